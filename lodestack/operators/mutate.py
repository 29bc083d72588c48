"""Changes to tables, each as a new DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import number_of, pack
from ..functions.text import infer_fields, parse_schema, schema_of
from ..shared import few, settled
from .sorting import positioned

#: The tag colours that a tag's name is hashed to.
PALETTE = [
    "ff0009", "ff7700", "fff700", "09ff00", "00ff77", "00fff7", "0089ff", "0009ff", "7700ff", "f700ff", "ff0089", "ff7378",
    "ffb573", "fffb73", "beff73", "78ff73", "73ffb5", "73fffb", "73beff", "7378ff", "b573ff", "fb73ff", "ff73be",
]


def tag_selection(document_tag: DataFrame, ids: DataFrame, tag_id: int) -> DataFrame:
    """Tagging twice changes nothing."""
    fresh = ids.select(F.col("id").alias("document_id"), F.lit(tag_id).cast(document_tag.schema["tag_id"].dataType).alias("tag_id"))
    return document_tag.unionByName(fresh.distinct().join(document_tag, ["document_id", "tag_id"], "left_anti"))


def untag_selection(document_tag: DataFrame, ids: DataFrame, tag_id: int) -> DataFrame:
    gone = ids.select(F.col("id").alias("document_id"), F.lit(tag_id).alias("tag_id")).distinct()
    return document_tag.join(gone, ["document_id", "tag_id"], "left_anti")


def delete_tag(tag: DataFrame, document_tag: DataFrame, tag_id: int) -> tuple[DataFrame, DataFrame]:
    return tag.filter(F.col("id") != tag_id), document_tag.filter(F.col("tag_id") != tag_id)


def upsert_links(links: DataFrame, new: DataFrame, store_object: DataFrame, store_id: int, documents: DataFrame) -> DataFrame:
    """document_store_object rows replaced or added; rows of another store's objects or of unknown documents are ignored."""
    own = store_object.filter(F.col("store_id") == store_id).select(F.col("id").alias("store_object_id"))
    valid = new.join(own, "store_object_id", "left_semi").join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    valid = valid.dropDuplicates(["document_id", "store_object_id"])
    return links.join(valid, ["document_id", "store_object_id"], "left_anti").unionByName(valid)


def delete_links(links: DataFrame, gone: DataFrame) -> DataFrame:
    return links.join(gone.select("document_id", "store_object_id").distinct(), ["document_id", "store_object_id"], "left_anti")


def edit(documents: DataFrame, changes: DataFrame, write_nulls: bool = False) -> DataFrame:
    """``changes``: id, once each, and the new values of some columns; null leaves a value as it is, or with ``write_nulls`` is one."""
    columns = [c for c in changes.columns if c != "id"]
    new = changes.select("id", F.lit(True).alias("__changed"), *[F.col(c).alias(f"__{c}") for c in columns])
    joined = documents.join(new, "id", "left")
    value = lambda c: F.when(F.col("__changed"), F.col(f"__{c}")).otherwise(F.col(c)) if write_nulls else F.coalesce(f"__{c}", c)
    return joined.select(*[value(c).alias(c) if c in columns else F.col(c) for c in documents.columns])


def edit_indexed(documents: DataFrame, postings: DataFrame, changes: DataFrame, metadata_fields: list[str] = (), analyzer: str = "unicode", sorts=None, write_nulls: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents after an edit and their index, in which only the edited ones are indexed anew; their sets' sorts are dropped from ``sorts``."""
    from .index import reindexed

    ids = settled(changes.select("id").distinct(), "edited")
    after = edit(documents, changes, write_nulls)
    if sorts is not None:
        for row in documents.join(ids, "id", "left_semi").select("document_set_id").distinct().toLocalIterator():
            sorts.changed(row.document_set_id)
    return after, reindexed(postings, after, metadata_fields, analyzer, ids=ids)


def rebased(df: DataFrame, columns: list[str], new_set_id: int) -> DataFrame:
    """Ids moved to another document set: the upper half is replaced, the number kept."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), pack(F.lit(new_set_id), number_of(F.col(c)))) for c in columns})


def clone(tables: dict[str, DataFrame], new_set_id: int, first_tag_id: int) -> dict[str, DataFrame]:
    """documents, errors, tag, document_tag, tree, node and node_document of a set, under new ids; tags get ids from ``first_tag_id`` on."""
    out = dict(tables)
    owned = lambda df: df.withColumn("document_set_id", F.lit(new_set_id).cast("long"))
    if "documents" in tables:
        out["documents"] = owned(rebased(tables["documents"], ["id"], new_set_id))
    if "errors" in tables:
        out["errors"] = owned(tables["errors"])
    if "tag" in tables:
        names = settled(positioned(tables["tag"].select(F.col("id").alias("__old")), [F.col("__old")]).select("__old", (F.col("pos") + first_tag_id).alias("__new")), "new-tags")
        kind = tables["tag"].schema["id"].dataType
        out["tag"] = owned(tables["tag"].join(names, tables["tag"]["id"] == names["__old"]).withColumn("id", F.col("__new").cast(kind)).drop("__old", "__new"))
        if "document_tag" in tables:
            links = tables["document_tag"].join(few(names), F.col("tag_id") == F.col("__old")).withColumn("tag_id", F.col("__new").cast(tables["document_tag"].schema["tag_id"].dataType)).drop("__old", "__new")
            out["document_tag"] = rebased(links, ["document_id"], new_set_id)
    if "tree" in tables:
        out["tree"] = owned(rebased(tables["tree"], ["id", "root_node_id"], new_set_id))
    if "node" in tables:
        out["node"] = rebased(tables["node"], ["id", "root_id", "parent_id"], new_set_id)
    if "node_document" in tables:
        out["node_document"] = rebased(tables["node_document"], ["node_id", "document_id"], new_set_id)
    return out


def delete_set(tables: dict[str, DataFrame], document_set_id: int) -> dict[str, DataFrame]:
    """Every table with a document_set_id loses the set's rows; bridges lose those of its documents; files that only it uses go."""
    keep = lambda c: (F.shiftright(F.col(c), 32) != document_set_id) | F.col(c).isNull()
    out = {name: df.filter(F.coalesce(F.col("document_set_id") != document_set_id, F.lit(True))) if "document_set_id" in df.columns else df.filter(keep("document_id")) if "document_id" in df.columns else df for name, df in tables.items()}
    if "file" in tables and "document_set_file" in tables:
        gone = unshared_files(tables["document_set_file"], document_set_id).select(F.col("file_id").alias("id"))
        out["file"] = tables["file"].join(gone, "id", "left_anti")
    return out


def unshared_files(document_set_file: DataFrame, document_set_id: int) -> DataFrame:
    """Files that only this set uses: those that go with it."""
    users = document_set_file.groupBy("file_id").agg(F.countDistinct("document_set_id").alias("n"), F.max((F.col("document_set_id") == document_set_id).cast("int")).alias("here"))
    return users.filter("n = 1 and here = 1").select("file_id")


def java_hash(name: str) -> int:
    """Java's String.hashCode, over UTF-16 units."""
    data, h = name.encode("utf-16-be", "surrogatepass"), 0
    for i in range(0, len(data), 2):
        h = (31 * h + (data[i] << 8 | data[i + 1])) & 0xFFFFFFFF
    return h - (1 << 32) if h >= 1 << 31 else h


def tag_color(name: str) -> str:
    return PALETTE[java_hash(name) % len(PALETTE)]


def next_numbers(new: DataFrame, existing: DataFrame, document_set_id: int, order: list[Column]) -> DataFrame:
    """New rows with ids that follow the set's greatest; an empty set starts at number 0."""
    top = existing.filter(F.col("document_set_id") == document_set_id).agg(F.max("id")).first()[0]
    top = (document_set_id << 32) - 1 if top is None else top
    return positioned(new, order, "__n").withColumn("id", F.lit(top + 1) + F.col("__n")).drop("__n")


def finish_upload(document_set: DataFrame, document_set_id: int, title: str, metadata_json: str) -> DataFrame:
    """The sets with a new one, whose metadata schema has the fields of the upload's metadata."""
    row = document_set.sparkSession.createDataFrame([(document_set_id, title, schema_of(infer_fields(metadata_json)))], "id long, title string, metadata_schema string")
    return document_set.unionByName(row, allowMissingColumns=True)


def update_schema(document_set: DataFrame, document_set_id: int, schema: str) -> DataFrame:
    """A set's metadata schema replaced.  Raises ValueError for what isn't one."""
    parse_schema(schema)
    return document_set.withColumn("metadata_schema", F.when(F.col("id") == document_set_id, F.lit(schema)).otherwise(F.col("metadata_schema")))


def put_state(state: DataFrame, key: str, value: str) -> DataFrame:
    """A store's key-value state after one write."""
    return state.filter(F.col("key") != key).unionByName(state.sparkSession.createDataFrame([(key, value)], "key string, value string"))


def get_state(state: DataFrame, key: str, default: str = "{}") -> str:
    row = state.filter(F.col("key") == key).first()
    return default if row is None else row.value


def upsert_objects(store_object: DataFrame, new: DataFrame, store_id: int) -> DataFrame:
    """A store's objects replaced or added by id; another store's objects can't be changed."""
    mine = new.withColumn("store_id", F.lit(store_id).cast(store_object.schema["store_id"].dataType))
    foreign = store_object.filter(F.col("store_id") != store_id).select("id")
    valid = mine.join(foreign, "id", "left_anti").dropDuplicates(["id"])
    return store_object.join(valid.select("id"), "id", "left_anti").unionByName(valid, allowMissingColumns=True)


def delete_objects(store_object: DataFrame, links: DataFrame, ids: list[int], store_id: int) -> tuple[DataFrame, DataFrame]:
    """Objects of a store deleted with their links."""
    gone = store_object.filter((F.col("store_id") == store_id) & F.col("id").isin(ids)).select("id")
    return store_object.join(gone, "id", "left_anti"), links.join(gone.withColumnRenamed("id", "store_object_id"), "store_object_id", "left_anti")
