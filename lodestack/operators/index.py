"""The positional term index, as a table: postings(document_set_id, id, field, term, pos, begin, end).

Write it partitioned by document set and sorted by (field, term): a search then reads only the row groups of its terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import analyze, metadata_value, terms, tokens

#: Metadata fields indexed per document set; ``unindexed_fields`` names the others.
MOST_FIELDS = 100
#: Postings of the Unicode analyser go to Spark in parts of about so many.
PART = 20_000


def notes_text(notes: Column) -> Column:
    return F.array_join(F.transform(notes, lambda n: n["text"]), "\f")


def field_texts(docs: DataFrame, metadata_fields: list[str] = ()) -> dict[str, Column]:
    """Text of each indexed field; metadata fields are named ``meta:<name>``."""
    out = {f: F.col(f) for f in ("title", "text") if f in docs.columns}
    if "pdf_notes" in docs.columns:
        out["notes"] = notes_text(F.col("pdf_notes"))
    if "metadata_json" in docs.columns:
        out |= {f"meta:{f}": metadata_value(F.col("metadata_json"), f) for f in list(metadata_fields)[:MOST_FIELDS]}
    return out


def unindexed_fields(metadata_fields: list[str]) -> list[str]:
    """Fields beyond MOST_FIELDS, which no search finds."""
    return list(metadata_fields)[MOST_FIELDS:]


def build_postings(docs: DataFrame, metadata_fields: list[str] = (), analyzer: str = "unicode", offsets: bool = True) -> DataFrame:
    """One pass over ``docs`` (id, optional document_set_id, title, text, pdf_notes, metadata_json); no shuffle.

    Without ``offsets`` (begin and end null) the simple analyser is cheaper; searches don't need them.
    """
    owner = F.col("document_set_id") if "document_set_id" in docs.columns else F.lit(0)
    if analyzer == "unicode":
        return _unicode_postings(docs, owner, field_texts(docs, metadata_fields))
    bare = lambda text: F.transform(terms(text), lambda t: F.struct(t.alias("term"), F.lit(None).cast("int").alias("begin"), F.lit(None).cast("int").alias("end")))
    read = (lambda text: tokens(text, analyzer)) if offsets or analyzer != "simple" else bare
    fields = [F.struct(F.lit(name).alias("field"), read(text).alias("tokens")) for name, text in field_texts(docs, metadata_fields).items()]
    rows = docs.select(owner.cast("long").alias("document_set_id"), "id", F.explode(F.array(*fields)).alias("f"))
    return rows.select("document_set_id", "id", "f.field", F.posexplode("f.tokens").alias("pos", "t")).select("document_set_id", "id", "field", "t.term", "pos", "t.begin", "t.end")


def _unicode_postings(docs: DataFrame, owner: Column, texts: dict[str, Column]) -> DataFrame:
    """The postings by the Unicode analyser, a document after the other: a worker holds the words of PART postings and one field."""
    rows = docs.select(owner.cast("long").alias("document_set_id"), "id", *[t.alias(f"f{i}") for i, t in enumerate(texts.values())])
    names, part = list(texts), PART
    schema = StructType(rows.schema.fields[:2]).add("field", "string").add("term", "string").add("pos", "integer").add("begin", "integer").add("end", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [batch.schema.field(0).type, batch.schema.field(1).type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            made = lambda columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], schema.names)  # noqa: E731, B023
            columns: list[list] = [[] for _ in kinds]
            for i in range(batch.num_rows):
                owner_, id_ = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                for k, name in enumerate(names, 2):
                    found = analyze(batch.column(k)[i].as_py())
                    for at in range(0, len(found), part):
                        some = found[at : at + part]
                        for column, values in zip(columns, ([owner_] * len(some), [id_] * len(some), [name] * len(some), [t[0] for t in some], range(at, at + len(some)), [t[1] for t in some], [t[2] for t in some]), strict=True):
                            column += values
                        if len(columns[0]) >= part:
                            yield made(columns)
                            columns = [[] for _ in kinds]
            if columns[0]:
                yield made(columns)

    return rows.mapInArrow(run, schema)


def save_postings(postings: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per document set, sorted by term within files; ``mode="append"`` adds documents."""
    ranged = postings.repartitionByRange("document_set_id", "field", "term", "id").sortWithinPartitions("document_set_id", "field", "term", "id", "pos")
    ranged.write.mode(mode).partitionBy("document_set_id").parquet(path)


def replace_documents(postings: DataFrame, changed: DataFrame) -> DataFrame:
    """The index after some documents were indexed anew: their old rows go, the new ones come."""
    return postings.join(changed.select("id").distinct(), "id", "left_anti").unionByName(changed)


def without_documents(postings: DataFrame, ids: DataFrame) -> DataFrame:
    return postings.join(ids.select("id").distinct(), "id", "left_anti")


def dictionary(postings: DataFrame) -> DataFrame:
    """field, term, number of documents."""
    return postings.groupBy("field", "term").agg(F.countDistinct("id").alias("n_docs"))


def document_dictionary(docs: DataFrame, metadata_fields: list[str] = (), analyzer: str = "simple") -> DataFrame:
    """As ``dictionary`` of the postings of ``docs``, from each document's distinct terms: one map-side combined count."""
    read = (lambda text: F.transform(tokens(text, analyzer), lambda t: t["term"])) if analyzer != "simple" else terms
    fields = [F.struct(F.lit(name).alias("field"), F.array_distinct(read(text)).alias("terms")) for name, text in field_texts(docs, metadata_fields).items()]
    rows = docs.select(F.explode(F.array(*fields)).alias("f")).select("f.field", F.explode("f.terms").alias("term"))
    return rows.groupBy("field", "term").agg(F.count("*").alias("n_docs"))


def save_index(docs: DataFrame, path: str, metadata_fields: list[str] = (), analyzer: str = "unicode", offsets: bool = True) -> None:
    """Postings, and beside them their dictionary, which fuzzy and prefix terms are looked up in."""
    save_postings(build_postings(docs, metadata_fields, analyzer, offsets), f"{path}/postings")
    document_dictionary(docs, metadata_fields, analyzer).repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/dictionary")


def reindexed(postings: DataFrame, docs: DataFrame, metadata_fields: list[str] = (), analyzer: str = "unicode", document_set_id: int | None = None, ids: DataFrame | None = None) -> DataFrame:
    """The index after a reindex job: of one document set, of some documents, or of all."""
    if document_set_id is not None:
        docs, postings = docs.filter(F.col("document_set_id") == document_set_id), postings.filter(F.col("document_set_id") != document_set_id)
    elif ids is not None:
        docs, postings = docs.join(ids.select("id").distinct(), "id", "left_semi"), without_documents(postings, ids)
    else:
        postings = postings.limit(0)
    fresh = build_postings(docs, metadata_fields, analyzer)
    return postings.select(*fresh.columns).unionByName(fresh)
