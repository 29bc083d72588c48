"""Joins that decorate documents, files and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import settled


def tags_of(ids: DataFrame, document_tag: DataFrame, tag: DataFrame) -> DataFrame:
    """(id, tag_id, name) for a selection's documents."""
    names = tag.select(F.col("id").alias("tag_id"), "name")
    return ids.select(F.col("id").alias("document_id")).join(document_tag, "document_id").join(names, "tag_id").select(F.col("document_id").alias("id"), "tag_id", "name")


def sizes(ids: DataFrame, document: DataFrame, file2: DataFrame, file: DataFrame, page: DataFrame) -> DataFrame:
    """Bytes of each document: of its page, its file, its new-style file, or its text, the first there is."""
    docs = ids.select("id").join(document, "id")
    for other, key in ((file2, "file2_id"), (file, "file_id"), (page, "page_id")):
        docs = docs.join(other.select(F.col("id").alias(key), F.col("n_bytes").alias(f"__{key}")), key, "left")
    return docs.select("id", F.coalesce("__page_id", "__file_id", "__file2_id", F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))


def page_infos(document: DataFrame, file2: DataFrame) -> DataFrame:
    """id, page_number and number of pages of documents that are pages of a parent file."""
    parent = file2.select(F.col("id").alias("parent_id"), F.col("n_children").alias("n_pages"))
    own = file2.filter("parent_id is not null").select(F.col("id").alias("file2_id"), "parent_id", (F.col("index_in_parent") + 1).alias("page_number"))
    return document.select("id", "file2_id").join(own, "file2_id").join(parent, "parent_id").select("id", "page_number", "n_pages")


def roots(file2: DataFrame) -> DataFrame:
    """Leaf files with their root's name; a file without a root is its own."""
    top = file2.select(F.col("id").alias("root"), F.col("filename").alias("root_filename"))
    return file2.select("id", "filename", F.coalesce("root_id", "id").alias("root")).join(top, "root")


def file_exists(file2: DataFrame, ids_in_set: DataFrame) -> DataFrame:
    """Files in a set: those listed, and their descendants."""
    return file2.withColumn("__root", F.coalesce("root_id", "id")).join(ids_in_set.select(F.col("id").alias("__root")), "__root", "left_semi").drop("__root")


def unfinished_files(file2: DataFrame) -> DataFrame:
    """Files of an interrupted ingest that still have work, with ``n_ingested_children``.

    A file that isn't processed, or has no children, comes by itself; a processed one brings its children that aren't
    ingested, and theirs.  Each round goes one level down, over a written table.
    """
    rows = settled(file2.filter("ingested_at is null"), "not-ingested")
    done = file2.filter("ingested_at is not null and parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("n_ingested_children"))
    level = settled(rows.filter("parent_id is null").select("id", "processed_at", "n_children"), "level")
    found = level.select("id")
    while level.limit(1).count():
        parents = level.filter("processed_at is not null and n_children > 0").select(F.col("id").alias("parent_id"))
        level = settled(rows.join(parents, "parent_id", "left_semi").select("id", "processed_at", "n_children"), "level")
        found = found.union(level.select("id"))
    return rows.join(found, "id", "left_semi").join(done, "id", "left").withColumn("n_ingested_children", F.coalesce("n_ingested_children", F.lit(0)))


def with_sha1(rows: DataFrame, sha1_hex: str, column: str = "sha1") -> DataFrame:
    return rows.filter(F.lower(F.hex(column)) == sha1_hex.lower())


def owned_sets(document_set: DataFrame, document_set_user: DataFrame, role: str = "Owner") -> DataFrame:
    """Sets with the user who has the role, newest first."""
    users = document_set_user.filter(F.col("role") == role).select(F.col("document_set_id").alias("id"), "user_email")
    return document_set.join(users, "id").orderBy(F.col("created_at").desc(), "id")


def jobs(kinds: dict[str, DataFrame], document_set: DataFrame, document_set_user: DataFrame) -> DataFrame:
    """Import jobs of all kinds with their set's title and owner, if any."""
    out = None
    for kind, rows in kinds.items():
        rows = rows.withColumn("kind", F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    sets = document_set.select(F.col("id").alias("document_set_id"), "title")
    owners = document_set_user.filter("role = 'Owner'").select("document_set_id", "user_email")
    return out.join(sets, "document_set_id").join(owners, "document_set_id", "left")


def objects(store_object: DataFrame, store_id: int, indexed_long: int | None = None, indexed_string: str | None = None) -> DataFrame:
    out = store_object.filter(F.col("store_id") == store_id)
    out = out if indexed_long is None else out.filter(F.col("indexed_long") == indexed_long)
    return out if indexed_string is None else out.filter(F.col("indexed_string") == indexed_string)


def in_page_order(page_ids: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a page's (pos, id) in its order; ids without a row give nulls."""
    return page_ids.join(rows, "id", "left").orderBy("pos")
