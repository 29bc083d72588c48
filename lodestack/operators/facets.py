"""Counts over selections and per-document lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _of(bridge: DataFrame, selection: DataFrame | None, column: str) -> DataFrame:
    if selection is None:
        return bridge
    ids = selection.select(F.col("id").alias("__id"))
    return bridge.join(ids, bridge[column] == ids["__id"], "left_semi")


def tag_counts(document_tag: DataFrame, selection: DataFrame) -> DataFrame:
    """tag_id, n over a selection; tags without documents are left out."""
    return _of(document_tag, selection, "document_id").groupBy("tag_id").agg(F.count("*").alias("n"))


def all_tag_counts(tag: DataFrame, document_tag: DataFrame) -> DataFrame:
    """Every tag with its number of documents, zeros included."""
    counts = document_tag.groupBy("tag_id").agg(F.count("*").alias("n"))
    return tag.join(counts, tag["id"] == counts["tag_id"], "left").select(tag["id"], "name", "color", F.coalesce("n", F.lit(0)).alias("n"))


def node_counts(node_document: DataFrame, selection: DataFrame, node_ids: list[int]) -> DataFrame:
    rows = node_document.filter(F.col("node_id").isin(node_ids))
    return _of(rows, selection, "document_id").groupBy("node_id").agg(F.count("*").alias("n"))


def object_counts(document_store_object: DataFrame, store_object: DataFrame, store_id: int, selection: DataFrame) -> DataFrame:
    own = store_object.filter(F.col("store_id") == store_id).select(F.col("id").alias("store_object_id"))
    rows = document_store_object.join(own, "store_object_id", "left_semi")
    return _of(rows, selection, "document_id").groupBy("store_object_id").agg(F.count("*").alias("n"))


def lists_per_document(bridge: DataFrame, value: str, ids: DataFrame, keep_empty: bool) -> DataFrame:
    """id, ``values``: sorted values of the bridge for each id; without any an empty list, or no row."""
    lists = _of(bridge, ids, "document_id").groupBy(F.col("document_id").alias("id")).agg(F.sort_array(F.collect_list(value)).alias("values"))
    if not keep_empty:
        return lists
    kind = f"array<{bridge.schema[value].dataType.simpleString()}>"
    return ids.select("id").join(lists, "id", "left").withColumn("values", F.coalesce("values", F.array().cast(kind)))


def totals(df: DataFrame, **sums: str | Column) -> DataFrame:
    """One row: n rows, and sums with nothing as 0."""
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(name) for name, c in sums.items()])


def set_counts(documents: DataFrame, errors: DataFrame) -> DataFrame:
    """document_set_id, n_documents and n_errors of each set that has any: kept with the set after documents were added."""
    both = documents.select("document_set_id", F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(errors.select("document_set_id", F.lit(0).alias("d"), F.lit(1).alias("e")))
    return both.groupBy("document_set_id").agg(F.sum("d").alias("n_documents"), F.sum("e").alias("n_errors"))


def views_and_trees(view: DataFrame, tree: DataFrame, literal: bool = False) -> DataFrame:
    """document_set_id, n of views and trees together.  ``literal``: two equal counts are counted once."""
    per = lambda df: df.groupBy("document_set_id").agg(F.count("*").alias("n"))
    both = per(view).unionByName(per(tree))
    return (both.distinct() if literal else both).groupBy("document_set_id").agg(F.sum("n").alias("n"))


def children_done(file2: DataFrame) -> DataFrame:
    """Parents all of whose children are ingested: id, n_children."""
    done = file2.filter(F.col("parent_id").isNotNull() & F.col("ingested_at").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("done"))
    return file2.select("id", "n_children").join(done, "id").filter("done = n_children").select("id", "n_children")
