"""Trees of documents as table rows: making, naming and deleting them, and writing their nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import pack

COLUMNS = "id long, document_set_id long, root_node_id long, title string, tag_id long, language string, supplied_stop_words string, important_words string, description string, progress double"


def create_tree(tree: DataFrame, document_set_id: int, title: str, tag_id: int | None = None, language: str = "en", supplied_stop_words: str = "", important_words: str = "") -> tuple[DataFrame, int]:
    """The trees with one more, which isn't begun yet (progress 0, no root), and its id: the set's next number."""
    top = tree.filter(F.col("document_set_id") == document_set_id).agg(F.max("id")).first()[0]
    number = (document_set_id << 32) if top is None else top + 1
    fresh = tree.sparkSession.createDataFrame([(number, document_set_id, None, title, tag_id, language, supplied_stop_words, important_words, "", 0.0)], COLUMNS)
    return tree.unionByName(fresh, allowMissingColumns=True), number


def update_tree(tree: DataFrame, tree_id: int, title: str) -> DataFrame:
    return tree.withColumn("title", F.when(F.col("id") == tree_id, F.lit(title)).otherwise(F.col("title")))


def finish_tree(tree: DataFrame, node: DataFrame, bridge: DataFrame, tree_id: int, nodes: DataFrame, node_documents: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A clustering's result stored: node numbers move into the tree's set, the tree gets its root and is done."""
    document_set_id = tree_id >> 32
    last = node.filter(F.shiftright("id", 32) == document_set_id).agg(F.max("id")).first()[0]
    first = 0 if last is None else (last & 0xFFFFFFFF) + 1
    moved = lambda c: pack(F.lit(document_set_id), F.col(c) + first)
    root = (document_set_id << 32) + first
    new_nodes = nodes.select(moved("id").alias("id"), F.lit(root).cast("long").alias("root_id"), F.when(F.col("parent_id").isNotNull(), moved("parent_id")).alias("parent_id"), *[c for c in nodes.columns if c not in ("id", "root_id", "parent_id")])
    new_bridge = node_documents.select(moved("node_id").alias("node_id"), "document_id")
    done = tree.withColumns({"root_node_id": F.when(F.col("id") == tree_id, F.lit(root)).otherwise(F.col("root_node_id")), "progress": F.when(F.col("id") == tree_id, F.lit(1.0)).otherwise(F.col("progress"))})
    return done, node.unionByName(new_nodes, allowMissingColumns=True), bridge.unionByName(new_bridge)


def delete_tree(tree: DataFrame, node: DataFrame, bridge: DataFrame, tree_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trees, nodes and node documents without the tree's."""
    root = tree.filter(F.col("id") == tree_id).select(F.col("root_node_id").alias("root_id"))
    nodes = node.join(root, "root_id", "left_semi").select(F.col("id").alias("node_id"))
    return tree.filter(F.col("id") != tree_id), node.join(root, "root_id", "left_anti").select(*node.columns), bridge.join(nodes, "node_id", "left_anti")


def incomplete_trees(tree: DataFrame, document_set: DataFrame, document_set_user: DataFrame) -> DataFrame:
    """Trees that aren't done, with their set's title and its owner, if any."""
    sets = document_set.select(F.col("id").alias("document_set_id"), F.col("title").alias("set_title"))
    owners = document_set_user.filter("role = 'Owner'").select("document_set_id", "user_email")
    return tree.filter("progress <> 1").join(sets, "document_set_id").join(owners, "document_set_id", "left")


def write_nodes(node: DataFrame, bridge: DataFrame, folder: str, mode: str = "append") -> None:
    """Both tables of a clustering, a folder per document set: a search for a set's nodes reads its folder only."""
    owner = lambda c: F.shiftright(F.col(c), 32).alias("document_set_id")
    node.withColumn("document_set_id", owner("id")).write.mode(mode).partitionBy("document_set_id").parquet(f"{folder}/node")
    bridge.withColumn("document_set_id", owner("node_id")).write.mode(mode).partitionBy("document_set_id").parquet(f"{folder}/node_document")
