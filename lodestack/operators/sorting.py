"""Orders of documents, positions in them, and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import metadata_value
from ..shared import settled

CANONICAL = ("title", "supplied_id", "page_number", "id")


def canonical_order() -> list[Column]:
    """Title, supplied id, page number, id; nulls last."""
    return [F.col(c).asc_nulls_last() for c in CANONICAL]


def scalar_metadata(metadata_json: Column, field: str) -> Column:
    """A metadata field for sorting: objects, arrays, null and missing count as empty."""
    value = metadata_value(metadata_json, field)
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(metadata_json), "$['" + field.replace("'", "\\'") + "']", "variant"))
    return F.when(kind.startswith("OBJECT") | kind.startswith("ARRAY"), F.lit("")).otherwise(value)


def field_order(metadata_json: Column, field: str, collation: str = "en_USA") -> list[Column]:
    """A metadata field by ICU collation, then the canonical order."""
    return [F.collate(scalar_metadata(metadata_json, field), collation).asc(), *canonical_order()]


def positioned(df: DataFrame, order: list[Column], column: str = "pos") -> DataFrame:
    """``df`` with its 0-based place in the order, by a distributed sort.

    The range-partitioned sort numbers rows within each partition; a table of one row a partition, so of bounded size,
    brings the offsets.  The sorted rows are a written table, so both reads see the same numbers, also after an executor
    was lost, and nothing stays in memory.
    """
    numbered = settled(df.orderBy(*order).withColumn("__m", F.monotonically_increasing_id()), "sorted")
    part, within = F.shiftright("__m", 33), F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = sorted((r.part, r.n) for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = F.broadcast(df.sparkSession.createDataFrame(offsets or [(0, 0)], "__part long, __offset long"))
    placed = numbered.withColumn("__part", part).withColumn("__within", within).join(table, "__part")
    return placed.withColumn(column, F.col("__offset") + F.col("__within")).drop("__m", "__part", "__within", "__offset")


def page(selection: DataFrame, offset: int, limit: int, most: int = 1000, reverse: bool = False, total: int | None = None) -> DataFrame:
    """Rows of a positioned frame on one page: a filter on the position, no sort of the rest.  The limit is held to [1, most]."""
    limit, offset = max(1, min(limit, most)), max(0, offset)
    if not reverse:
        return selection.filter((F.col("pos") >= offset) & (F.col("pos") < offset + limit))
    total = selection.count() if total is None else total
    high = total - 1 - offset
    rows = selection.filter((F.col("pos") <= high) & (F.col("pos") > high - limit))
    return rows.withColumn("pos", F.lit(total - 1) - F.col("pos"))
