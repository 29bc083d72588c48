"""Extension points: view filters that name document ids, and converters of ingested files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: name -> f(spark, object ids, operation "any" | "all" | "none") -> DataFrame with a column id
FILTERS: dict[str, Callable[[SparkSession, list[str], str], DataFrame]] = {}
#: MIME type, or "text/*" -> f(file: dict with filename, content_type, content, metadata) -> list of child dicts
CONVERTERS: dict[str, Callable[[dict], list[dict]]] = {}


def register_filter(name: str, f: Callable[[SparkSession, list[str], str], DataFrame]) -> None:
    FILTERS[name] = f


def register_converter(content_type: str, f: Callable[[dict], list[dict]]) -> None:
    CONVERTERS[content_type] = f


def converter_for(content_type: str) -> Callable[[dict], list[dict]] | None:
    return CONVERTERS.get(content_type) or CONVERTERS.get(f"{content_type.partition('/')[0]}/*")
