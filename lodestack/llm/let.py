"""Naming of intermediate values in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body, or a lambda in it, reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
