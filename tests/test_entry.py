"""The registry, and every core query against its SQL on small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns == ["id", "pos", "title", "n_chars"] and entry.entry(spark).count() > 0


def value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return ""
    return f"{float(x):.6g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", list(catalog.SQL))
def test_core_query_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    found = catalog.Q[name](spark, SF)
    result = con.execute(catalog.SQL[name])
    columns = sorted(c[0] for c in result.description)
    assert sorted(found.columns) == columns
    order = [[c[0] for c in result.description].index(c) for c in columns]
    want = sorted([value(r[i]) for i in order] for r in result.fetchall())
    assert sorted([value(x) for x in r] for r in found.select(*columns).collect()) == want
