"""Mixing sources to target weights by balanced (cube-method) sampling.

A source's target over its size gives each of its documents the same expected number of copies: a whole part that all
get, and an inclusion probability for one copy more.  The flight phase moves the probabilities of three documents at a
time along the null space of the two balance constraints (words, documents) until one of them is 0 or 1.  Chunks of a
source fly apart; each leaves at most LANDING open documents, which fly again together, so the landing problem has at
most LANDING documents a source, whatever its size: of all their roundings the one is taken that brings the source's
words nearest to its target, and of equal ones the number of documents.  The smallest fly first; a few drawn ones and the
largest come last, since a landing of documents of many sizes comes nearer than one of like sizes.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sorting import positioned
from ..shared import few, settled

SPACE = r"[\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
#: Documents of one flight, those that a flight leaves open, and the drawn and the largest ones that come last in it.
CHUNK, LANDING = 256, 16
DRAWN, LARGEST = 8, 3
#: Equal rows are numbered in runs of so many.
RUN = 1000
SMALL = 1e-12


def fly(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, keep: int = 2) -> np.ndarray:
    """Probabilities after the flight phase: all but at most ``keep`` (2 or more) are 0 or 1, and sum(p) and sum(size * p) are as before."""
    p = p.copy()
    open_ = [i for i in range(len(p)) if SMALL < p[i] < 1 - SMALL]
    active, rest = open_[:3], open_[3:][::-1]
    draws = iter(rng.random(len(p) + 3).tolist())
    while len(active) + len(rest) > keep:
        a, b, c = active
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if not any(u):
            u = (1.0, -1.0, 0.0)
        up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(active, u, strict=True) if x)
        down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(active, u, strict=True) if x)
        step = up if next(draws) < down / (up + down) else -down
        for i, x in zip(active, u, strict=True):
            p[i] = min(1.0, max(0.0, p[i] + step * x))
            if p[i] < SMALL or p[i] > 1 - SMALL:
                p[i] = round(p[i])
        active = [i for i in active if 0 < p[i] < 1]
        while len(active) < 3 and rest:
            active.append(rest.pop())
    return p


@lru_cache(maxsize=2)
def _roundings(n: int) -> np.ndarray:
    return (np.arange(1 << n)[:, None] >> np.arange(n)[None, :] & 1).astype(float)


def land(size: np.ndarray, p: np.ndarray) -> np.ndarray:
    """The open probabilities, LANDING at most, rounded so that the words come nearest to their expectation, then the documents."""
    p = p.copy()
    open_ = np.flatnonzero((p > 0) & (p < 1))
    if len(open_):
        choices = _roundings(len(open_))
        words = np.abs(choices @ size[open_] - float((size * p)[open_].sum()))
        count = np.abs(choices.sum(axis=1) - float(p[open_].sum()))
        p[open_] = choices[np.lexsort((count.round(9), words.round(6)))[0]]
    return p


FIELDS = "source string, doc_id long, size long, row long, p double"


def flight_order(size: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Places from the smallest to the largest size, but DRAWN ones of least draw and then the LARGEST last; equal sizes by draw."""
    order = np.lexsort((row, size))
    rest, top = order[: max(0, len(order) - LARGEST)], order[max(0, len(order) - LARGEST) :]
    drawn = rest[np.argsort(row[rest], kind="stable")[:DRAWN]]
    return np.concatenate((rest[~np.isin(rest, drawn)], drawn, top))


def _flight(group: pd.DataFrame) -> pd.DataFrame:
    group = group[["source", "doc_id", "size", "row", "p"]].sort_values(["size", "row", "doc_id"], na_position="last", kind="stable")
    group = group.iloc[flight_order(group["size"].to_numpy(), group["row"].to_numpy())].reset_index(drop=True)
    if len(group):
        seed = int(group["size"].sum()) * 1_000_003 + len(group)
        group["p"] = fly(group["size"].to_numpy(float), group.p.to_numpy(float), np.random.default_rng(seed), LANDING)
    return group


def _landing(group: pd.DataFrame) -> pd.DataFrame:
    """Last flight and landing of a source's open documents."""
    group = _flight(group)
    group["p"] = land(group["size"].to_numpy(float), group.p.to_numpy(float))
    return group


def sized(docs: DataFrame, id_col: str, source_col: str, text_col: str) -> DataFrame:
    words = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), SPACE, -1), lambda w: w != ""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(source, size) -> (source, size, target), a table of any length.

    Sources in code-point order, null last, weigh ``weights``, repeating.  They share all words by weight; a target stops
    at ``most`` times its source's size, and what is over is shared by weight among the others until none is above.  Sums
    are of whole numbers, so reruns agree; each round is one pass over the sources.
    """
    order = positioned(sizes.select("source", "size"), [F.col("source").isNull().asc(), F.encode("source", "UTF-8").asc()])
    weight = F.get(F.lit(list(weights)), (F.col("pos") % len(weights)).cast("int"))
    order = settled(order.select("source", "size", weight.cast("long").alias("weight")), "sources")
    total = order.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    left, whole = total, None  # words to share, weights that share them
    while True:
        over = F.lit(False) if whole is None else F.lit(left).cast("double") * F.col("weight") / F.lit(whole) > F.col("size") * most
        capped, free = order.filter(over).agg(F.sum("size")).first()[0] or 0, order.filter(~over).agg(F.sum("weight")).first()[0] or 0
        if whole is not None and (total - most * capped, free) == (left, whole):
            break
        left, whole = total - most * capped, free
        if not free:
            break
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(whole or 1))
    return order.select("source", "size", F.least(share, (F.col("size") * most).cast("double")).alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with a draw for each, ``row``, that rests on the row alone: equal rows are numbered, so that they draw apart."""
    equal = settled(rows.groupBy("source", "doc_id", "size").agg(F.count("*").alias("n")), "equal-rows")
    runs = equal.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    if equal.filter(F.col("n") > RUN).limit(1).count():  # so that many equal rows aren't made in one task
        runs = runs.repartition("source", "doc_id", "size", "run")
    nth = F.explode(F.sequence(F.col("run") * RUN, F.least(F.col("n"), (F.col("run") + 1) * RUN) - 1))
    return runs.select("source", "doc_id", "size", nth.alias("nth")).select("source", "doc_id", "size", F.xxhash64("doc_id", "size", "nth").alias("row"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, source, size (words), source_size, target (its source's words), copies, taken (size * copies).

    Null or empty texts have size 0 and take nothing; a null source is a source of its own, the last; rows without an id
    are mixed like others, repeated rows count each.  No document is taken more than MOST_COPIES times.  Draws depend on
    the rows alone, so reruns agree.  Further columns of ``docs`` are ignored.
    """
    rows = settled(sized(docs, id_col, source_col, text_col), "sizes")
    stats = settled(rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "source-sizes")
    ratio = F.when(F.col("size") > 0, F.least(F.col("target") / F.col("size"), F.lit(float(MOST_COPIES)))).otherwise(F.lit(0.0))
    goal = targets(stats).select(F.col("source").alias("of"), F.col("size").alias("source_size"), "target", ratio.alias("ratio"))
    table = settled(goal.join(stats.select("source", "n"), F.col("of").eqNullSafe(F.col("source"))).select("of", "source_size", "target", "ratio", F.ceil(F.col("n") / CHUNK).alias("chunks")), "targets")
    table = few(table)
    own = _numbered(rows).join(table, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    part = F.col("ratio") - F.floor(F.col("ratio") + F.lit(SMALL))
    chunked = own.select("source", "doc_id", "size", "row", F.when(part > SMALL, part).otherwise(F.lit(0.0)).alias("p"), F.pmod("row", "chunks").alias("chunk"))

    flown = settled(chunked.groupBy("source", "chunk").applyInPandas(_flight, FIELDS), "flown")
    done, left = [flown.filter("p = 0 or p = 1")], flown.filter("p > 0 and p < 1")
    while True:
        most = left.groupBy("source").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
        if most <= CHUNK:
            done.append(left.groupBy("source").applyInPandas(_landing, FIELDS))
            break
        flown = settled(left.groupBy("source", F.pmod("row", F.lit(-(-most // CHUNK)))).applyInPandas(_flight, FIELDS), "flown")
        done.append(flown.filter("p = 0 or p = 1"))
        left = flown.filter("p > 0 and p < 1")
    picked = done[0]
    for more in done[1:]:
        picked = picked.union(more)
    info = table.select("of", "source_size", "target", F.floor(F.col("ratio") + F.lit(SMALL)).cast("int").alias("whole"))
    out = picked.join(info, picked["source"].eqNullSafe(info["of"]))
    copies = (F.col("whole") + F.col("p").cast("int")).alias("copies")
    return out.select("doc_id", "source", "size", "source_size", "target", copies).withColumn("taken", F.col("size") * F.col("copies"))


def taken(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` as often as ``mixed`` takes them.

    Rows that share id and source, or have none, share the copies that ``mixed`` has for them evenly, in the order in which
    the table is read.  They are numbered by parts of the table, so no task gathers them.
    """
    key = [F.col("doc_id").alias("__id"), F.col("source").alias("__source")]
    copies = settled(mixed.groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__n")), "copies")
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & F.col(source_col).cast("string").eqNullSafe(F.col("__source"))
    out = docs.join(few(copies.filter("__n = 1")), same).withColumn("__each", F.col("__copies"))
    shared = copies.filter("__n > 1")
    if shared.limit(1).count():
        rows = settled(docs.join(few(shared), same).withColumn("__m", F.monotonically_increasing_id()), "rows-of-one-key")
        rows = rows.withColumn("__part", F.shiftright("__m", 33))
        per = rows.groupBy("__id", "__source", "__part").agg(F.count("*").alias("__here"))
        before = F.coalesce(F.sum("__here").over(Window.partitionBy("__id", "__source").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        offsets = per.select(F.col("__id").alias("__i"), F.col("__source").alias("__s"), F.col("__part").alias("__p"), before.alias("__before"))
        place = F.row_number().over(Window.partitionBy("__id", "__source", "__part").orderBy("__m"))
        placed = rows.withColumn("__place", place).join(few(settled(offsets, "offsets")), F.col("__id").eqNullSafe(F.col("__i")) & F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__part") == F.col("__p")))
        each = F.floor(F.col("__copies") / F.col("__n")) + (F.col("__before") + F.col("__place") <= F.col("__copies") % F.col("__n")).cast("long")
        out = out.unionByName(placed.withColumn("__each", each), allowMissingColumns=True)
    return out.withColumn("__copy", F.explode(F.expr("if(__each > 0, sequence(1L, __each), array())"))).select(*docs.columns)
