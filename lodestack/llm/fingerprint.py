"""Bottom-k sketches of word shingles, in DataFrame operations.

A sketch is the K least hashes of a text's distinct five-word shingles.  Sketches of parts merge into that of the whole;
two of them estimate resemblance and containment, and one the number of distinct shingles.  A sketch of fewer than K
hashes holds every shingle, so estimates from such sketches are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import few, settled
from .let import let
from .quality import words_of

WORDS = 5
K = 128
#: Documents per bucket of the id order, and the most buckets: their bounds are one array, and a row each is broadcast.
PER_BUCKET, MOST_BUCKETS = 64, 1 << 17
BROADCAST_BYTES = 16_000_000


def sketch(text: Column, k: int = K) -> Column:
    """Sorted array of at most k longs.  Null, empty and blank texts: empty.  Fewer than WORDS words: their sequence is the one shingle."""

    def hashes(w: Column) -> Column:
        whole = F.array(F.xxhash64(F.array_join(w, " ")))
        at = lambda i: F.get(w, i)
        grams = F.transform(F.slice(w, F.lit(1), F.greatest(F.size(w) - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[at(i + j) for j in range(1, WORDS)]))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < WORDS, whole).otherwise(grams)

    return F.slice(F.sort_array(F.array_distinct(let(words_of(F.coalesce(text, F.lit(""))), hashes))), F.lit(1), F.lit(k))


def merged(sketches: Column, k: int = K) -> Column:
    """Sketch of the union of texts, from an array of their sketches."""
    return F.slice(F.sort_array(F.array_distinct(F.flatten(sketches))), F.lit(1), F.lit(k))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity of the shingle sets; 1 for two empty ones."""
    least = lambda u: F.slice(F.sort_array(u), F.lit(1), F.lit(k))
    share = lambda u: F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)
    return let(F.array_union(a, b), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(let(least(u), share)))


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's rank among all hashes."""
    rank = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / rank)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's count over a's count."""
    both = merged(F.array(a, b), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * distinct_shingles(both, k) / distinct_shingles(a, k)))


def shown(s: Column) -> Column:
    """A sketch as text: base 64 of the joined 8-byte hashes."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda x: F.lpad(F.hex(x), 16, "0")), "")))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most ``key``: a binary search."""
    if not bounds:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")

    def search(t: Column) -> Column:
        def step(acc: Column, _: Column) -> Column:
            def half(middle: Column) -> Column:
                below = F.coalesce(F.get(t, middle) <= key, F.lit(False)) & (acc["low"] < acc["high"])
                return F.struct(F.when(below, middle + 1).otherwise(acc["low"]).alias("low"), F.when(below, acc["high"]).otherwise(F.least(middle, acc["high"])).alias("high"))

            return let(F.floor((acc["low"] + acc["high"]) / 2).cast("int"), half)

        start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step, lambda acc: acc["low"])

    return let(table, search)


def with_next(docs: DataFrame, key: str, value: str) -> DataFrame:
    """``docs`` with ``next_<value>``, of the row of the next smaller key (a long); after the least comes the greatest.

    The keys alone are range-sorted first; every n-th of them, of MOST_BUCKETS at most, bounds a bucket, so buckets have
    like numbers of rows however the keys lie.  Each bucket is one window partition and gets beside its own rows the row
    that ends the bucket before it: one shuffle of the rows, and a broadcast of one key a bucket.  Rows of one key have the
    same next; that of the key above is the least ``value`` among them.  Only one row of such a key goes through the
    window, the others are joined to it.  Rows with a null key stand outside the order: their next is null.
    """
    spark = docs.sparkSession
    nothing = F.lit(None).cast(docs.schema[value].dataType).alias(f"next_{value}")
    keyed = docs.filter(F.col(key).isNotNull())
    counts = keyed.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("__n"))
    counts = settled(counts.repartitionByRange("__key").sortWithinPartitions("__key").withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "keys")
    n, high, repeats = counts.agg(F.count("*"), F.max("__key"), F.count(F.when(F.col("__n") > 1, 1))).first()
    alone = docs.filter(F.col(key).isNull()).select("*", nothing)
    if n == 0:
        return alone
    width = max(PER_BUCKET, n // MOST_BUCKETS)
    bounds = sorted(r[0] for r in counts.filter(F.col("__at") % width == 0).select("__key").collect())[1:]
    ends = counts.select("__key", _bucket(F.col("__key"), bounds).alias("b")).groupBy("b").agg(F.max("__key").alias("last")).collect()  # a row a bucket
    after = [(r["last"], r.b + 1) for r in ends if r["last"] != high] + [(high, 0)]
    ends = F.broadcast(spark.createDataFrame(after, "__end long, __for int"))

    single = keyed
    if repeats:
        many = few(counts.filter("__n > 1").select("__key"))
        least = keyed.join(many, F.col(key) == F.col("__key"), "left_semi").groupBy(key).agg(F.min(value).alias(value))
        single = keyed.join(many, F.col(key) == F.col("__key"), "left_anti").unionByName(least, allowMissingColumns=True)
    guests = single.join(ends, F.col(key) == F.col("__end")).select(F.lit(None).cast("long").alias("__own"), value, F.col("__for").alias("__bucket"))
    own = single.select("*", F.col(key).alias("__own"), _bucket(F.col(key), bounds).alias("__bucket"))
    w = Window.partitionBy("__bucket").orderBy(F.col("__own").asc_nulls_first())
    placed = own.unionByName(guests, allowMissingColumns=True).withColumn(f"next_{value}", F.lag(value).over(w)).filter("__own is not null")
    if not repeats:
        return placed.select(*docs.columns, f"next_{value}").unionByName(alone)
    placed = settled(placed.select(*docs.columns, f"next_{value}"), "in-order")
    nexts = settled(placed.join(many, F.col(key) == F.col("__key"), "left_semi").select(F.col(key).alias("__of"), f"next_{value}"), "nexts")
    size = nexts.agg(F.sum(F.octet_length(F.coalesce(f"next_{value}", F.lit(""))) + 64)).first()[0] or 0
    nexts = F.broadcast(nexts) if size <= BROADCAST_BYTES else nexts
    others = keyed.join(nexts, F.col(key) == F.col("__of")).select(*docs.columns, f"next_{value}")
    return placed.join(many, F.col(key) == F.col("__key"), "left_anti").unionByName(others).unionByName(alone)


def edited(text: Column, following: Column) -> Column:
    """The text with its last floor(n/2) code points replaced by the first as many of the following one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.left(text, F.length(text) - half), F.left(following, half))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with its sketch, its edited text's (see ``edited``) and the next document's, in descending id order.

    Null texts are empty.  A document without an id has no next one: its edited text just loses the second half, and its
    next sketch is empty.  Rows that share an id have the same next document, that of the next smaller id; the next one of
    the id above is the least text among them.  Further columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", "text")
    text = rows.select("doc_id", "text", F.coalesce("next_text", F.lit("")).alias("next_text"))
    text = text.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return text.select("doc_id", F.length("text").cast("long").alias("n_chars"), "edited", sketch(F.col("text")).alias("sketch"), sketch(F.col("edited")).alias("edited_sketch"), sketch(F.col("next_text")).alias("next_sketch"))
