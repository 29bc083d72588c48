"""Quality rules: base text statistics and a hashed n-gram log-likelihood ratio, all in DataFrame operations.

The ratio compares two multinomials over hashed unigrams and bigrams: that of a trusted target (documents labelled good)
and that of the raw corpus.  A document's score is its mean ratio per n-gram, and a fixed threshold decides every document.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import few
from .let import let

SPACE = r"[\x20\x09-\x0D]+"
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
BUCKETS = 1 << 13
PSEUDO_COUNT = 1.0
LEAST_SCORE = -0.25


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur at least twice in the text."""

    def covered(grams: Column) -> Column:
        pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spread(s: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(s, i)["h"] == F.get(s, j)["h"], F.lit(False))
            twice = F.filter(s, lambda x, i: same(i, i - 1) | same(i, i + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), F.lit(0)).otherwise(let(pairs, spread))

    grams = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    return let(grams, covered)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_struct(text: Column) -> Column:
    """A struct of BASE (longs) of a text; null counts as empty.  The text is split into words once."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counts(w: Column) -> Column:
        values = (
            F.size(w),
            F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x)),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
            _repeat_words(w),
        )
        return F.struct(*[v.cast("long").alias(name) for v, name in zip(values, BASE, strict=True)])

    return let(words_of(text), counts)


def hashed_grams(text: Column) -> Column:
    """Buckets of a text's lower-cased tokens (runs of letters and digits, runs of other marks) and token pairs."""
    bucket = lambda *x: F.xxhash64(*x).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")  # noqa: E731  BUCKETS is a power of two
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))

    def both(t: Column) -> Column:
        return F.concat(F.transform(t, lambda x: bucket(x)), F.transform(F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0))), lambda x, i: bucket(F.get(t, i), x)))

    return let(tokens, both)


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[float]:
    """log(target / raw) of each of the BUCKETS hashed n-gram buckets, with a pseudo-count.

    Target: documents whose labels all have quality 1; raw: all documents.  The result's size is fixed, whatever the corpus.
    """
    trusted = labels.filter("doc_id is not null").groupBy(F.col("doc_id").alias("__id")).agg(F.min("quality").alias("q")).filter("q = 1").select("__id", F.lit(1).alias("__target"))
    trusted = few(trusted)
    texts = docs.select(F.col(id_col).cast("long").alias("__doc"), F.col(text_col).alias("__text")).join(trusted, F.col("__doc") == F.col("__id"), "left")
    counts = texts.select("__target", F.explode(hashed_grams(F.col("__text"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("__target").alias("target")).collect()
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for row in counts:
        raw[row.bucket], target[row.bucket] = row.raw, row.target
    if not sum(target):
        return [0.0] * BUCKETS
    norm = math.log((sum(raw) + PSEUDO_COUNT * BUCKETS) / (sum(target) + PSEUDO_COUNT * BUCKETS))
    return [norm + math.log((t + PSEUDO_COUNT) / (r + PSEUDO_COUNT)) for r, t in zip(raw, target, strict=True)]


def mean_ratio(text: Column, ratios: list[float]) -> Column:
    """Mean log ratio per n-gram; 0 for a text without any."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return let(hashed_grams(text), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total(g) / F.size(g)))


def quality(docs: DataFrame, ratios: list[float], text_col: str = "text", least_score: float = LEAST_SCORE) -> DataFrame:
    """``docs`` with a struct ``__quality``: the base columns, base_failed, score and kept.  One narrow pass, no shuffle.

    base_failed: fewer than 50 words, or over half of the words repeated.  kept: not base_failed and score >= least_score.
    Null and empty texts have all counts 0 and fail.  Ties don't arise: every row is decided by itself, repeated rows alike.
    Columns of ``docs``, whatever their names, are kept as they are.
    """
    struct = F.struct(base_struct(F.col(text_col)).alias("base"), mean_ratio(F.col(text_col), ratios).alias("score"))

    def judged(x: Column) -> Column:
        b = x["base"]
        failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
        return F.struct(*[b[n].alias(n) for n in BASE], failed.alias("base_failed"), x["score"].alias("score"), (~failed & (x["score"] >= least_score)).alias("kept"))

    return docs.withColumn("__quality", let(struct, judged))
