"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word stands for the hashed character n-grams of ``<word>`` and the word itself; a text's vector is the mean of its
n-grams' embeddings, and a linear softmax over it gives the classes.  Misspelt words share n-grams with known ones.
Embeddings and softmax are trained together by Adam.  Because everything after the embedding is linear, a trained model
folds into one number per n-gram bucket and a bias: scoring a text is a mean over its n-grams and a logistic function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing

SIZES = (3, 4, 5)
BUCKETS, DIMENSIONS = 1 << 16, 4
#: The classifier is fitted on at most so many labelled texts of each class, those of least hashed id.
SAMPLE_PER_CLASS = 2048
EPOCHS, BATCH, RATE, DECAY = 30, 64, 0.005, 5e-4
THRESHOLD = 0.3
SLICE_BYTES, ROWS_AT_ONCE = 1 << 18, 512
EDGE = 1


@lru_cache(maxsize=1)
def _is_word() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def gram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of each text's lower-cased words, joined, and their bounds."""
    joined = "".join(f"\0{t.replace(chr(0), ' ')}" for t in texts).lower() + "\0"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.flatnonzero(points == 0)
    inside = _is_word()[points]
    points = np.where(inside, points, EDGE)
    up, down = hashing.powers(len(points))
    prefix = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=prefix[1:])
    edges = np.concatenate(([0], np.cumsum(~inside)))
    places, found = [], []
    for n in SIZES:
        count = len(points) - n + 1
        if count <= 0:
            continue
        # an edge may only be the first or the last place
        at = np.flatnonzero((edges[n - 1 : n - 1 + count] - edges[1 : 1 + count]) == 0)
        places.append(at)
        found.append(prefix[at + n] - prefix[at])
    start = np.flatnonzero(inside & ~np.concatenate(([False], inside[:-1])))
    stop = np.flatnonzero(inside & ~np.concatenate((inside[1:], [False]))) + 1
    places.append(start)
    found.append((prefix[stop] - prefix[start]) * np.uint64(3))
    place = np.concatenate(places)
    bucket = (hashing.mix64(np.concatenate(found) * down[place]) >> np.uint64(48)).astype(np.int32)
    text = np.searchsorted(ends, place, "right") - 1
    order = np.argsort(text, kind="stable")
    bounds = np.searchsorted(text[order], np.arange(len(texts) + 1))
    return bucket[order], bounds


@dataclass
class Classifier:
    weight: np.ndarray
    bias: float

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of class 1; a text without words gets that of the bias alone."""
        buckets, bounds = gram_buckets(texts)
        total = np.concatenate(([0.0], np.cumsum(self.weight[buckets])))
        count = np.diff(bounds)
        mean = (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(count, 1)
        return 1 / (1 + np.exp(-np.clip(mean + self.bias, -40, 40)))


def fit(texts: list[str], labels: list[int], odds: float = 1.0, seed: int = 7) -> Classifier:
    """Joint training of the embeddings and the two-class softmax, both classes weighing alike; then the bias is set for ``odds`` of class 1.

    With labels of one class only the result is that class, without labels class 0.
    """
    y = np.array(labels, np.int64)
    if len(set(labels)) < 2:
        return Classifier(np.zeros(BUCKETS, np.float32), -20.0 if not len(y) or not y[0] else 20.0)
    rows = []
    for low in range(0, len(texts), 64):
        buckets, bounds = gram_buckets(texts[low : low + 64])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            ids, counts = np.unique(buckets[a:b], return_counts=True)
            rows.append((ids.astype(np.int32), (counts / max(1, b - a)).astype(np.float32)))
    rng = np.random.default_rng(seed)
    share = np.array([np.mean(y == 0), np.mean(y == 1)])
    table, out, bias = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), rng.normal(0, 0.1, (DIMENSIONS, 2)), np.zeros(2)
    params = [table, out, bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    scale = 50.0  # the mean over a text's n-grams is small; the softmax sees it enlarged
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for low in range(0, len(order), BATCH):
            batch = order[low : low + BATCH]
            ids = np.concatenate([rows[i][0] for i in batch])
            parts = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            mean = np.stack([np.bincount(owner, table[ids, d] * parts, len(batch)) for d in range(DIMENSIONS)], axis=1) * scale
            logits = mean @ out + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            g = (p - np.eye(2)[y[batch]]) / (2 * share[y[batch]])[:, None] / len(batch)
            back = (g @ out.T) * scale
            gradients = [np.stack([np.bincount(ids, back[owner, d] * parts, BUCKETS) for d in range(DIMENSIONS)], axis=1) + DECAY * table, mean.T @ g + DECAY * out, g.sum(axis=0)]
            step += 1
            for p_, g_, (m, v) in zip(params, gradients, moments, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    side = out[:, 1] - out[:, 0]
    return Classifier((table @ side * scale).astype(np.float32), float(bias[1] - bias[0] + np.log(odds)))


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learned from: CRC-32 of the id as text leaves 2 when divided by 4.  Null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Classifier:
    """Fit on at most ``per_class`` labelled texts of each class that are not held out: those of least hashed id.

    Labels that contradict each other count as 1 if any is; null labels and labels without a text are left out.  Of rows that
    share an id the least text is learned.  The sample's texts are held by the driver.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max(label_col).alias("label"))
    known = known.withColumn("h", F.xxhash64("__id"))
    picked = [known.filter(test).orderBy("h", "__id").limit(per_class) for test in ("label = 1", "label <> 1")]
    chosen = [r for part in picked for r in part.collect()]  # 2 * per_class rows at most
    if not chosen:
        return fit([], [])
    spark = docs.sparkSession
    sample = F.broadcast(spark.createDataFrame([(r["__id"], int(r.label == 1)) for r in chosen], "__id long, label int"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(sample, F.col("id") == F.col("__id")).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.max("label").alias("label"))
    rows = sorted(((r.id, r.text, r.label) for r in rows.toLocalIterator()), key=lambda r: r[0])
    shares = {r.toxic: r.n for r in known.groupBy((F.col("label") == 1).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    return fit([r[1] for r in rows], [r[2] for r in rows], shares.get(True, 0) / shares.get(False, 1) if len(shares) == 2 else 1.0)


def _score(model) -> object:
    @hashing.returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classifier = model.value
        for batch in batches:
            for begin in range(0, len(batch), ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                texts = [t or "" for t in part.column(1).to_pylist()]
                low = 0
                while low < len(texts):
                    high, size = low, 0
                    while high < len(texts) and (high == low or size + len(texts[high]) <= SLICE_BYTES):
                        size += len(texts[high])
                        high += 1
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(low, high - low), pa.array(classifier.scores(texts[low:high]))], ["doc_id", "score"])
                    low = high

    return run


def score(docs: DataFrame, classifier: Classifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) per row.  The model sent to tasks has a fixed size (BUCKETS numbers).

    Null and empty texts get the bias's score; nulls in other columns pass through, repeated rows score alike, further
    columns are ignored.
    """
    hashing.small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    scored = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
