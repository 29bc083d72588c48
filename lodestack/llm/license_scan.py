"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Words are runs of ASCII letters, digits and non-ASCII bytes, ASCII-lower-cased.  Hashes of GRAM-word sequences are
winnowed over WINDOW of them, in templates and texts alike, so any shared run of GRAM + WINDOW - 1 words shares a
fingerprint.  The inverted index from fingerprint to (template, place) gives candidate diagonals; around each, template
and text are aligned word by word inside a band, and an alignment counts if it matches LEAST_COVERAGE of the template.
The templates are a fixed list, so the index that tasks hold has a fixed size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .license_templates import TEMPLATES

GRAM, WINDOW = 3, 2
BAND = 8
LEAST_COVERAGE = 0.85

MATCHES = "array<struct<license:string,coverage:double,matched:int,start:int,stop:int>>"


def _split(data: np.ndarray, offsets: np.ndarray) -> hashing.Words:
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    word = ((lower >= 97) & (lower <= 122)) | ((lower >= 48) & (lower <= 57)) | (lower >= 128)
    return hashing.split_words(np.where(word, lower, np.uint8(32)), offsets)


def _winnowed(grams: np.ndarray) -> np.ndarray:
    """Places of the chosen grams: the least of each window, the last of equal ones."""
    if len(grams) <= WINDOW:
        return np.array([len(grams) - 1 - int(np.argmin(grams[::-1]))]) if len(grams) else np.zeros(0, np.int64)
    windows = np.lib.stride_tricks.sliding_window_view(grams, WINDOW)
    return np.unique(np.arange(len(windows)) + WINDOW - 1 - np.argmin(windows[:, ::-1], axis=1))


def _grams(words: np.ndarray) -> np.ndarray:
    return hashing._fold([words[j : len(words) - GRAM + 1 + j] for j in range(GRAM)]) if len(words) >= GRAM else words[:0]


class Index:
    """Fingerprint -> (template, place), as sorted arrays."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        self.names = [name for name, texts in templates.items() for _ in texts]
        texts = pa.array([t for texts in templates.values() for t in texts])
        self.words: list[np.ndarray] = []
        for low, high, data, offsets in hashing.text_slices(texts):
            w = _split(data, offsets)
            h = w.hashes()
            self.words += [h[w.first[i] : w.first[i + 1]] for i in range(high - low)]
        rows = [(int(g), t, int(p)) for t, words in enumerate(self.words) for grams in [_grams(words)] for p in _winnowed(grams) for g in [grams[p]]]
        rows.sort()
        self.keys = np.array([r[0] for r in rows], np.uint64)
        self.template = np.array([r[1] for r in rows])
        self.place = np.array([r[2] for r in rows])

    @classmethod
    @lru_cache(maxsize=1)
    def standard(cls) -> Index:
        return cls()


def align(template: np.ndarray, text: np.ndarray, diagonal: int, band: int = BAND) -> tuple[int, int, int, int]:
    """Best alignment of the whole template with text inside the band around ``diagonal`` (text place - template place).

    A matched word scores 2, a word left out or put in costs 1; text before and after is free.
    Returns matched words, first and last matched place in text (-1 if none), and left-out or put-in words.
    """
    width = 2 * band + 1
    low = diagonal - band  # cell (i, d): i template words read, text read up to i + low + d
    lost = -1e9
    score, back = np.full((len(template) + 1, width), lost), np.zeros((len(template) + 1, width), np.int8)
    score[0] = 0
    steps, place = np.arange(width), np.arange(width) + low
    for i in range(1, len(template) + 1):
        j = place + i
        inside = (j >= 0) & (j <= len(text))
        same = inside & (j >= 1)
        same[same] = text[j[same] - 1] == template[i - 1]
        without = np.append(score[i - 1, 1:] - 1, lost)
        here = np.where(same & (score[i - 1] + 2 >= without), score[i - 1] + 2, without)
        kind = np.where(same & (score[i - 1] + 2 >= without), 3, 2)
        here[~inside | (here < lost / 2)] = lost
        # words put in: each costs 1, those behind the template's last word nothing
        cost = steps if i < len(template) else 0
        run = np.maximum.accumulate(here + cost) - cost
        score[i] = np.where(inside, run, lost)
        back[i] = np.where(inside & (run > lost / 2), np.where(run > here, 1, kind), 0)
    best = np.flatnonzero(score[-1] == score[-1].max())
    i, d = len(template), int(best[np.argmin(np.abs(best - band))])  # of equal ones that nearest the diagonal
    matched, first, last, gaps = 0, -1, -1, 0
    while i > 0 and back[i, d]:
        j = i + low + d
        if back[i, d] == 3:
            matched, first = matched + 1, j - 1
            last = j - 1 if last < 0 else last
            i -= 1
        elif back[i, d] == 2:
            i, d, gaps = i - 1, d + 1, gaps + 1
        else:
            d, gaps = d - 1, gaps + (last >= 0)
    return matched, first, last, gaps


def scan(words: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    """(template, matched words, first place, last place) of the licences in one text, none overlapping a better one."""
    grams = _grams(words)
    chosen = _winnowed(grams)
    return _resolve(words, chosen[np.isin(grams[chosen], index.keys)], grams, index) if len(chosen) else []


def _resolve(words: np.ndarray, hits: np.ndarray, grams: np.ndarray, index: Index) -> list[tuple[int, int, int, int]]:
    diagonals: dict[int, list[tuple[int, int]]] = {}
    for p in hits.tolist():
        low, high = np.searchsorted(index.keys, grams[p], "left"), np.searchsorted(index.keys, grams[p], "right")
        for t, place in zip(index.template[low:high].tolist(), index.place[low:high].tolist(), strict=True):
            diagonals.setdefault(t, []).append((p - place, p))
    found = []
    for t, places in diagonals.items():
        template, last, spans = index.words[t], None, []
        near = min(BAND // 2, len(template) - 1)
        for diagonal, p in sorted(set(places)):
            # a neighbour of a diagonal tried already, unless it is that of another copy
            if last is not None and diagonal - last <= near and (not spans or spans[-1][0] <= p <= spans[-1][1]):
                continue
            last = diagonal
            start = max(0, diagonal - BAND)
            part = words[start : diagonal + len(template) + BAND + 1]
            matched, a, b, gaps = align(template, part, diagonal - start)
            if matched >= LEAST_COVERAGE * len(template):
                found.append((matched - gaps, matched / len(template), -t, t, matched, a + start, b + start))
                spans.append((a + start, b + start))
    kept: list[tuple[int, int, int, int]] = []  # first place, last place, template, matched words: in order, apart
    for x in sorted(found, reverse=True):
        at = bisect.bisect_left(kept, (x[5],))
        if (not at or kept[at - 1][1] < x[5]) and (at == len(kept) or x[6] < kept[at][0]):
            kept.insert(at, (x[5], x[6], x[3], x[4]))
    return sorted((t, matched, first, last) for first, last, t, matched in kept)


@hashing.returning_memory
def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = Index.standard()
    kind = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("matched", pa.int32()), ("start", pa.int32()), ("stop", pa.int32())]))
    for batch in batches:
        ids = batch.column(0)
        for low, high, data, offsets in hashing.text_slices(batch.column(1)):
            w = _split(data, offsets)
            h = w.hashes()
            grams = _grams(h)
            marked = np.flatnonzero(np.isin(grams, index.keys))
            rows: list[list] = [[] for _ in range(high - low)]
            for i in np.unique(np.searchsorted(w.first, marked, "right") - 1).tolist():
                a, b = w.first[i], w.first[i + 1]
                for t, matched, first, last in scan(h[a:b], index):
                    begin, end = (int(np.count_nonzero((data[offsets[i] : x] & 0xC0) != 0x80)) for x in (w.start[a + first], w.end[a + last]))
                    rows[i].append({"license": index.names[t], "coverage": matched / len(index.words[t]), "matched": matched, "start": begin, "stop": end})
            yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array([sorted(r, key=lambda m: (m["start"], m["license"])) for r in rows], kind)], ["doc_id", "matches"])


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, matches) per row: each licence's name, matched share of the template, matched words and code-point span.

    Of matches that overlap the one of more matched words, less words left out or put in, stays; of equal ones that of
    greater coverage, then of the earlier template, then the later one in the text.  Copies beside each other all count.
    Null and empty texts have no matches.  Rows are scanned one by one, whole: no shuffle, repeated rows alike, null ids
    pass through, further columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scan_batches, f"doc_id long, matches {MATCHES}")
