"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The vocabulary is read from a public model file (pieces, log scores, types).  Encoding marks word starts with U+2581,
cuts the text where no piece can reach across, and finds each distinct chunk's best segmentation once per batch: a Viterbi
search that advances all chunks together, one code point at a time, walking the double-array trie in numpy.  Code points
without a piece become byte pieces.  Decoding joins pieces, turns marks into spaces and byte pieces into UTF-8.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import hashing

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model type in a model file.
UNIGRAM = 1
#: How far below the least piece score a code point without a piece is scored.
UNKNOWN_PENALTY = 10.0
#: Chunks of more code points are searched by themselves.
LONG = 4096


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of one protocol-buffer message."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7)
            size = varint() if size is None else size
            yield key >> 3, data[i : i + size]
            i += size


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    types: np.ndarray
    dummy_prefix: bool = True

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A unigram model's log scores as stored; the pieces of a merge-ranked model, listed by rank, get Zipf's log probabilities."""
        pieces, scores, types, prefix, ranked = [], [], [], True, False
        with open(path, "rb") as f:
            model = f.read()
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                pieces.append(piece[1].decode())
                scores.append(np.frombuffer(piece.get(2, b"\0\0\0\0"), "<f4")[0])
                types.append(piece.get(3, NORMAL))
            elif number == 2:
                ranked = dict(_fields(value)).get(3, UNIGRAM) != UNIGRAM
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        scores, types = np.array(scores, np.float64), np.array(types)
        if ranked:
            plain = np.flatnonzero(np.isin(types, (NORMAL, USER)))
            rank = np.arange(1, len(plain) + 1)
            scores[plain] = -np.log(rank) - np.log(np.sum(1 / rank))
        return cls(pieces, scores, types, prefix)


@dataclass
class DoubleArray:
    """A trie in two arrays: from state s over code c to t = base[s] + c, which is a child if check[t] == s.  value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    codes: np.ndarray = field(repr=False)

    @classmethod
    def build(cls, words: list[tuple[str, int]]) -> DoubleArray:
        letters = sorted({c for w, _ in words for c in w})
        codes = np.zeros(0x110000, np.int32)
        for n, c in enumerate(letters, 1):
            codes[ord(c)] = n
        tree: dict = {}
        for word, number in words:
            node = tree
            for c in word:
                node = node.setdefault(int(codes[ord(c)]), {})
            node[-1] = number
        room = (4 + sum(len(w) for w, _ in words)) * 4 + 1024 * (2 + len(letters))
        base, check, value = np.zeros(room, np.int32), np.full(room, -1, np.int32), np.full(room, -1, np.int32)
        used, low = bytearray(room), 1
        used[0] = 1
        queue = [(0, tree)]
        for state, node in queue:
            value[state] = node.get(-1, -1)
            keys = sorted(k for k in node if k > 0)
            if not keys:
                continue
            low = used.find(0, low)
            # the first free place for the least key at which the other keys' places are free too; wide nodes go to the empty end
            free = used.find(0, max(low, keys[0] + 1) if len(keys) < 16 else max(used.rfind(1) + 1, keys[0] + 1))
            while any(used[free - keys[0] + k] for k in keys):
                free = used.find(0, free + 1)
            at = free - keys[0]
            base[state] = at
            for k in keys:
                used[at + k] = 1
                check[at + k] = state
                queue.append((at + k, node[k]))
        used = np.frombuffer(bytes(used), np.uint8)
        top = int(np.flatnonzero(used)[-1]) + len(letters) + 2
        return cls(base[:top], check[:top], value[:top], codes)


class Model:
    """Encoder and decoder of one vocabulary.  Build it once per process: ``Model.load(path)``."""

    def __init__(self, vocabulary: Vocabulary):
        v = self.vocabulary = vocabulary
        plain = np.isin(v.types, (NORMAL, USER))
        self.bytes = np.full(256, -1)
        for i in np.flatnonzero(v.types == BYTE).tolist():
            self.bytes[int(v.pieces[i][3:5], 16)] = i
        self.unknown = int(np.flatnonzero(v.types == UNKNOWN)[0])
        self.trie = DoubleArray.build([(v.pieces[i], i) for i in np.flatnonzero(plain).tolist()])
        self.lost = float(v.scores[plain].min()) - UNKNOWN_PENALTY
        self.longest = max(len(v.pieces[i]) for i in np.flatnonzero(plain).tolist())
        self.score = np.where(v.types == USER, 0.0, v.scores)
        # a chunk may begin at a mark that no piece holds after another code point
        self.inner = {a for i in np.flatnonzero(plain).tolist() for a, b in zip(v.pieces[i], v.pieces[i][1:], strict=False) if b == MARK}
        # with pieces that hold marks only in runs at their start, and none for a line break, a pattern finds the same parts or finer ones
        plain_marks = self.inner <= {MARK} and not self.trie.codes[10]
        self.quick = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n").findall if plain_marks else None
        self.known: dict[str, bytes] = {}
        self.held = 0
        self.shown = ["" if t == CONTROL else " ⁇ " if t == UNKNOWN else p.replace(MARK, " ") for p, t in zip(v.pieces, v.types.tolist(), strict=True)]
        self.is_byte = v.types == BYTE
        self.byte_of = np.array([int(p[3:5], 16) if t == BYTE else 0 for p, t in zip(v.pieces, v.types.tolist(), strict=True)], np.uint8)

    @classmethod
    @lru_cache(maxsize=2)
    def load(cls, path: str) -> Model:
        return cls(Vocabulary.read(path))

    def marked(self, text: str) -> str:
        return ((" " if self.vocabulary.dummy_prefix and text else "") + text).replace(" ", MARK)

    def chunks(self, text: str) -> list[str]:
        """Parts of a marked text that pieces don't reach across: a part begins at a mark unless a piece could join it to what stands before."""
        if self.quick:
            return self.quick(text)
        first, *parts = text.split(MARK)
        out, current = [], first
        for part in parts:
            if current and current[-1] not in self.inner:
                out.append(current)
                current = ""
            current += MARK + part
        return [*out, current] if current else out

    def segment(self, chunks: list[str]) -> list[np.ndarray]:
        """Best piece ids of each chunk: the greatest sum of scores; of equal ones that whose last piece is longest, and so on back."""
        if not chunks:
            return []
        if any(len(c) > LONG for c in chunks):
            rest = iter(self.segment([c for c in chunks if len(c) <= LONG]))
            return [self.segment_long(c) if len(c) > LONG else next(rest) for c in chunks]
        order = np.argsort([len(c) for c in chunks], kind="stable")[::-1]
        n = np.array([len(chunks[i]) for i in order])
        starts = np.concatenate(([0], np.cumsum(n)))
        points = np.frombuffer("".join(chunks[i] for i in order).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.trie.codes[points]
        room = starts + np.arange(len(starts))  # each chunk has one place more than code points
        best = np.full(room[-1] + 1, -np.inf)
        back, piece = np.zeros(len(best), np.int32), np.full(len(best), -1, np.int32)
        best[room[:-1]] = 0.0
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        limit = len(check)
        for i in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -i, "left"))  # chunks longer than i
            at, here = starts[:live] + i, room[:live] + i
            ends = starts[1 : live + 1]
            score = best[here]
            # a code point by itself, if it has no piece
            state, where, left, from_, so_far = np.zeros(live, np.int32), at, ends, here, score
            single = np.zeros(live, bool)
            rows = np.arange(live)
            for length in range(1, self.longest + 1):
                code = codes[where]
                to = base[state] + code
                ok = (code > 0) & (to < limit)
                ok[ok] = check[to[ok]] == state[ok]
                if not ok.any():
                    break
                if not ok.all():
                    where, left, from_, so_far, to, rows = where[ok], left[ok], from_[ok], so_far[ok], to[ok], rows[ok]
                state = to
                ids = value[state]
                hit = ids >= 0
                if hit.any():
                    target, total = from_[hit] + length, so_far[hit] + self.score[ids[hit]]
                    better = total > best[target]
                    t = target[better]
                    best[t], back[t], piece[t] = total[better], length, ids[hit][better]
                    if length == 1:
                        single[rows[hit]] = True
                where = where + 1
                more = where < left
                if not more.all():
                    where, left, from_, so_far, state, rows = where[more], left[more], from_[more], so_far[more], state[more], rows[more]
                if not len(where):
                    break
            alone = ~single
            if alone.any():
                target, total = here[alone] + 1, score[alone] + self.lost
                better = total > best[target]
                t = target[better]
                best[t], back[t], piece[t] = total[better], 1, -1
        out: list = [None] * len(chunks)
        for k, i in enumerate(order.tolist()):
            low, high = int(room[k]), int(room[k] + n[k]) + 1
            out[i] = self._path(chunks[i], back[low:high].tolist(), piece[low:high].tolist())
        return out

    def segment_long(self, chunk: str) -> np.ndarray:
        """As ``segment`` for one long chunk, code point by code point."""
        base, check, value, score = map(memoryview, (self.trie.base, self.trie.check, self.trie.value, self.score))  # read number by number, without lists of them
        codes = self.trie.codes[np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), np.uint32)].tolist()
        n, limit = len(codes), len(check)
        best, back, piece = [0.0] + [-np.inf] * n, [0] * (n + 1), [-1] * (n + 1)
        for i in range(n):
            state, single, so_far = 0, False, best[i]
            for j in range(i, n):
                to = base[state] + codes[j]
                if not codes[j] or to >= limit or check[to] != state:
                    break
                state = to
                if value[to] >= 0:
                    single |= j == i
                    total = so_far + score[value[to]]
                    if total > best[j + 1]:
                        best[j + 1], back[j + 1], piece[j + 1] = total, j + 1 - i, value[to]
            if not single and so_far + self.lost > best[i + 1]:
                best[i + 1], back[i + 1], piece[i + 1] = so_far + self.lost, 1, -1
        return self._path(chunk, back, piece)

    def _path(self, chunk: str, back, piece) -> np.ndarray:
        ids, at = [], len(chunk)
        while at > 0:
            if piece[at] >= 0:
                ids.append(int(piece[at]))
            else:
                known = [int(self.bytes[b]) for b in chunk[at - 1].encode("utf-8", "surrogatepass")]
                ids.extend(known[::-1] if min(known) >= 0 else [self.unknown])
            at -= int(back[at])
        return np.array(ids[::-1], np.int32)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Piece ids of each text; null is empty.  Chunks are remembered with their ids from call to call, in up to KEEP_BYTES."""
        known = self.known
        parts = [self.chunks(self.marked(t)) if t else [] for t in texts]
        new = list({c for p in parts for c in p if c not in known})
        for chunk, ids in zip(new, self.segment(new), strict=True):
            known[chunk] = data = ids.tobytes()
            self.held += CHUNK_BYTES + 2 * len(chunk) + len(data)
        found = [np.frombuffer(b"".join(map(known.__getitem__, p)), np.int32) for p in parts]
        if self.held > KEEP_BYTES:
            self.known, self.held = {}, 0
        return found

    def decode(self, ids) -> str:
        """The text of piece ids; invalid UTF-8 from byte pieces becomes U+FFFD, control pieces nothing."""
        ids = np.asarray(ids, np.int64)
        raw = self.is_byte[ids]
        if raw.any():  # runs of byte pieces between runs of others
            edges = [0, *(np.flatnonzero(raw[1:] != raw[:-1]) + 1).tolist(), len(ids)]
            shown = list(map(self.shown.__getitem__, ids.tolist()))
            parts = [self.byte_of[ids[a:b]].tobytes().decode("utf-8", "replace") if raw[a] else "".join(shown[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
            text = "".join(parts)
        else:
            text = "".join(map(self.shown.__getitem__, ids.tolist()))
        return text[1:] if self.vocabulary.dummy_prefix and text.startswith(" ") else text


#: Memory for remembered chunks, beyond which it starts anew; what one takes besides its text and ids, about.
KEEP_BYTES, CHUNK_BYTES = 24_000_000, 200
SLICE = 256


def encode_batches(path: str, digest: bool):
    """mapInArrow function over (doc_id, text): ids as array<int>, or digests of ids and of the decoded text."""
    from hashlib import sha256

    @hashing.returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.load(path)
        for batch in batches:
            for low in range(0, len(batch), SLICE):
                part = batch.slice(low, SLICE)
                found = model.encode(part.column(1).to_pylist())
                rows = {"doc_id": part.column(0), "n_pieces": pa.array([len(x) for x in found], pa.int64())}
                if digest:
                    rows["n_byte_pieces"] = pa.array([int(model.is_byte[x].sum()) for x in found], pa.int64())
                    rows["ids_sha256"] = pa.array([sha256(x.astype("<i4").tobytes()).hexdigest() for x in found], pa.string())
                    rows["decoded_sha256"] = pa.array([sha256(model.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in found], pa.string())
                else:
                    bounds = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                    rows["ids"] = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found)))
                yield pa.RecordBatch.from_arrays(list(rows.values()), list(rows))

    return run


def encode(docs, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False):
    """(doc_id, n_pieces, ids), or with ``digest`` (doc_id, n_pieces, n_byte_pieces, ids_sha256, decoded_sha256), per row.

    Null and empty texts have no pieces.  Rows are encoded one by one: no shuffle, repeated rows alike, ids of any value or
    null pass through, further columns are ignored.  The vocabulary file must be at ``path`` on every executor.
    """
    from pyspark.sql import functions as F

    hashing.small_batches(docs.sparkSession)
    fields = "doc_id long, n_pieces long, " + ("n_byte_pieces long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode_batches(path, digest), fields)
