"""MinHash near-duplicate detection with circulant signatures.

Two permutations of the 32-bit integers give every signature coordinate: ``sigma`` scatters the shingle hashes once, and
coordinate j is the least ``pi(sigma(s) + j)`` over the shingles s, that is ``pi`` shifted circularly by j.  Bands of the
signature put texts into buckets; candidates of a bucket are confirmed by the exact Jaccard similarity of the full sets.

No bucket is expanded into all its pairs:

1. Texts with equal shingle sets collapse into one representative (a map-side combined minimum), numbered for itself, so
   that rows which share a doc_id stay apart.
2. In each bucket all members are compared with one hub, the member that shares most bands with others.  The links found
   make components; most buckets now lie in one component and are done.
3. For a bucket that still holds several components, signatures tell which member may link to which other component;
   those members are compared with *all* members of that component, in blocks of bounded size, exactly.  One link per
   member and block is enough, since a component is connected already.

So no link between different texts is given up beyond the miss rate of the banding itself: with 32 bands of 5 rows a pair
of similarity 0.8 shares no bucket with probability 3e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..operators.components import edge_components
from ..shared import HOT_LEAST, few, joined_by_size, keep_ids, settled
from . import hashing

ROWS, BANDS = 5, 32
#: A pair of similarity 0.8 has less than this share of equal 8-bit coordinates with probability 5e-6.
LEAST_AGREEMENT = 0.66
#: Members of a bucket, and rows with whole sets, that are compared in one block.
BLOCK, SET_BLOCK = 512, 128
PAIRS_AT_ONCE = 1 << 15
EMPTY = 0xFFFFFFFF
#: Rows of one task that compares signatures: the work is in the comparisons, not in the bytes.
ROWS_A_TASK = 4096


def permute(x: np.ndarray, shift: int, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """``pi`` of x + shift: a bijection of the 32-bit integers, worked out in place."""
    np.add(x, np.uint32(shift), out=out)
    for by, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, None)):
        np.right_shift(out, np.uint32(by), out=spare)
        np.bitwise_xor(out, spare, out=out)
        if factor:
            np.multiply(out, np.uint32(factor), out=out)
    return out


def signatures(values: np.ndarray, bounds: np.ndarray, coordinates: int = ROWS * BANDS) -> np.ndarray:
    """Circulant MinHash signatures (texts x coordinates) of joined sets of 64-bit shingle hashes."""
    sigma = (hashing.mix64(values ^ np.uint64(0x5DEECE66D)) >> np.uint64(32)).astype(np.uint32)
    out, spare = np.empty_like(sigma), np.empty_like(sigma)
    found = np.empty((len(bounds) - 1, coordinates), np.uint32)
    for j in range(coordinates):
        found[:, j] = hashing.minima(permute(sigma, j + 1, out, spare), bounds, EMPTY)
    return found


def band_keys(found: np.ndarray) -> np.ndarray:
    keys = np.empty((len(found), BANDS), np.uint64)
    for b in range(BANDS):
        h = np.full(len(found), np.uint64(b + 1))
        for j in range(b * ROWS, (b + 1) * ROWS):
            h = hashing.mix64(h * hashing.BASE + found[:, j])
        keys[:, b] = h
    return keys.view(np.int64)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))


def _digests(values: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """16 bytes for each set, equal for equal sets; None for an empty one."""
    return [hashlib.blake2b(values[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def _sign(k: int):
    @hashing.returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for low, high, data, offsets in hashing.text_slices(batch.column(1)):
                values, bounds = hashing.shingle_sets(hashing.split_words(data, offsets, lower=True), k)
                size = np.diff(bounds)
                keys = band_keys(signatures(values, bounds))
                full = np.repeat(size > 0, BANDS)
                ends = np.concatenate(([0], np.cumsum((size > 0) * BANDS)))
                yield pa.RecordBatch.from_arrays([ids.slice(low, high - low), pa.array(size), pa.array(_digests(values, bounds), pa.binary()), _lists(keys.ravel()[full], ends)], ["doc_id", "n_shingles", "digest", "bands"])

    return run


def _sets(k: int):
    """(id, digest, text) -> the sets of the texts that have the digest."""

    @hashing.returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in hashing.text_slices(batch.column(2)):
                values, bounds = hashing.shingle_sets(hashing.split_words(data, offsets, lower=True), k)
                found = signatures(values, bounds)
                short, bands = (found & np.uint32(0xFF)).astype(np.uint8), band_keys(found)
                out = pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), _lists(values.view(np.int64), bounds), pa.array([x.tobytes() for x in short], pa.binary()), pa.array([x.tobytes() for x in bands], pa.binary())], ["id", "shingles", "short", "bands"])
                wanted = batch.column(1).slice(low, high - low).to_pylist()
                yield out.filter(pa.array([x == y for x, y in zip(_digests(values, bounds), wanted, strict=True)], pa.bool_()))

    return run


def set_digests(docs: DataFrame, shingle_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``__digest``: equal for rows of equal shingle sets, null without a word."""
    hashing.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            found: list[bytes | None] = []
            for _, _, data, offsets in hashing.text_slices(batch.column(at)):
                found += _digests(*hashing.shingle_sets(hashing.split_words(data, offsets, lower=True), shingle_words))
            yield batch.append_column("__digest", pa.array(found, pa.binary()))

    return docs.mapInArrow(hashing.returning_memory(run), StructType([*docs.schema.fields, StructField("__digest", BinaryType())]))


def _may_link(percent: int):
    """Within a part of a bucket: which asking member may link to which other component, by signature and set size."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = group[group.asked], group[~group.asked]
        if not len(a) or not len(b):
            return pd.DataFrame({"u": [], "comp": []}, dtype="int64")
        n, m = a.n.to_numpy()[:, None], b.n.to_numpy()[None, :]
        near = a.comp.to_numpy()[:, None] != b.comp.to_numpy()[None, :]
        near &= 100 * np.minimum(n, m) >= percent * np.maximum(n, m)
        near &= b.main.to_numpy()[None, :] | (a.id.to_numpy()[:, None] < b.id.to_numpy()[None, :])  # two that both ask meet once
        if not near.any():
            return pd.DataFrame({"u": [], "comp": []}, dtype="int64")
        table = lambda column, kind: np.frombuffer(b"".join(column), kind).reshape(len(column), -1)
        x, y = table(a.short, np.uint8), table(b.short, np.uint8)
        i, j = np.nonzero(near)
        if len(i) <= PAIRS_AT_ONCE:
            equal = np.count_nonzero(x[i] == y[j], axis=1)
        else:
            all_ = np.zeros(near.shape, np.uint16)
            for c in range(x.shape[1]):
                all_ += x[:, c, None] == y[None, :, c]
            equal = all_[i, j]
        close = equal >= LEAST_AGREEMENT * x.shape[1]
        i, j = i[close], j[close]
        # a pair counts in the first bucket it shares only
        mine, theirs = table(a.bands, np.int64)[i], table(b.bands, np.int64)[j]
        first = mine[np.arange(len(i)), np.argmax(mine == theirs, axis=1)] == group.bucket.iat[0]
        left, right = a.iloc[i[first]], b.iloc[j[first]]
        out = set()
        for u, u_size, u_comp, v, v_size, v_comp in zip(left.id, left.members, left.comp, right.id, right.members, right.comp, strict=True):
            out.add((u, v_comp) if (u_size, u_comp) < (v_size, v_comp) else (v, u_comp))
        return pd.DataFrame(sorted(out), columns=["u", "comp"]).astype("int64")

    return run


def _link_blocks(percent: int):
    """Queries (role 0) against a block of one component's members (role 1): the first exact link of each query."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        queries, members = group[group.role == 0], group[group.role == 1]
        out = []
        if len(queries) and len(members):
            sizes = members.shingles.map(len).to_numpy()
            values = np.concatenate(members.shingles.to_list())
            owner = np.repeat(np.arange(len(members)), sizes)
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            ids = members.id.to_numpy()
            for u, shingles in zip(queries.id, queries.shingles, strict=True):
                low, high = np.searchsorted(values, shingles, "left"), np.searchsorted(values, shingles, "right")
                run_ = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(run_)[:-1])), run_) + np.arange(run_.sum())
                common = np.bincount(owner[at], minlength=len(members))
                linked = (100 * common >= percent * (sizes + len(shingles) - common)) & (ids != u)
                if linked.any():
                    out.append((u, int(ids[linked].min())))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def near_duplicates(docs: DataFrame, shingle_words: int = 4, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (least doc_id reachable over links), kept (doc_id = component_id), digest, component.

    Two documents are linked if 100 * |A & B| >= percent * |A | B| for their sets of distinct ``shingle_words``-word
    shingles of the text with A-Z lower-cased; a shorter text's set is its whole word sequence.  ``percent`` of at least 80
    is what the banding is made for.  Null or empty texts have empty sets and link with nothing.  Rows without an id can't
    be linked: component_id is null and they are kept.  Repeated rows count as copies of each other; rows that share a
    doc_id and have different texts are different documents, each linked by its own text.  ``digest`` tells equal sets,
    ``component`` what is linked, also where rows share a doc_id; both are null for empty sets and rows without an id.
    Further columns of ``docs``, whatever their names, are ignored.
    """
    hashing.small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = settled(source.mapInArrow(_sign(shingle_words), "doc_id long, n_shingles long, digest binary, bands array<long>"), "signed")
    owned = signed.filter("digest is not null and doc_id is not null")
    reps = owned.groupBy("digest").agg(F.min_by(F.struct("doc_id", "n_shingles", "bands"), "doc_id").alias("r"), F.count("*").alias("copies"))
    # the numbers are those that the written table has, whatever a second run of a task would give
    reps = settled(reps.select("digest", "copies", "r.doc_id", F.col("r.n_shingles").alias("n"), "r.bands", F.monotonically_increasing_id().alias("id")), "sets-of-copies")
    exploded = reps.select("id", "n", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count("*").alias("count")).filter("count > 1")
    members = settled(exploded.join(shared, "bucket").select("bucket", "id", "n", "count"), "members")

    scores = members.groupBy("id").agg(F.sum("count").alias("score"))
    hubs = members.join(scores, "id").groupBy("bucket").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("hub"))
    pairs = members.join(hubs, "bucket").filter("id <> hub").select("id", "hub").distinct()
    asked_for = settled(reps.join(scores.select("id"), "id", "left_semi").select("doc_id", "id", "digest"), "candidates")
    texts = source.join(few(asked_for), "doc_id").select("id", "digest", "text")
    sets = settled(texts.mapInArrow(_sets(shingle_words), "id long, shingles array<long>, short binary, bands binary"), "sets")
    if sets.count() > asked_for.count():  # rows that are repeated whole
        sets = settled(sets.dropDuplicates(["id"]), "sets")
    mine, theirs = sets.select("id", "shingles"), sets.select(F.col("id").alias("hub"), F.col("shingles").alias("hub_shingles"))
    common = F.size(F.array_intersect("shingles", "hub_shingles"))
    links = settled(
        pairs.join(mine, "id").join(theirs, "hub")
        .withColumn("common", common)
        .filter(F.expr(f"100 * common >= {percent} * (size(shingles) + size(hub_shingles) - common)"))
        .select(F.col("id").alias("a"), F.col("hub").alias("b")),
        "links",
    )
    first = edge_components(links).withColumnRenamed("component", "comp")

    labelled = members.join(first, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    per_comp = labelled.groupBy("bucket", "comp").agg(F.count("*").alias("many"))
    open_ = per_comp.groupBy("bucket").agg(F.count("*").alias("comps"), F.sum("many").alias("all"), F.max_by("comp", F.struct("many", -F.col("comp"))).alias("main_comp"), F.max("many").alias("main_many")).filter("comps > 1")
    parts = lambda n: F.ceil(n / BLOCK).cast("int")
    others = F.col("all") - F.col("main_many")
    open_ = settled(open_.select("bucket", "main_comp", parts(F.col("all")).alias("parts"), parts(others).alias("ask_parts"), (others * parts(F.col("all")) + F.col("all") * parts(others)).alias("rows")), "open")
    sizes = first.groupBy("comp").agg(F.count("*").alias("members"))
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rest = (
        labelled.join(open_, "bucket")
        .join(sizes, "comp", "left")
        .join(sets.select("id", "short", "bands"), "id")
        .select("bucket", "id", "n", "comp", F.coalesce("members", F.lit(1)).alias("members"), "short", "bands", "parts", "ask_parts", (F.col("comp") == F.col("main_comp")).alias("main"))
    )
    # members outside a bucket's main component ask; every member is asked once, in its part, by each block of askers
    columns = ["bucket", "id", "n", "comp", "members", "short", "bands", "main", "p", "q", "asked"]
    asking = rest.filter("not main").withColumn("q", part(F.col("ask_parts"))).withColumn("p", spread("parts")).withColumn("asked", F.lit(True))
    replying = rest.withColumn("p", part(F.col("parts"))).withColumn("q", spread("ask_parts")).withColumn("asked", F.lit(False))
    tasks = 1 + int(open_.agg(F.sum("rows")).first()[0] or 0) // ROWS_A_TASK
    met = asking.select(*columns).union(replying.select(*columns)).repartition(tasks, "bucket", "p", "q")
    maybe = settled(met.groupBy("bucket", "p", "q").applyInPandas(_may_link(percent), "u long, comp long").distinct(), "maybe")

    queries = maybe.groupBy("comp").agg(F.ceil(F.count("*") / SET_BLOCK).cast("int").alias("query_parts"))
    targets = queries.join(sizes, "comp", "left").select("comp", "query_parts", F.ceil(F.coalesce("members", F.lit(1)) / SET_BLOCK).cast("int").alias("blocks"))
    asked = maybe.withColumnRenamed("u", "id").join(targets, "comp").select("comp", "id", part(F.col("query_parts")).alias("q"), spread("blocks").alias("b"), F.lit(0).alias("role"))
    single = targets.select("comp", F.col("comp").alias("id"))  # a component's least member; the only one of those without links
    member = single.union(first.select("comp", "id").join(targets.select("comp"), "comp", "left_semi").select("comp", "id")).distinct()
    member = member.join(targets, "comp").select("comp", "id", spread("query_parts").alias("q"), part(F.col("blocks")).alias("b"), F.lit(1).alias("role"))
    # blocks are of like sizes: dealt by ranges, tasks have like numbers of them
    blocks = asked.union(member).join(mine, "id").repartitionByRange("comp", "q", "b")
    more = blocks.groupBy("comp", "q", "b").applyInPandas(_link_blocks(percent), "a long, b long")
    more = settled(more, "more-links")
    if more.limit(1).count():
        first = edge_components(links.union(more)).withColumnRenamed("component", "comp")

    placed = settled(reps.select("id", "digest", "copies", "doc_id").join(first, "id", "left"), "placed")
    joined = placed.filter("comp is not null").select("digest", "comp", F.col("copies").alias("rows"), "doc_id")
    least = settled(joined.groupBy("comp").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("copies")), "least")
    found = joined_by_size(joined, least, "comp", HOT_LEAST).select("digest", F.col("rows").alias("copies"), "component_id", F.col("comp").alias("component"))
    alone = placed.filter("comp is null").select("digest", "copies", F.col("doc_id").alias("component_id"), F.col("id").alias("component"))
    found = settled(found.unionByName(alone), "components")
    rows = signed.select("doc_id", "n_shingles", "digest")
    linked = joined_by_size(rows.filter("digest is not null and doc_id is not null"), found, "digest", HOT_LEAST)
    others = rows.filter("digest is null or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("component"))
    out = linked.select("doc_id", "n_shingles", "component_id", "digest", "component").unionByName(others)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "digest", "component")


def without_near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one of each group of near-duplicates is left: the one of least id.

    Of a group's rows with that id the one with the least digest stays, and of equal ones of those one row.  So repeated
    rows leave one, and a row whose text is unique stays whatever rows share its id.  Rows without an id or a word stay.
    """
    found = settled(near_duplicates(docs, shingle_words, percent, id_col, text_col), "near-duplicates")
    ids = settled(found.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("kept").alias("stays")), "ids")
    out = keep_ids(docs, id_col, ids.filter("n > 1 or not stays").select("doc_id"), "left_anti")
    many = settled(ids.filter("n > 1").select("doc_id"), "shared-ids")
    n_many = many.count()
    if not n_many:
        return out
    same = settled(set_digests(keep_ids(docs, id_col, many, rows=n_many), shingle_words, id_col, text_col), "rows-of-shared-ids")
    best = keep_ids(found.filter("kept and digest is not null"), "doc_id", many, rows=n_many).groupBy("component").agg(F.min("doc_id").alias("__of"), F.min("digest").alias("__best"))
    best = few(settled(best.select("__of", "__best"), "stay"))
    rows = same.join(best, (F.col(id_col) == F.col("__of")) & (F.col("__digest") == F.col("__best")), "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    one = rows.groupBy(F.col(id_col).alias("__of"), "__digest").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return out.unionByName(one).unionByName(same.filter("__digest is null").select(*docs.columns))
