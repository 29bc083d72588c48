"""Archives, chat formatting and the pipeline."""

import base64
import gzip
import hashlib
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from lodestack.llm import chat, mixing, near_dup, quality, sentencepiece, warc
from lodestack.llm.queries import op2_warc_capture_index, op5_chat_formatting, piece_model

from ..conftest import SF
from .cases import awkward
from .test_text_operators import brute_components, brute_targets, plain_clean, plain_quality, plain_terms, words


def brute_pages(rows, least=0):
    first = {}
    for i, html in sorted((i, h or "") for i, _, h in rows if i is not None):
        first.setdefault(html, i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        of = first.get(html or "")
        repeat = i is not None and len(data) >= least and of != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if repeat else "response", of if repeat else None))
    return sorted(out, key=str)


PAGES = [
    (5, "http://www.Example.com:80/b?z=1&a=2#frag", "<p>same</p>"), (3, "https://example.com/a", "<p>same</p>"), (9, "https://example.com/a", "other é🎉"), (7, None, None), (8, "", ""),
    (10, "not a url", "x"), (11, "http://[bad", "y\r\n\r\nz"), (12, "http://sub.example.org/" + "p" * 3000, "q" * 200_000), (3, "https://example.com/a", "<p>same</p>"), (None, "http://none.example/", "<p>same</p>"), (13, "http://line\nbreak.example/", "w"),
]


def read(archive):
    return sorted((tuple(r)[:5] for r in archive.read().collect()), key=str)


def test_archive_round_trip(spark):
    df = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, file string")
    archive = warc.write_archive(df)
    assert read(archive) == brute_pages(PAGES)
    assert read(warc.write_archive(df, least_bytes=5)) == brute_pages(PAGES, 5)
    assert warc.write_archive(df.limit(0)).read().count() == 0
    asked = spark.createDataFrame([("http://EXAMPLE.com/a#x",), ("http://example.com/missing",), ("http://EXAMPLE.com/a#x",)], "url string")
    found = archive.lookup(asked, payloads=True).collect()
    assert sorted(r.page_id for r in found) == [3, 3, 9]
    assert {bytes(r.payload) for r in found} == {b"<p>same</p>", "other é🎉".encode()}
    assert archive.lookup(asked.limit(0)).count() == 0


def test_archive_of_test_pages(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html").collect()]
    got = sorted((tuple(r)[:5] for r in op2_warc_capture_index(spark, SF).collect()), key=str)
    assert got == brute_pages(rows)


def test_many_blocks_and_lookups(spark, monkeypatch):
    df = spark.range(3000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h"), (F.col("id") % 40).cast("string"), F.lit(".example.com/p"), (F.col("id") % 700).cast("string")).alias("url"), F.concat(F.lit("page "), (F.col("id") % 900).cast("string")).alias("html"))
    archive = warc.write_archive(df)
    rows = [tuple(r) for r in df.collect()]
    assert read(archive) == brute_pages(rows)
    assert archive.directory.count() >= 12
    by_url = defaultdict(list)
    for i, url, _ in rows:
        by_url[url].append(i)
    for url in list(by_url)[:4]:
        assert sorted(r.page_id for r in archive.lookup(spark.createDataFrame([(url,)], "url string")).collect()) == by_url[url]
    some = list(by_url)[5::9]
    found = archive.lookup(spark.createDataFrame([(u,) for u in some], "url string")).collect()
    assert sorted((r.url, r.page_id) for r in found) == sorted((u, i) for u in some for i in by_url[u])


def test_index_files_of_one_key(spark, monkeypatch):
    """A URL with a third of all captures lies in several index files, and is found whole."""
    monkeypatch.setattr(warc, "PART_LINES", 700)
    df = spark.range(6000).select(F.col("id").alias("page_id"), F.when(F.col("id") % 3 == 0, F.lit("http://hot.example/")).otherwise(F.concat(F.lit("http://h.example/"), (F.col("id") % 50).cast("string"))).alias("url"), F.col("id").cast("string").alias("html"))
    archive = warc.write_archive(df)
    files = archive.directory.groupBy("file").agg(F.sum("lines").alias("n")).collect()
    assert len(files) == 9 and max(r.n for r in files) < 1500
    assert archive.lookup(spark.createDataFrame([("http://hot.example/",)], "url string")).count() == 2000
    assert archive.read().select("page_id").distinct().count() == archive.read().count() == 6000


def test_records_are_plain_warc():
    record = warc.build_record(4, "http://a.example/é", b"body", None)
    data = gzip.compress(record) + gzip.compress(warc.build_record(5, "u", b"body", (4, "http://a.example/é")))
    text = gzip.decompress(data)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.count(b"WARC/1.1") == 2
    parsed = warc.parse_record(record)
    assert parsed["payload"] == b"body" and parsed["headers"]["warc-payload-digest"].endswith(warc.payload_digest(b"body"))
    assert warc.url_key("https://www.Example.com:443/A?b=2&a=1#f") == "com,example)/a?a=1&b=2"


CONTROL_TEXT = st.lists(st.sampled_from([*"<|>[]/\\\n.sINSTend", "é", "🎉", *chat.CONTROL]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb", "<|end|>\\n"]), st.lists(CONTROL_TEXT, max_size=3)), max_size=4))
def test_chat_round_trip(turns):
    text, mask, _ = chat.format_turns([(role, [{"kind": "text", "text": t} for t in texts]) for role, texts in turns])
    assert chat.read_turns(text) == [(role, "".join(texts)) for role, texts in turns]
    assert "".join(chat.unescape(text[a:b]) for a, b in mask) == "".join("".join(t) for r, t in turns if r == "assistant")
    assert text.count(chat.BEGIN) == text.count(chat.END) == len(turns)
    assert not any(c in text for c in chat.CONTROL if c not in (chat.BEGIN, chat.END))


def test_chat_parts_in_order():
    parts = [{"kind": "text", "text": "see <|im"}, {"kind": "image", "ref": "a.png", "width": 57, "height": 28}, {"kind": "text", "text": "age|>"}, {"kind": "audio", "ref": "b.wav", "seconds": 1.01}, {"kind": "document", "ref": "c.pdf", "pages": 3}, {"kind": "image", "ref": None}, {"kind": "odd", "text": None}]
    text, _, attachments = chat.format_turns([("user", parts)])
    assert text == "<|turn|>user\nsee <|im<|image|>age|><|audio|><|document|><|image|><|end|>"
    assert [(a["ref"], a["tokens"]) for a in attachments] == [("a.png", 3), ("b.wav", 26), ("c.pdf", 768), (None, 1)]


def brute_conversations(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        learned = "".join(t for _, r, t in turns if r == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learned), digest(learned))
    return out


def test_chat_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op5_chat_formatting(spark, SF).collect()}
    assert got == brute_conversations(rows)


def test_chat_awkward(spark):
    rows = [(1, None, None, None), (1, 0, "user", ""), (1, 0, "user", ""), (None, 1, "assistant", "x" * 100_000), (2, 1, "assistant", "\\.<|end|>")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat.text_part(F.col("text"))).withColumn("t", F.lit(1))
    got = {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_conversations(messages)).collect()}
    assert got == {1: (3, 0), None: (1, 100_000), 2: (1, 9)}
    assert chat.format_conversations(messages.limit(0)).count() == 0
    nulls = messages.withColumn("parts", F.lit(None).cast(f"array<{chat.PART}>"))
    assert chat.format_conversations(nulls).count() == 3


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    ratios = quality.log_ratios(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r.doc_id for r in quality.quality(docs, ratios).filter("__quality.kept").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    stages = dict(corpus_pipeline.STAGES)
    one = stages[names[0]](spark, docs, SF)
    assert one.columns == columns and {r.doc_id for r in one.collect()} == kept
    two = stages[names[1]](spark, one, SF)
    groups = {r.doc_id: r.component_id for r in near_dup.near_duplicates(one, shingle_words=5).collect()}
    assert two.columns == columns and sorted(r.doc_id for r in two.collect()) == sorted(set(groups.values()))
    three = stages[names[2]](spark, two, SF)
    assert three.columns == columns and three.count() == two.count() and three.filter("n_chars <> length(text)").count() == 0
    assert three.filter(r"text rlike '@[A-Za-z0-9-]+\\.[a-z]'").count() == 0
    four = stages[names[3]](spark, three, SF)
    counts = four.groupBy("doc_id").count().collect()
    assert four.columns == columns and max(r["count"] for r in counts) <= 3
    five = stages[names[4]](spark, four, SF)
    assert five.count() == four.count() and five.filter("n_pieces <> size(ids)").count() == 0


def test_pipeline_end_to_end(spark):
    """The last stage's rows, against plain versions of all stages but the mix, whose draws are free, and its balance."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = [(r.doc_id, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()]
    texts = {i: r.text for i, r in docs.items()}
    scores, kept = plain_quality(texts, labels), {}
    for i, t in texts.items():
        w = words(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeated = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
        if len(w) >= 50 and 100 * len(repeated) <= 50 * len(w) and scores[i] >= quality.LEAST_SCORE:
            kept[i] = t
    groups = brute_components(kept, 5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    clean = {i: plain_clean(t, plain_terms(kept)) for i, t in kept.items()}
    model = sentencepiece.Model.load(piece_model())
    found = Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        assert len(r.ids) == r.n_pieces and model.decode(r.ids) == clean[r.doc_id]
        found[r.doc_id] += 1
    assert max(found.values()) <= 3
    sizes, taken, longest = Counter(), Counter(), {}
    for i, t in clean.items():
        n, source = len(words(t)), docs[i].source
        sizes[source] += n
        taken[source] += n * found[i]
        longest[source] = max(n, longest.get(source, 0))
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= max(0.02 * target, longest[source] / 2)


def test_near_dedup_stage_of_shared_ids(spark):
    """One row of each group stays, and a unique text stays although another row of its id goes."""
    a, u = " ".join(f"a{i}" for i in range(60)), " ".join(f"u{i}" for i in range(60))
    rows = [(1, a, "x"), (1, a, "x"), (2, u, "x"), (2, a, "y"), (3, a + " end", "y"), (4, "", "z"), (4, None, "z"), (None, a, "z"), (5, u + " more", "z"), (6, "v w", "z"), (6, "v w", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = dict(corpus_pipeline.STAGES)["minhash_near_dedup"]
    got = sorted((tuple(r) for r in stage(spark, docs, SF).collect()), key=str)
    assert got == sorted([(1, a, "x"), (2, u, "x"), (4, "", "z"), (4, None, "z"), (None, a, "z"), (6, "v w", "z")], key=str)


def test_copies_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(1, "a", f"t{i}") for i in range(10)] + [(2, "a", "x"), (None, None, "n"), (None, None, "m")], "doc_id long, source string, text string").repartition(3)
    mixed = spark.createDataFrame([(1, "a", c) for c in (2, 2, 1, 0, 0, 3, 0, 1, 1, 1)] + [(2, "a", 3), (None, None, 1), (None, None, 0)], "doc_id long, source string, copies int")
    counts = {(r.doc_id, r.text): r["count"] for r in mixing.taken(docs, mixed).groupBy("doc_id", "text").count().collect()}
    assert sum(n for (i, _), n in counts.items() if i == 1) == 11 and sorted(n for (i, _), n in counts.items() if i == 1) == [1] * 9 + [2]
    assert counts[2, "x"] == 3 and sum(n for (i, _), n in counts.items() if i is None) == 1


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_pipeline_of_awkward_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    rows = awkward(spark)
    extra = rows.select(*docs.columns, "id", "score", "n", "key")
    docs = docs.withColumns({"id": F.lit("clash"), "score": F.lit(0.5), "n": F.lit(7).cast("long"), "key": F.lit(None).cast("string")}).unionByName(extra.withColumn("doc_id", F.col("doc_id") + 10**6))
    total = docs.count()
    stages = [f for _, f in corpus_pipeline.STAGES]
    for stage in stages[1:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    assert stages[2](spark, docs, SF).count() == total
    kept = stages[1](spark, docs, SF)
    assert kept.filter("doc_id is null").count() == 2  # without an id nothing is a known copy
    mixed = stages[3](spark, docs, SF)
    assert mixed.groupBy("doc_id", "text").count().filter("count > 9").count() == 0
    want = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed.count() == want
    for stage in stages:
        docs = stage(spark, docs, SF)
    assert docs.count() > 0
