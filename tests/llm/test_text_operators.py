"""Each operator on awkward rows, on an empty table, and against a brute-force version."""

import base64
import hashlib
import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestack.llm import fingerprint, license_scan, mixing, near_dup, pii, quality, sentencepiece, toxicity
from lodestack.llm.queries import piece_model

from ..conftest import SF
from .cases import AWKWARD, GOOD, awkward, empty, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# near-duplicates


def shingles(text, k):
    w = words((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(texts, k=4, percent=80):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_against_brute_force(spark):
    base = [f"w{i}" for i in range(60)]
    variants = [" ".join(base[:i] + [f"edit{i}"] + base[i + 1 :]) for i in range(0, 60, 3)]
    chain = [" ".join(f"c{j}" for j in range(i * 3, i * 3 + 60)) for i in range(8)]
    texts = dict(enumerate(AWKWARD + variants + [" ".join(base)] + chain + ["ONE", "one"]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_of_test_documents(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(documents(spark)).collect()}
    assert got == brute_components(texts)


def test_near_duplicates_awkward(spark):
    found = near_dup.near_duplicates(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) + 4
    assert all(r.kept and r.component_id is None for r in found if r.doc_id is None)
    assert {r.component_id for r in found if r.doc_id in (5, 6, 7)} == {5}
    assert near_dup.near_duplicates(empty(spark)).count() == 0


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    rows_ = [(1, GOOD), (1, GOOD), (2, "unique " + " ".join(f"u{i}" for i in range(40))), (2, GOOD), (3, GOOD + " more"), (None, GOOD)]
    found = near_dup.near_duplicates(spark.createDataFrame(rows_, "doc_id long, text string")).collect()
    by = sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None)
    n, more, unique = len(shingles(GOOD, 4)), len(shingles(GOOD + " more", 4)), 38
    assert by == sorted([(1, n, 1), (1, n, 1), (2, unique, 2), (2, n, 1), (3, more, 1)])
    assert [(r.component_id, r.kept) for r in found if r.doc_id is None] == [(None, True)]


def test_a_hot_set_and_a_hot_component(spark, monkeypatch):
    """Sets and components of many rows are joined by a broadcast; the result is the same."""
    near = [" ".join([*[f"w{j}" for j in range(60)], f"end{i}"]) for i in range(30)]
    texts = dict(enumerate([GOOD] * 40 + near + ["lonely one", ""]))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for least in (4, 10**6):
        monkeypatch.setattr(near_dup, "HOT_LEAST", least)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()} == brute_components(texts)


# quality


def test_quality_base_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()} | {10**6 + i: t for i, t in enumerate([*AWKWARD, "a b c a b c a b c\nx\nx\n \n \nx", "#*$ %& <>|"])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in quality.quality(df, [0.0] * quality.BUCKETS).select("doc_id", "__quality.*").collect():
        text = texts[r.doc_id] or ""
        w = words(text)
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        repeated = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(w) < 50 or 100 * len(repeated) > 50 * len(w)) and r.kept == (not r.base_failed)


def test_quality_scores_against_brute_force(spark):
    df = spark.createDataFrame([(i, "good words here " * 30 + GOOD) for i in range(5)] + [(i, "bad ### | " * 60) for i in range(5, 8)] + [(9, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 1), (2, 0), (6, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    ratios = quality.log_ratios(df, labels)
    grams = {r.doc_id: r.g for r in df.select("doc_id", quality.hashed_grams(F.col("text")).alias("g")).collect()}
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for i in (0, 1) for x in grams[i])
    n = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(target.values()) + quality.BUCKETS))
    for b in range(quality.BUCKETS):
        assert ratios[b] == pytest.approx(n + math.log((target[b] + 1) / (raw[b] + 1)))
    for r in quality.quality(df, ratios).select("doc_id", "__quality.score").collect():
        assert r.score == pytest.approx(sum(ratios[x] for x in grams[r.doc_id]) / max(1, len(grams[r.doc_id])))
    assert len(set(grams[0])) > 10  # lower-cased tokens and pairs


def plain_grams(text):
    """Hashed tokens and pairs of tokens, by another library's hash and regular expressions."""
    import regex
    import xxhash

    tokens = regex.findall(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\x20\x09-\x0D]+", (text or "").lower())
    one = lambda t, seed=42: xxhash.xxh64(t.encode(), seed=seed).intdigest()
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    return [signed(one(t)) % quality.BUCKETS for t in tokens] + [signed(one(b, one(a))) % quality.BUCKETS for a, b in zip(tokens, tokens[1:], strict=False)]


def plain_quality(texts, labels):
    """Of {id: text} and [(id, quality)]: {id: score} by the definition."""
    marks = {}
    for i, q in labels:
        marks.setdefault(i, []).append(q)
    raw, target = Counter(), Counter()
    for i, t in texts.items():
        grams = plain_grams(t)
        raw.update(grams)
        if marks.get(i) and min(marks[i]) == 1:
            target.update(grams)
    n = math.log((sum(raw.values()) + quality.BUCKETS) / (sum(target.values()) + quality.BUCKETS))
    ratio = {b: n + math.log((target[b] + 1) / (raw[b] + 1)) for b in raw}
    return {i: sum(ratio[b] for b in plain_grams(t)) / max(1, len(plain_grams(t))) for i, t in texts.items()}


def test_quality_scores_of_test_documents(spark):
    docs, labels = documents(spark), spark.read.parquet(f"{SF}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    want = plain_quality(texts, [(r.doc_id, r.quality) for r in labels.collect()])
    found = quality.quality(docs, quality.log_ratios(docs, labels)).select("doc_id", "__quality.*").collect()
    assert {r.doc_id: round(r.score, 9) for r in found} == {i: pytest.approx(x, abs=1e-8) for i, x in want.items()}
    assert all(r.kept == (not r.base_failed and want[r.doc_id] >= quality.LEAST_SCORE) for r in found)


def test_quality_awkward(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.log_ratios(awkward(spark), labels) == [0.0] * quality.BUCKETS
    out = quality.quality(awkward(spark), [0.0] * quality.BUCKETS)
    assert out.columns[:-1] == awkward(spark).columns and out.count() == len(AWKWARD) + 4
    assert quality.quality(empty(spark), quality.log_ratios(empty(spark), labels)).count() == 0


# personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_secrets(text, base):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}", text or ""):
        free = all(m.end() <= int(s.split(":")[1]) or int(s.split(":")[2]) <= m.start() for s in base)
        if free and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and len(set(m[0])) >= 8:
            out.append(f"secret:{m.start()}:{m.end()}")
    return out


def brute_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), n, kind, m.end()))
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def plain_terms(texts):
    """{term: "removed" or "general"} by the definition, over {id: text}."""
    every, near, total = Counter(), Counter(), Counter()
    for t in texts.values():
        t = t or ""
        every.update(re.findall(r"[^\W\d_]+", t.lower()))
        base = brute_spans(t)
        marks = [s.split(":") for s in base] + [s.split(":") for s in brute_secrets(t, [])]
        for kind in {k for k, _, _ in marks}:
            spans = sorted((int(a), int(b)) for k, a, b in marks if k == kind)
            for a, b in spans:
                left, right = t[:a], t[b:]
                for x, y in sorted(spans, reverse=True):  # the kind's own spans are no words
                    left = left[:x] + " " * (min(y, a) - x) + left[min(y, a) :] if y <= a else left
                    right = right[: x - b] + " " * (y - x) + right[y - b :] if x >= b else right
                words_ = re.findall(r"[^\W\d_]+", left.lower())[-5:] + re.findall(r"[^\W\d_]+", right.lower())[:5]
                near.update((kind, w) for w in words_)
                total[kind] += len(words_)
    n, best = sum(every.values()), {}
    for (kind, w), k in near.items():
        if k >= pii.LEAST_SUPPORT:
            share = math.log2(k * n / (every[w] * total[kind])) / math.log2(n / total[kind])
            best[w] = max(share, best.get(w, -9))
    return {w: "removed" if x >= pii.REMOVE_AT else "general" for w, x in best.items() if x >= pii.GENERALISE_AT}


def plain_clean(text, terms):
    """The sanitised text by the definition."""
    text = text or ""
    base = brute_spans(text)
    spans = [(int(a), pii.ORDER.index(k), int(b)) for k, a, b in (s.split(":") for s in base + brute_secrets(text, base))]
    for m in re.finditer(r"[^\W\d_]+", text):
        what = terms.get(m[0].lower())
        if what and all(m.end() <= a or b <= m.start() for a, _, b in spans[: len(base) + len(brute_secrets(text, base))]):
            spans.append((m.start(), pii.ORDER.index(what), m.end()))
    out, at = [], 0
    for a, kind, b in sorted(spans):
        if a >= at:
            out += [text[at:a], pii.HOLDERS[pii.ORDER[kind]]]
        at = max(at, b)
    return "".join(out) + text[at:]


TRICKY = [
    "a@b.c%d@e.f, x@y.z.", "@a.b a@b a@b. a@-b.c-", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.1 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 41111111111111111111111",
    "+1 (017) 555-7713 +12 345 +1 234 567 890 123 456 7 ++1 4111 1111 1111 1111", "🎉é me@ex.am 10.0.0.1 日本+49 170 1234567", "a" * 4000 + "@b.co " + "1" * 3000, "x@a.b" * 700, "é@a.b c.d@e.f@g.h", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" key1234567890abcdefghijk@mail.example.com aaaaaaaaaaaaaaaaaaaaaaa1",
]


def test_personal_data_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()} | {10**6 + i: t for i, t in enumerate([*TRICKY, *AWKWARD])}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    n_secrets = 0
    for r in pii.find_personal_data(df, {}).select("doc_id", "__pii.*").collect():
        want = brute_spans(texts[r.doc_id])
        secrets = brute_secrets(texts[r.doc_id], want)
        every = sorted(want + secrets, key=lambda x: (int(x.split(":")[1]), pii.ORDER.index(x.split(":")[0])))
        n_secrets += len(secrets)
        assert r.spans == ",".join(every) and (r.n_secret, r.n_entities, r.n_terms) == (len(secrets), len(every), 0)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k, _ in PATTERNS]
        text, at, clean = texts[r.doc_id] or "", 0, []
        for s in every:
            kind, a, b = s.split(":")
            a, b = int(a), int(b)
            if a >= at:
                clean += [text[at:a], pii.HOLDERS[kind]]
            at = max(at, b)
        assert r.clean == "".join(clean) + text[at:]
    assert n_secrets


def test_disclosing_terms_against_brute_force(spark):
    filler = [f"filler{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    texts = [f"{' '.join(filler)} call Hotline now +1 212 555 {1000 + i} thanks" for i in range(20)] + [" ".join(filler) + " now"] * 30 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    every = Counter(w for t in texts for w in re.findall(r"[^\W\d_]+", (t or "").lower()))
    near = Counter()
    for t in texts:
        for m in re.finditer(PATTERNS[3][1], t or ""):
            left, right = re.findall(r"[^\W\d_]+", t[: m.start()].lower()), re.findall(r"[^\W\d_]+", t[m.end() :].lower())
            near.update(left[-5:] + right[:5])
    n, slots, want = sum(every.values()), sum(near.values()), {}
    for term, k in near.items():
        if k >= max(5, math.ceil(slots / 1000)):
            share = math.log2(k * n / (every[term] * slots)) / math.log2(n / slots)
            if share >= pii.GENERALISE_AT:
                want[term] = "removed" if share >= pii.REMOVE_AT else "general"
    got = pii.disclosing_terms(df)
    assert got == want and got["hotline"] == "removed"
    r = pii.find_personal_data(df, got).select("__pii.*").first()
    assert "Hotline" not in r.clean and "[PHONE]" in r.clean and "removed:" in r.spans and r.n_phone == 1


def test_sanitised_test_documents(spark):
    """Terms and texts of all test documents against plain versions."""
    docs = documents(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    terms = plain_terms(texts)
    table = pii.term_table(docs)
    assert {r.term: r.what for r in table.collect()} == terms
    for r in pii.find_personal_data(docs, table).select("doc_id", "__pii.clean").collect():
        assert r.clean == plain_clean(texts[r.doc_id], terms)


def test_personal_data_awkward(spark):
    out = pii.find_personal_data(awkward(spark), pii.disclosing_terms(awkward(spark)))
    assert out.count() == len(AWKWARD) + 4 and pii.disclosing_terms(empty(spark)) == {}
    assert pii.find_personal_data(empty(spark), {}).count() == 0


def test_terms_have_one_support_at_every_size(spark, monkeypatch):
    """Terms of five uses, all beside an IP, go although its contexts have over 5000 words; so do more terms than are listed."""
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    filler = " ".join(f"filler{name(i)}" for i in range(4000))
    texts = [f"far Secret{name(i)} 10.0.{i % 250}.1 away" for i in range(1200) for _ in range(5)] + [filler] * 40 + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = pii.term_table(df)
    terms = {r.term: r.what for r in table.collect()}
    assert {f"secret{name(i)}" for i in range(1200)} <= set(terms) and len(terms) > pii.LISTED_TERMS
    listed = {r.doc_id: r["__pii"] for r in pii.find_personal_data(df, terms).collect()}
    for most in (pii.BROADCAST_BYTES, -1):  # a broadcast, a shuffle
        monkeypatch.setattr(pii, "BROADCAST_BYTES", most)
        assert {r.term: r.what for r in pii.term_table(df).collect()} == terms
        joined = pii.find_personal_data(df, table)
        assert joined.columns == ["doc_id", "text", "__pii"] and {r.doc_id: r["__pii"] for r in joined.collect()} == listed
    assert "Secret" not in listed[0].clean and listed[len(texts) - 2].spans == ""


def test_contexts_are_five_whole_words_around_valid_spans(spark):
    long = "".join("ab"[i % 2] for i in range(90))
    texts = {
        "a b zorblatt since 2019 card 4111 1111 1111 1111 in 12 of 34 c d e f": ["a", "b", "zorblatt", "since", "card", "in", "of", "c", "d", "e"],
        f"a b {long} {long}x c 4111 1111 1111 1111": ["a", "b", long, f"{long}x", "c"],
        "one 4111 1111 1111 1111 two 4111-1111-1111-1111": ["one", "two", "one", "two"],
        "4111111111111111": [],
        "no card 12 34": [],
    }
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.text: r.w for r in df.select("text", pii._contexts(F.col("text"), "card").alias("w")).collect()} == texts


# fingerprints


def test_fingerprints_against_brute_force(spark):
    texts = {r.doc_id: r.text for r in documents(spark).collect()} | {10**6 + 7 * i: t for i, t in enumerate(AWKWARD)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    order = sorted(texts, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    rows_ = fingerprint.compare_with_next(df)
    rows_ = rows_.withColumn("near", fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("next", fingerprint.resemblance(F.col("sketch"), F.col("next_sketch"))).withColumn("distinct", fingerprint.distinct_shingles(F.col("sketch")))
    errors = []

    def sets(t):
        w = words(t)
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 1.0

    for r in rows_.collect():
        text, other = texts[r.doc_id] or "", texts[following[r.doc_id]] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert r.n_chars == len(text) and r.edited == edited
        a, b = sets(text), sets(edited)
        assert len(r.sketch) == min(len(a), fingerprint.K) and r.sketch == sorted(r.sketch)
        errors += [r.near - jaccard(a, b), r.next - jaccard(a, sets(other))]
        if len(a | b) <= fingerprint.K:
            assert r.near == pytest.approx(jaccard(a, b))
        assert r.distinct == pytest.approx(len(a), rel=0.4)
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors)) / len(errors) < 0.02


def test_sketches_merge(spark):
    a, b = "a b c d e f g h i j " * 2, "e f g h i j k l m n o p q"
    row = spark.sql("select 1").select(fingerprint.merged(F.array(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(b)))).alias("m"), fingerprint.sketch(F.lit(a)).alias("a"), fingerprint.sketch(F.lit(b)).alias("b"), fingerprint.containment(fingerprint.sketch(F.lit(a)), fingerprint.sketch(F.lit(a))).alias("c")).first()
    assert row.m == sorted(set(row.a) | set(row.b)) and row.c == 1.0


def test_fingerprints_awkward(spark):
    found = fingerprint.compare_with_next(awkward(spark)).collect()
    assert len(found) == len(AWKWARD) + 4
    assert all(r.next_sketch == [] for r in found if r.doc_id is None)
    assert fingerprint.compare_with_next(empty(spark)).count() == 0
    one = spark.createDataFrame([(4, "a b c d e f g")], "doc_id long, text string")
    assert fingerprint.compare_with_next(one).first().edited == "a b c da b"[:7] + "a b c "[:6]


def test_order_of_uneven_and_repeated_ids(spark, monkeypatch):
    """Outlier ids put no bucket's rows out of proportion, and rows of one id have the same next one."""
    monkeypatch.setattr(fingerprint, "PER_BUCKET", 8)
    ids = [*range(0, 900, 3), 2**62, -(2**63), 2**63 - 1, 7, 7, 7, 300, None, None]
    rows_ = [(i, f"text {i} of {n % 2}") for n, i in enumerate(ids)]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(5)
    least = {}
    for i, t in rows_:
        if i is not None:
            least[i] = min(t, least.get(i, t))
    order = sorted(least, reverse=True)
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    for most in (fingerprint.BROADCAST_BYTES, -1):
        monkeypatch.setattr(fingerprint, "BROADCAST_BYTES", most)
        found = fingerprint.with_next(df, "doc_id", "text").collect()
        assert sorted((str(r.doc_id), r.text) for r in found) == sorted((str(i), t) for i, t in rows_)
        assert all(r.next_text == (None if r.doc_id is None else least[following[r.doc_id]]) for r in found)
    bounds = [1, 5, 9, 12, 100]
    got = spark.range(-3, 120).select("id", fingerprint._bucket(F.col("id"), bounds).alias("b")).collect()
    assert all(r.b == sum(x <= r.id for x in bounds) for r in got)


# mixing


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), float(sum(sizes.values()))
    while free:
        whole = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / whole > 3 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / whole for s in free}
        target |= {s: 3.0 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    return target


def test_targets_against_brute_force(spark):
    import random

    rng = random.Random(4)
    for n in (1, 2, 7, 40):
        sizes = {f"s{i}é" if i else None: rng.choice([0, 1, 5, 100, 10_000, 10**12]) for i in range(n)}
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mixing_equal_rows_and_tiny_ratios(spark, monkeypatch):
    """Rows without id and of equal size fly in chunks of bounded size; a source far larger than its target gives its words all the same."""
    docs = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a").alias("source"), F.lit("one two three").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1, "b", "w " * 5000)], docs.schema))
    table = mixing._numbered(docs.select("source", "doc_id", F.lit(3).cast("long").alias("size")))
    chunks = [r["count"] for r in table.groupBy(F.pmod("row", F.lit(20))).count().collect()]
    assert table.count() == 5001 and max(chunks) < 400 and len(chunks) == 20
    found = mixing.mix(docs).collect()
    assert len(found) == 5001 and abs(sum(r.taken for r in found if r.source == "a") - found[0].target if found[0].source == "a" else 0) <= 3
    import numpy as np

    p = mixing.fly(np.full(300, 10.0**6), np.full(300, 5e-7), np.random.default_rng(1), mixing.LANDING)
    assert p.sum() == pytest.approx(300 * 5e-7)


def test_landing_is_the_nearest_rounding():
    import itertools

    import numpy as np

    rng = np.random.default_rng(9)
    for _ in range(30):
        size, p = rng.integers(1, 900, 7).astype(float), rng.random(7)
        got = mixing.land(size, p)
        off = lambda x: abs(float(np.dot(size, x)) - float(np.dot(size, p)))
        assert off(got) == pytest.approx(min(map(off, itertools.product((0.0, 1.0), repeat=7))))


def test_mixing(spark):
    docs = documents(spark)
    found = mixing.mix(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(found) == len(texts) and all(r.size == len(words(texts[r.doc_id])) and r.taken == r.size * r.copies and 0 <= r.copies <= 3 for r in found)
    sources = {}
    for r in found:
        s = sources.setdefault(r.source, [0, 0, r.target, r.source_size, []])
        s[0], s[1] = s[0] + r.size, s[1] + r.taken
        s[4].append(r.size)
    total = sum(s[0] for s in sources.values())
    assert sum(s[2] for s in sources.values()) == pytest.approx(total)
    order = sorted(sources)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    for s, (size, taken, target, source_size, parts) in sources.items():
        assert size == source_size and target <= 3 * size + 1e-6
        assert abs(taken - target) <= max(0.05 * target, sorted(parts)[len(parts) // 2])
    free = [s for s in order if sources[s][2] < 3 * sources[s][3] - 1e-6]
    rates = [sources[s][2] / weight[s] for s in free]
    assert max(rates) == pytest.approx(min(rates))
    again = {(r.doc_id, r.copies) for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, r.copies) for r in found}


def test_flight_keeps_balance_and_probabilities():
    import numpy as np

    rng = np.random.default_rng(3)
    size = rng.integers(1, 400, 101).astype(float)
    start = np.full(101, 0.37)
    total = np.zeros(101)
    for i in range(300):
        p = mixing.fly(size, start, np.random.default_rng(i))
        assert ((p > 0) & (p < 1)).sum() <= 2
        assert p.sum() == pytest.approx(start.sum()) and (p * size).sum() == pytest.approx((start * size).sum())
        total += p
    assert abs(total / 300 - 0.37).max() < 0.13  # inclusion probabilities are kept
    assert set(mixing.land(size, p)) <= {0.0, 1.0}


def test_mixing_many_chunks_and_awkward(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "b").when(F.col("id") < 2500, "a").alias("source"), F.expr("repeat('w ', cast(id % 50 as int))").alias("text"))
    found = mixing.mix(docs)
    for r in found.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect():
        assert abs(r.taken - r.target) <= 3
    assert mixing.mix(awkward(spark)).count() == len(AWKWARD) + 4
    assert mixing.mix(empty(spark)).count() == 0


# toxicity


def test_toxicity_held_out_accuracy(spark):
    import random

    rng = random.Random(5)
    plain = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    bad = ["horrible", "wretched", "vileness"]
    texts = []
    for i in range(600):
        w = [rng.choice(plain) for _ in range(80)]
        if i % 5 == 0:
            for _ in range(4):
                w[rng.randrange(80)] = rng.choice(bad)
        texts.append((i, " ".join(w), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in texts], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    truth = {i: y for i, _, y in texts}
    found = toxicity.score(docs, model).collect()
    held = [r for r in found if r.held_out]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    clean, misspelt = model.scores([" ".join(plain[:80]), " ".join(plain[:76] + ["horribble", "wretchedd", "vilenes", "horrble"])])
    assert misspelt > 0.3 > clean
    assert toxicity.score(awkward(spark), model).filter("score between 0 and 1").count() == len(AWKWARD) + 4
    assert toxicity.score(empty(spark), model).count() == 0


def plain_buckets(text):
    """Buckets of a text's n-grams by the definition, number by number."""
    from lodestack.llm import hashing

    whole = 1 << 64

    def mixed(x):
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (32, 0xD6E8FEB86659FD93), (32, 1)):
            x = (x ^ (x >> shift)) * factor % whole
        return x

    def number(points):
        return sum((p + 1) * pow(int(hashing.BASE), n, whole) for n, p in enumerate(points)) % whole

    out, words_, word = [], [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words_.append(word)
            word = ""
    for w in words_:
        points = [toxicity.EDGE, *map(ord, w), toxicity.EDGE]
        out += [mixed(number(points[i : i + n])) >> 48 for n in toxicity.SIZES for i in range(len(points) - n + 1)]
        out.append(mixed(number(points[1:-1]) * 3 % whole) >> 48)
    return out


def test_toxicity_scores_against_plain_ones():
    import numpy as np

    rng = np.random.default_rng(2)
    model = toxicity.Classifier(rng.normal(0, 2, toxicity.BUCKETS).astype(np.float32), -0.4)
    texts = ["Hello, wörld! a bc 12x", "", "one", "¡Qué! 日本語 — ok", "x" * 50, "a.b-c_d"]
    buckets, bounds = toxicity.gram_buckets(texts)
    for i, t in enumerate(texts):
        want = plain_buckets(t)
        assert sorted(buckets[bounds[i] : bounds[i + 1]].tolist()) == sorted(want)
        mean = sum(float(model.weight[b]) for b in want) / max(1, len(want))
        assert model.scores(texts)[i] == pytest.approx(1 / (1 + math.exp(-(mean + model.bias))), rel=1e-6)


def test_toxicity_of_repeated_ids(spark):
    """An id with several texts is learned by the least of them, whatever the order of the rows."""
    rows_ = [(i, f"good plain words {i}" if i % 2 else f"awful nasty words {i}") for i in range(80)] + [(4, "zzz other"), (6, None), (6, "awful nasty words 6")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string")
    labels = spark.createDataFrame([(i, (i + 1) % 2) for i in range(80)], "doc_id long, toxic int")
    one, two = (toxicity.train(docs.orderBy(order), labels) for order in (F.col("text").asc(), F.col("text").desc()))
    assert (one.weight == two.weight).all() and one.bias == two.bias


def test_toxicity_never_learns_from_held_out(spark):
    import zlib

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    for r in docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect():
        assert r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    labels = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).cast("int").alias("toxic"))
    assert toxicity.train(docs, labels).bias == -20.0  # only class 0 is left


# licences


def test_licenses(spark):
    texts = [
        "Some words.\nReleased under the MIT License.\nMore.", "é🎉 This work is licensed under the GNU General Public License, version 3. x", "Licensed under CC BY-NC 4.0.",
        "licensed UNDER the apache license version 2 0 " * 3, "a licence to nothing under the sun", "Permission is hereby granted, free of charge, to any person who obtains a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.matches for r in license_scan.scan_licenses(df).collect()}
    assert [[m.license for m in found[i]] for i in range(6)] == [["MIT"], ["GPL-3.0"], ["CC-BY-NC-4.0"], ["Apache-2.0"] * 3, [], ["MIT-text"]]
    assert texts[0][found[0][0].start : found[0][0].stop] == "Released under the MIT License"
    assert texts[1][found[1][0].start : found[1][0].stop] == "This work is licensed under the GNU General Public License, version 3"
    assert 0.9 < found[5][0].coverage < 1 and found[0][0].coverage == 1
    assert license_scan.scan_licenses(awkward(spark)).count() == len(AWKWARD) + 4 and license_scan.scan_licenses(empty(spark)).count() == 0


def plain_align(template, text, diagonal, band):
    """The best score of the band by plain recursion."""
    from functools import lru_cache

    low, n = diagonal - band, len(text)

    @lru_cache(None)
    def score(i, d):
        j = i + low + d
        if i == 0:
            return 0
        if d < 0 or d > 2 * band or j < 0 or j > n:
            return -1e9
        out = score(i - 1, d + 1) - 1 if d < 2 * band else -1e9
        if j >= 1 and template[i - 1] == text[j - 1]:
            out = max(out, score(i - 1, d) + 2)
        if d >= 1 and j >= 1:
            out = max(out, score(i, d - 1) - (i < len(template)))
        return out

    return max(score(len(template), d) for d in range(2 * band + 1))


def test_alignment_against_plain_recursion():
    import random

    import numpy as np

    rng = random.Random(3)
    for _ in range(150):
        template = [rng.randrange(6) for _ in range(rng.randint(1, 12))]
        text = [rng.randrange(6) for _ in range(rng.randint(0, 5))] + [x if rng.random() < 0.8 else rng.randrange(6) for x in template if rng.random() < 0.9] + [rng.randrange(6) for _ in range(rng.randint(0, 5))]
        diagonal, band = rng.randint(-2, 6), rng.randint(1, 5)
        matched, first, last, gaps = license_scan.align(np.array(template), np.array(text, int), diagonal, band)
        want = plain_align(tuple(template), tuple(text), diagonal, band)
        assert matched <= len(template) and (not matched or 0 <= first <= last < len(text))
        assert 2 * matched - gaps >= want  # left-out words before the first match and put-in ones count as the score has them


def test_winnowing_against_plain_windows():
    import random

    import numpy as np

    rng = random.Random(2)
    for _ in range(100):
        grams = np.array([rng.randrange(9) for _ in range(rng.randint(0, 20))])
        w = license_scan.WINDOW
        want = set()
        for i in range(len(grams) - w + 1) if len(grams) > w else ([0] if len(grams) else []):
            window = grams[i : i + w] if len(grams) > w else grams
            want.add(i + max(k for k in range(len(window)) if window[k] == window.min()))
        assert set(license_scan._winnowed(grams).tolist()) == want


def test_whole_licences_and_copies(spark):
    from lodestack.llm import license_templates as texts

    whole = {name: parts[0] for name, parts in texts.TEMPLATES.items() if name.endswith("-whole")}
    edited = {name: " ".join("EXAMPLE" if n % 31 == 30 else w for n, w in enumerate(t.split())) for name, t in whole.items()}
    rows_ = [*whole.values(), *edited.values(), "SPDX-License-Identifier: MIT\n" * 5, "x " * 40 + texts.MIT_OPENING, "no licence " * 50]
    found = [r.matches for r in license_scan.scan_licenses(spark.createDataFrame(list(enumerate(rows_)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert [[m.license for m in f] for f in found[: 2 * len(whole)]] == [[n] for n in whole] * 2
    assert all(f[0].coverage == 1 for f in found[: len(whole)]) and all(license_scan.LEAST_COVERAGE <= f[0].coverage < 1 for f in found[len(whole) : 2 * len(whole)])
    assert [m.license for m in found[-3]] == ["MIT"] * 5 and [m.license for m in found[-2]] == ["MIT-text"] and found[-1] == []


def test_a_long_text_of_many_licences(spark):
    import time

    line = "Released under the MIT License.\nLicensed under CC BY 4.0.\n"
    df = spark.createDataFrame([(1, line * 4000), (2, "This work is licensed under the GNU General Public License, version 3. Released under the GNU General Public License v3.0.")], "doc_id long, text string")
    began = time.time()
    found = {r.doc_id: r.matches for r in license_scan.scan_licenses(df).collect()}
    assert len(found[1]) == 8000 and [m.license for m in found[1][:2]] == ["MIT", "CC-BY-4.0"] and time.time() - began < 60
    assert [m.license for m in found[2]] == ["GPL-3.0", "GPL-3.0"]


def test_license_lines_of_test_documents(spark):
    docs = documents(spark)
    line = re.compile(r"^(?:Released under the MIT License\.|Licensed under CC BY-NC 4\.0\.|Licensed under the Apache License, Version 2\.0\.|This work is licensed under the GNU General Public License, version 3\.)$", re.M)
    want = {r.doc_id: [(m.start(), m.end() - 1) for m in line.finditer(r.text)] for r in docs.collect()}
    got = {r.doc_id: [(m.start, m.stop) for m in r.matches] for r in license_scan.scan_licenses(docs).collect()}
    assert got == want and any(want.values())


# sentence pieces


def small_model():
    import numpy as np

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), *[(f"<0x{i:02X}>", 0.0, 6) for i in range(256)], ("▁", -3.0, 1), ("▁▁", -3.5, 1), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("▁ab", -3.9, 1), ("ba", -4.0, 1), ("aba", -4.1, 1), ("é", -5.0, 1)]
    return sentencepiece.Model(sentencepiece.Vocabulary([p for p, _, _ in pieces], np.array([s for _, s, _ in pieces]), np.array([t for _, _, t in pieces])))


def brute_score(model, text):
    v = model.vocabulary
    plain = {p: s for p, s, t in zip(v.pieces, v.scores, v.types, strict=True) if t == 1}
    best = [0.0] + [-1e18] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            s = plain.get(text[i:j], model.lost if j == i + 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@pytest.mark.parametrize("long", [4096, 2])
def test_viterbi_against_brute_force(long, monkeypatch):
    import random

    monkeypatch.setattr(sentencepiece, "LONG", long)
    rng, model = random.Random(1), small_model()
    for _ in range(300):
        text = "".join(rng.choice("aab é 日\n▁") for _ in range(rng.randint(1, 24)))
        (ids,) = model.encode([text])
        score = sum(model.lost if model.is_byte[i] else model.score[i] for i in ids if not model.is_byte[i])
        unknown = sum(c in "日\n" for c in text)
        assert score + unknown * model.lost == pytest.approx(brute_score(model, model.marked(text)))
        assert model.decode(ids) == text.replace("▁", " ")


def test_pieces_against_library(spark):
    """The library's own unigram search, given the same pieces and scores, finds no better segmentation, and ours round-trips."""
    import struct

    import sentencepiece as library

    model = sentencepiece.Model.load(piece_model())
    v = model.vocabulary

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, data):
        return varint(number << 3 | 2) + varint(len(data)) + data

    proto = b"".join(message(1, message(1, p.encode()) + b"\x15" + struct.pack("<f", s) + b"\x18" + varint(int(t))) for p, s, t in zip(v.pieces, v.scores, v.types, strict=True))
    proto += message(2, b"\x18\x01\x98\x02\x01") + message(3, message(1, b"identity") + b"\x18\x01\x20\x00\x28\x01")
    reference = library.SentencePieceProcessor(model_proto=proto)
    texts = [r.text for r in documents(spark).limit(60).collect()] + [t for t in AWKWARD if t and "\x00" not in t]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        assert model.decode(ids) == text
        theirs = reference.encode(text)
        total = lambda x: sum(model.score[i] for i in x)
        assert ids.tolist() == theirs or total(ids) >= total(theirs) - 1e-3


def test_encoding_awkward(spark):
    found = sentencepiece.encode(awkward(spark), piece_model(), digest=True).collect()
    assert len(found) == len(AWKWARD) + 4
    for r in found:
        if r.doc_id is not None:
            assert r.decoded_sha256 == hashlib.sha256((AWKWARD[r.doc_id] or "").encode()).hexdigest()
    assert sentencepiece.encode(empty(spark), piece_model()).count() == 0


def test_fingerprint_text_is_the_sketch(spark):
    df = spark.createDataFrame(rows([GOOD]), "doc_id long, text string, lang string, source string, n_chars long, id string, score double, n long, key string")
    r = df.select(fingerprint.sketch(F.col("text")).alias("s"), fingerprint.shown(fingerprint.sketch(F.col("text"))).alias("t")).first()
    raw = base64.b64decode(r.t)
    assert [int.from_bytes(raw[i : i + 8], "big", signed=True) for i in range(0, len(raw), 8)] == r.s
