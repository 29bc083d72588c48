"""Personal data: pattern spans, and terms that disclose them by corpus co-occurrence, all in DataFrame operations.

Pattern spans come from splitting a text at a pattern: the lengths of the pieces and matches give the offsets.  The
patterns are written with possessive quantifiers and a look-behind, so each runs in linear time; they match exactly what
the plain patterns match leftmost and without overlap.

Protected entities are the four base kinds and secrets: long opaque runs of letters and digits, such as keys, outside the
base spans.  For a term t within CONTEXT_WORDS words of an entity of kind e,
pointwise mutual information over corpus counts, PMI(t; e) = log2(n(t,e) N / (n(t) n(e))), is at most the entity's
information content IC(e) = log2(N / n(e)); their quotient is the share of the entity that the term discloses.  Terms
above REMOVE_AT are removed, terms above GENERALISE_AT replaced by a general word.  A term needs LEAST_SUPPORT
occurrences near the kind, at every size of the corpus.  So the terms are a table that grows with the corpus: up to
LISTED_TERMS of them are written into the expressions, more are joined with the words of the texts, by a broadcast up to
BROADCAST_BYTES and by a shuffle beyond, with the same result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import settled
from .let import let

#: The pattern of each kind, in the order in which spans of one start are listed.
KINDS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds of entity that the method adds to the base ones.
ADDED = {"secret": r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"}
PROTECTED = KINDS | ADDED
#: Different characters of a secret.
LEAST_VARIETY = 8
ORDER = [*PROTECTED, "general", "removed"]
HOLDERS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "secret": "[SECRET]", "general": "[TERM]", "removed": ""}
CONTEXT_WORDS = 5
GENERALISE_AT, REMOVE_AT = 0.8, 0.9
LEAST_SUPPORT = 5
LISTED_TERMS, BROADCAST_BYTES = 1000, 16_000_000
BLOCK = 256
NOT_LETTERS, LETTERS = r"[^\p{L}]+", r"[\p{L}]+"


def _luhn(digits: Column) -> Column:
    doubled = F.lit([0, 2, 4, 6, 8, 1, 3, 5, 7, 9])
    back = F.reverse(digits)
    digit = lambda i: F.substring(back, i + 1, F.lit(1)).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), lambda a, i: a + F.when(i % 2 == 1, F.get(doubled, digit(i))).otherwise(digit(i)))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "secret":
        return (digits != "") & match.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(match, ""))) >= LEAST_VARIETY)
    return F.lit(True)


def _may_have(kind: str, text: Column) -> Column:
    return {"email": text.contains("@"), "phone": text.contains("+"), "secret": text.rlike(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20}")}.get(kind, text.rlike(r"[0-9][\x20.-]?[0-9]"))


def _cut(text: Column, pattern: str) -> Column:
    """Struct of the pieces between the matches, one more than those, and the matches."""
    return F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"))


SPAN = "array<struct<start:int,kind:int,stop:int,byte_start:int,byte_stop:int>>"


def _placed(cut: Column, wanted, kind_of) -> Column:
    """Spans of the wanted matches: code-point and byte offsets.  Found ones are gathered in blocks, so that the work stays near linear.

    ``wanted`` and ``kind_of`` get a match, its index and the number of spans found before it.
    """
    none = F.array().cast(SPAN)
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("byte"), F.lit(0).alias("found"), none.alias("block"), F.array().cast(f"array<{SPAN}>").alias("full"))

    def step(acc: Column, i: Column) -> Column:
        piece, match = F.get(cut["pieces"], i), F.get(cut["matches"], i)

        def put(x: Column) -> Column:
            span = F.array(F.struct(x["at"].alias("start"), kind_of(match, i, acc["found"]).alias("kind"), x["stop"].alias("stop"), x["byte"].alias("byte_start"), x["byte_stop"].alias("byte_stop"))).cast(SPAN)
            whole = F.size(acc["block"]) >= BLOCK
            hit = wanted(match, i, acc["found"])
            block = F.when(~hit, acc["block"]).when(whole, span).otherwise(F.concat(acc["block"], span))
            full = F.when(hit & whole, F.concat(acc["full"], F.array(acc["block"]))).otherwise(acc["full"])
            return F.struct(x["stop"].alias("at"), x["byte_stop"].alias("byte"), (acc["found"] + hit.cast("int")).alias("found"), block.alias("block"), full.alias("full"))

        at, byte = acc["at"] + F.length(piece), acc["byte"] + F.octet_length(piece)
        return let(F.struct(at.alias("at"), (at + F.length(match)).alias("stop"), byte.alias("byte"), (byte + F.octet_length(match)).alias("byte_stop")), put)

    indices = F.sequence(F.lit(0), F.size(cut["matches"]) - 1)
    found = F.aggregate(indices, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["block"]))))
    return F.when(F.size(cut["matches"]) > 0, found).otherwise(none)


def _spans_of(text: Column, kind: str) -> Column:
    found = let(_cut(text, PROTECTED[kind]), lambda c: _placed(c, lambda m, *_: _valid(kind, m), lambda *_: F.lit(ORDER.index(kind))))
    return F.when(_may_have(kind, text), found).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> Column:
    """All valid spans of the base patterns, by start and then kind."""
    return F.sort_array(F.concat(*[_spans_of(text, kind) for kind in KINDS]))


def added_spans(text: Column, base: Column) -> Column:
    """Spans of the added kinds that touch no base span."""
    return F.concat(*[_free(_spans_of(text, kind), base) for kind in ADDED])


def _contexts(text: Column, kind: str) -> Column:
    """Lower-cased words of letters near each valid match: CONTEXT_WORDS on each side, of the text around the valid matches."""
    none, mark = F.array().cast("array<string>"), "0"  # no word of letters
    words = lambda x: F.filter(F.split(F.lower(x), NOT_LETTERS, -1), lambda w: w != "")

    def marked(c: Column) -> Column:
        is_entity = lambda i: F.coalesce(_valid(kind, F.get(c["matches"], i)), F.lit(False))
        return F.flatten(F.transform(c["pieces"], lambda x, i: F.concat(words(x), F.when(is_entity(i), F.array(F.lit(mark))).otherwise(none))))

    def near(w: Column) -> Column:
        places = F.filter(F.transform(w, lambda x, i: F.when(x == mark, i)), lambda i: i.isNotNull())
        before = F.transform(places, lambda i, n: i - n)  # words before each match
        plain = F.filter(w, lambda x: x != mark)
        around = lambda p, n: F.slice(p, F.greatest(n - CONTEXT_WORDS + 1, F.lit(1)), F.least(n, F.lit(CONTEXT_WORDS)) + CONTEXT_WORDS)
        return let(plain, lambda p: F.flatten(F.transform(before, lambda n: around(p, n))))

    return F.when(_may_have(kind, text), let(let(_cut(text, PROTECTED[kind]), marked), near)).otherwise(none)


def _broadcast(rows: DataFrame, n_bytes: Column) -> DataFrame:
    """``rows``, marked for a broadcast if they are of at most BROADCAST_BYTES."""
    return F.broadcast(rows) if (rows.agg(F.sum(n_bytes)).first()[0] or 0) <= BROADCAST_BYTES else rows


def _term_bytes() -> Column:
    return F.octet_length("term") + 32


def term_table(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, what): "general" or "removed", from co-occurrence counts over all documents; of as many terms as qualify."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    of = lambda kind: F.transform(_contexts(text, kind), lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("term")))
    near = docs.select(F.explode(F.concat(*map(of, PROTECTED))).alias("x")).select("x.*")
    counts = settled(near.groupBy("kind", "term").agg(F.count("*").alias("n")), "contexts")
    slots = {r.kind: r.n for r in counts.groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # one row a kind
    support = counts.filter(F.col("n") >= LEAST_SUPPORT)
    wanted = settled(support.select("term").distinct(), "support")
    words = F.filter(F.split(F.lower(text), NOT_LETTERS, -1), lambda w: w != "")
    held = _broadcast(wanted, _term_bytes())
    counted = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("uses"))
    if held is not wanted:  # words that aren't asked for meet in the row of null before the shuffle
        counted = docs.select(F.explode(words).alias("word")).join(held, F.col("word") == F.col("term"), "left").groupBy(F.col("term").alias("word")).agg(F.count("*").alias("uses"))
    counted = settled(counted, "uses")
    everything = counted.agg(F.sum("uses")).first()[0] or 0
    content = {kind: math.log2(everything / n) for kind, n in slots.items() if n < everything}
    if not content:
        return docs.sparkSession.createDataFrame([], "term string, what string")
    by_kind = lambda values: F.coalesce(*[F.when(F.col("kind") == kind, F.lit(float(values[kind]))) for kind in content])
    disclosed = F.log2(F.col("n") * F.lit(float(everything)) / (F.col("uses") * by_kind(slots))) / by_kind(content)
    shares = support.join(counted, F.col("term") == F.col("word")).groupBy("term").agg(F.max(disclosed).alias("share"))
    return settled(shares.filter(F.col("share") >= GENERALISE_AT).select("term", F.when(F.col("share") >= REMOVE_AT, "removed").otherwise("general").alias("what")), "terms")


def disclosing_terms(docs: DataFrame, text_col: str = "text") -> dict[str, str]:
    """The rows of term_table on the driver, for small corpora."""
    return {r.term: r.what for r in term_table(docs, text_col).collect()}


def _free(spans: Column, base: Column) -> Column:
    return F.filter(spans, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))


def term_spans(text: Column, base: Column, terms: dict[str, str]) -> Column:
    """Spans of the disclosing terms that touch no span of ``base``."""
    none = F.array().cast(SPAN)
    if not terms:
        return none
    removed = [t for t, what in terms.items() if what == "removed"]
    known = lambda m, *_: F.lower(m).isin(list(terms))
    kind = lambda m, *_: F.when(F.lower(m).isin(removed), F.lit(ORDER.index("removed"))).otherwise(F.lit(ORDER.index("general"))) if removed else F.lit(ORDER.index("general"))
    found = let(_cut(text, LETTERS), lambda c: F.when(F.exists(c["matches"], lambda m: known(m)), _placed(c, known, kind)).otherwise(none))
    return _free(found, base)


def _hit_spans(text: Column, base: Column, hits: Column) -> Column:
    """As term_spans, from the places of the terms among the text's words: (pos, kind) in order, walked along with the words."""
    none = F.array().cast(SPAN)
    at = lambda i, found: F.coalesce(F.get(hits, found)["pos"] == i, F.lit(False))
    found = F.when(F.size(hits) > 0, let(_cut(text, LETTERS), lambda c: _placed(c, lambda m, i, found: at(i, found), lambda m, i, found: F.get(hits, found)["kind"]))).otherwise(none)
    return _free(found, base)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _with_hits(docs: DataFrame, terms: DataFrame, text: Column) -> DataFrame:
    """``docs`` with ``__hits``, the places of terms among the words of the text.  Equal texts share them, so rows need no key of their own."""
    words = docs.select(_digest(text).alias("digest"), F.posexplode(F.transform(F.regexp_extract_all(text, F.lit(LETTERS), F.lit(0)), F.lower)).alias("pos", "word"))
    kind = F.when(F.col("what") == "removed", ORDER.index("removed")).otherwise(ORDER.index("general"))
    found = words.join(_broadcast(terms, _term_bytes()), F.col("word") == F.col("term")).select("digest", "pos", kind.alias("kind")).distinct()
    hits = settled(found.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("pos", "kind"))).alias("__hits")), "hits")
    hits = _broadcast(hits, F.size("__hits") * 24 + 96).withColumnRenamed("digest", "__of")
    none = F.array().cast("array<struct<pos:int,kind:int>>")
    return docs.join(hits, _digest(text) == F.col("__of"), "left").drop("__of").withColumn("__hits", F.coalesce("__hits", none))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(F.lit(ORDER), s["kind"]), s["start"], s["stop"])), ",")


def _running_max(values: Column) -> Column:
    """The greatest value so far at each place, gathered in blocks as in _placed."""
    start = F.struct(F.lit(0).alias("top"), F.array().cast("array<int>").alias("block"), F.array().cast("array<array<int>>").alias("full"))

    def step(acc: Column, x: Column) -> Column:
        top, whole = F.greatest(acc["top"], x), F.size(acc["block"]) >= BLOCK
        block = F.when(whole, F.array(top)).otherwise(F.concat(acc["block"], F.array(top)))
        full = F.when(whole, F.concat(acc["full"], F.array(acc["block"]))).otherwise(acc["full"])
        return F.struct(top.alias("top"), block.alias("block"), full.alias("full"))

    return F.aggregate(values, start, step, lambda acc: F.flatten(F.concat(acc["full"], F.array(acc["block"]))))


def _sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind's holder; a span that begins in an earlier one is cut off with it."""
    raw = F.encode(text, "UTF-8")
    part = lambda low, high: F.when(high > low, F.substring(raw, low + 1, high - low).cast("string")).otherwise(F.lit(""))

    def clean(s: Column) -> Column:
        def joined(reach: Column) -> Column:
            covered = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0))
            holder = lambda x: F.get(F.lit(list(HOLDERS.values())), x["kind"])
            bits = F.transform(s, lambda x, i: F.concat(part(covered(i), x["byte_start"]), F.when(x["byte_start"] >= covered(i), holder(x)).otherwise(F.lit(""))))
            return F.concat(F.array_join(bits, ""), part(F.element_at(reach, -1), F.octet_length(raw)))

        return let(_running_max(F.transform(s, lambda x: x["byte_stop"])), joined)

    return F.when(F.size(spans) == 0, text).otherwise(let(spans, clean))


def find_personal_data(docs: DataFrame, terms: dict[str, str] | DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``__pii``: counts by kind, base_sha256, spans, the sanitised text, and the numbers of entities and terms.

    One narrow pass without a shuffle for terms in a dict, or a term_table of up to LISTED_TERMS rows; a longer table is joined.

    Null and empty texts have no spans; a null text stays null.  Rows are worked on one by one, repeated rows alike, and
    columns of ``docs``, whatever their names, are kept as they are.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if isinstance(terms, DataFrame) and terms.count() <= LISTED_TERMS:
        terms = {r.term: r.what for r in terms.collect()}
    joined = isinstance(terms, DataFrame)
    if joined:
        docs = _with_hits(docs, terms, text)

    def described(b: Column) -> Column:
        def whole(entities: Column) -> Column:
            named = _hit_spans(b["text"], entities, b["hits"]) if joined else term_spans(b["text"], entities, terms)
            of = lambda n: F.size(F.filter(entities, lambda s: s["kind"] == n)).cast("long")
            counts = [of(n).alias(f"n_{kind}") for n, kind in enumerate(PROTECTED)]
            last = lambda e: [F.size(entities).cast("long").alias("n_entities"), (F.size(e) - F.size(entities)).cast("long").alias("n_terms")]
            return let(F.sort_array(F.concat(entities, named)), lambda e: F.struct(*counts, F.sha2(_listed(b["base"]), 256).alias("base_sha256"), _listed(e).alias("spans"), _sanitised(b["text"], e).alias("clean"), *last(e)))

        return let(F.concat(b["base"], added_spans(b["text"], b["base"])), whole)

    hits = [F.col("__hits").alias("hits")] if joined else []
    return docs.withColumn("__pii", let(text, lambda t: let(F.struct(t.alias("text"), base_spans(t).alias("base"), *hits), described))).drop("__hits")
