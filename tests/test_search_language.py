"""The search language: trees of queries, and the same documents by index and by scan."""

import pytest
from pyspark.sql import functions as F

from lodestack import catalog_queries
from lodestack.functions.text import analyze, query_terms, terms
from lodestack.operators.highlight import highlight_json, highlights, snippet_html, snippets, utf8_spans
from lodestack.operators.index import build_postings, replace_documents, without_documents
from lodestack.plans.ast import And, Everything, Field, Fuzzy, Not, Or, Phrase, Prefix, Proximity, Regex
from lodestack.plans.compile import IndexSearch, regex_rules, scan_column
from lodestack.plans.parser import QuerySyntaxError, parse


def shown(q):
    """A short text for a tree."""
    if isinstance(q, Everything):
        return "*"
    if isinstance(q, (And, Or)):
        return f"({f' {type(q).__name__.lower()} '.join(map(shown, q.nodes))})"
    if isinstance(q, Not):
        return f"-{shown(q.node)}"
    where = "" if q.field.kind == "all" else f"{q.field.name or q.field.kind}@"
    tail = {Phrase: "", Prefix: "..", Regex: "/"}.get(type(q))
    if isinstance(q, Fuzzy):
        tail = f"~{'?' if q.distance is None else q.distance}"
    if isinstance(q, Proximity):
        tail = f"^{q.slop}"
    return f"{where}<{q.text}>{tail}"


@pytest.mark.parametrize(
    "text, want",
    [
        ("", "*"), ("  ", "*"), ("apple", "<apple>"), ("apple pie", "<apple pie>"), ("a1 AND b1 or c1", "((<a1> and <b1>) or <c1>)"), ("a1 or b1 and c1", "((<a1> or <b1>) and <c1>)"),
        ("a1 and b1 AND c1", "(<a1> and <b1> and <c1>)"), ("not a1 and b1", "(-<a1> and <b1>)"), ("a1 not b1", "<a1 not b1>"), ("and x", "<and x>"), ("orchid android", "<orchid android>"),
        ("a1 and (b1 or not c1)", "(<a1> and (<b1> or -<c1>))"), ("a1 and (b1 or", "(<a1> and <(b1 or>)"), ("( a1 )", "<a1>"), ("'it\\'s \"so\"'", "<it's \"so\">"), ("“x 'y”", "<x 'y>"), ('"open', '<"open>'),
        ("pear~", "<pear>~?"), ("pear~1", "<pear>~1"), ("'red pear'~4", "<red pear>^4"), ("red pear~4", "<red pear>^4"), ("pe*", "<pe>.."), ("p*", "<p*>"), ("*", "<*>"), ("red pe*", "<red pe>.."), ("pe* red", "<pe* red>"),
        ("not pe*", "-<pe>.."), ("not*", "<not>.."), ("title: red", "title@<red>"), ("notes:red or text:pe*", "(notes@<red> or text@<pe>..)"), ("colour:red", "colour@<red>"), ("'my colour':red pear", "my colour@<red pear>"), ("\"title\":x", "title@<x>"),
        ("text:/a b/", "text@<a b>/"), ("text:/a/ and b", "(text@<a>/ and <b>)"), ("text:/a", "text@</a>"), ("text:/a/ b", "text@</a/ b>"), ("/a\\/b/", "<a\\/b>/"), ("/a/b/", "</a/b/>"), ("'and' and 'or'", "(<and> and <or>)"),
    ],
)
def test_trees(text, want):
    assert shown(parse(text)) == want


@pytest.mark.parametrize("text", ["a1)", "(a1) b1)", ")", "not )"])
def test_syntax_errors(text):
    with pytest.raises(QuerySyntaxError):
        parse(text)


def test_analysis():
    assert [t for t, _, _ in analyze("Dr. O'Neil's  3.25% ﬁne, ＡＢＣ straße")] == ["dr", "o'neil's", "3.25", "fine", "abc", "strasse"]
    assert analyze("x 🎉 Yz")[1] == ("yz", 4, 6)
    assert query_terms("Cafe\u0301") == query_terms("caf\u00e9")


DOCS = [
    (1, "red apple", "The quick brown fox jumps over the lazy dog", "moss green"), (2, "blue pear", "quick fox brown; a dog that is lazy", "red"), (3, "note", "Brown brown quick", None),
    (4, "jumpy", "over the lazy over the", "green"), (5, "", "", ""), (6, "naïve café", "FOXES foxed fox", "x"),
]
QUERIES = ["fox", "'quick brown'", "quick brown~1", "'brown quick'~2", "brown quick~0", "fox*", "over the la*", "foxx~1", "ofx~1", "fox~0", "jmupy~", "apple or pear", "brown and not fox", "not brown", "not brown and not over", "title:red", "text:red", "text:'brown brown'", "brown brown~1", "color:green", "color:moss gr*", "color:red or title:note", "fox and (dog or title:café)", "...", "!!*", "fox and text:/q/"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, x, f'{{"color": "{c}"}}' if c is not None else None) for i, t, x, c in DOCS]
    return spark.createDataFrame(rows, "id long, title string, text string, metadata_json string")


@pytest.fixture(scope="module")
def postings(docs):
    return build_postings(docs, ["color"], "simple").persist()


def plain(q, i, title, text, color):
    """A query on one document, by the meaning of the words."""
    if isinstance(q, Everything) or isinstance(q, Regex):
        return True
    if isinstance(q, And):
        return all(plain(n, i, title, text, color) for n in q.nodes)
    if isinstance(q, Or):
        return any(plain(n, i, title, text, color) for n in q.nodes)
    if isinstance(q, Not):
        return isinstance(q.node, Regex) or not plain(q.node, i, title, text, color)
    fields = {"all": [title, text], "title": [title], "text": [text], "metadata": [color or ""]}[q.field.kind]
    wanted = query_terms(q.text, "simple")

    def edits(a, b):
        if not a or not b:
            return len(a) + len(b)
        best = min(edits(a[1:], b) + 1, edits(a, b[1:]) + 1, edits(a[1:], b[1:]) + (a[0] != b[0]))
        return min(best, edits(a[2:], b[2:]) + 1) if a[:2] == b[1::-1] and len(b) > 1 and len(a) > 1 else best

    for f in fields:
        t = query_terms(f, "simple")
        if isinstance(q, Fuzzy):
            if any(abs(len(x) - len(q.text)) < 3 and edits(x, q.text.lower()) <= min(2, 2 if q.distance is None else q.distance) for x in t):
                return True
            continue
        if not wanted:
            continue
        slop = q.slop if isinstance(q, Proximity) else 0
        same = [lambda x, w=w: x == w for w in wanted]
        if isinstance(q, Prefix):
            same[-1] = lambda x: x.startswith(wanted[-1])

        def fits(k, used):
            if k == len(wanted):
                at = [p - n for n, p in enumerate(used)]
                return max(at) - min(at) <= slop
            return any(fits(k + 1, [*used, p]) for p, x in enumerate(t) if p not in used and same[k](x))

        if fits(0, []):
            return True
    return False


@pytest.mark.parametrize("text", QUERIES)
def test_index_and_scan_agree_with_plain_reading(docs, postings, text):
    query = parse(text)
    want = sorted(d[0] for d in DOCS if plain(query, *d))
    search = IndexSearch(postings, docs.select("id"), "simple")
    assert sorted(r.id for r in search.search(query).collect()) == want
    arrays = {"title": terms(F.col("title")), "text": terms(F.col("text")), "meta:color": terms(F.get_json_object("metadata_json", "$.color"))}
    assert sorted(r.id for r in docs.filter(scan_column(query, arrays)).select("id").collect()) == want


def test_unicode_index(docs):
    search = IndexSearch(build_postings(docs, ["color"]), docs.select("id"))
    assert [r.id for r in search.search(parse("NAI\u0308VE")).collect()] == [6]


def test_warnings(docs, postings):
    search = IndexSearch(postings, docs.select("id"), "simple", most_expansions=1)
    assert search.search(parse("over the l*")).count() == 2
    search.search(parse("text:quick b*"))
    search.search(parse("quick~7"))
    search.search(parse("text:foxes f*"))
    assert [w.kind for w in search.warnings] == ["TooMuchFuzz", "TooManyExpansions"]
    none = IndexSearch(None, docs.select("id"))
    assert none.search(parse("x")).count() == 0 and none.warnings[0].kind == "IndexDoesNotExist"


def test_regex_rules():
    rules, warnings = regex_rules(parse("title:/a/ and not /b/ and (c or not /d/) and /(/"))
    assert [(r.field.kind, r.pattern, r.negated) for r in rules] == [("title", "a", False), ("all", "b", True)]
    assert [(w.kind, w.about) for w in warnings] == [("NestedRegexIgnored", "d"), ("RegexSyntaxError", "(")]
    assert regex_rules(parse("plain"))[0] == [] and parse("x:/y/") == Regex(Field("metadata", "x"), "y")


def test_index_changes(spark, docs, postings):
    new = build_postings(spark.createDataFrame([(1, "t", "zebra")], "id long, title string, text string"), [], "simple")
    changed = replace_documents(postings, new)
    search = IndexSearch(changed, docs.select("id"), "simple")
    assert [r.id for r in search.search(parse("zebra")).collect()] == [1]
    assert 1 not in [r.id for r in search.search(parse("fox")).collect()]
    assert without_documents(postings, docs.select("id")).count() == 0


def test_highlights():
    text = "🎉 Quick fox. The quick, brown fox; foxes"
    cut = lambda spans: [text[a:b] for a, b in spans]
    assert cut(highlights(text, parse("'quick fox' or brown"), utf16=False)) == ["Quick", "fox", "brown"]
    assert cut(highlights(text, parse("fox*"), utf16=False)) == ["fox", "fox", "foxes"]
    assert highlights(text, parse("quick"))[0] == (3, 8)
    assert highlights(text, parse("not quick and title:fox")) == []
    assert highlight_json(text, parse("brown")) == "[[25,30]]" and utf8_spans(text, [(2, 7)]) == [(5, 10)]


def test_snippets():
    text = "First one here. " + "filler words " * 20 + "needle in it. Last needle! And needle <b>."
    found = snippets(text, parse("needle"))
    assert len(found) == 2 and all(s["end"] - s["begin"] <= 80 for s in found)
    html = snippet_html(text, found)
    assert html.count("<em>needle</em>") == 2 and html.startswith("…") and html.endswith("…")
    assert snippets(text, parse("absent")) == []


def test_registered_phrase_prefix_has_no_cap(spark, tmp_path):
    """More words begin with the prefix than MOST_EXPANSIONS; every one counts."""
    docs = spark.range(1200).select(F.col("id").alias("doc_id"), F.concat(F.lit("word of thea"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, "click")], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    assert catalog_queries.search_phrase_prefix(spark, str(tmp_path)).count() == 1200


def test_unicode_postings_go_in_small_parts(spark, monkeypatch):
    """No array of a whole batch's words: the parts that workers hand over are bounded, and hold every word in place."""
    from lodestack.operators import index

    monkeypatch.setattr(index, "PART", 3, raising=False)
    docs = spark.createDataFrame([(1, "a B", "Straße x's 3.5 ﬁne e\u0301"), (2, None, None), (3, "", "w " * 10)], "id long, title string, text string").coalesce(1)
    got = build_postings(docs)
    assert "MapInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    want = {(i, f, *t[:1], n, *t[1:]) for i, *texts in docs.collect() for f, text in zip(("title", "text"), texts, strict=True) for n, t in enumerate(analyze(text))}
    assert {(r.id, r.field, r.term, r.pos, r.begin, r.end) for r in got.collect()} == want and got.count() == len(want)
    assert got.columns == build_postings(docs, analyzer="simple").columns
