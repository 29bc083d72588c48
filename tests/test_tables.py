"""Selections, facets, changes, sources, sinks, vectors and clustering."""

import io
import json
import re
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack import catalog, plugins
from lodestack.functions import ids
from lodestack.functions.text import clean_metadata, metadata_value, parse_schema, textify, textify_bytes, truncated, weighted_terms
from lodestack.operators import cluster, components, facets, lookups, mutate, selection, sorting, vectors
from lodestack.operators.index import build_postings
from lodestack.operators.selection import Corpus, SelectionCache, SelectionRequest, filtered, select
from lodestack.sinks import export
from lodestack.sources import blobs, cloud, csv_documents, files, steps
from lodestack.streaming import ingest


@pytest.fixture(scope="module")
def corpus(spark):
    docs = spark.createDataFrame(
        [(1, "b", "2", None, "one fox", '{"year": "10", "odd": {"a": 1}}'), (2, "a", "1", None, "two foxes 555", '{"year": "9"}'), (3, None, "3", None, "none", "{}"), (4, "b", "2", 1, "fox 555", None)],
        "id long, title string, supplied_id string, page_number int, text string, metadata_json string",
    )
    tags = spark.createDataFrame([(1, 10), (2, 10), (2, 20)], "document_id long, tag_id long")
    nodes = spark.createDataFrame([(1, 7), (3, 7), (3, 8)], "document_id long, node_id long")
    objects = spark.createDataFrame([(4, 5), (1, 5), (2, 6)], "document_id long, store_object_id long")
    return Corpus(docs, build_postings(docs, ["year"]), tags, nodes, objects, ("year",))


def found(corpus, warnings=None, **request):
    return sorted(r.id for r in filtered(corpus, SelectionRequest(**request), [] if warnings is None else warnings).select("id").collect())


@pytest.mark.parametrize(
    "tag_ids, tagged, operation, want",
    [
        ((10,), None, "any", [1, 2]), ((10, 20), None, "any", [1, 2]), ((10, 20), None, "all", [2]), ((10, 20), None, "none", [3, 4]), ((), False, "any", [3, 4]), ((), True, "any", [1, 2]), ((20,), False, "any", [2, 3, 4]),
        ((20,), True, "any", [1, 2]), ((10,), True, "all", [1, 2]), ((10,), False, "all", []), ((20,), True, "none", [3, 4]), ((20,), False, "none", [1]), ((99,), None, "any", []), ((), True, "none", [3, 4]),
    ],
)
def test_tags(corpus, tag_ids, tagged, operation, want):
    assert found(corpus, tag_ids=tag_ids, tagged=tagged, tag_operation=operation) == want


def test_other_filters(corpus):
    assert found(corpus, node_ids=(7,)) == [1, 3] and found(corpus, node_ids=(7, 8), q="none") == [3]
    assert found(corpus, store_object_ids=(5,)) == [1, 4] and found(corpus, document_ids=(2, 3, 77)) == [2, 3]
    assert found(corpus, bitset="oA") == [2] and ids.bits_to_numbers("oA") == [0, 2] and ids.bits_to_numbers("!!") is None
    assert found(corpus, bitset=ids.numbers_to_bits([1, 4])) == [1, 4] and found(corpus, bitset="!!") == [1, 2, 3, 4]
    assert found(corpus, q="text:/[0-9]{3}/") == [2, 4] and found(corpus, q="not /555/ and fox*") == [1]
    plugins.register_filter("odd", lambda s, i, op: s.createDataFrame([(1,), (3,)], "id long"))
    plugins.register_filter("broken", lambda s, i, op: 1 / 0)
    warnings = []
    assert found(corpus, warnings, view_filters=(("odd", (), "any"), ("broken", (), "any"))) == [1, 3]
    assert [w.kind for w in warnings] == ["ViewFilterError"]


def test_order_and_pages(corpus):
    rows = lambda s: [r.id for r in s.rows.orderBy("pos").collect()]
    all_ = select(corpus, SelectionRequest())
    assert rows(all_) == [2, 4, 1, 3] and [r.id for r in all_.page(1, 2).orderBy("pos").collect()] == [4, 1]
    assert [r.id for r in all_.page(0, 3, reverse=True).orderBy("pos").collect()] == [3, 1, 4]
    assert all_.page(9, 5, reverse=True).count() == 0 and all_.page(0, 0).count() == 1
    by_year = select(corpus, SelectionRequest(sort_field="year"))
    assert rows(by_year) == [4, 3, 1, 2]  # empty first, then by collation of text
    assert select(corpus, SelectionRequest(sort_field="odd", q="what:x")).warnings[0].kind == "MissingField"
    few = select(corpus, SelectionRequest(q="text:/555/"), regex_limit=1)
    assert rows(few) == [2] and few.warnings[-1].kind == "RegexLimited"


def test_cache(corpus):
    clock = [0.0]
    cache = SelectionCache(10, lambda: clock[0])
    a = cache.find_or_create(corpus, SelectionRequest(q="fox"))
    assert cache.find_or_create(corpus, SelectionRequest(q="fox")) is a
    assert cache.find_or_create(corpus, SelectionRequest(q="fox"), refresh=True) is not a
    clock[0] = 11
    assert cache.find_or_create(corpus, SelectionRequest(q="fox")) is not a and len(cache.held) == 1


def test_projection(corpus):
    assert selection.parse_fields("title,nonsense,text") == ("id", "title", "text") and selection.parse_fields("x") == selection.DEFAULT_FIELDS
    docs = corpus.documents.withColumns({"url": F.lit("local://f/x"), "file2_id": F.lit(3).cast("long")})
    assert docs.select(selection.view_url(docs)).first()[0] == "/localfiles/f/x"
    assert docs.withColumn("url", F.lit(None).cast("string")).filter("id = 2").select(selection.view_url(docs.withColumn("url", F.lit(None).cast("string")))).first()[0] == "/documents/2.pdf"
    assert selection.projected(docs, ("id", "suppliedId")).columns == ["id", "suppliedId"]


def test_facets(spark, corpus):
    two = corpus.documents.filter("id <= 2")
    assert {r.tag_id: r.n for r in facets.tag_counts(corpus.document_tag, two).collect()} == {10: 2, 20: 1}
    tag = spark.createDataFrame([(10, "x", "c"), (30, "z", "c")], "id long, name string, color string")
    assert {r.id: r.n for r in facets.all_tag_counts(tag, corpus.document_tag).collect()} == {10: 2, 30: 0}
    assert {r.id: r["values"] for r in facets.lists_per_document(corpus.document_tag, "tag_id", corpus.documents, True).collect()} == {1: [10], 2: [10, 20], 3: [], 4: []}
    assert facets.tag_counts(corpus.document_tag, two.limit(0)).count() == 0
    one = spark.createDataFrame([(1,)], "document_set_id long")
    assert facets.views_and_trees(one, one).first().n == 2 and facets.views_and_trees(one, one, literal=True).first().n == 1
    assert tuple(facets.totals(one.limit(0), s="document_set_id").first()) == (0, 0)


def test_changes(spark, corpus):
    tagged = mutate.tag_selection(corpus.document_tag, corpus.documents.filter("id in (1, 3)"), 10)
    assert sorted(map(tuple, tagged.collect())) == [(1, 10), (2, 10), (2, 20), (3, 10)]
    assert sorted(map(tuple, mutate.untag_selection(tagged, corpus.documents, 10).collect())) == [(2, 20)]
    objects = spark.createDataFrame([(5, 1), (6, 2)], "id long, store_id long")
    new = spark.createDataFrame([(3, 5), (3, 6), (99, 5)], "document_id long, store_object_id long")
    after = mutate.upsert_links(corpus.document_store_object, new, objects, 1, corpus.documents)
    assert sorted(map(tuple, after.select("document_id", "store_object_id").collect())) == [(1, 5), (2, 6), (3, 5), (4, 5)]
    edited = mutate.edit(corpus.documents, spark.createDataFrame([(1, "new", None)], "id long, title string, text string"))
    assert edited.filter("id = 1").select("title", "text").first() == ("new", "one fox")
    assert mutate.java_hash("foo") == 101574 and mutate.tag_color("a") in mutate.PALETTE and len(set(mutate.PALETTE)) == 23
    existing = spark.createDataFrame([((5 << 32) + 3, 5)], "id long, document_set_id long")
    numbered = mutate.next_numbers(spark.createDataFrame([("b",), ("a",)], "x string"), existing, 5, [F.col("x")])
    assert {r.x: r.id for r in numbered.collect()} == {"a": (5 << 32) + 4, "b": (5 << 32) + 5}
    tables = {"documents": corpus.documents.withColumn("document_set_id", F.lit(0)), "tag": spark.createDataFrame([(10, "x", 0), (20, "y", 0)], "id long, name string, document_set_id long"), "document_tag": corpus.document_tag}
    cloned = mutate.clone(tables, 9, 100)
    assert sorted(map(tuple, cloned["document_tag"].select("document_id", "tag_id").collect())) == [((9 << 32) + 1, 100), ((9 << 32) + 2, 100), ((9 << 32) + 2, 101)]
    left = mutate.delete_set(tables, 0)
    assert left["documents"].count() == 0 and left["document_tag"].count() == 0
    shared = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "file_id long, document_set_id long")
    assert [r.file_id for r in mutate.unshared_files(shared, 1).collect()] == [2]


def test_store_state_and_objects(spark):
    state = mutate.put_state(mutate.put_state(spark.createDataFrame([], "key string, value string"), "a", "1"), "a", "2")
    assert mutate.get_state(state, "a") == "2" and mutate.get_state(state, "b") == "{}" and state.count() == 1
    objects = spark.createDataFrame([(1, 1, "x"), (2, 2, "y")], "id long, store_id long, json string")
    new = mutate.upsert_objects(objects, spark.createDataFrame([(1, "new"), (2, "theirs"), (3, "z")], "id long, json string"), 1)
    assert sorted(map(tuple, new.select("id", "store_id", "json").collect())) == [(1, 1, "new"), (2, 2, "y"), (3, 1, "z")]
    left, links = mutate.delete_objects(new, spark.createDataFrame([(9, 1), (9, 2)], "document_id long, store_object_id long"), [1, 2], 1)
    assert sorted(r.id for r in left.collect()) == [2, 3] and [r.store_object_id for r in links.collect()] == [2]


def test_text_and_metadata(spark):
    row = spark.createDataFrame([("a\r\nb\rc\x85d\x00e\tf\u0378g", '{"s": "x", "n": 1.5, "o": {"k": [1]}, "z": null}')], "t string, m string")
    r = row.select(textify(F.col("t")).alias("t"), clean_metadata(F.col("m"), ["s", "n", "o", "z", "q"]).alias("c"), metadata_value(F.col("m"), "n").alias("n"), sorting.scalar_metadata(F.col("m"), "o").alias("o")).first()
    assert r.t == "a\nb\nc\nd e\tfg" and json.loads(r.c) == {"s": "x", "n": "1.5", "o": '{"k":[1]}', "z": "", "q": ""} and r.n == "1.5" and r.o == ""
    assert parse_schema('{"version": 1, "fields": [{"name": "a"}]}')[0]["display"] == "TextInput"
    with pytest.raises(ValueError):
        parse_schema('{"version": 2}')
    lexed = spark.sql("select array('The', 'AN', 'Alpha', '12ab', '1a2bcdefg', 'KEYword') t").select(weighted_terms(F.col("t"), ["the"], {"KEY": 5.0, "word": 2.0}).alias("w")).first().w
    assert [(x.term, x.weight) for x in lexed] == [("alpha", 1.0), ("1a2bcdefg", 1.0), ("KEYword", 10.0)]
    assert ids.parse_ids("1,x22 99999999999999999999") == [1, 22]


@pytest.mark.parametrize(
    "text, rows, whole",
    [("a,b\r\n1,2\n", [["a", "b"], ["1", "2"]], True), ("\n\na\r\r", [["a"]], True), ('"x""y",z', [['x"y', "z"]], True), ('"a\nb",c', [["a\nb", "c"]], True), ('ab"c,d"e,f', [["abc,de", "f"]], True), (",", [["", ""]], True), ("a,", [["a", ""]], True), ('a,"b', [["a", "b"]], False), ('""x,y', [["x", "y"]], True)],
)
def test_csv_scanner(text, rows, whole):
    assert csv_documents.scan_csv(text) == (rows, whole)
    scanner = csv_documents.CsvScanner()
    for c in text:
        scanner.write(c)
    scanner.end()
    assert scanner.rows == rows


def test_csv_import(spark, tmp_path):
    (tmp_path / "x.csv").write_text('ID,Title,contents,Tags,Foo,foo2\n7,"T ""q""","line\nbreak","a, b,,a",1,2\n8,U,plain,,,\n', "utf-8")
    rows = csv_documents.to_documents(csv_documents.read_csv(spark, str(tmp_path / "x.csv")))
    by = {r.supplied_id: r for r in rows.collect()}
    assert by["7"].text == "line\nbreak" and by["7"].title == 'T "q"' and by["7"].tags == ["a", "b"] and json.loads(by["8"].metadata_json) == {"Foo": "", "foo2": ""}
    existing = spark.createDataFrame([((4 << 32) + 0, 4, "8")], "id long, document_set_id long, supplied_id string")
    tag = spark.createDataFrame([(3, "b", "c")], "id long, name string, color string")
    documents, tags, links = csv_documents.import_documents(rows, existing, tag, 4)
    assert [(r.id, r.supplied_id) for r in documents.collect()] == [((4 << 32) + 1, "7")]
    assert sorted(r.name for r in tags.collect()) == ["a", "b"] and sorted(r.tag_id for r in links.collect()) == [3, 4]
    lenient = csv_documents.read_csv_leniently(spark, str(tmp_path / "x.csv")).collect()
    assert len(lenient) == 2 and lenient[0].whole and lenient[0].row[0] == "7"


def test_cloud(spark):
    text = cloud.encode_ids([("1", "a", 3, "t", "p", "public")])
    df = spark.createDataFrame([(text,), ("1\u001fa",)], "e string")
    got = [r.d for r in df.select(cloud.decode_ids(F.col("e")).alias("d")).collect()]
    assert got[0][0].n_pages == 3 and got[1] is None
    pages = cloud.split_pages(spark.createDataFrame([("x", 3), ("y", 1), ("z", None)], "id string, n_pages int"))
    assert sorted((r.id, r.page_number or 0) for r in pages.collect()) == [("x", 1), ("x", 2), ("x", 3), ("y", 0), ("z", 0)]
    assert cloud.n_lists(0, 10) == 1 and list(cloud.remaining_lists(25, 10, 1)) == [1, 2]
    assert sorted((r.id, r.page_number) for r in cloud.not_there(pages, pages.filter("page_number = 2 or id = 'y'"), ["id", "page_number"]).filter("id = 'x'").collect()) == [("x", 1), ("x", 3)]


def make_files(folder):
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("deep.txt", "deep text")
        z.writestr("odd.bin", b"\x01\x02")
    with zipfile.ZipFile(folder / "outer.zip", "w") as z:
        z.writestr("inner.zip", inner.getvalue())
        z.writestr("page.html", "<html><head><title>t</title></head><body><p>Hi &amp; bye</p></body></html>")
    (folder / "note.txt").write_text("a\r\nnote")
    (folder / "mail.eml").write_text("From: a@b.c\nSubject: S\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=X\n\n--X\nContent-Type: text/plain\n\nBody\n--X\nContent-Type: text/plain\nContent-Disposition: attachment; filename=att.txt\n\nattached\n--X--\n")


def test_file_ingest(spark, tmp_path):
    make_files(tmp_path)
    processed = files.process(files.read_files(spark, str(tmp_path), '{"pageNumber": 4, "isFromOcr": "no"}')).persist()
    existing = spark.createDataFrame([], "id long, document_set_id long, supplied_id string")
    documents, errors = files.ingest(processed, existing, 2)
    texts = {r.title: r.text for r in documents.collect()}
    assert set(texts) == {"note.txt", "mail.eml", "att.txt", "page.html", "deep.txt"} and texts["note.txt"] == "a\nnote" and "Hi & bye" in texts["page.html"] and "Body" in texts["mail.eml"]
    assert {r.page_number for r in documents.collect()} == {4} and not any(r.is_from_ocr for r in documents.collect())
    messages = {r.text_url: r.message for r in errors.collect()}
    assert messages["odd.bin"] == "unhandled: application/octet-stream"
    again, _ = files.ingest(processed, documents.select("id", "document_set_id", "supplied_id"), 2)
    assert again.count() == 0
    done = {r.id.rsplit("/", 1)[-1]: (r.n_files, r.n_documents) for r in ingest.finished_trees(processed).collect()}
    assert done == {"outer.zip": (5, 2), "note.txt": (1, 1), "mail.eml": (2, 2)}


def test_streaming_ingest(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    make_files(source)
    for _ in range(2):  # the second run finds nothing new
        q = ingest.ingest_stream(ingest.watch_files(spark, str(source)), str(out), str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert spark.read.parquet(str(out)).filter("is_document").count() == 5


def test_exports(spark, corpus, tmp_path):
    tag = spark.createDataFrame([(10, "x"), (20, "y, z")], "id long, name string")
    docs = corpus.documents.withColumn("url", F.lit(None).cast("string"))
    rows = {r.text: r.tags for r in export.with_string_tags(docs, corpus.document_tag, tag, ["year"]).collect()}
    assert rows == {"one fox": "x", "two foxes 555": "x,y, z", "none": "", "fox 555": ""}
    wide = export.with_column_tags(docs, corpus.document_tag, tag).orderBy("text")
    assert [(r["x"], r["y, z"]) for r in wide.collect()] == [("", ""), ("", ""), ("1", ""), ("1", "1")]
    data = b"".join(export.csv_bytes(wide.limit(1)))
    assert data.startswith(b'\xef\xbb\xbfid,title,text,url,x,"y, z"\r\n') and data.endswith(b"\r\n")
    out = io.BytesIO()
    export.write_xlsx(wide, out)
    assert b"two foxes" in zipfile.ZipFile(out).read("xl/worksheets/sheet1.xml")
    out = io.BytesIO()
    assert export.write_zip([("é.txt", b"one"), ("é.txt", b"two"), ("b", b"")], out) == 2
    assert len(out.getvalue()) == export.zip_size([("é.txt", 3), ("b", 0)]) and zipfile.ZipFile(out).read("é.txt") == b"one"
    assert export.archive_name("a\\b:c.docx", 5, "pdf", 2) == "a/b_c-p2.pdf" and export.archive_name("", 5, "txt") == "5.txt"
    assert len(json.loads("".join(export.json_documents(docs, ["id", "title"])))) == 4 and json.loads(export.json_ids(docs.limit(0))) == []
    same = docs.withColumn("title", F.lit("same.doc"))
    assert [(r.id, r.name) for r in export.archive_entries(same.drop("page_number")).collect()] == [(1, "same.txt")]


def test_lookups(spark):
    file2 = spark.createDataFrame([(1, None, None, 2, 0, "root", b"\x01"), (2, 1, 1, 0, 0, "p1", b"\x02"), (3, 1, 1, 0, 1, "p2", b"\x02")], "id long, root_id long, parent_id long, n_children int, index_in_parent int, filename string, sha1 binary")
    docs = spark.createDataFrame([(10, 2), (11, 3), (12, 1)], "id long, file2_id long")
    assert sorted(map(tuple, lookups.page_infos(docs, file2).collect())) == [(10, 1, 2), (11, 2, 2)]
    assert {r.id: r.root_filename for r in lookups.roots(file2).collect()} == {1: "root", 2: "root", 3: "root"}
    assert lookups.with_sha1(file2, "02").count() == 2 and lookups.file_exists(file2, spark.createDataFrame([(1,)], "id long")).count() == 3
    page = spark.createDataFrame([(0, 11), (1, 99), (2, 10)], "pos long, id long")
    assert [r.file2_id for r in lookups.in_page_order(page, docs).collect()] == [3, None, 2]


def long_vectors(spark, x):
    return spark.createDataFrame([(i, f"t{j}", float(w)) for i, row in enumerate(x) for j, w in enumerate(row) if w], "id long, term string, weight double")


def grouped(n_groups=3, each=12, seed=2):
    rng = np.random.default_rng(seed)
    x = np.abs(rng.normal(0, 0.05, (n_groups * each, 12)))
    for i in range(len(x)):
        x[i, 3 * (i % n_groups) : 3 * (i % n_groups) + 3] += 1
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sparse(x):
    i, j = np.nonzero(x)
    return cluster.Rows(np.arange(len(x)), i, j, x[i, j], x.shape[1])


def test_vectors(spark):
    docs = spark.createDataFrame([(i, ["alpha", "beta", *(["gamma"] if i < 4 else ["delta"]), f"only{i}", "all"]) for i in range(8)], "id long, w array<string>")
    lexed = docs.select("id", F.transform("w", lambda t: F.struct(t.alias("term"), F.lit(1.0).alias("weight"))).alias("terms"))
    v = vectors.vectors(vectors.term_frequencies(lexed), 8)
    assert {r.term for r in v.collect()} <= {"gamma", "delta", "beta gamma", "beta delta", "gamma all"} and v.groupBy("id").agg(F.round(F.sum(F.col("weight") ** 2), 9).alias("n")).select("n").distinct().collect()[0].n == 1
    with pytest.raises(ValueError):
        vectors.vectors(vectors.term_frequencies(lexed), 1)
    assert vectors.empty_documents(docs, v.filter("id > 2")).count() == 3
    words = {r.id: r.keywords for r in vectors.keywords(v).collect()}
    assert len(words) == 8 and all(w for w in words.values())


def test_similar_pairs_and_components(spark):
    x = grouped()
    v = long_vectors(spark, x)
    dots = x @ x.T
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if dots[i, j] >= 0.5}
    got = vectors.similar_pairs(v, 0.5)
    assert {(r.a, r.b) for r in got.collect()} == want
    comps = {r.id: r.component for r in components.connected_components(v.select("id").distinct(), got).collect()}
    assert comps == {i: i % 3 for i in range(len(x))}
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {r.component for r in components.connected_components(spark.range(42), chain).collect()} == {0, 41}
    tree = {(r.document_id, r.level): r.component for r in cluster.threshold_tree(v, spark.range(len(x) + 1), (0.8, 0.1)).collect()}
    assert tree[len(x), 0] == 0 and (len(x), 1) not in tree and {tree[i, 1] for i in range(len(x))} == {0, 1, 2}
    assert (cluster.components_in_memory(sparse(x), 0.5) == np.arange(len(x)) % 3).all()


def test_no_similar_pair_is_left_out(spark, monkeypatch):
    """600 equal documents are one component; all pairs are found, also of terms dealt in blocks and at low cosines."""
    equal = spark.range(600).select("id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("term"), F.lit(0.5**0.5).alias("weight"))
    assert vectors.similar_pairs(equal, 0.5).count() == 600 * 599 // 2
    assert {(r.level, r.component) for r in cluster.threshold_tree(equal, spark.range(600), (0.5,)).collect()} == {(0, 0), (1, 0)}
    monkeypatch.setattr(vectors, "BLOCK", 7)
    rng = np.random.default_rng(3)
    x = rng.random((60, 30)) * (rng.random((60, 30)) < 0.2) + 1e-3 * np.eye(60, 30)
    x = np.vstack([x, x[:20]]) / np.linalg.norm(np.vstack([x, x[:20]]), axis=1, keepdims=True)
    x = x[np.isfinite(x).all(axis=1)]
    dots, v = x @ x.T, long_vectors(spark, x)
    for least in (0.1, 0.3, 0.7):
        want = {(i, j): dots[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if dots[i, j] >= least}
        got = vectors.similar_pairs(v, least).collect()
        assert len(got) == len(want) and all(want[r.a, r.b] == pytest.approx(r.cosine) for r in got)
        ids = v.select("id").distinct()
        links, pairs = (components.connected_components(ids, f(v, least)) for f in (vectors.similar_links, vectors.similar_pairs))
        assert {tuple(r) for r in links.collect()} == {tuple(r) for r in pairs.collect()}


def test_vector_queries_cover_the_documents(spark, tmp_path):
    """Each query over documents, against brute force; there is no other table in the folder."""
    words = [f"word{chr(97 + i)}" for i in range(12)]
    texts = [" ".join(words[(i * k + k) % 12] for k in range(1, 6)) for i in range(24)] + [""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.Q[name](spark, str(tmp_path)).collect()
    x = {}
    for r in run("tfidf_vectors"):
        x.setdefault(r.id, {})[r.term] = r.weight
    dot = lambda a, b: sum(w * x[b].get(t, 0) for t, w in x[a].items())
    want = {(a, b): dot(a, b) for a in x for b in x if a < b and dot(a, b) >= 0.1}
    got = {(r.a, r.b): r.cosine for r in run("cosine_pairs")}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-4 for p in want) and set(x) <= set(range(24))
    assert {r.id for r in run("k_means_clusters")} == set(x)
    found = run("threshold_components")
    assert {r.document_id for r in found if r.level == 0} == set(range(25)) and {r.document_id for r in found if r.level == 1} == set(x)
    assert {r["size"] for r in run("cluster_tree") if r.level == 0} == {25}


def test_clustering(spark):
    x = grouped()
    v = long_vectors(spark, x)
    labels = cluster.grow_k_means(sparse(x), 5)
    assert all(len(set(labels[i::3])) == 1 for i in range(3)) and len(set(labels)) == 3
    found = {r.id: r.cluster for r in cluster.k_means(v, 3).collect()}
    assert len(found) == len(x)
    assert cluster.distortions(v, cluster.k_means(v, 3)).filter("distortion < 0").count() == 0
    docs = spark.range(len(x) + 1)
    for kind in ("components", "k_means", "hybrid"):
        node, bridge = cluster.document_tree(v, docs, kind)
        nodes = {r.id: r for r in node.collect()}
        of = {}
        for r in bridge.collect():
            of.setdefault(r.node_id, set()).add(r.document_id)
        assert of[0] == set(range(len(x) + 1)) and {i: len(s) for i, s in of.items()} == {i: n["size"] for i, n in nodes.items()}
        for i, n in nodes.items():
            children = [c for c, m in nodes.items() if m.parent_id == i]
            assert n.is_leaf == (not children) and n.level <= 10 and len(children) <= 6
            if children:
                assert sum(len(of[c]) for c in children) == len(of[i]) and set().union(*(of[c] for c in children)) == of[i]
                assert all(c > i for c in children)
    labels = {r.node_id: r.description for r in cluster.node_labels(bridge, v).collect()}
    assert set(labels) == set(of) and labels[0].startswith("MOST: ") or "ALL: " in labels[0] or "SOME: " in labels[0]
    assert cluster.tree_levels(node, 0, 1).count() == 1 + sum(n.parent_id == 0 for n in nodes.values())
    assert cluster.ordered_children(node, bridge).count() == len(nodes)


def test_a_node_is_split_alike_in_a_task_and_by_jobs(spark, monkeypatch):
    """The tree is the same whether its nodes fit one task or not, and draws are Spark's hashes."""
    ids_ = np.array([0, 1, -5, 2**40, 7])
    want = [r.h for r in spark.createDataFrame([(int(i),) for i in ids_], "id long").select(F.shiftrightunsigned(F.xxhash64(F.col("id") * 31 + 3), 12).alias("h")).collect()]
    assert np.allclose(cluster._draws(ids_, 3), (np.array(want, float) + 0.5) / 2.0**52)
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 0.3, (36, 8)))
    for i in range(len(x)):
        x[i, [0, 0, 0, 2, 4, 6][i % 6]] += 1 + (i % 3) / 4
    x = x * (rng.random(x.shape) < 0.7) + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = long_vectors(spark, x)
    assert sorted((r.id, r.cluster) for r in cluster.grow_k_means_jobs(v, 4).collect()) == list(enumerate(cluster.grow_k_means(sparse(x), 4).tolist()))
    for least in (0.5, 0.9):
        got = sorted((r.id, r.cluster) for r in cluster.split_node_jobs(v, least_cosine=least).collect())
        alone = cluster.split_node(sparse(x), least_cosine=least).tolist()
        names = dict(zip([c for _, c in got], alone, strict=True))  # the same parts
        assert [names[c] for _, c in got] == alone and len(set(names.values())) == len(names)


def test_collector_of_converter_parts():
    head = lambda i, **h: steps.named_part(f"{i}.json", json.dumps(h).encode())
    part = steps.named_part
    good = [head(0, filename="a", contentType="text/plain"), part("0.blob", b"x"), part("0.txt", b"hi"), part("progress", b"0.5"), head(1, filename="b", contentType="application/pdf", wantOcr=False), part("1.blob", b"y"), part("1-thumbnail.png", b"t"), part("done")]
    c = steps.collected(good)
    assert [x.blob for x in c.children] == [b"x", b"y"] and c.children[0].text == "hi" and c.error is None and c.progress == 1.0
    assert [x.processed() for x in c.children] == [False, True]
    again = steps.collected([*good[:6], *good])  # a second run from its start
    assert [x.blob for x in again.children] == [b"x", b"y"] and again.error is None
    late = steps.collected([*good, part("error", b"late"), head(2)])
    assert late.error is None and len(late.children) == 2
    assert steps.collected([head(0), part("done")]).error.startswith("logic error in converter: tried to write child without blob")
    assert steps.collected([part("0.blob", b"x")]).error.startswith("logic error")
    gap = steps.collected([head(0), part("0.blob"), head(2)])
    assert gap.error and gap.children == []
    assert steps.collected([head(0), part("0.inherit-blob"), head(1), part("1.inherit-blob")]).error.startswith("logic error")
    failed = steps.collected([head(0), part("0.blob", b"x"), head(1), part("error", b"broken")])
    assert failed.error == "broken" and len(failed.children) == 1
    assert steps.collected(good[:3]).error.startswith("logic error") and steps.named_part("x.blob") is None
    kids = steps.as_children(steps.collected([head(0, filename="p", metadata={"k": 1}), part("0.inherit-blob"), part("done")]), {"content": b"whole", "metadata_json": "{}"})
    assert kids[0]["content"] == b"whole" and json.loads(kids[0]["metadata_json"]) == {"k": 1}


def test_routes_and_task_payload():
    assert [steps.route("application/pdf"), steps.route("application/pdf", want_ocr=True), steps.route("text/x-log"), steps.route("image/png"), steps.route("image/png", known=["image/png"]), steps.route("text/plain", canceled=True)] == ["Pdf", "PdfOcr", "Text", "Unhandled", "image/png", "Canceled"]
    payload = steps.task_payload({"id": 3, "filename": "a.pdf", "content_type": "application/pdf", "metadata_json": '{"x": "y"}', "n_bytes": 5, "sha1": "00"}, "http://host/3")
    assert payload["blob"] == {"url": "http://host/3/blob", "nBytes": 5, "sha1": "00"} and payload["wantOcr"] and payload["metadata"] == {"x": "y"}


def test_blobs(spark, tmp_path):
    path = blobs.blob_path("file:things:a/b", {"file": str(tmp_path)})
    assert path == f"{tmp_path}/things/a/b"
    data = bytes(range(256)) * 9000
    assert blobs.create_blob(spark, path, b"old") == 3 and blobs.create_blob(spark, path, data) == len(data)
    assert b"".join(blobs.stream_blob(spark, path)) == data and blobs.get_bytes(spark, path, 5) == data[:5]
    row = blobs.read_blobs(spark, path).select("length", blobs.first_bytes(F.col("content"), 4).alias("first")).first()
    assert row.length == len(data) and bytes(row.first) == data[:4]
    with blobs.blob_in_file(spark, path) as name, open(name, "rb") as f:
        assert f.read() == data
    blobs.delete_blobs(spark, [path, path])
    with pytest.raises(Exception):
        blobs.get_bytes(spark, path, 1)
    for bad in ("ftp:a:b", "file::b", "file:a:../b"):
        with pytest.raises(ValueError):
            blobs.blob_path(bad, {"file": "/"})
    assert blobs.blob_url("https://x/y") and blobs.blob_url("/x") is None


def test_truncated_by_utf16_units(spark):
    texts = ["abc", "🎉" * 10, "ab🎉cd", "a🎉🎉🎉b", "é" * 6, "", None, "🎉a" * 5]

    def want(t, n):
        return None if t is None else t.encode("utf-16-le")[: 2 * n].decode("utf-16-le", "ignore")

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3, 4, 5, 6, 9):
        assert [r.x for r in df.select(truncated(F.col("t"), n).alias("x")).collect()] == [want(t, n) for t in texts]


def test_bytes_are_decoded_with_replacement(spark):
    data = [b"plain", "é🎉".encode(), b"a\xffb\xc3", b"\xe9t\xe9", None]
    df = spark.createDataFrame([(d,) for d in data], "d binary")
    for charset in ("utf-8", "latin-1", "cp1252"):
        got = [r.x for r in df.select(textify_bytes(F.col("d"), charset).alias("x")).collect()]
        assert got == [None if d is None else re.sub("[\x7f-\x9f]", " ", d.decode(charset, "replace")) for d in data]


def test_csv_keeps_the_files_order_and_names_broken_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('title,text,tags\nz,"one, ""two""","x,y"\nb,t\n\na,last,y\n', "utf-8")
    rows = csv_documents.read_csv_leniently(spark, str(tmp_path))
    assert csv_documents.import_errors(rows, 3).count() == 0
    existing = spark.createDataFrame([], "id long, document_set_id long, supplied_id string")
    tag = spark.createDataFrame([(4, "y", "ffffff")], "id long, name string, color string")
    new, tags, links = csv_documents.import_documents(csv_documents.to_documents(csv_documents.named_rows(rows)), existing, tag, 3)
    got = {r.id: (r.title, r.text) for r in new.collect()}
    assert got == {(3 << 32): ("z", 'one, "two"'), (3 << 32) + 1: ("b", "t"), (3 << 32) + 2: ("a", "last")}
    assert {(r.id, r.name) for r in tags.collect()} == {(4, "y"), (5, "x")} and sorted(tuple(r) for r in links.collect()) == [(3 << 32, 4), (3 << 32, 5), ((3 << 32) + 2, 4)]
    (tmp_path / "a.csv").write_text('title,text\nz,"open', "utf-8")
    assert csv_documents.import_errors(csv_documents.read_csv_leniently(spark, str(tmp_path)), 3).first().text_url.endswith("a.csv")


def test_dictionary_and_expansions(spark, corpus):
    from lodestack.operators.index import document_dictionary, unindexed_fields
    from lodestack.plans.compile import IndexSearch
    from lodestack.plans.parser import parse

    words_ = document_dictionary(corpus.documents, ["year"], "unicode")
    assert {tuple(r) for r in words_.filter("field = 'text'").collect()} >= {("text", "fox", 2), ("text", "555", 2), ("text", "none", 1)}
    for q in ("text:foxs~1", "one fo*", "fo*", "foxx~"):
        with_, without = (sorted(r.id for r in IndexSearch(corpus.postings, corpus.documents.select("id"), most_expansions=most, dictionary=d).search(parse(q)).collect()) for most, d in ((1000, words_), (None, None)))
        assert with_ == without and with_
    assert unindexed_fields([str(i) for i in range(103)]) == ["100", "101", "102"]


def test_caches(spark, corpus):
    clock = [0.0]
    cache = SelectionCache(10.0, lambda: clock[0])
    first = cache.find_or_create(corpus, SelectionRequest(q="fox"))
    assert cache.find(SelectionRequest(q="fox").key()) is first and cache.find("nothing") is None
    clock[0] = 11.0
    assert cache.find(SelectionRequest(q="fox").key()) is None and cache.find_or_create(corpus, SelectionRequest(q="fox")) is not first
    sorts = selection.SortCache()
    whole = Corpus(corpus.documents.withColumn("document_set_id", F.lit(0).cast("long")), None)
    kept = sorts.positions(whole, 0, "year")
    assert sorts.positions(whole, 0, "year") is kept and [r.id for r in kept.orderBy("pos").collect()] == [4, 3, 1, 2]
    sorts.changed(0)
    assert sorts.positions(whole, 0, "year") is not kept


def test_edits(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "id long, title string, url string")
    changes = spark.createDataFrame([(1, None, "new"), (3, "t", None)], "id long, title string, url string")
    assert sorted((tuple(r) for r in mutate.edit(docs, changes).collect()), key=str) == [(1, "a", "new"), (2, "b", "y"), (3, "t", "z")]
    assert sorted((tuple(r) for r in mutate.edit(docs, changes, write_nulls=True).collect()), key=str) == [(1, None, "new"), (2, "b", "y"), (3, "t", None)]


def test_positions_survive_a_second_reading(spark):
    df = spark.range(5000).select((F.col("id") * 37 % 5000).alias("id")).repartition(7)
    placed = sorting.positioned(df, [F.col("id")])
    assert placed.filter("id <> pos").count() == 0 and placed.count() == 5000


def test_csv_preview():
    header, rows = csv_documents.preview_csv('\ufeffid,text\u00851,"a\u0085b"\r\n\n2\n3,"cut off')
    assert header == ["id", "text"] and rows == [{"id": "1", "text": "a\u0085b"}, {"id": "2", "text": ""}, {"id": "3", "text": "cut off"}]
    with pytest.raises(ValueError):
        csv_documents.preview_csv("\n\n")


def test_fetch_takes_only_200_and_sends_no_credentials_on(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            seen.append((self.path, self.headers.get("Authorization")))
            status = {"/moved": 302, "/gone": 404, "/twice": 302}.get(self.path, 200)
            self.send_response(status)
            if status == 302:
                self.send_header("Location", f"http://127.0.0.1:{port}/" + ("moved" if self.path == "/twice" else "there"))
            self.end_headers()
            self.wfile.write("té".encode() if status == 200 else b"")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    port = server.server_port
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = spark.createDataFrame([(n, a, f"http://127.0.0.1:{port}/{p}") for n, a, p in (("1", "private", "moved"), ("2", "public", "there"), ("3", "public", "gone"), ("4", "public", "twice"))] + [("5", "public", "nonsense")], "id string, access string, text_url string")
        got = {r.id: (r.text, r.error is None) for r in cloud.fetch_texts(rows, ("user", "secret")).collect()}
    finally:
        server.shutdown()
    assert got == {"1": ("té", True), "2": ("té", True), "3": (None, False), "4": (None, False), "5": (None, False)}
    assert {p for p, a in seen if a} == {"/moved"}


def test_sets_of_uploads(spark):
    sets = spark.createDataFrame([(1, "old", None)], "id long, title string, metadata_schema string")
    out = mutate.finish_upload(sets, 2, "new", '{"b": 1, "a": "x"}')
    assert [f["name"] for f in parse_schema(out.filter("id = 2").first().metadata_schema)] == ["b", "a"]
    changed = mutate.update_schema(out, 1, '{"version": 1, "fields": []}')
    assert changed.filter("id = 1").first().metadata_schema == '{"version": 1, "fields": []}' and changed.filter("id = 2").first().metadata_schema
    with pytest.raises(ValueError):
        mutate.update_schema(out, 1, '{"version": 2}')


def test_sampled_links(spark):
    x = grouped(3, 8)
    v = long_vectors(spark, x)
    want = set()
    for edges, least in ((4, 0.5), (500, 0.5)):
        want = set()
        for a in range(len(x)):
            product = (x[a] * x).max(axis=1)
            best = [b for b in sorted(range(len(x)), key=lambda b: (-product[b], b)) if b != a][:edges]
            want |= {(min(a, b), max(a, b)) for b in best if x[a] @ x[b] >= least}
        assert {(r.a, r.b) for r in vectors.sampled_links(v, edges, least).collect()} == want


def test_tree_of_components(spark):
    x = grouped()
    v, docs = long_vectors(spark, x), spark.range(len(x) + 2)
    node, bridge = cluster.build_tree(v, docs, "ConnectedComponents")
    of = {}
    for r in bridge.collect():
        of.setdefault(r.node_id, set()).add(r.document_id)
    nodes = {r.id: r for r in node.collect()}
    root = [n for n in nodes.values() if n.parent_id is None]
    assert len(root) == 1 and of[root[0].id] == set(range(len(x) + 2)) and set(of) == set(nodes)
    assert {frozenset(of[i]) for i, n in nodes.items() if n.parent_id == root[0].id} == {frozenset(range(k, len(x), 3)) for k in range(3)}
    for i, n in nodes.items():
        assert n["size"] == len(of[i]) and n.is_leaf == (i not in {m.parent_id for m in nodes.values()})
        if n.parent_id is not None:
            assert of[i] < of[n.parent_id]
    assert cluster.build_tree(v, docs, "KMeans")[0].filter("parent_id is null").count() == 1


def test_a_csv_text_is_scanned_by_pieces_as_by_characters():
    rng = np.random.default_rng(2)
    for n in range(4000):
        text = "".join(rng.choice(list('""",,\n\r\nab é'), n % 40))
        scanner = csv_documents.CsvScanner()
        scanner.write(text)
        whole = scanner.end()
        assert csv_documents.scan_csv(text) == (scanner.rows, whole), repr(text)


def test_one_large_csv_file_is_read_by_blocks(spark, tmp_path, monkeypatch):
    """The same rows as of the whole file, though records lie across blocks and one fills several."""
    rng = np.random.default_rng(4)
    fields = ["".join(rng.choice(list('"",\n\rab é'), n % 23)) for n in range(300)]
    fields[100] = 'long, "' + "x\n" * 900
    data = ("\ufeffid,text\r\n" + "".join(export.csv_line([i, f]) for i, f in enumerate(fields))).encode() + b'bad\xff,"open\n'
    (tmp_path / "a.csv").write_bytes(data)
    (tmp_path / "b.csv").write_text("id,text\n1,small\n", "utf-8")
    want = sorted(map(tuple, csv_documents.read_csv_leniently(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(csv_documents, "MOST_WHOLE", 100)
    monkeypatch.setattr(csv_documents, "PART", 50)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300b")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = csv_documents.read_csv_leniently(spark, str(tmp_path))
        assert found.filter("path like '%a.csv'").rdd.getNumPartitions() > 5
        assert sorted(map(tuple, found.collect())) == want
        assert csv_documents.named_rows(found.filter("path like '%a.csv'")).columns == ["__order", "id", "text"]
    finally:
        for name in ("maxPartitionBytes", "openCostInBytes"):
            spark.conf.unset(f"spark.sql.files.{name}")


def test_a_blob_is_written_from_parts(spark, tmp_path):
    """A stream's parts are never joined, and JSON arrays are read by lines."""
    path = f"{tmp_path}/x"
    assert blobs.create_blob(spark, path, (bytes([i]) * 300_000 for i in range(9))) == 2_700_000
    assert (tmp_path / "x").read_bytes() == b"".join(bytes([i]) * 300_000 for i in range(9))
    assert blobs.create_blob(spark, path, iter(())) == 0 and (tmp_path / "x").read_bytes() == b""
    docs = spark.createDataFrame([(1, 'a,\n"b",'), (2, None), (3, "[]")], "id long, text string")
    for rows in (docs, docs.limit(0)):
        blobs.create_blob(spark, f"{tmp_path}/j/x.json", (part.encode() for part in export.json_documents(rows, ["id", "text"])))
        assert json.loads((tmp_path / "j/x.json").read_text("utf-8")) == [r.asDict() for r in rows.collect()]
        assert sorted(map(tuple, export.read_json_documents(spark, f"{tmp_path}/j", "id long, text string").collect())) == sorted(map(tuple, rows.collect()))


def test_pairs_are_multiplied_by_blocks(spark, monkeypatch):
    """Pairs of several blocks are all met once; links are few, and connect the same at every cosine."""
    rng = np.random.default_rng(8)
    x = rng.random((90, 40)) * (rng.random((90, 40)) < 0.3) + 1e-3
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    dots, v = x @ x.T, long_vectors(spark, x)
    for name, value in (("BLOCK_ENTRIES", 500), ("MOST_LINKS", 30), ("MOST_PAIRS", 20)):
        monkeypatch.setattr(vectors, name, value, raising=False)
    got = vectors.similar_pairs(v, 0.2).collect()
    want = {(i, j): dots[i, j] for i in range(90) for j in range(i + 1, 90) if dots[i, j] >= 0.2}
    assert len(got) == len(want) > 2000 and all(want[r.a, r.b] == pytest.approx(r.cosine) for r in got)
    links = vectors.similar_links(v, 0.2).cache()
    assert links.count() < len(want) / 2 and all(want[r.a, r.b] == pytest.approx(r.cosine) for r in links.collect())
    ids_ = v.select("id").distinct()
    pairs = spark.createDataFrame([(i, j, float(c)) for (i, j), c in want.items()], "a long, b long, cosine double")
    for least in (0.2, 0.5, 0.6, 0.7):
        one, two = (sorted(map(tuple, components.connected_components(ids_, p.filter(f"cosine >= {least}")).collect())) for p in (links, pairs))
        assert one == two


def test_packed_vectors_and_large_nodes(spark, monkeypatch):
    """Packed vectors are the long ones, also in small parts; a tree is the same below large and small nodes."""
    from lodestack.catalog_queries import all_vectors, packed_vectors
    from lodestack.operators import packed

    sf = "/root/testdata/sf0.001"
    long = {(r.id, r.term): r.weight for r in all_vectors(spark, sf).collect()}

    def unpacked(p):
        rows = p.rows.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("x")).select("id", F.col("x.terms").alias("number"), F.col("x.weights").alias("w"))
        return {(r.id, r.term): r.w for r in rows.join(p.names, "number").collect()}

    found = packed_vectors(spark, sf)
    got = unpacked(found)
    assert set(got) == set(long) and all(abs(got[k] - w) < 1e-9 for k, w in long.items())
    monkeypatch.setattr(packed, "TOKENS_AT_ONCE", 500)
    monkeypatch.setattr(packed, "TERMS_AT_ONCE", found.width // 3)
    got = unpacked(packed_vectors(spark, sf))
    assert set(got) == set(long) and all(abs(got[k] - w) < 1e-9 for k, w in long.items())
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("id"))
    whole = sorted(tuple(sorted(r.docs)) for r in cluster.document_tree(found, docs)[1].groupBy("node_id").agg(F.collect_list("document_id").alias("docs")).collect())
    monkeypatch.setattr(cluster, "IN_TASK", 150)
    monkeypatch.setattr(cluster, "MOST_SUMS", 0)
    bridge = cluster.document_tree(found, docs)[1]
    assert sorted(tuple(sorted(r.docs)) for r in bridge.groupBy("node_id").agg(F.collect_list("document_id").alias("docs")).collect()) == whole


def test_rows_of_one_id_are_one_packed_vector(spark, tmp_path):
    from lodestack.catalog_queries import all_vectors, packed_vectors

    texts = [(i // 2, f"{a} {b} {a}") for i, (a, b) in enumerate([("apple", "plum"), ("pear", "apple"), ("plum", "pear"), ("fig", "apple"), ("fig", "plum"), ("pear", "fig")])]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((r.id, round(r.weight, 9)) for r in all_vectors(spark, str(tmp_path)).collect())
    got = sorted((r.id, round(w, 9)) for r in packed_vectors(spark, str(tmp_path)).rows.collect() for w in r.weights)
    assert got == want and len(got) > 3
