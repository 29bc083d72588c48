"""Registered queries of the document-analytics operators, each over whole tables, with the same query as SQL where SQL has it.

The tables map onto the engine so: a document is a row of ``documents`` (title ``source/doc_id``, metadata lang and
source); tags are quality (1) and toxic (2), from ``labels``; nodes are languages and their sources; store objects are
event types, linked to documents by user id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plugins
from .functions import ids as id_functions
from .functions.text import clean_metadata, term_rows, terms, textify, weighted_terms
from .operators import cluster, components, facets, highlight, lookups, mutate, selection, vectors
from .operators.index import document_dictionary, save_index
from .operators.packed import Packed, pack, text_vectors
from .plans.parser import parse
from .shared import new_path, settled, table_state
from .sinks import export
from .sources import cloud, csv_documents, files

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("document_set_id"), F.concat_ws("/", "source", "doc_id").alias("title"),
        F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("supplied_id"), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("string").alias("url"),
        "text", F.to_json(F.struct("lang", "source")).alias("metadata_json"), "lang", "source",
    )


def document_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = F.array_compact(F.array(F.when(F.col("quality") == 1, 1), F.when(F.col("toxic") == 1, 2)))
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("document_id"), F.explode(tags).alias("tag_id"))


def tag(spark: SparkSession) -> DataFrame:
    names = [(1, "quality"), (2, "toxic"), (3, "unused")]
    return spark.createDataFrame([(i, n, mutate.tag_color(n)) for i, n in names], "id int, name string, color string")


def node_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.explode(F.array("lang", F.concat_ws("/", "lang", "source"))).alias("node_id"), F.col("doc_id").alias("document_id"))


def object_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("document_id"), F.col("event_type").alias("store_object_id"))


#: Folders of the term indexes written by this process, by application, table folder and state of the documents.
_INDEXES: dict[tuple, str] = {}


def index(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The term index and its dictionary of the documents: written once a session and state of the table, sorted by field and term, and then read by every search."""
    key = (spark.sparkContext.applicationId, sf_dir, table_state(spark, f"{sf_dir}/documents.parquet"))
    if key not in _INDEXES:
        path = new_path(spark, "index")
        save_index(documents(spark, sf_dir), path, ["lang", "source"], "simple", offsets=False)
        _INDEXES[key] = path
    postings = spark.read.schema("id long, field string, term string, pos int, begin int, end int, document_set_id long").parquet(f"{_INDEXES[key]}/postings")
    return postings, spark.read.schema("field string, term string, n_docs long").parquet(f"{_INDEXES[key]}/dictionary")


def corpus(spark: SparkSession, sf_dir: str) -> selection.Corpus:
    docs = documents(spark, sf_dir)
    postings, terms_ = index(spark, sf_dir)
    return selection.Corpus(docs, postings, document_tag(spark, sf_dir), node_document(spark, sf_dir), object_link(spark, sf_dir), ("lang", "source"), "simple", terms_, most_expansions=None)


def searched(spark: SparkSession, sf_dir: str, **request) -> DataFrame:
    return selection.filtered(corpus(spark, sf_dir), selection.SelectionRequest(**request), []).select("id")


D = r"""WITH d AS (SELECT doc_id AS id, concat_ws('/', source, doc_id) AS title, text, lang, source,
  regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t, regexp_extract_all(lower(concat_ws('/', source, doc_id)), '[\p{L}\p{N}]+') AS tt,
  lpad(CAST(doc_id AS VARCHAR), 9, '0') AS supplied_id FROM documents)
"""
TAGS = "tags AS (SELECT doc_id, quality = 1 AS q, toxic = 1 AS x FROM labels), g AS (SELECT d.id, coalesce(q, false) AS q, coalesce(x, false) AS x FROM d LEFT JOIN tags ON d.id = tags.doc_id)"
PHRASE = "(' ' || array_to_string(t, ' ') || ' ') LIKE '% {0} %'"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A boolean search with a phrase and a prefix, in canonical order, first page with titles."""
    found = selection.select(corpus(spark, sf_dir), selection.SelectionRequest(q="'in the' AND NOT stup* OR title:src1"))
    rows = documents(spark, sf_dir).select("id", "title", F.length("text").alias("n_chars"))
    return lookups.in_page_order(found.page(0, 100), rows)


# search


@query(D + "SELECT id FROM d WHERE list_contains(t, 'stupid') OR list_contains(tt, 'stupid')")
def search_term(spark, sf_dir):
    return searched(spark, sf_dir, q="Stupid")


@query(D + "SELECT id FROM d WHERE " + PHRASE.format("in the"))
def search_phrase(spark, sf_dir):
    return searched(spark, sf_dir, q='text:"in the"')


@query(D + "SELECT id FROM d WHERE list_bool_or(list_transform(range(1, len(t) + 1), lambda i: t[i] = 'of' AND (coalesce(t[i - 1], '') = 'that' AND false OR list_contains(t[greatest(i - 1, 1):i - 1], 'that') OR list_contains(t[i + 1:i + 3], 'that'))))")
def search_proximity(spark, sf_dir):
    return searched(spark, sf_dir, q="text:'of that'~2")


@query(D + "SELECT id FROM d WHERE list_bool_or(list_transform(t, lambda x: starts_with(x, 'worthl')))")
def search_prefix(spark, sf_dir):
    return searched(spark, sf_dir, q="worthl*")


@query(D + r"SELECT id FROM d WHERE regexp_matches(' ' || array_to_string(t, ' '), ' of thea')")
def search_phrase_prefix(spark, sf_dir):
    return searched(spark, sf_dir, q="text:of thea*")


@query(D + "SELECT id FROM d WHERE list_bool_or(list_transform(t, lambda x: damerau_levenshtein(x, 'stupid') <= 1))")
def search_fuzzy(spark, sf_dir):
    return searched(spark, sf_dir, q="text:stupdi~1")


SQL["search_fuzzy"] = D + "SELECT id FROM d WHERE list_bool_or(list_transform(t, lambda x: damerau_levenshtein(x, 'stupdi') <= 1))"


@query(D + "SELECT id FROM d WHERE (list_contains(t, 'idiot') OR list_contains(t, 'moron')) AND NOT list_contains(t, 'clown') AND NOT (" + PHRASE.format("of the") + ")")
def search_boolean(spark, sf_dir):
    return searched(spark, sf_dir, q="text:idiot OR text:moron AND NOT text:clown AND NOT text:'of the'")


SQL["search_boolean"] = D + "SELECT id FROM d WHERE coalesce((list_contains(t, 'idiot') OR list_contains(t, 'moron')) AND NOT list_contains(t, 'clown') AND NOT (" + PHRASE.format("of the") + "), false)"


@query(D + "SELECT id FROM d WHERE lang = 'fr'")
def search_metadata(spark, sf_dir):
    return searched(spark, sf_dir, q="lang:FR")


@query(D + r"SELECT id FROM d WHERE regexp_matches(text, '555-[0-9]{4}') AND NOT regexp_matches(title, 'src1')")
def search_regex(spark, sf_dir):
    return searched(spark, sf_dir, q="text:/555-[0-9]{4}/ AND NOT title:/src1/")


@query(D + "SELECT id FROM d WHERE list_contains(t, 'trash') AND NOT " + PHRASE.format("to the"))
def search_scan(spark, sf_dir):
    """The same language without an index: one boolean column, no shuffle."""
    from .plans.compile import scan_column

    docs = documents(spark, sf_dir).withColumn("__t", terms(F.col("text"))).withColumn("__tt", terms(F.col("title")))
    return docs.filter(scan_column(parse("text:trash AND NOT text:'to the'"), {"text": F.col("__t"), "title": F.col("__tt")})).select("id")


@query(D + "SELECT term, CAST(count(DISTINCT id) AS BIGINT) AS n_docs FROM (SELECT id, unnest(t) AS term FROM d) GROUP BY term")
def term_dictionary(spark, sf_dir):
    return document_dictionary(documents(spark, sf_dir).select("id", "text")).select("term", "n_docs")


@query()
def highlights(spark, sf_dir):
    return highlight.highlight_documents(documents(spark, sf_dir), parse("stupid OR 'in the'"))


@query()
def snippets(spark, sf_dir):
    return highlight.snippet_documents(documents(spark, sf_dir), parse("idiot OR worthl*"))


# selections


@query(D + f", {TAGS} SELECT id FROM g WHERE q OR x")
def select_tags_any(spark, sf_dir):
    return searched(spark, sf_dir, tag_ids=(1, 2), tag_operation="any")


@query(D + f", {TAGS} SELECT id FROM g WHERE q AND x")
def select_tags_all(spark, sf_dir):
    return searched(spark, sf_dir, tag_ids=(1, 2), tag_operation="all")


@query(D + f", {TAGS} SELECT id FROM g WHERE NOT q")
def select_tags_none(spark, sf_dir):
    return searched(spark, sf_dir, tag_ids=(1,), tag_operation="none")


@query(D + f", {TAGS} SELECT id FROM g WHERE x OR NOT (q OR x)")
def select_tags_any_or_untagged(spark, sf_dir):
    return searched(spark, sf_dir, tag_ids=(2,), tagged=False, tag_operation="any")


@query(D + f", {TAGS} SELECT id FROM g WHERE q OR x")
def select_tagged(spark, sf_dir):
    return searched(spark, sf_dir, tagged=True)


@query(D + f", {TAGS} SELECT id FROM g WHERE NOT (q OR x)")
def select_untagged(spark, sf_dir):
    return searched(spark, sf_dir, tagged=False)


@query(D + "SELECT id FROM d WHERE lang = 'de' OR (lang = 'en' AND source = 'src3')")
def select_nodes(spark, sf_dir):
    return searched(spark, sf_dir, node_ids=("de", "en/src3"))


@query(D + "SELECT id FROM d WHERE id IN (SELECT user_id FROM events WHERE event_type IN ('click', 'purchase'))")
def select_objects(spark, sf_dir):
    return searched(spark, sf_dir, store_object_ids=("click", "purchase"))


@query(D + "SELECT id FROM d WHERE id IN (0, 2, 5, 17, 100, 101, 640)")
def select_bitset(spark, sf_dir):
    return searched(spark, sf_dir, bitset=id_functions.numbers_to_bits([0, 2, 5, 17, 100, 101, 640]))


@query(D + "SELECT id FROM d WHERE id IN (3, 14, 159, 265)")
def select_ids(spark, sf_dir):
    return searched(spark, sf_dir, document_ids=(3, 14, 159, 265, 10**12))


@query(D + "SELECT id FROM d WHERE length(text) >= 2000")
def select_view_filter(spark, sf_dir):
    plugins.register_filter("long-texts", lambda s, ids, op: documents(s, sf_dir).filter(F.length("text") >= int(ids[0])).select("id"))
    return searched(spark, sf_dir, view_filters=(("long-texts", ("2000",), "any"),))


@query(D + f", {TAGS} SELECT d.id FROM d JOIN g USING (id) WHERE q AND lang = 'en' AND list_contains(t, 'the') AND regexp_matches(text, '[0-9]')")
def select_combined(spark, sf_dir):
    return searched(spark, sf_dir, q="text:the AND text:/[0-9]/", tag_ids=(1,), tag_operation="all", node_ids=("en",))


CANON = "row_number() OVER (ORDER BY title, supplied_id, id) - 1 AS pos"


@query(D + f"SELECT id, {CANON} FROM d")
def canonical_order(spark, sf_dir):
    return selection.select(corpus(spark, sf_dir), selection.SelectionRequest()).rows.select("id", "pos")


@query(D + f"SELECT id, pos FROM (SELECT id, {CANON} FROM d) WHERE pos >= 30 AND pos < 50")
def page_forward(spark, sf_dir):
    return selection.select(corpus(spark, sf_dir), selection.SelectionRequest()).page(30, 20).select("id", "pos")


@query(D + f"SELECT id, n - 1 - pos AS pos FROM (SELECT id, {CANON}, count(*) OVER () AS n FROM d) WHERE n - 1 - pos >= 30 AND n - 1 - pos < 50")
def page_reverse(spark, sf_dir):
    return selection.select(corpus(spark, sf_dir), selection.SelectionRequest()).page(30, 20, reverse=True).select("id", "pos")


@query(D + "SELECT id, row_number() OVER (ORDER BY lang, title, supplied_id, id) - 1 AS pos FROM d")
def sort_field(spark, sf_dir):
    return selection.select(corpus(spark, sf_dir), selection.SelectionRequest(sort_field="lang")).rows.select("id", "pos")


# facets and joins

FR = "s AS (SELECT id FROM d WHERE lang = 'fr')"
DT = "dt AS (SELECT doc_id, 1 AS tag_id FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, 2 FROM labels WHERE toxic = 1)"


@query(D + f", {FR}, {DT} SELECT tag_id, count(*) AS n FROM dt WHERE doc_id IN (SELECT id FROM s) GROUP BY tag_id")
def facet_tags(spark, sf_dir):
    return facets.tag_counts(document_tag(spark, sf_dir), searched(spark, sf_dir, q="lang:fr"))


@query(f"WITH {DT} SELECT id, name, (SELECT count(*) FROM dt WHERE tag_id = id) AS n FROM (VALUES (1, 'quality'), (2, 'toxic'), (3, 'unused')) v(id, name)")
def facet_tags_all(spark, sf_dir):
    return facets.all_tag_counts(tag(spark), document_tag(spark, sf_dir)).select("id", "name", "n")


@query(D + "SELECT lang AS node_id, count(*) AS n FROM d WHERE list_contains(t, 'idiot') AND lang IN ('en', 'fr', 'de', 'es') GROUP BY lang")
def facet_nodes(spark, sf_dir):
    return facets.node_counts(node_document(spark, sf_dir), searched(spark, sf_dir, q="text:idiot"), ["en", "fr", "de", "es"])


@query(D + "SELECT event_type AS store_object_id, count(*) AS n FROM events WHERE user_id IN (SELECT id FROM d WHERE lang = 'fr') GROUP BY event_type")
def facet_objects(spark, sf_dir):
    objects = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), F.lit(7).alias("store_id")).distinct()
    return facets.object_counts(object_link(spark, sf_dir), objects, 7, searched(spark, sf_dir, q="lang:fr"))


@query(f"WITH {DT} SELECT doc_id AS id, coalesce((SELECT string_agg(tag_id, ',' ORDER BY tag_id) FROM dt WHERE dt.doc_id = documents.doc_id), '') AS tag_ids FROM documents")
def doc_tag_arrays(spark, sf_dir):
    lists = facets.lists_per_document(document_tag(spark, sf_dir), "tag_id", documents(spark, sf_dir).select("id"), keep_empty=True)
    return lists.select("id", F.array_join(F.col("values").cast("array<string>"), ",").alias("tag_ids"))


@query(f"WITH {DT} SELECT doc_id AS id, tag_id, CASE tag_id WHEN 1 THEN 'quality' ELSE 'toxic' END AS name FROM dt WHERE doc_id IN (SELECT doc_id FROM documents)")
def tags_of_documents(spark, sf_dir):
    return lookups.tags_of(documents(spark, sf_dir).select("id"), document_tag(spark, sf_dir), tag(spark))


@query("SELECT o_custkey AS document_set_id, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY o_custkey")
def views_and_trees(spark, sf_dir):
    trees = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_set_id"))
    return facets.views_and_trees(trees, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_set_id")))


@query("SELECT conv_id AS id, turn + 1 AS page_number, n_pages FROM conversations JOIN (SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id) USING (conv_id)")
def page_infos(spark, sf_dir):
    """Turns as pages of a parent file, their conversation."""
    turns = table(spark, sf_dir, "conversations")
    parent = turns.groupBy("conv_id").agg(F.count("*").alias("n_children")).select((F.col("conv_id") * 1000).alias("id"), F.lit(None).cast("long").alias("parent_id"), F.lit(0).cast("long").alias("index_in_parent"), "n_children")
    leaf = turns.select((F.col("conv_id") * 1000 + F.col("turn") + 1).alias("id"), (F.col("conv_id") * 1000).alias("parent_id"), F.col("turn").alias("index_in_parent"), F.lit(0).cast("long").alias("n_children"))
    docs = turns.select(F.col("conv_id").alias("id"), (F.col("conv_id") * 1000 + F.col("turn") + 1).alias("file2_id"))
    return lookups.page_infos(docs, parent.unionByName(leaf))


@query("SELECT o_orderkey AS id, c_name AS user_email, n_name AS role FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation)")
def owned_sets(spark, sf_dir):
    """Orders as document sets, customers as their users, nations as roles."""
    nation = table(spark, sf_dir, "nation")
    users = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    links = table(spark, sf_dir, "orders").join(users, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("document_set_id"), F.col("c_name").alias("user_email"), F.col("n_name").alias("role"))
    sets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("created_at"))
    first = nation.agg(F.min("n_name")).first()[0]
    return lookups.owned_sets(sets, links, first).select("id", "user_email", F.lit(first).alias("role"))


@query("SELECT doc_id AS id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents")
def document_sizes(spark, sf_dir):
    none = spark.createDataFrame([], "id long, n_bytes long")
    docs = documents(spark, sf_dir).select("id", "text", *[F.lit(None).cast("long").alias(c) for c in ("file2_id", "file_id", "page_id")])
    return lookups.sizes(docs, docs, none, none, none)


@query("SELECT count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents")
def totals(spark, sf_dir):
    return facets.totals(table(spark, sf_dir, "documents"), chars="n_chars")


# ingest, export, changes


@query("SELECT page_id AS id, length(regexp_replace(html, '\r\n?', '\n', 'g')) AS n FROM pages")
def textify_lengths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.length(textify(F.col("html"))).cast("long").alias("n"))


@query("SELECT doc_id AS id, lang, CASE WHEN lang IS NULL THEN '' ELSE lang END || '|' || coalesce(source, '') || '|' AS cleaned FROM documents")
def metadata_clean(spark, sf_dir):
    cleaned = F.from_json(clean_metadata(F.col("metadata_json"), ["lang", "source", "missing"]), "lang string, source string, missing string")
    return documents(spark, sf_dir).withColumn("c", cleaned).select("id", "lang", F.concat_ws("|", "c.lang", "c.source", "c.missing").alias("cleaned"))


@query("SELECT doc_id AS number, (CAST(5 AS BIGINT) << 32) + row_number() OVER (ORDER BY source, doc_id) + 6 AS id FROM documents")
def ingest_number_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source")
    return csv_documents.numbered(rows, 5, 7, [F.col("source"), F.col("doc_id")]).select(F.col("doc_id").alias("number"), "id")


@query("SELECT o_orderkey AS id, CASE WHEN n > 1 THEN unnest(range(1, n + 1)) END AS page_number FROM (SELECT o_orderkey, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)")
def page_explode(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_pages"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return cloud.split_pages(orders.select(F.col("o_orderkey").alias("id"), "n_pages")).select("id", F.col("page_number").cast("long").alias("page_number"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_missing(spark, sf_dir):
    there = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return cloud.not_there(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), there, ["id"])


@query("SELECT page_id AS id, sha1(html) AS sha1 FROM pages WHERE sha1(html) = (SELECT sha1(html) FROM pages WHERE page_id = 3)")
def sha1_lookup(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.sha1("html").alias("sha1"))
    wanted = pages.filter("id = 3").first().sha1
    return lookups.with_sha1(pages.withColumn("raw", F.unhex("sha1")), wanted, "raw").select("id", "sha1")


@query()
def ingest_pages(spark, sf_dir):
    """Raw pages as HTML files through the ingest steps."""
    pages = table(spark, sf_dir, "pages")
    none = lambda kind: F.lit(None).cast(kind)
    roots = pages.select(F.col("page_id").cast("string").alias("id"), none("string").alias("root_id"), none("string").alias("parent_id"), F.lit(0).alias("index_in_parent"), F.concat(F.col("page_id").cast("string"), F.lit(".html")).alias("filename"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("content"), F.lit('{"pageNumber": 1}').alias("metadata_json"))
    empty = spark.createDataFrame([], "id long, document_set_id long, supplied_id string")
    return files.ingest(files.process(roots), empty, 9)[0].select("id", "supplied_id", "title", "text", "page_number", "is_from_ocr")


@query(f"WITH {DT} SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, lang, coalesce((SELECT string_agg(CASE tag_id WHEN 1 THEN 'quality' ELSE 'toxic' END, ',' ORDER BY tag_id) FROM dt WHERE dt.doc_id = documents.doc_id), '') AS tags FROM documents")
def export_string_tags(spark, sf_dir):
    return export.with_string_tags(documents(spark, sf_dir).drop("lang"), document_tag(spark, sf_dir), tag(spark), ["lang"]).select("id", "lang", "tags")


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, CASE WHEN quality = 1 THEN '1' ELSE '' END AS quality, CASE WHEN toxic = 1 THEN '1' ELSE '' END AS toxic, '' AS unused FROM documents LEFT JOIN labels USING (doc_id)")
def export_column_tags(spark, sf_dir):
    return export.with_column_tags(documents(spark, sf_dir), document_tag(spark, sf_dir), tag(spark)).select("id", "quality", "toxic", "unused")


@query("SELECT min(doc_id) AS id, lang || '/' || (doc_id % 10) || '.txt' AS name FROM documents GROUP BY name")
def archive_entries(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat(F.col("lang"), F.lit("/"), (F.col("doc_id") % 10).cast("string"), F.lit(".doc")).alias("title"), "text")
    return export.archive_entries(d).select("id", "name")


@query("SELECT (CAST(77 AS BIGINT) << 32) | doc_id AS id, CAST(77 AS BIGINT) AS document_set_id FROM documents")
def clone_ids(spark, sf_dir):
    return mutate.clone({"documents": documents(spark, sf_dir)}, 77, 100)["documents"].select("id", "document_set_id")


@query(f"WITH {DT} SELECT doc_id AS document_id, tag_id FROM dt UNION SELECT doc_id, 2 FROM documents WHERE lang = 'es'")
def tag_selection(spark, sf_dir):
    return mutate.tag_selection(document_tag(spark, sf_dir), searched(spark, sf_dir, q="lang:es"), 2)


@query(f"WITH {DT} SELECT doc_id AS document_id, tag_id FROM dt WHERE NOT (tag_id = 1 AND doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en'))")
def untag_selection(spark, sf_dir):
    return mutate.untag_selection(document_tag(spark, sf_dir), searched(spark, sf_dir, q="lang:en"), 1)


@query("SELECT l_partkey AS file_id FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) = 1 AND min(l_suppkey) = 7")
def unshared_files(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("file_id"), F.col("l_suppkey").alias("document_set_id"))
    return mutate.unshared_files(links, 7)


@query("SELECT event_id AS id, CAST(list_sum(list_transform(regexp_extract_all(props, '[0-9]+'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS total FROM events WHERE props IS NOT NULL")
def parse_ids(spark, sf_dir):
    found = id_functions.parsed_ids(F.col("props"))
    total = F.when(F.size(found) > 0, F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x))
    return table(spark, sf_dir, "events").filter("props is not null").select(F.col("event_id").alias("id"), total.alias("total"))


# vectors and clustering


def lexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").repartition("id")
    return texts.select("id", weighted_terms(terms(F.col("text")), [], {}).alias("terms"))


LEX = r"""WITH x AS (SELECT {1} AS id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda w: length(w) >= 3 AND NOT (regexp_matches(w, '^[0-9]') AND length(regexp_replace(w, '[^0-9]', '', 'g')) * 10 >= length(w) * 4)) AS t0 FROM {0}),
y AS (SELECT id, list_transform(t0, lambda w: substr(w, 1, 40)) AS t FROM x),
f AS (SELECT id, unnest(t) AS term FROM y UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM y),
tf AS (SELECT id, term, CAST(count(*) AS DOUBLE) AS tf FROM f GROUP BY id, term),
df AS (SELECT term, CAST(sum(tf) AS BIGINT) AS uses, count(*) AS n_docs FROM tf GROUP BY term)
"""
DOCS = LEX.format("documents", "doc_id")


@query(DOCS + "SELECT id, term, tf FROM tf")
def term_frequency(spark, sf_dir):
    return vectors.term_frequencies(lexed(spark, sf_dir))


@query(DOCS + "SELECT term, uses, n_docs FROM df")
def document_frequency(spark, sf_dir):
    return vectors.document_frequencies(vectors.term_frequencies(lexed(spark, sf_dir)))


@query(DOCS + "SELECT term, round(log10((SELECT count(*) FROM documents) / CAST(n_docs AS DOUBLE)), 6) AS idf FROM df WHERE n_docs >= 3 AND n_docs < (SELECT count(*) FROM documents)")
def inverse_document_frequency(spark, sf_dir):
    n = table(spark, sf_dir, "documents").count()
    df = vectors.document_frequencies(vectors.term_frequencies(lexed(spark, sf_dir)))
    return df.select("term", F.round(vectors.idf(n, F.col("n_docs"), 3), 6).alias("idf")).filter("idf is not null")


LLR = """, n AS (SELECT CAST(sum(uses) AS DOUBLE) AS n FROM df WHERE term NOT LIKE '% %'),
c AS (SELECT p.term, CAST(p.uses AS DOUBLE) AS ab, CAST(a.uses AS DOUBLE) AS a, CAST(b.uses AS DOUBLE) AS b, n FROM df p JOIN df a ON a.term = split_part(p.term, ' ', 1) JOIN df b ON b.term = split_part(p.term, ' ', 2), n WHERE p.term LIKE '% %' AND p.uses >= {0}),
e AS (SELECT *, b / n AS p, ab / a AS p1, (b - ab) / (n - a) AS p2 FROM c),
l AS (SELECT term, 2 * (ab * ln(p1) + (a - ab) * (CASE WHEN p1 < 1 THEN ln(1 - p1) ELSE 0 END) + (b - ab) * (CASE WHEN p2 > 0 THEN ln(p2) ELSE 0 END) + (n - a - b + ab) * ln(1 - p2) - ab * ln(p) - (a - ab) * ln(1 - p) - (b - ab) * ln(p) - (n - a - b + ab) * ln(1 - p)) AS likelihood, ab * n > a * b AS above FROM e)
"""


@query(DOCS + LLR.format(5) + "SELECT term, round(likelihood, 3) AS likelihood FROM l WHERE likelihood >= 30 AND above")
def bigram_likelihood(spark, sf_dir):
    df = settled(vectors.document_frequencies(vectors.term_frequencies(lexed(spark, sf_dir))), "document-frequencies")
    return vectors.collocations(df).select("term", F.round("likelihood", 3).alias("likelihood"))


W = LLR.format(5) + """, k AS (SELECT term, log10((SELECT count(*) FROM documents) / CAST(n_docs AS DOUBLE)) AS idf FROM df WHERE n_docs >= 3 AND n_docs < (SELECT count(*) FROM documents) AND (term NOT LIKE '% %' OR term IN (SELECT term FROM l WHERE likelihood >= 30 AND above))),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN k USING (term)), v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w)
"""
PAIRS = "SELECT a.id AS a, b.id AS b, sum(a.weight * b.weight) AS cosine FROM v a JOIN v b ON a.term = b.term AND a.id < b.id GROUP BY a.id, b.id"


def all_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vectors(vectors.term_frequencies(lexed(spark, sf_dir)), table(spark, sf_dir, "documents").count())


def packed_vectors(spark: SparkSession, sf_dir: str) -> Packed:
    """The same vectors, a row a document."""
    docs = table(spark, sf_dir, "documents")
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").limit(1).count():  # rows of one id are one vector
        return pack(settled(all_vectors(spark, sf_dir)))
    return text_vectors(docs.select(F.col("doc_id").alias("id"), terms(F.col("text")).alias("tokens")), docs.count())


@query(DOCS + W + "SELECT id, term, round(weight, 6) AS weight FROM v")
def tfidf_vectors(spark, sf_dir):
    return all_vectors(spark, sf_dir).select("id", "term", F.round("weight", 6).alias("weight"))


@query(DOCS + W + f"SELECT a, b, round(cosine, 6) AS cosine FROM ({PAIRS}) WHERE cosine >= 0.1")
def cosine_pairs(spark, sf_dir):
    return vectors.similar_pairs(packed_vectors(spark, sf_dir), 0.1).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(
    DOCS + W + """, t AS (SELECT id, list(term ORDER BY weight DESC, term) AS t FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM v) WHERE rank <= 7 GROUP BY id)
SELECT id, array_to_string(list_filter(t, lambda x: contains(x, ' ') OR NOT list_contains(flatten(list_transform(list_filter(t, lambda y: contains(y, ' ')), lambda y: string_split(y, ' '))), x)), ', ') AS keywords FROM t"""
)
def keywords(spark, sf_dir):
    return vectors.keywords(all_vectors(spark, sf_dir)).select("id", F.array_join("keywords", ", ").alias("keywords"))


@query("SELECT doc_id AS id, min(doc_id) OVER (PARTITION BY text) AS component FROM documents")
def connected_components(spark, sf_dir):
    """Exact copies as links to the copy before."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    groups = docs.groupBy("h").agg(F.min("doc_id").alias("first"))
    edges = docs.join(groups, "h").filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    return components.connected_components(docs.select(F.col("doc_id").alias("id")), edges)


@query()
def k_means_clusters(spark, sf_dir):
    return cluster.k_means(settled(all_vectors(spark, sf_dir)), 5)


@query()
def cluster_tree(spark, sf_dir):
    """The default tree over all documents, with labels."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return cluster.labelled_tree(packed_vectors(spark, sf_dir), docs)


@query((DOCS + W).replace("WITH x AS", "WITH RECURSIVE x AS") + f""", p0 AS ({PAIRS} HAVING sum(a.weight * b.weight) >= 0.2 - 1e-12), p AS (SELECT * FROM p0 UNION ALL SELECT b, a, cosine FROM p0),
h AS (SELECT i AS level, [0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1][i] AS d FROM range(1, 9) t(i)),
r AS (SELECT DISTINCT level, id, id AS reach FROM v, h UNION SELECT r.level, r.id, p.b FROM r JOIN h ON h.level = r.level JOIN p ON p.a = r.reach AND p.cosine >= 1 - h.d - 1e-12)
SELECT doc_id AS document_id, 0 AS level, (SELECT min(doc_id) FROM documents) AS component FROM documents UNION ALL SELECT id, CAST(level AS INT), min(reach) FROM r GROUP BY id, level""")
def threshold_components(spark, sf_dir):
    """Nested components of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return cluster.threshold_tree(packed_vectors(spark, sf_dir), docs)


@query(r"SELECT doc_id AS id, unnest(range(0, len(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')))) AS pos FROM documents")
def term_positions(spark, sf_dir):
    return term_rows(table(spark, sf_dir, "documents"), "doc_id", "text").select("id", F.col("pos").cast("long").alias("pos"))
