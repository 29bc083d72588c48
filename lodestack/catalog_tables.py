"""Registered queries of the table operators: files, jobs, sets, trees, edits, imports and analysis, with the same query as SQL.

Orders stand for document sets and for files with their line items as children, customers for users, suppliers and parts for
files of sets, events for store objects; ``vector`` is the line items' flags and statuses, weighted by quantity.
"""

from __future__ import annotations

import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_queries import CANON, DOCS, DT, D, W, corpus, document_tag, documents, lexed, node_document, query, searched, table, tag
from .functions import ids as id_functions
from .functions.text import metadata_value, short_tokens, terms, textify_bytes, truncated, weighted_terms
from .operators import cluster, components, facets, highlight, index, lists, lookups, mutate, selection, sorting, trees, vectors
from .plans.compile import IndexSearch
from .plans.parser import parse
from .shared import new_path, settled
from .sinks import export
from .sources import blobs, cloud, csv_documents, files
from .streaming import ingest

NULL = lambda kind: F.lit(None).cast(kind)


# files and jobs


def file_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as processed root files, their line items as children: returned ones (R) aren't ingested yet, N ones aren't processed."""
    lines = table(spark, sf_dir, "lineitem")
    kids = lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_orderkey") * 10).alias("parent_id"), (F.col("l_orderkey") * 10).alias("root_id"), F.col("l_linenumber").cast("long").alias("index_in_parent"), F.concat(F.lit("part"), "l_partkey").alias("filename"), F.lit(0).cast("long").alias("n_children"), F.when(F.col("l_returnflag") != "N", F.col("l_shipdate")).alias("processed_at"), F.when(F.col("l_returnflag") == "A", F.col("l_shipdate")).alias("ingested_at"))
    many = lines.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_returnflag") != "A", 1)).alias("open"))
    roots = table(spark, sf_dir, "orders").join(many, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return roots.select((F.col("o_orderkey") * 10).alias("id"), NULL("long").alias("parent_id"), NULL("long").alias("root_id"), F.lit(0).cast("long").alias("index_in_parent"), F.concat(F.lit("order"), "o_orderkey").alias("filename"), F.coalesce("n", F.lit(0)).cast("long").alias("n_children"), F.col("o_orderdate").alias("processed_at"), F.when(F.coalesce("open", F.lit(0)) == 0, F.col("o_orderdate")).alias("ingested_at")).unionByName(kids)


FILES = """WITH m AS (SELECT l_orderkey AS k, count(*) AS n, count(*) FILTER (l_returnflag <> 'A') AS o FROM lineitem GROUP BY l_orderkey),
f AS (SELECT o_orderkey * 10 AS id, CAST(NULL AS BIGINT) AS parent_id, CAST(NULL AS BIGINT) AS root_id, 'order' || o_orderkey AS filename, coalesce(n, 0) AS n_children, true AS processed, coalesce(o, 0) = 0 AS ingested FROM orders LEFT JOIN m ON k = o_orderkey
UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_orderkey * 10, l_orderkey * 10, 'part' || l_partkey, 0, l_returnflag <> 'N', l_returnflag = 'A' FROM lineitem)
"""


@query(FILES + "SELECT f.id, f.filename, r.id AS root, r.filename AS root_filename FROM f JOIN f r ON r.id = coalesce(f.root_id, f.id)")
def file_roots(spark, sf_dir):
    return lookups.roots(file_tree(spark, sf_dir)).select("id", "filename", "root", "root_filename")


@query(FILES + "SELECT id FROM f WHERE coalesce(root_id, id) IN (SELECT o_orderkey * 10 FROM orders WHERE o_custkey % 10 = 3)")
def files_of_sets(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").filter("o_custkey % 10 = 3").select((F.col("o_orderkey") * 10).alias("id"))
    return lookups.file_exists(file_tree(spark, sf_dir), roots).select("id")


@query(FILES + "SELECT p.id, p.n_children FROM f p JOIN (SELECT parent_id, count(*) AS done FROM f WHERE ingested AND parent_id IS NOT NULL GROUP BY parent_id) c ON c.parent_id = p.id AND done = p.n_children")
def finished_parents(spark, sf_dir):
    return facets.children_done(file_tree(spark, sf_dir))


@query(FILES + """SELECT f.id, coalesce(d.n, 0) AS n_ingested_children FROM f LEFT JOIN (SELECT parent_id, count(*) AS n FROM f WHERE ingested AND parent_id IS NOT NULL GROUP BY parent_id) d ON d.parent_id = f.id
WHERE NOT ingested AND (f.parent_id IS NULL OR EXISTS (SELECT 1 FROM f p WHERE p.id = f.parent_id AND NOT p.ingested AND p.processed AND p.n_children > 0))""")
def unfinished_files(spark, sf_dir):
    return lookups.unfinished_files(file_tree(spark, sf_dir)).select("id", "n_ingested_children")


def _jobs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_set_id"), (F.col("o_orderstatus") == "F").alias("finished"), "o_orderpriority")
    return {kind: orders.filter(F.col("o_orderpriority").startswith(str(n))).drop("o_orderpriority") for n, kind in enumerate(("csv", "cloud", "files", "clone", "delete"), 1)}


JOBS = "WITH j AS (SELECT o_orderkey AS id, o_custkey AS document_set_id, o_orderstatus = 'F' AS finished, ['csv', 'cloud', 'files', 'clone', 'delete'][CAST(left(o_orderpriority, 1) AS INT)] AS kind FROM orders) "


@query(JOBS + "SELECT kind, id, document_set_id FROM j WHERE NOT finished")
def dangling_jobs(spark, sf_dir):
    return cloud.dangling(_jobs(spark, sf_dir))


def _sets(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as document sets, and their nations as owners; even ones have a viewer, the segment."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sets = customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_acctbal").alias("created_at"), (F.col("c_custkey") % 7 == 0).alias("deleted"), (F.col("c_custkey") % 5 == 0).alias("is_public"))
    owners = customer.filter("c_custkey % 11 <> 0").select(F.col("c_custkey").alias("document_set_id"), F.col("n_name").alias("user_email"), F.lit("Owner").alias("role"))
    viewers = customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("document_set_id"), F.col("c_mktsegment").alias("user_email"), F.lit("Viewer").alias("role"))
    return sets, owners.unionByName(viewers)


SETS = """WITH s AS (SELECT c_custkey AS id, c_name AS title, c_acctbal AS created_at, c_custkey % 7 = 0 AS deleted, c_custkey % 5 = 0 AS is_public, CASE WHEN c_custkey % 11 <> 0 THEN n_name END AS owner, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS viewer FROM customer JOIN nation ON c_nationkey = n_nationkey) """


@query(JOBS.replace("WITH j", SETS.rstrip() + ", j") + "SELECT j.id, kind, document_set_id, title, owner AS user_email FROM j JOIN s ON s.id = document_set_id")
def import_jobs(spark, sf_dir):
    return lookups.jobs(_jobs(spark, sf_dir), *_sets(spark, sf_dir)).select("id", "kind", "document_set_id", "title", "user_email")


@query(SETS + "SELECT id, title FROM s WHERE NOT deleted AND owner = 'NATION_3' ORDER BY created_at DESC, id LIMIT 5 OFFSET 2")
def sets_of_owner_page(spark, sf_dir):
    return lists.paged(lists.sets_of_owner(*_sets(spark, sf_dir), "NATION_3"), 2, 5).select("id", "title")


@query(SETS + "SELECT count(*) AS n FROM s WHERE NOT deleted AND owner = 'NATION_3'")
def sets_of_owner_total(spark, sf_dir):
    return lists.n_sets_of_owner(*_sets(spark, sf_dir), "NATION_3")


@query(SETS + "SELECT id, owner AS owner_email FROM s WHERE viewer = 'MACHINERY' AND owner IS NOT NULL")
def sets_shared(spark, sf_dir):
    return lists.sets_shared_with(*_sets(spark, sf_dir), "MACHINERY").select("id", "owner_email")


@query(SETS + "SELECT id, owner AS owner_email FROM s WHERE is_public AND owner IN (SELECT n_name FROM nation WHERE n_regionkey < 3)")
def sets_public(spark, sf_dir):
    users = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("email"))
    return lists.public_sets(*_sets(spark, sf_dir), users).select("id", "owner_email")


@query("SELECT c_name AS email FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS t FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey ORDER BY t DESC NULLS LAST, c_name LIMIT 20 OFFSET 40")
def users_page(spark, sf_dir):
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last_activity_at"))
    users = table(spark, sf_dir, "customer").join(latest, F.col("o_custkey") == F.col("c_custkey"), "left").select(F.col("c_name").alias("email"), "last_activity_at")
    return lists.paged(lists.users_by_activity(users), 40, 20).select("email")


@query("SELECT p_partkey AS id FROM part WHERE p_size % 2 = 0 ORDER BY p_size, p_partkey LIMIT 25")
def plugins_in_order(spark, sf_dir):
    plugin = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2 == 0).alias("autocreate"), F.col("p_size").alias("autocreate_order"))
    return lists.automatic_plugins(plugin).limit(25).select("id")


@query("SELECT o_orderkey AS id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 30")
def reindex_jobs_in_order(spark, sf_dir):
    return lists.jobs_by_request(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("last_requested_at"))).limit(30).select("id")


@query("SELECT o_custkey AS document_set_id, count(*) FILTER (o_orderstatus = 'F') AS n_documents, count(*) FILTER (o_orderstatus <> 'F') AS n_errors FROM orders GROUP BY o_custkey")
def set_counts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_set_id"), "o_orderstatus")
    return facets.set_counts(orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus <> 'F'"))


@query("SELECT c_custkey AS id, CAST(greatest(1, ceil(coalesce(n, 0) / 4.0)) AS BIGINT) AS n_lists FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey")
def id_lists_to_fetch(spark, sf_dir):
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(found, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(F.col("c_custkey").alias("id"), cloud.list_count(F.coalesce("n", F.lit(0)), 4).alias("n_lists"))


@query("SELECT o_custkey AS list, CAST(o_orderkey AS VARCHAR) AS id, o_orderstatus AS title, CAST(o_orderkey % 9 AS INT) AS n_pages FROM orders")
def id_list_codec(spark, sf_dir):
    record = F.concat_ws(cloud.FIELD, "o_orderkey", "o_orderstatus", F.col("o_orderkey") % 9, F.lit("text"), F.lit("page"), F.lit("public"))
    encoded = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("list")).agg(F.concat_ws(cloud.RECORD, F.collect_list(record)).alias("encoded"))
    return encoded.select("list", F.explode(cloud.decode_ids(F.col("encoded"))).alias("d")).select("list", "d.id", "d.title", "d.n_pages")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source AS title, CAST(doc_id % 4 AS INT) AS n_pages, 'https://example.com/' || doc_id || '.txt' AS text_url FROM documents")
def cloud_results(spark, sf_dir):
    """Saved pages of search results, eight of them, written and read back."""
    d = table(spark, sf_dir, "documents")
    link = F.struct(F.concat(F.lit("https://example.com/"), "doc_id", F.lit(".txt")).alias("text"), F.struct(F.lit("p{page}").alias("text")).alias("page"))
    one = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("title"), (F.col("doc_id") % 4).alias("pages"), F.lit("public").alias("access"), link.alias("resources"))
    pages = d.groupBy(F.pmod("doc_id", F.lit(8)).alias("page")).agg(F.count("*").alias("total"), F.collect_list(one).alias("documents"))
    path = new_path(spark, "results")
    pages.select(F.to_json(F.struct("*")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return cloud.read_results(spark, path).select("id", "title", "n_pages", "text_url")


# CSV and other files


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS supplied_id, source || '/' || doc_id AS title, md5(coalesce(text, '')) AS text_md5, lang, source FROM documents")
def csv_round_trip(spark, sf_dir):
    """All documents exported as CSV and read back: quotes, commas and line ends in texts."""
    path = new_path(spark, "csv")
    export.write_csv(documents(spark, sf_dir).select(F.col("supplied_id").alias("id"), "title", "text", "url", "lang", "source"), path)
    read = csv_documents.to_documents(csv_documents.read_csv(spark, path))
    value = lambda name: metadata_value(F.col("metadata_json"), name).alias(name)
    return read.select("supplied_id", "title", F.md5("text").alias("text_md5"), value("lang"), value("source"))


@query("SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS supplied_id, md5(coalesce(text, '')) AS text_md5, true AS whole FROM documents")
def csv_lenient_round_trip(spark, sf_dir):
    """The same by the lenient scanner."""
    path = new_path(spark, "csv")
    export.write_csv(documents(spark, sf_dir).select("supplied_id", "text"), path)
    rows = csv_documents.read_csv_leniently(spark, f"{path}/*.csv")
    return rows.select(F.get("row", F.lit(0)).alias("supplied_id"), F.md5(F.coalesce(F.get("row", F.lit(1)), F.lit(""))).alias("text_md5"), "whole")


TAGLISTS = "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'red, blue ,red' WHEN 2 THEN ' green,,quality' ELSE lang END"


@query(f"WITH t AS (SELECT doc_id, trim(unnest(string_split({TAGLISTS}, ','))) AS name FROM documents WHERE doc_id % 3 <> 0) SELECT DISTINCT doc_id AS number, name FROM t WHERE name <> ''")
def csv_import_tags(spark, sf_dir):
    """An import of documents of which a third is there already: rows of new documents and their tags by name."""
    d = table(spark, sf_dir, "documents")
    lists_ = F.expr(TAGLISTS.replace("''", "\"\""))
    rows = d.select(F.col("doc_id").cast("string").alias("supplied_id"), F.lit("").alias("url"), F.lit("").alias("title"), F.lit("").alias("text"), F.lit("{}").alias("metadata_json"), csv_documents.tag_names(lists_).alias("tags"))
    existing = d.filter("doc_id % 3 = 0").select((F.lit(5 << 32) + F.col("doc_id")).alias("id"), F.lit(5).cast("long").alias("document_set_id"), F.col("doc_id").cast("string").alias("supplied_id"))
    new, tags, links = csv_documents.import_documents(rows, existing, tag(spark), 5)
    named = links.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id").join(new.select(F.col("id").alias("document_id"), "supplied_id"), "document_id")
    return named.select(F.col("supplied_id").cast("long").alias("number"), "name")


@query("""SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'application/pdf' WHEN 2 THEN 'text/html' WHEN 3 THEN 'image/png' WHEN 4 THEN 'application/zip' ELSE 'application/octet-stream' END AS content_type FROM documents""")
def detected_types(spark, sf_dir):
    """Types by name, by first bytes, as given, and unknown."""
    name = F.expr("CASE doc_id % 6 WHEN 0 THEN 'a.txt' WHEN 1 THEN 'noname' WHEN 2 THEN 'x.bin' WHEN 3 THEN 'b.png' WHEN 4 THEN 'noname' ELSE 'noname' END")
    given = F.expr("CASE doc_id % 6 WHEN 2 THEN 'text/html; charset=utf-8' ELSE 'application/octet-stream' END")
    start = F.expr("CASE doc_id % 6 WHEN 1 THEN '%PDF-1.7' WHEN 4 THEN 'PK\\u0003\\u0004' ELSE 'zz' END")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), files.detected(name, F.encode(start, "UTF-8"), given).alias("content_type"))


@query("""SELECT doc_id AS id, CASE doc_id % 7 WHEN 0 THEN 3 WHEN 3 THEN 4 WHEN 4 THEN -2 END AS page_number, doc_id % 7 = 5 AS is_from_ocr FROM documents""")
def file_metadata(spark, sf_dir):
    """Page numbers and OCR marks count only if they are a JSON number and a JSON boolean."""
    j = F.expr("""CASE doc_id % 7 WHEN 0 THEN '{"pageNumber": 3}' WHEN 1 THEN '{"pageNumber": "3", "isFromOcr": "true"}' WHEN 2 THEN '{"pageNumber": true, "isFromOcr": 1}' WHEN 3 THEN '{"pageNumber": 3.5}' WHEN 4 THEN '{"pageNumber": -2, "isFromOcr": false}' WHEN 5 THEN '{"isFromOcr": true}' END""")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), files.page_number(j).alias("page_number"), F.coalesce(files.is_from_ocr(j), F.lit(False)).alias("is_from_ocr"))


@query("SELECT CAST(doc_id AS VARCHAR) AS supplied_id, (CAST(9 AS BIGINT) << 32) + row_number() OVER (ORDER BY CAST(doc_id AS VARCHAR)) - 1 AS id, doc_id || '.txt' AS title, md5(coalesce(text, '')) AS text_md5 FROM documents WHERE doc_id % 2 = 1")
def ingest_texts(spark, sf_dir):
    """Plain-text files of all documents through the ingest steps; those of even ids are there already."""
    d = table(spark, sf_dir, "documents")
    roots = d.select(F.col("doc_id").cast("string").alias("id"), NULL("string").alias("root_id"), NULL("string").alias("parent_id"), F.lit(0).alias("index_in_parent"), F.concat("doc_id", F.lit(".txt")).alias("filename"), F.lit("application/octet-stream").alias("content_type"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"), F.lit("{}").alias("metadata_json"))
    there = d.filter("doc_id % 2 = 0").select(F.lit(7).cast("long").alias("id"), F.lit(1).cast("long").alias("document_set_id"), F.col("doc_id").cast("string").alias("supplied_id"))
    return files.ingest(files.process(roots), there, 9)[0].select("supplied_id", "id", "title", F.md5("text").alias("text_md5"))


def _exported(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select(F.col("supplied_id").alias("id"), "title", F.coalesce("text", F.lit("")).alias("text")).orderBy("id")


EXPORTED = "SELECT lpad(CAST(doc_id AS VARCHAR), 9, '0') AS id, source || '/' || doc_id AS title, md5(coalesce(text, '')) AS text_md5 FROM documents"


@query(EXPORTED)
def csv_file_round_trip(spark, sf_dir):
    """One CSV file as it is downloaded, and read back."""
    path = new_path(spark, "csv-file")
    blobs.create_blob(spark, f"{path}/all.csv", export.csv_bytes(_exported(spark, sf_dir)))
    rows = csv_documents.named_rows(csv_documents.read_csv_leniently(spark, path))
    return rows.select("id", "title", F.md5("text").alias("text_md5"))


@query(EXPORTED)
def json_round_trip(spark, sf_dir):
    """The streamed JSON array of documents, and read back."""
    path = new_path(spark, "json-file")
    blobs.create_blob(spark, f"{path}/all.json", (part.encode() for part in export.json_documents(_exported(spark, sf_dir), ["id", "title", "text"])))
    rows = export.read_json_documents(spark, path, "id string, title string, text string")
    return rows.select("id", "title", F.md5("text").alias("text_md5"))


@query("SELECT min(doc_id) AS first, source || '/' || (doc_id % 50) || '.txt' AS name, md5(min_by(coalesce(text, ''), doc_id)) AS text_md5 FROM documents GROUP BY name")
def zip_round_trip(spark, sf_dir):
    """An archive of texts, of equal names the first; then ingested as an uploaded file, whose entries are its children."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id") % 50, F.lit(".doc")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    entries = export.archive_entries(d)
    path, out = new_path(spark, "zip"), io.BytesIO()
    export.write_zip(((r["name"], r.text.encode()) for r in entries.orderBy("id").toLocalIterator()), out)
    blobs.create_blob(spark, f"{path}/all.zip", out.getvalue())
    found = files.process(files.read_files(spark, path)).filter("is_document")
    return found.join(entries.select("id", "name"), F.col("filename") == F.col("name")).select(entries["id"].alias("first"), "name", F.md5(found["text"]).alias("text_md5"))


@query("SELECT n_name AS name, length(n_name) AS n, left(n_name, 4) AS start FROM nation")
def blobs_written(spark, sf_dir):
    """A blob for each nation, written, read by the executors, and one of them deleted again."""
    path = new_path(spark, "blobs")
    where = lambda name: blobs.blob_path(f"file:names:{name}", {"file": path})
    for r in table(spark, sf_dir, "nation").select("n_name").collect():
        blobs.create_blob(spark, where(r.n_name), r.n_name.encode())
    blobs.create_blob(spark, where("gone"), b"gone")
    blobs.delete_blobs(spark, [where("gone")])
    rows = blobs.read_blobs(spark, f"{path}/names")
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("n"), blobs.first_bytes(F.col("content"), 4).cast("string").alias("start"))


@query("SELECT r_name || '.txt' AS filename, r_name || ' text' AS text, 1 AS n_files FROM region")
def streamed_ingest(spark, sf_dir):
    """A landing folder ingested as a stream, and its finished files."""
    path = new_path(spark, "landing")
    for r in table(spark, sf_dir, "region").select("r_name").collect():
        blobs.create_blob(spark, f"{path}/in/{r.r_name}.txt", f"{r.r_name} text".encode())
    ingest.ingest_stream(ingest.watch_files(spark, f"{path}/in", 2), f"{path}/out", f"{path}/state").awaitTermination()
    done = spark.read.parquet(f"{path}/out")
    return done.join(ingest.finished_trees(done).select("id", "n_files"), "id").select("filename", "text", "n_files")


# selections


@query(D + "SELECT id FROM d WHERE length(text) >= 1500 AND id % 2 = 0")
def select_two_view_filters(spark, sf_dir):
    from . import plugins

    plugins.register_filter("long", lambda s, ids, op: documents(s, sf_dir).filter(F.length("text") >= int(ids[0])).select("id"))
    plugins.register_filter("even", lambda s, ids, op: documents(s, sf_dir).filter("id % 2 = 0").select("id"))
    plugins.register_filter("broken", lambda s, ids, op: documents(s, sf_dir).select(F.raise_error(F.lit("no service")).cast("long").alias("id")))
    return searched(spark, sf_dir, view_filters=(("long", ("1500",), "any"), ("broken", (), "any"), ("even", (), "all")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'")
def intersected_ids(spark, sf_dir):
    d = documents(spark, sf_dir)
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    foreign = d.select((F.col("id") + (3 << 32)).alias("id"))  # of another set
    return id_functions.intersect([id_functions.of_set(d.select("id").union(foreign), 0).filter("id % 2 = 0"), labelled, d.filter("lang = 'en'").select("id")])


@query(D + "SELECT id FROM d")
def search_nested_regex(spark, sf_dir):
    """A regular expression within an OR is ignored, so that side matches everything."""
    return searched(spark, sf_dir, q="text:/no such thing/ OR text:idiot")


QUERY_WARNINGS = [("text:/(/ AND lang:en", "RegexSyntaxError", "("), ("a OR text:/b/", "NestedRegexIgnored", "b"), ("nope:x AND lang:en", "MissingField", "nope"), ("text:abc~7", "TooMuchFuzz", "abc"), ("lang:en", None, None), ("text:/(?<n>x)/", None, None), ("text:/(?P<n>x)/", "RegexSyntaxError", "(?P<n>x)")]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in QUERY_WARNINGS) + ") v(q, kind, about)")
def query_warnings(spark, sf_dir):
    found = []
    for q, _, _ in QUERY_WARNINGS:
        warned: list = []
        selection.filtered(corpus(spark, sf_dir), selection.SelectionRequest(q=q), warned)
        found += [(q, w.kind, w.about) for w in warned] or [(q, None, None)]
    return spark.createDataFrame(found, "q string, kind string, about string")


PARSED = [
    ("a b AND c", "AND(a b,c)"), ("a and not (b or c)", "AND(a,NOT(OR(b,c)))"), ("title:'x y'~3", "title:x y~3"), ("foo:bar*", "foo:bar*"), ("text:/r.x/", "text:/r.x/"), ("abc~", "abc~"), ("abc~1 OR notes:z", "OR(abc~1,notes:z)"), ("not not a", "NOT(NOT(a))"), ("", "ALL"), ("(a", "(a"), ("a and b and c", "AND(a,b,c)"),
]


def shown(q) -> str:
    """A query tree as text."""
    kind = type(q).__name__
    if kind == "Everything":
        return "ALL"
    if kind in ("And", "Or"):
        return f"{kind.upper()}({','.join(map(shown, q.nodes))})"
    if kind == "Not":
        return f"NOT({shown(q.node)})"
    end = {"Prefix": "*", "Fuzzy": "~" + ("" if getattr(q, "distance", None) is None else str(q.distance)), "Proximity": f"~{getattr(q, 'slop', 0)}"}.get(kind, "")
    name = {"all": "", "metadata": f"{q.field.name}:"}.get(q.field.kind, f"{q.field.kind}:")
    return f"{name}/{q.text}/" if kind == "Regex" else f"{name}{q.text}{end}"


@query("SELECT * FROM (VALUES " + ", ".join("('" + a.replace("'", "''") + f"', '{b}')" for a, b in PARSED) + ") v(q, tree)")
def parsed_queries(spark, sf_dir):
    return spark.createDataFrame([(q, shown(parse(q))) for q, _ in PARSED], "q string, tree string")


@query(D + "SELECT id FROM d WHERE list_bool_or(list_transform(t, lambda x: length(x) BETWEEN 4 AND 8 AND damerau_levenshtein(x, 'stupid') <= 2))")
def search_fuzzy_two(spark, sf_dir):
    return searched(spark, sf_dir, q="text:stupid~")


@query(D + f", o AS (SELECT id, text, {CANON} FROM d) SELECT id, row_number() OVER (ORDER BY pos) - 1 AS pos FROM o WHERE pos < 60 AND regexp_matches(text, '[0-9]{{3}}')")
def select_regex_limited(spark, sf_dir):
    """The cap on tested candidates, as an option."""
    return selection.select(corpus(spark, sf_dir), selection.SelectionRequest(q="text:/[0-9]{3}/"), regex_limit=60).rows.select("id", "pos")


@query(D + "SELECT count(*) AS n FROM d WHERE lang = 'de'")
def selection_count(spark, sf_dir):
    n = selection.select(corpus(spark, sf_dir), selection.SelectionRequest(q="lang:de")).count()
    return spark.createDataFrame([(n,)], "n long")


@query(D + f"SELECT id, pos, source AS shown FROM (SELECT id, source, {CANON} FROM d) WHERE pos >= 5 AND pos < 17")
def rows_in_page_order(spark, sf_dir):
    page = selection.select(corpus(spark, sf_dir), selection.SelectionRequest()).page(5, 12)
    return lookups.in_page_order(page, documents(spark, sf_dir).select("id", F.col("source").alias("shown")))


FIRST = "regexp_extract(text, '^[^A-Za-zÀ-ÿ]*([A-Za-zÀ-ÿ]+)', 1)"


@query(f"SELECT doc_id AS id, row_number() OVER (ORDER BY {FIRST} COLLATE en, source || '/' || doc_id, doc_id) - 1 AS pos FROM documents")
def sort_accented_field(spark, sf_dir):
    """A metadata field with accented and capital letters: each document's first word."""
    d = documents(spark, sf_dir).withColumn("metadata_json", F.to_json(F.struct(F.regexp_extract("text", "^[^A-Za-zÀ-ÿ]*([A-Za-zÀ-ÿ]+)", 1).alias("first"))))
    ordered = sorting.positioned(d.select("id", "title", "supplied_id", "page_number", "metadata_json"), sorting.field_order(F.col("metadata_json"), "first"))
    return ordered.select("id", "pos")


@query(D + "SELECT id, row_number() OVER (ORDER BY lang, title, id) - 1 AS pos FROM d WHERE source <> 'src0'")
def sort_cached(spark, sf_dir):
    """Positions of a set's documents by a field, sorted once, and those of some documents closed up."""
    cache = selection.SortCache()
    some = documents(spark, sf_dir).filter("source <> 'src0'").select("id")
    cache.ordered(corpus(spark, sf_dir), 0, some.limit(3), "lang")
    return cache.ordered(corpus(spark, sf_dir), 0, some, "lang").select("id", "pos")


@query("SELECT doc_id AS id, CASE doc_id % 6 WHEN 0 THEN '\"quoted\"' WHEN 1 THEN '12.5' WHEN 2 THEN '' WHEN 3 THEN '' WHEN 4 THEN 'true' ELSE '' END AS value FROM documents")
def scalar_metadata(spark, sf_dir):
    j = F.expr("""CASE doc_id % 6 WHEN 0 THEN '{"f": "\\\\"quoted\\\\""}' WHEN 1 THEN '{"f": 12.5}' WHEN 2 THEN '{"f": {"a": 1}}' WHEN 3 THEN '{"f": [1, 2]}' WHEN 4 THEN '{"f": true}' ELSE '{"g": 1}' END""")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), sorting.scalar_metadata(j, "f").alias("value"))


@query(f"WITH {DT} SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM dt WHERE tag_id = 2)")
def documents_with_tag(spark, sf_dir):
    """What a clustering of one tag works on."""
    return selection.documents_for_clustering(documents(spark, sf_dir), document_tag(spark, sf_dir), 2).select("id")


@query("SELECT doc_id AS id, lpad(CAST(doc_id AS VARCHAR), 9, '0') AS \"suppliedId\", source || '/' || doc_id AS title FROM documents")
def api_fields(spark, sf_dir):
    return selection.projected(documents(spark, sf_dir), selection.parse_fields("suppliedId,bogus,title"))


@query("SELECT doc_id AS id, CASE doc_id % 4 WHEN 0 THEN '/documents/' || doc_id || '.pdf' WHEN 1 THEN '/localfiles/a/' || doc_id WHEN 2 THEN 'https://example.com/' || doc_id END AS url FROM documents")
def view_urls(spark, sf_dir):
    url = F.expr("CASE doc_id % 4 WHEN 1 THEN concat('local://a/', doc_id) WHEN 2 THEN concat('https://example.com/', doc_id) END")
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("id"), url.alias("url"), F.expr("CASE WHEN doc_id % 4 = 0 THEN doc_id END").alias("file2_id"))
    return d.select("id", selection.view_url(d).alias("url"))


@query("SELECT event_id AS id FROM events WHERE user_id % 3 = 1 AND user_id = 7 AND event_type = 'click'")
def store_objects(spark, sf_dir):
    return lookups.objects(_objects(spark, sf_dir), 1, 7, "click").select("id")


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), (F.col("user_id") % 3).cast("int").alias("store_id"), F.col("user_id").alias("indexed_long"), F.col("event_type").alias("indexed_string"))


@query("SELECT doc_id AS id, lang || ',' || lang || '/' || source AS nodes FROM documents WHERE source <> 'src1'")
def nodes_per_document(spark, sf_dir):
    some = documents(spark, sf_dir).filter("source <> 'src1'").select("id")
    return facets.lists_per_document(node_document(spark, sf_dir), "node_id", some, keep_empty=False).select("id", F.array_join("values", ",").alias("nodes"))


@query(f"WITH {DT} SELECT v.id, name, (SELECT count(*) FROM dt WHERE tag_id = v.id) AS count, color FROM (VALUES (1, 'quality', '{mutate.tag_color('quality')}'), (2, 'toxic', '{mutate.tag_color('toxic')}'), (3, 'unused', '{mutate.tag_color('unused')}')) v(id, name, color)")
def tags_csv(spark, sf_dir):
    return export.tags_csv(facets.all_tag_counts(tag(spark), document_tag(spark, sf_dir)))


@query("SELECT o_custkey AS document_set_id, CAST(sum(n) AS BIGINT) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 UNION SELECT c_custkey, count(*) FROM customer GROUP BY 1) GROUP BY o_custkey")
def views_and_trees_distinct(spark, sf_dir):
    """The literal reading: two equal counts are one."""
    views = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_set_id"))
    return facets.views_and_trees(views, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("document_set_id")), literal=True)


@query(D + "SELECT id FROM d WHERE lang = 'es'")
def selection_cached(spark, sf_dir):
    """A selection found again by its request's key."""
    cache, request = selection.SelectionCache(), selection.SelectionRequest(q="lang:es")
    made = cache.find_or_create(corpus(spark, sf_dir), request)
    found = cache.find(request.key())
    return found.rows.select("id") if found is made else found.rows.limit(0).select("id")


# changes


@query("SELECT user_id % 50 AS document_id, event_id % 40 AS store_object_id, CASE WHEN max(event_id) % 2 = 0 THEN 'new' ELSE 'old' END AS json FROM (SELECT DISTINCT user_id, event_id FROM events WHERE event_id < 40) GROUP BY user_id, event_id")
def store_links_upserted(spark, sf_dir):
    """Even links are written anew; links to objects of another store or to unknown documents are ignored."""
    e = table(spark, sf_dir, "events").filter("event_id < 40").select((F.col("user_id") % 50).alias("document_id"), (F.col("event_id") % 40).alias("store_object_id"), "event_id")
    old = e.select("document_id", "store_object_id", F.lit("old").alias("json"))
    new = e.filter("event_id % 2 = 0").select("document_id", "store_object_id", F.lit("new").alias("json"))
    foreign = e.select(F.lit(10**6).cast("long").alias("document_id"), "store_object_id", F.lit("x").alias("json")).unionByName(e.select("document_id", F.lit(777).cast("long").alias("store_object_id"), F.lit("y").alias("json")))
    objects = e.select(F.col("store_object_id").alias("id"), F.lit(1).alias("store_id")).unionByName(spark.createDataFrame([(777, 2)], "id long, store_id int"))
    return mutate.upsert_links(old, new.unionByName(foreign), objects, 1, e.select(F.col("document_id").alias("id")).distinct())


@query("SELECT event_id AS id FROM events WHERE event_id % 3 <> 0 OR event_id >= 300")
def store_links_deleted(spark, sf_dir):
    links = table(spark, sf_dir, "events").select(F.col("event_id").alias("document_id"), F.lit(5).alias("store_object_id"))
    return mutate.delete_links(links, links.filter("document_id % 3 = 0 and document_id < 300")).select(F.col("document_id").alias("id"))


@query("SELECT event_id AS id, CAST(user_id % 3 AS INT) AS store_id, CASE WHEN user_id % 3 = 1 AND event_id % 5 = 0 THEN 'edited' ELSE event_type END AS indexed_string FROM events UNION ALL SELECT -1, 1, 'added'")
def store_objects_upserted(spark, sf_dir):
    """A store's objects replaced or added; those of other stores stay."""
    objects = _objects(spark, sf_dir)
    new = objects.filter("id % 5 = 0").select("id", F.lit("edited").alias("indexed_string"), "indexed_long").unionByName(spark.createDataFrame([(-1, "added", 0)], "id long, indexed_string string, indexed_long long"))
    return mutate.upsert_objects(objects, new, 1).select("id", "store_id", "indexed_string")


@query("SELECT event_id AS id FROM events WHERE NOT (user_id % 3 = 1 AND event_id IN (1, 2, 3, 5, 8, 13, 21, 34))")
def store_objects_deleted(spark, sf_dir):
    objects = _objects(spark, sf_dir)
    return mutate.delete_objects(objects, objects.select(F.col("id").alias("store_object_id")), [1, 2, 3, 5, 8, 13, 21, 34], 1)[1].select(F.col("store_object_id").alias("id"))


@query("SELECT doc_id AS id, CASE WHEN doc_id % 10 = 0 THEN 'Title ' || doc_id ELSE source || '/' || doc_id END AS title, CASE WHEN doc_id % 20 = 0 THEN NULL ELSE lpad(CAST(doc_id AS VARCHAR), 9, '0') END AS supplied_id FROM documents")
def documents_edited(spark, sf_dir):
    d = documents(spark, sf_dir)
    changes = d.filter("id % 10 = 0").select("id", F.concat(F.lit("Title "), "id").alias("title"), F.when(F.col("id") % 20 != 0, F.col("supplied_id")).alias("supplied_id"))
    return mutate.edit(d, changes, write_nulls=True).select("id", "title", "supplied_id")


@query(D + "SELECT id FROM d WHERE (id % 10 = 0) OR (id % 10 <> 0 AND list_contains(t, 'zebrafish'))")
def search_after_edit(spark, sf_dir):
    """Documents whose text was edited are found by their new words, and only their postings are made anew."""
    d = documents(spark, sf_dir)
    postings = index.build_postings(d, [], "simple", offsets=False)
    changes = d.filter("id % 10 = 0").select("id", F.lit("a zebrafish swims").alias("text"))
    after, postings = mutate.edit_indexed(d, postings, changes, analyzer="simple", sorts=selection.SortCache())
    return IndexSearch(postings, after.select("id"), "simple").search(parse("text:zebrafish"))


@query(D + """, f AS (SELECT unnest(['title', 'text', 'meta:lang', 'meta:source']) AS field, unnest([tt, t, regexp_extract_all(lower(lang), '[\\p{L}\\p{N}]+'), regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')]) AS terms FROM d)
SELECT field, CAST(sum(len(terms)) AS BIGINT) AS n_postings, CAST(len(list_distinct(flatten(list(terms)))) AS BIGINT) AS n_terms FROM f GROUP BY field""")
def index_built(spark, sf_dir):
    """The term index and its dictionary, made and written anew; their sizes."""
    path = new_path(spark, "index")
    index.save_index(documents(spark, sf_dir), path, ["lang", "source"], "simple", offsets=False)
    terms_ = spark.read.parquet(f"{path}/dictionary").groupBy("field").agg(F.count("*").alias("n_terms"))
    return spark.read.parquet(f"{path}/postings").groupBy("field").agg(F.count("*").alias("n_postings")).join(terms_, "field")


@query(D + "SELECT id, lang FROM d WHERE list_contains(t, 'idiot')")
def documents_written(spark, sf_dir):
    """Documents written in two loads with their postings, read back and searched."""
    path, d = new_path(spark, "documents"), documents(spark, sf_dir)
    for part in (d.filter("id % 2 = 0"), d.filter("id % 2 = 1")):
        export.write_documents(part, f"{path}/table", "append", f"{path}/postings", ["lang"], "simple", offsets=False)
    back = spark.read.parquet(f"{path}/table")
    search = IndexSearch(spark.read.parquet(f"{path}/postings"), back.select("id"), "simple")
    return back.select("id", "lang").join(search.search(parse("text:idiot")), "id", "left_semi")


@query(D + "SELECT term, CAST(count(DISTINCT id) AS BIGINT) AS n_docs FROM (SELECT id, unnest(t) AS term FROM d WHERE lang <> 'fr') GROUP BY term")
def index_without_documents(spark, sf_dir):
    d = documents(spark, sf_dir).select("id", "text", "lang")
    kept = index.without_documents(index.build_postings(d, [], "simple", offsets=False), d.filter("lang = 'fr'"))
    return index.dictionary(kept).select("term", "n_docs")


@query(D + "SELECT id FROM d WHERE lang = 'fr' AND list_contains(t, 'de')")
def search_reindexed_documents(spark, sf_dir):
    """Postings of some documents lost, and those documents reindexed."""
    d = documents(spark, sf_dir)
    french = d.filter("lang = 'fr'").select("id")
    postings = index.without_documents(index.build_postings(d.filter("lang <> 'fr'"), [], "simple"), french)
    again = index.reindexed(postings, d, analyzer="simple", ids=french)
    return IndexSearch(again, d.select("id"), "simple").search(parse("text:de")).join(french, "id", "left_semi")


@query("SELECT l_orderkey AS file_id FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 10) = 1 AND min(l_suppkey % 10) = 7")
def files_of_one_set(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 10).alias("document_set_id"))
    return mutate.unshared_files(links, 7)


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey % 10) = 1 AND min(l_suppkey % 10) = 7)")
def files_after_set_deleted(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), (F.col("l_suppkey") % 10).alias("document_set_id"))
    return mutate.delete_set({"file": table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), "document_set_file": links}, 7)["file"]


@query("SELECT doc_id AS number, (CAST(3 AS BIGINT) << 32) + 100 + row_number() OVER (ORDER BY doc_id) - 1 AS id FROM documents WHERE doc_id >= 100")
def ids_after_the_last(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("number"))
    there = d.filter("number < 100").select((F.lit(3 << 32) + F.col("number")).alias("id"), F.lit(3).cast("long").alias("document_set_id"))
    return mutate.next_numbers(d.filter("number >= 100"), there, 3, [F.col("number")]).select("number", "id")


@query(f"WITH {DT} SELECT (CAST(77 AS BIGINT) << 32) | doc_id AS document_id, tag_id + 99 AS tag_id FROM dt")
def cloned_tags(spark, sf_dir):
    return mutate.clone({"tag": tag(spark).withColumn("document_set_id", F.lit(0).cast("long")), "document_tag": document_tag(spark, sf_dir)}, 77, 100)["document_tag"].select("document_id", "tag_id")


@query("SELECT * FROM (VALUES ('a', '1'), ('b', '{\"x\": 3}')) v(key, value)")
def store_state(spark, sf_dir):
    state = spark.createDataFrame([("a", "0"), ("b", "2")], "key string, value string")
    return mutate.put_state(mutate.put_state(state, "a", "1"), "b", '{"x": 3}').select("key", "value")


# trees


def _nodes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The root, regions and nations as nodes, their customers as documents."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    bridge = customer.select(F.explode(F.array(F.lit(0), F.col("n_regionkey") + 1, F.col("n_nationkey") + 100).cast("array<bigint>")).alias("node_id"), F.col("c_custkey").alias("document_id"))
    regions = table(spark, sf_dir, "region").select((F.col("r_regionkey") + 1).cast("long").alias("id"), F.lit(0).cast("long").alias("parent_id"))
    nations = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"))
    nodes = spark.createDataFrame([(0, None)], "id long, parent_id long").unionByName(regions).unionByName(nations)
    return settled(nodes.join(bridge.groupBy(F.col("node_id").alias("id")).agg(F.count("*").alias("size")), "id"), "nodes"), bridge


NODES = "WITH b AS (SELECT c_custkey AS document_id, unnest([0, n_regionkey + 1, n_nationkey + 100]) AS node_id FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT 0 AS id, CAST(NULL AS BIGINT) AS parent_id UNION ALL SELECT r_regionkey + 1, 0 FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1 FROM nation), s AS (SELECT node_id AS id, count(*) AS size, min(document_id) AS first_document FROM b GROUP BY node_id) "


@query(NODES + "SELECT CAST(n.id AS BIGINT) AS id, size FROM n JOIN s ON s.id = n.id WHERE parent_id IS NULL OR parent_id = 0")
def tree_top(spark, sf_dir):
    return cluster.tree_levels(_nodes(spark, sf_dir)[0], 0, 1).select("id", "size")


@query(NODES + "SELECT CAST(n.id AS BIGINT) AS id, first_document FROM n JOIN s ON s.id = n.id ORDER BY parent_id NULLS FIRST, size DESC, first_document LIMIT 12")
def children_in_order(spark, sf_dir):
    return cluster.ordered_children(*_nodes(spark, sf_dir)).limit(12).select("id", "first_document")


def _stored_tree(spark: SparkSession, sf_dir: str):
    node, bridge = _nodes(spark, sf_dir)
    tree, number = trees.create_tree(spark.createDataFrame([], trees.COLUMNS), 4, "First")
    stored = spark.createDataFrame([], "id long, root_id long, parent_id long, size long")
    return number, *trees.finish_tree(tree, stored, spark.createDataFrame([], "node_id long, document_id long"), number, node, bridge)


@query(NODES + "SELECT (CAST(4 AS BIGINT) << 32) + n.id AS id, CAST(4 AS BIGINT) << 32 AS root_id, (CAST(4 AS BIGINT) << 32) + parent_id AS parent_id, size FROM n JOIN s ON s.id = n.id")
def tree_stored(spark, sf_dir):
    """A tree created, and a clustering's nodes stored under it: written by set and read back."""
    _, _, node, bridge = _stored_tree(spark, sf_dir)
    path = new_path(spark, "tree")
    trees.write_nodes(node, bridge, path)
    return spark.read.parquet(f"{path}/node").select("id", "root_id", "parent_id", "size")


@query(NODES + "SELECT 'second' AS title, CAST(0 AS DOUBLE) AS progress, 0 AS n_nodes, 0 AS n_links")
def tree_deleted(spark, sf_dir):
    """One of two trees deleted with its nodes; the other renamed, not begun."""
    number, tree, node, bridge = _stored_tree(spark, sf_dir)
    tree, other = trees.create_tree(tree, 4, "x")
    tree, node, bridge = trees.delete_tree(trees.update_tree(tree, other, "second"), node, bridge, number)
    return tree.select("title", "progress", F.lit(node.count()).alias("n_nodes"), F.lit(bridge.count()).alias("n_links"))


@query(SETS + "SELECT o_orderkey AS id, title AS set_title, owner AS user_email FROM orders JOIN s ON s.id = o_custkey WHERE o_orderstatus <> 'F'")
def trees_unfinished(spark, sf_dir):
    tree = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_set_id"), F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.5).alias("progress"))
    return trees.incomplete_trees(tree, *_sets(spark, sf_dir)).select("id", "set_title", "user_email")


@query("SELECT doc_id AS id, doc_id - doc_id % 12 AS component FROM documents")
def components_of_chains(spark, sf_dir):
    """Chains of twelve documents, linked to the one before."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    return components.connected_components(d, d.filter("id % 12 <> 0").select(F.col("id").alias("a"), (F.col("id") - 1).alias("b")))


# vectors


def vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id"), F.concat_ws("-", "l_returnflag", "l_linestatus", F.col("l_suppkey") % 10).alias("term")).agg(F.sum("l_quantity").alias("w"))
    norms = rows.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return settled(rows.join(norms, "id").select("id", "term", (F.col("w") / F.col("norm")).alias("weight")), "vector")


V = """WITH r AS (SELECT l_orderkey AS id, l_returnflag || '-' || l_linestatus || '-' || (l_suppkey % 10) AS term, sum(l_quantity) AS w FROM lineitem GROUP BY 1, 2),
v AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM r),
c0 AS (SELECT id % 6 AS cluster, term, sum(weight) AS w FROM v GROUP BY 1, 2), c AS (SELECT cluster, term, w / sqrt(sum(w * w) OVER (PARTITION BY cluster)) AS weight FROM c0)
"""


@query(V + "SELECT CAST(cluster AS INT) AS cluster, term, round(weight, 9) AS weight FROM c")
def centroids(spark, sf_dir):
    v = vector(spark, sf_dir)
    return vectors.means(v, _by_id(v)).select("cluster", "term", F.round("weight", 9).alias("weight"))


def _by_id(v: DataFrame) -> DataFrame:
    return v.select("id").distinct().select("id", (F.col("id") % 6).cast("int").alias("cluster"))


@query(V + ", d AS (SELECT v.id, c.cluster, sum(v.weight * c.weight) AS dot FROM v JOIN c ON c.term = v.term GROUP BY 1, 2) SELECT id, round(1 - max(dot), 9) AS distance FROM d GROUP BY id")
def nearest_centroids(spark, sf_dir):
    """One step of k-means: each document's nearest centroid, by its distance."""
    v = vector(spark, sf_dir)
    return cluster.nearest(v, vectors.means(v, _by_id(v))).select("id", F.round("distance", 9).alias("distance"))


@query(V + ", d AS (SELECT v.id, c.cluster, sum(v.weight * c.weight) AS dot FROM v JOIN c ON c.term = v.term AND c.cluster = v.id % 6 GROUP BY 1, 2) SELECT CAST(cluster AS INT) AS cluster, round(sum((1 - dot) * (1 - dot)), 6) AS distortion FROM d GROUP BY cluster")
def cluster_distortions(spark, sf_dir):
    v = vector(spark, sf_dir)
    return cluster.distortions(v, _by_id(v)).select("cluster", F.round("distortion", 6).alias("distortion"))


@query(V + "SELECT id, CAST(rank AS INT) AS rank, term, round(weight, 9) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, term) AS rank FROM v) WHERE rank <= 3")
def heaviest_terms(spark, sf_dir):
    return vectors.top_terms(vector(spark, sf_dir), 3).select("id", "rank", "term", F.round("weight", 9).alias("weight"))


@query(DOCS.replace("UNION ALL SELECT id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) FROM y", "") + """, k AS (SELECT term, log10((SELECT count(*) FROM documents) / CAST(n_docs AS DOUBLE)) AS idf FROM df WHERE n_docs >= 3 AND n_docs < (SELECT count(*) FROM documents)),
w AS (SELECT id, term, tf * idf AS w FROM tf JOIN k USING (term)) SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM w""")
def unigram_vectors(spark, sf_dir):
    tf = vectors.term_frequencies(lexed(spark, sf_dir), pairs=False)
    return vectors.vectors(tf, table(spark, sf_dir, "documents").count()).select("id", "term", F.round("weight", 6).alias("weight"))


@query(DOCS + W.replace("tf * idf AS w", "tf AS w") + "SELECT id, term, round(weight, 6) AS weight FROM v")
def frequency_vectors(spark, sf_dir):
    tf = vectors.term_frequencies(lexed(spark, sf_dir))
    return vectors.vectors(tf, table(spark, sf_dir, "documents").count(), use_idf=False).select("id", "term", F.round("weight", 6).alias("weight"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT l_orderkey FROM lineitem)")
def documents_without_vector(spark, sf_dir):
    return vectors.empty_documents(documents(spark, sf_dir), vector(spark, sf_dir))


@query(V + """, b AS (SELECT DISTINCT id % 6 AS node_id, id FROM v), z AS (SELECT node_id, count(*) AS size FROM b GROUP BY node_id),
t AS (SELECT node_id, term, sum(weight) AS w, count(*) AS df, row_number() OVER (PARTITION BY node_id ORDER BY sum(weight) DESC, term) AS r FROM b JOIN v USING (id) GROUP BY node_id, term),
k AS (SELECT node_id, CASE WHEN df = size THEN 'ALL: ' WHEN df >= ceil(size * 0.7) THEN 'MOST: ' ELSE 'SOME: ' END AS kind, string_agg(term, ', ' ORDER BY r) AS terms FROM t JOIN z USING (node_id) WHERE r <= 10 GROUP BY 1, 2)
SELECT node_id, string_agg(kind || terms, '  ' ORDER BY kind) AS description FROM k GROUP BY node_id""")
def node_descriptions(spark, sf_dir):
    """The labels of tree nodes."""
    v = vector(spark, sf_dir)
    bridge = v.select((F.col("id") % 6).alias("node_id"), F.col("id").alias("document_id")).distinct()
    return cluster.node_labels(bridge, v).select("node_id", "description")


STOP = ["thing", "they", "with"]
EMPHASIS = {"^stu": 5.0, "id$": 3.0}


@query(r"""WITH x AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t0 FROM documents),
y AS (SELECT id, unnest(list_transform(t0, lambda w: substr(w, 1, 40))) AS w FROM x),
z AS (SELECT id, w, (CASE WHEN regexp_matches(w, '^stu') THEN 5.0 ELSE 1.0 END) * (CASE WHEN regexp_matches(w, 'id$') THEN 3.0 ELSE 1.0 END) AS f, regexp_matches(w, '^stu') OR regexp_matches(w, 'id$') AS hit FROM y)
SELECT id, w AS term, CAST(sum(f) AS DOUBLE) AS tf FROM z WHERE hit OR (length(w) >= 3 AND NOT (regexp_matches(w, '^[0-9]') AND length(regexp_replace(w, '[^0-9]', '', 'g')) * 10 >= length(w) * 4) AND w NOT IN ("""
       + ", ".join("'" + w.replace("'", "''") + "'" for w in sorted(set(STOP)))
       + ")) GROUP BY 1, 2")
def emphasised_terms(spark, sf_dir):
    """Stop words go, emphasised words weigh more and are kept whatever they are."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").repartition("id").select("id", weighted_terms(terms(F.col("text")), STOP, EMPHASIS).alias("terms"))
    return vectors.term_frequencies(rows, pairs=False)


# text


@query("SELECT page_id AS id, md5(regexp_replace(regexp_replace(html, '\r\n?|\u0085', '\n', 'g'), '[\\x00-\\x08\\x0B-\\x1F\\x7F-\\x{9F}]', ' ', 'g')) AS cleaned FROM pages")
def textified_pages(spark, sf_dir):
    """Pages as bytes, decoded and cleaned."""
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.md5(textify_bytes(F.encode("html", "UTF-8"), "utf-8")).alias("cleaned"))


@query("SELECT doc_id AS id, substr(text, 1, 300) AS text FROM documents")
def truncated_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), truncated(F.col("text"), 300).alias("text"))


@query(r"SELECT doc_id AS id, CAST(len(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: length(w) < 9)) AS BIGINT) AS n FROM documents")
def short_token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.size(short_tokens(terms(F.col("text")), 9)).cast("long").alias("n"))


@query(rf"SELECT doc_id AS id FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{{L}}\p{{M}}\p{{N}}_''’.:])stupid($|[^\p{{L}}\p{{M}}\p{{N}}_''’.:]|[''’.:]($|[^\p{{L}}]))')")
def search_unicode(spark, sf_dir):
    """A search by the default analyser: words as Unicode segments them, folded."""
    d = documents(spark, sf_dir).select("id", "text")
    return IndexSearch(index.build_postings(d), d.select("id")).search(parse("text:STUPID"))


@query("SELECT conv_id AS id FROM conversations GROUP BY conv_id HAVING bool_or(regexp_matches(lower(text), '(^|[^a-zà-ÿ0-9_])tion([^a-zà-ÿ0-9_]|$)'))")
def search_notes(spark, sf_dir):
    """Conversations as documents, their turns as notes."""
    d = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.struct("text")).alias("pdf_notes"))
    d = d.withColumn("text", F.lit("tion"))
    return IndexSearch(index.build_postings(d, [], "simple"), d.select("id"), "simple").search(parse("notes:tion"))


@query(r"""WITH p AS (SELECT doc_id AS id, regexp_split_to_array(text, '(?i)\bstupid\b') AS parts FROM documents),
s AS (SELECT id, list_transform(range(1, len(parts)), lambda i: CAST(list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1) * 6 AS BIGINT)) AS b FROM p WHERE len(parts) > 1)
SELECT id, array_to_string(list_transform(b, lambda x: x || ':' || (x + 6)), ',') AS spans FROM s""")
def highlight_spans(spark, sf_dir):
    found = highlight.highlight_documents(documents(spark, sf_dir), parse("stupid"))
    return found.select("id", F.array_join(F.transform("highlights", lambda h: F.concat_ws(":", h["begin"], h["end"])), ",").alias("spans"))
