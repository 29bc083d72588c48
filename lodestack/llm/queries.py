"""The registered queries of this subpackage: one per operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, fingerprint, license_scan, mixing, near_dup, pii, quality, sentencepiece, toxicity, warc

#: Folder of the public vocabulary files.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model(folder: str = TOKENIZERS) -> str:
    return f"{folder}/piece_bpe_32k.model"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_table(spark, sf_dir, "documents"))
    shown = F.transform("matches", lambda m: F.concat_ws(":", m["license"], F.format_number(m["coverage"], 3), m["start"], m["stop"]))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_licenses"), F.array_join(shown, ",").alias("licenses"))


def op2_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write_archive(_table(spark, sf_dir, "pages")).read().drop("url")


def op3_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_personal_data(docs, pii.term_table(docs))
    return found.select("doc_id", *[f"__pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")], F.sha2(F.coalesce("__pii.clean", F.lit("")), 256).alias("clean_sha256"), *[f"__pii.{c}" for c in ("n_secret", "n_entities", "n_terms")])


def op4_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fingerprint.compare_with_next(_table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint.shown(F.col("sketch")).alias("fingerprint"), fingerprint.shown(F.col("edited_sketch")).alias("edited_fingerprint"),
        fingerprint.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), fingerprint.resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        fingerprint.distinct_shingles(F.col("sketch")).alias("n_shingles_estimate"), fingerprint.containment(F.col("sketch"), F.col("edited_sketch")).alias("in_edited"),
    )


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, n, role, "</s>[INST] ok [/INST]") for n, role in enumerate(("user", "assistant"))], rows.schema)
    messages = rows.union(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("parts"))
    return chat.read_back(chat.format_conversations(messages))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents")).drop("digest", "component")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    ratios = quality.log_ratios(docs, _table(spark, sf_dir, "labels"))
    return quality.quality(docs, ratios).select("doc_id", *[f"__quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(_table(spark, sf_dir, "documents"), piece_model(), digest=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_warc_capture_index, op3_pii_sanitisation, op4_bottom_k_fingerprints, op5_chat_formatting, op6_minhash_near_dedup, op7_quality_rules, op8_source_mixing, op9_toxicity, op10_sentencepiece)
    return {f.__name__: f for f in found}


SQL = {
    "op2_warc_capture_index": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS hex, page_id <> first AS again, first FROM p),
b AS (SELECT *, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(hex, CAST(i AS BIGINT), 1)) - 1) AS d FROM h),
g AS (SELECT *, list_transform(range(0, 32), lambda k: list_sum(list_transform(range(0, 5), lambda j: ((d[CAST(((5 * k + j) // 4) + 1 AS BIGINT)] >> CAST(3 - (5 * k + j) % 4 AS INT)) & 1) << CAST(4 - j AS INT)))) AS q FROM b)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(q, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(v AS BIGINT) + 1, 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN first END AS refers_to FROM g""",
    "op5_chat_formatting": """
WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(text) - length(replace(text, chr(92), '')) + 2 * ("""
    + " + ".join(f"(length(text) - length(replace(text, '{c}', ''))) // {len(c)}" for c in chat.CONTROL)
    + f""") AS more FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(chat.BEGIN)} + length(role) + 1 + length(text) + more + {len(chat.END)}) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS attachment_tokens
FROM e GROUP BY conv_id""",
    "op6_minhash_near_dedup": """
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\t\\n\\x0B\\f\\r]+') AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) >= 4 THEN list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]) WHEN len(t) > 0 THEN [array_to_string(t, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
r AS (SELECT doc_id AS id, doc_id AS reach FROM documents UNION SELECT id, b FROM r JOIN l ON reach = a)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT id, min(reach) AS component_id FROM r GROUP BY id) m ON d.doc_id = m.id""",
}


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: hashes of one library, models or random draws.  Tests hold them against brute force."""
    return dict(SQL)
