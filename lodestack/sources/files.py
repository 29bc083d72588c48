"""Files into documents: detection of types, conversion, recursion into containers, and the ingest tables."""

from __future__ import annotations

import email
import email.policy
import html
import io
import mimetypes
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import plugins
from ..functions.text import textify
from ..shared import settled

#: First bytes of common types.
MAGIC = [(b"%PDF-", "application/pdf"), (b"PK\x03\x04", "application/zip"), (b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"{\\rtf", "application/rtf"), (b"\x1f\x8b", "application/gzip"), (b"\xd0\xcf\x11\xe0", "application/x-ole-storage"), (b"<!DOCTYPE html", "text/html"), (b"<html", "text/html")]
MOST_DEPTH = 10
CHILD = "id string, root_id string, parent_id string, index_in_parent int, filename string, content_type string, content binary, text string, metadata_json string, is_document boolean, n_children int, error string"


def detect(filename: str, data: bytes, given: str = "application/octet-stream") -> str:
    """MIME type without parameters: the given one unless it is the general one, then by name, then by first bytes."""
    given = (given or "").partition(";")[0].strip() or "application/octet-stream"
    if given != "application/octet-stream":
        return given
    by_name = mimetypes.guess_type(filename or "")[0]
    by_start = next((t for start, t in MAGIC if data[: len(start)] == start), None)
    return by_name or by_start or given


def detected(filename: Column, content: Column, given: Column) -> Column:
    """``detect`` as a column; only the first bytes go to Python."""

    def types(names: pd.Series, starts: pd.Series, givens: pd.Series) -> pd.Series:
        return pd.Series([detect(n or "", bytes(b or b""), g) for n, b, g in zip(names, starts, givens, strict=True)], dtype=object)

    return F.pandas_udf(types, "string")(filename, F.substring(content, 1, 32), given)


def html_text(page: str) -> str:
    page = re.sub(r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ", page)
    page = re.sub(r"(?i)<(br|/p|/div|/li|/tr|/h[1-6])\b[^>]*>", "\n", page)
    return re.sub(r"[ \t]+", " ", html.unescape(re.sub(r"<[^>]*>", "", page))).strip()


def _text(f: dict) -> list[dict]:
    return [{"text": f["content"].decode("utf-8", "replace")}]


def _html(f: dict) -> list[dict]:
    return [{"text": html_text(f["content"].decode("utf-8", "replace"))}]


def _archive(f: dict) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(f["content"])) as z:
        return [{"filename": i.filename, "content": z.read(i)} for i in z.infolist() if not i.is_dir()]


def _email(f: dict) -> list[dict]:
    message = email.message_from_bytes(f["content"], policy=email.policy.default)
    body = message.get_body(("plain", "html"))
    content = body.get_content() if body is not None else ""
    head = "".join(f"{k}: {message[k]}\n" for k in ("From", "To", "Cc", "Date", "Subject") if message[k])
    text = html_text(content) if body is not None and body.get_content_subtype() == "html" else content
    files = [{"filename": a.get_filename() or "attachment", "content_type": a.get_content_type(), "content": a.get_payload(decode=True) or b""} for a in message.iter_attachments()]
    return [{"text": f"{head}\n{text}", "filename": f["filename"]}, *files]


BUILT_IN = {"text/html": _html, "application/xhtml+xml": _html, "application/zip": _archive, "message/rfc822": _email, "text/*": _text}


def step_for(content_type: str):
    """A registered converter, a built-in one, or None for types that aren't handled."""
    return plugins.converter_for(content_type) or BUILT_IN.get(content_type) or (BUILT_IN["text/*"] if content_type.startswith("text/") else None)


def convert_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each file's outputs: the file itself with its fate, and its children.  A failure keeps the children made before it."""
    names = [x.split()[0] for x in CHILD.split(", ")]
    for batch in batches:
        rows = []
        for f in batch.to_dict("records"):
            data = bytes(f["content"] or b"")
            kind = detect(f["filename"], data, f["content_type"])
            step, children, text, error = step_for(kind), [], None, None
            if step is None:
                error = f"unhandled: {kind}"
            else:
                try:
                    for n, out in enumerate(step({**f, "content": data, "content_type": kind})):
                        if out.get("text") is not None and n == 0:
                            text = out["text"]
                        else:
                            children.append(out)
                except Exception as e:  # noqa: BLE001  the converter's fault is recorded with the file
                    error = f"{type(e).__name__}: {e}"
            root = f["root_id"] or f["id"]
            rows.append((f["id"], f["root_id"], f["parent_id"], f["index_in_parent"], f["filename"], kind, None, text, f["metadata_json"], text is not None and error is None, len(children), error))
            for n, c in enumerate(children):
                name = c.get("filename") or f"{f['filename']}/{n}"
                rows.append((f"{f['id']}/{n}", root, f["id"], n, name, c.get("content_type") or "application/octet-stream", c.get("content") or (c.get("text") or "").encode(), None, c.get("metadata_json") or f["metadata_json"], None, None, None))
        yield pd.DataFrame(rows, columns=names)


def read_files(spark: SparkSession, path: str, metadata_json: str = "{}") -> DataFrame:
    """Root files of a folder with their SHA-1."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    none = lambda kind: F.lit(None).cast(kind)
    return raw.select(F.col("path").alias("id"), none("string").alias("root_id"), none("string").alias("parent_id"), F.lit(0).alias("index_in_parent"), name.alias("filename"), F.lit("application/octet-stream").alias("content_type"), "content", F.lit(metadata_json).alias("metadata_json"), F.sha1("content").alias("sha1"))


INPUT = ["id", "root_id", "parent_id", "index_in_parent", "filename", "content_type", "content", "metadata_json"]


def process(files: DataFrame, most_depth: int = MOST_DEPTH) -> DataFrame:
    """Every file and all files in it, converted (columns CHILD without content): rounds of conversion until no container is left."""
    done, todo = None, files.select(*INPUT)
    for _ in range(most_depth):
        out = settled(todo.mapInPandas(convert_rows, CHILD))
        finished = out.filter(F.col("is_document").isNotNull())
        done = finished if done is None else done.unionByName(finished)
        fresh = out.filter(F.col("is_document").isNull())
        if not fresh.limit(1).count():
            return done.drop("content")
        todo = fresh.select(*INPUT)
    deep = fresh.withColumns({"is_document": F.lit(False), "n_children": F.lit(0), "error": F.lit("unhandled: nested too deeply")})
    return done.unionByName(deep).drop("content")


def page_number(metadata_json: Column) -> Column:
    """``pageNumber`` of file metadata if it is a JSON number, rounded half away from zero; null for texts, booleans and what isn't an int."""
    value = F.try_variant_get(F.try_parse_json(_plain(metadata_json)), "$.pageNumber", "variant")
    is_number = F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
    return F.when(is_number, F.round(F.try_variant_get(value, "$", "double")).try_cast("int"))


def is_from_ocr(metadata_json: Column) -> Column:
    """``isFromOcr`` of file metadata if it is a JSON boolean, else false."""
    value = F.try_variant_get(F.try_parse_json(_plain(metadata_json)), "$.isFromOcr", "variant")
    return F.when(F.schema_of_variant(value) == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).otherwise(F.lit(False))


def _plain(metadata_json: Column) -> Column:
    return F.regexp_replace(metadata_json, r"\\u0000", "")


def ingest(processed: DataFrame, existing: DataFrame, document_set_id: int) -> tuple[DataFrame, DataFrame]:
    """(documents, errors) of processed files that aren't ingested yet.  Run again it adds nothing."""
    from .csv_documents import next_numbers

    fresh = processed.join(existing.select(F.col("supplied_id").alias("id")).distinct(), "id", "left_anti")
    rows = fresh.filter("is_document").select(F.col("id").alias("supplied_id"), F.col("filename").alias("title"), textify(F.col("text")).alias("text"), "metadata_json")
    documents = next_numbers(rows, existing, document_set_id, [F.col("supplied_id")]).withColumns({"document_set_id": F.lit(document_set_id).cast("long"), "page_number": page_number(F.col("metadata_json")), "is_from_ocr": is_from_ocr(F.col("metadata_json"))})
    errors = fresh.filter("error is not null").select(F.lit(document_set_id).cast("long").alias("document_set_id"), F.col("id").alias("file2_id"), F.col("filename").alias("text_url"), F.col("error").alias("message"))
    return documents, errors
