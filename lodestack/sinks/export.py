"""Exports: CSV, XLSX, ZIP and JSON, and the rows they hold."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import metadata_value
from ..operators.index import build_postings, save_postings
from ..shared import few

BOM = b"\xef\xbb\xbf"
MOST_ENTRIES, MOST_BYTES = 0xFFFF, 0xFFFFFFFF


def csv_line(values: Iterable) -> str:
    out = []
    for v in values:
        text = "" if v is None else str(v)
        out.append('"' + text.replace('"', '""') + '"' if re.search('[",\r\n]', text) else text)
    return ",".join(out) + "\r\n"


def csv_bytes(rows: DataFrame) -> Iterator[bytes]:
    """One CSV file, streamed partition by partition: byte-order mark, header, CRLF ends, quotes only where needed."""
    yield BOM + csv_line(rows.columns).encode()
    for row in rows.toLocalIterator():
        yield csv_line(row).encode("utf-8", "replace")


def write_csv(rows: DataFrame, path: str) -> None:
    """The same rows as a folder of CSV parts, written by the executors."""
    rows.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="")


def document_columns(metadata_fields: list[str]) -> list[Column]:
    return [F.col("supplied_id").alias("id"), F.col("title"), F.col("text"), F.col("url"), *[metadata_value(F.col("metadata_json"), f).alias(f) for f in metadata_fields]]


def with_string_tags(documents: DataFrame, document_tag: DataFrame, tag: DataFrame, metadata_fields: list[str] = ()) -> DataFrame:
    """Export rows with a column ``tags``: the names, joined by commas in name order."""
    names = few(tag.select(F.col("id").alias("tag_id"), "name"))
    tags = document_tag.join(names, "tag_id").groupBy(F.col("document_id").alias("__id")).agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))
    joined = documents.join(tags, documents["id"] == tags["__id"], "left")
    return joined.select(*document_columns(list(metadata_fields)), F.coalesce("tags", F.lit("")).alias("tags"))


def with_column_tags(documents: DataFrame, document_tag: DataFrame, tag: DataFrame, metadata_fields: list[str] = ()) -> DataFrame:
    """Export rows with a column for each tag: "1" or empty."""
    tags = [(r.id, r.name) for r in tag.select("id", "name").orderBy("name", "id").collect()]  # a set's tags
    marks = document_tag.groupBy(F.col("document_id").alias("__id")).agg(*[F.max(F.when(F.col("tag_id") == i, "1")).alias(f"__t{i}") for i, _ in tags]) if tags else document_tag.select(F.col("document_id").alias("__id")).distinct()
    joined = documents.join(marks, documents["id"] == marks["__id"], "left")
    return joined.select(*document_columns(list(metadata_fields)), *[F.coalesce(f"__t{i}", F.lit("")).alias(name) for i, name in tags])


def tags_csv(counts: DataFrame) -> DataFrame:
    return counts.select("id", "name", F.col("n").alias("count"), "color").orderBy("name", "id")


def _cell(value) -> str:
    text = re.sub(r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "", "" if value is None else str(value))[:32767]
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_xlsx(rows: DataFrame, out: io.BufferedIOBase) -> None:
    """One sheet of text cells, streamed into the archive."""
    package = "http://schemas.openxmlformats.org/package/2006"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="Documents" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        with z.open("xl/worksheets/sheet1.xml", "w") as sheet:
            sheet.write(f'{head}<worksheet xmlns="{main}"><sheetData>'.encode())
            sheet.write(f"<row>{''.join(map(_cell, rows.columns))}</row>".encode())
            for row in rows.toLocalIterator():
                sheet.write(f"<row>{''.join(map(_cell, row))}</row>".encode("utf-8", "replace"))
            sheet.write(b"</sheetData></worksheet>")


def archive_name(title: str, document_id: int, extension: str, page_number: int | None = None) -> str:
    """File name in an archive: the title without a short extension, unsafe characters as ``_``, page and new extension added."""
    stem = re.sub(r"\.[^./\\]{1,4}$", "", title or "") or str(document_id)
    stem = re.sub(r'[\x00-\x1f\x7f<>:"|?*]', "_", stem.replace("\\", "/")).lstrip("/")
    return f"{stem}-p{page_number}.{extension}" if page_number is not None else f"{stem}.{extension}"


def archive_entries(docs: DataFrame) -> DataFrame:
    """(name, text) with names as above, the first document of equal names only."""
    stem = F.regexp_replace(F.coalesce("title", F.lit("")), r"\.[^./\\]{1,4}$", "")
    stem = F.when(stem == "", F.col("id").cast("string")).otherwise(stem)
    clean = F.regexp_replace(F.regexp_replace(F.translate(stem, "\\", "/"), r'[\x00-\x1f\x7f<>:"|?*]', "_"), "^/+", "")
    page = F.when(F.col("page_number").isNotNull(), F.concat(F.lit("-p"), F.col("page_number").cast("string"))).otherwise(F.lit("")) if "page_number" in docs.columns else F.lit("")
    named = docs.select("id", F.concat(clean, page, F.lit(".txt")).alias("name"), "text")
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("name").orderBy("id")))
    return first.filter("r = 1").select("id", "name", "text")


def zip_size(entries: list[tuple[str, int]]) -> int:
    """Exact bytes of an archive of stored entries (name, size)."""
    return 22 + sum(30 + 46 + 2 * len(name.encode()) + size for name, size in entries)


def write_zip(entries: Iterable[tuple[str, bytes]], out: io.BufferedIOBase) -> int:
    """Stored (uncompressed) entries with UTF-8 names; repeated names are skipped.  Returns the number written."""
    seen: set[str] = set()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=False) as z:
        for name, data in entries:
            if name in seen:
                continue
            if len(seen) >= MOST_ENTRIES:
                raise ValueError("too many files for an archive")
            seen.add(name)
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data)
    return len(seen)


def json_documents(docs: DataFrame, columns: list[str]) -> Iterator[str]:
    """A JSON array of documents, streamed, a line each."""
    first = True
    yield "[\n"
    for row in docs.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
        yield row.j if first else ",\n" + row.j
        first = False
    yield "\n]"


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The documents of arrays by json_documents; one file is read by several tasks."""
    lines = spark.read.option("lineSep", "\n").text(path).filter("value not in ('[', ']', '')")
    return lines.select(F.from_json(F.regexp_replace("value", ",$", ""), schema).alias("d")).select("d.*")


def json_ids(docs: DataFrame) -> str:
    return json.dumps([r.id for r in docs.select("id").toLocalIterator()])


def write_documents(docs: DataFrame, path: str, mode: str = "append", index_path: str | None = None, metadata_fields: list[str] = (), analyzer: str = "unicode", offsets: bool = True) -> None:
    """The document table, a folder per document set; with ``index_path`` the documents' postings too, so that searches find them."""
    docs.write.mode(mode).partitionBy("document_set_id").parquet(path)
    if index_path:
        save_postings(build_postings(docs, list(metadata_fields), analyzer, offsets), index_path, mode)
