"""CSV uploads as documents."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import pack
from ..operators.mutate import next_numbers, tag_color
from ..operators.sorting import positioned
from ..shared import few, settled

MOST_METADATA = 100
#: Larger files are read in parallel, by blocks; others whole, in one task each.
MOST_WHOLE = 32 << 20
#: Rows of a large file go to Spark in parts of about so many characters.
PART = 4 << 20
#: Header names, lower-cased, that aren't metadata; the first there is of the text names gives the text.
TEXT_NAMES = ("text", "contents", "snippet")
NAMES = ("id", "url", "title", "tags", *TEXT_NAMES)


class CsvScanner:
    """Lenient push scanner of CSV text.

    Line feeds, carriage returns and their pair end a row; empty rows are skipped.  A quote opens quoting wherever it
    stands in a value; inside, two quotes are one, and what follows a closing quote belongs to the value.  Further line
    ends may be named: previews take U+0085 for one.
    """

    def __init__(self, more_ends: str = ""):
        self._ends = "\r\n" + more_ends
        self.rows: list[list[str]] = []
        self._row: list[str] = []
        self._value: list[str] = []
        self._quoted = self._closing = self._after_return = False

    def write(self, text: str) -> None:
        for c in text:
            if self._closing:
                self._closing = False
                if c == '"':
                    self._value.append(c)
                    continue
                self._quoted = False
            if self._quoted:
                if c == '"':
                    self._closing = True
                else:
                    self._value.append(c)
            elif c == "\n" and self._after_return:
                pass
            elif c == '"':
                self._quoted = True
            elif c == ",":
                self._row.append(self._take())
            elif c in self._ends:
                self._end_row()
            else:
                self._value.append(c)
            self._after_return = c == "\r" and not self._quoted

    def end(self) -> bool:
        """Finish; whether the text was complete, that is did not end inside quotes."""
        whole = not self._quoted or self._closing
        self._end_row()
        self._quoted = self._closing = False
        return whole

    def _take(self) -> str:
        value = "".join(self._value)
        self._value.clear()
        return value

    def _end_row(self) -> None:
        if self._row or self._value:
            self._row.append(self._take())
            self.rows.append(self._row)
            self._row = []


def scan_csv(text: str) -> tuple[list[list[str]], bool]:
    """The rows of a CsvScanner, and whether the text was complete; by pieces between quotes, not by characters."""
    rows: list[list[str]] = []
    row: list[str] = []
    value: list[str] = []
    pieces = text.split('"')
    for i, piece in enumerate(pieces):
        if i % 2:
            value.append(piece)
        elif not piece and 0 < i < len(pieces) - 1:
            value.append('"')  # two quotes inside quotes
        else:
            for j, line in enumerate(re.split("[\r\n]", piece)):
                if j:
                    if row or any(value):
                        rows.append([*row, "".join(value)])
                    row, value = [], []
                first, *more = line.split(",")
                value.append(first)
                for field in more:
                    row.append("".join(value))
                    value = [field]
    if row or any(value):
        rows.append([*row, "".join(value)])
    return rows, len(pieces) % 2 == 1


def preview_csv(text: str, most_rows: int = 100) -> tuple[list[str], list[dict[str, str]]]:
    """Header and first rows of the beginning of a file, which may end anywhere.  Raises ValueError without a header."""
    scanner = CsvScanner("\u0085")
    scanner.write(text.removeprefix("\ufeff"))
    scanner.end()
    if not scanner.rows:
        raise ValueError("a CSV file needs a header")
    header, *rows = scanner.rows
    return header, [dict(zip(header, [*row, *[""] * len(header)], strict=False)) for row in rows[:most_rows]]


def read_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of CSV files by Spark's parallel reader: quoted line ends, doubled quotes, header first.  All columns are strings."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', encoding=encoding, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_csv_leniently(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """(path, row_number, header, row, whole) as CsvScanner has them: for files whose quoting Spark's reader doesn't take.

    One task per file; a UTF-8 file over MOST_WHOLE bytes is read by blocks.  Bytes that aren't valid in the encoding are
    replaced.  ``row_number`` is the row's place in its file.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            for name, data in zip(batch.path, batch.content, strict=True):
                rows, whole = scan_csv(bytes(data).decode(encoding, "replace").removeprefix("\ufeff"))
                header = rows[0] if rows else []
                yield pd.DataFrame({"path": name, "row_number": range(1, len(rows)), "header": [header] * (len(rows) - 1), "row": rows[1:], "whole": whole}, columns=["path", "row_number", "header", "row", "whole"])

    found = spark.read.format("binaryFile").load(path)
    large = []
    if codecs.lookup(encoding).name == "utf-8":  # in which a quote or a line end is no part of another character
        large = [r.path for r in found.filter(F.col("length") > MOST_WHOLE).select("path").orderBy("path").collect()]
        found = found.filter(F.col("length") <= MOST_WHOLE) if large else found
    out = found.select("path", "content").mapInPandas(run, "path string, row_number long, header array<string>, row array<string>, whole boolean")
    for one in large:
        out = _large_rows(spark, one).unionByName(out)
    return out


def _block_pieces(lines: DataFrame, inside: dict[int, bool], survey: bool) -> DataFrame:
    """Blocks cut into records, a record being the lines up to one that ends outside quotes.

    (block, number, row) of the records that lie in one block; with ``survey`` instead (block, n, first, head, tail): the number of
    those rows and the first, and the bytes before the first record's begin and from the last one's, which other blocks have
    the rest of.  ``inside``: whether a block begins inside quotes.
    """
    strings, most = pa.list_(pa.string()), PART

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """(block, rows, head, tail), several a block; head or tail is given once."""
        at = None
        for batch in batches:
            done, held = [], 0
            for block, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != at:
                    if done:
                        yield at, done, None, None
                    if at is not None and record:  # noqa: F821
                        yield at, [], None, (b"\n".join(record), starts)  # noqa: F821
                    at, within, starts, record, done, held = block, inside[block], not inside[block], [], [], 0
                record.append(line)
                if line.count(b'"') % 2:
                    within = not within
                if not within:
                    whole = b"\n".join(record)
                    record = []
                    if starts:
                        done += scan_csv(whole.decode("utf-8", "replace"))[0]
                        held += len(whole)
                    else:
                        yield at, [], whole, None
                    starts = True
                    if held > most:
                        yield at, done, None, None
                        done, held = [], 0
            if done:
                yield at, done, None, None
        if at is not None and record:
            yield at, [], None, (b"\n".join(record), starts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, number = None, 0
        for block, done, _, _ in blocks(batches):
            number = number if block == at else 0
            at = block
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([block] * len(done), pa.int64()), pa.array(range(number, number + len(done)), pa.int64()), pa.array(done, strings)], ["block", "number", "row"])
            number += len(done)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, done, head, tail in blocks(batches):
            tail, starts = tail or (None, None)
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in ((block, pa.int64()), (len(done), pa.int64()), (done[0] if done else None, strings), (head, pa.binary()), (tail, pa.binary()), (starts, pa.bool_()))], ["block", "n", "first", "head", "tail", "starts"])

    if survey:
        return lines.mapInArrow(summed, "block long, n long, first array<string>, head binary, tail binary, starts boolean")
    return lines.mapInArrow(rows, "block long, number long, row array<string>")


def _last_line_end(spark: SparkSession, path: str) -> bytes:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.open(hadoop)
    try:
        stream.seek(fs.getFileStatus(hadoop).getLen() - 1)
        return b"\n" if stream.read() == 10 else b""
    finally:
        stream.close()


def _large_rows(spark: SparkSession, path: str) -> DataFrame:
    """read_csv_leniently of one UTF-8 file by blocks, in three passes: quotes by block, rows by block, rows.

    A block's state is the parity of the quotes before it.  A record that goes on in other blocks is joined apart: a piece or
    two a block.  The driver holds a few numbers a block.
    """
    line = F.col("value")
    read = spark.read.option("lineSep", "\n").text(re.sub(r"([\[\]{}*?\\])", r"\\\1", path)).select(F.col("_metadata.file_block_start").alias("block"), line)
    quotes = F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))
    odd = sorted((r.block, r.n % 2) for r in read.groupBy("block").agg(F.sum(quotes).alias("n")).collect())
    before = list(accumulate((n for _, n in odd), initial=0))
    inside = {block: n % 2 == 1 for (block, _), n in zip(odd, before, strict=False)}
    lines = read.select("block", line.cast("binary").alias("line"))
    survey = settled(_block_pieces(lines, inside, True), "csv-blocks")
    ends = survey.filter("head is not null or tail is not null").select("block", "starts", F.col("tail").isNotNull().alias("open")).collect()
    # a piece belongs to the block in which its record begins
    owner, last = [], None
    for r in sorted(ends, key=lambda r: (r.block, r.open)):
        last = r.block if r.open and r.starts else last
        owner.append((r.block, r.open, last))
    pieces = survey.filter("head is not null or tail is not null").select("block", F.col("tail").isNotNull().alias("open"), F.coalesce("tail", "head").alias("bytes"))
    owners = spark.createDataFrame(owner, "block long, open boolean, owner long")
    whole = before[-1] % 2 == 0
    unread = {} if whole else {last: _last_line_end(spark, path)}  # by the line reader, and inside quotes

    def joined(group):
        import pandas as pd

        text = b"\n".join(map(bytes, group.sort_values(["block", "open"]).bytes)) + unread.get(group.owner.iloc[0], b"")
        found = scan_csv(text.decode("utf-8", "replace"))[0]
        return pd.DataFrame({"block": group.owner.iloc[0], "number": range(len(found)), "row": found}, columns=["block", "number", "row"])

    across = settled(pieces.join(F.broadcast(owners), ["block", "open"]).groupBy("owner").applyInPandas(joined, "block long, number long, row array<string>"), "csv-across")
    n = {r.block: r.n for r in survey.groupBy("block").agg(F.sum("n").alias("n")).collect()}
    more = {r.block: r.n for r in across.groupBy("block").agg(F.count("*").alias("n")).collect()}
    blocks = [b for b, _ in odd]
    base = list(accumulate((n.get(b, 0) + more.get(b, 0) for b in blocks), initial=0))
    first = next((b for b in blocks if n.get(b, 0) or more.get(b, 0)), None)
    header = []
    if first is not None:
        own = survey.filter((F.col("block") == first) & F.col("first").isNotNull())
        header = own.first()["first"] if n.get(first) == own.count() == 1 else None
        header = header or (_block_pieces(lines.filter(F.col("block") == first), inside, False) if n.get(first) else across.filter(F.col("block") == first)).filter("number = 0").first()["row"]
    at = spark.createDataFrame([(b, base[i], base[i] + n.get(b, 0)) for i, b in enumerate(blocks)], "block long, base long, after long")
    rows = _block_pieces(lines, inside, False).join(F.broadcast(at), "block").select((F.col("base") + F.col("number")).alias("row_number"), "row")
    rows = rows.unionByName(across.join(F.broadcast(at), "block").select((F.col("after") + F.col("number")).alias("row_number"), "row"))
    return rows.filter("row_number > 0").select(F.lit(path).alias("path"), "row_number", F.array(*map(F.lit, header)).cast("array<string>").alias("header"), "row", F.lit(whole).alias("whole"))


def named_rows(rows: DataFrame) -> DataFrame:
    """Rows of read_csv_leniently of files with one header as columns by its names, with ``__order``, their place."""
    header = rows.select("header").first()
    names = list(dict.fromkeys(header.header)) if header else []
    at = {n: header.header.index(n) for n in names}
    return rows.select(F.struct("path", "row_number").alias("__order"), *[F.coalesce(F.get("row", F.lit(at[n])), F.lit("")).alias(n or "_c") for n in names])


def import_errors(rows: DataFrame, document_set_id: int) -> DataFrame:
    """An error row for each file that isn't whole CSV: it ends inside quotes."""
    bad = rows.filter("not whole").select("path").distinct()
    return bad.select(F.lit(document_set_id).cast("long").alias("document_set_id"), F.col("path").alias("text_url"), F.lit("CSV file ends inside a quoted value").alias("message"))


def to_documents(rows: DataFrame) -> DataFrame:
    """supplied_id, url, title, text, metadata_json, tags of CSV rows.

    Header names don't depend on case.  Other columns become metadata, at most 100 of them, the first of equal names;
    nameless ones are dropped.  Missing values are empty.
    """
    by_name: dict[str, str] = {}
    metadata: dict[str, str] = {}
    for c in rows.columns:
        if c == "__order":
            continue
        if c.lower() in NAMES:
            by_name.setdefault(c.lower(), c)
        elif c and not c.startswith("_c"):
            metadata.setdefault(c, c)
    value = lambda name: F.coalesce(F.col(f"`{by_name[name]}`"), F.lit("")) if name in by_name else F.lit("")
    text = next((value(n) for n in TEXT_NAMES if n in by_name), F.lit(""))
    fields = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in list(metadata)[:MOST_METADATA]]
    place = [F.col("__order")] if "__order" in rows.columns else []
    return rows.select(*place, value("id").alias("supplied_id"), value("url").alias("url"), value("title").alias("title"), text.alias("text"), (F.to_json(F.struct(*fields)) if fields else F.lit("{}")).alias("metadata_json"), tag_names(value("tags")).alias("tags"))


def tag_names(tags: Column) -> Column:
    """Names of a comma list: trimmed, not empty, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(tags, ","), lambda t: F.regexp_replace(t, r"^\s+|\s+$", "")), lambda t: t != ""))


def import_documents(rows: DataFrame, existing: DataFrame, tag: DataFrame, document_set_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """New documents with ids after the set's last, new tags, and document-tag rows.

    Rows get ids in the order of ``__order``, their place in the file, if they have one.  Rows whose supplied id is there
    already are skipped, so an import can be run again.
    """
    known = existing.filter(F.col("document_set_id") == document_set_id).select("supplied_id").distinct()
    fresh = rows.filter("supplied_id = ''").unionByName(rows.filter("supplied_id <> ''").join(known, "supplied_id", "left_anti").select(*rows.columns))
    order = [F.col(c) for c in (["__order"] if "__order" in rows.columns else ["title", "supplied_id", "text"])]
    documents = next_numbers(fresh, existing, document_set_id, order).withColumn("document_set_id", F.lit(document_set_id).cast("long")).drop("__order")
    names = settled(documents.select("id", F.explode("tags").alias("name")).withColumn("name", F.substring("name", 1, 100)).distinct(), "tag-names")
    top = tag.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    new = positioned(names.select("name").distinct().join(tag, "name", "left_anti"), [F.col("name")])
    color = F.udf(lambda name: tag_color(name), "string")  # one call a new tag
    fresh_tags = new.select((F.col("pos") + top + 1).cast("long").alias("id"), "name", color("name").alias("color"))
    tags = settled(tag.select(F.col("id").cast("long").alias("id"), "name", "color").unionByName(fresh_tags), "tags")
    links = names.join(few(tags.select(F.col("id").alias("tag_id"), "name")), "name").select(F.col("id").alias("document_id"), "tag_id")
    return documents.drop("tags"), tags, links


def numbered(rows: DataFrame, document_set_id: int, first: int, order: list[Column]) -> DataFrame:
    return positioned(rows, order, "__n").withColumn("id", pack(F.lit(document_set_id), F.col("__n") + first)).drop("__n")
