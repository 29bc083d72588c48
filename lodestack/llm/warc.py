"""WARC archives with a two-level capture index.

Pages become records of gzip-per-record WARC files; a page whose payload equals that of a page with a smaller id becomes a
revisit of it.  The index has a line per capture, keyed by the URL with its host reversed.  Lines are range-sorted and cut
into compressed blocks of BLOCK_LINES; a sparse directory has one row per block (first key, file, offset, length).
A lookup sends each key to the index files whose range may hold it; there it binary-searches that file's part of the
directory, unpacks the blocks that may hold the key and range-reads the records.  Reading a whole archive is a lookup of
all its keys.

Files go to the cluster's shared folder through pyarrow's file systems.  A task writes files of fresh names and returns
where its records are; only what the returned table names counts, so files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import BROADCAST_IDS, joined_by_size, new_path, qualified, settled
from . import hashing

BLOCK_LINES = 256
#: Captures of one index file, and bytes of their records, about: a file is read back by one task.
PART_LINES, PART_BYTES, MOST_FILES = 16 * BLOCK_LINES, 1 << 28, 1 << 16
FILE_BYTES = 1 << 30
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PORTS = {"http": 80, "https": 443}


def url_key(url: str | None) -> str:
    """Reversed host, then path and sorted query, lower-cased; scheme, ``www.``, default port and fragment don't count."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    port = "" if port in (None, PORTS.get(parts.scheme)) else f":{port}"
    query = "?" + "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){(parts.path or '/')}{query}".lower()


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, url: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}/{digest}/{url}')}>"


def _line(value: str) -> str:
    """A header value: control characters percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) < 32 or ord(c) == 127 else c for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers: tuple[int, str] | None) -> bytes:
    """One uncompressed record.  refers: page id and URL of the response that a revisit refers to."""
    url, digest = _line(url or ""), payload_digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest, url)}", f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    head += [f"X-Page-ID: {page_id}"] if page_id is not None else []
    if refers:
        other = _line(refers[1] or "")
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers[0], digest, other)}", f"WARC-Refers-To-Target-URI: {other}", f"X-Refers-To-Page-ID: {refers[0]}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """Headers (lower-cased names), HTTP headers and payload of a record; payload is None for a revisit."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": None if headers["warc-type"] == "revisit" else payload}


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


CAPTURE = "page_id long, key string, url string, record_type string, digest string, file string, offset long, length long"


def _write_records(folder: str):
    @hashing.returning_memory
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, out, at = "", None, 0
        for batch in batches:
            rows = []
            for page_id, url, html, first, first_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"pages-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                payload = (html or "").encode("utf-8", "surrogatepass")
                refers = (first, first_url) if first is not None else None
                data = gzip.compress(build_record(page_id, url, payload, refers), 6, mtime=0)
                out.write(data)
                rows.append((page_id, url_key(url), url, "revisit" if refers else "response", payload_digest(payload), name, at, len(data)))
                at += len(data)
            names = [x.split()[0] for x in CAPTURE.split(", ")]
            kinds = [pa.int64() if " long" in x else pa.string() for x in CAPTURE.split(", ")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
        if out is not None:
            out.close()

    return run


DIRECTORY = "first_key string, last_key string, file string, offset long, length long, lines long, record_bytes long"


def _write_blocks(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        name, at, lines, keys, found = f"captures-{uuid.uuid4().hex}.gz", 0, [], [], []
        out, records = None, 0

        def flush() -> None:
            nonlocal at, out, records
            if lines:
                out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                data = zlib.compress("\n".join(lines).encode("utf-8", "surrogatepass"))
                out.write(data)
                found.append((keys[0], keys[-1], name, at, len(data), len(lines), records))
                at += len(data)
                records = 0
                lines.clear()
                keys.clear()

        for batch in batches:
            for row in batch.to_pylist():
                keys.append(row.pop("key"))
                lines.append(json.dumps([keys[-1], *row.values()]))
                records += row["length"]
                if len(lines) >= BLOCK_LINES:
                    flush()
        flush()
        if out is not None:
            out.close()
        names = [x.split()[0] for x in DIRECTORY.split(", ")]
        kinds = [pa.int64() if " long" in x else pa.string() for x in DIRECTORY.split(", ")]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    return run


class _Reader:
    """Range reads with the last file kept open."""

    def __init__(self, folder: str):
        self.fs, self.root = _open(folder)
        self.name, self.file = "", None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.fs.open_input_file(f"{self.root}/{name}")
        self.file.seek(offset)
        return self.file.read(length)


def _captures(block: bytes) -> list[dict]:
    names = ["key", "page_id", "url", "record_type", "digest", "file", "offset", "length"]
    return [dict(zip(names, json.loads(x), strict=True)) for x in zlib.decompress(block).decode("utf-8", "surrogatepass").split("\n")]


def _described(record: dict) -> tuple:
    h = record["headers"]
    number = lambda k: int(h[k]) if k in h else None
    payload = record["payload"]
    size = len(payload) if payload is not None else int(record["http"]["content-length"])
    digest = payload_digest(payload) if payload is not None else h["warc-payload-digest"].removeprefix("sha1:")
    return number("x-page-id"), size, digest, h["warc-type"], number("x-refers-to-page-id"), h["warc-target-uri"]


WANTED = "file string, key string, last_key string, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
#: Rows of one output batch, and payload bytes, about.
ROWS_OUT, BYTES_OUT = 512, 8_000_000


def _to_files(bounds: list[tuple[str, str, str]]):
    """URLs -> (file, key) for each index file (first key, last key, file; sorted) whose range may hold the key."""
    firsts, lasts = [b[0] for b in bounds], [b[1] for b in bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key in dict.fromkeys(map(url_key, batch.column(0).to_pylist())):
                # files are ranges of (key, page): only neighbours may share a key
                out += [(bounds[i][2], key) for i in range(bisect.bisect_left(lasts, key), bisect.bisect_right(firsts, key))]
            yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in out], pa.string()), pa.array([k for _, k in out], pa.string())], ["file", "key"])

    return run


def _find(records: str, index: str, payloads: bool):
    """Rows of WANTED, sorted: a file's directory (rows with a length) before the keys that are looked for in it -> records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, archive = _Reader(index), _Reader(records)
        file, firsts, directory = None, [], []
        keys: set[str] = set()
        held: tuple[int, list[dict]] = (-1, [])
        out: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()] + [pa.binary()] * payloads
            names = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * payloads
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)
            out.clear()
            return made

        def wanted_of_held() -> Iterator[pa.RecordBatch]:
            nonlocal size
            for c in sorted((c for c in held[1] if c["key"] in keys), key=lambda c: (c["file"], c["offset"])):
                record = parse_record(gzip.decompress(archive.read(c["file"], c["offset"], c["length"])))
                out.append((*_described(record), *([record["payload"]] if payloads else [])))
                size += len(record["payload"] or b"") if payloads else 0
                if len(out) >= ROWS_OUT or size >= BYTES_OUT:
                    size = 0
                    yield batch_of()

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != file:
                    yield from wanted_of_held()
                    file, firsts, directory, keys, held = row["file"], [], [], set(), (-1, [])
                if row["length"] is not None:
                    firsts.append(row["key"])
                    directory.append(row)
                    continue
                key = row["key"]
                at = max(0, bisect.bisect_left(firsts, key) - 1)
                while at < len(firsts) and firsts[at] <= key:
                    if directory[at]["last_key"] >= key:
                        if held[0] != at:
                            yield from wanted_of_held()
                            d = directory[at]
                            keys, held = set(), (at, _captures(blocks.read(file, d["offset"], d["length"])))
                        keys.add(key)
                    at += 1
        yield from wanted_of_held()
        if out:
            yield batch_of()

    return hashing.returning_memory(run)


@dataclass
class Archive:
    """A written archive: folders of record and index files, the directory (a table of DIRECTORY), and the URLs it was made from."""

    records: str
    index: str
    directory: DataFrame
    urls: DataFrame

    def lookup(self, urls: DataFrame, payloads: bool = False) -> DataFrame:
        """Captures of the URLs in the first column: a row of RECORD each, with ``payloads`` the payload too (null for a revisit).

        The driver holds a range of keys for each index file, of which there are MOST_FILES at most.  A key meets the directory rows of the files whose range may
        hold it, so a key of many captures is read by as many tasks as there are files of it.
        """
        files = self.directory.groupBy("file").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last"), F.sum("record_bytes").alias("n")).collect()
        bounds = sorted((r["first"], r["last"], r["file"]) for r in files)
        keys = urls.select(F.col(urls.columns[0]).cast("string").alias("url")).mapInArrow(_to_files(bounds), "file string, key string").distinct()
        nothing = F.lit(None).cast("long")
        keys = keys.select("file", "key", F.lit(None).cast("string").alias("last_key"), nothing.alias("offset"), nothing.alias("length"))
        both = self.directory.select("file", F.col("first_key").alias("key"), "last_key", "offset", "length").unionByName(keys)
        order = ["file", F.col("length").isNull(), "key", F.col("offset")]
        dealt = both.repartition(max(1, len(bounds)), "file").sortWithinPartitions(*order)
        return dealt.mapInArrow(_find(self.records, self.index, payloads), RECORD + ", payload binary" * payloads)

    def read(self) -> DataFrame:
        """Every record, read back by looking up all the URLs: a row of RECORD each."""
        return self.lookup(self.urls)


def write_archive(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> Archive:
    """Write pages to WARC files and index them.

    Of pages with equal payloads of at least ``least_bytes`` the one with the smallest id is a response and the others
    revisit it; smaller payloads are all responses.  A null payload is empty, a null URL has an empty key.  A page without
    an id is always a response and nothing refers to it.  Repeated rows of one id are responses alike.  Further columns
    are ignored.
    """
    spark = pages.sparkSession
    hashing.small_batches(spark)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(text_col).alias("html"))
    digest = F.sha1(F.coalesce("html", F.lit("")))
    size = F.octet_length(F.coalesce("html", F.lit("")))
    small = rows.filter(F.col("page_id").isNotNull() & (size >= least_bytes)).select("page_id", "url", digest.alias("sha"))
    first = settled(small.groupBy("sha").agg(F.min_by(F.struct("page_id", "url"), "page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1"), "repeated")
    again = joined_by_size(small, first, "sha").filter("page_id <> first.page_id")
    repeats = again.select(F.col("page_id").alias("__id"), F.col("sha").alias("__sha"), F.col("first.page_id").alias("first"), F.col("first.url").alias("first_url"))
    repeats = settled(repeats.distinct(), "repeats")
    repeats = F.broadcast(repeats) if repeats.count() <= BROADCAST_IDS // 8 else repeats
    records, index = (qualified(spark, new_path(spark, name)) for name in ("warc", "capture-index"))
    joined = rows.join(repeats, (rows["page_id"] == F.col("__id")) & (digest == F.col("__sha")), "left").select("page_id", "url", "html", "first", "first_url")
    captures = settled(joined.mapInArrow(_write_records(records), CAPTURE), "captures")
    n, size = captures.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    parts = max(1, min(MOST_FILES, max(-(-n // PART_LINES), -(-size // PART_BYTES))))
    ordered = captures.select("key", "page_id", "url", "record_type", "digest", "file", "offset", "length").repartitionByRange(parts, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")
    return Archive(records, index, settled(ordered.mapInArrow(_write_blocks(index), DIRECTORY), "directory"), rows.select("url"))
