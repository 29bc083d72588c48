"""Blobs: whole files at ``scheme:container:key`` or at paths, in any file system that Hadoop knows."""

from __future__ import annotations

import contextlib
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import removed

CHUNK = 1 << 20


def blob_path(location: str, roots: dict[str, str]) -> str:
    """Path of ``file:container:key`` or ``s3:bucket:key``; roots: the folder or scheme of each, as {"file": "/data", "s3": "s3a:/"}."""
    scheme, container, key = location.split(":", 2)
    if scheme not in roots or not container or not key or ".." in key.split("/"):
        raise ValueError(f"blob location {location!r}")
    return f"{roots[scheme].rstrip('/')}/{container}/{key}"


def _file(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def read_blobs(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """path, length, content of many blobs, read by the executors."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "content")


def first_bytes(content: Column, n: int) -> Column:
    return F.substring(content, 1, n)


def stream_blob(spark: SparkSession, path: str, chunk: int = CHUNK) -> Iterator[bytes]:
    """A blob's bytes, a part at a time."""
    fs, hadoop = _file(spark, path)
    size, at = fs.getFileStatus(hadoop).getLen(), 0
    stream = fs.open(hadoop)
    try:
        while at < size:
            part = bytes(stream.readNBytes(min(chunk, size - at)))
            at += len(part)
            yield part
    finally:
        stream.close()


def get_bytes(spark: SparkSession, path: str, most: int) -> bytes:
    """The first ``most`` bytes of one blob."""
    fs, hadoop = _file(spark, path)
    stream = fs.open(hadoop)
    try:
        return bytes(stream.readNBytes(most))
    finally:
        stream.close()


def blob_url(path: str) -> str | None:
    """A link that a browser can follow; None where a blob has to be read through this program."""
    return path if path.startswith(("http://", "https://")) else None


@contextlib.contextmanager
def blob_in_file(spark: SparkSession, path: str) -> Iterator[str]:
    """A local copy for a program that wants a file; it goes afterwards."""
    with tempfile.NamedTemporaryFile(prefix="blob-") as f:
        for part in stream_blob(spark, path):
            f.write(part)
        f.flush()
        yield f.name


def create_blob(spark: SparkSession, path: str, data: bytes | Iterable[bytes]) -> int:
    """Write one blob whole, under another name until it is complete; returns its length.  Of data that come in parts a chunk is held at a time."""
    fs, hadoop = _file(spark, path)
    _, part = _file(spark, f"{path}.part")
    out, size, held = fs.create(part, True), 0, bytearray()
    try:
        for piece in [data] if isinstance(data, (bytes, bytearray)) else data:
            for at in range(0, len(piece), CHUNK):
                held += piece[at : at + CHUNK]
                if len(held) >= CHUNK:
                    out.write(held)
                    size, held = size + len(held), bytearray()
        out.write(held)
        size += len(held)
    finally:
        out.close()
    fs.delete(hadoop, False)
    if not fs.rename(part, hadoop):
        raise OSError(f"can't write {path}")
    return size


def delete_blobs(spark: SparkSession, paths: list[str]) -> None:
    """Those that aren't there count as deleted."""
    for path in paths:
        removed(spark, path)
