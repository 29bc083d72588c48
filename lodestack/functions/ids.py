"""Document ids (set << 32 | number), id lists and bit sets."""

from __future__ import annotations

import base64
import binascii
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_LONG = (1 << 63) - 1


def pack(document_set_id: Column, number: Column) -> Column:
    return F.shiftleft(document_set_id.cast("long"), 32).bitwiseOR(number.cast("long"))


def number_of(document_id: Column) -> Column:
    return document_id.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))


def set_of(document_id: Column) -> Column:
    return F.shiftright(document_id.cast("long"), 32)


def parse_ids(text: str) -> list[int]:
    """All runs of digits that fit a long."""
    return [n for n in map(int, re.findall(r"[0-9]+", text or "")) if n <= MOST_LONG]


def parsed_ids(text: Column) -> Column:
    """The same for a column: array of longs."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("long")), lambda x: x.isNotNull())


def bits_to_numbers(encoded: str) -> list[int] | None:
    """Numbers of the set bits of base-64 text (plain or URL-safe); bit 0 is the top bit of byte 0.  None if it isn't base 64."""
    plain = (encoded or "").strip().replace("-", "+").replace("_", "/").rstrip("=")
    try:
        data = base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None
    return [8 * i + j for i, byte in enumerate(data) for j in range(8) if byte & (0x80 >> j)]


def numbers_to_bits(numbers: list[int]) -> str:
    data = bytearray(max(numbers, default=-1) // 8 + 1)
    for n in numbers:
        data[n // 8] |= 0x80 >> n % 8
    return base64.b64encode(bytes(data)).decode()


def ids_frame(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(int(i),) for i in dict.fromkeys(ids)], "id long")


def intersect(frames: list[DataFrame]) -> DataFrame | None:
    """Ids in all of the frames; None for no frame at all, which stands for every document."""
    out = None
    for frame in frames:
        out = frame if out is None else out.join(frame, "id", "left_semi")
    return out


def of_set(frame: DataFrame, document_set_id: int) -> DataFrame:
    """Ids of one document set: those of another set never meet them in an intersection."""
    return frame.filter(set_of(F.col("id")) == document_set_id)
