"""Remote document collections: id lists, pages, and paged JSON search results."""

from __future__ import annotations

import base64
import math
import urllib.error
import urllib.request
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIELD, RECORD = "\u001f", "\u001e"
COLUMNS = ("id", "title", "n_pages", "text_url", "page_url", "access")
RESULT = "struct<total:long,page:long,documents:array<struct<id:string,title:string,pages:int,access:string,resources:struct<text:string,page:struct<text:string>>>>>"


def encode_ids(rows: list[tuple]) -> str:
    return RECORD.join(FIELD.join(map(str, row)) for row in rows)


def decode_ids(encoded: Column) -> Column:
    """Array of structs; null if a record hasn't six fields."""
    records = F.transform(F.filter(F.split(encoded, RECORD), lambda r: r != ""), lambda r: F.split(r, FIELD))
    kinds = {"n_pages": "int"}
    rows = F.transform(records, lambda r: F.struct(*[F.get(r, n).try_cast(kinds.get(c, "string")).alias(c) for n, c in enumerate(COLUMNS)]))
    return F.when(F.forall(records, lambda r: F.size(r) == len(COLUMNS)), rows)


def n_lists(total: int, per_list: int) -> int:
    """Lists to fetch for so many results: at least one."""
    return max(1, math.ceil(total / per_list))


def list_count(total: Column, per_list: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(total / per_list))


def remaining_lists(total: int, per_list: int, n_fetched: int) -> range:
    """Numbers of the lists still to fetch after a restart."""
    return range(n_fetched, n_lists(total, per_list))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Documents of saved search-result pages (JSON files): id, title, n_pages, text_url, page_url, access."""
    pages = spark.read.text(path, wholetext=True).select(F.from_json("value", RESULT).alias("r"))
    return pages.select(F.explode("r.documents").alias("d")).select("d.id", "d.title", F.col("d.pages").alias("n_pages"), F.col("d.resources.text").alias("text_url"), F.col("d.resources.page.text").alias("page_url"), "d.access")


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def fetch(url: str, credentials: tuple[str, str] | None = None, timeout: float = 30.0) -> bytes:
    """The body of a 200 answer; anything else raises OSError.

    One redirect is followed, without the credentials: private texts lie at signed addresses that mustn't see them.
    """
    opener = urllib.request.build_opener(_NoRedirect)

    def get(address: str, headers: dict[str, str]):
        try:
            return opener.open(urllib.request.Request(address, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            return e

    token = base64.b64encode(":".join(credentials).encode()).decode() if credentials else None
    answer = get(url, {"Authorization": f"Basic {token}"} if token else {})
    if answer.status in (301, 302, 303, 307, 308):
        answer = get(answer.headers["Location"], {})
    with answer:
        if answer.status != 200:
            raise OSError(f"HTTP {answer.status} for {url}")
        return answer.read()


def fetch_texts(rows: DataFrame, credentials: tuple[str, str] | None = None, url: str = "text_url") -> DataFrame:
    """``rows`` (id, access, url) fetched by the executors: id, text, error.  Credentials go with private documents only; a failure is a row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, access, address in zip(batch.id, batch.access, batch.url, strict=True):
                try:
                    out.append((i, fetch(address, credentials if access != "public" else None).decode("utf-8", "replace"), None))
                except (OSError, ValueError) as e:
                    out.append((i, None, str(e)))
            yield pd.DataFrame(out, columns=["id", "text", "error"])

    return rows.select("id", "access", F.col(url).alias("url")).mapInPandas(run, "id string, text string, error string")


def split_pages(docs: DataFrame, pages: str = "n_pages") -> DataFrame:
    """A row per page, numbered from 1; a document of one page (or none) stays one row without a page number."""
    numbers = F.when(F.col(pages) > 1, F.sequence(F.lit(1), F.greatest(F.col(pages), F.lit(2)).cast("int"))).otherwise(F.array(F.lit(None).cast("int")))
    return docs.withColumn("page_number", F.explode(numbers))


def not_there(rows: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows still to be fetched when an import resumes."""
    out = rows
    marks = existing.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        test = out[k].eqNullSafe(marks[f"__{k}"])
        same = test if same is None else same & test
    return out.join(marks, same, "left_anti")


def dangling(jobs: dict[str, DataFrame]) -> DataFrame:
    """Unfinished commands of every kind: kind, id, document_set_id."""
    out = None
    for kind, rows in jobs.items():
        part = rows.filter("not finished").select(F.lit(kind).alias("kind"), "id", "document_set_id")
        out = part if out is None else out.unionByName(part)
    return out
