"""Tables and folders in the folder that all executors share, and joins whose broadcasts are size-checked."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import shutil
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of ids and a few numbers are broadcast up to this many rows, 16 MB at some 64 bytes a row in memory; longer ones are joined by a shuffle.
BROADCAST_IDS = 250_000
#: Keys of more rows than the HOT_SHARE-th part of all, and than HOT_LEAST, are joined by a broadcast: HOT_SHARE keys at most.
HOT_SHARE, HOT_LEAST = 100_000, 64
_OWN: set[str] = set()


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Hadoop resolves it: one without a scheme lies in the cluster's default file system."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()
    return f"file://{whole.removeprefix('file:')}" if whole.startswith("file:/") and not whole.startswith("file://") else whole


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a temporary folder of a local session, else a part of the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.partition("[")[0] == "local":
        base = f"{spark.conf.get('spark.sql.warehouse.dir')}/.shared"
    if not base:
        base = getattr(shared_folder, "own", None)
        if base is None:
            base = shared_folder.own = tempfile.mkdtemp(prefix="lodestack-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's part of the shared folder, which goes when the driver ends."""
    own = f"{shared_folder(spark)}/lodestack/{spark.sparkContext.applicationId}"
    if own not in _OWN:
        _OWN.add(own)
        atexit.register(removed, spark, own)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it and the JVM are still there."""
    with contextlib.suppress(Exception):
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of change of a table's folder or file: differs once the table was written anew."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.getContentSummary(hadoop)
    return found.getLength(), found.getFileCount(), fs.getFileStatus(hadoop).getModificationTime()


def settled(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as a written table in the shared folder: lineage ends here, and lost executors don't matter."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def freed() -> None:
    """Give memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def few(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """``df``, marked for a broadcast if it has at most ``most`` rows; else joins with it go through a shuffle.  For narrow written tables."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keep_ids(df: DataFrame, key: str, ids: DataFrame, how: str = "left_semi", rows: int | None = None) -> DataFrame:
    """Semi or anti join of ``df`` with a one-column table of ids; the ids are broadcast only if they are few.

    ``rows``: their number, if known.
    """
    rows = ids.count() if rows is None else rows
    ids = ids.select(ids[ids.columns[0]].alias("__key"))
    right = F.broadcast(ids) if rows <= BROADCAST_IDS else ids
    return df.join(right, df[key] == right["__key"], how)


def joined_by_size(rows: DataFrame, sized: DataFrame, key: str, hot_least: int = HOT_LEAST) -> DataFrame:
    """``rows`` joined with ``sized`` (key, copies, ...), a written table of one row a key; copies: the rows of that key.

    A key's rows are not gathered: keys of many rows, at most HOT_SHARE of them by the choice of the bound, are broadcast;
    the others have few rows each and are joined by a shuffle.  ``copies`` isn't in the result.
    """
    bound = max(hot_least, (sized.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE)
    hot, cold = sized.filter(F.col("copies") > bound), sized.filter(F.col("copies") <= bound)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key)).drop("copies")
