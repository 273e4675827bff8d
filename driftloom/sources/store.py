"""Tables that are written once and read again: a shared folder, cut lineages, and tables kept for a session."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_FOLDERS: dict[str, str] = {}
_KEPT: dict[tuple, DataFrame] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share. Unset, a temporary folder serves a local master; a cluster raises."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    context = spark.sparkContext
    if not context.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _FOLDERS:
        _FOLDERS[context.applicationId] = folder = tempfile.mkdtemp(prefix="driftloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return _FOLDERS[context.applicationId]


Buckets = tuple[int, str]


def written(df: DataFrame, name: str, buckets: Buckets | None = None, onto: DataFrame | None = None) -> DataFrame:
    """``df`` from a Parquet table in the shared folder: its lineage is cut, and a lost executor costs a scan.

    With ``buckets`` (number, column) rows of equal value lie in one file, and what groups or joins by the column, alone or
    with others, needs no shuffle; rows that lie so already are not shuffled for the writing either.
    ``onto``: a table written so before, to which ``df`` is added; what comes back has the rows of both, in the same buckets, which
    a union would not keep.
    """
    spark, path = df.sparkSession, onto.written_at if onto is not None else f"{shared_dir(df.sparkSession)}/driftloom/{name}-{uuid.uuid4().hex}"
    if buckets is None:
        df.write.mode("append").option("compression", "zstd").parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # joins by the column and others, too
        table = f"driftloom_{name}_{path[-32:]}"
        if onto is not None:
            df.repartition(*buckets).select(*onto.columns).write.insertInto(table)
        else:
            df.repartition(*buckets).write.format("parquet").bucketBy(*buckets).option("compression", "zstd").option("path", path).saveAsTable(table)
        out = spark.table(table)
    out.written_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a ``written`` table that nothing reads any more."""
    files, at = hadoop_path(df.sparkSession, df.written_at)
    files.delete(at, True)


def hadoop_path(spark: SparkSession, path: str) -> tuple:
    """A path's file system and the path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def file_marks(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of change of a file, or of what a folder holds."""
    files, at = hadoop_path(spark, path)
    found = files.listStatus(at)
    return tuple((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found)


def bucket_number(spark: SparkSession, paths: list[str], size: int = 1 << 20) -> int:
    """Buckets for tables that come from these files: one per ``size`` bytes, and one per core at least, so that a bucket stays as large as it is when the input grows."""
    return max(spark.sparkContext.defaultParallelism, -(-sum(m[1] for p in paths for m in file_marks(spark, p)) // size))


def kept(spark: SparkSession, name: str, inputs: list[str], make: Callable[[], DataFrame], buckets: Buckets | None = None) -> DataFrame:
    """The written result of ``make``, made once per application as long as the ``inputs`` stay as they are and the result is there."""
    key = (spark.sparkContext.applicationId, name, *(file_marks(spark, p) for p in inputs))
    files, at = hadoop_path(spark, _KEPT[key].written_at) if key in _KEPT else (None, None)
    if files is None or not files.exists(at):
        _KEPT[key] = written(make(), name, buckets)
    return _KEPT[key]
