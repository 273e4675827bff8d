"""Shared plumbing of the corpus operators: spooled tables, Arrow text buffers, ragged gathers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from driftloom.sources.store import shared_dir

#: Text bytes that one numpy pass works on, a whole batch as it comes; bounds the memory of a Python worker.
SLICE_BYTES = 8 << 20
#: Bytes of an Arrow batch between Spark and Python; without a bound 10,000 long texts go at once, through both memories.
BATCH_BYTES = 8 << 20
#: What a Python worker keeps from task to task; a task of an operator that does not use it drops it.
WORKER_CACHE: dict = {}


def spool(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the session's part of the shared folder and read it back, which cuts its lineage.

    Results may read such tables until they are used; ``drop_tables`` deletes all of a session's when nothing needs them.
    """
    spark = df.sparkSession
    path = f"{session_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # The shuffles of a table that is written whole are of no more use: drop their files at once.
    drop, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", None
    before = spark.conf.get(drop, None)
    spark.conf.set(drop, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(drop, before) if before is not None else spark.conf.unset(drop)
    out = spark.read.schema(df.schema).parquet(path)
    out.spooled_at = path
    return out


def session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/driftloom/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Delete every table that this session's operators have written; results that were not yet used can't be read after."""
    _delete(spark, session_dir(spark))


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def unspool(df: DataFrame) -> None:
    """Delete a spooled table that nothing reads any more."""
    _delete(df.sparkSession, df.spooled_at)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by BATCH_BYTES, unless the session has a bound of its own. (Spark reads it when the plan runs, so it stays set.)"""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def arrow_map(df: DataFrame, run: Callable, schema: str, keep_cache: bool = False) -> DataFrame:
    """``mapInArrow`` whose workers can import this package from where the driver has it (or as shipped with --py-files)."""
    bound_batches(df.sparkSession)
    here, env = str(Path(__file__).resolve().parents[2]), df.sparkSession.sparkContext.environment
    if here not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{here}:{env.get('PYTHONPATH', '')}".rstrip(":")

    def run_and_release(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keep_cache:
            drop_cache()
        yield from run(batches)
        release()

    return df.mapInArrow(run_and_release, schema)


def release() -> None:
    """Give memory that a Python worker no longer uses back to the system; a worker stays for later tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def drop_cache() -> None:
    """Empty this worker's cache. (A nested function would be shipped with a copy of the dict.)"""
    if WORKER_CACHE:
        WORKER_CACHE.clear()
        release()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or large binary column; a null is an empty one."""
    column = pc.fill_null(column, b"") if pa.types.is_large_binary(column.type) else pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def text_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds about ``limit`` bytes of ``column`` at most (one row at least)."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            done = size[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices that gather the spans ``[start, start + length)`` one after the other."""
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64)
    return np.repeat(starts.astype(np.int64) - (ends - lengths), lengths) + np.arange(ends[-1])


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """An Arrow binary column over one buffer."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data)]
    ).cast(pa.binary())


def columns(**arrays) -> pa.RecordBatch:
    """A record batch of numpy or Arrow columns."""
    made = [a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a) for a in arrays.values()]
    return pa.RecordBatch.from_arrays(made, names=list(arrays))
