"""Append-only logs and keyed tables in a shared folder: ordered commits, and snapshots that rewrite only what they touch."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from driftloom.sources.store import hadoop_path

#: A log's batches are subfolders named so; the number is their place in the log.
COMMIT = "commit="


def _numbers(spark: SparkSession, folder: str, prefix: str, suffix: str = "") -> list[int]:
    files, at = hadoop_path(spark, folder)
    if not files.exists(at):
        return []
    names = [f.getPath().getName() for f in files.listStatus(at)]
    found = [n[len(prefix) : len(n) - len(suffix)] for n in names if n.startswith(prefix) and n.endswith(suffix)]
    return sorted(int(n) for n in found if n.isdigit())


def _created(spark: SparkSession, path: str, content: str = "") -> bool:
    """Whether this call made the file; one that is there already stays as it is."""
    files, at = hadoop_path(spark, path)
    try:
        out = files.create(at, False)
    except Exception as e:  # Hadoop's error class for it is known by name alone here
        if "AlreadyExists" in str(e) or files.exists(at):
            return False
        raise
    out.write(bytearray(content, "utf-8"))
    out.close()
    return True


def append(records: DataFrame, folder: str) -> int:
    """Add ``records`` to the log as one batch, after all that is there; returns its number.

    The batch is written beside the log first. Then a number is claimed, by creating a file that must not exist, and the
    batch is moved to its place in one step. So two writers never have one number, readers see a batch whole or not at
    all, and a writer that is lost leaves a number that is never used.
    """
    spark = records.sparkSession
    beside = f"{folder}/_beside/{uuid.uuid4().hex}"
    records.withColumn("_row", F.monotonically_increasing_id()).write.json(beside)
    n = max([0, *_numbers(spark, f"{folder}/_claims", ""), *_numbers(spark, folder, COMMIT)]) + 1
    while not _created(spark, f"{folder}/_claims/{n:012d}"):
        n += 1
    files, at = hadoop_path(spark, beside)
    if not files.rename(at, hadoop_path(spark, f"{folder}/{COMMIT}{n:012d}")[1]):
        raise OSError(f"{beside} could not be moved to its place in {folder}")
    return n


def _parsed(lines: DataFrame, schema: str | StructType, row: Column) -> DataFrame:
    """Records of JSON lines with _commit and _place; a line that is no record raises with its file and place.

    A batch's records have their row in the batch. In plain files the place is the file, the start of the piece of it that
    a task reads, and ``row`` within that.
    """
    if not isinstance(schema, str):
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    commit = F.coalesce(F.regexp_extract("_metadata.file_path", rf"/{COMMIT}(\d+)/", 1).try_cast("long"), F.lit(0))
    read = lines.select("value", commit.alias("_commit"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), row.alias("_at")).where(F.trim("value") != "")
    record = read.withColumn("_r", F.from_json("value", f"{schema}, `_row` bigint, `_bad` string", {"columnNameOfCorruptRecord": "_bad"}))
    where = F.concat(F.lit("no record in "), F.col("_path"), F.lit(" from byte "), F.col("_start").cast("string"), F.lit(": "), F.substring("value", 1, 80))
    sound = F.when(F.col("_r._bad").isNull(), F.col("_r")).otherwise(F.raise_error(where).cast(record.schema["_r"].dataType))
    whole = F.col("_r._row").isNotNull()
    place = F.struct(F.when(~whole, F.col("_path")).alias("file"), F.when(~whole, F.col("_start")).alias("start"), F.coalesce("_r._row", "_at").alias("row"))
    return record.withColumn("_r", sound).select("_r.*", "_commit", place.alias("_place")).drop("_bad", "_row")


def read_log(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """All records of a log, or of plain files of JSON lines, with ``_commit`` and ``_place``, which order them."""
    commits = _numbers(spark, path, COMMIT)
    return _parsed(spark.read.text([f"{path}/{COMMIT}{n:012d}" for n in commits] if commits else path), schema, F.monotonically_increasing_id())


def stream_log(spark: SparkSession, folder: str, schema: str | StructType) -> DataFrame:
    """The log's records as a stream, batches that are still to be appended included."""
    return _parsed(spark.readStream.text(f"{folder}/{COMMIT}*"), schema, F.lit(None).cast("long"))


def last_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The last record of each key; keys are reduced map-side, so one with very many records is no hot task. Null keys are a key."""
    inner = [c for c in rows.columns if c not in keys]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*inner) if inner else F.lit(1), F.struct(*order)).alias("_last"))
    return found.select(*(F.col(c) if c in keys else F.col(f"_last.`{c}`").alias(c) for c in rows.columns))


def read_latest(spark: SparkSession, path: str, schema: str | StructType, keys: list[str]) -> DataFrame:
    """The last record of each key of a log: of the last batch that has one, the last in it."""
    return last_of(read_log(spark, path, schema), keys, ["_commit", "_place"]).drop("_commit", "_place")


class Versioned:
    """A keyed table under a folder, cut into buckets by its keys; a put rewrites the buckets that it touches and no others.

    A version is a small file that names, for each bucket, the folder that holds it. It is created last, and must not exist
    before, so readers see the version before until then, a lost job leaves nothing half replaced, and of two writers that
    started from one version the second fails and can put again. Folders of older versions stay, and can be read.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def latest(self) -> int:
        """The number of the last version; 0 if there is none."""
        return max(_numbers(self.spark, f"{self.folder}/versions", "", ".json"), default=0)

    def _version(self, n: int) -> dict:
        if not n:
            return {"keys": None, "buckets": self.buckets, "schema": None, "at": {}}
        return json.loads(self.spark.read.text(f"{self.folder}/versions/{n}.json", wholetext=True).first()[0])

    def _rows(self, version: dict, buckets: list[str]) -> DataFrame:
        paths = [version["at"][b] for b in buckets if b in version["at"]]
        schema = StructType.fromJson(version["schema"])
        return self.spark.read.schema(schema).parquet(*(f"{self.folder}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        found = self._version(self.latest() if version is None else version)
        if found["schema"] is None:
            raise FileNotFoundError(f"{self.folder} has no version yet")
        return self._rows(found, sorted(found["at"]))

    def put(self, new: DataFrame, keys: list[str], order: list[str] | None = None) -> int:
        """Rows of ``new`` in place of those with their keys; of several of one key the last by ``order``. Returns the new version.

        A column that either side lacks is null there. The keys of a table stay those of its first put.
        """
        from driftloom.operators.lineage import upsert
        from driftloom.sources.store import discard, written

        n = self.latest()
        now = self._version(n)
        if now["keys"] not in (None, keys):
            raise ValueError(f"{self.folder} is keyed by {now['keys']}, not by {keys}")
        bucket = F.pmod(F.xxhash64(*keys), F.lit(now["buckets"])).cast("int")
        # what comes in is read more than once, and must be the same each time
        coming = written(last_of(new, keys, order) if order else new.distinct(), "coming")
        touched = sorted(str(r[0]) for r in coming.select(bucket).distinct().collect())  # as many as buckets at most
        both = upsert(self._rows(now, touched), coming, keys) if now["schema"] else coming
        home = f"data/{n + 1}-{uuid.uuid4().hex}"
        both.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.folder}/{home}")
        content = {"keys": keys, "buckets": now["buckets"], "schema": both.schema.jsonValue(), "at": now["at"] | {b: f"{home}/_bucket={b}" for b in touched}}
        if not _created(self.spark, f"{self.folder}/versions/{n + 1}.json", json.dumps(content)):
            raise FileExistsError(f"version {n + 1} of {self.folder} was made meanwhile; put again")
        discard(coming)
        return n + 1
