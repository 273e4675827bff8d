"""Ordered logs, keyed tables that rewrite what they touch, snapshots of SQLite, and what the last round's verdict found wrong."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from driftloom.operators import graph_queries
from driftloom.sources import corpora, log

SCHEMA = "doc string, n int, status string"


def records(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_last_append_is_read(spark, tmp_path):
    at = str(tmp_path / "log")
    for i in range(20):
        assert corpora.append_checkpoint(records(spark, ("a", i, "ok"), ("b", i, "first"), ("b", i, "second")).coalesce(1), at) == i + 1
        got = {r.doc: (r.n, r.status) for r in corpora.read_checkpoint(spark, at, SCHEMA, ["doc"]).collect()}
        assert got == {"a": (i, "ok"), "b": (i, "second")}
    corpora.append_checkpoint(records(spark, (None, 1, "x"), ("a", None, None)), at)
    got = {r.doc: (r.n, r.status) for r in corpora.read_checkpoint(spark, at, SCHEMA, ["doc"]).collect()}
    assert got == {"a": (None, None), "b": (19, "second"), None: (1, "x")}


def test_order_within_a_batch_is_that_of_its_rows(spark, tmp_path):
    at = str(tmp_path / "log")
    many = spark.range(2000, numPartitions=13).select(F.lit("k").alias("doc"), F.col("id").cast("int").alias("n"), F.lit("ok").alias("status"))
    log.append(many, at)
    assert log.read_latest(spark, at, SCHEMA, ["doc"]).first().n == 1999


def test_large_plain_file_is_read_in_order(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text("".join(f'{{"doc": "{i % 7}", "n": {i}, "status": "{"x" * 50}"}}\n' for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        assert {r.n for r in corpora.read_checkpoint(spark, str(path), SCHEMA, ["doc"]).collect()} == set(range(19993, 20000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_claimed_numbers_are_not_used_twice(spark, tmp_path):
    at = str(tmp_path / "log")
    log.append(records(spark, ("a", 1, "ok")), at)
    assert log._created(spark, f"{at}/_claims/{2:012d}")  # another writer that was lost, or has not moved its batch yet
    assert not log._created(spark, f"{at}/_claims/{2:012d}")
    assert log.append(records(spark, ("a", 2, "ok")), at) == 3
    assert log.read_latest(spark, at, SCHEMA, ["doc"]).first().n == 2


def test_broken_line_raises_with_its_place(spark, tmp_path):
    path = tmp_path / "c.jsonl"
    path.write_text('{"doc": "a", "n": 1}\n\n{"doc": "b", "n":\n')
    with pytest.raises(Exception, match=r"no record in .*c\.jsonl from byte 0: \{\"doc\": \"b\""):
        corpora.read_checkpoint(spark, str(path), SCHEMA, ["doc"]).collect()


def test_log_as_a_stream(spark, tmp_path):
    at = str(tmp_path / "log")
    log.append(records(spark, ("a", 1, "ok")), at)
    q = log.stream_log(spark, at, SCHEMA).withColumn("_place", F.col("_place.row")).writeStream.format("memory").queryName("log_rows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
        log.append(records(spark, ("b", 2, "ok"), ("a", 3, "failed")), at)
        q.processAllAvailable()
        rows = spark.table("log_rows").collect()
        assert sorted((r._commit, r.doc, r.n) for r in rows) == [(1, "a", 1), (2, "a", 3), (2, "b", 2)]
        assert [r.n for r in sorted(rows, key=lambda r: (r._commit, r._place))] == [1, 2, 3]
    finally:
        q.stop()


def test_put_rewrites_touched_buckets_only(spark, tmp_path):
    table = corpora.Versioned(spark, str(tmp_path / "t"), buckets=16)
    table.put(spark.range(1000).select(F.concat(F.lit("k"), "id").alias("doc"), F.lit(0).alias("n"), F.lit("old").alias("status")), ["doc"])
    before = table._version(1)["at"]
    assert len(before) == 16
    table.put(records(spark, ("k5", 1, "new"), ("k5", 2, "newest"), ("fresh", 1, "new")), ["doc"], ["n"])
    after = table._version(2)["at"]
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2
    assert {p.name.split("=")[1] for p in (tmp_path / "t" / "data").glob("2-*/_bucket=*")} == changed  # nothing else was written
    rows = {r.doc: (r.n, r.status) for r in table.read().collect()}
    assert len(rows) == 1001 and rows["k5"] == (2, "newest") and rows["fresh"] == (1, "new") and rows["k6"] == (0, "old")
    assert table.read(1).count() == 1000  # the version before can still be read
    with pytest.raises(ValueError, match="keyed by"):
        table.put(records(spark, ("a", 1, "x")), ["n"])


def test_lost_and_late_writers(spark, tmp_path, monkeypatch):
    table = corpora.Versioned(spark, str(tmp_path / "t"), buckets=4)
    table.put(records(spark, ("a", 1, "old"), ("b", 1, "old")), ["doc"])
    real = log._created
    with monkeypatch.context() as m:
        m.setattr(log, "_created", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError, match="lost"):
            table.put(records(spark, ("a", 2, "new")), ["doc"])
    assert sorted((r.doc, r.n) for r in table.read().collect()) == [("a", 1), ("b", 1)]
    with monkeypatch.context() as m:  # another writer makes the version while this one writes
        m.setattr(log, "_created", lambda s, p, c="": real(s, p, c) and real(s, p, c))
        with pytest.raises(FileExistsError):
            table.put(records(spark, ("a", 3, "new")), ["doc"])


def test_one_snapshot_for_all_partitions(spark, tmp_path):
    path = str(tmp_path / "lineage.db")
    con = sqlite3.connect(path)
    con.execute("PRAGMA journal_mode=WAL")
    con.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, "before") for i in range(40)])
    con.commit()  # in the log; the file itself has no rows yet
    copy, mark = corpora.snapshot(spark, path)
    assert mark["log_bytes"] == 0 and mark == corpora.fingerprint(copy)
    spark.dataSource.register(corpora.SqliteSource)
    rows = spark.read.format("sqlite").option("path", copy).option("table", "t").option("partitions", "4").load()
    first = rows.where("id < 10").collect()
    con.execute("UPDATE t SET v = 'after'")
    con.commit()
    con.close()
    rest = rows.where("id >= 10").collect()
    assert {r.v for r in first + rest} == {"before"} and len(first + rest) == 40


def test_document_ids_of_seven_digits(spark, tmp_path, monkeypatch):
    (tmp_path / "d.json").write_text('[{"title": "A b", "sents": [["x"]], "vertexSet": [], "labels": []}]')
    monkeypatch.setattr(corpora, "numbered", lambda rows, limit=None: rows.withColumn("idx", F.lit(1_234_567).cast("long")))
    assert corpora.read_docred(spark, str(tmp_path / "d.json")).first().document_id == "docred-dev-1234567-A_b"


def test_component_change_with_empty_base(spark):
    edges = spark.createDataFrame([("base", "x", "a", "r", "b"), ("f", "x", "a", "r", "b"), ("f", "x", "c", "r", "d"), ("f", "y", "a", "r", "b")], "family string, doc string, s string, r string, o string")
    docs = spark.createDataFrame([("x",), ("y",), ("z",)], "doc string")
    got = {(r.family, r.doc): r.change for r in graph_queries.component_change(docs, edges, ("f", "g"), "base").collect()}
    assert got == {("f", "x"): 1, ("g", "x"): 1, ("f", "y"): 1, ("g", "y"): 0, ("f", "z"): 0, ("g", "z"): 0}
