"""A store that lost a row or a file, or holds one twice, is not read."""

import shutil
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm import idstore

WORD = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", *(f"text number {i} " + "a passage that many texts share, word for word, " * (40 * (i % 3)) for i in range(120))]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids") / "store")
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(7, TEXTS[7]), (7, TEXTS[9]), (None, "no id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    idstore.write(spark.createDataFrame(rows, "doc_id long, text string"), WORD, path)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    return path, rows


def test_checksums_and_repeated_rows(spark, store):
    path, rows = store
    t = Tokenizer.from_file(WORD)
    want = sorted((-1 if i is None else i, zlib.crc32(np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes())) for i, x in rows)
    got = idstore.read(spark, path, checksums=True).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got) == want
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert [a for a, _ in ends] == [0, *(b for _, b in ends[:-1])]


def copy_of(store, tmp_path):
    return shutil.copytree(store[0], tmp_path / "copy")


def data_files(path):
    return sorted(Path(path, "data").glob("part-*.parquet"))


@pytest.mark.parametrize("which", [0, 1, -1])
def test_a_lost_or_doubled_file_is_noticed(spark, store, tmp_path, which):
    path = copy_of(store, tmp_path)
    assert len(data_files(path)) > 2
    file = data_files(path)[which]
    shutil.copy(file, file.with_name(f"part-x{file.name}"))
    with pytest.raises(ValueError, match="manifest"):
        idstore.read(spark, str(path))
    data_files(path)[-1].unlink()
    data_files(path)[which].unlink()
    with pytest.raises(ValueError, match="manifest"):
        idstore.read(spark, str(path))


@pytest.mark.parametrize("change", ["row >= 0 and doc_id = 5", "row = -1 and file = 1"])
def test_a_lost_row_is_noticed(spark, store, tmp_path, change):
    path = copy_of(store, tmp_path)
    spark.read.parquet(f"{path}/data").where(f"not coalesce({change}, false)").write.parquet(f"{path}/less")
    shutil.rmtree(f"{path}/data")
    Path(path, "less").rename(Path(path, "data"))
    with pytest.raises(ValueError, match="manifest"):
        idstore.read(spark, str(path))


def test_a_changed_payload_is_noticed(spark, store, tmp_path):
    from pyspark.sql import functions as F

    path = copy_of(store, tmp_path)
    spark.read.parquet(f"{path}/data").withColumn("payload", F.when(F.col("doc_id") == 3, F.concat(F.expr("substring(payload, 3)"), F.expr("substring(payload, 1, 2)"))).otherwise(F.col("payload"))).write.parquet(f"{path}/less")
    shutil.rmtree(f"{path}/data")
    Path(path, "less").rename(Path(path, "data"))
    with pytest.raises(Exception, match="do not match their recipes"):
        idstore.read(spark, str(path)).collect()


def test_wide_ids(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(idstore, "vocabulary", lambda _: 1 << 17)
    path = str(tmp_path / "wide")
    idstore.write(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), WORD, path)
    t = Tokenizer.from_file(WORD)
    got = sorted(idstore.read(spark, path).collect(), key=lambda r: r.doc_id)
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in TEXTS]
