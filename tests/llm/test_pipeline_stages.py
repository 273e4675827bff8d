"""Stages on nulls, empty and long texts, ties and repeated rows, empty tables and clashing columns."""

import pytest

import corpus_pipeline

NAMES = "doc_id long, text string, lang string, source string, n_chars long, accepted string, prior string, spans string, _row int, component_id string"


@pytest.fixture(scope="module")
def data(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(1, 40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def rows():
    long = " ".join(f"word{i}" for i in range(30_000)) + " joe@x.org"
    body = "one two three four five six seven eight nine ten"
    texts = [(5, body), (3, body), (3, body), (None, body), (3, "another text that is quite unlike the others here"), (8, None), (8, None), (9, ""), (None, ""), (10, long), (11, long), (None, "alone with no id at all but words enough"), (12, "mail joe@x.org now")]
    return [(i, t, "en", None if k % 2 else "h/p", len(t or ""), "a", "p", "s", k, "c") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), NAMES)


def plain(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES])
def test_empty_tables(spark, docs, data, stage):
    assert stage(spark, docs.limit(0), data).count() == 0


def test_quality_keeps_columns_and_judges_each_row(spark, docs, data):
    out = corpus_pipeline.quality(spark, docs, data)
    assert out.columns == docs.columns and set(plain(out)) <= set(plain(docs)) and out.count() > 0


def test_one_row_of_each_group_stays(spark, docs, data):
    out = corpus_pipeline.near_duplicates(spark, docs, data)
    assert out.columns == docs.columns
    # Of the four rows with one text that with doc_id 3 that comes first; of the long ones doc_id 10; no others go.
    assert sorted(r._row for r in out.collect()) == [1, 4, 5, 6, 7, 8, 9, 11, 12]


def test_private_data_keeps_columns(spark, docs, data):
    out = {r._row: r for r in corpus_pipeline.private_data(spark, docs, data).collect()}
    assert len(out) == docs.count()
    assert out[12].text == "mail [EMAIL] now" and out[9].text.endswith("[EMAIL]") and out[5].text == "" and out[12].spans == "s"
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_packing_takes_every_row(spark, docs, data):
    out = corpus_pipeline.packing(spark, docs, data)
    assert out.where("piece = 0").count() == docs.count()
