"""Rows without an id, repeated ids and repeated rows."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftloom.llm import html_text, jaccard, packing, quality, vectors

BYTE = public_tokenizers.path("byte_bpe_50k.json")
TEXT = "one two three four five six seven eight nine ten"


def test_packing(spark):
    rows = [(None, TEXT), (None, TEXT), (3, TEXT), (3, TEXT), (3, "other"), (None, None)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), BYTE).collect()
    t = Tokenizer.from_file(BYTE)
    want = [(str(i), len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in rows]
    assert sorted((str(r.doc_id), r.length) for r in got) == sorted(want)
    assert len({(r.sequence_id, r.offset) for r in got}) == 6


def test_jaccard(spark):
    rows = [(None, TEXT), (5, TEXT), (2, TEXT), (2, TEXT), (9, "quite another text of more than five words"), (9, TEXT + " more"), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # Rows with one doc_id are one node, each with the size of its own set; a row without doc_id has no component.
    assert got == sorted([(None, 6, None, 0), (5, 6, 2, 2), (2, 6, 2, 2), (2, 6, 2, 2), (9, 4, 2, 2), (9, 7, 2, 2), (None, 0, None, 0)], key=str)


def test_vectors(spark):
    rows = [(None, [1.0, 0.0]), (7, [1.0, 0.0]), (4, [1.0, 0.01]), (4, [0.0, 0.0]), (8, None), (None, None), (6, [1.0, 2.0, 3.0]), (4, [1.0, 0.01])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(frame).collect()), key=str)
    assert len(got) == len(rows) and [g for g in got if g[0] in (None, 6, 8)] == [(6, 0, 6, True), (8, 0, 8, True), (None, 0, None, True), (None, 0, None, True)]
    assert {g[2] for g in got if g[0] == 7} == {4} and (4, 0, 4, True) in got
    found = vectors.search(frame, frame, 2).collect()
    assert {r.query_id for r in found} == {7, 4} and all(r.vec_id in (7, 4) for r in found)


def test_pages_and_quality(spark):
    pages = spark.createDataFrame([(None, None, "<p>a</p>"), (1, "u", "<p>a</p>"), (1, "u", "<p>a</p>")], "page_id long, url string, html string")
    assert sorted((str(r.page_id), r.text) for r in html_text.extract(pages).collect()) == [("1", "a"), ("1", "a"), ("None", "a")]
    docs = spark.createDataFrame([(None, TEXT), (1, TEXT), (1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(None, 1, 0), (1, None, 1), (1, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).count() == 3


def test_vectors_of_doubles(spark):
    """Doubles that float32 holds are as good as floats; others raise, and are not compared as something else."""
    rows = [(20 * i, [float(i), 1.0, -0.5]) for i in range(5)]
    exact = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    single = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, vectors.search(exact, exact, 3).collect())) == sorted(map(tuple, vectors.search(single, single, 3).collect()))
    for wide in ([0.1, 1.0, 1.0], [1e200, 1.0, 1.0]):
        finer = exact.unionByName(spark.createDataFrame([(7, wide)], "vec_id long, embedding array<double>"))
        with pytest.raises(Exception, match="float32 does not hold the vector of vec_id 7"):
            vectors.search(finer, exact, 3).collect()
        with pytest.raises(Exception, match="float32 does not hold the vector of vec_id 7"):
            vectors.near_duplicates(finer).collect()
