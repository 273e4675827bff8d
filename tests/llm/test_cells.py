"""Numbers of links of vectors in several cells."""

import numpy as np
import pytest

from driftloom.llm import vectors


@pytest.mark.parametrize("block", [2048, 40])
def test_a_found_pair_counts_for_both_ends(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "CELL", 60)
    monkeypatch.setattr(vectors, "BLOCK", block)
    rng = np.random.default_rng(21)
    x = vectors.unit(rng.normal(size=(1500, 16)))
    y = vectors.unit(x + 0.3 * vectors.unit(rng.normal(size=x.shape)))
    rows = np.concatenate([x, y, y[:200]]).astype(np.float32)  # some rows twice
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()}
    u = vectors.unit(rows)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    group = np.array([got[i].component_id for i in range(len(rows))])
    found = link & (group[:, None] == group[None, :])
    assert found.sum() >= 0.95 * link.sum()
    assert [got[i].n_links for i in range(len(rows))] == found.sum(axis=1).tolist()


def test_ten_thousand_vectors_in_many_cells_equal_brute_force(spark, monkeypatch):
    """Groups of near vectors of all sizes, one of them large; every link, both ends."""
    monkeypatch.setattr(vectors, "BLOCK", 300)
    rng = np.random.default_rng(4)
    x = vectors.unit(rng.normal(size=(4000, 48)))
    sizes = [1500, 300, *rng.integers(1, 40, 200)]
    groups = [x[i] + 0.15 * vectors.unit(rng.normal(size=(n, 48))) for i, n in enumerate(sizes)]
    rows = np.concatenate([x, *groups])[:10_000].astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()}
    u = vectors.unit(rows)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    label = np.arange(len(rows))
    for _ in range(30):
        label = np.minimum(label, np.where(link, label[None, :], len(rows)).min(axis=1))
    assert len(rows) // vectors.CELL >= 10
    assert [got[i].n_links for i in range(len(rows))] == link.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == label.tolist()


@pytest.mark.parametrize("copies", [8, 1])
def test_crowded_cells_are_cut(spark, monkeypatch, copies):
    for name, value in (("CELL", 60), ("CELLS", 8), ("CROWDED", 200), ("BLOCK", 64), ("COPIES", copies), ("SAMPLE", 300)):
        monkeypatch.setattr(vectors, name, value)
    rng = np.random.default_rng(14)
    x = vectors.unit(rng.normal(size=(1500, 16)))
    y = vectors.unit(x + 0.2 * vectors.unit(rng.normal(size=x.shape)))
    near = vectors.unit(x[0] + 0.05 * vectors.unit(rng.normal(size=(400, 16))))  # no cut parts these
    rows = np.concatenate([x, y, near, y[:100]]).astype(np.float32)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<float>")).collect()}
    u = vectors.unit(rows)
    link = u @ u.T >= 0.95
    np.fill_diagonal(link, False)
    group = np.array([got[i].component_id for i in range(len(rows))])
    found = np.array([got[i].n_links for i in range(len(rows))])
    assert len(got) == len(rows) and (found <= link.sum(axis=1)).all() and found.sum() >= 0.95 * link.sum()
    assert not (link & (group[:, None] != group[None, :])).sum() > 0.05 * link.sum() and found.sum() % 2 == 0
    assert [got[i].n_links for i in range(3000, 3400)] == link[3000:3400].sum(axis=1).tolist()
