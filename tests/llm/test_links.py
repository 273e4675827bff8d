"""Numbers of links against brute force."""

import re

import numpy as np
import pytest

from driftloom.llm import jaccard


def brute_links(rows):
    sets = [(i, set(zip(*(w[k:] for k in range(5)), strict=False)) if len(w := re.findall(r"[^ ]+", t.lower())) >= 5 else {tuple(w)} - {()}) for i, t in rows]
    return {i: len({j for j, b in sets if j != i and a and b and 100 * len(a & b) >= 80 * len(a | b)}) for i, a in sets}


def test_jaccard_counts_every_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # the large group is several blocks
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    texts = ["", "one two", "ONE  two", "one two three four five"]
    for copies in (3, 60, 5, 2):
        base = rng.choice(words, 90).tolist()
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(90)] = str(rng.choice(words))
            texts += [" ".join(copy)] * (1 + int(rng.random() < 0.2))
    rows = list(enumerate(texts))
    rows += rows[4:8]  # repeated rows are one document
    want = brute_links(rows)
    got = jaccard.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and max(want.values()) > 16
    assert {r.doc_id: r.n_links for r in got} == want


def test_tokens_that_fall_together_lose_no_link(spark, monkeypatch):
    """Shingle hashes of few bits: many tokens of a set are one in the first stage."""
    plain = jaccard.shingle_sets

    def coarse(data, offsets):
        # Whole hashes stay apart in their last bits, which the first stage does not see.
        return [np.sort((s & np.uint64(0x7F << 57)) | (s & np.uint64((1 << 20) - 1))) for s in plain(data, offsets)]

    monkeypatch.setattr(jaccard, "shingle_sets", coarse)
    rng = np.random.default_rng(12)
    words = [f"w{i}" for i in range(500)]
    texts = []
    for _ in range(25):
        base = rng.choice(words, 100).tolist()
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.integers(0, 4)):
                copy[rng.integers(100)] = str(rng.choice(words))
            texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    got = jaccard.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == brute_links(rows)


@pytest.mark.parametrize("heavy", [None, 150])
def test_fragments_and_shared_passages(spark, monkeypatch, heavy):
    """With one salt near copies end in many groups, so links are found by asking and opening groups, in several blocks."""
    for name, value in (("ROUNDS", (range(1),)), ("BLOCK", 8), ("SHARE", 4), *([("HEAVY", heavy)] if heavy else [])):  # some ranges are larger than 150 tokens
        monkeypatch.setattr(jaccard, name, value)
    rng = np.random.default_rng(31)
    words = [f"w{i}" for i in range(900)]
    passage = " ".join(rng.choice(words, 70))
    texts = [f"{passage} {' '.join(rng.choice(words, n))}" for n in (2, 3, 8, 11, 12, 13, 14, 15, 16, 17, 18, 30, 60, 200) for _ in range(3)]
    for copies in (40, 25, 6):
        base = rng.choice(words, 110).tolist()
        for _ in range(copies):  # a chain: each is a copy of the one before
            base = list(base)
            for _ in range(int(rng.integers(1, 4))):
                base[rng.integers(110)] = str(rng.choice(words))
            texts.append(" ".join(base))
    rows = [(i, t) for i, t in enumerate(texts)]
    want = brute_links(rows)
    got = jaccard.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_links for r in got} == want
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in rows}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    while any(label[i] != label[j] for i, j in links):
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert {r.doc_id: r.component_id for r in got} == label and len(set(label.values())) < len(texts) - 30
