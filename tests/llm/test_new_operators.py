"""Operators 11 to 13 against brute force, on small tables with nulls, ties, repeated rows and odd texts."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from driftloom.llm import exact_dedup, filter_audit, queries, word_runs

DATA = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_filter_interactions", "op13_block_naming"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    frame = queries.QUERIES[name](spark, DATA)
    want = con.sql(queries.ORACLES[name])
    columns = sorted(frame.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(tuple, frame.select(columns).collect())) == sorted(want.select(*columns).fetchall())


def audit_by_hand(docs, labels):
    good, toxic = ({i for i, q, t in labels if (q, t)[k] == 1} for k in (0, 1))
    facts = []
    for i, source, text in docs:
        text = text or ""
        w = WORDS.findall(text)
        same = [j for j, _, t in docs if (t or "") == text]
        failed = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": any(j is not None and (i is None or j < i) for j in same),
        }
        facts.append((source or "", {c for c, x in failed.items() if x}, i in good and i is not None, i in toxic and i is not None))
    out = {}
    for part in {f[0] for f in facts}:
        own, shapley = [f for f in facts if f[0] == part], Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, c in enumerate(order):
                before = set(order[:k])
                gone = [f for f in own if c in f[1] and not f[1] & before]
                shapley[c] += len(gone)
                out[part, order, k + 1] = [sum(not f[1] & (before | {c}) for f in own), len(gone), sum(c in f[1] for f in own) - len(gone), sum(f[1] == {c} for f in own), sum(f[2] for f in gone), sum(f[3] for f in gone), c]
        for key in out:
            if key[0] == part:
                out[key][-1] = shapley[out[key][-1]]
    return {(*k, *v) for k, v in out.items()}


def test_filter_interactions(spark):
    rng, plain = random.Random(5), " ".join(f"w{i}" for i in range(60))
    texts = [None, "", "short", plain, plain, "A" * 300, plain + " #", "x " * 70, "x " * 70, "X y " * 40 + "|", "é" * 50, "a\x0bb\x1cc\xa0d " * 20, plain.upper(), "z" * 5000]
    docs = [(i, rng.choice([None, "s", "t", "s", ""]), rng.choice(texts)) for i in range(120)]
    docs += [(3, "s", plain), (3, "s", plain), (None, "t", plain), (None, "t", "only without id"), (None, None, "only without id")]
    labels = [(i, rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 100, 2)] + [(4, 1, None), (5, None, 1), (None, 1, 1), (4, 1, 0)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, source string, text string, part int").withColumn("mask", F.lit("x"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [tuple(r) for r in filter_audit.filter_interactions(frame, marks).collect()]
    want = audit_by_hand(docs, labels)
    assert len(got) == len(want) == 600 * len({d[1] or "" for d in docs}) and set(got) == want
    assert filter_audit.filter_interactions(frame.limit(0), marks).count() == 0
    # without labels nothing good or toxic is lost
    assert filter_audit.filter_interactions(frame, marks.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_removal_polynomial():
    rng = random.Random(2)
    counts = {m: rng.randint(0, 9) for m in range(16)}
    r = filter_audit.RemovalPolynomial(counts, 4)
    for corner in range(16):
        assert r.at(corner) == sum(n for m, n in counts.items() if m & corner)
    assert sum(r.shapley(i) for i in range(4)) == r.at(15)
    with pytest.raises(ValueError):
        filter_audit.audit(None, "AAB")


def runs_by_hand(s, least, periods):
    out = []
    for p in range(1, len(s) // periods + 1):
        i = 0
        while i + p < len(s):
            j = i
            while j + p < len(s) and s[j] == s[j + p]:
                j += 1
            n = j + p - i
            if j > i and n >= max(least, periods * p) and not any(s[i : i + n - q] == s[i + q : i + n] for q in range(1, p)):
                out.append((i, n, p))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def words_like(rng):
    s, letters = [], rng.choice([1, 2, 3, 5])
    while len(s) < rng.randint(0, 60):
        s += [rng.randrange(letters) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 7])
    return s


def test_runs_of_random_strings():
    rng = random.Random(7)
    for _ in range(3000):
        s = words_like(rng)
        for least, periods in ((6, 4), (2, 2), (9, 3)):
            assert word_runs.find_runs(s, least, periods) == runs_by_hand(s, least, periods), s


def test_edges_are_next_smaller_suffixes():
    rng = random.Random(8)
    for _ in range(500):
        s = words_like(rng)
        want = []
        for i in range(len(s)):
            j = next((j for j in range(i + 1, len(s)) if s[j:] < s[i:]), None)
            if j is not None:
                want.append((i, j, next(k for k in range(len(s)) if j + k == len(s) or s[i + k] != s[j + k])))
        assert sorted(word_runs.lyndon_edges(s, -1)) == want


def test_matching_is_linear():
    class Counted(int):
        seen = 0

        def __eq__(self, other):
            Counted.seen += 1
            return int(self) == int(other)

        __hash__ = int.__hash__

    a, b = [0], [0, 1]
    while len(b) < 20000:
        a, b = b, b + a
    nested = [0]
    for i in range(1, 9):
        nested = nested * 3 + [i]
    for s in (b, nested, [0] * 20000, [0, 1] * 10000, [random.Random(i).randrange(40) for i in range(500)] * 40):
        Counted.seen = 0
        word_runs.lyndon_edges([Counted(x) for x in s], 2)
        assert Counted.seen <= 4 * len(s)


def digest_by_hand(doc_id, text, planted=True):
    w = WORDS.findall(text or "")
    n = len(w)
    if planted and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = runs_by_hand(w, 6, 4)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] and 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_word_runs(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n\t", "a", "a " * 5, "a " * 6, "a b " * 3, "x a b a b a b a b y", "a b a b a b a b a " * 2, "é\xa0b é\xa0b é\xa0b é\xa0b é\xa0b\x0bé\xa0b", "the cat " * 500 + "dog " * 7, "A a A a A a A a"]
    texts += [" ".join(f"w{x}" for x in words_like(rng)) + rng.choice(["", " end", "\n"]) for _ in range(300)]
    rows = list(enumerate(texts)) + [(None, "b " * 9), (7, texts[7]), (7, "other")]
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    monkeypatch.setattr(word_runs, "PASS_BYTES", 2000)
    got = sorted(map(tuple, word_runs.digests(word_runs.word_runs(word_runs.repeat_periodically(frame))).collect()), key=str)
    assert got == sorted((digest_by_hand(i, t) for i, t in rows), key=str)
    assert word_runs.word_runs(frame.limit(0)).count() == 0
    # what the pieces are cut by loses nothing, with other bounds either
    short = word_runs.word_runs(frame, 4, 2).collect()
    by_id = {i: t for i, t in rows if i is not None and i != 7}
    assert all([tuple(x) for x in r.runs] == runs_by_hand(WORDS.findall(by_id[r.doc_id] or ""), 4, 2) for r in short if r.doc_id in by_id)


def test_word_runs_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect() if len(r.text) < 6000]
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_word_runs"](spark, DATA).collect()}
    assert len(got) == 200 and all(got[i] == digest_by_hand(i, t) for i, t in docs)
    assert sum(r[1] > 0 for r in got.values()) >= 5


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def duplicates_by_hand(rows):
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if lower(u) == lower(t)]
        keep = max((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), sha(lower(t))))
    return sorted(out, key=str)


@pytest.mark.parametrize("size, bits", [(4096, 64), (3, 64), (3, 2), (1, 1), (7, 0)])
def test_exact_duplicates(spark, size, bits):
    """Small blocks make many levels; hashes of few bits are shared by different blocks."""
    rng = random.Random(size)
    texts = [None, "", "a", "A", "aa", "aaa", "aaab", "É", "é", "ÉA", "Éa", "x" * 50, "X" * 50, "x" * 49 + "y", "ab" * 21, "AB" * 21, "ab" * 20, "\x00", " "]
    rows = [(i, rng.choice(texts)) for i in range(60)] + [(100 + i, "".join(rng.choice("aAbB") for _ in range(rng.randint(0, 7)))) for i in range(80)]
    rows += [(5, "same"), (5, "Same"), (None, "same"), (None, "none"), (None, "NONE")]
    frame = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, kept int, name int").repartition(5)
    got = exact_dedup.exact_duplicates(frame, block_bytes=size, hashed=lambda c: F.shiftrightunsigned(F.xxhash64(c), 64 - bits) if bits else F.lit(0).cast("long")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == duplicates_by_hand(rows)
    # one row of each group is kept, and it has the largest id
    kept = [r for r in got if r.kept]
    assert len(kept) == len({lower(t) for _, t in rows}) == len({r.text_sha256 for r in kept}) and all(r.doc_id == r.keep_id for r in kept)


def test_exact_duplicates_of_nothing(spark):
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
