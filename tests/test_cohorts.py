"""Cross-document cohorts against a plain greedy pass, and resampling from counts against plain draws."""

import hashlib
import json
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftloom.operators import cohort, statistics


def plain_answers(edges, shape):
    """Answers of (s, r, o, doc) rows, each pair of branches looked at."""
    out = set()
    for (s, _, o, d), (t, _, p, e) in combinations(sorted(set(edges)), 2):
        if d != e and shape == "fanout" and s == t and o != p:
            out.add((s, *sorted((o, p))))
        if d != e and shape == "shared_tail" and o == p and s != t:
            out.add((o, *sorted((s, t))))
    return out


def plain_cohort(gold, design, packets=None):
    digest = lambda *x: hashlib.sha256(json.dumps(x, separators=(",", ":")).encode()).hexdigest()
    found = []
    for a, b in combinations(sorted(gold), 2):
        both = gold[a] | gold[b]
        if any(plain_answers(both, s) for s in cohort.SHAPES):
            found.append((digest(design, a, b, "cohort-rank"), a, b))
    used, out = set(), []
    for rank, a, b in sorted(found):
        if not {a, b} & used:
            used |= {a, b}
            out.append(("packet-" + digest(design, a, b)[:12], a, b, rank))
    return out[:packets] if packets else out


@pytest.mark.parametrize("seed, documents, nodes", [(1, 40, 12), (2, 25, 3), (3, 60, 200)])
def test_cohort_is_the_greedy_one(spark, seed, documents, nodes):
    rng = random.Random(seed)
    gold = {f"d{i:03}": {(f"h{rng.randrange(nodes)}", "CID", f"t{rng.randrange(nodes)}", f"d{i:03}") for _ in range(rng.randint(0, 4))} for i in range(documents)}
    edges = spark.createDataFrame([(d, s, r, o) for d, es in gold.items() for s, r, o, _ in es], "doc string, s string, r string, o string")
    want = plain_cohort(gold, "x")
    got = cohort.build_cohort(edges, "x")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    some = cohort.build_cohort(edges, "x", 2) if len(want) > 1 else None
    assert some is None or sorted(map(tuple, some.collect())) == sorted(want[:2])
    with pytest.raises(ValueError):
        cohort.build_cohort(edges, "x", len(want) + 1)
    # X1 and X2 over the packets
    packed = cohort.packet_edges(edges, got)
    answers = {(r.packet, r["shape"], r.key, r.x, r.y) for r in cohort.packet_answers(packed).collect()}
    assert answers == {(p, s, *x) for p, a, b, _ in want for s in cohort.SHAPES for x in plain_answers(gold[a] | gold[b], s)}


def test_pairs_need_different_documents(spark):
    rows = [("a", "C", "CID", "D1"), ("b", "C", "CID", "D2"), ("a", "C1", "CID", "D"), ("b", "C2", "CID", "D"), ("a", "X", "CID", "Y1"), ("a", "X", "CID", "Y2"), ("c", "X2", "CID", "Y3"), ("d", "C", "CID", "D1")]
    edges = spark.createDataFrame(rows, "doc string, s string, r string, o string")
    # a and d have the same edge from C and no other, so that they answer nothing together
    assert {(r.doc_a, r.doc_b) for r in cohort.answering_pairs(edges).collect()} == {("a", "b"), ("b", "d")}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def f1(a, b):
    return 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0


def test_records_and_summary(spark):
    rng = random.Random(9)
    packets, conditions = [f"p{i}" for i in range(30)], ["gold", "cached", "ab", "ba", "again"]
    edges = {(p, c): {(f"h{rng.randrange(3)}", "CID", f"t{rng.randrange(3)}", rng.choice("xy")) for _ in range(rng.choice([0, 0, 2, 3, 5]))} for p in packets for c in conditions}
    frame = spark.createDataFrame([(p, c, *e) for (p, c), es in edges.items() for e in es], "packet string, condition string, s string, r string, o string, source string")
    chosen = spark.createDataFrame([(p, "x", "y", "") for p in packets], "packet string, doc_a string, doc_b string, rank string")
    bare = lambda es: {e[:3] for e in es}
    comparisons = {"order": ("ab", "ba"), "seed": ("ab", "again")}
    got = {(r.packet, r.comparison): r for r in cohort.comparison_records(frame, chosen, comparisons).collect()}
    assert len(got) == 60
    for (p, n), r in got.items():
        a, b = (edges[p, c] for c in comparisons[n])
        assert math.isclose(r.semantic_graph_drift, 1 - jaccard(bare(a), bare(b))) and math.isclose(r.provenance_graph_drift, 1 - jaccard(a, b))
        drift = {s: 1 - jaccard(plain_answers(a, s), plain_answers(b, s)) for s in cohort.SHAPES}
        active = [drift[s] for s in cohort.SHAPES if plain_answers(edges[p, "gold"], s)]
        assert math.isclose(r.max_query_drift, max(active, default=0.0)) and math.isclose(r.mean_query_drift, sum(active) / len(active) if active else 0.0)
        assert all(r[f"{s}_both_empty"] == (not plain_answers(a, s) and not plain_answers(b, s)) for s in cohort.SHAPES)
    quality = cohort.quality_records(frame, chosen, conditions[1:])
    for r in quality.collect():
        own, gold = edges[r.packet, r.condition], edges[r.packet, "gold"]
        assert math.isclose(r.semantic_f1, f1(bare(own), bare(gold))) and math.isclose(r.provenance_f1, f1(own, gold))
        active = [s for s in cohort.SHAPES if plain_answers(gold, s)]
        assert math.isclose(r.macro_f1, sum(f1(plain_answers(own, s), plain_answers(gold, s)) for s in active) / len(active) if active else 0.0)
        hits = [len(plain_answers(own, s) & plain_answers(gold, s)) / len(plain_answers(own, s)) if plain_answers(own, s) else 0.0 for s in active]
        assert math.isclose(r.macro_precision, sum(hits) / len(hits) if hits else 0.0)
    values = cohort.summary_values(cohort.comparison_records(frame, chosen, comparisons), quality, "order", "seed", "ab", "cached").collect()
    excess = {r.packet: r.value for r in values if r.section == "excess" and r.metric == "max_query_drift"}
    assert all(math.isclose(excess[p], got[p, "order"].max_query_drift - got[p, "seed"].max_query_drift, abs_tol=1e-12) for p in packets)
    rates = [r.value for r in values if (r.section, r.label, r.metric) == ("drift", "order", "graph_violation_rate")]
    assert sum(rates) == sum(got[p, "order"].provenance_graph_drift > 0.2 for p in packets) and len(rates) == 30
    assert sum(r.metric == "fanout_drift" and r.label == "order" for r in values) == sum(bool(plain_answers(edges[p, "gold"], "fanout")) for p in packets)


def plain_multinomial(cells, group, replicate):
    """Counts down the tree of digest bits, with Python's own arithmetic."""
    at = {c: int(hashlib.md5(f"{group}|{c}".encode()).hexdigest()[:8], 16) for c in cells}
    out = {}

    def draw(m, part, whole, level, prefix):
        d = hashlib.md5(f"{group}|{replicate}|{level}|{prefix}".encode()).hexdigest()
        u, v = ((int(d[i : i + 8], 16) + 0.5) / 2**32 for i in (0, 8))
        q = min(part, whole - part) / whole
        if m * q <= statistics.EXACT_MEAN:
            k, f = 0, (1 - q) ** m
            c = f
            while u > c and k < min(m, 40):
                k += 1
                f *= (m - k + 1) / k * q / (1 - q)
                c += f
        else:
            x = m * q + math.sqrt(m * q * (1 - q)) * math.sqrt(-2 * math.log(u)) * math.cos(2 * math.pi * v)
            k = max(0, min(m, math.floor(x + 0.5)))
        return k if 2 * part <= whole else m - k

    def down(m, level, prefix):
        own = {c: n for c, n in cells.items() if at[c] >> (32 - level) == prefix}
        if len(own) == 1:
            out[next(iter(own))] = m
        elif own:
            left = sum(n for c, n in own.items() if at[c] >> (31 - level) == 2 * prefix)
            k = 0 if not m or not left else m if left == sum(own.values()) else draw(m, left, sum(own.values()), level, prefix)
            down(k, level + 1, 2 * prefix)
            down(m - k, level + 1, 2 * prefix + 1)

    down(sum(cells.values()), 0, 0)
    return out


def test_draws_from_counts(spark):
    rng = random.Random(4)
    groups = {"a": {f"c{i}": rng.randint(1, 9) for i in range(60)}, "b": {"one": 7}, "c": {"x": 100_000, "y": 3, "z": 50_000}}
    frame = spark.createDataFrame([(g, c, n, "kept") for g, cs in groups.items() for c, n in cs.items()], "g string, cell string, n long, more string")
    got = statistics.multinomial(frame, ["g"], "cell", "n", 30).collect()
    by = {}
    for r in got:
        by.setdefault((r.g, r.replicate), {})[r.cell] = r.w
    assert len(by) == 90
    for (g, k), w in by.items():
        assert w == plain_multinomial(groups[g], g, k) and sum(w.values()) == sum(groups[g].values())


def test_draws_have_the_moments_of_a_multinomial(spark):
    cells = {"p": 5, "q": 40, "r": 1, "s": 154}
    frame = spark.createDataFrame(list(cells.items()), "cell string, n long")
    w = statistics.multinomial(frame, [], "cell", "n", 3000).groupBy("cell").agg(F.avg("w").alias("m"), F.var_samp("w").alias("v")).collect()
    for r in w:
        n, p = 200, cells[r.cell] / 200
        assert abs(r.m - n * p) < 5 * math.sqrt(n * p * (1 - p) / 3000) and abs(r.v / (n * p * (1 - p)) - 1) < 0.15


def test_interval_is_that_of_resampled_rows(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.exponential(2, 400), 3)
    frame = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("h", 2.5)], "g string, x double")
    got = {r.g: r for r in statistics.iid_bootstrap(frame, "x", 800, ["g"]).collect()}
    low, high = np.percentile([values[rng.integers(0, 400, 400)].mean() for _ in range(4000)], [2.5, 97.5])
    assert got["g"].n == 400 and abs(got["g"].mean - values.mean()) < 1e-9 and abs(got["g"].low - low) < 0.03 and abs(got["g"].high - high) < 0.03
    assert (got["h"].mean, got["h"].low, got["h"].high) == (2.5, 2.5, 2.5)


def test_pairs_of_a_common_node_are_not_written(spark, monkeypatch):
    rows, written = [], cohort.written
    monkeypatch.setattr(cohort, "written", lambda df, *a: (t := written(df, *a), rows.append(t.count()))[0])
    edges = spark.createDataFrame([(i, "hub", "CID", f"t{i}") for i in range(300)], "doc long, s string, r string, o string")
    found = cohort.build_cohort(edges, "x").collect()
    assert max(rows) <= 300  # there are 44,850 pairs
    gold = {i: {("hub", "CID", f"t{i}", i)} for i in range(300)}
    order = sorted((hashlib.sha256(json.dumps(["x", str(a), str(b), "cohort-rank"], separators=(",", ":")).encode()).hexdigest(), a, b) for a, b in combinations(gold, 2))
    used, want = set(), set()
    for rank, a, b in order:
        if not {a, b} & used:
            used |= {a, b}
            want.add((a, b, rank))
    assert {(r.doc_a, r.doc_b, r["rank"]) for r in found} == want


def test_records_of_packets_shuffle_no_answers(spark, capsys):
    from driftloom.plans import registry

    registry.load()
    for name in ("cross_document_records", "cross_document_quality"):
        frame = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        capsys.readouterr()
        frame.explain()
        assert capsys.readouterr().out.count("Exchange hashpartitioning") <= 1  # the packets themselves


def test_masks_say_the_same_as_conditions(spark):
    rng = random.Random(5)
    rows = sorted({(rng.choice("pq"), rng.choice(["gold", "ab", "ba"]), f"h{rng.randrange(3)}", "CID", f"t{rng.randrange(4)}", rng.choice("xy")) for _ in range(60)})
    frame = spark.createDataFrame(rows, "packet string, condition string, s string, r string, o string, source string")
    masks = cohort.condition_masks(frame, ["gold", "ab", "ba"])
    for shape in cohort.SHAPES:
        want = {}
        for r in cohort.packet_answers(frame, ["condition"]).where(F.col("shape") == shape).collect():
            want.setdefault((r.packet, r.key, r.x, r.y), set()).add(r.condition)
        got = {(r.packet, r.key, r.x, r.y): {c for i, c in enumerate(["gold", "ab", "ba"]) if r.mask >> i & 1} for r in cohort.answer_masks(masks, shape).collect()}
        assert got == want and want


def test_draws_broadcast_no_cells_and_spread_the_walks(spark, capsys):
    frame = spark.createDataFrame([("g", f"c{i}", 1 + i % 3) for i in range(200)], "g string, cell string, n long")
    capsys.readouterr()
    statistics.multinomial(frame, ["g"], "cell", "n", 3).explain()
    plan = capsys.readouterr().out
    assert plan.count("BroadcastExchange") <= 1  # a row per group
    assert "REPARTITION_BY_NUM" in plan


def test_pairs_on_heads_are_counted_in_as_many_tasks_as_asked(spark):
    rows = [(d, f"p{p}", f"s{(d * p) % 3}") for d in range(30) for p in range(5)] + [(1, "p1", "other")]
    found = cohort.pairs_on_heads(spark.createDataFrame(rows, "doc long, part string, supp string"), "part", "supp", 37)
    heads = {}
    for (a, p, s), (b, q, t) in combinations(sorted(rows), 2):
        if a != b and p == q and s != t:
            heads.setdefault((a, b), set()).add(p)
    assert {(r.doc_a, r.doc_b): r.n_heads for r in found.collect()} == {k: len(v) for k, v in heads.items()}
    assert found.select(F.spark_partition_id()).distinct().count() > 20  # the session has 4
