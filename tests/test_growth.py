"""What is shuffled follows the edges, not the pairs or answers that come of them."""

from hashlib import sha256
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from driftloom.operators import graph_queries, views
from driftloom.plans import registry
from driftloom.sources.store import written

DATA = "/root/testdata/sf0.001"
registry.load()


def plan(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out


@pytest.mark.parametrize("shape", ["fanout", "shared_tail"])
def test_pairs_across_documents_are_not_shuffled(spark, capsys, shape):
    rows = [(i % 2, f"s{i % 5}", f"o{i % 7}", i % 3 if i % 11 else None) for i in range(60)] + [(0, "s0", "o1", 0)] * 3 + [(0, None, "o1", 1), (0, "one", "a", 5), (0, "one", "b", 5)]
    edges = spark.createDataFrame(rows, "packet long, s string, o string, source long")
    found = graph_queries.cross_document(edges, ["packet"], shape, 3)
    shown = plan(found, capsys)
    held = {}
    for packet, s, o, source in rows:
        key, leaf = (s, o) if shape == "fanout" else (o, s)
        if None not in (key, leaf, source):
            held.setdefault((packet, key), set()).add((leaf, source))
    want = {(p, k, *sorted((x, y))) for (p, k), of in held.items() for (x, a), (y, b) in combinations(of, 2) if x != y and a != b}
    assert sorted(map(tuple, found.collect())) == sorted(want)
    assert shown.count("Exchange hashpartitioning") == 2 and "Aggregate" not in shown.split("Join")[0]


def test_quality_against_gold_has_no_shuffle(spark, capsys):
    assert "Exchange hashpartitioning" not in plan(registry.QUERIES["extraction_quality"](spark, DATA), capsys)


def test_levels_of_a_walk_stay_in_their_buckets(spark, capsys):
    edges = written(spark.createDataFrame([(d, f"n{i}", "r", f"n{i + 1}", 1) for d in range(3) for i in range(4)], "doc long, s string, r string, o string, mask long"), "walk", (3, "doc"))
    found = views.distances(edges, edges.where("s = 'n0'").select("doc", F.col("s").alias("source")), buckets=(3, "doc"))
    assert {tuple(r) for r in found.select("doc", "node", "hops").collect()} == {(d, f"n{i}", i) for d in range(3) for i in range(5)} and found.count() == 15
    shown = plan(found.groupBy("doc", "source").count(), capsys)
    assert "Exchange" not in shown and "SelectedBucketsCount: 3 out of 3" in shown


def graph(spark, docs=6, nodes=12, edges=40):
    """Rows of random edges (doc, s, r, o, mask) of two views, and the frame."""
    rows, seed = {}, 7
    for d in range(docs):
        for _ in range(edges * (d + 1) // docs):
            seed = (seed * 1103515245 + 12345) % (1 << 31)
            rows[d, f"n{seed // 8 % nodes}", f"r{seed // 97 % 2}", f"n{seed // 1031 % nodes}"] = 1 + seed // 64 % 3
    rows = [(*k, m) for k, m in rows.items()]
    return rows, spark.createDataFrame(rows, "doc long, s string, r string, o string, mask long")


@pytest.mark.parametrize("ahead", [0.02, 0.5, 1e9])
def test_documents_with_too_few_pairs_below_the_cut_are_done_again(spark, ahead):
    rows, elements = graph(spark)
    want = {}
    for doc in {r[0] for r in rows}:
        pairs = []
        for bit in (1, 2):
            next_to = {}
            for d, s, _, o, m in rows:
                if d == doc and m & bit and s != o:
                    next_to.setdefault(s, set()).add(o)
                    next_to.setdefault(o, set()).add(s)
            pairs.append({(a, b) for a in next_to for m in next_to[a] for b in next_to[m] | {m} if a < b})
        asked = sorted(pairs[0], key=lambda p: sha256("|".join(p).encode()).hexdigest())[:10]
        want[doc] = sum(p in pairs[1] for p in asked) / len(asked) if asked else 1.0
    found = views.path_preservation(elements.select("doc").distinct(), elements, ("f",), 10, ahead)
    assert {r.doc: r.preserved for r in found.collect()} == pytest.approx(want)


def test_nodes_alike_in_all_views_are_one_row(spark):
    rows = [(1, f"h{i % 3}", "r", f"t{i}", 3) for i in range(300)]
    few = views.alike(spark.createDataFrame(rows, "doc long, s string, r string, o string, mask long"), ("f",))
    assert {(r.b, r.c0, r.n) for r in few.collect()} == {(100, 100, 3), (1, 1, 300)}


@pytest.mark.parametrize("k", [0, 1, 3, 50])
def test_nodes_that_others_exceed_in_every_view_are_not_ranked(spark, k):
    rows = [(d, f"n{i:02}", (i * 7 + d) % 11 or None, (i * 5) % 13 or None, None if d == 2 else (i * 3) % 5) for d in range(3) for i in range(30)]
    counted = spark.createDataFrame(rows, "doc long, node string, b long, c0 long, c1 long")
    want = {(f, d, n, i + 1) for d in range(3) for j, f in enumerate(("base", "x", "y")) for i, (_, n) in enumerate(sorted((-r[j + 2], r[1]) for r in rows if r[0] == d and r[j + 2] is not None)[:k])}
    assert {(r.family, r.doc, r.node, r["rank"]) for r in views.top_nodes(counted, ("x", "y"), k).collect()} == want
    few = spark.createDataFrame([(1, f"n{i}", 9, 8) if i < 5 else (1, f"n{i}", 1, 2) for i in range(60)], "doc long, node string, b long, c0 long")
    assert views.leading(few, [F.col("b"), F.col("c0")], 5).count() == 5


def test_recall_of_two_models_needs_no_join_with_gold(spark, capsys):
    from driftloom.plans import derived

    docs, elements, families = derived.args(spark, DATA)
    own, marked = views.renamed(elements, derived.RENAMED), derived.edges(spark, DATA).withColumn("r", derived.own_name(F.col("r"))).groupBy("doc", "s", "r", "o").agg(F.bit_or("mask").alias("mask"), F.max("gold").alias("gold"))
    joined, counted = views.gold_recall(docs, own, derived.gold(spark, DATA), families, ["s", "r", "o"]), views.marked_recall(docs, marked, families)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, counted.collect()))
    assert plan(counted, capsys).count("Join") < plan(joined, capsys).count("Join")
