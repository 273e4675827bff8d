"""Queries without SQL cover every order and packet, held against plain versions on a small table of large ids."""

import hashlib
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from driftloom.operators import planning
from driftloom.plans import registry

registry.load()


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = np.random.default_rng(11)
    orders = [(k, i % 20) for i, k in enumerate((1, 499, 500, 1999, 2000, *range(7000, 7075)))]
    lines = [(k, int(rng.integers(1, 9)), int(rng.integers(1, 5)), n, float(rng.integers(1, 50)), str(rng.choice(list("ANR"))), "O", 0.0, 0.0) for k, _ in orders for n in range(1, int(rng.integers(2, 9)))]
    path = str(tmp_path_factory.mktemp("small"))
    spark.createDataFrame([(*o, "1-URGENT") for o in orders], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    return path, dict(orders), lines


def by_order(lines):
    out = defaultdict(list)
    for line in lines:
        out[line[0]].append(line)
    return out


def plain_matches(order, of):
    """Base edges in order; each takes the best edge that is left: exact, then same ends, then one end and the relation."""
    ends = lambda side, x: [(None if x[3] % 3 == side else str(x[k]), f"{word} {x[k]}") for k, word in ((1, "part"), (2, "supplier"))]
    same = lambda a, b: a[0] == b[0] if a[0] and b[0] else a[1] in b[1] or b[1] in a[1]
    left, out = list(of), []
    for x in of:
        kinds = []
        for y in left:
            raw = "X" if y[3] == 1 else "returned" if y[5] == "R" else y[5]
            subject, object_ = (same(a, b) for a, b in zip(ends(0, x), ends(1, y), strict=True))
            relation = x[5] == {"returned": "R"}.get(raw, raw)
            kind = "EXACT_SAME" if subject and object_ and relation else "TYPE_FLIP" if subject and object_ else "OBJECT_FLIP" if subject and relation else "SUBJECT_FLIP" if object_ and relation else None
            if kind:
                kinds.append(({"EXACT_SAME": 1.0, "TYPE_FLIP": 0.85}.get(kind, 0.7), kind, y, raw))
        if not kinds:
            out.append((str(order), f"0:{x[3]}", "DISAPPEARED", None, None, 0.0))
            continue
        score, kind, y, raw = max(kinds, key=lambda z: z[0])
        left.remove(y)
        many = sum(z[1] == kind for z in kinds) > 1 and kind != "EXACT_SAME"
        out.append((str(order), f"0:{x[3]}", "AMBIGUOUS" if many else kind, f"1:{y[3]}", raw, score))
    return out


def test_greedy_matches_of_every_order(spark, small):
    path, _, lines = small
    want = [w for order, of in by_order(lines).items() for w in plain_matches(order, of)]
    got = [tuple(r) for r in registry.QUERIES["greedy_edge_matches"](spark, path).select("run_id", "base_id", "outcome", "cf_id", "relation_after", "score").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {w[2] for w in want} >= {"EXACT_SAME", "TYPE_FLIP", "AMBIGUOUS"}


def plain_plan(rows, budget):
    """``rows``: (id, family, cost, family yield, group yield, draw) in order."""
    families = defaultdict(list)
    for r in rows:
        families[r[1]].append(r)
    if budget < 4:
        return [r[0] for r in sorted(rows, key=lambda r: (-r[3], r[2], r[5]))[:budget]]
    picked = [min(families[f], key=lambda r: r[2]) for f in sorted(families)[: max(1, min(len(families), round(budget * 0.34)))]]
    rest = budget - len(picked)
    weight = {f: (of[0][3] + 0.001) ** 1.5 for f, of in families.items()}
    by_weight = sorted(weight, key=lambda f: -weight[f])
    share = {f: round(rest * weight[f] / sum(weight.values())) for f in families}
    turn = 0
    while sum(share.values()) < rest:
        share[by_weight[turn % len(by_weight)]] += 1
        turn += 1
    while sum(share.values()) > rest:
        f = by_weight[turn % len(by_weight)]
        share[f] -= share[f] > 0
        turn += 1
    for f, of in families.items():
        picked += sorted((r for r in of if r not in picked), key=lambda r: (-r[4], r[2], r[5]))[: share[f]]
    return [r[0] for r in picked[:budget]]


def test_adaptive_plan_of_every_document(spark, small):
    path, _, lines = small
    want = []
    for order, of in by_order(lines).items():
        rows = [(f"{order}:{x[3]}", x[5], x[4], 0.5 if x[5] == "R" else 0.1, x[4] / 50, hashlib.sha256(f"0|{order}:{x[3]}".encode()).hexdigest()) for x in of]
        want += [(str(order), i, k) for k, i in enumerate(plain_plan(sorted(rows), 4), 1)]
    assert sorted(tuple(r) for r in registry.QUERIES["adaptive_planner"](spark, path).collect()) == sorted(want)


@pytest.mark.parametrize("budget", [0, 2, 4, 7, 12])
def test_adaptive_plan_with_other_budgets(spark, budget):
    rng = np.random.default_rng(budget)
    rows = [(f"i{k:02d}", "ABCDE"[rng.integers(5)], float(rng.integers(1, 9)), 0.0, float(rng.integers(0, 4)) / 4) for k in range(30)]
    rows = [(i, f, c, {"A": 0.4, "B": 0.0, "C": 0.7, "D": 0.1, "E": 0.2}[f], g) for i, f, c, _, g in rows]
    frame = spark.createDataFrame([("d", *r) for r in rows], "document_id string, intervention_id string, cause_family string, estimated_cost double, family_yield double, group_yield double")
    got = [r.intervention_id for r in planning.adaptive(frame, budget).orderBy("rank").collect()]
    assert got == plain_plan([(*r, hashlib.sha256(f"0|{r[0]}".encode()).hexdigest()) for r in rows], budget)


def test_budgeted_stream_leaves_families_not_the_stream(spark):
    rng = np.random.default_rng(1)
    rows = [("s", f"r{k:03d}", "AB"[k % 2], float(-k), float(rng.integers(1, 4)), bool(k % 2 or rng.random() < 0.1)) for k in range(300)]
    spent, n, bad, stopped, want = 0.0, defaultdict(int), defaultdict(int), set(), {}
    for _, run, family, _, cost, violated in rows:
        want[run] = family not in stopped and spent + cost <= 250
        if want[run]:
            spent += cost
            n[family] += 1
            bad[family] += violated
            p, m = bad[family] / n[family], n[family]
            low = (p + 1.96**2 / (2 * m) - 1.96 * (p * (1 - p) / m + 1.96**2 / (4 * m * m)) ** 0.5) / (1 + 1.96**2 / m)
            if m >= 25 and low > 0.2:
                stopped.add(family)
    got = {r.run_id: r.taken for r in planning.budgeted_stream(spark.createDataFrame(rows, "stream string, run_id string, family string, priority double, cost double, violated boolean"), 250.0).collect()}
    assert got == want and stopped == {"B"} and sum(want[r[1]] for r in rows if r[2] == "A") > 50


def test_shared_tails_of_every_packet(spark, small):
    path, customer, lines = small
    held = defaultdict(set)
    for order, part, supp, *_ in lines:
        held[customer[order] % 10, f"s:{supp}"].add((f"p:{part}", customer[order]))
    want = {(packet, tail, *sorted((x, y))) for (packet, tail), of in held.items() for (x, a), (y, b) in combinations(of, 2) if x != y and a != b}
    got = [tuple(r) for r in registry.QUERIES["cross_document_queries"](spark, path).where("shape = 'shared_tail'").select("packet", "key", "x", "y").collect()]
    assert len({w[0] for w in want}) == 10 and sorted(got) == sorted(want)


def test_bundle_has_the_single_metrics(spark):
    data = "/root/testdata/sf0.001"
    bundle = {(r.family, r.doc): r for r in registry.QUERIES["drift_bundle"](spark, data).collect()}
    for name, column, own in (("edge_jaccard", "edge", "jaccard"), ("entity_pair_jaccard", "entity_pair", "jaccard"), ("degree_distribution_shift", "degree_shift", "degree_shift"), ("path_preservation", "preserved", "preserved"), ("centrality_rank_correlation", "centrality", "centrality"), ("type_flip_rate", "flip", "flip")):
        single = registry.QUERIES[name](spark, data).collect()
        assert len(single) == len(bundle) and all(abs(bundle[r.family, r.doc][column] - r[own]) < 1e-6 for r in single)


def test_component_change_equals_plain_search(spark, small):
    path, customer, lines = small
    docs = defaultdict(list)
    for order, part, supp, n, *_ in lines:
        docs[customer[order]].append((order, part, supp, n))

    def count(edges):
        above = {}

        def root(x):
            while above.setdefault(x, x) != x:
                x = above[x]
            return x

        for a, b in edges:
            above[root(a)] = root(b)
        return len({root(x) for x in list(above)})

    got = {(r.family, r.doc): r.change for r in registry.QUERIES["component_change"](spark, path).collect()}
    for doc, of in docs.items():
        heads = [(f"c{doc}", f"o{k}") for k in {x[0] for x in of} | {k for k, c in customer.items() if c == doc}]
        base = heads + [(f"o{k}", e) for k, p, s, _ in of for e in (f"p{p}", f"s{s}")]
        lost = heads + [(f"o{k}", e) for k, p, s, n in of if n != 1 for e in (f"p{p}", f"s{s}")] if doc % 50 else []
        assert got["evidence", doc] == abs(count(base) - (count(lost) if lost else 0))


def test_cluster_bootstrap_interval_covers(spark):
    rng = np.random.default_rng(8)
    rows = [(c, float(v)) for c in range(120) for v in rng.normal(rng.normal(5, 2), 1, 4)]
    from driftloom.operators import statistics

    got = statistics.cluster_bootstrap(spark.createDataFrame(rows, "c long, v double"), "c", "v", 300).first()
    means = np.array([np.mean([v for c, v in rows if c == k]) for k in range(120)])
    draws = [means[rng.integers(0, 120, 120)].mean() for _ in range(2000)]
    low, high = np.percentile(draws, [2.5, 97.5])
    assert abs(got["mean"] - means.mean()) < 1e-9 and abs(got.low - low) < 0.15 and abs(got.high - high) < 0.15
