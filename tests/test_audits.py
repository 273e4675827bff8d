"""Inventories, output modes, policies and budgets against plain versions, with nulls, ties and empty tables."""

import hashlib
import random
from collections import Counter, defaultdict
from math import comb

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from driftloom.operators import inventory, modes, policies, statistics


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def reasons(audit, *keys):
    return {tuple(r[k] for k in keys): r["reason"] for r in audit.collect()}


def test_query_inventory_reasons(spark):
    declared = spark.createDataFrame([("a", "f", True, 2), ("a", "g", False, 0), ("b", "f", True, 1), ("c", "f", True, 3), ("d", "f", True, 2), ("e", "f", True, 2), ("g", "f", None, None), (None, "f", True, 1)], "run string, family string, eligible boolean, n_queries int")
    registered = spark.createDataFrame([("a", "f", "1"), ("a", "f", "2"), ("c", "f", "1"), ("d", "f", "1"), ("d", "f", "1"), ("e", "f", "1"), ("e", "f", "9"), ("h", "f", "1"), (None, "f", "1")], "run string, family string, q string")
    rebuilt = spark.createDataFrame([("a", "f", "1"), ("a", "f", "2"), ("a", "f", "2"), ("c", "f", "1"), ("d", "f", "1"), ("d", "f", "2"), ("e", "f", "1"), ("e", "f", "2"), ("g", "f", "1"), ("i", "f", "1"), (None, "f", "1")], "run string, family string, q string")
    audit = inventory.query_inventory(declared, registered, rebuilt, ["run", "family"], "q")
    want = {"a": None, "b": "eligibility", "c": "count", "d": "duplicate", "e": "inventory", "g": "eligibility", "h": "unknown", "i": "unregistered", None: None}
    assert reasons(audit, "run", "family") == {(k, "f"): v for k, v in want.items()} | {("a", "g"): None}
    with pytest.raises(ValueError, match="count"):
        inventory.require(audit)
    inventory.require(audit.where("run is null"))
    none = inventory.query_inventory(declared.limit(0), registered.limit(0), rebuilt.limit(0), ["run", "family"], "q")
    assert none.count() == 0


def test_edge_inventory(spark):
    edges = spark.createDataFrame([("x", "s", "r", "o"), ("x", "s", "r", "o"), ("x", None, "r", "o"), ("y", "s", "r", None)], "event_id string, s string, r string, o string")
    events = spark.createDataFrame([("x",), ("y",), ("z",), ("z",)], "event_id string")
    c = lambda *n: Row(**dict(zip(inventory.COUNTS, n, strict=True)))
    schema = "run_id string, base_event_id string, cf_event_id string, base_counts struct<all_rows:int,linked_rows:int,typed_edges:int,unlinked_rows:int>, cf_counts struct<all_rows:int,linked_rows:int,typed_edges:int,unlinked_rows:int>"
    pairs = spark.createDataFrame([("1", "x", "y", c(3, 2, 1, 1), c(1, 0, 0, 1)), ("2", "x", "z", c(3, 2, 2, 1), c(0, 0, 0, 0)), ("3", "w", None, c(0, 0, 0, 0), c(0, 0, 0, 0)), ("4", "x", "y", None, c(1, None, 0, 1))], schema)
    got = reasons(inventory.edge_inventory(pairs, events, edges), "run_id", "side")
    assert got == {("1", "base"): None, ("1", "cf"): None, ("2", "base"): "edge_counts", ("2", "cf"): None, ("3", "base"): "missing_event", ("3", "cf"): "missing_event", ("4", "base"): "edge_counts", ("4", "cf"): "edge_counts"}


CONDITIONS = ["base", "c1", "c2", "c3", "c4", "c5"]


def plain_mode(cells, modes_, docs):
    """What a mode reaches: successes, pairs and evaluable pairs per condition, whether it qualifies."""
    out = {}
    for m in modes_:
        mine = {k[1:]: v for k, v in cells.items() if k[0] == m}
        ok = {c: sum(v is not None for (d, cc), v in mine.items() if cc == c) for c in CONDITIONS}
        pairs, real = Counter(), Counter()
        for c in CONDITIONS[1:]:
            for d in docs:
                b, x = mine.get((d, "base")), mine.get((d, c))
                if b is not None and x is not None:
                    pairs[c] += 1
                    real[c] += bool(b or x)
        whole = len(mine) == 60 and sum(ok.values()) >= 54 and ok["base"] >= 9 and min(ok.values()) >= 8
        whole = whole and all(pairs[c] >= 8 and real[c] >= 7 for c in CONDITIONS[1:]) and sum(pairs.values()) >= 45 and sum(real.values()) >= 40
        out[m] = (len(mine), sum(ok.values()), sum(pairs.values()), sum(real.values()), whole)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_modes_equal_plain_rules(spark, seed):
    rng = random.Random(seed)
    rows, want = [], {}
    for group, (fails_one, fails_two, empty) in {"good": (0.02, 0.02, 0.05), "second": (0.45, 0.01, 0.05), "none": (0.5, 0.4, 0.1), "empty": (0.0, 0.0, 0.6), "gap": (0.3, 0.0, 0.0)}.items():
        cells = {}
        for m, fails in (("native", fails_one), ("json_object", fails_two)):
            for d in range(10):
                for c in CONDITIONS:
                    if group == "gap" and m == "native" and (d, c) == (3, "c2"):
                        continue
                    rows.append((group, m, d, c, 0, 7))  # an older record, which does not count
                    cells[m, d, c] = None if rng.random() < fails else 0 if rng.random() < empty else rng.randint(1, 4)
                    rows.append((group, m, d, c, 1, cells[m, d, c]))
        report = plain_mode(cells, ["native", "json_object"], range(10))
        both = [(cells["native", d, c], cells["json_object", d, c]) for d in range(10) for c in CONDITIONS if ("native", d, c) in cells]
        b, a = sum(x is None and y is not None for x, y in both), sum(x is not None and y is None for x, y in both)
        p = sum(comb(a + b, i) for i in range(b, a + b + 1)) / 2 ** (a + b)
        gain = report["json_object"][1] - report["native"][1]
        chosen = "native" if report["native"][4] else "json_object" if report["json_object"][4] and gain >= 6 and p < 0.05 else None
        want[group] = (report, len(both), b, a, p, gain, chosen)
    rows += [("good", "other", 0, "base", 1, 1), ("good", "native", 0, "c9", 1, 1)]  # an unknown mode and an unknown condition
    found = modes.cells(spark.createDataFrame(rows, "corpus string, mode string, doc int, condition string, at int, n_edges int"), ["corpus"], ["native", "json_object"], CONDITIONS, ["at"])
    for r in modes.mode_report(found, ["corpus"], CONDITIONS).collect():
        assert (r.attempted, r.parsed, r.parse_pairs, r.evaluable_pairs, r.qualified) == want[r.corpus][0][r.mode], (r.corpus, r.mode)
    for r in modes.select_mode(found, ["corpus"], CONDITIONS, "native", "json_object").collect():
        assert (r.common_cells, r.second_only, r.first_only, pytest.approx(r.p, abs=1e-12), r.improvement, r["mode"]) == want[r.corpus][1:]
    assert modes.select_mode(found.limit(0), ["corpus"], CONDITIONS, "native", "json_object").count() == 0


def test_one_mode_alone(spark):
    rows = [("a", "json_object", d, c, 0, 1) for d in range(10) for c in CONDITIONS]
    found = modes.cells(spark.createDataFrame(rows, "corpus string, mode string, doc int, condition string, at int, n_edges int"), ["corpus"], ["native", "json_object"], CONDITIONS, ["at"])
    (r,) = modes.select_mode(found, ["corpus"], CONDITIONS, "native", "json_object").collect()
    assert (r.first_qualified, r.second_qualified, r.common_cells, r.p, r["mode"]) == (False, True, 0, 1.0, None)


def test_binomial_tail(spark):
    pairs = [(n, k) for n in (0, 1, 2, 7, 20, 60) for k in range(n + 2)] + [(3000, 1500), (3000, 1650), (5, -1)]
    frame = spark.createDataFrame(pairs, "n int, k int").withColumn("p", statistics.binomial_upper_tail(F.col("n"), F.col("k")))
    for r in frame.collect():
        assert r.p == pytest.approx(sum(comb(r.n, i) for i in range(max(r.k, 0), r.n + 1)) / 2**r.n, abs=1e-9)


@pytest.mark.parametrize("shape", ["spread", "ties", "nulls", "one"])
def test_flags_at_count(spark, shape):
    rng = random.Random(shape)
    value = {"spread": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randint(0, 2)), "nulls": lambda: rng.choice([None, None, 1.0, rng.random()]), "one": lambda: 4.0}[shape]
    rows = [(g, i, value()) for g, n in (("a", 3000), ("b", 40), (None, 11), ("c", 1)) for i in range(n)]
    got = {(r.g, r.i): r.flag for r in statistics.flags_at_count(spark.createDataFrame(rows, "g string, i int, x double"), "x", "i", 0.15, ["g"]).collect()}
    assert len(got) == len(rows)
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, -(r[2] or 0), sha(str(r[1]))))
        k = round(len(mine) * 0.15)
        assert [r[1] for r in mine[:k]] == [r[1] for r in mine if got[g, r[1]]], (shape, g)
    assert statistics.flags_at_count(spark.createDataFrame([], "i int, x double"), "x", "i", 0.5).count() == 0
    assert sum(r.flag for r in statistics.flags_at_count(spark.createDataFrame(rows, "g string, i int, x double").withColumn("i", F.monotonically_increasing_id()), "x", "i", 0.5).collect()) == round(len(rows) * 0.5)


def test_digest_places(spark):
    rows = [(None if i % 3 == 0 else "a", f"r{i}") for i in range(700)]
    got = {(r.g, r.i): r.place for r in statistics.digest_places(spark.createDataFrame(rows, "g string, i string"), ["g"], "i", "s|", 16).collect()}
    for g in (None, "a"):
        order = sorted((i for h, i in rows if h == g), key=lambda i: sha("s|" + i))
        assert [got[g, i] for i in order] == list(range(1, len(order) + 1))


def test_policies_equal_plain_rules(spark):
    rng = random.Random(5)
    rows = [("c", f"r{i}", i % 17, rng.choice([None, rng.random()]), rng.random(), rng.random() < 0.3, rng.random()) for i in range(400)] + [("all", f"q{i}", i, 0.9, 0.9, True, 0.5) for i in range(5)]
    pairs = spark.createDataFrame(rows, "corpus string, run_id string, doc int, graph_drift double, query_drift double, harmful boolean, fidelity double")
    decided = policies.decisions(pairs, ["corpus"], "run_id")
    report = {(r.corpus, r.policy): r for r in policies.policy_report(decided, ["corpus"], "doc", 60).collect()}
    for corpus in ("c", "all"):
        mine = [r for r in rows if r[0] == corpus]
        joint = [(r[3] or 0) >= 0.45 or r[4] >= 0.7 for r in mine]
        first = set(sorted((r[1] for r in mine), key=lambda i: sha("random|" + i))[: sum(joint)])
        for policy, blocked in (("publish_all", [False] * len(mine)), ("graph_only", [(r[3] or 0) >= 0.45 for r in mine]), ("joint", joint), ("random", [r[1] in first for r in mine])):
            r, out = report[corpus, policy], [x for x, b in zip(mine, blocked, strict=True) if not b]
            harm = sum(x[5] for x in mine)
            assert r.n == len(mine) and r.published == pytest.approx(len(out) / len(mine))
            assert r.harm_recall == pytest.approx((harm - sum(x[5] for x in out)) / harm if harm else 0)
            assert r.published_harm == pytest.approx(sum(x[5] for x in out) / len(out) if out else 0)
            assert r.published_fidelity == pytest.approx(sum(x[6] for x in out) / len(out) if out else 0)
            if not out:
                assert (r.harm_low, r.harm_high, r.fidelity_low, r.fidelity_high) == (0, 0, 0, 0)
            else:
                assert r.fidelity_low <= r.published_fidelity <= r.fidelity_high and r.harm_low <= r.published_harm <= r.harm_high
                by_doc = defaultdict(list)
                for x in out:
                    by_doc[x[2]].append(x)
                means = []
                for _ in range(400):
                    sample = [x for d in rng.choices(sorted(by_doc), k=len(by_doc)) for x in by_doc[d]]
                    means.append(sum(x[6] for x in sample) / len(sample))
                means.sort()
                assert r.fidelity_low == pytest.approx(means[10], abs=0.05) and r.fidelity_high == pytest.approx(means[-11], abs=0.05)


@pytest.mark.parametrize("selector", policies.SELECTORS)
def test_selectors_equal_plain_greedy(spark, selector):
    rng = random.Random(selector)
    rows = [(f"s{i % 2}", f"r{i}", rng.choice(["x", "y", "z"]), float(rng.randint(1, 9)), rng.choice([None, float(rng.randint(0, 3))])) for i in range(300)]
    got = {(r.stream, r.run_id): r.taken for r in policies.selected_pairs(spark.createDataFrame(rows, "stream string, run_id string, family string, cost double, graph_drift double"), selector, 200.0).collect()}
    for s in ("s0", "s1"):
        mine = sorted((r for r in rows if r[0] == s), key=lambda r: sha("0|" + r[1]))
        if selector == "round_robin":
            turns, seen = [], Counter()
            for r in mine:
                seen[r[2]] += 1
                turns.append((seen[r[2]], r[2], r))
            mine = [t[2] for t in sorted(turns, key=lambda t: t[:2])]
        elif selector == "graph_first":
            mine.sort(key=lambda r: (-(r[4] if r[4] is not None else float("-inf")), r[1]))
        spent = 0
        for r in mine:
            fits = spent + r[3] <= 200
            spent += r[3] if fits else 0
            assert got[s, r[1]] == fits


def test_unknown_selector(spark):
    with pytest.raises(ValueError, match="unknown selector"):
        policies.selected_pairs(spark.createDataFrame([], "stream string, run_id string, family string, cost double, graph_drift double"), "best", 1.0)


@pytest.mark.parametrize("seed", range(3))
def test_harm_recovery_equals_plain_plans(spark, seed):
    rng = random.Random(seed)
    rates = {"a": 0.1, "b": 0.5, "c": 0.9, "d": 0.5, None: 0.0}
    rows = [(f"r{i}", f, rng.random() < rates[f]) for i in range(500) for f in [rng.choice(["a", "a", "a", "b", "c", "d", None])]]
    got = {(r.plan, r.permille): (r.selected, r.recovered) for r in policies.harm_recovery(spark.createDataFrame(rows, "run_id string, family string, harmful boolean"), (1, 100, 330, 900, 1000)).collect()}
    half = sorted(rows, key=lambda r: sha("half|" + r[0]))
    calib, rest = half[:250], sorted(half[250:], key=lambda r: sha("draw|" + r[0]))
    name = lambda r: r[1] or "unknown"
    of = defaultdict(list)
    for r in calib:
        of[name(r)].append(r[2])
    prior = {f: sum(v) / len(v) for f, v in of.items()}
    for m in (1, 100, 330, 900, 1000):
        k = max(1, round(250 * m / 1000))
        balanced, left = Counter(), Counter(map(name, rest))
        while sum(balanced.values()) < k:
            for f in sorted((f for f in left if balanced[f] < left[f]), key=sha):
                if sum(balanced.values()) < k:
                    balanced[f] += 1
        picked = {
            "random": rest[:k], "greedy": sorted(rest, key=lambda r: -prior.get(name(r), 0.0))[:k], "oracle": sorted(rest, key=lambda r: not r[2])[:k],
            "family_balanced": [r for f in left for r in [r for r in rest if name(r) == f][: balanced[f]]],
        }
        for plan, chosen in picked.items():
            assert got[plan, m] == (k, sum(r[2] for r in chosen)), (plan, m)


def plain_threshold(obs, mode, target, direction, weight=0.5):
    """The threshold of a mode by trying all candidates in order."""
    xs = sorted({m for m, _ in obs})
    tried = []
    for tau in [xs[0] - 1e-9] + [(a + b) / 2 for a, b in zip(xs, xs[1:])] + [xs[-1] + 1e-9]:
        flags = [m > tau if direction == "max" else m < tau for m, _ in obs]
        tp = sum(f and h for f, (_, h) in zip(flags, obs, strict=True))
        harm, on = sum(h for _, h in obs), sum(flags)
        p, r, a = tp / on if on else 0.0, tp / harm if harm else 0.0, on / len(obs)
        tried.append((tau, a, p, r, 2 * p * r / (p + r) if p + r else 0.0))
    met = {"recall_floor": lambda t: t[3] >= target, "alarm_budget": lambda t: t[1] <= target}.get(mode, lambda t: True)
    value = {"recall_floor": lambda t: -t[1], "alarm_budget": lambda t: t[3], "youden": lambda t: t[3] - t[1], "f1": lambda t: t[4], "utility": lambda t: weight * t[3] - (1 - weight) * t[1]}[mode]
    good = [t for t in tried if met(t)]
    if good:
        return max(good, key=value)
    best = max(tried, key=lambda t: t[3])
    return best if mode == "recall_floor" and best[3] > 0 else (tried[0][0], 0.0, 0.0, 0.0, 0.0)


@pytest.mark.parametrize("direction", statistics.DIRECTIONS)
def test_calibration_equals_plain_rule(spark, direction):
    rng = random.Random(direction)
    groups = {"mixed": [(rng.randint(0, 12) / 8, rng.random()) for _ in range(60)], "clean": [(rng.random(), 0.01) for _ in range(9)], "one": [(0.5, 0.2)], "harm": [(rng.random(), -0.3) for _ in range(9)]}
    rows = spark.createDataFrame([(g, m, u) for g, of in groups.items() for m, u in of] + [("mixed", None, 0.3), ("mixed", 0.3, None)], "g string, m double, u double")
    for mode in statistics.CALIBRATION_MODES:
        for target in (0.0, 0.4, 1.5) if mode == "recall_floor" else (-0.1, 0.25) if mode == "alarm_budget" else (0.0,):
            got = {r.g: (r.threshold, r.alarm_rate, r.precision, r.recall, r.f1) for r in statistics.calibrate_pairs(rows, ["g"], "m", "u", mode, target, direction).collect()}
            assert got == {g: pytest.approx(plain_threshold([(m, abs(u) > 0.05) for m, u in of], mode, target, direction)) for g, of in groups.items()}, (mode, target)
    with pytest.raises(ValueError, match="direction"):
        statistics.confusion_at_thresholds(rows, ["g"], "m", "u", "up")
    with pytest.raises(ValueError, match="mode"):
        statistics.calibrate(rows, ["g"], "best")


def test_curves(spark):
    rows = [("a", 0.1, 0), ("a", 0.1 + 1e-13, 1), ("a", 0.3, 0), ("a", 0.3 + 1e-9, 0), ("a", 1.0, 1), ("a", 7.0, 1), ("a", -2.0, 0), ("a", None, 1), ("b", 0.005, 1), ("c", 0.29, 0)]
    frame = spark.createDataFrame(rows, "g string, x double, h int")
    curve = statistics.risk_coverage(frame.where("g = 'a' and x is not null"), ["g"], "x", "h")
    assert [(round(r.coverage, 6), round(r.risk, 6)) for r in curve.orderBy("threshold").collect()] == [(round(n / 7, 6), round(h / n, 6)) for n, h in ((1, 0), (3, 1), (4, 1), (5, 1), (6, 2), (7, 3))]
    assert statistics.strict_coverage(curve, ["g"], 0.2).first().coverage == pytest.approx(5 / 7)
    assert statistics.strict_coverage(curve, ["g"], -1.0).first().coverage == 0.0
    grid = {(r.g, r.step): (r.coverage, r.risk) for r in statistics.gate_grid(frame, ["g"], "x", "h").collect()}
    assert len(grid) == 3 * 201
    for g in "abc":
        mine = [r for r in rows if r[0] == g]
        for i in range(201):
            out = [r for r in mine if r[1] is not None and r[1] < i / 200]
            assert grid[g, i] == (pytest.approx(len(out) / len(mine)), pytest.approx(sum(r[2] for r in out) / len(out) if out else 0.0)), (g, i)


def test_authority_audit(spark):
    from driftloom.operators import lineage

    events = spark.createDataFrame([("b", "d"), ("c", "d"), ("x", "e")], "event_id string, document_id string")
    pairs = spark.createDataFrame(
        [("ok", "d", "b", "c"), ("bare", "d", "b", "c"), ("rep", "d", "b", "c"), ("rep", "d", "b", "c"), ("nb", "d", None, "c"), ("nc", "d", "b", ""), ("same", "d", "b", "b"), ("bx", "d", "x", "c"), ("cx", "d", "b", "x"), ("wm", "d", "b", "c"), ("we", "d", "b", "c")],
        "run_id string, document_id string, base_event_id string, cf_event_id string",
    )
    witnesses = spark.createDataFrame([("ok", "m", "c"), ("wm", "m", None), ("wm", "n", "b"), ("we", "m", "c"), ("we", "n", "b"), ("bare", None, None), ("gone", "m", "c")], "run_id string, matched_edge_id string, event_id string")
    got = {r.run_id: (r.reason, r.witnessed) for r in lineage.authority_audit(pairs, events, witnesses).collect()}
    assert got == {
        "ok": (None, True), "bare": (None, False), "rep": ("repeated_run", False), "nb": ("missing_base", False), "nc": ("missing_counterfactual", False), "same": ("same_endpoint", False),
        "bx": ("base_elsewhere", False), "cx": ("counterfactual_elsewhere", False), "wm": ("witness_missing", True), "we": ("witness_elsewhere", True),
    }
