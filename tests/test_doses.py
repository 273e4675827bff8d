"""Dose panels and slopes against plain ones, and the selection's memory."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from driftloom.operators import dose, planning


def plain_slope(panels):
    num = sum((x - np.mean([a for a, _ in p])) * (y - np.mean([b for _, b in p])) for p in panels for x, y in p)
    return 0.1 * num / sum((x - np.mean([a for a, _ in p])) ** 2 for p in panels for x, _ in p)


def test_dose_response(spark):
    rng, levels = random.Random(2), [0.25, 0.5, 1.0]
    rows, panels, reasons = [], {"g": [], "h": []}, {"g": [0, 0], "h": [0, 0]}
    for d in range(160):
        g, base, n, panel = "gh"[d % 2], rng.random() < 0.9, 0, []
        rows.append((g, d, None, 1, "ok" if base else "api_error", None, None))
        for level in levels:
            ok = rng.random() < 0.95
            x, y = level - rng.random() / 10, level * (0.3 if g == "g" else -0.1) + rng.gauss(0, 0.1)
            rows.append((g, d, level, 1, "ok", 9.0, 9.0))  # an earlier record, which does not count
            rows.append((g, d, level, 2, "ok" if ok else "parse_error", x if ok else None, y))
            panel += [(x, y)] * ok
        rows.append((g, d, 0.6, 2, "ok", 5.0, 5.0))  # no level of the design
        if base and len(panel) == 3:
            panels[g].append(panel)
        else:
            reasons[g][0 if not base else 1] += 1
    rows.append(("empty", 1, 0.25, 1, "ok", 0.2, 0.1))
    frame = spark.createDataFrame(rows, "corpus string, doc int, level double, seq int, status string, x double, y double")
    got = {r.corpus: r for r in dose.dose_response(dose.panels(frame, ["corpus"], levels, ["seq"]), ["corpus"], 3, 400).collect()}
    assert (got["empty"].documents, got["empty"].complete, got["empty"].slope, got["empty"].low) == (1, 0, None, None)
    draw = np.random.default_rng(1)
    for g in "gh":
        r = got[g]
        assert (r.documents, r.no_base, r.no_level, r.complete, r.observations) == (80, *reasons[g], len(panels[g]), 3 * len(panels[g]))
        assert abs(r.slope - plain_slope(panels[g])) < 1e-9
        boot = sorted(plain_slope([panels[g][i] for i in draw.integers(0, len(panels[g]), len(panels[g]))]) for _ in range(400))
        assert abs(r.low - boot[9]) < 0.004 and abs(r.high - boot[390]) < 0.004


def test_selection_keeps_no_pairs():
    """Two million pairs go through one stream; what Python holds at most does not follow their number."""

    def batches(n, size=20_000):
        for start in range(0, n, size):
            i = np.arange(start, start + size)
            yield pa.RecordBatch.from_arrays([pa.array(["s"] * size), pa.array(i.astype(str)), pa.array(np.where(i % 3 == 0, "a", "b")), pa.array(np.ones(size)), pa.array(i % 3 == 0)], names=["stream", "run_id", "family", "cost", "violated"])

    def peak(n):
        tracemalloc.start()
        taken = sum(sum(b.column("taken").to_pylist()) for b in planning.selected(batches(n), 1e12, 0.2, 25))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return taken, most

    few, many = peak(100_000), peak(2_000_000)
    assert few[0] < 100_000 and many[1] < 1.2 * few[1]


def test_nearest_event(spark):
    from driftloom.operators import lineage

    rng = random.Random(5)
    time = lambda: None if rng.random() < 0.05 else f"2026-01-01 00:{rng.randrange(60):02d}:00"
    some = lambda *x: rng.choice(x)
    runs = [(i, some("a", "b", None), some("v", None), time()) for i in range(120)]
    events = [(i, some("a", "b", None), some("v", None), time()) for i in range(60)]
    schema = "id int, k string, variant string, t string"
    r, e = spark.createDataFrame(runs, schema).withColumnRenamed("id", "run_id"), spark.createDataFrame(events, schema).withColumnRenamed("id", "event_id")
    got = {x.run_id: x.event_id for x in lineage.nearest_event(r, e, ["k"], ["variant"], "t", "t", "run_id", "event_id").collect()}
    want = {}
    for i, k, v, t in runs:
        near = [(abs(int(t[14:16]) - int(u[14:16])), j) for j, m, w, u in events if k and k == m and v == w and t and u]
        if near:
            want[i] = min(near)[1]
    assert got == want
