"""Queries on large lineages shuffle no rows per view, and give what the plain forms give."""

import random

import pytest

from driftloom.operators import graph_queries, views
from driftloom.plans import extractions, registry
from driftloom.sources.store import written

DATA = "/root/testdata/sf0.001"
registry.load()


def shuffles(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


def test_toolchain_edges_and_audit_are_not_shuffled(spark, capsys):
    edges, audit = extractions._canonical(spark, DATA)
    assert shuffles(edges, capsys) == 0 and shuffles(audit, capsys) == 0
    want = {tuple(r) for r in edges.collect()}
    assert {tuple(r) for r in extractions._tool_edges(spark, DATA).select(*edges.columns).collect()} == want


def test_elements_of_runs_stay_where_their_documents_lie(spark, capsys):
    edges = written(spark.createDataFrame([(d, f"{e}{d}", f"s{i}", "r", "o") for d in range(4) for e in "bxy" for i in range(3 if e == "b" else d)], "at long, event_id string, s string, r string, o string"), "edges", (3, "at"))
    runs = written(spark.createDataFrame([(d, f"{e}{d}", f"b{d}", f"{e}{d}") for d in range(4) for e in "xy"] + [(0, "z0", "b0", "b0")], "at long, run_id string, base_event_id string, cf_event_id string"), "runs", (3, "at"))
    docs, elements, families, index = views.indexed(runs, edges, 2, "at", (3, "at"))
    assert shuffles(elements, capsys) == 0
    got = {r.run_id: r.jaccard for r in views.per_run(views.jaccard(docs, elements, families), index).collect()}
    assert got == pytest.approx({f"{e}{d}": d / 3 for d in range(4) for e in "xy"} | {"z0": 1.0})


@pytest.mark.parametrize("edges", ["random", "chain", "none"])
def test_components_of_all_views_at_once(spark, edges):
    rng, families = random.Random(3), ("f", "g")
    rows = {
        "random": {(d, f"n{rng.randrange(14)}", f"r{rng.randrange(2)}", f"n{rng.randrange(14)}"): rng.randrange(1, 8) for d in range(5) for _ in range(4 * d + 2)},
        "chain": {(0, f"n{i:02d}", "r", f"n{(i * 7 + 7) % 60:02d}" if i % 2 else f"n{i + 1:02d}"): 7 if i % 9 else 5 for i in range(40)}, "none": {(0, "a", "r", "a"): 2},
    }[edges]
    elements = written(spark.createDataFrame([(*k, m) for k, m in rows.items()], "doc long, s string, r string, o string, mask long"), "edges", (2, "doc"))
    docs = elements.select("doc").distinct()
    want = graph_queries.component_change(docs, views.long_form(elements, families, "base"), families, "base")
    got = views.component_change(docs, elements, families, (2, "doc"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_components_make_no_row_per_view(spark, monkeypatch):
    sizes = {}

    def seen(df, name, *a, **k):
        sizes[name] = (out := written(df, name, *a, **k)).count()
        return out

    monkeypatch.setattr(views, "written", seen)
    monkeypatch.setattr(graph_queries, "written", seen)
    registry.QUERIES["component_change"](spark, DATA).count()
    elements = views.masked(registry_elements(spark).where("s <> o"), ["s", "o"]).count()
    assert sizes["neighbours"] <= 2 * elements


def registry_elements(spark):
    from driftloom.plans import derived

    return derived.elements(spark, DATA)
