"""Diagnostic queries by id and mapped inputs, on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F

from driftloom.operators import diagnostics, inputs, views

FAMILIES = ("f", "g")
#: (doc, s, r, o, view) of two documents; the third has no edges.
EDGES = [
    *(("1", *e, "base") for e in (("a", "r", "b"), ("a", "q", "b"), ("a", "q", "c"), ("b", "r", "d"), ("d", "r", "d"))), *(("1", *e, "f") for e in (("a", "r", "b"), ("a", "q", "c"), ("c", "r", "a"))),
    *(("1", *e, "g") for e in (("a", "r", "b"), ("a", "q", "b"), ("a", "q", "c"), ("b", "r", "d"), ("d", "r", "d"))), ("2", "x", "r", "y", "base"), ("2", "x", "p", "y", "f"),
]


def plain_answers(query, edges):
    """A query's answers on one view's set of edges."""
    around = {}
    for s, _, o in edges:
        for n in (s, o):
            around.setdefault(n, set())
        if s != o:
            around[s].add(o)
            around[o].add(s)
    match query.split(".")[1]:
        case "edge_identity":
            return set(edges)
        case "two_hop_endpoints":
            return {(a[0], b[2]) for a in edges for b in edges if a[2] == b[0] and a[0] != b[2]}
        case "fanout_join":
            return {(a, b) for a in edges for b in edges if a[0] == b[0] and a[1] < b[1]}
        case "top_undirected_degree":
            return set(sorted(around, key=lambda n: (-len(around[n]), n))[:5])
        case _:
            return {(a, z) for a in around for z in around if a < z and (z in around[a] or around[a] & around[z])}


@pytest.fixture(scope="module")
def elements(spark):
    bits = {"base": views.BASE, "f": views.bit(0), "g": views.bit(1)}
    rows = [(d, s, r, o, sum(bits[v] for d2, s2, r2, o2, v in EDGES if (d2, s2, r2, o2) == (d, s, r, o))) for d, s, r, o in sorted({e[:4] for e in EDGES})]
    return spark.createDataFrame(rows, "doc string, s string, r string, o string, mask long")


@pytest.mark.parametrize("query", diagnostics.DIAGNOSTICS)
def test_drift_equals_plain_answers(spark, elements, query):
    docs = spark.createDataFrame([("1",), ("2",), ("3",)], "doc string")
    got = {(r.family, r.doc): r.drift for r in diagnostics.drift(query, docs, elements, FAMILIES).collect()}
    listed = {(r.family, r.doc): 1 - r.jaccard for r in views.jaccard(docs, diagnostics.answers(query, elements, FAMILIES), FAMILIES).collect()}
    for family, doc in itertools.product(FAMILIES, "123"):
        base, own = (plain_answers(query, {e[1:4] for e in EDGES if e[0] == doc and e[4] == v}) for v in ("base", family))
        want = 1 - len(base & own) / len(base | own) if base | own else 0.0
        assert got[family, doc] == pytest.approx(want) and listed[family, doc] == pytest.approx(want), (query, family, doc)


def test_unknown_diagnostic(elements):
    with pytest.raises(KeyError, match="edge_identity"):
        diagnostics.answers("diagnostic.other", elements, FAMILIES)


def test_summary_by_grouping_sets(spark):
    rows = [("q", f, c, d, x, x / 2, x) for f, c, d, x in (("f", "p", "1", 0.2), ("f", "p", "2", 0.4), ("g", "n", "1", 0.6), (None, "n", "3", 0.8))]
    found = diagnostics.diagnostic_summary(spark.createDataFrame(rows, "query string, cause_family string, semantic_class string, doc string, query_drift double, graph_drift double, amplification double"), 50)
    got = {(r.field, r.part): r for r in found.collect()}
    assert set(got) == {("all", None), ("cause_family", "f"), ("cause_family", "g"), ("cause_family", None), ("semantic_class", "p"), ("semantic_class", "n")}
    assert (got["all", None].n, got["all", None].n_documents) == (4, 3) and got["all", None].query_drift == pytest.approx(0.5)
    assert got["all", None].low <= 0.5 <= got["all", None].high and got["semantic_class", "n"].low is None
    assert got["cause_family", "f"].ratio_of_means == pytest.approx(0.3 / 0.2)


def tables(spark):
    make = spark.createDataFrame
    return {
        "documents": make([(0, "A", "pm1"), (1, "B", "cdr_1"), (2, "C", "wrong"), (3, "D", "pm4"), (4, "E", "pm5"), (5, "F", None)], "position int, document_id string, title string"),
        "raw": make([(0, "pm1", ["m1", "m2"]), (1, "", ["m2"]), (2, "pm3", ["m3"]), (3, "pm4", ["m1", "m9"]), (5, "pm6", None)], "position int, title string, concepts array<string>"),
        "entities": make(
            [("A", "A::e10", "Ten", ["ten", ""], "Drug"), ("A", "A::e2", "Two", None, ""), ("B", "B::e0", "Two", ["zwei"], "Disease"), ("C", "C::e0", "x", None, None), ("D", "D::e0", "y", None, None)],
            "document_id string, entity_id string, name string, aliases array<string>, type string",
        ),
        "gold": make([("A", "A::e2", "r", "A::e10"), ("A", "A::e2", "r", "A::e10"), ("A", "A::e2", "r", "A::e7"), ("D", "D::e0", "r", "D::e0"), ("Z", "a", "r", "b")], "document_id string, s string, r string, o string"),
        "runs": make([("A", "v1", 1, "1", "ok"), ("A", "v2", 2, "1", "ok"), ("A", "v3", 2, "2", "ok"), ("A", "v4", 9, "9", "failed"), ("B", None, 1, "1", "ok")], "document_id string, base_event_id string, created_at int, run_id string, status string"),
        "edges": make([("A", "v3", "A::e10", "r", "A::e2"), ("A", "v3", "A::e10", "", "A::e2"), ("A", "v3", None, "r", "A::e2"), ("A", "v1", "A::e2", "r", "A::e10")], "document_id string, event_id string, s string, r string, o string"),
    }


def test_map_inputs(spark):
    mapping, gold, base, audit = inputs.map_inputs(**tables(spark))
    assert {(r.entity_id, r.concept) for r in mapping.collect()} == {("A::e2", "m1"), ("A::e10", "m2"), ("B::e0", "m2")}  # by number, not by text
    assert [tuple(r) for r in gold.collect()] == [("A", "m1", "r", "m2")] and [tuple(r) for r in base.collect()] == [("A", "m2", "r", "m1")]
    r = audit.first()
    assert (r.n_documents, r.n_entities, r.n_concepts, r.n_repeated_concepts, r.n_documents_with_repeated, r.n_problems, r.n_without_base) == (6, 3, 2, 1, 2, 4, 5)
    assert (r.unmapped_gold, r.base_edges, r.mapped_base_edges, r.mapping_rate) == (2, 3, 1, pytest.approx(1 / 3))
    t = tables(spark)
    assert {(p.document_id, p.problem) for p in inputs.concept_map(t["documents"], t["raw"], t["entities"])[1].collect()} == {("C", "title"), ("D", "entity_count"), ("E", "missing"), ("F", "title")}
    assert {(r.concept, r.n_documents, r.n_names, r.n_types) for r in inputs.concept_registry(mapping).collect()} == {("m1", 1, 1, 0), ("m2", 2, 4, 2)}


def test_map_inputs_of_empty_tables(spark):
    mapping, gold, base, audit = inputs.map_inputs(**{k: v.where(F.lit(False)) for k, v in tables(spark).items()})
    r = audit.first()
    assert (mapping.count(), gold.count(), base.count(), r.n_documents, r.base_edges, r.mapping_rate) == (0, 0, 0, 0, 0, 0.0)
