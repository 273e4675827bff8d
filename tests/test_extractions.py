"""Joint responses, declared labels and toolchains against their stated rules, case by case."""

import json
import random

import pytest

from driftloom.operators import responses, toolchains

ENTITIES = [("d1", "C1", "Chemical"), ("d1", "D1", "Disease"), ("d2", "C2", "Chemical"), ("d2", "D1", "Disease"), ("d3", "C9", "Chemical")]


def edge(s="C1", r="CID", o="D1", source="d1", evidence=(1,), **more):
    return {"subject_mesh_id": s, "relation": r, "object_mesh_id": o, "source_document_id": source, "evidence_sentence_ids": list(evidence) if isinstance(evidence, tuple) else evidence} | more


#: An edge, and what is wrong with it.
CASES = [
    (edge(), None), (edge(r=" cid "), None), (edge(r="Other", o="C1"), None), (edge(s=" C1\n", evidence=(2, 1)), None), (edge(s="C2", source="d2", evidence=(3,)), None), (edge(confidence=0.3), None),
    ("text", "invalid_shape"), (7, "invalid_shape"), ([1], "invalid_shape"), (None, "invalid_shape"), ({}, "invalid_provenance"),
    (edge(source="d3", s="C9"), "invalid_provenance"), (edge(source=None), "invalid_provenance"), (edge(source="d9", s="zz", r="no", evidence=()), "invalid_provenance"),
    (edge(s="C2"), "undeclared_entity"), (edge(s=""), "undeclared_entity"), (edge(o=5, r="no"), "undeclared_entity"), (edge(s="c1"), "undeclared_entity"),
    (edge(r="CAUSES"), "invalid_relation"), (edge(r=None, evidence=()), "invalid_relation"),
    (edge(evidence=()), "invalid_evidence"), (edge(evidence=(0,)), "invalid_evidence"), (edge(evidence=(1, 3)), "invalid_evidence"), (edge(evidence=(1.0,)), "invalid_evidence"), (edge(evidence=(True,)), "invalid_evidence"), (edge(evidence=("1",)), "invalid_evidence"),
    (edge(evidence=(None,)), "invalid_evidence"), (edge(evidence=1), "invalid_evidence"), (edge(evidence=None), "invalid_evidence"), (edge(evidence=(10**30,)), "invalid_evidence"), (edge(s="D1", o="C1", evidence=(9,)), "invalid_evidence"),
    (edge(s="D1", o="C1"), "invalid_cid_direction"), (edge(o="C1"), "invalid_cid_direction"),
]


def test_joint_responses(spark):
    bodies = {"all": json.dumps({"edges": [e for e, _ in CASES]}), "list": "[1]", "none": json.dumps({"edges": {}}), "broken": "{", "null": None, "empty": '{"edges": []}', "fenced": "```json\n" + json.dumps({"edges": [edge(), edge()]}) + "\n```"}
    frame = spark.createDataFrame([("p", k, v) for k, v in bodies.items()], "packet string, condition string, response string")
    cohort = spark.createDataFrame([("p", "d1", "d2"), ("q", "d3", "d4")], "packet string, doc_a string, doc_b string")
    entities = spark.createDataFrame(ENTITIES, "doc string, entity string, type string")
    sentences = spark.createDataFrame([("d1", 2), ("d2", 3), ("d3", 1)], "doc string, n long")
    found = responses.joint_edges(frame, ["packet", "condition"], cohort, entities, sentences)
    got = {r.ordinal: r.reason for r in found.where("condition = 'all'").collect()}
    assert got == {i: reason for i, (_, reason) in enumerate(CASES)}
    audit = {r.condition: r for r in responses.joint_audit(found, ["packet", "condition"]).collect()}
    assert set(audit) == set(bodies) - {"empty"}  # a response without edges has nothing to audit
    want = {r: sum(x == r for _, x in CASES) for r in responses.REASONS}
    assert audit["all"].raw_edges == len(CASES) and {r: audit["all"][r] for r in responses.REASONS} == want
    assert audit["all"].accepted_edges == 3  # three of the six sound ones say the same
    assert audit["fenced"].raw_edges == 2 and audit["fenced"].accepted_edges == 1
    for c in ("list", "none", "broken", "null"):
        assert (audit[c].raw_edges, audit[c].accepted_edges, audit[c].invalid_shape) == (0, 0, 1)


def test_declared_labels(spark):
    raw = [("base", "A ", "Born In", "B"), ("base", "a", "born_in", "b"), ("base", "a", "place_born", "b"), ("schema_rename", "a", "Place Born", "b"), ("schema_rename", "a", "born in", "c"), ("schema_rename", "a", "made", "b"), ("prompt", "a", "born in", "b")]
    declared = spark.createDataFrame([(c, x) for c in ("base", "schema_rename") for x in (" BORN in", "died in")], "condition string, label string")
    edges, audit = responses.declared_edges(spark.createDataFrame(raw, "condition string, s string, r string, o string"), ["condition"], declared, {"place_born": "born_in"}, "schema_rename")
    assert sorted(map(tuple, edges.collect())) == [("base", "a", "born_in", "b"), ("schema_rename", "a", "born_in", "b"), ("schema_rename", "a", "born_in", "c")]
    assert {r.condition: (r.raw_edges, r.kept_edges, r.off_schema) for r in audit.collect()} == {"base": (3, 1, 1), "schema_rename": (3, 2, 1), "prompt": (1, 0, 1)}


def plain_index(entities, doc):
    names = {}
    for d, e, ns in entities:
        for n in ns or []:
            if d == doc and n and n.split():
                names.setdefault(" ".join(n.lower().split()), set()).add(e)
    return names


def test_toolchains(spark):
    rng = random.Random(6)
    entities = [(d, f"{d}-e{i}", [f"Name {i}", f"the  {'AB'[i % 2]}", None, " "]) for d in ("x", "y", "z") for i in range(4)] + [("x", "x-e0", None)]
    ids, renamed = {"date of birth": "P1", "part_of": "P2"}, {"born_on": "date of birth", "belongs_to": "part_of"}
    renamed = {k: v.replace(" ", "_") for k, v in renamed.items()}
    surfaces = ["name 0", " NAME\t1", "Name 2", "the A", "THE  b", "nobody", "", None]
    relations = ["Date of Birth", "Born On", "part of", "PART_OF", "belongs_to", "invented one", ""]
    records = []
    for t in ("one", "two"):
        for d in ("x", "y", "z"):
            for c in ("base", "evidence", "rename"):
                n = rng.choice([0, 2, 5])
                records.append((t, d, c, "extraction_error" if rng.random() < 0.15 else "ok", [(rng.choice(surfaces), rng.choice(relations), rng.choice(surfaces)) for _ in range(n)]))
    frame = spark.createDataFrame(records, "toolchain string, doc string, condition string, status string, edges array<struct<s:string,r:string,o:string>>")
    # labels are declared with blanks or with underscores, so one table serves both spellings
    edges, audit = toolchains.canonical_edges(frame, spark.createDataFrame(entities, "doc string, entity string, names array<string>"), {**ids, "date_of_birth": "P1"}, renamed)

    def resolve(doc, name):
        name = " ".join((name or "").lower().split())
        found = plain_index(entities, doc).get(name, set())
        return (next(iter(found)), "exact") if len(found) == 1 else (f"name:{name}", "ambiguous" if found else "unlinked")

    def relation(r):
        spaced = " ".join((r or "").lower().split())
        name = renamed.get(spaced.replace(" ", "_"), spaced.replace(" ", "_"))
        known = {**ids, "date_of_birth": "P1"}
        return known.get(name) or known.get(spaced) or f"label:{name}"

    want, counts = {}, {}
    for t, d, c, status, es in records:
        hows = [resolve(d, e[k])[1] for e in es for k in (0, 2)] if status == "ok" else []
        want[t, d, c] = {(resolve(d, s)[0], relation(r), resolve(d, o)[0]) for s, r, o in es} if status == "ok" else None
        counts[t, d, c] = (len(hows) // 2, len(want[t, d, c] or ()), *(hows.count(h) for h in ("exact", "ambiguous", "unlinked")), sum(relation(e[1]).startswith("label:") for e in es) if status == "ok" else 0)
    got = {}
    for r in edges.collect():
        got.setdefault((r.toolchain, r.doc, r.condition), set()).add((r.s, r.r, r.o))
    assert got == {k: v for k, v in want.items() if v}
    assert {(r.toolchain, r.doc, r.condition): (r.raw_edges, r.canonical_edges, r.exact, r.ambiguous, r.unlinked, r.off_schema) for r in audit.collect()} == counts

    matrix = toolchains.condition_matrix(frame, edges, ["evidence", "rename"])
    cells = {(r.toolchain, r.doc, r.condition): (r.n_base, r.n_own, r.n_both) for r in matrix.collect()}
    expected = {(t, d, c): (len(want[t, d, "base"]), len(want[t, d, c]), len(want[t, d, "base"] & want[t, d, c])) for t, d, c in want if c != "base" and want[t, d, "base"] is not None and want[t, d, c] is not None}
    assert cells == expected
    for r in toolchains.graph_drift(matrix, frame, {"evidence": 0.3, "rename": 0.05}, 0.2).collect():
        drifts = [1 - b / (n + m - b) for (t, _, c), (n, m, b) in expected.items() if (t, c) == (r.toolchain, r.condition) and n + m]
        assert r.n == len(drifts) and r.mean_drift == pytest.approx(sum(drifts) / len(drifts)) and r.violation_rate == pytest.approx(sum(x > r.tau for x in drifts) / len(drifts))
        assert r.errors == sum(x[0] == r.toolchain and x[2] == r.condition and x[3] != "ok" for x in records)


def test_query_pairs(spark):
    views = [("one", "base"), ("one", "evidence"), ("two", "base"), ("two", "evidence")]
    asked = spark.createDataFrame([("q1", "x"), ("q2", "x"), ("q3", "y")], "id string, doc string")
    answers = spark.createDataFrame([("q1", "a", 0b0011), ("q1", "b", 0b0001), ("q2", "c", 0b1000), ("q3", "d", 0b1100)], "id string, a string, mask long")
    records = spark.createDataFrame([(t, d, c, "failed" if (t, d, c) == ("one", "y", "evidence") else "ok") for t, c in views for d in "xy"], "toolchain string, doc string, condition string, status string")
    pairs = {(r.toolchain, r.doc): r for r in toolchains.query_pairs(asked, answers, records, views).collect()}
    assert set(pairs) == {("one", "x"), ("two", "x"), ("two", "y")}
    x = pairs["one", "x"]
    assert (x.n_queries, x.n_active, x.mean_drift, x.max_drift, x.both_empty, x.both_nonempty) == (2, 1, 0.25, 0.5, 1, 1)
    assert (pairs["two", "x"].cf_only, pairs["two", "x"].max_drift) == (1, 1.0) and pairs["two", "y"].max_drift == 0.0
    total = {r.toolchain: r for r in toolchains.query_summary(toolchains.query_pairs(asked, answers, records, views), 0.3).collect()}
    assert (total["two"].n_pairs, total["two"].n_query_evaluations, total["two"].violation_rate, total["two"].active_pair_rate) == (2, 3, 0.5, 1.0)
