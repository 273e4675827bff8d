"""Interventions applied by their target, and prompt definitions as rows."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import interventions


def run(spark, *candidates, **more):
    given = spark.createDataFrame([("d", [("s1", "Bob ran."), ("s2", "Ann sat.")], [("C1", "one"), ("C0_role", "old")], [("P1", "born", "x"), ("OTHER", "other", ""), ("P2", "died", "y")])], f"document_id string, sentences {interventions.SENTENCES}, clauses {interventions.SENTENCES}, relations {interventions.RELATIONS}")
    rows = spark.createDataFrame([("d", str(i), *c) for i, c in enumerate(candidates)], "document_id string, intervention_id string, target_type string, target_id string, operator string")
    return [(r.sentences, r.clauses, r.relations) for r in interventions.applied(rows, given, **more).orderBy(F.col("intervention_id").cast("int")).collect()]


def test_each_target(spark):
    texts = lambda x: [e.text for e in x]
    ids = lambda x: [e.id for e in x]
    got = run(
        spark, ("sentence", "s1", "remove"), ("sentence", "s2", "mask"), ("sentence", None, "entity_alias"), ("sentence", "s9", "remove"), ("sentence", None, "para_swap"),
        ("prompt_clause", "C1", "tone"), ("prompt_clause", "auditor", "role_swap"), ("prompt_clause", "nobody", "role_swap"), ("prompt_clause", "terse", "tone"), ("prompt_clause", "C9", "other"),
        ("schema", "drop:P1", "x"), ("schema", "ambiguous", "x"), ("schema", "ambiguous:P2,,OTHER", "x"), ("schema", "rename", "x"), ("schema", "with_other", "x"), ("schema", "coarse", "x"), ("noop", None, None), ("model", "m", "swap"),
        aliases=[("Bob", "Robert")], renames={"P1": "Q1"}, coarse={"P1": "life", "P2": "life"},
    )
    plain = ["Bob ran.", "Ann sat."]
    assert [texts(g[0]) for g in got[:4]] == [["Ann sat."], ["Bob ran.", "[MASKED]"], ["Robert ran.", "Ann sat."], plain] and sorted(texts(got[4][0])) == sorted(plain)
    assert all(texts(g[0]) == plain for g in got[5:])
    assert ids(got[5][1]) == ["C0_role"] and texts(got[6][1]) == [interventions.ROLES["auditor"], "one"] and texts(got[7][1])[0] == interventions.ROLES["expert"]
    assert ids(got[8][1]) == ["C1", "C0_role", "C9_tone"] and ids(got[9][1]) == ["C1", "C0_role"]
    assert [ids(g[2]) for g in got[10:16]] == [["OTHER", "P2"], ["OTHER", "related_to"], ["P1", "OTHER", "related_to"], ["Q1", "OTHER", "P2"], ["P1", "OTHER", "P2", "OTHER"], ["life", "OTHER"]]
    assert got[11][2][-1].description == "Ambiguous merge of ['P1', 'P2']" and got[12][2][-1].description == "Ambiguous merge of ['P2']"
    assert got[16] == got[17] and ids(got[16][2]) == ["P1", "OTHER", "P2"]


@pytest.mark.parametrize("candidate", [("sentence", "s1", "upper"), ("sentence", "s1", None), ("schema", "new", "x"), ("schema", None, "x"), ("graph", "a", "b"), (None, "a", "b")])
def test_unknown_ones_raise(spark, candidate):
    with pytest.raises(Exception, match="unknown"):
        run(spark, candidate)


def test_registered_prompts(spark):
    rows = [("p", None, "T", [("C1", None, "one"), ("C2", "kind", "two")]), ("p", None, "T", [("C1", None, "one"), ("C2", "kind", "two")]), ("q", "Q", "U", None)]
    prompts, clauses = interventions.registered_prompts(spark.createDataFrame(rows, "id string, name string, template string, clauses array<struct<id:string,type:string,text:string>>"))
    assert sorted(map(tuple, prompts.collect())) == [("p", "p", "T", ["C1", "C2"]), ("q", "Q", "U", [])]
    assert sorted(map(tuple, clauses.collect())) == [("C1", "p", "", "one"), ("C2", "p", "kind", "two")]
