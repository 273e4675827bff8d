"""Deployment drift is over every shared tail and chain of a document, however many it has."""

from itertools import combinations

import pytest

from driftloom.plans import registry

registry.load()

PRIORITIES, FLAGS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-LOW", "5-NONE"), "ANR"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """One customer with five orders; each has the same three parts, every part under a flag of its own."""
    path = str(tmp_path_factory.mktemp("catalogue"))
    orders = [(k + 1, 1, p) for k, p in enumerate(PRIORITIES)]
    lines = [(k, part, 1, part, FLAGS[part - 1], "O", 0.0, 0.0) for k, _, _ in orders for part in (1, 2, 3)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    return path


def test_no_instance_is_left_out(spark, small):
    tails, chains = 3 * len(list(combinations(PRIORITIES, 2))), len(PRIORITIES) * len(FLAGS)
    found = {(r.cause_family, r.query): r for r in registry.QUERIES["deployment_families"](spark, small).collect()}
    assert {found[f, "shared_tail_join"].n_queries for f in ("evidence", "schema", "model")} == {tails}
    assert {found[f, "typed_two_hop"].n_queries for f in ("evidence", "schema", "model")} == {chains}
    # without first lines a chain by the first part's flag has no answers
    assert found["evidence", "typed_two_hop"].base_only == len(PRIORITIES) and found["evidence", "shared_tail_join"].base_only == tails // 3


def test_summary_counts_all_instances(spark, small):
    found = {r.query: r.n_evaluations for r in registry.QUERIES["deployment_summary"](spark, small).where("cause_family = 'schema'").collect()}
    assert found["shared_tail_join"] == 30 and found["typed_two_hop"] == 15
    # the registered catalogue keeps its first six and eight
    first = {r.family: r["count"] for r in registry.QUERIES["query_catalogue"](spark, small).groupBy("family").count().collect()}
    assert first["shared_tail_join"] == 6 and first["typed_two_hop"] == 8
