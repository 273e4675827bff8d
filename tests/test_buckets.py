"""Tables of the lineage lie in buckets of documents, so metrics of documents need no shuffle, and buckets do not grow with the input."""

import pytest
from pyspark.sql import functions as F

from driftloom.operators import views
from driftloom.plans import derived, registry
from driftloom.sources import store

DATA = "/root/testdata/sf0.001"
registry.load()


def shuffles(frame, capsys):
    capsys.readouterr()
    frame.explain()
    return capsys.readouterr().out.count("Exchange hashpartitioning")


@pytest.mark.parametrize("name", ["edge_jaccard", "type_flip_rate", "degree_distribution_shift", "centrality_rank_correlation", "drift_decomposition", "two_hop_drift", "top_out_degree", "top_undirected_degree", "short_connectivity", "ego_edges"])
def test_metric_of_documents_has_no_shuffle(spark, capsys, name):
    assert shuffles(registry.QUERIES[name](spark, DATA), capsys) == 0


def test_joined_metrics_have_no_shuffle(spark, capsys):
    from driftloom.plans.evaluation import _drifts

    assert shuffles(_drifts(spark, DATA), capsys) == 0


def test_bucket_stays_as_large(spark, tmp_path):
    for name, size in (("one", 100_000), ("ten", 1_000_000)):
        (tmp_path / name).write_bytes(b"x" * size)
    one, ten = (store.bucket_number(spark, [str(tmp_path / n)], 10_000) for n in ("one", "ten"))
    assert (one, ten) == (10, 100)


def test_walk_with_more_levels_than_are_kept_apart(spark):
    edges = spark.createDataFrame([(1, f"n{i:02}", "r", f"n{i + 1:02}", 1) for i in range(20)] + [(1, "n20", "r", "n00", 1)], "doc long, s string, r string, o string, mask long")
    found = views.distances(edges, spark.createDataFrame([(1, "n00")], "doc long, source string")).where("hops > 0 and hops < 21")
    assert {(r.node, r.hops) for r in found.collect()} == {(f"n{i:02}", i) for i in range(1, 21)}


def test_gold_comes_from_the_same_table(spark):
    small = derived.lines(spark, DATA).where("disc <= 0.05").select("doc", F.concat(F.lit("o:"), F.col("k").cast("string")), "rel", F.concat(F.lit("p:"), F.col("part").cast("string"))).distinct()
    assert sorted(map(tuple, derived.gold(spark, DATA).collect())) == sorted(map(tuple, small.collect()))


@pytest.mark.parametrize("name", ["query_catalogue", "catalogue_answers"])
def test_catalogue_has_no_shuffle(spark, capsys, name):
    assert shuffles(registry.QUERIES[name](spark, DATA), capsys) == 0


def test_doses_at_a_half_fall_in_one_cell(spark):
    from driftloom.operators import dose

    def ends(*nums):
        rows = [("c", i, True, None, num, 0.3) for i, num in enumerate(nums)] + [("c", 9, True, None, -0.1, 0.31), ("c", 8, True, None, 0.2, 0.29)]
        found = spark.createDataFrame(rows, "corpus string, doc long, complete boolean, reason string, num double, den double")
        return [(r.low, r.high) for r in dose.dose_response(found, ["corpus"], 4, 60).collect()][0]

    half = 0.0262715
    below, above = ends(half - 2e-17 * 100, half), ends(half + 2e-17 * 100, half)
    assert below == pytest.approx(above, abs=1e-9)


def test_components_and_diagnostics_have_no_shuffle(spark, capsys):
    from driftloom.operators import diagnostics

    assert shuffles(registry.QUERIES["component_change"](spark, DATA), capsys) == 0
    assert shuffles(diagnostics.diagnostic_records(*derived.args(spark, DATA)), capsys) == 0
