"""Mentions of a pair of views as keys: ids first, then names that are known in the pair, then names within one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import text


def mention_key(name: Column, aliases: dict[str, str] | None = None) -> Column:
    """A name without case and outer white space, under its canonical form if it has one; null is empty."""
    return text.mapped(text.name_key(F.coalesce(name, F.lit(""))), aliases or {})


def named(known: DataFrame, asked: DataFrame, stop_at_names: bool) -> DataFrame:
    """(run_id, name, id) of the ``asked`` (run_id, name) that the ``known`` (run_id, name, id) settle.

    A name of exactly one id is settled. Else the known names that contain it, or that it contains, count together, and settle it
    if they have one id among them; with ``stop_at_names``, a name that is known with several ids is not looked for in others.
    The names of a run meet those of that run alone.
    """
    known = known.where("id is not null and name <> ''").distinct()
    own = known.groupBy("run_id", "name").agg(F.count("*").alias("ids"), F.min("id").alias("id"))
    direct = asked.distinct().join(own, ["run_id", "name"], "left")
    settled = direct.where("ids = 1").select("run_id", "name", "id")
    left = direct.where("name <> '' and (ids is null" + (")" if stop_at_names else " or ids > 1)")).select("run_id", F.col("name").alias("wanted"))
    within = left.join(known, "run_id").where(F.contains("name", F.col("wanted")) | F.contains(F.col("wanted"), F.col("name")))
    found = within.groupBy("run_id", F.col("wanted").alias("name")).agg(F.count_distinct("id").alias("ids"), F.min("id").alias("id")).where("ids = 1")
    return settled.unionByName(found.select("run_id", "name", "id"))


def keyed(edges: DataFrame, known: DataFrame, aliases: dict[str, str] | None = None, stop_at_names: bool = False) -> DataFrame:
    """``edges`` (run_id, s_id, s, r, o_id, o, …) with s and o as ``id:…`` or ``name:…`` keys; edges without a relation go."""
    rows = edges.where("r is not null and r <> ''").withColumns({"_sn": mention_key(F.col("s"), aliases), "_on": mention_key(F.col("o"), aliases)})
    bare = lambda i, n: rows.where(F.col(i).isNull()).select("run_id", F.col(n).alias("name"))
    ids = named(known, bare("s_id", "_sn").unionByName(bare("o_id", "_on")), stop_at_names)
    key = lambda own, found, name: F.coalesce(F.concat(F.lit("id:"), own), F.concat(F.lit("id:"), found), F.concat(F.lit("name:"), name))
    both = rows.join(ids.select("run_id", F.col("name").alias("_sn"), F.col("id").alias("_si")), ["run_id", "_sn"], "left").join(ids.select("run_id", F.col("name").alias("_on"), F.col("id").alias("_oi")), ["run_id", "_on"], "left")
    return both.withColumns({"s": key(F.col("s_id"), F.col("_si"), F.col("_sn")), "o": key(F.col("o_id"), F.col("_oi"), F.col("_on"))}).drop("s_id", "o_id", "_sn", "_on", "_si", "_oi")


def paired_triples(edges: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Edges of both views of each run under keys; what is known is what either view has linked."""
    ends = lambda i, n: edges.select("run_id", F.col(i).alias("id"), mention_key(F.col(n), aliases).alias("name"))
    return keyed(edges, ends("s_id", "s").unionByName(ends("o_id", "o")), aliases)


def gold_recall(edges: DataFrame, gold: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(run_id, recall) of ``edges`` against ``gold`` (run_id, head_id, head, r, tail_id, tail), whose names are what is known; gold without ids does not count, and runs without gold have 0."""
    sound = gold.where("head_id is not null and tail_id is not null and r is not null and r <> ''")
    ends = lambda i, n: sound.select("run_id", F.col(i).alias("id"), mention_key(F.col(n), aliases).alias("name"))
    found = keyed(edges, ends("head_id", "head").unionByName(ends("tail_id", "tail")), aliases, stop_at_names=True).select("run_id", "s", "r", "o").distinct()
    truth = sound.select("run_id", F.concat(F.lit("id:"), "head_id").alias("s"), "r", F.concat(F.lit("id:"), "tail_id").alias("o")).distinct()
    share = truth.join(found.withColumn("hit", F.lit(1)), ["run_id", "s", "r", "o"], "left").groupBy("run_id").agg((F.count("hit") / F.count("*")).alias("recall"))
    return edges.select("run_id").distinct().join(share, "run_id", "left").select("run_id", F.coalesce("recall", F.lit(0.0)).alias("recall"))
