"""Lineage repair, audits and log semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def nearest_event(runs: DataFrame, events: DataFrame, keys: list[str], null_safe: list[str], run_time: str, event_time: str, run_id: str, event_id: str) -> DataFrame:
    """(run_id, event_id): for each run the event with equal keys that is nearest in time, earlier or later; ties by event id.

    Null keys never match; ``null_safe`` columns match null with null; what has no time is near nothing. Runs and events of a
    key are sorted by time once, and each run looks at the last event up to it and the first one after it, so a key of many
    runs and events costs their number and not its square.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias("_t")
    by = [*keys, *null_safe]
    there = lambda df: df.dropna(subset=[*keys, "_t"])
    e = there(events.select(*by, micros(event_time), F.col(event_id).alias("_e"))).groupBy(*by, "_t").agg(F.min("_e").alias("_e"))  # of events at one time the first counts
    r = there(runs.select(*by, micros(run_time), F.col(run_id).alias("_r")))
    at = e.select(F.struct("_t", "_e").alias("x")).schema["x"].dataType
    both = e.select(*by, "_t", F.struct("_t", "_e").alias("_at"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.lit(0).alias("_k")).unionByName(r.select(*by, "_t", F.lit(None).cast(at).alias("_at"), "_r", F.lit(1).alias("_k")))
    order = W.partitionBy(*by).orderBy("_t", "_k")
    seen = both.withColumn("_b", F.last("_at", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("_a", F.first("_at", ignorenulls=True).over(order.rowsBetween(0, W.unboundedFollowing)))
    near = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col("_t") - F.col(f"{x}._t")).alias("gap"), F.col(f"{x}._e").alias("id")))
    best = F.array_min(F.array_compact(F.array(near("_b"), near("_a"))))
    return seen.where("_k = 1").select(F.col("_r").alias(run_id), best["id"].alias(event_id)).where(F.col(event_id).isNotNull())


def resolved_event(runs: DataFrame, witness: DataFrame, exact: DataFrame, near: DataFrame, run_id: str) -> DataFrame:
    """The event of each run: its first witness edge's, else the exact match's, else the nearest, else the recorded one."""
    first = witness.groupBy(run_id).agg(F.min_by(F.regexp_extract("edge_id", "^(.*)::", 1), "ordinal").alias("_w"))
    out = runs.join(first, run_id, "left").join(exact.withColumnRenamed("event_id", "_e"), run_id, "left").join(near.withColumnRenamed("event_id", "_n"), run_id, "left")
    return out.withColumn("resolved_event_id", F.coalesce("_w", "_e", "_n", "cf_event_id")).drop("_w", "_e", "_n")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key; a later failure replaces an earlier success."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))).where("_k = 1").drop("_k")


def linked_edges(edges: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Edges with all of ``required``, and per view how many there were and how many are linked."""
    ok = F.lit(True)
    for c in required:
        ok = ok & F.col(c).isNotNull()
    return edges.where(ok), edges.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("linked"))


def pair_violations(pairs: DataFrame, events: DataFrame) -> DataFrame:
    """(run_id, problem): repeated runs, missing endpoints, equal endpoints, endpoints of other documents."""
    e = events.select("event_id", F.col("document_id").alias("d"))
    both = pairs.join(e.select(F.col("event_id").alias("base_event_id"), F.col("d").alias("bd")), "base_event_id", "left").join(e.select(F.col("event_id").alias("cf_event_id"), F.col("d").alias("cd")), "cf_event_id", "left")
    problems = F.filter(F.array(F.when(F.col("bd").isNull() | F.col("cd").isNull(), "missing endpoint"), F.when(F.col("base_event_id") == F.col("cf_event_id"), "same endpoint"), F.when((F.col("bd") != F.col("document_id")) | (F.col("cd") != F.col("document_id")), "other document")), lambda x: x.isNotNull())
    return both.select("run_id", F.explode(problems).alias("problem")).unionByName(pairs.groupBy("run_id").count().where("count > 1").select("run_id", F.lit("repeated run").alias("problem")))


def missing_cells(records: DataFrame, documents: DataFrame, conditions: list[str]) -> DataFrame:
    """(doc, condition) cells that a rectangular checkpoint lacks."""
    grid = documents.select("doc").distinct().withColumn("condition", F.explode(F.array(*map(F.lit, conditions))))
    return grid.join(records.select("doc", "condition").distinct(), ["doc", "condition"], "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of ``new``, and those of ``old`` that it does not replace; of several new rows of a key the last by ``order`` stays.

    Without ``order`` repeated keys in ``new`` must be equal rows.
    """
    new = latest(new, keys, order) if order else new.distinct()
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def endpoint_reuse(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """How many endpoints and tokens pairs need if each is made anew, and if distinct endpoints are made once."""
    ends = pairs.select(F.explode(F.array("base_event_id", "cf_event_id")).alias("event_id")).join(tokens, "event_id", "left")
    once = ends.distinct().agg(F.count("*").alias("distinct_endpoints"), F.sum("tokens").alias("distinct_tokens"))
    every = ends.agg(F.count("*").alias("endpoints"), F.sum("tokens").alias("all_tokens"))
    return every.crossJoin(once).select("*", (F.col("endpoints") / F.col("distinct_endpoints")).alias("endpoint_factor"), (F.col("all_tokens") / F.col("distinct_tokens")).alias("token_factor"))


def witness_yield(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(cause_family, yield, change_rate): changed outcomes per token, tokens counted per joined outcome as they fan out."""
    changed = (F.col("outcome_type") != "EXACT_SAME").cast("double")
    return runs.join(outcomes, "run_id").groupBy("cause_family").agg((F.sum(changed) / F.greatest(F.sum("tokens"), F.lit(1))).alias("yield"), F.avg(changed).alias("change_rate"))


def paired(pairs: DataFrame, events: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """``pairs`` with cause_family and semantic_class of their intervention, ``unknown`` without one, and ``columns`` of both events, null where there is none."""
    of = lambda side: events.select(F.col("event_id").alias(f"{side}_event_id"), *(F.col(c).alias(f"{side}_{c}") for c in columns))
    named = pairs.join(candidates.select("intervention_id", "cause_family", "semantic_class"), "intervention_id", "left")
    named = named.withColumns({c: F.coalesce(c, F.lit("unknown")) for c in ("cause_family", "semantic_class")})
    return named.join(of("base"), "base_event_id", "left").join(of("cf"), "cf_event_id", "left")


def listed(documents: DataFrame, column: str, values: tuple[str, ...], order: str, limit: int | None = None) -> DataFrame:
    """Documents with one of the values, in order, the first ``limit`` if given."""
    out = documents.where(F.col(column).isin(*values)).orderBy(order)
    return out if limit is None else out.limit(limit)


def eligible(gold: DataFrame, schema: DataFrame, relation: str, by: list[str]) -> DataFrame:
    """(…, n_gold, eligible, excluded): gold edges by whether ``schema`` has their relation."""
    known = schema.select(relation).distinct().withColumn("_known", F.lit(True))
    marked = gold.join(F.broadcast(known), relation, "left")  # a schema is a few relations
    return marked.groupBy(*by).agg(F.count("*").alias("n_gold"), F.count("_known").alias("eligible"), F.count_if(F.col("_known").isNull()).alias("excluded"))


def load(runs: DataFrame, edges: DataFrame, gold: DataFrame, outcomes: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an evaluation reads of a lineage: runs, linked edges, gold edges.

    Runs are the successful ones (run_id, document_id, base_event_id, cf_event_id, cause_family). The event of a run's first matched
    edge by ordinal counts before the recorded one, and a run without a matched edge keeps its own, so empty views stay;
    a family that is not known is ``unknown``. Edges (event_id, s, r, o) and gold (document_id, s, r, o) are distinct.
    """
    matched = outcomes.where("matched_edge_id is not null and matched_edge_id <> ''")
    first = matched.groupBy("run_id").agg(F.min_by(F.regexp_extract("matched_edge_id", "^(.*)::", 1), "ordinal").alias("_event"))
    families = candidates.select("intervention_id", "cause_family")
    found = runs.where("status = 'ok'").join(first, "run_id", "left").join(families, "intervention_id", "left")
    chosen = found.select("run_id", "document_id", "base_event_id", F.coalesce("_event", "cf_event_id").alias("cf_event_id"), F.coalesce("cause_family", F.lit("unknown")).alias("cause_family"))
    linked = edges.where("subject_entity_id is not null and object_entity_id is not null").select("event_id", F.col("subject_entity_id").alias("s"), F.col("relation").alias("r"), F.col("object_entity_id").alias("o")).distinct()
    truth = gold.select("document_id", F.col("head_entity_id").alias("s"), F.col("relation_base").alias("r"), F.col("tail_entity_id").alias("o")).distinct()
    return chosen, linked, truth


def completed_keys(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keys whose last record succeeded."""
    return latest(records, keys, order).where("status = 'ok'").select(*keys)


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("document_id").agg(F.count("*").alias("n"))


def authority_audit(pairs: DataFrame, events: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(run_id, reason, witnessed): for each run of ``pairs`` the first thing that speaks against it, null if nothing does.

    ``witnesses`` (run_id, matched_edge_id, event_id) are the matched edges of a run with the event that owns the edge, null
    where there is no such edge. In order: ``repeated_run``, ``missing_base``, ``missing_counterfactual``, ``same_endpoint``,
    ``base_elsewhere`` and ``counterfactual_elsewhere`` (of another document), ``witness_missing``, ``witness_elsewhere``. A run
    without witnesses is sound: a view can be empty or all new. Empty ids count as none, and a repeated run comes out once.
    """
    known = lambda side: events.select(F.col("event_id").alias(f"{side}_event_id"), F.col("document_id").alias(f"_{side}"), F.lit(True).alias(f"_has_{side}")).dropDuplicates([f"{side}_event_id"])
    one = pairs.groupBy("run_id").agg(F.count("*").alias("_n"), F.min_by(F.struct("document_id", "base_event_id", "cf_event_id"), F.struct("base_event_id", "cf_event_id")).alias("p")).select("run_id", "_n", "p.*")
    both = one.join(known("base"), "base_event_id", "left").join(known("cf"), "cf_event_id", "left")
    edges = witnesses.where("matched_edge_id is not null").join(one.select("run_id", "cf_event_id"), "run_id")
    seen = edges.groupBy("run_id").agg(F.count_if(F.col("event_id").isNull()).alias("_lost"), F.count_if(F.col("event_id") != F.coalesce("cf_event_id", F.lit(""))).alias("_other"), F.lit(True).alias("_w"))
    lacks = lambda side: F.col(f"_has_{side}").isNull() | (F.col(f"{side}_event_id") == "")
    reason = (
        F.when(F.col("_n") > 1, "repeated_run").when(lacks("base"), "missing_base").when(lacks("cf"), "missing_counterfactual").when(F.col("base_event_id") == F.col("cf_event_id"), "same_endpoint")
        .when(~F.col("_base").eqNullSafe(F.col("document_id")), "base_elsewhere").when(~F.col("_cf").eqNullSafe(F.col("document_id")), "counterfactual_elsewhere")
        .when(F.col("_lost") > 0, "witness_missing").when(F.col("_other") > 0, "witness_elsewhere")
    )
    return both.join(seen, "run_id", "left").select("run_id", reason.alias("reason"), F.coalesce("_w", F.lit(False)).alias("witnessed"))
