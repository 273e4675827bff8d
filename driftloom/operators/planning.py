"""Selection under a budget: rank-based planners as windows, sequential ones per document."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.extraction import grouped_map
from driftloom.operators.statistics import digest_places


def _take(candidates: DataFrame, budget: int, *order: Column) -> DataFrame:
    ranked = candidates.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= budget)


def _draw(seed: int) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), "intervention_id"), 256)


def exhaustive(candidates: DataFrame, budget: int = 0, seed: int = 0) -> DataFrame:
    """All candidates; the budget does not cut."""
    return candidates.withColumn("rank", F.row_number().over(W.partitionBy("document_id").orderBy("intervention_id")))


def random(candidates: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    return _take(candidates, budget, _draw(seed))


def only(target: str):
    def plan(candidates: DataFrame, budget: int, seed: int = 0) -> DataFrame:
        return random(candidates.where(F.col("target_type") == target), budget, seed)

    return plan


def _cost() -> Column:
    """What a candidate costs; 1 if that is unknown or 0."""
    return F.when(F.coalesce("estimated_cost", F.lit(0)) == 0, 1.0).otherwise(F.col("estimated_cost"))


def cheapest_first(candidates: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    return _take(candidates, budget, _cost(), _draw(seed))


# What a clause is worth.
CLAUSE_WORTH = {"C1_evidence_only": 5.0, "C2_infer_implicit": 5.0, "C3_use_schema": 4.0, "C4_allow_other": 4.0}


def coarse_to_fine(candidates: DataFrame, budget: int, seed: int = 0, evidence: DataFrame | None = None) -> DataFrame:
    """Schema, then prompt clauses, then sentences that edges rest on, then other sentences; masks before removals; then worth per cost; then a draw.

    ``evidence`` (document_id, sentence_id) has a row per edge and sentence that it cites.
    """
    known = candidates
    if evidence is not None:
        cited = evidence.groupBy("document_id", F.col("sentence_id").alias("target_id")).agg(F.count("*").alias("_cited"))
        known = candidates.join(cited, ["document_id", "target_id"], "left")
    cited = F.col("_cited") if evidence is not None else F.lit(None).cast("long")
    kind, target = F.col("target_type"), F.col("target_id")
    schema, clause, sentence = kind == "schema", kind == "prompt_clause", kind == "sentence"
    rest = sentence & cited.isNotNull()
    tier = F.when(schema, 0).when(clause, 1).when(rest, 2).when(sentence, 3).otherwise(9)
    removal = F.when(sentence, (F.col("operator") != "mask").cast("int")).otherwise(0)
    worth = (
        F.when(schema, F.when(target.startswith("drop:") | target.startswith("ambiguous:"), 8.0).otherwise(6.0)).when(clause, F.coalesce(F.create_map(*(F.lit(x) for kv in CLAUSE_WORTH.items() for x in kv))[target], F.lit(2.0)))
        .when(rest, 3.0 + cited).when(sentence, 0.5).otherwise(0.0)
    )
    return _take(known, budget, tier, removal, -worth / _cost(), _draw(seed)).select(*candidates.columns, "rank")


def budget_curve(ranked: DataFrame, budgets: tuple[int, ...], found: str) -> DataFrame:
    """(budget, selected, found, share): how many of the ``found`` (boolean) the first ``budget`` of each document's ranked candidates hold."""
    steps = ranked.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where(F.col("rank") <= F.col("budget")).groupBy("budget").agg(F.count("*").alias("selected"), F.count_if(found).alias("found"))
    whole = ranked.agg(F.count_if(found).alias("_all"))  # one row
    return steps.crossJoin(whole).select("budget", "selected", "found", F.when(F.col("_all") > 0, F.col("found") / F.col("_all")).otherwise(0.0).alias("share"))


def round_robin(candidates: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """The first of every family, then the second of every family, and so on."""
    turn = candidates.withColumn("_turn", F.row_number().over(W.partitionBy("document_id", "cause_family").orderBy(_draw(seed))))
    return _take(turn, budget, F.col("_turn"), F.col("cause_family")).drop("_turn")


PROBE_SHARE, LEAST_TO_PROBE, YIELD_PRIOR, YIELD_POWER = 0.34, 4, 1e-3, 1.5


def allot(candidates: list[dict], budget: int) -> list[dict]:
    """A document's choice: probe, allot the rest by yield, refine by group yield.

    ``candidates`` have cause_family, family_yield, group_yield, cost (1 where it is null or 0) and draw, and come in order. With a budget below
    LEAST_TO_PROBE the families of the highest yield come first, then the cheapest. Otherwise about PROBE_SHARE of the budget
    goes to the cheapest candidate of the first families by name. The rest is shared by (yield + YIELD_PRIOR) ** YIELD_POWER, each
    share rounded half to even, what is left over one by one from the heaviest family on, and what is too much taken back likewise.
    """
    if budget < LEAST_TO_PROBE:
        return sorted(candidates, key=lambda c: (-c["family_yield"], c["cost"], c["draw"]))[: max(budget, 0)]
    families: dict[str, list[dict]] = {}
    for c in candidates:
        families.setdefault(c["cause_family"], []).append(c)
    probed = sorted(families)[: max(1, min(len(families), round(budget * PROBE_SHARE)))]
    chosen = [min(families[f], key=lambda c: c["cost"]) for f in probed]
    rest = budget - len(chosen)
    weight = {f: (of[0]["family_yield"] + YIELD_PRIOR) ** YIELD_POWER for f, of in families.items()}
    whole = sum(weight.values()) or 1.0
    heaviest = sorted(families, key=lambda f: -weight[f])
    share = {f: round(rest * weight[f] / whole) for f in families}
    over, k = rest - sum(share.values()), 0
    while over:
        f = heaviest[k % len(heaviest)]
        if over > 0 or share[f] > 0:
            share[f] += 1 if over > 0 else -1
            over += -1 if over > 0 else 1
        k += 1
    used = {c["intervention_id"] for c in chosen}
    for f, of in families.items():
        pool = sorted((c for c in of if c["intervention_id"] not in used), key=lambda c: (-c["group_yield"], c["cost"], c["draw"]))
        chosen += pool[: share[f]]
    return chosen[:budget]


def adaptive(candidates: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """``allot`` for every document; ``candidates`` carry family_yield and group_yield. Ties go by a hash draw. A document's candidates are what a task holds."""
    columns = candidates.columns
    cost = F.when(F.coalesce("estimated_cost", F.lit(0)) == 0, 1.0).otherwise(F.col("estimated_cost").cast("double"))
    rows = candidates.withColumns({"cost": cost, "draw": _draw(seed), "cause_family": F.coalesce("cause_family", *(["target_type"] if "target_type" in columns else []), F.lit("unknown")), "family_yield": F.coalesce("family_yield", F.lit(0.0)), "group_yield": F.coalesce("group_yield", F.lit(0.0))})
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*columns).schema) + ", rank int"
    return grouped_map(rows, "document_id", ["intervention_id"], lambda of: [{**c, "rank": k} for k, c in enumerate(allot(of, budget), 1)], schema)


LEAST_SEEN = 25


Z = 1.96


class Selection:
    """What a sequential selection keeps between pairs: what is spent, and per family how many were seen, how many violated, and whether it is left."""

    def __init__(self, budget: float, threshold: float, least_seen: int) -> None:
        self.budget, self.threshold, self.least_seen = budget, threshold, least_seen
        self.spent, self.seen, self.bad, self.stopped = 0.0, {}, {}, set()

    def take(self, family: str, cost: float, violated: bool) -> bool:
        """Whether the next pair is taken: it fits, and its family's Wilson lower bound of violations has not exceeded the threshold."""
        if self.spent + cost > self.budget or family in self.stopped:
            return False
        self.spent += cost
        n, k = self.seen.get(family, 0) + 1, self.bad.get(family, 0) + bool(violated)
        self.seen[family], self.bad[family] = n, k
        share = k / n
        low = (share + Z * Z / (2 * n) - Z * (share * (1 - share) / n + Z * Z / (4 * n * n)) ** 0.5) / (1 + Z * Z / n)
        if n >= self.least_seen and low > self.threshold:
            self.stopped.add(family)
        return True


def selected(batches: Iterator[pa.RecordBatch], budget: float, threshold: float, least_seen: int) -> Iterator[pa.RecordBatch]:
    """(stream, run_id, taken, spent) of pairs in order of stream and then priority; a batch at a time, and one ``Selection`` of the stream at hand."""
    stream, state = None, None
    for batch in batches:
        taken, spent = [], []
        for s, family, cost, violated in zip(*(batch.column(c).to_pylist() for c in ("stream", "family", "cost", "violated")), strict=True):
            if state is None or s != stream:
                stream, state = s, Selection(budget, threshold, least_seen)
            taken.append(state.take(family, cost, violated))
            spent.append(state.spent)
        yield pa.RecordBatch.from_arrays([batch.column("stream"), batch.column("run_id"), pa.array(taken, pa.bool_()), pa.array(spent, pa.float64())], names=["stream", "run_id", "taken", "spent"])


def budgeted_stream(pairs: DataFrame, budget: float, threshold: float = 0.20, least_seen: int = LEAST_SEEN) -> DataFrame:
    """(stream, run_id, taken, spent) for ``pairs`` (stream, run_id, family, priority, cost, violated): pairs in order of priority while they fit.

    Pairs that do not fit are passed over, and a family that violates too often is left; ties go by run_id. What follows
    depends on what was seen before, so a stream goes through one task in order. Spark sorts it, on disk if need be, and the
    task keeps a few numbers per family and no pairs.
    """
    rows = pairs.select("stream", "run_id", "family", F.col("priority").cast("double").alias("priority"), F.col("cost").cast("double").alias("cost"), "violated")
    ordered = rows.repartition("stream").sortWithinPartitions("stream", F.desc("priority"), "run_id")
    return ordered.mapInArrow(lambda batches: selected(batches, budget, threshold, least_seen), "stream string, run_id string, taken boolean, spent double")


PLANNERS = {"exhaustive": exhaustive, "random": random, "span_only": only("sentence"), "prompt_only": only("prompt_clause"), "schema_only": only("schema"), "cheapest": cheapest_first, "coarse_to_fine": coarse_to_fine, "round_robin": round_robin}


def planner(name: str):
    return PLANNERS[name]


def cover_strata(rows: DataFrame, row_id: str, tokens: list[str], most: int) -> list[str]:
    """Ids of at most ``most`` rows that greedily cover the (column, value) strata; what reaches the driver is one row per combination of strata."""
    combos = rows.groupBy(*tokens).agg(F.min(row_id).alias("id")).orderBy("id").collect()
    left = {(t, r[t]) for r in combos for t in tokens}
    pool, out = list(combos), []
    while left and pool and len(out) < most:
        best = max(pool, key=lambda r: (sum((t, r[t]) in left for t in tokens), ))
        pool.remove(best)
        out.append(best["id"])
        left -= {(t, best[t]) for t in tokens}
    return out


def retain_and_replace(anchor: DataFrame, eligible: DataFrame, key: str, size: int) -> DataFrame:
    """(key) of ``size`` rows at most: anchor rows that are still eligible, in anchor order, then other eligible ones by SHA-256.

    Both sides get their places in ranges, so what is put in order at the end are the chosen rows alone.
    """
    kept = anchor.join(eligible.select(key), key, "left_semi").select(key, F.col("position").cast("long").alias("_p"), F.lit(0).alias("_new"))
    fresh = eligible.select(key).distinct().join(anchor.select(key), key, "left_anti")
    most = kept.agg(F.greatest(F.lit(0), F.lit(size) - F.count("*")).alias("_most"))  # a row
    added = digest_places(fresh, [], key).crossJoin(most).where(F.col("place") <= F.col("_most")).select(key, F.col("place").cast("long").alias("_p"), F.lit(1).alias("_new"))
    return kept.unionByName(added).orderBy("_new", "_p").limit(size).select(key)
