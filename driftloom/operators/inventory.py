"""Registered inventories held against rebuilt ones, both ways; all groups in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons in the order in which they are looked for; a group has the first that applies.
QUERY_REASONS = ("unregistered", "unknown", "eligibility", "count", "duplicate", "inventory")
EDGE_REASONS = ("missing_event", "edge_counts")


def _first(*cases: tuple[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for reason, applies in reversed(cases):
        out = F.when(applies, reason).otherwise(out)
    return out


def query_inventory(declared: DataFrame, registered: DataFrame, rebuilt: DataFrame, by: list[str], key: str) -> DataFrame:
    """(…by, n_declared, n_registered, n_rebuilt, n_common, reason) per group of queries; reason is null where all agrees.

    ``declared`` (…by, eligible, n_queries) says of each group whether it has queries and how many, ``registered`` and
    ``rebuilt`` (…by, ``key``) list them. ``unregistered``: rebuilt but not declared; ``unknown``: registered but not declared;
    ``eligibility``: declared to have queries and has none, or the reverse; ``count``: declared with another number than was
    rebuilt; ``duplicate``: registered twice; ``inventory``: other queries than the rebuilt ones. Groups may be null, rows repeated.
    """
    sides = registered.select(*by, key, F.lit(1).alias("r"), F.lit(0).alias("b")).unionByName(rebuilt.select(*by, key, F.lit(0).alias("r"), F.lit(1).alias("b")))
    each = sides.groupBy(*by, key).agg(F.sum("r").alias("r"), F.max("b").alias("b"))
    found = each.groupBy(*by).agg(F.sum("r").alias("_r"), F.sum("b").alias("_b"), F.count_if((F.col("r") > 0) & (F.col("b") > 0)).alias("_c"), F.count_if(F.col("r") > 0).alias("_d"), F.lit(None).cast("boolean").alias("_e"), F.lit(None).cast("long").alias("_n"), F.lit(0).alias("_s"))
    said = declared.select(*by, *(F.lit(0).cast("long").alias(c) for c in ("_r", "_b", "_c", "_d")), F.coalesce("eligible", F.lit(False)).alias("_e"), F.coalesce("n_queries", F.lit(0)).cast("long").alias("_n"), F.lit(1).alias("_s"))
    # Added, not joined: groups that only one side has come out, and null is a group like others.
    g = found.unionByName(said).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("_r", "_b", "_c", "_d", "_s")), F.bool_or("_e").alias("_e"), F.sum("_n").alias("_n"))
    reason = _first(
        ("unregistered", (F.col("_s") == 0) & (F.col("_b") > 0)), ("unknown", F.col("_s") == 0), ("eligibility", F.col("_e") != (F.col("_b") > 0)), ("count", F.col("_n") != F.col("_b")),
        ("duplicate", F.col("_r") != F.col("_d")), ("inventory", (F.col("_c") != F.col("_b")) | (F.col("_c") != F.col("_d"))),
    )
    return g.select(*by, F.when(F.col("_s") > 0, F.col("_n")).alias("n_declared"), F.col("_r").alias("n_registered"), F.col("_b").alias("n_rebuilt"), F.col("_c").alias("n_common"), reason.alias("reason"))


COUNTS = ("all_rows", "linked_rows", "typed_edges", "unlinked_rows")


def edge_counts(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(event_id, all_rows, linked_rows, typed_edges, unlinked_rows) of every event, zeros without edges.

    An edge (event_id, s, r, o) is linked when it has all three; ``typed_edges`` counts different linked ones.
    """
    linked = F.col("s").isNotNull() & F.col("r").isNotNull() & F.col("o").isNotNull()
    per = edges.groupBy("event_id", "s", "r", "o").agg(F.count("*").alias("n")).groupBy("event_id").agg(F.sum("n").alias("all_rows"), F.sum(F.when(linked, F.col("n")).otherwise(0)).alias("linked_rows"), F.count_if(linked).alias("typed_edges"))
    full = events.select("event_id").distinct().join(per, "event_id", "left").fillna(0, ["all_rows", "linked_rows", "typed_edges"])
    return full.withColumn("unlinked_rows", F.col("all_rows") - F.col("linked_rows"))


def edge_inventory(pairs: DataFrame, events: DataFrame, edges: DataFrame) -> DataFrame:
    """(run_id, side, event_id, reason) for both ends of every pair; reason is null where the counts are the registered ones.

    ``pairs`` have run_id, base_event_id, cf_event_id and base_counts, cf_counts: structs of ``COUNTS``. Ends that several
    pairs share are counted once.
    """
    ends = pairs.select("run_id", F.explode(F.array(*(F.struct(F.lit(s).alias("side"), F.col(f"{s}_event_id").alias("event_id"), F.col(f"{s}_counts").alias("said")) for s in ("base", "cf")))).alias("e")).select("run_id", "e.*")
    found = edge_counts(events, edges).select("event_id", F.struct(*(F.col(c).cast("long").alias(c) for c in COUNTS)).alias("seen"))
    differs = ~F.struct(*(F.col(f"said.{c}").cast("long").alias(c) for c in COUNTS)).eqNullSafe(F.col("seen"))
    reason = _first(("missing_event", F.col("seen").isNull()), ("edge_counts", differs))
    return ends.join(found, "event_id", "left").select("run_id", "side", "event_id", reason.alias("reason"))


def require(audit: DataFrame, shown: int = 5) -> None:
    """Raise if any row of an audit has a reason, and name the first few."""
    bad = audit.where("reason is not null").orderBy("reason", *(c for c in audit.columns if c != "reason")).limit(shown).collect()
    if bad:
        raise ValueError("inventory mismatch: " + "; ".join(str(r.asDict()) for r in bad))
