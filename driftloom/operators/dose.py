"""Dose and response: complete panels of documents, the slope within documents, and its interval over resampled documents.

A document's panel takes part in every replicate through two numbers, its sums of products about its own means, so rows are
read once and documents whose two numbers are alike (at six decimals) are resampled together, by count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators.statistics import multinomial
from driftloom.sources.log import last_of
from driftloom.sources.store import written

#: A slope is reported per this much of the dose.
STEP = 0.10


def panels(records: DataFrame, by: list[str], levels: list[float], order: list[str]) -> DataFrame:
    """(…by, doc, complete, reason, num, den) of ``records`` (…by, doc, level, status, x, y and ``order``); level null is the base.

    The last record of a document's level counts. A panel is complete if the base and all ``levels`` succeeded and each level
    has its dose x; ``reason`` says what first is missing (``base``, then ``level``). ``num`` and ``den`` are the sums of
    (x - mean x)(y - mean y) and of (x - mean x)² over the levels of a complete panel. Other levels are not looked at.
    """
    known = records.where(F.col("level").isNull() | F.col("level").isin(*levels))
    last = last_of(known, [*by, "doc", "level"], order)
    ok, dose = F.col("status") == "ok", F.col("level").isNotNull()
    good = ok & dose & F.col("x").isNotNull() & F.col("y").isNotNull()
    at = lambda v: F.when(good, v)
    sums = last.groupBy(*by, "doc").agg(
        F.count_if(ok & ~dose).alias("_base"), F.count_if(good).alias("n"), F.sum(at(F.col("x"))).alias("sx"), F.sum(at(F.col("y"))).alias("sy"),
        F.sum(at(F.col("x") * F.col("x"))).alias("sxx"), F.sum(at(F.col("x") * F.col("y"))).alias("sxy"),
    )
    reason = F.when(F.col("_base") == 0, "base").when(F.col("n") < len(levels), "level")
    whole = sums.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull())
    n = F.col("n")
    of = lambda v: F.when(F.col("complete"), v)
    return whole.select(*by, "doc", "complete", "reason", of(F.col("sxy") - F.col("sx") * F.col("sy") / n).alias("num"), of(F.col("sxx") - F.col("sx") * F.col("sx") / n).alias("den"))


def dose_response(found: DataFrame, by: list[str], levels: int, replicates: int) -> DataFrame:
    """(…by, documents, no_base, no_level, complete, observations, slope, low, high) of ``panels``, per STEP of the dose.

    The pooled slope has an intercept per document. The interval is that of ``replicates`` draws of as many complete
    documents: the floor(0.025 (B - 1))-th and the ceil(0.975 (B - 1))-th of the sorted slopes. Groups without complete
    panels, or whose doses do not vary within documents, have none.
    """
    found = written(found, "panels")
    counts = found.groupBy(*by).agg(F.count("*").alias("documents"), F.count_if(F.col("reason") == "base").alias("no_base"), F.count_if(F.col("reason") == "level").alias("no_level"), F.count_if("complete").alias("complete"), F.sum("num").alias("_num"), F.sum("den").alias("_den"))
    # Rounded twice, as sums that are the same but for the order of their terms may lie on both sides of a half.
    key = F.concat_ws("/", *(F.round(F.round(F.col(c) * 1_000_000, 4)).cast("long").cast("string") for c in ("num", "den")))
    cells = written(found.where("complete").groupBy(*by, key.alias("cell")).agg(F.count("*").alias("n"), F.sum("num").alias("num"), F.sum("den").alias("den")), "cells")
    drawn = multinomial(cells, by, "cell", "n", replicates)
    share = F.col("w") / F.col("n")
    slopes = drawn.groupBy(*by, "replicate").agg(F.sum(share * F.col("num")).alias("num"), F.sum(share * F.col("den")).alias("den")).where("den > 0").select(*by, (STEP * F.col("num") / F.col("den")).alias("b"))
    ends = slopes.groupBy(*by).agg(F.sort_array(F.collect_list("b")).alias("b"))  # as many as replicates
    place = lambda p, whole: (whole(p * (F.size("b") - 1)) + 1).cast("int")
    ends = ends.select(*by, F.element_at("b", place(0.025, F.floor)).alias("low"), F.element_at("b", place(0.975, F.ceil)).alias("high"))
    slope = F.when(F.col("_den") > 0, STEP * F.col("_num") / F.col("_den"))
    return counts.join(ends, by, "left").select(*by, "documents", "no_base", "no_level", "complete", (F.col("complete") * levels).alias("observations"), slope.alias("slope"), "low", "high")
