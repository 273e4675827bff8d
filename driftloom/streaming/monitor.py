"""A drift monitor over a stream of pair records; beyond batch auditing, on the same semantics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def violation_windows(records: DataFrame, threshold: float, late: str = "10 minutes", length: str = "1 hour", slide: str | None = None) -> DataFrame:
    """(window, cause_family, n, violation_rate) of ``records`` (created_at, run_id, cause_family, drift); repeated runs within the watermark count once."""
    seen = records.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["run_id"]) if records.isStreaming else records.dropDuplicates(["run_id"])
    span = F.window("created_at", length, slide) if slide else F.window("created_at", length)
    return seen.groupBy(span, "cause_family").agg(F.count("*").alias("n"), F.avg((F.col("drift") > threshold).cast("double")).alias("violation_rate")).select(F.col("window.start").alias("start"), "cause_family", "n", "violation_rate")
