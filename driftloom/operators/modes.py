"""Which output mode of an extractor is used: qualification on a grid of documents and conditions, and a paired test."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators.lineage import latest
from driftloom.operators.statistics import binomial_upper_tail


@dataclass(frozen=True)
class Floors:
    """What a mode must reach, in tenths of the documents: 54 means 54 of the 60 cells that ten documents in six conditions have."""

    endpoints: int = 54
    base: int = 9
    each_condition: int = 8
    each_parse_pair: int = 8
    parse_pairs: int = 45
    each_evaluable_pair: int = 7
    evaluable_pairs: int = 40
    improvement: int = 6
    p_below: float = 0.05


def cells(records: DataFrame, by: list[str], modes: list[str], conditions: list[str], order: list[str]) -> DataFrame:
    """(…by, mode, doc, condition, parsed, filled): the last record of each cell; ``records`` have ``n_edges``, null where nothing was parsed.

    Records of other modes or conditions are left out. ``filled``: has an edge.
    """
    known = records.where(F.col("mode").isin(*modes) & F.col("condition").isin(*conditions))
    last = latest(known, [*by, "mode", "doc", "condition"], order)
    return last.select(*by, "mode", "doc", "condition", F.col("n_edges").isNotNull().alias("parsed"), F.coalesce(F.col("n_edges") > 0, F.lit(False)).alias("filled"))


def mode_report(found: DataFrame, by: list[str], conditions: list[str], floors: Floors = Floors()) -> DataFrame:
    """(…by, mode, documents, attempted, parsed, parse_pairs, evaluable_pairs, by_condition, qualified), from ``cells``.

    The first of ``conditions`` is the base. A pair is a document's base and another condition when both were parsed; it is
    evaluable when one of them has an edge. ``by_condition`` maps a condition to its (parsed, pairs, evaluable). The
    floors are of the group's documents, whichever mode they were tried in, and a mode must have tried every cell.
    """
    base, others = conditions[0], conditions[1:]
    # A document has at most one cell per condition, so its row stays small.
    rows = found.groupBy(*by, "mode", "doc").agg(F.map_from_entries(F.collect_list(F.struct("condition", F.struct("parsed", "filled")))).alias("c"))
    at = lambda c, field: F.coalesce(F.col("c")[c][field], F.lit(False))
    sums = [F.count("*").alias("_docs"), F.sum(F.size("c")).alias("attempted")]
    for i, c in enumerate(conditions):
        sums.append(F.count_if(at(c, "parsed")).alias(f"_s{i}"))
        both = at(base, "parsed") & at(c, "parsed") if i else F.lit(False)
        sums += [F.count_if(both).alias(f"_p{i}"), F.count_if(both & (at(base, "filled") | at(c, "filled"))).alias(f"_e{i}")]
    per = rows.groupBy(*by, "mode").agg(*sums)
    documents = found.select(*by, "doc").distinct().groupBy(*by).agg(F.count("*").alias("documents"))
    per = per.join(documents, by) if by else per.crossJoin(documents)  # a row
    total = lambda kind, start: sum((F.col(f"_{kind}{i}") for i in range(start, len(conditions))), F.lit(0).cast("long"))
    reaches = lambda value, tenths: value * 10 >= F.col("documents") * tenths
    ok = (F.col("attempted") == F.col("documents") * len(conditions)) & reaches(total("s", 0), floors.endpoints) & reaches(F.col("_s0"), floors.base) & reaches(total("p", 1), floors.parse_pairs) & reaches(total("e", 1), floors.evaluable_pairs)
    for i in range(len(conditions)):
        ok = ok & reaches(F.col(f"_s{i}"), floors.each_condition)
        if i:
            ok = ok & reaches(F.col(f"_p{i}"), floors.each_parse_pair) & reaches(F.col(f"_e{i}"), floors.each_evaluable_pair)
    of = F.map_from_arrays(F.array(*map(F.lit, conditions)), F.array(*(F.struct(F.col(f"_s{i}").alias("parsed"), F.col(f"_p{i}").alias("pairs"), F.col(f"_e{i}").alias("evaluable")) for i in range(len(conditions)))))
    return per.select(*by, "mode", "documents", "attempted", total("s", 0).alias("parsed"), total("p", 1).alias("parse_pairs"), total("e", 1).alias("evaluable_pairs"), of.alias("by_condition"), ok.alias("qualified"))


def paired_modes(found: DataFrame, by: list[str], first: str, second: str) -> DataFrame:
    """(…by, common_cells, second_only, first_only, p): cells that both modes tried, and the exact one-sided McNemar test that ``second`` parses more."""
    side = lambda m: F.max(F.when(F.col("mode") == m, F.col("parsed")))
    both = found.groupBy(*by, "doc", "condition").agg(side(first).alias("a"), side(second).alias("b")).where("a is not null and b is not null")
    counts = both.groupBy(*by).agg(F.count("*").alias("common_cells"), F.count_if(~F.col("a") & F.col("b")).alias("second_only"), F.count_if(F.col("a") & ~F.col("b")).alias("first_only"))
    return counts.withColumn("p", binomial_upper_tail(F.col("second_only") + F.col("first_only"), F.col("second_only")))


def select_mode(found: DataFrame, by: list[str], conditions: list[str], first: str, second: str, floors: Floors = Floors()) -> DataFrame:
    """(…by, documents, first_qualified, second_qualified, common_cells, second_only, first_only, p, improvement, mode) per group.

    ``first`` is taken if it qualifies; ``second`` if it qualifies, parses more by the floor and passes the paired test; otherwise
    ``mode`` is null. A group without any common cell has p = 1.
    """
    report = mode_report(found, by, conditions, floors)
    of = lambda m, c: F.max(F.when(F.col("mode") == m, F.col(c)))
    wide = report.groupBy(*by).agg(F.max("documents").alias("documents"), *(F.coalesce(of(m, c), F.lit(z)).alias(f"{n}_{c}") for n, m in (("first", first), ("second", second)) for c, z in (("qualified", False), ("parsed", 0))))
    pairs = paired_modes(found, by, first, second)
    joined = wide.join(pairs, by, "left") if by else wide.crossJoin(pairs)
    joined = joined.fillna(0, ["common_cells", "second_only", "first_only"]).fillna(1.0, ["p"]).withColumn("improvement", F.col("second_parsed") - F.col("first_parsed"))
    better: Column = F.col("second_qualified") & (F.col("improvement") * 10 >= F.col("documents") * floors.improvement) & (F.col("p") < floors.p_below)
    chosen = F.when(F.col("first_qualified"), first).when(better, second)
    return joined.select(*by, "documents", "first_qualified", "second_qualified", "common_cells", "second_only", "first_only", "p", "improvement", chosen.alias("mode"))
