"""Extraction toolchains side by side: names to entities, edges to one namespace, and drift over documents x conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OK = "ok"
STATES = ("both_empty", "base_only", "cf_only", "both_nonempty")


def surface(value: Column) -> Column:
    """A name in lower case with single spaces; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"(?U)\s+", " "))


def name_index(entities: DataFrame) -> DataFrame:
    """(doc, name, entity): each declared name of ``entities`` (doc, entity, names) with its entity, null if it has several."""
    names = entities.select("doc", "entity", F.explode("names").alias("n")).select("doc", "entity", surface(F.col("n")).alias("name")).where("name <> ''")
    return names.groupBy("doc", "name").agg(F.min("entity").alias("entity"), F.max("entity").alias("_last")).select("doc", "name", F.when(F.col("entity") == F.col("_last"), F.col("entity")).alias("entity"))


def relation_id(relation: Column, ids: dict[str, str], renamed: dict[str, str]) -> Column:
    """The id of a declared label, under its new name or its own, with blanks or underscores; ``label:`` and the label otherwise."""
    spaced = surface(relation)
    name = F.replace(spaced, F.lit(" "), F.lit("_"))
    pairs = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.create_map().cast("map<string,string>")
    old = F.coalesce(F.try_element_at(pairs(renamed), name), name)
    known = pairs({" ".join(k.lower().split()): v for k, v in ids.items()})
    return F.coalesce(F.try_element_at(known, old), F.try_element_at(known, spaced), F.concat(F.lit("label:"), old))


def canonical_edges(records: DataFrame, entities: DataFrame, ids: dict[str, str], renamed: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Canonical edges (toolchain, doc, condition, s, r, o) of ``records`` (…, status, edges: array of s, r, o), and an audit per record.

    A name that one entity of the document declares becomes that entity (exact). One that several declare (ambiguous), or
    none (unlinked), stays ``name:`` and the name. The audit counts raw and canonical edges, both ends by how they were
    resolved, and relations that are not declared; a record whose status is not ok has no edges, one without edges zeros.
    """
    by = ["toolchain", "doc", "condition"]
    raw = records.where(F.col("status") == OK).select(*by, F.explode("edges").alias("e")).select(*by, "e.*")
    index = name_index(entities)
    both = raw.withColumns({"_sn": surface(F.col("s")), "_on": surface(F.col("o")), "_r": relation_id(F.col("r"), ids, renamed)})
    for end in ("s", "o"):
        both = both.join(index.select("doc", F.col("name").alias(f"_{end}n"), F.col("entity").alias(f"_{end}e"), F.lit(True).alias(f"_{end}d")), ["doc", f"_{end}n"], "left")
    key = lambda e: F.coalesce(f"_{e}e", F.concat(F.lit("name:"), F.col(f"_{e}n")))
    how = lambda e, which: {"exact": F.col(f"_{e}e").isNotNull(), "ambiguous": F.col(f"_{e}d").isNotNull() & F.col(f"_{e}e").isNull(), "unlinked": F.col(f"_{e}d").isNull()}[which].cast("int")
    found = both.select(*by, key("s").alias("s"), F.col("_r").alias("r"), key("o").alias("o"), *((how("s", w) + how("o", w)).alias(w) for w in ("exact", "ambiguous", "unlinked")), F.col("_r").startswith("label:").cast("int").alias("off_schema"))
    sums = ("exact", "ambiguous", "unlinked", "off_schema")
    each = found.groupBy(*by, "s", "r", "o").agg(F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in sums))
    per = each.groupBy(*by).agg(F.sum("_n").alias("raw_edges"), F.count("*").alias("canonical_edges"), *(F.sum(c).alias(c) for c in sums))
    audit = records.select(*by, "status").join(per, by, "left").fillna(0)
    return each.select(*by, "s", "r", "o"), audit


def mapping_summary(audit: DataFrame, by: list[str]) -> DataFrame:
    """Sums of audits per group, with the share of ends that are linked to an entity."""
    ends = F.sum("exact") + F.sum("ambiguous") + F.sum("unlinked")
    return audit.groupBy(*by).agg(
        F.count("*").alias("n_endpoints"), F.count_if(F.col("status") == OK).alias("n_successful"), F.count_if(F.col("status") != OK).alias("n_errors"),
        *(F.sum(c).alias(c) for c in ("raw_edges", "canonical_edges", "exact", "ambiguous", "unlinked", "off_schema")), F.when(ends > 0, F.sum("exact") / ends).otherwise(0.0).alias("linked_rate"),
    )


def condition_matrix(records: DataFrame, edges: DataFrame, conditions: list[str], base: str = "base") -> DataFrame:
    """(toolchain, doc, condition, n_base, n_own, n_both): each document's base against each condition, where both succeeded.

    One aggregation: an edge has a bit per condition, and a cell's counts are sums over bits. Cells of which both sides
    are empty are there, with zeros; who averages decides about them.
    """
    every = [base, *conditions]
    bit = F.lit(0)
    for i, c in enumerate(every):
        bit = F.when(F.col("condition") == c, 1 << i).otherwise(bit)
    masks = edges.groupBy("toolchain", "doc", "s", "r", "o").agg(F.bit_or(bit).alias("m"))
    has = lambda i: F.col("m").bitwiseAND(F.lit(1 << i)) != 0
    sizes = masks.groupBy("toolchain", "doc").agg(F.count_if(has(0)).alias("n_base"), *(x for i, c in enumerate(conditions, 1) for x in (F.count_if(has(i)).alias(f"_n{i}"), F.count_if(has(0) & has(i)).alias(f"_b{i}"))))
    there = records.where(F.col("status") == OK).groupBy("toolchain", "doc").agg(F.bit_or(bit).alias("m")).where(has(0))
    cells = F.array(*(F.when(has(i), F.struct(F.lit(c).alias("condition"), F.coalesce(f"_n{i}", F.lit(0)).alias("n_own"), F.coalesce(f"_b{i}", F.lit(0)).alias("n_both"))) for i, c in enumerate(conditions, 1)))
    joined = there.join(sizes, ["toolchain", "doc"], "left")
    return joined.select("toolchain", "doc", F.coalesce("n_base", F.lit(0)).alias("n_base"), F.explode(F.array_compact(cells)).alias("c")).select("toolchain", "doc", "c.condition", "n_base", "c.n_own", "c.n_both")


def drift(n_base: str, n_own: str, n_both: str) -> Column:
    """1 - Jaccard of two sets; 0 if both are empty."""
    union = F.col(n_base) + F.col(n_own) - F.col(n_both)
    return F.when(union > 0, 1 - F.col(n_both) / union).otherwise(0.0)


def graph_drift(matrix: DataFrame, records: DataFrame, tolerance: dict[str, float], share: float) -> DataFrame:
    """Per toolchain and condition: cells with any edge, failed records, mean and median drift, share above the tolerance, verdict.

    Cells of which both sides are empty say nothing and are taken out before the mean; a condition without cells has no row.
    """
    tau = F.create_map(*(F.lit(x) for kv in tolerance.items() for x in kv))[F.col("condition")]
    cells = matrix.where("n_base + n_own > 0").withColumn("d", drift("n_base", "n_own", "n_both"))
    out = cells.groupBy("toolchain", "condition").agg(F.count("*").alias("n"), F.avg("d").alias("mean_drift"), F.expr("percentile(d, 0.5)").alias("median_drift"), F.first(tau).alias("tau"), F.avg((F.col("d") > tau).cast("int")).alias("violation_rate"))
    failed = records.where(F.col("status") != OK).groupBy("toolchain", "condition").agg(F.count("*").alias("errors"))
    return out.join(failed, ["toolchain", "condition"], "left").fillna(0, ["errors"]).withColumn("verdict", F.when(F.col("violation_rate") > share, "VIOLATED").otherwise("SATISFIED"))


def _has(views: list[tuple[str, str]], v: tuple[str, str]) -> Column:
    return F.col("mask").bitwiseAND(F.lit(1 << views.index(v))) != 0


def _others(views: list[tuple[str, str]], base: str) -> list[tuple[str, str]]:
    return [v for v in views if v[1] != base]


def _keys(rows: DataFrame) -> list[str]:
    return [c for c in ("doc", "id") if c in rows.columns]  # an id tells its document, but not where it lies


def answer_counts(answers: DataFrame, views: list[tuple[str, str]], base: str = "base") -> DataFrame:
    """(doc, id, …) of ``answers`` (doc, id, a, mask; doc may be missing): how many each view has, and how many it has in common with its toolchain's base view."""
    has = lambda v: _has(views, v)
    return answers.groupBy(*_keys(answers)).agg(*(F.count_if(has(v)).alias(f"_n{i}") for i, v in enumerate(views)), *(F.count_if(has(v) & has((v[0], base))).alias(f"_b{views.index(v)}") for v in _others(views, base)))


def pair_rows(asked: DataFrame, counts: DataFrame, views: list[tuple[str, str]], base: str = "base") -> DataFrame:
    """(toolchain, doc, condition, n_base, n_own, n_both) of every instance of ``asked`` (id, doc), zeros where it has no answers."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    at = {v: i for i, v in enumerate(views)}
    each = F.array(*(F.struct(F.lit(t).alias("toolchain"), F.lit(c).alias("condition"), zero(f"_n{at[t, base]}").alias("n_base"), zero(f"_n{at[t, c]}").alias("n_own"), zero(f"_b{at[t, c]}").alias("n_both")) for t, c in _others(views, base)))
    return asked.select("id", "doc").join(counts, _keys(counts), "left").select("doc", F.explode(each).alias("p")).select("doc", "p.*")


def pair_parts(rows: DataFrame) -> DataFrame:
    """(toolchain, doc, condition, n_queries, n_active, drifts, max_drift, and the four answer states): ``pair_rows`` summed up, for ``succeeded``; of rows in parts, each part's."""
    rows = rows.withColumn("d", drift("n_base", "n_own", "n_both"))
    state = F.when((F.col("n_base") == 0) & (F.col("n_own") == 0), STATES[0]).when(F.col("n_own") == 0, STATES[1]).when(F.col("n_base") == 0, STATES[2]).otherwise(STATES[3])
    return rows.withColumn("state", state).groupBy("toolchain", "doc", "condition").agg(F.count("*").alias("n_queries"), F.count_if(F.col("state") != STATES[0]).alias("n_active"), F.sum("d").alias("drifts"), F.max("d").alias("max_drift"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES))


def succeeded(parts: DataFrame, records: DataFrame, base: str = "base") -> DataFrame:
    """(toolchain, doc, condition, n_queries, n_active, mean_drift, max_drift, and the four answer states) of ``pair_parts`` whose pair succeeded."""
    n = F.sum("n_queries")
    per = parts.groupBy("toolchain", "doc", "condition").agg(n.alias("n_queries"), F.sum("n_active").alias("n_active"), (F.sum("drifts") / n).alias("mean_drift"), F.max("max_drift").alias("max_drift"), *(F.sum(s).alias(s) for s in STATES))
    ok = records.where(F.col("status") == OK).select("toolchain", "doc", "condition").distinct()
    return per.join(ok, ["toolchain", "doc", "condition"]).join(ok.where(F.col("condition") == base).select("toolchain", "doc"), ["toolchain", "doc"])


def query_pairs(asked: DataFrame, answers: DataFrame, records: DataFrame, views: list[tuple[str, str]], base: str = "base") -> DataFrame:
    """``succeeded`` of the query instances ``asked`` (id, doc) and their ``answers`` (doc, id, a, mask), with a bit per view (toolchain, condition)."""
    return succeeded(pair_parts(pair_rows(asked, answer_counts(answers, views, base), views, base)), records, base)


def query_summary(pairs: DataFrame, tolerance: float) -> DataFrame:
    """Per toolchain and condition: pairs, documents, evaluations, largest and mean drift of pairs, violations, activity and answer states."""
    n = F.sum("n_queries")
    return pairs.groupBy("toolchain", "condition").agg(
        F.count("*").alias("n_pairs"), F.count_distinct("doc").alias("n_documents"), n.alias("n_query_evaluations"), F.avg("max_drift").alias("mean_pair_max"), F.expr("percentile(max_drift, 0.5)").alias("median_pair_max"), F.avg("mean_drift").alias("mean_pair_mean"),
        F.avg((F.col("max_drift") > tolerance).cast("int")).alias("violation_rate"), F.avg((F.col("n_active") > 0).cast("int")).alias("active_pair_rate"), (1 - F.sum(STATES[0]) / n).alias("active_query_rate"), *(F.sum(s).alias(s) for s in STATES),
    )
