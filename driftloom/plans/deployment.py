"""Registered queries on the answers of the query catalogue over all views: deployment drift, utility against gold, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import prompts
from driftloom.operators import cohort, lineage, statistics, views
from driftloom.sources.store import kept, written

from . import derived, resampling
from .derived import table
from .evaluation import CANONICAL, PAIR, _records
from .graph import ANSWERS, CAPPED, CATALOGUED, GOLD, _answers, _catalogue, _judged
from .registry import query

QUERIES = ("lookup", "neighbor", "shared_tail_join", "typed_two_hop")
#: An instance's key in SQL, the instances of all pairs, and their answer counts.
_KEY = "concat_ws('|', i.family, coalesce(i.h, ''), coalesce(i.r, ''), coalesce(i.h1, ''), coalesce(i.r1, ''), coalesce(i.h2, ''), coalesce(i.r2, ''))"
_N = range(len(derived.FAMILIES))
INSTANCES = CATALOGUED + ANSWERS.replace("e AS (SELECT 'base' AS view, * FROM b UNION ALL SELECT * FROM c)", "e AS (SELECT 'base' AS view, * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT 'gold', * FROM g)") + f""",
ans AS MATERIALIZED (SELECT doc, {_KEY} AS iid, a, max((view = 'base')::INT) AS vb, max((view = 'gold')::INT) AS vg, {", ".join(f"max((view = '{f}')::INT) AS v{k}" for k, f in enumerate(derived.FAMILIES))} FROM w i GROUP BY ALL),
cnt AS (SELECT doc, iid, sum(vb) AS nb, sum(vg) AS ng, sum(vb * vg) AS bg, {", ".join(f"sum(v{k}) AS n{k}, sum(v{k} * vb) AS b{k}, sum(v{k} * vg) AS g{k}" for k in _N)} FROM ans GROUP BY ALL),
inst AS MATERIALIZED (SELECT f.family AS cause_family, i.doc, i.family AS query, {_KEY} AS iid, coalesce(nb, 0) AS base_n, coalesce(ng, 0) AS gold_n, coalesce(bg, 0) AS base_gold,
  coalesce(CASE f.family {" ".join(f"WHEN '{f}' THEN n{k}" for k, f in enumerate(derived.FAMILIES))} END, 0) AS cf_n, coalesce(CASE f.family {" ".join(f"WHEN '{f}' THEN b{k}" for k, f in enumerate(derived.FAMILIES))} END, 0) AS both_n,
  coalesce(CASE f.family {" ".join(f"WHEN '{f}' THEN g{k}" for k, f in enumerate(derived.FAMILIES))} END, 0) AS cf_gold FROM i CROSS JOIN f LEFT JOIN cnt ON cnt.doc = i.doc AND cnt.iid = {_KEY}),
d AS MATERIALIZED (SELECT *, CASE WHEN base_n + cf_n = 0 THEN 0.0 ELSE 1 - both_n / (base_n + cf_n - both_n)::DOUBLE END AS drift, CASE WHEN base_n = 0 AND cf_n = 0 THEN 'both_empty' WHEN cf_n = 0 THEN 'base_only' WHEN base_n = 0 THEN 'cf_only' ELSE 'both_nonempty' END AS state,
  CASE WHEN base_n + gold_n = 0 THEN 1.0 ELSE 2 * base_gold / (base_n + gold_n)::DOUBLE END AS f1_base, CASE WHEN cf_n + gold_n = 0 THEN 1.0 ELSE 2 * cf_gold / (cf_n + gold_n)::DOUBLE END AS f1_cf FROM inst)
"""
#: The same with every shared tail and chain of a document.
WHOLE_INSTANCES = INSTANCES.replace(" WHERE k <= 6)", ")").replace(" WHERE k <= 8)", ")")


def f1(hit: Column, n: Column, gold: Column) -> Column:
    """Both empty: 1; one empty: 0."""
    return F.when(n + gold == 0, 1.0).otherwise(2 * hit / (n + gold))


def _instances(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    """A row per cause family and query instance: answer counts, drift, state and F1 against the gold answers.

    What is written is a row per instance with the counts of all cause families, each query family by itself, in buckets.
    ``whole`` as in ``_catalogue``.
    """
    families = derived.FAMILIES
    b, g = views.has(views.BASE), views.has(GOLD)

    catalogued = _catalogue(spark, sf_dir, whole)

    def make(query: str) -> DataFrame:
        asked = catalogued[query]
        counted = _answers(catalogued, _judged(spark, sf_dir, GOLD))[query].groupBy("doc", "id").agg(
            F.count_if(b).alias("base_n"), F.count_if(g).alias("gold_n"), F.count_if(b & g).alias("base_gold"),
            *views.counters(families, cf_n=lambda i: views.has(views.bit(i)), both_n=lambda i: views.has(views.BASE | views.bit(i)), cf_gold=lambda i: views.has(GOLD | views.bit(i))),
        )
        counts = [c for c in counted.columns if c not in ("doc", "id")]
        return asked.select("doc", "id", F.col("family").alias("query")).join(counted, ["doc", "id"], "left").fillna(0, counts).drop("id")

    tables = [kept(spark, f"instances_{q}" + "_whole" * (whole and q in CAPPED), derived.inputs(sf_dir), lambda q=q: make(q), derived.buckets(spark, sf_dir)) for q in QUERIES]
    per = views.by_family(families, **{n: (lambda i, n=n: F.col(f"{n}{i}")) for n in ("cf_n", "both_n", "cf_gold")})
    each = [t.select("doc", "query", "base_n", "gold_n", "base_gold", F.explode(per).alias("x")).select(F.col("x.family").alias("cause_family"), "*", "x.cf_n", "x.both_n", "x.cf_gold").drop("x") for t in tables]
    return reduce(DataFrame.unionByName, each).withColumns({
        "drift": 1 - views.ratio(F.col("both_n"), F.col("base_n") + F.col("cf_n") - F.col("both_n"), 1.0), "state": views.answer_state(F.col("base_n"), F.col("cf_n")),
        "f1_base": f1(F.col("base_gold"), F.col("base_n"), F.col("gold_n")), "f1_cf": f1(F.col("cf_gold"), F.col("cf_n"), F.col("gold_n")),
    })


STATES = ("both_empty", "base_only", "cf_only", "both_nonempty")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    # Means of small fractions may lie just at a half; both engines then round up, whichever way they summed.
    return df.withColumns({n: F.round(F.col(n) + 1e-9, 6) for n in names})


@query(WHOLE_INSTANCES + f"""SELECT p.family AS cause_family, p.doc, k.query, count(d.iid) AS n_queries, round(avg(drift) + 1e-9, 6) AS mean_drift, round(max(drift) + 1e-9, 6) AS max_drift, {", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in STATES)}
FROM p CROSS JOIN (SELECT unnest({list(QUERIES)}) AS query) k LEFT JOIN d ON d.cause_family = p.family AND d.doc = p.doc AND d.query = k.query GROUP BY ALL""")
def deployment_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each pair in each query family, over all its instances; a family without queries in a document has no drift, not a drift of 0."""
    grid = derived.documents(spark, sf_dir).select("doc", F.explode(F.array(*map(F.lit, derived.FAMILIES))).alias("cause_family")).withColumn("query", F.explode(F.array(*map(F.lit, QUERIES))))
    per = _instances(spark, sf_dir, whole=True).groupBy("cause_family", "doc", "query").agg(F.count("*").alias("n_queries"), F.avg("drift").alias("mean_drift"), F.max("drift").alias("max_drift"), *(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return _rounded(grid.join(per, ["cause_family", "doc", "query"], "left").fillna(0, ["n_queries", *STATES]), "mean_drift", "max_drift")


@query(WHOLE_INSTANCES + """, pair AS (SELECT cause_family, doc, query, count(*) AS n, avg(drift) AS m, sum(drift) AS s FROM d GROUP BY ALL)
SELECT query, cause_family, count(*) AS n_pairs, count(DISTINCT doc) AS n_documents, sum(n)::BIGINT AS n_evaluations, round(avg(m) + 1e-9, 6) AS pair_mean, round(quantile_cont(m, 0.5) + 1e-9, 6) AS pair_median, round(sum(s) / sum(n) + 1e-9, 6) AS instance_mean FROM pair GROUP BY GROUPING SETS ((query), (query, cause_family))""")
def deployment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per query family, overall and by cause family, over all instances: means weighted by pair and by instance."""
    pair = _instances(spark, sf_dir, whole=True).groupBy("cause_family", "doc", "query").agg(F.count("*").alias("n"), F.avg("drift").alias("m"), F.sum("drift").alias("s"))
    levels = [F.struct(F.lit(None).cast("string").alias("cause_family")), F.struct("cause_family")]
    each = pair.withColumn("level", F.explode(F.array(*levels))).groupBy("query", F.col("level.cause_family").alias("cause_family"))
    out = each.agg(F.count("*").alias("n_pairs"), F.count_distinct("doc").alias("n_documents"), F.sum("n").alias("n_evaluations"), F.avg("m").alias("pair_mean"), F.expr("percentile(m, 0.5)").alias("pair_median"), (F.sum("s") / F.sum("n")).alias("instance_mean"))
    return _rounded(out, "pair_mean", "pair_median", "instance_mean")


@query(INSTANCES + """SELECT cause_family, doc, count(*) AS n_queries, round(avg(f1_base) + 1e-9, 6) AS f1_base, round(avg(f1_cf) + 1e-9, 6) AS f1_cf, round(avg(abs(f1_base - f1_cf)) + 1e-9, 6) AS delta_f1_abs, round(avg(f1_base - f1_cf) + 1e-9, 6) AS delta_f1_signed, round(max(drift) + 1e-9, 6) AS max_drift, round(avg(drift) + 1e-9, 6) AS mean_drift,
bool_or(base_n + cf_n > 0) AS any_answer FROM d GROUP BY ALL""")
def utility_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F1 of a pair's answers against the gold answers, and how it changes; beside the drift, which needs no gold."""
    change = F.col("f1_base") - F.col("f1_cf")
    out = _instances(spark, sf_dir).groupBy("cause_family", "doc").agg(
        F.count("*").alias("n_queries"), F.avg("f1_base").alias("f1_base"), F.avg("f1_cf").alias("f1_cf"), F.avg(F.abs(change)).alias("delta_f1_abs"), F.avg(change).alias("delta_f1_signed"),
        F.max("drift").alias("max_drift"), F.avg("drift").alias("mean_drift"), F.bool_or(F.col("base_n") + F.col("cf_n") > 0).alias("any_answer"),
    )
    return _rounded(out, "f1_base", "f1_cf", "delta_f1_abs", "delta_f1_signed", "max_drift", "mean_drift")


@query(INSTANCES + """, per AS (SELECT cause_family, doc, query, avg(f1_cf) AS f, sum(gold_n) AS g FROM d GROUP BY ALL)
SELECT cause_family, doc, count(*) FILTER (g > 0) AS active, round(avg(f) FILTER (g > 0) + 1e-9, 6) AS macro_f1 FROM per GROUP BY ALL""")
def macro_query_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the query families that have gold answers in the document."""
    per = _instances(spark, sf_dir).groupBy("cause_family", "doc", "query").agg(F.avg("f1_cf").alias("f"), F.sum("gold_n").alias("g"))
    return _rounded(per.groupBy("cause_family", "doc").agg(F.count_if(F.col("g") > 0).alias("active"), F.avg(F.when(F.col("g") > 0, F.col("f"))).alias("macro_f1")), "macro_f1")


@query(INSTANCES + """, x AS (SELECT cause_family, doc, max(drift) AS m, bool_or(base_n + cf_n > 0) AS active FROM d GROUP BY ALL)
SELECT cause_family, count(*) AS n, round(avg(m) + 1e-9, 6) AS mean_max, round(quantile_cont(m, 0.5) + 1e-9, 6) AS median_max, round(avg((m > 0.2)::INT) + 1e-9, 6) AS above_20, round(avg((m > 0.3)::INT) + 1e-9, 6) AS above_30, round(avg(active::INT) + 1e-9, 6) AS active_rate FROM x GROUP BY ALL""")
def axis_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest drift of each pair, per cause family: mean, median, how often it exceeds tolerances, and how many pairs have answers at all."""
    x = _instances(spark, sf_dir).groupBy("cause_family", "doc").agg(F.max("drift").alias("m"), F.bool_or(F.col("base_n") + F.col("cf_n") > 0).alias("active"))
    share = lambda c: F.avg(c.cast("int"))
    out = x.groupBy("cause_family").agg(F.count("*").alias("n"), F.avg("m").alias("mean_max"), F.expr("percentile(m, 0.5)").alias("median_max"), share(F.col("m") > 0.2).alias("above_20"), share(F.col("m") > 0.3).alias("above_30"), share(F.col("active")).alias("active_rate"))
    return _rounded(out, "mean_max", "median_max", "above_20", "above_30", "active_rate")


@query(INSTANCES + """, x AS (SELECT cause_family, doc, CASE WHEN query IN ('lookup', 'neighbor') THEN 'local' ELSE 'multihop' END AS regime, query, count(*) AS n, avg(drift) AS m, bool_or(base_n + cf_n > 0) AS active FROM d GROUP BY ALL)
SELECT cause_family, regime, sum(n)::BIGINT AS n, round(sum(m * n) / sum(n) + 1e-9, 6) AS drift FROM x WHERE active GROUP BY ALL""")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means weighted by queries of local and of multi-hop queries, over pairs with any answer."""
    regime = F.when(F.col("query").isin("lookup", "neighbor"), "local").otherwise("multihop")
    x = _instances(spark, sf_dir).groupBy("cause_family", "doc", regime.alias("regime"), "query").agg(F.count("*").alias("n"), F.avg("drift").alias("m"), F.bool_or(F.col("base_n") + F.col("cf_n") > 0).alias("active"))
    return _rounded(x.where("active").groupBy("cause_family", "regime").agg(F.sum("n").alias("n"), (F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("drift")), "drift")


@query(CANONICAL + """, x AS (SELECT cause_family, 'Q5' AS q, round(1 - paths, 9) AS drift FROM w WHERE paths IS NOT NULL UNION ALL SELECT cause_family, 'Q6', round(1 - top_degree, 9) FROM w UNION ALL SELECT cause_family, 'Q7', round(1 - ego, 9) FROM w)
SELECT q, cause_family, count(*) AS n, round(avg(drift) + 1e-9, 6) AS mean_drift, round(avg((drift > 0.3 + 1e-12)::INT) + 1e-9, 6) AS violation_rate FROM x GROUP BY ALL""")
def extended_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the path, hub and neighbourhood queries."""
    each = _records(spark, sf_dir).select("cause_family", F.explode(F.array(*(F.struct(F.lit(q).alias("q"), F.round(1 - F.col(c), 9).alias("drift")) for q, c in (("Q5", "paths"), ("Q6", "top_degree"), ("Q7", "ego"))))).alias("x")).where("x.drift is not null")
    out = each.groupBy("x.q", "cause_family").agg(F.count("*").alias("n"), F.avg("x.drift").alias("mean_drift"), F.avg((F.col("x.drift") > 0.3 + 1e-12).cast("int")).alias("violation_rate"))
    return _rounded(out, "mean_drift", "violation_rate")


@query(CANONICAL + """, x AS (SELECT cause_family, round(canonical, 9) AS m, round(recall_difference, 9) AS r FROM w)
SELECT CASE WHEN m >= 0.95 THEN 'strict' WHEN m >= 0.8 THEN 'soft' ELSE 'ablation' END AS bucket, cause_family, count(*) AS n, round(avg(m) + 1e-9, 6) AS similarity, round(avg((r > 0.2)::INT) + 1e-9, 6) AS recall_violations FROM x GROUP BY ALL""")
def stability_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, r = F.col("canonical"), F.col("recall_difference")
    bucket = F.when(m >= 0.95, "strict").when(m >= 0.8, "soft").otherwise("ablation")
    return _rounded(_records(spark, sf_dir).groupBy(bucket.alias("bucket"), "cause_family").agg(F.count("*").alias("n"), F.avg(m).alias("similarity"), F.avg((r > 0.2).cast("int")).alias("recall_violations")), "similarity", "recall_violations")


@query(CANONICAL + """, x AS (SELECT cause_family, round(canonical, 9) AS m, round(recall_difference, 9) AS r FROM w),
k AS (SELECT cause_family, m, r, rank() OVER (PARTITION BY cause_family ORDER BY m) + (count(*) OVER (PARTITION BY cause_family, m) - 1) / 2.0 AS rm, rank() OVER (PARTITION BY cause_family ORDER BY r) + (count(*) OVER (PARTITION BY cause_family, r) - 1) / 2.0 AS rr FROM x)
SELECT cause_family, count(*) FILTER (m < 0.85) AS violating, round(avg(r) FILTER (m < 0.85) + 1e-9, 6) AS loss_violating, round(avg(r) FILTER (m >= 0.85) + 1e-9, 6) AS loss_satisfied, round(CASE WHEN min(rm) < max(rm) AND min(rr) < max(rr) THEN corr(rm, rr) END + 1e-9, 6) AS rho FROM k GROUP BY ALL""")
def accuracy_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of recall of pairs that violate the invariance threshold and of those that do not, and the rank correlation of both. Ranks come from counts of equal values."""
    m, r = F.col("m"), F.col("r")
    x = _records(spark, sf_dir).select("cause_family", F.col("canonical").alias("m"), F.col("recall_difference").alias("r"))
    joint = x.groupBy("cause_family", "m", "r").agg(F.count("*").alias("n"))
    rank = lambda v: statistics.mean_rank(F.col("n"), ["cause_family"], v)
    k = joint.withColumns({"rm": rank("m"), "rr": rank("r")})
    mean = lambda v: F.sum(F.col("n") * F.col(v)) / F.sum("n")
    k = k.join(k.groupBy("cause_family").agg(mean("rm").alias("am"), mean("rr").alias("ar")), "cause_family")
    dm, dr, n = F.col("rm") - F.col("am"), F.col("rr") - F.col("ar"), F.col("n")
    over = lambda c: F.sum(F.when(c, n * r)) / F.sum(F.when(c, n))
    xx, yy = F.sum(n * dm * dm), F.sum(n * dr * dr)
    out = k.groupBy("cause_family").agg(F.coalesce(F.sum(F.when(m < 0.85, n)), F.lit(0)).alias("violating"), over(m < 0.85).alias("loss_violating"), over(m >= 0.85).alias("loss_satisfied"), F.when((xx > 0) & (yy > 0), F.sum(n * dm * dr) / F.sqrt(xx * yy)).alias("rho"))
    return _rounded(out, "loss_violating", "loss_satisfied", "rho")


@query(derived.SQL + """, t AS (SELECT family, doc, s, r, o FROM c), x AS (SELECT family, doc, s, r, o, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, s, r, o, 1 AS b, 0 AS c FROM p JOIN b q ON q.doc = p.doc UNION ALL SELECT family, doc, s, r, o, 0, 1 FROM t) GROUP BY ALL),
so AS (SELECT family, doc, s, o, max(b) AS b, max(c) AS c FROM x GROUP BY ALL), rr AS (SELECT family, doc, r, sum(b) AS nb, sum(c) AS nc FROM x GROUP BY ALL),
e AS (SELECT family, doc, 1 - sum(b * c) / count(*)::DOUBLE AS v FROM x GROUP BY ALL), q AS (SELECT family, doc, 1 - sum(b * c) / count(*)::DOUBLE AS v FROM so GROUP BY ALL), z AS (SELECT family, doc, 1 - count(*) FILTER (nb > 0 AND nc > 0) / count(*)::DOUBLE AS v FROM rr GROUP BY ALL)
SELECT p.family, p.doc, round(coalesce(e.v, 0.0) + 1e-9, 6) AS edge_distance, round(coalesce(q.v, 0.0) + 1e-9, 6) AS pair_distance, round(coalesce(z.v, 0.0) + 1e-9, 6) AS relation_set_distance, round((coalesce(e.v, 0.0) + coalesce(q.v, 0.0) + coalesce(z.v, 0.0)) / 3 + 1e-9, 6) AS distance FROM p LEFT JOIN e USING (family, doc) LEFT JOIN q USING (family, doc) LEFT JOIN z USING (family, doc)""")
def schema_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge, pair and relation-set distance of each pair, and their mean."""
    docs, elements, families = derived.args(spark, sf_dir)
    parts = [views.jaccard(docs, elements, families, "e"), views.jaccard(docs, views.masked(elements, ["s", "o"]), families, "q"), views.jaccard(docs, views.masked(elements, ["r"]), families, "z")]
    both = reduce(lambda a, b: a.join(b, PAIR), parts)
    e, q, z = (1 - F.col(c) for c in "eqz")
    return both.select(*PAIR, F.round(e + 1e-9, 6).alias("edge_distance"), F.round(q + 1e-9, 6).alias("pair_distance"), F.round(z + 1e-9, 6).alias("relation_set_distance"), F.round((e + q + z) / 3 + 1e-9, 6).alias("distance"))


@query()
def drift_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All graph metrics of each pair side by side; the tests hold it against the single queries."""
    args = docs, elements, families = derived.args(spark, sf_dir)
    parts = [views.jaccard(*args, name="edge"), views.jaccard(docs, views.masked(elements, ["s", "o"]), families, "entity_pair"), views.relation_distances(*args), views.degree_shift(*args), views.path_preservation(*args, buckets=derived.buckets(spark, sf_dir)), views.centrality_correlation(*args), views.type_flip(*args)]
    return reduce(lambda a, b: a.join(b, PAIR), parts)


@query("""WITH e AS (SELECT DISTINCT o_custkey % 10 AS packet, 'p:' || l_partkey AS s, 's:' || l_suppkey AS o, o_custkey AS source, l_linenumber % 2 AS side FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
f AS (SELECT packet, s, o, source, max(1 - side) AS b, max(side) AS c FROM e GROUP BY ALL), t AS (SELECT packet, s, o, max(b) AS b, max(c) AS c FROM f GROUP BY ALL)
SELECT packet, round(1 - x.j + 1e-9, 6) AS semantic_drift, round(1 - y.j + 1e-9, 6) AS provenance_drift FROM (SELECT packet, sum(b * c) / count(*)::DOUBLE AS j FROM t GROUP BY packet) x JOIN (SELECT packet, sum(b * c) / count(*)::DOUBLE AS j FROM f GROUP BY packet) y USING (packet)""")
def provenance_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between odd and even lines of a packet, of edges alone and of edges with their documents."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = l.join(o, l.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 10).alias("doc"), F.concat(F.lit("p:"), "l_partkey").alias("s"), F.concat(F.lit("s:"), "l_suppkey").alias("o"), F.col("o_custkey").alias("source"), F.when(F.col("l_linenumber") % 2 == 0, views.BASE).otherwise(views.bit(0)).cast("long").alias("mask"))
    docs, four = rows.select("doc").distinct(), views.masked(rows, ["s", "o", "source"])
    semantic, whole = views.jaccard(docs, views.masked(four, ["s", "o"]), ("odd",), "s"), views.jaccard(docs, four, ("odd",), "w")
    return semantic.join(whole, PAIR).select(F.col("doc").alias("packet"), F.round(1 - F.col("s") + 1e-9, 6).alias("semantic_drift"), F.round(1 - F.col("w") + 1e-9, 6).alias("provenance_drift"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS part, l_suppkey AS supp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT a.doc AS doc_a, z.doc AS doc_b, count(DISTINCT a.part) AS n_heads FROM e a JOIN e z ON a.part = z.part AND a.doc < z.doc AND a.supp <> z.supp GROUP BY ALL""")
def cohort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with any answer across them: they fall out of the join on the shared head, all pairs are never formed."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    n = derived.buckets(spark, sf_dir)[0]  # partitions follow the input, so that a task's share of the pairs stays as it is
    e = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("doc"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).repartition(n, "part").distinct()
    return cohort.pairs_on_heads(e, "part", "supp", n)


@query(f"""WITH rw AS (SELECT lang AS grp, n_chars::DOUBLE AS value FROM documents JOIN labels USING (doc_id)), {resampling.mean_intervals("rw", 40, "iv")}
SELECT grp AS lang, round(mean + 1e-9, 6) AS mean, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high FROM iv""")
def resampled_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means with percentile intervals from resampled rows; draws are digests, so that they can be repeated anywhere."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("lang", F.col("n_chars").cast("double").alias("x"))
    return _rounded(statistics.iid_bootstrap(rows, "x", 40, ["lang"]).drop("n"), "mean", "low", "high")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS latest, arg_min(event_id, (ts, event_id)) AS earliest FROM events GROUP BY user_id")
def latest_and_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, order = table(spark, sf_dir, "events"), F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(F.max_by("event_id", order).alias("latest"), F.min_by("event_id", order).alias("earliest"))


@query("""WITH r AS (SELECT o_orderkey AS run_id, o_custkey AS base, o_custkey + o_orderkey % 3 AS cf, o_orderpriority AS kind FROM orders), k AS (SELECT * FROM (VALUES ('1-URGENT', 'schema', 'presentation'), ('2-HIGH', 'prompt', 'presentation'), ('3-MEDIUM', 'evidence', 'semantic')) t(kind, cause_family, semantic_class))
SELECT run_id, coalesce(cause_family, 'unknown') AS cause_family, coalesce(semantic_class, 'unknown') AS semantic_class, b.c_nationkey AS base_document, c.c_nationkey AS cf_document FROM r LEFT JOIN k USING (kind) LEFT JOIN customer b ON b.c_custkey = base LEFT JOIN customer c ON c.c_custkey = cf""")
def paired_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with their interventions, unknown where there is none, and both events."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("base_event_id"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("cf_event_id"), F.col("o_orderpriority").alias("intervention_id"))
    candidates = spark.createDataFrame([("1-URGENT", "schema", "presentation"), ("2-HIGH", "prompt", "presentation"), ("3-MEDIUM", "evidence", "semantic")], "intervention_id string, cause_family string, semantic_class string")
    events = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("document_id"))
    return lineage.paired(pairs, events, candidates, ["document_id"]).select("run_id", "cause_family", "semantic_class", F.col("base_document_id").alias("base_document"), F.col("cf_document_id").alias("cf_document"))


@query("""WITH x AS (SELECT o_custkey AS unit, extract(year FROM o_orderdate) AS y, count(*) AS v FROM orders GROUP BY ALL), k AS (SELECT unit, y, v, lead(v) OVER (PARTITION BY unit ORDER BY y) AS n FROM x), u AS (SELECT unit, bool_and(coalesce(n >= v, TRUE)) AS ok FROM k GROUP BY unit)
SELECT c_nationkey AS nation, round(avg(ok::INT) + 1e-9, 6) AS monotone FROM u JOIN customer ON c_custkey = unit GROUP BY ALL""")
def monotone_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of customers whose number of orders never falls from one year to the next."""
    x = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("v"))
    x = x.join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("nation")), "c_custkey")
    return _rounded(statistics.monotone_share(x, "c_custkey", "y", "v", ["nation"]), "monotone")


@query(r"""SELECT doc_id, text, source FROM documents WHERE lang IN ('en', 'de') ORDER BY doc_id LIMIT 50""")
def listed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty documents of a split: the limit is what is asked for."""
    return lineage.listed(table(spark, sf_dir, "documents"), "lang", ("en", "de"), "doc_id", 50).select("doc_id", "text", "source")


@query(derived.SQL + """SELECT doc, count(*) AS n_gold, count(*) FILTER (r IN ('RNO', 'RAF')) AS eligible, count(*) FILTER (r NOT IN ('RNO', 'RAF')) AS excluded FROM g GROUP BY doc""")
def eligible_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold edges whose relation the base schema has, and how many fall out."""
    schema = spark.createDataFrame([("RNO",), ("RAF",)], "r string")
    return lineage.eligible(derived.gold(spark, sf_dir), schema, "r", ["doc"])


@query("""SELECT count(*) AS events, count(DISTINCT user_id) AS documents, coalesce(sum(value), 0.0)::DECIMAL(38, 2)::DOUBLE AS total, round(coalesce(avg(value), 0.0) + 1e-9, 6) AS mean, count(*) FILTER (event_type LIKE 'p%') AS matching FROM events""")
def manifest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("documents"), F.coalesce(F.sum("value"), F.lit(0.0)).cast("decimal(38,2)").cast("double").alias("total"), F.round(F.coalesce(F.avg("value"), F.lit(0.0)) + 1e-9, 6).alias("mean"), F.count_if(F.col("event_type").like("p%")).alias("matching"))


@query(CANONICAL + f""", mx AS (SELECT round(base_recall, 9) AS a, round(recall, 9) AS b, (round(abs(round(base_recall, 9) - round(recall, 9)), 9) > 0.2)::INT::DOUBLE AS over FROM recall WHERE family = 'model'),
mc AS (SELECT '' AS grp, (over * 1000000)::BIGINT::VARCHAR AS cell, count(*) AS n, sum(over) AS s FROM mx GROUP BY over), {resampling.multinomial("mc", 60, "mw")}, mm AS (SELECT r, sum(w * s / n) / sum(w) AS m FROM mw JOIN mc USING (grp, cell, n) GROUP BY r), ms AS (SELECT list_sort(list(m)) AS m FROM mm)
SELECT (SELECT count(*) FROM mx) AS n, (SELECT round(avg(a) + 1e-9, 6) FROM mx) AS base_recall, (SELECT round(avg(b) + 1e-9, 6) FROM mx) AS recall, (SELECT round(avg(abs(a - b)) + 1e-9, 6) FROM mx) AS difference, (SELECT round(avg(over) + 1e-9, 6) FROM mx) AS share, round(m[2] + 1e-9, 6) AS low, round(m[59] + 1e-9, 6) AS high,
CASE WHEN m[2] > 0.2 THEN 'VIOLATED' WHEN m[59] < 0.2 THEN 'SATISFIED' ELSE 'INCONCLUSIVE' END AS verdict FROM ms""")
def cross_model_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold recall of two models on the documents of both: how often it differs by more than 0.2, with a resampled interval and its verdict."""
    k = derived.FAMILIES.index("model")
    model = F.when(views.has(views.bit(k)), views.bit(0)).otherwise(0).cast("long").bitwiseOR(F.col("mask").bitwiseAND(F.lit(views.BASE)))
    asked = derived.edges(spark, sf_dir).where(F.col("gold") | F.col("r").isin(*derived.RENAMED)).withColumn("mask", model)
    own = asked.where("gold or mask <> 0").withColumn("r", derived.own_name(F.col("r"))).groupBy("doc", "s", "r", "o").agg(F.bit_or("mask").alias("mask"), F.max("gold").alias("gold"))
    both = views.marked_recall(derived.documents(spark, sf_dir), own, ("model",)).withColumns({"a": F.round("base_recall", 9), "b": F.round("recall", 9)})
    both = written(both.select("a", "b", (F.round(F.abs(F.col("a") - F.col("b")), 9) > 0.2).alias("over")), "recalls")
    means = both.agg(F.round(F.avg("a") + 1e-9, 6).alias("base_recall"), F.round(F.avg("b") + 1e-9, 6).alias("recall"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))) + 1e-9, 6).alias("difference"))
    found = statistics.proportion_verdict(both, "over", 0.2, 60)
    return _rounded(found.crossJoin(means), "share", "low", "high")  # one row each


@query("""WITH r AS (SELECT user_id % 10 AS corpus, CASE event_id % 7 WHEN 0 THEN 'parse_error' WHEN 1 THEN 'api_error' ELSE 'ok' END AS status, event_type AS family, value / 1000 AS drift FROM events)
SELECT corpus, family, count(*) AS attempted, count(*) FILTER (status = 'ok') AS valid, count(*) FILTER (status = 'parse_error') AS parse_failures, count(*) FILTER (status = 'api_error') AS other_failures, round(avg(drift) FILTER (status = 'ok') + 1e-9, 6) AS mean_drift,
round(quantile_cont(drift, 0.5) FILTER (status = 'ok') + 1e-9, 6) AS median_drift, round(avg(CASE WHEN status = 'ok' THEN drift ELSE 1.0 END) + 1e-9, 6) AS failure_as_harm FROM r GROUP BY ALL""")
def magnitude_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 7
    rows = table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("corpus"), F.when(k == 0, "parse_error").when(k == 1, "api_error").otherwise("ok").alias("status"), F.col("event_type").alias("family"), (F.col("value") / 1000).alias("drift"))
    return _rounded(statistics.cell_summary(rows, ["corpus", "family"]), "mean_drift", "median_drift", "failure_as_harm")


@query("""SELECT l_partkey AS part, count(DISTINCT o_custkey) AS n_documents, count(DISTINCT l_suppkey) AS n_tails FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING count(DISTINCT o_custkey) >= 2""")
def shared_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads that two documents or more have, with how many and how many tails."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey).groupBy(F.col("l_partkey").alias("part")).agg(F.count_distinct("o_custkey").alias("n_documents"), F.count_distinct("l_suppkey").alias("n_tails")).where("n_documents >= 2")


@query("""WITH m AS (SELECT l_orderkey AS run_id, arg_min('ev' || l_suppkey, l_linenumber * 100000 + l_suppkey) AS event FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey), k AS (SELECT * FROM (VALUES ('1-URGENT', 'schema'), ('2-HIGH', 'prompt')) t(kind, family))
SELECT o_orderkey AS run_id, 'c' || o_custkey AS document_id, 'base' || o_custkey AS base_event_id, coalesce(event, 'own' || o_orderkey) AS cf_event_id, coalesce(family, 'unknown') AS cause_family FROM orders LEFT JOIN m ON run_id = o_orderkey LEFT JOIN k ON kind = o_orderpriority WHERE o_orderstatus = 'F'""")
def loaded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished orders as successful runs; the event of a run's first matched edge comes before the recorded one."""
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    text = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    runs = o.select(F.col("o_orderkey").alias("run_id"), text("c", "o_custkey").alias("document_id"), text("base", "o_custkey").alias("base_event_id"), text("own", "o_orderkey").alias("cf_event_id"), F.col("o_orderpriority").alias("intervention_id"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed").alias("status"))
    outcomes = l.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") != "N", F.concat_ws("::", text("ev", "l_suppkey"), F.lit("x"))).alias("matched_edge_id"), (F.col("l_linenumber") * 100_000 + F.col("l_suppkey")).alias("ordinal"))
    candidates = spark.createDataFrame([("1-URGENT", "schema"), ("2-HIGH", "prompt")], "intervention_id string, cause_family string")
    none = spark.createDataFrame([], "event_id string, document_id string, subject_entity_id string, relation string, object_entity_id string, head_entity_id string, relation_base string, tail_entity_id string")
    return lineage.load(runs, none, none, outcomes, candidates)[0]


@query(derived.SQL + """, x AS (SELECT family, doc, s, r, o, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, s, r, o, 1 AS b, 0 AS c FROM p JOIN b q ON q.doc = p.doc UNION ALL SELECT family, doc, s, r, o, 0, 1 FROM c) GROUP BY ALL)
SELECT p.family || ':' || p.doc AS run_id, round(coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) + 1e-9, 6) AS jaccard FROM p LEFT JOIN x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc""")
def run_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge Jaccard of every run of a lineage in rows of (event, edge), two views to a key."""
    edges = views.long_form(derived.elements(spark, sf_dir), derived.FAMILIES, "base").select(F.col("doc").alias("at"), F.concat_ws(":", "family", "doc").alias("event_id"), "s", "r", "o")
    runs = derived.documents(spark, sf_dir).select("doc", F.explode(F.array(*map(F.lit, derived.FAMILIES))).alias("family")).select(F.col("doc").alias("at"), F.concat_ws(":", "family", "doc").alias("run_id"), F.concat_ws(":", F.lit("base"), "doc").alias("base_event_id"), F.concat_ws(":", "family", "doc").alias("cf_event_id"))
    docs, elements, families, index = views.indexed(runs, edges, slots=2, within="at", buckets=(derived.buckets(spark, sf_dir)[0], "at"))
    return _rounded(views.per_run(views.jaccard(docs, elements, families), index), "jaccard")


@query("""WITH d AS (SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || coalesce(text, ''), chr(10) ORDER BY turn, role, text) AS body FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, 'Rules:' || chr(10) || '- be exact' || chr(10) || '- cite' || chr(10) || chr(10) || body || chr(10) || '{clauses}?' AS prompt FROM d)
SELECT conv_id, sha256(prompt) AS prompt, sha256('m=m1|t=0.0|s=7' || chr(10) || prompt) AS cache_key FROM p""")
def rendered_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of a prompt, with the keys under which responses would be kept."""
    t = table(spark, sf_dir, "conversations").select("conv_id", F.struct(F.col("turn").alias("sentence_index"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("s"))
    d = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    clauses = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(x).alias("text")) for i, x in (("C1", "be exact"), ("C2", "hidden"), ("C3", "cite"))))
    prompt = prompts.filled(F.lit("Rules:\n{clauses}\n\n{document}\n{other}"), clauses=prompts.clauses_text(clauses, ("C1", "C3")), document=prompts.document_text(F.col("s")), other=F.lit("{clauses}?"))
    return d.withColumn("p", prompt).select("conv_id", F.sha2("p", 256).alias("prompt"), prompts.cache_key(F.lit("m1"), F.lit(0.0), F.lit(7), F.col("p")).alias("cache_key"))
