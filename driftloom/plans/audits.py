"""Registered queries on inventories, inputs, diagnostics, output modes, publication policies and budgets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import diagnostics, inputs, interventions, inventory, lineage, modes, policies, statistics
from driftloom.sources.store import written

from . import derived, resampling
from .derived import table
from .evaluation import GATE, LABELS, _drifts, scored_labels
from .graph import UNDIRECTED
from .registry import query


@query("""WITH q AS (SELECT DISTINCT l_orderkey AS run, l_returnflag AS family, l_partkey AS query_id FROM lineitem), l AS (SELECT l_orderkey AS run, l_returnflag AS family, l_partkey AS query_id, l_linenumber AS k FROM lineitem),
rg AS (SELECT run, family, query_id + (run % 13 = 0 AND k = 1)::INT AS query_id FROM l WHERE run % 17 > 0 OR k <> 2 UNION ALL SELECT run, family, query_id FROM l WHERE run % 19 = 0 AND k = 3),
de AS (SELECT run, family, true AS eligible, count(DISTINCT query_id) + (run % 23 = 0)::INT AS n FROM l WHERE run % 29 > 0 GROUP BY run, family UNION ALL SELECT DISTINCT run, 'Z', run % 31 = 0, 0 FROM l),
rb AS (SELECT run, family, count(*) AS b FROM q GROUP BY ALL), rr AS (SELECT run, family, count(*) AS r, count(DISTINCT query_id) AS d, count(DISTINCT query_id) FILTER ((run, family, query_id) IN (SELECT (run, family, query_id) FROM q)) AS c FROM rg GROUP BY ALL),
k AS (SELECT run, family FROM rb UNION SELECT run, family FROM rr UNION SELECT run, family FROM de), j AS (SELECT k.run, k.family, eligible, n, coalesce(r, 0) AS r, coalesce(d, 0) AS d, coalesce(b, 0) AS b, coalesce(c, 0) AS c FROM k LEFT JOIN de USING (run, family) LEFT JOIN rr USING (run, family) LEFT JOIN rb USING (run, family))
SELECT run, family, n AS n_declared, r::BIGINT AS n_registered, b AS n_rebuilt, c AS n_common, CASE WHEN eligible IS NULL AND b > 0 THEN 'unregistered' WHEN eligible IS NULL THEN 'unknown' WHEN eligible <> (b > 0) THEN 'eligibility' WHEN n <> b THEN 'count' WHEN r <> d THEN 'duplicate' WHEN c <> b OR c <> d THEN 'inventory' END AS reason FROM j""")
def query_inventory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs and their parts as queries: what was registered, with faults of every kind, against what is rebuilt."""
    run, k, q = F.col("run"), F.col("k"), F.col("query_id")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_returnflag").alias("family"), F.col("l_partkey").alias("query_id"), F.col("l_linenumber").alias("k"))
    wrong = lines.where((run % 17 > 0) | (k != 2)).select("run", "family", (q + F.when((run % 13 == 0) & (k == 1), 1).otherwise(0)).alias("query_id"))
    twice = lines.where((run % 19 == 0) & (k == 3)).select("run", "family", "query_id")
    said = lines.where(run % 29 > 0).groupBy("run", "family").agg(F.count_distinct("query_id").alias("n")).select("run", "family", F.lit(True).alias("eligible"), (F.col("n") + F.when(run % 23 == 0, 1).otherwise(0)).alias("n_queries"))
    none = lines.select("run").distinct().select("run", F.lit("Z").alias("family"), (run % 31 == 0).alias("eligible"), F.lit(0).cast("long").alias("n_queries"))
    return inventory.query_inventory(said.unionByName(none), wrong.unionByName(twice), lines.select("run", "family", "query_id").distinct(), ["run", "family"], "query_id")


@query("""WITH e AS (SELECT l_orderkey AS event_id, CASE WHEN l_returnflag <> 'A' THEN l_suppkey END AS s, l_linestatus AS r, CASE WHEN l_linenumber % 4 > 0 THEN l_partkey % 50 END AS o FROM lineitem), ev AS (SELECT o_orderkey AS event_id FROM orders WHERE o_orderkey % 11 > 0),
pe AS (SELECT event_id, count(*) AS a, count(*) FILTER (s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL) AS l, count(DISTINCT (s, r, o)) FILTER (s IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL) AS t FROM e GROUP BY ALL),
cn AS (SELECT event_id, coalesce(a, 0) AS a, coalesce(l, 0) AS l, coalesce(t, 0) AS t FROM ev LEFT JOIN pe USING (event_id)),
sd AS (SELECT o_orderkey AS event_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL),
rn AS (SELECT o_custkey || ':' || o_orderkey AS run_id, min(o_orderkey) OVER (PARTITION BY o_custkey) AS b, o_orderkey AS c FROM orders), en AS (SELECT run_id, 'base' AS side, b AS event_id FROM rn UNION ALL SELECT run_id, 'cf', c FROM rn)
SELECT run_id, side, en.event_id, CASE WHEN cn.event_id IS NULL THEN 'missing_event' WHEN cn.a <> sd.n OR cn.l <> sd.n OR cn.t <> sd.n THEN 'edge_counts' END AS reason FROM en LEFT JOIN cn ON cn.event_id = en.event_id LEFT JOIN sd ON sd.event_id = en.event_id""")
def edge_inventory_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's first order as base event of its orders; registered are as many typed edges as an order has lines, which holds for some."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    edges = l.select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") != "A", F.col("l_suppkey")).alias("s"), F.col("l_linestatus").alias("r"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_partkey") % 50).alias("o"))
    events = o.where(F.col("o_orderkey") % 11 > 0).select(F.col("o_orderkey").alias("event_id"))
    n = o.select("o_orderkey").join(l.groupBy("l_orderkey").agg(F.count("*").alias("n")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    counts = lambda side: F.struct(F.col(f"n_{side}").alias("all_rows"), F.col(f"n_{side}").alias("linked_rows"), F.col(f"n_{side}").alias("typed_edges"), F.lit(0).cast("long").alias("unlinked_rows")).alias(f"{side}_counts")
    firsts = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("base_event_id"))
    runs = o.select("o_custkey", F.col("o_orderkey").alias("cf_event_id")).join(firsts, "o_custkey")
    for side in ("base", "cf"):
        runs = runs.join(n.select(F.col("o_orderkey").alias(f"{side}_event_id"), F.col("n").alias(f"n_{side}")), f"{side}_event_id")
    pairs = runs.select(F.concat_ws(":", F.col("o_custkey").cast("string"), F.col("cf_event_id").cast("string")).alias("run_id"), "base_event_id", "cf_event_id", counts("base"), counts("cf"))
    return inventory.edge_inventory(pairs, events, edges)


CONDITIONS = ["base", "c1", "c2", "c3"]
#: Records of two modes on a grid of documents (users) and conditions; the second mode fails less often.
MODES = """WITH ev AS (SELECT user_id % 20 AS corpus, user_id AS doc, ['base', 'c1', 'c2', 'c3'][event_id % 4 + 1] AS condition, ts, event_id FROM events),
rc AS (SELECT *, 'native' AS mode, CASE WHEN event_id % (2 + corpus * 3) > 0 THEN event_id % 3 END AS n_edges FROM ev UNION ALL SELECT *, 'json_object', CASE WHEN event_id % (5 + corpus * 3) > 0 THEN event_id % 3 END FROM ev),
ce AS MATERIALIZED (SELECT corpus, mode, doc, condition, x.n IS NOT NULL AS parsed, coalesce(x.n > 0, false) AS filled FROM (SELECT corpus, mode, doc, condition, arg_max({'n': n_edges}, (ts, event_id)) AS x FROM rc GROUP BY ALL)),
dc AS (SELECT corpus, count(DISTINCT doc) AS d FROM ce GROUP BY corpus), ba AS (SELECT corpus, mode, doc, parsed AS bp, filled AS bf FROM ce WHERE condition = 'base'),
co AS (SELECT corpus, mode, condition, count(*) AS n, count(*) FILTER (parsed) AS s, count(*) FILTER (condition <> 'base' AND parsed AND coalesce(bp, false)) AS p, count(*) FILTER (condition <> 'base' AND parsed AND coalesce(bp, false) AND (filled OR bf)) AS e FROM ce LEFT JOIN ba USING (corpus, mode, doc) GROUP BY ALL),
fu AS (SELECT corpus, mode, condition, coalesce(n, 0) AS n, coalesce(s, 0) AS s, coalesce(p, 0) AS p, coalesce(e, 0) AS e FROM (SELECT corpus, mode, condition FROM (SELECT DISTINCT corpus, mode FROM ce), (SELECT unnest(['base', 'c1', 'c2', 'c3']) AS condition)) LEFT JOIN co USING (corpus, mode, condition)),
re AS (SELECT corpus, mode, d, sum(n)::BIGINT AS attempted, sum(s)::BIGINT AS parsed, sum(p)::BIGINT AS parse_pairs, sum(e)::BIGINT AS evaluable_pairs, sum(n) = 4 * d AND sum(s) * 10 >= d * 36 AND sum(p) * 10 >= d * 27 AND sum(e) * 10 >= d * 24 AND bool_and(s * 10 >= d * CASE WHEN condition = 'base' THEN 9 ELSE 8 END) AND bool_and(condition = 'base' OR p * 10 >= d * 8 AND e * 10 >= d * 7) AS qualified FROM fu JOIN dc USING (corpus) GROUP BY corpus, mode, d)
"""
FLOORS = modes.Floors(endpoints=36, parse_pairs=27, evaluable_pairs=24, improvement=4)


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, corpus = F.col("event_id"), F.col("corpus")
    ev = table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("corpus"), F.col("user_id").alias("doc"), F.element_at(F.array(*map(F.lit, CONDITIONS)), (k % 4 + 1).cast("int")).alias("condition"), "ts", "event_id")
    tried = lambda mode, first: ev.select("*", F.lit(mode).alias("mode"), F.when(k % (first + corpus * 3) > 0, k % 3).alias("n_edges"))
    return modes.cells(tried("native", 2).unionByName(tried("json_object", 5)), ["corpus"], ["native", "json_object"], CONDITIONS, ["ts", "event_id"])


@query(MODES + "SELECT corpus, mode, d AS documents, attempted, parsed, parse_pairs, evaluable_pairs, qualified FROM re")
def mode_qualification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two output modes reach on each corpus' grid of documents and conditions."""
    return modes.mode_report(_modes(spark, sf_dir), ["corpus"], CONDITIONS, FLOORS).drop("by_condition")


@query(MODES + """, pr AS (SELECT corpus, doc, condition, bool_or(parsed) FILTER (mode = 'native') AS a, bool_or(parsed) FILTER (mode = 'json_object') AS b FROM ce GROUP BY ALL), mc AS (SELECT corpus, count(*) AS m, count(*) FILTER (b AND NOT a) AS so, count(*) FILTER (a AND NOT b) AS fo FROM pr WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY corpus),
tl AS (SELECT corpus, m, so, fo, CASE WHEN so = 0 THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(so, so + fo + 1), lambda i: exp(lgamma(so + fo + 1.0) - lgamma(i + 1.0) - lgamma(so + fo - i + 1.0) - (so + fo) * ln(2.0))))) END AS p FROM mc),
wi AS (SELECT corpus, any_value(d) AS d, bool_or(qualified) FILTER (mode = 'native') AS fq, bool_or(qualified) FILTER (mode = 'json_object') AS sq, (max(parsed) FILTER (mode = 'json_object') - max(parsed) FILTER (mode = 'native')) AS im FROM re GROUP BY corpus)
SELECT corpus, d AS documents, fq AS first_qualified, sq AS second_qualified, m AS common_cells, so AS second_only, fo AS first_only, round(p, 6) AS p, im AS improvement, CASE WHEN fq THEN 'native' WHEN sq AND im * 10 >= d * 4 AND p < 0.05 THEN 'json_object' END AS mode FROM wi JOIN tl USING (corpus)""")
def mode_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mode that each corpus uses, with its paired test."""
    return modes.select_mode(_modes(spark, sf_dir), ["corpus"], CONDITIONS, "native", "json_object", FLOORS).withColumn("p", F.round("p", 6))


@query(f"""{GATE}, z AS MATERIALIZED (SELECT 'c' || doc % 3 AS corpus, doc, qd > 0.25 AS harmful, 1 - qd AS fidelity, gd >= 0.2 AS bg, gd >= 0.2 OR qd >= 0.3 AS bj, row_number() OVER (PARTITION BY doc % 3 ORDER BY sha256('random|' || family || ':' || doc)) AS k, count(*) FILTER (gd >= 0.2 OR qd >= 0.3) OVER (PARTITION BY doc % 3) AS m FROM y),
d AS MATERIALIZED (SELECT corpus, 'publish_all' AS policy, doc, harmful, fidelity, false AS blocked FROM z UNION ALL SELECT corpus, 'graph_only', doc, harmful, fidelity, bg FROM z UNION ALL SELECT corpus, 'joint', doc, harmful, fidelity, bj FROM z UNION ALL SELECT corpus, 'random', doc, harmful, fidelity, k <= m FROM z),
cl AS (SELECT corpus || '|' || policy AS grp, doc, count(*) AS m, count(*) FILTER (harmful) AS h, sum(fidelity) AS f FROM d WHERE NOT blocked GROUP BY ALL), ce AS MATERIALIZED (SELECT grp, m || '/' || h || '/' || round(f * 1000000)::BIGINT AS cell, count(*) AS n, sum(m) AS m, sum(h) AS h, sum(f) AS f FROM cl GROUP BY grp, cell),
{resampling.multinomial("ce", 40, "pw")}, me AS (SELECT pw.grp, r, sum(w * h / pw.n) / sum(w * m / pw.n) AS h, sum(w * f / pw.n) / sum(w * m / pw.n) AS f FROM pw JOIN ce ON ce.grp = pw.grp AND ce.cell = pw.cell GROUP BY pw.grp, r), en AS (SELECT grp, quantile_cont(h, 0.025) AS hl, quantile_cont(h, 0.975) AS hh, quantile_cont(f, 0.025) AS fl, quantile_cont(f, 0.975) AS fh FROM me GROUP BY grp)
SELECT corpus, policy, count(*) AS n, round(count(*) FILTER (NOT blocked) / count(*)::DOUBLE + 1e-9, 6) AS published, round(coalesce(count(*) FILTER (blocked AND harmful) / nullif(count(*) FILTER (harmful), 0)::DOUBLE, 0) + 1e-9, 6) AS harm_recall, round(coalesce(count(*) FILTER (blocked AND harmful) / nullif(count(*) FILTER (blocked), 0)::DOUBLE, 0) + 1e-9, 6) AS harm_precision,
round(coalesce(count(*) FILTER (blocked AND NOT harmful) / nullif(count(*) FILTER (NOT harmful), 0)::DOUBLE, 0) + 1e-9, 6) AS false_block, round(coalesce(count(*) FILTER (NOT blocked AND harmful) / nullif(count(*) FILTER (NOT blocked), 0)::DOUBLE, 0) + 1e-9, 6) AS published_harm, round(coalesce(avg(fidelity) FILTER (NOT blocked), 0) + 1e-9, 6) AS published_fidelity,
round(coalesce(any_value(hl), 0) + 1e-9, 6) AS harm_low, round(coalesce(any_value(hh), 0) + 1e-9, 6) AS harm_high, round(coalesce(any_value(fl), 0) + 1e-9, 6) AS fidelity_low, round(coalesce(any_value(fh), 0) + 1e-9, 6) AS fidelity_high FROM d LEFT JOIN en ON grp = corpus || '|' || policy GROUP BY corpus, policy""")
def gate_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four publication policies on all pairs of three corpora, with intervals over documents."""
    pairs = _drifts(spark, sf_dir).select("family", "doc", F.col("gd").alias("graph_drift"), F.col("qd").alias("query_drift"), F.concat(F.lit("c"), (F.col("doc") % 3).cast("string")).alias("corpus"), F.concat_ws(":", "family", F.col("doc").cast("string")).alias("run_id"), (F.col("qd") > 0.25).alias("harmful"), (1 - F.col("qd")).alias("fidelity"))
    decided = policies.decisions(pairs, ["corpus"], "run_id", graph_limit=0.2, query_limit=0.3)
    found = policies.policy_report(decided, ["corpus"], "doc", 40)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in found.columns if c not in ("corpus", "policy", "n")})


@query(f"""{GATE}, z AS MATERIALIZED (SELECT family, family || ':' || doc AS rid, qd > 0.25 AS h FROM y), sp AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY sha256('half|' || rid)) <= (SELECT count(*) // 2 FROM z) AS calib FROM z), pr AS (SELECT family, count(*) FILTER (h) / count(*)::DOUBLE AS prior FROM sp WHERE calib GROUP BY family),
rs AS MATERIALIZED (SELECT family, rid, h, coalesce(round(prior, 12), 0) AS prior, sha256('draw|' || rid) AS x FROM sp LEFT JOIN pr USING (family) WHERE NOT calib), n AS (SELECT count(*) AS a, count(*) FILTER (h) AS hs FROM rs), kk AS (SELECT pm, greatest(1, round_even(a * pm / 1000.0::DOUBLE, 0)::BIGINT) AS k, hs FROM n, (SELECT unnest([50, 100, 200, 500]) AS pm)),
fs AS (SELECT family, count(*) AS s FROM rs GROUP BY family), tt AS (SELECT pm, max(t) AS t FROM (SELECT pm, k, t, sum(least(s, t)) AS g FROM kk, (SELECT unnest(range(0, (SELECT max(s) FROM fs) + 1)) AS t), fs GROUP BY pm, k, t) WHERE g <= k GROUP BY pm),
qu AS (SELECT pm, family, least(s, t) + (s > t AND row_number() OVER (PARTITION BY pm ORDER BY s > t DESC, sha256(family)) <= k - sum(least(s, t)) OVER (PARTITION BY pm))::INT AS q FROM kk JOIN tt USING (pm), fs),
o AS (SELECT 'random' AS plan, h, row_number() OVER (ORDER BY x) AS i FROM rs UNION ALL SELECT 'greedy', h, row_number() OVER (ORDER BY prior DESC, x) FROM rs UNION ALL SELECT 'oracle', h, row_number() OVER (ORDER BY h DESC, x) FROM rs),
hf AS (SELECT plan, pm, count(*) FILTER (h AND i <= k) AS g FROM o, kk GROUP BY ALL UNION ALL SELECT 'family_balanced', pm, count(*) FILTER (h AND i <= q) FROM qu JOIN (SELECT family, h, row_number() OVER (PARTITION BY family ORDER BY x) AS i FROM rs) USING (family) GROUP BY pm)
SELECT plan, pm AS permille, k AS selected, g AS recovered, round(CASE WHEN hs > 0 THEN g / hs::DOUBLE ELSE 0.0 END, 6) AS share FROM hf JOIN kk USING (pm)""")
def harm_recovery_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The harm that four plans find within budgets of 5, 10, 20 and 50 % of the pairs that did not calibrate."""
    pairs = _drifts(spark, sf_dir).select(F.concat_ws(":", "family", F.col("doc").cast("string")).alias("run_id"), "family", (F.col("qd") > 0.25).alias("harmful"))
    return policies.harm_recovery(pairs, (50, 100, 200, 500)).withColumn("share", F.round("share", 6))


@query()
def budgeted_selectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three selectors on the lines of each order priority, within a cost of 5000; what fits depends on what was taken, so there is no SQL."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    pairs = l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_orderpriority").alias("stream"), F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("run_id"), F.col("l_returnflag").alias("family"), F.col("l_quantity").cast("double").alias("cost"), F.col("l_discount").cast("double").alias("graph_drift"))
    found = [policies.selected_pairs(pairs, s, 5000.0).withColumn("selector", F.lit(s)) for s in policies.SELECTORS]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("""WITH p AS (SELECT o_orderkey AS run, 'n' || o_custkey % 25 AS doc, 'e' || o_custkey AS b, 'e' || (o_custkey + o_orderkey % 4 * 25) AS c FROM orders UNION ALL SELECT o_orderkey, 'n0', 'e0', '' FROM orders WHERE o_orderkey % 41 = 0),
e AS (SELECT 'e' || c_custkey AS id, 'n' || (c_custkey % 25 + (c_custkey % 37 = 0)::INT) AS d FROM customer), wi AS (SELECT l_orderkey AS run, CASE WHEN l_partkey % 53 > 0 THEN 'e' || (o_custkey + o_orderkey % 4 * 25 + (l_suppkey % 13 = 0)::INT) END AS ev FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'),
one AS (SELECT run, count(*) AS n, arg_min({'doc': doc, 'b': b, 'c': c}, (b, c)) AS x FROM p GROUP BY run), sw AS (SELECT run, count(*) FILTER (ev IS NULL) AS lost, count(*) FILTER (ev <> x.c) AS other FROM wi JOIN one USING (run) GROUP BY run)
SELECT run AS run_id, CASE WHEN n > 1 THEN 'repeated_run' WHEN eb.id IS NULL THEN 'missing_base' WHEN ec.id IS NULL THEN 'missing_counterfactual' WHEN x.b = x.c THEN 'same_endpoint' WHEN eb.d <> x.doc THEN 'base_elsewhere' WHEN ec.d <> x.doc THEN 'counterfactual_elsewhere' WHEN lost > 0 THEN 'witness_missing' WHEN other > 0 THEN 'witness_elsewhere' END AS reason, lost IS NOT NULL AS witnessed
FROM one LEFT JOIN e eb ON eb.id = x.b LEFT JOIN e ec ON ec.id = x.c LEFT JOIN sw USING (run)""")
def authority_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs of customers' events, returned lines as witnesses; faults of every kind."""
    l, o, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    name = lambda prefix, x: F.concat(F.lit(prefix), x.cast("string"))
    cf = cust + key % 4 * 25
    pairs = o.select(key.alias("run_id"), name("n", cust % 25).alias("document_id"), name("e", cust).alias("base_event_id"), name("e", cf).alias("cf_event_id"))
    twice = o.where(key % 41 == 0).select(key.alias("run_id"), F.lit("n0").alias("document_id"), F.lit("e0").alias("base_event_id"), F.lit("").alias("cf_event_id"))
    events = c.select(name("e", F.col("c_custkey")).alias("event_id"), name("n", F.col("c_custkey") % 25 + F.when(F.col("c_custkey") % 37 == 0, 1).otherwise(0)).alias("document_id"))
    witnesses = l.where("l_returnflag = 'R'").join(o, l.l_orderkey == o.o_orderkey).select(key.alias("run_id"), F.lit("x").alias("matched_edge_id"), F.when(F.col("l_partkey") % 53 > 0, name("e", cf + F.when(F.col("l_suppkey") % 13 == 0, 1).otherwise(0))).alias("event_id"))
    return lineage.authority_audit(pairs.unionByName(twice), events, witnesses)


@query(LABELS + """, m AS (SELECT lang, max(score) AS mx FROM t GROUP BY lang), s AS (SELECT lang, score / mx AS score, toxic FROM t JOIN m USING (lang))
SELECT lang, g.i AS step, round(g.i / 200.0::DOUBLE, 6) AS threshold, round(count(*) FILTER (score < g.i / 200.0::DOUBLE) / count(*)::DOUBLE, 6) AS coverage, round(coalesce(sum(toxic) FILTER (score < g.i / 200.0::DOUBLE) / nullif(count(*) FILTER (score < g.i / 200.0::DOUBLE), 0)::DOUBLE, 0), 6) AS risk FROM s, (SELECT unnest(range(0, 201))::INT AS i) g GROUP BY ALL""")
def gate_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage and harm of gates at 201 thresholds of the relative length."""
    rows = scored_labels(spark, sf_dir)
    rows = rows.join(rows.groupBy("lang").agg(F.max("score").alias("_m")), "lang").withColumn("score", F.col("score") / F.col("_m"))
    return statistics.gate_grid(rows, ["lang"], "score", "toxic").withColumns({c: F.round(c, 6) for c in ("threshold", "coverage", "risk")})


@query(LABELS + """, p AS (SELECT lang, score, count(*) AS n, sum(toxic) AS h FROM t GROUP BY ALL), c AS (SELECT lang, sum(n) OVER w / sum(n) OVER (PARTITION BY lang)::DOUBLE AS coverage, sum(h) OVER w / sum(n) OVER w::DOUBLE AS risk FROM p WINDOW w AS (PARTITION BY lang ORDER BY score))
SELECT lang, round(coalesce(max(coverage) FILTER (risk <= 0.1), 0), 6) AS coverage FROM c GROUP BY lang""")
def strict_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that is published with at most a tenth toxic."""
    return statistics.strict_coverage(statistics.risk_coverage(scored_labels(spark, sf_dir), ["lang"], "score", "toxic"), ["lang"], 0.1).withColumn("coverage", F.round("coverage", 6))


#: Answers of the five diagnostic queries on all views, and per pair the drift of each.
DIAGNOSED = derived.SQL + f""", {UNDIRECTED}, nd AS (SELECT family, doc, s AS node FROM v UNION SELECT family, doc, o FROM v), dg AS (SELECT nd.family, nd.doc, node, count(u.a) AS degree FROM nd LEFT JOIN u ON u.family = nd.family AND u.doc = nd.doc AND u.a = nd.node GROUP BY ALL),
an AS MATERIALIZED (SELECT 'diagnostic.edge_identity' AS query, family, doc, s || '|' || r || '|' || o AS k FROM v
UNION ALL SELECT DISTINCT 'diagnostic.two_hop_endpoints', x.family, x.doc, x.s || '|' || y.o FROM v x JOIN v y ON y.family = x.family AND y.doc = x.doc AND y.s = x.o WHERE x.s <> y.o
UNION ALL SELECT 'diagnostic.fanout_join', x.family, x.doc, concat_ws('|', x.s, x.r, x.o, y.r, y.o) FROM v x JOIN v y ON y.family = x.family AND y.doc = x.doc AND y.s = x.s AND x.r < y.r
UNION ALL SELECT 'diagnostic.top_undirected_degree', family, doc, node FROM (SELECT *, row_number() OVER (PARTITION BY family, doc ORDER BY degree DESC, node) AS rank FROM dg) WHERE rank <= 5
UNION ALL SELECT 'diagnostic.short_connectivity', family, doc, a || '|' || z FROM (SELECT family, doc, a, z FROM u UNION SELECT x.family, x.doc, x.a, y.z FROM u x JOIN u y ON x.family = y.family AND x.doc = y.doc AND x.z = y.a WHERE x.a <> y.z) WHERE a < z),
sz AS (SELECT query, family, doc, count(*) AS n FROM an GROUP BY ALL), bo AS (SELECT x.query, y.family, x.doc, count(*) AS n FROM an x JOIN an y ON y.query = x.query AND y.doc = x.doc AND y.k = x.k WHERE x.family = 'base' AND y.family <> 'base' GROUP BY ALL),
dr AS MATERIALIZED (SELECT q.query, p.family, p.doc, 1 - coalesce(coalesce(bo.n, 0) / nullif(coalesce(sb.n, 0) + coalesce(sc.n, 0) - coalesce(bo.n, 0), 0)::DOUBLE, 1.0) AS d FROM p CROSS JOIN (SELECT DISTINCT query FROM an) q LEFT JOIN sz sb ON sb.query = q.query AND sb.family = 'base' AND sb.doc = p.doc LEFT JOIN sz sc ON sc.query = q.query AND sc.family = p.family AND sc.doc = p.doc LEFT JOIN bo ON bo.query = q.query AND bo.family = p.family AND bo.doc = p.doc),
rd AS MATERIALIZED (SELECT a.query, a.family, a.doc, CASE WHEN a.family IN ('stochastic', 'model') THEN 'none' ELSE 'presentation' END AS class, a.d AS qd, e.d AS gd, a.d / (e.d + 0.05) AS amp FROM dr a JOIN dr e ON e.query = 'diagnostic.edge_identity' AND e.family = a.family AND e.doc = a.doc)
"""


@query(DIAGNOSED + f""", cl AS (SELECT query AS grp, doc, count(*) AS m, sum(amp) AS s FROM rd GROUP BY ALL), ce AS MATERIALIZED (SELECT grp, m || '/' || round(s * 1000000)::BIGINT AS cell, count(*) AS n, sum(m) AS m, sum(s) AS s FROM cl GROUP BY grp, cell), {resampling.multinomial("ce", 30, "dw")},
me AS (SELECT dw.grp, r, sum(w * s / dw.n) / sum(w * m / dw.n) AS m FROM dw JOIN ce ON ce.grp = dw.grp AND ce.cell = dw.cell GROUP BY dw.grp, r), en AS (SELECT grp, quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM me GROUP BY grp),
gr AS (SELECT query, 'all' AS field, NULL AS part, qd, gd, amp, doc FROM rd UNION ALL SELECT query, 'cause_family', family, qd, gd, amp, doc FROM rd UNION ALL SELECT query, 'semantic_class', class, qd, gd, amp, doc FROM rd)
SELECT query, field, part, count(*) AS n, count(DISTINCT doc) AS n_documents, round(avg(qd) + 1e-9, 5) AS query_drift, round(avg(gd) + 1e-9, 5) AS graph_drift, round(avg(amp) + 1e-9, 5) AS amplification, round(avg(qd) / (avg(gd) + 0.05) + 1e-9, 5) AS ratio_of_means, round(any_value(low) FILTER (field = 'all') + 1e-9, 5) AS low, round(any_value(high) FILTER (field = 'all') + 1e-9, 5) AS high FROM gr LEFT JOIN en ON grp = query GROUP BY query, field, part""")
def diagnostic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the five diagnostic queries over all pairs, by family and by class."""
    records = diagnostics.diagnostic_records(*derived.args(spark, sf_dir))
    named = records.withColumnRenamed("family", "cause_family").withColumn("semantic_class", F.when(F.col("cause_family").isin("stochastic", "model"), "none").otherwise("presentation"))
    found = diagnostics.diagnostic_summary(written(named, "diagnosed"), 30)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 5) for c in ("query_drift", "graph_drift", "amplification", "ratio_of_means", "low", "high")})


#: Orders as documents whose parts are concepts; entities are local numbers. Some titles, counts, ends and runs are faulty.
MAPPED = """WITH ds AS (SELECT o_orderkey AS pos, 'd' || o_orderkey AS doc, CASE WHEN o_orderkey % 97 = 0 THEN 'x' WHEN o_orderkey % 5 = 0 THEN 'cdr_' || o_orderkey ELSE 't' || o_orderkey END AS title FROM orders),
pt AS (SELECT l_orderkey AS pos, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber)) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, min(l_returnflag) AS flag FROM lineitem GROUP BY l_orderkey, l_partkey), nn AS (SELECT pos, max(n) AS n FROM pt GROUP BY pos),
bad AS (SELECT ds.doc, CASE WHEN n IS NULL THEN 'missing' WHEN ds.pos % 97 = 0 THEN 'title' WHEN ds.pos % 101 = 0 THEN 'entity_count' END AS problem FROM ds LEFT JOIN nn USING (pos)),
mp AS MATERIALIZED (SELECT 'd' || pos AS doc, 'd' || pos || '::e' || (k - 1) AS ent, 'p' || part AS concept, 'n' || part % 7 AS name, flag AS type FROM pt JOIN bad ON bad.doc = 'd' || pos WHERE problem IS NULL),
nm AS (SELECT concept, 'd' AS k, doc AS v FROM mp UNION SELECT concept, 'n', name FROM mp UNION SELECT concept, 'n', 'a' || type FROM mp UNION SELECT concept, 't', type FROM mp), rg AS MATERIALIZED (SELECT concept, count(*) FILTER (k = 'd') AS n_documents, count(*) FILTER (k = 'n') AS n_names, count(*) FILTER (k = 't') AS n_types FROM nm GROUP BY concept)
"""


def _mapped(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    key, text = F.col("o_orderkey"), lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    title = F.when(key % 97 == 0, "x").when(key % 5 == 0, text("cdr_", key)).otherwise(text("t", key))
    parts = l.groupBy(F.col("l_orderkey").alias("position"), F.col("l_partkey").alias("part")).agg(F.min("l_linenumber").alias("first"), F.min("l_returnflag").alias("flag"))
    of = parts.groupBy("position").agg(F.sort_array(F.collect_list(F.struct("first", "part", "flag"))).alias("p"))  # an order's lines
    raw = of.select("position", F.when(F.col("position") % 5 > 0, text("t", F.col("position"))).alias("title"), F.transform("p", lambda x: text("p", x["part"])).alias("concepts"))
    each = of.select("position", F.posexplode("p").alias("k", "x")).where((F.col("position") % 101 > 0) | (F.col("k") > 0))
    doc = text("d", F.col("position"))
    entities = each.select(doc.alias("document_id"), F.concat(doc, F.lit("::e"), F.col("k").cast("string")).alias("entity_id"), text("n", F.col("x.part") % 7).alias("name"), F.array(F.concat(F.lit("a"), "x.flag")).alias("aliases"), F.col("x.flag").alias("type"))
    own = text("d", F.col("l_orderkey"))
    ends = [F.concat(own, F.lit("::e"), (F.col("l_linenumber") - i).cast("string")) for i in (1, 0)]
    edges = l.select(own.alias("document_id"), ends[0].alias("s"), F.when(F.col("l_linestatus") == "O", "r").otherwise("").alias("r"), ends[1].alias("o"), text("ev", F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("event_id"))
    runs = l.select(own.alias("document_id"), text("ev", F.col("l_orderkey") * 10 + F.col("l_linenumber") % 2).alias("base_event_id"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").cast("string").alias("run_id"), F.when(F.col("l_returnflag") == "N", "ok").otherwise("failed").alias("status"))
    return {"documents": o.select(key.alias("position"), text("d", key).alias("document_id"), title.alias("title")), "raw": raw, "entities": entities, "gold": edges.drop("event_id"), "runs": runs, "edges": edges}


@query(MAPPED + "SELECT concept, n_documents, n_names, n_types FROM rg")
def concept_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as global concepts: how many orders and names each has."""
    t = _mapped(spark, sf_dir)
    return inputs.concept_registry(inputs.concept_map(t["documents"], t["raw"], t["entities"])[0])


@query(MAPPED + """, ed AS (SELECT 'd' || l_orderkey AS doc, 'd' || l_orderkey || '::e' || (l_linenumber - 1) AS s, CASE WHEN l_linestatus = 'O' THEN 'r' ELSE '' END AS r, 'd' || l_orderkey || '::e' || l_linenumber AS o, l_orderkey * 10 + l_linenumber % 2 AS ev FROM lineitem),
be AS (SELECT 'd' || l_orderkey AS doc, arg_max(l_orderkey * 10 + l_linenumber % 2, (l_shipdate, l_linenumber)) AS ev FROM lineitem WHERE l_returnflag = 'N' GROUP BY l_orderkey), me AS MATERIALIZED (SELECT ed.*, a.concept IS NOT NULL AND b.concept IS NOT NULL AS whole, be.doc IS NOT NULL AS base FROM ed LEFT JOIN mp a ON a.ent = s LEFT JOIN mp b ON b.ent = ed.o LEFT JOIN be ON be.doc = ed.doc AND be.ev = ed.ev)
SELECT (SELECT count(*) FROM ds) AS n_documents, (SELECT count(*) FROM mp) AS n_entities, (SELECT count(*) FROM rg) AS n_concepts, (SELECT count(*) FROM rg WHERE n_documents > 1) AS n_repeated_concepts, (SELECT count(DISTINCT doc) FROM mp JOIN rg USING (concept) WHERE n_documents > 1) AS n_documents_with_repeated, (SELECT count(problem) FROM bad) AS n_problems,
(SELECT count(*) FROM ds WHERE doc NOT IN (SELECT doc FROM be)) AS n_without_base, (SELECT count(*) FROM me WHERE NOT whole) AS unmapped_gold, (SELECT count(*) FROM me WHERE base) AS base_edges, (SELECT count(*) FROM me WHERE base AND whole AND r <> '') AS mapped_base_edges, round((SELECT count(*) FILTER (whole AND r <> '') / count(*)::DOUBLE FROM me WHERE base), 6) AS mapping_rate""")
def mapping_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the orders' gold and base edges lies between concepts."""
    return inputs.map_inputs(**_mapped(spark, sf_dir))[3].withColumn("mapping_rate", F.round("mapping_rate", 6))


@query("""WITH sn AS (SELECT l_orderkey AS doc, list({'i': 's' || l_linenumber, 't': 'Part ' || l_partkey} ORDER BY l_linenumber, 'Part ' || l_partkey) AS x FROM lineitem GROUP BY l_orderkey), ca AS (SELECT l_orderkey AS doc, l_linenumber AS n, l_partkey % 9 AS k, x FROM lineitem JOIN sn ON sn.doc = l_orderkey),
sw AS (SELECT doc, string_agg(t, '|' ORDER BY sha256('7|' || doc || '|' || (pos - 1))) AS t FROM (SELECT doc, unnest(x).t AS t, generate_subscripts(x, 1) AS pos FROM sn) GROUP BY doc)
SELECT ca.doc || ':' || n AS intervention_id, CASE k WHEN 0 THEN array_to_string(list_transform(list_filter(x, lambda e: e.i <> 's' || n), lambda e: e.t), '|') WHEN 1 THEN array_to_string(list_transform(x, lambda e: CASE WHEN e.i = 's' || n THEN '[MASKED]' ELSE e.t END), '|') WHEN 2 THEN sw.t WHEN 3 THEN array_to_string(list_transform(x, lambda e: replace(e.t, 'Part', 'Item')), '|') ELSE array_to_string(list_transform(x, lambda e: e.t), '|') END AS sentences,
CASE WHEN k = 4 THEN array_to_string(list_filter(['C1', 'C2', 'C3'], lambda c: c <> 'C' || n), ',') WHEN k = 5 THEN 'C1,C2,C3,C9_tone' ELSE 'C1,C2,C3' END AS clauses, CASE k WHEN 6 THEN 'A,N' WHEN 7 THEN 'R,related_to' WHEN 8 THEN 'R,N,A' ELSE 'A,N,R' END AS relations FROM ca LEFT JOIN sw ON sw.doc = ca.doc""")
def applied_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate per line of an order, whose lines are sentences: what its extraction is given."""
    l = table(spark, sf_dir, "lineitem")
    n, k = F.col("l_linenumber").cast("string"), (F.col("l_partkey") % 9).cast("int")
    pick = lambda *of: F.element_at(F.array(*(F.lit(x) if isinstance(x, str) else x for x in of)), k + 1)
    own = F.concat(F.lit("s"), n)
    chosen = l.select(
        F.col("l_orderkey").alias("document_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), n).alias("intervention_id"), pick(*["sentence"] * 4, *["prompt_clause"] * 2, *["schema"] * 3).alias("target_type"),
        pick(own, own, own, own, F.concat(F.lit("C"), n), "strict", "drop:R", "ambiguous:A,N", "reorder").alias("target_id"), pick("remove", "mask", "para_swap", "entity_alias", "remove", "tone", "x", "x", "x").alias("operator"),
    )
    ordered = F.sort_array(F.collect_list(F.struct("l_linenumber", F.concat(F.lit("Part "), F.col("l_partkey").cast("string")).alias("t"))))  # an order's lines
    given = l.groupBy(F.col("l_orderkey").alias("document_id")).agg(ordered.alias("x")).select(
        "document_id", F.transform("x", lambda e: F.struct(F.concat(F.lit("s"), e["l_linenumber"].cast("string")).alias("id"), e["t"].alias("text"))).alias("sentences"),
        F.array(*(F.struct(F.lit(c).alias("id"), F.lit(f"text of {c}").alias("text")) for c in ("C1", "C2", "C3"))).alias("clauses"), F.array(*(F.struct(F.lit(r).alias("id"), F.lit(r).alias("label"), F.lit("").alias("description")) for r in "ANR")).alias("relations"),
    )
    ids = lambda c, field, by: F.array_join(F.transform(c, lambda e: e[field]), by).alias(c)
    return interventions.applied(chosen, given, [("Part", "Item")]).select("intervention_id", ids("sentences", "text", "|"), ids("clauses", "id", ","), ids("relations", "id", ","))
