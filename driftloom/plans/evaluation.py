"""Registered statistics, contract, gate and lineage queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import contracts, lineage, statistics, views

from driftloom.sources.store import kept, written

from . import derived, resampling
from .derived import table
from .graph import FANOUT_B, FANOUT_C, sided
from .registry import query

PAIR = ["family", "doc"]


def scored_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source, score, label, toxic) of the labelled documents; the score is the length."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "source", "lang", "score", F.col("quality").cast("long").alias("label"), F.col("toxic").cast("long").alias("toxic"))


LABELS = "WITH t AS (SELECT doc_id, source, lang, n_chars::DOUBLE AS score, quality::BIGINT AS label, toxic::BIGINT AS toxic FROM documents JOIN labels USING (doc_id))"


@query(LABELS + """, r AS (SELECT *, rank() OVER (PARTITION BY lang ORDER BY score) + (count(*) OVER (PARTITION BY lang, score) - 1) / 2.0 AS rk FROM t)
SELECT lang, count(*) AS n, round(CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) END, 6) AS auroc FROM r GROUP BY lang""")
def rank_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.rank_auc(scored_labels(spark, sf_dir), ["lang"], "score", "label")
    return out.withColumn("auroc", F.round("auroc", 6))


@query(LABELS + """, p AS (SELECT lang, score, count(*) AS n, sum(label) AS p FROM t GROUP BY ALL), c AS (SELECT *, sum(p) OVER w / sum(n) OVER w::DOUBLE AS prec FROM p WINDOW w AS (PARTITION BY lang ORDER BY score DESC))
SELECT lang, round(sum(prec * p) / sum(p), 6) AS average_precision FROM c GROUP BY lang""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.average_precision(scored_labels(spark, sf_dir), ["lang"], "score", "label")
    return out.withColumn("average_precision", F.round("average_precision", 6))


@query(LABELS + """, p AS (SELECT lang, score, count(*) AS n, sum(toxic) AS h FROM t GROUP BY ALL)
SELECT lang, score AS threshold, round(sum(n) OVER w / sum(n) OVER (PARTITION BY lang)::DOUBLE, 6) AS coverage, round(sum(h) OVER w / sum(n) OVER w::DOUBLE, 6) AS risk FROM p WINDOW w AS (PARTITION BY lang ORDER BY score)""")
def risk_coverage_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.risk_coverage(scored_labels(spark, sf_dir), ["lang"], "score", "toxic")
    return out.withColumn("coverage", F.round("coverage", 6)).withColumn("risk", F.round("risk", 6))


@query(LABELS + """, s AS (SELECT source, count(*) AS n, sum(toxic) AS k, sum(toxic) / count(*)::DOUBLE AS p FROM t GROUP BY source)
SELECT source, n, round(greatest((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 0.0), 6) AS low, round(least((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n), 1.0), 6) AS high FROM s""")
def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = scored_labels(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    low, high = statistics.wilson(F.col("k"), F.col("n"))
    return per.select("source", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@query(LABELS + """, r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, sha256(doc_id::VARCHAR)) AS k, count(*) OVER (PARTITION BY lang) AS n FROM t)
SELECT doc_id, lang, k <= round_even(n * 0.1, 0) AS flag FROM r""")
def flags_at_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.flags_at_count(scored_labels(spark, sf_dir), "score", "doc_id", 0.1, ["lang"]).select("doc_id", "lang", "flag")


@query("SELECT doc_id, (row_number() OVER (ORDER BY md5(doc_id::VARCHAR), doc_id) - 1) % 2 = 0 AS calibration FROM (SELECT DISTINCT doc_id FROM labels)")
def digest_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.digest_split(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id").select("doc_id", "calibration")


CONFUSIONS = LABELS + """, p AS (SELECT lang, score AS x, count(*) AS n, sum(toxic) AS p FROM t GROUP BY ALL),
s AS (SELECT *, sum(n) OVER w AS n0, sum(p) OVER w AS p0, sum(p) OVER (PARTITION BY lang) AS np, sum(n) OVER (PARTITION BY lang) AS nn, lead(x) OVER w AS nx FROM p WINDOW w AS (PARTITION BY lang ORDER BY x)),
m AS (SELECT lang, coalesce((x + nx) / 2, x + 1e-9) AS threshold, n0, p0, np, nn FROM s UNION ALL SELECT lang, min(x) - 1e-9, 0, 0, max(np), max(nn) FROM s GROUP BY lang),
q AS (SELECT lang, threshold, np - p0 AS tp, nn - n0 - np + p0 AS fp, p0 AS fn, n0 - p0 AS tn FROM m)
"""


RATES = CONFUSIONS + """, qq AS (SELECT 'max' AS direction, lang, threshold, tp, fp, fn, tn FROM q UNION ALL SELECT 'min', lang, threshold, fn, tn, tp, fp FROM q),
y0 AS (SELECT direction, lang, threshold, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS r, (tp + fp) / (tp + fp + fn + tn)::DOUBLE AS a FROM qq),
y AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f FROM y0)
"""


@query(RATES + """SELECT lang, round(arg_max(threshold, (r - a, -threshold)), 6) AS threshold, round(max(r - a), 6) AS score FROM y WHERE direction = 'max' GROUP BY lang""")
def calibrated_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Youden thresholds per language, from the confusions at every candidate."""
    found = statistics.calibrate(statistics.confusion_at_thresholds(scored_labels(spark, sf_dir), ["lang"], "score", "toxic"), ["lang"], "youden")
    return found.select("lang", F.round("threshold", 6).alias("threshold"), F.round("score", 6).alias("score"))


@query(RATES + """, sc AS (SELECT *, unnest([{'mode': 'recall_floor', 'met': r >= 0.9, 's': CASE WHEN r >= 0.9 THEN -a ELSE r END}, {'mode': 'alarm_budget', 'met': a <= 0.1, 's': CASE WHEN a <= 0.1 THEN r ELSE 0.0 END}, {'mode': 'f1', 'met': true, 's': f}, {'mode': 'utility', 'met': true, 's': 0.5::DOUBLE * r - 0.5::DOUBLE * a}]) AS m FROM y),
be AS (SELECT direction, lang, m.mode AS mode, arg_max({'t': threshold, 'met': m.met, 'a': a, 'p': p, 'r': r, 'f': f}, (m.met, m.s, -threshold)) AS x FROM sc GROUP BY ALL), vo AS (SELECT *, NOT x.met AND (mode <> 'recall_floor' OR x.r = 0) AS void FROM be)
SELECT direction, lang, mode, round(x.t, 6) AS threshold, round(CASE WHEN void THEN 0.0 ELSE x.a END, 6) AS alarm_rate, round(CASE WHEN void THEN 0.0 ELSE x.p END, 6) AS "precision", round(CASE WHEN void THEN 0.0 ELSE x.r END, 6) AS recall, round(CASE WHEN void THEN 0.0 ELSE x.f END, 6) AS f1 FROM vo""")
def calibration_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The other modes, with alarms above a threshold and below one."""
    parts = []
    for direction in statistics.DIRECTIONS:
        confusions = statistics.confusion_at_thresholds(scored_labels(spark, sf_dir), ["lang"], "score", "toxic", direction)
        parts += [statistics.calibrate(confusions, ["lang"], m, target).select(F.lit(direction).alias("direction"), "lang", F.lit(m).alias("mode"), *(F.round(c, 6).alias(c) for c in ("threshold", "alarm_rate", "precision", "recall", "f1"))) for m, target in (("recall_floor", 0.9), ("alarm_budget", 0.1), ("f1", 0.0), ("utility", 0.0))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(f"""WITH cl AS (SELECT event_type AS grp, user_id, count(*) AS m, sum(value) AS s FROM events WHERE value IS NOT NULL GROUP BY ALL), ce AS MATERIALIZED (SELECT grp, m || '/' || round(s * 1000000)::BIGINT AS cell, count(*) AS n, sum(m) AS m, sum(s) AS s FROM cl GROUP BY grp, cell), {resampling.multinomial("ce", 100, "bw")},
me AS (SELECT bw.grp, r, sum(w * s / bw.n) / sum(w * m / bw.n) AS m FROM bw JOIN ce ON ce.grp = bw.grp AND ce.cell = bw.cell GROUP BY bw.grp, r), ct AS (SELECT grp, sum(s) / sum(m) AS mean FROM ce GROUP BY grp)
SELECT grp AS event_type, round(any_value(mean), 4) AS mean, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high FROM me JOIN ct USING (grp) GROUP BY grp""")
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap of event values over users."""
    found = statistics.cluster_bootstrap(table(spark, sf_dir, "events"), "user_id", "value", 100, ["event_type"])
    return found.withColumns({c: F.round(c, 4) for c in ("mean", "low", "high")})


@query(f"""WITH t AS (SELECT source, n_chars::DOUBLE AS a, (doc_id % 97)::DOUBLE AS b, toxic::BIGINT AS y FROM documents JOIN labels USING (doc_id)), c AS (SELECT DISTINCT '' AS grp, source AS cell, 1 AS n FROM t), {resampling.multinomial("c", 40, "cw")}, e AS (SELECT r, a, b, y, w FROM cw JOIN t ON source = cell WHERE w > 0),
u AS (SELECT 'a' AS k, r, a AS x, sum(w) AS n, sum(w * y) AS p FROM e GROUP BY ALL UNION ALL SELECT 'b', r, b, sum(w), sum(w * y) FROM e GROUP BY ALL), v AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY k, r ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rk FROM u),
z AS (SELECT k, r, CASE WHEN sum(p) > 0 AND sum(p) < sum(n) THEN (sum(p * rk) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * (sum(n) - sum(p))) END AS auc FROM v GROUP BY ALL), d AS (SELECT r, max(auc) FILTER (k = 'a') - max(auc) FILTER (k = 'b') AS d FROM z GROUP BY r)
SELECT round(avg(d), 6) AS mean, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, count(d) AS used FROM d WHERE d IS NOT NULL""")
def auroc_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much better length tells toxic documents than an arbitrary score, over resampled sources."""
    rows = scored_labels(spark, sf_dir).select("source", "score", (F.col("doc_id") % 97).cast("double").alias("other"), "toxic")
    found = statistics.auc_difference(rows, "source", "score", "other", "toxic", 40)
    return found.withColumns({c: F.round(c, 6) for c in ("mean", "low", "high")})


@query("""WITH e AS (SELECT user_id, (epoch_us(ts) // 3600000000) % 24 AS x, avg(value) AS y FROM events GROUP BY ALL), d AS (SELECT *, x - avg(x) OVER (PARTITION BY user_id) AS dx, y - avg(y) OVER (PARTITION BY user_id) AS dy FROM e)
SELECT round(sum(dx * dy) / sum(dx * dx), 6) AS slope FROM d""")
def fixed_effects_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").groupBy("user_id", F.pmod(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000), F.lit(24)).cast("double").alias("x")).agg(F.avg("value").alias("y"))
    return statistics.fixed_effects_slope(e, "user_id", "x", "y").select(F.round("slope", 6).alias("slope"))


@query("""WITH t AS (SELECT l_suppkey AS supp, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04) AS k, count(*) FILTER (l_discount > 0.05 AND l_tax <= 0.04 OR l_discount <= 0.05 AND l_tax > 0.04) AS n FROM lineitem GROUP BY ALL)
SELECT supp, k, n, round(list_sum(list_transform(range(k, n + 1), lambda i: exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) - n * ln(2.0)))), 6) AS p FROM t""")
def mcnemar_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired test of two marks on the lines of each supplier: lines with only the first mark, against those with only one."""
    one, other = F.col("l_discount") > 0.05, F.col("l_tax") > 0.04
    t = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(F.count_if(one & ~other).alias("k"), F.count_if(one != other).alias("n"))
    return t.withColumn("p", F.round(statistics.binomial_upper_tail(F.col("n"), F.col("k")), 6))


GATE = derived.SQL + f""", {sided("b", "c", "s, r, o")}, gd AS (SELECT p.family, p.doc, 1 - coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS gd FROM p LEFT JOIN x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc),
x2 AS (SELECT family, doc, h, r, o, r2, o2, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, h, r, o, r2, o2, 1 AS b, 0 AS c FROM p JOIN {FANOUT_B} q ON q.doc = p.doc UNION ALL SELECT family, doc, h, r, o, r2, o2, 0, 1 FROM {FANOUT_C}) GROUP BY ALL),
qd AS (SELECT p.family, p.doc, 1 - coalesce(sum(x2.b * x2.c) / nullif(count(x2.b), 0)::DOUBLE, 1.0) AS qd FROM p LEFT JOIN x2 ON x2.family = p.family AND x2.doc = p.doc GROUP BY p.family, p.doc),
y AS (SELECT g0.family, g0.doc, gd, qd FROM gd g0 JOIN qd USING (family, doc))
"""


def _drifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(family, doc, gd, qd): graph drift and fan-out query drift."""
    args = derived.args(spark, sf_dir)
    graph = views.jaccard(*args).select(*PAIR, (1 - F.col("jaccard")).alias("gd"))
    return graph.join(views.fanout_jaccard(*args).select(*PAIR, (1 - F.col("fanout")).alias("qd")), PAIR)


@query(GATE + """SELECT family, count(*) AS n_pairs, round(avg(gd), 6) AS graph_drift, round(avg(qd), 6) AS query_drift, round(avg(qd / (gd + 0.05)), 6) AS amplification, round(avg(qd) / (avg(gd) + 0.05), 6) AS ratio_of_means FROM y GROUP BY ROLLUP (family)""")
def amplification_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per family and overall, in grouping sets."""
    d = _drifts(spark, sf_dir)
    return d.rollup("family").agg(F.count("*").alias("n_pairs"), F.round(F.avg("gd"), 6).alias("graph_drift"), F.round(F.avg("qd"), 6).alias("query_drift"), F.round(F.avg(views.amplification(F.col("qd"), F.col("gd"))), 6).alias("amplification"), F.round(views.amplification(F.avg("qd"), F.avg("gd")), 6).alias("ratio_of_means"))


@query(GATE + """, z AS (SELECT *, gd >= 0.2 OR qd >= 0.3 AS blocked, qd > 0.25 AS harmful, 1 - qd AS fidelity FROM y)
SELECT family, count(*) AS n, round(count(*) FILTER (NOT blocked) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (blocked AND harmful) / nullif(count(*) FILTER (harmful), 0)::DOUBLE, 6) AS harm_recall, round(count(*) FILTER (blocked AND harmful) / nullif(count(*) FILTER (blocked), 0)::DOUBLE, 6) AS harm_precision,
round(count(*) FILTER (blocked AND NOT harmful) / nullif(count(*) FILTER (NOT harmful), 0)::DOUBLE, 6) AS false_block, round(count(*) FILTER (NOT blocked AND harmful) / nullif(count(*) FILTER (NOT blocked), 0)::DOUBLE, 6) AS published_harm, round(avg(fidelity) FILTER (NOT blocked), 6) AS published_fidelity FROM z GROUP BY family""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A joint gate: a pair is blocked when its graph or its query drift reaches a threshold."""
    rows = _drifts(spark, sf_dir).withColumn("blocked", (F.col("gd") >= 0.2) | (F.col("qd") >= 0.3)).withColumn("harmful", F.col("qd") > 0.25).withColumn("fidelity", 1 - F.col("qd"))
    out = statistics.gate_metrics(rows, ["family"])
    return out.withColumns({c: F.round(c, 6) for c in ("coverage", "harm_recall", "harm_precision", "false_block", "published_harm", "published_fidelity")})


@query(GATE + """, u AS (SELECT least(floor(gd * 20), 19)::INT AS g, least(floor(qd * 20), 19)::INT AS q, (qd > 0.25)::INT AS h FROM y), k AS (SELECT i.i, j.j, count(*) AS n, sum(h) AS h FROM (SELECT unnest(range(1, 20)) AS i) i, (SELECT unnest(range(1, 20)) AS j) j JOIN u ON u.g < i.i AND u.q < j.j GROUP BY ALL)
SELECT round(i / 20.0, 6) AS tg, round(j / 20.0, 6) AS tq, round(n / (SELECT count(*) FROM u)::DOUBLE, 6) AS coverage, round(h / n::DOUBLE, 6) AS harm_rate FROM k WHERE h / n::DOUBLE <= 0.05 ORDER BY n DESC, i + j DESC, i DESC LIMIT 1""")
def threshold_grid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drifts(spark, sf_dir).withColumn("h", (F.col("qd") > 0.25).cast("int"))
    best = statistics.threshold_grid(rows, "gd", "qd", "h", 0.05)
    return best.select(*(F.round(c, 6).alias(c) for c in ("tg", "tq", "coverage", "harm_rate")))


#: Canonical views: the renamed relation under its own name, as all contracts compare them.
CANONICAL = derived.SQL + """, cc AS MATERIALIZED (SELECT DISTINCT family, doc, s, CASE WHEN r = 'alias_NO' THEN 'RNO' ELSE r END AS r, o FROM c),
sc AS (SELECT family, doc, s, r, o, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, s, r, o, 1 AS b, 0 AS c FROM p JOIN b q ON q.doc = p.doc UNION ALL SELECT family, doc, s, r, o, 0, 1 FROM cc) GROUP BY ALL),
canonical AS (SELECT p.family, p.doc, coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS v FROM p LEFT JOIN sc x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc),
sf AS (SELECT family, doc, h, r, o, r2, o2, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, h, r, o, r2, o2, 1 AS b, 0 AS c FROM p JOIN """ + FANOUT_B + """ q ON q.doc = p.doc UNION ALL SELECT family, doc, h, r, o, r2, o2, 0, 1 FROM """ + FANOUT_C.replace("FROM c a JOIN c z", "FROM cc a JOIN cc z") + """) GROUP BY ALL),
fanout AS (SELECT p.family, p.doc, coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS v FROM p LEFT JOIN sf x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc),
e AS (SELECT 'base' AS family, doc, s, r, o FROM b UNION ALL SELECT * FROM cc), g1 AS (SELECT family, doc, s AS node, count(*) AS n FROM e GROUP BY ALL),
t3 AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY family, doc ORDER BY n DESC, node) AS k FROM g1) WHERE k <= 3),
st AS (SELECT family, doc, node, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, node, 1 AS b, 0 AS c FROM p JOIN t3 q ON q.doc = p.doc AND q.family = 'base' UNION ALL SELECT family, doc, node, 0, 1 FROM t3 WHERE family <> 'base') GROUP BY ALL),
top AS (SELECT p.family, p.doc, coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS v FROM p LEFT JOIN st x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc),
u AS MATERIALIZED (SELECT DISTINCT family, doc, s AS a, o AS z FROM e WHERE s <> o UNION SELECT DISTINCT family, doc, o, s FROM e WHERE s <> o), seed AS (SELECT doc, node FROM t3 WHERE family = 'base' AND k = 1),
n0 AS (SELECT family, doc, node FROM (SELECT family, doc, s AS node FROM e UNION SELECT family, doc, o FROM e) JOIN seed USING (doc, node)), n1 AS (SELECT * FROM n0 UNION SELECT u.family, u.doc, u.z FROM n0 JOIN u ON u.family = n0.family AND u.doc = n0.doc AND u.a = n0.node),
n2 AS (SELECT * FROM n1 UNION SELECT u.family, u.doc, u.z FROM n1 JOIN u ON u.family = n1.family AND u.doc = n1.doc AND u.a = n1.node),
ee AS (SELECT e.* FROM e JOIN n2 x ON x.family = e.family AND x.doc = e.doc AND x.node = e.s JOIN n2 y ON y.family = e.family AND y.doc = e.doc AND y.node = e.o),
se AS (SELECT family, doc, s, r, o, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, s, r, o, 1 AS b, 0 AS c FROM p JOIN ee q ON q.doc = p.doc AND q.family = 'base' UNION ALL SELECT family, doc, s, r, o, 0, 1 FROM ee WHERE family <> 'base') GROUP BY ALL),
ego AS (SELECT p.family, p.doc, coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS v FROM p LEFT JOIN se x ON x.family = p.family AND x.doc = p.doc GROUP BY p.family, p.doc),
m1 AS (SELECT DISTINCT family, doc, s AS a, o AS z FROM e WHERE s <> o), m2 AS MATERIALIZED (SELECT DISTINCT x.family, x.doc, x.a AS h, y.z AS t, x.z AS node FROM m1 x JOIN m1 y ON y.family = x.family AND y.doc = x.doc AND y.a = x.z WHERE x.a <> y.z),
q5 AS (SELECT doc, h, t FROM (SELECT doc, h, t, row_number() OVER (PARTITION BY doc ORDER BY h, t) AS k FROM (SELECT DISTINCT doc, h, t FROM m2 WHERE family = 'base')) WHERE k <= 6),
s5 AS (SELECT family, doc, h, t, node, max(b) AS b, max(c) AS c FROM (SELECT p.family, p.doc, h, t, node, 1 AS b, 0 AS c FROM p JOIN m2 q ON q.doc = p.doc AND q.family = 'base' UNION ALL SELECT family, doc, h, t, node, 0, 1 FROM m2 WHERE family <> 'base') GROUP BY ALL),
j5 AS (SELECT p.family, p.doc, q5.h, q5.t, coalesce(sum(x.b * x.c) / nullif(count(x.b), 0)::DOUBLE, 1.0) AS j FROM p JOIN q5 ON q5.doc = p.doc LEFT JOIN s5 x ON x.family = p.family AND x.doc = p.doc AND x.h = q5.h AND x.t = q5.t GROUP BY ALL),
paths AS (SELECT family, doc, avg(j) AS v FROM j5 GROUP BY ALL),
hit AS (SELECT e.family, e.doc, count(*) AS n FROM e JOIN g ON g.doc = e.doc AND g.s = e.s AND g.r = e.r AND g.o = e.o GROUP BY ALL), ng AS (SELECT doc, count(*) AS n FROM g GROUP BY doc),
recall AS (SELECT p.family, p.doc, coalesce(x.n / ng.n::DOUBLE, 0.0) AS base_recall, coalesce(y.n / ng.n::DOUBLE, 0.0) AS recall FROM p LEFT JOIN ng ON ng.doc = p.doc LEFT JOIN hit x ON x.family = 'base' AND x.doc = p.doc LEFT JOIN hit y ON y.family = p.family AND y.doc = p.doc),
w AS MATERIALIZED (SELECT p.family || ':' || p.doc AS run_id, p.family AS cause_family, CASE WHEN p.family IN ('stochastic', 'model') THEN 'none' ELSE 'presentation' END AS semantic_class,
  CASE WHEN p.family = 'schema' THEN ['schema ''rename''', 'schema ''desc_added''', 'schema ''hierarchical'''][p.doc % 3 + 1] ELSE p.family END AS description, canonical.v AS canonical, fanout.v AS fanout, paths.v AS paths, top.v AS top_degree, ego.v AS ego, abs(base_recall - recall) AS recall_difference
  FROM p JOIN canonical USING (family, doc) JOIN fanout USING (family, doc) JOIN top USING (family, doc) JOIN ego USING (family, doc) LEFT JOIN paths USING (family, doc) JOIN recall USING (family, doc))
"""
RECORDS = CANONICAL + """, o AS (SELECT 'K1' AS contract, 0.85 AS t, canonical AS value, run_id, cause_family FROM w WHERE cause_family = 'schema' AND description LIKE '%''rename''%'
UNION ALL SELECT 'K1b', 0.80, canonical, run_id, cause_family FROM w WHERE cause_family = 'schema' AND description LIKE '%''desc_added''%' UNION ALL SELECT 'K1c', 0.50, canonical, run_id, cause_family FROM w WHERE cause_family = 'schema' AND description LIKE '%''hierarchical''%'
UNION ALL SELECT 'K2', 0.80, canonical, run_id, cause_family FROM w WHERE cause_family = 'prompt' UNION ALL SELECT 'K3', 0.80, canonical, run_id, cause_family FROM w WHERE cause_family = 'evidence'
UNION ALL SELECT 'K4', 0.70, fanout, run_id, cause_family FROM w WHERE semantic_class = 'presentation' UNION ALL SELECT 'K4b', 0.70, paths, run_id, cause_family FROM w WHERE semantic_class = 'presentation' AND paths IS NOT NULL
UNION ALL SELECT 'K4c', 0.70, top_degree, run_id, cause_family FROM w WHERE semantic_class = 'presentation' UNION ALL SELECT 'K4d', 0.70, ego, run_id, cause_family FROM w WHERE semantic_class = 'presentation'
UNION ALL SELECT 'K6', 0.85, canonical, run_id, cause_family FROM w WHERE cause_family = 'stochastic' UNION ALL SELECT 'K5', 0.20, recall_difference, run_id, cause_family FROM w WHERE cause_family = 'model'),
z AS (SELECT *, round(value, 9) AS v, CASE WHEN contract = 'K5' THEN round(value, 9) > t ELSE round(value, 9) < t END AS failed, abs(t - round(value, 9)) AS short FROM (SELECT contract, t::DOUBLE AS t, value, run_id, cause_family FROM o))
"""


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per pair with the metric of every contract; written once."""
    return kept(spark, "records", [f"{sf_dir}/lineitem.parquet", f"{sf_dir}/orders.parquet"], lambda: _make_records(spark, sf_dir))


def _make_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, elements, families = derived.args(spark, sf_dir)
    buckets = derived.buckets(spark, sf_dir)
    own = written(views.renamed(elements, derived.RENAMED), "canonical", buckets)
    top = views.as_masks(views.top_nodes(views.out_degrees(own, families), families, 3), families, ["node"])
    seeds = views.top_nodes(views.out_degrees(own.where(views.has(views.BASE)), ()), (), 1)
    parts = [
        views.canonical_jaccard(docs, own, families, derived.COARSE), views.fanout_jaccard(docs, own, families), views.nonempty(views.jaccard(docs, top, families, "top_degree"), own),
        views.nonempty(views.jaccard(docs, views.ego_edges(own, seeds.select("doc", "node"), buckets=buckets), families, "ego"), own), views.path_similarity(own, families, buckets=buckets),
        views.gold_recall(docs, own, derived.gold(spark, sf_dir), families, ["s", "r", "o"]).select(*PAIR, F.col("difference").alias("recall_difference")),
    ]
    d = parts[0]
    for p in parts[1:]:
        d = d.join(p, PAIR, "left")
    kind = F.element_at(F.array(*(F.lit(f"schema '{k}'") for k in ("rename", "desc_added", "hierarchical"))), (F.col("doc") % 3 + 1).cast("int"))
    metrics = ("canonical", "fanout", "top_degree", "ego", "paths", "recall_difference")
    return d.select(
        F.concat_ws(":", "family", "doc").alias("run_id"), F.col("family").alias("cause_family"), F.when(F.col("family").isin("stochastic", "model"), "none").otherwise("presentation").alias("semantic_class"), F.col("family").alias("operator"),
        F.when(F.col("family") == "schema", kind).otherwise(F.col("family")).alias("description"), *(F.round(m, 9).alias(m) for m in metrics),
    )


@query(RECORDS + """, s AS (SELECT contract, count(*) AS n, count(*) FILTER (failed) / count(*)::DOUBLE AS rate, avg(short) FILTER (failed) AS sev, avg(v) AS mean, quantile_cont(v, 0.5) AS median FROM z GROUP BY contract), k AS (SELECT unnest(['K1', 'K1b', 'K1c', 'K2', 'K3', 'K4', 'K4b', 'K4c', 'K4d', 'K5', 'K6']) AS contract),
p95 AS (SELECT contract, short FROM (SELECT contract, short, row_number() OVER (PARTITION BY contract ORDER BY short) AS i, count(*) OVER (PARTITION BY contract) AS m FROM z WHERE failed) WHERE i = floor(0.95 * (m - 1)) + 1)
SELECT contract, coalesce(n, 0) AS n, round(coalesce(rate, 0.0), 6) AS violation_rate, round(coalesce(sev, 0.0), 6) AS severity_mean, round(coalesce(short, 0.0), 6) AS severity_p95, round(mean, 6) AS mean, round(median, 6) AS median, CASE WHEN n IS NULL THEN 'INCONCLUSIVE' WHEN rate > 0.2 THEN 'VIOLATED' ELSE 'SATISFIED' END AS verdict FROM k LEFT JOIN s USING (contract) LEFT JOIN p95 USING (contract)""")
def contract_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered contracts in one job; those without pairs are inconclusive."""
    out = contracts.evaluate(_records(spark, sf_dir))
    return out.select("contract", F.col("n").cast("long").alias("n"), *(F.round(c, 6).alias(c) for c in ("violation_rate", "severity_mean", "severity_p95", "mean", "median")), "verdict")


@query(RECORDS + """SELECT contract, cause_family, count(*) AS n, count(*) FILTER (failed) AS failed, round(avg(v), 6) AS mean FROM z GROUP BY ALL""")
def contract_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each contract found in each cause family."""
    found = contracts.evaluate(_records(spark, sf_dir)).select("contract", F.explode("by_family").alias("cause_family", "x"))
    return found.select("contract", "cause_family", "x.n", "x.failed", F.round("x.mean", 6).alias("mean"))


@query(RECORDS + """SELECT contract, rank, run_id, round(v, 6) AS value, round(short, 6) AS shortfall FROM (SELECT *, row_number() OVER (PARTITION BY contract ORDER BY round(short, 9) DESC, run_id) AS rank FROM z WHERE failed) WHERE rank <= 5""")
def contract_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five worst pairs of each contract."""
    return contracts.worst_examples(_records(spark, sf_dir)).select("contract", F.col("rank").cast("long").alias("rank"), "run_id", F.round("value", 6).alias("value"), F.round("shortfall", 6).alias("shortfall"))


@query(RECORDS + """, s AS (SELECT contract, count(*) FILTER (failed) / count(*)::DOUBLE AS rate FROM z GROUP BY contract), k AS (SELECT unnest(['K1', 'K1b', 'K1c', 'K2', 'K3', 'K4', 'K4b', 'K4c', 'K4d', 'K5', 'K6']) AS contract)
SELECT CASE WHEN rate IS NULL THEN 'INCONCLUSIVE' WHEN rate > 0.2 THEN 'VIOLATED' ELSE 'SATISFIED' END AS verdict, count(*) AS n FROM k LEFT JOIN s USING (contract) GROUP BY ALL""")
def contract_roll_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.roll_up(contracts.evaluate(_records(spark, sf_dir)))


@query(RECORDS + """SELECT contract, h.h AS threshold, round(count(*) FILTER (CASE WHEN contract = 'K5' THEN v > h.h ELSE v < h.h END) / count(*)::DOUBLE, 6) AS violation_rate FROM z, (SELECT unnest([0.5::DOUBLE, 0.7::DOUBLE, 0.8::DOUBLE, 0.9::DOUBLE]) AS h) h GROUP BY ALL""")
def contract_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contracts.sensitivity(_records(spark, sf_dir)).withColumn("violation_rate", F.round("violation_rate", 6))


@query("""WITH r AS (SELECT event_id AS run_id, user_id, event_type, ts FROM events WHERE event_id % 10 = 0), e AS (SELECT event_id, user_id, event_type, ts FROM events WHERE event_id % 10 <> 0)
SELECT run_id, arg_min(e.event_id, (abs(epoch_us(e.ts) - epoch_us(r.ts)), e.event_id)) AS event_id FROM r JOIN e USING (user_id, event_type) GROUP BY run_id""")
def nearest_event_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-sided as-of join: every tenth event with the nearest other event of its user and type."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    runs = e.where("event_id % 10 = 0").withColumnRenamed("event_id", "run_id")
    return lineage.nearest_event(runs, e.where("event_id % 10 <> 0"), ["user_id", "event_type"], [], "ts", "ts", "run_id", "event_id")


@query("SELECT * FROM (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1".replace("SELECT * FROM", "SELECT event_id, user_id, event_type, value FROM"))
def latest_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query("""WITH p AS (SELECT o_orderkey AS run_id, o_custkey AS b, o_custkey + o_orderkey % 3 AS c FROM orders), e AS (SELECT c_custkey AS id, c_nationkey AS d FROM customer), j AS (SELECT p.*, eb.d AS bd, ec.d AS cd FROM p LEFT JOIN e eb ON eb.id = b LEFT JOIN e ec ON ec.id = c)
SELECT run_id, 'missing endpoint' AS problem FROM j WHERE bd IS NULL OR cd IS NULL UNION ALL SELECT run_id, 'same endpoint' FROM j WHERE b = c UNION ALL SELECT run_id, 'other document' FROM j WHERE bd <> 7 OR cd <> 7""")
def pair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs of customers, nations as documents; all pairs claim nation 7."""
    pairs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("base_event_id"), (F.col("o_custkey") + F.col("o_orderkey") % 3).alias("cf_event_id"), F.lit(7).alias("document_id"))
    return lineage.pair_violations(pairs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("document_id")))


@query("""WITH p AS (SELECT o_custkey AS a, o_custkey % 100 AS z FROM orders), e AS (SELECT unnest([a, z]) AS id FROM p), t AS (SELECT e.id, c_nationkey AS tokens FROM e LEFT JOIN customer ON c_custkey = e.id), d AS (SELECT DISTINCT * FROM t)
SELECT (SELECT count(*) FROM t) AS endpoints, (SELECT sum(tokens) FROM t)::BIGINT AS all_tokens, (SELECT count(*) FROM d) AS distinct_endpoints, (SELECT sum(tokens) FROM d)::BIGINT AS distinct_tokens, round((SELECT count(*) FROM t) / (SELECT count(*) FROM d)::DOUBLE, 6) AS endpoint_factor, round((SELECT sum(tokens) FROM t) / (SELECT sum(tokens) FROM d)::DOUBLE, 6) AS token_factor""")
def endpoint_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("base_event_id"), (F.col("o_custkey") % 100).alias("cf_event_id"))
    out = lineage.endpoint_reuse(pairs, table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("event_id"), F.col("c_nationkey").alias("tokens")))
    return out.withColumn("endpoint_factor", F.round("endpoint_factor", 6)).withColumn("token_factor", F.round("token_factor", 6))


@query("""SELECT l_orderkey AS doc, u.c AS condition FROM (SELECT DISTINCT l_orderkey FROM lineitem), (SELECT unnest(['1', '2', '3', '4', '5']) AS c) u WHERE NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_orderkey = lineitem.l_orderkey AND k.l_linenumber::VARCHAR = u.c)""".replace("FROM (SELECT DISTINCT l_orderkey FROM lineitem),", "FROM (SELECT DISTINCT l_orderkey FROM lineitem) lineitem,"))
def missing_checkpoint_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").cast("string").alias("condition"))
    return lineage.missing_cells(l, l, ["1", "2", "3", "4", "5"])
