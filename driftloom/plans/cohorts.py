"""Registered queries of the cross-document cohort: packets of two documents, their answers, drifts, quality and summary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import cohort, statistics
from driftloom.sources.store import kept, written

from . import derived, resampling
from .derived import table
from .registry import query

DESIGN = "driftloom-cohort-1"
#: A cached extraction of single documents, and joint ones: both orders of the documents, and another seed.
CACHED, AB, BA, AGAIN = "cached", "ab", "ba", "ab_again"
COMPARISONS = {"order": (AB, BA), "seed": (AB, AGAIN)}
CONDITIONS = (CACHED, AB, BA, AGAIN)


#: What the bits of a mask stand for.
EVERY = ("gold", *CONDITIONS)


def condition_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, s, r, o, mask): customers' parts -[CID]-> supplier and quantity, with the conditions that have them, gold among them; in buckets of documents."""
    return kept(spark, "condition_edges", derived.inputs(sf_dir), lambda: _make_edges(spark, sf_dir), derived.buckets(spark, sf_dir))


def _make_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    k, ln, part = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    there = {"gold": F.col("l_discount") <= 0.05, CACHED: F.lit(True), AB: ln != 1, BA: (k + ln) % 5 != 0, AGAIN: k % 7 != 0}
    mask = reduce(Column.__add__, (F.when(there[c], 1 << i).otherwise(0) for i, c in enumerate(EVERY)))
    rows = l.join(o, k == F.col("o_orderkey")).select(F.col("o_custkey").alias("doc"), part.alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_quantity").cast("int").alias("quantity"), mask.alias("mask")).repartition(*derived.buckets(spark, sf_dir))
    edges = rows.select("doc", F.concat(F.lit("p:"), F.col("part").cast("string")).alias("s"), F.lit("CID").alias("r"), F.concat_ws("/", F.concat(F.lit("s:"), F.col("supp").cast("string")), F.col("quantity").cast("string")).alias("o"), "mask")
    return edges.groupBy("doc", "s", "r", "o").agg(F.bit_or("mask").alias("mask"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, "cohort", derived.inputs(sf_dir), lambda: cohort.build_cohort(condition_edges(spark, sf_dir).where(F.col("mask").bitwiseAND(F.lit(1)) != 0), DESIGN))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet, s, r, o, mask, source), in buckets of packets."""
    buckets = (derived.buckets(spark, sf_dir)[0], "packet")
    return kept(spark, "packed", derived.inputs(sf_dir), lambda: cohort.packet_edges(condition_edges(spark, sf_dir), packets(spark, sf_dir)), buckets)


def _cohort_sql(rounds: int) -> str:
    """The greedy choice in rounds, as SQL; what a further round would take is none when all documents are in or out."""
    both = lambda t: f"(SELECT a FROM {t} UNION ALL SELECT z FROM {t})"
    best = lambda t: f"(SELECT doc, min(rank) AS rank FROM (SELECT a AS doc, rank FROM {t} UNION ALL SELECT z, rank FROM {t}) GROUP BY doc)"
    steps = [f"""t{i} AS MATERIALIZED (SELECT q.* FROM l{i} q JOIN {best(f'l{i}')} x ON x.doc = q.a AND x.rank = q.rank JOIN {best(f'l{i}')} y ON y.doc = q.z AND y.rank = q.rank),
l{i + 1} AS MATERIALIZED (SELECT * FROM l{i} WHERE a NOT IN {both(f't{i}')} AND z NOT IN {both(f't{i}')})""" for i in range(rounds)]  # fmt: skip
    taken = " UNION ALL ".join(f"SELECT * FROM t{i}" for i in range(rounds))
    return f"""WITH ln AS (SELECT o_custkey AS doc, l_orderkey AS k, l_linenumber AS n, l_discount AS disc, 'p:' || l_partkey AS s, 'CID' AS r, 's:' || l_suppkey || '/' || l_quantity::INT AS o FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS MATERIALIZED (SELECT DISTINCT doc, condition, s, r, o FROM (SELECT 'gold' AS condition, * FROM ln WHERE disc <= 0.05 UNION ALL SELECT 'cached', * FROM ln UNION ALL SELECT 'ab', * FROM ln WHERE n <> 1 UNION ALL SELECT 'ba', * FROM ln WHERE (k + n) % 5 <> 0 UNION ALL SELECT 'ab_again', * FROM ln WHERE k % 7 <> 0)),
gl AS MATERIALIZED (SELECT DISTINCT doc, s, o FROM e WHERE condition = 'gold'),
l0 AS MATERIALIZED (SELECT a, z, sha256('["{DESIGN}","' || a || '","' || z || '","cohort-rank"]') AS rank FROM (SELECT i.doc AS a, j.doc AS z FROM gl i JOIN gl j ON i.s = j.s AND i.doc < j.doc AND i.o <> j.o UNION SELECT i.doc, j.doc FROM gl i JOIN gl j ON i.o = j.o AND i.doc < j.doc AND i.s <> j.s)),
{', '.join(steps)},
pk AS MATERIALIZED (SELECT 'packet-' || left(sha256('["{DESIGN}","' || a || '","' || z || '"]'), 12) AS packet, a AS doc_a, z AS doc_b, rank FROM ({taken}))"""


#: Rounds that the SQL has; pairs that were left after them would make it differ.
SQL_COHORT = _cohort_sql(24)
SQL_PACKED = SQL_COHORT + """, pe AS MATERIALIZED (SELECT DISTINCT packet, condition, s, r, o, doc AS source FROM e JOIN pk ON doc = doc_a OR doc = doc_b),
an AS MATERIALIZED (SELECT DISTINCT i.packet, i.condition, 'fanout' AS shape, i.s AS key, i.o AS x, j.o AS y FROM pe i JOIN pe j ON i.packet = j.packet AND i.condition = j.condition AND i.s = j.s AND i.source <> j.source AND i.o < j.o
  UNION ALL SELECT DISTINCT i.packet, i.condition, 'shared_tail', i.o, i.s, j.s FROM pe i JOIN pe j ON i.packet = j.packet AND i.condition = j.condition AND i.o = j.o AND i.source <> j.source AND i.s < j.s)"""
SQL_RECORDS = SQL_PACKED + """, c AS (SELECT * FROM (VALUES ('order', 'ab', 'ba'), ('seed', 'ab', 'ab_again')) t(comparison, one, other)), sh AS (SELECT unnest(['fanout', 'shared_tail']) AS shape),
ju AS (SELECT packet, comparison, 'provenance' AS g, max((condition = one)::INT) AS i, max((condition = other)::INT) AS j, s, r, o, source FROM pe, c GROUP BY ALL), jw AS (SELECT packet, comparison, 'semantic' AS g, max((condition = one)::INT) AS i, max((condition = other)::INT) AS j, s, r, o FROM pe, c GROUP BY ALL),
ja AS (SELECT packet, comparison, shape AS g, max((condition = one)::INT) AS i, max((condition = other)::INT) AS j, key, x, y FROM an, c GROUP BY ALL),
jx AS (SELECT packet, comparison, g, sum(i * j) AS n_both, sum(greatest(i, j)) AS n_any FROM (SELECT packet, comparison, g, i, j FROM ju UNION ALL SELECT packet, comparison, g, i, j FROM jw UNION ALL SELECT packet, comparison, g, i, j FROM ja) GROUP BY ALL),
jy AS (SELECT packet, comparison, g, coalesce(1 - n_both / nullif(n_any, 0)::DOUBLE, 0.0) AS drift, coalesce(n_any, 0) = 0 AS empty, EXISTS (SELECT 1 FROM an WHERE an.packet = pk.packet AND an.shape = g AND condition = 'gold') AS active
  FROM pk CROSS JOIN c CROSS JOIN (SELECT unnest(['provenance', 'semantic', 'fanout', 'shared_tail']) AS g) LEFT JOIN jx USING (packet, comparison, g)),
rc AS MATERIALIZED (SELECT packet, comparison, max(drift) FILTER (g = 'semantic') AS semantic_graph_drift, max(drift) FILTER (g = 'provenance') AS provenance_graph_drift, coalesce(max(drift) FILTER (active), 0.0) AS max_query_drift, coalesce(avg(drift) FILTER (active), 0.0) AS mean_query_drift,
  bool_or(active) FILTER (g = 'fanout') AS fanout_active, max(drift) FILTER (g = 'fanout') AS fanout_drift, bool_or(empty) FILTER (g = 'fanout') AS fanout_both_empty, bool_or(active) FILTER (g = 'shared_tail') AS shared_tail_active, max(drift) FILTER (g = 'shared_tail') AS shared_tail_drift, bool_or(empty) FILTER (g = 'shared_tail') AS shared_tail_both_empty
  FROM jy GROUP BY packet, comparison)"""
SQL_QUALITY = """, k AS (SELECT unnest(['cached', 'ab', 'ba', 'ab_again']) AS cond),
qu AS (SELECT packet, cond, 'provenance' AS g, max((condition = cond)::INT) AS i, max((condition = 'gold')::INT) AS j, s, r, o, source FROM pe, k GROUP BY ALL), qw AS (SELECT packet, cond, 'semantic' AS g, max((condition = cond)::INT) AS i, max((condition = 'gold')::INT) AS j, s, r, o FROM pe, k GROUP BY ALL),
qa AS (SELECT packet, cond, shape AS g, max((condition = cond)::INT) AS i, max((condition = 'gold')::INT) AS j, key, x, y FROM an, k GROUP BY ALL),
qx AS (SELECT packet, cond, g, sum(i) AS own, sum(j) AS gold, sum(i * j) AS hit FROM (SELECT packet, cond, g, i, j FROM qu UNION ALL SELECT packet, cond, g, i, j FROM qw UNION ALL SELECT packet, cond, g, i, j FROM qa) GROUP BY ALL),
qy AS (SELECT packet, cond, g, coalesce(own, 0) > 0 AS answered, coalesce(gold, 0) > 0 AND g IN ('fanout', 'shared_tail') AS active, coalesce(hit / nullif(own, 0)::DOUBLE, 0.0) AS prec, coalesce(hit / nullif(gold, 0)::DOUBLE, 0.0) AS rec, coalesce(2.0 * hit / nullif(own + gold, 0), 1.0) AS f
  FROM pk CROSS JOIN k CROSS JOIN (SELECT unnest(['provenance', 'semantic', 'fanout', 'shared_tail']) AS g) LEFT JOIN qx USING (packet, cond, g)),
ql AS MATERIALIZED (SELECT packet, cond AS condition, coalesce(avg(prec) FILTER (active), 0.0) AS macro_precision, coalesce(avg(rec) FILTER (active), 0.0) AS macro_recall, coalesce(avg(f) FILTER (active), 0.0) AS macro_f1, max(f) FILTER (g = 'semantic') AS semantic_f1, max(f) FILTER (g = 'provenance') AS provenance_f1,
  """ + ", ".join(f"bool_or(active) FILTER (g = '{s}') AS {s}_active, bool_or(answered) FILTER (g = '{s}') AS {s}_answered, max(prec) FILTER (g = '{s}') AS {s}_precision, max(rec) FILTER (g = '{s}') AS {s}_recall, max(f) FILTER (g = '{s}') AS {s}_f1" for s in cohort.SHAPES) + " FROM qy GROUP BY packet, cond)"  # fmt: skip
_DRIFTS = ("semantic_graph_drift", "provenance_graph_drift", "max_query_drift", "mean_query_drift")
_RECORD_NUMBERS = (*_DRIFTS, "fanout_drift", "shared_tail_drift")
_QUALITY_NUMBERS = ("macro_precision", "macro_recall", "macro_f1", "semantic_f1", "provenance_f1", *(f"{s}_{c}" for s in cohort.SHAPES for c in ("precision", "recall", "f1")))
_rounds = lambda names: ", ".join(f"round({c}, 9) AS {c}" for c in names)


@query(SQL_COHORT + " SELECT * FROM pk")
def cross_document_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Disjoint pairs of documents that answer a question together, as a greedy pass by digest takes them."""
    return packets(spark, sf_dir)


@query(SQL_PACKED + " SELECT * FROM an")
def packet_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of both cross-document questions over the packets of the cohort, under each condition and as gold."""
    names = F.filter(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(c)) for i, c in enumerate(EVERY))), lambda c: c.isNotNull())
    of = lambda s: cohort.answer_masks(packed(spark, sf_dir), s).select("packet", F.explode(names).alias("condition"), F.lit(s).alias("shape"), "key", "x", "y")
    return reduce(DataFrame.unionByName, map(of, cohort.SHAPES))


@query(SQL_RECORDS + f" SELECT * REPLACE ({_rounds(_RECORD_NUMBERS)}) FROM rc")
def cross_document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of graphs and answers of each packet between the orders of its documents, and between two seeds."""
    found = cohort.comparison_records(packed(spark, sf_dir), packets(spark, sf_dir), COMPARISONS, conditions=list(EVERY))
    return found.withColumns({c: F.round(c, 9) for c in _RECORD_NUMBERS})


@query(SQL_PACKED + SQL_QUALITY + f" SELECT * REPLACE ({_rounds(_QUALITY_NUMBERS)}) FROM ql")
def cross_document_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and F1 of each packet's answers and graphs against gold, by condition."""
    found = cohort.quality_records(packed(spark, sf_dir), packets(spark, sf_dir), list(CONDITIONS), every=list(EVERY))
    return found.withColumns({c: F.round(c, 9) for c in _QUALITY_NUMBERS})


def _values_sql() -> str:
    """(section, label, metric, packet, value) of what the summary averages."""
    drift = {m: m for m in _DRIFTS} | {"graph_violation_rate": "(provenance_graph_drift > 0.2)::INT", "query_violation_rate": "(max_query_drift > 0.3)::INT"}
    drift |= {f"{s}_{c}": f"CASE WHEN {s}_active THEN {s}_{c}{'::INT' if c == 'both_empty' else ''} END" for s in cohort.SHAPES for c in ("drift", "both_empty")}
    macro = {m: m for m in _QUALITY_NUMBERS[:5]} | {f"{s}_{c}": f"CASE WHEN {s}_active THEN {s}_{c}{'::INT' if c == 'answered' else ''} END" for s in cohort.SHAPES for c in ("answered", "precision", "recall", "f1")}
    parts = [f"SELECT 'drift' AS section, comparison AS label, '{m}' AS metric, packet, ({x})::DOUBLE AS value FROM rc" for m, x in drift.items()]
    parts += [f"SELECT 'quality', condition, '{m}', packet, ({x})::DOUBLE FROM ql" for m, x in macro.items()]
    parts += [f"SELECT 'excess', 'order - seed', '{m}', a.packet, a.{m} - z.{m} FROM rc a JOIN rc z ON a.packet = z.packet AND a.comparison = 'order' AND z.comparison = 'seed'" for m in _DRIFTS]
    parts += ["SELECT 'gain', 'ab - cached', 'macro_f1', a.packet, a.macro_f1 - z.macro_f1 FROM ql a JOIN ql z ON a.packet = z.packet AND a.condition = 'ab' AND z.condition = 'cached'"]
    return "vl AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL)"


@query(SQL_RECORDS + SQL_QUALITY + f""", {_values_sql()}, rw AS (SELECT section || '|' || label || '|' || metric AS grp, value FROM vl), {resampling.mean_intervals("rw", 40, "iv")}
SELECT split_part(grp, '|', 1) AS section, split_part(grp, '|', 2) AS label, split_part(grp, '|', 3) AS metric, n::BIGINT AS n, round(mean + 1e-9, 6) AS mean, (SELECT round(median(value) + 1e-9, 6) FROM rw WHERE rw.grp = iv.grp) AS median, round(low + 1e-9, 6) AS low, round(high + 1e-9, 6) AS high FROM iv""")
def cross_document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over packets with resampled intervals: drift by comparison, order beyond seed, quality by condition, joint beyond cached."""
    edges, chosen = packed(spark, sf_dir), packets(spark, sf_dir)
    comparisons, quality = cohort.comparison_records(edges, chosen, COMPARISONS, conditions=list(EVERY)), cohort.quality_records(edges, chosen, list(CONDITIONS), every=list(EVERY))
    values = written(cohort.summary_values(written(comparisons, "comparisons"), written(quality, "quality"), "order", "seed", AB, CACHED), "values")
    by = ["section", "label", "metric"]
    middle = values.groupBy(*by).agg(F.expr("percentile(value, 0.5)").alias("median"))
    found = statistics.iid_bootstrap(values, "value", 40, by).join(middle, by)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean", "median", "low", "high")})
