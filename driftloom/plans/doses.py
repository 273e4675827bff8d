"""Registered queries on dose and response, and on operators of the lineage that no other query calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.operators import dose, extraction, graph_queries, lineage

from . import resampling
from .derived import table
from .registry import query

LEVELS = [0.25, 0.5, 0.75, 1.0]


@query(f"""WITH ev AS (SELECT user_id AS doc, 'c' || user_id % 3 AS corpus, ts, event_id, event_id % 5 / 4.0::DOUBLE AS level, CASE WHEN event_id % 11 = 0 OR event_id % 5 = 0 AND user_id % 7 = 0 THEN 'parse_error' ELSE 'ok' END AS status, event_id % 5 / 4.0::DOUBLE - event_id % 3 * 0.02::DOUBLE AS x, value / 1000 AS y FROM events),
la AS (SELECT corpus, doc, level, arg_max({{'status': status, 'x': x, 'y': y}}, (ts, event_id)) AS e FROM ev GROUP BY ALL), ok AS (SELECT corpus, doc, level, e.x AS x, e.y AS y FROM la WHERE e.status = 'ok'),
su AS (SELECT corpus, doc, count(ok.doc) FILTER (level = 0) AS base, count(ok.doc) FILTER (level > 0) AS n, sum(x) FILTER (level > 0) AS sx, sum(y) FILTER (level > 0) AS sy, sum(x * x) FILTER (level > 0) AS sxx, sum(x * y) FILTER (level > 0) AS sxy FROM (SELECT DISTINCT corpus, doc FROM ev) LEFT JOIN ok USING (corpus, doc) GROUP BY ALL),
pa AS MATERIALIZED (SELECT corpus, CASE WHEN base = 0 THEN 'base' WHEN n < 4 THEN 'level' END AS reason, CASE WHEN base > 0 AND n = 4 THEN sxy - sx * sy / n END AS num, CASE WHEN base > 0 AND n = 4 THEN sxx - sx * sx / n END AS den FROM su),
ce AS MATERIALIZED (SELECT corpus AS grp, round(num * 1000000)::BIGINT || '/' || round(den * 1000000)::BIGINT AS cell, count(*) AS n, sum(num) AS num, sum(den) AS den FROM pa WHERE reason IS NULL GROUP BY ALL), {resampling.multinomial("ce", 60, "dw")},
sl AS (SELECT grp, r, 0.1 * sum(w * num / n) / sum(w * den / n) AS b FROM dw JOIN ce USING (grp, cell, n) GROUP BY grp, r), en AS (SELECT grp, list_sort(list(b)) AS b FROM sl GROUP BY grp)
SELECT corpus, count(*) AS documents, count(*) FILTER (reason = 'base') AS no_base, count(*) FILTER (reason = 'level') AS no_level, count(*) FILTER (reason IS NULL) AS complete, 4 * count(*) FILTER (reason IS NULL) AS observations, round(0.1 * sum(num) / sum(den) + 1e-9, 6) AS slope,
round(any_value(b[floor(0.025 * (len(b) - 1))::BIGINT + 1]) + 1e-9, 6) AS low, round(any_value(b[ceil(0.975 * (len(b) - 1))::BIGINT + 1]) + 1e-9, 6) AS high FROM pa LEFT JOIN en ON grp = corpus GROUP BY corpus""")
def dose_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as extractions of a document at growing doses: complete panels, the slope within documents, its interval."""
    k, user = F.col("event_id"), F.col("user_id")
    records = table(spark, sf_dir, "events").select(
        F.concat(F.lit("c"), (user % 3).cast("string")).alias("corpus"), user.alias("doc"), "ts", "event_id", F.when(k % 5 > 0, k % 5 / 4.0).alias("level"),
        F.when((k % 11 == 0) | ((k % 5 == 0) & (user % 7 == 0)), "parse_error").otherwise("ok").alias("status"), (k % 5 / 4.0 - k % 3 * 0.02).alias("x"), (F.col("value") / 1000).alias("y"),
    )
    found = dose.dose_response(dose.panels(records, ["corpus"], LEVELS, ["ts", "event_id"]), ["corpus"], len(LEVELS), 60)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("slope", "low", "high")})


@query("""WITH e AS (SELECT DISTINCT o_custkey % 10 AS packet, 'p:' || l_partkey AS s, 's:' || l_suppkey AS o, o_custkey AS source FROM lineitem JOIN orders ON l_orderkey = o_orderkey), z AS (SELECT packet, source || '::' || s AS s, source || '::' || o AS o, source FROM e)
SELECT packet, count(*) AS n_edges, count(DISTINCT s) AS n_heads, count(DISTINCT o) AS n_tails, (SELECT count(*) FROM z a JOIN z b ON a.s = b.s AND a.source <> b.source) AS n_across FROM z GROUP BY packet""")
def localized_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The negative control: with nodes that carry their document nothing is joined across documents."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    name = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    e = l.join(o, l.l_orderkey == o.o_orderkey).select((F.col("o_custkey") % 10).alias("packet"), name("p:", "l_partkey").alias("s"), name("s:", "l_suppkey").alias("o"), F.col("o_custkey").alias("source")).distinct()
    own = graph_queries.localize(e, F.col("source").cast("string"))
    # heads that edges of two documents have; as many joins across documents
    across = own.groupBy("s").agg(F.count_distinct("source").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n_across"))
    return own.groupBy("packet").agg(F.count("*").alias("n_edges"), F.count_distinct("s").alias("n_heads"), F.count_distinct("o").alias("n_tails")).crossJoin(across)  # one row


@query("""SELECT o_orderpriority AS cause_family, round(sum((l_returnflag <> 'N')::INT)::DOUBLE / greatest(sum(l_quantity::BIGINT), 1), 9) AS yield, round(avg((l_returnflag <> 'N')::INT), 9) AS change_rate FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""")
def family_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed outcomes per token and per outcome of each cause family; a line is an outcome, its quantity the tokens that it took."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    runs = o.select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("cause_family"))
    outcomes = l.select(F.col("l_orderkey").alias("run_id"), F.when(F.col("l_returnflag") != "N", "TYPE_FLIP").otherwise("EXACT_SAME").alias("outcome_type"), F.col("l_quantity").cast("long").alias("tokens"))
    return lineage.witness_yield(runs, outcomes).withColumns({c: F.round(c, 9) for c in ("yield", "change_rate")})


@query("SELECT user_id AS document_id, count(*) AS n FROM events GROUP BY ALL")
def document_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.event_counts(table(spark, sf_dir, "events").withColumnRenamed("user_id", "document_id"))


@query("""WITH e AS (SELECT l_orderkey AS event_id, CASE WHEN l_returnflag <> 'A' THEN l_partkey END AS s, CASE WHEN l_linenumber % 4 > 0 THEN l_suppkey END AS o FROM lineitem)
SELECT event_id, count(*) AS n, count(*) FILTER (s IS NOT NULL AND o IS NOT NULL) AS linked FROM e GROUP BY ALL""")
def linked_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each view and how many of them have both ends linked to an entity."""
    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("event_id"), F.when(F.col("l_returnflag") != "A", F.col("l_partkey")).alias("s"), F.when(F.col("l_linenumber") % 4 > 0, F.col("l_suppkey")).alias("o"))
    return lineage.linked_edges(e, ["s", "o"])[1]


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(lower(coalesce(text, '')), '[\s\x0B\x1C-\x1F\x85\xA0]+', ' ', 'g'))) AS surface FROM documents""")
def document_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as surfaces: lower case, single spaces."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.surface(F.coalesce("text", F.lit(""))), 256).alias("surface"))
