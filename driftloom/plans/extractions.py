"""Registered queries on raw extractions: joint responses and their audit, declared labels, toolchains side by side."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.operators import responses, toolchains
from driftloom.sources.store import kept, written

from . import derived
from .cohorts import SQL_COHORT, packets
from .derived import table
from .graph import ANSWERS, CATALOGUED, _answers, _catalogue
from .registry import query


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return l.join(o, l.l_orderkey == o.o_orderkey)


def _joint_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(packet, response): JSON of the lines of both documents, with every twelfth line unsound in one of several ways."""
    chosen = packets(spark, sf_dir)
    l = _lines(spark, sf_dir).join(chosen.select("packet", F.explode(F.array("doc_a", "doc_b")).alias("o_custkey")), "o_custkey")
    v = (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 12
    part, supp = F.concat(F.lit("p:"), F.col("l_partkey").cast("string")), F.concat(F.lit("s:"), F.col("l_suppkey").cast("string"))
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    evidence = F.when(v == 3, "[]").when(v == 4, "[0]").when(v == 5, "[1.5]").when(v == 9, "[1, 1000000]").when(v == 10, "true").otherwise("[1]")
    edge = F.concat(
        F.lit('{"subject_mesh_id": '), quoted(F.when(v == 1, "zz").when(v == 6, supp).otherwise(part)), F.lit(', "relation": '), quoted(F.when(v == 2, "CAUSES").when(v == 7, " cid").when(v == 11, "other").otherwise("CID")),
        F.lit(', "object_mesh_id": '), quoted(F.when(v == 6, part).otherwise(supp)), F.lit(', "source_document_id": '), F.when(v == 0, '"nobody"').otherwise(quoted(F.col("o_custkey").cast("string"))), F.lit(', "evidence_sentence_ids": '), evidence, F.lit("}"),
    )
    # a response holds the edges of two documents
    each = l.groupBy("packet").agg(F.concat(F.lit('{"edges": ['), F.array_join(F.collect_list(F.when(v == 8, '"an edge"').otherwise(edge)), ", "), F.lit("]}")).alias("response"), F.min("o_custkey").alias("first"))
    return each.select("packet", F.when(F.col("first") % 17 == 0, "[1, 2]").otherwise(F.concat(F.lit("```json\n"), "response", F.lit("\n```"))).alias("response"))


@query(SQL_COHORT + """, rl AS (SELECT packet, o_custkey AS doc, (l_orderkey * 7 + l_linenumber) % 12 AS v, l_partkey AS p, l_suppkey AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN pk ON o_custkey = doc_a OR o_custkey = doc_b), ra AS (SELECT *, min(doc) OVER (PARTITION BY packet) % 17 = 0 AS bad FROM rl)
SELECT packet, count(*) FILTER (NOT bad) AS raw_edges, count(DISTINCT (p, q, v = 11, doc)) FILTER (NOT bad AND v IN (7, 11)) AS accepted_edges, CASE WHEN bool_or(bad) THEN 1 ELSE count(*) FILTER (v = 8) END AS invalid_shape, count(*) FILTER (NOT bad AND v = 0) AS invalid_provenance,
count(*) FILTER (NOT bad AND v = 1) AS undeclared_entity, count(*) FILTER (NOT bad AND v = 2) AS invalid_relation, count(*) FILTER (NOT bad AND v IN (3, 4, 5, 9, 10)) AS invalid_evidence, count(*) FILTER (NOT bad AND v = 6) AS invalid_cid_direction FROM ra GROUP BY packet""")
def joint_response_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each packet's joint response holds, and why its edges are left out; parts are chemicals, suppliers diseases, orders sentences."""
    l = _lines(spark, sf_dir)
    named = lambda c, prefix, kind: l.select(F.col("o_custkey").alias("doc"), F.concat(F.lit(prefix), F.col(c).cast("string")).alias("entity"), F.lit(kind).alias("type"))
    entities = named("l_partkey", "p:", "Chemical").unionByName(named("l_suppkey", "s:", "Disease"))
    sentences = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc")).agg(F.count("*").alias("n"))
    found = responses.joint_edges(_joint_responses(spark, sf_dir), ["packet"], packets(spark, sf_dir), entities, sentences)
    return responses.joint_audit(found, ["packet"])


@query("""WITH raw AS (SELECT o_custkey AS doc, CASE WHEN l_linenumber % 2 = 0 THEN 'schema_rename' ELSE 'base' END AS condition, l_orderkey AS s, l_partkey AS o, l_returnflag AS f, o_orderpriority AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
n AS (SELECT doc, condition, s, o, CASE WHEN f = 'N' THEN CASE condition WHEN 'base' THEN 'shipped_new' ELSE 'shipped_as_new' END WHEN f = 'A' THEN 'came_back' ELSE lower(m) END AS r FROM raw), q AS (SELECT *, CASE WHEN condition = 'schema_rename' AND r = 'shipped_as_new' THEN 'shipped_new' ELSE r END AS c FROM n)
SELECT doc, condition, count(*) AS raw_edges, count(DISTINCT (s, c, o)) FILTER (c IN ('shipped_new', 'came_back', '5-low')) AS kept_edges, count(*) FILTER (c NOT IN ('shipped_new', 'came_back', '5-low')) AS off_schema FROM q GROUP BY ALL""")
def declared_label_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many extracted relations are declared labels, with new names told from undeclared ones."""
    new = F.col("l_linenumber") % 2 == 0
    r = F.when(F.col("l_returnflag") == "N", F.when(new, " Shipped as New ").otherwise("shipped_new")).when(F.col("l_returnflag") == "A", "Came Back").otherwise(F.col("o_orderpriority"))
    raw = _lines(spark, sf_dir).select(F.col("o_custkey").alias("doc"), F.when(new, "schema_rename").otherwise("base").alias("condition"), F.concat(F.lit(" O"), F.col("l_orderkey").cast("string")).alias("s"), r.alias("r"), F.concat(F.lit("P"), F.col("l_partkey").cast("string"), F.lit("\t")).alias("o"))
    declared = spark.createDataFrame([(c, x) for c in ("base", "schema_rename") for x in ("Shipped New", "came_back", "5-LOW")], "condition string, label string")
    return responses.declared_edges(raw, ["doc", "condition"], declared, {"shipped_as_new": "shipped_new"}, "schema_rename")[1]


TOOLCHAINS = ("alpha", "beta")
AXES = ("evidence", "rename", "prompt")
VIEWS = [(t, c) for t in TOOLCHAINS for c in ("base", *AXES)]
LABELS = {f"r_{x}": f"R{x.upper()}" for x in ("no", "nf", "af", "rf", "ro", "ao")} | {p.lower(): p for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")}
RENAMES = {"alias_of_no": "r_no"}


def _tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines' columns that toolchains read, in buckets of documents: what is made of them, eight views long, is not shuffled."""
    buckets = derived.buckets(spark, sf_dir)

    def make() -> DataFrame:
        l, o = table(spark, sf_dir, "lineitem").repartition(buckets[0], "l_orderkey"), table(spark, sf_dir, "orders").repartition(buckets[0], "o_orderkey")
        return l.join(o, l.l_orderkey == o.o_orderkey).select(F.col("o_custkey").alias("doc"), "o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus", "l_tax", "o_orderpriority")

    return kept(spark, "toolchain_lines", derived.inputs(sf_dir), make, buckets)


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(toolchain, doc, condition, status, edges): what two toolchains gave for each document under each condition, by surface names."""
    def make() -> DataFrame:
        l = _tool_lines(spark, sf_dir)
        k, ln, part = (F.col(c).cast("long") for c in ("l_orderkey", "l_linenumber", "l_partkey"))
        text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
        thing = F.when(ln % 5 == 0, text("Lot ", part % 100)).when(ln % 7 == 0, text("Thing ", part)).otherwise(F.concat(text("  PART \t", part), F.lit(" ")))
        rel = F.concat(F.lit("R "), "l_returnflag", "l_linestatus")
        renamed = F.when(rel == "R NO", "Alias of No").otherwise(rel)
        edge = lambda s, r, o: F.struct(s.alias("s"), r.alias("r"), o.alias("o"))
        s = text("ORDER ", k)
        of_line = {"base": [edge(s, rel, thing)], "evidence": [F.when(ln != 1, edge(s, rel, thing))], "rename": [edge(s, renamed, thing)], "prompt": [edge(s, rel, thing), F.when(F.col("l_tax") > 0.06, edge(s, F.lit("Taxed At"), thing))]}
        of_order = F.when(ln == 1, edge(text("Customer ", F.col("o_custkey")), F.col("o_orderpriority"), s))
        made = F.array(*(F.struct(F.lit(t).alias("toolchain"), F.lit(c).alias("condition"), F.array_compact(F.array(*(e if t == "alpha" else F.when((k + ln) % 3 != 0, e) for e in of_line[c]), of_order)).alias("e")) for t, c in VIEWS))
        each = l.select("doc", F.explode(made).alias("m"))
        # a record holds the edges of one document
        found = each.groupBy("m.toolchain", "doc", "m.condition").agg(F.flatten(F.collect_list("m.e")).alias("edges"))
        failed = (F.col("toolchain") == "beta") & (((F.col("condition") == "prompt") & (F.col("doc") % 9 == 0)) | (F.col("doc") % 31 == 0))
        empty = (F.col("doc") % 13 == 0) & F.col("condition").isin("base", "evidence")
        return found.select("toolchain", "doc", "condition", F.when(failed, "extraction_error").otherwise("ok").alias("status"), F.when(empty, F.filter("edges", lambda e: F.lit(False))).otherwise(F.col("edges")).alias("edges"))

    return make()


def _statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_records`` without their edges."""
    return kept(spark, "toolchain_statuses", derived.inputs(sf_dir), lambda: _records(spark, sf_dir).drop("edges"), derived.buckets(spark, sf_dir))


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, entity, names): orders, customers, and parts, whose lot is a second name that parts may share."""
    name = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    part, order, customer = F.col("l_partkey"), F.col("l_orderkey"), F.col("o_custkey")
    each = F.array(
        F.struct(name("p:", part).alias("entity"), F.array(name("Part ", part), name("lot  ", part % 100)).alias("names")), F.struct(name("o:", order).alias("entity"), F.array(name("order ", order)).alias("names")),
        F.struct(name("c:", customer).alias("entity"), F.array(name("customer ", customer)).alias("names")),
    )
    return _tool_lines(spark, sf_dir).select("doc", F.explode(each).alias("x")).select("doc", "x.*").distinct()


def _canonical(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return toolchains.canonical_edges(_records(spark, sf_dir), _entities(spark, sf_dir), LABELS, RENAMES)


def _tool_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, s, r, o, mask): canonical edges once, with a bit per view, in buckets; rows per view would be several times as many."""
    bit = F.lit(0)
    for i, (t, c) in enumerate(VIEWS):
        bit = F.when((F.col("toolchain") == t) & (F.col("condition") == c), 1 << i).otherwise(bit)
    return kept(spark, "toolchain_views", derived.inputs(sf_dir), lambda: _canonical(spark, sf_dir)[0].groupBy("doc", "s", "r", "o").agg(F.bit_or(bit.cast("long")).alias("mask")), derived.buckets(spark, sf_dir))


def _tool_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(toolchain, doc, condition, s, r, o) of ``_tool_elements``."""
    held = F.array_compact(F.array(*(F.when(F.col("mask").bitwiseAND(F.lit(1 << i)) != 0, F.struct(F.lit(t).alias("toolchain"), F.lit(c).alias("condition"))) for i, (t, c) in enumerate(VIEWS))))
    return _tool_elements(spark, sf_dir).select("doc", "s", "r", "o", F.explode(held).alias("v")).select("v.toolchain", "doc", "v.condition", "s", "r", "o")


_LABELS_SQL = ", ".join(f"('{a}', '{b}')" for a, b in LABELS.items())
_TOOLS = f"""tl AS (SELECT o_custkey AS doc, l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_tax AS tax, o_orderpriority AS pr, lower('r_' || l_returnflag || l_linestatus) AS rel, CASE WHEN l_linenumber % 5 = 0 THEN 'lot ' || l_partkey % 100 WHEN l_linenumber % 7 = 0 THEN 'thing ' || l_partkey ELSE 'part ' || l_partkey END AS thing FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
tv AS (SELECT * FROM (SELECT unnest(['alpha', 'beta']) AS toolchain), (SELECT unnest(['base', 'evidence', 'rename', 'prompt']) AS condition)),
tr AS MATERIALIZED (SELECT DISTINCT toolchain, doc, condition, toolchain = 'beta' AND (condition = 'prompt' AND doc % 9 = 0 OR doc % 31 = 0) AS failed FROM tl, tv),
tw AS (SELECT toolchain, condition, doc, 'order ' || k AS s, rel AS r, thing AS o FROM tl, tv WHERE (toolchain = 'alpha' OR (k + n) % 3 <> 0) AND (condition <> 'evidence' OR n <> 1)
  UNION ALL SELECT toolchain, condition, doc, 'order ' || k, 'taxed_at', thing FROM tl, tv WHERE (toolchain = 'alpha' OR (k + n) % 3 <> 0) AND condition = 'prompt' AND tax > 0.06
  UNION ALL SELECT toolchain, condition, doc, 'customer ' || doc, lower(pr), 'order ' || k FROM tl, tv WHERE n = 1),
ti AS MATERIALIZED (SELECT doc, name, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS id FROM (SELECT doc, 'part ' || p AS name, 'p:' || p AS id FROM tl UNION SELECT doc, 'lot ' || p % 100, 'p:' || p FROM tl UNION SELECT doc, 'order ' || k, 'o:' || k FROM tl UNION SELECT doc, 'customer ' || doc, 'c:' || doc FROM tl) GROUP BY ALL),
tb(lb, rid) AS (VALUES {_LABELS_SQL}),
tc AS MATERIALIZED (SELECT w.toolchain, w.condition, w.doc, coalesce(x.id, 'name:' || w.s) AS s, coalesce(rid, 'label:' || replace(w.r, ' ', '_')) AS r, coalesce(z.id, 'name:' || w.o) AS o, (x.id IS NOT NULL)::INT + (z.id IS NOT NULL)::INT AS ex, (x.name IS NOT NULL AND x.id IS NULL)::INT + (z.name IS NOT NULL AND z.id IS NULL)::INT AS am, (x.name IS NULL)::INT + (z.name IS NULL)::INT AS un, (rid IS NULL)::INT AS os
  FROM tw w JOIN tr USING (toolchain, doc, condition) LEFT JOIN ti x ON x.doc = w.doc AND x.name = w.s LEFT JOIN ti z ON z.doc = w.doc AND z.name = w.o LEFT JOIN tb ON lb = w.r WHERE NOT failed AND NOT (w.doc % 13 = 0 AND condition IN ('base', 'evidence'))),
td AS MATERIALIZED (SELECT DISTINCT toolchain, condition, doc, s, r, o FROM tc)"""


@query(f"""WITH {_TOOLS}, au AS (SELECT toolchain, doc, condition, count(*) AS raw, count(DISTINCT (s, r, o)) AS can, sum(ex) AS ex, sum(am) AS am, sum(un) AS un, sum(os) AS os FROM tc GROUP BY ALL)
SELECT toolchain, condition, count(*) AS n_endpoints, count(*) FILTER (NOT failed) AS n_successful, count(*) FILTER (failed) AS n_errors, coalesce(sum(raw), 0)::BIGINT AS raw_edges, coalesce(sum(can), 0)::BIGINT AS canonical_edges, sum(ex)::BIGINT AS exact, sum(am)::BIGINT AS ambiguous, sum(un)::BIGINT AS unlinked, sum(os)::BIGINT AS off_schema, round(sum(ex) / sum(ex + am + un), 9) AS linked_rate
FROM tr LEFT JOIN au USING (toolchain, doc, condition) GROUP BY ALL""")
def toolchain_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How names and relations of each toolchain's records were resolved."""
    return toolchains.mapping_summary(_canonical(spark, sf_dir)[1], ["toolchain", "condition"]).withColumn("linked_rate", F.round("linked_rate", 9))


TOLERANCE = {"evidence": 0.3, "rename": 0.05, "prompt": 0.2}


@query(f"""WITH {_TOOLS}, mx AS (SELECT toolchain, doc, condition FROM tr JOIN (SELECT toolchain, doc FROM tr WHERE condition = 'base' AND NOT failed) USING (toolchain, doc) WHERE NOT failed AND condition <> 'base'),
ed AS (SELECT m.toolchain, m.doc, m.condition, s, r, o, max((d.condition = 'base')::INT) AS i, max((d.condition <> 'base')::INT) AS j FROM mx m JOIN td d ON d.toolchain = m.toolchain AND d.doc = m.doc AND d.condition IN ('base', m.condition) GROUP BY ALL),
dr AS (SELECT toolchain, doc, condition, 1 - sum(i * j) / count(*)::DOUBLE AS d, CASE condition WHEN 'evidence' THEN 0.3 WHEN 'rename' THEN 0.05 ELSE 0.2 END::DOUBLE AS tau FROM ed GROUP BY ALL)
SELECT toolchain, condition, count(*) AS n, round(avg(d) + 1e-9, 6) AS mean_drift, round(quantile_cont(d, 0.5) + 1e-9, 6) AS median_drift, tau, round(avg((d > tau)::INT) + 1e-9, 6) AS violation_rate, (SELECT count(*) FROM tr WHERE failed AND tr.toolchain = dr.toolchain AND tr.condition = dr.condition) AS errors, CASE WHEN avg((d > tau)::INT) > 0.2 THEN 'VIOLATED' ELSE 'SATISFIED' END AS verdict FROM dr GROUP BY ALL""")
def toolchain_graph_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of each toolchain's graphs under each condition, without the cells that are empty on both sides."""
    records = _statuses(spark, sf_dir)
    matrix = toolchains.condition_matrix(records, _tool_edges(spark, sf_dir), list(AXES))
    found = toolchains.graph_drift(matrix, records, TOLERANCE, 0.2)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean_drift", "median_drift", "violation_rate")})


@query(CATALOGUED.replace("WITH l AS", f"WITH {_TOOLS}, l AS", 1) + ANSWERS.replace("e AS (SELECT 'base' AS view, * FROM b UNION ALL SELECT * FROM c)", "e AS (SELECT toolchain || '|' || condition AS view, doc, s, r, o FROM td)") + """, iq AS MATERIALIZED (SELECT *, concat_ws('|', family, coalesce(h, ''), coalesce(r, ''), coalesce(h1, ''), coalesce(r1, ''), coalesce(h2, ''), coalesce(r2, '')) AS iid FROM i), wq AS MATERIALIZED (SELECT doc, concat_ws('|', family, coalesce(h, ''), coalesce(r, ''), coalesce(h1, ''), coalesce(r1, ''), coalesce(h2, ''), coalesce(r2, '')) AS iid, view, a FROM w),
oq AS (SELECT toolchain, doc, condition FROM tr JOIN (SELECT toolchain, doc FROM tr WHERE condition = 'base' AND NOT failed) USING (toolchain, doc) WHERE NOT failed AND condition <> 'base'),
cq AS (SELECT toolchain, condition, doc, iid, sum(i) AS nb, sum(j) AS no, sum(i * j) AS nn FROM (SELECT o.toolchain, o.condition, o.doc, iid, a, max((view = o.toolchain || '|base')::INT) AS i, max((view = o.toolchain || '|' || o.condition)::INT) AS j FROM oq o JOIN wq ON wq.doc = o.doc AND view IN (o.toolchain || '|base', o.toolchain || '|' || o.condition) GROUP BY ALL) GROUP BY ALL),
dq AS (SELECT o.toolchain, o.condition, o.doc, coalesce(nb, 0) AS nb, coalesce(no, 0) AS no, coalesce(1 - nn / nullif(nb + no - nn, 0)::DOUBLE, 0.0) AS d FROM oq o JOIN iq ON iq.doc = o.doc LEFT JOIN cq ON cq.toolchain = o.toolchain AND cq.condition = o.condition AND cq.doc = o.doc AND cq.iid = iq.iid),
pq AS (SELECT toolchain, condition, doc, count(*) AS n, avg(d) AS m, max(d) AS x, count(*) FILTER (nb = 0 AND no = 0) AS s0, count(*) FILTER (nb > 0 AND no = 0) AS s1, count(*) FILTER (nb = 0 AND no > 0) AS s2, count(*) FILTER (nb > 0 AND no > 0) AS s3 FROM dq GROUP BY ALL)
SELECT toolchain, condition, count(*) AS n_pairs, count(DISTINCT doc) AS n_documents, sum(n)::BIGINT AS n_query_evaluations, round(avg(x) + 1e-9, 6) AS mean_pair_max, round(quantile_cont(x, 0.5) + 1e-9, 6) AS median_pair_max, round(avg(m) + 1e-9, 6) AS mean_pair_mean, round(avg((x > 0.3)::INT) + 1e-9, 6) AS violation_rate, round(avg((n > s0)::INT) + 1e-9, 6) AS active_pair_rate, round(1 - sum(s0) / sum(n) + 1e-9, 6) AS active_query_rate,
sum(s0)::BIGINT AS both_empty, sum(s1)::BIGINT AS base_only, sum(s2)::BIGINT AS cf_only, sum(s3)::BIGINT AS both_nonempty FROM pq GROUP BY ALL""")
def toolchain_query_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift of the answers of one catalogue, made of gold alone, on every toolchain's graphs under each condition."""
    buckets, asked = derived.buckets(spark, sf_dir), _catalogue(spark, sf_dir)
    answers, parts = _answers(asked, _tool_elements(spark, sf_dir)), None
    for f in asked:  # families are added to one table, as a union would not keep documents together
        rows = toolchains.pair_rows(asked[f], written(toolchains.answer_counts(answers[f], VIEWS), "counts", buckets), VIEWS)
        parts = written(toolchains.pair_parts(rows), "pairs", buckets, onto=parts)
    pairs = toolchains.succeeded(parts, _statuses(spark, sf_dir))
    found = toolchains.query_summary(pairs, 0.3)
    return found.withColumns({c: F.round(F.col(c) + 1e-9, 6) for c in ("mean_pair_max", "median_pair_max", "mean_pair_mean", "violation_rate", "active_pair_rate", "active_query_rate")})
