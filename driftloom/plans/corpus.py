"""Registered queries of text functions, extraction operators, planners and the stream monitor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.functions import text
from driftloom.operators import extraction, interventions, pairing, planning
from driftloom.streaming.monitor import violation_windows

from .derived import table
from .registry import query


@query(r"""SELECT p_partkey, lower(trim(p_name)) AS name_key, replace(lower(trim(p_type)), ' ', '_') AS relation_key, left(regexp_replace(p_name, '[^\p{L}\p{N}_-]', '_', 'g'), 40) AS slug, sha256('7|' || p_partkey) AS rank, ('0x' || left(sha256(p_name), 15))::BIGINT AS head FROM part""")
def text_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", text.name_key(F.col("p_name")).alias("name_key"), text.relation_key(F.col("p_type")).alias("relation_key"), text.slug(F.col("p_name")).alias("slug"), text.digest_rank(F.lit("7"), F.col("p_partkey").cast("string")).alias("rank"), F.conv(F.substring(F.sha2("p_name", 256), 1, 15), 16, 10).cast("long").alias("head"))


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda t: t <> '')) AS n_tokens FROM documents""")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("""SELECT event_id, coalesce(json_extract(props, '$.k')::BIGINT, -1) AS k FROM events""")
def lenient_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties wrapped in a fence with a trailing comma, and read all the same."""
    broken = F.concat(F.lit("```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object(text.lenient_json(broken), "$.k").cast("long"), F.lit(-1).cast("long")).alias("k"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey % 3 AS run, 'p' || l_partkey % 5 AS s, l_returnflag AS r, l_linestatus AS o FROM lineitem), n AS (SELECT doc, run, count(*) AS n FROM r GROUP BY ALL), f AS (SELECT doc, run, s, o, min(r) AS r FROM r GROUP BY ALL),
p AS (SELECT a.doc, a.run AS a, b.run AS b, a.n AS na, b.n AS nb FROM n a JOIN n b ON a.doc = b.doc AND a.run < b.run), t AS (SELECT x.doc, x.run AS a, y.run AS b, count(*) AS same FROM r x JOIN r y ON x.doc = y.doc AND x.s = y.s AND x.r = y.r AND x.o = y.o AND x.run < y.run GROUP BY ALL),
k AS (SELECT x.doc, x.run AS a, y.run AS b, avg((x.r <> y.r)::INT) AS flip FROM f x JOIN f y ON x.doc = y.doc AND x.s = y.s AND x.o = y.o AND x.run < y.run GROUP BY ALL), z AS (SELECT p.*, coalesce(same, 0) AS same, flip FROM p LEFT JOIN t USING (doc, a, b) LEFT JOIN k USING (doc, a, b)),
m AS (SELECT doc, avg(same / (na + nb - same)::DOUBLE) AS overlap, avg(1 - same / na::DOUBLE) AS disappearance, avg(1 - same / nb::DOUBLE) AS "new", avg(flip) AS flip FROM z GROUP BY doc), c AS (SELECT doc, count(*) AS runs FROM n GROUP BY doc),
g AS (SELECT doc, avg((kinds = 1)::INT) AS agreement FROM (SELECT doc, s, o, count(*) AS n, count(DISTINCT r) AS kinds FROM f GROUP BY ALL) JOIN c USING (doc) WHERE n = runs GROUP BY doc)
SELECT doc, round(coalesce(overlap, 0.0), 6) AS overlap, round(coalesce(disappearance, 0.0), 6) AS disappearance, round(coalesce("new", 0.0), 6) AS "new", round(coalesce(flip, 0.0), 6) AS flip, round(coalesce(agreement, 0.0), 6) AS agreement FROM c LEFT JOIN m USING (doc) LEFT JOIN g USING (doc)""")
def run_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order as edges of three repeated runs."""
    l = table(spark, sf_dir, "lineitem")
    runs = l.select(F.col("l_orderkey").alias("doc"), (F.col("l_suppkey") % 3).alias("run"), F.concat(F.lit("p"), (F.col("l_partkey") % 5).cast("string")).alias("s"), F.col("l_returnflag").alias("r"), F.col("l_linestatus").alias("o"))
    out = extraction.stability(runs)
    return out.withColumns({c: F.round(c, 6) for c in ("overlap", "disappearance", "new", "flip", "agreement")})


@query()
def greedy_edge_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines matched with themselves after a change of flags; some mentions have no id. Sequential by definition, so without SQL."""
    l = table(spark, sf_dir, "lineitem")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")

    def edges(side: int, r: Column) -> DataFrame:
        linked = F.col("l_linenumber") % 3 != side
        return l.select(
            F.col("l_orderkey").cast("string").alias("run_id"), F.lit(side).alias("side"), F.col("l_linenumber").alias("ordinal"), F.concat_ws(":", F.lit(side), "l_linenumber").alias("edge_id"),
            F.when(linked, part).alias("s_id"), F.concat(F.lit("Part "), part).alias("s"), r.alias("r"), F.when(linked, supp).alias("o_id"), F.concat(F.lit("supplier "), supp).alias("o"),
        )

    flag = F.col("l_returnflag")
    after = F.when(F.col("l_linenumber") == 1, "X").when(flag == "R", "returned").otherwise(flag)
    return extraction.greedy_matches(edges(0, flag).unionByName(edges(1, after)), {"returned": "R"})


CANDIDATES = """WITH c AS (SELECT l_orderkey::VARCHAR AS document_id, l_orderkey || ':' || l_linenumber AS intervention_id, CASE l_linenumber % 3 WHEN 0 THEN 'schema' WHEN 1 THEN 'prompt_clause' ELSE 'sentence' END AS target_type,
  CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_returnflag = 'A' THEN 'drop:P1' ELSE 'coarse' END WHEN 1 THEN CASE WHEN l_returnflag = 'A' THEN 'C1_evidence_only' WHEN l_returnflag = 'R' THEN 'C3_use_schema' ELSE 'C9' END ELSE 's' || l_linenumber END AS target_id,
  CASE WHEN l_returnflag = 'R' THEN 'mask' ELSE 'remove' END AS operator, l_returnflag AS cause_family, l_quantity AS estimated_cost, (l_orderkey + l_linenumber) % 4 = 0 AS changed FROM lineitem),
v AS (SELECT l_orderkey::VARCHAR AS document_id, 's' || l_linenumber AS target_id, count(*) AS cited FROM lineitem WHERE l_tax > 0.03 GROUP BY ALL),
cf AS (SELECT c.*, CASE WHEN target_type = 'schema' THEN 0 WHEN target_type = 'prompt_clause' THEN 1 WHEN cited IS NOT NULL THEN 2 ELSE 3 END AS tier, CASE WHEN target_type = 'sentence' THEN (operator <> 'mask')::INT ELSE 0 END AS removal,
  CASE WHEN target_type = 'schema' THEN CASE WHEN target_id LIKE 'drop:%' THEN 8.0 ELSE 6.0 END WHEN target_type = 'prompt_clause' THEN CASE target_id WHEN 'C1_evidence_only' THEN 5.0 WHEN 'C3_use_schema' THEN 4.0 ELSE 2.0 END WHEN cited IS NOT NULL THEN 3.0 + cited ELSE 0.5 END::DOUBLE AS worth FROM c LEFT JOIN v USING (document_id, target_id))
"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, flag = F.col("l_linenumber") % 3, F.col("l_returnflag")
    target = F.when(n == 0, F.when(flag == "A", "drop:P1").otherwise("coarse")).when(n == 1, F.when(flag == "A", "C1_evidence_only").when(flag == "R", "C3_use_schema").otherwise("C9")).otherwise(F.concat(F.lit("s"), "l_linenumber"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("document_id"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("intervention_id"), F.when(n == 0, "schema").when(n == 1, "prompt_clause").otherwise("sentence").alias("target_type"), target.alias("target_id"),
        F.when(flag == "R", "mask").otherwise("remove").alias("operator"), flag.alias("cause_family"), F.col("l_quantity").alias("estimated_cost"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 4 == 0).alias("changed"),
    )


@query(CANDIDATES + """SELECT * FROM (SELECT 'random' AS planner, document_id, intervention_id, row_number() OVER (PARTITION BY document_id ORDER BY sha256('0|' || intervention_id)) AS rank FROM c
UNION ALL SELECT 'cheapest', document_id, intervention_id, row_number() OVER (PARTITION BY document_id ORDER BY estimated_cost, sha256('0|' || intervention_id)) FROM c
UNION ALL SELECT 'schema_only', document_id, intervention_id, row_number() OVER (PARTITION BY document_id ORDER BY sha256('0|' || intervention_id)) FROM c WHERE target_type = 'schema'
UNION ALL SELECT 'coarse_to_fine', document_id, intervention_id, row_number() OVER (PARTITION BY document_id ORDER BY tier, removal, -worth / estimated_cost, sha256('0|' || intervention_id)) FROM cf
UNION ALL SELECT 'round_robin', document_id, intervention_id, row_number() OVER (PARTITION BY document_id ORDER BY t, cause_family) FROM (SELECT *, row_number() OVER (PARTITION BY document_id, cause_family ORDER BY sha256('0|' || intervention_id)) AS t FROM c)) WHERE rank <= 2""")
def budget_planners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five planners with a budget of two per document."""
    c, out = _candidates(spark, sf_dir), None
    cited = table(spark, sf_dir, "lineitem").where("l_tax > 0.03").select(F.col("l_orderkey").cast("string").alias("document_id"), F.concat(F.lit("s"), "l_linenumber").alias("sentence_id"))
    for name in ("random", "cheapest", "schema_only", "coarse_to_fine", "round_robin"):
        made = planning.coarse_to_fine(c, 2, evidence=cited) if name == "coarse_to_fine" else planning.planner(name)(c, 2)
        part = made.select(F.lit(name).alias("planner"), "document_id", "intervention_id", F.col("rank").cast("long").alias("rank"))
        out = part if out is None else out.unionByName(part)
    return out


@query(CANDIDATES + """, k AS (SELECT 'random' AS planner, changed, row_number() OVER (PARTITION BY document_id ORDER BY sha256('0|' || intervention_id)) AS rank FROM c UNION ALL SELECT 'cheapest', changed, row_number() OVER (PARTITION BY document_id ORDER BY estimated_cost, sha256('0|' || intervention_id)) FROM c)
SELECT planner, b.b AS budget, count(*) AS selected, count(*) FILTER (changed) AS found, round(count(*) FILTER (changed) / (SELECT count(*) FROM c WHERE changed)::DOUBLE, 6) AS share FROM k JOIN (SELECT unnest([1, 2, 3, 5]) AS b) b ON rank <= b.b GROUP BY ALL""")
def budget_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of the changes two planners find, by budget per document."""
    c = _candidates(spark, sf_dir)
    parts = [planning.budget_curve(planning.planner(name)(c, 1 << 30), (1, 2, 3, 5), "changed").select(F.lit(name).alias("planner"), "budget", "selected", "found", F.round("share", 6).alias("share")) for name in ("random", "cheapest")]
    return parts[0].unionByName(parts[1])


@query()
def adaptive_planner(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).withColumn("family_yield", F.when(F.col("cause_family") == "R", 0.5).otherwise(0.1)).withColumn("group_yield", F.col("estimated_cost") / 50)
    return planning.adaptive(c, 4).select("document_id", "intervention_id", "rank")


@query()
def budgeted_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a nation's suppliers as a stream of pairs, by price under a budget; what is taken depends on what was seen."""
    l, supp = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("string").alias("stream"))
    pairs = l.join(supp, "l_suppkey").select("stream", F.concat_ws(":", "l_orderkey", "l_linenumber").alias("run_id"), F.col("l_returnflag").alias("family"), F.col("l_extendedprice").alias("priority"), F.col("l_quantity").alias("cost"), (F.col("l_discount") > 0.06).alias("violated"))
    return planning.budgeted_stream(pairs, 20_000.0)


@query(r"""WITH p AS (SELECT doc, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM (SELECT conv_id || ':' || turn AS doc, regexp_extract_all(text, '[ \t\n\x0B\f\r]+|[^ \t\n\x0B\f\r]+') AS pieces FROM conversations)),
k AS (SELECT doc, i, row_number() OVER (PARTITION BY doc ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc) AS n FROM p WHERE NOT regexp_matches(piece, '^[ \t\n\x0B\f\r]')),
r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY sha256('7' || chr(31) || doc || chr(31) || k), k) AS rank FROM k), l AS (SELECT unnest([0.1::DOUBLE, 0.3::DOUBLE, 0.6::DOUBLE]) AS level),
m AS (SELECT r.doc, l.level, count(*) FILTER (rank <= least(n, greatest(1, ceil(level * n)))) AS changed, count(*) AS eligible, sha256(coalesce(string_agg(k::VARCHAR, chr(10) ORDER BY k::VARCHAR) FILTER (rank <= least(n, greatest(1, ceil(level * n)))), '')) AS digest FROM r CROSS JOIN l GROUP BY ALL),
x AS (SELECT p.doc, l.level, string_agg(CASE WHEN r.rank <= least(r.n, greatest(1, ceil(l.level * r.n))) THEN '[MASK]' ELSE p.piece END, '' ORDER BY p.i) AS text FROM p CROSS JOIN l LEFT JOIN r ON r.doc = p.doc AND r.i = p.i GROUP BY ALL)
SELECT m.doc, m.level, changed, eligible, round(changed / eligible::DOUBLE, 6) AS magnitude, digest, sha256(text) AS text FROM m JOIN x ON x.doc = m.doc AND x.level = m.level""")
def nested_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extraction.mask_nested(table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("doc"), "text"), (0.1, 0.3, 0.6))
    return out.withColumn("magnitude", F.round("magnitude", 6)).withColumn("text", F.sha2("text", 256))


MENTIONS = """WITH e AS (SELECT l_orderkey AS run_id, l_linenumber % 2 AS side, l_linenumber AS edge_id, CASE WHEN l_linenumber % 3 <> 0 THEN 'i' || (l_partkey % 40) END AS s_id, 'Part ' || (l_partkey % 40) AS s, l_returnflag AS r,
  CASE WHEN l_linenumber % 4 <> 0 THEN 'j' || (l_suppkey % 30) END AS o_id, ' supplier ' || (l_suppkey % 30) AS o, l_discount AS disc FROM lineitem),
u AS (SELECT run_id, lower(trim(s)) AS k FROM e WHERE s_id IS NULL UNION SELECT run_id, lower(trim(o)) FROM e WHERE o_id IS NULL)
"""


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as edges of an order's two views; some mentions have no id, and some names lie within others."""
    n, part, supp = F.col("l_linenumber"), (F.col("l_partkey") % 40).cast("string"), (F.col("l_suppkey") % 30).cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (n % 2).alias("side"), n.alias("edge_id"), F.when(n % 3 != 0, F.concat(F.lit("i"), part)).alias("s_id"), F.concat(F.lit("Part "), part).alias("s"),
        F.col("l_returnflag").alias("r"), F.when(n % 4 != 0, F.concat(F.lit("j"), supp)).alias("o_id"), F.concat(F.lit(" supplier "), supp).alias("o"), F.col("l_discount").alias("disc"),
    )


@query(MENTIONS + """, n AS (SELECT DISTINCT run_id, k, id FROM (SELECT run_id, s_id AS id, lower(trim(s)) AS k FROM e UNION ALL SELECT run_id, o_id, lower(trim(o)) FROM e) WHERE id IS NOT NULL),
d AS (SELECT run_id, k, min(id) AS id FROM n GROUP BY ALL HAVING count(*) = 1), c AS (SELECT u.run_id, u.k, min(n.id) AS id FROM u JOIN n ON n.run_id = u.run_id AND (contains(n.k, u.k) OR contains(u.k, n.k)) GROUP BY ALL HAVING count(DISTINCT n.id) = 1),
x AS (SELECT u.run_id, u.k, coalesce('id:' || d.id, 'id:' || c.id, 'name:' || u.k) AS key FROM u LEFT JOIN d USING (run_id, k) LEFT JOIN c USING (run_id, k))
SELECT e.run_id, side, edge_id, coalesce('id:' || s_id, a.key) AS s, r, coalesce('id:' || o_id, z.key) AS o FROM e LEFT JOIN x a ON a.run_id = e.run_id AND a.k = lower(trim(s)) LEFT JOIN x z ON z.run_id = e.run_id AND z.k = lower(trim(o))""")
def paired_entity_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges under keys that both views share: ids, names known by an id in the pair, names within such names."""
    return pairing.paired_triples(_mentions(spark, sf_dir).drop("disc"))


@query(MENTIONS + """, g AS (SELECT DISTINCT run_id, 'i' || regexp_extract(s, '\\d+') AS h, r, 'j' || regexp_extract(o, '\\d+') AS t, lower(trim(s)) AS hk, lower(trim(o)) AS tk FROM e WHERE disc <= 0.05), n AS (SELECT DISTINCT run_id, k, id FROM (SELECT run_id, h AS id, hk AS k FROM g UNION ALL SELECT run_id, t, tk FROM g)),
d AS (SELECT run_id, k, min(id) AS id, count(*) AS c FROM n GROUP BY ALL), c AS (SELECT u.run_id, u.k, min(n.id) AS id FROM u JOIN n ON n.run_id = u.run_id AND (contains(n.k, u.k) OR contains(u.k, n.k)) WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.run_id = u.run_id AND d.k = u.k) GROUP BY ALL HAVING count(DISTINCT n.id) = 1),
x AS (SELECT u.run_id, u.k, coalesce(CASE WHEN d.c = 1 THEN d.id END, c.id) AS id FROM u LEFT JOIN d USING (run_id, k) LEFT JOIN c USING (run_id, k)),
f AS (SELECT DISTINCT e.run_id, coalesce(s_id, a.id) AS h, r, coalesce(o_id, z.id) AS t FROM e LEFT JOIN x a ON a.run_id = e.run_id AND a.k = lower(trim(s)) LEFT JOIN x z ON z.run_id = e.run_id AND z.k = lower(trim(o)) WHERE side = 1),
y AS (SELECT g.run_id, count(f.h) / count(*)::DOUBLE AS recall FROM (SELECT DISTINCT run_id, h, r, t FROM g) g LEFT JOIN f ON f.run_id = g.run_id AND f.h = g.h AND f.r = g.r AND f.t = g.t GROUP BY g.run_id)
SELECT k.run_id, round(coalesce(recall, 0.0), 6) AS recall FROM (SELECT DISTINCT run_id FROM e WHERE side = 1) k LEFT JOIN y USING (run_id)""")
def gold_recall_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of one view's edges against gold; mentions without an id are looked for among the gold names."""
    e = _mentions(spark, sf_dir)
    number = lambda kind, c: F.concat(F.lit(kind), F.regexp_extract(c, r"\d+", 0))
    gold = e.where("disc <= 0.05").select("run_id", number("i", "s").alias("head_id"), F.col("s").alias("head"), "r", number("j", "o").alias("tail_id"), F.col("o").alias("tail"))
    return pairing.gold_recall(e.where("side = 1"), gold).withColumn("recall", F.round("recall", 6))


@query("""WITH s AS (SELECT 'd' || conv_id AS d, turn AS i, 'd' || conv_id || '::s' || turn AS sid FROM conversations), r AS (SELECT 'd' || conv_id AS d, role, count(*) AS n FROM conversations WHERE role <> 'OTHER' AND role <> '' GROUP BY ALL),
k AS (SELECT d, role, row_number() OVER (PARTITION BY d ORDER BY n DESC, role) AS k FROM r), a AS (SELECT d, string_agg(role, ',' ORDER BY k) AS rels FROM k WHERE k <= 3 GROUP BY d), docs AS (SELECT DISTINCT d FROM s)
SELECT d AS document_id, d || '::iv::sent::' || sid || '::' || o.o AS intervention_id, o.o AS operator, 'evidence' AS cause_family, 'semantic' AS semantic_class FROM s, (SELECT unnest(['remove', 'mask']) AS o) o
UNION ALL SELECT d, d || '::iv::' || f.x.t, f.x.o, f.x.f, f.x.c FROM docs, (SELECT unnest([{'t': 'sent::doc::para_swap', 'o': 'para_swap', 'f': 'evidence', 'c': 'presentation'}, {'t': 'sent::doc::entity_alias', 'o': 'entity_alias', 'f': 'entity_alias', 'c': 'presentation'}, {'t': 'noop::repeat::0', 'o': 'repeat', 'f': 'stochastic', 'c': 'stochastic'}, {'t': 'noop::repeat::1', 'o': 'repeat', 'f': 'stochastic', 'c': 'stochastic'}, {'t': 'model::swap::m2', 'o': 'swap', 'f': 'model', 'c': 'model'},
  {'t': 'schema::S::with_other', 'o': 'switch_schema', 'f': 'schema', 'c': 'semantic'}, {'t': 'schema::S::coarse', 'o': 'switch_schema', 'f': 'schema', 'c': 'semantic'}]) AS x) f
UNION ALL SELECT d, d || '::iv::prompt::P::drop::' || c.c, 'remove', 'prompt', 'semantic' FROM docs, (SELECT unnest(['C1_evidence_only', 'C2_infer_implicit', 'C3_use_schema', 'C4_allow_other', 'C5_cite_evidence', 'C6_return_confidence']) AS c) c
UNION ALL SELECT d, d || '::iv::prompt::P::tone::' || c.c, 'tone', 'prompt', 'presentation' FROM docs, (SELECT unnest(['strict', 'permissive', 'terse']) AS c) c UNION ALL SELECT d, d || '::iv::prompt::P::role::' || c.c, 'role_swap', 'prompt', 'presentation' FROM docs, (SELECT unnest(['expert', 'novice', 'auditor']) AS c) c
UNION ALL SELECT d, d || '::iv::schema::S::' || c.c, 'switch_schema', 'schema', 'presentation' FROM docs, (SELECT unnest(['rename', 'reorder', 'desc_added', 'desc_removed', 'hierarchical']) AS c) c
UNION ALL SELECT d, d || '::iv::schema::S::ambiguous' || coalesce(':' || rels, ''), 'switch_schema', 'schema', 'semantic' FROM docs LEFT JOIN a USING (d) UNION ALL SELECT d, d || '::iv::schema::S::drop::' || role, 'switch_schema', 'schema', 'semantic' FROM k WHERE k <= 3""")
def intervention_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that may be changed about the extraction of each conversation; its turns stand for sentences, its roles for relations."""
    c = table(spark, sf_dir, "conversations").withColumn("document_id", F.concat(F.lit("d"), "conv_id"))
    sentences = c.select("document_id", F.concat_ws("::s", "document_id", "turn").alias("sentence_id"), F.col("turn").alias("sentence_index"))
    relations = interventions.relation_candidates(c.select("document_id", F.col("role").alias("relation")), spark.createDataFrame([], "document_id string, relation string"))
    found = interventions.candidates(c.select("document_id").distinct(), sentences, relations, "P", "S", models=("m2",))
    return found.select("document_id", "intervention_id", "operator", "cause_family", "semantic_class")


@query("""WITH t AS (SELECT conv_id AS doc, turn AS place, text FROM conversations)
SELECT 'remove' AS kind, doc, place, text FROM t WHERE place <> 1 UNION ALL SELECT 'mask', doc, place, CASE WHEN place = 1 THEN '[MASKED]' ELSE text END FROM t
UNION ALL SELECT 'shuffle', doc, row_number() OVER (PARTITION BY doc ORDER BY sha256('7|' || doc || '|' || place)) - 1, text FROM t""")
def sentence_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as sentences: one removed, one masked, all in another order."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").cast("long").alias("place"), "text")
    parts = [extraction.sentence_variant(t, kind, 1).select(F.lit(kind).alias("kind"), "doc", F.col("place").cast("long").alias("place"), "text") for kind in ("remove", "mask", "shuffle")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""WITH e AS (SELECT date_trunc('hour', ts) AS start, event_type AS cause_family, value FROM events)
SELECT start, cause_family, count(*) AS n, round(avg((value > 50)::INT), 6) AS violation_rate FROM e GROUP BY ALL""")
def drift_monitor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream monitor's windows, here over the events as a batch."""
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("created_at"), F.col("event_id").alias("run_id"), F.col("event_type").alias("cause_family"), F.col("value").alias("drift"))
    return violation_windows(e, 50.0).select(F.col("start").cast("timestamp_ntz").alias("start"), "cause_family", "n", F.round("violation_rate", 6).alias("violation_rate"))
