"""Registered queries of the corpus operators; each applies its operator to the whole intended table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spool, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query
def op6_content_addressed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import idstore

    idstore.write(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), path := idstore.fresh_path(spark))
    return idstore.read(spark, path, checksums=True)


@query
def op9_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lexicon import transcode

    coded = transcode(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))
    return coded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_block_matrix_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import search

    rows = table(spark, sf_dir, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"), 20)


ORACLES["op4_block_matrix_neighbours"] = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op10_embedding_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op2_tree_scored_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract

    return extract(table(spark, sf_dir, "pages"))


@query
def op5_columnar_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import digests, format_chat

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return digests(spool(format_chat(turns.unionByName(own)), "chat"))


@query
def op8_hierarchical_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op7_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .private_data import digest

    return digest(table(spark, sf_dir, "documents"))


@query
def op3_token_group_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard import ngram_jaccard_components

    return ngram_jaccard_components(table(spark, sf_dir, "documents"))


@query
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_interactions

    return filter_interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op11_filter_interactions"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), l AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY ALL
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
    doc_id IS DISTINCT FROM min(doc_id) OVER (PARTITION BY text) AS e
  FROM t LEFT JOIN l USING (doc_id)
), m AS (
  SELECT part, list_filter([CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END], lambda x: x IS NOT NULL) AS failed,
    count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c), o AS (
  SELECT x1.c || x2.c || x3.c || x4.c || x5.c AS filter_order FROM x x1, x x2, x x3, x x4, x x5 WHERE len(list_distinct([x1.c, x2.c, x3.c, x4.c, x5.c])) = 5
), s AS (SELECT filter_order, unnest(range(1, 6)) AS step FROM o), r AS (
  SELECT part, filter_order, step,
    sum(n) FILTER (NOT list_has_any(failed, string_split(filter_order[:step], ''))) AS kept,
    sum(n) FILTER (list_contains(failed, filter_order[step]) AND NOT list_has_any(failed, string_split(filter_order[:step - 1], ''))) AS removed,
    sum(n) FILTER (list_contains(failed, filter_order[step]) AND list_has_any(failed, string_split(filter_order[:step - 1], ''))) AS redundant,
    sum(n) FILTER (failed = [filter_order[step]]) AS unique_fails,
    sum(good) FILTER (list_contains(failed, filter_order[step]) AND NOT list_has_any(failed, string_split(filter_order[:step - 1], ''))) AS good_lost,
    sum(toxic) FILTER (list_contains(failed, filter_order[step]) AND NOT list_has_any(failed, string_split(filter_order[:step - 1], ''))) AS toxic_lost
  FROM m, s GROUP BY ALL
)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, filter_order[step]), 0)::BIGINT AS shapley
FROM r
"""


@query
def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .word_runs import digests, repeat_periodically, word_runs

    return digests(word_runs(repeat_periodically(table(spark, sf_dir, "documents"))))


@query
def op13_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op13_block_naming"] = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(text) AS text_sha256 FROM t WINDOW w AS (PARTITION BY text)
"""
