"""Documents of a corpus with global concepts joined to a lineage's documents with local entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftloom.operators.lineage import latest


def concept_map(documents: DataFrame, raw: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((document_id, entity_id, concept, name, aliases, type), (document_id, problem)).

    ``documents`` (position, document_id, title) and ``raw`` (position, title, concepts) are the same documents by position; a raw
    document without title is called cdr_ and its position. Its concepts are in the order in which mentions were
    accepted, each once; the document's ``entities`` (document_id, entity_id, name, aliases, type) get them in order of the number
    at the end of their id. A document that has no raw one, another title or another number of entities has a problem
    (``missing``, ``title``, ``entity_count``) and maps nothing.
    """
    expected = F.coalesce(F.when(F.col("_raw.title") != "", F.col("_raw.title")), F.concat(F.lit("cdr_"), F.col("position").cast("string")))
    both = documents.join(raw.select("position", F.struct("title", "concepts").alias("_raw")), "position", "left").withColumn("_expected", expected)
    numbered = entities.withColumn("_k", F.row_number().over(W.partitionBy("document_id").orderBy(F.regexp_extract("entity_id", r"(\d+)$", 1).try_cast("long"), "entity_id")))
    counts = entities.groupBy("document_id").agg(F.count("*").alias("_n"))
    concepts = F.coalesce("_raw.concepts", F.array().cast("array<string>"))
    problem = F.when(F.col("_raw").isNull(), "missing").when(~F.col("title").eqNullSafe(F.col("_expected")), "title").when(F.coalesce("_n", F.lit(0)) != F.size(concepts), "entity_count")
    judged = both.join(counts, "document_id", "left").select("document_id", concepts.alias("_c"), problem.alias("problem"))
    each = judged.where("problem is null").select("document_id", F.posexplode("_c").alias("_p", "concept")).withColumn("_k", F.col("_p") + 1)
    mapping = each.join(numbered, ["document_id", "_k"]).select("document_id", "entity_id", "concept", "name", "aliases", "type")
    return mapping, judged.where("problem is not null").select("document_id", "problem")


def concept_registry(mapping: DataFrame) -> DataFrame:
    """(concept, n_documents, n_names, n_types): in how many documents a concept is, and under how many names (aliases too) and types. Counted in rows, so that a concept of very many documents is no long list."""
    named = mapping.select("concept", F.explode(F.array_union(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("v")).where("v <> ''")
    facts = mapping.select("concept", F.lit("d").alias("k"), F.col("document_id").cast("string").alias("v")).unionByName(named.select("concept", F.lit("n").alias("k"), "v")).unionByName(mapping.where("type <> ''").select("concept", F.lit("t").alias("k"), F.col("type").alias("v")))
    n = lambda k: F.count_if(F.col("k") == k)
    return facts.distinct().groupBy("concept").agg(n("d").alias("n_documents"), n("n").alias("n_names"), n("t").alias("n_types"))


def mapped_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """``edges`` (document_id, s, r, o) with ``cs`` and ``co``: the concepts of their local ends, null where there is none."""
    at = lambda end: mapping.select(F.col("document_id"), F.col("entity_id").alias(end), F.col("concept").alias(f"c{end}"))
    return edges.join(at("s"), ["document_id", "s"], "left").join(at("o"), ["document_id", "o"], "left")


def base_events(runs: DataFrame) -> DataFrame:
    """(document_id, base_event_id): of a document's successful runs with a base event the last by time, then id."""
    return latest(runs.where("status = 'ok' and base_event_id is not null"), ["document_id"], ["created_at", "run_id"]).select("document_id", "base_event_id")


def map_inputs(documents: DataFrame, raw: DataFrame, entities: DataFrame, gold: DataFrame, runs: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(mapping, gold, base, audit): distinct gold and base edges (document_id, s, r, o) between concepts, and one row that says what was mapped.

    ``edges`` have event_id beside their columns; those of each document's base event count. Edges without relation or
    with an end that has no concept are left out and counted. Documents without a base event are a problem too.
    """
    mapping, problems = concept_map(documents, raw, entities)
    asked = documents.select("document_id")
    truth = mapped_edges(gold.join(asked, "document_id", "left_semi"), mapping)
    chosen = base_events(runs).join(asked, "document_id", "left_semi")
    base = mapped_edges(edges.join(chosen.select("document_id", F.col("base_event_id").alias("event_id")), ["document_id", "event_id"], "left_semi"), mapping)
    whole = F.col("cs").isNotNull() & F.col("co").isNotNull()
    usable = whole & (F.col("r") != "")
    registry = concept_registry(mapping)
    repeated = registry.where("n_documents >= 2").select("concept")
    numbers = [
        documents.agg(F.count("*").alias("n_documents")), mapping.agg(F.count("*").alias("n_entities")), registry.agg(F.count("*").alias("n_concepts"), F.count_if(F.col("n_documents") >= 2).alias("n_repeated_concepts")),
        mapping.join(repeated, "concept", "left_semi").agg(F.count_distinct("document_id").alias("n_documents_with_repeated")), problems.agg(F.count("*").alias("n_problems")),
        documents.join(chosen, "document_id", "left_anti").agg(F.count("*").alias("n_without_base")), truth.agg(F.count_if(~whole).alias("unmapped_gold")),
        base.agg(F.count("*").alias("base_edges"), F.count_if(usable).alias("mapped_base_edges")),
    ]
    audit = numbers[0]
    for one in numbers[1:]:
        audit = audit.crossJoin(one)  # one row each
    rate = F.when(F.col("base_edges") > 0, F.col("mapped_base_edges") / F.col("base_edges")).otherwise(0.0)
    columns = ["document_id", F.col("cs").alias("s"), "r", F.col("co").alias("o")]
    return mapping, truth.where(whole).select(*columns).distinct(), base.where(usable).select(*columns).distinct(), audit.withColumn("mapping_rate", rate)
