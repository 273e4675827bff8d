"""The graph-wide diagnostic queries by their ids, and the summary of how far they drift."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftloom.operators import views
from driftloom.operators.statistics import cluster_bootstrap

#: The ids of the queries, and how many nodes the fourth one ranks.
DIAGNOSTICS = ("diagnostic.edge_identity", "diagnostic.two_hop_endpoints", "diagnostic.fanout_join", "diagnostic.top_undirected_degree", "diagnostic.short_connectivity")
TOP_NODES = 5


def _known(query: str) -> str:
    if query not in DIAGNOSTICS:
        raise KeyError(f"{query} is not one of {', '.join(DIAGNOSTICS)}")
    return query


def answers(query: str, elements: DataFrame, families: views.Families) -> DataFrame:
    """(doc, …, mask): the answers of a query on all views at once, each with the views that give it."""
    match _known(query):
        case "diagnostic.edge_identity":
            return elements
        case "diagnostic.two_hop_endpoints":
            return views.two_hop_endpoints(elements)
        case "diagnostic.fanout_join":
            one = elements.select("doc", F.col("s").alias("h"), "r", "o", "mask")
            other = one.withColumnsRenamed({"r": "r2", "o": "o2"})
            return views.joined(one, other, ["doc", "h"], "r < r2")
        case "diagnostic.top_undirected_degree":
            return views.as_masks(views.top_nodes(views.neighbour_degrees(elements, families), families, TOP_NODES), families, ["node"])
        case _:
            return views.short_connectivity(elements)


def drift(query: str, docs: DataFrame, elements: DataFrame, families: views.Families) -> DataFrame:
    """(family, doc, drift): one less the Jaccard of a query's answers on the base view and on each counterfactual one; the fan-out join is counted, not listed."""
    if _known(query) == "diagnostic.fanout_join":
        found = views.fanout_jaccard(docs, elements, families, "jaccard")
    else:
        found = views.jaccard(docs, answers(query, elements, families), families)
    return found.select("family", "doc", (1 - F.col("jaccard")).alias("drift"))


def diagnostic_records(docs: DataFrame, elements: DataFrame, families: views.Families, queries: tuple[str, ...] = DIAGNOSTICS) -> DataFrame:
    """(query, family, doc, query_drift, graph_drift, amplification) of every pair and query."""
    graph = drift(DIAGNOSTICS[0], docs, elements, families).withColumnRenamed("drift", "graph_drift")
    out = None
    for q in queries:
        own = drift(q, docs, elements, families).select(F.lit(q).alias("query"), "family", "doc", F.col("drift").alias("query_drift")).join(graph, ["family", "doc"])  # before the union, which does not keep documents together
        out = own if out is None else out.unionByName(own)
    return out.withColumn("amplification", views.amplification(F.col("query_drift"), F.col("graph_drift")))


def diagnostic_summary(records: DataFrame, replicates: int) -> DataFrame:
    """(query, field, part, n, n_documents, query_drift, graph_drift, amplification, ratio_of_means, low, high) of records (query, cause_family, semantic_class, doc, query_drift, graph_drift, amplification).

    ``field`` is ``all``, ``cause_family`` or ``semantic_class``, and ``part`` one of its values (null for ``all``), in one
    aggregation by grouping sets. low and high are the interval of the mean amplification over resampled documents, for ``all``.
    """
    sets = records.groupingSets([["query"], ["query", "cause_family"], ["query", "semantic_class"]], "query", "cause_family", "semantic_class")
    means = [F.avg(c).alias(c) for c in ("query_drift", "graph_drift", "amplification")]
    found = sets.agg(F.grouping_id("query", "cause_family", "semantic_class").alias("_g"), F.count("*").alias("n"), F.count_distinct("doc").alias("n_documents"), *means)
    field = F.when(F.col("_g") == 1, "cause_family").when(F.col("_g") == 2, "semantic_class").otherwise("all")
    named = found.select("query", field.alias("field"), F.when(F.col("_g") == 1, F.col("cause_family")).when(F.col("_g") == 2, F.col("semantic_class")).alias("part"), "n", "n_documents", "query_drift", "graph_drift", "amplification", views.amplification(F.col("query_drift"), F.col("graph_drift")).alias("ratio_of_means"))
    ends = cluster_bootstrap(records, "doc", "amplification", replicates, ["query"]).select("query", F.lit("all").alias("field"), "low", "high")
    return named.join(ends, ["query", "field"], "left")
