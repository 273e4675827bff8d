"""Cross-document cohorts: pairs of documents that only together answer a question, and what is measured on them.

Edges are (doc, s, r, o). A pair of documents answers ``fanout`` if both have an edge from one head and the two tails
differ, and ``shared_tail`` if both have an edge into one tail and the two heads differ. Pairs come out of the join on the
shared node, so documents without an answer in common never meet. A node of n documents costs n² / 2 rows of that join,
which stay in the task of the node: a document leaves it with its first partner there, so what is shuffled and written
grows with edges and not with pairs.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.operators import graph_queries
from driftloom.sources.store import discard, written

SHAPES = ("fanout", "shared_tail")


def answering_pairs(edges: DataFrame) -> DataFrame:
    """(doc_a, doc_b), doc_a before doc_b: the documents that answer either question together."""
    e = edges.select("doc", "s", "o").distinct()
    found = None
    for key, leaf in (("s", "o"), ("o", "s")):
        a, b = (e.select(key, F.col("doc").alias(f"doc_{x}"), F.col(leaf).alias(f"_{x}")) for x in "ab")
        pairs = a.join(b, key).where("doc_a < doc_b and _a <> _b").select("doc_a", "doc_b")
        found = pairs if found is None else found.unionByName(pairs)
    return found.distinct()


def pairs_on_heads(edges: DataFrame, head: str, tail: str, partitions: int) -> DataFrame:
    """(doc_a, doc_b, n_heads): documents with different tails at one head, and at how many heads; ``edges`` (doc, head, tail) are different ones.

    A head's pairs are made different where the head is, and counted in ``partitions`` tasks; a number that follows the
    input keeps the memory of a task.
    """
    a, b = (edges.select(head, F.col("doc").alias(f"doc_{x}"), F.col(tail).alias(f"_{x}")) for x in "ab")
    each = a.join(b, head).where("doc_a < doc_b and _a <> _b").select(head, "doc_a", "doc_b").distinct()
    return each.select("doc_a", "doc_b").repartition(partitions, "doc_a", "doc_b").groupBy("doc_a", "doc_b").agg(F.count("*").alias("n_heads"))


def canonical_list(*values: Column | str) -> Column:
    """SHA-256 of the values as a JSON list of strings."""
    return F.sha2(F.to_json(F.array(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in values))), 256)


def pair_rank(design: str, a: Column, b: Column, plain: bool = False) -> Column:
    """What puts pairs in order, and knows nothing of what a model gave out: a digest of the design and both documents.

    ``plain`` documents are numbers, whose JSON needs no escapes, so that a pair is put together from strings.
    """
    if not plain:
        return canonical_list(design, a, b, "cohort-rank")
    quoted = F.concat(F.lit(json.dumps([design], ensure_ascii=False)[:-1] + ',"'), a.cast("string"), F.lit('","'), b.cast("string"), F.lit('","cohort-rank"]'))
    return F.sha2(quoted, 256)


#: Hexadecimal digits of a rank by which pairs of a document are compared: 60 bits, which are one long.
RANK_DIGITS = 15


def first_partners(edges: DataFrame, design: str) -> DataFrame:
    """(doc, other): with whom each document of ``edges`` (doc, s, o) makes its first pair by rank; documents without a pair are left out.

    Pairs are made where their node is and reduced there to one row per document and node, without a sort or a shuffle.
    """
    plain = edges.schema["doc"].dataType.simpleString() in ("int", "bigint")
    found = None
    for key, leaf in (("s", "o"), ("o", "s")):
        a, b = (edges.select(key, F.col("doc").alias(f"doc_{x}"), F.col(leaf).alias(f"_{x}")) for x in "ab")
        rank = F.conv(F.substring(pair_rank(design, F.col("doc_a"), F.col("doc_b"), plain), 1, RANK_DIGITS), 16, 10).cast("long")
        pairs = a.join(b, key).where("doc_a < doc_b and _a <> _b").select(key, "doc_a", "doc_b", rank.alias("rank"))
        ends = pairs.select(key, "rank", F.explode(F.array(*(F.struct(F.col(f"doc_{x}").alias("doc"), F.col(f"doc_{y}").alias("other")) for x, y in ("ab", "ba")))).alias("x")).select(key, "rank", "x.doc", "x.other")
        near = ends.groupBy(key, "doc").agg(F.min("rank").alias("rank"), F.min_by("other", "rank").alias("other")).select("doc", "rank", "other")
        found = near if found is None else found.unionByName(near)
    return found.groupBy("doc").agg(F.min_by("other", "rank").alias("other"))


def disjoint_pairs(edges: DataFrame, design: str) -> DataFrame:
    """The pairs (doc_a, doc_b) that a greedy pass in order of rank takes from the answering pairs of ``edges`` (doc, s, o), no document twice.

    A pair that is the first of both its documents is taken by the pass whatever comes before it. So all such pairs are
    taken at once, their documents go, as do those that have no partner left, and the rest is looked at again, until no
    pair is left; the first of all pairs is always taken, and with digests for ranks about half of the documents go each
    time. Edges of what is left are written; pairs are made again from them and never kept.
    """
    left, taken = written(edges.select("doc", "s", "o").distinct(), "left"), []
    while True:
        first = written(first_partners(left, design), "first")
        taken.append(written(first.groupBy(F.least("doc", "other").alias("doc_a"), F.greatest("doc", "other").alias("doc_b")).count().where("count = 2").select("doc_a", "doc_b"), "taken"))
        if taken[-1].isEmpty():
            break
        gone = taken[-1].select(F.explode(F.array("doc_a", "doc_b")).alias("doc"))
        before, left = left, written(left.join(first.select("doc").join(gone, "doc", "left_anti"), "doc", "left_semi"), "left")
        discard(before)
        discard(first)
    out = taken[0]
    for t in taken[1:]:
        out = out.unionByName(t)
    return out


def build_cohort(gold: DataFrame, design: str, packets: int | None = None) -> DataFrame:
    """(packet, doc_a, doc_b, rank): disjoint pairs of documents that answer a question together, the first ``packets`` by rank.

    What is chosen depends on gold edges alone. Fewer pairs than ``packets`` raise. Documents without edges are in no pair.
    """
    chosen = disjoint_pairs(gold, design).withColumn("rank", pair_rank(design, F.col("doc_a"), F.col("doc_b")))
    if packets is not None:
        chosen = written(chosen.orderBy("rank", "doc_a", "doc_b").limit(packets), "cohort")
        if (n := chosen.count()) < packets:
            raise ValueError(f"{packets} packets are asked for; there are {n} disjoint pairs")
    name = F.concat(F.lit("packet-"), F.substring(canonical_list(design, F.col("doc_a"), F.col("doc_b")), 1, 12))
    return chosen.select(name.alias("packet"), "doc_a", "doc_b", "rank")


def packet_edges(edges: DataFrame, cohort: DataFrame) -> DataFrame:
    """(packet, …, source): the different edges of both documents of each packet, ``source`` being the document.

    Columns of ``edges`` besides ``doc`` are kept, so conditions can be packed together. An edge of a document in no packet goes.
    """
    of = cohort.select("packet", F.explode(F.array("doc_a", "doc_b")).alias("doc"))  # a document is in one packet
    return edges.distinct().join(of, "doc").select("packet", *(c for c in edges.columns if c != "doc"), F.col("doc").alias("source"))


def packet_answers(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(packet, …, shape, key, x, y): answers of both questions over the edges of packets, for each of ``by``."""
    keys = ["packet", *(by or [])]
    out = None
    for shape in SHAPES:
        found = graph_queries.cross_document(edges, keys, shape).select(*keys, F.lit(shape).alias("shape"), "key", "x", "y")
        out = found if out is None else out.unionByName(found)
    return out


def condition_masks(edges: DataFrame, conditions: list[str]) -> DataFrame:
    """(packet, s, r, o, source, mask) from a row per condition: bit i is set if the edge stands in condition i."""
    bit = F.lit(0)
    for i, c in enumerate(conditions):
        bit = F.when(F.col("condition") == c, 1 << i).otherwise(bit)
    return edges.groupBy("packet", "s", "r", "o", "source").agg(F.bit_or(bit).alias("mask"))


def answer_masks(edges: DataFrame, shape: str) -> DataFrame:
    """(packet, key, x, y, mask): answers of a question over ``edges`` with a mask, each with the conditions that give it.

    One join serves all conditions: an answer is in those of both its edges. Edges that lie together by packet are not shuffled.
    """
    key, leaf = ("s", "o") if shape == "fanout" else ("o", "s")
    e = edges.groupBy("packet", F.col(key).alias("key"), F.col(leaf).alias("x"), F.col("source").alias("d")).agg(F.bit_or("mask").alias("mask"))
    other = e.select("packet", "key", F.col("x").alias("y"), F.col("d").alias("_d"), F.col("mask").alias("_m"))
    both = e.join(other, ["packet", "key"]).where("d <> _d and x < y").withColumn("mask", F.col("mask").bitwiseAND(F.col("_m"))).where("mask <> 0")
    return both.groupBy("packet", "key", "x", "y").agg(F.bit_or("mask").alias("mask"))


def _sized(edges: DataFrame, cohort: DataFrame, of_answers: dict[str, tuple[int, int]], of_graphs: dict[str, tuple[int, int]]) -> DataFrame:
    """A row per packet: ``_counts`` of its answers by question and of its graphs without and with source, 0 where it has none."""
    wide = cohort.select("packet")
    parts = {s: (answer_masks(edges, s), of_answers) for s in SHAPES}
    parts |= {g: (edges.groupBy("packet", *by).agg(F.bit_or("mask").alias("mask")), of_graphs) for g, by in (("semantic", ["s", "r", "o"]), ("provenance", ["s", "r", "o", "source"]))}
    for g, (rows, counted) in parts.items():
        wide = wide.join(_counts(rows, ["packet"], {f"{g}_{c}": v for c, v in counted.items()}), "packet", "left")
    return wide.fillna(0)


def _counts(rows: DataFrame, by: list[str], counted: dict[str, tuple[int, int]]) -> DataFrame:
    """Per ``by``: of masks, how many meet each (all of these bits, any of those bits)."""
    m = F.col("mask")
    return rows.groupBy(*by).agg(*(F.count_if((m.bitwiseAND(F.lit(every)) == every) & ((m.bitwiseAND(F.lit(some)) != 0) | F.lit(some == 0))).alias(n) for n, (every, some) in counted.items()))


def _share(part: str, whole: str, empty: float) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(empty))


def comparison_records(edges: DataFrame, cohort: DataFrame, comparisons: dict[str, tuple[str, str]], gold: str = "gold", conditions: list[str] | None = None) -> DataFrame:
    """One row per packet and comparison of two conditions of ``edges`` (packet, condition, s, r, o, source).

    With ``conditions``, edges have a mask of these in place of the condition.

    Drift of a graph is 1 - Jaccard of its edges, with their source documents (provenance) and without (semantic); drift
    of a question 1 - Jaccard of its answers; two empty sets have no drift. A question is active if gold answers it; the
    largest and mean drift are over active ones, and 0 without any. Packets without any edges have their rows, too.
    """
    if conditions is None:
        conditions = sorted({c for pair in comparisons.values() for c in pair} | {gold})
        edges = condition_masks(edges, conditions)
    bit = {c: 1 << i for i, c in enumerate(conditions)}
    sizes = {f"{n}_{k}": v for n, (a, b) in comparisons.items() for k, v in (("both", (bit[a] | bit[b], 0)), ("any", (0, bit[a] | bit[b])))}
    wide = _sized(edges, cohort, sizes | {"gold": (bit[gold], 0)}, sizes)

    def record(name: str) -> Column:
        drift = {g: 1 - _share(f"{g}_{name}_both", f"{g}_{name}_any", 1.0) for g in ("semantic", "provenance", *SHAPES)}
        active = F.filter(F.array(*(F.when(F.col(f"{s}_gold") > 0, drift[s]) for s in SHAPES)), lambda d: d.isNotNull())
        n = F.size(active)
        fields = [F.lit(name).alias("comparison"), drift["semantic"].alias("semantic_graph_drift"), drift["provenance"].alias("provenance_graph_drift"), F.coalesce(F.array_max(active), F.lit(0.0)).alias("max_query_drift"), F.when(n > 0, F.aggregate(active, F.lit(0.0), lambda a, d: a + d) / n).otherwise(0.0).alias("mean_query_drift")]
        for s in SHAPES:
            fields += [(F.col(f"{s}_gold") > 0).alias(f"{s}_active"), drift[s].alias(f"{s}_drift"), (F.col(f"{s}_{name}_any") == 0).alias(f"{s}_both_empty")]
        return F.struct(*fields)

    return wide.select("packet", F.explode(F.array(*map(record, comparisons))).alias("c")).select("packet", "c.*")


def quality_records(edges: DataFrame, cohort: DataFrame, conditions: list[str], gold: str = "gold", every: list[str] | None = None) -> DataFrame:
    """One row per packet and condition: precision, recall and F1 of its answers against gold's, macro over active questions, and F1 of its graphs.

    With ``every``, edges have a mask of these conditions in place of the condition.
    """
    if every is None:
        every = [*conditions, gold]
        edges = condition_masks(edges, every)
    bit = {c: 1 << i for i, c in enumerate(every)}
    sizes = {"gold": (bit[gold], 0)} | {f"{c}_{k}": v for c in conditions for k, v in (("own", (bit[c], 0)), ("hit", (bit[c] | bit[gold], 0)))}
    wide = _sized(edges, cohort, sizes, sizes)

    def f1(g: str, c: str) -> Column:
        both = F.col(f"{g}_{c}_own") + F.col(f"{g}_gold")
        return F.when(both > 0, 2.0 * F.col(f"{g}_{c}_hit") / both).otherwise(1.0)

    def record(c: str) -> Column:
        of = {"precision": lambda s: _share(f"{s}_{c}_hit", f"{s}_{c}_own", 0.0), "recall": lambda s: _share(f"{s}_{c}_hit", f"{s}_gold", 0.0), "f1": lambda s: f1(s, c)}
        active = {s: F.col(f"{s}_gold") > 0 for s in SHAPES}
        n = sum((a.cast("int") for a in active.values()), F.lit(0))
        fields = [F.lit(c).alias("condition"), *(F.when(n > 0, sum((F.when(active[s], get(s)).otherwise(0.0) for s in SHAPES), F.lit(0.0)) / n).otherwise(0.0).alias(f"macro_{k}") for k, get in of.items()), f1("semantic", c).alias("semantic_f1"), f1("provenance", c).alias("provenance_f1")]
        for s in SHAPES:
            fields += [active[s].alias(f"{s}_active"), (F.col(f"{s}_{c}_own") > 0).alias(f"{s}_answered"), *(get(s).alias(f"{s}_{k}") for k, get in of.items())]
        return F.struct(*fields)

    return wide.select("packet", F.explode(F.array(*map(record, conditions))).alias("c")).select("packet", "c.*")


DRIFTS = ("semantic_graph_drift", "provenance_graph_drift", "max_query_drift", "mean_query_drift")


def summary_values(comparisons: DataFrame, quality: DataFrame, order: str, seed: str, joint: str, cached: str) -> DataFrame:
    """(section, label, metric, packet, value): every value whose mean over packets a summary reports; packets are the units, not questions.

    Sections: ``drift`` of each comparison, the shares of packets above the tolerances (graph 0.2, queries 0.3) and of
    questions with both answers empty; ``excess`` of order over seed; ``quality`` of each condition; ``gain`` of the joint
    condition over the cached one. Values per question are of packets in which it is active.
    """
    def rows(frame: DataFrame, section: str, label: Column, values: dict[str, Column]) -> DataFrame:
        each = F.array(*(F.struct(F.lit(m).alias("metric"), v.cast("double").alias("value")) for m, v in values.items()))
        return frame.select(F.lit(section).alias("section"), label.alias("label"), "packet", F.explode(each).alias("e")).select("section", "label", "e.metric", "packet", "e.value").where("value is not null")

    of = lambda s, c: F.when(F.col(f"{s}_active"), F.col(f"{s}_{c}"))
    drift = {m: F.col(m) for m in DRIFTS} | {"graph_violation_rate": F.col("provenance_graph_drift") > 0.2, "query_violation_rate": F.col("max_query_drift") > 0.3}
    drift |= {f"{s}_{c}": of(s, c) for s in SHAPES for c in ("drift", "both_empty")}
    macro = {m: F.col(m) for m in ("macro_precision", "macro_recall", "macro_f1", "semantic_f1", "provenance_f1")} | {f"{s}_{c}": of(s, c) for s in SHAPES for c in ("answered", "precision", "recall", "f1")}
    side = lambda frame, column, value, name, columns: frame.where(F.col(column) == value).select("packet", *(F.col(c).alias(f"{name}_{c}") for c in columns))
    excess = side(comparisons, "comparison", order, "a", DRIFTS).join(side(comparisons, "comparison", seed, "b", DRIFTS), "packet")
    gain = side(quality, "condition", joint, "a", ["macro_f1"]).join(side(quality, "condition", cached, "b", ["macro_f1"]), "packet")
    out = rows(comparisons, "drift", F.col("comparison"), drift).unionByName(rows(quality, "quality", F.col("condition"), macro))
    out = out.unionByName(rows(excess, "excess", F.lit(f"{order} - {seed}"), {m: F.col(f"a_{m}") - F.col(f"b_{m}") for m in DRIFTS}))
    return out.unionByName(rows(gain, "gain", F.lit(f"{joint} - {cached}"), {"macro_f1": F.col("a_macro_f1") - F.col("b_macro_f1")}))
