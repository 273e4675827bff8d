"""Raw model responses to edges that hold up: declared labels, and joint responses over the two documents of a packet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions import text

#: Why an edge of a joint response is left out, in the order in which it is looked at; one edge has one reason.
REASONS = ("invalid_shape", "invalid_provenance", "undeclared_entity", "invalid_relation", "invalid_evidence", "invalid_cid_direction")


def label(value: Column) -> Column:
    """A relation as declared: lower case, no outer white space, blanks as underscores."""
    return F.replace(F.regexp_replace(F.lower(value), r"(?U)^\s+|\s+$", ""), F.lit(" "), F.lit("_"))


def declared_edges(raw: DataFrame, by: list[str], declared: DataFrame, renamed: dict[str, str], rename_condition: str) -> tuple[DataFrame, DataFrame]:
    """Edges of ``raw`` (…by with ``condition``, s, r, o) whose relation is declared, and (…by, raw_edges, kept_edges, off_schema).

    ``declared`` (condition, label) is what a condition's prompt allowed. Under ``rename_condition`` a new name counts as the
    one that it stands for; names of both sides are compared in lower case. Edges that come out alike are one.
    """
    name = label(F.col("r"))
    old = name
    for new, base in renamed.items():
        old = F.when(name == new, F.lit(base)).otherwise(old)
    r = F.when(F.col("condition") == rename_condition, old).otherwise(name)
    known = declared.select("condition", label(F.col("label")).alias("r")).distinct().withColumn("_known", F.lit(True))
    clean = lambda c: F.regexp_replace(F.lower(c), r"(?U)^\s+|\s+$", "")
    marked = raw.select(*by, clean(F.col("s")).alias("s"), r.alias("r"), clean(F.col("o")).alias("o")).join(F.broadcast(known), ["condition", "r"], "left")  # a few labels a condition
    counted = marked.groupBy(*by, "s", "r", "o", "_known").agg(F.count("*").alias("_n"))
    ok = F.col("_known").isNotNull()
    audit = counted.groupBy(*by).agg(F.sum("_n").alias("raw_edges"), F.count_if(ok).alias("kept_edges"), F.coalesce(F.sum(F.when(~ok, F.col("_n"))), F.lit(0)).alias("off_schema"))
    return counted.where(ok).select(*by, "s", "r", "o"), audit


def joint_edges(responses: DataFrame, by: list[str], cohort: DataFrame, entities: DataFrame, sentences: DataFrame, relations: tuple[str, ...] = ("CID", "OTHER"), directed: tuple[str, str, str] = ("CID", "Chemical", "Disease")) -> DataFrame:
    """(…by, ordinal, s, r, o, source, reason) of the edges in ``responses`` (…by with ``packet``, response); sound ones have no reason.

    A response is an object with a list ``edges``; anything else is one row without ordinal, ``invalid_shape``. Of an edge
    the first of REASONS that holds counts: it is no object; its source is no document of its packet; an entity is not
    declared in its source document (``entities``: doc, entity, type); the relation, in upper case, is none of
    ``relations``; evidence is no list of whole numbers from 1 to the document's ``sentences`` (doc, n), or an empty one;
    the directed relation does not lead from the first type to the second. Entities are those of the source document, so a
    packet's other document lends none.
    """
    get = lambda v, path, kind: F.try_variant_get(v, path, kind)
    parsed = responses.select(*by, F.try_parse_json(text.lenient_json(F.col("response"))).alias("v"))
    listed = parsed.select(*by, get(F.col("v"), "$.edges", "array<variant>").alias("edges"))
    bad = listed.where("edges is null").select(*by, F.lit(None).cast("int").alias("ordinal"), *(F.lit(None).cast("string").alias(c) for c in ("s", "r", "o", "source")), F.lit(REASONS[0]).alias("reason"))
    each = listed.select(*by, F.posexplode("edges").alias("ordinal", "e"))
    field = lambda name: F.coalesce(F.regexp_replace(get(F.col("e"), f"$.{name}", "string"), r"(?U)^\s+|\s+$", ""), F.lit(""))
    fields = each.select(
        *by, "ordinal", field("subject_mesh_id").alias("s"), F.upper(field("relation")).alias("r"), field("object_mesh_id").alias("o"), field("source_document_id").alias("source"),
        get(F.col("e"), "$.evidence_sentence_ids", "array<variant>").alias("evidence"), get(F.col("e"), "$", "map<string,variant>").isNotNull().alias("_object"),
    )
    allowed = cohort.select("packet", F.explode(F.array(F.col("doc_a").cast("string"), F.col("doc_b").cast("string"))).alias("source")).withColumn("_in", F.lit(True))
    known = entities.groupBy(F.col("doc").cast("string").alias("source"), "entity").agg(F.max("type").alias("type"))
    side = lambda c: known.select("source", F.col("entity").alias(c), F.lit(True).alias(f"_{c}"), F.col("type").alias(f"_{c}_type"))
    found = fields.join(allowed, ["packet", "source"], "left").join(side("s"), ["source", "s"], "left").join(side("o"), ["source", "o"], "left")
    found = found.join(sentences.select(F.col("doc").cast("string").alias("source"), F.col("n").alias("_n")), "source", "left")
    # Whole numbers as JSON writes them: 1.0 and true are none.
    sound = lambda x: (F.schema_of_variant(x) == "BIGINT") & F.coalesce(get(x, "$", "bigint").between(F.lit(1), F.coalesce("_n", F.lit(0))), F.lit(False))
    relation, first, second = directed
    checks = [
        ~F.col("_object"), F.col("_in").isNull(), F.col("_s").isNull() | F.col("_o").isNull(), ~F.col("r").isin(*relations),
        F.coalesce(F.size("evidence"), F.lit(0)) < 1, ~F.forall("evidence", sound), (F.col("r") == relation) & ~(F.col("_s_type").eqNullSafe(first) & F.col("_o_type").eqNullSafe(second)),
    ]
    reason = F.lit(None).cast("string")
    for check, name in reversed(list(zip(checks, (*REASONS[:5], REASONS[4], REASONS[5]), strict=True))):
        reason = F.when(check, name).otherwise(reason)
    return found.select(*by, "ordinal", "s", "r", "o", "source", reason.alias("reason")).unionByName(bad)


def joint_audit(edges: DataFrame, by: list[str]) -> DataFrame:
    """Per response of ``joint_edges``: raw_edges, accepted_edges (different ones), and how many edges have each reason."""
    ok = F.col("reason").isNull()
    return edges.groupBy(*by).agg(F.count("ordinal").alias("raw_edges"), F.count_distinct(F.when(ok, F.struct("s", "r", "o", "source"))).alias("accepted_edges"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS))
