"""What may be changed about an extraction: prompt variants, and the candidates of each document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftloom.functions.text import digest_rank
from driftloom.operators.extraction import MASKED, alias_rewrite, schema_variant

# Texts of roles and tones, and the presets of candidates.
ROLES = {
    "expert": "You are a senior knowledge-graph engineer with a PhD in NLP.",
    "novice": "You are a curious student who is just learning about extraction.",
    "auditor": "You are a meticulous data auditor who triple-checks every fact.",
    "concise": "You are a precise extractor; answer only with the structured output.",
}
TONES = {
    "strict": "Be extremely strict: only emit a relation when explicitly stated.",
    "permissive": "Be inclusive: emit any plausibly supported relation.",
    "polite": "Please carefully consider each candidate relation before emitting.",
    "terse": "Output the JSON only. No commentary.",
}
CLAUSES = ("C1_evidence_only", "C2_infer_implicit", "C3_use_schema", "C4_allow_other", "C5_cite_evidence", "C6_return_confidence")
SCHEMAS = ("with_other", "coarse", "ambiguous")
SHOWN_SCHEMAS = ("rename", "reorder", "desc_added", "desc_removed", "hierarchical")
SHOWN_TONES, SHOWN_ROLES = ("strict", "permissive", "terse"), ("expert", "novice", "auditor")


def _clause(name: str, text: str) -> Column:
    return F.struct(F.lit(name).alias("id"), F.lit(text).alias("text"))


def prompt_variant(clauses: Column, kind: str, value: str | tuple[str, ...] = "", text: str = "") -> Column:
    """An array of clauses (id, text) with clauses dropped, one added at the end, or another role first or tone last."""
    without = lambda *names: F.filter(clauses, lambda c: ~c["id"].isin(*names))
    made = {
        "drop": lambda: without(*((value,) if isinstance(value, str) else value)),
        "add": lambda: F.concat(clauses, F.array(_clause(value, text))),
        "role": lambda: F.concat(F.array(_clause("C0_role", ROLES.get(value, ROLES["expert"]))), without("C0_role")),
        "tone": lambda: F.concat(without("C9_tone"), F.array(_clause("C9_tone", TONES.get(value, TONES["terse"])))),
    }
    return made[kind]()


def relation_candidates(extracted: DataFrame, gold: DataFrame, most: int = 3) -> DataFrame:
    """(document_id, relations): each document's most frequent relations, extracted and gold counted together, without OTHER; ties by name."""
    both = extracted.select("document_id", "relation").unionByName(gold.select("document_id", "relation")).where("relation is not null and relation <> '' and relation <> 'OTHER'")
    counted = both.groupBy("document_id", "relation").agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "relation")))  # as many as a schema has
    return counted.groupBy("document_id").agg(F.slice(ordered, 1, most).getField("relation").alias("relations"))


def candidates(documents: DataFrame, sentences: DataFrame, relations: DataFrame, prompt: str, schema: str, repeats: int = 2, models: tuple[str, ...] = ()) -> DataFrame:
    """One row per possible intervention on each document.

    ``documents`` (document_id), ``sentences`` (document_id, sentence_id, sentence_index), ``relations`` (document_id,
    relations). What does not depend on the document's contents is one array of literals, exploded; nothing is joined
    but the document's own sentences and relations.
    """
    doc = F.col("document_id")

    def row(target_type: str, target: Column | str, operator: str, description: Column | str, tail: Column | str, group: str, semantic_class: str, family: str) -> Column:
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(
            F.concat(doc, F.lit("::iv::"), lit(tail)).alias("intervention_id"), F.lit(target_type).alias("target_type"), lit(target).alias("target_id"), F.lit(operator).alias("operator"), lit(description).alias("description"),
            F.lit(1.0).alias("estimated_cost"), F.concat(doc, F.lit(f"::{group}")).alias("group_id"), F.lit(semantic_class).alias("semantic_class"), F.lit(family).alias("cause_family"),
        )

    sid, number = F.col("sentence_id"), (F.col("sentence_index") + 1).cast("string")
    of_sentence = [
        row("sentence", sid, kind, F.concat(F.lit(f"{kind.capitalize()} sentence "), number), F.concat(F.lit("sent::"), sid, F.lit(f"::{kind}")), f"sent_{kind}", "semantic", "evidence") for kind in ("remove", "mask")
    ]
    shown = lambda *a: row(*a)
    fixed = [
        shown("sentence", "doc", "para_swap", "Reorder sentences (paragraph swap)", "sent::doc::para_swap", "evidence_pres", "presentation", "evidence"),
        shown("sentence", "doc", "entity_alias", "Rewrite entities with aliases", "sent::doc::entity_alias", "entity_alias", "presentation", "entity_alias"),
        *(row("prompt_clause", c, "remove", f"Drop prompt clause {c} from {prompt}", f"prompt::{prompt}::drop::{c}", "prompt_drop", "semantic", "prompt") for c in CLAUSES),
        *(row("prompt_clause", t, "tone", f"Switch prompt tone to {t}", f"prompt::{prompt}::tone::{t}", "prompt_tone", "presentation", "prompt") for t in SHOWN_TONES),
        *(row("prompt_clause", r, "role_swap", f"Switch prompt role to {r}", f"prompt::{prompt}::role::{r}", "prompt_role", "presentation", "prompt") for r in SHOWN_ROLES),
        *(row("schema", v, "switch_schema", f"Presentation schema variant '{v}'", f"schema::{schema}::{v}", "schema_pres", "presentation", "schema") for v in SHOWN_SCHEMAS),
        *(row("noop", f"seed{k}", "repeat", f"No-op re-run #{k}", f"noop::repeat::{k}", "noop", "stochastic", "stochastic") for k in range(repeats)),
        *(row("model", m, "swap", f"Re-extract with model {m}", f"model::swap::{m}", "model", "model", "model") for m in models),
    ]
    known = documents.select("document_id").join(relations, "document_id", "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))

    def switched(variant: str) -> Column:
        target = F.when(F.size("relations") > 0, F.concat(F.lit("ambiguous:"), F.array_join(F.slice("relations", 1, 3), ","))).otherwise("ambiguous") if variant == "ambiguous" else F.lit(variant)
        return row("schema", target, "switch_schema", F.concat(F.lit("Switch schema to variant '"), target, F.lit(f"' of {schema}")), F.concat(F.lit(f"schema::{schema}::"), target), "schema_sem", "semantic", "schema")

    dropped = F.transform("relations", lambda r: row("schema", F.concat(F.lit("drop:"), r), "switch_schema", F.concat(F.lit("Schema variant: drop relation "), r), F.concat(F.lit(f"schema::{schema}::drop::"), r), "schema_sem", "semantic", "schema"))
    of_documents = known.select("document_id", F.explode(F.concat(F.array(*fixed, *map(switched, SCHEMAS)), dropped)).alias("x"))
    of_sentences = sentences.join(documents.select("document_id"), "document_id", "left_semi").select("document_id", F.explode(F.array(*of_sentence)).alias("x"))
    return of_documents.unionByName(of_sentences).select("document_id", "x.*")
SENTENCES, RELATIONS = "array<struct<id:string,text:string>>", "array<struct<id:string,label:string,description:string>>"


def _sentences_after(target: Column, operator: Column, sentences: Column, document: Column, aliases: list[tuple[str, str]], seed: int) -> Column:
    named = lambda x, t: F.struct(x["id"].alias("id"), t.alias("text"))
    placed = F.transform(sentences, lambda x, i: F.struct(digest_rank(F.lit(str(seed)), document.cast("string"), i.cast("string")).alias("d"), i.alias("i"), x.alias("x")))
    return (
        F.when(operator == "remove", F.filter(sentences, lambda x: ~x["id"].eqNullSafe(target)))
        .when(operator == "mask", F.transform(sentences, lambda x: named(x, F.when(x["id"].eqNullSafe(target), MASKED).otherwise(x["text"]))))
        .when(operator == "para_swap", F.transform(F.array_sort(placed), lambda p: p["x"]))
        .when(operator == "entity_alias", F.transform(sentences, lambda x: named(x, alias_rewrite(x["text"], aliases))))
        .otherwise(F.raise_error(F.concat(F.lit("unknown sentence operator: "), F.coalesce(operator, F.lit("null")))).cast(SENTENCES))
    )


def _clauses_after(target: Column, operator: Column, clauses: Column) -> Column:
    chosen = lambda table, default: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[target], F.lit(table[default]))
    without = lambda name: F.filter(clauses, lambda c: ~c["id"].eqNullSafe(name))
    clause = lambda name, t: F.array(F.struct(F.lit(name).alias("id"), t.alias("text")))
    swap = ~target.startswith("C") & (operator != "remove")
    return F.when(swap & (operator == "role_swap"), F.concat(clause("C0_role", chosen(ROLES, "expert")), without(F.lit("C0_role")))).when(swap & (operator == "tone"), F.concat(without(F.lit("C9_tone")), clause("C9_tone", chosen(TONES, "terse")))).otherwise(without(target))


def _relations_after(target: Column, relations: Column, renames: dict[str, str], coarse: dict[str, str]) -> Column:
    fixed = F.lit(None).cast(RELATIONS)
    for kind in (*SHOWN_SCHEMAS, "with_other", "coarse"):
        fixed = F.when(target == kind, schema_variant(relations, kind, renames, coarse)).otherwise(fixed)
    first = F.slice(F.filter(F.transform(relations, lambda x: x["id"]), lambda i: ~i.isin("OTHER", "related_to")), 1, 3)
    merged = F.filter(F.when(target == "ambiguous", first).otherwise(F.split(F.substring_index(target, ":", -1), ",")), lambda i: (i != "") & (i != "OTHER"))
    text = F.concat(F.lit("Ambiguous merge of ["), F.array_join(F.transform(merged, lambda i: F.concat(F.lit("'"), i, F.lit("'"))), ", "), F.lit("]"))
    joined = F.array(F.struct(F.lit("related_to").alias("id"), F.lit("related_to").alias("label"), text.alias("description")))
    kept = F.filter(relations, lambda x: ~F.array_contains(merged, x["id"]) & (x["id"] != "related_to"))
    return (
        F.when(target.startswith("drop:"), F.filter(relations, lambda x: ~x["id"].eqNullSafe(F.regexp_extract(target, "^drop:(.*)$", 1))))
        .when((target == "ambiguous") | target.startswith("ambiguous:"), F.concat(kept, joined))
        .otherwise(F.coalesce(fixed, F.raise_error(F.concat(F.lit("unknown schema variant: "), F.coalesce(target, F.lit("null")))).cast(RELATIONS)))
    )


def applied(chosen: DataFrame, inputs: DataFrame, aliases: list[tuple[str, str]] | None = None, renames: dict[str, str] | None = None, coarse: dict[str, str] | None = None, seed: int = 7) -> DataFrame:
    """``chosen`` candidates with the sentences, clauses and relations that their extraction gets.

    ``inputs`` (document_id, sentences, clauses, relations) are arrays of (id, text), (id, text) and (id, label, description).
    A candidate changes one of them; ``noop`` and ``model`` change none, as what they change lies outside. Targets that are not
    there change nothing; an unknown target type, operator or schema variant raises, and so does a null one.
    """
    kind, target, operator = F.col("target_type"), F.col("target_id"), F.col("operator")
    known = F.when(kind.isin("sentence", "prompt_clause", "schema", "noop", "model"), kind).otherwise(F.raise_error(F.concat(F.lit("unknown target_type: "), F.coalesce(kind, F.lit("null")))).cast("string"))
    out = chosen.join(inputs, "document_id").withColumn("target_type", known)
    return out.withColumns({
        "sentences": F.when(kind == "sentence", _sentences_after(target, operator, F.col("sentences"), F.col("document_id"), aliases or [], seed)).otherwise(F.col("sentences")),
        "clauses": F.when(kind == "prompt_clause", _clauses_after(target, operator, F.col("clauses"))).otherwise(F.col("clauses")),
        "relations": F.when(kind == "schema", _relations_after(target, F.col("relations"), renames or {}, coarse or {})).otherwise(F.col("relations")),
    })


def registered_prompts(definitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((prompt_id, name, full_prompt, clause_ids), (clause_id, prompt_id, clause_type, clause_text)) of definitions (id, name, template, clauses of (id, type, text)); equal definitions once, a prompt without a name has its id."""
    one = definitions.select("id", "name", "template", F.coalesce("clauses", F.array().cast("array<struct<id:string,type:string,text:string>>")).alias("clauses")).distinct()
    prompts = one.select(F.col("id").alias("prompt_id"), F.coalesce("name", "id").alias("name"), F.col("template").alias("full_prompt"), F.transform("clauses", lambda c: c["id"]).alias("clause_ids"))
    clauses = one.select("id", F.explode("clauses").alias("c")).select(F.col("c.id").alias("clause_id"), F.col("id").alias("prompt_id"), F.coalesce("c.type", F.lit("")).alias("clause_type"), F.col("c.text").alias("clause_text"))
    return prompts, clauses.distinct()
