"""Prompt texts from arrays of their parts, and the key under which a response is kept."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _lines(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "\n")


def clauses_text(clauses: Column, active: tuple[str, ...] | None = None) -> Column:
    """A bulleted line per clause (id, text), of the active ones if given."""
    chosen = clauses if active is None else F.filter(clauses, lambda c: c["id"].isin(*active))
    return _lines(chosen, lambda c: F.concat(F.lit("- "), c["text"]))


def schema_text(schema_id: Column, description: Column, relations: Column) -> Column:
    """Id, description and a line per relation (id, label, description)."""
    line = lambda r: F.concat(F.lit("  - "), r["id"], F.lit(" ("), r["label"], F.lit("): "), F.trim(F.coalesce(r["description"], F.lit(""))))
    return F.concat_ws("\n", F.concat(F.lit("Schema id: "), schema_id), F.concat(F.lit("Description: "), F.coalesce(description, F.lit(""))), F.lit("Relations:"), F.when(F.size(relations) > 0, _lines(relations, line)))


def document_text(sentences: Column) -> Column:
    """A numbered line per sentence (sentence_index, text), in the order of the array."""
    return _lines(sentences, lambda s: F.concat(F.lit("["), (s["sentence_index"] + 1).cast("string"), F.lit("] "), s["text"]))


def entities_text(entities: Column) -> Column:
    """A line per entity (canonical_name, entity_type, entity_id)."""
    return _lines(entities, lambda e: F.concat(F.lit("- "), e["canonical_name"], F.lit(" (type="), F.when(F.coalesce(e["entity_type"], F.lit("")) == "", "ENT").otherwise(e["entity_type"]), F.lit(", id="), e["entity_id"], F.lit(")")))


def filled(template: Column, **parts: Column) -> Column:
    """The template with each ``{name}`` replaced by its part; parts are not looked at again."""
    out, mark = template, "\x00"
    for name in parts:
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(f"{mark}{name}{mark}"))
    pieces = F.split(out, mark)

    def put(piece: Column, at: Column) -> Column:
        chosen = piece
        for name, text in parts.items():
            chosen = F.when((at % 2 == 1) & (piece == name), text).otherwise(chosen)
        return chosen

    return F.array_join(F.transform(pieces, put), "")


def cache_key(model: Column, temperature: Column, seed: Column, prompt: Column) -> Column:
    """SHA-256 over model, temperature, seed and prompt; an absent seed counts as None."""
    return F.sha2(F.concat(F.lit("m="), model, F.lit("|t="), temperature.cast("string"), F.lit("|s="), F.coalesce(seed.cast("string"), F.lit("None")), F.lit("\n"), prompt), 256)
