"""Column functions on names, labels, texts and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name_key(x: Column) -> Column:
    """Lower case without white space at the ends, Unicode white space included."""
    return F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))


def surface(x: Column) -> Column:
    """Lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(x), r"(?U)\s+", " "))


def relation_key(x: Column) -> Column:
    return F.replace(name_key(x), F.lit(" "), F.lit("_"))


def mapped(x: Column, table: dict[str, str], otherwise: Column | None = None) -> Column:
    """Look-up in a small fixed map."""
    found = F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x] if table else F.lit(None).cast("string")
    return F.coalesce(found, x if otherwise is None else otherwise)


def parent_id(x: Column) -> Column:
    """What comes before the last ``::``."""
    return F.regexp_extract(x, "^(.*)::", 1)


def local_id(x: Column) -> Column:
    """What comes after the last ``::``."""
    return F.substring_index(x, "::", -1)


def slug(x: Column, length: int = 40) -> Column:
    return F.substring(F.regexp_replace(x, r"[^\p{L}\p{N}_-]", "_"), 1, length)


def tokens(x: Column) -> Column:
    return F.filter(F.split(x, r"\s+"), lambda t: t != "")


#: Marks and endings that follow without a space, marks that nothing follows with one, and abbreviations that end no sentence.
CLOSING = (",", ".", ";", ":", "!", "?", ")", "]", "'s", "n't", "'re", "'ve", "'ll", "'d", "'m")
OPENING = ("(", "[", "``", "$")
ABBREVIATIONS = ("e.g", "i.e", "vs", "et", "al", "fig", "etc", "ref", "vol", "no", "approx", "Dr", "Mr", "Mrs", "Ms", "St", "U.S", "U.K", "Inc", "Ltd")


def detokenise(words: Column) -> Column:
    """Words joined by spaces, but for closing marks and contractions, and after an opening mark that itself was joined on."""
    zero = F.struct(F.lit("").alias("text"), F.lit(True).alias("opened"))

    def step(acc: Column, w: Column) -> Column:
        joined = acc["opened"] | w.isin(*CLOSING)
        # Only what was joined without a space opens; ``(`` after a space does not stand alone in what was written last.
        return F.struct(F.concat(acc["text"], F.when(joined, w).otherwise(F.concat(F.lit(" "), w))).alias("text"), (joined & w.isin(*OPENING)).alias("opened"))

    return F.trim(F.aggregate(words, zero, step, lambda acc: acc["text"]))


def sentences(x: Column) -> Column:
    """Array of (start, stop, text), in code points: split after a closing mark before a capital or an opening bracket; not after an abbreviation."""
    gap = F.lit(r"(?<=[.!?])\s+(?=[A-Z(])")
    parts = F.filter(F.split(x, gap, -1), lambda p: p != "")
    kind = "array<struct<start:bigint,stop:bigint,text:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, part: Column) -> Column:
        start = _found(x, part, acc["at"])
        stop = start + F.length(part)
        last = F.element_at(acc["out"], -1)
        word = F.regexp_replace(F.regexp_extract(last["text"], r"(\S+)\s*$", 1), r"\.+$", "")
        first = F.when(F.size(acc["out"]) > 0, F.when(word.isin(*ABBREVIATIONS), last["start"]))
        begin = F.coalesce(first, start)
        made = F.struct(begin.alias("start"), stop.alias("stop"), F.substring(x, (begin + 1).cast("int"), (stop - begin).cast("int")).alias("text"))
        kept = F.when(first.isNotNull(), F.slice(acc["out"], 1, F.size(acc["out"]) - 1)).otherwise(acc["out"])
        return F.struct(stop.alias("at"), F.concat(kept, F.array(made)).alias("out"))

    return F.when(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")) == "", F.array().cast(kind)).otherwise(F.aggregate(parts, zero, step, lambda acc: acc["out"]))


def _found(x: Column, part: Column, at: Column) -> Column:
    """Where ``part`` begins, from ``at`` on."""
    return F.call_function("locate", part, x, (at + 1).cast("int")).cast("long") - 1


def tokens_with_places(x: Column) -> Column:
    """Array of (start, stop, token): runs of letters, digits, hyphens and slashes that begin with a letter or digit, and single other marks."""
    pattern = r"[A-Za-z0-9][A-Za-z0-9\-/]*|[^\sA-Za-z0-9]"
    found, between = F.regexp_extract_all(x, F.lit(pattern), 0), F.split(x, F.lit(pattern), -1)
    pairs = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda t, p: F.struct(t.alias("t"), p.alias("p")))
    kind = "array<struct<start:bigint,stop:bigint,token:string>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + F.length(z["p"])
        stop = start + F.length(z["t"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), z["t"].alias("token")))).alias("out"))

    return F.aggregate(pairs, zero, step, lambda acc: acc["out"])


def token_span(places: Column, start: Column, stop: Column) -> Column:
    """(first token, token after the last) that a span of characters touches, from ``tokens_with_places``; null if none."""
    ends = F.filter(F.transform(places, lambda p, i: F.struct(i.alias("i"), p["stop"].alias("e"), p["start"].alias("s"))), lambda z: (z["e"] > start) & (z["s"] < stop))
    return F.when(F.size(ends) > 0, F.struct(ends[0]["i"].alias("first"), (F.element_at(ends, -1)["i"] + 1).alias("stop")))


def digest_rank(*parts: Column) -> Column:
    """An order that knows nothing of labels."""
    return F.sha2(F.concat_ws("|", *parts), 256)


def digest_uint64(x: Column) -> Column:
    """The first eight bytes of SHA-256 as an unsigned number."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10).cast("decimal(20,0)")


def lenient_json(x: Column) -> Column:
    """JSON text out of fences, prose around the outermost braces, and trailing commas; null if none parses."""
    bare = F.regexp_replace(F.trim(x), r"(?s)^```[a-zA-Z]*\s*|\s*```$", "")
    braces = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    tidy = lambda t: F.regexp_replace(t, r",\s*([}\]])", "$1")
    return F.coalesce(*(F.when(F.try_parse_json(c).isNotNull() & (c != ""), c) for c in (x, bare, braces, tidy(braces))))
