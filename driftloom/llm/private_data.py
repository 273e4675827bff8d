r"""Operator 7, personal data and the terms that give it away, with DataFrame functions only.

Base spans are found by four patterns. Matches and the pieces between them have lengths, and their running sum gives
the places. The patterns here find what the plain ones find, but neither backtrack nor recurse: runs are possessive,
and no search starts inside a run that has already failed.

Information-theoretic sanitisation: an entity is a base match's value, a term a word of TERM_LETTERS letters or more that
stands within REACH characters of it. What a term gives away of an entity is the share of the entity's information that
is gone once the term is known: 1 - log P(entity | term) / log P(entity). All counts are of different texts, so it makes no
difference how often a text was copied. P(entity | term) is counted, but a term of few texts says little by its count, so
the count is shrunk, with the weight of SHRINK texts, toward what the entity's class lets expect: how often the term goes
with the class (an address's domain, a network, a card's issuer, a phone's country), itself shrunk toward the class's
share of all texts, times the entity's share of its class. In documents with the entity, terms from REMOVE on are removed
and terms from GENERALISE on are generalised to their kind of token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Rows up to which the hashes of texts with copies are broadcast.
BROADCAST_COPIES = 1_000_000
TERM_LETTERS, REACH, SHRINK, GENERALISE, REMOVE = 4, 60, 3, 0.6, 0.85
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "removed", "general")

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Only runs of twelve digits or more: shorter ones fail the check that follows.
CARD = r"(?<![0-9])(?=(?:[0-9][\x20-]?){11}[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE}


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """From the right, every second digit counts double, less nine above nine."""
    turned = F.reverse(digits)

    def value(i: Column) -> Column:
        d = F.ascii(turned.substr(i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1))), F.lit(0), lambda acc, i: acc + value(i))
    return total % 10 == 0


def _byte(part: Column) -> Column:
    """Whether a run of digits is 255 at most, however many zeros it starts with."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return F.when(F.length(bare) <= 3, F.coalesce(bare.try_cast("int") <= 255, F.lit(False))).otherwise(False)


SOUND = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, "\\."), _byte),
    "card": lambda m: F.length(_digits(m)).between(12, 19) & F.when(F.length(_digits(m)) <= 19, _luhn(_digits(m))).otherwise(False),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}
SPAN = "array<struct<kind:string,start:long,stop:long,value:string>>"


def running(xs: Column, most: bool = False) -> Column:
    """Running sums of longs, or running maxima if ``most``.

    Of runs of about the square root of their number each, since a step copies what it has: n to the power of 1.5, not 2.
    """
    joined = (lambda a, x: F.greatest(a, x)) if most else (lambda a, x: a + x)
    zero = F.lit(0).cast("long")

    def plain(part: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.array().cast("array<long>").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            at = joined(acc["at"], x)
            return F.struct(at.alias("at"), F.concat(acc["out"], F.array(at)).alias("out"))

        return F.aggregate(part, begin, step, lambda acc: acc["out"])

    size = F.greatest(F.ceil(F.sqrt(F.size(xs))), F.lit(1)).cast("int")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), size), lambda k: F.slice(xs, k + 1, size))
    totals = F.transform(runs, lambda r: F.aggregate(r, zero, joined))
    starts = F.concat(F.array(zero), plain(totals, zero))
    return F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), plain))


def with_places(rows: DataFrame, kinds: dict[str, tuple[Column, Column, object]]) -> DataFrame:
    """``rows`` (_text, …) with an array of spans for each kind: (whether to search, pattern, whether a match is sound), in order.

    Each step is a column of its own, so that a pattern is searched once, and once more only where it was found.
    """
    # Matches and the pieces between them have lengths, and the running sum of both gives the places.
    out = rows.withColumns({f"_m_{k}": F.when(gate, F.regexp_extract_all("_text", pattern, 0)) for k, (gate, pattern, _) in kinds.items()})
    some = {k: F.coalesce(F.size(f"_m_{k}"), F.lit(0)) > 0 for k in kinds}
    out = out.withColumns({f"_l_{k}": F.when(some[k], F.zip_with(F.slice(F.split("_text", pattern, -1), 1, F.size(f"_m_{k}")), f"_m_{k}", lambda p, m: (F.length(p) + F.length(m)).cast("long"))) for k, (_, pattern, _) in kinds.items()})
    out = out.withColumns({f"_e_{k}": F.when(some[k], running(F.col(f"_l_{k}"))) for k in kinds})

    def spans(k: str, sound) -> Column:
        made = F.zip_with(f"_e_{k}", f"_m_{k}", lambda e, m: F.struct(F.lit(k).alias("kind"), (e - F.length(m)).alias("start"), e.alias("stop"), m.alias("value")))
        return F.when(some[k], F.filter(made, lambda s: sound(s["value"]))).otherwise(F.array().cast(SPAN))

    return out.select(*rows.columns, *(spans(k, sound).alias(f"_{k}") for k, (_, _, sound) in kinds.items()))


def with_base(texts: DataFrame) -> DataFrame:
    """``texts`` (_text, …) with ``_base``, the spans of the base kinds; a text without the marks of a kind is not searched for it."""
    text = F.col("_text")
    marks = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": F.contains(text, F.lit("+"))}
    found = with_places(texts, {k: (marks[k], F.lit(PATTERNS[k]), SOUND[k]) for k in BASE})
    return found.select(*texts.columns, F.concat(*(f"_{k}" for k in BASE)).alias("_base"))


def entity_class(span: Column) -> Column:
    """What an entity shares with others of its kind: domain, first two parts, first six digits, first three of a phone's."""
    kind, value = span["kind"], F.lower(span["value"])
    part = F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).otherwise(F.substring(_digits(value), 1, F.when(kind == "card", 6).otherwise(3)))
    return F.concat(kind, F.lit(":"), part)


def terms_near(spans: DataFrame) -> DataFrame:
    """(entity, class, text, term) for ``spans`` (_text, _base): the terms on both sides of each entity; texts by hash."""
    one = spans.select("_text", F.explode("_base").alias("s"))
    # One more character tells whether the outermost word is whole; one that is cut is no term.
    start = F.col("s.start")
    before = F.substring(F.col("_text"), F.greatest(start - REACH, F.lit(1)).cast("int"), F.least(start, F.lit(REACH + 1)).cast("int"))
    before = F.when(start > REACH, F.regexp_replace(before, r"(?s)^(?:\p{L}+|.)", "")).otherwise(before)
    after = F.substring(F.col("_text"), (F.col("s.stop") + 1).cast("int"), F.lit(REACH + 1))
    after = F.when(F.length(after) > REACH, F.regexp_replace(after, r"(?s)(?:\p{L}+|.)\z", "")).otherwise(after)
    around = F.concat_ws("\n", before, after)
    return one.select(F.lower("s.value").alias("entity"), entity_class(F.col("s")).alias("class"), F.xxhash64("_text").alias("text"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(around), F.lit(rf"(?<!\p{{L}})\p{{L}}{{{TERM_LETTERS},}}(?!\p{{L}})"), 0))).alias("term"))


def revealing_terms(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(entity, term, kind) of the pairs whose disclosure reaches a threshold; counts cover all different texts of ``docs`` (_text)."""
    hashed = docs.withColumn("_hash", F.xxhash64("_text"))
    texts = spool(hashed.groupBy("_hash").agg(F.count("*").alias("copies")), "texts")
    total = texts.count()
    near = spool(terms_near(spans), "near")
    held = spool(spans.select(F.xxhash64("_text").alias("text"), F.explode("_base").alias("s")).select("text", F.lower("s.value").alias("entity"), entity_class(F.col("s")).alias("class")).distinct(), "held")
    entity_docs = held.groupBy("entity", "class").agg(F.count_distinct("text").alias("entity_docs"))
    class_docs = held.groupBy("class").agg(F.count_distinct("text").alias("class_docs"))
    # A term occurs at least in the documents that have it near an entity. Pairs that even this few leave below the
    # thresholds cannot reach them, so only the other terms are counted in all documents.
    fewest = near.groupBy("term").agg(F.count_distinct("text").alias("term_docs"))
    pairs = near.groupBy("entity", "class", "term").agg(F.count_distinct("text").alias("together"))
    of_class = near.groupBy("class", "term").agg(F.count_distinct("text").alias("class_together"))
    counted = pairs.join(of_class, ["class", "term"]).join(entity_docs, ["entity", "class"]).join(class_docs, "class")
    pairs = spool(counted.join(fewest, "term").where(disclosure(total) >= GENERALISE).drop("term_docs"), "pairs")
    terms = pairs.select("term").distinct()
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit("removed").alias("kind"))
    copied = texts.where("copies > 1")
    copied = F.broadcast(copied) if copied.count() <= BROADCAST_COPIES else copied
    words = hashed.join(copied, "_hash", "left").select(F.coalesce("copies", F.lit(1)).alias("copies"), F.explode(words_of(F.col("_text"))).alias("term"))
    # Summed first, so that what reaches the join is a row per word and number of copies, not per occurrence. (A semi-join
    # would be pushed below the sum.) A text of c copies is among the words of c copies c times.
    summed = words.groupBy("term", "copies").agg(F.count("*").alias("n")).join(terms, "term")
    term_docs = summed.groupBy("term").agg(F.sum((F.col("n") / F.col("copies"))).alias("term_docs"))
    kinds = F.when(F.col("share") >= REMOVE, "removed").when(F.col("share") >= GENERALISE, "general")
    return spool(pairs.join(term_docs, "term").withColumn("share", disclosure(total)).select("entity", "term", kinds.alias("kind")).where("kind is not null"), "terms")


def words_of(text: Column) -> Column:
    """The different terms of a text."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= TERM_LETTERS)


def disclosure(total: int) -> Column:
    """The share of an entity's information that a term gives away, from the counts of texts; 0 for one that all texts have."""
    k, n = float(SHRINK), F.col("term_docs")
    of_class = (F.col("class_together") + k * F.col("class_docs") / total) / (n + k)
    known = (F.col("together") + k * of_class * F.col("entity_docs") / F.col("class_docs")) / (n + k)
    alone = F.col("entity_docs") / total
    return F.round(F.when(alone < 1, 1 - F.log2(known) / F.log2(alone)).otherwise(0.0), 12)


def find_private(docs: DataFrame) -> DataFrame:
    """``docs`` (text, and any other columns) with ``spans``: array of (kind, start, stop, value) in code points, by start, then kind.

    A null or empty text has no spans; very long texts are searched whole; repeated rows get the same spans; an empty
    table gives no rows; a column ``spans`` of ``docs`` is replaced. Kinds beyond the base ones are ``removed`` and ``general``.
    """
    kept = [c for c in docs.columns if c != "spans"]
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    texts = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items()), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    texts = spool(with_base(texts), "base")
    hits = spool(texts.where(F.size("_base") > 0).select("_text", "_base"), "hits")
    pairs = revealing_terms(texts.select("_text"), hits)
    # Terms for each text that holds an entity of theirs; the text's hash stands for the text. They are found from the
    # text's own words, so an entity of many texts with many terms does not multiply one by the other.
    key = F.xxhash64("_text", F.md5("_text"))
    owned = hits.select(key.alias("_key"), F.explode(F.array_distinct(F.transform("_base", lambda s: F.lower(s["value"])))).alias("entity")).distinct()
    own_words = hits.select(key.alias("_key"), F.explode(words_of(F.col("_text"))).alias("term"))  # of copies each; they fall together below
    found = own_words.join(pairs, "term").join(owned, ["_key", "entity"])
    per_text = found.groupBy("_key", "term").agg(F.max("kind").alias("kind")).groupBy("_key").agg(F.sort_array(F.collect_set(F.when(F.col("kind") == "removed", F.col("term")))).alias("_removed"), F.sort_array(F.collect_set(F.when(F.col("kind") == "general", F.col("term")))).alias("_general"))
    per_text = spool(per_text, "text-terms")
    place = {k: i for i, k in enumerate(KINDS)}
    rank = F.create_map(*(F.lit(x) for kv in place.items() for x in kv))

    def finished(rows: DataFrame, everything: Column) -> DataFrame:
        ordered = F.transform(F.array_sort(F.transform(everything, lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), s["value"].alias("value")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"), s["value"].alias("value")))
        return rows.select(*(F.col(i).alias(c) for c, i in inner.items()), F.when(F.size(everything) > 0, ordered).otherwise(F.array().cast(SPAN)).alias("spans"))

    if per_text.isEmpty():
        return finished(texts, F.col("_base"))
    # Only texts with an entity meet their terms, so the others are not shuffled.
    marked = texts.where(F.size("_base") > 0).withColumn("_key", key).join(per_text, "_key", "left")

    def of(terms: str) -> tuple:
        pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join(terms, "|"), F.lit(r")(?!\p{L})"))
        return F.coalesce(F.size(terms), F.lit(0)) > 0, pattern, lambda m: F.lit(True)

    marked = with_places(marked.withColumnsRenamed({"_removed": "_out", "_general": "_wide"}), {"removed": of("_out"), "general": of("_wide")})
    return finished(marked, F.concat("_base", "_removed", "_general")).unionByName(finished(texts.where(F.size("_base") == 0), F.col("_base")))


def token_kind(value: Column) -> Column:
    """What is left of a generalised term."""
    first = F.substring(value, 1, 1)
    return F.when((F.upper(value) == value) & (F.lower(value) != value), "acronym").when((F.upper(first) == first) & (F.lower(first) != first), "name").otherwise("word")


def sanitise(rows: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``rows`` with base spans in ``text`` replaced by their kind in brackets, removed terms left out, and generalised ones
    replaced by their kind of token: ACRONYM (capitals), NAME (a capital first) or WORD.

    Spans that overlap are one, of the kind of the first. A null text becomes an empty one.
    """
    out = rows.withColumn("_stop", F.when(F.size(spans) > 0, running(F.transform(spans, lambda s: s["stop"]), most=True)))
    # ``before``: where the spans so far end; a span that starts earlier lies in them.
    zipped = F.zip_with(spans, F.concat(F.array(F.lit(0).cast("long")), F.slice("_stop", 1, F.size("_stop") - 1)), lambda s, b: F.struct(b.alias("before"), s["start"].alias("start"), F.when(s["kind"] == "general", token_kind(s["value"])).otherwise(s["kind"]).alias("kind")))
    out = out.withColumn("_cut", F.when(F.size(spans) > 0, F.filter(zipped, lambda z: z["start"] >= z["before"])))
    # Text is taken in runs of cuts, and each gap from its run, so no gap is looked for from the start of the text.
    size = F.ceil(F.sqrt(F.size("_cut"))).cast("int")
    cut = F.col("_cut")
    runs = F.transform(F.sequence(F.lit(0), F.size(cut) - 1, size), lambda k: F.slice(cut, k + 1, size))
    piece = lambda r: F.substring(F.col(text), (r[0]["before"] + 1).cast("int"), (F.element_at(r, -1)["start"] - r[0]["before"]).cast("int"))
    out = out.withColumn("_run", F.when(F.size("_cut") > 0, F.transform(runs, lambda r: F.struct(r.alias("cuts"), piece(r).alias("piece")))))
    mark = lambda c: F.when(c["kind"] == "removed", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(c["kind"]), F.lit("]")))
    gap = lambda z, c: F.substring(z["piece"], (c["before"] - z["cuts"][0]["before"] + 1).cast("int"), (c["start"] - c["before"]).cast("int"))
    filled = F.transform("_run", lambda z: F.array_join(F.transform(z["cuts"], lambda c: F.concat(gap(z, c), mark(c))), ""))
    rest = F.substring(F.col(text), (F.element_at("_stop", -1) + 1).cast("int"), F.length(text))
    clean = F.when(F.size(spans) > 0, F.concat(F.array_join(filled, ""), rest)).otherwise(F.coalesce(text, F.lit("")))
    return out.withColumn(text, clean).drop("_stop", "_cut", "_run")


def listing(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """kind:start:stop of all spans, or those of some kinds, joined by commas."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(*kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)."""
    found = find_private(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc_id", *counts, F.sha2(listing(F.col("spans"), BASE), 256).alias("base_sha256"), listing(F.col("spans")).alias("spans"))
