"""Operator 13, exact duplicates by deterministic block naming, with DataFrame functions only.

A normalised text is cut into blocks of a fixed number of bytes. The different blocks of all texts are sorted within
their partitions and numbered, so equal blocks, and no others, have one integer name; a text is a sequence of names.
Then adjacent names are paired, the different pairs are sorted and numbered in the same way, and so on, until a text is a
single name: together with its level that is its identity, and texts have the same one just when they are equal. A level
has half the rows of the one below.

Names come from written tables, so a stage that is run again reads the same ones. A block finds its name by a 64-bit
hash; hashes that two different blocks share are known from the table of names, and those blocks find theirs by their
bytes. No group is gathered: blocks, pairs and identities are counted map-side first, and joins are of plain tables, so
that Spark splits what a hot block brings to one task.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool, unspool

#: Bytes of a block.
BLOCK_BYTES = 4096
#: Stands for the second name where a sequence has an odd number of them; names are larger.
NO_NAME = -(2**63)


def normal(text: Column) -> Column:
    """The text with A-Z in lower case and all else as it is; null is empty. (``lower`` is quicker, and right where all is ASCII.)"""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def cut(text: str, size: int) -> Column:
    """A text's blocks of ``size`` bytes, the last one shorter; an empty text is one empty block."""
    data = F.col(text).cast("binary")
    starts = F.sequence(F.lit(0), F.greatest(F.octet_length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda at: F.substr(data, at + 1, F.lit(size)))


def named(different: DataFrame, keys: list[str], keep: list[str], name: Column) -> DataFrame:
    """A written table of ``keep`` and ``name``, numbered in the order of ``keys`` within each partition."""
    return spool(different.sortWithinPartitions(*keys).select(*keep, name.alias("name")), "names")


def block_names(blocks: DataFrame, hashed: Callable[..., Column]) -> DataFrame:
    """(_row, left, pos, name) of (_row, left, pos, block): the lowest level."""
    blocks = blocks.withColumn("h", hashed("block"))
    names = named(blocks.groupBy("h", "block").agg(F.count("*").alias("n")), ["block"], ["h"], F.monotonically_increasing_id())
    shared = spool(names.groupBy("h").count().where("count > 1").select("h"), "shared")
    places = blocks.select("_row", "left", "pos", "h")
    if shared.isEmpty():
        found = places.join(names, "h")
    else:
        contested = blocks.join(shared, "h")
        own = named(contested.select("h", "block").distinct(), ["block"], ["h", "block"], -1 - F.monotonically_increasing_id())
        found = places.join(shared, "h", "left_anti").join(names, "h").select("_row", "left", "pos", "name").unionByName(contested.join(own, ["h", "block"]).select("_row", "left", "pos", "name"))
    out = spool(found.select("_row", "left", "pos", "name"), "level")
    for t in (names, shared):
        unspool(t)
    return out


def pair_names(level: DataFrame) -> DataFrame:
    """The next level of the rows that have more than one name left."""
    at = F.col("pos") % 2 == 0
    both = level.where("left > 1").groupBy("_row", "left", F.shiftright("pos", 1).alias("pos"))
    pairs = spool(both.agg(F.max(F.when(at, F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~at, F.col("name"))), F.lit(NO_NAME)).alias("b")), "pairs")
    names = named(pairs.select("a", "b").distinct(), ["a", "b"], ["a", "b"], F.monotonically_increasing_id())
    out = spool(pairs.join(names, ["a", "b"]).select("_row", F.shiftright(F.col("left") + 1, 1).alias("left"), "pos", "name"), "level")
    for t in (pairs, names):
        unspool(t)
    return out


def exact_duplicates(docs: DataFrame, normalise: Callable[[Column], Column] = normal, block_bytes: int = BLOCK_BYTES, hashed: Callable[..., Column] = F.xxhash64) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of rows with equal normalised texts the one with the largest doc_id stays (``keep_id``); of repeated rows with that
    doc_id one stays, and a null doc_id is the smallest. A null text is an empty one, and empty texts are equal; texts of
    any length are named whole; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    rows = spool(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", normalise(F.col("text")).alias("text")).withColumn("text_sha256", F.sha2("text", 256)), "rows")
    blocks = rows.select("_row", F.greatest(F.ceil(F.octet_length("text") / block_bytes), F.lit(1)).cast("long").alias("left"), F.posexplode(cut("text", block_bytes)).alias("pos", "block"))
    longest = rows.agg(F.max(F.octet_length("text"))).first()[0] or 0
    level, levels, k = block_names(blocks, hashed), [], 0
    while True:
        levels.append(level)
        if block_bytes << k >= longest:
            break
        level, k = pair_names(level), k + 1
    single = [t.where("left = 1").select("_row", F.lit(i).alias("level"), "name") for i, t in enumerate(levels)]
    identity = single[0]
    for t in single[1:]:
        identity = identity.unionByName(t)
    whole = spool(rows.select("_row", "doc_id", "text_sha256").join(identity, "_row"), "identities")
    groups = spool(whole.groupBy("level", "name").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", -F.col("_row"))).alias("stays")).select("level", "name", "group_size", F.col("stays.doc_id").alias("keep_id"), (-F.col("stays.col2")).alias("keep_row")), "groups")
    for t in (rows, *levels):
        unspool(t)
    return whole.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("_row") == F.col("keep_row")).alias("kept"), "text_sha256")
