"""Operator 11, how quality filters act on one another: exact Shapley values from multilinear extensions.

A filter either fails a row or not, so a row is a mask of the filters that it fails, and a part of the corpus is the
numbers of its rows by mask. With x_i the chance that filter i is applied, the number of removed rows of a part is the
polynomial

    R(x) = sum over masks m of n_m * (1 - product over i in m of (1 - x_i)),

whose coefficients come from the counts by inclusion and exclusion. At a corner, where each x_i is 0 or 1, R is the number
of rows that those filters remove, which gives what is left after each step of any order. The Shapley value of a filter is
the integral of its partial derivative along the diagonal (t, ..., t), 0 <= t <= 1, taken exactly in rationals; times the
number of orders it is the sum over all orders of what the filter removes.

Texts are looked at once, in the scan. Only ids, masks and digests are shuffled; counts are formed map-side first.
"""

from __future__ import annotations

import math
from fractions import Fraction
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spool

#: Of n filters all n! orders are returned.
MOST_FILTERS = 6
ORDER_SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_filters(text: Column) -> dict[str, Column]:
    """The conditions under which the filters A to D fail a (non-null) text."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words)
    return {
        "A": n < 50,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 65 * n.cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 5 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts by part and mask: (part, mask, n, good, toxic); bit i of the mask is set if filter i of ABCDE fails the row.

    E compares SHA-256 digests of whole texts: a row fails if its text stands under a smaller doc_id; rows without doc_id
    come after all others. The row that stands first is found by a minimum per digest, formed map-side, and told apart by
    a join on digest and doc_id, so that a text with very many copies is dealt out by doc_id.
    """
    text = F.coalesce("text", F.lit(""))
    failed = text_filters(F.col("text"))
    bits = sum((F.when(failed[c], 1 << i).otherwise(0) for i, c in enumerate("ABCD")), F.lit(0))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    facts = spool(rows.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest")), "facts")
    firsts = spool(facts.groupBy("digest").agg(F.min("doc_id").alias("doc_id")), "firsts")
    marks = spool(labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")), "marks")
    f = firsts.select(F.col("digest").alias("_digest"), F.col("doc_id").alias("_id"), F.lit(1).alias("_first"))
    seen = facts.join(f, (facts.digest == f._digest) & facts.doc_id.eqNullSafe(f._id), "left").select("doc_id", "part", F.when(F.col("_first").isNull(), F.col("bits") + 16).otherwise(F.col("bits")).alias("mask"))
    return seen.join(marks, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


class RemovalPolynomial:
    """R of one part: ``coefficients[S]`` belongs to the product of x_i over the filters i in S (a bit set)."""

    def __init__(self, counts: dict[int, int], filters: int):
        self.filters = filters
        self.coefficients = [0] * (1 << filters)
        for mask, n in counts.items():
            part = mask
            while part:  # the non-empty subsets of the mask, with the sign that expanding 1 - prod(1 - x_i) gives
                self.coefficients[part] += n if part.bit_count() % 2 else -n
                part = (part - 1) & mask

    def at(self, corner: int) -> int:
        """Rows that the filters in ``corner`` remove."""
        total, part = 0, corner
        while part:
            total += self.coefficients[part]
            part = (part - 1) & corner
        return total

    def shapley(self, i: int) -> Fraction:
        """The integral of the derivative by x_i on the diagonal: x^S, with i in S, gives t^(|S| - 1), and 1 / |S|."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


def orders(part: str, counts: list[tuple[int, int, int, int]], names: str) -> list[tuple]:
    """Rows of ORDER_SCHEMA of one part, from its (mask, n, good, toxic)."""
    k = len(names)
    total = sum(c[1] for c in counts)
    all_rows, good, toxic = (RemovalPolynomial({c[0]: c[at] for c in counts}, k) for at in (1, 2, 3))
    every = (1 << k) - 1
    fails, only = [all_rows.at(1 << i) for i in range(k)], [all_rows.at(every) - all_rows.at(every & ~(1 << i)) for i in range(k)]
    share = [all_rows.shapley(i) * math.factorial(k) for i in range(k)]
    if any(s.denominator != 1 for s in share):
        raise ArithmeticError(f"a sum over orders is no integer in part {part!r}")
    corners = [[p.at(c) for c in range(1 << k)] for p in (all_rows, good, toxic)]
    out = []
    for order in permutations(range(k)):
        label, before = "".join(names[i] for i in order), 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            removed, good_lost, toxic_lost = (p[after] - p[before] for p in corners)
            out.append((part, label, step, total - corners[0][after], removed, fails[i] - removed, only[i], good_lost, toxic_lost, int(share[i])))
            before = after
    return out


def audit(counts: DataFrame, names: str) -> DataFrame:
    """All orders of the filters ``names`` for each part of ``counts`` (part, mask, n, good, toxic).

    A part has 2 ** len(names) masks at most, which one call gets; parts are dealt out over the cluster.
    """
    if len(set(names)) != len(names) or len(names) > MOST_FILTERS:
        raise ValueError(f"{MOST_FILTERS} different filters at most, each named by one letter: {names!r}")

    def one_part(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        got = [tuple(map(int, r)) for r in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)]
        return pd.DataFrame(orders(key[0], got, names), columns=[c.split()[0] for c in ORDER_SCHEMA.split(", ")])

    return counts.groupBy("part").applyInPandas(one_part, ORDER_SCHEMA)


def filter_interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the filters A to E over ``docs`` (doc_id, source, text) and ``labels`` (doc_id, quality, toxic).

    A null text is an empty one, a null source the part of the empty string. Rows are what is counted, repeated ones each:
    rows that share text and doc_id do not fail E because of one another. A doc_id with several labels is good, or toxic,
    if any of them says so; without labels it is neither, as is a row without doc_id. An empty table has no parts and
    gives no rows. Other columns are not looked at, whatever their names.
    """
    return audit(masks(docs, labels), "ABCDE")
