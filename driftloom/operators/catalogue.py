"""Query instances from gold edges, with stable ids and answer digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

TAIL_CAP, CHAIN_CAP = 6, 8
PARAMETERS = ["h", "r", "h1", "r1", "h2", "r2"]


def _capped(found: DataFrame, columns: list[str], cap: int | None) -> DataFrame:
    """The first ``cap`` distinct instances of each document, by their parameters: duplicates go before the cap. None: all of them."""
    if cap is None:
        return found.distinct()
    return found.distinct().withColumn("k", F.row_number().over(W.partitionBy("doc").orderBy(*columns))).where(F.col("k") <= cap).drop("k")


FAMILIES = ("lookup", "neighbor", "shared_tail_join", "typed_two_hop")


def instances(gold: DataFrame, tail_cap: int | None = TAIL_CAP, chain_cap: int | None = CHAIN_CAP) -> dict[str, DataFrame]:
    """By family, (doc, family, h, r, h1, r1, h2, r2): lookups, neighbours of heads with two tails or more, shared tails, two-hop chains.

    A document has the first ``tail_cap`` shared tails and the first ``chain_cap`` chains, or all of them where the cap is None.
    """
    g = gold.select("doc", "s", "r", "o").distinct()
    lookups = g.select("doc", F.col("s").alias("h"), "r").distinct()
    heads = g.groupBy("doc", "s").agg(F.count("*").alias("n")).where("n >= 2").select("doc", F.col("s").alias("h"))
    a, b = g.select("doc", "o", F.col("s").alias("h1"), F.col("r").alias("r1")), g.select("doc", "o", F.col("s").alias("h2"), F.col("r").alias("r2"))
    tails = a.join(b, ["doc", "o"]).where("h1 < h2 or (h1 = h2 and r1 < r2)").select("doc", "h1", "r1", "h2", "r2")
    one, two = g.select("doc", F.col("s").alias("h"), F.col("r").alias("r1"), F.col("o").alias("m")), g.select("doc", F.col("s").alias("m"), F.col("r").alias("r2"), F.col("o").alias("t"))
    chains = one.join(two, ["doc", "m"]).where("t <> h").select("doc", "h", "r1", "r2")
    parts = [lookups, heads, _capped(tails, ["h1", "r1", "h2", "r2"], tail_cap), _capped(chains, ["h", "r1", "r2"], chain_cap)]
    column = lambda p, c: F.col(c) if c in p.columns else F.lit(None).cast(gold.schema["r" if c[0] == "r" else "s"].dataType).alias(c)
    return {f: p.select("doc", F.lit(f).alias("family"), *(column(p, c) for c in PARAMETERS)) for f, p in zip(FAMILIES, parts)}


def build_queries(gold: DataFrame) -> DataFrame:
    """The ``instances`` of all families."""
    return reduce(DataFrame.unionByName, instances(gold).values())


def json_text(value: Column) -> Column:
    """A string as JSON text."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def query_id(family: Column, parameters: list[str]) -> Column:
    """SHA-256 of canonical JSON: keys in order, no spaces, absent parameters left out."""
    fields = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f'"{c}":'), json_text(F.col(c)))) for c in sorted(parameters)]
    return F.sha2(F.concat(F.lit('{"family":'), json_text(family), F.lit(',"parameters":{'), F.concat_ws(",", *fields), F.lit("}}")), 256)


def answer_digest(answers: Column) -> Column:
    """SHA-256 of a JSON array of distinct strings, in order of their JSON text."""
    return F.sha2(F.concat(F.lit("["), F.array_join(F.array_sort(F.transform(answers, json_text)), ","), F.lit("]")), 256)
