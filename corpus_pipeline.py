"""A training-data pipeline over ``documents``; each stage reads what the one before it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftloom.llm.common import session_dir, spool, table
from driftloom.llm.jaccard import BROADCAST_ROWS, ngram_jaccard_components
from driftloom.llm.packing import pack
from driftloom.llm.private_data import find_private, sanitise
from driftloom.llm.quality import accepted_rows
from driftloom.llm.queries import tokenizer


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts, with all their columns.

    A null text is an empty one; a null source or lang is a host or path of its own; repeated rows are judged each, and
    alike; an empty table gives no rows; no column's name clashes with the classifier's.
    """
    return accepted_rows(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest doc_id (a null one last), of those the first row.

    Rows are what is compared, so of repeated rows one stays, a row without doc_id takes part, and a doc_id with two
    different texts loses only the row that has a duplicate. A null or empty text is no duplicate of anything; an empty
    table gives no rows; other columns may have any names.
    """
    inner = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = spool(docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items())).withColumn("_row", F.monotonically_increasing_id()), "rows")
    found = spool(ngram_jaccard_components(rows.select(F.col("_row").alias("doc_id"), F.col(inner["text"]).alias("text")), count_links=False).select(F.col("doc_id").alias("_row"), "component_id"), "found")
    # Only rows of groups of two or more are looked at further.
    groups = spool(found.where("component_id <> _row").select("component_id").distinct(), "groups")
    few = groups.count() <= BROADCAST_ROWS
    members = spool(found.join(F.broadcast(groups) if few else groups, "component_id").join(rows.select("_row", F.col(inner["doc_id"]).alias("_id")), "_row"), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("_id").isNull(), "_id", "_row")).getField("_row").alias("first"))
    dropped = spool(members.join(F.broadcast(first) if few else first, "component_id").where("_row <> first").select("_row"), "dropped")
    left = rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_ROWS else dropped, "_row", "left_anti")
    return left.select(*(F.col(i).alias(c) for c, i in inner.items()))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without their personal data and the terms that give it away; ``n_chars``, if there, is the new length.

    A null text becomes an empty one; very long texts are cleaned whole; repeated rows come out alike; an empty table
    gives no rows; other columns, a column ``spans`` among them, stay as they are.
    """
    inner = {c: f"_of_{i}" for i, c in enumerate(docs.columns)} | {"text": "text"}
    clean = sanitise(find_private(docs.select(*(F.coalesce("text", F.lit("")).alias("text") if c == "text" else F.col(f"`{c}`").alias(i) for c, i in inner.items()))))
    return clean.select(*(F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(i).alias(c) for c, i in inner.items()))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences, of every row.

    A null text is an empty one, whose end id is packed; repeated rows are packed each; ties between sequences go to the
    first; texts of any length are cut, not dropped; an empty table gives no rows; other columns are not looked at.
    """
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_duplicates), ("PII", private_data), ("best-fit packing", packing)]

#: The stages train a model and hash shingles, which SQL does not express; the tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again."""
    docs, at = table(spark, sf_dir, "documents"), f"{session_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    return docs
