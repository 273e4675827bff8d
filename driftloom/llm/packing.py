"""Operator 1, best-fit packing of token pieces into fixed-length sequences.

Every piece asks for three resources of a sequence: tokens, one document slot, and attention cost (length squared).
Demands depend on the length alone, so the plan is made from the histogram of lengths, which has one row per length
however large the corpus is: lengths from long to short, each put into the class of open sequences with equal
residual vector that fits under all three capacities and scores best, by the weighted norm of what would be left or
by the weighted dot product of residual and demand. A whole run of sequences takes a whole run of pieces in one step.
Pieces find their sequence by their rank among the pieces of their length; ranks come from counts per (task, length),
so no group of equal lengths meets in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrow_map, columns, spool, text_slices, utf8_view
from .tokenizing import encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, place long"


@dataclass(frozen=True)
class Capacity:
    """What one sequence holds, how the three resources weigh in the score, and which score selects.

    With these defaults, pieces of up to ``tokens`` tokens fill no sequence by their number or attention cost before its
    tokens are full, so only tokens bind; the other residuals still have a say in which sequence a piece goes to.
    """

    tokens: int = 1024
    documents: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.05, 0.05)
    score: str = "norm"


def plan(histogram: dict[int, int], cap: Capacity) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset): piece ``first rank + i`` goes to sequence ``first sequence + i``."""
    full = np.array([cap.tokens, cap.documents, cap.attention], np.int64)
    weight = np.array(cap.weights)
    left = np.zeros((0, 3), np.int64)  # residual vectors of runs of open sequences
    first, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows, opened = [], 0
    for length in sorted(histogram, reverse=True):
        n, rank, need = histogram[length], 0, np.array([length, 1, length * length], np.int64)
        if (need > full).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while n:
            fits = np.flatnonzero((left >= need).all(axis=1))
            if not len(fits):
                # Open sequences that hold as many pieces of this length as fit, and one more for the rest.
                each = int((full // need).min())
                for per, m in ((each, n // each), (n % each, 1)):
                    if per and m:
                        for k in range(per):
                            rows.append((length, rank, m, opened, k * length))
                            rank += m
                        left = np.vstack([left, full - per * need])
                        first, count, opened = np.append(first, opened), np.append(count, m), opened + m
                break
            after = (left[fits] - need) / full
            score = (weight * after**2).sum(axis=1) if cap.score == "norm" else -(weight * (left[fits] / full) * (need / full)).sum(axis=1)
            i = fits[np.argmin(score)]
            k = int(min(n, count[i]))
            rows.append((length, rank, k, int(first[i]), int(full[0] - left[i][0])))
            if k < count[i]:
                left, first, count = np.vstack([left, left[i] - need]), np.append(first, first[i]), np.append(count, k)
                first[i] += k
                count[i] -= k
            else:
                left[i] = left[i] - need
            n, rank = n - k, rank + k
        useful = left[:, 0] > 0
        left, first, count = left[useful], first[useful], count[useful]
    return np.array(rows, np.int64).reshape(-1, 5)


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, limit: int) -> DataFrame:
    """Ids of each text and ``end_id``, cut from the end into pieces of ``limit`` ids; only the first may be shorter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task, seen = encoder(tokenizer), TaskContext.get().partitionId(), np.zeros(limit + 1, np.int64)
        for batch in text_slices(batches, "text"):
            ids, at = with_end(*code.encode(*utf8_view(batch.column("text"))), end_id)
            n = np.diff(at)
            parts = -(-n // limit)
            doc = np.repeat(np.arange(len(n)), parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
            head = n - (parts - 1) * limit
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * limit)
            length = np.where(piece == 0, head[doc], limit)
            raw = ids.astype("<u4")
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at[doc] + start, at[doc] + start + length, strict=True)]
            # The place among the task's pieces of the same length.
            order = np.argsort(length, kind="stable")
            run_at = np.searchsorted(length[order], length[order])
            place = np.empty(len(length), np.int64)
            place[order] = np.arange(len(length)) - run_at
            place += seen[length]
            seen += np.bincount(length, minlength=limit + 1)
            yield columns(doc_id=batch.column("doc_id").take(pa.array(doc)), piece=piece.astype(np.int32), start=start, length=length, ids_crc32=np.array(crc, np.int64), task=np.full(len(doc), task, np.int32), place=place)

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, PIECES, keep_cache=True)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, cap: Capacity = Capacity()) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one and still has its end id; repeated rows are packed each; an empty table gives no
    rows; other columns of ``docs`` are not looked at. Offsets within a sequence have no gaps.
    """
    pieces = spool(token_pieces(docs, tokenizer, end_id, cap.tokens), "pieces")
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    ranks = spool(per_task.select("length", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "ranks")
    # At most one row for each length up to cap.tokens.
    rows = plan({r[0]: r[1] for r in ranks.groupBy("length").agg(F.sum("n")).collect()}, cap)
    stride = 1 << 42
    order = np.argsort(rows[:, 0] * stride + rows[:, 1])
    rows = rows[order]
    keys = rows[:, 0] * stride + rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, length * stride + rank, side="right") - 1
            chosen = rows[at]
            yield columns(**{c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}, sequence_id=chosen[:, 3] + rank - chosen[:, 1], offset=chosen[:, 4])

    ranked = pieces.join(ranks.drop("n"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("place"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return arrow_map(ranked, place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
