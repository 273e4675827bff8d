"""Operator 12, periodic runs of words, by the linear-time method of Ellert and Fischer.

Words are numbered, in any order, as letters of an ordered alphabet; suffixes are compared letter by letter. Every run has
a place from which the longest Lyndon word is one period long, in the order of the letters or in the reversed one. That
word ends where the next smaller suffix starts, so the edges (i, next smaller suffix of i) of both orders, with the length
of what both suffixes have in common, hold every run. Edges are found from left to right along a chain of previous smaller
suffixes. What was matched furthest to the right is used again: within it, an edge has the extension of the edge that many
words before, and only letters past it are compared; below it the extension is the lesser of two known ones. So each
letter is matched once. There are no suffix arrays or trees, and no hashes of word sequences.

A run of exponent e holds each of its words e times. So before the search, texts are cut at words that occur less often,
and the pieces again at words that are too rare in them; no run is lost, and ordinary prose is nearly all cut away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, text_slices

#: A run has this many words at least, and this many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Times that pieces are cut again; what is left after that is searched as it is.
CUTS = 8
#: Text bytes of one numpy pass.
PASS_BYTES = 4 << 20
SCHEMA = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def lyndon_edges(s: list[int], slack: int) -> list[tuple[int, int, int]]:
    """(i, j, k): j starts the next smaller suffix of i, both go on alike for k letters, and k > slack * (j - i)."""
    n = len(s)
    nss, nlce, pss, plce = [n] * n, [0] * n, [-1] * n, [0] * n
    # s[base:reach] equals what stands ``shift`` letters before it, and no match has reached further.
    reach = base = shift = 0
    out = []
    for r in range(1, n):
        left = r - 1
        if r >= reach and s[left] < s[r]:
            pss[r] = left
            continue
        k, below = 0, -1
        while True:
            match = True
            if r < reach and left >= base:
                x, y = left - shift, r - shift
                k = nlce[x] if nss[x] == y else plce[y]
                if r + k >= reach:
                    k = reach - r
                else:
                    match = False
            elif below >= 0:
                known = plce[below]
                if known != k:
                    match = False
                    if known < k:
                        k = known
            if match:
                while r + k < n and s[left + k] == s[r + k]:
                    k += 1
                if r + k >= reach:  # from here on, the chain need not be that of ``shift`` words before
                    reach, base, shift = r + k, r, r - left
            if r + k < n and s[left + k] < s[r + k]:
                pss[r], plce[r] = left, k
                break
            nss[left], nlce[left] = r, k
            if k > slack * (r - left):
                out.append((left, r, k))
            below, left = left, pss[left]
            if left < 0:
                break
    return out


def find_runs(s: list[int], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All (start, length, period) of ``s`` with length >= max(least, periods * period), by start, then period (periods >= 2)."""
    found = set()
    for letters in (s, [-x for x in s]):
        for i, j, k in lyndon_edges(letters, periods - 2):
            p, back = j - i, 0
            while back < p and i > back and s[i - 1 - back] == s[j - 1 - back]:
                back += 1
            # With a whole period before it, this is not the run's first Lyndon word.
            if back < p and back + p + k >= max(least, periods * p):
                found.add((i - back, back + p + k, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def candidate_pieces(ids: np.ndarray, at: np.ndarray, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces of the texts ids[at[i]:at[i + 1]] that can hold a run."""
    starts, ends = at[:-1], at[1:]
    for _ in range(CUTS):
        long_enough = ends - starts >= least
        starts, ends = starts[long_enough], ends[long_enough]
        sizes = ends - starts
        if not len(starts):
            break
        piece = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        key = piece * (int(ids.max()) + 1) + ids[place]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        rare = count[back] < periods
        if not rare.any():
            break
        ok = ~rare
        first = ok & np.r_[True, rare[:-1] | (piece[1:] != piece[:-1])]
        last = ok & np.r_[rare[1:] | (piece[1:] != piece[:-1]), True]
        starts, ends = place[first], place[last] + 1
    keep = ends - starts >= least
    return starts[keep], ends[keep]


def collapsed_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those of a run after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def _runs(batches: Iterator[pa.RecordBatch], least: int, periods: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    for batch in text_slices(batches, "text", PASS_BYTES):
        # bytes.split cuts at \x20 and \x09 to \x0D, and at nothing else
        texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in batch.column("text").to_pylist()]
        numbers: dict[bytes, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for words in texts for w in words], np.int64)
        at = np.concatenate([[0], np.cumsum([len(w) for w in texts])]).astype(np.int64)
        starts, ends = candidate_pieces(ids, at, least, periods)
        runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for owner, start, end in zip(np.searchsorted(at, starts, side="right") - 1, starts, ends, strict=True):
            move = int(start - at[owner])
            runs[owner] += [(a + move, n, p) for a, n, p in find_runs(ids[start:end].tolist(), least, periods)]
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"),
            pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs], kind),
            pa.array([b" ".join(collapsed_words(w, r)) for w, r in zip(texts, runs, strict=True)], pa.binary()).cast(pa.string()),
        ], names=["doc_id", "runs", "collapsed"])


def word_runs(docs: DataFrame, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, runs (start, length, period; by start, then period), collapsed.

    Words are what stands between \\x20 and \\x09 to \\x0D. A run is a stretch of words with smallest period q, of
    max(least, periods * q) words at least, that no neighbouring word goes on. ``collapsed`` is the words joined by one
    space, without those that stand in a run after its first q words. A null or empty text has no runs and an empty
    ``collapsed``; texts of any length are searched whole, one text in one task; repeated rows and rows without doc_id come
    out each; an empty table gives no rows; other columns are not looked at, whatever their names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return arrow_map(rows, lambda batches: _runs(batches, least, periods), SCHEMA)


def repeat_periodically(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which the documents whose crc32 of doc_id ends in 0 repeat a stretch of their words to the end.

    With h that crc32, g = h div 10 and n words: from word a = g % n on, word i is word a + (i - a) % p, where
    p = 1 + (n - a) div (3 + g % 8). Other documents, and those without doc_id or words, are as they were.
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), h.alias("h")).withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    g, n = F.floor(F.col("h") / 10), F.size("words").cast("long")
    sized = chosen.withColumn("a", F.when(n > 0, g % n)).withColumn("p", 1 + F.floor((n - F.col("a")) / (3 + g % 8)))
    place = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    again = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.element_at("words", (place(i) + 1).cast("int"))), " ")
    return sized.select("doc_id", F.when(F.col("a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """Counts, the longest run and digests of what ``word_runs`` gives; no runs: nulls, and the digest of nothing."""
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    # The least of (-length, start, period) is the longest run; of equal ones the first, and then the shorter period.
    best: Column = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.less")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-1000 * F.col("best.less") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
