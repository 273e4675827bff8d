"""Operator 8, a quality classifier with hierarchical empirical Bayes.

A logistic model over hashed words, word beginnings and shape features gives each document's evidence that it should be
rejected (low quality or toxic). Hosts (``source`` up to its first slash) and paths below them (the whole ``source`` and
``lang``) have rates of their own: the expected number of rejections of a path is shrunk towards its host's rate, the
host's towards the global rate, each by a strength that the spread of the rates gives. Posterior odds are the document's
likelihood ratio by the odds of its path's shrunken rate, from which the document itself is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, columns, release, spool, text_slices, utf8_view
from .lexicon import words_of

#: Labelled rows that the model is fitted on, about; hashed features; rounds of fitting.
TRAIN_ROWS, BITS, ROUNDS = 10_000, 18, 60
#: Path rates up to which their table is broadcast.
BROADCAST_ROWS = 100_000
SHAPES, SIGNIFICANT = 11, 4.0
#: Bytes beyond which a word counts as a text without spaces, whose runs of PIECE characters are features too; text bytes of one pass.
LONG, PIECE, PASS_BYTES = 32, 3, 2 << 20
LEVELS = (0.002, 0.01, 0.03, 0.1, 0.3, 0.6)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#$%&*@^~{}[]<>\\_=+")] = True
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True


_SPREAD = np.random.default_rng(20250312).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of whole lower-cased words without ASCII punctuation, of the first four bytes of longer ones, and of pieces.

    Pieces are the runs of PIECE characters in words of more than LONG bytes; they come with their word's number.
    """
    keep = ~_PUNCTUATION[data]
    place = np.concatenate([[0], np.cumsum(keep)])
    data, bounds = _LOWER[data[keep]], place[bounds]
    n = np.diff(bounds)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_SPREAD[data] * _powers(_BASE, len(data))[: len(data)], dtype=np.uint64)])
    back = _powers(_BACK, len(data) + 1)

    def between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        h = (total[b] - total[a]) * back[a] + (b - a).astype(np.uint64)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        return (h ^ (h >> np.uint64(31))) | np.uint64(1)

    full, start = between(bounds[:-1], bounds[1:]), between(bounds[:-1], np.minimum(bounds[:-1] + 4, bounds[1:]))
    full[n == 0] = 0
    start[n < 5] = 0
    none = np.zeros(0, np.int64)
    if not (n > LONG).any():
        return full, start, none.astype(np.uint64), none
    # Places of characters of long words, and of their ends.
    word = np.repeat(np.arange(len(n)), n)
    lead = np.flatnonzero(((data & 0xC0) != 0x80) & (n > LONG)[word])
    whole = np.arange(len(lead)) + PIECE <= len(lead)
    first, last = lead[whole], lead[np.flatnonzero(whole) + PIECE - 1]
    after = np.append(lead[1:], len(data))[np.flatnonzero(whole) + PIECE - 1]
    same = word[first] == word[last]
    first, after, of = first[same], after[same], word[first[same]]
    return full, start, between(first, np.minimum(after, bounds[of + 1])), of


def features(data: np.ndarray, offsets: np.ndarray, chosen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed features of each text (of those ``chosen``), one text after the other, with offsets, and SHAPES numbers per text."""
    ink, bounds, first = words_of(data, offsets)
    full, start, pieces, of = word_hashes(ink, bounds)
    n = np.diff(first)
    row = np.repeat(np.arange(len(n)), n)
    mixed = np.concatenate([full * np.uint64(0x9E3779B97F4A7C15), (start + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F), (pieces + np.uint64(11)) * np.uint64(0x165667B19E3779F9)])
    code = (mixed >> np.uint64(64 - BITS)).astype(np.int64)
    used = np.concatenate([full != 0, start != 0, np.ones(len(pieces), bool)])
    if chosen is not None:
        used &= chosen[code]
    codes = np.sort((np.concatenate([row, row, row[of]])[used] << BITS) | code[used])
    codes = codes[np.concatenate([[True], codes[1:] != codes[:-1]])] if len(codes) else codes
    at = np.searchsorted(codes >> BITS, np.arange(len(first)))
    # Shapes: shares of bytes and of words of certain kinds.
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(n, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind)])
        return (total[offsets[1:]] - total[offsets[:-1]]) / size

    def words(kind: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(kind)])
        return (total[first[1:]] - total[first[:-1]]) / some

    length = np.diff(bounds)
    upper = np.concatenate([[0], np.cumsum(_UPPER[ink])])
    shouted = (upper[bounds[1:]] - upper[bounds[:-1]]) * 2 > np.maximum(length, 3)
    end = bounds[1:] - 1
    marked = (length > 2) & _PUNCTUATION[ink[end]] & _PUNCTUATION[ink[np.maximum(end - 1, 0)]] if len(ink) else np.zeros(0, bool)
    key = full ^ (row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ordered = np.argsort(key, kind="stable")
    repeated = np.zeros(len(full), bool)
    repeated[ordered[1:]] = (key[ordered][1:] == key[ordered][:-1]) & (length[ordered][1:] > 4)
    again = np.zeros(len(full), bool)
    again[1:] = (full[1:] == full[:-1]) & (row[1:] == row[:-1])
    shapes = np.stack(
        [share(_UPPER[data]), share(_DIGIT[data]), share(_SYMBOL[data]), share(data == ord("|")), share(data == 10), words(repeated), words(again), words(shouted), words(marked), np.minimum(words(length), 40) / 40, np.log1p(n) / 10],
        axis=1,
    )
    return (codes & ((1 << BITS) - 1)).astype(np.int32), at, shapes


def expand(shapes: np.ndarray) -> np.ndarray:
    """Shapes in steps, so that a linear model can cut at a level."""
    return np.hstack([shapes, *((shapes > v).astype(float) for v in LEVELS), np.ones((len(shapes), 1))])


class Model:
    """Weights of hashed features and of expanded shapes."""

    def __init__(self) -> None:
        self.words, self.shape = np.zeros(1 << BITS), np.zeros(SHAPES * (1 + len(LEVELS)) + 1)

    def fit(self, codes: np.ndarray, at: np.ndarray, shapes: np.ndarray, reject: np.ndarray, penalty: float = 1e-3) -> Model:
        """Full-batch logistic regression with AdaGrad steps, on features whose rate among rejected rows stands out.

        A feature stands out if its rejected rows differ from what its rows let expect by SIGNIFICANT standard deviations;
        its value is the log of the ratio of its rates, so that a clear feature needs little weight.
        """
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        n, base = len(reject), reject.mean()
        rows = np.bincount(codes, minlength=1 << BITS)
        bad = np.bincount(codes, reject[row], 1 << BITS)
        score = (bad - rows * base) / np.sqrt(np.maximum(rows, 1) * base * (1 - base))
        chosen = (np.abs(score) > SIGNIFICANT) & (rows >= 5)
        ratio = np.where(chosen, np.log((bad + 0.5) / (reject.sum() + 1)) - np.log((rows - bad + 0.5) / (n - reject.sum() + 1)), 0)
        kept = chosen[codes]
        row, codes, x = row[kept], codes[kept], expand(shapes)
        value = ratio[codes]
        word_sum, shape_sum = np.full(1 << BITS, 1e-8), np.full(x.shape[1], 1e-8)
        for step in range(ROUNDS):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, self.words[codes] * value, n) + x @ self.shape, -30, 30)))
            error = p - reject
            word = np.bincount(codes, error[row] * value, 1 << BITS) / n + penalty * self.words / 10
            shape = x.T @ error / n + penalty * self.shape / 10
            word_sum += word**2
            shape_sum += shape**2
            rate = 0.3 / (1 + step / 40)
            self.words -= rate * word / np.sqrt(word_sum)
            self.shape -= rate * shape / np.sqrt(shape_sum)
        self.words *= ratio
        return self

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        codes, at, shapes = features(data, offsets, self.words != 0)
        total = np.concatenate([[0], np.cumsum(self.words[codes])])
        return total[at[1:]] - total[at[:-1]] + expand(shapes) @ self.shape


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> tuple:
    """Features and targets of about ``most`` labelled rows, chosen by a hash of doc_id."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("reject"))
    n = known.count()
    share = min(1_000_003, int(1_000_003 * most / max(1, n)) + 1)
    picked = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) < share)  # about ``most`` rows of two numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", PASS_BYTES):
            codes, at, shapes = features(*utf8_view(batch.column("text")))
            yield columns(doc_id=batch.column("doc_id"), reject=batch.column("reject"), codes=pa.ListArray.from_arrays(at.astype(np.int32), codes), shapes=pa.ListArray.from_arrays((np.arange(len(shapes) + 1) * SHAPES).astype(np.int32), shapes.ravel()))

    joined = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    got = arrow_map(joined, run, "doc_id long, reject int, codes array<int>, shapes array<double>").orderBy("doc_id").toArrow()
    if not got.num_rows:
        return np.zeros(0, np.int32), np.zeros(1, np.int64), np.zeros((0, SHAPES)), np.zeros(0)
    codes, shapes = got.column("codes").combine_chunks(), got.column("shapes").combine_chunks()
    return codes.flatten().to_numpy(), codes.offsets.to_numpy() - codes.offsets[0].as_py(), shapes.flatten().to_numpy().reshape(-1, SHAPES), got.column("reject").to_numpy().astype(float)


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def rates(scored: DataFrame) -> DataFrame:
    """(_host, _path, n, s, host_n, host_s, all_n, all_s, k_host, k_path): expected rejections of each path, its host and all, with the strengths of the priors."""
    paths = scored.groupBy("_host", "_path").agg(F.count("*").cast("double").alias("n"), F.sum("_p").alias("s"))
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    world = hosts.agg(F.sum("host_n").alias("all_n"), F.sum("host_s").alias("all_s"))

    mean = F.col("all_s") / F.col("all_n")
    of_hosts = hosts.crossJoin(world)  # one row on the right
    over_hosts = of_hosts.groupBy("all_n", "all_s").agg(strength(F.col("host_s") / F.col("host_n"), mean, F.col("host_n")).alias("k_host"))
    of_paths = paths.join(of_hosts.join(over_hosts, ["all_n", "all_s"]), "_host")
    host_rate = (F.col("host_s") + F.col("k_host") * mean) / (F.col("host_n") + F.col("k_host"))
    over_paths = of_paths.agg(strength(F.col("s") / F.col("n"), host_rate, F.col("n")).alias("k_path"))
    return of_paths.crossJoin(over_paths)  # one row on the right


def prior(p: Column) -> Column:
    """The shrunken rate of a document's path, from all other documents: ``p``, its own part, is taken out of its path, its host and all."""
    mean = (F.col("all_s") - p) / F.greatest(F.col("all_n") - 1, F.lit(1.0))
    host = (F.col("host_s") - p + F.col("k_host") * mean) / (F.col("host_n") - 1 + F.col("k_host"))
    return (F.col("s") - p + F.col("k_path") * host) / (F.col("n") - 1 + F.col("k_path"))


def strength(rate: Column, centre: Column, n: Column) -> Column:
    """Prior rows by moments: binomial noise of one row over the spread between groups beyond what their sizes explain."""
    noise = F.sum(n * centre * (1 - centre)) / F.sum(n)
    spread = F.sum(n * (rate - centre) ** 2) / F.sum(n) - noise * F.count("*") / F.sum(n)
    return F.least(F.greatest(noise / F.greatest(spread, F.lit(1e-6)), F.lit(1.0)), F.lit(1e6))


def classify(docs: DataFrame, labels: DataFrame, extra: bool = False) -> DataFrame:
    """Columns of ``docs`` (doc_id, text, and source, lang if there) with logit, prior, p_reject and accepted.

    ``extra``: keep all columns of ``docs``; otherwise doc_id alone. Rejected are rows with p_reject of a half or more. A null
    text is an empty one; a null source or lang is a host or path of its own; repeated rows are judged each; without
    usable labels all weights are zero and every row is accepted; an empty table gives no rows. The new columns replace
    columns of these names; ``accepted_rows`` keeps them.
    """
    kept = [c for c in docs.columns if extra and c not in NEW] if extra else ["doc_id"]
    judged, inner = _judged(docs, labels, kept)
    return judged.select(*(F.col(i).alias(c) for c, i in inner.items()), *NEW)


NEW = ("logit", "prior", "p_reject", "accepted")


def accepted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The accepted rows of ``docs`` with all their columns, whatever their names, and no others."""
    judged, inner = _judged(docs, labels, docs.columns)
    return judged.where("accepted").select(*(F.col(i).alias(c) for c, i in inner.items()))


def _judged(docs: DataFrame, labels: DataFrame, kept: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """NEW columns and those ``kept``, under inner names that nothing clashes with."""
    codes, at, shapes, reject = training_rows(docs, labels)
    model = Model().fit(codes, at, shapes, reject) if len(reject) and 0 < reject.mean() < 1 else None
    words, shape = (model.words.astype(np.float32), model.shape) if model else (None, None)
    base = float(np.clip(reject.mean(), 1e-6, 1 - 1e-6)) if model else 1e-3

    @F.pandas_udf("double")
    def evidence(text):
        out = np.full(len(text), np.log(base / (1 - base)))
        if words is None:
            return _series(out)
        used = Model()
        used.words, used.shape = words.astype(np.float64), shape
        batch = pa.RecordBatch.from_arrays([pa.array(text, pa.large_string())], names=["text"])
        done = 0
        for part in text_slices([batch], "text", PASS_BYTES):
            out[done : done + part.num_rows] = used.logits(*utf8_view(part.column(0)))
            done += part.num_rows
        release()
        return _series(out)

    have = set(docs.columns)
    source = F.coalesce(F.col("source").cast("string"), F.lit("\0")) if "source" in have else F.lit("")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("\0")) if "lang" in have else F.lit("")
    inner = {c: f"_in_{i}" for i, c in enumerate(kept)}
    scored = docs.select(*(F.col(f"`{c}`").alias(i) for c, i in inner.items()), F.substring_index(source, "/", 1).alias("_host"), F.concat_ws("\1", source, lang).alias("_path"), evidence(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("logit"))
    scored = spool(scored.withColumn("_p", 1 / (1 + F.exp(-F.col("logit")))), "scored")
    of_paths = spool(rates(scored), "rates")
    few = of_paths.count() <= BROADCAST_ROWS
    joined = scored.join(F.broadcast(of_paths) if few else of_paths, ["_host", "_path"]).withColumn("prior", prior(F.col("_p")))
    combined = F.col("logit") - float(np.log(base / (1 - base))) + logit(F.col("prior"))
    out = joined.withColumn("p_reject", 1 / (1 + F.exp(-combined))).withColumn("accepted", F.col("p_reject") < 0.5)
    return out.select(*inner.values(), *NEW), inner


def _series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values)
