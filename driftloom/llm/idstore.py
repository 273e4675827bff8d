"""Operator 6, token ids in a content-addressed store.

A store is a folder with ``data`` (Parquet, rows and files in ascending doc_id order) and ``store`` (one row). A row of
``data`` is a document:

``doc_id``, ``row`` (identity of the input row), ``file`` (number of its file), ``start``, ``n_tokens``; ``recipe``: the
16-byte digests of the document's chunks, in order; ``sizes``: their ids as uint16; ``owned``: one byte per chunk: 0 if
another document holds the chunk's ids, 1 if this one does, 2 if it does and others refer to it; ``payload``: the ids of the
owned chunks; ``root``: Merkle root of the recipe. After the documents of a file comes its manifest, a row with ``row`` = -1
whose ``root`` is the Merkle root of the documents' roots, whose ``n_tokens`` is their number of ids and whose ``start`` is
that of the first. ``store`` has the number of files and ids, the bytes of an id (two, or four for vocabularies of more than
65,536) and the Merkle root of the files' roots. Reading recomputes all of them.

A rolling hash over the last WINDOW ids cuts an id stream, so equal passages give equal chunks wherever they lie. A chunk
is stored once: with the first row, in order of doc_id, that has it.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrow_map, binary_array, columns, ragged, session_dir, spool, text_slices, unspool, utf8_view
from .tokenizing import encoder, with_end

WINDOW, LEAST, MASK, MOST, DIGEST = 16, 64, 255, 2048, 16  # WINDOW is a power of two
_FACTOR = 0x9E3779B97F4A7C15

STAGED = "doc_id long, row long, n_tokens long, recipe binary, sizes binary, payload binary"
FILE = "doc_id long, row long, file int, start long, n_tokens long, recipe binary, sizes binary, owned binary, payload binary, root binary"
STORE = "files long, n_tokens long, width int, root binary"


def rolling(ids: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW ids that end at each place, modulo 2**64, mixed."""
    total = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    total ^= total >> np.uint64(32)
    width = 1
    while width < WINDOW:  # of two windows one of twice the width
        wider = total.copy()
        wider[width:] += total[:-width] * np.uint64(pow(_FACTOR, width, 1 << 64)) if width < len(total) else 0
        total, width = wider, 2 * width
    return (total * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)


def chunk_starts(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all chunks (and the end): after a hash hit at least LEAST ids on, after MOST ids, and at every document."""
    hits = np.flatnonzero((rolling(ids) & np.uint64(MASK)) == 0) + 1
    out, k = [], 0
    hits = hits.tolist() + [1 << 62]
    for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        at = lo
        while at < hi:
            out.append(at)
            while hits[k] < at + LEAST:
                k += 1
            at = min(hits[k], at + MOST, hi)
    return np.array([*out, offsets[-1]], np.int64)


def digests_of(raw: bytes, bounds: np.ndarray) -> bytes:
    ends = bounds.tolist()
    return b"".join(hashlib.blake2b(raw[a:b], digest_size=DIGEST).digest() for a, b in zip(ends[:-1], ends[1:], strict=True))


def merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd last leaf moves up as it is."""
    if not leaves:
        return hashlib.blake2b(b"", digest_size=DIGEST).digest()
    while len(leaves) > 1:
        up = [hashlib.blake2b(b"\1" + a + b, digest_size=DIGEST).digest() for a, b in zip(leaves[::2], leaves[1::2], strict=False)]
        leaves = up + leaves[len(leaves) - len(leaves) % 2 :]
    return leaves[0]


def split_digests(recipe: bytes) -> list[bytes]:
    return [recipe[i : i + DIGEST] for i in range(0, len(recipe), DIGEST)]


def roots_of(recipes: bytes, at: np.ndarray) -> list[bytes]:
    """Merkle roots of recipes that lie one after the other; ``at``: their byte offsets."""
    ends = at.tolist()
    return [recipes[a:b] if b - a == DIGEST else merkle(split_digests(recipes[a:b])) for a, b in zip(ends[:-1], ends[1:], strict=True)]


def flat(column: pa.Array, dtype: str = "u1") -> tuple[np.ndarray, np.ndarray]:
    """Values of a binary column, one after the other, and their offsets, in items of ``dtype``; a null is empty."""
    data, at = utf8_view(column.cast(pa.large_binary()))
    return data.view(dtype), at // np.dtype(dtype).itemsize


def spread(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs of these lengths."""
    return np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])


def staged(docs: DataFrame, tokenizer: str, end_id: int, width: int) -> DataFrame:
    """Every row's ids, ``width`` bytes each, cut into chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, row = encoder(tokenizer), TaskContext.get().partitionId() << 33
        for batch in text_slices(batches, "text"):
            ids, at = with_end(*code.encode(*utf8_view(batch.column("text"))), end_id)
            starts = chunk_starts(ids, at)
            raw = ids.astype(f"<u{width}")
            recipe = np.frombuffer(digests_of(raw.tobytes(), starts * width), np.uint8)
            first = np.searchsorted(starts, at)
            n = batch.num_rows
            yield columns(
                doc_id=batch.column("doc_id"), row=np.arange(row, row + n), n_tokens=np.diff(at),
                recipe=binary_array(recipe, first * DIGEST), sizes=binary_array(np.diff(starts).astype("<u2").view(np.uint8), first * 2), payload=binary_array(raw.view(np.uint8), at * width),
            )
            row += n

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, STAGED, keep_cache=True)


def references(stage: DataFrame) -> DataFrame:
    """(digest, doc_id, row, at) for each chunk of each row, from the recipes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = batch.column("recipe").buffers()[2], np.frombuffer(batch.column("recipe").buffers()[1], np.int32)[batch.column("recipe").offset :][: batch.num_rows + 1]
            n = np.diff(at) // DIGEST
            doc = np.repeat(np.arange(batch.num_rows), n)
            whole = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
            yield columns(digest=binary_array(whole, np.arange(len(doc) + 1) * DIGEST), doc_id=batch.column("doc_id").take(pa.array(doc)), row=batch.column("row").take(pa.array(doc)), at=(np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32))

    return arrow_map(stage.select("doc_id", "row", "recipe"), run, "digest binary, doc_id long, row long, at int")


def in_order(rows: DataFrame) -> DataFrame:
    """(row, start): ids of all rows before, by doc_id, then row; sums within ranges of doc_id, then over the ranges."""
    ranged = spool(rows.repartitionByRange("doc_id", "row").withColumn("range", F.spark_partition_id()), "order")
    sums = ranged.groupBy("range").agg(F.sum("n_tokens").alias("n"))  # one row per range
    before = sums.select("range", F.coalesce(F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n_tokens").over(W.partitionBy("range").orderBy("doc_id", "row").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(before, "range").select("doc_id", "row", (F.col("base") + F.col("inside")).alias("start"))


def vocabulary(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


def write(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2) -> None:
    """Write the ids of ``docs`` (doc_id, text), each text followed by ``end_id``, as a store at ``path``.

    A null text is an empty one (its end id alone); a null doc_id sorts first; repeated rows are kept each and share
    their chunks; an empty table gives an empty store; other columns are not looked at.
    """
    spark, width = docs.sparkSession, 2 if max(vocabulary(tokenizer), end_id + 1) <= 1 << 16 else 4
    stage = spool(staged(docs, tokenizer, end_id, width), "staged")
    refs = references(stage)
    # Only digests that occur again are joined back to their places.
    shared = refs.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    marks = refs.join(shared, "digest").select("doc_id", "row", "at", F.when(F.struct("doc_id", "row", "at").eqNullSafe(F.col("owner")), 2).otherwise(0).alias("mark"))
    marked = marks.groupBy("row").agg(F.collect_list(F.struct("at", "mark")).alias("marks"))
    head = spool(in_order(stage.select("doc_id", "row", "n_tokens")).join(marked, "row", "left").withColumn("n_tokens", F.lit(None).cast("long")), "head")
    both = head.select("doc_id", "row", "start", "n_tokens", F.col("marks.at").alias("at"), F.col("marks.mark").alias("mark"), *(F.lit(None).cast("binary").alias(c) for c in ("recipe", "sizes", "payload"))).unionByName(stage, allowMissingColumns=True)
    # A row's start and marks come just before its chunks, in the range of its doc_id.
    sorted_ = both.repartitionByRange("doc_id", "row").sortWithinPartitions("doc_id", "row", F.col("start").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, kept, roots, total, first = TaskContext.get().partitionId(), None, [], 0, None
        for batch in batches:
            if kept is not None:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            bare = batch.column("recipe").is_null().to_numpy(zero_copy_only=False)
            # A head whose chunks come in the next batch waits for them.
            n = len(bare) - bool(bare[-1])
            kept = batch.slice(n) if bare[-1] else None
            if not n:
                continue
            head, body = (batch.slice(0, n).filter(pa.array(x)) for x in (bare[:n], ~bare[:n]))
            if head.num_rows != body.num_rows or not head.column("row").equals(body.column("row")):
                raise ValueError("a row's head and chunks lie in different ranges")
            recipe, recipe_at = flat(body.column("recipe"))
            sizes, chunk_at = flat(body.column("sizes"), "<u2")
            payload, payload_at = flat(body.column("payload"), f"<u{width}")
            owned = np.ones(len(sizes), np.uint8)
            listed = pc.fill_null(pc.list_value_length(head.column("at")), 0).to_numpy()
            owned[np.repeat(chunk_at[:-1], listed) + pc.list_flatten(head.column("at")).to_numpy()] = pc.list_flatten(head.column("mark")).to_numpy()
            if not owned.all():
                held = spread(np.where(owned > 0, sizes, 0))
                payload, payload_at = payload[np.repeat(owned > 0, sizes)], held[chunk_at]
            found = roots_of(recipe.tobytes(), recipe_at)
            roots += found
            start, n_tokens = head.column("start"), body.column("n_tokens")
            first, total = start[0].as_py() if first is None else first, total + pc.sum(n_tokens).as_py()
            yield columns(
                doc_id=body.column("doc_id"), row=body.column("row"), file=np.full(len(found), file, np.int32), start=start, n_tokens=n_tokens, recipe=body.column("recipe"), sizes=body.column("sizes"),
                owned=binary_array(owned, chunk_at), payload=binary_array(payload.view(np.uint8), payload_at * width), root=pa.array(found, pa.binary()),
            )
        if kept is not None:
            raise ValueError("a row's head and chunks lie in different ranges")
        if roots:
            yield pa.RecordBatch.from_pylist([{"row": -1, "file": file, "start": first, "n_tokens": total, "root": merkle(roots)}], SCHEMA)

    arrow_map(sorted_, run, FILE).write.option("compression", "zstd").parquet(f"{path}/data")
    # One row per file, as many as the driver lists anyway.
    files = spark.read.schema(FILE).parquet(f"{path}/data").where("row = -1").select("start", "n_tokens", "root").orderBy("start").collect()
    spark.createDataFrame([(len(files), sum(f.n_tokens for f in files), width, merkle([bytes(f.root) for f in files]))], STORE).coalesce(1).write.parquet(f"{path}/store")
    for part in (stage, head):
        unspool(part)


SCHEMA = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("file", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.binary()) for c in ("recipe", "sizes", "owned", "payload", "root"))])


def verify(spark: SparkSession, path: str) -> int:
    """Compare the roots, starts and numbers of ids of all rows with the files' manifests, and those with the store's; raise on any difference. Returns the bytes of an id."""
    stored = spark.read.schema(STORE).parquet(f"{path}/store").collect()  # one row
    if len(stored) != 1:
        raise ValueError(f"the store at {path} has no manifest of its own")
    rows = spark.read.schema(FILE).parquet(f"{path}/data").select("file", "row", "start", "n_tokens", "root")

    def check(one: pa.Table) -> pa.Table:
        """A file's rows."""
        of_file = one.column("row").to_numpy() == -1
        manifest, docs = one.filter(pa.array(of_file)), one.filter(pa.array(~of_file)).sort_by("start")
        start, n = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
        sound = manifest.num_rows == 1 and len(n) and (start[1:] == start[:-1] + n[:-1]).all() and (start[0], n.sum(), merkle(docs.column("root").to_pylist())) == tuple(manifest.column(c)[0].as_py() for c in ("start", "n_tokens", "root"))
        return pa.table({"file": one.column("file").slice(0, 1), "sound": pa.array([bool(sound)]), "start": pa.array([start[0] if len(n) else None], pa.int64()), "n_tokens": pa.array([n.sum()], pa.int64()), "root": pa.array([manifest.column("root")[0].as_py() if manifest.num_rows else None], pa.binary())})

    files = rows.groupBy("file").applyInArrow(check, "file int, sound boolean, start long, n_tokens long, root binary").orderBy("start").collect()  # one row per file
    for f in files:
        if not f.sound:
            raise ValueError(f"file {f.file} of the store at {path} does not match its manifest")
    ends = np.concatenate([[0], np.cumsum([f.n_tokens for f in files], dtype=np.int64)])
    whole = stored[0]
    if [f.start for f in files] != ends[:-1].tolist() or (len(files), int(ends[-1]), merkle([bytes(f.root) for f in files])) != (whole.files, whole.n_tokens, bytes(whole.root)):
        raise ValueError(f"files of the store at {path} are missing or do not match its manifest")
    return whole.width


def read(spark: SparkSession, path: str, checksums: bool = False) -> DataFrame:
    """(doc_id, start, ids in little-endian bytes) of every document of a store; ``checksums``: n_tokens and ids_crc32 (over uint32) in place of the ids.

    Manifests are verified first, and each document by its chunks' digests and its root when it is put together; a
    difference raises.
    """
    width = verify(spark, path)
    rows = spark.read.schema(FILE).parquet(f"{path}/data").where("row >= 0")

    def requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (recipe, _), (owned, at) = flat(batch.column("recipe")), flat(batch.column("owned"))
            asked = np.flatnonzero(owned == 0)
            doc = np.searchsorted(at, asked, side="right") - 1
            yield columns(digest=binary_array(recipe.reshape(-1, DIGEST)[asked].ravel(), np.arange(len(asked) + 1) * DIGEST), row=batch.column("row").take(pa.array(doc)), at=(asked - at[doc]).astype(np.int32))

    def offers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (recipe, _), (owned, _), (sizes, _) = flat(batch.column("recipe")), flat(batch.column("owned")), flat(batch.column("sizes"), "<u2")
            payload, _ = flat(batch.column("payload"), f"<u{width}")
            offered = owned == 2
            held = np.repeat(offered[owned > 0], sizes[owned > 0])
            yield columns(digest=binary_array(recipe.reshape(-1, DIGEST)[offered].ravel(), np.arange(offered.sum() + 1) * DIGEST), ids=binary_array(payload[held].view(np.uint8), spread(sizes[offered]) * width))

    wanted = arrow_map(rows.where(has_byte("owned", 0)).select("row", "recipe", "owned"), requests, "digest binary, row long, at int")
    offered = arrow_map(rows.where(has_byte("owned", 2)).select("recipe", "sizes", "owned", "payload"), offers, "digest binary, ids binary")
    fetched = wanted.join(offered, "digest").select("row", "at", F.col("ids").alias("payload"))

    def rebuilt(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Documents, each followed by the chunks from elsewhere in order of their place."""
        own = batch.column("recipe").is_valid().to_numpy(zero_copy_only=False)
        body = batch.filter(pa.array(own))
        (recipe, recipe_at), (owned, chunk_at), (sizes, _) = flat(body.column("recipe")), flat(body.column("owned")), flat(body.column("sizes"), "<u2")
        ids, at = flat(batch.column("payload"), f"<u{width}")
        docs = spread(sizes)[chunk_at]
        if not own.all() or (owned == 0).any():
            sizes, source = sizes.astype(np.int64), np.zeros(len(sizes), np.int64)
            # A document's own chunks follow each other from its row's start; the others are the rows after it.
            mine = np.where(owned > 0, sizes, 0)
            doc = np.repeat(np.arange(len(chunk_at) - 1), np.diff(chunk_at))
            before = spread(mine)[:-1]
            source[owned > 0] = (at[:-1][own][doc] + before - before[np.minimum(chunk_at[:-1], len(before) - 1)][doc])[owned > 0]
            if (owned == 0).sum() != (~own).sum() or (np.bincount(doc[owned == 0], minlength=body.num_rows) != np.diff(np.append(np.flatnonzero(own), len(own))) - 1).any() or (np.diff(at)[~own] != sizes[owned == 0]).any():
                raise ValueError("documents do not match their recipes: chunks are missing")
            source[owned == 0] = at[:-1][~own]
            ids = ids[ragged(source, sizes)]
        if len(ids) != docs[-1] or digests_of(ids.tobytes(), spread(sizes) * width) != recipe.tobytes():
            raise ValueError("documents do not match their recipes")
        if roots_of(recipe.tobytes(), recipe_at) != body.column("root").to_pylist():
            raise ValueError("documents do not match their roots")
        found = {"doc_id": body.column("doc_id"), "start": body.column("start")}
        if checksums:
            whole, ends = ids.astype("<u4"), docs.tolist()
            return columns(**found, n_tokens=np.diff(docs), ids_crc32=np.array([zlib.crc32(whole[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64))
        return columns(**found, ids=binary_array(ids.view(np.uint8), docs * width))

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            # The last document may go on in the next batch.
            last = np.flatnonzero(batch.column("recipe").is_valid().to_numpy(zero_copy_only=False))
            if not len(last):
                kept.append(batch)
                continue
            whole = [*kept, batch.slice(0, last[-1])]
            kept = [batch.slice(last[-1])]
            if sum(b.num_rows for b in whole):
                yield rebuilt(pa.Table.from_batches(whole).combine_chunks().to_batches()[0])
        if kept:
            yield rebuilt(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    result = "doc_id long, start long, " + ("n_tokens long, ids_crc32 long" if checksums else "ids binary")
    own = rows.select("row", F.lit(-1).alias("at"), "doc_id", "start", "recipe", "sizes", "owned", "payload", "root")
    mixed = own.where(has_byte("owned", 0)).unionByName(fetched, allowMissingColumns=True).repartition("row").sortWithinPartitions("row", "at")
    return arrow_map(own.where(~has_byte("owned", 0)), rebuild, result).unionByName(arrow_map(mixed, rebuild, result))


def has_byte(column: str, value: int) -> Column:
    """Whether ``owned`` marks any chunk so."""
    return F.hex(column).contains(f"0{value}")


def fresh_path(spark: SparkSession) -> str:
    return f"{session_dir(spark)}/idstore-{uuid.uuid4().hex}"
