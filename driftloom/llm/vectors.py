"""Operators 4 and 10 on embedding tables: exact top-k by int8 tiles with error bounds, and near-duplicate groups by cells.

In both, vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without vec_id and
vectors of another length than the most frequent one (ties: the longer) of the table, or of the candidates.

Vectors are held as float32, and all sums in double precision are over those. Components of a table of doubles that float32
does not hold exactly would be other vectors, so they raise; who wants them rounded casts the column.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import arrow_map, columns, spool
from .components import components

#: Queries of one block, bytes of candidates of one block, candidates of one tile, dimensions whose int8 products float32 holds.
ASKED, CANDIDATES, TILE, EXACT = 4096, 8 << 20, 1024, 1024
#: k-means: rows of the sample, vectors a cell should hold, most cells of one level, rounds.
SAMPLE, CELL, CELLS, ROUNDS = 20_000, 512, 4096, 8
#: Rows from which a cell is cut into cells of its own, and cells that a vector may lie in on average where one is cut.
CROWDED, COPIES = 16_384, 8
#: Distance beyond a cell's border, as a sine, up to which a vector is compared in that cell too.
MARGIN = 0.08
#: Vectors of one block; a group of rows is two blocks of one cell.
BLOCK = 2048


def is_sound() -> Column:
    e = F.col("embedding")
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & e.isNotNull() & whole, F.lit(False))


def sound(table: DataFrame) -> DataFrame:
    return table.where(is_sound())


def common_width(table: DataFrame) -> int:
    """The most frequent number of components of sound vectors; 0 without any."""
    common = sound(table).groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return common[0] if common else 0


def usable(table: DataFrame, width: int | None = None) -> DataFrame:
    """(vec_id, raw): sound vectors of ``width`` components, the common one unless given, as little-endian float32 bytes."""
    e, width = F.col("embedding"), common_width(table) if width is None else width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pc.list_flatten(batch.column("embedding")).to_numpy(zero_copy_only=False).astype("<f4")
            bytes_ = pa.Array.from_buffers(pa.binary(4 * width), batch.num_rows, [None, pa.py_buffer(flat)]).cast(pa.binary()) if batch.num_rows else pa.array([], pa.binary())
            yield columns(vec_id=batch.column("vec_id"), raw=bytes_)

    if table.schema["embedding"].dataType.simpleString() == "array<double>":
        fits = F.forall(e, lambda x: x.cast("float").cast("double") == x)
        e = F.when(fits, e).otherwise(F.raise_error(F.concat(F.lit("float32 does not hold the vector of vec_id "), F.col("vec_id").cast("string"))).cast("array<double>"))
    return arrow_map(sound(table).where(F.size("embedding") == width).select(F.col("vec_id").cast("long"), e.cast("array<float>").alias("embedding")), run, "vec_id long, raw binary")


def matrix(raw: pa.Array) -> np.ndarray:
    rows = raw.to_pylist()
    return np.frombuffer(b"".join(rows), "<f4").reshape(len(rows), -1)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale and sum of absolute codes of each row; a component is its code by the scale, half a scale off at most."""
    scale = np.abs(x).max(axis=1).astype(np.float64) / 127
    codes = np.rint(x / np.maximum(scale, 1e-300)[:, None]).astype(np.int8)
    return codes, scale, np.abs(codes.astype(np.int64)).sum(axis=1)


def inner_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row in double precision, summed from the first component to the last, so that equal rows give equal bits."""
    total = np.zeros(len(x))
    for k in range(x.shape[1]):
        total += x[:, k].astype(np.float64) * y[:, k].astype(np.float64)
    return total


def search(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``candidates`` with the largest inner product with each query.

    Both have (vec_id, embedding). A query never finds a row of its own vec_id; ties go to the smaller vec_id; with fewer
    candidates all are returned; an unusable query, one of another length than the candidates among them, has no rows;
    repeated queries count once, the row with the least bytes, and repeated candidates each. Queries are dealt over blocks of about ASKED and candidates over
    blocks of about CANDIDATES bytes, and each two blocks meet in a group: int8 products of a tile are bounded, what
    the bounds leave is recomputed in double precision, and a heap per query keeps k. The driver has two counts.
    """
    width = common_width(candidates)
    rows = spool(usable(candidates, width).withColumn("place", F.monotonically_increasing_id()), "candidates")
    asked = spool(usable(queries, width).groupBy("vec_id").agg(F.min("raw").alias("raw")), "queries")
    blocks, of = max(1, -(-asked.count() // ASKED)), max(1, -(-rows.count() * 4 * max(1, width) // CANDIDATES))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("i"), every(of).alias("j"), F.lit(True).alias("asks"), "vec_id", "raw")
    right = rows.select(every(blocks).alias("i"), F.pmod("place", F.lit(of)).cast("int").alias("j"), F.lit(False).alias("asks"), "vec_id", "raw")

    def meet(pair: pa.Table) -> pa.Table:
        asks = pair.column("asks").to_numpy()
        q, c = pair.filter(pa.array(asks)), pair.filter(pa.array(~asks))
        found = nearest(*((np.array(t.column("vec_id")), matrix(t.column("raw"))) for t in (q, c)), k) if q.num_rows and c.num_rows else []
        return pa.table({"query_id": pa.array([f[0] for f in found], pa.int64()), "vec_id": pa.array([f[1] for f in found], pa.int64()), "score": pa.array([f[2] for f in found], pa.float64())})

    met = left.unionByName(right).groupBy("i", "j").applyInArrow(meet, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def int8_products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact: float32 holds the sums over EXACT components, which are added in float64."""
    total = np.zeros((len(x), len(y)))
    for lo in range(0, x.shape[1], EXACT):
        total += x[:, lo : lo + EXACT] @ y[:, lo : lo + EXACT].T
    return total


def nearest(asked: tuple[np.ndarray, np.ndarray], candidates: tuple[np.ndarray, np.ndarray], k: int) -> list[tuple[int, int, float]]:
    """(query, candidate, score) of the k best candidates of each query; both are (ids, vectors)."""
    (query_ids, q), (ids, x) = asked, candidates
    codes, scale, total = quantised(q)
    as_float = codes.astype(np.float32)
    heaps: list[list[tuple[float, int]]] = [[] for _ in q]
    least = np.full(len(q), -np.inf)
    for lo in range(0, len(ids), TILE):
        tile, tile_ids = x[lo : lo + TILE], ids[lo : lo + TILE]
        c, s, t = quantised(tile)
        est = int8_products(as_float, c.astype(np.float32))
        err = 0.5 * total[:, None] + 0.5 * t + 0.25 * q.shape[1]
        both = scale[:, None] * s
        upper, lower = (est + err) * both, (est - err) * both
        slack = 1e-9 * np.abs(upper) + 1e-300
        floor = least.copy()
        if len(tile) > k + 1:  # rows of the query's own id do not count; there may be many
            own = (query_ids[:, None] == tile_ids).sum(axis=1).max(initial=0)
            if len(tile) > k + own:
                floor = np.maximum(floor, np.partition(lower, -(k + own), axis=1)[:, -(k + own)])
        row, col = np.nonzero(upper + slack >= (floor - 1e-9 * np.abs(floor))[:, None])
        row, col = row[other := query_ids[row] != tile_ids[col]], col[other]
        score = np.concatenate([inner_products(q[row[i : i + 100_000]], tile[col[i : i + 100_000]]) for i in range(0, len(row), 100_000)] or [np.zeros(0)])
        for r, v, i in zip(row.tolist(), score.tolist(), tile_ids[col].tolist(), strict=True):
            heap = heaps[r]
            if len(heap) < k:
                heapq.heappush(heap, (v, -i))
            elif (v, -i) > heap[0]:
                heapq.heapreplace(heap, (v, -i))
        for r in np.unique(row).tolist():
            if len(heaps[r]) == k:
                least[r] = heaps[r][0][0]
    return [(i, -n, v) for i, heap in zip(query_ids.tolist(), heaps, strict=True) for v, n in heap]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Unit centres; an empty cell takes the vector worst served so far."""
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)]
    for _ in range(rounds):
        near = sample @ centres.T
        home = near.argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        norm = np.linalg.norm(sums, axis=1)
        bad = np.flatnonzero(norm < 1e-12)
        if len(bad):
            sums[bad] = sample[np.argsort(near.max(axis=1))[: len(bad)]]
            norm[bad] = 1
        centres = sums / norm[:, None]
    return centres


#: A cell's id is its number shifted by LEVEL, plus the number of the cell that it was cut into.
LEVEL = 20
ASSIGNED = "cell long, home boolean, of long, cells array<long>, rep long, n long, raw binary"
#: Cells up to which their sizes are broadcast.
BROADCAST_ROWS = 1_000_000


def within_margin(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows and centres that belong together: each row's nearest centre and those whose border is nearer than MARGIN; and the nearest ones."""
    near = x @ centres.T
    home = near.argmax(axis=1)
    far = np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
    row, cell = np.nonzero(near.max(axis=1)[:, None] - near <= MARGIN * far)
    return row, cell, home


def cell_centres(x: np.ndarray, cells: int) -> np.ndarray:
    """Centres of a crowded cell; fewer, or one, where vectors lie so close together that each would be in more than COPIES cells."""
    while cells > 1:
        centres = spherical_kmeans(x, cells)
        if len(within_margin(x[:4096], centres)[0]) <= COPIES * len(x[:4096]):
            return centres
        cells //= 4
    return x[:1]


def cut_crowded(assigned: DataFrame) -> DataFrame:
    """``assigned`` with cells of more than CROWDED rows cut by k-means of their own, by the same margin.

    Centres are fitted in a task per cell, on about SAMPLE of its home vectors; its rows meet them in shares, so a cell is
    many tasks. A second level takes CELLS times CELLS cells; near copies that no cut parts stay in one cell, which blocks deal out.
    """
    crowded = assigned.groupBy("cell").agg(F.count("*").alias("m"), F.count_if("home").alias("own")).where((F.col("m") > CROWDED) & (F.col("own") > CELL))
    crowded = spool(crowded.select("cell", "own", F.ceil(F.col("m") / (4 * CROWDED)).cast("int").alias("shares")), "crowded")  # CELLS rows at most
    if crowded.isEmpty():
        return assigned
    sampled = assigned.where("home").join(F.broadcast(crowded), "cell").where(F.pmod(F.xxhash64("raw"), F.lit(1_000_003)) < 1_000_003 * F.lit(SAMPLE) / F.col("own"))

    def fit(rows: pa.Table) -> pa.Table:
        centres = cell_centres(unit(matrix(rows.sort_by("raw").column("raw"))), max(1, min(CELLS, rows.column("own")[0].as_py() // CELL)))
        return pa.table({"cell": rows.column("cell").slice(0, 1), "centres": pa.array([centres.astype("<f8").tobytes()], pa.binary())})

    fitted = spool(sampled.select("cell", "own", "raw").groupBy("cell").applyInArrow(fit, "cell long, centres binary"), "centres")
    cut = crowded.join(fitted.select("cell"), "cell")
    shares = cut.join(fitted, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("place"), F.col("centres").alias("raw"))
    rows = assigned.join(F.broadcast(cut), "cell").select("cell", F.pmod(F.xxhash64("rep"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("place"), "home", "rep", "n", "raw")
    dealt = rows.unionByName(shares, allowMissingColumns=True).repartition("cell", "share").sortWithinPartitions("cell", "share", "place").select("cell", "place", "home", "rep", "n", "raw")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, np.ndarray] | None = None
        for batch in batches:
            first = np.flatnonzero(batch.column("place").to_numpy() == 0)
            for lo, hi in zip([0, *first.tolist()], [*first.tolist(), batch.num_rows], strict=True):
                part = batch.slice(lo, hi - lo)
                if part.num_rows and part.column("place")[0].as_py() == 0:
                    held = part.column("cell")[0].as_py(), np.frombuffer(part.column("raw")[0].as_py(), "<f8")
                    part = part.slice(1)
                for at in range(0, part.num_rows, 2048):
                    some = part.slice(at, 2048)
                    if held is None or some.column("cell")[0].as_py() != held[0]:
                        raise ValueError("a vector came before its cell's centres")
                    x = unit(matrix(some.column("raw")))
                    row, cell, home = within_margin(x, held[1].reshape(-1, x.shape[1]))
                    take = pa.array(row)
                    yield columns(cell=held[0] + cell, home=some.column("home").to_numpy(zero_copy_only=False)[row] & (cell == home[row]), rep=some.column("rep").take(take), n=some.column("n").take(take), raw=some.column("raw").take(take))

    parts = arrow_map(dealt, place, "cell long, home boolean, rep long, n long, raw binary")
    parts = spool(assigned.join(F.broadcast(cut), "cell", "left_anti").select("cell", "home", "rep", "n", "raw").unionByName(parts), "parts")
    # A vector is in tens of cells at most.
    lists = parts.groupBy("rep").agg(F.collect_list("cell").alias("all"), F.max(F.when(F.col("home"), F.col("cell"))).alias("of"))
    return spool(parts.join(lists, "rep").select("cell", "home", "of", F.when(F.col("home"), F.col("all")).otherwise(F.array().cast("array<long>")).alias("cells"), "rep", "n", "raw"), "cells")


def near_duplicates(table: DataFrame, least: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table`` (vec_id, embedding).

    Rows link when their cosine in double precision is ``least`` or more. Rows with equal bytes are compared once and
    counted each; an unusable row has no links and is its own component; rows with one vec_id are one node. The k-means
    is fitted on a sample of about SAMPLE vectors, but every vector is assigned: to its cell, and to all cells
    whose border is nearer than MARGIN. A crowded cell is cut into cells of its own. Pairs further apart from a common cell than
    that are not found; recall is measured in the tests. A pair that is found counts once for each end, from whichever cell. A cell's vectors are dealt over blocks of about BLOCK, and what
    meets is two blocks, once, so a crowded cell is dealt over many tasks; what comes out is a count per vector and a
    spanning forest, never the pairs.
    """
    width = common_width(table)
    rows = usable(table, width)
    same = spool(rows.groupBy("raw").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "vectors")
    n = same.count()
    if not n:
        return table.select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    picked = same if n <= SAMPLE else same.where(F.pmod(F.xxhash64("raw"), F.lit(1_000_003)) < int(1_000_003 * SAMPLE / n))
    centres = spherical_kmeans(unit(matrix(picked.select("raw").orderBy("raw").toArrow().column("raw"))), max(1, min(CELLS, n // CELL)))
    apart = np.linalg.norm(centres[:, None, :] - centres[None, :, :], axis=2) if len(centres) <= 512 else None

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                x = unit(matrix(part.column("raw")))
                near = x @ centres.T
                home = near.argmax(axis=1)
                gap = near.max(axis=1)[:, None] - near
                far = apart[home] if apart is not None else np.sqrt(np.maximum(0, 2 - 2 * centres[home] @ centres.T))
                row, cell = np.nonzero(gap <= MARGIN * far)
                take = pa.array(row)
                mine = cell == home[row]
                at = np.zeros(len(row) + 1, np.int32)
                at[1:][mine] = np.bincount(row, minlength=len(x))[row[mine]]
                # A row at home knows all its cells; elsewhere it knows its home.
                cell, of = cell.astype(np.int64) << LEVEL, home[row].astype(np.int64) << LEVEL
                cells = pa.ListArray.from_arrays(np.cumsum(at, dtype=np.int32), cell)
                yield columns(cell=cell, home=mine, of=of, cells=cells, rep=part.column("rep").take(take), n=part.column("n").take(take), raw=part.column("raw").take(take))

    assigned = spool(arrow_map(same.select("rep", "n", "raw"), assign, ASSIGNED), "cells")
    assigned = cut_crowded(assigned)
    # One row per cell. Home vectors are dealt over blocks 0 to own - 1, visitors over the blocks after them;
    # block i of those at home meets every block j from itself on, so two blocks meet once.
    sizes = assigned.groupBy("cell").agg(F.ceil(F.count_if("home") / BLOCK).cast("int").alias("own"), F.ceil(F.count_if(~F.col("home")) / BLOCK).cast("int").alias("away")).where("own > 0")
    sizes = spool(sizes, "sizes")
    dealt = assigned.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes, "cell").withColumn("block", F.when(F.col("home"), F.pmod(F.xxhash64("rep"), F.col("own"))).otherwise(F.col("own") + F.pmod(F.xxhash64("rep"), F.col("away"))).cast("int"))
    left = dealt.where("home").select("cell", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.col("own") + F.col("away") - 1)).alias("j"), F.lit(True).alias("left"), "home", "of", "cells", "rep", "n", "raw")
    right = dealt.where("block > 0").select("cell", F.explode(F.sequence(F.lit(0), F.least("block", "own") - 1)).alias("i"), F.col("block").alias("j"), F.lit(False).alias("left"), "home", "of", F.lit(None).cast("array<long>").alias("cells"), "rep", "n", "raw")

    def compare(pairs: pa.Table) -> pa.Table:
        mine = pairs.column("left").to_numpy()
        a, b = pairs.filter(pa.array(mine)), pairs.filter(pa.array(~mine))
        alone = pairs.column("i")[0].as_py() == pairs.column("j")[0].as_py()
        if alone:
            b = a
        node, links, peer = [], [], []
        if a.num_rows and b.num_rows:
            x = unit(matrix(a.column("raw")))
            y = x if alone else unit(matrix(b.column("raw")))
            (x_id, x_n), (y_id, y_n) = ((np.array(t.column("rep")), np.array(t.column("n"))) for t in (a, b))
            row, col = np.nonzero(x @ y.T >= least)
            row, col = row[other := x_id[row] != y_id[col]], col[other]
            node.append(x_id)
            links.append(np.bincount(row, y_n[col], len(x)).astype(np.int64))
            if not alone:
                counted = np.ones(len(row), bool)
                away = np.flatnonzero(~b.column("home").to_numpy())
                if len(away):
                    # A visitor counts its links in its home cell, so here those with rows that are not compared there.
                    lists = a.column("cells").combine_chunks()
                    owner, cells = np.repeat(np.arange(len(x)), np.diff(np.array(lists.offsets))), np.array(lists.flatten()).astype(np.int64)
                    span = 1 + int(max(cells.max(initial=0), np.array(b.column("of")).max()))
                    there = np.isin(row * span + np.array(b.column("of")).astype(np.int64)[col], owner * span + cells)
                    counted = ~(there & ~b.column("home").to_numpy()[col])
                node.append(y_id)
                links.append(np.bincount(col[counted], x_n[row[counted]], len(y)).astype(np.int64))
            # Nodes that hang together here, each joined to the least of them.
            ids, at = np.unique(np.concatenate([x_id[row], y_id[col]]), return_inverse=True)
            u, v, label = at[: len(row)], at[len(row) :], np.arange(len(ids))
            while (label[u] != label[v]).any():
                low = np.minimum(label[u], label[v])
                np.minimum.at(label, u, low)
                np.minimum.at(label, v, low)
                label = label[label]
            below = np.flatnonzero(label < np.arange(len(ids)))
            peer = [(ids[below], ids[label[below]])]
        counts, ends = (np.concatenate([*z, np.zeros(0, np.int64)]) for z in (node, links))
        some = ends > 0
        u, v = peer[0] if peer else (np.zeros(0, np.int64),) * 2
        none = pa.nulls
        return pa.table({"rep": np.concatenate([counts[some], u]), "links": pa.concat_arrays([pa.array(ends[some], pa.int64()), none(len(u), pa.int64())]), "peer": pa.concat_arrays([none(int(some.sum()), pa.int64()), pa.array(v, pa.int64())])})

    found = spool(left.unionByName(right).groupBy("cell", "i", "j").applyInArrow(compare, "rep long, links long, peer long"), "links")
    links = found.where("links is not null").groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.where("peer is not null").select(F.col("rep").alias("a"), F.col("peer").alias("b")))
    classes = same.join(links, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left").select("raw", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = spool(rows.join(classes, "raw").select("vec_id", "n_links", "component_id"), "linked")
    others = table.where(~(is_sound() & F.coalesce(F.size("embedding") == width, F.lit(False)))).select(F.col("vec_id").cast("long"), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    whole = known.unionByName(others)
    return whole.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
