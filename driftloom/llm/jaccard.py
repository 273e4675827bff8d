"""Operator 3, the exact join of documents whose 5-word shingle sets have a Jaccard similarity of 0.8 or more.

Equal sets fall together by their digest; what follows works on one node per set, named by its smallest doc_id.

1. Tokens (64-bit shingle hashes) have one order for all documents: a hash sample first, rarest first, then the others. Two
   sets that link share a token among their first floor(0.2 n) + 1. A task sends its sets' sampled tokens as sorted,
   packed runs per hash range; a range counts in how many sets a token occurs, and returns only tokens of two sets or
   more. A set whose unshared tokens fill its first places can link with nothing and is gone.
2. Similar sets are partitioned into groups: each set is compared with leaders that have the same least salted hash of
   shared tokens, in rounds of a few salts, and linked sets form a group (a connected component).
3. Sets that share a first token with a set of another group are ordered again, now by whole sets and by the number of
   groups that hold a token, so what only one group holds comes first and leads nowhere, however many copies hold it.
   Sets of n and m tokens link when they share 4 (n + m) / 9, so a token counts only where enough of both comes after it.
4. Token-group matrix: (token, group) says that some set of the group holds the token. The sets of the smaller of two
   groups ask the larger: as many of a set's tokens as a link with the group's smallest set asks for must be in that group's
   union, else no member can link. Only groups that qualify are opened, and their members compared with the askers in blocks.
5. Steps 2 to 4 find links enough to join the components. All links lie inside these, so they are counted there: a
   component's sets are dealt over blocks, and each pair of blocks is compared once, for both ends of a link.

Every comparison is exact, on whole sets. What a comparison needs is shipped to (leader, share of its sets), or (group, share
of those who ask, block of its members), so a leader of many sets or a large group is many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, columns, release, spool, text_slices, unspool, utf8_view
from .components import components
from .lexicon import words_of

WORDS, SAMPLED, RANGE_TOKENS, SHARE, BLOCK = 5, 0.5, 1 << 20, 64, 192
#: Tokens from which a range is not one group; hash ranges hold about RANGE_TOKENS, and more where very many sets hold one token.
HEAVY = 4 * RANGE_TOKENS
#: Rows of (node, key) up to which they are broadcast to the texts or sets.
BROADCAST_ROWS = 2_000_000
#: Salts of the rounds in which sets meet leaders; a round leaves out what the ones before have put into one group.
ROUNDS = (range(3), range(3, 7))
_rng = np.random.default_rng(20240611)
_LETTERS = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_LETTERS[65:91] = _LETTERS[97:123]  # A-Z count as a-z
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted: five words a shingle, or all words of a text with fewer."""
    ink, bounds, first = words_of(data, offsets)
    if not len(ink):
        return [np.zeros(0, np.uint64)] * (len(offsets) - 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(_LETTERS[ink] * _powers(_BASE, len(ink)), dtype=np.uint64)])
    word = _mix((total[bounds[1:]] - total[bounds[:-1]]) * _powers(_BACK, len(ink) + 1)[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    shingle = word.copy()
    for k in range(1, WORDS):
        shingle[: len(word) - k] = shingle[: len(word) - k] * np.uint64(_BASE) + word[k:] if len(word) > k else shingle[:0]
    shingle = _mix(shingle)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WORDS:
            found = np.sort(shingle[a : b - WORDS + 1])
            out.append(found[np.concatenate([[True], found[1:] != found[:-1]])])
        elif b > a:
            whole = np.full(1, b - a, np.uint64)
            for w in word[a:b]:
                whole = whole * np.uint64(_BASE) + w
            out.append(_mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def digest(found: np.ndarray) -> bytes:
    return hashlib.blake2b(found.tobytes(), digest_size=16).digest()


def prefix(n: int) -> int:
    return n // 5 + 1


_CUT = np.uint64(int(SAMPLED * 2**64))


def token_runs(docs: DataFrame, bits: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n, sig) per document, and (range, m, run) with the m packed sampled tokens of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in text_slices(batches, "text"):
            sets = shingle_sets(*utf8_view(batch.column("text")))
            sig = [digest(s) if len(s) else None for s in sets]
            once = {g: i for i, g in enumerate(sig) if g}
            at = list(once.values())
            size = np.array([len(sets[i]) for i in at], np.int64)
            sampled = np.array([np.searchsorted(sets[i], _CUT) for i in at], np.int64)
            sent = np.maximum(sampled, size // 5 + 1)
            tokens = np.concatenate([sets[i][:k] for i, k in zip(at, sent.tolist(), strict=True)]) if at else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(at)), sent)
            # What follows sees the first bits + 32 bits of a token. Tokens of one set that fall together there are one, and
            # so they are counted: a set and another share as many fewer at most as either has fewer, so prefixes stay as long.
            short = tokens >> np.uint64(32 - bits)
            again = np.flatnonzero((short[1:] == short[:-1]) & (owner[1:] == owner[:-1])) + 1
            sampled -= np.bincount(owner[again[tokens[again] < _CUT]], minlength=len(at))
            order = np.argsort(tokens)
            tokens, owner = tokens[order], owner[order].astype(np.uint32)
            of_range = (tokens >> np.uint64(64 - bits)).astype(np.int64)
            cuts = [*np.flatnonzero(np.diff(of_range, prepend=-1)).tolist(), len(tokens)]
            low = ((tokens << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            runs, ranges, amounts = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = int(of_range[a])
                held, local = np.unique(owner[a:b], return_inverse=True)
                wide = np.uint16 if len(held) < 1 << 16 else np.uint32
                keys = b"".join(sig[at[i]][:8] for i in held)
                head = np.array([b - a, len(held), np.dtype(wide).itemsize], np.uint32).tobytes()
                runs.append(pack(head + keys + size[held].astype(np.uint32).tobytes() + sampled[held].astype(np.uint32).tobytes() + np.diff(low[a:b], prepend=np.uint32(0)).tobytes() + local.astype(wide).tobytes()))
                ranges.append(r)
                amounts.append(b - a)
            m = len(runs)
            yield columns(doc_id=pa.concat_arrays([batch.column("doc_id"), pa.nulls(m, pa.int64())]), n=pa.array([len(s) for s in sets] + [None] * m, pa.int64()), sig=pa.array(sig + [None] * m, pa.binary()), range=pa.array([None] * len(sets) + ranges, pa.int32()), m=pa.array([None] * len(sets) + amounts, pa.int64()), run=pa.array([None] * len(sets) + runs, pa.binary()))

    return arrow_map(docs, run, "doc_id long, n long, sig binary, range int, m long, run binary")


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys, sizes and numbers of sampled tokens of a run's sets; its tokens within their range, and whose they are."""
    raw = zstandard.ZstdDecompressor().decompress(run)
    m, k, w = np.frombuffer(raw, np.uint32, 3).tolist()
    at = 12
    low = np.cumsum(np.frombuffer(raw, np.uint32, m, at + 16 * k), dtype=np.uint32)
    who = np.frombuffer(raw, np.uint16 if w == 2 else np.uint32, m, at + 16 * k + 4 * m).astype(np.int64)
    return np.frombuffer(raw, np.uint64, k, at), np.frombuffer(raw, np.uint32, k, at + 8 * k), np.frombuffer(raw, np.uint32, k, at + 12 * k), low, who


SHARED = "key long, n long, sampled long, tokens array<long>, sets array<long>"


def shared_tokens(runs: DataFrame) -> DataFrame:
    """(key, n, sampled, tokens, sets): per set and range its tokens that two sets or more hold, with how many hold each. ``runs``: (range, m, run)."""

    def count(rows: pa.Table) -> pa.Table:
        r = rows.column("range")[0].as_py()
        parts, base = [], 0
        for raw in rows.column("run").to_pylist():
            key, size, sample, low, who = unpacked(raw)
            parts.append((key, size, sample, low, who + base))
            base += len(key)
        key, size, sample, low, who = (np.concatenate(x) for x in zip(*parts, strict=True))
        # One number per distinct set: copies from different slices are one.
        key, first, number = np.unique(key, return_index=True, return_inverse=True)
        size, sample = size[first], sample[first]
        code = np.unique((low.astype(np.uint64) << np.uint64(32)) | number[who].astype(np.uint64))
        token, owner = (code >> np.uint64(32)).astype(np.int64), (code & np.uint64(0xFFFFFFFF)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        held = np.diff(np.append(starts, len(token)))
        sets = np.repeat(held, held)
        keep = sets > 1
        order = np.argsort(owner[keep], kind="stable")
        owner, token, sets = owner[keep][order], token[keep][order], sets[keep][order]
        cuts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(cuts, len(owner))
        mine = owner[cuts]
        whole = (np.int64(r) << np.int64(32)) | token  # the token's first bits + 32 bits
        release()
        return pa.table({"key": key[mine].view(np.int64), "n": size[mine].astype(np.int64), "sampled": sample[mine].astype(np.int64), "tokens": pa.ListArray.from_arrays(ends.astype(np.int32), whole), "sets": pa.ListArray.from_arrays(ends.astype(np.int32), sets.astype(np.int64))})

    heavy = spool(runs.groupBy("range").agg(F.sum("m").alias("m")).where(F.col("m") > HEAVY).select("range"), "heavy")
    if heavy.isEmpty():
        return runs.groupBy("range").applyInArrow(count, SHARED)
    # At most as many rows as ranges, 2 ** 30 in all and few that are heavy.
    light = runs.join(F.broadcast(heavy), "range", "left_anti").select("range", "m", "run")
    return light.groupBy("range").applyInArrow(count, SHARED).unionByName(heavy_tokens(runs.join(F.broadcast(heavy), "range").select("range", "run")))


def heavy_tokens(runs: DataFrame) -> DataFrame:
    """The same for ranges that are too large for a group: a row per token and set, counted and joined in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, raw in zip(batch.column("range").to_pylist(), batch.column("run").to_pylist(), strict=True):
                key, size, sample, low, who = unpacked(raw)
                for at in range(0, len(low), 1 << 18):
                    of = who[at : at + (1 << 18)]
                    yield columns(token=(np.int64(r) << np.int64(32)) | low[at : at + (1 << 18)].astype(np.int64), key=key[of].view(np.int64), range=np.full(len(of), r, np.int32), n=size[of].astype(np.int64), sampled=sample[of].astype(np.int64))

    each = spool(arrow_map(runs, run, "token long, key long, range int, n long, sampled long").distinct(), "each")
    held = spool(each.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1"), "held")
    lists = each.join(held, "token").groupBy("key", "range").agg(F.max("n").alias("n"), F.max("sampled").alias("sampled"), F.collect_list(F.struct("token", "sets")).alias("x"))
    return lists.select("key", "n", "sampled", F.col("x.token").alias("tokens"), F.col("x.sets").alias("sets"))


def survivors(shared: DataFrame, bits: int) -> DataFrame:
    """(key, n, need, sample, first): sets that may link; ``sample``: their shared sampled tokens; ``need`` of these must be in a group's union; ``first``: the shared among their first tokens."""
    cut = int(_CUT) >> (32 - bits) if bits < 32 else int(_CUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                token, sets = (np.array([x for part in r[c] for x in part], np.int64) for c in ("tokens", "sets"))
                tier = token < cut
                alone = r["sampled"] - int(tier.sum())
                room = prefix(r["n"]) - alone
                if room <= 0:
                    continue
                order = np.lexsort((token[tier], sets[tier]))[:room]
                first = np.concatenate([token[tier][order], token[~tier]])
                if len(first):
                    out.append({"key": r["key"], "n": r["n"], "need": r["sampled"] - r["n"] // 5, "sample": token[tier].tolist(), "first": first.tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, SURVIVOR)

    gathered = shared.groupBy("key").agg(F.max("n").alias("n"), F.max("sampled").alias("sampled"), F.collect_list("tokens").alias("tokens"), F.collect_list("sets").alias("sets"))
    return arrow_map(gathered, run, "key long, n long, need long, sample array<long>, first array<long>")


SURVIVOR = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("need", pa.int64()), ("sample", pa.list_(pa.int64())), ("first", pa.list_(pa.int64()))])


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of the pairs (a, b) that link; ``sets``: (node, set) with sorted hashes. Each b meets SHARE of its a's at a time."""
    many = pairs.groupBy("b").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    asked = pairs.join(many, "b").select(F.col("a").alias("node"), F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("place"))
    leads = many.select(F.col("b").alias("node"), F.col("b").alias("lead"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("place"))
    roles = spool(asked.unionByName(leads), "roles")
    shipped = sets.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles, "node").repartition("lead", "share").sortWithinPartitions("lead", "share", "place").select("node", "lead", "place", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, against = None, None
        for batch in batches:
            hits = []
            for node, to, place, raw in zip(*(batch.column(c).to_pylist() for c in ("node", "lead", "place", "set")), strict=True):
                if place == 0:
                    lead, against = to, np.frombuffer(raw, np.uint64)
                    continue
                if to != lead:
                    raise ValueError("a set came before its leader")
                mine = np.frombuffer(raw, np.uint64)
                at = np.searchsorted(against, mine)
                both = int((against[np.minimum(at, len(against) - 1)] == mine).sum())
                if 100 * both >= 80 * (len(mine) + len(against) - both):
                    hits.append((node, to))
            yield columns(a=pa.array([h[0] for h in hits], pa.int64()), b=pa.array([h[1] for h in hits], pa.int64()))

    return arrow_map(shipped, run, "a long, b long")


def _short(column: str) -> Column:
    """Tokens in 31 bits. Tokens that fall together only raise a bound, so no group is missed."""
    return F.transform(column, lambda t: F.pmod(t, F.lit((1 << 31) - 1)).cast("int"))


def qualifying(asks: DataFrame, nodes: DataFrame, matrix: DataFrame) -> DataFrame:
    """(node, other) of ``asks`` where so many of the node's tokens are in the other group's union as a member of ``least`` tokens asks for; SHARE nodes meet a union at a time."""
    many = spool(asks.groupBy("other").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares")), "many")
    asked = asks.join(many, "other").join(nodes, "node").select("other", F.pmod(F.xxhash64("node"), F.col("shares")).cast("int").alias("share"), F.lit(1).alias("place"), "node", F.ceil(4 * (F.col("n") + F.col("least")) / 9).cast("long").alias("need"), "tokens")
    unions = many.join(matrix, "other").select("other", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("place"), F.lit(None).cast("long").alias("node"), F.lit(0).cast("long").alias("need"), "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int32)
        for batch in batches:
            tokens = batch.column("tokens")
            flat, at = tokens.flatten().to_numpy(), tokens.offsets.to_numpy() - tokens.offsets[0].as_py()
            place, need = batch.column("place").to_numpy(), batch.column("need").to_numpy()
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                mine = flat[at[i] : at[i + 1]]
                if place[i] == 0:
                    held = mine
                else:
                    found = np.searchsorted(held, mine)
                    keep[i] = need[i] <= 0 or len(held) and (held[np.minimum(found, len(held) - 1)] == mine).sum() >= need[i]
            yield columns(node=batch.column("node").filter(pa.array(keep)), other=batch.column("other").filter(pa.array(keep)))

    dealt = asked.unionByName(unions).repartition("other", "share").sortWithinPartitions("other", "share", "place")
    return arrow_map(dealt, run, "node long, other long")


def foreign_tokens(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, n, grp, need, tokens, room) for the sets ``nodes`` (node, n, grp) that may link with a set of another group.

    ``tokens`` are those of the whole set that another group holds too, those of the fewest groups first. A set that links
    with a set of another group shares ``need`` of its tokens with it, so a set with fewer is gone, and two such sets
    share one among the first ``room`` of each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(raw, np.int64) for raw in batch.column("set").to_pylist()]
            at = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield columns(node=batch.column("node"), n=batch.column("n"), grp=batch.column("grp"), tokens=pa.ListArray.from_arrays(at, np.concatenate([*found, np.zeros(0, np.int64)])))

    whole = spool(arrow_map(sets.join(nodes, "node").select("node", "n", "grp", "set"), run, "node long, n long, grp long, tokens array<long>"), "whole")
    each = whole.select("node", "grp", F.explode("tokens").alias("token"))
    shared = spool(each.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token"), "shared")
    each = spool(each.join(shared, "token"), "each")
    groups = spool(each.select("token", "grp").distinct().groupBy("token").agg(F.count("*").alias("groups")), "groups")
    held = each.join(groups, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("groups", "token"))).getField("token").alias("tokens"))
    out = nodes.withColumn("need", F.col("n") - F.floor(F.col("n") / 5)).join(held, "node").withColumn("room", (F.size("tokens") + 1 - F.col("need")).cast("int")).where("room > 0")
    return out.select("node", "n", "grp", "need", "tokens", "room")


def leaders(alive: DataFrame, salts: range) -> DataFrame:
    """(a, b): each node with a leader per salt, one with the same least hash of its shared tokens; sets agree in it as often as they are similar."""
    held = F.concat("sample", "first")
    salted = lambda k: F.transform(held, lambda t: F.xxhash64(F.lit(k), t))
    least = F.array(*(F.struct(F.lit(k).alias("salt"), F.array_min(salted(k)).alias("key")) for k in salts))
    # A set with few tokens of its own is near the middle of its copies, so it is the first to lead.
    own = (F.col("need") + F.floor(F.col("n") / 5) - F.size("sample")).alias("own")
    near = spool(alive.select("node", "n", own, F.explode(least).alias("x")).select("node", "n", "own", "x.salt", "x.key"), "near")
    rank = [F.xxhash64("salt", "node").alias("h"), "node", "n"]
    heads = spool(near.groupBy("salt", "key").agg(F.min(F.struct(*(["own"] if 0 in salts else []), *rank)).alias("head")), "heads")
    return near.join(heads, ["salt", "key"]).where("node <> head.node and 5 * n >= 4 * head.n and 5 * head.n >= 4 * n").select(F.col("node").alias("a"), F.col("head.node").alias("b")).distinct()


def alike(x: list[np.ndarray], y: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Which sets of ``x`` (rows) link with which of ``y``; tokens are taken ``width`` at a time."""
    sizes = np.array([len(s) for s in (*x, *y)], np.int64)
    _, token = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    several = np.bincount(token) > 1
    keep = several[token]
    token, owner = (np.cumsum(several) - 1)[token[keep]], owner[keep]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    both = np.zeros((len(x), len(y)), np.int64)
    for lo in range(0, int(several.sum()), width):
        a, b = np.searchsorted(token, (lo, lo + width))
        held = np.zeros((len(sizes), width), np.float32)
        held[owner[a:b], token[a:b] - lo] = 1
        both += (held[: len(x)] @ held[len(x) :].T).astype(np.int64)
    return 100 * both >= 80 * (sizes[: len(x), None] + sizes[len(x) :] - both)


def _side(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Nodes, documents and sets of rows (side, node, documents, set) by node; equal rows count once."""
    rows = sorted({(r[1], r[2], r[3]) for r in rows})
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64), [np.frombuffer(r[2], np.uint64) for r in rows]


def _by_block(batches: Iterator[pa.RecordBatch], make, names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    """``make`` (key, rows) of the rows with equal first three columns, which follow each other; two columns of longs."""
    key, rows = None, []
    for batch in batches:
        done = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:3] != key:
                if rows:
                    done.append(make(key, rows))
                key, rows = row[:3], []
            rows.append(row[3:])
        if done:
            yield columns(**{n: np.concatenate([d[i] for d in done]) for i, n in enumerate(names)})
    if rows:
        yield columns(**dict(zip(names, make(key, rows), strict=True)))


def group_links(opened: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): a link of each ``opened`` (node, other) with a member of the other group, if there is any, per block of ``members`` (node, grp).

    A group hangs together already, so one link is enough. SHARE askers meet a block of members at a time.
    """
    asked = opened.groupBy("other").agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    sizes = members.groupBy(F.col("grp").alias("other")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    both = spool(asked.join(sizes, "other"), "sizes")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    asks = opened.join(both, "other").select("node", "other", deal("shares").alias("share"), every("blocks").alias("block"), F.lit(True).alias("asks"))
    has = members.withColumnRenamed("grp", "other").join(both, "other").select("node", "other", every("shares").alias("share"), deal("blocks").alias("block"), F.lit(False).alias("asks"))
    roles = spool(asks.unionByName(has), "roles")
    shipped = sets.join(F.broadcast(roles) if roles.count() <= BROADCAST_ROWS else roles, "node").repartition("other", "share", "block").sortWithinPartitions("other", "share", "block").select("other", "share", "block", "asks", "node", F.lit(1).alias("docs"), "set")

    def find(_: tuple, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        a_id, _, a = _side([r for r in rows if r[0]])
        b_id, _, b = _side([r for r in rows if not r[0]])
        if not len(a) or not len(b):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hit = alike(a, b)
        found = hit.any(axis=1)
        return a_id[found], b_id[hit.argmax(axis=1)[found]]

    return arrow_map(shipped, lambda batches: _by_block(batches, find, ("a", "b")), "a long, b long")


def link_counts(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, links) for ``members`` (node, grp, docs): the documents of the other sets of the group that link with the node's."""
    sizes = spool(members.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "sizes")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(sizes, "grp").select("node", "grp", "docs", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = spool(dealt.select("node", "docs", "grp", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("right")), "dealt")
    shipped = sets.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_ROWS else dealt, "node").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j").select("grp", "i", "j", "right", "node", "docs", "set")

    def count(key: tuple, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        same = key[1] == key[2]
        x_id, x_docs, x = _side([r for r in rows if not r[0]])
        y_id, y_docs, y = (x_id, x_docs, x) if same else _side([r for r in rows if r[0]])
        if not len(x) or not len(y):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # Rows of one node are one, so a link of any of them is the node's.
        (x_id, x_at), (y_id, y_at) = np.unique(x_id, return_index=True), np.unique(y_id, return_index=True)
        hit = np.maximum.reduceat(np.maximum.reduceat(alike(x, y), x_at, axis=0), y_at, axis=1) & (x_id[:, None] != y_id)
        links = hit @ y_docs[y_at]
        return (x_id, links) if same else (np.concatenate([x_id, y_id]), np.concatenate([links, x_docs[x_at] @ hit]))

    return arrow_map(shipped, lambda batches: _by_block(batches, count, ("node", "links")), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def ngram_jaccard_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for every row of ``docs`` (doc_id, text); without n_links if not ``count_links``.

    component_id is the smallest doc_id reachable by links; ``n_links`` counts the other doc_ids whose sets have the
    similarity, equal sets among them. A null or empty text has no shingles and links with nothing; rows with one doc_id are one
    node in links, each with its own n_shingles; a row without doc_id has no component; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    weight = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, weight / 6 * SAMPLED / RANGE_TOKENS))), 6, 30))
    staged = spool(token_runs(docs, bits), "tokens")
    sets = spool(staged.where("range is null").select("doc_id", "n", "sig"), "sigs")
    classes = spool(sets.where("n > 0 and doc_id is not null").groupBy("sig").agg(F.min("doc_id").alias("node"), F.count_distinct("doc_id").alias("docs")), "classes")
    shared = spool(shared_tokens(staged.where("range is not null").select("range", "m", "run")), "shared")
    unspool(staged)
    named = classes.select("node", F.col("sig").substr(1, 8).alias("half"))
    alive = spool(survivors(shared, bits).withColumn("half", _le_bytes(F.col("key"))).join(named, "half").select("node", "n", "need", "sample", "first"), "alive")
    unspool(shared)
    links, whole = _links(docs, alive)
    copies = F.col("docs") - 1
    if links is None:
        joined = classes.select("sig", F.col("node").alias("component"), copies.alias("n_links"))
    else:
        found = spool(components(links), "components").withColumnRenamed("node", "x")
        joined = classes.join(found, F.col("node") == F.col("x"), "left").select("sig", "node", F.coalesce("component", "node").alias("component"), copies.alias("n_links"))
        if count_links:
            # A node of several sets is in each of its classes.
            members = found.join(classes.groupBy("node").agg((F.sum("docs") - F.count("*") + 1).alias("docs")), F.col("x") == F.col("node")).select("node", F.col("component").alias("grp"), "docs")
            joined = joined.join(spool(link_counts(members, whole), "counts"), "node", "left").withColumn("n_links", F.col("n_links") + F.coalesce("links", F.lit(0)))
    joined = spool(joined.select("sig", "component", F.col("n_links").cast("long").alias("n_links")), "joined")
    out = sets.join(joined, "sig", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"), F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"))
    return out if count_links else out.drop("n_links")


def _le_bytes(key: Column) -> Column:
    """The eight bytes of a little-endian long."""
    big = F.lpad(F.hex(key), 16, "0")
    return F.unhex(F.concat(*(F.substring(big, 15 - 2 * i, 2) for i in range(8))))


def _links(docs: DataFrame, alive: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """Links between nodes that leave their connected components whole, and the nodes' sets; None if there are none to look for."""
    n = alive.count()
    if not n:
        return None, None

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            found = shingle_sets(*utf8_view(batch.column("text")))
            yield columns(node=batch.column("doc_id"), set=pa.array([s.tobytes() for s in found], pa.binary()), n=pa.array([len(s) for s in found], pa.int64()))

    wanted = alive.select(F.col("node").alias("doc_id"), F.col("n").alias("_n"))
    texts = docs.join(F.broadcast(wanted) if n <= BROADCAST_ROWS else wanted, "doc_id").select("doc_id", "text")
    sets = spool(arrow_map(texts, shingles, "node long, set binary, n long").select("node", "set"), "sets")
    found = None
    of = None
    for salts in ROUNDS:
        pairs = leaders(alive, salts)
        if of is not None:  # only nodes that are not yet in their leader's group
            mine, theirs = of.select(F.col("node").alias("a"), F.col("component").alias("ca")), of.select(F.col("node").alias("b"), F.col("component").alias("cb"))
            pairs = pairs.join(mine, "a", "left").join(theirs, "b", "left").where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        hits = spool(compare(spool(pairs, "pairs"), sets), "hits")
        found = hits if found is None else found.unionByName(hits)
        of = spool(components(found), "groups")
    grouped = spool(alive.join(of, "node", "left").select("node", "n", "first", F.coalesce("component", "node").alias("grp")), "grouped")
    # Only sets that share a first token with a set of another group can link with one; tokens within one group lead nowhere.
    entry = grouped.select("node", "grp", F.explode("first").alias("token"))
    crossing = spool(entry.groupBy("token").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("token"), "crossing")
    open_sets = spool(entry.join(crossing, "token", "left_semi").select("node").distinct(), "open")
    held = spool(foreign_tokens(grouped.join(open_sets, "node", "left_semi").select("node", "n", "grp"), sets), "held")
    # Sets of n and m tokens link when they share 4 (n + m) / 9; a shared token with ``left`` of n from it on allows m <= slack / 4.
    # Of two groups the smaller asks: a link is found from either end, and a large group's sets need not ask for each small one.
    weights = spool(held.groupBy("grp").agg(F.count("*").alias("members")), "weights")
    held = spool(held.join(weights, "grp"), "weighed")
    entry = held.select("node", "n", "grp", "members", F.size("tokens").alias("f"), F.posexplode(F.slice("tokens", 1, F.col("room"))).alias("at", "token"))
    entry = entry.select("node", "n", "grp", "members", "token", (9 * (F.col("f") - F.col("at")) - 4 * F.col("n")).alias("slack"))
    sides = spool(entry.groupBy("token", F.col("grp").alias("other")).agg(F.first("members").alias("others"), F.min("n").alias("least"), F.max("slack").alias("widest")), "sides")
    several = spool(sides.groupBy("token").count().where("count > 1").select("token"), "several")
    entry = spool(entry.join(several, "token"), "entry")
    asks = entry.join(sides, "token").where("(members < others or members = others and grp < other) and 4 * least <= slack and 4 * n <= widest").groupBy("node", "other").agg(F.min("least").alias("least"))
    asks = spool(asks, "asks")
    if not asks.count():
        return found, sets
    # The token-group matrix, for the groups that are asked: the foreign tokens of each group's union.
    matrix = held.join(asks.select(F.col("other").alias("grp")).distinct(), "grp", "left_semi").select(F.col("grp").alias("other"), F.explode(_short("tokens")).alias("token")).distinct().groupBy("other").agg(F.sort_array(F.collect_list("token")).alias("tokens"))
    opened = spool(qualifying(asks, held.select("node", "n", _short("tokens").alias("tokens")), spool(matrix, "matrix")), "opened")
    return found.unionByName(spool(group_links(opened, held.select("node", "grp"), sets), "hits")), sets
