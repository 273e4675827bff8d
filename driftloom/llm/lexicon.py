"""Operator 9, BPE by a minimal acyclic transducer of frequent words, with exact merging of all other words.

Words are the runs between ASCII white space, which the tokenizer drops and never merges across. Frequencies come from
all documents; the most frequent words go, with their ids, into an automaton whose equal suffixes are shared. Each
transition carries how many words come before it, so the sum along a word is its number and finds its ids. The automaton
is one file of three int32 arrays that every worker memory-maps and steps through for all words of a slice at once.
Words outside it are normalised and split by the tokenizer's own components and merged here, lowest rank first.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, binary_array, columns, ragged, spool, text_slices, unspool, utf8_view
from .tokenizing import WHITE, IdStore

#: Words in the automaton, and the longest of them in bytes: this bounds what is gathered on the driver and broadcast.
LEXICON_WORDS, WORD_BYTES = 32_768, 64
#: Symbols of a word up to which words are merged side by side in one matrix.
MATRIX_SYMBOLS = 96
#: Merged words that a worker remembers; beyond that it starts over.
CACHE_WORDS = 120_000


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes without white space, where each word starts in them (and the end), and each text's first word (and the end)."""
    if not len(data):
        return data, np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~WHITE[data]
    starts = ink.copy()
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    starts[1:] &= ~ink[:-1]
    starts[inner] = ink[inner]
    place = np.concatenate([[0], np.cumsum(ink)])
    at = np.flatnonzero(starts)
    bounds = np.append(place[at], place[-1])
    return data[ink], bounds, np.searchsorted(at, offsets)


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) over all texts, summed inside each slice before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text"):
            data, bounds, _ = words_of(*utf8_view(batch.column("text")))
            short = np.flatnonzero(np.diff(bounds) <= WORD_BYTES)
            words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            coded = words.take(pa.array(short)).dictionary_encode()
            yield columns(word=coded.dictionary.cast(pa.binary()), n=np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)).astype(np.int64))

    return arrow_map(docs.select(F.col("text").cast("string")), run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, most: int = LEXICON_WORDS) -> list[bytes]:
    """At most ``most`` words: all whose count reaches the least threshold that keeps them so few."""
    counted = spool(count_words(docs).where("n >= 4"), "words")
    level = F.floor(F.log2("n") * 32)  # a few thousand levels however large the counts
    levels = sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True)
    total, least = 0, None
    for at, n in levels:
        if total + n > most:
            break
        total, least = total + n, at
    found = [] if least is None else [bytes(r[0]) for r in counted.where(level >= least).select("word").collect()]
    unspool(counted)
    return sorted(found)


@dataclass
class Automaton:
    """Double array: from state s by byte b to slot base[s] + b, if owner[slot] is s; target[slot] is the next state."""

    base: np.ndarray
    slots: np.ndarray  # rows: owner, target, words before
    final: np.ndarray

    @classmethod
    def build(cls, words: list[bytes]) -> Automaton:
        """From distinct sorted words, one after the other; finished suffixes are looked up in a register."""
        edges: list[dict[int, int]] = [{}]
        final, register, path, before = [False], {}, [0], b""

        def settle(upto: int) -> None:
            for k in range(len(path) - 1, upto, -1):
                node, parent = path[k], path[k - 1]
                key = (final[node], tuple(edges[node].items()))
                same = register.setdefault(key, node)
                if same != node:
                    edges[parent][before[k - 1]] = same
                path.pop()

        for word in words:
            common = len(os.path.commonprefix([word, before]))
            settle(common)
            for b in word[common:]:
                edges.append({})
                final.append(False)
                edges[path[-1]][b] = len(edges) - 1
                path.append(len(edges) - 1)
            final[path[-1]] = True
            before = word
        settle(0)
        states, at = [], {}
        todo = [0]
        while todo:
            s = todo.pop()
            if s not in at:
                at[s] = len(states)
                states.append(s)
                todo += edges[s].values()
        below: dict[int, int] = {}

        def count(s: int) -> int:
            stack = [s]
            while stack:
                x = stack[-1]
                open_ = [y for y in edges[x].values() if y not in below]
                if open_:
                    stack += open_
                else:
                    below[x] = final[x] + sum(below[y] for y in edges[x].values())
                    stack.pop()
            return below[s]

        count(0)
        base = np.zeros(len(states), np.int32)
        taken, free, size = bytearray(256 * 4), 256, 256 * 4  # slots below 256 stay empty, so that no base is negative
        owner, target, skip, hint = {}, {}, {}, {}
        for s in sorted(states, key=lambda x: -len(edges[x])):
            bs = list(edges[s])
            if not bs:
                continue
            while taken[free]:
                free += 1
                if free + 512 >= size:
                    taken += bytearray(size)
                    size *= 2
            b0 = max(free - bs[0], hint.get(len(bs), 0) if len(bs) > 1 else 0)
            while any(taken[b0 + b] for b in bs) or b0 + bs[0] < 256:
                b0 += 1
                if b0 + 512 >= size:
                    taken += bytearray(size)
                    size *= 2
            base[at[s]] = hint[len(bs)] = b0
            passed = int(final[s])
            for b in sorted(bs):
                taken[b0 + b], owner[b0 + b], target[b0 + b], skip[b0 + b] = 1, at[s], at[edges[s][b]], passed
                passed += below[edges[s][b]]
        slots = np.full((3, max(owner, default=0) + 257), -1, np.int32)
        for row, made in enumerate((owner, target, skip)):
            slots[row, list(made)] = list(made.values())
        return cls(base, slots, np.array([final[s] for s in states], np.int32))

    def dump(self) -> bytes:
        head = np.array([len(self.base), self.slots.shape[1]], np.int32)
        return b"".join(x.tobytes() for x in (head, self.base, self.final, self.slots))

    @classmethod
    def mapped(cls, raw: bytes) -> Automaton:
        """The automaton in a memory-mapped file of this machine, named by its content and written again wherever it is missing."""
        path = os.path.join(tempfile.gettempdir(), f"lexicon-{hashlib.sha256(raw).hexdigest()[:24]}.bin")
        if not os.path.exists(path) or os.path.getsize(path) != len(raw):
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(raw)
            os.replace(f.name, path)
        whole = np.memmap(path, np.int32, "r")
        n, m = int(whole[0]), int(whole[1])
        return cls(whole[2 : 2 + n], whole[2 + 2 * n :].reshape(3, m), whole[2 + n : 2 + 2 * n])

    def numbers(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Each word's number in the sorted lexicon, or -1."""
        lengths = np.diff(bounds)
        out = np.full(len(lengths), -1, np.int64)
        live = np.flatnonzero((lengths > 0) & (lengths <= WORD_BYTES))
        at, left = bounds[:-1][live], lengths[live]
        state, number = np.zeros(len(live), np.int32), np.zeros(len(live), np.int64)
        owner, target, skip = self.slots
        while len(live):
            slot = self.base[state] + data[at]
            ok = owner[slot] == state
            live, at, left, number, slot = live[ok], at[ok] + 1, left[ok] - 1, number[ok], slot[ok]
            state = target[slot]
            number = number + skip[slot]
            over = left == 0
            hit = over & (self.final[state] > 0)
            out[live[hit]] = number[hit]
            on = ~over
            live, at, left, number, state = live[on], at[on], left[on], number[on], state[on]
        return out


#: What a word may hold to be split here: Latin characters whose normal form and lower case are single Latin characters.
PLAIN = re.compile(r"[\x21-\x7e\xa1-\u012f\u0131-\u0233]+").fullmatch
_OF = {k: "".join(map(re.escape, (c for c in map(chr, range(0x21, 0x234)) if unicodedata.category(c)[0] == k))) for k in "LN"}
#: The tokenizer's pattern over these characters, and the space between words.
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_OF['L']}]+|[{_OF['N']}]| |[^ {_OF['L']}{_OF['N']}]+").findall


class Merger:
    """The BPE of a tokenizer file, run over many words at once."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, self.vocabulary = whole["model"], whole["model"]["vocab"]
        self.special = [t["content"] for t in whole["added_tokens"]]
        # The byte alphabet: printable Latin-1 stands for itself, the other bytes for characters from U+0100 on.
        shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
        hidden = [b for b in range(256) if b not in shown]
        letter = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
        self.inner = np.array([self.vocabulary[letter[b]] for b in range(256)], np.int64)
        self.closing = np.array([self.vocabulary[letter[b] + (model["end_of_word_suffix"] or "")] for b in range(256)], np.int64)
        ranks = {}
        for rank, (a, b) in enumerate(model["merges"]):
            ranks[self.vocabulary[a] << 32 | self.vocabulary[b]] = (rank, self.vocabulary[a + b])
        self.pairs = np.array(sorted(ranks), np.int64)
        self.rank, self.into = np.array([ranks[k] for k in self.pairs.tolist()], np.int64).T.copy()
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.pieces: dict[str, int] = {}
        self.merged, self.words = IdStore(), IdStore()

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair (very large if none) and its place."""
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, keys), len(self.pairs) - 1)
        return np.where((self.pairs[at] == keys) & (left >= 0) & (right >= 0), self.rank[at], 1 << 40), at

    def merge(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of equally many symbols; merged rows are filled up with -1. One merge a row and round: least rank, then leftmost."""
        symbols = symbols.copy()
        width = symbols.shape[1]
        if width < 2:
            return symbols
        rank, place = self.ranks_of(symbols[:, :-1], symbols[:, 1:])
        live = np.arange(len(symbols))
        steps = np.arange(width)
        while True:
            best = rank[live].argmin(axis=1)
            on = rank[live, best] < 1 << 40
            live, best = live[on], best[on]
            if not len(live):
                return symbols
            symbols[live, best] = self.into[place[live, best]]
            source = np.minimum(steps + (steps > best[:, None]), width - 1)
            moved = np.take_along_axis(symbols[live], source, axis=1)
            moved[:, -1] = -1
            symbols[live] = moved
            source = np.minimum(steps[:-1] + (steps[:-1] > best[:, None] - 0), width - 2)
            for array, fill in ((rank, 1 << 40), (place, 0)):
                shifted = np.take_along_axis(array[live], source, axis=1)
                shifted[:, -1] = fill
                array[live] = shifted
            for j, ok in ((best - 1, best > 0), (best, best < width - 1)):
                rows, cols = live[ok], j[ok]
                rank[rows, cols], place[rows, cols] = self.ranks_of(symbols[rows, cols], symbols[rows, cols + 1])

    def piece_ids(self, pieces: list[str]) -> np.ndarray:
        """Places in ``merged`` of the ids of pre-tokenized pieces."""
        get = self.pieces.get
        at = np.fromiter((get(p, -1) for p in pieces), np.int64, len(pieces))
        missing = np.flatnonzero(at < 0)
        if not len(missing):
            return at
        raw = {p: p.encode() for p in dict.fromkeys([pieces[i] for i in missing])}
        fresh = sorted(raw, key=lambda p: len(raw[p]))
        first = self.merged.n
        size = np.fromiter((len(raw[p]) for p in fresh), np.int64, len(fresh))
        data = np.frombuffer(b"".join(raw[p] for p in fresh), np.uint8)
        ends = np.cumsum(size)
        for n in np.unique(size):
            lo, hi = np.searchsorted(size, [n, n + 1])
            if n > MATRIX_SYMBOLS:
                runs = [self.tokenizer.encode(p, add_special_tokens=False).ids for p in fresh[lo:hi]]
                self.merged.add(np.array([x for r in runs for x in r], np.uint32), np.array([len(r) for r in runs], np.int64))
            else:
                rows = data[ends[lo] - n : ends[hi - 1]].reshape(-1, n)
                done = self.merge(np.hstack([self.inner[rows[:, :-1]], self.closing[rows[:, -1:]]]))
                kept = done >= 0
                self.merged.add(done[kept].astype(np.uint32), kept.sum(axis=1))
        self.pieces.update(zip(fresh, range(first, self.merged.n), strict=True))
        at[missing] = [get(pieces[i]) for i in missing]
        return at

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        """Places in ``words`` of the ids of distinct words."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        get = self.known.get
        at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        for lo in range(0, len(new), 20_000):
            part = new[lo : lo + 20_000]
            self.add_words([words[i] for i in part])
            at[part] = np.arange(self.words.n - len(part), self.words.n)
        return at

    def add_words(self, words: list[bytes]) -> None:
        texts = [w.decode() for w in words]
        # The library encodes words with a special token's mark or a character beyond Latin as a whole.
        whole = {i: self.tokenizer.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts) if not PLAIN(t) or any(s in t for s in self.special)}
        for i in whole:
            texts[i] = "x"
        cut = SPLIT(" ".join(texts).lower())
        space = np.fromiter((p == " " for p in cut), bool, len(cut))
        place = self.piece_ids([p for p in cut if p != " "])
        lengths = self.merged.lengths[place]
        flat = self.merged.flat[ragged(self.merged.starts[place], lengths)]
        per = np.bincount(np.cumsum(space)[~space], lengths, len(texts)).astype(np.int64)
        if whole:
            runs = np.split(flat, np.cumsum(per)[:-1])
            for i, ids in whole.items():
                runs[i] = np.array(ids, np.uint32)
            flat, per = np.concatenate(runs), np.array([len(r) for r in runs], np.int64)
        first = self.words.n
        self.words.add(flat, per)
        self.known.update(zip(words, range(first, self.words.n), strict=True))


_MERGERS: dict[str, Merger] = {}
_MAPPED: dict[bytes, Automaton] = {}


def merger(path: str) -> Merger:
    if path not in _MERGERS:
        _MERGERS[path] = Merger(path)
    return _MERGERS[path]


def mapped(raw: bytes) -> Automaton:
    key = hashlib.sha256(raw).digest()
    if key not in _MAPPED:
        _MAPPED.clear()
        _MAPPED[key] = Automaton.mapped(raw)
    return _MAPPED[key]


@dataclass
class Lexicon:
    """The automaton's file content and the ids of its words."""

    raw: bytes
    ids: IdStore

    @classmethod
    def compile(cls, words: list[bytes], tokenizer: str) -> Lexicon:
        bpe, ids = Merger(tokenizer), IdStore()
        if words:
            at = bpe.word_ids(words)
            lengths = bpe.words.lengths[at]
            ids.add(bpe.words.flat[ragged(bpe.words.starts[at], lengths)], lengths)
        return cls(Automaton.build(words).dump(), ids)

    def encode(self, tokenizer: str, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and each text's first place among them (and the end)."""
        data, bounds, first = words_of(data, offsets)
        number = mapped(self.raw).numbers(data, bounds)
        starts, lengths = np.zeros(len(number), np.int64), np.zeros(len(number), np.int64)
        seen = number >= 0
        starts[seen], lengths[seen] = self.ids.starts[number[seen]], self.ids.lengths[number[seen]]
        flat = self.ids.flat[: self.ids.used]
        if not seen.all():
            bpe = merger(tokenizer)
            words = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
            coded = words.take(pa.array(np.flatnonzero(~seen))).dictionary_encode()
            at = bpe.word_ids(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
            starts[~seen], lengths[~seen] = bpe.words.starts[at] + len(flat), bpe.words.lengths[at]
            flat = np.concatenate([flat, bpe.words.flat[: bpe.words.used]])
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return flat[ragged(starts, lengths)], ends[first]


def token_bytes(tokenizer: str) -> tuple[np.ndarray, np.ndarray]:
    """Each id's token and a space, as bytes one after the other, with offsets: what decoding without a decoder joins."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)
    if t.decoder is not None:
        raise ValueError("this tokenizer has a decoder of its own")
    made = [((t.id_to_token(i) or "") + " ").encode() for i in range(t.get_vocab_size(with_added_tokens=True))]
    return np.frombuffer(b"".join(made), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in made])])


def decode(ids: np.ndarray, offsets: np.ndarray, tokens: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts of id runs as UTF-8 with offsets: tokens joined by single spaces."""
    raw, at = tokens
    ids = ids.astype(np.int64)
    lengths = at[ids + 1] - at[ids]
    lengths[offsets[1:][np.diff(offsets) > 0] - 1] -= 1  # no space after a text's last token
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return raw[ragged(at[ids], lengths)], ends[offsets]


_TOKENS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def transcode(docs: DataFrame, tokenizer: str, most: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids, decoded) of all rows of ``docs`` (doc_id, text): ids as the tokenizers library encodes the whole text.

    A null text is an empty one with no ids and an empty decoded text; repeated rows come out each; an empty table gives
    no rows; other columns are not looked at; a word of any length is merged exactly.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spec = docs.sparkSession.sparkContext.broadcast(Lexicon.compile(frequent_words(docs, most), tokenizer))  # LEXICON_WORDS words at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _TOKENS:
            _TOKENS[tokenizer] = token_bytes(tokenizer)
        for batch in text_slices(batches, "text", 3 << 20):
            ids, at = spec.value.encode(tokenizer, *utf8_view(batch.column("text")))
            text, ends = decode(ids, at, _TOKENS[tokenizer])
            yield columns(doc_id=batch.column("doc_id"), ids=binary_array(ids.astype("<u4").view(np.uint8), at * 4), decoded=binary_array(text, ends))

    return arrow_map(docs, run, "doc_id long, ids binary, decoded binary")
