"""Whole-text encoding with the tokenizers library, paid once per distinct piece of text.

A text is cut before white space that follows a visible character, and between Latin letters and plain marks or digits.
Neither pre-tokenizer in use joins text across such a place, and Unicode normalisation and the marks of special tokens
don't either, so the ids of the pieces, one after the other, are the ids of the text. Where a byte pattern might be the
end of a Unicode space, there is no cut.
"""

from __future__ import annotations

import os
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa

from .common import WORKER_CACHE, ragged

#: Distinct pieces that a Python worker remembers; beyond that it keeps those met again (results do not change).
CACHE_PIECES = 600_000

WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True


_LETTER, _STOP, _SMALL = np.zeros(256, bool), np.zeros(256, bool), np.arange(256, dtype=np.uint8)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP[list(b"0123456789!#$%&()*+,-./:;=?@")] = True
_SMALL[65:91] += 32


def _latin(data: np.ndarray) -> np.ndarray:
    """Where a byte ends a letter of ASCII or of the second half of Latin-1."""
    out = _LETTER[data]
    if len(data) > 1:
        one, two = data[1:], data[:-1]
        out[1:] |= (two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7)
    return out


def _between(data: np.ndarray) -> np.ndarray:
    """Where a letter meets a mark or digit that starts neither a contraction nor a special token: no token lies across."""
    return (_latin(data)[:-1] & _STOP[data[1:]]) | (_STOP[data[:-1]] & _LETTER[data[1:]])


def piece_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions that start a piece, with every text's start, and the end."""
    if not len(data):
        return np.zeros(1, np.int64)
    white = WHITE[data]
    at = np.flatnonzero(white[1:] & ~white[:-1]) + 1
    one, two, three = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
    solid = (one > 0x20) & (one != 0x7F) & ~((one >= 0x80) & ((two == 0xC2) | ((three >= 0xE1) & (three <= 0xE3))))
    marks = np.zeros(len(data) + 1, bool)
    marks[1:-1] = _between(data)
    marks[at[solid]] = True
    marks[offsets] = True
    marks[[0, -1]] = True
    return np.flatnonzero(marks)


def word_cuts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokenizers that drop white space and case and split letters from marks: bytes, piece starts (and the end), texts' places.

    ASCII white space is left out and Latin-1 capitals are small. Slices with ``<|``, which may mark a special token, keep
    their case.
    """
    if not len(data):
        return data, np.zeros(1, np.int64), offsets
    ink = ~WHITE[data]
    starts = np.zeros(len(data) + 1, bool)
    starts[1:-1] = _between(data) | ~ink[:-1]
    starts[offsets] = True
    starts[[0, -1]] = True
    place = np.zeros(len(data) + 1, np.int32)
    np.cumsum(ink, dtype=np.int32, out=place[1:])
    small = data
    if not ((data[:-1] == 60) & (data[1:] == 124)).any():
        small = _SMALL[data]
        small[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)).astype(np.uint8) << 5
    marks = np.zeros(place[-1] + 1, bool)
    marks[place[starts]] = True
    return small[ink], np.flatnonzero(marks), place[offsets].astype(np.int64)


class IdStore:
    """Growing ragged array of id runs."""

    def __init__(self) -> None:
        self.flat, self.starts, self.lengths, self.n, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def kept(self, at: np.ndarray) -> IdStore:
        """A store with the runs at ``at`` alone, in that order."""
        out = IdStore()
        out.add(self.flat[ragged(self.starts[at], self.lengths[at])], self.lengths[at])
        return out

    def add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(lengths) > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.lengths[self.n : self.n + len(lengths)] = lengths
        self.starts[self.n : self.n + len(lengths)] = self.used + np.cumsum(lengths) - lengths
        self.n += len(lengths)
        self.used += len(flat)


class PieceEncoder:
    """Encodes texts by a tokenizer file, as ``encode(text, add_special_tokens=False)`` does."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # Whether the tokenizer drops white space and case and keeps letters and marks apart, as it says itself.
        probe = "Ab, Cd.\tEF\n!g"
        self.by_words = [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(probe))] == ["ab", ",", "cd", ".", "ef", "!", "g"] if self.tokenizer.normalizer else False
        # Pieces that are one token of the pre-tokenizer go straight to the library's model, in its byte alphabet.
        self.plain = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+" if self.by_words else rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        self.letters = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.store, self.met = IdStore(), np.zeros(0, np.int64)

    def age(self) -> None:
        """Keep the pieces that were met in two slices or more, and halve how often they count as met."""
        hot = np.flatnonzero(self.met >= 2)
        places = np.full(len(self.met), -1, np.int64)
        places[hot] = np.arange(len(hot))
        self.known = {p: k for p, k in zip(self.known, places[np.fromiter(self.known.values(), np.int64, len(self.known))].tolist(), strict=True) if k >= 0}
        self.store, self.met = self.store.kept(hot), self.met[hot] // 2

    def runs(self, pieces: list[bytes]) -> np.ndarray:
        """Places of the pieces' ids in the store; ``pieces`` are distinct."""
        if len(self.known) > CACHE_PIECES:
            self.age()
        get = self.known.get
        at = np.fromiter(map(get, pieces, repeat(-1)), np.int64, len(pieces))
        if len(new := np.flatnonzero(at < 0)):
            fresh = [pieces[i] for i in new]
            for lo in range(0, len(fresh), 4096):
                ids = self.fresh_ids(fresh[lo : lo + 4096])
                self.store.add(np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))
            at[new] = np.arange(self.store.n - len(fresh), self.store.n)
            self.known.update(zip(fresh, at[new].tolist(), strict=True))
            self.met = np.concatenate([self.met, np.zeros(len(fresh), np.int64)])
        self.met[at] += 1
        return at

    def fresh_ids(self, pieces: list[bytes]) -> list[list[int]]:
        plain, tokenize, letters, space = self.plain, self.tokenizer.model.tokenize, self.letters, chr(self.letters[32])

        def coded(p: bytes) -> list[int] | None:
            # ASCII letters stand for themselves; most pieces are just these.
            if p.isalpha() and (p.islower() or not self.by_words):
                return [t.id for t in tokenize(p.decode("ascii"))]
            if not plain(p):
                return None
            return [t.id for t in tokenize(p.decode("ascii").replace(" ", space) if p.isascii() else p.decode("latin-1").translate(letters))]

        ids = list(map(coded, pieces))
        odd = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(odd, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in odd], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and each text's first place among them (and the end)."""
        if self.by_words:
            data, cuts, offsets = word_cuts(data, offsets)
        else:
            cuts = piece_cuts(data, offsets)
        if len(cuts) < 2:
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = pieces.dictionary_encode()
        at = self.runs(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        lengths = self.store.lengths[at]
        ids = self.store.flat[ragged(self.store.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return ids, ends[np.searchsorted(cuts, offsets)]


def encoder(path: str) -> PieceEncoder:
    """One encoder for each file and Python worker."""
    if path not in WORKER_CACHE:
        WORKER_CACHE[path] = PieceEncoder(path)
    return WORKER_CACHE[path]


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, np.uint32)
    keep = np.ones(len(out), bool)
    ends = offsets + np.arange(n + 1)
    keep[ends[1:] - 1] = False
    out[keep] = ids
    return out, ends
