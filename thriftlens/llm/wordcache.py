"""Token ids of plain texts by table look-up: words are found by their bytes, and only new ones are encoded.

A byte-level pre-tokenizer cuts a plain text at known places, so its words can be encoded one by one, and they
repeat. All words of a slice of texts are packed at once, looked up in a table of slots (a word overwrites what
was in its slot) and their ids copied together, all in numpy; memory is bounded by the table and a pool of ids.
A slot holds the whole word if it has 16 bytes or fewer, which is nearly always, and a 128-bit hash of a longer one,
and its length; so a word is never taken for another. Texts that aren't plain are left to the caller, whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import xxhash

from .common import in_groups
from .shingles import mix

#: Beyond Latin-1 and Latin Extended-A, and for Latin-1's own fractions and superscripts and white space, a text isn't plain.
ODD = re.compile("[\x1c-\x1f\x85\xa0\xaa\xb2\xb3\xb9\xba\xbc-\xbe\u0180-\U0010ffff]")
#: Slots of a worker's memory of chunks (a power of 2), and the ids that it holds at most.
SLOT_BITS, POOL = 21, 1 << 23
#: What plain() texts don't hold: white space that the pre-tokenizer may join to a neighbour, or rarer characters.
_RUNS = (b"  ", b"\n ", b" \n", b"\n\n", b"\t", b"\r", b"\x0b", b"\x0c", b"\x1c", b"\x1d", b"\x1e", b"\x1f")


def _bytes(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SPACE, _STOP, _LETTER = _bytes(b" \n"), _bytes(b".,;:!?"), _bytes(bytes([*range(65, 91), *range(97, 123)]))


def plain(text: bytes) -> bool:
    return not any(r in text for r in _RUNS) and (text.isascii() or not ODD.search(text.decode("utf-8", "replace")))


def chunk_starts(b: np.ndarray) -> np.ndarray:
    """Where a plain() text (its bytes, closed by a line break) can be cut without cutting a piece.

    A byte-level pre-tokenizer's pieces begin with a space or hold none, a line break is a piece of its own, and
    so is a stop between a letter and white space.
    """
    cut = _SPACE[b]
    cut[1:] |= b[:-1] == 10
    cut[1:-1] |= _STOP[b[1:-1]] & _LETTER[b[:-2]] & _SPACE[b[2:]]
    cut[:1] = True
    return np.flatnonzero(cut)


#: Weights that pack 8 bytes into an integer; what comes after them counts nothing.
_PACK = np.array([1 << (8 * i) for i in range(8)] + [0], np.uint64)


def packed(b: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(2, words): the bytes of each word of 16 bytes or fewer, or a 128-bit hash; words are end to end in b."""
    place = np.arange(len(b))
    place -= np.repeat(starts, lengths)
    out = np.zeros((2, len(starts)), np.uint64)
    out[0] = np.add.reduceat(b * _PACK[np.minimum(place, 8)], starts)
    more = np.flatnonzero(lengths > 8)
    if len(more):
        rest = place >= 8
        n = lengths[more] - 8
        out[1, more] = np.add.reduceat(b[rest] * _PACK[np.minimum(place[rest] - 8, 8)], np.cumsum(n) - n)
        for i in more[n > 8].tolist():
            h = xxhash.xxh3_128_intdigest(b[starts[i] : starts[i] + lengths[i]])
            out[:, i] = h & 0xFFFFFFFFFFFFFFFF, h >> 64
    return out


class WordCache:
    """ask(words) gives the ids of words end to end, and how many each has."""

    def __init__(self, ask: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]):
        self.ask = ask
        self.forget()

    def forget(self) -> None:
        self.keys, self.bytes = np.zeros((2, 1 << SLOT_BITS), np.uint64), np.zeros(1 << SLOT_BITS, np.int32)
        self.at, self.length = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def plain_ids(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of plain() texts, end to end, and how many each has."""
        if self.used > POOL:
            self.forget()
        buffer = b"\n".join(texts) + b"\n"
        b = np.frombuffer(buffer, np.uint8)
        starts = chunk_starts(b)
        lengths = np.diff(np.append(starts, len(b)))
        keys = packed(b, starts, lengths)
        ends = np.cumsum([len(t) + 1 for t in texts])
        slot = (mix(keys[0] ^ (keys[1] * np.uint64(0x9E3779B97F4A7C15)) + lengths.astype(np.uint64)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, n = self.at[slot].astype(np.int64), self.length[slot].astype(np.int64)
        missing = np.flatnonzero((self.keys[0][slot] != keys[0]) | (self.keys[1][slot] != keys[1]) | (self.bytes[slot] != lengths))
        if len(missing):
            new = np.stack([keys[0, missing], keys[1, missing], lengths[missing].astype(np.uint64)], 1)
            new, first, which = np.unique(new, axis=0, return_index=True, return_inverse=True)
            where = missing[first]
            ids, count = self.ask([buffer[x : x + k] for x, k in zip(starts[where].tolist(), lengths[where].tolist())])
            base = self.used
            self.add(ids)
            place = base + np.cumsum(count) - count
            which = which.ravel()
            at[missing], n[missing] = place[which], count[which]
            s = slot[where]
            last = np.unique(s[::-1], return_index=True)[1]  # of words that share a slot one stays, whole
            last = len(s) - 1 - last
            s = s[last]
            self.keys[:, s], self.bytes[s], self.at[s], self.length[s] = new[last, :2].T, new[last, 2], place[last], count[last]
        n[np.searchsorted(starts, ends - 1)] = 0  # the line breaks that close the texts
        per_text = np.add.reduceat(n, np.searchsorted(starts, ends - np.array([len(t) + 1 for t in texts])))
        return self.pool[spread(at, n)], per_text

    def add(self, ids: np.ndarray) -> None:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def ids_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each of some plain() texts."""
        out: list[np.ndarray] = []
        for begin, end in in_groups([len(t) for t in texts], 1 << 20):
            ids, n = self.plain_ids(texts[begin:end])
            out += np.split(ids, np.cumsum(n)[:-1])
        return out


def spread(at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of runs of n."""
    out = np.repeat(at - (np.cumsum(n) - n), n)
    out += np.arange(len(out))
    return out
