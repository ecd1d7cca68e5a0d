"""Hashed word shingles of whole texts, in numpy: the same code for signatures and for exact checks."""

from __future__ import annotations

import numpy as np
import xxhash

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**64 - 1, 1 << 12, dtype=np.uint64) | np.uint64(1)
_STEP = _rng.integers(1, 2**64 - 1, 64, dtype=np.uint64) | np.uint64(1)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at once; a longer text is hashed in pieces that end between words.
PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(b: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes; runs are end to end in b.

    Bytes are weighted by their place; the few runs longer than the table of weights are hashed one by one.
    """
    place = np.arange(len(b)) - np.repeat(begins, lengths)
    weighted = _BYTE[b]
    weighted *= _PLACE[place & (len(_PLACE) - 1)]
    out = mix(np.add.reduceat(weighted, begins) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for i in np.flatnonzero(lengths > len(_PLACE)).tolist():
        out[i] = xxhash.xxh64_intdigest(b[begins[i] : begins[i] + lengths[i]].tobytes())
    return out


def _piece(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a text, and where each begins."""
    b = np.frombuffer(text, np.uint8)
    at = np.flatnonzero(~_WHITE[b])
    if not len(at):
        return np.zeros(0, np.uint64), at
    first = np.ones(len(at), bool)
    first[1:] = np.diff(at) > 1
    begins = np.flatnonzero(first)
    return run_hashes(b[at], begins, np.diff(np.append(begins, len(at)))), at[begins]


def words(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word of a text whose A-Z are lower-cased already."""
    if len(text) <= PIECE:
        return _piece(text)[0]
    out, begin = [], 0
    while begin < len(text):
        end = min(len(text), begin + PIECE)
        while end < len(text) and not _WHITE[text[end]]:
            end += 1
        out.append(_piece(text[begin:end])[0])
        begin = end
    return np.concatenate(out)


def shingles(w: np.ndarray, k: int) -> np.ndarray:
    """The distinct hashed runs of k words, sorted; fewer words make one shingle, none make none."""
    if not len(w):
        return np.zeros(0, np.uint64)
    n = min(k, len(w))
    s = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        s += w[i : len(w) - n + 1 + i] * _STEP[i]
    return np.unique(mix(s + np.uint64(n)))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    return shingles(words(text.lower()), k) if text else np.zeros(0, np.uint64)


def word_runs(texts: list[bytes]) -> list[np.ndarray]:
    """words() of many short texts at one pass."""
    if len(texts) == 1:
        return [words(texts[0])]
    w, at = _piece(b"\n".join(texts))
    return np.split(w, np.searchsorted(at, np.cumsum([len(t) + 1 for t in texts[:-1]])))
