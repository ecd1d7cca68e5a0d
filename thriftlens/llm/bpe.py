"""Byte-level BPE, encoded by backtracking over longest matches and decoded with an offset table.

A piece of text (as the pre-tokenizer cuts it) is encoded without running merges: an Aho-Corasick automaton
over the vocabulary gives longest token matches from left to right; two neighbouring tokens stand only if the
pair is compatible, that is if BPE of their joined bytes gives just these two; where it isn't, the next shorter
token is tried, or the last token is taken back. Each position fails at most once, so time is linear, and the
result is the one exact merge order gives. Compatibility of a pair is read off the merge table: it holds
unless some merge across the seam comes before the merges that made the two sides; answers are remembered.

Words repeat, so each Python worker remembers the ids of a bounded number of them (see wordcache).

Decoding lays all token bytes end to end with a table of offsets; a document's ids then select byte ranges.

Defined results: null text is an empty text; no text gives no ids. Repeated rows give repeated rows. Texts are
read whole. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, raw, shipped
from .wordcache import ODD, WordCache, plain, spread

#: Fixed by the tokenizer's public format: how a byte-level pre-tokenizer cuts a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_EXACT = regex.compile(PIECES)
#: The same for plain texts: no marks, no numerals but 0-9.
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Compatible and incompatible pairs, and pieces of rarer texts, that a worker remembers at most.
PAIRS, REMEMBERED = 500_000, 50_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself where printable, else from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def pieces(text: str) -> list[str]:
    return (_EXACT if ODD.search(text) else _PLAIN).findall(text)


class Vocabulary:
    """A byte-level BPE vocabulary from a tokenizers JSON file (its bytes) whose merges are in the order of their ids."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, letters = spec["model"], byte_letters()
        if spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space") or model["type"] != "BPE":
            raise ValueError("only byte-level BPE without a normalizer is read")
        ids = {w: i for w, i in model["vocab"].items()}
        size = max([*ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.bytes_of = [b""] * size
        for w, i in ids.items():
            self.bytes_of[i] = bytes(letters[c] for c in w)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for w, i in self.special.items():
            self.bytes_of[i] = w.encode()
        self.rank: dict[tuple[int, int], int] = {}
        self.made_of: dict[int, tuple[int, int]] = {}
        self.order = [0] * size
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair, new = (ids[a], ids[b]), ids[a + b]
            self.rank[pair] = r
            self.made_of.setdefault(new, pair)
            self.order[new] = r + 1
        self.machine = ahocorasick.Automaton()
        self.id_of: dict[str, int] = {}
        for w, i in ids.items():
            s = self.bytes_of[i].decode("latin-1")
            self.id_of[s] = i
            self.machine.add_word(s, (i, len(s)))
        self.machine.make_automaton()
        #: The longest token that is a proper prefix of each token.
        self.shorter = [-1] * size
        for s, i in self.id_of.items():
            for n in range(len(s) - 1, 0, -1):
                j = self.id_of.get(s[:n])
                if j is not None:
                    self.shorter[i] = j
                    break
        self.length = [len(b) for b in self.bytes_of]
        self.offsets = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.split_at = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._fits: dict[int, bool] = {}
        self._known: dict[str, list[int]] = {}
        self.decimal = [str(i) for i in range(size)]
        self.words = WordCache(self._ask)

    def fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves tokens a and b side by side."""
        key = a << 20 | b
        known = self._fits.get(key)
        if known is None:
            known = self._fits[key] = self._seam(a, b)
            if len(self._fits) > PAIRS:
                self._fits.clear()
        return known

    def _seam(self, a: int, b: int) -> bool:
        """Undo merges on both sides of the seam, latest first, looking for a merge across it that comes earlier.

        Before merge number `until` the neighbours of the seam were a and b. If they can merge, and that merge
        comes before `until`, BPE would have joined them.
        """
        rank, order, made_of = self.rank, self.order, self.made_of
        until = len(rank) + 1
        while True:
            r = rank.get((a, b))
            if r is not None and r + 1 < until:
                return False
            # the side that was made later is undone first; on equal ranks BPE merges the left one first
            if order[a] > order[b]:
                until, a = order[a], made_of[a][1]
            elif order[b]:
                # a merge of the same number as b's comes first if it is across the seam, being further left
                until, b = order[b] + 1, made_of[b][0]
            elif order[a]:
                until, a = order[a], made_of[a][1]
            else:
                return True

    def encode_piece(self, s: str) -> list[int]:
        """Ids of one piece, given as a string of its bytes (latin-1)."""
        greedy = [v[0] for _, v in self.machine.iter_long(s)]
        fits = self.fits
        if all(map(fits, greedy, greedy[1:])):
            return greedy
        return self._backtrack(s)

    def _longest(self, s: str) -> list[int]:
        """The longest token that begins at each position."""
        out, n = [-1] * len(s), [0] * len(s)
        for end, (i, k) in self.machine.iter(s):
            if k > n[end - k + 1]:
                out[end - k + 1], n[end - k + 1] = i, k
        return out

    def _backtrack(self, s: str) -> list[int]:
        longest, dead = self._longest(s), bytearray(len(s) + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < len(s):
            last = out[-1] if out else -1
            while token >= 0 and (dead[at + self.length[token]] or (last >= 0 and not self.fits(last, token))):
                token = self.shorter[token]
            if token >= 0:
                out.append(token)
                at += self.length[token]
                token = longest[at] if at < len(s) else -1
            else:
                dead[at] = 1
                token = out.pop()
                at -= self.length[token]
                token = self.shorter[token]
        return out

    def _piece(self, p: str) -> list[int]:
        return self.encode_piece(p.encode().decode("latin-1"))

    def _ask(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """ids of words of plain texts, end to end, and how many each has."""
        lists = [[i for p in _PLAIN.findall(w.decode()) for i in self._piece(p)] for w in words]
        return np.array([i for x in lists for i in x], np.int32), np.array([len(x) for x in lists], np.int64)

    def encode(self, text: str) -> np.ndarray:
        """ids of any text."""
        parts = [p for p in self.split_at.split(text) if p] if self.split_at else [text]
        out: list[int] = []
        for part in parts:
            if part in self.special:
                out.append(self.special[part])
                continue
            for p in pieces(part):
                ids = self._known.get(p)
                if ids is None:
                    if len(self._known) >= REMEMBERED:
                        self._known.clear()
                    ids = self._known[p] = self._piece(p)
                out += ids
        return np.array(out, np.int32)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        """ids of texts: plain ones word by word, others piece by piece."""
        usual = [i for i, t in enumerate(texts) if t and plain(t) and not any(s.encode() in t for s in self.special)]
        out: list[np.ndarray | None] = [None] * len(texts)
        for i, ids in zip(usual, self.words.ids_of([texts[i] for i in usual])):
            out[i] = ids
        return [self.encode(t.decode("utf-8", "replace")) if ids is None else ids for t, ids in zip(texts, out)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of a sequence of ids."""
        begin = self.offsets[ids]
        return self.all_bytes[spread(begin, self.offsets[ids + 1] - begin)].tobytes()


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(content: bytes) -> Vocabulary:
    """One for each Python worker and file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Vocabulary(content)
    return _LOADED[key]


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 per row of docs; with_ids adds the ids themselves."""
    shared = shipped(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(shared.value)
        for b in batches:
            n, ids_hash, text_hash = [], [], []
            kept = v.encode_all([t or b"" for t in raw(b)])
            for ids in kept:
                n.append(len(ids))
                ids_hash.append(hashlib.sha256(",".join(map(v.decimal.__getitem__, ids.tolist())).encode()).hexdigest())
                h = hashlib.sha256()
                for begin in range(0, len(ids), 1 << 18):
                    h.update(v.decode(ids[begin : begin + (1 << 18)]))
                text_hash.append(h.hexdigest())
            arrays = [column(b, "doc_id"), pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                flat = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *n]).astype(np.int32)), pa.array(flat)))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
