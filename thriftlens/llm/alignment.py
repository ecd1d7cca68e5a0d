"""Cross-tokenizer alignment: which ids of two tokenizers stand for the same bytes, and how often they do so.

A text's tokens by A and by B are two ways to cut the same bytes. Tokens that share a byte are linked in a bipartite
graph, and union-find gives its components: as both sides lie on one line, a component is exactly a minimal group, the
tokens between two byte offsets at which both tokenizers end a token. All A-B pairs of a component's members are links.
How many documents hold an id pair linked is then counted over the corpus.

Both tokenizers treat the words of plain texts one by one, so each worker remembers the groups of a bounded number of
words (see wordcache; that the second vocabulary has no piece across a cut is read off its pieces). Other texts are
encoded and grouped whole.

Counting is distributed in three steps of shrinking size. A slice (one Arrow batch, bounded by bytes) holds a dictionary
of its distinct pairs with the number of its documents that hold each; its documents only point into it. The
dictionaries' counts are added up per pair, which gives every pair's count and the highest of each A id (at most one row
for each id of B). The counts go back to the dictionaries, a row for each pair of a slice and not of a document, and a
slice's documents are then summed up together. So nothing is collected, and what a task holds is bounded by a slice.

Defined results: null and empty texts, and texts whose tokens of A or of B don't give the bytes of space + text again
(a character that a tokenizer rewrites), have no tokens: zeros and an empty digest. Special tokens' strings are plain
text. Each row is a document, so repeated rows count each time and share a result. A very long text is one document in a slice of its own.
An empty table gives no rows. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import byte_letters
from .common import by_key, column, least_reached, mapped, raw, scratch, shipped, written
from .tokenout import Encoder
from .wordcache import WordCache, plain, spread

#: Words (or whole texts) and links of theirs that a worker remembers at most.
ENTRIES, LINKS = 300_000, 3_000_000


class Growing:
    """A numpy array that grows at its end."""

    def __init__(self, dtype: type):
        self.held, self.n = np.zeros(1 << 12, dtype), 0

    def add(self, more: np.ndarray) -> None:
        while self.n + len(more) > len(self.held):
            self.held = np.concatenate([self.held, np.zeros_like(self.held)])
        self.held[self.n : self.n + len(more)] = more
        self.n += len(more)


def overlap_groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A token and of each B token, from 0 in order; both cut the same bytes and end together."""
    ends = np.union1d(a_ends, b_ends)  # the bytes between two ends are in one token of A and one of B: a link
    nodes, least = least_reached(np.searchsorted(a_ends, ends), len(a_ends) + np.searchsorted(b_ends, ends))
    group = np.searchsorted(np.unique(least), least)  # a component's least node is its first A token
    return group[: len(a_ends)], group[len(a_ends) :]


class Aligner:
    """Tokens and groups of texts, by the bytes of the two tokenizers' files."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece

        self.a, self.b = Encoder(a, literal=True), sentencepiece.SentencePieceProcessor(model_proto=b)
        letters, vocab = byte_letters(), self.a.library.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for w, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in w) if all(c in letters for c in w) else w.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_length, self.b_length = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        usual = [x for i, x in enumerate(self.b_bytes) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        #: Whether no piece reaches across a cut between words, so that B too can be asked for words.
        self.by_words = not any(b" " in x.lstrip(b" ") or b"\n" in x or re.search(rb"[A-Za-z][.,;:!?]", x) for x in usual) and [self.b_bytes[i] for i in self.b.encode("\n")] == [b" ", b"\n"]
        self.words = WordCache(self._ask)
        self.forget()

    def forget(self) -> None:
        self.words.forget()
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad, self.at, self.length = (Growing(np.int64) for _ in range(7))
        self.pair, self.times = Growing(np.int32), Growing(np.int32)
        self.said: list[str] = []
        self.numbers: dict[int, int] = {}
        self.codes = Growing(np.int64)

    def _ask(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word's entry."""
        ids, n = self.a.ask(chunks)
        # after a line break a word has no space put before it; those two tokens are left out again
        other = [x[2:] for x in self.b.encode(["\n" + c.decode("utf-8", "replace") for c in chunks], num_threads=1)]
        return self._add(chunks, np.split(ids, np.cumsum(n)[:-1]), other), np.ones(len(chunks), np.int64)

    def _add(self, texts: list[bytes], a: list[np.ndarray], b: list[list[int]]) -> np.ndarray:
        """Numbers of new entries: texts with their tokens by A and by B."""
        first = len(self.said)
        good = np.array([b"".join([self.a_bytes[i] for i in x]) == t == b"".join([self.b_bytes[i] for i in y]) for t, x, y in zip(texts, a, b)], bool)
        none = np.zeros(0, np.int64)
        a = [np.asarray(x, np.int64) if g else none for x, g in zip(a, good)]
        b = [np.asarray(y, np.int64) if g else none for y, g in zip(b, good)]
        n_a, n_b = np.array([len(x) for x in a], np.int64), np.array([len(y) for y in b], np.int64)
        ids_a, ids_b = np.concatenate([none, *a]), np.concatenate([none, *b])
        unit = np.repeat(np.arange(len(texts)), n_a)
        if len(ids_a):
            ga, gb = overlap_groups(np.cumsum(self.a_length[ids_a]), np.cumsum(self.b_length[ids_b]))
        else:
            ga = gb = none
        n = int(ga[-1]) + 1 if len(ga) else 0
        ca, cb = np.bincount(ga, minlength=n), np.bincount(gb, minlength=n)
        of = unit[np.cumsum(ca) - ca] if n else none  # each group's text
        total = lambda x: np.bincount(of, weights=x, minlength=len(texts)).astype(np.int64)
        n_groups = total(np.ones(n))
        # members expand to links; equal ids of a group first become one with a count
        ua, ta = np.unique(ga * len(self.a_bytes) + ids_a, return_counts=True)
        ub, tb = np.unique(gb * len(self.b_bytes) + ids_b, return_counts=True)
        ua, ga_ = ua % len(self.a_bytes), ua // len(self.a_bytes)
        ub, gb_ = ub % len(self.b_bytes), ub // len(self.b_bytes)
        each = np.bincount(gb_, minlength=n)
        left = np.repeat(np.arange(len(ua)), each[ga_])
        right = spread((np.cumsum(each) - each)[ga_], each[ga_])
        number = self._numbered(ua[left] * len(self.b_bytes) + ub[right])
        at = self.pair.n
        length = np.bincount(of[ga_[left]], minlength=len(texts))
        self.pair.add(number)
        self.times.add(ta[left] * tb[right])
        for held, new in ((self.n_a, n_a), (self.n_b, n_b), (self.n_groups, n_groups), (self.n_links, total(ca * cb)), (self.bad, ~good), (self.length, length), (self.at, at + np.cumsum(length) - length)):
            held.add(new)
        said_a, said_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        groups, i, j = [], 0, 0
        for x, y in zip(ca.tolist(), cb.tolist()):
            groups.append(f"{','.join(said_a[i : i + x])}|{','.join(said_b[j : j + y])}")
            i, j = i + x, j + y
        i = 0
        for x in n_groups.tolist():
            self.said.append(";".join(groups[i : i + x]))
            i += x
        return np.arange(first, len(self.said), dtype=np.int32)

    def _numbered(self, codes: np.ndarray) -> np.ndarray:
        """This worker's own number of each id pair."""
        numbers, new = self.numbers, []
        out = np.empty(len(codes), np.int32)
        for i, c in enumerate(codes.tolist()):
            k = numbers.get(c)
            if k is None:
                k = numbers[c] = len(numbers)
                new.append(c)
            out[i] = k
        self.codes.add(np.array(new, np.int64))
        return out

    def entries(self, texts: list[bytes | None]) -> list[np.ndarray]:
        """The numbers of the entries that make up each text: its words, or itself; none for null and empty texts."""
        if len(self.said) > ENTRIES or self.pair.n > LINKS:
            self.forget()
        out = [np.zeros(0, np.int32)] * len(texts)
        usual, odd = [], []
        for i, t in enumerate(texts):
            if t:
                (usual if self.by_words and plain(b" " + t) and not any(s in t for s in self.a.special) else odd).append(i)
        for i in odd:
            t = texts[i].decode("utf-8", "replace")
            out[i] = self._add([b" " + texts[i]], self.a.whole([" " + t]), [self.b.encode(t, num_threads=1)])
        for i, e in zip(usual, self.words.ids_of([b" " + texts[i] for i in usual])):
            out[i] = e
        return out


_LOADED: dict[str, Aligner] = {}


def aligner(a: bytes, b: bytes) -> Aligner:
    """One for each Python worker and pair of files."""
    key = hashlib.sha256(a).hexdigest() + hashlib.sha256(b).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Aligner(a, b)
    return _LOADED[key]


SLICES = "slice long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, groups string, idx array<int>, times array<int>, a array<int>, b array<int>, docs array<int>"
_NAMES = [x.split()[0] for x in SLICES.split(", ")]


def _lists(flat: np.ndarray, n: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(flat.astype(np.int32)))


def slices(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """Rows of documents, which point into their slice's dictionary of id pairs (idx), and a row for each dictionary."""
    left, right = shipped(docs.sparkSession, a), shipped(docs.sparkSession, b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, slice_ = aligner(left.value, right.value), TaskContext.get().partitionId() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            m = batch.num_rows
            lists = al.entries(raw(batch))
            lists = [x if not al.bad.held[x].any() else x[:0] for x in lists]
            e, doc = np.concatenate(lists), np.repeat(np.arange(m), [len(x) for x in lists])
            total = lambda c: np.bincount(doc, weights=c.held[e], minlength=m).astype(np.int64)  # noqa: E731, B023
            groups = [";".join(map(al.said.__getitem__, x.tolist())) for x in lists]
            digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            # documents and their distinct pairs, with how often each is linked
            n = al.length.held[e]
            place = spread(al.at.held[e], n)
            size = max(1, len(al.numbers))
            key, times = np.repeat(doc, n) * size + al.pair.held[place], al.times.held[place]
            if times.sum() <= 4 * len(times):
                key, times = np.unique(np.repeat(key, times), return_counts=True)
            else:
                key, at = np.unique(key, return_inverse=True)
                times = np.bincount(at, weights=times)
            owner, pair = key // size, key % size
            held = np.bincount(pair, minlength=size)
            there = np.flatnonzero(held)
            local = np.cumsum(held > 0) - 1
            per = np.bincount(owner, minlength=m)
            pad = lambda kind: pa.nulls(m, kind)  # noqa: E731, B023
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m, slice_)), column(batch, "doc_id"), *(pa.array(total(c)) for c in (al.n_a, al.n_b, al.n_groups, al.n_links)), pa.array(digests, pa.string()), pa.array(groups, pa.string()) if with_groups else pad(pa.string()), _lists(local[pair], per), _lists(times, per), pad(ints), pad(ints), pad(ints)],
                _NAMES,
            )
            code, one = al.codes.held[there], np.array([len(there)])
            dictionary = [_lists(code // len(al.b_bytes), one), _lists(code % len(al.b_bytes), one), _lists(held[there], one)]
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [ints] * 2
            yield pa.RecordBatch.from_arrays([pa.array([slice_], pa.int64()), *(pa.nulls(1, k) for k in kinds), *dictionary], _NAMES)
            slice_ += 1

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SLICES)


def dictionaries(table: DataFrame) -> DataFrame:
    """slice, pos, a, b, docs: the rows of the slices' dictionaries."""
    rows = table.where(F.col("a").isNotNull()).select("slice", F.posexplode(F.arrays_zip("a", "b", "docs")).alias("pos", "pair"))
    return rows.select("slice", "pos", "pair.a", "pair.b", F.col("pair.docs").cast("long").alias("docs"))


def pair_counts(table: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (whether it is the highest of its a)."""
    counts = dictionaries(table).groupBy("a", "b").agg(F.sum("docs").alias("count"))
    return counts.withColumn("best", F.col("count") == F.max("count").over(W.partitionBy("a")))  # a row for each id of B at most


def aligned(docs: DataFrame, a: str, b: str, with_groups: bool = False) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of docs; with_groups adds the groups' ids as text.

    a is a byte-level tokenizer's JSON file and b a sentencepiece model's.
    """
    with scratch() as keep:
        table = keep(written(slices(docs, a, b, with_groups), "slices"))
        counts = written(pair_counts(table), "pairs")
        found = dictionaries(table).join(counts.hint("merge"), ["a", "b"]).select("slice", F.struct("pos", "count", "best").alias("x"))
        back = keep(written(found.groupBy("slice").agg(F.collect_list("x").alias("found")), "found"))  # a slice's dictionary, bounded as a slice is
    null = lambda kind: F.lit(None).cast(kind)
    own: list[Column | str] = ["slice", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "groups", "idx", "times"]
    kinds = {x.split()[0]: x.split()[1] for x in SLICES.split(", ")}
    rows = table.where(F.col("a").isNull()).select(*own, null("array<struct<pos:int,count:bigint,best:boolean>>").alias("found"))
    tasks = rows.unionByName(back.select("slice", *(null(kinds[c]).alias(c) for c in own[1:]), "found"))

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["slice"]):
            t = t.combine_chunks()
            told = t.column("found").combine_chunks()
            x = told.filter(told.is_valid()).flatten()
            pos = x.field("pos").to_numpy()
            count, best = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
            count[pos], best[pos] = x.field("count").to_numpy(), x.field("best").to_numpy(zero_copy_only=False)
            t = t.filter(told.is_null())
            idx, times = t.column("idx").combine_chunks(), t.column("times").combine_chunks()
            at, n = idx.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(idx.value_lengths().to_numpy())])
            upto = lambda v: np.diff(np.concatenate([[0], np.cumsum(v * n)])[ends])  # noqa: E731, B023
            out = t.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"]).append_column("n_best", pa.array(upto(best[at]))).append_column("count_sum", pa.array(upto(count[at])))
            yield from out.append_column("groups_sha256", t.column("groups_sha256")).append_column("groups", t.column("groups")).combine_chunks().to_batches()

    result = mapped(tasks.repartition("slice").sortWithinPartitions("slice"), summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string")
    return result if with_groups else result.drop("groups")
