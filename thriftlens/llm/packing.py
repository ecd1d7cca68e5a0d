"""Hierarchical packing of token ids into sequences of several lengths, which are filled to the last id.

Tiers are context sizes (4096, 2048, 1024, 512, 256). Of a document, whole windows of the longest size become sequences
of their own; what is left of it, its tail, is routed to the smallest tier that holds it. Tiers are packed from the
longest down: each tail of the tier opens a window, and the gap behind it is filled from what is shorter, by the longest
tail that fits; if none fits, by the beginning of a longer one, whose rest goes back to the shorter tiers. A tier opens
no more windows than can be filled. So every sequence is full, but for one with what is left in the end (less than the
shortest tier).

Only a tail's length decides where it goes, so the plan is made from a histogram: at most 4096 numbers reach the driver,
whatever the number of documents, and equal tails are placed in runs: the tails of length L numbered lo to lo + n go to
n sequences in a row. The plan's size follows the number of lengths. Documents get their number among equal tails by
prefix sums over the parts that they were encoded in, with no sort of documents.

Sequences of a tier are dealt in turn to steps that hold as many tokens each; neighbouring sequences of a plan are alike, so
each step gets its share of each kind. Steps of all tiers are put in one order, each tier's evenly spread.

Defined results: null and empty texts are documents of the end id alone. Very long texts are cut into windows of one
piece each. Repeated rows are packed one by one, each with its own pieces. An empty table gives no rows. Which of several
documents with equal tails gets which place follows from how Spark read them. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, mapped, raw, scratch, shipped, written
from .tokenout import Encoder
from .wordcache import plain

END = 2
#: Context sizes, each twice the next one; the longest is the window of a whole piece.
TIERS = (4096, 2048, 1024, 512, 256)
#: Tokens of one training step.
STEP = 64 * 4096


class WordEncoder(Encoder):
    """The library's ids where words end in a suffix: new words are told apart by a special token between them."""

    def __init__(self, content: bytes):
        super().__init__(content)
        self.mark = self.special[0].decode()
        self.mark_id = self.library.token_to_id(self.mark)

    def ask(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        flat, n = [], []
        for begin in range(0, len(chunks), 20_000):
            part = chunks[begin : begin + 20_000]
            ids = self.whole([self.mark.join([c.decode("utf-8", "replace") for c in part]) + self.mark])[0]
            ends = np.flatnonzero(ids == self.mark_id)
            n.append(np.diff(np.concatenate([[-1], ends])) - 1)
            flat.append(np.delete(ids, ends))
        return np.concatenate(flat), np.concatenate(n)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(texts)
        odd, usual = [], []
        for i, t in enumerate(texts):
            if t:
                (usual if plain(t) and not any(s in t for s in self.special) else odd).append(i)
        for begin in range(0, len(odd), 64):
            for i, ids in zip(odd[begin : begin + 64], self.whole([texts[i].decode("utf-8", "replace") for i in odd[begin : begin + 64]])):
                out[i] = ids
        for i, ids in zip(usual, self.words.ids_of([texts[i] for i in usual])):
            out[i] = ids
        return out


_LOADED: dict[str, WordEncoder] = {}


def word_encoder(content: bytes) -> WordEncoder:
    """One for each Python worker and file."""
    key = hashlib.sha256(content).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordEncoder(content)
    return _LOADED[key]


@dataclass
class Plan:
    """Where tails go: for each length, ranks from `cuts[i]` on have the pieces (start, length, tier, shift, offset) of `places[i]`.

    The tail of rank r has its piece in sequence r + shift of that tier.
    """

    tiers: tuple[int, ...]
    sequences: list[int]  # of each tier
    cuts: dict[int, list[int]] = field(default_factory=dict)
    places: dict[int, list[list[tuple[int, int, int, int, int]]]] = field(default_factory=dict)

    def first(self, tier: int) -> int:
        """The sequences before a tier's own."""
        return sum(self.sequences[:tier])

    def of(self, length: int, rank: int) -> list[tuple[int, int, int, int, int]]:
        return self.places[length][bisect_right(self.cuts[length], rank) - 1]

    def step(self, tier: int, nth: int) -> int:
        """The step of a tier's sequence: steps of all tiers lie in one order, those of each tier evenly."""
        steps = [self.steps(t) for t in range(len(self.tiers))]
        own = nth % steps[tier]
        # a tier's step j stands at (2 j + 1) / (2 * steps); on equal places the longer tier comes first
        before = 0
        for t, n in enumerate(steps):
            if t == tier or not self.sequences[t]:
                continue
            x = (2 * own + 1) * n - steps[tier]  # steps of t strictly before: 2 j * steps[tier] < x
            before += min(n, max(0, x // (2 * steps[tier]) + 1 if t < tier else -(-x // (2 * steps[tier]))))
        return own + before

    def steps(self, tier: int) -> int:
        return max(1, -(-self.sequences[tier] * self.tiers[tier] // STEP))


def planned(tails: dict[int, int], windows: int = 0, tiers: tuple[int, ...] = TIERS) -> Plan:
    """The plan for tails of each length (1 to less than the longest tier), after `windows` sequences of the longest tier."""
    pool: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: runs of (tail's length, piece's start, first rank, count)
    have: list[int] = []
    put: dict[int, list[tuple[int, int, int, int, int, int, int]]] = {}
    total = 0
    sequences = [windows] + [0] * (len(tiers) - 1)

    def give(length: int, run: tuple[int, int, int, int]) -> None:
        nonlocal total
        if run[3]:
            if length not in pool:
                pool[length] = []
                insort(have, length)
            pool[length].append(run)
            total += length * run[3]

    def take(length: int, most: int) -> tuple[int, int, int, int]:
        nonlocal total
        source, start, lo, n = pool[length].pop()
        k = min(n, most)
        if k < n:
            pool[length].append((source, start, lo + k, n - k))
        elif not pool[length]:
            del pool[length]
            have.remove(length)
        total -= length * k
        return source, start, lo, k

    def place(run: tuple[int, int, int, int], length: int, tier: int, first: int, offset: int) -> None:
        source, start, lo, n = run
        put.setdefault(source, []).append((lo, lo + n, start, length, tier, first - lo, offset))

    def fill(tier: int, first: int, count: int, used: int) -> None:
        """Fill windows first to first + count - 1 of a tier, all used so far to the same offset."""
        open_ = [(first, count, used)]
        while open_:
            at, n, upto = open_.pop()
            gap = tiers[tier] - upto
            if not gap:
                continue
            i = bisect_right(have, gap)
            length = have[i - 1] if i else have[-1]
            run = take(length, n)
            k, piece = run[3], min(length, gap)
            place(run, piece, tier, at, upto)
            give(length - piece, (run[0], run[1] + piece, run[2], k)) if piece < length else None
            open_.append((at + k, n - k, upto)) if k < n else None
            open_.append((at, k, upto + piece))

    for length in sorted(tails):
        give(length, (length, 0, 0, tails[length]))
    for t, size in enumerate(tiers):
        for length in range(max(tiers), 0 if t + 1 == len(tiers) else size // 2, -1):
            while length in pool and (n := min(sum(r[3] for r in pool[length]), total // size)):
                run = take(length, n)
                first, piece = sequences[t], min(length, size)
                sequences[t] += run[3]
                place(run, piece, t, first, 0)
                give(length - piece, (run[0], run[1] + piece, run[2], run[3])) if piece < length else fill(t, first, run[3], piece)
    if have:  # less than the shortest tier
        t, offset = len(tiers) - 1, 0
        while have:
            length = have[-1]
            place(take(length, 1), length, t, sequences[t], offset)
            offset += length
        sequences[t] += 1
    plan = Plan(tiers, sequences)
    for source, placed in put.items():
        cuts = plan.cuts[source] = sorted({p[0] for p in placed})
        places: list[list[tuple[int, int, int, int, int]]] = [[] for _ in cuts]
        for lo, hi, *piece in sorted(placed, key=lambda p: p[2]):
            for i in range(bisect_right(cuts, lo) - 1, len(cuts)):
                if cuts[i] >= hi:
                    break
                places[i].append(tuple(piece))
        plan.places[source] = places
    return plan


def tokenized(docs: DataFrame, tokenizer: str, window: int = TIERS[0]) -> DataFrame:
    """part, doc_id, doc_tokens, tail, nth, windows, ids of each row.

    nth: equal tails before it in its part; windows: whole windows before it there; ids: little-endian integers of 16 bits
    if the vocabulary allows, else of 32.
    """
    shared = shipped(docs.sparkSession, tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, seen, windows, end = word_encoder(shared.value), np.zeros(window, np.int64), 0, np.array([END], np.int32)
        kind = "<u2" if e.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<i4"
        for b in batches:
            nth, before, binary = [], [], []
            n = []
            for ids in e.encode([t or b"" for t in raw(b)]):
                size = len(ids) + 1
                nth.append(int(seen[size % window]))
                before.append(windows)
                seen[size % window] += 1
                windows += size // window
                n.append(size)
                binary.append(np.concatenate([ids, end]).astype(kind).tobytes())
            n = np.array(n, np.int64)
            arrays = [column(b, "part"), column(b, "doc_id"), pa.array(n), pa.array((n % window).astype(np.int32)), pa.array(nth, pa.int64()), pa.array(before, pa.int64()), pa.array(binary, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "doc_id", "doc_tokens", "tail", "nth", "windows", "ids"])

    rows = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mapped(rows, run, "part int, doc_id long, doc_tokens long, tail int, nth long, windows long, ids binary")


def packed(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, tier, step, ids of each piece (ids: little-endian 32-bit integers)."""
    spark, window = docs.sparkSession, tiers[0]
    with scratch() as keep:
        rows = keep(written(tokenized(docs, tokenizer, window), "tokenized"))
        # what comes before each part: of each length of tail, and whole windows
        n = rows.groupBy("part", "tail").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("doc_tokens") / window)).alias("w"))
        n = written(n, "tails")
        before = lambda c, by: F.coalesce(F.sum(c).over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        parts = n.groupBy("part").agg(F.sum("w").alias("w")).select("part", before("w", []).alias("window0"))  # a row per part
        starts = keep(written(n.select("part", "tail", before("n", ["tail"]).alias("nth0")).join(parts.hint("merge"), "part"), "starts"))
        histogram = n.groupBy("tail").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).collect()  # a row for each length of tail, `window` at most
    plan = planned({r["tail"]: r["n"] for r in histogram if r["tail"]}, sum(r["w"] for r in histogram), tiers)
    shared = spark.sparkContext.broadcast(plan)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        first = [plan.first(t) for t in range(len(tiers))]
        for b in batches:
            out: list[list] = [[] for _ in range(9)]
            for doc, n, rank, at, ids in zip(*(column(b, c).to_pylist() for c in ("doc_id", "doc_tokens", "rank", "window", "ids"))):
                whole = n // window
                if len(ids) == 2 * n:
                    ids = np.frombuffer(ids, "<u2").astype("<i4").tobytes()
                pieces = [(i * window, window, 0, at + i, 0) for i in range(whole)]
                if n % window:
                    pieces += [(whole * window + s, k, t, rank + shift, offset) for s, k, t, shift, offset in plan.of(n % window, rank)]
                for s, k, t, nth, offset in pieces:
                    for held, x in zip(out, (doc, s, k, n, first[t] + nth, offset, tiers[t], plan.step(t, nth), ids[4 * s : 4 * (s + k)])):
                        held.append(x)
            kinds = [pa.int64()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds)], names)

    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tier", "step", "ids"]
    placed = rows.join(starts.hint("merge"), ["part", "tail"]).select("doc_id", "doc_tokens", (F.col("nth") + F.col("nth0")).alias("rank"), (F.col("windows") + F.col("window0")).alias("window"), "ids")
    return mapped(placed, run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, tier int, step long, ids binary")


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, tier, step, ids, starts: the pieces of packed() put together; starts are their offsets.

    A sequence holds no more ids than its tier's size, so putting it together takes no memory to speak of.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    rows = pieces.groupBy("sequence_id").agg(F.first("tier").alias("tier"), F.first("step").alias("step"), parts.alias("parts"))
    return rows.select("sequence_id", "tier", "step", F.aggregate("parts", F.lit(b""), lambda done, p: F.concat(done, p["ids"])).alias("ids"), F.transform("parts", lambda p: p["offset"]).alias("starts"))


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step")
