"""Line dedup by winnowing: later repeats of passages of lines are deleted.

Lines are compared trimmed of white space; blank lines don't count. A passage is a run of lines of at least `words`
words. A line goes if it stands in a passage that stood before, in order of (doc_id, line), in a place that doesn't
hold the line itself: so where a passage overlaps itself, its first occurrence stays whole.

1. Winnowing. From each line a window takes in lines until it holds `words` words. The place of the least line hash in
   a window is selected, and only selected places are fingerprints. A passage that occurs twice holds a whole window,
   and equal windows have their minimum at the same line, so every repeated passage has a fingerprint in both places.
2. Position join. Fingerprints that occur in one place only are dropped (an aggregate with a map-side part); the
   positions of the others go back to the line hashes of their document.
3. Extension, both ways. Around a matched position the match grows line by line: to the left over the windows that
   have the position as their minimum, and from each of them to the right for as long as its first line is needed to
   hold `words` words; beyond that the window of the next line takes over. Each step is a hash of all lines from one
   end to the other, so a step agrees with another place if every line does. Equal steps are joined with the first of
   them, the nearest end of the match being the last step that agrees. Every line of a repeated passage is in one.
4. Steps that follow each other make the run; the runs' lines are deleted in all but the first place.
A blank line goes with the line before it. Other lines stay as they are, so a clean text is byte for byte the same.

What is shuffled are hashes and positions: a row per selected place, 16 bytes a line of documents that share a
fingerprint, and two rows at most for a line around a matched position; texts only meet their runs. First occurrences
are aggregates with a map-side part; a passage that stands in very many documents is a skewed join, never a group in
one task.

Defined results: null text stays null, with no lines; an empty text is one blank line and stays. A very long text is
read whole; it is one row of line hashes. Rows of one doc_id with equal texts (repeated rows) are the same document
and give equal results. Rows of one doc_id with different texts are different documents, in order of a hash of the
text. Each row with a null doc_id is a document of its own; they come before all others, in order of that hash.
Other columns are ignored (line_deduped) or kept (without_repeats).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, mapped, raw, scratch, unused_name, written
from .shingles import mix

WORDS = 50
_STRIP = b" \t\n\r\x0b\x0c"
_WORD = np.random.default_rng(11).integers(0, 2**63, 2, dtype=np.uint64) | np.uint64(1)
_NONE = -(1 << 63)
#: A document: its id, a hash of its text, and a number of its own if it has no id.
KEY = ["doc", "txt", "nth"]


def line_hashes(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of each line: a 64-bit hash of its trimmed bytes, and its number of words (0: blank)."""
    hashes, counts = np.zeros(len(lines), np.uint64), np.zeros(len(lines), np.int32)
    for i, line in enumerate(lines):
        counts[i] = len(line.split())
        hashes[i] = xxhash.xxh64_intdigest(line.strip(_STRIP))
    return hashes, counts


def winnowed(hashes: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """begin and end (included) of the window of each line that has one, and the place of its least hash.

    Every line has words here. The leftmost place counts where lines are equal.
    """
    total = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    end = np.searchsorted(total, total[:-1] + words) - 1  # the line with which a window is full
    begin = np.flatnonzero(end < len(counts))
    end = end[begin]
    if not len(begin):
        return begin, end, begin
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order) + 1, np.int64)
    rank[order], rank[-1] = np.arange(len(order)), len(order)
    return begin, end, order[np.minimum.reduceat(rank, np.stack([begin, end + 1], 1).ravel())[::2]]


def extended(hashes: np.ndarray, counts: np.ndarray, matched: np.ndarray, words: int) -> tuple[np.ndarray, ...]:
    """first and last line, and a 128-bit hash of all lines between, of each step of a match around matched places.

    The windows that have a matched place as their minimum are the match's steps to the left; each grows to the
    right until the window of the next line is full.
    """
    begin, end, place = winnowed(hashes, counts, words)
    grows = np.maximum(1, np.append(end[1:], len(counts)) - end) if len(end) else end
    hit = np.isin(place, matched)
    begin, end, grows = begin[hit], end[hit], grows[hit]
    step = np.arange(grows.sum()) - np.repeat(np.cumsum(grows) - grows, grows)
    first, last = np.repeat(begin, grows), np.repeat(end, grows) + step
    # polynomial in odd bases, over the lines from first to last; equal lines have equal values
    out = []
    for base in _WORD:
        up, down = _powers(int(base), len(hashes) + 1), _powers(pow(int(base), -1, 1 << 64), len(hashes) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mix(hashes ^ base) * up[:-1])])
        out.append(mix((sums[last + 1] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
    return first, last, out[0], out[1]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def numbered(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with the columns of KEY, under names that it doesn't use, which are given too."""
    names = [unused_name(docs, f"_{k}") for k in KEY]
    own = F.col("doc_id").cast("long")
    docs = docs.withColumn(names[0], F.coalesce(own, F.lit(_NONE))).withColumn(names[1], F.xxhash64("text"))
    known, unknown = docs.where(own.isNotNull()), docs.where(own.isNull())
    zero = F.lit(0).cast("long")
    if not unknown.limit(1).count():
        return docs.withColumn(names[2], zero), names
    # written, because the numbers must be the same each time the rows are read; they tell equal texts apart only
    return known.withColumn(names[2], zero).unionByName(written(unknown.withColumn(names[2], F.monotonically_increasing_id() + 1), "unknown")), names


def _lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))


def line_rows(docs: DataFrame, words: int) -> DataFrame:
    """Of docs (KEY, text) with a window: KEY, at, hashes, counts of the lines that aren't blank; p and fp, places and hashes that are selected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, parts = [], []
            for i, text in enumerate(raw(b)):
                if not text:
                    continue
                hashes, counts = line_hashes(text.split(b"\n"))
                at = np.flatnonzero(counts)
                hashes, counts = hashes[at], counts[at]
                place = np.unique(winnowed(hashes, counts, words)[2])
                if len(place):
                    rows.append(i)
                    parts.append((at.astype(np.int32), hashes.view(np.int64), counts, place.astype(np.int32), hashes[place].view(np.int64)))
            if rows:
                lists = [_lists(np.concatenate([[0], np.cumsum([len(x) for x in xs])]), np.concatenate(xs)) for xs in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*(column(b, k).take(pa.array(rows)) for k in KEY), *lists], [*KEY, "at", "hashes", "counts", "p", "fp"])

    return mapped(docs.select(*KEY, "text"), run, "doc long, txt long, nth long, at array<int>, hashes array<long>, counts array<int>, p array<int>, fp array<long>")


def step_rows(lines: DataFrame, words: int) -> DataFrame:
    """Of line_rows() with `matched` places: KEY, a, b (numbers of the first and last line), w1, w2 of each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*KEY, "a", "b", "w1", "w2"]
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            keys = list(zip(*(column(batch, k).to_pylist() for k in KEY)))
            each = zip(keys, *(column(batch, c) for c in ("at", "hashes", "counts", "matched")))
            for key, *lists in each:
                at, hashes, counts, matched = (x.values.to_numpy() for x in lists)
                first, last, w1, w2 = extended(hashes.view(np.uint64), counts, matched, words)
                for o, x in zip(out, (*(np.full(len(first), k) for k in key), at[first].astype(np.int64), at[last].astype(np.int64), w1.view(np.int64), w2.view(np.int64))):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], names)

    return mapped(lines.select(*KEY, "at", "hashes", "counts", "matched"), run, "doc long, txt long, nth long, a long, b long, w1 long, w2 long")


def deletions(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Of docs (KEY, text): KEY, spans: of documents that repeat a passage, the runs of lines to delete (pairs of first and last line)."""
    lines = written(line_rows(docs, words), "lines")
    marks = lines.select(*KEY, F.explode(F.arrays_zip("p", "fp")).alias("m")).select(*KEY, "m.p", "m.fp")
    place = F.struct(*KEY, "p")
    shared = written(marks.groupBy("fp").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x <> y").select("fp"), "fingerprints")
    matched = marks.join(shared, "fp", "left_semi").groupBy(*KEY).agg(F.collect_set("p").alias("matched"))
    steps = written(step_rows(lines.drop("p", "fp").join(matched, KEY), words), "steps")
    first = steps.groupBy("w1", "w2").agg(F.min(F.struct(*KEY, "a", "b")).alias("f"), F.max(F.struct(*KEY, "a", "b")).alias("l")).where("f <> l")
    first = written(first.select("w1", "w2", "f"), "first")
    same = F.struct(*KEY) == F.struct(*(F.col(f"f.{k}") for k in KEY))
    later = steps.join(first, ["w1", "w2"]).where(~same | (F.col("a") != F.col("f.a")))
    later = later.select(*KEY, F.when(same, F.greatest("a", F.col("f.b") + 1)).otherwise(F.col("a")).alias("a"), "b").where("a <= b")
    return later.groupBy(*KEY).agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"))


def cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """A text without the lines of spans and the blank lines that follow them: text, lines, lines deleted."""
    lines = text.split(b"\n")
    gone = np.zeros(len(lines) + 1, np.int64)
    for a, b in spans:
        gone[a] += 1
        gone[b + 1] -= 1
    out, deleted, dropping = [], 0, False
    for line, hit in zip(lines, np.cumsum(gone)[:-1].tolist()):
        if line.strip(_STRIP):
            dropping = hit > 0
        if dropping:
            deleted += 1
        else:
            out.append(line)
    return b"\n".join(out), len(lines), deleted


def _joined(docs: DataFrame, words: int) -> tuple[DataFrame, str]:
    """docs with its spans (null: none) in one more column, whose name is given too."""
    docs, own = numbered(docs)
    spans = unused_name(docs, "_spans")
    right = [unused_name(docs, f"_{k}_of") for k in KEY]
    with scratch() as keep:
        found = keep(written(deletions(docs.select(*(F.col(o).alias(k) for o, k in zip(own, KEY)), "text"), words), "spans"))
    found = found.select(*(F.col(k).alias(r) for k, r in zip(KEY, right)), F.col("spans").alias(spans))
    # always a merge join: the table of spans grows with the corpus, so the plan is the same at every size
    on = [F.col(o) == F.col(r) for o, r in zip(own, right)]
    return docs.join(found.hint("merge"), on, "left").drop(*own, *right), spans


def line_deduped(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, text (what is left), n_lines, n_deleted per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n, gone = [], [], []
            for t, spans in zip(raw(b), column(b, "_spans").to_pylist()):
                if t is None:
                    left, lines, deleted = None, 0, 0
                elif not spans:
                    left, lines, deleted = t, t.count(b"\n") + 1, 0
                else:
                    left, lines, deleted = cut(t, [(s["a"], s["b"]) for s in spans])
                texts.append(left)
                n.append(lines)
                gone.append(deleted)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(gone, pa.int64())], ["doc_id", "text", "n_lines", "n_deleted"])

    joined, _ = _joined(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), words)
    return mapped(joined.select("doc_id", "text", "_spans"), run, "doc_id long, text string, n_lines long, n_deleted long")


def without_repeats(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with repeated passages deleted; a document of which nothing is left goes."""
    joined, added = _joined(docs, words)
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, keep = [], []
            for t, spans in zip(b.column(at).cast(pa.large_binary()).to_pylist(), column(b, added).to_pylist()):
                left = cut(t, [(s["a"], s["b"]) for s in spans])[0] if t and spans else t
                texts.append(left)
                keep.append(not (spans and not left.strip(_STRIP)))
            arrays = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(arrays, names).filter(pa.array(keep, pa.bool_()))

    return mapped(joined, run, docs.schema)
