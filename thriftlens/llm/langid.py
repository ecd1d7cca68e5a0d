"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its hashed byte 3-grams and 4-grams (subwords; a space stands for
whatever is no letter or digit), followed by a linear softmax, both trained by stochastic gradient descent in numpy.
Because mean and softmax layer are linear, prediction adds up a small table of logits per hashed subword, so
whole texts are read at the speed of a few table look-ups per byte.

Fitting uses a bounded sample of labelled rows: about `per_lang` documents of each language and `most` in all,
picked by a hash of the id (counts are taken over all rows, and every language counts). A sampled text is learned
whole, as its distinct subwords with their numbers. A fifth of the sample fits no weight: it ends the training when
its loss no longer falls, sets the softmax temperature, and calibrates the rejection.

Rejection. A softmax can't tell a text in no known language from one in a known one: it only compares them. So the
table has one column more, how familiar a subword is (the log of its share among the subwords that were learned, at a
floor if it is unseen). A text's mean familiarity is set against that of the held-back documents, as a distance in
standard deviations for a text of its length (a few subwords vary more than many). The cut-off lies between what
held-back documents and pieces of them reach, and what negatives reach: their letters shuffled, random letters, hex
digits, and pieces in each language judged by the subwords of the other languages only. A rejected text's score falls
with the distance below the cut-off.

Defined results: null text, or text without any letter: `und`, score 0, rejected. No labelled row at all:
everything is `und`. A very long text is read whole, in slices. Repeated rows give repeated rows, and count once when
learned; of an id with several texts one is learned, the same in any order of rows. Rows without an id teach nothing.
Columns other than id, text and lang are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import column, give_back, in_groups, mapped, raw, scratch, written

BITS = 16
DIM = 16
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
#: ASCII letters in lower case, digits as one, other ASCII as a space, the bytes of other characters as they are.
_FOLD = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 48 if chr(b).isdigit() else 32 for b in range(256))


def gram_ids(text: bytes) -> np.ndarray:
    """Hashed 3-grams and 4-grams of a text's bytes; half of the table is for each order."""
    b = np.frombuffer(b" " + text.translate(_FOLD) + b"  ", np.uint8).astype(np.uint32)
    three = b[:-3] | (b[1:-2] << 8) | (b[2:-1] << 16)
    four = three | (b[3:] << 24)
    three = (three * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)
    four = ((four ^ (four >> np.uint32(15))) * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
    return np.concatenate([three, four + np.uint32(1 << BITS)])


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # (2 << BITS, languages + 1): logits of each hashed subword, and its familiarity
    bias: np.ndarray
    temperature: float
    usual: float  # mean familiarity of a text in a known language
    spread: tuple[float, float]  # its variance in long texts, and that of a single subword
    cut: float  # texts more standard deviations below the usual than this are rejected

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities, and how far each text is above the cut-off; texts are whole, in slices that bound memory."""
        sums, n = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts))
        for i, t in enumerate(texts):
            for begin in range(0, max(1, len(t)), 1 << 20):
                ids = gram_ids(t[begin : begin + (1 << 20)])
                sums[i] += self.table.take(ids, axis=0).sum(0, dtype=np.float64)
                n[i] += len(ids)
        sums /= n[:, None]
        return softmax((sums[:, :-1] + self.bias) / self.temperature), self.distance(sums[:, -1], n) - self.cut

    def distance(self, familiarity: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (familiarity - self.usual) / np.sqrt(self.spread[0] + self.spread[1] / n)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def has_letter(text: bytes) -> bool:
    return bool(_LETTER.search(text.decode("utf-8", "replace")))


@dataclass
class Sample:
    """One text that is learned: its distinct subwords, their numbers, its language and a piece of it."""

    ids: np.ndarray
    n: np.ndarray
    lang: str
    piece: bytes


def sampled(text: bytes, lang: str, rng: np.random.Generator) -> Sample:
    ids, n = np.unique(gram_ids(text), return_counts=True)
    words = text.split()
    at = int(rng.integers(0, max(1, len(words) - 8)))
    return Sample(ids.astype(np.int32), n.astype(np.int32), lang, b" ".join(words[at : at + int(rng.integers(1, 13))])[:200])


def familiarity(mass: np.ndarray) -> np.ndarray:
    """Log shares of the subwords of each order, from their weights in the sample; unseen ones are at a floor."""
    halves = mass.reshape(2, -1)
    return np.log(halves / np.maximum(halves.sum(1, keepdims=True), 1e-9) + 1e-7).ravel().astype(np.float32)


def train(rows: list[Sample], seed: int = 7, epochs: int = 6, rate: float = 3.0, size: int = 16) -> Model:
    """SGD on mini-batches until the loss of the held-back fifth falls by less than a hundredth, twice at least and `epochs` times at most."""
    langs = sorted({r.lang for r in rows})
    y = np.array([langs.index(r.lang) for r in rows])
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    check = held if len(held) else fit
    emb = rng.normal(0, 0.3, (2 << BITS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps, step, before = epochs * -(-len(fit) // size), 0, np.inf
    for epoch in range(epochs):
        for begin in range(0, len(fit), size):
            part = fit[begin : begin + size]
            lengths = np.array([len(rows[r].ids) for r in part])
            ids, n = np.concatenate([rows[r].ids for r in part]), np.concatenate([rows[r].n for r in part]).astype(np.float32)
            starts, owner = np.cumsum(lengths) - lengths, np.repeat(np.arange(len(part)), lengths)
            share = n / np.add.reduceat(n, starts)[owner]
            x = np.add.reduceat(emb[ids] * share[:, None], starts)
            p = softmax((x @ out + bias).astype(np.float64)).astype(np.float32)
            p[np.arange(len(part)), y[part]] -= 1
            lr = np.float32(rate * (1 - step / steps))
            back = p @ out.T
            out -= lr * x.T @ p / len(part)
            bias -= lr * p.mean(0) * 0.1
            # subwords that several texts have are added up first, so that each row of emb is written once
            once = np.argsort(ids, kind="stable")
            first = np.flatnonzero(np.diff(ids[once], prepend=-1))
            emb[ids[once[first]]] -= lr * np.add.reduceat((share[:, None] * back[owner])[once], first)
            step += 1
        table = (emb @ out).astype(np.float32)
        z = _means(table, [rows[r] for r in check]) + bias
        loss = -np.log(np.maximum(softmax(z)[np.arange(len(check)), y[check]], 1e-12)).mean()
        if epoch and loss > before * 0.99:
            break
        before, fit = loss, rng.permutation(fit)
    mass = np.zeros((len(langs), 2 << BITS))
    for r in fit:
        mass[y[r], rows[r].ids] += rows[r].n / rows[r].n.sum()
    known = familiarity(mass.sum(0))
    model = Model(langs, np.column_stack([table, known]), bias.astype(np.float64), _temperature(z, y[check]), 0.0, (1.0, 1.0), -np.inf)
    _calibrate(model, [rows[r] for r in check], mass, rng)
    return model


def _means(table: np.ndarray, rows: list[Sample]) -> np.ndarray:
    return np.stack([np.average(table[r.ids], axis=0, weights=r.n) for r in rows])


def _temperature(z: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least loss. Texts that are all told apart would ask for 0; as they are few, each may be wrong by 1 in their number."""
    grid, off = np.geomspace(1e-4, 100, 240), 1 / (len(y) + 2)
    target = np.full(z.shape, off / max(1, z.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - off
    loss = [-(target * np.log(np.maximum(softmax(z / t), 1e-300))).sum(1).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def negatives(pieces: list[bytes], rng: np.random.Generator) -> list[bytes]:
    """Texts in no language, as long as the pieces: their bytes shuffled, random letters, hex digits."""
    out = []
    for p in pieces:
        shuffled = bytearray(p)
        rng.shuffle(shuffled)
        letters = rng.integers(97, 123, len(p)).astype(np.uint8)
        letters[rng.random(len(p)) < 0.15] = 32
        hexed = rng.integers(0, 256, len(p) // 2 + 1).astype(np.uint8).tobytes().hex()
        out += [bytes(shuffled), letters.tobytes(), hexed.encode()]
    return out


def _calibrate(model: Model, rows: list[Sample], mass: np.ndarray, rng: np.random.Generator) -> None:
    known = model.table[:, -1]
    size = np.array([r.n.sum() for r in rows], float)
    whole = _means(known[:, None], rows)[:, 0]
    # short pieces and whole texts share one line: variance = that of long texts + that of a subword / subwords
    pieces = [r.piece for r in rows if len(r.piece) >= 8]
    grams = [gram_ids(p) for p in pieces]
    n = np.array([len(g) for g in grams], float)
    short = np.array([known[g].mean() for g in grams])
    model.usual = float(np.average(whole, weights=np.sqrt(size)))
    long = size >= np.median(size)
    model.spread = (float(max(1e-3, np.mean((whole[long] - model.usual) ** 2))), float(max(1e-3, np.mean((short - model.usual) ** 2 * n))) if len(n) else 1.0)
    no = [gram_ids(t) for t in negatives(pieces + [b" ".join(pieces[i : i + 8]) for i in range(0, len(pieces), 8)], rng)]
    other = [familiarity(mass.sum(0) - m) for m in mass] if len(mass) > 1 else []
    where = [model.langs.index(r.lang) for r in rows if len(r.piece) >= 8]
    m = [known[g].mean() for g in no] + [other[k][g].mean() for g, k in zip(grams, where) if other]
    k = [len(g) for g in no] + [len(g) for g in grams if other]
    yes = np.sort(model.distance(whole, size))
    parts = np.sort(model.distance(short, n)) if len(n) else yes
    high = min(-4.0, yes[int(0.001 * len(yes))], parts[int(0.005 * len(parts))])
    low = np.quantile(model.distance(np.array(m), np.array(k, float)), 0.99) if m else high
    model.cut = float((low + high) / 2 if low < high else high)


def fit(docs: DataFrame, learn, per_lang: int = 1500, most: int = 15_000, seed: int = 7, subwords: int = 1 << 24) -> Model | None:
    """Fit on rows of docs where `learn` (a Column) holds and lang isn't null; None if there are none.

    per_lang bounds the labelled rows of each language, and most those of all together, in equal parts. subwords bounds
    the sum of the texts' different subwords (8 bytes each on the driver): where texts are so long that they hold more,
    fewer are learned, of each language in turn, each of them whole.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not counts:
        return None
    each = max(1, min(per_lang, most // len(counts)))
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(int((1 << 30) * min(1.0, each / n))))])
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 30)) < share[F.col("lang")])

    def of_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple] = set()
        for b in batches:
            out: list[tuple] = []
            for key, text, lang in zip(column(b, "doc_id").to_pylist(), raw(b), column(b, "lang").to_pylist()):
                if (key, lang, h := xxhash.xxh64_intdigest(text)) in seen or not has_letter(text):
                    continue
                seen.add((key, lang, h))
                s = sampled(text, lang, np.random.default_rng([abs(key), seed]))
                out.append((key, h & 0x7FFFFFFFFFFFFFFF, s.ids.tobytes(), s.n.tobytes(), lang, s.piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [()] * 6, _SAMPLE.types)], schema=_SAMPLE)

    found = mapped(picked, of_each, "doc_id long, h long, ids binary, n binary, lang string, piece binary")
    # one text of an id, whatever the order of rows
    each_id = found.groupBy("doc_id").agg(F.min(F.struct("h", "lang", "ids", "n", "piece")).alias("s")).select("doc_id", "s.*")
    with scratch():
        drawn = written(each_id, "sample")
        turn = drawn.select("doc_id", "lang", F.length("ids").alias("size"), F.row_number().over(W.partitionBy("lang").orderBy("h", "doc_id")).alias("turn"))
        upto = turn.withColumn("upto", F.sum("size").over(W.orderBy("turn", "lang").rowsBetween(W.unboundedPreceding, 0)))  # numbers of the drawn rows alone
        kept = upto.where(F.col("upto") <= 4 * subwords).select("doc_id")
        one = drawn.join(kept.hint("merge"), "doc_id", "left_semi").toArrow()
    if not one.num_rows:
        return None
    try:
        return train(_samples(one), seed)
    finally:
        del one
        give_back()  # the driver has much more to do after this


def _samples(one: pa.Table) -> list[Sample]:
    """The rows of _SAMPLE in the order of doc_id; numbers are views of the table's own memory, and nothing is copied."""
    rows = []
    for b in one.to_batches():
        numbers = [_numbers(column(b, c)) for c in ("ids", "n")]
        rows += zip(column(b, "doc_id").to_pylist(), *numbers, column(b, "lang").to_pylist(), column(b, "piece").to_pylist())
    return [Sample(*r[1:]) for r in sorted(rows, key=lambda r: r[0])]


def _numbers(values: pa.Array) -> list[np.ndarray]:
    """Each binary value as a view of 32-bit numbers."""
    values = values.cast(pa.large_binary())
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    flat = np.frombuffer(data or b"", np.int32)[at[0] // 4 : at[-1] // 4]
    return np.split(flat, (at[1:-1] - at[0]) // 4)


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("ids", pa.binary()), ("n", pa.binary()), ("lang", pa.string()), ("piece", pa.binary())])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """One row per row of docs: doc_id, lang_pred, score, accepted. Only the text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # (2 << BITS) x (languages + 1) floats: 0.5 MB a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = raw(b)
            pred, score, good = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if t and has_letter(t)] if m else []
            for begin, end in in_groups([len(texts[i]) for i in known], 4 << 20):
                at = known[begin:end]
                for i, row, above in zip(at, *m.scores([texts[i] for i in at])):
                    k = int(row.argmax())
                    pred[i], score[i], good[i] = m.langs[k], min(1.0, float(row[k])) * np.exp(min(0.0, above)), above >= 0
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(pred, pa.string()), pa.array(score), pa.array(good)], ["doc_id", "lang_pred", "score", "accepted"])

    return mapped(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, lang_pred string, score double, accepted boolean")


def held_out():
    """Documents that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, per_lang: int = 1500) -> DataFrame:
    """Fit on what may be learned from, then predict every document."""
    predicted = predict(docs, fit(docs, ~held_out(), per_lang))
    return predicted.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "accepted")


def accepted_only(docs: DataFrame, per_lang: int = 1500) -> DataFrame:
    """The documents whose language is known; the row itself carries the decision, so nothing is joined."""
    model = fit(docs, ~held_out(), per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = b.column(at).cast(pa.large_binary()).to_pylist()
            keep = []
            for t in texts:
                ok = bool(m and t and has_letter(t))
                keep.append(ok and bool(m.scores([t])[1][0] >= 0))
            yield b.filter(pa.array(keep, pa.bool_()))

    return mapped(docs, run, docs.schema)
