"""Approximate nearest neighbours by shifted space-filling curves.

Each curve projects unit vectors on its own orthogonal directions, drawn at random from the covariance of a sample (so
that axes along which the data spread count more), shifts and cuts each coordinate into equal shares of the data, and
orders the vectors by their Hilbert key. One range partition (curve, key) sorts all curves at once; running counts and
one row per partition turn keys into positions. Around a query's position on each curve, a window of neighbours is
compared in single precision; those that come within its rounding error of the k-th best, all of a crowd if need be, are
compared again by cosine in double precision on the original vectors, so near copies that differ in the last digits are
told apart and no candidate of a window is lost. The windows' best are merged and ranked.

The width of the window is fitted, not chosen: for a bounded sample of vectors (`sample`) the
exact neighbours are found by comparing them, in one block, with all vectors. One pass counts how many keys lie below
theirs, which gives their positions without a sort. For each number of curves up to `curves` a window is just wide
enough that `aim` of those neighbours lie inside on some curve; `fit_window` picks one. The share of the data that this
takes follows from the data: near copies need a few positions, featureless noise a large part. Data and queries are dealt
by blocks of positions, so a task holds a block of vectors and the queries of a stretch of `every` blocks that reach it,
whatever the width.

Equal vectors are one point of a curve with the k + 1 least ids (more can't be in a result), so a vector that is
repeated very often is no crowd at a position, and is asked for once.

Defined results: a vector that is null, empty, zero or holds null or non-finite parts takes no part, as query or
as candidate. Vectors of different length aren't compared: each length has curves of its own (lengths are few; each
is a round of jobs). Fewer than k candidates: all of them. An empty table, or one without a query, gives no rows. Ties go to the smaller vec_id. Rows of one vec_id are one
vector; if they differ, the one with the least hash counts. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import by_key, column, mapped, scratch, written
from .embdedup import VALUES, usable


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert keys (n,) of integer points (n, d) with `bits` bits in each coordinate; d * bits is 63 at most."""
    x = cells.T.astype(np.uint64).copy()
    zero = np.uint64(0)
    q = 1 << (bits - 1)
    while q > 1:  # undo the rotation of each level, from the top
        low = np.uint64(q - 1)
        for i in range(len(x)):
            up = (x[i] & np.uint64(q)) != 0
            swap = np.where(up, zero, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(up, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, len(x)):  # Gray code
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint64), 1 << (bits - 1)
    while q > 1:
        turn = np.where((x[-1] & np.uint64(q)) != 0, turn ^ np.uint64(q - 1), turn)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = (key << np.uint64(1)) | ((row >> np.uint64(b)) & np.uint64(1))
    return key


@dataclass
class Curves:
    """Projections and the cuts of their coordinates: a few kilobytes, whatever the size of the data."""

    turn: np.ndarray  # (curves, dim, d)
    cuts: np.ndarray  # (curves, d, 2 ** bits - 1)
    bits: int

    def keys(self, x: np.ndarray) -> np.ndarray:
        """(curves, n) keys of unit vectors."""
        out = np.empty((len(self.turn), len(x)), np.int64)
        for c in range(len(self.turn)):
            y = x @ self.turn[c]
            cells = np.stack([np.searchsorted(self.cuts[c, i], y[:, i]) for i in range(y.shape[1])], 1)
            out[c] = hilbert(cells, self.bits).view(np.int64)
        return out


def fit_curves(sample: np.ndarray, curves: int, d: int, bits: int, seed: int = 1) -> Curves:
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    d = min(d, dim)
    values, axes = np.linalg.eigh(sample.T @ sample / len(sample))
    root = axes * np.sqrt(np.maximum(values, values[-1] * 1e-6))
    turns, cuts = [], []
    for _ in range(curves):
        turn = np.linalg.qr(root @ rng.normal(size=(dim, d)))[0]
        y = np.sort(sample @ turn, axis=0)
        # shares of equal size, shifted by up to half a share: another shift on each curve
        at = (np.arange(1, 1 << bits)[:, None] + rng.uniform(-0.5, 0.5, (1, d))) / (1 << bits)
        turns.append(turn)
        cuts.append(np.stack([np.quantile(y[:, i], at[:, i]) for i in range(d)]))
    return Curves(np.stack(turns), np.stack(cuts), bits)


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def halved(v: np.ndarray) -> np.ndarray:
    """v scaled by a power of 2, which no product can tell, to a greatest component of 0.5 to 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row of x with that of y, in double precision."""
    x, y = halved(x), halved(y)
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def coded(v: np.ndarray, narrow: bool) -> list[bytes]:
    """The bytes of each vector; narrow: in single precision, which is exact for what was read so."""
    return [x.tobytes() for x in v.astype("<f4" if narrow else "<f8")]


def uncoded(codes: list[bytes], narrow: bool) -> np.ndarray:
    return np.frombuffer(b"".join(codes), "<f4" if narrow else "<f8").reshape(len(codes), -1).astype(np.float64)


def nearest(x: np.ndarray, y: np.ndarray, there: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, columns, cosines): of each row of x the k nearest rows of y where `there`, by double precision, and maybe more.

    Products in single precision sort out all but those within their error of the k-th best. Where that leaves many, a
    crowd of near copies, the row is compared with all in double precision.
    """
    ux, uy = unit(x), unit(y)
    s = ux.astype(np.float32) @ uy.astype(np.float32).T
    s[~there] = -np.inf
    if k < s.shape[1]:
        error = 4 * (x.shape[1] + 4) * 2.0**-24  # of two sums of products of unit vectors
        s[s < -np.partition(-s, k - 1, axis=1)[:, k - 1 : k] - error] = -np.inf
    left = np.isfinite(s)
    crowd = left.sum(1) > 4 * k
    row, col = np.nonzero(left & ~crowd[:, None])
    if crowd.any():
        which = np.flatnonzero(crowd)
        again = ux[which] @ uy.T
        again[~left[which]] = -np.inf
        r, c = best_of(again, k)
        row, col = np.concatenate([row, which[r]]), np.concatenate([col, c])
    return row, col, cosines(x[row], y[col])


def points_of(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(points: pid, ids (the k + 1 least vec_ids), v, dim of each distinct vector; ids: vec_id, pid of each id)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(usable("v") & F.col("vec_id").isNotNull()).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    each = rows.groupBy("vec_id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("vec_id", "h.h1", "h.h2")
    each = written(each, "ids")
    # the least ids of a vector in two steps: of each part of its ids first, so that no vector is one task
    order = lambda *by: F.row_number().over(W.partitionBy("h1", "h2", *by).orderBy("vec_id"))
    some = each.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(256))).withColumn("r", order("part")).where(F.col("r") <= k + 1)
    some = written(some.withColumn("r", order()).where(F.col("r") <= k + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "least")
    points = rows.groupBy("h1", "h2").agg(F.first("v").alias("v")).join(some.hint("merge"), ["h1", "h2"])
    points = written(points.select("h1", "h2", F.col("ids")[0].alias("pid"), "ids", "v", F.size("v").alias("dim")), "points")
    return points.select("pid", "ids", "v", "dim"), each.join(points.select("h1", "h2", "pid", "dim").hint("merge"), ["h1", "h2"]).select("vec_id", "pid", "dim")


def matrix(lists: pa.Array) -> np.ndarray:
    """(rows, length) of a column of equally long lists."""
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def positions(points: DataFrame, curves: Curves, narrow: bool) -> DataFrame:
    """curve, pos, pid, code: each point's place on each curve, from 0, and the bytes of its vector."""
    shared = points.sparkSession.sparkContext.broadcast(curves)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = matrix(column(b, "v"))
            codes = pa.array(coded(v, narrow), pa.binary())
            for c, key in enumerate(shared.value.keys(unit(v))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, c, np.int32)), pa.array(key), column(b, "pid"), codes], ["curve", "key", "pid", "code"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "curve"), pa.array(np.arange(n, n + b.num_rows)), *(column(b, c) for c in ("pid", "code", "part"))], ["curve", "nth", "pid", "code", "part"])
            n += b.num_rows

    rows = mapped(points.select("pid", "v"), keyed, "curve int, key long, pid long, code binary")
    order = ["curve", "key", "pid"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("curve", "pid", "code", F.spark_partition_id().alias("part"))
    table = written(mapped(ranged, counted, "curve int, nth long, pid long, code binary, part int"), "curves")
    parts = table.groupBy("part", "curve").agg(F.count("*").alias("n"), F.min("nth").alias("nth0"))  # a row per partition, one more per curve
    before = F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = written(parts.select("part", "curve", (before - F.col("nth0")).alias("offset")), "offsets")
    return table.join(F.broadcast(offsets), ["part", "curve"]).select("curve", (F.col("nth") + F.col("offset")).alias("pos"), "pid", "code")


def best_of(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, columns) of each row's k best finite scores."""
    k = min(k, scores.shape[1])
    at = np.argpartition(-scores, k - 1, axis=1)[:, :k] if k < scores.shape[1] else np.broadcast_to(np.arange(k), (len(scores), k))
    row = np.repeat(np.arange(len(scores)), k)
    good = np.isfinite(scores[row, at.ravel()])
    return row[good], at.ravel()[good]


def exact_neighbours(points: DataFrame, qids: np.ndarray, qx: np.ndarray, k: int) -> dict[int, list[int]]:
    """Each sampled query's k nearest points, by comparing the block of queries with all points."""
    shared = points.sparkSession.sparkContext.broadcast((qids, unit(qx)))  # `sample` vectors at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, x = shared.value
        held_s, held_p = np.full((len(q), k), -np.inf), np.zeros((len(q), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            ids = column(b, "pid").to_numpy()
            s = x @ unit(matrix(column(b, "v"))).T
            s[q[:, None] == ids[None, :]] = -np.inf
            both, pids = np.hstack([held_s, s]), np.hstack([held_p, np.broadcast_to(ids, s.shape)])
            at = np.argpartition(-both, k - 1, axis=1)[:, :k]
            held_s, held_p = np.take_along_axis(both, at, 1), np.take_along_axis(pids, at, 1)
        good = np.isfinite(held_s)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, k)[good.ravel()]), pa.array(held_p[good]), pa.array(held_s[good])], ["q", "pid", "s"])

    found = mapped(points.select("pid", "v"), run, "q long, pid long, s double")
    best = found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("s"), "pid"))).where(F.col("r") <= k)
    out: dict[int, list[int]] = {}
    for r in best.select("q", "pid").collect():  # sample * k rows at most
        out.setdefault(r["q"], []).append(r["pid"])
    return out


def fit_window(points: DataFrame, curves: Curves, near: dict[int, list[int]], n: int, aim: float, whole: bool = False) -> tuple[int, int]:
    """(number of curves, width) with which `aim` of the sampled neighbours lie inside a window; `whole`: of all curves.

    The fewest curves whose windows hold three quarters of the n vectors or fewer, as each curve is one more copy that is
    sorted; if there are none, those whose windows hold the fewest, or a single window if several hold more than all.
    """
    spark = points.sparkSession
    wanted = sorted({p for q, ps in near.items() for p in (q, *ps)})
    ids = spark.createDataFrame([(p,) for p in wanted], "pid long")  # sample * (k + 1) rows at most
    rows = points.select("pid", "v").join(F.broadcast(ids), "pid").toArrow()
    at = {p: i for i, p in enumerate(rows.column("pid").to_pylist())}
    keys = curves.keys(unit(matrix(rows.column("v").combine_chunks())))
    steps = np.sort(np.concatenate([keys, keys + 1], axis=1), axis=1)
    shared = spark.sparkContext.broadcast((curves, steps))

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        curves_, steps_ = shared.value
        total = np.zeros((len(steps_), steps_.shape[1] + 1), np.int64)
        for b in batches:
            if b.num_rows:
                for c, key in enumerate(curves_.keys(unit(matrix(column(b, "v"))))):
                    total[c] += np.bincount(np.searchsorted(steps_[c], key, "right"), minlength=total.shape[1])
        c, step = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32()), pa.array(step, pa.int32()), pa.array(total[c, step])], ["curve", "step", "n"])

    counts = np.zeros((len(steps), steps.shape[1] + 1), np.int64)
    for r in mapped(points.select("v"), below, "curve int, step int, n long").groupBy("curve", "step").agg(F.sum("n").alias("n")).collect():  # 2 * curves * sample * (k + 1) rows
        counts[r["curve"], r["step"]] = r["n"]
    # keys below each one, and those up to it: points of one key lie between, in the order of their ids
    low, high = (np.stack([np.cumsum(counts[c])[np.searchsorted(steps[c], keys[c] + up)] for c in range(len(keys))]) for up in (0, 1))
    pairs = [(at[q], at[p]) for q, ps in near.items() for p in ps]
    if not pairs:
        return (len(keys) if whole else 1), 8
    one, two = (np.array(x) for x in zip(*pairs))
    gaps = np.maximum(high[:, one], high[:, two]) - np.minimum(low[:, one], low[:, two]) - 1
    gaps = np.minimum.accumulate(gaps, axis=0)
    gaps.sort(axis=1)
    width = np.maximum(8, gaps[:, min(len(pairs) - 1, int(aim * len(pairs)))] + 1)
    if whole:
        return len(width), int(min(width[-1], n))
    several = min(4, len(width)) - 1
    held = (np.minimum(2 * width, n) * np.arange(1, len(width) + 1))[several:]
    if held.min() > n:  # one window over everything holds less
        return 1, n
    best = several + int(np.argmax(held <= 0.75 * n) if (held <= 0.75 * n).any() else np.argmin(held))
    return best + 1, int(width[best])


def neighbours(vectors: DataFrame, every: int = 50, k: int = 5, curves: int = 32, d: int = 20, bits: int = 3, sample: int = 400, aim: float = 0.97, block: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the k nearest others found."""
    spark = vectors.sparkSession
    narrow = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
    with scratch() as keep:
        points, ids = points_of(vectors, k)
        asked = keep(written(ids.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("query_id"), F.col("pid").alias("qpid"), "dim"), "asked"))
        out = spark.createDataFrame([], "qpid long, pid long, score double")
        lengths = asked.select("dim").distinct().orderBy("dim").collect()
        for r in lengths:
            own = points.where(F.col("dim") == r["dim"])
            queries = written(asked.where(F.col("dim") == r["dim"]).select("qpid").distinct(), "queries")
            out = out.unionByName(_searched(own, queries, every, k, curves, d, bits, max(8, min(sample, VALUES // (k + 1) // r["dim"])), aim, block, narrow, min(5000, VALUES // r["dim"])))
        # of each point asked for, the ids of the nearest points; then of each id that asks, all but itself
        near = out.join(points.select("pid", "ids").hint("merge"), "pid").select("qpid", "score", F.explode("ids").alias("vec_id"))
        order = lambda by: F.row_number().over(W.partitionBy(by).orderBy(F.desc("score"), "vec_id"))
        near = keep(written(near.withColumn("r", order("qpid")).where(F.col("r") <= k + 1).select("qpid", "vec_id", "score"), "near"))
    ranked = asked.select("query_id", "qpid").join(near.hint("merge"), "qpid").where("vec_id <> query_id").withColumn("rank", order("query_id"))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searched(points: DataFrame, queries: DataFrame, every: int, k: int, curves: int, d: int, bits: int, sample: int, aim: float, block: int, narrow: bool, fitted: int) -> DataFrame:
    """qpid, pid, score: the points found nearest to each point of queries (qpid), itself included; all of one length."""
    n = points.count()
    share = lambda most, salt: F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))
    fit_on = points.where(share(fitted, 21)).select("pid", "v").limit(fitted + 1000).toArrow()
    if not fit_on.num_rows:
        fit_on = points.limit(1).select("pid", "v").toArrow()
    fit_on = fit_on.sort_by("pid")
    lines = fit_curves(unit(matrix(fit_on.column("v").combine_chunks())), curves, d, bits)
    picked = points.where(share(sample, 22)).select("pid", "v").limit(2 * sample).toArrow()
    near = exact_neighbours(points, picked.column("pid").to_numpy(), matrix(picked.column("v").combine_chunks()), k) if picked.num_rows else {}
    used, width = fit_window(points, lines, near, n, aim, n > block) if near else (len(lines.turn), n)
    placed = written(positions(points, Curves(lines.turn[:used], lines.cuts[:used], bits), narrow), "placed")
    # data go to the stretches of queries that reach their block, queries to the blocks they reach
    span = block * every
    seq = lambda a, b: F.explode(F.sequence(a, b))
    at = lambda x, by, last: F.greatest(F.lit(0), F.least(F.lit(last), F.floor(x / by)))
    lastb, lastq = (n - 1) // block, (n - 1) // span
    blk, pos = F.floor(F.col("pos") / block), F.col("pos")
    data = placed.withColumn("blk", blk).withColumn("qb", seq(at(F.col("blk") * block - width, span, lastq), at((F.col("blk") + 1) * block + width, span, lastq)))
    reach = placed.join(queries.withColumnRenamed("qpid", "pid").hint("merge"), "pid").withColumn("qb", F.floor(pos / span)).withColumn("blk", seq(at(pos - width, block, lastb), at(pos + width, block, lastb)))
    columns = ["curve", "blk", "qb", "pos", "pid", "code"]
    tasks = data.select(*columns, F.lit(False).alias("asks")).unionByName(reach.select(*columns, F.lit(True).alias("asks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["curve", "blk", "qb"]):
            asks_ = t.column("asks").to_numpy()
            if asks_.all() or not asks_.any():
                continue
            x, p, ids = uncoded(t.column("code").to_pylist(), narrow), t.column("pos").to_numpy(), t.column("pid").to_numpy()
            y, ypos, yids = x[~asks_], p[~asks_], ids[~asks_]
            for q in np.array_split(np.flatnonzero(asks_), -(-int(asks_.sum()) // 256)):
                row, col, s = nearest(x[q], y, np.abs(p[q][:, None] - ypos[None, :]) <= width, k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q[row]]), pa.array(yids[col]), pa.array(s)], ["qpid", "pid", "score"])

    key = ["curve", "blk", "qb"]
    found = mapped(tasks.repartition(*key).sortWithinPartitions(*key), run, "qpid long, pid long, score double")
    once = found.groupBy("qpid", "pid").agg(F.max("score").alias("score"))
    best = once.withColumn("r", F.row_number().over(W.partitionBy("qpid").orderBy(F.desc("score"), "pid"))).where(F.col("r") <= k + 1)
    return written(best.select("qpid", "pid", "score"), "found")
