"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative per group.

Vectors of one label are spread over cells by their nearest centroid. With unit vectors and a threshold t, let
e = sqrt(2 - 2t) be the greatest distance of a linked pair x, y with home centroids a and b. Then
(x.a - x.b) + (y.b - y.a) = (x - y).(a - b) <= e |a - b|, and both terms are at least 0, so one of them is at
most e |a - b| / 2. A vector therefore visits every cell whose centroid it misses by no more than that, and each
linked pair meets in the home cell of one of the two: no link is lost at a cell's border. Centroids closer than e to
another are left out, so a crowd of near vectors is one cell, and not many that all of its vectors visit.

Equal vectors of a label are one class first (an aggregate with a map-side part), so thousands of copies cost
one row. A cell's rows are dealt into blocks of `rows` rows or `block_values` numbers; each pair of blocks is one cosine
product in double precision, worked off in slabs, which gives counts and stars of linked vectors, never pairs: what a
slab links already is left out of the next one's links. So a cell of any size is compared whole, with memory bounded
by two blocks. As links are counted, every pair of a crowd of near vectors is compared; its rows are sent once for each
block of their cell. Centroids are fitted on a bounded sample (`sample` vectors, VALUES numbers in all) and are at most
`most_cells` and VALUES numbers, which bounds what is broadcast; beyond that cells grow and have more blocks, and a label without cells of
its own is one cell. Either way all pairs are compared.

Defined results: a vector that is null, empty, zero or holds null or non-finite parts, and one without a label,
links with nothing: n_links 0, component_id its own id, kept. Vectors of different length don't link. Each
row is a vector of its own, so repeated rows link, and so may rows of one vec_id with several vectors. Null vec_id: component_id null, not kept. An empty table gives
no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, column, components, least_reached, mapped, scratch, written


def usable(v: str = "embedding"):
    """Whether a vector can be compared: no null, no non-finite part, not zero."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(v).isNotNull() & ok & F.exists(v, lambda x: x != 0), F.lit(False))


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, ok, lab, h1, h2; classes: cid, least (vec_id), m, lab, h1, h2, dim, v) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("lab"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.withColumn("ok", usable("v") & F.col("lab").isNotNull() & F.col("vec_id").isNotNull())
    rows = rows.withColumn("h1", F.xxhash64("lab", "v")).withColumn("h2", F.xxhash64(F.lit(1), "v", "lab"))
    ok = rows.where("ok").groupBy("lab", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("m"), F.first("v").alias("v"))
    classes = written(ok.withColumn("dim", F.size("v")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    return rows.select("vec_id", "ok", "h1", "h2"), classes


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """k unit centroids of unit vectors, by cosine."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1)
        c = np.where(norm[:, None] > 1e-12, total / np.maximum(norm, 1e-12)[:, None], c)
    return c


def spaced(c: np.ndarray, least: float) -> np.ndarray:
    """Centroids that are `least` apart or more: between closer ones nearly all vectors of one would visit the other."""
    kept, n = np.empty_like(c), 1
    kept[0] = c[0]
    for x in c[1:]:
        if 2 - 2 * (kept[:n] @ x).max() >= least * least:  # the squared distance of unit vectors
            kept[n] = x
            n += 1
    return kept[:n]


#: Numbers that the sample of vectors holds at most, and the centroids (32 MB each), whatever the vectors' length.
VALUES = 1 << 22


def fit_cells(classes: DataFrame, threshold: float, cell: int, sample: int, most_cells: int, seed: int = 3) -> dict[tuple[str, int], np.ndarray]:
    """Centroids of each (label, length) with more than `cell` classes; labels beyond most_cells / 2 have one cell.

    What comes to the driver is bounded by bytes: `sample` vectors and VALUES numbers.
    """
    sizes = classes.groupBy("lab", "dim").count().where(F.col("count") > cell).orderBy(F.desc("count"), "lab", "dim").limit(most_cells // 2).collect()
    if not sizes:
        return {}
    total, values = sum(r["count"] for r in sizes), sum(r["count"] * r["dim"] for r in sizes)
    most_cells = max(2, min(most_cells, VALUES // max(r["dim"] for r in sizes)))
    part = classes.where(F.pmod(F.xxhash64("cid", F.lit(5)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / total, VALUES / values)))
    names = F.create_map(*[x for r in sizes for x in (F.lit(f"{r['dim']} {r['lab']}"), F.lit(1))])
    picked = part.where(names[F.concat_ws(" ", "dim", "lab")].isNotNull()).select("lab", "dim", "cid", "v").toArrow().sort_by("cid")
    rng, out = np.random.default_rng(seed), {}
    groups: dict[tuple[str, int], list[int]] = {}
    for i, key in enumerate(zip(picked.column("lab").to_pylist(), picked.column("dim").to_pylist())):
        groups.setdefault(key, []).append(i)
    per_cell = max(float(cell), total / most_cells * 2)
    for r in sizes:
        at = groups.get((r["lab"], r["dim"]), [])
        k = min(len(at), max(1, round(r["count"] / per_cell)))
        if k > 1:
            x = picked.column("v").take(pa.array(at)).combine_chunks().flatten().to_numpy().reshape(len(at), -1).copy()
            x /= np.abs(x).max(1, keepdims=True)
            out[r["lab"], r["dim"]] = spaced(kmeans(x / np.linalg.norm(x, axis=1)[:, None], k, rng), np.sqrt(2 - 2 * threshold))
    return out


def dealt(classes: DataFrame, cells: dict[tuple[str, int], np.ndarray], threshold: float) -> DataFrame:
    """cid, m, lab, dim, cell, own, visits, x (unit vector): a row for each cell that a class is at home in or visits."""
    half = np.sqrt(2 - 2 * threshold) / 2 + 1e-9
    shared = classes.sparkSession.sparkContext.broadcast(cells)  # at most most_cells centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(column(b, "lab").to_pylist(), column(b, "dim").to_pylist())):
                groups.setdefault(key, []).append(i)
            for key, at in groups.items():
                for begin in range(0, len(at), 512):
                    yield _placed(b.take(pa.array(at[begin : begin + 512])), shared.value.get(key), half)

    return mapped(classes.select("cid", "m", "lab", "dim", "v"), run, "cid long, m long, lab string, dim int, cell int, own int, visits array<int>, x binary")


def _placed(b: pa.RecordBatch, c: np.ndarray | None, half: float) -> pa.RecordBatch:
    """Rows of one label and length, once for each cell; c: its centroids."""
    n = b.num_rows
    x = column(b, "v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    x = x / np.abs(x).max(1, keepdims=True)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    if c is None:
        row, cell, own = np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    else:
        s = x @ c.T
        own = s.argmax(1)
        homes, at = np.unique(own, return_inverse=True)
        gaps = np.sqrt(np.maximum(0, 2 - 2 * c[homes] @ c.T))
        row, cell = np.nonzero(s[np.arange(n), own][:, None] - s <= half * gaps[at])
    many = np.bincount(row, minlength=n)
    ends = np.concatenate([[0], np.cumsum(np.repeat(many, many))]).astype(np.int32)
    visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.tile(v, len(v)) for v in np.split(cell, np.cumsum(many)[:-1])]), pa.int32()))
    take = pa.array(row)
    wide = pa.array([v.tobytes() for v in x], pa.binary())
    return pa.RecordBatch.from_arrays([*(column(b, k).take(take) for k in ("cid", "m", "lab", "dim")), pa.array(cell, pa.int32()), pa.array(own[row], pa.int32()), visits, wide.take(take)], schema=_DEALT)


_DEALT = pa.schema([("cid", pa.int64()), ("m", pa.int64()), ("lab", pa.string()), ("dim", pa.int32()), ("cell", pa.int32()), ("own", pa.int32()), ("visits", pa.list_(pa.int32())), ("x", pa.binary())])


def compare(t: pa.Table, cell: int, crossed: bool, threshold: float, step: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, link counts (copies counted) of a task's rows, and the row that stands for each one's component. crossed: only pairs of both sides count."""
    ids, m = t.column("cid").to_numpy(), t.column("m").to_numpy()
    own, side = t.column("own").to_numpy(), t.column("side").to_numpy()
    x = np.frombuffer(b"".join(t.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
    home = own == cell
    homes, place = np.unique(own, return_inverse=True)
    visits = t.column("visits").combine_chunks()
    seen = np.zeros((len(ids), len(homes)), bool)  # whether a row visits the home of another
    flat, at = visits.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(visits.offsets.to_numpy()))
    where = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
    hit = homes[where] == flat
    seen[at[hit], where[hit]] = True
    left, right = (np.flatnonzero(side == 0), np.flatnonzero(side == 1)) if crossed else (np.arange(len(ids)), np.arange(len(ids)))
    count, label, weight = np.zeros(len(ids)), np.arange(len(ids)), m.astype(np.float64)
    xr, home_r = x[right], home[right]
    lesser = cell < own
    for begin in range(0, len(left), step):
        rows = left[begin : begin + step]
        near = x[rows] @ xr.T >= threshold
        if not crossed:
            near &= rows[:, None] < right[None, :]
        # a pair is this cell's if one is at home here, and, where both meet in two cells, in the lesser of them
        here, there = home[rows][:, None], home_r[None, :]
        mine = here & there
        mine |= here & ~there & (~seen[rows][:, place[right]] | lesser[right][None, :])
        mine |= ~here & there & (~seen[right][:, place[rows]].T | lesser[rows][:, None])
        near &= mine
        if not near.any():
            continue
        # numbers of copies stay below 2 ** 53, so these sums are exact
        count[rows] += near @ weight[right]
        count[right] += weight[rows] @ near
        # each row's first link, then those that still join two components
        i = np.flatnonzero(near.any(1))
        label = _joined(label, rows[i], right[near[i].argmax(1)])
        i, j = np.nonzero(near & (label[rows][:, None] != label[right][None, :]))
        if len(i):
            label = _joined(label, rows[i], right[j])
    return ids, count.astype(np.int64), label


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of components after links a, b."""
    nodes, least = least_reached(label[a], label[b])
    to = np.arange(len(label))
    to[nodes] = least
    return to[label]


def linked(classes: DataFrame, threshold: float, cell: int, sample: int, most_cells: int, block_values: int, block_rows: int) -> DataFrame:
    """kind, a, b: link counts b of class a (kind 0) and links between classes a and b (kind 1)."""
    cells = fit_cells(classes, threshold, cell, sample, most_cells)
    rows = written(dealt(classes, cells, threshold), "dealt")
    most = F.least(F.lit(float(block_rows)), F.greatest(F.lit(1.0), block_values / F.col("dim")))
    blocks = written(rows.groupBy("lab", "dim", "cell").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")), "blocks")
    tasks = rows.join(blocks.hint("merge"), ["lab", "dim", "cell"]).withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("cid", "m", "own", "visits", "x", "lab", "dim", "cell", F.least("blk", "other").alias("p"), F.greatest("blk", "other").alias("q"), F.when(F.col("blk") > F.col("other"), 1).otherwise(0).alias("side"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["lab", "dim", "cell", "p", "q"]):
            cell, p, q = (t.column(c)[0].as_py() for c in ("cell", "p", "q"))
            ids, count, label = compare(t, cell, p != q, threshold)
            some, more = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(ids)))
            a, b = np.concatenate([ids[some], ids[more]]), np.concatenate([count[some], ids[label[more]]])
            kind = np.repeat(np.array([0, 1], np.int32), [len(some), len(more)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(a), pa.array(b)], ["kind", "a", "b"])

    key = ["lab", "dim", "cell", "p", "q"]
    return written(mapped(tasks.repartition(*key).sortWithinPartitions(*key), run, "kind int, a long, b long"), "linked")


def near_vectors(vectors: DataFrame, threshold: float = 0.93, cell: int = 2048, sample: int = 20_000, most_cells: int = 8192, block_values: int = 1 << 19, block_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors."""
    with scratch() as keep:
        rows, classes = classes_of(vectors)
        found = linked(classes, threshold, cell, sample, most_cells, block_values, block_rows)
        counts = found.where("kind = 0").groupBy("a").agg(F.sum("b").alias("links"))
        groups = components(found.where("kind = 1").select("a", "b"))
        out = classes.select("h1", "h2", "least", "cid", "m").join(counts.withColumnRenamed("a", "cid").hint("merge"), "cid", "left").join(groups.withColumnRenamed("node", "cid").hint("merge"), "cid", "left")
        out = keep(written(out.select("h1", "h2", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "least", F.coalesce("comp", "cid").alias("grp")), "linkcounts"))
        least = keep(written(out.groupBy("grp").agg(F.min("least").alias("comp")), "least"))
    out = out.drop("least").join(least.hint("merge"), "grp")
    all_rows = rows.join(out.hint("merge"), ["h1", "h2"], "left")
    comp = F.when(F.col("ok"), F.col("comp")).otherwise(F.col("vec_id"))
    return all_rows.select("vec_id", F.when(F.col("ok"), F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(comp == F.col("vec_id"), F.lit(False)).alias("kept"))
