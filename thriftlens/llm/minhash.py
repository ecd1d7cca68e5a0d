"""Near-duplicate texts by MinHash with tensored banding, confirmed on full shingle sets.

A band of 2r minhashes is made of two halves: m half-bands of r hashes are drawn twice (collections A and B),
and the key of table (i, j) pairs half-band A_i with half-band B_j. So m * m tables cost 2 * m * r hash
functions instead of m * m * 2 * r. r, m and the minhashes that must agree follow from the threshold: a pair just
at it shares no table with probability 0.001 at most, and fails the agreement with 0.0002 at most. At 0.85, r = 3
and m = 8: 64 tables from 48 functions, 31 must agree, 0.00098 and 0.00011 (a pair of 0.9: 0.00006 without a
table). At 0.8, r = 3 and m = 11: 121 tables from 66 functions, 40 must agree, 0.00075 and 0.00008.

Plan. Texts become small signature rows (one pass, no text is shuffled). Equal sets collapse into one class
by a 128-bit fingerprint. Each class sends m * m keys; a bucket is reduced to one representative by an aggregate
with a map-side part, and joined back (a large bucket is an ordinary skewed join), so a bucket gives as many
rows as it has members, never pairs. Representatives are drawn at random in each table, and a candidate link
must agree on `agree` minhashes. Where members of a bucket are then in different families, all that aren't in its
largest one are compared with every member by their sketches, in blocks of `sketches`, so that two near copies in a
bucket are linked whatever its representative is.

Connected candidates form families, and links inside a family are confirmed on full sets: sorted 64-bit shingles,
never texts, in blocks of `block` sets or `most` shingles. Each block is compared whole, together with about `pivots`
sets drawn from all of its family: near copies of one text link to the pivots, and so to each other, so a large
family is connected by sending each set once and the pivots to each block. What the pivots leave outside of a family's
largest part is compared with every member of it, in blocks of twice the size. The bytes that are sent are proportional to a family,
and beyond that to its size times the number of blocks that stay outside. A comparison gives stars, never pairs.

Defined results: null or wordless text: empty set, linked with nothing, component_id its own id. A very long text is
one set of shingles, whole. Repeated rows of one doc_id repeat the result. One doc_id with several texts: each is a
document of its own with that id, whatever the order of rows; where they are linked they are one component. Null
doc_id: compared with nothing, component_id null, kept false. Ties can't occur: a component's id is its least doc_id.
Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, column, components, dropped, in_groups, least_reached, mapped, raw, scratch, unused_name, written
from .shingles import mix, shingle_set, shingles, word_runs


def half_bands(t: float, r: int) -> int:
    """The least m, 8 at least, with which a pair of similarity t shares none of m * m tables with probability 0.001 at most."""
    return next(m for m in range(8, 1 << 16) if t >= 1 or 1 - (1 - (1 - t**r) ** m) ** 2 <= 0.001)


def least_agreement(t: float, hashes: int) -> int:
    """The most minhashes of which a pair of similarity t agrees on fewer with probability 0.0002 at most; 1 at least."""
    below, k = 0.0, 0
    while k < hashes and (below := below + math.comb(hashes, k) * t**k * (1 - t) ** (hashes - k)) <= 0.0002:
        k += 1
    return max(1, k)


class Plan:
    """Shape of the tables: r hashes in a half-band, m half-bands in each of two collections."""

    def __init__(self, words: int = 5, num: int = 4, den: int = 5, r: int | None = None, m: int | None = None, agree: int | None = None, block: int = 224, most: int = 1 << 20, pivots: int = 48, sketches: int = 512):
        if r is None:
            r = next((x for x in (3, 2) if half_bands(num / den, x) <= 12), 1)
        m = m or half_bands(num / den, r)
        self.hashes = 2 * r * m
        agree = agree or least_agreement(num / den, self.hashes)
        self.words, self.num, self.den, self.r, self.m, self.agree, self.block = words, num, den, r, m, agree, block
        self.most, self.pivots, self.sketches = most, pivots, sketches
        rng = np.random.default_rng(5)
        self.xor = rng.integers(0, 2**32, self.hashes, dtype=np.uint32)
        self.mul = rng.integers(0, 2**32, self.hashes, dtype=np.uint32) | np.uint32(1)
        self.fold = rng.integers(0, 2**63, r, dtype=np.uint64) | np.uint64(1)


def _minima(sets: np.ndarray, begins: np.ndarray, plan: Plan) -> np.ndarray:
    """(hashes, documents): the least value of each hash function over each non-empty set."""
    x = (sets >> np.uint64(32)).astype(np.uint32)
    out = np.empty((plan.hashes, len(begins)), np.uint32)
    h = np.empty_like(x)
    for i in range(plan.hashes):
        np.bitwise_xor(x, plan.xor[i], out=h)
        h *= plan.mul[i]
        h ^= h >> np.uint32(15)
        out[i] = np.minimum.reduceat(h, begins)
    return out


def signatures(docs: DataFrame, plan: Plan) -> DataFrame:
    """doc_id, t (a hash of the text), n_shingles, f1 and f2 (fingerprint of the set), halves (2m half-bands), sketch (a byte of each minhash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.lower() if t else b"" for t in raw(b)]
            n = np.zeros(len(texts), np.int64)
            f = np.zeros((2, len(texts)), np.uint64)
            halves = np.zeros((len(texts), 2 * plan.m), np.uint64)
            sketch = np.zeros((len(texts), plan.hashes), np.uint8)
            for begin, end in in_groups([len(t) for t in texts], 1 << 20):
                sets = [shingles(w, plan.words) for w in word_runs(texts[begin:end])]
                sizes = np.array([len(s) for s in sets])
                n[begin:end] = sizes
                at = np.flatnonzero(sizes)
                if not len(at):
                    continue
                flat = np.concatenate([sets[i] for i in at])
                begins = np.cumsum(sizes[at]) - sizes[at]
                f[:, begin + at] = fingerprints(flat, begins)
                low = _minima(flat, begins, plan)
                for k in range(2 * plan.m):
                    part = low[k * plan.r : (k + 1) * plan.r].astype(np.uint64)
                    halves[begin + at, k] = mix((part * plan.fold[:, None]).sum(0, dtype=np.uint64))
                sketch[begin + at] = (low & np.uint32(255)).T.astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [
                    column(b, "doc_id"), column(b, "t"), pa.array(n), pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * 2 * plan.m), pa.array(halves.view(np.int64).ravel())),
                    pa.array([s.tobytes() for s in sketch], pa.binary()),
                ],
                ["doc_id", "t", "n_shingles", "f1", "f2", "halves", "sketch"],
            )

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text"), run, "doc_id long, t long, n_shingles long, f1 long, f2 long, halves array<long>, sketch binary")


def fingerprints(flat: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """(2, sets): a 128-bit fingerprint of each set, whose shingles are end to end."""
    return np.stack([np.add.reduceat(flat, begins), np.add.reduceat(mix(flat ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)])


#: Keys that a task makes, unless there are more than MOST_PARTS tasks' worth; it then spills.
KEYS, MOST_PARTS = 1_000_000, 20_000


def candidate_links(classes: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) that connect all classes that share a bucket and agree on enough minhashes."""
    m = plan.m
    # a class has m * m keys, nearly all of them its own: so many classes to a task that its table of keys stays small
    parts = min(MOST_PARTS, -(-classes.count() * m * m // KEYS))
    keyed = (
        classes.select("cid", "halves").repartition(max(1, parts), "cid").select("cid", F.posexplode(F.slice("halves", 1, m)).alias("i", "x"), F.slice("halves", m + 1, m).alias("rest"))
        .select("cid", "i", "x", F.posexplode("rest").alias("j", "y"))
        .select("cid", F.xxhash64("x", "y", "i", "j").alias("key"))
    )
    buckets = written(keyed.groupBy("key").agg(F.expr("min_by(cid, xxhash64(cid, key))").alias("rep"), F.count("*").alias("n")).where("n > 1"), "buckets")
    members = written(keyed.join(buckets.hint("merge"), "key"), "members")
    dropped(buckets)
    pairs = written(members.where("cid <> rep").select(F.least("cid", "rep").alias("a"), F.greatest("cid", "rep").alias("b")).distinct(), "pairs")
    side = classes.select("cid", "sketch")
    same = " + ".join(f"if(substring(sa, {i + 1}, 1) = substring(sb, {i + 1}, 1), 1, 0)" for i in range(plan.hashes))
    one, two = side.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), side.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"))
    links = written(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").where(F.expr(f"{same} >= {plan.agree}")).select("a", "b"), "links")
    dropped(pairs)
    return links.unionByName(_links_across(members, links, side, plan))


def _links_across(members: DataFrame, links: DataFrame, side: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b) between bucket members that links leave in different families.

    A bucket of two is its representative and one member, which are compared already. In a larger one the members
    outside of its largest family (strangers) are compared with all members, in blocks.
    """
    families = components(links).select(F.col("node").alias("cid"), "comp")
    rest = written(members.where("n > 2").join(families.hint("merge"), "cid", "left").select("key", "cid", F.coalesce("comp", "cid").alias("comp")), "rest")
    parts = rest.groupBy("key", "comp").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("n"), F.count("*").alias("parts")).where("parts > 1")
    blocks = lambda n: F.ceil(n / plan.sketches).cast("int")
    mixed = written(mixed.select("key", F.col("top.comp").alias("main"), blocks(F.col("n")).alias("nb"), blocks(F.col("n") - F.col("top.k")).alias("ns")), "mixed")
    placed = rest.join(mixed.hint("merge"), "key").join(side.hint("merge"), "cid")
    dealt = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    columns = ["key", "p", "q", "side", "cid", "comp", "sketch"]
    tasks = placed.withColumn("p", dealt("nb")).withColumn("q", each("ns")).withColumn("side", F.lit(0)).select(*columns)
    tasks = tasks.unionByName(placed.where("comp <> main").withColumn("q", dealt("ns")).withColumn("p", each("nb")).withColumn("side", F.lit(1)).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, ["key", "p", "q"]):
            cid, comp, second = (t.column(c).to_numpy() for c in ("cid", "comp", "side"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(cid), plan.hashes)
            one, two = np.flatnonzero(second == 0), np.flatnonzero(second == 1)
            agree = np.zeros((len(one), len(two)), np.uint16)
            for i in range(plan.hashes):
                agree += sketch[one, i][:, None] == sketch[two, i][None, :]
            x, y = np.nonzero((agree >= plan.agree) & (comp[one][:, None] != comp[two][None, :]))
            if len(x):
                a, b = least_reached(cid[one[x]], cid[two[y]])  # as many links as members, not as pairs
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return mapped(tasks.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q"), run, "a long, b long")


def compare(ids: np.ndarray, sets: list[np.ndarray], plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """The exact links among sets: each linked one with the least that it reaches."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner, flat = np.repeat(np.arange(len(sets)), sizes), np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    group = np.cumsum(new) - 1
    often = np.bincount(group) > 1
    keep = often[group]
    col, own = (np.cumsum(often) - 1)[group[keep]], owner[keep]
    n, width = len(sets), 2048
    both = np.zeros((n, n), np.float32)
    for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        a, z = np.searchsorted(col, [c, c + width])
        m = np.zeros((n, width), np.float32)
        m[own[a:z], col[a:z] - c] = 1
        both += m @ m.T
    inter = both.astype(np.int64)  # exact: a count below 2 ** 24 in each step
    i, j = np.nonzero(np.triu((plan.den * inter >= plan.num * (sizes[:, None] + sizes[None, :] - inter)) & (inter > 0), 1))
    a, b = least_reached(ids[i], ids[j])
    return a[a != b], b[a != b]


def family_sets(docs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """cid, fam, n, set (sorted shingles) of members (cid, fam, least, f1, f2): the text of the class's least doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # classes of the present id, whose rows lie together
        last = None
        for b in batches:
            rows, sets = [], []
            keys = zip(*(column(b, c).to_pylist() for c in ("least", "cid", "f1", "f2")))
            for i, (t, (least, cid, f1, f2)) in enumerate(zip(raw(b), keys)):
                if least != last:
                    seen.clear()
                    last = least
                if cid in seen:
                    continue
                s = shingle_set(t, plan.words)
                if len(s) and fingerprints(s, np.array([0])).view(np.int64).ravel().tolist() == [f1, f2]:
                    seen.add(cid)
                    rows.append(i)
                    sets.append(s)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([column(b, "cid").take(at), column(b, "fam").take(at), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["cid", "fam", "n", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("least"), "text").where("least is not null").join(members.hint("merge"), "least")
    return mapped(texts.select("least", "cid", "fam", "f1", "f2", "text"), run, "cid long, fam long, n long, set binary")


def _compared(tasks: DataFrame, keys: list[str], plan: Plan) -> DataFrame:
    """Links (a, b) among the sets of each group of tasks (keys, cid, set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in by_key(batches, keys):
            ids, at = np.unique(t.column("cid").to_numpy(), return_index=True)
            if len(ids) > 1:
                sets = t.column("set").take(pa.array(at)).to_pylist()
                a, b = compare(ids, [np.frombuffer(s, np.uint64) for s in sets], plan)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return mapped(tasks.select(*keys, "cid", "set").repartition(*keys).sortWithinPartitions(*keys), run, "a long, b long")


def confirmed_links(docs: DataFrame, members: DataFrame, plan: Plan) -> DataFrame:
    """Exact links (a, b) that connect all linked members (cid, fam, least, f1, f2) of each family."""
    sets = written(family_sets(docs, members, plan), "sets")
    many = lambda block: F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / plan.most)).cast("int")
    sizes = written(sets.groupBy("fam").agg(F.count("*").alias("k"), many(plan.block).alias("nb"), many(2 * plan.block).alias("nw")), "sizes")
    placed = sets.join(sizes.hint("merge"), "fam").withColumn("blk", F.pmod(F.xxhash64("cid"), F.col("nb")).cast("int"))
    drawn = F.pmod(F.xxhash64("cid", F.lit(9)), F.lit(1 << 40)) / float(1 << 40) < plan.pivots / F.col("k")
    pivots = placed.where(F.col("nb") > 1).where(drawn).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    first = written(_compared(placed.unionByName(pivots), ["fam", "blk"], plan), "first")
    # large families that aren't one part yet
    parts = components(first).select(F.col("node").alias("cid"), "comp")
    large = placed.where(F.col("nb") > 1).select("fam", "cid", "nw").join(parts.hint("merge"), "cid", "left").select("fam", "cid", "nw", F.coalesce("comp", "cid").alias("comp"))
    large = written(large, "large")
    per = large.groupBy("fam", "nw", "comp").agg(F.count("*").alias("k"))
    split = per.groupBy("fam", "nw").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("k"), F.count("*").alias("parts")).where("parts > 1")
    outside = F.ceil((F.col("k") - F.col("top.k")) * F.col("nw") / F.col("k")).cast("int")
    split = written(split.select("fam", "nw", F.col("top.comp").alias("main"), outside.alias("no")), "split")
    every = sets.join(split.hint("merge"), "fam")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n: F.pmod(F.xxhash64("cid", F.lit(3)), F.col(n)).cast("int")
    columns = ["fam", "p", "q", "cid", "set"]
    tasks = every.withColumn("p", dealt("nw")).withColumn("q", each("no")).select(*columns)
    rest = every.join(large.select("cid", "comp").hint("merge"), "cid").where("comp <> main")
    tasks = tasks.unionByName(rest.withColumn("q", dealt("no")).withColumn("p", each("nw")).select(*columns))
    return first.unionByName(_compared(tasks, ["fam", "p", "q"], plan))


def decided(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, plan: Plan | None = None) -> DataFrame:
    """Per row: doc_id, t (a hash of the text), n_shingles, grp (a number of the component, null without shingles or id), component_id, kept."""
    plan = plan or Plan(words, num, den)
    with scratch() as keep:
        signed = keep(written(signatures(docs, plan), "signed"))
        sets = signed.where("n_shingles > 0 and doc_id is not null")
        classes = sets.groupBy("f1", "f2").agg(F.min("doc_id").alias("least"), F.first("halves").alias("halves"), F.first("sketch").alias("sketch"))
        classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
        families = components(written(candidate_links(classes, plan), "candidates"))
        members = classes.select("cid", "least", "f1", "f2").join(families.select(F.col("node").alias("cid"), F.col("comp").alias("fam")).hint("merge"), "cid")
        found = components(written(confirmed_links(docs, members, plan), "confirmed"))
        joined = classes.select("f1", "f2", "cid", "least").join(found.select(F.col("node").alias("cid"), "comp").hint("merge"), "cid", "left").select("f1", "f2", "least", F.coalesce("comp", "cid").alias("grp"))
        joined = written(joined, "joined")
        least = written(joined.groupBy("grp").agg(F.min("least").alias("component")), "least")
        joined = keep(written(joined.select("f1", "f2", "grp").join(least.hint("merge"), "grp"), "labels"))
    own = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = signed.select("doc_id", "t", "n_shingles", "f1", "f2").join(joined.hint("merge"), ["f1", "f2"], "left")
    own, known = F.when(F.col("doc_id").isNotNull(), own), F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select("doc_id", "t", "n_shingles", F.when(known, F.col("grp")).alias("grp"), own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5, plan: Plan | None = None) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept. Texts are linked when den * |A & B| >= num * |A | B|."""
    return decided(docs, words, num, den, plan).select("doc_id", "n_shingles", "component_id", "kept")


def first_of_each(docs: DataFrame, words: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """docs without the near-duplicates: of each component one row stays, with its least id.

    If that id has several rows in the component, the one with the least hash of its text stays. Rows without an id or
    without words are compared with nothing; the former all stay, and of the latter one of those with equal id and text.
    """
    with scratch() as keep:
        found = written(decided(docs, words, num, den), "near")
        id_, text = unused_name(docs, "_id"), unused_name(docs, "_text")
        alone = F.when(F.col("grp").isNull(), F.col("t"))
        stay = keep(written(found.where("kept").groupBy("doc_id", "grp", alone.alias("alone")).agg(F.min("t").alias("t")).select(F.col("doc_id").alias(id_), F.col("t").alias(text)), "stay"))
        repeated = found.where("kept").groupBy("doc_id", "t").count().where("count > 1").limit(1).count() > 0
    # a merge join at every size: what stays grows with the corpus
    known = docs.where("doc_id is not null").join(stay.hint("merge"), (F.col("doc_id").cast("long") == F.col(id_)) & (F.xxhash64("text") == F.col(text)), "left_semi")
    if repeated:
        known = known.withColumn(text, F.xxhash64("text")).dropDuplicates(["doc_id", text]).drop(text)
    return known.unionByName(docs.where("doc_id is null"))
