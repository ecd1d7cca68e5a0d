"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target of words; every document of it should be taken share = target / source_size times.
The whole part of the share is certain. The fractional parts are rounded together: two documents meet, words
move at random from one to the other until one of them holds none or all of its size (so its copies are an
integer), and the other goes on with the rest. The move keeps the sum of words and each expectation, so a
source ends within one document of its target.

Meetings form a reduction tree: documents of a source are dealt into blocks of about FAN by a hash, a block is
folded to one residual, longest documents first (so that the one left over tends to be short), and
residuals are the documents of the next level, until one block is left for each source. A level is one shuffle of
what the level below left over; a large source only has more blocks.

Defined results: null text has size 0 and is taken 0 words. A very long text is one document, counted whole. Sources
are ordered by code point with null last. No words at all: every target is 0. Repeated rows are separate documents.
One doc_id (or none) with several texts or sources: separate documents too. Equal inputs give equal results in any
order of rows: chance comes from hashes of doc_id and text, and rows that are equal in id, source and text are
numbered among themselves. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, scratch, unused_name, written

FAN = 48
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
_TINY = 1e-9


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, t (a hash of the text), rep (which of the rows that are equal in these)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", _words().alias("size"), F.xxhash64("text").alias("t"))
    return rows.withColumn("rep", F.row_number().over(W.partitionBy("doc_id", "source", "t").orderBy("size")))


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, n, source_size, target: weights by rank, filled up to `most` times a source's size.

    With sources in the order in which they fill up, the first k - 1 full ones leave the level
    (total - their limits) / (weights of the rest); the first k whose own limit isn't below that level ends it.
    The table has one row per source, so its windows are the only ones over a whole table.
    """
    per = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", (F.lit(most) * F.col("source_size")).cast("double"))
    everything = W.partitionBy()
    filling = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    per = per.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(filling.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("open", F.sum("weight").over(filling.rowsBetween(0, W.unboundedFollowing)))
    level = (F.col("goal") - F.col("full")) / F.col("open")
    per = per.withColumn("level", F.min(F.when(level * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("full").alias("full"), level.alias("level")))).over(everything)["level"])
    target = F.coalesce(F.least(F.col("cap"), F.col("level") * F.col("weight")), F.col("cap"))
    return per.select("source", "n", "source_size", target.alias("target"))


def _folded(level: int) -> Column:
    """items (sorted structs) -> struct(cur: the one document left over, out: those whose words are decided)."""
    names = ("size", "u", "doc_id", "t", "rep", "base")

    def step(acc: Column, x: Column) -> Column:
        c = acc["cur"]
        to_c = F.least(c["size"] - c["mass"], x["mass"])
        to_x = F.least(c["mass"], x["size"] - x["mass"])
        u = F.pmod(F.xxhash64(c["u"], x["u"], F.lit(level)), F.lit(1 << 52)) / float(1 << 52)
        first = u * (to_c + to_x) < to_x
        c_mass = F.when(first, c["mass"] + to_c).otherwise(c["mass"] - to_x)
        x_mass = F.when(first, x["mass"] - to_c).otherwise(x["mass"] + to_x)
        with_mass = lambda d, m: F.struct(*[d[n].alias(n) for n in names], m.alias("mass"))
        new_c, new_x = with_mass(c, c_mass), with_mass(x, x_mass)
        whole = (c_mass <= c["size"] * _TINY) | (c_mass >= c["size"] * (1 - _TINY))
        return F.struct(F.when(whole, new_x).otherwise(new_c).alias("cur"), F.concat(acc["out"], F.array(F.when(whole, new_c).otherwise(new_x))).alias("out"))

    items = F.col("items")
    start = F.struct(items[0].alias("cur"), F.slice(items, 1, 0).alias("out"))
    return F.aggregate(F.slice(items, 2, F.greatest(F.size(items) - 1, F.lit(0))), start, step)


def decisions(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, t, rep, source, size, source_size, target, copies: one row per row of docs."""
    rows = written(sized(docs), "sized")
    goal = written(targets(rows, weights, share, most), "targets")
    largest = goal.agg(F.max("n")).first()[0] or 0
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    right = goal.select(F.col("source").alias("_source"), "n", "source_size", "target")
    shares = rows.join(right, F.col("source").eqNullSafe(F.col("_source"))).withColumn("copies", copies)
    shares = shares.withColumn("base", F.least(F.floor("copies"), F.lit(most)).cast("int"))
    shares = shares.withColumn("mass", F.greatest(F.col("copies") - F.col("base"), F.lit(0.0)) * F.col("size"))
    shares = shares.withColumn("fixed", (F.col("mass") <= F.col("size") * _TINY)).withColumn("u", F.xxhash64("doc_id", "t", "rep"))
    shares = written(shares.select("doc_id", "t", "rep", "source", "size", "source_size", "target", "base", "mass", "fixed", "u", "n"), "shares")
    keep = ["doc_id", "t", "rep", "source", "size", "source_size", "target"]
    done = shares.where("fixed").select(*keep, F.col("base").alias("copies"))
    still = shares.where("not fixed").drop("fixed").withColumn("blocks", F.ceil(F.col("n") / FAN).cast("long"))
    blocks, level = -(-largest // FAN), 0
    while True:
        dealt = still.withColumn("blk", F.pmod(F.xxhash64("u", F.lit(1000 + level)), "blocks"))
        item = F.struct("size", "u", "doc_id", "t", "rep", "base", "mass")
        groups = dealt.groupBy("source", "blk").agg(F.sort_array(F.collect_list(item), asc=False).alias("items"), *[F.first(c).alias(c) for c in ("source_size", "target", "blocks")])
        folded = groups.select("source", "source_size", "target", "blocks", _folded(level).alias("f"))
        flat = folded.select("source", "source_size", "target", "blocks", F.posexplode(F.concat(F.array("f.cur"), F.col("f.out"))).alias("p", "d"))
        table = written(flat.select("source", "source_size", "target", "blocks", (F.col("p") == 0).alias("left"), "d.*"), "level")
        rounded = F.col("base") + (F.col("mass") * 2 > F.col("size")).cast("int")
        done = done.unionByName(table.where("not left").select(*keep, rounded.alias("copies")))
        still = table.where("left").drop("left").withColumn("blocks", F.ceil(F.col("blocks") / FAN).cast("long"))
        if blocks <= 1:
            break
        blocks, level = -(-blocks // FAN), level + 1
    coin = F.pmod(F.xxhash64("u", F.lit(77)), F.lit(1 << 52)) / float(1 << 52)
    last = still.select(*keep, (F.col("base") + (coin * F.col("size") < F.col("mass")).cast("int")).alias("copies"))
    return done.unionByName(last)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: how many words of each document the mix takes."""
    d = decisions(docs)
    return d.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """The rows of docs that the mix takes, each as often as it is taken."""
    id_, of, text, rep, copies, nth, copy = (unused_name(docs, n) for n in ("_id", "_of", "_text", "_rep", "_copies", "_nth", "_copy"))
    with scratch() as keep:
        d = decisions(docs, weights, share, most).select(F.col("doc_id").alias(id_), F.col("source").alias(of), F.col("t").alias(text), F.col("rep").alias(rep), F.col("copies").alias(copies))
        d = keep(written(d, "decided"))
    rows, own = docs, F.col("doc_id").cast("long")
    on = own.eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(of)) & (F.xxhash64("text") == F.col(text))
    if d.where(F.col(rep) > 1).limit(1).count():
        rows = docs.withColumn(nth, F.row_number().over(W.partitionBy(own, "source", F.xxhash64("text")).orderBy(F.lit(0))))
        on = on & (F.col(nth) == F.col(rep))
    taken = rows.join(d.where(F.col(copies) > 0).hint("merge"), on).withColumn(copy, F.explode(F.array_repeat(F.lit(0), F.col(copies))))
    return taken.select(*docs.columns)
