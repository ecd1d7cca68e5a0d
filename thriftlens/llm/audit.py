"""Filter interaction audit: what each of five filters takes in every order, and what that costs.

A relational plan, all in the JVM: one row for each distinct text and word, with its count, then one for each text, with
its total and its number of different words; other flags are joined to that by outer joins, and each part becomes one row
of 32 conditional counts, one for each set of filters that fail. All 120 orders are read off those 32 numbers.

Texts are known by 128 bits of their SHA-256. Equal texts become one before their words are exploded, with partial aggregates
where they lie, so a group of copies is worked on once and isn't gathered. Texts are sent once, by that key; counting their
words needs no further exchange. Nothing is broadcast or collected.

Defined results: a null text is an empty one, a null source the part ''. Wordless texts fail A alone of the counting
filters: they have no words to repeat and no characters beyond the white space. Every row counts, repeated rows too; rows of one id and text don't come before each
other (E). Several labels of one document: it is good, or toxic, if one of them says so; labels of other documents and
null labels say nothing. Very long texts are exploded whole. An empty table has no parts and gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, scratch, written

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_key(text: Column) -> Column:
    """128 bits of a text's SHA-256."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def word_counts(texts: DataFrame) -> DataFrame:
    """key, words, different: a row for each row (key, text) that has words."""
    words = texts.select("key", F.explode(F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1))).alias("word"))
    each = words.groupBy("key", "word").agg(F.count("*").alias("n"))
    return each.groupBy("key").agg(F.sum("n").alias("words"), F.count("*").alias("different"))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic, fails of each row: fails is the set of filters that it fails, a bit for each letter."""
    text = F.coalesce("text", F.lit(""))
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    keyed = all_.withColumn("key", text_key(F.col("text").cast("binary")))
    with scratch() as keep:
        points, upper = F.length("text"), F.length("text") - F.length(F.translate("text", UPPER, ""))
        rows = keep(written(keyed.select("doc_id", "part", "key", (100 * upper > 5 * points).alias("c"), F.col("text").rlike(r"[#$%&*|]").alias("d")), "rows"))
        firsts = keep(written(rows.groupBy("key").agg(F.min("doc_id").alias("least")), "firsts"))
        texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
        counts = keep(written(word_counts(texts), "words"))
    # flags of texts to rows, and of ids: exchanges on both sides, so that a group of copies can be split
    label = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    label = label.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    of_text = firsts.join(counts.hint("merge"), "key", "left")
    joined = rows.join(of_text.hint("merge"), "key", "left").join(label.hint("merge"), "doc_id", "left")
    words, different = F.coalesce("words", F.lit(0)), F.coalesce("different", F.lit(0))
    flags = [words < 50, 100 * different < 65 * words, F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    fails = sum((f.cast("int") * (1 << i) for i, f in enumerate(flags)), F.lit(0))
    return joined.select("part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), fails.alias("fails"))


def interactions(fails: DataFrame) -> DataFrame:
    """A part's 32 conditional counts: n (all), good and toxic, arrays by set of failing filters."""
    count = lambda when: F.array(*(F.count(F.when((F.col("fails") == s) & when, 1)) for s in range(SETS)))
    return fails.groupBy("part").agg(count(F.lit(True)).alias("n"), count(F.col("good")).alias("good"), count(F.col("toxic")).alias("toxic"))


def audited(docs: DataFrame, labels: DataFrame, with_counts: bool = False) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part."""
    parts = interactions(failures(docs, labels))
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps = [("".join(p), i + 1, bit[f], sum(bit[x] for x in p[:i])) for p in permutations(FILTERS) for i, f in enumerate(p)]
    fixed = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("own"), F.lit(e).alias("earlier")) for o, s, b, e in steps))
    sets = F.sequence(F.lit(0), F.lit(SETS - 1))

    def total(counts: str, wanted) -> Column:
        return F.aggregate(F.filter(sets, wanted), F.lit(0).cast("long"), lambda x, s: x + F.col(counts)[s])

    own, earlier = F.col("own"), F.col("earlier")
    falls = lambda s: s.bitwiseAND(own) != 0
    here = lambda s: falls(s) & (s.bitwiseAND(earlier) == 0)
    # a document is removed by a filter in the orders in which it comes before all others that the document fails
    orders = lambda s: F.element_at(F.array(*(F.lit(120 // k) for k in range(1, 6))), F.bit_count(s))
    shapley = F.aggregate(F.filter(sets, falls), F.lit(0).cast("long"), lambda x, s: x + F.col("n")[s] * orders(s))
    rows = parts.select("*", F.inline(fixed)).select(
        "part", "filter_order", "step",
        total("n", lambda s: s.bitwiseAND(own.bitwiseOR(earlier)) == 0).alias("kept"), total("n", here).alias("removed"),
        total("n", lambda s: falls(s) & (s.bitwiseAND(earlier) != 0)).alias("redundant"), F.col("n")[own].alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"), shapley.alias("shapley"),
        *(F.col(c) for c in ["n"] * with_counts),
    )
    return rows
