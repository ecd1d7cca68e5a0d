"""Context that costs tokens and adds nothing: repeated, oversized or unused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from thriftlens.operators.tables import Tables, finding, plural
from thriftlens.storage import written


def response_classes(t: Tables) -> DataFrame:
    """session_id, f1, f2, c, m, size: a class for each set of lines that tool responses of a session have.

    c is the first response's idx and m their number; size is the characters of all lines. Classes are an aggregate with
    a map-side part, so thousands of equal responses are one row. The lines are a column too, unless t has a table of
    sets: then classes are numbers, which are aggregated without a sort.
    """
    per = t.lines().groupBy("session_id", "f1", "f2")
    lines = [F.first("lines").alias("lines")] if t.sets is None else []
    return written(per.agg(F.min("idx").alias("c"), F.count("*").alias("m"), F.max("size").alias("size"), *lines), "classes")


def class_lines(t: Tables, classes: DataFrame) -> DataFrame:
    """session_id, c, h1, h2, n: the lines of classes, or those that another set has too."""
    if t.sets is None:
        return classes.select("session_id", "c", F.inline("lines"))
    return written(classes.join(t.sets, ["f1", "f2"]).select("session_id", "c", F.inline("lines")), "class-lines")


def class_pairs(classes: DataFrame, lines: DataFrame, most: int) -> DataFrame:
    """session_id, c, d, m, k, overlap of classes (c, d with m and k members) that share more than `most` characters of lines.

    Only lines that can decide a pair are joined: with a class's lines from the most to the least frequent
    of the session, those that come within the first `most` characters can be left out, because two
    classes that share more than that share a line beyond them. So boilerplate, which would pair all
    responses with each other, is not joined; the few pairs found are then measured on all their lines.
    How often a line stands in a session is a count with a map-side part, joined back. What is joined with all lines is
    written first: where few lines of a session are shared, Spark sees that and leaves the lines where they lie.
    """
    one = ["session_id", "h1", "h2"]
    often = lines.join(written(lines.groupBy(*one).agg(F.count("*").alias("often")).where("often > 1"), "often"), one)
    upto = F.sum("n").over(W.partitionBy("session_id", "c").orderBy(F.desc("often"), "h1", "h2").rowsBetween(W.unboundedPreceding, 0))
    deciding = written(often.withColumn("upto", upto).where(F.col("upto") > most).select("session_id", "c", "h1", "h2"), "deciding")
    pairs = written(deciding.join(deciding.withColumnRenamed("c", "d"), one).where("c < d").select("session_id", "c", "d").distinct(), "pairs")
    both = written(pairs.join(lines, ["session_id", "c"]), "sides").join(lines.drop("n").withColumnRenamed("c", "d"), [*one, "d"])
    shared = both.groupBy("session_id", "c", "d").agg(F.sum("n").alias("overlap")).where(F.col("overlap") > most)
    size = classes.select("session_id", "c", "m")
    return shared.join(size, ["session_id", "c"]).join(size.withColumnsRenamed({"c": "d", "m": "k"}), ["session_id", "d"]).select("session_id", "c", "d", "m", "k", "overlap")


def overlap_pairs(t: Tables) -> DataFrame:
    """session_id, i, j, overlap of tool responses (i before j) that share more than stale_overlap characters of lines.

    The pairs are the result, so their number is bounded only by what overlaps: n responses of one session that all hold
    the same text are n * (n - 1) / 2 pairs of numbers. Their totals, in stale(), don't need them.
    """
    most, classes = t.config.stale_overlap, response_classes(t)
    members = t.lines().select("session_id", "idx", "f1", "f2").join(classes.select("session_id", "f1", "f2", "c"), ["session_id", "f1", "f2"]).select("session_id", "c", "idx")
    one, two = members.withColumnRenamed("idx", "x"), members.withColumnsRenamed({"c": "d", "idx": "y"})
    between = class_pairs(classes, class_lines(t, classes), most).join(one, ["session_id", "c"]).join(two, ["session_id", "d"])
    same = classes.where((F.col("m") > 1) & (F.col("size") > most)).select("session_id", "c", F.col("c").alias("d"), F.col("size").alias("overlap"))
    within = same.join(one, ["session_id", "c"]).join(two, ["session_id", "d"]).where("x < y")
    ends = ["session_id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"), "overlap"]
    return between.select(*ends).unionByName(within.select(*ends))


def stale(t: Tables) -> DataFrame:
    """From pairs of classes: m * k pairs of responses, or m * (m - 1) / 2 of one class, in closed form."""
    most, classes = t.config.stale_overlap, response_classes(t)
    between = class_pairs(classes, class_lines(t, classes), most).select("session_id", (F.col("m") * F.col("k")).alias("pairs"), "overlap")
    within = classes.where((F.col("m") > 1) & (F.col("size") > most)).select("session_id", F.expr("m * (m - 1) div 2").alias("pairs"), F.col("size").alias("overlap"))
    wasted = F.sum(F.col("pairs") * F.floor(F.col("overlap") / 4)).cast("long")
    per = between.unionByName(within).groupBy("session_id").agg(F.sum("pairs").alias("n"), wasted.alias("w"))
    said = F.format_string("%d pairs of tool responses hold the same content, so it was read more than once", "n")
    return per.where(F.col("n") >= t.config.stale_pairs).select(*finding(0, "context_bloat", F.col("w"), F.col("n"), said, 0.65))


def oversized(t: Tables) -> DataFrame:
    most = t.config.oversized
    big = t.facts().where((F.col("role") == "tool") & (F.col("chars") > most)).withColumn("excess", (F.col("chars") - most).cast("long"))
    first = F.min_by(F.struct(F.coalesce("tool_name", F.lit("unknown")).alias("name"), "excess"), "idx")
    per = big.groupBy("session_id").agg(F.count("*").alias("n"), F.sum(F.floor(F.col("excess") / 4)).cast("long").alias("w"), first.alias("first"))
    said = F.format_string(f"%d tool %s longer than {most:,} characters (the first, from %s, by %,d); limit the lines that are read", "n", plural(F.col("n"), "response is", "responses are"), "first.name", "first.excess")
    return per.select(*finding(1, "context_bloat", F.col("w"), F.col("n"), said, 0.55))


def unused(t: Tables) -> DataFrame:
    """session_id, available, unused (sorted names) where tools are defined in the first system message."""
    system = t.facts().where("role = 'system'").groupBy("session_id").agg(F.min_by("tools", "idx").alias("available"))
    defined = system.where(F.size("available") >= t.config.unused_tools_from)
    used = t.tool_calls().select("session_id", "name").distinct().groupBy("session_id").agg(F.collect_set("name").alias("used"))
    both = defined.join(used, "session_id", "left")
    left = F.array_sort(F.array_except("available", F.coalesce("used", F.array().cast("array<string>"))))
    return both.select("session_id", F.size("available").alias("available"), left.alias("unused")).where(F.size("unused") > 0)


def unused_tools(t: Tables) -> DataFrame:
    n = F.size("unused")
    named = F.concat(F.array_join(F.slice("unused", 1, 3), ", "), F.when(n > 3, " and others").otherwise(""))
    said = F.format_string("%d defined %s never used (%s); leave them out of the system prompt", n, plural(n, "tool was", "tools were"), named)
    return unused(t).select(*finding(2, "context_bloat", n * t.config.unused_tool_tokens, n, said, 0.7))


def _noise(t: Tables) -> DataFrame:
    """session_id, message_count, noise of long sessions that have messages."""
    c = t.config
    noise = F.floor(F.col("input_tokens") * F.lit(c.noise)).cast("long")
    long = t.sessions.where(F.col("message_count") > c.long_session).select("session_id", "message_count", noise.alias("noise"))
    return long.join(t.facts().select("session_id").distinct(), "session_id", "left_semi")  # a row for each session and task is sent


def _overhead(t: Tables) -> list:
    said = F.format_string("the session has %d messages, of which about a quarter is overhead; start afresh now and then", "message_count")
    return finding(3, "context_bloat", F.col("noise"), F.col("message_count"), said, 0.4)


def _unexplained(t: Tables):
    return F.col("known").isNull() | (F.col("known") < F.col("noise") * F.lit(t.config.noise_gate))


def overhead(t: Tables, found: DataFrame) -> DataFrame:
    """Long sessions in which the other findings explain less than half of the usual overhead."""
    other = found.groupBy("session_id").agg(F.sum("tokens_wasted").alias("known"))
    return _noise(t).join(other, "session_id", "left").where(_unexplained(t)).select(*_overhead(t))


def detect(t: Tables) -> DataFrame:
    """All four; the last is decided where a session's other findings meet, so that they are computed once."""
    found = stale(t).unionByName(oversized(t)).unionByName(unused_tools(t))
    row = F.struct(*found.columns)
    per = found.groupBy("session_id").agg(F.collect_list(row).alias("found"), F.sum("tokens_wasted").alias("known"))
    both = per.join(_noise(t), "session_id", "full_outer")
    more = F.when(F.col("noise").isNotNull() & _unexplained(t), F.array(F.struct(*_overhead(t))))
    none = F.array().cast(per.schema["found"].dataType)
    each = both.select(F.explode(F.concat(F.coalesce("found", none), F.coalesce(more, none))).alias("f"))
    return each.select("f.*")
