"""A corpus pipeline: five operators in a row, each working on what the one before it kept.

Each stage takes documents with any further columns (also under names that operators use inside) and, but for the last,
gives the same columns. All rows count: what is defined for odd ones is said at each stage, and is the operator's own
rule. An empty table goes through all stages and gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from thriftlens.llm import bpe, langid, linededup, minhash, mixing
from thriftlens.llm.common import dropped, table_path, written
from thriftlens.llm.queries import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; rejected ones go.

    Null texts, texts without a letter, and texts in no language that was learned go. Very long texts are read whole.
    Repeated rows share one decision, as do equal texts under other ids. A null id or lang is no reason to go; where no
    row has a lang, nothing can be learned and all rows go.
    """
    return langid.accepted_only(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of lines that an earlier document has; a document of which nothing is left goes.

    Null and empty texts stay as they are. Very long texts are read whole. Repeated rows of one id are one document:
    none of them loses lines to another. Rows of one id with different texts, and rows without an id, are documents of
    their own.
    """
    return linededup.without_repeats(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, Jaccard similarity of 0.8 or more).

    The row with the least id stays, once, also of repeated rows; of several texts under that id the one with the
    least hash. Null, empty and wordless texts are near nothing and stay, as do all rows without an id.
    """
    return minhash.first_of_each(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    A null source is a source of its own. Null and wordless texts have no words to take and go. Repeated rows are taken
    one by one. Equal input gives equal output, whatever its order.
    """
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests of the round trip; one row for each row, null text as empty text."""
    return bpe.encoded(docs, tokenizer_path(), with_ids=True)


STAGES = [("language", language), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("encode", encode)]

#: Training by gradient descent, MinHash and BPE are not SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each result but the last is written and read again, and deleted once the next one is written."""
    docs = spark.read.parquet(table_path(sf_dir, "documents"))
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(before)
    return STAGES[-1][1](spark, docs, sf_dir)
