import random

import pytest

WORDS = [f"w{i}" for i in range(400)]
#: Names that the operators use inside.
CLASHES = ["size", "shard", "part", "node", "comp", "key", "copies", "blk", "_doc", "_spans", "cid", "before", "ids", "lang_pred", "taken", "pos", "kept"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(WORDS) for _ in range(n)]


def rows():
    base = words(120, 1)
    near = base[:60] + ["changed"] + base[61:]
    passage = "\n".join(" ".join(words(20, 100 + i)) for i in range(4))
    lines = lambda seed: "\n".join(" ".join(words(9, seed * 50 + i)) for i in range(6))
    out = [
        (1, " ".join(base), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, " ".join(base).upper(), "en", "b", 1), (4, None, None, None, None), (5, "", "de", "b", 0),
        (6, "   \n\t ", None, "", 0), (7, "one two", "fr", "c", 3), (8, "one  TWO", "fr", "c", 3), (9, " ".join(words(400_000, 9)), "en", "hot", 1),
        (10, f"{lines(3)}\n{passage}\n{lines(4)}", "en", "hot", 1), (11, f"{lines(5)}\n\n{passage}\n\n{lines(6)}", "en", "hot", 1), (12, passage, "en", "hot", 1),
        (13, "línea é über\r\n<|endoftext|> 你好 \U0001f600 x\x00y", "es", "z", 1), (14, "12 34 !!", "en", "z", 1), (None, "no id here", "en", "z", 1), (None, None, None, None, None),
        (15, "the same row", "en", "hot", 12), (15, "the same row", "en", "hot", 12), (15, "the same row", "en", "hot", 12),
    ]
    out += [(100 + i, " ".join(base), "en", "hot", 1) for i in range(20)]
    return [(*r, *["clash"] * len(CLASHES)) for r in out]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, ties, copies, repeated rows, clashing extra columns."""
    return spark.createDataFrame(rows(), SCHEMA).repartition(3, "doc_id")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
