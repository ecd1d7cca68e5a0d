"""Near copies in a crowd, and what comes to the driver."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from thriftlens.llm import ann, embdedup, langid


def vectors_of(spark, x, kind="float"):
    table = pa.table({"vec_id": pa.array(range(len(x)), pa.int64()), "embedding": pa.array(x.tolist(), pa.list_(pa.float32() if kind == "float" else pa.float64())), "label": pa.array([0] * len(x))})
    return spark.createDataFrame(table)


def recall(spark, x, out, every=50, k=5):
    """The share of the nearest by brute force that were found, in the crowd (ids below 600) and out of it."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append(r)
    hits = {True: [], False: []}
    for q in range(0, len(x), every):
        s = u @ u[q]
        s[q] = -np.inf
        best = np.sort(s)[-k]
        rows = found[q]
        assert [r["rank"] for r in rows] == list(range(1, k + 1)) and all(abs(s[r["vec_id"]] - r["score"]) < 1e-12 for r in rows)
        hits[q < 600].append(sum(s[r["vec_id"]] >= best - 1e-15 for r in rows) / k)
    return [np.mean(v) for v in hits.values()]


@pytest.mark.parametrize("noise,kind", [(0.01, "float"), (0.001, "float"), (0.001, "double"), (0.0001, "double")])
def test_neighbours_in_a_crowd(spark, noise, kind):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(1000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    away = rng.normal(size=(600, 64))
    x[:600] = x[0] + noise * away / np.linalg.norm(away, axis=1)[:, None]
    if kind == "float":
        x = x.astype(np.float32).astype(np.float64)
    crowd, other = recall(spark, x, ann.neighbours(vectors_of(spark, x, kind), every=50, k=5).collect())
    assert crowd >= 0.95 and other >= 0.9


def test_nearest_keeps_what_single_precision_cannot_tell():
    rng = np.random.default_rng(2)
    y = rng.normal(size=(1, 32)) + 1e-6 * rng.normal(size=(500, 32))
    x = y[:20]
    there = np.ones((20, 500), bool)
    there[:, 400:] = False
    row, col, s = ann.nearest(x, y, there, 6)
    u = y / np.linalg.norm(y, axis=1)[:, None]
    for i in range(20):
        want = np.sort((u[:400] @ u[i]))[-6:]
        assert np.allclose(np.sort(s[row == i])[-6:], want, atol=1e-15, rtol=0)
    assert (col < 400).all()


def test_cells_of_long_vectors_are_bounded_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(embdedup, "VALUES", 1 << 19)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 2048))
    x = np.repeat(base, 10, axis=0) + 0.01 * rng.normal(size=(600, 2048))
    df = vectors_of(spark, x)
    _, classes = embdedup.classes_of(df)
    cells = embdedup.fit_cells(classes, 0.93, cell=8, sample=20_000, most_cells=8192)
    assert sum(c.size for c in cells.values()) <= 1 << 19 and len(cells) == 1
    out = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embdedup.near_vectors(df, threshold=0.93).collect()}
    assert out == {i: (9, i // 10 * 10) for i in range(600)}


def test_spaced_centroids():
    rng = np.random.default_rng(6)
    c = rng.normal(size=(300, 3))
    c /= np.linalg.norm(c, axis=1)[:, None]
    kept = embdedup.spaced(c, 0.3)
    apart = np.linalg.norm(kept[:, None] - kept[None], axis=2) + np.eye(len(kept))
    assert apart.min() >= 0.3 - 1e-12 and all(np.linalg.norm(kept - x, axis=1).min() < 0.3 + 1e-12 for x in c)


def test_language_sample_is_bounded_by_subwords(spark, monkeypatch):
    """Long texts: fewer are learned, of each language, and all documents still get the right one."""
    import random

    r, seen = random.Random(8), []
    kinds = {"en": "the then with where thing shall".split(), "de": "über schön nicht ich auch würde".split(), "fr": "où était leçon chose être déjà".split()}
    rows = [(i, " ".join(r.choice(kinds[lang]) + str(r.randrange(10)) for _ in range(r.choice([20, 30_000 if i < 30 else 40]))), lang) for i, lang in ((i, sorted(kinds)[i % 3]) for i in range(240))]
    train = langid.train
    monkeypatch.setattr(langid, "train", lambda samples, seed: (seen.extend(samples), train(samples, seed))[1])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, langid.F.lit(True), subwords=20_000)
    assert sum(len(s.ids) for s in seen) <= 20_000 and {s.lang for s in seen} == set(kinds) and len(seen) > 30
    got = {x["doc_id"]: x["lang_pred"] for x in langid.predict(df, model).collect()}
    assert sum(got[i] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_langid_sample_is_learned_where_it_lies_and_its_memory_given_back(spark, monkeypatch):
    rows = [(d, d % 7, np.arange(d % 5 + 1, dtype=np.int32).tobytes(), np.full(d % 5 + 1, d, np.int32).tobytes(), f"l{d % 2}", b"a piece") for d in (5, 3, 9, 1, 4)]
    table = pa.concat_tables([pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), langid._SAMPLE.types)], schema=langid._SAMPLE) for part in (rows[:2], rows[2:])])
    held = pa.total_allocated_bytes()
    got = langid._samples(table)
    assert pa.total_allocated_bytes() - held < 64
    want = [(np.frombuffer(r[2], np.int32).tolist(), np.frombuffer(r[3], np.int32).tolist(), r[4], r[5]) for r in sorted(rows)]
    assert [(s.ids.tolist(), s.n.tolist(), s.lang, s.piece) for s in got] == want
    spans = [(c.buffers()[2].address, c.buffers()[2].address + c.buffers()[2].size) for c in table.column("ids").chunks]
    assert all(any(a <= s.ids.__array_interface__["data"][0] < z for a, z in spans) for s in got)

    calls = []
    monkeypatch.setattr(langid, "give_back", lambda: calls.append(1))
    docs = spark.createDataFrame([(i, f"some words of text number {i}", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(docs, F.lit(True)) is not None
    assert calls == [1]
