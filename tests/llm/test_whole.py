"""Cases in which the operators once did less than the whole job."""

import math
import random

import numpy as np
import pytest

from thriftlens.llm import ann, embdedup, linededup, minhash, mixing
from thriftlens.llm.common import components

from .test_operators import brute_lines, check_mix, check_near, least_linked


# --- line dedup: the end of a repeated passage


def test_the_end_of_a_repeated_passage_goes(spark):
    text = "\n".join(" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 60), ("b", 15), ("c", 15), ("d", 10)))
    df = spark.createDataFrame([(1, text), (2, text), (3, text + "\nmore of it"), (4, "own line\n" + text[: text.index("d0")] + "other end")], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linededup.line_deduped(df).collect()}
    assert left == {1: text, 2: "", 3: "more of it", 4: "own line\nother end"}
    assert sorted(r["doc_id"] for r in linededup.without_repeats(df).collect()) == [1, 3, 4]


def test_a_passage_ends_before_the_window_of_its_last_lines_is_full(spark):
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    abc = [line("a", 30), line("b", 30), line("c", 10)]
    df = spark.createDataFrame([(1, "\n".join([*abc, line("x", 60)])), (2, "\n".join([*abc, line("y", 60)]))], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.line_deduped(df).collect()}[2] == line("y", 60)


def test_an_extension_agrees_with_a_later_place(spark):
    """The first place of the passage's head doesn't have its tail; the second one does."""
    line = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = line("a", 60), line("b", 15), line("c", 10)
    texts = {1: [a, line("p", 9)], 2: [line("q", 9), a, b, c], 3: [a, b, line("r", 9)], 4: [line("s", 9), line("t", 5), a, b, c]}
    df = spark.createDataFrame([(k, "\n".join(v)) for k, v in texts.items()], "doc_id long, text string")
    left = {r["doc_id"]: r["text"] for r in linededup.line_deduped(df).collect()}
    assert left == {1: "\n".join(texts[1]), 2: "\n".join([line("q", 9), b, c]), 3: line("r", 9), 4: "\n".join([line("s", 9), line("t", 5)])}


def test_passages_by_chance(spark):
    r = random.Random(18)
    pool = [" ".join(f"p{r.randrange(30)}" for _ in range(r.randrange(1, 6))) for _ in range(12)] + ["", "  "]
    texts = {i: "\n".join(r.choice(pool) for _ in range(r.randrange(1, 25))) for i in range(120)} | {500: "\n".join(["same line here"] * 12)}
    texts |= {200 + i: "\n".join(texts[i].split("\n")[r.randrange(3) :]) for i in range(0, 120, 2)}
    df = spark.createDataFrame([(k, v) for k, v in texts.items() if v], "doc_id long, text string")
    left = {x["doc_id"]: x["text"] for x in linededup.line_deduped(df, 8).collect()}
    assert left == brute_lines([(k, v) for k, v in texts.items() if v], 8)


def test_rows_of_one_id_with_different_texts(spark):
    line = lambda c: " ".join(f"{c}{i}" for i in range(60))
    out = [(7, "\n".join(map(line, "abc"))), (7, "\n".join(map(line, "pqrs"))), (7, line("z")), (8, "\n".join([line("q"), "own"])), (7, "\n".join(map(line, "abc"))), (9, line("c") + "\nown too")]
    want = sorted([out[0][1], out[1][1], out[2][1], "own", out[4][1], "own too"])
    for rows in (out, out[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert sorted(r["text"] for r in linededup.line_deduped(df).collect()) == want
        assert sorted(r["text"] for r in linededup.without_repeats(df).collect()) == want


# --- MinHash: near copies in a bucket whose representative is like neither


@pytest.mark.parametrize("sketches", [64, 1024])
def test_near_copies_in_a_bucket_of_unlike_texts(spark, sketches):
    plan = minhash.Plan(5, 85, 100, sketches=sketches)
    r = np.random.default_rng(3)
    sketch = r.integers(0, 256, (400, plan.hashes), np.uint8)
    for i in range(0, 60, 2):  # pairs, and chains of three that agree only with the next
        sketch[i + 1, :40] = sketch[i, :40]
    for i in range(100, 160, 3):
        sketch[i + 1, :32], sketch[i + 2, 16:] = sketch[i, :32], sketch[i + 1, 16:]
    df = spark.createDataFrame([(i, [7] * 2 * plan.m, bytearray(s.tobytes())) for i, s in enumerate(sketch)], "cid long, halves array<long>, sketch binary")
    want = least_linked(dict(enumerate(sketch)), lambda a, b: (a == b).sum() >= plan.agree)
    got = {x["node"]: x["comp"] for x in components(minhash.candidate_links(df, plan)).collect()}
    assert {i: got.get(i, i) for i in range(len(sketch))} == want and sum(i != c for i, c in want.items()) == 70


def test_half_alike_texts(spark):
    r = random.Random(12)
    pool = [" ".join(f"v{p}x{i}" for i in range(12)) for p in range(60)]
    texts = [" ".join(r.sample(pool, 30)) for _ in range(300)]
    for i in range(0, 80, 2):
        w = texts[i].split()
        w[r.randrange(len(w))] = "changed"
        texts[i + 1] = " ".join(w)
    want = check_near(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 85, 100)
    assert sum(i != c for i, c in want.items()) == 40


# --- MinHash: losses at the threshold


@pytest.mark.parametrize("num,den", [(4, 5), (85, 100), (9, 10), (1, 2), (15, 17), (1, 1)])
def test_pairs_at_the_threshold_are_rarely_lost(num, den):
    p, t = minhash.Plan(5, num, den), num / den
    lost = 1 - (1 - (1 - t**p.r) ** p.m) ** 2
    few = sum(math.comb(p.hashes, k) * t**k * (1 - t) ** (p.hashes - k) for k in range(p.agree))
    assert lost <= 0.001 and few <= 0.0002
    assert t != 0.85 or (p.r, p.m, p.agree) == (3, 8, 31)


# --- rows without an id


def test_rows_without_an_id_stay_in_near_dedup(spark):
    out = [(None, "a text of its own"), (None, "another one"), (None, None), (1, "one two three"), (2, "one two three"), (3, "same"), (3, "same")]
    left = minhash.first_of_each(spark.createDataFrame(out, "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, out[:4] + out[5:6]))
    left = minhash.first_of_each(spark.createDataFrame(out[:5], "doc_id long, text string")).collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, out[:4]))


def test_rows_without_an_id_are_documents_of_their_own(spark):
    lines = lambda c: "\n".join(" ".join(f"{c}{i}x{j}" for j in range(20)) for i in range(6))
    copied, other = lines("a"), lines("b")
    out = [(None, other), (None, copied), (None, copied), (None, None), (1, copied + "\nleft"), (2, lines("c"))]
    df = spark.createDataFrame(out, "doc_id long, text string")
    left = linededup.line_deduped(df).collect()
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in left) == sorted(map(lambda r: (str(r[0]), str(r[1])), [(None, other), (None, copied), (None, ""), (None, None), (1, "left"), out[5]]))
    kept = linededup.without_repeats(df)
    assert kept.columns == df.columns and kept.count() == 5


# --- one id with several texts, in any order of rows


def test_near_duplicates_of_an_id_with_several_texts(spark):
    text = lambda c, n=30: " ".join(f"{c}{i}" for i in range(n))
    a, b, c = text("a"), text("b"), text("c")
    out = [(1, a, "x"), (2, a + " more", "x"), (2, b, "x"), (3, b, "x"), (4, c, "x"), (4, c + " more", "x"), (None, a, "x"), (5, "", "x"), (5, " ", "x"), (5, "", "x"), (4, c, "x")]
    want = sorted([(1, 1, True), (2, 1, False), (2, 2, True), (3, 2, False), (4, 4, True), (4, 4, True), (4, 4, True), (None, None, False), (5, 5, True), (5, 5, True), (5, 5, True)], key=str)
    stay = []
    for rows in (out, out[::-1], out[5:] + out[:5]):
        df = spark.createDataFrame(rows, "doc_id long, t string, grp string").withColumnRenamed("t", "text").repartition(3)
        assert sorted([(r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()], key=str) == want
        left = minhash.first_of_each(df)
        assert left.columns == ["doc_id", "text", "grp"]
        stay.append(sorted(map(str, map(tuple, left.collect()))))
    assert stay[0] == stay[1] == stay[2] and len(stay[0]) == 6 and str((2, b, "x")) in stay[0] and str((None, a, "x")) in stay[0]


def test_a_mix_of_rows_of_one_id(spark):
    out = [(7, f"{'w ' * (i % 9)}", "s" if i % 3 else "t") for i in range(200)] + [(None, "a b c", None)] * 40 + [(i, "one two three", "t") for i in range(100)]
    seen = []
    for rows in (out, out[::-1]):
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
        check_mix(df)
        seen.append((sorted(map(str, mixing.mixture(df).collect())), sorted(map(str, mixing.mixed(df).collect()))))
    assert seen[0] == seen[1]


# --- MinHash: large families


def test_a_family_of_two_parts_and_strangers(spark):
    """More members than a block has, in two parts that only a few members join, and some that are like neither."""
    r, base, out = random.Random(6), [f"b{i}" for i in range(120)], []
    other = base[:99] + [f"c{i}" for i in range(21)]
    for i in range(260):
        w = list(base if i % 2 else other)
        if i % 13 == 0:
            w = base[:108] + [f"c{k}" for k in range(9, 21)]
        for _ in range(i % 4):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append((i, " ".join(w)))
    df = spark.createDataFrame(out, "doc_id long, text string")
    check_near(df, 85, 100, minhash.Plan(5, 85, 100, block=32, pivots=3))
    check_near(df, 80, 100, minhash.Plan(5, 80, 100, block=32, pivots=3, sketches=16))


# --- vectors: crowds, several lengths, ids that are not unique


def test_a_crowd_of_near_vectors(spark):
    """All pairs of a crowd are counted, in many blocks, and none twice."""
    r = np.random.default_rng(4)
    x = r.normal(size=12) + r.normal(size=(600, 12)) * 0.25
    x[300:] = r.normal(size=12) + r.normal(size=(300, 12)) * 0.3
    df = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (np.arange(600)[:, None] % 2 == np.arange(600)[None, :] % 2) & ~np.eye(600, dtype=bool)
    want = least_linked(dict(enumerate(range(600))), lambda a, b: near[a, b])
    for cell, rows in ((2048, 8192), (2048, 40), (30, 17), (5, 3)):
        out = embdedup.near_vectors(df, 0.93, cell=cell, block_rows=rows).collect()
        assert {x.vec_id: (x.n_links, x.component_id) for x in out} == {i: (int(near[i].sum()), want[i]) for i in range(600)}


def test_vectors_of_one_id(spark):
    out = [(1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (2, [1.0, 0.01], 0), (3, [0.01, 1.0], 0), (2, [1.0, 0.01], 0)]
    for rows in (out, out[::-1]):
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(2)
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in embdedup.near_vectors(df).collect()) == [(1, 2, 1), (2, 1, 2), (2, 2, 1), (2, 2, 1), (3, 1, 2)]


def test_neighbours_of_each_length(spark):
    r = np.random.default_rng(2)
    rows = [(i, r.normal(size=(8, 3, 20)[i % 3]).tolist()) for i in range(900)] + [(900, [1.0]), (1000, [5.0] * 7), (1050, [1e-300, 2e-300]), (1051, [1e-300, 1e-300]), (1100, [1e300, 2e300])]
    found = {}
    for x in ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), every=50, k=5, block=64).collect():
        found.setdefault(x.query_id, []).append((x["rank"], x.vec_id, x.score))
    length = {i: len(v) for i, v in rows}
    hit = total = 0
    for q, v in rows:
        others = [i for i, n in length.items() if n == length[q] and i != q]
        if q % 50 or not others:
            assert q not in found
            continue
        u = np.array(v) / np.abs(v).max()
        score = {i: float(u @ w / np.linalg.norm(u) / np.linalg.norm(w)) for i, w in ((i, np.array(dict(rows)[i]) / np.abs(dict(rows)[i]).max()) for i in others)}
        best = sorted(others, key=lambda i: (-round(score[i], 12), i))[:5]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(best) + 1)) and all(abs(g[2] - score[g[1]]) < 1e-12 for g in got)
        hit, total = hit + len({g[1] for g in got} & set(best)), total + len(best)
    assert hit / total >= 0.9 and total > 80


def test_a_vector_that_very_many_ids_have(spark):
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=6) if i % 4 else np.ones(6)).tolist()) for i in range(2000)]
    out = {}
    for x in ann.neighbours(spark.createDataFrame(rows + rows[:100], "vec_id long, embedding array<double>"), every=50, k=5, block=64).collect():
        out.setdefault(x.query_id, []).append((x["rank"], x.vec_id))
    assert len(out) == 40
    for q in range(0, 2000, 100):
        assert sorted(out[q]) == list(enumerate([i for i in range(0, 28, 4) if i != q][:5], 1))


def test_fewer_vectors_are_compared_than_there_are(spark):
    r = np.random.default_rng(5)
    points = [(i, v.tolist()) for i, v in enumerate(r.normal(size=(60, 6))[r.integers(0, 60, 4000)] @ r.normal(size=(6, 32)) + r.normal(size=(4000, 32)) * 0.05)]
    df = spark.createDataFrame(points, "pid long, v array<double>")
    x = ann.unit(np.array([p[1] for p in points]))
    lines = ann.fit_curves(x[:1000], 32, 20, 3)
    near = ann.exact_neighbours(df, np.arange(0, 4000, 20), x[::20], 5)
    assert all(set(near[q]) == set(np.argsort(-np.where(np.arange(4000) == q, -9, x @ x[q]))[:5]) for q in range(0, 4000, 400))
    used, width = ann.fit_window(df, lines, near, 4000, 0.95)
    assert used >= 2 and used * 2 * width < 0.5 * 4000
