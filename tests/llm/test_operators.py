import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from thriftlens.llm.common import components
from thriftlens.llm import ann, bpe, chat, embdedup, langid, linededup, minhash, mixing, queries, sharding, shingles, tokenout, wordcache

from .conftest import rows


def collected(df):
    return [r.asDict() for r in df.collect()]


def test_sql(agrees):
    for name, sql in queries.ORACLE_SQL.items():
        agrees(queries.QUERIES[name], sql)


@pytest.mark.parametrize("chunk,parts", [(1, 3), (7, 5), (1000, 4), (1000, 1)])
def test_components(spark, chunk, parts):
    import random

    r = random.Random(chunk)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)] + [(7, 7)]
    sets = {i: i for x in links for i in x if x[0] != x[1]}
    pairs = {frozenset(x) for x in links}
    want = least_linked(sets, lambda a, b: frozenset((a, b)) in pairs)
    out = components(spark.createDataFrame(links, "a long, b long").repartition(parts), chunk=chunk).collect()
    assert len(out) == len(want) and {x["node"]: x["comp"] for x in out} == want


# --- 1 sharding


def test_sharding(docs):
    out = collected(sharding.sharded(docs, 5))
    assert len(out) == len(rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r)
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 5
    assert all(sorted(x["slot"] for x in g) == list(range(len(g))) for g in by.values())
    order = sorted(out, key=lambda r: (r["shard"], r["slot"]))
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
    assert ids == sorted(ids)  # contiguous, nulls first


def test_sharding_of_many_is_even(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 50 as int))").alias("text"))
    sizes = Counter()
    for r in sharding.sharded(df, 24).collect():
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2 * 58


def test_no_shards(no_docs):
    assert sharding.sharded(no_docs).count() == 0


# --- 2 language


def texts(spark, n=600):
    kinds = {"en": ["the", "then", "with", "where", "thing"], "de": ["über", "schön", "nicht", "ich", "auch"], "es": ["niño", "llama", "que", "ción", "está"]}
    out = []
    for i in range(n):
        lang = sorted(kinds)[i % 3]
        out.append((i, " ".join(kinds[lang][(i * 7 + j * j) % 5] for j in range(3 + i % 40)), lang))
    return spark.createDataFrame(out, "doc_id long, text string, lang string")


def test_language_held_out_accuracy(spark):
    df = texts(spark)
    out = {r["doc_id"]: r for r in langid.identify(df).collect()}
    right = [out[r["doc_id"]]["lang_pred"] == r["lang"] for r in df.collect() if out[r["doc_id"]]["held_out"]]
    assert len(right) > 100 and np.mean(right) > 0.98
    for r in out.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_learns_nothing_from_held_out_rows(spark):
    df = texts(spark, 300)
    swapped = df.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang")))
    a, b = langid.fit(df, ~langid.held_out()), langid.fit(swapped, ~langid.held_out())
    assert a.langs == b.langs and np.array_equal(a.table, b.table) and a.cut == b.cut


def test_language_of_odd_texts(docs, no_docs):
    out = collected(langid.identify(docs))
    assert len(out) == len(rows())
    for r in out:
        if r["doc_id"] in (4, 5, 6, 14):
            assert (r["lang_pred"], r["score"], r["accepted"]) == (langid.UNKNOWN, 0.0, False)
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 15}) == 1
    assert langid.identify(no_docs).count() == 0 and langid.accepted_only(no_docs).count() == 0
    kept = langid.accepted_only(docs)
    assert kept.columns == docs.columns and not {4, 5, 6, 14} & {r["doc_id"] for r in kept.collect()}


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert langid.identify(df).first()["lang_pred"] == "und"


def test_prediction_is_the_softmax_of_the_mean_embedding(spark):
    m = langid.train([langid.sampled(t.encode(), lang, np.random.default_rng(1)) for t, lang in (("aaa bbb", "x"), ("ccc ddd", "y"))] * 20)
    ids = langid.gram_ids("aaa bbb".encode())
    z = (np.mean([m.table[i] for i in ids], axis=0)[:-1] + m.bias) / m.temperature
    assert np.allclose(m.scores([b"aaa bbb"])[0][0], np.exp(z) / np.exp(z).sum(), atol=1e-5)


def test_language_rejects_what_it_never_learned(spark):
    """Texts in other languages, letters by chance and digests go; held-out documents stay."""
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = np.random.default_rng(1)
    letters = lambda n: "".join(chr(97 + x) if x < 26 else " " for x in r.integers(0, 30, n))
    junk = ["你好，世界。今天的天气非常好，我们去公园散步吧。" * 2, "Привет, как дела? Сегодня хорошая погода, и мы идём гулять.", "qqqqqqqqqqqq", "zxq wvk jjq pqx vvkz", "カタカナとひらがなの文章です", "Αυτό είναι ένα κείμενο στα ελληνικά"]
    junk += [hashlib.sha256(str(i).encode()).hexdigest() for i in range(40)] + [letters(60) for _ in range(40)] + [letters(3000)]
    both = df.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string"))
    out = langid.identify(both).collect()
    gone = {x["doc_id"] for x in out if x["doc_id"] < 0 and not x["accepted"]}
    assert {-1 - i for i in range(6)} <= gone and len(gone) >= 0.95 * len(junk)
    held = [x for x in out if x["doc_id"] >= 0 and x["held_out"]]
    assert np.mean([x["accepted"] for x in held]) >= 0.99 and len(held) > 250
    lang = {x["doc_id"]: x["lang"] for x in df.select("doc_id", "lang").collect()}
    assert np.mean([x["lang_pred"] == lang[x["doc_id"]] for x in held]) >= 0.98
    m = langid.fit(df, ~langid.held_out())
    assert 1e-3 < m.temperature < 50


def test_the_sample_doesn_t_depend_on_the_partitioning(spark):
    rows_ = [(i % 150, f"{'the then with' if i % 2 else 'nicht auch ich'} {i}", "en" if i % 2 else "de") for i in range(400)]
    models = [langid.fit(spark.createDataFrame(x, "doc_id long, text string, lang string").repartition(n), F.lit(True)) for x, n in ((rows_, 1), (rows_[::-1], 5))]
    assert np.array_equal(models[0].table, models[1].table) and models[0].cut == models[1].cut


def test_every_language_is_learned(spark):
    rows_ = [(i, " ".join(chr(97 + i % 26) * 3 + chr(97 + i // 26 % 12) for _ in range(6)), f"l{i % 312:03}") for i in range(1248)]
    assert len(langid.fit(spark.createDataFrame(rows_, "doc_id long, text string, lang string"), F.lit(True)).langs) == 312


# --- 3 mixing


def fill(sizes, weights, total, most=2):
    """Targets by rounds: shares by weight, what is above its limit is shared anew."""
    left, out = set(sizes), {}
    while left:
        share = (total - sum(out.values())) / sum(weights[s] for s in left)
        full = {s for s in left if share * weights[s] > most * sizes[s]}
        if not full:
            return out | {s: share * weights[s] for s in left}
        out |= {s: float(most * sizes[s]) for s in full}
        left -= full
    return out


def check_mix(df):
    out = collected(mixing.mixture(df))
    src = defaultdict(list)
    by_id = defaultdict(Counter)
    for r in df.select("doc_id", "source").collect():
        by_id[r["doc_id"]][r["source"]] += 1
    names = sorted({s for c in by_id.values() for s in c}, key=lambda s: (s is None, s or ""))
    per = {r["source"]: r["n"] or 0 for r in df.groupBy("source").agg(F.sum(F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))).alias("n")).collect()}
    want = fill(per, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(per.values()))
    for r in out:
        possible = [s for s in by_id[r["doc_id"]] if per[s] == r["source_size"]]
        assert any(math.isclose(want[s], r["target"], rel_tol=1e-9, abs_tol=1e-6) for s in possible)
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        src[possible[0]].append(r)
    for s, group in src.items():
        assert abs(sum(r["taken"] for r in group) - want[s]) <= max(r["size"] for r in group) + 1e-6
    return sorted((r["doc_id"] is None, r["doc_id"] or 0, r["taken"]) for r in out)


def test_mix(docs):
    assert check_mix(docs) == check_mix(docs.repartition(5))


def test_mix_of_a_hot_source(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"), F.expr("repeat('w ', cast(1 + id % 90 as int))").alias("text"))
    check_mix(df)


def test_mix_is_fair(spark):
    """Over many draws a document's expected words are its share; copies are only the integers around it."""
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", "w " * (1 + i % 5)) for i in range(600)], "doc_id long, source string, text string")
    out = mixing.mixture(df).where("target < 2 * source_size").groupBy("source_size").agg((F.sum("copies") / F.count("*")).alias("mean"), F.first(F.col("target") / F.col("source_size")).alias("share"), F.min("copies").alias("lo"), F.max("copies").alias("hi")).collect()
    for r in out:
        assert abs(r["mean"] - r["share"]) < 0.08 and r["lo"] >= math.floor(r["share"]) and r["hi"] <= math.ceil(r["share"])


def test_mixed_rows(docs, no_docs):
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    want = Counter()
    for r in mixing.decisions(docs).collect():
        want[r["doc_id"]] += r["copies"]
    assert n == Counter({k: v for k, v in want.items() if v})
    assert mixing.mixture(no_docs).count() == 0 and mixing.mixed(no_docs).count() == 0
    nothing = no_docs.sparkSession.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [(r["taken"], r["target"]) for r in mixing.mixture(nothing).collect()] == [(0, 0.0), (0, 0.0)]


# --- 4 MinHash


def shingle_set(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def least_linked(sets, linked):
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if linked(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def check_near(df, num, den, plan=None):
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in df.collect() if r["doc_id"] is not None}
    want = least_linked(sets, lambda a, b: a and b and den * len(a & b) >= num * len(a | b))
    out = collected(minhash.near_duplicates(df, num=num, den=den, plan=plan))
    assert len(out) == df.count()
    for r in out:
        if r["doc_id"] is None:
            assert r["component_id"] is None and not r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    return want


def test_near_duplicates(docs):
    want = check_near(docs, 85, 100)
    assert want[2] == want[3] == want[119] == 1 and want[8] == 7


def test_a_large_family_in_blocks(spark):
    """Copies that each change a few words of one text: most are linked only through the text itself."""
    import random

    base = [f"b{i}" for i in range(150)]
    r, out = random.Random(2), []
    for i in range(160):
        w = list(base)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = f"x{r.random()}"
        out.append((1000 - i, " ".join(w)))
    df = spark.createDataFrame(out, "doc_id long, text string")
    check_near(df, 85, 100, minhash.Plan(5, 85, 100, block=16, pivots=4))
    check_near(df, 85, 100, minhash.Plan(5, 85, 100, most=2000, pivots=1))


def test_exactly_at_the_threshold(spark):
    a, b = [f"a{i}" for i in range(21)], [f"a{i}" for i in range(19)]  # 17 and 15 shingles, 15 shared: 0.882
    c = [f"a{i}" for i in range(17)]  # 13 of 17 shared: 0.76
    df = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c))], "doc_id long, text string")
    assert check_near(df, 15, 17) == {1: 1, 2: 1, 3: 3}
    assert check_near(df, 90, 100) == {1: 1, 2: 2, 3: 3}


def test_one_of_each_stays(docs, no_docs):
    kept = minhash.first_of_each(docs)
    assert kept.columns == docs.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    assert ids[1] == 1 and ids[15] == 1 and ids[7] == 1 and not {2, 3, 8, 100, 119} & set(ids) and {4, 5, 6, 9, 10} <= set(ids)
    assert minhash.near_duplicates(no_docs).count() == 0 and minhash.first_of_each(no_docs).count() == 0


def test_blocks_of_a_comparison_agree():
    plan = minhash.Plan(2, 1, 2)
    texts = [b"a b c d", b"a b c e", b"x y z", b"q", b"A B C D", b"q"]
    a, b = minhash.compare(np.arange(6), [shingles.shingle_set(t, 2) for t in texts], plan)
    assert sorted(map(tuple, map(sorted, zip(a, b)))) == [(0, 1), (0, 4), (3, 5)]


def test_long_words_are_told_apart():
    a, b, n = b"a" * 4096, b"b" * 4096, 1 << 22
    one, two = shingles.words(a + b + b" x"), shingles.words(b + a + b" x")
    assert one[0] != two[0] and one[1] == two[1] and len(shingles.words(b"w " * n)) == n
    joined = shingles.word_runs([b"p q", b"", b" ", b"r"])
    assert [len(w) for w in joined] == [2, 0, 0, 1] and joined[3][0] == shingles.words(b"r")[0]


# --- 5 vectors


def vectors(spark, n=700, seed=1, d=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(n, d))
    for i in range(0, n - 1, 5):
        base[i + 1] = base[i] + r.normal(size=d) * 0.12
    base[50:90] = base[50]  # one very frequent vector
    out = [(i, base[i].tolist(), None if i % 97 == 3 else i % 3 if i > 300 else 0) for i in range(n)]
    out += [(n, None, 0), (n + 1, [0.0] * d, 0), (n + 2, [float("nan")] * d, 0), (n + 3, [1.0, None] + [0.0] * (d - 2), 0), (n + 4, [], 0), (n + 5, [float("inf")] * d, 0), (n + 6, [1e-300] * d, 1), (n + 7, [1e-300] * d, 1), (n + 8, [1.0, 2.0], 1), (None, [1.0] * d, 1)]
    return spark.createDataFrame([(*x, "clash", "clash") for x in out], "vec_id long, embedding array<double>, label int, m string, own string")


def good(v):
    return v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


@pytest.mark.parametrize("cell,block", [(40, 512), (512, 1 << 18)])
def test_near_vectors(spark, cell, block):
    df = vectors(spark)
    rows_ = df.collect()
    unit = {r["vec_id"]: (r["label"], np.array(r["embedding"]) / np.abs(r["embedding"]).max()) for r in rows_ if r["vec_id"] is not None and r["label"] is not None and good(r["embedding"])}
    unit = {k: (label, v / np.linalg.norm(v)) for k, (label, v) in unit.items()}
    links = lambda a, b: a[0] == b[0] and len(a[1]) == len(b[1]) and a[1] @ b[1] >= 0.93
    comp = least_linked(unit, links)
    n = {i: sum(links(unit[i], unit[j]) for j in unit if j != i) for i in unit}
    out = embdedup.near_vectors(df, 0.93, cell=cell, block_values=block).collect()
    assert len(out) == len(rows_) and sum(n.values()) > 1000
    for r in out:
        i = r["vec_id"]
        if i is None:
            assert r["component_id"] is None and not r["kept"] and r["n_links"] == 0
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (n.get(i, 0), comp.get(i, i), comp.get(i, i) == i)


def test_no_vectors(spark):
    assert embdedup.near_vectors(vectors(spark).limit(0)).count() == 0 and ann.neighbours(vectors(spark).limit(0)).count() == 0


# --- 6 BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


def test_bpe(docs, no_docs, library):
    out = bpe.encoded(docs, queries.tokenizer_path(), with_ids=True).collect()
    assert len(out) == len(rows())
    by_id = {r[0]: r[1] or "" for r in rows() if r[0] is not None}
    for r in out:
        if r["doc_id"] in by_id:
            ids = library.encode(by_id[r["doc_id"]], add_special_tokens=False).ids
            assert (r["ids"], r["n_tokens"]) == (ids, len(ids))
            assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.encoded(no_docs, queries.tokenizer_path()).count() == 0


def test_bpe_by_chance(library):
    import random

    v, r = bpe.vocabulary(open(queries.tokenizer_path(), "rb").read()), random.Random(4)
    parts = ["a", "tion", " the", "  ", "\n", "'s", "'T", "é", "²", "ß", "你", "\U0001f600", "123", "!!", " <|endoftext|>", "\x85", "\xa0", "́", "zq", "=====", "\t"]
    for _ in range(3000):
        t = "".join(r.choice(parts) for _ in range(r.randrange(12)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert v.encode(t).tolist() == ids and v.encode_all([t.encode()])[0].tolist() == ids and v.decode(np.array(ids, np.int32)).decode() == t


# --- 7 neighbours


def test_neighbours(spark):
    df = vectors(spark, 1500, 3)
    rows_ = df.where("vec_id is not null").collect()
    ok = {r["vec_id"]: np.array(r["embedding"]) for r in rows_ if good(r["embedding"]) and len(r["embedding"]) == 16}
    ids = sorted(ok)
    unit = np.stack([ok[i] / np.abs(ok[i]).max() for i in ids])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    out = defaultdict(list)
    for r in ann.neighbours(df, every=10, k=5, block=128).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for n, q in enumerate(ids):
        if q % 10:
            assert q not in out
            continue
        s = unit @ unit[n]
        got = sorted(out[q])
        assert [g[0] for g in got] == [1, 2, 3, 4, 5] and q not in {g[1] for g in got}
        assert all(abs(s[ids.index(v)] - x) < 1e-9 for _, v, x in got) and [(-x, v) for _, v, x in got] == sorted((-x, v) for _, v, x in got)
        best = [ids[j] for j in np.lexsort((ids, -np.round(s, 12))) if ids[j] != q][:5]
        hit += len(set(best) & {g[1] for g in got})
        total += 5
    assert hit / total >= 0.9
    copies = sorted(out[60])
    assert [c[1] for c in copies] == [50, 51, 52, 53, 54]  # ties go to the least ids of a crowd of copies


def test_few_candidates(spark):
    df = spark.createDataFrame([(50, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in ann.neighbours(df).orderBy("rank").collect()] == [(50, 1, 1), (50, 2, 2)]
    assert ann.neighbours(df.where("vec_id = 50")).count() == 0 and ann.neighbours(df.where("vec_id <> 50")).count() == 0


def test_hilbert_neighbours_touch():
    for d, bits in ((2, 4), (3, 3), (5, 2)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * d), -1).reshape(-1, d)
        key = ann.hilbert(cells, bits)
        assert sorted(key.tolist()) == list(range(len(cells)))
        steps = np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1)
        assert (steps == 1).all()


# --- 8 chat


def test_chat_round_trip_by_chance():
    import random

    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice(["\\", "### ", "</turn>", "\n", "a", ": ", "#", "</turn", "é"]) for _ in range(r.randrange(9)))
        role = "".join(r.choice(["user", "assistant", ":", " ", "\\", "\n", "### "]) for _ in range(r.randrange(4)))
        line = chat.render(role, t)
        assert chat.parse(line + line) == [(role, t)] * 2
        p = chat.Parser()
        assert [x for c in line for x in p.feed(c)] == [(role, t)] and p.done()
    with pytest.raises(ValueError):
        chat.parse("### user: x</turn>")


def test_chat(spark):
    turns = [(1, 2, "assistant", "b"), (1, 1, "user", "a </turn>"), (1, None, "system", None), (None, 1, None, "x"), (2, 1, "assistant", "t"), (2, 1, "assistant", "t"), (3, 1, "user", "y" * 300_000), *[(4, i, "assistant", f"é{i}") for i in range(300)], *queries.HARD_TURNS]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, segment string")
    out = {r["conv_id"]: r for r in chat.digests(chat.formatted(df)).collect()}
    by = defaultdict(list)
    for c, n, role, text in sorted(turns, key=lambda t: (t[1] is not None, t[1] or 0)):
        by[c].append((role or "", text or ""))
    assert set(out) == set(by)
    for c, ts in by.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = out[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(ts), sha("".join(f"{a}\n{b}\n" for a, b in ts)), len(loss), sha(loss))
        assert r["formatted_chars"] == sum(len(chat.render(a, b)) for a, b in ts)
    assert chat.digests(chat.formatted(df.limit(0))).count() == 0


# --- 9 token files


def test_token_files(spark, docs, no_docs, library, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenout.write_tokens(docs, queries.tokenizer_path(), path)
    out = tokenout.read_back(spark, path).orderBy("start").collect()
    assert len(out) == len(rows())
    want = sorted(((r[0] is not None, r[0] or 0), r[1] or "") for r in rows())
    at, texts_ = 0, defaultdict(Counter)
    for r in out:
        assert r["start"] == at
        at += r["n_tokens"]
        texts_[r["doc_id"]][r["n_tokens"], r["ids_crc32"]] += 1
    ids = [(-1 if r["doc_id"] is None else r["doc_id"]) for r in out]
    assert ids == sorted(ids)
    for (known, i), text in want:
        tokens = np.array([*library.encode(text, add_special_tokens=False).ids, tokenout.END], "<u4")
        assert texts_[i if known else None][len(tokens), zlib.crc32(tokens.tobytes())] > 0
    one = tokenout.read_tokens(spark, path).where("doc_id = 7").collect()
    assert [r["ids"] for r in one] == [library.encode("one two", add_special_tokens=False).ids + [tokenout.END]]
    assert tokenout.round_trip(no_docs, queries.tokenizer_path()).count() == 0


def test_chunks_hold_whole_pieces(library):
    import random

    e, r = tokenout.Encoder(open(queries.tokenizer_path(), "rb").read()), random.Random(5)
    parts = ["a", "tion", "é", " ", "\n", ",", "1", "'", "s", "'s", "ß", "_", "-", "23", "½", "\t", ". ", "x "]
    texts_ = ["".join(r.choice(parts) for _ in range(r.randrange(14))) for _ in range(4000)] + ["", "a<|endoftext|>", "a.\nb c", "end."]
    for t, ids in zip(texts_, e.encode([t.encode() for t in texts_])):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    longer = ["a" * n + c for n in range(20) for c in "abé"] + ["x" * 16, "x" * 17, "x" * 40 + "y", "y" + "x" * 40] * 2
    for t, ids in zip(longer, e.encode([t.encode() for t in longer])):
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
    e.words.used = wordcache.POOL + 1  # memory full
    assert e.encode([b"a b"])[0].tolist() == library.encode("a b", add_special_tokens=False).ids


def test_a_word_is_known_by_its_bytes():
    """Words in one slot, with every hash alike but for the bytes themselves, are told apart."""
    words_ = [b" abcdefg", b" abcdefh", b" abcdefgh", b" abcdefgi", b" abcdefghijklmno", b" abcdefghijklmnp", b" abcdefghijklmnopq", b" abcdefghijklmnopr"]
    b = np.frombuffer(b"".join(words_), np.uint8)
    lengths = np.array([len(w) for w in words_])
    keys = wordcache.packed(b, np.cumsum(lengths) - lengths, lengths)
    assert len({tuple(k) for k in keys.T.tolist()}) == len(words_)
    assert [keys[0, 0].tobytes(), keys[:, 4].tobytes()] == [words_[0], words_[4]]


def test_files_have_indexes_filters_and_run_lengths(spark, tmp_path):
    """What the ORC files hold beside the rows, and that a reader of one document skips the other row groups."""
    path = f"file://{tmp_path}/tokens"
    df = spark.range(6000).select((F.col("id") * 2 + (1 << 40)).alias("doc_id"), F.expr("concat('text number ', id)").alias("text"))
    tokenout.write_tokens(df, queries.tokenizer_path(), path)
    files = sorted(tmp_path.glob("tokens/*.orc"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    sarg = jvm.org.apache.hadoop.hive.ql.io.sarg
    columns = spark.sparkContext._gateway.new_array(jvm.java.lang.String, 1)
    columns[0] = "doc_id"

    def read(reader, key):
        """Rows that a reader of one doc_id takes from a file."""
        wanted = sarg.SearchArgumentFactory.newBuilder().startAnd().equals("doc_id", getattr(sarg, "PredicateLeaf$Type").LONG, key).end().build()
        rows, batch, n = reader.rows(reader.options().searchArgument(wanted, columns)), reader.getSchema().createRowBatch(), 0
        while rows.nextBatch(batch):
            n += batch.count()
        return n

    readers = [jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), jvm.org.apache.orc.OrcFile.readerOptions(conf)) for f in files]
    assert sum(r.getNumberOfRows() for r in readers) == 6000
    for reader in readers:
        assert reader.getRowIndexStride() == 1000
        at = reader.getSchema().getFieldNames().indexOf("doc_id") + 1
        for stripe in reader.getStripes():
            footer = reader.rows().readStripeFooter(stripe)
            streams = [(x.getColumn(), x.getKind().toString()) for x in footer.getStreamsList()]
            assert (at, "ROW_INDEX") in streams and (at, "BLOOM_FILTER_UTF8") in streams
            assert footer.getColumns(at).getKind().toString() == "DIRECT_V2"  # integers are run-length encoded
        stats = reader.getStatistics()[at]
        assert (stats.getMaximum() - stats.getMinimum()) // 2 + 1 == reader.getNumberOfRows()  # a file is a stretch of ids
    assert 0 < sum(read(r, (1 << 40) + 2468) for r in readers) <= 1000  # one row group of one file
    assert sum(read(r, (1 << 40) + 2469) for r in readers) == 0  # inside the bounds of a row group, but not in its Bloom filter


# --- 10 lines


def brute_lines(docs_, words):
    """Delete every line of every passage of `words` words or more that stood before, however long, but for lines that the first place holds too."""
    first, out = {}, {}
    for key, text in sorted(docs_):
        s = [(n, x.strip(" \t\n\r\x0b\x0c"), len(x.encode().split())) for n, x in enumerate(text.split("\n")) if x.encode().split()]
        gone, kept, dropping = set(), [], False
        for i in range(len(s)):
            total = 0
            for j in range(i, len(s)):
                total += s[j][2]
                if total >= words:
                    p = hash(tuple(x[1] for x in s[i : j + 1]))
                    if p in first:
                        k, b = first[p]
                        gone |= {s[x][0] for x in range(max(i, b + 1) if k == key else i, j + 1)}
                    else:
                        first[p] = key, j
        for n, line in enumerate(text.split("\n")):
            dropping = n in gone if line.strip(" \t\n\r\x0b\x0c") else dropping
            kept += [] if dropping else [line]
        out[key] = "\n".join(kept)
    return out


def check_lines(df, words=50):
    texts_ = {(-1 if r["doc_id"] is None else r["doc_id"]): r["text"] for r in df.collect() if r["text"]}
    want = brute_lines(sorted(texts_.items()), words)
    out = collected(linededup.line_deduped(df, words))
    for r in out:
        key = -1 if r["doc_id"] is None else r["doc_id"]
        if r["text"]:
            assert r["text"] == want[key] and (r["n_deleted"] > 0) == (want[key] != texts_[key])
        elif r["text"] is None:
            assert (r["n_lines"], r["n_deleted"]) == (0, 0)
    return want


def test_line_dedup(docs):
    want = check_lines(docs)
    texts_ = {r[0]: r[1] for r in rows()}
    assert want[10] == texts_[10] and want[12] == "" and want[100] == "" and want[2] == texts_[2]
    assert texts_[12] not in want[11] and want[11].startswith(texts_[11].split("\n\n")[0])


def test_line_dedup_by_chance(spark):
    import random

    r = random.Random(8)
    pool = [" ".join(f"p{r.randrange(30)}" for _ in range(r.randrange(1, 6))) for _ in range(12)] + ["", "  "]
    out = [(i, "\n".join(r.choice(pool) for _ in range(r.randrange(1, 25)))) for i in range(120)] + [(500, "\n".join(["same line here"] * 12))]
    check_lines(spark.createDataFrame(out, "doc_id long, text string"), 8)


def test_lines_that_go(docs, no_docs):
    left = linededup.without_repeats(docs)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert 12 not in ids and 100 not in ids and {1, 4, 5, 6, 10, 11, 15} <= ids
    assert linededup.line_deduped(no_docs).count() == 0 and linededup.without_repeats(no_docs).count() == 0
