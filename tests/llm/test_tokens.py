"""Alignment, packing and the filter audit, against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from thriftlens.llm import alignment, audit, packing, queries

from .conftest import rows, words

A, B, C = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"))


# --- 11 alignment


def brute_alignment(texts):
    """Rows (n_a, n_b, n_groups, n_links, n_best, count_sum, digest) of texts, by definition."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = {chr(x): x for x in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): x for i, x in enumerate(x for x in range(256) if chr(x) not in letters)}

    def tokens(text):
        if not text:
            return [], []
        left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        pieces = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        right = [(i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()) for i, p in pieces]
        whole = (" " + text).encode()
        return (left, right) if b"".join(x for _, x in left) == whole == b"".join(x for _, x in right) else ([], [])

    def groups(left, right):
        ends = [np.cumsum([len(x) for _, x in side]).tolist() for side in (left, right)]
        out, i, j = [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = i, j
            while i < len(left) and ends[0][i] <= cut:
                i += 1
            while j < len(right) and ends[1][j] <= cut:
                j += 1
            out.append(([t for t, _ in left[x:i]], [t for t, _ in right[y:j]]))
        return out

    held = [tokens(t) for t in texts]
    grouped = [groups(*x) if x[0] else [] for x in held]
    links = [[(x, y) for g in gs for x in g[0] for y in g[1]] for gs in grouped]
    count = Counter(p for ls in links for p in set(ls))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for (left, right), gs, ls in zip(held, grouped, links):
        said = ";".join(f"{','.join(map(str, g[0]))}|{','.join(map(str, g[1]))}" for g in gs)
        out.append((len(left), len(right), len(gs), len(ls), sum(count[p] == top[p[0]] for p in ls), sum(count[p] for p in ls), hashlib.sha256(said.encode()).hexdigest() if said else ""))
    return out


ALIGNED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def odd_texts():
    r = random.Random(5)
    alphabet = "abcXYZ  \n\t.,;:!?'\"-é ßœ“”…你好안ю😀▁́\x00\x85 <s>"
    return [
        None, "", " ", "\n", "a", " a", "a ", "a\n", "a  b", "word. Word, word; (word)", "it's  they're", "<s>", "</s> x", "<|endoftext|>", "x<|endoftext|>y", "<0x41>", "<unk>", "▁x", "a▁b",
        "line one\nline two.\n\nline four", "Überraschung größer naïve café", "你好，世界", "안녕하세요 세계", "Привет, мир!", "😀😀 ok", "a\x00b", "é combining", "a b", "ﬁ ① ½ ²", "\r\nx\r\n", "tab\tx", "x" * 300, "aB" * 200,
        "0x1f3A sha256:9f86d081884c7d65", "http://example.org/a?b=c&d=%20e", "1234567890 12 3.14", "!!!???...", "word." * 50, " lead and trail \n",
        *("".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(150)),
        *(" ".join(r.choice(["the", "cat.", "sat,", "über", "niño", "quick-brown", "x9", "(a)", "A.B."]) for _ in range(r.randrange(1, 40))) for _ in range(100)),
    ]


def test_alignment(spark):
    texts = odd_texts() + ["the same row"] * 3
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, idx string").repartition(5)
    out = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in alignment.aligned(df, A, B).collect()}
    assert [out[i] for i in range(len(texts))] == brute_alignment(texts)


def test_alignment_of_documents(spark, tables):
    df = queries.documents(spark, tables)
    ids, texts = zip(*sorted((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()))
    out = {r["doc_id"]: tuple(r[c] for c in ALIGNED) for r in queries.op11_alignment(spark, tables).collect()}
    assert [out[i] for i in ids] == brute_alignment(texts)


def test_alignment_of_odd_rows(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(alignment, "_LOADED", {})
    out = alignment.aligned(docs, A, B, with_groups=True).collect()
    data = rows()
    want = Counter((r[0], *x) for r, x in zip(data, brute_alignment([r[1] for r in data])))
    assert Counter((r["doc_id"], *(r[c] for c in ALIGNED)) for r in out) == want
    assert all(hashlib.sha256(r["groups"].encode()).hexdigest() == r["groups_sha256"] for r in out if r["groups"])
    assert alignment.aligned(no_docs, A, B).count() == 0


def test_alignment_forgets(monkeypatch):
    """With next to no memory the entries stay right."""
    monkeypatch.setattr(alignment, "ENTRIES", 3)
    al = alignment.Aligner(open(A, "rb").read(), open(B, "rb").read())
    for text in ["one two three four five", "two six seven", "one\ntwo.", "eight"] * 2:
        (e,) = al.entries([text.encode()])
        said = ";".join(al.said[i] for i in e)
        assert hashlib.sha256(said.encode()).hexdigest() == brute_alignment([text])[0][-1]


def test_groups_are_components_and_minimal():
    a, b = alignment.overlap_groups(np.array([2, 3, 7, 9, 10]), np.array([1, 3, 8, 9, 10]))
    assert a.tolist() == [0, 0, 1, 1, 2] and b.tolist() == [0, 0, 1, 1, 2]


# --- 12 packing


def check_plan(tails, windows=0, tiers=packing.TIERS):
    plan = packing.planned(tails, windows, tiers)
    used = defaultdict(list)
    for length, n in tails.items():
        for rank in range(n):
            pieces = plan.of(length, rank)
            at = 0
            for start, k, tier, shift, offset in pieces:
                assert start == at and k > 0
                at += k
                used[tier, rank + shift].append((offset, k))
            assert at == length
    short = 0
    for (tier, nth), parts in used.items():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at <= tiers[tier] and 0 <= nth < plan.sequences[tier]
        short += at < tiers[tier]
    assert short <= 1
    assert len(used) == sum(plan.sequences) - windows and all(t or nth >= windows for t, nth in used)
    return plan


def test_plans_fill_every_sequence():
    r = random.Random(3)
    check_plan({})
    check_plan({3000: 7})
    check_plan({4095: 1000})
    check_plan({2049: 50, 1: 3})
    check_plan({1: 10_000})
    check_plan({257: 100, 255: 1})
    for _ in range(60):
        kinds = r.choice([3, 20, 300])
        check_plan({r.randrange(1, 4096): r.randrange(1, r.choice([2, 9, 60])) for _ in range(kinds)}, r.randrange(3))


def test_a_plan_follows_the_lengths_and_not_the_documents():
    r = random.Random(4)
    one = {k: r.randrange(1, 1000) for k in range(1, 4096)}
    places = lambda p: sum(len(x) for v in p.places.values() for x in v)
    small, large = packing.planned(one), packing.planned({k: n * 1_000_003 for k, n in one.items()})
    assert places(small) < 30_000 and places(large) < 1.5 * places(small)  # a million times the documents


def test_steps_hold_as_many_tokens_each():
    plan = packing.Plan(packing.TIERS, [1000, 300, 70, 513, 100])
    load, tiers = Counter(), defaultdict(set)
    for t, n in enumerate(plan.sequences):
        for i in range(n):
            step = plan.step(t, i)
            load[step, t] += plan.tiers[t]
            tiers[step].add(t)
    assert all(len(x) == 1 for x in tiers.values()) and sorted(tiers) == list(range(len(tiers)))
    for t in range(len(plan.tiers)):
        own = [n for (_, x), n in load.items() if x == t]
        assert max(own) <= packing.STEP and max(own) - min(own) <= plan.tiers[t]


def check_packing(out, docs, tokenizer=C):
    t = Tokenizer.from_file(tokenizer)
    t.no_truncation()
    t.no_padding()
    ids = lambda text: (*t.encode(text or "", add_special_tokens=False).ids, 2)
    crc = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    want, got = Counter((d, ids(text)) for d, text in docs), defaultdict(list)
    filled = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
        filled[r["sequence_id"]].append((r["offset"], r["length"], r["tier"]))
    by_doc = defaultdict(list)
    for (d, x), n in want.items():
        by_doc[d] += [x] * n
    assert set(by_doc) == set(got)
    for d, texts in by_doc.items():
        if len(set(texts)) > 1:  # rows of one id: each text's pieces are there
            assert sum(p[1] for p in got[d]) == sum(map(len, texts))
            continue
        x = texts[0]
        assert all(n == len(x) and c == crc(x[s : s + k]) for s, k, c, n in got[d])
        assert sorted(i for s, k, _, _ in got[d] for i in range(s, s + k)) == sorted(list(range(len(x))) * len(texts))
    assert sorted(filled) == list(range(len(filled)))
    padded = 0
    for parts in filled.values():
        at = 0
        for offset, k, _ in sorted(parts):
            assert offset == at
            at += k
        assert at <= 4096 and len({p[2] for p in parts}) == 1
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded < 4096


def test_packing_of_odd_rows(spark, docs, no_docs):
    pieces = packing.packed(docs, C)
    out = packing.digests(pieces).collect()
    check_packing(out, [(r[0], r[1]) for r in rows()])
    assert packing.digests(packing.packed(no_docs, C)).count() == 0


def test_packing_of_documents(spark, tables):
    out = queries.op12_packing(spark, tables).collect()
    check_packing(out, [(r["doc_id"], r["text"]) for r in queries.documents(spark, tables).collect()])


def test_packed_words_equal_the_library(spark):
    texts = [t for t in odd_texts() if t] + ["<|STARTOFTEXT|> x", "a <|startoftext|>b", "İstanbul ǅ ſ", "don't DON'T 'S x's", "3.5% of 10", "ÉCOLE déjà"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    check_packing(packing.digests(packing.packed(df, C)).collect(), list(enumerate(texts)))


def test_sequences_are_their_pieces(spark):
    df = spark.createDataFrame([(i, " ".join(words(40 + 97 * i, i))) for i in range(60)], "doc_id long, text string").repartition(4)
    pieces = packing.packed(df, C).cache()
    by = defaultdict(dict)
    for r in pieces.collect():
        by[r["sequence_id"]][r["offset"]] = bytes(r["ids"])
    out = packing.sequences(pieces).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in out} == {k: b"".join(v[o] for o in sorted(v)) for k, v in by.items()}
    assert all(r["starts"] == sorted(by[r["sequence_id"]]) and len(r["ids"]) <= 4 * r["tier"] for r in out)
    pieces.unpersist()


# --- 13 filter audit


def brute_audit(docs, labels):
    import re

    least, good, toxic = {}, set(), set()
    for d, text, _ in docs:
        if d is not None:
            least[text or ""] = min(least.get(text or "", d), d)
    for d, q, t in labels:
        if d is not None:
            good |= {d} if q == 1 else set()
            toxic |= {d} if t == 1 else set()
    by = defaultdict(list)
    for d, text, source in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and d > least[t]}
        by[source or ""].append(({k for k, v in fails.items() if v}, d in good, d in toxic))
    out = []
    for part, all_ in by.items():
        own = []
        for order in permutations("ABCDE"):
            for i, f in enumerate(order):
                before = set(order[:i])
                here = [x for x in all_ if f in x[0] and not x[0] & before]
                own.append((part, "".join(order), i + 1, sum(not x[0] & (before | {f}) for x in all_), len(here), sum(f in x[0] and bool(x[0] & before) for x in all_), sum(x[0] == {f} for x in all_), sum(x[1] for x in here), sum(x[2] for x in here)))
        total = Counter()
        for r in own:
            total[r[1][r[2] - 1]] += r[4]
        out += [(*r, total[r[1][r[2] - 1]]) for r in own]
    return out


AUDITED = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("parts", [1, 7])
def test_audit_of_odd_rows(spark, docs, parts):
    data = rows()
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, 1), (15, 1, 1), (100, 1, None), (None, 1, 1), (999, 1, 1), (9, 0, 0)]
    table = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, key string")
    out = audit.audited(docs.repartition(parts), table).collect()
    assert sorted(tuple(r[c] for c in AUDITED) for r in out) == sorted(brute_audit([(r[0], r[1], r[3]) for r in data], labels))


def test_audit_of_nothing(spark, docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audited(no_docs, labels).count() == 0
    assert audit.audited(docs, labels).where("good_lost + toxic_lost > 0").count() == 0


def test_audit_at_the_bounds(spark):
    w = lambda n, different: " ".join(f"w{i % different}" for i in range(n))
    texts = [w(50, 50), w(49, 49), w(100, 65), w(100, 64), "A" + "b" * 19, "AA" + "b" * 38 + "C", "é" * 19 + "Z", "😀" * 18 + "ZZ", "x|y", "", None, "word", "Word", "word"]
    data = [(i, t, ["s", None, ""][i % 3]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = audit.audited(df, spark.createDataFrame([(0, 1, 1)], "doc_id long, quality int, toxic int")).collect()
    assert sorted(tuple(r[c] for c in AUDITED) for r in out) == sorted(brute_audit(data, [(0, 1, 1)]))
