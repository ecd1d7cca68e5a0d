from collections import Counter

import corpus_pipeline

from thriftlens.llm import mixing, queries

from .test_operators import brute_lines, least_linked, shingle_set


def test_stages(spark, tables):
    """Each stage against what its operator's brute force would keep of its own input."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names, got = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.written(stage(spark, docs, tables), name)
        assert docs.columns == names
        got[name] = before, docs.collect()
    before, after = got["language"]
    assert len(after) >= 0.98 * len(before) and {r["doc_id"] for r in after} <= {r["doc_id"] for r in before}
    before, after = got["line_dedup"]
    want = brute_lines(sorted((r["doc_id"], r["text"]) for r in before), 50)
    assert {r["doc_id"]: r["text"] for r in after} == {k: v for k, v in want.items() if v.strip()}
    before, after = got["near_dedup"]
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in before}
    comp = least_linked(sets, lambda a, b: a and b and 5 * len(a & b) >= 4 * len(a | b))
    assert Counter(r["doc_id"] for r in after) == Counter({i for i, c in comp.items() if c == i})
    before, after = got["mix"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.decisions(spark.createDataFrame(before, docs.schema)).collect()}
    assert Counter(r["doc_id"] for r in after) == Counter({i: n for i, n in copies.items() if n})
    out = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in out) == sorted((r["doc_id"], r["n_tokens"]) for r in corpus_pipeline.run(spark, tables).collect())
    from tokenizers import Tokenizer

    library, texts = Tokenizer.from_file(queries.tokenizer_path()), {r["doc_id"]: r["text"] for r in after}
    for r in out:
        assert r["ids"] == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids


def test_odd_documents(spark, docs, no_docs, tmp_path):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing columns, rows without an id, an empty table."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(queries.tokenizer_path())
    more = docs.limit(0).unionByName(spark.createDataFrame([(20, "a text with some words of its own kind", "en", "z"), (20, "another text under the id that the first one has", None, "z"), (None, "no id here", "en", None)], "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    path = f"{tmp_path}/odd"
    docs.unionByName(more).write.parquet(f"file://{path}/documents.parquet")
    seen = spark.read.parquet(f"file://{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, seen = seen, corpus_pipeline.written(stage(spark, seen, path), name)
        assert seen.columns == docs.columns
        texts = {r["text"] for r in before.collect()}
        if name != "line_dedup":
            assert {r["text"] for r in seen.collect()} <= texts
    out = corpus_pipeline.run(spark, f"file://{path}").collect()
    assert len(out) == seen.count() > 0
    assert Counter(r["n_tokens"] for r in out) == Counter(len(library.encode(r["text"] or "", add_special_tokens=False).ids) for r in seen.collect())
    no_docs.write.parquet(f"file://{tmp_path}/empty/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}/empty").count() == 0
