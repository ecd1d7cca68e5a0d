"""The corpus operators as queries over the synthetic tables, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, ann, audit, bpe, chat, embdedup, langid, linededup, minhash, mixing, packing, sharding, tokenout
from .common import table_path


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, "documents"))


def tokenizer_path(name: str = "byte_bpe_50k.json", variable: str = "THRIFTLENS_BPE") -> str:
    """A public tokenizer's file, by default the byte-level BPE vocabulary; the variable names another file."""
    if os.environ.get(variable):
        return os.environ[variable]
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir), shards=24)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op3_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), words=5, num=85, den=100)


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_vectors(spark.read.parquet(table_path(sf_dir, "embeddings")), threshold=0.93)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(documents(spark, sf_dir), tokenizer_path())


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(spark.read.parquet(table_path(sf_dir, "embeddings")), every=50, k=5)


#: A conversation whose texts hold the template's own control strings.
HARD_TURNS = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok")]


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(table_path(sf_dir, "conversations")).select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame(HARD_TURNS, "conv_id long, turn long, role string, text string")
    return chat.digests(chat.formatted(turns.unionByName(hard)))


def op9_orc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenout.round_trip(documents(spark, sf_dir), tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_deduped(documents(spark, sf_dir), words=linededup.WORDS)


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(documents(spark, sf_dir), tokenizer_path(), tokenizer_path("piece_bpe_32k.model", "THRIFTLENS_PIECES"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.packed(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json", "THRIFTLENS_WORD_BPE")))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(documents(spark, sf_dir), spark.read.parquet(table_path(sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shards": op1_shards,
    "op2_language": op2_language,
    "op3_mixture": op3_mixture,
    "op4_minhash": op4_minhash,
    "op5_near_vectors": op5_near_vectors,
    "op6_bpe": op6_bpe,
    "op7_neighbours": op7_neighbours,
    "op8_chat": op8_chat,
    "op9_orc_tokens": op9_orc_tokens,
    "op10_line_dedup": op10_line_dedup,
    "op11_alignment": op11_alignment,
    "op12_packing": op12_packing,
    "op13_filter_audit": op13_filter_audit,
}

#: By definition: equal lines on a diagonal make a run; a run of 50 words goes from the later place.
_LINE_DEDUP = r"""
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, i - 1 AS ln, ls[i] AS line, trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k,
         len(regexp_extract_all(ls[i], '[^\x20\x09-\x0D]+')) AS w
  FROM split, unnest(range(1, len(ls) + 1)) AS t(i)
),
worded AS (
  SELECT doc_id, ln, k, w, row_number() OVER (PARTITION BY doc_id ORDER BY ln) AS s,
         CAST(sum(w) OVER (PARTITION BY doc_id ORDER BY ln) AS BIGINT) AS upto
  FROM lines WHERE w > 0
),
equal AS (
  SELECT b.doc_id, b.s, a.doc_id AS d, b.s - a.s AS shift, b.w
  FROM worded AS a JOIN worded AS b ON a.k = b.k AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.s < b.s))
),
runs AS (
  SELECT doc_id, d, shift, min(s) AS s, max(s) AS e
  FROM (SELECT *, s - row_number() OVER (PARTITION BY doc_id, d, shift ORDER BY s) AS run FROM equal)
  GROUP BY doc_id, d, shift, run HAVING sum(w) >= 50
),
gone AS (
  SELECT DISTINCT r.doc_id, t.i AS s
  FROM runs AS r, unnest(range(r.s, r.e + 1)) AS t(i)
  JOIN worded AS f ON f.doc_id = r.doc_id AND f.s = r.s
  JOIN worded AS l ON l.doc_id = r.doc_id AND l.s = CASE WHEN r.doc_id = d THEN least(r.e, t.i + shift - 1) ELSE r.e END
  WHERE l.upto - f.upto + f.w >= 50
),
marked AS (
  SELECT l.doc_id, l.ln, l.line,
         CASE WHEN l.w > 0 THEN (CASE WHEN g.s IS NULL THEN 0 ELSE 1 END) END AS hit
  FROM lines AS l LEFT JOIN worded AS w ON w.doc_id = l.doc_id AND w.ln = l.ln
  LEFT JOIN gone AS g ON g.doc_id = w.doc_id AND g.s = w.s
),
carried AS (
  SELECT doc_id, ln, line,
         coalesce(last_value(hit IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS hit
  FROM marked
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text,
       coalesce(c.n_lines, 0) AS n_lines, coalesce(c.n_deleted, 0) AS n_deleted
FROM documents AS d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY ln) FILTER (WHERE hit = 0) AS text,
         count(*) AS n_lines, CAST(sum(hit) AS BIGINT) AS n_deleted
  FROM carried GROUP BY doc_id
) AS c ON c.doc_id = d.doc_id
"""

_NEAR = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], chr(10))) AS s
  FROM words, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles AS a JOIN shingles AS b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM common JOIN sizes AS x ON x.doc_id = a JOIN sizes AS y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reached AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = d.doc_id AS kept
FROM documents AS d LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM reached GROUP BY a) USING (doc_id)
"""

_NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reached AS r JOIN links AS l ON r.b = l.a)
SELECT vec_id, coalesce(n, 0) AS n_links, m AS component_id, m = vec_id AS kept
FROM (SELECT a AS vec_id, min(b) AS m FROM reached GROUP BY a) LEFT JOIN (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a) USING (vec_id)
"""

_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
sized AS (
  SELECT *, length('### ' || role || ': ' || '</turn>') + 1 + length(regexp_replace(t, '(\\*)(### |</turn>)', '\1\1\\\2', 'g')) + length(t) - length(rtrim(t, '\')) AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""

_AUDIT = r"""
WITH docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
words AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM docs),
firsts AS (SELECT t, min(doc_id) AS least FROM docs GROUP BY t),
label AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(l.toxic, false) AS toxic,
         len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
         100 * length(regexp_replace(w.t, '[^A-Z]', '', 'g')) > 5 * length(w.t) AS c,
         regexp_matches(w.t, '[#$%&*|]') AS d, w.doc_id > least AS e
  FROM words AS w JOIN firsts AS f ON f.t = w.t LEFT JOIN label AS l ON l.doc_id = w.doc_id
),
fails AS (SELECT part, good, toxic, concat(CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END, CASE WHEN e THEN 'E' END) AS s FROM flags),
sets AS (SELECT part, s, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic FROM fails GROUP BY part, s),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM letters AS p, letters AS q, letters AS r, letters AS s, letters AS t
  WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5
),
steps AS (
  SELECT filter_order, CAST(i AS INTEGER) AS step, filter_order[i] AS own, filter_order[1:i - 1] AS earlier
  FROM orders, unnest(range(1, 6)) AS u(i)
),
taken AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (WHERE NOT contains(s, own) AND translate(s, earlier, '') = s), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE contains(s, own) AND translate(s, earlier, '') = s), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE contains(s, own) AND translate(s, earlier, '') <> s), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE s = own), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE contains(s, own) AND translate(s, earlier, '') = s), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE contains(s, own) AND translate(s, earlier, '') = s), 0) AS toxic_lost
  FROM sets, steps GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM taken
"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash": _NEAR,
    "op5_near_vectors": _NEAR_VECTORS,
    "op8_chat": _CHAT,
    "op10_line_dedup": _LINE_DEDUP,
    "op13_filter_audit": _AUDIT,
}
