import datetime as dt

import pytest
from pyspark.sql import functions as F

from thriftlens.plans import accounting, cache, compress, requests
from thriftlens.schema import REQUESTS
from thriftlens.streaming import requests as streams


def log(spark, rows):
    """rows: (id, messages, extras)."""
    names = [c.split()[0] for c in REQUESTS.replace("array<struct<role:string,content:string>>", "a").split(", ")]
    out = []
    for i, messages, extra in rows:
        d = {"request_id": i, "ts": dt.datetime(2026, 1, 1) + dt.timedelta(seconds=i), "api": "chat", "model": "gpt-5", "messages": messages} | extra
        out.append(tuple(d.get(n) for n in names))
    return spark.createDataFrame(out, REQUESTS)


M = [("user", "hello 2026-01-02")]


def replay(spark, rows):
    out = requests.optimized(log(spark, rows)).orderBy("request_id").collect()
    return [r["is_hit"] for r in out], [r["tokens_saved"] for r in out]


def test_replay(spark):
    hits, saved = replay(spark, [
        (1, M, {"prompt_tokens": 3, "total_tokens": 50}), (2, [("user", "hello 2025-11-12 \r\n")], {"total_tokens": 50}), (3, M, {"temperature": 0.5}), (4, M, {"streaming": True}),
        (5, M, {"model": "o3"}), (6, [("developer", "x")], {}), (7, [("system", "x")], {"total_tokens": 0}),
    ])
    assert hits == [False, True, False, False, False, False, True]
    before = len('[{"role":"user","content":"hello [DATE]"}]') // 4
    assert saved == [before - 3, 50, 0, 0, 0, 0, 1]


def test_summary(spark):
    r = requests.run_summary(requests.optimized(log(spark, [(1, M, {}), (2, M, {"total_tokens": 20_000_000})]))).first()
    assert (r.calls, r.hits, r.tokens_saved, r.line) == (2, 1, 20_000_000, "2 calls, 1 cache hits, ~20,000,000 tokens saved (~$20.00)")
    assert requests.run_summary(requests.optimized(log(spark, []))).first().line is None


def test_cache_table(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    assert requests.open_cache(spark, path).count() == 0
    e = lambda *rows: spark.createDataFrame([(k, "m", r, dt.datetime(2026, 1, 1, 0, 0, s)) for k, r, s in rows], "key string, model string, response string, created_at timestamp")
    requests.save_cache(requests.stored(e(("a", "1", 1), ("a", "2", 2), ("b", "3", 1))), path)
    cache = requests.open_cache(spark, path)
    assert {(r.key, r.response, r.hits) for r in cache.collect()} == {("a", "2", 1), ("b", "3", 1)}
    asked = spark.createDataFrame([("a", True), ("a", True), ("c", True), ("b", False)], "key string, cacheable boolean")
    counted = requests.counted(cache, asked)
    assert {(r.key, r.hits) for r in counted.collect()} == {("a", 3), ("b", 1)}
    assert requests.cache_stats(counted).first() == (2, 2)
    assert {(r.key, r.response) for r in requests.looked_up(cache, asked).collect()} == {("a", "2"), ("c", None), ("b", "3")}
    requests.save_cache(requests.merged(counted, e(("a", "9", 9))), path)
    assert {(r.key, r.response, r.hits) for r in requests.open_cache(spark, path).collect()} == {("a", "9", 1), ("b", "3", 1)}
    requests.clear_cache(spark, path)
    assert requests.open_cache(spark, path).count() == 0


def messages(spark, rows):
    return spark.createDataFrame([("s", i, r, c) for i, (r, c) in enumerate(rows)], "session_id string, idx long, role string, content string")


def compressed(spark, rows):
    out = compress.compress_messages(messages(spark, rows), ["session_id"]).orderBy("out_idx").collect()
    array = spark.createDataFrame([(rows,)], "m array<struct<role:string,content:string>>").select(compress.compressed_array(F.col("m")).alias("m")).first()["m"]
    assert [(r.role, r.content) for r in out] == [(r.role, r.content) for r in array]
    return [(r.role, r.content) for r in out]


def test_compress(spark):
    assert compressed(spark, [("system", "a"), ("user", "b"), ("assistant", None)]) == [("system", "a"), ("user", "b"), ("assistant", "")]
    long = [("user", f"Q{i}") for i in range(1)]
    long = [("system", "sys")] + [x for i in range(30) for x in (("user", f"q{i}"), ("assistant", f"a{i}"))]
    out = compressed(spark, long)
    assert len(out) == 22 and out[0] == ("system", "sys") and out[-1] == ("assistant", "a29") and out[2] == ("user", "q20")
    assert out[1] == ("system", f"[Previous conversation summarized: 40 messages, ~{len(' '.join(c for _, c in long[1:41]))} chars]")
    assert len(compressed(spark, [("user", "x" * 8000)])[0][1]) == 6032


def test_compressors(spark):
    compress.register_compressor("star", lambda c: F.lit("*"))
    assert "star" in compress.list_compressors()
    df = spark.createDataFrame([([("user", "x" * 201), ("user", "x" * 200)],)], "m array<struct<role:string,content:string>>")
    out = df.select(compress.compressed_contents(F.col("m"), compress.compressor("star")).alias("m")).first()["m"]
    assert [x.content for x in out] == ["*", "x" * 200]


def test_accounting(spark, tmp_path):
    compress.register_compressor("star", lambda c: F.lit("*"))
    rows = [(1, [("user", "x" * 4000)], {"completion_tokens": 5}), (2, [("user", "y")], {"api": "messages", "completion_tokens": 7}), (3, [("user", "z")], {"api": "other"})]
    df = log(spark, rows)
    s = accounting.stats(df, "star").first()
    before, after = len('[{"role":"user","content":"' + "x" * 4000 + '"}]') // 4, len('[{"role":"user","content":"*"}]') // 4
    small = len('[{"role":"user","content":"y"}]') // 4
    assert tuple(s)[:4] == (2, before + small, after + small, 12) and abs(s.estimated_cost_saved - (before - after) / 1e6 * 2.5) < 1e-12
    failed = accounting.stats(df.withColumn("failed", F.lit(True)), "star").first()
    assert tuple(failed) == (2, before + small, after + small, 0, 0.0)
    path = f"file://{tmp_path}/stats"
    assert tuple(accounting.load_stats(spark, path).first()) == (0, 0, 0, 0, 0.0)
    accounting.save_stats(accounting.stats(df, "star"), path)
    assert accounting.load_stats(spark, path).first().estimated_cost_saved == round((before - after) / 1e6 * 2.5, 4)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.json").write_text("{no")
    assert accounting.load_stats(spark, f"file://{tmp_path}/bad").first().total_requests == 0
    assert accounting.status_line(accounting.stats(df, "star")).first().line.startswith("2 requests, ")
    paths = spark.createDataFrame([("/v1/chat/completions",), ("/v1/messages",), ("/x",)], "p string").select(accounting.api_of(F.col("p")).alias("a")).collect()
    assert [r.a for r in paths] == ["chat", "messages", None]


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, [("user", f"text {i % 5}")], {"completion_tokens": i, "streaming": i % 4 == 0}) for i in range(40)]
    df = log(spark, rows)
    path = str(tmp_path / "log")
    for lo in (0, 20):
        df.where(f"request_id >= {lo} and request_id < {lo + 20}").coalesce(1).write.mode("append").parquet(path)
    stream = lambda: streams.request_log(spark, path)
    assert streams.finished(streams.stats(stream()), "complete", "s").first() == accounting.stats(df).first()
    got = {r.request_id: r.is_hit for r in streams.replayed(stream()).collect()}
    want = {r.request_id: r.is_hit for r in requests.replayed(requests.keyed(df)).where("cacheable").collect()}
    assert got == want and sum(not h for h in got.values()) == 5
    windows = streams.finished(streams.stats_by_window(stream(), "10 seconds", "0 seconds"), "append", "w").collect()
    assert sum(r.total_requests for r in windows) == 30  # the last window is still open


def test_a_popular_key_in_a_stream(spark, tmp_path):
    """One key, 25,000 requests in one micro-batch and out of order, then more of it; its first request misses."""
    path = str(tmp_path / "log")
    n = 25_000
    df = spark.range(n).select(((F.col("id") * 7919 + 12_345) % n).alias("request_id"), F.lit("k").alias("key"))
    rows = df.select("request_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("request_id") / 10)).alias("ts"), F.lit("gpt-5").alias("model"), F.lit(False).alias("streaming"), F.array(F.struct(F.lit("user").alias("role"), F.lit("hello").alias("content"))).alias("messages"))
    rows = rows.withColumn("request_id", F.when(F.col("request_id") < 10, 9 - F.col("request_id")).otherwise(F.col("request_id")))
    rows.coalesce(1).write.mode("append").parquet(path)
    stream = streams.request_log(spark, path, "request_id long, ts timestamp, model string, streaming boolean, messages array<struct<role:string,content:string>>")
    out = streams.replayed(stream)
    assert out.count() == out.select("request_id").distinct().count() == n
    assert [r.request_id for r in out.where("not is_hit").collect()] == [0]
    batch = requests.replayed(requests.keyed(rows))
    assert [r.request_id for r in batch.where("not is_hit").collect()] == [0] and batch.count() == n


def test_replay_of_equal_times_and_repeated_ids(spark):
    rows = [(2, M, {"ts": dt.datetime(2026, 1, 1)}), (1, M, {"ts": dt.datetime(2026, 1, 1)}), (3, M, {}), (4, None, {}), (5, M, {"streaming": True}), (1, [("user", "other")], {})]
    out = requests.replayed(requests.keyed(log(spark, rows))).collect()
    assert sorted((r.request_id, r.is_hit) for r in out) == [(1, False), (1, False), (2, True), (3, True), (4, False), (5, False)]


def test_compressors_of_whole_lists(spark):
    """A compressor that fails leaves what the rules made of a request, and the others as they are."""

    def last_only(ms):
        if ms[-1]["content"] == "bad":
            raise ValueError("no")
        return "nonsense" if ms[-1]["content"] == "odd" else ms[-1:]

    compress.register_list_compressor("last", last_only)
    assert "last" in compress.list_compressors()
    rows = [(i, [("user", f"a{i}" + "x" * 7000), ("user", c)], {}) for i, c in enumerate(("good", "bad", "odd"))]
    out = {r.request_id: [m.content[:40] for m in r.compressed] for r in requests.optimized(log(spark, rows), whole="last").collect()}
    rules = {r.request_id: [m.content[:40] for m in r.compressed] for r in requests.optimized(log(spark, rows)).collect()}
    assert out == {0: ["good"], 1: rules[1], 2: rules[2]} and len(rules[1]) == 2
    assert {r.request_id: [m.content[:40] for m in r.compressed] for r in requests.optimized(log(spark, rows), whole="unknown").collect()} == rules


def test_raw_requests_are_routed(spark):
    raw = [(1, "/v1/chat/completions", '{"model": "gpt-5", "stream": true, "messages": [{"role": "user", "content": "hi"}], "temperature": 0.5}'), (2, "/x/v1/messages?beta", '{"model": "o3", "messages": []}'), (3, "/v1/models", "{}"), (4, "/v1/messages", "{no"), (5, None, None)]
    out = {r.request_id: (r.api, r.model, r.streaming, r.messages and [tuple(m) for m in r.messages], r.temperature) for r in accounting.routed(spark.createDataFrame(raw, "request_id int, path string, body string")).collect()}
    assert out == {1: ("chat", "gpt-5", True, [("user", "hi")], 0.5), 2: ("messages", "o3", False, [], None), 3: (None, None, False, None, None), 4: ("messages", None, False, [], None), 5: (None, None, False, None, None)}
    assert accounting.stats(accounting.routed(spark.createDataFrame(raw, "request_id int, path string, body string")).withColumn("completion_tokens", F.lit(2))).first().total_requests == 3


# --- the replay of a stream, and what a crash leaves


def small_log(spark, path, keys, first=0):
    """A file of requests, one for each key, in a stream's folder."""
    rows = [(first + i, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=first + i), "gpt-5", False, [("user", k)]) for i, k in enumerate(keys)]
    schema = "request_id long, ts timestamp, model string, streaming boolean, messages array<struct<role:string,content:string>>"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return lambda: streams.request_log(spark, path, schema, files_per_trigger=1)


def test_very_many_new_keys_in_one_batch(spark, tmp_path):
    path, n = str(tmp_path / "log"), 200_000
    message = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("content")))
    rows = spark.range(n).select(F.col("id").alias("request_id"), F.timestamp_seconds(F.col("id")).alias("ts"), F.lit("gpt-5").alias("model"), F.lit(False).alias("streaming"), message.alias("messages"))
    rows.unionByName(rows.where("request_id % 1000 = 0").withColumn("request_id", F.col("request_id") + n)).write.parquet(path)
    out = streams.replayed(streams.request_log(spark, path, "request_id long, ts timestamp, model string, streaming boolean, messages array<struct<role:string,content:string>>"))
    assert out.where("not is_hit").count() == n and out.count() == n + n // 1000
    assert out.where("is_hit").agg(F.min("request_id")).first()[0] == n
    # nothing runs in Python for a key; a text goes there only to be composed (NFC), which the JVM's functions can't
    plan = requests.keyed(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Python [") == plan.count("Python [_nfc_all(CASE WHEN exists") == 1


def test_replay_goes_on_from_a_checkpoint(spark, tmp_path, monkeypatch):
    """Stopped after new keys were written and before the rows were: the same rows as without a stop, compaction or not."""
    log, at = str(tmp_path / "log"), str(tmp_path / "replay")
    batches = [["a", "b", "a"], ["b", "c"], ["d", "a", "d"], ["c", "e"], ["f", "f"]]
    want = {}
    for i, keys in enumerate(batches[:3]):
        stream = small_log(spark, log, keys, 10 * i)
    streams.replay(stream(), at, f"{at}/checkpoint", compact=2, availableNow=True).awaitTermination()
    for i, keys in enumerate(batches[3:], 3):
        small_log(spark, log, keys, 10 * i)

    def stop(self, spark, number):
        raise RuntimeError("stopped")

    monkeypatch.setattr(streams.Replay, "_compacted", stop)
    with pytest.raises(Exception, match="stopped"):
        streams.replay(stream(), at, f"{at}/checkpoint", compact=2, availableNow=True).awaitTermination()
    monkeypatch.undo()
    streams.replay(stream(), at, f"{at}/checkpoint", compact=2, availableNow=True).awaitTermination()
    seen = set()
    for i, keys in enumerate(batches):
        for j, k in enumerate(keys):
            want[10 * i + j] = k in seen
            seen.add(k)
    out = streams.Replay(at).out(spark)
    assert {r.request_id: r.is_hit for r in out.collect()} == want and out.count() == len(want)


# --- the cache's buckets


def entries(spark, *rows):
    return spark.createDataFrame([(k, "m", r, dt.datetime(2026, 1, 1, 0, 0, s)) for k, r, s in rows], "key string, model string, response string, created_at timestamp")


def held(spark, path):
    return {(r.key, r.response, r.hits) for r in requests.open_cache(spark, path).collect()}


def test_an_upsert_rewrites_its_own_buckets(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    requests.save_cache(requests.stored(entries(spark, *((f"k{i}", "old", 1) for i in range(3000)))), path)
    before = cache.pointed(spark, path, 0)
    assert len(before) == cache.BUCKETS
    touched = requests.upsert(entries(spark, ("k7", "new", 2)), path)
    after = cache.pointed(spark, path, 1)
    assert len(touched) == 1 and {b for b in before if after[b] != before[b]} == set(touched)
    got = held(spark, path)
    assert len(got) == 3000 and ("k7", "new", 1) in got and ("k8", "old", 1) in got
    assert requests.upsert(entries(spark), path) == [] and held(spark, path) == got
    requests.upsert(entries(spark, ("brand new", "x", 1)), path)
    requests.upsert(entries(spark, ("k9", "y", 1)), path)
    assert len(held(spark, path)) == 3001 and cache.versions(spark, path) == [2, 3]


@pytest.mark.parametrize("step", ["_write", "_point", "_swept"])
def test_a_crash_at_any_step_leaves_a_cache(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/cache"
    requests.save_cache(requests.stored(entries(spark, ("a", "1", 1), ("b", "1", 1))), path)
    old = held(spark, path)
    real = getattr(cache, step)

    def crash(*args):
        if step == "_write":
            real(*args)
        raise RuntimeError("stopped")

    monkeypatch.setattr(cache, step, crash)
    with pytest.raises(RuntimeError):
        requests.upsert(entries(spark, ("a", "2", 2)), path)
    with pytest.raises(RuntimeError):
        requests.save_cache(requests.stored(entries(spark, ("c", "3", 3))), path)
    new = {("c", "3", 1)} if step == "_swept" else old  # named already: only old files are left over
    assert held(spark, path) == new
    monkeypatch.undo()
    requests.upsert(entries(spark, ("a", "4", 4)), path)
    assert held(spark, path) == {x for x in new if x[0] != "a"} | {("a", "4", 1)}


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/cache"
    requests.save_cache(requests.stored(entries(spark, ("a", "1", 1))), path)
    seen = cache.versions(spark, path)
    requests.upsert(entries(spark, ("b", "1", 1)), path)
    monkeypatch.setattr(cache, "versions", lambda *_: seen)
    with pytest.raises(cache.CacheConflict):
        cache._point(spark, path, 1, {})
    monkeypatch.undo()
    assert held(spark, path) == {("a", "1", 1), ("b", "1", 1)}
