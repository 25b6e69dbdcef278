"""Streams give what the same functions give on batches."""

import json
import os
import random
from datetime import datetime, timezone

from pyspark.sql import functions as F

from codelode.operators import ratelimit
from codelode.streaming import limiter, usage


def drain(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def events(spark, sf):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    return batch, spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def test_tumbling_stream_equals_batch(spark, sf):
    batch, stream = events(spark, sf)
    rows = lambda d: sorted((r.window_start, r.event_type, r.calls, round(r.total, 4)) for r in d.collect())
    got = rows(drain(usage.tumbling(stream, "1 day", ["event_type"]), "tumbling", "complete"))
    assert got == rows(usage.tumbling(batch, "1 day", ["event_type"]))


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([("k", "m", s) for s in (0, 1, 2, 60, 61, 62)], "api_key string, model_name string, s long")
    rows.select("api_key", "model_name", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("api_key string, model_name string, ts timestamp").parquet(f"{tmp_path}/in")
    out = drain(usage.rate_limited(stream, [(2, 60.0)]), "limited", "append")
    assert [r.admitted for r in out.orderBy("ts").collect()] == [True, True, False, True, True, False]


def test_latest_state(spark):
    log = spark.createDataFrame([(1, 1, 1, "running", "a", 1.0), (1, 2, 2, "completed", None, None)], "task_id long, t long, seq long, status string, message string, progress double").withColumn("ts", F.timestamp_seconds("t"))
    r = usage.latest_state(log).first()
    assert (r.status, r.message, r.progress) == ("completed", "a", 100.0)


LIMITS = {"a": [(2, 10.0), (5, 60.0)], "b": [(1, 3.5)], "c": [(3, 1.0)]}


def request_log(n, seed):
    """Bursts, equal times, a model without limits, and a long pause."""
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0, 0, 0.25, 1, 4]) + (500 if i == n // 2 else 0)
        out.append((f"r{i:04d}", rng.choice("aabcd"), t))
    return out


def test_limiter_stream_equals_the_replayed_log(spark, tmp_path):
    """Micro-batches whose rows are out of order, several keys; in the end the state is empty."""
    rows = request_log(240, 4)
    rng, files = random.Random(5), tmp_path / "in"
    files.mkdir()
    late = [*rows]
    for i in range(0, len(late), 6):  # within the watermark's delay
        late[i : i + 6] = rng.sample(late[i : i + 6], len(late[i : i + 6]))
    # the last requests only move the watermark on, past all that waits and then past the state
    parts = [late[i : i + 40] for i in range(0, len(late), 40)] + [[("end", "z", 100_000.0)], [("end2", "z", 300_000.0)], [("end3", "z", 900_000.0)]]
    schema = "request_id string, model_name string, ts timestamp"
    out = limiter.rate_limiter(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(files)), LIMITS, ["k1", "k2"], "1 minute")
    q = out.writeStream.format("memory").queryName("dealt").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        for i, part in enumerate(parts):
            lines = [json.dumps({"request_id": r, "model_name": m, "ts": datetime.fromtimestamp(1_700_000_000 + t, timezone.utc).isoformat()}) for r, m, t in part]
            (tmp_path / f"{i}.json").write_text("\n".join(lines))
            os.rename(tmp_path / f"{i}.json", files / f"{i}.json")
            q.processAllAvailable()
        state = q.lastProgress["stateOperators"][0]
    finally:
        q.stop()
    got = {r.request_id: (r.model_name, r.api_key, round(r.admitted_at.replace(tzinfo=timezone.utc).timestamp() - 1_700_000_000, 6)) for r in spark.table("dealt").where("model_name <> 'z'").select("request_id", "model_name", "api_key", F.col("admitted_at")).collect()}
    want = {}
    for model in "abcd":
        own = sorted((t, r) for r, m, t in rows if m == model)
        want |= {r: (model, k, round(at, 6)) for (_, r), (k, at) in zip(own, ratelimit.admit([t for t, _ in own], LIMITS.get(model, []), ["k1", "k2"]), strict=True)}
    assert got == want and {k for _, k, _ in got.values()} == {"k1", "k2"}
    assert any(at > t + 1 for r, m, t in rows for _, _, at in [got[r]])
    # models a to d are forgotten; what is left is of the one that moves the watermark
    assert state["numRowsTotal"] <= 6, state


def test_replay_equals_admit(spark):
    rows = request_log(300, 8)
    d = spark.createDataFrame([(r, m, 1_700_000_000 + t) for r, m, t in rows], "request_id string, model_name string, s double").withColumn("ts", F.timestamp_seconds("s"))
    limits = spark.createDataFrame([(m, n, p) for m, own in LIMITS.items() for n, p in own], "model_name string, max_requests int, period_seconds double")
    got = {r.request_id: (r.api_key, round(r.admitted_at - 1_700_000_000, 4)) for r in ratelimit.replay(d, limits, ["k1", "k2", "k3"]).collect()}
    for model in "abcd":
        own = sorted((t, r) for r, m, t in rows if m == model)
        want = ratelimit.admit([1_700_000_000 + t for t, _ in own], LIMITS.get(model, []), ["k1", "k2", "k3"])
        assert [got[r] for _, r in own] == [(k, round(at - 1_700_000_000, 4)) for k, at in want]


def test_turns_begin_anew_after_a_pause():
    r = ratelimit.Rotation([(1, 1.0)], ["a", "b", "c"])
    assert [r.admit(t)[0] for t in (0, 0, 10_000_000, 10_000_000, 10_000_000)] == ["a", "b", "a", "b", "c"]
    s = ratelimit.Rotation([(1, 1.0)], ["a", "c", "d"])
    s.restore(*r.state())
    assert s.admit(10_000_000) == ("d", 10_000_000)


def test_limit_state_of_idle_keys_goes(spark, tmp_path):
    files = tmp_path / "in"
    files.mkdir()
    out = usage.rate_limited(spark.readStream.schema("api_key string, model_name string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(files)), [(2, 60.0)], "1 second")
    q = out.writeStream.format("memory").queryName("limited_idle").outputMode("append").start()
    try:
        for i, (k, s) in enumerate([("a", 0), ("b", 30), ("c", 5000), ("c", 9000), ("c", 9001)]):
            (files / f"{i}.json").write_text(json.dumps({"api_key": k, "model_name": "m", "ts": datetime.fromtimestamp(1_700_000_000 + s, timezone.utc).isoformat()}))
            q.processAllAvailable()
        assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1
    finally:
        q.stop()
