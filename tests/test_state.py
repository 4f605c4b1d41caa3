"""Limiter by slices and by keyed state, monthly quota, and sign-ups into several tables."""

import datetime
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.streaming import fanout, limiter, quota, scan, state

DAY0 = datetime.datetime(2024, 1, 1)
HITS = "key string, ts timestamp, event_id long"


def simulated(rows, window_ms):
    """used of each call by a set of milliseconds for each key."""
    held, out = {}, {}
    for key, ts, i in sorted(rows, key=lambda r: (r[1], r[2])):
        now = int((ts - DAY0).total_seconds() * 1000 + 0.5)
        mine = {t for t in held.get(key, set()) if t > now - window_ms}
        out[i] = len(mine) + 1
        held[key] = mine | {now}
    return out


def hits(n, seed, keys, span_ms):
    draw = random.Random(seed)
    return [(draw.choice(keys), DAY0 + datetime.timedelta(milliseconds=draw.randrange(span_ms)), i) for i in range(n)]


@pytest.mark.parametrize("slices", [64, 1, 5])
def test_limiter_slices_against_simulation(spark, monkeypatch, slices):
    monkeypatch.setattr(limiter, "SLICES", slices)
    rows = hits(400, slices, ["hot"] * 4 + ["a", None], 20_000) + hits(60, 9, ["hot"], 40)
    rows = [(k, t, i) for i, (k, t, _) in enumerate(rows)]
    got = {r["event_id"]: r["used"] for r in limiter.limited(spark.createDataFrame(rows, HITS), 3, 2).collect()}
    assert got == simulated(rows, 2000)


def test_a_hot_key_is_cut_into_slices(spark):
    """One user has a third of all calls; no group that is looked at row by row has more than its slice."""
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    calls = events.select(F.when(F.col("event_id") % 3 == 0, "hot").otherwise(F.col("user_id").cast("string")).alias("key"), "ts", "event_id")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    largest = calls.groupBy("key", F.floor(ms / (21_600_000 // limiter.SLICES))).count().agg(F.max("count")).first()[0]
    assert largest < 0.02 * calls.where("key = 'hot'").count()
    plain = calls.alias("a").join(calls.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.unix_millis(F.col("b.ts").cast("timestamp")) < F.unix_millis(F.col("a.ts").cast("timestamp"))) & (F.unix_millis(F.col("b.ts").cast("timestamp")) > F.unix_millis(F.col("a.ts").cast("timestamp")) - 21_600_000), "left")
    want = plain.where("a.event_id % 10 = 0").groupBy("a.event_id").agg((F.count_distinct("b.ts") + 1).alias("want"))
    found = limiter.limited(calls, 2, 21_600).join(want, "event_id")
    assert found.count() == 1000 and found.where("used <> want").count() == 0


def test_vector_form_of_the_limiter():
    draw = np.random.default_rng(1)
    for _ in range(50):
        held = np.unique(draw.integers(0, 50, draw.integers(0, 8)))
        times = np.sort(draw.integers(held[-1] if len(held) else 0, 80, draw.integers(1, 20)))
        seen, want = list(held), []
        for t in times:
            inside = {x for x in seen if x > t - 10}
            want.append(len(inside) + 1)
            seen.append(t)
        assert limiter.used_calls(held, times, 10).tolist() == want


def written(spark, rows, schema, path, files):
    """Rows in order as so many files that follow each other."""
    size = -(-len(rows) // files)
    for n in range(files):
        part = rows[n * size : (n + 1) * size]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_streamed_limiter_equals_batch_and_forgets(spark, tmp_path):
    rows = sorted(hits(300, 3, ["a", "b", "c"], 3_600_000 * 5), key=lambda r: (r[1], r[2]))
    rows += [(f"once{i}", DAY0 + datetime.timedelta(hours=6, minutes=i), 1000 + i) for i in range(60)] + [("last", DAY0 + datetime.timedelta(days=2), 2000), ("last", DAY0 + datetime.timedelta(days=3), 2001)]
    path = written(spark, rows, HITS, f"file://{tmp_path}/hits", 12)
    calls = spark.read.parquet(path)
    stream = limiter.limited_stream(scan.read_stream(spark, path, calls.schema, 1), 5, 600, "10 minutes")
    query = scan.run_to_table(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {r["event_id"]: tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    want = {r["event_id"]: (r["key"], r["ts"], r["event_id"], r["used"], r["remaining"], r["allowed"], r["retry_after"]) for r in limiter.limited(calls, 5, 600).collect()}
    assert got == want and len(got) == len(rows)
    sizes = state.state_rows(query)
    assert sizes[-1] < max(sizes) / 3, sizes


def usage(n, seed):
    draw = random.Random(seed)
    rows = [(draw.randrange(4), DAY0 + datetime.timedelta(minutes=draw.randrange(60 * 24 * 80)), i, draw.choice([1, 1, 1, -1])) for i in range(n)]
    return sorted(rows, key=lambda r: (r[1], r[2]))


def test_quota_batch_and_stream_against_simulation(spark, tmp_path):
    rows, kind = usage(400, 2), "user_id long, ts timestamp, event_id long, amount int"
    used, want = Counter(), {}
    for user, ts, i, amount in rows:
        month = ts.strftime("%Y-%m")
        ok = used[user, month] + amount <= 9
        used[user, month] += amount if ok else 0
        want[i] = (user, month, i, ok, used[user, month], 9 - used[user, month])
    assert not all(w[3] for w in want.values())
    df = spark.createDataFrame(rows, kind)
    assert {r["event_id"]: tuple(r) for r in quota.charged(df, 9).select("user_id", "month", "event_id", "allowed", "used", "remaining").collect()} == want
    path = written(spark, [*rows, (9, DAY0 + datetime.timedelta(days=200), 9000, 1), (9, DAY0 + datetime.timedelta(days=201), 9001, 1)], kind, f"file://{tmp_path}/u", 8)
    stream = quota.charged_stream(scan.read_stream(spark, path, spark.read.parquet(path).schema, 1), 9)
    query = scan.run_to_table(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    got = {r["event_id"]: tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/out").where("event_id < 9000").collect()}
    assert got == want
    sizes = state.state_rows(query)
    assert sizes[-1] < max(sizes), sizes


def test_sign_ups_survive_a_failure_between_tables(spark, tmp_path, monkeypatch):
    users = [(i % 14, f"u{i % 14}@x.org", " ") for i in range(20)] + [(None, "x@y.org", "")]
    source = f"file://{tmp_path}/users"
    for n in range(3):
        spark.createDataFrame(users[n * 7 : n * 7 + 7], "user_id long, email string, display_name string").coalesce(1).write.mode("append").parquet(source)
    stream = lambda: scan.read_stream(spark, source, spark.read.parquet(source).schema, 1)
    out, check = f"file://{tmp_path}/out", f"file://{tmp_path}/check"
    write = fanout.write_batch

    def failing(tables, path, number):
        if number == 1:
            for k in ("profiles", "projects"):
                tables[k].withColumn("batch", F.lit(number).cast("long")).write.mode("append").partitionBy("batch").parquet(f"{path}/{k}")
            raise OSError("after the second table")
        write(tables, path, number)

    monkeypatch.setattr(fanout, "write_batch", failing)
    with pytest.raises(Exception, match="after the second table"):
        fanout.sign_ups(stream(), out, check, "2024-01-01").awaitTermination()
    assert fanout.committed(spark, out) == [0] and spark.read.parquet(f"{out}/profiles").where("batch = 1").count() > 0
    first = {r["user_id"] for r in fanout.read(spark, out, "profiles", fanout.SIGN_UP["profiles"]).collect()}
    assert first == {u for u, _, _ in users[:7] if u is not None}  # what wasn't committed isn't seen
    monkeypatch.setattr(fanout, "write_batch", write)
    fanout.sign_ups(stream(), out, check, "2024-01-01").awaitTermination()
    assert fanout.committed(spark, out) == [0, 1, 2]
    for name, column in (("profiles", "user_id"), ("projects", "project_id"), ("members", "user_id")):
        rows = [r[column] for r in fanout.read(spark, out, name, fanout.SIGN_UP[name]).collect()]
        assert len(rows) == len(set(rows)) == 14, name
