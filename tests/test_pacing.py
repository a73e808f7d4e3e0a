"""Token buckets: the waits of a batch against a loop over calls, and the stream whose rates answers move."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from syncwright.operators import pacing
from syncwright.streaming import pacing as stream
from syncwright.streaming import stateful

LIMITS = {"a": (2, 3), "b": (0.5, 1)}


def calls(seed=7, n=400):
    """(peer, micros, id): bursts and gaps, times that repeat, a peer with most of the calls and one without a limit."""
    rng, now, out = random.Random(seed), 0, []
    for k in range(n):
        now += rng.choice([0, 0, 1_000, 250_000, 500_000, 2_000_000])
        out.append((rng.choice(["a", "a", "a", "a", "b", "c", None]), now, f"{k:04d}"))
    return out


def looped(rows):
    """wait by id: tokens as owed microseconds, one call after the other."""
    owed, last, out = {}, {}, {}
    for peer, at, name in sorted(rows, key=lambda r: (r[1], r[2])):
        rate, burst = LIMITS.get(peer, (pacing.RATE, pacing.BURST))
        each = pacing.step(rate)
        owed[peer] = max(0, owed.get(peer, 0) - (at - last.get(peer, at))) + each
        last[peer] = at
        out[name] = max(0, owed[peer] - burst * each)
    return out


def table(spark, rows):
    return spark.createDataFrame(rows, "peer string, m long, id string").select("peer", F.timestamp_micros("m").alias("at"), "id")


@pytest.mark.parametrize("parts", ["1", "3", "8"])
def test_waits_equal_a_loop_over_calls(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r["id"]: r["wait_micros"] for r in pacing.paced(table(spark, calls()), LIMITS).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = looped(calls())
    assert got == want and 0 in want.values() and max(want.values()) > 10_000_000


def test_calls_without_time_and_tables_without_calls(spark):
    rows = table(spark, [("b", 0, "1"), ("b", 0, "2"), ("b", None, "3"), ("b", 500_000, "4")]).withColumn("extra", F.lit(1))
    got = pacing.released(pacing.paced(rows, LIMITS))
    assert got.columns == ["peer", "at", "id", "extra", "wait_micros", "released_at"]
    assert sorted((r["id"], r["wait_micros"]) for r in got.collect()) == [("1", 0), ("2", 2_000_000), ("3", None), ("4", 3_500_000)]
    assert {r["id"]: r["m"] for r in got.select("id", F.unix_micros("released_at").alias("m")).collect()} == {"1": 0, "2": 2_000_000, "3": None, "4": 4_000_000}
    assert pacing.paced(rows.limit(0), LIMITS).collect() == []


def run(spark, folder, batches):
    """(id, wait, rate) of all calls, each batch by a query of its own that takes up the state."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.prepared(spark)
    try:
        for k, rows in enumerate(batches):
            df = spark.createDataFrame(rows, "peer string, m long, id string, outcome string, retry_after double")
            df.select("peer", F.timestamp_micros("m").alias("at"), "id", "outcome", "retry_after").coalesce(1).write.parquet(f"{folder}/in/{k}")
            traffic = spark.readStream.schema(stream.TRAFFIC).parquet(f"{folder}/in/*")
            q = stream.paced(traffic, LIMITS).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return {r["id"]: (r["wait_micros"], r["rate"]) for r in spark.read.parquet(f"{folder}/out").collect()}


def test_a_stream_without_rejections_equals_the_batch_over_restarts(spark, tmp_path):
    rows = [(*r, None, None) for r in calls(n=240)]
    got = run(spark, tmp_path, [rows[:90], rows[90:]])
    assert {k: w for k, (w, _) in got.items()} == looped(calls(n=240))


def test_answers_move_the_rate(spark, tmp_path):
    s = 1_000_000
    first = [("a", 0, "1", None, None), ("a", 1 * s, "r1", "rejected", None), ("a", 1 * s, "2", None, None), ("a", 10 * s, "r2", "rejected", 30.0), ("a", 12 * s, "3", None, None)]
    # three more rejections meet the floor; then 20 answers raise the rate once, 19 more do not
    second = [("a", (50 + k) * s, f"r{k + 3}", "rejected", 1.0) for k in range(3)] + [("a", 60 * s, f"ok{k}", "accepted", None) for k in range(39)] + [("a", 100 * s, "4", None, None), ("b", 100 * s, "5", None, None)]
    got = run(spark, tmp_path, [first, second])
    # call 2: the rate is halved and the bucket empty, so one token at 1 a second; call 3: shut until 40 s
    assert got["1"] == (0, 2.0) and got["2"] == (s, 1.0) and got["3"] == (28 * s, 0.5)
    assert got["4"] == (0, 2 * 0.125 * 1.25) and got["5"] == (0, 0.5)


def test_a_full_recovery_stops_at_the_limit():
    bucket = stream.Bucket(8, 4)
    bucket.refused(0, 0)
    for _ in range(1000):
        bucket.taken()
    assert bucket.rate == 8 and bucket.accepted == 0
