"""Echoes and retries as streams with state, over restarts, against the batch operators."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from syncwright.operators import origin
from syncwright.streaming import stateful


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.prepared(spark)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def traffic(spark, rows):
    """(ref, hash, second, expires or None, id or None)"""
    df = spark.createDataFrame(rows, "ref string, hash string, t long, e long, id string")
    return df.select("ref", "hash", F.timestamp_seconds("t").alias("at"), F.timestamp_seconds("e").alias("expires_at"), "id")


def test_verdicts_equal_those_of_a_batch_over_restarts(spark, tmp_path):
    writes = [(f"r{i % 5}", f"h{i % 3}", 0, 1000 if i % 4 else 50, None) for i in range(24)]
    events = [(f"r{i % 7}", f"h{i % 4}", 100 + i, None, f"e{i:03d}") for i in range(120)]
    # three micro-batches, each by a query of its own that takes up the state
    for k, rows in enumerate((writes, events[:60], events[60:])):
        traffic(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        stream = spark.readStream.schema(stateful.TRAFFIC).parquet(f"{tmp_path}/in/*")
        q = stateful.classified(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
        assert q.awaitTermination(120) and q.exception() is None
    got = {r["id"]: r["verdict"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    e, w = traffic(spark, events), traffic(spark, writes)
    want = {r["id"]: r["verdict"] for r in origin.classify(e, w.select("ref", "hash", "expires_at"), F.timestamp_seconds(F.lit(100)), ["at", "id"]).collect()}
    assert got == want and set(want.values()) == {"echo", "near_miss", "foreign"}


def test_a_write_and_its_echo_in_one_micro_batch(spark, tmp_path):
    rows = [("r", "h", 5, None, "early"), ("r", "h", 9, 20, None), ("r", "h", 9, None, "echo"), ("r", "h", 10, None, "again"), ("r", "x", 25, None, "late"), ("s", "h", 9, None, "other")]
    traffic(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in")
    q = stateful.classified(spark.readStream.schema(stateful.TRAFFIC).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("verdicts").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["id"]: r["verdict"] for r in spark.sql("select * from verdicts").collect()}
    assert got == {"early": "foreign", "echo": "echo", "again": "near_miss", "late": "foreign", "other": "foreign"}


def failing():
    """A function that tasks get by value, since they cannot import this module."""

    def attempt(item, payload, number):
        # item k fails k times; some with an error that no retry mends
        k = int(item)
        if k >= 20 and number == 2:
            return "permanent"
        return "transient" if number <= k % 9 else None

    return attempt


def test_retries_come_back_by_timers(spark, tmp_path):
    items = spark.range(24).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("payload"))
    items.repartition(1).write.parquet(f"{tmp_path}/in/0")
    items.where("id < 3").repartition(1).write.parquet(f"{tmp_path}/in/1")  # items that wait, or are done, may come again
    attempt = failing()
    want = sorted(stateful.folded(str(k), "p", attempt) for k in range(24))
    assert {w[1] for w in want} == {"done", "dead"}

    def started():
        stream = spark.readStream.schema("id string, payload string").parquet(f"{tmp_path}/in/*")
        out = stateful.retried(stream, attempt, base_ms=50, least_ms=1)
        return out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(processingTime="0 seconds").start()

    got, began, q = [], time.monotonic(), started()
    time.sleep(5)
    q.stop()  # attempts are kept over a restart
    q = started()
    while time.monotonic() - began < 90 and len({g[0] for g in got}) < len(want):
        time.sleep(1)
        assert q.exception() is None
        got = sorted(tuple(r) for r in spark.read.schema("id string, outcome string, attempts int, error_kind string").parquet(f"{tmp_path}/out").collect())
    q.stop()
    assert sorted(set(got)) == want


def test_waits_double_and_stay_within_their_window():
    waits = [stateful.jittered("x", n) for n in range(1, 12)]
    assert all(100 <= w <= min(30_000, 250 << (n - 1)) or w == 100 for n, w in enumerate(waits, 1)) and len(set(waits)) > 5
    assert stateful.jittered("x", 3) == stateful.jittered("x", 3)
