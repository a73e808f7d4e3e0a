"""Planned names, counters in passing, and creates of records that share a key."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from syncwright.operators import numbering
from syncwright.plans import cycle, outcomes
from syncwright.plans import plan as P
from test_engine import SYNC, changes, deletes, empty_state, now, peer


def test_numbers_follow_the_order_over_tasks(spark):
    rng = random.Random(3)
    values = [(rng.randrange(50), i) for i in range(3000)] + [(7, 10_000 + i) for i in range(3000)]
    rows = spark.createDataFrame(values, "a int, b int").repartition(7)
    found = numbering.numbered(rows, [F.desc("a"), "b"])
    want = sorted(values, key=lambda v: (-v[0], v[1]))
    assert [(r["a"], r["b"]) for r in sorted(found.collect(), key=lambda r: r["n"])] == want
    assert sorted(r["n"] for r in found.collect()) == list(range(1, 6001))
    # half of all rows tie in a: they are dealt by b too
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 0.6 * 6000
    assert numbering.numbered(rows.limit(0), ["a"]).count() == 0


def test_names_of_records_to_be_created(spark):
    left = peer(spark, "left", [("l2", "bo@x.test", "Bo", 9), ("l1", "ann@x.test", "Ann", 5), ("l3", "di@x.test", "Di", 50)])
    right = peer(spark, "right", [("r9", "cy@x.test", "Cy", 1), ("r3", "di@x.test", "Dee", 5)])
    tables = empty_state(spark)
    plan = P.named(P.planned(left, right, tables["links"], tables["snapshots"], SYNC), SYNC)
    assert sorted((r["n"], r["action"], r["source"], r["target"]) for r in plan.collect()) == [
        (1, "create", "left:contact/l1", "right:contact/planned-1"), (2, "create", "left:contact/l2", "right:contact/planned-2"),
        (3, "update", "left:contact/l3", "right:contact/r3"), (4, "create", "right:contact/r9", "left:contact/planned-4"),
    ]


def test_of_records_that_share_a_key_only_the_first_is_created(spark):
    """Two records of one side and none at the other: a second create could make one person twice."""
    left = peer(spark, "left", [("l2", "ann@x.test", "Ann B", 9), ("l1", "ann@x.test", "Ann", 5), ("l3", "", "Nobody", 1), ("l4", "", "Nobody", 1)])
    right = peer(spark, "right", [("r1", "bo@x.test", "Bo", 5), ("r2", "bo@x.test", "Bo", 5)])
    tables = empty_state(spark)
    plan = P.planned(left, right, tables["links"], tables["snapshots"], SYNC)
    made = [(a, s) for a, _, s, _ in changes(plan)]
    assert made == [("create", "right:contact/r1"), ("create", "left:contact/l1"), ("create", "left:contact/l3"), ("create", "left:contact/l4"), ("review", "right:contact/r2"), ("review", "left:contact/l2")]
    assert {r["reason"] for r in plan.where("action = 'review'").collect()} == {"an earlier record that is created matches on email"}
    decisions = P.decided(left, right, tables["links"], tables["snapshots"], SYNC)
    assert cycle.writes(decisions, deletes(spark), tables["links"], SYNC, now()).count() == 4


def test_counters_in_passing(spark, tmp_path):
    rng = random.Random(5)
    kinds = ["echo", "created", "updated", "deleted", "reviewed", "skipped", "no_change", "retried", "dead_letter"]
    rows = spark.createDataFrame([(rng.choice(["near_miss", "foreign", None]), rng.choice(kinds)) for _ in range(500)], "verdict string, outcome string").repartition(3)
    want = {r["stat"]: r["n"] for r in outcomes.stats(rows).collect()}
    assert list(want) == list(outcomes.STATS) and want["ingested"] == 500 and min(want.values()) > 0
    seen, found = outcomes.observed(rows)
    seen.write.parquet(f"{tmp_path}/rows")
    assert found.get == want
    stream = outcomes.observed_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/rows"))
    q = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = [p["observedMetrics"]["outcomes"].asDict() for p in q.recentProgress if p["numInputRows"]]
    assert {name: sum(g[name] for g in got) for name in outcomes.STATS} == want


def test_outcomes_of_decisions_and_errors(spark):
    left = peer(spark, "left", [("l1", "ann@x.test", "Ann", 50), ("l2", "bo@x.test", "Bo", 5), ("l3", "cy@x.test", "Cy", 5), ("l4", "di@x.test", "Di", 5)])
    right = peer(spark, "right", [("r1", "ann@x.test", "Anna", 5), ("r3", "cy@x.test", "Cy", 5), ("r4", "di@x.test", "Dee", 5)])
    tables = empty_state(spark)
    rows, _ = P.standing(P.decided(left, right, tables["links"], tables["snapshots"], SYNC), None, SYNC)
    assert {r["l_id"]: r["o"] for r in rows.select("l_id", outcomes.decision_outcome().alias("o")).collect()} == {"l1": "updated", "l2": "created", "l3": "no_change", "l4": "reviewed"}
    cases = spark.createDataFrame([("created", None, 1), ("created", "transient", 1), ("updated", "transient", 6), ("deleted", "permanent", 1), ("reviewed", "transient", 1)], "o string, e string, n int")
    assert [r["x"] for r in cases.select(outcomes.after_errors(F.col("o"), F.col("e"), F.col("n")).alias("x")).collect()] == ["created", "retried", "dead_letter", "dead_letter", "reviewed"]
