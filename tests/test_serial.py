"""Events of one logical record are decided together: no order of arrival makes two records of one."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from syncwright.operators import serial
from syncwright.sources import peers
from syncwright.streaming import keyed

KEYS = "ref string, key_name string, key_value string"


def key_rows(spark, rows):
    return spark.createDataFrame([(r, n, v) for r, *pairs in rows for n, v in pairs], KEYS)


def test_groups_follow_keys_and_links(spark):
    rng = random.Random(2)
    refs = [f"left:c/{i:03d}" for i in range(120)]
    rows = [(r, ("email", str(rng.randrange(90))), ("phone", str(rng.randrange(90)))) for r in refs] + [("right:c/z", ("email", "none"))]
    links = [(refs[3], "right:c/z"), (refs[50], "right:c/y")]
    parent = {r: r for r in [*refs, "right:c/z", "right:c/y"]}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_key = {}
    for r, *pairs in rows:
        for p in pairs:
            by_key.setdefault(p, []).append(r)
    for a, b in [*((g[0], x) for g in by_key.values() for x in g[1:]), *links]:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r["ref"]: r["group"] for r in serial.groups(key_rows(spark, rows), spark.createDataFrame(links, "a string, b string")).collect()}
    assert got == {r: root(r) for r in parent}
    # a chain of 200 records, each of which shares one key with the next
    chain = [(f"{i:04d}", ("k", str(i)), ("k", str(i + 1))) for i in range(200)]
    assert {r["group"] for r in serial.groups(key_rows(spark, chain), spark.createDataFrame([], "a string, b string")).collect()} == {"0000"}


def decided(spark, events, known=(), links=()):
    ev = spark.createDataFrame([(r, r.split(":")[0], t) for r, t, _ in events], "ref string, side string, at long")
    keys = spark.createDataFrame([(r, "email", k) for r, _, k in events], KEYS)
    old = spark.createDataFrame([(r, r.split(":")[0], "email", k) for r, k in known], keyed.KEYS)
    rows = serial.decided(ev, keys, old, spark.createDataFrame(list(links), keyed.LINKS)).fillna("").collect()
    return sorted((r["action"], r["left"], r["right"], r["source"]) for r in rows)


def test_decisions(spark):
    assert decided(spark, [("left:c/1", 1, "a"), ("right:c/9", 2, "a"), ("left:c/2", 3, "b"), ("right:c/8", 4, None), ("left:c/2", 9, "b")]) == [("create", "", "right:c/8", "right:c/8"), ("create", "left:c/2", "", "left:c/2"), ("pair", "left:c/1", "right:c/9", "")]
    # a record known from before answers; two of them are a question
    assert decided(spark, [("left:c/1", 1, "a")], [("right:c/9", "a"), ("right:c/8", "z")]) == [("pair", "left:c/1", "right:c/9", "")]
    assert decided(spark, [("left:c/1", 1, "a")], [("right:c/9", "a"), ("right:c/8", "a")]) == [("review", "left:c/1", "", "left:c/1")]
    # a link stands, and who else claims its record waits
    assert decided(spark, [("left:c/1", 1, "a"), ("left:c/5", 2, "a")], [("right:c/9", "a")], [("left:c/1", "right:c/9")]) == [("linked", "left:c/1", "right:c/9", ""), ("review", "left:c/5", "", "left:c/5")]
    assert decided(spark, [("right:c/9", 1, "new")], [("left:c/1", "a")], [("left:c/1", "right:c/9")]) == [("linked", "left:c/1", "right:c/9", "")]
    assert decided(spark, []) == []


def test_a_key_of_very_many_records_stays_a_count(spark):
    n = 20_000
    ev = spark.range(n).select(F.concat(F.lit("left:c/"), "id").alias("ref"), F.lit("left").alias("side"), F.col("id").alias("at"))
    keys = ev.select("ref", F.lit("email").alias("key_name"), F.lit("same").alias("key_value"))
    found = serial.decided(ev, keys, spark.createDataFrame([], keyed.KEYS), spark.createDataFrame([], keyed.LINKS))
    assert found.where("action = 'review'").count() == n


@pytest.mark.parametrize("seed", [1, 2])
def test_no_order_of_arrival_makes_two(spark, tmp_path, seed):
    """Three people, known at one peer or both; their events, and the echoes of creates, in any order and any batches, some run twice."""
    rng = random.Random(seed)
    at = F.expr("timestamp '2026-09-05 12:00:00'")
    targets, state = {s: peers.Target(f"{tmp_path}/{s}") for s in ("left", "right")}, f"{tmp_path}/state"
    events = [("left:c/l1", "ann"), ("left:c/l2", "bo"), ("right:c/r2", "bo"), ("right:c/r3", "cy"), ("left:c/l1", "ann"), ("right:c/r2", "bo")]
    rng.shuffle(events)
    echoes, k = set(), 0
    while events:
        some, events = events[: (size := rng.randint(1, 4))], events[size:]
        rows = [(ref, ref.split(":")[0], 10 * k + j, {"email": key}, json.dumps({"email": key}), key) for j, (ref, key) in enumerate(some)]
        df = spark.createDataFrame(rows, keyed.EVENTS.replace("at timestamp", "t long")).withColumn("at", F.timestamp_seconds("t")).drop("t")
        for _ in range(rng.randint(1, 2)):
            keyed.batch(df, targets, state, f"{k:04d}", at)
        # what was created comes back, at once or later, with its new id
        for side, target in targets.items():
            for r in peers.current(peers.log(spark, target.folder, peers.PEER)).collect():
                ref = f"{side}:c/{r['remote_id']}"
                if ref not in echoes:
                    echoes.add(ref)
                    events.insert(rng.randint(0, len(events)), (ref, json.loads(r["record"])["email"]))
        k += 1
    links = {(r["a"], r["b"]) for r in peers.log(spark, f"{state}/links", keyed.LINKS).collect()}
    assert len(links) == 3 and len({a for a, _ in links}) == len({b for _, b in links}) == 3
    made = sorted((s, json.loads(r["record"])["email"]) for s, t in targets.items() for r in peers.current(peers.log(spark, t.folder, peers.PEER)).collect())
    # bo is known at both; if their events came in different batches, the first one's create is what the other's record meets
    assert [m for m in made if m[1] != "bo"] == [("left", "cy"), ("right", "ann")]
    assert len(made) - 2 <= 1
