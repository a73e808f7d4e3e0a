"""Rows that an operator reads many times, and values that it names many times, are worked out once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from syncwright.llm import line_dedup
from syncwright.operators import serial
from syncwright.operators.mapping import FieldMap, Mapping
from syncwright.plans import plan as P
from syncwright.plans import run
from syncwright.sources import peers, versions
from syncwright.streaming.stateful import Echoes
from test_run import World

def now():
    return F.expr("timestamp '2024-06-01 00:00:00'")


def counted(rows):
    """rows, and a counter of how many of them were worked out."""
    seen = rows.sparkSession.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return rows.mapInArrow(passed, rows.schema), seen


class Held:
    """A value or map state in memory that counts its calls."""

    def __init__(self):
        self.values, self.calls = {}, 0

    def __getattr__(self, name):
        self.calls += 1
        return {
            "exists": lambda: bool(self.values), "get": lambda: self.values[None], "update": lambda v: self.values.__setitem__(None, v),
            "containsKey": lambda k: k in self.values, "getValue": lambda k: self.values[k], "updateValue": self.values.__setitem__, "removeKey": self.values.pop,
        }[name]


def test_state_of_a_ref_is_read_and_written_once_a_digest():
    echoes, at = Echoes(None), pd.Timestamp("2024-01-01")
    echoes.open, echoes.recent = Held(), Held()
    rows = [("a", at, at + pd.Timedelta(days=1), None)] * 3 + [("ab"[k % 2], at + pd.Timedelta(seconds=k), None, f"{k:04d}") for k in range(1000)]
    frame = pd.DataFrame(rows, columns=["hash", "at", "expires_at", "id"])
    (out,) = echoes.handleInputRows(("r",), iter([frame[:400], frame[400:]]), None)
    assert list(out["verdict"]) == ["echo" if k in (0, 2, 4) else "near_miss" for k in range(1000)]
    assert echoes.open.calls + echoes.recent.calls <= 10
    assert not echoes.open.values  # all three were used up
    late = pd.DataFrame([("a", at + pd.Timedelta(days=2), None, "z")], columns=["hash", "at", "expires_at", "id"])
    (out,) = echoes.handleInputRows(("r",), iter([late]), None)
    assert list(out["verdict"]) == ["foreign"]


def test_groups_of_events_read_them_once(spark):
    e = spark.range(300).select(F.concat(F.lit("r"), "id").alias("ref"), F.when(F.col("id") % 2 == 0, "left").otherwise("right").alias("side"), F.col("id").alias("at"), F.concat(F.lit("k"), F.expr("id div 2")).alias("key"))
    e, seen = counted(e)
    known = spark.createDataFrame([], "ref string, side string, key_name string, key_value string")
    out = serial.decided(e.drop("key"), e.select("ref", F.lit("k").alias("key_name"), F.col("key").alias("key_value")), known, spark.createDataFrame([], "a string, b string"))
    assert sorted(r["action"] for r in out.collect()) == ["pair"] * 150
    assert seen.value <= 600


SYNC = P.Sync("contact:left-right", "left", "right", Mapping("contact", (FieldMap("email", "email", "email", transform="email_normalize"),)), ("email",), "left_wins")


def test_decisions_read_either_side_once(spark):
    side = spark.range(100).select(F.col("id").cast("string").alias("remote_id"), now().alias("updated_at"), F.parse_json(F.concat(F.lit('{"email":"X'), "id", F.lit('@www.a.b"}'))).alias("record"))
    (left, seen), (right, _) = counted(P.canonical(side, SYNC, "left")), counted(P.canonical(side, SYNC, "right"))
    out = P.decided(left, right, spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "ref string, hash string, fields map<string,string>"), SYNC)
    assert {tuple(r) for r in out.groupBy("outcome").count().collect()} == {("matched", 100)}
    assert seen.value <= 100


def test_a_mapped_field_is_taken_from_its_record_once(spark):
    mapped = spark.range(1).select(F.parse_json(F.concat(F.lit('{"email":" X@WWW.A.b "}'))).alias("record")).select(SYNC.mapping.to_canonical(F.col("record"), "left").alias("fields"))
    assert mapped.first()["fields"] == {"email": "sx@a.b"}
    plan = spark.range(1).select(SYNC.mapping.to_canonical(F.parse_json(F.col("id").cast("string")), "left").alias("fields"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count('["email"]') == 1


def test_a_batch_of_writes_is_worked_out_once(spark, tmp_path):
    targets = {side: peers.Target(f"{tmp_path}/{side}", ("email",)) for side in ("left", "right")}
    w = spark.range(50).select(F.when(F.col("id") % 2 == 0, "left").otherwise("right").alias("connector"), F.lit("s").alias("sync"), F.lit("create").alias("action"), F.lit("").alias("remote_id"), F.lit('{"email":"e"}').alias("record"), F.lit("h").alias("hash"), F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").cast("string").alias("source"), now().alias("at"))
    w, seen = counted(w)
    for batch in ("1", "1", "2"):
        peers.write(w, targets, f"{tmp_path}/state", batch, now())
    assert sum(peers.log(spark, t.folder, peers.PEER).count() for t in targets.values()) == 50
    assert seen.value <= 100  # the second time batch 1 is there


def test_a_cycle_works_out_each_record_once(spark, tmp_path, monkeypatch):
    made = []

    def canonical(*args):
        rows, seen = counted(P.canonical(*args))
        made.append(seen)
        return rows

    monkeypatch.setattr(run, "canonical", canonical)
    w = World(spark, tmp_path)
    for side in ("left", "right"):
        w.edit(side, 0, *[(f"{side}{k}", f"e{k}@x.test", f"N{k}") for k in range(20)])
    w.cycle(10)
    assert sum(seen.value for seen in made) == 40
    w.edit("left", 20, ("left3", "e3@x.test", "Other"), ("left4", None, None))
    w.cycle(30)
    assert sum(seen.value for seen in made) <= 80
    assert ("e3@x.test", "Other") in w.records("right") and len(w.records("right")) == 19


def test_a_table_of_one_version_is_read_as_it_stands(spark, tmp_path):
    links = spark.createDataFrame([("l1", "r1"), ("l2", "r2")], "a string, b string").withColumn("linked_at", now())
    versions.commit(spark, str(tmp_path), 1, {"links": (links, links.where("a = 'l2'"))})
    found = versions.read(spark, str(tmp_path))["links"]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    assert [r["a"] for r in found.collect()] == ["l1"]


def test_decisions_are_read_by_column(spark):
    sides = [P.canonical(spark.range(10).select(F.col("id").cast("string").alias("remote_id"), now().alias("updated_at"), F.parse_json(F.concat(F.lit('{"email":"X'), "id", F.lit('@www.a.b"}'))).alias("record")), SYNC, side) for side in ("left", "right")]
    out = P.decided(*sides, spark.createDataFrame([], "a string, b string"), spark.createDataFrame([], "ref string, hash string, fields map<string,string>"), SYNC)
    plan = out.select("l_id", "outcome")._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan and "right_values" not in plan
    assert out.where("outcome = 'matched'").count() == 10


def test_items_go_to_their_counts_as_three_numbers(spark):
    places = line_dedup.PLACES
    hot = spark.createDataFrame([(77, 0)], "item long, hot long")
    rows = spark.createDataFrame([(1, 9, 77), (1, 9, 5), (2, 9, 5), (2, 9, places + 1), (3, 9, 77), (3, 9, -4)], "h long, n int, item long")
    out = line_dedup._by_rarity(rows, hot)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item#" in plan and "_w0" not in plan
    # a hot item keeps one name, last in order; one whose hash lies among the places moves on
    assert {r["h"]: [tuple(o) for o in r["order"]] for r in out.collect()} == {1: [(2, places + 5), (1 << 40, 0)], 2: [(2, places + 5)], 3: [(1 << 40, 0)]}
