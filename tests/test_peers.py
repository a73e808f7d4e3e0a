"""Writes to peers: each record once, however often a batch is tried and wherever it is killed."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from syncwright.operators import progress
from syncwright.operators.state import TABLES
from syncwright.plans import cycle
from syncwright.plans import plan as P
from syncwright.sources import peers
from test_engine import SYNC, deletes, empty_state, now, peer

NOW = "timestamp '2026-09-05 12:00:00'"


def at(second=0):
    return F.expr(f"{NOW} + interval {second} seconds")


def writes(spark, rows):
    """(action, remote_id, record, key, second) to the peer `right`."""
    named = [("right", "s", a, i, r if r is None else json.dumps(r), "h", k, "left:contact/x", s) for a, i, r, k, s in rows]
    return spark.createDataFrame(named, peers.WRITES.replace("at timestamp", "s long")).withColumn("at", F.timestamp_seconds("s")).drop("s")


def records(spark, target):
    return sorted((r["remote_id"], r["version"], r["deleted"], json.loads(r["record"])) for r in peers.current(peers.log(spark, target.folder, peers.PEER)).collect())


def seeded(spark, folder):
    target = peers.Target(str(folder / "right"), ("name", "mail", "made"), ("mail",), ("made",), 60)
    old = spark.createDataFrame([("r1", 3, '{"mail":{"a":"x","b":"y"},"name":"Old"}'), ("r2", 1, '{"mail":"z"}')], "remote_id string, version long, record string")
    peers.append_once(old.select("remote_id", "version", at().alias("updated_at"), F.lit(False).alias("deleted"), "record", F.array().cast("array<string>").alias("keys")), target.folder, "0")
    return target


BATCH = [
    ("update", "r1", {"mail": {"a": "new"}}, "k1", 1), ("create", None, {"mail": "n", "name": "New"}, "k2aaaaaaaaaaaaaaaaaaaa", 1), ("create", "", {"mail": "n", "name": "New"}, "k2aaaaaaaaaaaaaaaaaaaa", 1),
    ("delete", "r2", None, "k3", 1), ("delete", "nobody", None, "k4", 1), ("update", "lost", {"mail": "back"}, "k5", 1),
    ("update", "r1", {"made": "now"}, "k6", 1), ("create", None, {"name": "no mail"}, "k7", 1), ("update", "r1", {"shoe": 1}, "k8", 1), ("update", "r1", {"mail": ""}, "k9", 1),
]
AFTER = [("lost", 1, False, {"mail": "back"}), ("n-k2aaaaaaaaaaaaaa", 1, False, {"mail": "n", "name": "New"}), ("r1", 4, False, {"mail": {"a": "new"}, "name": "Old"}), ("r2", 2, True, {"mail": "z"})]


class Killed(Exception):
    pass


@pytest.mark.parametrize("dies", ["never", "intent", "write right", "commit"])
def test_a_batch_leaves_each_record_once(spark, tmp_path, dies):
    target, state = seeded(spark, tmp_path), str(tmp_path / "state")

    def after(step):
        if step == dies:
            raise Killed

    if dies != "never":
        with pytest.raises(Killed):
            peers.write(writes(spark, BATCH), {"right": target}, state, "1", at(), after)
    for _ in range(2):
        peers.write(writes(spark, BATCH), {"right": target}, state, "1", at(1))
    assert records(spark, target) == AFTER
    dead = peers.log(spark, f"{state}/dlq", TABLES["dlq"])
    assert sorted(r["reason"] for r in dead.collect()) == ["a value is required for mail", "a value is required for mail", "it is not allowed to write made", "there is no field shoe"]
    idem = peers.idem_table(peers.log(spark, f"{state}/idem", TABLES["idem"] + ", step int"))
    assert sorted((r["key"][:2], r["remote_id"], r["created"], r["in_flight"]) for r in idem.collect()) == [("k1", "r1", False, False), ("k2", "n-k2aaaaaaaaaaaaaa", True, False), ("k3", "r2", False, False), ("k4", "nobody", False, False), ("k5", "lost", False, False)]
    origins = peers.log(spark, f"{state}/origins", TABLES["origins"])
    assert sorted(r["ref"] for r in origins.collect()) == ["right/lost", "right/n-k2aaaaaaaaaaaaaa", "right/r1"]
    # the same keys in another batch are known
    peers.write(writes(spark, BATCH[:4]), {"right": target}, state, "2", at(5))
    assert records(spark, target) == AFTER


def test_what_was_in_flight_is_written_again_only_if_its_target_is_known(spark, tmp_path):
    target, state = seeded(spark, tmp_path), str(tmp_path / "state")
    rows = [("update", "r1", {"name": "N"}, "k1", 1), ("create", None, {"mail": "m"}, "k2", 1)]

    def stop(step):
        raise Killed

    with pytest.raises(Killed):
        peers.write(writes(spark, rows), {"right": target}, state, "1", at(), stop)
    peers.write(writes(spark, rows), {"right": target}, state, "2", at(5))
    assert [r[0] for r in records(spark, target)] == ["r1", "r2"] and records(spark, target)[0][3]["name"] == "N"
    # once the mark is no longer alive, the create goes
    peers.write(writes(spark, rows), {"right": target}, state, "3", at(progress.IDEM_TTL + 10))
    assert [r[0] for r in records(spark, target)] == ["n-k2", "r1", "r2"]


def test_writes_to_one_record_follow_one_another(spark, tmp_path):
    target = seeded(spark, tmp_path)
    rows = [("update", "r1", {"name": "B", "mail": 2}, "k2", 2), ("update", "r1", {"name": "A", "mail": 1, "x": None}, "k1", 1), ("delete", "r2", None, "k3", 1), ("update", "r2", {"name": "again"}, "k4", 2), ("update", "r3", {"a": 1}, "k5", 1), ("delete", "r3", None, "k6", 2)]
    found = peers.upserted(peers.log(spark, target.folder, peers.PEER), writes(spark, rows), at())
    got = sorted((r["remote_id"], r["version"], r["deleted"], json.loads(r["record"])) for r in found.collect())
    assert got == [("r1", 4, False, {"mail": 2, "name": "B", "x": None}), ("r2", 2, False, {"name": "again"})]


def test_a_stream_of_writes(spark, tmp_path):
    target, state = seeded(spark, tmp_path), str(tmp_path / "state")
    for k, rows in enumerate((BATCH[:3], BATCH[1:6])):
        writes(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(peers.WRITES).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    for _ in range(2):
        q = peers.sink(stream, {"right": target}, state, f"{tmp_path}/checkpoint", at).trigger(availableNow=True).start()
        q.awaitTermination()
    assert records(spark, target) == AFTER


def test_a_cycle_written_to_its_peers_comes_back_as_echoes(spark, tmp_path):
    left, right = peer(spark, "left", [("l1", "ann@x.test", "Ann", 50), ("l2", "bo@x.test", "Bo", 5), ("l3", "cy@x.test", "Cy", 5)]), peer(spark, "right", [("r1", "ann@x.test", "Anna", 5), ("r3", "cy@x.test", "Cy", 5)])
    tables = empty_state(spark)
    links = spark.createDataFrame([("l3", "r3")], "a string, b string")
    gone = deletes(spark, [("left", "l3")])
    decisions = P.decided(left, right, links, tables["snapshots"], SYNC)
    sent = cycle.writes(decisions, gone, links, SYNC, now())
    rows = {r["action"]: r for r in sent.collect()}
    assert {a: (r["connector"], r["remote_id"], r["record"] and json.loads(r["record"])) for a, r in rows.items()} == {
        "create": ("right", None, {"mail": {"primary": "bo@x.test"}, "who": {"first": "Bo"}}),
        "update": ("right", "r1", {"mail": {"primary": "ann@x.test"}, "who": {"first": "Ann"}}),
        "delete": ("right", "r3", None),
    }
    assert sent.columns == [c.split()[0] for c in peers.WRITES.split(", ")]
    target = peers.Target(str(tmp_path / "right"))
    peers.write(sent, {"right": target}, str(tmp_path / "state"), "1", now())
    back = peers.current(peers.log(spark, target.folder, peers.PEER)).where("not deleted")
    seen = P.canonical(back.select("remote_id", "updated_at", F.parse_json("record").alias("record")), SYNC, "right")
    assert {r["hash"] for r in seen.collect()} == {rows["create"]["hash"], rows["update"]["hash"]}
    # what cycle.after notes under the idempotency key is what was sent
    answer = peers.idem_table(peers.log(spark, f"{tmp_path}/state/idem", TABLES["idem"] + ", step int")).where("created")
    created = answer.select(F.lit(rows["create"]["source"]).alias("source"), "remote_id")
    keys = {r["key"] for r in cycle.after(decisions, created, gone, tables | {"links": links.withColumn("linked_at", now())}, SYNC, now())["idem"].collect()}
    assert keys == {rows["create"]["key"], rows["update"]["key"]}
