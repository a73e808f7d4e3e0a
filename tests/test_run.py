"""State in versions, and cycles that read, decide, write and remember what changed."""

from __future__ import annotations

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from syncwright.operators import state
from syncwright.plans import plan as P
from syncwright.plans import run
from syncwright.sources import peers, versions
from test_engine import SYNC, empty_state, peer

T = "timestamp '2026-09-05 12:00:00'"


def at(second=0):
    return F.expr(f"{T} + interval {second} seconds")


class Killed(Exception):
    pass


def dies_at(step):
    def after(name):
        if name == step:
            raise Killed

    return after


def links(spark, *pairs):
    return spark.createDataFrame(list(pairs), "a string, b string").withColumn("linked_at", at())


def shown(tables):
    return sorted((r["a"], r["b"]) for r in tables["links"].collect())


def marks(spark, **times):
    return spark.createDataFrame([(c, "contact", datetime(2026, 9, day)) for c, day in times.items()], "connector string, kind string, mark timestamp")


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "state")
    assert versions.last(spark, folder) == 0 and shown(versions.read(spark, folder)) == []
    versions.commit(spark, folder, 1, {"links": (links(spark, ("l1", "r1"), ("l2", "r2")), None), "watermarks": (marks(spark, left=1, right=1), None)})
    versions.commit(spark, folder, 2, {"links": (links(spark, ("l3", "r3"), ("l1", "r1")), links(spark, ("l2", "r2"), ("l1", "r1"), ("l9", "r9"))), "watermarks": (marks(spark, left=4), None)})
    assert shown(versions.read(spark, folder, 1)) == [("l1", "r1"), ("l2", "r2")]
    assert shown(versions.read(spark, folder)) == [("l3", "r3")]
    assert sorted((r["connector"], r["mark"].day) for r in versions.read(spark, folder)["watermarks"].collect()) == [("left", 4), ("right", 1)]
    assert {n: t.columns for n, t in versions.read(spark, folder).items()} == {n: [c.split()[0] for c in s.replace("map<string,string>", "map").split(", ")] for n, s in state.TABLES.items()}
    for wrong in (2, 4):
        with pytest.raises(ValueError, match="does not follow"):
            versions.commit(spark, folder, wrong, {})
    with pytest.raises(ValueError, match="not there"):
        versions.read(spark, folder, 3)


def test_a_version_that_was_not_finished_is_not_read(spark, tmp_path):
    folder = str(tmp_path / "state")
    versions.commit(spark, folder, 1, {"links": (links(spark, ("l1", "r1")), None)})
    with pytest.raises(Killed):
        versions.commit(spark, folder, 2, {"links": (links(spark, ("lost", "lost")), links(spark, ("l1", "r1"))), "keys": (None, None)}, dies_at("links"))
    assert versions.last(spark, folder) == 1 and shown(versions.read(spark, folder)) == [("l1", "r1")]
    versions.commit(spark, folder, 2, {"links": (links(spark, ("l2", "r2")), None)})
    assert shown(versions.read(spark, folder)) == [("l1", "r1"), ("l2", "r2")]


def test_a_new_base_leaves_out_what_expired_and_old_versions_can_go(spark, tmp_path):
    folder = str(tmp_path / "state")
    origins = spark.createDataFrame([("a", "h", 10), ("b", "h", 99)], "ref string, hash string, s int").select("ref", "hash", at().alias("written_at"), F.expr(f"{T} + make_dt_interval(0, 0, 0, s)").alias("expires_at"))
    versions.commit(spark, folder, 1, {"links": (links(spark, ("l1", "r1")), None), "origins": (origins, None)})
    versions.commit(spark, folder, 2, {"links": (links(spark, ("l2", "r2")), None)})
    before = versions.read(spark, folder)["links"]
    versions.compacted(spark, folder, at(50))
    versions.compacted(spark, folder, at(50))
    versions.commit(spark, folder, 3, {"links": (None, links(spark, ("l1", "r1")))})
    assert shown({"links": before}) == shown(versions.read(spark, folder, 2)) == [("l1", "r1"), ("l2", "r2")]
    assert [r["ref"] for r in versions.read(spark, folder)["origins"].collect()] == ["b"]
    versions.trimmed(spark, folder, 2)
    assert shown(versions.read(spark, folder)) == [("l2", "r2")] and shown(versions.read(spark, folder, 2)) == [("l1", "r1"), ("l2", "r2")]
    with pytest.raises(ValueError, match="not there"):
        versions.read(spark, folder, 1)
    assert not list((tmp_path / "state").glob("change-0000000001-*")) and len(list((tmp_path / "state").glob("base-0*"))) == 1


def test_a_few_changes_write_a_few_rows(spark, tmp_path):
    """The base is neither written again nor shuffled."""
    folder = str(tmp_path / "state")
    many = spark.range(50_000).select(F.concat(F.lit("l"), "id").alias("a"), F.concat(F.lit("r"), "id").alias("b"), at().alias("linked_at"))
    versions.commit(spark, folder, 1, {"links": (many, None)})
    versions.compacted(spark, folder, at())
    versions.commit(spark, folder, 2, {"links": (links(spark, ("new", "new")), many.where("a in ('l1', 'l2')"))})
    assert spark.read.parquet(*map(str, (tmp_path / "state").glob("change-0000000002-*/links"))).count() == 3
    found = versions.read(spark, folder)["links"]
    assert found.count() == 49_999
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


# ---- cycles -----------------------------------------------------------------


def doc(side, email, name):
    return json.dumps({"email": email, "name": name} if side == "left" else {"mail": {"primary": email}, "who": {"first": name}})


class World:
    """Two peers and a state in a folder."""

    def __init__(self, spark, path):
        self.spark, self.folder, self.n = spark, str(path / "state"), 0
        self.targets = {side: peers.Target(str(path / side)) for side in ("left", "right")}

    def edit(self, side, second, *rows):
        """(id, email, name) as the peer's next versions; a name of None deletes."""
        self.n += 1
        made = [(i, self.n, n is None, doc(side, e, n)) for i, e, n in rows]
        df = self.spark.createDataFrame(made, "remote_id string, version long, deleted boolean, record string")
        peers.append_once(df.select("remote_id", "version", at(second).alias("updated_at"), "deleted", "record", F.array().cast("array<string>").alias("keys")), self.targets[side].folder, f"e{self.n}")

    def records(self, side):
        path = {"left": ("email", "name"), "right": ("mail.primary", "who.first")}[side]
        rows = peers.current(peers.log(self.spark, self.targets[side].folder, peers.PEER)).where("not deleted")
        return sorted(tuple(r) for r in rows.select(*[F.get_json_object("record", f"$.{p}") for p in path]).collect())

    def cycle(self, second, after=None):
        return run.once(self.spark, SYNC, self.targets, self.folder, at(second), 5, after)

    def state(self):
        return versions.read(self.spark, self.folder)

    def rows(self, name, number):
        return self.spark.read.parquet(f"{self.folder}/{name}/batch={number:010d}")


@pytest.fixture
def world(spark, tmp_path):
    w = World(spark, tmp_path)
    w.edit("left", 0, ("l1", "ann@x.test", "Ann"), ("l2", "bo@x.test", "Bo"))
    w.edit("right", 0, ("r1", "ann@x.test", "Ann"), ("r3", "cy@x.test", "Cy"))
    return w


ALL = [("ann@x.test", "Ann"), ("bo@x.test", "Bo"), ("cy@x.test", "Cy")]


def test_cycles_read_what_changed_and_then_rest(spark, world, tmp_path):
    assert world.cycle(100) == 1
    assert world.records("left") == world.records("right") == ALL
    assert len(shown(world.state())) == 3 and world.state()["snapshots"].count() == 6
    # our own writes come back once, as echoes, and nothing follows
    assert world.cycle(110) == 2
    # (what stands at the mark is read again, and found in step)
    assert world.rows("polled", 2).where("echo").count() == 2 and world.rows("sent", 2).isEmpty()
    assert spark.read.parquet(*map(str, tmp_path.glob("state/change-0000000002-*/snapshots"))).isEmpty()
    # an edit, and a delete, and nothing but their pairs is looked at
    world.edit("right", 120, ("r1", "ann@x.test", "Anna"))
    world.edit("left", 120, ("l2", "bo@x.test", None))
    assert run.quiet(spark, SYNC, world.targets, world.folder, lambda: at(130), overlap=5) == 2
    assert world.rows("decided", 3).count() == 1
    assert world.records("left") == world.records("right") == [("ann@x.test", "Anna"), ("cy@x.test", "Cy")]
    assert len(shown(world.state())) == 2 and world.state()["snapshots"].count() == world.state()["keys"].count() == 4


def test_a_cycle_that_is_killed_runs_again(spark, world):
    """Killed after one step after the other, it leaves what one whole cycle leaves; what it decided stands."""
    world.edit("left", 0, ("l4", "di@x.test", "Di"))
    world.edit("right", 0, ("r4", "di@x.test", "Dee"))
    for k, step in enumerate(["polled", "decided", "intent", "write left", "write right", "commit", "state links", "state watermarks"]):
        with pytest.raises(Killed):
            world.cycle(100 + k, dies_at(step))
        assert versions.last(spark, world.folder) == 0
    world.edit("left", 109, ("l1", "ann@x.test", "Anna"))
    assert world.cycle(110) == 1
    # Di and Dee wait for a decision, so they are not in step
    assert len(shown(world.state())) == 3 and len(world.records("left")) == len(world.records("right")) == 4
    assert [n for e, n in world.records("right") if e[:3] == "ann"] == ["Ann"]
    assert world.rows("sent", 1).count() == 2 and world.state()["review"].count() == 1


def test_refused_writes_are_not_remembered_and_questions_are_asked_once(spark, world, tmp_path):
    world.targets["right"] = peers.Target(str(tmp_path / "right"), fields=("who",))
    world.edit("left", 0, ("l3", "cy@x.test", "Cy"), ("l5", "ed@x.test", "Ed"))
    world.edit("right", 0, ("r5", "ed@x.test", "Ed"), ("r6", "ed@x.test", "Eddy"))
    world.cycle(100)
    questions = sorted((r["ref"], r["reason"], r["created_at"]) for r in world.state()["review"].collect())
    assert [r for r, _, _ in questions] == ["left:contact/l5", "right:contact/r5", "right:contact/r6"]
    dead = lambda: [r["reason"] for r in peers.log(spark, f"{world.folder}/peers/dlq", state.TABLES["dlq"]).collect()]
    assert dead() == ["there is no field mail"] and shown(world.state()) == [("l1", "r1"), ("l3", "r3")]
    # in step before, refused now: the snapshots stay as they were
    world.edit("left", 110, ("l1", "ann@x.test", "Anna"), ("l5", "ed@x.test", "Edd"))
    world.cycle(120)
    # l2 stands at the mark, so it was read and refused again, under the same id
    assert peers.log(spark, f"{world.folder}/peers/dlq", state.TABLES["dlq"]).select("id").distinct().count() == 2
    assert [r["n"] for r in world.state()["snapshots"].where("endswith(ref, '1')").select(F.col("fields")["name"].alias("n")).distinct().collect()] == ["sAnn"]
    assert sorted((r["ref"], r["reason"], r["created_at"]) for r in world.state()["review"].collect()) == questions
    assert ("ed@x.test", "Edd") not in world.records("right")


def test_decisions_on_changed_records_equal_those_on_all(spark):
    """What can be reached in two hops is enough to decide as on the whole tables."""
    rng = random.Random(7)
    rows = lambda s: [(f"{s}{i}", f"{rng.randrange(40)}@x.test", f"N{rng.randrange(2)}", rng.randrange(100)) for i in range(40)]
    left, right = peer(spark, "left", rows("l")), peer(spark, "right", rows("r"))
    known = spark.createDataFrame([(f"l{i}", f"r{i}") for i in range(0, 40, 7)], "a string, b string")
    show = lambda d: sorted((r["l_id"] or "", r["r_id"] or "", r["outcome"], r["why"]) for r in d.collect())
    whole = show(P.decided(left, right, known, empty_state(spark)["snapshots"], SYNC))
    members = [run.identity.keys_of(t, "remote_id", {"email": "key_email"}).select(F.lit(s).alias("side"), "id", "key_name", "key_value") for s, t in (("left", left), ("right", right))]
    ids = spark.createDataFrame([("left", f"l{i}") for i in range(0, 40, 5)] + [("right", f"r{i}") for i in range(3, 40, 9)], "side string, id string")
    near = run.reached(members[0].unionByName(members[1]), known, ids)
    some = {s: t.join(near.where(F.col("side") == s).select(F.col("id").alias("remote_id")), "remote_id", "left_semi") for s, t in (("left", left), ("right", right))}
    assert near.count() < 80
    moved = {r["id"] for r in ids.collect()}
    pick = lambda rows: [r for r in rows if r[0] in moved or r[1] in moved]
    assert pick(show(P.decided(some["left"], some["right"], known, empty_state(spark)["snapshots"], SYNC))) == pick(whole)
