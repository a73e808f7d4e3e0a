"""Incremental cycles between two peers: what changed since the last one is read, decided, written and remembered.

A cycle reads the state's last version and leaves the next one.  What it decided stands
once it is written: a cycle that was killed and runs again sends the same writes, each
of which a peer takes once, although by then the peers may hold some of them.  Nothing
of it counts as remembered, watermarks included, before its version is marked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.digest import review_id
from ..operators import identity, progress
from ..operators.mapping import DIRECTIONS
from ..operators.state import TABLES, first_review, swept
from ..session import written
from ..sources import peers, versions
from . import cycle
from .plan import Sync, canonical, decided, deleted_ends, refs, standing


def reached(members: DataFrame, links: DataFrame, ids: DataFrame, hops: int = 2) -> DataFrame:
    """(side, id) of the records that decisions on `ids` (side, id) can rest on, themselves included.

    members: (side, id, key_name, key_value).  A hop leads to all records of both sides that
    share a key, and to the other end of a link.  Two are enough: a record's candidates,
    and theirs.  A key that very many records share is one row of the distinct values.
    """
    for _ in range(hops):
        values = members.join(ids, ["side", "id"], "left_semi").select("key_name", "key_value").distinct()
        near = members.join(values, ["key_name", "key_value"], "left_semi").select("side", "id")
        ends = links.join(ids.where("side = 'left'").select(F.col("id").alias("a")), "a", "left_semi").select(F.lit("right").alias("side"), F.col("b").alias("id"))
        ends = ends.union(links.join(ids.where("side = 'right'").select(F.col("id").alias("b")), "b", "left_semi").select(F.lit("left"), "a"))
        ids = written(ids.union(near).union(ends).distinct())
    return ids


def _kept(rows: DataFrame, folder: str, batch: str) -> DataFrame:
    """rows as an earlier try of the same cycle wrote them, or written now."""
    peers.append_once(rows, folder, batch)
    return rows.sparkSession.read.parquet(f"{folder}/batch={batch}")


def polled(spark: SparkSession, sync: Sync, targets: dict[str, peers.Target], marks: DataFrame, origins: DataFrame, overlap: int) -> tuple[dict[str, DataFrame], DataFrame]:
    """(canonical records there, by side; (side, id, at, deleted, echo) of what changed since the marks, with the overlap).

    echo: the record is as we last wrote it, so it starts no work.  Either side's records are
    worked out once and written; all that follows reads them from there.
    """
    known = {r["connector"]: r["mark"] for r in marks.where(F.col("kind") == sync.mapping.kind).collect()}  # a row for each peer
    own = origins.select("ref", "hash").distinct().withColumn("_own", F.lit(True))
    there, found = {}, []
    for side, name in (("left", sync.left), ("right", sync.right)):
        now_there = peers.current(peers.log(spark, targets[name].folder, peers.PEER))
        record = F.when(~F.col("deleted"), F.parse_json("record"))
        rows = written(canonical(now_there.withColumn("record", record), sync, side, "deleted"))
        fresh = progress.delta(rows, "updated_at", progress.since(F.lit(known[name]), overlap) if known.get(name) else None)
        there[side] = rows.where("not deleted").drop("deleted")
        alive = fresh.where("not deleted").withColumn("ref", F.concat_ws("/", F.lit(name), "remote_id")).join(own, ["ref", "hash"], "left")
        change = lambda rows, deleted, echo: rows.select(F.lit(side).alias("side"), F.col("remote_id").alias("id"), F.col("updated_at").alias("at"), F.lit(deleted).alias("deleted"), echo.alias("echo"))  # noqa: E731, B023
        found += [change(alive, False, F.coalesce("_own", F.lit(False))), change(fresh.where("deleted"), True, F.lit(False))]
    changes = found[0]
    for more in found[1:]:
        changes = changes.unionByName(more)
    return there, changes


def once(spark: SparkSession, sync: Sync, targets: dict[str, peers.Target], folder: str, now: Column, overlap: int = progress.OVERLAP, after: Callable[[str], None] | None = None) -> int:
    """One cycle; the version that it leaves.

    targets: both peers, by the names in `sync`; folder: the state and all bookkeeping.
    Decisions are made on records that changed, together with all that they can rest on;
    an echo of our own write starts none.  A pair with a write that its peer refused
    is not remembered as in step.  after: called with the name of each step (for tests).
    """
    said = after or (lambda _: None)
    state = versions.read(spark, folder)
    state["links"] = written(state["links"])  # read by every step
    number = versions.last(spark, folder) + 1
    batch = f"{number:010d}"
    origins = swept(peers.log(spark, f"{folder}/peers/origins", TABLES["origins"], leave_out=batch), now)
    there, changes = polled(spark, sync, targets, state["watermarks"], origins, overlap)
    changes = _kept(changes, f"{folder}/polled", batch)
    said("polled")

    starts = [side for side, far in (("left", "right"), ("right", "left")) if far in DIRECTIONS[sync.mapping.direction]]
    foreign = changes.where(~F.col("echo") & F.col("side").isin(starts))
    ids = foreign.where("not deleted").select("side", "id")
    links = state["links"]
    if not state["watermarks"].isEmpty():
        keys = {k: f"key_{k}" for k in sync.keys}
        members = [identity.keys_of(rows, "remote_id", keys).select(F.lit(side).alias("side"), "id", "key_name", "key_value") for side, rows in there.items()]
        near = reached(members[0].unionByName(members[1]), links, ids)
        there = {side: written(rows.join(near.where(F.col("side") == side).select(F.col("id").alias("remote_id")), "remote_id", "left_semi")) for side, rows in there.items()}
    rows = decided(there["left"], there["right"], links, state["snapshots"], sync, stored=True)
    moved = {side: ids.where(F.col("side") == side).select(F.col("id").alias(f"_{side}")) for side in ("left", "right")}
    rows = rows.join(moved["left"], F.col("l_id") == F.col("_left"), "left").join(moved["right"], F.col("r_id") == F.col("_right"), "left").where("_left is not null or _right is not null").drop("_left", "_right")
    rows = _kept(rows, f"{folder}/decided", batch)
    said("decided")

    deletes = foreign.where("deleted").select("side", F.col("id").alias("remote_id"))
    sent = _kept(cycle.writes(rows, deletes, links, sync, now), f"{folder}/sent", batch)
    peers.write(sent, targets, f"{folder}/peers", batch, now, said)

    results = peers.idem_table(peers.log(spark, f"{folder}/peers/idem", TABLES["idem"] + ", step int")).where("not in_flight").select("key", F.col("remote_id").alias("_given"))
    answers = written(sent.select("key", "action", "source").join(results, "key", "left"))
    created = answers.where("action = 'create' and _given is not null").select("source", F.col("_given").alias("remote_id"))
    l_ref, r_ref = refs(sync)
    lost = answers.where("_given is null").select("source").distinct()
    for own in (l_ref, r_ref):
        rows = rows.join(lost, own == F.col("source"), "left_anti")
    change = {name: pair for name, pair in cycle.changed(rows, created, deletes, state, sync, now).items() if name in ("links", "snapshots", "keys")}
    change["review"] = (questions(rows, deleted_ends(deletes, links, sync), state["review"], sync, now), None)
    name = F.when(F.col("side") == "left", sync.left).otherwise(sync.right)
    seen = changes.select(name.alias("connector"), F.lit(sync.mapping.kind).alias("kind"), "at")
    marks = progress.advanced(state["watermarks"], seen, ["connector", "kind"], now)
    change["watermarks"] = (marks.join(state["watermarks"], ["connector", "kind", "mark"], "left_anti"), None)
    versions.commit(spark, folder, number, change, lambda table: said(f"state {table}"))
    return number


def questions(decisions: DataFrame, ends: DataFrame, review: DataFrame, sync: Sync, now: Column) -> DataFrame:
    """Rows of the review table for decisions that wait, without those that are open already: one question for each source."""
    rows, _ = standing(decisions, ends, sync)
    source = F.coalesce(*refs(sync))
    waits = rows.where("outcome = 'review' or d.action = 'escalate'")
    found = waits.select(review_id(F.lit(sync.name), source).alias("id"), F.lit(sync.name).alias("sync"), source.alias("ref"), F.when(F.col("outcome") == "review", F.col("why")).otherwise(F.col("d")["reason"]).alias("reason"), now.alias("created_at"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("payload"))
    return first_review(found).join(review.select("id"), "id", "left_anti")


def quiet(spark: SparkSession, sync: Sync, targets: dict[str, peers.Target], folder: str, now: Callable[[], Column] = F.current_timestamp, most: int = 10, overlap: int = progress.OVERLAP) -> int:
    """Cycles until one sends nothing, `most` of them at most; how many there were."""
    for n in range(1, most + 1):
        number = once(spark, sync, targets, folder, now(), overlap)
        if spark.read.parquet(f"{folder}/sent/batch={number:010d}").isEmpty():
            return n
    return most
