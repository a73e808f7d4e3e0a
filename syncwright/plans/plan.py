"""The dry run: what a cycle would do, as tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import ref, review_id, snapshot_hash
from ..operators import conflict, identity
from ..operators.numbering import numbered
from ..operators.mapping import DIRECTIONS, Mapping
from ..session import written


@dataclass(frozen=True)
class Sync:
    """One kind of record kept in agreement between two peers."""

    name: str
    left: str
    right: str
    mapping: Mapping
    keys: tuple[str, ...]
    policy: str = "review"
    per_field: tuple[tuple[str, str], ...] = ()
    on_ambiguous: str = "review"


def canonical(records: DataFrame, sync: Sync, side: str, *more: str) -> DataFrame:
    """(remote_id, updated_at, fields, hash, <keys>) of a peer's (remote_id, record variant, updated_at); more: further columns to keep."""
    out = records.select("remote_id", "updated_at", *more, sync.mapping.to_canonical(F.col("record"), side).alias("fields"))
    out = out.withColumn("hash", snapshot_hash(F.col("fields"), sync.mapping.names()))
    return out.withColumns({f"key_{k}": F.when(F.substring(F.col("fields")[k], 1, 1) == "s", F.substring(F.col("fields")[k], 2, 1 << 30)).otherwise(F.col("fields")[k]) for k in sync.keys})


def _side(alias: str, base: str) -> Column:
    return F.struct(F.col(f"{alias}.fields").alias("fields"), F.col(f"{alias}.hash").alias("hash"), F.col(f"{alias}.updated_at").alias("updated_at"), F.col(f"{base}.fields").alias("base"), F.col(f"{base}.hash").alias("synced_hash"))


def refs(sync: Sync) -> tuple[Column, Column]:
    """The refs of l_id and r_id."""
    kind = F.lit(sync.mapping.kind)
    return ref(F.lit(sync.left), kind, F.col("l_id")), ref(F.lit(sync.right), kind, F.col("r_id"))


def decided(left: DataFrame, right: DataFrame, links: DataFrame, snapshots: DataFrame, sync: Sync, stored: bool = False) -> DataFrame:
    """(l_id, r_id, outcome, why, l, r, d, lost, at) of every record: pairs once, with the decision d; records without a partner with one id.

    left, right: canonical records; links: (a, b) of remote ids; snapshots: (ref,
    hash, fields).  No record stands in two pairs (identity.partners).  Sides that a
    one-way mapping never reads from start nothing.  lost: the side whose linked record
    is not there.  The decisions are made once and written to the shared folder; plan,
    writes and state come from there.  stored: both sides are tables that were written already.
    """
    # either side is read four times, and its fields are dear to work out
    if not stored:
        left, right = written(left), written(right)
    keys = {k: f"key_{k}" for k in sync.keys}
    asked = lambda own, far, peer: identity.resolve(own, far, links, "remote_id", "remote_id", keys, peer, sync.on_ambiguous).withColumnRenamed("remote_id", "id")
    rows = identity.partners(asked(left, right, sync.right), asked(right, left, sync.left))
    starts = {"bidirectional": "true", "left_to_right": "by_left", "right_to_left": "by_right"}[sync.mapping.direction]
    rows = rows.where(starts).drop("by_left", "by_right")
    base = snapshots.select("ref", "hash", "fields")
    l_ref, r_ref = refs(sync)
    # an id that is not there is spread by the other one
    spread = lambda own, far: F.coalesce(F.col(own), F.concat(F.lit("\x00"), F.col(far)))
    joined = (
        rows.join(left.alias("l"), spread("l_id", "r_id") == F.col("l.remote_id"), "left").join(right.alias("r"), spread("r_id", "l_id") == F.col("r.remote_id"), "left")
        .join(base.alias("lb"), F.col("lb.ref") == F.coalesce(l_ref, spread("l_id", "r_id")), "left")
        .join(base.alias("rb"), F.col("rb.ref") == F.coalesce(r_ref, spread("r_id", "l_id")), "left")
    )
    there = {side: F.col(f"{side[0]}.remote_id").isNotNull() for side in ("left", "right")}
    d = conflict.resolve(_side("l", "lb"), _side("r", "rb"), sync.mapping.names(), sync.policy, dict(sync.per_field))
    lost = F.when(F.col("outcome") == "linked", F.when(~there["right"], "right").when(~there["left"], "left"))
    out = joined.select("l_id", "r_id", "outcome", "why", _side("l", "lb").alias("l"), _side("r", "rb").alias("r"), F.when(there["left"] & there["right"], d).alias("d"), lost.alias("lost"), F.coalesce("l.updated_at", "r.updated_at").alias("at"), *[F.coalesce(f"l.key_{k}", f"r.key_{k}").alias(f"key_{k}") for k in sync.keys])
    return _made_once(written(out), sync)


def _made_once(rows: DataFrame, sync: Sync) -> DataFrame:
    """rows in which, of the records of one side that share a key and that nobody answers to, only the first (by time, then id) is created.

    The others would make a second record of what may be one, so they wait for review.  The
    first of each key is a least value, so a key that very many share sends one row a task.
    """
    creates, key = F.col("outcome") == "create", [f"key_{k}" for k in sync.keys]
    side = F.when(F.col("r_id").isNull(), "left").otherwise("right")
    order = F.struct("at", F.coalesce("l_id", "r_id").alias("id"))
    for k, name in zip(sync.keys, key):
        there = creates & (F.coalesce(name, F.lit("")) != "")
        first = rows.where(there).groupBy(side.alias("_side"), F.col(name).alias("_value")).agg(F.min(order).alias(f"_first_{k}"), F.count("*").alias("_n"))
        # a key of one record needs no other look
        first = first.where("_n > 1").drop("_n")
        rows = rows.join(first, (F.col(name) == F.col("_value")) & there & (side == F.col("_side")), "left").drop("_side", "_value")
    late = [F.when(F.col(f"_first_{k}") != order, k) for k in sync.keys]
    shared = F.concat_ws(", ", *late)
    later = creates & (shared != "")
    why = F.when(later, F.concat(F.lit("an earlier record that is created matches on "), shared)).otherwise(F.col("why"))
    return rows.withColumns({"why": why, "outcome": F.when(later, "review").otherwise(F.col("outcome"))}).drop(*key, *[f"_first_{k}" for k in sync.keys])


def standing(rows: DataFrame, ends: DataFrame | None, sync: Sync) -> tuple[DataFrame, DataFrame]:
    """(decisions to act on, links (l_id, r_id) that lead nowhere) of decisions and the ends that were deleted.

    A pair with a deleted end is not compared.  A link to a record that is not there, and
    was not deleted as far as is known, is dropped, and the record at its other end is
    created anew; otherwise the pair would never be in step again.
    """
    if ends is not None:
        rows = rows.join(ends.select("l_id", "r_id"), ["l_id", "r_id"], "left_anti")
    nowhere = rows.where("lost is not null").select("l_id", "r_id")
    lost = F.col("lost")
    out = rows.withColumns({
        "l_id": F.when(lost.isNull() | (lost == "right"), F.col("l_id")), "r_id": F.when(lost.isNull() | (lost == "left"), F.col("r_id")),
        "outcome": F.when(lost.isNull(), F.col("outcome")).otherwise("create"), "why": F.when(lost.isNull(), F.col("why")).otherwise("the linked record is not there"),
    })
    return out.drop("lost"), nowhere


def _writable(fields: Column, sync: Sync, side: str) -> Column:
    return F.map_filter(fields, lambda k, _: k.isin(*sync.mapping.writable(side)))


def deleted_ends(deletes: DataFrame, links: DataFrame, sync: Sync) -> DataFrame:
    """(side, l_id, r_id) of the links (a, b) of which an end was deleted: (side, remote_id).  A record without a link ends nothing."""
    ends = links.select(F.col("a").alias("l_id"), F.col("b").alias("r_id"))
    by = {side: deletes.where(F.col("side") == side).select(F.col("remote_id").alias(own)).distinct() for side, own in (("left", "l_id"), ("right", "r_id"))}
    out = [ends.join(gone, own).select(F.lit(side).alias("side"), "l_id", "r_id") for side, own in (("left", "l_id"), ("right", "r_id")) if ("right" if side == "left" else "left") in DIRECTIONS[sync.mapping.direction] for gone in [by[side]]]
    rows = out[0] if len(out) == 1 else out[0].unionByName(out[1])
    # with both ends gone one delete is enough: the far one finds no link
    return rows.groupBy("l_id", "r_id").agg(F.min("side").alias("side")).select("side", "l_id", "r_id")


def planned(left: DataFrame, right: DataFrame, links: DataFrame, snapshots: DataFrame, sync: Sync, deletes: DataFrame | None = None) -> DataFrame:
    """(action, target, source, fields, reason, at, review) of each change or open question.

    deletes: (side, remote_id) of records that are gone.  Every record is decided
    once; what follows is made in its row.  A pair with a deleted end is deleted at
    the other one and not compared; a link that leads nowhere makes a create.
    """
    rows = decided(left, right, links, snapshots, sync)
    l_ref, r_ref = refs(sync)
    nothing, d = F.create_map().cast("map<string,string>"), F.col("d")
    ends = deleted_ends(deletes, links, sync) if deletes is not None else None
    rows, _ = standing(rows, ends, sync)

    def act(when: Column, action: str, target: Column, source: Column, fields: Column, reason: Column) -> Column:
        return F.when(when, F.struct(F.lit(action).alias("action"), target.alias("target"), source.alias("source"), fields.alias("fields"), reason.alias("reason")))

    to_left, to_right = _writable(d["left_values"], sync, "left"), _writable(d["right_values"], sync, "right")
    from_left = F.col("r_id").isNull()
    peer, source = F.when(from_left, sync.right).otherwise(sync.left), F.coalesce(l_ref, r_ref)
    values = F.when(from_left, _writable(F.col("l")["fields"], sync, "right")).otherwise(_writable(F.col("r")["fields"], sync, "left"))
    actions = F.array_compact(
        F.array(
            act(d["action"].isin("write_right", "write_both") & (F.size(to_right) > 0), "update", r_ref, l_ref, to_right, d["reason"]),
            act(d["action"].isin("write_left", "write_both") & (F.size(to_left) > 0), "update", l_ref, r_ref, to_left, d["reason"]),
            act(d["action"] == "escalate", "review", r_ref, l_ref, nothing, d["reason"]),
            act(F.col("outcome") == "create", "create", peer, source, values, F.col("why")),
            act(F.col("outcome") == "review", "review", peer, source, nothing, F.col("why")),
        )
    )
    out = rows.select(F.explode(actions).alias("x"), "at").select("x.*", "at")
    if ends is not None:
        at_left = F.col("side") == "left"
        out = out.unionByName(ends.select(F.lit("delete").alias("action"), F.when(at_left, r_ref).otherwise(l_ref).alias("target"), F.when(at_left, l_ref).otherwise(r_ref).alias("source"), nothing.alias("fields"), F.lit("the source was deleted").alias("reason"), F.lit(None).cast("timestamp").alias("at")))
    return out.withColumn("review", F.when(F.col("action") == "review", review_id(F.lit(sync.name), F.col("source"))))


def named(plan: DataFrame, sync: Sync) -> DataFrame:
    """The changes of a plan in the order of events, with `n`, and with planned-n as the id of each record yet to be created.

    Events of the left peer stand before those of the right one, deletes before the rest,
    then by time and ref.  Open questions have no number.
    """
    side = F.when(F.startswith(F.col("source"), F.lit(f"{sync.left}:")), 0).otherwise(1)
    out = numbered(plan.where("action <> 'review'").withColumn("_side", side), ["_side", F.col("at").asc_nulls_first(), "source", "action"]).drop("_side")
    target = F.when(F.col("action") == "create", F.concat("target", F.lit(f":{sync.mapping.kind}/planned-"), F.col("n").cast("string"))).otherwise(F.col("target"))
    return out.withColumn("target", target)


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("action").agg(F.count("*").alias("n"))
