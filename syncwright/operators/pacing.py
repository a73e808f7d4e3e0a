"""When calls to a peer may go: one token bucket for each peer, whose balance may be owed.

A bucket that holds `burst` tokens and earns one each `step` lets call i of its peer, made
at a_i, wait for

    max(0, i * step - a_i + max over j <= i of (a_j - (j - 1) * step) - burst * step)

so the waits of all calls come of numbers and running maxima, not of a loop over calls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

# What a peer that names no limit gets.
RATE, BURST = 5, 10


def _by_peer(peer: Column, limits: dict[str, tuple[float, int]], value, default: int) -> Column:
    """value(rate, burst) of the limit of `peer`; there are as many limits as connectors."""
    out = F.lit(default).cast("long")
    for name, limit in sorted(limits.items()):
        out = F.when(peer == name, F.lit(value(*limit)).cast("long")).otherwise(out)
    return out


def step(rate: float) -> int:
    """Microseconds in which a token is earned."""
    return round(1_000_000 / rate)


def paced(calls: DataFrame, limits: dict[str, tuple[float, int]], peer: str = "peer", at: str = "at", order: tuple[str, ...] = ("id",)) -> DataFrame:
    """calls with wait_micros: how long each waits for its token; limits: rate a second and burst by peer.

    Calls are taken by time, then by `order`, which makes that total.  They are dealt by
    range, so a peer with most of the calls is spread over tasks; only one row for each task
    and peer (how many calls, and their maximum) is carried from task to task.  A call
    without a time takes no token and has no wait; a null peer is a peer of its own.
    """
    parts = int(calls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each, burst = _by_peer(F.col(peer), limits, lambda r, b: step(r), step(RATE)), _by_peer(F.col(peer), limits, lambda r, b: b, BURST)
    timed = calls.where(F.col(at).isNotNull())
    dealt = timed.repartitionByRange(parts, peer, at, *order).sortWithinPartitions(peer, at, *order)
    placed = checkpointed(dealt.withColumn("_id", F.monotonically_increasing_id()))

    # within a task: the number of a call, and the maximum up to it as if the peer's calls began here
    here = Window.partitionBy("_task", peer).orderBy("_id")
    rows = placed.withColumn("_task", F.shiftright("_id", 33)).withColumn("_n", F.row_number().over(here).cast("long"))
    rows = rows.withColumn("_at", F.unix_micros(F.col(at).cast("timestamp"))).withColumn("_step", each)
    rows = rows.withColumn("_own", F.max(F.col("_at") - (F.col("_n") - 1) * F.col("_step")).over(here))

    # from task to task: the calls before, and their maximum
    earlier = Window.partitionBy("_peer").orderBy("_in").rowsBetween(Window.unboundedPreceding, -1)
    task = rows.groupBy(F.col("_task").alias("_in"), F.col(peer).alias("_peer")).agg(F.count("*").alias("_calls"), F.max("_own").alias("_most"), F.first("_step").alias("_each"))
    task = task.withColumn("_before", F.coalesce(F.sum("_calls").over(earlier), F.lit(0)))
    task = task.withColumn("_carried", F.max(F.col("_most") - F.col("_before") * F.col("_each")).over(earlier)).select("_in", "_peer", "_before", "_carried")

    rows = rows.join(task, (F.col("_task") == F.col("_in")) & F.col(peer).eqNullSafe(F.col("_peer")))
    most = F.greatest("_carried", F.col("_own") - F.col("_before") * F.col("_step"))  # greatest passes over nulls
    wait = F.greatest(F.lit(0).cast("long"), (F.col("_before") + F.col("_n") - burst) * F.col("_step") - F.col("_at") + most)
    untimed = calls.where(F.col(at).isNull()).withColumn("wait_micros", F.lit(None).cast("long"))
    return rows.withColumn("wait_micros", wait).select(*calls.columns, "wait_micros").unionByName(untimed)


def released(calls: DataFrame, at: str = "at") -> DataFrame:
    """What `paced` returned, with released_at: when a call may go."""
    return calls.withColumn("released_at", F.timestamp_micros(F.unix_micros(F.col(at).cast("timestamp")) + F.col("wait_micros")))
