"""Recognising our own writes when they come back as changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .progress import ECHO_WINDOW
from .state import live


def expiry(connector: Column, written_at: Column, windows: dict[str, int] | None = None) -> Column:
    """When a write's origin expires: peers differ in how long they take to send it back; windows in seconds, by connector."""
    seconds = F.lit(ECHO_WINDOW)
    for name, own in (windows or {}).items():
        seconds = F.when(connector == name, own if own > 0 else ECHO_WINDOW).otherwise(seconds)
    return written_at + F.make_dt_interval(secs=seconds)


def classify(events: DataFrame, writes: DataFrame, now, order: list[str]) -> DataFrame:
    """events (ref, hash, ...) with `verdict`: echo, near_miss or foreign.

    writes: (ref, hash, expires_at), the log of what we wrote.  An entry
    answers one event only: of several events with its hash, in `order`, as many
    are echoes as there are entries.  Other events on a ref we wrote to lately
    are near misses.  Only events with an entry are numbered; foreign traffic is not sorted.
    """
    alive = writes.where(live(F.col("expires_at"), now))
    entries = alive.groupBy(F.col("ref").alias("_r"), F.col("hash").alias("_h")).agg(F.count("*").alias("_entries"))
    joined = events.join(entries, (F.col("ref") == F.col("_r")) & (F.col("hash") == F.col("_h")), "left")
    turn = F.row_number().over(Window.partitionBy("ref", "hash").orderBy(*order))
    met = joined.where("_entries is not null").withColumn("_echo", turn <= F.col("_entries"))
    rest = joined.where("_entries is null").withColumn("_echo", F.lit(False))
    recent = alive.select(F.col("ref").alias("_recent")).distinct()
    judged = met.unionByName(rest).join(recent, F.col("ref") == F.col("_recent"), "left")
    verdict = F.when(F.col("_echo"), "echo").when(F.col("_recent").isNotNull(), "near_miss").otherwise("foreign")
    return judged.select(*events.columns, verdict.alias("verdict"))


def processed(verdict):
    """Whether an event goes on: only an echo stops."""
    return verdict != "echo"
