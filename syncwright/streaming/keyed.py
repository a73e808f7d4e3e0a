"""Events of two peers as a stream in which each logical record is handled once a micro-batch.

Links and keys are logs in the folder `state` (peers.append_once), so a micro-batch that
runs twice leaves them as one run does.  A create's id at the other peer follows from its
idempotency key, so its link is known in the micro-batch that makes it, and its echo finds
the link in whichever micro-batch it comes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import idempotency_key
from ..operators import serial
from ..sources import peers

EVENTS = "ref string, side string, at timestamp, keys map<string,string>, record string, hash string"
KEYS = "ref string, side string, key_name string, key_value string"
LINKS = "a string, b string"
REVIEWS = "source string, batch string"


def batch(events: DataFrame, targets: dict[str, peers.Target], state: str, name: str, now: Column) -> None:
    """One batch of EVENTS: pairs are linked, creates written to the other peer (`targets` by side), the rest put to review.

    A record's last event in the batch holds what is sent.  ref: side:kind/id.
    """
    spark = events.sparkSession
    known_keys, links = peers.log(spark, f"{state}/keys", KEYS, leave_out=name).distinct(), peers.log(spark, f"{state}/links", LINKS, leave_out=name).distinct()
    last = events.groupBy("ref", "side").agg(F.max_by(F.struct("keys", "record", "hash"), F.struct("at", "hash")).alias("e"), F.min("at").alias("at"))
    named = last.select("ref", "side", F.explode("e.keys").alias("key_name", "key_value")).where("key_value is not null and key_value <> ''")
    peers.append_once(named, f"{state}/keys", f"{name}-1")
    decisions = serial.decided(last.select("ref", "side", "at"), named.select("ref", "key_name", "key_value"), known_keys, links)
    peers.append_once(decisions, f"{state}/decisions", name)
    decisions = peers.log(spark, f"{state}/decisions", "group string, action string, left string, right string, source string").where(F.input_file_name().contains(f"/batch={name}/"))

    source = last.select(F.col("ref").alias("source"), "side", "e.*")
    other, kind = F.when(F.col("side") == "left", "right").otherwise("left"), F.split_part(F.split_part("source", F.lit(":"), F.lit(2)), F.lit("/"), F.lit(1))
    key = idempotency_key(F.lit("serial"), kind, F.col("side"), F.col("source"), other, F.lit(""), F.lit(""))
    made = decisions.where("action = 'create'").select("source").join(source, "source").withColumns({"other": other, "key": key, "kind": kind})
    sent = made.select(F.col("other").alias("connector"), F.lit("serial").alias("sync"), F.lit("create").alias("action"), F.lit(None).cast("string").alias("remote_id"), "record", "hash", "key", "source", now.alias("at"))
    peers.write(sent, targets, state, name, now)
    new = F.concat("other", F.lit(":"), "kind", F.lit("/"), peers.new_id(F.col("key")))
    at_left = F.col("side") == "left"
    paired = decisions.where("action = 'pair'").select(F.col("left").alias("a"), F.col("right").alias("b"))
    peers.append_once(paired.union(made.select(F.when(at_left, F.col("source")).otherwise(new), F.when(at_left, new).otherwise(F.col("source")))), f"{state}/links", name)
    peers.append_once(made.select(new.alias("ref"), F.col("other").alias("side"), F.explode("keys").alias("key_name", "key_value")).where("key_value is not null and key_value <> ''"), f"{state}/keys", f"{name}-2")
    peers.append_once(decisions.where("action = 'review'").select("source", F.lit(name).alias("batch")), f"{state}/reviews", name)


def run(stream: DataFrame, targets: dict[str, peers.Target], state: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp):
    """A writer of a stream of EVENTS: each micro-batch is one `batch` under its number.  `.start()` it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: batch(rows, targets, state, f"{number:010d}", now()))
