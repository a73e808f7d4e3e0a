"""Deliveries as a stream: authenticated before they are parsed, each taken once."""

from __future__ import annotations

import hashlib
import hmac
from bisect import bisect
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from ..operators.progress import DELIVERY_TTL

EVENT = "kind string, remote_id string, deleted boolean, record string"
MOST_BYTES = 4 << 20


def signature(secret: bytes, ts: int, body: bytes) -> str:
    """HMAC-SHA256, in hex, of the time, a dot and the body."""
    return hmac.new(secret, str(ts).encode() + b"." + body, hashlib.sha256).hexdigest()


def verified(secret: bytes):
    """A column builder (ts, body, signature) -> whether the signature is right, compared in constant time."""

    @F.pandas_udf("boolean")
    def check(ts: pd.Series, body: pd.Series, sent: pd.Series) -> pd.Series:
        return pd.Series([b is not None and s is not None and pd.notna(t) and hmac.compare_digest(signature(secret, int(t), b.encode()), s) for t, b, s in zip(ts, body, sent)])

    return check


def accepted(deliveries: DataFrame, secret: bytes, now: Column, window: int = 300) -> DataFrame:
    """Events of deliveries (connector, delivery, ts, body, signature) of a right signature and a near time.

    The filter stands before the parser; body: a JSON array of events.
    """
    near = F.abs(F.unix_timestamp(now) - F.col("ts")) <= window
    good = deliveries.where(near & (F.octet_length("body") <= MOST_BYTES)).where(verified(secret)(F.col("ts"), F.col("body"), F.col("signature")))
    return good.select("connector", "delivery", F.timestamp_seconds("ts").alias("at"), F.explode(F.from_json("body", f"array<struct<{EVENT.replace(' ', ':').replace(',:', ',')}>>")).alias("e")).select("connector", "delivery", "at", "e.*")


KEY = ["connector", "delivery", "kind", "remote_id"]


def once(events: DataFrame, seen: DataFrame | None = None, ttl: int = DELIVERY_TTL) -> DataFrame:
    """Batch: events of a delivery key that was not taken in the `ttl` seconds before; events without a delivery id all pass.

    seen: (connector, delivery, kind, remote_id, at) of keys taken earlier.  A key that
    comes again after `ttl` is a new delivery.  Repeats at one time are one row before the
    times of a key meet; those are sorted and folded once.
    """
    values = ["at", *[c for c in events.columns if c not in (*KEY, "at")]]
    named = events.where("delivery <> ''").groupBy(*KEY, "at").agg(F.min(F.struct(*values)).alias("_row"))
    times = named.groupBy(*KEY).agg(F.array_sort(F.collect_list("_row")).alias("_rows"))
    if seen is None:
        times = times.withColumn("_last", F.lit(None).cast("timestamp"))
    else:
        times = times.join(seen.groupBy(*KEY).agg(F.max("at").alias("_last")), KEY, "left")
    apart = lambda row, last: last.isNull() | (F.unix_micros(row["at"]) - F.unix_micros(last) >= ttl * 1_000_000)
    start = F.struct(F.col("_last").alias("last"), F.slice("_rows", 1, 0).alias("kept"))
    step = lambda so_far, row: F.when(apart(row, so_far["last"]), F.struct(row["at"].alias("last"), F.array_append(so_far["kept"], row).alias("kept"))).otherwise(so_far)
    taken = times.select(*KEY, F.explode(F.aggregate("_rows", start, step)["kept"]).alias("_row"))
    taken = taken.select(*KEY, *[F.col("_row")[c].alias(c) for c in values]).select(*events.columns)
    return taken.unionByName(events.where("coalesce(delivery, '') = ''"))


def _first_of_key(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, ttl: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    times = sorted(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values("at", kind="stable")
    kept = []
    for k, at in enumerate(rows["at"]):
        micros = at.value // 1000
        place = bisect(times, micros)
        if all(abs(t - micros) >= ttl * 1_000_000 for t in times[max(0, place - 1) : place + 1]):
            times.insert(place, micros)
            kept.append(k)
    state.update((times,))
    state.setTimeoutDuration(ttl * 1000)
    yield rows.iloc[kept]


def once_streaming(events: DataFrame, ttl: int = DELIVERY_TTL) -> DataFrame:
    """Stream: the same, with the times at which each key was taken kept for `ttl` seconds after it was last used.

    There is no watermark, so a late event is judged by its key like any other and never
    dropped for its time: it is taken if it is `ttl` seconds from all that were taken, be
    they before or after it, and then it counts as they do, so its own repeats stop.  Keys
    expire by the clock: use a trigger that goes on, not availableNow.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in events.schema)
    named = events.where("delivery <> ''").groupBy(*KEY).applyInPandasWithState(partial(_first_of_key, ttl=ttl), schema, "times array<long>", "append", "ProcessingTimeTimeout")
    return named.unionByName(events.where("coalesce(delivery, '') = ''"))
