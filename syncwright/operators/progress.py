"""Incremental reading, idempotent writing and retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values, in seconds unless said: defaults of the engine.
OVERLAP, COARSE_OVERLAP, IDEM_TTL, ECHO_WINDOW, DELIVERY_TTL = 120, 300, 3600, 300, 86400
BACKOFF_MS, MOST_BACKOFF_MS, LEAST_BACKOFF_MS = 250, 30_000, 100
RETRYABLE = ("transient", "rate_limited", "unknown")
ERROR_KINDS = ("unknown", "transient", "rate_limited", "auth", "not_found", "permanent")


def overlap(configured: int = OVERLAP, exact_times: bool = True) -> int:
    return configured if exact_times else max(configured, COARSE_OVERLAP)


def since(mark: Column, overlap_seconds: int) -> Column:
    """Where to read on from; null without a mark, which means from the start."""
    return mark - F.make_dt_interval(secs=F.lit(overlap_seconds))


def delta(rows: DataFrame, updated_at: str, start: Column | None) -> DataFrame:
    """Rows changed at or after `start`; all without one.  `in_order` gives the order in which peers send them."""
    return rows if start is None else rows.where(F.col(updated_at) >= start)


def in_order(rows: DataFrame, updated_at: str, id_col: str) -> DataFrame:
    """A delta in the order of change, ties by id, so that a page cut anywhere loses nothing."""
    return rows.orderBy(updated_at, id_col)


def advanced(marks: DataFrame, seen: DataFrame, keys: list[str], now: Column) -> DataFrame:
    """marks (keys, mark) moved to the highest time seen (keys, at): never back, never past now."""
    top = seen.groupBy(*keys).agg(F.least(F.max("at"), now).alias("_top"))
    return marks.join(top, keys, "full").select(*keys, F.greatest("mark", "_top").alias("mark"))


def idem_decision(writes: DataFrame, idem: DataFrame, now: Column) -> DataFrame:
    """writes (key, ...) with `decision`: replayed, recheck (begun, never answered) or proceed."""
    known = idem.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("key").alias("_key"), "in_flight", F.col("remote_id").alias("known_id"))
    joined = writes.join(known, F.col("key") == F.col("_key"), "left")
    decision = F.when(F.col("_key").isNull(), "proceed").when(F.col("in_flight"), "recheck").otherwise("replayed")
    return joined.select(*writes.columns, decision.alias("decision"), F.when(decision == "replayed", F.col("known_id")).alias("known_id"))


def begun(writes: DataFrame, idem: DataFrame, now: Column, ttl: int = IDEM_TTL) -> DataFrame:
    """idem with a mark in flight for each key of writes (key) that has no live row: intent is written before the call."""
    alive = idem.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    marks = writes.select("key").distinct().join(alive.select("key"), "key", "left_anti")
    marks = marks.select("key", F.lit(None).cast("string").alias("remote_id"), F.lit(False).alias("created"), F.lit(True).alias("in_flight"), now.alias("written_at"), (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))
    return alive.select(*marks.columns).unionByName(marks)


def settled(idem: DataFrame, results: DataFrame, now: Column, ttl: int = IDEM_TTL) -> DataFrame:
    """idem after the calls: results (key, remote_id, created, failed, error_kind).

    A success is committed.  An error that the peer answered did not land, so its mark
    goes; a failure without an answer keeps it, since the write may have landed.
    """
    good = results.where("not failed").select("key", "remote_id", "created", F.lit(False).alias("in_flight"), now.alias("written_at"), (now + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"))
    gone = results.where(~F.col("failed") | answered(F.col("error_kind"))).select("key").distinct()
    return idem.join(gone, "key", "left_anti").select(*good.columns).unionByName(good)


def kind_of(kind: Column, failed: Column) -> Column:
    """The class of an outcome: unknown without a failure, transient for a failure of no class."""
    return F.when(failed, F.coalesce(kind, F.lit("transient"))).otherwise(F.lit("unknown"))


def answered(kind: Column) -> Column:
    """Whether the peer replied: only its own errors have a class; otherwise the outcome is not known."""
    return kind.isNotNull()


def deleted_scan(before: DataFrame, now_there: DataFrame, id_col: str) -> DataFrame:
    """(id) of records that a peer had and has no more."""
    return before.select(id_col).distinct().join(now_there.select(id_col), id_col, "left_anti")


def retryable(kind: Column) -> Column:
    """Errors worth another try; one without a kind counts as transient."""
    return F.coalesce(kind, F.lit("transient")).isin(*RETRYABLE)


def backoff_window(attempts: Column) -> Column:
    """Milliseconds: 250 doubled for each attempt after the first, 30 s at most."""
    return F.least(F.lit(MOST_BACKOFF_MS), F.lit(BACKOFF_MS) * F.pow(F.lit(2), F.least(F.greatest(attempts, F.lit(1)), F.lit(20)) - 1).cast("long")).cast("long")


def backoff(attempts: Column, ref: Column, hint: Column | None = None) -> Column:
    """A delay within the window, the same for the same ref and attempt; 100 ms at least; a longer hint wins."""
    jitter = F.greatest(F.lit(LEAST_BACKOFF_MS).cast("long"), F.pmod(F.xxhash64(ref, attempts), backoff_window(attempts) + 1))
    return jitter if hint is None else F.greatest(jitter, F.coalesce(hint, F.lit(0)))


def failed(events: DataFrame, most_attempts: int = 6) -> tuple[DataFrame, DataFrame]:
    """(to retry, dead letters) of events with error_kind and attempts (tries so far)."""
    again = retryable(F.col("error_kind")) & (F.col("attempts") < most_attempts)
    return events.where(again).withColumn("delay_ms", backoff(F.col("attempts"), F.col("ref"))), events.where(~again)


def hydrated(events: DataFrame, current: DataFrame, id_col: str) -> DataFrame:
    """events with `record` from the peer's table where they came without one; `gone`: no record is to be found."""
    known = current.select(F.col(id_col).alias("_id"), F.col("record").alias("_now"))
    joined = events.join(known, F.col(id_col) == F.col("_id"), "left")
    record = F.coalesce("record", "_now")
    return joined.select(*[c for c in events.columns if c not in ("record", "deleted")], record.alias("record"), (F.col("deleted") | record.isNull()).alias("gone"))
