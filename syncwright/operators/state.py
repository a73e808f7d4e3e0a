"""Keyed state as plain tables: expiry, latest-wins compaction, overlays and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The state tables and their columns.
TABLES = {
    "links": "a string, b string, linked_at timestamp",
    "snapshots": "ref string, hash string, fields map<string,string>, at timestamp",
    "origins": "ref string, hash string, written_at timestamp, expires_at timestamp",
    "idem": "key string, remote_id string, created boolean, in_flight boolean, written_at timestamp, expires_at timestamp",
    "deliveries": "connector string, delivery string, at timestamp, expires_at timestamp",
    "dlq": "id string, sync string, ref string, reason string, created_at timestamp, attempts int, payload string",
    "review": "id string, sync string, ref string, reason string, created_at timestamp, attempts int, payload string",
    "watermarks": "connector string, kind string, mark timestamp",
    "keys": "ref string, key_name string, key_value string",
}

# What tells a row of each state table from the others; never null.
KEYS = {
    "links": ["a", "b"], "snapshots": ["ref"], "origins": ["ref", "hash", "written_at"], "idem": ["key"], "deliveries": ["connector", "delivery"],
    "dlq": ["id"], "review": ["id"], "watermarks": ["connector", "kind"], "keys": ["ref", "key_name"],
}


def live(expires_at: Column, now: Column) -> Column:
    """No expiry, or one that lies strictly ahead."""
    return expires_at.isNull() | (expires_at > now)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key; a partial aggregate, so a hot key sends one row a task."""
    values = [c for c in rows.columns if c not in keys]
    kept = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), F.col(order)).alias("_row"))
    return kept.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values]).select(*rows.columns)


def overlay(base: DataFrame, written: DataFrame, deleted: DataFrame, keys: list[str]) -> DataFrame:
    """base as a dry run sees it: without its deleted and rewritten rows, with its written ones."""
    gone = written.select(*keys).union(deleted.select(*keys)).distinct()
    return base.join(gone, keys, "left_anti").unionByName(written.join(deleted.select(*keys).distinct(), keys, "left_anti"))


def swept(rows: DataFrame, now: Column) -> DataFrame:
    return rows.where(live(F.col("expires_at"), now))


def taken(rows: DataFrame, wanted: DataFrame, keys: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """(live rows asked for, rows left): an expired row is no answer but goes too."""
    asked = wanted.select(*keys).distinct()
    return rows.join(asked, keys, "left_semi").where(live(F.col("expires_at"), now)), rows.join(asked, keys, "left_anti")


def oldest_first(queue: DataFrame, limit: int = 0) -> DataFrame:
    ordered = queue.orderBy("created_at", "id")
    return ordered.limit(limit) if limit > 0 else ordered


def first_review(items: DataFrame) -> DataFrame:
    """One open question for each id: the first time it was seen, with what it held then."""
    values = [c for c in items.columns if c != "id"]
    return items.groupBy("id").agg(F.min_by(F.struct(*values), "created_at").alias("_row")).select("id", *[F.col(f"_row.{c}").alias(c) for c in values])


def listed(rows: DataFrame, key: str, limit: int = 0, now: Column | None = None) -> DataFrame:
    """Live rows in the order of their keys; limit: the first so many, 0 for all."""
    alive = rows if now is None else rows.where(live(F.col("expires_at"), now))
    ordered = alive.orderBy(key)
    return ordered.limit(limit) if limit > 0 else ordered


def discarded(queue: DataFrame, ids: DataFrame) -> DataFrame:
    """The queue without the items of `ids` (id)."""
    return queue.join(ids.select("id").distinct(), "id", "left_anti")


def replayed(dead: DataFrame, ids: DataFrame, syncs: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events to submit, the queue left, ids that cannot be replayed with `problem`) of dead letters (id, sync, payload, ...).

    Attempts start anew.  An id that is not there, and an item of a sync that is no
    longer configured, is a problem and changes nothing.
    """
    asked = ids.select("id").distinct()
    known = F.col("sync").isin(*syncs) if syncs else F.lit(False)
    found = dead.join(asked, "id", "left_semi").where(known)
    judged = asked.join(dead.select("id", "sync"), "id", "left")
    problem = F.when(F.col("sync").isNull(), "no such item").when(~known, F.concat(F.lit("sync "), "sync", F.lit(" is not configured")))
    return found.select("id", "sync", "payload", F.lit(0).alias("attempts")), dead.join(found.select("id"), "id", "left_anti"), judged.select("id", problem.alias("problem")).where("problem is not null")


def due(queue: DataFrame, now: Column) -> DataFrame:
    """Items whose not_before has come (null: at once), the earliest first."""
    return queue.where(F.col("not_before").isNull() | (F.col("not_before") <= now)).orderBy(F.col("not_before").asc_nulls_first(), "id")


def lengths(tables: dict[str, DataFrame], now: Column) -> DataFrame:
    """(collection, n) of the live rows of each table; empty ones count 0."""
    spark = next(iter(tables.values())).sparkSession
    names = spark.createDataFrame([(n,) for n in tables], "collection string")
    rows = [t.where(live(F.col("expires_at"), now) if "expires_at" in t.columns else F.lit(True)).select(F.lit(n).alias("collection")) for n, t in tables.items()]
    found = rows[0]
    for more in rows[1:]:
        found = found.unionByName(more)
    return F.broadcast(names).join(found.groupBy("collection").agg(F.count("*").alias("n")), "collection", "left").select("collection", F.coalesce("n", F.lit(0)).alias("n"))
