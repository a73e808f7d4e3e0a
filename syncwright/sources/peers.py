"""Peers that are written to: a log of record versions in batches, and the write path with its bookkeeping.

A peer is a folder of batches of record versions (PEER).  A batch is a folder that Spark's
own writer fills and completes with its _SUCCESS mark; what has no mark was never
written, and a batch that has one stays as it is, whoever tries again.  So a batch that
runs twice, or is killed anywhere and runs again under its name, leaves the same rows.

A write goes in the order intent, write, commit: a mark in flight for each idempotency key,
the new record versions, then results, origins and rejections.  `sink` does this for each
micro-batch of a stream of writes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import progress
from ..operators.origin import expiry
from ..operators.state import TABLES
from ..session import empty, written

# The columns of a peer's record versions and of the writes that go to peers.
PEER = "remote_id string, version long, updated_at timestamp, deleted boolean, record string, keys array<string>"
WRITES = "connector string, sync string, action string, remote_id string, record string, hash string, key string, source string, at timestamp"


def _done(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def _batches(spark: SparkSession, folder: str) -> list[str]:
    """The completed batches of a folder, in order of name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(path):
        return []
    names = sorted(s.getPath().getName() for s in store.listStatus(path) if s.isDirectory())
    return [f"{folder}/{n}" for n in names if n.startswith("batch=") and _done(spark, f"{folder}/{n}")]


def append_once(rows: DataFrame, folder: str, name: str) -> None:
    """rows as the batch `name` of a folder, unless that batch was completed before."""
    path = f"{folder.rstrip('/')}/batch={name}"
    if not _done(rows.sparkSession, path):
        rows.write.mode("overwrite").parquet(path)


def log(spark: SparkSession, folder: str, schema: str, leave_out: str | None = None) -> DataFrame:
    """All rows of the completed batches of a folder; leave_out: a batch that is not read, with all its steps (name-...)."""
    own = lambda path: leave_out is not None and f"{path.rpartition('/batch=')[2]}-".startswith(f"{leave_out}-")
    found = [b for b in _batches(spark, folder.rstrip("/")) if not own(b)]
    return spark.read.schema(schema).parquet(*found) if found else empty(spark, schema)


def current(versions: DataFrame) -> DataFrame:
    """The last version of each record, deleted ones too: a partial aggregate, so one of many versions sends one row a task."""
    values = [c for c in versions.columns if c != "remote_id"]
    return versions.groupBy("remote_id").agg(F.max_by(F.struct(*values), "version").alias("v")).select("remote_id", *[F.col(f"v.{c}").alias(c) for c in values])


def shallow(old: Column, new: Column) -> Column:
    """JSON of an object with the top-level fields of another over it; null counts as no fields."""
    fields = lambda doc: F.parse_json(F.coalesce(doc, F.lit("{}"))).cast("map<string,variant>")
    return F.to_json(F.map_zip_with(fields(old), fields(new), lambda _, a, b: F.coalesce(b, a)))


def new_id(key: Column) -> Column:
    """The id that a peer gives to a record: the same for the same idempotency key."""
    return F.concat(F.lit("n-"), F.substring(key, 1, 16))


def upserted(versions: DataFrame, writes: DataFrame, now: Column) -> DataFrame:
    """PEER rows for writes (action, remote_id, record, key, at): a create for an id that is empty or unknown, else fields written over.

    A write whose key the peer knows leaves nothing: its first result stands.  Several
    writes to a record follow one another by (at, key) and make one version: each field has
    its last value, and what stood before a delete counts no more.  A delete of a record
    that is not there is done already.
    """
    known = versions.select(F.explode("keys").alias("_known")).distinct()
    fresh = writes.join(known, F.col("key") == F.col("_known"), "left_anti")
    fresh = fresh.withColumn("remote_id", F.when(F.coalesce("remote_id", F.lit("")) == "", new_id(F.col("key"))).otherwise(F.col("remote_id"))).withColumn("_order", F.struct("at", "key"))
    deletes = F.when(F.col("action") == "delete", F.col("_order"))
    ends = fresh.groupBy("remote_id").agg(F.max("_order").alias("_last"), F.max(deletes).alias("_cut"), F.array_sort(F.collect_set("key")).alias("keys"))
    later = fresh.where("action <> 'delete'").join(ends.select("remote_id", "_cut"), "remote_id").where("_cut is null or _order > _cut")
    field = later.select("remote_id", "_order", F.explode(F.parse_json("record").cast("map<string,variant>")).alias("name", "value"))
    field = field.groupBy("remote_id", "name").agg(F.max_by(F.to_json("value"), "_order").alias("value"))
    fields = field.groupBy("remote_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_new"))
    joined = ends.join(fields, "remote_id", "left").join(current(versions).select("remote_id", "version", "deleted", F.col("record").alias("_old")), "remote_id", "left")
    gone = F.coalesce(F.col("_last") == F.col("_cut"), F.lit(False))
    alive = F.coalesce(~F.col("deleted"), F.lit(False))
    new = F.to_json(F.transform_values(F.coalesce("_new", F.create_map().cast("map<string,string>")), lambda _, v: F.parse_json(v)))
    record = F.when(gone, F.col("_old")).otherwise(shallow(F.when(alive & F.col("_cut").isNull(), F.col("_old")), new))
    return joined.where(~gone | alive).select("remote_id", (F.coalesce("version", F.lit(0)) + 1).cast("long").alias("version"), now.alias("updated_at"), gone.alias("deleted"), record.alias("record"), "keys")


@dataclass(frozen=True)
class Target:
    """A peer to write to: its folder, and what its schema demands."""

    folder: str
    fields: tuple[str, ...] | None = None
    required: tuple[str, ...] = ()
    read_only: tuple[str, ...] = ()
    window: int = progress.ECHO_WINDOW


def rejection(target: Target, record: Column, creates: Column) -> Column:
    """Why a peer would not take a record: the first field in order of name; null if it takes it."""
    fields = F.parse_json(record).cast("map<string,variant>")
    names = F.array_sort(F.map_keys(fields))
    wrong = F.lit(None).cast("string")
    first = lambda found, text: F.when(F.size(found) > 0, F.concat(F.lit(text), F.get(found, 0)))
    if target.fields is not None:
        wrong = F.coalesce(wrong, first(F.array_except(names, F.array(*map(F.lit, target.fields)).cast("array<string>")), "there is no field "))
    if target.read_only:
        wrong = F.coalesce(wrong, first(F.array_intersect(names, F.array(*map(F.lit, target.read_only))), "it is not allowed to write "))
    if target.required:
        empty = lambda f: F.try_variant_get(F.parse_json(record), f'$["{f}"]', "string")
        lost = F.array_compact(F.array(*[F.when(F.coalesce(empty(f), F.lit("")) == "", F.lit(f)) for f in sorted(target.required)]))
        given = F.filter(lost, lambda f: creates | F.array_contains(names, f))
        wrong = F.coalesce(wrong, first(given, "a value is required for "))
    return wrong


def write(writes: DataFrame, targets: dict[str, Target], state: str, batch: str, now: Column, after: Callable[[str], None] | None = None) -> None:
    """One batch of writes (WRITES): to the peers, and to idem, origins and dlq in the folder `state`.

    An empty remote_id is a create.  A key with a live result is not written again; one that
    is in flight from another batch is written again if its target is known, and else waits
    for a poll to show whether the record is there.  A rejected write is an answer: its mark
    goes, and it stands among the dead letters.  after: called with the name of each step
    that is done (for tests that stop there).
    """
    spark = writes.sparkSession
    said = after or (lambda _: None)
    idem = idem_table(log(spark, f"{state}/idem", TABLES["idem"] + ", step int", leave_out=batch))
    asked = writes.withColumn("remote_id", F.coalesce("remote_id", F.lit(""))).groupBy("key").agg(F.min(F.struct(*[c for c in writes.columns if c != "key"])).alias("w")).select("key", "w.*")
    asked = progress.idem_decision(asked, idem, now).where("decision = 'proceed' or decision = 'recheck' and remote_id <> ''")
    refused = F.lit("there is no such peer")
    for name, target in targets.items():
        refused = F.when(F.col("connector") == name, F.when(F.col("action") != "delete", rejection(target, F.col("record"), F.col("remote_id") == ""))).otherwise(refused)
    asked = asked.withColumn("refused", refused)
    # read by each step; dead letters are the last one, after which none is left
    if not _done(spark, f"{state}/dlq/batch={batch}"):
        asked = written(asked)
    good = asked.where("refused is null")

    marks = good.select("key", F.lit(None).cast("string").alias("remote_id"), F.lit(False).alias("created"), F.lit(True).alias("in_flight"), now.alias("written_at"), (now + F.make_dt_interval(secs=F.lit(progress.IDEM_TTL))).alias("expires_at"), F.lit(0).alias("step"))
    append_once(marks, f"{state}/idem", f"{batch}-1")
    known = good.where("remote_id <> '' and action <> 'delete'")
    seconds = F.lit(progress.ECHO_WINDOW)
    windows = {name: t.window for name, t in targets.items()}
    origin = lambda rows, remote_id: rows.select(F.concat_ws("/", "connector", remote_id).alias("ref"), "hash", now.alias("written_at"), expiry(F.col("connector"), now, windows).alias("expires_at"))
    append_once(origin(known, F.col("remote_id")), f"{state}/origins", f"{batch}-1")
    said("intent")

    for name, target in targets.items():
        versions = log(spark, target.folder, PEER, leave_out=batch)
        append_once(upserted(versions, good.where(F.col("connector") == name), now), target.folder, batch)
        said(f"write {name}")

    given = F.when(F.col("remote_id") == "", new_id(F.col("key"))).otherwise(F.col("remote_id"))
    made = good.where("remote_id = ''")
    append_once(origin(made, given), f"{state}/origins", f"{batch}-2")
    results = good.select("key", given.alias("remote_id"), (F.col("remote_id") == "").alias("created"), F.lit(False).alias("in_flight"), now.alias("written_at"), (now + F.make_dt_interval(secs=F.lit(progress.IDEM_TTL))).alias("expires_at"), F.lit(1).alias("step"))
    append_once(results, f"{state}/idem", f"{batch}-2")
    dead = asked.where("refused is not null")
    ids = F.concat(F.lit("dlq-"), F.substring("key", 1, 32))
    append_once(dead.select(ids.alias("id"), "sync", F.col("source").alias("ref"), F.col("refused").alias("reason"), now.alias("created_at"), F.lit(1).alias("attempts"), F.col("record").alias("payload")), f"{state}/dlq", batch)
    said("commit")


def idem_table(rows: DataFrame) -> DataFrame:
    """The idem table of its log: the last word on each key."""
    values = [c for c in rows.columns if c not in ("key", "step")]
    return rows.groupBy("key").agg(F.max_by(F.struct(*values), F.struct("written_at", "step")).alias("r")).select("key", *[F.col(f"r.{c}").alias(c) for c in values])


def sink(stream: DataFrame, targets: dict[str, Target], state: str, checkpoint: str, now: Callable[[], Column] = F.current_timestamp):
    """A writer of a stream of writes: each micro-batch is one batch of `write` under its number.  `.start()` it."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda rows, number: write(rows, targets, state, f"{number:010d}", now()))
