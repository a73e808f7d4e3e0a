"""Peers as files, and faults to test against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DRIVERS: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, build: Callable[..., DataFrame]) -> None:
    if name in DRIVERS:
        raise ValueError(f"driver {name!r} is registered already")
    DRIVERS[name] = build


def build(name: str, spark: SparkSession, **options) -> DataFrame:
    if name not in DRIVERS:
        raise ValueError(f"unknown driver {name!r}; known: {', '.join(sorted(DRIVERS))}")
    return DRIVERS[name](spark, **options)


def drivers() -> list[str]:
    return sorted(DRIVERS)


def build_all(spark: SparkSession, peers: dict[str, tuple[str, dict]]) -> dict[str, DataFrame]:
    """The records of each named peer (driver, options); all that cannot be built is reported at once."""
    wrong = [f"{name}: unknown driver {driver!r}" for name, (driver, _) in peers.items() if driver not in DRIVERS]
    if wrong:
        raise ValueError("; ".join(wrong))
    return {name: build(driver, spark, **options) for name, (driver, options) in peers.items()}


def fixture(spark: SparkSession, file: str, kind: str) -> DataFrame:
    """(remote_id, record variant) of one kind in a JSON file {objects: {kind: {fields, records: [{id, fields}]}}}."""
    whole = spark.read.text(file, wholetext=True).select(F.parse_json("value").alias("v"))
    records = F.variant_get("v", f'$.objects["{kind}"].records', "array<variant>")
    return whole.select(F.explode(records).alias("r")).select(F.variant_get("r", "$.id", "string").alias("remote_id"), F.variant_get("r", "$.fields", "variant").alias("record"))


def fixture_schema(spark: SparkSession, file: str, kind: str) -> DataFrame:
    """(field, type, read_only) that a fixture declares for a kind."""
    whole = spark.read.text(file, wholetext=True).select(F.parse_json("value").alias("v"))
    fields = F.variant_get("v", f'$.objects["{kind}"].fields', "array<struct<name:string,type:string,read_only:boolean>>")
    return whole.select(F.explode(fields).alias("f")).select(F.col("f.name").alias("field"), "f.type", F.coalesce("f.read_only", F.lit(False)).alias("read_only"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(remote_id, updated_at, record variant) of a peer as JSON lines {id, updated_at, fields}, read in splits of any size."""
    rows = spark.read.text(path).select(F.try_parse_json("value").alias("v")).where("v is not null")
    return rows.select(F.variant_get("v", "$.id", "string").alias("remote_id"), F.try_variant_get("v", "$.updated_at", "timestamp").alias("updated_at"), F.variant_get("v", "$.fields", "variant").alias("record"))


def described(records: DataFrame) -> DataFrame:
    """(field, type, read_only) of a peer that declares no schema: the top-level fields that its records (record variant) hold."""
    fields = records.select(F.explode(F.map_entries(F.col("record").cast("map<string,variant>"))).alias("f"))
    return fields.groupBy(F.col("f.key").alias("field")).agg(F.max(F.schema_of_variant("f.value")).alias("type")).withColumn("read_only", F.lit(False))


register("fixture", fixture)
register("records", records)


def with_faults(events: DataFrame, id_col: str, seed: int = 0, duplicate_every: int = 0, bare_every: int = 0, delay_every: int = 0, delay_seconds: int = 60, granularity: int = 0, fail_every: int = 0, error_kind: str = "rate_limited", clock_offset: int = 0, shuffle: bool = False, rename: dict[str, str] | None = None) -> DataFrame:
    """events (at, record, ...) with repeats, notices without a record, late and coarse times, the same on every run.

    fail_every: events with `error_kind`, as a peer's answer to them; clock_offset:
    seconds that the peer's clock is ahead; shuffle: in an order of no meaning; rename:
    columns that the peer calls otherwise from now on.
    """
    draw = lambda every, salt: F.pmod(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(salt)), F.lit(every)) == 0
    if bare_every:
        events = events.withColumn("record", F.when(~draw(bare_every, 1), F.col("record")))
    if delay_every:
        events = events.withColumn("at", F.when(draw(delay_every, 2), F.col("at") + F.make_dt_interval(secs=F.lit(delay_seconds))).otherwise(F.col("at")))
    if granularity:
        events = events.withColumn("at", F.timestamp_seconds((F.unix_timestamp("at") / granularity).cast("long") * granularity))
    if duplicate_every:
        events = events.unionByName(events.where(draw(duplicate_every, 3)))
    if clock_offset:
        events = events.withColumn("at", F.col("at") + F.make_dt_interval(secs=F.lit(clock_offset)))
    if fail_every:
        events = events.withColumn("error_kind", F.when(draw(fail_every, 4), error_kind))
    if shuffle:
        events = events.orderBy(F.xxhash64(F.col(id_col), F.lit(seed), F.lit(5)))
    return events.withColumnsRenamed(rename or {})
