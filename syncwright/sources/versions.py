"""State tables in versions: a base, and the changes of each cycle since.

A version is there once its mark is written, after all its tables; until then readers see the
one before, and what a failed try left behind is never read.  A version holds the rows
that it puts and the keys that it removes, so its size is that of the changes.  `compacted`
writes a new base from time to time.  One writer at a time: a version that is there already
is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.state import KEYS, TABLES, latest, swept
from ..session import empty
from .peers import append_once, log

_MARK = "version long, path string, tables array<string>"


def _marks(spark: SparkSession, folder: str, kind: str) -> dict[int, tuple[str, list[str]]]:
    """version: (folder, tables) of what is marked; one row each, until `trimmed` takes the old ones."""
    return {r["version"]: (r["path"], r["tables"]) for r in log(spark, f"{folder}/{kind}-marks", _MARK).collect()}


def _mark(spark: SparkSession, folder: str, kind: str, version: int, path: str, tables: list[str]) -> None:
    append_once(spark.createDataFrame([(version, path, tables)], _MARK).coalesce(1), f"{folder}/{kind}-marks", f"{version:010d}")


def last(spark: SparkSession, folder: str) -> int:
    """The last version; 0 before the first."""
    return max([0, *_marks(spark, folder, "change"), *_marks(spark, folder, "base")])


def read(spark: SparkSession, folder: str, version: int | None = None) -> dict[str, DataFrame]:
    """All state tables as of a version, the last one if none is named; expired rows too, until a base drops them.

    The base is not shuffled for a few changes: it only loses the keys that they name.  A
    table that one version alone has put is read as it stands, since a version has a key once.
    """
    changes, bases = _marks(spark, folder, "change"), _marks(spark, folder, "base")
    top = max([0, *changes, *bases])
    wanted = top if version is None else version
    base = max([b for b in bases if b <= wanted], default=0)
    needed = range(base + 1, wanted + 1)
    if wanted > top or any(v not in changes for v in needed):
        raise ValueError(f"version {wanted} of {folder} is not there")
    out = {}
    for name, schema in TABLES.items():
        below = spark.read.schema(schema).parquet(f"{folder}/{bases[base][0]}/{name}") if base else empty(spark, schema)
        paths = [f"{folder}/{changes[v][0]}/{name}" for v in needed if name in changes[v][1]]
        if paths:
            rows = spark.read.schema(f"{schema}, gone boolean, version long").parquet(*paths)
            rows = latest(rows, KEYS[name], "version") if len(paths) > 1 else rows
            below = below.join(rows.select(*KEYS[name]), KEYS[name], "left_anti").unionByName(rows.where("not gone").select(*below.columns))
        out[name] = below
    return out


def commit(spark: SparkSession, folder: str, version: int, changes: dict[str, tuple[DataFrame | None, DataFrame | None]], after: Callable[[str], None] | None = None) -> None:
    """changes as the next version: for each table the rows that it puts, one a key, and the keys that it removes; a key in both is removed.

    after: called with the name of each table that is written (for tests that stop there).
    """
    if version != last(spark, folder) + 1:
        raise ValueError(f"version {version} of {folder} does not follow {last(spark, folder)}")
    path = f"change-{version:010d}-{uuid.uuid4().hex}"
    for name, (put, gone) in changes.items():
        keys, parts = KEYS[name], []
        none = empty(spark, TABLES[name])
        put = (none if put is None else put).select(*none.columns)
        if gone is not None:
            gone = gone.select(*keys).distinct()
            put = put.join(gone, keys, "left_anti")
            parts = [gone.select(*[F.col(c) if c in keys else F.lit(None).cast(none.schema[c].dataType).alias(c) for c in none.columns], F.lit(True).alias("gone"))]
        rows = put.withColumn("gone", F.lit(False))
        for more in parts:
            rows = rows.unionByName(more)
        rows.withColumn("version", F.lit(version).cast("long")).write.parquet(f"{folder}/{path}/{name}")
        if after:
            after(name)
    _mark(spark, folder, "change", version, path, list(changes))


def compacted(spark: SparkSession, folder: str, now: Column) -> None:
    """The last version as a base, without expired rows.  Readers of that version and later ones start there."""
    version = last(spark, folder)
    if version and version not in _marks(spark, folder, "base"):
        path = f"base-{version:010d}-{uuid.uuid4().hex}"
        for name, rows in read(spark, folder, version).items():
            (swept(rows, now) if "expires_at" in rows.columns else rows).write.parquet(f"{folder}/{path}/{name}")
        _mark(spark, folder, "base", version, path, list(TABLES))


def trimmed(spark: SparkSession, folder: str, oldest: int) -> None:
    """Deletes what no version from `oldest` on needs; earlier ones can no longer be read."""
    changes, bases = _marks(spark, folder, "change"), _marks(spark, folder, "base")
    base = max([b for b in bases if b <= oldest], default=0)
    old = [("change", v, changes[v][0]) for v in changes if v <= base] + [("base", b, bases[b][0]) for b in bases if b < base]
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for kind, v, rows in old:
        # the mark first: what has none is not read
        store.delete(path(f"{folder}/{kind}-marks/batch={v:010d}"), True)
        store.delete(path(f"{folder}/{rows}"), True)
