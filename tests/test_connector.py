"""A peer read as a batch and as a stream: filters reach the row groups, restarts lose and repeat nothing."""

from __future__ import annotations

import time
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from syncwright.sources import connector

T0 = datetime(2026, 1, 1)


def put(folder, name, rows, group=1000):
    """Rows (id, second) as a file."""
    folder.mkdir(parents=True, exist_ok=True)
    table = pa.table({"id": pa.array([i for i, _ in rows], pa.int64()), "at": pa.array([None if s is None else T0 + timedelta(seconds=s) for _, s in rows], pa.timestamp("us")), "name": [f"n{i}" for i, _ in rows]})
    pq.write_table(table, folder / f"{name}.parquet", row_group_size=group)


def options(folder, **more):
    return {"path": str(folder), "id": "id", "updated_at": "at"} | more


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    connector.register(spark)


def test_a_filter_on_the_time_of_change_skips_row_groups(spark, tmp_path):
    put(tmp_path / "peer", "a", [(i, i) for i in range(1000)], group=100)
    put(tmp_path / "peer", "b", [(i, i) for i in range(1000, 1200)] + [(5000, None)], group=100)
    df = spark.read.format("peer").options(**options(tmp_path / "peer")).load()
    assert df.schema.simpleString() == "struct<id:bigint,at:timestamp_ntz,name:string>" and df.count() == 1201
    late = df.where(F.col("at") >= F.lit(T0 + timedelta(seconds=950)).cast("timestamp_ntz"))
    assert sorted(r["id"] for r in late.select("id").collect()) == list(range(950, 1200))
    reader = connector.ChangeReader(connector.Peer(options(tmp_path / "peer", split_bytes="1")), ["id"])
    assert list(reader.pushFilters([connector.GreaterThanOrEqual(("at",), T0 + timedelta(seconds=950)), connector.EqualTo(("id",), 7)])) == [connector.EqualTo(("id",), 7)]
    assert [s.numbers for s in reader.partitions()] == [(9,), (0,), (1,)]
    plan = late._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull" not in plan and "GreaterThanOrEqual" in plan
    few = spark.read.format("peer").options(**options(tmp_path / "peer", columns="name")).load()
    assert few.columns == ["name"] and few.count() == 1201


def test_options_are_checked(spark, tmp_path):
    with pytest.raises(Exception, match="needs the options id, updated_at"):
        spark.read.format("peer").options(path=str(tmp_path)).load()
    with pytest.raises(Exception, match="no completed Parquet file"):
        spark.read.format("peer").options(**options(tmp_path)).load()
    put(tmp_path / "p", "a", [(1, 1)])
    with pytest.raises(Exception, match="has no column shoe"):
        spark.read.format("peer").options(**options(tmp_path / "p", columns="id,shoe")).load()


def test_unfinished_batches_are_not_read(spark, tmp_path):
    put(tmp_path / "peer/batch=1", "a", [(1, 1)])
    (tmp_path / "peer/batch=1/_SUCCESS").touch()
    put(tmp_path / "peer/batch=2", "a", [(2, 2)])
    assert [r["id"] for r in spark.read.format("peer").options(**options(tmp_path / "peer")).load().collect()] == [1]


def run(spark, peer, out, until, **more):
    stream = spark.readStream.format("peer").options(**options(peer, **more)).load()
    writer = stream.writeStream.format("parquet").option("path", str(out / "rows")).option("checkpointLocation", str(out / "checkpoint"))
    if not more:
        q = writer.trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return [p["numInputRows"] for p in q.recentProgress]
    q = writer.trigger(processingTime="0 seconds").start()
    began = time.monotonic()
    while time.monotonic() - began < 60 and q.exception() is None and sum(p["numInputRows"] for p in q.recentProgress) < until:
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None
    return [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]


def ids(spark, out):
    return sorted(r["id"] for r in spark.read.parquet(str(out / "rows")).collect())


@pytest.mark.parametrize("bound", [0, 7])
def test_a_stream_takes_each_change_once_over_restarts(spark, tmp_path, bound):
    peer, out = tmp_path / "peer", tmp_path / "out"
    more = {"max_rows": str(bound), "progress": str(tmp_path / "progress")} if bound else {}
    put(peer, "a", [(i, i // 3) for i in range(30)] + [(900, None)], group=8)
    taken = run(spark, peer, out, 30, **more)
    assert sum(taken) == 30 and (not bound or (max(taken) <= bound and len(taken) > 4))
    assert run(spark, peer, out, 0, **more) in ([], [0])
    # more at the last time, and later ones, in files of their own; ids go on
    put(peer, "b", [(i, 9 + i // 40) for i in range(30, 50)], group=8)
    taken = run(spark, peer, out, 20, **more)
    assert sum(taken) == 20 and ids(spark, out) == list(range(50))


def test_one_time_with_more_rows_than_the_bound_is_not_cut(spark, tmp_path):
    put(tmp_path / "peer", "a", [(i, 0) for i in range(20)] + [(i, i) for i in range(20, 30)], group=5)
    taken = run(spark, tmp_path / "peer", tmp_path / "out", 30, max_rows="4", progress=str(tmp_path / "progress"))
    assert taken == [20, 4, 4, 2] and ids(spark, tmp_path / "out") == list(range(30))
