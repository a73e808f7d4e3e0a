"""Consecutive numbers in an order, without a task that reads all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def numbered(rows: DataFrame, order: list, name: str = "n") -> DataFrame:
    """rows with `name`: 1, 2, 3 ... in `order`, which has to be total (equal rows may take each other's numbers).

    Rows are dealt by range and sorted within their tasks, and written once.  Only how many
    rows each task has goes through one task, to become where its numbers start.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the id is the number of the task, then that of the row in it
    placed = checkpointed(dealt.withColumn("_id", F.monotonically_increasing_id()))
    task = F.shiftright("_id", 33)
    sizes = placed.groupBy(task.alias("_task")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_task", before.alias("_start")))
    number = F.col("_start") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1
    return placed.join(starts, task == F.col("_task")).withColumn(name, number).drop("_id", "_task", "_start")
