"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def components(edges: DataFrame, store: Store, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the bigint edges (a, b); root is the smallest node reachable.

    Each step is a grouped minimum (partial aggregates collapse a hub before the
    shuffle) and a join that adaptive execution may split, so a component of any
    size never meets in one task.  Steps are written to the shared folder.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars = store.save(stars, f"{name}-0")
    last = None
    for k in range(1, max_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = store.save(small.union(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), f"{name}-{k}")
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if k > 1:
            store.drop(f"{name}-{k - 2}")
        if now == last:
            return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                stars.select(F.col("v"), F.col("v")).distinct()
            )
        last = now
    raise RuntimeError(f"{name}: components did not settle in {max_rounds} rounds")
