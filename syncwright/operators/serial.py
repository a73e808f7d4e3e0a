"""One logical record at a time: events that share an identity key are decided together, whatever the order in which they come.

The two peers have nothing in common but keys: a record that one of them was just sent
comes back with an id that no link knows yet.  Events of one logical record, joined by
any shared key, form a group, and a group is decided once: it makes one pair, one create
or one open question.  All of it is counts and least values, so neither a key that very
many records share nor a record with very many events gathers rows in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed


def touched(events: DataFrame, known: DataFrame) -> DataFrame:
    """(ref, key_name, key_value) of the records in events, and of known ones that share a key with them.

    events and known: (ref, key_name, key_value); a known record comes with all its keys,
    since by one of them it may meet another event.
    """
    own = events.select("ref", "key_name", "key_value").where("key_value is not null and key_value <> ''").distinct()
    met = known.join(own.select("key_name", "key_value").distinct(), ["key_name", "key_value"], "left_semi").select("ref")
    refs = met.union(events.select("ref")).distinct()
    return known.join(refs, "ref", "left_semi").select("ref", "key_name", "key_value").union(own).distinct()


def groups(keys: DataFrame, links: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(ref, group) of the refs in keys (ref, key_name, key_value) and links (a, b): the least ref that shared keys and links lead to.

    Each round a ref takes the least group of any key it holds, and then the group of that
    group, so chains shrink by halves.  Rounds are written to the shared folder.
    """
    edges = keys.select("ref", F.concat_ws("\x00", "key_name", "key_value").alias("key"))
    pair = F.concat_ws("\x01", "a", "b")
    edges = checkpointed(edges.union(links.select("a", pair)).union(links.select("b", pair)).distinct())
    every = edges.select("ref").distinct()
    # a key of one ref leads nowhere
    by_key = edges.groupBy("key").agg(F.min("ref").alias("least"), F.max("ref").alias("most")).where("least <> most")
    edges = checkpointed(edges.join(by_key.select("key"), "key"))
    found = edges.select("ref", F.col("ref").alias("group")).distinct()
    for _ in range(most_rounds):
        by_key = checkpointed(edges.join(found, "ref").groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most")))
        if by_key.where("least <> most").isEmpty():
            return every.join(found, "ref", "left").select("ref", F.coalesce("group", "ref").alias("group"))
        taken = edges.join(by_key, "key").groupBy("ref").agg(F.min("least").alias("group"))
        up = taken.select(F.col("ref").alias("_ref"), F.col("group").alias("_up"))
        found = checkpointed(taken.join(up, F.col("group") == F.col("_ref"), "left").select("ref", F.coalesce("_up", "group").alias("group")))
    raise RuntimeError(f"groups did not settle in {most_rounds} rounds")


def decided(events: DataFrame, keys: DataFrame, known_keys: DataFrame, links: DataFrame) -> DataFrame:
    """(group, action, left, right, source) of each logical record that events touch.

    events: (ref, side, at); keys: (ref, key_name, key_value) of their records;
    known_keys: (ref, side, key_name, key_value) of records seen before; links: (a, b) of
    left and right refs.  action: `linked` (a link stands), `pair` (one record on either
    side), `create` (one record, nobody answers; source: the ref of its first event) or
    `review`.  A group with a link and further records keeps the link; each further record
    is a review of its own, and so is each record of a group with several on a side.
    """
    events, keys = checkpointed(events), checkpointed(keys)  # read many times
    mine = keys.join(events.select("ref", "side").distinct(), "ref")
    near = touched(keys.select("ref", "key_name", "key_value").union(events.select("ref", F.lit("").alias("k"), F.lit("").alias("v"))), known_keys.select("ref", "key_name", "key_value"))
    sides = known_keys.select("ref", "side").union(mine.select("ref", "side")).union(events.select("ref", "side")).distinct()
    asked = near.select("ref").union(events.select("ref")).distinct()
    # both ends of a link that has one of these
    own = links.join(asked.withColumnRenamed("ref", "a"), "a", "left_semi").union(links.join(asked.withColumnRenamed("ref", "b"), "b", "left_semi").select("a", "b")).distinct()
    alone = events.select("ref", F.lit("ref").alias("key_name"), F.col("ref").alias("key_value"))
    grouped = groups(near.union(alone), own)
    linked = own.select(F.explode(F.array("a", "b")).alias("ref")).distinct().withColumn("in_link", F.lit(True))
    at = events.groupBy("ref").agg(F.min("at").alias("at"))
    sides = sides.union(own.select("a", F.lit("left"))).union(own.select("b", F.lit("right"))).distinct()
    rows = checkpointed(grouped.join(sides, "ref").join(linked, "ref", "left").join(at, "ref", "left").withColumn("in_link", F.coalesce("in_link", F.lit(False))))
    on = lambda side: F.when((F.col("side") == side) & ~F.col("in_link"), F.col("ref"))
    counted = rows.groupBy("group").agg(
        F.count(on("left")).alias("n_left"), F.count(on("right")).alias("n_right"), F.min(on("left")).alias("left"), F.min(on("right")).alias("right"),
        F.bool_or("in_link").alias("has_link"), F.count("at").alias("n_events"), F.min_by("ref", F.struct("at", "ref")).alias("source"),
    )
    one = (F.col("n_left") <= 1) & (F.col("n_right") <= 1) & ~F.col("has_link")
    action = F.when(one & (F.col("n_left") + F.col("n_right") == 2), "pair").when(one, "create")
    settled = counted.where(one & (F.col("n_events") > 0)).select("group", action.alias("action"), "left", "right", F.when(F.col("n_left") + F.col("n_right") == 1, F.coalesce("left", "right")).alias("source"))
    # the rest by record: those in a link stand, the others wait
    rest = rows.where("at is not null").join(counted.where(~one).select("group"), "group")
    waiting = rest.where("not in_link").select("group", F.lit("review").alias("action"), F.when(F.col("side") == "left", F.col("ref")).alias("left"), F.when(F.col("side") == "right", F.col("ref")).alias("right"), F.col("ref").alias("source"))
    hit = rest.where("in_link").select("ref", "group").distinct()
    stands = own.join(hit.withColumnRenamed("ref", "a"), "a").select("group", "a", "b").union(own.join(hit.withColumnRenamed("ref", "b"), "b").select("group", "a", "b")).distinct()
    stands = stands.select("group", F.lit("linked").alias("action"), F.col("a").alias("left"), F.col("b").alias("right"), F.lit(None).cast("string").alias("source"))
    return settled.unionByName(waiting).unionByName(stands)
