"""Who is who: stored links first, then equal keys; never a guess."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POLICIES = ("review", "create", "skip")


def keys_of(records: DataFrame, id_col: str, keys: list[str] | dict[str, str]) -> DataFrame:
    """(id, key_name, key_value) of the non-empty keys of each record; keys: column names, or key names with their columns."""
    columns = keys if isinstance(keys, dict) else {k: k for k in keys}
    pairs = F.array(*[F.struct(F.lit(k).alias("key_name"), F.col(c).cast("string").alias("key_value")) for k, c in columns.items()])
    return records.select(F.col(id_col).alias("id"), F.explode(pairs).alias("k")).select("id", "k.key_name", "k.key_value").where("key_value is not null and key_value <> ''")


def linked_peer(records: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """records with `linked`: the other end of a link (a, b) that holds their id at either end."""
    ends = links.select(F.col("a").alias("_end"), F.col("b").alias("linked")).union(links.select("b", "a")).groupBy("_end").agg(F.min("linked").alias("linked"))
    return records.join(ends, F.col(id_col) == F.col("_end"), "left").drop("_end")


def candidates(near: DataFrame, far: DataFrame, near_id: str, far_id: str, keys: list[str] | dict[str, str]) -> DataFrame:
    """(id, candidates, matched_on) by any equal key: distinct far ids in order, and the names of keys that met.

    For listings of a few records, as a reviewer sees them: a key that very many far records
    share makes long rows.  Decisions rest on `counted`, which makes none.
    """
    mine, theirs = keys_of(near, near_id, keys), keys_of(far, far_id, keys).withColumnRenamed("id", "far")
    # the far ids of a key are gathered first: one row for each key goes on to the join
    met = mine.join(theirs.groupBy("key_name", "key_value").agg(F.collect_set("far").alias("far")), ["key_name", "key_value"])
    return met.groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("far")))).alias("candidates"), F.array_join(F.array_sort(F.collect_set("key_name")), ", ").alias("matched_on"))


def counted(near: DataFrame, far: DataFrame, near_id: str, far_id: str, keys: list[str] | dict[str, str]) -> DataFrame:
    """(id, n, one, matched_on) of near records that any equal key joins to far ones: how many different ones, and which if it is one.

    Far records (one row for each id) are counted by the values of every set of keys, so
    a value that any number of records share is one short row on either side of the join.
    Records that meet by several keys are counted once: n is the sum over the sets of keys,
    with the sign of their size (2 keys make 3 sets, 3 make 7).
    """
    columns = keys if isinstance(keys, dict) else {k: k for k in keys}
    names = list(columns)

    def by_sets(records: DataFrame, id_col: str) -> DataFrame:
        value = {k: F.col(c).cast("string") for k, c in columns.items()}
        there = {k: F.coalesce(value[k] != "", F.lit(False)) for k in names}
        sets = []
        for mask in range(1, 1 << len(names)):
            own = [k for j, k in enumerate(names) if mask >> j & 1]
            whole = there[own[0]]
            for k in own[1:]:
                whole = whole & there[k]
            sets.append(F.when(whole, F.struct(F.lit(mask).alias("mask"), F.array(*[value[k] for k in own]).alias("values"))))
        return records.select(F.col(id_col).alias("id"), F.explode(F.array_compact(F.array(*sets))).alias("k")).select("id", "k.mask", "k.values")

    theirs = by_sets(far, far_id).groupBy("mask", "values").agg(F.count("*").alias("_n"), F.min("id").alias("_one"))
    met = by_sets(near, near_id).join(theirs, ["mask", "values"])
    sign = F.when(F.bit_count("mask") % 2 == 1, F.col("_n")).otherwise(-F.col("_n"))
    named = F.element_at(F.array(*[F.lit(k) for k in names]), (F.log2("mask") + 1).cast("int"))
    met = met.withColumn("_name", F.when(F.bit_count("mask") == 1, named))
    found = met.groupBy("id").agg(F.sum(sign).alias("n"), F.min("_one").alias("_one"), F.array_join(F.array_sort(F.collect_set("_name")), ", ").alias("matched_on"))
    return found.select("id", "n", F.when(F.col("n") == 1, F.col("_one")).alias("one"), "matched_on")


def outcome(linked: Column, n: Column, one: Column, matched_on: Column, peer: str, on_ambiguous: str = "review") -> tuple[Column, Column, Column]:
    """(outcome, peer id, reason) of a record with n candidates; one: the only one."""
    if on_ambiguous not in POLICIES:
        raise ValueError(f"unknown policy {on_ambiguous!r} for ambiguous matches")
    n = F.coalesce(n, F.lit(0))
    nobody, several = ("skip" if on_ambiguous == "skip" else "create"), on_ambiguous
    what = F.when(linked.isNotNull(), "linked").when(n == 1, "matched").when(n == 0, nobody).otherwise(several)
    who = F.coalesce(linked, F.when(n == 1, one))
    why = F.when(linked.isNotNull(), "linked").when(n == 1, F.concat(F.lit("matched on "), matched_on)).when(n == 0, "no match")
    return what, who, why.otherwise(F.concat(n.cast("string"), F.lit(f" records on {peer} match on "), matched_on))


def resolve(near: DataFrame, far: DataFrame, links: DataFrame, near_id: str, far_id: str, keys: list[str] | dict[str, str], peer: str, on_ambiguous: str = "review") -> DataFrame:
    """near with outcome, peer_id and reason.  Only records without a link look for keys."""
    known = linked_peer(near, links, near_id)
    found = counted(known.where("linked is null"), far, near_id, far_id, keys).withColumnRenamed("id", "_found_id")
    joined = known.join(found, F.col(near_id) == F.col("_found_id"), "left")
    what, who, why = outcome(F.col("linked"), F.col("n"), F.col("one"), F.col("matched_on"), peer, on_ambiguous)
    return joined.select(*near.columns, what.alias("outcome"), who.alias("peer_id"), why.alias("reason"))


def partners(from_left: DataFrame, from_right: DataFrame) -> DataFrame:
    """(l_id, r_id, outcome, why, by_left, by_right) in which no record has two partners.

    from_left, from_right: (id, outcome, peer_id, reason) of each side's records.  A link
    stands.  A match stands if both ends chose it: each is then the other's only candidate.
    One that a single end chose is contested (the other end is linked or has more
    candidates), and taking it would be a guess: the record that chose it waits for review.
    """
    ends = lambda rows, own, far: rows.select(F.col("id").alias(own), F.col("peer_id").alias(far), "outcome", "reason")
    chosen = ends(from_left, "l_id", "r_id").withColumns({"by_left": F.lit(True), "by_right": F.lit(False)})
    chosen = chosen.unionByName(ends(from_right, "r_id", "l_id").withColumns({"by_left": F.lit(False), "by_right": F.lit(True)}))
    rows = chosen.groupBy("l_id", "r_id").agg(F.min("outcome").alias("outcome"), F.min("reason").alias("why"), F.bool_or("by_left").alias("by_left"), F.bool_or("by_right").alias("by_right"))
    contested = (F.col("outcome") == "matched") & ~(F.col("by_left") & F.col("by_right"))
    why = F.when(contested, F.concat("why", F.lit(", but the record there has another match"))).otherwise(F.col("why"))
    return rows.select(
        F.when(~contested | F.col("by_left"), F.col("l_id")).alias("l_id"),
        F.when(~contested | F.col("by_right"), F.col("r_id")).alias("r_id"),
        F.when(contested, "review").otherwise(F.col("outcome")).alias("outcome"),
        why.alias("why"),
        "by_left",
        "by_right",
    )
