"""Plans and diagnoses as lines and JSON for readers: DataFrames in reading order, written out like any other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import quoted, untag

# The actions of a plan in the order in which they are counted.
ACTIONS = ("create", "update", "delete")


def by_sync(changes: DataFrame) -> DataFrame:
    """(sync, action, n) of planned changes."""
    return changes.groupBy("sync", "action").agg(F.count("*").alias("n"))


def counted(changes: DataFrame, reviews: DataFrame, dead: DataFrame) -> str:
    """The plan in one sentence."""
    counts = {r["action"]: r["n"] for r in changes.groupBy("action").agg(F.count("*").alias("n")).collect()}  # one row an action
    parts = [f"{counts[a]} to {a}" for a in ACTIONS if counts.get(a)]
    for rows, what in ((reviews, "waiting for a decision"), (dead, "that would fail")):
        if n := rows.count():
            parts.append(f"{n} {what}")
    return (", ".join(parts) or "Nothing to do") + "."


def _lines(fields: Column) -> Column:
    shown = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(F.lit("    "), e["key"], F.lit(" = "), quoted(e["value"])))
    return F.coalesce(shown, F.array().cast("array<string>"))


def plan_lines(changes: DataFrame, reviews: DataFrame, dead: DataFrame, errors: list[str] = ()) -> DataFrame:
    """(line) of a dry run, in order.

    changes: (sync, action, target, source, fields); reviews, dead: (ref, reason).
    errors: of peers that could not be read; a plan that met any says so.
    """
    spark = changes.sparkSession
    sentence = counted(changes, reviews, dead)
    n_reviews, n_dead = reviews.count(), dead.count()
    empty = sentence == "Nothing to do."
    head = F.when(F.col("action") == "create", F.concat(F.lit("  create on "), "target")).otherwise(F.concat(F.lit("  "), "action", F.lit(" "), "target"))
    under = F.when(F.col("action") == "delete", F.concat(F.lit("    because "), "source", F.lit(" was deleted"))).otherwise(F.concat(F.lit("    from "), "source"))
    body = F.concat(F.array(head, under), F.when(F.col("action") == "delete", F.array().cast("array<string>")).otherwise(_lines(F.col("fields"))))
    at = lambda part, *rest: [F.lit(part).alias("part"), *rest]
    text, number = (lambda x: F.coalesce(x, F.lit("")).cast("string")), F.lit(0).cast("long")
    rows = [
        changes.select("sync").distinct().select(*at(1, F.col("sync"), F.lit("").alias("rank"), F.array("sync").alias("lines"))),
        changes.select(*at(1, F.col("sync"), F.concat(F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).cast("string"), text(F.col("source")), F.lit("\x00"), text(F.col("target"))).alias("rank"), body.alias("lines"))),
        changes.select("sync").distinct().select(*at(1, F.col("sync"), F.lit("9").alias("rank"), F.array(F.lit("")).alias("lines"))),
    ]
    for part, items, what, n in ((2, reviews, "Waiting for a decision", n_reviews), (3, dead, "Would fail", n_dead)):
        if n:
            rows.append(spark.range(1).select(*at(part, F.lit("").alias("sync"), F.lit("").alias("rank"), F.array(F.lit(f"{what} ({n})")).alias("lines"))))
            rows.append(items.select(*at(part, F.lit("").alias("sync"), F.concat(F.lit("1"), "ref").alias("rank"), F.array(F.concat(F.lit("  "), "ref"), F.concat(F.lit("    "), "reason")).alias("lines"))))
            rows.append(spark.range(1).select(*at(part, F.lit("").alias("sync"), F.lit("\uffff").alias("rank"), F.array(F.lit("")).alias("lines"))))
    last = ["Nothing to report from the peers that answered." if errors else "Nothing to do: both sides already agree."] if empty else [sentence]
    if errors:
        last += ["", f"The plan is incomplete. {len(errors)} peer error(s):", *(f"  {line}" for e in errors for line in e.split("\n"))]
    rows.append(spark.range(1).select(*at(4, F.lit("").alias("sync"), F.lit("").alias("rank"), F.array(*map(F.lit, last)).alias("lines"))))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.select("part", "sync", "rank", F.posexplode("lines").alias("k", "line")).orderBy("part", "sync", "rank", "k").select("line")


def _json_ref(r: Column) -> Column:
    """connector:kind/remote_id, or a connector alone, as an object."""
    return F.struct(F.regexp_extract(r, "^([^:]*)", 1).alias("connector"), F.regexp_extract(r, "^[^:]*:([^/]*)/", 1).alias("kind"), F.regexp_extract(r, "^[^:]*:[^/]*/(.*)$", 1).alias("remote_id"))


def plan_json(changes: DataFrame) -> DataFrame:
    """(sync, change): each change as one JSON object."""
    fields = F.transform(F.array_sort(F.map_entries("fields")), lambda e: F.struct(e["key"].alias("field"), untag(e["value"]).alias("value")))
    return changes.select("sync", F.to_json(F.struct("sync", "action", _json_ref(F.col("source")).alias("source"), _json_ref(F.col("target")).alias("target"), fields.alias("fields"))).alias("change"))


def doctor_lines(checks: DataFrame) -> DataFrame:
    """(line) of checks (k, name, subject, ok, detail), in the order of k, then the sum."""
    spark = checks.sparkSession
    n, failed, width = checks.agg(F.count("*"), F.count(F.when(~F.col("ok"), 1)), F.coalesce(F.max(F.length("name") + F.length("subject") + 1), F.lit(0))).first()
    if n == 0:
        return spark.range(1).select(F.lit("Nothing to check: no syncs are configured.").alias("line"))
    label = F.rpad(F.trim(F.concat_ws(" ", "name", "subject")), width, " ")
    lines = checks.select("k", F.concat(F.when(F.col("ok"), "ok  ").otherwise("FAIL"), F.lit("  "), label, F.lit("  "), "detail").alias("line"))
    end = [("",), (f"{failed} of {n} checks failed." if failed else f"All {n} checks passed.",)]
    tail = spark.createDataFrame([(1 << 60, *end[0]), ((1 << 60) + 1, *end[1])], "k long, line string")
    return lines.unionByName(tail).orderBy("k").select("line")
