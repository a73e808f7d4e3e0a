"""What to do about two linked records: a three-way comparison under a policy, in one row, without a shuffle.

Sides are structs of canonical maps: fields, base (the last agreed state), hash,
synced_hash (empty or null without a base) and updated_at.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.digest import duration

POLICIES = ("left_wins", "right_wins", "newest_wins", "field_level", "review")
SKEW_SECONDS = 2


def changed(side: Column) -> Column:
    return F.coalesce(side["hash"], F.lit("")) != F.coalesce(side["synced_hash"], F.lit(""))


def has_base(side: Column) -> Column:
    return F.coalesce(side["synced_hash"], F.lit("")) != ""


def situation(left: Column, right: Column) -> Column:
    a, b = changed(left), changed(right)
    return F.when(a & b, "both_changed").when(a, "left_changed").when(b, "right_changed").otherwise("unchanged")


def differences(left: Column, right: Column, names: list[str]) -> Column:
    """Structs (field, left, right, left_changed, right_changed) of the fields that differ, in order; absent is null."""
    rows = [
        F.struct(
            F.lit(n).alias("field"),
            left["fields"][n].alias("left"),
            right["fields"][n].alias("right"),
            (~left["fields"][n].eqNullSafe(left["base"][n])).alias("left_changed"),
            (~right["fields"][n].eqNullSafe(right["base"][n])).alias("right_changed"),
        )
        for n in sorted(names)
    ]
    return F.filter(F.array(*rows), lambda d: ~d["left"].eqNullSafe(d["right"]))


def _picked(fields: Column, names: list[str]) -> Column:
    return F.map_filter(fields, lambda k, _: k.isin(*names))


def resolve(left: Column, right: Column, names: list[str], policy: str = "review", per_field: dict[str, str] | None = None, skew: int = SKEW_SECONDS) -> Column:
    """A struct (situation, action, reason, left_values, right_values); values: what to write to each side."""
    policy, per_field = policy or "review", per_field or {}
    for p in (policy, *per_field.values()):
        if p not in POLICIES:
            raise ValueError(f"unknown conflict policy {p!r}")
    empty = F.create_map().cast("map<string,string>")
    state, found = situation(left, right), differences(left, right, names)
    gap = F.abs(F.unix_micros(left["updated_at"]) - F.unix_micros(right["updated_at"])) / F.lit(1_000_000)
    close, left_later = gap <= skew, left["updated_at"] > right["updated_at"]
    mine, theirs = _picked(left["fields"], names), _picked(right["fields"], names)

    def result(action, reason, to_left=empty, to_right=empty) -> Column:
        text = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(state.alias("situation"), text(action).alias("action"), text(reason).alias("reason"), to_left.alias("left_values"), to_right.alias("right_values"))

    if per_field:
        both = _by_field(found, left, right, policy, per_field, close, left_later, result)
    elif policy == "field_level":
        both = _merged(found, left, right, result)
    elif policy == "left_wins":
        both = result("write_right", "both sides changed; the left side is the source of truth", to_right=mine)
    elif policy == "right_wins":
        both = result("write_left", "both sides changed; the right side is the source of truth", to_left=theirs)
    elif policy == "newest_wins":
        apart = F.concat(F.lit("both sides changed "), duration(gap), F.lit(" apart, inside the "), duration(F.lit(skew)), F.lit(" clock tolerance, so which is newer is not knowable"))
        both = (
            F.when(close, result("escalate", apart))
            .when(left_later, result("write_right", F.concat(F.lit("the left side changed "), duration(gap), F.lit(" later")), to_right=mine))
            .otherwise(result("write_left", F.concat(F.lit("the right side changed "), duration(gap), F.lit(" later")), to_left=theirs))
        )
    else:
        both = result("escalate", "both sides changed and the policy is to ask")
    return (
        F.when(F.size(found) == 0, result("nothing", "the two sides already agree on every mapped field"))
        .when(state == "unchanged", result("nothing", "neither side changed since the last sync"))
        .when(state == "left_changed", result("write_right", "only the left side changed", to_right=mine))
        .when(state == "right_changed", result("write_left", "only the right side changed", to_left=theirs))
        .otherwise(both)
    )


def _settled(judged: Column, blocked: Column, stop: Column, both: str, one: tuple[str, str], result) -> Column:
    """The end of a field-by-field policy: winners on both sides, on one, or on none."""
    # the winner of a field is the side whose value stays, so its value goes to the other side
    to_right = F.map_from_entries(F.transform(F.filter(judged, lambda d: d["winner"] == "left"), lambda d: F.struct(d["field"], d["left"])))
    to_left = F.map_from_entries(F.transform(F.filter(judged, lambda d: d["winner"] == "right"), lambda d: F.struct(d["field"], d["right"])))
    return (
        F.when(F.size(blocked) > 0, result("escalate", stop))
        .when((F.size(to_left) > 0) & (F.size(to_right) > 0), result("write_both", both, to_left, to_right))
        .when(F.size(to_right) > 0, result("write_right", one[0], to_right=to_right))
        .when(F.size(to_left) > 0, result("write_left", one[1], to_left=to_left))
        .otherwise(result("nothing", "the digests differ but no mapped field does"))
    )


def _judged(found: Column, winner) -> tuple[Column, Column, Column]:
    judged = F.transform(found, lambda d: F.struct(d["field"].alias("field"), d["left"].alias("left"), d["right"].alias("right"), winner(d).alias("winner")))
    blocked = F.filter(judged, lambda d: d["winner"] == "blocked")
    return judged, blocked, F.array_join(F.transform(blocked, lambda d: d["field"]), ", ")


def _edited(d: Column) -> Column:
    return F.when(d["left_changed"] & d["right_changed"], "blocked").when(d["left_changed"], "left").when(d["right_changed"], "right").otherwise("none")


def _merged(found: Column, left: Column, right: Column, result) -> Column:
    judged, blocked, names = _judged(found, _edited)
    done = _settled(judged, blocked, F.concat(F.lit("both sides edited "), names), "both sides changed, in fields that do not overlap", ("both sides changed, but only left-side edits need applying", "both sides changed, but only right-side edits need applying"), result)
    return F.when(~has_base(left) | ~has_base(right), result("escalate", "both sides changed and there is no recorded base to merge against")).otherwise(done)


def _by_field(found: Column, left: Column, right: Column, policy: str, per_field: dict[str, str], close: Column, left_later: Column, result) -> Column:
    def winner(d: Column) -> Column:
        own = F.lit(policy)
        for name, p in per_field.items():
            own = F.when(d["field"] == name, p).otherwise(own)
        return (
            F.when(own == "left_wins", "left")
            .when(own == "right_wins", "right")
            .when(own == "newest_wins", F.when(close, "blocked").when(left_later, "left").otherwise("right"))
            .when((own == "field_level") & has_base(left) & has_base(right), _edited(d))
            .otherwise("blocked")
        )

    judged, blocked, names = _judged(found, winner)
    stop = F.concat(F.lit("both sides changed and "), names, F.lit(" has no automatic winner"))
    return _settled(judged, blocked, stop, "both sides changed and per-field policies name both winners", ("both sides changed; per-field policy keeps the left values", "both sides changed; per-field policy keeps the right values"), result)
