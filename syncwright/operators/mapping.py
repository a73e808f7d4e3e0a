"""Mappings between the fields of two peers and canonical names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.digest import tag_variant, untag
from ..functions.transforms import TRANSFORMS, apply_tagged

# The directions, each as the sides that it writes.
DIRECTIONS = {"bidirectional": frozenset({"left", "right"}), "left_to_right": frozenset({"right"}), "right_to_left": frozenset({"left"})}
SIDES = ("left", "right")


def narrow(sync: str, own: str = "") -> str | None:
    """The direction that both allow; None if there is none.  An empty field direction is the sync's."""
    both = DIRECTIONS[sync] & DIRECTIONS[own or sync]
    return next((name for name, sides in DIRECTIONS.items() if sides == both), None)


@dataclass(frozen=True)
class FieldMap:
    canonical: str
    left: str
    right: str
    direction: str = ""
    transform: str = ""

    def path(self, side: str) -> str:
        return self.left if side == "left" else self.right


@dataclass(frozen=True)
class Mapping:
    """Checked on construction; all that is wrong is reported at once."""

    kind: str
    fields: tuple[FieldMap, ...]
    direction: str = "bidirectional"
    _narrowed: dict = field(default_factory=dict, compare=False, repr=False)

    def __post_init__(self) -> None:
        wrong, seen = [], set()
        if self.direction not in DIRECTIONS:
            raise ValueError(f"mapping {self.kind}: unknown direction {self.direction!r}")
        if not self.fields:
            wrong.append("no fields")
        for f in self.fields:
            if not f.canonical:
                wrong.append("a field without a canonical name")
            if f.canonical in seen:
                wrong.append(f"{f.canonical}: mapped twice")
            seen.add(f.canonical)
            wrong += [f"{f.canonical}: no {side} path" for side in SIDES if not f.path(side)]
            if f.transform not in TRANSFORMS:
                wrong.append(f"{f.canonical}: unknown transform {f.transform!r}")
            if f.direction and f.direction not in DIRECTIONS:
                wrong.append(f"{f.canonical}: unknown direction {f.direction!r}")
            elif (found := narrow(self.direction, f.direction)) is None:
                wrong.append(f"{f.canonical}: {f.direction} within {self.direction} leaves no direction")
            else:
                self._narrowed[f.canonical] = found
        if wrong:
            raise ValueError(f"mapping {self.kind}: " + "; ".join(wrong))

    def names(self) -> list[str]:
        return sorted(f.canonical for f in self.fields)

    def writable(self, side: str) -> list[str]:
        return sorted(n for n, d in self._narrowed.items() if side in DIRECTIONS[d])

    def to_canonical(self, record: Column, side: str) -> Column:
        """The canonical map of a variant record; absent fields are left out."""
        entries = [F.struct(F.lit(f.canonical).alias("key"), apply_tagged(f.transform, tag_variant(get_path(record, f.path(side)))).alias("value")) for f in sorted(self.fields, key=lambda f: f.canonical)]
        return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))

    def from_canonical(self, canonical: Column, side: str) -> Column:
        """JSON of the fields that may be written to a side and that the map holds, nested as their paths say."""
        return _nested([(f.path(side).split("."), f.canonical) for f in self.fields if f.canonical in self.writable(side)], canonical)


def get_path(record: Column, path: str) -> Column:
    """A variant at a dotted path; a flat key that holds the dots wins."""
    flat = F.try_variant_get(record, f'$["{path}"]', "variant")
    if "." not in path:
        return flat
    return F.coalesce(flat, F.try_variant_get(record, "$" + "".join(f'["{p}"]' for p in path.split(".")), "variant"))


def _json_value(v: Column) -> Column:
    text = F.substring(F.to_json(F.struct(untag(v).alias("v"))), 6, 1 << 30)
    return F.when(F.substring(v, 1, 1) == "s", F.substring(text, F.lit(1), F.length(text) - 1)).when(F.substring(v, 1, 1) == "t", F.concat(F.lit('"'), untag(v), F.lit('"'))).otherwise(F.coalesce(untag(v), F.lit("null")))


def _nested(paths: list[tuple[list[str], str]], canonical: Column) -> Column:
    heads: dict[str, list[tuple[list[str], str]]] = {}
    for parts, name in paths:
        heads.setdefault(parts[0], []).append((parts[1:], name))
    members = []
    for head, below in sorted(heads.items()):
        own = [name for rest, name in below if not rest]
        inner = _json_value(canonical[own[0]]) if own else _nested(below, canonical)
        present = F.lit(False)
        for _, name in below:
            present = present | F.coalesce(F.map_contains_key(canonical, name), F.lit(False))
        members.append(F.when(present, F.concat(F.lit(f'"{head}":'), inner)))
    return F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))


def problems(mapping: Mapping, side: str, schema: DataFrame) -> DataFrame:
    """(field, problem) of mapped paths that a peer's schema (field, read_only) lacks or forbids to write."""
    spark = schema.sparkSession
    writable = set(mapping.writable(side))
    rows = [(f.path(side).split(".")[0], f.path(side), f.canonical in writable) for f in mapping.fields]
    mapped = spark.createDataFrame(rows, "head string, field string, writes boolean")
    known = schema.select(F.col("field").alias("known"), "read_only")
    joined = mapped.join(F.broadcast(known), (F.col("known") == F.col("field")) | (F.col("known") == F.col("head")), "left")
    return joined.select("field", F.when(F.col("known").isNull(), "missing").when(F.col("writes") & F.col("read_only"), "read-only").alias("problem")).where("problem is not null").orderBy("field")
