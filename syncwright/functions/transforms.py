"""Field transforms as column expressions; a null or non-string value stays as it is."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def bound(v: Column, then: Callable[[Column], Column]) -> Column:
    """then(v), with v worked out once however often `then` names it."""
    return F.get(F.transform(F.array(v), lambda x: then(x)), F.lit(0))


def trim(v: Column) -> Column:
    """Without white space, of all of Unicode, at both ends."""
    return F.regexp_replace(v, r"(?U)^\s+|\s+$", "")


def lowercase(v: Column) -> Column:
    return F.lower(trim(v))


def domain_normalize(v: Column) -> Column:
    """The host of a URL, address or domain: no scheme, path, user, port, final dot or leading www."""
    v = lowercase(v)
    for pattern, marks in ((r"^.*?://", ["://"]), (r"(?s)[/?#].*$", ["/", "?", "#"]), (r"(?s)^.*@", ["@"]), (r"(?s):.*$", [":"]), (r"[.]$", []), (r"^www[.]", ["www."])):
        v = _without(v, pattern, marks)
    return v


def _without(v: Column, pattern: str, marks: list[str]) -> Column:
    """v without what a pattern finds; where a text holds none of the marks that its finds hold, nothing is searched."""
    if not marks:
        return F.regexp_replace(v, pattern, "")
    return bound(v, lambda x: F.when(reduce(or_, [x.contains(m) for m in marks]), F.regexp_replace(x, pattern, "")).otherwise(x))


def email_normalize(v: Column) -> Column:
    """Lower case, with a normalised domain after the last @."""
    return bound(trim(v), _email)


def _email(v: Column) -> Column:
    local = F.lower(F.regexp_extract(v, r"(?s)^(.*)@[^@]*$", 1))
    domain = domain_normalize(F.regexp_extract(v, r"(?s)@([^@]*)$", 1))
    return F.when(v.contains("@"), F.concat(local, F.lit("@"), domain)).otherwise(F.lower(v))


def email_fold_plus(v: Column) -> Column:
    """A normalised address without what follows the first + of its local part."""
    return bound(email_normalize(v), _folded)


def _folded(v: Column) -> Column:
    local, domain = F.regexp_extract(v, r"(?s)^(.*)@[^@]*$", 1), F.regexp_extract(v, r"(?s)(@[^@]*)$", 1)
    return F.when(v.contains("@"), F.concat(F.regexp_replace(local, r"(?s)[+].*$", ""), domain)).otherwise(v)


TRANSFORMS: dict[str, Callable[[Column], Column]] = {"": lambda v: v, "domain_normalize": domain_normalize, "email_fold_plus": email_fold_plus, "email_normalize": email_normalize, "lowercase": lowercase, "trim": trim}


def register(name: str, build: Callable[[Column], Column]) -> None:
    """Adds a transform of the caller's own; a name is taken once."""
    if name in TRANSFORMS:
        raise ValueError(f"transform {name!r} is registered already")
    TRANSFORMS[name] = build


def apply(name: str, v: Column) -> Column:
    if name not in TRANSFORMS:
        raise ValueError(f"unknown transform {name!r}; known: {', '.join(sorted(filter(None, TRANSFORMS)))}")
    return TRANSFORMS[name](v)


def apply_tagged(name: str, v: Column) -> Column:
    """A transform on a tagged canonical value: only strings (tag s) change."""
    return v if not name else bound(v, lambda t: F.when(F.substring(t, 1, 1) == "s", F.concat(F.lit("s"), apply(name, F.substring(t, 2, 1 << 30)))).otherwise(t))


def register_sql(spark: SparkSession) -> None:
    """SQL functions trim_unicode, email_normalize, ... of the same meaning, as macros that Catalyst inlines."""
    host = "lower(regexp_replace(v, '(?U)^\\\\s+|\\\\s+$', ''))"
    for pattern in (r"^.*?://", r"(?s)[/?#].*$", r"(?s)^.*@", r"(?s):.*$", r"[.]$", r"^www[.]"):
        host = f"regexp_replace({host}, '{pattern}', '')"
    spark.sql(f"create or replace temporary function domain_normalize(v string) returns string return {host}")
    clean = "regexp_replace(v, '(?U)^\\\\s+|\\\\s+$', '')"
    spark.sql(f"create or replace temporary function trim_unicode(v string) returns string return {clean}")
    spark.sql(
        "create or replace temporary function email_normalize(v string) returns string return case when contains(v, '@') then "
        f"lower(regexp_extract({clean}, '(?s)^(.*)@[^@]*$', 1)) || '@' || domain_normalize(regexp_extract({clean}, '(?s)@([^@]*)$', 1)) else lower({clean}) end"
    )
