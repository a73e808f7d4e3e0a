"""Tagged canonical values and the digests made of them.

A canonical record is a map from field to tagged string: s for strings, n for
numbers (whole ones without a fraction), b for booleans, t for times in UTC, x
for nested values as JSON, and a fixed mark for null.  A field that is not in the
map is absent, which is neither null nor empty.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .transforms import bound

NULL, ABSENT = "\x00null", "\x00absent"


def tag_string(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), v.cast("string")), F.lit(NULL))


def tag_number(v: Column) -> Column:
    """Equal numbers have equal tags whatever their types."""
    d = v.cast("double")
    whole = (d == F.floor(d)) & (F.abs(d) < 9.2e18)
    return F.coalesce(F.concat(F.lit("n"), F.when(whole, d.cast("long").cast("string")).otherwise(d.cast("string"))), F.lit(NULL))


def tag_boolean(v: Column) -> Column:
    return F.coalesce(F.concat(F.lit("b"), v.cast("string")), F.lit(NULL))


def tag_time(v: Column) -> Column:
    """A timestamp of the session's zone, which is UTC, without a trailing fraction of zeros."""
    whole = F.date_format(v, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.regexp_replace(F.date_format(v, ".SSSSSS"), "[.]?0+$", "")
    return F.coalesce(F.concat(F.lit("t"), whole, fraction, F.lit("Z")), F.lit(NULL))


def tag_variant(v: Column) -> Column:
    """The tagged value of a variant; null (SQL) where the variant has none."""
    return bound(v, lambda v: bound(F.schema_of_variant(v), lambda kind: _tagged(v, kind)))


def _tagged(v: Column, kind: Column) -> Column:
    text, number = F.try_variant_get(v, "$", "string"), F.try_variant_get(v, "$", "double")
    return F.when(v.isNotNull(), F.when(kind == "VOID", NULL).when(kind == "STRING", tag_string(text)).when(kind == "BOOLEAN", tag_boolean(text)).when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), tag_number(number)).otherwise(F.concat(F.lit("x"), F.to_json(v))))


def untag(v: Column) -> Column:
    """What a reader sees: the value without its tag, or null."""
    return F.when(v != NULL, F.substring(v, 2, 1 << 30))


def parts_digest(parts: Iterable[Column]) -> Column:
    """SHA-256 of length-prefixed parts, so that no two lists of parts are written alike."""
    chunks = [x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]
    return F.sha2(F.concat(*chunks).cast("binary"), 256)


def snapshot_hash(fields: Column, names: Iterable[str]) -> Column:
    """The digest of a canonical map over the named fields, in order of name."""
    return parts_digest(x for n in sorted(names) for x in (F.lit(n), F.coalesce(fields[n], F.lit(ABSENT))))


def idempotency_key(sync: Column, kind: Column, source: Column, source_id: Column, target: Column, target_id: Column, payload: Column, base: Column | None = None) -> Column:
    """One key for one write; base: the target's digest before it, so that a later repeat of a payload is a new write."""
    return parts_digest([sync, kind, source, source_id, target, target_id, payload, *([base] if base is not None else [])])


def review_id(sync: Column, subject: Column) -> Column:
    return F.concat(F.lit("review-"), F.substring(F.sha2(F.concat(sync, F.lit("\x00"), subject).cast("binary"), 256), 1, 32))


def queue_id(at: Column, sequence: Column) -> Column:
    """Ids whose order as text is the order of their times, then of their numbers."""
    nanos = (F.unix_micros(at) * 1000).cast("string")
    return F.concat_ws("-", F.lpad(nanos, 20, "0"), F.lpad(sequence.cast("string"), 10, "0"))


def ref(connector: Column, kind: Column, remote_id: Column) -> Column:
    return F.concat(connector, F.lit(":"), kind, F.lit("/"), remote_id)


def duration(seconds: Column) -> Column:
    """Whole seconds as 0s, 2s, 1m0s or 1h0m5s."""
    s = seconds.cast("long")
    h, m = (s / 3600).cast("long"), (s % 3600 / 60).cast("long")
    return F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("h"))).otherwise(""), F.when(s >= 60, F.concat(m.cast("string"), F.lit("m"))).otherwise(""), (s % 60).cast("string"), F.lit("s"))


def quoted(v: Column) -> Column:
    """A tagged value as reports show it: strings in quotes, null as (unset)."""
    text = F.regexp_replace(F.regexp_replace(untag(v), r"\\", r"\\\\"), '"', r'\\"')
    return F.when(v.isNull() | (v == NULL), "(unset)").when(F.substring(v, 1, 1) == "s", F.concat(F.lit('"'), text, F.lit('"'))).otherwise(untag(v))
