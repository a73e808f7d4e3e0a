"""The outcome of every event, and its counters taken in passing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..operators.progress import retryable

# The counters, and the outcomes that some of them count.
STATS = ("ingested", "echoes", "near_misses", "created", "updated", "deleted", "reviewed", "skipped", "no_change", "retried", "dead_lettered")
_BY_OUTCOME = {"echoes": "echo", "created": "created", "updated": "updated", "deleted": "deleted", "reviewed": "reviewed", "skipped": "skipped", "no_change": "no_change", "retried": "retried", "dead_lettered": "dead_letter"}


def decision_outcome() -> Column:
    """What a row of plans.plan.standing comes to: created, updated, reviewed, skipped or no_change."""
    action = F.col("d")["action"]
    paired = F.when(action == "escalate", "reviewed").when(action.isin("write_left", "write_right", "write_both"), "updated").otherwise("no_change")
    return F.when(F.col("outcome") == "create", "created").when(F.col("outcome") == "review", "reviewed").when(F.col("outcome") == "skip", "skipped").otherwise(paired)


def after_errors(outcome: Column, error_kind: Column, attempts: Column, most_attempts: int = 6) -> Column:
    """An outcome after the peer's answer: a write that failed is tried again or is a dead letter."""
    wrote = outcome.isin("created", "updated", "deleted") & error_kind.isNotNull()
    return F.when(wrote & retryable(error_kind) & (attempts < most_attempts), "retried").when(wrote, "dead_letter").otherwise(outcome)


def counters() -> list[Column]:
    """An aggregate for each of STATS over rows (verdict, outcome): verdict of operators.origin or null, outcome as above or echo."""
    one = {name: F.col("outcome") == text for name, text in _BY_OUTCOME.items()} | {"ingested": F.lit(True), "near_misses": F.col("verdict") == "near_miss"}
    return [F.count_if(F.coalesce(one[name], F.lit(False))).alias(name) for name in STATS]


def observed(rows: DataFrame, name: str = "outcomes") -> tuple[DataFrame, Observation]:
    """rows, and an observation that holds the counters once an action has gone over them: no second pass."""
    found = Observation(name)
    return rows.observe(found, *counters()), found


def observed_stream(rows: DataFrame, name: str = "outcomes") -> DataFrame:
    """A stream whose progress reports hold the counters of each micro-batch under `name`."""
    return rows.observe(name, *counters())


def stats(rows: DataFrame) -> DataFrame:
    """(stat, n) by a pass of its own."""
    pairs = F.array(*[F.struct(F.lit(name).alias("stat"), F.col(name).alias("n")) for name in STATS])
    return rows.agg(*counters()).select(F.explode(pairs).alias("s")).select("s.*")
