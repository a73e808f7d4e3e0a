"""Calls to peers as a stream, each with the wait that its peer's bucket imposes; what peers answer moves their rates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.pacing import BURST, RATE

TRAFFIC = "peer string, at timestamp, id string, outcome string, retry_after double"

# How answers move a rate.
SHRINK, LEAST, GROW, GROWS_AFTER = 0.5, 0.125, 1.25, 20


class Bucket:
    """A peer's tokens (owed if negative), its rate, the answers since that moved, and until when it is shut; times in microseconds."""

    def __init__(self, rate: float, burst: int, tokens: float | None = None, last: int | None = None, now_rate: float | None = None, accepted: int = 0, shut: int = 0) -> None:
        self.limit, self.burst = rate, burst
        self.tokens = float(burst) if tokens is None else tokens
        self.last, self.rate, self.accepted, self.shut = last, rate if now_rate is None else now_rate, accepted, shut

    def state(self) -> tuple:
        return self.tokens, self.last, self.rate, self.accepted, self.shut

    def call(self, at: int) -> int:
        """Takes a token; the microseconds to wait before it may be used."""
        if self.last is None or at > self.last:
            earned = 0.0 if self.last is None else (at - self.last) / 1e6 * self.rate
            self.tokens, self.last = min(float(self.burst), self.tokens + earned), at
        self.tokens -= 1
        return max(self.shut - at, round(-self.tokens / self.rate * 1e6), 0)

    def refused(self, at: int, retry_after: float) -> None:
        """The peer pushed back: a lower rate, nothing left to spend, shut for as long as it asks or one token takes."""
        self.rate, self.accepted = max(self.limit * LEAST, self.rate * SHRINK), 0
        self.tokens, self.last = min(self.tokens, 0.0), at
        self.shut = max(self.shut, at + round((retry_after if retry_after > 0 else 1 / self.rate) * 1e6))

    def taken(self) -> None:
        """The peer took a call: so many of them in a row earn a part of the rate back."""
        if self.rate < self.limit:
            self.accepted += 1
            if self.accepted == GROWS_AFTER:
                self.rate, self.accepted = min(self.limit, self.rate * GROW), 0


class Buckets(StatefulProcessor):
    """One bucket for each peer in the state store: five numbers, however many calls there were."""

    def __init__(self, limits: dict[str, tuple[float, int]]) -> None:
        self.limits = limits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("bucket", "tokens double, last long, rate double, accepted int, shut long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = Bucket(*self.limits.get(key[0], (RATE, BURST)), *(self.held.get() if self.held.exists() else ()))
        own = pd.concat(list(rows))
        own = own[own["at"].notna()]
        # an answer stands before a call of its time
        own = own.assign(calls=own["outcome"].isna()).sort_values(["at", "calls", "id"], kind="stable", na_position="first")
        out = []
        for at, name, outcome, after in zip(own["at"], own["id"], own["outcome"], own["retry_after"]):
            at = pd.Timestamp(at).value // 1000
            if pd.isna(outcome):
                out.append((name, key[0], bucket.call(at), bucket.rate))
            elif outcome == "rejected":
                bucket.refused(at, 0.0 if pd.isna(after) else after)
            elif outcome == "accepted":
                bucket.taken()
        self.held.update(bucket.state() if bucket.last is not None else (*bucket.state()[:1], 0, *bucket.state()[2:]))
        yield pd.DataFrame(out, columns=["id", "peer", "wait_micros", "rate"])

    def close(self) -> None:
        pass


def paced(traffic: DataFrame, limits: dict[str, tuple[float, int]]) -> DataFrame:
    """(id, peer, wait_micros, rate) of the calls (outcome null) in a stream of TRAFFIC; its other rows are answers: `accepted`, or `rejected` with retry_after seconds.

    A rejection halves the peer's rate (an eighth of its limit at least), forfeits what the
    bucket holds and shuts it; 20 accepted calls in a row raise the rate by a quarter, up to
    the limit.  Without rejections the waits are those of `operators.pacing.paced`.  A batch
    of one peer is one task's; how many rows a batch has is up to the source.
    """
    return traffic.groupBy("peer").transformWithStateInPandas(Buckets(limits), "id string, peer string, wait_micros long, rate double", "append", "none")
