"""Streams with state of their own: echoes of our writes, and retries by timers.

Both hold a few values for each key in Spark's state store (RocksDB, set by `prepared`),
which a restarted query takes up where it stood.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.progress import BACKOFF_MS, LEAST_BACKOFF_MS, MOST_BACKOFF_MS, RETRYABLE

MOST_ATTEMPTS = 6
TRAFFIC = "ref string, hash string, at timestamp, expires_at timestamp, id string"


def prepared(spark: SparkSession) -> SparkSession:
    """A session whose streams may hold state with timers and expiry."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return spark


def _micros(values: pd.Series) -> list[int | None]:
    return [None if pd.isna(v) else pd.Timestamp(v).value // 1000 for v in values]


class Echoes(StatefulProcessor):
    """A ref's writes that have not come back yet, by digest, and until when its last one counts as late."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "hash string", "expires array<long>", self.ttl_ms)
        self.recent = handle.getValueState("recent", "until long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows))
        # a write stands before what happens at its time
        events = own["id"].notna()
        rows = zip(_micros(own["at"]), events, own["id"].where(events, None), own["hash"], _micros(own["expires_at"]))
        # what the state holds of a digest is read once and written once, however many rows there are
        any_open, until = self.open.exists(), self.recent.get()[0] if self.recent.exists() else None
        before: dict[str, list[int]] = {}
        now: dict[str, list[int]] = {}
        used, written, out = set(), False, []
        for at, event, name, digest, expires in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "")):
            if digest not in now:
                before[digest] = list(self.open.getValue((digest,))[0]) if any_open and self.open.containsKey((digest,)) else []
                now[digest] = before[digest]
            waiting = now[digest]
            if not event:
                now[digest] = [*waiting, expires]
                used.add(digest)
                until, written = max(expires, until or expires), True
                continue
            alive = sorted(t for t in waiting if t > at)
            if waiting:  # one entry answers one event: the one that would go first
                now[digest] = alive[1:]
                used.add(digest)
            out.append((name, key[0], digest, "echo" if alive else "near_miss" if until is not None and until > at else "foreign"))
        for digest in used:
            if now[digest]:
                self.open.updateValue((digest,), (now[digest],))
            elif before[digest]:
                self.open.removeKey((digest,))
        if written:
            self.recent.update((until,))
        yield pd.DataFrame(out, columns=["id", "ref", "hash", "verdict"])

    def close(self) -> None:
        pass


def classified(traffic: DataFrame, ttl_seconds: int | None = None) -> DataFrame:
    """(id, ref, hash, verdict) of the events in a stream of TRAFFIC: writes (id null, with expires_at) and events (with id).

    An event that carries the digest of an open write to its ref, before that expires, is
    an echo and uses the write up; another one on a ref with a write that has not expired
    is a near miss.  ttl_seconds: state that was not used for so long goes, by the clock
    (the query then runs until it is stopped); None: it stays.
    """
    mode = "none" if ttl_seconds is None else "processingTime"
    processor = Echoes(None if ttl_seconds is None else ttl_seconds * 1000)
    return traffic.groupBy("ref").transformWithStateInPandas(processor, "id string, ref string, hash string, verdict string", "append", mode)


def jittered(item: str, attempts: int, base_ms: int = BACKOFF_MS, least_ms: int = LEAST_BACKOFF_MS) -> int:
    """Milliseconds to wait after so many attempts: within a window that doubles, the same for the same item."""
    window = min(MOST_BACKOFF_MS, base_ms << max(0, min(attempts, 20) - 1))
    return max(least_ms, zlib.crc32(f"{item}/{attempts}".encode()) % (window + 1))


class Retries(StatefulProcessor):
    """An item, the attempts made at it, and a timer for the next one."""

    def __init__(self, attempt: Callable[[str, str, int], str | None], most: int, base_ms: int, least_ms: int) -> None:
        self.attempt, self.most, self.base_ms, self.least_ms = attempt, most, base_ms, least_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "payload string, attempts int")

    def _tried(self, item: str, payload: str, attempts: int, now_ms: int) -> list[tuple]:
        kind = self.attempt(item, payload, attempts + 1)
        attempts += 1
        if kind in RETRYABLE and attempts < self.most:
            self.item.update((payload, attempts))
            self.handle.registerTimer(now_ms + jittered(item, attempts, self.base_ms, self.least_ms))
            return []
        self.item.clear()
        return [(item, "done" if kind is None else "dead", attempts, kind)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        payloads = [p for own in rows for p in own["payload"]]
        out = [] if self.item.exists() else self._tried(key[0], payloads[0], 0, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["id", "outcome", "attempts", "error_kind"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.item.exists():
            payload, attempts = self.item.get()
            out = self._tried(key[0], payload, attempts, timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["id", "outcome", "attempts", "error_kind"])

    def close(self) -> None:
        pass


def retried(items: DataFrame, attempt: Callable[[str, str, int], str | None], most: int = MOST_ATTEMPTS, base_ms: int = BACKOFF_MS, least_ms: int = LEAST_BACKOFF_MS) -> DataFrame:
    """(id, outcome, attempts, error_kind) of a stream of items (id, payload): `done`, or `dead` after an error that no retry mends or `most` attempts.

    attempt(id, payload, number): one try, which returns the kind of its error or None;
    it runs in a task and may run again after a lost executor, so it has to be idempotent.
    An item that is waiting and comes again is the same item.  An item waits for its timer
    in the state, not in a queue that is read each time.
    """
    return items.groupBy("id").transformWithStateInPandas(Retries(attempt, most, base_ms, least_ms), "id string, outcome string, attempts int, error_kind string", "append", "processingTime")


def folded(item: str, payload: str, attempt: Callable[[str, str, int], str | None], most: int = MOST_ATTEMPTS) -> tuple[str, str, int, str | None]:
    """What `retried` makes of one item, without the waits."""
    for number in range(1, most + 1):
        kind = attempt(item, payload, number)
        if kind not in RETRYABLE:
            break
    return item, "done" if kind is None else "dead", number, kind
