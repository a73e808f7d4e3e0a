"""A peer as a Spark data source: what changed since a time, as a batch or as a stream.

    connector.register(spark)
    spark.read.format("peer").options(path=..., id="remote_id", updated_at="updated_at").load()
    spark.readStream.format("peer").options(...).load()

A peer is a Parquet file or a folder of them.  In a folder of batches (batch=<name>/, as
peers.append_once writes them) only completed ones are read.  Options: path, id and
updated_at (names of columns), columns (names to read, with commas; all without it),
max_rows with progress (see ChangeStream), split_bytes (of row groups in one partition).

A batch takes `updated_at >= time` (and >, <, <=, =) down to the row groups: those whose
statistics lie outside are no partitions, and the others are filtered as they are read.

Defined cases: a row without updated_at is in every batch without a filter, and in no
stream, since it has no place in the order of changes; a folder without files has no schema
and is an error; rows of equal times go by id; null ids come before all others.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
SPLIT_BYTES = 128 << 20


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PeerSource)


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The Parquet files of a peer, those of unfinished batches left out, in order of name."""
    store, at = _opened(path)
    if store.get_file_info(at).type == pafs.FileType.File:
        return [at]
    infos = store.get_file_info(pafs.FileSelector(at, recursive=True))
    names = {i.path for i in infos}
    folder = lambda p: p.rpartition("/")[0]
    whole = lambda p: "/batch=" not in p or f"{folder(p)}/_SUCCESS" in names
    return sorted(i.path for i in infos if i.type == pafs.FileType.File and i.path.endswith(".parquet") and "/_temporary/" not in i.path and whole(i.path))


def micros(value) -> int | None:
    """A time as microseconds since 1970, as it stands where it has no zone."""
    if value is None:
        return None
    if isinstance(value, date) and not isinstance(value, datetime):
        value = datetime(value.year, value.month, value.day)
    value = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    since = value - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (since.days * 86400 + since.seconds) * 1_000_000 + since.microseconds


@dataclass(frozen=True)
class RowGroup:
    """A row group with its least and greatest time; no times: None."""

    file: str
    number: int
    rows: int
    size: int
    least: int | None
    most: int | None


class Peer:
    """The files of a peer and what their footers say."""

    def __init__(self, options: dict[str, str]) -> None:
        missing = [k for k in ("path", "id", "updated_at") if not options.get(k)]
        if missing:
            raise ValueError(f"the peer source needs the options {', '.join(missing)}")
        self.path, self.id, self.updated_at = options["path"], options["id"], options["updated_at"]
        self.columns = [c.strip() for c in options["columns"].split(",")] if options.get("columns") else None
        self.split_bytes = int(options.get("split_bytes") or SPLIT_BYTES)
        self._known: dict[str, list[RowGroup]] = {}

    def schema(self) -> pa.Schema:
        files = _files(self.path)
        if not files:
            raise ValueError(f"no completed Parquet file in {self.path}")
        found = pq.read_schema(files[0], filesystem=_opened(self.path)[0])
        found = pa.schema([f for f in found if self.columns is None or f.name in self.columns])
        lost = [c for c in self.columns or [] if c not in found.names]
        if lost:
            raise ValueError(f"the peer has no column {', '.join(lost)}")
        return found.remove_metadata()

    def row_groups(self) -> list[RowGroup]:
        store = _opened(self.path)[0]
        for file in _files(self.path):
            if file not in self._known:
                footer = pq.read_metadata(file, filesystem=store)
                at = footer.schema.names.index(self.updated_at)
                groups = [footer.row_group(k) for k in range(footer.num_row_groups)]
                stats = [g.column(at).statistics for g in groups]
                ends = [(micros(s.min), micros(s.max)) if s is not None and s.has_min_max else ((None, None) if s is not None and s.null_count == g.num_rows else (LOWEST, HIGHEST)) for s, g in zip(stats, groups)]
                self._known[file] = [RowGroup(file, k, g.num_rows, g.total_byte_size, *e) for k, (g, e) in enumerate(zip(groups, ends))]
        return [g for file in sorted(self._known) for g in self._known[file]]

    def splits(self, groups: Iterable[RowGroup]) -> list[tuple[str, tuple[int, ...]]]:
        """(file, row groups) of about split_bytes each."""
        out: list[tuple[str, list[int], int]] = []
        for g in groups:
            if out and out[-1][0] == g.file and out[-1][2] + g.size <= self.split_bytes:
                out[-1][1].append(g.number)
                out[-1] = (g.file, out[-1][1], out[-1][2] + g.size)
            else:
                out.append((g.file, [g.number], g.size))
        return [(file, tuple(numbers)) for file, numbers, _ in out]

    def batches(self, file: str, numbers: Sequence[int], columns: list[str]) -> Iterator[pa.RecordBatch]:
        with _opened(self.path)[0].open_input_file(file) as source:
            yield from pq.ParquetFile(source).iter_batches(batch_size=10_000, row_groups=list(numbers), columns=columns)

    def read(self, file: str, numbers: Sequence[int], names: list[str], keep) -> Iterator[pa.RecordBatch]:
        """Batches of the columns `names`; keep(times, ids) says which rows, or None for all."""
        extra = [] if keep is None else [c for c in (self.updated_at, self.id) if c not in names]
        for batch in self.batches(file, numbers, [*names, *extra]):
            if keep is not None:
                batch = batch.filter(keep(times(batch.column(self.updated_at)), batch.column(self.id)))
            if batch.num_rows:
                yield batch.select(names)


def times(column: pa.Array) -> pa.Array:
    """Microseconds of a column of times."""
    return pc.cast(pc.cast(column, pa.timestamp("us", column.type.tz if pa.types.is_timestamp(column.type) else None)), pa.int64())


@dataclass
class Split(InputPartition):
    file: str
    numbers: tuple[int, ...]
    start: tuple | None = None
    end: tuple | None = None


class PeerSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "peer"

    def schema(self) -> StructType:
        return from_arrow_schema(Peer(self.options).schema(), prefer_timestamp_ntz=True)

    def reader(self, schema: StructType) -> ChangeReader:
        return ChangeReader(Peer(self.options), schema.names)

    def streamReader(self, schema: StructType) -> ChangeStream:
        return ChangeStream(Peer(self.options), schema.names, int(self.options.get("max_rows") or 0), self.options.get("progress"))


class ChangeReader(DataSourceReader):
    """All rows, or those within limits on the time of change."""

    def __init__(self, peer: Peer, names: list[str]) -> None:
        self.peer, self.names = peer, names
        self.least, self.most, self.limited = LOWEST, HIGHEST, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            known = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) and f.attribute == (self.peer.updated_at,) and isinstance(f.value, date)
            if not known:
                yield f
                continue
            at = micros(f.value)
            if isinstance(f, (GreaterThanOrEqual, GreaterThan, EqualTo)):
                self.least = max(self.least, at + isinstance(f, GreaterThan))
            if isinstance(f, (LessThanOrEqual, LessThan, EqualTo)):
                self.most = min(self.most, at - isinstance(f, LessThan))
            self.limited = True

    def partitions(self) -> Sequence[InputPartition]:
        groups = self.peer.row_groups()
        if self.limited:
            groups = [g for g in groups if g.most is not None and g.most >= self.least and g.least <= self.most]
        return [Split(file, numbers) for file, numbers in self.peer.splits(groups)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        within = lambda at, _: pc.fill_null(pc.and_(pc.greater_equal(at, self.least), pc.less_equal(at, self.most)), False)
        return self.peer.read(partition.file, partition.numbers, self.names, within if self.limited else None)


class ChangeStream(DataSourceStreamReader):
    """Changes in the order of (time, id); the offset is the last one taken.

    Each micro-batch takes all that came after the one before.  max_rows bounds it: it
    then ends at a time, with all rows of that time, so it holds more rows only if one time
    has more.  The place it has come to is noted in the folder `progress`, since Spark does
    not tell a restarted source where it stands before it asks how far to go.  Only the
    column of times (and the ids of one time) is read to find the end.

    A row that comes late, with a time before the offset, is not seen here: read on from
    a watermark with an overlap (operators.progress) as a batch, as for any peer.
    """

    def __init__(self, peer: Peer, names: list[str], max_rows: int, progress: str | None) -> None:
        if max_rows and not progress:
            raise ValueError("max_rows needs a folder for the option progress")
        self.peer, self.names, self.max_rows, self.progress = peer, names, max_rows, progress
        self.at = self._noted() if max_rows else LOWEST

    def initialOffset(self) -> dict:
        return {"at": LOWEST, "id": ""}

    def latestOffset(self) -> dict:
        groups = [g for g in self.peer.row_groups() if g.most is not None]
        end = max((g.most for g in groups), default=LOWEST)
        if end == HIGHEST:  # no statistics: the times themselves
            end = max((int(t.max()) for g in groups if len(t := self._times(g))), default=LOWEST)
        if self.max_rows:
            end = self._bounded(groups, end)
        ids = [self._ids_at(g, end) for g in groups if g.least <= end <= g.most]
        last = max((i for own in ids for i in own if i is not None), default="")
        return {"at": end, "id": last}

    def _times(self, g: RowGroup) -> np.ndarray:
        return np.concatenate([times(b.column(0)).drop_null().to_numpy() for b in self.peer.batches(g.file, [g.number], [self.peer.updated_at])] or [np.zeros(0, np.int64)])

    def _ids_at(self, g: RowGroup, at: int) -> list:
        found = []
        for b in self.peer.batches(g.file, [g.number], [self.peer.updated_at, self.peer.id]):
            own = b.filter(pc.fill_null(pc.equal(times(b.column(self.peer.updated_at)), at), False)).column(self.peer.id)
            found += [pc.max(own).as_py()] if len(own) else []
        return found

    def _bounded(self, groups: list[RowGroup], end: int) -> int:
        """The time that ends the next max_rows rows after the place come to."""
        ahead = sorted((g for g in groups if g.most > self.at), key=lambda g: g.least)
        found = np.zeros(0, np.int64)
        for k, g in enumerate(ahead):
            t = self._times(g)
            found = np.sort(np.concatenate([found, t[t > self.at]]))
            beyond = ahead[k + 1].least if k + 1 < len(ahead) else HIGHEST
            if np.searchsorted(found, beyond) > self.max_rows:  # rows before any that is not read yet
                break
        if len(found) <= self.max_rows:
            return end
        before = found[found < found[self.max_rows]]
        return int(before[-1] if len(before) else found[0])

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if self.max_rows and end["at"] > self.at:
            self.at = end["at"]
            self._note(self.at)
        groups = [g for g in self.peer.row_groups() if g.most is not None and g.most >= start["at"] and g.least <= end["at"]]
        return [Split(file, numbers, (start["at"], start["id"]), (end["at"], end["id"])) for file, numbers in self.peer.splits(groups)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        def after(at: pa.Array, ids: pa.Array, place: tuple) -> pa.Array:
            later = pc.greater(at, place[0])
            if place[1] == "" and not pa.types.is_string(ids.type):
                return pc.or_(later, pc.equal(at, place[0]))
            return pc.or_(later, pc.and_(pc.equal(at, place[0]), pc.fill_null(pc.greater(ids, pa.scalar(place[1], ids.type)), False)))

        def within(at: pa.Array, ids: pa.Array) -> pa.Array:
            return pc.fill_null(pc.and_(after(at, ids, partition.start), pc.invert(after(at, ids, partition.end))), False)

        return self.peer.read(partition.file, partition.numbers, self.names, within)

    def _place(self) -> tuple[pafs.FileSystem, str]:
        store, at = _opened(self.progress)
        return store, f"{at.rstrip('/')}/place.json"

    def _noted(self) -> int:
        store, at = self._place()
        if store.get_file_info(at).type == pafs.FileType.NotFound:
            return LOWEST
        with store.open_input_file(at) as f:
            return json.loads(f.read())["at"]

    def _note(self, at: int) -> None:
        store, name = self._place()
        store.create_dir(name.rpartition("/")[0], recursive=True)
        with store.open_output_stream(f"{name}.new") as f:
            f.write(json.dumps({"at": at}).encode())
        store.move(f"{name}.new", name)
