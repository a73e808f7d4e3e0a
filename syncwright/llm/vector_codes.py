"""Vector codes: each part of a vector becomes the number of its nearest codebook entry, by Hamerly's form of Lloyd.

Components are floor(1024 * x); vectors are cut into equal consecutive parts, and each
part position has a codebook, at first that part of the vectors of the smallest ids.
In each round every part is assigned to its nearest entry (squared distance, ties to the
lower index), then each entry becomes the floor of the mean of its parts; an entry
without parts stays.  A last assignment gives the codes.

With its entry every part keeps an upper bound of the distance to it and a lower bound
of the distance to the second nearest, persisted in the table of each round.  Moves of
the entries widen both; only if the upper bound is not strictly below the lower one (and
below half the way to the entry's nearest neighbour) are all distances computed, as
whole numbers.  Bounds are rounded outwards, and a strict gap leaves no room for a tie,
so codes are those of full scans.

Rows flow through the rounds without a shuffle; only sums per task and entry are
shuffled.  The codebooks, parts * entries vectors, are the only thing at the driver.

Defined cases: rows whose vector is null or holds null, NaN or infinite components, or is
beyond vectors.MOST, are left out; vectors shorter than the longest (or than the next
multiple of `parts`) are filled up with zeros; with fewer kept rows than entries the codebook has as
many entries as rows; rows that repeat are coded each; of equal ids the smaller label and vector
come first in the codebook, null ids last; null labels form one group; an empty table gives
an empty result; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store
from .vectors import matrix, products, whole

#: Outward rounding of bounds, far above the error of the few operations that make them.
WIDER = 1e-13


def _moves(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry of each part moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(2).astype(np.float64)) * (1 + WIDER)


def _half_gaps(book: np.ndarray) -> np.ndarray:
    """Half the distance of each entry of one part to the nearest other one, rounded down."""
    size = (book**2).sum(1)
    far = size[:, None] + size[None] - 2 * products(book, book)
    np.fill_diagonal(far, np.iinfo(np.int64).max)
    return np.sqrt(far.min(1).astype(np.float64)) * (0.5 - WIDER)


def assigned(x: np.ndarray, book: np.ndarray, code: np.ndarray | None, upper: np.ndarray | None, lower: np.ndarray | None, moved: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code, upper, lower, scanned) of the parts x at one position; code and bounds of the round before, or None at first."""
    n, k = len(x), len(book)
    if code is None:
        code, upper, lower, scan = np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.ones(n, bool)
    else:
        most = int(moved.argmax())
        second = float(np.delete(moved, most).max(initial=0.0))
        away = np.where(code == most, second, moved[most])
        lower = lower - away - WIDER * (lower + away)
        upper = (upper + moved[code]) * (1 + WIDER)
        bound = np.maximum(lower, _half_gaps(book)[code])
        scan = ~(upper < bound)
        near = np.flatnonzero(scan)  # the distance to the entry itself may be enough
        upper[near] = np.sqrt(((x[near] - book[code[near]]) ** 2).sum(1).astype(np.float64)) * (1 + WIDER)
        scan = ~(upper < bound)
    rows = np.flatnonzero(scan)
    for a in range(0, len(rows), 4096):
        r = rows[a : a + 4096]
        far = (x[r] ** 2).sum(1)[:, None] + (book**2).sum(1)[None] - 2 * products(x[r], book)
        best = far.argmin(1)
        code[r] = best
        upper[r] = np.sqrt(far[np.arange(len(r)), best].astype(np.float64)) * (1 + WIDER)
        far[np.arange(len(r)), best] = np.iinfo(np.int64).max
        lower[r] = np.sqrt(far.min(1).astype(np.float64)) * (1 - WIDER) if k > 1 else np.inf
    return code, upper, lower, scan


def _column(batch: pa.RecordBatch, name: str, parts: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, parts).copy()


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1]), pa.int32()), pa.array(np.ascontiguousarray(values).ravel(), kind))


def _round(batches: Iterator[pa.RecordBatch], books: np.ndarray, moved: np.ndarray | None, last: bool) -> Iterator[pa.RecordBatch]:
    parts, _, width = books.shape
    for batch in batches:
        x = matrix(batch.column("q"), parts * width).reshape(-1, parts, width)
        before = [_column(batch, c, parts) for c in ("code", "upper", "lower")] if moved is not None else None
        found = [assigned(x[:, p], books[p], *([b[:, p].copy() for b in before] if before else (None, None, None)), moved[p] if before else None) for p in range(parts)]
        code, upper, lower = (np.stack([f[k] for f in found], 1) for k in range(3))
        names, columns = ["vec_id", "label"], [batch.column("vec_id"), batch.column("label")]
        if last:
            error = sum(((x[:, p] - books[p][code[:, p]]) ** 2).sum(1) for p in range(parts))
            names, columns = [*names, "code", "error"], [*columns, _lists(code, pa.int32()), pa.array(error, pa.int64())]
        else:
            names, columns = [*names, "q", "code", "upper", "lower"], [*columns, batch.column("q"), _lists(code, pa.int32()), _lists(upper, pa.float64()), _lists(lower, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _sums(batches: Iterator[pa.RecordBatch], parts: int, entries: int, width: int) -> Iterator[pa.RecordBatch]:
    """(part, entry, n, total) of one task."""
    n, total = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
    for batch in batches:
        x = matrix(batch.column("q"), parts * width).reshape(-1, parts, width)
        code = _column(batch, "code", parts)
        for p in range(parts):
            n[p] += np.bincount(code[:, p], minlength=entries)
            np.add.at(total[p], code[:, p], x[:, p])
    p, e = np.nonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e]), _lists(total[p, e], pa.int64())], names=["part", "entry", "n", "total"])


def coded(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", factor: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code array<int>, error) of every kept row, and the final codebooks as [part, entry, position]."""
    spark = rows.sparkSession
    store = Store(spark, "vector-codes")
    kept = store.save(whole(rows, F.col(vector_col), factor, F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label")), "rows")
    width = -(-max(1, kept.agg(F.max(F.size("q"))).first()[0] or 1) // parts)
    first = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.col("label").asc_nulls_last(), "q").limit(entries).collect()
    books = np.zeros((parts, len(first), width), np.int64)
    for k, row in enumerate(first):
        books[:, k] = np.array([*row.q, *[0] * (parts * width - len(row.q))], np.int64).reshape(parts, width)
    final = "vec_id long, label long, code array<int>, error long"
    if not first:
        return spark.createDataFrame([], final), books
    state, moved, head = kept, None, "vec_id long, label long, q array<int>, code array<int>, upper array<double>, lower array<double>"
    for k in range(rounds):
        state = store.save(state.mapInArrow(partial(_round, books=books, moved=moved, last=False), head), f"round-{k}")
        if k:
            store.drop(f"round-{k - 1}")
        sums = state.mapInArrow(partial(_sums, parts=parts, entries=len(first), width=width), "part int, entry int, n long, total array<long>")
        # as decimals, so that no number of rows makes a sum overflow; parts * entries rows come back
        totals = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[j].cast("decimal(20,0)")).alias(f"t{j}") for j in range(width)])
        new = books.copy()
        for row in totals.collect():
            new[row[0], row[1]] = [int(t) // row[2] for t in row[3:]]
        books, moved = new, _moves(books, new)
    return state.mapInArrow(partial(_round, books=books, moved=moved, last=True), final), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(rows: DataFrame, **options) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): two hex digits a part, and the error summed over equal labels."""
    spark = rows.sparkSession
    codes, books = coded(rows, **options)
    codes = Store(spark, "vector-codes").save(codes, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    text = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", text.alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
