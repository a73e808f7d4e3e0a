"""Quality scores: random-indexing word vectors pooled per document, then a two-layer network.

Every hashed word has a sparse random index vector; its context vector is the
sum of the index vectors of its neighbours over all documents.  A document is
the mean of its words' context vectors, with how alike words at distances 1 to 4
are.  A network of one hidden layer is trained with numpy on a bounded sample of
labelled rows, and its logits are divided by a temperature fitted on rows kept
apart from the training.

Fixed sizes: CELLS context vectors of DIM numbers (what each task sends on and
what is broadcast), and max_labels labelled rows (those of the smallest hashes).

Defined cases: null and wordless texts get the score of a vector of zeros; rows
that repeat a doc_id are scored each by its text; with labels of one kind only,
or none, every score is the share of label 1 (0.5 without labels); a null doc_id
is scored and not held out; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import RUNS, mix64, words_by_text
from .store import Store, small_batches

CELLS, DIM, SLICES = 1 << 14, 64, 64
_index = mix64(np.arange(2 * CELLS, dtype=np.uint64) + np.uint64(5)).reshape(CELLS, 2)
_AT, _SIGN = (_index >> np.uint64(58)).astype(np.int64), np.where(_index & np.uint64(1), 1, -1).astype(np.int64)


def _cells(column) -> Iterator[np.ndarray]:
    for _, h, _, _ in words_by_text(column, lower=False, classes=RUNS):
        yield (h >> np.uint64(50)).astype(np.int64)


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS * DIM, np.int64)
    for batch in batches:
        for cell in _cells(batch.column(0)):
            for gap in (1, 2):
                x, y = cell[:-gap], cell[gap:]
                for k in range(2):
                    np.add.at(total, x * DIM + _AT[y, k], _SIGN[y, k])
                    np.add.at(total, y * DIM + _AT[x, k], _SIGN[x, k])
    if total.any():
        yield _slices(total)


def _slices(total: np.ndarray) -> pa.RecordBatch:
    parts = total.reshape(SLICES, -1)
    return pa.RecordBatch.from_pydict({"slice": pa.array(np.arange(SLICES, dtype=np.int32)), "sums": pa.array([x.tobytes() for x in parts], pa.binary())})


def _add_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the rows of each slice as they come; a task holds its slices' sums only."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
            x = np.frombuffer(sums.as_buffer(), np.int64)
            total[k] = total[k] + x if k in total else x.copy()
    if total:
        yield pa.RecordBatch.from_pydict({"slice": pa.array(list(total), pa.int32()), "sums": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """(CELLS, DIM) unit vectors, from the neighbours of every word of every document."""
    parts = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(_context_rows, "slice int, sums binary")
    # two steps, so that no task adds up more than a share of the first tasks' sums
    for key in (("slice", F.pmod(F.xxhash64("sums"), F.lit(16))), ("slice",)):
        parts = parts.repartition(*key).mapInArrow(_add_slices, "slice int, sums binary")
    total = np.zeros((SLICES, CELLS * DIM // SLICES), np.int64)
    for row in parts.collect():  # SLICES rows of a fixed size
        total[row["slice"]] += np.frombuffer(row["sums"], np.int64)
    vectors = total.reshape(CELLS, DIM).astype(np.float32)
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + np.float32(1e-9))


LAGS, PIECE = 4, 4096


def pooled(cell: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """DIM means, the mean's norm and the mean likeness of words LAG apart, of one document."""
    out = np.zeros(DIM + 1 + LAGS)
    for at in range(0, len(cell), PIECE):
        part = vectors[cell[at : at + PIECE + LAGS]]
        own = part[:PIECE]
        out[:DIM] += own.sum(axis=0, dtype=np.float64)
        for lag in range(1, LAGS + 1):
            later = part[lag : lag + len(own)]
            out[DIM + lag] += np.einsum("ij,ij->", own[: len(later)], later)
    out /= max(1, len(cell))
    out[DIM] = np.sqrt((out[:DIM] ** 2).sum())
    return out


def _pool_rows(batches: Iterator[pa.RecordBatch], vectors) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pooled(c, vectors.value) for c in _cells(batch.column(2))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "label", "x"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3, seed: int = 7) -> dict:
    """The network's numbers, by Adam on the cross-entropy; deterministic for ordered rows."""
    if len(y) == 0 or y.min() == y.max():
        return {"share": float(y.mean()) if len(y) else 0.5}
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(y))
    apart, used = order[: len(y) // 10], order[len(y) // 10 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [draw.normal(0, z.shape[1] ** -0.5, (z.shape[1], hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), np.zeros(())]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        used = draw.permutation(used)
        for at in range(0, len(used), 128):
            k = used[at : at + 128]
            h = np.tanh(z[k] @ p[0] + p[1])
            d = (_sigmoid(h @ p[2] + p[3]) - y[k]) / len(k)
            dh = np.outer(d, p[2]) * (1 - h * h)
            step += 1
            for i, g in enumerate((z[k].T @ dh + 1e-4 * p[0], dh.sum(axis=0), h.T @ d + 1e-4 * p[2], d.sum())):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                p[i] = p[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    logit = np.tanh(z[apart] @ p[0] + p[1]) @ p[2] + p[3]
    heats = np.exp(np.linspace(np.log(0.25), np.log(8), 60))
    loss = [np.mean(np.logaddexp(0, logit / t) - y[apart] * logit / t) for t in heats] if len(apart) else [0.0]
    return {"mean": mean, "scale": scale, "p": p, "heat": float(heats[int(np.argmin(loss))]) if len(apart) else 1.0}


def scores(x: np.ndarray, net: dict) -> np.ndarray:
    if "share" in net:
        return np.full(len(x), net["share"])
    p = net["p"]
    return _sigmoid((np.tanh(((x - net["mean"]) / net["scale"]) @ p[0] + p[1]) @ p[2] + p[3]) / net["heat"])


def _score_rows(batches: Iterator[pa.RecordBatch], vectors, net) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pooled(c, vectors.value) for c in _cells(batch.column(1))]
        score = scores(np.array(rows).reshape(len(rows), DIM + 1 + LAGS), net.value)
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(score)], names=["doc_id", "score"])


def held_out(doc_id) -> F.col:
    """Rows whose labels are never learnt from: crc32 of the doc_id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; labels: (doc_id, quality)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    vectors = spark.sparkContext.broadcast(context_vectors(rows))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    usable = usable.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_labels)
    learnt = rows.join(F.broadcast(usable), "doc_id").select("doc_id", "label", "text").mapInArrow(partial(_pool_rows, vectors=vectors), "doc_id long, label int, x array<double>")
    # different rows of a repeated id count apart, and equal ones once: max_labels rows of DIM + 5 numbers come back in any case
    found = learnt.distinct().orderBy(F.xxhash64("doc_id", "label", "x"), "doc_id", "label").limit(max_labels).toArrow()
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(found), DIM + 1 + LAGS)
    y = found["label"].to_numpy().astype(np.float64)
    order = np.lexsort([y, *x.T[:4]]) if len(y) else []
    net = spark.sparkContext.broadcast(train(x[order], y[order]) if len(y) else train(x, y))
    scored = rows.mapInArrow(partial(_score_rows, vectors=vectors, net=net), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those predicted to be of low quality; its columns unchanged."""
    low = quality_scores(docs, labels, id_col=id_col, **options).where("predicted = 0").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(Store(docs.sparkSession, "quality").save(low, "rejected"), id_col, "left_anti").select(*docs.columns)
