"""Hard negatives: for each anchor and positive the best rows of other labels that score nearly as high, by inner product.

Vectors are whole numbers, floor(256 * x).  An orthogonal rotation by the principal
axes of all rows (second moments, not centred, so that products stay as they are)
moves most of a vector's length into its leading components.  A product is summed
over them step by step; what is left is at most the product of the two residual
norms, and a slack covers the rounding of rotation and sums.  Pairs whose bound falls
short of what an anchor still needs are discarded; the others are verified with
whole numbers, so scores and ties are exact whatever the rotation.

Anchors and rows meet in the cells of a grid: blocks of rows by blocks of anchors,
both cut at random and bounded in size, so a hot label is spread like any other.  A
cell keeps the best few of each anchor; those of all cells meet in one short group
for each anchor (and positive).  At the driver stand counts and the rotation only.

Defined cases: rows with a null id, a null label or a vector that is null or holds null, NaN
or infinite components take no part, nor do those with a squared norm over 2^56 after
scaling, for which the limits are no longs; vectors shorter than the longest are filled
up with zeros; rows that repeat an id are rows of their own, so a copy of an anchor is another
row of its label; ties go to the smaller id; an anchor without another row of its label, or
without negatives in range, gives no row; an empty table gives an empty result; other
columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import Store
from .vectors import matrix, whole

#: Relative slack of a product: far above the rounding of rotation, norms and sums.
SLACK = 1e-11
#: Pairs whose partial products stand in memory at once, and pairs verified at once.
PAIRS, VERIFIED = 1 << 20, 1 << 16


def _moments(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(i, moments with all j) of one task's rows."""
    total = np.zeros((width, width))
    for batch in batches:
        x = matrix(batch.column(0), width).astype(np.float64)
        total += x.T @ x
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, width * width + 1, width), pa.int32()), pa.array(total.ravel()))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width), pa.int32()), lists], names=["i", "row"])


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """The principal axes of the vectors q, as columns, the longest first."""
    sums = rows.select("q").mapInArrow(partial(_moments, width=width), "i int, row array<double>")
    found = sums.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    moments = np.zeros((width, width))
    for i, j, x in found:
        moments[i, j] = x
    return np.linalg.eigh((moments + moments.T) / 2)[1][:, ::-1]


class Block:
    """Vectors with their rotated coordinates and the norms that are left after each step."""

    def __init__(self, q: np.ndarray, axes: np.ndarray, cuts: list[int]) -> None:
        self.q, self.x = q, q.astype(np.float64) @ axes
        squares = np.cumsum((self.x**2)[:, ::-1], 1)[:, ::-1]
        self.left = np.stack([np.sqrt(squares[:, c]) if c < q.shape[1] else np.zeros(len(q)) for c in cuts], 1)
        self.norm = np.sqrt(squares[:, 0])

    def take(self, rows) -> Block:
        out = object.__new__(Block)
        out.q, out.x, out.left, out.norm = self.q[rows], self.x[rows], self.left[rows], self.norm[rows]
        return out


def survivors(a: Block, b: Block, cuts: list[int], least: np.ndarray, most: np.ndarray, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, product) of the pairs of a and b that may lie within least and most (by row of a), with exact products."""
    slack = SLACK * a.norm[:, None] * b.norm[None]
    total, begin, pairs = np.zeros((len(a.q), len(b.q))), 0, None
    for k, end in enumerate(cuts):
        if pairs is None:
            total += a.x[:, begin:end] @ b.x[:, begin:end].T
            room = a.left[:, k, None] * b.left[None, :, k] + slack
            alive = (total + room >= least[:, None]) & (total - room <= most[:, None])
            if allowed is not None:
                alive &= allowed
            if end == cuts[-1] or alive.mean() < 0.1:
                pairs = np.nonzero(alive)
                sums = total[pairs]
        else:
            i, j = pairs
            for at in range(0, len(i), VERIFIED):
                s = slice(at, at + VERIFIED)
                sums[s] += np.einsum("nd,nd->n", a.x[i[s], begin:end], b.x[j[s], begin:end])
            room = a.left[i, k] * b.left[j, k] + slack[i, j]
            alive = (sums + room >= least[i]) & (sums - room <= most[i])
            pairs, sums = (i[alive], j[alive]), sums[alive]
        begin = end
    i, j = pairs if pairs is not None else (np.zeros(0, np.int64),) * 2
    exact = [np.einsum("nd,nd->n", a.q[i[at : at + VERIFIED]], b.q[j[at : at + VERIFIED]]) for at in range(0, len(i), VERIFIED)]
    return i, j, np.concatenate(exact) if exact else np.zeros(0, np.int64)


def best(a: Block, b: Block, ids: np.ndarray, low: np.ndarray, high: np.ndarray, want: int, cuts: list[int], allowed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, row of b, product) of the first `want` rows of each group: row i of a with its k-th limits is group i * k.

    low, high: limits of 100 * product, as longs, by row of a and k; allowed(rows):
    which pairs with these rows of b count, or None for all.
    """
    n, width = low.shape
    kept = [np.zeros(0, np.int64)] * 3
    need = np.where(low == np.iinfo(np.int64).min, -np.inf, low / 100.0)
    top = np.where(high == np.iinfo(np.int64).max, np.inf, high / 100.0)
    step, at = 64, 0
    while at < len(ids):
        rows = np.arange(at, min(len(ids), at + step))
        at, step = at + step, max(1, PAIRS // max(1, n))  # a short first step finds limits for the next ones
        i, j, product = survivors(a, b.take(rows), cuts, need.min(1), top.max(1), allowed(rows) if allowed else None)
        for k in range(width):
            good = (100 * product >= low[i, k]) & (100 * product <= high[i, k]) & (product >= need[i, k])
            kept = [np.concatenate(x) for x in zip(kept, (i[good] * width + k, rows[j[good]], product[good]))]
        order = np.lexsort((ids[kept[1]], -kept[2], kept[0]))
        group = kept[0][order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        kept = [x[order][place < want] for x in kept]
        full = place[place < want] == want - 1
        need.reshape(-1)[kept[0][full]] = np.maximum(need.reshape(-1)[kept[0][full]], kept[2][full])
    return kept[0], kept[1], kept[2]


def _cuts(width: int) -> list[int]:
    return sorted({max(1, width * k // 4) for k in range(1, 5)})


def _blocks(anchors: pa.Table, rows: pa.Table, axes: np.ndarray) -> tuple[Block, Block, list[int], np.ndarray]:
    cuts = _cuts(len(axes))
    a, b = (Block(matrix(t.column("q"), len(axes)), axes, cuts) for t in (anchors, rows))
    return a, b, cuts, rows.column("vec_id").to_numpy()


def _positives(rows: pa.Table, anchors: pa.Table, axes: np.ndarray, want: int) -> pa.Table:
    """(anchor, vec_id, score) of the best rows of the same label, by label."""
    a, b, cuts, ids = _blocks(anchors, rows, axes)
    own, far = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    a_row, b_row = anchors.column("row").to_numpy(), rows.column("row").to_numpy()
    order = np.argsort(far, kind="stable")
    out = [(np.zeros(0, np.int64),) * 3]
    for label in np.unique(own):
        i = np.flatnonzero(own == label)
        j = order[slice(*np.searchsorted(far[order], [label, label + 1]))]
        other = lambda r, i=i, j=j: a_row[i][:, None] != b_row[j[r]][None]
        limits = [np.full((len(i), 1), f(np.int64)) for f in (lambda t: np.iinfo(t).min, lambda t: np.iinfo(t).max)]
        group, row, score = best(a.take(i), b.take(j), ids[j], *limits, want, cuts, other)
        out.append((a_row[i[group]], ids[j[row]], score))
    return pa.table([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor", "vec_id", "score"])


def _negatives(rows: pa.Table, anchors: pa.Table, axes: np.ndarray, want: int, least: int, most: int) -> pa.Table:
    """(anchor, place, vec_id, score) of the best rows of other labels within the limits of each positive."""
    a, b, cuts, ids = _blocks(anchors, rows, axes)
    lists = anchors.column("scores").combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    there = np.arange(max(1, size.max(initial=0)))[None] < size[:, None]
    scores = matrix(lists, there.shape[1])
    low, high = np.where(there, least * scores, np.iinfo(np.int64).max), np.where(there, most * scores, np.iinfo(np.int64).min)
    own, far = anchors.column("label").to_numpy(), rows.column("label").to_numpy()
    group, row, score = best(a, b, ids, low, high, want, cuts, lambda r: own[:, None] != far[r][None])
    names = ["anchor", "place", "vec_id", "score"]
    return pa.table([pa.array(anchors.column("row").to_numpy()[group // there.shape[1]]), pa.array((group % there.shape[1]).astype(np.int32)), pa.array(ids[row]), pa.array(score)], names=names)


def _met(rows: DataFrame, anchors: DataFrame, by: int, across: int, f, schema: str) -> DataFrame:
    """f over every cell: a block of rows and a block of anchors."""
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = rows.select("*", dealt(by).alias("_i")).select("*", spread(across).alias("_j"))
    right = anchors.select("*", dealt(across).alias("_j")).select("*", spread(by).alias("_i"))
    return left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(f, schema)


def mined(rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", factor: int = 256, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, rows_per_cell: int = 1 << 15, anchors_per_cell: int = 1 << 12) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) with least * p <= 100 * n <= most * p."""
    spark = rows.sparkSession
    store = Store(spark, "hard-negatives")
    named = whole(rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()), F.col(vector_col), factor, F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), most=float(1 << 56))
    # numbered in the written table: the number tells a row from its copies
    kept = store.save(named.withColumn("row", F.monotonically_increasing_id()), "rows")
    n, m, width = kept.agg(F.count("*"), F.count_if("is_anchor"), F.greatest(F.max(F.size("q")), F.lit(1))).first()
    axes = rotation(kept, width)
    body, anchors = kept.drop("is_anchor"), kept.where("is_anchor").drop("is_anchor")
    block = min(rows_per_cell, max(2048, -(-n // spark.sparkContext.defaultParallelism)))
    by, across = max(1, -(-n // block)), max(1, -(-m // anchors_per_cell))

    found = _met(body, anchors, by, across, partial(_positives, axes=axes, want=positives), "anchor long, vec_id long, score long")
    first = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id"))
    chosen = found.withColumn("place", first - 1).where(F.col("place") < positives)
    chosen = store.save(chosen, "positives")
    ranked = F.array_sort(F.collect_list(F.struct("place", "vec_id", "score")))
    limits = chosen.groupBy("anchor").agg(ranked.alias("p")).select("anchor", F.col("p.score").alias("scores"))
    asking = store.save(anchors.join(limits, F.col("row") == F.col("anchor")).drop("anchor"), "asking")

    found = _met(body, asking, by, across, partial(_negatives, axes=axes, want=negatives, least=least, most=most), "anchor long, place int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id"))
    hard = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    pairs = chosen.select("anchor", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = hard.join(pairs, ["anchor", "place"]).join(names, "anchor")
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
