"""Toxicity by a classifier chain over categories.

The categories are predicted one after the other by linear models on counts of
words and of word beginnings (five and seven bytes); each later model also gets
the probabilities of the categories before it, in training those of models that did
not see the row (out-of-fold).  The last category is the label itself.  The earlier
ones are kinds of toxic rows, found by grouping the labelled toxic rows by their
counts (k-means), so what makes up a kind is learnt and no word defines it.

Words that enter the models are those most tied to the label, counted with Spark
over a bounded sample of labelled rows (those of the smallest hashes); words in
fewer than min_rows sampled rows are left out.

Defined cases: null and wordless texts have no counts and get the base rate; texts
of any length are counted whole; words equally tied to the label (ties) enter by
their hash; rows that repeat a doc_id are scored each by its text, and with the
same text count once in the sample; a null doc_id is scored; without labels every
probability is 0; with fewer toxic rows than kinds the kinds left over are empty;
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import RUNS, words_by_text
from .store import Store, small_batches

PREFIXES = (0, 5, 7)


def _hashes(column) -> Iterator[np.ndarray]:
    """The words, then their beginnings, of every text."""
    for parts in zip(*(words_by_text(column, lower=True, classes=RUNS, prefix=k) for k in PREFIXES)):
        yield np.concatenate([h for _, h, _, _ in parts]).view(np.int64)


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, counts = [], []
        for h in _hashes(batch.column(1)):
            w, n = np.unique(h, return_counts=True)
            words.append(w), counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), pa.array(words, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["doc_id", "text_id", "toxic", "words", "counts"])


def _chosen_rows(batches: Iterator[pa.RecordBatch], chosen) -> Iterator[pa.RecordBatch]:
    """(toxic, size, at, n): the counts of the chosen words that a sampled row has, by their places, and of all."""
    words = chosen.value
    for batch in batches:
        size, places, numbers = [], [], []
        for h, n in zip(batch.column(1), batch.column(2)):
            h, n = h.values.to_numpy(zero_copy_only=False), n.values.to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(words, h), max(0, len(words) - 1))
            hit = words[at] == h if len(words) else np.zeros(len(h), bool)
            size.append(int(n.sum())), places.append(at[hit]), numbers.append(n[hit])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(places, pa.list_(pa.int64())), pa.array(numbers, pa.list_(pa.int64()))], names=["toxic", "size", "at", "n"])


def counts_of(words: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """log(1 + count) of each chosen (sorted) word, and of all."""
    at = np.searchsorted(chosen, words)
    at[at == len(chosen)] = 0
    hit = at[chosen[at] == words] if len(chosen) else np.zeros(0, np.int64)
    return np.log1p(np.append(np.bincount(hit, minlength=len(chosen)), len(words)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-4) -> np.ndarray:
    """Logistic weights, the last one the bias, by full-batch Adam."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.max() == 0:
        w[-1] = -60.0
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for k in range(1, steps + 1):
        g = x.T @ (_sigmoid(x @ w.astype(np.float32)) - y).astype(np.float32) / len(y) + decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def fit_chain(x: np.ndarray, targets: np.ndarray, folds: int = 3) -> list[np.ndarray]:
    """One weight vector for each category; later ones see out-of-fold probabilities of earlier ones."""
    fold = np.arange(len(x)) % folds
    models = []
    for c in range(targets.shape[1]):
        models.append(fit_linear(x, targets[:, c]))
        apart = np.zeros(len(x))
        for k in range(folds):
            apart[fold == k] = predict(x[fold == k], fit_linear(x[fold != k], targets[fold != k, c]))
        x = np.hstack([x, apart[:, None]])
    return models


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


def chain_scores(x: np.ndarray, models: list[np.ndarray]) -> np.ndarray:
    out = []
    for w in models:
        out.append(predict(x, w))
        x = np.hstack([x, out[-1][:, None]])
    return np.stack(out, axis=1)


def kinds_of(x: np.ndarray, kinds: int, rounds: int = 30) -> np.ndarray:
    """The group of each row, the largest first: k-means of rows brought to length 1, begun from rows that lie far apart."""
    if len(x) == 0:
        return np.zeros(0, np.int64)
    x = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    centres = [x.mean(axis=0)]
    for _ in range(kinds):
        centres.append(x[np.argmin(np.max(x @ np.stack(centres).T, axis=1))])
    centres = np.stack(centres[1:])
    for _ in range(rounds):
        group = np.argmax(x @ centres.T, axis=1)
        centres = np.stack([x[group == k].mean(axis=0) if (group == k).any() else centres[k] for k in range(kinds)])
        centres /= np.maximum(1e-12, np.linalg.norm(centres, axis=1, keepdims=True))
    group = np.argmax(x @ centres.T, axis=1)
    place = np.argsort(np.argsort(-np.bincount(group, minlength=kinds), kind="stable"))
    return place[group]


def chain_targets(x: np.ndarray, y: np.ndarray, kinds: int) -> np.ndarray:
    """A column for each kind of toxic rows, then the label."""
    group = np.full(len(y), -1)
    group[y > 0] = kinds_of(x[y > 0, :-1], kinds)
    return np.stack([*(1.0 * (group == k) for k in range(kinds)), y], axis=1)


def _score_rows(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    chosen, models, shares = model.value
    for batch in batches:
        x = np.array([counts_of(h, chosen) for h in _hashes(batch.column(1))]).reshape(batch.num_rows, len(chosen) + 1)
        p = chain_scores(x, models)
        p[x[:, -1] == 0] = shares  # no words
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(p[:, k]) for k in range(p.shape[1]))], names=["doc_id", *(f"p_{k}" for k in range(p.shape[1]))])


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labels: int = 20_000, features: int = 384, kinds: int = 3, min_rows: int = 5, threshold: float = 0.5) -> DataFrame:
    """(doc_id, p_kind_1 ..., p_toxic, toxic) for every row of docs; labels: (doc_id, toxic)."""
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(spark, "toxicity")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    usable = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    labelled = rows.join(F.broadcast(usable), "doc_id").select("doc_id", "text", F.xxhash64("text").alias("text_id"), "toxic")
    sample = store.save(labelled.mapInArrow(_sample_rows, "doc_id long, text_id long, toxic int, words array<long>, counts array<long>"), "labelled")
    # a doc_id may repeat: no more than max_labels different texts, each once
    kept = sample.select("doc_id", "text_id").distinct().orderBy(F.xxhash64("doc_id", "text_id"), "doc_id", "text_id").limit(max_labels)
    sample = store.save(sample.join(F.broadcast(kept), ["doc_id", "text_id"], "left_semi").dropDuplicates(["doc_id", "text_id"]).select("toxic", "words", "counts"), "sample")
    bad, all_rows = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    good = all_rows - bad
    count = sample.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).where(F.col("n") >= min_rows)
    odds = F.log((F.col("p") + 0.5) / (bad - F.col("p") + 0.5)) - F.log((F.col("n") - F.col("p") + 0.5) / (good - F.col("n") + F.col("p") + 0.5))
    tie = F.abs(odds) / F.sqrt(1 / (F.col("p") + 0.5) + 1 / (F.col("n") - F.col("p") + 0.5))
    chosen = np.sort(np.array([r["word"] for r in count.orderBy(tie.desc(), "word").limit(features).collect()], np.int64))
    words = spark.sparkContext.broadcast(chosen)
    found = sample.mapInArrow(partial(_chosen_rows, chosen=words), "toxic int, size long, at array<long>, n array<long>").toArrow()  # max_labels rows of the chosen words
    x, y = np.zeros((found.num_rows, len(chosen) + 1)), found.column("toxic").to_numpy().astype(np.float64)
    x[:, -1] = np.log1p(found.column("size").to_numpy())
    for k, (at, n) in enumerate(zip(found.column("at").to_pylist(), found.column("n").to_pylist())):
        x[k, at] = np.log1p(n)
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, np.int64)
    x, y = x[order], y[order]
    targets = chain_targets(x, y, kinds)
    model = spark.sparkContext.broadcast((chosen, fit_chain(x, targets), targets.mean(axis=0) if len(y) else np.zeros(kinds + 1)))
    names = [*(f"p_kind_{k}" for k in range(1, kinds + 1)), "p_toxic"]
    scored = rows.mapInArrow(partial(_score_rows, model=model), "doc_id long, " + ", ".join(f"p_{k} double" for k in range(kinds + 1))).toDF("doc_id", *names)
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
