"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

1.  The word n-grams of all benchmark items go into a Bloom filter of a fixed
    size.  Each document yields its stretches around n-grams in that filter, with
    as many words on both sides as a copy of the longest item can span.
2.  The corpus counts of those n-grams order each item's n-grams by rarity; its
    seeds are the rarest share of them (never none), by default all: an edited copy
    may keep only a common one.  Seeds join stretches to items.
3.  The item is aligned locally, word by word, with windows of the stretch around
    its seeds.  Windows overlap by all that a copy of the item can span, so each
    copy lies within one; the score is the best alignment as a share of a full match.

A copy without three unedited words in a row has no seed and is lost, although it may
align: every third word replaced scores just over half, a word inserted after every
second one up to three quarters.  Edits at random rarely do that (tests/llm/test_brute_force.py).

Defined cases: null and wordless texts match nothing; an item of fewer words than an
n-gram is its own single n-gram, so it is found as a whole text only: within another
one, one or two words prove nothing; items without words match nothing; rows
that repeat a doc_id are one document; a null doc_id is kept and not reported; an
empty table on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .kernels import mix64, ngrams, seeds, shingle_set, words_by_text
from .store import Store, small_batches

BITS = 1 << 23  # of the Bloom filter: one MB, whatever the benchmark's size
PROBES = seeds(4, 21)
MATCH, MISMATCH, GAP = 2, -1, -1


def _item_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, grams = [], []
        for _, h, _, _ in words_by_text(batch.column(1)):
            words.append(h.view(np.int64))
            grams.append((ngrams(h, n) if len(h) >= n else shingle_set(h, n)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.list_(pa.int64())), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "item_words", "grams"])


def _bloom_bits(grams: np.ndarray) -> np.ndarray:
    return (mix64(grams.astype(np.uint64)[:, None] * PROBES) % np.uint64(BITS)).astype(np.int64)


def _filter_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The set bytes of one task's part of the filter."""
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[_bloom_bits(batch.column(0).to_numpy(zero_copy_only=False)).ravel()] = True
    packed = np.packbits(bits)
    at = np.flatnonzero(packed)
    yield pa.RecordBatch.from_pydict({"at": pa.array(at, pa.int32()), "byte": pa.array(packed[at], pa.int32())})


def span(words, least_score: float):
    """The most words of a text in an alignment of so many item words that scores least_score of a full match.

    It matches no more than all item words, and each further word of the text costs at least one.
    """
    return words + MATCH * (1 - least_score) * words


def _stretch_rows(batches: Iterator[pa.RecordBatch], bloom, n: int, reach: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, start, words, at, grams): the words around hits that lie within `reach` words of each other."""
    bits = np.unpackbits(np.frombuffer(bloom.value, np.uint8)).view(bool)
    for batch in batches:
        ids, rows = batch.column(0), []
        for k, h, _, _ in words_by_text(batch.column(1)):
            if len(h) == 0:
                continue
            grams = ngrams(h, n) if len(h) >= n else shingle_set(h, n)
            hits = np.flatnonzero(bits[(mix64(grams * PROBES[0]) % np.uint64(BITS)).astype(np.int64)])
            hits = hits[bits[_bloom_bits(grams[hits])].all(axis=1)]
            for part in np.split(hits, np.flatnonzero(np.diff(hits) > reach) + 1) if len(hits) else []:
                a, b = max(0, int(part[0]) - reach), min(len(h), int(part[-1]) + n + reach)
                rows.append((ids[k].as_py(), a, h[a:b].view(np.int64), part - a, grams[part].view(np.int64)))
        columns = list(zip(*rows)) or [()] * 5
        types = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "start", "words", "at", "grams"])


def align(items: list[np.ndarray], texts: list[np.ndarray]) -> np.ndarray:
    """Best local alignment scores of item k with text k, all pairs at once."""
    if not items:
        return np.zeros(0, np.int64)
    rows, columns = max(map(len, items)), max(map(len, texts))
    x, y = np.zeros((len(items), rows), np.int64), np.ones((len(items), columns), np.int64)
    gone_x, gone_y = np.ones(x.shape, bool), np.ones(y.shape, bool)
    for k, (a, b) in enumerate(zip(items, texts)):
        x[k, : len(a)], y[k, : len(b)] = a, b
        gone_x[k, : len(a)], gone_y[k, : len(b)] = False, False
    last = np.zeros((len(items), columns + 1), np.int64)
    best = np.zeros(len(items), np.int64)
    ramp = np.arange(columns + 1) * -GAP
    for i in range(rows):
        step = np.where(x[:, i, None] == y, MATCH, MISMATCH)
        step[gone_x[:, i, None] | gone_y] = -(1 << 20)
        now = np.zeros_like(last)
        np.maximum(last[:, :-1] + step, last[:, 1:] + GAP, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        # gaps along the text: the best of earlier columns, less their distance
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        np.maximum(best, now.max(axis=1), out=best)
        last = now
    return best


def _scored_rows(batches: Iterator[pa.RecordBatch], size: int = 128, cells: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Scores of (doc_id, item_id, item_words, words), by pairs of like length, of about `cells` words in all."""
    for batch in batches:
        lengths = np.array([(len(x.values), len(y.values)) for x, y in zip(batch.column(2), batch.column(3))]).reshape(-1, 2)
        order = np.lexsort([lengths[:, 0], lengths[:, 1]])
        at = 0
        while at < len(order):
            widest = lengths[order[min(at + size, len(order)) - 1], 1]
            take = max(1, min(size, cells // max(1, widest)))
            part = batch.take(pa.array(order[at : at + take]))
            at += take
            items = [np.asarray(v.values) for v in part.column(2)]
            texts = [np.asarray(v.values) for v in part.column(3)]
            full = np.array([MATCH * len(x) for x in items])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(align(items, texts) / full)], names=["doc_id", "item_id", "score"])


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, seed_share: float = 1.0, least_score: float = 0.5, margin: int = 64) -> DataFrame:
    """(doc_id, item_id, score) of every document that holds a copy of an item, exact or edited.

    benchmark: (item_id, text).  seed_share: the share of an item's n-grams, the
    rarest first, that are its seeds; under 1 fewer pairs are aligned, and copies that
    keep common n-grams only are lost.  A pair counts from least_score of a full match on.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    items = store.save(items.mapInArrow(partial(_item_rows, n=n), "item_id long, item_words array<long>, grams array<long>").where("size(grams) > 0"), "items")
    gram = items.select("item_id", F.explode("grams").alias("gram")).distinct()
    part = gram.select("gram").repartition(F.pmod("gram", F.lit(16))).mapInArrow(_filter_rows, "at int, byte int").groupBy("at").agg(F.bit_or("byte").alias("byte"))
    bloom = np.zeros(BITS // 8, np.uint8)
    for at, byte in part.toLocalIterator():  # BITS / 8 rows at most
        bloom[at] = byte
    shared = spark.sparkContext.broadcast(bloom.tobytes())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    longest = items.agg(F.max(F.size("item_words"))).first()[0] or 0
    reach = max(margin, math.ceil(span(longest, least_score)))
    stretch = rows.mapInArrow(partial(_stretch_rows, bloom=shared, n=n, reach=reach), "doc_id long, start long, words array<long>, at array<long>, grams array<long>")
    stretch = store.save(stretch.withColumn("text_id", F.xxhash64("doc_id", "start", "words")), "stretches")
    hit = stretch.select("doc_id", "text_id", F.explode(F.arrays_zip("at", "grams")).alias("hit")).select("doc_id", "text_id", "hit.at", F.col("hit.grams").alias("gram"))
    seen = stretch.select(F.explode(F.array_distinct("grams")).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))
    by_item = Window.partitionBy("item_id")
    rank = gram.join(seen, "gram").withColumn("k", F.row_number().over(by_item.orderBy("df", "gram"))).withColumn("of", F.count("*").over(by_item))
    own_reach = items.select("item_id", F.greatest(F.lit(margin), F.ceil(span(F.size("item_words"), least_score))).cast("int").alias("reach")).distinct()
    seed = rank.where(F.col("k") <= F.ceil(F.col("of") * seed_share)).join(own_reach, "item_id").select("item_id", "gram", "reach")
    # seeds that lie within one tile of twice the reach have one window
    pair = hit.join(seed, "gram").groupBy("doc_id", "text_id", "item_id", "reach", F.floor(F.col("at") / (2 * F.col("reach"))).alias("tile")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    pair = pair.join(items.select("item_id", "item_words"), "item_id").join(stretch.select("doc_id", "text_id", "words").dropDuplicates(["doc_id", "text_id"]), ["doc_id", "text_id"])
    begin = F.greatest(F.lit(0), F.col("first") - F.col("reach")).cast("int")
    pair = pair.withColumn("words", F.slice("words", begin + 1, (F.col("last") + n + F.col("reach")).cast("int") - begin))
    scored = pair.select("doc_id", "item_id", "item_words", "words").mapInArrow(_scored_rows, "doc_id long, item_id long, score double")
    return scored.where(F.col("score") >= least_score).groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def clean_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the contaminated ones; its columns unchanged."""
    gone = contaminated(docs, benchmark, id_col=id_col, **options).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
