"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Method: every document is a set of five-word shingles.  A fast similarity sketch
fills all T coordinates in rounds: in round i < T each shingle goes to one
hashed bin with a value whose leading part is i, and in round T + b every shingle
competes for bin b, so each coordinate fills for sure while a large set needs one
round only.  Bands of R coordinates give bucket keys.  Within a bucket, sketches
are compared inside the task; only links that join two groups leave it.  The
groups are then verified on the full shingle sets.

Defined cases: a null or wordless text has an empty set and is linked with
nothing; fewer than five words count as one shingle; rows that repeat a doc_id
are one document, linked through each of its texts; a null doc_id is linked with
nothing and kept; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .kernels import mix64, seeds, shingle_set, words_by_text
from .store import Store, small_batches

T, R = 128, 4  # coordinates; rows a band: 32 bands miss a pair of similarity 0.75 with probability 5e-6
_U64 = np.uint64
_ROUND, _TAIL = seeds(T, 11), seeds(T, 12)
_BAND = seeds(R, 13)
_LOW56 = _U64((1 << 56) - 1)


def sketch(items: np.ndarray) -> np.ndarray:
    """T coordinates (uint64) of a non-empty set of 64-bit hashes."""
    out = np.full(T, ~_U64(0))
    done = 0
    while done < T and (out == ~_U64(0)).any():
        block = min(T - done, max(1, -(-8 * T // len(items))))
        z = mix64(items[None, :] ^ _ROUND[done : done + block, None])
        value = (np.arange(done, done + block, dtype=_U64)[:, None] << _U64(56)) | (z & _LOW56)
        np.minimum.at(out, (z >> _U64(57)).astype(np.int64).ravel(), value.ravel())
        done += block
    empty = np.flatnonzero(out == ~_U64(0))
    for b in empty:  # the second half of the rounds: all items compete for bin b
        out[b] = (mix64(items ^ _TAIL[b]) & _LOW56).min() | (_U64(T) << _U64(56))
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    rows = mix64(coordinates).reshape(-1, R)
    return mix64((rows * _BAND).sum(axis=1, dtype=_U64) ^ seeds(len(rows), 14))


_SKETCHED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def _sketch_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, keys1, keys2, bands, bytes_ = [], [], [], [], []
        for _, hashes, _, _ in words_by_text(batch.column(1)):
            items = shingle_set(hashes, words)
            sizes.append(len(items))
            if len(items) == 0:
                keys1.append(0), keys2.append(0), bands.append(None), bytes_.append(None)
                continue
            k1, k2 = np.frombuffer(hashlib.blake2b(items.tobytes(), digest_size=16).digest(), np.int64)
            coordinates = sketch(items)
            keys1.append(int(k1)), keys2.append(int(k2))
            bands.append(band_keys(coordinates).view(np.int64))
            bytes_.append((mix64(coordinates) & _U64(255)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], schema=_SKETCHED)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew so that no group (columns g1, i, j) spans two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
        change = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        first = tuple(key[:, 0])
        if held and first != last:
            yield _joined(held)
            held = []
        last = tuple(key[:, -1])
        if len(change):
            yield _joined([*held, batch.slice(0, int(change[-1]))])
            held = [batch.slice(int(change[-1]))]
        else:
            held.append(batch)
    if held:
        yield _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _spans(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(3)])
    starts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1])
    return starts, np.append(starts[1:], batch.num_rows)


def _forest(n: int, similar, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join 0..n-1 as all similar pairs do; similar(i) gives i's similar later ones; label: equal for those joined already."""
    label, links = np.arange(n) if label is None else label.copy(), []
    for i in range(n - 1):
        near = similar(i)
        near = near[label[near] != label[i]]
        if len(near) == 0:
            continue
        others, at = np.unique(label[near], return_index=True)
        links += [(i, int(near[k])) for k in at]
        label[np.isin(label, others)] = label[i]
    return links


_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _edge_batch(a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], schema=_EDGES)


def _sketches(column: pa.Array) -> np.ndarray:
    offsets, raw = column.cast(pa.binary()).buffers()[1:]
    at = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(raw, np.uint8)[at : at + T * len(column)].reshape(-1, T)


def _bucket_links(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links between nodes of one bucket block whose sketches agree in `least` coordinates."""
    for batch in _groups(batches):
        node, rows = batch.column(3).to_numpy(zero_copy_only=False), _sketches(batch.column(4))
        starts, ends = _spans(batch)
        a, b = [], []
        small = ends - starts <= 8
        group = np.repeat(np.where(small, np.arange(len(starts)), -1), ends - starts)
        for lag in range(1, 8):
            i = np.flatnonzero((group[:-lag] == group[lag:]) & (group[lag:] >= 0))
            for at in range(0, len(i), 65536):
                part = i[at : at + 65536]
                part = part[(rows[part] == rows[part + lag]).sum(axis=1) >= least]
                a.extend(node[part]), b.extend(node[part + lag])
        for s, e in zip(starts[~small], ends[~small]):
            own = rows[s:e]
            for i, j in _forest(e - s, lambda i: np.flatnonzero((own[i + 1 :] == own[i]).sum(axis=1) >= least) + i + 1):
                a.append(node[s + i]), b.append(node[s + j])
        yield _edge_batch(a, b)


def _rest_links(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Links as in _bucket_links, between nodes of two blocks that are not in one group (column 5) yet."""
    for batch in _groups(batches):
        node, rows, root = batch.column(3).to_numpy(zero_copy_only=False), _sketches(batch.column(4)), batch.column(5).to_numpy(zero_copy_only=False)
        a, b = [], []
        for s, e in zip(*_spans(batch)):
            order = s + np.argsort(root[s:e], kind="stable")
            own, label = rows[order], root[order]
            other = np.searchsorted(label, label, side="right")  # where the next group starts
            for i, j in _forest(e - s, lambda i: np.flatnonzero((own[other[i] :] == own[i]).sum(axis=1) >= least) + other[i], label):
                a.append(node[order[i]]), b.append(node[order[j]])
        yield _edge_batch(a, b)


def _verified_links(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Links between documents of one block whose full sets reach the similarity."""
    for batch in _groups(batches):
        node = batch.column(3).to_numpy(zero_copy_only=False)
        a, b = [], []
        starts, ends = _spans(batch)
        for s, e in zip(starts, ends):
            sets = [shingle_set(h, words) for _, h, _, _ in words_by_text(batch.column(4).slice(int(s), int(e - s)))]
            sizes = np.array([len(x) for x in sets])
            if e - s == 2:
                both = len(np.intersect1d(*sets, assume_unique=True))
                pairs = [(0, 1)] if 100 * both >= percent * (sizes.sum() - both) and both else []
            else:
                items, item = np.unique(np.concatenate(sets), return_inverse=True)
                count = np.bincount(item, minlength=len(items))
                shared = np.cumsum(count > 1) - 1
                width = -(-(int(shared[-1]) + 1) // 8) if len(items) else 0
                bits, at = np.zeros((e - s, max(1, width)), np.uint8), 0
                for k, size in enumerate(sizes):
                    own = item[at : at + size]
                    own = shared[own[count[own] > 1]]
                    np.bitwise_or.at(bits[k], own >> 3, (1 << (own & 7)).astype(np.uint8))
                    at += size

                def similar(i: int, bits=bits, sizes=sizes) -> np.ndarray:
                    both = np.bitwise_count(bits[i + 1 :] & bits[i]).sum(axis=1, dtype=np.int64)
                    return np.flatnonzero((100 * both >= percent * (sizes[i + 1 :] + sizes[i] - both)) & (both > 0)) + i + 1

                pairs = _forest(int(e - s), similar)
            a += [node[s + i] for i, _ in pairs]
            b += [node[s + j] for _, j in pairs]
        yield _edge_batch(a, b)


def _blocked(rows: DataFrame, group: str, blocks: str, node: str, payload: str, others=lambda every: every, more: tuple[str, ...] = ()) -> DataFrame:
    """Rows (g, i, j, node, payload, *more): a group of several blocks is dealt out as pairs of blocks; others: which of `every` one a block (own) meets."""
    other = others(F.sequence(F.lit(0).cast("long"), F.col(blocks).cast("long") - 1))
    pairs = F.transform(other, lambda k: F.struct(F.least("own", k).alias("i"), F.greatest("own", k).alias("j")))
    return (
        # a node's block is another one in each group
        rows.withColumn("own", F.pmod(F.xxhash64(node, group), F.col(blocks)).cast("long"))
        .select(group, node, payload, *more, F.explode(pairs).alias("p"))
        .select(F.col(group).alias("g"), "p.i", "p.j", F.col(node).alias("node"), F.col(payload).alias("payload"), *more)
        .repartition(F.col("g"), F.col("i"), F.col("j"))
        .sortWithinPartitions("g", "i", "j", "node")
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 75, sketch_percent: int = 55, block: int = 1024, hot_bucket: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs.

    Documents whose sets reach 100 * intersection >= percent * union are linked;
    component_id is the smallest doc_id reachable.  sketch_percent is the share
    of agreeing coordinates below which a pair is not looked at further: five
    standard deviations under the similarity.  Buckets are compared
    in blocks: up to hot_bucket different sets, all pairs of blocks at once; above,
    each block with itself first, and then only what that left in separate groups
    between the blocks.  Either way all pairs of a bucket are compared or in one group
    already, so hot_bucket changes the work and not the result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(spark, "near-dedup")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sketched = store.save(rows.mapInArrow(partial(_sketch_rows, words=words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"), "sketched")
    linkable = sketched.where("n_shingles > 0 and doc_id is not null")
    # documents with equal sets are one node, named by its smallest doc_id
    first = store.save(linkable.groupBy("k1", "k2").agg(F.min("doc_id").alias("first_id")), "first")
    node = linkable.join(first, (F.col("doc_id") == F.col("first_id")) & (linkable.k1 == first.k1) & (linkable.k2 == first.k2), "left_semi")
    node = store.save(node.dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "n_shingles", "bands", "sketch"), "nodes")

    member = node.select(F.explode("bands").alias("g"), F.col("doc_id").alias("node"))
    size = member.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    shared = store.save(member.join(size, "g"), "shared")
    sketch_of = node.select(F.col("doc_id").alias("node"), "sketch")
    bucket = shared.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    least = T * sketch_percent // 100
    hot = F.col("n") > hot_bucket
    alike = _blocked(bucket.join(sketch_of, "node"), "g", "blocks", "node", "sketch", lambda every: F.when(hot, F.array("own")).otherwise(every))
    group = components(alike.mapInArrow(partial(_bucket_links, least=least), "a long, b long"), store, "alike")
    wide = bucket.where(hot).join(group, "node", "left").select("g", "blocks", "node", F.coalesce("root", "node").alias("root"))
    apart = wide.groupBy("g").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("g")
    rest = _blocked(wide.join(apart, "g").join(sketch_of, "node"), "g", "blocks", "node", "sketch", lambda every: F.filter(every, lambda k: k != F.col("own")), ("root",))
    rest = store.save(rest.mapInArrow(partial(_rest_links, least=least), "a long, b long"), "rest")
    if not rest.isEmpty():
        group = components(rest.union(group.select("node", "root")), store, "joined")

    # the groups, with their texts, in blocks bounded in documents and in shingles
    weight = group.join(node.select(F.col("doc_id").alias("node"), "n_shingles"), "node").groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    blocks = F.greatest(F.ceil(F.col("n") / (block // 2)), F.ceil(F.col("w") / (1 << 22))).cast("int")
    placed = store.save(group.join(weight.select("root", blocks.alias("blocks")), "root"), "placed")
    texts = rows.join(placed, rows.doc_id == placed.node).select("root", "blocks", "node", "text")
    links = _blocked(texts, "root", "blocks", "node", "text").mapInArrow(partial(_verified_links, words=words, percent=percent), "a long, b long")
    linked = components(links, store, "linked")

    found = sketched.join(first, ["k1", "k2"], "left").join(linked.withColumnRenamed("node", "first_id"), "first_id", "left")
    component = F.coalesce("root", F.when(F.col("n_shingles") > 0, F.col("first_id")), "doc_id")
    return found.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without the rows that near_duplicates does not keep; its columns unchanged."""
    gone = near_duplicates(docs, id_col=id_col, **options).where(~F.col("kept")).select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)
