"""Best-fit packing of token sequences, by hierarchical residual packing.

Documents become token ids, then pieces of at most `capacity` ids.  Every task
packs its pieces best-fit decreasing, emits full and nearly full sequences, and
hands its underfull ones on as items; each round deals those to fewer tasks, bounded
in items and pieces, until one task is left, or until a round merges less than one item
in a hundred: tasks hold random items, so a further round would find as little.  A
sequence carries its pieces along (no more than `capacity`), so no round joins anything back.

Defined cases: a null text is empty, and an empty document is the single id 0;
texts of any length are cut; of items of one size (ties) the smaller (doc_id, piece)
is packed first; rows that repeat a doc_id are packed each; a null
doc_id is packed as such; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store, small_batches

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, offset long"
_PIECE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


@lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Text -> the ids that the tokenizers library gives for `vocabulary`.json, add_special_tokens=False.

    The rank file of that name holds the same vocabulary and gives the same ids several
    times faster; the strings of added tokens get the json's ids.  A text that its
    pattern cannot split (over some 100,000 blanks in a row) goes to tokenizers itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(public_tokenizers.path(vocabulary + ".json"))
    added = {token.content: number for number, token in slow.get_added_tokens_decoder().items()}
    with open(public_tokenizers.path(vocabulary + ".tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)

    def encode(text: str) -> list[int]:
        try:
            return fast.encode(text, allowed_special="all")
        except ValueError:
            return slow.encode(text, add_special_tokens=False).ids

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole ones, after a shorter first one if need be."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _piece_rows(batches: Iterator[pa.RecordBatch], vocabulary: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(vocabulary)
    for batch in batches:
        found = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.array([*encode(text.as_py() or ""), 0], dtype="<u4")
            for k, (at, n) in enumerate(cut(len(ids), capacity)):
                found.append((doc_id, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
        columns = list(zip(*found)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, in the order given: the fullest open bin that it fits, or a new one."""
    bins, count = np.empty(len(sizes), np.int64), 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    levels = 0  # bit r: some bin has r left
    for k, size in enumerate(sizes.tolist()):
        fits = levels >> size
        if fits:
            left = size + (fits & -fits).bit_length() - 1
            b = open_bins[left].pop()
            if not open_bins[left]:
                levels &= ~(1 << left)
        else:
            b, left, count = count, capacity, count + 1
        bins[k] = b
        left -= size
        if left:
            open_bins[left].append(b)
            levels |= 1 << left
    return bins


def _packed_rows(batches: Iterator[pa.RecordBatch], capacity: int, enough: int, last: int) -> Iterator[pa.RecordBatch]:
    """Items (fill, pieces) of one task, packed; `done` sequences are final.  last: number of the round."""
    found = [b for b in batches if b.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    table = table.combine_chunks()
    fill = table.column("fill").to_numpy().astype(np.int64)
    pieces = table.column("pieces").combine_chunks()
    pieces = pieces.chunk(0) if isinstance(pieces, pa.ChunkedArray) else pieces
    flat, lengths = pieces.flatten(), np.diff(pieces.offsets.to_numpy())
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    ids, numbers = flat.field("doc_id").fill_null(-1).to_numpy(), flat.field("piece").to_numpy()
    order = np.lexsort([numbers[starts], ids[starts], -fill])
    bins = best_fit(fill[order], capacity)
    order = order[np.argsort(bins, kind="stable")]
    bins = np.sort(bins, kind="stable")
    first = np.concatenate([[0], np.flatnonzero(np.diff(bins)) + 1])
    base = np.cumsum(fill[order]) - fill[order]
    base -= np.repeat(base[first], np.diff(np.append(first, len(bins))))
    take = np.repeat(starts[order] - (np.cumsum(lengths[order]) - lengths[order]), lengths[order]) + np.arange(lengths.sum())
    flat = flat.take(pa.array(take))
    offset = flat.field("offset").to_numpy() + np.repeat(base, lengths[order])
    flat = pa.StructArray.from_arrays([*(flat.field(f.name) for f in _PIECE if f.name != "offset"), pa.array(offset)], fields=list(_PIECE))
    total = np.add.reduceat(fill[order], first)
    count = np.add.reduceat(lengths[order], first)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), flat)
    number = (np.int64(last) << np.int64(52)) + (np.int64(TaskContext.get().partitionId()) << np.int64(28)) + np.arange(len(total))
    out = pa.RecordBatch.from_arrays([pa.array(total), lists, pa.array(total >= enough), pa.array(number)], names=["fill", "pieces", "done", "sequence_id"])
    for at in range(0, out.num_rows, 10_000):
        yield out.slice(at, 10_000)


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", capacity: int = 2048, slack: int = 8, items_per_task: int = 200_000, pieces_per_task: int = 1_000_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    A document's ids end with id 0.  Sequences with at most `slack` free places
    are final in the round that fills them.  A task holds about items_per_task items
    and pieces_per_task pieces, whatever the number of pieces that an item has gathered.
    """
    spark = docs.sparkSession
    small_batches(spark)
    store = Store(spark, "packing")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = rows.mapInArrow(partial(_piece_rows, vocabulary=vocabulary, capacity=capacity), PIECE.rpartition(",")[0])
    pieces = store.save(pieces.withColumn("offset", F.lit(0).cast("long")), "pieces")
    item = pieces.select(F.col("length").alias("fill"), F.array(F.struct(*pieces.columns)).alias("pieces"))
    done, k, before = [], 0, None
    while True:
        waiting, parts = item.agg(F.count("*"), F.coalesce(F.sum(F.size("pieces")), F.lit(0))).first()
        tasks = max(1, -(-waiting // items_per_task), -(-parts // pieces_per_task))
        key = F.xxhash64("pieces", F.lit(k))
        result = item.repartition(tasks, key).mapInArrow(partial(_packed_rows, capacity=capacity, enough=capacity - slack, last=k), f"fill long, pieces array<struct<{PIECE.replace(' ', ':')}>>, done boolean, sequence_id long".replace(",:", ","))
        result = store.save(result, f"round-{k}")
        item = result.where("not done").select("fill", "pieces")
        stuck = before is not None and waiting > 0.99 * before
        if tasks == 1 or stuck:
            done.append(result)
            break
        done.append(result.where("done"))
        k, before = k + 1, waiting
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    p = F.col("p")
    return out.select("sequence_id", F.explode("pieces").alias("p")).select(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["start"].alias("start"), p["length"].alias("length"), p["ids_crc32"].alias("ids_crc32"), "sequence_id", p["offset"].alias("offset"))
