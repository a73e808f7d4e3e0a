"""Byte-level BPE in both directions: texts to ids by merge replay over the words of many texts, ids to bytes by lookup.

A task gathers the texts of its partition, some 16 million bytes at a time.  Their
distinct words (matches of the vocabulary's pattern) stand in one array of tokens, at
first single bytes.  An index leads from each mergeable pair to the positions where it
stands; pairs that make the same token share an entry.  Merges are replayed in rank
order over all words at once: the positions of the lowest rank are merged, and only the
pairs with their neighbours are looked up anew and go back to the index, which may put a
lower rank first again.  Texts then take the ids of their words by number.

The order of merges within a word is that of the single word: lowest rank first, of one
rank the leftmost.  A merge that makes a pair of a lower rank while its word has more
merges of the same rank breaks that order; such a word is merged alone.

Defined cases: a null text is empty; an empty text has no ids and no bytes; texts and
words may have any length (a longer text than the share is a share of its own); equal
texts (ties) have equal ids, and rows that repeat are encoded each; a null id stays null;
an empty table gives an empty result; other columns are passed over, so names cannot
clash; bytes of a text that are no UTF-8 count as U+FFFD.  In ids, null arrays and null
ids count as nothing; an id outside the vocabulary is an error.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache, partial
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import small_batches

NONE = np.int32(2**31 - 1)


class Vocabulary:
    """Tokens by rank, which is their id, and the pattern that splits texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.merge = {(ranks[t[:k]], ranks[t[k:]]): rank for t, rank in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        keys = np.array([a << 32 | b for a, b in self.merge] or [0], np.int64)
        order = np.argsort(keys)
        self._keys, self._made = keys[order], np.array(list(self.merge.values()) or [NONE], np.int32)[order]

    def made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of what each pair makes; NONE if it makes no token."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], NONE)

    def alone(self, word: bytes) -> list[int]:
        """The ids of one word, its merges one by one."""
        tok = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(tok)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank, k, k + 1) for k in range(n - 1) if (rank := self.merge.get((tok[k], tok[k + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, k, j = heappop(heap)
            if tok[k] < 0 or after[k] != j or j >= n or self.merge.get((tok[k], tok[j])) != rank:
                continue
            tok[k], tok[j], after[k] = rank, -1, after[j]
            if after[k] < n:
                before[after[k]] = k
                if (new := self.merge.get((rank, tok[after[k]]))) is not None:
                    heappush(heap, (new, k, after[k]))
            if before[k] >= 0 and (new := self.merge.get((tok[before[k]], rank))) is not None:
                heappush(heap, (new, before[k], k))
        return [t for t in tok if t >= 0]

    def replayed(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, how many each word has) of non-empty words."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        n, first = len(raw), np.cumsum(size) - size
        if n == 0:
            return np.zeros(0, np.int32), size
        word = np.repeat(np.arange(len(words), dtype=np.int32), size)
        # position n stands for no neighbour; its token is in no pair
        tok = np.append(self.single[raw], NONE)
        nxt, prv = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
        nxt[first + size - 1], prv[first] = n, n
        alive = np.ones(n + 1, bool)
        made = np.full(n + 1, NONE, np.int32)
        table = self.made(np.repeat(self.single, 256), np.tile(self.single, 256))
        made[: n - 1] = table[raw[:-1].astype(np.int32) * 256 + raw[1:]]
        made[first + size - 1] = NONE

        def grouped(ranks: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
            order = np.argsort(ranks, kind="stable")
            ranks, at = ranks[order], at[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for a, b in zip(cuts, cuts[1:]):
                yield int(ranks[a]), at[a:b]

        there = np.flatnonzero(made[:n] < NONE).astype(np.int32)
        index: dict[int, list[np.ndarray]] = {rank: [at] for rank, at in grouped(made[there], there)} if len(there) else {}
        waiting, hard = sorted(index), set()
        while waiting:
            rank = heappop(waiting)
            parts = index.pop(rank)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            at = at[made[at] == rank]
            if len(at) > 1:
                linked = nxt[at[:-1]] == at[1:]
                if linked.any():  # of a run of overlapping pairs every other one, from the left
                    k = np.arange(len(at))
                    at = at[(k - np.maximum.accumulate(np.where(np.append(False, linked), 0, k))) % 2 == 0]
            elif not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            between = after[:-1][after[:-1] == at[1:]]
            if len(between):  # merged next to each other: a pair that stands only between the two merges
                hard.update(word[between[self.made(np.full(len(between), rank), tok[between]) < rank]].tolist())
            tok[at], nxt[at], prv[after] = rank, after, at
            alive[gone], made[gone] = False, NONE
            before = prv[at]
            touched = np.concatenate([before, at])
            new = self.made(np.concatenate([tok[before], tok[at]]), np.concatenate([tok[at], tok[after]]))
            made[touched] = new
            pairs = new < NONE
            if not pairs.any():
                continue
            touched, new = touched[pairs], new[pairs]
            if len(at) > 1 and new.min() < rank:
                own = word[at]
                hard.update(set(own[1:][own[1:] == own[:-1]].tolist()) & set(word[touched[new < rank]].tolist()))
            for r, where in grouped(new, touched) if len(new) > 1 else [(int(new[0]), touched)]:
                if r in index:
                    index[r].append(where)
                else:
                    index[r] = [where]
                    heappush(waiting, r)
        alive = alive[:n]
        ids, counts = tok[:n][alive], np.add.reduceat(alive, first, dtype=np.int64)
        if hard:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in hard:
                parts[k] = np.array(self.alone(words[k]), np.int32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        return ids, counts

    def encoded(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, how many each text has)."""
        number: defaultdict[str, int] = defaultdict(count().__next__)
        found = []
        for text in texts:
            words = self.split(text)
            found.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
        words = [w.encode() for w in number]
        # a word that is a token is that token, whatever merges would make of it
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int32)
        other = np.flatnonzero(whole < 0)
        ids, counts = self.replayed([words[k] for k in other.tolist()])
        flat = np.concatenate([ids, whole[whole >= 0]])
        size = np.ones(len(words), np.int64)
        size[other] = counts
        start = np.empty(len(words), np.int64)
        start[other] = np.cumsum(counts) - counts
        start[whole >= 0] = len(ids) + np.arange(len(words) - len(other))
        lengths = np.array([size[f].sum() for f in found], np.int64)
        out, at = np.empty(lengths.sum(), np.int32), 0
        for f, n in zip(found, lengths.tolist()):
            out[at : at + n] = flat[_spans(start[f], size[f])]
            at += n
        return out, lengths

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.tokens)):
            raise ValueError("an id is outside the vocabulary")
        return self.bytes[_spans(self.start[ids], self.length[ids])]


def _spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions of spans, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file; path: a file, or a name among the public tokenizers, whose pattern holds if none is given."""
    import public_tokenizers

    with open(path if os.path.exists(path) else public_tokenizers.path(path), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return Vocabulary(ranks, pattern or public_tokenizers.PATTERN)


def _encoded_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str | None, share: int) -> Iterator[pa.RecordBatch]:
    words = vocabulary(path, pattern)

    def flushed(keys: list, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        ids, counts = words.encoded(t.decode("utf-8", "replace") for t in texts)
        ends = np.cumsum(counts)
        for a in range(0, len(keys), 1000):
            b = min(len(keys), a + 1000)
            low = int(ends[a - 1]) if a else 0
            offsets = np.concatenate([[0], ends[a:b] - low]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[low : ends[b - 1]]))
            yield pa.RecordBatch.from_arrays([pa.array(keys[a:b], pa.int64()), lists], names=["doc_id", "ids"])

    keys, texts, held = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py() or b""
            keys.append(key)
            texts.append(text)
            held += len(text)
            if held >= share:
                yield from flushed(keys, texts)
                keys, texts, held = [], [], 0
    if keys:
        yield from flushed(keys, texts)


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = "byte_bpe_50k.tiktoken", pattern: str | None = None, share: int = 1 << 24) -> DataFrame:
    """(doc_id, ids) of every text, without special tokens.  share: bytes of text whose words are merged together in a task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(partial(_encoded_rows, path=path, pattern=pattern, share=share), "doc_id long, ids array<int>")


def _decoded_rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str | None) -> Iterator[pa.RecordBatch]:
    words = vocabulary(path, pattern)
    for batch in batches:
        lists = batch.column(1)
        out = []
        for row in lists:
            ids = row.values.drop_null().to_numpy() if row.is_valid else np.zeros(0, np.int32)
            out.append(words.decoded(ids).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(out, pa.binary())], names=["doc_id", "ids", "bytes"])


def decoded(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", path: str = "byte_bpe_50k.tiktoken", pattern: str | None = None) -> DataFrame:
    """(doc_id, ids, bytes) of every row of ids."""
    small_batches(rows.sparkSession)
    picked = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return picked.mapInArrow(partial(_decoded_rows, path=path, pattern=pattern), "doc_id long, ids array<int>, bytes binary")
