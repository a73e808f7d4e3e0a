"""Vectorised text kernels shared by the corpus operators.

All of them work on the UTF-8 bytes of an Arrow string column, so no Python
string is made per word.  Words are the maximal runs without U+0020 and
U+0009..U+000D; lower-casing touches A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18  # bytes hashed at once: bounds the temporary arrays

_U64 = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit words (xor-shift and multiply)."""
    x = np.asarray(x, dtype=_U64)
    x = (x ^ (x >> _U64(30))) * _U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U64(27))) * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def seeds(n: int, salt: int) -> np.ndarray:
    """n odd pseudo-random 64-bit constants."""
    base = np.arange(1, n + 1, dtype=_U64) * _U64(0x9E3779B97F4A7C15)
    return mix64(base + _U64(salt * 0x51ED2701 + 17)) | _U64(1)


_BYTE = seeds(256, 1)
_RAW = np.arange(256, dtype=np.uint8)
_LOWER = _RAW.copy()
_LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Byte classes; a word is a run of one class, class 0 stands between words.
WORDS = (~SPACE).astype(np.uint8)
#: Letters (with all non-ASCII), digits and symbols apart.
RUNS = np.full(256, 3, np.uint8)
RUNS[48:58] = 2
RUNS[65:91] = RUNS[97:123] = RUNS[128:] = 1
RUNS[SPACE] = 0
_BASE, _BASE_INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_WORD_LEN = seeds(1, 2)[0]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U64)
    out[0] = 1
    return np.multiply.accumulate(out)


_cache: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _cache or len(_cache["up"]) < n:
        size = max(n, CHUNK_BYTES + 1)
        _cache["up"], _cache["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _cache["up"], _cache["down"]


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; null texts count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _hash_piece(raw: np.ndarray, bounds: np.ndarray, lower: bool, classes: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of one piece; bounds: positions where a text begins."""
    n = len(raw)
    if n == 0:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, _U64), empty, empty
    kind = classes[raw]
    solid = kind != 0
    opens, shuts = solid.copy(), solid.copy()
    turn = kind[1:] != kind[:-1]
    opens[1:] &= turn
    shuts[:-1] &= turn
    bounds = bounds[(bounds > 0) & (bounds < n)]
    opens[bounds] = solid[bounds]
    shuts[bounds - 1] = solid[bounds - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(shuts) + 1
    up, down = _tables(n + 1)
    total = np.zeros(n + 1, _U64)
    np.cumsum(_BYTE[(_LOWER if lower else _RAW)[raw]] * up[:n], out=total[1:])
    last = np.minimum(ends, starts + prefix) if prefix else ends
    h = (total[last] - total[starts]) * down[starts]
    return mix64(h + (last - starts).astype(_U64) * _WORD_LEN + _U64(prefix)), starts, ends


def hashed_words(raw: np.ndarray, lower: bool = True, classes: np.ndarray = WORDS, prefix: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, byte starts and byte ends of the words of one text of any length; prefix: bytes of a word that count, 0 for all."""
    if len(raw) <= CHUNK_BYTES:
        return _hash_piece(raw, np.zeros(0, np.int64), lower, classes, prefix)
    out, at = [], 0
    while at < len(raw):
        to = min(len(raw), at + CHUNK_BYTES)
        while to < len(raw) and not SPACE[raw[to]]:  # a word is never cut
            gap = np.flatnonzero(SPACE[raw[to : to + CHUNK_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(len(raw), to + CHUNK_BYTES)
        h, s, e = _hash_piece(raw[at:to], np.zeros(0, np.int64), lower, classes, prefix)
        out.append((h, s + at, e + at))
        at = to
    return tuple(np.concatenate(x) for x in zip(*out))  # type: ignore[return-value]


def words_by_text(column, lower: bool = True, classes: np.ndarray = WORDS, prefix: int = 0) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, word hashes, byte starts, byte ends) of every text; starts count from the text."""
    raw, offsets = text_buffers(column)
    n, row = len(offsets) - 1, 0
    while row < n:
        to = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, side="right")) - 1
        if to <= row:  # one long text
            h, s, e = hashed_words(raw[offsets[row] : offsets[row + 1]], lower, classes, prefix)
            yield row, h, s, e
            row += 1
            continue
        to = min(to, n)
        base = offsets[row]
        h, s, e = _hash_piece(raw[base : offsets[to]], offsets[row:to] - base, lower, classes, prefix)
        cuts = np.searchsorted(s, offsets[row : to + 1] - base)
        for k in range(row, to):
            a, b = cuts[k - row], cuts[k - row + 1]
            at = offsets[k] - base
            yield k, h[a:b], s[a:b] - at, e[a:b] - at
        row = to


_SHINGLE = seeds(64, 3)


def ngrams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows in order; none if there are fewer words."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, _U64)
    total = words[:m] * _SHINGLE[0]
    for j in range(1, k):
        total = total + words[j : j + m] * _SHINGLE[j]
    return mix64(total)


def shingle_set(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Sorted distinct k-word shingles (k < 32); with fewer words, the whole sequence as one."""
    if len(words) == 0:
        return np.zeros(0, _U64)
    if len(words) < k:
        total = (words * _SHINGLE[: len(words)]).sum(dtype=_U64, keepdims=True)
        return mix64(total ^ _SHINGLE[k + len(words) : k + len(words) + 1])
    return np.unique(ngrams(words, k))
