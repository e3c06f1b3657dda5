"""Vectorised text kernels over Arrow buffers: lower-casing A-Z, word spans, word and shingle hashes.

Words are `[^\\x20\\x09-\\x0D]+`. All hashes are 64 bits wide and depend only on the bytes, so they agree
between processes and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed 64-bit constants."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(seed) * U64(1 << 32)) * U64(0x9E3779B97F4A7C15))


_BYTE = seeded(256, 1)
_BASE = int(seeded(1, 2)[0]) | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_POW: dict[str, np.ndarray] = {}
_CHUNK = 1 << 19


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= _CHUNK:
        if not _POW:
            for k, base in (("up", _BASE), ("down", _BASE_INV)):
                p = np.full(_CHUNK + 1, base, dtype=U64)
                p[0] = 1
                _POW[k] = np.multiply.accumulate(p)
        return _POW["up"], _POW["down"]
    out = []
    for base in (_BASE, _BASE_INV):
        p = np.full(n + 1, base, dtype=U64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def column_bytes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls count as empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = arr.cast(pa.large_binary())
    if arr.null_count:
        arr = arr.fill_null(b"")
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def doc_chunks(offsets: np.ndarray, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of documents with about `size` bytes; a longer document stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and how many words each document has."""
    n_docs = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_docs, np.int64)
    word = _IS_WORD[data]
    before = np.empty_like(word)
    before[0] = False
    before[1:] = word[:-1]
    inner = offsets[1:-1]
    before[inner[inner < len(data)]] = False
    after = np.empty_like(word)
    after[-1] = False
    after[:-1] = word[1:]
    after[inner[inner > 0] - 1] = False
    starts = np.flatnonzero(word & ~before)
    ends = np.flatnonzero(word & ~after) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, by differences of a running polynomial."""
    out = np.empty(len(starts), dtype=U64)
    i = 0
    while i < len(starts):
        j = int(np.searchsorted(ends, starts[i] + _CHUNK, side="right"))
        j = max(j, i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        up, down = _powers(hi - lo)
        run = np.empty(hi - lo + 1, dtype=U64)
        run[0] = 0
        np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo], out=run[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (run[e] - run[s]) * down[s] + (e - s).astype(U64) * U64(0x9E3779B97F4A7C15)
        i = j
    return mix64(out)


def shingle_sets(words: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each document its sorted distinct k-word shingle hashes; fewer words make one shingle, none an empty set."""
    mult = seeded(k, 7) | U64(1)
    if len(words) >= k:
        acc = np.zeros(len(words) - k + 1, dtype=U64)
        for j in range(k):
            acc += words[j : j + len(acc)] * mult[j]
        acc = mix64(acc)
    else:
        acc = np.zeros(0, dtype=U64)
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(acc[at : at + n - k + 1])
        elif n:
            yield mix64((words[at : at + n] * mult[:n]).sum(dtype=U64, keepdims=True) + np.full(1, n, dtype=U64) * U64(0xD1B54A32D192ED03))
        else:
            yield np.zeros(0, dtype=U64)
        at += n


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's signed long."""
    return x.view(np.int64)


def list_array(parts: list[np.ndarray]) -> pa.Array:
    """list<int64> of the parts."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, type=pa.int64()))
