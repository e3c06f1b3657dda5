"""Elias-Fano sequences over memory-mapped arrays, with vectorised access and search."""

from __future__ import annotations

import json
import mmap
import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np

U64 = np.uint64
_ALL, _ONES, _TOPS = (1 << 64) - 1, U64(0x0101010101010101), U64(0x8080808080808080)
# _SEL[b, r]: place of the r-th one of byte b
_SEL = np.zeros((256, 8), dtype=U64)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _SEL[_b, : len(_ones)] = _ones


def encode(values: np.ndarray, top: int, prefix: str) -> dict[str, np.ndarray]:
    """Arrays of a non-decreasing sequence of values under `top`."""
    n = len(values)
    low_bits = max(0, (max(top, 1) // max(n, 1)).bit_length() - 1)
    v = values.astype(U64)
    high = (v >> U64(low_bits)).astype(np.int64) if low_bits < 64 else np.zeros(n, np.int64)
    bits = n + (int(top) >> low_bits) + 2
    ones = high + np.arange(n)
    words = np.zeros(bits // 64 + 1, dtype=U64)
    np.add.at(words, ones >> 6, U64(1) << (ones & 63).astype(U64))  # every bit once
    rank = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(np.bitwise_count(words), out=rank[1:])
    low = v & U64((1 << low_bits) - 1)
    if low_bits > 56:
        packed = low
    else:
        packed = np.zeros(n * low_bits // 64 + 2, dtype=U64)
        for a in range(0, n if low_bits else 0, 1 << 16):  # 64 values fill low_bits whole words
            part = low[a : a + (1 << 16)]
            bit = np.arange(a, a + len(part)) * low_bits
            at, shift = bit >> 6, (bit & 63).astype(U64)
            # in every word some value begins, and at most one runs on into the next
            start = np.flatnonzero(np.diff(at, prepend=at[0] - 1))
            packed[at[0] : at[-1] + 1] |= np.bitwise_or.reduceat(part << shift, start)
            over = np.flatnonzero(shift > 64 - low_bits)
            packed[at[over] + 1] |= part[over] >> (U64(64) - shift[over])
        packed = packed.view(np.uint8)[: (n * low_bits + 7) // 8 + 8]
    return {f"{prefix}.head": np.array([n, low_bits], dtype=np.int64), f"{prefix}.high": words, f"{prefix}.rank": rank, f"{prefix}.low": packed}


class EliasFano:
    """Reader over the arrays of `encode`."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.low_bits = (int(x) for x in arrays[f"{prefix}.head"])
        self.high, self.rank, self.packed = arrays[f"{prefix}.high"], arrays[f"{prefix}.rank"], arrays[f"{prefix}.low"]
        self.zeros = np.arange(len(self.rank), dtype=np.int64) * 64 - self.rank
        if self.low_bits <= 56:
            self.window = np.lib.stride_tricks.as_strided(self.packed[:8].view(U64), shape=(len(self.packed) - 7,), strides=(1,))
        self.mask = U64((1 << self.low_bits) - 1)

    def low(self, i: np.ndarray) -> np.ndarray:
        if self.low_bits > 56:
            return np.asarray(self.packed[i])
        at = i * self.low_bits
        return (self.window[at >> 3] >> (at & 7).astype(U64)) & self.mask

    def _select(self, i: np.ndarray, counts: np.ndarray, flip: int, after: bool = False):
        """Places of the i-th ones, or zeros with flip: the word by its count, then the byte by prefix sums within the word.

        after: also the places of the ones that follow them.
        """
        word = np.searchsorted(counts, i, side="right") - 1
        left = (i - counts[word]).astype(U64)
        x = self.high[word] ^ U64(flip)
        s = x - ((x >> U64(1)) & U64(0x5555555555555555))
        s = (s & U64(0x3333333333333333)) + ((s >> U64(2)) & U64(0x3333333333333333))
        s = ((s + (s >> U64(4))) & U64(0x0F0F0F0F0F0F0F0F)) * _ONES
        byte = np.bitwise_count((((left * _ONES) | _TOPS) - s) & _TOPS).astype(U64)
        byte = np.minimum(byte, U64(7)) << U64(3)
        inner = left - (((s << U64(8)) >> byte) & U64(255))
        bit = byte + _SEL[((x >> byte) & U64(255)).astype(np.intp), np.minimum(inner, U64(7)).astype(np.intp)]
        place = word * 64 + bit.astype(np.int64)
        if not after:
            return place
        rest = x & ~((U64(2) << bit) - U64(1))
        then = word * 64 + np.bitwise_count((rest & (~rest + U64(1))) - U64(1)).astype(np.int64)
        far = np.flatnonzero(rest == 0)
        if len(far):
            then[far] = self._select(i[far] + 1, counts, flip)
        return place, then

    def _value(self, place: np.ndarray, i: np.ndarray) -> np.ndarray:
        return ((place - i).astype(U64) << U64(self.low_bits)) | self.low(i)

    def access(self, i: np.ndarray) -> np.ndarray:
        """Values at places i."""
        return self._value(self._select(i, self.rank, 0), i)

    def access_pairs(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values at places i and i + 1."""
        a, b = self._select(i, self.rank, 0, True)
        return self._value(a, i), self._value(b, i + 1)

    def find(self, x: np.ndarray, begin: np.ndarray | int = 0, end: np.ndarray | None = None) -> np.ndarray:
        """Place of each value x within [begin, end), or -1: the bucket by its high part, then the successor in it."""
        if not len(x) or not self.n:
            return np.full(len(x), -1, dtype=np.int64)
        h = (x >> U64(self.low_bits)).astype(np.int64) if self.low_bits < 64 else np.zeros(len(x), np.int64)
        most = int(self.zeros[-1]) - 1
        inside = h < most
        h = np.minimum(h, max(most - 1, 0))
        prev = np.maximum(h - 1, 0)
        a, b = self._select(prev, self.zeros, _ALL, True)  # the zeros around the bucket
        hi = np.where(h > 0, b - h, a)
        lo = np.where(h > 0, a - prev, 0)
        lo = np.maximum(lo, begin)
        hi = np.minimum(hi, self.n if end is None else end)
        out = np.full(len(x), -1, dtype=np.int64)
        at = np.flatnonzero(inside & (lo < hi))
        lo, hi, want = lo[at], hi[at] - 1, (x & self.mask)[at]
        while True:  # down to one place each, a value's first; those that are there leave
            wide = lo < hi
            if not wide.all():
                done = ~wide
                lone = lo[done]
                out[at[done]] = np.where(self.low(lone) == want[done], lone, -1)
                at, lo, hi, want = at[wide], lo[wide], hi[wide], want[wide]
            if not len(at):
                return out
            mid = (lo + hi) >> 1
            less = self.low(mid) < want
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)


def pack(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a length, a JSON directory, then the arrays on 64-byte borders."""
    names, at, parts = {}, 0, []
    for name, a in arrays.items():
        raw = np.ascontiguousarray(a).tobytes()
        names[name] = (at, a.dtype.str, len(a))
        parts.append(raw + b"\0" * (-len(raw) % 64))
        at += len(parts[-1])
    head = json.dumps(names).encode()
    head += b" " * (-(len(head) + 8) % 64)
    return len(head).to_bytes(8, "little") + head + b"".join(parts)


def _local(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def write_file(uri: str, data: bytes) -> None:
    """Write under a temporary name, then rename, so that a repeated attempt leaves one whole file."""
    temp = f"{uri}.tmp-{uuid.uuid4().hex}"
    if path := _local(temp):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)
            f.flush()
            os.fsync(f.fileno())
        os.replace(path, _local(uri))
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(temp)
    with store.open_output_stream(path) as f:
        f.write(data)
    store.move(path, fs.FileSystem.from_uri(uri)[1])


def map_file(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a packed file, memory-mapped; a remote one by way of an unlinked local copy."""
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, remote = fs.FileSystem.from_uri(uri)
        handle = tempfile.TemporaryFile()
        with store.open_input_stream(remote) as f:
            shutil.copyfileobj(f, handle)
        handle.flush()
    else:
        handle = open(path, "rb")  # noqa: SIM115
    with handle:
        data = np.frombuffer(mmap.mmap(handle.fileno(), 0, access=mmap.ACCESS_READ), dtype=np.uint8)
    head = int.from_bytes(data[:8].tobytes(), "little")
    names = json.loads(data[8 : 8 + head].tobytes())
    base = 8 + head
    return {k: data[base + at : base + at + n * np.dtype(kind).itemsize].view(kind) for k, (at, kind, n) in names.items()}
