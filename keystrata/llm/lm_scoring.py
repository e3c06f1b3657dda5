"""Language-model scoring with an Elias-Fano n-gram trie.

Tokens are words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased, then one end per text. Passes over whole texts, each an
Arrow kernel:

1. Counts of all training tokens by 64-bit hash, summed by Spark; shards of the hash space become the first
   level: hashes as an Elias-Fano sequence, exact counts beside it. A word's id is its place.
2. For each higher order up to ORDER, all training n-grams as (context, successor), reduced per slice and dealt to
   shards by context; each shard merges its parts and writes its part of the level: contexts, monotone pointers
   to their successor ranges, successors (each range continues from the last value of the range before, so the
   whole is one monotone sequence), one quantised smoothed probability each and one quantised weight a context
   leaves to the next shorter one. A context is the place of an n-gram in the level before. A successor of two words or more is
   not stored as a word but relative to the shorter context: as its rank among the words that follow that one.
   A context with over a quarter of a shard's tokens is cut by successor over up to PIECES shards.
3. Scoring: each worker maps the levels into memory, reads only the pages it needs, and walks the orders
   upwards for the distinct n-grams of a slice: the context's node, its pointer range, the successor search in it.

Model: p(w | c) = max(n(cw) - D, 0) / n(c) + D * successors(c) / n(c) * p(w | c'), with absolute discount D, c' the context
without its first word, and the stated unigram base p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). An unseen context leaves
everything to the shorter one. Stored terms are rounded down, so the sum over words stays at most 1. Nothing
is pruned, and nothing is collected but numbers per shard. Level files go to the shared scratch folder under
temporary names, then are renamed.

Defined cases: null counts as empty (one end token); repeated rows are separate; a null identifier is not
held out; without training texts N = V = 0 and every token has probability 1; 2^32 - 2 distinct words or more are refused;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import kernels as K
from keystrata.llm.common import materialize, scratch_path, table
from keystrata.llm.elias_fano import EliasFano, encode, map_file, pack, write_file

ORDER, DISCOUNT = 3, 0.75
WORDS_A_SHARD, TOKENS_A_SHARD, PIECES = 1 << 21, 3_000_000, 64
SLICE, HELD = 4 << 20, 1_000_000
NONE = 0xFFFFFFFF  # a successor that no level holds
END = K.U64(0x3C6EF372FE94F82B)  # the end token's hash
LOG_FLOOR = -10.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, each followed by its end, and tokens per document."""
    low = K.lower_bytes(data)
    starts, ends, counts = K.word_spans(low, offsets)
    h = K.word_hashes(low, starts, ends)
    return np.insert(h, np.cumsum(counts), END), counts + 1


def slices(batches: Iterator[pa.RecordBatch], col: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = K.column_bytes(batch.column(col))
        for i, j in K.doc_chunks(offsets, SLICE):
            yield batch, i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and their summed counts, all at least 1: rows are counted, then what some count beyond 1 is added."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    more = np.flatnonzero(c > 1)
    extra, c = k[more], c[more] - 1
    k, n = np.unique(k, return_counts=True)
    np.add.at(n, np.searchsorted(k, extra), c)
    return k, n


def order_of(x: np.ndarray) -> np.ndarray:
    """The stable order of whole numbers from 0, sorted as plain words that hold a number and its place, if both fit."""
    bits = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + bits > 63:
        return np.argsort(x, kind="stable")
    key = (x << bits) | np.arange(len(x))
    key.sort()
    return key & ((1 << bits) - 1)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes, and which of them each is; by a hash table, as tokens repeat."""
    found = pa.array(h).dictionary_encode()
    u = np.asarray(found.dictionary)
    order = np.argsort(u)
    number = np.empty(len(u), np.int64)
    number[order] = np.arange(len(u))
    return u[order], number[np.asarray(found.indices)]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of numbers from 0 under 2^32 in rising order, as two arrays, and which of them each is."""
    bits, low = len(a).bit_length(), int(b.max(initial=0)).bit_length()
    if int(a.max(initial=0)).bit_length() + low + bits > 63:
        key, inverse = np.unique((a.astype(K.U64) << K.U64(32)) | b.astype(K.U64), return_inverse=True)
        return (key >> K.U64(32)).astype(np.int64), (key & K.U64(0xFFFFFFFF)).astype(np.int64), inverse
    key = (((a << low) | b) << bits) | np.arange(len(a))
    key.sort()
    order = key & ((1 << bits) - 1)
    key >>= bits
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    inverse = np.empty(len(key), np.int64)
    inverse[order] = np.cumsum(new) - 1
    key = key[new]
    return key >> low, key & ((1 << low) - 1), inverse


def token_counts(texts: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in texts (text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array(K.signed(k)), pa.array(c, pa.int64())], ["h", "c"])

        for _, _, _, data, offsets in slices(batches, 0):
            k, c = np.unique(tokens(data, offsets)[0], return_counts=True)
            keys.append(k)
            counts.append(c)
            held += len(k)
            if held > HELD:
                yield out()
                keys, counts, held = [], [], 0
        if keys:
            yield out()

    return texts.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


class Words:
    """The first level: hash -> id and exact count."""

    def __init__(self, meta: dict):
        self.bits, self.base, self.files = meta["bits"], np.array(meta["word_base"] or [0], dtype=np.int64), meta["word_files"]
        self.parts = [map_file(f) if f else None for f in self.files]
        self.seq = [EliasFano(p, "hash") if p else None for p in self.parts]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of sorted distinct hashes; -1 and 0 if unknown."""
        ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        shard = (h >> K.U64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h), np.int64)
        cut = np.searchsorted(shard, np.arange(len(self.files) + 1))
        rest = K.U64((1 << (64 - self.bits)) - 1)
        for s, seq in enumerate(self.seq):
            a, b = cut[s], cut[s + 1]
            if seq is None or a == b:
                continue
            at = seq.find(h[a:b] & rest)
            ok = at >= 0
            ids[a:b][ok] = at[ok] + self.base[s]
            counts[a:b][ok] = self.parts[s]["count"][at[ok]]
        return ids, counts


def shard_of(ctx: np.ndarray, word: np.ndarray, hot: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each n-gram: by context, and for hot contexts by successor too."""
    key = ctx.astype(K.U64) * K.U64(0x9E3779B97F4A7C15)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, ctx), len(hot) - 1)
        key = key + np.where(hot[at] == ctx, word % PIECES + 1, 0).astype(K.U64)
    return (K.mix64(key) % K.U64(shards)).astype(np.int64)


def word_level(counts: DataFrame, folder: str) -> dict:
    """Write the first level; returns its metadata."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    if distinct >= NONE - 1:
        raise ValueError("more distinct words than 32-bit ids")
    bits = max(0, -(-distinct // WORDS_A_SHARD) - 1).bit_length()

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        h = np.asarray(rows["h"].combine_chunks()).view(K.U64) & K.U64((1 << (64 - bits)) - 1)
        c = np.asarray(rows["c"].combine_chunks())
        order = np.argsort(h)
        c = c[order]
        path = f"{folder}/words-{shard:06d}"
        write_file(path, pack(encode(h[order], 1 << (64 - bits), "hash") | {"count": c.astype(np.uint32) if not len(c) or c.max() < 1 << 32 else c}))
        return pa.table({"shard": pa.array([shard], pa.int32()), "n": pa.array([len(h)], pa.int64()), "path": [path]})

    shard = F.shiftrightunsigned("h", 64 - bits).cast("int") if bits else F.lit(0)
    done = {r["shard"]: r for r in counts.withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, n long, path string").collect()}
    sizes = [done[s]["n"] if s in done else 0 for s in range(1 << bits)]
    return {"bits": bits, "tokens": int(total), "distinct": int(distinct), "word_base": [0, *np.cumsum(sizes)[:-1].tolist()], "word_files": [done[s]["path"] if s in done else None for s in range(1 << bits)]}


def _blob(ctx: np.ndarray, word: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted n-grams (context, successor, count), delta-coded and compressed."""
    first = np.ones(len(ctx), bool)
    first[1:] = ctx[1:] != ctx[:-1]
    at = np.flatnonzero(first)
    step = np.diff(word, prepend=0)
    step[at] = word[at]
    parts = [np.array([len(at), len(ctx)], dtype=np.int64), np.diff(ctx[at], prepend=0), np.diff(np.append(at, len(ctx))), step, count]
    wide = [parts[0]] + [p.astype(np.uint32) if not len(p) or p.max() < 1 << 32 else p for p in parts[1:]]
    raw = b"".join(bytes([p.itemsize]) + p.tobytes() for p in wide[1:])
    # bytes of equal weight together compress best
    return wide[0].tobytes() + zstandard.ZstdCompressor(level=1).compress(raw)


def _unblob(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n_ctx, n = np.frombuffer(blob[:16], dtype=np.int64).tolist()
    raw, at, parts = zstandard.ZstdDecompressor().decompress(blob[16:]), 0, []
    for size in (n_ctx, n_ctx, n, n):
        width = raw[at]
        parts.append(np.frombuffer(raw, dtype=f"<u{width}", count=size, offset=at + 1).astype(np.int64))
        at += 1 + width * size
    ctx, run, step, count = parts
    start = np.cumsum(run) - run
    whole = np.cumsum(step)
    base = np.repeat(whole[start] - step[start], run)
    return np.repeat(np.cumsum(ctx), run), whole - base, count


_models: dict[str, object] = {}


def _once(key: str, make):
    """One mapped model a process; a new one replaces the old."""
    if key not in _models:
        _models.clear()
        _models[key] = make()
    return _models[key]


def quantised(x: np.ndarray, kind: type) -> np.ndarray:
    """Logarithms of x, at most 1, rounded down to codes of an unsigned type."""
    steps = np.iinfo(kind).max
    return np.clip(np.floor((np.log10(np.maximum(x, 1e-12)) / -LOG_FLOOR + 1) * steps), 0, steps).astype(kind)


def powers(kind: type) -> np.ndarray:
    """What each code stands for."""
    steps = np.iinfo(kind).max
    return 10.0 ** (LOG_FLOOR + np.arange(steps + 1) / steps * -LOG_FLOOR)


_POWER, _WEIGHT = powers(np.uint8), powers(np.uint16)


class Level:
    """One order's successors of all contexts, shard by shard."""

    def __init__(self, meta: dict):
        self.hot, self.hot_left = np.array(meta["hot"], np.int64), np.array(meta["hot_left"])
        self.base, self.files = np.array(meta["base"], np.int64), meta["files"]

    def lookup(self, ctx: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(discounted share, weight left to the shorter context, place or -1, rank among the context's successors)."""
        share, left = np.zeros(len(ctx)), np.ones(len(ctx))
        place, rank = np.full(len(ctx), -1, np.int64), np.full(len(ctx), NONE, np.int64)
        shard = shard_of(ctx, word, self.hot, len(self.files))
        order = order_of(shard)
        cut = np.searchsorted(shard[order], np.arange(len(self.files) + 1))
        for s, file in enumerate(self.files):
            rows = order[cut[s] : cut[s + 1]]
            if file is None or not len(rows):
                continue
            part, node, ptr, succ = open_level(file)
            c = ctx[rows]
            new = np.ones(len(c), bool)
            new[1:] = c[1:] != c[:-1]
            nodes, inverse = c[new], np.cumsum(new) - 1
            at = node.find(nodes.astype(K.U64))
            ok = at >= 0
            begin, end, base, first = (np.zeros(len(nodes), np.int64) for _ in range(4))
            if ok.any():
                begin[ok], end[ok] = (x.astype(np.int64) for x in ptr.access_pairs(at[ok]))
            later = np.flatnonzero(ok & (begin > 0))
            base[later], first[later] = (x.astype(np.int64) for x in succ.access_pairs(begin[later] - 1))
            start = np.flatnonzero(ok & (begin == 0))
            first[start] = succ.access(begin[start])
            first -= base
            weight = np.ones(len(nodes))
            weight[ok] = _WEIGHT[part["left"][at[ok]]]
            left[rows] = weight[inverse]
            w, known = word[rows], word[rows] != NONE
            found = np.full(len(rows), -1, np.int64)
            one = np.flatnonzero(known & (w == first[inverse]) & (end > begin)[inverse])
            found[one] = begin[inverse[one]]  # the first of the range
            more = np.flatnonzero(known & (w > first[inverse]) & (end > begin + 1)[inverse])
            found[more] = succ.find((base[inverse[more]] + w[more]).astype(K.U64), begin[inverse[more]] + 1, end[inverse[more]])
            hit = np.flatnonzero(found >= 0)
            share[rows[hit]] = _POWER[part["code"][found[hit]]]
            place[rows[hit]] = found[hit] + self.base[s]
            rank[rows[hit]] = (found[hit] - begin[inverse[hit]]) * PIECES
        if len(self.hot):
            where = np.minimum(np.searchsorted(self.hot, ctx), len(self.hot) - 1)
            loud = self.hot[where] == ctx
            left[loud] = self.hot_left[where[loud]]
            # ranks of a cut context count within its piece
            rank = np.where(loud & (rank != NONE), rank + word % PIECES, rank)
        return share, left, place, rank


@lru_cache(maxsize=256)
def open_level(file: str) -> tuple[dict, EliasFano, EliasFano, EliasFano]:
    """A mapped shard of a level; the least recently used ones are let go."""
    part = map_file(file)
    return part, *(EliasFano(part, k) for k in ("node", "ptr", "succ"))


class Trie:
    """The mapped model, of as many levels as are built."""

    def __init__(self, meta: dict):
        self.meta, self.words, self.levels = meta, Words(meta), [Level(m) for m in meta["levels"]]

    def walk(self, h: np.ndarray, n: np.ndarray, more: bool = True) -> tuple[np.ndarray, list, tuple]:
        """Counts of tokens; per level (tokens with a context, their share, their weight); the n-grams of the order after the last level.

        The latter, if asked for with more, are distinct (context, successor, count), sorted. Of each order only distinct n-grams are looked up.
        """
        first = np.cumsum(n) - n
        u, inverse = distinct(h)
        ids, counts = self.words.find(u)
        counts, known = counts[inverse], ids >= 0
        gone = int(known.sum())  # the code of a successor that no level holds
        code = np.where(known, np.cumsum(known) - 1, gone)[inverse]
        ctx = np.empty_like(code)
        ctx[1:] = np.where(code < gone, code, -1)[:-1]
        ctx[first] = gone
        words = np.append(ids[known], NONE)  # what code stands for; places in a level rise with the hashes
        # the contexts that ctx numbers, in rising order: lookups then sweep through a level
        names = np.append(ids[known], self.meta["distinct"])  # the last is the place before a text
        steps = []
        for level in [*self.levels, None]:
            rows = np.flatnonzero(ctx >= 0)
            if level is None:
                rows = rows[code[rows] != gone]
                key, times = np.unique((ctx[rows] << 32) | code[rows], return_counts=True)
                c, w = names[key >> 32], key & NONE
                return counts, steps, (c, w if words is None else words[w], times)
            c, w, inverse = distinct_pairs(ctx[rows], code[rows])
            c, w = names[c], np.where(w == gone, NONE, w) if words is None else words[w]
            share, left, place, rank = level.lookup(c, w)
            steps.append((rows, share[inverse], left[inverse]))
            if not more and level is self.levels[-1]:
                return counts, steps, ()
            held = np.flatnonzero(place >= 0)
            by = held[order_of(place[held])]
            names, number = place[by], np.full(len(place), -1, np.int64)
            number[by] = np.arange(len(by))
            cell = np.full(len(ctx), -1, np.int64)
            cell[rows] = number[inverse]
            words, gone = None, int(rank[held].max(initial=-1)) + 1  # small numbers, so that pairs sort as plain words
            code = np.full(len(ctx), gone, np.int64)
            code[rows] = np.where(place >= 0, rank, gone)[inverse]
            ctx = np.empty_like(cell)
            ctx[1:] = cell[:-1]
            ctx[first] = -1  # nothing precedes the place before a text
        raise AssertionError

    def score(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per document: tokens, known tokens, base score, score."""
        h, n = tokens(data, offsets)
        counts, steps, _ = self.walk(h, n, False)
        base = (counts + 0.5) / (self.meta["tokens"] + 0.5 * (self.meta["distinct"] + 1))
        p = base.copy()
        for rows, share, left in steps:
            p[rows] = share + left * p[rows]
        at = np.cumsum(n) - n
        add = lambda x: np.add.reduceat(x, at)
        return n, add((counts > 0).astype(np.int64)), add(np.log10(base)), add(np.log10(p))


def add_level(texts: DataFrame, meta: dict, hot: dict[int, int], folder: str) -> tuple[dict, dict[int, int]]:
    """Write the next level; returns the grown metadata and the n-grams that are hot contexts of the level after.

    hot: contexts of this level with over a quarter of a shard's tokens, and how often each occurs.
    """
    order = len(meta["levels"]) + 2
    shards = max(1, -(-meta["tokens"] // TOKENS_A_SHARD))
    limit = max(1, meta["tokens"] // (4 * shards))
    names = np.array(sorted(hot), np.int64)
    totals = np.array([hot[v] for v in names.tolist()], np.int64)
    key = f"{meta['key']}#{order}"

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _once(key, lambda: Trie(meta))
        for _, _, _, data, offsets in slices(batches, 0):
            ctx, word, c = trie.walk(*tokens(data, offsets))[2]
            shard = shard_of(ctx, word, names, shards)
            by = order_of(shard)
            cut = np.searchsorted(shard[by], np.arange(shards + 1))
            rows = [(s, _blob(ctx[o], word[o], c[o])) for s in range(shards) if len(o := by[cut[s] : cut[s + 1]])]
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

    def build(group: tuple, rows: pa.Table) -> pa.Table:
        shard = group[0].as_py()
        parts = [_unblob(blob.as_py()) for blob in rows["blob"]]
        node = np.unique(np.concatenate([np.unique(p[0]) for p in parts]))
        k, c = summed([(np.searchsorted(node, p[0]).astype(K.U64) << K.U64(32)) | p[1].astype(K.U64) for p in parts], [p[2] for p in parts])
        del parts
        ctx, word = (k >> K.U64(32)).astype(np.int64), (k & K.U64(NONE)).astype(np.int64)
        at = np.searchsorted(ctx, np.arange(len(node)))
        size = np.diff(np.append(at, len(ctx)))
        total = np.add.reduceat(c, at)
        loud = np.isin(node, names)
        total[loud] = totals[np.searchsorted(names, node[loud])]
        last = word[np.append(at[1:], len(ctx)) - 1]
        base = np.cumsum(last) - last
        arrays = encode(node, int(node[-1]) + 1, "node") | encode(np.append(at, len(ctx)), len(ctx) + 1, "ptr") | encode(word + np.repeat(base, size), int(base[-1] + last[-1]) + 1, "succ")
        arrays |= {"code": quantised((c - DISCOUNT) / np.repeat(total, size), np.uint8), "left": quantised(DISCOUNT * size / total, np.uint16)}
        path = f"{folder}/grams{order}-{shard:06d}"
        write_file(path, pack(arrays))
        often = np.flatnonzero(c > limit)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (node[loud], size[loud], often, c[often])]
        return pa.table([pa.array([shard], pa.int32()), pa.array([path]), pa.array([len(k)], pa.int64()), *lists], ["shard", "path", "n", "ctx", "wide", "often", "times"])

    schema = "shard int, path string, n long, ctx array<long>, wide array<long>, often array<long>, times array<long>"
    done = texts.mapInArrow(emit, "shard int, blob binary").groupBy("shard").applyInArrow(build, schema).collect()  # a row a shard, with its hot contexts
    sizes, files, wide = [0] * shards, [None] * shards, dict.fromkeys(hot, 0)
    for r in done:
        sizes[r["shard"]], files[r["shard"]] = r["n"], r["path"]
        for v, n in zip(r["ctx"], r["wide"]):
            wide[v] += n
    base = np.cumsum(sizes) - sizes
    grown = {"hot": names.tolist(), "hot_left": [min(1.0, DISCOUNT * wide[v] / max(hot[v], 1)) if wide[v] else 1.0 for v in names.tolist()], "base": base.tolist(), "files": files}
    then = {int(base[r["shard"]] + i): n for r in done for i, n in zip(r["often"], r["times"])}
    return meta | {"levels": [*meta["levels"], grown]}, then


def fit(docs: DataFrame, id_col: str, text_col: str, trains: Column, order: int = ORDER) -> dict:
    """Build the trie of `order` words over the rows of docs where `trains` holds; returns its metadata."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "lm")
    texts = docs.filter(trains).select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialize(token_counts(texts), "token-counts")
    meta = word_level(counts, folder) | {"key": folder, "levels": []}
    if not meta["tokens"]:
        return meta
    shards = max(1, -(-meta["tokens"] // TOKENS_A_SHARD))
    loud = {r["h"]: r["c"] for r in counts.filter(F.col("c") > max(1, meta["tokens"] // (4 * shards))).collect()}  # under 4 * shards of them
    h = np.sort(np.array(list(loud), dtype=np.int64).view(K.U64))
    hot = {int(i): loud[int(x)] for i, x in zip(Words(meta).find(h)[0], K.signed(h))}
    end = counts.filter(F.col("h") == int(K.signed(np.array([END]))[0])).first()
    hot[meta["distinct"]] = int(end["c"])  # the place before a text: as many as there are ends
    for _ in range(order - 1):
        meta, hot = add_level(texts, meta, hot, folder)
    return meta


def scores(docs: DataFrame, meta: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, n_tokens, n_known, train_tokens, base_score, score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _once(meta["key"], lambda: Trie(meta))
        for batch, i, j, data, offsets in slices(batches, 1):
            n, known, base, score = trie.score(data, offsets)
            cols = [pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(j - i, meta["tokens"]), pa.int64()), pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *cols], [id_col, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = f"`{id_col}` long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scores(docs, fit(docs, "doc_id", "text", ~held_out("doc_id")))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
