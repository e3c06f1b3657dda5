"""Byte-level BPE encoding and decoding with Aho-Corasick longest matches and backtracking.

Token bytes are mapped to Latin-1 strings for the automaton. A piece is encoded from the left: take the
longest token at the position; it may follow the token before it only if BPE, run on the two tokens' bytes,
keeps exactly that pair (memoised per pair); else try the next shorter prefix token, or step back. Positions
from which no encoding was found are marked, so each is left at most once and the work is linear in the piece.
The sequence found is unique and equals the sequence of exact merges by rank.

Pieces come from the tokenizer's split pattern; frequent ones are kept in a bounded memo. Tokenizers are never
trained here: the rank file's place is a parameter.

Defined cases: null counts as empty, which has no tokens; bytes that aren't UTF-8 count as U+FFFD; texts of
any length are encoded in bounded slices; repeated rows are separate; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import table

MEMO_PIECES, MEMO_PAIRS, SLICE = 300_000, 500_000, 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a line for each token, base64 and rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merged(piece: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merges by rank, using only ranks under `below`; for building tables and for tests."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(a + b, below), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairEncoder:
    """Encoder and decoder for one rank table and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.split = ranks, regex.compile(pattern)
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.table = [self.bytes_of.get(i, b"") for i in range(max(ranks.values(), default=-1) + 1)]
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.shorter: dict[int, int | None] = {}
        self.automaton = ahocorasick.Automaton()
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = merged(token, ranks, rank)
                if len(parts) != 2:
                    continue  # merges never make it; only a piece equal to it is encoded so
                pair = (ranks[parts[0]], ranks[parts[1]])
                self.halves[rank], self.joined[pair] = pair, rank
            else:
                self.halves[rank] = (rank, rank)
            self.automaton.add_word(token.decode("latin-1"), (len(token) - 1, rank))
        for rank in self.halves:
            token = self.bytes_of[rank]
            self.shorter[rank] = next((r for n in range(len(token) - 1, 0, -1) if (r := ranks.get(token[:n])) in self.halves), None)
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.memo = _Memo(self)

    def pair_fits(self, left: int, right: int) -> bool:
        """Whether BPE on the two tokens' bytes gives just these two tokens."""
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= MEMO_PAIRS:
                self.fits.clear()
            known = self.fits[(left, right)] = self._pair_fits(left, right)
        return known

    def _pair_fits(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens' last merges, one after another; a merge across the border that
        # would have come before the undone ones shows that BPE doesn't keep the border.
        bound = 1 << 62
        while True:
            across = self.joined.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                bound = left
                left = self.halves[left][1]
                if left == bound:
                    bound = right + 1
                    right = self.halves[right][0]
                    if right + 1 == bound:
                        return True
            else:
                bound = right + 1
                right = self.halves[right][0]
                if right + 1 == bound:
                    bound = left
                    left = self.halves[left][1]
                    if left == bound:
                        return True

    def encode_piece(self, piece: bytes) -> list[int]:
        """The token ids of one piece of the split."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        longest = [0] * n
        for end, (before, rank) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - before] = rank  # ends only grow, so the last match from a start is its longest
        open_at, out, at = bytearray(b"\x01") * (n + 1), [], 0
        table, fits = self.table, self.fits
        token: int | None = longest[0]
        while at < n:
            while True:
                end = at + len(table[token])
                if open_at[end]:
                    fit = not out or fits.get((out[-1], token))
                    if fit is None:
                        fit = self.pair_fits(out[-1], token)
                    if fit:
                        out.append(token)
                        at = end
                        if at < n:
                            token = longest[at]
                        break
                token = self.shorter[token]
                if token is None:
                    open_at[at] = 0
                    token = out.pop()
                    at -= len(self.table[token])
                    token = self.shorter[token]
                    while token is None:
                        open_at[at] = 0
                        token = out.pop()
                        at -= len(self.table[token])
                        token = self.shorter[token]
        return out

    def encode_blocks(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in blocks of bounded size."""
        self.memo.age()
        look = self.memo.__getitem__
        if len(text) <= 4 * SLICE:
            yield b"".join(map(look, self.split.findall(text)))
            return
        pieces = self.split.finditer(text)
        while block := list(islice(pieces, SLICE)):
            yield b"".join(look(m.group()) for m in block)
            self.memo.age()

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self.encode_blocks(text)), dtype="<u4")

    def decode_block(self, ids: bytes) -> bytes:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.table.__getitem__, ids))


class _Memo(dict):
    """Encoded pieces in two generations: what was used since the last ageing, and what was used before."""

    def __init__(self, encoder: BytePairEncoder):
        super().__init__()
        self.encoder, self.old = encoder, {}

    def age(self) -> None:
        if len(self) > MEMO_PIECES:
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            got = self.encoder.encode_piece(piece.encode("utf-8"))
            ids = struct.pack(f"<{len(got)}I", *got)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


_encoders: dict[tuple[str, str], BytePairEncoder] = {}


def encoder_for(path: str, pattern: str) -> BytePairEncoder:
    """One encoder a process."""
    if (path, pattern) not in _encoders:
        _encoders[(path, pattern)] = BytePairEncoder(read_ranks(path), pattern)
    return _encoders[(path, pattern)]


def texts_of(column: pa.Array) -> Iterator[str]:
    """The texts of a column; null counts as empty."""
    for x in column.cast(pa.large_binary()):
        yield (x.as_py() or b"").decode("utf-8", "replace")


def encoded(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: `id_col`, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(path, pattern)
        for batch in batches:
            ids, count, sha, back, tokens = [], [], [], [], []

            def flush(upto: int) -> pa.RecordBatch:
                cols = [batch.column(0).slice(upto - len(count), len(count)), pa.array(count, pa.int64()), pa.array(sha), pa.array(back)]
                names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    flat = np.frombuffer(b"".join(tokens), dtype="<i4")
                    cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                    names.append("token_ids")
                return pa.RecordBatch.from_arrays(cols, names)

            size = 0
            for at, text in enumerate(texts_of(batch.column(1))):
                h, d, n = hashlib.sha256(), hashlib.sha256(), 0
                for block in enc.encode_blocks(text):
                    h.update(block)
                    d.update(enc.decode_block(block))
                    n += len(block) // 4
                    if with_ids:
                        tokens.append(block)
                count.append(n)
                sha.append(h.hexdigest())
                back.append(d.hexdigest())
                size += n
                if size > 1_000_000:
                    yield flush(at + 1)
                    ids, count, sha, back, tokens, size = [], [], [], [], [], 0
            if count:
                yield flush(batch.num_rows)

    schema = f"`{id_col}` long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)


def decoded(rows: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """`id_col` and text of each row's token ids; a null list gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder_for(path, pattern)
        for batch in batches:
            texts = [enc.decode(x.as_py() or []).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).cast("array<int>").alias("__ids")).mapInArrow(run, f"`{id_col}` long, text string")


def public_tokenizer() -> tuple[str, str]:
    """Path and pattern of the installed public 50k vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), *public_tokenizer(), with_ids=False)
