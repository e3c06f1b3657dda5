"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, lengths, word repetition and
likeness to its neighbours, each also seen from the line before and after; a transition score ties
neighbouring labels. Forward-backward gives each line's probability of being good; a document's raw quality
is the mean of its lines' probabilities weighted by length, and a logistic curve over it and the lowest
probability of any line of LONG_LINE bytes or more gives the score.

Training is on a bounded sample of labelled texts (MAX_GOOD and MAX_BAD rows, by hash of the identifier, texts
of at most MAX_TEXT bytes); a text's label stands for all its lines. Scoring is vectorised over whole Arrow
buffers, line by line for all documents of a slice at once. A line's features are weighed in blocks of BLOCK_LINES
lines and BLOCK_BYTES bytes (or one longer line): its own three scores, as a line, as the one before and as the one
after, are all that is kept of it, so texts of very many lines need a few numbers a line.

Defined cases: null and empty texts have one empty line; repeated rows are separate; without usable labels
every score is 0.5, with one class its share; texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import kernels as K
from keystrata.llm.common import table
from keystrata.llm.toxicity import training_sample

MAX_GOOD, MAX_BAD, MAX_TEXT = 1500, 1500, 32_768
STEPS, RATE, RIDGE = 250, 0.08, 1e-3
LONG_LINE, BLOCK_LINES, BLOCK_BYTES = 40, 16_384, 1 << 20

# character classes: 0 other bytes of multi-byte characters, 1 lower case, 2 upper case, 3 digits, 4 white space,
# then every ASCII punctuation mark by itself
_CLASS = np.zeros(256, dtype=np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]] = 4
_MARKS = [i for i in range(33, 127) if not chr(i).isalnum()]
_CLASS[_MARKS] = np.arange(5, 5 + len(_MARKS))
N_CLASS = 5 + len(_MARKS)
N_LINE = N_CLASS + 11


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, lines per document): line i is data[bounds[i]:bounds[i+1]], its line feed included."""
    feeds = np.flatnonzero(data == 10) + 1
    starts = np.sort(np.concatenate([offsets[:-1], feeds]))
    # a line feed at a document's end opens an empty line there; it belongs to that document
    counts = np.diff(np.searchsorted(feeds, offsets, side="right")) + 1
    return np.concatenate([starts, offsets[-1:]]), counts


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, bytes per line, lines per document)."""
    bounds, counts = lines_of(data, offsets)
    return block_features(data, bounds, opening(counts)), np.diff(bounds), counts


def opening(counts: np.ndarray) -> np.ndarray:
    """Which lines open a document."""
    out = np.zeros(int(counts.sum()), bool)
    out[np.cumsum(counts) - counts] = True
    return out


def block_features(data: np.ndarray, bounds: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The features of the lines data[bounds[i]:bounds[i+1]]; opens: which of them open a document."""
    n = len(bounds) - 1
    size = np.diff(bounds)
    line = np.repeat(np.arange(n), size)
    hist = np.bincount(line * N_CLASS + _CLASS[data], minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float64)
    share = hist / np.maximum(size, 1)[:, None]
    x = np.zeros((n, N_LINE), dtype=np.float64)
    x[:, :N_CLASS] = np.sqrt(share)
    starts, stops, _ = K.word_spans(data, bounds)
    at = np.searchsorted(bounds, starts, side="right") - 1
    h = K.word_hashes(data, starts, stops)
    words = np.bincount(at, minlength=n).astype(np.float64)
    same_line = at[1:] == at[:-1]
    again = np.bincount(at[1:][same_line & (h[1:] == h[:-1])], minlength=n)
    key = K.mix64(h + at.astype(K.U64) * K.U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    first = np.ones(len(key), bool)
    first[1:] = key[order][1:] != key[order][:-1]
    unique = np.bincount(at[order[first]], minlength=n)
    letters = np.bincount(at, weights=(stops - starts), minlength=n)
    most = np.maximum(words, 1)
    sums = np.zeros(n, dtype=K.U64)
    np.add.at(sums, at, h)
    tail = N_CLASS
    x[:, tail] = np.log1p(size) / 6
    x[:, tail + 1] = np.log1p(words) / 5
    x[:, tail + 2] = again / most
    x[:, tail + 3] = unique / most
    x[:, tail + 4] = np.minimum(letters / most, 20) / 10
    x[:, tail + 5] = words == 0
    x[1:, tail + 6] = (sums[1:] == sums[:-1]) & (words[1:] > 0) & ~opens[1:]
    x[:, tail + 7] = share[:, 5:].sum(axis=1)
    x[:, tail + 8] = hist[:, 2] / np.maximum(hist[:, 1] + hist[:, 2], 1)
    x[:, tail + 9] = (unique / most) ** 4
    x[:, tail + 10] = hist[:, 5:].sum(axis=1) / most
    return x


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each line's features, those of the line before and after in its document (zeros outside), and a constant."""
    ends = np.cumsum(counts)
    before, after = np.zeros_like(x), np.zeros_like(x)
    before[1:], after[:-1] = x[:-1], x[1:]
    before[ends - counts] = 0
    after[ends - 1] = 0
    edge = np.zeros((len(x), 3))
    edge[ends - counts, 0], edge[ends - 1, 1], edge[:, 2] = 1, 1, 1
    return np.concatenate([x, before, after, edge], axis=1)


def forward_backward(good: np.ndarray, counts: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(P(good) of each line, pair marginals summed over neighbours if asked for); good: each line's score for good, bad's is 0.

    All documents advance together, longest first, so a step only touches those that still have lines.
    """
    order = np.argsort(-counts, kind="stable")
    first = (np.cumsum(counts) - counts)[order]
    length = counts[order]
    psi = np.stack([np.zeros_like(good), good], axis=1)
    alpha, beta = np.zeros_like(psi), np.zeros_like(psi)
    alive = [int(np.searchsorted(-length, -t, side="left")) for t in range(int(length[0]) + 1)] if len(length) else [0]

    def lse(a: np.ndarray) -> np.ndarray:
        return np.logaddexp(a[..., 0], a[..., 1])

    alpha[first] = psi[first]
    for t in range(1, len(alive)):
        rows = first[: alive[t]] + t
        alpha[rows] = psi[rows] + lse(alpha[rows - 1][:, None, :] + trans.T[None])
    for t in range(len(alive) - 1, 0, -1):
        rows = first[: alive[t]] + t - 1
        beta[rows] = lse(trans[None] + (psi[rows + 1] + beta[rows + 1])[:, None, :])
    joint = alpha + beta
    p = 1 / (1 + np.exp(np.clip(joint[:, 0] - joint[:, 1], -50, 50)))
    if not pairs:
        return p, None
    inner = np.ones(len(good), bool)
    inner[np.cumsum(counts) - counts] = False
    rows = np.flatnonzero(inner)
    pair = alpha[rows - 1][:, :, None] + trans[None] + (psi[rows] + beta[rows])[:, None, :]
    pair -= pair.max(axis=(1, 2), keepdims=True)
    pair = np.exp(pair)
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair.sum(axis=0)


class Field:
    """The fitted field and curve, or a constant score."""

    def __init__(self, constant: float = 0.5):
        self.constant, self.w, self.trans, self.curve = constant, None, np.zeros((2, 2)), np.zeros(3)

    def line_scores(self, data: np.ndarray, bounds: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Each line's score for good: what `with_neighbours` times the weights gives, block by block."""
        n = len(bounds) - 1
        # own, as the line before, as the line after
        w = self.w[: 3 * N_LINE].reshape(3, N_LINE).T
        opens, parts, i = opening(counts), np.empty((n, 3)), 0
        while i < n:
            j = int(np.searchsorted(bounds, bounds[i] + BLOCK_BYTES, side="right")) - 1
            j = min(n, i + BLOCK_LINES, max(j, i + 1))
            a = max(i - 1, 0)  # one line more: a feature compares a line with the one before
            x = block_features(data[bounds[a] : bounds[j]], bounds[a : j + 1] - bounds[a], opens[a:j])
            parts[i:j] = ((x[i - a :] - self.mean) / self.std) @ w
            i = j
        first, last = np.cumsum(counts) - counts, np.cumsum(counts) - 1
        good = parts[:, 0] + self.w[-1]
        good[1:] += np.where(opens[1:], 0.0, parts[:-1, 1])
        good[:-1] += np.where(opens[1:], 0.0, parts[1:, 2])
        good[first] += self.w[-3]
        good[last] += self.w[-2]
        return good

    def line_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bounds, counts = lines_of(data, offsets)
        p, _ = forward_backward(self.line_scores(data, bounds, counts), counts, self.trans, pairs=False)
        return p, np.diff(bounds), counts

    def document_features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per document: log-odds of the length-weighted mean, those of the lowest long line, and a constant."""
        p, size, counts = self.line_probabilities(data, offsets)
        w = size + 1.0
        at = np.cumsum(counts) - counts
        mean = np.add.reduceat(p * w, at) / np.add.reduceat(w, at)
        low = np.minimum.reduceat(np.where(size >= LONG_LINE, p, 1.0), at)
        odds = lambda q: np.log(np.clip(q, 1e-4, 1 - 1e-4) / (1 - np.clip(q, 1e-4, 1 - 1e-4)))
        return np.stack([odds(mean), odds(low), np.ones_like(mean)], axis=1)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        if self.w is None:
            return np.full(n, self.constant)
        return 1 / (1 + np.exp(-np.clip(self.document_features(data, offsets) @ self.curve, -30, 30)))


def buffers(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return K.column_bytes(pa.array(texts, pa.string()))


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> Field:
    """Train on labelled texts; prior: the share of label 1, if the sample's differs."""
    y = np.array(labels, dtype=np.float64)
    share = float(y.mean()) if len(y) else 0.5
    prior = share if prior is None else prior
    field = Field(prior)
    if not len(y) or y.min() == y.max():
        return field
    data, offsets = buffers(texts)
    x, size, counts = line_features(data, offsets)
    field.mean, field.std = x.mean(axis=0), x.std(axis=0) + 1e-3
    f = with_neighbours((x - field.mean) / field.std, counts)
    doc = np.repeat(np.arange(len(y)), counts)
    target = y[doc]
    # a text weighs the same however many lines it has, a class the same however many texts
    weight = (size + 1.0) / np.bincount(doc, weights=size + 1.0)[doc] * np.where(target > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
    weight *= len(y)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(counts) - counts] = False
    seen = np.zeros((2, 2))
    seen[0, 0], seen[1, 1] = (inner & (target == 0)).sum(), (inner & (target == 1)).sum()
    w, trans = np.zeros(f.shape[1]), np.zeros((2, 2))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    for step in range(1, STEPS + 1):
        p, pair = forward_backward(f @ w, counts, trans)
        gw = f.T @ (weight * (p - target)) / len(y) + RIDGE * w
        gt = (pair - seen) / max(len(doc), 1) + RIDGE * trans + 0.05 * trans
        for value, grad, m, v in ((w, gw, mw, vw), (trans, gt, mt, vt)):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    field.w, field.trans = w, trans
    d = field.document_features(data, offsets)
    wt = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    curve = np.zeros(3)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(d @ curve, -30, 30)))
        grad = d.T @ (wt * (p - y)) + 0.1 * curve * [1, 1, 0]
        hess = (d * (wt * p * (1 - p))[:, None]).T @ d + np.diag([0.1, 0.1, 1e-6])
        step = np.linalg.solve(hess, grad)
        curve = curve - step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
    field.curve = curve
    return field


def scored(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and score of each row."""
    model = docs.sparkSession.sparkContext.broadcast(field)  # some hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            for i, j in K.doc_chunks(offsets, 2 << 20):
                s = model.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(s, pa.float64())], [id_col, "score"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` long, score double")


def quality(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_at: float = 0.3) -> DataFrame:
    """`id_col`, held_out, score, predicted of each row of docs, by a field fitted on train_docs and labels."""
    texts, ys, prior = training_sample(train_docs, labels, "quality", {1: MAX_GOOD, 0: MAX_BAD}, MAX_TEXT, id_col, text_col)
    out = scored(docs, fit(texts, ys, prior), id_col, text_col)
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= keep_at).cast("int").alias("predicted"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality(docs, docs, table(spark, sf_dir, "labels"))
