"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks.

A sentence is a bag of segments: its words (A-Z and other letters lower-cased, outer punctuation removed), runs
of single letters joined ("i d i o t"), and overlapping windows of very long words. The kernel of two segments
is the normalised gap-weighted subsequence kernel of order 3: every common subsequence of three characters
counts, damped by DECAY for each place it spans, so gaps and inserted characters lower a match only a little.
The machine's value of a sentence is the largest over its segments, of a text the largest over its sentences.

Two neighbouring words that together spell a witness ("id iot") are a segment, too.

Training is on a bounded sample of labelled texts (MAX_TOXIC and MAX_CLEAN rows, by hash of the identifier,
texts of at most MAX_TEXT bytes). Labels belong to texts, so witness segments are chosen first: those whose
share of toxic texts is significantly larger than of clean ones, counting texts that are copies of each other once. Witnesses, witnesses spoiled by an
inserted character, and the commonest clean segments
are landmarks; a squared-hinge machine is fitted on the landmark map, and refitted with the clean segments it
rates highest. The logistic curve is fitted to the texts' largest values, and to those of toxic texts with spoiled witnesses. The expansion over landmarks is linear in subsequence space, so it is folded into one weight
per three-character subsequence: scoring is exact, and independent of the number of landmarks. A logistic
curve over the largest value gives the score.

Defined cases: null, empty and word-less texts get the score of a text without a witness; repeated rows are
separate; no usable labels, or labels of one class only: every score is the share of toxic labels (0.5 without
labels); texts of any length are scored whole; other columns are ignored.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator
from itertools import combinations
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import kernels as K
from keystrata.llm.bpe import texts_of
from keystrata.llm.common import table

DECAY, CODES, WINDOW = 0.7, 64, 18
MAX_TOXIC, MAX_CLEAN, MAX_TEXT = 1500, 2500, 32_768
LANDMARKS, MEMO = 256, 300_000
BLOCK = 4_000_000  # numbers gathered at once
ROUNDS, MINUS, RIDGE, VARIANTS = 5, 8.0, 3e-5, 6
OUTER = string.punctuation + "«»“”„‘’…–—¡¿"
SPELLED = re.compile(r"(?<!\S)(?:\S[ \t.\-_*]{1,2}){3,}\S(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def segments(sentence: str) -> set[str]:
    """The segments of a sentence, lower-cased."""
    low = sentence.lower()
    out = {w.strip(OUTER) for w in low.split()}
    for run in SPELLED.findall(low):
        out.add(re.sub(r"[\s.\-_*]", "", run))
    out.discard("")
    return out


def codes_of(words: list[str], n: int) -> np.ndarray:
    """Character codes of words of length n: 0 a start, 1-26 letters, 27-36 digits, 63 an end, the rest folded onto 37-62."""
    cp = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n)
    out = 37 + cp % 26
    out = np.where((cp >= 97) & (cp <= 122), cp - 96, out)
    out = np.where((cp >= 48) & (cp <= 57), cp - 21, out)
    return np.where(cp == 1, 0, np.where(cp == 2, 63, out)).astype(np.int64)


_triples: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of all three-character subsequences of a word of length n."""
    if n not in _triples:
        at = np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3)
        _triples[n] = at, (DECAY ** (at[:, 2] - at[:, 0] + 1)).astype(np.float32)
    return _triples[n]


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(subsequence index, weight) arrays; one row a word."""
    at, weight = triples(codes.shape[1])
    return (codes[:, at[:, 0]] * CODES + codes[:, at[:, 1]]) * CODES + codes[:, at[:, 2]], weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Kernel of each word with itself, to the power 1/2: equal subsequences of a word add up before squaring."""
    at, weight = features(codes)
    order = np.argsort(at, axis=1, kind="stable")
    ranked = np.take_along_axis(at, order, 1)
    run = np.concatenate([np.zeros((len(at), 1)), np.cumsum(weight[order], axis=1, dtype=np.float64)], axis=1)
    last = np.concatenate([ranked[:, 1:] != ranked[:, :-1], np.ones((len(at), 1), bool)], axis=1)
    upto = np.where(last, run[:, 1:], 0.0)
    before = np.maximum.accumulate(np.concatenate([np.zeros((len(at), 1)), upto[:, :-1]], axis=1), axis=1)
    return np.sqrt((np.where(last, upto - before, 0.0) ** 2).sum(axis=1))


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, codes) of words cut into windows, in blocks of bounded size."""
    groups: dict[int, tuple[list[int], list[str]]] = {}
    for i, w in enumerate(words):
        if len(w) < 2:
            continue
        w = f"\x01{w}\x02"
        parts = [w] if len(w) <= WINDOW else [w[j : j + WINDOW] for j in range(0, len(w) - WINDOW // 2, WINDOW // 2)]
        for part in parts:
            at, ws = groups.setdefault(len(part), ([], []))
            at.append(i)
            ws.append(part)
    for n, (at, ws) in groups.items():
        step = max(1, 250_000 // len(triples(n)[1]))
        for j in range(0, len(ws), step):
            yield n, np.array(at[j : j + step]), codes_of(ws[j : j + step], n)


class Machine:
    """The fitted model: a weight per subsequence, a bias and the logistic curve; or a constant score."""

    def __init__(self, weight: np.ndarray | None = None, bias: float = 0.0, slope: float = 0.0, shift: float = 0.0, constant: float = 0.5, witnesses: frozenset[str] = frozenset()):
        self.weight, self.bias, self.slope, self.shift, self.constant, self.witnesses = weight, bias, slope, shift, constant, witnesses

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each segment; under three characters: the bias."""
        out = np.full(len(words), self.bias)
        for _, at, codes in by_length(words):
            idx, weight = features(codes)
            got = (self.weight[idx] @ weight) / np.maximum(norms(codes), 1e-9) + self.bias
            np.maximum.at(out, at, got)
        return out

    def score(self, top: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * top + self.shift, -30, 30)))


def vectors(words: list[str], place: np.ndarray, dense: np.ndarray) -> np.ndarray:
    """Normalised kernel of each word with the landmarks; place: a subsequence's row in dense, 0 if no landmark has it."""
    out = np.zeros((len(words), dense.shape[1]), dtype=np.float32)
    for _, at, codes in by_length(words):
        idx, weight = features(codes)
        step = max(1, BLOCK // (len(weight) * dense.shape[1]))
        for a in range(0, len(at), step):
            part = at[a : a + step]
            got = np.einsum("ijk,j->ik", dense[place[idx[a : a + step]]], weight)
            # windows of one word may share a block
            np.maximum.at(out, part, got / np.maximum(norms(codes[a : a + step]), 1e-9)[:, None])
    return out


def bags_of(texts: list[str]) -> tuple[list[str], list[np.ndarray]]:
    """All segments, and each text's as places in that list: a bag of numbers is a tenth of a set of strings."""
    place: dict[str, int] = {}
    bags = []
    for t in texts:
        bag = set().union(*(segments(s) for s in SENTENCE.split(t))) if t else ()
        bags.append(np.fromiter((place.setdefault(w, len(place)) for w in bag), dtype=np.int32, count=len(bag)))
    return list(place), bags


def distinct_texts(names: list[str], bags: list[np.ndarray]) -> list[int]:
    """Bags that share no band of six minima with an earlier one taken: copies of a text count once."""
    digest = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=K.U64, count=len(names))
    seeds, seen, out = K.seeded(60, 31)[:, None], set(), []
    for i, bag in enumerate(bags):
        h = digest[bag]
        low = [K.mix64((h[None, :] ^ seeds[j : j + 6]).ravel()).reshape(6, -1).min(axis=1).tobytes() for j in range(0, 60, 6)] if len(bag) else []
        keys = set(enumerate(low))
        if not keys & seen:
            seen |= keys
            out.append(i)
    return out


def spoilt(word: str, rng: np.random.Generator, n: int) -> list[str]:
    """The word with one character inserted, at n places."""
    at = rng.permutation(np.arange(1, len(word)))[:n].tolist()
    return [word[:i] + "*x.-0q_"[int(rng.integers(7))] + word[i:] for i in at]


def fit(texts: list[str], labels: list[int], prior: float | None = None) -> Machine:
    """Train on labelled texts; prior: the share of toxic labels, if the sample's differs."""
    y = np.array(labels)
    share = float(y.mean()) if len(y) else 0.5
    prior = share if prior is None else prior
    if not len(y) or y.min() == y.max():
        return Machine(constant=prior)
    names, bags = bags_of(texts)
    once = distinct_texts(names, bags)
    held = np.zeros((2, len(names)), dtype=np.int64)
    for i in once:
        held[y[i], bags[i]] += 1
    clean, dirty = (Counter({names[j]: int(n[j]) for j in np.flatnonzero(n)}) for n in held)
    nt = int(y[once].sum())
    nc = len(once) - nt

    def evidence(w: str) -> float:
        a, b = dirty[w], clean[w]
        p = (a + b) / (nt + nc)
        terms = ((a, nt * p), (nt - a, nt * (1 - p)), (b, nc * p), (nc - b, nc * (1 - p)))
        return 2 * sum(o * np.log(o / e) for o, e in terms if o and e)

    least = max(2, 0.005 * nt)
    ranked = sorted(((evidence(w), w) for w, a in dirty.items() if a >= least and a * nc >= 8 * nt * clean[w] and len(w) >= 3), reverse=True)
    # as many words were tried as recur in toxic texts, so chance alone reaches about 2 ln(n); 6 more make it a rare event
    tried = sum(a >= least for a in dirty.values())
    witnesses = [w for g, w in ranked if g >= 2 * np.log(max(tried, 1)) + 6][:400]
    if not witnesses:
        return Machine(constant=prior)
    known = set(witnesses)
    pool = sorted(w for w in clean if w not in known and len(w) >= 2)
    common = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) >= 2 and w not in known]
    # tolerance is trained in, too: witnesses with one inserted character stay witnesses
    rng = np.random.default_rng(7)
    variants = {w: spoilt(w, rng, VARIANTS) for w in witnesses}
    plus = witnesses + [x for w in witnesses for x in variants[w]]
    weight = np.array([float(dirty[w]) for w in witnesses] + [dirty[w] / len(variants[w]) for w in witnesses for _ in variants[w]])
    minus = common[:1500] + [pool[i] for i in rng.permutation(len(pool))[:2500]]
    machine, worst = Machine(), []
    for _ in range(ROUNDS):
        hurt = [variants[w][0] for w in witnesses[: LANDMARKS // 4]]
        marks = [w[: WINDOW - 2] for w in dict.fromkeys(witnesses[: LANDMARKS // 4] + hurt + worst[: LANDMARKS // 4] + common)][:LANDMARKS]
        place, dense, root = _landmark_map(marks)
        z = vectors(plus + minus, place, dense) @ root
        t = np.concatenate([np.ones(len(plus)), -np.ones(len(minus))])
        cost = np.concatenate([weight / weight.sum(), np.full(len(minus), MINUS / len(minus))])
        w, b = _squared_hinge(z, t, cost, RIDGE)
        folded = (dense @ (root @ w)).astype(np.float32)
        folded[0] = 0.0
        machine = Machine(folded[place], b)
        value = machine.values(pool)
        worst = [pool[i] for i in np.argsort(-value)[:500]]
        minus = list(dict.fromkeys(minus + worst))
    # the curve over each text's largest value, with classes weighted back to their true shares; half of the weight
    # of toxic texts is theirs with all witnesses spoiled
    value = machine.values(names)
    spoiled = np.full(len(names), -np.inf)
    for j, w in enumerate(names):
        if w in known:
            spoiled[j] = np.median(machine.values(variants[w]))
    top = np.array([value[bag].max(initial=-np.inf) if len(bag) else machine.bias for bag in bags])
    again = np.array([spoiled[bag].max(initial=-np.inf) if t else -np.inf for bag, t in zip(bags, y)])
    again[np.isneginf(again)] = np.nan
    has = ~np.isnan(again)
    wt = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    wt[has] /= 2
    machine.slope, machine.shift = _logistic(np.concatenate([top, again[has]]), np.concatenate([y, y[has]]), np.concatenate([wt, wt[has]]))
    machine.witnesses = frozenset(known)
    return machine


def _landmark_map(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of subsequences, the landmarks' normalised weights by row, and the inverse root of their kernel matrix."""
    parts = []
    for j, w in enumerate(marks):
        for _, _, codes in by_length([w]):
            idx, weight = features(codes)
            parts.append((j, idx[0], weight / max(float(norms(codes)[0]), 1e-9)))
    used = np.unique(np.concatenate([idx for _, idx, _ in parts]))
    place = np.zeros(CODES**3, dtype=np.int32)
    place[used] = np.arange(1, len(used) + 1)
    dense = np.zeros((len(used) + 1, len(marks)), dtype=np.float32)
    for j, idx, weight in parts:
        np.add.at(dense[:, j], place[idx], weight)
    gram = vectors(marks, place, dense).astype(np.float64)
    vals, vecs = np.linalg.eigh((gram + gram.T) / 2)
    return place, dense, vecs @ np.diag(1 / np.sqrt(np.maximum(vals, 1e-5))) @ vecs.T


def _squared_hinge(z: np.ndarray, t: np.ndarray, cost: np.ndarray, ridge: float = 1e-4, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Newton steps for the squared-hinge machine."""
    x = np.concatenate([z, np.ones((len(z), 1))], axis=1).astype(np.float64)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        margin = t * (x @ w)
        on = margin < 1
        xa, ca = x[on], cost[on]
        reg = np.full(len(w), ridge)
        reg[-1] = 1e-9
        new = np.linalg.solve((xa * ca[:, None]).T @ xa + np.diag(reg), (xa * ca[:, None]).T @ t[on])
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w = new
    return w[:-1], float(w[-1])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> tuple[float, float]:
    """Slope and shift of a weighted logistic curve, by damped Newton steps."""
    m, s = x.mean(), x.std() + 1e-9
    d = np.stack([(x - m) / s, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        grad = d.T @ (weight * (p - y)) + ridge * np.array([w[0], 0.0])
        hess = (d * (weight * p * (1 - p))[:, None]).T @ d + np.diag([ridge, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - step * min(1.0, 2 / (np.abs(step).max() + 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0] / s), float(w[1] - w[0] * m / s)


def training_sample(docs: DataFrame, labels: DataFrame, label: str, caps: dict[int, int], max_text: int = MAX_TEXT, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int], float | None]:
    """Texts and labels of a bounded sample, and the share of label 1 among all labels that may be learned from.

    Only identifiers with crc32 mod 5 other than 0 are used. caps: rows of each class, the first by hash.
    """
    may = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col(label).cast("int").alias("__y"))
    may = may.filter(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (F.crc32(F.col("__id").cast("string").cast("binary")) % 5 != 0))
    counts = {r[0]: r[1] for r in may.groupBy("__y").count().collect()}
    parts = [may.filter(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(cap) for y, cap in caps.items()]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__t")).filter(F.octet_length("__t") <= max_text)
    # at most sum(caps) identifiers are broadcast
    rows = slim.join(F.broadcast(picked.dropDuplicates(["__id"])), "__id").select("__id", "__y", "__t")
    rows = rows.orderBy(F.xxhash64("__id"), "__id", F.xxhash64("__t")).limit(sum(caps.values())).collect()
    total = sum(counts.values())
    return [r["__t"] or "" for r in rows], [r["__y"] for r in rows], (counts.get(1, 0) / total if total else None)


class Scorer:
    """Scores texts with a machine, remembering segments' values in two generations of bounded size."""

    def __init__(self, machine: Machine):
        self.machine, self.memo, self.old = machine, {}, {}

    def scores(self, texts: list[str]) -> np.ndarray:
        m = self.machine
        if m.weight is None:
            return np.full(len(texts), m.constant)
        bags = []
        for text in texts:
            low = text.lower()
            words = low.split()
            bag = set(words)
            bag |= m.witnesses.intersection(map(add, words, words[1:]))
            if SPELLED.search(low):
                bag |= segments(low)
            bags.append(bag)
        fresh = []
        for w in set().union(*bags) - self.memo.keys():
            if w in self.old:
                self.memo[w] = self.old[w]
            else:
                fresh.append(w)
        self.memo.update(zip(fresh, m.values([w.strip(OUTER) for w in fresh]).tolist()))
        top = np.array([max(map(self.memo.__getitem__, bag), default=m.bias) for bag in bags])
        if len(self.memo) > MEMO:
            self.memo, self.old = {}, self.memo
        return m.score(top)


def slices(texts: Iterator[str], size: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in lists of about `size` characters."""
    out, held = [], 0
    for t in texts:
        out.append(t)
        held += len(t)
        if held > size:
            yield out
            out, held = [], 0
    if out:
        yield out


def scored(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and score of each row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)  # one weight per subsequence: 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            at = 0
            for texts in slices(texts_of(batch.column(1))):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(scorer.scores(texts), pa.float64())], [id_col, "score"])
                at += len(texts)

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("__text")).mapInArrow(run, f"`{id_col}` long, score double")


def without_toxic(docs: DataFrame, machine: Machine, text_col: str = "text", reject_at: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose score is under reject_at; no join, so identifiers don't matter."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def score(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model.value)
        for column in columns:
            yield pd.Series(np.concatenate([scorer.scores(t) for t in slices(x or "" for x in column)] or [np.zeros(0)]))

    return docs.filter(score(F.col(text_col)) < reject_at)


def toxicity(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, score, predicted of each row of docs, by a machine fitted on train_docs and labels."""
    texts, ys, prior = training_sample(train_docs, labels, "toxic", {1: MAX_TOXIC, 0: MAX_CLEAN}, id_col=id_col, text_col=text_col)
    out = scored(docs, fit(texts, ys, prior), id_col, text_col)
    held = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity(docs, docs, table(spark, sf_dir, "labels"))
