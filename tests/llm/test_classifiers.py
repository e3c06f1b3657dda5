"""Toxicity and quality: kernels and marginals against brute force, and accuracy on rows held out."""

import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import kernels, quality, toxicity
from tests.llm.util import SCHEMA, docs_frame, prose, vocabulary, words

INSULTS = ["grumblefoot", "wortbrain", "slimehead"]


def subsequence_kernel(s, t):
    """By listing all subsequences of length 3 with their spans."""

    def phi(x):
        x = f"\x01{x}\x02"
        out = {}
        for at in itertools.combinations(range(len(x)), 3):
            u = tuple(x[i] for i in at)
            out[u] = out.get(u, 0) + toxicity.DECAY ** (at[2] - at[0] + 1)
        return out

    a, b = phi(s), phi(t)
    dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
    return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5


def test_kernel_equals_brute_force():
    marks, ws = ["idiot", "banana", "aaa"], ["idiot", "idxiot", "banan", "aa", "a1b2", "aaaaaa"]
    place, dense, _ = toxicity._landmark_map(marks)
    got = toxicity.vectors(ws, place, dense)
    assert np.allclose(got, [[subsequence_kernel(w, m) for m in marks] for w in ws], atol=1e-5)


def test_windows_of_a_long_word_count_by_the_largest():
    place, dense, _ = toxicity._landmark_map(["grumblefoot", "banana"])
    long = "grumblefoot" + "zqzqzqzq" * 5
    alone = [toxicity.vectors([w], place, dense)[0] for w in (long, long[::-1])]
    windows = [f"\x01{long}\x02"[j : j + toxicity.WINDOW] for j in range(0, len(long) + 2 - toxicity.WINDOW // 2, toxicity.WINDOW // 2)]
    codes = [toxicity.codes_of([w], len(w)) for w in windows]
    each = [np.einsum("jk,j->k", dense[place[idx[0]]], weight) / toxicity.norms(c)[0] for c in codes for idx, weight in [toxicity.features(c)]]
    assert np.allclose(alone[0], np.max(each, axis=0), atol=1e-5)
    assert np.allclose(toxicity.vectors([long, long[::-1]], place, dense), alone, atol=1e-5)


def test_a_fit_needs_little_memory():
    """The driver fits, beside Spark; one step of 256 long words by all landmarks alone took over 200 MB."""
    import tracemalloc

    rng, rows = random.Random(5), toxic_rows(300, 4)
    texts = [t + " " + " ".join("".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(12)) for _, t in rows[0]]
    tracemalloc.start()
    machine = toxicity.fit(texts, [y for _, _, y in rows[1]])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert machine.weight is not None and peak < 150_000_000


def toxic_rows(n, seed):
    rng, vocab = random.Random(seed), vocabulary(3, 500)
    rows, labels = [], []
    for i in range(n):
        w = prose(rng, vocab, rng.randrange(15, 60)).split()
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_generalises_to_gaps_and_leaves_clean_text(spark):
    rows, labels = toxic_rows(500, 1)
    rows += [(1000, "a calm wort grumb"), (1001, "you grumble-foot there"), (1002, "such a sli*mehead"), (1003, "w o r t b r a i n"), (1004, None), (1005, ""), (1005, "")]
    df = docs_frame(spark, rows).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, df, lab).collect()}
    truth = {i: t for i, _, t in labels}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] == (i in set(held)) for i in truth)
    assert np.mean([got[i]["predicted"] == truth[i] for i in held]) >= 0.98
    assert [got[i]["predicted"] for i in (1000, 1001, 1002, 1003, 1004, 1005)] == [0, 1, 1, 1, 0, 0]
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_toxicity_tolerates_inserted_characters(spark):
    rng, vocab = random.Random(12), vocabulary(12, 1500)
    insults = ["vexor", "quizak", "wyzzle", "jaxxy", "kovyk"]
    texts, labels = [], []
    for i in range(400):
        w = prose(rng, vocab, rng.randrange(20, 60)).split()
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    scorer = toxicity.Scorer(toxicity.fit(texts, labels))
    spoiled = [w[:i] + c + w[i:] for w in insults for i in range(1, len(w)) for c in "*x.-"]
    split = [w[:i] + " " + w[i:] for w in insults for i in range(2, len(w) - 1)]
    hits = scorer.scores([f"{prose(rng, vocab, 9)} {w} {prose(rng, vocab, 9)}" for w in spoiled + split]) >= 0.5
    clean = scorer.scores([prose(rng, vocab, 60) for _ in range(300)] + ["", "word " * 50_000]) >= 0.5
    assert hits[: len(spoiled)].mean() >= 0.9 and hits[len(spoiled) :].all() and clean.mean() <= 0.01


def test_toxicity_column_filter_keeps_columns(spark):
    rows, labels = toxic_rows(200, 2)
    machine = toxicity.fit([t for _, t in rows], [t for _, _, t in labels])
    df = docs_frame(spark, rows + [(None, None)])
    kept = toxicity.without_toxic(df, machine)
    assert kept.columns == df.columns and kept.count() == 161


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0), (3, 1, 0)], [(1, None, None)]])
def test_no_usable_labels(spark, labels):
    df = docs_frame(spark, [(1, "a b"), (2, "c"), (3, None), (None, "d")])
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r["score"] for r in toxicity.toxicity(df, df, lab).collect()} <= {0.5, 0.0}
    assert {r["score"] for r in quality.quality(df, df, lab).collect()} <= {0.5, 1.0}
    assert toxicity.toxicity(df.limit(0), df, lab).count() == 0 == quality.quality(df.limit(0), df, lab).count()


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    counts, good, trans = np.array([3, 1, 4]), rng.normal(size=8), rng.normal(size=(2, 2))
    p, pair = quality.forward_backward(good, counts, trans)
    at, want, pairs = 0, [], np.zeros((2, 2))
    for n in counts.tolist():
        total, ones, both = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=n):
            e = np.exp(sum(good[at + i] * v for i, v in enumerate(y)) + sum(trans[a, b] for a, b in zip(y, y[1:])))
            total += e
            ones += e * np.array(y)
            for a, b in zip(y, y[1:]):
                both[a, b] += e
        want += list(ones / total)
        pairs += both / total
        at += n
    assert np.allclose(p, want) and np.allclose(pair, pairs)


def test_line_features_see_each_document_alone():
    texts = ["one two\n\nthree three", "", "\n", "UP!! up", "UP!! up\nup"]
    data, offsets = quality.buffers(texts)
    x, size, counts = quality.line_features(data, offsets)
    assert counts.tolist() == [3, 1, 2, 1, 2] and size.tolist() == [8, 1, 11, 0, 1, 0, 7, 8, 2]
    for i, t in enumerate(texts):
        alone = quality.line_features(*quality.buffers([t]))[0]
        a = int(counts[:i].sum())
        assert np.allclose(alone, x[a : a + counts[i]])


def field_of(seed):
    rng = np.random.default_rng(seed)
    field = quality.Field()
    field.w, field.trans = rng.normal(size=3 * quality.N_LINE + 3), rng.normal(size=(2, 2))
    field.mean, field.std, field.curve = rng.random(quality.N_LINE), 1 + rng.random(quality.N_LINE), np.array([1.0, 0.5, 0.1])
    return field


def test_line_scores_in_blocks_equal_whole_feature_rows(monkeypatch):
    rng, vocab, field = random.Random(8), vocabulary(5, 40), field_of(2)
    texts = ["\n".join(rng.choice([prose(rng, vocab, rng.randrange(1, 12)), "", "again again", "é ü!"]) for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["", "\n" * 7, "x" * 90]
    data, offsets = quality.buffers(texts)
    x, _, counts = quality.line_features(data, offsets)
    want = quality.with_neighbours((x - field.mean) / field.std, counts) @ field.w
    bounds, _ = quality.lines_of(data, offsets)
    for lines, size in ((1, 1 << 20), (3, 1 << 20), (100, 30), (1 << 20, 1 << 20)):
        monkeypatch.setattr(quality, "BLOCK_LINES", lines)
        monkeypatch.setattr(quality, "BLOCK_BYTES", size)
        assert np.allclose(field.line_scores(data, bounds, counts), want)
    alone = [field.score(*quality.buffers([t]))[0] for t in texts]
    assert np.allclose(field.score(data, offsets), alone)


def test_many_lines_need_little_memory():
    import tracemalloc

    data, offsets = quality.buffers(["\n" * 400_000, "a b\n" * 50_000])
    field = field_of(3)
    tracemalloc.start()
    s = field.score(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert ((0 <= s) & (s <= 1)).all() and peak < 250_000_000


def test_the_chain_changes_answers():
    """A doubtful line between bad ones is bad, between good ones good; without transitions both are alike."""
    good = np.array([-3.0, 0.1, -3.0, 3.0, -0.1, 3.0])
    tie = np.array([[1.5, -1.5], [-1.5, 1.5]])
    counts = np.array([3, 3])
    p, pairs = quality.forward_backward(good, counts, tie, pairs=False)
    assert pairs is None and p[1] < 0.1 and p[4] > 0.9
    q, _ = quality.forward_backward(good, counts, np.zeros((2, 2)))
    assert q[1] > 0.5 > q[4]


def test_quality_on_held_out_rows(spark):
    rng, vocab = random.Random(3), vocabulary(4, 300)
    rows, labels = [], []
    for i in range(400):
        lines = [prose(rng, vocab, rng.randrange(8, 25)) + "." for _ in range(rng.randrange(2, 6))]
        bad = i % 4 == 0
        if bad:
            lines = [(" ".join([w.upper() + "!!" for w in x.split()]) if i % 8 else " ".join([x.split()[0]] * 15)) if rng.random() < 0.8 else x for x in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not bad), 0))
    rows += [(900, None), (901, ""), (902, "word " * 30_000)]
    df = docs_frame(spark, rows)
    got = {r["doc_id"]: r for r in quality.quality(df, df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [(i, q) for i, q, _ in labels if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == q for i, q in held]) >= 0.95
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())


def test_kernels_equal_plain_python():
    texts = ["Hello  World\tfoo", "", " ", "É\x85x a\x0bb", "one", "x" * 3]
    data, offsets = quality.buffers(texts)
    low = kernels.lower_bytes(data)
    starts, ends, counts = kernels.word_spans(low, offsets)
    got = [bytes(low[a:b]).decode() for a, b in zip(starts, ends)]
    assert got == [w for t in texts for w in words(t)] and counts.tolist() == [len(words(t)) for t in texts]
    h = kernels.word_hashes(low, starts, ends)
    assert len(set(h.tolist())) == len(set(got))
    again = kernels.word_hashes(*[np.frombuffer(b"..foo", np.uint8), np.array([2]), np.array([5])])
    assert again[0] == h[got.index("foo")]


def test_schema_constant():
    assert SCHEMA.startswith("doc_id long, text string")
