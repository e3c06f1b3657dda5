"""Elias-Fano sequences and the language model against plain dictionaries."""

import collections
import math
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keystrata.llm import elias_fano as ef
from keystrata.llm import lm_scoring as lm
from tests.llm.util import docs_frame, words


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, (1 << 63) - 1), max_size=300), st.integers(0, 62))
def test_sequence(values, shift):
    v = np.sort(np.array(values, dtype=np.uint64) >> np.uint64(shift))
    seq = ef.EliasFano(ef.encode(v, int(v[-1]) + 1 if len(v) else 1, "x"), "x")
    if len(v):
        assert (seq.access(np.arange(len(v))) == v).all()
        probe = np.unique(np.concatenate([v, v + np.uint64(1), v // np.uint64(2)]))
        got = seq.find(probe)
        first = {int(x): int(np.searchsorted(v, x)) for x in v}
        assert [first.get(int(x), -1) for x in probe] == got.tolist()


def test_pack_and_map(tmp_path):
    arrays = {"a": np.arange(5), "b": np.zeros(0, np.uint8), "c": np.array([1], dtype=np.uint64)}
    ef.write_file(f"file://{tmp_path}/f", ef.pack(arrays))
    back = ef.map_file(f"file://{tmp_path}/f")
    assert all((back[k] == v).all() and len(back[k]) == len(v) for k, v in arrays.items()) and len(list(tmp_path.iterdir())) == 1


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.lists(st.tuples(st.integers(0, (1 << 32) - 1), st.integers(0, (1 << 32) - 1)), max_size=200), st.integers(1, 50))
def test_sorts_as_plain_words(bits, pairs, most):
    a = np.array([x % most if i % 2 else x >> (32 - bits) for i, (x, _) in enumerate(pairs)], dtype=np.int64)
    b = np.array([y >> (32 - bits) for _, y in pairs], dtype=np.int64)
    c, w, inverse = lm.distinct_pairs(a, b)  # wide numbers take the other way
    assert list(zip(c.tolist(), w.tolist())) == sorted(set(zip(a.tolist(), b.tolist()))) and (c[inverse] == a).all() and (w[inverse] == b).all()
    assert (lm.order_of(a) == np.argsort(a, kind="stable")).all()
    u, inverse = lm.distinct(a.astype(np.uint64))
    assert u.tolist() == sorted(set(a.tolist())) and (u[inverse] == a.astype(np.uint64)).all()


def test_counts_beyond_one_are_added():
    k = [np.array([1, 5, 9], dtype=np.uint64), np.array([5, 7], dtype=np.uint64), np.zeros(0, np.uint64)]
    got = lm.summed(k, [np.array([1, 3, 1 << 40]), np.array([4, 1]), np.zeros(0, np.int64)])
    assert [x.tolist() for x in got] == [[1, 5, 7, 9], [1, 7, 1, 1 << 40]]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300), st.data())
def test_search_within_ranges(values, data):
    v = np.sort(np.array(values, dtype=np.uint64))
    seq = ef.EliasFano(ef.encode(v, int(v[-1]) + 1, "x"), "x")
    x = np.sort(np.array(data.draw(st.lists(st.sampled_from([*values, 1, 4999]), min_size=1, max_size=50)), dtype=np.uint64))
    begin = np.array(data.draw(st.lists(st.integers(0, len(v)), min_size=len(x), max_size=len(x))))
    end = np.minimum(len(v), begin + 40)
    want = [next((i for i in range(b, e) if v[i] == y), -1) for y, b, e in zip(x, begin, end)]
    assert seq.find(x, begin, end).tolist() == want


def expected(rows, trains, order=lm.ORDER):
    toks = [(i, words(t) + ["</s>"]) for i, t in rows]
    c, grams, follow = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, w in toks:
        if trains(i):
            c.update(w)
            w = ["<s>", *w]
            for k in range(2, order + 1):
                grams.update(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    seen = collections.Counter()
    for g, n in grams.items():
        follow[g[:-1]].add(g[-1])
        seen[g[:-1]] += n
    total, distinct = sum(c.values()), len(c)
    out = []
    for i, w in toks:
        base = [(c[x] + 0.5) / (total + 0.5 * (distinct + 1)) for x in w]
        p, v = list(base), ["<s>", *w]
        for k in range(2, order + 1):
            for j, x in enumerate(w):
                ctx = tuple(v[j + 2 - k : j + 1])
                if j + 2 >= k and seen[ctx]:
                    p[j] = max(grams[(*ctx, x)] - lm.DISCOUNT, 0) / seen[ctx] + lm.DISCOUNT * len(follow[ctx]) / seen[ctx] * p[j]
        out.append((i, len(w), sum(c[x] > 0 for x in w), total, sum(map(math.log10, base)), sum(map(math.log10, p))))
    return out


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 5 == 1


def check(spark, rows, order=lm.ORDER):
    df = docs_frame(spark, rows).withColumn("n_tokens", F.lit("clash"))
    got = lm.scores(df, lm.fit(df, "doc_id", "text", ~lm.held_out("doc_id"), order)).collect()
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(expected(rows, lambda i: not held(i), order), key=key)
    assert len(got) == len(want)
    step = -lm.LOG_FLOOR / 254
    for g, w in zip(got, want):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-6
        assert w[5] - step * w[1] - 1e-6 <= g[5] <= w[5] + 1e-6  # shares are rounded down by less than a step
    return got


def test_model_equals_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOKENS_A_SHARD", 500)  # several shards, and hot contexts cut over them
    monkeypatch.setattr(lm, "WORDS_A_SHARD", 64)
    rng = np.random.default_rng(3)
    vocab = ["the"] * 200 + [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(vocab, rng.integers(0, 60)))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "The THE unseenword the"), (503, "É é unseen1 unseen2"), (503, "É é unseen1 unseen2"), (None, "w1 w2")]
    rows += [(600 + i, "the w1 the w1 the w2 the w3") for i in range(200)]  # word pairs as hot contexts
    rows += [(900, "w5 " * 30_000), (901, "w6 w7 " * 2000)]
    for order in (2, 3, 4):
        check(spark, rows, order)


def test_probabilities_sum_to_one_at_most(spark):
    rows = [(i, "a b a c a b d") for i in range(6) if not held(i)]
    df = docs_frame(spark, rows)
    trie = lm.Trie(lm.fit(df, "doc_id", "text", F.lit(True)))
    n = np.array([3])
    seen = [lm.tokens(*lm.K.column_bytes(__import__("pyarrow").array([w])))[0][0] for w in ("a", "b", "c", "d", "zzz")]
    ctx = seen[:2]
    p = []
    for last in [*seen, lm.END]:
        counts, steps, _ = trie.walk(np.array([*ctx, last], dtype=np.uint64), n)
        q = (counts + 0.5) / (trie.meta["tokens"] + 0.5 * (trie.meta["distinct"] + 1))
        for rows_, share, left in steps:
            q[rows_] = share + left * q[rows_]
        p.append(q[2])
    assert 0.9 < sum(p) <= 1 + 1e-9  # p(x | a b) over all words, the end and anything unknown


def test_repeated_texts_score_apart(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choice(vocab, 60)) for _ in range(300)]
    rows = list(enumerate(texts)) + [(1000 + i, t) for i, t in enumerate(texts[:20])]
    df = docs_frame(spark, rows)
    got = {r["doc_id"]: r["score"] for r in lm.scores(df, lm.fit(df, "doc_id", "text", F.lit(True))).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 300))


def test_nothing_to_learn_from(spark):
    df = docs_frame(spark, [(1, "a b"), (2, None)])
    rows = lm.scores(df, lm.fit(df, "doc_id", "text", F.lit(False))).collect()
    assert {(r["train_tokens"], r["score"], r["base_score"]) for r in rows} == {(0, 0.0, 0.0)}
    assert lm.scores(df.limit(0), lm.fit(df, "doc_id", "text", F.lit(True))).count() == 0
