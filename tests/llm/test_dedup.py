"""Exact, near and line deduplication against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystrata.llm import common, exact_dedup, near_dedup, substring_dedup
from keystrata.llm.components import connected_components
from tests.llm.util import LOWER, components, docs_frame, prose, shingles, vocabulary

EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "One"), (904, "one"), (905, "one two"), (906, "One  TWO"), (907, "É É É É"), (908, "é é é é"), (909, "word " * 30_000)]


def near_brute(rows, k, num, den):
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in components(ids, links).items()}


def near_rows(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def family(rng, vocab, base, size, most):
    out = []
    for _ in range(size):
        w = base.split()
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k,num,den", [(3, 85, 100), (5, 4, 5)])
def test_near_equals_brute_force(spark, monkeypatch, k, num, den):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)  # several blocks a bucket
    rng, vocab = random.Random(5), vocabulary(5)
    texts = [prose(rng, vocab, rng.randrange(1, 120)) for _ in range(60)]
    base = prose(rng, vocab, 120)
    texts += family(rng, vocab, base, 110, 9) + [base] * 12
    texts += family(rng, vocab, prose(rng, vocab, 30), 25, 3)
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + EDGES
    got = near_dedup.near_duplicates(docs_frame(spark, rows), k=k, num=num, den=den)
    assert near_rows(got) == near_brute(rows, k, num, den)
    assert got.filter("kept <> (doc_id = component_id)").count() == 0


def test_near_without_the_forest_gives_the_same(spark, monkeypatch):
    rng, vocab = random.Random(6), vocabulary(6)
    rows = list(enumerate(family(rng, vocab, prose(rng, vocab, 100), 60, 10)))
    monkeypatch.setattr(near_dedup, "wide_limits", lambda total, num, den, z=5.0: (total * 0 - 1, total * 0 + 4096))  # nothing clear, nothing excluded
    assert near_rows(near_dedup.near_duplicates(docs_frame(spark, rows), k=3, num=85, den=100)) == near_brute(rows, 3, 85, 100)


def test_near_edges(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (3, "x y")]
    df = docs_frame(spark, rows).withColumn("cid", F.lit("clash")).withColumn("bands", F.lit(1))
    got = sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"]), r["kept"]) for r in near_dedup.near_duplicates(df).collect())
    assert got == [("1", 3, "1", False), ("1", 3, "1", True), ("3", 1, "3", True), ("None", 0, "None", True), ("None", 3, "1", False)]
    assert near_dedup.near_duplicates(docs_frame(spark, rows).limit(0)).count() == 0


def test_odd_sketch_counts_differing_samples():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (1, near_dedup.SAMPLES), dtype=np.uint32)
    b = a.copy()
    b[0, :20] += 1
    x, y = near_dedup.odd_sketch(a), near_dedup.odd_sketch(b)
    odd = int(np.unpackbits((x ^ y).view(np.uint8)).sum())
    assert 20 <= odd <= 40 and not (x ^ near_dedup.odd_sketch(a)).any()


def test_components_of_a_long_chain(spark):
    ids = random.Random(2).sample(range(10**9), 200)
    links = spark.createDataFrame(list(zip(ids, ids[1:])) + [(5 * 10**9, 6 * 10**9), (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["comp"] for r in connected_components(links).collect()}
    assert {got[i] for i in ids} == {min(ids)} and got[6 * 10**9] == 5 * 10**9 and len(got) == 202


@pytest.mark.parametrize("stays", ["min", "max"])
def test_exact_equals_brute_force(spark, stays):
    rng = random.Random(1)
    rows = [(i, rng.choice(["Aa", "aA", "b", "É", "é", "", None, "x y"])) for i in range(300)] + EDGES + [(5, "b"), (5, "b"), (None, "b")]
    got = exact_dedup.exact_duplicates(docs_frame(spark, rows).withColumn("keep_id", F.lit(0)), stays=stays).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    pick = min if stays == "min" else max
    want, stayed = [], set()
    for i, t in rows:
        n = (t or "").translate(LOWER)
        keep = pick(x for x in groups[n] if x is not None)
        want.append((str(i), keep, len(groups[n]), i == keep and n not in stayed, hashlib.sha256(n.encode()).hexdigest()))
        stayed |= {n} if i == keep else set()  # of equal rows one stays
    assert sorted((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got) == sorted(want)
    assert exact_dedup.exact_duplicates(docs_frame(spark, rows).limit(0)).count() == 0


def test_null_identifiers_share_no_key(spark):
    rng, vocab = random.Random(3), vocabulary(3)
    texts = [prose(rng, vocab, 40) for _ in range(12)]
    rows = [(None, t) for t in texts] * 2 + [(None, texts[0] + " more")]
    got = near_dedup.near_duplicates(docs_frame(spark, rows)).filter("kept").count()
    assert got == 12 and near_dedup.near_duplicates(docs_frame(spark, rows)).count() == 25


def test_exact_runs_no_python(spark):
    plan = exact_dedup.exact_duplicates(docs_frame(spark, EDGES))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def unit_list(text):
    """(start, end, words, normalised unit) of a text."""
    out, last = [], None
    for m in re.finditer(r"[^ \t\n\x0b\x0c\r]+", text or ""):
        if not out or last.group()[-1] in ".!?" or "\n" in text[last.end() : m.start()]:
            out.append([m.start(), m.end(), []])
        out[-1][1] = m.end()
        out[-1][2].append(m.group().translate(LOWER))
        last = m
    return [(a, b, len(w), " ".join(w)) for a, b, w in out]


def repeats_brute(rows, run_words):
    """(row, id, start, end, words, keep id, keep start) of each unit to remove."""
    first, order = {}, sorted(range(len(rows)), key=lambda r: (rows[r][0] is None, rows[r][0] or 0))
    units = {r: unit_list(rows[r][1]) for r in order}
    found = sorted(((rows[r][0] is None, rows[r][0] or 0, u[0], r, u) for r in order for u in units[r]), key=lambda x: x[:4])
    for _, _, _, r, u in found:
        first.setdefault(u[3], (r, u[0]))
    out = []
    for r in order:
        run = []
        for u in [*units[r], None]:
            if u is not None and first[u[3]] != (r, u[0]):
                run.append(u)
                continue
            if sum(x[2] for x in run) >= run_words:
                out += [(rows[r][0], a, b, n, rows[first[t][0]][0], first[t][1]) for a, b, n, t in run]
            run = []
    return out


def found(df):
    return sorted(map(tuple, df.select("doc_id", "start", "end", "n_words", "keep_doc_id", "keep_start").collect()), key=str)


def test_repeats_equal_brute_force_and_text_is_cut(spark):
    rng, vocab = random.Random(9), vocabulary(9, 60)
    common = [prose(rng, vocab, n) + rng.choice([".", "!", "", "?"]) for n in (3, 6, 12, 40)]
    bits = [*common, "", "É  x\ty."]
    rows = [(i, "".join(rng.choice([*bits, prose(rng, vocab, 8)]) + rng.choice(["\n", " ", " \t", "\r\n"]) for _ in range(rng.randrange(6)))) for i in range(80)]
    rows += [(500, None), (501, ""), (502, common[3].upper() + "  \n" + common[3]), (503, " \n\n .  "), (504, "É. " * 4000)]
    df = docs_frame(spark, rows).withColumn("start", F.lit(1)).withColumn("d1", F.lit(1)).withColumn("__at", F.lit("x"))
    for least in (1, 10):
        assert found(substring_dedup.repeated_units(df, run_words=least)) == sorted(repeats_brute(rows, least), key=str)
    want = repeats_brute(rows, 5)
    cut = {r["doc_id"]: r for r in substring_dedup.without_repeats(docs_frame(spark, rows), run_words=5).collect()}
    for i, t in rows:
        gone = {p for d, a, b, *_ in want if d == i for p in range(a, b)}
        left = [p for s in cut[i]["kept_spans"] for p in range(s["start"], s["end"])]
        assert not gone & set(left) and all((t or "")[p].isspace() for p in set(range(len(t or ""))) - gone - set(left))
        assert cut[i]["text"] == (None if t is None else "".join(t[p] for p in left))
    assert substring_dedup.repeated_units(docs_frame(spark, rows).limit(0)).count() == 0


def test_rows_are_told_apart_by_place(spark):
    line, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    rows = [(1, line), (None, line), (None, other), (3, line + "\n" + other), (3, "mine"), (7, other), (7, other)]
    got = substring_dedup.without_repeats(docs_frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in got) == sorted([("1", line), ("None", ""), ("None", ""), ("3", other), ("3", "mine"), ("7", ""), ("7", "")])
    assert found(substring_dedup.repeated_units(docs_frame(spark, rows))) == sorted(repeats_brute(rows, 30), key=str)


def test_passages_are_found_however_they_are_wrapped_or_embedded(spark):
    rng, vocab = random.Random(10), vocabulary(10, 3000)

    def sentences(n):
        w, out = prose(rng, vocab, n).split(), []
        while w:
            k = rng.randrange(5, 11)
            out.append(" ".join(w[:k]) + ".")
            w = w[k:]
        return out

    rows, planted = [], set()
    for width in range(8, 20):  # wrapped alike
        w = prose(rng, vocab, 51).split()
        lines = [" ".join(w[a : a + width]) for a in range(0, 51, width)]
        lines.insert(2, "")
        for copy in range(3):
            planted |= {len(rows)} if copy else set()
            rows.append((len(rows), "\n".join([prose(rng, vocab, 9), *lines, prose(rng, vocab, 9)])))
    for _ in range(12):  # in the middle of other sentences
        passage = " ".join(sentences(rng.randrange(51, 120)))
        for copy in range(3):
            planted |= {len(rows)} if copy else set()
            rows.append((len(rows), f"{prose(rng, vocab, 12)}. {prose(rng, vocab, 4)} {passage} {prose(rng, vocab, 5)}. {prose(rng, vocab, 9)}."))
    short = sentences(20)
    rows += [(900 + i, " ".join([prose(rng, vocab, 9) + ".", *short, prose(rng, vocab, 9) + "."])) for i in range(20)]
    got = found(substring_dedup.repeated_units(docs_frame(spark, rows)))
    assert {i for i, *_ in got} == planted
    assert got == sorted(repeats_brute(rows, 30), key=str)


def test_a_hot_line_is_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    line = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{line}\nown line number {i} . again") for i in range(300)]
    assert found(substring_dedup.repeated_units(docs_frame(spark, rows))) == sorted(repeats_brute(rows, 30), key=str)
