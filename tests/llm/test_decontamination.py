"""Spaced seeds against brute force over all alignments."""

import itertools
import random

from pyspark.sql import functions as F

from keystrata.llm import decontamination
from keystrata.llm.decontamination import MASKS, OVERLAP, SPAN, contaminated_spans
from tests.llm.util import docs_frame, prose, vocabulary, words


def brute(rows, items):
    out = set()
    for b, it in items:
        iw = words(it)
        for i, t in rows:
            w = words(t)
            for shift in range(-len(iw) + 1, len(w)):
                inside = [w[shift + p] == x for p, x in enumerate(iw) if 0 <= shift + p < len(w)]
                m = sum(inside)
                part = any(sum(inside[a : a + OVERLAP]) * 5 >= 4 * OVERLAP for a in range(len(inside) - OVERLAP + 1))
                if iw and (m == len(iw) if len(iw) < SPAN else m * 5 >= 4 * len(iw) or part):
                    out.add((i, b, max(shift, 0), min(len(w), shift + len(iw)), m, len(iw)))
    return out


def test_equals_brute_force(spark):
    rng, vocab = random.Random(4), vocabulary(4, 3000)
    items = [(i, prose(rng, vocab, rng.randrange(15, 50))) for i in range(12)] + [(100, "tiny item here"), (101, None), (102, ""), (103, "ONE two")]
    rows = []
    for i in range(60):
        w = prose(rng, vocab, rng.randrange(0, 60)).split()
        if i % 2:
            hit = (items[rng.randrange(12)][1]).split()
            for _ in range(rng.randrange(3)):
                hit[rng.randrange(len(hit))] = "changed"
            at = rng.randrange(len(w) + 1)
            w[at:at] = hit
        rows.append((i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, "a Tiny item\nHERE b"), (203, "one"), (204, "one two"), (205, " ".join(items[0][1].split()[2:])), (206, " ".join(items[1][1].split()[:-2]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_frame(spark, rows).withColumn("item_id", F.lit("clash"))
    cols = ["doc_id", "item_id", "word_start", "word_end", "matched", "item_words"]
    want = brute(rows, items)
    # two changed words may leave an alignment without any seed; all others must be found, and nothing else
    got = {tuple(r) for r in contaminated_spans(docs, bench).select(cols).collect()}
    assert got <= want and {x for x in want if x[4] == x[5]} <= got and len(got) >= 0.9 * len(want)
    assert {tuple(r) for r in contaminated_spans(docs, bench, broadcast_rows=0).select(cols).collect()} == got
    assert contaminated_spans(docs.limit(0), bench).count() == 0 == contaminated_spans(docs, bench.limit(0)).count()


def test_masks_ignore_every_position_at_least_once():
    for p in range(SPAN):
        assert any(p not in m for m in MASKS)
    assert all(len(m) == 5 and max(m) < SPAN for m in MASKS)


def test_runs_no_python(spark):
    docs, bench = docs_frame(spark, [(1, "a b")]), spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    plan = contaminated_spans(docs, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_every_copy_within_four_fifths_is_found(spark):
    """Verbatim at every offset, all sets of changed words that the rule allows, and copies cut by the text's ends."""
    vocab = vocabulary(6, 4000)
    items = [(n, " ".join(f"w{n}x{j}" for j in range(n))) for n in range(8, 16)]
    rows = []
    for n, item in items:
        w = item.split()
        rows += [" ".join(vocab[:at] + w + vocab[50:53]) for at in range(10)]
        rows += [" ".join(vocab[:3] + ["changed" if j in gone else x for j, x in enumerate(w)] + vocab[50:52]) for gone in itertools.combinations(range(n), n // 5)]
        rows += [" ".join(w[1:] + vocab[:4]), " ".join(vocab[:4] + w[:-1]), " ".join(w[1:]), " ".join(w[:-1])]
    rows = list(enumerate(rows))
    cols = ["doc_id", "item_id", "word_start", "word_end", "matched", "item_words"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(rows, items)
    assert {i for i, *_ in want} == {i for i, _ in rows}
    for n in (500_000, 0):
        assert {tuple(r) for r in contaminated_spans(docs_frame(spark, rows), bench, broadcast_rows=n).select(cols).collect()} == want


def test_parts_of_long_items_are_found(spark):
    """Long quotations, copies with a word inserted or dropped, and parts with a fifth of the words changed; shorter parts are not."""
    item = [f"w{j}" for j in range(60)]
    other = [f"z{j}" for j in range(9)]
    rng = random.Random(12)
    rows = [other + item[:45] + other, item[20:40], item[:30] + ["new"] + item[30:], item[:30] + item[31:], item[:OVERLAP], item[-OVERLAP:] + other, item[10 : 10 + OVERLAP - 3] + other, item[10:22]]
    for _ in range(30):
        a = rng.randrange(60 - OVERLAP)
        gone = rng.sample(range(a, a + OVERLAP), OVERLAP // 5)
        rows.append(other[: rng.randrange(9)] + ["changed" if j in gone else item[j] for j in range(a, a + OVERLAP)] + other[: rng.randrange(9)])
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    items = [(1, " ".join(item))]
    cols = ["doc_id", "item_id", "word_start", "word_end", "matched", "item_words"]
    want = brute(rows, items)
    assert {i for i, *_ in want} == set(range(38)) - {6, 7}
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n in (500_000, 0):
        assert {tuple(r) for r in contaminated_spans(docs_frame(spark, rows), bench, broadcast_rows=n).select(cols).collect()} == want


def test_rows_that_share_an_identifier_are_told_apart(spark):
    item = " ".join(f"w{j}" for j in range(15))
    seed = " ".join([*item.split()[:8], *(f"x{j}" for j in range(7))])  # a hit at the same alignment that is no copy
    rows = [(i, t) for i in (1, None) for t in (seed, item, seed + " z", item)]
    bench = spark.createDataFrame([(1, item), (1, "another text under this identifier, of more than eight words"), (None, item)], "item_id long, text string")
    for n in (500_000, 0):
        got = contaminated_spans(docs_frame(spark, rows), bench, broadcast_rows=n).select("doc_id", "item_id", "matched").collect()
        assert sorted(map(tuple, got), key=str) == sorted([(i, b, 15) for i in (1, None) for b in (1, None)], key=str)


def test_items_and_seeds_are_made_once(spark, tmp_path, monkeypatch):
    """No later plan reads the benchmark again; copies of its making in one plan burdened the driver."""
    read, write = {}, decontamination.materialize
    monkeypatch.setattr(decontamination, "materialize", lambda df, tag, **more: read.update({tag: df.inputFiles()}) or write(df, tag, **more))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(6)]
    spark.createDataFrame(rows[:3], "item_id long, text string").write.parquet(f"file://{tmp_path}/bench")
    for n in (500_000, 0):
        read.clear()
        got = contaminated_spans(docs_frame(spark, rows), spark.read.parquet(f"file://{tmp_path}/bench"), broadcast_rows=n)
        assert {r["doc_id"] for r in got.collect()} == {0, 1, 2}
        assert [tag for tag, files in read.items() if any("/bench/" in f for f in files)] == ["items"]
        assert not any("/bench/" in f for f in got.inputFiles())
