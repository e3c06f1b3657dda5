"""The pipeline on planted cases, each stage judged on its own input."""

import random

import corpus_pipeline
from tests.llm.util import SCHEMA, prose, vocabulary

INSULTS = ["grumblefoot", "wortbrain", "slimehead"]


def build(path, spark):
    rng, vocab = random.Random(8), vocabulary(8, 2000)
    docs, labels = [], []
    for i in range(240):
        w = prose(rng, vocab, rng.randrange(40, 90)).split()
        if i % 6 == 0:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(INSULTS))
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 6 == 0)))
    bench = [(i, prose(rng, vocab, 30)) for i in range(5)]
    text = dict(docs)
    docs += [(300, text[1]), (301, text[1].upper()), (302, " ".join(text[2].split()[:-1])), (303, text[3] + " " + bench[2][1]), (304, None), (305, ""), (306, None), (307, "short")]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")


def test_stages_drop_what_is_planted_and_nothing_else(spark, tmp_path):
    path = f"file://{tmp_path}"
    build(path, spark)
    docs, dropped = spark.read.parquet(f"{path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        out = stage(spark, docs, path)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{path}/stage{k}")
        docs = spark.read.parquet(f"{path}/stage{k}")
        dropped[name] = before - {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert dropped["toxicity"] == set(range(0, 240, 6))
    assert dropped["exact dedup"] == {300, 301, 305, 306}
    assert dropped["near dedup"] == {302} and dropped["decontamination"] == {303} and dropped["bpe"] == set()
    same = corpus_pipeline.run(spark, path)
    assert sorted(r["ids_sha256"] for r in same.collect()) == sorted(r["ids_sha256"] for r in docs.collect())


def test_verdicts_are_about_rows(spark, tmp_path):
    path = f"file://{tmp_path}"
    build(path, spark)
    rng, vocab = random.Random(9), vocabulary(9, 2000)
    a, b, c, d = (prose(rng, vocab, 60) for _ in range(4))
    bench = spark.read.parquet(f"{path}/benchmark.parquet").first()["text"]
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, a), (None, d), (None, c + " tail"), (4, b + " " + bench), (None, d[:99] + " " + bench), (4, "own text")]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).write.parquet(f"{path}/rows")
    docs = spark.read.parquet(f"{path}/rows")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        stage(spark, docs, path).write.parquet(f"{path}/rows-{name[:2]}")
        docs = spark.read.parquet(f"{path}/rows-{name[:2]}")
    assert sorted((str(r["doc_id"]), r["text"]) for r in docs.collect()) == sorted([("1", a), ("2", b), ("3", c), ("None", d), ("4", "own text")])


def test_empty_documents(spark, tmp_path):
    path = f"file://{tmp_path}"
    build(path, spark)
    spark.read.parquet(f"{path}/documents.parquet").limit(0).write.parquet(f"{path}/empty/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{path}/{t}.parquet").limit(0).write.parquet(f"{path}/empty/{t}.parquet")
    assert corpus_pipeline.run(spark, f"{path}/empty").count() == 0
