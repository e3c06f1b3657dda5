"""Fixtures and brute-force helpers for the corpus operators."""

import random
import re

LOWER = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return [w for w in re.split(r"[ \t\n\x0b\x0c\r]+", (text or "").translate(LOWER)) if w]


def shingles(text, k):
    w = words(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def vocabulary(seed, n=400):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefghiklmnoprstu") for _ in range(rng.randrange(2, 8))) for _ in range(n)]


def prose(rng, vocab, n):
    return " ".join(rng.choice(vocab) for _ in range(n))


def docs_frame(spark, rows, parts=3):
    """rows: (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], SCHEMA).repartition(parts)


def components(ids, links):
    """id -> smallest id reachable."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}
