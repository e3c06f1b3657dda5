"""The backtracking encoder against tiktoken, and exact round trips."""

import hashlib

import numpy as np
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from keystrata.llm import bpe
from tests.llm.util import docs_frame

PATH, PATTERN = bpe.public_tokenizer()
ENCODER = bpe.BytePairEncoder(bpe.read_ranks(PATH), PATTERN)
REFERENCE = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ENCODER.ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="ab ABthe'sé\n 01", max_size=120)))
def test_equals_reference(text):
    text = text.encode("utf-8", "replace").decode()
    ids = ENCODER.encode(text).tolist()
    assert ids == REFERENCE.encode_ordinary(text)
    assert ENCODER.decode(ids).decode() == text


def test_every_token_encodes_to_itself():
    for token, rank in list(ENCODER.ranks.items())[::37]:
        assert ENCODER.encode_piece(token) == [rank]


def test_long_runs_are_linear_and_right():
    for text in ("a" * 20_000, " " * 20_000, "ab" * 9_000, "aaaab" * 4_000, "é" * 5_000):
        assert ENCODER.encode(text).tolist() == REFERENCE.encode_ordinary(text)


def test_slices_and_memo_do_not_change_results(monkeypatch):
    monkeypatch.setattr(bpe, "SLICE", 10)
    monkeypatch.setattr(bpe, "MEMO_PIECES", 3)
    text = "The quick brown fox's   jumps 12 times!! " * 5
    assert ENCODER.encode(text).tolist() == REFERENCE.encode_ordinary(text)


def test_operator_edges_and_decoding(spark):
    rows = [(1, None), (2, ""), (3, "Hello world"), (3, "Hello world"), (4, "<|endoftext|> ünï 中文 🎉\n\n  x"), (None, "z"), (5, "word " * 20_000)]
    df = bpe.encoded(docs_frame(spark, rows), PATH, PATTERN)
    got = sorted(df.collect(), key=lambda r: (str(r["doc_id"]), r["n_tokens"]))
    want = sorted(rows, key=lambda r: (str(r[0]), len(REFERENCE.encode_ordinary(r[1] or ""))))
    for r, (i, t) in zip(got, want):
        ids = REFERENCE.encode_ordinary(t or "")
        assert (r["doc_id"], r["n_tokens"], r["token_ids"]) == (i, len(ids), ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    back = bpe.decoded(df, PATH, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in back) == sorted((str(i), t or "") for i, t in rows)
    assert bpe.encoded(docs_frame(spark, rows).limit(0), PATH, PATTERN).count() == 0
