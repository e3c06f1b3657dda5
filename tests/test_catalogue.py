"""Every registered query of the engine gives the rows of its SQL."""

import os
import re

import duckdb
import pytest

from keystrata.plans import catalogue
from tests.conftest import DATA


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in os.listdir(DATA):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{t}')")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    ran = duck.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in ran.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(str(dict(zip(names, r))[c]) for c in cols) for r in ran.fetchall())


def test_engine_does_not_import_the_corpus_subpackage():
    root = os.path.dirname(catalogue.__file__) + "/.."
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"(from|import) +keystrata\.llm", open(f"{folder}/{f}").read())


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_entry_works_without_the_corpus_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m.startswith("keystrata.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "keystrata.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    again = importlib.reload(entry)
    assert set(again.queries()) == set(catalogue.queries())
    monkeypatch.undo()
    importlib.reload(entry)
