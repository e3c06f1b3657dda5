"""Substring deduplication by hashing lines and the sentences within them.

Each text is cut into units: at line feeds, and within a line after a word that ends in `.`, `!` or `?`. A unit is
normalised (A-Z lower-cased, runs of white space made one space, trimmed) and hashed to 128 bits. Digests are
counted over the whole corpus; of equal units the one with the smallest (doc_id, offset) stays, every other one
is repeated. A repeated unit is reported, with its offsets in the original text, if the run of consecutive repeated units
it lies in holds at least `run_words` words together: a passage is judged by its own length, however it is
wrapped and wherever in a line it starts. The first and the last sentence of a passage copied into the middle
of others is no whole unit, so the length asked for (RUN_WORDS = 30) is less than that of the passages meant
(over 50 words). Shorter repeats are left alone: short sentences and lines recur in honest text.

Counting combines on the map side; the few digests that own a large share of all units are broadcast (their
number is bounded), so a line that stands in a third of all texts is no hot key. Rows are told apart by their
place, not by identifier.

Defined cases: null or empty text has no unit; a repeat inside one document counts; rows with equal identifiers
are separate, and of equal units in equal rows one stays; a null identifier ranks last; empty table: empty
result; other columns are ignored by `repeated_units` and kept by `without_repeats`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.llm import kernels as K
from keystrata.llm.common import ROW_KEY, join_groups, materialize, passing_tables, row_keyed, table

RUN_WORDS = 30
UNITS = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in ROW_KEY), ("no", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])
_STOP = np.zeros(256, dtype=bool)
_STOP[[33, 46, 63]] = True
_PLACE = K.seeded(2, 21) | K.U64(1)
_SALT = K.seeded(2, 22)


def units_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, number within it, start, end, words, digest, digest) of each unit; offsets are code points of the document."""
    low = K.lower_bytes(data)
    starts, ends, counts = K.word_spans(low, offsets)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return (none,) * 7
    h = K.word_hashes(low, starts, ends)
    feeds = np.concatenate([[0], np.cumsum(data == 10)])
    opens = np.ones(len(starts), bool)
    opens[1:] = (feeds[starts[1:]] != feeds[ends[:-1]]) | _STOP[data[ends[:-1] - 1]]
    opens[(np.cumsum(counts) - counts)[counts > 0]] = True
    first = np.flatnonzero(opens)
    size = np.diff(np.append(first, len(starts)))
    place = (np.arange(len(starts)) - np.repeat(first, size) + 1).astype(K.U64)
    digests = [K.mix64(np.add.reduceat(K.mix64((h ^ salt) + place * by), first) + size.astype(K.U64)) for by, salt in zip(_PLACE, _SALT)]
    doc = np.repeat(np.arange(len(counts)), counts)[first]
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    base = before[offsets[doc]]
    no = np.arange(len(first)) - np.searchsorted(doc, doc)
    return doc, no, before[starts[first]] - base, before[ends[first + size - 1]] - base, size, K.signed(digests[0]), K.signed(digests[1])


def units(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """UNITS, one row per unit of `keyed`, which holds ROW_KEY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(3))
            for i, j in K.doc_chunks(offsets, 4 << 20):
                doc, *cols = units_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                own = [batch.column(c).slice(i, j - i).take(pa.array(doc)) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(c, t) for c, t in zip(cols, UNITS.types[3:]))], schema=UNITS)

    ids = F.col(id_col).cast("long").alias("doc_id")
    schema = ", ".join(f"`{f.name}` {'int' if f.type == pa.int32() else 'long'}" for f in UNITS)
    return keyed.select(ids, *ROW_KEY, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def _repeats(keyed: DataFrame, id_col: str, text_col: str, run_words: int) -> DataFrame:
    """ROW_KEY, doc_id, start, end, n_words, keep_doc_id, keep_start of each unit to remove."""
    with passing_tables(keyed.sparkSession):
        rows = materialize(units(keyed, id_col, text_col), "units")
        again = materialize(rows.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-digests")
        hits = materialize(join_groups(rows, again, ["d1", "d2"], "n", rows.count()), "repeated-units")
        rank = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "start", *ROW_KEY)
        firsts = materialize(hits.groupBy("d1", "d2").agg(F.min(rank).alias("k"), F.count(F.lit(1)).alias("n")), "first-units")
        later = join_groups(hits.drop("n"), firsts, ["d1", "d2"], "n", hits.count())
        later = later.filter(~((F.col("__file") == F.col("k.__file")) & (F.col("__row") == F.col("k.__row")) & (F.col("start") == F.col("k.start"))))
        # consecutive units keep the same distance between their number and their place among the repeated ones
        later = later.withColumn("run", F.col("no") - F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("no")))
        later = later.withColumn("run_words", F.sum("n_words").over(Window.partitionBy(*ROW_KEY, "run"))).filter(F.col("run_words") >= run_words)
        out = later.select(*ROW_KEY, "doc_id", "start", "end", "n_words", F.col("k.doc_id").alias("keep_doc_id"), F.col("k.start").alias("keep_start"))
        return materialize(out, "repeats", keep=True)


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """The units to remove: `id_col`, start, end, n_words, keep_doc_id, keep_start."""
    return _repeats(row_keyed(docs, id_col, text_col), id_col, text_col, run_words).drop(*ROW_KEY).withColumnRenamed("doc_id", id_col)


def remove_units(text: str | None, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and the original (start, end) of what is left.

    The white space after a span goes with it, the line feed only if the span starts its line.
    """
    text, at, left = text or "", 0, []
    for start, end in sorted(spans):
        begin = max(at, start)
        while end < len(text) and text[end] in " \t\r\x0b\x0c":
            end += 1
        if end < len(text) and text[end] == "\n" and (begin == at and (at == 0 or text[at - 1] == "\n") or text[:start].rpartition("\n")[2].strip() == ""):
            end += 1
        if begin > at:
            left.append((at, begin))
        at = max(at, end)
    if at < len(text):
        left.append((at, len(text)))
    return "".join(text[a:b] for a, b in left), left


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """docs with repeated units cut out of `text_col`, and `kept_spans`, the original offsets of what is left; joined by row, not by identifier."""
    keyed = row_keyed(docs)
    spans = _repeats(keyed, id_col, text_col, run_words).groupBy(*ROW_KEY).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))

    @F.udf("struct<text: string, spans: array<struct<start: long, end: long>>>", useArrow=True)
    def cut(text, spans):
        out, left = remove_units(text, [(s["start"], s["end"]) for s in spans or []])
        return out, left

    done = keyed.join(spans, ROW_KEY, "left").withColumn("__cut", cut(F.col(text_col), F.col("__spans")))
    done = done.withColumn(text_col, F.when(F.col(text_col).isNotNull(), F.col("__cut.text"))).withColumn("kept_spans", F.col("__cut.spans"))
    return done.select(*docs.columns, "kept_spans")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_units(table(spark, sf_dir, "documents"))


OP8_SQL = """
WITH raw AS (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS parts,
    length(regexp_extract(text, '^[\\x20\\x09-\\x0D]*')) AS lead FROM documents WHERE text IS NOT NULL),
tok AS (SELECT doc_id, lead, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM raw),
pos AS (SELECT doc_id, i, regexp_extract(part, '^[^\\x20\\x09-\\x0D]+') AS word, contains(part, chr(10)) AS feed,
    lead + coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot FROM tok),
cut AS (SELECT *, coalesce(sum(CASE WHEN feed OR right(word, 1) IN ('.', '!', '?') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS no FROM pos),
u AS (SELECT doc_id, no, CAST(min(spot) AS BIGINT) AS start, CAST(max(spot + length(word)) AS BIGINT) AS "end", CAST(count(*) AS INTEGER) AS n_words,
    translate(string_agg(word, ' ' ORDER BY i), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM cut GROUP BY doc_id, no),
k AS (SELECT *, first_value(doc_id) OVER o AS keep_doc_id, first_value(start) OVER o AS keep_start FROM u WINDOW o AS (PARTITION BY t ORDER BY doc_id, start)),
hit AS (SELECT *, no - row_number() OVER (PARTITION BY doc_id ORDER BY no) AS run FROM k WHERE NOT (doc_id = keep_doc_id AND start = keep_start)),
w AS (SELECT *, sum(n_words) OVER (PARTITION BY doc_id, run) AS run_words FROM hit)
SELECT doc_id, start, "end", n_words, keep_doc_id, keep_start FROM w WHERE run_words >= 30
"""
