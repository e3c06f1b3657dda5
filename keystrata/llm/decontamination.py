"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words are `[^\\x20\\x09-\\x0D]+` of the text with A-Z lower-cased. A seed is a fixed mask over `SPAN` consecutive
words; the words under its zeros are ignored, so a hit survives substitutions there. Benchmark items and
texts are both hashed at every position, texts also at the one before their first word. The masks are chosen
so that 8 to 15 words of which at most a fifth are changed, wherever, always hold an undisturbed seed; longer
passages can be cut into such pieces, one of which has at most a fifth changed, so no copy within 80 % is
missed. Equal hashes name an item and an alignment (text position minus item position); around each
alignment all words of the item are compared with the text's. The text is contaminated if at least `num/den`
of the item's words agree there, or of any `overlap` (OVERLAP = 13) consecutive words of it: a long part of an item counts,
too, as do the parts beside an inserted or deleted word. `overlap` words of which num/den agree hold an undisturbed
seed as well. Items shorter than SPAN words are hashed whole, at every position of the text, and must agree word for word.

Items and their seeds are written once. Words become 64-bit hashes first and positions are exploded without the text. If a count shows at most
`broadcast_rows` seeds they are broadcast, and positions with no hit go before anything else is done; else
both sides are shuffled by hash. Hits are reduced to (text, item, alignment) with map-side combination, so a
passage that a third of all texts share is no hot group; their texts are then joined back by the row's place,
whole rows once.

Defined cases: null texts or items, and those without words, are never contaminated or contaminating;
repeated rows are reported once per (id, item, alignment); an empty table on either side gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm.common import ROW_KEY, ascii_lower, materialize, row_keyed, table

# Masks of span 8 and weight 5. Any floor(n / 5) changed words among n = 8 ... 15 leave one of them whole somewhere.
MASKS = ((0, 1, 3, 5, 7), (0, 2, 3, 4, 6), (1, 2, 4, 6, 7), (0, 1, 2, 5, 7), (0, 1, 2, 3, 5), (0, 1, 4, 5, 6))
SPAN = 8
BROADCAST_ROWS = 500_000
OVERLAP = 13


def words_of(col: Column) -> Column:
    """The words as an array; null for null."""
    return F.filter(F.split(ascii_lower(col), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def _windows(rows: DataFrame, words: str, keep: list[str], lead: int) -> DataFrame:
    """keep, __at, __h0 ...: the seeds at each position of `words` from -lead on; where a word is missing they match nothing."""
    none = F.array(F.lit(None).cast("long"))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    hashed = rows.select(*keep, (F.concat(none, hashes) if lead else hashes).alias("__hw"))
    each = F.arrays_zip(*(F.slice("__hw", 1 + j, F.size("__hw")) for j in range(SPAN)))
    spread = hashed.select(*keep, F.posexplode(each).alias("__at", "__s")).withColumn("__at", F.col("__at") - lead)
    seeds = (F.xxhash64(F.lit(m), *(F.col("__s")[str(j)] for j in mask)).alias(f"__h{m}") for m, mask in enumerate(MASKS))
    return spread.select(*keep, "__at", *seeds)


def _stacked(windows: DataFrame, keep: list[str]) -> DataFrame:
    """keep, __at, __h: one row per seed."""
    return windows.select(*keep, "__at", F.explode(F.array(*(F.col(f"__h{m}") for m in range(len(MASKS))))).alias("__h"))


def _whole(words: Column) -> Column:
    """A hash of an item shorter than SPAN, by its length and all its words."""
    return F.xxhash64(F.lit(-1), F.size(words), F.array_join(words, " "))


def _whole_slices(words: Column, n: int) -> Column:
    """array<struct<at, h>> of the hashes of all n-word slices; null for shorter texts."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.struct(i.alias("at"), _whole(F.slice(words, i + 1, n)).alias("h"))))


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    num: int = 4, den: int = 5, broadcast_rows: int = BROADCAST_ROWS, overlap: int = OVERLAP,
) -> DataFrame:
    """One row per text, item and alignment that overlap: `id_col`, `item_col`, word_start, word_end, matched, item_words.

    The words are those under the whole item; matched counts the words that agree there.
    """
    spans = contaminated_rows(row_keyed(docs, id_col, text_col), benchmark, id_col, text_col, item_col, item_text_col, num, den, broadcast_rows, overlap)
    return spans.drop(*ROW_KEY).distinct()


def contaminated_rows(
    keyed: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    num: int = 4, den: int = 5, broadcast_rows: int = BROADCAST_ROWS, overlap: int = OVERLAP,
) -> DataFrame:
    """ROW_KEY and the columns of `contaminated_spans`, for each row of `keyed`, which holds ROW_KEY."""
    items = benchmark.select(F.col(item_col).alias("__item"), words_of(F.col(item_text_col)).alias("__iw")).filter(F.size("__iw") > 0)
    items = items.withColumn("__n", F.size("__iw")).withColumn("__ik", F.xxhash64("__iw")).dropDuplicates(["__item", "__ik"])
    # items, seeds and their hashes are written: each is used up to seven times, and plans that build them anew are large
    items = materialize(items, "items", keep=True)
    name = ["__item", "__ik"]
    long = items.filter(F.col("__n") >= SPAN)
    seeds = _stacked(_windows(long, "__iw", [*name, "__n"], 0), [*name, "__n"]).filter(F.col("__at") <= F.col("__n") - SPAN)
    seeds = seeds.select(*name, F.col("__at").alias("__p"), "__h")
    short = items.filter(F.col("__n") < SPAN).select(*name, F.lit(0).alias("__p"), _whole(F.col("__iw")).alias("__h"))
    seeds = materialize(seeds.unionByName(short), "seeds", keep=True)
    small = seeds.limit(broadcast_rows + 1).count() <= broadcast_rows
    lengths = [r[0] for r in items.filter(F.col("__n") < SPAN).select("__n").distinct().collect()]  # at most SPAN - 1 values

    w = F.col("__w")
    texts = keyed.select(*ROW_KEY, F.col(id_col).alias("__id"), F.col(text_col).alias("__text")).filter(F.col("__text").isNotNull())
    tokens = texts.select(*ROW_KEY, words_of(F.col("__text")).alias("__w"))
    probes = _windows(tokens, "__w", ROW_KEY, 1)
    if small:
        # most positions hit nothing: they go before their seeds become rows
        keys = materialize(seeds.select("__h").distinct(), "seed-hashes", keep=True)
        for m in range(len(MASKS)):
            probes = probes.join(F.broadcast(keys.select(F.col("__h").alias(f"__h{m}"), F.lit(True).alias(f"__hit{m}"))), f"__h{m}", "left")
        probes = probes.filter(F.coalesce(*(F.col(f"__hit{m}") for m in range(len(MASKS)))))
    probes = _stacked(probes, ROW_KEY)
    if lengths:
        none = F.array().cast("array<struct<at:int,h:bigint>>")
        slices = tokens.select(*ROW_KEY, F.explode(F.concat(*(F.coalesce(_whole_slices(w, n), none) for n in lengths))).alias("s"))
        probes = probes.unionByName(slices.select(*ROW_KEY, F.col("s.at").alias("__at"), F.col("s.h").alias("__h")))
    hits = probes.join(F.broadcast(seeds) if small else seeds, "__h")
    spots = materialize(hits.select(*ROW_KEY, *name, (F.col("__at") - F.col("__p")).alias("__shift")).distinct(), "alignments")

    few = spots.limit(broadcast_rows + 1).count() <= broadcast_rows
    whole = texts.join(F.broadcast(spots) if few else spots, ROW_KEY)
    near = whole.select(*ROW_KEY, "__id", "__item", "__ik", "__shift", words_of(F.col("__text")).alias("__w"))
    near = near.withColumnsRenamed({"__item": "__item2", "__ik": "__ik2"})
    near = near.join(items, (F.col("__ik") == F.col("__ik2")) & F.col("__item").eqNullSafe(F.col("__item2")))
    near = near.withColumn("__text", F.slice("__w", F.greatest("__shift", F.lit(0)) + 1, F.col("__n") + F.least("__shift", F.lit(0))))
    lead = F.greatest(-F.col("__shift"), F.lit(0))
    part = F.slice("__iw", lead + 1, F.size("__text"))
    near = near.withColumn("__same", F.zip_with("__text", part, lambda a, b: (a == b).cast("int")))
    agree = F.size(F.filter("__same", lambda x: x == 1))
    # the most agreeing words of any `overlap` neighbours: each step adds a word and takes the one `overlap` before it off
    gains = F.zip_with("__same", F.slice(F.concat(F.array_repeat(F.lit(0), overlap), "__same"), F.lit(1), F.size("__same")), lambda x, old: x - old)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    step = lambda acc, x: F.struct((acc["now"] + x).alias("now"), F.greatest(acc["best"], acc["now"] + x).alias("best"))
    most = F.when(F.size("__same") >= overlap, F.aggregate(gains, start, step)["best"]).otherwise(0)
    out = near.select(*ROW_KEY, "__id", "__item", "__shift", "__n", F.size("__text").alias("__len"), agree.alias("__m"), most.alias("__most"))
    part_agrees = F.col("__most") * den >= overlap * num
    out = out.filter(F.when(F.col("__n") < SPAN, F.col("__m") == F.col("__n")).otherwise((F.col("__m") * den >= F.col("__n") * num) | part_agrees))
    return out.select(
        *ROW_KEY, F.col("__id").alias(id_col), F.col("__item").alias(item_col), F.greatest("__shift", F.lit(0)).cast("long").alias("word_start"),
        (F.greatest("__shift", F.lit(0)) + F.col("__len")).cast("long").alias("word_end"), F.col("__m").cast("long").alias("matched"), F.col("__n").cast("long").alias("item_words"),
    ).distinct()


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
