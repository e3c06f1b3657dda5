"""MinHash near-deduplication with Odd sketches.

1. One Arrow pass gives each text its set size, a 64-bit class id of its shingle set, `bands` band keys of
   `rows` MinHash samples each, and an Odd sketch: sample i flips bit hash(i, minimum) of a parity bitmap, so
   the population count of the XOR of two bitmaps tells how many samples differ. A second, wider parity bitmap
   of all shingles tells the size of the symmetric difference.
2. Texts with equal sets form a class; from here on only classes are compared.
3. Classes that share a band key are candidates. First each is compared with a few bucket heads (star links,
   linear in the input); links the sketches can't exclude are confirmed on full sets; components follow.
4. Buckets whose members already share a component are done. In the others every pair from different
   components is compared, in blocks, by sketch; the largest component of a bucket is compared only with the
   rest, never with itself. Of the pairs the sketches put clearly over the threshold, a block emits only a
   spanning forest; pairs too close to call are emitted if that forest doesn't join them already. All emitted
   pairs are confirmed on full sets. Should a clear pair ever fail, the blocks run again without the forest.

A pair at the threshold shares no band with probability (1 - t^rows)^bands (3e-6 with the defaults at 0.85),
and the sketch filter lies `z` standard deviations under the threshold. Everything that passes is exact.

Defined cases: null text or no words: an empty set, linked with nothing, and kept; fewer than k words: the whole
sequence is the one shingle; repeated identifiers are separate rows, told apart by place, and one row of a component
is kept; a null identifier takes part, and its component is the smallest non-null identifier (null if there is
none); empty table: empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.llm import kernels as K
from keystrata.llm.common import ROW_KEY, attach_group, materialize, passing_tables, row_keyed, table
from keystrata.llm.components import connected_components

ROWS, BANDS, SKETCH_BITS, WIDE_BITS = 8, 40, 512, 2048
SAMPLES = ROWS * BANDS
BLOCK = 2048
SIG_SCHEMA = "`__file` long, `__row` long, doc_id long, n_shingles long, cid long, sketch array<long>, wide binary, bands array<long>"

_A = (K.seeded(SAMPLES, 11) & K.U64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)
_B = (K.seeded(SAMPLES, 12) & K.U64(0xFFFFFFFF)).astype(np.uint32)
_BAND_MULT = K.seeded(ROWS, 13) | K.U64(1)
_BAND_SALT = K.seeded(BANDS, 14)
_SAMPLE_SALT = K.seeded(SAMPLES, 15)
_SET_MULT = K.U64(int(K.seeded(1, 16)[0]) | 1)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima over a non-empty set."""
    x = (shingles >> K.U64(32)).astype(np.uint32)
    out = None
    for i in range(0, len(x), 256):
        low = np.minimum.reduce(x[i : i + 256, None] * _A + _B, axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def odd_sketch(sig: np.ndarray) -> np.ndarray:
    """The samples' parity bitmap, SKETCH_BITS wide, as 64-bit words. sig: one row of minima a set."""
    bit = (K.mix64(sig.astype(K.U64) + _SAMPLE_SALT) % K.U64(SKETCH_BITS)).astype(np.int64)
    flips = np.zeros((len(sig), SKETCH_BITS), dtype=np.uint16)
    np.add.at(flips, (np.repeat(np.arange(len(sig)), SAMPLES), bit.ravel()), 1)
    return np.packbits((flips & 1).astype(np.uint8), axis=1).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> bytes:
    """The parity bitmap of a whole set, WIDE_BITS wide, packed."""
    flips = np.bincount((shingles % K.U64(WIDE_BITS)).astype(np.int64), minlength=WIDE_BITS)
    return np.packbits((flips & 1).astype(np.uint8)).tobytes()


def wide_limits(total: np.ndarray, num: int, den: int, z: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Odd bits of two wide sketches up to which a pair with `total` = |A| + |B| is clearly over num/den, and above which clearly under."""
    diff = total * (den - num) / (den + num)
    n = WIDE_BITS
    mean = n / 2 * -np.expm1(diff * np.log1p(-2 / n))
    fade = np.exp(-4 * diff / n)
    slack = z * np.sqrt(np.maximum(n / 4 * (1 - fade) - diff * fade, 0.25)) + 1
    return mean - slack, mean + slack


def set_id(shingles: np.ndarray) -> np.int64:
    """One hash of a sorted set."""
    return K.signed(K.mix64(K.mix64(shingles * _SET_MULT).sum(dtype=K.U64, keepdims=True) + K.U64(len(shingles))))[0]


def most_odd_bits(num: int, den: int, z: float = 5.0) -> int:
    """The sketch filter: pairs with more odd bits are under num/den by more than z standard deviations."""
    t = num / den
    low = t - z * math.sqrt(t * (1 - t) / SAMPLES)
    n, flips = SKETCH_BITS, 2 * SAMPLES * (1 - low)
    mean = n / 2 * (1 - (1 - 2 / n) ** flips)
    return math.ceil(mean + z * math.sqrt(n * 0.25 * (1 - (1 - 2 / n) ** (2 * flips))) / 2)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """SIG_SCHEMA for each row of docs (ROW_KEY, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(3))
            for i, j in K.doc_chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low = K.lower_bytes(data[offsets[i] : offsets[j]])
                starts, ends, counts = K.word_spans(low, own)
                sizes, cids, sigs, full, wides = [], [], [], [], []
                for at, s in enumerate(K.shingle_sets(K.word_hashes(low, starts, ends), counts, k)):
                    sizes.append(len(s))
                    if len(s):
                        cids.append(set_id(s))
                        sigs.append(minhash(s))
                        wides.append(wide_sketch(s))
                        full.append(at)
                n = j - i
                cid = np.zeros(n, np.int64)
                has = np.zeros(n, bool)
                wide: list = [None] * n
                sketches, bands = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
                if full:
                    cid[full], has[full] = cids, True
                    sig = np.stack(sigs)
                    key = (sig.reshape(len(full), BANDS, ROWS).astype(K.U64) * _BAND_MULT).sum(axis=2, dtype=K.U64)
                    key = K.signed(K.mix64(K.mix64(key) + _BAND_SALT))
                    for at, s, v, b in zip(full, odd_sketch(sig), wides, key):
                        sketches[at], wide[at], bands[at] = s, v, b
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, n) for c in range(3)), pa.array(sizes, pa.int64()), pa.array(cid, mask=~has), K.list_array(sketches), pa.array(wide, pa.binary()), K.list_array(bands)],
                    [*ROW_KEY, "doc_id", "n_shingles", "cid", "sketch", "wide", "bands"],
                )

    return docs.mapInArrow(run, SIG_SCHEMA)


def shingle_table(docs: DataFrame, k: int) -> DataFrame:
    """(cid, shingles) of each row of docs (cid, text) whose text has that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.column_bytes(batch.column(1))
            want = np.asarray(batch.column(0).fill_null(0))
            for i, j in K.doc_chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                low = K.lower_bytes(data[offsets[i] : offsets[j]])
                starts, ends, counts = K.word_spans(low, own)
                sets = list(K.shingle_sets(K.word_hashes(low, starts, ends), counts, k))
                hit = [at for at, s in enumerate(sets) if len(s) and set_id(s) == want[i + at]]
                yield pa.RecordBatch.from_arrays([pa.array(want[i:j][hit]), K.list_array([K.signed(sets[at]) for at in hit])], ["cid", "shingles"])

    return docs.mapInArrow(run, "cid long, shingles array<long>")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have den * intersection >= num * union."""
    sa, sb = sets.select(F.col("cid").alias("a"), F.col("shingles").alias("sa")), sets.select(F.col("cid").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(sa, "a").join(sb, "b")
    both = both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return both.filter(F.col("common") * den >= (F.col("na") + F.col("nb") - F.col("common")) * num).select("a", "b")


OPEN = ["bkey", "i", "j", "left", "cid", "comp", "n", "minor", "sketch", "wide", "bands"]
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("ca", pa.int64()), ("cb", pa.int64()), ("odd", pa.int32()), ("clear", pa.bool_())])


def cross_pairs(limit: int, num: int, den: int, forest: bool):
    """A function for mapInArrow over OPEN rows sorted by (bkey, i, j): pairs to confirm.

    Each run of equal keys is one block of a bucket's minority against one block of the bucket. A pair counts
    only in the first band the two share, only if their components differ, their sizes allow the threshold
    and neither sketch excludes it.
    """

    def block(c: dict[str, np.ndarray], key: int) -> list[tuple]:
        li, ri = np.flatnonzero(c["left"]), np.flatnonzero(~c["left"])
        if not len(li) or not len(ri):
            return []
        rc, rn, rid, minor = c["comp"][ri], c["n"][ri], c["cid"][ri], c["minor"][ri]
        rs, rw, rb = c["sketch"][ri], c["wide"][ri], c["bands"][ri]
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root.get(x, x)) != x:
                root[x] = root.get(y, y)
                x = y
            return x

        out, near = [], []
        for x in li:
            n, me = c["n"][x], c["cid"][x]
            ok = np.flatnonzero((rc != c["comp"][x]) & (np.minimum(rn, n) * den >= np.maximum(rn, n) * num) & ~(minor & (rid <= me)))
            if not len(ok):
                continue
            odd = np.bitwise_count(rs[ok] ^ c["sketch"][x]).sum(axis=1, dtype=np.int32)
            keep = odd <= limit
            ok, odd = ok[keep], odd[keep]
            if not len(ok):
                continue
            diff = np.bitwise_count(rw[ok] ^ c["wide"][x]).sum(axis=1, dtype=np.int32)
            sure, most = wide_limits((rn[ok] + n).astype(np.float64), num, den)
            first = c["bands"][x][(rb[ok] == c["bands"][x]).argmax(axis=1)] == key
            keep = first & (diff <= most)
            for at, o, clear in zip(ok[keep].tolist(), odd[keep].tolist(), (diff < sure)[keep].tolist()):
                ca, cb = int(c["comp"][x]), int(rc[at])
                row = (int(me), int(rid[at]), ca, cb, o, clear)
                if forest and clear:
                    ra, rb_ = find(ca), find(cb)
                    if ra != rb_:
                        root[ra] = rb_
                        out.append(row)
                else:
                    near.append(row)
        return out + [r for r in near if not forest or find(r[2]) != find(r[3])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(part: pa.Table) -> Iterator[pa.RecordBatch]:
            part = part.combine_chunks()
            n = part.num_rows
            c = {k: part[k].to_numpy() for k in ("bkey", "i", "j", "cid", "comp", "n")} | {k: part[k].combine_chunks().to_numpy(zero_copy_only=False) for k in ("left", "minor")}
            c["wide"] = np.frombuffer(b"".join(part["wide"].to_pylist()), dtype=np.uint64).reshape(n, -1)
            for k in ("sketch", "bands"):
                c[k] = part[k].combine_chunks().flatten().to_numpy().reshape(n, -1)
            c["sketch"] = c["sketch"].view(np.uint64)
            new = np.ones(n, bool)
            new[1:] = (c["bkey"][1:] != c["bkey"][:-1]) | (c["i"][1:] != c["i"][:-1]) | (c["j"][1:] != c["j"][:-1])
            cut = np.append(np.flatnonzero(new), n)
            rows = [r for a, b in zip(cut, cut[1:]) for r in block({k: v[a:b] for k, v in c.items()}, c["bkey"][a])]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PAIRS.types)], schema=PAIRS)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = tuple(batch.column(i)[-1].as_py() for i in range(3))
            same = np.ones(batch.num_rows, bool)
            for i in range(3):
                same &= batch.column(i).to_numpy(zero_copy_only=False) == last[i]
            tail = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
            if same.all() and held and tuple(held[-1].column(i)[-1].as_py() for i in range(3)) == last:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, tail)])
            if whole.num_rows:
                yield from done(whole)
            held = [batch.slice(tail)]
        if held:
            yield from done(pa.Table.from_batches(held))

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """One row per input row: `id_col`, n_shingles, component_id, kept.

    Two texts are linked if den * |intersection| >= num * |union| of their distinct k-word shingles; a
    component takes the smallest identifier it holds. The default is five words and 0.8.
    """
    return near_verdicts(row_keyed(docs, id_col, text_col), id_col, text_col, k, num, den).drop(*ROW_KEY).withColumnRenamed("doc_id", id_col)


def near_verdicts(keyed: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """ROW_KEY, doc_id, n_shingles, component_id, kept of each row of `keyed`, which holds ROW_KEY."""
    slim = keyed.select(*ROW_KEY, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with passing_tables(keyed.sparkSession):
        return materialize(_near_duplicates(slim, k, num, den), "near-duplicates", keep=True)


def _near_duplicates(slim: DataFrame, k: int, num: int, den: int) -> DataFrame:
    sig = materialize(signatures(slim, k), "sig")
    limit = most_odd_bits(num, den)

    # classes of equal sets, each with the place of one of its texts; sets too small to differ and still reach the threshold need no bands
    picked = F.min(F.struct(*ROW_KEY, "n_shingles", "sketch", "wide", "bands"))
    classes = sig.filter("cid is not null").groupBy("cid").agg(picked.alias("x")).select("cid", "x.*")
    classes = materialize(classes, "classes")
    least = -(-num // max(den - num, 1))
    banded = classes.filter(F.col("n_shingles") >= least).select("cid", F.explode("bands").alias("bkey"))
    heads = banded.groupBy("bkey").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct(F.xxhash64("cid", "bkey"), "cid")).alias("h"))
    heads = heads.filter("size > 1").select("bkey", F.col("h.cid").alias("head"))
    members = materialize(banded.join(heads, "bkey"), "members")
    if members.isEmpty():
        comp = None
    else:
        comp = _linked(slim, classes, members, limit, k, num, den)

    base = sig.select(*ROW_KEY, "doc_id", "n_shingles", "cid")
    if comp is not None:
        base = base.join(comp.select(F.col("node").alias("cid"), F.col("comp")), "cid", "left")
    else:
        base = base.withColumn("comp", F.lit(None).cast("long"))
    base = base.select(*ROW_KEY, "doc_id", "n_shingles", F.coalesce("comp", "cid").alias("__comp"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", *ROW_KEY)
    linked = attach_group(base.filter("__comp is not null"), ["__comp"], F.hash(*ROW_KEY), {"__best": (F.min(first), "min")})
    kept = (F.col("__file") == F.col("__best.__file")) & (F.col("__row") == F.col("__best.__row"))
    out = linked.select(*ROW_KEY, "doc_id", "n_shingles", F.col("__best.doc_id").alias("component_id"), kept.alias("kept"))
    return out.unionByName(base.filter("__comp is null").select(*ROW_KEY, "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")))


def _linked(slim: DataFrame, classes: DataFrame, members: DataFrame, limit: int, k: int, num: int, den: int) -> DataFrame:
    active = members.select("cid").distinct().join(classes, "cid")
    active = materialize(active, "active")
    texts = slim.join(active.select("cid", *ROW_KEY), ROW_KEY).select("cid", "text")
    sets = materialize(shingle_table(texts, k).dropDuplicates(["cid"]), "sets")

    # star links: each class with the two bucket heads most like it
    sk = active.select("cid", "sketch", F.col("n_shingles").alias("n"))
    stars = members.filter("cid <> head").select(F.col("cid").alias("a"), F.col("head").alias("b")).distinct()
    stars = stars.join(sk.select(F.col("cid").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    stars = stars.join(sk.select(F.col("cid").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    stars = stars.select("a", "b", odd_bits("sa", "sb").alias("odd")).filter(F.col("odd") <= limit)
    best = stars.groupBy("a").agg(F.min(F.struct("odd", "b")).alias("x"), F.max(F.struct(-F.col("odd"), "b")).alias("y"))
    best = best.select("a", F.explode(F.array_distinct(F.array("x.b", "y.b"))).alias("b"))
    links = materialize(confirm(best, sets, num, den), "star-links")
    comp = materialize(connected_components(links, tag="star"), "star-comp")

    # buckets that still hold different components
    labels = comp.select(F.col("node").alias("cid"), "comp")
    labelled = members.select("cid", "bkey").join(labels, "cid", "left").select("cid", "bkey", F.coalesce("comp", "cid").alias("comp"))
    mix = labelled.groupBy("bkey", "comp").agg(F.count(F.lit(1)).alias("n"))
    mix = mix.groupBy("bkey").agg(F.count(F.lit(1)).alias("kinds"), F.max(F.struct("n", "comp")).alias("major"), F.sum("n").alias("size"))
    mix = mix.filter("kinds > 1").select("bkey", F.col("major.comp").alias("major"), F.col("size"), (F.col("size") - F.col("major.n")).alias("few"))
    open_rows = labelled.join(mix, "bkey").join(active.select("cid", "sketch", "wide", "bands", F.col("n_shingles").alias("n")), "cid")
    open_rows = open_rows.withColumn("minor", F.col("comp") != F.col("major")).withColumn("nb", F.ceil(F.col("few") / BLOCK)).withColumn("nr", F.ceil(F.col("size") / BLOCK))
    cols = ["bkey", "cid", "comp", "sketch", "wide", "bands", "n", "minor"]
    block = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), F.col(n))
    left = open_rows.filter("minor").select(*cols, F.lit(True).alias("left"), block("nb", 1).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nr") - 1)).alias("j"))
    right = open_rows.select(*cols, F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("nb") - 1)).alias("i"), block("nr", 2).alias("j"))
    blocks = left.unionByName(right).select(OPEN).repartition("bkey", "i", "j").sortWithinPartitions("bkey", "i", "j")
    schema = "a long, b long, ca long, cb long, odd int, clear boolean"
    pairs = materialize(blocks.mapInArrow(cross_pairs(limit, num, den, True), schema), "pairs")
    if pairs.isEmpty():
        return comp
    found = materialize(confirm(pairs.dropDuplicates(["a", "b"]), sets, num, den), "links")
    failed = pairs.filter("clear").select("a", "b").join(found, ["a", "b"], "left_anti")
    if not failed.isEmpty():
        pairs = blocks.mapInArrow(cross_pairs(limit, num, den, False), schema)
        found = materialize(confirm(pairs.dropDuplicates(["a", "b"]), sets, num, den), "all-links")
    return comp if found.isEmpty() else _merged(comp, found, "rest")


def _merged(comp: DataFrame, links: DataFrame, tag: str) -> DataFrame:
    """Components after adding links."""
    tie = comp.select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return connected_components(links.select("a", "b").unionByName(tie), tag=tag)


def odd_bits(a: str, b: str):
    """Population count of the XOR of two sketches, natively."""
    total = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        total = total + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return total


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, num=85, den=100)


OP1_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * p.c >= 85 * (x.n + y.n - p.c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, both_ways.b FROM r JOIN both_ways ON both_ways.a = r.u),
c AS (SELECT v AS doc_id, min(u) AS component_id FROM r GROUP BY v)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""
