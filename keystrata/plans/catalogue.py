"""The registered queries: the engine's operators over the driver's tables, and the SQL each must agree with.

The events table is read as a change log: k a user, seq the event, a delete where the event is an error, v its
properties, and one run for each 128 events.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keystrata.functions.scalar import bloom_bits, level_budget, log_bytes, padded_key, size_bucket, user_bytes
from keystrata.operators import compaction, lookup, resolve
from keystrata.operators.separation import dereference, split_values
from keystrata.plans.store import Options, Store

K = {"key": "k", "order": "seq"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, seq, op, v, run) of the events table."""
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    return e.select(
        padded_key(F.col("user_id"), "user", 6).alias("k"), F.col("event_id").alias("seq"), F.when(error, 1).otherwise(0).alias("op"),
        F.when(error, "").otherwise(F.col("props")).alias("v"), F.floor(F.col("event_id") / 128.0).cast("long").alias("run"),
    )


def run_rows(log: DataFrame) -> DataFrame:
    """What the flush of each run writes: one row per key and run."""
    return resolve.newest_per_key(log, ["run", "k"], "seq")


def run_sizes(runs: DataFrame) -> DataFrame:
    return runs.groupBy("run").agg(
        F.count(F.lit(1)).alias("records"), F.min("k").alias("min_key"), F.max("k").alias("max_key"), F.sum(log_bytes(F.col("k"), F.col("v"))).alias("bytes")
    )


def live_view(spark, sf):
    return resolve.live_view(change_log(spark, sf), **K).select("k", "v")


def point_get(spark, sf):
    return lookup.point_get(change_log(spark, sf), "user000042", "k").select("k", "v")


def point_get_deleted(spark, sf):
    log = change_log(spark, sf)
    first = resolve.tombstones(resolve.newest_per_key(log, **K)).agg(F.min("k").alias("k"))
    return resolve.live_view(log.join(F.broadcast(first), "k", "left_semi"), **K).select("k", "v")  # one row is broadcast


def multi_get(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(padded_key(F.col("c_custkey"), "user", 6).alias("k"))
    return lookup.multi_get(change_log(spark, sf), wanted, "k").select("k", "v")


def range_scan(spark, sf):
    return lookup.range_scan(change_log(spark, sf), "user000010", "user000050", "k").select("k", "v")


def range_scan_empty(spark, sf):
    return lookup.range_scan(change_log(spark, sf), "user000050", "user000050", "k").select("k", "v")


def tombstones(spark, sf):
    return resolve.tombstones(resolve.newest_per_key(change_log(spark, sf), **K)).select("k", "seq")


def revived_keys(spark, sf):
    return resolve.revived(change_log(spark, sf), "k")


def filter_after_resolve(spark, sf):
    return resolve.live_view(change_log(spark, sf), **K).filter(F.col("v").like("%9}")).select("k", "v")


def run_flush(spark, sf):
    return run_rows(change_log(spark, sf)).select("run", "k", "seq", "op", "v")


def run_stats(spark, sf):
    return run_sizes(run_rows(change_log(spark, sf)))


def size_bucket_query(spark, sf):
    return run_stats(spark, sf).select("run", size_bucket(F.col("bytes")).alias("bucket"))


def compact_tiered_keep(spark, sf):
    """Every four neighbouring runs merged; what is older stays outside, so tombstones stay."""
    rows = run_rows(change_log(spark, sf)).withColumn("merge", F.floor(F.col("run") / 4.0).cast("long"))
    return resolve.merge_runs(rows, False, ["merge", "k"], "seq").select("merge", "k", "seq", "op", "v")


def compact_tiered_drop(spark, sf):
    """The older half of all runs merged; nothing older is left out, so tombstones go."""
    log = change_log(spark, sf)
    half = log.agg(F.floor(F.max("run") / 2.0).alias("half"))
    rows = run_rows(log).join(F.broadcast(half), F.col("run") <= F.col("half")).drop("half")  # one row is broadcast
    return resolve.merge_runs(rows, True, **K).select("k", "seq", "v")


def compact_all(spark, sf):
    return resolve.merge_runs(change_log(spark, sf), True, **K).select("k", "seq", "v")


def pick_tiered(spark, sf):
    size = F.sum(F.when(F.pmod("run", F.lit(5)) == 2, 1).otherwise(9))
    runs = run_rows(change_log(spark, sf)).groupBy("run").agg(size.alias("bytes")).select("run", size_bucket(F.col("bytes")).alias("bucket"))
    return compaction.size_tiers(runs).filter("n >= 2")


def level_overlap(spark, sf):
    """Every run with the slots of ten users its key range meets: candidates by slot number, then the ranges compared."""
    number = F.substring("k", 5, 12).cast("long")
    runs = run_rows(change_log(spark, sf)).groupBy("run").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.min(number).alias("from"), F.max(number).alias("to"))
    runs = runs.withColumn("slot", F.explode(F.sequence(F.floor(F.col("from") / 10.0), F.floor(F.col("to") / 10.0))))
    user = F.col("user_id")
    slots = table(spark, sf, "events").groupBy(F.floor(user / 10.0).cast("long").alias("slot")).agg(
        padded_key(F.min("user_id"), "user", 6).alias("slot_lo"), padded_key(F.max("user_id"), "user", 6).alias("slot_hi")
    )
    return runs.join(slots, "slot").filter((F.col("slot_hi") >= F.col("lo")) & (F.col("slot_lo") <= F.col("hi"))).select("run", "slot")


def level_split(spark, sf):
    rows = resolve.live_view(change_log(spark, sf), **K)
    return compaction.split_points(rows, log_bytes(F.col("k"), F.col("v")), 1000.0, "k", 8).select("k", "file_no")


def level_budget_query(spark, sf):
    """Bytes and budget of each level, with the runs dealt to nine levels."""
    level = (F.pmod("run", F.lit(9)) + 1).alias("level")
    runs = run_rows(change_log(spark, sf)).groupBy(level).agg(F.sum(F.octet_length("v")).cast("long").alias("bytes"))
    return runs.withColumn("budget", level_budget(F.col("level"), 64.0))


def shadow_antijoin(spark, sf):
    """The rows of every run that neither of the next two runs shadows."""
    older = run_rows(change_log(spark, sf))
    newer = older.select("k", F.explode(F.array(F.col("run") - 1, F.col("run") - 2)).alias("run"))
    return resolve.shadowed_by(older, newer, ["run", "k"]).select("run", "k", "seq", "v")


def orphans(spark, sf):
    """Runs on disk that the manifest doesn't name, had it lost every fourth one."""
    listed = change_log(spark, sf).select("run").distinct()
    return listed.join(listed.filter("run % 4 <> 0"), "run", "left_anti")


def user_wal_bytes(spark, sf):
    k, v, op = F.col("k"), F.col("v"), F.col("op").cast("long")
    return change_log(spark, sf).agg(
        F.sum(user_bytes(k, v)).alias("user_bytes"), F.sum(log_bytes(k, v)).alias("wal_bytes"), F.sum(1 - op).alias("writes"), F.sum(op).alias("deletes")
    )


def write_amp(spark, sf):
    return user_wal_bytes(spark, sf).select(F.round(F.col("wal_bytes").cast("double") / F.col("user_bytes").cast("double"), 6).alias("wal_amp"))


def space_amp(spark, sf):
    return resolve.versions(change_log(spark, sf), "k")


def read_probes(spark, sf):
    return lookup.read_probes(change_log(spark, sf), "run", "k")


def throughput_lag(spark, sf):
    counters = change_log(spark, sf).groupBy("run").agg(F.sum(1 - F.col("op").cast("long")).alias("writes"))
    return counters.select("run", (F.col("writes") - F.lag("writes").over(Window.orderBy("run"))).alias("delta"))


def value_separation(spark, sf):
    log = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("doc_id").alias("seq"), F.lit(0).alias("op"), F.col("text").alias("value"))
    _, run = split_values(log, 1, 1024)
    size = F.coalesce(F.col("vref.len"), F.octet_length("value")).cast("long")
    return run.select(F.col("key").alias("doc_id"), F.col("vref").isNotNull().cast("int").alias("separated"), size.alias("len"))


def _separated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(values, run) of the whole log with every value separated, as one generation."""
    values, run = split_values(_store_log(spark, sf).drop("run"), 1, 0)
    return values.withColumn("gen", F.lit(1)), run


def pointer_deref(spark, sf):
    values, run = _separated(spark, sf)
    return _text(dereference(resolve.live(resolve.newest_per_key(run)), values))


def gc_live_dead(spark, sf):
    """Bytes of separated values before a collection, and of those it copies."""
    values, run = _separated(spark, sf)
    size = F.sum(F.octet_length("value").cast("long"))
    copied = dereference(resolve.live(resolve.newest_per_key(run)), values)
    return values.agg(size.alias("before_bytes")).join(F.broadcast(copied.agg(size.alias("after_bytes"))))  # one row each


def snapshot_asof(spark, sf):
    """The live view when half of the runs were there."""
    log = change_log(spark, sf)
    half = log.agg(F.floor(F.max("run") / 2.0).alias("half"))
    return resolve.as_of(log.join(F.broadcast(half)), F.col("run") <= F.col("half"), **K).select("k", "v")  # one row is broadcast


def recover_two_logs(spark, sf):
    """Every even run as a sealed log and the odd one after it as the active log, recovered together."""
    log = change_log(spark, sf).withColumn("pair", F.floor(F.col("run") / 2.0).cast("long")).withColumn("src", F.pmod("run", F.lit(2)))
    return resolve.newest_per_key(log, ["pair", "k"], ["src", "seq"]).select("pair", "k", "op", "v")


def bloom_sizing(spark, sf):
    return run_stats(spark, sf).select("run", bloom_bits(F.col("records")).alias("bits"))


def composite_key_upsert(spark, sf):
    key = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 10, "0"), F.lit(":"), F.col("l_linenumber").cast("string"))
    return table(spark, sf, "lineitem").groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("versions"))


def key_history(spark, sf):
    return resolve.history(change_log(spark, sf), "k").select("k", "seq", "previous", "next")


def level_read_order(spark, sf):
    """Runs in the order a leveled store reads them: every fourth run on level 0, the rest on level 1."""
    runs = run_stats(spark, sf).withColumn("level", F.when(F.pmod("run", F.lit(4)) == 0, 0).otherwise(1))
    order = Window.orderBy("level", F.when(F.col("level") == 0, -F.col("run")).otherwise(0), "min_key", "run")
    return runs.select("run", "level", F.row_number().over(order).cast("long").alias("place"))


def level_bytes(spark, sf):
    runs = run_stats(spark, sf).withColumn("level", F.pmod("run", F.lit(3)))
    return runs.groupBy("level").agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("runs"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def _store_log(spark: SparkSession, sf: str) -> DataFrame:
    return change_log(spark, sf).select(F.col("k").cast("binary").alias("key"), "seq", "op", F.col("v").cast("binary").alias("value"), "run")


def built_store(spark: SparkSession, sf: str, options: Options | None = None, loads: int = 4) -> Store:
    """A store loaded from events in a few bulk batches, under the shared scratch folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="keystrata-")
    path = f"{base}/store-{uuid.uuid4().hex}"
    store = Store(spark, path, options or Options(min_merge=3, value_threshold=8))
    log = _store_log(spark, sf)
    top = log.agg(F.max("seq")).first()[0] or 0
    step = top // loads + 1
    for i in range(loads):
        store.load(log.filter((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)), batch=f"load:{i}")
    return store


def _text(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").cast("string").alias("k"), F.col("value").cast("string").alias("v"))


def store_live_view(spark, sf):
    return _text(built_store(spark, sf).view())


def store_range_scan(spark, sf):
    return _text(built_store(spark, sf).scan(b"user000010", b"user000050"))


def store_multi_get(spark, sf):
    wanted = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(padded_key(F.col("c_custkey"), "user", 6).cast("binary").alias("key"))
    return _text(built_store(spark, sf).multi_get(wanted))


def store_leveled_view(spark, sf):
    store = built_store(spark, sf, Options(min_merge=2, strategy="leveled", value_threshold=None, buffer_bytes=2048))
    return _text(store.view())


def store_after_gc(spark, sf):
    store = built_store(spark, sf)
    store.collect_values()
    return _text(store.view())


def store_compact_all(spark, sf):
    store = built_store(spark, sf, Options(auto_compact=False))
    store.compact_all()
    runs = store.run_infos().select(F.col("pos").cast("long").alias("pos"), "records", "tombstones")
    return runs


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_live_view(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "live_view": live_view, "point_get": point_get, "point_get_deleted": point_get_deleted, "multi_get": multi_get, "range_scan": range_scan,
        "range_scan_empty": range_scan_empty, "tombstones": tombstones, "revived_keys": revived_keys, "filter_after_resolve": filter_after_resolve,
        "run_flush": run_flush, "run_stats": run_stats, "size_bucket": size_bucket_query, "compact_tiered_keep": compact_tiered_keep,
        "compact_tiered_drop": compact_tiered_drop, "compact_all": compact_all, "pick_tiered": pick_tiered, "level_overlap": level_overlap,
        "level_split": level_split, "level_budget": level_budget_query, "shadow_antijoin": shadow_antijoin, "orphans": orphans, "user_wal_bytes": user_wal_bytes,
        "write_amp": write_amp, "space_amp": space_amp, "read_probes": read_probes, "throughput_lag": throughput_lag, "value_separation": value_separation,
        "pointer_deref": pointer_deref, "gc_live_dead": gc_live_dead, "snapshot_asof": snapshot_asof, "recover_two_logs": recover_two_logs,
        "bloom_sizing": bloom_sizing, "composite_key_upsert": composite_key_upsert, "key_history": key_history, "level_read_order": level_read_order,
        "level_bytes": level_bytes, "store_live_view": store_live_view, "store_range_scan": store_range_scan, "store_multi_get": store_multi_get,
        "store_leveled_view": store_leveled_view, "store_after_gc": store_after_gc, "store_compact_all": store_compact_all,
    }


KV = """
WITH kv AS (SELECT concat('user', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS k, event_id AS seq,
       CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS op, CASE WHEN event_type = 'error' THEN '' ELSE props END AS v,
       CAST(floor(event_id / 128.0) AS BIGINT) AS run FROM events),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) rn FROM kv) t WHERE rn = 1),
runlatest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run, k ORDER BY seq DESC) rn FROM kv) t WHERE rn = 1),
size AS (SELECT run, CAST(count(*) AS BIGINT) AS records, min(k) AS min_key, max(k) AS max_key,
       CAST(sum(9 + octet_length(encode(k)) + octet_length(encode(v))) AS BIGINT) AS bytes FROM runlatest GROUP BY run)
"""
LIVE = "SELECT k, v FROM latest WHERE op = 0"
MULTI = "SELECT l.k, l.v FROM latest l JOIN (SELECT DISTINCT concat('user', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) k FROM customer WHERE c_mktsegment = 'BUILDING') q ON l.k = q.k WHERE l.op = 0"
RANGE = "SELECT k, v FROM latest WHERE op = 0 AND k >= 'user000010' AND k < 'user000050'"
WITH_KV = {
    "live_view": LIVE,
    "point_get": LIVE + " AND k = 'user000042'",
    "point_get_deleted": LIVE + " AND k = (SELECT min(k) FROM latest WHERE op = 1)",
    "multi_get": MULTI,
    "range_scan": RANGE,
    "range_scan_empty": LIVE + " AND k >= 'user000050' AND k < 'user000050'",
    "tombstones": "SELECT k, seq FROM latest WHERE op = 1",
    "revived_keys": "SELECT l.k, CAST(count(*) AS BIGINT) AS deletes_before FROM latest l JOIN kv d ON d.k = l.k AND d.op = 1 AND d.seq < l.seq WHERE l.op = 0 GROUP BY l.k",
    "filter_after_resolve": LIVE + " AND v LIKE '%9}'",
    "run_flush": "SELECT run, k, seq, op, v FROM runlatest",
    "run_stats": "SELECT * FROM size",
    "size_bucket": "SELECT run, CAST(floor(ln(CAST(bytes AS DOUBLE)) / ln(2.0)) AS BIGINT) AS bucket FROM size",
    "compact_tiered_keep": "SELECT merge, k, seq, op, v FROM (SELECT *, CAST(floor(run / 4.0) AS BIGINT) AS merge, row_number() OVER (PARTITION BY CAST(floor(run / 4.0) AS BIGINT), k ORDER BY seq DESC) r FROM runlatest) t WHERE r = 1",
    "compact_tiered_drop": "SELECT k, seq, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM runlatest WHERE run <= (SELECT floor(max(run) / 2.0) FROM kv)) t WHERE r = 1 AND op = 0",
    "compact_all": "SELECT k, seq, v FROM latest WHERE op = 0",
    "pick_tiered": """, s AS (SELECT run, CAST(floor(ln(CAST(sum(CASE WHEN mod(run, 5) = 2 THEN 1 ELSE 9 END) AS DOUBLE)) / ln(2.0)) AS BIGINT) AS bucket FROM runlatest GROUP BY run),
      i AS (SELECT run, bucket, CAST(row_number() OVER (ORDER BY run DESC) - row_number() OVER (PARTITION BY bucket ORDER BY run DESC) AS BIGINT) AS island FROM s)
      SELECT bucket, island, CAST(count(*) AS BIGINT) AS n, min(run) AS oldest, max(run) AS newest FROM i GROUP BY bucket, island HAVING count(*) >= 2""",
    "level_overlap": """, s AS (SELECT run, min(k) lo, max(k) hi FROM runlatest GROUP BY run), d AS (SELECT CAST(floor(user_id / 10.0) AS BIGINT) AS slot,
      concat('user', lpad(CAST(min(user_id) AS VARCHAR), 6, '0')) lo, concat('user', lpad(CAST(max(user_id) AS VARCHAR), 6, '0')) hi FROM events GROUP BY 1)
      SELECT s.run, d.slot FROM s JOIN d ON NOT (d.hi < s.lo OR d.lo > s.hi)""",
    "level_split": "SELECT k, CAST(floor((cum - 1) / 1000.0) AS BIGINT) AS file_no FROM (SELECT k, sum(9 + octet_length(encode(k)) + octet_length(encode(v))) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING) AS cum FROM latest WHERE op = 0) t",
    "level_budget": "SELECT mod(run, 9) + 1 AS level, CAST(sum(octet_length(encode(v))) AS BIGINT) AS bytes, CAST(64 * power(2.0, mod(run, 9)) AS BIGINT) AS budget FROM runlatest GROUP BY mod(run, 9)",
    "shadow_antijoin": "SELECT o.run, o.k, o.seq, o.v FROM runlatest o WHERE NOT EXISTS (SELECT 1 FROM runlatest n WHERE n.k = o.k AND (n.run = o.run + 1 OR n.run = o.run + 2))",
    "orphans": "SELECT DISTINCT run FROM kv WHERE mod(run, 4) = 0",
    "user_wal_bytes": "SELECT CAST(sum(octet_length(encode(k)) + octet_length(encode(v))) AS BIGINT) AS user_bytes, CAST(sum(9 + octet_length(encode(k)) + octet_length(encode(v))) AS BIGINT) AS wal_bytes, CAST(sum(1 - op) AS BIGINT) AS writes, CAST(sum(op) AS BIGINT) AS deletes FROM kv",
    "write_amp": "SELECT round(CAST((SELECT sum(9 + octet_length(encode(k)) + octet_length(encode(v))) FROM kv) AS DOUBLE) / CAST((SELECT sum(octet_length(encode(k)) + octet_length(encode(v))) FROM kv) AS DOUBLE), 6) AS wal_amp",
    "space_amp": "SELECT k, CAST(count(*) AS BIGINT) AS versions, CAST(count(*) - 1 AS BIGINT) AS shadowed FROM kv GROUP BY k",
    "read_probes": "SELECT k, CAST((SELECT max(run) FROM kv) - max(run) + 1 AS BIGINT) AS probes FROM runlatest GROUP BY k",
    "throughput_lag": "SELECT run, writes - lag(writes) OVER (ORDER BY run) AS delta FROM (SELECT run, CAST(sum(1 - op) AS BIGINT) AS writes FROM kv GROUP BY run) t",
    "pointer_deref": "SELECT l.k, e.props AS v FROM latest l JOIN events e ON e.event_id = l.seq WHERE l.op = 0",
    "gc_live_dead": "SELECT CAST(sum(octet_length(encode(kv.v))) AS BIGINT) AS before_bytes, CAST(sum(CASE WHEN l.k IS NOT NULL THEN octet_length(encode(kv.v)) ELSE 0 END) AS BIGINT) AS after_bytes FROM kv LEFT JOIN latest l ON l.k = kv.k AND l.seq = kv.seq AND l.op = 0 WHERE kv.op = 0",
    "snapshot_asof": "SELECT k, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY seq DESC) r FROM kv WHERE run <= (SELECT floor(max(run) / 2.0) FROM kv)) t WHERE r = 1 AND op = 0",
    "recover_two_logs": "SELECT pair, k, op, v FROM (SELECT k, op, v, CAST(floor(run / 2.0) AS BIGINT) AS pair, row_number() OVER (PARTITION BY CAST(floor(run / 2.0) AS BIGINT), k ORDER BY mod(run, 2) DESC, seq DESC) r FROM kv) t WHERE r = 1",
    "bloom_sizing": "SELECT run, CAST(ceil(-CAST(records AS DOUBLE) * ln(0.01) / (ln(2.0) * ln(2.0))) AS BIGINT) AS bits FROM size",
    "key_history": "SELECT k, seq, lag(seq) OVER w AS previous, lead(seq) OVER w AS next FROM kv WINDOW w AS (PARTITION BY k ORDER BY seq)",
    "level_read_order": "SELECT run, level, row_number() OVER (ORDER BY level, CASE WHEN level = 0 THEN -run ELSE 0 END, min_key, run) AS place FROM (SELECT *, CASE WHEN mod(run, 4) = 0 THEN 0 ELSE 1 END AS level FROM size) t",
    "level_bytes": "SELECT mod(run, 3) AS level, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(count(*) AS BIGINT) AS runs, min(min_key) AS min_key, max(max_key) AS max_key FROM size GROUP BY 1",
    "store_live_view": LIVE,
    "store_range_scan": RANGE,
    "store_multi_get": MULTI,
    "store_leveled_view": LIVE,
    "store_after_gc": LIVE,
    "store_compact_all": "SELECT CAST(0 AS BIGINT) AS pos, CAST(count(*) AS BIGINT) AS records, CAST(0 AS BIGINT) AS tombstones FROM latest WHERE op = 0",
}
PLAIN = {
    "value_separation": "SELECT doc_id, CASE WHEN octet_length(encode(text)) >= 1024 THEN 1 ELSE 0 END AS separated, CAST(octet_length(encode(text)) AS BIGINT) AS len FROM documents",
    "composite_key_upsert": "SELECT concat(lpad(CAST(l_orderkey AS VARCHAR), 10, '0'), ':', CAST(l_linenumber AS VARCHAR)) AS k, CAST(count(*) AS BIGINT) AS versions FROM lineitem GROUP BY 1",
}


def oracle_sql() -> dict[str, str]:
    return {name: KV + sql for name, sql in WITH_KV.items()} | PLAIN
