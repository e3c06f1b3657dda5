"""The store: a mutable keyed table over immutable sorted runs.

Writes go to a log and a bounded driver-side buffer, or in bulk straight to a run; a flush or bulk load writes
one run on the executors and commits a manifest. Reads union the runs a query can touch with the buffer,
resolve newest-per-key, drop tombstones, and only then fetch separated values. Compaction and value collection
write new files, commit, and leave old files to readers of retained manifest versions until vacuum.
"""

from __future__ import annotations

import threading
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrata.functions.bloom import RunFilter
from keystrata.functions.scalar import LOG_HEADER_BYTES, run_name, sequence_of, user_bytes
from keystrata.operators.compaction import Pick, pick_leveled, pick_tiered
from keystrata.operators.lookup import keys_frame, multi_get, point_get, range_scan
from keystrata.operators.resolve import live, merge_runs, newest_per_key, union_runs
from keystrata.operators.separation import dereference, split_values
from keystrata.schema import CHANGE_LOG, DELETE, PUT, VALUES
from keystrata.sources import files, wire
from keystrata.sources.manifest import Manifest, ManifestStore, RunInfo, runs_frame
from keystrata.sources.runs import describe, filter_batches, may_hold, meets, orphans, read_runs, write_run

LEVEL_TASK_BYTES = 256 << 10  # smaller level files are written by one task up to this size


@dataclass
class Options:
    """Defaults of the engine. value_threshold None keeps all values in the runs."""

    buffer_bytes: int = 4 << 20
    min_merge: int = 4
    size_ratio: float = 2.0
    value_threshold: int | None = 128
    strategy: str = "tiered"
    file_bytes: int = 128 << 20
    keep_versions: int = 3
    auto_compact: bool = True
    run_filters: bool = True
    orphan_grace: float = 24 * 3600.0  # seconds that an unnamed file is spared, since another writer may be about to commit it

    @property
    def first_level_bytes(self) -> int:
        return 16 * self.buffer_bytes

    @property
    def level_file_bytes(self) -> int:
        return 2 * self.buffer_bytes


@dataclass
class Counters:
    """Cumulative counters since open."""

    writes: int = 0
    deletes: int = 0
    reads: int = 0
    user_bytes: int = 0
    log_bytes: int = 0
    flush_bytes: int = 0
    compaction_bytes: int = 0
    value_bytes: int = 0
    flushes: int = 0
    compactions: int = 0
    bloom_checks: int = 0
    bloom_skips: int = 0
    bloom_false_positives: int = 0


class Store:
    """One store directory, on any file system Spark can write."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None, version: int | None = None, read_only: bool = False):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        if self.options.strategy not in ("tiered", "leveled"):
            raise ValueError("strategy is tiered or leveled")
        self.manifests = ManifestStore(spark, f"{self.path}/manifests")
        self.counters, self.bloom, self._lock = Counters(), True, threading.RLock()
        self._filters: dict[str, RunFilter | None] = {}
        self._buffer: dict[bytes, tuple[int, int, bytes]] = {}
        self._pending: list[tuple[int, bytes, bytes]] = []
        self._buffered = 0
        self.read_only = read_only or version is not None
        self.manifest = self.manifests.read(version) or self._bootstrap()
        if not self.read_only:
            self.vacuum(self.options.orphan_grace)
        if version is None:
            self._recover()

    def _bootstrap(self) -> Manifest:
        """A manifest rebuilt from the runs on disk, newest content first; an empty one if there are none.

        Runs are taken whole and on level 0: rows carry their write numbers, so neither order nor level decides
        what is newest. Runs without Spark's success mark were never finished and are left out.
        """
        names = [n for n in files.names(self.spark, f"{self.path}/runs") if files.exists(self.spark, f"{self.path}/runs/{n}/_SUCCESS")]
        if not names:
            return Manifest()
        runs = [r for n in names for r in describe(self.spark, f"{self.path}/runs/{n}", n, 0) if r.records]
        gens = tuple(sorted(sequence_of(n) or 0 for n in files.names(self.spark, f"{self.path}/values")))
        top = max((r.max_seq for r in runs), default=0)
        found = Manifest(next_seq=top + 1, next_run=max(sequence_of(n) or 0 for n in names) + 1, flushed_seq=top, generation=max(gens, default=1), generations=gens, runs=tuple(runs)).ordered()
        return found if self.read_only else self.manifests.commit(found)

    # -- writing ---------------------------------------------------------------------------------

    def put(self, key: bytes, value: bytes, sync: bool = True) -> None:
        self._write(PUT, key, value, sync)

    def delete(self, key: bytes, sync: bool = True) -> None:
        """Write a tombstone, also for an absent key."""
        self._write(DELETE, key, b"", sync)

    def _write(self, op: int, key: bytes, value: bytes, sync: bool) -> None:
        with self._lock:
            self._writable()
            record = wire.encode_record(op, key, value)
            self._pending.append((op, key, value))
            self._apply(op, key, value)
            c = self.counters
            c.writes, c.deletes = c.writes + (op == PUT), c.deletes + (op == DELETE)
            c.user_bytes, c.log_bytes = c.user_bytes + len(key) + len(value), c.log_bytes + len(record)
            if sync:
                self.sync()
            if self._buffered >= self.options.buffer_bytes:
                self.flush()

    def _apply(self, op: int, key: bytes, value: bytes) -> None:
        seq = self.manifest.next_seq
        old = self._buffer.get(key)
        self._buffered += len(key) + len(value) - (len(key) + len(old[2]) if old else 0)
        self._buffer[key] = (seq, op, value)
        self.manifest = replace(self.manifest, next_seq=seq + 1)

    def sync(self) -> None:
        """Make all writes so far durable: one log file for the group."""
        with self._lock:
            if self._pending:
                first = self.manifest.next_seq - len(self._pending)
                files.make_dirs(self.spark, f"{self.path}/log")
                files.write_bytes(self.spark, f"{self.path}/log/{first:020d}.log", b"".join(wire.encode_record(*r) for r in self._pending))
                self._pending = []

    def flush(self) -> None:
        """Write the buffer as a run, however small; nothing to do if it is empty."""
        with self._lock:
            self._writable()
            if not self._buffer:
                return
            self.sync()
            rows = [(k, s, op, v) for k, (s, op, v) in self._buffer.items()]
            upto = self.manifest.next_seq - 1
            self._publish(self.spark.createDataFrame(rows, CHANGE_LOG), expected=len(rows), flushed_seq=upto)
            self._buffer, self._buffered = {}, 0
            self._drop_log(upto)
            if self.options.auto_compact:
                self.compact()

    def load(self, log: DataFrame, batch: str | None = None) -> bool:
        """Add a change log (key, value, op, seq) in bulk; its seq orders it after all earlier writes.

        With a batch name the load is idempotent: a batch that was committed before is ignored.
        """
        with self._lock:
            self._writable()
            if batch is not None and batch in self.manifest.batches:
                return False
            self.flush()
            base = self.manifest.next_seq
            typed = log.select(F.col("key").cast("binary").alias("key"), F.col("seq").cast("long").alias("seq"), F.col("op").cast("byte").alias("op"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"))
            first = log.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.count(F.lit(1)).alias("n"), F.sum((F.col("op") == PUT).cast("long")).alias("w"), F.sum(user_bytes(F.col("key").cast("binary"), F.col("value").cast("binary"))).alias("b")).first()
            if not first["n"]:
                return False
            shifted = typed.withColumn("seq", F.col("seq") - first["lo"] + base)
            top = first["hi"] - first["lo"] + base
            c = self.counters
            c.writes, c.deletes = c.writes + first["w"], c.deletes + first["n"] - first["w"]
            c.user_bytes, c.log_bytes = c.user_bytes + first["b"], c.log_bytes + first["b"] + LOG_HEADER_BYTES * first["n"]
            self.manifest = replace(self.manifest, next_seq=top + 1)
            done = self.manifest.batches | ({batch: self.manifest.version + 1} if batch is not None else {})
            parts = max(1, -(-first["b"] // self.options.file_bytes))
            self._publish(newest_per_key(shifted), parts, first["n"], flushed_seq=top, batches=done)
            if self.options.auto_compact:
                self.compact()
            return True

    def _publish(self, rows: DataFrame, parts: int = 1, expected: int | None = None, **changes) -> None:
        """Values first, then the run and its filter, then the manifest."""
        run = self._write_run(rows, 0, parts, expected)
        self.counters.flushes += 1
        self.counters.flush_bytes += sum(r.bytes for r in run)
        self.manifest = self.manifests.commit(replace(self.manifest, runs=(*run, *self.manifest.runs), **changes))

    def _write_run(self, rows: DataFrame, level: int, parts: int, expected: int | None = None, separate: bool = True, split: bool = False) -> list[RunInfo]:
        name = f"{run_name(self.manifest.next_run)}-{uuid.uuid4().hex[:8]}"  # another writer may use the number too
        path = f"{self.path}/runs/{name}"
        gen = self.manifest.generation
        self.manifest = replace(self.manifest, next_run=self.manifest.next_run + 1)
        if separate:
            values, rows = split_values(rows, gen, self.options.value_threshold)
            if self.options.value_threshold is not None:
                where = f"{self.path}/values/gen={gen:06d}/{name}"
                values.write.parquet(where)
                size = self.spark.read.schema(VALUES).parquet(where).agg(F.count(F.lit(1)), F.coalesce(F.sum(8 + F.octet_length("key") + F.octet_length("value")), F.lit(0))).first()
                if size[0]:
                    self.counters.value_bytes += size[1]
                    self.manifest = replace(self.manifest, generations=tuple(sorted({*self.manifest.generations, gen})))
        together = max(1, LEVEL_TASK_BYTES // self.options.level_file_bytes) if split else 1
        write_run(rows, path, parts, -(-expected // parts) if expected else None, together)
        new = describe(self.spark, path, name, level, split)
        if self.options.run_filters:
            self._build_filters([r for r in new if r.records])
        return new

    # -- reading ---------------------------------------------------------------------------------

    def log_frame(self, runs: list[RunInfo] | None = None) -> DataFrame:
        """Unresolved rows of the given runs (all by default) and the buffer."""
        with self._lock:
            stored = read_runs(self.spark, list(self.manifest.runs if runs is None else runs), self.bloom)
            parts = [stored] if stored is not None else []
            if self._buffer or stored is None:
                parts.append(self.spark.createDataFrame([(k, s, op, v) for k, (s, op, v) in self._buffer.items()], CHANGE_LOG))
            return union_runs(parts)

    def values_frame(self) -> DataFrame | None:
        """(gen, id, key, value) of the generations in use."""
        frames = []
        for gen in self.manifest.generations:
            folder = f"{self.path}/values/gen={gen:06d}"
            paths = [f"{folder}/{n}" for n in files.names(self.spark, folder)]
            if paths:
                frames.append(self.spark.read.schema(VALUES).parquet(*paths).withColumn("gen", F.lit(gen)))
        return union_runs(frames) if frames else None

    def _finish(self, rows: DataFrame) -> DataFrame:
        return dereference(rows, self.values_frame() if "vref" in rows.columns else None).select("key", "value")

    def view(self) -> DataFrame:
        """The live table (key, value) of this snapshot."""
        return self._finish(live(newest_per_key(self.log_frame())))

    def get(self, key: bytes) -> bytes | None:
        """The newest value, or None for an absent or deleted key."""
        with self._lock:
            self.counters.reads += 1
            if key in self._buffer:
                _, op, value = self._buffer[key]
                return value if op == PUT else None
            runs = [r for r in self.manifest.runs if may_hold(r, key)]
            passed = [r for r in runs if self._might_contain(r, key)]
            if not passed:
                return None
            got = self._finish(point_get(self.log_frame(passed), key)).first()
            self.counters.bloom_false_positives += int(got is None and self.bloom)
            return bytes(got["value"]) if got else None

    def multi_get(self, keys: list[bytes] | DataFrame) -> DataFrame:
        """(key, value) of all live keys among `keys`, in one job."""
        wanted = keys if isinstance(keys, DataFrame) else keys_frame(self.spark, keys)
        runs = list(self.manifest.runs)
        if isinstance(keys, DataFrame):
            ends = wanted.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
            runs = [r for r in runs if ends["lo"] is not None and r.max_key >= bytes(ends["lo"]) and r.min_key <= bytes(ends["hi"])]
        else:
            runs = [r for r in runs if any(may_hold(r, k) and self._might_contain(r, k) for k in keys)]
        return self._finish(multi_get(self.log_frame(runs), wanted))

    def scan(self, start: bytes, end: bytes) -> DataFrame:
        """start <= key < end, ascending."""
        self.counters.reads += 1
        runs = [r for r in self.manifest.runs if meets(r, start, end)]
        return self._finish(range_scan(self.log_frame(runs), start, end)).orderBy("key")

    def _might_contain(self, run: RunInfo, key: bytes) -> bool:
        if not self.bloom:
            return True
        path = f"{self.path}/filters/{run.name}.bloom"
        if run.name not in self._filters:
            self._filters[run.name] = RunFilter.load(self.spark, path) if files.exists(self.spark, path) else None
        f = self._filters[run.name]
        if f is None:
            return True
        self.counters.bloom_checks += 1
        yes = f.might_contain(key)
        self.counters.bloom_skips += int(not yes)
        return yes

    def build_filters(self) -> None:
        """Write a Bloom filter beside every run that lacks one; point reads then skip runs by it."""
        self._build_filters([r for r in self.manifest.runs if not files.exists(self.spark, f"{self.path}/filters/{r.name}.bloom")])

    def _build_filters(self, runs: list[RunInfo]) -> None:
        files.make_dirs(self.spark, f"{self.path}/filters")
        for some in filter_batches(runs):
            built = RunFilter.build_each(read_runs(self.spark, some), "key", max(r.records for r in some)) if len(some) > 1 else {}
            made = {r.name: built.get(r.path) or RunFilter.build(read_runs(self.spark, [r]), "key", r.records) for r in some}
            with ThreadPoolExecutor(16) as pool:  # a small file each, so nearly all of it is waiting
                list(pool.map(lambda name: made[name].save(self.spark, f"{self.path}/filters/{name}.bloom"), made))
            for name in made:
                self._filters.pop(name, None)

    def set_bloom_enabled(self, on: bool) -> None:
        self.bloom = on

    # -- lifecycle -------------------------------------------------------------------------------

    def pick(self) -> Pick | None:
        o = self.options
        if o.strategy == "tiered":
            return pick_tiered(self.manifest.runs, o.min_merge, o.size_ratio)
        return pick_leveled(self.manifest.runs, o.min_merge, o.first_level_bytes, o.size_ratio)

    def compact(self) -> int:
        """Merge until no pick is left; returns the number of merges and moves."""
        n = 0
        with self._lock:
            while pick := self.pick():
                if pick.move:
                    self._move(list(pick.runs), pick.level)
                else:
                    self._merge(list(pick.runs), pick.level, pick.drop_tombstones)
                n += 1
        return n

    def compact_all(self) -> None:
        """One run of live rows; nothing to do with at most one run."""
        with self._lock:
            if len(self.manifest.runs) > 1:
                self._merge(list(self.manifest.runs), 0, True)

    def _merge(self, picked: list[RunInfo], level: int, drop: bool) -> None:
        merged = merge_runs(read_runs(self.spark, picked), drop)
        size = sum(r.bytes for r in picked)
        target = self.options.level_file_bytes if level else self.options.file_bytes
        new = self._write_run(merged, level, max(1, -(-size // target)), sum(r.records for r in picked), separate=False, split=level > 0)
        new = [r for r in new if r.records]
        self.counters.compactions += 1
        self.counters.compaction_bytes += sum(r.bytes for r in new)
        changed = self.manifest.replaced(picked, new)
        self.manifest = self.manifests.commit(changed.ordered() if self.options.strategy == "leveled" else changed)

    def _move(self, picked: list[RunInfo], level: int) -> None:
        """Give runs that meet nothing on `level` that level; their files stay as they are."""
        moved = self.manifest.replaced(picked, [replace(r, level=level) for r in picked])
        self.manifest = self.manifests.commit(moved.ordered())

    def collect_values(self) -> None:
        """Keep only live rows, copy their separated values to the next generation, and drop the old ones."""
        with self._lock:
            self.flush()
            runs = list(self.manifest.runs)
            if not runs:
                return
            rows = live(newest_per_key(read_runs(self.spark, runs)))
            full = dereference(rows, self.values_frame()).select("key", "seq", "op", "value")
            self.manifest = replace(self.manifest, generation=self.manifest.generation + 1, generations=())
            new = self._write_run(full, 0, max(1, -(-sum(r.bytes for r in runs) // self.options.file_bytes)), sum(r.records for r in runs))
            self.counters.compactions += 1
            self.manifest = self.manifests.commit(replace(self.manifest, runs=tuple(r for r in new if r.records)))

    def vacuum(self, grace: float = 0.0) -> list[str]:
        """Delete manifests beyond the retained versions, then runs, values and filters none of these name.

        What changed in the last `grace` seconds is spared: a writer elsewhere may be about to commit it. Without
        any manifest nothing goes.
        """
        self._writable()
        self.manifests.forget(self.options.keep_versions)
        kept = [self.manifests.read(v) for v in self.manifests.versions()]
        if not kept:
            return []
        ages = {kind: files.ages(self.spark, f"{self.path}/{kind}") for kind in ("runs", "values", "filters", "manifests")}
        live_runs = {r.name.split(".")[0] for m in kept for r in m.runs}
        live_gens = {g for m in kept for g in m.generations}
        gone = [("runs", n) for n in orphans(self.spark, f"{self.path}/runs", live_runs)]
        gone += [("values", n) for n in ages["values"] if sequence_of(n) not in live_gens]
        gone += [("filters", n) for n in ages["filters"] if n.removesuffix(".bloom").split(".")[0] not in live_runs]
        gone += [("manifests", n) for n in ages["manifests"] if n.endswith(".tmp")]
        gone = [f"{kind}/{n}" for kind, n in gone if ages[kind].get(n, 0.0) >= grace]
        for n in gone:
            files.delete(self.spark, f"{self.path}/{n}")
        return gone

    def _recover(self) -> None:
        """Replay log files newer than the manifest, in write order."""
        for name in files.names(self.spark, f"{self.path}/log"):
            first = int(name.split(".")[0])
            for i, (op, key, value) in enumerate(wire.decode_records(files.read_bytes(self.spark, f"{self.path}/log/{name}"))):
                if first + i > self.manifest.flushed_seq:
                    self.manifest = replace(self.manifest, next_seq=max(self.manifest.next_seq, first + i))
                    self._apply(op, key, value)

    def _drop_log(self, upto: int) -> None:
        for name in files.names(self.spark, f"{self.path}/log"):
            if int(name.split(".")[0]) <= upto:
                files.delete(self.spark, f"{self.path}/log/{name}")

    def wait_for_idle(self) -> None:
        """Lifecycle work is synchronous, so once the lock is free there is none."""
        with self._lock:
            return

    def close(self) -> None:
        """Make pending writes durable; the buffer is recovered from the log at the next open."""
        if not self.read_only:
            self.sync()

    def _writable(self) -> None:
        if self.read_only:
            raise PermissionError("a store opened at a version or for reading is read-only")

    # -- measurement -----------------------------------------------------------------------------

    @property
    def buffer_count(self) -> int:
        return len(self._buffer)

    @property
    def buffer_bytes(self) -> int:
        return self._buffered

    @property
    def buffer_tombstones(self) -> int:
        return sum(op == DELETE for _, op, _ in self._buffer.values())

    @property
    def threshold(self) -> int:
        return self.options.buffer_bytes

    @property
    def run_count(self) -> int:
        return len(self.manifest.runs)

    @property
    def disk_bytes(self) -> int:
        """Logical bytes of all runs, without separated values."""
        return sum(r.bytes for r in self.manifest.runs)

    def value_disk_bytes(self) -> int:
        """Bytes on disk of the value generations in use."""
        return sum(files.size(self.spark, f"{self.path}/values/gen={g:06d}") for g in self.manifest.generations)

    def run_infos(self) -> DataFrame:
        return runs_frame(self.spark, self.manifest, self.options.size_ratio)

    def stats(self) -> DataFrame:
        """One row: the counters, buffer and run sizes, and write amplification."""
        c = asdict(self.counters)
        row = c | {"buffer_count": self.buffer_count, "buffer_bytes": self.buffer_bytes, "buffer_tombstones": self.buffer_tombstones, "runs": self.run_count, "disk_bytes": self.disk_bytes}
        df = self.spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} long" for k in row))
        written = F.col("log_bytes") + F.col("flush_bytes") + F.col("compaction_bytes") + F.col("value_bytes")
        fpr = F.when(F.col("bloom_checks") > 0, (F.col("bloom_checks") - F.col("bloom_skips")) / F.col("bloom_checks"))
        return df.withColumn("write_amplification", F.when(F.col("user_bytes") > 0, written / F.col("user_bytes"))).withColumn("bloom_pass_rate", fpr)

    def stats_json(self) -> str:
        """Statistics and run list as one JSON object."""
        runs = self.run_infos().select(F.collect_list(F.struct("name", "level", "tier", "records", "bytes")).alias("runs"))
        return self.stats().crossJoin(runs).select(F.to_json(F.struct("*"))).first()[0]
