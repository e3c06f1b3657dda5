"""The store against its contract: durability, snapshots, compaction, value separation, recovery."""

import os
import shutil
import random

import pytest

from keystrata.plans.store import Options, Store
from keystrata.sources import wire
from keystrata.sources.manifest import ConcurrentCommitError
from keystrata.sources.runs import read_runs


def local(path):
    return path.removeprefix("file://")


def contents(store):
    return {bytes(r["key"]): bytes(r["value"]) for r in store.view().collect()}


def quiet(**kw):
    return Options(**({"auto_compact": False, "value_threshold": None} | kw))


def test_put_get_delete_scan_over_buffer_and_runs(spark, store_path):
    s = Store(spark, store_path, quiet())
    for i in range(10):
        s.put(f"k{i}".encode(), f"v{i}".encode(), sync=False)
    s.flush()
    s.put(b"k3", b"new", sync=False)
    s.delete(b"k4", sync=False)
    s.delete(b"absent", sync=False)
    assert s.get(b"k3") == b"new" and s.get(b"k4") is None and s.get(b"k5") == b"v5" and s.get(b"nope") is None
    assert [bytes(r["key"]) for r in s.scan(b"k2", b"k6").collect()] == [b"k2", b"k3", b"k5"]
    assert s.scan(b"k6", b"k2").count() == 0
    got = {bytes(r["key"]) for r in s.multi_get([b"k1", b"k4", b"zz"]).collect()}
    assert got == {b"k1"}
    assert (s.buffer_count, s.buffer_tombstones, s.run_count, s.threshold) == (3, 2, 1, 4 << 20)


def test_counters(spark, store_path):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"111")
    s.put(b"b", b"22")
    s.delete(b"a")
    c = s.counters
    assert (c.writes, c.deletes, c.user_bytes, c.log_bytes) == (2, 1, 8, 8 + 27)
    assert s.stats().first()["writes"] == 2 and '"writes":2' in s.stats_json()


def test_reopen_recovers_synced_writes_only(spark, store_path):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"1")
    s.flush()
    s.put(b"b", b"2")
    s.put(b"a", b"3", sync=False)
    again = Store(spark, store_path, quiet())
    assert contents(again) == {b"a": b"1", b"b": b"2"}
    s.close()
    assert contents(Store(spark, store_path, quiet())) == {b"a": b"3", b"b": b"2"}


def test_recovery_after_flush_does_not_replay_old_log(spark, store_path):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"1")
    old = {n: open(f"{local(store_path)}/log/{n}", "rb").read() for n in os.listdir(f"{local(store_path)}/log") if n.endswith(".log")}
    s.flush()
    s.put(b"a", b"2")
    s.flush()
    for n, data in old.items():  # a crash between commit and log removal
        open(f"{local(store_path)}/log/{n}", "wb").write(data)
    assert contents(Store(spark, store_path, quiet())) == {b"a": b"2"}


def test_torn_log_tail_is_ignored():
    whole = wire.encode_record(0, b"k\x00y", b"\x00\x01") + wire.encode_record(1, b"z", b"")
    want = [(0, b"k\x00y", b"\x00\x01"), (1, b"z", b"")]
    assert list(wire.decode_records(whole)) == want
    for cut in range(1, len(wire.encode_record(1, b"z", b""))):
        assert list(wire.decode_records(whole[:-cut])) == want[:1]


def test_log_reader_frame(spark, tmp_path):
    (tmp_path / "0.log").write_bytes(wire.encode_record(0, b"a", b"1") + b"\x00\x05\x00")
    rows = wire.read_log(spark, f"file://{tmp_path}").collect()
    assert [(r["pos"], r["op"], bytes(r["key"]), bytes(r["value"])) for r in rows] == [(0, 0, b"a", b"1")]


def test_bulk_load_is_idempotent_by_batch(spark, store_path):
    s = Store(spark, store_path, quiet())
    log = spark.createDataFrame([(b"a", b"1", 0, 10), (b"a", b"2", 0, 11), (b"b", b"", 1, 12)], "key binary, value binary, op int, seq long")
    assert s.load(log, "one") and not s.load(log, "one")
    s.put(b"b", b"after")
    assert contents(s) == {b"a": b"2", b"b": b"after"}
    assert not s.load(log.limit(0), "none")


def test_compaction_keeps_answers_and_oldest_tombstones(spark, store_path):
    s = Store(spark, store_path, quiet(min_merge=2))
    s.put(b"k", b"old", sync=False)
    for i in range(50):
        s.put(f"big{i}".encode(), b"x" * 200, sync=False)
    s.flush()
    for n in range(2):
        s.delete(b"k", sync=False)
        s.put(f"s{n}".encode(), b"y", sync=False)
        s.flush()
    before = contents(s)
    s.compact()
    assert contents(s) == before and b"k" not in before
    s.compact_all()
    assert contents(s) == before and s.run_count == 1
    assert read_runs(spark, list(s.manifest.runs)).filter("op = 1").count() == 0
    s.compact_all()
    assert s.counters.compactions == 2


def test_newest_value_wins_after_merges_of_other_runs(spark, store_path):
    s = Store(spark, store_path, quiet(min_merge=3))
    s.put(b"k", b"OLD", sync=False)
    s.flush()
    for tag in "ABC":
        for i in range(20):
            s.put(f"{tag}{i}".encode(), b"z" * 500, sync=False)
        s.flush()
    s.put(b"k", b"NEW", sync=False)
    s.flush()
    s.compact()
    assert s.get(b"k") == b"NEW"


def test_leveled_runs_are_disjoint(spark, store_path):
    s = Store(spark, store_path, Options(strategy="leveled", min_merge=2, buffer_bytes=600, value_threshold=None))
    want = {}
    for i in range(60):
        k, v = f"k{i * 7 % 40:03d}".encode(), b"v" * 40 + str(i).encode()
        s.put(k, v, sync=False)
        want[k] = v
    s.flush()
    by_level = {}
    for r in s.manifest.runs:
        by_level.setdefault(r.level, []).append(r)
    for level, runs in by_level.items():
        runs.sort(key=lambda r: r.min_key)
        assert level == 0 or all(a.max_key < b.min_key for a, b in zip(runs, runs[1:]))
    assert max(by_level) >= 1 and contents(s) == want and contents(Store(spark, store_path, s.options)) == want


def test_leveled_load_takes_few_steps_and_filters_every_file(spark, store_path):
    s = Store(spark, store_path, Options(strategy="leveled", min_merge=2, buffer_bytes=100, value_threshold=None))
    want, jobs = {}, spark.sparkContext.statusTracker()
    for turn in range(2):
        rows = [(f"k{i:04d}".encode(), i, 0, f"{turn}".encode() * 20) for i in range(turn, 400, turn + 1)]
        want |= {k: v for k, _, _, v in rows}
        spark.sparkContext.setJobGroup(f"load-{turn}", "")
        s.load(spark.createDataFrame(rows, "key binary, seq long, op int, value binary"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("load-1")) < 80  # hundreds, were files merged one by one
    runs = s.manifest.runs
    assert len(runs) > 50 and contents(s) == want
    assert {f"{r.name}.bloom" for r in runs} <= set(os.listdir(f"{local(store_path)}/filters"))
    for r in runs:
        assert s._might_contain(r, r.min_key) and s._might_contain(r, r.max_key)
    assert sum(s._might_contain(r, b"x%d" % i) for r in runs for i in range(20)) < len(runs)
    for level in {r.level for r in runs}:
        of = sorted((r for r in runs if r.level == level), key=lambda r: r.min_key)
        assert sum(r.bytes for r in of) <= s.options.first_level_bytes * 2 ** (level - 1) and all(a.max_key < b.min_key for a, b in zip(of, of[1:]))


def test_separation_threshold_is_inclusive_and_gc_reclaims(spark, store_path):
    s = Store(spark, store_path, quiet(value_threshold=100))
    s.put(b"in", b"i" * 99)
    s.put(b"out", b"o" * 100)
    s.flush()
    rows = {bytes(r["key"]): r for r in read_runs(spark, list(s.manifest.runs)).collect()}
    assert rows[b"in"]["vref"] is None and rows[b"out"]["value"] is None and rows[b"out"]["vref"]["len"] == 100
    for i in range(3):
        s.put(b"out", bytes([i]) * 300, sync=False)
        s.flush()
    s.delete(b"in")
    s.compact_all()
    assert s.manifest.generations == (1,)
    s.collect_values()
    assert contents(s) == {b"out": b"\x02" * 300} and s.manifest.generations == (2,)
    assert s.values_frame().count() == 1
    s.options.keep_versions = 1
    s.vacuum()
    assert sorted(os.listdir(f"{local(store_path)}/values")) == ["gen=000002"]
    assert s.get(b"out") == b"\x02" * 300
    s.collect_values()
    assert contents(Store(spark, store_path, s.options)) == {b"out": b"\x02" * 300}


def test_snapshot_reads_survive_compaction(spark, store_path):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"1")
    s.flush()
    version = s.manifest.version
    reader = s.view()
    s.put(b"a", b"2")
    s.flush()
    s.compact_all()
    assert [bytes(r["value"]) for r in reader.collect()] == [b"1"]
    assert contents(Store(spark, store_path, version=version)) == {b"a": b"1"}
    with pytest.raises(PermissionError):
        Store(spark, store_path, version=version).put(b"x", b"y")


def test_concurrent_commit_is_refused(spark, store_path):
    one, two = Store(spark, store_path, quiet()), Store(spark, store_path, quiet())
    one.put(b"a", b"1")
    one.flush()
    two.put(b"b", b"2")
    with pytest.raises(ConcurrentCommitError):
        two.flush()


def test_old_orphans_are_removed_on_open_and_fresh_ones_spared(spark, store_path):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"1")
    s.flush()
    stray, fresh = (f"{local(store_path)}/runs/run-99999{i}" for i in (8, 9))
    os.makedirs(stray)
    os.makedirs(fresh)
    os.utime(stray, (0, 0))
    again = Store(spark, store_path, quiet())
    assert not os.path.exists(stray) and os.path.exists(fresh) and contents(again) == {b"a": b"1"}


def test_an_open_during_a_flush_takes_nothing_away(spark, store_path, monkeypatch):
    s = Store(spark, store_path, quiet())
    s.put(b"a", b"1")
    s.flush()
    s.put(b"b", b"2")
    commit = s.manifests.commit

    def opened_in_between(manifest):
        assert contents(Store(spark, store_path, quiet())) == {b"a": b"1", b"b": b"2"}  # from the log
        assert contents(Store(spark, store_path, read_only=True)) == {b"a": b"1", b"b": b"2"}
        return commit(manifest)

    monkeypatch.setattr(s.manifests, "commit", opened_in_between)
    s.flush()
    assert contents(s) == contents(Store(spark, store_path, quiet())) == {b"a": b"1", b"b": b"2"}


def test_a_lost_manifest_is_rebuilt_from_the_runs(spark, store_path):
    s = Store(spark, store_path, quiet(value_threshold=20))
    for value in (b"1", b"2" * 40):
        s.put(b"a", value)
        s.put(b"b", b"3")
        s.flush()
    s.delete(b"b")
    s.flush()
    shutil.rmtree(f"{local(store_path)}/manifests")
    assert contents(Store(spark, store_path, read_only=True)) == {b"a": b"2" * 40}
    again = Store(spark, store_path, quiet(value_threshold=20))
    again.put(b"c", b"4")
    again.flush()
    assert contents(again) == contents(Store(spark, store_path, quiet())) == {b"a": b"2" * 40, b"c": b"4"}


def test_multi_get_reads_only_runs_that_may_hold_a_key(spark, store_path):
    s = Store(spark, store_path, quiet())
    for part in (b"a", b"m", b"z"):
        s.put(part + b"1", b"v")
        s.put(part + b"9", b"v")
        s.flush()
    got = s.multi_get([b"m1", b"m5"])
    assert {bytes(r["key"]) for r in got.collect()} == {b"m1"} and len(got.inputFiles()) == 1
    frame = spark.createDataFrame([(b"z0",), (b"z9",), (None,)], "key binary")
    assert {bytes(r["key"]) for r in s.multi_get(frame).collect()} == {b"z9"}
    assert s.multi_get([]).count() == s.multi_get(frame.limit(0)).count() == 0


def test_bloom_on_and_off_agree_and_skip(spark, store_path):
    s = Store(spark, store_path, quiet())
    for part in range(2):
        for i in range(40):
            s.put(f"k{i:03d}{part}".encode(), b"v", sync=False)
        s.flush()
    s.build_filters()
    keys = [b"k0050", b"k0061", b"k00a", b"k0155", b"k0201"]
    on = [s.get(k) for k in keys]
    assert s.counters.bloom_checks == 10 and s.counters.bloom_skips >= 6
    s.set_bloom_enabled(False)
    assert [s.get(k) for k in keys] == on == [b"v", b"v", None, None, b"v"]


def test_random_steps_match_a_dict(spark, store_path):
    rng, model = random.Random(20), {}
    s = Store(spark, store_path, Options(min_merge=3, value_threshold=24))
    for step in range(260):
        k = f"key{rng.randrange(30)}".encode()
        what = rng.random()
        if what < 0.7:
            model[k] = f"v{step}".encode() + b"x" * rng.randrange(40)
            s.put(k, model[k], sync=False)
        elif what < 0.95:
            model.pop(k, None)
            s.delete(k, sync=False)
        else:
            s.flush()
        if step == 120:
            s.compact_all()
        if step in (150, 230):
            s.close()
            s = Store(spark, store_path, s.options)
        if step == 200:
            s.collect_values()
    assert contents(s) == model
    for k in (b"key1", b"key7", b"nokey"):
        assert s.get(k) == model.get(k)
    a, b = b"key1", b"key3"
    assert [bytes(r["key"]) for r in s.scan(a, b).collect()] == sorted(k for k in model if a <= k < b)
