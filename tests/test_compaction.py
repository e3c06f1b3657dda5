"""Which runs are merged, and how a merged run is cut."""

import pytest
from pyspark.sql import functions as F

from keystrata.functions import scalar
from keystrata.operators.compaction import pick_leveled, pick_tiered, reaches_oldest, split_points
from keystrata.sources.manifest import Manifest, RunInfo


def run(i, size, level=0, lo=b"a", hi=b"z"):
    return RunInfo(f"run-{i:06d}", f"p{i}", level, 1, 0, size, lo, hi, i)


def test_tiered_takes_neighbours_of_one_size_class():
    runs = [run(9, 100), run(8, 110), run(7, 5000), run(6, 120), run(5, 100), run(4, 127)]
    pick = pick_tiered(runs, min_merge=3)
    assert [r.name for r in pick.runs] == ["run-000006", "run-000005", "run-000004"] and pick.drop_tombstones
    assert pick_tiered(runs, min_merge=4) is None


def test_tombstones_stay_unless_the_pick_reaches_the_oldest_run():
    runs = [run(4, 100), run(3, 100), run(2, 100), run(1, 100_000)]
    assert not pick_tiered(runs, min_merge=3).drop_tombstones
    assert reaches_oldest(runs, runs[2:]) and not reaches_oldest(runs, runs[:2])


def test_smallest_class_then_newest_group_wins():
    runs = [run(6, 1000), run(5, 1000), run(4, 10), run(3, 10), run(2, 1000), run(1, 1000)]
    assert [r.name for r in pick_tiered(runs, min_merge=2).runs] == ["run-000004", "run-000003"]
    runs = [run(5, 10), run(4, 10), run(3, 999), run(2, 10), run(1, 10)]
    assert [r.name for r in pick_tiered(runs, min_merge=2).runs] == ["run-000005", "run-000004"]


def test_merge_output_takes_the_newest_inputs_place():
    runs = [run(5, 1), run(4, 1), run(3, 1), run(2, 1)]
    new = run(9, 2)
    assert [r.name[-1] for r in Manifest(runs=tuple(runs)).replaced(runs[1:3], [new]).runs] == ["5", "9", "2"]


def test_leveled_picks():
    low, high = run(1, 10, 1, b"a", b"f"), run(2, 10, 1, b"m", b"q")
    fresh = [run(4, 10, 0, b"b", b"c"), run(3, 10, 0, b"c", b"e")]
    pick = pick_leveled([*fresh, low, high], 2, 1000)
    assert set(pick.runs) == {*fresh, low} and pick.level == 1 and pick.drop_tombstones
    deep = run(0, 10, 2, b"a", b"z")
    assert not pick_leveled([*fresh, low, high, deep], 2, 1000).drop_tombstones
    over = pick_leveled([low, high, deep], 2, 15)
    assert set(over.runs) == {low, deep} and over.level == 2
    assert pick_leveled([low, high], 2, 1000) is None


def test_leveled_takes_all_the_excess_at_once():
    files = [run(i, 10, 1, b"k%03d" % (2 * i), b"k%03d" % (2 * i + 1)) for i in range(100)]
    pick = pick_leveled(files[::-1], 2, 200)
    assert pick.move and pick.level == 2 and list(pick.runs) == files[:80]  # nothing below: the level alone changes
    below = run(200, 10, 2, b"k101", b"k102")
    pick = pick_leveled([*files, below], 2, 200)
    assert pick.move and list(pick.runs) == files[:50]
    pick = pick_leveled([*files[50:], below], 2, 200)
    assert not pick.move and list(pick.runs) == [*files[50:80], below]


def test_tombstones_are_not_moved_to_where_they_may_go():
    dead = RunInfo("run-000001", "p", 1, 5, 2, 30, b"a", b"f", 1)
    pick = pick_leveled([dead], 2, 10)
    assert not pick.move and pick.drop_tombstones
    assert pick_leveled([dead, run(0, 10, 3, b"a", b"z")], 2, 10).move


def test_manifest_round_trip_and_foreign_file():
    m = Manifest(version=3, runs=(run(1, 5, lo=b"\x00", hi=b"\xff"),), generations=(1, 2), batches={"b:1": 2})
    assert Manifest.loads(m.dumps()) == m
    with pytest.raises(ValueError):
        Manifest.loads(b"{}")


def test_split_points_equal_a_running_sum(spark):
    rows = [(f"k{i:04d}", 7 + i * 13 % 40) for i in range(300)]
    got = dict(split_points(spark.createDataFrame(rows, "key string, n int"), F.col("n"), 100.0, "key", 5).select("key", "file_no").collect())
    total, want = 0, {}
    for k, n in rows:
        total += n
        want[k] = (total - 1) // 100
    assert got == want


def test_scalars(spark):
    row = spark.range(1).select(
        scalar.size_bucket(F.lit(0)).alias("a"), scalar.size_bucket(F.lit(1 << 20)).alias("b"), scalar.bloom_bits(F.lit(0)).alias("c"), scalar.bloom_bits(F.lit(1000)).alias("d"),
        scalar.bloom_hashes(F.lit(9586), F.lit(1000)).alias("e"), scalar.level_budget(F.lit(3), 64.0).alias("f"), scalar.padded_key(F.lit(7)).alias("g"),
        scalar.log_bytes(F.lit(b"abc"), F.lit(b"de")).alias("h"), scalar.user_bytes(F.lit("é"), F.lit(None).cast("string")).alias("i"), scalar.human_bytes(F.lit(2048)).alias("j"),
    ).first()
    assert tuple(row) == (0, 20, 1, 9586, 7, 256, "key0000000007", 14, 2, "2.0 KiB")
    assert all(scalar.size_bucket_of(1 << i) == i for i in range(40))
    assert scalar.sequence_of("run-000012") == 12 and scalar.sequence_of("gen=000003") == 3 and scalar.sequence_of("x") is None
