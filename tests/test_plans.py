"""Plan builders: results against plain definitions, and the physical plans that they must have."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corpusgrid.operators import dedup, planning, selection
from corpusgrid.plans.intervals import coalesce_ranges, explode_range, overlap_join
from corpusgrid.plans.scale import running, two_level


def explained(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_running_sums_and_lags_agree_at_both_levels(spark):
    r = random.Random(3)
    rows = [(f"k{r.randrange(400):03d}", i, r.randrange(100)) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, i int, v long")
    order = [F.col("k"), F.col("i")]
    found = lambda out: {(x["k"], x["i"]): (x["s"], x["p"], x["m"]) for x in out.collect()}
    one = found(running(df, order, {"s": "v"}, {"p": "v"}, None, {"m": "v"}))
    two = found(two_level(df, order, {"s": "v"}, {"p": "v"}, {"m": "v"}))
    total, before, most, want = 0, None, -1, {}
    for k, i, v in sorted(rows):
        total, most = total + v, max(most, v)
        want[k, i] = (total, before, most)
        before = v
    assert one == two == want


def test_running_over_nothing(spark):
    df = spark.createDataFrame([], "k string, v long")
    assert two_level(df, [F.col("k")], {"s": "v"}, {}).count() == running(df, [F.col("k")], {"s": "v"}).count() == 0


def test_overlap_join_equals_the_plain_predicate_without_a_nested_loop(spark):
    r = random.Random(5)
    make = lambda n: [(i, s := r.randrange(5000), s + r.choice([0, 1, 7, 300, 2000])) for i in range(n)]
    a, b = make(200), make(60)
    left, right = spark.createDataFrame(a, "a int, s long, e long"), spark.createDataFrame(b, "b int, t long, f long")
    got = overlap_join(left, right, "s", "e", "t", "f", 256)
    want = {(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2] and x[1] < x[2] and y[1] < y[2]}
    assert sorted((x["a"], x["b"]) for x in got.collect()) == sorted(want)
    semi = overlap_join(left, right, "s", "e", "t", "f", 256, "left_semi")
    assert {x["a"] for x in semi.collect()} == {x for x, _ in want}
    for plan in (explained(got), explained(semi)):
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_coalesce_ranges(spark):
    df = spark.createDataFrame([(0, 5), (5, 9), (12, 12), (20, 30)], "s long, e long")
    assert sorted(map(tuple, coalesce_ranges(df, "s", "e").select("s", "e").collect())) == [(0, 9), (20, 30)]
    nested = spark.createDataFrame([(0, 10), (1, 2), (3, 4), (3, 12), (14, 15), (14, 20), (15, 16), (None, 3)], "s long, e long")
    assert sorted(map(tuple, coalesce_ranges(nested, "s", "e").select("s", "e").collect())) == [(0, 12), (14, 20)]


def test_a_run_of_ten_million_blocks_is_dealt_over_all_tasks(spark):
    files = spark.createDataFrame([("a.txt", 10_000_000 * 8, False), ("empty.jpg", 0, True), ("b.txt", 3, False)], "path string, size long, force_raw boolean")
    blocks = planning.block_table(files, 8)
    got = blocks.withColumn("task", F.spark_partition_id()).agg(F.count("*"), F.count_distinct("block_id"), F.sum("raw_len"), F.count_distinct("task")).first()
    assert tuple(got)[:3] == (10_000_001, 10_000_001, 80_000_003) and got[3] > 1


def test_ranges_are_exploded_in_steps(spark):
    df = spark.createDataFrame([(0, 200_000), (5, 4), (7, 7), (-3, 1)], "a long, b long")
    got = explode_range(df, F.col("a"), F.col("b"), "i").groupBy("a").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"))
    assert sorted(map(tuple, got.collect())) == [(-3, 5, -3, 1), (0, 200_001, 0, 200_000), (7, 1, 7, 7)]


def test_blocks_tile_the_stream_and_are_as_many_as_planned(spark, small_dir):
    files = planning.document_files(spark, small_dir)
    blocks = planning.block_table(files, planning.BLOCK)
    total = files.agg(F.sum("size")).first()[0]
    assert blocks.agg(F.sum("raw_len")).first()[0] == total
    assert blocks.count() == planning.q_dir_block_count(spark, small_dir).first()["blocks"]
    assert selection.q_extents(spark, small_dir).agg(F.sum("len")).first()[0] == total


def test_golden_runs(spark):
    rows = planning.q_dir_blocks(spark, "/root/testdata/sf0.01").orderBy("run_id").collect()
    assert len(rows) == 10
    assert [tuple(r)[:5] for r in rows[:2]] == [(1, False, 0, 123537, 2), (2, True, 123537, 10916, 1)]


def test_a_flip_of_the_raw_policy_ends_a_block_and_its_absence_fills_it(spark):
    r = random.Random(11)
    files = [(f"{i:02d}{'.png' if raw else '.md'}", r.randrange(0, 40), raw) for i, raw in enumerate([False] * 5 + [True] * 5)]
    df = spark.createDataFrame(files, "path string, size long, force_raw boolean")
    plain, raw = (sum(n for _, n, x in files if x is y) for y in (False, True))
    got = planning.block_table(df, 16).groupBy("force_raw").agg(F.count("*").alias("n"), F.max("raw_len").alias("most")).collect()
    assert {x["force_raw"]: (x["n"], x["most"]) for x in got} == {False: (-(-plain // 16), 16), True: (-(-raw // 16), 16)}


def test_files_above_the_fragment_limit_come_first(spark):
    limit = planning.fragment_limit(planning.BLOCK)
    files = [(f"{name}-{size}", size, raw) for name, raw in (("z", False), ("a", True)) for size in (limit + 1, limit, 1)]
    df = spark.createDataFrame(files, "path string, size long, force_raw boolean")
    place = lambda f: (0 if f[1] > limit else 2 if f[2] else 1, f[0])
    assert [x["path"] for x in planning.file_order(df, planning.BLOCK).orderBy("place").collect()] == [f[0] for f in sorted(files, key=place)]


@pytest.mark.parametrize("bad", ["", "/a", "a/../b", "./."])
def test_bad_prefixes(bad):
    with pytest.raises(ValueError):
        selection.normal_prefix(bad)


def test_selecting_nothing_is_an_error_where_something_is_required(spark, small_dir):
    files = planning.document_files(spark, small_dir)
    with pytest.raises(ValueError):
        selection.selected(files, ["nowhere"], (), required=True)
    assert selection.selected(files, ["documents/src1"]).count() < selection.selected(files, ["documents"]).count()


def test_metadata_queries_read_no_text_they_do_not_need(spark, small_dir):
    plan = explained(planning.q_ext_counts(spark, small_dir))
    assert "ReadSchema: struct<doc_id:bigint>" in plan


def test_reference_chains(spark):
    refs = spark.createDataFrame([(0, None), (1, 0), (2, 1), (3, 2), (9, 77)], "id long, target long")
    assert {r["id"]: r["data_id"] for r in dedup.resolve(refs).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 9: 77}
