"""Merge and target tables: idempotence, order of batches, crashes, plans."""

import random

import pytest
from pyspark.sql import functions as F

from ferrywork.operators import merge
from ferrywork.operators.targets import MARKER, TargetTable
from ferrywork.sources import folders

SCHEMA = "k int, v int, s string"


def rows(df, *columns):
    return sorted([tuple(r) for r in df.select(*(columns or df.columns)).collect()], key=repr)


@pytest.fixture()
def target(spark, tmp_path):
    return TargetTable(spark, str(tmp_path), "My-Table", ["k"], "v", buckets=4)


def put(target, data, run, op=None):
    df = target.spark.createDataFrame(data, SCHEMA)
    df = df if op is None else df.withColumn("_op", F.lit(op))
    target.append(df, run).commit()


def test_merge_newest_per_key_and_null_keys_are_added(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (None, 1, "n")], SCHEMA)
    new = spark.createDataFrame([(2, 5, "x"), (2, 7, "y"), (3, 1, "c"), (None, 2, "m")], SCHEMA)
    got = merge.merge_rows(old, new, ["k"], merge.newest_first("v"))
    assert rows(got) == sorted([(1, 1, "a"), (2, 7, "y"), (3, 1, "c"), (None, 1, "n"), (None, 2, "m")], key=repr)


def test_delete_ignores_null_keys_and_handles_pairs(spark):
    old = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], SCHEMA)
    gone = spark.createDataFrame([(1, 2, ""), (2, None, ""), (1, 2, "")], SCHEMA)
    assert rows(merge.delete_by_key(old, gone, ["k", "v"])) == sorted([(1, 1, "a"), (2, None, "c")], key=repr)
    assert rows(merge.rows_to_delete(old, gone, ["k", "v"])) == [(1, 2, "b")]
    assert merge.delete_by_key(old, gone, []) is old


def test_insert_ignore(spark):
    old = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    new = spark.createDataFrame([(1, 9, "x"), (2, 1, "b"), (2, 2, "c"), (None, 0, "n")], SCHEMA)
    assert rows(merge.insert_ignore(old, new, ["k"], merge.newest_first("v"))) == sorted([(2, 2, "c"), (None, 0, "n")], key=repr)


def test_batches_one_by_one_equal_all_at_once(spark, tmp_path):
    rng = random.Random(1)
    changes = [(rng.randint(0, 30), i, f"s{i}") for i in range(120)]
    one = TargetTable(spark, str(tmp_path / "one"), "t", ["k"], "v", buckets=3)
    put(one, changes, "all")
    many = TargetTable(spark, str(tmp_path / "many"), "t", ["k"], "v", buckets=3, compact_after=3)
    for n in range(6):
        put(many, changes[n * 20 : n * 20 + 20], f"r{n}")
        many.compact_if_due()
    newest = {}
    for k, v, s in changes:
        newest[k] = (k, v, s)
    assert rows(one.read()) == rows(many.read()) == sorted(newest.values(), key=repr)
    put(many, changes[100:], "again")
    assert rows(many.read()) == rows(one.read())


def test_deletes_and_later_upserts(target):
    put(target, [(1, 1, "a"), (2, 1, "b")], "r1")
    put(target, [(1, None, None)], "r2", "D")
    assert rows(target.read()) == [(2, 1, "b")]
    put(target, [(1, 0, "back")], "r3")
    assert rows(target.read()) == [(1, 0, "back"), (2, 1, "b")]
    target.compact()
    assert rows(target.read()) == [(1, 0, "back"), (2, 1, "b")] and target.version()[0] == 2


def test_uncommitted_batch_is_invisible_and_overwritten(target):
    put(target, [(1, 1, "a")], "r1")
    target.append(target.spark.createDataFrame([(9, 9, "lost")], SCHEMA), "r2")
    assert rows(target.read()) == [(1, 1, "a")] and target.commit_of("r2") is None
    put(target, [(2, 2, "b")], "r2")
    assert rows(target.read()) == [(1, 1, "a"), (2, 2, "b")]
    assert target.commit_of("r2")["run_id"] == "r2"


def test_half_written_base_is_ignored(target):
    put(target, [(1, 1, "a")], "r1")
    folder = f"{target.path}/v=00002.b=4/base"
    target.spark.range(1).write.parquet(folder)
    assert target.version()[0] == 1
    target.compact()
    assert target.version()[0] == 2 and rows(target.read()) == [(1, 1, "a")]


def test_replace_and_old_versions(target):
    put(target, [(1, 1, "a"), (2, 1, "b")], "r1")
    target.replace(target.spark.createDataFrame([(5, 1, "n"), (5, 2, "m")], SCHEMA), "r2")
    assert rows(target.read()) == [(5, 2, "m")]
    target.replace(target.spark.createDataFrame([], SCHEMA), "r3")
    assert rows(target.read()) == [] and target.read().columns == ["k", "v", "s"]
    target.drop_old_versions(keep=1)
    assert [n for n in folders.child_names(target.spark, target.path)] == ["v=00003.b=4"]
    put(target, [(7, 7, "z")], "r4")
    assert rows(target.read()) == [(7, 7, "z")]


def test_new_columns_are_null_in_old_rows(target):
    put(target, [(1, 1, "a")], "r1")
    target.append(target.spark.createDataFrame([(2, 2, "b", 0.5)], SCHEMA + ", x double"), "r2").commit()
    assert rows(target.read()) == sorted([(1, 1, "a", None), (2, 2, "b", 0.5)], key=repr)
    target.compact()
    put(target, [(3, 3, "c")], "r3")
    assert rows(target.read(), "k", "x") == sorted([(1, None), (2, 0.5), (3, None)], key=repr)


def test_changed_type_is_refused(target):
    put(target, [(1, 1, "a")], "r1")
    with pytest.raises(TypeError, match="v"):
        target.append(target.spark.createDataFrame([(1, "x", "a")], "k int, v string, s string"), "r2")


def test_rejected_rows_stay_outside(target):
    df = target.spark.createDataFrame([(1, 1, "ok"), (2, 2, "bad")], SCHEMA)
    batch = target.append(df, "r1", rejected=F.col("s") == "bad")
    batch.commit()
    assert rows(target.read()) == [(1, 1, "ok")] and rows(batch.rejected_rows(), "k") == [(2,)]


def test_growing_target_without_keys(spark, tmp_path):
    log = TargetTable(spark, str(tmp_path), "log", [])
    put(log, [(1, 1, "a")], "r1")
    put(log, [(1, 1, "a")], "r2")
    assert len(rows(log.read())) == 2
    log.compact()
    assert len(rows(log.read())) == 2 and log.commit_of("r2") and log.commit_of("r9") is None


def test_base_is_not_shuffled_when_changes_are_large(spark, target):
    target.replace(spark.range(5000).selectExpr("cast(id as int) k", "1 v", "'a' s"), "r1")
    put(target, [(i, 2, "b") for i in range(0, 5000, 3)], "r2")
    saved = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = target._parts()[0]
        plan = kept._jdf.queryExecution().executedPlan().toString()
        left = plan.split("SortMergeJoin")[1].split("FileScan")[1].split("\n")[0]
        assert "Bucketed: true" in left and plan.count("Exchange hashpartitioning") == 1, plan
        assert target.read().where("v = 2").count() == 1667
    finally:
        for key, value in saved.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_one_key_with_a_third_of_all_rows(spark, target):
    hot = spark.range(30_000).selectExpr("cast(if(id % 3 = 0, -1, id) as int) k", "cast(id as int) v", "'h' s")
    target.append(hot, "r1").commit()
    got = target.read()
    assert got.count() == 20_001 and got.where("k = -1").first()["v"] == 29_997
    plan = target._parts()[-1]._jdf.queryExecution().executedPlan().toString()
    below = plan.split("Exchange hashpartitioning")[1]
    assert "WindowGroupLimit" in below


def test_marker_is_one_file(target):
    put(target, [(1, 1, "a")], "r1")
    assert MARKER in folders.child_names(target.spark, f"{target.path}/v=00001.b=4/changes/batch=00001")


def test_old_versions_go_after_compaction(target):
    target.compact_after = 1
    for n in range(4):
        put(target, [(n, n, "a")], f"r{n}")
        assert target.compact_if_due()
    assert [n[:7] for n in folders.child_names(target.spark, target.path)] == ["v=00004", "v=00005"]
    assert rows(target.read(), "k") == [(0,), (1,), (2,), (3,)]
    assert target.commit_of("r3") and target.version()[0] == 5
