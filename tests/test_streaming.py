"""Streams give what batches give, also across restarts."""

from pyspark.sql import functions as F

from ferrywork.operators.targets import TargetTable
from ferrywork.streaming import sync as streams

SCHEMA = "id bigint, v bigint, s string"


def run(spark, folder, target, **kwargs):
    schema = spark.createDataFrame([], SCHEMA).schema
    stream = streams.file_stream(spark, f"{folder}/in", "*.parquet", schema, files_per_batch=1)
    streams.stream_sync(stream, target, "s", f"{folder}/_checkpoint", **kwargs).awaitTermination()


def test_stream_equals_batch_and_goes_on_after_a_restart(spark, tmp_path):
    folder = str(tmp_path)
    target = TargetTable(spark, folder, "out", ["id"], "v", compact_after=2)
    steps = [{"type": "compute", "config": {"expression": "w = v * 2"}}]
    for n in range(3):
        spark.range(10 * n, 10 * n + 20).selectExpr("id", f"{n} v", "'x' s").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run(spark, folder, target, transforms=steps)
    got = {r["id"]: (r["v"], r["w"]) for r in target.read().collect()}
    assert got == {i: (min(i // 10, 2), 2 * min(i // 10, 2)) for i in range(40)}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 1, "a"), (2, 2, None)], SCHEMA).coalesce(1).write.parquet(f"{folder}/in")
    target = TargetTable(spark, folder, "out", ["id"])
    run(spark, folder, target, required=["s"])
    assert [r["id"] for r in target.read().collect()] == [1]


def test_deletes_and_returns_follow_the_order_column(spark, tmp_path):
    folder = str(tmp_path)
    schema = "id bigint, v bigint, s string, deleted_at timestamp"
    from datetime import datetime

    at = datetime(2024, 1, 1)
    rows = [(1, 1, "a", None), (1, 2, "a", at), (2, 1, "b", at), (2, 2, "b2", None), (3, 1, "c", None)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/in")
    target = TargetTable(spark, folder, "out", ["id"], "v")
    stream = streams.file_stream(spark, f"{folder}/in", "*.parquet", spark.createDataFrame([], schema).schema)
    streams.stream_sync(stream, target, "d", f"{folder}/_checkpoint", deleted_column="deleted_at").awaitTermination()
    assert sorted((r["id"], r["s"]) for r in target.read().collect()) == [(2, "b2"), (3, "c")]


def test_repeated_keys_are_dropped(spark, tmp_path):
    folder = str(tmp_path)
    rows = spark.range(50).select((F.col("id") % 10).alias("id"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("t"))
    rows.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
    unique = streams.without_repeats(stream, ["id"], "t", "1 hour")
    query = (
        unique.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/_c")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(f"{folder}/out").collect()) == list(range(10))
