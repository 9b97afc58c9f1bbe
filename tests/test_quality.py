"""Quality checks, dead letters and raw rows on tiny frames."""

from datetime import datetime

from pyspark.sql import functions as F

from ferrywork.operators import deadletter as dl, load, quality


def test_row_count_check_edges(spark):
    df = spark.createDataFrame([(0, 0), (100, 95), (1000, 949), (0, 7)], "rows_extracted bigint, rows_loaded bigint")
    got = [(r["discrepancy_pct"], r["status"], r["passed"]) for r in quality.row_count_check(df).collect()]
    assert got == [(0.0, "passed", True), (5.0, "passed", True), (5.1, "failed", False), (0.0, "passed", True)]


def test_null_check(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    row = quality.null_check(df, ["a", "b", "gone"]).first()
    assert (row["status"], row["null_columns"], row["passed"]) == ("warning", "b(1), gone(2)", False)
    empty = quality.null_check(df.limit(0), ["a", "gone"]).first()
    assert (empty["status"], empty["null_columns"], empty["passed"]) == ("passed", None, True)
    assert quality.null_check(df, []).first()["status"] == "passed"


def test_duplicates_also_of_equal_rows_and_hot_keys(spark):
    hot = [(0, i % 50, "h") for i in range(3000)]
    data = hot + [(1, 5, "a"), (1, 5, "a"), (1, 4, "b"), (2, 1, "c"), (None, 1, "n"), (None, 1, "n")]
    df = dl.row_errors(spark.createDataFrame(data, "k int, v int, s string"), ["s"])
    got = dl.mark_duplicates(df, ["k"], ["v"])
    assert got.count() == len(data)
    good = sorted([(r["k"], r["v"]) for r in got.where("error_type IS NULL").collect()], key=repr)
    assert good == sorted([(0, 0), (1, 4), (2, 1), (None, 1), (None, 1)], key=repr)


def test_rejected_rows_keep_their_content(spark):
    df = spark.createDataFrame([(1, None, datetime(2024, 1, 2, 3))], "a int, b string, t timestamp")
    letters = dl.dead_letters(dl.row_errors(df, ["b"]), "My Source.x", "t", "r1", F.lit(datetime(2024, 1, 1)))
    row = letters.first()
    assert row["source_name"] == "my_source_x" and row["error_text"] == "required value is NULL: b"
    assert row["row_data"].startswith('{"a":1,"b":null,"t":"2024-01-02T03:00:00')


def test_raw_rows_roundtrip_and_expiry(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 1.5), (1, None, 1.5), (2, "x", None)], "a int, b string, c double")
    old = load.raw_rows(df, "r1", F.lit(datetime(2024, 1, 1, 5, 30)))
    new = load.raw_rows(df, "r2", F.lit(datetime(2024, 1, 9)))
    load.write_raw(old, str(tmp_path / "raw"), "r1", datetime(2024, 1, 1))
    load.write_raw(new, str(tmp_path / "raw"), "r2", datetime(2024, 1, 9))
    # A repeated run replaces its own rows.
    load.write_raw(new, str(tmp_path / "raw"), "r2", datetime(2024, 1, 9))
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert sorted(map(repr, load.parse_raw(raw.where("_run_id = 'r2'"), df.schema).select("a", "b", "c").collect())) == sorted(map(repr, df.collect()))
    as_of = F.lit(datetime(2024, 1, 8, 5, 0))
    assert load.live_raw_rows(raw, as_of).count() == 3
    assert load.live_raw_rows(raw, F.lit(datetime(2024, 1, 8, 4, 59))).count() == 6
    assert load.expire_raw(spark, str(tmp_path / "raw"), datetime(2024, 1, 9, 12)) == ["2024-01-01"]
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 3
    assert load.dedup_by_hash(df, ["a", "b", "c"], ["a"]).count() == 2


def test_align_to_target_types(spark):
    df = spark.createDataFrame([("7", 1), ("x", 2)], "N string, extra int")
    schema = spark.createDataFrame([], "n int, m string").schema
    assert [tuple(r) for r in load.align_to(df, schema).collect()] == [(7, None), (None, None)]


def test_listings_are_sorted_by_kind(spark):
    from ferrywork.operators import runlog

    df = spark.createDataFrame([(2, "b"), (10, "A"), (1, None), (3, "B")], "n int, s string").repartition(3)
    assert [r["n"] for r in runlog.sorted_listing(df, "n", True).collect()] == [10, 3, 2, 1]
    assert [r["s"] for r in runlog.sorted_listing(df, "s").collect()] == ["A", "B", "b", None]


def test_log_rows_of_a_run_are_those_of_the_frame(spark):
    import json

    for n, loaded, folded, nulls in ((100, 90, 5, 3), (100, 5, 95, 0), (0, 0, 0, 0), (7, 6, 0, 1), (3, 2, 0, 0)):
        counts = {"table_name": "t", "rows_extracted": n, "rows_loaded": loaded, "rows_folded": folded, "nulls_a": nulls, "nulls_b": 0}
        frame = spark.createDataFrame([counts])
        want = [json.loads(x) for x in quality.checks_of_counts(frame, ["a", "b"], 5.0).toJSON().collect()]
        by_type = lambda rows: sorted(rows, key=lambda r: r["check_type"])
        assert by_type(quality.checks_of_run(counts, ["a", "b"], 5.0)) == by_type(want)
