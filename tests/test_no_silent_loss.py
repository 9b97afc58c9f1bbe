"""Runs that used to lose or keep rows without a word."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrywork.functions import expressions  # noqa: F401
from ferrywork.operators import load, runlog
from ferrywork.operators.targets import TargetTable
from ferrywork.streaming import sync as streams
from ferrywork.plans.sync import FULL_REFRESH, Pipeline, SyncTable, Workspace, run_pipeline
from ferrywork.sources import folders

SCHEMA = "id int, updated_at timestamp, deleted_at timestamp"


def rows(n, without=()):
    return [(k, None if k in without else datetime(2024, 1, 1 + k), None) for k in range(n)]


def test_rows_without_bookmark_come_with_the_first_bounded_batch(spark, tmp_path):
    table = SyncTable("t", keys=("id",), max_rows=3)
    ws, pipeline = Workspace(spark, str(tmp_path)), Pipeline("p", "s", (table,))
    source = spark.createDataFrame(rows(10, {1, 4, 7}), SCHEMA)
    for k in range(4):
        assert run_pipeline(ws, pipeline, lambda _: source, f"r{k}", datetime(2024, 3, 1 + k)).outcome == "success"
    assert sorted(r.id for r in ws.target(table, "updated_at").read().collect()) == list(range(10))


def test_full_refresh_of_an_emptied_source(spark, tmp_path):
    table = SyncTable("t", keys=("id",), sync_mode=FULL_REFRESH)
    ws, pipeline = Workspace(spark, str(tmp_path)), Pipeline("p", "s", (table,))
    source = spark.createDataFrame(rows(5), SCHEMA)
    run_pipeline(ws, pipeline, lambda _: source, "r1", datetime(2024, 3, 1))
    assert ws.target(table, "updated_at").read().count() == 5
    run_pipeline(ws, pipeline, lambda _: source.limit(0), "r2", datetime(2024, 3, 2))
    assert ws.target(table, "updated_at").read().count() == 0


def test_lookback_needs_keys():
    with pytest.raises(ValueError):
        SyncTable("t", lookback="5 days")


def test_files_appear_whole(spark, tmp_path):
    path = f"{tmp_path}/marker.json"
    for text in ("one", "two"):
        folders.write_text(spark, path, text)
        assert folders.read_text(spark, path) == text
    assert folders.child_names(spark, str(tmp_path)) == ["marker.json"] or ".marker" in str(folders.child_names(spark, str(tmp_path)))


def test_daily_stats_serve_the_asked_range(spark):
    runs = spark.sql("SELECT timestamp '2024-06-30' - make_dt_interval(d) AS started_at, 1L AS rows_synced FROM (SELECT explode(sequence(0, 80)) AS d)")
    assert runlog.daily_run_stats(runs, "2024-06-30 00:00:00", 90).count() == 81


def test_pipelines_with_one_table_name_keep_apart(spark, tmp_path):
    table, ws = SyncTable("t", keys=("id",)), Workspace(spark, str(tmp_path))
    for name, n in (("a", 10), ("b", 15)):
        source = spark.createDataFrame(rows(n), SCHEMA)
        result = run_pipeline(ws, Pipeline(name, "s", (table,)), lambda _: source, f"run-{name}", datetime(2024, 3, 1))
        assert result.tables[0].rows_loaded == n
        assert ws.target(table, "updated_at", Pipeline(name, "s", (table,))).read().count() == n
    with pytest.raises(LookupError):
        ws.target(table)


def test_a_shared_target_holds_each_bookmark(spark, tmp_path):
    table, ws = SyncTable("t", keys=("id",), target_schema="both"), Workspace(spark, str(tmp_path))
    for name, low in (("a", 0), ("b", 5)):
        source = spark.createDataFrame([(k, datetime(2024, 1, 20 - low), None) for k in range(low, low + 5)], SCHEMA)
        # One run id in both: the commit of the other pipeline is not this one's.
        assert run_pipeline(ws, Pipeline(name, "s", (table,)), lambda _: source, "run", datetime(2024, 3, 1)).tables[0].rows_loaded == 5
    assert ws.target(table).read().count() == 10
    assert ws.bookmarks.get("a", "t") == "2024-01-20 00:00:00" and ws.bookmarks.get("b", "t") == "2024-01-15 00:00:00"


def test_late_deletes_and_deletes_alone(spark, tmp_path):
    table, ws = SyncTable("t", keys=("id",), lookback="5 days"), Workspace(spark, str(tmp_path))
    plain, pipelines = SyncTable("u", keys=("id",)), {}
    first = rows(10)
    late = [(k, u, datetime(2024, 1, 9) if k == 9 else None) for k, u, _ in first]
    gone = [(k, u, datetime(2024, 2, 1) if k < 2 else None) for k, u, _ in first]

    def cycle(table, data, run):
        pipeline = pipelines.setdefault(table.source_table, Pipeline(f"of-{table.source_table}", "s", (table,)))
        source = spark.createDataFrame(data, SCHEMA)
        return run_pipeline(ws, pipeline, lambda _: source, run, datetime(2024, 3, int(run[-1]))).tables[0]

    cycle(table, first, "t1")
    cycle(table, late, "t2")
    assert sorted(r.id for r in ws.target(table, "updated_at").read().collect()) == list(range(9))
    cycle(plain, first, "u1")
    assert [cycle(plain, gone, f"u{k}").rows_deleted for k in (2, 3, 4)] == [2, 0, 0]
    assert ws.target(plain, "updated_at").read().count() == 8


def test_json_keeps_microseconds(spark):
    times = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0, 123456)), (1, datetime(2024, 1, 1, 0, 0, 0, 123457))], "id int, t timestamp")
    raw = load.raw_rows(times, "r", F.current_timestamp())
    assert sorted(r.t for r in load.parse_raw(raw, times.schema).collect()) == sorted(r.t for r in times.collect())
    assert load.dedup_by_hash(times, ["id", "t"], ["id"]).count() == 2


@pytest.mark.parametrize("mode", ["direct", "raw"])
def test_letters_hold_the_value_also_across_scripts(spark, tmp_path, mode):
    steps = (
        {"type": "type_cast", "config": {"columns": {"code": "int"}}},
        {"type": "script", "config": {"script_name": "plain"}},
        {"type": "compute", "config": {"expression": "note = 6 // n"}},
    )
    table = SyncTable("t", keys=("id",), transforms=steps, load_mode=mode)
    ws = Workspace(spark, str(tmp_path))
    source = spark.createDataFrame([(1, "7", 2, "a"), (2, "A1", 3, "b"), (3, "8", 0, "c")], "id int, code string, n int, note string")
    done = run_pipeline(ws, Pipeline("p", "s", (table,)), lambda _: source, "r", datetime(2024, 3, 1), {"plain": lambda row: {k: row[k] for k in sorted(row)}})
    assert (done.tables[0].rows_loaded, done.tables[0].rows_failed) == (1, 2)
    letters = {json.loads(r.row_data)["id"]: json.loads(r.row_data) for r in ws.dead_letters().collect()}
    assert letters[2]["code"] == "A1" and letters[3]["note"] == "c"
    assert "_casts" not in str(letters) and not [c for c in ws.target(table).read().columns if "cast" in c or "error" in c]
    if mode == "raw":
        raw = spark.read.parquet(ws.raw_path("s", "t"))
        assert not raw.where("_data LIKE '%_casts%'").count()


def test_stream_letters_and_a_new_checkpoint(spark, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "1"), (2, "x2")], "id int, code string").coalesce(1).write.parquet(f"{folder}/in")
    target = TargetTable(spark, folder, "out", ["id"])
    steps = [{"type": "type_cast", "config": {"columns": {"code": "int"}}}]
    for n in range(2):
        stream = streams.file_stream(spark, f"{folder}/in", "*.parquet", spark.read.parquet(f"{folder}/in").schema, files_per_batch=1)
        streams.stream_sync(stream, target, "s", f"{folder}/checkpoint{n}", steps).awaitTermination()
        spark.createDataFrame([(3, "3"), (4, "x4")], "id int, code string").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    assert sorted(r.id for r in target.read().collect()) == [1, 3]
    codes = {json.loads(r.row_data)["code"] for r in spark.read.parquet(streams.dead_letter_folder(target)).collect()}
    assert codes == {"x2", "x4"}
