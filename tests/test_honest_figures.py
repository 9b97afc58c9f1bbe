"""Figures that come from what was written, rows that stay apart, and values that wait for their column."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrywork.operators import deadletter as dl, quality, runlog
from ferrywork.operators.merge import unfolded
from ferrywork.operators.targets import TargetTable
from ferrywork.plans import sync
from ferrywork.plans.sync import Pipeline, SyncTable, Workspace, reprocess_letters, run_pipeline
from ferrywork.sources import folders, scans
from ferrywork.streaming import sync as streams

AT = datetime(2024, 3, 1)


def test_rows_folded_into_one_key_are_counted(spark, tmp_path):
    ws, table = Workspace(spark, str(tmp_path)), SyncTable("t", keys=("id",))
    source = spark.range(100).selectExpr("id % 5 AS id", "id AS n")
    done = run_pipeline(ws, Pipeline("p", "s", (table,)), lambda _: source, "r", AT).tables[0]
    assert (done.rows_extracted, done.rows_loaded, done.rows_folded, done.quality_passed) == (100, 5, 95, True)


@pytest.mark.parametrize("mode", [sync.INCREMENTAL, sync.FULL_REFRESH])
def test_a_lost_file_fails_the_row_count(spark, tmp_path, monkeypatch, mode):
    ws, table = Workspace(spark, str(tmp_path)), SyncTable("t", keys=("id",), sync_mode=mode)
    source = spark.range(0, 100, 1, 4).selectExpr("id", "id AS n")

    def losing(original):
        def write(*args, **kwargs):
            batch = original(*args, **kwargs)
            folder = f"{batch.path}/_rejected=false" if mode == sync.INCREMENTAL else batch.path
            name = next(n for n in folders.child_names(spark, folder) if n.startswith("part-"))
            folders.remove(spark, f"{folder}/{name}")
            return batch

        return write

    monkeypatch.setattr(sync.TargetTable, "append", losing(sync.TargetTable.append))
    monkeypatch.setattr(sync, "_stage", losing(sync._stage))
    done = run_pipeline(ws, Pipeline("p", "s", (table,)), lambda _: source, "r", AT).tables[0]
    assert (done.rows_extracted, done.rows_loaded, done.quality_passed) == (100, 75, False)
    log = {r.check_type: r for r in spark.read.json(ws.log_path("quality")).collect()}
    assert (log["row_count"].status, log["row_count"].discrepancy_pct) == ("failed", 25.0)


def test_two_pipelines_with_one_run_id(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    table = SyncTable("orders", keys=("id",), required=("v",), load_mode="raw")
    for name, n in (("a", 4), ("b", 6)):
        source = spark.range(n).selectExpr("id", "nullif(id, 1) AS v")
        assert run_pipeline(ws, Pipeline(name, "shop", (table,)), lambda _: source, "run-1", AT).outcome == "success"
    assert spark.read.parquet(ws.raw_path("shop", "orders")).count() == 10
    letters = ws.dead_letters()
    assert sorted(r.pipeline_id for r in letters.collect()) == ["a", "b"] and letters.select("id").distinct().count() == 2
    runs, stats = ws.read_log("runs", sync.RUNS), ws.read_log("run_table_stats", sync.STATS)
    assert sorted((r.pipeline_id, r.rows_synced) for r in runs.collect()) == [("a", 3), ("b", 5)]
    assert sorted((r.pipeline_id, r.rows_synced) for r in runlog.run_summary(stats).collect()) == [("a", 3), ("b", 5)]
    assert runlog.runs_by_asset(runs, stats).count() == 2 and stats.where("rows_loaded_raw > 0").count() == 2
    assert {r.pipeline_id for r in sync.run_alerts(ws, "run-1").collect()} == {"a", "b"}
    assert {r.pipeline_id for r in sync.run_alerts(ws, "run-1", "a").collect()} == {"a"}
    lines = ws.read_log("run_logs", sync.LINES)
    assert runlog.log_lines(lines.where("pipeline_id = 'a'"), "run-1", 0, 1).first().message == "run started: 1 tables"
    assert ws.prune_logs(datetime(2025, 1, 1)) == 2 and ws.read_log("run_logs", sync.LINES).count() == 0


def test_equal_rejects_have_letters_of_their_own(spark):
    rows = spark.createDataFrame([(None, "x")] * 5 + [(None, "y")], "a int, b string")
    letters = dl.dead_letters(dl.row_errors(rows, ["a"]), "s", "t", "r", F.lit(AT), pipeline_id="p")
    assert letters.select("id").distinct().count() == letters.count() == 6
    assert sorted(r.id for r in letters.collect()) == sorted(r.id for r in letters.repartition(3).collect())


def test_unfolded_gives_every_copy_once(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 7), ("c", 10)], "k string, n long")
    got = sorted((r.k, r.copy) for r in unfolded(rows, "n", "copy", block=3).collect())
    assert got == [(k, c) for k, n in (("a", 1), ("b", 7), ("c", 10)) for c in range(1, n + 1)]


def test_reprocessed_letters_end_and_older_rows_do_not_win(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    cast = ({"type": "type_cast", "config": {"columns": {"n": "int"}}},)
    table = SyncTable("t", keys=("id",), bookmark_column="updated_at", transforms=cast, required=("n",))
    pipeline = Pipeline("p", "s", (table,))
    day = lambda d: datetime(2024, 1, d)
    first = [(1, "1", day(1)), (2, "x2", day(1)), (3, "x3", day(1)), (4, "y", day(1)), (2, "x2", day(1))]
    schema = "id int, n string, updated_at timestamp"
    assert reprocess_letters(ws, pipeline, table, "early", AT) == (0, 0)
    run_pipeline(ws, pipeline, lambda _: spark.createDataFrame(first, schema), "r1", AT)
    run_pipeline(ws, pipeline, lambda _: spark.createDataFrame([(3, "33", day(9))], schema), "r2", datetime(2024, 3, 2))
    repair = [{"type": "map_values", "config": {"column": "n", "mapping": {"x2": "2", "x3": "3"}}}]
    assert reprocess_letters(ws, pipeline, table, "again", AT, repair) == (3, 1)
    assert reprocess_letters(ws, pipeline, table, "again", AT, repair) == (3, 1)
    target = ws.target(table, "updated_at", pipeline)
    assert sorted((r.id, r.n) for r in target.read().collect()) == [(1, 1), (2, 2), (3, 33)]
    waiting = ws.dead_letters().where("NOT reprocessed").collect()
    assert [json.loads(r.row_data)["n"] for r in waiting] == ["y"] and ws.dead_letters().count() == 4
    assert reprocess_letters(ws, pipeline, table, "third", AT, [{"type": "map_values", "config": {"column": "n", "mapping": {"y": "4"}}}]) == (1, 0)
    assert ws.dead_letters().where("NOT reprocessed").count() == 0 and target.read().count() == 4


def test_rescued_values_come_back_with_their_type(spark, tmp_path):
    ws = Workspace(spark, str(tmp_path))
    steps = [
        (False, "SELECT 1 AS id, timestamp'2024-01-01' AS updated_at"),
        (False, "SELECT 2 AS id, timestamp'2024-01-02' AS updated_at, timestamp'2020-02-03 04:05:06.000007' AS seen, 1.25D AS `it's`, array(1, 2) AS list, cast(NULL AS int) AS none"),
        (False, "SELECT 3 AS id, timestamp'2024-01-03' AS updated_at, cast(NULL AS timestamp) AS seen, 7.5D AS `it's`, array(3) AS list, 4 AS none"),
        (True, "SELECT 4 AS id, timestamp'2024-01-04' AS updated_at, timestamp'2024-01-01' AS seen, 9.5D AS `it's`, array(4) AS list, 5 AS none"),
    ]
    for number, (evolve, sql) in enumerate(steps):
        table = SyncTable("t", keys=("id",), auto_evolve=evolve)
        assert run_pipeline(ws, Pipeline("p", "s", (table,)), lambda _: spark.sql(sql), f"r{number}", datetime(2024, 3, 1 + number)).outcome == "success"
        if number == 2:
            now = ws.target(table, "updated_at").read()
            assert now.columns == ["id", "updated_at", "_run_id", "_synced_at"]
    for compacted in (False, True):
        target = ws.target(table, "updated_at")
        if compacted:
            target.compact()
        got = {r.id: (str(r.seen), r["it's"], r.list, r.none) for r in target.read().collect()}
        assert got == {1: ("None", None, None, None), 2: ("2020-02-03 04:05:06.000007", 1.25, [1, 2], None), 3: ("None", 7.5, [3], 4), 4: ("2024-01-01 00:00:00", 9.5, [4], 5)}
    versions = ws.schema_versions().orderBy("version").collect()
    assert [v.version for v in versions][:1] == [1] and versions[-1].columns.endswith("none")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz", "date", "bigint", "int", "string"])
def test_cut_is_the_row_count_reached(spark, kind):
    number = "cast(id * id % 977 AS int)"
    made = {"string": f"lpad({number}, 6, '0')", "bigint": f"{number} * 9000000000000000", "int": number, "date": f"date_add(date'1960-01-01', {number})"}
    moved = made.get(kind, f"{kind}'1950-01-01 00:00:00' + make_dt_interval({number}, 0, 0, 0.000001)")
    df = spark.range(3000).selectExpr("id", f"{moved} AS t").unionAll(spark.sql(f"SELECT -1L, cast(NULL AS {kind})"))
    values = sorted(r.t for r in df.where("t IS NOT NULL").collect())
    for limit in (1, 10, 1500, 2999, 3000, 9999):
        for unordered in (False, True):
            got = sorted(r.t for r in scans.cut_rows(df, "t", limit, unordered).where("t IS NOT NULL").collect())
            assert got == [v for v in values if limit > len(values) or v <= values[limit - 1]]
            assert scans.cut_rows(df, "t", limit, unordered).where("t IS NULL").count() == unordered


def test_cut_sorts_no_rows_and_is_pushed_down(spark, tmp_path):
    spark.range(1000).selectExpr("id", "timestamp_micros(id * 1000) AS t").write.parquet(f"{tmp_path}/x")
    plan = scans.cut_rows(spark.read.parquet(f"{tmp_path}/x"), "t", 300)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "Sort" not in plan and "LessThanOrEqual(t" in plan
    wide = spark.createDataFrame([(-(2**63),), (-1,), (0,), (5,), (2**63 - 1,)], "n long")
    assert [scans.cut_rows(wide, "n", k).count() for k in (1, 2, 3, 4, 5)] == [1, 2, 3, 4, 5]


def test_deep_page_of_a_hot_pipeline(spark):
    rows = spark.range(300_000).selectExpr("id", "if(id % 10 > 0, 0, id % 7) AS pipeline_id", "timestamp_micros((id * 7919) % 250000 * 1000000) AS started_at")
    page = runlog.deep_page_per_key(rows, "pipeline_id", "started_at", "id", 100_000, 50)
    want = runlog.runs_page_per_pipeline(rows, 100_000, 50)
    assert sorted(map(tuple, page.collect())) == sorted(map(tuple, want.collect())) and page.count() == 50
    near = spark.sql("SELECT * FROM VALUES (1, 'a', timestamp'2024-01-01'), (2, 'a', NULL), (3, 'a', timestamp'2024-01-02'), (4, NULL, timestamp'2024-01-02') AS v(id, p, t)")
    assert sorted((r.id, r.position) for r in runlog.deep_page_per_key(near, "p", "t", "id", 0, 9).collect()) == [(1, 2), (2, 3), (3, 1), (4, 1)]
    assert runlog.deep_page_per_key(near.limit(0), "p", "t", "id", 0, 9).count() == 0


def test_duplicates_are_found_in_one_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id % 10 AS k", "id % 4 AS v", "nullif(id % 3, 0) AS w").write.parquet(f"{tmp_path}/x")
    rows = dl.row_errors(spark.read.parquet(f"{tmp_path}/x"), ["k", "w"])
    marked = dl.mark_duplicates(rows, ["k"], ["v"])
    marked.collect()
    assert marked._jdf.queryExecution().executedPlan().toString().count("ReusedExchange") >= 1
    found = marked.groupBy("error_type").count().collect()
    assert {r.error_type: r["count"] for r in found} == {None: 10, dl.PK_DUPLICATE: 656, dl.NULL_CONSTRAINT: 334}


def test_stream_accounts_for_rows_without_key(spark, tmp_path):
    folder, schema = f"{tmp_path}/in", "id long, t timestamp"
    batches = [[(1, datetime(2024, 1, 9)), (1, datetime(2024, 1, 8))], [(2, datetime(2024, 1, 1)), (1, AT), (None, AT), (3, None)], [(2, AT)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    target = TargetTable(spark, f"{tmp_path}/out", "t", ["id"], compact_share=float("inf"))
    for _ in range(2):
        stream = streams.file_stream(spark, folder, "*.parquet", spark.read.parquet(folder).schema, files_per_batch=1)
        streams.stream_unique(stream, target, "unique_keys", f"{tmp_path}/check", "t").awaitTermination()
    assert sorted((r.id, r.t) for r in target.read().collect() if r.id < 3) == [(1, datetime(2024, 1, 8)), (2, datetime(2024, 1, 1))]
    facts = [f["counts"] for f in target.facts("counts")]
    assert [(f["rows"], f["loaded"], f["repeats"], f["keyless"], f["late"]) for f in facts] == [(2, 1, 1, 0, 0), (4, 2, 1, 1, 1), (1, 0, 1, 0, 0)]
    assert facts[-1]["all"] == {"rows": 7, "loaded": 3, "repeats": 3, "keyless": 1, "late": 1}
    assert spark.read.parquet(streams.dead_letter_folder(target)).count() == 1


def test_text_lines_that_do_not_parse(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b", c', datetime(2024, 1, 1, 0, 0, 0, 7)), (2, "", None), (3, None, AT)], "id int, s string, t timestamp_ntz")
    for kind, broken in (("csv", "x,y\n4"), ("json", '{"id": "four", "s": 1}\n{"id": 5, ')):
        path = f"{tmp_path}/{kind}"
        scans.export_files(rows, path, kind)
        spark.createDataFrame([(line,) for line in broken.split("\n")], "line string").write.mode("append").text(path)
        sound, lines = scans.split_broken(scans.read_lines(spark, path, kind, rows.schema, **scans.import_options(kind)))
        assert sorted(sound.collect()) == sorted(rows.collect())
        letters = dl.dead_letters(lines, "files", "t", "r", F.lit(AT)).collect()
        assert sorted(json.loads(r.row_data)["line"] for r in letters) == sorted(broken.split("\n"))
        assert sound.select("id").count() == 3 and sound.agg(F.count("*")).first()[0] == 3


def test_schema_versions_per_pipeline(spark):
    seen = [("a", "t", "id", 1), ("a", "t", "id,x", 2), ("b", "t", "id", 3)]
    frame = spark.createDataFrame(seen, "pipeline_id string, table_name string, columns string, seen_at int")
    assert sorted((r.pipeline_id, r.version, r.columns) for r in quality.schema_versions(frame).collect()) == [("a", 1, "id"), ("a", 2, "id,x"), ("b", 1, "id")]
