"""Whole pipeline runs: isolation, bookmarks, deletes, dead letters, drift, repeats."""

from datetime import datetime, timedelta

import pytest
from ferrywork.operators import state
from ferrywork.plans import sync
from ferrywork.plans.sync import Pipeline, SyncTable, Workspace, run_pipeline

T0 = datetime(2024, 1, 1)
SCHEMA = "id int, name string, updated_at timestamp, deleted_at timestamp"


def day(n):
    return datetime(2023, 12, 1) + timedelta(days=n)


@pytest.fixture()
def ws(spark, tmp_path):
    return Workspace(spark, str(tmp_path / "ws"))


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def run(ws, tables, frames, n, **kwargs):
    pipeline = kwargs.pop("pipeline", Pipeline("p1", "Shop-DB", tuple(tables)))
    return run_pipeline(ws, pipeline, lambda t: frames[t], f"run-{n}", T0 + timedelta(hours=n), **kwargs)


def current(ws, table, columns=("id", "name")):
    return sorted([tuple(r) for r in ws.target(table).read().select(*columns).collect()], key=repr)


USERS = SyncTable("users", keys=("id",), bookmark_column="updated_at", required=("id",))


def test_single_table(ws, spark):
    result = run(ws, [USERS], {"users": frame(spark, [(1, "test")], "id int, name string")}, 1)
    assert (result.status, result.outcome, result.rows_synced) == ("success", "success", 1)
    # The bookmark column is absent from the rows, so there is no bookmark.
    assert ws.bookmarks.get("p1", "users") is None
    row = ws.target(USERS).read().first()
    assert row["_run_id"] == "run-1" and row["_synced_at"] == T0 + timedelta(hours=1)


def test_empty_extract_loads_nothing(ws, spark):
    result = run(ws, [USERS], {"users": frame(spark, [])}, 1)
    assert result.status == "success" and result.rows_synced == 0
    assert ws.target(USERS).commit_of("run-1") is None


def test_failing_table_does_not_stop_the_others(ws, spark):
    orders = SyncTable("orders", keys=("id",))
    result = run(ws, [USERS, orders], {"orders": frame(spark, [(3, "charlie", day(1), None)])}, 1)
    by_name = {t.table: t for t in result.tables}
    assert result.status == "success" and result.outcome == "partial"
    assert by_name["users"].status == "failed" and by_name["users"].rows_loaded == 0
    assert by_name["orders"].status == "success" and result.rows_synced == 1
    logged = {r["table_name"]: r["status"] for r in ws.read_log("run_table_stats", sync.STATS).collect()}
    assert logged == {"users": "failed", "orders": "success"}


def test_two_tables_are_summed(ws, spark):
    frames = {"users": frame(spark, [(1, "alice", day(1), None), (2, "bob", day(2), None)]), "orders": frame(spark, [(3, "charlie", day(1), None)])}
    result = run(ws, [USERS, SyncTable("orders", keys=("id",))], frames, 1)
    assert result.rows_synced == 3
    assert ws.read_log("runs", sync.RUNS).first()["rows_synced"] == 3


def test_updates_and_soft_deletes_across_runs(ws, spark):
    first = [(1, "a", day(1), None), (2, "b", day(2), None), (3, "c", day(3), None)]
    run(ws, [USERS], {"users": frame(spark, first)}, 1)
    assert ws.bookmarks.get("p1", "users") == "2023-12-04 00:00:00"
    second = [(1, "a2", day(5), None), (2, "b", day(2), day(6)), (3, "c", day(6), day(6)), (4, "d", day(4), None)]
    result = run(ws, [USERS], {"users": frame(spark, second)}, 2)
    # Both deleted rows go, also the one whose change time moved with the delete.
    assert result.tables[0].rows_deleted == 2 and current(ws, USERS) == [(1, "a2"), (4, "d")]
    assert ws.bookmarks.get("p1", "users") == "2023-12-06 00:00:00"
    third = run(ws, [USERS], {"users": frame(spark, second)}, 3)
    assert third.rows_synced == 0 and current(ws, USERS) == [(1, "a2"), (4, "d")]


def test_deletes_alone_are_committed(ws, spark):
    run(ws, [USERS], {"users": frame(spark, [(1, "a", day(1), None), (2, "b", day(2), None)])}, 1)
    result = run(ws, [USERS], {"users": frame(spark, [(1, "a", day(1), day(4)), (2, "b", day(2), None)])}, 2)
    assert (result.rows_synced, result.tables[0].rows_deleted) == (0, 1)
    assert current(ws, USERS) == [(2, "b")]


def test_keys_renamed_by_the_transforms(ws, spark):
    table = SyncTable(
        "users", keys=("user_id",), source_keys=("id",), bookmark_column="updated_at",
        transforms=({"type": "rename", "config": {"mapping": {"id": "user_id"}}},),
    )
    run(ws, [table], {"users": frame(spark, [(1, "a", day(1), None), (2, "b", day(2), None)])}, 1)
    run(ws, [table], {"users": frame(spark, [(1, "a", day(3), day(3)), (2, "b", day(2), None)])}, 2)
    assert current(ws, table, ("user_id", "name")) == [(2, "b")]


@pytest.mark.parametrize("mode", ["direct", "raw"])
def test_bad_rows_become_dead_letters(ws, spark, mode):
    table = SyncTable("users", keys=("id",), load_mode=mode, transforms=({"type": "type_cast", "config": {"columns": {"name": "int"}}},))
    rows = [(1, "10", day(1), None), (2, "ten", day(2), None), (None, "30", day(3), None)]
    result = run(ws, [table], {"users": frame(spark, rows)}, 1)
    t = result.tables[0]
    assert (t.rows_extracted, t.rows_loaded, t.rows_failed, t.rows_raw) == (3, 1, 2, 3 if mode == "raw" else 0)
    assert current(ws, table) == [(1, 10)]
    letters = {r["error_type"]: r for r in ws.dead_letters().collect()}
    assert set(letters) == {"TYPE_MISMATCH", "NULL_CONSTRAINT"}
    assert letters["TYPE_MISMATCH"]["source_name"] == "shop_db" and '"id":2' in letters["TYPE_MISMATCH"]["row_data"]
    assert not t.quality_passed
    checks = {r["check_type"]: r for r in spark.read.json(ws.log_path("quality")).collect()}
    assert checks["row_count"]["status"] == "failed" and checks["row_count"]["discrepancy_pct"] == 66.67
    assert checks["null_check"]["status"] == "passed"


def test_new_source_columns(ws, spark):
    evolving = SyncTable("users", keys=("id",), bookmark_column="updated_at", auto_evolve=True)
    wider = SCHEMA + ", email string"
    for table, expect in ((USERS, False), (evolving, True)):
        here = Workspace(spark, f"{ws.root}-{expect}")
        run(here, [table], {"users": frame(spark, [(1, "a", day(1), None)])}, 1)
        result = run(here, [table], {"users": frame(spark, [(2, "b", day(2), None, "b@x")], wider)}, 2)
        assert result.tables[0].new_columns == ["email"]
        assert ("email" in here.target(table).read().columns) is expect


def test_full_refresh_replaces_and_sets_the_bookmark(ws, spark):
    table = SyncTable("users", keys=("id",), sync_mode="full_refresh", bookmark_column="updated_at")
    run(ws, [table], {"users": frame(spark, [(1, "a", day(1), None), (2, "b", day(2), None)])}, 1)
    run(ws, [table], {"users": frame(spark, [(2, "b2", day(3), None), (9, "x", day(1), day(2))])}, 2)
    assert current(ws, table) == [(2, "b2")] and ws.bookmarks.get("p1", "users") == "2023-12-04 00:00:00"


def test_repeated_run_writes_nothing_again(ws, spark):
    frames = {"users": frame(spark, [(1, "a", day(1), None)])}
    plain = SyncTable("users", bookmark_column="updated_at")
    run(ws, [plain], frames, 1)
    again = run(ws, [plain], frames, 1)
    assert again.tables[0].rows_loaded == 1 and ws.target(plain).read().count() == 1


def test_crash_between_commit_and_bookmark(ws, spark, monkeypatch):
    frames = {"users": frame(spark, [(1, "a", day(1), None)])}
    plain = SyncTable("users", bookmark_column="updated_at")

    def die(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(state.BookmarkStore, "put", die)
        assert run(ws, [plain], frames, 1).outcome == "failed"
    assert ws.bookmarks.get("p1", "users") is None
    # The next run finds the committed bookmark in the target and goes on from it.
    assert run(ws, [plain], frames, 2).rows_synced == 0
    assert ws.target(plain).read().count() == 1 and ws.bookmarks.get("p1", "users") == "2023-12-02 00:00:00"


def test_limited_runs_lose_no_ties(ws, spark):
    table = SyncTable("users", keys=("id",), bookmark_column="updated_at", max_rows=2)
    rows = [(i, f"n{i}", day(i // 3), None) for i in range(10)]
    for n in range(1, 6):
        run(ws, [table], {"users": frame(spark, rows)}, n)
    assert [i for i, _ in current(ws, table)] == list(range(10))


def test_reset_and_backfill(ws, spark):
    rows = [(i, f"n{i}", day(i), None) for i in range(6)]
    run(ws, [USERS], {"users": frame(spark, rows)}, 1)
    ws.bookmarks.backfill("p1", "users", "updated_at", "2023-12-03 00:00:00", "manual", T0 + timedelta(hours=2))
    assert run(ws, [USERS], {"users": frame(spark, rows)}, 3).rows_synced == 3
    ws.bookmarks.reset("p1", "users", "manual-2", T0 + timedelta(hours=4))
    assert state.list_bookmarks(ws.bookmarks.log()).count() == 0
    assert run(ws, [USERS], {"users": frame(spark, rows)}, 5).rows_synced == 6
    listed = state.list_bookmarks(ws.bookmarks.log()).collect()
    assert [(r["source_table"], r["bookmark_value"]) for r in listed] == [("users", "2023-12-06 00:00:00")]


def test_dependency_gate_in_a_run(ws, spark):
    frames = {"users": frame(spark, [(1, "a", day(1), None)])}
    later = Pipeline("p2", "shop", (USERS,), depends_on="p1")
    skipped = run(ws, [], frames, 1, pipeline=later)
    assert skipped.status == "skipped" and "never succeeded" in skipped.reason
    run(ws, [USERS], frames, 2)
    assert run(ws, [], frames, 3, pipeline=later).status == "success"
    assert run(ws, [], frames, 4, pipeline=later).status == "skipped"


def test_a_run_whose_tables_all_failed_does_not_open_the_gate(ws, spark):
    assert run(ws, [USERS], {}, 1).outcome == "failed"
    assert ws.read_log("runs", sync.RUNS).first()["status"] == "failed"
    later = Pipeline("p2", "shop", (USERS,), depends_on="p1")
    assert run(ws, [], {}, 2, pipeline=later).status == "skipped"


def test_raw_run_that_died_is_replaced(ws, spark, monkeypatch):
    table = SyncTable("users", bookmark_column="updated_at", load_mode="raw")
    frames = {"users": frame(spark, [(1, "a", day(1), None)])}
    with monkeypatch.context() as patch:
        patch.setattr(sync.TargetTable, "append", lambda *a, **k: 1 / 0)
        assert run(ws, [table], frames, 1).outcome == "failed"
    assert run(ws, [table], frames, 1).outcome == "success"
    assert ws.target(table).read().count() == 1
    assert spark.read.parquet(ws.raw_path("Shop-DB", "users")).count() == 1


def test_duplicates_can_be_rejected(ws, spark):
    rows = [(1, "first", day(1), None), (1, "second", day(2), None), (1, "second", day(2), None), (2, "b", day(1), None)]
    kept = SyncTable("users", keys=("id",), bookmark_column="updated_at", reject_duplicates=True)
    result = run(ws, [kept], {"users": frame(spark, rows)}, 1).tables[0]
    assert (result.rows_extracted, result.rows_loaded, result.rows_failed) == (4, 2, 2)
    assert current(ws, kept) == [(1, "first"), (2, "b")]
    assert {r["error_type"] for r in ws.dead_letters().collect()} == {"PK_DUPLICATE"}
    merged = Workspace(spark, ws.root + "-merged")
    run(merged, [USERS], {"users": frame(spark, rows)}, 1)
    assert current(merged, USERS) == [(1, "second"), (2, "b")]


def test_old_run_logs_are_pruned(ws, spark):
    for n in (1, 2, 3000):
        run(ws, [USERS], {"users": frame(spark, [(1, "a", day(1), None)])}, n)
    assert ws.prune_logs(T0 + timedelta(hours=3000)) == 2
    assert [r["id"] for r in ws.read_log("runs", sync.RUNS).collect()] == ["run-3000"]
    assert ws.read_log("run_table_stats", sync.STATS).count() == 1


def test_settings_from_discovery(ws, spark):
    from ferrywork.sources import catalog

    frames = {
        "users": frame(spark, [(1, "a", day(1), None), (2, "b", day(2), day(3))]),
        "countries": frame(spark, [(7, "x")], "id int, name string"),
        "tmp_x": frame(spark, [(1,)], "id int"),
    }
    tables = sync.tables_from(catalog.discover(frames), {"users": ("id",), "countries": ("id",)}, "-tmp*")
    assert [(t.source_table, t.sync_mode, t.bookmark_column) for t in tables] == [
        ("countries", "full_refresh", None), ("users", "incremental", "updated_at"),
    ]
    assert run(ws, tables, frames, 1).rows_synced == 2


def test_rows_with_maps_are_merged(ws, spark):
    rows = spark.sql("SELECT 1 AS id, map('a', 1) AS m UNION ALL SELECT 1, map('b', 2)")
    assert run(ws, [SyncTable("t", keys=("id",))], {"t": rows}, 1).outcome == "success"
    assert ws.target(SyncTable("t", keys=("id",))).read().count() == 1


def test_disabled_tables_are_left_out(ws, spark):
    assert run(ws, [SyncTable("users", enabled=False)], {}, 1).tables == []


def test_script_step_in_a_run(ws, spark):
    table = SyncTable("users", keys=("id",), transforms=({"type": "script", "config": {"script_name": "s"}},))

    def shout(row):
        return {**row, "name": row["name"].upper()} if row["id"] > 1 else None

    run(ws, [table], {"users": frame(spark, [(1, "a", day(1), None), (2, "b", day(2), None)])}, 1, scripts={"s": shout})
    assert current(ws, table) == [(2, "B")]


def test_counts_come_from_the_write_itself(ws, spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    def no_count(self):
        raise AssertionError("count() reads the source a second time")

    monkeypatch.setattr(DataFrame, "count", no_count)
    assert run(ws, [USERS], {"users": frame(spark, [(1, "a", day(1), None)])}, 1).outcome == "success"


def test_alerts_and_run_log_questions(ws, spark):
    from ferrywork.operators import runlog

    rows = [(1, "a", day(1), None), (None, "b", day(2), None)]
    run(ws, [USERS, SyncTable("gone", keys=("id",))], {"users": frame(spark, rows)}, 1)
    events = sorted((r["table_name"], r["event_type"]) for r in sync.run_alerts(ws, "run-1").collect())
    assert events == [("gone", "failure"), ("users", "dead_letter"), ("users", "quality_breach"), ("users", "success")]
    runs = ws.read_log("runs", sync.RUNS)
    assert runlog.pipeline_stats(runs).first()["total_rows"] == 1
    assert runlog.recent_runs(runs).first()["rows_synced"] == 1
    assert runlog.run_summary(ws.read_log("run_table_stats", sync.STATS)).first()["status"] == "partial"
    assert runlog.daily_run_stats(runs, "2024-01-02 00:00:00").first()["run_count"] == 1
