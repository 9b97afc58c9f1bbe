"""Checks of whole sync cycles, written tables and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from ferrywork.operators import load, merge, runlog
from ferrywork.operators.targets import TargetTable
from ferrywork.operators.transforms import apply_steps
from ferrywork.plans.fixtures import BOOKMARK, table, view, view_columns
from ferrywork.plans.registry import check
from ferrywork.plans.sync import LINES, RUNS, STATS, Pipeline, SyncTable, Workspace, reprocess_letters, run_pipeline
from ferrywork.session import scratch_path
from ferrywork.sources.scans import incremental_rows, live_rows, soft_deleted_rows
from ferrywork.streaming import sync as streams

SLICE = (
    {"type": "filter", "config": {"condition": "o_orderstatus != 'F'"}},
    {"type": "compute", "config": {"expression": "tax = o_totalprice * 0.11"}},
    {"type": "rename", "config": {"mapping": {"o_totalprice": "total"}}},
)
_SLICE_SQL = f"""SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice AS total, updated_at, deleted_at, o_totalprice * 0.11::double AS tax FROM src_orders
    WHERE o_orderstatus <> 'F'"""


@check(
    "sync_slice",
    f"SELECT * FROM ({_SLICE_SQL}) WHERE (updated_at > timestamp '{BOOKMARK}' AND deleted_at IS NULL) OR updated_at <= timestamp '{BOOKMARK}'",
    ("src_orders",),
)
def sync_slice(spark, sf):
    """Rows past the bookmark, transformed and merged into what was there before."""
    source = view(spark, sf, "src_orders")
    before = source.where(F.col("updated_at") <= F.lit(BOOKMARK).cast("timestamp_ntz"))
    changes = apply_steps(incremental_rows(source, "updated_at", BOOKMARK), SLICE)
    return merge.merge_rows(apply_steps(before, SLICE), changes, ["o_orderkey"], merge.newest_first("updated_at"))


@check("full_refresh_load", "SELECT o_orderkey, o_custkey, o_totalprice, updated_at FROM src_orders WHERE deleted_at IS NULL", ("src_orders",))
def full_refresh_load(spark, sf):
    source = view(spark, sf, "src_orders").select("o_orderkey", "o_custkey", "o_totalprice", "updated_at", "deleted_at")
    target = TargetTable(spark, scratch_path(spark, "refresh"), "orders", ["o_orderkey"], "updated_at")
    target.replace(source.where(F.col("updated_at") <= F.lit(BOOKMARK).cast("timestamp_ntz")).drop("deleted_at"), "run-1")
    target.replace(live_rows(source).drop("deleted_at"), "run-2")
    return target.read()


@check(
    "soft_delete_reconcile",
    f"SELECT o_orderkey, updated_at FROM src_orders WHERE deleted_at IS NULL OR NOT deleted_at > timestamp '{BOOKMARK}'",
    ("src_orders",),
)
def soft_delete_reconcile(spark, sf):
    source = view(spark, sf, "src_orders")
    deletes = soft_deleted_rows(source, BOOKMARK, "updated_at")
    return merge.delete_by_key(source.select("o_orderkey", "updated_at"), deletes, ["o_orderkey"])


def orders_as_of(spark, sf, moment: str):
    """The source table as it stood at ``moment``: later changes not yet made."""
    now = F.lit(moment).cast("timestamp_ntz")
    rows = view(spark, sf, "src_orders").where(F.col("updated_at") <= now)
    return rows.withColumn("deleted_at", F.when(F.col("deleted_at") <= now, F.col("deleted_at")))


def run_cycles(spark, sf, moments, load_mode="direct"):
    ws = Workspace(spark, scratch_path(spark, "sync"))
    pipeline = Pipeline(
        "p1", "shop",
        (SyncTable("orders", keys=("o_orderkey",), bookmark_column="updated_at", transforms=SLICE, required=("o_custkey",), load_mode=load_mode),),
    )
    for number, moment in enumerate(moments):
        result = run_pipeline(ws, pipeline, lambda _: orders_as_of(spark, sf, moment), f"run-{number}", datetime(2024, 1, 1 + number))
        if result.outcome != "success":
            raise RuntimeError(result.tables[0].error)
    return ws, pipeline


MOMENTS = ["1997-06-01 00:00:00", "1999-01-01 00:00:00", "2002-01-01 00:00:00"]


@check("sync_cycle", f"SELECT * EXCLUDE (deleted_at) FROM ({_SLICE_SQL}) WHERE deleted_at IS NULL", ("src_orders",))
def sync_cycle(spark, sf):
    """Three cycles over a growing source leave the live rows, once each."""
    ws, pipeline = run_cycles(spark, sf, MOMENTS)
    return ws.target(pipeline.tables[0], "updated_at").read().drop("deleted_at", load.RUN_ID, load.SYNCED_AT)


@check("sync_cycle_raw", f"SELECT * EXCLUDE (deleted_at) FROM ({_SLICE_SQL}) WHERE deleted_at IS NULL", ("src_orders",))
def sync_cycle_raw(spark, sf):
    """The same through the raw landing table."""
    ws, pipeline = run_cycles(spark, sf, MOMENTS, "raw")
    return ws.target(pipeline.tables[0], "updated_at").read().drop("deleted_at", load.RUN_ID, load.SYNCED_AT)


@check(
    "sync_cycle_two_sources",
    f"""SELECT * EXCLUDE (deleted_at), 'a' AS of_pipeline FROM ({_SLICE_SQL}) WHERE updated_at <= timestamp '{MOMENTS[0]}'
        AND (deleted_at IS NULL OR deleted_at > timestamp '{MOMENTS[0]}')
        UNION ALL SELECT * EXCLUDE (deleted_at), 'b' FROM ({_SLICE_SQL}) WHERE deleted_at IS NULL""",
    ("src_orders",),
)
def sync_cycle_two_sources(spark, sf):
    """Two pipelines with a table of one name keep rows and bookmarks apart: the second one loads all of its own."""
    ws = Workspace(spark, scratch_path(spark, "two"))
    out = []
    for number, (name, moment) in enumerate((("b", MOMENTS[1]), ("a", MOMENTS[0]), ("b", MOMENTS[2]))):
        orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="updated_at", transforms=SLICE)
        pipeline = Pipeline(name, "shop", (orders,))
        result = run_pipeline(ws, pipeline, lambda _: orders_as_of(spark, sf, moment), f"run-{number}", datetime(2024, 1, 1 + number))
        if result.outcome != "success":
            raise RuntimeError(result.tables[0].error)
        if number:
            out.append(ws.target(orders, "updated_at", pipeline).read().drop("deleted_at", load.RUN_ID, load.SYNCED_AT).withColumn("of_pipeline", F.lit(name)))
    return out[0].unionByName(out[1])


@check("ensure_schema_ddl", "SELECT o_orderkey, o_orderstatus, NULL::double AS discount FROM orders WHERE o_orderdate > timestamp '2000-01-01'")
def ensure_schema_ddl(spark, sf):
    """A typed table is made, filled, and given one more column."""
    source = table(spark, sf, "orders").where("o_orderdate > '2000-01-01'").select("o_orderkey", "o_orderstatus")
    path = scratch_path(spark, "typed")
    name = load.ensure_table(spark, "ferrywork_check", path.rsplit("/", 1)[1], source.schema, path)
    load.stamp(source, "run-1", F.lit("2024-01-01").cast("timestamp")).write.insertInto(name)
    load.add_columns(spark, name, spark.createDataFrame([], "discount double").schema)
    return spark.table(name).drop(load.RUN_ID, load.SYNCED_AT)


def event_stream(spark, sf):
    return streams.file_stream(spark, sf, "events.parquet", table(spark, sf, "events").schema)


@check("stream_sync_append", "SELECT event_id, user_id, event_type, value, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def stream_sync_append(spark, sf):
    folder = scratch_path(spark, "stream")
    target = TargetTable(spark, folder, "events", ["event_id"])
    steps = [{"type": "filter", "config": {"condition": "event_type != 'error'"}}, {"type": "compute", "config": {"expression": "doubled = value * 2"}}]
    streams.stream_sync(event_stream(spark, sf), target, f"s{abs(hash(folder))}", f"{folder}/_checkpoint", steps).awaitTermination()
    return target.read().select("event_id", "user_id", "event_type", "value", "doubled")


@check(
    "stream_sync_rejects",
    "SELECT event_id, 'TYPE_MISMATCH' AS error_type, event_type, value FROM events WHERE event_type = 'error'",
)
def stream_sync_rejects(spark, sf):
    """Rows of a stream that do not convert become dead letters that hold their text."""
    folder = scratch_path(spark, "rejects")
    target = TargetTable(spark, folder, "events", ["event_id"])
    events = event_stream(spark, sf).select(
        "event_id", "event_type", "value", F.expr("CASE WHEN event_type = 'error' THEN 'x' || event_type ELSE '7' END").alias("code")
    )
    steps = [{"type": "type_cast", "config": {"columns": {"code": "int"}}}]
    streams.stream_sync(events, target, f"r{abs(hash(folder))}", f"{folder}/_checkpoint", steps).awaitTermination()
    letters = spark.read.parquet(streams.dead_letter_folder(target))
    row = F.from_json("row_data", "event_id bigint, event_type string, value double, code string").alias("row")
    return letters.select("error_type", row).where("row.code = 'xerror'").select("row.event_id", "error_type", "row.event_type", "row.value")


@check("stream_dedup", "SELECT event_id, user_id, event_type FROM events")
def stream_dedup(spark, sf):
    folder = scratch_path(spark, "dedup")
    # The same files read twice: every event arrives two times.
    stamped = event_stream(spark, sf).unionByName(event_stream(spark, sf)).withColumn("ts", F.col("ts").cast("timestamp"))
    unique = streams.without_repeats(stamped, ["event_id"], "ts").select("event_id", "user_id", "event_type")
    query = (
        unique.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/_checkpoint")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@check(
    "stream_daily_stats",
    "SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS run_count, coalesce(sum(rows_synced), 0)::bigint AS total_rows FROM runs GROUP BY 1",
    ("runs",),
)
def stream_daily_stats(spark, sf):
    folder = scratch_path(spark, "daily")
    runs = event_stream(spark, sf).selectExpr(*view_columns("runs")).withColumn("started_at", F.col("started_at").cast("timestamp"))
    target = TargetTable(spark, folder, "daily", ["day"])
    streams.stream_sync(
        streams.daily_counts(runs, "started_at"), target, f"d{abs(hash(folder))}", f"{folder}/_checkpoint", output_mode="update"
    ).awaitTermination()
    return target.read().select(F.col("day").cast("string").alias("day"), "run_count", "total_rows")


# -- what a run leaves ----------------------------------------------------------------


@check(
    "quality_row_count_of_load",
    """SELECT 'row_count' AS check_type, count(*) AS rows_extracted, count(DISTINCT l_orderkey) FILTER (good) AS rows_loaded,
        count(*) FILTER (good) - count(DISTINCT l_orderkey) FILTER (good) AS rows_folded, round_even(count(*) FILTER (NOT good) / count(*) * 100, 2) AS discrepancy_pct, TRUE AS passed
        FROM (SELECT l_orderkey, l_returnflag <> 'R' OR l_linenumber <> 3 AS good FROM lineitem)""",
)
def quality_row_count_of_load(spark, sf):
    """Rows that the written files hold against rows sent to them; rows folded into another of their key are a figure of their own."""
    ws = Workspace(spark, scratch_path(spark, "counted"))
    lines = SyncTable("lineitem", keys=("l_orderkey",), bookmark_column="l_shipdate", required=("flag",))
    source = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_shipdate", "CASE WHEN l_returnflag <> 'R' OR l_linenumber <> 3 THEN l_returnflag END AS flag")
    run_one(ws, Pipeline("p1", "shop", (lines,), quality_threshold=20.0), source, 1)
    log = spark.read.json(ws.log_path("quality")).where("check_type = 'row_count'")
    return log.select("check_type", "rows_extracted", "rows_loaded", "rows_folded", "discrepancy_pct", "passed")


def run_one(ws, pipeline, source, number, run_id=None):
    result = run_pipeline(ws, pipeline, lambda _: source, run_id or f"run-{number}", datetime(2024, 1, number))
    if result.outcome != "success":
        raise RuntimeError(result.tables[0].error)
    return result


def plain_orders(spark, sf, moment):
    return table(spark, sf, "orders").where(F.col("o_orderdate") <= F.lit(moment).cast("timestamp_ntz"))


@check(
    "schema_evolve_late",
    f"SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderdate > timestamp '{MOMENTS[0]}' THEN o_orderpriority END AS priority, "
    f"CASE WHEN o_orderdate > timestamp '{MOMENTS[0]}' THEN o_totalprice END AS price FROM orders",
)
def schema_evolve_late(spark, sf):
    """Values of columns that nobody asked for are there once the columns are added."""
    ws = Workspace(spark, scratch_path(spark, "late"))
    extra = [F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price")]
    for number, moment in enumerate(MOMENTS, start=1):
        orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="o_orderdate", auto_evolve=number == 3)
        source = plain_orders(spark, sf, moment).select("o_orderkey", "o_orderstatus", "o_orderdate", *(extra if number > 1 else []))
        run_one(ws, Pipeline("p1", "shop", (orders,)), source, number)
    return ws.target(orders, "o_orderdate").read().select("o_orderkey", "o_orderstatus", "priority", "price")


CODED = "CASE o_orderkey % 10 WHEN 0 THEN 'n/a' WHEN 1 THEN concat('x', o_custkey) ELSE cast(o_custkey AS string) END AS code"


@check(
    "dead_letter_reprocess_load",
    """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE o_custkey END AS code,
        CASE WHEN o_orderkey % 10 = 1 THEN 'value does not convert: code' END AS waiting_for, CASE WHEN o_orderkey % 10 = 1 THEN 'x' || o_custkey END AS value FROM orders""",
)
def dead_letter_reprocess_load(spark, sf):
    """Rejected rows are repaired and merged into the target; letters that fail again keep waiting."""
    ws = Workspace(spark, scratch_path(spark, "letters"))
    cast = {"type": "type_cast", "config": {"columns": {"code": "int"}}}
    orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="o_orderdate", transforms=(cast,), required=("code",))
    pipeline = Pipeline("p1", "shop", (orders,))
    run_one(ws, pipeline, table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", CODED), 1)
    repair = [{"type": "map_values", "config": {"column": "code", "mapping": {"n/a": "0"}}}]
    for _ in range(2):  # repeating the step changes nothing
        reprocess_letters(ws, pipeline, orders, "again-1", datetime(2024, 1, 2), repair)
    done = ws.target(orders, "o_orderdate", pipeline).read().select("o_orderkey", "code", F.lit(None).cast("string").alias("waiting_for"), F.lit(None).cast("string").alias("value"))
    row = F.from_json("row_data", "o_orderkey bigint, code string").alias("row")
    waiting = ws.dead_letters().where("NOT reprocessed").select("error_text", row)
    return done.unionByName(waiting.select("row.o_orderkey", F.lit(None).cast("bigint").alias("code"), F.col("error_text").alias("waiting_for"), F.col("row.code").alias("value")))


@check(
    "sync_runs_of_equal_id",
    f"""SELECT p AS pipeline_id, count(*) FILTER (o_orderkey % 10 > 1 AND d <= m) AS kept, count(*) FILTER (d <= m) AS raw_rows,
        count(*) FILTER (o_orderkey % 10 <= 1 AND d <= m) AS letters, 1::bigint AS runs, 1::bigint AS logged_tables
        FROM (SELECT o_orderkey, o_orderdate AS d FROM orders), (VALUES ('a', timestamp '{MOMENTS[0]}'), ('b', timestamp '{MOMENTS[1]}')) AS v(p, m) GROUP BY p""",
)
def sync_runs_of_equal_id(spark, sf):
    """Two pipelines with one table name, source and run id: rows, raw rows, letters and run logs of both are there."""
    ws = Workspace(spark, scratch_path(spark, "equal"))
    cast = {"type": "type_cast", "config": {"columns": {"code": "int"}}}
    orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="o_orderdate", transforms=(cast,), load_mode="raw")
    out = None
    for name, moment in zip("ab", MOMENTS):
        run_one(ws, Pipeline(name, "shop", (orders,)), plain_orders(spark, sf, moment).selectExpr("o_orderkey", "o_orderdate", CODED), 1, "the-run")
    raw = spark.read.parquet(ws.raw_path("shop", "orders")).withColumn("pipeline_id", F.substring("of_owner", 1, 1))
    counted = {
        "raw_rows": raw, "letters": ws.dead_letters().dropDuplicates(["id"]),
        "runs": ws.read_log("runs", RUNS), "logged_tables": ws.read_log("run_table_stats", STATS),
    }
    for name in "ab":
        kept = ws.target(orders, "o_orderdate", Pipeline(name, "shop", (orders,))).read().agg(F.lit(name).alias("pipeline_id"), F.count("*").alias("kept"))
        out = kept if out is None else out.unionByName(kept)
    for column, rows in counted.items():
        out = out.join(rows.groupBy("pipeline_id").agg(F.count("*").alias(column)), "pipeline_id")
    return out


@check(
    "run_log_of_a_run",
    f"""SELECT * FROM (SELECT 'INFO' AS level, 'run started: 1 tables' AS message
        UNION ALL SELECT 'INFO', 'orders: ' || count(*) || ' extracted, ' || count(*) FILTER (o_orderkey % 10 > 1) || ' loaded, 0 deleted, bookmark ' || strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') FROM orders
        UNION ALL SELECT 'WARNING', 'orders: ' || count(*) FILTER (o_orderkey % 10 <= 1) || ' rows rejected' FROM orders
        UNION ALL SELECT 'WARNING', 'orders: quality check failed')""",
)
def run_log_of_a_run(spark, sf):
    """The lines that a run writes about itself, without the last one, which has its time."""
    ws = Workspace(spark, scratch_path(spark, "lines"))
    cast = {"type": "type_cast", "config": {"columns": {"code": "int"}}}
    orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="o_orderdate", transforms=(cast,))
    run_one(ws, Pipeline("p1", "shop", (orders,)), table(spark, sf, "orders").selectExpr("o_orderkey", "o_orderdate", CODED), 1)
    lines = runlog.log_lines(ws.read_log("run_logs", LINES), "run-1", 0, 100)
    return lines.where("message NOT LIKE 'run ended%'").select("level", "message")


@check(
    "sync_cycle_changes",
    f"""SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 7 = 0 AND o_orderdate <= timestamp '{MOMENTS[0]}' THEN 1 ELSE 0 END AS price,
        o_orderkey % 50 AS code, CASE WHEN o_orderdate > timestamp '{MOMENTS[1]}' THEN o_orderpriority END AS priority FROM orders WHERE o_orderkey % 50 <> 3""",
)
def sync_cycle_changes(spark, sf):
    """Rows are changed, rejected and given a column between the cycles."""
    ws = Workspace(spark, scratch_path(spark, "changes"))
    first, later = (F.lit(m).cast("timestamp_ntz") for m in MOMENTS[:2])
    cast = {"type": "type_cast", "config": {"columns": {"code": "int"}}}
    for number, moment in enumerate(MOMENTS, start=1):
        rows = plain_orders(spark, sf, moment)
        changed = (F.col("o_orderkey") % 7 == 0) & (F.col("o_orderdate") <= first) & F.lit(number > 1)
        source = rows.select(
            "o_orderkey", (F.col("o_totalprice") + F.when(changed, 1).otherwise(0)).alias("price"),
            F.expr("CASE WHEN o_orderkey % 50 = 3 THEN 'bad' ELSE cast(o_orderkey % 50 AS string) END AS code"),
            F.when(changed, first + F.make_dt_interval(F.lit(1), (F.col("o_orderkey") % 1000).cast("int"))).otherwise(F.col("o_orderdate")).alias("updated_at"),
            *([F.when(F.col("o_orderdate") > later, F.col("o_orderpriority")).alias("priority")] if number == 3 else []),
        )
        orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="updated_at", transforms=(cast,), auto_evolve=True)
        run_one(ws, Pipeline("p1", "shop", (orders,)), source, number)
    return ws.target(orders, "updated_at").read().select("o_orderkey", "price", "code", "priority")


@check(
    "sync_bounded_nulls",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS updated_at FROM orders",
)
def sync_bounded_nulls(spark, sf):
    """Bounded batches, the first of which also takes the rows without a change time, leave every row loaded."""
    ws = Workspace(spark, scratch_path(spark, "nulls"))
    source = table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 10 > 0 THEN o_orderdate END AS updated_at")
    size = source.count() // 3 + 1
    orders = SyncTable("orders", keys=("o_orderkey",), bookmark_column="updated_at", max_rows=size)
    for number in range(1, 4):
        run_one(ws, Pipeline("p1", "shop", (orders,)), source, number)
    return ws.target(orders, "updated_at").read().select("o_orderkey", "updated_at")


@check("ensure_schema_whole", "SELECT o_orderkey, o_orderstatus, o_orderdate, NULL::double AS discount FROM orders")
def ensure_schema_whole(spark, sf):
    """A typed table is made, filled with all orders, and given one more column."""
    source = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    path = scratch_path(spark, "whole")
    name = load.ensure_table(spark, "ferrywork_check", path.rsplit("/", 1)[1], source.schema, path)
    load.stamp(source, "run-1", F.lit("2024-01-01").cast("timestamp")).write.insertInto(name)
    load.add_columns(spark, name, spark.createDataFrame([], "discount double").schema)
    return spark.table(name).drop(load.RUN_ID, load.SYNCED_AT)


# -- streams out of order -----------------------------------------------------------------

#: Three files that come one by one: the newest events, the oldest with repeats of the newest, the rest with repeats of all.
_PARTS = (
    "ts >= timestamp '2024-01-20'",
    "ts < timestamp '2024-01-10' OR (ts >= timestamp '2024-01-20' AND event_id % 5 = 0)",
    "(ts >= timestamp '2024-01-10' AND ts < timestamp '2024-01-20') OR event_id % 7 = 0",
)


def out_of_order(spark, sf, columns=("*",)):
    """Folder of three files, in that order, and their schema."""
    folder = scratch_path(spark, "parts")
    for part in _PARTS:
        table(spark, sf, "events").where(part.replace("timestamp '", "timestamp_ntz'")).selectExpr(*columns).coalesce(1).write.mode("append").parquet(folder)
    return spark.read.parquet(folder).schema, folder


def unique_events(spark, sf):
    schema, parts = out_of_order(spark, sf)
    folder = scratch_path(spark, "unique")
    target = TargetTable(spark, folder, "events", ["event_id"], compact_share=float("inf"))
    stream = streams.file_stream(spark, parts, "*.parquet", schema, files_per_batch=1)
    streams.stream_unique(stream, target, f"u{abs(hash(folder))}", f"{folder}/_checkpoint", "ts").awaitTermination()
    return target


@check("stream_dedup_late", "SELECT event_id, user_id, event_type, ts FROM events")
def stream_dedup_late(spark, sf):
    """Every event once, also those that come weeks late."""
    return unique_events(spark, sf).read().select("event_id", "user_id", "event_type", "ts")


@check(
    "stream_dedup_accounts",
    f"""WITH parts AS ({" UNION ALL ".join(f"SELECT {k} AS part, event_id, ts FROM events WHERE {p}" for k, p in enumerate(_PARTS))}),
        tops AS (SELECT part, max(max(ts)) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM parts GROUP BY part),
        firsts AS (SELECT event_id, min(part) AS part FROM parts GROUP BY event_id)
        SELECT p.part::bigint AS part, count(*) AS rows, (SELECT count(*) FROM firsts f WHERE f.part = p.part) AS loaded,
            count(*) - (SELECT count(*) FROM firsts f WHERE f.part = p.part) AS repeats, count(*) FILTER (p.ts < t.newest - INTERVAL 1 DAY) AS late
        FROM parts p JOIN tops t ON t.part = p.part GROUP BY p.part""",
)
def stream_dedup_accounts(spark, sf):
    """Rows, loaded rows, repeats and late rows of each micro-batch."""
    facts = [f["counts"] for f in unique_events(spark, sf).facts("counts")]
    rows = [(k, f["rows"], f["loaded"], f["repeats"], f["late"]) for k, f in enumerate(facts)]
    return spark.createDataFrame(rows, "part long, rows long, loaded long, repeats long, late long")


@check(
    "stream_daily_stats_late",
    "SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS run_count, coalesce(sum(rows_synced), 0)::bigint AS total_rows FROM ("
    + " UNION ALL ".join(f"SELECT r.* FROM runs r JOIN events e ON e.event_id = r.id WHERE {p}" for p in _PARTS)
    + ") GROUP BY 1",
    ("runs",),
)
def stream_daily_stats_late(spark, sf):
    """Runs and rows per day of runs that come out of order."""
    schema, parts = out_of_order(spark, sf, view_columns("runs"))
    folder = scratch_path(spark, "totals")
    target = TargetTable(spark, folder, "totals", [])
    stream = streams.file_stream(spark, parts, "*.parquet", schema, files_per_batch=1)
    streams.stream_daily_totals(stream, target, f"t{abs(hash(folder))}", f"{folder}/_checkpoint", "started_at").awaitTermination()
    return streams.daily_totals(target).withColumn("day", F.col("day").cast("string"))
