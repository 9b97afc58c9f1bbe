"""Questions about runs: history, statistics, freshness, dependencies.

Frames: ``runs(id, pipeline_id, status, started_at, finished_at, duration_ms,
rows_synced, trigger_type, error_message)``, ``stats`` (one row per run and
table), ``pipelines`` and ``tables``. Runs are the large side everywhere; they
are aggregated map-side before they meet the pipelines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywork.functions.pytext import round_half_even
from ferrywork.operators.merge import latest_per_key, newest_first

SUCCESS, FAILED, RUNNING = "success", "failed", "running"


def _since(as_of, column: str, **interval) -> Column:
    """``column`` lies within the interval before ``as_of``; the bound stays a literal."""
    span = F.make_dt_interval(F.lit(interval.get("days", 0)), F.lit(interval.get("hours", 0)))
    return F.col(column) >= (F.lit(as_of).cast("timestamp_ntz") - span)


def _sum(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _status(value: str) -> Column:
    return F.col("status") == value


# -- listings -----------------------------------------------------------------


def recent_runs(runs: DataFrame, limit: int = 10) -> DataFrame:
    return (
        runs.select(
            "id", "pipeline_id", "status", F.coalesce("rows_synced", F.lit(0)).alias("rows_synced"), "duration_ms", "started_at"
        )
        .orderBy(F.desc("started_at"), F.desc("id"))
        .limit(limit)
    )


def filter_runs(runs: DataFrame, status: str | None = None, pipeline_id=None) -> DataFrame:
    if status is not None:
        runs = runs.where(_status(status))
    return runs if pipeline_id is None else runs.where(F.col("pipeline_id") == pipeline_id)


def runs_page(runs: DataFrame, offset: int, limit: int, status: str | None = None, pipeline_id=None) -> DataFrame:
    """One page of the filtered runs, newest first, with the total before paging."""
    wanted = filter_runs(runs, status, pipeline_id)
    total = wanted.agg(F.count("*")).scalar()
    page = wanted.orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(limit)
    return page.withColumn("total", total)


def runs_with_pipeline_name(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    names = pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"))
    joined = runs.join(names, "pipeline_id", "left")
    return joined.withColumn("pipeline_name", F.coalesce("pipeline_name", F.lit("")))


def runs_by_asset(runs: DataFrame, stats: DataFrame, table_name: str | None = None, pipeline_id=None) -> DataFrame:
    """Runs with the figures of one table; a zero or missing figure falls back to the run's."""
    stats = stats if table_name is None else stats.where(F.col("table_name") == table_name)
    runs = runs if pipeline_id is None else runs.where(F.col("pipeline_id") == pipeline_id)
    key = ["id", "pipeline_id"] if "pipeline_id" in stats.columns else ["id"]
    s = stats.withColumnRenamed("run_id", "id").select(
        *key,
        "table_name",
        (F.coalesce("rows_loaded_analytics", F.lit(0)) + F.coalesce("rows_loaded_raw", F.lit(0))).alias("rows_synced"),
        F.col("duration_ms").alias("_duration"),
        F.nullif("error_message", F.lit("")).alias("_error"),
    )
    r = runs.select("id", "pipeline_id", "status", "started_at", "trigger_type", "duration_ms", "error_message")
    return r.join(s, key).select(
        "id", "pipeline_id", "table_name", "status", "started_at", "trigger_type", "rows_synced",
        F.coalesce(F.nullif("_duration", F.lit(0)), F.col("duration_ms")).alias("duration_ms"),
        F.coalesce("_error", "error_message").alias("error_message"),
    )


def runs_page_per_pipeline(runs: DataFrame, offset: int, limit: int) -> DataFrame:
    """Every pipeline's page of runs, newest first; cut map-side to the rows needed."""
    newest = Window.partitionBy("pipeline_id").orderBy(F.desc("started_at"), F.desc("id"))
    ranked = runs.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= offset + limit)
    return ranked.where(F.col("position") > offset).withColumn("position", F.col("position").cast("bigint"))


def deep_page_per_key(rows: DataFrame, key: str, moment: str, tie_break: str, offset: int, limit: int, ranges: int = 4096) -> DataFrame:
    """Every key's page of rows, newest first, with its ``position``, for pages far from the newest row and keys with very many rows.

    Rows are counted per key and range of time, which is combined map-side; running sums of the counts tell at which position a range begins.
    Only the ranges that the page lies in are joined back and sorted.  Rows without a time come last.
    """
    micros = F.unix_micros(F.col(moment).cast("timestamp"))
    low, high = rows.agg(F.min(micros), F.max(micros)).first()
    width = ((high or 0) - (low or 0)) // ranges + 1
    placed = rows.withColumn("_range", F.coalesce(F.floor((micros - F.lit(low or 0)) / width), F.lit(-1)))
    counted = placed.groupBy(key, "_range").agg(F.count("*").alias("_rows"))
    newer = Window.partitionBy(key).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    begun = counted.withColumn("_before", F.coalesce(F.sum("_rows").over(newer), F.lit(0)))
    wanted = begun.where((F.col("_before") < offset + limit) & (F.col("_before") + F.col("_rows") > offset)).withColumnRenamed(key, "_key")
    same = F.col(key).eqNullSafe(F.col("_key")) & (placed["_range"] == wanted["_range"])
    own = placed.join(wanted, same).drop(wanted["_range"])
    newest = Window.partitionBy(key, "_range").orderBy(F.desc_nulls_last(moment), F.desc(tie_break))
    ranked = own.withColumn("position", (F.col("_before") + F.row_number().over(newest)).cast("bigint"))
    return ranked.where((F.col("position") > offset) & (F.col("position") <= offset + limit)).select(*rows.columns, "position")


def log_lines(lines: DataFrame, run_id, offset: int, limit: int) -> DataFrame:
    return lines.where(F.col("run_id") == run_id).orderBy("id").offset(offset).limit(limit)


def sorted_listing(df: DataFrame, column: str, descending: bool = False, *tie_break: str) -> DataFrame:
    """Numbers by value, anything else by its text without regard to case."""
    numeric = df.schema[column].dataType.typeName() in ("long", "integer", "short", "byte", "double", "float", "decimal")
    keys = [F.col(column)] if numeric else [F.lower(F.col(column).cast("string")), F.col(column).cast("string")]
    ordered = [k.desc_nulls_last() if descending else k.asc_nulls_last() for k in keys]
    return df.orderBy(*ordered, *tie_break)


# -- latest per pipeline --------------------------------------------------------


def last_run_per_pipeline(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs, ["pipeline_id"], newest_first("started_at", "id"))


def last_success_per_pipeline(runs: DataFrame) -> DataFrame:
    return latest_per_key(runs.where(_status(SUCCESS)), ["pipeline_id"], newest_first("finished_at", "id"))


def dependency_gate(pipelines: DataFrame, runs: DataFrame, exclude_run_id=None) -> DataFrame:
    """May a pipeline run: its upstream must have succeeded after its own last run.

    ``exclude_run_id`` leaves out the run being started. Both joins use both
    times of the same aggregation, so the runs are scanned and shuffled once.
    """
    if exclude_run_id is not None:
        runs = runs.where(F.col("id") != exclude_run_id)
    times = runs.groupBy("pipeline_id").agg(
        F.max(F.when(_status(SUCCESS), F.col("finished_at"))).alias("success_at"), F.max("started_at").alias("ran_at")
    )
    own = times.select(
        F.col("pipeline_id").alias("id"), F.col("ran_at").alias("last_own_run_at"), F.col("success_at").alias("last_own_success_at")
    )
    upstream = times.select(
        F.col("pipeline_id").alias("depends_on"), F.col("success_at").alias("upstream_success_at"), F.col("ran_at").alias("upstream_run_at")
    )
    names = pipelines.select(F.col("id").alias("depends_on"), F.col("name").alias("_upstream_name"))
    gated = pipelines.select("id", "name", "depends_on").join(own, "id", "left").join(upstream, "depends_on", "left").join(names, "depends_on", "left")
    upstream_name = F.coalesce("_upstream_name", F.col("depends_on").cast("string"))
    free = F.col("depends_on").isNull()
    never = F.col("upstream_success_at").isNull()
    fresh = F.col("last_own_run_at").isNull() | (F.col("upstream_success_at") > F.col("last_own_run_at"))
    reason = F.when(~free & never, F.concat(F.lit("upstream '"), upstream_name, F.lit("' has never succeeded"))).when(
        ~free & ~fresh, F.concat(F.lit("upstream '"), upstream_name, F.lit("' has not succeeded since this pipeline last ran"))
    )
    return gated.select(
        "id", "depends_on", "upstream_success_at", "upstream_run_at", "last_own_run_at", "last_own_success_at",
        F.coalesce(free | (~never & fresh), F.lit(False)).alias("satisfied"),
        reason.alias("reason"),
    )


# -- aggregates -----------------------------------------------------------------


def dashboard_summary(runs: DataFrame, pipelines: DataFrame, tables: DataFrame, sources: DataFrame, destinations: DataFrame, as_of) -> DataFrame:
    """All overview figures in one row: one aggregation per frame."""
    day, week, hour = (_since(as_of, "started_at", **span) for span in ({"days": 1}, {"days": 7}, {"hours": 1}))
    won = _status(SUCCESS)
    run_part = runs.agg(
        F.count_if(day).alias("total_runs_24h"),
        F.count_if(day & _status(FAILED)).alias("failed_runs_24h"),
        _sum(F.when(day, F.col("rows_synced"))).alias("rows_synced_24h"),
        _sum(F.when(won, F.col("rows_synced"))).alias("total_rows_synced"),
        F.count_if(week).alias("_week"),
        F.count_if(week & won).alias("_week_won"),
        F.avg(F.when(week & won, F.col("duration_ms"))).alias("_latency"),
        F.count_distinct(F.when(hour & _status(FAILED), F.col("pipeline_id"))).alias("degraded_pipelines"),
    )
    active = F.count_if(_status("active"))
    one_row = run_part
    for part in (
        pipelines.agg(
            F.struct(F.count("*").alias("total_pipelines"), active.alias("active_pipelines"), active.alias("running_pipelines"))
        ),
        sources.agg(
            F.struct(
                F.count("*").alias("total_sources"),
                F.count_if(_status("connected")).alias("active_sources"),
                F.count_if(_since(as_of, "created_at", days=7)).alias("new_sources_week"),
            )
        ),
        tables.agg(F.struct(F.count_if("enabled").alias("total_tables_synced"))),
        destinations.agg(F.struct(F.count("*").alias("total_destinations"))),
    ):
        one_row = one_row.withColumn("_part", part.scalar()).select("*", "_part.*").drop("_part")
    uptime = F.when(F.col("_week") > 0, round_half_even(F.col("_week_won") / F.col("_week") * 100, 1)).otherwise(100.0)
    latency = F.coalesce(F.col("_latency").cast("bigint"), F.lit(0).cast("bigint"))
    return one_row.withColumns({"uptime_pct_7d": uptime, "avg_latency_ms": latency}).drop("_week", "_week_won", "_latency")


def degraded_pipelines(runs: DataFrame, as_of, hours: int = 1) -> DataFrame:
    failed = runs.where(_status(FAILED) & _since(as_of, "started_at", hours=hours))
    return failed.agg(F.count_distinct("pipeline_id").alias("degraded_pipelines"))


def pipeline_stats(runs: DataFrame) -> DataFrame:
    return runs.groupBy("pipeline_id").agg(
        _sum(F.col("rows_synced")).alias("total_rows"),
        F.count("*").alias("total_runs"),
        F.count_if(_status(SUCCESS)).alias("success_runs"),
        F.count_if(_status(FAILED)).alias("failed_runs"),
    )


def daily_run_stats(runs: DataFrame, as_of, days: int = 7) -> DataFrame:
    recent = runs.where(_since(as_of, "started_at", days=days))
    return (
        recent.groupBy(F.to_date("started_at").alias("day"))
        .agg(F.count("*").alias("run_count"), _sum(F.col("rows_synced")).alias("total_rows"))
        .orderBy("day")
    )


def busiest_day(daily: DataFrame) -> DataFrame:
    """The day with most rows, the earliest on a tie, and the chart scale of at least 1."""
    best = F.max_by(F.struct("day", "total_rows"), F.struct("total_rows", F.negate(F.unix_date("day"))))
    return daily.agg(best.alias("b"), F.greatest(F.lit(1), F.max("total_rows")).alias("scale_max")).select("b.*", "scale_max")


def pipeline_status_counts(pipelines: DataFrame, tables: DataFrame) -> DataFrame:
    failing = _status("error") | _status(FAILED)
    counted = pipelines.agg(
        F.count_if(_status("active")).alias("active_count"),
        F.count_if(_status("paused")).alias("paused_count"),
        F.count_if(failing).alias("error_count"),
    )
    from_tables = tables.agg(
        F.struct(F.count("*").alias("total_tables"), F.count_distinct("source_schema").alias("schema_count"))
    )
    return counted.withColumn("_part", from_tables.scalar()).select("*", "_part.*").drop("_part")


def pipeline_health(pipelines: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    errors = (
        runs.where(_status(FAILED) & _since(as_of, "started_at", days=7)).groupBy("pipeline_id").agg(F.count("*").alias("error_count_7d"))
    )
    joined = pipelines.select(F.col("id").alias("pipeline_id"), "status").join(errors, "pipeline_id", "left")
    failures = F.coalesce("error_count_7d", F.lit(0))
    label = (
        F.when(_status("active"), F.when(failures > 0, "Degraded").otherwise("Running"))
        .when(_status("paused"), "Paused")
        .otherwise("Inactive")
    )
    return joined.select("pipeline_id", failures.cast("bigint").alias("error_count_7d"), label.alias("health"))


def pipeline_throughput(runs: DataFrame, as_of) -> DataFrame:
    """Rows per hour over the last day, halves rounded up."""
    rows = _sum(F.when(_since(as_of, "started_at", days=1), F.col("rows_synced")))
    return runs.groupBy("pipeline_id").agg(rows.alias("rows_24h")).select(
        "pipeline_id", "rows_24h", F.floor(F.col("rows_24h") / 24 + 0.5).cast("bigint").alias("rows_per_hour")
    )


def tables_per_pipeline(tables: DataFrame) -> DataFrame:
    """Each pipeline's table names in order, comma-joined, once each."""
    names = tables.select("pipeline_id", "source_table").distinct().groupBy("pipeline_id")
    listed = F.array_sort(F.collect_list("source_table"))
    return names.agg(F.array_join(listed, ",").alias("tables"), F.count("*").alias("table_count"))


def entity_counts(frames: dict[str, DataFrame], by_status: dict[str, list[str]] | None = None) -> DataFrame:
    """One ``(entity, n)`` row per frame, and one per asked status from the same pass."""
    out = None
    for name, df in frames.items():
        statuses = (by_status or {}).get(name, [])
        wide = df.agg(F.count("*").alias(name), *[F.count_if(_status(s)).alias(f"{name}:{s}") for s in statuses])
        part = wide.unpivot([], wide.columns, "entity", "n")
        out = part if out is None else out.unionByName(part)
    return out


def pipeline_overview(pipelines: DataFrame, sources: DataFrame, destinations: DataFrame, tables: DataFrame, runs: DataFrame, as_of) -> DataFrame:
    """Pipelines with source, destination, tables, last run and recent figures, in one job."""
    week = _since(as_of, "started_at", days=7)
    latest = F.max_by(F.struct("started_at", "status"), F.struct("started_at", "id"))
    from_runs = runs.groupBy("pipeline_id").agg(
        latest.alias("_last"),
        _sum(F.col("rows_synced")).alias("total_rows"),
        F.count_if(week & _status(FAILED)).alias("error_count_7d"),
        F.floor(F.avg(F.when(week & _status(SUCCESS), F.col("duration_ms")))).cast("bigint").alias("avg_latency_ms"),
    )
    from_tables = tables.groupBy("pipeline_id").agg(
        F.count("*").alias("table_count"), F.count_if("enabled").alias("enabled_table_count")
    )
    p = pipelines.select(F.col("id").alias("pipeline_id"), "name", "status", "source_id", "destination_id")
    src = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source_name"))
    dst = destinations.select(F.col("id").alias("destination_id"), F.col("name").alias("destination_name"))
    zero = F.lit(0).cast("bigint")
    return (
        p.join(src, "source_id", "left").join(dst, "destination_id", "left")
        .join(from_tables, "pipeline_id", "left").join(from_runs, "pipeline_id", "left")
        .select(
            "pipeline_id", "name", "status", "source_name", "destination_name",
            F.coalesce("table_count", zero).alias("table_count"),
            F.coalesce("enabled_table_count", zero).alias("enabled_table_count"),
            F.coalesce("total_rows", zero).alias("total_rows"),
            F.coalesce("error_count_7d", zero).alias("error_count_7d"),
            "avg_latency_ms",
            F.col("_last.started_at").alias("last_run_at"),
            F.coalesce("_last.status", F.lit("not_started")).alias("last_run_status"),
        )
    )


def bookmark_overview(pipelines: DataFrame, tables: DataFrame, bookmarks: DataFrame) -> DataFrame:
    """Stored bookmark of every table that has a bookmark column."""
    tracked = tables.where(F.col("bookmark_column").isNotNull()).select("pipeline_id", "source_table", "bookmark_column")
    names = pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"))
    values = bookmarks.select("pipeline_id", "source_table", "bookmark_value")
    return tracked.join(names, "pipeline_id").join(values, ["pipeline_id", "source_table"], "left").orderBy("pipeline_id", "source_table")


def expand_tables(pipelines: DataFrame, table_names: list[str]) -> DataFrame:
    """One row per pipeline and listed table; the fixed list is exploded, not joined."""
    listed = F.array(*[F.lit(t) for t in table_names])
    return pipelines.select(F.col("id").alias("pipeline_id"), F.col("name").alias("pipeline_name"), F.explode(listed).alias("source_table"))


def freshness_status(pipelines: DataFrame, runs: DataFrame, as_of, interval_minutes: Column) -> DataFrame:
    """Stale where the last success is older than the pipeline's own interval."""
    success = runs.where(_status(SUCCESS)).groupBy("pipeline_id").agg(F.max("finished_at").alias("last_success_at"))
    joined = pipelines.withColumn("interval_minutes", interval_minutes).withColumnRenamed("id", "pipeline_id").join(success, "pipeline_id", "left")
    now = F.lit(as_of).cast("timestamp_ntz")
    limit = now - F.make_dt_interval(F.lit(0), F.lit(0), F.col("interval_minutes").cast("int"))
    state = F.when(F.col("last_success_at").isNull(), "never").when(F.col("last_success_at") < limit, "stale").otherwise("fresh")
    return joined.select("pipeline_id", "interval_minutes", "last_success_at", state.alias("freshness"))


def run_summary(stats: DataFrame) -> DataFrame:
    """Per run, of each pipeline where the figures name it: tables, rows, failures, time and overall status."""
    failed = F.count_if(F.col("error_message").isNotNull())
    return stats.groupBy(*[c for c in ("run_id", "pipeline_id") if c in stats.columns]).agg(
        F.count("*").alias("table_count"),
        failed.alias("failed_tables"),
        _sum(F.col("rows_loaded_analytics")).alias("rows_synced"),
        _sum(F.col("duration_ms")).alias("duration_ms"),
        F.when(failed == 0, SUCCESS).when(failed == F.count("*"), FAILED).otherwise("partial").alias("status"),
    )


# -- retention --------------------------------------------------------------------


def retained_runs(runs: DataFrame, as_of, days: int = 90) -> DataFrame:
    return runs.where(_since(as_of, "started_at", days=days))


def retained_children(children: DataFrame, runs_kept: DataFrame) -> DataFrame:
    """Rows of retained runs only; the others go with their run."""
    return children.join(runs_kept.select(F.col("id").alias("run_id")), "run_id", "left_semi")


def retained_lines(lines: DataFrame, as_of, days: int = 30) -> DataFrame:
    return lines.where(_since(as_of, "timestamp", days=days))
