"""Checks of run-log analytics, lineage, alerts and display text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ferrywork.functions import formats
from ferrywork.operators import alerts, lineage, runlog
from ferrywork.plans.fixtures import AS_OF, table, view
from ferrywork.plans.registry import check

NOW = f"timestamp '{AS_OF}'"
DAY, WEEK = f"started_at >= {NOW} - INTERVAL 1 DAY", f"started_at >= {NOW} - INTERVAL 7 DAY"
NEWEST = "ORDER BY started_at DESC, id DESC"


@check("recent_runs", f"SELECT id, pipeline_id, status, coalesce(rows_synced, 0) AS rows_synced, duration_ms, started_at FROM runs {NEWEST} LIMIT 10", ("runs",))
def recent_runs(spark, sf):
    return runlog.recent_runs(view(spark, sf, "runs"), 10)


@check("runs_page", f"SELECT *, (SELECT count(*) FROM runs WHERE status = 'failed') AS total FROM runs WHERE status = 'failed' {NEWEST} LIMIT 50 OFFSET 100", ("runs",))
def runs_page(spark, sf):
    return runlog.runs_page(view(spark, sf, "runs"), 100, 50, status="failed")


@check(
    "runs_with_pipeline_name",
    "SELECT r.*, coalesce(p.name, '') AS pipeline_name FROM runs r LEFT JOIN (SELECT * FROM pipelines WHERE status <> 'paused') p ON p.id = r.pipeline_id",
    ("runs", "pipelines"),
)
def runs_with_pipeline_name(spark, sf):
    # Without the paused pipelines some runs have no name.
    return runlog.runs_with_pipeline_name(view(spark, sf, "runs"), view(spark, sf, "pipelines").where("status <> 'paused'"))


@check(
    "runs_by_asset",
    """SELECT r.id, r.pipeline_id, s.table_name, r.status, r.started_at, r.trigger_type,
        coalesce(s.rows_loaded_analytics, 0) + coalesce(s.rows_loaded_raw, 0) AS rows_synced,
        CASE WHEN s.duration_ms IS NULL OR s.duration_ms = 0 THEN r.duration_ms ELSE s.duration_ms END AS duration_ms,
        coalesce(nullif(s.error_message, ''), r.error_message) AS error_message
        FROM runs r JOIN run_table_stats s ON s.run_id = r.id WHERE s.table_name = 't2'""",
    ("runs", "run_table_stats"),
)
def runs_by_asset(spark, sf):
    return runlog.runs_by_asset(view(spark, sf, "runs"), view(spark, sf, "run_table_stats"), "t2")


@check(
    "runs_page_per_pipeline",
    f"SELECT *, row_number() OVER (PARTITION BY pipeline_id {NEWEST}) AS position FROM runs QUALIFY position BETWEEN 6 AND 10",
    ("runs",),
)
def runs_page_per_pipeline(spark, sf):
    return runlog.runs_page_per_pipeline(view(spark, sf, "runs"), 5, 5)


@check("run_log_page", "SELECT * FROM run_logs WHERE run_id = 7 ORDER BY id LIMIT 20 OFFSET 10", ("run_logs",))
def run_log_page(spark, sf):
    return runlog.log_lines(view(spark, sf, "run_logs"), 7, 10, 20)


@check("sorted_listing", "SELECT p_partkey, p_name, p_size FROM part")
def sorted_listing(spark, sf):
    return runlog.sorted_listing(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"), "p_name", True, "p_partkey")


@check("last_run_per_pipeline", "SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, id DESC) = 1", ("runs",))
def last_run_per_pipeline(spark, sf):
    return runlog.last_run_per_pipeline(view(spark, sf, "runs"))


@check(
    "last_success_per_pipeline",
    "SELECT * FROM runs WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY pipeline_id ORDER BY finished_at DESC, id DESC) = 1",
    ("runs",),
)
def last_success_per_pipeline(spark, sf):
    return runlog.last_success_per_pipeline(view(spark, sf, "runs"))


@check(
    "dependency_gate",
    """SELECT p.id, p.depends_on, u.success_at AS upstream_success_at, u.ran_at AS upstream_run_at, o.ran_at AS last_own_run_at, o.success_at AS last_own_success_at,
        p.depends_on IS NULL OR (u.success_at IS NOT NULL AND (o.ran_at IS NULL OR u.success_at > o.ran_at)) AS satisfied,
        CASE WHEN p.depends_on IS NULL THEN NULL WHEN u.success_at IS NULL THEN 'upstream ''pipe-' || p.depends_on || ''' has never succeeded'
             WHEN o.ran_at IS NOT NULL AND NOT u.success_at > o.ran_at THEN 'upstream ''pipe-' || p.depends_on || ''' has not succeeded since this pipeline last ran' END AS reason
        FROM pipelines p
        LEFT JOIN (SELECT pipeline_id, max(started_at) AS ran_at, max(finished_at) FILTER (status = 'success') AS success_at FROM runs GROUP BY 1) o ON o.pipeline_id = p.id
        LEFT JOIN (SELECT pipeline_id, max(started_at) AS ran_at, max(finished_at) FILTER (status = 'success') AS success_at FROM runs GROUP BY 1) u ON u.pipeline_id = p.depends_on""",
    ("runs", "pipelines"),
)
def dependency_gate(spark, sf):
    return runlog.dependency_gate(view(spark, sf, "pipelines"), view(spark, sf, "runs"))


@check(
    "dashboard_summary",
    f"""SELECT count(*) FILTER ({DAY}) AS total_runs_24h, count(*) FILTER ({DAY} AND status = 'failed') AS failed_runs_24h,
        coalesce(sum(rows_synced) FILTER ({DAY}), 0)::bigint AS rows_synced_24h, coalesce(sum(rows_synced) FILTER (status = 'success'), 0)::bigint AS total_rows_synced,
        count(DISTINCT pipeline_id) FILTER (status = 'failed' AND started_at >= {NOW} - INTERVAL 1 HOUR) AS degraded_pipelines,
        CASE WHEN count(*) FILTER ({WEEK}) > 0 THEN round_even(count(*) FILTER ({WEEK} AND status = 'success') / count(*) FILTER ({WEEK}) * 100, 1) ELSE 100.0 END AS uptime_pct_7d,
        coalesce(trunc(avg(duration_ms) FILTER ({WEEK} AND status = 'success')), 0)::bigint AS avg_latency_ms,
        (SELECT count(*) FROM pipelines) AS total_pipelines, (SELECT count(*) FROM pipelines WHERE status = 'active') AS active_pipelines,
        (SELECT count(*) FROM pipelines WHERE status = 'active') AS running_pipelines, (SELECT count(*) FROM sources) AS total_sources,
        (SELECT count(*) FROM sources WHERE status = 'connected') AS active_sources,
        (SELECT count(*) FROM sources WHERE created_at >= {NOW} - INTERVAL 7 DAY) AS new_sources_week,
        (SELECT count(*) FROM pipeline_tables WHERE enabled) AS total_tables_synced, (SELECT count(*) FROM destinations) AS total_destinations
        FROM runs""",
    ("runs", "pipelines", "sources", "pipeline_tables", "destinations"),
)
def dashboard_summary(spark, sf):
    frames = (view(spark, sf, n) for n in ("runs", "pipelines", "pipeline_tables", "sources", "destinations"))
    return runlog.dashboard_summary(*frames, as_of=AS_OF)


@check("degraded_pipelines", f"SELECT count(DISTINCT pipeline_id) AS degraded_pipelines FROM runs WHERE status = 'failed' AND started_at >= {NOW} - INTERVAL 36 HOUR", ("runs",))
def degraded_pipelines(spark, sf):
    return runlog.degraded_pipelines(view(spark, sf, "runs"), AS_OF, hours=36)


@check(
    "pipeline_stats",
    """SELECT pipeline_id, coalesce(sum(rows_synced), 0)::bigint AS total_rows, count(*) AS total_runs, count(*) FILTER (status = 'success') AS success_runs,
        count(*) FILTER (status = 'failed') AS failed_runs FROM runs GROUP BY pipeline_id""",
    ("runs",),
)
def pipeline_stats(spark, sf):
    return runlog.pipeline_stats(view(spark, sf, "runs"))


_DAILY = f"SELECT strftime(started_at, '%Y-%m-%d') AS day, count(*) AS run_count, coalesce(sum(rows_synced), 0)::bigint AS total_rows FROM runs WHERE {WEEK} GROUP BY 1"


@check("daily_run_stats", _DAILY, ("runs",))
def daily_run_stats(spark, sf):
    return runlog.daily_run_stats(view(spark, sf, "runs"), AS_OF, 7).withColumn("day", F.col("day").cast("string"))


@check("busiest_day", f"SELECT day, total_rows, greatest(1, total_rows) AS scale_max FROM ({_DAILY}) ORDER BY total_rows DESC, day LIMIT 1", ("runs",))
def busiest_day(spark, sf):
    return runlog.busiest_day(runlog.daily_run_stats(view(spark, sf, "runs"), AS_OF, 7)).withColumn("day", F.col("day").cast("string"))


@check(
    "pipeline_status_counts",
    """SELECT count(*) FILTER (status = 'active') AS active_count, count(*) FILTER (status = 'paused') AS paused_count, count(*) FILTER (status IN ('error', 'failed')) AS error_count,
        (SELECT count(*) FROM pipeline_tables) AS total_tables, (SELECT count(DISTINCT source_schema) FROM pipeline_tables) AS schema_count FROM pipelines""",
    ("pipelines", "pipeline_tables"),
)
def pipeline_status_counts(spark, sf):
    return runlog.pipeline_status_counts(view(spark, sf, "pipelines"), view(spark, sf, "pipeline_tables"))


@check(
    "pipeline_health",
    f"""SELECT p.id AS pipeline_id, coalesce(e.n, 0) AS error_count_7d, CASE p.status WHEN 'active' THEN CASE WHEN coalesce(e.n, 0) > 0 THEN 'Degraded' ELSE 'Running' END
        WHEN 'paused' THEN 'Paused' ELSE 'Inactive' END AS health
        FROM pipelines p LEFT JOIN (SELECT pipeline_id, count(*) AS n FROM runs WHERE status = 'failed' AND {WEEK} GROUP BY 1) e ON e.pipeline_id = p.id""",
    ("runs", "pipelines"),
)
def pipeline_health(spark, sf):
    return runlog.pipeline_health(view(spark, sf, "pipelines"), view(spark, sf, "runs"), AS_OF)


@check(
    "pipeline_throughput",
    f"""SELECT pipeline_id, coalesce(sum(rows_synced) FILTER ({DAY}), 0)::bigint AS rows_24h,
        floor(coalesce(sum(rows_synced) FILTER ({DAY}), 0) / 24 + 0.5)::bigint AS rows_per_hour FROM runs GROUP BY pipeline_id""",
    ("runs",),
)
def pipeline_throughput(spark, sf):
    return runlog.pipeline_throughput(view(spark, sf, "runs"), AS_OF)


@check("tables_per_pipeline", "SELECT pipeline_id, string_agg(source_table, ',' ORDER BY source_table) AS tables, count(*) AS table_count FROM pipeline_tables GROUP BY 1", ("pipeline_tables",))
def tables_per_pipeline(spark, sf):
    return runlog.tables_per_pipeline(view(spark, sf, "pipeline_tables"))


@check(
    "entity_counts",
    """SELECT 'runs' AS entity, count(*) AS n FROM runs UNION ALL SELECT 'runs:success', count(*) FILTER (status = 'success') FROM runs
        UNION ALL SELECT 'runs:failed', count(*) FILTER (status = 'failed') FROM runs UNION ALL SELECT 'runs:running', count(*) FILTER (status = 'running') FROM runs
        UNION ALL SELECT 'pipelines', count(*) FROM pipelines UNION ALL SELECT 'pipelines:active', count(*) FILTER (status = 'active') FROM pipelines
        UNION ALL SELECT 'sources', count(*) FROM sources UNION ALL SELECT 'sources:connected', count(*) FILTER (status = 'connected') FROM sources
        UNION ALL SELECT 'pipeline_tables', count(*) FROM pipeline_tables UNION ALL SELECT 'dead_letters', count(*) FROM dead_letters
        UNION ALL SELECT 'run_logs', count(*) FROM run_logs""",
    ("runs", "pipelines", "sources", "pipeline_tables", "dead_letters", "run_logs"),
)
def entity_counts(spark, sf):
    names = ("runs", "pipelines", "sources", "pipeline_tables", "dead_letters", "run_logs")
    wanted = {"runs": ["success", "failed", "running"], "pipelines": ["active"], "sources": ["connected"]}
    return runlog.entity_counts({n: view(spark, sf, n) for n in names}, wanted)


@check(
    "pipeline_overview",
    f"""SELECT p.id AS pipeline_id, p.name, p.status, s.name AS source_name, d.name AS destination_name, coalesce(t.n, 0) AS table_count, coalesce(t.e, 0) AS enabled_table_count,
        coalesce(r.total_rows, 0) AS total_rows, coalesce(r.errors, 0) AS error_count_7d, r.latency AS avg_latency_ms, l.started_at AS last_run_at, coalesce(l.status, 'not_started') AS last_run_status
        FROM pipelines p LEFT JOIN sources s ON s.id = p.source_id LEFT JOIN destinations d ON d.id = p.destination_id
        LEFT JOIN (SELECT pipeline_id, count(*) AS n, count(*) FILTER (enabled) AS e FROM pipeline_tables GROUP BY 1) t ON t.pipeline_id = p.id
        LEFT JOIN (SELECT pipeline_id, coalesce(sum(rows_synced), 0)::bigint AS total_rows, count(*) FILTER ({WEEK} AND status = 'failed') AS errors,
                   floor(avg(duration_ms) FILTER ({WEEK} AND status = 'success'))::bigint AS latency FROM runs GROUP BY 1) r ON r.pipeline_id = p.id
        LEFT JOIN (SELECT pipeline_id, started_at, status FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_id {NEWEST}) = 1) l ON l.pipeline_id = p.id""",
    ("pipelines", "sources", "destinations", "pipeline_tables", "runs"),
)
def pipeline_overview(spark, sf):
    frames = (view(spark, sf, n) for n in ("pipelines", "sources", "destinations", "pipeline_tables", "runs"))
    return runlog.pipeline_overview(*frames, as_of=AS_OF)


@check(
    "bookmark_overview",
    """SELECT t.pipeline_id, t.source_table, t.bookmark_column, p.name AS pipeline_name, b.bookmark_value FROM pipeline_tables t JOIN pipelines p ON p.id = t.pipeline_id
        LEFT JOIN bookmarks b ON b.pipeline_id = t.pipeline_id AND b.source_table = t.source_table WHERE t.bookmark_column IS NOT NULL""",
    ("pipelines", "pipeline_tables", "bookmarks"),
)
def bookmark_overview(spark, sf):
    frames = (view(spark, sf, n) for n in ("pipelines", "pipeline_tables", "bookmarks"))
    return runlog.bookmark_overview(*frames)


@check(
    "table_expand_cross",
    "SELECT p.id AS pipeline_id, p.name AS pipeline_name, v.t AS source_table FROM pipelines p, (VALUES ('orders'), ('leads'), ('inventory')) AS v(t) WHERE p.status = 'active'",
    ("pipelines",),
)
def table_expand_cross(spark, sf):
    return runlog.expand_tables(view(spark, sf, "pipelines").where("status = 'active'"), ["orders", "leads", "inventory"])


@check(
    "freshness_status",
    f"""SELECT p.id AS pipeline_id, p.schedule_minutes * 4 AS interval_minutes, s.last_success_at, CASE WHEN s.last_success_at IS NULL THEN 'never'
        WHEN s.last_success_at < {NOW} - to_minutes(p.schedule_minutes * 4) THEN 'stale' ELSE 'fresh' END AS freshness
        FROM pipelines p LEFT JOIN (SELECT pipeline_id, max(finished_at) AS last_success_at FROM runs WHERE status = 'success' GROUP BY 1) s ON s.pipeline_id = p.id""",
    ("pipelines", "runs"),
)
def freshness_status(spark, sf):
    return runlog.freshness_status(view(spark, sf, "pipelines"), view(spark, sf, "runs"), AS_OF, F.col("schedule_minutes") * 4)


@check(
    "run_summary",
    """SELECT pipeline_id AS run_id, count(*) AS table_count, count(error_message) AS failed_tables, coalesce(sum(rows_loaded_analytics), 0)::bigint AS rows_synced,
        coalesce(sum(duration_ms), 0)::bigint AS duration_ms, CASE WHEN count(error_message) = 0 THEN 'success' WHEN count(error_message) = count(*) THEN 'failed' ELSE 'partial' END AS status
        FROM (SELECT s.*, r.pipeline_id * 100 + day(r.started_at) AS pipeline_id FROM run_table_stats s JOIN runs r ON r.id = s.run_id) GROUP BY 1""",
    ("runs", "run_table_stats"),
)
def run_summary(spark, sf):
    # One run per pipeline and day, holding all of that day's table results.
    runs = view(spark, sf, "runs").select(F.col("id").alias("run_id"), (F.col("pipeline_id") * 100 + F.day("started_at")).alias("day_run"))
    stats = view(spark, sf, "run_table_stats").join(runs, "run_id").drop("run_id").withColumnRenamed("day_run", "run_id")
    return runlog.run_summary(stats)


@check(
    "retention_prune",
    f"""SELECT 'runs' AS kind, id FROM runs WHERE started_at >= {NOW} - INTERVAL 12 DAY
        UNION ALL SELECT 'stats', s.run_id FROM run_table_stats s JOIN runs r ON r.id = s.run_id WHERE r.started_at >= {NOW} - INTERVAL 12 DAY
        UNION ALL SELECT 'lines', id FROM run_logs WHERE timestamp >= {NOW} - INTERVAL 4 DAY""",
    ("runs", "run_table_stats", "run_logs"),
)
def retention_prune(spark, sf):
    runs = runlog.retained_runs(view(spark, sf, "runs"), AS_OF, 12)
    stats = runlog.retained_children(view(spark, sf, "run_table_stats"), runs)
    lines = runlog.retained_lines(view(spark, sf, "run_logs"), AS_OF, 4)
    return (
        runs.select(F.lit("runs").alias("kind"), "id")
        .unionByName(stats.select(F.lit("stats").alias("kind"), F.col("run_id").alias("id")))
        .unionByName(lines.select(F.lit("lines").alias("kind"), "id"))
    )


# -- lineage ------------------------------------------------------------------------

_MODE = "coalesce(t.load_mode, p.load_mode)"
_RAW_NAME = "translate(lower(coalesce(s.name, 'unknown')), '- ', '__') || '_' || t.source_table || '_raw'"
_LAYERED = f"""SELECT pipeline_id, source_table, mode, unnest(CASE WHEN mode = 'raw' THEN ['source', 'raw', 'target'] ELSE ['source', 'target'] END) AS layer, raw_name
    FROM (SELECT t.pipeline_id, t.source_table, {_MODE} AS mode, {_RAW_NAME} AS raw_name FROM pipeline_tables t
          JOIN pipelines p ON p.id = t.pipeline_id LEFT JOIN sources s ON s.id = p.source_id WHERE t.enabled)"""
_NAMED = f"SELECT pipeline_id, source_table, mode, layer, CASE WHEN layer = 'raw' THEN raw_name ELSE source_table END AS name FROM ({_LAYERED})"
_LAST = f"SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY pipeline_id {NEWEST}) = 1"
_ASSETS = f"""SELECT a.pipeline_id, a.layer, a.name, a.source_table,
    CASE WHEN l.status = 'running' THEN 'running' WHEN st.run_id IS NOT NULL THEN CASE WHEN coalesce(st.error_message, '') <> '' THEN 'failed' ELSE 'success' END
         ELSE coalesce(l.status, 'not_started') END AS status,
    coalesce(CASE a.layer WHEN 'source' THEN st.rows_extracted WHEN 'raw' THEN st.rows_loaded_raw ELSE st.rows_loaded_analytics END, 0) AS rows,
    coalesce(st.duration_ms, 0) AS duration_ms, st.error_message AS error
    FROM ({_NAMED}) a LEFT JOIN ({_LAST}) l ON l.pipeline_id = a.pipeline_id
    LEFT JOIN run_table_stats st ON st.run_id = l.id AND st.table_name = a.name"""
_LINEAGE = ("runs", "run_table_stats", "pipelines", "pipeline_tables", "sources")


def lineage_frames(spark, sf):
    return [view(spark, sf, n) for n in ("pipelines", "pipeline_tables", "sources")]


@check("lineage_assets", _ASSETS, _LINEAGE)
def lineage_assets(spark, sf):
    return lineage.assets(*lineage_frames(spark, sf), view(spark, sf, "runs"), view(spark, sf, "run_table_stats"))


@check("lineage_assets_by_source", _ASSETS.replace("st.table_name = a.name", "st.table_name = a.source_table"), _LINEAGE)
def lineage_assets_by_source(spark, sf):
    """The same with the figures of all layers logged under the source table, as a run logs them."""
    return lineage.assets(*lineage_frames(spark, sf), view(spark, sf, "runs"), view(spark, sf, "run_table_stats"), by_source=True)


@check("asset_status", f"SELECT layer, status, count(*) AS n FROM ({_ASSETS}) GROUP BY ALL", _LINEAGE)
def asset_status(spark, sf):
    rows = lineage.assets(*lineage_frames(spark, sf), view(spark, sf, "runs"), view(spark, sf, "run_table_stats"))
    return rows.groupBy("layer", "status").agg(F.count("*").alias("n"))


_EDGES = f"""SELECT pipeline_id, 'source.' || source_table AS from_asset, CASE WHEN mode = 'raw' THEN 'raw.' || raw_name ELSE 'target.' || source_table END AS to_asset
    FROM (SELECT DISTINCT pipeline_id, source_table, mode, raw_name FROM ({_LAYERED}))
    UNION ALL SELECT DISTINCT pipeline_id, 'raw.' || raw_name, 'target.' || source_table FROM ({_LAYERED}) WHERE mode = 'raw'"""


@check("lineage_edges", _EDGES, ("pipelines", "pipeline_tables", "sources"))
def lineage_edges(spark, sf):
    return lineage.edges(lineage.named_tables(*lineage_frames(spark, sf)))


@check(
    "lineage_neighbors",
    f"""SELECT pipeline_id, to_asset AS asset, 'upstream' AS direction, from_asset AS neighbour FROM ({_EDGES})
        UNION ALL SELECT pipeline_id, from_asset, 'downstream', to_asset FROM ({_EDGES})""",
    ("pipelines", "pipeline_tables", "sources"),
)
def lineage_neighbors(spark, sf):
    return lineage.neighbours(lineage.edges(lineage.named_tables(*lineage_frames(spark, sf))))


# -- alerts -------------------------------------------------------------------------

_EVENTS = """SELECT pipeline_id, run_id, table_name, 'success' AS event_type, rows_synced::varchar AS detail FROM run_results WHERE status = 'success'
    UNION ALL SELECT pipeline_id, run_id, table_name, 'failure', error_message FROM run_results WHERE status = 'failed'
    UNION ALL SELECT pipeline_id, run_id, table_name, 'dead_letter', rows_failed::varchar FROM run_results WHERE rows_failed > 0
    UNION ALL SELECT pipeline_id, run_id, table_name, 'schema_drift', new_columns FROM run_results WHERE new_columns <> ''
    UNION ALL SELECT pipeline_id, run_id, table_name, 'quality_breach', error_message FROM run_results WHERE NOT passed"""
_SUBSCRIBED = "SELECT l.pipeline_id, l.target_id, coalesce(l.event_types, ['failure']) AS event_types, t.name AS target_name, t.type AS target_type, t.is_active FROM links l JOIN targets t ON t.id = l.target_id"


@check("alert_events", _EVENTS, ("run_results",))
def alert_events(spark, sf):
    return alerts.alert_events(view(spark, sf, "run_results"))


@check("alert_subscriptions", f"SELECT * REPLACE (array_to_string(event_types, ',') AS event_types) FROM ({_SUBSCRIBED})", ("links", "targets"))
def alert_subscriptions(spark, sf):
    rows = alerts.subscriptions(view(spark, sf, "links"), view(spark, sf, "targets"))
    return rows.withColumn("event_types", F.array_join("event_types", ","))


@check(
    "alert_routing",
    f"""SELECT e.*, s.target_id, s.target_name, s.target_type FROM ({_EVENTS}) e JOIN ({_SUBSCRIBED}) s ON s.pipeline_id = e.pipeline_id AND list_contains(s.event_types, e.event_type)
        WHERE s.is_active AND s.target_type IN ('telegram', 'discord', 'slack')""",
    ("run_results", "links", "targets"),
)
def alert_routing(spark, sf):
    subscribed = alerts.subscriptions(view(spark, sf, "links"), view(spark, sf, "targets"))
    return alerts.route_alerts(alerts.alert_events(view(spark, sf, "run_results")), subscribed)


_HEAD = "chr(10) || 'Pipeline: pipe-' || e.pipeline_id"
_RUN = "chr(10) || 'Run ID: ' || e.run_id"


@check(
    "alert_message",
    f"""SELECT e.run_id, e.event_type, CASE e.event_type
          WHEN 'success' THEN 'Pipeline Succeeded' || {_HEAD} || {_RUN} || chr(10) || 'Rows Synced: ' || format('{{:,}}', r.rows_synced) || chr(10) || 'Duration: ' || r.duration_ms || 'ms'
          WHEN 'failure' THEN 'Pipeline Failed' || {_HEAD} || {_RUN} || chr(10) || 'Error: ' || r.error_message
          WHEN 'dead_letter' THEN 'Dead Letter Rows Created' || {_HEAD} || {_RUN} || chr(10) || 'Table: ' || r.table_name || chr(10) || 'Rejected Rows: ' || r.rows_failed
               || coalesce(chr(10) || 'Error: ' || r.error_message, '')
          WHEN 'schema_drift' THEN 'Schema Drift Detected' || {_HEAD} || chr(10) || 'Table: ' || r.table_name || chr(10) || 'New Columns: c1, c2'
          ELSE 'Data Quality Breach' || {_HEAD} || {_RUN} || chr(10) || 'Details: ' || coalesce(r.error_message, 'Threshold breached') END AS message
        FROM ({_EVENTS}) e JOIN run_results r ON r.run_id = e.run_id""",
    ("run_results",),
)
def alert_message(spark, sf):
    results = view(spark, sf, "run_results")
    happened = alerts.alert_events(results).select("run_id", "event_type").join(results, "run_id")
    rows = F.when(F.col("event_type") == "dead_letter", F.col("rows_failed")).otherwise(F.col("rows_synced"))
    text = alerts.message(
        F.col("event_type"), F.concat(F.lit("pipe-"), F.col("pipeline_id").cast("string")), F.col("run_id").cast("string"), F.col("table_name"),
        rows, F.col("duration_ms"), F.col("error_message"), F.col("new_columns"),
    )
    return happened.select("run_id", "event_type", text.alias("message"))


# -- display text ---------------------------------------------------------------------


# One decimal of n / unit: exact ties go up, which printf alone does not do.
_ONE_DECIMAL = "printf('%.1f', CASE WHEN {n} % {unit} IN ({unit} / 4, {unit} * 3 / 4) THEN ({n} + {unit} / 20) / {unit} ELSE {n} / {unit} END)"
_SECONDS = _ONE_DECIMAL.format(n="duration_ms", unit=1000)


@check(
    "format_duration",
    f"""SELECT id, CASE WHEN duration_ms IS NULL THEN '-' WHEN duration_ms < 1000 THEN duration_ms || 'ms' WHEN duration_ms < 60000 THEN {_SECONDS} || 's'
        ELSE (duration_ms // 60000) || 'm ' || ((duration_ms % 60000) // 1000) || 's' END AS duration FROM runs""",
    ("runs",),
)
def format_duration(spark, sf):
    return view(spark, sf, "runs").select("id", formats.duration_text(F.col("duration_ms")).alias("duration"))


@check(
    "format_count",
    f"""SELECT o_orderkey, CASE WHEN n >= 1000000 THEN {_ONE_DECIMAL.format(n='n', unit=1000000)} || 'M' WHEN n >= 1000 THEN {_ONE_DECIMAL.format(n='n', unit=1000)} || 'K' ELSE n::varchar END AS shown
        FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 1000 WHEN 1 THEN floor(o_totalprice)::bigint ELSE floor(o_totalprice)::bigint * 250 END AS n FROM orders)""",
)
def format_count(spark, sf):
    whole = F.floor("o_totalprice")
    n = F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 1000).when(F.col("o_orderkey") % 3 == 1, whole).otherwise(whole * 250)
    return table(spark, sf, "orders").select("o_orderkey", formats.count_text(n).alias("shown"))


@check(
    "format_age",
    f"""SELECT id, CASE WHEN m < 1 THEN 'Just now' WHEN m < 60 THEN m || ' min ago' WHEN m // 60 < 24 THEN (m // 60) || 'h ago' ELSE strftime(started_at, '%Y-%m-%d') END AS age
        FROM (SELECT id, started_at, floor(date_diff('microsecond', started_at, {NOW}) / 60000000)::bigint AS m FROM runs)""",
    ("runs",),
)
def format_age(spark, sf):
    return view(spark, sf, "runs").select("id", formats.age_text(F.col("started_at"), F.lit(AS_OF)).alias("age"))


@check(
    "runs_deep_page",
    """SELECT pipeline_id, started_at, id, position FROM (
        SELECT *, row_number() OVER (PARTITION BY pipeline_id ORDER BY started_at DESC, id DESC) AS position FROM (
            SELECT CASE WHEN l_orderkey % 3 < 2 THEN 0 ELSE l_orderkey % 100 END AS pipeline_id, l_shipdate AS started_at, l_orderkey * 10 + l_linenumber AS id FROM lineitem))
       WHERE position > 3000 AND position <= 3200""",
)
def runs_deep_page(spark, sf):
    """A page far from the newest run, where one pipeline has two thirds of all runs."""
    hot = "CASE WHEN l_orderkey % 3 < 2 THEN 0 ELSE l_orderkey % 100 END AS pipeline_id"
    runs = table(spark, sf, "lineitem").selectExpr(hot, "l_shipdate AS started_at", "l_orderkey * 10 + l_linenumber AS id")
    return runlog.deep_page_per_key(runs, "pipeline_id", "started_at", "id", 3000, 200)
