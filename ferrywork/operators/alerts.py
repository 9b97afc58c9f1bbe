"""Alert events, who gets them, and their text. Sending is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Event types, target types, and message wording.
EVENT_TYPES = ("success", "failure", "dead_letter", "schema_drift", "quality_breach")
TARGET_TYPES = ("telegram", "discord", "slack")
DEFAULT_EVENTS = ("failure",)
TITLES = {
    "success": "Pipeline Succeeded",
    "failure": "Pipeline Failed",
    "dead_letter": "Dead Letter Rows Created",
    "schema_drift": "Schema Drift Detected",
    "quality_breach": "Data Quality Breach",
}
ERROR_CHARS, DETAIL_CHARS = 200, 300


def alert_events(run_results: DataFrame) -> DataFrame:
    """Events of finished tables.

    ``run_results`` has ``pipeline_id, run_id, table_name, status, rows_synced,
    rows_failed, new_columns, passed, error_message``; a row gives one event per
    thing that happened to it.
    """
    def event(kind, detail, when):
        made = F.struct(F.lit(kind).alias("event_type"), detail.cast("string").alias("detail"))
        return F.when(when, made)

    happened = F.array(
        event("success", F.col("rows_synced"), F.col("status") == "success"),
        event("failure", F.col("error_message"), F.col("status") == "failed"),
        event("dead_letter", F.col("rows_failed"), F.col("rows_failed") > 0),
        event("schema_drift", F.col("new_columns"), F.length("new_columns") > 0),
        event("quality_breach", F.col("error_message"), ~F.col("passed")),
    )
    each = run_results.select("pipeline_id", "run_id", "table_name", F.explode(F.array_compact(happened)).alias("e"))
    return each.select("pipeline_id", "run_id", "table_name", "e.*")


def subscriptions(links: DataFrame, targets: DataFrame) -> DataFrame:
    """Links with their target; a link without event types listens to failures."""
    t = targets.select(
        F.col("id").alias("target_id"), F.col("name").alias("target_name"), F.col("type").alias("target_type"), "is_active"
    )
    listed = F.coalesce("event_types", F.array(*[F.lit(e) for e in DEFAULT_EVENTS]))
    return links.withColumn("event_types", listed).join(t, "target_id")


def route_alerts(events: DataFrame, subscribed: DataFrame) -> DataFrame:
    """One row per event and active target that listens to it.

    Subscriptions are unfolded to one row per event type, so the join is an
    equality on pipeline and type and no other pair is ever formed.
    """
    wanted = (
        subscribed.where(F.col("is_active") & F.col("target_type").isin(*TARGET_TYPES))
        .select("pipeline_id", "target_id", "target_name", "target_type", F.explode(F.array_distinct("event_types")).alias("event_type"))
        .where(F.col("event_type").isin(*EVENT_TYPES))
    )
    return events.join(wanted, ["pipeline_id", "event_type"])


def _line(label: str, value: Column) -> Column:
    return F.when(F.length(value) > 0, F.concat(F.lit(f"{label}: "), value))


def message(
    event_type: Column,
    pipeline: Column,
    run_id: Column,
    table: Column,
    rows: Column,
    duration_ms: Column,
    error: Column,
    new_columns: Column,
) -> Column:
    """Title and ``name: value`` lines of one event; empty values give no line."""
    counted = F.format_number(F.coalesce(rows, F.lit(0)), 0)
    cut = F.substring(F.coalesce(error, F.lit("")), 1, ERROR_CHARS)
    bodies = {
        "success": [
            _line("Pipeline", pipeline), _line("Run ID", run_id), _line("Rows Synced", counted),
            _line("Duration", F.concat(duration_ms.cast("string"), F.lit("ms"))),
        ],
        "failure": [
            _line("Pipeline", pipeline), _line("Run ID", run_id),
            _line("Error", F.coalesce(F.nullif(cut, F.lit("")), F.lit("Unknown"))),
        ],
        "dead_letter": [
            _line("Pipeline", pipeline), _line("Run ID", run_id), _line("Table", F.coalesce(table, F.lit("?"))),
            _line("Rejected Rows", counted), _line("Error", cut),
        ],
        "schema_drift": [
            _line("Pipeline", pipeline), _line("Table", F.coalesce(table, F.lit("?"))),
            _line("New Columns", F.coalesce(F.nullif(new_columns, F.lit("")), F.lit("?"))),
        ],
        "quality_breach": [
            _line("Pipeline", pipeline), _line("Run ID", run_id),
            _line("Details", F.substring(F.coalesce(F.nullif(error, F.lit("")), F.lit("Threshold breached")), 1, DETAIL_CHARS)),
        ],
    }
    text = None
    for kind, lines in bodies.items():
        rendered = F.concat_ws("\n", F.lit(TITLES[kind]), *lines)
        text = F.when(event_type == kind, rendered) if text is None else text.when(event_type == kind, rendered)
    return text
