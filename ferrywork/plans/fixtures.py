"""Source tables and run logs derived from the given parquet tables.

Each view exists twice: as a Spark frame and as the text of the same view for
the SQL side of a check. All of them grow with the tables they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BOOKMARK = "1998-01-01 00:00:00"
AS_OF = "2024-01-31 00:00:00"
RUN_ID = "run-0001"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SPARK_VIEWS = {
    "src_orders": ("orders", [
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate AS updated_at",
        "CASE WHEN o_orderstatus = 'P' THEN o_orderdate + make_dt_interval(cast(o_orderkey % 60 AS int)) END AS deleted_at",
    ]),
    "runs": ("events", [
        "event_id AS id", "user_id AS pipeline_id",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'running' ELSE 'success' END AS status",
        "ts AS started_at",
        "CASE WHEN event_type <> 'signup' THEN timestampadd(MILLISECOND, cast(floor(value * 1000) AS bigint), ts) END AS finished_at",
        "CASE WHEN event_type <> 'signup' THEN cast(floor(value * 1000) AS bigint) END AS duration_ms",
        "CASE WHEN event_type NOT IN ('error', 'signup') THEN cast(floor(value * 10) AS bigint) END AS rows_synced",
        "CASE event_type WHEN 'click' THEN 'manual' ELSE 'scheduled' END AS trigger_type",
        "CASE WHEN event_type = 'error' THEN concat('E', cast(user_id % 5 AS string)) END AS error_message",
    ]),
    "pipelines": ("customer", [
        "c_custkey AS id", "concat('pipe-', cast(c_custkey AS string)) AS name",
        "CASE WHEN c_acctbal < 0 THEN 'paused' WHEN c_mktsegment = 'MACHINERY' THEN 'error' ELSE 'active' END AS status",
        "CASE WHEN c_custkey % 3 > 0 THEN c_custkey - (c_custkey % 3) END AS depends_on",
        "CASE WHEN c_custkey % 2 = 0 THEN 'raw' ELSE 'direct' END AS load_mode",
        "c_custkey % 120 AS source_id", "cast(c_nationkey AS bigint) AS destination_id",
        "5 + 55 * (c_custkey % 7) AS schedule_minutes",
    ]),
    "sources": ("supplier", [
        "s_suppkey AS id", "concat('Src ', s_name) AS name",
        "CASE WHEN s_acctbal > 0 THEN 'connected' ELSE 'error' END AS status",
        "timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(cast(s_suppkey AS int)) AS created_at",
    ]),
    "destinations": ("nation", ["cast(n_nationkey AS bigint) AS id", "n_name AS name"]),
    "run_logs": ("events", [
        "event_id AS id", "user_id AS run_id", "ts AS timestamp",
        "CASE event_type WHEN 'error' THEN 'ERROR' ELSE 'INFO' END AS level", "props AS message",
    ]),
    "links": ("customer", [
        "c_custkey AS pipeline_id", "cast(c_nationkey AS bigint) AS target_id",
        "CASE c_mktsegment WHEN 'MACHINERY' THEN array('success', 'failure') WHEN 'FURNITURE' THEN array('dead_letter', 'quality_breach') "
        "WHEN 'HOUSEHOLD' THEN array('failure', 'schema_drift') WHEN 'AUTOMOBILE' THEN array('other', 'success') END AS event_types",
    ]),
    "targets": ("nation", [
        "cast(n_nationkey AS bigint) AS id", "n_name AS name",
        "CASE n_regionkey WHEN 1 THEN 'discord' WHEN 2 THEN 'slack' WHEN 3 THEN 'email' ELSE 'telegram' END AS type",
        "n_nationkey % 4 <> 0 AS is_active",
    ]),
}

# DuckDB text where it differs from the Spark expressions above.
_SQL_TEXT = {
    "o_orderdate + make_dt_interval(cast(o_orderkey % 60 AS int))": "o_orderdate + to_days(cast(o_orderkey % 60 AS integer))",
    "timestampadd(MILLISECOND, cast(floor(value * 1000) AS bigint), ts)": "ts + to_milliseconds(cast(floor(value * 1000) AS bigint))",
    "timestamp_ntz'2024-01-31 00:00:00' - make_dt_interval(cast(s_suppkey AS int))": "timestamp '2024-01-31 00:00:00' - to_days(cast(s_suppkey AS integer))",
    "AS string)": "AS varchar)",
    "array('success', 'failure')": "['success', 'failure']",
    "array('dead_letter', 'quality_breach')": "['dead_letter', 'quality_breach']",
    "array('failure', 'schema_drift')": "['failure', 'schema_drift']",
    "array('other', 'success')": "['other', 'success']",
}

_OVER_VIEWS = {
    "run_table_stats": ("runs", [
        "id AS run_id", "concat('t', cast(pipeline_id % 4 AS string)) AS table_name", "rows_synced AS rows_extracted",
        "CASE WHEN pipeline_id % 2 = 0 THEN rows_synced END AS rows_loaded_raw",
        "CASE WHEN rows_synced IS NOT NULL THEN rows_synced - (id % 3) END AS rows_loaded_analytics",
        "CASE WHEN id % 7 = 0 THEN cast(0 AS bigint) ELSE duration_ms END AS duration_ms", "error_message",
    ]),
    "run_results": ("runs", [
        "pipeline_id", "id AS run_id", "concat('t', cast(pipeline_id % 4 AS string)) AS table_name", "status", "rows_synced", "duration_ms",
        "CASE WHEN id % 11 = 0 THEN id % 5 ELSE 0 END AS rows_failed",
        "CASE WHEN id % 13 = 0 THEN 'c1, c2' ELSE '' END AS new_columns", "id % 17 <> 0 AS passed", "error_message",
    ]),
}

_GROUPED_VIEWS = {
    "pipeline_tables": (
        "orders",
        ["o_custkey AS pipeline_id", "concat('t', cast(o_orderkey % 4 AS string)) AS source_table"],
        [
            "concat('s', cast(max(o_orderkey) % 6 AS string)) AS source_schema", "max(o_totalprice) > 150000 AS enabled",
            "CASE WHEN min(o_orderpriority) = '1-URGENT' THEN 'raw' END AS load_mode",
            "CASE WHEN max(o_orderstatus) = 'P' THEN 'updated_at' END AS bookmark_column",
        ],
    ),
    "bookmarks": (
        "orders",
        ["o_custkey AS pipeline_id", "concat('t', cast(o_orderkey % 4 AS string)) AS source_table"],
        ["cast(max(o_orderkey) AS string) AS bookmark_value", "count(*) AS row_count"],
    ),
}

_DEAD_LETTERS = [
    "event_id AS id", "concat('src_', cast(user_id % 5 AS string)) AS source_name",
    "concat('t', cast(user_id % 4 AS string)) AS table_name", "user_id AS run_id", "props AS row_data",
    "CASE WHEN user_id % 2 = 0 THEN 'TYPE_MISMATCH' ELSE 'NULL_CONSTRAINT' END AS error_type",
    "concat('bad value ', cast(user_id % 9 AS string)) AS error_text", "ts AS failed_at", "event_id % 4 = 0 AS reprocessed",
]

DEPENDS = {"run_table_stats": ["runs"], "run_results": ["runs"]}


def view_columns(name: str) -> list[str]:
    """Column expressions of a view over one table, for use on a stream of that table."""
    return _SPARK_VIEWS[name][1]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived view ``name`` as a Spark frame."""
    if name == "dead_letters":
        return table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr(*_DEAD_LETTERS)
    if name in _GROUPED_VIEWS:
        base, keys, measures = _GROUPED_VIEWS[name]
        keyed = table(spark, sf_dir, base).selectExpr("*", *keys)
        names = [k.split(" AS ")[-1] for k in keys]
        from pyspark.sql import functions as F

        return keyed.groupBy(*names).agg(*[F.expr(m.rsplit(" AS ", 1)[0]).alias(m.rsplit(" AS ", 1)[1]) for m in measures])
    if name in _OVER_VIEWS:
        base, exprs = _OVER_VIEWS[name]
        return view(spark, sf_dir, base).selectExpr(*exprs)
    base, exprs = _SPARK_VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*exprs)


def view_sql(name: str) -> str:
    """The derived view ``name`` as DuckDB SQL over the same tables."""
    if name == "dead_letters":
        text = f"SELECT {', '.join(_DEAD_LETTERS)} FROM events WHERE event_type = 'error'"
    elif name in _GROUPED_VIEWS:
        base, keys, measures = _GROUPED_VIEWS[name]
        text = f"SELECT {', '.join(keys + measures)} FROM {base} GROUP BY ALL"
    else:
        base, exprs = (_OVER_VIEWS.get(name) or _SPARK_VIEWS[name])
        text = f"SELECT {', '.join(exprs)} FROM {base}"
    for spark_text, duck_text in _SQL_TEXT.items():
        text = text.replace(spark_text, duck_text)
    return text


def with_views(body: str, *names: str) -> str:
    """``body`` with the named views in front of it, dependencies first."""
    ordered: list[str] = []
    for name in names:
        for needed in [*DEPENDS.get(name, []), name]:
            if needed not in ordered:
                ordered.append(needed)
    if not ordered:
        return body
    ctes = ",\n".join(f"{n} AS ({view_sql(n)})" for n in ordered)
    return f"WITH {ctes}\n{body}"
