"""Assets and edges: source table -> raw table -> target table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ferrywork.functions.names import safe_name
from ferrywork.operators.runlog import FAILED, RUNNING, SUCCESS, last_run_per_pipeline

NOT_STARTED = "not_started"


def status_of(run_status: Column, has_stat: Column, stat_error: Column) -> Column:
    """A running run wins, then the table's own figures, then the run's status."""
    return (
        F.when(run_status == RUNNING, RUNNING)
        .when(has_stat, F.when(F.coalesce(F.length(stat_error), F.lit(0)) > 0, FAILED).otherwise(SUCCESS))
        .otherwise(F.coalesce(run_status, F.lit(NOT_STARTED)))
    )


def named_tables(pipelines: DataFrame, tables: DataFrame, sources: DataFrame) -> DataFrame:
    """Enabled tables with their load mode and the name of their raw table."""
    p = pipelines.select(F.col("id").alias("pipeline_id"), "source_id", F.col("load_mode").alias("_mode"))
    s = sources.select(F.col("id").alias("source_id"), F.col("name").alias("_source"))
    modes = ["load_mode", "_mode"] if "load_mode" in tables.columns else ["_mode"]
    source = F.coalesce(safe_name(F.col("_source"), keep_dots=True), F.lit("unknown"))
    joined = tables.where("enabled").join(p, "pipeline_id").join(s, "source_id", "left")
    return joined.select(
        "pipeline_id",
        "source_table",
        F.coalesce(*modes, F.lit("direct")).alias("mode"),
        F.concat(source, F.lit("_"), "source_table", F.lit("_raw")).alias("raw_name"),
    )


def layered_tables(named: DataFrame) -> DataFrame:
    """One row per table and layer, with the asset's name."""

    def layer(name, asset):
        return F.struct(F.lit(name).alias("layer"), F.col(asset).alias("name"))

    source, raw, target = layer("source", "source_table"), layer("raw", "raw_name"), layer("target", "source_table")
    layers = F.when(F.col("mode") == "raw", F.array(source, raw, target)).otherwise(F.array(source, target))
    return named.select("pipeline_id", "source_table", "mode", F.explode(layers).alias("l")).select(
        "pipeline_id", "source_table", "mode", "l.*"
    )


def assets(pipelines: DataFrame, tables: DataFrame, sources: DataFrame, runs: DataFrame, stats: DataFrame, by_source: bool = False) -> DataFrame:
    """Assets with status, rows, time and error of the pipeline's last run.

    Figures are found under the asset's own name, or with ``by_source`` under that of its source table, where a run logs
    the rows of all layers; raw assets have figures only then.

    The last run per pipeline is found first, so only its figures are joined.
    Both uses of it read the same columns, so the runs are shuffled once.
    """
    last = last_run_per_pipeline(runs).select("pipeline_id", F.col("id").alias("run_id"), F.col("status").alias("_run_status"))
    key = ["run_id", "pipeline_id"] if "pipeline_id" in stats.columns else ["run_id"]
    figures = stats.join(last, key).select(
        "pipeline_id",
        F.col("_run_status").alias("_stat_run_status"),
        F.col("table_name").alias("name"),
        F.lit(True).alias("_has"),
        "rows_extracted", "rows_loaded_raw", "rows_loaded_analytics",
        F.col("duration_ms").alias("_duration"),
        F.col("error_message").alias("_error"),
    )
    logged = figures.withColumnRenamed("name", "_logged_as")
    layered = layered_tables(named_tables(pipelines, tables, sources)).withColumn("_logged_as", F.col("source_table" if by_source else "name"))
    joined = layered.join(last, "pipeline_id", "left").join(logged, ["pipeline_id", "_logged_as"], "left")
    zero = F.lit(0).cast("bigint")
    rows = (
        F.when(F.col("layer") == "source", F.col("rows_extracted"))
        .when(F.col("layer") == "raw", F.col("rows_loaded_raw"))
        .otherwise(F.col("rows_loaded_analytics"))
    )
    return joined.select(
        "pipeline_id", "layer", "name", "source_table",
        status_of(F.coalesce("_stat_run_status", "_run_status"), F.coalesce("_has", F.lit(False)), F.col("_error")).alias("status"),
        F.coalesce(rows, zero).alias("rows"),
        F.coalesce("_duration", zero).alias("duration_ms"),
        F.col("_error").alias("error"),
    )


def edges(named: DataFrame) -> DataFrame:
    """Edges between neighbouring layers, keyed ``layer.name``; each table gives its own."""

    def edge(a, b):
        return F.struct(a.alias("from_asset"), b.alias("to_asset"))

    source = F.concat(F.lit("source."), "source_table")
    raw = F.concat(F.lit("raw."), "raw_name")
    target = F.concat(F.lit("target."), "source_table")
    pairs = F.when(F.col("mode") == "raw", F.array(edge(source, raw), edge(raw, target))).otherwise(F.array(edge(source, target)))
    return named.select("pipeline_id", F.explode(pairs).alias("e")).select("pipeline_id", "e.*")


def neighbours(edge_rows: DataFrame) -> DataFrame:
    """One hop up and down of every asset; sources have no upstream, targets no downstream."""

    def seen_from(asset, direction, other):
        return F.struct(F.col(asset).alias("asset"), F.lit(direction).alias("direction"), F.col(other).alias("neighbour"))

    both = F.array(seen_from("to_asset", "upstream", "from_asset"), seen_from("from_asset", "downstream", "to_asset"))
    return edge_rows.select("pipeline_id", F.explode(both).alias("n")).select("pipeline_id", "n.*")
