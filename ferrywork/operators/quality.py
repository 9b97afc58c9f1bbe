"""Checks on loaded rows, each one aggregation pass or none at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ferrywork.functions.pytext import round_half_even

# Fixed value: largest accepted difference of row counts, in percent.
DEFAULT_THRESHOLD_PCT = 5.0


def discrepancy_pct(extracted: Column, loaded: Column) -> Column:
    return F.when(extracted == 0, F.lit(0.0)).otherwise(F.abs(extracted - loaded) / extracted * 100)


def row_count_check(counts: DataFrame, threshold: float = DEFAULT_THRESHOLD_PCT) -> DataFrame:
    """Adds the verdict to rows of ``rows_extracted``, ``rows_loaded``."""
    pct = discrepancy_pct(F.col("rows_extracted"), F.col("rows_loaded"))
    passed = pct <= threshold
    return counts.select(
        "*",
        round_half_even(pct, 2).alias("discrepancy_pct"),
        F.when(passed, "passed").otherwise("failed").alias("status"),
        passed.alias("passed"),
    )


def null_counts(df: DataFrame, required: list[str]) -> list[Column]:
    """One count per required column; an absent column is NULL in every row."""
    return [
        (F.count_if(F.col(f"`{c}`").isNull()) if c in df.columns else F.count("*")).alias(f"nulls_{c}") for c in required
    ]


def null_check(df: DataFrame, required: list[str]) -> DataFrame:
    """One row: verdict and ``col(n)`` list of the required columns holding NULLs."""
    counted = df.agg(F.count("*").alias("n"), *null_counts(df, required))
    return counted.select(*null_verdict([F.col(f"nulls_{c}") for c in required], required))


def null_verdict(counts: list[Column], required: list[str]) -> list[Column]:
    found = [
        F.when(n > 0, F.concat(F.lit(f"{c}("), n.cast("string"), F.lit(")"))) for n, c in zip(counts, required)
    ]
    passed = reduce(lambda a, b: a & b, [F.coalesce(n, F.lit(0)) == 0 for n in counts], F.lit(True))
    return [
        F.lit("null_check").alias("check_type"),
        F.when(passed, "passed").otherwise("warning").alias("status"),
        F.nullif(F.concat_ws(", ", *found), F.lit("")).alias("null_columns"),
        F.lit(", ".join(required)).alias("required_columns"),
        passed.alias("passed"),
    ]


def null_ratios(df: DataFrame, columns: list[str], threshold_pct: float) -> DataFrame:
    """Per column: share of NULLs in percent and whether it stays within the threshold."""
    share = [F.coalesce(F.avg(F.col(f"`{c}`").isNull().cast("int")) * 100, F.lit(0.0)).alias(c) for c in columns]
    long = df.agg(*share).unpivot([], columns, "column_name", "pct")
    return long.select("column_name", round_half_even(F.col("pct"), 2).alias("null_pct"), (F.col("pct") <= threshold_pct).alias("passed"))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row, and how many rows hold each."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("row_count"))
    return counted.where(F.col("row_count") > 1)


def quality_log(df: DataFrame, rows_extracted: Column, required: list[str], threshold: float = DEFAULT_THRESHOLD_PCT) -> DataFrame:
    """Log rows of the row-count check and the null check from one pass over ``df``."""
    counted = df.agg(F.count("*").alias("rows_loaded"), *null_counts(df, required)).withColumn(
        "rows_extracted", rows_extracted
    )
    return checks_of_counts(counted, required, threshold)


def checks_of_counts(counted: DataFrame, required: list[str], threshold: float = DEFAULT_THRESHOLD_PCT) -> DataFrame:
    """Unpivots rows of counts into two log rows each; other columns are kept.

    Rows that were folded into another of their key, ``rows_folded`` where it is counted, are not missing.
    """
    extracted, loaded = F.col("rows_extracted"), F.col("rows_loaded")
    if "rows_folded" in counted.columns:
        loaded = loaded + F.col("rows_folded")
    pct = discrepancy_pct(extracted, loaded)
    _, status, null_columns, required_columns, passed = null_verdict([F.col(f"nulls_{c}") for c in required], required)
    none = F.lit(None).cast("string")

    def log_row(check, status, pct, nulls, required_text, passed):
        return F.struct(
            F.lit(check).alias("check_type"),
            status.alias("status"),
            pct.cast("double").alias("discrepancy_pct"),
            nulls.alias("null_columns"),
            required_text.alias("required_columns"),
            passed.alias("passed"),
        )

    count_row = log_row(
        "row_count", F.when(pct <= threshold, "passed").otherwise("failed"), round_half_even(pct, 2), none, none, pct <= threshold
    )
    null_row = log_row("null_check", status, F.lit(None), null_columns, required_columns, passed)
    kept = [c for c in counted.columns if not c.startswith("nulls_")]
    return counted.select(*kept, F.explode(F.array(count_row, null_row)).alias("c")).select(*kept, "c.*")


def checks_of_run(counts: dict, required: list[str], threshold: float = DEFAULT_THRESHOLD_PCT) -> list[dict]:
    """The two log rows of :func:`checks_of_counts` for one run's figures, which are at hand without a job."""
    extracted, loaded = counts["rows_extracted"], counts["rows_loaded"] + counts.get("rows_folded", 0)
    pct = abs(extracted - loaded) / extracted * 100 if extracted else 0.0
    missing = [f"{c}({counts[f'nulls_{c}']})" for c in required if counts[f"nulls_{c}"]]
    kept = {k: v for k, v in counts.items() if not k.startswith("nulls_")}
    rows = [
        {**kept, "check_type": "row_count", "status": "passed" if pct <= threshold else "failed", "discrepancy_pct": round(pct, 2), "passed": pct <= threshold},
        {**kept, "check_type": "null_check", "status": "warning" if missing else "passed", "required_columns": ", ".join(required), "passed": not missing},
    ]
    if missing:
        rows[1]["null_columns"] = ", ".join(missing)
    return rows


def schema_versions(observed: DataFrame) -> DataFrame:
    """Version history from ``(table_name, seen_at, columns)`` observations, per pipeline where they name it.

    Columns are only ever added, so a list that was left never comes back and
    each distinct list is one version. Observations are folded map-side to the
    distinct lists, of which a table has few, before they are numbered.
    """
    of = [c for c in ("pipeline_id", "table_name") if c in observed.columns]
    first_seen = observed.groupBy(*of, "columns").agg(F.min("seen_at").alias("applied_at"))
    by_table = Window.partitionBy(*of).orderBy("applied_at", "columns")
    return first_seen.select(
        *of, F.row_number().over(by_table).cast("bigint").alias("version"), "columns", "applied_at"
    )
