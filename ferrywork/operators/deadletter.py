"""Rejected rows: found one by one, stored as JSON, listed and tried again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ferrywork.functions.names import safe_name
from ferrywork.operators.load import json_row
from ferrywork.operators.merge import has_key, unfolded
from ferrywork.operators.transforms import apply_steps, row_before

# Reasons for a rejection.
TYPE_MISMATCH, NULL_CONSTRAINT, PK_DUPLICATE = "TYPE_MISMATCH", "NULL_CONSTRAINT", "PK_DUPLICATE"
ERROR_TYPE, ERROR_TEXT = "error_type", "error_text"
#: The row as it was before the value that did not convert became NULL.
ERROR_ROW = "error_row"


def row_errors(df: DataFrame, required: list[str], failed_casts: str | None = None) -> DataFrame:
    """Adds ``error_type`` and ``error_text``, NULL on good rows; needs no shuffle.

    Where the steps kept the row as it was before a failed cast, it becomes ``error_row``.
    """
    missing = F.concat_ws(", ", *[F.when(F.col(f"`{c}`").isNull(), F.lit(c)) for c in required if c in df.columns])
    absent = [c for c in required if c not in df.columns]
    if absent:
        missing = F.concat_ws(", ", F.nullif(missing, F.lit("")), *[F.lit(c) for c in absent])
    casts = F.coalesce(F.col(failed_casts), F.lit("")) if failed_casts and failed_casts in df.columns else F.lit("")
    kind = F.when(casts != "", TYPE_MISMATCH).when(missing != "", NULL_CONSTRAINT)
    text = F.when(casts != "", F.concat(F.lit("value does not convert: "), casts)).when(
        missing != "", F.concat(F.lit("required value is NULL: "), missing)
    )
    out = df.withColumns({ERROR_TYPE: kind, ERROR_TEXT: text})
    if not failed_casts or failed_casts not in df.columns:
        return out
    return out.drop(failed_casts).withColumnRenamed(row_before(failed_casts), ERROR_ROW)


def mark_duplicates(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """Marks every good row but the first per key as a duplicate.

    Equal rows are folded into one with a count, then one aggregate per key gives its first row and its number of rows, both combined
    map-side so that a hot key does not gather, and is joined back once; the copies are unfolded after it.  The order is made total by all
    the other columns.  Both uses of the folded rows share one shuffle, so ``df`` is read once.
    """
    columns = [c for c in df.columns if c not in (ERROR_TYPE, ERROR_TEXT, ERROR_ROW)]
    folded = df.groupBy(*df.columns).agg(F.count("*").alias("_copies"))
    rest = [c for c in columns if c not in keys and c not in order_by]
    place = F.struct(*order_by, *rest) if order_by or rest else F.lit(0)
    good = F.col(ERROR_TYPE).isNull()
    # Written as conditions inside the aggregates: a filter would be pushed below the folding, which then could not be shared.
    firsts = folded.groupBy(*keys).agg(F.min(F.when(good, place)).alias("_first"), F.sum(F.when(good, F.col("_copies"))).alias("_rows"))
    # Null-safe, as a plain equality would filter one use by key; rows without a key are no duplicates all the same.
    renamed = firsts.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    copies = unfolded(folded.join(renamed, same, "left"), "_copies", "_copy")
    duplicate = good & has_key(keys) & F.coalesce((F.col("_rows") > 1) & ~((place == F.col("_first")) & (F.col("_copy") == 1)), F.lit(False))
    text = F.concat(F.lit("key occurs again: "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys]))
    return copies.withColumns({ERROR_TYPE: F.when(duplicate, PK_DUPLICATE).otherwise(F.col(ERROR_TYPE)), ERROR_TEXT: F.when(duplicate, text).otherwise(F.col(ERROR_TEXT))}).select(*df.columns)


def dead_letters(
    rejected: DataFrame, source: str, table: str, run_id: str, failed_at: Column, error_text: str | None = None, pipeline_id: str | None = None
) -> DataFrame:
    """Rejected rows in dead-letter form: the row as JSON, with the value that did not convert, beside its error.

    Equal rows give letters of their own, told apart by the copy's number in the id.
    """
    columns = [c for c in rejected.columns if c not in (ERROR_TYPE, ERROR_TEXT, ERROR_ROW)]
    data = json_row(rejected.select(*[f"`{c}`" for c in columns]))
    if ERROR_ROW in rejected.columns:
        data = F.coalesce(F.col(ERROR_ROW), data)
    kind = F.col(ERROR_TYPE) if ERROR_TYPE in rejected.columns else F.lit(None).cast("string")
    text = F.lit(error_text) if error_text is not None else F.col(ERROR_TEXT)
    letters = rejected.select(
        F.lit(pipeline_id).cast("string").alias("pipeline_id"),
        F.lit(safe_name(source)).alias("source_name"),
        F.lit(table).alias("table_name"),
        F.lit(run_id).alias("run_id"),
        data.alias("row_data"),
        kind.alias(ERROR_TYPE),
        text.alias(ERROR_TEXT),
        failed_at.alias("failed_at"),
        F.lit(False).alias("reprocessed"),
    )
    # The id comes from the content and the copy's number, so a task that runs again gives it again.
    copies = unfolded(letters.groupBy(*letters.columns).agg(F.count("*").alias("_copies")), "_copies", "_copy")
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("pipeline_id", "run_id", "source_name", "table_name", ERROR_TYPE, ERROR_TEXT, "row_data", "_copy")]
    return copies.select(F.sha2(F.concat_ws("\n", *parts), 256).alias("id"), *letters.columns)


def summary(letters: DataFrame) -> DataFrame:
    """Dead letters by source and table with the last failure, most first."""
    return (
        letters.groupBy("source_name", "table_name")
        .agg(F.count("*").alias("failed_rows"), F.max("failed_at").alias("last_failure"))
        .orderBy(F.desc("failed_rows"), "source_name", "table_name")
    )


def page(letters: DataFrame, source: str, offset: int, limit: int) -> DataFrame:
    """One source's dead letters, newest first."""
    mine = letters.where(F.col("source_name") == safe_name(source))
    return mine.orderBy(F.desc("failed_at"), F.desc("id")).offset(offset).limit(limit)


def reprocess(letters: DataFrame, schema, steps, required: list[str], scripts: dict | None = None, conform=None, letter: str = "id") -> DataFrame:
    """Waiting letters run through ``steps`` again, and through ``conform`` where given: the typed row, and the outcome.

    ``reprocessed`` is true where the row now passes; ``letter`` names the column of the letter's id, for rows that have an ``id`` of their own.
    """
    waiting = letters.where(~F.col("reprocessed")).select(F.col("id").alias(letter), F.from_json("row_data", schema).alias("_row"))
    rows = apply_steps(waiting.select(letter, "_row.*"), steps, scripts, rejects="_casts")
    out = row_errors(conform(rows) if conform else rows, required, "_casts").drop(ERROR_ROW)
    return out.withColumn("reprocessed", F.col(ERROR_TYPE).isNull())
