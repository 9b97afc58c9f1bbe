"""Row transforms: each step maps a DataFrame to a DataFrame, lazily.

A chain of steps stays one projection/filter in the plan; only ``script`` runs
Python, in Arrow batches.
"""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ferrywork.functions import pytext
from ferrywork.functions.expressions import ExpressionError, UnsupportedExpression, kept_by, value_of
from ferrywork.operators.load import json_row

log = logging.getLogger(__name__)

# A longer mapping is joined instead of being spelled out in the expression.
MAX_LITERAL_MAPPING = 1_000


def _col(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_before(rejects: str) -> str:
    """Name of the column that holds a row, as JSON, as it was before its first failed cast."""
    return f"{rejects}_row"


def noted(df: DataFrame, changed: dict[str, Column], failed: dict[str, Column], rejects: str, keep_row: bool = True) -> DataFrame:
    """Set the ``changed`` columns; where a ``failed`` condition holds, note its column's name and the row before."""
    internal = [c for c in (rejects, row_before(rejects)) if c in df.columns]
    names = F.concat_ws(", ", *[F.when(bad, F.lit(n)) for n, bad in failed.items()])
    before = F.when(names != "", json_row(df.drop(*internal)))
    if rejects in internal:
        names = F.concat_ws(", ", F.nullif(_col(rejects), F.lit("")), F.nullif(names, F.lit("")))
    if row_before(rejects) in internal:
        before = F.coalesce(_col(row_before(rejects)), before)
    return df.withColumns({**changed, rejects: names, **({row_before(rejects): before} if keep_row else {})})


def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename all columns at once, so names can be swapped.

    Where two columns end up with one name, the later one stays.
    """
    if not mapping:
        return df
    final = {}
    for name in df.columns:
        final[mapping.get(name, name)] = name
    return df.select([_col(old).alias(new) for new, old in final.items()])


def remove_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.drop(*fields)


def compute(df: DataFrame, expression: str, rejects: str | None = None) -> DataFrame:
    """``name = expression``; a row whose expression fails keeps its old value.

    An old value that does not fit the new type becomes NULL, and is noted in ``rejects`` as a failed cast.
    """
    target, sep, text = expression.partition("=")
    target, text = target.strip(), text.strip()
    if not sep or not target or not text:
        return df
    value = value_of(text, df.schema)
    if target not in df.columns:
        return df.withColumn(target, value)
    new_type = df.select(value.alias("v")).schema["v"].dataType
    old_type = df.schema[target].dataType
    old = _col(target) if old_type == new_type else _col(target).try_cast(new_type)
    kept = F.coalesce(value, old)
    if rejects and old_type != new_type:
        return noted(df, {target: kept}, {target: kept.isNull() & _col(target).isNotNull()}, rejects)
    return df.withColumn(target, kept)


def filter_rows(df: DataFrame, condition: str) -> DataFrame:
    """Keep rows where the condition is true, and rows where it fails."""
    return df.where(kept_by(condition, df.schema)) if condition else df


def map_values(df: DataFrame, column: str, mapping: dict[str, object]) -> DataFrame:
    """Replace values found in ``mapping`` by their text; others and NULL stay."""
    if not column or not mapping or column not in df.columns:
        return df
    text = pytext.py_str(_col(column), df.schema[column].dataType)
    pairs = {str(k): None if v is None else str(v) for k, v in mapping.items()}
    if len(pairs) <= MAX_LITERAL_MAPPING:
        # One entry per key holds a struct, so a key mapped to NULL is told
        # from a key that is missing.
        lookup = F.create_map(*[x for k, v in pairs.items() for x in (F.lit(k), F.struct(F.lit(v).cast("string").alias("to")))])
        hit = F.try_element_at(lookup, text)
        return df.withColumn(column, F.when(hit.isNotNull(), hit["to"]).otherwise(text))
    schema = T.StructType().add("_from", T.StringType()).add("_to", T.StringType()).add("_hit", T.BooleanType())
    table = df.sparkSession.createDataFrame([(k, v, True) for k, v in pairs.items()], schema)
    joined = df.withColumn("_text", text).join(table, F.col("_text") == F.col("_from"), "left")
    mapped = F.when(F.col("_hit"), F.col("_to")).otherwise(F.col("_text"))
    return joined.select([mapped.alias(c) if c == column else _col(c) for c in df.columns])


def _cast_column(col: Column, dtype: T.DataType, target: str) -> Column | None:
    """The converted column; None where the type has no such conversion."""
    if target == "int":
        return pytext.py_int(col, dtype)
    if target == "float":
        return pytext.py_float(col, dtype)
    if target == "str":
        return pytext.py_str(col, dtype)
    if target == "bool":
        return pytext.py_bool(col, dtype)
    return None


def _casts(df: DataFrame, columns: dict[str, str]) -> dict[str, Column]:
    casts = {}
    for name, target in columns.items():
        if name in df.columns:
            casted = _cast_column(_col(name), df.schema[name].dataType, target)
            if casted is not None:
                casts[name] = casted
    return casts


def type_cast(df: DataFrame, columns: dict[str, str], rejects: str | None = None, keep_row: bool = False) -> DataFrame:
    """Convert columns to int, float, str or bool.

    A value that does not convert becomes NULL, because a typed column cannot
    keep it. With ``rejects`` its column name is added to that text column,
    and with ``keep_row`` the row before the step is kept, for the dead letters.
    """
    casts = _casts(df, columns)
    if not casts:
        return df
    if rejects:
        return noted(df, casts, {n: _col(n).isNotNull() & c.isNull() for n, c in casts.items()}, rejects, keep_row)
    return df.withColumns(casts)


def concat_fields(
    df: DataFrame,
    fields: list[str],
    separator: str = " ",
    target: str = "concatenated",
    drop_source: bool = False,
    null_as: str = "None",
) -> DataFrame:
    """Join fields as text; an absent field gives ``""``, NULL gives ``null_as``."""
    if not fields:
        return df
    parts = [
        F.coalesce(pytext.py_str(_col(f), df.schema[f].dataType), F.lit(null_as)) if f in df.columns else F.lit("")
        for f in fields
    ]
    out = df.withColumn(target, F.concat_ws(separator, *parts))
    return out.drop(*fields) if drop_source else out


def script(
    df: DataFrame, fn: Callable[[dict], dict | None], schema: T.StructType | str | None = None, beside: tuple[str, ...] = ()
) -> DataFrame:
    """Run ``fn(row) -> row | None`` over every row, in Arrow batches.

    None drops the row, an exception keeps the original row. ``schema`` is the
    declared output schema (the input's by default): extra keys are dropped,
    missing keys are NULL. Rows are handled one batch at a time, so memory does
    not grow with the partition. Columns ``beside`` pass by the function unseen.
    """
    beside = [c for c in beside if c in df.columns]
    out_schema = df.schema if schema is None else schema
    if isinstance(out_schema, str):
        out_schema = T.StructType.fromDDL(out_schema)
    # A script may leave any value out, whatever the input promised.
    out_schema = T.StructType([T.StructField(f.name, f.dataType) for f in out_schema.fields if f.name not in beside])
    for name in beside:
        out_schema = out_schema.add(name, df.schema[name].dataType)
    names = out_schema.names

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_schema = to_arrow_schema(out_schema)

        def arrow(rows):
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in rows], schema=arrow_schema)

        for batch in batches:
            before, after = [], []
            for row in batch.to_pylist():
                held = {name: row.pop(name) for name in beside}
                try:
                    result = fn(dict(row))
                    if result is not None:
                        result = {**result, **held}
                except Exception:
                    result = {**row, **held}
                if result is not None:
                    before.append({**row, **held})
                    after.append(result)
            try:
                yield arrow(after)
            except (pa.ArrowException, TypeError, ValueError, AttributeError):
                # Some result does not fit the schema: those rows count as failed.
                for old, new in zip(before, after):
                    try:
                        yield arrow([new])
                    except (pa.ArrowException, TypeError, ValueError, AttributeError):
                        yield arrow([old])

    return df.mapInArrow(run, out_schema)


def mask(df: DataFrame, column: str, method: str = "email") -> DataFrame:
    """Hide a text column: ``email`` keeps first letter and domain, ``sha256`` hashes."""
    if column not in df.columns:
        return df
    text = _col(column).cast("string")
    if method == "sha256":
        return df.withColumn(column, F.sha2(text, 256))
    return df.withColumn(column, F.regexp_replace(text, r"^(.)[^@]*(@.*)$", "$1***$2"))


def apply_step(df: DataFrame, step: dict, scripts: dict | None = None, rejects: str | None = None) -> DataFrame:
    kind, config = step.get("type"), step.get("config") or {}
    if kind == "rename":
        return rename(df, config.get("mapping") or {})
    if kind == "remove_fields":
        return remove_fields(df, config.get("fields") or [])
    if kind == "compute":
        return compute(df, config.get("expression", ""), rejects)
    if kind == "filter":
        return filter_rows(df, config.get("condition", ""))
    if kind == "map_values":
        return map_values(df, config.get("column", ""), config.get("mapping") or {})
    if kind == "type_cast":
        return type_cast(df, config.get("columns") or {}, rejects, keep_row=True)
    if kind == "concat_fields":
        return concat_fields(
            df,
            config.get("fields") or [],
            config.get("separator", " "),
            config.get("target", "concatenated"),
            config.get("drop_source", False),
            config.get("null_as", "None"),
        )
    if kind == "mask":
        return mask(df, config.get("column", ""), config.get("method", "email"))
    if kind == "script":
        entry = (scripts or {}).get(config.get("script_name"))
        if entry is None:
            log.warning("script %r is not registered; step skipped", config.get("script_name"))
            return df
        fn, schema = entry if isinstance(entry, tuple) else (entry, None)
        return script(df, fn, schema, (rejects, row_before(rejects)) if rejects else ())
    log.warning("unknown transform type %r; step skipped", kind)
    return df


def apply_steps(
    df: DataFrame,
    steps: list[dict] | None,
    scripts: dict | None = None,
    rejects: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Apply ``[{type, config}]`` in order.

    A step that would fail on every row changes none: it is skipped with a warning, or raised with ``strict``.  A step that is sound
    but cannot be expressed is always raised, before any row is read: without it the rows would come out wrong.
    """
    for step in steps or []:
        try:
            df = apply_step(df, step, scripts, rejects)
        except ExpressionError as exc:
            if strict or isinstance(exc, UnsupportedExpression):
                raise
            log.warning("transform step %s skipped: %s", step, exc)
    return df
