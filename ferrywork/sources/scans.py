"""Reading source rows: full, incremental, bounded and soft-deleted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Columns that mark changed or deleted rows, best first.
CHANGE_COLUMNS = ("updated_at", "modified_at", "last_modified", "updated")
CREATED_COLUMN = "created_at"
DELETED_COLUMN = "deleted_at"


def find_column(df: DataFrame, name: str | None) -> str | None:
    """The frame's own spelling of ``name``, looked up without regard to case."""
    return next((c for c in df.columns if name and c.lower() == name.lower()), None)


def bookmark_literal(value, dtype: T.DataType) -> Column:
    """Stored bookmark text as a literal of the column's type.

    The cast is on the literal, never on the column, so the comparison is
    still pushed into the scan.
    """
    return F.lit(value).cast(dtype)


def live_rows(df: DataFrame, deleted_column: str = DELETED_COLUMN) -> DataFrame:
    """Rows that are not soft-deleted; everything where no such column exists."""
    name = find_column(df, deleted_column)
    return df.where(F.col(name).isNull()) if name else df


def incremental_rows(
    df: DataFrame,
    bookmark_column: str | None,
    bookmark=None,
    deleted_column: str = DELETED_COLUMN,
    lookback: str | None = None,
) -> DataFrame:
    """Live rows strictly past the bookmark.

    Without a bookmark or without the column this is a full scan. ``lookback``
    (an interval text) re-reads a stretch before a time bookmark, for rows that
    were committed late; merging by key makes that safe.
    """
    name = find_column(df, bookmark_column)
    rows = live_rows(df, deleted_column)
    if bookmark is None or name is None:
        return rows
    floor = bookmark_literal(bookmark, df.schema[name].dataType)
    if lookback:
        floor = (floor - F.expr(f"INTERVAL {lookback}")).cast(df.schema[name].dataType)
    return rows.where(F.col(name) > floor)


def bounded_rows(df: DataFrame, order_column: str, max_rows: int, unordered: bool = False) -> DataFrame:
    """The oldest ``max_rows`` rows, plus all rows that tie with the last one.

    ``unordered`` adds the rows without a value, which no later batch would find: for the first batch.

    A cut between equal values would lose the rest of them for good, because
    the next run starts strictly past that value. The cut value is a scalar
    subquery over one narrow column; the rows themselves are only filtered.
    """
    oldest = df.select(order_column).where(F.col(order_column).isNotNull()).orderBy(order_column).limit(max_rows)
    cut = oldest.agg(F.max(order_column).alias("cut"))
    within = F.col(order_column) <= cut.scalar()
    return df.where(within | F.col(order_column).isNull() if unordered else within)


#: Bins of one refinement of a cut; as many rows at most come back from each pass.
CUT_BINS = 1 << 14


def _whole_number(df: DataFrame, column: str):
    """The column as whole numbers in its own order, and a way back to a literal; None for types that have no such form."""
    kind, quoted = df.schema[column].dataType, f"`{column}`"
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(quoted)), lambda n: F.timestamp_micros(F.lit(n))
    if isinstance(kind, T.TimestampNTZType):
        zero = "timestamp_ntz'1970-01-01 00:00:00'"
        return F.expr(f"timestampdiff(MICROSECOND, {zero}, {quoted})"), lambda n: F.expr(f"timestampadd(MICROSECOND, {n}L, {zero})")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(quoted)).cast("bigint"), lambda n: F.date_from_unix_date(F.lit(n).cast("int"))
    if isinstance(kind, T.IntegralType):
        return F.col(quoted).cast("bigint"), lambda n: F.lit(n).cast(kind)
    return None


def batch_cut(df: DataFrame, column: str, max_rows: int, bins: int = CUT_BINS) -> Column | None:
    """Smallest value up to which ``df`` has ``max_rows`` rows or more, as a literal; None where it has no more than that.

    A histogram of the column is refined: the bin in which the count is reached is divided again, until it holds one value.  Each pass is an
    aggregation of one column, combined map-side, over a range that the reader can skip to; no rows are sorted.  Rows without a value do not count.
    """
    number, literal = _whole_number(df, column)
    name = F.col(f"`{column}`")
    low, high, total = df.agg(F.min(number), F.max(number), F.count(name)).first()
    if total <= max_rows:
        return None
    before = 0
    while low < high:
        width = (high - low) // bins + 1
        offset = number - F.lit(low) if high - low < 2**62 else number.cast("double") - F.lit(float(low))
        within = df.where((name >= literal(low)) & (name <= literal(high)))
        counted = within.groupBy(F.floor(offset / width).alias("bin")).agg(F.count("*").alias("n"), F.min(number).alias("low"), F.max(number).alias("high")).collect()
        for found in sorted(counted):
            if before + found["n"] >= max_rows:
                low, high = found["low"], found["high"]
                break
            before += found["n"]
    return literal(low)


def cut_rows(df: DataFrame, order_column: str, max_rows: int, unordered: bool = False) -> DataFrame:
    """The rows of :func:`bounded_rows`, with the cut found by :func:`batch_cut` where the column's type allows.

    The rows themselves are read once, up to the cut: rows that came in since it was found and lie below it are part of the batch too.
    """
    if _whole_number(df, order_column) is None:
        return bounded_rows(df, order_column, max_rows, unordered)
    cut, name = batch_cut(df, order_column, max_rows), F.col(f"`{order_column}`")
    within = name.isNotNull() if cut is None else name <= cut
    return df.where(within | name.isNull()) if unordered else df.where(within)


def soft_deleted_rows(
    df: DataFrame,
    bookmark,
    bookmark_column: str,
    deleted_column: str = DELETED_COLUMN,
    include_touched: bool = True,
    lookback: str | None = None,
) -> DataFrame:
    """Rows soft-deleted past the bookmark; none without a bookmark.

    ``lookback`` moves the floor back as it does for live rows.

    ``include_touched=False`` leaves out rows whose change column also moved
    past the bookmark. Those are missed by the live scan too, so the default
    keeps them.
    """
    deleted, changed = find_column(df, deleted_column), find_column(df, bookmark_column)
    if bookmark is None or deleted is None:
        return df.limit(0)
    floor = bookmark_literal(bookmark, df.schema[deleted].dataType)
    if lookback:
        floor = (floor - F.expr(f"INTERVAL {lookback}")).cast(df.schema[deleted].dataType)
    rows = df.where(F.col(deleted) > floor)
    if include_touched or changed is None:
        return rows
    floor = bookmark_literal(bookmark, df.schema[changed].dataType)
    return rows.where(F.col(changed).isNull() | (F.col(changed) <= floor))


def json_documents(df: DataFrame, column: str, schema: T.StructType | str, keep: list[str] | None = None) -> DataFrame:
    """Documents held as JSON text, as typed columns beside ``keep``."""
    parsed = F.from_json(F.col(column), schema)
    return df.select(*(keep or []), parsed.alias("_doc")).select(*(keep or []), "_doc.*")


def flatten_documents(df: DataFrame, id_column: str = "_id") -> DataFrame:
    """Document columns in plain form: id as text, times as ISO text, nested as JSON."""
    from ferrywork.functions.formats import iso_text

    out = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if field.name == id_column:
            col = col.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            col = iso_text(col)
        elif isinstance(field.dataType, (T.StructType, T.ArrayType, T.MapType)):
            col = F.to_json(col, {"ignoreNullFields": "false"})
        out.append(col.alias(field.name))
    return df.select(out)


#: Column that holds a line that the reader could not take apart.
BROKEN = "_broken_line"


def read_lines(spark: SparkSession, path: str, file_format: str, schema: T.StructType, **options) -> DataFrame:
    """Lines of CSV (without a heading) or JSON as typed rows, with the text of each line that does not fit ``schema`` in :data:`BROKEN`.

    Lines are parsed whole, whatever columns are asked for later, so that a broken one is never taken for a sound one.  Blank lines are no rows.
    """
    parse = {"csv": F.from_csv, "json": F.from_json}[file_format]
    full = T.StructType([*schema.fields, T.StructField(BROKEN, T.StringType())])
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in full.fields) if file_format == "csv" else full
    settings = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN, **options}
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", parse(F.col("value"), shape, settings).alias("_row"))
    broken = F.when(F.col("_row").isNull(), F.col("value")).otherwise(F.col(f"_row.{BROKEN}"))
    return lines.select(*[F.col(f"_row.`{f.name}`") for f in schema.fields], broken.alias(BROKEN))


def split_broken(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sound rows of :func:`read_lines`, and the broken lines in the form that dead letters are made of."""
    from ferrywork.operators import deadletter

    sound = rows.where(F.col(BROKEN).isNull()).drop(BROKEN)
    broken = rows.where(F.col(BROKEN).isNotNull()).withColumns({
        deadletter.ERROR_TYPE: F.lit(deadletter.TYPE_MISMATCH),
        deadletter.ERROR_TEXT: F.lit("line does not parse"),
        deadletter.ERROR_ROW: F.to_json(F.struct(F.col(BROKEN).alias("line"))),
    })
    return sound, broken.drop(BROKEN)


# Options that let a text format give back what was written: times to the microsecond, NULL apart from an empty text.
EXPORT_OPTIONS = {
    "csv": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "nullValue": "\\N", "escape": '"'},
    "json": {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "ignoreNullFields": "false"},
}


def export_files(df: DataFrame, path: str, file_format: str, mode: str = "errorifexists", **options) -> None:
    """Write ``df`` in one of Spark's file formats; :func:`import_options` reads it back."""
    df.write.format(file_format).options(**{**EXPORT_OPTIONS.get(file_format, {}), **options}).mode(mode).save(path)


def import_options(file_format: str) -> dict[str, str]:
    """Reader options for what :func:`export_files` wrote."""
    return {k: v for k, v in EXPORT_OPTIONS.get(file_format, {}).items() if k != "ignoreNullFields"}


def read_files(spark: SparkSession, path: str, file_format: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Files through Spark's own reader; give ``schema`` for text formats."""
    reader = spark.read.format(file_format).options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)
