"""Catalogue frames: what tables and columns exist, and how to sync them."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ferrywork.sources.scans import CHANGE_COLUMNS, CREATED_COLUMN, DELETED_COLUMN

COLUMNS_SCHEMA = "schema_name string, table_name string, column_name string, type string, nullable boolean, pk boolean, position int"

# Schemas that belong to the database itself.
SYSTEM_SCHEMAS = ("information_schema", "pg_catalog", "pg_toast", "mysql", "performance_schema", "sys")


def columns_of(tables: dict[str, DataFrame], schema_name: str = "default", primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """One row per column of the given frames, in column order.

    Only schemas are read, never rows.
    """
    keys = primary_keys or {}
    rows = [
        (schema_name, table, f.name, f.dataType.simpleString(), f.nullable,
         bool(f.metadata.get("pk", f.name in keys.get(table, []))), position)
        for table, df in sorted(tables.items())
        for position, f in enumerate(df.schema.fields, start=1)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, COLUMNS_SCHEMA)


def tables_of(tables: dict[str, DataFrame], schema_name: str = "default") -> DataFrame:
    """One row per frame: its rows (answered from file footers where Spark can) and columns."""
    out = None
    for name, df in sorted(tables.items()):
        part = df.agg(F.count("*").alias("row_count")).select(
            F.lit(schema_name).alias("schema_name"), F.lit(name).alias("table_name"), "row_count",
            F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def discover_tables(spark: SparkSession, schema_include: list[str] | None = None, primary_keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Columns of every table in the session catalogue, ordered by schema and table."""
    parts = []
    for database in spark.catalog.listDatabases():
        if database.name in SYSTEM_SCHEMAS or (schema_include and database.name not in schema_include):
            continue
        tables = {
            t.name: spark.table(f"`{database.name}`.`{t.name}`")
            for t in spark.catalog.listTables(database.name)
            if not t.isTemporary
        }
        if tables:
            parts.append(columns_of(tables, database.name, primary_keys))
    if not parts:
        return spark.createDataFrame([], COLUMNS_SCHEMA)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.orderBy("schema_name", "table_name", "position")


def information_schema_columns(reader) -> DataFrame:
    """Columns of a JDBC source, from its ``information_schema``.

    ``reader`` maps a query to a frame (see ``connectors.jdbc_reader``).
    """
    df = reader(
        "SELECT table_schema, table_name, column_name, data_type, is_nullable, ordinal_position "
        "FROM information_schema.columns"
    )
    return df.where(~F.lower("table_schema").isin(*SYSTEM_SCHEMAS)).select(
        F.col("table_schema").alias("schema_name"),
        "table_name",
        "column_name",
        F.col("data_type").alias("type"),
        (F.upper("is_nullable") == "YES").alias("nullable"),
        F.lit(False).alias("pk"),
        F.col("ordinal_position").cast("int").alias("position"),
    )


def detect_sync_modes(columns: DataFrame) -> DataFrame:
    """Per table: sync mode, change column and soft-delete column.

    The first change column in column order wins, then the creation column;
    a table with neither is fully refreshed.
    """
    name = F.lower("column_name")
    changed = name.isin(*CHANGE_COLUMNS)
    usable = changed | (name == CREATED_COLUMN)
    order = F.struct(F.when(changed, 0).otherwise(1).alias("rank"), F.col("position"))
    picked = columns.groupBy("schema_name", "table_name").agg(
        F.min_by(F.when(usable, F.col("column_name")), F.when(usable, order)).alias("bookmark_column"),
        F.min_by(F.when(name == DELETED_COLUMN, F.col("column_name")), F.when(name == DELETED_COLUMN, F.col("position"))).alias("deleted_at_column"),
    )
    mode = F.when(F.col("bookmark_column").isNotNull(), "incremental").otherwise("full_refresh")
    return picked.select(
        "schema_name",
        "table_name",
        mode.alias("sync_mode"),
        "bookmark_column",
        F.when(F.col("bookmark_column").isNotNull(), F.col("deleted_at_column")).alias("deleted_at_column"),
    )


def discover(tables: dict[str, DataFrame], schema_name: str = "default") -> DataFrame:
    """Per table: rows, columns, sync mode and the newest value of its bookmark column, as text and, where it is a time, as time."""
    modes = detect_sync_modes(columns_of(tables, schema_name))
    newest = None
    for name, df in sorted(tables.items()):
        column = bookmark_column_of(df.columns)
        top = F.max(column) if column else F.lit(None)
        timed = column and isinstance(df.schema[column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType))
        moment = top.try_cast("timestamp_ntz") if timed else F.lit(None).cast("timestamp_ntz")
        part = df.agg(F.count("*").alias("row_count"), moment.alias("newest"), top.cast("string").alias("newest_value")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(len(df.columns)).cast("bigint").alias("column_count"), "newest", "newest_value"
        )
        newest = part if newest is None else newest.unionByName(part)
    return modes.join(newest, "table_name")


def bookmark_column_of(columns: list[str]) -> str | None:
    """First change column in column order, else the creation column."""
    changed = [c for c in columns if c.lower() in CHANGE_COLUMNS]
    created = [c for c in columns if c.lower() == CREATED_COLUMN]
    return (changed + created + [None])[0]


def parse_table_filter(text: str) -> tuple[list[str], list[str]]:
    """Include and exclude globs of ``"a*, +b, -c"``."""
    words = [w.strip() for w in text.split(",") if w.strip()]
    return [w.removeprefix("+") for w in words if not w.startswith("-")], [w[1:] for w in words if w.startswith("-")]


def glob_pattern(glob: str) -> str:
    """Regular expression of a ``*``/``?`` glob, for both Spark and Java."""
    parts = {"*": ".*", "?": "."}
    return "^" + "".join(parts.get(ch, re.escape(ch)) for ch in glob) + "$"


def matches_globs(name: Column, include: list[str], exclude: list[str]) -> Column:
    """In any include glob (or none given) and in no exclude glob."""
    def any_of(globs):
        return name.rlike("|".join(f"(?:{glob_pattern(g)})" for g in globs))

    wanted = any_of(include) if include else F.lit(True)
    return wanted & ~any_of(exclude) if exclude else wanted


# Type ladder of document values.
KINDS = ("timestamp", "boolean", "bigint", "double", "json", "varchar(48)", "binary", "text")
#: How JSON text writes values that JSON has no type for: an object with just this one key.
WRAPPED = {
    "$date": "timestamp", "$timestamp": "timestamp", "$numberInt": "bigint", "$numberLong": "bigint", "$numberDouble": "double", "$numberDecimal": "double",
    "$oid": "varchar(48)", "$binary": "binary", "$uuid": "binary",
}


def document_kinds(fields: DataFrame) -> DataFrame:
    """``column_name, kind`` of ``key, value`` rows: the kind of a VARIANT is that of its type, never of how its text looks; NULL for a null."""
    keys = F.when(F.col("shape").startswith("OBJECT<`$"), F.json_object_keys(F.to_json("value")))
    shaped = fields.select("key", "value", F.schema_of_variant("value").alias("shape"))
    wrapped = F.create_map(*[F.lit(x) for pair in WRAPPED.items() for x in pair])
    wrapped = shaped.select("key", "shape", F.when(F.size(keys) == 1, F.try_element_at(wrapped, keys[0])).alias("wrapped"))
    shape = F.col("shape")
    kind = (
        F.when(shape == "VOID", None)
        .when(F.col("wrapped").isNotNull(), F.col("wrapped"))
        .when(shape.isin("TIMESTAMP", "TIMESTAMP_NTZ", "DATE"), "timestamp")
        .when(shape == "BOOLEAN", "boolean")
        .when(shape == "BIGINT", "bigint")
        .when(shape.isin("DOUBLE", "FLOAT") | shape.startswith("DECIMAL"), "double")
        .when(shape.startswith("OBJECT<") | shape.startswith("ARRAY<"), "json")
        .when(shape == "BINARY", "binary")
        .otherwise("text")
    )
    return wrapped.select(F.col("key").alias("column_name"), kind.alias("kind"))


def infer_document_types(df: DataFrame, column: str, id_column: str = "_id") -> DataFrame:
    """:func:`infer_document_columns` with the id as it is held in a target: text of bounded length."""
    found = infer_document_columns(df, column, id_column)
    return found.withColumn("type", F.when(F.col("pk"), "varchar(48)").otherwise(F.col("type")))


def infer_document_columns(df: DataFrame, column: str, id_column: str = "_id") -> DataFrame:
    """Name and type of every top-level field over all documents, which are JSON text or VARIANT.

    Looks at the whole collection in one aggregation by field name: field names are few, so partial aggregation leaves almost nothing to
    shuffle. A field seen as both bigint and double is double; other mixes are text. Nulls count for no kind; a field of nulls alone is
    ``null``. Text that is no JSON object has no fields. The id is the key and never null.
    """
    document = F.col(column) if isinstance(df.schema[column].dataType, T.VariantType) else F.try_parse_json(F.col(column))
    fields = df.select(document.alias("_document")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_document").outer()))
    fields = document_kinds(fields.where(F.col("key").isNotNull()).select("key", "value"))
    seen = {k: F.count_if(F.col("kind") == k) > 0 for k in KINDS}
    kinds = sum((c.cast("int") for c in seen.values()), F.lit(0))
    one = F.coalesce(*[F.when(c, k) for k, c in seen.items()])
    numeric = seen["bigint"] & seen["double"] & (kinds == 2)
    typed = fields.groupBy("column_name").agg(
        F.when(kinds == 0, "null").when(numeric, "double").when(kinds == 1, one).otherwise("text").alias("type")
    )
    is_id = F.col("column_name") == id_column
    return typed.select("*", (~is_id).alias("nullable"), is_id.alias("pk"))


def infer_struct(df: DataFrame, column: str) -> T.StructType:
    """Spark's own schema inference over all documents of a JSON text column."""
    rows = df.agg(F.schema_of_variant_agg(F.try_parse_json(F.col(column))).alias("ddl")).collect()
    ddl = rows[0]["ddl"].replace("OBJECT<", "STRUCT<")
    return T.DataType.fromDDL(ddl)


def new_columns(source: DataFrame, target: DataFrame) -> DataFrame:
    """Catalogue rows of source columns the target lacks, ignoring case.

    Both arguments are catalogue frames; bookkeeping columns (``_`` first) of
    either side do not count.
    """
    def keyed(df):
        return df.where(~F.col("column_name").startswith("_")).withColumn("_key", F.lower("column_name"))

    return keyed(source).join(keyed(target).select("table_name", "_key"), ["table_name", "_key"], "left_anti").drop("_key")
