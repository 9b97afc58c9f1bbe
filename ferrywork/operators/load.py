"""Landing raw rows and shaping typed rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ferrywork.functions.names import safe_name
from ferrywork.operators.merge import latest_per_key, newest_first
from ferrywork.sources import folders

RUN_ID, SYNCED_AT = "_run_id", "_synced_at"

# Fixed value: how long raw rows are kept.
RAW_TTL_DAYS = 7


# NULLs stay, and times keep their microseconds; readers take any number of digits.
JSON_OPTIONS = {
    "ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def json_row(df: DataFrame) -> Column:
    """The whole row as JSON text, NULLs kept, times to the microsecond."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), JSON_OPTIONS)


def raw_rows(df: DataFrame, run_id: str, extracted_at: Column, beside: list[str] | None = None) -> DataFrame:
    """Raw landing rows: run, time, JSON text and its SHA-256; columns ``beside`` stay out of the text."""
    beside = beside or []
    data = df.select(F.lit(run_id).alias(RUN_ID), extracted_at.alias("_extracted_at"), json_row(df.drop(*beside)).alias("_data"), *beside)
    return data.withColumn("_hash", F.sha2("_data", 256))


def raw_table_name(source: str, table: str) -> str:
    return f"{safe_name(source)}_{safe_name(table)}_raw"


def write_raw(rows: DataFrame, path: str, run_id: str, day: date, owner: str = "") -> str:
    """Write one run's raw rows to a folder of its own; returns the folder.

    Days are the outer folders, so expiry drops whole days; a run that is
    repeated replaces its rows, but not those of another ``owner`` (pipeline and table) with that run id.
    """
    folder = f"{path}/_day={day:%Y-%m-%d}/of_owner={folders.file_name(owner or '-')}/of_run={folders.file_name(run_id)}"
    rows.write.mode("overwrite").parquet(folder)
    return folder


def live_raw_rows(rows: DataFrame, as_of: Column, moment: str = "_extracted_at", days: int = RAW_TTL_DAYS) -> DataFrame:
    """Raw rows whose hour is younger than ``days``.

    The bound is moved to the literal side so it prunes partitions and row
    groups: ``hour(t) + days > as_of`` holds exactly from the first whole hour
    after ``as_of - days``.
    """
    edge = (as_of - F.make_dt_interval(F.lit(days))).cast("timestamp")
    first_hour = F.date_trunc("hour", edge) + F.make_dt_interval(F.lit(0), F.lit(1))
    column_type = rows.schema[moment].dataType
    return rows.where(F.col(moment) >= first_hour.cast(column_type))


def expire_raw(spark: SparkSession, path: str, as_of, days: int = RAW_TTL_DAYS) -> list[str]:
    """Remove whole days of raw rows that are past their time; returns the days."""
    last_kept = f"{as_of - timedelta(days=days):%Y-%m-%d}"
    names = [n for n in folders.child_names(spark, path) if n.startswith("_day=") and n[5:] < last_kept]
    for name in names:
        folders.remove(spark, f"{path}/{name}")
    return [n[5:] for n in names]


def dedup_by_hash(df: DataFrame, columns: list[str], keep_first: list[str]) -> DataFrame:
    """One row per equal content of ``columns``, the first by ``keep_first``; adds ``_hash``."""
    hashed = df.withColumn("_hash", F.sha2(F.to_json(F.struct(*columns), JSON_OPTIONS), 256))
    return latest_per_key(hashed, ["_hash"], [F.col(c).asc() for c in keep_first])


def parse_raw(rows: DataFrame, schema: T.StructType | str, beside: list[str] | None = None) -> DataFrame:
    """Typed rows read back from the raw landing table, with their run and time."""
    kept = [RUN_ID, "_extracted_at", *(beside or [])]
    return rows.select(*kept, F.from_json("_data", schema).alias("_row")).select(*kept, "_row.*")


def replay_raw(rows: DataFrame, schema: T.StructType | str, keys: list[str], version: str) -> DataFrame:
    """Typed table rebuilt from raw rows: the newest version per key."""
    typed = parse_raw(rows, schema)
    return latest_per_key(typed, keys, newest_first(version, "_extracted_at", RUN_ID)).drop("_extracted_at", RUN_ID)


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` by name; missing ones are NULL, misfits become NULL."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in schema.fields:
        name = have.get(f.name.lower())
        col = F.lit(None).cast(f.dataType) if name is None else F.col(f"`{name}`")
        if name is not None and df.schema[name].dataType != f.dataType:
            col = col.try_cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(out)


def stamp(df: DataFrame, run_id: str, synced_at: Column) -> DataFrame:
    return df.withColumns({RUN_ID: F.lit(run_id), SYNCED_AT: synced_at})


def evolve(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Target plus rows; columns new in ``rows`` are NULL in the old rows."""
    return target.unionByName(rows, allowMissingColumns=True)


def ensure_table(spark: SparkSession, database: str, table: str, schema: T.StructType, path: str | None = None) -> str:
    """Create database and typed table if absent, with run id and sync time columns."""
    full = schema.add(RUN_ID, T.StringType()).add(SYNCED_AT, T.TimestampType()) if RUN_ID not in schema.names else schema
    name = f"`{safe_name(database)}`.`{safe_name(table)}`"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}{'' if f.nullable else ' NOT NULL'}" for f in full.fields)
    location = f" LOCATION '{path}'" if path else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{safe_name(database)}`")
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet{location}")
    return name


def add_columns(spark: SparkSession, table: str, schema: T.StructType) -> list[str]:
    """Add the columns of ``schema`` the table lacks; returns their names."""
    have = {c.lower() for c in spark.table(table).columns}
    fresh = [f for f in schema.fields if f.name.lower() not in have]
    if fresh:
        spec = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fresh)
        spark.sql(f"ALTER TABLE {table} ADD COLUMNS ({spec})")
    return [f.name for f in fresh]
