"""Bookmarks: the last value synced of each table's change column.

State is an append-only log of ``(pipeline_id, source_table, ...)`` rows, the
newest row per table being the bookmark. Values are text and are cast to the
column's type when they are used. One row per table and run keeps it small.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ferrywork.operators.merge import latest_per_key, newest_first
from ferrywork.sources import folders
from ferrywork.sources.folders import file_name

BOOKMARK_SCHEMA = (
    "pipeline_id string, source_table string, bookmark_column string, bookmark_value string, "
    "row_count bigint, last_run_id string, last_synced_at timestamp"
)
KEY = ["pipeline_id", "source_table"]


def current_bookmarks(log: DataFrame) -> DataFrame:
    """Newest state row per table; a reset leaves a row without a value."""
    return latest_per_key(log, KEY, newest_first("last_synced_at", "last_run_id"))


def upsert_bookmarks(state: DataFrame, updates: DataFrame) -> DataFrame:
    return current_bookmarks(state.unionByName(updates))


def list_bookmarks(log: DataFrame) -> DataFrame:
    return current_bookmarks(log).where(F.col("bookmark_value").isNotNull()).orderBy(*KEY)


def bookmark_after(loaded: DataFrame, column: str) -> DataFrame:
    """One row: greatest loaded value as text, and how many rows were loaded."""
    return loaded.agg(F.max(column).cast("string").alias("bookmark_value"), F.count("*").alias("row_count"))


def reset_rows(bookmarks: DataFrame, chosen: Column, at: Column) -> DataFrame:
    """State rows that clear the chosen bookmarks: the next run is a full load."""
    return bookmarks.where(chosen).withColumns(
        {"bookmark_value": F.lit(None).cast("string"), "row_count": F.lit(0).cast("bigint"), "last_synced_at": at}
    )


def backfill_rows(bookmarks: DataFrame, chosen: Column, value: str, at: Column) -> DataFrame:
    """State rows that move the chosen bookmarks to ``value``: the next run starts past it."""
    return bookmarks.where(chosen).withColumns({"bookmark_value": F.lit(value), "last_synced_at": at})


class BookmarkStore:
    """Bookmarks as small JSON files, ``<pipeline>/<table>/<time>.<run>.json``.

    The newest readable file counts, so a write that died midway is ignored,
    and a run that is repeated writes its own file again. No Spark job is
    needed to look up or move one bookmark.
    """

    def __init__(self, spark: SparkSession, path: str, history: int = 10):
        self.spark, self.path, self.history = spark, path, history

    def _folder(self, pipeline_id: str, source_table: str) -> str:
        return f"{self.path}/{file_name(pipeline_id)}/{file_name(source_table)}"

    def log(self) -> DataFrame:
        """All kept state rows, for :func:`current_bookmarks` and :func:`list_bookmarks`."""
        if not folders.exists(self.spark, self.path):
            return self.spark.createDataFrame([], BOOKMARK_SCHEMA)
        return self.spark.read.schema(BOOKMARK_SCHEMA).json(f"{self.path}/*/*/*.json")

    def newest(self, pipeline_id: str, source_table: str) -> dict | None:
        folder = self._folder(pipeline_id, source_table)
        for name in reversed(folders.child_names(self.spark, folder)):
            try:
                return json.loads(folders.read_text(self.spark, f"{folder}/{name}"))
            except ValueError:
                continue
        return None

    def get(self, pipeline_id: str, source_table: str) -> str | None:
        row = self.newest(pipeline_id, source_table)
        return row["bookmark_value"] if row else None

    def put(self, pipeline_id, source_table, column, value, row_count, run_id, at) -> None:
        folder = self._folder(pipeline_id, source_table)
        row = {
            "pipeline_id": pipeline_id, "source_table": source_table, "bookmark_column": column, "bookmark_value": value,
            "row_count": row_count, "last_run_id": run_id, "last_synced_at": at.isoformat(),
        }
        folders.write_text(self.spark, f"{folder}/{at:%Y%m%dT%H%M%S%f}.{file_name(run_id)}.json", json.dumps(row) + "\n")
        for name in folders.child_names(self.spark, folder)[: -self.history]:
            folders.remove(self.spark, f"{folder}/{name}")

    def reset(self, pipeline_id, source_table, run_id, at) -> None:
        """The next run of this table is a full load."""
        self.put(pipeline_id, source_table, None, None, 0, run_id, at)

    def backfill(self, pipeline_id, source_table, column, value, run_id, at) -> None:
        """The next run of this table starts past ``value``."""
        self.put(pipeline_id, source_table, column, value, 0, run_id, at)

