"""A pipeline run: every table scanned past its bookmark, transformed and loaded.

Per table scan, transforms, checks, counts and soft deletes are one write job.
The order of effects makes a crash harmless: batch files, dead letters, commit
marker (which carries the bookmark), bookmark. A run that is repeated after its
commit writes nothing again.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ferrywork.functions.names import safe_name
from ferrywork.operators import alerts, deadletter, load, quality, runlog
from ferrywork.operators.state import BookmarkStore
from ferrywork.operators.targets import DELETE, OP, RESCUED, UPSERT, TargetTable, landed, rescue
from ferrywork.operators.transforms import apply_steps, noted, row_before
from ferrywork.sources import folders
from ferrywork.sources.catalog import bookmark_column_of, matches_globs, parse_table_filter
from ferrywork.sources.folders import file_name
from ferrywork.sources.scans import DELETED_COLUMN, bookmark_literal, cut_rows, find_column, incremental_rows, live_rows, soft_deleted_rows

log = logging.getLogger(__name__)

INCREMENTAL, FULL_REFRESH = "incremental", "full_refresh"

RUNS = (
    "id string, pipeline_id string, status string, started_at timestamp, finished_at timestamp, duration_ms bigint, "
    "rows_synced bigint, trigger_type string, error_message string"
)
STATS = (
    "run_id string, table_name string, status string, rows_extracted bigint, rows_loaded_raw bigint, rows_loaded_analytics bigint, "
    "rows_failed bigint, rows_deleted bigint, bookmark_before string, bookmark_after string, "
    "new_columns string, quality_passed boolean, duration_ms bigint, error_message string, pipeline_id string, rows_folded bigint"
)
LINES = "id string, run_id string, pipeline_id string, timestamp timestamp, level string, message string"
SEEN_COLUMNS = "pipeline_id string, table_name string, seen_at timestamp, columns string"



@dataclass(frozen=True)
class SyncTable:
    """How one table is synced. ``keys`` are target columns; ``source_keys`` default to them.

    Of several rows with one key the newest is kept; with ``reject_duplicates``
    the first is kept and the others become dead letters.
    """

    source_table: str
    keys: tuple[str, ...] = ()
    source_keys: tuple[str, ...] | None = None
    target_table: str | None = None
    target_schema: str | None = None
    sync_mode: str = INCREMENTAL
    load_mode: str = "direct"
    bookmark_column: str | None = None
    deleted_column: str = DELETED_COLUMN
    transforms: tuple[dict, ...] = ()
    required: tuple[str, ...] = ()
    max_rows: int | None = None
    lookback: str | None = None
    auto_evolve: bool = False
    include_touched: bool = True
    reject_duplicates: bool = False
    enabled: bool = True
    buckets: int | None = None

    def __post_init__(self):
        if self.lookback and not self.keys and self.sync_mode != FULL_REFRESH:
            raise ValueError(f"{self.source_table}: lookback reads rows again, which needs keys to merge them")


@dataclass(frozen=True)
class Pipeline:
    id: str
    source_name: str
    tables: tuple[SyncTable, ...]
    name: str = ""
    depends_on: str | None = None
    quality_threshold: float = quality.DEFAULT_THRESHOLD_PCT
    target_schema: str | None = None

    def schema_of(self, table: SyncTable) -> str:
        """Folder of a table's target; by default each pipeline has one of its own."""
        return table.target_schema or self.target_schema or f"{self.source_name}.{self.id}"


@dataclass
class TableResult:
    table: str
    status: str = "success"
    rows_extracted: int = 0
    rows_raw: int = 0
    rows_loaded: int = 0
    rows_failed: int = 0
    rows_deleted: int = 0
    rows_folded: int = 0
    bookmark_before: str | None = None
    bookmark_after: str | None = None
    new_columns: list[str] = field(default_factory=list)
    quality_passed: bool = True
    duration_ms: int = 0
    error: str | None = None


@dataclass
class RunResult:
    """``status`` tells whether the run came to its end; ``outcome`` looks at the tables.

    The run log has a run as failed where every table of it failed.
    """

    run_id: str
    status: str
    tables: list[TableResult]
    reason: str | None = None

    @property
    def rows_synced(self) -> int:
        return sum(t.rows_loaded for t in self.tables)

    @property
    def outcome(self) -> str:
        failed = sum(t.status == "failed" for t in self.tables)
        return "success" if not failed else "failed" if failed == len(self.tables) else "partial"


def run_file(pipeline_id: str, run_id: str) -> str:
    """Run ids are the caller's, so two pipelines may have the same."""
    return f"{file_name(pipeline_id)}.{file_name(run_id)}"


class Workspace:
    """Folders of one deployment: targets, raw zone, state and logs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.bookmarks = BookmarkStore(spark, f"{self.root}/state/bookmarks")

    def target(self, table: SyncTable, bookmark_column: str | None = None, pipeline: Pipeline | None = None) -> TargetTable:
        """The target of a pipeline's table; without a pipeline, of the only schema that holds a table of this name."""
        name, root = table.target_table or table.source_table, f"{self.root}/targets"
        if pipeline:
            schema, owner = file_name(pipeline.schema_of(table)), f"{pipeline.id}/{table.source_table}"
        else:
            schemas = [s for s in folders.child_names(self.spark, root) if folders.exists(self.spark, f"{root}/{s}/{safe_name(name)}")]
            if len(schemas) > 1:
                raise LookupError(f"{name} is in the schemas {schemas}; name the pipeline")
            schema, owner = (schemas or ["default"])[0], None
        return TargetTable(self.spark, f"{root}/{schema}", name, list(table.keys), bookmark_column, table.buckets, owner=owner)

    def staging_path(self, target: TargetTable) -> str:
        return f"{self.root}/staging/{target.path.removeprefix(self.root).removeprefix('/targets/')}"

    def raw_path(self, source: str, table: str) -> str:
        return f"{self.root}/raw/{load.raw_table_name(source, table)}"

    def log_path(self, name: str) -> str:
        return f"{self.root}/logs/{name}"

    def write_log(self, name: str, key: str, lines: list[str]) -> None:
        """A few JSON lines about one run; writing them again replaces them."""
        folders.write_text(self.spark, f"{self.log_path(name)}/{key}.json", "".join(f"{x}\n" for x in lines))

    def read_log(self, name: str, schema: str) -> DataFrame:
        path = self.log_path(name)
        if not folders.exists(self.spark, path):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(path)

    def prune_logs(self, as_of: datetime, days: int = 90) -> int:
        """Remove the log files of runs past their time; returns how many runs went."""
        runs, key = self.read_log("runs", RUNS), ["pipeline_id", "id"]
        old = runs.join(runlog.retained_runs(runs, as_of.isoformat(), days).select(key), key, "left_anti").select(key)
        gone = 0
        for row in old.toLocalIterator():
            for name in ("run_table_stats", "run_logs", "runs"):
                folders.remove(self.spark, f"{self.log_path(name)}/{run_file(row['pipeline_id'], row['id'])}.json")
            gone += 1
        return gone

    def write_dead_letters(self, letters: DataFrame, pipeline: Pipeline, table: str, run_id: str) -> None:
        """One folder per pipeline, table and run, so that a repeated run replaces its own."""
        path = f"{self.log_path('dead_letters')}/of_pipeline={file_name(pipeline.id)}/of_table={file_name(table)}/of_run={file_name(run_id)}"
        letters.write.mode("overwrite").parquet(path)

    def letter_states(self) -> TargetTable:
        """What became of letters that were tried again, by letter id."""
        return TargetTable(self.spark, f"{self.root}/state", "letters", ["id"])

    def schema_versions(self) -> DataFrame:
        """Column lists that each pipeline's targets have had, numbered."""
        return quality.schema_versions(self.read_log("schemas", SEEN_COLUMNS))

    def dead_letters(self) -> DataFrame:
        """All letters, each with its last outcome: a letter that passed is ``reprocessed``, one that failed again has its newest error."""
        letters = self.spark.read.parquet(self.log_path("dead_letters")).drop("of_pipeline", "of_table", "of_run")
        states = self.letter_states()
        if states.version() is None:
            return letters
        known = states.read().select("id", F.col("reprocessed").alias("_passed"), "last_type", "last_text")
        failed_again = F.col("_passed").isNotNull() & ~F.col("_passed")
        newest = {c: F.when(failed_again, F.col(last)).otherwise(F.col(c)) for c, last in (("error_type", "last_type"), ("error_text", "last_text"))}
        passed = F.coalesce("_passed", F.lit(False))
        return letters.join(known, "id", "left").withColumns({"reprocessed": passed, **newest}).select(letters.columns)


def pick_bookmark_column(table: SyncTable, source: DataFrame) -> str | None:
    """The configured column, else the first change column, else the creation column."""
    if table.bookmark_column:
        return find_column(source, table.bookmark_column)
    return bookmark_column_of(source.columns)


def tables_from(discovered: DataFrame, keys: dict[str, tuple[str, ...]] | None = None, table_filter: str = "") -> tuple[SyncTable, ...]:
    """Sync settings for the tables of a ``catalog.discover`` frame that pass the filter."""
    include, exclude = parse_table_filter(table_filter)
    wanted = discovered.where(matches_globs(F.col("table_name"), include, exclude)).orderBy("table_name")
    return tuple(
        SyncTable(
            row["table_name"], keys=tuple((keys or {}).get(row["table_name"], ())), sync_mode=row["sync_mode"],
            bookmark_column=row["bookmark_column"], deleted_column=row["deleted_at_column"] or DELETED_COLUMN,
        )
        for row in wanted.collect()
    )


def conform(rows: DataFrame, known, rejects: str) -> DataFrame:
    """Columns the target already has take its types; misfits are named in ``rejects``."""
    types = {f.name: f.dataType for f in known.fields}
    casts = {n: F.col(f"`{n}`").try_cast(t) for n, t in types.items() if n in rows.columns and rows.schema[n].dataType != t}
    if not casts:
        return rows
    return noted(rows, casts, {n: F.col(f"`{n}`").isNotNull() & c.isNull() for n, c in casts.items()}, rejects)


def sync_table(ws: Workspace, pipeline: Pipeline, table: SyncTable, source: DataFrame, run_id: str, as_of: datetime, scripts=None) -> TableResult:
    spark, result = ws.spark, TableResult(table.source_table)
    full = table.sync_mode == FULL_REFRESH
    bookmark_column = pick_bookmark_column(table, source)
    target = ws.target(table, bookmark_column, pipeline)
    _recover_bookmark(ws, pipeline, table, target)
    done = target.commit_of(run_id)
    if done:
        result.rows_loaded = done.get("rows") or 0
        result.bookmark_before, result.bookmark_after = (done.get("bookmark") or {}).get("before"), (done.get("bookmark") or {}).get("after")
        return result
    bookmark = None if full else ws.bookmarks.get(pipeline.id, table.source_table)
    result.bookmark_before = bookmark

    rows = live_rows(source, table.deleted_column) if full else incremental_rows(
        source, bookmark_column, bookmark, table.deleted_column, table.lookback
    )
    if table.max_rows and bookmark_column and not full:
        rows = cut_rows(rows, bookmark_column, table.max_rows, unordered=bookmark is None)

    extracted = Observation()
    top = F.max(bookmark_column).cast("string") if bookmark_column else F.lit(None).cast("string")
    rows = rows.observe(extracted, F.count("*").alias("n"), top.alias("top"))
    rows = apply_steps(rows, table.transforms, scripts, rejects="_casts")

    stamp = F.lit(as_of).cast("timestamp")
    known = target.schema()
    if table.load_mode == "raw":
        # The typed load reads this run's raw rows back, not the source again.
        path = ws.raw_path(pipeline.source_name, table.source_table)
        landed = Observation()
        beside = [c for c in ("_casts", row_before("_casts")) if c in rows.columns]
        raw = load.raw_rows(rows, run_id, stamp, beside).observe(landed, F.count("*").alias("n"))
        mine = spark.read.parquet(load.write_raw(raw, path, run_id, as_of.date(), f"{pipeline.id}/{table.source_table}"))
        result.rows_raw = landed.get["n"]
        rows = load.parse_raw(mine, rows.drop(*beside).schema, beside).drop(load.RUN_ID, "_extracted_at")

    if known is not None and known.fields:
        kept = {f.name.lower() for f in known.fields}
        result.new_columns = [c for c in rows.columns if c.lower() not in kept and not c.startswith("_")]
        if result.new_columns and not table.auto_evolve and not full:
            rows = rescue(rows, result.new_columns)
        if not full:
            rows = conform(rows, known, "_casts")

    required = list(dict.fromkeys([*table.keys, *table.required]))
    checked = deadletter.row_errors(load.stamp(rows, run_id, stamp), required, "_casts")
    if table.reject_duplicates and table.keys:
        # Looked at several times, so the rows are written first and not read from the source again.
        staged = f"{ws.staging_path(target)}-checked"
        checked.write.mode("overwrite").parquet(staged)
        checked = deadletter.mark_duplicates(spark.read.schema(checked.schema).parquet(staged), list(table.keys), [bookmark_column] if bookmark_column in checked.columns else [])
    good = F.col(deadletter.ERROR_TYPE).isNull()
    counted = Observation()
    nulls = [F.count_if(good & F.col(f"`{c}`").isNull()).alias(f"nulls_{c}") for c in required if c in checked.columns]
    checked = checked.observe(counted, F.count("*").alias("n"), F.count_if(good).alias("good"), *nulls)

    deleted = None
    if full:
        written = _stage(ws, target, checked, run_id)
    else:
        if bookmark is not None and table.keys and find_column(source, table.deleted_column):
            deleted = Observation()
            seen = target.last_fact("deleted")
            gone = deleted_keys(source, table, bookmark, bookmark_column, seen and seen["deleted"], deleted, stamp)
            checked = checked.withColumn(OP, F.lit(UPSERT)).unionByName(gone.withColumn(OP, F.lit(DELETE)), allowMissingColumns=True)
        written = target.append(checked, run_id, rejected=F.col(deadletter.ERROR_TYPE).isNotNull())
    metrics = counted.get
    result.rows_extracted = extracted.get["n"]
    # What the files hold, not what was sent to them; rows of one key become one.
    found, result.rows_folded = written.landed()
    result.rows_loaded, result.rows_failed = found - result.rows_folded, metrics["n"] - metrics["good"]
    result.rows_deleted = deleted.get["n"] if deleted else 0
    if result.rows_failed:
        letters = deadletter.dead_letters(written.rejected_rows(), pipeline.source_name, table.source_table, run_id, stamp, pipeline_id=pipeline.id)
        ws.write_dead_letters(letters, pipeline, table.source_table, run_id)
    if result.rows_extracted or result.rows_deleted or full:  # an emptied source empties the target
        result.bookmark_after = extracted.get["top"]
        fact = None
        if result.bookmark_after is not None:
            fact = {"column": bookmark_column, "before": bookmark, "after": result.bookmark_after}
        written.commit(as_of.isoformat(), fact, result.rows_loaded + result.rows_deleted, deleted.get["top"] if deleted else None)
        _recover_bookmark(ws, pipeline, table, target)

        if known is None or result.new_columns:
            columns = ",".join(f.name for f in target.schema().fields if not f.name.startswith("_"))
            seen = {"pipeline_id": pipeline.id, "table_name": table.source_table, "seen_at": as_of.isoformat(), "columns": columns}
            ws.write_log("schemas", f"{run_file(pipeline.id, run_id)}.{file_name(table.source_table)}", [json.dumps(seen)])

    names = [c for c in required if f"nulls_{c}" in metrics]
    counts = {"rows_extracted": metrics["n"], "rows_loaded": result.rows_loaded, "rows_folded": result.rows_folded}
    counts |= {f"nulls_{c}": metrics[f"nulls_{c}"] for c in names}
    fixed = {"pipeline_id": pipeline.id, "run_id": run_id, "table_name": table.source_table, "checked_at": as_of.isoformat()}
    verdicts = quality.checks_of_run(fixed | counts, names, pipeline.quality_threshold)
    ws.write_log("quality", f"{run_file(pipeline.id, run_id)}.{file_name(table.source_table)}", [json.dumps(v) for v in verdicts])
    result.quality_passed = all(v["passed"] for v in verdicts)
    target.compact_if_due()
    return result


def reprocess_letters(
    ws: Workspace, pipeline: Pipeline, table: SyncTable, run_id: str, as_of: datetime, steps=(), schema: T.StructType | str | None = None, scripts=None
) -> tuple[int, int]:
    """Try the waiting letters of a table again: repaired rows are merged into its target, and every letter tried gets its outcome.

    ``steps`` repair the rows, which have plain values as text unless ``schema`` says otherwise; then the target's types apply.  A repaired row does not
    replace one of its key with the same or a later change time, but its letter is done.  Returns how many letters passed and how many failed again.
    The step can be repeated with its ``run_id`` after a failure at any point: rows and outcomes are each committed once.
    """
    if not folders.exists(ws.spark, ws.log_path("dead_letters")):
        return 0, 0
    column = table.bookmark_column
    target, states = ws.target(table, column, pipeline), ws.letter_states()
    known = T.StructType([f for f in target.schema().fields if not f.name.startswith("_")])
    waiting = ws.dead_letters().where((F.col("pipeline_id") == pipeline.id) & (F.col("table_name") == table.source_table) & ~F.col("reprocessed"))
    nested = (T.StructType, T.ArrayType, T.MapType, T.VariantType)
    text = T.StructType([f if isinstance(f.dataType, nested) else T.StructField(f.name, T.StringType()) for f in known.fields])
    required = list(dict.fromkeys([*table.keys, *table.required]))
    tried = deadletter.reprocess(waiting, schema or text, steps, required, scripts, lambda rows: conform(rows, known, "_casts"), letter="_letter")
    path = f"{ws.staging_path(target)}-letters/{run_file(pipeline.id, run_id)}"
    if states.commit_of(run_id) is None:
        if target.commit_of(run_id) is None:
            tried.write.mode("overwrite").parquet(path)
            good = ws.spark.read.schema(tried.schema).parquet(path).where("reprocessed").drop("_letter", "reprocessed", deadletter.ERROR_TYPE, deadletter.ERROR_TEXT)
            if table.keys and column in good.columns:
                later = target.read().select(*table.keys, F.col(column).alias("_later"))
                good = good.join(later, list(table.keys), "left").where(F.col("_later").isNull() | (F.col("_later") < F.col(column))).drop("_later")
            batch = target.append(load.stamp(good, run_id, F.lit(as_of).cast("timestamp")), run_id)
            batch.commit(as_of.isoformat(), rows=batch.landed()[0])
        outcome = ws.spark.read.schema(tried.schema).parquet(path).select(
            F.col("_letter").alias("id"), "reprocessed", F.col(deadletter.ERROR_TYPE).alias("last_type"), F.col(deadletter.ERROR_TEXT).alias("last_text"),
            F.lit(run_id).alias("reprocessed_by"),
        )
        batch = states.append(outcome, run_id)
        batch.commit(as_of.isoformat(), rows=batch.landed()[0])
        states.compact_if_due()
    counted = states.read().where(F.col("reprocessed_by") == run_id).agg(F.count_if("reprocessed").alias("passed"), F.count_if(~F.col("reprocessed")).alias("failed")).first()
    return counted["passed"], counted["failed"]


def _recover_bookmark(ws: Workspace, pipeline: Pipeline, table: SyncTable, target: TargetTable) -> None:
    """Record the bookmark of the target's last commit, unless state has a later word."""
    fact = target.last_bookmark()
    known = ws.bookmarks.newest(pipeline.id, table.source_table)
    if fact and (known is None or known["last_synced_at"] < fact["at"]):
        mark = fact["bookmark"]
        ws.bookmarks.put(
            pipeline.id, table.source_table, mark["column"], mark["after"], fact.get("rows") or 0, fact["run_id"], datetime.fromisoformat(fact["at"])
        )


class _Staged:
    """Full refresh: the accepted part of the staged rows becomes the new base on commit."""

    def __init__(self, ws: Workspace, target: TargetTable, path: str, run_id: str):
        self.ws, self.target, self.path, self.run_id = ws, target, path, run_id

    def staged(self) -> DataFrame:
        return self.ws.spark.read.parquet(self.path)

    def rejected_rows(self) -> DataFrame:
        return self.staged().where(F.col(deadletter.ERROR_TYPE).isNotNull())

    def landed(self) -> tuple[int, int]:
        return landed(self.staged().where(F.col(deadletter.ERROR_TYPE).isNull()), self.target.keys)

    def commit(self, at: str, bookmark: dict | None, rows: int, deleted: str | None = None) -> None:
        good = self.staged().where(F.col(deadletter.ERROR_TYPE).isNull())
        self.target.replace(good.drop(deadletter.ERROR_TYPE, deadletter.ERROR_TEXT, deadletter.ERROR_ROW), self.run_id, at, bookmark)


def _stage(ws: Workspace, target: TargetTable, checked: DataFrame, run_id: str) -> _Staged:
    path = ws.staging_path(target)
    checked.write.mode("overwrite").parquet(path)
    return _Staged(ws, target, path, run_id)


def deleted_keys(
    source: DataFrame, table: SyncTable, bookmark, bookmark_column: str, seen: str | None, counted: Observation, as_of: Column
) -> DataFrame:
    """Target keys of the rows soft-deleted since the newest delete ``seen``, or else since the bookmark.

    ``counted`` observes their number and the newest delete of them; one dated past ``as_of`` is not taken
    as seen, or it would hide all deletes before it.  A bookmark that is no time cannot be compared with
    deletes: then all of them count until one was seen.
    """
    name = find_column(source, table.deleted_column)
    timed = bookmark_column and isinstance(source.schema[bookmark_column].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.StringType))
    if seen is None and not timed:
        gone = source.where(F.col(name).isNotNull())
    else:
        # The change column is only compared where the floor is the bookmark itself.
        touched = table.include_touched or seen is not None
        gone = soft_deleted_rows(source, seen or bookmark, bookmark_column, name, touched, table.lookback)
        if not table.include_touched and touched:
            floor = bookmark_literal(bookmark, source.schema[bookmark_column].dataType)
            gone = gone.where(F.col(bookmark_column).isNull() | (F.col(bookmark_column) <= floor))
    newest = F.max(F.when(F.col(name).cast("timestamp") <= as_of, F.col(name))).cast("string")
    gone = gone.observe(counted, F.count("*").alias("n"), newest.alias("top"))
    renames = [s for s in table.transforms if s.get("type") == "rename"]
    return apply_steps(gone.select(*(table.source_keys or table.keys)), renames).select(*table.keys)


def run_pipeline(
    ws: Workspace,
    pipeline: Pipeline,
    read_source: Callable[[str], DataFrame],
    run_id: str,
    as_of: datetime,
    scripts: dict | None = None,
    trigger: str = "manual",
    parallel_tables: int = 4,
) -> RunResult:
    """Sync every enabled table. A table that fails is logged and the others go on."""
    runs = ws.read_log("runs", RUNS)
    if pipeline.depends_on:
        known = ws.spark.createDataFrame(
            [(pipeline.id, pipeline.name or pipeline.id, pipeline.depends_on)], "id string, name string, depends_on string"
        )
        gate = runlog.dependency_gate(known, runs, exclude_run_id=run_id).first()
        if not gate["satisfied"]:
            return RunResult(run_id, "skipped", [], gate["reason"])

    def sync_one(table: SyncTable) -> TableResult:
        started = time.monotonic()
        try:
            result = sync_table(ws, pipeline, table, read_source(table.source_table), run_id, as_of, scripts)
        except Exception as exc:
            log.exception("table %s failed", table.source_table)
            result = TableResult(table.source_table, "failed", error=str(exc)[:500])
        result.duration_ms = int((time.monotonic() - started) * 1000)
        return result

    enabled = [t for t in pipeline.tables if t.enabled]
    # Small tables leave most of a cluster idle, so a few are synced side by side.
    with ThreadPoolExecutor(max_workers=max(1, min(len(enabled), parallel_tables))) as pool:
        results = list(pool.map(sync_one, enabled))
    outcome = RunResult(run_id, "success", results)
    write_run_log(ws, pipeline, outcome, as_of, trigger)
    return outcome


def run_alerts(ws: Workspace, run_id: str, pipeline_id: str | None = None) -> DataFrame:
    """Alert events of a logged run, of one pipeline or of each that has a run of this id; see ``alerts`` for routing and text."""
    stats = ws.read_log("run_table_stats", STATS).where(F.col("run_id") == run_id)
    if pipeline_id is not None:
        stats = stats.where(F.col("pipeline_id") == pipeline_id)
    return alerts.alert_events(stats.withColumns({"rows_synced": F.col("rows_loaded_analytics"), "passed": F.col("quality_passed")}))


def write_run_log(ws: Workspace, pipeline: Pipeline, outcome: RunResult, as_of: datetime, trigger: str) -> None:
    took = sum(t.duration_ms for t in outcome.tables)
    stats = [
        {
            "run_id": outcome.run_id, "table_name": t.table, "status": t.status, "rows_extracted": t.rows_extracted, "rows_loaded_raw": t.rows_raw,
            "rows_loaded_analytics": t.rows_loaded, "rows_failed": t.rows_failed, "rows_deleted": t.rows_deleted,
            "bookmark_before": t.bookmark_before, "bookmark_after": t.bookmark_after, "new_columns": ", ".join(t.new_columns),
            "quality_passed": t.quality_passed, "duration_ms": t.duration_ms, "error_message": t.error, "pipeline_id": pipeline.id, "rows_folded": t.rows_folded,
        }
        for t in outcome.tables
    ]
    run = {
        "id": outcome.run_id, "pipeline_id": pipeline.id,
        "status": runlog.FAILED if outcome.outcome == "failed" else outcome.status, "started_at": as_of.isoformat(),
        "finished_at": (as_of + timedelta(milliseconds=took)).isoformat(), "duration_ms": took, "rows_synced": outcome.rows_synced,
        "trigger_type": trigger, "error_message": "; ".join(f"{t.table}: {t.error}" for t in outcome.tables if t.error) or None,
    }
    key, seen_at = run_file(pipeline.id, outcome.run_id), as_of.isoformat()
    ws.write_log("run_table_stats", key, [json.dumps(s) for s in stats])
    lines = [
        {"id": f"{key}.{n:04d}", "run_id": outcome.run_id, "pipeline_id": pipeline.id, "timestamp": seen_at, "level": level, "message": message}
        for n, (level, message) in enumerate(run_lines(outcome, run["status"], took))
    ]
    ws.write_log("run_logs", key, [json.dumps(x) for x in lines])
    ws.write_log("runs", key, [json.dumps(run)])


def run_lines(outcome: RunResult, status: str, took: int) -> list[tuple[str, str]]:
    """Level and text of what a run did, in order."""
    lines = [("INFO", f"run started: {len(outcome.tables)} tables")]
    for t in outcome.tables:
        if t.error:
            lines.append(("ERROR", f"{t.table}: {t.error}"))
            continue
        lines.append(("INFO", f"{t.table}: {t.rows_extracted} extracted, {t.rows_loaded} loaded, {t.rows_deleted} deleted, bookmark {t.bookmark_after or t.bookmark_before}"))
        if t.new_columns:
            lines.append(("WARNING", f"{t.table}: new columns {', '.join(t.new_columns)}"))
        if t.rows_failed:
            lines.append(("WARNING", f"{t.table}: {t.rows_failed} rows rejected"))
        if not t.quality_passed:
            lines.append(("WARNING", f"{t.table}: quality check failed"))
    return [*lines, ("ERROR" if status == runlog.FAILED else "INFO", f"run ended: {status}, {outcome.rows_synced} rows in {took} ms")]
