"""The same loads as Structured Streaming jobs.

The stream's checkpoint takes the place of the bookmark. Every micro-batch is
one change batch of the target, named by the checkpoint's own id and its number,
so a batch that Spark runs again after its commit is left out, and one of a new
checkpoint is not.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ferrywork.operators import deadletter, load
from ferrywork.operators.merge import has_key, latest_per_key, row_hash
from ferrywork.operators.targets import DELETE, OP, UPSERT, TargetTable
from ferrywork.operators.transforms import apply_steps
from ferrywork.sources import folders


def file_stream(spark: SparkSession, folder: str, pattern: str, schema: T.StructType, file_format: str = "parquet", files_per_batch: int = 1_000) -> DataFrame:
    """New files of a folder, a bounded number per micro-batch."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
    return reader.format(file_format).load(folder)


def stream_sync(
    stream: DataFrame,
    target: TargetTable,
    name: str,
    checkpoint: str,
    transforms: list[dict] | None = None,
    required: list[str] | None = None,
    output_mode: str = "append",
    scripts: dict | None = None,
    deleted_column: str | None = None,
    letters: str | None = None,
) -> StreamingQuery:
    """Load everything that is available, then stop.

    Rows with a value in ``deleted_column`` delete their key. Rejected rows
    become dead letters below ``letters``, a folder beside the target by default.
    """
    letters = letters or dead_letter_folder(target)
    needed = list(dict.fromkeys([*target.keys, *(required or [])]))

    def load_batch(batch: DataFrame, number: int) -> None:
        run_id = batch_run_id(target.spark, name, checkpoint, number)
        if target.commit_of(run_id):
            return
        rows = apply_steps(batch, transforms, scripts, rejects="_casts")
        checked = deadletter.row_errors(load.stamp(rows, run_id, F.current_timestamp()), needed, "_casts")
        if deleted_column:
            gone = F.col(deleted_column).isNotNull()
            checked = checked.withColumn(OP, F.when(gone, DELETE).otherwise(UPSERT))
        bad, counted = F.col(deadletter.ERROR_TYPE).isNotNull(), Observation()
        checked = checked.observe(counted, F.count("*").alias("n"), F.count_if(bad).alias("bad"))
        written = target.append(checked, run_id, rejected=bad)
        if counted.get["bad"]:
            found = deadletter.dead_letters(written.rejected_rows(), name, name, run_id, F.current_timestamp())
            found.write.mode("overwrite").parquet(f"{letters}/of_run={folders.file_name(run_id)}")
        written.commit(rows=counted.get["n"] - counted.get["bad"])
        target.compact_if_due()

    return (
        stream.writeStream.queryName(name)
        .outputMode(output_mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(load_batch)
        .start()
    )


def dead_letter_folder(target: TargetTable) -> str:
    return f"{target.path}_dead_letters"


def batch_run_id(spark: SparkSession, name: str, checkpoint: str, number: int) -> str:
    """Name of a micro-batch that no other checkpoint shares."""
    return f"{name}-{json.loads(folders.read_text(spark, f'{checkpoint}/metadata'))['id']}-{number}"


def _each_batch(stream: DataFrame, name: str, checkpoint: str, load_batch) -> StreamingQuery:
    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(load_batch).start()


def stream_unique(stream: DataFrame, target: TargetTable, name: str, checkpoint: str, time_column: str, delay: str = "1 day") -> StreamingQuery:
    """Load the first row of each key, in whatever order rows come; every row is accounted for.

    The target itself is the state: a row whose key it holds is a repeat.  So nothing is dropped for being late; rows that lie ``delay`` behind the newest
    time before their batch are loaded like others and counted.  Rows without a key become dead letters beside the target.  ``target.facts("counts")`` has the
    figures of the micro-batches since the last compaction: ``rows`` are those ``loaded``, the ``repeats`` and the ``keyless`` ones together; ``late`` ones
    are among them.  The last one also has ``all``, the sums over all micro-batches.
    """

    def load_batch(batch: DataFrame, number: int) -> None:
        run_id = batch_run_id(target.spark, name, checkpoint, number)
        if target.commit_of(run_id):
            return
        before = target.last_fact("counts")
        newest = before["counts"]["newest"] if before else None
        moment = F.col(time_column).cast("timestamp")
        late = moment < F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}") if newest else F.lit(False)
        seen, kept = Observation(), Observation()
        rows = batch.observe(seen, F.count("*").alias("n"), F.count_if(late).alias("late"), F.max(moment).cast("string").alias("newest"))
        first = latest_per_key(rows.where(has_key(target.keys)), target.keys, [F.col(time_column).asc_nulls_last(), row_hash(rows)])
        if target.version() is not None:
            first = first.join(target.read().select(*target.keys), target.keys, "left_anti")
        keyed, keyless = has_key(target.keys), batch.where(~has_key(target.keys))
        out = first.unionByName(keyless).observe(kept, F.count_if(keyed).alias("loaded"), F.count_if(~keyed).alias("keyless"))
        written = target.append(out, run_id, rejected=~keyed)
        total, found = seen.get, kept.get
        if found["keyless"]:
            why = {deadletter.ERROR_TYPE: F.lit(deadletter.NULL_CONSTRAINT), deadletter.ERROR_TEXT: F.lit(f"required value is NULL: {', '.join(target.keys)}")}
            letters = deadletter.dead_letters(written.rejected_rows().withColumns(why), name, name, run_id, F.current_timestamp())
            letters.write.mode("overwrite").parquet(f"{dead_letter_folder(target)}/of_run={folders.file_name(run_id)}")
        repeats = total["n"] - found["loaded"] - found["keyless"]
        newest = max(filter(None, (newest, total["newest"])), default=None)
        counts = {"rows": total["n"], "loaded": found["loaded"], "repeats": repeats, "keyless": found["keyless"], "late": total["late"]}
        sums = before["counts"]["all"] if before else dict.fromkeys(counts, 0)
        sums = {k: sums[k] + n for k, n in counts.items()}
        written.commit(rows=found["loaded"], counts={**counts, "newest": newest, "all": sums})
        target.compact_if_due()

    return _each_batch(stream, name, checkpoint, load_batch)


def stream_daily_totals(stream: DataFrame, target: TargetTable, name: str, checkpoint: str, time_column: str) -> StreamingQuery:
    """Runs and rows per day, as partial sums of each micro-batch in a target without keys; late rows count like others.  See :func:`daily_totals`."""

    def load_batch(batch: DataFrame, number: int) -> None:
        run_id = batch_run_id(target.spark, name, checkpoint, number)
        if target.commit_of(run_id):
            return
        days = batch.groupBy(F.to_date(time_column).alias("day"))
        written = target.append(days.agg(F.count("*").alias("run_count"), F.sum("rows_synced").cast("bigint").alias("total_rows")), run_id)
        written.commit()

    return _each_batch(stream, name, checkpoint, load_batch)


def daily_totals(target: TargetTable) -> DataFrame:
    summed = target.read().groupBy("day").agg(F.sum("run_count").cast("bigint").alias("run_count"), F.coalesce(F.sum("total_rows"), F.lit(0)).cast("bigint").alias("total_rows"))
    return summed


def without_repeats(stream: DataFrame, keys: list[str], time_column: str, delay: str = "1 day", spread: int = 8) -> DataFrame:
    """Rows whose key was not seen within ``delay``; state is dropped after it.

    Streaming de-duplication has no map-side step, so all repeats of one hot
    key would meet in one task. They are first thinned in ``spread`` parts by
    the task they come from; the second step is exact whatever that split is.
    ``spread=1`` leaves the first step out.
    """
    marked = stream.withWatermark(time_column, delay)
    if spread > 1:
        parts = marked.withColumn("_part", F.spark_partition_id() % spread)
        marked = parts.dropDuplicatesWithinWatermark([*keys, "_part"]).drop("_part")
    return marked.dropDuplicatesWithinWatermark(keys)


def daily_counts(stream: DataFrame, time_column: str, delay: str = "1 day") -> DataFrame:
    """Runs and rows per day of a stream of finished runs."""
    day = F.window(time_column, "1 day")
    counted = stream.withWatermark(time_column, delay).groupBy(day).agg(
        F.count("*").alias("run_count"), F.coalesce(F.sum("rows_synced"), F.lit(0)).cast("bigint").alias("total_rows")
    )
    return counted.select(F.to_date("window.start").alias("day"), "run_count", "total_rows")
