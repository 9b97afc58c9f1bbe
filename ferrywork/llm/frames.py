"""Helpers shared by the operators: slices of Arrow batches and tables written to the shared folder."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ferrywork.session import scratch_path

SLICE_BYTES = 1 << 19
#: Rows of a batch of texts between Spark and its workers; Spark's own bound of 10,000 makes tens of megabytes on either side.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder, which lost executors do not take with them."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Have batches of at most ``ARROW_ROWS`` rows in this session; a smaller bound that is set stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    bound = int(spark.conf.get(key))
    if bound <= 0 or bound > ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def give_back() -> None:
    """Return the memory that this process holds without need; workers live on after a task, and those of earlier stages add up."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim is not None:
        trim(0)


def released(run):
    """``run`` over the batches of a task, and :func:`give_back` when the task ends, however it ends."""

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return inner


def slices(batches, column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``size`` bytes of ``column``, or one longer row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths) // size
        cuts = np.flatnonzero(np.diff(part, prepend=-1)).tolist() + [batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(a, b - a)


def rows_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)
