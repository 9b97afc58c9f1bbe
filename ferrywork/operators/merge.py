"""Keeping a target right by primary key: latest row, upsert, delete, insert-ignore.

All joins here are on the key and leave the strategy to Catalyst: a small
change set is broadcast under Spark's own size limit, a large one is
sort-merged, and a bucketed target (see ``targets``) is not shuffled at all.
No plan step gathers all rows of one key: a key that holds a third of the
change set is cut to one row per map task before the shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F


def newest_first(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def row_hash(df: DataFrame) -> Column:
    """Hash over all columns; the last tie-break, so that results repeat."""
    def hashable(field):
        col = F.col(f"`{field.name}`")
        text = field.dataType.simpleString()
        return F.to_json(F.struct(col)) if "map<" in text or "variant" in text else col

    return F.xxhash64(*[hashable(f) for f in df.schema.fields])


def latest_per_key(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """First row per key in ``order_by`` order.

    Spark turns ``row_number() = 1`` into a group limit on both sides of the
    shuffle, so each map task sends at most one row per key.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    return ranked.where(F.col("_rn") == 1).drop("_rn")


def has_key(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def delete_by_key(target: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """Target without the rows named by ``deletes``; NULL keys match nothing."""
    if not keys:
        return target
    return target.join(deletes.where(has_key(keys)).select(*keys).distinct(), keys, "left_anti")


def rows_to_delete(target: DataFrame, deletes: DataFrame, keys: list[str]) -> DataFrame:
    """The target rows that :func:`delete_by_key` removes."""
    return target.join(deletes.where(has_key(keys)).select(*keys).distinct(), keys, "left_semi")


def insert_ignore(target: DataFrame, rows: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """Rows whose key the target lacks, one per key; rows with a NULL key never conflict."""
    fresh = rows.where(has_key(keys)).join(target.select(*keys), keys, "left_anti")
    return latest_per_key(fresh, keys, order_by).unionByName(rows.where(~has_key(keys)))


def merge_rows(target: DataFrame, changes: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """Target after an upsert of the newest change per key.

    Columns that only one side has are NULL on the other. Changes with a NULL
    key match nothing and are added as they are.
    """
    keyed = latest_per_key(changes.where(has_key(keys)), keys, order_by)
    kept = delete_by_key(target, changes, keys)
    return kept.unionByName(keyed, allowMissingColumns=True).unionByName(
        changes.where(~has_key(keys)), allowMissingColumns=True
    )


def compact_latest(df: DataFrame, keys: list[str], version: str, *tie_break: str) -> DataFrame:
    """One row per key, the one with the greatest version."""
    return latest_per_key(df, keys, newest_first(version, *tie_break))


def unfolded(df: DataFrame, copies: str, number: str, block: int = 10_000) -> DataFrame:
    """Each row ``copies`` times, numbered from 1 in ``number``; made in blocks, so that no long list is held."""
    first = F.sequence(F.lit(0).cast("bigint"), F.col(copies) - 1, F.lit(block).cast("bigint"))
    blocks = df.withColumn("_block", F.explode(first))
    last = F.least(F.col(copies), F.col("_block") + block)
    return blocks.withColumn(number, F.explode(F.sequence(F.col("_block") + 1, last))).drop("_block")
