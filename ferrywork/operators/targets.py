"""Target tables on plain parquet: a bucketed base and the change batches since.

A sync cycle writes only its changes. Readers see the newest change per key on
top of the base; ``compact`` folds the changes into a new base now and then.
The base is bucketed by key, so joining it with the changes never shuffles it.
Where the catalogue has tables with row-level writes, use ``DataFrame.mergeInto``
on them instead.

Layout, below ``<root>/<name>``::

    v=00002.b=64/base/            parquet in 64 buckets, _COMMITTED.json
    v=00002.b=64/changes/batch=00001/_rejected=false|true/   _COMMITTED.json

Only folders with a marker count, so a job that dies leaves nothing visible and
can run again. The marker names the run, the schema and the bookmark that the
batch reached: rows and bookmark are committed by one small write. One writer
per target at a time.
"""

from __future__ import annotations

import json
import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ferrywork.functions.names import safe_name
from ferrywork.operators.merge import delete_by_key, has_key, latest_per_key, row_hash
from ferrywork.sources import folders

MARKER = "_COMMITTED.json"
OP, REJECTED, BATCH = "_op", "_rejected", "batch"
UPSERT, DELETE = "U", "D"
ERRORS = ("error_type", "error_text", "error_row")
BOOKKEEPING = (OP, REJECTED, BATCH, *ERRORS)
#: VARIANT object of the values that came for columns the target did not have, by lower-case name.
RESCUED = "_rescued"

Version = tuple[int, int]


class TargetTable:
    """``keys`` may be empty: such a target only grows.

    Commits carry ``owner``; with one set, only its own commits count as its runs and bookmarks.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        name: str,
        keys: list[str],
        order_by: str | None = None,
        buckets: int | None = None,
        compact_after: int = 20,
        compact_share: float = 0.5,
        owner: str | None = None,
    ):
        self.owner = owner
        self.spark, self.keys, self.order_by = spark, list(keys), order_by
        self.path = f"{root.rstrip('/')}/{safe_name(name)}"
        self.buckets = (buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))) if keys else 0
        self.compact_after, self.compact_share = compact_after, compact_share
        self._label = f"{safe_name(name)}_{zlib.crc32(self.path.encode()):08x}"
        self._read_markers: dict[str, dict] = {}

    # -- what is committed ------------------------------------------------

    def _marker(self, path: str) -> dict | None:
        if path not in self._read_markers:
            if not folders.exists(self.spark, f"{path}/{MARKER}"):
                return None
            try:
                self._read_markers[path] = json.loads(folders.read_text(self.spark, f"{path}/{MARKER}"))
            except json.JSONDecodeError:  # cut short: not committed
                return None
        return self._read_markers[path]

    def _commit(self, path: str, schema: T.StructType, **facts) -> None:
        marker = {**facts, "schema": schema.jsonValue()}
        folders.write_text(self.spark, f"{path}/{MARKER}", json.dumps(marker))
        self._read_markers[path] = marker

    def _schema(self, path: str) -> T.StructType:
        return T.StructType.fromJson(self._marker(path)["schema"])

    def version(self) -> Version | None:
        """Number and bucket count of the newest committed base."""
        for name in reversed(folders.child_names(self.spark, self.path)):
            match = re.fullmatch(r"v=(\d+)\.b=(\d+)", name)
            if match and self._marker(f"{self.path}/{name}/base"):
                return int(match.group(1)), int(match.group(2))
        return None

    def _folder(self, version: Version) -> str:
        return f"{self.path}/v={version[0]:05d}.b={version[1]}"

    def _base_path(self, version: Version) -> str:
        return f"{self._folder(version)}/base"

    def _batch_path(self, version: Version, number: int) -> str:
        return f"{self._folder(version)}/changes/batch={number:05d}"

    def batches(self, version: Version) -> list[int]:
        names = folders.child_names(self.spark, f"{self._folder(version)}/changes")
        numbers = sorted(int(n.split("=")[1]) for n in names if n.startswith("batch="))
        return [n for n in numbers if self._marker(self._batch_path(version, n))]

    def commits(self) -> list[dict]:
        """Markers of the newest version, oldest first: its base, then its batches."""
        version = self.version()
        if version is None:
            return []
        return [self._marker(p) for p in (self._base_path(version), *(self._batch_path(version, n) for n in self.batches(version)))]

    def commit_of(self, run_id: str) -> dict | None:
        """The marker of this run if its rows are already in the target."""
        for marker in self.commits():
            for fact in (marker, *marker.get("folded", [])):
                if fact.get("run_id") == run_id and self._mine(fact):
                    return fact
        return None

    def _mine(self, fact: dict) -> bool:
        return self.owner is None or fact.get("owner") == self.owner

    def last_fact(self, name: str) -> dict | None:
        """The last commit of the owner that holds a fact of this name."""
        return next(reversed(self.facts(name)), None)

    def facts(self, name: str) -> list[dict]:
        """All commits of the owner that hold a fact of this name, oldest first."""
        return [f for m in self.commits() for f in (*m.get("folded", []), m) if f.get(name) and self._mine(f)]

    def last_bookmark(self) -> dict | None:
        """The bookmark fact committed last, with its run and time."""
        return self.last_fact("bookmark")

    def schema(self) -> T.StructType | None:
        """Columns of the base, then those that later batches added."""
        version = self.version()
        if version is None:
            return None
        paths = [self._base_path(version), *(self._batch_path(version, n) for n in self.batches(version))]
        return _merged([self._schema(p) for p in paths], drop=BOOKKEEPING)

    # -- reading ------------------------------------------------------------

    def _base(self, version: Version) -> DataFrame:
        path = self._base_path(version)
        schema = self._schema(path)
        if not self.keys or not schema.fields:
            return self.spark.read.schema(schema).parquet(path)
        table = f"{self._label}_v{version[0]}"
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        by = ", ".join(f"`{k}`" for k in self.keys)
        quoted = path.replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
            f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {version[1]} BUCKETS LOCATION '{quoted}'"
        )
        return self.spark.table(table)

    def _changes(self, version: Version, numbers: list[int]) -> DataFrame:
        paths = [self._batch_path(version, n) for n in numbers]
        schema = _merged([self._schema(p) for p in paths], drop=(BATCH,)).add(BATCH, "integer")
        reader = self.spark.read.schema(schema).option("basePath", f"{self._folder(version)}/changes")
        return reader.parquet(*paths).where(~F.col(REJECTED)).drop(REJECTED, *ERRORS)

    def _newest(self, changes: DataFrame) -> DataFrame:
        """Last change per key: by batch, then by the order column.

        A delete that brings only its key wins within its batch, because its
        scan may have come after the other one.
        """
        order = [F.col(BATCH).desc()]
        if self.order_by in changes.columns:
            moment = F.col(self.order_by)
            order += [(moment.isNull() & (F.col(OP) == DELETE)).desc(), moment.desc_nulls_last()]
        return latest_per_key(changes, self.keys, [*order, F.col(OP).asc(), row_hash(changes)])

    def _parts(self) -> list[DataFrame]:
        """The untouched base rows and the rows that changed, whichever there are."""
        version = self.version()
        if version is None:
            raise LookupError(f"{self.path} has no committed version")
        base, numbers = self._base(version), self.batches(version)
        if not numbers:
            return [base]
        changes = self._changes(version, numbers)
        newest = changes
        if self.keys:
            newest = self._newest(changes.where(has_key(self.keys))).where(F.col(OP) == UPSERT)
        parts = [newest.drop(OP, BATCH)]
        if base.columns:
            parts.insert(0, delete_by_key(base, changes, self.keys))
        return parts

    def read(self, rescued: bool = False) -> DataFrame:
        """The table as it stands; with ``rescued`` also the values kept for columns it does not have."""
        rows = _filled(_united(self._parts()))
        return rows if rescued or RESCUED not in rows.columns else rows.drop(RESCUED)

    # -- writing ------------------------------------------------------------

    def _spread(self, rows: DataFrame, buckets: int) -> DataFrame:
        """One task per bucket, so that a bucket becomes one file.

        Rows that were just chosen per key are already hashed by key; where
        shuffles have as many partitions as there are buckets that is enough.
        """
        if not self.keys or int(self.spark.conf.get("spark.sql.shuffle.partitions")) == buckets:
            return rows
        return rows.repartition(buckets, *self.keys)

    def _write_base(self, version: Version, rows: DataFrame, **facts) -> None:
        """Write the rows as they are partitioned, then commit."""
        path = self._base_path(version)
        self._read_markers.pop(path, None)
        table = f"{self._label}_v{version[0]}"
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        counted = Observation()
        writer = rows.observe(counted, F.count("*").alias("n")).write.mode("overwrite")
        if self.keys:
            bucketed = writer.format("parquet").bucketBy(version[1], *self.keys).sortBy(*self.keys)
            bucketed.option("path", path).saveAsTable(table)
        else:
            writer.parquet(path)
        self._commit(path, _merged([rows.schema]), rows=counted.get["n"], **facts)

    def replace(self, rows: DataFrame, run_id: str, at: str = "", bookmark: dict | None = None) -> None:
        """A new version that holds just ``rows``, one per key."""
        last = self.version()
        version = ((last[0] if last else 0) + 1, self.buckets)
        if self.keys:
            order = [F.col(self.order_by).desc_nulls_last()] if self.order_by in rows.columns else []
            unique = latest_per_key(rows.where(has_key(self.keys)), self.keys, [*order, row_hash(rows)])
            rows = self._spread(unique, self.buckets)
        self._write_base(version, rows, run_id=run_id, at=at, bookmark=bookmark, owner=self.owner)

    def append(self, rows: DataFrame, run_id: str, rejected: Column | None = None) -> "Batch":
        """Write ``rows`` as a change batch. Nothing is visible before ``commit``.

        Rows may bring an ``_op`` column of ``U`` and ``D``; without it all are
        upserts. ``rejected`` rows are stored beside the others but never read
        as part of the table.
        """
        version = self.version()
        if version is None:
            version = (1, self.buckets)
            self._commit(self._base_path(version), T.StructType())
        self._check_types(rows)
        numbers = self.batches(version)
        path = self._batch_path(version, (numbers[-1] if numbers else 0) + 1)
        added = {REJECTED: F.lit(False) if rejected is None else rejected}
        if OP not in rows.columns:
            added[OP] = F.lit(UPSERT)
        out = rows.withColumns(added)
        out.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(REJECTED).parquet(path)
        return Batch(self, path, run_id, T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields]))

    def _check_types(self, rows: DataFrame) -> None:
        known = self.schema()
        types = {f.name: f.dataType for f in known.fields} if known else {}
        wrong = [f.name for f in rows.schema.fields if f.name in types and types[f.name] != f.dataType]
        if wrong:
            raise TypeError(f"columns {wrong} do not have the target's type; cast them first")

    def compact(self) -> None:
        """Fold the changes into a new base; the old version stays readable."""
        version = self.version()
        if not self.batches(version):
            return
        *kept, changed = self._parts()
        folded = [{k: m.get(k) for k in ("run_id", "at", "bookmark", "rows", "owner", "deleted", "counts")} for m in self.commits() if m.get("run_id")]
        # The kept rows are written from where they are, bucket by bucket.
        rows = _filled(_united([*kept, self._spread(changed, version[1])]))
        self._write_base((version[0] + 1, version[1]), rows, folded=folded)

    def compact_if_due(self) -> bool:
        """Compact a first load at once, later when changes are many or large beside the base."""
        base, *changes = self.commits() or [{}]
        if not changes or not self.keys:
            return False
        changed = sum(m.get("rows") or 0 for m in changes)
        due = len(changes) >= self.compact_after or not base["schema"]["fields"]
        due = due or changed > self.compact_share * (base.get("rows") or 0)
        if due:
            self.compact()
            self.drop_old_versions()
        return due

    def drop_old_versions(self, keep: int = 2) -> None:
        """Readers that began on the version before the newest may still finish."""
        names = [n for n in folders.child_names(self.spark, self.path) if re.fullmatch(r"v=\d+\.b=\d+", n)]
        for name in names[:-keep]:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._label}_v{int(name[2:7])}")
            folders.remove(self.spark, f"{self.path}/{name}")


class Batch:
    """A written change batch that waits for its commit."""

    def __init__(self, target: TargetTable, path: str, run_id: str, schema: T.StructType):
        self.target, self.path, self.run_id, self.schema = target, path, run_id, schema

    def rejected_rows(self) -> DataFrame:
        rows = self.target.spark.read.schema(self.schema).parquet(self.path)
        return rows.where(F.col(REJECTED)).drop(REJECTED, OP)

    def landed(self) -> tuple[int, int]:
        """Accepted rows that the written files hold, and how many of them repeat the key of another."""
        rows = self.target.spark.read.schema(self.schema).parquet(self.path)
        return landed(rows.where(~F.col(REJECTED) & (F.col(OP) == UPSERT)), self.target.keys)

    def commit(
        self, at: str = "", bookmark: dict | None = None, rows: int | None = None, deleted: str | None = None, counts: dict | None = None
    ) -> None:
        """``deleted`` is the newest soft delete that the batch carries over; ``counts`` are other figures to keep with it."""
        owner = self.target.owner
        self.target._commit(self.path, self.schema, run_id=self.run_id, at=at, bookmark=bookmark, rows=rows, owner=owner, deleted=deleted, counts=counts)


def landed(rows: DataFrame, keys: list[str]) -> tuple[int, int]:
    """Rows of a written frame and how many of them repeat a key; reads the key columns, or without keys only the file footers."""
    if not keys:
        return rows.agg(F.count("*")).first()[0], 0
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("keys")).first()
    return counted["n"] or 0, (counted["n"] or 0) - counted["keys"]


def _rescue_key(name: str) -> str:
    return folders.file_name(name.lower())  # without the signs that end a path


def rescue(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` without ``columns``, whose values go to the rescue column; it is NULL where all of them are."""
    held = F.to_variant_object(F.struct(*[F.col(f"`{c}`").alias(_rescue_key(c)) for c in columns]))
    some = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in columns])
    return rows.withColumn(RESCUED, F.when(some, held)).drop(*columns)


def _filled(rows: DataFrame) -> DataFrame:
    """Columns added later get the values that were rescued for them before."""
    if RESCUED not in rows.columns:
        return rows
    kept = {}
    for f in rows.schema.fields:
        if not f.name.startswith("_"):
            path = f"$['{_rescue_key(f.name)}']"
            kept[f.name] = F.coalesce(F.col(f"`{f.name}`"), F.try_variant_get(F.col(RESCUED), path, f.dataType.simpleString()))
    return rows.withColumns(kept)


def _united(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _merged(schemas: list[T.StructType], drop: tuple[str, ...] = ()) -> T.StructType:
    out = T.StructType()
    for schema in schemas:
        for f in schema.fields:
            if f.name not in drop and f.name not in out.names:
                out = out.add(T.StructField(f.name, f.dataType))
    return out
