"""Nearest neighbours by inner product with multi-index hashing.

A rotation learned on a bounded sample (iterative quantisation) turns vectors into binary codes; vectors of different length are first lifted
onto a sphere, so that the largest inner product is the smallest angle.  Codes are split into substrings, each with its own
index of rows by value.  A code within Hamming radius r of a query agrees with it within r // m bits in one of m substrings
at least (pigeonhole), so probing each index within that distance retrieves every code in the radius; retrieved codes are checked for the radius, and what is left
is ranked by its floats.  The radius is learned on the sample so that it holds the neighbours there.

Rows and queries meet block against block: each block of rows builds its index once per block of queries, and keeps only the best
``k`` of each query.  A query that finds fewer than ``k`` rows in all within the radius is answered by widening it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrywork.llm.frames import rows_of, written

BITS_PER_SUBSTRING, ROUNDS, SAMPLE, SAMPLE_QUERIES, BLOCK, QUERY_BLOCK, RECALL = 8, 20, 4000, 200, 8192, 2048, 0.97


def clean(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``id, v`` (doubles) of the rows that take part: an id, no null or non-finite component, not all zero, and a sum of squares a double can hold."""
    v = F.col(embedding).cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col(vec_id).cast("long").alias("id"), v.alias("v"), square.alias("square"), fine.alias("fine")).where(
        "id IS NOT NULL AND v IS NOT NULL AND fine AND square > 0 AND square < double('infinity')"
    ).select("id", "v")


class Codes:
    """Learned rotation, lift and radius."""

    def __init__(self, sample: np.ndarray, longest: float, k: int):
        self.longest = longest
        lifted = self.lift(sample)
        self.width = -(-lifted.shape[1] // BITS_PER_SUBSTRING) * BITS_PER_SUBSTRING
        self.mean = lifted.mean(axis=0)
        rng = np.random.default_rng(5)
        start, _ = np.linalg.qr(rng.standard_normal((self.width, self.width)))
        self.turn = start[: lifted.shape[1]]
        centred = lifted - self.mean
        for _ in range(ROUNDS):  # iterative quantisation: signs, then the rotation that brings the vectors closest to them
            left, _, right = np.linalg.svd(centred.T @ np.sign(centred @ self.turn), full_matrices=False)
            self.turn = left @ right
        queries = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
        near = np.argsort(-(queries @ sample.T), axis=1)[:, 1 : k + 1]
        away = np.bitwise_count(self.of_queries(queries)[:, None, :] ^ self.of_rows(sample)[near]).sum(axis=2)
        self.radius = int(np.quantile(away, RECALL)) if away.size else self.width

    def lift(self, rows: np.ndarray) -> np.ndarray:
        scaled = rows / self.longest
        return np.hstack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(axis=1, keepdims=True)))])

    def _bits(self, x: np.ndarray) -> np.ndarray:
        return np.packbits((x - self.mean) @ self.turn > 0, axis=1)

    def of_rows(self, rows: np.ndarray) -> np.ndarray:
        return self._bits(self.lift(rows))

    def of_queries(self, rows: np.ndarray) -> np.ndarray:
        return self._bits(np.hstack([rows / np.linalg.norm(rows, axis=1, keepdims=True), np.zeros((len(rows), 1))]))


_APART = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])


def probe(rows: np.ndarray, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """``(query, row)`` positions of all codes within ``radius``, through the substring indexes."""
    pieces = rows.shape[1]
    reach = radius // pieces
    hit = np.zeros((len(queries), len(rows)), dtype=bool)
    for piece in range(pieces):
        order = np.argsort(rows[:, piece], kind="stable")
        bounds = np.searchsorted(rows[order, piece], np.arange(257))
        for value in range(256):
            members = order[bounds[value] : bounds[value + 1]]
            asking = np.flatnonzero(_APART[queries[:, piece], value] <= reach)
            if len(members) and len(asking):
                hit[asking[:, None], members[None, :]] = True
    left, right = np.nonzero(hit)
    away = np.zeros(len(left), dtype=np.uint16)
    for piece in range(pieces):
        away += np.bitwise_count(queries[left, piece] ^ rows[right, piece])
    close = away <= radius
    return left[close], right[close]


def best_of_block(codes: Codes, ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, radius: int):
    """``query id, row id, score`` of the best ``k`` rows per query found in one block."""
    found = []
    row_codes, query_codes = codes.of_rows(rows), codes.of_queries(queries)
    for a in range(0, len(queries), 256):
        left, right = probe(row_codes, query_codes[a : a + 256], radius)
        left = left + a
        other = query_ids[left] != ids[right]
        left, right = left[other], right[other]
        score = np.empty(len(left))
        for b in range(0, len(left), 1 << 16):
            score[b : b + (1 << 16)] = np.einsum("ij,ij->i", queries[left[b : b + (1 << 16)]], rows[right[b : b + (1 << 16)]])
        order = np.lexsort((ids[right], -score, left))
        left, right, score = left[order], right[order], score[order]
        start = np.searchsorted(left, left, side="left")
        top = np.arange(len(left)) - start < k
        found.append((query_ids[left[top]], ids[right[top]], score[top]))
    return [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` nearest rows found for each query, itself left out; ties go to the smaller id.

    ``queries`` has the same columns.  Vectors that do not take part (see :func:`clean`), or whose length is not the usual one, are
    neither found nor asked; a repeated id counts once, as its first vector in the order of components.  Fewer rows than ``k`` are all returned.
    """
    rows = clean(vectors, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v"))
    asked = clean(queries, vec_id, embedding).groupBy("id").agg(F.min("v").alias("v"))
    rows, asked = written(rows, "vectors"), written(asked, "queries")
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    size = rows.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("square")).orderBy(F.desc("n"), "size").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if size is None:
        return rows.sparkSession.createDataFrame([], schema)
    rows, asked = rows.where(F.size("v") == size["size"]), asked.where(F.size("v") == size["size"])
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()])
    codes = Codes(sample, float(np.sqrt(size["square"])) * (1 + 1e-12), k)
    blocks, pages = max(1, -(-size["n"] // BLOCK)), max(1, -(-asked.count() // QUERY_BLOCK))
    match = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def stacked(group: pa.Table):
        ids = group.column("id").combine_chunks().to_numpy()
        flat = group.column("v").combine_chunks()
        return ids, flat.flatten().to_numpy().reshape(len(ids), -1)

    def meet(radius: int):
        def run(block: pa.Table, page: pa.Table) -> pa.Table:
            if not block.num_rows or not page.num_rows:
                return match.empty_table()
            found = best_of_block(codes, *stacked(block), *stacked(page), k, radius)
            return pa.Table.from_arrays([pa.array(c) for c in found], schema=match)

        return run

    def pairs(some: DataFrame, radius: int) -> DataFrame:
        left = rows.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"), "id", "v")
        right = some.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), F.pmod(F.xxhash64("id"), F.lit(pages)).cast("int").alias("page"), "id", "v")
        return left.groupBy("block", "page").cogroup(right.groupBy("block", "page")).applyInArrow(meet(radius), "query_id long, vec_id long, score double")

    found = written(pairs(asked, codes.radius), "neighbours")
    full = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, size["n"] - 1))
    short = asked.join(full, asked.id == full.query_id, "left_anti")
    wide = pairs(short, codes.width).join(short.select(F.col("id").alias("query_id")), "query_id")
    enough = found.join(full.select("query_id"), "query_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = enough.union(wide.select(enough.columns)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
