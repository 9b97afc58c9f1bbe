"""Near-duplicate vectors by spherical-cap filters.

Filter directions form a random product code: the space is split into parts, each with its own small codebook, and every combination of code words,
one per part, is a direction.  A vector goes to every direction whose inner product with it exceeds a threshold; the directions are found by list decoding: part by
part, dropping beginnings that no ending can lift over the threshold.  Vectors that share a filter (and a label) are compared, and those of a cosine at or above the limit are linked.
Code size and threshold follow from the number of vectors, so that a filter holds a bounded number of unrelated vectors and a vector has about ``SHARE`` filters.

Equal vectors are folded first.  A pair is counted in the first filter that both share only, so links are counted without listing pairs;
filters with more than ``CROWD`` vectors are compared in blocks spread over tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.annindex import clean
from ferrywork.llm.components import Forest, components
from ferrywork.llm.frames import rows_of, written

PARTS, SHARE, LEAST, LOAD, CROWD, LIMIT = 3, 48, 24, 128, 2048, 0.93


class ProductCode:
    def __init__(self, dim: int, vectors: int):
        chance = min(0.02, LOAD / max(vectors, 1))
        self.size = max(4, round((SHARE / chance) ** (1 / PARTS)))
        rng = np.random.default_rng(11)
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.turn = turn
        edges = np.linspace(0, dim, PARTS + 1).astype(int)
        self.edges = list(zip(edges[:-1], edges[1:]))
        # Each part's words have length 1 / sqrt(PARTS), so that directions have length 1.
        self.books = []
        for a, b in self.edges:
            book = rng.standard_normal((self.size, b - a))
            length = np.linalg.norm(book, axis=1, keepdims=True)
            self.books.append(book / np.where(length > 0, length, 1) / np.sqrt(PARTS))
        # The threshold that a share ``chance`` of directions exceeds, measured on random vectors; normal only in many dimensions.
        units = rng.standard_normal((20_000, dim))
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        gains = np.zeros(len(units))
        for (a, b), book in zip(self.edges, self.books):
            gains += np.einsum("ij,ij->i", units[:, a:b], book[rng.integers(0, self.size, len(units))])
        self.threshold = float(np.quantile(gains, 1 - chance))

    def decode(self, units: np.ndarray, threshold: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``(vector, filter)`` of all directions above the threshold, which is lowered for vectors with fewer than ``LEAST`` of them."""
        threshold = self.threshold if threshold is None else threshold
        turned = units @ self.turn
        gains = [turned[:, a:b] @ book.T for (a, b), book in zip(self.edges, self.books)]
        owner, code, so_far = np.arange(len(units)), np.zeros(len(units), dtype=np.int64), np.zeros(len(units))
        for part, g in enumerate(gains):
            hope = sum((h.max(axis=1) for h in gains[part + 1 :]), np.zeros(len(units)))
            total = so_far[:, None] + g[owner]
            at, word = np.nonzero(total + hope[owner][:, None] >= threshold)
            owner, code, so_far = owner[at], code[at] * self.size + word, total[at, word]
        poor = np.flatnonzero(np.bincount(owner, minlength=len(units)) < LEAST)
        if len(poor) and threshold > -1:
            more, codes = self.decode(units[poor], threshold - 0.05)
            rich = ~np.isin(owner, poor)
            owner, code = np.concatenate([owner[rich], poor[more]]), np.concatenate([code[rich], codes])
        order = np.lexsort((code, owner))
        return owner[order], code[order]


def cap_filter_links(vectors: DataFrame, limit: float = LIMIT, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Only vectors of one non-null label and one dimension are compared.  Null, zero and non-finite vectors, and null labels, link with nothing.
    Rows of one id and vector count as one vector with itself; a null id stays, unlinked, with a null component and ``kept`` false.  Other columns are not read.
    """
    every = vectors.select(F.col(vec_id).cast("long").alias("vec_id"))
    fit = vectors.where(F.col(label).isNotNull()).select(F.col(vec_id).alias("i"), F.col(embedding).alias("e"), F.col(label).cast("string").alias("label"))
    fine = clean(fit, "i", "e")
    # Vectors travel as they are given; cosines are in doubles.
    wide = F.col("v").cast("array<double>")
    labelled = fit.select(F.col("i").cast("long").alias("id"), "label", F.col("e").alias("v"))
    fine = fine.select(F.col("id").alias("fine_id"), F.col("v").alias("fine_v")).distinct()
    folded = written(labelled.join(fine, (F.col("id") == F.col("fine_id")) & (wide == F.col("fine_v")), "left_semi").groupBy("label", "v").agg(F.min("id").alias("rep"), F.count_distinct("id").alias("copies")), "folded")
    members = labelled.join(folded, ["label", "v"]).select("id", "rep", "copies").distinct()
    most = folded.groupBy("label", F.size("v").alias("dim")).count().agg(F.max("count")).first()[0] or 1
    dims = [r[0] for r in folded.select(F.size("v")).distinct().collect()]
    codes = {d: ProductCode(d, most) for d in dims}
    number = folded.schema["v"].dataType.elementType.simpleString()
    filtered = pa.schema([("label", pa.string()), ("dim", pa.int32()), ("cap", pa.int64()), ("rep", pa.int64()), ("copies", pa.int64()), ("v", pa.list_(pa.float32() if number == "float" else pa.float64())), ("caps", pa.list_(pa.int64()))])
    ddl = f"label string, dim int, cap long, rep long, copies long, v array<{number}>, caps array<long>"

    def assign(batches):
        for batch in batches:
            size = batch.column("dim").to_numpy()
            for d in np.unique(size):
                part = batch.filter(pa.array(size == d))
                for a in range(0, part.num_rows, 1000):
                    some = part.slice(a, 1000)
                    x = _stacked(some.column("v"))
                    owner, cap = codes[int(d)].decode(x / np.linalg.norm(x, axis=1, keepdims=True))
                    own = pa.array(owner)
                    lists = np.split(cap, np.searchsorted(owner, np.arange(1, some.num_rows)))
                    yield rows_of(filtered, [some.column("label").take(own), some.column("dim").take(own), cap, some.column("rep").take(own), some.column("copies").take(own), some.column("v").take(own), pa.array(lists, pa.list_(pa.int64())).take(own)])

    caps = written(folded.select("label", F.size("v").alias("dim"), "rep", "copies", "v").mapInArrow(assign, ddl), "caps")
    crowds = caps.groupBy("label", "dim", "cap").agg(F.count("*").alias("n")).where("n > 1")
    split = F.ceil(F.col("n") / CROWD).cast("int")
    dealt = caps.join(crowds, ["label", "dim", "cap"]).withColumn("split", split).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("split")).cast("int"))
    # A crowd of s blocks becomes one group per pair of blocks; its vectors go to the s groups of their block.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("split") - 1)))
    dealt = dealt.select("label", "dim", "cap", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "rep", "copies", "v", "caps")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])

    def compare(group: pa.Table) -> pa.Table:
        rep, copies, own = (group.column(c).combine_chunks().to_numpy() for c in ("rep", "copies", "own"))
        x = _stacked(group.column("v").combine_chunks())
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        cap, low, high = (group.column(c)[0].as_py() for c in ("cap", "low", "high"))
        lists = group.column("caps").combine_chunks()
        held = lists.flatten().to_numpy()
        holder = np.repeat(np.arange(len(rep)), pc.list_value_length(lists).to_numpy())
        # A pair that shares an earlier filter is counted there.
        earlier = held < cap
        names, place = np.unique(held[earlier], return_inverse=True)
        before = np.zeros((len(rep), len(names)), dtype=np.float32)
        before[holder[earlier], place] = 1
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        links, forest = np.zeros(len(rep), dtype=np.int64), Forest()
        for a in range(0, len(left), 512):
            rows = left[a : a + 512]
            close = (x[rows] @ x[right].T >= limit) & (rep[rows][:, None] != rep[right][None, :])
            close[close.any(axis=1)] &= before[rows[close.any(axis=1)]] @ before[right].T == 0
            links[rows] += close @ copies[right]
            if low != high:
                links[right] += close.T @ copies[rows]
            for i, j in zip(*np.nonzero(close)):
                forest.join(int(rep[rows[i]]), int(rep[right[j]]))
        counted = np.flatnonzero(links)
        edges = [(n, r, 0) for n in forest.parent if (r := forest.root(n)) != n]
        a = np.concatenate([rep[counted], np.array([e[0] for e in edges], dtype=np.int64)])
        b = np.concatenate([rep[counted], np.array([e[1] for e in edges], dtype=np.int64)])
        return pa.Table.from_arrays([pa.array(a), pa.array(b), pa.array(np.concatenate([links[counted], np.zeros(len(edges), np.int64)]))], schema=out)

    found = written(dealt.groupBy("label", "dim", "cap", "low", "high").applyInArrow(compare, "a long, b long, links long"), "caplinks")
    links = found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    rooted = components(found.where("a <> b").select("a", "b").union(members.where("id <> rep").select("id", "rep")))
    joined = members.join(links, "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    result = every.join(joined, every.vec_id == joined.id, "left").join(rooted, every.vec_id == rooted.node, "left")
    component = F.coalesce("root", "vec_id")
    return result.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


def _stacked(vectors: pa.Array) -> np.ndarray:
    return vectors.flatten().to_numpy().reshape(len(vectors), -1).astype(np.float64)
