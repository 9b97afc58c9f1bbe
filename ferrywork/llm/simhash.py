"""Near-duplicate documents by SimHash fingerprints, with pivot distance tables.

Fingerprints are made once per document and folded to distinct ones before anything is compared.
Two fingerprints that differ in at most four of 64 bits agree on three of seven blocks, so
each goes to the 35 lists of its block triples.  Within a list the distances of every fingerprint to
the reference fingerprints (pivots) are laid out as a table: by the triangle inequality, a pair whose
coordinates differ by more than the radius anywhere is too far apart.  Pairs that are left are verified.
Lists longer than ``DENSE`` are linked through midpoints in place of pairs (two fingerprints within four
bits share a word within two bits of both), which finds the same components in linear time.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywork.llm.components import Forest, components
from ferrywork.llm.frames import released, rows_of, slices, small_batches, written
from ferrywork.llm.textcodes import mixed

SEED, SHINGLE, RADIUS, PIVOTS, DENSE = 42, 4, 4, 48, 4096
BLOCKS = (10, 9, 9, 9, 9, 9, 9)
TRIPLES = list(combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS))


def _block_masks() -> list[int]:
    at, masks = 0, []
    for width in BLOCKS:
        masks.append(((1 << width) - 1) << at)
        at += width
    return masks


MASKS = np.array([sum(_block_masks()[b] for b in triple) for triple in TRIPLES], dtype=np.uint64)
REFERENCES = mixed(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of the ASCII-lower-cased words of ``text``; 0 where there is none."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), dtype=np.uint64, count=len(starts))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` (a signed long) for each row of ``docs``, and every column besides ``text`` and these that ``docs`` has."""
    small_batches(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text", "fp")]
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`") for c in others])

    def run(batches):
        for part in slices(batches):
            texts = part.column("text").cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64).view(np.int64)
            columns = [part.column("doc_id"), pa.array(found), *[part.column(c) for c in others]]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", *others])

    result = T.StructType([*T.StructType.fromDDL("doc_id long, fp long").fields, *[source.schema[c] for c in others]])
    return source.mapInArrow(released(run), result)


def _near(fps: np.ndarray, radius: int):
    """Pairs of positions within ``radius``: pivot table first, then the bits themselves."""
    table = np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int16)
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order]
    stop = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")
    block = max(1, (1 << 20) // len(fps))
    for k in range(0, len(fps), block):
        rows = np.arange(k, min(k + block, len(fps)))
        count = stop[rows] - rows - 1
        left = np.repeat(rows, count)
        if not len(left):
            continue
        right = np.concatenate([np.arange(r + 1, stop[r]) for r in rows])
        for pivot in range(1, PIVOTS):
            close = np.abs(table[left, pivot] - table[right, pivot]) <= radius
            left, right = left[close], right[close]
        exact = np.bitwise_count(fps[left] ^ fps[right]) <= radius
        yield order[left[exact]], order[right[exact]]


def _through_midpoints(fps: np.ndarray, free: list[int], forest: Forest) -> None:
    """Link fingerprints that share a word at most two free bits away from both."""
    flips = np.array([0, *(1 << a for a in free), *((1 << a) | (1 << b) for a, b in combinations(free, 2))], dtype=np.uint64)
    rounds = -(-len(fps) * len(flips) // (1 << 22))
    for r in range(rounds):
        words, owners = [], []
        for flip in flips:
            word = fps ^ flip
            mine = mixed(word) % np.uint64(rounds) == r
            words.append(word[mine])
            owners.append(fps[mine])
        words, owners = np.concatenate(words), np.concatenate(owners)
        order = np.argsort(words, kind="stable")
        words, owners = words[order], owners[order]
        same = np.flatnonzero(words[1:] == words[:-1])
        for a, b in set(zip(owners[same].tolist(), owners[same + 1].tolist())):
            forest.join(a, b)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links ``a, b`` that join distinct fingerprints of column ``fp`` into the same components as all pairs within the radius."""
    if radius > RADIUS:
        raise ValueError(f"the block triples cover a radius of at most {RADIUS}")
    pair = pa.schema([("key", pa.int64()), ("fp", pa.int64())])
    edge = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    tag = (np.arange(len(MASKS), dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03)

    def keyed(batches):
        for batch in batches:
            own = batch.column(0).to_numpy().view(np.uint64)
            keys = mixed((own[:, None] & MASKS[None, :]) + tag[None, :])
            for k in range(0, len(own), 2000):
                yield rows_of(pair, [pa.array(keys[k : k + 2000].ravel().view(np.int64)), pa.array(np.repeat(own[k : k + 2000], len(MASKS)).view(np.int64))])

    def linked(own: np.ndarray, forest: Forest) -> None:
        own = np.unique(own)
        if len(own) < 2:
            return
        if len(own) > DENSE:
            alike = np.bitwise_and.reduce(~(own ^ own[0]))
            _through_midpoints(own, [b for b in range(64) if not int(alike) >> b & 1], forest)
            return
        for left, right in _near(own, radius):
            for a, b in zip(own[left].tolist(), own[right].tolist()):
                forest.join(a, b)

    def search(batches):
        forest, rest = Forest(), (np.zeros(0, np.int64), np.zeros(0, np.uint64))
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.concatenate([rest[0], batch.column(0).to_numpy()])
            own = np.concatenate([rest[1], batch.column(1).to_numpy().view(np.uint64)])
            starts = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0)
            bounds = np.append(starts, len(key))
            for k in np.flatnonzero(np.diff(bounds[:-1]) > 1):
                linked(own[bounds[k] : bounds[k + 1]], forest)
            tail = bounds[-2]
            rest = (key[tail:], own[tail:])
        linked(rest[1], forest)
        found = np.array([(x, r) for x in forest.parent if (r := forest.root(x)) != x], dtype=np.uint64).reshape(-1, 2).view(np.int64)
        for k in range(0, len(found), 50_000):
            yield rows_of(edge, [pa.array(found[k : k + 50_000, 0]), pa.array(found[k : k + 50_000, 1])])

    return fps.select("fp").mapInArrow(released(keyed), "key long, fp long").repartition("key").sortWithinPartitions("key").mapInArrow(released(search), "a long, b long")


def groups(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``fp, least, root`` for each distinct ``fp`` of ``marked`` (``doc_id, fp``): its least id, and the fingerprint that names its group."""
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = components(links(distinct, radius))
    return written(distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "roots")


def first_of_groups(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The rows of ``docs`` that stay when each group of near duplicates keeps one document: that of the smallest ``doc_id``.

    Where an id has several texts, each counts by itself: a group keeps the one of least digest, and other groups may keep the others.  Of rows that
    repeat id and text, one stays, the first by its other columns, whatever their type.  Null and empty texts are one text.  Rows without ``doc_id``
    all stay, and keep none away.  An empty table gives an empty result.
    """
    digest = F.substring(F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)), 1, 16)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # put aside, so that no column's name matters
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("id"), digest.alias("digest"), row.alias("row"))
    marked = known.select(F.col("id").alias("doc_id"), F.col("row.text").alias("text"), "digest")
    marked = written(fingerprints(marked, shingle), "fingerprints").withColumnRenamed("doc_id", "id")
    rooted = groups(marked.withColumnRenamed("id", "doc_id"), radius).select("fp", "root")
    firsts = marked.groupBy("fp").agg(F.min(F.struct("id", "digest")).alias("first")).join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first"))
    times = marked.groupBy("id", "digest").agg(F.count("*").alias("times"))
    stay = known.join(firsts.select("first.*").join(times, ["id", "digest"]), ["id", "digest"])
    columns = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    once = stay.where("times = 1").select(*columns)
    # Repeats are few beside all documents, so only theirs are gathered, row by row, and ordered by the text of their columns: some types have no order.
    order = F.to_json("row", {"ignoreNullFields": "false"})
    again = stay.where("times > 1").groupBy("id", "digest").agg(F.min_by("row", order).alias("row")).select(*columns)
    return once.unionByName(again).unionByName(docs.where("doc_id IS NULL"))


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp, component_id`` for each row of ``docs``.

    Null and blank texts have fingerprint 0 and link like any other.  Repeated rows and equal texts share
    their fingerprint and so their component.  Rows without ``doc_id`` stay, and lend no id: a component
    with no id at all has a null ``component_id``.  An empty table gives an empty result.  Other columns are not read.
    """
    marked = written(fingerprints(docs.select("doc_id", "text"), shingle), "fingerprints")
    rooted = groups(marked, radius)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(ids, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(column))), 16, "0")
