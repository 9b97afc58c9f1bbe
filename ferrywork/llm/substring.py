"""Removal of word windows that an earlier document holds, by suffix automata over reference shards.

1. *Anchors.*  Of the short word runs in each window the one with the least hash is its anchor, so equal windows
   have equal anchors.  Anchors that only one document holds are dropped; for the others the first document is known.
2. *Shards.*  The windows of a repeated anchor go, as stretches of text, to the shard of the anchor's first
   document.  Every document that holds such a window sends it to that same shard, so no other text needs to be seen there.  The anchors of a document that is
   first for very many are dealt to several shards by their hash; equal windows have equal anchors and still meet.
3. *Automata.*  A shard streams its stretches in the order of doc_id through one suffix automaton of the stretches of smaller ids, which gives
   the length of the longest match that ends at each word; matches of a whole window or more are maximal spans to remove.
   Only text that was not matched is added, so the automaton holds distinct text.

The automata are not broadcast whole: the reference is the corpus itself, so shards and stretches are
brought together by a shuffle, which grows with the repeated text alone.  Anchors found more than ``HOT`` times
(a passage that a large part of the documents share) would all meet in one shard; their runs of windows are folded to
distinct texts first, within each row and then over all, whose windows are compared by an aggregation, and the answers are joined back to the rows, which Spark can split.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrywork.llm.frames import released, rows_of, slices, small_batches, written
from ferrywork.llm.textcodes import Words, utf8

WINDOW, GRAM, HOT, SHARD_RUNS = 13, 5, 5000, 200_000


def anchors(words: Words, window: int, gram: int):
    """Runs of windows with one anchor: hash, text, first window in the text, number of windows."""
    grams, whole = words.windows(gram), words.whole(window)
    n, spread = len(whole), window - gram + 1
    if not n:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    least, at = grams[:n].copy(), np.zeros(n, dtype=np.int64)
    for k in range(1, spread):
        other = grams[k : k + n]
        less = other < least
        np.copyto(least, other, where=less)
        at[less] = k
    at += np.arange(n)
    start = np.flatnonzero(whole)
    if not len(start):
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    text = words.text[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[start][1:] != at[start][:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    count = np.diff(np.append(heads, len(start)))
    first = start[heads]
    return least[first], words.text[first], first - words.first[words.text[first]], count


class Automaton:
    """Suffix automaton of word strings, each added from the root."""

    __slots__ = ("steps", "link", "length")

    def __init__(self):
        self.steps, self.link, self.length = [{}], [-1], [0]

    def add(self, words: list[bytes]) -> None:
        steps, link, length = self.steps, self.link, self.length
        last = 0
        for word in words:
            to = steps[last].get(word)
            if to is not None and length[to] == length[last] + 1:
                last = to
                continue
            if to is None:
                state = len(steps)
                steps.append({})
                link.append(0)
                length.append(length[last] + 1)
            else:
                state = None
            up = last
            while state is not None and up != -1 and word not in steps[up]:
                steps[up][word] = state
                up = link[up]
            if up != -1:
                to = steps[up][word]
                if length[to] != length[up] + 1:
                    copy = len(steps)
                    steps.append(steps[to].copy())
                    link.append(link[to])
                    length.append(length[up] + 1)
                    while up != -1 and steps[up].get(word) == to:
                        steps[up][word] = copy
                        up = link[up]
                    link[to] = copy
                    to = copy
                if state is not None:
                    link[state] = to
            last = to if state is None else state

    def matched(self, words: list[bytes], window: int) -> np.ndarray:
        """Whether a match of ``window`` words or more ends at each word."""
        steps, link, length = self.steps, self.link, self.length
        state = match = 0
        ends = np.zeros(len(words), dtype=bool)
        for k, word in enumerate(words):
            to = steps[state].get(word)
            while to is None and state:
                state = link[state]
                match = length[state]
                to = steps[state].get(word)
            if to is not None:
                state = to
                match += 1
                if match >= window:
                    ends[k] = True
        return ends


class Shard:
    """One shard: feed stretches by doc_id, get the spans of words that earlier documents hold."""

    def __init__(self, window: int):
        self.window, self.automaton, self.seen, self.wait = window, Automaton(), {}, []

    def spans(self, doc: int, text: bytes):
        """``(first, count)`` of words in the stretch; stretches of one document do not count for each other."""
        if self.wait and self.wait[0][0] != doc:
            for _, stretch in self.wait:
                self.automaton.add(stretch)
            self.wait = []
        words = text.split(b" ")
        if self.seen.setdefault(text, doc) != doc:
            return [(0, len(words))]
        ends = self.automaton.matched(words, self.window)
        new = np.flatnonzero(~ends[self.window - 1 :])
        for a, b in _runs(new):
            self.wait.append((doc, words[a : b + self.window - 1]))
        return [(a, b - a + self.window - 1) for a, b in _runs(np.flatnonzero(ends[self.window - 1 :]))]


def _runs(at: np.ndarray):
    """Half-open runs of consecutive numbers."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut + 1)].tolist(), (at[np.append(cut, len(at) - 1)] + 1).tolist()))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, shard_runs: int = SHARD_RUNS) -> DataFrame:
    """``docs`` with ``text`` reduced to its kept words, joined by one blank, and ``n_words, n_removed`` added.

    Columns of these two names in ``docs`` are replaced; all others stay.  A word goes if a window that covers it also starts in a document of a smaller
    ``doc_id``, both judged on the input.  Null texts have no words and stay null; texts shorter than a window and
    rows without ``doc_id`` lose nothing and remove nothing.  Rows of one ``doc_id`` do not count for each other.  Texts of any length are read whole; an
    empty table gives an empty result.  A row is known by its id and a 64-bit hash of its text, so only two texts of one id could be taken for each other.
    """
    small_batches(docs.sparkSession)
    kept_columns = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    rest = [c for c in kept_columns if c not in ("doc_id", "text")]
    source = docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0).alias("none")]).alias("rest"),
    )
    named = source.where("doc_id IS NOT NULL")
    run = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int32()), ("windows", pa.int16())])
    seen = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64())])
    stretch = pa.schema([("shard", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("ats", pa.list_(pa.int32())), ("words", pa.binary()), ("hot", pa.bool_())])
    span = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("spans", pa.list_(pa.struct([("at", pa.int32()), ("count", pa.int32())])))])

    span_ddl = "row long, doc_id long, spans array<struct<at: int, count: int>>"

    def marks(batches):
        for part in slices(batches):
            hashes, text, _, _ = anchors(Words(*utf8(part.column("text"))), window, gram)
            yield rows_of(seen, [hashes.view(np.int64), part.column("doc_id").take(pa.array(text))])

    def places(batches):
        for part in slices(batches):
            hashes, text, at, count = anchors(Words(*utf8(part.column("text"))), window, gram)
            own = pa.array(text)
            for a, b in _pieces(len(hashes)):
                yield rows_of(run, [hashes[a:b].view(np.int64), part.column("row").take(own[a:b]), part.column("doc_id").take(own[a:b]), at[a:b], count[a:b]])

    def compress(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            blobs = [pack(t.as_buffer()) if t.is_valid else None for t in part.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), pa.array(blobs, pa.binary()), part.column("rest")], names=["row", "doc_id", "packed", "rest"])

    def cut(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, size = [], 0
            for row, doc, blob, found in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "packed", "found")]):
                words, hot_ats = unpack(blob).split(), {}
                for shard, at, count, is_hot in _stretches(found):
                    part = b" ".join(words[at : at + count + window - 1])
                    if is_hot:  # a text that the row repeats goes once, with all its places
                        hot_ats.setdefault(part, []).append(at)
                    else:
                        rows.append((shard, row, doc, [at], part, False))
                    size += len(part)
                rows += [(0, row, doc, ats, part, True) for part, ats in hot_ats.items()]
                if size > 1 << 20:
                    yield rows_of(stretch, list(zip(*rows)))
                    rows, size = [], 0
            if rows:
                yield rows_of(stretch, list(zip(*rows)))

    def windows_of(batches):
        schema = pa.schema([("words", pa.binary()), ("k", pa.int32()), ("window", pa.binary()), ("first", pa.int64())])
        for batch in batches:
            rows = []
            for text, doc in zip(batch.column("words").to_pylist(), batch.column("first").to_pylist()):
                words = text.split(b" ")
                rows += [(text, k, b" ".join(words[k : k + window]), doc) for k in range(len(words) - window + 1)]
            if rows:
                yield rows_of(schema, list(zip(*rows)))

    def held_before(batches):
        for batch in batches:
            rows = []
            for row, doc, ats, firsts in zip(*[batch.column(c).to_pylist() for c in ("row", "doc_id", "ats", "firsts")]):
                gone = np.array(sorted(f["k"] for f in firsts if f["first"] < doc), dtype=np.int64)
                if len(gone):
                    rows.append((row, doc, _spans([(at + a, b - a + window - 1) for at in ats for a, b in _runs(gone)])))
            if rows:
                yield rows_of(span, list(zip(*rows)))

    def match(batches):
        shard, now = None, None
        for batch in batches:
            rows = []
            for key, row, doc, ats, text in zip(*[c.to_pylist() for c in batch.columns]):
                if key != now:
                    shard, now = Shard(window), key
                found = [(ats[0] + a, n) for a, n in shard.spans(doc, text)]
                if found:
                    rows.append((row, doc, _spans(found)))
            if rows:
                yield rows_of(span, list(zip(*rows)))

    rest_field = source.schema["rest"]
    result = T.StructType([*T.StructType.fromDDL("row long, doc_id long, text string, n_words long, n_removed long").fields, rest_field])

    def remove(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            at, size, blobs = 0, 0, batch.column("packed")
            texts, words_in, removed = [], [], []
            for k, (blob, spans) in enumerate(zip(blobs, batch.column("spans").to_pylist())):
                words = unpack(blob.as_py()).split() if blob.is_valid else []
                keep = np.ones(len(words), dtype=bool)
                for s in spans or ():
                    keep[s["at"] : s["at"] + s["count"]] = False
                kept = b" ".join(np.array(words, dtype=object)[keep]) if not keep.all() else b" ".join(words)
                texts.append(kept if blob.is_valid else None)
                words_in.append(len(words))
                removed.append(int(len(words) - keep.sum()))
                size += len(kept)
                if size > 4 << 20 or k + 1 == len(blobs):
                    part = batch.slice(at, k + 1 - at)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("row"), part.column("doc_id"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(words_in, pa.int64()), pa.array(removed, pa.int64()), part.column("rest")],
                        names=["row", "doc_id", "text", "n_words", "n_removed", "rest"],
                    )
                    at, size, texts, words_in, removed = k + 1, 0, [], [], []

    firsts = named.select("doc_id", "text").mapInArrow(released(marks), "anchor long, doc_id long")
    firsts = firsts.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("times"))
    # Written, as it is read twice and small beside what it comes from.
    firsts = written(firsts.where("first < last").select("anchor", "first", "times", (F.col("times") > hot).alias("hot")), "anchors")
    loads = firsts.where("NOT hot").groupBy("first").agg(F.sum("times").alias("runs")).where(F.col("runs") > shard_runs)
    parts = loads.select("first", F.ceil(F.col("runs") / shard_runs).alias("parts"))
    own = F.when(F.col("parts").isNull() | F.col("hot"), F.col("first")).otherwise(F.xxhash64("first", F.pmod("anchor", F.col("parts"))))
    firsts = firsts.join(parts, "first", "left").select("anchor", own.alias("first"), "hot")
    placed = named.select("row", "doc_id", "text").mapInArrow(released(places), "anchor long, row long, doc_id long, at int, windows short")
    found = placed.join(firsts, "anchor").groupBy("row", "doc_id").agg(F.collect_set(F.struct("at", "windows", "first", "hot")).alias("found"))
    packed = source.mapInArrow(released(compress), T.StructType([*T.StructType.fromDDL("row long, doc_id long, packed binary").fields, rest_field]))
    parts = packed.join(found, ["row", "doc_id"]).select("row", "doc_id", "packed", "found")
    stretches = written(parts.mapInArrow(released(cut), "shard long, row long, doc_id long, ats array<int>, words binary, hot boolean"), "stretches")
    cold = stretches.where("NOT hot").drop("hot").repartition("shard").sortWithinPartitions("shard", "doc_id", "row", "ats")
    spans = cold.mapInArrow(released(match), span_ddl)
    shared = stretches.where("hot").select("row", "doc_id", "ats", "words")
    texts = shared.groupBy("words").agg(F.min("doc_id").alias("first"))
    each = texts.mapInArrow(released(windows_of), "words binary, k int, window binary, first long")
    earliest = each.groupBy("window").agg(F.min("first").alias("first"))
    firsts = each.drop("first").join(earliest, "window").groupBy("words").agg(F.collect_list(F.struct("k", "first")).alias("firsts"))
    again = shared.join(firsts, "words").mapInArrow(released(held_before), span_ddl)
    spans = written(spans.union(again), "spans")
    removal = spans.groupBy("row", "doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    joined = packed.join(removal, ["row", "doc_id"], "left").select("row", "doc_id", "packed", "spans", "rest")
    done = joined.mapInArrow(released(remove), result)
    fields = {"doc_id": F.col("doc_id"), "text": F.col("text")} | {c: F.col(f"rest.`{c}`") for c in rest}
    types = dict(docs.dtypes)
    return done.select(*[fields[c].cast(types[c]).alias(c) for c in kept_columns], "n_words", "n_removed")


def _spans(found: list[tuple[int, int]]) -> list[dict]:
    """Spans in order, with those that touch made one."""
    out: list[dict] = []
    for at, count in sorted(found):
        if out and at <= out[-1]["at"] + out[-1]["count"]:
            out[-1]["count"] = max(out[-1]["count"], at + count - out[-1]["at"])
        else:
            out.append({"at": at, "count": count})
    return out


def _pieces(n: int, size: int = 100_000):
    return [(k, min(k + size, n)) for k in range(0, n, size)]


def _stretches(found: list[dict]):
    """Consecutive windows of one shard in one stretch; of hot anchors, each run by itself."""
    out: list[list] = []
    for f in sorted(found, key=lambda f: f["at"]):
        if out and not f["hot"] and not out[-1][3] and out[-1][0] == f["first"] and out[-1][1] + out[-1][2] == f["at"]:
            out[-1][2] += f["windows"]
        else:
            out.append([f["first"], f["at"], f["windows"], f["hot"]])
    return out
