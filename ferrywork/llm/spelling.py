"""Spelling variants by pivotal grams.

Words are compared within one edit.  Grams are ordered by how many words hold them, rare ones first; a word's prefix is its three rarest
bigrams and whatever else ranks no later than the third.  Of the prefix, dynamic programming picks two disjoint bigrams, the pivots, of least total
frequency.  One edit spoils at most one of two disjoint bigrams, so a near word holds one of them, and holds it in its own prefix if that prefix ends no
earlier in the order; of two near words, one has this relation to the other.  The edit is to the right of that bigram or to the left.  If to the right, the words agree
up to the bigram, which has not moved; if to the left, they agree from it on, and it has moved by the difference of the lengths.  Where the agreeing side is the shorter
one, the other side is halved, and one half of it agrees too.  So pivots are joined with prefixes on bigram, place, length and what agrees, which is half of the word or
more, and what meets is verified.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import rows_of, slices, written

LETTERS, EDITS, GRAM = "A-Za-zÀ-ÿ", 1, 2
LEAST_LENGTH, LEAST_COUNT, RATIO, THINNED = 7, 2, 10, 31
PIECE_CHARS, COUNTER_WORDS = 1 << 20, 100_000


def _pieces(text: str, run: re.Pattern):
    """A very long text in pieces that end where a run does."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        end = at + PIECE_CHARS
        tail = run.match(text, end)
        end = tail.end() if tail else end
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, thinned: int = THINNED) -> DataFrame:
    """``word, n``: the maximal letter runs of all texts, A-Z lower-cased, of ``least_length`` code points or more.

    A run whose crc32 of ``<doc_id>:<run>`` is a multiple of ``thinned`` loses the code point at crc32 modulo its length first.  A null text has no runs,
    a null ``doc_id`` is written as nothing, repeated rows count each, an empty table gives no words, other columns are not read.  Texts of any length are
    read whole; counts are added up per task before they are shuffled.
    """
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])
    letter = re.compile(f"[{LETTERS}]+")
    long_run = re.compile(f"[{LETTERS}]{{{least_length},}}")

    def counts(batches):
        total: Counter[str] = Counter()
        for part in slices(batches):
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                if not text:
                    continue
                own: Counter[str] = Counter()
                for piece in _pieces(text, letter):
                    own.update(long_run.findall(piece.encode().lower().decode()))
                begun = zlib.crc32(b"%s:" % (b"" if doc is None else b"%d" % doc))
                for run, n in own.items():
                    h = zlib.crc32(run.encode(), begun)
                    if h % thinned == 0:
                        k = h % len(run)
                        run = run[:k] + run[k + 1 :]
                        if len(run) < least_length:
                            continue
                    total[run] += n
            if len(total) > COUNTER_WORDS:
                yield rows_of(schema, [list(total), list(total.values())])
                total.clear()
        if total:
            yield rows_of(schema, [list(total), list(total.values())])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(places: list[int], weights: list[int], count: int = EDITS + 1, size: int = GRAM) -> list[int]:
    """``count`` of the ascending ``places``, pairwise ``size`` apart or more, of least total weight.

    Dynamic programming over how many places were seen and how many of them were taken; the earlier choice wins ties.
    """
    none = (float("inf"), ())
    best = [[(0, ())] + [none] * count]
    for k, place in enumerate(places):
        before = best[bisect_right(places, place - size, 0, k)]
        row = [best[-1][0]]
        for taken in range(1, count + 1):
            cost, chosen = before[taken - 1]
            row.append(min(best[-1][taken], (cost + weights[k], (*chosen, place)), key=lambda x: x[0]))
        best.append(row)
    return list(best[-1][count][1])


def signatures(word: str, held: dict[str, int], rank: dict[str, int]) -> tuple[list[tuple[str, int]], list[tuple[str, int]], int]:
    """Pivots and prefix of ``word``, as bigrams with places, and the rank at which the prefix ends.

    ``held`` says how many words hold a bigram, ``rank`` puts all bigrams in one order.
    """
    grams = [word[k : k + GRAM] for k in range(len(word) - GRAM + 1)]
    ranks = [rank[g] for g in grams]
    end = sorted(ranks)[GRAM * EDITS]
    places = [k for k, r in enumerate(ranks) if r <= end]
    chosen = pivots(places, [held[grams[k]] for k in places])
    return [(grams[k], k) for k in chosen], [(grams[k], k) for k in places], end


def agreements(word: str, place: int, size: int) -> list[tuple[str, int, int, str]]:
    """What a word of ``size``, at most one edit away, can agree in with ``word`` around the bigram at ``place`` of ``word``.

    Each is a kind of agreement, the bigram's place in the other word, ``size`` and the text that is equal; one of them holds for every edit that spares the bigram.
    """
    found, moved = [], size - len(word)
    end = place + GRAM
    if end <= size:  # the edit is to the right
        middle = end + (size - end) // 2
        if 2 * end >= size:
            found.append(("<", place, size, word[:end]))
        else:
            found += [("<<", place, size, word[:middle]), ("<>", place, size, f"{word[:end]}|{word[middle - moved :]}")]
    at = place + moved
    if at >= 0:  # the edit is to the left
        middle = at // 2
        if 2 * (size - at) >= size:
            found.append((">", at, size, word[place:]))
        else:
            found += [(">>", at, size, word[middle - moved :]), ("><", at, size, f"{word[:middle]}|{word[place:]}")]
    return found


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``a, a_n, b, b_n``: all pairs of distinct words of ``words`` (``word, n``) that differ by one edit, each in both directions.

    Words have at least ``least_length`` (4 or more) code points of a fixed alphabet; the table of bigrams that every task gets is bounded by its square.
    """
    grams = words.select(F.explode(F.expr(f"array_distinct(transform(sequence(1, length(word) - {GRAM - 1}), k -> substring(word, k, {GRAM})))")).alias("gram"))
    table = grams.groupBy("gram").agg(F.count("*").alias("words")).collect()  # bigrams of the alphabet, not of the data
    held = {r.gram: r.words for r in table}
    rank = {g: k for k, g in enumerate(sorted(held, key=lambda g: (held[g], g)))}
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("end", pa.int32()), ("pivot", pa.bool_())])

    def key(found: tuple) -> int:
        return xxhash.xxh64_intdigest("%s%d %d %s" % found) - (1 << 63)

    def signed(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 5000):
                rows = []
                for word, n in zip(*[c.to_pylist() for c in batch.slice(start, 5000).columns]):
                    chosen, prefix, end = signatures(word, held, rank)
                    size = len(word)
                    rows += [(key(x), word, n, end, False) for _, k in prefix for x in agreements(word, k, size)]
                    sizes = [m for m in (size - 1, size, size + 1) if m >= least_length]
                    rows += [(key(x), word, n, end, True) for _, k in chosen for m in sizes for x in agreements(word, k, m)]
                yield rows_of(schema, list(zip(*rows)))

    index = written(words.select("word", "n").mapInArrow(signed, "key long, word string, n long, end int, pivot boolean"), "grams")
    probe = index.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("end").alias("a_end"))
    held_by = index.where("NOT pivot").select("key", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("end").alias("b_end"))
    met = probe.join(held_by, "key").where(f"a_end <= b_end AND a <> b AND levenshtein(a, b, {EDITS}) = {EDITS}")
    pairs = met.select(F.least("a", "b").alias("a"), F.when(F.col("a") < F.col("b"), F.col("a_n")).otherwise(F.col("b_n")).alias("a_n"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("b_n")).otherwise(F.col("a_n")).alias("b_n"))
    pairs = pairs.distinct()
    return pairs.select(F.explode(F.array(F.struct("a", "a_n", "b", "b_n"), F.struct(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))).alias("p")).select("p.*")


def variants(words: DataFrame, ratio: int = RATIO, least_length: int = LEAST_LENGTH) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each row of ``words`` (distinct ``word`` with its ``n``).

    ``form`` is the near word of largest ``n`` (ties: the smallest) if it has ``ratio`` times the word's; ``root`` is where the forms end.
    Every step to a form multiplies ``n``, so there are no circles and a chain is at most logarithmic; it is halved by each join.
    """
    near = near_pairs(words, least_length).groupBy("a").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("minus_n"), "b")).alias("best"))
    joined = words.join(near.withColumnRenamed("a", "word"), "word", "left")
    enough = -F.col("best.minus_n") >= ratio * F.col("n")
    found = written(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.b")).alias("form"), F.when(enough, -F.col("best.minus_n")).alias("form_n")), "forms")
    steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(steps.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return found.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """:func:`variants` of the words of ``docs`` that are found ``least_count`` times or more.  An empty table gives no rows."""
    return variants(written(word_counts(docs).where(F.col("n") >= least_count), "words"))
