"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for each length, the polynomial of its first code points modulo a prime, for two bases.  The difference of two
entries, divided by the power at which it starts, is the hash of the span between them, so any two spans of any two texts are compared in constant time, and
the longest common extension of two places is found by binary search over its length.  Equal spans always have equal hashes; different ones of
length n agree with a chance of about (n / 2**31)**2.

Arrays are kept as one entry per block and built inside a block when asked, so a text needs 4 bytes per code point besides one block.

A fingerprint holds: the number of code points, the hash of the whole text, hashes of prefixes and of suffixes of a fixed ladder of lengths, and the least
hashes of all spans of ``WIDTH``.  Likeness is the larger of two estimates: the share of common spans, and the share covered by common prefix and suffix,
found by binary search on the ladders.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import rows_of, slices
from ferrywork.llm.textcodes import mixed

PRIME, BASES = (1 << 31) - 1, (1_203_187_921, 817_504_253)
BLOCK, WIDTH, LEAST, STEPS = 1 << 16, 16, 64, 4
_P, _BITS = np.uint64(PRIME), np.uint64(31)


def _folded(x: np.ndarray) -> np.ndarray:
    """``x`` itself, brought down by a multiple of the prime."""
    high = x >> _BITS
    x &= _P
    x += high
    return x


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` itself modulo the prime, for values below 2**63."""
    x = _folded(_folded(x))
    return np.minimum(x, x - _P, out=x)  # the difference wraps round to a great number where x is below


def _table(base: int) -> np.ndarray:
    """Powers of ``base`` modulo the prime, enough for a block and a span; each doubling is one product."""
    powers = np.ones(1, dtype=np.uint64)
    while len(powers) <= BLOCK + WIDTH:
        powers = np.concatenate((powers, _reduced(powers * np.uint64(pow(base, len(powers), PRIME)))))
    return powers


_UP, _DOWN = [_table(b) for b in BASES], [_table(pow(b, -1, PRIME)) for b in BASES]


def _sums(codes: np.ndarray, k: int) -> np.ndarray:
    """Prefix array of at most a block and a span, for base ``k``."""
    terms = codes.astype(np.uint64)
    terms += np.uint64(1)
    terms *= _UP[k][: len(codes)]
    out = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(_folded(terms), out=out[1:])
    return _reduced(out)


def _down(k: int, at: np.ndarray) -> np.ndarray:
    """Powers of the inverse of base ``k``: how a difference of entries is brought back to the beginning."""
    blocks, inverse = at // BLOCK, int(_DOWN[k][1])
    low = _DOWN[k][at % BLOCK]
    if not blocks.any():
        return low
    known = {b: pow(inverse, b * BLOCK, PRIME) for b in np.unique(blocks).tolist()}
    return _reduced(low * np.array([known[b] for b in blocks.tolist()], dtype=np.uint64))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class PrefixHashes:
    """Prefix array of one text; spans are half-open, in code points."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.size = codes, len(codes)
        self.marks, self._kept = [(0, 0)], (-1, None)
        for k in range(0, self.size - BLOCK + 1, BLOCK):
            self.marks.append(tuple(int(x[-1]) for x in self._block(k // BLOCK)))

    def _block(self, number: int) -> list[np.ndarray]:
        """Entries ``number * BLOCK`` to ``(number + 1) * BLOCK``."""
        if self._kept[0] != number:
            start = number * BLOCK
            codes = self.codes[start : start + BLOCK]
            sums = [_sums(codes, k) for k in (0, 1)]
            if number:
                sums = [_reduced(_reduced(sums[k] * np.uint64(pow(BASES[k], start, PRIME))) + np.uint64(self.marks[number][k])) for k in (0, 1)]
            self._kept = (number, sums)
        return self._kept[1]

    def upto(self, at: int) -> tuple[int, int]:
        """The array's entry: hash of the first ``at`` code points, for both bases."""
        number = at // BLOCK
        if at % BLOCK == 0:
            return self.marks[number]
        return tuple(int(x[at - number * BLOCK]) for x in self._block(number))

    def span(self, start: int, end: int) -> int:
        """Hash of the span, wherever it stands; spans of one length are compared by it."""
        a, b = self.upto(start), self.upto(end)
        high, low = ((y - x) * pow(base, -start, PRIME) % PRIME for base, x, y in zip(BASES, a, b))
        return high << 31 | low

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hashes of many spans at once."""
        total = np.zeros(len(starts), dtype=np.uint64)
        for k in (0, 1):
            difference = _reduced(self._entries(k, ends) + _P - self._entries(k, starts))
            total = total << _BITS | _reduced(difference * _down(k, starts))
        return total

    def _entries(self, k: int, at: np.ndarray) -> np.ndarray:
        if self.size < BLOCK:
            return self._block(0)[k][at]
        found = np.zeros(len(at), dtype=np.uint64)
        numbers = at // BLOCK
        for number in np.unique(numbers).tolist():
            own = numbers == number
            found[own] = self._block(number)[k][at[own] - number * BLOCK]
        return found

    def common(self, other: PrefixHashes, at: int = 0, other_at: int = 0) -> int:
        """Longest common extension to the right of the two places, by binary search over its length."""
        low, high = 0, min(self.size - at, other.size - other_at)
        same = (lambda n: self.upto(n) == other.upto(n)) if at == other_at == 0 else (lambda n: self.span(at, at + n) == other.span(other_at, other_at + n))
        while low < high:
            middle = (low + high + 1) // 2
            if same(middle):
                low = middle
            else:
                high = middle - 1
        return low

    def common_back(self, other: PrefixHashes, at: int, other_at: int) -> int:
        """Longest common extension to the left of the two places."""
        low, high = 0, min(at, other_at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.span(at - middle, at) == other.span(other_at - middle, other_at):
                low = middle
            else:
                high = middle - 1
        return low

    def least_spans(self, width: int = WIDTH, count: int = LEAST) -> np.ndarray:
        """The ``count`` least of the distinct hashes, of the first base, of all spans of ``width``; of a shorter text, of its one span."""
        width = min(width, self.size)
        found = np.zeros(0, dtype=np.uint32)
        if not width:
            return found
        for start in range(0, self.size - width + 1, BLOCK):
            sums = self._block(0)[0] if self.size < BLOCK else _sums(self.codes[start : start + BLOCK + width - 1], 0)
            spans = sums[width:] + _P
            spans -= sums[:-width]
            spans *= _DOWN[0][: len(spans)]
            values = (mixed(_reduced(spans)) >> np.uint64(32)).astype(np.uint32)
            least = np.unique(np.partition(values, 4 * count)[: 4 * count]) if len(values) > 8 * count else np.unique(values)
            if len(least) < count:
                least = np.unique(values)
            found = np.unique(np.concatenate((found, least[:count])))[:count]
        return found


def _rungs(size: int) -> list[int]:
    lengths, step, at = [], 1, 1
    while at <= size:
        lengths.append(at)
        if at == 2 * STEPS * step:
            step *= 2
        at += step
    return lengths


_LADDER = _rungs(1 << 40)


def ladder(size: int) -> list[int]:
    """Lengths up to ``size``: all small ones, then ``STEPS`` to each doubling."""
    return _LADDER[: bisect_right(_LADDER, size)]


def fingerprint(hashes: PrefixHashes) -> str:
    n, none = hashes.size, np.zeros(1, dtype=np.int64)
    lengths = np.array(ladder(n), dtype=np.int64)
    ends = np.concatenate((none + n, lengths, np.full(len(lengths), n)))
    starts = np.concatenate((none, np.zeros(len(lengths), dtype=np.int64), n - lengths))
    found = hashes.spans(starts, ends)
    marks = _short(found[1:]).tobytes().hex()
    return f"{n:x}-{int(found[0]):016x}-{marks[: len(marks) // 2]}-{marks[len(marks) // 2 :]}-" + hashes.least_spans().astype(">u4").tobytes().hex()


def _short(values: np.ndarray) -> np.ndarray:
    """32 mixed bits of 62-bit hashes, big-endian."""
    return (values * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(">u4")


def _marks(text: str) -> list[str]:
    return [text[k : k + 8] for k in range(0, len(text), 8)]


def _agreeing(a: list[str], b: list[str]) -> int:
    """Longest length of the ladder at which the marks agree; where they agree, they do at all shorter ones."""
    shared = min(len(a), len(b))
    k = bisect_left(range(shared), True, key=lambda k: a[k] != b[k])
    return _LADDER[k - 1] if k else 0


def likeness(a: str, b: str) -> float:
    """Estimated share, 0 to 1, of what two texts have in common, from their fingerprints; 1 for equal ones, 0 where just one text is empty."""
    if a == b:
        return 1.0
    (n, _, heads, tails, spans), (m, _, other_heads, other_tails, other_spans) = a.split("-"), b.split("-")
    n, m = int(n, 16), int(m, 16)
    if not n or not m:
        return 0.0
    covered = _agreeing(_marks(heads), _marks(other_heads)) + _agreeing(_marks(tails), _marks(other_tails))
    own, others = set(_marks(spans)), set(_marks(other_spans))
    both = sorted(own | others)
    if max(len(own), len(others)) == LEAST:
        both = both[:LEAST]
    shared = sum(x in own and x in others for x in both) / len(both)
    return max(min(covered, n, m) / max(n, m), 2 * shared / (1 + shared))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of each row of ``docs``.

    A null text is empty; repeated rows are kept; a null ``doc_id`` stays null; texts of any length are read whole.  An empty table gives an empty result.
    Other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for part in slices(batches):
            found = [PrefixHashes(code_points(t or "")) for t in part.column("text").to_pylist()]
            yield rows_of(schema, [part.column("doc_id"), [h.size for h in found], [fingerprint(h) for h in found]])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def common_extensions(pairs: DataFrame) -> DataFrame:
    """``pairs`` (``left_text, left_at, right_text, right_at`` and other columns) with ``common``: the longest common extension to the right, in code points.

    Null texts are empty, null places 0; places beyond the end have no extension.  A column ``common`` in ``pairs`` is replaced.
    """
    kept = pairs.drop("common")
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + ["common long"])

    def run(batches):
        for part in slices(batches, "left_text"):
            found = []
            for left, i, right, j in zip(*[part.column(c).to_pylist() for c in ("left_text", "left_at", "right_text", "right_at")]):
                a, b = PrefixHashes(code_points(left or "")), PrefixHashes(code_points(right or ""))
                i, j = i or 0, j or 0
                found.append(a.common(b, i, j) if 0 <= i <= a.size and 0 <= j <= b.size else 0)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.int64())], names=[*part.schema.names, "common"])

    return kept.mapInArrow(run, ddl)


EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_edited", pa.int64()), ("common_next", pa.int64()),
])
EDITED_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with the columns of ``EDITED_DDL``.

    The edited text has its last half (rounded down) replaced by as much of the beginning of the next document, in descending ``doc_id``; the first follows the
    last.  ``near_*`` compare fingerprints; ``common_*`` are the common prefixes with the edited and the next text, by binary search on the prefix arrays.

    Rows without ``doc_id`` come after all others; rows of one ``doc_id`` stand by size and hash of the text; equal rows are rows of their own.  A null text is
    empty.  One document follows itself.  An empty table gives an empty result.  Other columns are not read.

    Documents are dealt by ranges of ``doc_id`` and shuffled once, compressed; the first documents of a range also go to the range before it, so no
    neighbour is lost at an edge.  Rows of one ``doc_id`` stay in one range, through which they are streamed one by one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    wanted = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = F.array(*[F.lit(k / wanted) for k in range(1, wanted)])
    cuts = np.unique(np.array(docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 10 * wanted))).first()[0] or [], dtype=np.int64))

    def range_of(ids: pa.Array) -> np.ndarray:
        found = len(cuts) - np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left")
        return np.where(ids.is_null().to_numpy(zero_copy_only=False), len(cuts) + 1, found)

    def tops(batches):
        schema = pa.schema([("part", pa.int32()), ("doc_id", pa.int64())])
        for batch in batches:
            parts, ids = range_of(batch.column(0)), batch.column(0)
            for part in np.unique(parts).tolist():
                own = ids.filter(pa.array(parts == part)).drop_null()
                yield rows_of(schema, [[part], [max(own.to_pylist(), default=None)]])

    first = {r.part: r.doc_id for r in docs.select("doc_id").mapInArrow(tops, "part int, doc_id long").groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()}
    order = sorted(first)
    peeked = {first[part]: order[k - 1] for k, part in enumerate(order)}  # the range that sees this document as its last neighbour
    sent = pa.schema([("part", pa.int32()), ("peek", pa.bool_()), ("doc_id", pa.int64()), ("size", pa.int64()), ("hash", pa.int64()), ("packed", pa.binary())])

    def packed(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for part in slices(batches):
            rows = []
            for number, doc, text in zip(range_of(part.column("doc_id")).tolist(), part.column("doc_id").to_pylist(), part.column("text").fill_null("").cast(pa.binary()).to_pylist()):
                row = (doc, len(text), xxhash.xxh64_intdigest(text) - (1 << 63), pack(text))
                rows.append((number, False, *row))
                if doc in peeked:
                    rows.append((peeked[doc], True, *row))
            yield rows_of(sent, list(zip(*rows)))

    def compared(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        before, done = None, []
        for batch in batches:
            for peek, doc, blob in zip(batch.column("peek"), batch.column("doc_id"), batch.column("packed")):
                if peek.as_py() and before is None:
                    continue  # another of the rows that share the peeked id
                text = unpack(blob.as_py()).decode()
                hashes = PrefixHashes(code_points(text))
                own = (doc.as_py(), text, hashes, fingerprint(hashes))
                if before is not None:
                    done.append(_pair(before, own))
                before = None if peek.as_py() else own
                if len(done) == 200:
                    yield rows_of(EDITED, list(zip(*done)))
                    done = []
        if done:
            yield rows_of(EDITED, list(zip(*done)))

    dealt = docs.mapInArrow(packed, "part int, peek boolean, doc_id long, size long, hash long, packed binary").repartition(max(1, len(order)), "part")
    return dealt.sortWithinPartitions("part", "peek", F.desc_nulls_last("doc_id"), "size", "hash").mapInArrow(compared, EDITED_DDL)


def _pair(own: tuple, following: tuple) -> tuple:
    doc, text, hashes, print_ = own
    half = hashes.size // 2
    keep = hashes.size - half
    edited = PrefixHashes(np.concatenate((hashes.codes[:keep], following[2].codes[:half])))
    edited_print = fingerprint(edited)
    digest = hashlib.sha256((text[:keep] + following[1][:half]).encode()).hexdigest()
    common = hashes.common(edited), hashes.common(following[2])
    return doc, hashes.size, digest, print_, edited_print, likeness(print_, edited_print), likeness(print_, following[3]), *common
