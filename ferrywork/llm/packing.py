"""Sum-of-squares packing of tokenised documents into windows of fixed length.

Each task packs its own stream of documents: whole windows are cut off a long document at once, and what
is left goes to the fill level at which the sum of squared counts of partly filled windows comes out
smallest.  The level array holds one count and one stack of open windows per fill level, so its size depends on the window, not on the data.
When the stream ends, open windows are poured into each other; the last one is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrywork.llm.frames import released, rows_of, slices, small_batches
from ferrywork.llm.textcodes import PreTokens, distinct_pretokens, gathered, joined_codes

WINDOW, END_ID, CACHED_WORDS = 2048, 1, 300_000
PIECE = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
])
PIECE_DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


# The sign by which a byte-level tokenizer writes each byte; a blank is none of them.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_SIGNS = np.zeros(256, dtype="<u2")
_SIGNS[_PRINTED] = _PRINTED
_SIGNS[np.setdiff1d(np.arange(256), _PRINTED)] = 256 + np.arange(256 - len(_PRINTED))


class Runs:
    """Numbered runs of 32-bit values, one behind the other; the room for them doubles when it is full."""

    def __init__(self, values: np.ndarray, counts: np.ndarray):
        self.flat, self.ends, self.size = values, np.concatenate(([0], np.cumsum(counts, dtype=np.int64))), len(counts)

    def add(self, values: np.ndarray, counts: np.ndarray) -> None:
        used = self.ends[self.size]
        self.flat = _with_room(self.flat, used + len(values))
        self.flat[used : used + len(values)] = values
        self.ends = _with_room(self.ends, self.size + 1 + len(counts))
        self.ends[self.size + 1 : self.size + 1 + len(counts)] = used + np.cumsum(counts)
        self.size += len(counts)

    def where(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of these runs."""
        begin = self.ends[numbers]
        return begin, self.ends[numbers + 1] - begin

    def only(self, numbers: np.ndarray) -> Runs:
        begin, count = self.where(numbers)
        return Runs(gathered(self.flat, begin, count), count)


def _with_room(values: np.ndarray, size: int) -> np.ndarray:
    if size <= len(values):
        return values
    return np.concatenate((values, np.zeros(max(size, 2 * len(values)) - len(values), dtype=values.dtype)))


class WordEncoder:
    """Ids of texts by the file of a byte-level tokenizer; each distinct pre-token is encoded once while it is kept.

    Known words are found by hash and compared code point by code point.  Where two words of equal hash differ, the texts at hand are encoded without them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_file(path)
        if whole.normalizer is not None:
            raise ValueError("a tokenizer that changes a text before it is cut is not supported")
        # Words come already cut and written in signs, so only the merges are left to be done.
        self.tokenizer = Tokenizer(whole.model)
        self.tokenizer.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        vocabulary = whole.get_vocab()
        self.id_bytes = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        self.id_bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]  # one sign stands for one byte
        nothing = np.zeros(0, dtype="<u4")
        self.words, self.ids = Runs(nothing, nothing), Runs(nothing, nothing)
        self.hash, self.number = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)  # ascending, and whose hash it is
        self.again = np.zeros(0, dtype=bool)
        added = whole.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("added tokens that take white space or whole words only are not supported")
        self.added = {t.content: np.array([k], dtype="<u4") for k, t in added.items()}
        # The longest one where several begin; a text without any is one piece.
        longest = sorted(self.added, key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest))})").split if longest else lambda text: [text]

    def forget(self, room: int = 0) -> None:
        """Keep only words met in more than one call since the last time; none, where ``room`` more would still be too many."""
        numbers = np.flatnonzero(self.again)
        if len(numbers) + room > CACHED_WORDS:
            numbers = numbers[:0]
        renamed = np.full(len(self.again), -1)
        renamed[numbers] = np.arange(len(numbers))
        renamed = renamed[self.number]
        self.hash, self.number = self.hash[renamed >= 0], renamed[renamed >= 0]
        self.words, self.ids = self.words.only(numbers), self.ids.only(numbers)
        self.again = np.zeros(len(numbers), dtype=bool)

    def _learn(self, codes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new words that stand one behind the other, and how many each has; words end where the bytes of their ids do."""
        flat, counts = [], []
        ends = np.concatenate(([0], np.cumsum(lengths)))
        for k in range(0, len(lengths), 1000):
            bounds = ends[k : k + 1001]
            part = codes[bounds[0] : bounds[-1]]
            raw = np.frombuffer(part.tobytes().decode("utf-32-le").encode(), dtype=np.uint8)
            size = 1 + (part >= 0x80).astype(np.int64) + (part >= 0x800) + (part >= 0x10000)
            wanted = np.cumsum(size)[bounds[1:] - bounds[0] - 1]
            signs = np.insert(_SIGNS[raw], wanted[:-1], ord(" ")).tobytes().decode("utf-16-le")
            ids = np.array(self.tokenizer.encode_batch_fast([signs], add_special_tokens=False)[0].ids, dtype="<u4")
            reached = np.cumsum(self.id_bytes[ids])
            last = np.searchsorted(reached, wanted)
            if len(ids) != last[-1] + 1 or (reached[last] != wanted).any():
                raise ValueError("the tokenizer is not byte-level: its ids do not spell the words")
            flat.append(ids)
            counts.append(np.diff(last, prepend=-1))
        return np.concatenate(flat), np.concatenate(counts)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; added tokens are cut out first and have ids of their own."""
        parts = [self.cut(text) for text in texts]
        plain = iter(self._plain([p for x in parts for p in x[::2]]))
        return [next(plain) if len(x) == 1 else np.concatenate([self.added[p] if k % 2 else next(plain) for k, p in enumerate(x)]) for x in parts]

    def _numbers(self, cut: PreTokens) -> np.ndarray | None:
        """Numbers of the distinct pre-tokens, new ones learned; nothing where a word differs from a known one of its hash."""
        if len(self.again) + len(cut.hash) > CACHED_WORDS:
            self.forget(len(cut.hash))
        start, length = cut.start[cut.index], cut.length[cut.index]
        at = np.searchsorted(self.hash, cut.hash)
        known = np.zeros(len(at), dtype=bool)
        inside = at < len(self.hash)
        known[inside] = self.hash[at[inside]] == cut.hash[inside]
        numbers = np.empty(len(at), dtype=np.int64)
        numbers[known] = old = self.number[at[known]]
        begin, count = self.words.where(old)
        if (count != length[known]).any() or (gathered(self.words.flat, begin, count) != gathered(cut.codes, start[known], count)).any():
            return None
        self.again[old] = True
        new = ~known
        if new.any():
            codes = gathered(cut.codes, start[new], length[new])
            ids, counts = self._learn(codes, length[new])
            numbers[new] = own = len(self.again) + np.arange(len(counts))
            self.words.add(codes, length[new])
            self.ids.add(ids, counts)
            self.again = np.append(self.again, np.zeros(len(counts), dtype=bool))
            self.hash, self.number = np.insert(self.hash, at[new], cut.hash[new]), np.insert(self.number, at[new], own)
        return numbers

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        cut = PreTokens(texts)
        number, first, runs = cut.number, cut.first, self.ids
        numbers = self._numbers(cut) if cut.same and len(cut.hash) else None
        if numbers is not None:
            number, runs = numbers[number], self.ids
        elif len(cut.hash):
            words, number, first = distinct_pretokens(texts)
            codes, offsets = joined_codes(words)
            runs = Runs(*self._learn(codes, np.diff(offsets)))
        begin, count = runs.where(number)
        found = gathered(runs.flat, begin, count)
        ends = np.concatenate(([0], np.cumsum(count)))[first]
        return [found[a:b] for a, b in zip(ends[:-1], ends[1:])]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Level array of open windows; ``add`` and ``close`` give finished pieces as ``(doc, start, ids, doc_tokens, sequence, offset)``."""

    def __init__(self, window: int = WINDOW, first_sequence: int = 0):
        self.window, self.next = window, first_sequence
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: list[list[list]] = [[] for _ in range(window)]

    def level_for(self, size: int) -> int:
        """Fill level whose choice leaves the smallest sum of squares; the fullest one on ties, 0 for a new window."""
        count, top = self.count, self.window - size
        levels = np.flatnonzero(count[1 : top + 1]) + 1
        if not len(levels):
            return 0
        # Taking a window from level h and putting it on h + size changes the sum by 2 (N[h + size] - N[h] + 1).
        change = 2 * (count[levels + size] - count[levels] + 1)
        if levels[-1] == top:
            change[-1] = 1 - 2 * count[top]  # a full window is counted no more
        best = len(levels) - 1 - int(np.argmin(change[::-1]))
        return int(levels[best]) if change[best] <= 2 * count[size] + 1 else 0

    def add(self, doc, ids: np.ndarray):
        size, at = len(ids), 0
        while size - at >= self.window:
            yield doc, at, ids[at : at + self.window], size, self._sequence(), 0
            at += self.window
        rest = size - at
        if not rest:
            return
        level = self.level_for(rest)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.count[level] -= 1
        pieces.append((doc, at, ids[at:].copy(), size))
        if level + rest == self.window:
            yield from self._finished(pieces)
        else:
            self.open[level + rest].append(pieces)
            self.count[level + rest] += 1

    def _sequence(self) -> int:
        self.next += 1
        return self.next - 1

    def _finished(self, pieces):
        sequence, offset = self._sequence(), 0
        for doc, start, ids, size in pieces:
            yield doc, start, ids, size, sequence, offset
            offset += len(ids)

    def close(self):
        """Pour the open windows into each other, then cut what is left at powers of two."""
        pieces = [p for level in self.open for window in level for p in window]
        left = sum(len(p[2]) for p in pieces)
        sizes = [self.window] * (left // self.window)
        rest = left % self.window
        sizes += [1 << b for b in range(self.window.bit_length(), -1, -1) if rest >> b & 1]
        queue = iter(pieces)
        piece = None
        for size in sizes:
            filled, room = [], size
            while room:
                doc, start, ids, total = piece or next(queue)
                filled.append((doc, start, ids[:room], total))
                piece = (doc, start + room, ids[room:], total) if len(ids) > room else None
                room -= len(filled[-1][2])
            yield from self._finished(filled)
        self.open, self.count = [[] for _ in range(self.window)], np.zeros(self.window + 1, dtype=np.int64)


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids`` (little-endian 32-bit)``, doc_tokens, sequence_id, offset``.

    A null or empty text is a document of the end id alone.  Repeated rows are packed each for itself; a null
    ``doc_id`` stays null.  An empty table gives no pieces.  Other columns are not read.
    """

    def run(batches):
        packer = Packer(window, TaskContext.get().partitionId() << 40)
        ids_of = encoder(tokenizer_path)

        def rows(pieces):
            return rows_of(PIECE, [
                [p[0] for p in pieces], [p[1] for p in pieces], [len(p[2]) for p in pieces],
                [p[2].astype("<u4").tobytes() for p in pieces], *[[p[k] for p in pieces] for k in (3, 4, 5)],
            ])

        for part in slices(batches):
            texts = part.column(1).fill_null("").to_pylist()
            found = []
            for doc, ids in zip(part.column(0).to_pylist(), ids_of(texts)):
                found += packer.add(doc, np.append(ids, np.uint32(end_id)))
            if found:
                yield rows(found)
        found = list(packer.close())
        if found:
            yield rows(found)
        ids_of.forget()  # what was met again is left for the next task

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(released(run), PIECE_DDL)
