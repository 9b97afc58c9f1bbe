"""Words, word windows and pre-tokens of many texts at once, as numpy offsets and hashes.

Texts arrive as one UTF-8 buffer with offsets, as Arrow holds them, so no Python object is made
per word.  Hashes are 64-bit polynomials; callers that need certainty compare the words behind them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

# Byte and code point classes, fixed values: white space that parts words, and Unicode's White_Space.
WORD_SPACE = b"\t\n\x0b\x0c\r "
UNICODE_SPACE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")

_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xC2B2AE3D27D4EB4F)
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[list(WORD_SPACE)] = False


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_known_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64; the longest rows so far are kept."""
    if base not in _known_powers or len(_known_powers[base][0]) < size:
        pair = []
        for b in (base, pow(base, -1, 2**64)):
            steps = np.full(size, b, dtype=np.uint64)
            steps[0] = 1
            pair.append(np.multiply.accumulate(steps))
        _known_powers[base] = (pair[0], pair[1])
    return _known_powers[base]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: np.uint64) -> np.ndarray:
    """Hash of ``values[start:end]`` for each run, equal for equal runs wherever they stand."""
    size = 1 << max(12, int(len(values)).bit_length())
    up, down = _powers(int(base), size)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
    found = (total[ends] - total[starts]) * down[starts]
    return mixed(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string array; a null text is an empty one."""
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


class Words:
    """The words of many texts: ``start``/``end`` bytes, ``hash``, and ``first[i]:first[i + 1]`` for text ``i``."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, hashes: bool = True):
        inside = np.zeros(len(raw) + 1, dtype=bool)
        inside[:-1] = _IS_WORD[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        edges = offsets[offsets < len(raw)]
        begins[edges] |= inside[edges]
        closes = np.zeros(len(raw) + 1, dtype=bool)
        closes[1:] = inside[:-1] & ~inside[1:]
        inner = offsets[(offsets > 0) & (offsets <= len(raw))]
        closes[inner] |= inside[inner - 1]
        self.raw, self.start, self.end = raw, np.flatnonzero(begins), np.flatnonzero(closes)
        self.first = np.searchsorted(self.start, offsets)
        self.text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = run_hashes(raw, self.start, self.end, _BYTE_BASE) if hashes else None

    def windows(self, size: int) -> np.ndarray:
        """Hash of each run of ``size`` words; a run that leaves its text is counted too, see :meth:`whole`."""
        count = max(0, len(self.start) - size + 1)
        at = np.arange(count)
        return run_hashes(self.hash, at, at + size, _WORD_BASE)

    def whole(self, size: int) -> np.ndarray:
        """Whether the run of ``size`` words that starts here stays within one text."""
        count = max(0, len(self.start) - size + 1)
        return self.text[:count] == self.text[size - 1 : size - 1 + count]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 number, 3 white space, for every code point."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for code in range(0x40000):  # Unicode has no letter or number beyond plane 3
        kind = unicodedata.category(chr(code))[0]
        table[code] = 1 if kind == "L" else 2 if kind == "N" else 0
    table[list(UNICODE_SPACE)] = 3
    return table


def pretokens(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where each pre-token starts, in code points, for texts at ``offsets`` of ``codes``.

    The rule, in order: a contraction; a run of letters, of numbers or of other signs, each with one
    blank before it if there is one; white space up to the last one before a word; other white space.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, dtype=np.int64)
    kind = _classes()[codes]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    space = kind == 3
    # The last white space of a run that a word follows stands alone, or with that word if it is a blank.
    last = np.zeros(n, dtype=bool)
    last[:-1] = space[:-1] & ~space[1:] & ~edge[1:-1]
    joins = last & (codes == 32)
    starts = change | last
    starts[1:] &= ~joins[:-1]
    # A contraction can only start where a run of other signs starts without its blank.
    quote = np.flatnonzero(starts & (codes == 39) & (kind == 0))
    if len(quote):
        bounds = offsets[np.searchsorted(offsets, quote, side="right")]
        for short in CONTRACTIONS:
            letters = [ord(c) for c in short]
            fits = quote + len(letters) <= bounds
            for k, letter in enumerate(letters):
                fits &= codes[np.minimum(quote + k, n - 1)] == letter
            at = quote[fits]
            starts[at + 1] = False
            after = at + len(letters)
            bound = bounds[fits]
            # What is left of the letters goes on as a run of its own; a mark ends it anyway.
            starts[after[after < bound]] = True
    return np.flatnonzero(starts)


def joined_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and where each begins."""
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32), offsets


class PreTokens:
    """The pre-tokens of many texts: ``start`` and ``length`` in ``codes``, and ``first[i]:first[i + 1]`` for text ``i``.

    ``hash`` and ``index`` are the distinct hashes, ascending, and a pre-token that stands for each; ``number`` is each pre-token's place among them.
    ``same`` tells whether all pre-tokens of equal hash are equal, which is found by comparing them.
    """

    def __init__(self, texts: list[str]):
        self.codes, offsets = joined_codes(texts)
        self.start = pretokens(self.codes, offsets)
        self.length = np.diff(self.start, append=len(self.codes))
        self.first = np.searchsorted(self.start, offsets)
        hashes = run_hashes(self.codes, self.start, self.start + self.length, _BYTE_BASE)
        self.hash, self.index, self.number = np.unique(hashes, return_index=True, return_inverse=True)
        self.same = same_runs(self.codes, self.start, self.length, self.index[self.number])


def distinct_pretokens(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pre-tokens, the number of each pre-token in reading order, and where each text begins in it.

    Pre-tokens are sorted out by hash, then each is compared with the one that stands for it; if any differs, all are told apart by their text.
    """
    cut = PreTokens(texts)
    whole = "".join(texts)
    if cut.same:
        words = [whole[a : a + n] for a, n in zip(cut.start[cut.index].tolist(), cut.length[cut.index].tolist())]
        return words, cut.number, cut.first
    numbers: dict[str, int] = {}
    own = (whole[a : a + n] for a, n in zip(cut.start.tolist(), cut.length.tolist()))
    inverse = np.fromiter((numbers.setdefault(word, len(numbers)) for word in own), dtype=np.int64, count=len(cut.start))
    return list(numbers), inverse, cut.first


def same_runs(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, like: np.ndarray) -> bool:
    """Whether each of the adjoining runs that make up ``codes`` equals the run of the number ``like``."""
    if (lengths != lengths[like]).any():
        return False
    kind = np.int32 if len(codes) < 2**31 else np.int64
    at = np.repeat((starts[like] - starts).astype(kind), lengths)
    at += np.arange(len(codes), dtype=kind)
    return bool((codes[at] == codes).all())


def gathered(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``values[first[i] : first[i] + count[i]]`` for all ``i``, in a row."""
    total = int(count.sum())
    if not total:
        return values[:0]
    shift = first - np.concatenate(([0], np.cumsum(count)[:-1]))
    return values[np.repeat(shift, count) + np.arange(total)]
