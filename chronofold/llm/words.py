"""Words and byte strings of many texts at once, as numpy arrays inside a task.

A text column arrives as one Arrow buffer of UTF-8 bytes. Everything here works on such a
buffer and on the offsets of its texts, so no Python object is made per word. Hashes are
64-bit polynomials over a fixed random table; the multiplier is odd, hence invertible, and
the hash of any byte range follows from two prefix sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
"""Bytes of text handled at a time; a longer text is cut at white space."""

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

MARKS = np.ones(256, bool)
"""ASCII characters that are neither letter nor digit: white space and marks."""
MARKS[128:] = False
for _lo, _hi in ((48, 58), (65, 91), (97, 123)):
    MARKS[_lo:_hi] = False

LETTERS = np.zeros(256, bool)
LETTERS[65:91] = True
LETTERS[97:123] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word (the finaliser of splitmix64)."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(seed: int, fold_case: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(seed << 32))
    if fold_case:
        table[65:91] = table[97:123]
    return table


PLAIN, FOLDED = byte_table(1, False), byte_table(1, True)
_powers: dict[str, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base**0 .. base**n; kept for ordinary slices only."""
    key = str(int(base))
    have = _powers.get(key)
    if have is None or len(have) <= n:
        out = np.full(max(n, SLICE) + 1, base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        if n > 4 * SLICE:
            return out
        _powers[key] = have = out
    return have


def prefix(buf: np.ndarray, table: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(table[buf] * powers(len(buf), base)[: len(buf)], out=out[1:])
    return out


def range_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    """Hash of bytes lo..hi-1 of the buffer ``sums`` was made from, wherever they stand."""
    inverse = INVERSE if base == BASE else np.uint64(pow(int(base), -1, 1 << 64))
    back = powers(len(sums), inverse)
    return mix((sums[hi] - sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its texts; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def row_slices(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes, or of one row that is longer."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def _pieces(buf: np.ndarray, offsets: np.ndarray, keep: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of at most ``keep`` bytes that end at a text's end or at white space."""
    lo, n = 0, len(buf)
    while lo < n:
        hi = min(lo + keep, n)
        if hi < n:
            end = int(offsets[np.searchsorted(offsets, hi, "right") - 1])
            if end > lo:
                hi = end
            else:
                space = np.flatnonzero(SPACES[buf[lo:hi]])
                while not len(space) and hi < n:
                    hi = min(hi + keep, n)
                    space = np.flatnonzero(SPACES[buf[lo:hi]])
                if len(space):
                    hi = lo + int(space[-1]) + 1
        yield lo, hi
        lo = hi


def word_edges(
    buf: np.ndarray, offsets: np.ndarray, cut_after_letters: bool = False, between: np.ndarray = SPACES
) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without bytes of ``between``, within texts.

    ``cut_after_letters`` ends a run also where an ASCII or Latin-1 letter is followed by
    an ASCII character that is neither letter nor digit.
    """
    n = len(buf)
    word = ~between[buf]
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | fresh[1:n]
    if cut_after_letters and n > 1:
        latin = (buf[1:] >= 0x80) & (buf[1:] <= 0xBF) & (buf[:-1] == 0xC3) & (buf[1:] != 0x97) & (buf[1:] != 0xB7)
        letter = LETTERS[buf]
        letter[1:] |= latin
        mark = (buf < 0x80) & ~LETTERS[buf] & word & ~((buf >= 48) & (buf <= 57))
        begin[1:] |= letter[:-1] & mark[1:]
    starts = np.flatnonzero(begin)
    stop = np.zeros(n + 1, bool)
    stop[1:n] = word[:-1] & (~word[1:] | begin[1:])
    if n:
        stop[n] = word[-1]
    return starts, np.flatnonzero(stop)


def word_hashes(
    buf: np.ndarray,
    offsets: np.ndarray,
    table: np.ndarray = FOLDED,
    cut_after_letters: bool = False,
    between: np.ndarray = SPACES,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of every word and the index of each text's first word."""
    hashes, starts, ends = [], [], []
    for lo, hi in _pieces(buf, offsets, SLICE):
        part = buf[lo:hi]
        inside = offsets[(offsets >= lo) & (offsets < hi)] - lo
        s, e = word_edges(part, inside, cut_after_letters, between)
        hashes.append(range_hash(prefix(part, table), s, e))
        starts.append(s + lo)
        ends.append(e + lo)
    if not hashes:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), start, np.concatenate(ends), np.searchsorted(start, offsets)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for each range, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
