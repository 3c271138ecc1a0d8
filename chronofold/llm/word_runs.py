"""Periodic runs of words by dyadic square catching.

Words are appended to one growing row. On level k every completed block of 2**k words has
a catcher: while the words 2**k to 2**(k+1) behind the block's start are appended, it
compares the row's suffix of 2**k words with the block. An equal suffix that starts q words
behind the block is a square of period q caught there. A stretch of period q and three
periods has a whole block and its copy inside on the level with 2**k <= q < 2**(k+1), so
none is missed. A caught square is widened word by word to the stretch that holds it; a
stretch that reaches the row's end stays open and grows with the words appended later, and
squares inside a known stretch merge into it.

If a square lies inside a stretch of a shorter period that is shorter than the block, its
own period is a multiple of that one (Fine and Wilf), so it is no run of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from chronofold.llm import words as W

APPEND = 1 << 18
"""Words appended at a time; any number gives the same runs."""

STEPS = 32
"""Words by which all caught squares widen together before the long ones go on alone."""

LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Level:
    """Catchers over the blocks of one length."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.suffixes = np.zeros(0, np.uint64)  # hash of the ``size`` words from each place on
        self.first = 0  # the place of suffixes[0]; older ones are never looked at again
        self.seen = 0  # places compared so far

    @property
    def end(self) -> int:
        return self.first + len(self.suffixes)

    def advance(self, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Take the hashes of further suffixes; places and periods of the squares caught."""
        self.suffixes = np.concatenate([self.suffixes, fresh])
        lo, hi, size = max(self.seen, self.size), self.end, self.size
        self.seen = max(self.seen, hi)
        if lo >= hi:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        blocks = np.arange(lo // size - 1, (hi - 1) // size)  # each catcher listens for one block's length
        known = self.suffixes[blocks * size - self.first]
        times = np.full(len(blocks), size)
        times[0] -= lo % size
        times[-1] -= blocks[-1] * size + 2 * size - hi
        caught = np.flatnonzero(np.repeat(known, times) == self.suffixes[lo - self.first : hi - self.first]) + lo
        start = (caught // size - 1) * size
        return start, caught - start

    def forget(self, upper: int) -> None:
        """Keep what the next comparison and the level above (from place ``upper`` on) need."""
        least = min((self.seen // self.size - 1) * self.size, upper, self.end)
        if least - self.first > self.size:
            self.suffixes, self.first = self.suffixes[least - self.first :].copy(), least


class Catchers:
    """All catchers over one row of words, given as 64-bit names."""

    def __init__(self) -> None:
        self.row = np.zeros(1 << 10, np.uint64)
        self.n = 0
        self.levels = [Level(1)]
        self.open: list[list[int]] = []  # [start, end, period] of stretches that reach the end
        self.closed: list[tuple[int, int, int]] = []
        self.latest: dict[int, tuple[int, int]] = {}

    def append(self, names: np.ndarray) -> None:
        if not len(names):
            return
        while len(self.row) < self.n + len(names):
            self.row = np.concatenate([self.row, np.zeros_like(self.row)])
        self.row[self.n : self.n + len(names)] = names
        self.n += len(names)
        growing, self.open = self.open, []
        for start, end, period in growing:
            self._keep(start, self._right(end - period, period), period)
        fresh, k = names, 0
        while len(fresh):
            level = self.levels[k]
            self._report(level.size, *level.advance(fresh))
            if k + 1 == len(self.levels):
                if level.end <= level.size:
                    break
                self.levels.append(Level(2 * level.size))
            above = self.levels[k + 1]
            lo, hi = above.end, level.end - level.size
            if lo < hi:
                a, b = (level.suffixes[x - level.first : x - level.first + hi - lo] for x in (lo, lo + level.size))
                fresh = W.mix(a * LEFT + W.mix(b + RIGHT))
            else:
                fresh = fresh[:0]
            level.forget(max(above.end, hi))
            k += 1

    def runs(self, shortest: int, periods: int) -> list[tuple[int, int, int]]:
        """(start, length, period) of the stretches so far that are long enough."""
        every = [*self.closed, *map(tuple, self.open)]
        return sorted((s, e - s, q) for s, e, q in every if e - s >= max(shortest, periods * q))

    def _keep(self, start: int, end: int, period: int) -> None:
        self.latest[period] = start, end
        if end == self.n:
            self.open.append([start, end, period])
        elif end - start >= 3 * period:
            self.closed.append((start, end, period))

    def _report(self, size: int, start: np.ndarray, period: np.ndarray) -> None:
        """Merge squares of this level into known stretches, or widen them to new ones."""
        if not len(start):
            return
        order = np.lexsort((start, period))
        start, period = start[order], period[order]
        fresh = np.ones(len(start), bool)
        fresh[1:] = (period[1:] != period[:-1]) | (start[1:] != start[:-1] + size)
        start, period = start[fresh], period[fresh]
        shorter = [s for s in (*self.closed, *self.open) if s[2] < size]
        if shorter:
            from_, to = np.array(shorter, np.int64)[:, :2].T
            order = np.argsort(from_, kind="stable")
            reach = np.append(-1, np.maximum.accumulate(to[order]))
            held = reach[np.searchsorted(from_[order], start, "right")] >= start + size + period
            start, period = start[~held], period[~held]
        low, high = self._widened(start, start + size, period)
        for s, lo, hi, q in zip(start.tolist(), low.tolist(), high.tolist(), period.tolist(), strict=True):
            a, b = self.latest.get(q, (0, 0))
            if a <= s and s + size + q <= b:
                continue
            self._keep(self._left(lo, q) if s - lo == STEPS else lo, self._right(hi, q) if hi - s - size == STEPS else hi + q, q)

    def _widened(self, low: np.ndarray, high: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Widen low..high-1, whose words equal those a period later, by at most STEPS words."""
        low, high, row = low.copy(), high.copy(), self.row
        left = right = np.arange(len(low))
        for _ in range(STEPS):
            left = left[low[left] > 0]
            left = left[row[low[left] - 1] == row[low[left] - 1 + period[left]]]
            low[left] -= 1
            right = right[high[right] + period[right] < self.n]
            right = right[row[high[right]] == row[high[right] + period[right]]]
            high[right] += 1
            if not len(left) and not len(right):
                break
        return low, high

    def _left(self, low: int, period: int) -> int:
        step = STEPS
        while low:
            at = max(0, low - step)
            other = np.flatnonzero(self.row[at:low] != self.row[at + period : low + period])
            if len(other):
                return at + int(other[-1]) + 1
            low, step = at, 2 * step
        return low

    def _right(self, high: int, period: int) -> int:
        """End of the stretch whose words before ``high`` equal those a period later."""
        step = STEPS
        while high + period < self.n:
            to = min(high + step, self.n - period)
            other = np.flatnonzero(self.row[high:to] != self.row[high + period : to + period])
            if len(other):
                return high + int(other[0]) + period
            high, step = to, 2 * step
        return self.n


def folded_places(doc_id: int, n: int) -> np.ndarray | None:
    """Which word stands at each place of a text that repeats its own words, null if none does."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % p
    return places


def _summary(runs: list[tuple[int, int, int]]) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2]))).encode()).hexdigest()
    if not runs:
        return 0, None, None, None, None, listed
    start, length, period = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return len(runs), start, length, period, 1000 * length // period, listed


SCHEMA = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>"
)


def find_runs(docs: DataFrame, *, shortest: int = 24, periods: int = 3, fold: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text), with the runs of its words.

    Words stand between ASCII white space and are numbered from 0. A run is a longest
    stretch with smallest period q of at least ``shortest`` words and ``periods`` (3 or
    more) periods; ``start``, ``length``, ``period`` and ``exponent_milli`` are those of the
    run with most periods (then the smallest start, then period), null if there is none.
    ``collapsed_sha256`` digests the words, joined by one space, that no run holds behind
    its first period. ``runs`` lists all. With ``fold`` some texts first repeat words of
    their own, as ``folded_places`` says; a null doc_id never does.

    A null or empty text has no words. Repeated rows give equal rows. A very long text is
    appended part by part; its words and one hash a level of each place stay in memory. An
    empty table gives no rows; other columns are not read.
    """
    if periods < 3:
        raise ValueError("periods must be at least 3")
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = W.text_bytes(batch.column(1))
            ids = batch.column(0).to_pylist()
            for lo, hi in W.row_slices(offsets):
                part = offsets[lo : hi + 1]
                columns = _slice(buf[part[0] : part[-1]], part - part[0], ids[lo:hi], shortest, periods, fold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *columns], NAMES)

    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {id_type}, {SCHEMA}")


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256", "runs"]


def _slice(buf: np.ndarray, offsets: np.ndarray, ids: list, shortest: int, periods: int, fold: bool) -> list[pa.Array]:
    """The columns behind doc_id for a run of texts, which are appended to one row of words."""
    names, starts, ends, bounds = W.word_hashes(buf, offsets, W.PLAIN)
    count = np.diff(bounds)
    places = np.arange(len(names))
    for i, doc in enumerate(ids if fold else []):
        if doc is not None and (own := folded_places(doc, int(count[i]))) is not None:
            places[bounds[i] : bounds[i + 1]] = bounds[i] + own
    # A word of its own stands behind each text, so that no square reaches over its end.
    row = np.insert(names[places], bounds[1:], W.mix(np.arange(1, len(ids) + 1, dtype=np.uint64) << np.uint64(40)))
    catchers = Catchers()
    for at in range(0, len(row), APPEND):
        catchers.append(row[at : at + APPEND])
    shifted = bounds[:-1] + np.arange(len(ids))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    gone = np.zeros(len(names) + 1, np.int64)
    for s, n, q in catchers.runs(shortest, periods):
        i = int(np.searchsorted(shifted, s, "right")) - 1
        s -= i
        runs[i].append((s - int(bounds[i]), n, q))
        gone[s + q] += 1
        gone[s + n] -= 1
    kept = np.flatnonzero(np.cumsum(gone[:-1]) == 0)
    source = places[kept]
    wide = ends[source] - starts[source] + 1  # a word and the space behind it
    before = np.append(0, np.cumsum(wide))
    cuts = np.searchsorted(kept, bounds)
    digests = []
    for a, b in _spans(cuts, before):
        joined = _joined(buf, starts[source[cuts[a] : cuts[b]]], wide[cuts[a] : cuts[b]])
        at = before[cuts[a : b + 1]] - before[cuts[a]]
        digests += [hashlib.sha256(joined[x : max(x, y - 1)]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    facts = list(zip(*map(_summary, runs), strict=True))
    columns = [pa.array(c, pa.int64()) for c in facts[:5]] + [pa.array(facts[5], pa.string()), pa.array(digests, pa.string())]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    listed = [[{"start": s, "length": n, "period": q} for s, n, q in sorted(r, key=lambda r: (r[0], r[2]))] for r in runs]
    return [*columns, pa.array(listed, kind)]


def _spans(cuts: np.ndarray, before: np.ndarray, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes left, or of one text that has more."""
    yield from W.row_slices(before[cuts], limit)


def _joined(buf: np.ndarray, starts: np.ndarray, wide: np.ndarray) -> memoryview:
    at = W.ragged(starts, wide)
    out = np.append(buf, np.uint8(32))[at]
    out[np.cumsum(wide) - 1] = 32
    return memoryview(out)
