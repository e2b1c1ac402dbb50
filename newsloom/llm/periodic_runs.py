"""Runs of words that repeat with a period, by recursive frequency splitting and a lag scan.

A run that holds its period three times holds each of its words three times.  So a word that occurs
less often in a segment is in no run of that segment, and splits it; the counts of the parts are
smaller, and splitting goes on until no word is rare in its segment.  Natural text falls apart in a
few rounds.  What survives is scanned by lags: short ones one by one, over all words at once; of
periods from B to 2 B - 1, every run holds a block of B words that starts at a multiple of B and comes
again one period later, so the block is compared with the B places behind it, one comparison per
word and doubling of B, and what agrees is extended both ways by binary search over prefix hashes.
Extents are checked word by word in the end.

Cases with a defined result: a null or empty text has no words and no runs; a null doc_id has no hash, so
its words stay as they are; rows are judged one by one, so repeated rows get equal results; texts of any
length take n log n steps.  Other columns are not read.  Narrow: no shuffle.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

_BASE = 0x9E3779B97F4A7C15 | 3
_ROUNDS = 64  # of splitting; what is left then is scanned as it is, which gives the same runs


@dataclass(frozen=True)
class RunParams:
    least: int = 24  # words of a run
    times: int = 3  # that its period goes into it
    short: int = 16  # lags below are scanned one by one; a power of two


class Runs(NamedTuple):
    """Maximal runs, by start, then period."""
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


_NO_RUNS = Runs(*(np.empty(0, dtype=np.int64) for _ in range(3)))


def surviving_segments(ids: np.ndarray, bounds: np.ndarray, params: RunParams = RunParams()) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what frequency splitting leaves of the stretches between ``bounds``."""
    starts, ends = bounds[:-1], bounds[1:]
    stable: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(_ROUNDS):
        long = ends - starts >= params.least
        starts, ends = starts[long], ends[long]
        if not len(starts):
            break
        size = ends - starts
        first = np.cumsum(size) - size
        segment = np.repeat(np.arange(len(starts)), size)
        at = np.arange(len(segment)) + np.repeat(starts - first, size)
        order = np.lexsort((ids[at], segment))
        value, owner = ids[at[order]], segment[order]
        new = np.concatenate([[True], (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])])
        group = np.flatnonzero(new)
        count = np.diff(np.append(group, len(order)))
        rare = np.empty(len(order), dtype=bool)
        rare[order] = np.repeat(count < params.times, count)
        split = np.zeros(len(starts), dtype=bool)
        split[segment[rare]] = True
        stable.append((starts[~split], ends[~split]))
        # parts between rare words, of the segments that have any
        inside = ~rare & split[segment]
        edge = np.concatenate([[True], segment[1:] != segment[:-1]])
        begins = inside & (edge | ~np.concatenate([[False], inside[:-1]]))
        finishes = inside & (np.append(edge[1:], True) | ~np.append(inside[1:], False))
        starts, ends = at[begins], at[finishes] + 1
    else:
        stable.append((starts, ends))
    starts, ends = (np.concatenate(x) if stable else np.empty(0, np.int64) for x in (
        [s for s, _ in stable], [e for _, e in stable]))
    order = np.argsort(starts, kind="stable")
    return starts[order], ends[order]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, dtype=np.uint64)
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
    return out[:n]


class _Hashed:
    """Hashes of all stretches of a sequence."""

    def __init__(self, ids: np.ndarray):
        self.n = len(ids)
        self.sums = np.zeros(self.n + 1, dtype=np.uint64)
        np.cumsum(words.mix(ids.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, self.n), out=self.sums[1:])
        self.down = _powers(pow(_BASE, -1, 1 << 64), self.n + 1)

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.down[start]

    def forward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree from ``x`` and ``y`` > x on."""
        low, high = np.zeros(len(x), dtype=np.int64), self.n - y
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(x, mid) == self.of(y, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def backward(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words agree before ``x`` and ``y`` > x."""
        low, high = np.zeros(len(x), dtype=np.int64), x.copy()
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self.of(x - mid, mid) == self.of(y - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def _stretches(ids: np.ndarray, lag: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of ``least`` words or more in which words ``lag`` apart are equal."""
    same = ids[:-lag] == ids[lag:]
    step = np.diff(np.concatenate([[False], same, [False]]).astype(np.int8))
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1) + lag
    long = end - start >= least
    return start[long], end[long]


def lag_scan(ids: np.ndarray, params: RunParams = RunParams()) -> Runs:
    """All runs of a sequence."""
    n = len(ids)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def keep(start, end, period):
        found.append((start, end, np.broadcast_to(np.asarray(period, dtype=np.int64), start.shape)))

    for lag in range(1, min(params.short, n // params.times + 1)):
        keep(*_stretches(ids, lag, max(params.least, params.times * lag)), lag)
    hashed = _Hashed(ids) if n >= params.times * params.short else None
    block = params.short
    while params.times * block <= n:
        anchors = np.arange(0, n - 2 * block + 1, block)
        if found:  # inside a run of a shorter period other lags are multiples of it
            start, end, _ = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(start, kind="stable")
            reach = np.maximum.accumulate(end[order]) if len(order) else end
            before = np.searchsorted(start[order], anchors, side="right") - 1
            covered = (before >= 0) & (reach[np.maximum(before, 0)] >= anchors + 3 * block) if len(order) else before >= 0
            anchors = anchors[~covered]
        # hashes of a block of words from every place, and of places past the last one a value that none has
        at_all = hashed.of(np.arange(n - block + 1), block)
        hits_a, hits_lag = [], []
        rows = max(1, (1 << 20) // block)
        for i in range(0, len(anchors), rows):
            part = anchors[i:i + rows]
            place = part[:, None] + block + np.arange(block)
            equal = at_all[np.minimum(place, n - block)] == at_all[part][:, None]
            equal &= place <= n - block
            x, y = np.nonzero(equal)
            hits_a.append(part[x])
            hits_lag.append(block + y)
        if hits_a:
            a, lag = np.concatenate(hits_a), np.concatenate(hits_lag)
            start = a - hashed.backward(a, a + lag)
            end = a + lag + hashed.forward(a, a + lag)
            each = np.unique(np.stack([start, end, lag], axis=1)[end - start >= np.maximum(params.least, params.times * lag)], axis=0)
            if len(each):
                keep(*_checked(ids, each, params))
        block *= 2
    start, end, period = (np.concatenate(x) for x in zip(*found)) if found else _NO_RUNS
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    if len(start):  # of equal extents the smallest period
        first = np.concatenate([[True], (start[1:] != start[:-1]) | (end[1:] != end[:-1])])
        start, end, period = start[first], end[first], period[first]
    order = np.lexsort((period, start))
    return Runs(start[order], (end - start)[order], period[order])


def _checked(ids: np.ndarray, rows: np.ndarray, params: RunParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ``rows`` (start, end, lag) as they are word by word, of equal extents the smallest lag.

    Hashes only ever make a stretch too long.
    """
    out = []
    for start, end, lag in rows.tolist():
        if out and out[-1][:2] == (start, end):
            continue
        if (ids[start:end - lag] == ids[start + lag:end]).all():
            out.append((start, end, lag))
        else:
            low, high = _stretches(ids[start:end], lag, max(params.least, params.times * lag))
            out += [(start + a, start + b, lag) for a, b in zip(low.tolist(), high.tolist())]
    table = np.array(out, dtype=np.int64).reshape(-1, 3)
    return table[:, 0], table[:, 1], table[:, 2]


def runs_of_block(ids: np.ndarray, bounds: np.ndarray, params: RunParams = RunParams()) -> list[Runs]:
    """The runs of each stretch of ``ids`` between ``bounds``; starts count from the stretch's own."""
    out = [_NO_RUNS] * (len(bounds) - 1)
    starts, ends = surviving_segments(ids, bounds, params)
    if not len(starts):
        return out
    size = ends - starts
    # segments one after the other, with a word of its own after each
    first = np.cumsum(size + 1) - size - 1
    place = np.arange(size.sum()) + np.repeat(np.arange(len(size)), size)
    at = place + np.repeat(starts - first, size)
    line = np.empty(int(size.sum()) + len(size), dtype=np.int64)
    known, line[place] = np.unique(ids[at], return_inverse=True)
    line[first + size] = len(known) + np.arange(len(size))
    runs = lag_scan(line, params)
    owner = np.searchsorted(first, runs.start, side="right") - 1
    start = runs.start - first[owner] + starts[owner]
    document = np.searchsorted(bounds, start, side="right") - 1
    edges = np.searchsorted(document, np.arange(len(bounds)))
    for i in np.unique(document).tolist():
        here = slice(edges[i], edges[i + 1])
        order = np.lexsort((runs.period[here], start[here]))
        out[i] = Runs((start[here] - bounds[i])[order], runs.length[here][order], runs.period[here][order])
    return out


def strongest(runs: Runs) -> int:
    """Index of the run with the greatest length / period, then the smallest start, then period."""
    best = 0
    for i in range(1, len(runs.start)):  # in the order of ties already
        if int(runs.length[i]) * int(runs.period[best]) > int(runs.length[best]) * int(runs.period[i]):
            best = i
    return best


def dropped_words(runs: Runs, n: int) -> np.ndarray:
    """Words that are in a run behind its first period."""
    depth = np.zeros(n + 1, dtype=np.int64)
    np.add.at(depth, runs.start + runs.period, 1)
    np.add.at(depth, runs.start + runs.length, -1)
    return np.cumsum(depth[:-1]) > 0


def woven(doc_id: int | None, n: int) -> np.ndarray | None:
    """Places of the words of a document that the contract makes periodic; None where they stay."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def _judged(texts: list[bytes], wanted: list[np.ndarray | None], runs: list[Runs]) -> dict[str, list]:
    out: dict[str, list] = {name: [] for name in (
        "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for text, at, own in zip(texts, wanted, runs):
        parts = text.split()  # bytes: white space of ASCII, as in words.WHITE_SPACE
        if at is not None:
            parts = [parts[i] for i in at.tolist()]
        if len(own.start):
            best = strongest(own)
            shown = [int(x[best]) for x in own]
            shown.append(1000 * shown[1] // shown[2])
            parts = list(compress(parts, (~dropped_words(own, len(parts))).tolist()))
        else:
            shown = [None] * 4
        lines = "".join(f"{s},{k},{p}\n" for s, k, p in zip(*(x.tolist() for x in own)))
        for name, value in zip(out, [len(own.start), *shown, hashlib.sha256(lines.encode()).hexdigest(),
                                     hashlib.sha256(b" ".join(parts)).hexdigest()]):
            out[name].append(value)
    return out


_KINDS = [pa.int64()] * 5 + [pa.string()] * 2


def periodic_runs(docs: DataFrame, params: RunParams = RunParams(), weave: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): its runs, the strongest one, and the text without repeats.

    With ``weave``, documents are first made periodic as :func:`woven` says.  The digests are those of
    the list of runs, one `start,length,period` per line, and of the words that are left, joined by blanks.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                doc_ids = batch.column("doc_id").slice(block.rows.start, block.count)
                found = words.words(block, words.WHITE_SPACE)
                ids = words.rolling(block, fold=False).of(found.starts, found.ends)
                wanted = [woven(i, n) if weave else None for i, n in zip(doc_ids.to_pylist(), found.counts.tolist())]
                for k, at in enumerate(wanted):
                    if at is not None:
                        part = ids[found.first[k]:found.first[k + 1]]
                        part[:] = part[at]
                raw = block.data.tobytes()
                texts = [raw[a:b] for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist())]
                rows = _judged(texts, wanted, runs_of_block(ids, found.first, params))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids, *(pa.array(v, k) for v, k in zip(rows.values(), _KINDS))], names=["doc_id", *rows])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        read, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, "
              "runs_sha256 string, collapsed_sha256 string")
