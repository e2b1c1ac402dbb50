"""Words of whole texts as numpy arrays, a block of documents at a time.

A block is a stretch of an Arrow column: its bytes, and the byte offsets of its documents.
Blocks hold whole documents and about :data:`BLOCK_BYTES`, so memory is bounded by that or
by the longest single document.  All hashes are 64-bit and the same in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

# ASCII white space; and every ASCII character that is neither letter nor digit
WHITE_SPACE = bytes([0x20, *range(0x09, 0x0E)])
NON_ALPHANUMERIC = bytes(c for c in range(128) if not chr(c).isalnum())

# Odd; powers of it walk through many residues.
_BASE = 0x9E3779B97F4A7C15 | 3


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown by doubling and kept."""
    global _UP, _DOWN
    while len(_UP) < n:
        k = len(_UP)
        up = np.uint64(pow(_BASE, k, 1 << 64))
        down = np.uint64(pow(pow(_BASE, -1, 1 << 64), k, 1 << 64))
        _UP, _DOWN = np.concatenate([_UP, _UP * up]), np.concatenate([_DOWN, _DOWN * down])
    return _UP, _DOWN


_UP = _DOWN = np.ones(1, dtype=np.uint64)
_FOLD = np.arange(256)
_FOLD[65:91] += 32
_EXACT_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_VALUES = _EXACT_VALUES[_FOLD]


class Block(NamedTuple):
    rows: slice  # documents of the batch
    data: np.ndarray  # uint8
    offsets: np.ndarray  # int64, one more than documents

    @property
    def count(self) -> int:
        return len(self.offsets) - 1


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield Block(slice(start, end), data[offsets[start]:offsets[end]], offsets[start:end + 1] - offsets[start])
        start = end


class Words(NamedTuple):
    starts: np.ndarray  # byte positions in the block
    ends: np.ndarray
    first: np.ndarray  # index of each document's first word; one more than documents

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _separators(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[np.frombuffer(chars, dtype=np.uint8)] = True
    return table


_TABLES = {chars: _separators(chars) for chars in (WHITE_SPACE, NON_ALPHANUMERIC)}


def words(block: Block, separators: bytes = WHITE_SPACE) -> Words:
    """Maximal runs of bytes that are no separators; no word spans two documents."""
    table = _TABLES.get(separators)
    gap = (_separators(separators) if table is None else table)[block.data]
    n = len(gap)
    edge = np.zeros(n + 1, dtype=bool)
    edge[block.offsets] = True
    before, after = edge.copy(), edge
    before[0] = after[n] = True
    before[1:] |= gap
    after[:-1] |= gap
    inside = ~gap
    starts = np.flatnonzero(inside & before[:-1])
    ends = np.flatnonzero(inside & after[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, block.offsets))


class Rolling(NamedTuple):
    """Hashes of any byte ranges of a block."""
    sums: np.ndarray
    down: np.ndarray

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts])


def rolling(block: Block, fold: bool = True) -> Rolling:
    """Rolling hashes of a block, A-Z folded to a-z if ``fold``."""
    up, down = _powers(len(block.data) + 1)
    sums = np.zeros(len(block.data) + 1, dtype=np.uint64)
    np.cumsum((_VALUES if fold else _EXACT_VALUES)[block.data] * up[:len(block.data)], out=sums[1:])
    return Rolling(sums, down)


def shingles(hashes: np.ndarray, found: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``size`` words on end, and the index of each document's first one.

    A document with fewer words (but any) has one shingle of all its words.
    """
    counts = found.counts
    per_doc = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(per_doc)])
    at = np.arange(first[-1]) + np.repeat(found.first[:-1] - first[:-1], per_doc)
    left = np.repeat(found.first[1:], per_doc) - at  # words from here to the document's end
    out = hashes[at] if len(at) else np.empty(0, np.uint64)
    for k in range(1, size):
        more = left > k
        if more.all():
            out = mix(out + np.uint64(k)) + hashes[at + k]
        else:
            out = out.copy()
            out[more] = mix(out[more] + np.uint64(k)) + hashes[at[more] + k]
    return mix(out), first


def distinct_in_documents(values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each document, and the index of each document's first."""
    parts, counts = [], np.zeros(len(first), dtype=np.int64)
    for i in range(len(first) - 1):
        part = np.sort(values[first[i]:first[i + 1]])
        if len(part) > 1:
            part = part[np.concatenate([[True], part[1:] != part[:-1]])]
        parts.append(part)
        counts[i + 1] = len(part)
    return (np.concatenate(parts) if parts else values[:0]), np.cumsum(counts)
