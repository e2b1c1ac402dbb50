"""Tokens of articles, grouped by term: which places a term has in which field.

A helper of one Arrow batch.  Its articles are cut into blocks by their number of tokens, so memory is
bounded by a block or the longest single article; in a block terms become numbers, which are sorted
with their article and field, and every stretch of equal ones is a posting.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .stemming import word_memo

BLOCK_TOKENS = 200_000


def blocks(batch: pa.RecordBatch, token_columns: list[int]) -> Iterator[pa.RecordBatch]:
    """Consecutive rows with about ``BLOCK_TOKENS`` tokens, one row at least."""
    tokens = sum(_sizes(batch.column(i)) for i in token_columns)
    block = (np.cumsum(tokens) - tokens) // BLOCK_TOKENS
    edges = np.flatnonzero(np.diff(block)) + 1
    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
        if end > start:
            yield batch.slice(start, end - start)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _strings(texts: pa.Array) -> list[str]:
    """As ``to_pylist``, which makes an object of Arrow for every text first."""
    return texts.to_numpy(zero_copy_only=False).tolist()


class Postings:
    """Tokens in, postings out: ``term, row, field, tf, positions, impact`` and lengths of the fields.

    ``code`` is the number of a posting's term among all ``terms`` of the block.

    ``stemmed`` says of each field whether its words are stemmed; ``only`` leaves out all other terms;
    ``impact`` (fields, frequencies, lengths) gives the part of a posting in the number of its block.
    """

    def __init__(self, stemmed: list[bool], only: list[str] | None, impact):
        self.stemmed, self.impact = stemmed, impact
        self.only = None if only is None else pa.array(only, pa.string())
        self.memo = word_memo(extended=False)

    def _coded(self, tokens: list[pa.Array]) -> tuple[np.ndarray, pa.Array]:
        """A number for each token, and the terms by number."""
        coded = pa.concat_arrays(tokens).dictionary_encode()
        codes, terms = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
        if not any(self.stemmed):
            return codes, terms
        own = np.repeat(self.stemmed, [len(t) for t in tokens])
        used = np.unique(codes[own])
        stems = pa.array([self.memo[w] for w in _strings(terms.take(pa.array(used)))], pa.string())
        every = pa.concat_arrays([terms, stems]).dictionary_encode()
        numbers = every.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        of_stem = np.zeros(len(terms), np.int64)
        of_stem[used] = numbers[len(terms):]
        return np.where(own, of_stem[codes], numbers[codes]), every.dictionary

    def of_block(self, lists: list[pa.Array]) -> dict:
        n_fields = len(lists)
        lengths = np.stack([_sizes(x) for x in lists])
        n_rows = lengths.shape[1]
        tokens = [x.flatten().cast(pa.string()) for x in lists]
        row = np.concatenate([np.repeat(np.arange(n_rows), n) for n in lengths])
        field = np.repeat(np.arange(n_fields), lengths.sum(axis=1))
        place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in lengths])
        codes, terms = self._coded(tokens)
        if self.only is not None:
            kept = np.asarray(pc.is_in(terms, value_set=self.only))[codes] if len(codes) else np.zeros(0, bool)
            row, field, place, codes = row[kept], field[kept], place[kept], codes[kept]
        key = (row * max(len(terms), 1) + codes) * n_fields + field
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        ends = np.append(first, len(key))
        row, field, codes, tf = row[order][first], field[order][first], codes[order][first], np.diff(ends)
        pair = key[first] // n_fields  # of a term and an article
        pair = np.cumsum(np.concatenate([np.zeros(min(len(pair), 1), bool), pair[1:] != pair[:-1]]))
        share = self.impact(field, tf, lengths[field, row])
        impact = np.bincount(pair, weights=share)[pair] if len(pair) else share
        return {"row": row, "field": field, "code": codes, "term": terms.take(pa.array(codes)), "terms": terms, "tf": tf.astype(np.int32),
                "positions": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(place[order].astype(np.int32))),
                "field_length": lengths[field, row].astype(np.int32), "impact": impact.astype(np.int32)}


def sorted_rows(own: dict, field_names: list[str], buckets: int) -> np.ndarray:
    """Places of the postings of a block by field name, bucket of the term, term and impact.

    Spark sorts what it gets as stretches that are in order already by merging them, which is a few comparisons
    of a row instead of one for each doubling of the rows of a task.
    """
    used = np.unique(own["code"])
    terms = own["terms"].take(pa.array(used))
    bucket = np.array([zlib.crc32(t.encode()) for t in _strings(terms)], np.int64) % buckets
    by_term = pc.sort_indices(terms.cast(pa.binary())).to_numpy()
    by_term = by_term[np.argsort(bucket[by_term], kind="stable")]
    place = np.empty(len(own["terms"]), np.int64)
    place[used[by_term]] = np.arange(len(used))
    of_field = np.argsort(np.argsort(field_names))[own["field"]]
    # of numbers below the fields, the terms of a block and the classes of impact: far below 2**63
    impact = own["impact"].astype(np.int64)
    top = int(impact.max(initial=0)) + 1
    return np.argsort((of_field * max(len(used), 1) + place[own["code"]]) * top + impact, kind="stable")
