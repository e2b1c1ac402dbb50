"""Benchmark passages in documents, found by spaced seeds.

A seed is a fixed mask over words on end: some count, some are ignored, so a word that was replaced
hides no more than the seeds that count it.  Items of no more than ``window`` words get further masks,
until one is hit whichever words are replaced, as many as the rule lets be; items of fewer than five words
may have none replaced and are looked for as they are.  Benchmark and documents are hashed under
the masks and joined on the hash, by Spark; documents pass a screen of the benchmark's hashes first, a bit
table of fixed size.  Around every hit the two texts are laid side by side word by word, and a document
is contaminated by an item if in some window of ``window`` words (or of the whole item, if shorter) at
least ``percent`` of the words are equal.

Words are runs of ASCII letters and digits and of non-ASCII characters, in lower case.

Cases with a defined result: a null or empty text or item has no words and meets nothing; items with
equal texts are all reported, an item that is repeated whole counts once, one with a null item_id counts
and is not listed; rows that share a doc_id are each looked at on their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .rows import unused
from .storage import stored

_SCREEN_BITS = 25  # of the bit table; each key sets two bits
_BROADCAST_ROWS = 500_000  # of two numbers each


@dataclass(frozen=True)
class SeedParams:
    masks: tuple[str, ...] = ("111111", "1101100101", "1011010011", "1110010101")  # 1: the word counts
    window: int = 13
    percent: int = 80

    @property
    def span(self) -> int:
        return max(map(len, self.masks))


def _missing(n: int, masks: list[np.ndarray], params: SeedParams) -> list[np.ndarray]:
    """Masks for items of ``n`` words: with ``masks``, one is hit whichever words are replaced, as many as may be."""
    replaced = n * (100 - params.percent) // 100
    counted = [set((mask + k).tolist()) for mask in masks for k in range(n - int(mask[-1]))]
    left = [set(c) for c in combinations(range(n), replaced) if all(seed & set(c) for seed in counted)]
    out = []
    while left:
        ignored = set(left[0])
        for pattern in left[1:]:  # one mask for several, as long as six words count
            if n - len(ignored | pattern) >= 6:
                ignored |= pattern
        left = [pattern for pattern in left if not pattern <= ignored]
        out.append(np.array([k for k in range(n) if k not in ignored]))
    return out


@lru_cache(maxsize=256)
def item_masks(n: int, params: SeedParams) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of ``n`` words, as places that count."""
    base = [np.flatnonzero([c == "1" for c in mask]) for mask in params.masks]
    if n > params.window:
        found = base
    elif n >= params.span:
        found = base + _missing(n, base, params)
    elif n * (100 - params.percent) // 100:  # one word may be another
        found = [m for m in base if int(m[-1]) < n] + [np.delete(np.arange(n), k) for k in range(n)]
    else:
        found = [np.arange(n)]
    return tuple(dict.fromkeys(tuple((m - m[0]).tolist()) for m in found))


def _seed_keys(hashes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """Key at each place from which the mask fits into ``hashes``; other masks give other keys."""
    count = len(hashes) - mask[-1]
    if count <= 0:
        return np.empty(0, np.uint64)
    number = sum(1 << place for place in mask)
    key = np.full(count, words.mix(np.array([number & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0], dtype=np.uint64)
    for place in mask:
        key = (key + hashes[place:place + count]) * np.uint64(0x9E3779B97F4A7C15)
    return words.mix(key)


def _word_hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text."""
    for block in words.blocks(pc.utf8_lower(texts)):
        found = words.words(block, words.NON_ALPHANUMERIC)
        hashes = words.rolling(block).of(found.starts, found.ends)
        for row in range(block.count):
            yield block.rows.start + row, hashes[found.first[row]:found.first[row + 1]]


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_twin, n, hashes) of each distinct item with words: its word hashes as bytes."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [h for _, h in _word_hashes(batch.column("text"))]
            yield pa.record_batch({
                "item_id": batch.column("item_id"), "item_twin": batch.column("item_twin"),
                "n": pa.array([len(h) for h in own], pa.int32()), "hashes": pa.array([h.tobytes() for h in own], pa.binary())})

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return (rows.withColumn("item_twin", F.xxhash64("text")).filter("text IS NOT NULL")
            .mapInArrow(read, "item_id long, item_twin long, n int, hashes binary").filter("n > 0")
            .dropDuplicates(["item_id", "item_twin"]))


def item_seeds(items: DataFrame, params: SeedParams) -> DataFrame:
    """(key, item_id, item_twin, item_place) of all seeds of :func:`benchmark_items`."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, raw in enumerate(batch.column("hashes")):
                own = np.frombuffer(raw.as_buffer(), np.uint64)
                found = [_seed_keys(own, mask) for mask in item_masks(len(own), params)]
                keys = np.concatenate(found)
                same = lambda c: pa.array([batch.column(c)[row].as_py()] * len(keys), pa.int64())  # noqa: E731, B023
                yield pa.record_batch({
                    "key": pa.array(keys.view(np.int64)), "item_id": same("item_id"), "item_twin": same("item_twin"),
                    "item_place": pa.array(np.concatenate([np.arange(len(k), dtype=np.int32) for k in found]))})

    return items.mapInArrow(read, "key long, item_id long, item_twin long, item_place int")


def _slots(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - _SCREEN_BITS)
    return ((key >> shift).astype(np.int64), (words.mix(key) >> shift).astype(np.int64))


def screen(seeds: DataFrame) -> np.ndarray:
    """Bit table of all keys.  Its bits are set by Spark; the driver gets the table, which has a fixed size."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.concatenate(_slots(batch.column("key").to_numpy().view(np.uint64)))
            yield pa.record_batch({"cell": pa.array((slot >> 6).astype(np.int32)), "bit": pa.array(
                (np.uint64(1) << (slot & 63).astype(np.uint64)).view(np.int64))})

    cells = (seeds.select("key").mapInArrow(read, "cell int, bit long")
             .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(1 << (_SCREEN_BITS - 6), dtype=np.uint64)
    out[cells.column("cell").to_numpy()] = cells.column("bits").to_numpy().view(np.uint64)
    return out


def _passes(table: np.ndarray, key: np.ndarray) -> np.ndarray:
    found = np.ones(len(key), dtype=bool)
    for slot in _slots(key):
        found &= (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
    return found


def document_seeds(docs: DataFrame, masks: tuple[tuple[int, ...], ...], table: np.ndarray) -> DataFrame:
    """(key, doc_id, twin, place) of the seeds of ``docs`` (doc_id, twin, text) that pass the screen; narrow."""
    shared = docs.sparkSession.sparkContext.broadcast((masks, table))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks, table = shared.value
        for batch in batches:
            for block in words.blocks(pc.utf8_lower(batch.column("text"))):
                found = words.words(block, words.NON_ALPHANUMERIC)
                hashes = words.rolling(block).of(found.starts, found.ends)
                keys, places = [], []
                for mask in masks:
                    key = _seed_keys(hashes, mask)
                    at = np.flatnonzero(_passes(table, key))
                    doc = np.searchsorted(found.first, at, side="right") - 1
                    at = at[at + mask[-1] < found.first[doc + 1]]  # the seed ends in the document it starts in
                    keys.append(key[at])
                    places.append(at)
                at = np.concatenate(places) if places else np.empty(0, np.int64)
                doc = np.searchsorted(found.first, at, side="right") - 1
                rows = pa.array(doc + block.rows.start)
                key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
                yield pa.record_batch({
                    "key": pa.array(key.view(np.int64)), "doc_id": batch.column("doc_id").take(rows),
                    "twin": batch.column("twin").take(rows), "place": pa.array((at - found.first[doc]).astype(np.int32))})

    return docs.mapInArrow(read, "key long, doc_id long, twin long, place int")


def _best(own: np.ndarray, item: np.ndarray, offset: int, window: int) -> float:
    """Largest share of equal words in a window of the item, its first word beside word ``offset``."""
    equal = np.zeros(len(item), dtype=np.int64)
    low, high = max(0, -offset), min(len(item), len(own) - offset)
    equal[low:high] = own[low + offset:high + offset] == item[low:high]
    window = min(window, len(item))
    sums = np.concatenate([[0], np.cumsum(equal)])
    return int((sums[window:] - sums[:-window]).max()) / window


def _verify(params: SeedParams):
    """Verified (doc_id, twin, item_id, item_twin, share) of rows in which each text stands before its hits."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.empty(0, np.uint64)
        for batch in batches:
            texts = dict(_word_hashes(batch.column("text")))
            out: list[tuple] = []
            columns = [batch.column(c).to_pylist() for c in ("kind", "doc_id", "twin", "item_id", "item_twin", "offset", "hashes")]
            for row, (kind, doc_id, twin, item_id, item_twin, offset, hashes) in enumerate(zip(*columns)):
                if kind == 0:
                    own = texts[row]
                    continue
                share = _best(own, np.frombuffer(hashes, np.uint64), offset, params.window)
                if 100 * share >= params.percent - 1e-9:
                    out.append((doc_id, twin, item_id, item_twin, share))
            made = list(zip(*out)) if out else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.record_batch([pa.array(v, k) for v, k in zip(made, kinds)],
                                  names=["doc_id", "twin", "item_id", "item_twin", "share"])

    return read


def found_items(texts: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """(doc_id, twin, n_items, items, overlap) of the contaminated ones among ``texts`` (doc_id, twin, text).

    Hits of a passage that many documents share are dealt by document after the join; in the join
    itself a hot key meets the few seeds of the items that have it.
    """
    items = stored(benchmark_items(benchmark), "items")
    seeds = stored(item_seeds(items, params), "item-seeds")
    sizes = [r.n for r in items.select(F.least("n", F.lit(params.window + 1)).alias("n")).distinct().collect()]
    masks = tuple(dict.fromkeys(m for n in sorted(sizes) for m in item_masks(n, params)))
    mine = document_seeds(texts, masks, screen(seeds))
    hits = stored(mine.join(seeds, "key").select(
        "doc_id", "twin", "item_id", "item_twin", (F.col("place") - F.col("item_place")).alias("offset")).distinct(), "hits")
    here = hits.select(F.col("doc_id").alias("id"), F.col("twin").alias("own")).distinct()
    if here.count() <= _BROADCAST_ROWS:
        here = F.broadcast(here)
    wanted = texts.join(here, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("own")), "left_semi")
    known = items.select(F.col("item_id").alias("i"), F.col("item_twin").alias("t"), "hashes")
    beside = hits.join(known, F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_twin") == F.col("t"))).drop("i", "t")
    none = {c: F.lit(None).cast(k) for c, k in (("item_id", "long"), ("item_twin", "long"), ("offset", "int"), ("hashes", "binary"))}
    rows = (wanted.dropDuplicates(["doc_id", "twin"]).select("doc_id", "twin", F.lit(0).alias("kind"), "text", *[v.alias(c) for c, v in none.items()])
            .unionByName(beside.withColumn("kind", F.lit(1)).withColumn("text", F.lit(None).cast("string"))))
    verified = (rows.repartition("doc_id", "twin").sortWithinPartitions("doc_id", "twin", "kind")
                .mapInArrow(_verify(params), "doc_id long, twin long, item_id long, item_twin long, share double"))
    return verified.groupBy("doc_id", "twin").agg(
        F.count_distinct(F.struct("item_id", "item_twin")).alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("items"), F.max("share").alias("overlap"))


def contamination(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """(doc_id, n_items, items, overlap, contaminated) of each row of ``docs`` (doc_id, text).

    ``items`` are the ids of the items found, ``overlap`` the largest share of equal words in a window,
    0 for clean documents.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "twin", F.xxhash64("text"))
    found = stored(found_items(texts, benchmark, params), "found").withColumnsRenamed({"doc_id": "id", "twin": "own"})
    rows = texts.select("doc_id", "twin").join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("twin") == F.col("own")), "left")
    return rows.select("doc_id", F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
                       F.coalesce("items", F.array().cast("array<long>")).alias("items"),
                       F.coalesce("overlap", F.lit(0.0)).alias("overlap"), F.col("n_items").isNotNull().alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, params: SeedParams = SeedParams()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that have no benchmark passage, with their columns."""
    id_, own = unused(docs, "found_id"), unused(docs, "found_twin")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn(
        "twin", F.xxhash64("text"))
    gone = stored(found_items(texts, benchmark, params).select(F.col("doc_id").alias(id_), F.col("twin").alias(own)), "found")
    # two numbers a row: while they are few, the texts need not be shuffled
    gone = F.broadcast(gone) if gone.count() <= _BROADCAST_ROWS else gone.hint("shuffle_hash")
    return docs.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.xxhash64(F.col("text").cast("string")) == F.col(own)), "left_anti")
