"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

SuperMinHash visits the components of a signature in an order that is a permutation of its own for
every element, with ranks that rise from visit to visit: the value of visit j lies in [j, j+1).  A
component that has a value below j cannot be improved by visit j, so the visits end as soon as
every component has one; large sets need one or two.  As no two visits of an element meet in a
component, signatures vary less than those of independent hashes.

Documents with equal sets are one node from the start.  Documents that agree in all rows of a band
meet in a bucket.  First everything in a bucket is compared, on full sets, with one pivot, the member
that meets most others: that connects most of a group, however large, by one link per member.  Where
a bucket still holds several components, its members join the group of its pivot, each once, however
many buckets they share.  A group is dealt over tiles of bounded size, in which the sizes of all
intersections come from a product of matrices; only what connects components leaves a tile.  So no
pairs are listed, and every pair of a bucket that could join two components is judged on full sets.

Cases with a defined result: a null or empty text has an empty set and is linked with nothing; a text
with fewer words than a shingle has one shingle of all its words; rows that share a doc_id share a
component; rows with a null doc_id are linked with nothing, their component is null and they are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .components import unite, components
from .rows import unused
from .storage import stored, stored_by_batches

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class NearDuplicateParams:
    shingle: int = 5  # words
    percent: int = 80  # of the union that two linked sets share at least
    size: int = 128  # components of a signature
    bands: int = 32  # of size / bands rows; a pair at 0.8 is in no common bucket with probability 5e-8
    tile: int = 1024  # members of a part of a group; a tile holds two parts at most
    tile_shingles: int = 2_000_000  # of a part


def signatures(values: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """SuperMinHash signatures, one row per document of distinct 64-bit ``values``.

    A component holds the visit in its upper 8 bits and the rank within it below.  Documents
    without values keep the largest value everywhere.
    """
    count = len(first) - 1
    out = np.full((count, size), _NONE)
    flat = out.reshape(-1)
    owner = np.repeat(np.arange(count), np.diff(first))
    base, live = owner * size, values
    order = None  # permutation of each live element, made when a second visit is needed
    for visit in range(size):
        if not len(live):
            break
        draw = words.mix(live ^ np.uint64(0xA0761D6478BD642F * (visit + 1) % (1 << 64)))
        swap = visit + ((draw >> np.uint64(40)) % np.uint64(size - visit)).astype(np.int64)
        if visit == 0:
            place = swap
            first_swap = swap
        else:
            if order is None:
                order = np.tile(np.arange(size, dtype=np.uint8 if size <= 256 else np.int32), (len(live), 1))
                each = np.arange(len(live))
                order[each, first_swap], order[:, 0] = 0, first_swap
            each = np.arange(len(live))
            place = order[each, swap].astype(np.int64)
            order[each, swap] = order[:, visit]
        rank = words.mix(draw) >> np.uint64(8)
        np.minimum.at(flat, base + place, (np.uint64(visit) << np.uint64(56)) | rank)
        open_docs = (out == _NONE).any(axis=1)
        keep = open_docs[owner]
        if not keep.all():
            owner, base, live = owner[keep], base[keep], live[keep]
            if order is None:
                first_swap = first_swap[keep]
            else:
                order = order[keep]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """A 64-bit key per document and band."""
    count, size = signature.shape
    rows = signature.reshape(count, bands, size // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (count, bands))
    for k in range(rows.shape[2]):
        key = words.mix(key ^ rows[:, :, k])
    return key


def _shingle_sets(block: words.Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    found = words.words(block, words.WHITE_SPACE)
    hashes = words.rolling(block).of(found.starts, found.ends)
    return words.distinct_in_documents(*words.shingles(hashes, found, size))


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signed(docs: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """(doc_id, n_shingles, set_key, buckets) of each row; narrow.  set_key is null without words."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text"), 4 * words.BLOCK_BYTES):
                values, first = _shingle_sets(block, params.shingle)
                keys = band_keys(signatures(values, first, params.size), params.bands).view(np.int64)
                counts = np.diff(first)
                raw = values.tobytes()
                names = [hashlib.blake2b(raw[8 * a:8 * b], digest_size=16).digest() if b > a else None
                         for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
                some = np.repeat(counts > 0, params.bands)
                offsets = np.concatenate([[0], np.cumsum(np.where(counts > 0, params.bands, 0))])
                yield pa.record_batch({
                    "doc_id": batch.column("doc_id").slice(block.rows.start, block.count),
                    "n_shingles": pa.array(counts, pa.int64()), "set_key": pa.array(names, pa.binary()),
                    "buckets": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys.ravel()[some]))})

    return _ids_and_texts(docs).mapInArrow(
        read, "doc_id long, n_shingles long, set_key binary, buckets array<long>")


def _sets_of(docs: DataFrame, ids: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """(id, members) with the sorted shingle hashes of the documents in ``ids``."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                values, first = _shingle_sets(block, params.shingle)
                raw = values.tobytes()
                yield pa.record_batch({
                    "id": batch.column("doc_id").slice(block.rows.start, block.count),
                    "members": pa.array([raw[8 * a:8 * b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())],
                                        pa.binary())})

    wanted = _ids_and_texts(docs).join(ids.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi")
    return wanted.mapInArrow(read, "id long, members binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shared, union = [], []
        for x, y in zip(batch.column("x"), batch.column("y")):
            x = np.frombuffer(x.as_buffer(), dtype=np.uint64)
            y = np.frombuffer(y.as_buffer(), dtype=np.uint64)
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
            shared.append(common)
            union.append(len(x) + len(y) - common)
        yield pa.record_batch({"a": batch.column("a"), "b": batch.column("b"),
                               "shared": pa.array(shared, pa.int64()), "total": pa.array(union, pa.int64())})


def verify(pairs: DataFrame, sets: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """(a, b, linked) of distinct ``pairs`` (a, b) of ids, on the full ``sets`` (id, members)."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b").select("a", "b", "x", "y"))
    compared = both.mapInArrow(_compare, "a long, b long, shared long, total long")
    return stored_by_batches(compared.select(
        "a", "b", (100 * F.col("shared") >= params.percent * F.col("total")).alias("linked")), "compared", 500)


def _may_link(n: Column, m: Column, params: NearDuplicateParams) -> Column:
    """False if the sizes alone rule a link out."""
    return 100 * F.least(n, m) >= params.percent * F.greatest(n, m)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    count = len(sets)
    shingle, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
    owner = np.repeat(np.arange(count), [len(x) for x in sets])
    shared = times[shingle] > 1
    column = (np.cumsum(times > 1) - 1)[shingle[shared]]
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((count, count), dtype=np.float32)
    width = 4096
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        low, high = np.searchsorted(column, [start, start + width])
        part = np.zeros((count, width), dtype=np.float32)
        part[owner[low:high], column[low:high] - start] = 1
        out += part @ part.T
    return out


def _judge_tile(side: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int):
    """Links between the components of a tile, one per component that others join."""
    size = np.array([len(x) for x in sets])
    shared = _overlaps(sets).astype(np.int64)
    apart = component[:, None] < component[None, :]
    if (side > 0).all():  # 1 and 2 are two parts of a group; pairs within a part have a tile of their own
        apart &= side[:, None] != side[None, :]
    x, y = np.nonzero(apart & (100 * shared >= percent * (size[:, None] + size[None, :] - shared)))
    return unite(component[x], component[y]) if len(x) else None


def _between(params: NearDuplicateParams):
    """Links between components, of tiles whose rows come one after the other."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now = None

        def judged():
            if len({c for _, c, _ in held}) > 1:
                found = _judge_tile(np.array([s for s, _, _ in held]), np.array([c for _, c, _ in held]),
                                    [x for _, _, x in held], params.percent)
                if found is not None:
                    yield pa.record_batch({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

        for batch in batches:
            for tile, side, component, members in zip(
                    batch.column("tile").to_pylist(), batch.column("side").to_pylist(),
                    batch.column("component").to_pylist(), batch.column("members")):
                if tile != now:
                    yield from judged()
                    held, now = [], tile
                held.append((side, component, np.frombuffer(members.as_py(), np.uint64)))
        yield from judged()

    return read


def _tiles(rows: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """Rows (pivot, id, n, component) dealt over tiles: a group of g parts has one for each part and every two."""
    most = F.greatest(F.count("*") / params.tile, F.sum("n") / params.tile_shingles)
    parts = (rows.groupBy("pivot").agg(F.ceil(most).cast("int").alias("g"), F.min("component").alias("low"),
                                       F.max("component").alias("high")).filter("low <> high").select("pivot", "g"))
    placed = rows.join(parts, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2)
    return placed.select(F.xxhash64("pivot", low, high).alias("tile"), side.alias("side"), "id", "component")


def links_between(docs: DataFrame, classes: DataFrame, params: NearDuplicateParams) -> DataFrame:
    """Verified links (a, b) that connect all ``classes`` (id, n, buckets) which links connect."""
    members = classes.select("id", "n", F.explode("buckets").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1")
    members = stored(members.join(sizes, "bucket"), "members")
    sets = stored_by_batches(_sets_of(docs, members.select("id").distinct(), params), "sets", 1000)
    weights = members.groupBy("id").agg(F.sum("k").alias("weight"))
    pivots = members.join(weights, "id").groupBy("bucket").agg(
        F.max_by(F.struct("id", "n"), F.struct("weight", -F.col("id"))).alias("p"))
    placed = stored(members.join(pivots, "bucket").select(
        "bucket", "id", "n", F.col("p.id").alias("pivot"), F.col("p.n").alias("pivot_n")), "placed")
    stars = (placed.filter("id <> pivot").filter(_may_link(F.col("n"), F.col("pivot_n"), params))
             .select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct())
    links = verify(stars, sets, params).filter("linked").select("a", "b")
    labelled = stored(placed.join(components(links).withColumnRenamed("node", "id"), "id", "left")
                      .withColumn("component", F.coalesce("component", "id")), "labelled")
    mixed = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    # pivots have been compared with all of their buckets
    grouped = stored(labelled.join(mixed.select("bucket"), "bucket").filter("id <> pivot")
                     .select("pivot", "id", "n", "component").distinct(), "groups")
    tiled = _tiles(grouped, params).join(sets, "id").repartition("tile").sortWithinPartitions("tile")
    between = tiled.mapInArrow(_between(params), "a long, b long").distinct()
    return links.unionByName(stored_by_batches(between, "between", 1000))


def near_duplicates(docs: DataFrame, params: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of ``docs`` (doc_id, text)."""
    rows = stored(signed(docs, params), "signed")
    nodes = rows.filter("set_key IS NOT NULL AND doc_id IS NOT NULL")
    classes = stored(nodes.groupBy("set_key").agg(
        F.min("doc_id").alias("id"), F.any_value("n_shingles").alias("n"), F.any_value("buckets").alias("buckets")), "classes")
    links = links_between(docs, classes.select("id", "n", "buckets"), params)
    same = nodes.select("doc_id", "set_key").join(classes.select("set_key", "id"), "set_key").filter("doc_id <> id")
    whole = components(links.unionByName(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b"))))
    return (rows.select("doc_id", "n_shingles").join(whole.withColumnRenamed("node", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
                    F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept")))


def representatives(docs: DataFrame, params: NearDuplicateParams = NearDuplicateParams()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that stay: of each group the one with the smallest doc_id."""
    name = unused(docs, "gone")
    gone = near_duplicates(docs, params).filter("NOT kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), F.col("doc_id").cast("long") == F.col(name), "left_anti")
