"""Near-duplicate groups of vectors, by tiles of int8 products with error bounds.

A vector is scaled to length 1 and stored as 8-bit numbers times a scale of its own; how far that is
from the vector is measured, not estimated.  The product of two such vectors is exact in integers, and
the two distances bound how far it is from the cosine.  So most pairs are ruled out, and others in,
by the product alone; only pairs whose bound holds the threshold are computed again in doubles.

Equal vectors are one node from the start.  Nodes are dealt over parts by hash, and every two parts meet
in a tile of bounded size, on any executor.  A tile gives, per node, the number of links, and the links
that union-find needs to connect what it saw: at most one per node, so no pairs are listed, however
large a group of near copies is.  The number of tiles is quadratic in that of different vectors, which is
the price of losing no link; the bytes sent are those of the vectors times the number of parts.

Cases with a defined result: vectors that are null, empty or zero, or hold null or non-finite components,
are linked with nothing; so are vectors of different lengths with each other, and rows with a null
vec_id, which keep a null component and stay.  Rows that share a vec_id are vectors of their own, which
share a component.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .components import components, unite
from .storage import stored, stored_by_batches

_EXACT = 1024  # columns whose int8 products add up exactly in 32-bit floats
_ROUNDING = 1e-6  # of scales and products in 32-bit floats, and of lengths in doubles
_AGAIN = 1 << 22  # numbers held to compute pairs again


@dataclass(frozen=True)
class CosineParams:
    least: float = 0.9  # cosine of a link
    part: int = 32_768  # vectors of a part at most
    part_bytes: int = 64 << 20
    spread: int = 8  # parts at least, while these have 1,024 vectors
    chunk_bytes: int = 128 << 10  # of vectors in one row on their way to a tile
    block: int = 2048  # vectors on a side of one product


class Quantised(NamedTuple):
    unit: np.ndarray  # float64, length 1
    codes: np.ndarray  # int8 as float32, for products
    scale: np.ndarray
    error: np.ndarray  # distance from unit to scale * codes, rounded up


def quantise(vectors: np.ndarray) -> Quantised:
    """Rows of finite numbers, none all zero, as 8-bit numbers; errors are measured."""
    unit = vectors.astype(np.float64)
    unit /= np.abs(unit).max(axis=1, keepdims=True)  # first, so that squares stay finite and above zero
    unit /= np.sqrt(np.einsum("ij,ij->i", unit, unit))[:, None]
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None])
    gap = unit - codes * scale[:, None]
    return Quantised(unit, codes.astype(np.float32), scale, np.sqrt(np.einsum("ij,ij->i", gap, gap)) + _ROUNDING)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    if a.shape[1] <= _EXACT:
        return a @ b.T
    return sum((a[:, k:k + _EXACT] @ b[:, k:k + _EXACT].T).astype(np.float64) for k in range(0, a.shape[1], _EXACT))


def linked(a: Quantised, b: Quantised, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Rows of ``a`` and of ``b`` that have links, and which of them are linked; None if none are.

    |x . y - x' . y'| <= |x - x'| |y| + |x'| |y - y'| <= e + f (1 + e) for lengths of 1.
    """
    product = _products(a.codes, b.codes)
    e, f = a.error.max(), b.error.max()
    lowest = (least - e - f * (1 + e) - _ROUNDING) / (a.scale.max() * b.scale.max())
    near = product >= lowest if lowest > 0 else np.ones(product.shape, dtype=bool)
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return None
    columns = np.flatnonzero(near[rows].any(axis=0))
    cosine = product[np.ix_(rows, columns)].astype(np.float64) * a.scale[rows][:, None] * b.scale[columns][None, :]
    e, f = a.error[rows][:, None], b.error[columns][None, :]
    bound = e + f * (1 + e) + _ROUNDING
    sure = cosine - bound >= least
    x, y = np.nonzero(~sure & (cosine + bound >= least))
    step = max(1, _AGAIN // a.unit.shape[1])
    for i in range(0, len(x), step):
        p, q = x[i:i + step], y[i:i + step]
        sure[p, q] = np.einsum("ij,ij->i", a.unit[rows[p]], b.unit[columns[q]]) >= least
    return rows, columns, sure


def _merge(label_a: np.ndarray, label_b: np.ndarray, links: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of labels that connect what ``links`` connects, one per row and column and round."""
    out = []
    while True:
        apart = links & (label_a[:, None] != label_b[None, :])
        rows = np.flatnonzero(apart.any(axis=1))
        if not len(rows):
            return out
        columns = np.flatnonzero(apart.any(axis=0))
        x = np.concatenate([label_a[rows], label_a[apart[:, columns].argmax(axis=0)]])
        y = np.concatenate([label_b[apart[rows].argmax(axis=1)], label_b[columns]])
        node, root = unite(x, y)
        out.append((node, root))
        label_a, label_b = _renamed(label_a, node, root), _renamed(label_b, node, root)


def _renamed(labels: np.ndarray, node: np.ndarray, root: np.ndarray) -> np.ndarray:
    """``labels`` with each of ``node`` (sorted) replaced by its root."""
    if not len(node):
        return labels
    at = np.minimum(np.searchsorted(node, labels), len(node) - 1)
    return np.where(node[at] == labels, root[at], labels)


class Side(NamedTuple):
    """Nodes of a part."""
    key: np.ndarray  # names, 16 bytes
    node: np.ndarray  # smallest vec_id
    size: np.ndarray  # rows
    vectors: np.ndarray

    def sorted_by_scale(self) -> tuple[Side, Quantised]:
        """Blocks of like scales have sharp bounds."""
        made = quantise(self.vectors)
        order = np.argsort(made.scale, kind="stable")
        return Side(*(x[order] for x in self)), Quantised(*(x[order] for x in made))


def judge_tile(left: Side, right: Side | None, params: CosineParams = CosineParams()):
    """(key, links) and links (a, b) between two parts, or within one where ``right`` is None."""
    a, qa = left.sorted_by_scale()
    b, qb = (a, qa) if right is None else right.sorted_by_scale()
    count_a = np.zeros(len(a.node), dtype=np.int64)
    count_b = count_a if right is None else np.zeros(len(b.node), dtype=np.int64)
    label_a = a.node.copy()
    label_b = label_a if right is None else b.node.copy()
    pairs = []
    for i in range(0, len(a.node), params.block):
        r = slice(i, i + params.block)
        for j in range(i if right is None else 0, len(b.node), params.block):
            c = slice(j, j + params.block)
            found = linked(Quantised(*(x[r] for x in qa)), Quantised(*(x[c] for x in qb)), params.least)
            if found is None:
                continue
            rows, columns, links = found[0] + i, found[1] + j, found[2]
            if right is None and i == j:  # a node and itself
                links &= rows[:, None] != columns[None, :]
            count_a[rows] += links @ b.size[columns]
            if right is not None or i != j:
                count_b[columns] += a.size[rows] @ links
            for node, root in _merge(label_a[rows], label_b[columns], links):
                pairs.append((node, root))
                label_a[:] = _renamed(label_a, node, root)
                if right is not None:
                    label_b[:] = _renamed(label_b, node, root)
    counts = [(a.key[count_a > 0], count_a[count_a > 0])]
    if right is not None:
        counts.append((b.key[count_b > 0], count_b[count_b > 0]))
    x, y = (np.concatenate(v) for v in zip(*pairs)) if pairs else (np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(v) for v in zip(*counts)), (x, y)


def _named(rows: DataFrame) -> DataFrame:
    """(vec_id, width, key, vector) of each row: vector as bytes, key and vector null if it can't be linked."""
    source = rows.schema["embedding"].dataType
    if not isinstance(source, ArrayType):
        raise ValueError("embedding is no array")
    kind = "float" if isinstance(source.elementType, FloatType) else "double"
    number = np.float32 if kind == "float" else np.float64

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, raws, widths = [], [], []
            for vec_id, vector in zip(batch.column("vec_id"), batch.column("embedding")):
                values = vector.values
                good = vec_id.is_valid and values is not None and len(values) > 0 and not values.null_count
                if good:
                    values = values.to_numpy(zero_copy_only=False)
                    good = bool(np.isfinite(values).all() and values.any())
                raw = values.astype(number).tobytes() if good else None
                raws.append(raw)
                keys.append(hashlib.blake2b(raw, digest_size=16).digest() if good else None)
                widths.append(len(values) if good else None)
            yield pa.record_batch({"vec_id": batch.column("vec_id"), "width": pa.array(widths, pa.int32()),
                                   "key": pa.array(keys, pa.binary()), "vector": pa.array(raws, pa.binary())})

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias(
        "embedding")).mapInArrow(read, "vec_id long, width int, key binary, vector binary"), np.dtype(number)


def _chunks(limit: int):
    """Rows (width, part, ...) of one part after the other, packed into rows of many vectors."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        now, size = None, 0

        def packed():
            key, node, rows, vector = zip(*held)
            return pa.record_batch({
                "width": pa.array([now[0]], pa.int32()), "part": pa.array([now[1]], pa.int32()),
                "keys": pa.array([b"".join(key)], pa.binary()), "vectors": pa.array([b"".join(vector)], pa.binary()),
                "nodes": pa.array([np.array(node, np.int64).tobytes()], pa.binary()),
                "sizes": pa.array([np.array(rows, np.int64).tobytes()], pa.binary())})

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("width", "part", "key", "id", "size", "vector")]
            for width, part, key, node, rows, vector in zip(*columns):
                if held and ((width, part) != now or size >= limit):
                    yield packed()
                    held, size = [], 0
                now = (width, part)
                held.append((key, node, rows, vector))
                size += len(vector)
        if held:
            yield packed()

    return read


def _tiles(number: np.dtype, params: CosineParams):
    """Counts (key, n) and links (a, b) of tiles whose rows come one after the other."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        now = None

        def side(rows: list[tuple]) -> Side:
            keys, nodes, sizes, vectors = (b"".join(x) for x in zip(*rows))
            nodes = np.frombuffer(nodes, np.int64)
            return Side(np.frombuffer(keys, "V16"), nodes, np.frombuffer(sizes, np.int64),
                        np.frombuffer(vectors, number).reshape(len(nodes), -1))

        def judged():
            if 1 in held or 0 in held and 2 in held:
                left, right = (side(held[1]), None) if 1 in held else (side(held[0]), side(held[2]))
                (key, n), (a, b) = judge_tile(left, right, params)
                none = len(key), len(a)
                yield pa.record_batch({
                    "key": pa.array([k.tobytes() for k in key] + [None] * none[1], pa.binary()),
                    "n": pa.array(n.tolist() + [None] * none[1], pa.int64()),
                    "a": pa.array([None] * none[0] + a.tolist(), pa.int64()),
                    "b": pa.array([None] * none[0] + b.tolist(), pa.int64())})

        for batch in batches:
            for tile, which, *blobs in zip(*(batch.column(c).to_pylist() for c in (
                    "tile", "side", "keys", "nodes", "sizes", "vectors"))):
                if tile != now:
                    yield from judged()
                    held, now = {}, tile
                held.setdefault(which, []).append(tuple(blobs))
        yield from judged()

    return read


def links_of(nodes: DataFrame, number: np.dtype, params: CosineParams) -> tuple[DataFrame, DataFrame]:
    """Numbers of links (key, n), to be added up, and links (a, b) of ``nodes`` (key, id, size, width, vector)."""
    fits = F.least(F.lit(params.part), F.floor(params.part_bytes / (F.col("width") * (number.itemsize + 12))) + 1)
    plan = stored(nodes.groupBy("width").count().withColumn(
        "parts", F.greatest(F.ceil(F.col("count") / fits), F.least(F.lit(params.spread), F.ceil(F.col("count") / 1024))).cast("int")
    ).select("width", "parts"), "parts")
    tiles = plan.agg(F.sum(F.col("parts") * (F.col("parts") + 1) / 2).cast("long"), F.sum("parts")).first()
    if not tiles[0]:
        empty = nodes.limit(0)
        return (empty.select("key", F.lit(0).cast("long").alias("n")),
                empty.select(F.col("id").alias("a"), F.col("id").alias("b")))
    placed = nodes.join(plan, "width").withColumn("part", F.pmod(F.xxhash64("key"), "parts").cast("int"))
    # one task packs whole parts, so that no chunk is short
    chunks = stored_by_batches(placed.repartition(min(int(tiles[1]), 10_000), "width", "part").sortWithinPartitions("width", "part")
                               .select("width", "part", "key", "id", "size", "vector")
                               .mapInArrow(_chunks(params.chunk_bytes),
                                           "width int, part int, keys binary, vectors binary, nodes binary, sizes binary"),
                               "chunks", 2000)
    met = (chunks.join(plan, "width").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
           .withColumn("side", F.when(F.col("part") < F.col("other"), 0).when(F.col("part") == F.col("other"), 1).otherwise(2)))
    low, high = F.least("part", "other"), F.greatest("part", "other")
    named = met.select(F.struct("width", low.alias("low"), high.alias("high")).alias("tile"),
                       (F.col("width") * 7 + high * (high + 1) / 2 + low).cast("long").alias("number"),
                       "side", "keys", "nodes", "sizes", "vectors")
    # products take far longer than rows to move: a partition for every tile, numbered so that none holds two of a width
    count = min(int(tiles[0]), 20_000)
    dealt = named.repartitionById(count, F.pmod("number", F.lit(count)).cast("int")).sortWithinPartitions("tile", "side")
    found = stored_by_batches(dealt.withColumn("tile", F.to_json("tile")).mapInArrow(
        _tiles(number, params), "key binary, n long, a long, b long"), "tiles", 16)
    return found.filter("key IS NOT NULL").select("key", "n"), found.filter("a IS NOT NULL").select("a", "b")


def near_duplicates(vectors: DataFrame, params: CosineParams = CosineParams()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors`` (vec_id, embedding)."""
    named, number = _named(vectors)
    rows = stored(named, "vectors")
    known = rows.filter("key IS NOT NULL")
    nodes = stored(known.groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("size"),
                                            F.any_value("width").alias("width"), F.any_value("vector").alias("vector")), "nodes")
    counts, links = links_of(nodes, number, params)
    totals = stored(nodes.select("key", "id", "size").join(counts.groupBy("key").agg(F.sum("n").alias("n")), "key", "left")
                    .select("key", "id", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links")), "totals")
    # rows without a key pass by the join, in which they would all meet in one task
    of_rows = stored(known.select("vec_id", "key").join(totals, "key").select("vec_id", "id", "n_links").unionByName(
        rows.filter("key IS NULL").select("vec_id", F.col("vec_id").alias("id"), F.lit(0).cast("long").alias("n_links"))), "rows")
    same = of_rows.filter("vec_id <> id").select(F.col("id").alias("a"), F.col("vec_id").alias("b"))
    whole = components(links.unionByName(same)).withColumnRenamed("node", "vec_id")
    component = F.coalesce("component", "vec_id")
    return (of_rows.select("vec_id", "n_links").join(whole, "vec_id", "left")
            .select("vec_id", "n_links", component.alias("component_id"),
                    F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept")))
