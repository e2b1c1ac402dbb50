"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are cut into pieces of the largest capacity, and pieces are numbered and dealt by a hash of
the number over shards of about equal size, which are packed independently; more data make more shards.
Within a shard, pieces go longest first into the open sequence that they fill best.  Where none has
room, the capacity that costs least per token it can still get is opened; at the end each sequence
shrinks to the smallest permitted capacity that holds its contents.

Cases with a defined result: a null length counts as 0, and a document without tokens is one row with
no bin; pieces of equal length go in order of (doc_id, piece), a null doc_id first; repeated rows
are packed each on its own and are spread over shards like others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored


@dataclass(frozen=True)
class PackingParams:
    capacities: tuple[int, ...] = (1024, 2048, 4096, 8192)
    fixed_cost: float = 64.0  # of a sequence, in tokens; a token of capacity costs 1
    pieces_a_shard: int = 20_000

    def cost(self, capacity: int) -> float:
        return capacity + self.fixed_cost


def pack(lengths: list[int], params: PackingParams) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece, and the capacity of each bin.  Pieces come longest first."""
    capacities = sorted(params.capacities)
    left = sum(lengths)  # tokens of pieces not yet placed
    open_bins: list[tuple[int, int]] = []  # (room, bin), sorted
    opened, fill = [], []
    bins, offsets = [], []
    for length in lengths:
        at = bisect_left(open_bins, (length, -1))
        if at < len(open_bins):
            room, number = open_bins.pop(at)
        else:
            room = min((c for c in capacities if c >= length),
                       key=lambda c: (params.cost(c) / (length + min(c - length, left - length)), c))
            number = len(fill)
            opened.append(room)
            fill.append(0)
        bins.append(number)
        offsets.append(fill[number])
        fill[number] += length
        left -= length
        if room > length:
            insort(open_bins, (room - length, number))
    shrunk = [next(c for c in capacities if c >= f) for f in fill]
    return bins, offsets, shrunk


_PIECE = "doc_id long, piece int, start long, length long"
_PACKED = f"{_PIECE}, bin_id string, capacity long, offset long, bin_fill long"


def best_fit(lengths: DataFrame, params: PackingParams = PackingParams()) -> DataFrame:
    """Pack ``lengths`` (doc_id, length); one row per piece.

    piece counts from 0, start is its first token in the document, offset its place in the sequence
    ``bin_id``, which has ``bin_fill`` tokens and the final ``capacity``.
    """
    largest = max(params.capacities)
    length = F.greatest(F.coalesce(F.col("length").cast("long"), F.lit(0)), F.lit(0))
    docs = lengths.select(F.col("doc_id").cast("long").alias("doc_id"), length.alias("whole"))
    pieces = stored(
        docs.select("doc_id", "whole", F.explode(F.expr(f"sequence(0L, greatest(whole - 1, 0L) div {largest})")).alias("p"))
        .select("doc_id", F.col("p").cast("int").alias("piece"), (F.col("p") * largest).alias("start"),
                F.least(F.col("whole") - F.col("p") * largest, F.lit(largest)).alias("length"))
        .withColumn("number", F.monotonically_increasing_id()), "pieces")  # written, so it stays as it is
    shards = max(1, -(-pieces.count() // params.pieces_a_shard))

    def pack_shard(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets, capacity = pack(table.column("length").to_pylist(), params)
        shard = table.column("shard")[0].as_py()
        bins = np.array(bins)
        fill = np.bincount(bins, weights=table.column("length").to_numpy()).astype(np.int64)
        return table.drop(["shard", "number"]).append_column("bin_id", pa.array([f"{shard}-{b}" for b in bins])).append_column(
            "capacity", pa.array(np.array(capacity)[bins])).append_column(
            "offset", pa.array(offsets, pa.int64())).append_column("bin_fill", pa.array(fill[bins]))

    full = pieces.filter("length > 0").withColumn(
        "shard", F.pmod(F.xxhash64("number"), F.lit(shards)).cast("int"))
    empty = pieces.filter("length = 0").drop("number").select(
        "*", F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("long").alias("capacity"),
        F.lit(None).cast("long").alias("offset"), F.lit(None).cast("long").alias("bin_fill"))
    return full.groupBy("shard").applyInArrow(pack_shard, _PACKED).unionByName(empty)


def word_lengths(docs: DataFrame) -> DataFrame:
    """(doc_id, length) with the words between ASCII white space as tokens; null text: 0."""
    return docs.select("doc_id", F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).alias("length"))
