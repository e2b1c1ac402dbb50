"""Connected components of a table of links, by union-find and contraction.

Each task first unites its own links (union-find), which leaves one link per node it has seen.
Then levels of contraction: every node points at the smallest of itself and its neighbours, the
links move to what their ends point at, and links within a node vanish.  The levels are composed
at the end.  Every level is written to the shared folder, so lost executors cost little, and the
driver sees counts only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import stored

_FLUSH = 1_000_000  # links held by a task


def unite(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest reachable node) of the given links; nodes that are smallest left out."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = np.arange(len(nodes))
    x, y = ends[:len(a)], ends[len(a):]
    while True:  # hook the larger root on the smaller, then shorten all paths
        rx, ry = parent[x], parent[y]
        low, high = np.minimum(rx, ry), np.maximum(rx, ry)
        if (low == high).all():
            break
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def _unite_tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a, b = unite(np.concatenate([x for x, _ in held]), np.concatenate([y for _, y in held]))
        return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    for batch in batches:
        if batch.num_rows:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            size += batch.num_rows
        if size >= _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Links may repeat, be given in either direction, or lead from a node to itself; rows with a
    null end are left out.  No links: no rows.
    """
    named = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna()
    left = stored(named.mapInArrow(_unite_tasks, "a long, b long").distinct(), "links")
    levels = []
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up"))
                    .select(F.col("a").alias("node"), "up"), "level")
        levels.append(up)
        ends = (left.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a")
                .join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
                .filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")))
        left = stored(ends.mapInArrow(_unite_tasks, "a long, b long").distinct(), "links")
    if not levels:
        return named.sparkSession.createDataFrame([], "node long, component long")
    out = levels[0].select("node", F.col("up").alias("component"))
    for level in levels[1:]:
        step = level.select(F.col("node").alias("component"), "up")
        out = (out.join(step, "component", "left")
               .select("node", F.coalesce("up", "component").alias("component")))
    return stored(out, "components")
