"""Which blocks of postings a search for the best hits has to read.

The statistics of a written index say, per term and block, how many postings there are and what a term
can weigh at most in an article of the block.  Once as many hits are known as a page wants, a block can be
left out if its bound, with the largest bounds of the other terms of the query, stays below the last of
these hits: an article of the block can't be on the page.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .postings import BM25_K1, SearchIndex

SLACK = 2e-6  # of sums and of scores that are rounded to 6 places


@dataclass(frozen=True)
class Block:
    impact: int
    bound: float  # of what the term adds to the score of an article
    rows: int


@dataclass(frozen=True)
class BlockPlan:
    """The blocks that are read of each term."""
    chosen: dict[str, tuple[Block, ...]]
    blocks: dict[str, tuple[Block, ...]]
    threshold: float | None = None

    @property
    def rows(self) -> int:
        return sum(b.rows for chosen in self.chosen.values() for b in chosen)

    @property
    def total(self) -> int:
        return sum(b.rows for blocks in self.blocks.values() for b in blocks)

    @property
    def whole(self) -> bool:
        return all(len(self.chosen[t]) == len(self.blocks[t]) for t in self.blocks)

    def condition(self) -> Column:
        """Postings of the chosen blocks."""
        wanted = F.lit(False)
        for term, chosen in self.chosen.items():
            rows = F.col("term") == term
            if len(chosen) < len(self.blocks[term]):
                rows = rows & F.col("impact").isin([b.impact for b in chosen])
            wanted = wanted | rows
        return wanted

    def above(self, threshold: float) -> BlockPlan:
        """The blocks that can hold an article with a score of ``threshold``."""
        best = {t: blocks[0].bound for t, blocks in self.blocks.items()}
        every = sum(best.values())
        return BlockPlan({t: tuple(b for b in blocks if b.bound + every - best[t] + SLACK >= threshold)
                          for t, blocks in self.blocks.items()}, self.blocks, threshold)


def bounds(stats: DataFrame, field_stats: DataFrame) -> DataFrame:
    """``(field, term, impact, df, share, n_articles)`` of rows of statistics, added up over batches.

    ``share`` bounds the share of its limit that a weight has.  It was taken at the mean length of a
    batch; where the mean of all batches is larger by a factor, the share is larger by that factor at most.
    """
    means = field_stats.groupBy("field").agg(
        F.sum("n_articles").alias("n_articles"), (F.sum("total_length") / F.sum("n_articles")).alias("mean_length"))
    then = field_stats.select("field", "ingest_batch", (F.col("total_length") / F.col("n_articles")).alias("batch_mean"))
    share = F.least(F.lit(1.0), F.col("top") * F.greatest(F.lit(1.0), F.col("mean_length") / F.col("batch_mean")))
    return (stats.join(then, ["field", "ingest_batch"]).join(means, "field")
            .groupBy("field", "term", "impact", "n_articles").agg(F.sum("df").alias("df"), F.max(share).alias("share")))


def term_blocks(index: SearchIndex, stats: DataFrame) -> dict[str, tuple[Block, ...]]:
    """Blocks of each term of ``stats`` (rows of the terms and fields of one query), the best first.

    What is collected is bounded by the terms of a query, the fields and the classes of blocks.
    """
    rows = bounds(stats, index.field_stats).collect()
    df: dict[tuple[str, str], int] = {}
    for r in rows:
        df[r.term, r.field] = df.get((r.term, r.field), 0) + r.df
    found: dict[str, dict[int, list[float]]] = {}
    for r in rows:
        idf = math.log(r.n_articles / (df[r.term, r.field] + 1.0)) + 1
        block = found.setdefault(r.term, {}).setdefault(r.impact, [0.0, 0])
        block[0] += idf * (BM25_K1 + 1) * r.share
        block[1] += r.df
    return {term: tuple(sorted((Block(i, bound, n) for i, (bound, n) in blocks.items()), key=lambda b: (-b.bound, b.impact)))
            for term, blocks in found.items()}


def first_blocks(blocks: dict[str, tuple[Block, ...]], rows: int) -> BlockPlan:
    """The best blocks of each term, until they have ``rows`` postings."""
    chosen = {}
    for term, own in blocks.items():
        taken, n = [], 0
        for block in own:
            if n >= rows:
                break
            taken.append(block)
            n += block.rows
        chosen[term] = tuple(taken)
    return BlockPlan(chosen, blocks)
