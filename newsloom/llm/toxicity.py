"""Non-negative positive-unlabelled learning of toxicity.

A linear model over hashed words is trained in numpy from confirmed toxic texts (P) and all
others (U), those without a label and those labelled otherwise.  With class prior ``pi`` and ``h``,
the share of toxic texts in U, the risk is

    pi * E_P[loss(+f)] + (1 - pi) / (1 - h) * max(0, E_U[loss(-f)] - h * E_P[loss(-f)])

The second part estimates the risk on the hidden negatives; as it cannot be negative, a step
that would push it below zero goes the other way.  ``pi`` is the share among labelled texts, and
that among those without a label too; so ``h`` is ``pi`` times the part of U that has no label,
whatever the numbers are.  The texts of the fit are taken in the order of a hash, so the model
doesn't depend on how the tables are cut into tasks.

Cases with a defined result: a null or empty text has no features and gets the score of the
bias alone; labels that are null, or of ids with no document, are left out; an id with several
labels is toxic if one of them says so; with no toxic text to learn from every score is 0, and
with none but confirmed toxic ones every score is 1.
Rows are scored one by one, so repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from . import words
from .rows import unused, with_column


@dataclass(frozen=True)
class ToxicityParams:
    bits: int = 20  # hashed features
    prefixes: tuple[int, ...] = (5, 7)  # bytes; beginnings of words are features too
    max_positive: int = 4_000  # the fit takes about so many toxic texts at most, chosen by a hash of the id,
    max_unlabelled: int = 8_000  # and so many others; everything is scored
    min_positive: int = 4  # toxic texts of the fit that a feature must be in
    min_z: float = 4.5  # log odds of a feature, toxic against others, over their standard error
    epochs: int = 30
    batch: int = 256
    rate: float = 0.02
    decay: float = 1e-4
    gamma: float = 1.0  # of the step back
    seed: int = 7


@dataclass(frozen=True)
class ToxicityModel:
    weights: np.ndarray
    bias: float
    bits: int
    prefixes: tuple[int, ...]


def features(block: words.Block, bits: int, prefixes: tuple[int, ...],
             among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each document, sorted, and where each document's begin.

    ``among`` marks the features that are wanted.
    """
    found = words.words(block, words.NON_ALPHANUMERIC)
    hashes = words.rolling(block)
    parts, owner = [hashes.of(found.starts, found.ends)], found.document()
    owners = [owner]
    length = found.ends - found.starts
    for size in prefixes:
        longer = length > size
        start = found.starts[longer]
        parts.append(words.mix(hashes.of(start, start + size) + np.uint64(size)))
        owners.append(owner[longer])
    values = (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.uint64)
    owner = np.concatenate(owners).astype(np.uint64)
    if among is not None:
        wanted = among[values.astype(np.int64)]
        owner, values = owner[wanted], values[wanted]
    pairs = np.sort((owner << np.uint64(bits)) | values)
    if len(pairs):
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])]
    first = np.searchsorted(pairs, np.arange(block.count + 1, dtype=np.uint64) << np.uint64(bits))
    return (pairs & np.uint64((1 << bits) - 1)).astype(np.int64), first


def _sums(weights: np.ndarray, columns: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of weights over the root of the number of features, for each document."""
    size = np.diff(first)
    # document by document: a sum doesn't depend on what else is in the block
    sums = np.bincount(np.repeat(np.arange(len(size)), size), weights=weights[columns], minlength=len(size))
    return sums / np.sqrt(np.maximum(size, 1))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def telling(rows: list[np.ndarray], toxic: np.ndarray, params: ToxicityParams) -> np.ndarray:
    """Marks the features that are clearly more frequent in toxic texts than in others."""
    def texts_with(which):
        chosen = [rows[i] for i in np.flatnonzero(which)] or [np.empty(0, np.int64)]
        return np.bincount(np.concatenate(chosen), minlength=1 << params.bits)

    in_p, in_u = texts_with(toxic), texts_with(~toxic)
    odds = np.log((in_p + 0.5) / (toxic.sum() + 1)) - np.log((in_u + 0.5) / ((~toxic).sum() + 1))
    error = np.sqrt(1 / (in_p + 0.5) + 1 / (in_u + 0.5))
    return (odds >= params.min_z * error) & (in_p >= params.min_positive)


def fit(rows: list[np.ndarray], toxic: np.ndarray, prior: float, params: ToxicityParams,
        among_others: float | None = None) -> ToxicityModel:
    """Mini-batches of Adagrad on the non-negative risk, logistic loss.

    ``rows`` are the sorted features of each text; ``toxic`` says which are confirmed; ``among_others``
    is the share of toxic texts among those that are not, ``prior`` if not given.
    """
    share = prior if among_others is None else among_others
    weight = (1 - prior) / (1 - share) if share < 1 else 1.0  # of the risk on the hidden negatives
    size = 1 << params.bits
    weights, bias = np.zeros(size), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    positive, unlabelled = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    kept = telling(rows, toxic, params)
    rows = [r[kept[r]] for r in rows]
    if not len(positive) or not len(unlabelled):
        return ToxicityModel(weights, -40.0 if not len(positive) else 40.0, params.bits, params.prefixes)
    squares, bias_squares = np.full(size, 1e-8), 1e-8
    random = np.random.default_rng(params.seed)
    steps = max(1, -(-len(unlabelled) // params.batch))
    for _ in range(params.epochs):
        mixed = random.permutation(unlabelled)
        for step in range(steps):
            u = mixed[step * params.batch:(step + 1) * params.batch]
            p = random.choice(positive, size=min(params.batch, len(positive)), replace=False)
            chosen = [rows[i] for i in np.concatenate([p, u])]
            first = np.concatenate([[0], np.cumsum([len(r) for r in chosen])])
            columns = np.concatenate(chosen)
            value = bias + _sums(weights, columns, first)
            on_p, on_u = value[:len(p)], value[len(p):]
            hidden = np.mean(np.logaddexp(0, on_u)) - share * np.mean(np.logaddexp(0, on_p))
            slope_u = weight * _sigmoid(on_u) / len(u)
            slope_p = -weight * share * _sigmoid(on_p) / len(p)
            if hidden < 0:
                slope = params.gamma * np.concatenate([-slope_p, -slope_u])
            else:
                slope = np.concatenate([slope_p - prior * _sigmoid(-on_p) / len(p), slope_u])
            scaled = np.repeat(slope / np.sqrt(np.maximum(np.diff(first), 1)), np.diff(first))
            touched, place = np.unique(columns, return_inverse=True)
            gradient = np.bincount(place, weights=scaled, minlength=len(touched)) + params.decay * weights[touched]
            squares[touched] += gradient ** 2
            weights[touched] -= params.rate * gradient / np.sqrt(squares[touched]) * 10
            bias_gradient = slope.sum()
            bias_squares += bias_gradient ** 2
            bias -= params.rate * bias_gradient / np.sqrt(bias_squares)
    return ToxicityModel(weights, float(bias), params.bits, params.prefixes)


def _sample(docs: DataFrame, params: ToxicityParams, cap: int) -> DataFrame:
    """About ``cap`` documents at most, by a hash of the id."""
    share = min(1.0, cap / max(1, docs.count()))
    return docs.filter(F.pmod(F.xxhash64("doc_id", F.lit(params.seed)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def train(docs: DataFrame, labels: DataFrame, may_learn: str = "true",
          params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on the toxic and all other texts of ``docs`` (doc_id, text).

    ``labels`` has (doc_id, toxic); ``may_learn`` is a condition on doc_id, and nothing is
    learnt from other rows.  What comes to the driver is the features of at most about
    ``max_positive + max_unlabelled`` texts.
    """
    marks = (labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
             .groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic")))
    rows = docs.select("doc_id", "text").filter(F.expr(may_learn) & F.col("doc_id").isNotNull())
    marked = rows.select("doc_id").join(marks, "doc_id", "left")
    shares = marked.agg(F.avg("toxic").alias("prior"), F.count_if(F.col("toxic").isNull()).alias("open"),
                        F.count_if(F.col("toxic") == 0).alias("other")).first()
    prior = float(shares.prior or 0.0)
    among_others = prior * shares.open / max(1, shares.open + shares.other)
    chosen = (_sample(marked.filter("toxic = 1"), params, params.max_positive)
              .unionByName(_sample(marked.filter("toxic IS NULL OR toxic = 0"), params, params.max_unlabelled)).distinct())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in words.blocks(batch.column("text")):
                columns, first = features(block, params.bits, params.prefixes)
                yield pa.record_batch({
                    "place": batch.column("place").slice(block.rows.start, block.count),
                    "toxic": batch.column("toxic").slice(block.rows.start, block.count),
                    "features": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(columns, pa.int32()))})

    table = (rows.join(F.broadcast(chosen), "doc_id")  # at most the sample's bound, narrow
             .select(F.xxhash64("text", "doc_id", F.lit(params.seed)).alias("place"), "toxic", "text")
             .mapInArrow(read, "place long, toxic int, features array<int>").toArrow().sort_by("place"))
    lists = table.column("features").combine_chunks()
    values, first = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    found = [values[first[i]:first[i + 1]].astype(np.int64) for i in range(len(table))]
    toxic = np.array([v == 1 for v in table.column("toxic").to_pylist()], dtype=bool)
    return fit(found, toxic, prior, params, among_others)


def with_score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` (text, ...) and the score, ``name``, of each row; narrow."""
    at = np.flatnonzero(model.weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, model.weights[at]))  # the telling features only
    bias, bits, prefixes = model.bias, model.bits, model.prefixes

    def start():
        weights = np.zeros(1 << bits)
        weights[shared.value[0]] = shared.value[1]
        wanted = weights != 0

        def score(block: words.Block) -> pa.Array:
            columns, first = features(block, bits, prefixes, wanted)
            return pa.array(_sigmoid(bias + _sums(weights, columns, first)))

        return score

    return with_column(docs, name, DoubleType(), start)


# a text with this id is held out: its label is never read
MAY_LEARN = "crc32(cast(cast(doc_id AS string) AS binary)) % 4 <> 2"


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
             params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """Train on the ids that are not held out, then score and predict every row."""
    model = train(docs, labels, MAY_LEARN, params)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_score(texts, model).select(
        "doc_id", F.coalesce(F.expr(f"NOT ({MAY_LEARN})"), F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3,
                  params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, ...) that score below the threshold, with their columns."""
    model = train(docs, labels, MAY_LEARN, params)
    name = unused(docs, "toxicity_score")
    return with_score(docs, model, name).filter(F.col(name) < threshold).drop(name)
