"""Columns of the input that are named like columns that the operators use inside change no result."""

import random

import pytest
from llm_tools import CLASHING, ODD_TEXTS, docs, documents, prose
from pyspark.sql import functions as F

from newsloom.llm import (alignment, embeddings, exact_dedup, licenses, packing, periodic_runs, queries, suffixes, token_counts,
                          warc)

INSIDE = ("digest", "check", "row", "number", "length", "n_bytes", "apart", "best", "maybe", "name", "count", "state", "wanted", "_id",
          "_twin", "spans", "whole", "p", "shard", "n_chars_all", "raw", "base_labels", "runs", "n_a", "vec_id", "label", "payload", "header",
          "record_type", "refers_to", "large", "group_size")

OF_DOCUMENTS = {
    "packing": lambda d: packing.best_fit(packing.word_lengths(d)).select("doc_id", "piece", "start", "length"),
    "licenses": licenses.scan,
    "token_counts": lambda d: token_counts.token_counts(d, token_counts.vocabulary_of(queries.PIECES)),
    "suffixes": suffixes.remove_repeats,
    "exact": exact_dedup.exact_duplicates,
    "alignment": lambda d: alignment.aligned(d, queries.BYTE_PAIRS, queries.PIECES),
    "periodic": lambda d: periodic_runs.periodic_runs(d, weave=True),
}


def crowded(df):
    taken = {c.lower() for c in df.columns}
    return df.select("*", *[F.lit("x").alias(c) for c in INSIDE if c not in taken])


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    rows = [(i, " ".join(prose(rng, rng.randrange(60), 50)) + " under the MIT license") for i in range(60)]
    return rows + [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(200, rows[3][1]), (201, rows[3][1] * 4)]


@pytest.mark.parametrize("name", OF_DOCUMENTS)
def test_documents(spark, texts, name):
    call = OF_DOCUMENTS[name]
    plain, full = call(docs(spark, texts)), call(crowded(documents(spark, texts, extra=True)))
    assert full.columns == plain.columns and not set(full.columns) & {"lang", "source"}
    assert rows_of(full) == rows_of(plain) and len(CLASHING) > 10


def test_pages(spark, texts):
    pages = spark.createDataFrame([(i, f"http://a/{i}", t) for i, t in texts], "page_id long, url string, html string")
    plain, full = (warc.summary(warc.records(warc.archived(p))) for p in (pages, crowded(pages)))
    assert full.columns == plain.columns and rows_of(full) == rows_of(plain)


def test_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(4)]) for i in range(50)] + [(60, None), (61, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain, full = embeddings.near_duplicates(vectors), embeddings.near_duplicates(crowded(vectors))
    assert full.columns == plain.columns and rows_of(full) == rows_of(plain)
