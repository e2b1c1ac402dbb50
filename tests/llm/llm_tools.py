"""Small tables for the tests of the training-data operators."""

from __future__ import annotations

import random

CLASHING = ("score", "labels", "kept", "n_words", "bucket", "items", "twin", "start", "runs_of_lines", "component_id", "line_counts", "gone", "found")


def docs(spark, rows, parts=3):
    """documents from (doc_id, text) pairs, spread over some partitions."""
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)


def documents(spark, rows, extra=False):
    """A table with all columns of documents, some null, and columns with names that operators use inside."""
    full = [(i, t, None if k % 3 else "en", "src0" if k % 2 else None, len(t) if t else None)
            + (("x",) * len(CLASHING) if extra else ()) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(full, schema + "".join(f", `{c}` string" for c in CLASHING if extra)).repartition(3)


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD_TEXTS = [None, "", " ", "\n\n", "one", "ONE", "ÀÉ ß 日本", "a" * 5000, " ".join(["same"] * 3000), "x\ty\x0bz\r\n w"]
