"""Preparation of the labelled corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.stemming import stem_words


def content_words(text: Column) -> Column:
    """Blank-joined words that go to the stemmer."""
    return F.array_join(tx.keep_content_words(tx.word_tokens(tx.clean_text(text))), " ")


def processed_text(text: Column, once: bool = False) -> Column:
    """The text as the classifier sees it: cleaned, without stop words, stemmed; ``once`` as for :func:`stem_words`."""
    return stem_words(content_words(text), extended=True, once=once)


def prepare(raw: DataFrame, row_id: str | None = None, title: str = "title", body: str = "text",
            label: str = "label") -> DataFrame:
    """``(doc_id, processed_text, label)``; rows whose text ends empty are dropped.

    A narrow job: no shuffle, and every text is cleaned and stemmed once.  Without a row id a hash of the raw row serves as one.
    """
    rid = F.col(row_id).cast("string") if row_id else F.md5(
        F.concat_ws("\u0001", F.coalesce(title, F.lit("")), F.coalesce(body, F.lit("")),
                    F.col(label).cast("string")))
    return (raw.select(rid.alias("doc_id"), processed_text(tx.combine(title, body), once=True).alias("processed_text"),
                       F.col(label).cast("int").alias("label"))
            .filter(F.length("processed_text") > 0))
