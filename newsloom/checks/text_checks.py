"""Text preparation and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.html import extract_pages
from ..operators import quality
from ..plans import corpus
from ..session import scratch_path
from ..sources import corpus_csv, requests
from ..sources import driver_views as views
from .sql_parts import LABELLED, RAW, clean, content_word_list, stemmed_list


def _docs(spark, sf):
    return views.articles(spark, sf).select("doc_id", "title", F.col("content").alias("text"))


def combined_text(spark, sf):
    d = _docs(spark, sf)
    title = F.when(F.col("doc_id") % 3 != 0, F.col("title"))
    return d.select("doc_id", tx.combine(title, "text").alias("combined"),
                    F.length(tx.combine(title, "text")).alias("text_length"))


def clean_text(spark, sf):
    return _docs(spark, sf).select("doc_id", tx.clean_text("text").alias("clean"))


def clean_pages(spark, sf):
    """Cleaning of raw page sources, which hold tags and addresses."""
    return views.pages(spark, sf).select("page_id", tx.clean_text("html").alias("clean"))


def tokens_filtered(spark, sf):
    return _docs(spark, sf).select("doc_id", corpus.content_words(F.col("text")).alias("tokens"))


def text_lengths(spark, sf):
    d = _docs(spark, sf)
    both = tx.combine("title", "text", trim=True)
    return d.select("doc_id", F.length(tx.clean_text(both)).alias("clean_length"),
                    F.length(corpus.content_words(both)).alias("words_length"))


def text_quality(spark, sf):
    """Conversation turns as score requests; what is refused, and why."""
    turns = views.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.lit(None).cast("string").alias("title"),
        F.expr("CASE WHEN turn % 4 = 3 THEN substr(text, 1, 0) ELSE text END").alias("content"))
    return quality.check_texts(requests.from_records(turns)).select("idx", "title", "error")


def stemmed_text(spark, sf):
    return _docs(spark, sf).select("doc_id", corpus.processed_text(F.col("text")).alias("processed_text"))


def prepared_corpus(spark, sf):
    """Rows with a text left."""
    d = corpus.prepare(views.labelled(spark, sf), "doc_id")
    return d.select(F.col("doc_id").cast("long").alias("doc_id"), "label")


def corpus_csv_round_trip(spark, sf):
    """The labelled rows written as CSV and read back with the corpus reader."""
    path = scratch_path(spark, "corpus")
    rows = views.labelled(spark, sf).select("title", "text", "label")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return corpus_csv.read_corpus(spark, path).select(
        F.md5(F.trim("title")).alias("title_hash"), F.length(F.trim("text")).alias("text_length"), "label")


def corpus_cache(spark, sf):
    """Prepared corpus by way of the cache; the second call reads what the first wrote."""
    path, cache = scratch_path(spark, "corpus"), scratch_path(spark, "cache")
    rows = views.labelled(spark, sf).select("title", "text", "label")
    rows.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    corpus_csv.cached_or_prepare(spark, path, cache, corpus.prepare)
    again = corpus_csv.cached_or_prepare(spark, path, cache, corpus.prepare)
    return again.groupBy("label").agg(F.count("*").alias("n"))


def page_extract(spark, sf):
    return extract_pages(views.pages(spark, sf))


def page_paragraphs(spark, sf):
    """Pages without a content element: open, nested and closed paragraphs, some around scripts."""
    section = F.regexp_replace("html", "(?i)(</?)article", "$1section")
    with_script = F.regexp_replace(section, "<br>", "<script>var p = '<p>no text</p>';</script><br>")
    return extract_pages(views.pages(spark, sf).withColumn("html", with_script)).select("page_id", "content")


def page_title(spark, sf):
    return extract_pages(views.pages(spark, sf)).select(
        "page_id", F.regexp_replace("title", "&", "&amp;").alias("title"))


def page_article_text(spark, sf):
    """Letters and digits of the main text; entities would need a table in SQL."""
    return extract_pages(views.pages(spark, sf)).select(
        "page_id", F.regexp_replace("content", r"(?U)\s+", "").alias("content"))


QUERIES = {
    "combined_text": combined_text, "clean_text": clean_text, "clean_pages": clean_pages,
    "tokens_filtered": tokens_filtered, "text_lengths": text_lengths, "text_quality": text_quality,
    "stemmed_text": stemmed_text, "prepared_corpus": prepared_corpus,
    "corpus_csv_round_trip": corpus_csv_round_trip, "corpus_cache": corpus_cache,
    "page_paragraphs": page_paragraphs,
    "page_extract": page_extract, "page_title": page_title, "page_article_text": page_article_text,
}

_BOTH = "trim(concat(title, ' ', content))"

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&#39;", "''"), ("&amp;", "&"))


def _readable(html):
    """Text of a piece of a page whose tags are gone: entities read, blanks squeezed."""
    for entity, letter in _ENTITIES:
        html = f"replace({html}, '{entity}', '{letter}')"
    return f"trim(regexp_replace({html}, '\\s+', ' ', 'g'))"


_BARE = "regexp_replace({0}, '(?s)<[^>]*>', '{1}', 'g')"

ORACLES = {
    "stemmed_text": f"WITH {stemmed_list('text')} SELECT doc_id, processed_text FROM stemmed",
    "page_extract": f"""SELECT page_id, url, {_readable("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} AS title,
        {_readable(_BARE.format("regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1)", ''))} AS content,
        CAST(NULL AS VARCHAR) AS error FROM pages""",
    # without a content element all text from the first paragraph to the end of the section counts
    "page_paragraphs": f"""SELECT page_id, {_readable(_BARE.format(
        "regexp_replace(regexp_extract(html, '(?is)<p>(.*)</article>', 1), '(?i)</?p>', ' ', 'g')", ''))} AS content FROM pages""",
    "combined_text": f"""WITH {RAW}, c AS (SELECT doc_id, concat(CASE WHEN doc_id % 3 <> 0 THEN title ELSE '' END,
        ' ', content) AS combined FROM raw) SELECT doc_id, combined, length(combined) AS text_length FROM c""",
    "clean_text": f"SELECT doc_id, {clean('text')} AS clean FROM documents",
    "clean_pages": f"SELECT page_id, {clean('html')} AS clean FROM pages",
    "tokens_filtered": f"SELECT doc_id, array_to_string({content_word_list('text')}, ' ') AS tokens FROM documents",
    "text_lengths": f"""WITH {RAW} SELECT doc_id, length({clean(_BOTH)}) AS clean_length,
        length(array_to_string({content_word_list(_BOTH)}, ' ')) AS words_length FROM raw""",
    "text_quality": """SELECT conv_id * 1000 + turn AS idx, '' AS title,
        CASE WHEN turn % 4 = 3 OR regexp_replace(text, '\\s+', '', 'g') = '' THEN 'No text provided for prediction' END AS error
        FROM conversations""",
    "prepared_corpus": f"""WITH {LABELLED} SELECT doc_id, label FROM labelled
        WHERE len({content_word_list("concat(title, ' ', text)")}) > 0""",
    "corpus_csv_round_trip": f"""WITH {LABELLED} SELECT md5(trim(title)) AS title_hash,
        length(trim(text)) AS text_length, label FROM labelled""",
    "corpus_cache": f"""WITH {LABELLED} SELECT label, count(*) AS n FROM labelled
        WHERE len({content_word_list("concat(title, ' ', text)")}) > 0 GROUP BY label""",
    "page_title": "SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM pages",
    "page_article_text": """SELECT page_id, regexp_replace(replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '(?s)<[^>]*>', '', 'g'),
        '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ''), '&#39;', ''''), '&amp;', '&'), '\\s+', '', 'g') AS content FROM pages""",
}
