"""Landed feed payloads (RSS 2.0, RSS 1.0, Atom) to entries.

One payload is one row; parsing is a column function, so it runs where the rows
are and a malformed payload only marks its own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import entry_published

_ITEM = """STRUCT<
  title:STRING, link:STRING, guid:STRUCT<_VALUE:STRING, _isPermaLink:STRING>,
  description:STRING, summary:STRING, `content:encoded`:ARRAY<STRING>,
  author:STRING, `dc:creator`:STRING, category:ARRAY<STRING>, `dc:subject`:ARRAY<STRING>,
  pubDate:STRING, `dc:date`:STRING>"""

_ENTRY = """STRUCT<
  title:STRING, link:ARRAY<STRUCT<_href:STRING, _rel:STRING>>,
  summary:STRING, content:ARRAY<STRING>, published:STRING, updated:STRING,
  author:ARRAY<STRUCT<name:STRING, email:STRING>>, category:ARRAY<STRUCT<_term:STRING>>>"""

PAYLOAD_DDL = f"""
  channel STRUCT<title:STRING, description:STRING, lastBuildDate:STRING, pubDate:STRING,
                 `dc:date`:STRING, item:ARRAY<{_ITEM}>>,
  item ARRAY<{_ITEM}>,
  title STRING, subtitle STRING, updated STRING, entry ARRAY<{_ENTRY}>,
  broken STRING""".replace("\n", " ")

_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}


def _filled(*values: Column) -> Column:
    """First value that is neither null nor empty; else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def _rss_item(i: Column) -> Column:
    summary = _filled(i["summary"], i["description"])
    link = F.coalesce(i["link"], F.when(
        F.coalesce(i["guid"]["_isPermaLink"], F.lit("true")) == "true", i["guid"]["_VALUE"]))
    tags = F.concat(F.coalesce(i["category"], F.array()), F.coalesce(i["dc:subject"], F.array()))
    return F.struct(
        F.coalesce(i["title"], F.lit("")).alias("title"),
        F.coalesce(link, F.lit("")).alias("link"),
        summary.alias("summary"),
        _filled(F.get(i["content:encoded"], 0), summary).alias("content"),
        i["pubDate"].alias("published_text"), i["dc:date"].alias("updated_text"),
        _filled(i["dc:creator"], i["author"]).alias("author"),
        F.filter(tags, lambda t: t.isNotNull()).alias("tags"))


def _atom_entry(e: Column) -> Column:
    alternate = F.filter(
        e["link"], lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    summary = F.coalesce(e["summary"], F.lit(""))
    first = F.get(e["author"], 0)
    author = F.when(first["email"].isNotNull() & first["name"].isNotNull(),
                    F.concat(first["name"], F.lit(" ("), first["email"], F.lit(")"))
                    ).otherwise(_filled(first["name"], first["email"]))
    return F.struct(
        F.coalesce(e["title"], F.lit("")).alias("title"),
        F.coalesce(F.get(alternate, 0)["_href"], F.lit("")).alias("link"),
        summary.alias("summary"),
        _filled(F.get(e["content"], 0), summary).alias("content"),
        e["published"].alias("published_text"), e["updated"].alias("updated_text"),
        author.alias("author"),
        F.filter(F.transform(F.coalesce(e["category"], F.array()), lambda c: c["_term"]),
                 lambda t: t.isNotNull()).alias("tags"))


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """One row per payload: status, feed metadata and the list of entries.

    The list is as long as its payload; it is exploded by the next step and never
    crosses a shuffle.
    """
    p = payloads.select("feed_key", "fetched_at", "payload",
                        F.from_xml("payload", F.lit(PAYLOAD_DDL), _OPTIONS).alias("p"))
    broken = F.col("payload").isNull() | F.col("p.broken").isNotNull()
    nothing = F.array()
    entries = F.concat(
        F.transform(F.coalesce(F.col("p.channel.item"), nothing), _rss_item),
        F.transform(F.coalesce(F.col("p.item"), nothing), _rss_item),
        F.transform(F.coalesce(F.col("p.entry"), nothing), _atom_entry))
    return p.select(
        "feed_key", "fetched_at",
        F.when(broken, "error").otherwise("success").alias("status"),
        F.when(broken, "Feed parsing error: payload is not well-formed").alias("error_message"),
        _filled(F.col("p.channel.title"), F.col("p.title")).alias("feed_title"),
        _filled(F.col("p.channel.description"), F.col("p.subtitle")).alias("feed_description"),
        _filled(F.col("p.channel.lastBuildDate"), F.col("p.updated"), F.col("p.channel")["dc:date"],
                F.col("p.channel.pubDate")).alias("feed_updated"),
        F.when(~broken, entries).otherwise(F.lit(None)).alias("entries"))


def entries_to_articles(parsed: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries as article rows; name and category come from the feed registry.

    ``feeds`` is joined without a hint: the optimiser broadcasts it while it is small
    enough, and payload rows of one feed are few per run.
    """
    registry = feeds.select(F.col("key").alias("feed_key"), F.col("name").alias("source"), "category")
    rows = (parsed.filter("status = 'success'")
            .join(registry, "feed_key")
            .select("feed_key", "fetched_at", "source", "category", F.explode("entries").alias("e")))
    return rows.select(
        "e.title", "e.summary", "e.content", "e.link",
        entry_published("e.published_text", "e.updated_text", "fetched_at").alias("published"),
        "source", "category", "e.author", "e.tags", "feed_key", "fetched_at")
