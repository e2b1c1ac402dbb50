import datetime as dt

import pytest
from pyspark.sql import functions as F

from newsloom.functions.dates import parse_feed_date
from newsloom.operators import dedupe
from newsloom.sources import feeds

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)
NS = ('xmlns:content="http://purl.org/rss/1.0/modules/content/" xmlns:dc="http://purl.org/dc/elements/1.1/" '
      'xmlns:media="http://search.yahoo.com/mrss/" xmlns:atom="http://www.w3.org/2005/Atom"')


def rss(*items, head="<title>Chan</title><description>Desc</description>"):
    return f'<?xml version="1.0"?><rss version="2.0" {NS}><channel>{head}{"".join(items)}</channel></rss>'


FULL = """<item><title>One &amp; two</title><media:title>no</media:title><link>http://e.org/1</link>
<description>short</description><content:encoded><![CDATA[<p>long</p>]]></content:encoded><dc:creator>Ann</dc:creator>
<category>a</category><category domain="d">b</category><pubDate>Tue, 02 Jan 2024 03:04:05 +0100</pubDate></item>"""
BARE = "<item><guid>http://e.org/2</guid></item>"
BAD_DATE = """<item><title>t</title><link>l</link><summary></summary><description>d</description>
<pubDate>soon</pubDate><dc:date>2024-02-03T04:05:06Z</dc:date><category/></item>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title><subtitle>S</subtitle>
<updated>2024-01-01T00:00:00Z</updated><entry><title type="html">At</title><link rel="self" href="http://self"/>
<link href="http://alt"/><updated>2024-03-01T10:00:00+02:00</updated><summary>sum</summary>
<author><name>N</name><email>n@e.org</email></author><category term="x"/><category label="none"/></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="d">
<channel><title>R</title></channel><item><title>r</title><link>http://r</link><dc:date>2024-04-01</dc:date>
<dc:subject>s</dc:subject></item></rdf:RDF>"""


@pytest.fixture(scope="module")
def parsed(spark):
    rows = [("full", rss(FULL)), ("none", rss()), ("many", rss(BARE, BAD_DATE, FULL)), ("atom", ATOM), ("rdf", RDF),
            ("cut", rss(FULL)[:300]), ("null", None), ("blank", "")]
    df = spark.createDataFrame([(k, NOW, p) for k, p in rows], "feed_key string, fetched_at timestamp, payload string")
    return feeds.parse_payloads(df)


def test_status_per_payload(parsed):
    got = {r.feed_key: (r.status, len(r.entries) if r.entries is not None else None) for r in parsed.collect()}
    assert got == {"full": ("success", 1), "none": ("success", 0), "many": ("success", 3), "atom": ("success", 1),
                   "rdf": ("success", 1), "cut": ("error", None), "null": ("error", None), "blank": ("error", None)}


def test_metadata(parsed):
    got = {r.feed_key: (r.feed_title, r.feed_description, r.feed_updated) for r in parsed.collect()}
    assert got["full"] == ("Chan", "Desc", "")
    assert got["atom"] == ("A", "S", "2024-01-01T00:00:00Z")
    assert got["rdf"] == ("R", "", "")


@pytest.fixture(scope="module")
def articles(spark, parsed):
    registry = spark.createDataFrame([(k, k.title(), "Cat") for k in ("full", "many", "atom", "rdf", "none", "cut")],
                                     "key string, name string, category string")
    return {(r.feed_key, r.link): r for r in feeds.entries_to_articles(parsed, registry).collect()}


def test_rss_entry(articles):
    r = articles["full", "http://e.org/1"]
    assert (r.title, r.summary, r.content, r.author, r.tags) == ("One & two", "short", "<p>long</p>", "Ann", ["a", "b"])
    assert (r.source, r.category, r.published) == ("Full", "Cat", dt.datetime(2024, 1, 2, 2, 4, 5))


def test_missing_parts(articles):
    r = articles["many", "http://e.org/2"]
    assert (r.title, r.summary, r.content, r.author, r.tags, r.published) == ("", "", "", "", [], NOW)


def test_bad_date_falls_to_updated_and_summary_to_description(articles):
    r = articles["many", "l"]
    assert (r.summary, r.content, r.published) == ("d", "d", dt.datetime(2024, 2, 3, 4, 5, 6))


def test_atom_and_rdf(articles):
    a, r = articles["atom", "http://alt"], articles["rdf", "http://r"]
    assert (a.title, a.content, a.author, a.tags, a.published) == (
        "At", "sum", "N (n@e.org)", ["x"], dt.datetime(2024, 3, 1, 8, 0))
    assert (r.title, r.tags, r.published) == ("r", ["s"], dt.datetime(2024, 4, 1))


DATES = {
    "Tue, 2 Jan 2024 03:04:05 GMT": (2024, 1, 2, 3, 4, 5), "02 Jan 2024 03:04 EST": (2024, 1, 2, 8, 4, 0),
    "Tue, 02 Jan 24 03:04:05 PDT": (2024, 1, 2, 10, 4, 5), "Tue, 02 Jan 2024 03:04:05": (2024, 1, 2, 3, 4, 5),
    "Tuesday, 02 Jan 2024 03:04:05 -0230": (2024, 1, 2, 5, 34, 5), "2024-01-02T03:04:05Z": (2024, 1, 2, 3, 4, 5),
    "2024-01-02T03:04:05.250+01:00": (2024, 1, 2, 2, 4, 5, 250000), "2024-01-02T03:04:05+0100": (2024, 1, 2, 2, 4, 5),
    "2024-01-02": (2024, 1, 2), "2024-01-02 03:04": (2024, 1, 2, 3, 4), "soon": None, "": None, "99 Foo 2024": None,
    "Tue, 02 Jan 2024 03:04:05 XYZ": None}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "s string")
    got = {r.s: r.d for r in df.select("s", parse_feed_date("s").alias("d")).collect()}
    for text, parts in DATES.items():
        assert got[text] == (dt.datetime(*parts) if parts else None), text


def test_copies_collapse_to_the_first(spark):
    rows = [("T", "L", dt.datetime(2024, 1, d), f"f{d}") for d in (3, 1, 2)] + [("T2", "L", NOW, "f")]
    df = dedupe.with_article_id(spark.createDataFrame(rows, "title string, link string, published timestamp, feed_key string"))
    got = dedupe.first_per_article(df.repartition(3)).collect()
    assert sorted((r.title, r.feed_key) for r in got) == [("T", "f1"), ("T2", "f")]


def test_not_stored(spark):
    new = spark.createDataFrame([("a",), ("b",), ("c",)], "article_id string")
    old = spark.createDataFrame([("b",), ("z",)], "article_id string")
    assert sorted(r.article_id for r in dedupe.not_stored(new, old).collect()) == ["a", "c"]
    assert dedupe.not_stored(new, old.filter(F.lit(False))).count() == 3
