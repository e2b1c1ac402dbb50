"""Blocks, patterns, 3-grams and pages: each against the plain way, on random rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from newsloom.operators import contains, filters, grams, pages, postings, search
from newsloom.operators.search import BooleanSpec, Clause, SearchSpec

SCHEMA = ("article_id string, title string, summary string, content string, published timestamp, source string, "
          "category string, author string, tags array<string>, link string, created_at timestamp")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(n, seed=1):
    """Articles over a small vocabulary, so that some words are in nearly all of them."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["étude", "x.y", "longword", "wörter"]
    pick = lambda k: " ".join(words[min(int(rng.expovariate(0.15)), len(words) - 1)] for _ in range(k))
    out = []
    for i in range(n):
        when = None if rng.random() < 0.1 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=rng.randrange(200))
        made = None if rng.random() < 0.1 else dt.datetime(2024, 2, 1) + dt.timedelta(hours=rng.randrange(50))
        out.append((f"{rng.randrange(10**9):09d}", rng.choice([None, "", pick(rng.randrange(1, 6))]), pick(rng.randrange(0, 12)),
                    pick(rng.choice([3, 10, 60, 200])), when, rng.choice(["A", "B"]), rng.choice(["n", "m", None]), None, None, None, made))
    return list({r[0]: r for r in out}.values())


@pytest.fixture(scope="module")
def articles(spark):
    return spark.createDataFrame(rows(300), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def index(articles, tmp_path_factory):
    """Two batches of different lengths of text, so that the means of the batches differ."""
    path = str(tmp_path_factory.mktemp("blocks"))
    layout = postings.IndexLayout(4, 2)
    first = articles.filter(F.length("content") < 150)
    assert postings.write_index(first, path, 0, stem=False, layout=layout) == first.count()
    assert postings.write_index(articles, path, 1, stem=False, layout=layout) == articles.count() - first.count()
    assert postings.write_index(articles, path, 1, stem=False, layout=layout) == articles.count() - first.count()
    return postings.load_index(articles.sparkSession, path)


def as_rows(df):
    return [(r.article_id, r.score) for r in df.collect()]


@pytest.mark.parametrize("query,kw", [
    ("w0", {}), ("w1 w0", {}), ("w3", {"page": 2, "per_page": 7}), ("w0 w2 w5", {"per_page": 3}), ("longword", {}),
    ("w0 absent", {}), ("the", {}), ("w1", {"category": "n", "source": "A", "per_page": 5}), ("w0", {"page": 40}),
    ("étude w1", {"fields": ("content",)}), ("w2", {"fields": ("title", "content", "source")})])
def test_blocks_give_the_same_page(index, query, kw):
    spec = SearchSpec(query, **kw)
    want = as_rows(search.result_page(search.match_all(index, spec), spec))
    for first_rows in (1, 20):
        page, read = search.best_page(index, spec, whole_below=0, first_rows=first_rows)
        assert as_rows(page) == want
        assert read.rows <= read.total
    assert as_rows(search.search_ids(index, spec)) == want


def test_pages_behind_a_score(index):
    every = as_rows(search.search_ids(index, SearchSpec("w0 w1", per_page=100)))
    got, after = [], None
    while True:
        page, _ = search.best_page(index, SearchSpec("w0 w1", per_page=9, after=after), whole_below=0, first_rows=10)
        page = as_rows(page)
        if not page or len(got) >= len(every):
            break
        got += page
        after = (page[-1][1], page[-1][0])
    assert got[:len(every)] == every


def test_blocks_are_skipped(index):
    _, read = search.best_page(index, SearchSpec("w0", per_page=5), whole_below=0, first_rows=1)
    assert read.threshold is not None and read.rows < read.total / 2
    page, _ = search.best_page(index, SearchSpec("w0", per_page=5), whole_below=0, first_rows=1)
    assert re.search(r"PushedFilters: \[.*impact", plan(page))


def test_bounds_hold_for_every_posting(index):
    terms = ["w0", "w3", "longword"]
    known = search.blocks.term_blocks(index, index.term_stats.filter(
        F.col("term").isin(terms) & F.col("field").isin(list(postings.DEFAULT_FIELDS))))
    bound = {(t, b.impact): b.bound for t, own in known.items() for b in own}
    hits = index.postings.filter(F.col("term").isin(terms) & F.col("field").isin(list(postings.DEFAULT_FIELDS)))
    scored = search._scored(index, hits, hits, terms, postings.DEFAULT_FIELDS)
    for r in scored.groupBy("term", "impact", "article_id").agg(F.sum("weight").alias("w")).collect():
        assert r.w <= bound[r.term, r.impact] + 1e-9


PATTERNS = ["w1*", "w*", "*1", "*ong*", "?1", "l*d", "*", "é*", "*.y", "w?r*r", "absent*", "w1", "x.?", "??", "*w", "w_*", "%*"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_patterns_find_the_terms(index, articles, pattern):
    every = {r.term for r in index.term_stats.select("term").distinct().collect()}
    shape = re.compile("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern), re.DOTALL)
    assert {r.term for r in search.matching_terms(index, pattern).collect()} == {t for t in every if shape.fullmatch(t)}
    if pattern not in ("w1*", "*ong*", "w?r*r"):
        return
    spec = BooleanSpec(all_of=(Clause("wildcard", pattern),), none_of=(Clause("prefix", "w3"),))
    lazy = postings.index_articles(articles, stem=False)
    want = {r.article_id for r in search.boolean_ids(lazy, spec).collect()}
    assert {r.article_id for r in search.boolean_ids(index, spec).collect()} == want


def test_patterns_read_no_statistics(index, caplog):
    ranged = plan(search.matching_terms(index, "w1*"))
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(term,w1\).*LessThan\(term,w2\)", ranged)
    spec = BooleanSpec(any_of=(Clause("prefix", "w1"), Clause("wildcard", "*ong*")))
    assert "term_stats" not in plan(search.boolean_ids(index, spec)) and "term_grams" in plan(search.boolean_ids(index, spec))
    with caplog.at_level("INFO"):
        search.matching_terms(index, "*")
    assert "all distinct terms" in caplog.text


def test_analysis_runs_no_job(spark):
    tracker, context = spark.sparkContext.statusTracker(), spark.sparkContext
    context.setJobGroup("analysis", "analysis")
    assert search.query_term_lists(["The Cats; state.of.art", "", "of"], True) == [["cat", "state.of.art"], [], []]
    assert list(tracker.getJobIdsForGroup("analysis")) == []
    context.setLocalProperty("spark.jobGroup.id", None)


def test_phrases_start_at_the_rarest_term(index, articles):
    lazy = postings.index_articles(articles, stem=False)
    for phrase in ("w0 w1", "w1 w0 w0", "longword w0", "w0 absent", "w0 w0"):
        want = {tuple(r) for r in search.phrase_ids(lazy, phrase).collect()}
        for broadcast_rows in (0, 1000):
            assert {tuple(r) for r in search.phrase_ids(index, phrase, broadcast_rows=broadcast_rows).collect()} == want
    assert "BroadcastExchange" in plan(search.phrase_ids(index, "longword w0"))


def test_query_batch_skips_blocks_and_loses_nothing(spark, index):
    queries = ["w0", "w1 w0", "w3", "longword", "w0 w2 w5", "absent w0", "étude w1", "w0"]
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for first_rows in (1, 10_000):
        got = {}
        for r in search.query_batch(index, asked, k=4, first_rows=first_rows, rows_per_salt=50).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.article_id, r.score)
        for i, q in enumerate(queries):
            want = as_rows(search.search_ids(index, SearchSpec(q, per_page=4)))
            assert [got.get(i, {}).get(k + 1) for k in range(len(want))] == want and len(got.get(i, {})) == len(want)


NEEDLES = ["w1", "w1 w", "longword", "W1 ", "w%longw", "w_ w", "é", "ÉTUDE", "x.y w0", "absent", "%", "w0%w39 ", "100\\%", "  ", "ö"]


@pytest.fixture(scope="module")
def lists(articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grams"))
    for batch in (0, 1, 1):
        contains.write_grams(articles.filter(F.pmod(F.col("article_id").cast("long"), F.lit(2)) == batch), path, batch,
                             contains.GramLayout(4, 2, 64))
    return path


@pytest.mark.parametrize("needle", NEEDLES)
def test_contains_equals_a_scan(spark, articles, lists, needle):
    for escape in (False, True) if set(needle) & set("%_") else (False,):
        want = sorted(r.article_id for r in filters.contains_filter(articles, needle, escape=escape).collect())
        for rows_ in (0, 100_000):
            got = contains.search_contains(spark, lists, articles.schema, needle, escape=escape, broadcast_rows=rows_)
            assert sorted(r.article_id for r in got.collect()) == want
            assert got.columns == articles.columns


def test_contains_opens_the_buckets_of_its_candidates(spark, articles, lists):
    got = contains.search_contains(spark, lists, articles.schema, "w35 w1")
    assert "dynamicpruning" in plan(got).lower()
    got.collect()
    done = plan(got)
    opened = int(re.search(r"number of partitions read: (\d+)", done).group(1)) if "number of partitions read" in done else None
    assert opened is None or opened < 64
    assert contains.plan_contains(spark, lists, "w1").scan and not contains.plan_contains(spark, lists, "w35").scan
    with pytest.raises(ValueError):
        contains.write_grams(articles, lists, 2, contains.GramLayout(8, 1, 64))


def test_pieces():
    assert grams.like_pieces("a%b_cd\\%e\\\\f") == ["a", "b", "cd%e\\f"] and grams.like_pieces("%_") == []
    assert grams.literal_prefix("ab*c?") == "ab" and grams.literal_prefix("?a") == "" and grams.literal_prefix("abc") == "abc"
    assert grams.after_prefix("ab") == "ac" and grams.after_prefix("a\U0010ffff") == "b" and grams.after_prefix("퟿") == ""
    assert grams.after_prefix("\U0010ffff") is None
    assert grams.piece_grams(["abcd", "bcd", "x"]) == ["abc", "bcd"]


@pytest.mark.parametrize("order", sorted(pages.ORDERS))
def test_pages_walk_the_whole_table(spark, articles, tmp_path, order):
    path = str(tmp_path / order)
    pages.write_ordered(articles, path, order, rows_per_range=30)
    column = pages.ORDERS[order][0]
    want = [r.article_id for r in articles.orderBy(*pages._sort(order)).collect()]
    for condition in (None, F.col("source") == "A"):
        kept = want if condition is None else [r.article_id for r in articles.filter(condition).orderBy(*pages._sort(order)).collect()]
        got, token = [], None
        while True:
            page = pages.page_after(spark, path, articles.schema, order, token, 40, condition).collect()
            if not page:
                break
            got += [r.article_id for r in page]
            token = pages.PageToken(page[-1][column], page[-1].article_id)
        assert got == kept


def test_a_deep_page_opens_few_ranges(spark, articles, tmp_path):
    path = str(tmp_path / "deep")
    pages.write_ordered(articles, path, "title", rows_per_range=20)
    rows_ = articles.orderBy(*pages._sort("title")).collect()
    token = pages.PageToken(rows_[200].title, rows_[200].article_id)
    page = pages.page_after(spark, path, articles.schema, "title", token, 10)
    assert [r.article_id for r in page.collect()] == [r.article_id for r in rows_[201:211]]
    named = re.search(r"PartitionFilters: \[.*?page_range#\d+L? IN \(([\d, ]+)\)|page_range#\d+ = (\d+)", plan(page))
    assert named and len((named.group(1) or named.group(2)).split(",")) <= 2


def test_small_ranges_need_no_task_each(spark, articles, tmp_path, monkeypatch):
    asked, given = [], type(articles).repartitionByRange
    monkeypatch.setattr(type(articles), "repartitionByRange", lambda self, n, *cols: asked.append(n) or given(self, n, *cols))
    monkeypatch.setattr(pages, "TASK_ROWS", 100)
    path, n = str(tmp_path / "tiny"), articles.count()
    pages.write_ordered(articles, path, "title", rows_per_range=1)
    assert asked == [-(-n // 100)]
    assert spark.read.parquet(f"{path}/title/ranges").filter("n = 1").count() == n
    rows_ = articles.orderBy(*pages._sort("title")).collect()
    page = pages.page_after(spark, path, articles.schema, "title", pages.PageToken(rows_[-3].title, rows_[-3].article_id), 10)
    assert [r.article_id for r in page.collect()] == [r.article_id for r in rows_[-2:]]
    assert pages.page_after(spark, path, articles.schema, "title", pages.PageToken(rows_[-1].title, rows_[-1].article_id)).count() == 0


def test_postings_nobody_asks_for_are_dropped_before_a_shuffle(spark):
    rows_ = spark.range(20_000).selectExpr("cast(id % 100 as string) AS term", "cast(id as string) AS article_id", "id AS tf")
    asked = rows_.filter("tf % 50 = 0").select("term", "article_id").unionByName(
        spark.createDataFrame([("none", "none"), ("none", None)], "term string, article_id string"))
    left = search._screened(rows_, asked, ["term", "article_id"])
    assert left.columns == rows_.columns and 400 <= left.count() < 500
    assert left.filter("tf % 50 = 0").count() == 400 and search._screened(rows_, asked.limit(0), ["term"]).count() == 0
