import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

from newsloom.functions.stemming import porter_stem
from newsloom.functions.wordlists import SEARCH_STOP_WORDS
from newsloom.operators import filters, postings, search
from newsloom.operators.search import BooleanSpec, Clause, SearchSpec
from newsloom.plans.search import search_articles, search_total

D = [dt.datetime(2024, 1, d) for d in range(1, 9)]
ARTICLES = [
    # id, title, summary, content, published, source, category, author, tags
    ("a", "Cats running", "A cat runs", "The cats were running and a dog barked", D[0], "Wire One", "News", "Ann", ["x", "Y y"]),
    ("b", "Dogs", "dogs dogs dogs", "dogs and more dogs, cats never", D[1], "Wire One", "Special Reports", "Bob", ["x"]),
    ("c", "Running shoes", "", "running shoes for running", D[2], "Wire Two", "news", None, None),
    ("d", "100% off_sale", None, "Nothing to see", None, "Wire Two", "Sale", "Running Ann", []),
    ("e", "Running shoes", "", "running shoes for running", D[2], "Wire Two", "news", None, None),
    ("f", "", "", "", D[4], "", "", None, None),
    ("g", "État été", "naïve café", "L'été: cats—dogs state.of.art", D[5], "Wire One", "News", "Zoë", ["x"]),
]
SCHEMA = ("article_id string, title string, summary string, content string, published timestamp, source string, "
          "category string, author string, tags array<string>")
FIELDS = {"title": 1, "summary": 2, "content": 3}


@pytest.fixture(scope="module")
def articles(spark):
    df = spark.createDataFrame(ARTICLES, SCHEMA)
    return df.withColumn("created_at", F.col("published")).withColumn(
        "link", F.concat(F.lit("http://e.org/"), "article_id"))


@pytest.fixture(scope="module")
def index(articles, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    layout = postings.IndexLayout(4, 2)
    postings.write_index(articles, path, layout=layout)
    return postings.load_index(articles.sparkSession, path, layout)


def words(text):
    found = re.findall(r"\w+(?:\.\w+)*", (text or "").lower())
    return [porter_stem(w, False) for w in found if len(w) > 1 and w not in SEARCH_STOP_WORDS]


def brute_force(query):
    """BM25 by hand: article to score, of articles that hold all terms."""
    tokens = {f: {a[0]: words(a[i]) for a in ARTICLES} for f, i in FIELDS.items()}
    terms, out = set(words(query)), {}
    for a in ARTICLES:
        if not terms or not all(any(t in tokens[f][a[0]] for f in FIELDS) for t in terms):
            continue
        score = 0.0
        for f in FIELDS:
            mean = sum(map(len, tokens[f].values())) / len(ARTICLES)
            for t in terms:
                tf = tokens[f][a[0]].count(t)
                if tf:
                    df = sum(t in tokens[f][x] for x in tokens[f])
                    idf = math.log(len(ARTICLES) / (df + 1)) + 1
                    score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[f][a[0]]) / mean))
        out[a[0]] = round(score, 6)
    return out


@pytest.mark.parametrize("query", ["cats", "running", "Running cat", "dogs", "the and", "absent cats", "été", "state.of.art",
                                   "cats cats", "shoes running"])
def test_scores_equal_brute_force(articles, index, query):
    want = brute_force(query)
    for ix in (index, postings.index_articles(articles)):
        got = {r.article_id: r.score for r in search.match_all(ix, SearchSpec(query)).collect()}
        assert got == pytest.approx(want, abs=2e-6), query


def test_order_ties_and_pages(index):
    def ids(**kw):
        return [r.article_id for r in search.search_ids(index, SearchSpec("running shoes", **kw)).collect()]
    assert ids() == ["c", "e"] and ids(per_page=1) == ["c"] and ids(per_page=1, page=2) == ["e"]
    assert ids(per_page=1, page=3) == []
    first = search.search_ids(index, SearchSpec("running shoes", per_page=1)).first()
    assert ids(after=(first.score, first.article_id)) == ["e"]


def test_pages_partition_the_result(index):
    every = [r.article_id for r in search.search_ids(index, SearchSpec("cats", per_page=100)).collect()]
    paged = [r.article_id for p in (1, 2, 3) for r in
             search.search_ids(index, SearchSpec("cats", per_page=1, page=p)).collect()]
    assert paged == every


def test_date_order_puts_missing_times_last(index):
    spec = SearchSpec("running", sort_by="date", fields=("title", "author"))
    assert [r.article_id for r in search.search_ids(index, spec).collect()] == ["c", "e", "a"]


@pytest.mark.parametrize("mode,category,want", [
    ("value", "NEWS", {"a", "g"}), ("value", "special reports", {"b"}), ("token", "Special Reports", set()),
    ("token", "reports", {"b"})])
def test_keyword_filter(index, articles, mode, category, want):
    spec = SearchSpec("cats", category=category, keyword_mode=mode)
    assert {r.article_id for r in search.match_all(index, spec).collect()} == want
    hit = {r.article_id for r in filters.keyword_filter(articles, "category", category, mode).collect()}
    assert want <= hit


def test_phrases(index):
    def ids(p):
        return {r.article_id for r in search.phrase_ids(index, p).collect()}
    assert ids("running shoes") == {"c", "e"}
    assert ids("dogs dogs dogs") == {"b"} and ids("dogs dogs dogs dogs") == set()
    assert ids("cats were running") == {"a"} and ids("running were cats") == set()
    assert ids("dogs and more dogs") == {"b"}           # stop words take no place
    assert ids("the") == set()


def test_boolean(index, articles):
    def ids(**kw):
        return {r.article_id for r in search.boolean_ids(index, BooleanSpec(**kw), articles).collect()}
    cats, dogs = Clause("term", "cats"), Clause("term", "dog")
    assert ids(all_of=(cats, dogs)) == {"a", "b", "g"}
    assert ids(all_of=(cats,), none_of=(dogs,)) == set()
    assert ids(any_of=(Clause("prefix", "sho"), Clause("wildcard", "s?e"))) == {"c", "d", "e"}
    assert ids(none_of=(Clause("wildcard", "*"),)) == {"f"}
    assert ids(any_of=(Clause("term", "Special Reports", "category"), Clause("term", "y y", "tags"))) == {"a", "b"}
    assert ids(any_of=(Clause("term", "Running", "author"),)) == {"d"}
    assert ids(all_of=(cats,), published_from=D[1], published_to=D[4]) == {"b"}
    with pytest.raises(ValueError):
        search.boolean_ids(index, BooleanSpec(none_of=(cats,)))


def test_query_batch_equals_single_searches(spark, index, articles):
    queries = ["cats", "running shoes", "dogs cats", "absent", "the", "running running"]
    df = spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")
    for ix in (index, postings.index_articles(articles)):
        got = {}
        for r in search.query_batch(ix, df, k=3).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = (r.article_id, r.score)
        for i, q in enumerate(queries):
            best = sorted(brute_force(q).items(), key=lambda kv: (-kv[1], kv[0]))[:3]
            assert [got.get(i, {}).get(k + 1) for k in range(len(best))] == [
                (a, pytest.approx(s, abs=2e-6)) for a, s in best]
            assert len(got.get(i, {})) == len(best)


def test_contains_and_fallback(articles):
    def ids(*a, **kw):
        return {r.article_id for r in filters.contains_filter(articles, *a, **kw).collect()}
    assert ids("%") == {a[0] for a in ARTICLES} and ids("%", escape=True) == {"d"}
    assert ids("off_s") == {"d"} and ids("f_s", escape=True) == {"d"} and ids("f_s") >= {"d"}
    assert ids("ÉTÉ") == {"g"} and ids(None) == ids("") == {a[0] for a in ARTICLES}
    assert ids("cats", category="NEW", source="one") == {"a", "g"}
    page = search_articles(articles, SearchSpec("running", per_page=2))
    assert [r.article_id for r in page.collect()] == ["c", "e"]
    assert search_total(articles, SearchSpec("running")).first().total == 3


def test_ranked_page_has_stored_fields(articles, index):
    rows = search_articles(articles, SearchSpec("running shoes"), index).collect()
    assert {(r.article_id, tuple(r.tags)) for r in rows} == {("c", ()), ("e", ())}
    assert search_total(articles, SearchSpec("running shoes"), index).first().total == 2


@pytest.mark.parametrize("bad", [dict(query=""), dict(query="x" * 201), dict(query="x", page=0),
                                 dict(query="x", per_page=101), dict(query="x", sort_by="title")])
def test_arguments(bad):
    with pytest.raises(ValueError):
        SearchSpec(**bad)


def test_not_indexed(index, articles, tmp_path):
    path = str(tmp_path / "i")
    assert postings.not_indexed(articles, path).count() == len(ARTICLES)
    postings.write_index(articles.filter("article_id < 'd'"), path, layout=postings.IndexLayout(2, 1))
    left = {r.article_id for r in postings.not_indexed(articles, path).collect()}
    assert left == {"d", "e", "f", "g"}


def test_positions_rebuild_the_text(articles):
    rows = postings.build_postings(articles, stem=False).filter("field = 'content'").collect()
    for a in ARTICLES:
        placed = {p: r.term for r in rows if r.article_id == a[0] for p in r.positions}
        plain = [w for w in re.findall(r"\w+(?:\.\w+)*", a[3].lower()) if len(w) > 1 and w not in SEARCH_STOP_WORDS]
        assert [placed[i] for i in range(len(placed))] == plain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_written_index_prunes_and_pushes_down(index):
    text = plan(search.search_ids(index, SearchSpec("running shoes")))
    assert re.search(r"PartitionFilters: \[.*field.*term_bucket", text)
    assert re.search(r"PushedFilters: \[.*In\(term|PushedFilters: \[.*term", text)
    assert "TakeOrderedAndProject" in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_postings_are_made_without_a_shuffle(articles):
    assert "Exchange" not in plan(postings.build_postings(articles))
