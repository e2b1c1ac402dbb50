"""Searches over the postings table.

A search reads the postings of its own terms (partition and row-group pruning),
groups them by article and takes a top-k.  Its cost follows the length of these
lists, not the corpus.  On a written index a search for the best hits also skips
blocks of frequent terms (:mod:`.blocks`), a phrase starts at its rarest term, and prefixes
and wildcards are looked up among the distinct terms.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.stemming import porter_stem, stem_words
from ..functions.text import search_tokens
from ..session import scratch_path
from . import blocks, grams, postings
from .blocks import BlockPlan
from .postings import BM25_B, BM25_K1, DEFAULT_FIELDS, KEYWORD_FIELDS, PLAIN_FIELDS, SearchIndex, term_bucket

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class SearchSpec:
    """One search.

    ``after`` continues without an offset behind the last row of a page: (score, article_id), or
    (published, article_id) when sorted by date.  Queries and pages have a largest size; both
    limits are parameters, and what is larger is refused, not cut.
    """
    query: str
    category: str | None = None
    source: str | None = None
    page: int = 1
    per_page: int = 20
    sort_by: str = "relevance"
    fields: tuple[str, ...] = DEFAULT_FIELDS
    keyword_mode: str = "value"
    after: tuple[object, str] | None = None
    max_query_length: int = 200
    max_per_page: int = 100

    def __post_init__(self):
        if not 1 <= len(self.query) <= self.max_query_length:
            raise ValueError(f"query must have 1 to {self.max_query_length} characters")
        if self.page < 1 or not 1 <= self.per_page <= self.max_per_page:
            raise ValueError(f"page must be at least 1 and per_page between 1 and {self.max_per_page}")
        if self.sort_by not in ("relevance", "date"):
            raise ValueError("sort_by must be 'relevance' or 'date'")


def query_term_lists(texts: list[str], stem: bool, spark: SparkSession | None = None) -> list[list[str]]:
    """Terms of several query texts, in order: they go through the analyser of the index itself.

    The texts are constants of the plan, so it is evaluated where it is made and no job is run.
    """
    if not texts:
        return []
    spark = spark or SparkSession.active()
    rows = ", ".join(f"({i}, :q{i})" for i in range(len(texts)))
    given = spark.sql(f"SELECT * FROM VALUES {rows} AS t(at, q)", args={f"q{i}": t for i, t in enumerate(texts)})
    words = {r.at: r.words for r in given.select("at", search_tokens("q").alias("words")).collect()}
    return [[porter_stem(w, extended=False) for w in words[i]] if stem else words[i] for i in range(len(texts))]


def query_terms(text: str, stem: bool, spark: SparkSession | None = None) -> list[str]:
    """Terms of a query, in order."""
    return query_term_lists([text], stem, spark)[0]


def analyse_query(text: str, index: SearchIndex) -> list[str]:
    """Distinct terms of a query, in order of first use."""
    return list(dict.fromkeys(query_terms(text, index.stem)))


def _hits(index: SearchIndex, terms: list[str], fields) -> DataFrame:
    """Postings of the given terms: looked up, or made for them by a lazy index."""
    if index.look_up is not None:
        return index.look_up(terms, tuple(fields))
    return _of_terms(index.postings, terms, fields, index)


def _of_terms(table: DataFrame, terms: list[str], fields, index: SearchIndex) -> DataFrame:
    """Rows of the given terms; all three conditions reach the scan of a written index."""
    buckets = sorted({term_bucket(t, index.layout) for t in terms})
    return table.filter(F.col("field").isin(list(fields)) & F.col("term_bucket").isin(buckets)
                        & F.col("term").isin(terms))


def _keyword(column: str, value: str, mode: str) -> Column:
    if mode == "value":
        return F.lower(column) == value.lower()
    return F.array_contains(F.split(F.lower(column), r"(?U)\s+"), value.lower())


def _filtered(postings: DataFrame, spec: SearchSpec) -> DataFrame:
    if spec.category:
        postings = postings.filter(_keyword("category", spec.category, spec.keyword_mode))
    if spec.source:
        postings = postings.filter(_keyword("source", spec.source, spec.keyword_mode))
    return postings


def _field_means(index: SearchIndex) -> DataFrame:
    """Articles and mean length per field: as many rows as there are fields."""
    return index.field_stats.groupBy("field").agg(
        F.sum("n_articles").alias("n_articles"),
        (F.sum("total_length") / F.sum("n_articles")).alias("mean_length"))


def _bm25() -> Column:
    idf = F.log(F.col("n_articles") / (F.col("df") + F.lit(1.0))) + 1
    norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * F.col("field_length") / F.col("mean_length")
    return idf * (F.col("tf") * F.lit(BM25_K1 + 1)) / (F.col("tf") + F.lit(BM25_K1) * norm)


def _scored(index: SearchIndex, all_hits: DataFrame, hits: DataFrame, terms: list[str], fields) -> DataFrame:
    """Hits with their BM25 weight.

    Document frequencies come from the statistics of a written index; a lazy one
    counts its hits.  Both broadcast sides have a fixed bound: fields x query terms,
    and fields.
    """
    if index.look_up is not None:
        dfs = all_hits.groupBy("field", "term").agg(F.count("*").alias("df"))
    else:
        dfs = (_of_terms(index.term_stats, terms, fields, index)
               .groupBy("field", "term").agg(F.sum("df").alias("df")))
    return (hits.join(F.broadcast(dfs), ["field", "term"])
            .join(F.broadcast(_field_means(index)), "field")
            .withColumn("weight", _bm25()))


def match_all(index: SearchIndex, spec: SearchSpec) -> DataFrame:
    """Every article that holds every term in any of the fields, with its score.

    ``(article_id, published, score)``.  The score is rounded to 6 places, so that
    equal scores are equal whatever the order of the sum, and ties go by id.
    """
    terms = analyse_query(spec.query, index)
    return _matches(index, spec, terms, _hits(index, terms, spec.fields))


def _matches(index: SearchIndex, spec: SearchSpec, terms: list[str], hits: DataFrame) -> DataFrame:
    scored = _scored(index, hits, _filtered(hits, spec), terms, spec.fields)
    held = [F.max(F.col("term") == t).alias(f"has_{i}") for i, t in enumerate(terms)]
    grouped = scored.groupBy("article_id").agg(
        F.max("published").alias("published"), F.round(F.sum("weight"), 6).alias("score"), *held)
    for i in range(len(terms)):
        grouped = grouped.filter(F.col(f"has_{i}"))
    if not terms:                   # only stop words: nothing matches
        grouped = grouped.filter(F.lit(False))
    return grouped.select("article_id", "published", "score")


def best_page(index: SearchIndex, spec: SearchSpec, whole_below: int = 50_000,
              first_rows: int = 4096) -> tuple[DataFrame, BlockPlan]:
    """One page by score of a written index, and which blocks were read for it.

    The best blocks of each term are read until they hold as many hits as the page needs; the last of
    these bounds the page from below, and blocks that stay under it are skipped.  Lists of fewer than
    ``whole_below`` postings are read whole at once.  The rows are those of all hits, sorted and cut.
    """
    terms = analyse_query(spec.query, index)
    hits = _hits(index, terms, spec.fields)
    known = blocks.term_blocks(index, _of_terms(index.term_stats, terms, spec.fields, index)) if terms else {}
    if not terms or len(known) < len(terms):  # a term that no article has
        none = {t: () for t in terms}
        return result_page(_matches(index, spec, terms, hits.filter(F.lit(False))), spec), BlockPlan(none, none)
    wanted = spec.per_page if spec.after is not None else spec.page * spec.per_page
    whole = BlockPlan(known, known)
    rows = max(first_rows, 16 * wanted)
    plan = whole if whole.total <= whole_below else blocks.first_blocks(known, rows)
    while not plan.whole:
        found = _behind(_matches(index, spec, terms, hits.filter(plan.condition())), spec)
        line = found.orderBy(F.col("score").desc()).limit(wanted).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        if line.n == wanted:
            plan = whole.above(line.s)
            break
        rows *= 8
        plan = blocks.first_blocks(known, rows)
    read = hits if plan.whole else hits.filter(plan.condition())
    return result_page(_matches(index, spec, terms, read), spec), plan


def result_page(matches: DataFrame, spec: SearchSpec) -> DataFrame:
    """One page of matches: best score, or newest first.  Past the end it is empty."""
    if spec.sort_by == "date":
        order = [F.col("published").desc_nulls_last(), F.col("article_id")]
    else:
        order = [F.col("score").desc(), F.col("article_id")]
    if spec.after is not None:
        return _behind(matches, spec).orderBy(*order).limit(spec.per_page)
    return matches.orderBy(*order).offset((spec.page - 1) * spec.per_page).limit(spec.per_page)


def _behind(matches: DataFrame, spec: SearchSpec) -> DataFrame:
    """Matches behind the last row of the page before, if one is named."""
    if spec.after is None:
        return matches
    last, last_id = spec.after
    behind = F.col("article_id") > last_id
    if spec.sort_by == "relevance":
        rest = (F.col("score") < last) | ((F.col("score") == last) & behind)
    elif last is None:                  # nulls come last
        rest = F.col("published").isNull() & behind
    else:
        last = F.lit(last).cast(matches.schema["published"].dataType)
        rest = (F.col("published") < last) | ((F.col("published") == last) & behind) | F.col("published").isNull()
    return matches.filter(rest)


def search_ids(index: SearchIndex, spec: SearchSpec) -> DataFrame:
    if index.path is not None and spec.sort_by == "relevance":
        return best_page(index, spec)[0]
    return result_page(match_all(index, spec), spec)


def total_hits(matches: DataFrame) -> DataFrame:
    return matches.agg(F.count("*").alias("total"))


def with_stored_fields(page: DataFrame, articles: DataFrame) -> DataFrame:
    """The rows of one page of hits with their articles, in the order of the page.

    The page (at most ``per_page`` rows) is fetched first and its places are kept as ``rank``.  Its
    ids then go into the scan of the articles as plain comparisons, so that files and row groups
    without them are skipped by their statistics and bloom filters instead of being read for a join.
    """
    rows = page.drop("published").collect()
    names = page.drop("published").schema
    ranked = [(*row, place) for place, row in enumerate(rows, 1)]
    small = articles.sparkSession.createDataFrame(ranked, StructType([*names.fields, StructField("rank", IntegerType())]))
    wanted = F.lit(False)
    for row in rows:
        wanted = wanted | (F.col("article_id") == row.article_id)
    return (articles.filter(wanted).join(F.broadcast(small), "article_id")
            .withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).orderBy("rank"))


def phrase_ids(index: SearchIndex, phrase: str, fields=DEFAULT_FIELDS, broadcast_rows: int = 200_000) -> DataFrame:
    """``(article_id, field)`` where the terms of the phrase stand side by side.

    Positions of the terms of one article meet in one row; each step keeps the places that continue
    the phrase.  On a written index only what has the rarest term is a candidate, and postings of
    the other terms that belong to no candidate are dropped before anything is shuffled; the
    candidates are broadcast for it while the statistics say that they are at most ``broadcast_rows``.
    """
    sequence = query_terms(phrase, index.stem)
    terms = list(dict.fromkeys(sequence))
    if not terms:
        return index.postings.select("article_id", "field").filter(F.lit(False))
    hits = _hits(index, terms, fields).select("article_id", "field", "term", "positions")
    if index.path is not None and len(terms) > 1:
        counted = _of_terms(index.term_stats, terms, fields, index).groupBy("term").agg(F.sum("df").alias("df")).collect()
        df = {t: 0 for t in terms} | {r.term: r.df for r in counted}
        rarest = min(terms, key=lambda t: (df[t], t))
        own = hits.filter(F.col("term") == rarest)
        candidates = own.select("article_id", "field")
        if df[rarest] <= broadcast_rows:
            candidates = F.broadcast(candidates)
        hits = own.unionByName(hits.filter(F.col("term") != rarest).join(candidates, ["article_id", "field"], "left_semi")
                               .select(*own.columns))
    places = hits.groupBy("article_id", "field").agg(*[
        F.first(F.when(F.col("term") == t, F.col("positions")), ignorenulls=True).alias(f"at_{i}")
        for i, t in enumerate(terms)])
    ends = F.col(f"at_{terms.index(sequence[0])}")
    for term in sequence[1:]:
        ends = F.array_intersect(F.transform(ends, lambda p: p + 1), F.col(f"at_{terms.index(term)}"))
    return places.filter(F.size(F.coalesce(ends, F.array().cast("array<int>"))) > 0).select(
        "article_id", "field")


@dataclass(frozen=True)
class Clause:
    """One condition on terms: an exact ``term``, a ``prefix``, or a ``wildcard`` (* and ?)."""
    kind: str
    value: str
    field: str | None = None


@dataclass(frozen=True)
class BooleanSpec:
    """Structured query: every ``all_of``, at least one ``any_of``, no ``none_of``."""
    all_of: tuple[Clause, ...] = ()
    any_of: tuple[Clause, ...] = ()
    none_of: tuple[Clause, ...] = ()
    published_from: object = None
    published_to: object = None
    fields: tuple[str, ...] = DEFAULT_FIELDS


@dataclass(frozen=True)
class _Test:
    """What one clause asks of an article: every one of ``parts`` must hold for some posting."""
    fields: tuple[str, ...]
    terms: tuple[str, ...] = ()          # exact terms, one part each
    pattern: str | None = None           # with * and ?, one part

    @property
    def parts(self) -> int:
        return len(self.terms) + (self.pattern is not None)

    def holds(self, part: int) -> Column:
        matches = F.col("term") == self.terms[part] if self.pattern is None else _like(self.pattern)
        return F.col("field").isin(list(self.fields)) & matches


def _like(pattern: str) -> Column:
    """Terms that match a pattern with * and ?."""
    if pattern.endswith("*") and "*" not in pattern[:-1] and "?" not in pattern:
        return F.col("term").startswith(pattern[:-1])
    for mark in ("\\", "%", "_"):
        pattern = pattern.replace(mark, "\\" + mark)
    return F.col("term").like(pattern.replace("*", "%").replace("?", "_"))


def _tests(groups: dict[str, tuple[Clause, ...]], spec_fields, index: SearchIndex) -> dict[str, _Test]:
    """The test of every clause; the texts of all clauses are analysed at once."""
    named = {f"{name}_{i}": clause for name, clauses in groups.items() for i, clause in enumerate(clauses)}
    words = {name: c for name, c in named.items() if c.kind == "term" and c.field not in KEYWORD_FIELDS}
    split = dict(zip(words, query_term_lists([c.value for c in words.values()], False)))
    out = {}
    for name, clause in named.items():
        fields = (clause.field,) if clause.field else tuple(spec_fields)
        low = clause.value.lower()
        if clause.kind == "term":
            # several words: all of them; stop words only: nothing is asked
            stem = index.stem and clause.field not in PLAIN_FIELDS
            own = [porter_stem(w, extended=False) if stem else w for w in split[name]] if name in split else [low]
            out[name] = _Test(fields, tuple(dict.fromkeys(own)))
        elif clause.kind in ("prefix", "wildcard"):
            out[name] = _Test(fields, pattern=low + "*" if clause.kind == "prefix" else low)
        else:
            raise ValueError(f"unknown clause kind {clause.kind!r}")
    return out


def matching_terms(index: SearchIndex, pattern: str) -> DataFrame:
    """Distinct terms of a written index that match a pattern with * and ?.

    What a pattern begins with is a range of the sorted terms; without that the terms that hold all
    3-grams of its pieces are looked up by gram.  A pattern with neither reads all distinct terms,
    which is logged.
    """
    spark = index.term_stats.sparkSession
    terms = postings.read_terms(spark, index.path)
    prefix = grams.literal_prefix(pattern)
    needed = grams.piece_grams(grams.wildcard_pieces(pattern))
    if prefix and (pattern == prefix + "*" or len(prefix) >= grams.GRAM or not needed):
        terms = terms.filter(F.col("term") >= prefix)
        if (end := grams.after_prefix(prefix)) is not None:
            terms = terms.filter(F.col("term") < end)
    elif needed:
        buckets = sorted({term_bucket(g, index.layout) for g in needed})
        listed = postings.read_term_grams(spark, index.path).filter(
            F.col("gram_bucket").isin(buckets) & F.col("gram").isin(needed))
        terms = (listed.groupBy("term").agg(F.countDistinct("gram").alias("held"))
                 .filter(F.col("held") == len(needed)))
    else:
        _log.info("all distinct terms are read for the pattern %s", pattern)
    return terms.filter(_like(pattern)).select("term").distinct()


def _postings_for(index: SearchIndex, tests: list[_Test]) -> DataFrame:
    """Postings that some test may want.

    Exact terms are looked up in their buckets.  Patterns are first matched against the distinct
    terms, and what is found is then looked up by field, bucket and term.
    """
    exact = [t for t in tests if t.terms]
    loose = [t for t in tests if t.pattern is not None]
    fields = lambda some: sorted({f for t in some for f in t.fields})
    found = index.postings.filter(F.lit(False))
    if exact:
        found = _of_terms(index.postings, sorted({x for t in exact for x in t.terms}), fields(exact), index)
    if loose:
        if index.path is None:
            wanted = F.lit(False)
            for t in loose:
                wanted = wanted | t.holds(0)
            more = index.postings.filter(wanted)
        else:
            listed = None
            for t in loose:
                own = matching_terms(index, t.pattern).select(F.explode(F.array(*[F.lit(f) for f in t.fields])).alias("field"), "term")
                listed = own if listed is None else listed.unionByName(own)
            listed = listed.distinct().withColumn("term_bucket", postings.bucket_column(index.layout))
            more = index.postings.join(listed, ["field", "term_bucket", "term"], "left_semi").select(*index.postings.columns)
        found = found.unionByName(more)
    return found


def boolean_ids(index: SearchIndex, spec: BooleanSpec, universe: DataFrame | None = None) -> DataFrame:
    """``(article_id, published)`` of the articles that satisfy ``spec``.

    A clause of several words wants all of them; one without any indexed word asks nothing.  One
    grouping by article decides all clauses.  A query with only ``none_of`` needs ``universe``, the
    articles to choose from.
    """
    groups = {"all": spec.all_of, "any": spec.any_of, "none": spec.none_of}
    tests = _tests(groups, spec.fields, index)
    flags = [F.max(test.holds(part)).alias(f"{name}_{part}") for name, test in tests.items() for part in range(test.parts)]
    rows = _postings_for(index, list(tests.values())).groupBy("article_id").agg(F.max("published").alias("published"), *flags)
    asked = {name: test.parts for name, test in tests.items() if test.parts}
    decided = []
    for name, parts in asked.items():
        every = F.lit(True)
        for part in range(parts):
            every = every & F.col(f"{name}_{part}")
        decided.append(every.alias(name))
    found = rows.select("article_id", "published", *decided)
    spec_all = [n for n in asked if n.startswith("all_")]
    spec_any = [n for n in asked if n.startswith("any_")]
    spec_none = [n for n in asked if n.startswith("none_")]
    keep = F.lit(True)
    for name in spec_all:
        keep = keep & F.col(name)
    if spec_any:
        some = F.lit(False)
        for name in spec_any:
            some = some | F.col(name)
        keep = keep & some
    unwanted = F.lit(False)
    for name in spec_none:
        unwanted = unwanted | F.col(name)
    if spec_all or spec_any:
        out = found.filter(keep & ~unwanted).select("article_id", "published")
    else:
        if universe is None:
            raise ValueError("a query of none_of clauses needs the universe of articles")
        out = universe.select("article_id", "published").join(
            found.filter(unwanted).select("article_id"), "article_id", "left_anti")
    if spec.published_from is not None:
        out = out.filter(F.col("published") >= F.lit(spec.published_from))
    if spec.published_to is not None:
        out = out.filter(F.col("published") <= F.lit(spec.published_to))
    return out


def query_batch(index: SearchIndex, queries: DataFrame, k: int = 10,
                fields: tuple[str, ...] = DEFAULT_FIELDS, rows_per_salt: int = 100_000,
                first_rows: int = 4096, broadcast_rows: int = 200_000) -> DataFrame:
    """Top ``k`` articles of many queries: ``(query_id, rank, article_id, score)``.

    ``queries`` is ``(query_id, query)``, any number of rows; equal sets of terms are scored once.
    An article must hold all terms of a query, so it must hold the rarest: only articles with the
    rarest term become candidates, and of these only those with the second rarest go on.  Postings that
    no candidate asks for are dropped by a bit table before they are shuffled; the others meet the sets of their
    article in one row.  The blocks of the rarest term are taken in the order of their bounds:
    first the best ones, of ``first_rows`` postings or more, then those that can still beat the
    k-th hit of their set.  Of each set at most ``k`` rows per task go on to the last choice.  Where even
    the rarest term is frequent, its list is dealt over salts, one per ``rows_per_salt`` postings.
    Plan, candidates and hits are written to the shared folder once and read from there.
    """
    q = queries.select("query_id", F.array_distinct(search_tokens("query")).alias("terms"))
    if index.stem:
        line = stem_words(F.array_join("terms", " "), extended=False)
        q = q.withColumn("terms", F.array_distinct(F.split(line, " ")))
    q = q.filter(F.size("terms") > 0).filter(F.get("terms", F.lit(0)) != "").select("query_id", F.array_sort("terms").alias("terms"))
    q = _kept(q.withColumn("set_id", F.md5(F.array_join("terms", "\n"))), "queries")
    asked = q.groupBy("set_id").agg(F.any_value("terms").alias("terms")).select(
        "set_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("term"))
    wanted = asked.select("term").distinct().withColumn("term_bucket", postings.bucket_column(index.layout))

    def of_batch(table):
        """Rows of the terms of the batch; the bucket is a partition, so only its folders are read."""
        return table.filter(F.col("field").isin(list(fields))).join(wanted, ["term_bucket", "term"], "left_semi")

    if index.path is not None:
        known = blocks.bounds(of_batch(index.term_stats), index.field_stats)
    else:
        known = (of_batch(index.term_stats).groupBy("field", "term").agg(F.sum("df").alias("df")).join(_field_means(index), "field")
                 .select("field", "term", F.lit(0).alias("impact"), "n_articles", "df", F.lit(1.0).alias("share")))
    # one row per term: its frequency in each field, and its blocks with the share of each field
    in_block = F.struct("field", "df", "share", "n_articles")
    per_term = (known.groupBy("term", "impact").agg(F.collect_list(in_block).alias("fields"))
                .groupBy("term").agg(F.collect_list(F.struct("impact", "fields")).alias("blocks"))
                .withColumn("every", F.flatten("blocks.fields"))
                .withColumn("by_field", F.filter(F.transform(F.array(*[F.lit(f) for f in fields]), lambda f: F.struct(
                    f.alias("field"),
                    F.aggregate(F.filter("every", lambda x: x["field"] == f), F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("df"),
                    F.array_max(F.transform(F.filter("every", lambda x: x["field"] == f), lambda x: x["n_articles"])).alias("n_articles"))),
                    lambda x: x["df"] > 0)))

    def weight(x):
        """The most that a term adds in one field of a block."""
        own = F.filter("by_field", lambda y: y["field"] == x["field"])[0]
        return (F.log(own["n_articles"] / (own["df"] + F.lit(1.0))) + 1) * F.lit(BM25_K1 + 1) * x["share"]

    bounded = F.transform("blocks", lambda b: F.struct(
        F.aggregate(b["fields"], F.lit(0.0), lambda n, x: n + weight(x)).alias("bound"), b["impact"].alias("impact"),
        F.aggregate(b["fields"], F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("rows")))
    per_term = per_term.select(
        "term", F.aggregate("by_field", F.lit(0).cast("long"), lambda n, x: n + x["df"]).alias("any_df"),
        F.transform(F.array(*[F.lit(f) for f in fields]), lambda f: F.coalesce(
            F.get(F.filter("by_field", lambda x: x["field"] == f), F.lit(0))["df"], F.lit(0).cast("long"))).alias("dfs"),
        F.sort_array(bounded, asc=False).alias("blocks"))
    highest = F.col("blocks")[0]["bound"]
    # one row per set: its terms with their frequencies, as long as the query text, and the blocks of the rarest
    planned = _kept(asked.join(per_term, "term").groupBy("set_id", "n_terms").agg(
        F.count("*").alias("known"), F.sum(highest).alias("highest"), F.sort_array(F.collect_list(F.struct("any_df", "term", "dfs"))).alias("parts"),
        F.min(F.struct("any_df", "term", "blocks")).alias("rarest"))
        .filter(F.col("known") == F.col("n_terms"))        # an unknown term: no hit
        .select("set_id", "n_terms", F.transform("parts", lambda x: F.struct(x["term"].alias("term"), x["dfs"].alias("dfs"))).alias("parts"),
                F.get("parts", F.lit(1))["term"].alias("second"), F.col("rarest.term").alias("term"), F.col("rarest.blocks").alias("blocks"),
                (F.col("highest") - F.col("rarest.blocks")[0]["bound"]).alias("others")), "planned")
    best_first = Window.partitionBy("set_id").orderBy("place")
    of_sets = (planned.select("set_id", "term", "others", F.posexplode("blocks").alias("place", "b"))
               .select("set_id", "term", "place", "b.impact", "b.rows", (F.col("b.bound") + F.col("others")).alias("bound"))
               .withColumn("before", F.sum("rows").over(best_first) - F.col("rows")))
    means = _field_means(index).filter(F.col("field").isin(list(fields))).collect()  # a row per field
    block = F.col("impact") if index.path is not None else F.lit(0)
    in_fields = index.postings.filter(F.col("field").isin(list(fields))).withColumn("block", block)

    def hits_in(chosen: DataFrame, label: str) -> DataFrame:
        """(set_id, article_id, score) of the articles in the chosen blocks that hold all terms."""
        # a block is dealt over as many salts as its rows need
        salts = (F.col("rows") / rows_per_salt).cast("int") + 1
        listed = _kept(chosen.select("term", F.col("impact").alias("block"), salts.alias("salts")).distinct().withColumn(
            "term_bucket", postings.bucket_column(index.layout)), f"{label}-listed")
        own = in_fields.select("term_bucket", "term", "block", "article_id")
        if listed.count() <= broadcast_rows:
            own = own.join(F.broadcast(listed), ["term_bucket", "term", "block"])
        else:
            own = _screened(own, listed, ["term", "block"]).join(listed, ["term_bucket", "term", "block"])
        lists = own.withColumn("salt", F.pmod(F.xxhash64("article_id"), F.col("salts")).cast("int"))
        dealt = chosen.select("set_id", "term", F.col("impact").alias("block"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
        candidates = dealt.join(lists, ["term", "block", "salt"]).select("set_id", "article_id").distinct()
        # of these only what has the second rarest term, too, is asked for the others
        candidates = _kept(candidates.join(planned.select("set_id", F.col("second").alias("term")), "set_id"), f"{label}-candidates")
        asked_second = candidates.filter("term IS NOT NULL")
        held = _screened(in_fields.select("term", "article_id"), asked_second, ["term", "article_id"])
        candidates = _kept(candidates.filter("term IS NULL").unionByName(asked_second.join(held, ["term", "article_id"], "left_semi"))
                           .select("set_id", "article_id").join(planned.select("set_id", "n_terms", "parts"), "set_id"), f"{label}-both")
        # an article's sets and those of its postings that they ask for meet in one row
        rows = _screened(in_fields.select("term", "article_id", "field", "tf", "field_length"),
                         candidates.select("article_id", F.explode("parts.term").alias("term")), ["term", "article_id"])
        sets = candidates.groupBy("article_id").agg(F.collect_list(F.struct("set_id", "n_terms", "parts")).alias("sets"))
        found = rows.groupBy("article_id").agg(F.collect_list(F.struct("term", "field", "tf", "field_length")).alias("found"))
        none = lambda kind: F.lit(None).cast(kind)
        of_sets = F.flatten(F.transform("sets", lambda x: F.transform(x["parts"], lambda part: F.struct(
            part["term"].alias("term"), x["set_id"].alias("set_id"), x["n_terms"].alias("n_terms"), part["dfs"].alias("dfs"),
            none("string").alias("field"), none("int").alias("tf"), none("int").alias("field_length")))))
        of_postings = F.transform("found", lambda x: F.struct(
            x["term"].alias("term"), none("string").alias("set_id"), none("int").alias("n_terms"), none("array<bigint>").alias("dfs"),
            x["field"].alias("field"), x["tf"].alias("tf"), x["field_length"].alias("field_length")))
        items = sets.join(found, "article_id").select("article_id", F.inline(F.concat(of_sets, of_postings)))
        here = F.collect_list(F.when(F.col("field").isNotNull(), F.struct("field", "tf", "field_length"))).over(
            Window.partitionBy("article_id", "term"))
        met = (items.withColumn("here", here).filter("set_id IS NOT NULL")
               .withColumn("weights", F.filter(F.transform("here", posting_weight), lambda x: x.isNotNull()))
               .filter(F.size("weights") > 0))
        return (met.groupBy("article_id", "set_id", "n_terms")
                .agg(F.count("*").alias("held"), F.round(F.sum(F.aggregate("weights", F.lit(0.0), lambda n, x: n + x)), 6).alias("score"))
                .filter(F.col("held") == F.col("n_terms")).select("set_id", "article_id", "score"))

    def posting_weight(x):
        """What a posting adds; nothing where the statistics do not know the term in its field."""
        out = F.lit(None).cast("double")
        for r in means:
            df = F.col("dfs")[fields.index(r.field)]
            idf = F.log(F.lit(r.n_articles) / (df + F.lit(1.0))) + 1
            norm = F.lit(1 - BM25_B) + F.lit(BM25_B) * x["field_length"] / F.lit(r.mean_length)
            own = idf * (x["tf"] * F.lit(BM25_K1 + 1)) / (x["tf"] + F.lit(BM25_K1) * norm)
            out = F.when((x["field"] == r.field) & (df > 0), own).otherwise(out)
        return out

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("set_id").orderBy(F.col("score").desc(), F.col("article_id"))
        return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    now = F.col("before") < max(first_rows, k)
    first = _kept(best(hits_in(of_sets.filter(now), "first")), "first")
    least = first.filter(F.col("rank") == k).select("set_id", F.col("score").alias("least"))
    later = _kept(of_sets.filter(~now).drop("place").join(least, "set_id", "left")
                  .filter(F.col("least").isNull() | (F.col("bound") + blocks.SLACK >= F.col("least"))).drop("least"), "later")
    found = first
    if not later.isEmpty():
        found = best(first.drop("rank").unionByName(hits_in(later, "second")))
    return q.select("query_id", "set_id").join(found, "set_id").select("query_id", "rank", "article_id", "score")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read from there."""
    path = scratch_path(df.sparkSession, f"batch-{label}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _screened(rows: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without most of those whose keys are not among the ``asked``: a join that follows shuffles few others.

    Hashes of the keys are bits of at most 2^20 cells of 64, which are broadcast whatever the number of keys is.
    """
    cell, bit = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 20) - 1)), F.pmod(F.shiftright(F.xxhash64(*keys), 20), F.lit(64)).cast("int")
    cells = asked.select(cell.alias("_cell"), bit.alias("_bit")).groupBy("_cell").agg(
        F.bit_or(F.expr("shiftleft(1L, _bit)")).alias("_bits"))
    cells = _kept(cells, "cells")
    return (rows.withColumn("_cell", cell).withColumn("_bit", bit).join(F.broadcast(cells), "_cell")
            .filter(F.expr("shiftright(_bits, _bit) & 1L") == 1).select(*rows.columns))
