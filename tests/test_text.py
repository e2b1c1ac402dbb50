import re
import string

import pytest
from pyspark.sql import functions as F

from newsloom.functions import text as tx
from newsloom.functions.stemming import porter_stem, stem_words
from newsloom.functions.wordlists import ENGLISH_STOP_WORDS
from newsloom.operators.search import query_terms
from newsloom.plans import corpus

ROWS = [None, "", "See http://a.b/c now", "gluedhttp://x.y/z here", "at www.example.org, ok",
        "mail me.now@host.org today", "@handle and a@b and c@", "<b>Bold</b> text", "<a\nhref='x'>two lines</a>",
        string.punctuation + "x", "a b c\x1cd", "I cannot gonna wanna lemme",
        "“quoted” ‘single’ «guil»", "the and of", "ÉCOLE Straße", "  spaced \t out\n\n", "1 < 2 and 3 > 2"]


def expected_clean(text):
    """The definition, said with the standard library."""
    if not text:
        return ""
    text = text.lower()
    for pattern in (r"http\S+|www\S+|https\S+", r"<.*?>", r"\S+@\S+"):
        text = re.sub(pattern, "", text)
    return " ".join("".join(c for c in text if c not in string.punctuation).split())


def test_clean_text_rows(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ROWS)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text("t").alias("c")).collect()}
    for i, t in enumerate(ROWS):
        assert got[i] == expected_clean(t), (t, got[i])


def test_clean_text_is_stable_on_clean_text(spark):
    df = spark.createDataFrame([(t,) for t in ROWS], "t string").select(tx.clean_text("t").alias("c"))
    assert df.filter(tx.clean_text("c") != F.col("c")).count() == 0


def test_email_pattern_on_a_long_run(spark):
    run = "x" * 200_000
    df = spark.createDataFrame([(run + " a@b " + run,)], "t string")
    assert df.select(F.length(tx.clean_text("t")).alias("n")).first().n == 400_001


def test_tokens_and_stop_words(spark):
    df = spark.createDataFrame([("i cannot gonna wanna “so” scannots lemme news",)], "t string")
    assert df.select(tx.word_tokens("t").alias("w")).first().w == [
        "i", "can", "not", "gon", "na", "wan", "na", "“", "so", "”", "scannots", "lem", "me", "news"]
    kept = df.select(tx.keep_content_words(tx.word_tokens("t")).alias("w")).first().w
    assert kept == ["gon", "wan", "scannots", "lem", "news"]
    assert len(ENGLISH_STOP_WORDS) == len(set(ENGLISH_STOP_WORDS)) == 179


PAIRS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop falling fall hissing hiss fizzed fizz failing fail
filing file happy happi relational relat conditional condit rational ration valenci valenc digitizer digit
radicalli radic differentli differ vileli vile analogousli analog vietnamization vietnam predication predic
operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous formaliti formal
sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr
electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin
gyroscopic gyroscop adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
dependent depend adoption adopt communism commun activate activ angulariti angular homologous homolog
effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll""".split()


@pytest.mark.parametrize("extended", [True, False])
def test_published_stem_pairs(extended):
    for word, stem in zip(PAIRS[::2], PAIRS[1::2]):
        assert porter_stem(word, extended) == stem, word


def test_variants_differ_where_they_should():
    both = {"ties": ("tie", "ti"), "dying": ("die", "dy"), "skies": ("sky", "ski"), "news": ("news", "new"),
            "enjoy": ("enjoy", "enjoi"), "say": ("say", "sai"), "spied": ("spi", "spi"), "died": ("die", "di"),
            "by": ("by", "by"), "proceed": ("proceed", "proce")}
    for word, (extended, published) in both.items():
        assert (porter_stem(word, True), porter_stem(word, False)) == (extended, published), word


def test_stem_column_equals_function(spark):
    words = PAIRS[::2] + ["été", "naïveté", "x", ""]
    df = spark.createDataFrame([(" ".join(words),), ("",), (None,)], "t string")
    got = [r.s for r in df.select(stem_words("t").alias("s")).collect()]
    assert got == [" ".join(porter_stem(w) for w in words), "", None]


def test_prepared_corpus(spark):
    raw = spark.createDataFrame([("Big News", "The cats are running at http://x.y", 1), (None, "the of and", 0),
                                 ("Only title", None, 0)], "title string, text string, label int")
    got = {r.label: r.processed_text for r in corpus.prepare(raw).collect()}
    assert got == {1: "big news cat run", 0: "titl"}


def test_combine_and_preview(spark):
    df = spark.createDataFrame([(None, " b ", "x" * 30)], "a string, b string, c string")
    row = df.select(tx.combine("a", "b").alias("plain"), tx.combine("a", "b", trim=True).alias("trimmed"),
                    tx.preview("c", 30).alias("same"), tx.preview("c", 29).alias("cut"),
                    tx.preview("c", 40, True).alias("demo")).first()
    assert (row.plain, row.trimmed, row.same, row.cut, row.demo) == (
        "  b ", "b", "x" * 30, "x" * 29 + "...", "x" * 30 + "...")


def test_query_terms_equal_the_index_analyser(spark):
    for text in ("The U.S. cats, 3.14 and co_op naïve—dash state-of-the-art a", "हिन्दी समाचार", "m² ２×", "ΟΔΟΣ İx"):
        df = spark.createDataFrame([(text,)], "t string")
        assert df.select(tx.search_tokens("t").alias("w")).first().w == query_terms(text, False)


def test_tags(spark):
    df = spark.createDataFrame([(["a", "b c"],), (None,)], "tags array<string>")
    rows = df.select(tx.split_tags(tx.join_tags("tags")).alias("t")).collect()
    assert [r.t for r in rows] == [["a", "b c"], []]
    assert spark.createDataFrame([(" x, ,y ",)], "j string").select(
        tx.split_tags("j").alias("t")).first().t == ["x", "y"]


def test_words_with_no_suffix_pass_all_steps(monkeypatch):
    from newsloom.functions import stemming
    words = ["hausb", "été", "a1b2", "probabo", "x_"]
    assert [stemming._tidy(stemming._step4(stemming._step3(stemming._step2(w, True))), True) for w in words] == words
    monkeypatch.setattr(stemming, "_plural", lambda *_: 1 / 0)
    assert [stemming.porter_stem(w, extended) for w in words for extended in (False, True)] == [w for w in words for _ in "ab"]
