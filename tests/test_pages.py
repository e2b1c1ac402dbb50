import pytest

from newsloom.functions.html import CONTENT_SELECTORS, extract_pages, read_page


@pytest.mark.parametrize("selector", CONTENT_SELECTORS)
def test_each_selector(selector):
    tag = f'<div class="big {selector[1:]}">' if selector[0] == "." else f"<{selector}>"
    end = "</div>" if selector[0] == "." else f"</{selector}>"
    assert read_page(f"<title> T </title><p>out</p>{tag}<p>in</p> side{end}<p>after</p>") == ("T", "in side")


def test_order_of_selectors_not_of_elements():
    assert read_page("<main>m</main><div class='content'>c</div><article>a</article>")[1] == "a"
    assert read_page("<main>m</main><div class='content'>c</div>")[1] == "c"


def test_first_element_of_a_selector_and_nesting():
    assert read_page("<article>one<article>two</article></article><article>three</article>")[1] == "onetwo"


def test_titles():
    assert read_page("<meta property='og:title' content=' Og '><p>x</p>")[0] == "Og"
    assert read_page("<title> </title><meta property='og:title' content='Og'>")[0] == "Og"
    assert read_page("<title>A &amp; B</title><title>C</title>")[0] == "A & B"
    assert read_page("<p>x</p>") == ("", "x")


def test_scripts_and_styles_are_no_text():
    page = "<article>a<script>var x = '</p>';</script><style>p{}</style>b</article>"
    assert read_page(page)[1] == "ab"
    assert read_page("<p>a<script>1</script></p><p>b</p>")[1] == "a b"


def test_paragraph_fallback():
    assert read_page("<div>no</div><p>a</p><p>b <i>c</i></p>")[1] == "a b c"
    assert read_page("<article></article><p>a</p>")[1] == "a"
    assert read_page("<article>  </article><p>a</p>")[1] == ""      # blank text is text, then collapsed
    assert read_page("<div><p>a</p><p>b</p></div><main><p>a</p><p>b</p></main>")[1] == "ab"


def test_entities_and_broken_tags():
    assert read_page("<article>caf&eacute; &#8212; &lt;x&gt;<b>bold</article> rest")[1] == "café — <x>bold"
    assert read_page("<p>open<p>next</i></div>")[1] == "open next"  # text of nested paragraphs counts once
    assert read_page("<article>a<br>b<br/>c<img src=x>d")[1] == "abcd"


def test_page_job_keeps_bad_rows(spark):
    pages = spark.createDataFrame([(1, "u1", "<title>t</title><article>x</article>"), (2, "u2", None)],
                                  "page_id bigint, url string, html string")
    got = {r.page_id: r for r in extract_pages(pages).collect()}
    assert (got[1].title, got[1].content, got[1].error) == ("t", "x", None)
    assert got[2].title is None and got[2].error.startswith("page cannot be read")


def test_open_tags_take_linear_time():
    import time
    start = time.perf_counter()
    assert read_page("<article>x" + "<p>y" * 16_000)[1].startswith("xyy")
    assert read_page("<div>" * 16_000 + "<b>z</b>" * 16_000 + "<p>end</p>")[1] == "end"
    assert time.perf_counter() - start < 3
