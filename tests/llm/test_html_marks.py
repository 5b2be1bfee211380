"""Labels and forms lose only what they name."""

import time

import pytest

from lodestone.llm import html_text
from lodestone.llm.html_text import KEPT, LOST, OPEN, SOFT, page_blocks


def states(page):
    return {text: state for state, text in page_blocks(page)}


@pytest.mark.parametrize("wrapper", ["div class='has-sidebar'", "div id='page' class='with-sidebar'", "div class='no_sidebar'", "form action='/x'", "div class='sidebar'"])
def test_wrappers_around_main_text(wrapper):
    page = f"<body><{wrapper}><main><article><p>Text</p></article></main></{wrapper.split()[0]}></body>"
    assert states(page) == {"Text": KEPT}


def test_wrappers_without_main_elements():
    assert states("<body><div class='has-sidebar'><p>Text</p></div></body>") == {"Text": OPEN}
    assert states("<body><form><article><p>Text</p></article><p>Send</p></form></body>") == {"Text": KEPT, "Send": LOST}


def test_anchors_in_an_article():
    page = "<article><h2 id='side-effects'>A</h2><section id='related-work'><p>B</p></section><h2 id='search'>C</h2><p data-id='search'>D</p></article>"
    assert states(page) == dict.fromkeys("ABCD", KEPT)


def test_labels_still_lose_their_elements():
    page = "<body><div class='post ad'>A</div><section class='comments'><article>B</article></section><article>C<form>D</form><div role='search'>E</div><h2 class='related'>F</h2></article><form><nav>G</nav></form></body>"
    assert states(page) == dict.fromkeys("ABDEFG", LOST) | {"C": SOFT}


def test_names_that_hold_a_label_among_other_words():
    page = "<article><section id='related-work'><p>A</p></section><div class='share price'>B</div><div class='search results'>C</div><div class='side-by-side'>D</div><p title='the hidden cost'>E</p></article>"
    assert states(page) == {"A": KEPT, "B": SOFT, "C": SOFT, "D": SOFT, "E": KEPT}
    page = "<article><div class='share'><p>A</p></div><div class='share-buttons'>B</div><div class='post-comments'><p>C</p></div><p hidden>D</p></article>"
    assert states(page) == {"A": KEPT, "B": LOST, "C": LOST, "D": LOST}


N = 100_000
HARD = {
    "unclosed tags": "<p>x " + "<a" * (N // 2),
    "one unclosed tag": "<" + "a" * N,
    "unclosed tags before an end": "<a" * (N // 2) + ">",
    "open quotes": '<a b="' * (N // 6) + ">",
    "quotes of both kinds": '<a b=">\'' * (N // 8) + ">",
    "end tags of nothing": "<div>" * (N // 10) + "</span>" * (N // 10),
    "end tags behind a wall": "<span><article>" + "<div>" * (N // 10) + "</span>" * (N // 10),
    "a long class": "<div class='" + "a" * N + "'>x",
    "a long reference": "&#" + "9" * N + ";",
    "raw elements": "<button>" * (N // 8),
    "ends of raw elements": "<script>" + "</scriptx" * (N // 9),
    "spaces": "<p a" + " " * N + ">",
    "equals": "<a " + "=" * N + ">",
    "nested": "<p><b>" * (N // 6),
}


@pytest.mark.parametrize("name", HARD)
def test_no_page_takes_long(name):
    began = time.perf_counter()
    page_blocks(HARD[name])
    assert time.perf_counter() - began < 1


def test_long_pages_are_aligned_in_little_time_and_memory():
    import numpy as np

    a, b = np.arange(20_000) % 7, np.arange(20_000) % 5
    began = time.perf_counter()
    html_text.shared_blocks(a, b)
    assert time.perf_counter() - began < 10


PLAIN = "<body><div>Our site</div><div>{0}</div><p>All rights</p></body>"
MARKED = "<body><div>Our site</div><article><h1>{0}</h1><p>{0} with many more words</p><p>Licence</p><div>Read on</div></article></body>"


@pytest.mark.parametrize(("page", "want", "undiffed"), [(PLAIN, "{0}", "Our site\n{0}\nAll rights"), (MARKED, "{0}\n{0} with many more words\nLicence", "Our site\n{0}\n{0} with many more words\nLicence\nRead on")])
def test_differencing_decides(spark, page, want, undiffed):
    rows = [(k, f"http://a.example/x/{k}", page.format(f"Text {k}")) for k in range(4)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.text for r in html_text.main_text(df).collect()} == {k: want.format(f"Text {k}") for k in range(4)}
    alone = spark.createDataFrame([(k, f"http://{k}.example/x", h) for k, _, h in rows], df.schema)
    assert {r.page_id: r.text for r in html_text.main_text(alone).collect()} == {k: undiffed.format(f"Text {k}") for k in range(4)}


def test_copies_of_a_page_are_one_neighbour(spark):
    rows = [(k, f"http://a.example/x/{k // 2}", PLAIN.format(f"Text {k // 2}")) for k in range(6)] + [(None, None, None), (None, None, PLAIN.format("Text"))]
    df = spark.createDataFrame(rows + rows[:2], "page_id bigint, url string, html string")
    got = sorted((r.page_id, r.text) for r in html_text.main_text(df).where("page_id is not null").collect())
    assert got == sorted((k, f"Text {k // 2}") for k in [*range(6), 0, 1])


def test_a_copied_article_stays(spark):
    rows = [(k, f"http://a.example/x/{k}", MARKED.format("Text").replace("Our", f"Our{k}")) for k in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.text.split("\n", 1)[1] for r in html_text.main_text(df).collect()} == {"Text\nText with many more words\nLicence\nRead on"}
