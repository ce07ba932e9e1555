"""Text density decides what a page's text is, with and without an article element."""

import time

import pytest

from corpusloom.llm import html_text as H

PARAGRAPHS = "".join(f"<p>{'A long sentence of the article with many words. ' * 4}{i}</p>" for i in range(4))
COMMENTS = "".join(f"<div><b>u{i}</b> <i>said</i> <span>hi {i}</span></div>" for i in range(20))
TEASERS = "".join(f"<article><h2>More {i}</h2><p>Read on.</p></article>" for i in range(6))
LINES = [("A long sentence of the article with many words. " * 4 + str(i)) for i in range(4)]


@pytest.mark.parametrize(
    "page, want",
    [
        (f"<body><article><h1>T</h1>{PARAGRAPHS}<div id=x>{COMMENTS}</div></article></body>", ["T", *LINES]),
        (f"<body><article>{PARAGRAPHS}</article><div id=x>{COMMENTS}</div></body>", LINES),
        (f"<body><div>{PARAGRAPHS}</div><div id=x>{COMMENTS}</div></body>", LINES),
        (f"<body><main><article><h1>T</h1>{PARAGRAPHS}</article>{TEASERS}</main></body>", ["T", *LINES]),
        (f"<body><main>{PARAGRAPHS}<ul><li>one</li><li>two</li></ul></main></body>", [*LINES, "one", "two"]),
        (f"<body><div class='post'>{PARAGRAPHS}</div><div class='comments'>{PARAGRAPHS}</div></body>", LINES),
    ],
)
def test_thin_containers_and_teasers_are_left_out(page, want):
    assert H.main_text(page).split("\n") == [x.strip() for x in want]


@pytest.mark.parametrize("page", [f"<body><article>{PARAGRAPHS}<div>{COMMENTS}</div></article></body>", f"<body><div>{PARAGRAPHS}</div><div>{COMMENTS}</div></body>"])
def test_without_densities_pages_give_other_texts(page, monkeypatch):
    found = H.main_text(page)
    monkeypatch.setattr(H, "density", lambda *counts: 1.0)
    assert "said" not in found and "said" in H.main_text(page)


def test_nested_headers_take_linear_time():
    def seconds(n):
        began = time.time()
        H.main_text('<div class="header">' * n + "x")
        return time.time() - began

    seconds(100)
    assert seconds(16_000) < 16 * max(0.05, seconds(2000))


def test_extract_takes_the_place_of_a_column_in_any_case(spark):
    pages = spark.createDataFrame([(1, "<p>a b</p>", "old"), (2, None, "old")], "page_id long, html string, TEXT string")
    found = H.extract(pages, "text").orderBy("page_id")
    assert found.columns == ["page_id", "html", "text"] and [r.text for r in found.collect()] == ["a b", ""]
