"""Pages that names of classes or broken markup used to cost their story."""

import random
import re
import time

import pytest

from evalloom.llm import html_extract

STORY = ["The harbour opened in 1920, and ships came from far away, with grain and with coal.", "Nobody knew, at that time, how soon the trade would move elsewhere, or why it did.", "Today the old cranes stand still, and visitors walk along the quay in the evening."]
BODY = "".join(f"<p>{p}</p>" for p in STORY)


@pytest.mark.parametrize("name", ["no-sidebar", "has-header", "layout-sidebar", "hfeed sidebar-right", "cols extra", "related-layout", "notice", "page-with-popup", "menu-open"])
@pytest.mark.parametrize("inner", [BODY, f"<article>{BODY}</article>", f"<main><div>{BODY}</div></main>"])
def test_wrappers_keep_their_story(name, inner):
    page = f"<html><body><nav><a href='/'>Home</a></nav><div class='{name}'>{inner}</div><footer>All rights reserved.</footer></body></html>"
    assert html_extract.main_text(page) == "\n".join(STORY)


@pytest.mark.parametrize("part", ["<p class='ad-hoc'>An ad-hoc group met twice, and agreed on nothing at all.</p>", "<p>A <span class='share'>share of it</span> was lost, for good, in the fire of that year.</p>", "<p>He was <em class='social'>social</em> to a fault, and everyone liked him for it.</p>"])
def test_words_in_classes_keep_paragraphs_of_the_story(part):
    assert html_extract.main_text(f"<body><article>{BODY}{part}</article></body>") == "\n".join([*STORY, re.sub("<[^>]*>", "", part)])


def test_furniture_stays_out():
    comments = "<div class='comments'><h3>Comments</h3>" + "".join(f"<article class='comment'><p>I think, as always, that this is wrong, number {k}.</p></article>" for k in range(40)) + "</div>"
    side = "<div class='sidebar'><p>Most read this week, by far, and for good reason, are these.</p></div><p class='ad'>Buy now, pay later, and never look back at all!</p>"
    assert html_extract.main_text(f"<body><article>{BODY}<p class='ad'>Buy shoes, cheap, today only, online.</p></article>{side}{comments}</body>") == "\n".join(STORY)
    assert html_extract.main_text(f"<body><div class='content'>{BODY}</div>{side}{comments}</body>") == "\n".join(STORY)


def test_parts_of_one_kind_are_kept():
    page = f"<body><div id='x'><section><h2>One</h2>{BODY}</section><section><h2>Two</h2><p>It was short.</p></section></div></body>"
    assert html_extract.main_text(page) == "\n".join(["One", *STORY, "Two", "It was short."])


@pytest.mark.parametrize("piece", ["<b>x</i>", "<dl>", "<ul><li>", "<b><td></b>", "<p><i>", "</p></b>", "<div></div></span>", "<section><p>y", "<td></i>", "<li><b>"])
def test_broken_pages_take_linear_time(piece):
    times = []
    for n in (10_000, 40_000):
        begun = time.perf_counter()
        html_extract.parse(piece * n)
        times.append(time.perf_counter() - begun)
    assert times[1] < 10 * times[0] + 1, times


def plain_text(page):
    """Every text outside of scripts, block by block: for pages that are nothing but their story."""
    blocks = re.sub(r"(?i)</?(?:p|div|section|h\d|ul|ol|li|article|main|body|html)\b[^>]*>", "\0", page)
    return "\n".join(t for t in (re.sub(r"\s+", " ", re.sub("<[^>]*>", "", b)).strip() for b in blocks.split("\0")) if t)


def test_pages_of_nothing_but_a_story_come_whole():
    rng = random.Random(3)
    for _ in range(300):
        parts = []
        for _ in range(rng.randint(2, 12)):
            words = " ".join(rng.choice(["<b>bold</b>", "word", "and,", "<i class='social'>more</i>", "quay"]) for _ in range(rng.randint(8, 40)))
            parts.append(rng.choice(["<p>{}.</p>", "<p class='{}'>{{}}.</p>".format(rng.choice(["lead", "ad-hoc", "share-price", "x"])), "<ul><li>{}.</li></ul>"]).format(words))
        page = f"<html><body><article>{''.join(parts)}</article></body></html>"
        assert html_extract.main_text(page) == plain_text(page)
