"""Broken markup ends in time that grows with the page, and articles need no named container."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from verbatia.llm.html_text import default_field, extract_text, leaf_blocks, main_text

SENTENCE = "Plain words of an ordinary article stand here and go on for a while."
BROKEN = {
    "cut off in quotes": "<article><p>Text.</p><div data-x='{" + ",".join(f'"k{i}":"v{i}"' for i in range(5000)),
    "tags that never close": "<div " * 200_000,
    "hidden ends": '<a ">" ' * 150_000,
    "open quotes": "<a '" * 250_000,
    "bare quotes": '"' * 1_000_000 + "<",
    "deep": "<div>" * 100_000 + "inside",
    "deep with text": "<div class=a>x" * 20_000,
    "ends only": "</div>" * 150_000,
    "comments": "<!--" * 250_000,
    "scripts": "<script>" * 100_000,
    "drawings": "<svg>" * 150_000,
    "titles": "<title>" * 100_000,
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_markup_ends(kind):
    began = time.process_time()
    leaf_blocks(BROKEN[kind])
    assert time.process_time() - began < 8, kind


def test_what_broken_markup_says():
    said = lambda page: [b[0] for b in leaf_blocks(page)]
    assert said("<p>one</p><div data-x='{\"a\":\"b") == ["one"]
    assert said("<p title='it's'>two</p>") == ["two"] and said('<p class="a>three</p>') == ["three"]
    assert said("<div>" * 600 + "<b>in</b></div>next" + "</div>" * 599 + "<p>out") == ["in", "next", "out"]
    assert said("a < b and <3 hearts") == ["a < b and <3 hearts"]


@pytest.mark.parametrize("open_", ["<svg><path d='x'>", "<select><option>x"])
def test_elements_left_open_end_at_the_next_block(open_):
    said = [b[0] for b in leaf_blocks(f"<article><p>one</p>{open_}<p>two</p></article>")]
    assert said == ["one", "two"]


@pytest.mark.parametrize("open_, close", [("<section>", "</section>"), ("<div>", "</div>"), ("<div class='wrapper'>", "</div>"), ("", ""), ("<table><tr><td>", "</td></tr></table>"), ("<div id='page'><div>", "</div></div>")])
def test_articles_without_a_named_container(open_, close):
    body = "".join(f"<p>{SENTENCE} {SENTENCE}</p>" for _ in range(4))
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>About us</a></li></ul></nav>{open_}{body}{close}<footer>&copy; me</footer></body></html>"
    assert main_text(page, default_field()) == " ".join([SENTENCE] * 8)


def test_text_without_markup():
    assert main_text(f"{SENTENCE} {SENTENCE}", default_field()) == f"{SENTENCE} {SENTENCE}"


def test_long_and_clashing_rows(spark):
    long = "<article>" + f"<p>{SENTENCE}</p>" * 20_000 + "</article>"
    df = spark.createDataFrame([(1, long, "mine"), (2, None, None), (2, None, None)], "page_id long, html string, text string")
    rows = extract_text(df, out="main").select("page_id", "text", F.length("main").alias("n")).collect()
    assert sorted((r.page_id, r.text or "", r.n) for r in rows) == [(1, "mine", 20_000 * (len(SENTENCE) + 1) - 1), (2, "", 0), (2, "", 0)]
