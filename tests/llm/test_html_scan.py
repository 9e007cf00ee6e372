"""Scanning of odd markup: what an unclosed quote loses, time on long pages, hosts by number."""

import time

import pytest

from quillon.llm import html_text


def read(page: str) -> str:
    return html_text.Reading(page).text()


def test_a_quote_that_stays_open_ends_with_its_tag():
    assert read('<p title="x>hello</p><p>after</p>') == "hello\n\nafter"
    assert read('<p title="x>hello</p><p class="b">after</p>') == "hello\n\nafter"
    assert read('<p title="a > b">hello</p>') == "hello"
    assert read("a < b and c > d") == "a < b and c > d"
    assert read("<p>1 <b") == "1 <b"


@pytest.mark.parametrize("page", ['<a b="' * 160_000, "<a '' <a '' " * 90_000 + '"', "<div>" * 200_000, "<p><button>" + "<div>" * 200_000, "<div>" * 100_000 + "</p>" * 100_000, "<article>" + "<blockquote>x " * 60_000])
def test_a_long_odd_page_takes_seconds(page):
    start = time.monotonic()
    read(page)
    assert time.monotonic() - start < 20


def test_hosts_are_those_of_the_address(spark):
    urls = ["http://A.example:80/x", "https://u:p@b.example/", "http://[::1]:8080/x", "//c.example/y", "mailto:x@y", "", None]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(html_text.host_of(html_text.F.col("url")).alias("h")).collect()
    assert [r["h"] for r in got] == ["a.example", "b.example", "[::1]", "c.example", None, None, None]


def test_a_block_of_a_numbered_host_is_template(spark):
    page = lambda i: f"<html><body><div><p>Same box of words on all pages here</p></div><div><p>Own text number {i} of this page, which is long enough to stay.</p></div></body></html>"
    rows = [(i, f"http://[::1]/{i}", page(i)) for i in range(12)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 12 and all("Same box" not in r["text"] and f"number {r['page_id']} " in r["text"] for r in got)
