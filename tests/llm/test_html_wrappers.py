"""Pages whose text stands in elements with names or tags of boilerplate, and recurring blocks below the whole site."""

import re

import pytest

from quillon.llm.html_text import Reading, extract

ARTICLE = "<article><h1>Head</h1><p>One sentence of the text.</p><p>Another one of it.</p></article>"
TEXT = "Head\n\nOne sentence of the text.\n\nAnother one of it."
PLAIN = ARTICLE.replace("article>", "div>")


@pytest.mark.parametrize(
    "page",
    [
        f"<body><div class='content has-sidebar'>{ARTICLE}</div></body>",
        ARTICLE.replace("<article", "<article class='post share-enabled'"),
        f"<body class='x'><form id=f action='/'><input name=v>{PLAIN}</form></body>",
        f"<form><nav><a href=/>home</a></nav>{ARTICLE}<footer>A long footer that says who owns all of this, since when, and what may be done with it.</footer></form>",
        f"<div class='modal'><div class='widget'>{PLAIN}</div></div><div class='ad'>buy</div>",
        f"<div class='comments'><main>{PLAIN}</main></div>",
        f"<nav><ul><li><a href=/>home</a>{ARTICLE}",
        f"<div class='elementor-widget'>{PLAIN}</div><div id='no-comments'></div>",
    ],
)
def test_wrappers_are_kept(page):
    assert Reading(page).text() == TEXT


@pytest.mark.parametrize(
    "extra",
    [
        "<div class='sidebar'><p>side</p></div>", "<div class='box cookie-notice'><p>we use cookies</p></div>", "<form><p>subscribe</p></form>", "<aside><article>card</article></aside>", "<div hidden><p>h</p></div>",
        "<div id='comments'><article><p>" + "A reader's long remark. " * 20 + "</p></article></div>", "<footer><p>" + "Long legal text. " * 20 + "</p></footer>", "<div role=alert><p>alert</p></div>", "<template><main>m</main></template>",
    ],
)
def test_boilerplate_is_still_left_out(extra):
    assert Reading(f"<body>{PLAIN}{extra}</body>").text() == TEXT
    assert Reading(f"<body>{ARTICLE}{extra}</body>").text() == TEXT
    assert Reading(f"<body>{ARTICLE.replace('</article>', extra + '</article>')}</body>").text() == TEXT


def own(host, i, words=40):
    return " ".join(f"{host}{i}w{k}" for k in range(words))


KEPT_WITHIN = ["<p class='related'>b c</p>", "<div class='share price'>5</div>", "<h2 id='comments'>Comments on the bill</h2>", "<math>x</math>", "<noscript>shown without scripts</noscript>", "<div class='note'>n</div>", "<li class='menu'>l</li>"]


@pytest.mark.parametrize("part", KEPT_WITHIN)
def test_an_article_keeps_its_text_whatever_it_is_named(part):
    said = re.sub("<[^>]*>", "", part)
    assert said in Reading(f"<body>{ARTICLE.replace('</article>', part + '</article>')}</body>").text()


def extracted_by_hand(pages, least=3):
    """Template subtrees counted host by host in Python, copies of an article once."""
    on, articles, out = {}, {}, {}
    for _, url, page in pages:
        r, host = Reading(page), url.split("/")[2]
        articles.setdefault(host, set()).add(r.text())
        for brief, h in r.subtrees:
            on.setdefault((host, brief, h), set()).add(r.text())
    for i, url, page in pages:
        host = url.split("/")[2]
        out[i] = Reading(page, frozenset(h for (x, brief, h), n in on.items() if x == host and len(n) >= least and (not brief or 2 * len(n) >= len(articles[host])))).text()
    return out


def site(seed=0):
    """Hosts of many sizes whose pages share unnamed and named blocks, and articles with one closing sentence on many hosts."""
    boxes = ["<div><p>See this section of our site</p></div>", "<ul class='nav'><li>home</li><li>news</li></ul>", "<section><div>Our partners bring you this</div></section>"]
    closing = "<p>This sentence closes articles on many a host</p>"
    pages, closed = [], []
    for h, n in enumerate((1, 2, 3, 4, 9, 30, 100)):
        for i in range(n):
            t = own(f"h{h}x", i // 2 if h == 4 else i)  # one host's articles come twice
            inside = f"<h2>Introduction</h2><p>{t}</p>" + (closing if i % 3 == 0 else "")
            body = f"<article>{inside}</article>" if i % 2 else f"<div>{inside}</div>"
            pages.append((len(pages), f"http://h{h}.example/{i}", f"<body>{boxes[i % 3]}{body}{boxes[2] if i % 5 == 0 else ''}</body>"))
            if i % 2 and i % 3 == 0:
                closed.append(len(pages) - 1)
    return pages, closed


def test_templates_of_each_host_against_counting_by_hand(spark):
    pages, closed = site()
    df = spark.createDataFrame(pages + [(-1, None, "<p>no host</p>"), (-2, "http://h9.example", None)], "page_id long, url string, html string").repartition(4)
    want = extracted_by_hand(pages) | {-1: "no host", -2: ""}
    for broadcast in (10_000, 0):
        assert {r["page_id"]: r["text"] for r in extract(df, broadcast_hosts=broadcast).collect()} == want
    assert all(want[i].endswith("closes articles on many a host") for i in closed)  # in an article, on hosts of every size
    assert sum("our site" in t or "partners" in t for t in want.values()) < 8 and all("Introduction" in want[i] for i in closed)


def test_equal_articles_give_equal_text_on_all_hosts(spark):
    article = "<article><h1>T</h1><p>The same words stand on hosts of any size here.</p></article>"
    pages = [(100 * h + i, f"http://s{h}.example/{i}", article if i == 0 else f"<article><p>{own('z', i)}</p><p>The same words stand on hosts of any size here.</p></article>") for h, n in enumerate((1, 3, 12, 40)) for i in range(n)]
    got = {r["page_id"]: r["text"] for r in extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert len({got[100 * h] for h in range(4)}) == 1 and all(t.endswith("of any size here.") for t in got.values())
