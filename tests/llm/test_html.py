import re
from html import unescape

import pytest

from factloom.llm import html_paths as H
from tests.llm.helpers import SF


def plain_reading(html):
    """The article of a page whose article is well marked, read by patterns alone."""
    found = re.search(r"<article>(.*?)</article>", html or "", re.S)
    parts = re.split(r"</?(?:p|h1)>", found.group(1)) if found else []
    return "\n\n".join(x for x in (" ".join(unescape(re.sub("<[^>]+>", " ", p)).split()) for p in parts) if x)


def test_whole_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in H.op4_html(spark, SF).collect()}
    assert set(got) == set(pages)
    for i, p in pages.items():
        assert got[i].text == plain_reading(p.html) and got[i].n_chars == len(got[i].text) and got[i].url == p.url


LONG = "A sentence of the article, with commas and words. And one more of them."


@pytest.mark.parametrize(
    "junk",
    [
        "<nav><a href=x>Home</a></nav>", "<header><h1>Site name, here.</h1></header>", "<footer>Imprint, terms.</footer>", "<aside>Other things, too.</aside>", "<div class='sidebar'>Side, text.</div>",
        "<div class=\"cookie-notice\">We use cookies, of course.</div>", "<div class=ad>Buy it, now.</div>", "<form><p>Name, please.</p></form>", "<script>var a='<p>no</p>';</script>", "<style>p{}</style>",
        "<section id='comments'><p>A reader says, well done.</p></section>", "<!-- <p>a comment, hidden</p> -->", "<div hidden>Not seen, at all.</div>", "<p style='display: none'>Not seen, either.</p>", "<noscript>No script, sorry.</noscript>",
    ],
)
@pytest.mark.parametrize("container", ["article", "div class='content'"])
def test_boilerplate_leaves(junk, container):
    page = f"<html><body>{junk}<{container}><h2>Title</h2><p>{LONG}</p><p>{LONG} Two.</p></{container.split()[0]}>{junk}</body></html>"
    assert H.main_text(page) == f"Title\n\n{LONG}\n\n{LONG} Two."


def test_references_space_and_broken_markup():
    page = "<article><p><b>A &amp; B &eacute;&#233;&#x1F600;\n\t c<br>d<p>2 &lt; 3 a<b>b</b>c<ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article"
    assert H.main_text(page) == "A & B éé😀 c d\n\n2 < 3 abc\n\none\n\ntwo\n\nx\n\ny"


@pytest.mark.parametrize("page", [None, "", " ", "<", "<>", "<p", "</p></div>", "<!--", "<script>", "<a href='", "&#0;&bogus;"])
def test_odd_pages(page):
    assert isinstance(H.main_text(page), str)


def test_long_page_is_read_whole():
    page = "<article>" + "".join(f"<p>Paragraph {i}, with text.</p>" for i in range(5000)) + "</article>"
    assert H.main_text(page).count("\n\n") == 4999


def test_menus_lose_to_text_without_a_stated_article():
    menu = "".join(f"<li><a href=/{i}>Link {i}</a></li>" for i in range(30))
    assert H.main_text(f"<body><ul>{menu}</ul><div><p>{LONG}</p><p>{LONG} Two.</p></div></body>") == f"{LONG}\n\n{LONG} Two."


def test_nulls_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, "x", 3), (2, "<p>One text, here.</p>", "y", 4), (2, "<p>One text, here.</p>", "y", 4)], "page_id long, html string, text string, n_chars int")
    rows = sorted(H.extract(df).collect())
    assert [(r.page_id, r.text, r.n_chars) for r in rows] == [(1, "", 0), (2, "One text, here.", 15), (2, "One text, here.", 15)]
    assert H.extract(df.where("false")).count() == 0


def test_an_article_that_is_only_a_teaser_does_not_hide_the_text():
    page = f"<body><article class=card><h3><a href=/x>Read</a></h3></article><div class=text><p>{LONG}</p><p>{LONG} Two.</p></div></body>"
    assert H.main_text(page) == f"{LONG}\n\n{LONG} Two."
    text = H.main_text(page.replace("</h3>", "</h3><p>Short teaser</p>"))
    assert f"{LONG}\n\n{LONG} Two." in text


def test_text_beside_an_article_is_kept_by_its_ratio():
    paragraphs = "".join(f"<p>{LONG} {i}.</p>" for i in range(6))
    text = H.main_text(f"<body><article><p>{LONG}</p>{paragraphs}</article><div class=more>{paragraphs}</div></body>")
    assert text.count(LONG) == 13
    assert "By me" not in H.main_text(f"<body><article><p>{LONG}</p>{paragraphs}</article><p class=by>By me</p></body>")


def test_linked_headings_and_lists_of_an_article_stay():
    page = f"<article><h1><a href=x>Title</a></h1><p>{LONG}</p><ul><li><a href=a>Source one</a><li><a href=b>Source two</a></ul></article>"
    assert H.main_text(page) == f"Title\n\n{LONG}\n\nSource one\n\nSource two"
    assert H.main_text(f"<div class=text><h1><a href=x>Title</a></h1><p>{LONG}</p><p>{LONG}</p></div>") == f"Title\n\n{LONG}\n\n{LONG}"


@pytest.mark.parametrize(
    "name", ["class='content has-sidebar'", "id=page class=no-comments", "class='post category-search comment-status-open'", "class=sidebar", "class='post hidden'", "id=main-content class=notice"]
)
@pytest.mark.parametrize("form", ["<article {}>{}</article>", "<div {}>{}</div>", "<div {}><article>{}</article></div>", "<main><div {}>{}</div></main>"])
def test_a_name_on_a_container_does_not_take_the_text(name, form):
    text = form.format(name, f"<h2>Title</h2><p>{LONG}</p><p>{LONG} Two.</p>")
    assert H.main_text(f"<html><body>{text}<div class=ad>Buy it, now.</div></body></html>") == f"Title\n\n{LONG}\n\n{LONG} Two."


@pytest.mark.parametrize("name", ["cookie-notice", "site_footer", "main-nav", "share-buttons", "related-posts", "comments-area", "ad-container", "page-header"])
def test_compounds_leave(name):
    assert H.main_text(f"<body><div class=text><p>{LONG}</p><p>{LONG} Two.</p></div><div class={name}><p>Short text, here.</p></div></body>") == f"{LONG}\n\n{LONG} Two."


def test_long_comments_beside_an_article_leave():
    said = "".join(f"<li class=comment><article class=comment-body><p>{LONG} {i}.</p></article></li>" for i in range(9))
    assert H.main_text(f"<body><article><p>{LONG}</p></article><section id=comments><ol>{said}</ol></section></body>") == LONG
    assert H.main_text(f"<body><article><p>{LONG}</p></article><div class=ad><p>{LONG} {LONG}</p></div></body>") == LONG
    assert said.count(LONG) == H.main_text(f"<body><article>Teaser</article><div class='post notice'>{said.replace('comment', 'x')}</div></body>").count(LONG)
    assert H.main_text(f"<body class=single><div class=sidebar><article><p>{LONG}</p></article></div></body>") == LONG


def stripped(html, tag):
    """The page without classes and with no element that states the article."""
    bare = re.sub(r'\sclass="?[^">]*"?', "", html)
    return re.sub(r"<(/?)article>", rf"<\1{tag}>" if tag else "", bare)


@pytest.mark.parametrize("tag", ["div", "section", ""])
def test_the_ratios_find_the_text_where_nothing_states_it(spark, tag):
    pages = [r.html for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/pages.parquet").select("html").collect()]
    right = [H.main_text(stripped(h, tag)) == plain_reading(h) for h in pages if len(plain_reading(h)) >= 120 * (plain_reading(h).count("\n\n") + 1)]
    assert len(right) > 200 and sum(right) >= 0.93 * len(right)


def test_the_threshold_changes_the_choice():
    page = f"<body><section><p>Short advert, buy it now.</p></section><div><p>{LONG}</p><div><p>{LONG * 4}</p></div></div></body>"
    texts = [H.main_text(page, t) for t in (0.1, 0.7, 0.95)]
    assert "advert" in texts[0] and "advert" not in texts[1] and LONG in texts[1] and len(texts[2]) < len(texts[1])


def test_deep_pages_take_linear_memory_and_time():
    import time
    import tracemalloc

    tracemalloc.start()
    began = time.time()
    assert H.main_text("<div class=x>" * 60_000 + "Text, here." + "</b>" * 60_000) == "Text, here."
    assert tracemalloc.get_traced_memory()[1] < 100_000_000 and time.time() - began < 120
    tracemalloc.stop()
