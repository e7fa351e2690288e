import html
import re

import pytest

from factsheet.llm import html_text, queries

SF = "/root/testdata/sf0.01"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x}</style><script>var t="</p>";</script></head>
<body class="has-sidebar"><header><h2>Site</h2></header><nav><ul><li><a href=/a>A</a></ul></nav>
<div class="cookie notice">We use cookies</div><!-- <p>hidden</p> -->
<article><header><h1>Head &amp;   line</h1></header><p>First&nbsp;para <b>bold</b>text.<p>Short.<br>Next
<aside>See also</aside><div class="ad">Buy</div><form><input name=q><button>Go</button></form><p>a &lt; b &am; 1 < 2</p>
<section class="comments"><p>I disagree</p></section></article>
<div id=sidebar>Links</div><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert html_text.main_text(PAGE) == "Head & line\nFirst para boldtext.\nShort. Next\na < b &am; 1 < 2"


def test_page_without_article_marks():
    lines = "".join(f"<p>{'word ' * 40}{i}</p><p>x</p>" for i in range(5))
    page = f"<body><ul><li><a href=x>one</a><li><a href=y>two</a></ul><nav>menu</nav><div>{lines}</div><footer>end</footer><p>tail</p>"
    assert html_text.main_text(page).split("\n")[::2] == [f"{'word ' * 40}{i}" for i in range(5)]
    assert html_text.main_text(page).count("\nx") == 5


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain text", "plain text"), ("<article>cut <p", "cut"), ("<article><p>a<p>b", "a\nb"), ("<script>x", ""), ("<article></article>", "")])
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


def test_spans_follow_surges_and_dives():
    assert list(html_text.spans(__import__("numpy").array([0, 0, 5, 0, 90, 0, 0, 0, 3, 0]), 3, 0.25)) == [(2, 5)]


def test_every_page_against_its_article(spark):
    rows = queries.QUERIES["op1_html_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect()
    assert len(rows) == 250
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)


def test_clashing_columns_and_no_rows(spark):
    df = spark.createDataFrame([(1, None, "<p>a", 7), (1, "u", "<p>a", 7)], "page_id long, url string, html string, text int")
    assert [tuple(r) for r in html_text.extract(df).collect()] == [(1, None, "a", 1), (1, "u", "a", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_long_page():
    assert len(html_text.main_text("<article>" + "<p>some words here</p>" * 50_000)) == 16 * 50_000 - 1


BODY = "".join(f"<p>Sentence {i} of the body, with words enough to be read as one.</p>" for i in range(12))


@pytest.mark.parametrize("box", ['div class="elementor-widget-text-editor"', 'div class="wp-block-media-banner"', 'div class="has-sidebar"', 'div id="no-comments"', 'div class="post post-with-related"', "form action=/x", 'form class="search" id=aspnetForm', 'div class="widget"', 'div class="banner"'])
def test_a_box_that_holds_the_page_is_no_furniture(box):
    page = f"<body><nav><a href=/>Home</a></nav><{box}><input type=hidden name=__VIEWSTATE><input name=q>{BODY}<div class=sidebar>Side</div></{box.split()[0]}><footer>me</footer>"
    article = f"<article><h1>Head</h1><{box}>{BODY}</{box.split()[0]}</article>"
    assert html_text.main_text(page).count("Sentence") == html_text.main_text(article).count("Sentence") == 12
    assert "Side" not in html_text.main_text(page)


@pytest.mark.parametrize("box", ['div class="site-footer"', 'div class="adSlot ad-2"', 'ul class="related-posts"', 'section id="comments"', 'div role="banner"', "form", "aside", 'p class="ad"'])
def test_furniture_beside_the_text_goes(box):
    name = box.split()[0]
    assert html_text.main_text(f"<body><article>{BODY}<{box}>Buy this or say so.</{name}><p>End.</p></article>").endswith("as one.\nEnd.")
    assert "Buy" not in html_text.main_text(f"<body><div>{BODY}</div><{box}>Buy this or say so.</{name}>")
    long = "I disagree with all of this, and at length. " * 40
    assert "disagree" not in html_text.main_text(f"<body><article>{BODY}</article><div class=comments>{long}</div>")


def test_a_form_of_fields_and_an_unclosed_paragraph():
    assert html_text.main_text("<form>Name <input name=a> Password <input name=b type=password></form>") == ""
    assert html_text.main_text("<article><p class=ad>Buy<p>Text.</article>") == "Text."


CARD = "<article><h3>Also read</h3><p>A card of a few words.</p></article>"


@pytest.mark.parametrize("cards", [1, 5])
@pytest.mark.parametrize("box", ["div", "section"])
def test_teaser_articles_do_not_take_the_page(box, cards):
    long = "<p>" + "A sentence of the body that goes on for a while. " * 20 + "</p>"
    got = html_text.main_text(f"<body><nav>menu</nav><{box}><h1>Head</h1>{long * 3}</{box}>{CARD * cards}<footer>me</footer>")
    assert got.count("A sentence") == 60 and "Also read" not in got
    assert html_text.main_text(f"<body>{CARD * cards}<{box}>{long}</{box}>").count("A sentence") == 20


def test_an_article_outweighs_what_is_beside_it():
    beside = "<div><p>" + "Text of the page beside the article, not named as furniture. " * 5 + "</p></div>"
    assert html_text.main_text(f"<body>{beside}<article>{BODY}</article>{beside}").count("Sentence") == 12
    assert "beside" not in html_text.main_text(f"<body>{beside}<article>{BODY}</article>{beside}")
    posts = "".join(f"<article><h2>Post {i}</h2><p>{'Words of a post. ' * (40 if i % 2 else 2)}</p></article>" for i in range(6))
    assert html_text.main_text(f"<body><div>{posts}</div>").count("Post") == 6


def test_paragraphs_between_adverts():
    ad = '<div class="ad">Buy</div>'
    long, closing = "<p>" + "Long words of prose. " * 72 + "</p>", "<p>" + "The closing words. " * 16 + "</p>"
    got = html_text.main_text(f"<body><div>{long}{ad}<p>Short one.</p>{ad}{long}{ad}{closing}{ad}</div><ul><li><a href=/>{'Link of a list ' * 30}</a></ul><footer>me</footer><p>tail</p>")
    assert got.count("Long words") == 144 and "Short one." in got and got.endswith("The closing words.")
    assert html_text.main_text(f"<body><p>Only this.</p>{ad}<p>Or.</p>") == "Only this.\nOr."


COMMENT = "I disagree with all of this, and at length, as a reader may. " * 30


@pytest.mark.parametrize("box", ['div class="user-comments"', 'ol class="commentlist"', 'div id="commentSection"', 'article class="comment"', 'section class="reply"', 'div class="post-comments"'])
def test_comments_go_however_long_they_are(box):
    name = box.split()[0]
    inside, beside = f"<article>{BODY}<{box}>{COMMENT}</{name}></article>", f"<div>{BODY}</div><{box}><p>{COMMENT}</p></{name}>"
    for page in (inside, beside, f"<article><p>A short article of one line.</p></article><{box}>{COMMENT * 9}</{name}>"):
        got = html_text.main_text(f"<body>{page}")
        assert "disagree" not in got and ("Sentence 11" in got or got == "A short article of one line.")


@pytest.mark.parametrize("box", ['div class="comments-open"', 'div class="has-comments"', 'div class="commentary"', 'div class="cookies-allowed"', 'main class="comments"'])
def test_boxes_that_only_mention_a_name_stay(box):
    assert html_text.main_text(f"<body><{box}>{BODY}</{box.split()[0]}>").count("Sentence") == 12


@pytest.mark.parametrize("box", ['div id="CybotCookiebotDialog"', 'div class="sponsored-content"', 'div class="more-stories"', 'div class="cookieBar-text"'])
def test_notices_and_adverts_go_by_a_word_of_their_name(box):
    other = "<p>We and our partners, or a story of theirs.</p>" * 3
    for page in (f"<main>{BODY}<{box}>{other}</div><p>End.</p></main>", f"<{box}>{other}</div><div>{BODY}</div>"):
        got = html_text.main_text(f"<body>{page}")
        assert "partners" not in got and got.count("Sentence") == 12


@pytest.mark.parametrize("before", ["İ", "İİİ", "İ" * 30, "ẞŉǰ"])
def test_letters_that_grow_when_lowered(before):
    page = f"<title>{before}</title><body><article><p>{before} first</p><SCRIPT>var a = 1</Script><p>The next paragraph</p></article>"
    assert html_text.main_text(page) == f"{before} first\nThe next paragraph"


def test_the_length_profile_decides_where_nothing_is_named():
    menu, foot = ("".join(f"<div>{w}</div>" for w in words.split()) for words in ("Home World Sport Money Health Travel Food Video", "Terms Privacy Contact Jobs Press Help Feeds Apps"))
    body = "".join(f"<div>Sentence {i} of the body, with words enough to be read as one line of its text.</div>" for i in range(9))
    got = html_text.main_text(f"<body><div>{menu}</div><div><div>A headline over the text</div>{body}</div><div>{foot}</div>").split("\n")
    assert got.count("A headline over the text") == 1 and sum(x.startswith("Sentence") for x in got) == 9
    assert not {"Home", "World", "Sport", "Money", "Health", "Travel"} & set(got) and not {"Jobs", "Press", "Help", "Feeds", "Apps"} & set(got)


def test_stray_end_tags_take_linear_time():
    import time

    def seconds(n):
        start = time.process_time()
        html_text.main_text("<font>" * n + "</b>" * n + "<p>text")
        return time.process_time() - start

    assert seconds(32_000) < 20 * max(seconds(4000), 0.01)
