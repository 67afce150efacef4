"""Main text of pages: planted articles among the rest of a page."""

import random
import time

import pytest

from gaugeworks.llm import html_extract
from gaugeworks.llm.entry import ORACLE_SQL, QUERIES

SENTENCE = "The quick survey found, after some weeks, that most of the people asked were content"
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies, please accept them, thank you.</p></div>
{article}
<aside class="sidebar"><p>Read more, and more, and more about this site</p></aside>
<div id="comments"><h3>Comments</h3><div class="comment"><p>I disagree, strongly, with all of it, says a reader who writes a lot.</p></div></div>
<form><p>Your name, please</p><input name="q"></form><div class="ad"><p>Buy now, cheap, and fast</p></div>
<footer><p>Imprint, contact, and legal terms</p></footer></body></html>"""


def paragraphs(n, seed=0):
    rng = random.Random(seed)
    return [f"{SENTENCE} {rng.randrange(10**6)}." for _ in range(n)]


def test_article_element():
    p = paragraphs(4)
    got = html_extract.extract(PAGE.format(article="<article><h1>A title</h1>" + "".join(f"<p>{x}</p>" for x in p) + "</article>"))
    assert got == "\n".join(["A title", *p])


def test_plain_containers_with_siblings():
    p = paragraphs(6, 1)
    article = f"<div class='post-content'><h2>A title</h2>{''.join(f'<p>{x}</p>' for x in p)}</div>"
    assert html_extract.extract(PAGE.format(article=article)) == "\n".join(["A title", *p])


def test_white_space_references_and_breaks():
    p = paragraphs(3, 2)
    article = f"<article><p>{p[0]}\n\t &amp; &eacute;&#x41;&#66; <b>bold</b>text</p><p>one<br>two</p><ul><li>first item</li><li>second <a href='x'>item</a></li></ul><p>{p[1]}</p><p>{p[2]}</p></article>"
    assert html_extract.extract(PAGE.format(article=article)) == "\n".join([f"{p[0]} & éAB boldtext", "one two", "first item", "second item", p[1], p[2]])


def test_page_within_a_form_or_hidden():
    p = paragraphs(4, 7)
    text = "".join(f"<p>{x}</p>" for x in p)
    rest = "<nav><a href='x'>Home</a></nav><input name='state'><select><option>One</option></select><button>Go</button>"
    article = f"<article><h1>A title</h1>{text}<form><p>Your mail</p><input></form></article>"
    for open_, close in (("<form id='aspnetForm'>", "</form>"), ("<fieldset>", "</fieldset>"), ("<div role='form'>", "</div>"), ("<div style='display:none'>", "</div>"), ("<div hidden><form>", "</form></div>")):
        assert html_extract.extract(f"<body>{open_}{rest}{article}{close}</body>") == "\n".join(["A title", *p])
    assert html_extract.extract(f"<body style='display: none'>{article}</body>") == "\n".join(["A title", *p])
    # no article, but a first heading or paragraphs
    assert html_extract.extract(f"<body><form>{rest}<div><h1>A title</h1>{text}</div></form></body>") == "\n".join(["A title", *p])
    assert html_extract.extract(f"<body><header><h1>Site</h1></header><form>{rest}<div>{text}</div></form></body>") == "\n".join(p)


def test_forms_and_hidden_parts_beside_an_article_go():
    p = paragraphs(4, 8)
    article = f"<article><h1>A title</h1>{''.join(f'<p>{x}</p>' for x in p)}<form>{''.join(f'<p>{x}</p>' for x in paragraphs(4, 9))}</form><div hidden><h1>Join us</h1><p>{SENTENCE}</p></div></article>"
    assert html_extract.extract(PAGE.format(article=article)) == "\n".join(["A title", *p])
    assert html_extract.extract("<form><p>Your name, please</p><input name='q'></form><div hidden><p>Later</p></div>") == ""


def test_broken_markup():
    p = paragraphs(3, 3)
    article = f"<article><p>{p[0]}<p>{p[1]}</b></i><div><p>{p[2]}</div></article>"
    assert html_extract.extract(PAGE.format(article=article)) == "\n".join(p)
    for junk in ("<", "<a", "</", "<!-- x", "<p <p <p", "<script>never closed", "<div" * 3000, "<b>" * 3000, "text only", "&&#;&#99999999;"):
        html_extract.extract(junk)


def test_nothing_to_find():
    assert html_extract.extract(None) == ""
    assert html_extract.extract("") == ""
    assert html_extract.extract("<nav><a href='x'>Home</a></nav><script>x</script>") == ""


def test_links_discount_a_list_of_links():
    p = paragraphs(3, 4)
    links = "<div class='box'>" + "".join(f"<p><a href='{i}'>{SENTENCE}, and, so, on {i}</a></p>" for i in range(12)) + "</div>"
    got = html_extract.extract(f"<body>{links}<div class='text'>{''.join(f'<p>{x}</p>' for x in p)}</div></body>")
    assert got == "\n".join(p)


def test_long_page():
    p = paragraphs(3000, 5)
    assert html_extract.extract(PAGE.format(article="<article>" + "".join(f"<p>{x}</p>" for x in p) + "</article>")) == "\n".join(p)


def test_frames(spark):
    p = paragraphs(3, 6)
    good = PAGE.format(article="<article>" + "".join(f"<p>{x}</p>" for x in p) + "</article>")
    pages = spark.createDataFrame([(1, good, "own"), (2, None, "own"), (3, "", "own"), (3, "", "own")], "page_id long, html string, MAIN_TEXT string")
    rows = html_extract.main_text(pages).collect()
    assert sorted((r["page_id"], r["main_text_"], r["MAIN_TEXT"]) for r in rows) == [(1, "\n".join(p), "own"), (2, "", "own"), (3, "", "own"), (3, "", "own")]
    assert html_extract.main_text(pages.limit(0)).collect() == []


def test_quotes_open_values_after_an_equals_sign_only():
    p = paragraphs(3, 11)
    for opening in ("<p title=don't>", "<p don't>", '<p 5">', "<p title=it's class=x>", "<p title = 'a > b'>", '<p title="it\'s > that">', "<p title='>' \">", "<p =x='a'>", "<p title=>"):
        assert html_extract.extract(f"<article>{opening}{p[0]}</p><p>{p[1]} isn't lost</p><p>{p[2]}</p></article>") == "\n".join([p[0], f"{p[1]} isn't lost", p[2]])
    assert html_extract.extract(f"<article><p>{p[0]} <a title=it's href=x>link</a> goes on</p><p>{p[1]}</p></article>") == f"{p[0]} link goes on\n{p[1]}"


def test_names_in_passing_and_lists_of_links_in_an_article_stay():
    p = paragraphs(4, 12)
    links = "<ul><li><a href='a'>First source</a></li><li><a href='b'>Second source</a></li></ul>"
    body = f"<h1>A title</h1><p>{p[0]}</p><p class=related-note>{p[1]}</p><p class='related'>{p[2]}</p>{links}<p class='has-sidebar'>{p[3]}</p>"
    want = "\n".join(["A title", p[0], p[1], p[2], "First source", "Second source", p[3]])
    assert html_extract.extract(PAGE.format(article=f"<article>{body}</article>")) == want
    assert html_extract.extract(PAGE.format(article=f"<div class='post-content'>{body}</div>")) == want


@pytest.mark.parametrize("name", ["comments", "article-comments", "comment-content", "post-footer", "ad-slot", "adBox", "cookie-notice", "newsletter-signup", "sidebar-left", "main-nav", "related-posts", "share-buttons"])
def test_parts_named_as_others_go_from_an_article(name):
    p = paragraphs(3, 13)
    other = f"<div class='{name}'><h3>Read on</h3><p><a href='x'>One more, of many</a></p></div>"
    assert html_extract.extract(PAGE.format(article=f"<article><h1>A title</h1><p>{p[0]}</p>{other}<p>{p[1]}</p><p>{p[2]}</p></article>")) == "\n".join(["A title", *p])


def test_menus_around_a_plain_container_go():
    p = paragraphs(3, 14)
    menu = "<ul><li><a href='a'>Home</a></li><li><a href='b'>News</a></li></ul>"
    assert html_extract.extract(f"<body><div>{menu}{''.join(f'<p>{x}</p>' for x in p)}{menu}</div></body>") == "\n".join(p)


def test_an_inline_end_tag_closes_no_block():
    assert html_extract.extract("<article><b>one <p>two </b>three</p><p>four</article>") == "one\ntwo three\nfour"


#: Paragraphs for page shapes below, which are written by hand, apart from the operator, with the blocks that a reader takes for the article.
P = paragraphs(12, 21)
NAV = "<div class=nav><a href=a>Home</a> <a href=b>News</a></div>"
FOOT = "<footer><p>Imprint, contact</p></footer>"
LINKS = "<div class=x1><ul>" + "".join(f"<li><a href={i}>Story number {i}</a></li>" for i in range(6)) + "</ul></div>"


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6, 8, 12])
def test_sections_columns_and_divs_without_an_article(n):
    p = P[:n]
    row = lambda x: f"<div class=row><div class=col><p>{x}</p></div></div>"
    shapes = [
        ("".join(f"<section><h2>Part {i}</h2><p>{x}</p></section>" for i, x in enumerate(p)), [y for i, x in enumerate(p) for y in (f"Part {i}", x)]),
        ("".join(f"<div><p>{x}</p></div>" for x in p), p),
        ("<div class=row><h1>Title</h1></div>" + "".join(row(x) for x in p), ["Title", *p]),
        ("<h1>Title</h1>" + "".join(row(f"{x} {x} {x}") for x in p), ["Title", *(f"{x} {x} {x}" for x in p)]),
        ("".join(row(x) for x in p) + row("The end."), [*p, "The end."]),
        ("".join(f"<div>{x}</div>" for x in p), p),
        ("".join(f"<x-part><p>{x}</x-part>" for x in p), p),
    ]
    for body, want in shapes:
        assert html_extract.extract(f"<body>{NAV}{body}{FOOT}</body>") == "\n".join(want)


SHAPES = {
    "links beside": (f"<div class=wrap>{LINKS}<div class=c>{''.join(f'<p>{x}</p>' for x in P[:3])}</div>{LINKS}</div><div>\xa9 2024 Acme</div>", P[:3]),
    "layout table": (f"<table><tr><td>{LINKS}</td><td><p>{P[0]}</p><p>{P[1]}</p></td></tr></table>", P[:2]),
    "breaks": (f"<div>{'<br><br>'.join(P[:3])}</div>", [" ".join(P[:3])]),
    "intro apart": (f"<h1>Title</h1><div class=intro><p>{P[0]}</p></div><div class=rest>{''.join(f'<p>{x} {x}</p>' for x in P[1:])}</div>", ["Title", P[0], *(f"{x} {x}" for x in P[1:])]),
    "list within": (f"<h1>Title</h1><div><p>{P[0]}</p><ul><li>one of two</li><li>two</li></ul></div><div><p>{P[1]}</p></div>", ["Title", P[0], "one of two", "two", P[1]]),
    "links between": (f"<div><p>{P[0]}</p></div>{LINKS}<div><p>{P[1]}</p></div>", P[:2]),
    "title apart": (f"<div class=t><h1>Title</h1></div><div class=c><p>{P[0]}</p><p>{P[1]}</p></div>", ["Title", *P[:2]]),
    "main of columns": (f"<main><div class=row><h1>Title</h1></div>{''.join(f'<div class=row><div class=col><p>{x}</p></div></div>' for x in P[:3])}</main>", ["Title", *P[:3]]),
    "short texts": ("".join(f"<div><p>Short text {i}, here.</p></div>" for i in range(3)), [f"Short text {i}, here." for i in range(3)]),
    "figure between": (f"<div class=c><p>{P[0]}</p></div><figure><img src=x><figcaption>A caption</figcaption></figure><div class=c><p>{P[1]}</p></div>", [P[0], "A caption", P[1]]),
    "named entries": (f"<div class=site-content><div class=entry><p>{P[0]}</p></div><div class=entry><p>{P[1]} {P[2]}</p></div></div>", [P[0], f"{P[1]} {P[2]}"]),
    "entries in body": (f"<div class=entry><p>{P[0]}</p></div><div class=entry><p>{P[1]} {P[2]}</p></div>", [P[0], f"{P[1]} {P[2]}"]),
    "table of data": (f"<div><p>{P[0]}</p><table><tr><th>A</th><td>1</td></tr></table><p>{P[1]}</p></div>", [P[0], "A", "1", P[1]]),
    "a part that goes ends a block": ("<article><div>one<nav>x</nav>two</div></article>", ["one", "two"]),
    "fieldset of text": (f"<article><p>{P[0]}</p><fieldset><legend>Box</legend><p>text</p></fieldset><p>{P[2]}</p></article>", [P[0], "Box", "text", P[2]]),
    "fieldset of fields": (f"<article><p>{P[0]}</p><fieldset><legend>Box</legend><input></fieldset><p>{P[2]}</p></article>", [P[0], P[2]]),
    "quotes and asides": (f"<article><p>{P[0]}</p><aside class=pull-quote>A word</aside><aside><blockquote>Two words</blockquote></aside><aside>More <a href=x>links</a></aside><p>{P[1]}</p></article>", [P[0], "A word", "Two words", P[1]]),
    "cdata": (f"<article><p>{P[0]}<![CDATA[x>y]]></p><p>{P[1]}<![CDATA[never closed></p></article>", P[:2]),
    "copyright": (f"<article><p>{P[0]}</p><p class=copyright>\xa9 2024 Acme Corporation Ltd of London. All rights reserved.</p></article>", P[:1]),
}


@pytest.mark.parametrize("name", SHAPES)
def test_page_shapes(name):
    body, want = SHAPES[name]
    assert html_extract.extract(f"<body>{NAV}{body}{FOOT}</body>") == "\n".join(want)


@pytest.mark.parametrize(
    "part",
    ["<script>x()</script>", "<style>p{}</style>", "<svg><path d=1 /></svg>", "<math><mi>x</mi></math>", "<button>Go</button>", "<button><div>Go</div></button>", "<input>", "<select><option>a</select>", "<iframe src=x></iframe>", "<noscript>x</noscript>", "<template><p>z</p></template>", "<video></video>", "<picture><source><img></picture>", "<o:p></o:p>", "<my-tag></my-tag>", "<output></output>"],
)
def test_what_is_no_block_splits_no_paragraph(part):
    assert html_extract.extract(f"<article><p>{P[0]} before {part}after</p><p>{P[1]}</p></article>") == f"{P[0]} before after\n{P[1]}"


@pytest.mark.parametrize("name", "legal promotion alert banner copyright search respond sponsor subscribe".split())
def test_prose_in_an_article_stays_whatever_its_name(name):
    body = f"<p>{P[0]}</p><p class={name}>{P[1]}</p><p>{P[2]}</p>"
    assert html_extract.extract(f"<article>{body}</article>") == "\n".join(P[:3])
    assert html_extract.extract(f"<body><div class=post-content>{body}</div></body>") == "\n".join(P[:3])
    assert html_extract.extract(f"<article>{body.replace(P[1], P[1] + '<a href=x>Join</a>')}</article>") == f"{P[0]}\n{P[2]}"


@pytest.mark.parametrize("name", "comment ad advert cookie-notice notice reply sponsored".split())
def test_comments_adverts_and_notices_go(name):
    assert html_extract.extract(f"<article><p>{P[0]}</p><p class={name}>{P[1]}</p><p>{P[2]}</p></article>") == f"{P[0]}\n{P[2]}"


@pytest.mark.parametrize("opening", ["<div>", "<b>", "<a href=x>", "<li>", "<p>", "<b><p>a</b>", "<ul><li>", "<table><tr><td>", "<span class=comment>", "</b>", "<", "<a b='c", "<b><li>"])
def test_time_is_linear_in_depth(opening):
    def seconds(n):
        began = time.process_time()
        html_extract.extract(f"{opening}x" * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(4000), 0.02)


def test_query(spark, sf, same):
    same(QUERIES["op4_html"](spark, sf), ORACLE_SQL["op4_html"])
