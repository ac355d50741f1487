"""HTML extraction: the template decides, boilerplate goes, nothing of the article is lost, and no markup breaks it."""

import random
import re
import time
from html import unescape

import pytest

from veritrace.llm import html_text
from veritrace.llm.html_text import Blocks

SCHEMA = "page_id long, url string, html string, host string, text string"


def texts_of(spark, pages, **options):
    rows = [(*p, "h", "t") for p in pages]
    return {r["page_id"]: r["text"] for r in html_text.report(spark.createDataFrame(rows, SCHEMA), **options).collect()}


def article_of(html):
    """The blocks of the one article of a page of the test tables, by other means: no parser, no template."""
    body = re.search(r"<article>(.*)</article>", html, re.S).group(1)
    blocks = re.split(r"</?(?:p|h1|h2|h3|div|li|ul|ol)\b[^>]*>", body)
    plain = (" ".join(unescape(re.sub(r"<[^>]*>", lambda m: " " if m.group().startswith(("<br", "<hr")) else "", b)).split()) for b in blocks)
    return "\n".join(b for b in plain if b)


def test_articles_of_a_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_text.report(pages).collect()}
    assert {r["page_id"]: article_of(r["html"]) for r in pages.collect()} == got


def site(n, notice="All prices include tax and shipping within the country."):
    """Pages without article and without telling names: a menu, a notice, two content parts, a list of links."""
    draw = random.Random(n)
    text = lambda k: " ".join(draw.choice("lorem ipsum dolor sit amet elit sed do magna erat nunc".split()) + str(draw.randrange(999)) for _ in range(k))
    menu = "".join(f"<a href='/{k}'>Section {k}</a> " for k in range(9))
    want = [(text(30), text(60), text(50)) for _ in range(n)]
    html = "<html><head><title>t</title></head><body><div class='x1'>{m}</div><div class='x2'><div class='x3'><p>{a}</p><p>{s}</p></div><div class='x4'><p>{b}<p>{c}</div></div><div class='x5'>{m}</div><div class='x6'>{f}</div></body></html>"
    return [(k, f"http://plain.example/{k}", html.format(m=menu, s=notice, a=a, b=b, c=c, f=text(3))) for k, (a, b, c) in enumerate(want)], ["\n".join(w) for w in want]


def test_the_template_finds_slots_without_telling_names(spark):
    pages, want = site(8)
    assert texts_of(spark, pages) == dict(enumerate(want))


def test_without_the_template_the_result_differs(spark, monkeypatch):
    pages, want = site(8)
    real = html_text.templates
    monkeypatch.setattr(html_text, "templates", lambda tokens, **o: real(tokens, **o).withColumn("paths", html_text.F.expr("transform(paths, x -> named_struct('token', x.token + 1, 'prose', x.prose, 'links', x.links, 'once', x.once))")))
    assert texts_of(spark, pages) != dict(enumerate(want))


def test_a_page_alone_on_its_host_and_copies_of_an_article(spark):
    pages, want = site(1)
    alone = texts_of(spark, pages)[0]
    assert want[0].split("\n")[1] in alone and "Section" not in alone
    copies = [(k, f"http://copies.example/{k}", pages[0][2]) for k in range(9)]
    assert set(texts_of(spark, copies).values()) == {alone}


def test_parts_of_other_roles_go(spark):
    html = ("<body><header><h1>Site</h1></header><div class='cookie-notice'>We use cookies</div><nav>menu</nav><form>name <input> please</form>"
            "<main><article><header><h1>Title &#8212; one</h1></header><p>First <a href=x>link</a> text,\n\t  and more.</p><script>no()</script><span class='ad'>Buy now</span>"
            "<p>Second<style>p{}</style></p><div class='comments'><p>reader says</p></div></article></main><aside>side</aside><footer>foot</footer></body>")  # fmt: skip
    got = texts_of(spark, [(1, "http://a.example/1", html), (2, None, None), (3, "http://a.example/3", ""), (1, "http://a.example/1", html)])
    assert got == {1: "Title — one\nFirst link text, and more.\nSecond", 2: "", 3: ""}


def test_broken_markup():
    draw = random.Random(9)
    parts = ["<![foo[x]]>", "<![CDATA[x", "<!", "<!--", "-->", "</", "<a href='", "<p", ">", "&#xD800;", "&#99999999999;", "&nosuch;", "<div class=>", "</div></div>", "<script>", "</script>", "text ", "\x00", "<table><tr><td>", "<?php ?>", "<article>", "</article>", "<svg>", "<b", "]]>", "<!DOCTYPE", "<![if !IE]>", "<![endif]>"]
    for _ in range(3000):
        html = "".join(draw.choice(parts) for _ in range(draw.randrange(30)))
        page = Blocks().done(html)
        assert set(p for p, _, _ in page.blocks) <= set(page.paths)
    assert Blocks().done("<p>a<![foo[x]]>b</p>").blocks[0][1].startswith("a")


@pytest.mark.parametrize("unit", ["<div>", "<div class=a><p>x", "<ul><li>", "<x>", "</b>", "<b>", "<span class=ad>", "<a href=x>y", "<p>z", "<table><tr><td>"])
def test_time_grows_with_the_length_alone(unit):
    def seconds(n):
        began = time.process_time()
        Blocks().done("<body>" + unit * n + "end")
        return time.process_time() - began

    seconds(2000)
    assert seconds(40_000) < 40 * max(seconds(4000), 0.01)


def test_empty_pages(spark):
    assert html_text.report(spark.createDataFrame([], SCHEMA)).count() == 0
