"""Article extraction: fields by priority, ways to the body, broken markup, whole table."""

import json
import re
from html import unescape

from claimloom import catalog_relations as K
from claimloom.functions import pages as P

LONG = "This paragraph has enough words to count as a part of the article that is looked for here."


def got(html, url="https://www.paper.example/x"):
    return dict(zip(P.FIELDS, P.article(url, html), strict=True))


def test_fields_by_priority():
    linked = json.dumps({"@graph": [{"@type": "WebSite", "headline": "no"}, {"@type": ["NewsArticle"], "headline": "Linked - Paper", "author": [{"name": "A. Writer"}], "publisher": {"name": "The Paper"}}]})
    page = f'<head><title>Page</title><meta property="og:title" content="Tagged"><meta name="author" content="Other"><meta name="pubdate" content=" 2024-05-01 "><link rel="canonical" href="/a"><script type="application/ld+json">{linked}</script></head>'
    r = got(page)
    assert (r["title"], r["author"], r["publisher"], r["published_at"]) == ("Linked", "A. Writer", "The Paper", "2024-05-01")
    assert (r["domain"], r["canonical_url"], r["description"]) == ("paper.example", "https://www.paper.example/a", None)
    bare = got("<title>T</title><h1>Head <b>line</b></h1>")
    assert (bare["title"], bare["publisher"]) == ("Headline", "Paper")


def test_ways_to_the_body():
    assert got(f"<article><p>{LONG}</p><p>short</p><h2>{LONG}</h2></article>")["body"] == f"{LONG}\n\n{LONG}"
    assert got(f"<div class='x post-content'><p>{LONG}<p>{LONG}</div>")["method"] == "container_selector(div[class*='post-content'])"
    assert got(f"<p>{LONG}</p><p>{LONG}</p>")["method"] == "body_paragraph_aggregation"
    linked = json.dumps({"@type": "Article", "articleBody": LONG * 2})
    assert got(f'<script type="application/ld+json">{linked}</script>')["method"] == "json_ld_article_body"
    assert (got("<p>short</p>")["body"], got("<p>short</p>")["method"]) == (None, "failed")


def test_junk_goes_and_broken_markup_stays():
    page = f"<article><nav><p>{LONG}</p></nav><div id='Cookie-box'><p>{LONG}</p></div><!-- <p>{LONG}</p> --></i><p>{LONG} &amp; more</p><p>{LONG}"
    assert got(page)["body"] == f"{LONG} & more\n\n{LONG}"


def test_nothing_fails():
    for html in (None, "", "<", "<p", "</p></p>", '<script type="application/ld+json">{bad</script>', '<script type="application/ld+json">[1, null]</script>', "<b>" * 20_000):
        assert P.article(None, html)[-1] == "failed"
    assert P.article("https://[bad", "x")[5] is None


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = {r["page_id"]: r for r in K.page_articles(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(rows) == len(pages)
    for p in pages:
        h1 = re.search(r"<h1>([^<]*)</h1>", p["html"] or "")
        if h1:
            assert rows[p["page_id"]]["title"] == unescape(h1[1]).strip()
