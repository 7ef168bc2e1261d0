"""Article metadata and body of raw HTML, by a UDF over a forgiving tree of the standard library's parser.

An end tag closes the nearest open element of its name and is ignored where there is none; unclosed elements
nest. No expression of Spark parses HTML, and patterns can't follow nesting, so this is one pass in Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Elements without an end, elements whose text is no prose (fixed values).
VOID = "area base br col embed hr img input link meta param source track wbr".split()
UNREAD = "script style template".split()
#: Elements that hold no article, and words that mark others (fixed values).
JUNK_TAGS = "script style noscript iframe nav footer header aside form button svg canvas audio video menu".split()
JUNK_WORDS = "comment advert sponsored cookie newsletter subscribe sidebar related-posts social-share share-buttons disclaimer breadcrumb modal popup banner".split()
#: Containers of articles: element, attribute, what it contains (fixed values).
CONTAINERS = (("div", "class", "article-body"), ("div", "class", "story-body"), ("div", "class", "post-content"), ("div", "class", "entry-content"), ("section", "class", "article"),
              ("div", "id", "article-body"), ("main", None, None))
#: Names of meta elements by field, first wins (fixed values).
METAS = {
    "title": ("og:title", "twitter:title"), "publisher": ("og:site_name", "publisher", "twitter:site"), "author": ("author", "article:author", "twitter:creator", "byl"),
    "published_at": ("article:published_time", "datePublished", "publishdate", "pubdate", "timestamp", "dc.date"), "description": ("og:description", "description", "twitter:description"),
}
#: Fields of structured data by ours (fixed values).
LINKED = {"title": "headline", "publisher": "publisher", "author": "author", "published_at": "datePublished", "description": "description", "body": "articleBody"}
#: Characters that a part, a loose paragraph and a whole article have more than (fixed values).
PART_CHARS, LOOSE_CHARS, BODY_CHARS = 20, 30, 100


class Element:
    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.inside = name, attrs, []

    def walk(self) -> Iterator[Element]:
        """Elements below, in document order, however deep."""
        left = [x for x in reversed(self.inside) if isinstance(x, Element)]
        while left:
            e = left.pop()
            yield e
            left += [x for x in reversed(e.inside) if isinstance(x, Element)]

    def find(self, *names: str) -> Iterator[Element]:
        return (e for e in self.walk() if e.name in names)

    def text(self) -> str:
        """All text, each piece trimmed."""
        out, left = [], list(reversed(self.inside))
        while left:
            x = left.pop()
            if isinstance(x, str):
                out.append(x.strip())
            elif x.name not in UNREAD:
                left += reversed(x.inside)
        return "".join(out)

    def prune(self, gone) -> None:
        """Without the elements for which ``gone`` holds."""
        left = [self]
        while left:
            e = left.pop()
            e.inside = [x for x in e.inside if isinstance(x, str) or not gone(x)]
            left += [x for x in e.inside if isinstance(x, Element)]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        e = Element(tag, {k: v or "" for k, v in reversed(attrs)})
        self.open[-1].inside.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].name == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].inside.append(data)


def tree(html: str) -> Element:
    parser = _Tree()
    parser.feed(html)
    parser.close()
    return parser.root


def _named(value) -> str | None:
    """A person or an organisation in structured data: its name, itself, or the first of several."""
    if isinstance(value, list):
        value = value[0] if value else None
    return value.get("name") if isinstance(value, dict) else value if isinstance(value, str) else None


def linked_data(root: Element) -> dict[str, str]:
    """Fields of the page's articles in JSON-LD, first wins."""
    found: dict[str, str] = {}
    for script in root.find("script"):
        if script.attrs.get("type") != "application/ld+json":
            continue
        try:
            data = json.loads("".join(x for x in script.inside if isinstance(x, str)))
        except ValueError:
            continue
        graph = data.get("@graph") if isinstance(data, dict) else data
        for item in graph if isinstance(graph, list) else [data]:
            kinds = item.get("@type", "") if isinstance(item, dict) else ""
            if any("article" in str(k).lower() or "news" in str(k).lower() for k in (kinds if isinstance(kinds, list) else [kinds])):
                for field, name in LINKED.items():
                    value = item.get(name)
                    value = _named(value) if field in ("author", "publisher") else value if isinstance(value, str) else None
                    if value and field not in found:
                        found[field] = value
    return found


def metadata(root: Element, url: str) -> dict[str, str | None]:
    """Title, publisher, author, date, description, domain, canonical URL and JSON-LD body of a page."""
    try:
        host = (urlsplit(url).hostname or "").lower().removeprefix("www.")
    except ValueError:
        host = ""
    metas: dict[tuple[str, str], str] = {}
    for m in root.find("meta"):
        for key in ("property", "name"):
            if key in m.attrs:
                metas.setdefault((key, m.attrs[key]), m.attrs.get("content", "").strip())
    linked = linked_data(root)
    out: dict[str, str | None] = {}
    for field, names in METAS.items():
        tagged = (metas[key, n] if metas.get((key, n)) is not None else "" for n in names for key in ("property", "name"))
        out[field] = linked.get(field) or next((v for v in tagged if v), None)
    for name in ("h1", "title"):
        out["title"] = out["title"] or next((e.text() for e in root.find(name)), None)
    site = host.split(".")[0]
    if out["title"] and site:
        head, dash, tail = out["title"].rpartition(" - ")
        if dash and site in tail.lower():
            out["title"] = head.strip()
    out["publisher"] = out["publisher"] or (site.capitalize() if site else None)
    href = next((e.attrs.get("href") for e in root.find("link") if "canonical" in e.attrs.get("rel", "").lower()), None)
    try:
        canonical = urljoin(url, href) if href else None
    except ValueError:
        canonical = href
    return out | {"domain": host or None, "canonical_url": canonical, "linked_body": linked.get("body")}


def body(root: Element, linked_body: str | None) -> tuple[str | None, str]:
    """The article's text with the way it was found; prunes ``root``."""
    root.prune(lambda e: e.name in JUNK_TAGS)
    root.prune(lambda e: any(w in e.attrs.get(k, "").lower() for k in ("class", "id") for w in JUNK_WORDS))

    def parts(within: Element, names: tuple[str, ...], more: int) -> str | None:
        found = [t for t in (e.text() for e in within.find(*names)) if len(t) > more]
        return "\n\n".join(found) if sum(map(len, found)) > BODY_CHARS else None

    for article in list(root.find("article"))[:1]:
        got = parts(article, ("p", "h2", "h3"), PART_CHARS)
        if got:
            return got, "semantic_article_tag"
    for name, attr, part in CONTAINERS:
        for e in root.find(name):
            if attr is None or part in e.attrs.get(attr, ""):
                got = parts(e, ("p", "h2", "h3"), PART_CHARS)
                if got:
                    return got, f"container_selector({name}[{attr}*='{part}'])" if attr else f"container_selector({name})"
                break
    if linked_body and len(linked_body.strip()) > BODY_CHARS:
        return linked_body.strip(), "json_ld_article_body"
    got = parts(root, ("p",), LOOSE_CHARS)
    return (got, "body_paragraph_aggregation") if got else (None, "failed")


FIELDS = ("title", "publisher", "author", "published_at", "description", "domain", "canonical_url", "body", "method")


def article(url: str | None, html: str | None) -> tuple[str | None, ...]:
    root = tree(html or "")
    meta = metadata(root, url or "")
    meta["body"], meta["method"] = body(root, meta["linked_body"])
    return tuple(meta[f] for f in FIELDS)


@F.udf(StructType([StructField(f, StringType()) for f in FIELDS]), useArrow=False)
def extract(url: str | None, html: str | None) -> tuple[str | None, ...]:
    """Rows come a hundred at a time; an Arrow batch would hold ten thousand pages of any size and their articles at once."""
    return article(url, html)
