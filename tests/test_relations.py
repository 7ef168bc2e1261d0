"""Similarity and relations against plain loops over pairs."""

import re
from functools import cache

import pytest
from pyspark.sql import functions as F

from claimloom import catalog_relations as K
from claimloom.functions import similarity as M
from claimloom.functions import text as T
from claimloom.operators import relations as L

SF = "/root/testdata/sf0.001"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prior = 0
        for k, y in enumerate(b, 1):
            row[k], prior = (prior + 1 if x == y else max(row[k], row[k - 1])), row[k]
    return row[-1]


@pytest.mark.parametrize("a, b", [("", ""), ("abc", ""), ("abc", "abc"), ("kitten", "sitting"), ("aaaa", "aa"), ("ab" * 40, "ba" * 33), ("héllo wörld", "hallo welt"), ("xyz", "abc")])
def test_common_subsequence(a, b):
    assert M.common_subsequence(a, b) == M.common_subsequence(b, a) == lcs(a, b)


def norm(t):
    return " ".join(re.sub(r"[^\w\s]", " ", (t or "").lower()).split())


def content_words(t):
    return {w for w in norm(t).split() if w not in T.STOP_WORDS and len(w) > 1}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def grams(t, n):
    w = norm(t).split()
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}


@cache
def seq(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a and b else 0.0


def alike(a, b, whole):
    x, y = norm(a), norm(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    j = jaccard(content_words(a), content_words(b))
    return 0.45 * j + 0.35 * seq(x[:500], y[:500]) + 0.2 * jaccard(grams(a, 3), grams(b, 3)) if whole else 0.6 * j + 0.4 * seq(x, y)


def test_relations_match_pairs_one_by_one(spark):
    given = K.items(spark, SF).where("claim_id < 4")
    rows = {r["ord"]: r for r in given.collect()}
    got = L.relations(given).collect()
    assert {(r["a"], r["b"]) for r in got} == {(x, y) for x in rows for y in rows if x < y and rows[x]["claim_id"] == rows[y]["claim_id"]}
    for r in got:
        a, b = rows[r["a"]], rows[r["b"]]
        assert r["title"] == pytest.approx(alike(a["title"], b["title"], False), abs=0.00051)
        own = alike(a["content"], b["content"], True) if a["content"] and b["content"] else 0.0
        assert r["content"] == pytest.approx(own, abs=0.00051)
    assert len({r["kind"] for r in got}) > 2


def item(ord_, title, content, url, domain, publisher=None):
    return (1, ord_, title, content, None, url, domain, publisher)


SCHEMA = "claim_id long, ord long, title string, content string, snippet string, canonical_url string, domain string, publisher string"
BODY = "The committee approved the new water plan on Tuesday after a long debate about costs and the river"


def kinds(spark, *items):
    return {(r["a"], r["b"]): (r["kind"], r["confidence"]) for r in L.relations(spark.createDataFrame(list(items), SCHEMA)).collect()}


def test_kinds(spark):
    got = kinds(
        spark,
        item(1, "Water plan approved", BODY, "https://a.org/1", "a.org", "Alpha News"),
        item(2, "Other words entirely", "Nothing shared here", "https://A.org/1", "a.org"),
        item(3, "Water plan approved", None, "https://b.org/1", "b.org"),
        item(4, "Plan for water: approval", BODY + " bed", "https://c.org/1", "c.org"),
        item(5, "Council news", "A vote took place, according to Alpha News, yesterday.", "https://d.org/1", "d.org"),
        item(6, "Sports results tonight", "The home side won again", "https://e.org/1", "e.org"),
        item(7, None, None, None, None),
    )
    assert got[1, 2] == ("EXACT_DUPLICATE", 0.98)
    assert got[1, 3] == ("EXACT_DUPLICATE", 0.95)
    assert got[1, 4] == ("SYNDICATED", 0.85)
    assert got[1, 5] == ("LIKELY_DERIVED", 0.88)
    assert got[1, 6] == ("LIKELY_INDEPENDENT", 0.85)
    assert got[6, 7] == ("UNKNOWN", 0.5)


def test_publisher_is_no_pattern(spark):
    texts = spark.createDataFrame([("as reported by a.b (c news today", "a.b (c"), ("as reported by axbcd news", "a.bcd"), ("citing the BBCX", "BBCX"), ("CITING bbcx.", "BBCX"), ("citing abc", "abc"), ("x", None)], "t string, p string")
    assert [r[0] for r in texts.select(L.cites(F.col("t"), F.col("p"))).collect()] == [True, False, False, True, False, False]


def test_clusters_follow_relations(spark):
    given = K.items(spark, SF)
    pairs = L.relations(given).collect()
    root = {r["ord"]: r["ord"] for r in given.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in pairs:
        if r["kind"] in L.DEPENDENT:
            x, y = find(r["a"]), find(r["b"])
            root[max(x, y)] = min(x, y)
    got = {r["ord"]: r["cluster"] for r in K.source_clusters(spark, SF).collect()}
    assert got == {x: find(x) for x in root}


def test_no_rows(spark):
    assert L.relations(spark.createDataFrame([], SCHEMA)).count() == 0
