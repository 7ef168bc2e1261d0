"""Families of verbs over a small lexicon, against sets."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import families as W

SENSES = [
    ("surge", "s1", 0), ("soar", "s1", 0), ("rise", "r1", 0), ("go_up", "r1", 0), ("climb", "r1", 1), ("lift", "l1", 0), ("hike", "h1", 0), ("raise", "l1", 1), ("plummet", "p1", 0), ("drop", "d1", 0), ("fall", "f1", 0),
    ("walk", "w1", 0), ("move", "m1", 0), ("run", "w1", 2), ("rain", "n1", 0), ("deep", "x4", 3), ("deep", "x1", 0), ("deep", "x2", 1), ("deep", "x3", 2), ("far", "x4", 0), ("ox", "s1", 5),
]
PARENTS = [("s1", "r1"), ("h1", "l1"), ("s1", "l1"), ("p1", "d1"), ("d1", "f1"), ("w1", "m1"), ("n1", "f1")]


@pytest.fixture(scope="module")
def expanded(spark):
    return W.expansions(spark.createDataFrame(SENSES, "lemma string, synset string, rank int"), spark.createDataFrame(PARENTS, "synset string, parent string")).cache()


def sets():
    names, parents = {}, {}
    for lemma, synset, _ in SENSES:
        word = lemma.replace("_", " ")
        if len(word) > 2:
            names.setdefault(synset, set()).add(word)
    for s, p in PARENTS:
        parents.setdefault(s, set()).add(p)
    senses = {}
    for lemma, synset, rank in SENSES:
        senses.setdefault(lemma.replace("_", " "), []).append((rank, synset))
    own = {w: [s for _, s in sorted(x)][:3] for w, x in senses.items() if len(w) > 2}
    syn = {w: {w}.union(*[names[s] for s in x]) for w, x in own.items()}
    hyper = {w: set().union(*[names[p] for s in x for p in parents.get(s, ())]) for w, x in own.items()}
    good = lambda x: {w for w in x if " " not in w and w not in W.GENERIC}
    above = {w: good(h).union(*[good(hyper[p]) for p in good(h)]) for w, h in hyper.items()}
    return syn, hyper, above, good


def related(a, b):
    syn, hyper, above, good = sets()
    if a == b:
        return True
    if a in W.GENERIC or b in W.GENERIC or a not in syn or b not in syn:
        return False
    return (a in syn[b] or b in syn[a] or a in hyper[b] or b in hyper[a] or bool(good(hyper[a]) & good(hyper[b])) or b in above[a] or a in above[b])


def test_related_equals_sets(spark, expanded):
    words = sorted({s[0].replace("_", " ") for s in SENSES} | {"unknown"})
    pairs = [(a, b) for a in words for b in words]
    got = {tuple(r) for r in W.related(spark.createDataFrame([*pairs, pairs[0]], "a string, b string"), expanded).collect()}
    assert got == {(a, b) for a, b in pairs if related(a, b)}
    assert {("surge", "rise"), ("hike", "surge"), ("plummet", "fall"), ("surge", "soar")} <= got and not {("walk", "run"), ("walk", "move"), ("deep", "far"), ("plummet", "rain")} & got - {("deep", "far")}


def test_family_words(spark, expanded):
    got = {r[0] for r in W.family_words(spark.createDataFrame([("Rise",), ("strike",)], "word string"), expanded).collect()}
    syn, hyper, above, good = sets()
    surface = {"rise", "strike"} | syn["rise"]
    assert got == {w for w in syn if good(syn[w] | hyper[w] | above[w]) & surface} | good(surface)
    texts = spark.createDataFrame([(1, "Prices SOAR and surge"), (2, "a walk"), (3, None), (4, "")], "k int, text string")
    assert [tuple(r) for r in W.family_signals(texts, ["k"], spark.createDataFrame([("rise",)], "word string"), expanded).collect()] == [(1, "soar")]


def test_actions(spark, expanded):
    rows = [(1, "surge", "Prices surge"), (2, "surge", "Prices soar, then fall"), (3, "surge", "Prices climb"), (4, "rise", "They go up"), (5, "walk", "They run"), (6, "run", "They walk"), (7, "plummet", "It may fall"), (8, "fall", None), (9, "unknown", "unknown")]
    got = {r.k: r.tier for r in W.action_matches(spark.createDataFrame(rows, "k int, action string, text string"), expanded, ["k"]).collect()}
    assert got == {1: "verbatim", 2: "synonym", 3: "related", 4: "phrase", 5: "synonym", 6: "synonym", 7: "related", 8: None, 9: "verbatim"}


def test_lexicon_makes_no_pairs_of_names(spark):
    senses = spark.range(2000).selectExpr("concat('word', id) AS lemma", "if(id % 2 = 0, 's', 't') AS synset", "0 AS rank")
    made = W.expansions(senses, spark.createDataFrame([("s", "t")], "synset string, parent string")).cache()
    assert made.count() <= 4 * 2000
    assert {r[0] for r in W.related(spark.createDataFrame([("word1", "word4"), ("word4", "word6"), ("word4", "none")], "a string, b string"), made).select(F.concat("a", "b")).collect()} == {"word1word4", "word4word6"}
