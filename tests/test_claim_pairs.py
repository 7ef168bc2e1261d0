"""Pairs of a claim's items, compared where the claim is, against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom import catalog_relations as K
from claimloom.functions import similarity as M
from claimloom.functions import text as T
from claimloom.operators import relations as L
from claimloom.operators import verification as V
from tests.test_relations import BODY, SCHEMA, SF, alike, grams, item, jaccard


def test_a_claims_items_go_to_a_worker_once(spark):
    plan = L.relations(K.items(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "array_intersect" not in plan and "a_ord" not in plan


def test_ratios_of_many_at_once():
    rng = random.Random(4)
    texts = ["", "abc", "abc", "a", "xyz", "😀é" * 30] + ["".join(rng.choice("abcde é😀") for _ in range(rng.choice((3, 70, 400, M.SHORT, M.SHORT + 900)))) for _ in range(12)]
    wanted = np.array([[(i * j) % 3 != 1 for j in range(len(texts))] for i in range(len(texts))])
    got = M.ratios(texts, wanted)
    assert all(got[i, j] == (M.ratio(texts[i], texts[j]) if wanted[i, j] and i != j else 0.0) for i in range(len(texts)) for j in range(len(texts)))


def test_figures_of_pairs(spark):
    given = K.items(spark, SF).where("claim_id < 6").withColumn("snippet", F.when(F.col("ord") % 4 == 1, F.col("title"))).withColumn("content", F.when(F.col("ord") % 5 > 0, F.col("content")))
    rows = {r["ord"]: r for r in given.withColumn("wires", V.wire_agencies(F.concat_ws(" ", "publisher", "title", F.coalesce("snippet", F.lit("")), F.coalesce("content", F.lit(""))))).collect()}
    got = L.compared(given).collect()
    n_whole = 0
    for r in got:
        a, b = rows[r["a"]], rows[r["b"]]
        x, y = (" ".join([q["title"], q["snippet"] or "", q["content"] or ""]) for q in (a, b))
        own = [q["content"] or q["snippet"] or "" for q in (a, b)]
        assert r["content"] == pytest.approx(alike(*own, True), abs=0.00051)
        assert r["brief"] == pytest.approx(alike(*[" ".join([q["title"], q["snippet"] or ""]) for q in (a, b)], True), abs=0.00051)
        assert r["n_phrases"] == min(5, sum(len(grams(x, n) & grams(y, n)) for n in (6, 5)))
        assert r["wired"] == bool(set(a["wires"]) & set(b["wires"]))
        if r["all"] is None:
            assert r["same_domain"] or not (r["derived"] or r["wired"] or r["n_phrases"] > 1)
        else:
            n_whole += 1
            assert r["all"] == pytest.approx(alike(x, y, True), abs=0.00051)
    assert len(got) > 100 and 0 < n_whole < len(got)


def test_shares_in_parts(monkeypatch):
    rng = random.Random(5)
    sets = [{rng.randrange(60) for _ in range(rng.randrange(40))} for _ in range(7)] + [set()]
    cells = np.array([v * 8 + i for i, s in enumerate(sets) for v in s for _ in range(2)])
    for most in (1 << 20, 8, 40):
        monkeypatch.setattr(L, "CELLS", most)
        got = L.shares(cells, 8)
        assert all(got[i, j] == jaccard(sets[i], sets[j]) for i in range(8) for j in range(8) if i != j)


def test_many_words_of_a_claim(monkeypatch):
    rows = [{"title": t, "snippet": "", "own": t, "has_content": True, "has_own": True, "url": None, "domain": None, "publisher": None, "wires": [], "cited": []} for t in ("a b c d e f g", "x b c d e f g", "", "b c d")]
    want = L.told(rows)
    monkeypatch.setattr(L, "MANY_WORDS", 0)
    got = L.told(rows)
    assert all((got[k] == want[k]).all() for k in want) and want["n_phrases"][0, 1] == 3


def test_equal_and_missing_places(spark):
    items = [item(1, "Water plan", BODY, "u", "a.org"), item(1, "Water plan", BODY, "u", "a.org"), item(None, "Water plan", BODY, "u", "a.org"), item(2, "Water plan", BODY, "v", "b.org")]
    other = [(None, *items[0][1:]), (None, *items[3][1:]), (9, *items[0][1:])]
    got = [(r["claim_id"], r["a"], r["b"], r["kind"]) for r in L.relations(spark.createDataFrame(items + other, SCHEMA)).collect()]
    assert got == [(1, 1, 2, "EXACT_DUPLICATE")] * 2


def test_words_of_forms_are_words(spark):
    texts = ["ΑΣ ΟΔΟΣ' ab cd", "İstanbul áb ²x", "x y _z", None, ""]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in frame.select(T.similarity_form("t").alias("f"), T.words(F.col("t")).alias("w"), T.similarity_form(F.concat_ws(" ", "t", F.lit("Σ"), "t")).alias("c")).collect():
        assert (r["f"] or "").split() == (r["w"] or [])
        assert r["c"] == " ".join(filter(None, [r["f"], "σ", r["f"]]))
