"""Grounding of claims and findings, and clusters by embeddings, against brute force."""

import difflib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from claimloom.operators import grounding as G
from claimloom.operators import neighbours as N


@pytest.mark.parametrize(("claim", "source", "grounded"), [
    ("Profit rose to 1,200 in 2024", "in 2024 profit was 1200", True), ("Profit rose to 1,200", "profit was 1,200", False), ("5 people", "five people", True), ("12 people", "twelve people", False),
    ("In March it fell", "it fell in march", True), ("In March it fell", "it fell in April", False), ("Nothing", "", True),
])
def test_numbers(spark, claim, source, grounded):
    assert spark.range(1).select(G.numbers_grounded(F.lit(claim), F.lit(source))).first()[0] is grounded


def ratio(name, text):
    target, source = re.findall(r"\w+", name.lower()), re.findall(r"\w+", text.lower())
    best = 0.0
    for width in {len(target) - 1, len(target), len(target) + 1}:
        if 1 <= width <= len(source):
            for k in range(len(source) - width + 1):
                best = max(best, difflib.SequenceMatcher(None, " ".join(target), " ".join(source[k : k + width])).ratio())
    return best


def test_windows_equal_brute_force(spark):
    r = random.Random(4)
    docs = [(i, row.text) for i, row in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(12).collect())]
    names = []
    for i, text in docs:
        ws = re.findall(r"\w+", text)
        for _ in range(12):
            k, n = r.randrange(len(ws)), r.randrange(1, 4)
            name = " ".join(ws[k : k + n])
            for _ in range(r.randrange(3)):
                at = r.randrange(len(name))
                name = name[:at] + r.choice(["", "x", name[at] * 2]) + name[at + 1 :]
            names.append((i, name))
        names += [(i, "not there at all"), (i, "- -"), (i, ws[0].upper())]
    names.append((99, "no source"))
    got = G.best_windows(spark.createDataFrame(names, "source_id long, name string"), spark.createDataFrame(docs, "source_id long, text string")).collect()
    of = dict(docs)
    assert len(got) == len(set(names))
    for row in got:
        best = ratio(row.name, of.get(row.source_id, "")) if re.search(r"\w", row.name) else 0.0
        assert row.likeness == (pytest.approx(best) if best >= G.LIKE else 0.0), (row, best)


def test_valid_claims(spark):
    source = "Indian officials said that Ravi Kumar of the Reserve Bank spent 25 crore in March 2024."
    texts = ["short", "Ravi Kumar spent 25 crore.", "ravi kumar spent 25 crore.", "Did Ravi Kumar spend it?", "Ravi Kumar spent 26 crore.", "The India officials said so.", "Angela Merkel spent 25 crore.", None, "x" * 501, "It was in March, he said.",
             "An eleventh claim that is too late."]
    names = [[], ["Ravi Kumar"], ["Ravi Kumar"], [], [], ["India"], ["Angela Merkel"], [], [], ["--"], []]
    claims = spark.createDataFrame([(1, k, t, 0.5, n) for k, (t, n) in enumerate(zip(texts, names, strict=True))] + [(2, 0, "A claim without a source text", 0.1, ["Ann Lee"]), (2, 1, "Another without names in it", 0.2, None)],
                                   "source_id long, ord int, claim_text string, confidence double, names array<string>")
    got = G.valid_claims(claims, spark.createDataFrame([(1, source), (2, None)], "source_id long, text string")).orderBy("source_id", "place").collect()
    assert [(r.source_id, r.place, r.claim_text) for r in got] == [(1, 0, "Ravi Kumar spent 25 crore."), (1, 1, "The India officials said so."), (1, 2, "It was in March, he said."), (2, 0, "Another without names in it")]


FINDING = "array<struct<text:string,evidence_ids:array<string>,stance:string,importance:string,confidence:double>>"


def validated(lists, ids, urls):
    """One by one."""
    warnings, out = [], []
    for name, findings in zip(G.LISTS, lists, strict=True):
        done = []
        for text, given, confidence in findings:
            kept = [i for i in given if i in ids]
            warnings += [f"Hallucinated evidence ID '{i}' detected in {name} finding: '{text[:60]}...'" for i in given if i not in ids]
            warnings += [f"Hallucinated URL '{u}' in finding text" for u in re.findall(r"https?://[^\s)\]]+", text) if u.lower() not in {x.lower() for x in urls}]
            done.append((text, kept or ids[:1], min(confidence, 0.75) if warnings else confidence))
        out.append(done)
    return out, warnings


def test_findings(spark):
    r = random.Random(8)
    packets, results, want = [], [], {}
    for claim in range(30):
        ids, urls = [f"e{k}" for k in range(r.randrange(4))], ["http://A.org/x"] * r.randrange(2)
        lists = [[(r.choice(["plain", "see http://a.org/x now", "see (https://b.org/y) and http://c.org", "long " * 30]), r.sample(["e0", "e1", "e2", "zz"], r.randrange(4)), r.random()) for _ in range(r.randrange(4))] for _ in G.LISTS]
        if claim != 7:
            packets.append((claim, ids, urls))
        want[claim] = validated(lists, ids if claim != 7 else [], urls if claim != 7 else [])
        results.append((claim, *[[(t, i, "S", "HIGH", c) for t, i, c in f] for f in lists], ["before"]))
    frame = spark.createDataFrame(results, f"claim_id long, {', '.join(f'{n} {FINDING}' for n in G.LISTS)}, limitations array<string>")
    got = G.validate_findings(frame, spark.createDataFrame(packets, "claim_id long, evidence_ids array<string>, urls array<string>")).collect()
    for row in got:
        lists, warnings = want[row.claim_id]
        assert [[(f.text, f.evidence_ids, f.confidence) for f in row[n]] for n in G.LISTS] == lists and row.warnings == warnings
        assert row.limitations == ["before"] + ([f"Grounding validator flagged {len(warnings)} unverified reference(s) which were sanitized."] if warnings else [])
    nothing = G.validate_findings(spark.createDataFrame([(1, None, None, None)], f"claim_id long, {', '.join(f'{n} {FINDING}' for n in G.LISTS)}"), spark.createDataFrame([], "claim_id long, evidence_ids array<string>, urls array<string>"))
    assert nothing.first().key_findings == [] and nothing.first().limitations == []


@pytest.mark.parametrize("task", [N.TASK, 90])
def test_embedding_clusters_find_most_pairs_and_no_others(spark, monkeypatch, task):
    monkeypatch.setattr(N, "TASK", task)
    monkeypatch.setattr(N, "BUCKET", 64)
    r = np.random.default_rng(3)
    rows = [(b + s * r.standard_normal(24)).tolist() for b in r.standard_normal((300, 24)) for s in (0.0, r.choice([0.2, 0.5]))]
    hot = r.standard_normal(24)
    rows += [(hot + 0.05 * r.standard_normal(24)).tolist() for _ in range(200)] + [rows[0]] * 30
    odd = [(None, rows[4]), (9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] * 24), (9004, [1.0] * 3), (9004, [1.0] * 3)]
    got = N.embedding_clusters(spark.createDataFrame([*enumerate(rows), *odd], "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows) + len(odd)
    assert all(g.cluster == g.vec_id and g.size == 1 for g in got if g.vec_id is not None and g.vec_id >= 9000)
    of = {g.vec_id: g.cluster for g in got if g.vec_id is not None and g.vec_id < 9000}
    x = np.array(rows)
    x = x / np.linalg.norm(x, axis=1)[:, None]
    link = x @ x.T >= 0.85
    true = np.arange(len(x))
    for a, b in np.argwhere(link):
        true[true == true[max(a, b)]] = min(true[a], true[b]) if true[a] != true[b] else true[a]
    pairs = [(a, b) for a, b in np.argwhere(link) if a < b]
    assert sum(of[a] == of[b] for a, b in pairs) >= 0.9 * len(pairs)
    assert all(true[k] == true[of[k]] for k in of)
    sizes = {}
    for g in got:
        sizes.setdefault(g.cluster, set()).add(g.size)
    assert all(len(s) == 1 for s in sizes.values())


def test_components_of_a_long_way(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 60, 1) if k != 30] + [(5, 5), (100, 101), (101, 100)], "a long, b long")
    got = {r.id: r.component for r in N.components(edges).collect()}
    assert got == {k: (0 if k <= 30 else 31) for k in range(61)} | {100: 100, 101: 100}
