"""Reports, totals and TF-IDF matches against loops."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from claimloom.operators import assembly as A
from claimloom.operators import tfidf

ITEM = ("claim_id long, cluster string, evidence_id long, stance string, category string, domain string, primary boolean, meta_score double, n_chars long, published_at string, fact_checker string, "
        "reliability long, source_type string, transparency string, kind string, aspect string, severity string, value string, relevance double")


def item(claim_id, cluster, evidence_id, stance, relevance, kind=None, value=None):
    return (claim_id, cluster, evidence_id, stance, "NEWS_MEDIA", "x.org", False, 0.8, 100, None, "checker" if evidence_id % 10 == 9 else None, 80, "NEWS", "HIGH", kind, kind and "amount", kind and "MAJOR", value, relevance)


def test_reports(spark):
    evidence = spark.createDataFrame([
        *[item(1, f"c{k}", k, "SUPPORTING", k / 10) for k in range(4)], item(1, None, 9, "CONTRADICTING", None, "NUMERIC", "Five"), item(1, None, 8, "NEUTRAL", 0.5, "NUMERIC", "five"),
        *[item(2, "same", 100 + k, "SUPPORTING", 0.1) for k in range(30)],
    ], ITEM)
    claims = spark.createDataFrame([(1, 7, 1, "one", "LOW"), (2, 7, 2, "two", "HIGH"), (3, 7, 0, "three", "HIGH"), (4, 8, 0, "four", None)], "claim_id long, doc long, place int, claim_text string, importance string")
    got = {r.doc: r for r in A.reports(claims, evidence).collect()}
    one = got[7]
    assert [c.claim_id for c in one.claims] == [3, 2, 1] and [c.score is None for c in one.claims] == [True, True, False]
    last = one.claims[2]
    assert [c.evidence_id for c in last.supporting_evidence] == [3, 2, 1, 0] and [c.evidence_id for c in last.contradicting_evidence] == [9] and (last.discrepancies, last.sources, last.fact_checks) == (1, 6, 1)
    assert one.claims[1].items == A.MOST_ITEMS and one.items == 26 and one.score == last.score and one.classification == last.classification
    assert one.executive_summary.startswith("The submitted content contains 3 material factual claim(s). Analysis indicates: ") and "2 with insufficient corroboration" in one.executive_summary
    assert got[8].score is None and A.ALL_BELOW in got[8].executive_summary and got[8].claims[0].supporting_evidence == []
    assert "1 verified fact-check review(s) were analyzed. 1 factual discrepancy(ies) were identified" in last.summary and "(0 independent source" in one.claims[0].summary
    assert A.reports(claims.limit(0), evidence).count() == 0


def test_totals(spark):
    evidence = spark.createDataFrame([item(c, f"k{e % 2}" if e % 5 else None, e, ["SUPPORTING", "NEUTRAL", None][e % 3], 0.1) for e in range(40) for c in [e % 4]], ITEM).withColumn("doc", F.col("claim_id") % 2)
    got = {(r.level, r.doc, r.claim_id): (r["items"], r.supporting, r.sources) for r in A.totals(evidence).collect()}
    rows = evidence.collect()

    def told(pick):
        own = [r for r in rows if pick(r)]
        return len(own), sum(r.stance == "SUPPORTING" for r in own), len({(r.claim_id, r.cluster, None if r.cluster else r.evidence_id) for r in own})

    want = {("claim", c % 2, c): told(lambda r, c=c: r.claim_id == c) for c in range(4)} | {("document", d, None): told(lambda r, d=d: r.doc == d) for d in range(2)} | {("all", None, None): told(lambda r: True)}
    assert got == want


def test_tfidf_matches_equal_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(10**6, None), (10**6 + 1, ""), (10**6 + 2, "...")]
    rows += [(2 * 10**6 + i, f"{t} more words here") for i, t in rows[:40] if t] + [(3 * 10**6 + i, t) for i, t in rows[:20]]
    counts = {i: Counter(w for w in re.sub(r"[^\w\s]", " ", (t or "").lower()).split()) for i, t in rows}
    df = Counter(w for c in counts.values() for w in c)
    vectors = {}
    for i, c in counts.items():
        v = {w: n * (math.log((1 + len(rows)) / (1 + df[w])) + 1) for w, n in c.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors[i] = {w: x / norm for w, x in v.items()}
    asked = [i for i in vectors if i % 5 == 0]
    want = {}
    for q in asked:
        for i, v in vectors.items():
            cosine = sum(x * v.get(w, 0.0) for w, x in vectors[q].items())
            if i != q and cosine >= 0.85:
                want[q, i] = cosine
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("df", F.lit(1))
    got = {(r["query"], r.doc_id): r.cosine for r in tfidf.tfidf_matches(frame, "doc_id", frame.where("doc_id % 5 = 0")).collect()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in got) and len(want) > 10
