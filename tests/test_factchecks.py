"""Fact-check alignment, ratings and cross-verification: cases and one-by-one rules."""

import pytest
from pyspark.sql import functions as F

from claimloom.operators import crosscheck as X
from claimloom.operators import factchecks as FC
from claimloom.operators import scoring as C

REVIEW = "source_type string, provider string, domain string, publisher string, metadata map<string,string>, title string, snippet string, content string"
CLAIM = "claim string, speaker string, entities array<struct<label:string,text:string>>, persons array<string>, organizations array<string>, locations array<string>, dates array<string>, numbers array<string>"


def review(**given):
    return tuple(given.get(k) for k in ("source_type", "provider", "domain", "publisher", "metadata", "title", "snippet", "content"))


@pytest.mark.parametrize(("given", "found"), [
    ({"source_type": "FACT_CHECK"}, True), ({"provider": "google_factcheck"}, True), ({"metadata": {"rating": "x"}}, True), ({"metadata": {"other": "x"}}, False), ({"domain": "www.BoomLive.in"}, True),
    ({"publisher": "AFP Fact Check"}, True), ({"provider": "news", "domain": "news.org"}, False), ({}, False),
])
def test_what_is_a_fact_check(spark, given, found):
    assert spark.createDataFrame([review(**given)], REVIEW).select(FC.is_fact_check()).first()[0] is found


@pytest.mark.parametrize(("given", "rating", "reviewed"), [
    ({"metadata": {"rating": " ", "verdict": " False "}}, "False", None), ({"snippet": "It was. rating:  Half true. More"}, "Half true", None), ({}, "Unknown", None),
    ({"snippet": "Claim reviewed: 'The bridge fell.'. Rating: False", "metadata": {}}, "False", "The bridge fell"), ({"title": "Claim: The bridge\nfell Rating: Fake"}, "Unknown", "The bridge\nfell"),
    ({"content": "CLAIM: the bridge stands."}, "Unknown", "the bridge stands"), ({"metadata": {"claim_text": " as told. "}, "snippet": "Claim: other"}, "Unknown", "as told."),
])
def test_ratings_and_reviewed_assertions(spark, given, rating, reviewed):
    row = spark.createDataFrame([review(**given)], REVIEW).select(FC.raw_rating(), FC.reviewed_text()).first()
    assert tuple(row) == (rating, reviewed)


def claim(text, names=(), dates=(), numbers=(), places=()):
    return (text, None, [("X", n) for n in names], [], [], list(places), list(dates), list(numbers))


TOWER = claim("The iron tower was finished in 1889 for the fair in Paris.", ["iron tower", "Paris"], ["1889"])
FLOOD = claim("Recently there was a flood in Bihar.", ["Bihar"], places=["Bihar"])
ROVER = claim("The rover of the agency landed on Mars on February 18, 2021.", ["rover", "Mars"], ["February 18, 2021"])
PETROL = claim("The central government announced a cut of 10 rupees in petrol prices.", ["central government"], numbers=["10 rupees"])


@pytest.mark.parametrize(("given", "reviewed", "gate", "aligned"), [
    (TOWER, "A photo shows that the iron tower in Paris collapsed", "figures_absent", False), (TOWER, "The iron tower in Paris was finished in 1889", "overlap", True),
    (FLOOD, "Image of a family on the roof of their hut during Bihar floods", "media_debunk", False), (FLOOD, "There was a flood in Bihar", "overlap", True),
    (ROVER, "The February 18, 2021 landing of the rover on Mars was staged in a studio", "hoax_variant", False), (ROVER, "The rover found fossils on Mars", "figures_absent", False),
    (ROVER, "The rover of the agency landed on Mars on February 18, 2021", "overlap", True), (ROVER, "Rover landed on Mars (18 2021)", "overlap", True), (PETROL, "Central government cut petrol prices by Rs 10", "overlap", True),
    (PETROL, "Actors of a film were paid 10 times", "overlap", False), (claim("Cats sleep a lot in winter."), "Dogs bark", "overlap", False), (claim("Cats sleep a lot in winter."), "A hoax: cats sleep a lot", "hoax_variant", False),
])
def test_alignment(spark, given, reviewed, gate, aligned):
    row = spark.createDataFrame([given], CLAIM).select(FC.alignment(F.lit(reviewed)).alias("a")).first()["a"]
    assert (row.gate, row.aligned) == (gate, aligned)
    assert row.score == {"figures_absent": 0.15, "hoax_variant": 0.1, "media_debunk": 0.1}.get(row.gate, row.score)


def test_only_aligned_ratings_count(spark):
    rows = [review(metadata={"claim_reviewed": "The rover of the agency landed on Mars on February 18, 2021", "rating": "False"}), review(metadata={"claim_reviewed": "The landing of the rover on Mars in February 18, 2021 was faked", "rating": "False"}),
            review(metadata={"rating": "False"}, content="Short."), review(domain="news.org", content="The agency says that its rover landed on Mars on February 18, 2021, as planned."), review()]
    pairs = spark.createDataFrame([(k, *r, *ROVER) for k, r in enumerate(rows)], f"k int, {REVIEW}, {CLAIM}")
    got = FC.compare(pairs).orderBy("k").collect()
    assert [(r.method, r.stance, r.confidence, r.relevance) for r in got[:3]] == [("rating", "CONTRADICTING", 0.92, 0.95), ("mismatch", "NEUTRAL", 0.58, 0.3), ("review_text", "INSUFFICIENT", 0.7, 0.0)]
    assert (got[3].method, got[3].rating, got[4].method, got[4].stance) == ("text", None, "text", "INSUFFICIENT")


ITEM = ("claim_id long, cluster string, evidence_id long, stance string, category string, domain string, primary boolean, meta_score double, n_chars long, published_at string, fact_checker string, "
        "reliability long, source_type string, transparency string, kind string, aspect string, severity string")


def item(claim_id, cluster, evidence_id, stance, kind=None):
    return (claim_id, cluster, evidence_id, stance, "NEWS_MEDIA", "x.org", False, 0.8, 100, None, None, 80, "NEWS", "HIGH", kind, kind and "amount", kind and "MAJOR")


FINDING = "array<struct<text:string,evidence_ids:array<long>>>"


def test_cross_verification(spark):
    from claimloom.operators import report as R

    evidence = spark.createDataFrame([
        *[item(1, f"c{k}", k, "SUPPORTING") for k in range(4)],  # agreement 1.0, findings against it
        *[item(2, f"c{k}", 10 + k, "NEUTRAL", "NUMERIC") for k in range(4)],  # insufficient, rescued by two findings
        *[item(3, f"c{k}", 20 + k, "NEUTRAL") for k in range(4)],  # insufficient, its findings are of other claims
        *[item(4, f"c{k}", 30 + k, "SUPPORTING") for k in range(3)],  # the result is a fallback
        *[item(5, "one", 40 + k, "NEUTRAL") for k in range(3)],  # one source: still insufficient after findings
        *[item(6, f"c{k}", 50 + k, "SUPPORTING") for k in range(4)], *[item(7, f"c{k}", 60 + k, "SUPPORTING") for k in range(2)],  # agree; no result
    ], ITEM)
    f = lambda *ids: [("t", list(i)) for i in ids]
    results = spark.createDataFrame([
        (1, True, False, f([0, 99]), f([1], [2], [77])), (2, True, False, f([10], [11, 5]), None), (3, True, False, f([10], [11]), f([99])), (4, True, True, None, f([30], [31])), (5, True, False, f([40], [41]), f([42])),
        (6, True, None, f([50], [51], [52]), f([53])), (8, True, False, f([1]), f([1])),
    ], f"claim_id long, ai_used boolean, fallback_used boolean, supporting_findings {FINDING}, contradicting_findings {FINDING}")
    scores = C.claim_scores(R.claim_figures(evidence).withColumns({"doc": F.lit(1), "importance": F.lit("HIGH")}))
    before = {r.claim_id: r.score for r in scores.collect()}
    got = {r.claim_id: (r.score, r.scoring_method, r.adjustment) for r in X.cross_verify(scores, evidence, results).collect()}
    assert set(got) == set(range(1, 8))
    assert got[1] == (before[1] - 15, "ai_assisted", -15.0)  # a third against all: 20 points, held at 15
    assert got[2][1:] == ("ai_assisted", None) and before[2] is None and got[2][0] == 25 + 12 + 13 + 8 + 4  # agreement, quality, two of three sources, no fact-check, transparency; no discrepancies
    assert got[3] == (None, "insufficient_evidence", None) and got[5] == (None, "insufficient_evidence", None)
    assert got[4] == (before[4], "deterministic", None) and got[6] == (before[6], "deterministic", None) and got[7] == (before[7], "deterministic", None)
