"""Reasoning from packets and texts of scores: cases."""

from pyspark.sql import functions as F

from claimloom.operators import reasoning as W
from claimloom.operators import report as R

PACKET = f"claim_id long, items {W.ITEM}, fact_checks {W.CHECK}, discrepancies {W.CONFLICT}, cluster_sizes array<int>, independent int"


def item(rank, stance, category="news", reliability="low", point=None, publisher="Daily"):
    return (rank, f"e{rank}", publisher, stance, category, reliability, 0.5, point)


def test_fallback_reasoning(spark):
    rows = [
        (1, [item(2, "CONTRADICTING"), item(1, "SUPPORTING", "government", "high", "It holds.")], [("Checker", "False", "False")], [("amount", "5", "7")], [2, 1], 2),
        (2, [item(1, "NEUTRAL", publisher="Weekly")], [], None, [1], 1),
        (3, None, None, None, None, None),
        (4, [item(1, "SUPPORTING"), item(2, "SUPPORTING")], None, [], None, 2),
    ]
    got = {r.claim_id: r for r in W.fallback_reasoning(spark.createDataFrame(rows, PACKET)).collect()}
    one, two, three, four = (got[k] for k in (1, 2, 3, 4))
    assert [(f.text, f.importance, f.evidence_ids) for f in one.key_findings] == [("It holds.", "HIGH", ["e1"]), ("Daily contradicts or refutes the claim.", "HIGH", ["e2"])]
    assert one.summary == ("A third-party fact check by Checker rated this claim 'False'. Retrieved evidence resolved into 2 independent cluster(s) (1 supporting, 1 contradicting). "
                           "Conflict on amount: claim asserts '5', but evidence reports '7'.") and one.uncertainty == "HIGH"
    assert one.source_observations == [W.HAS_PRIMARY, "1 high-reliability publisher(s) are present in the evidence corpus."] and one.verification_gaps == [W.GAPS["conflict"]]
    assert one.independence_observations == ["1 multi-article syndication cluster(s) detected. Effective independent source count is 2."] and one.fact_check_observations == ["Fact check by Checker rated the claim 'False' (False)."]
    assert two.key_findings[0].text == "Weekly discusses the topic, but provides inconclusive evidence." and two.uncertainty == "MEDIUM" and two.independence_observations == [W.DISTINCT]
    assert two.verification_gaps == ["Limited independent corroboration: only 1 independent source group(s) found.", W.GAPS["primary"], R.NO_SUPPORT]
    assert three.key_findings == [] and three.uncertainty == "HIGH" and three.summary == "Evidence retrieval yielded no independent corroborating sources." and three.verification_gaps[-1] == W.GAPS["none"]
    assert four.uncertainty == "LOW" and four.independence_observations == ["Effective independent source count is 2."] and four.fallback_used and not four.ai_used


def test_score_texts(spark):
    parts = [("evidence_agreement", 1.0, 25.0), ("source_quality", 0.1, 1.5), ("independent_sources", 1.0, 20.0), ("fact_checks", 0.5, 7.5)]
    frame = spark.createDataFrame([(80, "MOSTLY SUPPORTED", parts, 2, "a conflict"), (None, "INSUFFICIENT EVIDENCE", parts, 4, None), (10, "STRONGLY CONTRADICTED", [], 3, None)],
                                  "score int, classification string, parts array<struct<factor:string,raw:double,contribution:double>>, sources int, top string")
    got = frame.select(W.score_summary(F.col("top")).alias("s"), W.score_limitations(F.array_compact(F.array("top"))).alias("l")).collect()
    assert got[0].s == "Claim evaluated as 'MOSTLY SUPPORTED' (score: 80/100). Strengths include strong evidence agreement, independent sources. Score reduced due to: a conflict"
    assert got[0].l[0].startswith("Evaluation is based on 2 independent") and got[0].l[1] == "a conflict" and (got[1].s, got[1].l) == (W.INSUFFICIENT, [W.UNMET]) and got[2].l == []
    assert got[2].s == "Claim evaluated as 'STRONGLY CONTRADICTED' (score: 10/100)."
