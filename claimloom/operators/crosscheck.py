"""Cross-verification of scores by grounded findings, and rescue of claims whose evidence was insufficient."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import report as R
from claimloom.operators import scoring as C

#: Points by which findings move a score at most, the difference of ratios from which they do, and findings that rescue a claim (fixed values).
MOST_POINTS, MATERIAL, LEAST_FINDINGS = 15.0, 0.30, 2


def grounded(findings: Column, valid: Column) -> Column:
    """Findings with at least one valid id, of which they keep these."""
    kept = F.transform(findings, lambda f: f.withField("evidence_ids", F.filter(f["evidence_ids"], lambda i: F.array_contains(valid, i))))
    return F.filter(kept, lambda f: F.size(f["evidence_ids"]) > 0)


def grounded_findings(results: DataFrame, evidence: DataFrame) -> DataFrame:
    """(claim_id, usable, supporting, contradicting, supporting_ids, contradicting_ids) of ``results`` (claim_id, ai_used, fallback_used and the arrays
    supporting_findings and contradicting_findings), with the ids of the claim's own evidence alone."""
    valid = evidence.groupBy("claim_id").agg(F.collect_set("evidence_id").alias("valid"))
    out = results.join(valid, "claim_id")
    none = lambda c: F.coalesce(c, F.array().cast(dict(results.dtypes)[c]))
    for side in ("supporting", "contradicting"):
        out = out.withColumn(side, grounded(none(f"{side}_findings"), F.col("valid"))).withColumn(f"{side}_ids", F.array_distinct(F.flatten(F.transform(side, lambda f: f["evidence_ids"]))))
    usable = F.coalesce("ai_used", F.lit(False)) & ~F.coalesce("fallback_used", F.lit(False))
    return out.select("claim_id", usable.alias("usable"), F.size("supporting").alias("n_supporting"), F.size("contradicting").alias("n_contradicting"), "supporting_ids", "contradicting_ids")


def rescued_figures(evidence: DataFrame, findings: DataFrame) -> DataFrame:
    """Figures of the claims of ``findings`` (as of ``grounded_findings``) in which the findings' ids have taken the place of
    all comparisons: no discrepancies, no fact-checks, and sources counted by the clusters that the findings name."""
    met = evidence.join(findings, "claim_id")
    up, down = F.array_contains("supporting_ids", F.col("evidence_id")), F.array_contains("contradicting_ids", F.col("evidence_id"))
    unit = F.struct("cluster", F.when(F.col("cluster").isNull(), F.col("evidence_id")).alias("item"))
    named = met.groupBy("claim_id").agg(*[F.size(F.collect_set(F.when(c, unit))).alias(k) for k, c in (("independent", up), ("independent_contradicting", down))])
    told = met.withColumn("stance", F.when(up, "SUPPORTING").when(down, "CONTRADICTING")).withColumn("kind", F.lit(None).cast("string")).withColumn("fact_checker", F.lit(None).cast("string"))
    counted = findings.select("claim_id", F.col("n_supporting").alias("supporting"), F.col("n_contradicting").alias("contradicting"))
    return R.claim_figures(told.drop(*[c for c in findings.columns if c != "claim_id"])).drop("independent", "independent_contradicting", "supporting", "contradicting").join(named, "claim_id").join(counted, "claim_id")


def cross_verify(scores: DataFrame, evidence: DataFrame, results: DataFrame) -> DataFrame:
    """``scores`` (as of ``claim_scores``) as score, classification, scoring_method and adjustment after the findings of ``results``.

    A score moves by up to ``MOST_POINTS`` where the findings' ratio differs from the agreement of the evidence by ``MATERIAL`` or more.
    A claim without a score that has two grounded findings is scored anew from them; only the evidence of such claims is read a
    second time. Claims without findings, evidence or a reasoning result of its own keep their score, and say so."""
    findings = grounded_findings(results, evidence)
    rows = scores.join(findings, "claim_id", "left").withColumn("usable", F.coalesce("usable", F.lit(False)))
    total = F.col("n_supporting") + F.col("n_contradicting")
    ratio = F.when(F.col("usable") & (total > 0), F.col("n_supporting") / total)
    diff = F.round(ratio - F.col("agreement"), 9)
    moved = F.when(F.col("score").isNotNull() & (F.abs(diff) >= MATERIAL), F.greatest(F.lit(-MOST_POINTS), F.least(F.lit(MOST_POINTS), diff * MOST_POINTS * 2.0)))
    rows = rows.withColumn("adjustment", moved)
    weak = rows.where(F.col("score").isNull() & F.col("usable") & (total >= LEAST_FINDINGS))
    again = rescued_figures(evidence, weak.select(*findings.columns)).withColumn("doc", F.lit(None).cast("long")).withColumn("importance", F.lit(None).cast("string"))
    saved = C.claim_scores(again).where("score is not null").select("claim_id", F.col("score").alias("saved"))
    out = rows.join(saved, "claim_id", "left")
    shifted = F.when(F.col("adjustment").isNotNull(), F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("score") + F.col("adjustment"))), 6)).cast("int"))
    score = F.coalesce(shifted, F.col("score"), F.col("saved"))
    method = F.when(F.col("adjustment").isNotNull() | F.col("saved").isNotNull(), "ai_assisted").when(F.col("score").isNull(), "insufficient_evidence").otherwise("deterministic")
    return out.select("claim_id", "doc", "importance", score.alias("score"), C.classification(score).alias("classification"), method.alias("scoring_method"), "adjustment")
