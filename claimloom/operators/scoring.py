"""Credibility: components, penalties, claim and document scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Factor weights, penalties and limits (fixed values).
FACTORS = {"evidence_agreement": 0.25, "source_quality": 0.15, "independent_sources": 0.20, "fact_checks": 0.15, "official_evidence": 0.20, "transparency": 0.05}
PENALTY = {"CRITICAL": 20.0, "MAJOR": 10.0}
OTHER_PENALTY, REFUTATION, ANONYMOUS = 5.0, 25.0, 10.0
TARGET_SOURCES, LEAST_INDEPENDENT, LEAST_DECISIVE = 3, 2, 2
IMPORTANCE = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4}


def _components() -> Column:
    """(factor, raw, contribution) of a row of per-claim figures, in the order of the factors."""
    s, c = F.col("independent"), F.col("independent_contradicting")
    raw = {
        "evidence_agreement": F.when(s + c > 0, s / (s + c)).when(F.col("neutral") > 0, 0.5).otherwise(0.0),
        "source_quality": F.coalesce(F.col("support_reliability") / 100.0, F.col("mean_reliability") / 100.0 * 0.5, F.lit(0.0)),
        "independent_sources": F.least(F.col("independent") / float(TARGET_SOURCES), F.lit(1.0)),
        "fact_checks": F.coalesce("fact_check_mean", F.lit(0.5)),
        "official_evidence": F.when(F.col("official"), 1.0).when(F.col("primary_support"), 0.8).otherwise(0.0),
        "transparency": F.coalesce("transparency_mean", F.lit(0.5)),
    }
    return F.array(*[F.struct(F.lit(k).alias("factor"), v.cast("double").alias("raw"), F.round(v * w * 100.0, 2).alias("contribution")) for (k, w), v in zip(FACTORS.items(), raw.values(), strict=True)])


def components(claims: DataFrame) -> DataFrame:
    """(claim_id, factor, raw, contribution) of per-claim figures."""
    return claims.select("claim_id", F.inline(_components()))


def classification(score: Column) -> Column:
    return (F.when(score.isNull(), "INSUFFICIENT EVIDENCE").when(score >= 90, "STRONGLY SUPPORTED").when(score >= 75, "MOSTLY SUPPORTED")
            .when(score >= 50, "MIXED / UNCERTAIN").when(score >= 25, "WEAKLY SUPPORTED").otherwise("STRONGLY CONTRADICTED"))


def penalty_points(severity: Column) -> Column:
    out = F.lit(OTHER_PENALTY)
    for k, v in PENALTY.items():
        out = F.when(severity == k, v).otherwise(out)
    return out


def scored(claims: DataFrame) -> DataFrame:
    """``claims`` with parts, total, agreement, score and classification: half-even, null where sources or decisive items are too few."""
    out = claims.withColumn("parts", _components()).withColumn("total", F.aggregate("parts", F.lit(0.0), lambda a, x: a + x["contribution"]))
    lacking = (F.col("sources") < LEAST_INDEPENDENT) | (F.col("supporting") + F.col("contradicting") < LEAST_DECISIVE)
    score = F.bround(F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.col("total") - F.col("penalty"))), 6)).cast("int")
    out = out.withColumn("agreement", F.get("parts", F.lit(0))["raw"]).withColumn("score", F.when(~lacking, score))
    return out.withColumn("classification", classification(F.col("score")))


def claim_scores(claims: DataFrame) -> DataFrame:
    return scored(claims).select("claim_id", "doc", "importance", "agreement", "score", "classification")


def document_scores(scores: DataFrame) -> DataFrame:
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in IMPORTANCE.items() for x in kv]), F.col("importance"))
    w = F.when(F.col("score").isNotNull(), weight)
    mean = F.sum(w * F.col("score")) / F.sum(w)
    return scores.groupBy("doc").agg(F.bround(F.round(mean, 6)).cast("int").alias("score"), F.count("score").alias("n_scored"), F.count("*").alias("n_claims")).withColumn("classification", classification(F.col("score")))
