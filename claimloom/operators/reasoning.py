"""Reasoning without a model: findings, observations, gaps, uncertainty and a summary from a claim's packet, as nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import report as R

#: Categories of primary documents, and sentences (fixed values).
PRIMARY = ("government", "institution")
HAS_PRIMARY, NO_PRIMARY = "Primary institutional or government documentation was identified among retrieved sources.", "Retrieved sources consist primarily of secondary journalistic coverage."
DISTINCT, NO_CHECKS = "All retrieved articles appear to originate from distinct reporting sources.", "No third-party fact-check reviews were located for this claim."
GAPS = {
    "few": "Limited independent corroboration: only {} independent source group(s) found.", "primary": "No primary official document was retrieved to independently verify the claim.",
    "conflict": "Unresolved numerical or temporal discrepancies exist between reporting outlets.", "none": "No relevant external evidence could be retrieved.",
}
ITEM = "array<struct<rank:int,evidence_id:string,publisher:string,stance:string,category:string,reliability:string,confidence:double,point:string>>"
CHECK = "array<struct<fact_checker:string,raw_rating:string,verdict:string>>"
CONFLICT = "array<struct<aspect:string,claim_value:string,evidence_value:string>>"


def said(*parts) -> Column:
    """Texts and columns in one sentence."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def list_of(*parts: Column) -> Column:
    return F.array_compact(F.array(*parts))


def findings(items: Column, stance: str, otherwise: str) -> Column:
    """A finding of each item of a stance: its first point or what its publisher does."""
    def one(i: Column) -> Column:
        weight = F.lit("HIGH") if stance == "CONTRADICTING" else F.when(i["reliability"] == "high", "HIGH").otherwise("MEDIUM")
        return F.struct(F.coalesce(i["point"], F.concat(i["publisher"], F.lit(otherwise))).alias("text"), F.array(i["evidence_id"]).alias("evidence_ids"), F.lit(stance).alias("stance"), weight.alias("importance"), i["confidence"].alias("confidence"))

    return F.transform(F.filter(items, lambda i: i["stance"] == stance), one)


def fallback_reasoning(packets: DataFrame) -> DataFrame:
    """For each row of ``packets`` (claim_id and items, fact_checks, discrepancies, cluster_sizes as arrays, independent) the findings, observations, gaps,
    uncertainty and summary. Arrays are bounded by the packet; null ones are empty, but null cluster_sizes say that no clusters are known."""
    p = packets.select("claim_id", *[F.coalesce(F.col(c).cast(t), F.array().cast(t)).alias(c) for c, t in (("items", ITEM), ("fact_checks", CHECK), ("discrepancies", CONFLICT))], "cluster_sizes",
                       F.coalesce("independent", F.lit(0)).cast("int").alias("n"))
    p = p.withColumn("items", F.array_sort("items"))
    p = p.withColumn("supporting_findings", findings(F.col("items"), "SUPPORTING", " reports corroboration for the claim.")).withColumn("contradicting_findings", findings(F.col("items"), "CONTRADICTING", " contradicts or refutes the claim."))
    first = F.get("items", F.lit(0))
    vague = F.struct(F.concat(first["publisher"], F.lit(" discusses the topic, but provides inconclusive evidence.")).alias("text"), F.array(first["evidence_id"]).alias("evidence_ids"), first["stance"].alias("stance"), F.lit("LOW").alias("importance"), F.lit(0.7).alias("confidence"))
    key = F.concat(F.slice("supporting_findings", 1, 1), F.slice("contradicting_findings", 1, 1))
    p = p.withColumn("key_findings", F.when((F.size(key) == 0) & (F.size("items") > 0), F.array(vague)).otherwise(key))
    p = p.withColumn("important_discrepancies", F.transform("discrepancies", lambda d: said("Conflict on ", d["aspect"], ": claim asserts '", d["claim_value"], "', but evidence reports '", d["evidence_value"], "'.")))
    primary = F.exists("items", lambda i: F.coalesce(i["category"].isin(*PRIMARY), F.lit(False)))
    high = F.size(F.filter("items", lambda i: i["reliability"] == "high"))
    p = p.withColumn("source_observations", list_of(F.when(primary, HAS_PRIMARY).otherwise(NO_PRIMARY), F.when(high > 0, said(high, " high-reliability publisher(s) are present in the evidence corpus."))))
    many, count = F.size(F.filter("cluster_sizes", lambda s: s > 1)), said("Effective independent source count is ", F.col("n"), ".")
    p = p.withColumn("independence_observations", F.array(F.when(many > 0, F.concat(said(many, " multi-article syndication cluster(s) detected. "), count)).when(F.size("cluster_sizes") > 0, DISTINCT).otherwise(count)))
    checks = F.transform("fact_checks", lambda c: said("Fact check by ", c["fact_checker"], " rated the claim '", c["raw_rating"], "' (", c["verdict"], ")."))
    p = p.withColumn("fact_check_observations", F.when(F.size("fact_checks") > 0, checks).otherwise(F.array(F.lit(NO_CHECKS))))
    conflict, nothing = F.size("discrepancies") > 0, F.size("items") == 0
    few = said(*[x if k % 2 == 0 else F.col("n") for k, x in enumerate([GAPS["few"].split("{}")[0], None, GAPS["few"].split("{}")[1]])])
    gaps = list_of(F.when(F.col("n") < 2, few), F.when(~primary, GAPS["primary"]), F.when(conflict, GAPS["conflict"]), F.when(nothing, GAPS["none"]))
    p = p.withColumn("verification_gaps", R.with_absence_gaps(gaps, F.size("items"), F.size("supporting_findings")))
    p = p.withColumn("uncertainty", F.when(nothing | (F.size("contradicting_findings") > 0) | conflict, "HIGH").when((F.col("n") < 2) | (F.size("supporting_findings") == 0), "MEDIUM").otherwise("LOW"))
    check = F.get("fact_checks", F.lit(0))
    told = F.when(F.size("fact_checks") > 0, said("A third-party fact check by ", check["fact_checker"], " rated this claim '", check["verdict"], "'."))
    found = F.when(F.col("n") > 0, said("Retrieved evidence resolved into ", F.col("n"), " independent cluster(s) (", F.size("supporting_findings"), " supporting, ", F.size("contradicting_findings"), " contradicting).")).otherwise(
        "Evidence retrieval yielded no independent corroborating sources.")
    p = p.withColumn("summary", F.concat_ws(" ", told, found, F.get("important_discrepancies", F.lit(0))))
    return p.drop("items", "fact_checks", "discrepancies", "cluster_sizes", "n").withColumns({"ai_used": F.lit(False), "fallback_used": F.lit(True)})


#: Names of the score's parts, and sentences about the score (fixed values).
LABELS = {"evidence_agreement": "evidence agreement", "source_quality": "source quality", "independent_sources": "independent sources", "fact_checks": "fact checks", "official_evidence": "official evidence", "transparency": "transparency"}
INSUFFICIENT = "Insufficient evidence available to substantiate or refute this claim. Fewer than 2 independent reporting sources or decisive evidence items were retrieved."
UNMET = "Independent confirmation threshold not met: retrieved sources may be syndicated or too few to form a conclusive verdict."
STRONG = 5.0


def score_summary(penalty: Column) -> Column:
    """Of score, classification and parts; ``penalty``: the explanation of the first one, or null."""
    strong = F.slice(F.transform(F.filter("parts", lambda x: x["contribution"] > STRONG), lambda x: F.element_at(F.create_map(*[F.lit(y) for kv in LABELS.items() for y in kv]), x["factor"])), 1, 2)
    strengths = F.when(F.size(strong) > 0, said("Strengths include strong ", F.array_join(strong, ", "), "."))
    text = F.concat_ws(" ", said("Claim evaluated as '", F.col("classification"), "' (score: ", F.col("score"), "/100)."), strengths, F.concat(F.lit("Score reduced due to: "), penalty))
    return F.when(F.col("score").isNull(), INSUFFICIENT).otherwise(text)


def score_limitations(discrepancies: Column) -> Column:
    """Of score and sources; ``discrepancies``: explanations of the discrepancy penalties."""
    few = said("Evaluation is based on ", F.col("sources"), " independent source cluster(s). Additional corroboration from secondary outlets recommended.")
    return F.concat(list_of(F.when(F.col("score").isNull(), UNMET), F.when(F.col("sources") < 3, few)), discrepancies)
