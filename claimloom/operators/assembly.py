"""Reports: one nested row for each document, and totals of claims and documents, from one pass over the evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import report as R
from claimloom.operators import scoring as C

#: Items that a claim keeps after retrieval (fixed value).
MOST_ITEMS = 20
#: Sentences of the summaries (fixed values).
CLAIM_TEXTS = {
    "STRONGLY SUPPORTED": "Evidence is predominantly supportive across {} independent source cluster(s) analyzed.",
    "MOSTLY SUPPORTED": "Evidence largely corroborates the core assertion across {} independent reporting cluster(s).",
    "MIXED / UNCERTAIN": "The retrieved evidence is mixed, with independent sources supporting and contradicting different aspects of the claim.",
    "WEAKLY SUPPORTED": "Limited corroborating evidence was found, accompanied by material unverified aspects or contrary accounts.",
    "STRONGLY CONTRADICTED": "Relevant independent evidence contains substantial contradictions to the material claim.",
}
TOO_LITTLE = "There is not enough independent evidence in the retrieved material to produce a reliable credibility assessment ({} independent source cluster(s) found; minimum threshold is 2)."
ALL_BELOW = "All extracted factual assertions fell below the minimum independent corroboration threshold to form a reliable credibility assessment."
CAVEAT = "This assessment represents evidence strength and consistency at the time of retrieval, and should not be interpreted as an ontological probability of truth."
TOTALS = ("items", "supporting", "contradicting", "neutral", "insufficient", "fact_checks")


def capped(evidence: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """The first ``most`` items of each claim, in the order of their ids, as retrieval keeps them."""
    by = Window.partitionBy("claim_id").orderBy("evidence_id")
    return evidence.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= most).drop("_n")


def filled(text: str, value: Column) -> Column:
    before, _, after = text.partition("{}")
    return F.concat(F.lit(before), value.cast("string"), F.lit(after)) if after or "{}" in text else F.lit(text)


def claim_summary() -> Column:
    """Of classification, score, sources, fact_checks and discrepancies."""
    first = F.coalesce(*[F.when(F.col("classification") == k, filled(t, F.col("sources"))) for k, t in CLAIM_TEXTS.items()])
    checks = F.when(F.col("fact_checks") > 0, filled("{} verified fact-check review(s) were analyzed.", F.col("fact_checks")))
    conflicts = F.when(F.col("discrepancies") > 0, filled("{} factual discrepancy(ies) were identified against reporting.", F.col("discrepancies")))
    return F.when(F.col("score").isNull(), filled(TOO_LITTLE, F.col("sources"))).otherwise(F.concat_ws(" ", first, checks, conflicts))


def executive_summary() -> Column:
    """Of claims (an array with score and classification), score and classification of the document."""
    count = lambda *kinds: F.size(F.filter("claims", lambda c: c["score"].isNotNull() & c["classification"].isin(*kinds)))
    none = F.size(F.filter("claims", lambda c: c["score"].isNull()))
    told = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {text}")))
    parts = F.concat_ws(", ", told(count("STRONGLY SUPPORTED", "MOSTLY SUPPORTED"), "supported by independent evidence"), told(count("STRONGLY CONTRADICTED", "WEAKLY SUPPORTED"), "contradicted or contested"),
                        told(count("MIXED / UNCERTAIN"), "with mixed evidence"), told(none, "with insufficient corroboration"))
    overall = F.when(F.col("score").isNotNull(), F.concat(F.lit("The overall document credibility is evaluated as '"), "classification", F.lit("' ("), F.col("score").cast("string"), F.lit("/100).")))
    overall = F.coalesce(overall, F.concat(F.lit("Overall document assessment is '"), "classification", F.lit("'.")))
    analysis = F.concat_ws(" ", F.concat(F.lit("Analysis indicates: "), parts, F.lit(".")), overall)
    return F.concat_ws(" ", filled("The submitted content contains {} material factual claim(s).", F.size("claims")), F.when(none < F.size("claims"), analysis).otherwise(ALL_BELOW), F.lit(CAVEAT))


def reports(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """A row for each doc of ``claims`` (claim_id, doc, place, claim_text, importance): score, classification, executive_summary, the totals
    of its evidence and its claims, nested with their cards by stance.

    Three levels of groups, of units, claims and documents, over one pass of ``evidence``, of which a claim keeps its first
    ``MOST_ITEMS`` items; a claim without evidence is insufficient. Claims go HIGH, MEDIUM, LOW, then by place."""
    card = F.struct((-F.coalesce("relevance", F.lit(0.0))).alias("less_relevant"), "evidence_id", "stance", "category", "domain", "reliability")
    figures = R.claim_figures(capped(evidence), card)
    counts = [*TOTALS, "sources", "discrepancies", "independent", "independent_contradicting"]
    rows = claims.join(figures, "claim_id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in counts} | {"penalty": F.coalesce("penalty", F.lit(0.0))})
    rows = C.scored(rows).withColumn("summary", claim_summary())
    of = lambda s: F.filter(F.coalesce("cards", F.expr("array()").cast(dict(rows.dtypes)["cards"])), lambda c: c["stance"] == s)
    order = F.when(F.col("importance") == "HIGH", 0).when(F.col("importance") == "LOW", 2).otherwise(1)
    claim = F.struct(order.alias("tier"), "place", "claim_id", "claim_text", "importance", "score", "classification", "summary", "parts", "penalty", *counts,
                     *[of(s).alias(f"{s.lower()}_evidence") for s in ("SUPPORTING", "CONTRADICTING", "NEUTRAL", "INSUFFICIENT")])
    weight = F.when(F.col("score").isNotNull(), F.element_at(F.create_map(*[F.lit(x) for kv in C.IMPORTANCE.items() for x in kv]), F.col("importance")))
    docs = rows.withColumn("weight", weight).groupBy("doc").agg(
        F.array_sort(F.collect_list(claim)).alias("claims"), (F.sum(F.col("weight") * F.col("score")) / F.sum("weight")).alias("mean"), *[F.sum(c).alias(c) for c in (*TOTALS, "sources")])
    docs = docs.withColumn("score", F.bround(F.round("mean", 6)).cast("int")).withColumn("classification", C.classification(F.col("score"))).drop("mean")
    return docs.withColumn("executive_summary", executive_summary())


def totals(evidence: DataFrame) -> DataFrame:
    """(doc, claim_id, level, the totals and sources): claims, their documents and, with both null, all of them, by one rollup of the claims'
    independent units."""
    stance = lambda s: F.count_if(F.col("stance") == s)
    per = {"items": F.count("*"), "supporting": stance("SUPPORTING"), "contradicting": stance("CONTRADICTING"), "neutral": stance("NEUTRAL"), "insufficient": stance("INSUFFICIENT"), "fact_checks": F.count("fact_checker")}
    units = R.units(evidence, F.first("doc").alias("doc"), *[v.alias(k) for k, v in per.items()])
    level = F.when(F.grouping_id() == 0, "claim").when(F.grouping_id() == 1, "document").otherwise("all")
    return units.rollup("doc", "claim_id").agg(level.alias("level"), *[F.sum(c).alias(c) for c in TOTALS], F.count("*").alias("sources"))
