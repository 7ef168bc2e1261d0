"""Verification: publication age, wire agencies, month discrepancies, stance, clusters, evidence packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Agencies by their mentions, and month names (fixed values).
WIRES = {
    "AFP": "afp|agence france-presse", "ANI": "ani|asian news international", "Associated Press": "associated press|ap", "Bloomberg": "bloomberg",
    "News Wire Agency": "wire reports?|agency reports?", "PTI": "pti|press trust of india", "Reuters": "reuters",
}
MONTHS = (
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec"
).split()
PACKET_ITEMS, PACKET_CHARS, ITEM_CHARS, PACKET_FACT_CHECKS = 10, 10_000, 1_200, 5


def age_days(raw: Column, as_of: int) -> Column:
    """Whole days before ``as_of`` (epoch seconds), not under 0; null where ``raw`` is no date."""
    s = F.trim(raw)
    compact = F.regexp_replace(F.regexp_replace(s, "Z$", ""), r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2}))?$", "$1-$2-$3T$4:$5:$6")
    full = F.when(s.rlike(r"^\d{8}$"), F.concat(F.substring(compact, 1, 10), F.lit("T00:00:00Z"))).when(s.rlike(r"^\d{8}T\d{6}Z?$"), F.concat(compact, F.lit("Z")))
    dashed = s.rlike(r"^\d{4}-\d{2}-\d{2}")
    zoned = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(s, F.lit("T00:00:00Z"))).when(s.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), s).otherwise(F.concat(s, F.lit("Z")))
    day = F.concat(F.substring(s, 1, 10), F.lit("T00:00:00Z"))
    at = F.coalesce(F.try_to_timestamp(full), F.when(dashed, F.coalesce(F.try_to_timestamp(zoned), F.try_to_timestamp(day))))
    return F.greatest(F.floor((F.lit(as_of) - F.unix_seconds(at)) / 86400), F.when(at.isNotNull(), F.lit(0)))


def age_label(days: Column) -> Column:
    return F.when(days.isNull(), "UNKNOWN").when(days <= 30, "VERY_RECENT").when(days <= 365, "RECENT").otherwise("OLDER")


def wire_agencies(text: Column) -> Column:
    """Names of the agencies that a text mentions, sorted."""
    return F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b({p})\b"), F.lit(k)) for k, p in WIRES.items()]))


def month_conflict(claim_dates: Column, evidence: Column) -> Column:
    """First month only the evidence names, where it names none of the claim's; else null."""
    def named(text: Column) -> Column:
        return F.filter(F.array(*[F.lit(m) for m in MONTHS]), lambda m: F.contains(F.lower(text), m))

    claimed, found = named(claim_dates), named(evidence)
    return F.when((F.size(claimed) > 0) & ~F.arrays_overlap(claimed, found), F.get(found, F.lit(0)))


def clusters(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, ord, cluster, cluster_type, confidence, independent): dependent ``pairs`` (claim_id, a < b,
    duplicate) join items. Retrieval keeps at most 20 items of a claim, so a claim's pairs fit in one row."""
    met = pairs.groupBy("claim_id").agg(F.collect_list(F.struct("a", "b", "duplicate")).alias("pairs"))
    items = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_list("ord")).alias("ords")).join(met, "claim_id", "left")
    labels = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<a:bigint,b:bigint,duplicate:boolean>>")), F.map_from_arrays("ords", "ords"), lambda m, p: F.transform_values(
        m, lambda _, v: F.when((v == F.element_at(m, p["a"])) | (v == F.element_at(m, p["b"])), F.least(F.element_at(m, p["a"]), F.element_at(m, p["b"]))).otherwise(v)))
    got = items.withColumn("label", labels).withColumn("independent", F.size(F.array_distinct(F.map_values("label"))))
    rows = got.select("claim_id", "pairs", "label", "independent", F.explode("label").alias("ord", "cluster"))
    own = F.filter("pairs", lambda p: F.element_at("label", p["a"]) == F.col("cluster"))
    dup, other = F.exists(own, lambda p: p["duplicate"]), F.exists(own, lambda p: ~p["duplicate"])
    kind = F.when(F.coalesce(F.size(own), F.lit(0)) <= 0, "INDEPENDENT").when(dup & other, "MIXED").when(dup, "DUPLICATE").otherwise("SYNDICATION")
    return rows.select("claim_id", "ord", "cluster", kind.alias("cluster_type"), "independent").withColumn(
        "confidence", F.when(F.col("cluster_type") == "INDEPENDENT", 0.9).when(F.col("cluster_type") == "MIXED", 0.85).when(F.col("cluster_type") == "DUPLICATE", 0.92).otherwise(0.88))


#: What no packet may hold, and what ends a shortened item (fixed values).
TAGS = (r"(?i)</?UNTRUSTED_EXTERNAL_EVIDENCE_PACKET>", r"(?i)<script[\s\S]*?</script>")
CUT = " ... [truncated]"


def packet_text(text: Column) -> Column:
    """Without tags that could end the packet, at most ITEM_CHARS long."""
    clean = F.coalesce(text, F.lit(""))
    for tag in TAGS:
        clean = F.regexp_replace(clean, tag, "")
    short = F.concat(F.regexp_replace(F.substring(clean, 1, ITEM_CHARS - len(CUT)), r"\s+$", ""), F.lit(CUT))
    return F.when(F.length(clean) > ITEM_CHARS, short).otherwise(F.regexp_replace(clean, r"^\s+|\s+$", ""))


def packet(evidence: DataFrame) -> DataFrame:
    """Items of (claim_id, ord, text, priority figures) that go to reasoning: by priority, bounded in number and length;
    a claim's fact-checks beyond the fifth leave their places to other items, and the first two items always go."""
    priority = (F.when(F.col("fact_check"), 100).when(F.col("primary"), 90).when(F.col("discrepant"), 80).when(F.col("stance").isin("SUPPORTING", "CONTRADICTING"), 70)
                .when(F.col("stance") == "NEUTRAL", 40).otherwise(20))
    by = Window.partitionBy("claim_id").orderBy(F.col("priority").desc(), "ord")
    nth = F.row_number().over(Window.partitionBy("claim_id", "fact_check").orderBy("ord"))
    evidence = evidence.withColumn("_nth", nth).where(~F.coalesce("fact_check", F.lit(False)) | (F.col("_nth") <= PACKET_FACT_CHECKS))
    first = evidence.select("claim_id", "ord", "text", priority.alias("priority")).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= PACKET_ITEMS)
    first = first.withColumn("snippet", packet_text(F.col("text"))).drop("text").withColumn("chars", F.length("snippet").cast("long"))
    total = F.sum("chars").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("total", total).where((F.col("total") <= PACKET_CHARS) | (F.col("rank") <= 2))
