"""From evidence rows to penalties, score figures, clusters' representatives, cards, summaries and citations.

Evidence rows have claim_id, evidence_id, cluster, stance, relevance, reliability, category, source_type, domain, primary,
meta_score, transparency, n_chars, published_at, fact_checker and a discrepancy's kind, aspect, severity and value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators import scoring as C
from claimloom.operators import sources as S

#: Categories, bonuses and penalties (fixed values).
OFFICIAL_CATEGORIES = ("GOVERNMENT", "REGULATORY", "INTERNATIONAL_ORGANIZATION", "ACADEMIC")
OFFICIAL_TYPES = ("OFFICIAL", "PRIMARY_DOCUMENT")
WIRE_DOMAINS = ("reuters.com", "apnews.com", "afp.com")
REPUTABLE, LOW_META, LOW_RELIABILITY = 75, 0.40, 40
LEVELS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.3}


def origin_score() -> Column:
    """How likely an item is the origin of its cluster."""
    category = F.col("category")
    origin = F.when(category.isin("GOVERNMENT", "REGULATORY"), 50.0).when(category == "FACT_CHECKER", 40.0).when(F.col("domain").isin(*WIRE_DOMAINS), 45.0).otherwise(0.0)
    score = (origin + F.when(F.col("primary"), 20.0).otherwise(0.0) + F.col("meta_score") * 10.0 + F.least(F.coalesce("n_chars", F.lit(0)) / 100.0, F.lit(15.0))
             + F.when(F.coalesce("published_at", F.lit("")) != "", 10.0).otherwise(0.0))
    return F.round(score, 6)


def representatives(evidence: DataFrame) -> DataFrame:
    """(claim_id, cluster, representative, size): the item of a cluster with the highest origin score, the first of equal ones.
    Ids may be of any type with an order."""
    best = F.min(F.struct((-origin_score()).alias("score"), F.col("evidence_id").alias("id")))
    return evidence.groupBy("claim_id", "cluster").agg(best["id"].alias("representative"), F.count("*").alias("size"))


def item_status(evidence: DataFrame) -> DataFrame:
    """Each item's independence: alone or the representative of its cluster, or derived from it."""
    got = evidence.select("claim_id", "cluster", "evidence_id").join(representatives(evidence), ["claim_id", "cluster"])
    own = F.col("evidence_id") == F.col("representative")
    return got.select("claim_id", "cluster", "evidence_id", F.when(own, "LIKELY_INDEPENDENT").otherwise("LIKELY_DERIVED").alias("status"),
                      F.when(F.col("size") == 1, 0.9).when(own, 0.8).otherwise(0.85).alias("confidence"), (F.col("size") - 1).alias("related"))


def duplicate_clusters(evidence: DataFrame) -> DataFrame:
    """Clusters of more than one item: the origin and the others, in order."""
    met = evidence.select("claim_id", "cluster", "evidence_id").join(representatives(evidence).where("size > 1"), ["claim_id", "cluster"])
    others = F.array_sort(F.collect_list(F.when(F.col("evidence_id") != F.col("representative"), F.col("evidence_id"))))
    return met.groupBy("claim_id", "cluster", "representative", "size").agg(others.alias("others"))


def units(evidence: DataFrame, *also: Column) -> DataFrame:
    """A row for each independent unit of a claim, a cluster or an item of none, with ``also`` aggregated: its stance is its
    representative's or, where that has none, the most frequent of its items (of equally frequent ones the first by name)."""
    unit = F.struct("cluster", F.when(F.col("cluster").isNull(), F.col("evidence_id")).alias("item"))
    best = F.min(F.struct((-origin_score()).alias("score"), F.col("evidence_id").alias("id"), F.col("stance").alias("stance")))
    mode = F.mode("stance", True)
    return evidence.withColumn("unit", unit).groupBy("claim_id", "unit").agg(F.coalesce(best["stance"], mode).alias("unit_stance"), *also)


def cluster_consensus(evidence: DataFrame) -> DataFrame:
    """Stance counts of items and of their independent units, agreement and a summary, of the items with a stance: one pass
    over the evidence, clusters being a first level of groups."""
    told = F.col("stance").isNotNull()
    per = units(evidence, F.count_if(F.col("stance") == "SUPPORTING").alias("supporting"), F.count_if(told).alias("items"), F.count(F.when(told, F.col("fact_checker"))).alias("fact_checks"))
    total = lambda c: F.sum(c).alias(c)
    out = per.groupBy("claim_id").agg(total("supporting"), total("items"), total("fact_checks"), F.count_if(F.col("unit_stance") == "SUPPORTING").alias("independent_supporting"),
                                      F.count_if(F.col("unit_stance") == "CONTRADICTING").alias("independent_contradicting"))
    s, c = F.col("independent_supporting"), F.col("independent_contradicting")
    out = out.withColumn("agreement_ratio", F.when(s + c > 0, F.round(s / (s + c), 3)).otherwise(0.0))
    share = F.bround(F.round(F.col("agreement_ratio") * 100, 6)).cast("int")
    text = (F.when((s > 0) & (c == 0), F.concat(s, F.lit(" independent source(s) corroborate the claim ("), "supporting", F.lit(" total article(s)).")))
            .when(s > 0, F.concat(F.lit("Conflicting reporting: "), s, F.lit(" independent source(s) support, while "), c, F.lit(" contradict ("), share, F.lit("% agreement).")))
            .when(c > 0, F.concat(c, F.lit(" independent source(s) contradict the claim.")))
            .otherwise(F.concat(F.lit("No conclusive supporting or contradicting evidence found across "), "items", F.lit(" retrieved item(s)."))))
    return out.withColumn("summary", text)


def key_discrepancies(evidence: DataFrame) -> DataFrame:
    """Distinct discrepancies of a claim by kind, aspect and lower-cased value, the first of each, in order."""
    by = Window.partitionBy("claim_id", "kind", "aspect", F.lower("value")).orderBy("evidence_id")
    return evidence.where("kind is not null").withColumn("_n", F.row_number().over(by)).where("_n = 1").select("claim_id", "evidence_id", "kind", "aspect", "severity", "value")


def penalties(evidence: DataFrame) -> DataFrame:
    """(claim_id, place, penalty_type, detail, amount): of discrepancies, then refutations, then anonymous sources."""
    first = Window.partitionBy("claim_id", "kind", "aspect").orderBy("evidence_id")
    d = key_discrepancies(evidence).withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "claim_id", F.lit(1).alias("place"), F.concat(F.lower("kind"), F.lit("_discrepancy")).alias("penalty_type"), F.col("aspect").alias("detail"), C.penalty_points(F.upper(F.coalesce("severity", F.lit("MAJOR")))).alias("amount"))
    against = evidence.where(F.col("stance") == "CONTRADICTING")
    checked = against.where("fact_checker is not null").select("claim_id", "fact_checker").distinct()
    r = checked.select("claim_id", F.lit(2).alias("place"), F.lit("fact_check_refutation").alias("penalty_type"), F.col("fact_checker").alias("detail"), F.lit(C.REFUTATION).alias("amount"))
    strong = against.where((F.col("reliability") >= REPUTABLE) | F.col("category").isin(*OFFICIAL_CATEGORIES)).groupBy("claim_id").agg(F.count("*").alias("n"))
    s = strong.join(checked.select("claim_id"), "claim_id", "left_anti").select(
        "claim_id", F.lit(2).alias("place"), F.lit("reputable_source_refutation").alias("penalty_type"), F.col("n").cast("string").alias("detail"), F.lit(C.REFUTATION).alias("amount"))
    low = F.when(F.col("meta_score") > 0, F.col("meta_score") < LOW_META).otherwise(F.col("transparency") == "LOW")
    a = evidence.where(F.col("stance") == "SUPPORTING").groupBy("claim_id").agg(F.every(low).alias("dim"), F.every(F.col("reliability") < LOW_RELIABILITY).alias("weak"), F.count("*").alias("n")).where("dim or weak")
    a = a.select("claim_id", F.lit(3).alias("place"), F.lit("anonymous_unindexed_sources").alias("penalty_type"), F.col("n").cast("string").alias("detail"), F.lit(C.ANONYMOUS).alias("amount"))
    return d.unionByName(r).unionByName(s).unionByName(a)


def claim_figures(evidence: DataFrame, card: Column | None = None) -> DataFrame:
    """What the score components and the penalties of a claim are made of: one pass over its evidence, with the independent
    units as a first level of groups. A unit's discrepancies go on as a list, at most one entry for each of its items, and so do
    the values of ``card``, as cards, in their order."""
    up, down = F.col("stance") == "SUPPORTING", F.col("stance") == "CONTRADICTING"
    official = F.col("category").isin(*OFFICIAL_CATEGORIES)
    check = F.when(F.col("fact_checker").isNotNull(), F.when(up, 1.0).when(down, 0.0).otherwise(0.5))
    shown = F.when(F.col("meta_score") > 0, F.col("meta_score")).otherwise(S.mapped(F.col("transparency"), LEVELS, 0.5))
    low = F.when(F.col("meta_score") > 0, F.col("meta_score") < LOW_META).otherwise(F.col("transparency") == "LOW")
    means = {"support_reliability": F.when(up, F.col("reliability")), "mean_reliability": F.col("reliability"), "fact_check_mean": check, "transparency_mean": shown}
    sums = [x for k, v in means.items() for x in (F.sum(v).alias(f"{k}_sum"), F.count(v).alias(f"{k}_n"))]
    counts = {"supporting": up, "contradicting": down, "neutral": F.col("stance") == "NEUTRAL", "strong": down & ((F.col("reliability") >= REPUTABLE) | official)}
    flags = {"official": F.bool_or(up & (F.col("source_type").isin(*OFFICIAL_TYPES) | official)), "primary_support": F.bool_or(up & F.col("primary")),
             "dim": F.every(F.when(up, low)), "weak": F.every(F.when(up, F.col("reliability") < LOW_RELIABILITY))}
    points = C.penalty_points(F.upper(F.coalesce("severity", F.lit("MAJOR"))))
    value = F.lower("value") if "value" in evidence.columns else F.lit("")
    found = F.when(F.col("kind").isNotNull(), F.struct("kind", "aspect", F.col("evidence_id").alias("id"), points.alias("points"), value.alias("value")))
    counts |= {"insufficient": F.col("stance") == "INSUFFICIENT", "fact_checks": F.col("fact_checker").isNotNull(), "items": F.lit(True)}
    cards = [] if card is None else [F.collect_list(card).alias("cards")]
    per = units(evidence, *cards, *sums, *[F.count_if(v).alias(k) for k, v in counts.items()], *[v.alias(k) for k, v in flags.items()],
                F.collect_list(found).alias("found"), F.collect_set(F.when(down, F.col("fact_checker"))).alias("checkers"))
    whole = per.groupBy("claim_id").agg(
        *[F.sum(k).alias(k) for k in counts], *[(F.sum(f"{k}_sum") / F.nullif(F.sum(f"{k}_n"), F.lit(0))).alias(k) for k in means],
        F.bool_or("official").alias("official"), F.bool_or("primary_support").alias("primary_support"), F.every("dim").alias("dim"), F.every("weak").alias("weak"),
        F.count_if(F.col("unit_stance") == "SUPPORTING").alias("independent"), F.count_if(F.col("unit_stance") == "CONTRADICTING").alias("independent_contradicting"), F.count("*").alias("sources"),
        *[F.array_sort(F.flatten(F.collect_list("cards"))).alias("cards") for _ in cards], F.array_sort(F.flatten(F.collect_list("found"))).alias("found"), F.size(F.array_distinct(F.flatten(F.collect_list("checkers")))).alias("checkers"))
    # sorted by kind, aspect and id: the first of each kind and aspect counts
    first = F.filter("found", lambda x, i: (i == 0) | ~F.struct(x["kind"], x["aspect"]).eqNullSafe(F.struct(F.get("found", i - 1)["kind"], F.get("found", i - 1)["aspect"])))
    whole = whole.withColumn("discrepancies", F.size(F.array_distinct(F.transform("found", lambda x: F.struct(x["kind"], x["aspect"], x["value"])))))
    lost = F.aggregate(first, F.lit(0.0), lambda a, x: a + x["points"])
    refuted = F.when(F.col("checkers") > 0, F.col("checkers") * C.REFUTATION).when(F.col("strong") > 0, C.REFUTATION).otherwise(0.0)
    anonymous = F.when((F.col("supporting") > 0) & (F.coalesce("dim", F.lit(False)) | F.coalesce("weak", F.lit(False))), C.ANONYMOUS).otherwise(0.0)
    return whole.withColumn("penalty", lost + refuted + anonymous).withColumn("transparency_mean", F.round("transparency_mean", 6)).drop("found", "checkers", "dim", "weak", "strong")


def breakdown(components: DataFrame, lost: DataFrame) -> DataFrame:
    """Components and negative penalties of a claim by their absolute contribution; of equal ones components come first."""
    order = {f: k for k, f in enumerate(C.FACTORS)}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in order.items() for x in kv]), F.col("factor"))
    both = components.select("claim_id", "factor", "contribution", place.alias("place"), F.lit("").alias("detail")).unionByName(
        lost.select("claim_id", F.col("penalty_type").alias("factor"), (-F.col("amount")).alias("contribution"), (F.col("place") + len(order)).alias("place"), "detail"))
    by = Window.partitionBy("claim_id").orderBy(F.abs("contribution").desc(), "place", "factor", "detail")
    return both.select("claim_id", "factor", "contribution", "detail", F.row_number().over(by).alias("rank"))


def evidence_cards(evidence: DataFrame) -> DataFrame:
    """Items of a claim by stance, each with its place by relevance and id; other stances count as neutral."""
    known = F.col("stance").isin("SUPPORTING", "CONTRADICTING", "NEUTRAL", "INSUFFICIENT")
    cards = evidence.withColumn("card", F.when(known, F.col("stance")).otherwise("NEUTRAL"))
    by = Window.partitionBy("claim_id", "card").orderBy(F.coalesce("relevance", F.lit(0.0)).desc(), "evidence_id")
    part = F.when(F.col("card").isin("SUPPORTING", "CONTRADICTING"), F.lower("card")).otherwise("neutral")
    return cards.select("claim_id", "evidence_id", "card", part.alias("part"), F.lower("category").alias("category"), F.row_number().over(by).alias("rank"))


def evidence_summary(evidence: DataFrame, pairs: DataFrame) -> DataFrame:
    """Counts of a claim's evidence; ``pairs`` (claim_id, duplicate) are its dependent pairs."""
    n = lambda s: F.count_if(F.col("stance") == s)
    out = evidence.groupBy("claim_id").agg(F.count("*").alias("total"), n("SUPPORTING").alias("supporting"), n("CONTRADICTING").alias("contradicting"), n("NEUTRAL").alias("neutral"),
                                           n("INSUFFICIENT").alias("insufficient"), F.countDistinct("cluster").alias("independent"), F.count("fact_checker").alias("fact_checks"))
    related = pairs.groupBy("claim_id").agg(F.count_if("duplicate").alias("duplicates"), F.count_if(~F.col("duplicate")).alias("syndicated"))
    return out.join(related, "claim_id", "left").fillna(0, ["duplicates", "syndicated"])


def document_summary(summaries: DataFrame, key: str = "doc") -> DataFrame:
    """The counts of a document's claims, summed."""
    return summaries.groupBy(key).agg(*[F.sum(c).alias(c) for c in summaries.columns if c not in (key, "claim_id")])


def report_order(claims: DataFrame) -> DataFrame:
    """Claims of a document by importance, then as they were extracted."""
    tier = F.when(F.col("importance") == "HIGH", 0).when(F.col("importance") == "LOW", 2).otherwise(1)
    return claims.withColumn("place", F.row_number().over(Window.partitionBy("doc").orderBy(tier, "claim_id")))


def citations(given: DataFrame, pool: DataFrame) -> DataFrame:
    """Of (evidence_id, url, ord) the first of each evidence_id whose url is one of the ``pool``'s, in either case."""
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    urls = pool.where("url is not null and url != ''").select(clean(F.col("url")).alias("_url")).distinct()
    kept = given.withColumn("_url", clean(F.col("url"))).join(urls, "_url", "left_semi")
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy("evidence_id").orderBy("ord"))).where("_n = 1").drop("_n", "_url")


#: Gaps that the absence of evidence adds (fixed values).
NO_EVIDENCE = "No relevant external evidence could be retrieved for this claim; no independent assessment was possible."
NO_SUPPORT = "No supporting evidence was retrieved for this claim in the searched sources; no independent source corroborates the assertion."


def with_absence_gaps(gaps: Column, total: Column, supporting: Column) -> Column:
    """``gaps`` and, where it lacks one, the gap that no evidence or no support leaves. Twice is as good as once."""
    says = lambda words: F.exists(gaps, lambda g: F.contains(F.lower(g), F.lit(words)))
    more = F.when((total == 0) & ~says("no relevant external evidence"), NO_EVIDENCE).when((total > 0) & (supporting == 0) & ~says("no supporting evidence"), NO_SUPPORT)
    return F.when(more.isNotNull(), F.concat(gaps, F.array(more))).otherwise(gaps)


def typed_gaps(gaps: Column) -> Column:
    return F.transform(gaps, lambda g: F.struct(F.lit("evidence_gap").alias("gap_type"), g.alias("description")))
