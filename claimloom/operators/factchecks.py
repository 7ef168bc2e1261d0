"""Fact-checks: which evidence is one, its rating, what it reviewed, and whether that is the claim at hand."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import aspects as A
from claimloom.operators import evidence as E

#: Providers, metadata keys, outlets and patterns of reviews (fixed values).
PROVIDERS = ("factcheck_api", "google_factcheck")
MARKS = ("verdict", "claim_reviewed", "rating")
OUTLETS = ("politifact", "snopes", "factcheck", "boomlive", "altnews", "fullfact", "afp fact check", "lead stories")
RATING_KEYS = ("rating", "verdict", "textual_rating", "rating_label")
REVIEWED_KEYS = ("claim_reviewed", "reviewed_claim", "claim_text", "reviewed_text")
RATING = r"(?i)Rating:\s*([^.\n]+)"
REVIEWED = (r"(?is)Claim reviewed:\s*['\"](.+?)['\"]", r"(?is)Claim:\s*(.+?)(?:\.?\s*Rating:|$)")
HOAX = r"(?i)\b(fak(?:e|ed|ing)|stag(?:ed|es|ing)|hoax(?:es)?|fabricat(?:e|ed|ion)|doctored|morphed|not\s+real|never\s+happened|did\s+not\s+happen)\b"
MEDIA = "(?:photo|photos|image|images|video|videos|picture|pictures|footage|clip|clips|visual|visuals)"
MEDIA_DEBUNK = (
    rf"(?i)\b(?:recent|old|unrelated|viral|recycled|falsely\s+shared|misattributed|out\s+of\s+context)\s+{MEDIA}\b|\b{MEDIA}\s+(?:show|shows|showing|shared\s+as|claimed\s+to\s+show|from|of|in)\b"
    r"|\b(?:falsely\s+shared|misleading\s+video|misleading\s+photo|misleading\s+image|fake\s+photo|fake\s+image|fake\s+video)\b"
)
#: Overlaps and coverages of the gates, and the scores of what doesn't pass them (fixed values).
OVERLAP, COVERAGE, VERBATIM, ABSENT_SCORE, VETO_SCORE = 0.15, 0.5, 0.60, 0.15, 0.10
CONFIDENCE, RELEVANCE = 0.92, 0.95


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def filled(text: Column) -> Column:
    """Stripped, null if nothing is left."""
    return F.nullif(stripped(text), F.lit(""))


def is_fact_check() -> Column:
    """By source_type, provider, keys of metadata, or an outlet's name in domain or publisher."""
    has = lambda c: reduce(lambda a, b: a | b, [F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(o)) for o in OUTLETS])
    keys = F.coalesce(F.arrays_overlap(F.map_keys("metadata"), F.array(*[F.lit(m) for m in MARKS])), F.lit(False))
    named = F.coalesce(F.col("source_type") == "FACT_CHECK", F.lit(False)) | F.coalesce(F.col("provider").isin(*PROVIDERS), F.lit(False))
    return named | keys | has("domain") | has("publisher")


def raw_rating() -> Column:
    """Of metadata, else of the snippet, else Unknown."""
    said = F.when(F.col("snippet").rlike(RATING), stripped(F.regexp_extract("snippet", RATING, 1)))
    return F.coalesce(*[filled(F.element_at("metadata", k)) for k in RATING_KEYS], said, F.lit("Unknown"))


def reviewed_text() -> Column:
    """The assertion that was reviewed, of metadata or, by two patterns, of snippet, title and content; else null."""
    found = [filled(F.regexp_extract(c, p, 1)) for c in ("snippet", "title", "content") for p in REVIEWED]
    return F.coalesce(*[filled(F.element_at("metadata", k)) for k in REVIEWED_KEYS], *[F.regexp_replace(x, r"\.+$", "") for x in found])


def digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[^0-9]", "")


def names_it(term: Column, reviewed: Column) -> Column:
    """A date or number is in a text as it stands or, with two digits or more, by its digits among the text's."""
    d = digits(term)
    return F.contains(F.lower(reviewed), F.lower(term)) | ((F.length(d) >= 2) & F.contains(digits(reviewed), d))


def alignment(reviewed: Column) -> Column:
    """(score, aligned, gate): whether a review's assertion is the claim, of the columns claim, persons, organizations,
    locations, entities, dates and numbers.

    The gates in order: dates and numbers absent, a hoax variant, a debunked picture, then overlap and coverage. The veto by different
    predicates needs a tagger; without one it isn't applied."""
    low = F.lower(reviewed)
    figures = F.filter(F.transform(F.concat("dates", "numbers"), stripped), lambda x: x != "")
    terms = F.array_distinct(F.filter(F.concat("persons", "organizations", "locations", F.transform("entities", lambda e: e["text"])), lambda t: F.length(t) > 2))
    overlap = T.jaccard(T.words(F.col("claim"), False), T.words(reviewed, False))
    absent = (F.size(figures) > 0) & ~F.exists(figures, lambda d: names_it(d, reviewed))
    hoax = reviewed.rlike(HOAX) & (F.exists(terms, lambda t: F.contains(low, F.lower(t))) | (overlap >= OVERLAP))
    media = ~F.col("claim").rlike(rf"(?i)\b{MEDIA}\b") & reviewed.rlike(MEDIA_DEBUNK)
    wanted = F.array_distinct(F.concat(terms, figures))
    hits = F.size(F.filter(wanted, lambda t: F.contains(low, F.lower(t)) | (F.array_contains(figures, t) & names_it(t, reviewed))))
    coverage = F.when(F.size(wanted) > 0, hits / F.size(wanted)).otherwise(1.0)
    ok = (overlap >= VERBATIM) | ((overlap >= OVERLAP) & (coverage >= COVERAGE)) | ((coverage >= 0.8) & (overlap >= 0.10) & (F.size(wanted) >= 2))
    gate = F.when(absent, "figures_absent").when(hoax, "hoax_variant").when(media, "media_debunk").otherwise("overlap")
    score = F.when(absent, ABSENT_SCORE).when(hoax | media, VETO_SCORE).otherwise(F.round(0.5 * overlap + 0.5 * coverage, 2))
    return F.struct(score.alias("score"), (~absent & ~hoax & ~media & ok).alias("aligned"), gate.alias("gate"))


def compare(pairs: DataFrame) -> DataFrame:
    """Stance, confidence and relevance of each pair of claim and evidence, with how they were found.

    ``pairs`` has the claim's columns as ``judge`` takes them and title, snippet, content, source_type, provider, domain, publisher and
    metadata of the evidence. A fact-check whose reviewed assertion is the claim gives its rating; one that reviewed another is neutral; one
    that doesn't say what it reviewed, and all other evidence, is judged by its text."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(". "), F.coalesce("snippet", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))
    rows = A.judge(pairs.withColumn("evidence", F.trim(text)))
    rows = rows.withColumn("fact_check", is_fact_check()).withColumn("reviewed", F.when(F.col("fact_check"), reviewed_text())).withColumn("rating", F.when(F.col("fact_check"), raw_rating()))
    rows = E.rate(rows.withColumnRenamed("stance", "text_stance")).withColumnRenamed("stance", "rated")
    rows = rows.withColumn("alignment", F.when(F.col("reviewed").isNotNull(), alignment(F.col("reviewed"))))
    by_text, aligned, score = F.col("reviewed").isNull(), F.col("alignment.aligned"), F.col("alignment.score")
    rows = rows.withColumn("stance", F.when(by_text, F.col("text_stance")).when(aligned, F.col("rated")).otherwise("NEUTRAL"))
    rows = rows.withColumn("confidence", F.when(by_text, F.col("confidence")).when(aligned, CONFIDENCE).otherwise(F.round(0.55 + 0.25 * score, 2)))
    rows = rows.withColumn("relevance", F.when(by_text, F.round("relevance", 2)).when(aligned, RELEVANCE).otherwise(F.round(0.25 + 0.5 * score, 2)))
    method = F.when(~F.col("fact_check"), "text").when(by_text, "review_text").when(aligned, "rating").otherwise("mismatch")
    return rows.withColumn("method", method).withColumn("verdict", F.when(F.col("fact_check"), F.col("verdict"))).drop("text_stance", "rated")
