"""Claims: candidate sentences, type, importance, similarity, search queries and their routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import lexicon as W
from claimloom.functions import text as T

#: Openings, opinions, boilerplate and the words behind claim types (fixed values).
GREETING = r"(?i)^(hello|hi|good morning|good evening|welcome back|greetings)[.,! ]"
BOILERPLATE = (
    r"(?i)click here to subscribe|sign up for (our|the) newsletter|read more|follow us on (twitter|facebook|instagram|linkedin|telegram)|copyright [0-9]{4}"
    r"|all rights reserved|advertisement|sponsored content|terms of service|privacy policy|share this article|leave a comment"
)
OPINIONS = (
    "in my opinion", "i think", "i feel", "i believe", "we believe", "experts believe this could", "could change everything", "is this the beginning",
    "many people say", "some may argue", "to be honest", "needless to say", "in my view", "personally speaking", "pure speculation",
)
RHETORICAL = r"(?i)^(could|is|are|will|can|should|what if|why|how)\s+.*\?"
FINANCIAL = ("repo rate", "inflation", "gdp", "profit", "revenue", "loss", "budget", "tax", "emi", "inr", "usd", "$", "₹")
STATISTIC = ("percent", "%", "crore", "lakh", "billion", "million")
POLICY = ("approved", "bill", "law", "policy", "cabinet", "ban", "guidelines", "decree", "rule")
ANNOUNCEMENT = ("announced", "unveiled", "launched", "introduced", "scheduled")
SCIENTIFIC = ("study", "research", "scientists", "vaccine", "clinical", "discovery", "published")
EVENT = ("struck", "earthquake", "crash", "flood", "fire", "killed")
ROUTES = {
    "FACT_CHECK": ("factcheck", "web"), "OFFICIAL": ("official", "news"), "NUMERIC": ("news", "web"), "DATE_FOCUSED": ("news", "web"),
    "DIRECT": ("news", "web", "factcheck"), "ENTITY_FOCUSED": ("news", "web", "factcheck"),
}


def any_of(text: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in parts])


def is_candidate(text: Column, verbs: list[str] | None = None) -> Column:
    """Sentences worth a claim: long enough, no question, greeting, boilerplate or short opinion; of
    three words only with one of ``verbs`` (words of events and auxiliaries by default)."""
    s = F.trim(text)
    low, n = F.lower(s), F.size(F.split(s, r"\s+"))
    opinion = reduce(lambda a, b: a | b, [low.startswith(o) | F.contains(low, F.lit(f" {o} ")) for o in OPINIONS])
    plain = ~s.endswith("?") & ~s.rlike(RHETORICAL) & ~s.rlike(GREETING) & ~s.rlike(BOILERPLATE)
    return (F.length(s) >= 8) & (n >= 3) & plain & ~(opinion & (n < 12)) & ((n >= 4) | W.has_word(s, verbs or W.event_words() + W.AUXILIARIES))


def claim_type(text: Column, attributed: Column, numbers: Column, persons: Column, organizations: Column, dated: Column) -> Column:
    """``dated``: the claim has dates or locations."""
    low = F.lower(text)
    return (F.when(attributed, "QUOTE").when(any_of(low, FINANCIAL), "FINANCIAL").when(numbers | any_of(low, STATISTIC), "STATISTIC").when(any_of(low, POLICY), "POLICY")
            .when(any_of(low, ANNOUNCEMENT), "ANNOUNCEMENT").when(any_of(low, SCIENTIFIC), "SCIENTIFIC").when(persons, "PERSON_ACTION").when(organizations, "ORGANIZATION_ACTION")
            .when(dated | any_of(low, EVENT), "EVENT").otherwise("OTHER"))


def importance(headline: Column, sentence: Column, numbers: Column, actors: Column, dates: Column, kind: Column) -> Column:
    points = (F.when(sentence <= 2, 2).otherwise(0) + numbers.cast("int") + actors.cast("int") + dates.cast("int")
              + kind.isin("POLICY", "EVENT", "ANNOUNCEMENT", "FINANCIAL").cast("int"))
    return F.when(headline | (sentence == 0) | (points >= 4), "HIGH").when(points >= 2, "MEDIUM").otherwise("LOW")


def long_words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{3,}"), F.lit(0)))


def claim_similarity(a: Column, b: Column) -> Column:
    return T.jaccard(long_words(a), long_words(b))


MOST_QUERIES = 5


def search_queries(claims: DataFrame, key: str) -> DataFrame:
    """(key, query_type, query): up to five different queries of two words or more for each claim, by kind.

    ``claims`` has text, speaker and the arrays organizations, persons, locations, numbers and dates."""
    words, first = T.keywords(F.col("text"), 7), lambda c, n: F.slice(c, 1, n)
    speaker = F.when(F.col("speaker").isNotNull(), F.array("speaker")).otherwise(F.array().cast("array<string>"))
    named = claims.withColumn("_words", words).withColumn("_named", F.concat(speaker, first("organizations", 2), first("persons", 2), first("locations", 2)))
    named = named.withColumn("_topic", first(F.filter("_words", lambda w: ~F.array_contains("_named", w)), 3)).withColumn("_anchor", F.coalesce(F.get("organizations", F.lit(0)), F.get("persons", F.lit(0))))
    pair, some = first("_named", 2), lambda c: F.size(c) > 0
    check = F.concat(pair, F.col("_topic"))
    parts = {
        "DIRECT": F.when(some("_words"), F.col("_words")),
        "ENTITY_FOCUSED": F.when(some("_named"), F.concat("_named", "_topic")),
        "NUMERIC": F.when(some("numbers"), F.concat(first("numbers", 2), pair, first("_topic", 2))),
        "DATE_FOCUSED": F.when(some("dates"), F.concat(pair, first("_topic", 2), first("dates", 1))),
        "FACT_CHECK": F.when(some(check) | some("_words"), F.concat(F.when(some(check), check).otherwise(first("_words", 4)), F.array(F.lit("fact check")))),
        "OFFICIAL": F.when(F.col("_anchor").isNotNull(), F.concat(F.array("_anchor", F.lit("official statement")), first("_topic", 2))),
    }
    clean = lambda p: F.trim(F.regexp_replace(F.array_join(p, " "), r"\s+", " "))
    made = F.filter(F.array_compact(F.array(*[F.when(p.isNotNull(), F.struct(F.lit(k).alias("query_type"), clean(p).alias("query"))) for k, p in parts.items()])), lambda x: F.contains(x["query"], F.lit(" ")))
    named = named.withColumn("_made", made)
    kept = first(F.filter("_made", lambda x, i: ~F.exists(F.slice("_made", 1, i), lambda y: F.lower(y["query"]) == F.lower(x["query"]))), MOST_QUERIES)
    plain = F.struct(F.lit("DIRECT").alias("query_type"), clean(first(F.split(F.trim("text"), r"\s+"), 8)).alias("query"))
    some_made = F.when(F.size("_kept") > 0, F.col("_kept")).otherwise(F.filter(F.array(plain), lambda x: F.contains(x["query"], F.lit(" "))))
    return named.withColumn("_kept", kept).select(key, F.inline(some_made))


def routed_queries(claims: DataFrame, key: str) -> DataFrame:
    """The queries of claims, a row for each provider, with cache keys."""
    routes = F.create_map(*[x for k, v in ROUTES.items() for x in (F.lit(k), F.array(*[F.lit(p) for p in v]))])
    out = search_queries(claims, key).withColumn("provider", F.explode(F.element_at(routes, F.col("query_type"))))
    return out.withColumn("cache_key", F.concat("provider", F.lit("::"), F.lower(F.trim("query"))))
