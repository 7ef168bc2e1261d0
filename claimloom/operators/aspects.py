"""Stance from texts: a claim's aspects, which of them evidence bears out, the best sentence to quote, the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.functions import numbers as N
from claimloom.functions import text as T
from claimloom.operators import claims as K
from claimloom.operators import signals as S
from claimloom.operators import verification as V
from claimloom.operators.evidence import beside

#: Actions and the words that bear them out, in order (fixed values).
ACTIONS = {
    "cut": "cut|reduced|lowered|slashed|reduction|decrease",
    "reduce": "reduced|cut|lowered|slashed|reduction|decrease",
    "announce": "announced|unveiled|declared|introduced|rolled out",
    "approve": "approved|cleared|greenlit|sanctioned|okayed|passed",
    "resign": "resigned|resignation|stepped down|quit|vacated",
    "invest": "invested|investment|investing|pledged|committed",
    "ban": "banned|prohibited|outlawed|illegal|prohibition",
    "lose": "lost|loss|losses|deficit|incurred",
    "acquire": "acquired|bought|purchased|takeover|acquisition",
    "launch": "launched|rolled out|introduced|started|unveiled",
    "hire": "hired|recruited|onboarded|appointed|hiring",
    "layoff": "laid off|layoffs|sacked|fired|terminated|job cuts",
    "flood": "flood|floods|flooded|flooding|inundated|inundation|submerged|deluged|deluge|swelled",
    "earthquake": "earthquake|earthquakes|tremor|tremors|quake|quakes|seismic",
    "disaster": "disaster|calamity|catastrophe|crisis",
    "strike": "struck|strikes|striking|hit|hits|hitting|ravaged|swept|affected|affecting|devastated",
    "occur": "occurred|happened|occur|occurs|erupted|broke out",
}
#: Characters of evidence, relevance and common words below which nothing can be told (fixed values).
LEAST_CHARS, LEAST_RELEVANCE, LEAST_COMMON = 40, 0.18, 2


def action(text: Column) -> Column:
    """The first action whose name or words a claim has; null if it has none."""
    return F.coalesce(*[F.when(F.lower(text).rlike(rf"\b({base}|{words})\b"), F.lit(base)) for base, words in ACTIONS.items()])


def bears_out(wanted: Column, text: Column) -> Column:
    """Whether evidence has one of an action's words."""
    return F.coalesce(*[F.when(wanted == base, F.lower(text).rlike(rf"\b({words})\b")) for base, words in ACTIONS.items()], F.lit(False))


def claim_aspects() -> Column:
    """(kind, value) of a claim's persons, organizations, speaker, locations, dates, numbers and action, in this order."""
    each = lambda c, kind: F.transform(c, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    speaker = F.filter(F.array("speaker"), lambda s: s.isNotNull() & ~F.array_contains(F.concat("persons", "organizations"), s))
    act = F.filter(F.array(action(F.col("claim"))), lambda a: a.isNotNull())
    return F.concat(each(F.col("persons"), "WHO"), each(F.col("organizations"), "WHO"), each(speaker, "ATTRIBUTION"), each(F.col("locations"), "WHERE"),
                    each(F.col("dates"), "WHEN"), each(F.col("numbers"), "AMOUNT"), each(act, "ACTION"))


def matched_aspects() -> Column:
    """(kind, value, evidence_value, status) of ``aspects`` in ``evidence``, given its ``denied`` and ``conflicts``."""
    low = F.lower("evidence")

    def match(a: Column) -> Column:
        there, conflict = F.contains(low, F.lower(a["value"])), F.get("conflicts", F.lit(0))["evidence_value"]
        status = (F.when((a["kind"] == "ACTION") & F.col("denied"), "CONTRADICTED").when(a["kind"] == "ACTION", F.when(bears_out(a["value"], F.col("evidence")), "SUPPORTED"))
                  .when((a["kind"] == "AMOUNT") & (F.size("conflicts") > 0), "CONTRADICTED").when(there, "SUPPORTED"))
        found = F.when((a["kind"] == "AMOUNT") & (F.size("conflicts") > 0), conflict).when(status == "SUPPORTED", a["value"])
        return F.struct(a["kind"].alias("kind"), a["value"].alias("value"), found.alias("evidence_value"), F.coalesce(status, F.lit("UNMENTIONED")).alias("status"))

    return F.transform("aspects", match)


def judge(pairs: DataFrame) -> DataFrame:
    """Stance of each pair of claim and evidence text, from the texts alone.

    ``pairs`` has claim (its normal form), evidence, speaker, entities and the arrays persons, organizations, locations,
    dates and numbers; other columns stay. Adds relevance, common, denied, conflicts, late_month, aspects, supported, stance and
    confidence. A denial counts in a sentence that names one of the claim's subjects. Null evidence counts as empty."""
    ws = lambda c: T.words(F.col(c), False)
    rows = pairs.withColumn("evidence", F.coalesce("evidence", F.lit(""))).withColumn("_claim", ws("claim")).withColumn("_found", ws("evidence"))
    rows = rows.withColumn("common", F.size(F.array_intersect("_claim", "_found")))
    share = F.col("common").cast("double") / F.greatest(F.size("_claim"), F.lit(1))
    rows = rows.withColumn("relevance", F.least(F.lit(1.0), T.jaccard(F.col("_claim"), F.col("_found")) * 2.5 + share * 0.5)).drop("_claim", "_found")
    subjects = F.array_distinct(F.filter(F.concat("persons", "organizations", "locations", F.transform("entities", lambda e: e["text"])), lambda t: F.length(t) > 2))
    rows = rows.withColumn("denied", S.denial(F.col("evidence"), subjects).isNotNull())
    rows = rows.withColumn("conflicts", N.numeric_conflicts(N.quantities(F.col("claim")), N.quantities(F.col("evidence"))))
    rows = rows.withColumn("late_month", V.month_conflict(F.array_join("dates", ", "), F.col("evidence")))
    rows = rows.withColumn("aspects", claim_aspects()).withColumn("aspects", matched_aspects())
    count = lambda f: F.size(F.filter("aspects", f))
    rows = rows.withColumn("supported", count(lambda a: a["status"] == "SUPPORTED"))
    acts, borne = count(lambda a: a["kind"] == "ACTION") > 0, count(lambda a: (a["kind"] == "ACTION") & (a["status"] == "SUPPORTED")) > 0
    weak = (F.col("relevance") < LEAST_RELEVANCE) | (F.length("evidence") < LEAST_CHARS) | (F.col("common") < LEAST_COMMON)
    open_ = (acts & ~borne) | ((F.col("supported") < 2) & ~borne)
    stance = F.when(F.col("denied") | (F.size("conflicts") > 0), "CONTRADICTING").when(weak, "INSUFFICIENT").when(open_, "NEUTRAL").otherwise("SUPPORTING")
    sure = (F.when(F.col("denied"), 0.9).when(F.size("conflicts") > 0, 0.88).when(weak, 0.7).when(open_, 0.8)
            .otherwise(F.round(F.least(F.lit(0.95), 0.75 + 0.06 * F.col("supported")), 2)))
    return rows.withColumn("stance", stance).withColumn("confidence", sure)


def best_quotes(claims: DataFrame, docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(claim_id, doc_id, overlap, quote): of each of ``pairs`` the sentence with most of the claim's words, the first of
    several; pairs without a sentence that has two of them are left out.

    ``claims`` has claim_id and claim, ``docs`` doc_id and text, a row for each id. Sentences of the documents that are asked for make an inverted
    index of their words, which meets the claims' words: sentences with fewer than two never come together, and a sentence
    travels as its number until it has won."""
    asked = pairs.select("claim_id", "doc_id").distinct()
    sentences = docs.join(beside(asked.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "quote"))
    index = sentences.select("doc_id", "n", F.explode(K.long_words(F.col("quote"))).alias("w"))
    wanted = asked.join(claims.select("claim_id", F.explode(T.words(F.col("claim"), False)).alias("w")), "claim_id")
    met = index.join(wanted, ["doc_id", "w"]).groupBy("claim_id", "doc_id", "n").agg(F.count("*").alias("overlap")).where(F.col("overlap") >= 2)
    best = met.groupBy("claim_id", "doc_id").agg(F.max(F.struct("overlap", (-F.col("n")).alias("before"))).alias("best"))
    best = best.select("claim_id", "doc_id", "best.overlap", (-F.col("best.before")).alias("n"))
    return best.join(sentences, ["doc_id", "n"]).select("claim_id", "doc_id", "overlap", "quote")
