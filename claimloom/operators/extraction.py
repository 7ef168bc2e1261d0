"""Claims from documents: headline first, then sentences, split into clauses, numbered, with first-wins duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T
from claimloom.operators import claims as K
from claimloom.operators import signals as S

#: Verbs by which an "and" is seen to begin a clause (fixed values).
CLAUSE_VERBS = "will|is|are|was|were|has|have|had|announced|approved|banned|scheduled"
CLAUSE = T.ascii_edges(rf"(?i)\s+and\s+(?=[a-z\s]+(?:{CLAUSE_VERBS})\b)")
#: Likeness from which a claim is a duplicate, and from which it is one with the same figures.
SAME, ALIKE = 0.75, 0.5


def clauses(statement: Column) -> Column:
    """Clauses joined by "and" as statements of their own, if two or more have four words and something factual."""
    end = lambda p: F.when(p.rlike(r"[.!?]$"), p).otherwise(F.concat(p, F.lit(".")))
    parts = F.filter(F.transform(F.split(statement, CLAUSE, -1), lambda p: F.trim(p)), lambda p: F.size(F.split(p, r"\s+")) >= 4)
    good = F.transform(F.filter(parts, S.is_factual), end)
    whole = F.array(statement)
    return F.when(~statement.rlike(CLAUSE), whole).otherwise(F.when(F.size(good) > 1, good).otherwise(whole))


def claim_id(text: Column, index: Column) -> Column:
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "")
    return F.concat(F.lit("claim_"), F.substring(F.sha2(bare.cast("binary"), 256), 1, 10), F.lit("_"), index.cast("string"))


def extract_claims(docs: DataFrame, key: str) -> DataFrame:
    """A row for each claim of ``docs`` (key, title, text): claim_index from 1 by document, claim_id, sentence (null for a
    headline), text, normalized, source_sentence, speaker, verb, entities, dates, numbers, locations, claim_type, importance.

    Titles and sentences must be candidates with something factual. Null titles and texts give none. Persons and
    organizations need a model of names; without one they are empty."""
    none = F.lit(None).cast("string")
    fit = lambda s: K.is_candidate(s) & S.is_factual(s)
    heads = docs.select(key, F.lit(-1).alias("sentence"), F.trim("title").alias("source_sentence")).where(fit(F.col("source_sentence")))
    heads = heads.select(key, "sentence", "source_sentence", none.alias("speaker"), none.alias("verb"), F.array("source_sentence").alias("parts"))
    parts = F.filter(F.transform(F.split("text", r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    body = docs.select(key, F.posexplode(parts).alias("sentence", "source_sentence")).where(fit(F.col("source_sentence")))
    body = body.withColumn("said", S.attribution(F.col("source_sentence"))).select(key, "sentence", "source_sentence", "said.speaker", "said.verb", clauses(F.col("said.statement")).alias("parts"))
    rows = heads.unionByName(body).select(key, "sentence", "source_sentence", "speaker", "verb", F.posexplode("parts").alias("part", "text"))
    rows = rows.withColumn("claim_index", F.row_number().over(Window.partitionBy(key).orderBy("sentence", "part")))
    rows = rows.withColumn("entities", S.entities(F.col("text")))
    names = {"dates": ["DATE"], "numbers": ["MONEY", "PERCENT"], "locations": ["GPE"]}
    rows = rows.withColumns({k: S.entity_texts(F.col("entities"), *v) for k, v in names.items()})
    some, no = lambda c: F.size(c) > 0, F.lit(False)
    kind = K.claim_type(F.col("text"), F.col("speaker").isNotNull(), some("numbers"), no, no, some("dates") | some("locations"))
    rows = rows.withColumn("claim_type", kind)
    return rows.select(
        key, "claim_index", claim_id(F.col("text"), F.col("claim_index")).alias("claim_id"), F.when(F.col("sentence") >= 0, F.col("sentence")).alias("sentence"), F.trim("text").alias("text"),
        S.normalize_claim(F.col("text")).alias("normalized"), "source_sentence", "speaker", "verb", "entities", *names, "claim_type",
        K.importance(F.col("sentence") < 0, F.col("sentence"), some("numbers"), no, some("dates"), F.col("claim_type")).alias("importance"))


def prefix(words: Column) -> Column:
    """Of the distinct ``words``, longest and so rarest first, those of which two sets with a likeness of ``ALIKE`` share one."""
    ordered = F.transform(F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
    return F.slice(ordered, 1, F.size(words) - F.ceil(F.size(words) * ALIKE).cast("int") + 1)


def like_pairs(claims: DataFrame, key: str) -> DataFrame:
    """(key, a, b): claims (key, claim_index, normalized, source_sentence, numbers, dates) of one document, a before b, of
    which b would be a duplicate of a. Claims meet that share a word of a prefix; sets are compared exactly."""
    words = lambda c: K.long_words(F.col(c))
    sets = claims.select(key, "claim_index", "numbers", "dates", words("normalized").alias("own"), words("source_sentence").alias("source"))
    marked = lambda c: F.transform(prefix(F.col(c)), lambda w: F.concat(F.lit(f"{c}:"), w))
    tokens = sets.select(key, "claim_index", F.explode(F.concat(marked("own"), marked("source"))).alias("w"))
    side = lambda s: tokens.select(key, "w", F.col("claim_index").alias(s))
    met = side("a").join(side("b"), [key, "w"]).where("a < b").select(key, "a", "b").distinct()
    full = lambda s: sets.select(key, F.col("claim_index").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("own", "source", "numbers", "dates")])
    met = met.join(full("a"), [key, "a"]).join(full("b"), [key, "b"])
    own, source = T.jaccard(F.col("own_a"), F.col("own_b")), T.jaccard(F.col("source_a"), F.col("source_b"))
    numbers, dates = F.arrays_overlap("numbers_a", "numbers_b"), F.arrays_overlap("dates_a", "dates_b")
    likeness = F.when((own < SAME) & (source >= ALIKE) & (numbers | dates), source).otherwise(own)
    return met.where((likeness >= SAME) | ((likeness >= ALIKE) & numbers & dates)).select(key, "a", "b")


def first_primaries(pairs: DataFrame, key: str) -> DataFrame:
    """(key, claim_index, primary) of the claims that are duplicates: of the first claim they are like that is none itself.

    Likeness isn't transitive, so a document's pairs are gone through in order; they are numbers, and only of claims that
    are like one another."""
    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        of: dict[int, int] = {}
        for a, b in frame.sort_values(["b", "a"])[["a", "b"]].itertuples(index=False):
            if b not in of and a not in of:
                of[b] = a
        return pd.DataFrame({key: frame[key].iloc[0], "claim_index": list(of), "primary": list(of.values())})

    return pairs.groupBy(key).applyInPandas(fold, f"{key} {dict(pairs.dtypes)[key]}, claim_index int, primary int")


def group_claims(claims: DataFrame, key: str) -> DataFrame:
    """``claims`` with duplicate_of, the claim_id of the primary, and on primaries equivalents: the other texts of their duplicates.

    Claims that are equal in all that is compared stand in for one another, so a line that a document repeats makes no pairs."""
    alike = ["normalized", "source_sentence", "numbers", "dates"]
    first = claims.groupBy(key, *alike).agg(F.min("claim_index").alias("first"))
    found = first_primaries(like_pairs(first.withColumnRenamed("first", "claim_index"), key), key).withColumnRenamed("claim_index", "first")
    member = claims.join(first, [key, *alike]).join(found, [key, "first"], "left")
    # a claim is like its equal if it has words, or figures and a sentence with words
    itself = (F.size(K.long_words(F.col("normalized"))) > 0) | ((F.size("numbers") + F.size("dates") > 0) & (F.size(K.long_words(F.col("source_sentence"))) > 0))
    member = member.withColumn("primary", F.coalesce("primary", F.when((F.col("claim_index") > F.col("first")) & itself, F.col("first")))).drop("first")
    ids = claims.select(key, F.col("claim_index").alias("primary"), F.col("claim_id").alias("duplicate_of"))
    marked = member.join(ids, [key, "primary"], "left")
    texts = marked.where("primary is not null").groupBy(key, F.col("primary").alias("claim_index"), "text").agg(F.min("claim_index").alias("at"))
    texts = texts.groupBy(key, "claim_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]).alias("equivalents"))
    return marked.drop("primary").join(texts, [key, "claim_index"], "left").withColumn("equivalents", F.coalesce("equivalents", F.array().cast("array<string>")))
