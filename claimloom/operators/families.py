"""Families of verbs: synonyms and hypernyms over a lexicon that is given as two tables.

``senses`` (lemma, synset, rank) has a row for each lemma of each sense, rank 0 being the lemma's most frequent sense; ``parents``
(synset, parent) leads to the more general sense. Only the three most frequent senses of a lemma are expanded, while all
lemmas of a synset are its names. Everything is joins over the lexicon, which is small beside the texts; texts meet it by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import lexicon as W
from claimloom.operators.evidence import beside

#: Verbs too general to lead from one to another (fixed values).
GENERIC = (
    "be have do does get make take go goes come put set give run turn become seem keep leave hold bring flow course feed move travel change alter modify hit operate work displace locomote pull "
    "express tally score show ingest"
).split()
SENSES = 3


def specific(word: Column) -> Column:
    """One word, and not too general."""
    return ~F.contains(word, F.lit(" ")) & ~word.isin(GENERIC)


def expansions(senses: DataFrame, parents: DataFrame) -> DataFrame:
    """(lemma, kind, synset), from which relations of words are joined when asked: name for the synsets that a lemma is a name of, sense for
    those of its expanded senses, hypernym for their parents, and above for what the specific names of these lead to in turn.

    It grows with the lexicon: pairs of words that a synset relates, as many as the square of its names, are never made."""
    clean = F.lower(F.trim(F.regexp_replace("lemma", "_", " ")))
    names = senses.withColumn("lemma", clean).where((F.length("lemma") > 2) | F.contains("lemma", F.lit(" ")))
    top = names.withColumn("_n", F.row_number().over(Window.partitionBy("lemma").orderBy("rank", "synset"))).where(F.col("_n") <= SENSES).select("lemma", "synset").distinct()
    names = names.select("lemma", "synset").distinct()
    hypernym = top.join(parents, "synset").select("lemma", F.col("parent").alias("synset")).distinct()
    on = names.where(specific(F.col("lemma"))).withColumnRenamed("synset", "via").join(hypernym, "lemma").select("via", "synset").distinct()
    above = hypernym.withColumnRenamed("synset", "via").join(on, "via").select("lemma", "synset").distinct()
    kind = lambda df, k: df.select("lemma", F.lit(k).alias("kind"), "synset")
    return kind(names, "name").unionByName(kind(top, "sense")).unionByName(kind(hypernym, "hypernym")).unionByName(kind(above, "above"))


def of_kind(expanded: DataFrame, lemma: str, synset: str, *kinds: str) -> DataFrame:
    return expanded.where(F.col("kind").isin(*kinds)).select(F.col("lemma").alias(lemma), F.col("synset").alias(synset)).distinct()


def synonymous(pairs: DataFrame, expanded: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) of which b is a name of one of a's senses, or a itself with a sense."""
    named = pairs.join(of_kind(expanded, "a", "synset", "sense"), "a").join(of_kind(expanded, "b", "synset", "name"), ["b", "synset"]).select("a", "b")
    return named.unionByName(pairs.where("a = b").select("a", "b").join(of_kind(expanded, "a", "synset", "sense"), "a", "left_semi")).distinct()


def related(pairs: DataFrame, expanded: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) that assert a related predicate: equal; or, neither being too general, synonyms or a hypernym either
    way, a shared specific hypernym, or one of up to two steps either way."""
    given = pairs.select("a", "b").distinct()
    open_ = given.where((F.col("a") != F.col("b")) & ~F.col("a").isin(GENERIC) & ~F.col("b").isin(GENERIC))
    both = open_.select("a", "b", F.col("a").alias("lemma"), F.col("b").alias("other")).unionByName(open_.select("a", "b", F.col("b").alias("lemma"), F.col("a").alias("other")))
    up = both.join(expanded.where("kind != 'name'"), "lemma").where((F.col("kind") != "above") | specific(F.col("other")))
    steps = up.join(of_kind(expanded, "other", "synset", "name"), ["other", "synset"], "left_semi").select("a", "b")
    # hypernyms are shared where a specific name is one of both synsets
    side = lambda s: of_kind(expanded, s, f"of_{s}", "hypernym")
    parents = open_.join(side("a"), "a").join(side("b"), "b")
    name = lambda s: of_kind(expanded.where(specific(F.col("lemma"))), "via", f"of_{s}", "name")
    asked = parents.select("of_a", "of_b").distinct()
    common = asked.join(name("a"), "of_a").join(name("b"), ["of_b", "via"]).select("of_a", "of_b").distinct()
    shared = parents.join(common, ["of_a", "of_b"], "left_semi").select("a", "b")
    return given.where("a = b").unionByName(steps).unionByName(shared).distinct()


def family_words(reference: DataFrame, expanded: DataFrame) -> DataFrame:
    """(word): lemmas of the lexicon that belong to the families of ``reference`` (word): themselves or by their synonyms or specific
    hypernyms of up to two steps a reference word or one of its synonyms. The reference isn't led upwards itself."""
    given = reference.select(F.lower("word").alias("lemma")).distinct()
    senses = of_kind(expanded, "lemma", "synset", "sense").join(given, "lemma", "left_semi").select("synset").distinct()
    named = of_kind(expanded, "word", "synset", "name")
    surface = named.join(senses, "synset", "left_semi").select("word").unionByName(given.select(F.col("lemma").alias("word"))).distinct().where(specific(F.col("word")))
    reached = named.join(surface, "word", "left_semi").select("synset").distinct()
    return of_kind(expanded, "word", "synset", "sense", "hypernym", "above").join(reached, "synset", "left_semi").select("word").unionByName(surface).distinct()


def words_of(texts: DataFrame, key: list[str]) -> DataFrame:
    return texts.select(*key, F.explode(F.array_distinct(W.letters(F.col("text")))).alias("word")).where(F.length("word") > 2)


def family_signals(texts: DataFrame, key: list[str], reference: DataFrame, expanded: DataFrame) -> DataFrame:
    """(key, word): the first by name of a text's words that is of the families of ``reference``; texts without one are left out."""
    met = words_of(texts, key).join(beside(family_words(reference, expanded)), "word")
    return met.groupBy(*key).agg(F.min("word").alias("word"))


def action_matches(asked: DataFrame, expanded: DataFrame, key: list[str]) -> DataFrame:
    """(key, tier) of ``asked`` (key, action, text; a row for each key): how a text bears out an action: verbatim, by a synonym among its words, by
    a related word, by a synonym of several words, or, null, not at all.

    Words that the lexicon has as lemmas stand for the text's verbs: there is no tagger. An action that is too general counts verbatim or by synonyms."""
    low = F.concat(F.lit(" "), F.array_join(W.letters(F.col("text")), " "), F.lit(" "))
    rows = asked.select(*key, F.lower("action").alias("action"), F.coalesce(low, F.lit(" ")).alias("line"))
    within = lambda phrase: F.contains("line", F.concat(F.lit(" "), phrase, F.lit(" ")))
    verbatim = rows.where(within(F.col("action"))).select(*key, F.lit(1).alias("tier"))
    verbs = of_kind(expanded, "word", "synset", "sense").select("word").distinct()
    spoken = words_of(asked, key).join(beside(verbs), "word").join(asked.select(*key, F.lower("action").alias("action")), key)
    said = spoken.select(F.col("action").alias("a"), F.col("word").alias("b")).distinct()
    by_synonym = spoken.join(synonymous(said, expanded).toDF("action", "word"), ["action", "word"], "left_semi").select(*key, F.lit(2).alias("tier"))
    near = related(said, expanded).select(F.col("a").alias("action"), F.col("b").alias("word"))
    by_relation = spoken.where(~F.col("action").isin(GENERIC)).join(near, ["action", "word"], "left_semi").select(*key, F.lit(3).alias("tier"))
    phrases = of_kind(expanded.where(F.contains("lemma", F.lit(" "))), "word", "synset", "name")
    phrases = of_kind(expanded, "action", "synset", "sense").join(phrases, "synset").select("action", "word").unionByName(
        of_kind(expanded, "action", "synset", "sense").where(F.contains("action", F.lit(" "))).select("action", F.col("action").alias("word"))).distinct()
    by_phrase = rows.join(phrases, "action").where(within(F.col("word"))).select(*key, F.lit(4).alias("tier"))
    best = verbatim.unionByName(by_synonym).unionByName(by_relation).unionByName(by_phrase).groupBy(*key).agg(F.min("tier").alias("tier"))
    name = F.element_at(F.array(*[F.lit(t) for t in ("verbatim", "synonym", "related", "phrase")]), F.col("tier"))
    return rows.select(*key).join(best.withColumn("tier", name), key, "left")
