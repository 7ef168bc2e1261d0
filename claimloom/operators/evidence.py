"""Evidence: retrieval from a corpus, first-wins dedup, fact-check ratings, consensus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimloom.functions import text as T

#: Fact-check ratings with verdict and stance (fixed values).
RATINGS = {
    "true": ("True", "SUPPORTING"), "correct": ("True", "SUPPORTING"), "accurate": ("True", "SUPPORTING"), "verified": ("True", "SUPPORTING"),
    "mostly true": ("Mostly True", "SUPPORTING"), "mostly correct": ("Mostly True", "SUPPORTING"), "mostly accurate": ("Mostly True", "SUPPORTING"),
    "confirmed": ("True", "SUPPORTING"),
    "false": ("False", "CONTRADICTING"), "incorrect": ("False", "CONTRADICTING"), "fake": ("False", "CONTRADICTING"),
    "pants on fire": ("Pants on Fire", "CONTRADICTING"), "misleading": ("Misleading", "CONTRADICTING"), "fabricated": ("Fabricated", "CONTRADICTING"),
    "hoax": ("Hoax", "CONTRADICTING"), "debunked": ("Debunked", "CONTRADICTING"), "distorts the facts": ("Distorts Facts", "CONTRADICTING"),
    "mostly false": ("Mostly False", "CONTRADICTING"), "mostly incorrect": ("Mostly False", "CONTRADICTING"), "untrue": ("False", "CONTRADICTING"),
    "bust": ("False", "CONTRADICTING"), "unfounded": ("False", "CONTRADICTING"),
    "half true": ("Half True", "NEUTRAL"), "partly true": ("Partly True", "NEUTRAL"), "partly false": ("Partly False", "NEUTRAL"), "mixture": ("Mixture", "NEUTRAL"),
    "mixed": ("Mixed", "NEUTRAL"), "inconclusive": ("Inconclusive", "NEUTRAL"), "unproven": ("Unproven", "NEUTRAL"), "unverified": ("Unverified", "NEUTRAL"),
    "needs context": ("Needs Context", "NEUTRAL"), "missing context": ("Missing Context", "NEUTRAL"), "disputed": ("Disputed", "NEUTRAL"),
}

#: Where the table has no rating: words, of which any decides, with verdict and stance, in this order (fixed values).
PARTLY = "half|partly|mixture|partially"
RATING_WORDS = [
    ("pants on fire|fake|fabricated|hoax|debunked|untrue|unfounded|bust|disproven", "False", "CONTRADICTING"), ("misleading|distort", "Misleading", "CONTRADICTING"),
    ("mostly false|mostly incorrect", "Mostly False", "CONTRADICTING"), (f"(?=.*({PARTLY})).*(false|incorrect)", "Partly False", "NEUTRAL"), ("false|incorrect", "False", "CONTRADICTING"),
    ("mostly true|mostly correct|mostly accurate", "Mostly True", "SUPPORTING"), (f"(?=.*({PARTLY})).*(true|correct|accurate|verified|confirmed)", "Partly True", "NEUTRAL"),
    ("true|correct|accurate|verified|confirmed", "True", "SUPPORTING"), ("half|mixture|mixed|unproven|unverified|inconclusive|context|disputed", "Needs Context", "NEUTRAL"),
]


#: Rows of a table of words that is still broadcast, some 50 bytes each.
BROADCAST_ROWS = 1_000_000


def beside(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as the smaller side of a join: broadcast if it has at most ``most`` rows, else left to the optimizer."""
    return F.broadcast(df) if df.count() <= most else df


def relevant_documents(claims: DataFrame, docs: DataFrame, top: int = 3) -> DataFrame:
    """The ``top`` documents of each claim by relevance, clamp(2.5 Jaccard + 0.5 share of claim words).

    Documents are dealt by their ids once, as word lists, so that common words are counted where they are found; before
    the shuffle by claim each task keeps the best of its own. The ids of ``docs`` must be distinct."""
    def tokens(df: DataFrame, key: str) -> DataFrame:
        ws = df.select(key, T.words(F.col("text"), False).alias("ws"))  # distinct already
        return ws.select(key, F.size("ws").cast("long").alias("n_" + key), "ws")

    spread = lambda df, key: df.select(key, "n_" + key, F.explode("ws").alias("w"))
    dealt = spread(tokens(docs, "doc_id").repartition("doc_id"), "doc_id")
    met = dealt.join(beside(spread(tokens(claims, "item_id"), "item_id")), "w").groupBy("item_id", "doc_id", "n_item_id", "n_doc_id").agg(F.count("*").alias("common"))
    both = F.col("common").cast("double")
    score = F.least(F.lit(1.0), both / (F.col("n_item_id") + F.col("n_doc_id") - F.col("common")) * 2.5 + both / F.col("n_item_id") * 0.5)
    ranked = met.withColumn("relevance", F.round(score, 6)).withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("relevance").desc(), "doc_id")))
    return ranked.where(F.col("rank") <= top).select("item_id", "doc_id", "common", "relevance", "rank")


def trigram_matches(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id, shared, similarity) of the items and documents that share a word trigram.

    Hashes of trigrams find the pairs, in one pass over the documents; only those that are found make their trigrams as text, and are
    compared by them. The ids of both must be distinct."""
    def hashed(df: DataFrame, key: str) -> DataFrame:
        ws = df.select(key, T.words(F.col("text")).alias("ws"))  # a column of its own, else each trigram would split the text anew
        n = F.greatest(F.size("ws") - 2, F.lit(0))
        three = ws.select(key, F.explode(F.arrays_zip(*[F.slice("ws", k, n).alias(c) for k, c in ((1, "a"), (2, "b"), (3, "c"))])).alias("g"))
        return three.select(key, F.xxhash64("g.a", "g.b", "g.c").alias("h"))

    def grams(df: DataFrame, key: str, name: str) -> DataFrame:
        return df.select(key, T.words(F.col("text")).alias("ws")).select(key, T.word_ngrams(F.col("ws"), 3).alias(name))

    found = hashed(docs, "doc_id").join(beside(hashed(items, "item_id").distinct()), "h").select("item_id", "doc_id").distinct()
    mine = grams(docs.join(beside(found.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id", "d")
    met = found.join(mine, "doc_id").join(beside(grams(items, "item_id", "i")), "item_id")
    shared = F.size(F.array_intersect("i", "d")).cast("long")
    met = met.select("item_id", "doc_id", shared.alias("shared"), F.size("i").alias("ni"), F.size("d").alias("nd")).where("shared > 0")
    return met.select("item_id", "doc_id", "shared", F.round(F.col("shared") / (F.col("ni") + F.col("nd") - F.col("shared")), 6).alias("similarity"))


def first_wins(evidence: DataFrame, key: str, order: str) -> DataFrame:
    return evidence.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


#: Titles of one domain with this share of common words are one title (fixed value).
SAME_TITLE = 0.80


def dedup_greedy(evidence: DataFrame) -> DataFrame:
    """Rows of (claim_id, ord, title, canonical_url, domain) that no kept row of their claim before them is like: by
    URL, by title, or by domain and most words of the title. Likeness isn't transitive, so a claim's rows, which
    retrieval bounds, are folded in order; all other columns stay out of the fold."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("title", F.lit(""))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))
    rows = evidence.select("claim_id", F.struct("ord", F.coalesce("canonical_url", F.lit("")).alias("url"), F.lower(F.coalesce("domain", F.lit(""))).alias("domain"), bare.alias("t"),
                                                F.array_remove(F.array_distinct(F.split(bare, " ")), "").alias("ws")).alias("row"))
    claims = rows.groupBy("claim_id").agg(F.array_sort(F.collect_list("row")).alias("rows"))

    def alike(old, new):
        close = (old["domain"] != "") & (old["domain"] == new["domain"]) & (T.jaccard(old["ws"], new["ws"]) >= SAME_TITLE)
        return (old["url"] == new["url"]) | ((new["t"] != "") & (old["t"] == new["t"])) | close

    kept = F.aggregate("rows", F.slice("rows", 1, 0), lambda have, row: F.when(F.exists(have, lambda old: alike(old, row)), have).otherwise(F.concat(have, F.array(row))))
    ids = claims.select("claim_id", F.explode(F.transform(kept, lambda r: r["ord"])).alias("ord"))
    return evidence.join(ids, ["claim_id", "ord"], "left_semi")


def rate(ratings: DataFrame) -> DataFrame:
    """Verdict and stance of ``rating``: the table, else words in it, else Unverified and neutral."""
    key = F.lower(F.trim("rating"))
    table = F.create_map(*[F.lit(x) for k, v in RATINGS.items() for x in (k, "|".join(v))])
    hit = F.split(F.element_at(table, key), r"\|")
    word = [(key.rlike(rf"(?s)^(?:{p})" if p.startswith("(?=") else p), v, s) for p, v, s in RATING_WORDS]
    verdict = F.coalesce(F.get(hit, F.lit(0)), *[F.when(w, F.lit(v)) for w, v, _ in word], F.lit("Unverified"))
    stance = F.coalesce(F.get(hit, F.lit(1)), *[F.when(w, F.lit(s)) for w, _, s in word], F.lit("NEUTRAL"))
    return ratings.withColumn("verdict", verdict).withColumn("stance", stance)


def consensus(comparisons: DataFrame) -> DataFrame:
    """Stance counts and agreement of (claim_id, stance)."""
    n = lambda s: F.count_if(F.col("stance") == s)
    out = comparisons.groupBy("claim_id").agg(n("SUPPORTING").alias("supporting"), n("CONTRADICTING").alias("contradicting"), n("NEUTRAL").alias("neutral"), n("INSUFFICIENT").alias("insufficient"))
    decisive = F.col("supporting") + F.col("contradicting")
    return out.withColumn("agreement_ratio", F.when(decisive == 0, 0.0).otherwise(F.round(F.col("supporting") / decisive, 3)))
