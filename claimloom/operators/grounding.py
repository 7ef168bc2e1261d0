"""Grounding: what a claim or a finding names must be in its source or in the packet it was made from."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimloom.operators.verification import MONTHS

#: Claims of a source, characters of a claim and likeness of names (fixed values).
MOST_CLAIMS, LEAST_CHARS, MOST_CHARS, LIKE = 10, 10, 500, 0.85
#: Confidence that findings keep once something in the result was not grounded (fixed value).
CAPPED = 0.75
URL = r"https?://[^\s)\]]+"
NUMBER = r"\d[\d,.]*(?:\.\d+)?"


def numbers_grounded(claim: Column, source: Column) -> Column:
    """Numbers of two digits or more must be digit runs of the source, and months must occur in it."""
    runs = F.regexp_extract_all(source, F.lit(r"\d+"), F.lit(0))
    figures = F.transform(F.regexp_extract_all(claim, F.lit(NUMBER), F.lit(0)), lambda m: F.regexp_replace(m, r"\D", ""))
    months = F.array(*[F.lit(m) for m in MONTHS[:12]])
    return F.forall(figures, lambda d: (F.length(d) < 2) | F.array_contains(runs, d)) & F.forall(
        months, lambda m: ~F.contains(F.lower(claim), m) | F.contains(F.lower(source), m))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def block_ratio(target: pd.Series, window: pd.Series) -> pd.Series:
    """Twice the matching characters by longest blocks over all characters; bounds that cost less come first."""
    out, match, held = [], difflib.SequenceMatcher(None), None
    for a, b in zip(target, window, strict=True):
        if b != held:
            match.set_seq2(b)
            held = b
        match.set_seq1(a)
        out.append(match.ratio() if match.real_quick_ratio() >= LIKE and match.quick_ratio() >= LIKE else 0.0)
    return pd.Series(out)


def best_windows(names: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, name, likeness) of the distinct ``names`` (source_id, name): the best ratio, from ``LIKE`` on, with a window of
    the source of as many words, one less or one more; 0 where none reaches it.

    A name whose words are in the source as they stand is there for certain. For the others windows are made of the sources that are asked, once each, and
    only those of a length that can reach ``LIKE`` meet the name."""
    asked = names.select("source_id", "name", words(F.col("name")).alias("ws")).where(F.size("ws") > 0).distinct()
    asked = asked.withColumn("target", F.array_join("ws", " ")).withColumn("n", F.size("ws")).drop("ws")
    texts = sources.join(asked.select("source_id").distinct(), "source_id", "left_semi").select("source_id", words(F.col("text")).alias("ws")).withColumn("line", F.concat(F.lit(" "), F.array_join("ws", " "), F.lit(" ")))
    told = asked.join(texts.select("source_id", "line"), "source_id").withColumn("exact", F.contains("line", F.concat(F.lit(" "), "target", F.lit(" ")))).drop("line")
    sure = told.where("exact").select("source_id", "name", F.lit(1.0).alias("likeness"))
    rest = told.where("not exact").drop("exact").withColumn("width", F.explode(F.array(F.col("n") - 1, F.col("n"), F.col("n") + 1))).where("width > 0")
    widths = rest.groupBy("source_id").agg(F.collect_set("width").alias("widths"))
    # ``ws`` is cut by arrays that slide along it, so that no lambda evaluates it again
    places = texts.join(widths, "source_id").withColumn("width", F.explode("widths")).where(F.size("ws") >= F.col("width")).select(
        "source_id", "width", "ws", F.explode(F.sequence(F.lit(1), F.size("ws") - F.col("width") + 1)).alias("at"))
    windows = places.select("source_id", "width", F.array_join(F.slice("ws", F.col("at"), F.col("width")), " ").alias("window")).distinct()
    a, b = F.length("target"), F.length("window")
    met = rest.join(windows, ["source_id", "width"]).where(2 * F.least(a, b) >= LIKE * (a + b))
    scored = met.withColumn("likeness", F.pandas_udf(block_ratio, "double")("target", "window")).groupBy("source_id", "name").agg(F.max("likeness").alias("likeness")).where(F.col("likeness") >= LIKE)
    found = sure.unionByName(scored)
    return names.select("source_id", "name").distinct().join(found, ["source_id", "name"], "left").withColumn("likeness", F.coalesce("likeness", F.lit(0.0)))


def valid_claims(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """The rows of ``claims`` (source_id, ord, claim_text, confidence, names: array) that stand, in order, as (source_id, place,
    claim_text, confidence): of a source's first ten those of 10 to 500 characters, no questions, whose numbers, months and names are grounded in its
    text; of those that differ in case only, the first. Names without words are passed over; a source without a text grounds no names."""
    by = Window.partitionBy("source_id").orderBy("ord")
    first = claims.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= MOST_CLAIMS).drop("_n").withColumn("claim_text", F.trim(F.coalesce("claim_text", F.lit(""))))
    first = first.where(F.length("claim_text").between(LEAST_CHARS, MOST_CHARS) & ~F.col("claim_text").endswith("?"))
    texts = sources.select("source_id", F.coalesce("text", F.lit("")).alias("text"))
    first = first.join(texts, "source_id").where(numbers_grounded(F.col("claim_text"), F.col("text"))).drop("text")
    named = first.select("source_id", "ord", F.explode("names").alias("name")).where(F.size(words(F.col("name"))) > 0)
    lost = named.join(best_windows(named.select("source_id", "name"), texts).where(F.col("likeness") < LIKE), ["source_id", "name"], "left_semi").select("source_id", "ord").distinct()
    kept = first.join(lost, ["source_id", "ord"], "left_anti")
    kept = kept.withColumn("_n", F.row_number().over(Window.partitionBy("source_id", F.lower("claim_text")).orderBy("ord"))).where("_n = 1")
    return kept.select("source_id", (F.row_number().over(by) - 1).alias("place"), "claim_text", "confidence")


#: The lists of findings of a reasoning result, in the order in which they are checked.
LISTS = ("key_findings", "supporting_findings", "contradicting_findings")


def validate_findings(results: DataFrame, packets: DataFrame) -> DataFrame:
    """``results`` (claim_id and the arrays of findings in ``LISTS``: text, evidence_ids, stance, importance, confidence) held
    against ``packets`` (claim_id, evidence_ids, urls; a row for each claim), with ``warnings``.

    Ids that the packet lacks go; a finding that loses all gets the packet's first. Each lost id and each URL in a text that the packet
    lacks is a warning, and a finding's confidence is capped once there are warnings, its own or earlier ones. A claim without a
    packet grounds nothing. Lists stay nested and in order: nothing is exploded but one join of a row for each claim."""
    none = F.array().cast("array<string>")
    out = results.join(packets.select("claim_id", F.col("evidence_ids").alias("_ids"), F.col("urls").alias("_urls")), "claim_id", "left")
    out = out.withColumn("_ids", F.coalesce("_ids", none)).withColumn("_urls", F.transform(F.coalesce("_urls", none), lambda u: F.lower(u)))
    out = out.withColumn("warnings", none)
    kinds = dict(results.dtypes)
    for name in LISTS:
        def told(f: Column, name: str = name) -> Column:
            ids = F.transform(F.filter(f["evidence_ids"], lambda i: ~F.array_contains("_ids", i)), lambda i: F.concat(
                F.lit("Hallucinated evidence ID '"), i, F.lit(f"' detected in {name} finding: '"), F.substring(f["text"], 1, 60), F.lit("...'")))
            urls = F.transform(F.filter(F.regexp_extract_all(f["text"], F.lit(URL), F.lit(0)), lambda u: ~F.array_contains("_urls", F.lower(u))), lambda u: F.concat(F.lit("Hallucinated URL '"), u, F.lit("' in finding text")))
            return F.concat(ids, urls)

        def clean(f: Column, warned: Column) -> Column:
            kept = F.filter(f["evidence_ids"], lambda i: F.array_contains("_ids", i))
            kept = F.when((F.size(kept) == 0) & (F.size("_ids") > 0), F.slice("_ids", 1, 1)).otherwise(kept)
            return f.withField("evidence_ids", kept).withField("confidence", F.when(warned, F.least(f["confidence"], F.lit(CAPPED))).otherwise(f["confidence"]))

        found = F.transform(F.coalesce(F.col(name), F.array().cast(kinds[name])), lambda f: F.struct(f.alias("f"), told(f).alias("w")))
        out = out.withColumn("_found", found)
        before = lambda i: (F.size("warnings") > 0) | F.exists(F.slice("_found", 1, i + 1), lambda x: F.size(x["w"]) > 0)
        out = out.withColumn(name, F.transform("_found", lambda x, i: clean(x["f"], before(i))))
        out = out.withColumn("warnings", F.concat("warnings", F.flatten(F.transform("_found", lambda x: x["w"]))))
    note = F.concat(F.lit("Grounding validator flagged "), F.size("warnings").cast("string"), F.lit(" unverified reference(s) which were sanitized."))
    limits = F.coalesce("limitations", none) if "limitations" in kinds else none
    return out.withColumn("limitations", F.when(F.size("warnings") > 0, F.concat(limits, F.array(note))).otherwise(limits)).drop("_ids", "_urls", "_found")
