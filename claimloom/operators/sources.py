"""Source analysis: metadata quality, transparency, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimloom.operators import signals as G
from claimloom.operators import verification as V

#: Weights, sub-scores and baselines (fixed values).
WEIGHTS = {"transparency": 0.25, "metadata": 0.20, "attribution": 0.20, "domain": 0.20, "primary": 0.15}
TRANSPARENCY = {"HIGH": 100.0, "MEDIUM": 65.0, "LOW": 30.0, "UNKNOWN": 10.0}
BASELINE = {
    "GOVERNMENT": 90.0, "REGULATORY": 90.0, "INTERNATIONAL_ORGANIZATION": 88.0, "ACADEMIC": 85.0, "FACT_CHECKER": 85.0,
    "NEWS_MEDIA": 75.0, "ORGANIZATION": 60.0, "PERSONAL_BLOG": 35.0, "UNKNOWN": 45.0,
}
HIGH, MEDIUM = 75, 50


def present(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)) != "", F.lit(False))


def metadata_quality() -> Column:
    """0 to 1; over title, publisher, canonical_url, content, snippet, published_at, author."""
    return F.round(sum((F.when(c, w).otherwise(0.0) for c, w in (
        (present("title"), 0.2), (present("publisher"), 0.2), (present("canonical_url"), 0.2), (has_content(), 0.2), (present("published_at"), 0.1), (present("author"), 0.1))), F.lit(0.0)), 2)


def has_content() -> Column:
    long = lambda c: F.coalesce(F.length(F.trim(F.col(c))) >= 20, F.lit(False))
    return long("content") | long("snippet")


def transparency() -> Column:
    full = present("publisher") & present("canonical_url") & has_content()
    return (F.when(full & present("author") & present("published_at"), "HIGH")
            .when(present("publisher") & (present("canonical_url") | has_content()), "MEDIUM")
            .when(metadata_quality() >= 0.3, "LOW").otherwise("UNKNOWN"))


def mapped(key: Column, table: dict, default: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def analyze(evidence: DataFrame) -> DataFrame:
    """Adds meta_score, transparency, reliability and label; ``evidence`` has category, reputation
    (null: the category's baseline), attributed, quoted, named_source, primary_signals."""
    attribution = F.when(~F.col("attributed"), 30.0).otherwise(F.least(60.0 + F.when(F.col("quoted"), 20.0).otherwise(0.0) + F.when(F.col("named_source"), 20.0).otherwise(0.0), F.lit(100.0)))
    primary = F.when(F.col("primary_signals") == 0, 40.0).otherwise(F.least(70.0 + F.col("primary_signals") * 15.0, F.lit(100.0)))
    out = evidence.withColumn("meta_score", metadata_quality()).withColumn("transparency", transparency())
    raw = (mapped(F.col("transparency"), TRANSPARENCY, 10.0) * WEIGHTS["transparency"] + F.col("meta_score") * 100.0 * WEIGHTS["metadata"] + attribution * WEIGHTS["attribution"]
           + F.coalesce("reputation", mapped(F.col("category"), BASELINE, 45.0)) * WEIGHTS["domain"] + primary * WEIGHTS["primary"])
    out = out.withColumn("reliability", F.greatest(F.lit(0), F.least(F.lit(100), F.bround(F.round(raw, 6)).cast("int"))))
    return out.withColumn("label", F.when(F.col("reliability") >= HIGH, "HIGH").when(F.col("reliability") >= MEDIUM, "MEDIUM")
                          .when((F.col("meta_score") <= 0.2) & (F.col("category") == "UNKNOWN"), "UNKNOWN").otherwise("LOW"))


#: What speaks for categories, and what is lacking (fixed values).
FOR_CATEGORY = {"GOVERNMENT": "Official institutional or regulatory source", "REGULATORY": "Official institutional or regulatory source", "FACT_CHECKER": "Identified independent fact-checking desk",
                "ACADEMIC": "Accredited academic or higher education domain"}
BLOG = "Self-publishing or personal blog platform; independent corroboration advised"
LACKS = {"publisher": "Publisher identity not clearly disclosed", "author": "Author byline missing or uncredited", "date": "Publication date is missing or unparseable",
         "attribution": "No explicit external attribution or quotes detected in excerpt", "content": "Full article content unavailable; evaluated based on snippet only"}


def profile(evidence: DataFrame, as_of: int) -> DataFrame:
    """``analyze`` with signals of the text itself, its content, else its snippet, else its title, and what speaks for and against the source:
    the arrays positive and lacking. ``evidence`` has title, publisher, canonical_url, content, snippet, published_at, author, category and reputation."""
    filled = lambda c: F.when(present(c), F.col(c))
    rows = evidence.withColumn("_text", F.coalesce(filled("content"), filled("snippet"), F.col("title"), F.lit("")))
    rows = rows.withColumn("attributed", G.attributed(F.col("_text"))).withColumn("quoted", F.col("_text").rlike(G.QUOTED)).withColumn("_named", G.named_sources(F.col("_text"))).withColumn("_primary", G.primary_signals(F.col("_text"))).drop("_text")
    out = analyze(rows.withColumn("named_source", F.size("_named") > 0).withColumn("primary_signals", F.size("_primary")))
    said = lambda before, what, after=")": F.concat(F.lit(before), what, F.lit(after))
    kind = F.coalesce(*[F.when(F.col("category") == k, F.lit(v)) for k, v in FOR_CATEGORY.items()])
    dated = present("published_at")
    positive = F.array(
        F.when(present("publisher"), said("Publisher clearly identified (", F.col("publisher"))), kind, F.when(present("author"), said("Named author byline (", F.col("author"))), F.when(dated, "Publication timestamp clearly recorded"),
        F.when(dated & (V.age_label(V.age_days(F.col("published_at"), as_of)) == "VERY_RECENT"), "Recent publication date (within last 30 days)"), F.when(F.col("attributed") & F.col("quoted"), "Contains direct quoted statements"),
        F.when(F.col("attributed") & F.col("named_source"), said("Attributes claims to cited sources (", F.array_join("_named", ", "))), F.when(F.col("primary_signals") > 0, said("Firsthand reporting indicators detected (", F.array_join("_primary", ", "))))
    lacking = F.array(F.when(~present("publisher"), LACKS["publisher"]), F.when(F.col("category") == "PERSONAL_BLOG", BLOG), F.when(~present("author"), LACKS["author"]), F.when(~dated, LACKS["date"]),
                      F.when(~F.col("attributed"), LACKS["attribution"]), F.when(~has_content(), LACKS["content"]))
    return out.withColumn("positive", F.array_compact(positive)).withColumn("lacking", F.array_compact(lacking)).drop("_named", "_primary")
