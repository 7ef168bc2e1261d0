"""Corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage reads its predecessor's rows and removes rows, not ids: rows with a null or repeated doc_id
are judged one by one. Null and empty texts pass the first stage as they score, count as equal
texts in the second, are linked with nothing and hold no leak. All but the last return the columns of
documents; the last repeats each document as often as the mix takes it, with its number in ``copy``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import decontaminate, exact_dedup, mixing, ngram_join, toxicity
from claimloom.llm.common import ROW, numbered, salted_join, without, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(texts, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score(docs, model)
    return scored.where(F.col(scored.columns[-1])["predicted"] == 0).drop(scored.columns[-1])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_distinct(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 the smallest doc_id stays (null counts
    as greatest; of rows with that id, one)."""
    rows = numbered(docs)
    found = ngram_join.ngram_components(rows.select(F.col(ROW).alias("doc_id"), "text"), size=5, percent=80)
    grouped = written(found.withColumnRenamed("doc_id", ROW).join(rows.select(ROW, F.col("doc_id").alias("id")), ROW), "grouped")
    first = grouped.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", ROW))[ROW].alias("stays"), F.count("*").alias("n")).where("n > 1")
    return without(rows, salted_join(grouped, first, ["component_id"]).where(F.col(ROW) != F.col("stays")), ROW).drop(ROW)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    rows = numbered(docs)
    found = decontaminate.decontaminate(rows.select(F.col(ROW).alias("doc_id"), "text"), items)
    return without(rows, found.where("contaminated").select(F.col("doc_id").alias(ROW)), ROW).drop(ROW)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("mixing", mix),
]
#: The toxicity score and the Jaccard components have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "stage")
    return docs
