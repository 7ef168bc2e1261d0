"""What is dealt, sorted and read again, seen in plans."""

from pyspark.sql import functions as F

from claimloom import catalog_relations as CR
from claimloom import catalog_text as CT
from claimloom.llm.common import settings
from claimloom.operators import relations as L
from claimloom.operators import tfidf

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_prefixes_tell_what_follows(spark):
    rows = spark.createDataFrame([(1, "a", 1, 0.8), (1, "b", 2, 0.6), (2, "c", 1, 1.0)], "doc_id long, word string, df long, weight double")
    got = {(r.doc_id, r.word): (round(r.after, 9), round(r.end, 9)) for r in tfidf.prefixes(rows, "doc_id", 0.5).collect()}
    assert got == {(1, "a"): (0.6, 0.0), (1, "b"): (0.0, 0.0), (2, "c"): (0.0, 0.0)}


def test_relations_deal_and_sort_items_as_they_are(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    items = docs.select(F.floor(F.col("doc_id") / 8).alias("claim_id"), F.col("doc_id").alias("ord"), F.col("text").alias("title"), F.col("text").alias("content"), F.lit(None).cast("string").alias("snippet"),
                        F.col("source").alias("canonical_url"), F.col("source").alias("domain"), F.col("source").alias("publisher"))
    lines = plan(L.compared(items)).splitlines()
    assert not any("ArrowEvalPython" in x for x in lines) and sum("Sort [" in x for x in lines) == sum("Exchange" in x for x in lines) == 2


def test_retrieval_of_claims_is_read_again(spark):
    claims, _, top = CT.claim_pairs(spark, SMALL)
    assert claims.storageLevel.useMemory and top.storageLevel.useMemory


def test_sequences_of_neighbours_are_made_after_texts_are_dealt(spark):
    below = [part.split("Scan")[0] for part in plan(CR.distinctive_phrases(spark, SMALL)).split("Exchange")[1:]]
    assert len(below) == 2 and not any("split(" in x for x in below)


def test_pages_are_not_gathered_into_arrow_batches(spark):
    lines = plan(CR.page_articles(spark, SMALL))
    assert "BatchEvalPython" in lines and "ArrowEvalPython" not in lines


def test_join_of_a_document_with_the_one_before_deals_each_text_once(spark):
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        dealt = plan(CR.items(spark, SMALL)).split("Exchange")[1:]
    assert len(dealt) == 2 and all("CASE WHEN" in part for part in dealt)
    whole = spark.sql(CR.ITEMS.replace("documents AS", f"parquet.`{SMALL}/documents.parquet` AS"))
    assert CR.items(spark, SMALL).exceptAll(whole).isEmpty() and whole.exceptAll(CR.items(spark, SMALL)).isEmpty()
