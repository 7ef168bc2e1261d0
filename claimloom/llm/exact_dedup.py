"""Exact dedup against a persistent digest index.

The index is a table of one row for each distinct text, bucketed and sorted by the SHA-256
digest. New documents are grouped by digest, sort-merge anti-joined with the index and what is
new is appended, so a batch never shuffles the index.

Null counts as an empty text. Of equal new texts the row with the largest doc_id stays (a null
doc_id is least; of repeated rows one stays); a text that the index already holds is dropped.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, ROW, UPPER, ascii_lower, buckets_for, new_path, numbered, salted_join, temporary_table, without, written


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(ascii_lower(F.coalesce(text, F.lit(""))).cast("binary"), 256))


class DigestIndex:
    """``table`` names an index; it is made, in ``path`` or the shared folder, if it isn't there. Without a
    name it lives as long as the process.

    Rows carry the batch that brought them. A batch that is ingested again, say after a lost job, is judged
    against the other batches only and appends nothing twice, so it gets the decisions of its first run."""

    def __init__(self, spark: SparkSession, table: str | None = None, path: str | None = None, buckets: int = 12):
        self.spark, self.buckets = spark, buckets
        self.table = table or temporary_table(spark, "digests")
        self.path = path or new_path(spark, "digests")
        if not spark.catalog.tableExists(self.table):
            self._write(spark.createDataFrame([], "digest binary, keep_id long, group_size long, batch string"))

    def _write(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").write.mode("append").format("parquet").bucketBy(self.buckets, "digest")
             .sortBy("digest").option("path", self.path).saveAsTable(self.table))

    def read(self) -> DataFrame:
        return self.spark.table(self.table)

    def ingest(self, digests: DataFrame, batch: str | None = None) -> DataFrame:
        """Decides on new rows (row, doc_id, digest) and appends what is new.

        Returns row, doc_id, digest, keep_id, group_size, kept. ``keep_id`` is the row that
        stays, of the index or of this batch; ``group_size`` counts this batch's rows.
        """
        batch = batch or uuid.uuid4().hex
        top = F.max(F.struct(F.col("doc_id"), F.col("row")))
        salted = digests.groupBy("digest", F.pmod(F.xxhash64("row"), F.lit(64)).alias("part")).agg(top.alias("top"), F.count("*").alias("n"))
        groups = written(salted.groupBy("digest").agg(F.max("top").alias("top"), F.sum("n").alias("group_size")), "groups")
        held = self.read()
        old = held.where(F.col("batch") != batch).select("digest", F.col("keep_id").alias("old_id"), F.lit(True).alias("old"))
        new = groups.join(held.select("digest").hint("merge"), "digest", "left_anti")
        marked = groups.join(old.hint("merge"), "digest", "left")
        verdict = written(marked.select(
            "digest", "group_size", F.when(F.col("old"), F.col("old_id")).otherwise(F.col("top.doc_id")).alias("keep_id"),
            F.when(F.col("old").isNull(), F.col("top.row")).alias("keep_row")), "verdicts")
        self._write(new.select("digest", F.col("top.doc_id").alias("keep_id"), "group_size", F.lit(batch).alias("batch")))
        return salted_join(digests, verdict, ["digest"]).select(
            "row", "doc_id", "digest", "keep_id", "group_size", F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"))


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """A row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs))
    digests = written(docs.select("doc_id", text_digest(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")
    return index.ingest(digests, batch).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame, index: DigestIndex | None = None, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    index = index or DigestIndex(docs.sparkSession, buckets=buckets_for(docs))
    rows = numbered(docs)
    digests = written(rows.select(F.col(ROW).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_digest(F.col("text")).alias("digest")), "digests")
    out = index.ingest(digests, batch).where("not kept").select(F.col("row").alias(ROW))
    return without(rows, out, ROW).drop(ROW)


def op4_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents),
     g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
