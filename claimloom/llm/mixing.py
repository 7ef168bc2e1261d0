"""Mixing sources to target weights.

Tokens are summed for each source; targets share the total by weight, each stops at ``cap``
times its source's size and the excess is reshared by weight until none is above. A source's
repetition rate is target / size; a document is taken floor(rate) times, plus once more with
the fraction's probability, by a draw seeded with its doc_id, so reruns agree. Rows that share a doc_id, null
among them, are told apart by their places in their files, so that each has a draw of its own.

The capped share has a closed form: with sources ordered by cap / weight, the level per unit
of weight is the greatest of (total - caps before) / (weights from here on). It needs two sorts
of the sources, one row each, dealt by ranges. Null texts have size 0; a null source is a source of its own.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ROW, numbered, salted_join, word_count, written

SEED = "mix-1"


def running(df: DataFrame, order: list[Column], sums: dict[str, Column], name: str) -> tuple[DataFrame, list]:
    """``df`` with ``<sum>_before`` of each of ``sums`` over the rows before in ``order``, and the totals.

    Rows are dealt by ranges of the order and summed within a range; a row for each range holds
    what comes before it, so no task gets all rows.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.select("*", *[c.alias(f"_{k}") for k, c in sums.items()], F.struct(*order).alias("_order"))
    dealt = written(keyed.repartitionByRange(parts, "_order").withColumn("_range", F.spark_partition_id()), name)
    totals = dealt.groupBy("_range").agg(*[F.sum(f"_{k}").alias(k) for k in sums]).orderBy("_range").collect()  # a row for each range
    before, base = [0] * len(sums), []
    for r in totals:
        base.append((r["_range"], *before))
        before = [b + (r[k] or 0) for b, k in zip(before, sums, strict=True)]
    schema = ", ".join(["_range int", *[f"_{k}_base decimal(38,0)" for k in sums]])
    bases = df.sparkSession.createDataFrame([(b[0], *map(Decimal, b[1:])) for b in base], schema)
    inner = Window.partitionBy("_range").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(F.broadcast(bases), "_range").select(
        *df.columns, *[(F.coalesce(F.sum(f"_{k}").over(inner), F.lit(0)) + F.col(f"_{k}_base")).cast("long").alias(f"{k}_before") for k in sums])
    return out, before


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """(source, source_size, target) of rows (source, size); weights repeat by source name, null last.

    Any number of sources will do: both orders are dealt by ranges (``running``)."""
    by = written(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    by, _ = running(by, [F.col("source").isNull(), F.col("source")], {"place": F.lit(1)}, "places")
    by = by.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place_before") % len(weights) + 1).cast("int"))).withColumn("most", cap * F.col("source_size"))
    fill = [F.col("most") / F.col("weight"), F.col("place_before")]
    by, (_, heavy, total) = running(by, fill, {"most": F.col("most"), "weight": F.col("weight"), "size": F.col("source_size")}, "fill")
    level = ((F.lit(int(total)) - F.col("most_before")).cast("double") / (F.lit(int(heavy)) - F.col("weight_before")))
    top = by.agg(F.max(level)).first()[0]
    return by.select("source", "source_size", F.least(F.col("most").cast("double"), F.lit(top).cast("double") * F.col("weight")).alias("target"))


def draw(doc_id: Column, seed: str = SEED, place: Column | None = None) -> Column:
    """Uniform in [0, 1), by doc_id and seed, and by ``place`` where that isn't null."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":" + seed), *([] if place is None else [F.coalesce(F.concat(F.lit(":"), place.cast("string")), F.lit(""))]))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / float(1 << 52)


#: Sources, some 100 bytes each, while their targets are broadcast, so that whole texts stay where they are.
SOURCES = 1 << 16
#: Ids that several rows share, 30 bytes each, while they are broadcast.
REPEATED = 1 << 18


def placed(rows: DataFrame) -> DataFrame:
    """``rows`` (as of ``numbered``) with ``__place``: the row's number if others have its doc_id, else null."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"))
    again = written(rows.groupBy(key.alias("__key")).agg(F.count("*").alias("__n")).where("__n > 1").select("__key", F.lit(True).alias("__again")), "repeated")
    few = again.count() <= REPEATED
    keyed = rows.withColumn("__key", key)
    met = keyed.join(F.broadcast(again), "__key", "left") if few else salted_join(keyed, again, ["__key"], how="left")
    return met.withColumn("__place", F.when(F.col("__again"), F.col(ROW))).drop("__key", "__again")


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc, source_size, target, copies): ``doc`` holds the columns of ``docs`` (rows as of ``numbered``), whatever their names."""
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce(F.col("source"), F.lit("")).alias("name"))
    given = placed(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != ROW]).alias("doc"), key.alias("key"), F.col("__place").alias("place"))
    by = written(targets.select(key.alias("key"), "source_size", "target"), "targets")
    out = given.join(F.broadcast(by), "key", "left") if by.count() <= SOURCES else salted_join(given, by, ["key"], how="left")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("doc", "source_size", "target", (F.floor(rate) + (draw(F.col("doc.doc_id"), seed, F.col("place")) < rate - F.floor(rate)).cast("long")).alias("copies"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: str = SEED) -> DataFrame:
    """Each document as often as it is taken, numbered from 1 by ``copy`` (``copy_``, ... where ``docs`` has that name)."""
    targets = source_targets(docs.select("source", word_count(F.col("text")).alias("size")), weights, cap)
    got = with_copies(numbered(docs), targets, seed).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("number"))
    name = "copy"
    while name in docs.columns:
        name += "_"
    return got.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns], F.col("number").alias(name))


def op10_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = written(numbered(docs).select("doc_id", "source", word_count(F.col("text")).alias("size"), ROW), "sizes")
    return with_copies(sized, source_targets(sized)).select(
        "doc.doc_id", "doc.size", "source_size", "target", (F.col("copies") * F.col("doc.size")).alias("taken"))


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
     w AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most FROM s),
     f AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                  sum(weight) OVER (ORDER BY most::DOUBLE / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest,
                  sum(source_size) OVER () AS total FROM w),
     t AS (SELECT *, least(most::DOUBLE, max((total - before)::DOUBLE / rest::DOUBLE) OVER () * weight) AS target FROM f),
     r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
                  ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':{SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u
           FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM r
"""
