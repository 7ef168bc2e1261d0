"""Duplicates by embeddings: random hyperplanes find candidates, cosines decide, links make clusters."""

from __future__ import annotations

import math
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors a bucket should hold, vectors in a task, the share of pairs at the threshold to find, and the most bits of a bucket.
BUCKET, TASK, RECALL, MOST_BITS = 2048, 16384, 0.97, 20


def held(df: DataFrame) -> DataFrame:
    """``df`` in the folder for checkpoints; only a local session without one gets a temporary folder."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set")
        spark.sparkContext.setCheckpointDir(given or tempfile.mkdtemp(prefix="claimloom-"))
    return df.checkpoint()


def components(edges: DataFrame) -> DataFrame:
    """(id, component: its least id) of the vertices of ``edges`` (a, b): least labels spread along edges and along themselves,
    so that a way of many steps is halved each time."""
    both = edges.where("a != b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").distinct()
    both = held(both)
    now = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component"))
    while True:
        now = held(now)
        near = both.join(now.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        step = now.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        over = step.select(F.col("id").alias("component"), F.col("component").alias("next"))
        step = held(step.join(over, "component").select("id", "old", F.least("component", "next").alias("component")))
        now = step.select("id", "component")
        if step.where("old != component").isEmpty():
            return now


def banding(n: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(bits, bands): bits so that a bucket of ordinary vectors holds about ``BUCKET``, and as many bands as find a pair at the
    threshold with a probability of ``recall``; closer pairs are found more often."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(2, n / BUCKET)))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def _matrix(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]) if len(x) else x


def link_rows(x: np.ndarray, side: np.ndarray, cosine: float) -> np.ndarray:
    """Least index of each row's group: rows are linked from ``cosine`` on, within one side if all are of one, else across sides.

    Groups are walked one by one: a row is held against those that none has reached yet, so a crowd of alike rows costs
    one pass and not its square."""
    unit = x / np.sqrt(np.square(x).sum(axis=1))[:, None]
    group, free, one = np.full(len(x), -1), np.arange(len(x)), side.min() == side.max()
    for k in range(len(x)):
        if group[k] >= 0:
            continue
        group[k], free, front = k, free[free != k], [k]
        while front and len(free):
            at = front.pop()
            hit = unit[free] @ unit[at] >= cosine - 1e-12
            if not one:
                hit &= side[free] != side[at]
            new = free[hit]
            group[new], free = k, free[~hit]
            front.extend(new.tolist())
    return group


def usable() -> F.Column:
    x = F.col("embedding")
    return F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(x, lambda c: c != 0), F.lit(False))


def embedding_clusters(vectors: DataFrame, cosine: float = 0.85, recall: float = RECALL) -> DataFrame:
    """(vec_id, cluster, size): vectors linked by a cosine of ``cosine`` or more, in clusters named by their least vec_id.

    No pair below the threshold is linked; of pairs at the threshold ``recall`` are found on average and of closer ones more.
    Equal vectors are compared as one. A bucket of more than ``TASK`` vectors is cut into parts that meet in pairs, so none
    is left out. Null, empty, zero and non-finite vectors, and those of another length than most, are clusters of their own."""
    spark = vectors.sparkSession
    rows = vectors.select("vec_id", "embedding")
    top = rows.where(usable()).groupBy(F.size("embedding").alias("length")).count().orderBy(F.col("count").desc(), "length").first()
    fit = F.coalesce(usable() & (F.size("embedding") == (top["length"] if top else 0)), F.lit(False))
    alone = rows.where(~fit).select("vec_id", F.col("vec_id").alias("cluster"), F.lit(1).cast("long").alias("size"))
    if not top:
        return alone
    given = held(rows.where(fit).groupBy("embedding").agg(F.min(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))).alias("least"), F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id()))
    bits, bands = banding(given.count(), cosine, recall)
    planes = np.random.default_rng(11).standard_normal((top["length"], bits * bands))
    weights = 1 << np.arange(bits)

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            code = ((_matrix(batch.column(1)) @ planes > 0).reshape(batch.num_rows, bands, bits) * weights).sum(axis=2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code.tolist(), pa.list_(pa.int64()))], names=["no", "codes"])

    codes = held(given.select("no", "embedding").mapInArrow(bucket, "no long, codes array<long>"))
    placed = codes.select("no", F.posexplode("codes").alias("band", "bucket"))
    crowd = held(placed.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("cut", F.ceil(F.col("n") / TASK).cast("int")))
    own = F.pmod(F.xxhash64("no"), F.col("cut")).cast("int")
    tasks = placed.join(crowd, ["band", "bucket"]).withColumn("part", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cut") - 1)))
    tasks = tasks.select("no", "band", "bucket", F.least("part", "other").alias("one"), F.greatest("part", "other").alias("two"), F.when(F.col("part") == F.col("other"), 0).otherwise(F.col("part")).alias("side"))
    keys = ["band", "bucket", "one", "two"]

    def compare(table: pa.Table) -> pa.Table:
        get = lambda c: table.column(c).combine_chunks()
        no = get("no").to_numpy()
        group = link_rows(_matrix(get("embedding")), get("side").to_numpy(), cosine)
        away = group != np.arange(len(no))
        return pa.table({"a": no[away], "b": no[group[away]]})

    many = int(crowd.agg(F.coalesce(F.sum(F.col("cut") * F.col("n")), F.lit(0))).first()[0])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), many // TASK)
    met = tasks.join(given.select("no", "embedding"), "no").repartition(parts, *keys).groupBy(*keys).applyInArrow(compare, "a long, b long")
    found = components(met)
    member = given.select("no", "least", "n").join(found.withColumnRenamed("id", "no"), "no", "left").select("no", "least", "n", F.coalesce("component", "no").alias("component"))
    whole = member.groupBy("component").agg(F.min("least").alias("first"), F.sum("n").alias("size"))
    named = given.select("embedding", "no").join(member.select("no", "component"), "no").join(whole, "component").select("embedding", F.col("first.id").alias("cluster"), "size")
    return rows.where(fit).join(named, "embedding").select("vec_id", "cluster", "size").unionByName(alone)

