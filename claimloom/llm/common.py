"""Shared folder, written intermediates and small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper and lower case ASCII letters (fixed values).
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where that is unset and
    the session is local, else a folder in the warehouse."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = conf.get("spark.master", "")
        if master == "local" or master.startswith("local["):  # not local-cluster, whose executors have folders of their own
            root = getattr(shared_dir, "made", None) or tempfile.mkdtemp(prefix="claimloom-")
            shared_dir.made = root
        else:
            root = spark.conf.get("spark.sql.warehouse.dir") + "/_claimloom"
    return f"{root.rstrip('/')}/claimloom-{spark.sparkContext.applicationId}"


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended; the folder's owner cleans up
        pass


def new_path(spark: SparkSession, name: str) -> str:
    root = shared_dir(spark)
    if root not in _roots:
        _roots.add(root)
        atexit.register(_forget, spark, root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


_roots: set[str] = set()


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the actions inside; the caller's own come back afterwards."""
    old = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


#: Joins of whole texts with a filtered table of ids drop most other texts before the shuffle, by Spark's
#: runtime Bloom filter: 2 MB at any size of input; where it fills up, more texts are shuffled. Spark only
#: makes one from a side with a comparison in its filter, as in ``class >= 0``; ``is not null`` won't do.
BLOOM = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in {
    "applicationSideScanSizeThreshold": "1MB", "creationSideThreshold": "1GB", "expectedNumItems": "2000000", "numBits": str(1 << 24)}.items()}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: The column of ``numbered``.
ROW = "__row"


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row in ``ROW``, the same in every job. Rows of a plain scan go by their
    file and their place in it, which costs no copy; any other rows are written once with their numbers."""
    try:
        placed = docs.select(*docs.columns, F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__index"))
    except AnalysisException:  # no scan of files
        return written(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")
    files = written(placed.select("__file").distinct().repartition(1).withColumn("__number", F.monotonically_increasing_id()), "files")
    row = F.shiftleft(F.col("__number"), 40) + F.col("__index")
    return placed.join(F.broadcast(files), "__file").select(*[F.col(f"`{c}`") for c in docs.columns], row.alias(ROW))


def without(docs: DataFrame, gone: DataFrame, key: str, most: int = 1 << 20) -> DataFrame:
    """Rows of ``docs`` whose ``key`` isn't in ``gone`` (one column of longs). Up to ``most`` keys, 8 MB,
    are broadcast, so whole texts stay where they are; more are joined by a shuffle."""
    keys = written(gone.select(F.col(key)).where(F.col(key).isNotNull()).distinct(), "gone")
    return docs.join(F.broadcast(keys) if keys.count() <= most else keys.hint("merge"), key, "left_anti").select(docs.columns)


def _drop(spark: SparkSession, table: str) -> None:
    try:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    except Exception:  # the session has ended, and its catalog with it
        pass


def temporary_table(spark: SparkSession, name: str) -> str:
    """A new table's name; what it names is dropped when the process ends."""
    table = f"claimloom_{name}_{uuid.uuid4().hex}"
    atexit.register(_drop, spark, table)
    return table


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as an external table in the shared folder, bucketed and sorted by ``key``."""
    spark = df.sparkSession
    table = temporary_table(spark, name)
    (df.write.bucketBy(buckets, key).sortBy(key).format("parquet")
       .option("path", new_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def give_back() -> None:
    """Returns a worker's freed memory to the system: workers outlive their tasks, beside the JVM's heap."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def size_of(df: DataFrame) -> int:
    """The optimizer's size of ``df`` in bytes: file sizes, for a scan; of several, their sum, where the optimizer
    would take the product of the sides of a join."""
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    if leaves.size() == 1:
        return int(plan.stats().sizeInBytes())
    return sum(int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size()))


def ranges_for(df: DataFrame, bytes_each: int = 16 << 20, least: int = 12) -> int:
    """Ranges of keys to deal what ``df`` sends, so that each holds about ``bytes_each`` of input, at any size."""
    size = size_of(df)
    if size > 1 << 50:  # unknown: not a scan
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, size // bytes_each + 1)


def buckets_for(df: DataFrame, bytes_each: int = 16 << 20, least: int = 12) -> int:
    """Buckets of a table like ``df``: as many as Spark allows at most, whose rows are read one by one."""
    most = int(df.sparkSession.conf.get("spark.sql.sources.bucketing.maxBuckets", "100000"))
    return min(most, ranges_for(df, bytes_each, least))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


#: Keys that are dealt to several tasks at most, and the rows from which on one is.
HOT_KEYS, HOT_ROWS = 1000, 500


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16, how: str = "inner", every: bool = False) -> DataFrame:
    """Joins on keys of which a few may hold a large part of ``left``; ``right`` has a row for each key.
    A count finds the ``HOT_KEYS`` with the most rows; their rows go to ``salts`` tasks, and theirs alone
    are repeated in ``right``. Any other key holds less than one row in ``HOT_KEYS``. ``every``: without
    a count, where ``left`` is the dearer side by far, all of ``right`` is repeated."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    if every:
        copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return left.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")
    many = left.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") >= HOT_ROWS)
    hot = written(many.orderBy(F.col("_rows").desc()).limit(HOT_KEYS).select(*keys, F.lit(True).alias("_hot")), "hot")
    if hot.isEmpty():
        return left.join(right, keys, how)
    spread = left.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    each = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copies = right.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.explode(each)).drop("_hot")
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
