"""Benchmark decontamination as a prefix-filtered set join.

An item's windows (``width`` consecutive words, or the whole of a shorter item) are sets of word
shingles. All of a window's shingles must occur, so one of them suffices as its prefix: the
rarest over all documents. Documents are joined on that shingle alone; position and length
bounds place the window, and its words are compared exactly.

Documents are cut into chunks of ``CHUNK`` words, with enough words beside each that every window is whole in
the chunk of its prefix, so work and memory are linear in a text's length, however long it is.

The shingle table is broadcast while it has at most ``BROADCAST_ROWS`` rows; beyond, chunks are written and
only (shingle, row, place) are shuffled to a sort-merge join, in which common shingles are salted; what it
finds is joined back to the chunks and verified there. Null texts have no words; items without words are
left out; repeated rows each get their result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, salted_join, written

#: About 50 bytes each.
BROADCAST_ROWS = 1_000_000
CHUNK = 128
#: Characters between words (fixed values).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def shingle(ws: Column, at: Column, size: int) -> Column:
    return F.xxhash64(*[F.get(ws, at + k) for k in range(size)])


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """(item_id, win): an item's distinct windows, as arrays of words."""
    ws = items.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("ws") - width + 1, F.lit(1)))
    return ws.select("item_id", "ws", F.explode(starts).alias("s")).select("item_id", F.slice("ws", F.col("s"), F.lit(width)).alias("win")).distinct()


def chunks(docs: DataFrame, width: int) -> DataFrame:
    """(row, doc_id, n_words, c, base, ws): the words of chunk c and ``width`` on either side, from word ``base`` on."""
    n = F.size("ws")
    base = lambda c: F.greatest(c * CHUNK - width, F.lit(0))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / CHUNK).cast("int") - 1, F.lit(0))), lambda c: F.struct(
        c.alias("c"), base(c).alias("base"), F.slice("ws", base(c) + 1, CHUNK + 2 * width).alias("part")))
    texts = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("ws"))
    return texts.select("row", "doc_id", n.alias("n_words"), F.inline(parts)).withColumnRenamed("part", "ws")


def occurrences(docs: DataFrame, items: DataFrame, width: int = 10, size: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Documents (row, doc_id, n_words, found: array of (start, end, win_id)) and (win_id, item_id)."""
    owners = written(item_windows(items, width).withColumn("win_id", F.xxhash64("win")), "windows")
    windows = owners.select("win_id", "win").distinct().withColumn("n", F.size("win"))
    each = windows.select("win_id", "win", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size, F.lit(0)))).alias("off"))
    each = written(each.withColumn("token", shingle(F.col("win"), F.col("off"), size)), "shingles")
    small = [r[0] for r in each.where(F.col("n") < size).select("n").distinct().collect()]  # below ``size`` of them
    light = each.count() <= broadcast_rows
    near = (lambda df: F.broadcast(df)) if light else (lambda df: df.hint("merge"))
    parts = chunks(docs, width) if light else written(chunks(docs, width), "chunks")
    sizes = [size, *small]

    def tokens(df: DataFrame, first: int) -> DataFrame:
        """A row for each place of each chunk; place -1 of a document, if asked for, has token 0."""
        begin = F.when((F.col("c") == 0) & F.lit(first < 0), F.lit(-1)).otherwise((F.col("c") * CHUNK).cast("int"))
        end = F.least(F.col("c") * CHUNK + CHUNK, F.col("n_words")).cast("int") - 1
        places = F.when(end >= begin, F.sequence(begin, F.greatest(end, begin)))
        placed = df.withColumn("at", F.explode(places))
        made = [F.when(F.col("at") < 0, F.lit(0).cast("long")).otherwise(shingle(F.col("ws"), F.col("at") - F.col("base"), k)) for k in sizes]
        if len(made) == 1:
            return placed.withColumn("token", made[0])
        return placed.withColumn("token", F.explode(F.array_distinct(F.array(*made))))

    wanted = each.select("token").distinct()
    counts = tokens(parts, 0).select("token").join(near(wanted), "token").groupBy("token").agg(F.count("*").alias("df"))
    ranked = each.join(counts, "token", "left").groupBy("win_id", "win", "n").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("token"), F.col("off"))).alias("rare"))
    prefix = ranked.select(F.col("rare.token").alias("token"), "win_id", "win", "n", F.col("rare.off").alias("off"), F.col("rare.df").alias("df")).where("df > 0").drop("df")
    start = F.col("at") - F.col("off")
    if light:  # every document meets the row of token 0 once, so that one pass over the texts is enough
        blank = docs.sparkSession.range(1).select(
            F.lit(0).cast("long").alias("token"), F.lit(None).cast("long").alias("win_id"), F.lit(None).cast("array<string>").alias("win"), F.lit(0).alias("n"), F.lit(0).alias("off"))
        met = tokens(parts, -1).join(F.broadcast(written(prefix.unionByName(blank), "prefix")), "token").withColumn("start", start)
    else:
        prefix = written(prefix, "prefix")
        found = salted_join(tokens(parts, 0).select("row", "c", "at", "token"), prefix.drop("win"), ["token"], every=True).select("row", "c", "win_id", "n", start.alias("start"))
        met = parts.join(found.hint("merge"), ["row", "c"]).join(prefix.select("win_id", "win").hint("merge"), "win_id")
    inner = F.col("start") - F.col("base")
    whole = (F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("n_words")) & (F.slice("ws", F.greatest(inner + 1, F.lit(1)), F.col("n")) == F.col("win"))
    met = met.where(F.col("win_id").isNull() | whole).select("row", "doc_id", "n_words", F.when(
        F.col("win_id").isNotNull(), F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end"), F.col("win_id"))).alias("hit"))
    if not light:
        met = met.unionByName(parts.where("c = 0").select("row", "doc_id", "n_words", F.lit(None).cast(met.schema["hit"].dataType).alias("hit")))
    found = met.groupBy("row", "doc_id", "n_words").agg(F.collect_set("hit").alias("found"))
    return written(found, "found"), owners.select("win_id", "item_id").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 10, size: int = 3, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """For each document: n_words, n_hit (words inside an occurrence), item_ids, spans of words, contaminated."""
    found, owners = occurrences(docs, items, width, size, broadcast_rows)
    runs = F.aggregate(
        F.array_sort(F.transform("found", lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end")))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("reach")),
        lambda a, h: F.struct((a["n"] + F.greatest(h["end"] - F.greatest(h["start"], a["reach"]), F.lit(0))).cast("long").alias("n"), F.greatest(a["reach"], h["end"]).alias("reach")),
        lambda a: a["n"])
    pairs = found.where(F.size("found") > 0).select("row", F.explode(F.array_distinct(F.transform("found", lambda h: h["win_id"]))).alias("win_id"))
    few = owners.count() <= BROADCAST_ROWS
    of_items = pairs.join(F.broadcast(owners) if few else owners, "win_id").groupBy("row").agg(F.collect_set(F.col("item_id").cast("string")).alias("item_ids"))
    out = found.withColumn("n_hit", runs).join(of_items, "row", "left")
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.coalesce(F.array_sort("item_ids"), F.array().cast("array<string>")).alias("item_ids"),
                      F.transform(F.array_sort("found"), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias("spans"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
    return got.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                      F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def windows_sql(documents: str = "documents") -> str:
    """CTEs dw (documents' words) and hits (row, item_id, s, n), in DuckDB."""
    ws = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""
     dw AS (SELECT doc_id, row_number() OVER () AS rid, {ws} AS ws FROM {documents}),
     bw AS (SELECT item_id, {ws} AS ws FROM benchmark),
     win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS win
             FROM (SELECT *, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM bw WHERE len(ws) > 0)),
     lens AS (SELECT DISTINCT n FROM win),
     pos AS (SELECT rid, n, s, array_to_string(ws[s:s + n - 1], ' ') AS win
             FROM (SELECT dw.rid, dw.ws, lens.n, unnest(generate_series(1, len(dw.ws) - lens.n + 1)) AS s FROM dw JOIN lens ON len(dw.ws) >= lens.n)),
     hits AS (SELECT pos.rid, win.item_id, pos.s, pos.n FROM pos JOIN win ON pos.win = win.win AND pos.n = win.n)"""


OP5_SQL = f"""
WITH {windows_sql()},
     items AS (SELECT rid, count(DISTINCT item_id)::BIGINT AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY rid),
     words AS (SELECT rid, count(DISTINCT w)::BIGINT AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS w FROM (SELECT DISTINCT rid, s, n FROM hits)) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN items USING (rid) LEFT JOIN words USING (rid)
"""
