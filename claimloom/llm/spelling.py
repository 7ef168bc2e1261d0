"""Spelling variants by pairless wildcard groups.

Words that differ by one replaced code point share a wildcard: the word with that place left open. A group of a
wildcard keeps its size and its two most frequent words, which is all that its members need: size less one
near words, the best of them the first, or the second for the first itself. A deleted code point gives a
string that is looked up in the vocabulary; both ends of such a hit count one near word. The counts and
bests of a word's groups and hits are summed up without pairs.

Words are numbered in code-point order, so keys travel with two longs. A group holds at most one word for each
letter of the alphabet, so none is large. Words of up to ``LONG`` code points have their wildcards and deletions
as strings; longer ones, which would need the square of their length, have digests of what lies before and after a
place, made in one pass. A long word's deletion is looked up among the gaps of the words one shorter.

Null texts have no words and a null doc_id hashes as an empty string; repeated rows count each. Texts are cut
between runs into pieces of ``PIECE`` code points, so a very long one isn't held as one list of words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import LOWER, UPPER, ascii_lower, salted_join, written
from .mixing import running

RUN = "[a-zÀ-ÿ]"
PIECE, LONG = 1 << 16, 256
#: Stands in a wildcard for the open place; no word holds it.
OPEN = "\0"


def without_place(word: Column, at: Column, between: str = "") -> Column:
    """``word`` without the code point at ``at`` (from 0)."""
    return F.concat(F.substring(word, F.lit(1), at), F.lit(between), F.substring(word, at + 2, F.length(word)))


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): the lower-cased runs of letters."""
    pieces = docs.select("doc_id", F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"(?s).{{1,{PIECE}}}+{RUN}*+"), F.lit(0))).alias("piece"))
    return pieces.select("doc_id", F.explode(F.regexp_extract_all("piece", F.lit(f"{RUN}+"), F.lit(0))).alias("run"))


def mistyped(doc_id: Column, run: Column, one_in: int = 97) -> Column:
    """``run``, of which one in ``one_in`` loses a code point, by a hash of doc_id and run."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    return F.when(h % one_in == 0, without_place(run, (h % F.length(run)).cast("int"))).otherwise(run)


def vocabulary(words: DataFrame, least_length: int = 5, least_n: int = 3) -> DataFrame:
    """(no, word, n): words by number, in code-point order."""
    counted = words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)
    placed, _ = running(written(counted, "counted"), [F.col("word")], {"no": F.lit(1)}, "order")
    return written(placed.select(F.col("no_before").alias("no"), "word", "n"), "vocabulary")


def _long_keys(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(kind, key, no, n) of words of ``LONG`` code points or more, in time and memory in proportion to their length."""
    def digests(units: list[bytes]) -> list[bytes]:
        state, out = hashlib.sha256(), [b""]
        for u in units:
            state.update(u)
            out.append(state.digest())
        return out

    for frame in rows:
        for no, word, n in frame.itertuples(index=False):
            units = [c.encode() for c in word]
            size = len(units)
            before, after = digests(units), digests(units[::-1])[::-1]  # of the first k, of those from k on
            part = lambda k, j: before[k] + b"|" + after[j] + k.to_bytes(8, "big")  # noqa: B023, E731
            made = [("whole", part(k, k)) for k in range(size + 1)]
            if size > LONG:
                made += [("open", part(k, k + 1)) for k in range(size)]
                made += [("less", part(k, k + 1)) for k in range(size) if not k or units[k] != units[k - 1]]
            yield pd.DataFrame({"kind": [m[0] for m in made], "key": [m[1] for m in made], "no": no, "n": n})


def keyed(words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, no, n) three times: wildcards, deletions, and what deletions are looked up in."""
    size = F.length("word")
    short = words.where(size <= LONG)
    places = F.sequence(F.lit(0), size - 1)
    opened = short.select(F.explode(F.transform(places, lambda k: without_place(F.col("word"), k, OPEN))).alias("key"), "no", "n")
    less = short.select(F.explode(F.array_distinct(F.transform(places, lambda k: without_place(F.col("word"), k)))).alias("key"), "no", "n")
    whole = words.where(size < LONG).select(F.col("word").alias("key"), "no", "n")
    long = words.where(size >= LONG).select("no", "word", "n").mapInPandas(_long_keys, "kind string, key binary, no long, n long")
    if words.where(size >= LONG).isEmpty():
        long = long.limit(0)
    else:
        long = written(long, "long")
    joined = lambda df, kind: df.withColumn("key", F.col("key").cast("binary")).unionByName(long.where(F.col("kind") == kind).drop("kind"))
    return joined(opened, "open"), joined(less, "less"), joined(whole, "whole")


def near_words(words: DataFrame) -> DataFrame:
    """(no, n_near, best): how many words are near word ``no`` and the best of them, as (-n, no), if there are any."""
    opened, less, whole = keyed(words)
    me = F.struct((-F.col("n")).alias("less_n"), F.col("no"))
    group = Window.partitionBy("key")
    ordered = group.orderBy("me").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = opened.select("key", "no", me.alias("me")).select(
        "no", "me", F.count("*").over(ordered).alias("size"), F.first("me").over(ordered).alias("first"), F.nth_value("me", 2).over(ordered).alias("second")).where("size > 1")
    replaced = groups.select("no", (F.col("size") - 1).alias("count"), F.when(F.col("me") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("best"))
    hits = less.select("key", F.col("no").alias("longer"), me.alias("longer_me")).join(whole.select("key", F.col("no").alias("shorter"), me.alias("shorter_me")), "key")
    ends = hits.select(F.explode(F.array(F.struct(F.col("longer").alias("no"), F.col("shorter_me").alias("best")), F.struct(F.col("shorter").alias("no"), F.col("longer_me").alias("best")))).alias("end"))
    indels = ends.select("end.no", F.lit(1).cast("long").alias("count"), "end.best")
    return replaced.unionByName(indels).groupBy("no").agg(F.sum("count").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(no, root) of (no, form): forms have larger n, at least twice, so there is no circle and doubling the reach ends
    after as many rounds as the logarithm of the longest way."""
    now = written(forms.select("no", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("no").alias("root"), F.col("root").alias("next"))
        step = written(salted_join(now, on, ["root"], how="left").select("no", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.drop("moved")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, one_in: int = 97, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``docs`` (doc_id, text)."""
    words = vocabulary(runs(docs).select(mistyped(F.col("doc_id"), F.col("run"), one_in).alias("word")), least_length, least_n)
    near = written(words.join(near_words(words), "no", "left"), "near")
    ok = -F.col("best.less_n") >= times * F.col("n")
    formed = near.select("no", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(ok, F.col("best.no")).alias("form"), F.when(ok, -F.col("best.less_n")).cast("long").alias("form_n"))
    last = roots(formed.where(F.col("form").isNotNull()))
    named = words.select(F.col("no").alias("form"), F.col("word").alias("form_word"))
    ends = words.select(F.col("no").alias("root"), F.col("word").alias("root_word"))
    linked = formed.where(F.col("form").isNotNull()).join(last, "no")
    linked = salted_join(salted_join(linked, named, ["form"]), ends, ["root"])
    alone = formed.where(F.col("form").isNull()).select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return alone.unionByName(linked.select("word", F.col("form_word").alias("form"), F.col("root_word").alias("root"), "n", "n_near", "form_n"))


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


#: The table of crc32, for DuckDB, which has no such function.
_CRC = str([zlib.crc32(bytes([k ^ 255])) ^ 0xFF000000 for k in range(256)])

OP13_SQL = rf"""
WITH t AS (SELECT doc_id, run, count(*)::BIGINT AS c FROM (
            SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents) GROUP BY ALL),
     b AS (SELECT run, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''),
                  lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)] ELSE [195, ord(x) - 64] END)) AS bytes FROM t),
     h AS (SELECT run, c, xor(4294967295, list_reduce(list_transform(bytes, lambda x: x::BIGINT),
                  lambda s, x: xor(({_CRC}::BIGINT[])[(xor(s, x) & 255) + 1], s >> 8), 4294967295::BIGINT)) AS h FROM b),
     m AS (SELECT CASE WHEN h % 97 = 0 THEN run[:h % len(run)] || run[h % len(run) + 2:] ELSE run END AS word, c FROM h),
     v AS (SELECT word, sum(c)::BIGINT AS n FROM m WHERE len(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
     p AS (SELECT word, n, unnest(generate_series(1, len(word))) AS k FROM v),
     o AS (SELECT word, n, word[:k - 1] || chr(1) || word[k + 1:] AS key FROM p),
     d AS (SELECT DISTINCT word, n, word[:k - 1] || word[k + 1:] AS key FROM p),
     near AS (SELECT a.word, b.word AS other, b.n FROM o a JOIN o b ON a.key = b.key AND a.word <> b.word
              UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON d.key = v.word
              UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON d.key = v.word),
     g AS (SELECT word, count(*)::BIGINT AS n_near, min({{'less': -n, 'word': other}}) AS best FROM near GROUP BY word),
     f AS (SELECT v.word, v.n, coalesce(g.n_near, 0) AS n_near, CASE WHEN -g.best.less >= 2 * v.n THEN g.best.word END AS form,
                  CASE WHEN -g.best.less >= 2 * v.n THEN -g.best.less END AS form_n FROM v LEFT JOIN g USING (word)),
     way AS (WITH RECURSIVE w AS (SELECT word, word AS root FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.root = f.word WHERE f.form IS NOT NULL)
             SELECT w.word, w.root FROM w JOIN f ON w.root = f.word WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n FROM f JOIN way USING (word)
"""
