"""Queries and DuckDB oracles of verb families, over a lexicon that the benchmark passages make.

A stand-in for a dictionary, of which only the shape matters: words of five letters and more are senses of their endings and of their beginnings of four letters; an
ending leads to its last three letters, which words of four letters name, and these to their last two, named by words of three.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import lexicon as W
from claimloom.functions import text as T
from claimloom.operators import evidence as E
from claimloom.operators import families as V


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lexicon(spark, sf_dir):
    """Senses and parents; read several times, so held."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(W.letters(F.col("text"))).alias("lemma")).where(F.length("lemma") >= 3).distinct().persist()
    sense = lambda size, synset, rank: words.where(size).select("lemma", synset.alias("synset"), F.lit(rank).alias("rank"))
    n, end = F.length("lemma"), lambda k: F.concat(F.lit(f"e{k}"), F.substring("lemma", -k, k))
    senses = sense(n >= 5, end(4), 0).unionByName(sense(n >= 5, F.concat(F.lit("b"), F.substring("lemma", 1, 4)), 1)).unionByName(sense(n == 4, end(3), 0)).unionByName(sense(n == 3, end(2), 0))
    parents = words.where(n >= 5).select(end(4).alias("synset"), end(3).alias("parent")).unionByName(words.where(n >= 4).select(end(3).alias("synset"), end(2).alias("parent"))).distinct()
    return V.expansions(senses, parents).persist()


def actions(spark, sf_dir):
    """(item_id, action): a passage's longest word, the first by name."""
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(W.letters(F.col("text"))).alias("word"))
    return words.groupBy("item_id").agg(F.min(F.struct((-F.length("word")).alias("n"), "word"))["word"].alias("action"))


def verb_families(spark, sf_dir):
    """Words of a passage that its action is related to."""
    acts = actions(spark, sf_dir)
    words = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.array_distinct(W.letters(F.col("text")))).alias("b")).where("length(b) > 2")
    pairs = acts.join(words, "item_id").select("item_id", F.col("action").alias("a"), "b")
    return pairs.join(V.related(pairs, lexicon(spark, sf_dir)), ["a", "b"]).select("item_id", "a", "b")


def family_signals(spark, sf_dir):
    """Sentences of documents with a word of the families of every fourth passage's action."""
    reference = actions(spark, sf_dir).where(F.col("item_id") % 4 == 0).select(F.col("action").alias("word"))
    texts = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "text")).withColumn("n", F.col("n").cast("long"))
    return V.family_signals(texts, ["doc_id", "n"], reference, lexicon(spark, sf_dir))


def action_evidence(spark, sf_dir):
    """How the most relevant documents bear out the passages' actions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    top = E.relevant_documents(table(spark, sf_dir, "benchmark").select("item_id", "text"), docs).select("item_id", "doc_id")
    asked = E.beside(top.join(actions(spark, sf_dir), "item_id")).join(docs, "doc_id")
    return V.action_matches(asked.select("item_id", "doc_id", "action", "text"), lexicon(spark, sf_dir), ["item_id", "doc_id"])


_WORDS = r"string_split_regex(lower(text), '[^\p{L}\p{N}_]+')"
_GENERIC = ", ".join(f"'{w}'" for w in V.GENERIC)
LEXICON = f"""bw AS (SELECT item_id, unnest({_WORDS}) AS w FROM benchmark), lw AS (SELECT DISTINCT w FROM bw WHERE length(w) >= 3),
 se AS (SELECT w, 'e4' || right(w, 4) AS s FROM lw WHERE length(w) >= 5 UNION ALL SELECT w, 'b' || left(w, 4) FROM lw WHERE length(w) >= 5 UNION ALL SELECT w, 'e3' || right(w, 3) FROM lw WHERE length(w) = 4 UNION ALL SELECT w, 'e2' || right(w, 2) FROM lw WHERE length(w) = 3),
 pa AS (SELECT DISTINCT 'e4' || right(w, 4) AS s, 'e3' || right(w, 3) AS p FROM lw WHERE length(w) >= 5 UNION SELECT 'e3' || right(w, 3), 'e2' || right(w, 2) FROM lw WHERE length(w) >= 4),
 syn AS (SELECT DISTINCT a.w, b.w AS o FROM se a JOIN se b USING (s)), hyp AS (SELECT DISTINCT a.w, b.w AS o FROM se a JOIN pa USING (s) JOIN se b ON b.s = pa.p), one AS (SELECT * FROM hyp WHERE o NOT IN ({_GENERIC})),
 abv AS (SELECT * FROM one UNION SELECT a.w, b.o FROM one a JOIN one b ON a.o = b.w), led AS (SELECT w, o FROM syn UNION SELECT w, o FROM hyp UNION SELECT w, o FROM abv), act AS (SELECT item_id, w AS action FROM bw QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) = 1)"""
_PAIR = f"""rel AS (SELECT w AS a, o AS b FROM led UNION SELECT o, w FROM led UNION SELECT x.w, y.w FROM one x JOIN one y ON x.o = y.o)"""
FAMILIES_SQL = f"""WITH {LEXICON}, {_PAIR} SELECT DISTINCT item_id, action AS a, w AS b FROM act JOIN bw USING (item_id)
 WHERE length(w) > 2 AND (action = w OR (action NOT IN ({_GENERIC}) AND w NOT IN ({_GENERIC}) AND (action, w) IN (SELECT a, b FROM rel)))"""
SIGNALS_SQL = rf"""
WITH {LEXICON}, ref AS (SELECT DISTINCT action AS w FROM act WHERE item_id % 4 = 0), sur AS (SELECT w FROM ref UNION SELECT o FROM syn WHERE w IN (SELECT w FROM ref)),
 fam AS (SELECT w FROM led WHERE o NOT IN ({_GENERIC}) AND o IN (SELECT w FROM sur) UNION SELECT w FROM sur WHERE w NOT IN ({_GENERIC})),
 s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) > 5) AS ss FROM documents),
 s AS (SELECT doc_id, unnest(ss) AS text, unnest(generate_series(0, len(ss) - 1)) AS n FROM s0), w AS (SELECT doc_id, n, unnest({_WORDS}) AS w FROM s)
SELECT doc_id, n, min(w) AS word FROM w WHERE length(w) > 2 AND w IN (SELECT w FROM fam) GROUP BY doc_id, n
"""


def action_sql(top):
    """``top``: SQL of the retrieval with item_id and doc_id."""
    return rf"""
WITH {LEXICON}, {_PAIR}, top AS (SELECT item_id, doc_id FROM ({top})), j AS (SELECT item_id, doc_id, action, list_distinct({_WORDS}) AS ws FROM top JOIN act USING (item_id) JOIN documents USING (doc_id)),
 u AS (SELECT item_id, doc_id, action, unnest(list_filter(ws, lambda x: length(x) > 2)) AS w FROM j), k AS (SELECT item_id, doc_id, bool_or((action, w) IN (SELECT w, o FROM syn)) AS s, bool_or(action NOT IN ({_GENERIC}) AND w NOT IN ({_GENERIC}) AND w IN (SELECT w FROM syn) AND (action, w) IN (SELECT a, b FROM rel)) AS r FROM u GROUP BY ALL)
SELECT item_id, doc_id, CASE WHEN list_contains(ws, action) THEN 'verbatim' WHEN s THEN 'synonym' WHEN r THEN 'related' END AS tier FROM j LEFT JOIN k USING (item_id, doc_id)
"""


QUERIES = {"verb_families": verb_families, "family_signals": family_signals, "action_evidence": action_evidence}
#: action_evidence gets its oracle in ``catalog``, which has the retrieval's.
ORACLES = {"verb_families": FAMILIES_SQL, "family_signals": SIGNALS_SQL}
