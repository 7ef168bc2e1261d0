"""Queries over pairs and pages: similarity, duplicates, syndication, clusters from texts, greedy dedup, phrases, articles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import pages as P
from claimloom.functions import similarity as M
from claimloom.functions import text as T
from claimloom.operators import evidence as E
from claimloom.operators import relations as L

#: Documents as evidence, eight to a claim: the first line is the title, the rest the content, the source names publisher and domain.
#: Every sixth document follows the one before it: as a reprint, under its title, with an agency, or citing its publisher.
ITEMS = """
SELECT CAST(floor(doc_id / 8) AS BIGINT) AS claim_id, doc_id AS ord, split_part(body, chr(10), 1) AS title,
  substr(body, length(split_part(body, chr(10), 1)) + 2) AS content, CAST(NULL AS STRING) AS snippet, concat('https://', lower(src), '.example/', doc_id % 500) AS canonical_url, concat(lower(src), '.example') AS domain, concat('Outlet ', src) AS publisher
FROM (SELECT doc_id, coalesce(source, '') AS src, CASE doc_id % 6 WHEN 1 THEN concat(coalesce(prior, ''), ' (Reuters)') WHEN 3 THEN concat(coalesce(text, ''), ' according to Outlet ', coalesce(prior_source, '')) WHEN 0 THEN concat(coalesce(text, ''), ' Reuters')
        ELSE coalesce(text, '') END AS body
      FROM (SELECT d.doc_id, d.source, d.text, p.text AS prior, p.source AS prior_source FROM documents AS d LEFT JOIN documents AS p ON p.doc_id = d.doc_id - 1))
"""


#: What ``ITEMS`` takes of a document and of the one before it: of each text one of the two, so that the join deals it once.
OWN = "(SELECT doc_id, source, CASE WHEN doc_id % 6 = 1 THEN NULL ELSE text END AS text FROM documents)"
PRIOR = "(SELECT doc_id, source, CASE WHEN doc_id >= 0 AND doc_id % 6 = 0 THEN text END AS text FROM documents)"


def items(spark, sf_dir):
    taken = ITEMS.replace("documents AS d", f"{OWN} AS d").replace("documents AS p", f"{PRIOR} AS p")
    return spark.sql(taken.replace("FROM documents)", f"FROM parquet.`{sf_dir}/documents.parquet`)"))


def source_relations(spark, sf_dir):
    return L.relations(items(spark, sf_dir))


def source_clusters(spark, sf_dir):
    given = items(spark, sf_dir)
    return L.source_clusters(given, L.relations(given))


#: Documents as retrieval results, twenty to a claim; titles are their first lines, so copies share them.
RESULTS = """SELECT CAST(floor(doc_id / 20) AS BIGINT) AS claim_id, doc_id AS ord, split_part(coalesce(text, ''), chr(10), 1) AS title, concat('https://a.example/', n_chars) AS canonical_url, source AS domain FROM documents"""


def evidence_dedup_greedy(spark, sf_dir):
    return E.dedup_greedy(spark.sql(RESULTS.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))).select("claim_id", "ord")


TITLE = r"trim(regexp_replace(regexp_replace(lower(title), '[^\p{L}\p{N}_\s]', '', 'g'), '\s+', ' ', 'g'))"
#: A row is kept if no kept row before it is like it; the recursion goes through a claim's rows in order.
GREEDY_SQL = rf"""
WITH RECURSIVE v AS ({RESULTS}), t AS (SELECT claim_id, ord, canonical_url, lower(domain) AS domain, {TITLE} AS t, row_number() OVER (PARTITION BY claim_id ORDER BY ord) AS n FROM v),
 w AS (SELECT *, list_distinct(list_filter(string_split(t, ' '), lambda x: x <> '')) AS ws FROM t),
 alike AS (SELECT b.claim_id, b.n AS later, a.n AS earlier FROM w a JOIN w b ON a.claim_id = b.claim_id AND a.n < b.n AND (a.canonical_url = b.canonical_url OR (a.t <> '' AND a.t = b.t)
   OR (a.domain <> '' AND a.domain = b.domain AND len(a.ws) > 0 AND len(b.ws) > 0 AND len(list_intersect(a.ws, b.ws)) >= 0.8 * (len(a.ws) + len(b.ws) - len(list_intersect(a.ws, b.ws)))))),
 lists AS (SELECT claim_id, later, list(earlier) AS earlier FROM alike GROUP BY ALL),
 r AS (SELECT claim_id, 0::BIGINT AS n, []::BIGINT[] AS kept FROM (SELECT DISTINCT claim_id FROM w)
       UNION ALL SELECT r.claim_id, r.n + 1, CASE WHEN l.earlier IS NOT NULL AND list_has_any(r.kept, l.earlier) THEN r.kept ELSE list_append(r.kept, r.n + 1) END
       FROM r JOIN w ON w.claim_id = r.claim_id AND w.n = r.n + 1 LEFT JOIN lists l ON l.claim_id = r.claim_id AND l.later = r.n + 1),
 f AS (SELECT claim_id, unnest(kept) AS n FROM r QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY n DESC) = 1)
SELECT f.claim_id, ord FROM f JOIN w ON w.claim_id = f.claim_id AND w.n = f.n
"""


def distinctive_phrases(spark, sf_dir):
    """Of neighbouring documents, the word sequences both hold. Texts are dealt and sorted as they are, once for each side; sequences are
    made where the neighbours meet, so they are neither shuffled nor sorted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def sequences(side, name):
        dealt = side.repartition("doc_id").sortWithinPartitions("doc_id").select("doc_id", T.words(F.col("text")).alias("ws"))
        return dealt.select("doc_id", *[T.word_ngrams(F.col("ws"), n).alias(f"{name}{n}") for n in M.PHRASE_WORDS])

    a, b = sequences(docs, "g"), sequences(docs.select((F.col("doc_id") - 1).alias("doc_id"), "text"), "h")
    got = a.hint("merge").join(b, "doc_id").select("doc_id", M.phrases([F.col(f"g{n}") for n in M.PHRASE_WORDS], [F.col(f"h{n}") for n in M.PHRASE_WORDS]).alias("p"))
    return got.select("doc_id", F.size("p").cast("long").alias("n_phrases"), F.array_join("p", "|").alias("phrases"))


def _words_sql():
    sim = r"trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    return f"list_filter(string_split({sim}, ' '), lambda w: w <> '')"


PHRASES_SQL = f"""
WITH w AS (SELECT doc_id, {_words_sql()} AS ws FROM documents), n AS (SELECT unnest([6, 5]) AS n),
 g AS (SELECT doc_id, n, s, array_to_string(ws[s : s + n - 1], ' ') AS g FROM (SELECT doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS s FROM w, n)),
 a AS (SELECT doc_id, n, g, min(s) AS s FROM g GROUP BY ALL), m AS (SELECT a.doc_id, a.n, a.s, a.g FROM a SEMI JOIN g ON g.doc_id = a.doc_id + 1 AND g.n = a.n AND g.g = a.g),
 r AS (SELECT doc_id, list(g ORDER BY n DESC, s)[1:5] AS p FROM m GROUP BY 1)
SELECT x.doc_id, coalesce(len(p), 0)::BIGINT AS n_phrases, coalesce(array_to_string(p, '|'), '') AS phrases FROM w x LEFT JOIN r USING (doc_id) WHERE EXISTS (SELECT 1 FROM w y WHERE y.doc_id = x.doc_id + 1)
"""


def page_articles(spark, sf_dir):
    """Metadata and article text of all pages."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", P.extract(F.col("url"), F.col("html")).alias("a")).select("page_id", "a.*")


QUERIES = {"source_relations": source_relations, "source_clusters": source_clusters, "evidence_dedup_greedy": evidence_dedup_greedy, "distinctive_phrases": distinctive_phrases, "page_articles": page_articles}
#: Sequence similarity and nested HTML have no SQL form: the other three are tested against brute force and fixtures.
ORACLES = {"evidence_dedup_greedy": GREEDY_SQL, "distinctive_phrases": PHRASES_SQL}
