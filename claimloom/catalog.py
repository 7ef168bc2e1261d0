"""All registered queries and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import catalog_checks, catalog_claims, catalog_families, catalog_relations, catalog_report, catalog_signals, catalog_text
from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import evidence as E
from claimloom.operators import factchecks as FC
from claimloom.operators import scoring as C
from claimloom.operators import sources as S


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


SIM = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
WORDS = "list_filter(string_split(" + SIM + ", ' '), lambda w: w <> '')"
CONTENT = "list_distinct(list_filter(string_split(" + SIM + f", ' '), lambda w: len(w) > 1 AND w NOT IN ({quoted(T.STOP_WORDS)})))"


def claim_evidence_topk(spark, sf_dir):
    return E.relevant_documents(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


CLAIM_EVIDENCE_SQL = f"""
WITH d AS (SELECT doc_id, {CONTENT.format('text')} AS ws FROM documents), c AS (SELECT item_id, {CONTENT.format('text')} AS ws FROM benchmark),
     dt AS (SELECT doc_id, len(ws) AS nd, unnest(ws) AS w FROM d), ct AS (SELECT item_id, len(ws) AS nc, unnest(ws) AS w FROM c),
     m AS (SELECT item_id, doc_id, nc, nd, count(*) AS common FROM dt JOIN ct USING (w) GROUP BY ALL),
     s AS (SELECT *, round(least(1.0, common::DOUBLE / (nc + nd - common) * 2.5 + common::DOUBLE / nc * 0.5), 6) AS relevance FROM m),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY relevance DESC, doc_id) AS rank FROM s)
SELECT item_id, doc_id, common, relevance, rank::INTEGER AS rank FROM r WHERE rank <= 3
"""


def text_normalize(spark, sf_dir):
    clean = T.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", T.digest(clean).alias("digest"), F.length(clean).cast("long").alias("n_chars_clean"))


TEXT_NORMALIZE_SQL = r"""
WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}\x{200E}\x{200F}\x{202A}-\x{202E}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{00A0}]+', ' ', 'g') AS t FROM documents),
     b AS (SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM a)
SELECT doc_id, sha256(t) AS digest, length(t)::BIGINT AS n_chars_clean FROM b
"""


def token_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.size(F.array_distinct(T.words(F.col("text"), False))).cast("long").alias("n_content_words"))


TOKEN_COUNTS_SQL = f"SELECT doc_id, len({WORDS.format('text')})::BIGINT AS n_words, len({CONTENT.format('text')})::BIGINT AS n_content_words FROM documents"


def sentence_split(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s")).select("doc_id", F.col("n").cast("long").alias("n"), T.digest(F.col("s")).alias("digest"))


SENTENCE_SPLIT_SQL = r"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) > 5) AS ss FROM documents),
     e AS (SELECT doc_id, unnest(ss) AS s, unnest(generate_series(0, len(ss) - 1)) AS n FROM s)
SELECT doc_id, n, sha256(s) AS digest FROM e
"""


def keyword_extract(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


KEYWORD_SQL = f"""SELECT item_id, array_to_string(list_filter(regexp_extract_all(text, '[A-Za-z0-9$%€₹-]+'), lambda w: len(w) > 1 AND lower(w) NOT IN ({quoted(T.QUERY_STOP_WORDS)}))[1:8], ' ') AS keywords FROM benchmark"""


def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.canonical(F.col("url")).alias("canonical_url"), U.domain(F.col("url")).alias("domain"))


CANONICAL_SQL = rf"""
WITH p AS (SELECT page_id, trim(url) AS u, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme,
                  lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host FROM pages),
     q AS (SELECT *, CASE scheme WHEN 'http' THEN regexp_replace(host, ':80$', '') WHEN 'https' THEN regexp_replace(host, ':443$', '') ELSE host END AS h,
                  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS path,
                  string_split(regexp_extract(u, '\?([^#]*)', 1), '&') AS pairs FROM p),
     k AS (SELECT page_id, unnest(pairs) AS pair, unnest(generate_series(1, len(pairs))) AS nth FROM q),
     g AS (SELECT page_id, string_agg(regexp_extract(pair, '^([^=]*)', 1) || '=' || regexp_extract(pair, '^[^=]*=(.*)$', 1), '&' ORDER BY regexp_extract(pair, '^([^=]*)', 1), nth) AS query
           FROM k WHERE regexp_extract(pair, '^[^=]*=(.*)$', 1) <> '' AND lower(regexp_extract(pair, '^([^=]*)', 1)) NOT IN ({quoted(U.TRACKING)}) GROUP BY page_id)
SELECT page_id, scheme || '://' || h || CASE WHEN length(path) > 1 THEN regexp_replace(path, '/+$', '') ELSE path END || CASE WHEN query IS NULL THEN '' ELSE '?' || query END AS canonical_url,
       regexp_replace(host, '^www\.', '') AS domain FROM q LEFT JOIN g USING (page_id)
"""


def evidence_dedup_exact(spark, sf_dir):
    pages = canonical_url(spark, sf_dir)
    return E.first_wins(pages, "canonical_url", "page_id").select("page_id", "canonical_url")


DEDUP_SQL = f"WITH c AS ({CANONICAL_SQL}) SELECT min(page_id) AS page_id, canonical_url FROM c GROUP BY canonical_url"

DOMAINS = ["www.cdc.gov", "PIB.nic.in", "mod.gov.uk", "army.mil", "mit.edu", "ox.ac.uk", "who.int", "me.substack.com", "medium.com", "wwf.org", "ngo.org.in", "example.com", ""]


def domain_category(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in DOMAINS], "domain string").unionByName(canonical_url(spark, sf_dir).select("domain").distinct())
    return given.select("domain", U.category(F.col("domain")).alias("category"))


DOMAIN_SQL = rf"""
WITH g AS (SELECT unnest([{quoted(DOMAINS)}]) AS domain UNION ALL SELECT DISTINCT domain FROM ({CANONICAL_SQL})), d AS (SELECT domain, regexp_replace(lower(trim(domain)), '^www\.', '') AS k FROM g)
SELECT domain, CASE WHEN k = '' THEN 'UNKNOWN' WHEN regexp_matches(k, '(\.gov(\.[a-z]{{2}})?$)|(\.nic\.in$)|(\.mil(\.[a-z]{{2}})?$)') THEN 'GOVERNMENT'
  WHEN regexp_matches(k, '(\.edu(\.[a-z]{{2}})?$)|(\.ac\.[a-z]{{2,}}$)') THEN 'ACADEMIC' WHEN regexp_matches(k, '\.int$') THEN 'INTERNATIONAL_ORGANIZATION'
  WHEN regexp_matches(k, '(^|\.)({'|'.join(b.replace('.', chr(92) + '.') for b in U.BLOG_HOSTS)})$') THEN 'PERSONAL_BLOG'
  WHEN k LIKE '%.org' OR k LIKE '%.org.in' THEN 'ORGANIZATION' ELSE 'UNKNOWN' END AS category FROM d
"""


def content_ids(spark, sf_dir):
    bare = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}_]", "")
    return table(spark, sf_dir, "documents").select("doc_id", U.content_id("claim_", bare, size=10).alias("claim_key"), U.content_id("ev_web_", F.lit("web"), F.col("text")).alias("evidence_id"))


CONTENT_IDS_SQL = r"""SELECT doc_id, 'claim_' || substr(sha256(regexp_replace(lower(text), '[^\p{L}\p{N}_]', '', 'g')), 1, 10) AS claim_key, 'ev_web_' || substr(sha256('web' || text), 1, 12) AS evidence_id FROM documents"""


def trigram_similarity(spark, sf_dir):
    """Benchmark passages against the documents that hold one of their word trigrams."""
    return E.trigram_matches(table(spark, sf_dir, "benchmark").select("item_id", "text"), table(spark, sf_dir, "documents").select("doc_id", "text"))


TRIGRAM_SQL = f"""
WITH dw AS (SELECT doc_id, {WORDS.format('text')} AS ws FROM documents), bw AS (SELECT item_id, {WORDS.format('text')} AS ws FROM benchmark),
     dg AS (SELECT DISTINCT doc_id, ws[s] || ' ' || ws[s + 1] || ' ' || ws[s + 2] AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - 2)) AS s FROM dw)),
     bg AS (SELECT DISTINCT item_id, ws[s] || ' ' || ws[s + 1] || ' ' || ws[s + 2] AS g FROM (SELECT *, unnest(generate_series(1, len(ws) - 2)) AS s FROM bw)),
     dn AS (SELECT doc_id, count(*) AS nd FROM dg GROUP BY 1), bn AS (SELECT item_id, count(*) AS ni FROM bg GROUP BY 1),
     m AS (SELECT item_id, doc_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2)
SELECT item_id, doc_id, shared, round(shared::DOUBLE / (ni + nd - shared), 6) AS similarity FROM m JOIN dn USING (doc_id) JOIN bn USING (item_id)
"""

EVIDENCE_VIEW = """
SELECT doc_id, 'title ' || doc_id AS title, CASE WHEN doc_id % 5 > 0 THEN source END AS publisher, CASE WHEN doc_id % 3 > 0 THEN 'https://a.example/' || doc_id END AS canonical_url,
       CASE WHEN doc_id % 7 > 0 THEN t END AS content, CAST(NULL AS {string}) AS snippet, CASE WHEN doc_id % 4 = 0 THEN '2024-01-01' WHEN doc_id % 4 = 2 THEN '2024-05-20T10:00:00Z' END AS published_at, CASE WHEN doc_id % 4 = 0 THEN 'A' END AS author,
       CASE WHEN doc_id % 6 = 0 THEN 'GOVERNMENT' WHEN doc_id % 6 = 1 THEN 'PERSONAL_BLOG' ELSE 'UNKNOWN' END AS category, CASE WHEN doc_id % 11 = 0 THEN CAST(95.0 AS DOUBLE) END AS reputation FROM ({planted})
"""
PLANTED = catalog_signals.PLANTED.replace("SELECT doc_id", "SELECT doc_id, source")
AS_OF = 1_717_200_000


def source_reliability(spark, sf_dir):
    """Sources of documents, judged by their texts' own signals."""
    given = spark.sql(EVIDENCE_VIEW.format(string="STRING", planted=PLANTED).replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))
    return S.profile(given, AS_OF).select("doc_id", "meta_score", "transparency", "reliability", "label", F.array_join("positive", "|").alias("positive"), F.array_join("lacking", "|").alias("lacking"))


RELIABILITY_SQL = f"""
WITH sig AS (SELECT doc_id, attributed AS at0, has_quotes AS hq, named AS nm, signals AS sg FROM ({catalog_signals.SOURCE_SIGNALS_SQL})),
     v AS (SELECT e.*, at0 AND content IS NOT NULL AS attributed, hq AND content IS NOT NULL AS quoted, content IS NOT NULL AND nm <> '' AS named_source, CASE WHEN content IS NULL OR sg = '' THEN 0 ELSE len(string_split(sg, ',')) END AS primary_signals, nm, sg
           FROM ({EVIDENCE_VIEW.format(string='VARCHAR', planted=PLANTED)}) e JOIN sig USING (doc_id)),
     p AS (SELECT *, coalesce(trim(title), '') <> '' AS t, coalesce(trim(publisher), '') <> '' AS pb, coalesce(trim(canonical_url), '') <> '' AS cu, coalesce(length(trim(content)), 0) >= 20 AS co,
                  coalesce(published_at, '') <> '' AS pa, coalesce(author, '') <> '' AS au FROM v),
     m AS (SELECT *, round(0.2::DOUBLE * t::INT + 0.2::DOUBLE * pb::INT + 0.2::DOUBLE * cu::INT + 0.2::DOUBLE * co::INT + 0.1::DOUBLE * pa::INT + 0.1::DOUBLE * au::INT, 2) AS meta_score FROM p),
     x AS (SELECT *, CASE WHEN pb AND cu AND co AND au AND pa THEN 'HIGH' WHEN pb AND (cu OR co) THEN 'MEDIUM' WHEN meta_score >= 0.3 THEN 'LOW' ELSE 'UNKNOWN' END AS transparency FROM m),
     r AS (SELECT *, (CASE transparency WHEN 'HIGH' THEN 100.0 WHEN 'MEDIUM' THEN 65.0 WHEN 'LOW' THEN 30.0 ELSE 10.0 END)::DOUBLE * 0.25::DOUBLE + meta_score * 100 * 0.2::DOUBLE
                  + (CASE WHEN NOT attributed THEN 30 ELSE least(60 + 20 * quoted::INT + 20 * named_source::INT, 100) END)::DOUBLE * 0.2::DOUBLE
                  + coalesce(reputation, CASE category WHEN 'GOVERNMENT' THEN 90 WHEN 'PERSONAL_BLOG' THEN 35 ELSE 45 END)::DOUBLE * 0.2::DOUBLE
                  + (CASE WHEN primary_signals = 0 THEN 40 ELSE least(70 + primary_signals * 15, 100) END)::DOUBLE * 0.15::DOUBLE AS raw FROM x),
     s AS (SELECT *, greatest(0, least(100, round_even(round(raw, 6), 0)::INTEGER)) AS reliability FROM r)
SELECT doc_id, meta_score, transparency, reliability, CASE WHEN reliability >= 75 THEN 'HIGH' WHEN reliability >= 50 THEN 'MEDIUM' WHEN meta_score <= 0.2 AND category = 'UNKNOWN' THEN 'UNKNOWN' ELSE 'LOW' END AS label,
  concat_ws('|', 'Publisher clearly identified (' || CASE WHEN pb THEN publisher END || ')', CASE WHEN category = 'GOVERNMENT' THEN 'Official institutional or regulatory source' END, CASE WHEN au THEN 'Named author byline (' || author || ')' END,
    CASE WHEN pa THEN 'Publication timestamp clearly recorded' END, CASE WHEN published_at LIKE '2024-05-20%' THEN 'Recent publication date (within last 30 days)' END, CASE WHEN attributed AND quoted THEN 'Contains direct quoted statements' END,
    CASE WHEN attributed AND named_source THEN 'Attributes claims to cited sources (' || replace(nm, ',', ', ') || ')' END, CASE WHEN primary_signals > 0 THEN 'Firsthand reporting indicators detected (' || replace(sg, ',', ', ') || ')' END) AS positive,
  concat_ws('|', CASE WHEN NOT pb THEN '{S.LACKS['publisher']}' END, CASE WHEN category = 'PERSONAL_BLOG' THEN '{S.BLOG}' END, CASE WHEN NOT au THEN '{S.LACKS['author']}' END, CASE WHEN NOT pa THEN '{S.LACKS['date']}' END,
    CASE WHEN NOT attributed THEN '{S.LACKS['attribution']}' END, CASE WHEN NOT co THEN '{S.LACKS['content']}' END) AS lacking FROM s
"""

RATING_ROWS = [
    *E.RATINGS, " Mostly True ", "FALSE", "Four Pinocchios", "", "Rated false by our team", "This is a hoax", "Mostly true, with caveats", "It distorts", "Mostly false claim", "false, partially", "Half is correct",
    "Confirmed by us", "Lacks context", "Mostly fake news", "half and half", "Disputed by many",
]


def rating_map(spark, sf_dir):
    """Ratings as they stand at the end of a review's snippet."""
    snippet = F.concat(F.lit("Reviewed. Rating: "), F.element_at(F.array(*[F.lit(x) for x in RATING_ROWS]), (F.col("doc_id") % len(RATING_ROWS) + 1).cast("int")), F.lit(".\n"), F.coalesce("text", F.lit("")))
    given = table(spark, sf_dir, "documents").select("doc_id", snippet.alias("snippet"), F.lit(None).cast("map<string,string>").alias("metadata"))
    return E.rate(given.select("doc_id", FC.raw_rating().alias("rating")))


RATING_SQL = f"""
WITH g AS (SELECT doc_id, trim(rating) AS rating FROM (SELECT doc_id, [{quoted(RATING_ROWS)}][doc_id % {len(RATING_ROWS)} + 1] AS rating FROM documents)), t AS (SELECT * FROM (VALUES {', '.join("('%s', '%s', '%s')" % (k, *v) for k, v in E.RATINGS.items())}) AS v(k, verdict, stance)),
 r AS (SELECT doc_id, rating, lower(rating) AS c FROM g), h AS (SELECT doc_id, rating, c, CASE
  WHEN regexp_matches(c, 'pants on fire|fake|fabricated|hoax|debunked|untrue|unfounded|bust|disproven') THEN 'False:CONTRADICTING' WHEN regexp_matches(c, 'misleading|distort') THEN 'Misleading:CONTRADICTING'
  WHEN regexp_matches(c, 'mostly false|mostly incorrect') THEN 'Mostly False:CONTRADICTING' WHEN regexp_matches(c, 'false|incorrect') AND regexp_matches(c, 'half|partly|mixture|partially') THEN 'Partly False:NEUTRAL'
  WHEN regexp_matches(c, 'false|incorrect') THEN 'False:CONTRADICTING' WHEN regexp_matches(c, 'mostly true|mostly correct|mostly accurate') THEN 'Mostly True:SUPPORTING'
  WHEN regexp_matches(c, 'true|correct|accurate|verified|confirmed') AND regexp_matches(c, 'half|partly|mixture|partially') THEN 'Partly True:NEUTRAL' WHEN regexp_matches(c, 'true|correct|accurate|verified|confirmed') THEN 'True:SUPPORTING'
  WHEN regexp_matches(c, 'half|mixture|mixed|unproven|unverified|inconclusive|context|disputed') THEN 'Needs Context:NEUTRAL' ELSE 'Unverified:NEUTRAL' END AS guess FROM r)
SELECT doc_id, rating, coalesce(t.verdict, split_part(guess, ':', 1)) AS verdict, coalesce(stance, split_part(guess, ':', 2)) AS stance FROM h LEFT JOIN t ON c = k
"""


def stance_consensus(spark, sf_dir):
    """Quality and toxicity labels stand for stances, ten documents to a claim."""
    labels = table(spark, sf_dir, "labels")
    stance = F.when(F.col("toxic") == 1, "CONTRADICTING").when(F.col("quality") == 1, "SUPPORTING").otherwise("NEUTRAL")
    return E.consensus(labels.select(F.floor(F.col("doc_id") / 10).alias("claim_id"), stance.alias("stance")))


CONSENSUS_SQL = """
WITH s AS (SELECT doc_id // 10 AS claim_id, CASE WHEN toxic = 1 THEN 'CONTRADICTING' WHEN quality = 1 THEN 'SUPPORTING' ELSE 'NEUTRAL' END AS stance FROM labels),
     c AS (SELECT claim_id, count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL') AS neutral, 0::BIGINT AS insufficient FROM s GROUP BY 1)
SELECT *, CASE WHEN supporting + contradicting = 0 THEN 0.0::DOUBLE ELSE round(supporting::DOUBLE / (supporting + contradicting), 3) END AS agreement_ratio FROM c
"""

def claims_view(spark, sf_dir):
    """Claims with the figures of their evidence."""
    return catalog_report.claims(spark, sf_dir)


COMPONENT_CTE = f"""
{catalog_report.FIGURES}, c AS (SELECT claim_id, unnest(['evidence_agreement', 'source_quality', 'independent_sources', 'fact_checks', 'official_evidence', 'transparency']) AS factor,
  unnest([CASE WHEN independent + independent_contradicting > 0 THEN independent::DOUBLE / (independent + independent_contradicting) WHEN neutral > 0 THEN 0.5 ELSE 0 END, coalesce(support_reliability / 100.0::DOUBLE, mean_reliability / 100.0::DOUBLE * 0.5::DOUBLE, 0),
          least(independent / 3.0::DOUBLE, 1), coalesce(fact_check_mean, 0.5), CASE WHEN official THEN 1 WHEN primary_support THEN 0.8 ELSE 0 END, coalesce(transparency_mean, 0.5)]::DOUBLE[]) AS raw,
  unnest([0.25, 0.15, 0.20, 0.15, 0.20, 0.05]::DOUBLE[]) AS w FROM v), kk AS (SELECT claim_id, factor, raw, round((raw * w * 100)::VARCHAR::DECIMAL(30, 17), 2)::DOUBLE AS contribution FROM c)"""
LABELS_SQL = "CASE WHEN score IS NULL THEN 'INSUFFICIENT EVIDENCE' WHEN score >= 90 THEN 'STRONGLY SUPPORTED' WHEN score >= 75 THEN 'MOSTLY SUPPORTED' WHEN score >= 50 THEN 'MIXED / UNCERTAIN' WHEN score >= 25 THEN 'WEAKLY SUPPORTED' ELSE 'STRONGLY CONTRADICTED' END AS classification"
SCORE_CTE = f"""{COMPONENT_CTE}, t AS (SELECT claim_id, sum(contribution) AS total FROM kk GROUP BY 1),
 s AS (SELECT claim_id, doc, importance, CASE WHEN sources >= 2 AND supporting + contradicting >= 2 THEN round_even(round(greatest(0, least(100, total - penalty)), 6), 0)::INTEGER END AS score FROM v JOIN t USING (claim_id))"""


def score_components(spark, sf_dir):
    return C.components(claims_view(spark, sf_dir))


def claim_score(spark, sf_dir):
    return C.claim_scores(claims_view(spark, sf_dir)).drop("agreement")


def document_score(spark, sf_dir):
    return C.document_scores(claim_score(spark, sf_dir))


COMPONENTS_SQL = f"WITH {COMPONENT_CTE} SELECT * FROM kk"
CLAIM_SCORE_SQL = f"WITH {SCORE_CTE} SELECT *, {LABELS_SQL} FROM s"
DOCUMENT_SCORE_SQL = f"""
WITH {SCORE_CTE}, w AS (SELECT doc, score, CASE WHEN score IS NOT NULL THEN CASE importance WHEN 'HIGH' THEN 1.0 WHEN 'MEDIUM' THEN 0.7 ELSE 0.4 END::DOUBLE END AS w FROM s),
 d AS (SELECT doc, round_even(round(sum(w * score) / sum(w), 6), 0)::INTEGER AS score, count(score) AS n_scored, count(*) AS n_claims FROM w GROUP BY doc) SELECT *, {LABELS_SQL} FROM d
"""

QUERIES = {
    "claim_evidence_topk": claim_evidence_topk, "text_normalize": text_normalize, "token_counts": token_counts, "sentence_split": sentence_split, "keyword_extract": keyword_extract,
    "canonical_url": canonical_url, "evidence_dedup_exact": evidence_dedup_exact, "domain_category": domain_category, "content_ids": content_ids, "trigram_similarity": trigram_similarity,
    "source_reliability": source_reliability, "rating_map": rating_map, "stance_consensus": stance_consensus, "score_components": score_components, "claim_score": claim_score, "document_score": document_score,
}
ORACLES = {
    "claim_evidence_topk": CLAIM_EVIDENCE_SQL, "text_normalize": TEXT_NORMALIZE_SQL, "token_counts": TOKEN_COUNTS_SQL, "sentence_split": SENTENCE_SPLIT_SQL, "keyword_extract": KEYWORD_SQL,
    "canonical_url": CANONICAL_SQL, "evidence_dedup_exact": DEDUP_SQL, "domain_category": DOMAIN_SQL, "content_ids": CONTENT_IDS_SQL, "trigram_similarity": TRIGRAM_SQL,
    "source_reliability": RELIABILITY_SQL, "rating_map": RATING_SQL, "stance_consensus": CONSENSUS_SQL, "score_components": COMPONENTS_SQL, "claim_score": CLAIM_SCORE_SQL, "document_score": DOCUMENT_SCORE_SQL,
}
QUERIES |= catalog_families.QUERIES | catalog_checks.QUERIES | catalog_text.QUERIES | catalog_claims.QUERIES | catalog_signals.QUERIES | catalog_report.QUERIES | catalog_relations.QUERIES
ORACLES |= catalog_families.ORACLES | catalog_checks.ORACLES | catalog_text.ORACLES | catalog_claims.ORACLES | catalog_signals.ORACLES | catalog_report.ORACLES | catalog_relations.ORACLES | {"score_breakdown": catalog_report.breakdown_sql(COMPONENT_CTE), "cross_verified_scores": catalog_checks.cross_sql(SCORE_CTE, LABELS_SQL), "action_evidence": catalog_families.action_sql(CLAIM_EVIDENCE_SQL), "reports": catalog_report.reports_sql(SCORE_CTE, LABELS_SQL), "score_texts": catalog_checks.texts_sql(SCORE_CTE, LABELS_SQL)}
DOMAINS_SQL = f"SELECT unnest([{quoted(catalog_signals.DOMAINS)}]) AS domain UNION ALL SELECT DISTINCT domain FROM ({CANONICAL_SQL})"
ORACLES["registry_lookup"] = catalog_signals.registry_sql(DOMAINS_SQL, DOMAIN_SQL.replace(f"SELECT unnest([{quoted(DOMAINS)}]) AS domain UNION ALL SELECT DISTINCT domain FROM ({CANONICAL_SQL})", DOMAINS_SQL))
