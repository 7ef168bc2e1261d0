"""Queries and DuckDB oracles of claims and verification."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom.functions import lexicon as W
from claimloom.functions import text as T
from claimloom.functions import urls as U
from claimloom.operators import claims as K
from claimloom.operators import verification as V


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(words):
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("n", "s")).withColumn("n", F.col("n").cast("long"))


SENTENCES = r"""s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) > 5) AS ss FROM documents),
 s AS (SELECT doc_id, unnest(ss) AS s, unnest(generate_series(0, len(ss) - 1)) AS n FROM s0)"""


def candidate_sentences(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "n", K.is_candidate(F.col("s")).alias("candidate"))


#: What a claim may not look like, written out again for the oracle.
ASKING = r"(?i)^(could|is|are|will|can|should|what if|why|how)\s+.*\?"
CANDIDATE = rf"""length({{0}}) >= 8 AND len(string_split_regex({{0}}, '\s+')) >= 3 AND NOT ends_with({{0}}, '?') AND NOT regexp_matches({{0}}, '{ASKING}') AND NOT regexp_matches({{0}}, '{K.GREETING}')
  AND NOT regexp_matches({{0}}, '{K.BOILERPLATE}') AND NOT (len(string_split_regex({{0}}, '\s+')) < 12 AND ({' OR '.join(f"starts_with(lower({{0}}), '{o}') OR contains(lower({{0}}), ' {o} ')" for o in K.OPINIONS)}))
  AND (len(string_split_regex({{0}}, '\s+')) >= 4 OR {W.has_word_sql('{0}', W.event_words() + W.AUXILIARIES)})"""
CANDIDATE_SQL = f"WITH {SENTENCES}, w AS (SELECT doc_id, n, trim(s) AS t FROM s) SELECT doc_id, n, {CANDIDATE.replace('{0}', 't')} AS candidate FROM w"


def claim_types(spark, sf_dir):
    s = F.col("s")
    said, numbers, dates = s.rlike(r"(?i)\baccording to\b"), s.rlike("[0-9]"), K.any_of(F.lower(s), V.MONTHS[:12])
    none = F.lit(False)
    got = sentences(spark, sf_dir).withColumn("claim_type", K.claim_type(s, said, numbers, none, none, dates))
    return got.select("doc_id", "n", "claim_type", K.importance(none, F.col("n"), numbers, none, dates, F.col("claim_type")).alias("importance"))


def has(words, of="l"):
    return "(" + " OR ".join(f"contains({of}, {quoted([w])})" for w in words) + ")"


CLAIM_TYPES_SQL = rf"""
WITH {SENTENCES}, w AS (SELECT doc_id, n, lower(s) AS l, regexp_matches(s, '[0-9]') AS num, {has(V.MONTHS[:12], 'lower(s)')} AS dat, regexp_matches(s, '(?i)\baccording to\b') AS said FROM s),
 t AS (SELECT *, CASE WHEN said THEN 'QUOTE' WHEN {has(K.FINANCIAL)} THEN 'FINANCIAL' WHEN num OR {has(K.STATISTIC)} THEN 'STATISTIC' WHEN {has(K.POLICY)} THEN 'POLICY' WHEN {has(K.ANNOUNCEMENT)} THEN 'ANNOUNCEMENT'
   WHEN {has(K.SCIENTIFIC)} THEN 'SCIENTIFIC' WHEN dat OR {has(K.EVENT)} THEN 'EVENT' ELSE 'OTHER' END AS claim_type FROM w),
 p AS (SELECT *, CASE WHEN n <= 2 THEN 2 ELSE 0 END + num::INT + dat::INT + (claim_type IN ('POLICY', 'EVENT', 'ANNOUNCEMENT', 'FINANCIAL'))::INT AS points FROM t)
SELECT doc_id, n, claim_type, CASE WHEN n = 0 OR points >= 4 THEN 'HIGH' WHEN points >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS importance FROM p
"""


def claim_similarity(spark, sf_dir):
    """Each sentence against the next one of its document."""
    following = F.lead("s").over(Window.partitionBy("row", "doc_id").orderBy("n"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.monotonically_increasing_id().alias("row"), T.sentences(F.col("text")).alias("ss")).select("doc_id", "row", F.posexplode("ss").alias("n", "s"))
    return rows.withColumn("t", following).where("t is not null").select("doc_id", F.col("n").cast("long").alias("n"), F.round(K.claim_similarity(F.col("s"), F.col("t")), 6).alias("similarity"))


SIMILARITY_SQL = rf"""
WITH {SENTENCES}, w AS (SELECT doc_id, n, list_distinct(regexp_extract_all(lower(s), '[\p{{L}}\p{{N}}_]{{3,}}')) AS a FROM s), p AS (SELECT *, lead(a) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM w)
SELECT doc_id, n, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))), 6) END AS similarity FROM p WHERE b IS NOT NULL
"""


#: Benchmark passages as claims, with what their extraction would find, by item_id.
CLAIM_FIELDS = """SELECT item_id, text, CASE WHEN item_id % 5 = 0 THEN 'The Minister' END AS speaker, CASE WHEN item_id % 3 = 0 THEN array('Reserve Bank', 'WHO', 'Third') ELSE array() END AS organizations,
  CASE WHEN item_id % 4 = 0 THEN array('Ann  Lee') ELSE array() END AS persons, CASE WHEN item_id % 7 = 0 THEN array('Kerala') ELSE array() END AS locations,
  CASE WHEN item_id % 2 = 0 THEN array('5 crore', '25 bps', '7%') ELSE array() END AS numbers, CASE WHEN item_id % 6 = 0 THEN array('Monday', 'Friday') ELSE array() END AS dates FROM benchmark"""


def query_routing(spark, sf_dir):
    return K.routed_queries(spark.sql(CLAIM_FIELDS.replace("array()", "cast(array() AS array<string>)").replace("FROM benchmark", f"FROM parquet.`{sf_dir}/benchmark.parquet`")), "item_id")


def _list(*parts):
    return "list_concat(" * (len(parts) - 1) + parts[0] + "".join(f", {p})" for p in parts[1:])


ROUTING_SQL = rf"""
WITH b AS ({CLAIM_FIELDS.replace('array()', '[]::VARCHAR[]').replace('array(', 'list_value(')}),
 k AS (SELECT *, list_filter(regexp_extract_all(text, '[A-Za-z0-9$%€₹-]+'), lambda w: len(w) > 1 AND lower(w) NOT IN ({quoted(T.QUERY_STOP_WORDS)}))[1:7] AS ws, {_list("CASE WHEN speaker IS NULL THEN []::VARCHAR[] ELSE [speaker] END", "organizations[1:2]", "persons[1:2]", "locations[1:2]")} AS es FROM b),
 t AS (SELECT *, list_filter(ws, lambda w: NOT list_contains(es, w))[1:3] AS ts, coalesce(organizations[1], persons[1]) AS anchor FROM k),
 c AS (SELECT item_id, text, unnest(range(6)) AS pos, unnest(['DIRECT', 'ENTITY_FOCUSED', 'NUMERIC', 'DATE_FOCUSED', 'FACT_CHECK', 'OFFICIAL']) AS query_type, unnest([ws, CASE WHEN len(es) > 0 THEN list_concat(es, ts) END,
   CASE WHEN len(numbers) > 0 THEN {_list('numbers[1:2]', 'es[1:2]', 'ts[1:2]')} END, CASE WHEN len(dates) > 0 THEN {_list('es[1:2]', 'ts[1:2]', 'dates[1:1]')} END,
   CASE WHEN len(es[1:2]) + len(ts) > 0 THEN {_list('es[1:2]', 'ts', "['fact check']")} WHEN len(ws) > 0 THEN {_list('ws[1:4]', "['fact check']")} END, CASE WHEN anchor IS NOT NULL THEN {_list("[anchor, 'official statement']", 'ts[1:2]')} END]) AS parts FROM t),
 s AS (SELECT item_id, pos, query_type, trim(regexp_replace(array_to_string(parts, ' '), '[ ]+', ' ', 'g')) AS query FROM c WHERE parts IS NOT NULL),
 d AS (SELECT * FROM s WHERE contains(query, ' ') QUALIFY row_number() OVER (PARTITION BY item_id, lower(query) ORDER BY pos) = 1), n AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY pos) <= 5),
 f AS (SELECT item_id, query_type, query FROM n UNION ALL SELECT item_id, 'DIRECT', trim(regexp_replace(array_to_string(string_split_regex(trim(text), '\s+')[1:8], ' '), '[ ]+', ' ', 'g')) FROM b WHERE item_id NOT IN (SELECT item_id FROM n) AND len(string_split_regex(trim(text), '\s+')) >= 2),
 r AS (SELECT * FROM (VALUES ('FACT_CHECK', 'factcheck'), ('FACT_CHECK', 'web'), ('OFFICIAL', 'official'), ('OFFICIAL', 'news'), ('NUMERIC', 'news'), ('NUMERIC', 'web'), ('DATE_FOCUSED', 'news'), ('DATE_FOCUSED', 'web'),
   ('DIRECT', 'news'), ('DIRECT', 'web'), ('DIRECT', 'factcheck'), ('ENTITY_FOCUSED', 'news'), ('ENTITY_FOCUSED', 'web'), ('ENTITY_FOCUSED', 'factcheck')) AS v(query_type, provider))
SELECT item_id, query_type, query, provider, provider || '::' || lower(trim(query)) AS cache_key FROM f JOIN r USING (query_type)
"""

URLS = [
    "", "  ", "ftp://a.example/x", "https://", "http:///path", "http://127.0.0.1/", "http://10.2.3.4:80/a", "https://172.31.255.255", "https://172.32.0.1", "http://8.8.8.8/dns", "http://169.254.169.254/latest", "http://224.0.0.1",
    "http://user:pw@LOCALHOST:8080/", "https://db.internal/", "http://printer.local", "http://[::1]/", "http://[fe80::1]:80/", "https://[2606:4700::1111]/", "http://300.1.1.1/", "HTTPS://News.Example/a?b=c", "nonsense",
]


def url_validate(spark, sf_dir):
    given = spark.createDataFrame([(x,) for x in URLS], "url string").unionByName(table(spark, sf_dir, "pages").select("url").distinct())
    return given.select("url", U.validity(F.col("url")).alias("status"))


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
URL_SQL = rf"""
WITH g AS (SELECT unnest([{quoted(URLS)}]) AS url UNION ALL SELECT DISTINCT url FROM pages),
 p AS (SELECT url, lower(regexp_extract(trim(url), '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, regexp_replace(regexp_replace(lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS h FROM g),
 v AS (SELECT *, string_split(h, '.') AS o FROM p), n AS (SELECT *, TRY_CAST(o[1] AS BIGINT) * 16777216 + TRY_CAST(o[2] AS BIGINT) * 65536 + TRY_CAST(o[3] AS BIGINT) * 256 + TRY_CAST(o[4] AS BIGINT) AS ip FROM v)
SELECT url, CASE WHEN coalesce(trim(url), '') = '' THEN 'EMPTY' WHEN scheme NOT IN ('http', 'https') THEN 'BAD_SCHEME' WHEN h = '' THEN 'NO_HOST'
  WHEN (regexp_matches(h, '^({OCTET}\.){{3}}{OCTET}$') AND ({' OR '.join('ip BETWEEN %d AND %d' % U.net_range(*x) for x in U.BLOCKED_NETS)})) OR regexp_matches(h, '^\[(::1?|f[cd][0-9a-f]{{2}}:.*|fe[89ab][0-9a-f]:.*|ff[0-9a-f]{{2}}:.*)\]$') THEN 'BLOCKED_IP'
  WHEN h IN ({quoted(U.BLOCKED_HOSTS)}) OR ends_with(h, '.local') OR ends_with(h, '.internal') THEN 'BLOCKED_HOST' ELSE 'OK' END AS status FROM n
"""

#: 2026-04-20T00:00:00Z.
AS_OF = 1_776_643_200
DATES = ["2026-04-05T12:00:00Z", "2026-04-05T12:00:00+05:30", "2026-04-05T12:00:00", "2026-04-05", "20260405T120000Z", "20260405T120000", "20250405", "2025-04-20 and more", "2027-01-01", "2020-02-30", "2026", "soon", "", "2025-04-20"]


def source_age(spark, sf_dir):
    """Event times as sources write them, and odd dates."""
    ts, k = F.col("ts"), F.col("event_id") % 6
    forms = {0: "yyyy-MM-dd'T'HH:mm:ss'Z'", 1: "yyyyMMdd'T'HHmmss", 2: "yyyyMMdd", 3: "yyyy-MM-dd", 4: "yyyyMMdd'T'HHmmss'Z'"}
    raw = F.element_at(F.array(*[F.lit(x) for x in DATES]), (F.col("event_id") % len(DATES) + 1).cast("int"))
    given = table(spark, sf_dir, "events").select("event_id", F.coalesce(*[F.when(k == n, F.date_format(ts, f)) for n, f in forms.items()], raw).alias("published_at"))
    return given.withColumn("days", V.age_days(F.col("published_at"), AS_OF)).withColumn("age", V.age_label(F.col("days")))


SOURCE_AGE_SQL = rf"""
WITH g AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y%m%dT%H%M%S') WHEN 2 THEN strftime(ts, '%Y%m%d') WHEN 3 THEN strftime(ts, '%Y-%m-%d') WHEN 4 THEN strftime(ts, '%Y%m%dT%H%M%SZ')
   ELSE [{quoted(DATES)}][event_id % {len(DATES)} + 1] END AS published_at FROM events),
 t AS (SELECT event_id, published_at, CASE WHEN regexp_matches(published_at, '^\d{{8}}$') THEN try_strptime(published_at, '%Y%m%d') WHEN regexp_matches(published_at, '^\d{{8}}T\d{{6}}Z?$') THEN try_strptime(replace(published_at, 'Z', ''), '%Y%m%dT%H%M%S')
   WHEN regexp_matches(published_at, '^\d{{4}}-\d{{2}}-\d{{2}}') THEN coalesce(TRY_CAST(published_at AS TIMESTAMP), TRY_CAST(published_at[1:10] AS TIMESTAMP)) END AS ts FROM g),
 d AS (SELECT event_id, published_at, CASE WHEN ts IS NOT NULL THEN greatest(floor(({AS_OF} - epoch(ts)) / 86400)::BIGINT, 0) END AS days FROM t)
SELECT event_id, published_at, days, CASE WHEN days IS NULL THEN 'UNKNOWN' WHEN days <= 30 THEN 'VERY_RECENT' WHEN days <= 365 THEN 'RECENT' ELSE 'OLDER' END AS age FROM d
"""

#: Documents with planted mentions.
MENTIONS = "CASE doc_id % 5 WHEN 0 THEN concat(text, ' (Reuters) and PTI') WHEN 1 THEN concat('AP: ', text) WHEN 2 THEN concat(text, ' in May, wire reports say') ELSE text END"


def wire_agencies(spark, sf_dir):
    return table(spark, sf_dir, "documents").withColumn("t", F.expr(MENTIONS)).select("doc_id", F.array_join(V.wire_agencies(F.col("t")), ",").alias("agencies"))


WIRE_SQL = rf"""WITH m AS (SELECT doc_id, {MENTIONS} AS t FROM documents) SELECT doc_id, concat_ws(',', {', '.join(rf"CASE WHEN regexp_matches(t, '(?i)\b({p})\b') THEN '{k}' END" for k, p in V.WIRES.items())}) AS agencies FROM m WHERE t IS NOT NULL
UNION ALL SELECT doc_id, '' FROM documents WHERE text IS NULL"""


def temporal_discrepancy(spark, sf_dir):
    """The claim's month goes by doc_id."""
    claimed = F.get(F.array(*[F.lit(m) for m in V.MONTHS[:12]]), (F.col("doc_id") % 12).cast("int"))
    return table(spark, sf_dir, "documents").withColumn("t", F.expr(MENTIONS)).select("doc_id", V.month_conflict(claimed, F.col("t")).alias("month"))


TEMPORAL_SQL = f"""
WITH m AS (SELECT doc_id, lower({MENTIONS}) AS t, [{quoted(V.MONTHS[:12])}][doc_id % 12 + 1] AS c FROM documents),
 f AS (SELECT doc_id, list_filter([{quoted(V.MONTHS)}], lambda x: contains(c, x)) AS a, list_filter([{quoted(V.MONTHS)}], lambda x: contains(t, x)) AS b FROM m)
SELECT doc_id, CASE WHEN NOT list_has_any(a, b) THEN b[1] END AS month FROM f
"""

def clusters(spark, sf_dir):
    """Claims of 20 documents each; equal texts are duplicates, equal lengths modulo 7 syndicated."""
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 20).alias("claim_id"), F.col("doc_id").alias("ord"), F.sha2("text", 256).alias("h"), (F.col("n_chars") % 31).alias("m"))
    a, b = docs.alias("a"), docs.alias("b")
    pairs = a.join(b, (F.col("a.claim_id") == F.col("b.claim_id")) & (F.col("a.ord") < F.col("b.ord")) & (F.col("a.m") == F.col("b.m")))
    return V.clusters(docs, pairs.select("a.claim_id", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), (F.col("a.h") == F.col("b.h")).alias("duplicate")))


CLUSTERS_SQL = """
WITH RECURSIVE d AS (SELECT doc_id // 20 AS claim_id, doc_id AS ord, sha256(text) AS h, n_chars % 31 AS m FROM documents),
 p AS (SELECT a.claim_id, a.ord AS a, b.ord AS b, a.h = b.h AS dup FROM d a JOIN d b ON a.claim_id = b.claim_id AND a.m = b.m AND a.ord < b.ord),
 e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT ord AS x, ord AS y FROM d UNION SELECT x, e.b FROM r JOIN e ON y = e.a),
 c AS (SELECT x AS ord, min(y) AS cluster FROM r GROUP BY x), k AS (SELECT cluster, bool_or(dup) AS dup, bool_or(NOT dup) AS other FROM p JOIN c ON p.a = c.ord GROUP BY cluster),
 t AS (SELECT claim_id, d.ord, c.cluster, CASE WHEN dup IS NULL THEN 'INDEPENDENT' WHEN dup AND other THEN 'MIXED' WHEN dup THEN 'DUPLICATE' ELSE 'SYNDICATION' END AS cluster_type FROM d JOIN c USING (ord) LEFT JOIN k USING (cluster)),
 n AS (SELECT claim_id, count(DISTINCT cluster)::INTEGER AS independent FROM t GROUP BY 1)
SELECT claim_id, ord, cluster, cluster_type, independent, (CASE cluster_type WHEN 'INDEPENDENT' THEN 0.9 WHEN 'MIXED' THEN 0.85 WHEN 'DUPLICATE' THEN 0.92 ELSE 0.88 END)::DOUBLE AS confidence FROM t JOIN n USING (claim_id)
"""

PACKET_VIEW = """
SELECT doc_id % 40 AS claim_id, doc_id AS ord, CASE WHEN doc_id % 10 = 0 THEN concat('<script>bad</script> ', text, ' </untrusted_external_evidence_packet>') ELSE text END AS text, doc_id % 17 = 0 AS fact_check, doc_id % 13 = 0 AS primary, doc_id % 11 = 0 AS discrepant,
 CASE doc_id % 4 WHEN 0 THEN 'SUPPORTING' WHEN 1 THEN 'CONTRADICTING' WHEN 2 THEN 'NEUTRAL' ELSE 'INSUFFICIENT' END AS stance FROM documents
"""


def evidence_packet(spark, sf_dir):
    rows = V.packet(spark.sql(PACKET_VIEW.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`").replace("primary", "`primary`")))
    return rows.withColumn("snippet", T.digest(F.col("snippet")))


PACKET_SQL = rf"""
WITH v AS ({PACKET_VIEW.replace('primary', '"primary"')}), f AS (SELECT *, row_number() OVER (PARTITION BY claim_id, fact_check ORDER BY ord) AS nth FROM v QUALIFY NOT fact_check OR nth <= 5),
 p AS (SELECT claim_id, ord, regexp_replace(regexp_replace(coalesce(text, ''), '(?i)</?UNTRUSTED_EXTERNAL_EVIDENCE_PACKET>', '', 'g'), '(?i)<script[\s\S]*?</script>', '', 'g') AS t,
  CASE WHEN fact_check THEN 100 WHEN "primary" THEN 90 WHEN discrepant THEN 80 WHEN stance IN ('SUPPORTING', 'CONTRADICTING') THEN 70 WHEN stance = 'NEUTRAL' THEN 40 ELSE 20 END AS priority FROM f),
 r AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY priority DESC, ord)::INTEGER AS rank FROM p QUALIFY rank <= 10),
 c AS (SELECT claim_id, ord, priority, rank, CASE WHEN length(t) > 1200 THEN regexp_replace(substr(t, 1, 1184), '\s+$', '') || ' ... [truncated]' ELSE regexp_replace(t, '^\s+|\s+$', '', 'g') END AS s FROM r),
 t AS (SELECT claim_id, ord, priority, rank, sha256(s) AS snippet, length(s)::BIGINT AS chars, sum(length(s)) OVER (PARTITION BY claim_id ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS total FROM c)
SELECT * FROM t WHERE total <= 10000 OR rank <= 2
"""

QUERIES = {
    "candidate_sentences": candidate_sentences, "claim_types": claim_types, "claim_similarity": claim_similarity, "query_routing": query_routing, "url_validate": url_validate, "source_age": source_age,
    "wire_agencies": wire_agencies, "temporal_discrepancy": temporal_discrepancy, "clusters": clusters, "evidence_packet": evidence_packet,
}
ORACLES = {
    "candidate_sentences": CANDIDATE_SQL, "claim_types": CLAIM_TYPES_SQL, "claim_similarity": SIMILARITY_SQL, "query_routing": ROUTING_SQL, "url_validate": URL_SQL, "source_age": SOURCE_AGE_SQL,
    "wire_agencies": WIRE_SQL, "temporal_discrepancy": TEMPORAL_SQL, "clusters": CLUSTERS_SQL, "evidence_packet": PACKET_SQL,
}
