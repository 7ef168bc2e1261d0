"""Queries and DuckDB oracles of claims and stances that come from texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom import catalog_claims as CC
from claimloom import catalog_signals as CS
from claimloom.functions import text as T
from claimloom.operators import aspects as A
from claimloom.operators import evidence as E
from claimloom.operators import extraction as X
from claimloom.operators import signals as S
from claimloom.operators import verification as V

#: Endings that documents and benchmark passages get, by their ids, so that claims and evidence meet in ordinary text.
REPORTS = [
    " The state government banned plastic bags in Kerala on Monday.",
    " Officials in Kerala denied that plastic bags were banned on Monday. Plastic bags are sold in every shop of the state.",
    " The central bank cut the repo rate by 50 bps in June, the governor said on Monday.",
    " A flood in Assam struck 300 villages in July and workers were evacuated by the army.",
    " Plastic bags are common in Kerala and the state government did nothing about them.",
    " The firm announced that 500 jobs and ₹200 crore go to Gujarat on 5 March 2024.",
    " The minister said that the firm will hire 500 workers and the plant will open in Gujarat on 5 March 2024. The firm will hire 500 workers!",
    "",
]
CLAIMS = [
    " The state government banned plastic bags in Kerala on Monday and the central bank will cut the repo rate by 25 bps.",
    " The minister said that the firm announced 500 jobs and ₹300 crore for Gujarat on 5 March 2024.",
    " A flood in Assam struck 300 villages in June. A flood in Assam struck 300 villages in June!",
    " Vaccines cause autism. Could this be true? asked the minister on Monday. The tower is still the tallest of all.",
    "",
]


def with_endings(table, key, endings):
    cases = " ".join(f"WHEN {k} THEN {CS.q(x)}" for k, x in enumerate(endings))
    return f"SELECT {key}, concat(coalesce(text, ''), CASE {key} % {len(endings)} {cases} END) AS t FROM {table}"


REPORTED, CLAIMED = with_endings("documents", "doc_id", REPORTS), with_endings("benchmark", "item_id", CLAIMS)


def rows(spark, sf_dir, sql):
    for name in ("documents", "benchmark"):
        sql = sql.replace(f"FROM {name}", f"FROM parquet.`{sf_dir}/{name}.parquet`")
    return spark.sql(sql)


def document_claims(spark, sf_dir):
    """Claims of all documents; a short first line is the headline."""
    title = F.regexp_extract("t", r"^([^\n]{1,150})\n", 1)
    return X.extract_claims(rows(spark, sf_dir, REPORTED).select("doc_id", F.when(title != "", title).alias("title"), F.col("t").alias("text")), "doc_id")


def extract_claims(spark, sf_dir):
    got = document_claims(spark, sf_dir)
    return got.select("doc_id", F.col("claim_index").cast("long").alias("claim_index"), "claim_id", F.col("sentence").cast("long").alias("sentence"), T.digest(F.col("text")).alias("text"), T.digest(F.col("normalized")).alias("normalized"),
                      "speaker", "verb", F.size("entities").cast("long").alias("n_entities"), *[F.array_join(c, "|").alias(c) for c in ("dates", "numbers", "locations")], "claim_type", "importance")


AND = r"(?i)\s+and\s+"


def claims_sql(source, key):
    """CTEs from ``source`` (key, title, t) to ``claims``."""
    fit = f"{CC.CANDIDATE} AND {CS.FACTUAL}".replace("{0}", "s")
    speaker = CS.q(S.SPEAKER)
    return rf"""cs0 AS (SELECT {key}, title, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM {source}),
 cs AS (SELECT {key}, unnest(ss) AS s, unnest(range(len(ss))) AS n FROM cs0 UNION ALL SELECT {key}, trim(title), -1 FROM cs0 WHERE title IS NOT NULL), cf AS (SELECT * FROM cs WHERE {fit}),
 ca AS (SELECT *, n >= 0 AND regexp_matches(s, {speaker}) AND len(string_split_regex(trim(regexp_extract(s, {speaker}, 1)), '\s+')) <= 5 AS ok FROM cf),
 cb AS (SELECT {key}, n, s AS source, CASE WHEN ok THEN trim(regexp_extract(s, {speaker}, 1)) END AS speaker, CASE WHEN ok THEN trim(regexp_extract(s, {speaker}, 2)) END AS verb, CASE WHEN ok THEN trim(regexp_extract(s, {speaker}, 3)) ELSE s END AS st FROM ca),
 cc AS (SELECT *, string_split_regex(st, '{AND}') AS ps, regexp_extract_all(st, '{AND}') AS seps FROM cb),
 cd AS (SELECT *, list_transform(range(1, len(ps) + 1), lambda k: k > 1 AND regexp_matches(substr(st, (1 + list_sum(list_transform(ps[1:k - 1], lambda p: len(p))) + list_sum(list_transform(seps[1:k - 1], lambda p: len(p))))::BIGINT), '(?i)^[a-z\s]+(?:{X.CLAUSE_VERBS})\b')) AS cut FROM cc),
 ce AS (SELECT *, list_transform(string_split(array_to_string(list_transform(range(1, len(ps) + 1), lambda k: CASE WHEN k = 1 THEN ps[k] WHEN cut[k] THEN chr(2) || ps[k] ELSE seps[k - 1] || ps[k] END), ''), chr(2)), lambda p: trim(p)) AS parts FROM cd),
 cg AS (SELECT *, list_transform(list_filter(parts, lambda s: len(string_split_regex(s, '\s+')) >= 4 AND {CS.FACTUAL.replace('{0}', 's')}), lambda p: CASE WHEN regexp_matches(p, '[.!?]$') THEN p ELSE p || '.' END) AS good FROM ce),
 ch AS (SELECT {key}, n, source, speaker, verb, unnest(CASE WHEN n >= 0 AND len(parts) > 1 AND len(good) > 1 THEN good ELSE [st] END) AS t, unnest(range(CASE WHEN n >= 0 AND len(parts) > 1 AND len(good) > 1 THEN len(good) ELSE 1 END)) AS part FROM cg),
 {CS.normalize_sql('ch')}, {CS.entities_sql('ch_n', key)},
 ci AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY n, part) AS claim_index, lower(t) AS l FROM ch_n_e),
 ck AS (SELECT *, CASE WHEN speaker IS NOT NULL THEN 'QUOTE' WHEN {CC.has(CC.K.FINANCIAL)} THEN 'FINANCIAL' WHEN len(numbers) > 0 OR {CC.has(CC.K.STATISTIC)} THEN 'STATISTIC' WHEN {CC.has(CC.K.POLICY)} THEN 'POLICY'
   WHEN {CC.has(CC.K.ANNOUNCEMENT)} THEN 'ANNOUNCEMENT' WHEN {CC.has(CC.K.SCIENTIFIC)} THEN 'SCIENTIFIC' WHEN len(dates) + len(locations) > 0 OR {CC.has(CC.K.EVENT)} THEN 'EVENT' ELSE 'OTHER' END AS claim_type FROM ci),
 claims AS (SELECT *, 'claim_' || left(sha256(regexp_replace(lower(t), '[^\p{{L}}\p{{N}}_]+', '', 'g')), 10) || '_' || claim_index AS claim_id,
   CASE WHEN n <= 0 OR (n <= 2)::INT * 2 + (len(numbers) > 0)::INT + (len(dates) > 0)::INT + (claim_type IN ('POLICY', 'EVENT', 'ANNOUNCEMENT', 'FINANCIAL'))::INT >= 4 THEN 'HIGH'
        WHEN (n <= 2)::INT * 2 + (len(numbers) > 0)::INT + (len(dates) > 0)::INT + (claim_type IN ('POLICY', 'EVENT', 'ANNOUNCEMENT', 'FINANCIAL'))::INT >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS importance FROM ck)"""


EXTRACT_SQL = rf"""
WITH r AS ({REPORTED}), d AS (SELECT doc_id, nullif(regexp_extract(t, '^([^\n]{{1,150}})\n', 1), '') AS title, t FROM r), {claims_sql('d', 'doc_id')}
SELECT doc_id, claim_index, claim_id, CASE WHEN n >= 0 THEN n END AS sentence, sha256(trim(t)) AS text, sha256(normal) AS normalized, speaker, verb, len(a)::BIGINT AS n_entities,
  array_to_string(dates, '|') AS dates, array_to_string(numbers, '|') AS numbers, array_to_string(locations, '|') AS locations, claim_type, importance FROM claims
"""


def claim_groups(spark, sf_dir):
    got = X.group_claims(document_claims(spark, sf_dir).persist(), "doc_id")  # read four times
    return got.select("doc_id", F.col("claim_index").cast("long").alias("claim_index"), "claim_id", "duplicate_of", T.digest(F.array_join("equivalents", "|")).alias("equivalents"))


def passage_claims(spark, sf_dir):
    none = F.array().cast("array<string>")
    made = X.extract_claims(rows(spark, sf_dir, CLAIMED).select("item_id", F.lit(None).cast("string").alias("title"), F.col("t").alias("text")), "item_id")
    return made.select(F.concat_ws(":", "item_id", "claim_id").alias("claim_id"), F.col("normalized").alias("claim"), "speaker", "entities", "dates", "numbers", "locations", none.alias("persons"), none.alias("organizations"))


def claim_pairs(spark, sf_dir, docs=None):
    """Claims of the benchmark passages, documents (doc_id, text), and each claim's three most relevant ones."""
    claims = passage_claims(spark, sf_dir).persist()  # read with the documents and by those who ask
    docs = docs or rows(spark, sf_dir, REPORTED).select("doc_id", F.col("t").alias("text"))
    top = E.relevant_documents(claims.select(F.col("claim_id").alias("item_id"), F.col("claim").alias("text")), docs).select(F.col("item_id").alias("claim_id"), "doc_id").persist()  # three rows for each claim, read up to four times
    return claims, docs, top


def claim_queries(spark, sf_dir):
    """Search queries of the passages' claims, with their providers."""
    claims = passage_claims(spark, sf_dir).withColumnRenamed("claim_id", "item_id").withColumnRenamed("claim", "text")
    return CC.K.routed_queries(claims, "item_id")


def stance(spark, sf_dir):
    """Stance of the most relevant documents on claims, with the best quote."""
    claims, docs, top = claim_pairs(spark, sf_dir)
    pairs = E.beside(top).join(docs.withColumnRenamed("text", "evidence"), "doc_id").join(claims, "claim_id")
    quotes = A.best_quotes(claims, docs, top)
    told = A.judge(pairs).join(quotes, ["claim_id", "doc_id"], "left")
    aspects = F.array_join(F.transform("aspects", lambda a: F.concat_ws("=", F.concat_ws(":", a["kind"], a["value"]), a["status"], F.coalesce(a["evidence_value"], F.lit("")))), "|")
    return told.select("claim_id", "doc_id", F.round("relevance", 2).alias("relevance"), F.col("common").cast("long").alias("common"), "denied", F.size("conflicts").cast("long").alias("n_conflicts"), "late_month",
                       aspects.alias("aspects"), F.col("supported").cast("long").alias("supported"), "stance", "confidence", F.col("overlap").cast("long").alias("overlap"), T.digest(F.col("quote")).alias("quote"))


CONTENT = "list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: len(w) > 1 AND w NOT IN (" + CC.quoted(T.STOP_WORDS) + ")))"
_DENIED = " OR ".join(f"regexp_matches(x, {CS.q('(?i)' + d)})" for d in S.DENIALS)
_ACTION = "CASE " + " ".join(rf"WHEN regexp_matches(lower(claim), '\b({b}|{w})\b') THEN '{b}'" for b, w in A.ACTIONS.items()) + " END"
_BORNE = "CASE v " + " ".join(rf"WHEN '{b}' THEN regexp_matches(lower(ev), '\b({w})\b')" for b, w in A.ACTIONS.items()) + " ELSE false END"
_MONTHS = "[" + ", ".join(f"'{m}'" for m in V.MONTHS) + "]"
def stance_sql(docs):
    """CTEs up to v0: the claims of the passages against their documents of ``docs`` (doc_id, t)."""
    return rf"""r AS ({CLAIMED}), b AS (SELECT item_id, NULL::VARCHAR AS title, t FROM r), {claims_sql('b', 'item_id')}, dd AS ({docs}),
 q0 AS (SELECT item_id || ':' || claim_id AS claim_id, normal AS claim, speaker, a, dates, numbers, locations, {CONTENT.format('normal')} AS cw FROM claims), d0 AS (SELECT doc_id, t AS ev, {CONTENT.format('t')} AS dw FROM dd),
 m AS (SELECT claim_id, doc_id, len(cw) AS nc, len(dw) AS nd, len(list_intersect(cw, dw)) AS common FROM q0, d0 WHERE len(list_intersect(cw, dw)) > 0),
 s AS (SELECT *, least(1.0, common::DOUBLE / (nc + nd - common) * 2.5 + common::DOUBLE / nc * 0.5) AS rel FROM m),
 top AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY claim_id ORDER BY round(rel, 6) DESC, doc_id) <= 3), j AS (SELECT top.*, q0.* EXCLUDE (claim_id), d0.ev FROM top JOIN q0 USING (claim_id) JOIN d0 USING (doc_id)),
 jc AS (SELECT DISTINCT claim_id, claim AS t FROM j), je AS (SELECT DISTINCT doc_id, ev AS t FROM j), {CS.quantities_sql('jc', 'claim_id')}, {CS.quantities_sql('je', 'doc_id')},
 k0 AS (SELECT j.*, jc_q.a AS cq, je_q.a AS eq, list_filter(list_distinct(list_concat(locations, list_transform(j.a, lambda x: x.text))), lambda x: len(x) > 2) AS terms,
   list_filter(list_transform(string_split(regexp_replace(ev, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') AS ss FROM j JOIN jc_q USING (claim_id) JOIN je_q USING (doc_id)),
 k1 AS (SELECT *, len(list_filter(ss, lambda x: len(list_filter(terms, lambda y: contains(lower(x), lower(y)))) > 0 AND ({_DENIED}))) > 0 AS denied,
   list_filter(list_transform(cq, lambda x: list_filter(eq, lambda y: ({CS.name_sql('y.unit')}) = ({CS.name_sql('x.unit')}) OR ({CS.name_sql('x.unit')}) = 'currency')), lambda near, i: len(near) > 0 AND len(list_filter(near, lambda y: abs(y.value - cq[i].value) < 1e-4)) = 0) AS conf,
   list_filter({_MONTHS}, lambda x: contains(lower(array_to_string(dates, ', ')), x)) AS cm, list_filter({_MONTHS}, lambda x: contains(lower(ev), x)) AS em, {_ACTION} AS act FROM k0),
 k2 AS (SELECT *, CASE WHEN len(cm) > 0 AND NOT list_has_any(cm, em) THEN em[1] END AS late_month, list_concat(list_concat(list_concat(CASE WHEN speaker IS NULL THEN [] ELSE [{{'k': 'ATTRIBUTION', 'v': speaker}}] END, list_transform(locations, lambda x: {{'k': 'WHERE', 'v': x}})),
   list_concat(list_transform(dates, lambda x: {{'k': 'WHEN', 'v': x}}), list_transform(numbers, lambda x: {{'k': 'AMOUNT', 'v': x}}))), CASE WHEN act IS NULL THEN [] ELSE [{{'k': 'ACTION', 'v': act}}] END) AS asp FROM k1),
 u AS (SELECT claim_id, doc_id, ev, denied, conf, unnest(asp).k AS k, unnest(asp).v AS v, unnest(range(len(asp))) AS pos FROM k2),
 w AS (SELECT *, CASE WHEN k = 'ACTION' AND denied THEN 'CONTRADICTED' WHEN k = 'ACTION' THEN CASE WHEN {_BORNE} THEN 'SUPPORTED' ELSE 'UNMENTIONED' END WHEN k = 'AMOUNT' AND len(conf) > 0 THEN 'CONTRADICTED' WHEN contains(lower(ev), lower(v)) THEN 'SUPPORTED' ELSE 'UNMENTIONED' END AS status FROM u),
 z AS (SELECT claim_id, doc_id, string_agg(k || ':' || v || '=' || status || '=' || CASE WHEN k = 'AMOUNT' AND len(conf) > 0 THEN conf[1][1].phrase WHEN status = 'SUPPORTED' THEN v ELSE '' END, '|' ORDER BY pos) AS aspects,
   count(*) FILTER (status = 'SUPPORTED') AS supported, bool_or(k = 'ACTION') AS acts, bool_or(k = 'ACTION' AND status = 'SUPPORTED') AS borne FROM w GROUP BY ALL),
 y AS (SELECT k2.*, coalesce(aspects, '') AS aspects, coalesce(supported, 0) AS supported, coalesce(acts, false) AS acts, coalesce(borne, false) AS borne FROM k2 LEFT JOIN z USING (claim_id, doc_id)),
 x0 AS (SELECT claim_id, doc_id, cw, unnest(list_filter(ss, lambda x: len(x) > 5)) AS quote, unnest(range(len(list_filter(ss, lambda x: len(x) > 5)))) AS pos FROM k2 JOIN (SELECT claim_id, cw AS cw FROM q0) USING (claim_id)),
 x1 AS (SELECT *, len(list_intersect(cw, regexp_extract_all(lower(quote), '[\p{{L}}\p{{N}}_]{{3,}}'))) AS overlap FROM x0),
 x2 AS (SELECT * FROM x1 WHERE overlap >= 2 QUALIFY row_number() OVER (PARTITION BY claim_id, doc_id ORDER BY overlap DESC, pos) = 1),
 v0 AS (SELECT *, CASE WHEN denied OR len(conf) > 0 THEN 'CONTRADICTING' WHEN rel < 0.18 OR len(ev) < 40 OR common < 2 THEN 'INSUFFICIENT' WHEN (acts AND NOT borne) OR (supported < 2 AND NOT borne) THEN 'NEUTRAL' ELSE 'SUPPORTING' END AS stance FROM y)""".replace("k2 JOIN (SELECT claim_id, cw AS cw FROM q0) USING (claim_id)", "k2")


STANCE_SQL = f"""
WITH {stance_sql(REPORTED)}
SELECT claim_id, doc_id, round(rel, 2) AS relevance, common::BIGINT AS common, denied, len(conf)::BIGINT AS n_conflicts, late_month, aspects, supported::BIGINT AS supported, stance,
  (CASE WHEN denied THEN 0.9 WHEN len(conf) > 0 THEN 0.88 WHEN stance = 'INSUFFICIENT' THEN 0.7 WHEN stance = 'NEUTRAL' THEN 0.8 ELSE round(least(0.95, 0.75 + 0.06 * supported), 2) END)::DOUBLE AS confidence, overlap::BIGINT AS overlap, sha256(quote) AS quote
FROM v0 LEFT JOIN (SELECT claim_id, doc_id, overlap, quote FROM x2) USING (claim_id, doc_id)
"""

_FROM_CLAIMS = f"r AS ({CLAIMED}), b0 AS (SELECT item_id, NULL::VARCHAR AS title, t FROM r), {claims_sql('b0', 'item_id')}, b AS (SELECT item_id || ':' || claim_id AS item_id, normal AS text, speaker, []::VARCHAR[] AS organizations, []::VARCHAR[] AS persons, locations, numbers, dates FROM claims)"
_TAIL = CC.ROUTING_SQL[CC.ROUTING_SQL.index(" k AS (SELECT *, list_filter(regexp_extract_all(text"):]
CLAIM_QUERIES_SQL = f"WITH {_FROM_CLAIMS}, {_TAIL.replace(' r AS (SELECT * FROM (VALUES', ' routes AS (SELECT * FROM (VALUES').replace('FROM f JOIN r USING', 'FROM f JOIN routes USING')}"

QUERIES = {"extract_claims": extract_claims, "claim_groups": claim_groups, "claim_queries": claim_queries, "stance": stance}
#: Which claim comes first decides on duplicates one by one: tested against a loop.
ORACLES = {"extract_claims": EXTRACT_SQL, "claim_queries": CLAIM_QUERIES_SQL, "stance": STANCE_SQL}
