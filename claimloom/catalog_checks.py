"""Queries and DuckDB oracles of fact-checks, cross-verification, grounding and duplicates by embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimloom import catalog_report as CR
from claimloom import catalog_signals as CS
from claimloom import catalog_text as CT
from claimloom.operators import crosscheck as X
from claimloom.operators import evidence as E
from claimloom.operators import factchecks as FC
from claimloom.operators import grounding as G
from claimloom.operators import neighbours as N
from claimloom.operators import reasoning as W
from claimloom.operators import report as R
from claimloom.operators import tfidf
from claimloom.operators import scoring as C

#: Snippets of reviews that documents get, by doc_id.
SNIPPETS = [
    "Claim reviewed: 'The state government banned plastic bags in Kerala on Monday'. Rating: Mostly true",
    "Claim: A flood in Assam struck 300 villages in June. Rating: False",
    'Claim reviewed: "A staged event in Kerala on Monday: the state banned plastic bags". Rating: Fake',
    "Claim: a viral photo of plastic bags in Kerala on Monday Rating: misleading",
    "Claim: Nobody banned anything on 5 March 2024.",
    "Rating: Half true.",
    "",
]
REVIEWS = f"""SELECT doc_id, CASE doc_id % {len(SNIPPETS)} {' '.join(f"WHEN {k} THEN {CS.q(x)}" for k, x in enumerate(SNIPPETS))} END AS snippet, t AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'www.Snopes.com' ELSE source END AS domain, CASE WHEN doc_id % 4 = 0 THEN 'google_factcheck' ELSE 'news' END AS provider, CASE WHEN doc_id % 13 = 0 THEN 'Pants on Fire ' END AS given FROM ({CT.with_endings('documents', 'doc_id', CT.REPORTS).replace('SELECT doc_id', 'SELECT doc_id, source')})"""


def fact_check_alignment(spark, sf_dir):
    """Claims against their most relevant documents, many of which are fact-checks of one claim or another."""
    none = lambda kind="string": F.lit(None).cast(kind)
    reviews = CT.rows(spark, sf_dir, REVIEWS).withColumn("metadata", F.when(F.col("given").isNotNull(), F.create_map(F.lit("rating"), "given"))).drop("given")
    reviews = reviews.withColumns({"title": none(), "publisher": none(), "source_type": none()})
    claims, _, top = CT.claim_pairs(spark, sf_dir, reviews.select("doc_id", F.concat(F.lit(". "), "snippet", F.lit(" "), "content").alias("text")))
    got = FC.compare(E.beside(top).join(reviews, "doc_id").join(claims, "claim_id"))
    return got.select("claim_id", "doc_id", "fact_check", "rating", "reviewed", F.col("alignment.score").alias("score"), F.col("alignment.aligned").alias("aligned"), F.col("alignment.gate").alias("gate"), "method", "stance", "confidence", "relevance", "verdict")


_HITS = "list_filter(want, lambda x: contains(rl, lower(x)) OR (list_contains(figs, x) AND length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2 AND contains(rd, regexp_replace(x, '[^0-9]', '', 'g'))))"
ALIGNMENT_SQL = rf"""
WITH rv AS ({REVIEWS}), {CT.stance_sql("SELECT doc_id, '. ' || snippet || ' ' || content AS t FROM rv")},
 f0 AS (SELECT v0.*, snippet, contains(lower(domain), 'snopes') OR provider = 'google_factcheck' OR given IS NOT NULL AS fact_check,
   coalesce(trim(given), CASE WHEN regexp_matches(snippet, {CS.q(FC.RATING)}) THEN trim(regexp_extract(snippet, {CS.q(FC.RATING)}, 1)) END, 'Unknown') AS rating0,
   rtrim(coalesce(nullif(trim(regexp_extract(snippet, {CS.q(FC.REVIEWED[0])}, 1)), ''), nullif(trim(regexp_extract(snippet, {CS.q(FC.REVIEWED[1])}, 1)), '')), '.') AS rev0 FROM v0 JOIN rv USING (doc_id)),
 f1 AS (SELECT *, CASE WHEN fact_check THEN rating0 END AS rating, CASE WHEN fact_check THEN rev0 END AS reviewed FROM f0),
 f2 AS (SELECT *, lower(reviewed) AS rl, regexp_replace(reviewed, '[^0-9]', '', 'g') AS rd, list_concat(dates, numbers) AS figs, list_distinct(list_filter(list_concat(locations, list_transform(a, lambda x: x.text)), lambda x: length(x) > 2)) AS tms,
   {CT.CONTENT.format('claim')} AS c1, {CT.CONTENT.format("coalesce(reviewed, '')")} AS c2 FROM f1),
 f3 AS (SELECT *, CASE WHEN len(c1) = 0 OR len(c2) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(c1, c2))::DOUBLE / len(list_distinct(list_concat(c1, c2))) END AS jac, list_distinct(list_concat(tms, figs)) AS want,
   len(figs) > 0 AND len(list_filter(figs, lambda x: contains(rl, lower(x)) OR (length(regexp_replace(x, '[^0-9]', '', 'g')) >= 2 AND contains(rd, regexp_replace(x, '[^0-9]', '', 'g'))))) = 0 AS absent FROM f2),
 f4 AS (SELECT *, regexp_matches(reviewed, {CS.q(FC.HOAX)}) AND (len(list_filter(tms, lambda x: contains(rl, lower(x)))) > 0 OR jac >= 0.15) AS hoax,
   NOT regexp_matches(claim, {CS.q(rf"(?i){chr(92)}b{FC.MEDIA}{chr(92)}b")}) AND regexp_matches(reviewed, {CS.q(FC.MEDIA_DEBUNK)}) AS media, CASE WHEN len(want) > 0 THEN len({_HITS})::DOUBLE / len(want) ELSE 1.0 END AS cov FROM f3),
 f5 AS (SELECT *, CASE WHEN reviewed IS NULL THEN NULL WHEN absent THEN 0.15 WHEN hoax OR media THEN 0.1 ELSE round(0.5::DOUBLE * jac + 0.5::DOUBLE * cov, 2) END::DOUBLE AS score,
   CASE WHEN reviewed IS NOT NULL THEN NOT absent AND NOT hoax AND NOT media AND (jac >= 0.6 OR (jac >= 0.15 AND cov >= 0.5) OR (cov >= 0.8 AND jac >= 0.1 AND len(want) >= 2)) END AS aligned,
   CASE WHEN reviewed IS NULL THEN NULL WHEN absent THEN 'figures_absent' WHEN hoax THEN 'hoax_variant' WHEN media THEN 'media_debunk' ELSE 'overlap' END AS gate,
   CASE lower(rating) WHEN 'mostly true' THEN 'Mostly True:SUPPORTING' WHEN 'false' THEN 'False:CONTRADICTING' WHEN 'fake' THEN 'False:CONTRADICTING' WHEN 'misleading' THEN 'Misleading:CONTRADICTING' WHEN 'half true' THEN 'Half True:NEUTRAL'
     WHEN 'pants on fire' THEN 'Pants on Fire:CONTRADICTING' ELSE 'Unverified:NEUTRAL' END AS rated FROM f4)
SELECT claim_id, doc_id, fact_check, rating, reviewed, score, aligned, gate, CASE WHEN NOT fact_check THEN 'text' WHEN reviewed IS NULL THEN 'review_text' WHEN aligned THEN 'rating' ELSE 'mismatch' END AS method,
  CASE WHEN reviewed IS NULL THEN stance WHEN aligned THEN split_part(rated, ':', 2) ELSE 'NEUTRAL' END AS stance,
  (CASE WHEN reviewed IS NOT NULL THEN CASE WHEN aligned THEN 0.92 ELSE round(0.55::DOUBLE + 0.25::DOUBLE * score, 2) END WHEN denied THEN 0.9 WHEN len(conf) > 0 THEN 0.88 WHEN stance = 'INSUFFICIENT' THEN 0.7 WHEN stance = 'NEUTRAL' THEN 0.8 ELSE round(least(0.95, 0.75 + 0.06 * supported), 2) END)::DOUBLE AS confidence,
  CASE WHEN reviewed IS NULL THEN round(rel, 2) WHEN aligned THEN 0.95 ELSE round(0.25::DOUBLE + 0.5::DOUBLE * score, 2) END::DOUBLE AS relevance, CASE WHEN fact_check THEN split_part(rated, ':', 1) END AS verdict FROM f5
"""

#: Findings of a reasoning result for each claim, from its evidence: each of one or two ids, of which some are of other claims.
FINDINGS = f"""SELECT claim_id, evidence_id, CASE n_chars % 4 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'both' END AS side, CASE WHEN n_chars % 9 = 0 THEN evidence_id + 1000000 ELSE evidence_id END AS one, evidence_id + 12 AS two FROM ({CR.EVIDENCE})"""
ODD = "claim_id % 11 = 3", "claim_id % 13 = 5"


def reasoning(spark, sf_dir):
    rows = spark.sql(FINDINGS.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`").replace("JOIN labels", f"JOIN parquet.`{sf_dir}/labels.parquet`"))
    finding = F.struct(F.concat(F.lit("see http://a.org/"), "evidence_id").alias("text"), F.array("one", "two").alias("evidence_ids"), F.lit(0.9).alias("confidence"))
    side = lambda *s: F.array_sort(F.collect_list(F.when(F.col("side").isin(*s), finding)))
    out = rows.groupBy("claim_id").agg(side("up", "both").alias("supporting_findings"), side("down", "both").alias("contradicting_findings"))
    return out.withColumn("ai_used", ~F.expr(ODD[0])).withColumn("fallback_used", F.expr(ODD[1]))


def cross_verified_scores(spark, sf_dir):
    evidence = CR.evidence(spark, sf_dir)
    return X.cross_verify(C.claim_scores(CR.claims(spark, sf_dir)), evidence, reasoning(spark, sf_dir)).withColumn("adjustment", F.round("adjustment", 6))


def cross_sql(scores, labels):
    """``scores``: CTEs up to s and kk of the claims; the rescue scores claims by the same CTEs over other evidence."""
    other = f"""SELECT e1.* REPLACE (CASE WHEN list_contains(uids, evidence_id) THEN 'SUPPORTING' WHEN list_contains(dids, evidence_id) THEN 'CONTRADICTING' END AS stance, NULL::VARCHAR AS kind, NULL::VARCHAR AS fact_checker) FROM ({CR.EVIDENCE}) e1 JOIN g USING (claim_id)"""
    again = scores.replace(f"e AS ({CR.EVIDENCE})", f"e AS ({other})")
    again = again.replace("con.independent_supporting AS independent, con.independent_contradicting,", "(SELECT n_up_units FROM g WHERE g.claim_id = fig.claim_id) AS independent, (SELECT n_down_units FROM g WHERE g.claim_id = fig.claim_id) AS independent_contradicting,")
    again = again.replace("count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL')",
                          "(SELECT n_up FROM g WHERE g.claim_id = e.claim_id) AS supporting, (SELECT n_down FROM g WHERE g.claim_id = e.claim_id) AS contradicting, count(*) FILTER (stance = 'NEUTRAL')")
    return f"""
WITH x0 AS ({CR.EVIDENCE}), x1 AS ({FINDINGS}), x2 AS (SELECT x1.claim_id, side, list_filter([one, two], lambda x: list_contains(ids, x)) AS ids FROM x1 JOIN (SELECT claim_id, list(evidence_id) AS ids FROM x0 GROUP BY 1) USING (claim_id) WHERE side IS NOT NULL),
 x3 AS (SELECT * FROM x2 WHERE len(ids) > 0), x4 AS (SELECT claim_id, count(*) FILTER (side <> 'down') AS n_up, count(*) FILTER (side <> 'up') AS n_down, coalesce(list_distinct(flatten(list(ids) FILTER (side <> 'down'))), []) AS uids, coalesce(list_distinct(flatten(list(ids) FILTER (side <> 'up'))), []) AS dids FROM x3 GROUP BY 1),
 g AS (SELECT x4.*, (SELECT count(DISTINCT cluster) FROM x0 WHERE x0.claim_id = x4.claim_id AND list_contains(uids, evidence_id)) AS n_up_units, (SELECT count(DISTINCT cluster) FROM x0 WHERE x0.claim_id = x4.claim_id AND list_contains(dids, evidence_id)) AS n_down_units FROM x4
   WHERE NOT ({ODD[0]}) AND NOT ({ODD[1]})),
 first AS (WITH {scores} SELECT s.*, kk.raw AS agreement FROM s JOIN kk ON s.claim_id = kk.claim_id AND kk.factor = 'evidence_agreement'), later AS (WITH {again} SELECT claim_id, score AS saved FROM s WHERE score IS NOT NULL),
 m AS (SELECT first.*, n_up, n_down, CASE WHEN n_up + n_down > 0 THEN round(n_up::DOUBLE / (n_up + n_down) - agreement, 9) END AS diff FROM first LEFT JOIN g USING (claim_id)),
 n AS (SELECT *, CASE WHEN score IS NOT NULL AND abs(diff) >= 0.3 THEN greatest(-15.0::DOUBLE, least(15.0::DOUBLE, diff * 30)) END AS adjustment FROM m),
 o AS (SELECT n.* EXCLUDE (score), score AS old, saved, coalesce(CASE WHEN adjustment IS NOT NULL THEN round_even(round(greatest(0.0::DOUBLE, least(100.0::DOUBLE, score + adjustment)), 6), 0)::INTEGER END, score, CASE WHEN n_up + n_down >= 2 THEN saved END) AS score FROM n LEFT JOIN later USING (claim_id))
SELECT claim_id, doc, importance, score, CASE WHEN adjustment IS NOT NULL OR (old IS NULL AND score IS NOT NULL) THEN 'ai_assisted' WHEN score IS NULL THEN 'insufficient_evidence' ELSE 'deterministic' END AS scoring_method, round(adjustment, 6) AS adjustment, {labels} FROM o
"""


def finding_validation(spark, sf_dir):
    """Findings held against packets of the claims' own evidence."""
    evidence = CR.evidence(spark, sf_dir)
    texts = F.transform("f", lambda x: F.struct(x["text"].alias("text"), F.transform(x["evidence_ids"], lambda i: i.cast("string")).alias("evidence_ids"), x["confidence"].alias("confidence")))
    made = reasoning(spark, sf_dir)
    results = made.select("claim_id", F.slice("supporting_findings", 1, 0).alias("key"), "supporting_findings", "contradicting_findings")
    for name, column in (("key_findings", "key"), ("supporting_findings", "supporting_findings"), ("contradicting_findings", "contradicting_findings")):
        results = results.withColumn("f", F.col(column)).withColumn(name, texts)
    packets = evidence.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.when(F.col("n_chars") % 5 > 0, F.col("evidence_id").cast("string")))).alias("evidence_ids"), F.collect_list(F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("http://A.org/"), "evidence_id"))).alias("urls"))
    got = G.validate_findings(results.drop("f", "key"), packets)
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws("=", F.array_join(f["evidence_ids"], "+"), f["confidence"].cast("string"))), "|")
    return got.select("claim_id", told("supporting_findings").alias("supporting"), told("contradicting_findings").alias("contradicting"), F.size("warnings").cast("long").alias("n_warnings"), F.size("limitations").cast("long").alias("n_limitations"))


def _list_sql(name, before):
    return f"""list_transform({name}, lambda x, i: array_to_string(CASE WHEN len(list_filter(x.ids, lambda y: list_contains(pids, y))) > 0 OR len(pids) = 0 THEN list_filter(x.ids, lambda y: list_contains(pids, y)) ELSE pids[1:1] END, '+') || '='
   || CASE WHEN {before} OR len(list_filter({name}[1:i], lambda z: len(list_filter(z.ids, lambda y: NOT list_contains(pids, y))) > 0 OR NOT list_contains(purls, z.url))) > 0 THEN '0.75' ELSE '0.9' END)"""


_LOST = "(list_sum(list_transform({0}, lambda x: len(list_filter(x.ids, lambda y: NOT list_contains(pids, y))) + (NOT list_contains(purls, x.url))::INT)))"
FINDING_SQL = f"""
WITH x0 AS ({CR.EVIDENCE}), x1 AS ({FINDINGS}), p AS (SELECT claim_id, coalesce(list(evidence_id::VARCHAR ORDER BY evidence_id::VARCHAR) FILTER (n_chars % 5 > 0), []) AS pids, coalesce(list('http://a.org/' || evidence_id) FILTER (n_chars % 2 = 0), []) AS purls FROM x0 GROUP BY 1),
 l AS (SELECT claim_id, coalesce(list({{'ids': [one::VARCHAR, two::VARCHAR], 'url': 'http://a.org/' || evidence_id}} ORDER BY 'see http://a.org/' || evidence_id) FILTER (side IN ('up', 'both')), []) AS up,
   coalesce(list({{'ids': [one::VARCHAR, two::VARCHAR], 'url': 'http://a.org/' || evidence_id}} ORDER BY 'see http://a.org/' || evidence_id) FILTER (side IN ('down', 'both')), []) AS down FROM x1 GROUP BY 1), j AS (SELECT * FROM l JOIN p USING (claim_id)),
 n AS (SELECT *, coalesce({_LOST.format('up')}, 0) AS lost_up, coalesce({_LOST.format('down')}, 0) AS lost_down FROM j)
SELECT claim_id, array_to_string({_list_sql('up', 'false')}, '|') AS supporting, array_to_string({_list_sql('down', 'lost_up > 0')}, '|') AS contradicting, (lost_up + lost_down)::BIGINT AS n_warnings, (lost_up + lost_down > 0)::BIGINT AS n_limitations FROM n
"""


def name_grounding(spark, sf_dir):
    """Names of claims, their runs of capitalised words, in the documents that are most relevant to them."""
    claims, docs, top = CT.claim_pairs(spark, sf_dir)
    names = claims.select("claim_id", F.explode(F.array_distinct(F.regexp_extract_all("claim", F.lit(r"\p{Lu}[\p{L}\p{N}]+(?:\s+\p{Lu}[\p{L}\p{N}]+)*"), F.lit(0)))).alias("name"))
    got = G.best_windows(top.join(names, "claim_id").select(F.col("doc_id").alias("source_id"), "name"), docs.withColumnRenamed("doc_id", "source_id"))
    return got.select(F.col("source_id").alias("doc_id"), "name", F.round("likeness", 6).alias("likeness"))


def grounded_claims(spark, sf_dir):
    """Claims of the passages as if made from the documents that are most relevant to them."""
    claims, docs, top = CT.claim_pairs(spark, sf_dir)
    made = top.join(claims, "claim_id").select(F.col("doc_id").alias("source_id"), F.col("claim_id").alias("ord"), F.col("claim").alias("claim_text"), F.lit(0.5).alias("confidence"), F.transform("entities", lambda e: e["text"]).alias("names"))
    got = G.valid_claims(made, docs.withColumnRenamed("doc_id", "source_id"))
    return got.select(F.col("source_id").alias("doc_id"), F.col("place").cast("long").alias("place"), F.sha2("claim_text", 256).alias("claim"))


def embedding_clusters(spark, sf_dir):
    return N.embedding_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
 l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE list_dot_product(a.x, b.x) / (sqrt(list_dot_product(a.x, a.x)) * sqrt(list_dot_product(b.x, b.x))) >= 0.85),
 w AS (SELECT vec_id, vec_id AS other FROM v UNION SELECT w.vec_id, l.b FROM w JOIN l ON w.other = l.a), c AS (SELECT vec_id, min(other) AS cluster FROM w GROUP BY 1)
SELECT vec_id, cluster, (count(*) OVER (PARTITION BY cluster))::BIGINT AS size FROM c
"""

def tfidf_matches(spark, sf_dir):
    """Every twentieth document against all of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return tfidf.tfidf_matches(docs, "doc_id", docs.where(F.col("doc_id") % 20 == 0)).select("query", "doc_id", F.round("cosine", 6).alias("cosine"))


TFIDF_SQL = rf"""
WITH t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
 f AS (SELECT w, count(*) AS df FROM t GROUP BY 1), r AS (SELECT doc_id, w, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1.0::DOUBLE + df)) + 1) AS raw FROM t JOIN f USING (w)),
 v AS (SELECT doc_id, w, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS x FROM r), s AS (SELECT a.doc_id AS query, b.doc_id, sum(a.x * b.x) AS cosine FROM v a JOIN v b ON a.w = b.w AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY ALL)
SELECT query, doc_id, round(cosine, 6) AS cosine FROM s WHERE cosine >= 0.85
"""

def fallback_reasoning(spark, sf_dir):
    """Packets of the first ten items of each claim; every ninth claim has none."""
    e = CR.evidence(spark, sf_dir).withColumn("rank", F.row_number().over(Window.partitionBy("claim_id").orderBy("evidence_id")).cast("int")).where("rank <= 10")
    label = F.when(F.col("reliability") >= 75, "high").when(F.col("reliability") >= 50, "medium").otherwise("low")
    item = F.struct("rank", F.col("evidence_id").cast("string").alias("evidence_id"), F.col("domain").alias("publisher"), "stance", F.lower("category").alias("category"), label.alias("reliability"), F.lit(0.8).alias("confidence"),
                    F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("Point "), "evidence_id")).alias("point"))
    check = F.when(F.col("fact_checker").isNotNull(), F.struct("fact_checker", F.col("transparency").alias("raw_rating"), F.col("stance").alias("verdict"), "rank"))
    conflict = F.when(F.col("kind") == "NUMERIC", F.struct("rank", "aspect", F.lit("5 crore").alias("claim_value"), F.col("value").alias("evidence_value")))
    some = F.col("claim_id") % 9 > 0
    packets = e.groupBy("claim_id").agg(F.collect_list(F.when(some, item)).alias("items"), F.array_sort(F.collect_list(F.when(some, F.struct("rank", check.alias("c"))))).alias("checks"), F.array_sort(F.collect_list(F.when(some, conflict))).alias("conflicts"))
    sizes = e.where(some).groupBy("claim_id", "cluster").agg(F.count("*").alias("n")).groupBy("claim_id").agg(F.collect_list("n").alias("cluster_sizes"), F.count("*").alias("independent"))
    checks = F.transform(F.filter("checks", lambda x: x["c"].isNotNull()), lambda x: F.struct(x["c"]["fact_checker"].alias("fact_checker"), x["c"]["raw_rating"].alias("raw_rating"), x["c"]["verdict"].alias("verdict")))
    conflicts = F.transform("conflicts", lambda x: F.struct(x["aspect"].alias("aspect"), x["claim_value"].alias("claim_value"), x["evidence_value"].alias("evidence_value")))
    got = W.fallback_reasoning(packets.join(sizes, "claim_id", "left").select("claim_id", "items", checks.alias("fact_checks"), conflicts.alias("discrepancies"), "cluster_sizes", "independent"))
    told = lambda c: F.array_join(F.transform(c, lambda f: F.concat_ws("=", f["text"], F.array_join(f["evidence_ids"], "+"), f["importance"])), "|")
    return got.select("claim_id", "summary", "uncertainty", told("supporting_findings").alias("supporting"), told("contradicting_findings").alias("contradicting"), told("key_findings").alias("key"),
                      *[F.array_join(c, "|").alias(c) for c in ("important_discrepancies", "source_observations", "independence_observations", "fact_check_observations", "verification_gaps")])


def _finding_sql(stance, otherwise, weight):
    text = f"coalesce(point, domain || '{otherwise}') || '=' || evidence_id || '=' || {weight}"
    return f"coalesce(string_agg({text}, '|' ORDER BY rank) FILTER (stance = '{stance}'), '')", f"first({text} ORDER BY rank) FILTER (stance = '{stance}')"


_UP, _UP1 = _finding_sql("SUPPORTING", " reports corroboration for the claim.", "CASE WHEN reliability >= 75 THEN 'HIGH' ELSE 'MEDIUM' END")
_DOWN, _DOWN1 = _finding_sql("CONTRADICTING", " contradicts or refutes the claim.", "'HIGH'")
REASONING_SQL = f"""
WITH e0 AS ({CR.EVIDENCE}), e1 AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY evidence_id) AS rank, CASE WHEN n_chars % 2 = 0 THEN 'Point ' || evidence_id END AS point FROM e0), e AS (SELECT * FROM e1 WHERE rank <= 10 AND claim_id % 9 > 0),
 u AS (SELECT claim_id, count(*) AS n, count(*) FILTER (k > 1) AS many FROM (SELECT claim_id, cluster, count(*) AS k FROM e GROUP BY ALL) GROUP BY 1),
 a AS (SELECT claim_id, count(*) AS items, count(*) FILTER (stance = 'SUPPORTING') AS up, count(*) FILTER (stance = 'CONTRADICTING') AS down, {_UP} AS supporting, {_DOWN} AS contradicting, {_UP1} AS up1, {_DOWN1} AS down1,
   first(domain || ' discusses the topic, but provides inconclusive evidence.=' || evidence_id || '=LOW' ORDER BY rank) AS vague, bool_or(category = 'GOVERNMENT') AS prim, count(*) FILTER (reliability >= 75) AS high,
   string_agg('Conflict on ' || aspect || ': claim asserts ''5 crore'', but evidence reports ''' || value || '''.', '|' ORDER BY rank) FILTER (kind = 'NUMERIC') AS conflicts, first('Conflict on ' || aspect || ': claim asserts ''5 crore'', but evidence reports ''' || value || '''.' ORDER BY rank) FILTER (kind = 'NUMERIC') AS conflict1,
   string_agg('Fact check by ' || fact_checker || ' rated the claim ''' || transparency || ''' (' || stance || ').', '|' ORDER BY rank) FILTER (fact_checker IS NOT NULL) AS checks, first('A third-party fact check by ' || fact_checker || ' rated this claim ''' || stance || '''.' ORDER BY rank) FILTER (fact_checker IS NOT NULL) AS check1 FROM e GROUP BY 1),
 j AS (SELECT c.claim_id, coalesce(items, 0) AS items, coalesce(up, 0) AS up, coalesce(down, 0) AS down, coalesce(supporting, '') AS supporting, coalesce(contradicting, '') AS contradicting, up1, down1, vague, coalesce(prim, false) AS prim, coalesce(high, 0) AS high, conflicts, conflict1, checks, check1, coalesce(n, 0) AS n, many
   FROM (SELECT DISTINCT claim_id FROM e0) c LEFT JOIN a USING (claim_id) LEFT JOIN u USING (claim_id))
SELECT claim_id, concat_ws(' ', check1, CASE WHEN n > 0 THEN 'Retrieved evidence resolved into ' || n || ' independent cluster(s) (' || up || ' supporting, ' || down || ' contradicting).' ELSE 'Evidence retrieval yielded no independent corroborating sources.' END, conflict1) AS summary,
  CASE WHEN items = 0 OR down > 0 OR conflicts IS NOT NULL THEN 'HIGH' WHEN n < 2 OR up = 0 THEN 'MEDIUM' ELSE 'LOW' END AS uncertainty, supporting, contradicting, CASE WHEN up + down > 0 THEN concat_ws('|', up1, down1) ELSE coalesce(vague, '') END AS key,
  coalesce(conflicts, '') AS important_discrepancies, concat_ws('|', CASE WHEN prim THEN '{W.HAS_PRIMARY}' ELSE '{W.NO_PRIMARY}' END, CASE WHEN high > 0 THEN high || ' high-reliability publisher(s) are present in the evidence corpus.' END) AS source_observations,
  CASE WHEN many > 0 THEN many || ' multi-article syndication cluster(s) detected. Effective independent source count is ' || n || '.' WHEN n > 0 THEN '{W.DISTINCT}' ELSE 'Effective independent source count is ' || n || '.' END AS independence_observations,
  coalesce(checks, '{W.NO_CHECKS}') AS fact_check_observations, concat_ws('|', CASE WHEN n < 2 THEN 'Limited independent corroboration: only ' || n || ' independent source group(s) found.' END, CASE WHEN NOT prim THEN '{W.GAPS['primary']}' END, CASE WHEN conflicts IS NOT NULL THEN '{W.GAPS['conflict']}' END,
    CASE WHEN items = 0 THEN '{W.GAPS['none']}' END, CASE WHEN items > 0 AND up = 0 THEN '{R.NO_SUPPORT}' END) AS verification_gaps FROM j
"""


def score_texts(spark, sf_dir):
    """Summaries and limitations of scores."""
    lost = CR.penalties(spark, sf_dir)
    text = F.concat_ws(" ", "penalty_type", "detail")
    per = lost.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("place", text.alias("text")))).alias("lost"))
    rows = C.scored(CR.claims(spark, sf_dir)).join(per, "claim_id", "left").withColumn("lost", F.coalesce("lost", F.array().cast("array<struct<place:int,text:string>>")))
    own = F.transform(F.filter("lost", lambda x: x["place"] == 1), lambda x: x["text"])
    return rows.select("claim_id", W.score_summary(F.get("lost", F.lit(0))["text"]).alias("summary"), F.array_join(W.score_limitations(own), "|").alias("limitations"))


def texts_sql(scores, labels):
    return f"""
WITH {scores}, ls AS (SELECT s.*, {labels} FROM s), pt AS (SELECT claim_id, place, penalty_type || ' ' || detail AS text FROM pen), pa AS (SELECT claim_id, first(text ORDER BY place, text) AS top, string_agg(text, '|' ORDER BY text) FILTER (place = 1) AS own FROM pt GROUP BY 1),
 sg AS (SELECT claim_id, list(replace(factor, '_', ' ') ORDER BY list_position([{', '.join(f"'{f}'" for f in C.FACTORS)}], factor)) FILTER (contribution > 5) AS strong FROM kk GROUP BY 1)
SELECT claim_id, CASE WHEN score IS NULL THEN '{W.INSUFFICIENT}' ELSE concat_ws(' ', 'Claim evaluated as ''' || classification || ''' (score: ' || score || '/100).', CASE WHEN len(strong) > 0 THEN 'Strengths include strong ' || array_to_string(strong[1:2], ', ') || '.' END, 'Score reduced due to: ' || top) END AS summary,
  concat_ws('|', CASE WHEN score IS NULL THEN '{W.UNMET}' END, CASE WHEN sources < 3 THEN 'Evaluation is based on ' || sources || ' independent source cluster(s). Additional corroboration from secondary outlets recommended.' END, own) AS limitations
FROM ls JOIN (SELECT claim_id, sources FROM v) USING (claim_id) LEFT JOIN pa USING (claim_id) LEFT JOIN sg USING (claim_id)
"""

QUERIES = {
    "fact_check_alignment": fact_check_alignment, "cross_verified_scores": cross_verified_scores, "finding_validation": finding_validation, "name_grounding": name_grounding, "grounded_claims": grounded_claims,
    "embedding_clusters": embedding_clusters, "tfidf_matches": tfidf_matches, "fallback_reasoning": fallback_reasoning, "score_texts": score_texts,
}
#: Likeness by longest blocks has no SQL form: name_grounding and grounded_claims are tested against loops. cross_verified_scores and score_texts get their oracles in ``catalog``.
ORACLES = {"fact_check_alignment": ALIGNMENT_SQL, "finding_validation": FINDING_SQL, "embedding_clusters": EMBEDDING_SQL, "tfidf_matches": TFIDF_SQL, "fallback_reasoning": REASONING_SQL}


