"""Queries and DuckDB oracles of what follows from evidence rows: figures, penalties, clusters, cards, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.operators import assembly as A
from claimloom.operators import report as R
from claimloom.operators import scoring as C

#: Documents as evidence, twelve to a claim; labels give stances, languages categories, sources domains.
EVIDENCE = """
SELECT d.doc_id AS evidence_id, CAST(floor(d.doc_id / 12) AS BIGINT) AS claim_id, concat(CAST(floor(d.doc_id / 12) AS BIGINT), ':', coalesce(lang, '')) AS cluster,
  CASE WHEN toxic = 1 THEN 'CONTRADICTING' WHEN quality = 1 THEN 'SUPPORTING' WHEN quality = 0 THEN 'NEUTRAL' ELSE 'INSUFFICIENT' END AS stance,
  CAST(n_chars % 100 AS DOUBLE) / 100 AS relevance, CAST(n_chars % 101 AS BIGINT) AS reliability,
  CASE lang WHEN 'de' THEN 'GOVERNMENT' WHEN 'fr' THEN 'ACADEMIC' WHEN 'es' THEN 'FACT_CHECKER' ELSE 'NEWS_MEDIA' END AS category,
  CASE WHEN n_chars % 13 = 0 THEN 'OFFICIAL' WHEN n_chars % 7 = 0 THEN 'FACT_CHECK' ELSE 'NEWS' END AS source_type, CASE WHEN n_chars % 7 = 0 AND n_chars % 13 > 0 THEN source END AS fact_checker,
  CASE WHEN n_chars % 17 = 0 THEN 'reuters.com' ELSE source END AS domain, n_chars % 5 = 0 AS primary_, CAST(n_chars % 11 AS DOUBLE) / 10 AS meta_score,
  CASE n_chars % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNKNOWN' END AS transparency, CAST(n_chars AS BIGINT) AS n_chars, CASE WHEN n_chars % 3 > 0 THEN '2024-01-01' END AS published_at,
  CASE n_chars % 6 WHEN 0 THEN 'NUMERIC' WHEN 1 THEN 'POLARITY' WHEN 2 THEN 'TEMPORAL' END AS kind, CASE n_chars % 6 WHEN 0 THEN 'amount_crore' WHEN 1 THEN 'claim_action_or_status' WHEN 2 THEN 'timeframe_month' END AS aspect,
  CASE n_chars % 6 WHEN 0 THEN 'MAJOR' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MINOR' END AS severity, CASE WHEN n_chars % 6 < 3 THEN concat('Value ', n_chars % 4) END AS value, text
FROM documents AS d LEFT JOIN labels AS l ON d.doc_id = l.doc_id
"""


def evidence(spark, sf_dir):
    return spark.sql(EVIDENCE.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`").replace("JOIN labels", f"JOIN parquet.`{sf_dir}/labels.parquet`")).withColumnRenamed("primary_", "primary")


REP = f"""e AS ({EVIDENCE}), o AS (SELECT *, round(CASE WHEN category IN ('GOVERNMENT', 'REGULATORY') THEN 50.0::DOUBLE WHEN category = 'FACT_CHECKER' THEN 40 WHEN domain IN ('reuters.com', 'apnews.com', 'afp.com') THEN 45 ELSE 0 END
    + CASE WHEN primary_ THEN 20.0::DOUBLE ELSE 0 END + meta_score * 10.0::DOUBLE + least(coalesce(n_chars, 0) / 100.0::DOUBLE, 15) + CASE WHEN coalesce(published_at, '') <> '' THEN 10.0::DOUBLE ELSE 0 END, 6) AS origin FROM e),
 rep AS (SELECT claim_id, cluster, evidence_id AS representative, stance AS cluster_stance, count(*) OVER (PARTITION BY claim_id, cluster) AS size FROM o QUALIFY row_number() OVER (PARTITION BY claim_id, cluster ORDER BY origin DESC, evidence_id) = 1)"""


def representatives(spark, sf_dir):
    return R.item_status(evidence(spark, sf_dir))


REPRESENTATIVES_SQL = f"""WITH {REP} SELECT claim_id, cluster, evidence_id, CASE WHEN evidence_id = representative THEN 'LIKELY_INDEPENDENT' ELSE 'LIKELY_DERIVED' END AS status,
  (CASE WHEN size = 1 THEN 0.9 WHEN evidence_id = representative THEN 0.8 ELSE 0.85 END)::DOUBLE AS confidence, size - 1 AS related FROM e JOIN rep USING (claim_id, cluster)"""


def duplicate_clusters(spark, sf_dir):
    return R.duplicate_clusters(evidence(spark, sf_dir)).withColumn("others", F.array_join(F.col("others").cast("array<string>"), ","))


DUPLICATE_CLUSTERS_SQL = f"""WITH {REP} SELECT claim_id, cluster, representative, size, string_agg(evidence_id::VARCHAR, ',' ORDER BY evidence_id) FILTER (evidence_id <> representative) AS others
 FROM e JOIN rep USING (claim_id, cluster) WHERE size > 1 GROUP BY ALL"""


def cluster_consensus(spark, sf_dir):
    """With some items of no cluster and some without a comparison."""
    given = evidence(spark, sf_dir).withColumn("cluster", F.when(F.col("n_chars") % 19 > 0, F.col("cluster"))).withColumn("stance", F.when(F.col("n_chars") % 7 > 2, F.col("stance")))
    return R.cluster_consensus(given)


def consensus_cte(rep):
    """``rep``: CTEs to e and o. Adds raw, per and con."""
    return f"""{rep}, un AS (SELECT *, coalesce(cluster, 'item ' || evidence_id) AS unit FROM o), md AS (SELECT claim_id, unit, stance AS most FROM (SELECT claim_id, unit, stance, count(*) AS n FROM un WHERE stance IS NOT NULL GROUP BY ALL)
   QUALIFY row_number() OVER (PARTITION BY claim_id, unit ORDER BY n DESC, stance) = 1), us AS (SELECT claim_id, coalesce(stance, most) AS unit_stance FROM (SELECT * FROM un QUALIFY row_number() OVER (PARTITION BY claim_id, unit ORDER BY origin DESC, evidence_id) = 1) LEFT JOIN md USING (claim_id, unit)),
 per AS (SELECT claim_id, count(*) FILTER (unit_stance = 'SUPPORTING') AS independent_supporting, count(*) FILTER (unit_stance = 'CONTRADICTING') AS independent_contradicting FROM us GROUP BY 1),
 raw AS (SELECT claim_id, count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(stance) AS items, count(fact_checker) FILTER (stance IS NOT NULL) AS fact_checks FROM e GROUP BY 1),
 con AS (SELECT *, CASE WHEN independent_supporting + independent_contradicting > 0 THEN round(independent_supporting::DOUBLE / (independent_supporting + independent_contradicting), 3) ELSE 0.0::DOUBLE END AS agreement_ratio FROM raw JOIN per USING (claim_id))"""


CONSENSUS = consensus_cte(REP)
PARTED = REP.replace(f"e AS ({EVIDENCE})", f"e0 AS ({EVIDENCE}), e AS (SELECT * REPLACE (CASE WHEN n_chars % 19 > 0 THEN cluster END AS cluster, CASE WHEN n_chars % 7 > 2 THEN stance END AS stance) FROM e0)")
CONSENSUS_SQL = f"""WITH {consensus_cte(PARTED)} SELECT *, CASE WHEN independent_supporting > 0 AND independent_contradicting = 0 THEN independent_supporting || ' independent source(s) corroborate the claim (' || supporting || ' total article(s)).'
  WHEN independent_supporting > 0 THEN 'Conflicting reporting: ' || independent_supporting || ' independent source(s) support, while ' || independent_contradicting || ' contradict (' || round_even(round(agreement_ratio * 100, 6), 0)::INTEGER || '% agreement).'
  WHEN independent_contradicting > 0 THEN independent_contradicting || ' independent source(s) contradict the claim.' ELSE 'No conclusive supporting or contradicting evidence found across ' || items || ' retrieved item(s).' END AS summary FROM con"""


def key_discrepancies(spark, sf_dir):
    return R.key_discrepancies(evidence(spark, sf_dir))


DISCREPANCIES = "k AS (SELECT claim_id, evidence_id, kind, aspect, severity, value FROM e WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY claim_id, kind, aspect, lower(value) ORDER BY evidence_id) = 1)"
DISCREPANCIES_SQL = f"WITH e AS ({EVIDENCE}), {DISCREPANCIES} SELECT * FROM k"


def penalties(spark, sf_dir):
    return R.penalties(evidence(spark, sf_dir))


PENALTIES = f"""{DISCREPANCIES}, kd AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY claim_id, kind, aspect ORDER BY evidence_id) = 1),
 fc AS (SELECT DISTINCT claim_id, fact_checker FROM e WHERE stance = 'CONTRADICTING' AND fact_checker IS NOT NULL),
 st AS (SELECT claim_id, count(*) AS n FROM e WHERE stance = 'CONTRADICTING' AND (reliability >= 75 OR category IN ('GOVERNMENT', 'REGULATORY', 'INTERNATIONAL_ORGANIZATION', 'ACADEMIC')) AND claim_id NOT IN (SELECT claim_id FROM fc) GROUP BY 1),
 an AS (SELECT claim_id, count(*) AS n FROM e WHERE stance = 'SUPPORTING' GROUP BY 1 HAVING bool_and(CASE WHEN meta_score > 0 THEN meta_score < 0.4 ELSE transparency = 'LOW' END) OR bool_and(reliability < 40)),
 pen AS (SELECT claim_id, 1 AS place, lower(kind) || '_discrepancy' AS penalty_type, aspect AS detail, (CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'MAJOR' THEN 10 ELSE 5 END)::DOUBLE AS amount FROM kd
  UNION ALL SELECT claim_id, 2, 'fact_check_refutation', fact_checker, 25.0 FROM fc UNION ALL SELECT claim_id, 2, 'reputable_source_refutation', n::VARCHAR, 25.0 FROM st UNION ALL SELECT claim_id, 3, 'anonymous_unindexed_sources', n::VARCHAR, 10.0 FROM an)"""
PENALTIES_SQL = f"WITH e AS ({EVIDENCE}), {PENALTIES} SELECT * FROM pen"

#: Claims with what their scores are made of: five to a document, with an importance by their place.
IMPORTANCE = "CASE claim_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END"
FIGURES = f"""{CONSENSUS}, {PENALTIES}, fig AS (SELECT claim_id, count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL') AS neutral,
   avg(reliability) FILTER (stance = 'SUPPORTING') AS support_reliability, avg(reliability) AS mean_reliability, avg(CASE WHEN fact_checker IS NOT NULL THEN CASE stance WHEN 'SUPPORTING' THEN 1.0::DOUBLE WHEN 'CONTRADICTING' THEN 0 ELSE 0.5 END END) AS fact_check_mean,
   bool_or(stance = 'SUPPORTING' AND (source_type IN ('OFFICIAL', 'PRIMARY_DOCUMENT') OR category IN ('GOVERNMENT', 'REGULATORY', 'INTERNATIONAL_ORGANIZATION', 'ACADEMIC'))) AS official, bool_or(stance = 'SUPPORTING' AND primary_) AS primary_support,
   round(avg(CASE WHEN meta_score > 0 THEN meta_score ELSE CASE transparency WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.7 WHEN 'LOW' THEN 0.3 ELSE 0.5 END END), 6) AS transparency_mean FROM e GROUP BY 1),
 lost AS (SELECT claim_id, sum(amount) AS penalty FROM pen GROUP BY 1),
 v AS (SELECT fig.*, claim_id // 5 AS doc, {IMPORTANCE} AS importance, con.independent_supporting AS independent, con.independent_contradicting, (SELECT count(DISTINCT unit) FROM un WHERE un.claim_id = fig.claim_id) AS sources, coalesce(penalty, 0.0::DOUBLE) AS penalty FROM fig JOIN con USING (claim_id) LEFT JOIN lost USING (claim_id))"""


def claims(spark, sf_dir):
    return R.claim_figures(evidence(spark, sf_dir)).withColumn("doc", F.floor(F.col("claim_id") / 5)).withColumn("importance", F.expr(IMPORTANCE))


def claim_figures(spark, sf_dir):
    return claims(spark, sf_dir).select("claim_id", F.round("support_reliability", 6).alias("support_reliability"), F.round("mean_reliability", 6).alias("mean_reliability"), F.round("fact_check_mean", 6).alias("fact_check_mean"),
                                        "official", "primary_support", "transparency_mean", "independent", "penalty")


FIGURES_SQL = f"WITH {FIGURES} SELECT claim_id, round(support_reliability, 6) AS support_reliability, round(mean_reliability, 6) AS mean_reliability, round(fact_check_mean, 6) AS fact_check_mean, official, primary_support, transparency_mean, independent, penalty FROM v"


def score_breakdown(spark, sf_dir):
    return R.breakdown(C.components(claims(spark, sf_dir)), penalties(spark, sf_dir))


def breakdown_sql(components):
    """``components``: CTEs up to k (claim_id, factor, contribution)."""
    order = ", ".join(f"'{f}'" for f in C.FACTORS)
    return f"""WITH {components}, al AS (SELECT claim_id, factor, contribution, list_position([{order}], factor) - 1 AS place, '' AS detail FROM kk UNION ALL SELECT claim_id, penalty_type, -amount, place + {len(C.FACTORS)}, detail FROM pen)
 SELECT claim_id, factor, contribution, detail, row_number() OVER (PARTITION BY claim_id ORDER BY abs(contribution) DESC, place, factor, detail) AS rank FROM al"""


def evidence_cards(spark, sf_dir):
    return R.evidence_cards(evidence(spark, sf_dir))


CARDS_SQL = f"""WITH e AS ({EVIDENCE}) SELECT claim_id, evidence_id, stance AS card, CASE WHEN stance IN ('SUPPORTING', 'CONTRADICTING') THEN lower(stance) ELSE 'neutral' END AS part, lower(category) AS category,
  row_number() OVER (PARTITION BY claim_id, stance ORDER BY coalesce(relevance, 0) DESC, evidence_id) AS rank FROM e"""


def pairs(spark, sf_dir):
    """Pairs of one cluster: duplicates where their texts are equal, else syndicated; counted by text, not made one by one."""
    e = evidence(spark, sf_dir).select("claim_id", "cluster", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("h"), "evidence_id")
    a, b = e.alias("a"), e.alias("b")
    return a.join(b, (F.col("a.claim_id") == F.col("b.claim_id")) & (F.col("a.cluster") == F.col("b.cluster")) & (F.col("a.evidence_id") < F.col("b.evidence_id"))).select("a.claim_id", (F.col("a.h") == F.col("b.h")).alias("duplicate"))


def evidence_summary(spark, sf_dir):
    return R.evidence_summary(evidence(spark, sf_dir), pairs(spark, sf_dir))


SUMMARY = f"""e AS ({EVIDENCE}), pr AS (SELECT a.claim_id, coalesce(a.text, '') = coalesce(b.text, '') AS dup FROM e a JOIN e b ON a.claim_id = b.claim_id AND a.cluster = b.cluster AND a.evidence_id < b.evidence_id),
 pc AS (SELECT claim_id, count(*) FILTER (dup) AS duplicates, count(*) FILTER (NOT dup) AS syndicated FROM pr GROUP BY 1),
 sm AS (SELECT claim_id, count(*) AS total, count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL') AS neutral,
   count(*) FILTER (stance = 'INSUFFICIENT') AS insufficient, count(DISTINCT cluster) AS independent, count(fact_checker) AS fact_checks FROM e GROUP BY 1),
 su AS (SELECT sm.*, coalesce(duplicates, 0) AS duplicates, coalesce(syndicated, 0) AS syndicated FROM sm LEFT JOIN pc USING (claim_id))"""
SUMMARY_SQL = f"WITH {SUMMARY} SELECT * FROM su"


def document_summary(spark, sf_dir):
    return R.document_summary(evidence_summary(spark, sf_dir).withColumn("doc", F.floor(F.col("claim_id") / 5)))


DOCUMENT_SUMMARY_SQL = f"WITH {SUMMARY} SELECT claim_id // 5 AS doc, " + ", ".join(
    f"sum({c})::BIGINT AS {c}" for c in ("total", "supporting", "contradicting", "neutral", "insufficient", "independent", "fact_checks", "duplicates", "syndicated")) + " FROM su GROUP BY 1"


def report_order(spark, sf_dir):
    ids = evidence(spark, sf_dir).select("claim_id").distinct()
    return R.report_order(ids.withColumn("doc", F.floor(F.col("claim_id") / 5)).withColumn("importance", F.expr(IMPORTANCE)))


ORDER_SQL = f"""WITH e AS ({EVIDENCE}), c AS (SELECT DISTINCT claim_id, claim_id // 5 AS doc, {IMPORTANCE} AS importance FROM e)
SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE importance WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, claim_id) AS place FROM c"""

CITED = "SELECT page_id % 97 AS evidence_id, CASE WHEN page_id % 4 = 0 THEN concat(' ', upper(url), ' ') WHEN page_id % 9 = 0 THEN concat(url, '/made-up') ELSE url END AS url, page_id AS ord FROM pages"


def citations(spark, sf_dir):
    pool = spark.read.parquet(f"{sf_dir}/pages.parquet").where("page_id % 5 > 0").select("url")
    return R.citations(spark.sql(CITED.replace("FROM pages", f"FROM parquet.`{sf_dir}/pages.parquet`")), pool)


CITATIONS_SQL = f"""WITH c AS ({CITED}), u AS (SELECT DISTINCT lower(trim(url)) AS url FROM pages WHERE page_id % 5 > 0 AND url IS NOT NULL AND url <> '')
SELECT evidence_id, c.url, ord FROM c WHERE lower(trim(coalesce(c.url, ''))) IN (SELECT url FROM u) QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY ord) = 1"""

GIVEN_GAPS = [[], ["No supporting evidence so far"], ["no RELEVANT external evidence", "x"]]


def absence_gaps(spark, sf_dir):
    """Claims with the gaps that their evidence leaves; every fourth claim counts as one without evidence."""
    per = evidence(spark, sf_dir).groupBy("claim_id").agg(F.when(F.col("claim_id") % 4 == 0, 0).otherwise(F.count("*")).alias("total"), F.count_if(F.col("stance") == "SUPPORTING").alias("supporting"))
    given = F.get(F.array(*[F.array(*[F.lit(g) for g in gs]).cast("array<string>") for gs in GIVEN_GAPS]), (F.col("claim_id") % 3).cast("int"))
    once = R.with_absence_gaps(given, F.col("total"), F.col("supporting"))
    twice = R.with_absence_gaps(F.col("once"), F.col("total"), F.col("supporting"))
    return per.withColumn("once", once).select("claim_id", F.array_join(twice, "|").alias("gaps"), F.array_join(F.transform(R.typed_gaps(F.col("once")), lambda g: g["gap_type"]), ",").alias("types"))


GAPS_SQL = f"""WITH e AS ({EVIDENCE}), p AS (SELECT claim_id, CASE WHEN claim_id % 4 = 0 THEN 0 ELSE count(*) END AS total, count(*) FILTER (stance = 'SUPPORTING') AS supporting FROM e GROUP BY 1),
 g AS (SELECT *, CASE claim_id % 3 WHEN 0 THEN []::VARCHAR[] WHEN 1 THEN ['No supporting evidence so far'] ELSE ['no RELEVANT external evidence', 'x'] END AS gs FROM p),
 a AS (SELECT claim_id, CASE WHEN total = 0 AND claim_id % 3 < 2 THEN list_append(gs, 'No relevant external evidence could be retrieved for this claim; no independent assessment was possible.')
   WHEN total > 0 AND supporting = 0 AND claim_id % 3 <> 1 THEN list_append(gs, 'No supporting evidence was retrieved for this claim in the searched sources; no independent source corroborates the assertion.') ELSE gs END AS gs FROM g)
SELECT claim_id, array_to_string(gs, '|') AS gaps, array_to_string(list_transform(gs, lambda x: 'evidence_gap'), ',') AS types FROM a"""

def claim_rows(spark, sf_dir):
    """Claims of the evidence, of which some have none: five to a document."""
    return evidence(spark, sf_dir).select("claim_id").distinct().select("claim_id", F.floor(F.col("claim_id") / 5).alias("doc"), (F.col("claim_id") % 5).alias("place"), F.expr(IMPORTANCE).alias("importance"),
                                                                       F.concat(F.lit("Claim "), "claim_id").alias("claim_text"))


def reports(spark, sf_dir):
    got = A.reports(claim_rows(spark, sf_dir), evidence(spark, sf_dir).where(F.col("claim_id") % 17 != 3))
    cards = lambda c, s: F.array_join(F.transform(c[f"{s}_evidence"], lambda x: x["evidence_id"].cast("string")), "+")
    told = F.array_join(F.transform("claims", lambda c: F.concat_ws("/", c["claim_id"].cast("string"), c["importance"], F.coalesce(c["score"].cast("string"), F.lit("-")), c["summary"], c["sources"].cast("string"), cards(c, "supporting"), cards(c, "contradicting"))), "|")
    return got.select("doc", "score", "classification", "executive_summary", told.alias("claims"), *A.TOTALS, "sources")


def report_totals(spark, sf_dir):
    return A.totals(evidence(spark, sf_dir).withColumn("doc", F.floor(F.col("claim_id") / 5)))


def _put(text, value):
    return "'" + text.replace("'", "''").replace("{}", f"' || {value} || '") + "'"


def reports_sql(scores, labels):
    """``scores``: CTEs up to s (claim_id, doc, importance, score), v and k of the claims with evidence."""
    some = scores.replace(f"e AS ({EVIDENCE})", f"e AS (SELECT * FROM ({EVIDENCE}) WHERE claim_id % 17 <> 3)")
    texts = " ".join(f"WHEN classification = '{k}' THEN {_put(t, 'sources')}" for k, t in A.CLAIM_TEXTS.items())
    count = lambda kinds, text: f"CASE WHEN count(*) FILTER (score IS NOT NULL AND classification IN ({kinds})) > 0 THEN count(*) FILTER (score IS NOT NULL AND classification IN ({kinds})) || ' {text}' END"
    return f"""
WITH all_claims AS (SELECT DISTINCT claim_id, claim_id // 5 AS doc, claim_id % 5 AS place, {IMPORTANCE} AS importance FROM ({EVIDENCE})),
 got AS (WITH {some}, cnt AS (SELECT claim_id, count(*) AS items, count(*) FILTER (stance = 'SUPPORTING') AS supporting, count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL') AS neutral, count(*) FILTER (stance = 'INSUFFICIENT') AS insufficient,
    count(fact_checker) AS fact_checks, string_agg(evidence_id::VARCHAR, '+' ORDER BY relevance DESC, evidence_id) FILTER (stance = 'SUPPORTING') AS sup, string_agg(evidence_id::VARCHAR, '+' ORDER BY relevance DESC, evidence_id) FILTER (stance = 'CONTRADICTING') AS con FROM e GROUP BY 1)
   SELECT claim_id, score, sources, (SELECT count(DISTINCT kind || ':' || aspect || ':' || lower(value)) FROM e WHERE e.claim_id = s.claim_id AND kind IS NOT NULL) AS discrepancies, cnt.* EXCLUDE (claim_id) FROM s JOIN (SELECT claim_id, sources FROM v) USING (claim_id) JOIN cnt USING (claim_id)),
 c0 AS (SELECT a.claim_id, doc, place, importance, score, {', '.join(f'coalesce({c}, 0) AS {c}' for c in (*A.TOTALS, 'sources', 'discrepancies'))}, coalesce(sup, '') AS sup, coalesce(con, '') AS con, {labels} FROM all_claims a LEFT JOIN got USING (claim_id)),
 c1 AS (SELECT *, CASE WHEN score IS NULL THEN {_put(A.TOO_LITTLE, 'sources')} ELSE concat_ws(' ', CASE {texts} END, CASE WHEN fact_checks > 0 THEN fact_checks || ' verified fact-check review(s) were analyzed.' END,
   CASE WHEN discrepancies > 0 THEN discrepancies || ' factual discrepancy(ies) were identified against reporting.' END) END AS summary, CASE importance WHEN 'HIGH' THEN 1.0::DOUBLE WHEN 'MEDIUM' THEN 0.7 ELSE 0.4 END AS w FROM c0),
 d0 AS (SELECT doc, round_even(round(sum(w * score) FILTER (score IS NOT NULL) / sum(w) FILTER (score IS NOT NULL), 6), 0)::INTEGER AS score, count(*) AS n, count(score) AS n_scored, {', '.join(f'sum({c})::BIGINT AS {c}' for c in (*A.TOTALS, 'sources'))},
   concat_ws(', ', {count("'STRONGLY SUPPORTED', 'MOSTLY SUPPORTED'", 'supported by independent evidence')}, {count("'STRONGLY CONTRADICTED', 'WEAKLY SUPPORTED'", 'contradicted or contested')}, {count("'MIXED / UNCERTAIN'", 'with mixed evidence')},
     CASE WHEN count(*) > count(score) THEN (count(*) - count(score)) || ' with insufficient corroboration' END) AS parts,
   string_agg(claim_id || '/' || importance || '/' || coalesce(score::VARCHAR, '-') || '/' || summary || '/' || sources || '/' || sup || '/' || con, '|' ORDER BY CASE importance WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END, place) AS claims FROM c1 GROUP BY doc),
 d1 AS (SELECT *, {labels} FROM d0)
SELECT doc, score, classification, {', '.join(A.TOTALS)}, sources, claims, 'The submitted content contains ' || n || ' material factual claim(s). ' || CASE WHEN n_scored = 0 THEN '{A.ALL_BELOW}' ELSE 'Analysis indicates: ' || parts || '. ' ||
  CASE WHEN score IS NOT NULL THEN 'The overall document credibility is evaluated as ''' || classification || ''' (' || score || '/100).' ELSE 'Overall document assessment is ''' || classification || '''.' END END || ' {A.CAVEAT}' AS executive_summary FROM d1
"""


TOTALS_SQL = f"""WITH e AS (SELECT *, claim_id // 5 AS doc FROM ({EVIDENCE})) SELECT doc, claim_id, CASE GROUPING(doc, claim_id) WHEN 0 THEN 'claim' WHEN 1 THEN 'document' ELSE 'all' END AS level, count(*) AS items, count(*) FILTER (stance = 'SUPPORTING') AS supporting,
 count(*) FILTER (stance = 'CONTRADICTING') AS contradicting, count(*) FILTER (stance = 'NEUTRAL') AS neutral, count(*) FILTER (stance = 'INSUFFICIENT') AS insufficient, count(fact_checker) AS fact_checks, count(DISTINCT cluster) AS sources FROM e GROUP BY ROLLUP (doc, claim_id)"""

QUERIES = {
    "reports": reports, "report_totals": report_totals,
    "representatives": representatives, "duplicate_clusters": duplicate_clusters, "cluster_consensus": cluster_consensus, "key_discrepancies": key_discrepancies, "penalties": penalties, "claim_figures": claim_figures,
    "score_breakdown": score_breakdown, "evidence_cards": evidence_cards, "evidence_summary": evidence_summary, "document_summary": document_summary, "report_order": report_order, "citations": citations, "absence_gaps": absence_gaps,
}
ORACLES = {
    "report_totals": TOTALS_SQL,
    "representatives": REPRESENTATIVES_SQL, "duplicate_clusters": DUPLICATE_CLUSTERS_SQL, "cluster_consensus": CONSENSUS_SQL, "key_discrepancies": DISCREPANCIES_SQL, "penalties": PENALTIES_SQL, "claim_figures": FIGURES_SQL,
    "evidence_cards": CARDS_SQL, "evidence_summary": SUMMARY_SQL, "document_summary": DOCUMENT_SUMMARY_SQL, "report_order": ORDER_SQL, "citations": CITATIONS_SQL, "absence_gaps": GAPS_SQL,
}
