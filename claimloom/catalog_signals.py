"""Queries and DuckDB oracles of text and source signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from claimloom.functions import lexicon as W
from claimloom.functions import numbers as N
from claimloom.functions import text as T
from claimloom.operators import signals as S

#: Endings that documents get, by doc_id, so that every signal occurs in ordinary text.
PLANTS = [
    " The RBI said that the Govt. will pay Rs. 5,000 crore, up 25 bps and 100 basis points, and the law was approved on Monday.",
    ' According to officials, "prices rose 6.5%" and $3.2 billion was spent in Kerala by 5 March 2024; monday in KERALA again.',
    " Documents obtained by our reporter, in a press release: exchange filing of ₹500 crore in Tamil Nadu on 2024-05-06, 7 cr more.",
    " The Minister and the minister denied it; the claim is fake news. Officials have no evidence of ₹10, of 20 per cent or of 30 %.",
    " In an interview with scientists, a study published in a peer-reviewed journal showed that 300 workers left the US because of it.",
    " Our correspondent stated on Friday: the tower is still the tallest",
    "",
]
CASES = " ".join(f"WHEN {k} THEN '{p}'" for k, p in enumerate(PLANTS))
PLANTED = f"SELECT doc_id, concat(coalesce(text, ''), CASE doc_id % {len(PLANTS)} {CASES} END) AS t FROM documents"


def planted(spark, sf_dir):
    return spark.sql(PLANTED.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))


def edge(words):
    """A test for whole words, by letters of any script."""
    return rf"(?i)(^|[^\p{{L}}\p{{N}}_])({words})($|[^\p{{L}}\p{{N}}_])"


def q(x):
    return "'" + x.replace("'", "''") + "'"


def source_signals(spark, sf_dir):
    t = F.col("t")
    return planted(spark, sf_dir).select("doc_id", S.attributed(t).alias("attributed"), t.rlike(S.QUOTED).alias("has_quotes"), F.array_join(S.named_sources(t), ",").alias("named"),
                                         S.statement_type(t).alias("statement_type"), F.array_join(S.primary_signals(t), ",").alias("signals"))


SOURCE_SIGNALS_SQL = rf"""
WITH p AS ({PLANTED}), a AS (SELECT *, regexp_matches(t, '["“][^"”]{{5,}}["”]') AS has_quotes,
  list_transform(regexp_extract_all(t, '(?i)\b(spokesperson|minister|prime minister|secretary|governor|commissioner|director|researchers|scientists|investigators|officials|regulators|analysts)\b'),
                 lambda x: upper(x[1]) || lower(x[2:])) AS actors FROM p),
 d AS (SELECT *, list_filter(actors, lambda x, i: list_position(actors, x) = i)[1:3] AS named FROM a)
SELECT doc_id, has_quotes OR len(named) > 0 OR regexp_matches(t, {q(edge(S.ATTRIBUTION))}) AS attributed, has_quotes, array_to_string(named, ',') AS named,
  CASE WHEN contains(lower(t), 'press release') THEN 'press_release' WHEN contains(lower(t), 'statement') THEN 'official_statement' WHEN contains(lower(t), 'filing') THEN 'regulatory_filing' WHEN has_quotes THEN 'direct_quote' END AS statement_type,
  concat_ws(',', {', '.join(f"CASE WHEN regexp_matches(t, {q(edge(p))}) THEN '{k}' END" for k, p in S.PRIMARY.items())}) AS signals FROM d
"""


def claim_normalize(spark, sf_dir):
    out = F.col("out")
    rows = planted(spark, sf_dir).select("doc_id", S.normalize_claim(F.col("t")).alias("out"))
    return rows.select("doc_id", T.digest(out).alias("digest"), F.substring(F.reverse(out), 1, 60).alias("end_reversed"))


def _normal_sql(text="t"):
    out = f"trim({text})"
    for pattern, long in S.ABBREVIATIONS.items():
        out = f"regexp_replace({out}, {q(pattern)}, {q(long)}, 'g')"
    for pattern, code in S.CURRENCIES.items():
        out = f"regexp_replace({out}, {q(pattern)}, '\\1 {code}', 'g')"
    return out


def normalize_sql(source):
    """CTE ``source``_n: ``source`` (t, ...) with its normal form ``normal``."""
    return rf"""{source}_na AS (SELECT *, {_normal_sql()} AS n0 FROM {source}), {source}_nb AS (SELECT *, string_split_regex(n0, {q(S.POINTS)}) AS gaps, regexp_extract_all(n0, {q(S.POINTS)}, 1) AS points FROM {source}_na),
 {source}_nc AS (SELECT * EXCLUDE (n0, gaps, points), trim(regexp_replace(array_to_string(list_transform(gaps, lambda g, i: g || CASE WHEN i <= len(points) THEN (points[i]::INTEGER / 100.0)::DOUBLE::VARCHAR || '%' ELSE '' END), ''), '\s+', ' ', 'g')) AS n1 FROM {source}_nb),
 {source}_n AS (SELECT * EXCLUDE (n1), CASE WHEN n1 = '' OR regexp_matches(n1, '[.!?]$') THEN n1 ELSE n1 || '.' END AS normal FROM {source}_nc)"""


CLAIM_NORMALIZE_SQL = f"WITH p AS ({PLANTED}), {normalize_sql('p')} SELECT doc_id, sha256(normal) AS digest, left(reverse(normal), 60) AS end_reversed FROM p_n"


def sentences(spark, sf_dir):
    return planted(spark, sf_dir).select("doc_id", F.posexplode(T.sentences(F.col("t"))).alias("n", "s")).withColumn("n", F.col("n").cast("long"))


SENTENCES = rf"""p AS ({PLANTED}), s0 AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: len(x) > 5) AS ss FROM p),
 s AS (SELECT doc_id, unnest(ss) AS s, unnest(generate_series(0, len(ss) - 1)) AS n FROM s0)"""


def factual_signals(spark, sf_dir):
    return sentences(spark, sf_dir).select("doc_id", "n", S.is_factual(F.col("s")).alias("factual"))


FACTUAL = rf"""(regexp_matches({{0}}, '[0-9]') OR regexp_matches({{0}}, '(?i){S.CURRENCY}') OR regexp_matches({{0}}, {q(edge('|'.join([S.DAYS, S.CAUSES])))}) OR {W.has_word_sql('{0}', W.event_words() + W.SAYING)}
  OR regexp_matches({{0}}, '(?i)(^|[^\p{{{{L}}}}\p{{{{N}}}}_])(is|are|was|were)($|[^\p{{{{L}}}}\p{{{{N}}}}_.?!])([^.?!]{{{{0,59}}}}[^\p{{{{L}}}}\p{{{{N}}}}_.?!])?(tallest|longest|largest|biggest|smallest|shortest|oldest|newest|first|last|only|visible|located|situated|invented|discovered|founded|headquartered)($|[^\p{{{{L}}}}\p{{{{N}}}}_])'))""".replace("{{", "{").replace("}}", "}")
FACTUAL_SQL = f"WITH {SENTENCES} SELECT doc_id, n, {FACTUAL.replace('{0}', 's')} AS factual FROM s"


def claim_attribution(spark, sf_dir):
    return sentences(spark, sf_dir).withColumn("a", S.attribution(F.col("s"))).select("doc_id", "n", "a.speaker", "a.verb", T.digest(F.col("a.statement")).alias("statement"))


ATTRIBUTION_SQL = rf"""
WITH {SENTENCES}, m AS (SELECT doc_id, n, s, regexp_matches(s, {q(S.SPEAKER)}) AS hit, trim(regexp_extract(s, {q(S.SPEAKER)}, 1)) AS speaker, trim(regexp_extract(s, {q(S.SPEAKER)}, 2)) AS verb, trim(regexp_extract(s, {q(S.SPEAKER)}, 3)) AS statement FROM s),
 k AS (SELECT *, hit AND len(string_split_regex(speaker, '\s+')) <= 5 AS ok FROM m)
SELECT doc_id, n, CASE WHEN ok THEN speaker END AS speaker, CASE WHEN ok THEN verb END AS verb, sha256(CASE WHEN ok THEN statement ELSE s END) AS statement FROM k
"""


def claim_entities(spark, sf_dir):
    e = planted(spark, sf_dir).withColumn("e", S.entities(F.col("t")))
    return e.select("doc_id", F.size("e").cast("long").alias("n"), *[F.array_join(S.entity_texts(F.col("e"), *k), "|").alias(name) for name, k in (("dates", ["DATE"]), ("numbers", ["MONEY", "PERCENT"]), ("locations", ["GPE"]))])


def entities_sql(source, key):
    """CTE ``source``_e: ``source`` (key, t) with a, its entities in order, and the lists dates, numbers and locations."""
    distinct = lambda labels: f"list_filter(list_transform(list_filter(a, lambda x: x.label IN ({labels})), lambda x: x.text), lambda x, i: list_position(list_transform(list_filter(a, lambda y: y.label IN ({labels})), lambda y: y.text), x) = i)"
    found = ", ".join(f"list_transform(regexp_extract_all(t, {q(p)}), lambda x: {{'label': '{k}', 'text': trim(x)}}) AS l{j}" for j, (k, p) in enumerate(S.ENTITIES))
    joined = "l0"
    for j in range(1, len(S.ENTITIES)):
        joined = f"list_concat({joined}, l{j})"
    return f"""{source}_f AS (SELECT *, {found} FROM {source}), {source}_g AS (SELECT *, {joined} AS all_ FROM {source}_f),
 {source}_h AS (SELECT *, list_filter(all_, lambda x, i: x.label = 'GPE' OR len(list_filter(all_[1:i - 1], lambda y: lower(y.text) = lower(x.text))) = 0) AS a FROM {source}_g),
 {source}_e AS (SELECT * EXCLUDE (all_, {', '.join(f'l{j}' for j in range(len(S.ENTITIES)))}), {distinct("'DATE'")} AS dates, {distinct("'MONEY', 'PERCENT'")} AS numbers, {distinct("'GPE'")} AS locations FROM {source}_h)"""


ENTITIES_SQL = f"""
WITH p AS ({PLANTED}), {entities_sql('p', 'doc_id')}
SELECT doc_id, len(a)::BIGINT AS n, {', '.join(f"array_to_string({c}, '|') AS {c}" for c in ('dates', 'numbers', 'locations'))} FROM p_e
"""


def quantities(spark, sf_dir):
    rows = planted(spark, sf_dir).select("doc_id", F.inline(N.quantities(F.col("t"))))
    return rows.select("doc_id", F.col("start").cast("long").alias("start"), "value", "unit", "phrase")


def located_sql(name, pattern, k):
    unit = f"lower(regexp_extract(v, {q(pattern)}, 2))" if k == 0 else "'currency'"
    return rf"""list_transform(range(1, len(v{k}) + 1), lambda i: {{'start': list_sum(list_transform(g{k}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(v{k}[1:i - 1], lambda v: length(v))), 0),
      'stop': list_sum(list_transform(g{k}[1:i], lambda g: length(g))) + list_sum(list_transform(v{k}[1:i], lambda v: length(v))), 'value': replace(regexp_extract(v{k}[i], {q(pattern)}, 1), ',', '')::DOUBLE, 'unit': {unit.replace('(v,', f'(v{k}[i],')}, 'phrase': trim(v{k}[i])}}) AS {name}"""


def quantities_sql(source, key):
    """CTEs: ``source`` (key, t) to qs (key, a: the list of quantities)."""
    lists = ", ".join(f"regexp_extract_all(t, {q(p)}) AS v{k}, string_split_regex(t, {q(p)}) AS g{k}" for k, p in enumerate(N.QUANTITIES))
    free = "len(list_filter({0}, lambda y: x.start >= y.start AND x.stop <= y.stop)) = 0"
    return f"""{source}_v AS (SELECT {key}, {lists} FROM {source}), {source}_l AS (SELECT {key}, {', '.join(located_sql(f'l{k}', p, k) for k, p in enumerate(N.QUANTITIES))} FROM {source}_v),
 {source}_2 AS (SELECT {key}, l2, list_concat(l0, list_filter(l1, lambda x: {free.format('l0')})) AS a FROM {source}_l), {source}_q AS (SELECT {key}, list_concat(a, list_filter(l2, lambda x: {free.format('a')})) AS a FROM {source}_2)"""


QUANTITIES_SQL = f"WITH p AS ({PLANTED}), {quantities_sql('p', 'doc_id')}, u AS (SELECT doc_id, unnest(a) AS x FROM p_q) SELECT doc_id, x.start::BIGINT AS start, x.value, x.unit, x.phrase FROM u"

#: Claims that the documents are held against, by doc_id.
CLAIMS = ["The state will pay ₹500 crore for 300 workers", "Rates go up by 25 bps and 20 percent", "Rs 10 are enough, not $4", "Nothing is counted here"]
CLAIMED = f"SELECT doc_id, t, CASE doc_id % {len(CLAIMS)} {' '.join(f'WHEN {k} THEN {q(c)}' for k, c in enumerate(CLAIMS))} END AS claim FROM ({PLANTED})"


def numeric_discrepancy(spark, sf_dir):
    rows = spark.sql(CLAIMED.replace("FROM documents", f"FROM parquet.`{sf_dir}/documents.parquet`"))
    found = rows.withColumn("d", N.numeric_conflicts(N.quantities(F.col("claim")), N.quantities(F.col("t")))).where(F.size("d") > 0).select("doc_id", "t", F.posexplode("d").alias("n", "d"))
    return found.select("doc_id", F.col("n").cast("long").alias("n"), F.concat(F.lit("amount_"), "d.unit").alias("aspect"), "d.claim_value", "d.evidence_value",
                        T.digest(N.snippet(F.col("t"), F.col("d.evidence_value"), 70)).alias("snippet"))


def name_sql(unit):
    return f"CASE {unit} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in N.UNITS.items()) + f" ELSE {unit} END"


NUMERIC_SQL = rf"""
WITH r AS ({CLAIMED}), c AS (SELECT doc_id, claim AS t FROM r), e AS (SELECT doc_id, t FROM r), {quantities_sql('c', 'doc_id')}, {quantities_sql('e', 'doc_id')},
 j AS (SELECT doc_id, e.t, unnest(c_q.a) AS x, unnest(range(len(c_q.a))) AS pos, e_q.a AS found FROM c_q JOIN e_q USING (doc_id) JOIN e USING (doc_id)),
 k AS (SELECT *, {name_sql('x.unit')} AS unit FROM j), n AS (SELECT *, list_filter(found, lambda y: ({name_sql('y.unit')}) = unit OR unit = 'currency') AS near FROM k),
 h AS (SELECT *, near[1].phrase AS ev FROM n WHERE len(near) > 0 AND len(list_filter(near, lambda y: abs(y.value - x.value) < 1e-4)) = 0),
 w AS (SELECT *, strpos(lower(t), lower(ev)) - 1 AS at0, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS n FROM h),
 z AS (SELECT *, greatest(at0 - 70, 0) AS a, least(at0 + length(ev) + 70, length(t)) AS b FROM w)
SELECT doc_id, n, 'amount_' || unit AS aspect, x.phrase AS claim_value, ev AS evidence_value, sha256(CASE WHEN a > 0 THEN '...' ELSE '' END || trim(substr(t, a + 1, b - a)) || CASE WHEN b < length(t) THEN '...' ELSE '' END) AS snippet FROM z
"""
TERMS = ["Minister", "officials", "RBI"]


def polarity(spark, sf_dir):
    d = S.denial(F.col("t"), F.array(*[F.lit(t) for t in TERMS]))
    return planted(spark, sf_dir).withColumn("d", d).where("d is not null").select("doc_id", "d.word", T.digest(F.col("d.sentence")).alias("sentence"))


POLARITY_SQL = rf"""
WITH p AS ({PLANTED}), s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)),
   lambda x: x <> '' AND ({' OR '.join(f"contains(lower(x), '{t.lower()}')" for t in TERMS)})) AS ss FROM p),
 d AS (SELECT doc_id, ss, unnest([{', '.join(q('(?i)' + d) for d in S.DENIALS)}]) AS pat, unnest(range({len(S.DENIALS)})) AS k FROM s),
 h AS (SELECT doc_id, k, regexp_extract(x, pat) AS word, x FROM (SELECT *, list_filter(ss, lambda y: regexp_matches(y, pat))[1] AS x FROM d) WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1)
SELECT doc_id, word, sha256(left(x, 300)) AS sentence FROM h
"""

DOMAINS = ["www.Reuters.com", "news.bbc.com", "a.b.sebi.gov.in", "x.pib.gov.in", "y.gov.uk", "timesofindia.indiatimes.com", "m.timesofindia.indiatimes.com", "health.who.int", "data.europa.eu", "ox.ac.uk", "mit.edu", "example.com", "", "in"]


def registry_lookup(spark, sf_dir):
    from claimloom.functions import urls as U

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(U.domain(F.col("url")).alias("domain")).distinct()
    given = spark.createDataFrame([(x,) for x in DOMAINS], "domain string").unionByName(pages)
    e = S.Registry().find(F.col("domain"))
    return given.select("domain", e["name"].alias("name"), F.coalesce(e["category"], U.category(F.col("domain"))).alias("category"), e["reputation"].cast("long").alias("reputation"), S.is_official(F.col("domain")).alias("official"))


def registry_sql(domains, category):
    """``domains`` (domain) with the registry's entry; ``category``: SQL from (domain, category)."""
    return rf"""
WITH reg AS (SELECT * FROM (VALUES {', '.join(f"({q(d)}, {q(n)}, '{c}', {r})" for d, n, c, r in S.REGISTRY)}) AS v(d, name, category, reputation)), g AS ({domains}),
 k AS (SELECT domain, regexp_replace(lower(trim(domain)), '^www\.', '') AS key FROM g), l AS (SELECT *, string_split(key, '.') AS p FROM k),
 t AS (SELECT *, array_to_string(p[-2:], '.') AS two, array_to_string(p[-3:], '.') AS three FROM l)
SELECT t.domain, coalesce(a.name, b.name, c.name) AS name, coalesce(a.category, b.category, c.category, s.category) AS category, coalesce(a.reputation, b.reputation, c.reputation)::BIGINT AS reputation,
  {' OR '.join(f"regexp_matches(lower(t.domain), {q(p)})" for p in S.OFFICIAL)} AS official
FROM t LEFT JOIN reg a ON a.d = t.key LEFT JOIN reg b ON b.d = t.two AND len(p) > 2 LEFT JOIN reg c ON c.d = t.three AND len(p) > 3 JOIN ({category}) s ON s.domain = t.domain
"""


def submissions(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 5 == 4, "url").when(F.col("doc_id") % 25 == 3, "file").otherwise("text")
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", kind.alias("kind"))
    clean = T.normalize(F.coalesce("text", F.lit("")))
    out = rows.withColumn("s", S.submitted(F.col("kind"), F.col("text")))
    ok = F.col("s.method") == "direct_text"
    return out.select("doc_id", "s.status", "s.method", F.when(ok, F.length(clean)).cast("long").alias("chars"),
                      F.when(ok, F.size(F.filter(F.split(clean, r"\s+"), lambda w: w != ""))).cast("long").alias("words"))


SUBMISSIONS_SQL = r"""
WITH k AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 5 = 4 THEN 'url' WHEN doc_id % 25 = 3 THEN 'file' ELSE 'text' END AS kind FROM documents),
 n AS (SELECT *, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) AS n FROM k),
 s AS (SELECT *, CASE WHEN kind = 'file' THEN 'UNSUPPORTED' WHEN kind = 'text' AND n < 20 THEN 'TOO_SHORT' WHEN kind = 'text' AND n > 10000 THEN 'TOO_LONG' WHEN n = 0 THEN 'EMPTY' ELSE 'OK' END AS status FROM n),
 a AS (SELECT doc_id, status, kind, regexp_replace(regexp_replace(regexp_replace(text, '[\x{200B}-\x{200D}\x{FEFF}\x{200E}\x{200F}\x{202A}-\x{202E}\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g'), '[ \t\x{00A0}]+', ' ', 'g') AS t FROM s),
 b AS (SELECT doc_id, status, kind, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x)), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS t FROM a)
SELECT doc_id, status, CASE WHEN status = 'OK' THEN CASE kind WHEN 'text' THEN 'direct_text' ELSE 'url' END END AS method, CASE WHEN status = 'OK' AND kind = 'text' THEN length(t)::BIGINT END AS chars,
  CASE WHEN status = 'OK' AND kind = 'text' THEN len(list_filter(string_split_regex(t, '\s+'), lambda w: w <> ''))::BIGINT END AS words FROM b
"""

QUERIES = {
    "source_signals": source_signals, "claim_normalize": claim_normalize, "factual_signals": factual_signals, "claim_attribution": claim_attribution, "claim_entities": claim_entities,
    "quantities": quantities, "numeric_discrepancy": numeric_discrepancy, "polarity": polarity, "registry_lookup": registry_lookup, "submissions": submissions,
}
ORACLES = {
    "source_signals": SOURCE_SIGNALS_SQL, "claim_normalize": CLAIM_NORMALIZE_SQL, "factual_signals": FACTUAL_SQL, "claim_attribution": ATTRIBUTION_SQL, "claim_entities": ENTITIES_SQL,
    "quantities": QUANTITIES_SQL, "numeric_discrepancy": NUMERIC_SQL, "polarity": POLARITY_SQL, "submissions": SUBMISSIONS_SQL,
}
