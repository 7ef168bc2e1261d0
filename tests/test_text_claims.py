"""Claims, their duplicates and stances from texts: cases and brute force."""

import re

import pytest
from pyspark.sql import functions as F

from claimloom import catalog_text
from claimloom.functions import lexicon as W
from claimloom.operators import aspects as A
from claimloom.operators import claims as K
from claimloom.operators import extraction as X
from claimloom.operators import report as R
from claimloom.operators import signals as S


@pytest.mark.parametrize(("sentence", "candidate"), [
    ("Vaccines cause autism.", True), ("The red house.", False), ("Could this be true? asked the minister on Monday", False), ("Why did prices rise?", False), ("Hello, the law was passed today.", False),
    ("In my opinion taxes are too high.", False), ("Click here to subscribe to the daily news of the city.", False), ("The tower is tall.", True), ("Rain fell.", False), ("Prices rose sharply.", True),
])
def test_candidates(spark, sentence, candidate):
    assert spark.range(1).select(K.is_candidate(F.lit(sentence))).first()[0] is candidate


@pytest.mark.parametrize(("sentence", "factual"), [
    ("the army evacuated two towns", True), ("the banning of bags", True), ("cattle fell ill", True), ("the flooding went on", True), ("he is happy", False), ("It was a dark day", False),
    ("the wall is visible from space", True), ("delays due to rain", True), ("a quiet evening", False), ("the banned", True), ("abandoned houses", False),
])
def test_factual(spark, sentence, factual):
    assert spark.range(1).select(S.is_factual(F.lit(sentence))).first()[0] is factual


def test_inflections():
    assert W.inflections("ban") == ["ban", "bans", "banned", "banning"] and W.inflections("occur")[2:] == ["occurred", "occurring"]
    assert W.inflections("crash") == ["crash", "crashes", "crashed", "crashing"] and W.inflections("open")[2:] == ["opened", "opening"] and "fallen" in W.inflections("fall")
    assert W.inflections("raise") == ["raise", "raises", "raised", "raising"] and W.inflections("treat")[2] == "treated"


@pytest.mark.parametrize(("statement", "clauses"), [
    ("The cabinet approved the bill on Monday and the law will ban plastic bags", ["The cabinet approved the bill on Monday.", "the law will ban plastic bags."]),
    ("Bread and butter are sold in 10 shops", ["Bread and butter are sold in 10 shops"]),
    ("Prices rose 5 percent AND the banks have cut rates and jobs are lost in June!", ["Prices rose 5 percent.", "the banks have cut rates.", "jobs are lost in June!"]),
    ("Prices rose 5 percent and it is so", ["Prices rose 5 percent and it is so"]),
    ("The mill closed in 2020 and the two towns were flooded and the road is 9 km long", ["The mill closed in 2020.", "the two towns were flooded.", "the road is 9 km long."]),
])
def test_clauses(spark, statement, clauses):
    got = spark.range(1).select(X.clauses(F.lit(statement))).first()[0]
    if len(clauses) == 1:
        assert got == [statement]
    else:
        assert got == clauses


def test_verbs_of_clauses_end_at_ascii_edges(spark):
    parts = ["The cabinet approved the budget of 5 crore", "the mayor wasö in 7 of the towns"]
    assert spark.range(1).select(X.clauses(F.lit(" and ".join(parts)))).first()[0] == [p + "." for p in parts]


TEXTS = [
    (1, "State bans plastic bags in Kerala", "The cabinet approved a ban on plastic bags in Kerala on Monday and the law will start on 5 June 2025. Is it true? Ravi Kumar said that 300 shops were closed on Monday: it is done. Nice day. "
     "Ravi Kumar announced that 300 shops were closed on Monday. The cabinet approved a ban on plastic bags in Kerala on Monday!"),
    (2, None, "Line 42 is broken again. " * 40 + "The minister said that inflation fell to 6.5% in the town. Officials reported that inflation fell to 6.5% in that town. a1 b2 c3 d4. a1 b2 c3 d4."),
    (3, "A headline without anything in it", None), (None, None, "The bank cut rates by 25 bps on Friday. On Friday, the bank cut rates by 25 bps."), (4, "", ""),
]


def words(text):
    return set(re.findall(r"\w{3,}", text.lower()))


def likeness(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def grouped(claims):
    primaries, of, same = [], {}, {}
    for c in claims:
        for p in primaries:
            own = likeness(words(c.normalized), words(p.normalized))
            numbers, dates = set(c.numbers) & set(p.numbers), set(c.dates) & set(p.dates)
            source = likeness(words(c.source_sentence), words(p.source_sentence))
            if own < 0.75 and source >= 0.5 and (numbers or dates):
                own = source
            if own >= 0.75 or (own >= 0.5 and numbers and dates):
                of[c.claim_index] = p.claim_id
                if c.text not in same.setdefault(p.claim_index, []):
                    same[p.claim_index].append(c.text)
                break
        else:
            primaries.append(c)
    return {c.claim_index: (of.get(c.claim_index), same.get(c.claim_index, [])) for c in claims}


def test_claims_and_their_duplicates(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, title string, text string").withColumn("claim", F.lit(1)).withColumn("w", F.lit(2))
    claims = X.extract_claims(docs, "doc_id").cache()
    rows = claims.orderBy("doc_id", "claim_index").collect()
    one = [r for r in rows if r.doc_id == 1]
    assert [r.claim_index for r in one] == list(range(1, len(one) + 1)) and one[0].sentence is None and one[0].importance == "HIGH"
    assert [r.text for r in one[1:3]] == ["The cabinet approved a ban on plastic bags in Kerala on Monday.", "the law will start on 5 June 2025."]
    assert (one[3].speaker, one[3].claim_type, one[3].text) == ("Ravi Kumar", "QUOTE", "300 shops were closed on Monday: it is done.")
    assert one[1].claim_id.startswith("claim_") and one[1].claim_id.endswith("_2") and one[2].dates == ["5 June 2025"]
    got = X.group_claims(claims, "doc_id").collect()
    for key in (1, 2, None):
        of = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.claim_index)
        if key is not None:
            assert {r.claim_index: (r.duplicate_of, r.equivalents) for r in got if r.doc_id == key} == grouped(of)
    assert {r.claim_index for r in got if r.doc_id == 2 and r.duplicate_of} >= set(range(2, 41))
    assert X.extract_claims(docs.limit(0), "doc_id").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_against_a_loop(spark, seed):
    import random

    r = random.Random(seed)
    some = lambda k: [r.choice(["alpha", "beta", "gamma", "delta", "of", "house", "river", "42", "stone"]) for _ in range(k)]
    rows = []
    for doc in range(6):
        for k in range(1, 30):
            text = " ".join(some(r.randrange(1, 7)))
            rows.append((doc, k, f"c{k}", text, text + ".", " ".join(some(r.randrange(0, 6))), r.sample(["5%", "7%"], r.randrange(3)), r.sample(["Monday", "Friday"], r.randrange(3))))
    claims = spark.createDataFrame(rows, "doc_id long, claim_index int, claim_id string, text string, normalized string, source_sentence string, numbers array<string>, dates array<string>")
    got = X.group_claims(claims, "doc_id").collect()
    for doc in range(6):
        want = grouped(sorted((c for c in claims.collect() if c.doc_id == doc), key=lambda c: c.claim_index))
        assert {c.claim_index: (c.duplicate_of, c.equivalents) for c in got if c.doc_id == doc} == want


CLAIM = "The state government banned plastic bags in Kerala on Monday."
EVIDENCE = [
    ("The government of Kerala has outlawed plastic bags in the state from Monday, officials said.", "SUPPORTING", 0.93, ["WHERE=SUPPORTED", "WHEN=SUPPORTED", "ACTION=SUPPORTED"]),
    ("Officials in Kerala denied that plastic bags were banned on Monday by the state.", "CONTRADICTING", 0.9, ["WHERE=SUPPORTED", "WHEN=SUPPORTED", "ACTION=CONTRADICTED"]),
    ("Plastic bags in Kerala: the state government talks about plastic bags in Kerala.", "NEUTRAL", 0.8, ["WHERE=SUPPORTED", "WHEN=UNMENTIONED", "ACTION=UNMENTIONED"]),
    ("The minister denied a rise of taxes. Plastic bags were banned in Kerala on Monday by the state government.", "SUPPORTING", 0.93, ["WHERE=SUPPORTED", "WHEN=SUPPORTED", "ACTION=SUPPORTED"]),
    ("Short text on bags.", "INSUFFICIENT", 0.7, ["WHERE=UNMENTIONED", "WHEN=UNMENTIONED", "ACTION=UNMENTIONED"]), (None, "INSUFFICIENT", 0.7, ["WHERE=UNMENTIONED", "WHEN=UNMENTIONED", "ACTION=UNMENTIONED"]),
]


def pairs(spark, claim, texts):
    made = X.extract_claims(spark.createDataFrame([(1, None, claim)], "doc_id long, title string, text string"), "doc_id")
    none = F.array().cast("array<string>")
    claims = made.select("claim_id", F.col("normalized").alias("claim"), "speaker", "entities", "dates", "numbers", "locations", none.alias("persons"), none.alias("organizations"))
    return claims.crossJoin(spark.createDataFrame(list(enumerate(texts)), "doc_id long, evidence string"))


def test_stance_from_texts(spark):
    got = A.judge(pairs(spark, CLAIM, [e[0] for e in EVIDENCE])).orderBy("doc_id").collect()
    assert [(r.stance, r.confidence, [f"{a.kind}={a.status}" for a in r.aspects]) for r in got] == [e[1:] for e in EVIDENCE]


def test_figures_and_months_conflict(spark):
    claim = "The firm announced a rise of 5 percent for Gujarat in a plan of 5 March 2024."
    got = A.judge(pairs(spark, claim, ["The firm announced a rise of 7 percent for Gujarat in its plan for April.", "The firm announced a rise of 5 percent for Gujarat, not 7 percent, on 5 March 2024."])).orderBy("doc_id").collect()
    assert [(r.stance, r.confidence, len(r.conflicts), r.late_month) for r in got] == [("CONTRADICTING", 0.88, 1, "april"), ("SUPPORTING", 0.95, 0, None)]
    amount = [a for a in got[0].aspects if a.kind == "AMOUNT"][0]
    assert (amount.status, amount.evidence_value) == ("CONTRADICTED", "7 percent")


def test_best_quotes_take_the_first_of_equal_sentences(spark):
    claims = spark.createDataFrame([("c1", "plastic bags banned Kerala"), ("c2", "river stone")], "claim_id string, claim string")
    docs = spark.createDataFrame([(1, "Plastic is old. Kerala has plastic bags. Bags, plastic, Kerala! Nothing else."), (2, "Stone only."), (3, None), (4, "bags plastic")], "doc_id long, text string")
    asked = spark.createDataFrame([("c1", 1), ("c1", 1), ("c1", 2), ("c2", 2), ("c1", 3), ("c1", 4), ("c9", 1)], "claim_id string, doc_id long")
    got = A.best_quotes(claims, docs, asked).collect()
    assert sorted((r.claim_id, r.doc_id, r.overlap, r.quote) for r in got) == [("c1", 1, 3, "Kerala has plastic bags."), ("c1", 4, 2, "bags plastic")]


ITEMS = "claim_id long, cluster string, evidence_id string, stance string, category string, domain string, primary boolean, meta_score double, n_chars long, published_at string, fact_checker string"


def test_consensus_of_units_with_ids_of_text(spark):
    item = lambda c, k, i, s, score=0.5: (c, k, i, s, "NEWS_MEDIA", "x.org", False, score, 100, None, None)
    rows = [item(1, "a", "e1", None, 0.9), item(1, "a", "e2", "SUPPORTING"), item(1, "a", "e3", "SUPPORTING"), item(1, "a", "e4", "CONTRADICTING"), item(1, None, "e5", "CONTRADICTING"), item(1, None, "e6", "CONTRADICTING"),
            item(2, "b", "e7", "NEUTRAL", 0.9), item(2, "b", "e8", "SUPPORTING"), item(3, "c", "e9", None)]
    frame = spark.createDataFrame(rows, ITEMS)
    got = {r.claim_id: (r.independent_supporting, r.independent_contradicting, r.agreement_ratio, r.items) for r in R.cluster_consensus(frame).collect()}
    assert got == {1: (1, 2, 0.333, 5), 2: (0, 0, 0.0, 2), 3: (0, 0, 0.0, 0)}
    assert {(r.claim_id, r.cluster): r.representative for r in R.representatives(frame.where("cluster is not null")).collect()} == {(1, "a"): "e1", (2, "b"): "e7", (3, "c"): "e9"}


def test_claim_groups_query_keeps_every_claim(spark):
    sf = "/root/testdata/sf0.001"
    claims, groups = catalog_text.document_claims(spark, sf).collect(), catalog_text.claim_groups(spark, sf).collect()
    assert len(claims) == len(groups)
    by = {}
    for c in claims:
        by.setdefault(c.doc_id, []).append(c)
    want = {(d, k): v[0] for d, cs in by.items() for k, v in grouped(sorted(cs, key=lambda c: c.claim_index)).items()}
    assert {(g.doc_id, g.claim_index): g.duplicate_of for g in groups} == want and any(want.values())
