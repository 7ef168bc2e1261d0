from claimloom.operators import evidence as E

WANT = {
    "Rated false by our team": ("False", "CONTRADICTING"), "This is a hoax": ("False", "CONTRADICTING"), "Mostly true, with caveats": ("Mostly True", "SUPPORTING"),
    "It distorts": ("Misleading", "CONTRADICTING"), "Mostly false claim": ("Mostly False", "CONTRADICTING"), "false,\npartially": ("Partly False", "NEUTRAL"),
    "Half is correct": ("Partly True", "NEUTRAL"), "Confirmed by us": ("True", "SUPPORTING"), "Lacks context": ("Needs Context", "NEUTRAL"), "half true": ("Half True", "NEUTRAL"),
}


def test_words_in_ratings_that_the_table_lacks(spark):
    got = E.rate(spark.createDataFrame([(k,) for k in WANT], "rating string")).collect()
    assert {r.rating: (r.verdict, r.stance) for r in got} == WANT
