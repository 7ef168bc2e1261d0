from claimloom.operators import verification as V


def test_packet_takes_at_most_five_fact_checks(spark):
    rows = [(1, k, "t", k < 12, k == 12, False, "NEUTRAL") for k in range(20)] + [(2, k, "t", True, False, False, "NEUTRAL") for k in range(3)]
    items = spark.createDataFrame(rows, "claim_id long, ord long, text string, fact_check boolean, `primary` boolean, discrepant boolean, stance string")
    got = sorted((r.claim_id, r.ord, r.rank) for r in V.packet(items).collect())
    assert got == [(1, o, n + 1) for n, o in enumerate([0, 1, 2, 3, 4, 12, 13, 14, 15, 16])] + [(2, k, k + 1) for k in range(3)]
