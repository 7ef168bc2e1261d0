from claimloom.llm.common import without


def test_without_is_the_same_by_broadcast_and_by_shuffle(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c"), (3, None)], "doc_id long, text string")
    gone = spark.createDataFrame([(2,), (2,), (None,), (9,)], "doc_id long")
    for most in (1 << 20, 1):
        got = without(docs, gone, "doc_id", most)
        assert got.columns == docs.columns
        assert sorted(got.collect(), key=str) == sorted([(1, "a"), (None, "c"), (3, None)], key=str)
