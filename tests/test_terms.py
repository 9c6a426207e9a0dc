"""Terms counted within a row against terms counted by a shuffle."""

from kwforge.operators import keywords

ROWS = [(1, "b a b"), (2, "A a, a! c"), (3, ""), (4, None), (5, "c"), (6, "zz b zz b a"), (7, "...")]


def test_counts_without_a_shuffle(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    terms = keywords.term_counts(df, "doc_id", "text")
    assert "Exchange" not in terms._jdf.queryExecution().executedPlan().toString()
    assert {tuple(r) for r in terms.collect()} == {(1, "a", 1), (1, "b", 2), (2, "a", 3), (2, "c", 1), (5, "c", 1), (6, "a", 1), (6, "b", 2), (6, "zz", 2)}


def test_same_weights(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    one, two = ({(r.id, r.kw): round(r.weight, 9) for r in keywords.tf_idf(df, "doc_id", "text", unique_ids=u).collect()} for u in (True, False))
    assert one == two and {k for _, k in one} == {"a", "b", "c"}
