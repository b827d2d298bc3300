"""Counts of an index without its postings."""

from siltstone.operators import retrieval


def test_counts_with_repeated_keys(spark):
    rows = [(1, "a b a"), (1, "a c"), (2, None), (3, ""), (None, "b b"), (None, "B d"), (4, "a")]
    got = retrieval.index_stats(spark.createDataFrame(rows, "doc_id long, text string")).first()
    want = {(i, w) for i, t in rows for w in (t or "").lower().split()}
    assert (got.postings, got.tokens, got.terms, got.n, got.avgdl) == (len(want), 10, 4, 7, round(10 / 7, 6))
    none = retrieval.index_stats(spark.createDataFrame([], "doc_id long, text string")).first()
    assert (none.postings, none.tokens, none.terms, none.n, none.avgdl) == (0, None, 0, 0, None)


def test_postings_are_not_shuffled(spark):
    df = retrieval.index_stats(spark.createDataFrame([(i, f"w{i} w") for i in range(50)], "doc_id long, text string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" in plan and "hashpartitioning(doc_id" not in plan
