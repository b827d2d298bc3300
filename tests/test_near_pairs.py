"""near_pairs without a window of days."""

from siltstone.operators import evals


def test_window_is_optional(spark):
    items = spark.createDataFrame([(1, 0, [1, 2, 3, 4, 5]), (16, 15, [1, 2, 3, 4, 5, 6]), (18, 17, [1, 2, 3, 4, 5])], "id long, day int, h array<bigint>")
    pairs = lambda days: {(r.a, r.b) for r in evals.near_pairs(items, days=days).collect()}
    assert pairs(7) == {(16, 18)} and pairs(None) == {(1, 16), (1, 18), (16, 18)}
