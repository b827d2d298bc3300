"""Near pairs by packed shingles: all pairs, and what is moved for them."""

import random

from siltstone.operators import evals


def test_pairs_by_definition_in_small_pieces(spark, monkeypatch):
    monkeypatch.setattr(evals, "AT_ONCE", 50)
    monkeypatch.setattr(evals, "COMMON", 2)
    r = random.Random(8)
    whole = [r.getrandbits(64) - (1 << 63) for _ in range(25)]
    rows = [(i * 1_000_003 - 50_000_000, r.randrange(9), r.sample(whole, r.randrange(26))) for i in range(120)] + [(7, 1, None), (8, 2, [])]
    df = spark.createDataFrame(rows, "id long, day int, h array<bigint>")
    for days in (None, 2):
        want = {(min(a, b), max(a, b)) for i, (a, d, x) in enumerate(rows) for b, e, y in rows[:i] if x and y and (days is None or abs(d - e) <= days) and len(set(x) & set(y)) / len(set(x) | set(y)) > 0.6}
        assert {(p.a, p.b) for p in evals.near_pairs(df, days=days).collect()} == want and want


def test_sets_are_not_stored(spark, monkeypatch):
    seen, store = [], evals.stored
    monkeypatch.setattr(evals, "stored", lambda df: seen.append(df.columns) or store(df))
    df = spark.createDataFrame([(i, 0, [i, 1, 2, 3, 4]) for i in range(5, 40)], "id long, day int, h array<bigint>")
    assert evals.near_pairs(df, days=None).count() == 35 * 34 // 2
    assert seen and not any("h" in columns for columns in seen)


def test_distinct_texts_with_repeated_keys(spark):
    rows = [(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "b"), (4, None), (5, None), (6, "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, evals.distinct_texts(df).where("text is not null").collect())) == [(1, "a"), (1, "b"), (6, "c")]
