"""Places of a phrase that overlap."""

from siltstone.operators import dictionary


def test_places_apart(spark):
    texts = spark.createDataFrame([(1, "x ab ab ab y ab "), (2, "aaaa"), (3, " ab c")], "id long, text string")
    phrases = spark.createDataFrame([(" ab ",), ("aaa",)], "phrase string")
    counts = lambda apart: {(r.id, r.phrase): r.n for r in dictionary.found(texts, phrases, "id", apart=apart).collect()}
    assert counts(True) == {(1, " ab "): 3, (2, "aaa"): 1, (3, " ab "): 1} and all(t.count(p) == counts(True).get((i, p), 0) for i, t in map(tuple, texts.collect()) for p in (" ab ", "aaa"))
    assert counts(False) == {(1, " ab "): 4, (2, "aaa"): 2, (3, " ab "): 1}
