"""The share of duplicate pairs, against all pairs."""

import random
from itertools import combinations

from siltstone.operators import evals


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_duplicate_share_by_all_pairs(spark):
    r = random.Random(5)
    base = [" ".join(f"w{r.randrange(900)}" for _ in range(30)) for _ in range(12)]
    rows = []
    for i in range(90):
        text = r.choice([*base, "", None])
        if text and r.random() < 0.4:
            w = text.split()
            w[r.choice([0, 29])] = f"x{r.randrange(3)}"
            text = " ".join(w)
        rows.append((i, text, r.randrange(25)))
    df = spark.createDataFrame(rows, "doc_id long, text string, day int")

    def alike(a, b):
        x, y = shingles(a), shingles(b)
        return a == b or bool(x and y) and len(x & y) / len(x | y) > 0.6

    near = [(a, b) for a, b in combinations(rows, 2) if abs(a[2] - b[2]) <= 7]
    want = sum(alike(a[1], b[1]) for a, b in near)
    got = evals.duplicate_share(df).first()
    assert (got.duplicates, got.pairs, got.rate) == (want, len(near), round(want / len(near), 6)) and want > 50
    none = evals.duplicate_share(df.limit(0)).first()
    assert (none.duplicates, none.pairs, none.rate) == (0, 0, 0)
