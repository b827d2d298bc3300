"""Near pairs of large groups: items are sent to cells, not to pairs."""

import random

from siltstone.operators import evals


def jaccard(x, y):
    return len(x & y) / len(x | y) if x | y else 0


def groups(r, n, size):
    """Rows of groups around a set each, with few or many changes, and of odd ones that share common values."""
    rows, boiler = [], list(range(40))
    for g in range(n):
        whole = [r.getrandbits(64) - (1 << 63) for _ in range(r.choice([4, 30, 70]))]
        for _ in range(size):
            kept = [x for x in whole if r.random() > r.choice([0.02, 0.2, 0.3])]
            rows.append(kept + [r.getrandbits(64) - (1 << 63) for _ in range(len(whole) - len(kept))] + r.sample(boiler, r.choice([0, 0, 8, 35])))
    rows += [r.sample(boiler, r.randrange(1, 40)) for _ in range(size)]
    return [(i * 7919 - 100_000, r.randrange(30), sorted(set(h))) for i, h in enumerate(rows)]


def test_all_pairs_of_groups(spark, monkeypatch):
    for name, value in {"HOT": 4, "COMMON": 3, "BLOCK": 16, "DENSE": 3, "COLUMNS": 7, "AT_ONCE": 300}.items():
        monkeypatch.setattr(evals, name, value)
    rows = groups(random.Random(3), 6, 45)
    df = spark.createDataFrame(rows, "id long, day int, h array<bigint>").repartition(5)
    sets = [(i, d, set(h)) for i, d, h in rows]
    for least, days in ((0.6, None), (0.6, 7), (0.3, None)):
        want = {}
        for i, (a, d, x) in enumerate(sets):
            for b, e, y in sets[:i]:
                if (days is None or abs(d - e) <= days) and jaccard(x, y) > least:
                    want[min(a, b), max(a, b)] = jaccard(x, y)
        got = evals.near_pairs(df, least, days).collect()
        assert len(got) == len(want) and {(p.a, p.b): p.jaccard for p in got} == want and len(want) > 500


def test_group_is_not_paired_on_the_way(spark):
    r = random.Random(4)
    whole = [r.getrandbits(63) for _ in range(100)]
    rows = [(i, 0, r.sample(whole, 88) + [r.getrandbits(63) for _ in range(12)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, day int, h array<bigint>")
    assert evals.near_pairs(df, days=None).count() > 40_000
    met = evals.meeting(df, 0.6, None)
    assert met.count() < 300 * 30  # 44,850 pairs
    assert evals.cells(evals.stored(met)).selectExpr("sum(size(cells)) AS n").first().n < 300 * 30


def test_unlike_items_that_share_one_rare_value_do_not_meet(spark):
    rows = [(i, 0, [*range(i * 1000, i * 1000 + 99), -1 - i // 2]) for i in range(200)]
    rows = [(i, d, [x * 0x9E3779B97F4A7C15 % (1 << 63) for x in h]) for i, d, h in rows]
    assert evals.meeting(spark.createDataFrame(rows, "id long, day int, h array<bigint>"), 0.6, None).count() == 0


def test_shingles_by_definition(spark, monkeypatch):
    monkeypatch.setattr(evals, "TEXT_AT_ONCE", 200)
    r = random.Random(6)
    texts = ["", None, " \t\n", "A b", "a  B ", "b a", "x" * 300, "y" * 64 + " " + "y" * 65, "Ä ö ü é e f g", "a b c d e", "a b c d e f a b c d e f"]
    texts += [r.choice([" ", ""]) + r.choice([" ", "\n", " \x0b\r"]).join(r.choice(["ab", "ba", "a", "Ab", "ü", "w" * 70]) for _ in range(r.randrange(40))) for _ in range(120)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    got = {x.id: x.h for x in evals.with_shingles(df, "text", "h").collect()}

    def want(t):
        for c in "\t\n\x0b\x0c\r":
            t = (t or "").replace(c, " ")
        w = [x for x in t.lower().split(" ") if x]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    number = {}
    for i, t in enumerate(texts):
        assert len(got[i]) == len(set(got[i])) == len(want(t))
        for s in want(t):
            number.setdefault(s, set(got[i])).intersection_update(got[i])
    assert all(number.values()) and len({x for h in got.values() for x in h}) == len(number)


def test_least_keys_by_the_fewer_rows(spark):
    for copies in (1, 5):
        rows = [(i * 10 + j, f"t{i}") for i in range(40) for j in range(copies if i % 2 else 1)] + [(3000, "t3"), (None, "t4"), (None, "n")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(map(tuple, evals.distinct_texts(df).collect())) == sorted((i * 10, f"t{i}") for i in range(40))
