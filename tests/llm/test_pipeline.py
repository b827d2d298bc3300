"""The whole pipeline against plain Python, and its defined cases."""

import random
import re

import corpus_pipeline
import pytest
from siltstone.llm import common, packing

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(10**6)}" for _ in range(n))


def grams(text, k=5):
    w = text.split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def slow_pipeline(rows, items):
    """(doc_id, text) of what is packed. rows: unlike ids; lines of the tables here are lower case with single spaces."""
    # 1: too few words, and lines of over 20 documents and over 1 % of a host's, but for the first
    by_line = {}
    for i, t, _, s, _ in rows:
        for x in {x for x in (t or "").split("\n") if x.strip()}:
            by_line.setdefault((x, s), set()).add(i)
    in_host = {s: len({r[0] for r in rows if r[3] == s}) for s in {r[3] for r in rows}}
    kept = []
    for i, t, _, s, _ in rows:
        if len((t or "").split()) < 20:
            continue
        gone = {x for x in set(t.split("\n")) if x.strip() and len(by_line[x, s]) > max(20, -(-in_host[s] // 100)) and i != min(by_line[x, s])}
        lines = {x for x in t.split("\n") if x.strip()}
        if 1 - sum(map(len, gone)) / sum(map(len, lines)) >= 0.3:
            kept.append((i, "\n".join(x for x in t.split("\n") if x not in gone), s))
    # 8: lines on 10 sites or more, but for the first document
    sites, first = {}, {}
    for i, t, s in kept:
        for x in {x for x in t.split("\n") if x.strip()}:
            sites.setdefault(x, set()).add(s)
            first[x] = min(first.get(x, i), i)
    kept = [(i, "\n".join(x for x in t.split("\n") if not x.strip() or len(sites[x]) < 10 or first[x] == i)) for i, t, s in kept]
    # 3: one of each component at Jaccard 0.8
    sets, root = {i: grams(t) for i, t in kept}, {i: i for i, _ in kept}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    kept = [(i, t) for i, t in kept if root[i] == i]
    # 7: those that hold 0.8 of an item
    plain = [grams(" ".join(re.findall(r"\w+", x.lower()))) for _, x in items]
    return {i: t for i, t in kept if not any(len(grams(t) & q) >= 0.8 * len(q) for q in plain)}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rows = []
    for i in range(120):
        text = words(60, i)
        if i % 10 == 1:  # near copy of the one before
            w = words(60, i - 1).split()
            w[7] = "changed"
            text = " ".join(w)
        if i % 15 == 4:
            text = words(9, i)
        if i % 20 == 6:
            text += "\n" + words(30, 10**6 + i % 3)  # an item of the benchmark
        text += "\nthe line of one host" if i < 90 and i % 3 == 0 else ""
        text += "\nboilerplate of all sites" if i % 4 == 2 else ""
        rows.append((i, text, "en", "host" if i % 3 == 0 else f"s{i % 40}", len(text)))
    items = [(j, words(30, 10**6 + j)) for j in range(3)]
    d = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, DOCS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, rows, items


def test_pipeline_by_brute_force(spark, corpus):
    d, rows, items = corpus
    want = slow_pipeline(rows, items)
    got = corpus_pipeline.run(spark, d).toPandas()
    assert set(got.doc_id) == set(want) and 60 < len(want) < 110
    encode = packing.Encoder()
    assert {i: int(n) for i, n in got.groupby("doc_id").length.sum().items()} == {i: len(encode(t)) + 1 for i, t in want.items()}
    assert got.groupby("sequence_id").length.sum().max() <= packing.WINDOW


def test_stages_hand_on_whole_columns_and_leave_no_tables(spark, corpus):
    d, _, _ = corpus
    common.drop_all()
    docs = spark.read.parquet(f"{d}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, d).columns == docs.columns
    common.drop_all()
    corpus_pipeline.run(spark, d).count()
    assert sum(map(len, common._made)) == 1  # the result
    common.drop_all()


def test_pipeline_of_odd_and_of_no_rows(spark, corpus, tmp_path):
    d, rows, _ = corpus
    long = words(20_000, 5)
    odd = [(1, None, None, None, None), (None, words(40, 1), "en", None, 3), (None, words(40, 2), None, "a", 3), (3, long, "en", "a", 1), (3, long, "en", "a", 1), (4, "", "en", "a", 0), (5, words(25, 9), "en", "a", 7)]
    for name, table, n in (("odd", odd, 4), ("none", [], 0)):
        own = f"{tmp_path}/{name}"
        spark.createDataFrame(table, DOCS).write.parquet(f"{own}/documents.parquet")
        spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"{own}/benchmark.parquet")
        got = corpus_pipeline.run(spark, own).toPandas()
        assert len(got.groupby(["doc_id", "doc_tokens"], dropna=False)) == n if n else len(got) == 0
