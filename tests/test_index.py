"""The stored index: searches against BM25 by definition, refreshes against rebuilds, versions under crashes and conflicts."""

import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.operators import index as I
from siltstone.operators import memory as M
from siltstone.sources.versions import Conflict, Refused, Versions, ingested

DOCS = "doc long, text string"


def texts(n, seed, vocabulary=300):
    """Words of Zipf's law: the first are in nearly every text."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, " ".join(r.choices(words, weights, k=r.choice([0, 3, 20, 120])))) for i in range(n)]


def by_definition(docs, queries, k):
    bags = {i: Counter((t or "").split()) for i, t in docs}
    n, average = len(bags), sum(sum(b.values()) for b in bags.values()) / len(bags)
    df = Counter(w for b in bags.values() for w in b)
    out = {}
    for q, text in queries:
        scores = {}
        for i, b in bags.items():
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * b[w] * 2.2 / (b[w] + 1.2 * (0.25 + 0.75 * sum(b.values()) / average)) for w in set(text.split()) if w in b)
            if s:
                scores[i] = round(s, 6)
        out[q] = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
    return out


QUERIES = [(1, "w0 w1 w2 w40 w200"), (2, "w0 w0 w1"), (3, "w250 w251 nothing"), (4, "nothing"), (5, ""), (6, " ".join(f"w{i}" for i in range(0, 300, 7)))]


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = [*texts(400, 1), (1000, None), (1001, ""), (1002, "w0 " * 5000 + "w299"), *[(2000 + i, "w5 w40 w200 w6") for i in range(60)]]
    index = I.Index(spark, str(tmp_path_factory.mktemp("index")))
    index.build(spark.createDataFrame(docs, DOCS))
    return index, docs


def ranked(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(x)] for q, x in out.items()}


@pytest.mark.parametrize("whole", [0, I.WHOLE])
@pytest.mark.parametrize("k", [1, 10])
def test_search_by_definition(spark, built, whole, k):
    index, docs = built
    got = ranked(index.search(spark.createDataFrame(QUERIES, "item_id long, text string"), k, whole=whole))
    want = {q: x for q, x in by_definition(docs, QUERIES, k).items() if x}
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(abs(a - b) < 2e-6 for q in want for (_, a), (_, b) in zip(got[q], want[q]))


def test_a_pruned_search_leaves_lists_unread(spark, built, monkeypatch, tmp_path):
    monkeypatch.setattr(I, "PROBED", 8)
    monkeypatch.setattr(I, "GROUP", 1)
    index = I.Index(spark, str(tmp_path))
    index.build(spark.createDataFrame(built[1], DOCS))
    asked = spark.createDataFrame([(1, "w0 w1 w2 w3 w250 w260")], "item_id long, text string")
    read = index.entries_read(asked, k=2).first()
    assert read.whole + read.beside < read.entries / 2, read


def entries(index, facts=False):
    post = index.read("postings").select("term", "part", "grp", F.round("impact", 9), "n", "cf", "entries")
    return sorted(map(repr, post.collect())), sorted(map(tuple, index.read("documents").select("doc", "sha", "len", "part").collect()))


def test_refresh_equals_a_rebuild(spark, built, tmp_path):
    index, docs = built
    own = I.Index(spark, f"{tmp_path}/a")
    facts = index.store.version().facts
    own.build(spark.createDataFrame(docs, DOCS), facts)
    later = [(i, (t or "") + " w7 fresh" if i % 7 == 0 else t) for i, t in docs if i % 11] + [(5000, "new words w1")]
    own.refresh(spark.createDataFrame(later, DOCS))
    again = I.Index(spark, f"{tmp_path}/b")
    again.build(spark.createDataFrame(later, DOCS), facts)
    assert entries(own) == entries(again)
    for whole in (0, I.WHOLE):  # the average has changed since the impacts were made
        got = ranked(own.search(spark.createDataFrame(QUERIES, "item_id long, text string"), 5, whole=whole))
        assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in by_definition(later, QUERIES, 5).items() if x}


def test_unchanged_segments_keep_their_files(spark, built):
    index, docs = built
    before = index.store.version()
    after = index.refresh(spark.createDataFrame(docs, DOCS))
    assert after.number == before.number
    changed = [(i, "all new" if i == 3 else t) for i, t in docs]
    after = index.refresh(spark.createDataFrame(changed, DOCS))
    moved = [p for p, f in after.parts["postings"].items() if before.parts["postings"].get(p) != f]
    assert len(moved) == 1 and after.number == before.number + 1
    assert index.read("documents", before).count() == index.read("documents", after).count() == len(docs)
    index.refresh(spark.createDataFrame(docs, DOCS))


def test_recall_by_definition(spark, built):
    index, docs = built
    r = random.Random(5)
    priors = [(i, r.choice([0.0, 0.3, 0.9, 1.0, r.random()])) for i, _ in docs if i % 3]
    asked = spark.createDataFrame(QUERIES, "item_id long, text string")
    for first in (3, 20):
        got = {}
        for x in M.recalled(index, spark.createDataFrame(priors, "doc long, prior double"), asked, k=4, first=first).collect():
            got.setdefault(x.item_id, []).append((x.rank, x.doc, x.recall))
        for q, scores in by_definition(docs, QUERIES, 10**6).items():
            known = dict(priors)
            want = sorted(((-round(known[i] * s / (s + 1), 6), i) for i, s in scores if i in known))[:4]
            assert [(i, -s) for s, i in want] == [(i, pytest.approx(s, abs=2e-6)) for _, i, s in sorted(got.get(q, []))] or [s for s, _ in want] == [pytest.approx(-s, abs=2e-6) for _, _, s in sorted(got[q])]


def rows(spark, ids):
    return spark.createDataFrame([(i, f"v{i}", str(i % 3)) for i in ids], "id long, v string, part string")


READ = "id long, v string, part string"


def test_versions(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/t")
    assert store.version().number == 0 and store.read("t", store.version(), READ).count() == 0
    one = store.commit(store.version(), store.stage(t=rows(spark, range(9))), ["t"])
    pinned = store.read("t", one, READ)
    staged = store.stage(t=rows(spark, [100]))  # a writer that dies here has changed nothing
    assert store.version() == one and pinned.count() == 9
    two = store.commit(one, staged, ["t"], ["1"])
    assert sorted(r.id for r in store.read("t", two, READ).collect()) == [0, 2, 3, 5, 6, 8, 100]
    assert two.parts["t"]["0"] == one.parts["t"]["0"] and pinned.count() == 9
    with pytest.raises(Conflict):
        store.commit(one, store.stage(t=rows(spark, [7])), ["t"], ["1"])
    assert store.version() == two and not [x for x in os.listdir(f"{tmp_path}/t/manifests") if x.startswith(".") and not x.endswith(".crc")]
    assert len(store.vacuum(keep=1)) == 1 and store.read("t", store.version(), READ).count() == 7


def test_ingestion_with_a_gate(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/t")
    reason = F.when(F.col("id") % 10 == 0, "round")
    version, folder = ingested(store, "t", rows(spark, range(20)), reason, F.lit("b1"), gate=0.2)
    assert store.read("t", version, READ).count() == 18
    assert [r.reason for r in spark.read.parquet(f"{tmp_path}/t/data/{folder}/quarantine").collect()] == ["round"] * 2
    with pytest.raises(Refused):
        ingested(store, "t", rows(spark, [10, 11]), reason, F.lit("b2"), gate=0.2)
    assert store.version() == version
    version, _ = ingested(store, "t", rows(spark, range(21, 25)), reason, F.lit("b2"))
    assert store.read("t", version, READ).count() == 22


def test_forgotten_rows_leave_the_next_version(spark, tmp_path):
    store = Versions(spark, f"{tmp_path}/t")
    one = store.commit(store.version(), store.stage(t=rows(spark, range(9))), ["t"])
    two, tombstones = M.forget(store, "t", "id long, v string", spark.createDataFrame([(3,), (77,)], "id long"))
    assert sorted(r.id for r in store.read("t", two, READ).collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    assert two.parts["t"]["1"] == one.parts["t"]["1"] and [r.id for r in tombstones.collect()] == [3]
    three, more = M.forget(store, "t", "id long, v string", spark.createDataFrame([(4,)], "id long"))
    assert more.first().tombstone_id != tombstones.first().tombstone_id
    assert store.read("tombstones", three, "id long, tombstone_id string").count() == 2
    assert M.forget(store, "t", "id long, v string", spark.createDataFrame([(99,)], "id long"))[0] == three


def test_receipts_of_different_requests(spark):
    ledger = spark.range(10)
    ids = {M.forgotten(ledger, spark.createDataFrame([(i,) for i in x], "id long"))[1].first().tombstone_id for x in ([4], [3, 4], [], [2, 3, 4])}
    assert len(ids) == 4
