"""Whitening: against the plain definition, exact integers, merges in any order, odd rows."""

import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltstone.llm import whitening as W

SF = "/root/testdata/sf0.001"


def plain(vectors, k=32):
    """The definition, over exact integers."""
    x = [[int(np.floor(64 * float(v))) + 1_000_000 for v in row] for row in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    apart = [[n * v - t for v, t in zip(row, s)] for row in x]
    centred = np.array([[v / n for v in row] for row in apart])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return n, [sum(v * v for v in row) for row in apart], centred @ axes / np.sqrt(values), values / (centred**2).mean(axis=0).sum()


def compare(rows, ids, want):
    n, deviations, white, explained = want
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == white.size and {r.n for r in rows} == {n}
    got = np.array([[by[i, c + 1].whitened for c in range(white.shape[1])] for i in ids])
    got *= np.sign((got * white).sum(axis=0))
    assert np.allclose(got, white, atol=1e-7)
    assert [by[i, 1].deviation for i in ids] == deviations
    assert np.allclose([by[ids[0], c + 1].explained for c in range(white.shape[1])], explained, rtol=1e-9)
    assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-9


def test_query_by_definition(spark):
    t = pq.read_table(f"{SF}/embeddings.parquet").to_pydict()
    compare(W.op13_chan_whitening(spark, SF).collect(), t["vec_id"], plain(t["embedding"]))


def test_merges_in_any_order():
    r = np.random.default_rng(5)
    x = r.integers(-90, 90, (500, 6)) + 1_000_000
    parts = [W.Moments.of(p) for p in np.split(x, [1, 40, 300, 301])]
    random.Random(1).shuffle(parts)
    while len(parts) > 1:
        parts = [parts.pop().merged(parts.pop()), *parts]
    assert parts[0].n == 500 and parts[0].sums == x.sum(axis=0).tolist()
    assert np.allclose(parts[0].scatter / 500, np.cov(x.T, bias=True), rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("partitions", [1, 3, 50])
def test_any_partitioning(spark, partitions):
    r = np.random.default_rng(6)
    vectors = r.normal(size=(40, 5)).round(3).tolist()
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(partitions)
    compare(W.whitened(df).collect(), list(range(40)), plain(vectors))


def test_odd_rows(spark):
    r = np.random.default_rng(7)
    good = [[*map(float, x), 2.0] for x in r.normal(size=(30, 3)).round(2)]  # one dimension without variance
    rows = [(i, v, 1.0) for i, v in enumerate(good)] + [(0, good[0], 1.0), (None, good[1], 1.0)]
    bad = [None, [], [1.0], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0]]
    df = spark.createDataFrame(rows + [(100 + i, v, 2.0) for i, v in enumerate(bad)], "vec_id long, embedding array<double>, whitened double")
    got = W.whitened(df).collect()
    assert len(got) == 32 * 4 and {x.n for x in got} == {32} and {x.vec_id for x in got} == {*range(30), None}
    assert {x.whitened for x in got if x.component == 4} == {0.0} and got[0].identity_error < 1e-9
    assert W.whitened(df.limit(0)).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert W.whitened(df.limit(0)).count() == 0 and W.whitened(df.where("vec_id >= 100 and vec_id <> 102")).count() == 0
    same = W.whitened(df.where("vec_id = 3")).collect()  # no variance at all
    assert {(x.whitened, x.explained, x.identity_error, x.deviation) for x in same} == {(0.0, 0.0, 0.0, 0)}


def test_deviation_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e9, 0.0]), (1, [-1e9, 0.0]), (2, [0.5, 0.0])], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.deviation for r in W.whitened(df).collect()}
    assert got[0] is None and got[1] is None and got[2] == 32**2 * 4
