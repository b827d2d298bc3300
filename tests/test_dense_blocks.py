"""Dense search holds few products at once."""

import random

import numpy as np

from siltstone.operators import retrieval


def test_blocks_of_queries(spark, monkeypatch):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    whole = sorted(map(tuple, retrieval.dense(df, df, k=4).collect()))
    held = []
    monkeypatch.setattr(retrieval, "CELLS", 600)
    monkeypatch.setattr(retrieval, "spread", lambda x: Here(x))

    class Here:
        """Runs the function of the tasks here, where the sizes of the products can be seen."""

        def __init__(self, df):
            self.df = df

        def mapInArrow(self, f, schema):
            show = np.round

            def seen(x, *a):
                held.append(np.size(x))
                return show(x, *a)

            monkeypatch.setattr(np, "round", seen)
            out = list(f(iter(self.df.toArrow().to_batches())))
            monkeypatch.setattr(np, "round", show)
            return spark.createDataFrame([x for b in out for x in zip(*(c.to_pylist() for c in b.columns))], schema)

    assert sorted(map(tuple, retrieval.dense(df, df, k=4).collect())) == whole
    assert max(held) <= 600
