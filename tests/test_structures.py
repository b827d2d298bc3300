"""Dense search, dictionaries, schemas, nested cleaning, chains and the event stream, on small cases."""

import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions import nested, schema
from siltstone.operators import dictionary, reconcile, retrieval
from siltstone.sources.versions import Versions
from siltstone.streaming import queue


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("at_once", [40, 64 << 20])
def test_dense_by_definition(spark, monkeypatch, metric, at_once):
    monkeypatch.setattr(retrieval, "QUERY_BYTES", at_once)
    r = np.random.default_rng(2)
    v = {i: list(map(float, r.integers(-2, 3, 3))) for i in range(60)} | {60: [0.0, 0.0, 0.0], 61: [1.0, float("nan"), 0.0], 62: None, 63: [1.0], 64: [1.0, None, 2.0]}
    df = spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>").repartition(3)
    got = {}
    for x in retrieval.dense(df, df.where("vec_id % 10 = 0"), metric, k=7).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id))
    fine = {i: np.array(x) for i, x in v.items() if i < 60 or i == 60 and metric == "dot"}

    def score(a, b):
        return round(float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) if metric == "cosine" else a @ b), 9)

    fine = {i: x for i, x in fine.items() if metric == "dot" or x.any()}
    for q in (i for i in fine if i % 10 == 0):
        want = sorted((-score(x, fine[q]), i) for i, x in fine.items() if i != q)[:7]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]
    assert set(got) == {i for i in fine if i % 10 == 0}
    assert retrieval.dense(df.limit(0), df.where("vec_id = 10")).count() == 0 and retrieval.dense(df, df.limit(0)).count() == 0


@pytest.mark.parametrize("shard_bytes", [40, 1 << 20])
def test_dictionary_by_definition(spark, shard_bytes):
    r = random.Random(1)
    texts = [(i, "".join(r.choice("abé ") for _ in range(r.randrange(40)))) for i in range(60)] + [(60, None), (61, ""), (61, "ab" * 30_000)]
    phrases = ["ab", "abab", "é", " ", "b a", "zz", "", None, "ab"] + ["".join(r.choice("abé ") for _ in range(3)) for _ in range(8)]
    got = dictionary.found(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in phrases], "phrase string"), "id", shard_bytes=shard_bytes)

    def count(t, p):
        return sum(t.startswith(p, i) for i in range(len(t)))

    want = sorted((i, p, n) for i, t in texts for p in {p for p in phrases if p} if (n := count(t or "", p)))
    assert sorted(map(tuple, got.collect())) == want
    left = dictionary.missing(spark.createDataFrame([(p,) for p in phrases], "phrase string"), spark.createDataFrame(texts, "id long, text string"))
    assert [r.phrase for r in left.collect()] == [p for p in phrases if p and not any(p in (t or "") for _, t in texts)]


SCHEMA = {
    "type": "object", "required": ["a", "z"], "additionalProperties": {"type": "integer", "maximum": 3},
    "properties": {"a": {"type": ["string", "null"], "pattern": "^x"}, "n": {"type": "number", "minimum": 1}, "l": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["k"], "properties": {"k": {"const": 5}}, "additionalProperties": False}}},
}
CASES = [
    ({"a": "x", "z": 1}, []),
    ({"a": None, "z": 3.0}, []),
    ({"a": "y"}, ["$.a: pattern", "$.z: required"]),
    ({"a": 1, "z": 4, "b": "1"}, ["$.a: type", "$.b: type", "$.z: maximum"]),
    ({"a": "x", "z": 1, "n": "2"}, ["$.n: type"]),
    ({"a": "x", "z": 1, "n": 0.5, "l": []}, ["$.n: minimum", "$.l: minItems"]),
    ({"a": "x", "z": 1, "l": [{"k": 5}, {}, {"k": 6, "q": 1}, 7]}, ["$.l[1].k: required", "$.l[2].k: const", "$.l[2].q: additionalProperties", "$.l[3]: type"]),
    ([1], ["$: type"]),
]


def test_schemas_as_data(spark, tmp_path):
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(CASES)] + [(90, "{"), (91, None)], "i int, t string")
    got = {r.i: r.e for r in df.select("i", schema.violations(F.col("t"), SCHEMA).alias("e")).collect()}
    assert [got[i] for i in range(len(CASES))] == [e for _, e in CASES] and got[90] == got[91] == ["$: json"]
    with pytest.raises(ValueError, match="oneOf"):
        schema.violations(F.col("t"), {"oneOf": []})
    (tmp_path / "s.json").write_text(json.dumps({"name": "tool", "input_schema": SCHEMA}))
    assert schema.from_file(spark, str(tmp_path / "s.json")) == SCHEMA
    assert all(schema.packaged(x)["type"] == "object" for x in ("content_classification", "generated_comment", "post_comment"))


def test_cleaning_at_any_depth(spark):
    kind = "i long, s string, a array<array<string>>, m map<string,struct<p:string,n:int>>, t struct<x:array<map<string,string>>>"
    bad = 'password="q\\" x /home/me/f'
    df = spark.createDataFrame([(1, bad, [[bad, None], None], {"secret=1": (bad, 3)}, ([{"k": "ok"}],)), (2, None, None, None, None)], kind)
    df = df.withColumn("v", F.when(F.col("i") == 1, F.parse_json(F.lit(json.dumps({"token=1": [bad, {"a\"b: ": "api_key=zz"}, 5, None, True], "e": ""}))))).withColumn("w", F.to_json("v"))
    one, two = nested.cleaned_rows(df).withColumn("v", F.to_json("v")).orderBy("i").collect()
    clean = "password[REDACTED] x [PATH]"
    assert one.s == clean and one.a == [[clean, None], None] and one.m == {"secret=1": (clean, 3)} and one.t.x == [{"k": "ok"}]
    assert json.loads(one.v) == {"token=1": [clean, {"a\"b: ": "api_key[REDACTED]"}, 5, None, True], "e": ""}
    assert (two.s, two.a, two.m, two.t, two.v) == (None,) * 5


@pytest.mark.parametrize("parts", [1, 4, 40])
def test_one_long_chain(spark, parts):
    lines = [(i, f"line {i}") for i in range(50)]
    df = spark.createDataFrame(lines, "n long, line string").repartition(3)
    got = {r.n: r.prev_sha for r in reconcile.chained(df, "n", "line", parts).collect()}
    assert got == {i: hashlib.sha256(lines[i - 1][1].encode()).hexdigest() if i else None for i in range(50)}
    rows = [(i, x if i != 20 else "changed", None if i < 5 or i == 30 else got[i]) for i, x in lines]
    status = reconcile.whole_chain_status(spark.createDataFrame(rows, "n long, line string, prev string"), "n", "line", "prev", parts)
    assert sorted(r.n for r in status.where("not ok").collect()) == [21, 30] and status.count() == 50
    assert reconcile.chained(df.limit(0), "n", "line").count() == 0


def test_stream_counts_each_event_once(spark, tmp_path):
    folder, store = tmp_path / "in", Versions(spark, f"{tmp_path}/ledger")
    kind = "event_id long, ts timestamp, body struct<note: string>"

    def put(name, ids):
        rows = [(i, f"token=abc{i}") for i in ids]
        df = spark.createDataFrame(rows, "event_id long, note string").select("event_id", F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"), F.struct("note").alias("body"))
        df.coalesce(1).write.mode("append").json(f"{folder}/{name}")

    def run():
        events = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(folder))
        queue.append_events(events, store, f"{tmp_path}/cp").awaitTermination()
        return sorted(r.event_id for r in store.read("events", store.version(), kind + ", part string").collect())

    put("a", [1, 2, 3])
    put("b", [2, 3, 4])
    assert run() == [1, 2, 3, 4]
    put("c", [4, 5])  # the query begins again from its checkpoint
    assert run() == [1, 2, 3, 4, 5] == run()
    ledger = store.read("events", store.version(), kind + ", part string")
    assert {r.body.note for r in ledger.collect()} == {"token[REDACTED]"}
    # the last batch is delivered once more, as after a crash between its commit and the checkpoint
    last = max(int(x) for x in os.listdir(f"{tmp_path}/cp/commits") if x.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{tmp_path}/cp/commits/{name}")
    assert run() == [1, 2, 3, 4, 5]
