"""Hand-computed cases and invariants of the operators."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from siltstone.functions import stem
from siltstone.functions import text as T
from siltstone.operators import memory, policy, reconcile, retrieval, scoring
from siltstone.session import spread
from siltstone.sources import readers, sinks
from siltstone.streaming import queue

EVENT = "event string, source string, candidate string, signal string, note string, tags array<string>, token_estimate long, confidence_hint double, risk_hint double"


def test_scores_of_hand_computed_rows(spark):
    rows = [
        ("pass", "t", "short context scorer", "verified success", "useful", ["adopt"], 700, 0.9, 0.1),
        ("prod", "t", "prod deploy helper", "token delete", "", [], None, None, None),
    ]
    got = {r.candidate: r for r in scoring.scored(spark.createDataFrame(rows, EVENT)).collect()}
    a = got["short context scorer"]
    assert (a.token_budget, a.decision) == (700, "promote")
    assert a.confidence == pytest.approx(0.35 + 0.05 + 0.25 + 0.135)
    b = got["prod deploy helper"]
    assert (b.confidence, b.risk, b.decision, b.token_budget) == (pytest.approx(0.475), 1.0, "reject", 1100)
    assert b.reasons == ["risk_terms=4"]


def test_score_limit(spark):
    rows = [("e", "s", f"c{i}", "", "", [], None, None, None) for i in range(12)]
    s = scoring.scored(spark.createDataFrame(rows, EVENT))
    assert scoring.ranked(s, limit=0).count() == 12 and scoring.ranked(s, limit=5).count() == 5


def test_no_secret_survives(spark):
    text = "password=abc123 token: sk-test-value Authorization: Bearer testvalue and bare sk-abcdefgh"
    out = spark.createDataFrame([(text,)], "t string").select(T.redacted(F.col("t"))).first()[0]
    assert "[REDACTED]" in out and not any(x in out for x in ("abc123", "sk-test-value", "testvalue", "sk-abcdefgh"))


@pytest.mark.parametrize(
    ("command", "want"),
    [
        ("git branch -D scratch-work", "allow"),
        ("git push origin --delete topic", "ask"),
        ("git branch -d main-backup", "allow"),
        ("git branch -d develop", "deny"),
        ("git branch -D refs/heads/main", "deny"),
        ("git -C repo branch --delete master", "deny"),
        ("git push origin :staging", "deny"),
        ("rm -rf /", "deny"),
        ("git push --force", "deny"),
        ("pip install x", "ask"),
        ("ls", "allow"),
    ],
)
def test_command_policy(spark, command, want):
    assert spark.createDataFrame([(command,)], "c string").select(policy.command_decision(F.col("c"))["decision"]).first()[0] == want


@pytest.mark.parametrize(
    ("bound", "want"),
    [("2026", None), ("2026-12-31", "2026-12-31 23:59:59"), ("2026-12-31T10:00:00Z", "2026-12-31 10:00:00"), ("2026-12-31 10:00", "2026-12-31 10:00:00"), ("2026-02-30", None), ("soon", None), (None, None)],
)
def test_expiry_bounds(spark, bound, want):
    got = spark.createDataFrame([(bound,)], "b string").select(T.expires(F.col("b")).cast("string")).first()[0]
    assert got == want


def test_fusion_constant(spark):
    got = [r[0] for r in spark.createDataFrame([(n,) for n in (1, 32, 100, 1000, 1024, 10_000, 1 << 20)], "n long").select(T.rrf_k(F.col("n"))).collect()]
    assert got == [30, 30, 40, 60, 60, 80, 120]


def test_stems_and_subtokens(spark):
    assert stem.stem("running") == stem.stem("runs") == "run"
    assert stem.folded("Café") == "cafe"
    assert [stem.stem(w) for w in ("relational", "hopping", "happy", "generalization", "controlling")] == ["relat", "hop", "happi", "gener", "control"]
    got = spark.createDataFrame([("fetchFlightScheduleBoard",)], "t string").select(T.subtokens(F.col("t"))).first()[0]
    assert {"fetch", "flight", "schedule", "board", "fetchflightscheduleboard"} == set(got)
    assert spark.createDataFrame([("Cafés running",), (None,)], "t string").select(stem.stemmed_tokens("t")).collect()[0][0] == ["cafe", "run"]


def test_ledger_lines(spark, tmp_path):
    p = tmp_path / "l.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n[1, 2]\n[{"a": 1}]\n"str"\n7\nnull\n{"a": "wrong", "b": "y"}\n')
    got = sorted(map(tuple, readers.json_lines(spark, str(p), {"a": "long", "b": "string"}).collect()), key=repr)
    assert got == [(1, "x"), (None, "y")]
    assert readers.json_lines(spark, str(tmp_path / "none"), {"a": "long"}).count() == 0
    p.write_text('{"a": 1}\n{bad\n')
    with pytest.raises(Exception, match="bad JSON"):
        readers.json_lines(spark, str(p), {"a": "long"}).collect()
    assert readers.json_lines(spark, str(p), {"a": "long"}, on_error="flag").where("_bad").count() == 1


def test_orphans_need_a_current_list(spark):
    rows = spark.createDataFrame([("c/x-1",), ("c/own",)], "path string")
    none = rows.limit(0)
    assert reconcile.orphans(rows, rows, none, "x-", []).count() == 0
    assert {r.path for r in reconcile.orphans(none, rows, rows.where("path = 'c/own'"), "x-", []).collect()} == {"c/x-1"}


def test_chain_with_unchained_prefix(spark):
    sha = {x: hashlib.sha256(x.encode()).hexdigest() for x in "bcd"}
    lines = [("a", None), ("b", None), ("c", sha["b"]), ("d", sha["c"]), ("e", sha["d"])]
    df = spark.createDataFrame([(1, i, x, p) for i, (x, p) in enumerate(lines)], "k int, i int, line string, prev string")
    assert reconcile.chain_status(df, "k", "i", "line", "prev").where("not ok").count() == 0
    bad = df.withColumn("line", F.when(F.col("i") == 3, "D").otherwise(F.col("line")))
    assert [r.i for r in reconcile.chain_status(bad, "k", "i", "line", "prev").where("not ok").collect()] == [4]


def test_dead_records_never_rank(spark):
    rows = [(1, [], None, False), (2, [3], None, False), (3, [], None, False), (4, [], "2020-01-01", False), (5, [], None, True), (6, [1], None, True)]
    r = spark.createDataFrame(rows, "id long, contradicts array<long>, expires_at string, tombstone boolean")
    now = F.lit("2024-01-01").cast("timestamp")
    assert sorted(x.id for x in memory.live(r, now).collect()) == [1, 2]
    assert sorted(x.id for x in memory.live(r, now, include_expired=True).collect()) == [1, 2, 4]


def test_removing_a_handler_collapses_its_parents(spark):
    hooks = {"Stop": [("x", [("mine",)])], "Start": [("x", [("mine",), ("theirs",)])]}
    df = spark.createDataFrame([(hooks,)], "h map<string, array<struct<matcher: string, hooks: array<struct<command: string>>>>>")
    got = df.select(reconcile.without_handlers(F.col("h"), "mine")).first()[0]
    assert list(got) == ["Start"] and [h.command for h in got["Start"][0].hooks] == ["theirs"]


def test_managed_block():
    once = sinks.managed_block("user\n", "kit", "# begin", "# end")
    assert sinks.managed_block(once, "kit", "# begin", "# end") == once and once.startswith("user")
    with pytest.raises(ValueError):
        sinks.managed_block("# begin\n", "kit", "# begin", "# end")


def test_canonical_json():
    assert sinks.canonical_json({"b": 1, "a": "é"}) == json.dumps({"a": "é", "b": 1}, indent=2, ensure_ascii=False) + "\n"


def test_lease_ends_exactly_at_its_time_and_third_attempt_kills():
    job = queue.step(queue.NEW, "enqueue", None, 0)
    for n in range(3):
        job = queue.step(job, "lease", "a", n * 300.0)
        assert job[:2] == ("processing", n + 1)
    assert queue.step(job, "complete", "b", 601)[0] == "processing"
    assert queue.step(job, "sweep", None, 899.9)[0] == "processing"
    assert queue.step(job, "sweep", None, 900.0)[0] == "dead"


def test_stream_equals_replay(spark, tmp_path):
    acts = [(j, i, a, "l", float(i)) for j in range(3) for i, a in enumerate(["enqueue", "lease", "fail", "lease", "complete"][: 3 + j])]
    df = spark.createDataFrame(acts, "job_id long, seq long, action string, lease_id string, at double")
    df.write.parquet(str(tmp_path / "in"))
    out = queue.streamed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = out.writeStream.format("memory").queryName("jobs").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("jobs").collect())) == sorted(map(tuple, queue.replayed(df).collect()))


def test_rounding_by_the_binary_value(spark):
    got = [r[0] for r in spark.createDataFrame([(0.175,), (0.475,), (0.8274999999999999,), (None,)], "x double").select(stem.rounded_2("x")).collect()]
    assert got == [0.17, 0.47, 0.83, None]


def test_numbers_and_first_replacement(spark):
    df = spark.createDataFrame([("0.5",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(T.number_in_range(F.col("s"))).collect()] == [0.5, None, None]
    with pytest.raises(Exception, match="not a number in range"):
        spark.createDataFrame([("2",)], "s string").select(T.number_in_range(F.col("s"))).collect()
    assert spark.createDataFrame([("a-b-b",)], "s string").select(T.first_replaced(F.col("s"), "b", "c")).first()[0] == "a-c-b"


#: A command for each pattern of the policy, in the lists' order; it must be that pattern that decides.
EACH = {
    "deny": [
        "rm -rf ~", "git reset --hard HEAD", "git clean -fd", "dropdb x", "DROP DATABASE x", "prisma migrate reset", "sequelize db:drop", "kubectl delete pod x", "terraform destroy",
        "pulumi destroy", "git branch -D main", "git push --force", "git push origin --delete trunk", "git push origin :prod", "git filter-branch x", "git filter-repo x", "git update-ref -d x", "git reflog expire x",
    ],
    "ask": ["git rebase x", "gh repo create x", "gh workflow run x", "pnpm add x", "uv add x"],
}


def test_each_pattern_of_the_policy(spark):
    lists = {"deny": policy.DENY, "ask": policy.ASK}
    rows = [(c, d, p) for d, commands in EACH.items() for c, p in zip(commands, lists[d], strict=True)]
    got = spark.createDataFrame(rows, "c string, d string, p string").select("c", "d", "p", policy.command_decision(F.col("c")).alias("x")).collect()
    assert [(r.c, r.x.decision, r.x.pattern) for r in got] == rows


def test_different_requests_have_different_tombstones(spark):
    rows = spark.createDataFrame([(i,) for i in (1, 2, 3, 3)], "id long")

    def tombs(*ids):
        got = memory.compacted(rows, spark.createDataFrame([(i,) for i in ids], "id long")).collect()
        assert sorted(r.id for r in got if r.tombstone) == sorted(set(ids) & {1, 2, 3})
        assert sorted(r.id for r in got if not r.tombstone) == sorted(i for i in (1, 2, 3, 3) if i not in ids)
        return {r.tombstone_id for r in got if r.tombstone}

    a, b = tombs(1, 3), tombs(2, 3, 9)
    assert len(a) == len(b) == 1 and a != b and tombs(9) == set()


def test_prior_session_is_recent(spark):
    rows = [(1, "a", "2024-01-01"), (1, "b", "2024-01-10"), (1, "c", "2024-01-12"), (2, "a", "2024-01-01"), (2, "b", "2024-02-01"), (3, "a", "2024-01-01")]
    df = spark.createDataFrame(rows, "u long, s string, t string").withColumn("t", F.to_timestamp("t"))
    assert [(r.u, r.s) for r in memory.prior_session(df, "u", "s", "t").collect()] == [(1, "b")]


def test_dense_falls_back_to_words(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue fish"), (3, "red red")], "vec_id long, text string")
    queries = spark.createDataFrame([(1, "blue")], "query_id long, text string")
    asked = vectors.where("vec_id = 1")

    def best(v):
        return [(r.query_id, r.vec_id, r.arm) for r in retrieval.dense_or_lexical(v, asked, docs, queries, "cosine", 1).collect()]

    assert best(vectors) == [(1, 2, "dense")]
    assert best(None) == best(vectors.limit(0)) == [(1, 2, "lexical")]


def test_user_scalars_win(spark):
    user = spark.createDataFrame([("a", "mine"), ("c", "own")], "name string, value string")
    kit = spark.createDataFrame([("a", "theirs"), ("b", "kit")], "name string, value string")
    assert {tuple(r) for r in reconcile.user_scalars(user, kit).collect()} == {("a", "mine"), ("b", "kit"), ("c", "own")}


def test_spread_leaves_small_and_shuffled_plans(spark, tmp_path):
    small = spark.range(10)
    assert spread(small) is small
    path = str(tmp_path / "t")
    spark.range(300_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text")).coalesce(1).write.parquet(path)
    one = spark.read.parquet(path)
    assert spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    grouped = one.groupBy("text").count()
    assert spread(grouped) is grouped
