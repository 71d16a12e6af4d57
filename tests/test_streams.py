"""Streams with state: against their batch forms, over several batches, replays and restarts."""

import datetime
import time

import pytest
from pyspark.sql import functions as F

from prosemill.operators import feedback, scoring
from prosemill.streaming import streams

CALLS = "call_id long, budgets int, ts timestamp, scope string, key string, period string, amount long, limit long"


@pytest.fixture(autouse=True)
def ends(spark):
    """Timers make a batch without rows after each batch; a run over what has arrived would never end."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield spark
    spark.conf.unset(key)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def run(build, out, state):
    """One run over what has arrived, appended to out."""
    q = build.writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
    assert q.awaitTermination(180) and q.exception() is None


def test_verdicts_equal_spend(rocks, tmp_path):
    """Several budgets a call, over runs that each restart from the checkpoint; a call whose budget never comes is refused in the end."""
    spark, start = rocks, datetime.datetime(2026, 1, 1)
    at = lambda i: start + datetime.timedelta(seconds=i)
    calls = [(i, at(i), s, k, 1 + i % 2) for i in range(24) for s, k in (("all", "x"), ("user", f"u{i % 3}"), ("team", "t"))[: 2 + i % 2]]
    limit = {"all": 30, "user": 9, "team": 10}
    rows = [(i, 2 + i % 2, t, s, k, "d", n, limit[s]) for i, t, s, k, n in calls]
    stream = lambda: spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))
    for part in (range(0, 9), range(9, 24)):
        spark.createDataFrame([r for r in rows if r[0] in part], CALLS).repartition(3).write.mode("append").parquet(str(tmp_path / "in"))
        run(streams.stream_verdicts(stream(), wait_ms=1000), str(tmp_path / "out"), str(tmp_path / "state"))
    batch = feedback.spend(spark.createDataFrame(rows, CALLS).drop("limit", "budgets"), spark.createDataFrame(list(limit.items()), "scope string, limit long"))
    want = {x["call_id"]: x["allowed"] for x in batch.select("call_id", "allowed").distinct().collect()}
    got = [(x["call_id"], x["allowed"]) for x in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert dict(got) == want and len(got) == 24 and {True, False} == set(want.values())
    spark.createDataFrame([(99, 2, at(99), "lone", "x", "d", 1, 5)], CALLS).write.mode("append").parquet(str(tmp_path / "in"))
    run(streams.stream_verdicts(stream(), wait_ms=1000), str(tmp_path / "out"), str(tmp_path / "state"))
    time.sleep(1)
    spark.createDataFrame([(100, 1, at(100), "free", "x", "d", 1, None)], CALLS).write.mode("append").parquet(str(tmp_path / "in"))
    run(streams.stream_verdicts(stream(), wait_ms=1000), str(tmp_path / "out"), str(tmp_path / "state"))
    late = {x["call_id"]: (x["allowed"], x["answers"]) for x in spark.read.parquet(str(tmp_path / "out")).filter("call_id >= 99").collect()}
    assert late == {99: (False, 1), 100: (True, 1)}


def test_verdicts_of_many_calls(rocks, tmp_path):
    """Calls are kept by group, not by a key of state each; calls without an id are one call, and none is told twice."""
    spark, t, n = rocks, datetime.datetime(2026, 1, 1), 6_000
    ids = spark.range(n).select(F.when(F.col("id") >= 3, F.col("id")).alias("call_id"), F.when(F.col("id") < 3, 6).otherwise(2).cast("int").alias("budgets"))
    rows = [ids.select("call_id", "budgets", F.lit(t).alias("ts"), F.lit(s).alias("scope"), F.pmod("call_id", F.lit(k)).cast("string").alias("key"), F.lit("d").alias("period"), F.lit(1).cast("long").alias("amount"), F.lit(most).cast("long").alias("limit")) for s, k, most in (("a", 7, 10**6), ("b", 100, 50))]
    for part in rows:
        part.coalesce(2).write.mode("append").parquet(str(tmp_path / "in"))
        build = streams.stream_verdicts(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in")))
        q = build.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(180) and q.exception() is None
    assert max(x["numRowsTotal"] for x in q.lastProgress["stateOperators"]) <= streams.GROUPS + 1 < n
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == n - 2 and got.distinct().count() == n - 2 and got.filter("call_id is null and allowed and answers = 6").count() == 1
    assert got.filter("call_id is not null and not allowed and answers = 2").count() == n - 3 - got.filter("call_id is not null and allowed").count() == sum(max(0, len(range(k + 100 * (k < 3), n, 100)) - 50) for k in range(100))


def test_budgets_stream(rocks, tmp_path):
    spark, t = rocks, datetime.datetime(2026, 1, 1)
    rows = [(i, 1, t + datetime.timedelta(seconds=i), "a", "k", "d", n, 3) for i, n in enumerate((2, 1, 1))]
    spark.createDataFrame(rows, CALLS).write.parquet(str(tmp_path / "in"))
    run(streams.stream_budgets(spark.readStream.schema(CALLS).parquet(str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((x["call_id"], x["running"], x["within"]) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, 2, True), (1, 3, True), (2, 4, False)]


def test_each_text_is_scored_once(spark, tmp_path):
    """Texts that come again in later batches are not computed, a replayed batch changes nothing, and results are the batch form's."""
    store, out, asked = str(tmp_path / "store"), str(tmp_path / "out"), []

    def compute(texts):
        asked.append(sorted(x["text"] or "" for x in texts.collect()))
        return texts.select("key", F.length(F.coalesce("text", F.lit(""))).alias("n"))

    batches = [[(1, "aa"), (2, "b"), (3, "aa")], [(4, "b"), (5, None), (6, "ccc")], [(7, "ccc"), (8, "aa")]]
    rows = lambda i: spark.createDataFrame(batches[i], "id int, text string")
    shown = lambda: sorted(map(tuple, spark.read.parquet(out).select("id", "text", "n").collect()), key=str)
    for i in range(3):
        streams.score_batch(rows(i), i, compute, store, out)
    before = shown()
    assert asked == [["aa", "b"], ["", "ccc"], []] and before == sorted(((i, t, len(t or "")) for b in batches for i, t in b), key=str)
    streams.score_batch(rows(1), 1, compute, store, out)
    streams.score_batch(rows(1).limit(0), 9, compute, store, out)
    assert shown() == before and spark.read.parquet(store).count() == 4 and asked[3] == ["", "ccc"]


def test_stream_score_once(spark, tmp_path):
    net = scoring.Network.random((176, 8, 4, 3), seed=1)
    for part in range(2):
        spark.createDataFrame([(part * 10 + i, f"The word number {i} is here and it is not alone. " * 6) for i in range(part, part + 3)], "id int, text string").write.mode("append").parquet(str(tmp_path / "in"))
        q = streams.stream_score_once(spark.readStream.schema("id int, text string").parquet(str(tmp_path / "in")), net, str(tmp_path / "store"), str(tmp_path / "out"), tau=0.4, tau_machine=0.5)
        q.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(180)
    got, texts = spark.read.parquet(str(tmp_path / "out")), spark.read.parquet(str(tmp_path / "in"))
    assert spark.read.parquet(str(tmp_path / "store")).count() == 4 and got.count() == 6
    batch = streams.stream_score(texts, net, tau=0.4, tau_machine=0.5).select("id", "decision")
    assert sorted(map(tuple, got.select("id", "decision").collect())) == sorted(map(tuple, batch.collect()))


def test_rescore_forgets_idle_keys(spark, tmp_path):
    schema = "page string, ts int, text string"
    for i, (page, text, pause) in enumerate([("p", "a", 0), ("p", "a", 0), ("q", "x", 3), ("p", "a", 0)]):
        time.sleep(pause)
        spark.createDataFrame([(page, i, text)], schema).write.mode("append").parquet(str(tmp_path / "in"))
        run(streams.stream_rescore(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), ["page"], "page string", idle_ms=2000 if i else 60_000), str(tmp_path / "out"), str(tmp_path / "state"))
    # the second row is the text that is known; when q comes, p has been idle, so its text is new again
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("p", "a"), ("p", "a"), ("q", "x")]
