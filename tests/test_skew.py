"""Hot keys: results as from plain joins and windows, rows spread over tasks without Spark's own skew handling."""

import datetime

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.functions import web
from prosemill.operators import corpus, feedback, skew, training


@pytest.fixture
def plain(spark):
    """No skew handling, no coalescing, no automatic broadcast."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def most_in_a_task(df):
    return max(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect())


def texts(spark):
    """6000 rows, half of them one text; nulls and empty texts among the rest."""
    t = F.when(F.col("id") % 2 == 0, "hot text").when(F.col("id") % 501 == 0, None).when(F.col("id") % 503 == 0, "").otherwise(F.concat(F.lit("t"), F.col("id") % 700))
    return spark.range(0, 6000, 1, 12).select("id", t.alias("text"))


def test_hot_keys(spark):
    df = texts(spark)
    assert skew.hot_keys(df, "text")[0] == "hot text" and skew.hot_keys(df.limit(0), "text") == []
    assert skew.hot_keys(spark.createDataFrame([(None,)], "text string"), "text") == []


@pytest.mark.parametrize("how", ["inner", "left"])
def test_join_hot(plain, how):
    df = texts(plain)
    right = df.filter("text is not null and text <> 't7'").groupBy("text").agg(F.min("id").alias("first"))
    got, want = skew.join_hot(df, right, "text", how, most=5), df.join(right, "text", how)
    assert sorted(map(str, got.select("id", "text", "first").collect())) == sorted(map(str, want.select("id", "text", "first").collect()))
    assert most_in_a_task(got) < 1000 < 3000 <= most_in_a_task(want)
    with pytest.raises(ValueError):
        skew.join_hot(df, right, "text", "outer")


def test_score_back_of_a_hot_text(plain):
    df = texts(plain)
    scored = corpus.distinct_texts(df).select("key", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    got = corpus.score_back(df, scored)
    assert got.count() == 6000 and got.filter(F.col("n") != F.length(F.coalesce("text", F.lit("")))).count() == 0
    assert most_in_a_task(got) < 1500


def test_default_off_of_a_hot_host(plain):
    df = plain.range(0, 4000, 1, 8).select("id", F.when(F.col("id") % 2 == 0, "a.hot.example").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("h"), F.col("id") % 50, F.lit(".b.org"))).alias("host"))
    domains = plain.createDataFrame([("hot.example",), ("hot.example",), ("h7.b.org",), (None,)], "domain string")
    got = web.default_off_host(df, "host", domains)
    assert got.count() == 4000 and most_in_a_task(got) < 1000
    assert {x["host"] for x in got.filter("off").collect()} == {"a.hot.example", "h7.b.org"} and got.filter("host is null and off is null").count() == 40


def test_spend_of_a_hot_budget(plain):
    """As one window gives it, with half of all calls on one budget, equal times, null keys and no amounts; the budget spreads over tasks."""
    start = datetime.datetime(2026, 1, 1)
    rows = []
    for i in range(4000):
        rows.append((i, start + datetime.timedelta(seconds=(i * 37) % 9000, milliseconds=i % 3 * 400), "all", "hot", "d", i % 5))
        rows.append((i, start + datetime.timedelta(seconds=(i * 37) % 9000, milliseconds=i % 3 * 400), "user", f"u{i % 90}" if i % 11 else None, "d", None if i % 13 == 0 else 1))
    calls = plain.createDataFrame(rows, "call_id int, ts timestamp, scope string, key string, period string, amount int").repartition(6)
    limits = plain.createDataFrame([("all", 3000), ("user", 20)], "scope string, limit int")
    got = feedback.spend(calls, limits)
    w = W.partitionBy("scope", "key", "period").orderBy("ts", "call_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = calls.withColumn("running", F.coalesce(F.sum("amount").over(w), F.lit(0))).join(limits, "scope").withColumn("within", F.col("running") <= F.col("limit"))
    want = {(x["call_id"], x["scope"]): (x["running"], x["within"]) for x in run.collect()}
    out = got.collect()
    assert len(out) == len(want) == 8000 and all(want[x["call_id"], x["scope"]] == (x["running"], x["within"]) for x in out)
    assert all(x["allowed"] == (want[x["call_id"], "all"][1] and want[x["call_id"], "user"][1]) for x in out) and 0 < sum(x["allowed"] for x in out) < 8000
    totals = skew.running_totals(calls, ["scope", "key", "period"], ["ts", "call_id"], "amount", "running", feedback.time_slices(calls, "ts"))
    assert most_in_a_task(totals) < 1000


@pytest.mark.parametrize("values", [[5.0], [1.0, 2.0], [0.5] * 3000 + [0.7], list(np.random.default_rng(1).normal(size=3000)), [1.0, np.nextafter(1.0, 2), np.nextafter(1.0, 2), 2.0], [-1.7e308, 0.0, 1e-300, 1.7e308], [float("-inf"), 1.0, 3.0]])
def test_quantile_is_exact(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "x double")
    sound = [v for v in values if np.isfinite(v)]
    if len(sound) < len(values):
        df = df.filter("x > -1e308 or x is null")
    for q in (0.0, 0.25, 0.5, 0.995, 1.0):
        assert training.quantile(df, "x", q) == pytest.approx(float(np.quantile(sound, q)), rel=1e-12, abs=1e-300)
    assert training.quantile(df.filter("x is null"), "x", 0.5) is None


def test_eval_sample_of_a_hot_source(plain):
    df = plain.range(0, 6000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "human").otherwise("machine").alias("label"), F.when(F.col("id") % 10 == 0, F.col("id") % 3).otherwise(7).cast("string").alias("source"))
    got = corpus.eval_sample(df, {"human": 40, "machine": 10})
    assert {x["label"]: x["count"] for x in got.groupBy("label").count().collect()} == {"human": 40, "machine": 10}
    assert got.filter("label = 'human'").groupBy("source").count().agg(F.min("count")).first()[0] == 10
