"""The splittable reader of quoted CSV against Spark's whole-file reader, snapshots by run, stamps, the feature store."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from prosemill.operators import corpus
from prosemill.sources import io, store
from prosemill.sources.quoted import read_quoted_csv

SCHEMA = "id string, attack string, domain string, generation string"
HARD = ['plain', 'a "quoted" word', '"', '""', 'x,y', 'line\nbreak', '\n\n', 'tab\tand "mix"\n,"', 'é\n\U0001f600"', 'end\r\nof line', '', ' ', "it's", '"\n"', 'a\\"b', '\\']


def written(path, rows, end="\r\n", header=("attack", "id", "other", "domain", "generation")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(header)
        w.writerows(rows)
    return str(path)


@pytest.fixture
def split_size(spark):
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    yield lambda n: [spark.conf.set(k, v) for k, v in zip(keys, (str(n), "0", "1"))]
    for k in keys:
        spark.conf.unset(k)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 50, 333, 100_000])
def test_quoted_csv_at_every_split_size(spark, tmp_path, split_size, size):
    """Quotes, breaks, escapes and a field over many ranges, whatever the ranges are; one file and several."""
    r = random.Random(size)
    n = 8 if size < 7 else 60
    (tmp_path / "in").mkdir()
    want = []
    for k, end in enumerate(("\r\n", "\n")):
        rows = [("none", f"{k}-{i}", r.choice(HARD), "d", r.choice(HARD) + ("\n\"x\"," * 30 if i == 3 and size >= 7 else "")) for i in range(n)]
        written(tmp_path / "in" / f"{k}.csv", rows, end)
        want += [(b, e) for _, b, _, _, e in rows]
    split_size(size)
    df = read_quoted_csv(spark, str(tmp_path / "in"), "generation string, id string")
    assert df.columns == ["generation", "id"]
    got = {x["id"]: x["generation"] or "" for x in df.collect()}
    assert got == dict(want)
    if 7 <= size <= 50:
        assert spark.read.option("lineSep", "\n").text(str(tmp_path / "in")).rdd.getNumPartitions() > 20
    split_size(1 << 20)
    plain = spark.read.csv(str(tmp_path / "in"), header=True, multiLine=True, quote='"', escape='"', schema="attack string, id string, other string, domain string, generation string")
    # which makes one line end of two within fields
    assert {x["id"]: (x["generation"] or "").replace("\r\n", "\n") for x in plain.collect()} == {i: g.replace("\r\n", "\n") for i, g in got.items()}


def test_quoted_csv_cases(spark, tmp_path):
    path = written(tmp_path / "a.csv", [("none", "1", "", "d", "7"), ("none", "2", "", "d", "x")])
    assert [tuple(x) for x in read_quoted_csv(spark, path, "id int, domain string").orderBy("id").collect()] == [(1, "d"), (2, "d")]
    with pytest.raises(ValueError, match="no column"):
        read_quoted_csv(spark, path, "id int, nothing string")
    with pytest.raises(Exception, match="(?i)malformed"):
        read_quoted_csv(spark, path, "generation int").collect()
    (tmp_path / "b.csv").write_text('a,b\n1,"open\n')
    with pytest.raises(ValueError, match="don't pair"):
        read_quoted_csv(spark, str(tmp_path / "b.csv"), "a int").collect()
    (tmp_path / "c.csv").write_text("")
    assert read_quoted_csv(spark, str(tmp_path / "c.csv"), "a int").count() == 0
    (tmp_path / "d.csv").write_text("a,b\n\n1,2\n\n")
    assert [tuple(x) for x in read_quoted_csv(spark, str(tmp_path / "d.csv"), "b int, a int").collect()] == [(2, 1)]


def test_snapshots_by_run(spark, tmp_path):
    one = spark.range(2).withColumn("n", F.lit(1))
    for run, n in (("a", 1), ("b", 2), ("a", 3)):  # the first run is done again
        io.append_snapshot(one.withColumn("n", F.lit(n)), str(tmp_path / "s"), run)
    got = sorted((x["run"], x["id"], x["n"]) for x in spark.read.parquet(str(tmp_path / "s")).collect())
    assert got == [("a", 0, 3), ("a", 1, 3), ("b", 0, 2), ("b", 1, 2)]


def test_corpus_stamp(spark):
    stamp = lambda rows: tuple(corpus.corpus_stamp(spark.createDataFrame(rows, "text string, label string, split string")).first())
    a, b, c = ("a", "human", "train"), ("b", "human", "train"), ("c", "mixed", "val")
    same = [stamp(x) for x in ([a, b, c], [c, a, b])]
    assert same[0] == same[1] and stamp([]) == (0, 0, 0)
    other = [[a, a, c], [b, b, c], [a, b], [a, b, c, c], [a, b, (None, "mixed", "val")], [a, b, ("", "mixed", "val")], [a, b, ("c", "val", "mixed")], [a, b, ("c", None, "mixed")], [a, b, (None, "c", "mixed")], [a, b, ("c\x1f=mixed", "val", "")]]
    assert len({same[0], *map(stamp, other)}) == len(other) + 1
    df = spark.range(5000).selectExpr("cast(id % 70 as string) as text", "'x' as label", "'y' as split")
    assert corpus.corpus_stamp(df).first() == corpus.corpus_stamp(df.repartition(7)).first()


def test_feature_store(spark, tmp_path):
    """Stale rows are refused, a store can be opened anew and replaced, and two stores join without an exchange."""
    df = spark.range(300).selectExpr("sha1(cast(id as string)) as key", "cast(id as string) as text", "'human' as label", "array(cast(id as float), 1f) as vector")
    path, stamp = str(tmp_path / "base"), corpus.corpus_stamp(df, ("text", "label"))
    with pytest.raises(ValueError, match="no store"):
        store.open_features(spark, path, 5)
    store.write_features(df.drop("text"), path, 5, stamp, ("a", "b"), buckets=8)
    assert store.open_features(spark, path, 5, stamp).count() == 300 and store.component_names(spark, path) == ["a", "b"]
    with pytest.raises(ValueError, match="spec 5, not 6"):
        store.open_features(spark, path, 6, stamp)
    with pytest.raises(ValueError, match="has changed"):
        store.open_features(spark, path, 5, corpus.corpus_stamp(df.withColumn("label", F.lit("mixed")), ("text", "label")))
    lm = store.write_features(df.select("key", F.array(F.lit(2.0).cast("float")).alias("lm")), str(tmp_path / "lm"), 1, stamp, buckets=8)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        spark.sql(f"DROP TABLE {store._name(path)}")  # as another session finds it
        both = corpus.with_lm(store.open_features(spark, path, 5, stamp), lm, "key")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan and "Bucketed: true" in plan
        assert both.filter("size(vector) = 3").count() == 300
        again = store.write_features(df.limit(10).drop("text"), path, 6, stamp, buckets=4)
        assert again.count() == 10 and store.open_features(spark, path, 6).count() == 10
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
