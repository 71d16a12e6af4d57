"""Queries of the sources and sinks: each writes given rows to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from prosemill.functions import features
from prosemill.operators import corpus, feedback
from prosemill.session import scratch
from prosemill.sources import io, store

from . import frames, queries_text
from .frames import FEEDBACK, documents

ATTACKS = ("none", "paraphrase", "homoglyph")


def io1_slim_csv(spark, d):
    path = scratch(spark)
    rows = documents(spark, d).select(F.col("doc_id").cast("string").alias("id"), frames.pick(ATTACKS, F.col("doc_id")).alias("attack"), F.col("source").alias("domain"), F.col("lang").alias("model"), F.col("text").alias("generation"))
    rows.write.csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    slim = io.slim_csv(spark, path, "generation string, id string, attack string, domain string", ["id", "attack", "domain", "generation"])
    return slim.select("id", "attack", "domain", F.md5(F.col("generation").cast("binary")).alias("text_md5"))


def io3_jsonl(spark, d):
    path = scratch(spark)
    io.write_jsonl(documents(spark, d), path, "gzip")
    rows = io.read_jsonl(spark, path, "doc_id long, lang string, text string", with_shard=True)
    return rows.select("doc_id", "lang", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.col("shard").endswith(".json.gz").alias("packed"))


def io4_corpus(spark, d):
    path = scratch(spark)
    io.write_corpus(documents(spark, d).withColumn("split", frames.pick(("train", "val", "test"), F.col("doc_id"))), path)
    return spark.read.parquet(path).select("doc_id", "split", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def io5_text_files(spark, d):
    """Characters of all files of a language, whose texts end in a line break each."""
    path = scratch(spark)
    documents(spark, d).select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(path)
    files = io.read_text_files(spark, path)
    return files.groupBy(F.regexp_extract("file", "lang=([^/]*)", 1).alias("lang")).agg(F.sum(F.length("text")).alias("chars"))


def io7_snapshot(spark, d):
    """Weekly rates of two runs, of which the first is written twice."""
    path, weeks = scratch(spark), feedback.unsure_by_week(frames.feedback(spark, d))
    for run in ("monday", "tuesday", "monday"):
        io.append_snapshot(weeks, path, run)
    return spark.read.parquet(path).select("run", "week", "n", F.round("unsure_rate", 6).alias("unsure_rate"))


def io8_corpus_stamp(spark, d):
    return corpus.corpus_stamp(frames.labelled(spark, d), ("text", "label", "lang"))


def fx2_store(spark, d):
    """Every document's vector, from a store that is written, refused or accepted by spec and stamp, and opened."""
    docs = documents(spark, d).select("doc_id", "text")
    made = corpus.corpus_stamp(docs, ("doc_id", "text"))
    rows = features.extract_features(docs, "text", queries_text.TEST_PHRASES, queries_text.TEST_OPENERS).drop("text")
    kept = store.write_features(rows, scratch(spark), 5, made, features.FEATURE_NAMES, key="doc_id", buckets=16)
    return kept.select("doc_id", *[F.round(F.col("vector")[i].cast("double"), 4).alias(f"f{i:03d}") for i in range(len(features.FEATURE_NAMES))], "n_words", "english")


QUERIES = {f.__name__: f for f in (io1_slim_csv, io3_jsonl, io4_corpus, io5_text_files, io7_snapshot, io8_corpus_stamp, fx2_store)}
_ROW = " || ".join(f"coalesce(length({c}) || ':' || {c}, '-')" for c in ("d.text", "d.label", "d.lang"))
_PART = lambda start: f"coalesce(CAST(sum(CAST(CAST('0x' || substr(h, {start}, 15) AS BIGINT) AS HUGEINT)) % 1152921504606846976 AS BIGINT), 0)"
SQL = {
    "io1_slim_csv": f"SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS id, ({frames.sql_list(ATTACKS)})[doc_id % 3 + 1] AS attack, source AS domain, md5(text) AS text_md5, text FROM documents) SELECT id, attack, domain, text_md5 WHERE attack <> 'homoglyph' AND regexp_matches(text, '[^\\t\\n\\x0B\\f\\r ]')".replace("SELECT * FROM (", "FROM ("),
    "io3_jsonl": "SELECT doc_id, lang, md5(text) AS text_md5, true AS packed FROM documents",
    "io4_corpus": "SELECT doc_id, (['train', 'val', 'test'])[doc_id % 3 + 1] AS split, source, md5(text) AS text_md5 FROM documents",
    "io5_text_files": "SELECT lang, CAST(sum(length(coalesce(text, '')) + 1) AS BIGINT) AS chars FROM documents GROUP BY lang",
    "io7_snapshot": f"""WITH {FEEDBACK}, weeks AS (SELECT strftime(created_at, '%G-W%V') AS week, count(*) AS n, round(avg(CASE WHEN predicted = 'unsure' THEN 1.0 ELSE 0.0 END), 6) AS unsure_rate FROM feedback GROUP BY 1)
SELECT run, week, n, unsure_rate FROM weeks, (VALUES ('monday'), ('tuesday')) AS r(run)""",
    "io8_corpus_stamp": f"WITH {frames.LABELLED}, hashed AS (SELECT md5({_ROW}) AS h FROM labelled d) SELECT count(*) AS rows, {_PART(1)} AS first, {_PART(16)} AS second FROM hashed",
    "fx2_store": queries_text.VECTOR_SQL,
}
