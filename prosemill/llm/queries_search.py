"""Queries of the operators on vectors, duplicates, personal data, secrets and mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import maxscore, mixing, pii, secrets, simhash
from .common import table

#: Stands in for a key in tests and reports. Production names its own in spark.prosemill.pii.key.
PII_KEY = "replace-this-key"


def pii_key(spark: SparkSession) -> str:
    return spark.conf.get("spark.prosemill.pii.key", PII_KEY)


def op1_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = maxscore.integer_vectors(table(spark, sf_dir, "embeddings"))
    return maxscore.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


OP1_SQL = """
WITH v AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.x) + 1), lambda i: q.x[i] * c.x[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.pseudonymise(docs, pii_key(spark))
    count = lambda k: F.size(F.filter("pii", lambda h: h["kind"] == k)).alias(f"n_{k}")
    return found.select("doc_id", "text", F.size("pii").alias("n_pii"), *[count(k) for k in pii.KINDS])


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", F.concat_ws("/", "source", "lang").alias("repository"))
    found = secrets.find_secrets(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        secrets.listed(F.col("live")).alias("live_spans"), secrets.listed(F.col("shared")).alias("shared_spans"),
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(table(spark, sf_dir, "documents"), power=0.5, seed=42).select("doc_id", "text", "lang", "source", "n_chars", "copy", "shuffle_key")


OP10_SQL = """
WITH n AS (
  SELECT coalesce(source, '') AS s, count(*) AS n, pow(CAST(count(*) AS DOUBLE), 0.5) AS weight FROM documents GROUP BY 1
), rates AS (
  SELECT s, weight * (SELECT CAST(sum(n) AS DOUBLE) FROM n) / (SELECT sum(weight) FROM n) / n AS rate FROM n
), terms AS (
  SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM rates, range(0, 400) AS t(k) WHERE k <= ceil(rate + 12 * sqrt(rate) + 30)
), sums AS (
  SELECT s, list(c ORDER BY k) AS sums FROM (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM terms) GROUP BY s
), counted AS (
  SELECT d.*, len(list_filter(sums, lambda c: c <= CAST(concat('0x', substr(md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 13)) AS BIGINT) / 4503599627370496.0)) AS copies
  FROM documents d JOIN sums ON coalesce(d.source, '') = sums.s
)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
  CAST(concat('0x', substr(md5(concat_ws(':', '42', coalesce(CAST(doc_id AS VARCHAR), ''), CAST(copy AS VARCHAR))), 1, 15)) AS BIGINT) AS shuffle_key
FROM (SELECT *, unnest(range(0, copies)) AS copy FROM counted)
"""

QUERIES = {"op1_maxscore": op1_maxscore, "op5_simhash": op5_simhash, "op7_pii": op7_pii, "op8_secrets": op8_secrets, "op10_mixing": op10_mixing}
SQL = {"op1_maxscore": OP1_SQL, "op10_mixing": OP10_SQL}
