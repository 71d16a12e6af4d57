"""Queries of the streams: each writes given rows to the shared folder, runs the stream over what has arrived, and reads what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.session import scratch
from prosemill.streaming import streams

from . import queries_model
from .frames import documents

STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(rows: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What the stream built over rows gives, in append mode."""
    spark = rows.sparkSession
    source, out, state = (scratch(spark) for _ in range(3))
    rows.write.parquet(source)
    with _settings(spark, STATE):
        q = build(spark.readStream.schema(rows.schema).parquet(source)).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(out)


def ss1_scored_once(spark, d):
    """Lengths of all documents, each text's worked out once, in batches of some files of four."""
    source, store, out, state = (scratch(spark) for _ in range(4))
    docs = documents(spark, d).select("doc_id", "text")
    docs.repartition(4, "doc_id").write.parquet(source)

    def each(rows: DataFrame, batch: int) -> None:
        streams.score_batch(rows, batch, lambda texts: texts.select("key", F.length("text").alias("n")), store, out)

    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 2).parquet(source)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("doc_id long, text string, n int, batch long").parquet(out).select("doc_id", "n", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("key"))


def ss3_verdicts(spark, d):
    calls = queries_model._calls(spark, d).join(F.broadcast(queries_model._limits(spark, d)), "scope", "left")
    budgets = calls.groupBy("call_id").agg(F.count("*").cast("int").alias("budgets"))
    rows = calls.join(budgets, "call_id").select("call_id", "budgets", "ts", "scope", "key", "period", F.col("amount").cast("long").alias("amount"), F.col("limit").cast("long").alias("limit"))
    return _run(rows, streams.stream_verdicts).select("call_id", "allowed")


def ss4_changed(spark, d):
    """Texts of a source that differ from the one before, as blocks of one page would change."""
    rows = documents(spark, d).select("source", F.col("doc_id").alias("ts"), "text")
    return _run(rows, lambda s: streams.stream_rescore(s, ["source"], "source string")).groupBy("source", F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (ss1_scored_once, ss3_verdicts, ss4_changed)}
SQL = {
    "ss1_scored_once": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n, sha1(coalesce(text, '')) AS key FROM documents",
    "ss3_verdicts": f"SELECT DISTINCT call_id, allowed FROM ({queries_model.SQL['fb7_spend']})",
    "ss4_changed": "WITH t AS (SELECT source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth, lag(coalesce(text, '')) OVER (PARTITION BY source ORDER BY doc_id) AS last FROM documents) SELECT source, md5(text) AS text_md5, count(*) AS n FROM t WHERE nth = 1 OR coalesce(text, '') <> last GROUP BY 1, 2",
}
