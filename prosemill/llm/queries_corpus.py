"""Queries of the operators on search, archives and phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import lexical, phrases, warc
from .common import table


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"), least=1000)


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"), least=10, inside=50, k=2000)


QUERIES = {"op11_lexical": op11_lexical, "op12_warc": op12_warc, "op13_phrases": op13_phrases}
SQL = {"op11_lexical": lexical.SQL, "op12_warc": warc.SQL, "op13_phrases": phrases.SQL}
