"""All queries over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_io, queries_model, queries_streams, queries_text

QUERIES = {**queries_text.QUERIES, **queries_model.QUERIES, **queries_io.QUERIES, **queries_streams.QUERIES}
SQL: dict[str, str] = {**queries_text.SQL, **queries_model.SQL, **queries_io.SQL, **queries_streams.SQL}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_model.flagship(spark, sf_dir)
