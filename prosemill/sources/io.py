"""Sources and sinks. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosemill.functions.text import trim

from .quoted import read_quoted_csv

#: The corpus: text, label, source, domain, model, group, split and whether the model is a modern one.
CORPUS = "text string, label string, source string, domain string, model string, `group` string, split string, modern boolean"
SLIM = "id string, source_id string, model string, decoding string, attack string, domain string, title string, generation string"


def slim_csv(spark: SparkSession, path: str, schema: str, keep: list[str], kinds: tuple[str, ...] = ("none", "paraphrase"), min_domains: int = 8, text: str = "generation") -> DataFrame:
    """Columns keep of a CSV with quoted, multi-line text, read by byte ranges: rows of these attacks whose text isn't blank. Too few
    domains raise."""
    rows = read_quoted_csv(spark, path, schema).select(*keep)
    rows = rows.filter(F.col("attack").isin(*kinds) & F.col(text).isNotNull() & (trim(F.col(text)) != ""))
    if rows.agg(F.countDistinct("domain").alias("n")).first()["n"] < min_domains:
        raise ValueError(f"fewer than {min_domains} domains in {path}")
    return rows


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def read_jsonl(spark: SparkSession, path: str, schema: str, with_shard: bool = False) -> DataFrame:
    """JSON lines, compressed or not; with_shard adds the file's name."""
    rows = spark.read.schema(schema).json(path)
    return rows.withColumn("shard", F.element_at(F.split(F.input_file_name(), "/"), -1)) if with_shard else rows


def write_jsonl(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").json(path, compression=compression)


def write_corpus(df: DataFrame, path: str, by: str = "split") -> None:
    df.write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def read_feedback(df: DataFrame, spec: int) -> DataFrame:
    """Feedback of this spec whose label is a class."""
    return df.filter((F.col("spec") == spec) & (F.col("label") != "unsure"))


def append_snapshot(df: DataFrame, path: str, run: str) -> None:
    """df's rows as those of one run: a run that is written again replaces its own rows alone, so that a retried job adds nothing."""
    df.withColumn("run", F.lit(run)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run").parquet(path)


def stamp(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("sha1", F.sha1(F.coalesce(F.col(text), F.lit("")).cast("binary")))
