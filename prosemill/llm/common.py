"""What several operators share: reading, checkpoints, tokens."""

from __future__ import annotations

import tempfile
import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.session import ready

#: Bytes that separate words: space and 0x09-0x0D, which bytes.split() uses too.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints: the one set on the context, or else what spark.checkpoint.dir names. Without either, a new one of
    this machine in local mode; on a cluster, whose executors must all see it, that is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            named = tempfile.mkdtemp(prefix="spark-")
        if not named:
            raise ValueError("set spark.checkpoint.dir, or a checkpoint folder on the context, to a folder that all executors share")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir().rstrip("/")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often and wherever body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to differ from all columns of df, whatever their case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder for checkpoints, so that a lost executor costs no lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored_path(spark: SparkSession) -> str:
    """A new place in the folder for checkpoints, which executors share."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the folder for checkpoints; smaller than a checkpoint."""
    spark = df.sparkSession
    path = stored_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def best(df: DataFrame, by: list[str], order: list[Column], k: int, parts: int = 64) -> DataFrame:
    """df with rank (from 1): the k first rows of each group in this order. Each of some parts of a group is ranked and cut first, so
    that no task gets a large group whole."""
    part = free_name(df, "part")
    first = df.withColumn(part, F.pmod(F.xxhash64(*[c for c in df.columns if c not in by]), F.lit(parts)))
    short = first.withColumn("rank", F.row_number().over(W.partitionBy(*by, part).orderBy(*order))).filter(F.col("rank") <= k)
    return short.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int")).filter(F.col("rank") <= k).drop(part)


def words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words as UTF-8; none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(doc_id: int | None, n: int) -> int:
    """crc32 of the id as text, mod n; null counts as the empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % n


def crc_mod_col(doc_id: Column, n: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)
