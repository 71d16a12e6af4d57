"""A store of features: rows bucketed by key, with a manifest that says what they were made from.

Stores with as many buckets join by key without moving a row. The manifest is written last, so a store whose writing broke off has none.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "spec int, rows long, first long, second long, names array<string>, key string, buckets int, columns string"


def _name(path: str) -> str:
    return f"features_{hashlib.md5(path.encode()).hexdigest()}"


def write_features(df: DataFrame, path: str, spec: int, stamp: DataFrame, names: tuple[str, ...] = (), key: str = "key", buckets: int = 64) -> DataFrame:
    """Writes df as the store at path, in place of one that is there, and opens it. stamp: (rows, first, second) of the corpus (see
    corpus_stamp); names: of the vector's components. Each bucket is one file, sorted by key."""
    spark, table = df.sparkSession, _name(path)
    spark.sql(f"DROP TABLE IF EXISTS {table}")
    made = stamp.first()
    df.repartition(buckets, key).write.format("parquet").mode("overwrite").option("path", f"{path}/data").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    row = (spec, made["rows"], made["first"], made["second"], list(names), key, buckets, columns)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return open_features(spark, path, spec, stamp)


def open_features(spark: SparkSession, path: str, spec: int, stamp: DataFrame | None = None) -> DataFrame:
    """The rows of a store, known to be bucketed. Features of another spec, and of a corpus that has changed since (by stamp, if given),
    are refused with ValueError."""
    try:
        made = spark.read.schema(MANIFEST).json(f"{path}/manifest").first()
    except Exception as e:
        raise ValueError(f"there is no store of features at {path}") from e
    if made is None or made["spec"] != spec:
        raise ValueError(f"the store at {path} was made by spec {made and made['spec']}, not {spec}")
    if stamp is not None and tuple(stamp.first()) != (made["rows"], made["first"], made["second"]):
        raise ValueError(f"the corpus has changed since the store at {path} was made")
    table = _name(path)
    key, n = made["key"], made["buckets"]
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({made['columns']}) USING parquet CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {n} BUCKETS LOCATION '{path}/data'")
    spark.catalog.refreshTable(table)
    return spark.table(table)


def component_names(spark: SparkSession, path: str) -> list[str]:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").select(F.col("names")).first()["names"]
