"""CSV with quoted fields that hold line breaks, read by byte ranges.

Spark's text reader gives each task the physical lines that begin in its range of a file. A line break ends a record if an even number
of quotes stands before it in the file, and an escaped quote is two. So one pass counts the quotes of each range; their sums from
the left say whether a range begins inside a quoted field; a second pass joins lines to records in each range. What a range has of a
record that began before it, or ends after it, is at most two pieces, and these are put together by the range where the record began.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIECE = "file string, block long, kind string, text string"
WHOLE, HEAD, TAIL, INSIDE = "record", "head", "tail", "inside"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def ranges(lines: DataFrame) -> DataFrame:
    """(file, block, begun, odd_end): whether a range begins within a quoted field; odd_end says it of its end. A row for each range."""
    odd = (F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd")
    order = W.partitionBy("file").orderBy("block")
    upto = F.sum("odd").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return lines.groupBy("file", "block").agg(odd).withColumn("upto", upto).select("file", "block", ((F.col("upto") - F.col("odd")) % 2 == 1).alias("begun"), (F.col("upto") % 2 == 1).alias("odd_end"))


def _pieces(lines: DataFrame, begun: set[tuple[str, int]]) -> DataFrame:
    """PIECE rows: whole records, and what a range holds of records that begin before it (head), end after it (tail) or both (inside)."""
    shared = lines.sparkSession.sparkContext.broadcast(begun)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, at, inside, first, held = shared.value, None, False, False, []
        for b in batches:
            out = []
            for file, block, line in zip(b["file"], b["block"], b["value"]):
                if (file, block) != at:
                    if held:
                        out.append((*at, INSIDE if first else TAIL, "\n".join(held)))
                    at, held = (file, block), []
                    inside = first = at in own
                held.append(line)
                if line.count('"') % 2:
                    inside = not inside
                if not inside:
                    out.append((file, block, HEAD if first else WHOLE, held[0] if len(held) == 1 else "\n".join(held)))
                    held, first = [], False
            if out:
                yield pd.DataFrame(out, columns=["file", "block", "kind", "text"])
        if held:
            yield pd.DataFrame([(*at, INSIDE if first else TAIL, "\n".join(held))], columns=["file", "block", "kind", "text"])

    return lines.mapInPandas(run, PIECE)


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, first, text): each record as it stands in the file, without its line end; first: whether it is the file's first.

    Blank records are left out. A file whose quotes don't pair raises ValueError.
    """
    lines = _lines(spark, path)
    found = ranges(lines).collect()  # a row for each range, of which the driver plans a task anyway
    last = {r["file"]: r for r in sorted(found, key=lambda r: (r["file"], r["block"]))}
    if wrong := sorted(f for f, r in last.items() if r["odd_end"]):
        raise ValueError(f"quotes don't pair in {wrong[0]}")
    pieces = _pieces(lines, {(r["file"], r["block"]) for r in found if r["begun"]})
    whole = pieces.filter(F.col("kind") == WHOLE).select("file", "block", "text")
    # of each record that crosses ranges, the range where it begins: the last tail before or at its piece
    parts = pieces.filter(F.col("kind") != WHOLE)
    order = W.partitionBy("file").orderBy("block", F.col("kind") == TAIL)
    begun = F.max(F.when(F.col("kind") == TAIL, F.col("block"))).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    crossing = parts.withColumn("begin", begun).groupBy("file", "begin").agg(F.array_sort(F.collect_list(F.struct("block", "text"))).alias("parts"))
    joined = crossing.select("file", F.col("begin").alias("block"), F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    text = F.regexp_replace("text", "\r\\z", "")
    return whole.unionByName(joined).select("file", "block", text.alias("text")).filter("text <> ''")


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The columns of schema, by their names in the files' header, of a CSV whose fields may be quoted and then hold anything.

    Every file begins with the same header, as a line of its own. A column that it lacks raises ValueError, and a field that isn't of its
    column's type an error when it is read. Splittable at any byte: the number of tasks follows the size, also of one file.
    """
    starts = spark.read.option("lineSep", "\n").text(path).limit(1).collect()
    if not starts:
        return spark.createDataFrame([], schema)
    header = starts[0]["value"].removesuffix("\r")
    names = next(csv.reader([header]))
    wanted = T._parse_datatype_string(schema)
    if missing := [f.name for f in wanted.fields if f.name not in names]:
        raise ValueError(f"{path} has no column {missing[0]}")
    kinds = {f.name: f.dataType for f in wanted.fields}
    # by position, since a header may repeat names that aren't asked for
    full = T.StructType([T.StructField(f"c{i}", kinds.get(n, T.StringType())) for i, n in enumerate(names)])
    options = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "FAILFAST"}
    rows = records(spark, path).filter(F.col("text") != header).select(F.from_csv("text", full.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("r"))
    return rows.select(*[F.col("r")[f"c{names.index(f.name)}"].alias(f.name) for f in wanted.fields])
