"""Places in a text: prefix sums over arrays, spans of matches, and their translation into UTF-16 units.

A span is a struct<start, end>. Pieces and matches of a pattern are measured and their lengths summed from the left, so all spans are
told in one pass. Places count code points unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int>>"
#: Pieces whose lengths are summed together, so that no array is copied as often as there are pieces.
BLOCK = 64
SUPPLEMENTARY = r"[\x{10000}-\x{10FFFF}]"


def prefix_sums(lengths: Column) -> Column:
    """array<int>: the sum of all lengths before each."""
    none = F.array().cast("array<int>")

    def add(s: Column, x: Column) -> Column:
        return F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))

    def chain(s: Column, b: Column) -> Column:
        moved = F.transform(b["out"], lambda x: x + s["at"])
        return F.struct((s["at"] + b["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.size(lengths), F.lit(1)), F.lit(BLOCK)), lambda i: F.aggregate(F.slice(lengths, i, F.lit(BLOCK)), zero, add))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out")), chain)
    return F.flatten(whole["out"])


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "UTF-16BE")) / 2).cast("int")


#: How a piece is measured.
UNITS = {"points": F.length, "utf16": utf16_length}


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def before(c: Column, part: Column) -> Column:
    """What stands before a part's first place in c."""
    return F.substring(c, F.lit(1), F.position(part, c) - 1)


def matches(c: Column, pattern: str, group: int = 0, length: Callable[[Column], Column] = F.length) -> Column:
    """array<struct<start, end, hit>>: all matches of a pattern, or of a group of it, which is sought in its match from the left."""
    def placed(found: Column) -> Column:
        starts = prefix_sums(F.transform(found, lambda x: length(x["gap"]) + length(x["hit"])))
        hit = lambda x: x["part"] if group else x["hit"]
        inner = lambda x: length(before(x["hit"], x["part"])) if group else F.lit(0)
        at = lambda x, s: s + length(x["gap"]) + inner(x)
        return F.zip_with(found, starts, lambda x, s: F.struct(at(x, s).cast("int").alias("start"), (at(x, s) + length(hit(x))).cast("int").alias("end"), hit(x).alias("hit")))

    def some(hits: Column) -> Column:
        rows = F.arrays_zip(F.split(c, pattern, -1).alias("gap"), hits.alias("hit"), *([F.regexp_extract_all(c, F.lit(pattern), group).alias("part")] if group else []))
        return once(F.filter(rows, lambda x: x["hit"].isNotNull()), placed)

    # most patterns have no match in most texts, which then needn't be split
    return once(F.regexp_extract_all(c, F.lit(pattern), 0), lambda hits: F.when(F.size(hits) == 0, F.array().cast("array<struct<start:int,end:int,hit:string>>")).otherwise(some(hits)))


def find_spans(c: Column, pattern: str, group: int = 0) -> Column:
    return bare(matches(c, pattern, group))


def bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end")))


def cut(c: Column, span: Column) -> Column:
    return F.substring(c, span["start"] + 1, span["end"] - span["start"])


def utf16_spans(c: Column, spans: Column) -> Column:
    """Spans in code points as spans in UTF-16 units: each place is moved by the supplementary characters before it."""
    def moved(wide: Column) -> Column:
        by = lambda p: (p + F.size(F.filter(wide, lambda w: w["start"] < p))).cast("int")
        return F.transform(spans, lambda s: F.struct(by(s["start"]).alias("start"), by(s["end"]).alias("end")))

    return F.when(c.rlike(SUPPLEMENTARY), once(find_spans(c, SUPPLEMENTARY), moved)).otherwise(bare(spans))
