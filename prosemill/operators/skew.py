"""Joins and running totals of keys that may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Keys that a sketch returns at most, and those it tracks. A key with more than one in TRACKED of all rows is among them.
HOT, TRACKED = 1000, 10_000


def hot_keys(df: DataFrame, key: str, most: int = HOT) -> list:
    """At most so many of the most frequent values of key, by a mergeable sketch of fixed size in one pass without a shuffle.

    What it misses or overrates changes how rows travel, never a result.
    """
    n = min(most, TRACKED)
    found = df.filter(F.col(key).isNotNull()).agg(F.expr(f"approx_top_k(`{key}`, {n}, {max(TRACKED, n)})").alias("top")).first()["top"] or []
    total = sum(x["count"] for x in found)
    return [x["item"] for x in found if x["count"] > max(1, total // (10 * n))]


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", most: int = HOT) -> DataFrame:
    """left joined with right, which has one row for each key: rows of left's hot keys meet a broadcast of these keys' rows, which are
    as many at most, and the others are shuffled. how: inner or left; a null key meets nothing."""
    if how not in ("inner", "left"):
        raise ValueError("how is inner or left")
    hot = hot_keys(left, key, most)
    if not hot:
        return left.join(right, key, how)
    among = F.col(key).isin(hot)
    first = left.filter(among).join(F.broadcast(right.filter(among)), key, how)
    return first.unionByName(left.filter(~F.coalesce(among, F.lit(False))).join(right.filter(~among), key, how))


def _nulls_too(a: DataFrame, b: DataFrame, by: list[str], how: str, extra: list[str]) -> DataFrame:
    other = b.select(*[F.col(c).alias(f"_other_{c}") for c in by], *extra)  # names of its own, since both may come from one table
    same = [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in by]
    return a.join(other, same, how).select(*a.columns, *extra)


def running_totals(df: DataFrame, by: list[str], order: list[str], amount: str, out: str, slices: list[Column]) -> DataFrame:
    """df with out: the sum of amount over the rows of the group up to and with this one.

    slices are coarse to fine and must not fall along the order; sums of the finest are made first, what stands before a slice is added
    up from coarse to fine, and only rows within one finest slice are ordered. So a group spreads over as many tasks as it has slices.
    Null keys are a group, and null amounts add nothing.
    """
    names = [f"_slice_{i}" for i in range(len(slices))]
    rows = df.withColumns(dict(zip(names, slices)))
    sums = {names[-1]: rows.groupBy(*by, *names).agg(F.sum(amount).alias("_sum"))}
    for i in range(len(names) - 2, -1, -1):
        sums[names[i]] = sums[names[i + 1]].groupBy(*by, *names[: i + 1]).agg(F.sum("_sum").alias("_sum"))
    before = None
    for i, name in enumerate(names):
        up_to = W.partitionBy(*by, *names[:i]).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
        here = sums[name].withColumn("_here", F.coalesce(F.sum("_sum").over(up_to), F.lit(0))).drop("_sum")
        if before is None:
            before = here.withColumnRenamed("_here", "_before")
        else:
            both = _nulls_too(here, before, [*by, *names[:i]], "left", ["_before"])
            before = both.withColumn("_before", F.col("_before") + F.col("_here")).drop("_here")
    within = F.sum(amount).over(W.partitionBy(*by, *names).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    placed = _nulls_too(rows, before, [*by, *names], "left", ["_before"])
    return placed.withColumn(out, F.col("_before") + F.coalesce(within, F.lit(0))).drop("_before", *names)
