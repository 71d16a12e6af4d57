"""Mixing sources to target weights by Poisson replication, with DataFrame functions only.

A source's target repetition rate is weight share x total rows / its rows. Each document gets a number in [0, 1) from a seeded
hash of its id, and the Poisson distribution with its source's rate is inverted at that number: the count of cumulative
probabilities below it. The document is exploded by its count, and the copies are dealt out and sorted by another seeded hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

#: Up to so many sources, their distributions are broadcast; beyond, they are joined by shuffling, salted.
BROADCAST_SOURCES = 4096
SALTS = 64


def seeded_hash(*parts: Column, digits: int = 15) -> Column:
    """The first hex digits of the MD5 of the parts, joined by ':', as a long."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10).cast("long")


def unit_hash(*parts: Column) -> Column:
    """52 bits of the hash as a double in [0, 1)."""
    return seeded_hash(*parts, digits=13) / F.lit(2.0**52)


def cumulative(rate: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... of the Poisson distribution with this rate (0 or more), up to where double precision ends."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    # terms by logarithms, since exp(-rate) underflows beyond 745
    return F.when(rate <= 0, F.array(F.lit(1.0))).otherwise(
        F.aggregate(
            F.sequence(F.lit(1), last),
            F.struct((-rate).alias("log"), F.array(F.exp(-rate)).alias("sums")),
            lambda s, k: F.struct(
                (s["log"] + F.log(rate / k)).alias("log"),
                F.concat(s["sums"], F.array(F.element_at(s["sums"], -1) + F.exp(s["log"] + F.log(rate / k)))).alias("sums"),
            ),
            lambda s: s["sums"],
        )
    )


def source_rates(docs: DataFrame, power: float = 0.5, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, rate): each source's mean number of copies, so that as many rows come out as go in, in expectation.

    Weights come from the dictionary (a source it leaves out has weight 0), or else are row counts to this power: 1 keeps the
    mixture, 0 evens it out. A null source is a source of its own, named ''. If all weights are 0, all rates are.
    """
    counts = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(power)))
    elif weights:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in sorted(weights.items()) for x in (k, float(v))]), F.col("source")), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("n").alias("rows"), F.sum("weight").alias("weights")).first()
    if not total["weights"]:
        return counts.select("source", F.lit(0.0).alias("rate"))
    return counts.select("source", (F.col("weight") * F.lit(float(total["rows"])) / F.lit(total["weights"]) / F.col("n")).alias("rate"))


def poisson_mix(docs: DataFrame, power: float = 0.5, weights: dict[str, float] | None = None, seed: int = 42) -> DataFrame:
    """docs, each row as often as its Poisson count says, plus copy (from 0) and shuffle_key, by which partitions are dealt and sorted.

    Rows with one doc_id draw the same count. Null ids hash as the empty text; null texts are kept like any others. Columns of docs
    named copy or shuffle_key are replaced, all others pass, whatever their names. Sources beyond BROADCAST_SOURCES are joined on source and salt, so a
    source with a third of the rows is spread over SALTS partitions. An empty table gives an empty result.
    """
    docs = docs.drop("copy", "shuffle_key")
    kept = docs.columns
    source, sums, salt, salted, u, n = (free_name(docs, x) for x in ("_source", "_sums", "_salt", "_salted", "_u", "_copies"))
    rates = source_rates(docs, power, weights).select(F.col("source").alias(source), cumulative(F.col("rate")).alias(sums))
    name = F.coalesce(F.col("source").cast("string"), F.lit(""))
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        joined = docs.join(F.broadcast(rates), name == F.col(source))
    else:
        each = rates.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = docs.withColumn(salted, F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(each, (name == F.col(source)) & (F.col(salted) == F.col(salt)))
    counted = joined.withColumn(u, unit_hash(F.lit(seed), F.col("doc_id"))).withColumn(n, F.size(F.filter(sums, lambda c: c <= F.col(u))))
    copies = counted.filter(F.col(n) > 0).select(*[F.col(f"`{c}`") for c in kept], F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", seeded_hash(F.lit(seed), F.col("doc_id"), F.col("copy")))
    return keyed.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
