"""Reader feedback, weekly calibration and usage budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import CLASSES, DECISIONS
from .skew import running_totals

#: Site classes, and fields of a correction.
SITES = ("social", "forum", "reference", "docs", "shop", "news", "blog", "other")
VERSION = r"^[0-9A-Za-z][0-9A-Za-z.+-]{0,31}$"
BINS = 10


def correction_reason(dim: int) -> Column:
    """Why a correction is refused, or null: vector, predicted, label, p, site_class, spec, model_version."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        F.when(F.col("vector").isNull() | (F.size("vector") != dim) | ~finite, "vector")
        .when(F.col("predicted").isNull() | ~F.col("predicted").isin(*DECISIONS), "predicted").when(F.col("label").isNull() | ~F.col("label").isin(*DECISIONS), "label")
        .when(F.col("p").isNull() | F.isnan("p") | ~F.col("p").between(0, 1), "p").when(F.col("site_class").isNull() | ~F.col("site_class").isin(*SITES), "site_class")
        .when(F.col("spec").isNull() | (F.col("spec") != F.floor("spec")), "spec").when(F.col("model_version").isNull() | ~F.col("model_version").rlike(VERSION), "model_version")
    )


def valid_correction(df: DataFrame, dim: int) -> DataFrame:
    """df with reason: null for a good row, else the first field that is wrong."""
    return df.withColumn("reason", correction_reason(dim))


def valid_batches(df: DataFrame, most: int = 50) -> DataFrame:
    """batch, n, accepted: a batch of 1 to most items with a UUID is accepted if all its items are. df: batch, install_id, reason."""
    uuid = F.col("install_id").rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return df.groupBy("batch").agg(F.count("*").alias("n"), (F.count("*").between(1, most) & F.bool_and(F.coalesce(uuid, F.lit(False)) & F.col("reason").isNull())).alias("accepted"))


def reliability_by_decision(df: DataFrame) -> DataFrame:
    """predicted, bin, n, mean_p, observed over decided rows: bin = min(9, floor(10 p))."""
    cell = F.least(F.lit(BINS - 1), F.floor(F.col("p") * BINS)).cast("int")
    return df.filter(F.col("predicted").isin(*CLASSES)).groupBy("predicted", cell.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("observed"))


def feedback_ece(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("observed"))) / F.sum("n")).alias("ece"))


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def unsure_by_week(df: DataFrame) -> DataFrame:
    return df.groupBy(iso_week(F.col("created_at")).alias("week")).agg(F.count("*").alias("n"), F.avg((F.col("predicted") == "unsure").cast("double")).alias("unsure_rate"))


def calibration_snapshot(df: DataFrame, version: str) -> DataFrame:
    """One row for a model version: n, ece, bins (class to cells), unsure_by_week."""
    rows = df.filter(F.col("model_version") == version)
    cells = reliability_by_decision(rows)
    by_class = cells.groupBy("predicted").agg(F.array_sort(F.collect_list(F.struct("bin", "mean_p", "observed", "n"))).alias("cells"))
    bins = by_class.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("predicted", "cells")))).alias("bins"))
    weeks = unsure_by_week(rows).agg(F.array_sort(F.collect_list(F.struct("week", "n", "unsure_rate"))).alias("unsure_by_week"))
    one = rows.agg(F.count("*").alias("n"))
    for part in (feedback_ece(cells), bins, weeks):  # a row each
        one = one.join(F.broadcast(part), F.lit(True))
    return one.withColumn("model_version", F.lit(version))


def time_slices(df: DataFrame, ts: str, widths: tuple[int, ...] = (3600, 1)) -> list[Column]:
    """Slices of these widths in seconds, coarse to fine; a time that is a number counts as seconds."""
    seconds = F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000 if df.schema[ts].dataType.typeName().startswith(("timestamp", "date")) else F.col(ts)
    return [F.floor(seconds / w).cast("long") for w in widths]


def spend(calls: DataFrame, limits: DataFrame) -> DataFrame:
    """call_id, scope, key, period, running, within, allowed: a call passes if each budget it draws on stays within its limit.

    calls: call_id, ts, scope, key, period, amount; refused calls still count. limits: scope, limit; a scope without one has no bound.
    Totals run over hours, then seconds, and only the calls of one second are ordered, so that a budget which many draw on spreads.
    """
    few = limits.limit(10_001).count() <= 10_000
    run = running_totals(calls, ["scope", "key", "period"], ["ts", "call_id"], "amount", "running", time_slices(calls, "ts"))
    run = run.join(F.broadcast(limits) if few else limits, "scope", "left").withColumn("within", F.coalesce(F.col("running") <= F.col("limit"), F.lit(True)))
    verdict = run.groupBy("call_id").agg(F.bool_and("within").alias("allowed"))
    return run.join(verdict, "call_id").select("call_id", "scope", "key", "period", "running", "within", "allowed")


def merge_usage(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("scope", "key", "period").agg(F.sum("n").alias("n"))


def hash_key(forwarded: Column, salt: str) -> Column:
    """First 32 digits of the salted SHA-256 of the first forwarded address."""
    first = F.coalesce(F.nullif(F.trim(F.split(forwarded, ",")[0]), F.lit("")), F.lit("unknown"))
    return F.substring(F.sha2(F.concat(F.lit(salt), first), 256), 1, 32)
