"""Weights, training and calibration: each step is one aggregation, or an iteration of small aggregations."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .evaluation import CLASSES
from .scoring import softmax

#: Edges of word-count buckets, and temperatures that are tried.
BUCKET_EDGES = (40, 60, 80, 120, 200)
TEMPERATURES = tuple(float(t) for t in np.exp(np.linspace(np.log(0.3), np.log(5.0), 200)))


def standard_stats(df: DataFrame, vector: str, dim: int, chunk: int = 44) -> tuple[list[float], list[float]]:
    """Mean and population deviation of each component; one below 1e-4 counts as 1. One aggregation a chunk, so that code stays small."""
    mean, sd = [], []
    for at in range(0, dim, chunk):
        span = range(at, min(dim, at + chunk))
        r = df.agg(*[F.avg(F.col(vector)[i].cast("double")).alias(f"m{i}") for i in span], *[F.stddev_pop(F.col(vector)[i].cast("double")).alias(f"s{i}") for i in span]).first()
        mean += [r[f"m{i}"] or 0.0 for i in span]
        sd += [r[f"s{i}"] if (r[f"s{i}"] or 0.0) >= 1e-4 else 1.0 for i in span]
    return mean, sd


def apply_standard(vector: Column, mean: list[float], sd: list[float]) -> Column:
    m, s = F.array(*map(F.lit, mean)), F.array(*map(F.lit, sd))
    return F.transform(vector, lambda x, i: (x - F.get(m, i)) / F.get(s, i))


def standardise(df: DataFrame, train: Column, vector: str, dim: int) -> tuple[DataFrame, tuple[list[float], list[float]]]:
    stats = standard_stats(df.filter(train), vector, dim)
    return df.withColumn(vector, apply_standard(F.col(vector), *stats)), stats


def word_bucket(n: Column) -> Column:
    """0..5 by the edges; -1 for unknown lengths (null or negative)."""
    out = F.lit(len(BUCKET_EDGES))
    for i, edge in reversed(list(enumerate(BUCKET_EDGES))):
        out = F.when(n < edge, i).otherwise(out)
    return F.when(n.isNull() | (n < 0), -1).otherwise(out)


def row_weights(df: DataFrame, modern_weight: float = 1.0, most: float = 10.0) -> DataFrame:
    """df (split, label, n_words, modern) with weight: within split and length bucket each class weighs the same, at most 10 a row.

    Sums have a row for each split, bucket and class, so they are broadcast after a check of their number.
    """
    raw = F.when(F.col("modern"), float(modern_weight)).otherwise(1.0)
    rows = df.withColumn("_bucket", word_bucket(F.col("n_words"))).withColumn("_raw", raw)
    per_class = rows.groupBy("split", "_bucket", "label").agg(F.count("*").alias("_n"), F.sum("_raw").alias("_sum"))
    per = per_class.withColumn("_all", F.sum("_n").over(W.partitionBy("split", "_bucket"))).select("split", "_bucket", "label", "_sum", "_all")
    small = F.broadcast(per) if per.limit(10_001).count() <= 10_000 else per
    return rows.join(small, ["split", "_bucket", "label"]).withColumn("weight", F.least(F.col("_raw") * F.col("_all") / (3 * F.col("_sum")), F.lit(most))).drop("_bucket", "_raw", "_sum", "_all")


def class_index(label: Column) -> Column:
    """The fixed place of a class."""
    return F.array_position(F.array(*map(F.lit, CLASSES)), label) - 1


def fit_logistic(df: DataFrame, vector: str, weight: str | None = None, reg: float = 1e-3, iterations: int = 50) -> LogisticRegressionModel:
    cols = [array_to_vector(F.col(vector).cast("array<double>")).alias("features"), class_index(F.col("label")).cast("double").alias("y")]
    data = df.select(*cols, *([F.col(weight).alias("w")] if weight else []))
    return LogisticRegression(labelCol="y", family="multinomial", regParam=reg, maxIter=iterations, **({"weightCol": "w"} if weight else {})).fit(data)


def fit_mlp(df: DataFrame, vector: str, dim: int, hidden: tuple[int, ...] = (224, 64), weight: str | None = None, seed: int = 1, iterations: int = 60) -> MultilayerPerceptronClassificationModel:
    """Weights are met by replicating rows: floor(weight) times, and once more if a hash says so (this estimator has no weights)."""
    rows = df.filter(F.col("label").isin(*CLASSES))
    if weight:
        extra = (F.pmod(F.xxhash64(F.lit(seed), vector), F.lit(1000)) / 1000 < F.col(weight) - F.floor(weight)).cast("int")
        rows = rows.withColumn("_n", (F.floor(weight) + extra).cast("int")).filter("_n > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    data = rows.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), class_index(F.col("label")).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, *hidden, len(CLASSES)], seed=seed, maxIter=iterations).fit(data)


def ensemble_mean(df: DataFrame, members: list[str]) -> DataFrame:
    """df with logits: the mean of the members' logit columns."""
    total = F.col(members[0])
    for m in members[1:]:
        total = F.zip_with(total, F.col(m), lambda a, b: a + b)
    return df.withColumn("logits", F.transform(total, lambda x: x / len(members)))


def mean_loss(temperature: float) -> Column:
    p = F.get(softmax(F.col("logits"), temperature), class_index(F.col("label")).cast("int"))
    return F.avg(-F.log(F.greatest(p, F.lit(1e-12))))


def fit_temperature(df: DataFrame, grid: tuple[float, ...] = TEMPERATURES) -> DataFrame:
    """temperature, loss: the best of the grid, from one aggregation with a mean for each."""
    losses = df.agg(F.array(*[F.struct(mean_loss(t).alias("loss"), F.lit(t).alias("temperature")) for t in grid]).alias("all"))
    return losses.select(F.array_min("all").alias("best")).select("best.temperature", "best.loss")


def fit_vector_scaling(df: DataFrame, iterations: int = 25) -> tuple[list[float], list[float]]:
    """Scale and shift of each class's logit that minimise cross-entropy: Newton's method, its sums by one aggregation a step."""
    at, best, step = np.array([1.0] * 3 + [0.0] * 3), None, np.zeros(6)
    for _ in range(iterations):
        a = [float(x) for x in at]
        z = F.array(*[F.col("logits")[i] * F.lit(a[i]) + F.lit(a[i + 3]) for i in range(3)])
        rows = df.select(class_index(F.col("label")).alias("y"), "logits", softmax(z).alias("p"))
        x = [F.col("logits")[i] for i in range(3)] + [F.lit(1.0)] * 3
        grad = [((F.col("p")[i % 3] - (F.col("y") == i % 3).cast("double")) * x[i]) for i in range(6)]
        hess = {(i, j): x[i] * x[j] * (F.col("p")[i % 3] * ((1.0 if i % 3 == j % 3 else 0.0) - F.col("p")[j % 3])) for i in range(6) for j in range(i, 6)}
        loss = -F.log(F.greatest(F.get("p", F.col("y").cast("int")), F.lit(1e-12)))
        r = rows.agg(F.avg(loss).alias("loss"), *[F.avg(g).alias(f"g{i}") for i, g in enumerate(grad)], *[F.avg(h).alias(f"h{i}_{j}") for (i, j), h in hess.items()]).first()
        if r["loss"] is None:
            break
        if best is not None and r["loss"] > best[0]:  # too far: half way back
            step = step / 2
            at = best[1] - step
            continue
        best = (r["loss"], at)
        g = np.array([r[f"g{i}"] for i in range(6)])
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(6)] for i in range(6)])
        step = np.linalg.lstsq(h + 1e-9 * np.eye(6), g, rcond=1e-9)[0]  # equal shifts change nothing: the shortest step
        at = at - step
        if np.abs(step).max() < 1e-7:
            break
    at = at if best is None else best[1]
    return [float(x) for x in at[:3]], [float(x) for x in at[3:]]


def add_feedback(corpus: DataFrame, feedback: DataFrame, dim: int, holdout: float = 0.2) -> DataFrame:
    """corpus with usable feedback: the first 80 % by time are train, the rest fresh; lengths are unknown (-1).

    The time at which the share is reached comes from counts by day, then from ranks within that day alone.
    """
    good = feedback.filter(F.col("label").isin(*CLASSES) & (F.size("vector") == dim)).withColumn("_day", F.to_date("created_at"))
    days = good.groupBy("_day").agg(F.count("*").alias("n")).orderBy("_day").collect()  # a row for each day
    want, seen, edge, before = (1 - holdout) * sum(r["n"] for r in days), 0, None, 0
    for r in days:
        if edge is None and seen + r["n"] > want:
            edge, before = r["_day"], seen
        seen += r["n"]
    rank = F.row_number().over(W.partitionBy("_day").orderBy("created_at", "id"))
    inside = good.filter(F.col("_day") == F.lit(edge)).withColumn("split", F.when(rank + before <= F.floor(F.lit(want)), "train").otherwise("fresh")) if edge else good.limit(0).withColumn("split", F.lit("train"))
    rest = good.filter(F.col("_day") != F.lit(edge)).withColumn("split", F.when(F.col("_day") < F.lit(edge), "train").otherwise("fresh")) if edge else inside
    added = inside.unionByName(rest) if edge else inside
    return corpus.unionByName(added.select("vector", "label", "split", F.lit(-1).alias("n_words")), allowMissingColumns=True)


def rule_weights(hits: DataFrame, coefficients: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """rule, weight, fire_rate_human, fire_rate_machine: hits (rule, label, value); coefficients: of human and of machine, by rule."""
    fired = F.avg(F.when(F.col("value") > 0.05, 1.0).otherwise(0.0))
    rates = hits.filter(F.col("label").isin("human", "machine")).groupBy("rule").pivot("label", ["human", "machine"]).agg(fired)
    weight = F.create_map(*[F.lit(x) for k, (h, m) in sorted((coefficients or {}).items()) for x in (k, m - h)])[F.col("rule")] if coefficients else F.lit(None).cast("double")
    return rates.select("rule", weight.alias("weight"), F.col("human").alias("fire_rate_human"), F.col("machine").alias("fire_rate_machine"))


def ablate(df: DataFrame, vector: str, places: list[int]) -> DataFrame:
    """df with these components set to 0."""
    gone = F.array(*map(F.lit, places))
    return df.withColumn(vector, F.transform(vector, lambda x, i: F.when(F.array_contains(gone, i), F.lit(0)).otherwise(x)))


#: Cells into which the range that holds a sought value is cut at once.
CELLS = 1024


def quantile(df: DataFrame, value: str, q: float) -> float | None:
    """The exact quantile, between neighbours by their distance, of value without nulls and NaN; None without rows.

    A histogram tells in which cell the sought place lies, and that cell's own range is cut again until it is one value: a few
    aggregations of CELLS rows at most, whatever the number of rows and of equal ones.
    """
    rows = df.select(F.col(value).cast("double").alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    whole = rows.agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).first()
    if not whole["n"]:
        return None
    place = q * (whole["n"] - 1)
    k, low, high, before = int(place), whole["low"], whole["high"], 0
    while low < high:
        # halves of the width, so that the widest range doesn't overflow
        cell = F.floor((F.col("x") / 2 - F.lit(low / 2)) / F.lit((high / 2 - low / 2) or 1.0) * CELLS)
        cells = rows.filter(F.col("x").between(low, high)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("cell").collect()
        if len(cells) == 1:  # neighbours too close to be cut
            values = rows.filter(F.col("x").between(low, high)).groupBy("x").count().orderBy("x").limit(CELLS).collect()
            cells = [{"n": r["count"], "low": r["x"], "high": r["x"]} for r in values]
        for c in cells:
            if before + c["n"] > k:
                low, high = c["low"], c["high"]
                break
            before += c["n"]
    if place == k:
        return low
    after = rows.agg(F.count_if(F.col("x") <= low).alias("upto"), F.min(F.when(F.col("x") > low, F.col("x"))).alias("next")).first()
    upper = low if after["upto"] > k + 1 else after["next"]
    return low + (place - k) * (upper - low)


def val_catch(df: DataFrame, q: float = 0.995) -> DataFrame:
    """caught: share of modern machine rows above the q quantile of human rows' score. df: label, modern, score."""
    bar = quantile(df.filter(F.col("label") == "human"), "score", q)
    return df.filter(F.col("modern") & (F.col("label") == "machine")).agg(F.avg((F.col("score") > F.lit(bar).cast("double")).cast("double")).alias("caught"), F.lit(bar).cast("double").alias("bar"))
