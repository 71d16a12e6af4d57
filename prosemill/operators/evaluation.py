"""Evaluation: everything is one aggregation, or a histogram and its suffix sums. Rows have label, pred, probs and weights as named."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .corpus import hash_order, stratified_cap

#: Classes in order, and the decisions.
CLASSES = ("human", "machine", "mixed")
DECISIONS = (*CLASSES, "unsure")


def rate(test: Column, among: Column | None = None) -> Column:
    """Mean of a condition among rows, null if there are none."""
    return F.avg(F.when(among, test.cast("double")) if among is not None else test.cast("double"))


def wilson_low(p: Column, n: Column, z: float = 1.96) -> Column:
    """Lower bound of a share p of n; 0 if n is 0."""
    centre, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return F.when(n > 0, (centre - spread) / (1 + z * z / n)).otherwise(0.0)


def confusion(df: DataFrame) -> DataFrame:
    return df.groupBy("label", "pred").agg(F.count("*").alias("n"))


def accuracy(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"), rate(F.col("label") == F.col("pred")).alias("accuracy"))


def macro_f1(df: DataFrame, where: Column | None = None) -> DataFrame:
    df = df if where is None else df.filter(where)
    parts = []
    for c in CLASSES:
        hit = F.count_if((F.col("label") == c) & (F.col("pred") == c))
        total = F.count_if(F.col("label") == c) + F.count_if(F.col("pred") == c)
        parts.append(2.0 * hit / F.greatest(total, F.lit(1)))
    return df.agg((sum(parts[1:], parts[0]) / len(CLASSES)).alias("macro_f1"))


def ece(df: DataFrame, p: str = "p", hit: Column | None = None, bins: int = 10) -> DataFrame:
    """Gap between confidence and accuracy over bins (b/10, (b+1)/10], weighted by rows."""
    hit = F.col("label") == F.col("pred") if hit is None else hit
    cells = df.groupBy(F.least(F.greatest(F.ceil(F.col(p) * bins) - 1, F.lit(0)), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("p"), F.avg(hit.cast("double")).alias("hit"))
    return cells.agg((F.sum(F.col("n") * F.abs(F.col("p") - F.col("hit"))) / F.sum("n")).alias("ece"))


def ece_decided(df: DataFrame, bins: int = 10) -> DataFrame:
    return ece(df.filter(F.col("decision") != "unsure"), "p", F.col("decision") == F.col("label"), bins)


def reliability(df: DataFrame, min_n: int = 5, bins: int = 10) -> DataFrame:
    """class, bin, n, predicted, observed: one against the rest, bins [b/10, (b+1)/10), the last closed; small cells left out."""
    long = df.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"p_{c}").alias("p")) for c in CLASSES])).alias("x")).select("label", "x.*")
    cell = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    out = long.groupBy("class", cell.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("predicted"), rate(F.col("label") == F.col("class")).alias("observed"))
    return out.filter(F.col("n") >= min_n)


def auroc(df: DataFrame, score: str, positive: Column) -> DataFrame:
    """Area under the ROC curve, ties counted half; null if a side is empty. Rows are counted by score before they are ordered."""
    cells = df.groupBy(F.col(score).alias("s")).agg(F.count_if(positive).cast("double").alias("pos"), F.count_if(~positive).cast("double").alias("neg"))
    # two levels, so that no task orders all scores: sums of 4096ths, then orders within each
    cells = cells.withColumn("b", F.floor(F.col("s") * 4096))
    earlier = W.orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    buckets = cells.groupBy("b").agg(F.sum("neg").alias("in_b")).select("b", F.coalesce(F.sum("in_b").over(earlier), F.lit(0.0)).alias("before"))
    within = F.coalesce(F.sum("neg").over(W.partitionBy("b").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    return cells.withColumn("within", within).join(buckets, "b").withColumn("below", F.col("before") + F.col("within")).agg(
        F.when((F.sum("pos") > 0) & (F.sum("neg") > 0), F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg"))).alias("auroc")
    )


def false_machine_rate(df: DataFrame) -> DataFrame:
    return df.agg(rate(F.col("pred") == "machine", F.col("label") == "human").alias("false_machine"), rate(F.col("pred") == "machine", F.col("label") == "machine").alias("machine_recall"))


def outcome_columns() -> list[Column]:
    d, l = F.col("decision"), F.col("label")  # noqa: E741
    called = d != "unsure"
    return [
        F.count("*").alias("n"), rate(~called).alias("unsure"), rate(d == l, called).alias("accuracy"), rate(d == "machine", l == "human").alias("human_called_machine"),
        rate(l == "mixed", d == "mixed").alias("mixed_precision"), rate(d == "machine", F.col("modern") & (l == "machine")).alias("modern_caught"), F.count_if(called).alias("calls"),
    ]


def outcome(df: DataFrame) -> DataFrame:
    """Rates of decided rows: label, decision, modern."""
    return df.agg(*outcome_columns())


def by_source(df: DataFrame) -> DataFrame:
    return df.groupBy("split", "source").agg(F.count("*").alias("n"), rate(F.col("label") == F.col("pred")).alias("accuracy"), *[rate(F.col("pred") == c).alias(f"share_{c}") for c in CLASSES])


def calls(df: DataFrame) -> DataFrame:
    return df.agg(*[rate(F.col("decision") == c).alias(f"called_{c}") for c in DECISIONS])


def abstention_curve(df: DataFrame, points: int = 34, first: float = 0.33, step: float = 0.02) -> DataFrame:
    """threshold, abstained, accuracy, called at each point: rows are counted by cell once, then summed from above."""
    place = F.least(F.floor((F.col("p") - first) / step + 1e-9), F.lit(points - 1)).cast("int")
    cells = df.groupBy(place.alias("i")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits"))
    grid = df.sparkSession.range(points).select(F.col("id").cast("int").alias("i"))
    total = cells.agg(F.sum("n").alias("all")).first()["all"] or 0
    filled = grid.join(cells, "i", "left").fillna(0)
    up = W.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = filled.select("i", F.sum("n").over(up).alias("called"), F.sum("hits").over(up).alias("hits"))
    return summed.select(F.round(first + step * F.col("i"), 2).alias("threshold"), F.when(F.lit(total) > 0, 1 - F.col("called") / F.lit(float(max(total, 1)))).alias("abstained"), F.when(F.col("called") > 0, F.col("hits") / F.col("called")).alias("accuracy"), "called")


def closest_point(curve: DataFrame, target: float) -> DataFrame:
    return curve.agg(F.min_by(F.struct("threshold", "abstained", "accuracy"), F.struct(F.abs(F.col("abstained") - target), F.col("threshold"))).alias("x")).select("x.*")


def decision_curves(df: DataFrame, grid: list[float]) -> DataFrame:
    """Outcome at each general threshold of the grid, the machine threshold being the larger of it and 0.9: one aggregation."""
    called = {t: F.col("p") >= F.when(F.col("pred") == "machine", max(t, 0.9)).otherwise(t) for t in grid}
    aggs = []
    for i, t in enumerate(grid):
        aggs += [rate(~called[t]).alias(f"u{i}"), rate(F.col("pred") == F.col("label"), called[t]).alias(f"a{i}"), rate((F.col("pred") == "machine") & called[t], F.col("label") == "human").alias(f"h{i}")]
    one = df.agg(*aggs)
    return one.select(F.inline(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"u{i}").alias("unsure"), F.col(f"a{i}").alias("accuracy"), F.col(f"h{i}").alias("human_called_machine")) for i, t in enumerate(grid)])))


def choose_thresholds(df: DataFrame, taus: list[float], machine_taus: list[float], accuracy: float = 0.96, cap: float = 0.001) -> DataFrame:
    """tau_machine, tau, unsure: of the pairs whose accuracy's lower bound and rate of humans called machine are good enough, the one that is least unsure.

    Rows are counted once by the last threshold they reach; pairs are summed from these counts.
    """
    reached = lambda grid: F.aggregate(F.array(*map(F.lit, grid)), F.lit(0), lambda n, t: n + F.when(F.col("p") >= t, 1).otherwise(0))
    machine = F.col("pred") == "machine"
    cells = df.groupBy(machine.alias("m"), F.when(machine, reached(machine_taus)).otherwise(reached(taus)).alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("label") == F.col("pred")).alias("hits"), F.count_if(F.col("label") == "human").alias("humans"))
    counts = {(r["m"], r["k"]): r for r in cells.collect()}  # at most a row for each threshold
    total, humans = sum(r["n"] for r in counts.values()), sum(r["humans"] for r in counts.values())
    above = lambda m, i, what: sum(r[what] for (a, k), r in counts.items() if a == m and k > i)
    best = None
    for j, tm in enumerate(machine_taus):
        for i, t in enumerate(taus):
            called, hits = above(True, j, "n") + above(False, i, "n"), above(True, j, "hits") + above(False, i, "hits")
            p = hits / called if called else 0.0
            low = ((p + 3.8416 / (2 * called)) - 1.96 * np.sqrt(p * (1 - p) / called + 3.8416 / (4 * called * called))) / (1 + 3.8416 / called) if called else 0.0
            if low >= accuracy and (not humans or above(True, j, "humans") / humans <= cap):
                unsure = 1 - called / total
                if best is None or unsure < best[2]:
                    best = (tm, t, float(unsure))
                break
    return df.sparkSession.createDataFrame([best] if best else [], "tau_machine double, tau double, unsure double")


def retrain_gate(df: DataFrame, least: int = 50) -> DataFrame:
    """Whether a candidate may replace a model on fresh rows: label, p_old, pred_old, p_new, pred_new."""
    out = {}
    for side in ("old", "new"):
        part = df.select("label", F.col(f"pred_{side}").alias("pred"), F.col(f"p_{side}").alias("p"))
        out[side] = ece(part).select(F.col("ece").alias(f"ece_{side}"))
    rates = df.agg(F.count("*").alias("n"), *[rate(F.col(f"pred_{s}") == "machine", F.col("label") == "human").alias(f"hcm_{s}") for s in ("old", "new")])
    both = rates.join(F.broadcast(out["old"]), F.lit(True)).join(F.broadcast(out["new"]), F.lit(True))
    ok = (F.col("n") >= least) & (F.col("ece_new") < F.col("ece_old")) & (F.coalesce(F.col("hcm_new"), F.lit(0.0)) <= F.coalesce(F.col("hcm_old"), F.lit(0.0)))
    return both.withColumn("passes", ok)


def compare_models(df: DataFrame) -> DataFrame:
    """metric, old, new, change, worse: rates of two models' decisions on the same rows; label, decision_old, decision_new."""
    metrics = {
        "unsure": (lambda d: rate(d == "unsure"), 1), "accuracy": (lambda d: rate(d == F.col("label"), d != "unsure"), -1),
        "human_called_machine": (lambda d: rate(d == "machine", F.col("label") == "human"), 1), "human_recall": (lambda d: rate(d == "human", F.col("label") == "human"), -1),
        "machine_recall": (lambda d: rate(d == "machine", F.col("label") == "machine"), -1), "mixed_recall": (lambda d: rate(d == "mixed", F.col("label") == "mixed"), -1),
        "machine_called_human": (lambda d: rate(d == "human", F.col("label") == "machine"), 1), "mixed_precision": (lambda d: rate(F.col("label") == "mixed", d == "mixed"), -1),
    }
    one = df.agg(*[f(F.col(f"decision_{s}")).alias(f"{m}_{s}") for m, (f, _) in metrics.items() for s in ("old", "new")])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_old").alias("old"), F.col(f"{m}_new").alias("new"), F.lit(sign).alias("sign")) for m, (_, sign) in metrics.items()])))
    return rows.select("metric", "old", "new", (F.col("new") - F.col("old")).alias("change"), (F.col("sign") * (F.col("new") - F.col("old")) > 0).alias("worse"))


def summarise_systems(long: DataFrame) -> DataFrame:
    """Rates by system, overall and by each of adversarial, label and site: system, adversarial, label, site, decision, p."""
    grouped = long.groupingSets([["system"], ["system", "adversarial"], ["system", "label_group"], ["system", "site"]], "system", "adversarial", "label_group", "site")
    return grouped.agg(F.count("*").alias("n"), rate(F.col("decision") == "unsure").alias("unsure"), rate(F.col("decision") == F.col("label"), F.col("decision") != "unsure").alias("accuracy"), *[rate(F.col("decision") == c).alias(f"share_{c}") for c in DECISIONS])


def bootstrap_gap(df: DataFrame, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """gap, low, high: difference of two systems' accuracy on calls and its 95% interval. called_a, hit_a, called_b, hit_b: booleans.

    Only the counts of the 16 kinds of rows matter, so resamples are multinomial draws from them.
    """
    names = ("called_a", "hit_a", "called_b", "hit_b")
    cells = df.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names).collect()
    flags = np.array([[bool(r[c]) for c in names] for r in cells], float).reshape(-1, 4)
    n = np.array([r["n"] for r in cells], float)

    def gap(weight: np.ndarray) -> np.ndarray:
        share = lambda called, hit: weight @ (called * hit) / np.maximum(weight @ called, 1)
        return share(flags[:, 0], flags[:, 1]) - share(flags[:, 2], flags[:, 3])

    if not len(n):
        return df.sparkSession.createDataFrame([], "gap double, low double, high double")
    drawn = gap(np.random.default_rng(seed).multinomial(int(n.sum()), n / n.sum(), size=rounds).astype(float))
    return df.sparkSession.createDataFrame([(float(gap(n[None])[0]), float(np.quantile(drawn, 0.025)), float(np.quantile(drawn, 0.975)))], "gap double, low double, high double")


def index_percentiles(df: DataFrame, column: str, by: list[str], qs: tuple[float, ...] = (0.5, 0.9), buckets: int = 1024) -> DataFrame:
    """by, p50, p90: the value at place floor(n q) of the ordered rows that have one, not interpolated.

    Rows are counted by buckets of equal width between a group's ends; only the bucket that holds the place is looked into, by counts of
    its distinct values. So no task gets a whole group.
    """
    rows = df.filter(F.col(column).isNotNull()).select(*[F.col(c).alias(f"_{i}") for i, c in enumerate(by)], F.col(column).alias("_v"))
    keys = [f"_{i}" for i in range(len(by))]

    def joined(a: DataFrame, b: DataFrame, *more: str) -> DataFrame:
        """a with b's columns, by keys, which may be null, and more."""
        other = b.select(*[F.col(c).alias(f"_b{c}" if c in (*keys, *more) else c) for c in b.columns])
        same = [F.col(k).eqNullSafe(F.col(f"_b{k}")) for k in keys] + [F.col(k) == F.col(f"_b{k}") for k in more]
        return a.join(other, same).drop(*[f"_b{k}" for k in (*keys, *more)])

    ends = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").cast("double").alias("_low"), F.max("_v").cast("double").alias("_high"))
    width = (F.col("_high") - F.col("_low")) / buckets
    cell = F.when(width > 0, F.least(F.floor((F.col("_v") - F.col("_low")) / width), F.lit(buckets - 1))).otherwise(0)
    placed = joined(rows, ends).select(*keys, "_v", "_n", cell.alias("_cell"))
    each = F.explode(F.array(*[F.struct(F.lit(f"p{round(q * 100)}").alias("name"), F.lit(float(q)).alias("q")) for q in qs])).alias("_q")
    place = F.least(F.floor(F.col("_n") * F.col("_q.q")) + 1, F.col("_n"))

    def holding(counts: DataFrame, order: str, group: list[str]) -> DataFrame:
        """The rows of counts (group, order, _m) that hold the place _k, and _k within them."""
        upto = F.sum("_m").over(W.partitionBy(*group).orderBy(order))
        return counts.withColumn("_upto", upto).filter((F.col("_upto") >= F.col("_k")) & (F.col("_upto") - F.col("_m") < F.col("_k"))).withColumn("_k", F.col("_k") - F.col("_upto") + F.col("_m")).drop("_upto", "_m")

    cells = placed.groupBy(*keys, "_n", "_cell").agg(F.count("*").alias("_m")).select("*", each).select(*keys, "_cell", "_m", F.col("_q.name").alias("_name"), place.alias("_k"))
    found = holding(cells, "_cell", [*keys, "_name"])
    inside = joined(placed.drop("_n"), found, "_cell").groupBy(*keys, "_name", "_k", "_v").agg(F.count("*").alias("_m"))
    values = holding(inside, "_v", [*keys, "_name"])
    return values.groupBy(*[F.col(k).alias(c) for k, c in zip(keys, by)]).agg(*[F.max(F.when(F.col("_name") == f"p{round(q * 100)}", F.col("_v"))).alias(f"p{round(q * 100)}") for q in qs])


def max_abs_delta(a: DataFrame, b: DataFrame, key: str, column: str) -> DataFrame:
    """The largest difference of two array columns over common keys."""
    both = a.select(key, F.col(column).alias("_a")).join(b.select(key, F.col(column).alias("_b")), key)
    return both.agg(F.max(F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))).alias("delta"))


def stratified_study_sample(df: DataFrame, shares: dict[str, float], n: int, key: str, stratum: str = "stratum") -> DataFrame:
    """By stratum the first round(share x n) rows in hash order."""
    allowed = F.create_map(*[F.lit(x) for k, v in sorted(shares.items()) for x in (k, round(v * n))])
    some = stratified_cap(df.filter(F.col(stratum).isin(*shares)), [stratum], max(round(v * n) for v in shares.values()), key, "study")
    ranked = some.withColumn("_rank", F.row_number().over(W.partitionBy(stratum).orderBy(hash_order(key, salt="study"), key)))
    return ranked.filter(F.col("_rank") <= allowed[F.col(stratum)]).drop("_rank")
