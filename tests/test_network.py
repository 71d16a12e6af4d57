"""Networks: gradients against differences, sums against one batch, choice, merging, rounding, and the way to score_mlp."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.operators import network, scoring, training
from prosemill.operators.evaluation import CLASSES


def some_rows(spark, n, seed):
    """Classes by the signs of two of six components, which no linear model tells."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 6)) * [1, 1, 3, 0.1, 1, 1] + [0, 0, 5, 0, 0, 0]
    y = np.where(x[:, 0] * x[:, 1] > 0, 0, np.where(x[:, 4] > 0, 1, 2))
    y = np.where(r.random(n) < 0.1, r.integers(0, 3, n), y)  # some labels are wrong
    rows = [(i, [float(v) for v in x[i]], CLASSES[y[i]], ("train", "train", "val", "test")[i % 4], int(r.integers(20, 300)), bool(r.random() < 0.4)) for i in range(n)]
    rows += [(-1, None, "human", "train", 50, False), (-2, [0.0] * 6, "other", "train", 50, True), (-3, [0.0] * 6, None, "val", 50, None), (-4, [1.0] * 6, "human", "adv", 50, None)]
    return spark.createDataFrame(rows, "id int, vector array<float>, label string, split string, n_words int, modern boolean").repartition(3)


def test_gradients():
    r = np.random.default_rng(1)
    sizes = (4, 5, 3, 3)
    layers = network.initial(sizes, 1)
    x, y, w = r.normal(size=(9, 4)), r.integers(0, 3, 9), r.random(9)
    at = network.flat(layers)
    got = network.gradient(layers, x, y, w)
    for i in range(0, len(at), 3):
        step = np.zeros(len(at))
        step[i] = 1e-6
        up, down = (network.gradient(network.shaped(at + d, sizes), x, y, w)[0] for d in (step, -step))
        assert got[1 + i] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)


def test_sums_do_not_depend_on_partitions(spark):
    rows = some_rows(spark, 200, 2).filter("id >= 0").select("vector", training.class_index(F.col("label")).cast("int").alias("y"), F.array(F.lit(1.0), F.rand(3)).alias("weights")).cache()
    sizes, stats = (6, 4, 3), (np.zeros(6), np.ones(6))
    values = np.stack([network.flat(network.initial(sizes, s)) for s in (1, 2)])
    one = network.gradient_sums(rows.coalesce(1), values, sizes, [0, 1], stats)
    many = network.gradient_sums(rows.repartition(90), values, sizes, [0, 1], stats)
    assert np.allclose(one, many) and one.shape == (2, values.shape[1] + 1)
    local = rows.toPandas()
    assert np.allclose(one[1], network.gradient(network.shaped(values[1], sizes), np.stack(local["vector"]), local["y"].to_numpy(), np.stack(local["weights"])[:, 1]))


def test_merged_network_is_the_mean():
    r = np.random.default_rng(3)
    members = [network.initial((5, 7, 4, 3), s) for s in range(3)]
    x = r.normal(size=(8, 5))
    assert np.allclose(network.forward(network.merged(members), x), np.mean([network.forward(m, x) for m in members], axis=0))
    assert np.allclose(network.forward(network.scaled(members[0], [1, 2, 3], [0, 1, 0]), x), network.forward(members[0], x) * [1, 2, 3] + [0, 1, 0])


def test_fitted_network_scores(spark):
    """From rows to score_mlp: better than the linear model on rows kept out, rounding moves no probability by more than 0.02."""
    df = some_rows(spark, 1600, 4).cache()
    fitted = network.fit_network(df, "vector", 6, hidden=(24, 8), modern_weights=(1.0, 2.0), seeds=(0, 1, 2), members=2, steps=80, rate=0.05)
    test = df.filter("split = 'test'")
    right = lambda scored: scored.agg(F.avg((F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("logits", F.array_max("logits")).cast("int")) == F.col("label")).cast("double"))).first()[0]
    own = right(scoring.score_mlp(test, fitted.network))
    linear = training.fit_logistic(df.filter("split = 'train' and label in ('human', 'machine', 'mixed') and vector is not null"), "vector")
    scored = linear.transform(test.select("label", training.array_to_vector(F.col("vector").cast("array<double>")).alias("features")))
    straight = scored.agg(F.avg((F.col("prediction") == training.class_index(F.col("label"))).cast("double"))).first()[0]
    assert own > 0.8 > straight + 0.2
    x = np.stack([r["vector"] for r in test.collect()]).astype(float)
    soft = lambda z: np.exp(z - z.max(1, keepdims=True)) / np.exp(z - z.max(1, keepdims=True)).sum(1, keepdims=True)
    exact = soft(network.forward(fitted.layers, (x - fitted.network.mean) / fitted.network.sd))
    assert np.abs(exact - soft(fitted.network.forward(x)[-1])).max() <= 0.02
    assert all(layer.weights.dtype == np.int8 for layer in fitted.network.layers) and fitted.network.layers[0].weights.shape == (48, 6)
    assert 0 < network.moved(test, fitted) <= 0.02 and 0 < fitted.report["moved"] <= 0.02
    assert len(fitted.report["members"]) == 2 and fitted.report["tried"] == 6
    assert fitted.report["members"][0]["caught"] >= fitted.report["members"][1]["caught"]


def test_nothing_to_learn_from(spark):
    with pytest.raises(ValueError):
        network.fit_network(some_rows(spark, 4, 5).filter("id < 0"), "vector", 6, hidden=(4,), steps=2)
