"""Training of the ReLU networks that scoring.score_mlp runs: weighted gradients summed over partitions, choice among candidates, rounding.

All candidates learn together: a step sends their weights to every task, each task adds up its rows' gradients for all of them, the sums
of tasks are added in groups and then on the driver, whose share is one row of fixed size for each group. Steps are Adam's, on sums
over all training rows, so results don't depend on partitions but for the order of additions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import training
from .evaluation import CLASSES
from .scoring import Layer, Network, score_mlp, softmax

#: Hidden units, weights of modern rows that are tried, members of an ensemble, and the share of false alarms at which they are compared.
HIDDEN, MODERN_WEIGHTS, MEMBERS, FALSE_ALARMS = (224, 64), (1.0, 2.0, 4.0), 3, 0.005
#: Rows whose gradients a task computes at once.
BATCH = 2048

Layers = list[tuple[np.ndarray, np.ndarray]]


def initial(sizes: tuple[int, ...], seed: int) -> Layers:
    r = np.random.default_rng(seed)
    return [(r.normal(0, math.sqrt(2 / a), (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]


def flat(layers: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for pair in layers for x in pair])


def shaped(values: np.ndarray, sizes: tuple[int, ...]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes, sizes[1:]):
        out.append((values[at : at + a * b].reshape(b, a), values[at + a * b : at + a * b + b]))
        at += a * b + b
    return out


def gradient(layers: Layers, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted sums of cross-entropy and of its gradient by all weights, in flat order after the loss."""
    hidden = [x]
    for i, (weights, bias) in enumerate(layers):
        z = hidden[-1] @ weights.T + bias
        hidden.append(np.maximum(z, 0) if i + 1 < len(layers) else z)
    z = hidden.pop()
    e = np.exp(z - z.max(axis=1, keepdims=True))
    p = e / e.sum(axis=1, keepdims=True)
    rows = np.arange(len(y))
    loss = -(w * np.log(np.maximum(p[rows, y], 1e-12))).sum()
    p[rows, y] -= 1
    back, out = p * w[:, None], []
    for i in range(len(layers) - 1, -1, -1):
        out.append((back.T @ hidden[i], back.sum(axis=0)))
        if i:
            back = (back @ layers[i][0]) * (hidden[i] > 0)
    return np.concatenate(([loss], flat(out[::-1])))


def gradient_sums(rows: DataFrame, values: np.ndarray, sizes: tuple[int, ...], weights: list[int], stats: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """[candidates, loss and gradient]: sums over all rows (vector, y, weights array). weights: each candidate's place in that array."""
    shared = rows.sparkSession.sparkContext.broadcast((values, weights, stats))
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, places, (mean, sd) = shared.value
        total = np.zeros((len(own), own.shape[1] + 1))
        networks = [shaped(v, sizes) for v in own]
        for b in batches:
            for at in range(0, len(b), BATCH):
                part = b.iloc[at : at + BATCH]
                x, y, w = (np.stack(part["vector"].to_numpy()) - mean) / sd, part["y"].to_numpy(np.int64), np.stack(part["weights"].to_numpy())
                for c, layers in enumerate(networks):
                    total[c] += gradient(layers, x, y, w[:, places[c]])
        yield pd.DataFrame({"part": [TaskContext.get().partitionId() % groups], "sums": [total.tobytes()]})

    def add(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": [key[0]], "sums": [sum(np.frombuffer(x) for x in part["sums"]).tobytes()]})

    schema = "part int, sums binary"
    sums = rows.mapInPandas(run, schema)
    if groups > 8:  # few tasks' sums go to the driver as they are
        sums = sums.groupBy("part").applyInPandas(add, schema)
    out = sum((np.frombuffer(r["sums"]) for r in sums.toLocalIterator()), np.zeros(len(values) * (values.shape[1] + 1)))
    shared.unpersist()
    return out.reshape(len(values), -1)


def train(rows: DataFrame, sizes: tuple[int, ...], seeds: list[int], weights: list[int], stats: tuple[np.ndarray, np.ndarray], steps: int = 120, rate: float = 0.02, decay: float = 1e-4) -> list[Layers]:
    """The candidates (a seed and a place among the rows' weights each) after so many of Adam's steps, whose rate falls to a tenth."""
    values = np.stack([flat(initial(sizes, s)) for s in seeds])
    held = rows.agg(F.array(*[F.sum(F.col("weights")[i]) for i in range(max(weights) + 1)]).alias("w")).first()["w"]
    total = np.array([held[w] or 0.0 for w in weights])[:, None]
    if not total.all():
        raise ValueError("no training rows have weight")
    first, second = np.zeros_like(values), np.zeros_like(values)
    for step in range(1, steps + 1):
        g = gradient_sums(rows, values, sizes, weights, stats)[:, 1:] / total + decay * values
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        now = rate * (1 - 0.9 * step / steps)
        values = values - now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return [shaped(v, sizes) for v in values]


def rounded(layers: Layers, mean: np.ndarray, sd: np.ndarray) -> Network:
    """The network with whole weights of 8 bits and a scale for each output, as score_mlp takes it."""
    return Network(np.asarray(mean, np.float32), np.asarray(sd, np.float32), [Layer.rounded(w, b) for w, b in layers])


def scaled(layers: Layers, scale: list[float], shift: list[float]) -> Layers:
    """With each class's logit scaled and shifted."""
    w, b = layers[-1]
    return [*layers[:-1], (w * np.array(scale)[:, None], b * np.array(scale) + np.array(shift))]


def merged(members: list[Layers]) -> Layers:
    """One network whose logits are the members' means: their units stand side by side."""
    out = []
    for i, parts in enumerate(zip(*members)):
        ws, bs = [w for w, _ in parts], [b for _, b in parts]
        if i == 0:
            out.append((np.vstack(ws), np.concatenate(bs)))
        elif i + 1 < len(members[0]):
            block = np.zeros((sum(w.shape[0] for w in ws), sum(w.shape[1] for w in ws)))
            r = c = 0
            for w in ws:
                block[r : r + w.shape[0], c : c + w.shape[1]] = w
                r, c = r + w.shape[0], c + w.shape[1]
            out.append((block, np.concatenate(bs)))
        else:
            out.append((np.hstack(ws) / len(members), np.mean(bs, axis=0)))
    return out


def forward(layers: Layers, x: np.ndarray) -> np.ndarray:
    for i, (w, b) in enumerate(layers):
        x = x @ w.T + b
        x = np.maximum(x, 0) if i + 1 < len(layers) else x
    return x


def balanced_f1(df: DataFrame, candidates: list[Layers], stats: tuple[np.ndarray, np.ndarray]) -> list[float]:
    """Of each candidate the mean of macro-F1 on modern and on other rows (vector, y, modern): confusion counts of all in one pass.

    A kind without rows counts as the other one does; without any rows it is 0.
    """
    shared = df.sparkSession.sparkContext.broadcast((candidates, stats))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, (mean, sd) = shared.value
        counts = np.zeros((len(own), 2, len(CLASSES), len(CLASSES)), np.int64)
        for b in batches:
            if len(b):
                x, y, m = (np.stack(b["vector"].to_numpy()) - mean) / sd, b["y"].to_numpy(np.int64), b["modern"].to_numpy(bool).astype(int)
                for c, layers in enumerate(own):
                    np.add.at(counts[c], (m, y, forward(layers, x).argmax(axis=1)), 1)
        c, m, y, p = np.nonzero(counts)
        yield pd.DataFrame({"c": c, "m": m, "y": y, "p": p, "n": counts[c, m, y, p]})

    total = np.zeros((len(candidates), 2, len(CLASSES), len(CLASSES)))
    for r in df.mapInPandas(run, "c long, m long, y long, p long, n long").groupBy("c", "m", "y", "p").agg(F.sum("n").alias("n")).toLocalIterator():
        total[r["c"], r["m"], r["y"], r["p"]] = r["n"]
    hit = np.einsum("cmii->cmi", total)
    f1 = 2 * hit / np.maximum(total.sum(axis=3) + total.sum(axis=2), 1)
    return [float(np.mean([f1[c, m].mean() for m in (0, 1) if total[c, m].any()] or [0.0])) for c in range(len(candidates))]


@dataclass
class Fitted:
    """network: rounded, for score_mlp. layers: the same before rounding, for standardised vectors. report: how it was chosen."""

    network: Network
    layers: Layers
    report: dict = field(default_factory=dict)


def calibrated(df: DataFrame, layers: Layers, stats: tuple[np.ndarray, np.ndarray], vector: str) -> Layers:
    """With the scale and shift of each logit that fit df's labels best."""
    return scaled(layers, *training.fit_vector_scaling(score_mlp(df, rounded(layers, *stats), vector)))


def fit_network(
    df: DataFrame, vector: str, dim: int, hidden: tuple[int, ...] = HIDDEN, modern_weights: tuple[float, ...] = MODERN_WEIGHTS, seeds: tuple[int, ...] = (0, 1, 2),
    members: int = MEMBERS, steps: int = 120, rate: float = 0.02,
) -> Fitted:
    """A network from df (vector, label, split, n_words, modern), learnt on the split train and chosen on val.

    Rows weigh as in row_weights, in which a modern row counts modern_weight times. For each seed the weight with the best balanced_f1 on
    val is kept; of the seeds those that catch most modern machine text at FALSE_ALARMS are calibrated, merged and calibrated again, up
    to members. Labels beyond the classes, null vectors and other splits take no part. Without rows to learn from it raises ValueError.
    """
    known = df.filter(F.col("label").isin(*CLASSES) & F.col(vector).isNotNull() & F.col("split").isin("train", "val")).withColumn("modern", F.coalesce("modern", F.lit(False)))
    rows = known.select(F.col(vector).alias("vector"), "label", "split", "n_words", "modern")
    for i, w in enumerate(modern_weights):
        rows = training.row_weights(rows, w).withColumnRenamed("weight", f"weight_{i}")
    each = rows.select("vector", "label", "split", "modern", training.class_index(F.col("label")).cast("int").alias("y"), F.array(*[f"weight_{i}" for i in range(len(modern_weights))]).alias("weights")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        learn, val = each.filter("split = 'train'"), each.filter("split = 'val'")
        stats = tuple(np.array(x) for x in training.standard_stats(learn, "vector", dim))
        sizes = (dim, *hidden, len(CLASSES))
        tried = [(s, i) for s in seeds for i in range(len(modern_weights))]
        found = train(learn, sizes, [s for s, _ in tried], [i for _, i in tried], stats, steps, rate)
        f1 = balanced_f1(val, found, stats)
        best = [max((c for c, (s, _) in enumerate(tried) if s == seed), key=lambda c: f1[c]) for seed in dict.fromkeys(seeds)]
        if val.isEmpty():
            chosen, layers = best[:members], merged([found[c] for c in best[:members]])
            caught = {}
        else:
            own = {c: calibrated(val, found[c], stats, "vector") for c in best}
            caught = {c: catch(val, rounded(own[c], *stats)) for c in best}
            chosen = sorted(best, key=lambda c: -caught[c])[:members]
            layers = calibrated(val, merged([own[c] for c in chosen]), stats, "vector")
        report = {"members": [{"seed": tried[c][0], "modern_weight": modern_weights[tried[c][1]], "balanced_f1": f1[c], "caught": caught.get(c)} for c in chosen], "tried": len(tried)}
        fitted = Fitted(rounded(layers, *stats), layers, report)
        return Fitted(fitted.network, layers, report | {"moved": moved(val, fitted)})
    finally:
        each.unpersist()


def moved(df: DataFrame, fitted: Fitted, vector: str = "vector") -> float:
    """How far rounding moves any probability of a row at most."""
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    soft = lambda z: (e := np.exp(z - z.max(axis=1, keepdims=True))) / e.sum(axis=1, keepdims=True)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for b in batches:
            if len(b):
                x = np.stack(b["x"].to_numpy()).astype(float)
                exact = soft(forward(own.layers, (x - own.network.mean) / own.network.sd))
                yield pd.DataFrame({"by": [float(np.abs(exact - soft(own.network.forward(x)[-1])).max())]})

    return df.select(F.col(vector).alias("x")).mapInPandas(run, "by double").agg(F.max("by")).first()[0] or 0.0


def catch(df: DataFrame, network: Network, false_alarms: float = FALSE_ALARMS) -> float:
    """Share of modern machine rows beyond the score that this share of human rows passes; 0 where it can't be told."""
    scored = score_mlp(df, network).withColumn("score", softmax(F.col("logits"))[CLASSES.index("machine")])
    return training.val_catch(scored, 1 - false_alarms).first()["caught"] or 0.0
