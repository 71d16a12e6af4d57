"""Scoring, decisions, explanations and roll-ups."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .evaluation import CLASSES


@dataclass
class Layer:
    """int8 weights [outputs, inputs] with a scale and a bias for each output."""

    weights: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    @staticmethod
    def rounded(weights: np.ndarray, bias: np.ndarray) -> Layer:
        scale = np.maximum(np.abs(weights).max(axis=1), 1e-12) / 127
        return Layer(np.rint(weights / scale[:, None]).astype(np.int8), scale.astype(np.float32), bias.astype(np.float32))


@dataclass
class Network:
    mean: np.ndarray
    sd: np.ndarray
    layers: list[Layer]
    spec: int = 1

    @staticmethod
    def random(sizes: tuple[int, ...], seed: int = 1) -> Network:
        """An untrained network of this shape, for tests of the scoring path."""
        r = np.random.default_rng(seed)
        layers = [Layer.rounded(r.normal(0, (2 / a) ** 0.5, (b, a)), np.zeros(b)) for a, b in zip(sizes, sizes[1:])]
        return Network(np.zeros(sizes[0]), np.ones(sizes[0]), layers)

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """Activations before each non-linearity, the last being the logits."""
        out, h = [], ((x - self.mean) / self.sd).astype(np.float32)
        for i, layer in enumerate(self.layers):
            z = h @ layer.weights.T.astype(np.float32) * layer.scale + layer.bias
            out.append(z)
            h = np.maximum(z, 0) if i + 1 < len(self.layers) else z
        return out

    def gradient(self, x: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of the target class's logit less the mean logit, by the standardised inputs."""
        zs = self.forward(x)
        g = np.full((len(x), len(CLASSES)), -1 / len(CLASSES), np.float32)
        g[np.arange(len(x)), target] += 1
        for i in range(len(self.layers) - 1, -1, -1):
            layer = self.layers[i]
            g = (g * layer.scale) @ layer.weights.astype(np.float32)
            if i:
                g = g * (zs[i - 1] > 0)
        return g


def score_mlp(df: DataFrame, model: Network, vector: str = "vector") -> DataFrame:
    """df with logits array<double>; null vectors give null logits. A vector of another length raises."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def logits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            some = b.notna().to_numpy()
            z = iter(shared.value.forward(np.stack(b[some].to_numpy()))[-1].astype(float)) if some.any() else iter(())
            out = pd.Series([next(z) if x else None for x in some], index=b.index, dtype=object)
            yield out

    return df.withColumn("logits", logits(F.col(vector)))


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp((x - top) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def decide(df: DataFrame, tau: float, tau_machine: float, min_words: int = 25) -> DataFrame:
    """df (probs array in class order, n_words, english) with top, p, bar and decision; the first class wins ties."""
    p = F.array_max("probs")
    top = F.element_at(F.array(*map(F.lit, CLASSES)), F.array_position("probs", p).cast("int"))
    bar = F.when(F.col("top") == "machine", F.lit(tau_machine)).otherwise(F.lit(tau))
    unsure = (F.col("n_words") < min_words) | ~F.col("english") | (F.col("p") < F.col("bar"))
    return df.withColumn("p", p).withColumn("top", top).withColumn("bar", bar).withColumn("decision", F.when(unsure, "unsure").otherwise(F.col("top")))


def explain(df: DataFrame, model: Network, keys: list[str], names: tuple[str, ...], top: int = 3, fires: float = 0.05) -> DataFrame:
    """keys, rank, rule, push, value: the rules that push most towards the called class (machine where unsure).

    df: keys, vector, decision. Only positive pushes count, and only rules that fire unless the class is human.
    """
    shared, n = df.sparkSession.sparkContext.broadcast(model), len(names)
    schema = T.StructType([*df.select(*keys).schema.fields, *T.StructType.fromDDL("rank int, rule string, push double, value double").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            if not len(b):
                continue
            x = np.stack(b["vector"].to_numpy()).astype(np.float32)
            target = np.array([CLASSES.index(d) if d in CLASSES else 1 for d in b["decision"]])
            push = (m.gradient(x, target) * ((x - m.mean) / m.sd))[:, :n]
            allowed = (push > 0) & ((x[:, :n] > fires) | (target == 0)[:, None])
            order = np.argsort(-np.where(allowed, push, -np.inf), axis=1, kind="stable")[:, :top]
            rows, ranks = np.nonzero(np.take_along_axis(allowed, order, 1))
            if not len(rows):
                continue
            places = order[rows, ranks]
            out = b[keys].iloc[rows].reset_index(drop=True)
            yield out.assign(rank=(ranks + 1).astype(np.int32), rule=[names[i] for i in places], push=push[rows, places].astype(float), value=x[rows, places].astype(float))

    return df.select(*keys, "vector", "decision").mapInPandas(run, schema)


def reasons(df: DataFrame, pushes: DataFrame, keys: list[str], names: DataFrame | None = None, hits: str | None = None, find: Callable[[DataFrame, Column], DataFrame] | None = None) -> DataFrame:
    """df with reasons: array<struct<id, name, spans>>, the rules of pushes (keys, rank, rule; see explain) in order of rank.

    names: (id, name) of rules, a few dozen rows; a rule without one shows its id. hits: df's column of array<struct<rule, spans>>; a rule
    without hits has no spans. Rows without pushes, and null spans, have empty arrays. keys tell df's rows apart. find: adds hits to df's
    rows, told the ids of the rules that push them, so that no others are looked for.
    """
    spans = "array<struct<start:int,end:int>>"
    called = pushes.select(*keys, "rank", "rule")
    if names is not None:
        table = names.select(F.col("id").alias("rule"), "name")
        called = called.join(F.broadcast(table) if table.limit(10_001).count() <= 10_000 else table, "rule", "left")
    else:
        called = called.withColumn("name", F.lit(None).cast("string"))
    why = called.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("rule").alias("id"), F.coalesce("name", "rule").alias("name")))).alias("_why"))
    own = lambda x: F.get(F.filter(F.col(hits), lambda h: h["rule"] == x["id"]), F.lit(0))["spans"] if hits else F.lit(None).cast(spans)
    rows = F.transform("_why", lambda x: F.struct(x["id"].alias("id"), x["name"].alias("name"), F.coalesce(own(x), F.array().cast(spans)).alias("spans")))
    both = df.join(why, keys, "left")
    if find:
        both = find(both, F.transform("_why", lambda x: x["id"]))
    return both.withColumn("reasons", F.coalesce(rows, F.array().cast(f"array<struct<id:string,name:string,spans:{spans}>>"))).drop("_why")


def shown_p(p: Column) -> Column:
    return F.least(p, F.lit(0.99))


#: What readers see for a decision.
LABELS = {"human": "Reads human", "machine": "Reads machine-made", "mixed": "Reads mixed", "unsure": "Not sure"}


def reading(df: DataFrame, reasons: str | None = None, min_words: int = 25) -> DataFrame:
    """df with the public record: verdict, label, confidence, probabilities, reasons, skipped."""
    skipped = F.when(F.col("n_words") < min_words, "too-short").when(~F.col("english"), "not-english")
    label = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])[F.col("decision")]
    why = F.when(skipped.isNull(), F.col(reasons)) if reasons else F.lit(None).cast("array<string>")
    empty = F.array().cast(df.schema[reasons].dataType if reasons else "array<string>")
    probs = F.struct(*[F.col("probs")[i].alias(c) for i, c in enumerate(CLASSES)])
    return df.withColumn("verdict", F.col("decision")).withColumn("label", label).withColumn("confidence", shown_p(F.col("p"))).withColumn("probabilities", probs).withColumn("skipped", skipped).withColumn("reasons", F.coalesce(why, empty))


def file_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """by, read, machine, human, mixed, unsure, skipped, any_machine: decisions of paragraphs (decision, skipped)."""
    read = F.col("skipped").isNull()
    return df.groupBy(*by).agg(
        F.count_if(read).alias("read"), *[F.count_if(read & (F.col("decision") == d)).alias(d) for d in ("machine", "human", "mixed", "unsure")], F.count_if(~read).alias("skipped"),
        F.coalesce(F.bool_or(read & (F.col("decision") == "machine")), F.lit(False)).alias("any_machine"),
    )


#: The order in which equal remainders are rounded up.
SHOWN_ORDER = ("machine", "mixed", "unsure", "human")


def distribution(df: DataFrame, by: list[str]) -> DataFrame:
    """by, decision, percent: whole percentages that add up to 100 by largest remainders; those of 0 are left out."""
    place = F.array_position(F.array(*map(F.lit, SHOWN_ORDER)), F.col("decision"))
    counts = df.groupBy(*by, "decision").agg(F.count("*").alias("n"))
    w = W.partitionBy(*by)
    exact = 100.0 * F.col("n") / F.sum("n").over(w)
    floors = counts.withColumn("_place", place).withColumn("_exact", exact).withColumn("_floor", F.floor("_exact"))
    left = 100 - F.sum("_floor").over(w)
    ranked = floors.withColumn("_left", left).withColumn("_rank", F.row_number().over(w.orderBy(F.desc(F.round(F.col("_exact") - F.col("_floor"), 9)), "_place")))
    return ranked.select(*by, "decision", (F.col("_floor") + (F.col("_rank") <= F.col("_left")).cast("long")).alias("percent")).filter("percent > 0")


#: Words, and line breaks as tokens of their own.
TOKEN = re.compile(r"\n|\S+")


def word_diff(df: DataFrame, a: str, b: str, most_cells: int = 4_000_000) -> DataFrame:
    """df with diff: array<struct<kind, words>> of kept, removed and added words and line breaks, removals first; too long pairs are replaced whole."""
    kind = "array<struct<kind:string,words:string>>"

    @F.pandas_udf(kind)
    def diff(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_diff(TOKEN.findall(x or ""), TOKEN.findall(y or ""), most_cells) for x, y in zip(left, right)])

    return df.withColumn("diff", diff(F.col(a), F.col(b)))


def _diff(a: list[str], b: list[str], most_cells: int) -> list[dict]:
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    mid_a, mid_b = a[head : len(a) - tail], b[head : len(b) - tail]
    steps = [("same", w) for w in a[:head]]
    if len(mid_a) * len(mid_b) > most_cells:
        steps += [("removed", w) for w in mid_a] + [("added", w) for w in mid_b]
    else:
        ids = {w: i for i, w in enumerate(dict.fromkeys(mid_a + mid_b))}
        y = np.array([ids[w] for w in mid_b], np.int64)
        table = np.zeros((len(mid_a) + 1, len(mid_b) + 1), np.int32)
        for i in range(len(mid_a) - 1, -1, -1):
            # longest common subsequence of the rest; a row at a time, ties carried from the right
            best = np.maximum(table[i + 1, :-1], np.where(y == ids[mid_a[i]], table[i + 1, 1:] + 1, 0))
            table[i, :-1] = np.maximum.accumulate(best[::-1])[::-1]
        i = j = 0
        while i < len(mid_a) or j < len(mid_b):
            if i < len(mid_a) and j < len(mid_b) and mid_a[i] == mid_b[j]:
                steps.append(("same", mid_a[i]))
                i, j = i + 1, j + 1
            elif j >= len(mid_b) or i < len(mid_a) and table[i + 1, j] > table[i, j + 1]:  # where either keeps as much, words are added first
                steps.append(("removed", mid_a[i]))
                i += 1
            else:
                steps.append(("added", mid_b[j]))
                j += 1
    steps += [("same", w) for w in (a[len(a) - tail :] if tail else [])]
    out: list[dict] = []
    for kind, group in _changes(steps):
        if group:
            out.append({"kind": kind, "words": " ".join(group)})
    return out


def _changes(steps: list[tuple[str, str]]) -> Iterator[tuple[str, list[str]]]:
    """Runs of one kind; between two runs of kept words all removals come before all additions."""
    same: list[str] = []
    removed: list[str] = []
    added: list[str] = []
    for kind, w in [*steps, ("end", "")]:
        if kind in ("same", "end") and (removed or added):
            yield "removed", removed
            yield "added", added
            removed, added = [], []
        if kind == "same":
            same.append(w)
            continue
        if same:
            yield "same", same
            same = []
        if kind == "removed":
            removed.append(w)
        elif kind == "added":
            added.append(w)


def parse_rewrite(reply: Column) -> Column:
    """struct<text, removed>: a reply without its last "Removed:" line, and the rule ids on that line."""
    last = F.regexp_extract(reply, r"(?i)\n[ \t]*Removed:([^\n]*)\s*\z", 1)
    has = reply.rlike(r"(?i)\n[ \t]*Removed:[^\n]*\s*\z")
    text = F.when(has, F.regexp_replace(reply, r"(?i)\n[ \t]*Removed:[^\n]*\s*\z", "")).otherwise(reply)
    return F.struct(F.trim(text).alias("text"), F.regexp_extract_all(last, F.lit(r"r-[0-9]{3}"), 0).alias("removed"))
