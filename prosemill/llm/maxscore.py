"""Exact top-k inner products by MaxScore over shards of integer vectors.

A query's terms are its dimensions. What a term gives to a vector of a block lies between two bounds, the products with the
block's smallest and largest component. A vector counts as present in a term's postings by what it gets above the lower bound.
Terms are ordered by the width of their bounds; the longest tail of them with which a vector that is absent from all others
cannot reach the current k-th score is non-essential. Postings of the essential terms are traversed for the whole block; the
other terms are probed, a few at a time, only for the vectors that can still reach the k-th score. Shards and blocks of queries
meet in a grid of groups of bounded size, and the k best of each shard are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Most vectors of a shard, most queries of a block, vectors whose bounds are held together.
SHARD, QUERIES, BLOCK = 65536, 16384, 2048
#: Non-essential terms probed before candidates are looked through again.
PROBE = 8


def integer_vectors(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, x): floor(scale * component) as longs, of the vectors without nulls, infinities and NaN."""
    e = F.col("embedding").cast("array<double>")
    sound = F.col("embedding").isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(sound & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x * scale).cast("long")).alias("x"))


def matrix(rows: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def top_of_shard(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, id, score) of each query's k best in this shard, ties to smaller ids; a vector never meets its own id."""
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(vectors).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64  # exact in each
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order].astype(kind)
    blocks = []
    for i in range(0, len(ids), BLOCK):
        v = vectors[i : i + BLOCK]
        blocks.append((i, np.ascontiguousarray(v.T), v.min(axis=0), v.max(axis=0)))
    found: tuple[list, list, list] = ([], [], [])
    for row, (own, q) in enumerate(zip(query_ids, queries.astype(kind))):
        best_i, best_s = np.empty(0, np.int64), np.empty(0, kind)
        for first, postings, low, high in blocks:
            n = postings.shape[1]
            bound = np.maximum(q * low, q * high)
            floor = np.minimum(q * low, q * high)
            full = len(best_s) >= k
            if full:
                theta = best_s[-1]
                if bound.sum() < theta:
                    continue
                terms = np.argsort(floor - bound, kind="stable")  # widest range first
                tail = np.concatenate((np.cumsum(bound[terms][::-1])[::-1], [0]))
                above = np.concatenate((np.cumsum((bound - floor)[terms][::-1])[::-1], [0]))
                split = int(np.argmax(floor.sum() + above < theta))  # 0 terms can reach it only if their floor does
                head = terms[:split]
                score = q[head] @ postings[head]
                at = np.flatnonzero(score + tail[split] >= theta)
                score = score[at]
                while split < len(terms) and len(at):
                    part = terms[split : split + PROBE]
                    probed = q[part] @ postings[part]
                    score = score + (probed if len(at) == n else probed[at]) if 4 * len(at) > n else score + q[part] @ postings[part[:, None], at]
                    split += len(part)
                    keep = score + tail[min(split, len(terms))] >= theta
                    at, score = at[keep], score[keep]
            else:
                at, score = np.arange(n), q @ postings
            at = at + first
            mine = ids[at] != own
            at, score = np.concatenate((best_i, at[mine])), np.concatenate((best_s, score[mine]))
            if len(score) > k:  # candidates at or above the k-th score, then ties by id: positions are in its order
                cut = -np.partition(-score, k - 1)[k - 1]
                near = score >= cut
                at, score = at[near], score[near]
            rank = np.lexsort((at, -score))[:k]
            best_i, best_s = at[rank], score[rank]
        found[0].append(np.full(len(best_i), row))
        found[1].append(ids[best_i])
        found[2].append(best_s.astype(np.int64))
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in found)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best among all rows (vec_id, x) but those with its own id.

    Queries are the rows for which is_query holds. Vectors of unequal length are compared as if the shorter ended in zeros. Repeated
    ids are candidates as often as they come and queries once (one of them, if their vectors differ). Without vectors or queries
    the result is empty; with fewer than k candidates all are returned. Products beyond 64 bits wrap around.
    """
    n = vectors.count()
    asked = vectors.filter(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    m = asked.count()
    blocks = max(1, math.ceil(m / queries))
    busy = 2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks  # groups enough for all cores, of a block at least
    shards = max(1, math.ceil(n / shard), min(busy, math.ceil(n / BLOCK)))
    place = F.xxhash64("vec_id", F.lit(1))
    candidates = vectors.select("vec_id", "x", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asking = asked.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.pmod(place, F.lit(blocks)).cast("int").alias("block"))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        width = max(map(len, pdf["x"]), default=0)
        asks = pdf["asks"].to_numpy(bool)
        x, ids = matrix(pdf["x"], width), pdf["vec_id"].to_numpy(np.int64)
        q, i, s = top_of_shard(ids[asks], x[asks], ids[~asks], x[~asks], k)
        return pd.DataFrame({"query_id": ids[asks][q] if len(q) else q, "vec_id": i, "score": s})

    merged = candidates.unionByName(asking).groupBy("shard", "block").applyInPandas(cell, "query_id long, vec_id long, score long")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
