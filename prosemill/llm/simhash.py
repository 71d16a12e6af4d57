"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Two fingerprints at a distance of at most 2 have a segment in which they
differ by at most one bit, so they share one of the 32 variants of that segment with one bit wiped out. Every distinct fingerprint
is indexed under its 64 variants, an equality on the variant finds candidates, and the bit count of the XOR verifies them where a
variant has two. Where it has more, no pairs are made: each of them is indexed under itself and its 64 neighbours at distance 1.
Two fingerprints are within distance 2 exactly if they share such a point, so all that share a point belong together, and each is
linked to the smallest. The work is linear in the number of distinct fingerprints.

A pair with a similarity of 0.8 differs in about 10 bits, beyond any radius that segments can index selectively. Several
fingerprints from differently mixed hashes of the same shingles find more of such pairs: two texts link if any of them does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpointed, free_name, stored, words

#: The lowest bit of each byte of a word of 8, and how many of them one byte can add up.
ONES, LANE = np.uint64(0x0101010101010101), 255


def shingle_hashes(text: str | None, width: int = 3, seed: int = 42) -> np.ndarray:
    ws = words(text)
    if not ws:
        return np.empty(0, np.uint64)
    joined = b" ".join(ws)
    if len(ws) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in ws]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), np.uint64, len(ws) - width + 1)


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many hashes in each row of h [prints, hashes] have each bit set, most significant first."""
    if not h.shape[1]:
        return np.zeros((len(h), 64), np.int64)
    starts = np.arange(0, h.shape[1], LANE)
    # bits j, j + 8, ... of up to 255 hashes are summed in the bytes of one word
    sums = [np.add.reduceat(h >> np.uint64(j) & ONES, starts, axis=1).astype("<u8").view(np.uint8).reshape(len(h), -1, 8).sum(axis=1, dtype=np.int64) for j in range(8)]
    return np.stack(sums, axis=2).reshape(len(h), 64)[:, ::-1]


def mixed(h: np.ndarray, prints: int) -> np.ndarray:
    """The hashes for each fingerprint [prints, hashes]: themselves for the first, else permuted by xor-shifts and products."""
    if prints == 1:
        return h[None]
    x = h[None] + np.arange(1, prints, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return np.concatenate((h[None], x ^ x >> np.uint64(31)))


def fingerprint(text: str | None, width: int = 3, seed: int = 42, prints: int = 1) -> list[int]:
    """As signed 64-bit integers; 0 for a text without words."""
    h = shingle_hashes(text, width, seed)
    return np.packbits(2 * bit_counts(mixed(h, prints)) > len(h), axis=1).view(">i8").ravel().tolist()


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, prints: int = 1) -> DataFrame:
    """(doc_id, fps array<long>) of each row of (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fps": [fingerprint(t, width, seed, prints) for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, fps array<long>")


def links(fps: DataFrame, max_bits: int = 2) -> DataFrame:
    """(p, a, b): links that connect what is within max_bits (1 or 2), over the distinct rows of fps (p, fp); p tells fingerprints of one kind.

    A variant of two fingerprints gives their pair, verified. Those under larger variants are linked to the smallest of each point
    they share, which joins the same groups.
    """
    if max_bits not in (1, 2):
        raise ValueError("max_bits is 1 or 2")
    variants = fps.select("p", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).selectExpr(
        "p",
        "fp",
        # the wiped bit's number above the segment that holds it, with this bit off
        "shiftleft(bit + 0L, 32) | ((if(bit < 32, fp & 4294967295L, shiftrightunsigned(fp, 32))) & ~shiftleft(1L, bit % 32)) AS key",
    )
    shared = checkpointed(variants.withColumn("n", F.count("*").over(W.partitionBy("p", "key"))).filter("n > 1"))
    pairs = shared.filter("n = 2").groupBy("p", "key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter(F.expr(f"bit_count(a ^ b) <= {int(max_bits)}")).select("p", "a", "b")
    crowded = shared.filter("n > 2").select("p", "fp").distinct()
    if max_bits == 2:
        points = crowded.select("p", "fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit")).selectExpr("p", "fp", "if(bit = 64, fp, fp ^ shiftleft(1L, bit)) AS point")
    else:  # the 64 pairs of neighbours that it belongs to, told by the wiped bit
        points = crowded.select("p", "fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).selectExpr("p", "fp", "struct(bit, fp & ~shiftleft(1L, bit)) AS point")
    stars = points.select("p", "fp", F.min("fp").over(W.partitionBy("p", "point")).alias("b")).filter("fp <> b").select("p", F.col("fp").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): for each node of the (a, b) links the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours, then that label's own label, so that the number of
    rounds grows with the logarithm of a chain's length. Neither step gathers a group: labels spread along links, whose number
    per node is bounded, and the second step is a plain join, which Spark may split.
    """
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).select(both["a"].alias("node"), "label", F.lit(None).cast("long").alias("old"))
        near = checkpointed(heard.unionByName(labels.select("node", "label", F.col("label").alias("old"))).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old")))
        far = near.select(F.col("node").alias("label"), F.col("label").alias("further"))
        labels = checkpointed(near.join(far, "label").select("node", F.col("further").alias("label"), "old"))
        if labels.filter("label <> old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")


def class_links(classes: DataFrame, max_bits: int) -> DataFrame:
    """(a, b) over the keys of classes (key, fps), whose links join the classes that any of their fingerprints joins."""
    each = checkpointed(classes.select("key", F.posexplode("fps").alias("p", "fp")))
    first = each.groupBy("p", "fp").agg(F.min("key").alias("rep"))
    found = links(first.select("p", "fp"), max_bits)
    named = found.join(first.select("p", F.col("fp").alias("a"), F.col("rep").alias("x")), ["p", "a"]).join(first.select("p", F.col("fp").alias("b"), F.col("rep").alias("y")), ["p", "b"])
    same = each.join(first, ["p", "fp"]).filter("key <> rep").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    return same.unionByName(named.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")))


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 2, seed: int = 42, prints: int = 1) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs (doc_id, text, and any others); fp is the first fingerprint.

    component_id is the smallest doc_id among the rows that chains of links reach, its own included. Null and empty texts and
    texts of white space have fingerprint zero and link like any other. Repeated rows come back as often as they came. A null
    doc_id never names a component unless all its members are null. An empty table gives an empty result. With several prints,
    rows with equal 64-bit hashes of their fingerprints count as one class, which takes chances of n^2 / 4e19 among n classes.
    """
    key = F.col("fps")[0] if prints == 1 else F.xxhash64("fps")
    rows = checkpointed(fingerprints(docs, width, seed, prints).select("doc_id", key.alias("key"), "fps"))
    classes = checkpointed(rows.groupBy("key").agg(F.min("doc_id").alias("first"), F.first("fps").alias("fps")))
    edges = links(classes.select(F.lit(0).alias("p"), F.col("key").alias("fp")), max_bits).select("a", "b") if prints == 1 else class_links(classes, max_bits)
    labels = connected(edges)
    linked = checkpointed(classes.join(labels, classes["key"] == labels["node"]).select("key", "first", "label"))
    firsts = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    named = linked.join(firsts, "label").select("key", "component_id")
    alone = classes.join(labels, classes["key"] == labels["node"], "left_anti").select("key", F.col("first").alias("component_id"))
    found = checkpointed(named.unionByName(alone))
    return rows.join(found, "key").select("doc_id", F.col("fps")[0].alias("fp"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, max_bits: int = 2, prints: int = 1) -> DataFrame:
    """One row of docs for each group: the first of its smallest doc_id; rows without a doc_id stay.

    Rows are told apart by a number of their own, since ids may be null or repeat with other texts.
    """
    row = free_name(docs, "_row")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()))
    groups = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"), width, max_bits, prints=prints).select(F.col("doc_id").alias(row), "component_id")
    ids = rows.select(row, F.col("doc_id").alias("id"))
    firsts = ids.filter("id is not null").join(groups, row).groupBy("component_id").agg(F.min(F.struct("id", row)).alias("first")).select(F.col("first")[row].alias(row))
    kept = firsts.unionByName(ids.filter("id is null").select(row))
    return rows.join(kept, row, "left_semi").drop(row)
