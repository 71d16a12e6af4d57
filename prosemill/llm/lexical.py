"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds blocks of documents of about one length. A block's signatures lie in slices: slice j has one bit for each document,
set if any of its terms hashes to j. A term is put in once for each level of occurrences that it reaches (1, 2, 3, 4, 6, 8, 12, ...).
The slices of a query's term, taken together by AND, give the documents that may hold it so often, never too few. Summed with the
terms' weights, and with what a level can add for the document's length, they bound each document's score from above.

A search takes the documents of the highest bounds, scores them exactly, and so has a score that each item's k-th best reaches at
least. All documents whose bound reaches it are then scored exactly; the others are provably excluded.

The index also holds each block's terms with the number of its documents that hold them, from which document frequencies are exact.
Items are answered in blocks of bounded size, whose terms every task gets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, best, stored

#: Bits for each term and level put in, slices of a term, bits and documents of a block at most (a document's own bits may be more).
BITS, SLICES, BLOCK_BITS, BLOCK_DOCS = 16, 8, 1 << 23, 4096
#: Bytes of items that are answered together, and candidates that are broadcast rather than shuffled.
ITEM_BYTES, BROADCAST = 1 << 18, 1 << 20
INDEX = "docs long, total long, levels int, width int, keys array<long>, ns array<long>, slices binary, terms array<string>, dfs array<long>"
#: ASCII but letters and digits parts terms; A-Z are lower-cased; bytes of other characters stay.
TABLE = bytes(ord(chr(b).lower()) if b > 127 or chr(b).isalnum() else 32 for b in range(128)) + bytes(range(128, 256))


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def thresholds(most: int) -> np.ndarray:
    """The occurrences of each level up to the first above most: 1, 2, 3, 4, 6, 8, 12, ..."""
    out = [1, 2, 3]
    while out[-1] <= most:
        out.append(2 * out[-2])
    return np.array(out)


def places(hashes: np.ndarray, width: int) -> np.ndarray:
    """[hashes, SLICES]: where a hash sets bits among width slices."""
    return ((hashes & np.uint64(0xFFFFFFFF))[:, None] + np.arange(SLICES, dtype=np.uint64) * (hashes >> np.uint64(32) | np.uint64(1))[:, None]) % np.uint64(width)


def at_level(hashes: np.ndarray, level: int) -> np.ndarray:
    """Hashes of terms at a level, by another odd factor each."""
    return hashes * np.uint64(pow(0x9E3779B97F4A7C15, level, 1 << 64))


class _Block:
    """Documents of about one length, as they gather."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.ns: list[int] = []
        self.hashes: list[np.ndarray] = []
        self.most = self.levels = 0
        self.dfs: Counter[bytes] = Counter()

    def add(self, key: int, n: int, counts: Counter[bytes], hashes: np.ndarray, levels: int) -> None:
        self.keys.append(key)
        self.ns.append(n)
        self.hashes.append(hashes)
        self.dfs.update(counts.keys())
        self.most, self.levels = max(self.most, len(hashes)), max(self.levels, levels)

    def full(self) -> bool:
        return len(self.keys) >= BLOCK_DOCS or len(self.keys) * self.most * BITS >= BLOCK_BITS

    def row(self) -> pd.DataFrame:
        width = max(64, self.most * BITS)
        bits = np.zeros((width, -(-len(self.keys) // 8) * 8), bool)
        for d, h in enumerate(self.hashes):
            bits[places(h, width).ravel(), d] = True
        names, dfs = [t.decode("utf-8", "surrogatepass") for t in self.dfs], list(self.dfs.values())
        return pd.DataFrame({"docs": [len(self.keys)], "total": [sum(self.ns)], "levels": [self.levels], "width": [width], "keys": [self.keys], "ns": [self.ns], "slices": [np.packbits(bits, axis=1).tobytes()], "terms": [names], "dfs": [dfs]})


def insertions(counts: Counter[bytes]) -> tuple[np.ndarray, int]:
    """The hashes of a document's terms at all levels that they reach, and the number of levels that any reaches."""
    h = xxhash.xxh64_intdigest
    hashes = np.fromiter(map(h, counts), np.uint64, len(counts))
    reached = np.searchsorted(thresholds(max(counts.values())), np.fromiter(counts.values(), np.int64, len(counts)), side="right")
    most = int(reached.max())
    return np.concatenate([at_level(hashes[reached > level], level) for level in range(most)]), most


def keyed(docs: DataFrame) -> DataFrame:
    """(key, doc_id, text): key is a hash of id and text. Documents that share one are only scored where one alone had been enough."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")


def build_index(docs: DataFrame) -> DataFrame:
    """Blocks of signatures (see INDEX) over all rows of docs (doc_id, text, and any others) that have a term.

    A block holds documents whose numbers of insertions differ by less than a half. A task holds one open block for each length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks: dict[int, _Block] = {}
        for b in batches:
            for key, text in zip(b["key"], b["text"]):
                ts = terms(text)
                if not ts:
                    continue
                counts = Counter(ts)
                hashes, levels = insertions(counts)
                size = int(2 * math.log2(max(8, len(hashes))))
                block = blocks.setdefault(size, _Block())
                block.add(key, len(ts), counts, hashes, levels)
                if block.full():
                    yield blocks.pop(size).row()
        while blocks:
            yield blocks.popitem()[1].row()

    return keyed(docs).select("key", "text").mapInPandas(run, INDEX)


class Asked(NamedTuple):
    """A block of items: their terms' hashes and weights, each item's terms by number, and the collection's size."""

    terms: list[bytes]
    hashes: np.ndarray
    weights: np.ndarray
    items: list[np.ndarray]
    n_docs: int
    total: int


def length_factor(n: int, asked: Asked) -> int:
    return 50 + 50 * n * asked.n_docs // asked.total


def gain(tf: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """What tf occurrences are worth in documents of these length factors, before the weight. More occurrences are never worth less."""
    tf = np.minimum(tf, 1 << 33)  # beyond it, a bound of the limit
    return np.where(tf >= 1 << 33, 1_000_000, 1_000_000_000 * tf // (1000 * tf + 20 * m))


def bounds(asked: Asked, levels: int, width: int, ns: np.ndarray, slices: bytes) -> np.ndarray:
    """[items, documents]: the most that each document of a block can score. Whole numbers below 2^53, so doubles are exact."""
    n = len(ns)
    rows = np.frombuffer(slices, np.uint8).reshape(width, -1)
    m = np.array([length_factor(int(x), asked) for x in ns], np.int64)
    out = np.zeros((len(asked.items), n))
    limits = thresholds(1 << 60)
    before, alive, held = np.zeros(n, np.int64), np.arange(len(asked.hashes)), None
    for level in range(levels):
        found = np.bitwise_and.reduce(rows[places(at_level(asked.hashes[alive], level), width)], axis=1)
        held = found if held is None else found & held
        some = held.any(axis=1)
        alive, held = alive[some], held[some]
        if not len(alive):
            break
        place = np.full(len(asked.hashes), -1)
        place[alive] = np.arange(len(alive))
        present = np.unpackbits(held, axis=1, count=n)
        worth = gain(int(limits[level + 1]) - 1, m)
        step = (worth - before).astype(float)
        before = worth
        for i, ts in enumerate(asked.items):
            own = ts[place[ts] >= 0]
            if len(own):
                out[i] += (asked.weights[own] @ present[place[own]].astype(np.float64)) * step
    return out


def highest(index: DataFrame, asked: Asked, k: int) -> DataFrame:
    """(item, key, bound): of each task the k documents of the highest bounds for each item, ties as they come."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        keys, tops = np.empty((len(own.items), 0), np.int64), np.empty((len(own.items), 0))
        for b in batches:
            for r in b.itertuples():
                new = bounds(own, r.levels, r.width, np.asarray(r.ns), r.slices)
                tops = np.concatenate((tops, new), axis=1)
                keys = np.concatenate((keys, np.broadcast_to(np.asarray(r.keys, np.int64), new.shape)), axis=1)
                if tops.shape[1] > k:
                    at = np.argpartition(-tops, k - 1, axis=1)[:, :k]
                    keys, tops = np.take_along_axis(keys, at, 1), np.take_along_axis(tops, at, 1)
        item, place = np.nonzero(tops)
        yield pd.DataFrame({"item": item.astype(np.int32), "key": keys[item, place], "bound": tops[item, place]})

    return index.select("levels", "width", "keys", "ns", "slices").mapInPandas(run, "item int, key long, bound double")


def reaching(index: DataFrame, asked: Asked, least: np.ndarray) -> DataFrame:
    """(item, key) of all documents whose bound is at least the item's least score."""
    shared = index.sparkSession.sparkContext.broadcast((asked, least))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, low = shared.value
        for b in batches:
            for r in b.itertuples():
                item, place = np.nonzero(bounds(own, r.levels, r.width, np.asarray(r.ns), r.slices) >= low[:, None])
                yield pd.DataFrame({"item": item.astype(np.int32), "key": np.asarray(r.keys, np.int64)[place]})

    return index.select("levels", "width", "keys", "ns", "slices").mapInPandas(run, "item int, key long")


def rescored(docs: DataFrame, candidates: DataFrame, asked: Asked) -> DataFrame:
    """(item, doc_id, score): the exact scores above 0 of candidates (item, key), whose texts are read again.

    Up to BROADCAST candidates go to where the documents are; more are joined by shuffling.
    """
    shared = docs.sparkSession.sparkContext.broadcast(asked)
    few = candidates.count() <= BROADCAST
    wanted = candidates.groupBy("key").agg(F.collect_set("item").alias("items"))  # no more than items of a block
    pairs = keyed(docs).join(F.broadcast(wanted) if few else wanted, "key")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        weights = [dict(zip((own.terms[t] for t in ts), own.weights[ts].astype(int).tolist())) for ts in own.items]
        for b in batches:
            out = []
            for doc_id, text, items in zip(b["doc_id"], b["text"], b["items"]):
                ts = terms(text)
                counts, m = Counter(ts), length_factor(len(ts), own)
                for i in items:
                    score = sum(w * (1_000_000_000 * tf // (1000 * tf + 20 * m)) for t, w in weights[i].items() if (tf := counts.get(t, 0)))
                    if score > 0:
                        out.append((i, None if pd.isna(doc_id) else int(doc_id), score))
            frame = pd.DataFrame(out, columns=["item", "doc_id", "score"])
            yield frame.astype({"item": "int32", "doc_id": "Int64", "score": "int64"})

    return pairs.select("doc_id", "text", "items").mapInPandas(run, "item int, doc_id long, score long")


def item_blocks(items: DataFrame) -> DataFrame:
    """(item_id, text, block), stored: the items dealt by hash into blocks of about ITEM_BYTES; all rows of an id are in one block."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return stored(rows.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(size / ITEM_BYTES)))).cast("int")))


def search(index: DataFrame, docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of the highest scores above 0 for each item (item_id, text, and any others).

    index is that of docs, stored. Rows of items that share an id, a null one included, are one item with all their terms. Null and empty
    texts have no terms and give no rows; so do empty tables. Repeated documents are ranked as often as they come. Documents without
    an id count and are ranked, after all others of the same score.
    """
    spark = docs.sparkSession
    size = index.agg(F.sum("docs").alias("n"), F.sum("total").alias("total")).first()
    held = item_blocks(items)
    blocks = [r["block"] for r in held.select("block").distinct().collect()] if size["n"] else []
    result = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks:
        own: dict[int | None, set[bytes]] = {}
        for r in held.filter(F.col("block") == block).toLocalIterator():
            own.setdefault(r["item_id"], set()).update(terms(r["text"]))
        found = _search(index, docs, own, size["n"], size["total"], k)
        result = found if len(blocks) == 1 else result.unionByName(stored(found))
    return result


def _search(index: DataFrame, docs: DataFrame, own: dict, n: int, total: int, k: int) -> DataFrame:
    """search for one block of items, given by their ids and terms."""
    spark = docs.sparkSession
    vocabulary = spark.createDataFrame([(t.decode("utf-8", "surrogatepass"),) for t in sorted(set().union(*own.values()))], "term string")
    each = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.dfs").alias("df"))
    dfs = {r["term"].encode("utf-8", "surrogatepass"): r["df"] for r in each.join(F.broadcast(vocabulary), "term").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    names = sorted(dfs)
    number = {t: i for i, t in enumerate(names)}
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * dfs[t] + 1))) for t in names], float)
    items = [np.array(sorted(number[t] for t in ts if t in number), np.int64) for ts in own.values()]
    asked = Asked(names, np.array([xxhash.xxh64_intdigest(t) for t in names], np.uint64), weights, items, n, total)

    first = stored(best(highest(index, asked, k), ["item"], [F.desc("bound"), F.col("key")], k).select("item", "key").distinct())
    scores = best(rescored(docs, first, asked), ["item"], [F.desc("score")], k)
    least = np.ones(len(items))
    for r in scores.filter(F.col("rank") == k).select("item", "score").collect():
        least[r["item"]] = r["score"]
    candidates = stored(reaching(index, asked, least).distinct())
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(own)], "item int, item_id long")
    top = best(rescored(docs, candidates, asked), ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k)
    return top.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """search over an index that is built and stored for it."""
    return search(stored(build_index(docs)), docs, items, k)


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
SQL = f"""
WITH each AS (
  SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS ts FROM documents
), sizes AS (
  SELECT row, doc_id, CAST(len(ts) AS BIGINT) AS n FROM each WHERE len(ts) > 0
), whole AS (
  SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS total FROM sizes
), tfs AS (
  SELECT row, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT row, unnest(ts) AS term FROM each) GROUP BY row, term
), wanted AS (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark)
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), whole
), factors AS (
  SELECT row, doc_id, 50 + (50 * n * docs) // total AS m FROM sizes, whole
), scores AS (
  SELECT item_id, row, any_value(doc_id) AS doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tfs USING (term) JOIN factors USING (row) GROUP BY item_id, row
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 50
"""
