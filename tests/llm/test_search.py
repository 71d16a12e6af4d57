"""MaxScore, SimHash and mixing against brute force, with empty, null, tied and repeated rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.llm import maxscore, mixing, simhash

VECTORS = "vec_id long, embedding array<float>, label int"


def brute_top(rows, k):
    v = {i: np.floor(64 * np.array(e, np.float32).astype(float)).astype(int) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)}
    out = {}
    for q in (i for i in v if i % 20 == 0):
        best = sorted(((-int(v[q][: len(v[c])] @ v[c][: len(v[q])]), c) for c in v if c != q))[:k]
        out[q] = [(c, -s) for s, c in best]
    return out


@pytest.mark.parametrize("n,dim,k", [(300, 16, 20), (30, 4, 20), (90, 1, 3)])
def test_top_k_is_exact(spark, n, dim, k):
    r = np.random.default_rng(n)
    rows = [(i, (r.normal(size=dim) * r.choice([0.1, 1, 5])).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[3][1]) for i in range(25)] + [(2000, None), (2020, [float("nan")] * dim), (2040, [None] * dim), (2060, [float("inf")] * dim)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], VECTORS)
    got = {}
    for x in maxscore.top_k(maxscore.integer_vectors(df), F.col("vec_id") % 20 == 0, k, shard=64, queries=7).orderBy("query_id", "rank").collect():
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    assert got == brute_top(rows, k)


def test_top_k_without_rows_and_with_unequal_lengths(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert maxscore.top_k(maxscore.integer_vectors(empty), F.col("vec_id") % 20 == 0).count() == 0
    some = spark.createDataFrame([(0, [1.0, 1.0], 0), (1, [1.0], 0), (2, [], 0), (3, [2.0, 0.0, 9.0], 0)], VECTORS)
    got = [(x["vec_id"], x["score"]) for x in maxscore.top_k(maxscore.integer_vectors(some), F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(3, 8192), (1, 4096), (2, 0)]


def components(fps):
    up = dict(zip(fps, fps))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(set(fps), 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def near(r, base, n):
    out = []
    for _ in range(n):
        x = base
        for b in r.sample(range(64), r.randint(0, 3)):
            x ^= 1 << b
        out.append(x)
    return out


def test_links_connect_what_is_within_two_bits(spark):
    """A crowded ball of fingerprints, a long chain, pairs and loners; those of another kind never link."""
    r = random.Random(3)
    chain, x = [], r.getrandbits(64)
    for i in range(20):
        x ^= (1 << (3 * i)) | (1 << (3 * i + 1))
        chain.append(x)
    fps = list({0, 3, *(v - 2**64 if v >= 2**63 else v for v in near(r, r.getrandbits(64), 150) + chain + [r.getrandbits(64) for _ in range(30)])})
    edges = simhash.links(spark.createDataFrame([(0, f) for f in fps] + [(1, f ^ 1) for f in fps], "p int, fp long"), 2).filter("p = 0").select("a", "b")
    rows = edges.collect()
    assert all(((e["a"] ^ e["b"]) & (2**64 - 1)).bit_count() <= 2 for e in rows)
    labels = {x["node"]: x["label"] for x in simhash.connected(edges).collect()}
    assert {f: labels.get(f, f) for f in fps} == components(fps)


def brute_fingerprint(text):
    import xxhash

    ws = text.translate(str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})).encode().split() if text else []
    shingles = [b" ".join(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_near_duplicates(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcÀéX") for _ in range(r.randint(1, 6)))
    texts = [" ".join(word() for _ in range(r.choice([0, 1, 2, 3, 50]))) for _ in range(60)]
    long = " ".join(word() for _ in range(30_000))
    texts += [long, long + " end", None, "", " \n\t", "One\ntwo  THREE", "one two three"] + [texts[0]] * 5
    rows = [(i * 3 + 1, t, 7) for i, t in enumerate(texts)] + [(None, texts[4], 7), (4, texts[1], 7)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp int")).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t, _ in rows if i is not None}
    groups = components([f - 2**64 if f >= 2**63 else f for f in fp.values()])
    first = {}
    for i, f in fp.items():
        g = groups[f - 2**64 if f >= 2**63 else f]
        first[g] = min(i, first.get(g, i))
    for x in got:
        assert x["doc_id"] is None or x["fp"] & (2**64 - 1) == fp[x["doc_id"]]
        assert x["component_id"] == first[groups[x["fp"]]]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spark_hashes_agree(spark):
    """Shingles are hashed as Spark's own xxhash64 does."""
    want = spark.createDataFrame([("a é c",)], "s string").select(F.xxhash64("s")).first()[0] & (2**64 - 1)
    assert int(simhash.shingle_hashes("A é c", 3)[0]) == want


def test_bits_are_counted():
    h = np.random.default_rng(5).integers(0, 2**64, 1000, dtype=np.uint64)
    for n in (0, 1, 254, 255, 256, 1000):
        rows = simhash.mixed(h[:n], 3)
        assert simhash.bit_counts(rows).tolist() == [[sum(int(x) >> b & 1 for x in row) for b in range(63, -1, -1)] for row in rows]
    assert len(set(simhash.mixed(h, 3).ravel().tolist())) == 3000


def test_several_fingerprints(spark):
    """Texts link if any of their fingerprints is near; the components equal those of all pairs."""
    r = random.Random(8)
    base = [str(r.randrange(10**6)) for _ in range(300)]
    texts = []
    for i in range(40):
        ws = list(base)
        for at in r.sample(range(300), i // 4):
            ws[at] = "x" + str(r.randrange(10**6))
        texts.append(" ".join(ws))
    texts += [" ".join(str(r.randrange(10**6)) for _ in range(200)) for _ in range(20)] + ["", None, texts[7]]
    prints = [simhash.fingerprint(t, 5, 42, 4) for t in texts]
    up = list(range(len(texts)))
    for i, j in combinations(range(len(texts)), 2):
        if any(((a ^ b) & (2**64 - 1)).bit_count() <= 2 for a, b in zip(prints[i], prints[j])):
            low, high = sorted((up[i], up[j]))
            up = [low if x == high else x for x in up]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 5, prints=4).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == dict(enumerate(up)) and len(set(up[:40])) > 1


def test_keep_one(spark):
    docs = spark.createDataFrame([(5, "a b c d", "x"), (2, "A b  c d", "y"), (9, "quite another text", "z"), (None, "a b c d", "n"), (9, "quite another text", "z")], "doc_id long, text string, component_id string")
    assert sorted((x["doc_id"], x["component_id"]) for x in simhash.keep_one(docs).filter("doc_id is not null").collect()) == [(2, "y"), (9, "z")]


def test_keep_one_tells_rows_apart(spark):
    """Null ids and ids with several texts lose no text that isn't a copy."""
    rows = [(None, "one two three four", 0), (None, "five six seven eight", 1), (None, "one two three four", 2), (3, "red green blue black", 3), (7, "red green blue black", 4), (7, "sun moon stars sky", 5), (7, "north south east west", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns and sorted(x["_row"] for x in got.collect()) == [0, 1, 2, 3, 5, 6]
    assert simhash.keep_one(docs.limit(0)).count() == 0


def test_poisson_counts_and_rates(spark):
    from math import exp, lgamma, log

    for rate in (0.0, 0.3, 4.0, 900.0):
        sums = spark.range(1).select(mixing.cumulative(F.lit(rate)).alias("x")).first()["x"]
        want, total = [], 0.0
        for k in range(len(sums)):
            total += (1.0 if k == 0 else 0.0) if rate == 0 else exp(-rate + k * log(rate) - lgamma(k + 1))
            want.append(total)
        assert np.allclose(sums, want, atol=1e-9) and sums[-1] == pytest.approx(1)
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, F.lit(None)).otherwise("hot").alias("source"), F.lit("t").alias("text"), F.lit(1).alias("copy"))
    out = mixing.poisson_mix(docs, weights={"a": 1.0, "hot": 1.0}).groupBy("source").count().collect()
    n = {x["source"]: x["count"] for x in out}
    assert set(n) == {"a", "hot"} and abs(n["a"] - 10_000) < 500 and abs(n["hot"] - 10_000) < 500
    assert mixing.poisson_mix(docs, weights={}).count() == 0
    assert mixing.poisson_mix(docs.limit(0)).count() == 0


def test_mixing_keeps_columns_whatever_their_names(spark):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), *[F.lit(7).alias(c) for c in ("_u", "_SUMS", "_source", "rate", "copies", "_salt", "a.b")])
    got = mixing.poisson_mix(docs, power=1.0)
    assert got.columns == [*docs.columns, "copy", "shuffle_key"] and set(got.select("_u", "_SUMS", "_source", "rate", "copies", "_salt", "`a.b`").distinct().collect()) == {(7,) * 7}


def test_mixing_is_repeatable_and_salted_join_agrees(spark, monkeypatch):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7).cast("string")).alias("source"))
    one = sorted(map(tuple, mixing.poisson_mix(docs.repartition(3)).select("doc_id", "copy", "shuffle_key").collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 2)
    assert one == sorted(map(tuple, mixing.poisson_mix(docs).select("doc_id", "copy", "shuffle_key").collect()))
