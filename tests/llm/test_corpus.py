"""Lexical search, archives and phrases against brute force, with empty, null, tied and repeated rows."""

import glob
import gzip
import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from prosemill.llm import lexical, phrases, warc
from prosemill.llm.common import stored_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, KEY string, score double, lang string"


def terms_of(text):
    return TERM.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute_ranks(docs, items, k):
    counts = [(i, Counter(t)) for i, x in docs if (t := terms_of(x))]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    asked = {}
    for i, x in items:
        asked.setdefault(i, set()).update(terms_of(x))
    out = {}
    for i, ts in asked.items():
        rows = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in ts if c[t])
            if score > 0:
                rows.append((-score, d is None, d or 0, d))
        if rows:
            out[i] = [(d, -s) for s, _, _, d in sorted(rows)[:k]]
    return out


def some_docs(r, n):
    words = [f"{a}{b}" for a in ("ka", "Ré", "to", "X9", "ñu") for b in ("", "li", "mo", "Ss", "é", "12", "ra")]
    docs = [(i, r.choice(" .,\n").join(r.choices(words, [1 / (j + 1) for j in range(len(words))], k=r.choice([1, 3, 20, 80, 400])))) for i in range(n)]
    return docs + [(7, docs[3][1])] * 3 + [(8, docs[8][1])] * 2 + [(None, "kali kali"), (None, docs[5][1]), (900, None), (901, ""), (902, " .;\x00 "), (903, "ka " * 5000), (904, "kali kali"), (905, "KALIK")]


def ranked(got):
    out = {}
    for x in sorted(got, key=lambda x: (x["item_id"] is None, x["item_id"] or 0, x["rank"])):
        assert x["rank"] == len(out.setdefault(x["item_id"], [])) + 1
        out[x["item_id"]].append((x["doc_id"], x["score"]))
    return out


def test_ranks_are_exact(spark, monkeypatch):
    """Ties, repeats, null ids and texts, long and wordless texts, items that share an id; one block of items and several, shuffled and broadcast."""
    r = random.Random(1)
    docs = some_docs(r, 300)
    items = [(i, " ".join(r.choice(docs[:300])[1].split()[:12])) for i in range(12)] + [(3, "TO x9li"), (20, None), (21, ""), (22, "nowhere"), (None, "kali 12"), (23, "kali nowhere kali")]
    df = spark.createDataFrame([(*d, "k", 0.5, "en") for d in docs], DOCS).repartition(3)
    asked = spark.createDataFrame([(*x, 0) for x in items], "item_id long, text string, rank int")
    want = brute_ranks(docs, items, 10)
    assert ranked(lexical.rank_documents(df, asked, 10).collect()) == want
    monkeypatch.setattr(lexical, "ITEM_BYTES", 100)
    monkeypatch.setattr(lexical, "BROADCAST", 0)
    assert ranked(lexical.rank_documents(df, asked, 10).collect()) == want


def test_ranks_without_rows(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical.rank_documents(docs.limit(0), items).count() == 0
    assert lexical.rank_documents(docs.withColumn("text", docs["text"].substr(9, 9)), items).count() == 0
    assert lexical.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical.rank_documents(docs, items).count() == 1


def test_bounds_hold_and_are_close():
    """No document scores above its bound, and most bounds are the score itself."""
    r = random.Random(2)
    counts = [Counter(lexical.terms(x)) for _, x in some_docs(r, 400) if lexical.terms(x)]
    n, total = len(counts), sum(sum(c.values()) for c in counts)
    names = sorted(set().union(*counts))
    weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * sum(t in c for c in counts) + 1))) for t in names], float)
    items = [np.array(sorted(r.sample(range(len(names)), 8))) for _ in range(20)]
    asked = lexical.Asked(names, np.array([xxhash.xxh64_intdigest(t) for t in names], np.uint64), weights, items, n, total)
    block = lexical._Block()
    for d, c in enumerate(counts):
        hashes, levels = lexical.insertions(c)
        block.add(d, sum(c.values()), c, hashes, levels)
    row = block.row().iloc[0]
    most = lexical.bounds(asked, row["levels"], row["width"], np.array(row["ns"]), row["slices"])
    close = 0
    for d, c in enumerate(counts):
        m = lexical.length_factor(sum(c.values()), asked)
        for i, ts in enumerate(items):
            score = sum(int(weights[t]) * (10**9 * tf // (1000 * tf + 20 * m)) for t in ts if (tf := c.get(names[t], 0)))
            assert most[i, d] >= score
            close += most[i, d] <= 1.3 * score
    assert close > 0.9 * most.size
    assert lexical.thresholds(9).tolist() == [1, 2, 3, 4, 6, 8, 12]


def brute_phrases(docs, least, inside, k):
    n, f = Counter(), {1: Counter(), 2: Counter(), 3: Counter()}
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if c < "\x80" else c for c in text or "")):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for size in f:
                f[size].update((lang, *ws[i : i + size]) for i in range(len(ws) - size + 1))
    rows = []
    for size in (2, 3):
        for (lang, *ws), a in f[size].items():
            if a < least:
                continue
            longer = [b for (m, *x), b in f[3].items() if size == 2 and m == lang and b >= least and ws in (x[:2], x[1:])]
            if any(100 * b >= inside * a for b in longer):
                continue
            cuts = [(f[c][(lang, *ws[:c])], f[size - c][(lang, *ws[c:])]) for c in range(1, size)]
            score, _, l, r = min((10**6 * a * a // (l * r), i, l, r) for i, (l, r) in enumerate(cuts))
            rows.append((lang, -score, -a, " ".join(ws).encode(), l, r))
    out, seen = [], Counter()
    for lang, score, a, phrase, l, r in sorted(rows):
        seen[lang] += 1
        if seen[lang] <= k:
            out.append((lang, seen[lang], phrase.decode(), -a, l, r, n[lang], -score))
    return out


@pytest.mark.parametrize("head,pairs,lookup", [(1 << 19, 1 << 20, 9), (40, 1 << 20, 9), (1 << 19, 30, 2), (25, 20, 3), (0, 0, 1)])
def test_phrases_are_exact(spark, monkeypatch, head, pairs, lookup):
    """All words and pairs held by tasks, some of them, or none; ties, repeats, null languages and texts, long texts, odd white space."""
    for name, value in (("HEAD", head), ("PAIRS", pairs), ("LOOKUP", lookup), ("GROUP", 500), ("FILTER_PART", 1 << 23)):
        monkeypatch.setattr(phrases, name, value)
    r = random.Random(3)
    words = ["Of", "the", "été", "New", "york", "ÄB", "x\xa0y", "a'b", "-", *[f"w{i}" for i in range(60)]]
    line = lambda n: "".join(r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n"]) + w for w in r.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(r.choice(["en", "fr", None, "und", ""]), line(r.choice([1, 2, 30, 300])) + " of the world new york city" * r.randint(0, 2)) for _ in range(120)]
    docs += [("en", None), (None, ""), ("en", " . ; "), ("fr", "yes no " * 4000), ("de", "a b c " * 9)] + [docs[5]] * 3
    df = spark.createDataFrame([(i, t, lang, 1, "p") for i, (lang, t) in enumerate(docs)], "doc_id long, text string, lang string, n long, phrase string").repartition(3)
    names = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    got = sorted(tuple(x[c] for c in names) for x in phrases.mine(df, 10, 50, 40).collect())
    assert got == sorted(brute_phrases(docs, 10, 50, 40)) and len(got) > 60


def test_phrases_without_rows(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "en")], "doc_id long, text string, lang string")
    assert phrases.mine(df).count() == 0 and phrases.mine(df.limit(0)).count() == 0


def test_tiles_dense_and_sparse(monkeypatch):
    monkeypatch.setattr(phrases, "SIDE", 3)
    monkeypatch.setattr(phrases, "DENSE", 50)
    r = np.random.default_rng(0)
    left, right = (np.minimum(r.geometric(0.08, 4000) - 1, 70) for _ in range(2))
    codes, counts = phrases.tile_counts(left, right)
    assert dict(zip(codes.tolist(), counts.tolist())) == Counter((left << 32 | right).tolist()) and len(set(codes.tolist())) == len(codes)


PAGES = "page_id long, url string, html string, digest string, record_id int, value string"


def some_pages(spark, rows):
    return spark.createDataFrame([(*x, "d", 1, "v") for x in rows], PAGES)


def brute_archive(rows):
    data = [(i, (x or "").encode()) for i, _, x in rows]
    best, out = {}, []
    for row, (i, d) in enumerate(data):
        best[d] = max(best.get(d, (False, 0, -(10**9))), (i is not None, i or 0, -row))
    for row, (i, d) in enumerate(data):
        whole = len(d) < 1000 or best[d] == (i is not None, i or 0, -row)
        out.append((i, len(d), hashlib.sha1(d).hexdigest(), "response" if whole else "revisit", None if whole else (best[d][1] if best[d][0] else None)))
    return sorted(out, key=repr)


def test_archives_keep_each_payload_once(spark):
    """Sizes around the least, repeated rows and pages, null ids and texts, payloads that look like records, urls with line breaks."""
    long = lambda c: c * 1000
    rows = [(i, f"http://a/{i}", long("x")) for i in range(40)] + [(i, "u", "x" * 999) for i in range(5)] + [(50, "u", long("é")), (51, None, long("é")), (51, "other", long("é"))]
    trick = "<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 30
    rows += [(60, "http://b/\r\nWARC-Type: metadata", trick), (61, "u", trick), (62, "u", None), (63, "u", ""), (None, "u", long("x")), (None, "u", long("n")), (None, "v", long("n")), (70, "u", "y\n" * 900), (70, "u", "y\n" * 900)]
    got = warc.archive(some_pages(spark, rows).repartition(3), 1000).collect()
    assert sorted((tuple(x) for x in got), key=repr) == brute_archive(rows)
    assert warc.archive(some_pages(spark, []), 1000).count() == 0


def test_archives_are_whole_and_can_be_resolved_again(spark):
    """Records as the format has them; payloads come back; new crawls' revisits find the originals; a broken file raises."""
    long = lambda c: c * 1200
    crawl, target, again = (stored_path(spark) for _ in range(3))
    warc.write(warc.crawled(some_pages(spark, [(1, "http://a/ü", long("ü")), (2, "http://b", long("ü")), (3, "c", "")])), crawl)
    warc.resolve_archives(spark, crawl, target)
    data = b"".join(gzip.open(f).read() for f in sorted(glob.glob(f"{target.removeprefix('file:')}/part-*")))
    records = list(warc.parsed(data, "all"))
    assert len(records) == 3 and data.count(long("ü").encode()) == 1
    kinds = {f["page-id"]: f for _, f, _ in records}
    assert kinds["1"]["warc-type"] == "revisit" and kinds["1"]["warc-refers-to"] == kinds["2"]["warc-record-id"] and kinds["1"]["warc-profile"] == warc.PROFILE
    assert {x["page_id"]: x["payload"] for x in warc.read(spark, target).collect()} == {1: None, 2: long("ü").encode(), 3: b""}
    # another crawl of the same page beside the resolved archives: the old revisit gets the newest original
    warc.write(warc.crawled(some_pages(spark, [(9, "d", long("ü"))])), target, mode="append")
    warc.resolve_archives(spark, target, again)
    assert {x["page_id"]: (x["record_type"], x["payload_bytes"], x["refers_to"]) for x in warc.described(spark, again).collect()} == {1: ("revisit", 2400, 9), 2: ("revisit", 2400, 9), 3: ("response", 0, None), 9: ("response", 2400, None)}
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(data[:-400], "x"))
    with pytest.raises(ValueError, match="no record"):
        list(warc.parsed(b"GIF89a", "x"))


def test_attached_splits_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 10)
    rows = spark.range(9000).select("id", F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 500).alias("key"))
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("most")).filter("key <> 7")
    got = warc.attached(rows, groups, "key", 9000)
    assert got.count() == 9000 and got.filter("key = 0 and most is null or key = 7 and most is not null").count() == 0
    assert got.filter("most is null").count() == rows.filter("key = 7").count()
