"""The pipeline against what its stages should do, told by brute force."""

import hashlib
import random
from itertools import combinations

import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from prosemill.llm import bpe, mixing, pii, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    """Clean, toxic, copied, nearly copied and empty texts, some with personal data; null ids, and one id with two texts."""
    r = random.Random(9)
    word = lambda: "".join(r.choice(["an", "er", "th", "ou", "in", "es", "on"]) for _ in range(r.randint(1, 5)))
    bad, rows, labels = ["scoundrel", "vermin", "blockhead"], [], []
    for i in range(400):
        ws = [word() for _ in range(60)]
        if i % 5 == 0:
            for _ in range(4):
                ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append([i, " ".join(ws) + (f" call 386-555-{i:04d} now" if i % 7 == 1 else ""), f"s{i % 3}"])
        labels.append((i, 1, int(i % 5 == 0)))
    clean = [x for x in rows if x[0] % 5]
    rows += [[1000 + k, x[1], "s0"] for k, x in enumerate(clean[:20])]  # copies
    rows += [[1100 + k, x[1] + " " + word(), "s1"] for k, x in enumerate(clean[20:40])]  # nearly
    rows += [[2000, "", "s1"], [2001, None, "s1"], [None, " ".join(word() for _ in range(50)), None], [None, " ".join(word() for _ in range(50)), None], [3, " ".join(word() for _ in range(50)), "s2"]]
    return [(i, t, "xx", s, len(t or "")) for i, t, s in rows], labels


def test_stages_in_turn(spark, tmp_path):
    rows, labels = corpus()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash near duplicates", "personal data", "source mixture", "byte-level BPE"]
    docs, seen = spark.createDataFrame(rows, SCHEMA), []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        assert i == 4 or dict(docs.dtypes) == {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}
        docs.write.parquet(f"{tmp_path}/{i}")
        docs = spark.read.parquet(f"{tmp_path}/{i}")
        seen.append(docs.collect())
    clean, single, private, mixed, encoded = seen

    bad = ("scoundrel", "vermin", "blockhead")
    key = lambda xs: sorted((x[0] is None, x[0] or 0, x[1] is None, x[1] or "") for x in xs)
    assert key(clean) == key(x for x in rows if not any(b in (x[1] or "") for b in bad))

    # one of each group; rows without an id stay; of each group the row with the smallest id, whatever order rows come in
    prints = [simhash.fingerprint(x["text"], 5, 42, corpus_pipeline.PRINTS) for x in clean]
    up = list(range(len(clean)))
    for a, b in combinations(range(len(clean)), 2):
        if any(((p ^ q) & (2**64 - 1)).bit_count() <= 2 for p, q in zip(prints[a], prints[b])) and up[a] != up[b]:
            low, high = sorted((up[a], up[b]))
            up = [low if x == high else x for x in up]
    groups = {}
    for x, g in zip(clean, up):
        groups.setdefault(g, []).append(x)
    kept = [x for g in groups.values() for x in g if x["doc_id"] is None] + [min((x for x in g if x["doc_id"] is not None), key=lambda x: x["doc_id"]) for g in groups.values() if any(x["doc_id"] is not None for x in g)]
    assert sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in single) == sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in kept)
    assert len(single) <= len(clean) - 20 and sum(x["doc_id"] is None for x in single) == 2
    assert {x["text"] for x in single} <= {x["text"] for x in kept}

    before = {(x["doc_id"], (x["text"] or "")[:40]): x for x in single}
    assert len(private) == len(single)
    for x in private:
        old = before[(x["doc_id"], (x["text"] or "")[:40])]
        assert x["n_chars"] == len(x["text"] or "") and ("555" in (old["text"] or "")) == (x["text"] != old["text"])

    want = {}
    rates = {x["source"]: x["rate"] for x in mixing.source_rates(spark.createDataFrame(private, SCHEMA), 0.5).collect()}
    for x in private:
        u = int(hashlib.md5(f"42:{'' if x['doc_id'] is None else x['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        rate, n, term, total = rates[x["source"] or ""], 0, None, 0.0
        import math

        term = total = math.exp(-rate)
        while total <= u:
            n += 1
            term *= rate / n
            total += term
        want[(x["doc_id"], x["text"])] = want.get((x["doc_id"], x["text"]), 0) + n
    got = {}
    for x in mixed:
        got[(x["doc_id"], x["text"])] = got.get((x["doc_id"], x["text"]), 0) + 1
    assert got == {k: n for k, n in want.items() if n}

    path, sha = public_tokenizers.path("byte_bpe_50k.tiktoken"), lambda x: hashlib.sha256(x).hexdigest()
    core = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.loaded(path, public_tokenizers.PATTERN).ranks, special_tokens={})
    rows_of = lambda xs: sorted(map(str, xs))
    assert rows_of(tuple(x) for x in encoded) == rows_of((x["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha((x["text"] or "").encode())) for x in mixed for ids in [core.encode_ordinary(x["text"] or "")])


def test_run_and_key(spark, tmp_path):
    """run() gives what the stages give; the session's key decides the pseudonyms; empty tables stay empty."""
    rows, labels = corpus()
    spark.createDataFrame(rows[:60] + rows[-5:], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
    one = spark.createDataFrame([(1, "at 386-555-0001", "xx", "s", 15)], SCHEMA)
    plain = corpus_pipeline.replace_personal_data(spark, one, "").first()["text"]
    spark.conf.set("spark.prosemill.pii.key", "another")
    try:
        other = corpus_pipeline.replace_personal_data(spark, one, "").first()["text"]
    finally:
        spark.conf.unset("spark.prosemill.pii.key")
    assert plain != other == pii.pseudonymise(one, "another").first()["text"]
    empty = one.filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0


def test_toxic_stage_with_a_common_word(spark, monkeypatch):
    """The stage drops all toxic rows and no others, also if toxic ones hold a common word more often than chance would have it."""
    from .test_text import toxic_corpus

    rows, labels = toxic_corpus()
    often = lambda i: i // 4 % 10 < 9 if i % 4 == 0 else i % 20 < 11
    docs = spark.createDataFrame([(i, t[:-1] + " mostly." if often(i) else t, "en", "s", len(t)) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    monkeypatch.setattr(corpus_pipeline, "table", lambda *_: spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = corpus_pipeline.drop_toxic(spark, docs, "")
    assert kept.columns == list(corpus_pipeline.COLUMNS) and sorted(x["doc_id"] for x in kept.collect()) == [i for i, _, _ in rows if i % 4]
