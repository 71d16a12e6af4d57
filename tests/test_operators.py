"""Feedback, budgets, scoring, dom blocks, audit, language-model statistics, sources and streams on hand-written cases."""

import datetime
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from prosemill.functions import features, lexicons
from prosemill.functions import text as T
from prosemill.operators import audit, corpus, dom, evaluation, feedback, lm, scoring, training
from prosemill.sources import io
from prosemill.streaming import streams


def test_calibration_snapshot(spark):
    day = lambda d: datetime.datetime(2026, 9, d)
    rows = [("machine", "machine", 0.9, day(16), "v"), ("machine", "human", 0.9, day(16), "v"), ("human", "human", 0.75, day(16), "v"), ("unsure", "machine", 0.5, day(23), "v"), ("human", "machine", 0.1, day(1), "old")]
    s = feedback.calibration_snapshot(spark.createDataFrame(rows, "predicted string, label string, p double, created_at timestamp, model_version string"), "v").first()
    assert s["n"] == 4 and s["ece"] == pytest.approx((2 * 0.4 + 0.25) / 3)
    assert [tuple(x) for x in s["bins"]["machine"]] == [(9, 0.9, 0.5, 2)] and [tuple(x) for x in s["bins"]["human"]] == [(7, 0.75, 1.0, 1)]
    assert [tuple(x) for x in s["unsure_by_week"]] == [("2026-W38", 3, 0.0), ("2026-W39", 1, 1.0)]
    weeks = spark.createDataFrame([(datetime.datetime(2021, 1, 3),), (datetime.datetime(2026, 9, 19),)], "t timestamp").select(feedback.iso_week(F.col("t")).alias("w")).collect()
    assert [x["w"] for x in weeks] == ["2020-W53", "2026-W38"]


def test_budgets(spark):
    t = datetime.datetime(2026, 1, 1)
    calls = [(i, t, s, "k", "2026-01-01", n) for i, n in enumerate((2, 1, 1)) for s in ("a", "b")]
    got = feedback.spend(spark.createDataFrame(calls, "call_id long, ts timestamp, scope string, key string, period string, amount long"), spark.createDataFrame([("a", 3), ("b", 100)], "scope string, limit long"))
    assert [(x["call_id"], x["allowed"]) for x in got.filter("scope = 'b'").orderBy("call_id").collect()] == [(0, True), (1, True), (2, False)]
    assert got.agg(F.max("running")).first()[0] == 4


def test_corrections(spark):
    good = ([0.0, 1.0], "human", "machine", 0.5, "blog", 1.0, "1.0.1")
    bad = [(0, [0.0]), (0, None), (0, [float("nan"), 1.0]), (1, "robot"), (2, None), (3, 1.5), (4, "moon"), (5, 1.5), (6, "!")]
    rows = [(0, *good)] + [(i + 1, *[v if k == j else x for k, x in enumerate(good)]) for i, (j, v) in enumerate(bad)]
    df = feedback.valid_correction(spark.createDataFrame(rows, "id int, vector array<double>, predicted string, label string, p double, site_class string, spec double, model_version string"), 2)
    assert [x["reason"] for x in df.orderBy("id").collect()] == [None, "vector", "vector", "vector", "predicted", "label", "p", "site_class", "spec", "model_version"]


def test_distribution_adds_up(spark):
    rows = [("f", d) for d in ("machine", "mixed", "unsure")]
    assert [(x["decision"], x["percent"]) for x in scoring.distribution(spark.createDataFrame(rows, "f string, decision string"), ["f"]).orderBy(F.desc("percent"), "decision").collect()] == [("machine", 34), ("mixed", 33), ("unsure", 33)]


def test_polish_label(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d", "e"], ["a", "b", "c", "x", "e"]), (["a", "b"], []), (["a", "b", "c"], ["a", "b", "c"])], "o array<string>, r array<string>")
    got = df.select(corpus.bigram_kept(F.col("o"), F.col("r")).alias("k"), corpus.polish_label(F.col("o"), F.col("r")).alias("l")).collect()
    assert [(x["k"], x["l"]) for x in got] == [(0.5, "mixed"), (0.0, "machine"), (1.0, "human")]


def test_modes(spark):
    got = [x["m"] for x in spark.range(20).select(corpus.mode_of(F.col("id")).alias("m")).collect()]
    assert got == ["plain"] * 9 + ["antitell"] * 2 + ["humanize"] * 3 + ["rewrite"] * 2 + ["polish"] * 4


def test_caps_over_large_strata(spark):
    df = spark.range(30_000).select("id", (F.col("id") % 3).alias("s")).unionByName(spark.createDataFrame([(-1, None), (-2, None)], "id long, s long"))
    got = corpus.stratified_cap(df, ["s"], 10, "id")
    assert {x["s"]: x["count"] for x in got.groupBy("s").count().collect()} == {0: 10, 1: 10, 2: 10, None: 2}
    assert [x["id"] for x in got.orderBy("id").collect()] == [x["id"] for x in corpus.stratified_cap(df.repartition(5), ["s"], 10, "id").orderBy("id").collect()]
    assert corpus.until_total(spark.range(1000).withColumn("n", F.lit(3)), "n", 100, ["id"]).count() == 34


def test_decisions_and_readings(spark):
    rows = [([0.2, 0.7, 0.1], 4, True), ([0.2, 0.98, 0.1], 40, True), ([0.2, 0.9, 0.1], 40, True), ([0.95, 0.02, 0.03], 40, False), ([0.4, 0.4, 0.2], 40, True)]
    got = scoring.reading(scoring.decide(spark.createDataFrame(rows, "probs array<double>, n_words int, english boolean"), 0.3, 0.97)).collect()
    assert [(x["verdict"], x["skipped"]) for x in got] == [("unsure", "too-short"), ("machine", None), ("unsure", None), ("unsure", "not-english"), ("human", None)]


def test_network_alone_or_in_a_batch(spark):
    net = scoring.Network.random((176, 24, 8, 3), seed=2)
    x = np.random.default_rng(1).normal(size=(50, 176)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(99, None)]
    got = {r["id"]: r["logits"] for r in scoring.score_mlp(spark.createDataFrame(rows, "id int, vector array<float>").repartition(3), net).collect()}
    assert got[99] is None and np.allclose([got[i] for i in range(50)], [net.forward(x[i : i + 1])[-1][0] for i in range(50)], atol=1e-4)
    target = np.array([0, 1, 2] * 16 + [0, 1])
    g, eps = net.gradient(x, target), 1e-2
    for i, j in ((0, 3), (7, 50), (49, 175)):
        f = lambda v: (lambda z: z[target[i]] - z.mean())(net.forward(v[None])[-1][0])  # noqa: E731, B023
        up, down = x[i].copy(), x[i].copy()
        up[j] += eps
        down[j] -= eps
        assert (f(up) - f(down)) / (2 * eps) == pytest.approx(g[i, j], abs=2e-2)


def test_word_diff_and_rewrites(spark):
    df = spark.createDataFrame([("a b c d e", "a x c d y e"), ("", "new words"), (None, None), ("same", "same")], "a string, b string")
    got = [[tuple(s) for s in x["diff"]] for x in scoring.word_diff(df, "a", "b").collect()]
    assert got == [[("same", "a"), ("removed", "b"), ("added", "x"), ("same", "c d"), ("added", "y"), ("same", "e")], [("added", "new words")], [], [("same", "same")]]
    r = spark.createDataFrame([("Text here.\nRemoved: r-001, r-014",), ("No line.",)], "t string").select(scoring.parse_rewrite(F.col("t")).alias("x")).collect()
    assert [tuple(x["x"]) for x in r] == [("Text here.", ["r-001", "r-014"]), ("No line.", [])]


LONG = "word " * 30


def test_content_blocks(spark):
    main = f"<nav><p>{LONG}</p></nav><main><p>{LONG}<b>bold</b></p><ul><li>{LONG}</li><li>two</li></ul><p>short</p><p hidden>{LONG}</p><pre>{LONG}</pre><p><a href=x>{LONG}</a></p></main><footer><p>{LONG}</p></footer>"
    runs = f"<body><div>{LONG}<br><br>{LONG}second<br>line</div></body>"
    got = dom.content_blocks(spark.createDataFrame([(1, main), (2, runs), (3, None), (4, "<div>" * 3000)], "id int, html string"), "html", ["id"]).orderBy("id", "pos").collect()
    assert [(x["id"], x["kind"]) for x in got] == [(1, "p"), (1, "ul"), (2, "run"), (2, "run")]
    assert got[0]["text"].endswith("**bold**") and got[1]["text"].startswith("- word") and got[3]["text"].endswith("second\nline")


TRICKS = (
    "<html><body class=\"bg-white\"><h1>\U0001f680 Go</h1><p>Fast — smart — easy. It's not just a tool, it's a friend. ✓ ✓ ✓ $9/mo $19/mo $29/mo ✨</p>"
    + '<svg class="lucide"></svg>' * 3
    + '<div class="bg-gradient-to-r bg-gradient-to-b bg-clip-text blur-3xl shadow-lg shadow-xl shadow-md shadow-2xl shadow-lg backdrop-blur-md rounded-2xl rounded-2xl rounded-3xl rounded-2xl rounded-2xl border-l-4 bg-grid'
    + ' text-purple-500 bg-violet-600 from-indigo-500 bg-black grid-cols-3 col-span-2 row-span-2 hover:scale-105 hover:rotate-3 hover:-translate-y-1 group-hover:translate-x-1 text-lime-300 bg-cyan-400 text-lime-400'
    + ' via-red-500 to-blue-500 from-green-400 via-pink-400 to-amber-300 bg-pink-50 bg-blue-100 bg-green-50 bg-amber-50">x</div>'
    + '<i class="bg-red-500"></i><i class="bg-yellow-400"></i><i class="bg-green-500"></i><style>body{font-family: Inter, sans-serif}</style></body></html>'
)


def test_audit(spark):
    plain = '<html><body><p>Plain words.</p><a href="/terms">Terms</a><a href="/privacy">Privacy</a></body></html>'
    pages = spark.createDataFrame([(1, TRICKS), (2, plain), (3, None)], "id int, html string")
    rows = audit.audit_pages(pages.withColumnRenamed("id", "page"), ["page"]).filter("hit").collect()
    assert {x["id"] for x in rows if x["page"] == 1} == set(audit.checks()) and not [x for x in rows if x["page"] == 2]
    assert {x["id"] for x in rows if x["page"] == 3} == {"no-terms", "no-privacy"}


def test_token_statistics(spark):
    r = np.random.default_rng(5)
    logits, tokens = r.normal(size=(7, 40)), r.integers(0, 40, 7)
    got = lm.token_stats(spark.createDataFrame([(i, z.tolist(), int(t)) for i, (z, t) in enumerate(zip(logits, tokens))], "pos int, logits array<float>, next_token int"), ["pos"]).orderBy("pos").collect()
    for x, z, t in zip(got, logits, tokens):
        p = np.exp(z) / np.exp(z).sum()
        h = -(p * np.log(p)).sum()
        assert np.allclose([x["observed"], x["entropy"], x["variance"]], [np.log(p[t]), h, (p * (np.log(p) + h) ** 2).sum()], atol=1e-4) and x["rank"] == 1 + (p > p[t]).sum()
    stats = spark.createDataFrame([(1, 0, -2.0, 3.0, 1.5, 4), (1, 1, -0.5, 2.0, 0.75, 1), (1, 300, -9.0, 9.0, 9.0, 9)], "para int, pos int, observed double, entropy double, variance double, rank int")
    v = lm.lm_features(stats, ["para"]).first()["lm"]
    assert v[0] == -1.25 and v[5] == 0.5 and v[6] == 1.0 and v[2] == pytest.approx(2.5 / 1.5)


def test_bootstrap_and_wilson(spark):
    rows = [(True, i % 10 < 9, True, i % 10 < 6) for i in range(1000)]
    x = evaluation.bootstrap_gap(spark.createDataFrame(rows, "called_a boolean, hit_a boolean, called_b boolean, hit_b boolean")).first()
    assert x["gap"] == pytest.approx(0.3) and 0.25 < x["low"] < 0.3 < x["high"] < 0.35
    assert spark.range(1).select(evaluation.wilson_low(F.lit(0.5), F.lit(0.0)).alias("x")).first()["x"] == 0


def test_fits_learn(spark):
    r = np.random.default_rng(1)
    rows = [(("human", "machine", "mixed")[c], (r.normal(size=4) + 3 * np.eye(4)[c]).tolist(), 1.0 + c) for c in range(3) for _ in range(80)]
    df = spark.createDataFrame(rows, "label string, vector array<float>, w double")
    data = df.withColumn("features", training.array_to_vector(F.col("vector").cast("array<double>")))
    for model in (training.fit_logistic(df, "vector", "w"), training.fit_mlp(df, "vector", 4, hidden=(8,), weight="w")):
        assert model.transform(data).filter(F.col("prediction") == training.class_index(F.col("label"))).count() > 200
    scale, shift = training.fit_vector_scaling(df.withColumn("logits", F.transform(F.slice("vector", 1, 3), lambda x: x.cast("double") * 9)))
    assert all(0 < s < 1 for s in scale)


def test_sources(spark, tmp_path):
    csv = tmp_path / "a.csv"
    csv.write_text('id,attack,domain,generation\n' + "".join(f'{i},{"none" if i % 3 else "other"},d{i},"line ""one""\nline two"\n' for i in range(20)) + '90,none,d1,"  "\n')
    got = io.slim_csv(spark, str(csv), "id string, attack string, domain string, generation string", ["id", "attack", "domain", "generation"])
    assert got.count() == 13 and got.first()["generation"] == 'line "one"\nline two'
    with pytest.raises(ValueError):
        io.slim_csv(spark, str(csv), "id string, attack string, domain string, generation string", ["attack", "domain", "generation"], min_domains=100)
    io.write_jsonl(got.coalesce(1), str(tmp_path / "j"), "gzip")
    assert io.read_jsonl(spark, str(tmp_path / "j"), "id string, generation string", True).filter("shard like '%.gz'").count() == 13
    io.write_corpus(got.withColumn("split", F.lit("train")), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).filter("split = 'train'").count() == 13
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_text("a\nb")
    assert io.read_text_files(spark, str(tmp_path / "t")).first()["text"] == "a\nb"
    for run in ("a", "b", "b"):
        io.append_snapshot(got, str(tmp_path / "s"), run)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 26 and corpus.corpus_stamp(got, ("id",)).first() == corpus.corpus_stamp(got.repartition(3), ("id",)).first()


def run_stream(spark, df, schema, tmp_path, name, build, mode):
    df.write.parquet(str(tmp_path / name))
    q = build(spark.readStream.schema(schema).parquet(str(tmp_path / name))).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    assert q.awaitTermination(120)
    return spark.sql(f"select * from {name}")


def test_streams_give_what_batches_give(spark, tmp_path):
    net = scoring.Network.random((176, 8, 4, 3), seed=1)
    texts = spark.createDataFrame([(i, f"The word number {i} is here and it is not alone. " * 6) for i in range(6)], "id int, text string")
    batch = scoring.decide(scoring.score_mlp(features.extract_features(texts, "text"), net).withColumn("probs", scoring.softmax(F.col("logits"))), 0.4, 0.5)
    got = run_stream(spark, texts, texts.schema, tmp_path, "scores", lambda s: streams.stream_score(s, net, tau=0.4, tau_machine=0.5).select("id", "decision"), "append")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("id", "decision").collect()))
    t = datetime.datetime(2026, 9, 16)
    rows = [(str(i), [1.0], d, "human", 0.5, "blog", 1.0, "1", t + datetime.timedelta(days=7 * (i // 2))) for i, d in enumerate(["unsure", "human", "machine", "unsure"])]
    fb = spark.createDataFrame(rows + rows[:1], "id string, vector array<double>, predicted string, label string, p double, site_class string, spec double, model_version string, created_at timestamp")
    got = run_stream(spark, fb, fb.schema, tmp_path, "weeks", lambda s: streams.stream_feedback(s, 1), "complete")
    assert sorted(map(tuple, got.collect())) == [(datetime.date(2026, 9, 14), 2, 0.5), (datetime.date(2026, 9, 21), 2, 0.5)]
    blocks = spark.createDataFrame([("p", 1, "a"), ("p", 2, "a"), ("p", 3, "b"), ("q", 1, "a")], "page string, ts int, text string")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # see streams
    got = run_stream(spark, blocks.coalesce(1), blocks.schema, tmp_path, "blocks", lambda s: streams.stream_rescore(s, ["page"], "page string"), "append")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert sorted(map(tuple, got.collect())) == [("p", "a"), ("p", "b"), ("q", "a")]
    calls = spark.createDataFrame([("a", "k", "d", 2), ("a", "k", "d", 1)], "scope string, key string, period string, amount long")
    got = run_stream(spark, calls, calls.schema, tmp_path, "usage", streams.stream_usage, "complete")
    assert [x["n"] for x in got.collect()] == [3]


def test_stratified_cap_of_repeated_keys(spark):
    """No stratum gets fewer rows than it may have, whatever its keys."""
    rows = [(k, f"s{k}", i) for k in (0, 1, 2, 3, None) for i in range(5000)] + [(i, "wide", i) for i in range(9000)] + [(i, None, i) for i in range(3)]
    df = spark.createDataFrame(rows, "k long, stratum string, i int")
    got = corpus.stratified_cap(df, ["stratum"], 8, "k")
    assert {x["stratum"]: x["count"] for x in got.groupBy("stratum").count().collect()} == {"s0": 8, "s1": 8, "s2": 8, "s3": 8, "sNone": 8, "wide": 8, None: 3}
    assert sorted(map(str, got.collect())) == sorted(map(str, corpus.stratified_cap(df.repartition(7), ["stratum"], 8, "k").collect()))


def test_too_many_phrases_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(lexicons, "MOST_PHRASES", 2)
    df = spark.createDataFrame([("r-001", x) for x in "abc"], "rule string, phrase string")
    assert lexicons.phrase_table(df.limit(2)).keys() == {"r-001"}
    with pytest.raises(ValueError):
        lexicons.phrase_table(df)


def test_index_percentiles_of_hot_groups_ties_and_nulls(spark):
    r = np.random.default_rng(2)
    rows = [("hot", float(v)) for v in r.normal(size=3000)] + [("tied", 1.0)] * 500 + [("tied", 2.0)] * 3 + [(None, 7.0), ("one", 5.0), ("none", None)]
    got = {x["g"]: (x["p50"], x["p90"]) for x in evaluation.index_percentiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    want = {}
    for g in ("hot", "tied", None, "one"):
        v = sorted(x for k, x in rows if k == g)
        want[g] = tuple(v[min(int(len(v) * q), len(v) - 1)] for q in (0.5, 0.9))
    assert got == want


def test_calls_of_scopes_without_a_limit_pass(spark):
    calls = spark.createDataFrame([(1, 1, "a", "k", "d", 5), (2, 2, "b", "k", "d", 5)], "call_id int, ts int, scope string, key string, period string, amount int")
    got = feedback.spend(calls, spark.createDataFrame([("a", 3)], "scope string, limit int")).collect()
    assert {(x["call_id"], x["allowed"]) for x in got} == {(1, False), (2, True)}


def test_training_paragraphs(spark):
    """Chunks end where enough words have come, line breaks within a block stay, sizes differ from chunk to chunk."""
    text = ". ".join(f"word{i} and some more of it" for i in range(400)) + "."
    docs = spark.createDataFrame([(1, text), (2, "too short"), (3, "a  b\tc\nd " * 10), (4, None)], "id int, t string")
    got = T.training_paragraphs(docs, "t", ["id"], limit=50).collect()
    sizes = [len(x["text"].split()) for x in got if x["id"] == 1]
    assert all(n >= 25 for n in sizes) and len(set(sizes)) > 5 and {x["id"] for x in got} == {1, 3}
    assert " ".join(x["text"] for x in sorted(got, key=lambda x: x["pos"]) if x["id"] == 1) in text
    assert [x["text"] for x in got if x["id"] == 3] == [("a b c\nd " * 10).strip()]
    drawn = [x["n"] for x in spark.range(4000).select(T.chunk_words(F.col("id"), min_words=1).alias("n")).collect()]
    assert abs(np.log(drawn).mean() - np.log(40)) < 0.05 and abs(np.log(drawn).std() - 0.65) < 0.05


def test_rules_of_a_long_text_are_linear(spark):
    """Statistics of sentences are told once a text, not once a sentence."""
    name = lambda i: "x" + "".join(chr(97 + int(c)) for c in str(i % 5000))
    text = " ".join(f"{name(i)} goes {'on and on and on ' * (i // 2 % 4)}here." for i in range(10_000))
    df = spark.createDataFrame([(1, text)], "id int, body string")
    began = time.time()
    r = features.rule_features(features.parse(df, "body")).select("rules.`r-017`", "rules.`r-025`", "rules.`r-030`").first()
    assert time.time() - began < 30
    assert round(r[2], 9) == round(1 / 9999, 9) and 0 < r[0] < 1 and r[1] > 0
