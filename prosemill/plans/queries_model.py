"""Queries of the corpus, join, training, scoring, evaluation and feedback operators, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from prosemill.functions import features, spans, web
from prosemill.functions import text as T
from prosemill.operators import corpus, evaluation, feedback, lm, network, scoring, training
from prosemill.operators.evaluation import CLASSES
from prosemill.session import scratch
from prosemill.sources import io

from . import frames
from .frames import FEEDBACK, GENERATIONS, LABELLED, SCORED, documents, table
from . import queries_text
from .queries_text import SENTENCES

ORDER = lambda salt, *cols: "md5(concat_ws('|', '" + salt + "', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols) + "))"
R6 = lambda e: f"round({e}, 6)"


def rounded(df, *keep):
    """Doubles to 6 places, so that sums in another order are equal."""
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# -- sources


def io2_columns(spark, d):
    return io.read_columns(spark, f"{d}/documents.parquet", ["doc_id", "lang"])


def io6_feedback(spark, d):
    return io.read_feedback(frames.feedback(spark, d).withColumn("spec", F.pmod("id", F.lit(2))), 1).select("id", "predicted", "label", "p")


def io8_stamp(spark, d):
    return io.stamp(documents(spark, d), "text").select("doc_id", "sha1")


# -- corpus


def cp1_split(spark, d):
    g = F.concat(F.lit("g"), F.col("doc_id").cast("string"))
    split = corpus.hash_split(g, "md5")
    return documents(spark, d).select("doc_id", split.alias("split"), corpus.adversarial_split(split, F.when(F.pmod("doc_id", F.lit(5)) == 0, "paraphrase").otherwise("none"), F.when(F.pmod("doc_id", F.lit(11)) == 0, "web")).alias("final"))


def cp1_split_crc(spark, d):
    return documents(spark, d).groupBy(corpus.hash_split(F.col("doc_id")).alias("split")).agg(F.count("*").alias("n"))


def cp3_cap(spark, d):
    return corpus.stratified_cap(documents(spark, d), ["source", "lang"], 8, "doc_id", "cap").select("doc_id", "source", "lang")


def cp4_band(spark, d):
    return corpus.length_band(documents(spark, d), "text", 60, 400).select("doc_id", corpus.modern_flag(F.col("source"), ("src3", "src4"), ("src1",)).alias("modern"))


def cp6_replies(spark, d):
    return corpus.assistant_replies(table(spark, d, "conversations"), 100).select("conv_id", "turn", "paragraphs")


def cp7_latest(spark, d):
    return corpus.latest_generation(frames.generations(spark, d), ["group", "source", "model"], "seq").select("key", "group", "source", "model")


def cp8_top(spark, d):
    latest = corpus.latest_generation(frames.generations(spark, d), ["group", "source", "model"], "seq")
    return corpus.top_per_seed(latest).select("key", "group", "source")


def cp9_family(spark, d):
    return corpus.family_cap(frames.generations(spark, d).select("key", "model").distinct(), 0.2, "key").select("key", "model")


def _pairs(spark, d):
    """Each user's turn with the assistant's next one."""
    c = table(spark, d, "conversations").filter("text is not null")
    a = c.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("a"))
    return a.join(c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])


def cp10_polish(spark, d):
    a, b = corpus.pair_words(F.col("a")), corpus.pair_words(F.concat_ws(" ", "a", "b"))
    return _pairs(spark, d).select("conv_id", "turn", F.round(corpus.bigram_kept(a, b), 6).alias("kept"), corpus.polish_label(a, b).alias("label"))


def _shards(spark, d):
    p = table(spark, d, "pages")
    return p.select(F.col("page_id").alias("doc_id"), F.pmod("page_id", F.lit(7)).alias("shard"), web.hostname(F.col("url")).alias("host"), F.regexp_count("html", F.lit("<p>")).alias("paragraphs"))


def cp11_holdout(spark, d):
    return corpus.web_holdout(_shards(spark, d), 20, 300)[0].select("doc_id", "shard", "host", "paragraphs")


def cp12_train_pages(spark, d):
    docs = _shards(spark, d)
    return corpus.train_pages(docs, docs.filter("doc_id % 10 = 0").select("host"), 50).select("doc_id", "host", "rank")


def cp13_seeds(spark, d):
    return corpus.make_seeds(frames.blocks(spark, d).select("doc_id", "source", "text"), 10)


def cp14_sample(spark, d):
    return corpus.eval_sample(frames.labelled(spark, d), {"human": 60, "machine": 20, "mixed": 10}).select("doc_id", "label", "source")


def cp15_plan(spark, d):
    seeds = documents(spark, d).select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("group"))
    return corpus.plan_jobs(seeds, ["r0", "r1", "r2"], 100, 20)


def jn3_pending(spark, d):
    plan = cp15_plan(spark, d)
    split, label = corpus.holdout_flag(F.col("mode"), F.col("route"), ("r1",))
    return corpus.pending_jobs(plan, plan.filter("route = 'r0'").select("key")).withColumn("split", split).withColumn("label", label)


def cp17_report(spark, d):
    return corpus.corpus_report(frames.labelled(spark, d), "source", "label", list(CLASSES))


# -- joins


def jn1_splice(spark, d):
    rows = frames.labelled(spark, d)
    return corpus.splice(rows.filter("label = 'human'").select("source", "text"), rows.filter("label = 'machine'").select("source", "text"), "source").select("source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def jn2_unseen(spark, d):
    docs = _shards(spark, d)
    return corpus.unseen_hosts(docs, docs.filter("doc_id % 10 = 0").select("host")).select("doc_id", "host")


def jn4_originals(spark, d):
    """Every other conversation has its originals: there, the question with the answer after it is held against the question."""
    p = _pairs(spark, d).withColumn("group", F.concat_ws(":", "conv_id", "turn"))
    rewrites = p.select("group", F.concat_ws(" ", "a", "b").alias("text"))
    return corpus.polish_originals(rewrites, p.filter("conv_id % 2 = 0").select("group", F.col("a").alias("human"))).select("group", "label")


def jn5_score_back(spark, d):
    docs = documents(spark, d)
    scores = corpus.distinct_texts(docs).select("key", F.length("text").alias("n"))
    return corpus.score_back(docs, scores).select("doc_id", "n")


def jn6_with_lm(spark, d):
    e = table(spark, d, "embeddings")
    base = e.select("vec_id", F.slice(F.col("embedding"), 1, 56).alias("vector"))
    return corpus.with_lm(base, e.select("vec_id", F.slice(F.col("embedding"), 57, 8).alias("lm")), "vec_id").select("vec_id", F.size("vector").alias("n"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


def jn7_rule_names(spark, d):
    """All rules' values of all documents, with the rules' names and kinds."""
    rules = spark.createDataFrame([(r, f"rule {r}", "statistical" if r in spans.STATISTICAL else "shown") for r in features.RULES], "id string, name string, tier string")
    return corpus.rule_names(queries_text.rules_all(spark, d), rules)


def fx3_incremental(spark, d):
    docs = documents(spark, d)
    compute = lambda x: x.select("key", F.length("text").alias("n"))
    store = compute(corpus.distinct_texts(docs.filter("doc_id % 3 = 0"))).withColumn("spec", F.lit(1))
    return corpus.featurize_incremental(docs, store, compute, 1)


# -- training


def tr1_standardise(spark, d):
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    out, _ = training.standardise(e, F.pmod("vec_id", F.lit(3)) == 0, "v", 64)
    return out.select("vec_id", *[F.round(F.col("v")[i], 5).alias(f"v{i}") for i in range(64)])


def tr2_weights(spark, d):
    rows = frames.labelled(spark, d).select("doc_id", "label", "modern", T.count_space_words(F.col("text")).alias("n_words"), corpus.hash_split(F.col("doc_id").cast("string"), "md5").alias("split"))
    return training.row_weights(rows, 2.0).select("doc_id", F.round("weight", 6).alias("weight"))


def tr3_logistic(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), frames.pick(CLASSES, F.col("label")).alias("label"))
    model = training.fit_logistic(rows, "vector", iterations=20)
    data = rows.select("vec_id", "label", training.array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return model.transform(data).select("vec_id", "label", frames.pick(CLASSES, F.col("prediction").cast("int")).alias("pred"))


def tr4_mlp(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), frames.pick(CLASSES, F.col("label")).alias("label"), F.lit(1.5).alias("w"))
    model = training.fit_mlp(rows, "vector", 64, hidden=(16,), weight="w", iterations=20)
    data = rows.select("vec_id", "label", training.array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    return model.transform(data).select("vec_id", "label", frames.pick(CLASSES, F.col("prediction").cast("int")).alias("pred"))


def tr5_ensemble(spark, d):
    rows = frames.scored(spark, d).withColumn("b", F.transform("logits", lambda x: x * 2)).withColumn("c", F.transform("logits", lambda x: x + 3))
    mean = training.ensemble_mean(rows, ["logits", "b", "c"])
    return mean.select("vec_id", *[F.round(F.col("logits")[i], 6).alias(f"z{i}") for i in range(3)])


def tr6_temperature(spark, d):
    return rounded(training.fit_temperature(frames.scored(spark, d)))


def tr7_vector_scaling(spark, d):
    scale, shift = training.fit_vector_scaling(frames.scored(spark, d))
    z = F.array(*[F.col("logits")[i] * scale[i] + shift[i] for i in range(3)])
    return frames.scored(spark, d).select("vec_id", scoring.softmax(z).alias("probs"))


def tr8_feedback(spark, d):
    fb = frames.feedback(spark, d).withColumn("vector", F.array(F.lit(0.0), F.col("p")))
    base = fb.limit(0).select("vector", "label", F.lit("train").alias("split"), F.lit(0).alias("n_words"))
    return training.add_feedback(base, fb, 2).select("label", F.col("vector")[1].alias("p"), "split", "n_words")


def tr9_thresholds(spark, d):
    return rounded(evaluation.choose_thresholds(frames.scored(spark, d), [x / 20 for x in range(7, 20)], [x / 20 for x in range(14, 20)], 0.2, 0.9))


def tr10_rates(spark, d):
    hits = frames.scored(spark, d).select("label", F.explode(F.array(*[F.struct(F.lit(f"r{i}").alias("rule"), F.col("probs")[i].alias("value")) for i in range(3)])).alias("x")).select("label", "x.*")
    return rounded(training.rule_weights(hits).drop("weight"))


def tr11_ablate(spark, d):
    return training.ablate(frames.scored(spark, d), "logits", [1]).select("vec_id", *[F.col("logits")[i].alias(f"z{i}") for i in range(3)])


def tr12_catch(spark, d):
    return rounded(training.val_catch(frames.scored(spark, d).withColumn("score", F.col("p_machine")), 0.9))


# -- scoring


def untrained(dim: int = 64) -> scoring.Network:
    return scoring.Network.random((dim, 32, 16, 3), seed=5)


def sc1_mlp(spark, d):
    return scoring.score_mlp(table(spark, d, "embeddings").select("vec_id", "embedding"), untrained(), "embedding").select("vec_id", "logits")


def tr4_network(spark, d):
    """A network fitted to two thirds of the vectors and scored on all of them in its rounded form."""
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), frames.pick(CLASSES, F.col("label")).alias("label"), frames.pick(("train", "val", "test"), F.col("vec_id")).alias("split"), (F.pmod("vec_id", F.lit(200)) + 10).cast("int").alias("n_words"), (F.pmod("vec_id", F.lit(2)) == 0).alias("modern"))
    fitted = network.fit_network(rows, "vector", 64, hidden=(32, 16), modern_weights=(1.0, 2.0), seeds=(0, 1), members=2, steps=25)
    scored = scoring.score_mlp(rows, fitted.network).withColumn("probs", scoring.softmax(F.col("logits")))
    return scored.select("vec_id", "split", "label", *[F.round(F.col("probs")[i], 4).alias(f"p_{c}") for i, c in enumerate(CLASSES)])


def sc2_softmax(spark, d):
    return frames.scored(spark, d).select("vec_id", *[F.round(scoring.softmax(F.col("logits"), 2.0)[i], 6).alias(f"p{i}") for i in range(3)])


def _decided(spark, d):
    rows = frames.scored(spark, d).drop("p", "decision").withColumn("n_words", F.pmod("vec_id", F.lit(60)).cast("int")).withColumn("english", F.pmod("vec_id", F.lit(9)) != 0)
    return scoring.decide(rows, 0.5, 0.7)


def sc3_decide(spark, d):
    return _decided(spark, d).select("vec_id", "top", "decision", F.round("p", 6).alias("p"), "bar")


def sc4_explain(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"), frames.pick(evaluation.DECISIONS, F.col("vec_id")).alias("decision"))
    return scoring.explain(rows, untrained(), ["vec_id"], tuple(f"f{i}" for i in range(36)))


def sc5_reading(spark, d):
    return scoring.reading(_decided(spark, d)).select("vec_id", "verdict", F.col("label").alias("shown"), F.round("confidence", 6).alias("confidence"), "skipped", F.size("reasons").alias("n_reasons"))


def sc5_reasons(spark, d):
    """Readings of documents by an untrained network, with the rules that push and their spans."""
    phrases, openers = queries_text.TEST_PHRASES, queries_text.TEST_OPENERS
    rows = features.extract_features(documents(spark, d).select("doc_id", "text"), "text", phrases, openers)
    model = untrained(len(features.FEATURE_NAMES))
    read = scoring.decide(scoring.score_mlp(rows, model).withColumn("probs", scoring.softmax(F.col("logits"))), 0.5, 0.7).drop("logits")
    path = scratch(spark)
    read.withColumnRenamed("text", "body").write.parquet(path)
    found = spark.read.parquet(path)  # scored once, for the reasons and for what they join

    def find(rows, called):
        return spans.located(rows, "body", called).withColumn("hits", spans.rule_hit_structs(phrases, openers, called))

    # readings that are skipped show no reasons
    pushes = scoring.explain(found.filter((F.col("n_words") >= T.MIN_WORDS) & F.col("english")), model, ["doc_id"], features.RULES)
    read = scoring.reading(scoring.reasons(found, pushes, ["doc_id"], hits="hits", find=find), "reasons")
    return read.select("doc_id", "verdict", "label", "confidence", "skipped", F.transform("reasons", lambda r: F.struct(r["id"], F.size(r["spans"]).alias("n_spans"))).alias("reasons"))


def sc7_summary(spark, d):
    return scoring.file_summary(scoring.reading(_decided(spark, d)), ["source"])


def sc8_distribution(spark, d):
    return scoring.distribution(_decided(spark, d), ["source"])


def sc9_diff(spark, d):
    return scoring.word_diff(_pairs(spark, d), "a", "b").select("conv_id", "turn", "diff")


def sc10_rewrite(spark, d):
    reply = F.concat("text", F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(F.lit("\nRemoved: r-00"), F.pmod("doc_id", F.lit(9)).cast("string"), F.lit(", r-010"))).otherwise(""))
    x = scoring.parse_rewrite(reply)
    return documents(spark, d).select("doc_id", F.md5(x["text"].cast("binary")).alias("text_md5"), F.array_join(x["removed"], ",").alias("removed"))


def lm2_features(spark, d):
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 50).alias("para"), F.pmod("vec_id", F.lit(50)).alias("pos"), F.array(*[F.round(F.abs(F.col("embedding")[i].cast("double")), 4) for i in range(4)]).alias("x"))
    stats = e.select("para", "pos", (-F.col("x")[0]).alias("observed"), F.col("x")[1].alias("entropy"), F.col("x")[2].alias("variance"), (F.floor(F.col("x")[3] * 40) + 1).cast("int").alias("rank"))
    return lm.lm_features(stats, ["para"]).select("para", *[F.round(F.col("lm")[i], 5).alias(f"l{i}") for i in range(8)])


def lm1_stats(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("logits"), F.pmod("vec_id", F.lit(64)).cast("int").alias("next_token"))
    return lm.token_stats(e, ["vec_id"]).select("vec_id", *[F.round(c, 5).alias(c) for c in ("observed", "entropy", "variance")], "rank")


# -- evaluation


def ev1_confusion(spark, d):
    return evaluation.confusion(frames.scored(spark, d))


def ev1_scores(spark, d):
    s = frames.scored(spark, d)
    a, f, e, m = evaluation.accuracy(s), evaluation.macro_f1(s), evaluation.ece(s), evaluation.false_machine_rate(s)
    g = evaluation.ece_decided(s).withColumnRenamed("ece", "ece_decided")
    out = a
    for part in (f, e, m, g):  # a row each
        out = out.join(F.broadcast(part), F.lit(True))
    return rounded(out)


def ev4_reliability(spark, d):
    return rounded(evaluation.reliability(frames.scored(spark, d)))


def ev5_auroc(spark, d):
    return rounded(evaluation.auroc(frames.scored(spark, d).withColumn("s", F.round(F.col("p_machine") + F.col("p_mixed"), 4)), "s", F.col("label") != "human"))


def ev7_outcome(spark, d):
    s = frames.scored(spark, d)
    return rounded(evaluation.outcome(s).join(F.broadcast(evaluation.calls(s)), F.lit(True)))


def ev8_by_source(spark, d):
    return rounded(evaluation.by_source(frames.scored(spark, d)))


GRID = [0.4, 0.5, 0.6, 0.8, 0.95]


def ev9_curves(spark, d):
    return rounded(evaluation.decision_curves(frames.scored(spark, d), GRID))


def ev10_wilson(spark, d):
    by = frames.scored(spark, d).groupBy("source").agg(F.avg((F.col("label") == F.col("pred")).cast("double")).alias("share"), F.count("*").cast("double").alias("n"))
    return by.select("source", F.round(evaluation.wilson_low(F.col("share"), F.col("n")), 6).alias("low"))


def _two(spark, d):
    s = frames.scored(spark, d)
    p2 = F.round(F.least(F.col("p") + 0.05, F.lit(1.0)), 6)
    return s.select("vec_id", "label", F.col("p").alias("p_old"), F.col("pred").alias("pred_old"), p2.alias("p_new"), F.when(F.pmod("vec_id", F.lit(4)) == 0, F.col("label")).otherwise(F.col("pred")).alias("pred_new"), F.col("decision").alias("decision_old"), F.when(F.pmod("vec_id", F.lit(4)) == 0, F.col("label")).otherwise(F.col("decision")).alias("decision_new"))


def ev11_gate(spark, d):
    return rounded(evaluation.retrain_gate(_two(spark, d)))


def ev12_compare(spark, d):
    return rounded(evaluation.compare_models(_two(spark, d)))


def ev13_study(spark, d):
    return evaluation.stratified_study_sample(frames.scored(spark, d).withColumn("stratum", F.col("label")), {"human": 0.4, "machine": 0.35, "mixed": 0.25}, 40, "vec_id").select("vec_id", "stratum")


def ev14_systems(spark, d):
    s = frames.scored(spark, d)
    long = s.select(F.lit("a").alias("system"), (F.pmod("vec_id", F.lit(4)) == 0).alias("adversarial"), F.col("label").alias("label_group"), F.col("source").alias("site"), "label", "decision")
    both = long.unionByName(long.withColumn("system", F.lit("b")).withColumn("decision", F.when(F.col("decision") == "unsure", "human").otherwise(F.col("decision"))))
    return rounded(evaluation.summarise_systems(both))


def ev15_curve(spark, d):
    return rounded(evaluation.abstention_curve(frames.scored(spark, d)))


def ev15_closest(spark, d):
    return rounded(evaluation.closest_point(evaluation.abstention_curve(frames.scored(spark, d)), 0.3))


def ev16_bootstrap(spark, d):
    t = _two(spark, d)
    flags = t.select((F.col("decision_old") != "unsure").alias("called_a"), (F.col("decision_old") == F.col("label")).alias("hit_a"), (F.col("decision_new") != "unsure").alias("called_b"), (F.col("decision_new") == F.col("label")).alias("hit_b"))
    return evaluation.bootstrap_gap(flags)


def ev17_latency(spark, d):
    return evaluation.index_percentiles(table(spark, d, "events").select("event_type", "value"), "value", ["event_type"])


def ev18_delta(spark, d):
    s = frames.scored(spark, d)
    return rounded(evaluation.max_abs_delta(s, s.withColumn("probs", F.transform("probs", lambda x: x * 0.9)), "vec_id", "probs"))


# -- feedback


def fb1_valid(spark, d):
    fb = frames.feedback(spark, d).withColumn("vector", F.when(F.pmod("id", F.lit(10)) == 0, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.col("p"))))
    fb = fb.withColumn("p", F.when(F.pmod("id", F.lit(7)) == 0, F.col("p") + 2).otherwise(F.col("p"))).withColumn("site_class", F.when(F.pmod("id", F.lit(9)) == 0, "moon").otherwise("blog")).withColumn("spec", F.lit(1))
    return feedback.valid_correction(fb, 2)


def fb1_reasons(spark, d):
    return fb1_valid(spark, d).select("id", "reason")


def fb2_batches(spark, d):
    uuid = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("user_id").cast("string"), 12, "0"))
    return feedback.valid_batches(fb1_valid(spark, d).select(F.floor(F.col("id") / 3).alias("batch"), uuid.alias("install_id"), "reason"), 50)


def fb3_reliability(spark, d):
    return rounded(feedback.reliability_by_decision(frames.feedback(spark, d)))


def fb5_weeks(spark, d):
    return rounded(feedback.unsure_by_week(frames.feedback(spark, d)))


def fb6_snapshot(spark, d):
    s = feedback.calibration_snapshot(frames.feedback(spark, d), "1.0.1")
    whole, none = s.select("n", F.round("ece", 6).alias("ece"), "bins", "unsure_by_week"), F.lit(None)
    cells = whole.select("n", "ece", F.explode("bins").alias("name", "cells")).select("n", "ece", "name", F.explode("cells").alias("c"))
    cells = cells.select("n", "ece", "name", F.col("c.bin").alias("bin"), F.round("c.mean_p", 6).alias("mean"), F.round("c.observed", 6).alias("observed"), F.col("c.n").alias("rows"))
    weeks = whole.select("n", "ece", F.explode("unsure_by_week").alias("w")).select("n", "ece", F.col("w.week").alias("name"), none.cast("int").alias("bin"), F.round("w.unsure_rate", 6).alias("mean"), none.cast("double").alias("observed"), F.col("w.n").alias("rows"))
    return cells.unionByName(weeks)


def _calls(spark, d):
    e = table(spark, d, "events")
    key = F.concat(F.lit("u"), F.pmod("user_id", F.lit(20)).cast("string"))
    base = e.select(F.col("event_id").alias("call_id"), "ts", key.alias("key"), F.date_format("ts", "yyyy-MM-dd").alias("period"), (F.pmod("event_id", F.lit(3)) + 1).alias("amount"))
    return base.withColumn("scope", F.lit("user")).unionByName(base.withColumn("scope", F.lit("all")).withColumn("key", F.lit("*")))


def _limits(spark, d):
    return table(spark, d, "nation").filter("n_nationkey < 2").select(F.when(F.col("n_nationkey") == 0, "user").otherwise("all").alias("scope"), F.when(F.col("n_nationkey") == 0, 20).otherwise(400).cast("long").alias("limit"))


def fb7_spend(spark, d):
    return feedback.spend(_calls(spark, d), _limits(spark, d)).select("call_id", "scope", "key", "period", "running", "within", "allowed")


def fb8_merge(spark, d):
    used = _calls(spark, d).select("scope", "key", "period", F.col("amount").alias("n"))
    return feedback.merge_usage(used.filter("n = 1"), used.filter("n <> 1"))


def fb9_keys(spark, d):
    forwarded = F.when(F.pmod("event_id", F.lit(5)) == 0, "").otherwise(F.concat(F.lit(" 10.0.0."), F.pmod("user_id", F.lit(250)).cast("string"), F.lit(", 1.1.1.1")))
    return table(spark, d, "events").select("event_id", feedback.hash_key(forwarded, "salt").alias("key"))


def flagship(spark, d):
    """Distinct lines of enough words, their features, scores and decisions, brought back to documents and rolled up."""
    lines = T.split_lines_min_words(documents(spark, d), "text", ["doc_id"])
    # features cost far more than moving their texts, so small inputs are dealt to all cores too
    unique = features.extract_features(corpus.distinct_texts(lines).repartition(spark.sparkContext.defaultParallelism * 2, "key"), "text")
    scored = scoring.score_mlp(unique, scoring.Network.random((176, 224, 64, 3), seed=3)).withColumn("probs", scoring.softmax(F.col("logits")))
    read = scoring.reading(scoring.decide(scored, 0.5, 0.6)).select("key", "decision", "skipped")
    return scoring.file_summary(corpus.score_back(lines, read), ["doc_id"])


_NWORDS = "(CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) END)"
_SQL_WORDS = lambda x: f"list_transform(regexp_extract_all({x}, '[A-Za-z\\x{{00C0}}-\\x{{024F}}]+(?:[''\\x{{2019}}][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*'), lambda w: lower(w))"
_PAIR = lambda w: f"list_distinct(list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_SHARDS = "shards AS (SELECT page_id AS doc_id, page_id % 7 AS shard, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host, len(regexp_extract_all(html, '<p>')) AS paragraphs FROM pages)"
_PAIRS = "pairs AS (SELECT u.conv_id, u.turn, u.text AS a, v.text AS b FROM conversations u JOIN conversations v ON u.conv_id = v.conv_id AND v.turn = u.turn + 1 WHERE u.role = 'user' AND v.role = 'assistant' AND u.text IS NOT NULL AND v.text IS NOT NULL)"
_PAIR_WORDS = lambda x: f"regexp_extract_all(lower({x}), '[a-z0-9'']+')"
_KEPT = lambda o, r: f"CASE WHEN len({_PAIR(r)}) > 0 THEN len(list_intersect({_PAIR(r)}, {_PAIR(o)})) / len({_PAIR(r)}) ELSE 0 END"
_P = lambda g: f"(CAST('0x' || substr(md5({g}), 1, 8) AS BIGINT) % 100)"
_SPLIT = lambda g: f"CASE WHEN {_P(g)} < 15 THEN 'test' WHEN {_P(g)} < 25 THEN 'val' ELSE 'train' END"
_RATE = lambda t, among="TRUE": f"round(avg(CAST({t} AS INTEGER)) FILTER ({among}), 6)"
_PLAN = """plan AS (SELECT g AS "group", mode, route, concat_ws(':', g, mode, route) AS key FROM (
  SELECT g, CASE WHEN m < 9 THEN 'plain' WHEN m < 11 THEN 'antitell' WHEN m < 14 THEN 'humanize' WHEN m < 16 THEN 'rewrite' ELSE 'polish' END AS mode, 'r' || CAST(r AS VARCHAR) AS route FROM (
    SELECT g, CAST('0x' || substr(h, 1, 8) AS BIGINT) % 20 AS m, CAST('0x' || substr(h, 9, 8) AS BIGINT) % 3 AS r, row_number() OVER (ORDER BY h, g) AS n
    FROM (SELECT 'g' || CAST(doc_id AS VARCHAR) AS g, sha1('g' || CAST(doc_id AS VARCHAR)) AS h FROM documents)) WHERE n > 20 AND n <= 120))"""
_BIN10 = "least(greatest(ceil(p * 10) - 1, 0), 9)"
_ECE = lambda src, hit, where="TRUE": f"(SELECT round(sum(n * abs(p - h)) / sum(n), 6) FROM (SELECT count(*) AS n, avg(p) AS p, avg(CAST({hit} AS INTEGER)) AS h FROM {src} WHERE {where} GROUP BY {_BIN10}))"
_F1 = " + ".join(f"2.0 * count(*) FILTER (label = '{c}' AND pred = '{c}') / greatest(count(*) FILTER (label = '{c}') + count(*) FILTER (pred = '{c}'), 1)" for c in CLASSES)
_DECIDED = """decided AS (SELECT *, CASE WHEN p0 < CASE WHEN top = 'machine' THEN 0.7 ELSE 0.5 END OR n_words < 25 OR NOT english THEN 'unsure' ELSE top END AS d2 FROM (
  SELECT vec_id, source, pred AS top, p AS p0, vec_id % 60 AS n_words, vec_id % 9 <> 0 AS english FROM scored))"""
_SKIP = "CASE WHEN n_words < 25 THEN 'too-short' WHEN NOT english THEN 'not-english' END"
_TWO = """two AS (SELECT vec_id, label, p AS p_old, pred AS pred_old, round(least(p + 0.05, 1.0), 6) AS p_new, CASE WHEN vec_id % 4 = 0 THEN label ELSE pred END AS pred_new,
  decision AS decision_old, CASE WHEN vec_id % 4 = 0 THEN label ELSE decision END AS decision_new FROM scored)"""
_CALLS = """calls AS (SELECT event_id AS call_id, ts, s AS scope, CASE WHEN s = 'user' THEN 'u' || CAST(user_id % 20 AS VARCHAR) ELSE '*' END AS key, strftime(ts, '%Y-%m-%d') AS period, event_id % 3 + 1 AS amount
  FROM events, (VALUES ('user'), ('all')) t(s))"""
_CHECKED = """SELECT id, user_id, CASE WHEN id % 10 = 0 THEN 'vector' WHEN NOT (CASE WHEN id % 7 = 0 THEN p + 2 ELSE p END BETWEEN 0 AND 1) THEN 'p' WHEN id % 9 = 0 THEN 'site_class' END AS reason FROM feedback"""


def _compare_sql() -> str:
    metrics = {
        "unsure": ("{d} = 'unsure'", "TRUE", 1), "accuracy": ("{d} = label", "{d} <> 'unsure'", -1), "human_called_machine": ("{d} = 'machine'", "label = 'human'", 1), "human_recall": ("{d} = 'human'", "label = 'human'", -1),
        "machine_recall": ("{d} = 'machine'", "label = 'machine'", -1), "mixed_recall": ("{d} = 'mixed'", "label = 'mixed'", -1), "machine_called_human": ("{d} = 'human'", "label = 'machine'", 1), "mixed_precision": ("label = 'mixed'", "{d} = 'mixed'", -1),
    }
    one = []
    for m, (t, among, sign) in metrics.items():
        avg = lambda s: f"avg(CAST({t.format(d='decision_' + s)} AS INTEGER)) FILTER ({among.format(d='decision_' + s)})"  # noqa: E731, B023
        one.append(f"SELECT '{m}' AS metric, {avg('old')} AS o, {avg('new')} AS w, {sign} AS sign FROM two")
    return f"WITH {SCORED}, {_TWO} SELECT metric, round(o, 6) AS old, round(w, 6) AS new, round(w - o, 6) AS change, sign * (w - o) > 0 AS worse FROM (" + " UNION ALL ".join(one) + ")"


def _curves_sql() -> str:
    parts = []
    for t in GRID:
        called = f"p >= CASE WHEN pred = 'machine' THEN {max(t, 0.9)} ELSE {t} END"
        parts.append(f"SELECT {t}::DOUBLE AS threshold, {_RATE(f'NOT ({called})')} AS unsure, {_RATE('pred = label', called)} AS accuracy, {_RATE(f'''pred = 'machine' AND {called}''', '''label = 'human' ''')} AS human_called_machine FROM scored")
    return f"WITH {SCORED} " + " UNION ALL ".join(parts)


def _systems_sql() -> str:
    shares = ", ".join(f"{_RATE(f'''decision = '{c}' ''')} AS share_{c}" for c in evaluation.DECISIONS)
    return f"""WITH {SCORED}, long AS (SELECT x AS system, vec_id % 4 = 0 AS adversarial, label AS label_group, source AS site, label, CASE WHEN x = 'b' AND decision = 'unsure' THEN 'human' ELSE decision END AS decision FROM scored, (VALUES ('a'), ('b')) t(x))
SELECT system, adversarial, label_group, site, count(*) AS n, {_RATE("decision = 'unsure'")} AS unsure, {_RATE("decision = label", "decision <> 'unsure'")} AS accuracy, {shares}
FROM long GROUP BY GROUPING SETS ((system), (system, adversarial), (system, label_group), (system, site))"""


_CURVE = """curve AS (SELECT round(0.33 + 0.02 * i, 2) AS threshold, round(1 - sum(c) OVER w / (SELECT count(*) FROM scored), 6) AS abstained, round(CASE WHEN sum(c) OVER w > 0 THEN sum(h) OVER w / sum(c) OVER w END, 6) AS accuracy, CAST(sum(c) OVER w AS BIGINT) AS called
  FROM (SELECT g.i, coalesce(c, 0) AS c, coalesce(h, 0) AS h FROM range(0, 34) g(i) LEFT JOIN (SELECT least(floor((p - 0.33) / 0.02 + 1e-9), 33) AS i, count(*) AS c, count(*) FILTER (label = pred) AS h FROM scored GROUP BY 1) k ON g.i = k.i)
  WINDOW w AS (ORDER BY i DESC))"""
_TAUS = f"""grid AS (SELECT tm.x / 20 AS tau_machine, t.x / 20 AS tau FROM range(14, 20) tm(x), range(7, 20) t(x)), tried AS (
  SELECT tau_machine, tau, count(*) FILTER (c) AS n, count(*) FILTER (c AND label = pred) AS hits, count(*) FILTER (c AND pred = 'machine' AND label = 'human') / greatest(count(*) FILTER (label = 'human'), 1) AS hcm, count(*) AS total
  FROM (SELECT *, p >= CASE WHEN pred = 'machine' THEN tau_machine ELSE tau END AS c FROM grid, scored) GROUP BY 1, 2),
good AS (SELECT *, 1 - n / total AS unsure, row_number() OVER (PARTITION BY tau_machine ORDER BY tau) AS k FROM tried WHERE n > 0 AND hcm <= 0.9 AND ((hits / n + 3.8416 / (2 * n)) - 1.96 * sqrt(hits / n * (1 - hits / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n) >= 0.2)
SELECT tau_machine, tau, round(unsure, 6) AS unsure FROM good WHERE k = 1 ORDER BY good.unsure, tau_machine LIMIT 1"""
_TEMPS = ", ".join(repr(t) for t in training.TEMPERATURES)

QUERIES = {f.__name__: f for f in (
    io2_columns, io6_feedback, io8_stamp, cp1_split, cp1_split_crc, cp3_cap, cp4_band, cp6_replies, cp7_latest, cp8_top, cp9_family, cp10_polish, cp11_holdout, cp12_train_pages, cp13_seeds, cp14_sample, cp15_plan, jn3_pending, cp17_report,
    jn1_splice, jn2_unseen, jn4_originals, jn5_score_back, jn6_with_lm, jn7_rule_names, fx3_incremental, tr1_standardise, tr2_weights, tr3_logistic, tr4_mlp, tr4_network, tr5_ensemble, tr6_temperature, tr7_vector_scaling, tr8_feedback, tr9_thresholds, tr10_rates,
    tr11_ablate, tr12_catch, sc1_mlp, sc2_softmax, sc3_decide, sc4_explain, sc5_reading, sc5_reasons, sc7_summary, sc8_distribution, sc9_diff, sc10_rewrite, lm1_stats, lm2_features, ev1_confusion, ev1_scores, ev4_reliability, ev5_auroc, ev7_outcome, ev8_by_source,
    ev9_curves, ev10_wilson, ev11_gate, ev12_compare, ev13_study, ev14_systems, ev15_curve, ev15_closest, ev16_bootstrap, ev17_latency, ev18_delta, fb1_reasons, fb2_batches, fb3_reliability, fb5_weeks, fb6_snapshot, fb7_spend, fb8_merge, fb9_keys, flagship,
)}
SQL = {
    "io2_columns": "SELECT doc_id, lang FROM documents", "io6_feedback": f"WITH {FEEDBACK} SELECT id, predicted, label, p FROM feedback WHERE id % 2 = 1", "io8_stamp": "SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents",
    "cp1_split": f"SELECT doc_id, split, CASE WHEN doc_id % 11 = 0 THEN 'web' WHEN doc_id % 5 = 0 AND split = 'test' THEN 'adv' ELSE split END AS final FROM (SELECT doc_id, {_SPLIT('g')} AS split FROM (SELECT doc_id, 'g' || CAST(doc_id AS VARCHAR) AS g FROM documents))",
    "cp3_cap": f"SELECT doc_id, source, lang FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY {ORDER('cap', 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 8",
    "cp4_band": f"SELECT doc_id, source IN ('src3', 'src4') OR source LIKE 'src1%' AS modern FROM documents WHERE {_NWORDS} BETWEEN 60 AND 400",
    "cp6_replies": f"""SELECT conv_id, turn, paragraphs FROM (SELECT *, coalesce(sum(paragraphs) OVER (ORDER BY {ORDER('', 'conv_id', 'turn')}, conv_id, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (
  SELECT conv_id, turn, CAST(len(list_filter(string_split_regex(text, '\\n\\s*\\n'), lambda x: trim(x) <> '')) AS INTEGER) AS paragraphs FROM conversations WHERE turn < 4 AND role = 'assistant' AND text IS NOT NULL AND NOT regexp_matches(text, '{T.CODE.replace('(?md)', '(?m)')}'))) WHERE before < 100""",
    "cp7_latest": f'WITH {GENERATIONS} SELECT key, "group", source, model FROM (SELECT *, row_number() OVER (PARTITION BY "group", source, model ORDER BY seq DESC) AS r FROM generations) WHERE r = 1',
    "cp8_top": f"""WITH {GENERATIONS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "group", source, model ORDER BY seq DESC) AS r FROM generations) WHERE r = 1)
SELECT key, "group", source FROM (SELECT *, row_number() OVER (PARTITION BY "group", source ORDER BY {ORDER('top', '"group"', 'model')}, text) AS k FROM latest) WHERE k <= 2""",
    "cp9_family": f"""WITH {GENERATIONS}, u AS (SELECT DISTINCT key, model FROM generations) SELECT key, model FROM (SELECT *, row_number() OVER (PARTITION BY string_split(model, '/')[1] ORDER BY {ORDER('family', 'key')}, key) AS r FROM u) WHERE r <= (SELECT CAST(floor(0.2 * count(*)) AS BIGINT) FROM u)""",
    "cp10_polish": f"""WITH {_PAIRS}, w AS (SELECT conv_id, turn, {_PAIR_WORDS('a')} AS o, {_PAIR_WORDS("a || ' ' || b")} AS r FROM pairs), k AS (SELECT conv_id, turn, {_KEPT('o', 'r')} AS kept FROM w)
SELECT conv_id, turn, round(kept, 6) AS kept, CASE WHEN kept >= 0.8 THEN 'human' WHEN kept < 0.2 THEN 'machine' ELSE 'mixed' END AS label FROM k""",
    "jn1_splice": f"""WITH {LABELLED}, s AS (SELECT source, label, text, {SENTENCES} AS st FROM labelled WHERE label IN ('human', 'machine')), o AS (SELECT source, label, arg_min(st, md5(text) || text) AS st FROM s WHERE len(st) >= 2 GROUP BY source, label),
j AS (SELECT h.source, array_to_string(list_concat(h.st[1:len(h.st) // 2], m.st[len(m.st) // 2 + 1:]), ' ') AS text FROM o h JOIN o m ON h.source = m.source AND h.label = 'human' AND m.label = 'machine') SELECT source, md5(text) AS text_md5 FROM j WHERE {_NWORDS} >= 25""",
    "cp11_holdout": f"""WITH {_SHARDS}, capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY {ORDER('web', 'doc_id')}, doc_id) AS r FROM shards) WHERE r <= 20)
SELECT doc_id, shard, host, CAST(paragraphs AS INTEGER) AS paragraphs FROM (SELECT *, coalesce(sum(paragraphs) OVER (ORDER BY {ORDER('web', 'doc_id')}, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM capped) WHERE before < 300""",
    "cp12_train_pages": f"""WITH {_SHARDS} SELECT doc_id, host, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (ORDER BY {ORDER('train', 'doc_id')}, doc_id) AS r FROM shards WHERE paragraphs > 0 AND host NOT IN (SELECT host FROM shards WHERE doc_id % 10 = 0)) WHERE r <= 50""",
    "cp14_sample": f"""WITH {LABELLED}, q AS (SELECT *, CASE label WHEN 'human' THEN 60 WHEN 'machine' THEN 20 ELSE 10 END AS quota FROM labelled), h AS (SELECT *, row_number() OVER (PARTITION BY label, source ORDER BY {ORDER('eval', 'doc_id')}, doc_id) AS head FROM q),
s AS (SELECT label, count(DISTINCT source) AS n FROM q GROUP BY label), p AS (SELECT h.*, CASE WHEN head > floor(quota / n) THEN 1 ELSE 0 END AS late FROM h JOIN s ON h.label = s.label)
SELECT doc_id, label, source FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY late, {ORDER('eval', 'doc_id')}, doc_id) AS r FROM p) WHERE r <= quota""",
    "cp15_plan": f"WITH {_PLAN} SELECT * FROM plan", "jn3_pending": f"""WITH {_PLAN} SELECT *, CASE WHEN mode IN ('antitell', 'humanize') AND route = 'r1' THEN 'adv' END AS split, CASE WHEN mode = 'polish' THEN 'mixed' ELSE 'machine' END AS label FROM plan WHERE route <> 'r0'""",
    "cp17_report": f"WITH {LABELLED} SELECT source, count(*) FILTER (label = 'human') AS human, count(*) FILTER (label = 'machine') AS machine, count(*) FILTER (label = 'mixed') AS mixed FROM labelled GROUP BY source",
    "jn2_unseen": f"WITH {_SHARDS} SELECT doc_id, host FROM shards WHERE host NOT IN (SELECT host FROM shards WHERE doc_id % 10 = 0)",
    "jn4_originals": f"""WITH {_PAIRS}, w AS (SELECT p.conv_id, p.turn, {_PAIR_WORDS('s.a')} AS o, {_PAIR_WORDS("p.a || ' ' || p.b")} AS r, s.a IS NOT NULL AS known FROM pairs p LEFT JOIN pairs s ON s.conv_id = p.conv_id AND s.turn = p.turn AND s.conv_id % 2 = 0),
k AS (SELECT *, {_KEPT('o', 'r')} AS kept FROM w) SELECT conv_id || ':' || turn AS "group", CASE WHEN known THEN CASE WHEN kept >= 0.8 THEN 'human' WHEN kept < 0.2 THEN 'machine' ELSE 'mixed' END END AS label FROM k""",
    "jn5_score_back": "SELECT doc_id, CAST(length(text) AS INTEGER) AS n FROM documents", "jn6_with_lm": "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
    "jn7_rule_names": f"SELECT rule, doc_id, value, 'rule ' || rule AS name, CASE WHEN rule IN ({', '.join(repr(r) for r in spans.STATISTICAL)}) THEN 'statistical' ELSE 'shown' END AS tier FROM ({queries_text.SQL['rules_all']})",
    "fx3_incremental": "SELECT sha1(coalesce(text, '')) AS key, CAST(length(any_value(text)) AS INTEGER) AS n, CAST(1 AS INTEGER) AS spec FROM documents GROUP BY 1",
    "tr1_standardise": "WITH s AS (SELECT " + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS m{i}, stddev_pop(CAST(embedding[{i + 1}] AS DOUBLE)) AS s{i}" for i in range(64)) + " FROM embeddings WHERE vec_id % 3 = 0) SELECT vec_id, "
    + ", ".join(f"round((CAST(embedding[{i + 1}] AS DOUBLE) - m{i}) / CASE WHEN s{i} < 1e-4 THEN 1 ELSE s{i} END, 5) AS v{i}" for i in range(64)) + " FROM embeddings, s",
    "tr2_weights": f"""WITH {LABELLED}, r AS (SELECT doc_id, label, {_SPLIT('CAST(doc_id AS VARCHAR)')} AS split, CASE WHEN modern THEN 2.0 ELSE 1.0 END AS raw, {_NWORDS} AS n FROM labelled),
b AS (SELECT *, CASE WHEN n < 40 THEN 0 WHEN n < 60 THEN 1 WHEN n < 80 THEN 2 WHEN n < 120 THEN 3 WHEN n < 200 THEN 4 ELSE 5 END AS bucket FROM r)
SELECT doc_id, round(least(raw * count(*) OVER (PARTITION BY split, bucket) / (3 * sum(raw) OVER (PARTITION BY split, bucket, label)), 10.0), 6) AS weight FROM b""",
    "tr5_ensemble": f"WITH {SCORED} SELECT vec_id, " + ", ".join(f"round((logits[{i}] + logits[{i}] * 2 + logits[{i}] + 3) / 3, 6) AS z{i - 1}" for i in (1, 2, 3)) + " FROM scored",
    "tr6_temperature": f"""WITH {SCORED}, t AS (SELECT unnest(CAST([{_TEMPS}] AS DOUBLE[])) AS temperature), l AS (SELECT temperature, avg(-ln(greatest(exp((logits[list_position({frames.sql_list(CLASSES)}, label)] - list_max(logits)) / temperature) / list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / temperature))), 1e-12))) AS loss FROM scored, t GROUP BY temperature)
SELECT round(temperature, 6) AS temperature, round(loss, 6) AS loss FROM l ORDER BY l.loss, l.temperature LIMIT 1""",
    "tr8_feedback": f"""WITH {FEEDBACK}, r AS (SELECT label, p, row_number() OVER (ORDER BY created_at, id) AS k, count(*) OVER () AS n FROM feedback) SELECT label, p, CASE WHEN k <= floor(0.8 * n) THEN 'train' ELSE 'fresh' END AS split, -1 AS n_words FROM r""",
    "tr9_thresholds": f"WITH {SCORED}, {_TAUS}",
    "tr10_rates": f"WITH {SCORED}, h AS (SELECT label, 'r' || CAST(i AS VARCHAR) AS rule, probs[i + 1] AS v FROM scored, range(0, 3) t(i)) SELECT rule, {_RATE('v > 0.05', '''label = 'human' ''')} AS fire_rate_human, {_RATE('v > 0.05', '''label = 'machine' ''')} AS fire_rate_machine FROM h GROUP BY rule",
    "tr11_ablate": f"WITH {SCORED} SELECT vec_id, logits[1] AS z0, CAST(0 AS DOUBLE) AS z1, logits[3] AS z2 FROM scored",
    "tr12_catch": f"WITH {SCORED}, b AS (SELECT quantile_cont(p_machine, 0.9) AS bar FROM scored WHERE label = 'human') SELECT round(avg(CAST(p_machine > bar AS INTEGER)), 6) AS caught, round(any_value(bar), 6) AS bar FROM scored, b WHERE modern AND label = 'machine'",
    "sc2_softmax": f"WITH {SCORED} SELECT vec_id, " + ", ".join(f"round(exp(logits[{i}] / 2) / list_sum(list_transform(logits, lambda x: exp(x / 2))), 6) AS p{i - 1}" for i in (1, 2, 3)) + " FROM scored",
    "sc3_decide": f"WITH {SCORED}, {_DECIDED} SELECT vec_id, top, d2 AS decision, round(p0, 6) AS p, CAST(CASE WHEN top = 'machine' THEN 0.7 ELSE 0.5 END AS DOUBLE) AS bar FROM decided",
    "sc5_reading": f"WITH {SCORED}, {_DECIDED} SELECT vec_id, d2 AS verdict, CASE d2 WHEN 'human' THEN 'Reads human' WHEN 'machine' THEN 'Reads machine-made' WHEN 'mixed' THEN 'Reads mixed' ELSE 'Not sure' END AS shown, round(least(p0, 0.99), 6) AS confidence, {_SKIP} AS skipped, CAST(0 AS INTEGER) AS n_reasons FROM decided",
    "sc7_summary": f"WITH {SCORED}, {_DECIDED}, k AS (SELECT *, {_SKIP} IS NULL AS r FROM decided) SELECT source, count(*) FILTER (r) AS read, " + ", ".join(f"count(*) FILTER (r AND d2 = '{c}') AS {c}" for c in ("machine", "human", "mixed", "unsure")) + ", count(*) FILTER (NOT r) AS skipped, coalesce(bool_or(r AND d2 = 'machine'), false) AS any_machine FROM k GROUP BY source",
    "sc8_distribution": f"""WITH {SCORED}, {_DECIDED}, c AS (SELECT source, d2 AS decision, count(*) AS n FROM decided GROUP BY 1, 2), e AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY source) AS x, list_position(['machine', 'mixed', 'unsure', 'human'], decision) AS o FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY round(x - floor(x), 9) DESC, o) AS k, 100 - sum(floor(x)) OVER (PARTITION BY source) AS left_over FROM e) SELECT source, decision, CAST(floor(x) + CASE WHEN k <= left_over THEN 1 ELSE 0 END AS BIGINT) AS percent FROM r WHERE floor(x) + CASE WHEN k <= left_over THEN 1 ELSE 0 END > 0""",
    "sc10_rewrite": "SELECT doc_id, md5(trim(text)) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN 'r-00' || CAST(doc_id % 9 AS VARCHAR) || ',r-010' ELSE '' END AS removed FROM documents",
    "lm1_stats": """WITH z AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS z, vec_id % 64 + 1 AS t FROM embeddings), m AS (SELECT *, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS total FROM z),
l AS (SELECT vec_id, t, list_transform(z, lambda x: x - total) AS p FROM m), e AS (SELECT *, -list_sum(list_transform(p, lambda x: exp(x) * x)) AS entropy FROM l)
SELECT vec_id, round(p[t], 5) AS observed, round(entropy, 5) AS entropy, round(list_sum(list_transform(p, lambda x: exp(x) * x * x)) - entropy * entropy, 5) AS variance, CAST(1 + len(list_filter(p, lambda x: x > p[t])) AS INTEGER) AS rank FROM e""",
    "lm2_features": """WITH s AS (SELECT vec_id // 50 AS para, -round(abs(CAST(embedding[1] AS DOUBLE)), 4) AS o, round(abs(CAST(embedding[2] AS DOUBLE)), 4) AS e, round(abs(CAST(embedding[3] AS DOUBLE)), 4) AS v, floor(round(abs(CAST(embedding[4] AS DOUBLE)), 4) * 40) + 1 AS r FROM embeddings)
SELECT para, round(avg(o), 5) AS l0, round(avg(e), 5) AS l1, round((sum(o) + sum(e)) / sqrt(greatest(sum(v), 1e-6)), 5) AS l2, round(CASE WHEN sum(e) > 0 THEN -sum(o) / sum(e) ELSE 0 END, 5) AS l3, round(avg(ln(r)), 5) AS l4, round(avg(CAST(r = 1 AS INTEGER)), 5) AS l5, round(avg(CAST(r <= 10 AS INTEGER)), 5) AS l6,
  round(CASE WHEN count(*) > 1 THEN stddev_samp(o) ELSE 0 END, 5) AS l7 FROM s GROUP BY para""",
    "ev1_confusion": f"WITH {SCORED} SELECT label, pred, count(*) AS n FROM scored GROUP BY 1, 2",
    "ev1_scores": f"""WITH {SCORED} SELECT count(*) AS n, {_RATE('label = pred')} AS accuracy, round(({_F1}) / 3, 6) AS macro_f1, {_ECE('scored', 'label = pred')} AS ece, {_RATE("pred = 'machine'", "label = 'human'")} AS false_machine, {_RATE("pred = 'machine'", "label = 'machine'")} AS machine_recall, {_ECE('scored', 'decision = label', "decision <> 'unsure'")} AS ece_decided FROM scored""",
    "ev4_reliability": f"WITH {SCORED}, l AS (SELECT label, c AS class, probs[i] AS p FROM scored, (VALUES (1, 'human'), (2, 'machine'), (3, 'mixed')) t(i, c)) SELECT class, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, {_RATE('label = class')} AS observed FROM l GROUP BY 1, 2 HAVING count(*) >= 5",
    "ev5_auroc": f"""WITH {SCORED}, s AS (SELECT round(p_machine + p_mixed, 4) AS s, label <> 'human' AS pos FROM scored), r AS (SELECT pos, (rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0) AS k FROM s)
SELECT round((sum(k) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 6) AS auroc FROM r""",
    "ev7_outcome": f"""WITH {SCORED} SELECT count(*) AS n, {_RATE("decision = 'unsure'")} AS unsure, {_RATE("decision = label", "decision <> 'unsure'")} AS accuracy, {_RATE("decision = 'machine'", "label = 'human'")} AS human_called_machine, {_RATE("label = 'mixed'", "decision = 'mixed'")} AS mixed_precision,
  {_RATE("decision = 'machine'", "modern AND label = 'machine'")} AS modern_caught, count(*) FILTER (decision <> 'unsure') AS calls, """ + ", ".join(f"{_RATE(f'''decision = '{c}' ''')} AS called_{c}" for c in evaluation.DECISIONS) + " FROM scored",
    "ev8_by_source": f"WITH {SCORED} SELECT split, source, count(*) AS n, {_RATE('label = pred')} AS accuracy, " + ", ".join(f"{_RATE(f'''pred = '{c}' ''')} AS share_{c}" for c in CLASSES) + " FROM scored GROUP BY 1, 2",
    "ev9_curves": _curves_sql(),
    "ev10_wilson": f"WITH {SCORED}, g AS (SELECT source, avg(CAST(label = pred AS INTEGER)) AS p, count(*) AS n FROM scored GROUP BY 1) SELECT source, round(((p + 3.8416 / (2 * n)) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low FROM g",
    "ev11_gate": f"""WITH {SCORED}, {_TWO}, o AS (SELECT label, pred_old AS pred, p_old AS p FROM two), w AS (SELECT label, pred_new AS pred, p_new AS p FROM two), x AS (SELECT count(*) AS n, {_RATE("pred_old = 'machine'", "label = 'human'")} AS hcm_old, {_RATE("pred_new = 'machine'", "label = 'human'")} AS hcm_new, {_ECE('o', 'label = pred')} AS ece_old, {_ECE('w', 'label = pred')} AS ece_new FROM two)
SELECT *, n >= 50 AND ece_new < ece_old AND coalesce(hcm_new, 0) <= coalesce(hcm_old, 0) AS passes FROM x""",
    "ev12_compare": _compare_sql(),
    "ev13_study": f"WITH {SCORED} SELECT vec_id, label AS stratum FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {ORDER('study', 'vec_id')}, vec_id) AS r FROM scored) WHERE r <= CASE label WHEN 'human' THEN 16 WHEN 'machine' THEN 14 ELSE 10 END",
    "ev14_systems": _systems_sql(), "ev15_curve": f"WITH {SCORED}, {_CURVE} SELECT * FROM curve", "ev15_closest": f"WITH {SCORED}, {_CURVE} SELECT threshold, abstained, accuracy FROM curve ORDER BY abs(abstained - 0.3), threshold LIMIT 1",
    "ev17_latency": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, max(value) FILTER (i = least(floor(n * 0.5) + 1, n)) AS p50, max(value) FILTER (i = least(floor(n * 0.9) + 1, n)) AS p90 FROM r GROUP BY 1",
    "ev18_delta": f"WITH {SCORED} SELECT round(max(list_max(list_transform(probs, lambda x: abs(x - x * 0.9)))), 6) AS delta FROM scored",
    "fb1_reasons": f"WITH {FEEDBACK} SELECT id, reason FROM ({_CHECKED})", "fb2_batches": f"WITH {FEEDBACK} SELECT id // 3 AS batch, count(*) AS n, bool_and(reason IS NULL) AS accepted FROM ({_CHECKED}) GROUP BY 1",
    "fb3_reliability": f"WITH {FEEDBACK} SELECT predicted, CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, {_RATE('predicted = label')} AS observed FROM feedback WHERE predicted <> 'unsure' GROUP BY 1, 2",
    "fb5_weeks": f"WITH {FEEDBACK} SELECT strftime(created_at, '%G-W%V') AS week, count(*) AS n, {_RATE('''predicted = 'unsure' ''')} AS unsure_rate FROM feedback GROUP BY 1",
    "fb6_snapshot": f"""WITH {FEEDBACK}, f AS (SELECT * FROM feedback WHERE model_version = '1.0.1'), c AS (SELECT predicted, least(9, floor(p * 10)) AS bin, count(*) AS n, avg(p) AS m, avg(CAST(predicted = label AS INTEGER)) AS o FROM f WHERE predicted <> 'unsure' GROUP BY 1, 2)
SELECT (SELECT count(*) FROM f) AS n, (SELECT round(sum(n * abs(m - o)) / sum(n), 6) FROM c) AS ece, x.* FROM (
  SELECT predicted AS name, CAST(bin AS INTEGER) AS bin, round(m, 6) AS mean, round(o, 6) AS observed, n AS rows FROM c
  UNION ALL SELECT strftime(created_at, '%G-W%V'), NULL, {_RATE("predicted = 'unsure'")}, NULL, count(*) FROM f GROUP BY 1
) x""",
    "fb7_spend": f"""WITH {_CALLS}, r AS (SELECT *, CAST(sum(amount) OVER (PARTITION BY scope, key, period ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM calls), w AS (SELECT *, running <= CASE WHEN scope = 'user' THEN 20 ELSE 400 END AS within FROM r)
SELECT call_id, scope, key, period, running, within, bool_and(within) OVER (PARTITION BY call_id) AS allowed FROM w""",
    "fb8_merge": f"WITH {_CALLS} SELECT scope, key, period, CAST(sum(amount) AS BIGINT) AS n FROM calls GROUP BY 1, 2, 3",
    "fb9_keys": "SELECT event_id, substr(sha256('salt' || CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE '10.0.0.' || CAST(user_id % 250 AS VARCHAR) END), 1, 32) AS key FROM events",
}
