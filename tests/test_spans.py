"""Spans of rule hits: what they cut from the raw text, their number against the rules' values, and UTF-16 units."""

import math
import os

import pytest
from pyspark.sql import functions as F

from prosemill.functions import features as X
from prosemill.functions import spans as S
from prosemill.functions import text as T
from prosemill.operators import scoring
from prosemill.plans import frames, queries_text

SF = "/root/testdata/sf0.001"
#: A text for each rule, and what its spans cut out of it.
CASES = {
    "r-001": ("We will delve into a robust plan.", ["delve", "robust"]),
    "r-007": ("It rained. “Moreover, it was cold. Thus we left.", ["“Moreover", "Thus"]),
    "r-009": ("He left — she stayed -- alone 1– 2.", ["—", " -- ", "–"]),
    "r-010": ("Note: skip. The answer to all of this: a nap.", [": "]),
    "r-011": ("- **Speed:** it is fast\n**Cost**: low", ["- **Speed:**", "\n**Cost**:"]),
    "r-012": ("Seven Great Ideas\nand text below.", ["Seven Great Ideas"]),
    "r-013": ("Go \U0001f680 now ✅", ["\U0001f680", "✅"]),
    "r-014": ("It's fine. This is not just big, but huge.", ["not just big, but"]),
    "r-015": ("He said “no” and it’s \"fine\"", ["“", "”", "’"]),
    "r-016": ("Things:\n- one\n2) two\nthree", ["- one", "2) two"]),
    "r-017": ("One two three. Four five six! Seven eight nine?", ["One two three.", "Four five six!", "Seven eight nine?"]),
    "r-018": ("He quickly ate. Sadly the family left.", ["quickly", "Sadly"]),
    "r-019": ("The cake was quickly baked. We ate it.", ["The cake was quickly baked."]),
    "r-020": ("It might perhaps rain. It might not.", ["It might perhaps rain."]),
    "r-021": ("We bought apples, pears, and plums today.", ["We bought apples, pears, and plums"]),
    "r-023": ("An extraordinary circumstance.", ["extraordinary", "circumstance"]),
    "r-024": ("“In conclusion, it worked. Good.", ["In conclusion"]),
    "r-025": ("Short one. Two words. This one here is long enough. Bye.", ["Short one.", "Two words."]),
    "r-026": ("It runs from dawn to dusk, from apples to oranges.", ["from apples to oranges"]),
    "r-027": ("Here's what I know. Not much.", ["Here's what"]),
    "r-028": ("It grew, showing the need. End.", [", showing the need."]),
    "r-029": ("We tried. The result? It broke.", ["The result?"]),
    "r-030": ("They ran. They hid. We saw. We left. they slept.", ["They", "They", "they"]),
    "r-034": ("word " * 50, []),
}


def test_spans_cut_the_hits(spark):
    df = spark.createDataFrame([(r, t) for r, (t, _) in CASES.items()] + [("none", None), ("empty", ""), ("twice", "delve"), ("twice", "delve")], "id string, raw string")
    got = {}
    for x in S.span_rows(df.withColumnRenamed("raw", "body"), "body", ["id"]).orderBy("id", "rule", "pos").collect():
        got.setdefault((x["id"], x["rule"]), []).append((x["start"], x["end"], x["hit"]))
    for r, (text, want) in CASES.items():
        rows = got.get((r, r), [])
        assert [h for _, _, h in rows] == want, r
        assert all(text[a:b] == h for a, b, h in rows), r
    assert [h for _, _, h in got["twice", "r-001"]] == ["delve", "delve"] and not {"none", "empty"} & {k for k, _ in got}


def test_spans_in_utf16_units(spark):
    text = "\U0001f600\U0001f600 delve \U0001f680 “x” robust\n\n\U0001f600 two\n\nb"
    df = spark.createDataFrame([(1, text), (2, "delve")], "i int, t string")
    units = text.encode("utf-16-le")
    for x in S.span_rows(df, "t", ["i"], units="utf16").filter("i = 1").collect():
        assert units[2 * x["start"] : 2 * x["end"]].decode("utf-16-le") == x["hit"]
    rows = df.filter("i = 1").select(T.find_all(F.col("t"), "[a-z]+", "utf16").alias("s")).first()["s"]
    assert [units[2 * a : 2 * b].decode("utf-16-le") for a, b in rows] == ["delve", "x", "robust", "two", "b"]
    assert [units[2 * x["start"] : 2 * x["end"]].decode("utf-16-le") for x in T.segment_spans(df.filter("i = 1"), "t", ["i"], "utf16").orderBy("pos").collect()] == text.split("\n\n")
    assert [(x["start"], x["end"]) for x in T.segment_spans(df, "t", ["i"]).filter("i = 1").orderBy("pos").collect()] == [(0, 21), (23, 28), (30, 31)]


def test_prefix_sums(spark):
    for n in (0, 1, 63, 64, 65, 300):
        got = spark.range(1).select(S.prefix_sums(F.array(*map(F.lit, range(n))) if n else F.array().cast("array<int>")).alias("x")).first()["x"]
        assert got == [sum(range(i)) for i in range(n)]


def test_shown_spans(spark):
    rows = spark.createDataFrame([("r-001", 0, 48), ("r-001", 0, 49), ("r-018", 0, 5), ("r-025", 3, 9)], "rule string, start int, end int")
    assert sorted((x["rule"], x["end"]) for x in S.tell_spans(rows).collect()) == [("r-001", 48), ("r-025", 9)]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_span_counts_give_the_values(spark):
    """Where a rule's value comes from a count, the number of its spans gives that value on every document; spans lie in order in the text."""
    docs = frames.documents(spark, SF).select("doc_id", F.col("text").alias("body"))
    args = (queries_text.TEST_PHRASES, queries_text.TEST_OPENERS)
    parsed = X.rule_features(X.parse(docs, "body"), *args).select("doc_id", F.size("words").alias("words"), F.size("sentences").alias("sentences"), F.size("lines").alias("lines"), "rules")
    value = {x["doc_id"]: x for x in parsed.collect()}
    rows = S.span_rows(docs, "body", ["doc_id"], *args)
    assert rows.filter("end <= start or start < 0").count() == 0
    n = {(x["doc_id"], x["rule"]): x["n"] for x in rows.groupBy("doc_id", "rule").agg(F.count("*").alias("n")).collect()}
    squash = lambda x, k: 1 - math.exp(-x / k)
    per = {"word": lambda v: 100 / max(v["words"], 20), "sentence": lambda v: 1 / max(v["sentences"], 3), "line": lambda v: 1 / max(v["lines"], 1), "one": lambda v: 1, "long": lambda v: 1 / max(v["words"], 20)}
    kinds = {"word": {"r-001": 2.5, "r-002": 1, "r-003": 1, "r-004": 0.7, "r-005": 1.5, "r-006": 1, "r-008": 0.5, "r-013": 1, "r-018": 4, "r-026": 0.8, "r-031": 0.7, "r-032": 0.7, "r-033": 0.7, "r-035": 0.7, "r-038": 0.7},
             "sentence": {"r-007": 0.25, "r-009": 0.35, "r-010": 0.2, "r-014": 0.12, "r-020": 0.3, "r-021": 0.35, "r-025": 0.3, "r-028": 0.2}, "line": {"r-011": 0.2}, "one": {"r-012": 0.7, "r-029": 0.7}, "long": {"r-023": 0.12}}
    for kind, rules in kinds.items():
        for r, k in rules.items():
            for i, v in value.items():
                assert v["rules"][r] == pytest.approx(squash(n.get((i, r), 0) * per[kind](v), k), abs=1e-9), (r, i)
    for i, v in value.items():
        assert v["rules"]["r-030"] == pytest.approx((n[i, "r-030"] - 1) / (v["sentences"] - 1) if (i, "r-030") in n else 0)


def test_reasons(spark):
    """Names and spans of the called rules in order of rank; rows without any keep an empty list; skipped rows show none."""
    text = "We will delve into it. Moreover, it is so. " * 3
    df = spark.createDataFrame([(1, text, "machine", 30, True), (2, "plain words", "unsure", 2, True)], "id int, t string, decision string, n_words int, english boolean")
    found = S.located(df, "t").withColumn("hits", S.rule_hit_structs()).select("id", "decision", "n_words", "english", "hits", F.lit(0.9).alias("p"), F.array(*map(F.lit, (0.1, 0.8, 0.1))).alias("probs"))
    pushes = spark.createDataFrame([(1, 2, "r-007", 0.1, 0.5), (1, 1, "r-001", 0.4, 0.9), (1, 3, "r-022", 0.1, 0.5), (2, 1, "r-001", 0.1, 0.1)], "id int, rank int, rule string, push double, value double")
    names = spark.createDataFrame([("r-001", "stock words"), ("r-007", "openers")], "id string, name string")
    out = {x["id"]: x for x in scoring.reading(scoring.reasons(found, pushes, ["id"], names, "hits"), "reasons").collect()}
    assert [(r["id"], r["name"], [text[a:b] for a, b in r["spans"]]) for r in out[1]["reasons"]] == [("r-001", "stock words", ["delve"] * 3), ("r-007", "openers", ["Moreover"] * 3), ("r-022", "r-022", [])]
    assert out[2]["reasons"] == [] and out[2]["skipped"] == "too-short"
    assert scoring.reasons(found, pushes.limit(0), ["id"]).filter(F.size("reasons") > 0).count() == 0


def test_only_called_rules_are_looked_for(spark):
    """Hits of the rules that a row is asked for are those that it has among all rules' hits; nobody else's are looked for."""
    texts = [(1, "It’s robust. Moreover, it is probably perhaps fine. Moreover, we delve quickly into an extraordinary tapestry.", ["r-001", "r-018"]), (2, "Robust and lavish.", []), (3, None, ["r-030"]), (4, "One two. One three. One four.", ["r-030", "r-025"])]
    df = spark.createDataFrame(texts, "id int, body string, called array<string>")
    every = {r["id"]: r["h"] for r in S.located(df, "body").select("id", S.rule_hit_structs().alias("h")).collect()}
    some = S.located(df, "body", F.col("called"))
    got = {r["id"]: r for r in some.select("id", "called", "found_sentences", "found_words", S.rule_hit_structs(called=F.col("called")).alias("h")).collect()}
    assert all(got[i]["h"] == [x for x in every[i] if x["rule"] in called] for i, _, called in texts)
    assert got[1]["h"] and got[4]["h"] and got[1]["found_sentences"] is None and got[4]["found_words"] is None


def test_spans_of_some_rules(spark):
    """Rows of these rules alone, cut from the raw text, whose quotes stay as they are."""
    df = spark.createDataFrame([(1, "\U0001F680 It’s robust, and it’s a testament. The family quickly delves."), (2, None), (3, "")], "id int, body string")
    rows = lambda **x: sorted(map(tuple, S.span_rows(df, "body", ["id"], **x).collect()))
    some = rows(rules=S.SHOWN)
    assert some and some == [r for r in rows() if r[1] not in S.STATISTICAL] != rows()
    assert {"’", "robust", "testament"} <= {r[-1] for r in some}
