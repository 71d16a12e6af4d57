"""Segmenting, tokenising, rules and style on hand-written cases."""

import pytest
from pyspark.sql import functions as F

from prosemill.functions import features, web
from prosemill.functions import text as T


def col(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_segments(spark):
    df = spark.createDataFrame([(1, "one\n\n\ntwo\r\n\r\nthree"), (2, "---\n\n- x -\n \n42"), (3, ""), (4, None)], "id int, t string")
    assert [(x["id"], x["pos"], x["text"]) for x in T.segment(df, "t", ["id"]).orderBy("id", "pos").collect()] == [(1, 0, "one"), (1, 1, "two"), (1, 2, "three"), (2, 0, "- x -")]
    spans = {(x["id"], x["pos"]): (x["start"], x["end"]) for x in T.segment_spans(df, "t", ["id"]).collect()}
    assert spans == {(1, 0): (0, 3), (1, 1): (6, 9), (1, 2): (11, 16), (2, 0): (5, 10)}
    assert T.split_blank(df, "t", ["id"]).filter("id = 2").count() == 3


def test_sentences(spark):
    assert len(col(spark, "It goes\n  on here. Then it ends.", T.sentence_texts)) == 2
    assert len(col(spark, "A title line\nThen a sentence.", T.sentence_texts)) == 2
    assert col(spark, 'He paid 3.50 there. "Why?" she said. ... !', T.sentence_texts) == ["He paid 3.50 there.", '"Why?"', "she said."]
    assert col(spark, "Don’t stop at 1,000 words", lambda c: T.words(T.normalise_quotes(c))) == ["don't", "stop", "at", "1,000", "words"]


def test_cleaning(spark):
    assert col(spark, "a\nb\n\nc", T.unwrap_soft) == "a b\n\nc"
    assert col(spark, "# Head\ntext\n```py\ncode\n```\n<!-- no -->more", T.markdown_prose).split() == ["text", "more"]
    assert col(spark, "x\n| a | b |\n![i](u)\n\n\n\ny", T.document_prose) == "x\n\ny"
    assert col(spark, "def f():\n    return 1", T.looks_like_code) and not col(spark, "Plain prose, nothing else.", T.looks_like_code)
    assert col(spark, "The user wants a poem.", T.looks_like_reasoning) and not col(spark, "A poem.", T.looks_like_reasoning)


#: One pair a rule: the first text has the habit, the second hasn't.
FILL = " The bus was late and the rain came down on us while old Tom read his paper by the door"
PAIRS = {
    "r-001": ("We delve into a robust tapestry.", "We look at a plain rug."), "r-002": ("It serves as a base.", "It is a base."), "r-003": ("It is worth noting that it rained.", "It rained."),
    "r-004": ("I hope this helps with it.", "That is all of it."), "r-005": ("An opulent, sun-drenched town.", "A small, quiet town."), "r-006": ("It is a testament and a beacon.", "It is a sign and a light."),
    "r-007": ("Moreover, it rained.", "It rained."), "r-008": ("As of my last update it stood.", "It stood last year."), "r-009": ("It rained — and hard — all day.", "It rained, and hard, all day."),
    "r-010": ("The old man said it plain: nothing works.", "The old man said nothing works."), "r-011": ("**Speed**: it is fast.\n**Cost**: it is low.", "It is fast.\nIt costs little."), "r-012": ("The Quick Brown Answer\nit rained", "the quick brown answer\nit rained"),
    "r-013": ("Great 🚀 work 🎉 here.", "Great work here."), "r-014": ("It is not just a tool, but a way of life.", "It is a tool and a way of life."), "r-015": ("He said “yes” and ‘no’.", "He said \"yes\" and 'no'."),
    "r-016": ("- one thing\n- two things", "one thing\ntwo things"), "r-017": ("We ate the bread. We saw the town. We had the tea.", "We ate. We saw the old town by the sea in the rain. Tea."), "r-018": ("He quickly and boldly ran and slowly sat.", "He ran and sat with a thud."),
    "r-019": ("The cake was eaten. The bread was baked.", "We ate the cake. We baked bread."), "r-020": ("It might perhaps rain.", "It will rain."), "r-021": ("Red apples, green pears, and blue plums.", "Red apples with green pears."),
    "r-023": ("Extraordinary circumstances notwithstanding.", "Odd days or not."), "r-024": ("In conclusion, it rained.", "It rained."), "r-025": ("It rained. Hard. All day.", "It rained hard for all of that long day."),
    "r-026": ("It goes from joy to sorrow.", "It goes past joy and sorrow."), "r-027": ("Here's what we know of it.", "We know this of it."), "r-028": ("It rained, showing the need.", "It rained and we saw the need."),
    "r-029": ("It rained. The result? We stayed.", "It rained. We stayed."), "r-030": ("We ate. We ran. We slept.", "We ate. Then Tom ran. All slept."), "r-031": ("It was a pivotal moment.", "It was a Monday."), "r-032": ("Experts say it rains.", "Ann says it rains."),
    "r-033": ("Despite these challenges it grew.", "It grew."), "r-034": ("The road is long." + FILL * 3, "I think I like my road." + FILL * 3), "r-035": ("Onwards and upwards then.", "The sun is out."), "r-038": ("On the one hand it rains.", "It rains."),
}


def test_rules_tell_habits_from_plain_text(spark):
    assert set(PAIRS) == set(features.RULES) - {"r-022"}
    rows = [(r, i, t) for r, pair in PAIRS.items() for i, t in enumerate(pair)]
    hits = features.rule_hits(features.rule_features(features.parse(spark.createDataFrame(rows, "own string, side int, t string"), "t")), ["own", "side"])
    got = {(x["own"], x["side"]): x["value"] for x in hits.filter("own = rule").collect()}
    assert {r: (got[r, 0], got[r, 1]) for r in PAIRS if not got[r, 0] > got[r, 1]} == {}
    assert all(0 <= v <= 1 for v in got.values())


def test_vector(spark):
    assert len(features.FEATURE_NAMES) == 176 and len(set(features.FEATURE_NAMES)) == 176
    df = spark.createDataFrame([(1, "I can't say. You know it, lol!!"), (2, ""), (3, None), (4, "Un texte sans aucun mot anglais.")], "id int, body string")
    got = {x["id"]: x for x in features.extract_features(df, "body").collect()}
    assert all(len(x["vector"]) == 176 and all(v == v and abs(v) < 1e6 for v in x["vector"]) for x in got.values())
    v = dict(zip(features.FEATURE_NAMES, got[1]["vector"]))
    assert v["human:contractions"] == pytest.approx(1 / 7) and v["human:first-person"] == pytest.approx(1 / 7) and v["human:informal"] == pytest.approx(2 / 7) and v["fw:can"] == 0
    assert got[1]["n_words"] == 7 and not got[4]["english"] and list(got[2]["vector"]) == list(got[3]["vector"])


def test_curly_and_straight_apostrophes(spark):
    df = spark.createDataFrame([(1, "Here’s what I don’t say."), (2, "Here's what I don't say.")], "id int, body string")
    a, b = (dict(zip(features.FEATURE_NAMES, x["vector"])) for x in features.extract_features(df, "body").orderBy("id").collect())
    assert all(a[r] == b[r] for r in ("r-024", "r-027", "r-034")) and a["r-015"] == 1 and b["r-015"] == 0


@pytest.mark.parametrize("ip,private", [("10.0.0.1", True), ("172.16.0.1", True), ("172.32.0.1", False), ("192.168.1.1", True), ("100.64.0.1", True), ("8.8.8.8", False), ("224.0.0.1", True), ("::1", True), ("fd00::1", True), ("fe80::1", True), ("::ffff:127.0.0.1", True), ("2001:4860::8888", False)])
def test_addresses(spark, ip, private):
    assert col(spark, ip, web.is_private_address) == private


@pytest.mark.parametrize("url,want", [("example.com", "https://example.com/"), (" HTTP://Example.com/a?b ", "http://example.com/a?b"), ("https://a:b@example.com", None), ("localhost", None), ("https://", None), ("ftp://example.com", None), ("8.8.8.8/x", "https://8.8.8.8/x")])
def test_urls(spark, url, want):
    got = col(spark, url, web.normalise_url)
    assert got["url"] == want and (got["error"] is None) == (want is not None)


def test_site_classes(spark):
    cases = [("www.reddit.com", "/", "", "", "forum"), ("docs.example.org", "/", "", "", "docs"), ("shop.example.com", "/", "product", "", "shop"), ("a.example.com", "/doc/1", "", "", "docs"), ("b.example.com", "/", "", "Discourse 3", "forum"), ("y.example.org", "/", "", "", "other")]
    df = spark.createDataFrame(cases, "h string, p string, o string, g string, want string")
    assert df.filter(web.site_class(F.col("h"), F.col("p"), F.col("o"), F.col("g")) != F.col("want")).count() == 0
    assert col(spark, "<p>a&amp;nbsp;b &quot;c&quot;</p><script>x</script>", web.visible_text) == 'a&nbsp;b "c"'
