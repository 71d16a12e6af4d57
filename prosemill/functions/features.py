"""The 36 rule values and 140 style values of a paragraph, as column expressions in one projection.

A parsed paragraph has columns raw, text, words, raw_words, sentences and lines; parse() makes them, behind a projection of their
own so that no pattern is matched twice.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicons as L
from . import text as T
from .offsets import once

#: Rules in order, and the value above which a rule fires.
RULES = tuple(f"r-{i:03d}" for i in range(1, 36)) + ("r-038",)
FIRES = 0.05
#: Words whose rates are features, in order.
FUNCTION_WORDS = (
    "the a an and or but so if then than that which who whom whose this these those it its they them their we our you your i me my he she his her of in on at "
    "by for with from to into onto over under about after before between through during without within as is are was were be been being have has had do does did "
    "not no can could will would shall should may might must just very really also only even still yet here there when where why how what all some any each every "
    "both more most such own same other"
).split()
PUNCTUATION = (",", ";", ":", "(", "!", "?", '"', "'", "-", "\u2014", "\u2026")
LENGTH_BINS = ((0, 5), (5, 10), (10, 15), (15, 20), (20, 30), (30, 40), (40, 1 << 30))
FIRST_PERSON = ("i", "me", "my", "i'm", "i've", "i'd", "i'll", "mine")
SECOND_PERSON = ("you", "your", "you're", "you've", "you'll", "yours")
INFORMAL_WORDS = "lol lmao tbh imo imho idk btw gonna wanna gotta kinda sorta yeah yep nope ok okay dunno ya y'all ain't meh ugh huh wow damn crap stuff guys dude haha hmm".split()
STYLE_NAMES = (
    *[f"fw:{w}" for w in FUNCTION_WORDS], *[f"punct:{c}" for c in PUNCTUATION], "char:digit", "char:upper",
    *[f"sentlen:<={'Infinity' if hi > 1000 else hi}" for _, hi in LENGTH_BINS], "len:mean-sentence", "len:mean-word", "len:log-words", "len:log-sentences",
    "human:contractions", "human:first-person", "human:second-person", "human:informal", "human:lowercase-start", "human:double-space", "human:proper-nouns", "human:parens", "human:questions",
)
FEATURE_NAMES = RULES + STYLE_NAMES
#: Patterns of the rules that are no phrase lists.
DASH = r"\u2014|\u2013(?=" + T.WS + ")|" + T.WS + "--" + T.WS
TRIAD = rf"(?i){T.START}(?=[A-Za-z0-9_])[\w'-]+(?:{T.WS}+[\w'-]+){{0,2}},{T.WS}+[\w'-]+(?:{T.WS}+[\w'-]+){{0,2}},?{T.WS}+(?:and|or){T.WS}+[\w'-]+"
EMOJI = r"[\x{1F000}-\x{1FAFF}\u2600-\u27BF\u2B05-\u2B07\u2B1B\u2B1C\u2B50\u2B55\u231A\u231B\u2328\u23CF\u23E9-\u23F3\u23F8-\u23FA\u00A9\u00AE\u203C\u2049\u2122\u2139\u2194-\u2199\u21A9\u21AA\u24C2\u25AA\u25AB\u25B6\u25C0\u25FB-\u25FE\u2934\u2935\u3030\u303D\u3297\u3299]"
LIST_LINE = "^" + T.WS + r"*(?:[-*\u2022\u25AA\u25E6]|[0-9]+[.)])" + T.WS + "+"
LABEL = r"(?:^|\n)" + T.WS + r"*(?:[-*\u2022]|[0-9]+\.)?" + T.WS + r"*(?:\*\*|__)[^*_\n]{1,40}(?:\*\*|__)" + T.WS + "*:|" + r"(?:^|\n)" + T.WS + r"*(?:[-*\u2022]|[0-9]+\.)" + T.WS + r"*\*\*[^*\n]{1,40}:\*\*"
STAGED = r"(?:^|[.!?]" + T.WS + r"+)(?:(?:the|so|and|but)?" + T.WS + r"*\w+(?:" + T.WS + r"+\w+){0,4}\?)" + T.WS + "+(?=[A-Z])"
FROM_TO = rf"(?i){T.START}from{T.WS}+(?:the{T.WS}+)?[a-z][\w-]*(?:{T.WS}+[a-z][\w-]*){{0,3}}{T.WS}+to{T.WS}+(?:the{T.WS}+)?[a-z][\w-]*(?:{T.WS}+[a-z][\w-]*){{0,3}}"
PARALLEL = (
    rf"(?i){T.START}(?:not (?:just|only|merely|simply){T.END}[^.!?;]{{1,80}}?{T.START}(?:but|it'?s|it is|they'?re|they are){T.END}"
    rf"|it(?:'s| is)(?: not| n't|n't) (?:about|just|only){T.END}[^.!?]{{1,60}}?[,;.\u2014\u2013-]{T.WS}*it(?:'s| is){T.END}"
    rf"|isn't (?:just )?(?:a|an|about){T.END}[^.!?]{{1,60}}?[,;.\u2014\u2013-]{T.WS}*(?:it'?s|it is){T.END}"
    rf"|no{T.WS}+\w+,{T.WS}+no{T.WS}+\w+[,.]?{T.WS}+just{T.END})"
)
LEADING = "^[\\t\\n\\x0B\\f\\r \\u00A0\"'\u201C(*-]*"


def squash(x: Column, k: float) -> Column:
    return 1 - F.exp(-F.greatest(x, F.lit(0.0)) / k)


def parse(df: DataFrame, text: str) -> DataFrame:
    """df with raw, text, low (lower-cased), words, raw_words, sentences, lines; a null text is read as an empty one."""
    raw = F.coalesce(F.col(text), F.lit(""))
    kept = [c for c in df.columns if c not in ("raw", "text", "low", "words", "raw_words", "sentences", "lines")]
    base = df.select(*kept, raw.alias("raw"), T.normalise_quotes(raw).alias("text"))
    return base.select("*", F.lower("text").alias("low"), T.raw_words(F.col("text")).alias("raw_words"), T.sentences(F.col("text")).alias("sentences"), T.lines(F.col("text")).alias("lines")).withColumn("words", F.transform("raw_words", F.lower))


def _n_words() -> Column:
    return F.size("words")


def per100(n: Column) -> Column:
    return 100.0 * n / F.greatest(_n_words(), F.lit(20))


def per_sentence(n: Column) -> Column:
    return n / F.greatest(F.size("sentences"), F.lit(3))


def count(pattern: str, c: str = "text") -> Column:
    return F.regexp_count(F.col(c), F.lit(pattern))


def phrase_pattern(phrases: tuple[str, ...]) -> str:
    return "(?i)(?<![A-Za-z])(?:" + "|".join(phrases) + ")(?![A-Za-z])"


def count_chars(c: str, chars: str) -> Column:
    """How many of these characters column c holds."""
    less = lambda x: F.length(c) - F.length(F.replace(F.col(c), F.lit(x), F.lit("")))
    out = less(chars[0])
    for x in chars[1:]:
        out = out + less(x)
    return out


def count_class(c: str, chars: str) -> Column:
    """How many characters of this class column c holds."""
    return F.length(c) - F.length(F.regexp_replace(c, f"[{chars}]+", ""))


def holds(*parts: str, c: str = "low") -> Column:
    """Whether the lower-cased text holds any of these strings: a search for plain bytes, which spares most texts a pattern."""
    out = F.col(c).contains(parts[0])
    for p in parts[1:]:
        out = out | F.col(c).contains(p)
    return out


def holds_any(phrases: tuple[str, ...]) -> Column:
    """A condition without which none of the phrases can match; phrases that are patterns can always."""
    return holds(*(p.lower() for p in phrases)) if all(re.fullmatch("[A-Za-z' -]+", p) for p in phrases) else F.lit(True)


def only_if(condition: Column, value: Column, otherwise=0) -> Column:
    return F.when(condition, value).otherwise(otherwise)


def lexicon_rule(phrases: tuple[str, ...], k: float) -> Column:
    return squash(per100(only_if(holds_any(phrases), count(phrase_pattern(phrases)))), k) if phrases else F.lit(0.0)


def opener_pattern(phrases: tuple[str, ...]) -> str:
    return f"(?i){LEADING}(?:{'|'.join(phrases)}){T.END}"


def _sentences_with(test) -> Column:
    return F.size(F.filter("sentences", lambda s: test(s["text"])))


def _words_with(test) -> Column:
    return F.size(F.filter("words", test))


def _title_line(line: Column) -> Column:
    return ~line.rlike("[.!?,;]" + T.WS + "*\\z") & _title(line)


def _title(line: Column) -> Column:
    t = T.trim(F.regexp_replace(line, "^#+" + T.WS + "*", ""))
    ws = T.space_words(t)
    major = F.filter(ws, lambda w: F.length(w) > 3)
    return F.size(ws).between(3, 12) & ~t.rlike("[.!?,;]\\z") & (F.size(major) >= 2) & F.forall(major, lambda w: w.rlike("^[A-Z]"))


def _colons() -> Column:
    """Connecting colons with more than three pieces before them on their line."""
    pattern = r"(?<=[a-z0-9)\]\"\u201D]):" + T.WS + "+(?=[a-zA-Z])"

    def in_line(line: Column) -> Column:
        pieces = F.split(line, pattern, -1)
        before = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: T.trim(F.array_join(F.slice(pieces, 1, i), ": ")))
        return F.when(F.size(pieces) > 1, F.size(F.filter(before, lambda b: F.size(F.split(b, T.WS + "+")) > 3))).otherwise(0)

    # a colon before a line break connects to the next line, so line breaks after colons are spaces here
    return F.aggregate(F.split(F.regexp_replace("text", r"(?<=[a-z0-9)\]\"\u201D]):" + T.WS + "+(?=[a-zA-Z])", ": "), "\n", -1), F.lit(0), lambda n, x: n + in_line(x))


def _evenness() -> Column:
    """1 less the spread of the sentences' lengths by their mean, which is summed once for all of them."""
    n = F.size("sentences")

    def told(lengths: Column) -> Column:
        def spread(mean: Column) -> Column:
            return 1 - F.sqrt(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n) / F.greatest(mean, F.lit(1.0))

        return once(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n, spread)

    return once(F.transform("sentences", lambda s: F.size(s["words"]).cast("double")), told)


def _diversity(window: int = 40) -> Column:
    """Mean share of different words in all windows: all places of all windows, less those of words that their window has had before.
    A word and its last occurrence share the windows that hold both, so their number is told from the two places."""
    n = _n_words()

    def repeats(placed: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<w:string,i:int>")), placed)
        pairs = F.zip_with(placed, before, lambda x, y: F.when((x["w"] == y["w"]) & (x["i"] - y["i"] < window), F.greatest(F.least(y["i"], n - window) - F.greatest(x["i"] - (window - 1), F.lit(0)) + 1, F.lit(0))))
        return F.aggregate(F.filter(pairs, lambda x: x.isNotNull()), F.lit(0).cast("long"), lambda a, x: a + x)

    placed = F.sort_array(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    total = window * (n - window + 1).cast("long") - once(placed, repeats)
    return F.when(n < 15, 0.0).when(n <= window, F.size(F.array_distinct("words")) / n).otherwise(total / window / (n - window + 1))


def _fragments() -> Column:
    """Sentences of up to 4 words next to another such one."""
    def among(short: Column) -> Column:
        near = lambda i: F.coalesce(F.get(short, i), F.lit(False))
        return F.size(F.filter(F.transform(short, lambda x, i: x & (near(i - 1) | near(i + 1))), lambda x: x))

    return once(F.transform("sentences", lambda s: F.size(s["words"]) <= 4), among)


def most_equal(names: Column) -> Column:
    """How often the most frequent of these strings comes, by the longest run of equal ones in order; 0 of none."""
    def longest(placed: Column) -> Column:
        step = lambda s, x: once(F.when(x == s["w"], s["n"] + 1).otherwise(1), lambda n: F.struct(x.alias("w"), n.alias("n"), F.greatest(s["most"], n).alias("most")))
        return F.aggregate(placed, F.struct(F.lit(None).cast("string").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most")), step)["most"]

    return once(F.sort_array(names), longest)


def _repeated_openers() -> Column:
    n = F.size("sentences")
    return once(most_equal(F.transform("sentences", lambda s: F.lower(s["first"]))), lambda most: F.when((n < 3) | (most < 2), 0.0).otherwise((most - 1) / (n - 1)))


def rule_columns(phrases: dict[str, tuple[str, ...]] | None = None, openers: dict[str, tuple[str, ...]] | None = None) -> dict[str, Column]:
    """Value of each rule over parsed columns; phrase lists that are left out are the defaults."""
    p, o = L.PHRASES | (phrases or {}), L.OPENERS | (openers or {})
    first = F.get("sentences", F.lit(0))["text"]
    n_lines, n_sentences = F.size("lines"), F.size("sentences")
    any_of = lambda items: rf"{T.START}(?:{'|'.join(items)}){T.END}"
    passive = rf"(?i){T.START}(?:is|are|was|were|be|been|being|gets?|got){T.WS}+(?:\w+ly{T.WS}+)?(?:\w+ed|{'|'.join(L.IRREGULAR)}){T.END}"
    real_range = rf"(?i){T.START}from{T.WS}+(?:{'|'.join(L.RANGE_STARTS)})"
    # all of them take more than one byte
    wide = F.octet_length("raw") > F.length("raw")
    curly, straight = only_if(wide, count_chars("raw", "\u201c\u201d\u2018\u2019")), count_chars("raw", "\"'")
    contraction = lambda w: w.rlike("'(?:t|re|ve|ll|d|m)\\z")
    voice = per100(_words_with(lambda w: w.isin(*L.VOICE)) + _words_with(contraction)) + only_if(holds_any(L.OPINIONS) & F.col("text").rlike("(?i)" + any_of(L.OPINIONS)), F.lit(3))
    opener = lambda r: F.when(first.rlike(opener_pattern(o[r])), 1.0).otherwise(0.0)
    scale = {"r-001": 2.5, "r-002": 1, "r-003": 1, "r-004": 0.7, "r-005": 1.5, "r-006": 1, "r-008": 0.5, "r-031": 0.7, "r-032": 0.7, "r-033": 0.7, "r-035": 0.7, "r-038": 0.7}
    out = {r: lexicon_rule(p[r], k) for r, k in scale.items()} | {
        "r-007": squash(per_sentence(_sentences_with(lambda s: s.rlike(opener_pattern(o["r-007"])))), 0.25),
        "r-009": squash(per_sentence(only_if(wide | holds("--"), count(DASH))), 0.35),
        "r-010": squash(per_sentence(only_if(holds(":"), _colons())), 0.2),
        "r-011": squash(only_if(holds("**", "__"), count(LABEL)) / F.greatest(n_lines, F.lit(1)), 0.2),
        "r-012": squash(F.size(F.filter("lines", _title_line)).cast("double"), 0.7),
        "r-013": squash(per100(only_if(wide, count(EMOJI))), 1),
        "r-014": squash(per_sentence(only_if(holds("not ", "n't ") | holds("no") & holds("just"), count(PARALLEL))), 0.12),
        "r-015": once(F.struct(curly.alias("c"), straight.alias("s")), lambda x: F.when(x["c"] + x["s"] > 0, x["c"] / (x["c"] + x["s"])).otherwise(0.0)),
        "r-016": F.when(n_lines > 0, F.size(F.filter("lines", lambda x: x.rlike(LIST_LINE))) / n_lines).otherwise(0.0),
        "r-017": F.when(n_sentences < 3, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _evenness()))),
        "r-018": squash(per100(_words_with(lambda w: (F.length(w) > 4) & w.endswith("ly") & ~w.isin(*L.NOT_ADVERBS))), 4),
        "r-019": F.when(n_sentences > 0, _sentences_with(lambda s: s.rlike(passive)) / n_sentences).otherwise(0.0),
        "r-020": squash(per_sentence(only_if(holds_any(L.HEDGES), _sentences_with(lambda s: F.regexp_count(s, F.lit("(?i)" + any_of(L.HEDGES))) >= 2))), 0.3),
        "r-021": squash(per_sentence(only_if(holds(",") & holds("and", "or"), count(TRIAD))), 0.35),
        "r-022": _diversity(),
        "r-023": squash(_words_with(lambda w: (F.length(w) >= 10) & w.rlike("^[a-z]")) / F.greatest(_n_words(), F.lit(20)), 0.12),
        "r-024": opener("r-024"),
        "r-025": squash(per_sentence(_fragments()), 0.3),
        "r-026": squash(per100(only_if(holds("from"), F.size(F.filter(F.regexp_extract_all("text", F.lit(FROM_TO), 0), lambda m: ~m.rlike(real_range))))), 0.8),
        "r-027": opener("r-027"),
        "r-028": squash(per_sentence(only_if(holds_any(L.PARTICIPLES), count(rf"(?i),{T.WS}+(?:{'|'.join(L.PARTICIPLES)}){T.END}[^.!?]*[.!?]"))), 0.2),
        "r-029": squash(only_if(holds("?"), count(STAGED)).cast("double"), 0.7),
        "r-030": _repeated_openers(),
        "r-034": F.when(_n_words() < 40, 0.0).otherwise(F.exp(-voice / 1.5)),
    }
    return {r: out[r].cast("double") for r in RULES}


def style_columns() -> list[Column]:
    """The style values over parsed columns, in the order of STYLE_NAMES. Function words are gathered once (column known)."""
    n, s = F.greatest(_n_words(), F.lit(1)), F.greatest(F.size("sentences"), F.lit(1))
    chars = F.greatest(F.length("text"), F.lit(1))
    share = lambda test: _words_with(test) / n
    lengths = lambda lo, hi: F.size(F.filter("sentences", lambda x: (F.size(x["words"]) > lo) & (F.size(x["words"]) <= hi))) / s
    capital = lambda w: w.rlike("^[A-Z][a-z]") & (w != "I")
    capitals = count_class("text", "A-Z")
    starts = F.size(F.filter("sentences", lambda x: capital(x["first"])))
    informal = rf"(?i){T.START}(?:{'|'.join(INFORMAL_WORDS)}){T.END}|!!|\?\?|\.\.\.(?!\.)"
    return [
        *[(F.octet_length("known") - F.octet_length(F.replace(F.col("known"), F.lit(f" {x} "), F.lit("")))) / (len(x) + 2) / n for x in FUNCTION_WORDS],
        *[100 * (F.length("raw") - F.length(F.replace(F.col("raw"), F.lit(c), F.lit("")))) / chars for c in PUNCTUATION],
        count_class("text", "0-9") / chars,
        capitals / F.greatest(count_class("text", "A-Za-z"), F.lit(1)),
        *[lengths(lo, hi) for lo, hi in LENGTH_BINS],
        F.aggregate("sentences", F.lit(0), lambda a, x: a + F.size(x["words"])) / s / 30,
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / n / 6,
        F.log1p(_n_words().cast("double")) / 6,
        F.log1p(F.size("sentences").cast("double")) / 3,
        share(lambda w: w.rlike("'(?:t|re|ve|ll|d|m)\\z")),
        share(lambda w: w.isin(*FIRST_PERSON)),
        share(lambda w: w.isin(*SECOND_PERSON)),
        count(informal) / n,
        F.size(F.filter("sentences", lambda x: x["first"].rlike("^[a-z]"))) / s,
        only_if(holds("  "), count(r"[^\n ] {2,}[^\n ]")) / s,
        (F.size(F.filter("raw_words", capital)) - starts) / n,
        count_chars("text", "(") / s,
        count_chars("text", "?") / s,
    ]


def rule_features(parsed: DataFrame, phrases=None, openers=None) -> DataFrame:
    """parsed with rules: struct of a double for each rule."""
    return parsed.withColumn("rules", F.struct(*[c.alias(r) for r, c in rule_columns(phrases, openers).items()]))


def style_features(parsed: DataFrame) -> DataFrame:
    """parsed with style: array of 140 doubles."""
    # each between spaces of its own, so that a word's count is told by what the text loses with it
    among = F.filter("words", lambda w: w.isin(*FUNCTION_WORDS))
    known = parsed.withColumn("known", F.when(F.size(among) > 0, F.concat(F.lit(" "), F.array_join(among, "  "), F.lit(" "))).otherwise(""))
    return known.withColumn("style", F.array(*[c.cast("double") for c in style_columns()])).drop("known")


def extract_features(df: DataFrame, text: str, phrases=None, openers=None) -> DataFrame:
    """df with vector (176 floats in the order of FEATURE_NAMES), n_words and english."""
    kept = [c for c in df.columns if c not in ("vector", "n_words", "english")]
    both = style_features(rule_features(parse(df.select(*kept), text), phrases, openers))
    rules = [F.col(f"rules.`{r}`") for r in RULES]
    keep = [F.col("raw").alias(text) if c == text else F.col(c) for c in kept]
    return both.select(*keep, F.transform(F.concat(F.array(*rules), F.col("style")), lambda x: x.cast("float")).alias("vector"), F.size("words").alias("n_words"), T.is_english(F.col("words")).alias("english"))


def rule_hits(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, rule, value: the rules struct as rows."""
    return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"rules.`{r}`").alias("value")) for r in RULES])).alias("x")).select(*keys, "x.rule", "x.value")
