"""Where sentences, words and rule hits stand in a text.

Quotes are normalised one by one and lower-casing is left to the patterns, so spans of the normalised text are spans of the raw one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import lexicons as L
from . import text as T
from .offsets import SPANS, bare, cut, find_spans, matches, once, prefix_sums, utf16_spans

#: Rules whose number is a statistic, of which no place is shown, and the longest span that is shown.
STATISTICAL = ("r-017", "r-018", "r-019", "r-020", "r-021", "r-022", "r-023")
MOST_SHOWN = 48

def sentence_spans(c: Column) -> Column:
    """array<struct<start, end, text, n, first_start, first_end, first>>: sentences that hold a word, from their first to their last
    character, with the number of words and the first word."""
    pieces, ends = F.split(c, T.SENTENCE_END, -1), F.regexp_extract_all(c, F.lit(T.SENTENCE_END), 0)
    rows = F.zip_with(pieces, ends, lambda p, e: F.struct(p.alias("piece"), e.alias("stop")))

    def placed(found: Column) -> Column:
        starts = prefix_sums(F.transform(found, lambda x: F.length(x["piece"]) + F.coalesce(F.length(x["stop"]), F.lit(0))))
        # line breaks that end a sentence aren't part of it, and nothing is trimmed before a stop
        body = lambda x: F.when(x["stop"].isNull(), F.regexp_replace(x["piece"], f"{T.WS}+\\z", "")).when(x["stop"].startswith("\n"), x["piece"]).otherwise(F.concat(x["piece"], x["stop"]))

        def one(x: Column, s: Column) -> Column:
            return once(body(x), lambda b: once(F.regexp_replace(b, f"^{T.WS}+", ""), lambda t: F.struct((s + F.length(b) - F.length(t)).alias("start"), (s + F.length(b)).alias("end"), t.alias("text"))))

        with_words = F.filter(F.zip_with(found, starts, one), lambda x: x["text"].rlike(T.WORD))

        def counted(x: Column) -> Column:
            first = F.regexp_extract(x["text"], T.WORD, 0)
            at = x["start"] + F.position(first, x["text"]) - 1
            return F.struct(x["start"].alias("start"), x["end"].alias("end"), x["text"].alias("text"), F.regexp_count(x["text"], F.lit(T.WORD)).alias("n"), at.alias("first_start"), (at + F.length(first)).alias("first_end"), F.lower(first).alias("first"))

        return F.transform(with_words, counted)

    return once(rows, placed)


def line_spans(c: Column) -> Column:
    """array<struct<start, end, text>>: lines that aren't blank."""
    def placed(pieces: Column) -> Column:
        starts = prefix_sums(F.transform(pieces, lambda p: F.length(p) + 1))
        return F.filter(F.zip_with(pieces, starts, lambda p, s: F.struct(s.alias("start"), (s + F.length(p)).alias("end"), p.alias("text"))), lambda x: x["text"].rlike(T.NOT_WS))

    return once(F.split(c, "\n", -1), placed)


#: What rules of words, sentences and lines read; all others read the text alone.
READ = {"found_words": ("r-018", "r-023"), "found_sentences": ("r-007", "r-017", "r-019", "r-020", "r-024", "r-025", "r-027", "r-030"), "found_lines": ("r-012", "r-016")}


def located(df: DataFrame, text: str, called: Column | None = None) -> DataFrame:
    """df with raw, text, low, found_words, found_sentences, found_lines, behind a projection of their own; a null text is an empty one.

    called: ids of the rules that a row is asked for, by default all; what none of them reads is null.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    own = ("raw", "text", "low", "found_words", "found_sentences", "found_lines")
    base = df.select(*[c for c in df.columns if c not in own], raw.alias("raw"), T.normalise_quotes(raw).alias("text"))
    words = F.transform(matches(F.col("text"), T.WORD), lambda w: F.struct(w["start"], w["end"], F.lower(w["hit"]).alias("lower")))
    found = {"found_words": words, "found_sentences": sentence_spans(F.col("text")), "found_lines": line_spans(F.col("text"))}
    if called is not None:
        found = {k: F.when(F.arrays_overlap(called, F.array(*map(F.lit, READ[k]))), c) for k, c in found.items()}
    return base.select("*", F.lower("text").alias("low"), *[c.alias(k) for k, c in found.items()])


def _opener(phrases: tuple[str, ...]) -> Column:
    """The opening phrase of the first sentence, without what stands before it."""
    pattern = f"(?i){X.LEADING}({'|'.join(phrases)}){T.END}"
    first = F.get("found_sentences", F.lit(0))
    whole, phrase = F.regexp_extract(first["text"], pattern, 0), F.regexp_extract(first["text"], pattern, 1)
    end = first["start"] + F.length(whole)
    return F.when(first["text"].rlike(pattern), F.array(F.struct((end - F.length(phrase)).alias("start"), end.alias("end")))).otherwise(F.array().cast(SPANS))


def _most_repeated() -> Column:
    """First words of the sentences that share the opener which most have, of several the one that comes first."""
    s, none = F.col("found_sentences"), F.array().cast(SPANS)

    def most(names: Column) -> Column:
        last = lambda x: F.coalesce(F.get(names, x["j"] + 1)["w"] != x["w"], F.lit(True))
        ends = F.filter(F.transform(names, lambda x, j: F.struct(x["w"].alias("w"), j.alias("j"))), last)
        starts = F.concat(F.array(F.struct(F.lit("").alias("w"), F.lit(-1).alias("j"))), ends)
        runs = F.zip_with(ends, starts, lambda e, b: F.struct((e["j"] - b["j"]).alias("n"), (-F.get(names, b["j"] + 1)["i"]).alias("first"), e["w"].alias("w")))
        return F.array_max(F.filter(runs, lambda x: x["n"].isNotNull()))

    def own(best: Column) -> Column:
        same = F.transform(F.filter(s, lambda x: x["first"] == best["w"]), lambda x: F.struct(x["first_start"].alias("start"), x["first_end"].alias("end")))
        return F.when((F.size(s) >= 3) & (best["n"] >= 2), same).otherwise(none)

    names = F.array_sort(F.transform(s, lambda x, i: F.struct(x["first"].alias("w"), i.alias("i"))))
    return once(once(names, most), own)


def rule_spans(phrases: dict[str, tuple[str, ...]] | None = None, openers: dict[str, tuple[str, ...]] | None = None, rules: tuple[str, ...] = X.RULES) -> dict[str, Column]:
    """The spans of the hits of these rules over located columns, in code points of the raw text."""
    p, o = L.PHRASES | (phrases or {}), L.OPENERS | (openers or {})
    text, none = F.col("text"), F.array().cast(SPANS)
    all_of = lambda pattern: find_spans(text, pattern)
    words = lambda test: bare(F.filter("found_words", lambda w: test(w["lower"])))
    sentences = lambda test: bare(F.filter("found_sentences", test))
    lines = lambda test: bare(F.filter("found_lines", lambda x: test(x["text"])))
    any_of = lambda items: rf"{T.START}(?:{'|'.join(items)}){T.END}"
    passive = rf"(?i){T.START}(?:is|are|was|were|be|been|being|gets?|got){T.WS}+(?:\w+ly{T.WS}+)?(?:\w+ed|{'|'.join(L.IRREGULAR)}){T.END}"
    real_range = rf"(?i){T.START}from{T.WS}+(?:{'|'.join(L.RANGE_STARTS)})"
    colon = r"(?<=[a-z0-9)\]\"”]):" + T.WS + "+(?=[a-zA-Z])"
    line_before = lambda x: T.trim(F.substring_index(F.substring(text, F.lit(1), x["start"]), "\n", -1))
    lengths, n = F.transform("found_sentences", lambda s: s["n"].cast("double")), F.size("found_sentences")
    squares = lambda mean: F.aggregate(lengths, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    even = F.when(n < 3, 0.0).otherwise(once(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x) / n, lambda mean: 1 - F.sqrt(squares(mean)) / F.greatest(mean, F.lit(1.0))))
    short = lambda i: F.coalesce(F.get("found_sentences", i)["n"] <= 4, F.lit(False))
    numbered = F.transform("found_sentences", lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), i.alias("i")))
    out = {r: all_of(X.phrase_pattern(x)) if x else none for r, x in p.items()} | {
        "r-007": F.transform(F.filter("found_sentences", lambda s: s["text"].rlike(X.opener_pattern(o["r-007"]))), lambda s: F.struct(s["start"].alias("start"), s["first_end"].alias("end"))),
        "r-009": all_of(X.DASH),
        "r-010": bare(F.filter(all_of(colon), lambda x: F.size(F.split(line_before(x), T.WS + "+")) > 3)),
        "r-011": all_of(X.LABEL), "r-012": lines(X._title_line), "r-013": all_of(X.EMOJI), "r-014": all_of(X.PARALLEL),
        "r-015": find_spans(F.col("raw"), "[“”‘’]"), "r-016": lines(lambda x: x.rlike(X.LIST_LINE)),
        "r-017": F.when(even > 0.6, sentences(lambda s: F.lit(True))).otherwise(none),
        "r-018": words(lambda w: (F.length(w) > 4) & w.endswith("ly") & ~w.isin(*L.NOT_ADVERBS)), "r-019": sentences(lambda s: s["text"].rlike(passive)),
        "r-020": sentences(lambda s: F.regexp_count(s["text"], F.lit("(?i)" + any_of(L.HEDGES))) >= 2), "r-021": all_of(X.TRIAD), "r-022": none,
        "r-023": words(lambda w: (F.length(w) >= 10) & w.rlike("^[a-z]")), "r-024": _opener(o["r-024"]),
        "r-025": bare(F.filter(numbered, lambda x: short(x["i"]) & (short(x["i"] - 1) | short(x["i"] + 1)))),
        "r-026": bare(F.filter(matches(text, X.FROM_TO), lambda x: ~x["hit"].rlike(real_range))), "r-027": _opener(o["r-027"]),
        "r-028": all_of(rf"(?i),{T.WS}+(?:{'|'.join(L.PARTICIPLES)}){T.END}[^.!?]*[.!?]"), "r-029": find_spans(text, STAGED_PART, 1), "r-030": _most_repeated(), "r-034": none,
    }
    return {r: out[r].cast(SPANS) for r in rules}


#: The staged question of features.STAGED as a group.
STAGED_PART = X.STAGED.replace(r"(?:(?:the|so|and|but)?", r"((?:the|so|and|but)?", 1)


def span_rows(df: DataFrame, text: str, keys: list[str], phrases=None, openers=None, units: str = "points", rules: tuple[str, ...] = X.RULES) -> DataFrame:
    """keys, rule, pos (from 0), start, end, hit: each span of each of these rules, in code points or, for units utf16, in UTF-16 units.

    The raw text from start to end is the hit. Null and empty texts have none; repeated rows have theirs as often as they come.
    """
    found = located(df.select(*keys, text), text)
    move = (lambda s: utf16_spans(F.col("raw"), s)) if units == "utf16" else bare
    # hits are cut out before rows are made, which don't carry the whole text then
    shown = lambda at: F.zip_with(at, move(at), lambda a, m: F.struct(m["start"].alias("start"), m["end"].alias("end"), cut(F.col("raw"), a).alias("hit")))
    spans = [F.struct(F.lit(r).alias("rule"), once(s, shown).alias("found")) for r, s in rule_spans(phrases, openers, rules).items()]
    rows = found.select(*keys, F.explode(F.array(*spans)).alias("x")).select(*keys, "x.rule", F.posexplode("x.found").alias("pos", "s"))
    return rows.select(*keys, "rule", "pos", "s.start", "s.end", "s.hit")


def tell_spans(rows: DataFrame, most: int = MOST_SHOWN, statistical: tuple[str, ...] = STATISTICAL) -> DataFrame:
    """The rows that are shown: none of statistical rules, and none longer than most units."""
    return rows.filter(~F.col("rule").isin(*statistical) & (F.col("end") - F.col("start") <= most))


#: Rules whose spans are shown, besides by their length.
SHOWN = tuple(r for r in X.RULES if r not in STATISTICAL)


def rule_hit_structs(phrases=None, openers=None, called: Column | None = None) -> Column:
    """array<struct<rule, spans>> over located columns, rules with spans only: what explanations show beside a rule's name.

    called: ids of the rules that a row is asked for, by default all; the others aren't looked for.
    """
    asked = lambda r, s: s if called is None else F.when(F.array_contains(called, r), s)
    each = F.array(*[F.struct(F.lit(r).alias("rule"), asked(r, s).alias("spans")) for r, s in rule_spans(phrases, openers).items()])
    return F.filter(each, lambda x: x["spans"].isNotNull() & (F.size(x["spans"]) > 0))
