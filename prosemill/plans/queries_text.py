"""Queries of the text, feature and page operators, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from prosemill.functions import features, lexicons, spans, web
from prosemill.functions import text as T
from prosemill.operators import audit, dom

from . import frames
from .frames import documents, table

WS = r"[\t\n\x0B\f\r ]"
TRIM = lambda x: f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"
SQL_WORD = r"[A-Za-z\x{00C0}-\x{024F}]+(?:[''\x{2019}][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*"
WORDS = lambda x: f"list_transform(regexp_extract_all({x}, '{SQL_WORD}'), lambda w: lower(w))"
COUNT = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
SENTENCES = f"""list_filter(list_transform(string_split(replace(regexp_replace(regexp_replace(regexp_replace(text, '([.!?\\x{{2026}}]+["''\\x{{201D}}\\x{{2019}})\\]]*)({WS}|$)', '\\1' || chr(30) || '\\2', 'g'),
  '\\n+([ \\t]*[a-z])', chr(29) || '\\1', 'g'), '\\n+', chr(30), 'g'), chr(29), chr(10)), chr(30)), lambda s: {TRIM('s')}), lambda s: regexp_matches(s, '{SQL_WORD}'))"""
DOUBLE = "documents_2 AS (SELECT doc_id, replace(text, chr(10), chr(10) || chr(10)) AS text FROM documents)"
#: Words, raw words, sentences and lines of each document, as parse() has them.
PARSED = f"""base AS (SELECT doc_id, coalesce(text, '') AS raw, replace(coalesce(text, ''), chr(8217), '''') AS text FROM documents),
parsed AS (
  SELECT doc_id, raw, text, {WORDS('text')} AS w, regexp_extract_all(text, '{SQL_WORD}') AS rw, {SENTENCES} AS st,
    list_filter(string_split(text, chr(10)), lambda x: {TRIM('x')} <> '') AS lines
  FROM base
), full_parsed AS (
  SELECT *, list_transform(st, lambda s: {WORDS('s')}) AS sw, list_transform(st, lambda s: regexp_extract(s, '{SQL_WORD}')) AS first, greatest(len(w), 1) AS n, greatest(len(st), 1) AS s FROM parsed
)"""


def sg1_segment(spark, d):
    return T.segment(frames.blocks(spark, d), "text", ["doc_id"])


def sg2_segment_spans(spark, d):
    docs = frames.blocks(spark, d)
    spans = T.segment_spans(docs, "text", ["doc_id"])
    return spans.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "pos", F.expr("substring(text, start + 1, end - start)").alias("text"))


def sg3_split_blank(spark, d):
    return T.split_blank(frames.blocks(spark, d), "text", ["doc_id"])


def sg4_long_lines(spark, d):
    return T.split_lines_min_words(documents(spark, d), "text", ["doc_id"], 25)


def sg5_training_paragraphs(spark, d):
    return T.training_paragraphs(frames.blocks(spark, d), "text", ["doc_id"])


def sg6_sg8_clean(spark, d):
    c = F.col("text")
    return documents(spark, d).select("doc_id", T.unwrap_soft(c).alias("unwrapped"), T.document_prose(c).alias("prose"), T.looks_like_code(c).alias("code"), T.looks_like_reasoning(c).alias("reasoning"), T.too_short(c).alias("short"))


def sg7_markdown_prose(spark, d):
    return documents(spark, d).select("doc_id", T.markdown_prose(F.col("text")).alias("prose"))


def tk_words(spark, d):
    docs, ws = documents(spark, d).select("doc_id", T.words(T.normalise_quotes(F.col("text"))).alias("words")), F.col("words")  # matched once
    return docs.select("doc_id", F.size(ws).alias("n_words"), F.md5(F.array_join(ws, " ").cast("binary")).alias("words_md5"), F.round(T.english_share(ws), 9).alias("english_share"), T.is_english(ws).alias("english"))


def tk_sentences(spark, d):
    s = T.sentence_texts(T.normalise_quotes(F.col("text")))
    return documents(spark, d).select("doc_id", F.size(s).alias("n_sentences"), F.md5(F.array_join(s, "|").cast("binary")).alias("sentences_md5"), F.size(T.lines(F.col("text"))).alias("n_lines"))


def tk6_find_all(spark, d):
    spans = T.find_all(F.col("text"), "[A-Z][a-z]+")
    cut = documents(spark, d).select("doc_id", F.posexplode(spans).alias("pos", "s"), "text")
    return cut.select("doc_id", "pos", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("hit"))


def rules_values(spark, d):
    parsed = features.rule_features(features.parse(documents(spark, d).select("doc_id", F.col("text").alias("body")), "body"), TEST_PHRASES, TEST_OPENERS)
    return parsed.select("doc_id", *[F.round(F.col(f"rules.`{r}`"), 6).alias(r.replace("-", "_")) for r in features.RULES])


def rules_all(spark, d):
    parsed = features.rule_features(features.parse(documents(spark, d).select("doc_id", F.col("text").alias("body")), "body"), TEST_PHRASES, TEST_OPENERS)
    return features.rule_hits(parsed, ["doc_id"]).withColumn("value", F.round("value", 6))


def tk7_tell_spans(spark, d):
    """Each span that is shown, by what the raw text has there, without white space at its ends."""
    rows = spans.tell_spans(spans.span_rows(documents(spark, d), "text", ["doc_id"], TEST_PHRASES, TEST_OPENERS, rules=spans.SHOWN))
    return rows.select("doc_id", "rule", "pos", T.trim(F.col("hit")).alias("hit"))


def tk7_utf16_spans(spark, d):
    """Spans of long words in both units, in texts that begin with page_id mod 3 supplementary characters."""
    text = F.concat(F.repeat(F.lit("\U0001F680 "), F.col("page_id").cast("int") % 3), web.visible_text(F.col("html")))
    pages = table(spark, d, "pages").select("page_id", text.alias("text"))
    both = pages.select("page_id", F.posexplode(F.arrays_zip(T.find_all(F.col("text"), "[A-Za-z]{10,}").alias("p"), T.find_all(F.col("text"), "[A-Za-z]{10,}", "utf16").alias("u"))).alias("pos", "s"))
    return both.select("page_id", "pos", F.col("s.p.start").alias("start"), F.col("s.p.end").alias("end"), F.col("s.u.start").alias("unit_start"), F.col("s.u.end").alias("unit_end"))


def style_values(spark, d):
    parsed = features.style_features(features.parse(documents(spark, d).select("doc_id", F.col("text").alias("body")), "body"))
    return parsed.select("doc_id", *[F.round(F.col("style")[i], 6).alias(f"v{i}") for i in range(len(features.STYLE_NAMES))])


def fx1_vectors(spark, d):
    made = features.extract_features(documents(spark, d).select("doc_id", "text"), "text", TEST_PHRASES, TEST_OPENERS)
    return made.select("doc_id", *[F.round(F.col("vector")[i].cast("double"), 4).alias(f"f{i:03d}") for i in range(len(features.FEATURE_NAMES))], "n_words", "english")


def _style_values() -> list[str]:
    share = lambda test: f"len(list_filter(w, lambda x: {test})) / n"
    q = lambda c: c.replace("'", "''")
    values = [share(f"x = '{q(x)}'") for x in features.FUNCTION_WORDS]
    values += [f"100 * (length(raw) - length(replace(raw, '{q(c)}', ''))) / greatest(length(text), 1)" for c in features.PUNCTUATION]
    values += [f"{COUNT('text', '[0-9]')} / greatest(length(text), 1)", f"{COUNT('text', '[A-Z]')} / greatest({COUNT('text', '[A-Za-z]')}, 1)"]
    values += [f"len(list_filter(sw, lambda x: len(x) > {lo} AND len(x) <= {hi})) / s" for lo, hi in features.LENGTH_BINS]
    values += ["coalesce(list_sum(list_transform(sw, lambda x: len(x))), 0) / s / 30", "coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / n / 6", "ln(1 + len(w)) / 6", "ln(1 + len(st)) / 3"]
    lists = lambda names: "[" + ", ".join("'" + q(x) + "'" for x in names) + "]"
    values += [share("regexp_matches(x, '''(?:t|re|ve|ll|d|m)$')"), share(f"list_contains({lists(features.FIRST_PERSON)}, x)"), share(f"list_contains({lists(features.SECOND_PERSON)}, x)")]
    informal = r"(?i)\b(?:" + "|".join(q(x) for x in features.INFORMAL_WORDS) + r")\b|!!|\?\?"
    values += [f"({COUNT('text', informal)} + len(list_filter(regexp_extract_all(text, '[.]+'), lambda x: length(x) >= 3))) / n"]
    values += ["len(list_filter(first, lambda x: regexp_matches(x, '^[a-z]'))) / s", COUNT("text", "[^\\n ] {2,}[^\\n ]") + " / s"]
    capital = "regexp_matches(x, '^[A-Z][a-z]')"
    values += [f"(len(list_filter(rw, lambda x: {capital})) - len(list_filter(first, lambda x: {capital}))) / n", COUNT("text", "[(]") + " / s", COUNT("text", "[?]") + " / s"]
    return values


STYLE_SQL = _style_values()


_squash = lambda x, k: f"1 - exp(-greatest(CAST({x} AS DOUBLE), 0.0) / {k})"
_per100 = lambda x: f"100.0 * {x} / greatest(len(w), 20)"
_sentence = lambda x: f"{x} / greatest(len(st), 3)"
_in = lambda names: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + "]"
_LENGTHS = "list_transform(sw, lambda x: CAST(len(x) AS DOUBLE))"
_DIVERSE = "list_sum(list_transform(range(1, len(w) - 38), lambda i: len(list_distinct(w[i:i + 39])))) / 40 / (len(w) - 39)"
_SHORT = "list_transform(sw, lambda x: len(x) <= 4)"
_NEAR = "len(list_filter(range(1, len(sw) + 1), lambda i: short[i] AND (coalesce(short[i - 1], false) AND i > 1 OR coalesce(short[i + 1], false))))"
_VOICE = f"len(list_filter(w, lambda x: list_contains({_in(lexicons.VOICE)}, x))) + len(list_filter(w, lambda x: regexp_matches(x, '''(?:t|re|ve|ll|d|m)$')))"
_LISTED = "^[\\t\\n\\f\\r ]*(?:[-*\\x{2022}\\x{25AA}\\x{25E6}]|[0-9]+[.)])[\\t\\n\\f\\r ]+"
#: A pattern of features.py in DuckDB's syntax, which knows no look-around and has a word boundary of its own.
RE = lambda p: re.sub(r"\\u([0-9A-Fa-f]{4})", r"\\x{\1}", p.replace(T.WS, T.ANY_WS).replace(T.START, r"\b").replace(T.END, r"\b").replace("(?=[A-Za-z0-9_])", "")).replace("'", "''")
_FLAGS = lambda p: p.replace("(?md)", "(?m)")
#: Phrases and openers that the tables' invented words hold, for every rule that takes some.
TEST_PHRASES = {
    "r-001": ("the", "and", "of", "license"), "r-002": ("der", "die"), "r-003": ("of the", "in the", "to"), "r-004": ("la", "los"), "r-005": ("with", "en"), "r-006": ("it is", "is"),
    "r-008": ("for",), "r-031": ("que", "les"), "r-032": ("that", "was"), "r-033": ("on", "as"), "r-035": ("a",), "r-038": ("das", "und"),
}
TEST_OPENERS = {"r-007": ("the", "in", "it", "die"), "r-024": ("the", "of"), "r-027": ("de", "la", "and")}
_SCALE = {"r-001": 2.5, "r-002": 1, "r-003": 1, "r-004": 0.7, "r-005": 1.5, "r-006": 1, "r-008": 0.5, "r-031": 0.7, "r-032": 0.7, "r-033": 0.7, "r-035": 0.7, "r-038": 0.7}
_FOUND = lambda p, t="text": f"len(regexp_extract_all({t}, '{p}'))"
_ANY = lambda items: r"\b(?:" + "|".join(items) + r")\b"
#: With all that isn't a letter doubled, phrases next to each other don't share what stands between them.
_PHRASE = lambda items: _FOUND("(?i)(?:^|[^A-Za-z])(?:" + "|".join(x.replace(" ", "  ") for x in items) + ")(?:$|[^A-Za-z])", "regexp_replace(text, '([^A-Za-z])', '\\1\\1', 'g')")
_OPENS = lambda items: RE("(?i)" + features.LEADING) + _ANY(items)[2:]
_FIRST = lambda items: f"CASE WHEN len(st) > 0 AND regexp_matches(st[1], '{_OPENS(items)}') THEN 1 ELSE 0 END"
_PIECES = lambda t: f"string_split_regex({t}, '{WS}+')"
_COLON = f"([a-z0-9)\\]\"\\x{{201D}}]):{WS}+([a-zA-Z])"
_MARKED = f"regexp_replace(regexp_replace(text, '{_COLON}', '\\1' || chr(30) || '\\2', 'g'), '{_COLON}', '\\1' || chr(30) || '\\2', 'g')"
_BEFORE = f"len(list_filter(range(1, len(string_split(x, chr(30)))), lambda i: len({_PIECES(TRIM('array_to_string(string_split(x, chr(30))[1:i], chr(58) || chr(32))'))}) > 3))"
_TITLE = TRIM(f"regexp_replace(x, '^#+{WS}*', '')")
_MAJOR = f"list_filter({_PIECES(_TITLE)}, lambda y: length(y) > 3)"
_IS_TITLE = f"len({_PIECES(_TITLE)}) BETWEEN 3 AND 12 AND NOT regexp_matches({_TITLE}, '[.!?,;]$') AND len({_MAJOR}) >= 2 AND len(list_filter({_MAJOR}, lambda y: NOT regexp_matches(y, '^[A-Z]'))) = 0"
_PASSIVE = RE(rf"(?i)\b(?:is|are|was|were|be|been|being|gets?|got){T.WS}+(?:\w+ly{T.WS}+)?(?:\w+ed|{'|'.join(lexicons.IRREGULAR)})\b")
_QUOTES = """[\\x{201C}\\x{201D}\\x{2018}\\x{2019}]"""
_ALL_QUOTES = """[\\x{201C}\\x{201D}\\x{2018}\\x{2019}"'']"""
#: Each rule's value over extra, before rounding.
RULE_SQL = {r: _squash(_per100(_PHRASE(TEST_PHRASES[r])), k) for r, k in _SCALE.items()} | {
    "r-007": _squash(_sentence(f"len(list_filter(st, lambda x: regexp_matches(x, '{_OPENS(TEST_OPENERS['r-007'])}')))"), 0.25),
    "r-009": _squash(_sentence(_FOUND(RE("\\u2014|\\u2013" + T.WS + "|" + T.WS + "--" + T.WS))), 0.35),
    "r-010": _squash(_sentence(f"coalesce(list_sum(list_transform(string_split({_MARKED}, chr(10)), lambda x: {_BEFORE})), 0)"), 0.2),
    "r-011": _squash(_FOUND(RE(features.LABEL)) + " / greatest(len(lines), 1)", 0.2),
    "r-012": _squash(f"len(list_filter(lines, lambda x: {_IS_TITLE}))", 0.7),
    "r-013": _squash(_per100(_FOUND(RE(features.EMOJI))), 1),
    "r-014": _squash(_sentence(_FOUND(RE(features.PARALLEL))), 0.12),
    "r-015": f"CASE WHEN {_FOUND(_ALL_QUOTES, 'raw')} > 0 THEN {_FOUND(_QUOTES, 'raw')} / {_FOUND(_ALL_QUOTES, 'raw')} ELSE 0 END",
    "r-016": f"CASE WHEN len(lines) > 0 THEN len(list_filter(lines, lambda x: regexp_matches(x, '{_LISTED}'))) / len(lines) ELSE 0 END",
    "r-017": f"CASE WHEN len(st) < 3 THEN 0 ELSE least(1, greatest(0, 1 - list_stddev_pop({_LENGTHS}) / greatest(list_avg({_LENGTHS}), 1))) END",
    "r-018": _squash(_per100(f"len(list_filter(w, lambda x: length(x) > 4 AND x LIKE '%ly' AND NOT list_contains({_in(lexicons.NOT_ADVERBS)}, x)))"), 4),
    "r-019": f"CASE WHEN len(st) > 0 THEN len(list_filter(st, lambda x: regexp_matches(x, '{_PASSIVE}'))) / len(st) ELSE 0 END",
    "r-020": _squash(_sentence(f"len(list_filter(st, lambda x: {_FOUND('(?i)' + _ANY(lexicons.HEDGES), 'x')} >= 2))"), 0.3),
    "r-021": _squash(_sentence(_FOUND(RE(features.TRIAD))), 0.35),
    "r-022": f"CASE WHEN len(w) < 15 THEN 0 WHEN len(w) <= 40 THEN len(list_distinct(w)) / len(w) ELSE {_DIVERSE} END",
    "r-023": _squash("len(list_filter(w, lambda x: length(x) >= 10 AND regexp_matches(x, '^[a-z]'))) / greatest(len(w), 20)", 0.12),
    "r-024": _FIRST(TEST_OPENERS["r-024"]),
    "r-025": _squash(_sentence(_NEAR), 0.3),
    "r-026": _squash(_per100(f"len(list_filter(regexp_extract_all(text, '{RE(features.FROM_TO)}'), lambda x: NOT regexp_matches(x, '{RE('(?i)' + T.START + 'from' + T.WS + '+(?:' + '|'.join(lexicons.RANGE_STARTS) + ')')}')))"), 0.8),
    "r-027": _FIRST(TEST_OPENERS["r-027"]),
    "r-028": _squash(_sentence(_FOUND(RE(rf"(?i),{T.WS}+(?:{'|'.join(lexicons.PARTICIPLES)})\b[^.!?]*[.!?]"))), 0.2),
    "r-029": _squash(_FOUND(RE(features.STAGED.replace("(?=[A-Z])", "[A-Z]"))), 0.7),
    "r-030": "CASE WHEN len(st) < 3 OR list_max(map_values(list_histogram(openers))) < 2 THEN 0 ELSE (list_max(map_values(list_histogram(openers))) - 1) / (len(st) - 1) END",
    "r-034": f"CASE WHEN len(w) < 40 THEN 0 ELSE exp(-({_per100(f'({_VOICE})')} + CASE WHEN regexp_matches(text, '(?i){_ANY(lexicons.OPINIONS)}') THEN 3 ELSE 0 END) / 1.5) END",
}
_EXTRA = f"WITH {PARSED}, extra AS (SELECT *, {_SHORT} AS short, list_transform(first, lambda x: lower(x)) AS openers FROM full_parsed)"
RULES_SQL = f"{_EXTRA} SELECT doc_id, " + ", ".join(f"round({RULE_SQL[r]}, 6) AS {r.replace('-', '_')}" for r in features.RULES) + " FROM extra"
RULE_ROWS_SQL = f"{_EXTRA} SELECT doc_id, unnest({_in(features.RULES)}) AS rule, unnest([" + ", ".join(f"round(CAST({RULE_SQL[r]} AS DOUBLE), 6)" for r in features.RULES) + "]) AS value FROM extra"
_FLOAT = lambda x: f"round(CAST(CAST({x} AS FLOAT) AS DOUBLE), 4)"
_SHARE = f"len(list_filter(w, lambda x: list_contains({_in(T.ENGLISH_WORDS)}, x)))"
VECTOR_SQL = f"{_EXTRA} SELECT doc_id, " + ", ".join(f"{_FLOAT(v)} AS f{i:03d}" for i, v in enumerate([*(RULE_SQL[r] for r in features.RULES), *STYLE_SQL])) + f", CAST(len(w) AS INTEGER) AS n_words, CASE WHEN len(w) > 0 THEN {_SHARE} / len(w) ELSE 0 END >= 0.1 AS english FROM extra"


_HITS_OF = lambda p, group=0, t="text": f"regexp_extract_all({t}, '{p}', {group})"
_PHRASE_HITS = lambda items: "list_transform(" + _HITS_OF("(?i)(?:^|[^A-Za-z])(" + "|".join(x.replace(" ", "  ") for x in items) + ")(?:$|[^A-Za-z])", 1, "regexp_replace(text, '([^A-Za-z])', '\\1\\1', 'g')") + ", lambda x: replace(x, '  ', ' '))"
_OPENING = lambda items: f"CASE WHEN len(st) > 0 AND regexp_matches(st[1], '{_OPENS(items)}') THEN [regexp_extract(st[1], '{RE('(?i)' + features.LEADING)}({'|'.join(items)})\\b', 1)] ELSE [] END"
_REPEATED = "list_sort(list_transform(list_distinct(openers), lambda x: {'n': -len(list_filter(openers, lambda y: y = x)), 'i': list_position(openers, x), 'w': x}))[1]"
#: What each shown rule hits, in order.
HITS_SQL = {r: _PHRASE_HITS(TEST_PHRASES[r]) for r in _SCALE} | {
    "r-007": f"list_transform(list_filter(st, lambda x: regexp_matches(x, '{_OPENS(TEST_OPENERS['r-007'])}')), lambda x: substring(x, 1, instr(x, regexp_extract(x, '{SQL_WORD}')) + length(regexp_extract(x, '{SQL_WORD}')) - 1))",
    "r-009": _HITS_OF(RE("\\u2014|\\u2013" + T.WS + "|" + T.WS + "--" + T.WS)),
    "r-010": f"list_transform(range(0, CAST(coalesce(list_sum(list_transform(string_split({_MARKED}, chr(10)), lambda x: {_BEFORE})), 0) AS BIGINT)), lambda i: ':')",
    "r-011": _HITS_OF(RE(features.LABEL)), "r-012": f"list_filter(lines, lambda x: {_IS_TITLE})", "r-013": _HITS_OF(RE(features.EMOJI)), "r-014": _HITS_OF(RE(features.PARALLEL)),
    "r-015": _HITS_OF(_QUOTES, 0, "raw"), "r-016": f"list_filter(lines, lambda x: regexp_matches(x, '{_LISTED}'))", "r-024": _OPENING(TEST_OPENERS["r-024"]),
    "r-025": f"list_transform(list_filter(range(1, len(sw) + 1), lambda i: short[i] AND (coalesce(short[i - 1], false) AND i > 1 OR coalesce(short[i + 1], false))), lambda i: st[i])",
    "r-026": f"list_filter(regexp_extract_all(text, '{RE(features.FROM_TO)}'), lambda x: NOT regexp_matches(x, '{RE('(?i)' + T.START + 'from' + T.WS + '+(?:' + '|'.join(lexicons.RANGE_STARTS) + ')')}'))",
    "r-027": _OPENING(TEST_OPENERS["r-027"]), "r-028": _HITS_OF(RE(rf"(?i),{T.WS}+(?:{'|'.join(lexicons.PARTICIPLES)})\b[^.!?]*[.!?]")), "r-029": _HITS_OF(RE(spans.STAGED_PART.replace("(?=[A-Z])", "[A-Z]")), 1),
    "r-030": f"CASE WHEN len(st) >= 3 AND {_REPEATED}.n <= -2 THEN list_transform(list_filter(range(1, len(st) + 1), lambda i: openers[i] = {_REPEATED}.w), lambda i: first[i]) ELSE [] END",
}
TELLS_SQL = f"""{_EXTRA}, hits AS ({" UNION ALL ".join(f"SELECT doc_id, '{r}' AS rule, CAST({h} AS VARCHAR[]) AS hits FROM extra" for r, h in HITS_SQL.items())}),
  each AS (SELECT doc_id, rule, hits, unnest(range(1, len(hits) + 1)) AS i FROM hits)
SELECT doc_id, rule, CAST(i - 1 AS INTEGER) AS pos, {TRIM('hits[i]')} AS hit FROM each WHERE length(hits[i]) <= 48"""


def ht1_visible_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(web.visible_text(F.col("html")).cast("binary")).alias("text_md5"))


VISIBLE = lambda h: (
    "trim(regexp_replace(replace(replace(replace(regexp_replace(replace(replace(regexp_replace("
    + "".join("regexp_replace(" for _ in range(5)) + h
    + "".join(f", '(?is)<{t}\\b.*?</{t}>', ' ', 'g')" for t in ("script", "style", "noscript", "svg", "template"))
    + ", '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&#39;|&apos;|&rsquo;', '''', 'g'), '&quot;', '\"'), '&mdash;', chr(8212)), '&#8212;', chr(8212)), '[\\t\\n\\x0B\\f\\r \\x{00A0}]+', ' ', 'g'))"
)


_PREFIX = "repeat(chr(128640) || ' ', page_id % 3)"
_LONG = "regexp_extract_all(text, '[A-Za-z]{10,}')"
UNITS_SQL = f"""WITH t AS (SELECT page_id, page_id % 3 AS k, {_PREFIX} || {VISIBLE('html')} AS text FROM pages), m AS (SELECT page_id, k, string_split_regex(text, '[A-Za-z]{{10,}}') AS gaps, {_LONG} AS hits FROM t),
  e AS (SELECT page_id, k, gaps, hits, unnest(range(1, len(hits) + 1)) AS i FROM m), p AS (SELECT page_id, k, i, hits, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS place FROM e)
SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, CAST(place AS INTEGER) AS start, CAST(place + length(hits[i]) AS INTEGER) AS "end", CAST(place + k AS INTEGER) AS unit_start, CAST(place + length(hits[i]) + k AS INTEGER) AS unit_end FROM p"""


def ht2_html_paragraphs(spark, d):
    return web.html_paragraphs(table(spark, d, "pages"), "html", ["page_id"])


def ht3_page_parts(spark, d):
    p = web.page_parts(table(spark, d, "pages").select("page_id", "html"))
    return p.select("page_id", "css", "classes", F.array_join("headings", "|").alias("headings"), F.array_join("links", "|").alias("links"))


def ht4_content_blocks(spark, d):
    return dom.content_blocks(table(spark, d, "pages"), "html", ["page_id"], 5)


def ht7_attach_css(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url", F.concat(F.lit('<link rel="stylesheet" href="/a.css"><link rel="stylesheet" href="b.css">'), "html").alias("html"))
    links = web.stylesheet_links(pages, ["page_id"])
    css = links.filter("ord = 0").select(F.col("href").alias("url")).distinct().withColumn("body", F.concat(F.lit("/* "), "url", F.lit(" */")))
    return web.attach_css(pages, css, ["page_id"]).select("page_id", "css")


def ur_urls(spark, d):
    u = web.normalise_url(F.col("url"))
    host = web.hostname(F.col("url"))
    return table(spark, d, "pages").select("page_id", host.alias("host"), u["error"].alias("error"), web.site_class(host, F.regexp_extract("url", r"^[a-z]+://[^/?#]*([^?#]*)", 1), web.meta_content(F.col("html"), "og:type"), web.meta_content(F.col("html"), "generator")).alias("site_class"))


def ur1_addresses(spark, d):
    """Addresses made from the pages', good and bad ones in turn."""
    rest, i = F.regexp_replace("url", "^[a-z]+://", ""), F.col("page_id") % 8
    forms = [F.col("url"), F.concat(F.lit(" HTTP://"), rest, F.lit(" ")), rest, F.concat(F.lit("https://me:pw@"), rest), F.concat(F.lit("localhost/"), "page_id"), F.concat(F.lit("ftp://"), rest), F.concat(F.lit("https://"), F.regexp_replace(rest, "^([^/?#]+)", "$1:8080")), F.lit("https://")]
    given = forms[0]
    for k, form in enumerate(forms[1:], 1):
        given = F.when(i == k, form).otherwise(given)
    return table(spark, d, "pages").select("page_id", given.alias("given")).select("page_id", "given", web.normalise_url(F.col("given")).alias("u")).select("page_id", "given", "u.url", "u.error")


def ur2_private(spark, d):
    part = lambda n: F.pmod(F.col("event_id") * n, F.lit(256)).cast("string")
    ip = F.concat_ws(".", part(7), part(13), part(29), part(31))
    return table(spark, d, "events").select("event_id", web.is_private_address(ip).alias("private"), web.is_private_address(F.concat(F.lit("::ffff:"), ip)).alias("mapped"))


def ur5_default_off(spark, d):
    pages = table(spark, d, "pages").select("page_id", web.hostname(F.col("url")).alias("host"))
    domains = pages.filter("page_id % 7 = 0").select(F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1).alias("domain"))
    return web.default_off_host(pages, "host", domains).select("page_id", "host", "off")


#: What the tables' pages lack, so that each check finds something on some: a page gets it page_id mod 7 times, in two halves.
HABITS = (
    '<style>.a{box-shadow: 0 2px 4px #000; border-radius: 16px; filter: blur(80px); border-left: 4px solid; background: linear-gradient(a); font-family: Inter; color: #7c3aed}</style><h2>\u2728 Fast</h2>'
    '<p class="blur-2xl shadow-lg rounded-3xl backdrop-blur grid-cols-3 hover:scale-105 bg-pink-50 from-red-500 to-sky-300 bg-purple-500">\u2713 \u2014 $9/mo It\u0027s not just big, it\u0027s huge.</p>',
    '<style>html{background:#000} .b{box-shadow:none; text-shadow: 0 0 9px; backdrop-filter: blur; background: radial-gradient(red 1px, x)} body { background: white}</style><a href="/tos">Terms</a>'
    '<p class="blur-[80px] border-l-4 border-l-[3px] bg-dot group-hover:translate-x-1 bg-sky-50 bg-lime-100 bg-rose-50 via-pink-300 from-lime-200 to-teal-100 text-lime-300 col-span-2 bg-gradient-to-r"><svg class="lucide lucide-check lucide-sparkles"></svg>'
    '<i class="bg-red-500"></i><i class="bg-yellow-400"></i><i class="bg-green-500"></i> \U0001F680 <a href="/x">Privacy</a> font __Geist_a1b2</p>',
)


def _habits(spark, d):
    html = F.concat("html", F.repeat(F.lit(HABITS[0]), F.col("page_id").cast("int") % 7), F.repeat(F.lit(HABITS[1]), F.col("page_id").cast("int") % 3))
    return table(spark, d, "pages").withColumn("html", html)


def audit_pages(spark, d):
    return audit.audit_pages(_habits(spark, d), ["page_id"])


def audit_copy(spark, d):
    """The finding that needs decisions, here by the paragraphs' lengths."""
    pages = table(spark, d, "pages")
    read = web.html_paragraphs(pages, "html", ["page_id"]).withColumn("decision", F.when(F.length("text") % 4 == 0, "machine").otherwise("human"))
    return audit.audit_pages(pages, ["page_id"], scored=read).filter("id = 'machine-copy'").select("page_id", "id", "group", "hit", "n")


def audit_summary(spark, d):
    pages = _habits(spark, d)
    return audit.audit_summary(audit.audit_pages(pages, ["page_id"]), pages, ["page_id"])


_HOST = "lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]]*\\]|[^/?#:]*)', 1))"
_SQL_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_BODY = "regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>', ' ', 'g'), '(?is)<style\\b.*?</style>', ' ', 'g')"
_LINKS = "list_transform(range(1, len(a) + 1), lambda i: a[i] || ' ' || t[i])"


def _site_sql() -> str:
    h = "regexp_replace(host, '^www\\.', '')"
    whens = []
    for name, pattern, signal, value in web.SITE_RULES:
        hit = f"regexp_matches({h}, '{pattern}')"
        if signal:
            hit += f" OR regexp_matches({signal}, '{value}')"
        whens.append(f"WHEN {hit} THEN '{name}'")
    return " ".join(whens)


def _meta_sql(name: str) -> str:
    tag = f"regexp_extract(html, '(?i)(<meta\\b[^>]*\\b(?:name|property)=[\"'']{name}[\"''][^>]*>)', 1)"
    return f"regexp_extract({tag}, '(?i)\\bcontent=[\"'']([^\"'']*)', 1)"


_PRIVATE = (
    "(a IN (0, 10, 127) OR a >= 224 OR a = 100 AND b BETWEEN 64 AND 127 OR a = 169 AND b = 254 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 198 AND b IN (18, 19))"
)
_SEGMENTS = f"list_filter(list_transform(string_split_regex(text, '\\n{WS}*\\n'), lambda x: {TRIM('x')}), lambda x: regexp_matches(x, '[A-Za-z]'))"
_NON_BLANK = f"list_filter(list_transform(string_split_regex(text, '\\n{WS}*\\n'), lambda x: {TRIM('x')}), lambda x: x <> '')"
_ROWS = lambda arr, frm: f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x[i] AS text FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, {arr} AS x FROM {frm}))"
_NWORDS = lambda t: f"(CASE WHEN {TRIM(t)} = '' THEN 0 ELSE len(string_split_regex({TRIM(t)}, '{WS}+')) END)"

_LINK_TEXT = "list_transform(range(1, len(a) + 1), lambda i: a[i] || ' ' || b[i])"
#: Parts of each page, as page_parts() has them.
_AUDITED = f"""WITH p AS (SELECT page_id, html || repeat('{HABITS[0].replace("'", "''")}', page_id % 7) || repeat('{HABITS[1]}', page_id % 3) AS html FROM pages), q AS (SELECT page_id, html, {VISIBLE('html')} AS text, array_to_string(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1), chr(10)) || chr(10) AS css, {_BODY} AS body FROM p),
r AS (SELECT *, array_to_string(regexp_extract_all(body, '\\bclass(?:Name)?="([^"]*)"', 1), ' ') AS classes, list_transform(regexp_extract_all(body, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>', 1), lambda h: {VISIBLE('h')}) AS headings,
  regexp_extract_all(body, '(?is)<a\\b([^>]*)>(.*?)</a>', 1) AS a, list_transform(regexp_extract_all(body, '(?is)<a\\b([^>]*)>(.*?)</a>', 2), lambda h: {VISIBLE('h')}) AS b FROM q),
parts AS (SELECT *, {_LINK_TEXT} AS links, list_sort(list_distinct(list_transform(list_concat(list_concat(regexp_extract_all(css || ' ' || html, '{RE(audit.FONT)}', 1), regexp_extract_all(css || ' ' || html, '{RE(audit.FONT_LINK)}', 1)), regexp_extract_all(css || ' ' || html, '{RE(audit.FONT_MODULE)}', 1)), lambda x: translate(x, '+_', '  ')))) AS fonts,
  trim(regexp_extract(text, '{RE(audit.NOT_X)}', 0)) AS phrase FROM r)"""


def _counted_sql(name: str, column: str, pattern: str) -> str:
    if "(?!" in pattern:  # shadows: without look-ahead, whole values are taken and then looked at
        return f"len(list_filter(regexp_extract_all({column}, 'box-shadow:\\s*([^;}}]*)', 1), lambda x: NOT regexp_matches(x, '^(?:none|0 0 0)') AND regexp_matches(x, '\\d+px[^;}}]*\\d+px')))"
    return _FOUND(RE(pattern), column)


def _audit_rows() -> list[tuple[str, str, str, str, str]]:
    """(id, group, hit, n, sample) of each check."""
    rows = []
    for name, (group, least, parts) in audit.COUNTED.items():
        n = " + ".join(_counted_sql(name, c, p) for c, p in parts)
        rows.append((name, group, f"{n} >= {least}", n, "NULL"))
    kinds = lambda p: f"len(list_distinct(regexp_extract_all(classes, '{RE(p)}', 1)))"
    emojis, purple = _FOUND(RE(features.EMOJI)), _FOUND(RE(audit.PURPLE_CLASS), "classes") + " + " + _FOUND(RE(audit.PURPLE_HEX), "css")
    heads = f"list_filter(headings, lambda h: regexp_matches(h, '{RE(features.EMOJI)}'))"
    white = f"(regexp_matches(regexp_extract(html, '(?i)(<body\\b[^>]*>)', 1), '\\bbg-white\\b') OR regexp_matches(css, '{RE(audit.WHITE)}'))"
    bento, dots = _FOUND(r"\b(?:md:|lg:)?(?:col|row)-span-2\b", "classes"), f"regexp_matches(html, '{audit.DOTS}')"
    without = lambda p: f"len(list_filter(links, lambda x: regexp_matches(x, '{p}')))"
    return rows + [
        ("not-x-its-y", "Copy", "phrase <> ''", "CAST(phrase <> '' AS INTEGER)", "substring(phrase, 1, 90)"),
        ("emojis", "Copy", f"len({heads}) > 0 OR {emojis} >= 5", emojis, f"substring({heads}[1], 1, 60)"),
        ("fonts", "Type and icons", "len(fonts) > 0", "len(fonts)", "array_to_string(fonts, ', ')"),
        ("purple-black", "Colour", f"{purple} >= 3 AND regexp_matches(classes || ' ' || css || ' ' || substring(html, 1, 4000), '{RE(audit.DARK)}')", purple, "NULL"),
        ("rainbow", "Colour", f"{kinds(audit.HUES)} >= 5", kinds(audit.HUES), "NULL"), ("pastel", "Colour", f"{kinds(audit.PASTEL)} >= 4", kinds(audit.PASTEL), "NULL"),
        ("pure-white", "Colour", white, f"CAST({white} AS INTEGER)", "NULL"), ("bento", "Layout", f"{bento} >= 2 OR regexp_matches(classes, '(?i)\\bbento\\b')", bento, "NULL"),
        ("terminal", "Layout", dots, f"CAST({dots} AS INTEGER)", "NULL"),
        ("no-terms", "Trust", without(r"(?i)terms|\btos\b") + " = 0", without(r"(?i)terms|\btos\b"), "NULL"), ("no-privacy", "Trust", without("(?i)privacy") + " = 0", without("(?i)privacy"), "NULL"),
    ]


_AUDIT = " UNION ALL ".join(f"SELECT page_id, '{k}' AS id, '{g}' AS \"group\", coalesce({hit}, false) AS hit, CAST({n} AS INTEGER) AS n, CAST({sample} AS VARCHAR) AS sample FROM parts" for k, g, hit, n, sample in _audit_rows())
AUDIT_SQL = f"{_AUDITED} {_AUDIT}"
SUMMARY_SQL = f"""{_AUDITED}, found AS ({_AUDIT}) SELECT page_id, count(*) FILTER (hit) AS found, count(*) AS total,
  any_value((SELECT length(regexp_replace(h.html, '(?is)<script\\b.*?</script>', '', 'g')) < 3000 FROM p h WHERE h.page_id = found.page_id)) AS partial FROM found GROUP BY page_id"""
_REST = "regexp_replace(url, '^[a-z]+://', '')"
_SLASHED = lambda x: f"(CASE WHEN regexp_matches({x}, '^[a-z]+://[^/?#]+/') THEN {x} ELSE regexp_replace({x}, '^([a-z]+://[^/?#]+)', '\\1/') END)"
ADDRESSES_SQL = f"""SELECT page_id, given, CASE page_id % 8 WHEN 0 THEN {_SLASHED('url')} WHEN 1 THEN {_SLASHED(f"'http://' || {_REST}")} WHEN 2 THEN {_SLASHED(f"'https://' || {_REST}")} WHEN 6 THEN {_SLASHED('given')} END AS url,
  CASE WHEN page_id % 8 IN (4, 5) THEN 'not a public address' WHEN page_id % 8 = 7 THEN 'not an address' WHEN page_id % 8 = 3 THEN 'has credentials' END AS error
FROM (SELECT page_id, url, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN ' HTTP://' || {_REST} || ' ' WHEN 2 THEN {_REST} WHEN 3 THEN 'https://me:pw@' || {_REST} WHEN 4 THEN 'localhost/' || page_id WHEN 5 THEN 'ftp://' || {_REST}
  WHEN 6 THEN 'https://' || regexp_replace({_REST}, '^([^/?#]+)', '\\1:8080') ELSE 'https://' END AS given FROM pages)"""

QUERIES = {
    "sg1_segment": sg1_segment, "sg2_segment_spans": sg2_segment_spans, "sg3_split_blank": sg3_split_blank, "sg4_long_lines": sg4_long_lines, "sg5_training_paragraphs": sg5_training_paragraphs,
    "sg6_sg8_clean": sg6_sg8_clean, "sg7_markdown_prose": sg7_markdown_prose, "tk_words": tk_words, "tk_sentences": tk_sentences, "tk6_find_all": tk6_find_all, "rules_values": rules_values,
    "tk7_tell_spans": tk7_tell_spans, "tk7_utf16_spans": tk7_utf16_spans,
    "rules_all": rules_all, "style_values": style_values, "fx1_vectors": fx1_vectors, "ht1_visible_text": ht1_visible_text, "ht2_html_paragraphs": ht2_html_paragraphs, "ht3_page_parts": ht3_page_parts,
    "ht4_content_blocks": ht4_content_blocks, "ht7_attach_css": ht7_attach_css, "ur_urls": ur_urls, "ur1_addresses": ur1_addresses, "ur2_private": ur2_private, "ur5_default_off": ur5_default_off,
    "audit_pages": audit_pages, "audit_copy": audit_copy, "audit_summary": audit_summary,
}
SQL = {
    "sg1_segment": f"WITH {DOUBLE} " + _ROWS(_SEGMENTS, "documents_2"), "sg2_segment_spans": f"WITH {DOUBLE} " + _ROWS(_SEGMENTS, "documents_2"), "sg3_split_blank": f"WITH {DOUBLE} " + _ROWS(_NON_BLANK, "documents_2"),
    "sg4_long_lines": "SELECT * FROM (" + _ROWS("string_split(text, chr(10))", "documents") + f") WHERE {_NWORDS('text')} >= 25",
    "sg6_sg8_clean": f"""SELECT doc_id, replace(text, chr(10), ' ') AS unwrapped, {TRIM("regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '" + _FLAGS(T.FENCED) + "', '', 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '" + _FLAGS(T.TABLE_ROW) + "', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')")} AS prose,
  regexp_matches(text, '{_FLAGS(T.CODE)}') AS code, regexp_matches({TRIM('text')}, '{T.THOUGHT}') AS reasoning, {_NWORDS('text')} < 25 AS short FROM documents""",
    "tk_words": f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(w, ' ')) AS words_md5, round(CASE WHEN len(w) > 0 THEN e / len(w) ELSE 0 END, 9) AS english_share, CASE WHEN len(w) > 0 THEN e / len(w) ELSE 0 END >= 0.1 AS english
FROM (SELECT doc_id, w, len(list_filter(w, lambda x: list_contains({_in(T.ENGLISH_WORDS)}, x))) AS e FROM (SELECT doc_id, {WORDS("replace(text, chr(8217), '''')")} AS w FROM documents))""",
    "tk_sentences": f"WITH {PARSED} SELECT doc_id, CAST(len(st) AS INTEGER) AS n_sentences, md5(array_to_string(st, '|')) AS sentences_md5, CAST(len(lines) AS INTEGER) AS n_lines FROM parsed",
    "tk6_find_all": "SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, x[i] AS hit FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS x FROM documents))",
    "tk7_tell_spans": TELLS_SQL, "tk7_utf16_spans": UNITS_SQL,
    "rules_values": RULES_SQL, "style_values": f"WITH {PARSED} SELECT doc_id, " + ", ".join(f"round(CAST({v} AS DOUBLE), 6) AS v{i}" for i, v in enumerate(STYLE_SQL)) + " FROM full_parsed", "rules_all": RULE_ROWS_SQL, "fx1_vectors": VECTOR_SQL,
    "ht1_visible_text": f"SELECT page_id, md5({VISIBLE('html')}) AS text_md5 FROM pages",
    "ht2_html_paragraphs": f"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, x[i] AS text FROM (SELECT page_id, x, unnest(range(1, len(x) + 1)) AS i FROM (
  SELECT page_id, list_filter(list_transform(regexp_extract_all(html, '(?is)<p\\b[^>]*>(.*?)</p>', 1), lambda h: {VISIBLE('h')}), lambda p: len(string_split_regex(p, '{WS}+')) >= 25) AS x FROM pages))""",
    "ht3_page_parts": f"""SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<style\\b[^>]*>(.*?)</style>', 1), chr(10)) || chr(10) AS css, array_to_string(regexp_extract_all(body, '\\bclass(?:Name)?="([^"]*)"', 1), ' ') AS classes,
  array_to_string(list_transform(regexp_extract_all(body, '(?is)<h[1-3]\\b[^>]*>(.*?)</h[1-3]>', 1), lambda h: {VISIBLE('h')}), '|') AS headings, array_to_string({_LINKS}, '|') AS links
FROM (SELECT *, regexp_extract_all(body, '(?is)<a\\b([^>]*)>(.*?)</a>', 1) AS a, list_transform(regexp_extract_all(body, '(?is)<a\\b([^>]*)>(.*?)</a>', 2), lambda h: {VISIBLE('h')}) AS t FROM (SELECT page_id, html, {_BODY} AS body FROM pages))""",
    "ht7_attach_css": "SELECT page_id, '/* ' || regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || '/a.css */' || chr(10) AS css FROM pages",
    "ur_urls": f"SELECT page_id, host, CAST(NULL AS VARCHAR) AS error, CASE {_site_sql()} ELSE 'other' END AS site_class FROM (SELECT page_id, {_HOST} AS host, {_SQL_PATH} AS path, {_meta_sql('og:type')} AS og_type, {_meta_sql('generator')} AS generator FROM pages)",
    "ur2_private": f"SELECT event_id, {_PRIVATE} AS private, {_PRIVATE} AS mapped FROM (SELECT event_id, event_id * 7 % 256 AS a, event_id * 13 % 256 AS b FROM events)",
    "ur5_default_off": f"""WITH h AS (SELECT page_id, {_HOST} AS host FROM pages), l AS (SELECT DISTINCT regexp_extract(host, '([^.]+\\.[^.]+\\.[^.]+)$', 1) AS domain FROM h WHERE page_id % 7 = 0)
SELECT page_id, host, regexp_matches(host, '{web.OFF_PATTERN}') OR EXISTS (SELECT 1 FROM l WHERE host = domain OR ends_with(host, '.' || domain)) AS off FROM h""",
    "audit_pages": AUDIT_SQL, "audit_summary": SUMMARY_SQL, "ur1_addresses": ADDRESSES_SQL,
}
SQL["audit_copy"] = f"""SELECT page_id, 'machine-copy' AS id, 'Copy' AS "group", coalesce(read >= 5 AND machine >= 0.2 * read, false) AS hit, CAST(coalesce(machine, 0) AS INTEGER) AS n FROM pages LEFT JOIN (
  SELECT page_id, count(*) AS read, count(*) FILTER (length(text) % 4 = 0) AS machine FROM ({SQL['ht2_html_paragraphs']}) WHERE pos < 60 GROUP BY page_id) USING (page_id)"""
