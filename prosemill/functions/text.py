"""Column functions on text: normalising, segmenting, tokenising, cleaning.

Spark's own \\s, \\b and \\w follow Java, so white space and word characters are written out as classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .offsets import UNITS, bare, matches, once, prefix_sums

#: White space and word patterns.
ANY_WS = r"[\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
#: The same characters, of which the wide ones are only looked up for wide ones; Java tries a class's parts one by one.
WS = r"[\t\n\x0B\f\r \u00A0[\u1680-\uFEFF&&[\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]]]"
NOT_WS = r"[^\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
WORD = r"[A-Za-z\u00C0-\u024F]+(?:['\u2019][A-Za-z]+)*|[0-9]+(?:[.,][0-9]+)*"
SENTENCE_END = r"([.!?\u2026]+[\"'\u201D\u2019)\]]*)(?=" + WS + r"|\z)|\n+(?![ \t]*[a-z])"
MARK = "\x1e"
#: What stands before and after a word, which starts and ends with an ASCII word character.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: The words by whose share English is told.
ENGLISH_WORDS = (
    "the of and to in is it that was for on are as with his her they be this from or had by but what were we when your there their which been these "
    "who will would about into them than then its our you he she have has not"
).split()
MIN_WORDS = 25


def trim(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def space_words(c: Column) -> Column:
    """Pieces between white space; an empty text has one empty piece."""
    return F.split(trim(c), f"{WS}+")


def count_space_words(c: Column) -> Column:
    t = trim(c)
    return F.when(t == "", 0).otherwise(F.size(F.split(t, f"{WS}+")))


def normalise_quotes(c: Column) -> Column:
    return F.replace(c, F.lit("\u2019"), F.lit("'"))


def words(c: Column) -> Column:
    """Lower-cased words and numbers."""
    return F.transform(F.regexp_extract_all(c, F.lit(WORD), 0), F.lower)


def raw_words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def sentence_texts(c: Column) -> Column:
    """Trimmed sentences that hold a word. A line break ends one unless the next line starts in lower case."""
    pieces = F.split(F.regexp_replace(c, SENTENCE_END, "$1" + MARK), MARK)
    return F.filter(F.transform(pieces, trim), lambda s: s.rlike(WORD))


def sentences(c: Column) -> Column:
    """array<struct<text, words, first>>: sentences with their words, and the first word as written."""
    return F.transform(sentence_texts(c), lambda s: F.struct(s.alias("text"), words(s).alias("words"), F.regexp_extract(s, WORD, 0).alias("first")))


def lines(c: Column) -> Column:
    return F.filter(F.split(c, "\n", -1), lambda x: x.rlike(NOT_WS))


def english_share(ws: Column) -> Column:
    """Share of English function words; 0 without words."""
    return F.when(F.size(ws) > 0, F.size(F.filter(ws, lambda w: w.isin(*ENGLISH_WORDS))) / F.size(ws)).otherwise(0.0)


def is_english(ws: Column) -> Column:
    return english_share(ws) >= 0.1


def find_all(c: Column, pattern: str, units: str = "points") -> Column:
    """array<struct<start, end>> of all matches, in code points or, for units utf16, in UTF-16 units; the pattern has no groups that matter."""
    return bare(matches(c, pattern, length=UNITS[units]))


# -- segments


def unix_lines(c: Column) -> Column:
    return F.regexp_replace(c, "\r\n?", "\n")


BLANK = r"\n" + WS + r"*\n"


def segment(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """keys, pos, text: chunks between blank lines that hold an ASCII letter, trimmed, numbered from 0 among those kept."""
    pieces = F.filter(F.transform(F.split(unix_lines(F.col(text)), BLANK), trim), lambda p: p.rlike("[A-Za-z]"))
    return df.select(*keys, F.posexplode(pieces).alias("pos", "text"))


def segment_spans(df: DataFrame, text: str, keys: list[str], units: str = "points") -> DataFrame:
    """keys, pos, start, end: where segment's chunks stand in the text with unified line ends, in code points or UTF-16 units (utf16)."""
    t, length = unix_lines(F.col(text)), UNITS[units]
    pieces, gaps = F.split(t, BLANK, -1), F.regexp_extract_all(t, F.lit(BLANK), 0)
    both = F.zip_with(pieces, gaps, lambda p, g: F.struct(p.alias("p"), F.coalesce(length(g), F.lit(0)).alias("g")))

    def placed(found: Column) -> Column:
        starts = prefix_sums(F.transform(found, lambda x: length(x["p"]) + x["g"]))
        lead = lambda p: length(p) - length(F.regexp_replace(p, f"^{WS}+", ""))
        at = lambda x, s: F.struct((s + lead(x["p"])).alias("start"), (s + lead(x["p"]) + length(trim(x["p"]))).alias("end"), x["p"].rlike("[A-Za-z]").alias("keep"))
        return F.filter(F.zip_with(found, starts, at), lambda y: y["keep"])

    return df.select(*keys, F.posexplode(once(both, placed)).alias("pos", "s")).select(*keys, "pos", "s.start", "s.end")


def split_blank(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    pieces = F.filter(F.transform(F.split(unix_lines(F.col(text)), BLANK), trim), lambda p: p != "")
    return df.select(*keys, F.posexplode(pieces).alias("pos", "text"))


def split_lines_min_words(df: DataFrame, text: str, keys: list[str], n: int = MIN_WORDS) -> DataFrame:
    """keys, pos, text: lines of at least n words; pos is the line's number."""
    return df.select(*keys, F.posexplode(F.split(F.col(text), "\n", -1)).alias("pos", "text")).filter(count_space_words(F.col("text")) >= n)


#: Median and spread of the logarithm of a chunk's words.
CHUNK_WORDS, CHUNK_SPREAD = 40.0, 0.65


def chunk_words(*seed: Column, min_words: int = MIN_WORDS) -> Column:
    """A number of words drawn by hash: e to a normal variable, at least min_words."""
    unit = lambda k: (F.pmod(F.xxhash64(*seed, F.lit(k)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    normal = F.sqrt(-2 * F.log(unit(1))) * F.cos(2 * F.pi() * unit(2))
    return F.greatest(F.lit(min_words), F.floor(F.lit(CHUNK_WORDS) * F.exp(F.lit(CHUNK_SPREAD) * normal)).cast("int"))


def training_paragraphs(df: DataFrame, text: str, keys: list[str], limit: int = 2, min_words: int = MIN_WORDS) -> DataFrame:
    """keys, pos, text: at most limit paragraphs of a document.

    Blocks between blank lines with enough words, blanks and tabs in them squeezed, are filled sentence by sentence up to a size that is
    drawn anew for each chunk (see chunk_words); what remains is kept if it has enough words. Documents without such a block give no rows.
    """
    blocks = F.filter(F.transform(F.split(trim(unix_lines(F.col(text))), BLANK), lambda b: F.regexp_replace(trim(b), "[ \\t]+", " ")), lambda b: count_space_words(b) >= min_words)
    exploded = df.select(*keys, F.posexplode(blocks).alias("block", "body"))
    parts = F.split(F.regexp_replace("body", r"(?<=[.!?])(" + WS + "+)", MARK + "$1"), MARK)
    target = lambda out: chunk_words(F.col("body"), F.size(out), min_words=min_words)

    def fill(s: Column, x: Column) -> Column:
        joined = F.concat(s["now"], x)
        full = F.concat(s["out"], F.array(trim(joined)))
        return F.when(count_space_words(joined) >= s["target"], F.struct(F.lit("").alias("now"), full.alias("out"), target(full).alias("target"))).otherwise(
            F.struct(joined.alias("now"), s["out"].alias("out"), s["target"].alias("target"))
        )

    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), empty.alias("out"), target(empty).alias("target"))
    filled = F.aggregate(parts, start, fill, lambda s: F.when(count_space_words(s["now"]) >= min_words, F.concat(s["out"], F.array(trim(s["now"])))).otherwise(s["out"]))
    cut = exploded.select(*keys, "block", F.posexplode(filled).alias("part", "text"))
    best = cut.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(F.struct("block", "part", "text"))), 1, limit).alias("rows"))
    return best.select(*keys, F.posexplode("rows").alias("pos", "row")).select(*keys, "pos", "row.text")


# -- cleaning


def unwrap_soft(c: Column) -> Column:
    """Single line breaks become spaces; runs of them stay."""
    return F.regexp_replace(c, r"(?<!\n)\n(?!\n)", " ")


def markdown_prose(c: Column) -> Column:
    """Without fenced code, HTML comments and headings."""
    c = F.regexp_replace(unix_lines(c), r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[ \t]*$|\z)", "")
    c = F.regexp_replace(c, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(c, r"(?m)^#{1,6}[ \t].*$", "")


#: Fences and table rows of documents, signs of code, beginnings of leaked thoughts.
FENCED = r"(?md)^ {0,3}(?:```|~~~)[\s\S]*?(?:```|~~~)\s*$"
TABLE_ROW = r"(?md)^\s*\|.*\|\s*$"
CODE = r"(?md)```|^\s{4}\S|[{};]\s*$|^\s*\"[^\"\n]{1,60}\"\s*:"
THOUGHT = r"(?i)^(?:<think|the user (?:wants|is asking|asked)|let me think)"


def document_prose(c: Column) -> Column:
    """Without fences, images and table rows; at most one blank line between paragraphs."""
    c = F.regexp_replace(unix_lines(c), FENCED, "")
    c = F.regexp_replace(c, r"!\[[^\]]*\]\([^)]*\)", "")
    c = F.regexp_replace(c, TABLE_ROW, "")
    return trim(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def looks_like_code(c: Column) -> Column:
    return c.rlike(CODE)


def looks_like_reasoning(c: Column) -> Column:
    """Whether a text begins as a model's leaked thoughts do."""
    return trim(c).rlike(THOUGHT)


def too_short(c: Column, n: int = MIN_WORDS) -> Column:
    return count_space_words(c) < n
