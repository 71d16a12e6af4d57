"""Page audit: template habits counted by patterns, one projection a page, as rows of page and check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.functions import features, web

#: Simple checks, each with its group, the least sum of matches, and (column, pattern) to be counted.
COUNTED: dict[str, tuple[str, int, tuple[tuple[str, str], ...]]] = {
    "em-dash": ("Copy", 2, (("text", "\u2014"),)),
    "checkmarks": ("Copy", 3, (("text", "[\u2713\u2714\u2705\u2611]"), ("html", r"\blucide-(?:circle-)?check(?:-circle)?\b"))),
    "lucide": ("Type and icons", 3, (("html", r'<svg\b[^>]*\bclass="[^"]*\blucide\b'),)),
    "sparkles": ("Type and icons", 1, (("html", r"\blucide-sparkles?\b"), ("text", "\u2728"))),
    "gradients": ("Surfaces", 3, (("css", r"linear-gradient\("), ("classes", r"\bbg-(?:gradient|linear)-to-[a-z]{1,2}\b"), ("classes", r"\bbg-clip-text\b"))),
    "orbs": ("Surfaces", 1, (("classes", r"\bblur-(?:2xl|3xl|\[\d{2,3}px\])\b"), ("css", r"filter:\s*blur\((?:[4-9]\d|\d{3})px\)"))),
    "shadows": ("Surfaces", 5, (("classes", r"\bshadow-(?:md|lg|xl|2xl)\b"), ("css", r"box-shadow:\s*(?!none|0 0 0)[^;}]*\d+px[^;}]*\d+px"))),
    "glass": ("Surfaces", 1, (("classes", r"\bbackdrop-blur(?:-[a-z0-9]+)?\b"), ("css", r"backdrop-filter:\s*blur"))),
    "radius": ("Surfaces", 5, (("classes", r"\brounded-(?:2xl|3xl)\b"), ("css", r"border-radius:\s*(?:1[6-9]|[2-9]\d)px"))),
    "left-stripe": ("Surfaces", 1, (("classes", r"\bborder-l-(?:[2-8]|\[\d+px\])\b"), ("css", r"border-left:\s*[2-8]px\s+solid"))),
    "dot-grid": ("Surfaces", 1, (("css", r"radial-gradient\([^)]*\b1px\b[^)]*\)"), ("classes", r"\b(?:bg-dot|dot-pattern|bg-grid)\b"))),
    "neon": ("Colour", 3, (("css", r"text-shadow:\s*0\s+0\s+\d+px"), ("classes", r"\bdrop-shadow-\[0_0_\d+px"), ("classes", r"\b(?:text|bg)-(?:lime|cyan|fuchsia)-(?:300|400)\b"))),
    "three-cards": ("Layout", 1, (("classes", r"\b(?:sm:|md:|lg:)?grid-cols-3\b"),)),
    "pricing": ("Layout", 3, (("text", r"(?i)\$\s?\d+(?:\.\d{2})?\s*/\s*(?:mo|month|user)\b"),)),
    "arrows": ("Layout", 1, (("classes", r"\bgroup-hover:translate-x-(?:0\.5|1|2)\b"),)),
    "hover": ("Layout", 3, (("classes", r"\bhover:(?:scale-\d+|-translate-y-[\d.]+|rotate-\d+)\b"),)),
}
#: Patterns of the other checks.
PURPLE_CLASS = r"\b(?:bg|text|from|via|to|border|ring|fill)-(?:purple|violet|indigo|fuchsia)-\d{2,3}\b"
PURPLE_HEX = r"(?i)#(?:7c3aed|8b5cf6|a855f7|9333ea|6366f1|4f46e5|a78bfa|c084fc|6d28d9|5b21b6)\b"
DARK = r"(?i)\bbg-(?:black|zinc-950|neutral-950|gray-950|slate-950)\b|background(?:-color)?:\s*(?:#000\b|#000000|#09090b|#0a0a0a|black)"
PASTEL = r"\bbg-(pink|purple|blue|green|yellow|orange|rose|sky|emerald|amber|violet|teal|lime|cyan|indigo|fuchsia|red)-(?:50|100)\b"
HUES = r"\b(?:from|via|to)-(red|orange|amber|yellow|lime|green|emerald|teal|cyan|sky|blue|indigo|violet|purple|fuchsia|pink|rose)-\d{2,3}\b"
WHITE = r"(?i)(?:^|[}\s])(?:html|body)\s*\{[^}]*background(?:-color)?:\s*(?:#fff\b|#ffffff\b|white\b|rgb\(255,\s*255,\s*255\))"
FONT = r"font-family:[^;}\"]*?\b(Inter|Geist|Space Grotesk)\b"
FONT_LINK = r"fonts\.googleapis\.com/css2?\?[^\"']*family=(Inter|Geist|Space\+Grotesk)\b"
FONT_MODULE = r"__(Inter|Geist|Space_Grotesk)_[a-z0-9]+"
DOTS = r"(?s)bg-(?:red|rose)-[45]00.{0,300}?bg-(?:yellow|amber)-[34]00.{0,300}?bg-(?:green|emerald)-[45]00"
NOT_X = (
    r"(?i)\b(?:it'?s|this is|that'?s|it isn'?t|this isn'?t)\s+not\s+(?:just\s+|only\s+)?[^.!?]{1,50}?[,;\u2014:-]\s*(?:it'?s|this is|but)\b[^.!?]{0,40}"
    r"|\bnot\s+just\s+[^.!?,]{1,40},?\s+but\s+[^.!?]{1,40}"
)


def _n(column: str, pattern: str) -> Column:
    return F.regexp_count(F.col(column), F.lit(pattern))


def _kinds(column: str, pattern: str) -> Column:
    return F.size(F.array_distinct(F.regexp_extract_all(F.col(column), F.lit(pattern), 1)))


def _none() -> Column:
    return F.lit(None).cast("string")


#: What a check gives: whether it hits, a count, a sample. More can be added under other names.
Finding = tuple[Column, Column, Column]


def checks() -> dict[str, tuple[str, Callable[[], Finding]]]:
    def counted(least: int, parts) -> Callable[[], Finding]:
        def make() -> Finding:
            n = sum((_n(c, p) for c, p in parts[1:]), _n(*parts[0]))
            return n >= least, n, _none()

        return make

    def phrase() -> Finding:
        found = F.regexp_extract("text", f"({NOT_X})".replace("((?i)", "(?i)(", 1), 1)
        return found != "", (found != "").cast("int"), F.substring(F.trim(found), 1, 90)

    def emojis() -> Finding:
        heads = F.filter("headings", lambda h: h.rlike(features.EMOJI))
        n = _n("text", features.EMOJI)
        return (F.size(heads) > 0) | (n >= 5), n, F.substring(F.get(heads, F.lit(0)), 1, 60)

    def fonts() -> Finding:
        both = F.concat_ws(" ", "css", "html")
        names = F.flatten(F.array(*[F.regexp_extract_all(both, F.lit(p), 1) for p in (FONT, FONT_LINK, FONT_MODULE)]))
        found = F.array_sort(F.array_distinct(F.transform(names, lambda x: F.translate(x, "+_", "  "))))
        return F.size(found) > 0, F.size(found), F.array_join(found, ", ")

    def purple() -> Finding:
        n = _n("classes", PURPLE_CLASS) + _n("css", PURPLE_HEX)
        return (n >= 3) & F.concat_ws(" ", "classes", "css", F.substring("html", 1, 4000)).rlike(DARK), n, _none()

    def distinct(least: int, pattern: str) -> Callable[[], Finding]:
        return lambda: (_kinds("classes", pattern) >= least, _kinds("classes", pattern), _none())

    def white() -> Finding:
        hit = F.regexp_extract("html", r"(?i)(<body\b[^>]*>)", 1).rlike(r"\bbg-white\b") | F.col("css").rlike(WHITE)
        return hit, hit.cast("int"), _none()

    def bento() -> Finding:
        n = _n("classes", r"\b(?:md:|lg:)?(?:col|row)-span-2\b")
        return (n >= 2) | F.col("classes").rlike(r"(?i)\bbento\b"), n, _none()

    def terminal() -> Finding:
        hit = F.col("html").rlike(DOTS)
        return hit, hit.cast("int"), _none()

    def missing(pattern: str) -> Callable[[], Finding]:
        def make() -> Finding:
            n = F.size(F.filter("links", lambda x: x.rlike(pattern)))
            return n == 0, n, _none()

        return make

    return {k: (group, counted(least, parts)) for k, (group, least, parts) in COUNTED.items()} | {
        "not-x-its-y": ("Copy", phrase), "emojis": ("Copy", emojis), "fonts": ("Type and icons", fonts), "purple-black": ("Colour", purple), "rainbow": ("Colour", distinct(5, HUES)),
        "pastel": ("Colour", distinct(4, PASTEL)), "pure-white": ("Colour", white), "bento": ("Layout", bento), "terminal": ("Layout", terminal),
        "no-terms": ("Trust", missing(r"(?i)terms|\btos\b")), "no-privacy": ("Trust", missing("(?i)privacy")),
    }


def audit_pages(pages: DataFrame, keys: list[str], css: str | None = None, scored: DataFrame | None = None) -> DataFrame:
    """keys, id, group, hit, n, sample: a row for each page (html) and check. scored: keys, pos, decision of page paragraphs."""
    parts = web.page_parts(pages.select(*keys, "html", *([css] if css else [])), "html", css)
    rows = []
    for name, (group, make) in checks().items():
        hit, n, sample = make()
        rows.append(F.struct(F.lit(name).alias("id"), F.lit(group).alias("group"), F.coalesce(hit, F.lit(False)).alias("hit"), n.cast("int").alias("n"), sample.alias("sample")))
    found = parts.select(*keys, F.inline(F.array(*rows)))
    if scored is None:
        return found
    read = scored.filter("pos < 60").groupBy(*keys).agg(F.count("*").alias("read"), F.count_if(F.col("decision") == "machine").alias("n"))
    copy = pages.select(*keys).join(read, keys, "left").select(
        *keys, F.lit("machine-copy").alias("id"), F.lit("Copy").alias("group"), F.coalesce((F.col("read") >= 5) & (F.col("n") >= 0.2 * F.col("read")), F.lit(False)).alias("hit"),
        F.coalesce("n", F.lit(0)).cast("int").alias("n"), F.lit(None).cast("string").alias("sample"),
    )
    return found.unionByName(copy)


def audit_summary(findings: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, found, total, partial: partial tells that a page holds under 3000 characters once scripts are removed."""
    partial = pages.select(*keys, (F.length(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?is)<script\b.*?</script>", "")) < 3000).alias("partial"))
    return findings.groupBy(*keys).agg(F.count_if("hit").alias("found"), F.count("*").alias("total")).join(partial, keys)
