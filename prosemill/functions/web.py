"""Column functions on URLs, addresses and HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prosemill.operators.skew import join_hot

from . import text as T

#: Decoded in this order, so doubly escaped text is decoded twice.
ENTITIES = ((r"&nbsp;", " "), (r"&amp;", "&"), (r"&#39;|&apos;|&rsquo;", "'"), (r"&quot;", '"'), (r"&mdash;", "\u2014"), (r"&#8212;", "\u2014"))
#: Site classes in order; pattern of the host, then of another signal. A correction carries the class that a reader's page
#: had (see feedback.SITES), so a host must get the class here that it has there; site_class takes other rules too.
SITE_RULES = (
    ("social", r"(^|\.)(twitter|x|facebook|instagram|linkedin|threads|bsky|tiktok|youtube|mastodon)\.", None, None),
    ("forum", r"(^|\.)(reddit|quora|stackoverflow|stackexchange|ycombinator|discord)\.|^(forums?|community|discuss)\.", "generator", "(?i)discourse"),
    ("reference", r"(^|\.)(wikipedia|wiktionary|wikimedia|britannica|fandom)\.|\.wiki$", None, None),
    ("docs", r"^(docs|developers?|devdocs|learn)\.", "path", r"/docs?/"),
    ("shop", r"(^|\.)(amazon|ebay|etsy|walmart|aliexpress|bestbuy|shopify)\.", "og_type", "^product$"),
    ("news", r"(^|\.)(nytimes|bbc|cnn|theguardian|reuters|apnews|washingtonpost|wsj|bloomberg|npr|ft|economist|theverge|arstechnica|wired|axios|politico)\.|news", None, None),
    ("blog", r"(^|\.)(medium|substack|wordpress|blogspot|ghost|tumblr|hashnode)\.|blog", "og_type", "^article$"),
)
OFF_PATTERN = r"(^|\.)(mail|webmail|outlook)\.|bank"


def visible_text(html: Column) -> Column:
    """Without scripts, styles and tags, six references decoded, white space squeezed."""
    out = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|template)\b.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for pattern, to in ENTITIES:
        out = F.regexp_replace(out, pattern, to)
    return T.trim(F.regexp_replace(out, T.WS + "+", " "))


def html_paragraphs(df: DataFrame, html: str, keys: list[str], min_words: int = T.MIN_WORDS) -> DataFrame:
    """keys, pos, text: visible texts of p elements with enough words, numbered among those kept."""
    bodies = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), 1)
    kept = F.filter(F.transform(bodies, visible_text), lambda p: F.size(F.split(p, T.WS + "+")) >= min_words)
    return df.select(*keys, F.posexplode(kept).alias("pos", "text"))


def page_parts(df: DataFrame, html: str = "html", css: str | None = None) -> DataFrame:
    """df with text, css, classes, headings and links of its pages; scripts and styles don't count for the last three."""
    h = F.coalesce(F.col(html), F.lit(""))
    body = F.regexp_replace(h, r"(?is)<(script|style)\b.*?</\1>", " ")
    inline = F.array_join(F.regexp_extract_all(h, F.lit(r"(?is)<style\b[^>]*>(.*?)</style>"), 1), "\n")
    sheet = F.concat(inline, F.lit("\n"), F.coalesce(F.col(css), F.lit("")) if css else F.lit(""))
    attrs, inner = (F.regexp_extract_all(body, F.lit(r"(?is)<a\b([^>]*)>(.*?)</a>"), i) for i in (1, 2))
    names = [c for c in df.columns if c not in ("text", "css", "classes", "headings", "links")]
    return df.select(
        *names, visible_text(h).alias("text"), sheet.alias("css"), F.array_join(F.regexp_extract_all(body, F.lit(r'\bclass(?:Name)?="([^"]*)"'), 1), " ").alias("classes"),
        F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h[1-3]\b[^>]*>(.*?)</h[1-3]>"), 1), visible_text).alias("headings"),
        F.zip_with(attrs, inner, lambda a, t: F.concat(a, F.lit(" "), visible_text(t))).alias("links"),
    )


def stylesheet_links(pages: DataFrame, keys: list[str], url: str = "url", html: str = "html", limit: int = 6) -> DataFrame:
    """keys, ord, href: the first stylesheet links of each page, as absolute addresses."""
    tags = F.filter(F.regexp_extract_all(F.col(html), F.lit(r"(?i)<link\b[^>]*>"), 0), lambda t: t.rlike(r"(?i)\brel=[\"']?stylesheet"))
    refs = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?i)\bhref=[\"']?([^\"' >]+)", 1)), lambda h: h != "")
    listed = pages.select(*keys, F.col(url).alias("_page"), F.posexplode(F.slice(refs, 1, limit)).alias("ord", "_href"))
    origin = F.regexp_extract("_page", r"^([a-zA-Z]+://[^/?#]+)", 1)
    folder = F.regexp_extract("_page", r"^([a-zA-Z]+://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    href = (
        F.when(F.col("_href").rlike("^[a-zA-Z]+:"), F.col("_href")).when(F.col("_href").startswith("//"), F.concat(F.regexp_extract("_page", "^([a-zA-Z]+:)", 1), "_href"))
        .when(F.col("_href").startswith("/"), F.concat(origin, "_href")).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), "_href"))
    )
    return listed.select(*keys, "ord", href.alias("href"))


def attach_css(pages: DataFrame, css: DataFrame, keys: list[str]) -> DataFrame:
    """pages with css: the bodies of their stylesheets from css (url, body), in order; a missing one is empty."""
    links = stylesheet_links(pages, keys)
    got = links.join(css.select(F.col("url").alias("href"), "body"), "href", "left").groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("ord", F.coalesce("body", F.lit("")).alias("body")))).alias("sheets"))
    return pages.drop("css").join(got, keys, "left").withColumn("css", F.coalesce(F.array_join(F.transform("sheets", lambda s: s["body"]), "\n"), F.lit(""))).drop("sheets")


def hostname(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def is_ipv4(host: Column) -> Column:
    return host.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$")


def normalise_url(url: Column) -> Column:
    """struct<url, error>: with https where no scheme is given; error instead of what isn't a public web address."""
    t = T.trim(url)
    full = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = hostname(full)
    port = F.regexp_extract(full, r"^[a-zA-Z]+://(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*)(:[^/?#]*)?", 1)
    bad = t.isNull() | (host == "") | host.rlike(r"[^a-z0-9.\[\]:_\u0080-\uffff-]") | ~port.rlike("^(?::[0-9]{0,5})?$")
    error = (
        F.when(bad, "not an address").when(full.rlike(r"^[a-zA-Z]+://[^/?#]*@"), "has credentials")
        .when(~host.contains(".") & ~host.startswith("["), "not a public address").otherwise(F.lit(None).cast("string"))
    )
    path = F.regexp_replace(full, r"^[a-zA-Z]+://[^/?#]*", "")
    clean = F.concat(F.lower(F.regexp_extract(full, "^([a-zA-Z]+)://", 1)), F.lit("://"), host, port, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path)))
    return F.struct(F.when(error.isNull(), clean).alias("url"), error.alias("error"))


def is_private_address(ip: Column) -> Column:
    """Whether an address is private, local or reserved; IPv4 in IPv6 form is told by its IPv4 part."""
    v6 = F.lower(ip)
    mapped = F.regexp_replace(v6, "^::ffff:", "")
    a, b = (F.split(mapped, r"\.")[i].try_cast("int") for i in (0, 1))
    v4 = a.isin(0, 10, 127) | (a >= 224) | ((a == 100) & b.between(64, 127)) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 198) & b.isin(18, 19))
    return F.when(is_ipv4(mapped), v4).otherwise(v6.isin("::", "::1") | v6.rlike("^(?:fc|fd|fe8|fe9|fea|feb)"))


def site_class(host: Column, path: Column, og_type: Column, generator: Column, rules=SITE_RULES) -> Column:
    """The first rule that the host or the rule's other signal meets; other if none."""
    h, signals = F.regexp_replace(host, r"^www\.", ""), {"path": path, "og_type": og_type, "generator": generator}
    out = F.lit("other")
    for name, pattern, signal, value in reversed(rules):
        hit = h.rlike(pattern)
        out = F.when(hit | F.coalesce(signals[signal], F.lit("")).rlike(value) if signal else hit, name).otherwise(out)
    return out


def meta_content(html: Column, name: str) -> Column:
    tag = F.regexp_extract(html, rf"(?i)(<meta\b[^>]*\b(?:name|property)=[\"']{name}[\"'][^>]*>)", 1)
    return F.regexp_extract(tag, r"(?i)\bcontent=[\"']([^\"']*)", 1)


def default_off_host(df: DataFrame, host: str, domains: DataFrame) -> DataFrame:
    """df with off: whether the host or a domain above it is in domains (domain), or looks like a mail or bank host.

    Each host is looked up once; the answers for hosts of very many rows go to where these are. A null host has a null off.
    """
    h = F.col(host)
    parts = F.split("_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    listed = df.filter(h.isNotNull()).select(h.alias("_host")).distinct().select("_host", F.explode(above).alias("domain"))
    hit = listed.join(domains.select("domain").distinct(), "domain", "left_semi").select(F.col("_host").alias(host)).distinct().withColumn("_hit", F.lit(True))
    return join_hot(df, hit, host, "left").withColumn("off", F.coalesce("_hit", F.lit(False)) | h.rlike(OFF_PATTERN)).drop("_hit")
