"""Secret scan with corpus-wide ownership frequency, with DataFrame functions only.

Every text is scanned for candidates. The hashes of their values are counted over the whole corpus by distinct repositories and
distinct owners: a value that several owners hold, or two in many repositories, is a widely copied example; one that stays with its
owner, in however many of the owner's repositories, and looks random is taken for a live credential.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, let

#: Kinds in the order in which spans with one start are listed; pattern, the group that holds the value, its least
#: length. A match whose value is shorter is dropped, but its characters are used up.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: What the method looks for besides: keys of known shape, signed web tokens, private keys.
ADDED = {
    "vendor": (r"(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|sk_live_|rk_live_|sk-|AIza|npm_|hf_)[A-Za-z0-9_-]+", 0, 24),
    "jwt": (r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
    "pem": (r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]+", 0, 60),
}
#: Cheap conditions without which a kind can't match.
HINTS = {
    "assign": lambda t: t.rlike(r"(?i)password|passwd|secret|token|api_?key"),
    "access": lambda t: t.contains("AKIA"),
    "hex": lambda t: t.rlike(r"[0-9a-f]{24}"),
    "vendor": lambda t: t.rlike(r"gh[pousr]_|github_pat_|glpat-|xox[abprs]-|k_live_|sk-|AIza|npm_|hf_"),
    "jwt": lambda t: t.contains("eyJ"),
    "pem": lambda t: t.contains("PRIVATE KEY-----"),
}
KINDS = (*BASE, *ADDED)
SPAN = "array<struct<start:int,ord:int,end:int,kind:string,value:string>>"
#: A value that so many owners hold is a copied example, and so is one of at least two owners in so many repositories.
SHARED_OWNERS, SHARED_REPOS = 3, 5
#: Matches of a text whose places are added up at once: n of them take about n * BLOCK + (n / BLOCK)^2 steps.
BLOCK = 256
#: A value with so many rows is hot. Up to so many hot values' counts are broadcast; beyond, they are joined salted.
HOT_ROWS, BROADCAST_VALUES, SALTS = 10_000, 100_000, 64


def spans_of(t: Column, kind: str) -> Column:
    """The kind's leftmost non-overlapping matches with a value of its least length, in code points."""
    pattern, group, least = (BASE | ADDED)[kind]
    if kind == "hex":  # runs are maximal, so shorter ones need not be listed first
        pattern = r"[0-9a-f]{24,}"
    p = F.lit(pattern)
    whole, values, pieces = F.regexp_extract_all(t, p, 0), F.regexp_extract_all(t, p, group), F.split(t, pattern, -1)
    parts = F.arrays_zip(pieces.alias("piece"), whole.alias("whole"), values.alias("value"))
    empty = F.array().cast(SPAN)

    def step(s: Column, m: Column) -> Column:
        start = s["at"] + F.length(m["0"])
        end = start + F.coalesce(F.length(m["1"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("ord"), end.alias("end"), F.lit(kind).alias("kind"), m["2"].alias("value"))
        return F.struct(end.alias("at"), F.when(F.length(m["2"]) >= least, F.concat(s["spans"], F.array(span))).otherwise(s["spans"]).alias("spans"))

    def block(s: Column, ms: Column) -> Column:
        inner = F.aggregate(ms, F.struct(s["at"].alias("at"), empty.alias("spans")), step)
        return let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(s["spans"], F.array(x["spans"])).alias("spans")))

    # named by position, so that the lambda doesn't depend on how arrays_zip names expressions
    zipped = F.transform(parts, lambda x: x.cast("struct<`0`:string,`1`:string,`2`:string>"))
    blocks = let(zipped, lambda z: F.transform(F.sequence(F.lit(1), F.size(z), F.lit(BLOCK)), lambda i: F.slice(z, i, F.lit(BLOCK))))
    found = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans")), block, lambda s: F.flatten(s["spans"]))
    return F.when(HINTS[kind](t), found).otherwise(empty)


def listed(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def looks_random(value: Column) -> Column:
    """At least 8 different characters, digits and letters both, and no word of a placeholder."""
    return (F.size(F.array_distinct(F.split(value, "(?<=.)(?=.)"))) >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(?i)example|sample|changeme|placeholder|dummy|xxxx|1234567|abcdef")


def scan(docs: DataFrame, owner: str = "source", repository: str = "repository") -> DataFrame:
    """(doc_id, owner, repository, spans) of each row; spans ordered by start, then kind. Null texts have none."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    spans = F.array_sort(F.concat(*[spans_of(t, k) for k in KINDS]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), spans.alias("spans"))


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners, n_rows) over rows (hash, owner, repository), reduced to distinct triples before they are dealt by hash.

    Null owners and repositories count as one each.
    """
    triples = candidates.groupBy("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repository", F.lit("")).alias("repository")).agg(F.count("*").alias("n"))
    owners = triples.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return owners.groupBy("hash").agg(F.sum("repos").alias("n_repos"), F.count("*").alias("n_owners"), F.sum("n").alias("n_rows"))


def with_counts(each: DataFrame, counts: DataFrame) -> DataFrame:
    """each (row, span, hash) with n_owners and n_repos of its hash. Hot hashes' counts are broadcast or salted, so that no task gets a
    hot hash's rows alone."""
    counts = counts.select("hash", "n_owners", "n_repos", (F.col("n_rows") >= HOT_ROWS).alias("hot"))
    hot, cold = counts.filter("hot").drop("hot"), counts.filter("not hot").drop("hot")
    if hot.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES:
        marked = each.join(F.broadcast(hot), "hash", "left")
    else:
        salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        marked = each.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"], "left").drop("salt")
    rest = marked.filter("n_owners is null").drop("n_owners", "n_repos").join(cold, "hash")
    return marked.filter("n_owners is not null").unionByName(rest)


def find_secrets(docs: DataFrame, owner: str = "source", repository: str = "repository", shared_owners: int = SHARED_OWNERS, shared_repos: int = SHARED_REPOS) -> DataFrame:
    """(doc_id, spans, live, shared) for each row of docs (doc_id, text, the owner's and the repository's column, and any others).

    spans holds every match; shared those whose value shared_owners owners or more hold, or two or more in shared_repos repositories
    or more; live the others whose value looks random. A value within the spans of two kinds is judged for each. Null or empty texts
    give empty arrays, repeated rows come back as often as they came, an empty table gives an empty result. A null owner or
    repository counts as one.
    """
    rows = checkpointed(scan(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()))
    some = rows.filter(F.size("spans") > 0)
    each = some.select("row", "owner", "repository", F.explode("spans").alias("span")).withColumn("hash", F.sha2("span.value", 256))
    counts = checkpointed(ownership(each.select("hash", "owner", "repository")))
    copied = (F.col("n_owners") >= shared_owners) | (F.col("n_owners") >= 2) & (F.col("n_repos") >= shared_repos)
    judged = (
        with_counts(each.select("row", "span", "hash"), counts)
        .select("row", F.struct("span.*", "n_owners", "n_repos", copied.alias("shared"), (~copied & looks_random(F.col("span.value"))).alias("live")).alias("span"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list("span")).alias("judged"))
    )
    pick = lambda keep: F.coalesce(F.filter("judged", keep), F.array().cast("array<struct<start:int,ord:int,end:int,kind:string,value:string,n_owners:bigint,n_repos:bigint,shared:boolean,live:boolean>>"))
    return rows.join(judged, "row", "left").select("doc_id", "spans", pick(lambda s: s["live"]).alias("live"), pick(lambda s: s["shared"]).alias("shared"))
