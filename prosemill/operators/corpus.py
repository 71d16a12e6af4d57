"""Corpus construction: splits, caps, labels, samples, plans; and the joins between its tables.

Random choices are hash orders with a unique tie-break, so results don't depend on partitions. Caps over few, large groups first
drop what a hash threshold safely excludes, so no window sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.session import scratch

from .skew import join_hot


def hash_order(*cols: str, salt: str = "") -> Column:
    """A fixed pseudo-random string for a row: MD5 of salt and columns."""
    return F.md5(F.concat_ws("|", F.lit(salt), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).cast("binary"))


def hash_percent(group: Column, fn: str = "crc32") -> Column:
    """0..99 by the group's CRC-32, or by the first 8 digits of its MD5."""
    data = group.cast("string").cast("binary")
    return (F.crc32(data) if fn == "crc32" else F.conv(F.substring(F.md5(data), 1, 8), 16, 10).cast("long")) % 100


def hash_split(group: Column, fn: str = "crc32") -> Column:
    """test, val or train for a whole group."""
    p = hash_percent(group, fn)
    return F.when(p < 15, "test").when(p < 25, "val").otherwise("train")


def adversarial_split(split: Column, attack: Column, forced: Column) -> Column:
    """A forced split first; paraphrases of test groups are adv."""
    return F.coalesce(forced, F.when((attack == "paraphrase") & (split == "test"), "adv").otherwise(split))


def modern_flag(source: Column, sources: tuple[str, ...] = (), prefixes: tuple[str, ...] = ()) -> Column:
    out = source.isin(*sources) if sources else F.lit(False)
    for p in prefixes:
        out = out | source.startswith(p)
    return out


def length_band(df: DataFrame, text: str, low: int, high: int | None = None) -> DataFrame:
    n = T.count_space_words(F.col(text))
    return df.filter(n >= low) if high is None else df.filter(n.between(low, high))


def stratified_cap(df: DataFrame, by: list[str], n: int, key: str, salt: str = "") -> DataFrame:
    """Up to n rows of each stratum, in hash order of the key; null strata are strata. Never fewer than min(n, its rows).

    Sizes are counted first, and rows far behind the n-th in expectation are dropped before any window. What is left is written to the
    shared folder; only strata that it leaves short, such as those of few keys that repeat, are read again, with all their rows. Rows of
    one key are told apart by a hash of all columns.
    """
    u = F.conv(F.substring(F.col("_order"), 1, 8), 16, 10).cast("double") / float(1 << 32)
    ordered = df.withColumn("_order", hash_order(key, salt=salt))
    # the chance that fewer than n of a stratum's rows lie below this bound is small, if keys don't repeat
    sizes = df.groupBy(*by).agg(F.count("*").alias("_size")).withColumn("_bound", (F.lit(float(n)) + 20 * F.sqrt(F.lit(float(n))) + 400) / F.col("_size"))
    few = sizes.limit(10_001).count() <= 10_000
    small = F.broadcast if few else lambda x: x
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_order", key, F.xxhash64(*df.columns)))

    def first(bounds: DataFrame) -> DataFrame:
        same = [ordered[c].eqNullSafe(bounds[c]) for c in by]
        rows = ordered.join(small(bounds), same).filter(u <= bounds["_bound"]).select(*[ordered[c] for c in ordered.columns])
        return rows.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank", "_order")

    spark, path = df.sparkSession, scratch(df.sparkSession)
    first(sizes).write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    held = found.groupBy(*by).agg(F.count("*").alias("_held"))
    same = [sizes[c].eqNullSafe(held[c]) for c in by]
    short = sizes.join(held, same, "left").filter(F.coalesce("_held", F.lit(0)) < F.least(F.col("_size"), F.lit(n))).select(*[sizes[c] for c in by], F.lit(1.0).alias("_bound"))
    if short.isEmpty():
        return found
    again = [found[c].eqNullSafe(short[c]) for c in by]
    return found.join(small(short), again, "left_anti").unionByName(first(short))


def assistant_replies(conv: DataFrame, budget: int, max_turn: int = 4, languages: tuple[str, ...] | None = None) -> DataFrame:
    """Assistant turns among the first turns that aren't code, in hash order of the conversation, until budget paragraphs.

    conv: conv_id, turn, role, text (and lang, if languages are given). A reply counts its blank-line blocks; the one that passes the
    budget is the last taken.
    """
    rows = conv.filter((F.col("turn") < max_turn) & (F.col("role") == "assistant") & F.col("text").isNotNull() & ~T.looks_like_code(F.col("text")))
    if languages:
        rows = rows.filter(F.col("lang").isin(*languages))
    blocks = F.size(F.filter(F.split(T.unix_lines(F.col("text")), T.BLANK), lambda b: T.trim(b) != ""))
    return until_total(rows.withColumn("paragraphs", blocks), "paragraphs", budget, ["conv_id", "turn"])


def until_total(df: DataFrame, amount: str, budget: int, key: list[str], salt: str = "", buckets: int = 256) -> DataFrame:
    """Rows in hash order until their amounts reach budget, the row that reaches it included.

    Amounts are summed by hash bucket first; only the bucket where the budget is reached needs an order of its own rows.
    """
    ordered = df.withColumn("_order", hash_order(*key, salt=salt)).withColumn("_bucket", (F.conv(F.substring("_order", 1, 4), 16, 10).cast("int") * buckets / 65536).cast("int"))
    sums = ordered.groupBy("_bucket").agg(F.sum(amount).alias("_sum")).orderBy("_bucket").collect()  # at most buckets rows
    before, last = 0, -1
    for r in sums:
        last = r["_bucket"]
        if before + (r["_sum"] or 0) >= budget:
            break
        before += r["_sum"] or 0
    else:
        return ordered.drop("_order", "_bucket")
    run = F.sum(amount).over(W.orderBy("_order", *key).rowsBetween(W.unboundedPreceding, -1))
    edge = ordered.filter(F.col("_bucket") == last).withColumn("_run", F.coalesce(run, F.lit(0)) + before).filter(F.col("_run") < budget).drop("_run")
    return ordered.filter(F.col("_bucket") < last).unionByName(edge).drop("_order", "_bucket")


def latest_generation(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row with the largest seq for each key; of several, the one with the smallest hash of all columns."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(seq), F.xxhash64(*df.columns)))).filter("_rank = 1").drop("_rank")


def top_per_seed(df: DataFrame, n: int = 2) -> DataFrame:
    """The n first of each (group, source), by a hash of group and model, then by text."""
    order = hash_order("group", "model", salt="top")
    return df.withColumn("_rank", F.row_number().over(W.partitionBy("group", "source").orderBy(order, "text"))).filter(F.col("_rank") <= n).drop("_rank")


def family_cap(df: DataFrame, share: float = 0.2, key: str = "key") -> DataFrame:
    """Each lab (what stands before / in model) at most int(share x all rows), in hash order."""
    cap = int(share * df.count())
    return stratified_cap(df.withColumn("lab", F.split("model", "/")[0]), ["lab"], cap, key, "family").drop("lab")


def pair_words(text: Column) -> Column:
    """The words whose pairs are compared: runs of a-z, digits and straight apostrophes."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), 0)


def word_pairs(ws: Column) -> Column:
    n = F.size(ws)
    pairs = F.zip_with(F.slice(ws, 1, F.greatest(n - 1, F.lit(0))), F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.array_distinct(pairs)


def bigram_kept(original: Column, rewritten: Column) -> Column:
    """Share of the rewritten text's distinct word pairs that the original has too; 0 if it has none."""
    pairs = word_pairs(rewritten)
    return F.when(F.size(pairs) > 0, F.size(F.array_intersect(pairs, word_pairs(original))) / F.size(pairs)).otherwise(0.0)


def polish_label(original: Column, rewritten: Column) -> Column:
    kept = bigram_kept(original, rewritten)
    return F.when(kept >= 0.8, "human").when(kept < 0.2, "machine").otherwise("mixed")


def web_holdout(docs: DataFrame, per_shard: int, target: int) -> tuple[DataFrame, DataFrame]:
    """(held documents, their hosts): capped by shard, then in hash order until target paragraphs. docs: doc_id, shard, host, paragraphs."""
    held = until_total(stratified_cap(docs, ["shard"], per_shard, "doc_id", "web"), "paragraphs", target, ["doc_id"], "web")
    return held, held.select("host").distinct()


def unseen_hosts(pages: DataFrame, checked: DataFrame, host: str = "host") -> DataFrame:
    return pages.join(checked.select(host).distinct(), host, "left_anti")


def train_pages(docs: DataFrame, checked: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """The first n pages in hash order from hosts that aren't checked, with their rank; pages without paragraphs don't count."""
    rows = unseen_hosts(docs, checked).filter("paragraphs > 0").withColumn("_order", hash_order(key, salt="train"))
    top = rows.orderBy("_order", key).limit(n)
    return top.withColumn("rank", F.row_number().over(W.orderBy("_order", key))).drop("_order")


def gist(text: Column, n: int = 25) -> Column:
    return F.array_join(F.slice(T.space_words(text), 1, n), " ")


def make_seeds(df: DataFrame, per_source: int, key: str = "doc_id") -> DataFrame:
    """(domain, group, topic, human): up to per_source documents of each source, their text cut to one training paragraph."""
    chosen = stratified_cap(df, ["source"], per_source, key, "seed")
    cut = T.training_paragraphs(chosen.select("source", key, "text"), "text", ["source", key], limit=1)
    return cut.select(F.col("source").alias("domain"), F.col(key).cast("string").alias("group"), gist(F.col("text")).alias("topic"), F.col("text").alias("human"))


def eval_sample(df: DataFrame, quota: dict[str, int], key: str = "doc_id") -> DataFrame:
    """By label a quota of rows: equal heads for each source first, the rest topped up in hash order."""
    w = W.partitionBy("label", "source").orderBy("_order", key)
    per = df.filter(F.col("label").isin(*quota)).groupBy("label").agg(F.countDistinct("source").alias("_sources"))
    allowed = F.create_map(*[F.lit(x) for kv in sorted(quota.items()) for x in kv])[F.col("label")]
    most = stratified_cap(df.filter(F.col("label").isin(*quota)), ["label", "source"], max(quota.values(), default=0), key, "eval")  # so no window sees a large source
    ranked = most.withColumn("_order", hash_order(key, salt="eval")).withColumn("_head", F.row_number().over(w)).filter(F.col("_head") <= allowed)
    placed = ranked.join(per, "label").withColumn("_late", (F.col("_head") > F.floor(allowed / F.col("_sources"))).cast("int"))
    final = placed.withColumn("_rank", F.row_number().over(W.partitionBy("label").orderBy("_late", "_order", key))).filter(F.col("_rank") <= allowed)
    return final.drop("_order", "_head", "_sources", "_late", "_rank")


#: Slots of 20 by mode.
MODES = (("plain", 9), ("antitell", 2), ("humanize", 3), ("rewrite", 2), ("polish", 4))


def mode_of(slot: Column) -> Column:
    out, end = F.lit(MODES[-1][0]), sum(n for _, n in MODES)
    for name, n in reversed(MODES):
        end -= n
        out = F.when(slot < end + n, name).otherwise(out) if name != MODES[-1][0] else out
    return out


def plan_jobs(seeds: DataFrame, routes: list[str], count: int, offset: int = 0, salt: str = "") -> DataFrame:
    """(group, mode, route, key): the slice of seeds by SHA-1 of their group, with a mode and a route by its next bits."""
    h = F.sha1(F.concat(F.lit(salt), F.col("group")).cast("binary"))
    top = seeds.select("group").distinct().withColumn("_h", h).orderBy("_h", "group").limit(offset + count)
    placed = top.withColumn("_n", F.row_number().over(W.orderBy("_h", "group"))).filter(F.col("_n") > offset)
    bits = lambda i: F.conv(F.substring("_h", 1 + 8 * i, 8), 16, 10).cast("long")
    route = F.element_at(F.array(*map(F.lit, routes)), (bits(1) % len(routes) + 1).cast("int"))
    return placed.select("group", mode_of(bits(0) % 20).alias("mode"), route.alias("route")).withColumn("key", F.concat_ws(":", "group", "mode", "route"))


def pending_jobs(plan: DataFrame, done: DataFrame) -> DataFrame:
    return plan.join(done.select("key"), "key", "left_anti")


def holdout_flag(mode: Column, model: Column, held_out: tuple[str, ...]) -> tuple[Column, Column]:
    """(split or null, label): hard modes on held-out models are adv; polished text is mixed."""
    return F.when(mode.isin("antitell", "humanize") & model.isin(*held_out), "adv"), F.when(mode == "polish", "mixed").otherwise("machine")


def corpus_report(df: DataFrame, rows: str, cols: str, values: list[str]) -> DataFrame:
    return df.groupBy(rows).pivot(cols, values).count().fillna(0, values)


# -- joins


def splice(humans: DataFrame, machines: DataFrame, on: str, cap: int = 1200, min_words: int = 25) -> DataFrame:
    """First half of a human text's sentences and second half of one machine text's of the same source.

    humans and machines: on, text. One row of each is chosen per key before the join, so that no key multiplies.
    """

    def one(df: DataFrame, name: str) -> DataFrame:
        two = df.withColumn(name, T.sentence_texts(F.col("text"))).filter(F.size(name) >= 2)
        return two.groupBy(on).agg(F.min_by(name, F.struct(F.md5(F.col("text").cast("binary")), "text")).alias(name))

    both = one(humans, "_h").join(one(machines, "_m"), on)
    half = lambda c: F.floor(F.size(c) / 2).cast("int")
    text = F.array_join(F.concat(F.slice("_h", 1, half("_h")), F.slice("_m", half("_m") + 1, F.size("_m"))), " ")
    return both.select(on, text.alias("text")).filter(T.count_space_words(F.col("text")) >= min_words).orderBy(hash_order(on, salt="splice"), on).limit(cap)


def polish_originals(rewrites: DataFrame, seeds: DataFrame) -> DataFrame:
    """rewrites (group, text) with the original of their group from seeds (group, human), and the label that it gives."""
    joined = rewrites.join(seeds.select("group", F.col("human").alias("original")), "group", "left")
    return joined.withColumn("label", F.when(F.col("original").isNotNull(), polish_label(pair_words(F.col("original")), pair_words(F.col("text")))))


def text_key(text: Column) -> Column:
    return F.sha1(F.coalesce(text, F.lit("")).cast("binary"))


def distinct_texts(df: DataFrame, text: str = "text") -> DataFrame:
    """(key, text): each text once."""
    return df.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text")).groupBy("key").agg(F.first("text").alias("text"))


def score_back(df: DataFrame, scored: DataFrame, text: str = "text") -> DataFrame:
    """df with the columns of scored (key, ...): results of distinct texts brought back to every occurrence.

    Results of texts that occur very often go to where these are; others are shuffled.
    """
    return join_hot(df.withColumn("key", text_key(F.col(text))), scored, "key").drop("key")


def with_lm(base: DataFrame, lm: DataFrame, key: str) -> DataFrame:
    """base (key, vector) with lm (key, lm) appended to the vector; a row without one raises."""
    joined = base.join(lm.select(key, "lm"), key, "left")
    checked = F.when(F.col("lm").isNull(), F.raise_error(F.lit("a row without language-model features"))).otherwise(F.concat("vector", "lm"))
    return joined.withColumn("vector", checked).drop("lm")


def rule_names(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """hits with name and tier from the rule table, which has a few dozen rows."""
    if rules.limit(10_001).count() > 10_000:
        return hits.join(rules.select(F.col("id").alias("rule"), "name", "tier"), "rule")
    return hits.join(F.broadcast(rules.select(F.col("id").alias("rule"), "name", "tier")), "rule")


def featurize_incremental(df: DataFrame, store: DataFrame, compute, spec: int, text: str = "text") -> DataFrame:
    """(key, ..., spec) for every distinct text: rows of store (key, ..., spec) where it has them, compute(distinct texts) for the rest.

    A store of another spec is refused.
    """
    if not store.filter(F.col("spec") != spec).isEmpty():
        raise ValueError("the store holds features of another spec")
    wanted = distinct_texts(df, text)
    new = compute(wanted.join(store.select("key"), "key", "left_anti")).withColumn("spec", F.lit(spec))
    return store.join(wanted.select("key"), "key", "left_semi").unionByName(new.select(*store.columns))


def corpus_stamp(df: DataFrame, cols: tuple[str, ...] = ("text", "label", "split")) -> DataFrame:
    """(rows, first, second): the number of rows, and sums of two independent hashes of 60 bits of each row, modulo 2^60.

    A hash of the multiset of rows: their order and partitions don't matter, and any row added, removed, changed or repeated shows. Nulls
    differ from empty values, and a value's place among the columns counts. An empty table has three zeros.
    """
    value = lambda c: F.col(c).cast("string")
    row = F.concat(*[F.coalesce(F.concat(F.length(value(c)).cast("string"), F.lit(":"), value(c)), F.lit("-")) for c in cols])
    digest = F.md5(row.cast("binary"))
    part = lambda start: F.conv(F.substring(digest, start, 15), 16, 10).cast("decimal(28,0)")  # noqa: E731  sums of 10^20 rows fit
    total = lambda start: F.coalesce((F.sum(part(start)) % F.lit(1 << 60)).cast("long"), F.lit(0).cast("long"))
    return df.agg(F.count("*").alias("rows"), total(1).alias("first"), total(16).alias("second"))
