"""Phrase mining by direct-address tiling.

Words that occur often enough get ids by frequency in their language. A pair of neighbours is a cell of a grid of tiles with 1024 ids a
side, so that the most frequent pairs lie in few tiles. Tasks count a batch of pairs tile by tile: where many fall into a tile, by a
dense bincount over its cells, else as sorted coordinates with counts. Partial counts are dealt by a hash of the pair into groups of
bounded size and summed there. Frequent pairs are then ranked by frequency themselves, and a phrase of three words is a pair of such a
rank and a word's id, counted in the same way; both pairs in it must be frequent.

Every task holds the HEAD most frequent words and the PAIRS most frequent pairs. If there are more that are frequent, phrases which
need them are counted as strings, in a pass of their own: a bitmap of fixed size keeps out nearly all that can't be frequent, and
those that it lets through by chance are counted like others and then fall below the threshold.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, best, stored

#: Words and pairs that every task holds at most; bits of a side of a tile; codes from which a tile is counted densely.
HEAD, PAIRS, SIDE, DENSE = 1 << 19, 1 << 20, 10, 1 << 17
#: Words that a task gathers before it counts, words for each group of partial counts, distinct strings before they leave a task.
CHUNK, GROUP, STRINGS = 1 << 21, 1 << 21, 1 << 19
#: Bits of the bitmap of frequent strings, and of the pieces in which it is made; frequent strings whose counts are broadcast.
FILTER, FILTER_PART, LOOKUP = 1 << 27, 1 << 20, 1 << 16
#: A-Z are lower-cased; what ends a piece becomes a line break.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9)
PACKED = "lang string, size long, codes binary, counts binary"
COUNTS = "lang string, words array<string>, a long, l array<long>, r array<long>"


def pieces(text: str | None) -> list[list[bytes]]:
    """The words of each piece that has any."""
    parts = text.encode("utf-8", "surrogatepass").translate(TABLE).split(b"\n") if text else []
    return [ws for p in parts if (ws := p.split())]


def languages(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))


def drained(counts: dict[str, Counter[bytes]]) -> pd.DataFrame:
    rows = [(lang, w.decode("utf-8", "surrogatepass"), n) for lang, c in counts.items() for w, n in c.items()]
    counts.clear()
    return pd.DataFrame(rows, columns=["lang", "phrase", "n"]).astype({"lang": object, "phrase": object, "n": "int64"})


def word_counts(texts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, n) of words that occur least times; a null phrase has the number of all words."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter[bytes]] = {}
        totals: Counter[str] = Counter()
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                own = counts.setdefault(lang, Counter())
                for ws in pieces(text):
                    own.update(ws)
                    totals[lang] += len(ws)
                if sum(map(len, counts.values())) >= STRINGS:
                    yield drained(counts)
        yield drained(counts)
        yield pd.DataFrame([(lang, None, n) for lang, n in totals.items()], columns=["lang", "phrase", "n"]).astype({"lang": object, "phrase": object, "n": "int64"})

    return texts.mapInPandas(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter((F.col("n") >= least) | F.col("phrase").isNull())


class Pairs(NamedTuple):
    """Ranked pairs of a language: their codes in order with their ranks, and by rank their codes and counts."""

    codes: np.ndarray
    ranks: np.ndarray
    by_rank: np.ndarray
    counts: np.ndarray

    def find(self, codes: np.ndarray) -> np.ndarray:
        """The rank of each code, -1 if it has none."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return np.where(self.codes[at] == codes, self.ranks[at], -1)


class Head:
    """The ranked words of a language."""

    def __init__(self, words: list[bytes], counts: list[int]):
        self.words, self.counts = words, np.array(counts, np.int64)
        self.ids = dict(zip(words, range(len(words))))

    def encode(self, groups: list[list[bytes]]) -> np.ndarray:
        """Ids of all words, -1 for those without and after each piece."""
        get, out = self.ids.get, []
        for ws in groups:
            out += map(get, ws)
            out.append(None)
        return np.array([-1 if i is None else i for i in out], np.int64)


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left << 32 | right


def pair_codes(ids: np.ndarray) -> np.ndarray:
    """The code of each word with the next, -1 where either has no id."""
    return np.where((ids[:-1] >= 0) & (ids[1:] >= 0), joined(ids[:-1], ids[1:]), -1)


def tile_counts(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts): dense tiles by bincount, the cells of all others sorted."""
    codes = joined(left, right)
    tiles, place, sizes = np.unique(joined(left >> SIDE, right >> SIDE), return_inverse=True, return_counts=True)
    dense = np.flatnonzero(sizes >= DENSE)
    found = [np.unique(codes[(sizes < DENSE)[place]], return_counts=True)]
    low = (1 << SIDE) - 1
    for t in dense:
        mine = place == t
        counts = np.bincount((left[mine] & low) << SIDE | right[mine] & low, minlength=1 << 2 * SIDE)
        cells = np.flatnonzero(counts)
        tile = int(tiles[t])
        found.append((joined((tile >> 32 << SIDE) + (cells >> SIDE), ((tile & 0xFFFFFFFF) << SIDE) + (cells & low)), counts[cells]))
    return np.concatenate([c for c, _ in found]), np.concatenate([n for _, n in found])


def dealt(lang: str, codes: np.ndarray, counts: np.ndarray, groups: int) -> pd.DataFrame:
    """Partial counts as one row for each group, by a hash of the code."""
    x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    group = ((x ^ x >> np.uint64(29)) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    codes, counts, group = codes[order], counts[order], group[order]
    own, starts = np.unique(group, return_index=True)
    ends = np.append(starts, len(group))[1:]
    cut = lambda x: pd.Series([x[a:b].tobytes() for a, b in zip(starts, ends)], dtype=object)
    return pd.DataFrame({"lang": pd.Series([lang] * len(own), dtype=object), "part": own, "codes": cut(codes), "counts": cut(counts)})


def tiled(texts: DataFrame, heads: dict[str, Head], pairs: dict[str, Pairs] | None, groups: int, least: int) -> DataFrame:
    """PACKED codes and counts of frequent pairs of ranked words, or of frequent phrases of a ranked pair and a word if pairs are given."""
    shared = texts.sparkSession.sparkContext.broadcast((heads, pairs))

    def count(lang: str, ids: np.ndarray, own: dict[str, Pairs] | None) -> pd.DataFrame:
        code = pair_codes(ids)
        if own is None:
            at = np.flatnonzero(code >= 0)
            left, right = ids[at], ids[at + 1]
        else:
            rank = own[lang].find(code)
            at = np.flatnonzero((rank[:-1] >= 0) & (rank[1:] >= 0))
            left, right = rank[at], ids[at + 2]
        return dealt(lang, *tile_counts(left, right), groups)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_heads, own_pairs = shared.value
        held: dict[str, list[np.ndarray]] = {}
        size = 0
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                if lang not in own_heads or own_pairs is not None and lang not in own_pairs:
                    continue
                ids = own_heads[lang].encode(pieces(text))
                held.setdefault(lang, []).append(ids)
                size += len(ids)
                if size >= CHUNK:
                    size = 0
                    while held:
                        lang, parts = held.popitem()
                        yield count(lang, np.concatenate(parts), own_pairs)
        while held:
            lang, parts = held.popitem()
            yield count(lang, np.concatenate(parts), own_pairs)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate([np.frombuffer(x, np.int64) for x in rows["codes"]])
        counts = np.concatenate([np.frombuffer(x, np.int64) for x in rows["counts"]])
        order = np.argsort(codes, kind="stable")
        codes = codes[order]
        first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        total = np.add.reduceat(counts[order], first)
        return packed(key[0], codes[first][total >= least], total[total >= least])

    partial = texts.mapInPandas(run, "lang string, part long, codes binary, counts binary")
    return partial.groupBy("lang", "part").applyInPandas(add, PACKED).filter("size > 0")


def packed(lang: str, codes: np.ndarray, counts: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"lang": [lang], "size": [len(codes)], "codes": [codes.tobytes()], "counts": [counts.tobytes()]})


def unpacked(found: DataFrame, heads: dict[str, Head], pairs: dict[str, Pairs] | None) -> DataFrame:
    """COUNTS of what tiled() found."""
    shared = found.sparkSession.sparkContext.broadcast((heads, pairs))
    lists = lambda x: pd.Series(x, dtype=object)
    text = lambda head, ids: [w.decode("utf-8", "surrogatepass") for w in map(head.words.__getitem__, ids.tolist())]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_heads, own_pairs = shared.value
        for row in (r for b in batches for r in b.itertuples()):
            head, codes = own_heads[row.lang], np.frombuffer(row.codes, np.int64)
            left, right = codes >> 32, codes & 0xFFFFFFFF
            if own_pairs is None:
                words, before, after = zip(text(head, left), text(head, right)), [head.counts[left]], [head.counts[right]]
            else:
                ranked = own_pairs[row.lang]
                first, middle = ranked.by_rank[left] >> 32, ranked.by_rank[left] & 0xFFFFFFFF
                words = zip(text(head, first), text(head, middle), text(head, right))
                before, after = [head.counts[first], ranked.counts[left]], [ranked.counts[ranked.find(joined(middle, right))], head.counts[right]]
            yield pd.DataFrame({"lang": lists([row.lang] * len(codes)), "words": lists([list(w) for w in words]), "a": np.frombuffer(row.counts, np.int64), "l": lists(np.stack(before, 1).tolist()), "r": lists(np.stack(after, 1).tolist())})

    return found.mapInPandas(run, COUNTS)


# -- beyond what tasks hold


def string_key(lang: str, phrase: bytes) -> int:
    return xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass") + b"\t" + phrase, 42) % FILTER


def bitmap(strings: DataFrame) -> bytes | None:
    """A bit for the hash of each (lang, phrase); None without rows. Made in parts of fixed size."""
    size = FILTER_PART
    key = F.pmod(F.xxhash64(F.concat("lang", F.lit("\t"), "phrase")), F.lit(FILTER))

    def part(name: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, bool)
        bits[rows["bit"].to_numpy()] = True
        return pd.DataFrame({"part": [name[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    bits = strings.select(key.alias("key")).distinct().select((F.col("key") / size).cast("long").alias("part"), (F.col("key") % size).alias("bit"))
    found = bits.groupBy("part").applyInPandas(part, "part long, bits binary").collect()
    if not found:
        return None
    out = bytearray(FILTER // 8)
    for x in found:
        out[x["part"] * size // 8 : (x["part"] + 1) * size // 8] = x["bits"]
    return bytes(out)


def string_counts(texts: DataFrame, heads: dict[str, Head], pairs: dict[str, Pairs] | None, more_words: bytes | None, more_pairs: bytes | None, least: int) -> DataFrame:
    """(lang, phrase, n) of the frequent pairs, or phrases of three words if pairs are given, that tiled() doesn't count."""
    shared = texts.sparkSession.sparkContext.broadcast((heads, pairs, more_words, more_pairs))
    none = Pairs(*[np.empty(0, np.int64)] * 4)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_heads, own_pairs, words_in, pairs_in = shared.value
        counts: dict[str, Counter[bytes]] = {}
        holds = lambda bits, lang, x: bits is not None and bits[(k := string_key(lang, x)) >> 3] >> (k & 7) & 1
        for b in batches:
            for lang, text in zip(b["lang"], b["text"]):
                head = own_heads.get(lang) or Head([], [])
                for ws in pieces(text):
                    ids = head.encode([ws])[:-1]
                    maybe = ids >= 0
                    for i in np.flatnonzero(~maybe):
                        maybe[i] = holds(words_in, lang, ws[i])
                    if own_pairs is None:
                        for i in np.flatnonzero(maybe[:-1] & maybe[1:] & ((ids[:-1] < 0) | (ids[1:] < 0))):
                            counts.setdefault(lang, Counter())[b" ".join(ws[i : i + 2])] += 1
                        continue
                    ranked = own_pairs.get(lang, none).find(pair_codes(ids)) >= 0
                    both = ranked.copy()
                    for i in np.flatnonzero(~ranked & maybe[:-1] & maybe[1:]):
                        both[i] = holds(pairs_in, lang, b" ".join(ws[i : i + 2]))
                    for i in np.flatnonzero(both[:-1] & both[1:] & ~(ranked[:-1] & ranked[1:])):
                        counts.setdefault(lang, Counter())[b" ".join(ws[i : i + 3])] += 1
                if sum(map(len, counts.values())) >= STRINGS:
                    yield drained(counts)
        yield drained(counts)

    return texts.mapInPandas(run, "lang string, phrase string, n long").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def with_count(rows: DataFrame, phrase: Column, name: str, counts: DataFrame) -> DataFrame:
    """rows with the count of a phrase of theirs. The most frequent, which many rows may hold, are broadcast, others are shuffled."""
    top = counts.orderBy(F.desc("n"), "lang", "phrase").limit(LOOKUP)
    asked = rows.withColumn("phrase", phrase)
    some = asked.join(F.broadcast(top.withColumnRenamed("n", name)), ["lang", "phrase"], "left")
    rest = some.filter(F.col(name).isNull()).drop(name).join(counts.withColumnRenamed("n", name), ["lang", "phrase"])
    return some.filter(F.col(name).isNotNull()).unionByName(rest).drop("phrase")


def counted_cuts(found: DataFrame, counts: DataFrame) -> DataFrame:
    """COUNTS for frequent strings (lang, phrase, n), whose parts' counts are all in counts."""
    rows = found.select("lang", F.split("phrase", " ").alias("words"), F.col("n").alias("a"))
    if rows.isEmpty():
        return rows.select("lang", "words", "a", F.array().cast("array<long>").alias("l"), F.array().cast("array<long>").alias("r"))
    size = F.size("words")
    text = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    for name, phrase in {"l1": text(1, 1), "r1": text(2, 2), "l2": text(F.lit(1), size - 1), "r2": F.element_at("words", -1)}.items():
        rows = with_count(rows, phrase, name, counts)
    # a pair has one cut, which both looks give
    return rows.select("lang", "words", "a", *[F.when(size == 2, F.array(f"{x}1")).otherwise(F.array(f"{x}1", f"{x}2")).alias(x) for x in "lr"])


# -- the operator


def ranked_heads(words: DataFrame) -> tuple[dict[str, Head], bool]:
    """The HEAD most frequent words as each language's ranked ones, and whether there are more."""
    more = words.count() > HEAD
    top = (words.orderBy(F.desc("n"), "lang", "phrase").limit(HEAD) if more else words).toPandas()
    heads = {}
    for lang, rows in top.groupby("lang", sort=True):
        both = sorted(zip((-rows["n"]).tolist(), (w.encode("utf-8", "surrogatepass") for w in rows["phrase"])))
        heads[lang] = Head([w for _, w in both], [-n for n, _ in both])
    return heads, more


def frequent(found: DataFrame, most: int) -> tuple[DataFrame, bool]:
    """PACKED pairs of at most so many, the most frequent ones, and whether others were left out: all of one size class are in or out."""
    if (found.agg(F.sum("size")).first()[0] or 0) <= most:
        return found, False
    grade = lambda counts: (16 * np.log2(counts)).astype(np.int64)

    def grades(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            own, n = np.unique(grade(np.concatenate([np.frombuffer(x, np.int64) for x in b["counts"]])), return_counts=True)
            yield pd.DataFrame({"grade": own, "n": n})

    cut, total = 1 << 20, 0
    for x in found.mapInPandas(grades, "grade long, n long").groupBy("grade").agg(F.sum("n").alias("n")).orderBy(F.desc("grade")).collect():
        total += x["n"]
        if total > most:
            break
        cut = x["grade"]

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for row in (r for b in batches for r in b.itertuples()):
            codes, counts = np.frombuffer(row.codes, np.int64), np.frombuffer(row.counts, np.int64)
            large = grade(counts) >= cut
            yield packed(row.lang, codes[large], counts[large])

    return found.mapInPandas(keep, PACKED).filter("size > 0"), True


def ranked_pairs(found: DataFrame) -> tuple[dict[str, Pairs], bool]:
    """The PAIRS most frequent of PACKED pairs, ranked by language, and whether there are more."""
    top, more = frequent(found, PAIRS)
    parts: dict[str, list] = {}
    for x in top.select("lang", "codes", "counts").collect():
        parts.setdefault(x["lang"], []).append((np.frombuffer(x["codes"], np.int64), np.frombuffer(x["counts"], np.int64)))
    out = {}
    for lang, own in parts.items():
        codes, counts = (np.concatenate(x) for x in zip(*own))
        order = np.lexsort((codes, -counts))
        codes, counts = codes[order], counts[order]
        ranks = np.argsort(codes, kind="stable")
        out[lang] = Pairs(codes[ranks], ranks, codes, counts)
    return out, more


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lang, n) of all words; frequent pairs and phrases of three words as COUNTS."""
    texts = languages(docs)
    counted = stored(word_counts(texts, least))
    totals = counted.filter("phrase is null").select("lang", "n")
    size = totals.agg(F.sum("n")).first()[0] or 0
    groups = max(1, -(-size // GROUP))
    words = counted.filter("phrase is not null and n >= %d" % least)
    heads, more = ranked_heads(words)
    tiles = stored(tiled(texts, heads, None, groups, least))
    pairs = unpacked(tiles, heads, None)
    words_in = bitmap(words) if more else None
    ranks, unranked = ranked_pairs(tiles)
    if more:
        pairs = pairs.unionByName(counted_cuts(stored(string_counts(texts, heads, None, words_in, None, least)), words))
    triples = unpacked(stored(tiled(texts, heads, ranks, groups, least)), heads, ranks)
    if more or unranked:
        pairs = stored(pairs)
        both = pairs.select("lang", F.array_join("words", " ").alias("phrase"), F.col("a").alias("n"))
        found = stored(string_counts(texts, heads, ranks, words_in, bitmap(both), least))
        triples = triples.unionByName(counted_cuts(found, words.unionByName(both)))
    return totals, pairs, triples


def mine(docs: DataFrame, least: int = 10, inside: int = 50, k: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's k first phrases of two and three words by score.

    docs: (lang, text, and any others), read whole. A phrase occurs a >= least times; its cut into parts of l and r occurrences is the one
    of the lowest floor(1000000 a a / (l r)), the first of several. A pair isn't reported if a reported or unreported phrase of three words
    holds it at least inside per cent as often. Equal scores go by a, then by the phrase's bytes. Null and empty texts have no words, a
    null language is und, repeated rows count as often as they come, an empty table gives an empty result.
    """
    totals, pairs, triples = phrase_counts(docs, least)
    parts = triples.select("lang", "a", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("words"))
    longer = parts.groupBy("lang", "words").agg(F.max("a").alias("longer"))
    alone = pairs.join(longer, ["lang", "words"], "left").filter(f"longer is null or 100 * longer < {int(inside)} * a").drop("longer")
    exact = "cast(cast(1000000 as decimal(7,0)) * (cast(a as decimal(18,0)) * cast(a as decimal(18,0))) div (cast(l[i] as decimal(18,0)) * cast(r[i] as decimal(18,0))) as long)"
    cuts = F.expr(f"array_min(transform(sequence(0, size(l) - 1), i -> struct({exact} as score, i as k, l[i] as l, r[i] as r)))")
    scored = alone.unionByName(triples).select("lang", F.array_join("words", " ").alias("phrase"), "a", cuts.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    top = best(scored, ["lang"], [F.desc("score"), F.desc("a"), F.col("phrase")], k)
    return top.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


SQL = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents
), ws AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces
), ones AS (
  SELECT lang, x AS phrase, CAST(count(*) AS BIGINT) AS f FROM (SELECT lang, unnest(w) AS x FROM ws) GROUP BY ALL
), twos AS (
  SELECT lang, x AS phrase, CAST(count(*) AS BIGINT) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM ws) GROUP BY ALL
), threes AS (
  SELECT lang, x AS phrase, CAST(count(*) AS BIGINT) AS f FROM (SELECT lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS x FROM ws) GROUP BY ALL
), candidates AS (
  SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM twos WHERE f >= 10 UNION ALL SELECT lang, phrase, string_split(phrase, ' ') AS w, f AS a FROM threes WHERE f >= 10
), counts AS (
  SELECT * FROM ones UNION ALL SELECT * FROM twos
), cuts AS (
  SELECT lang, phrase, w, a, unnest(range(1, len(w))) AS k FROM candidates
), scores AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (CAST(1000000 AS HUGEINT) * c.a * c.a) // (CAST(x.f AS HUGEINT) * y.f), k) AS nth
  FROM cuts c JOIN counts x ON c.lang = x.lang AND x.phrase = array_to_string(c.w[1:k], ' ') JOIN counts y ON c.lang = y.lang AND y.phrase = array_to_string(c.w[k + 1:], ' ')
), longer AS (
  SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE len(w) = 3) GROUP BY ALL
), kept AS (
  SELECT s.* FROM scores s LEFT JOIN longer o ON s.lang = o.lang AND s.phrase = o.phrase WHERE nth = 1 AND (o.a IS NULL OR 100 * o.a < 50 * s.a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, CAST(rank AS INTEGER) AS rank, phrase, a, l, r, n, score
FROM ranked JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM ones GROUP BY lang) USING (lang) WHERE rank <= 2000
"""
