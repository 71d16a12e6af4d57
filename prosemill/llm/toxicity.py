"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the toxic and one on the ordinary labelled texts. A text is cut into windows of
several words; each window is compressed with both dictionaries, and it resembles toxic text where that dictionary makes it shorter
by some threshold. The threshold is calibrated on the training rows, and a logistic model turns the share of such windows
in the text into a score.

Lengths of letters would mostly tell syllables that words happen to share, so a word goes in as 24 bytes of a hash: zstandard then
finds whole words and sequences of them, and what neither dictionary holds costs the same under both. That many bytes let knowing a
word outweigh the few bytes that a sequence saves which only one dictionary happens to hold. A dictionary is trained as
zstandard's own trainer does it, by segments of the text that cover most of what counts (that trainer counts strings by frequency
alone, which in toxic text too are those of ordinary words). For the toxic dictionary, words count by how far chance would not put
so many of their documents among the toxic ones, if holding the word makes a text toxic rather than not. For the ordinary one, the words that most documents hold count, and before them all
words that come along in the toxic dictionary's segments. Of either dictionary's segments only words that both hold stay, and the
telling words of the toxic one, so that knowing any other word speaks for neither side.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, crc_mod, crc_mod_col

#: Most labelled documents of each class that are learnt from, in the order of a hash of their ids.
TOXIC_ROWS, ORDINARY_ROWS = 6000, 18000
#: Words of a window, and of a dictionary's segment; bytes that stand for a word.
WINDOW, CODE = 8, 24
#: zstandard's window: what a dictionary can hold. Most common words that the ordinary dictionary covers.
WINDOW_LOG, COMMON = 20, 1000
#: One training in so many takes a word for telling by chance.
ODDS = 20
#: Stand around a window, and at the end of both dictionaries: zstandard starts no match in a block's last bytes and stores small blocks raw.
FRAME = (xxhash.xxh3_128_digest(b"\x01"), xxhash.xxh3_128_digest(b"\x02"))
#: A-Z to lower case, other ASCII but letters to spaces; bytes of other scripts stay.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Distinct words whose codes a task remembers before it starts anew.
CACHE = 1 << 20
#: Windows that meet one dictionary before they meet the other.
TOGETHER = 4096
#: The largest saving that is told apart, in bytes.
MOST = 80


def letter_words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(LETTERS).split() if text else []


def signature(words: list[bytes]) -> int:
    """The smallest hash of the pieces between words whose hash is divisible by 4: mostly equal for near copies."""
    best, piece = 2**63 - 1, []
    for w in words:
        piece.append(w)
        if xxhash.xxh32_intdigest(w) % 4 == 0 or len(piece) >= 16:
            best, piece = min(best, xxhash.xxh64_intdigest(b" ".join(piece)) >> 1), []
    return min(best, xxhash.xxh64_intdigest(b" ".join(piece)) >> 1) if piece else best


def code(word: bytes) -> bytes:
    return xxhash.xxh3_128_digest(word) + xxhash.xxh3_64_digest(word, 1)


def compressor(segments: tuple[bytes, ...]) -> zstandard.ZstdCompressor:
    """Of a dictionary of these segments, texts of words; the last are nearest and so cheapest."""
    content = b"".join(code(w) for s in segments for w in s.split())[-(1 << WINDOW_LOG) + 4096 :] + b"".join(FRAME)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    p = zstandard.ZstdCompressionParameters(
        window_log=WINDOW_LOG, hash_log=WINDOW_LOG, chain_log=WINDOW_LOG, search_log=1, min_match=6, strategy=zstandard.STRATEGY_DFAST,
        write_content_size=False, write_dict_id=False, write_checksum=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
    )
    d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(dict_data=d, compression_params=p)


@dataclass
class Model:
    """The dictionaries' segments and the logistic model; bounded by what zstandard's window holds, so it is sent with each task."""

    ordinary: tuple[bytes, ...]
    toxic: tuple[bytes, ...]
    threshold: int = MOST
    weights: tuple[float, ...] = (0.0, 0.0)


class Scorer:
    def __init__(self, model: Model):
        self.model, self.codes = model, {}
        self.plain, self.knowing = compressor(model.ordinary), compressor(model.toxic)

    def windows(self, ws: list[bytes]) -> list[bytes]:
        codes = self.codes
        if len(codes) + len(ws) > CACHE:
            codes.clear()
        for w in set(ws).difference(codes):
            codes[w] = code(w)
        found, (before, after) = [codes[w] for w in ws], FRAME
        return [b"".join([before, *found[i : i + WINDOW], after]) for i in range(0, len(found), WINDOW)]

    def savings(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], int]]:
        """For each text, by how many bytes each window is shorter with the toxic dictionary than with the ordinary one, and its words.

        Many windows meet one dictionary and then the other: their tables would push each other out of the processor's cache.
        """
        held, sizes = [], []
        for t in texts:
            ws = letter_words(t)
            held += self.windows(ws)
            sizes.append(len(ws))
            if len(held) >= TOGETHER:
                yield from self.compressed(held, sizes)
                held, sizes = [], []
        yield from self.compressed(held, sizes)

    def compressed(self, windows: list[bytes], sizes: list[int]) -> Iterator[tuple[list[int], int]]:
        plain, knowing, at = self.plain.compress, self.knowing.compress, 0
        long = [len(plain(w)) for w in windows]
        saved = [n - len(knowing(w)) for n, w in zip(long, windows)]
        for n in sizes:
            until = at - (-n // WINDOW)
            yield saved[at:until], n
            at = until

    def profiles(self, texts: Iterable[str | None]) -> Iterator[tuple[list[int], int]]:
        """How many windows save at least 1, 2, ... MOST bytes, and the number of words."""
        for saved, n in self.savings(texts):
            counts = np.bincount(np.clip(saved, 0, MOST).astype(int), minlength=MOST + 1)
            yield counts[::-1].cumsum()[::-1][1:].tolist(), n

    def scores(self, texts: Iterable[str | None]) -> Iterator[float]:
        m = self.model
        for saved, n in self.savings(texts):
            z = float(np.dot(m.weights, features(sum(s >= m.threshold for s in saved), n)))
            yield 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(hits: np.ndarray | int, n: np.ndarray | int) -> np.ndarray:
    """Of the number of telling windows and of words: the share by its logarithm, so that one window in a very long text says little."""
    return np.stack(np.broadcast_arrays(1.0, np.log2(1 + 1000 * np.asarray(hits) / np.maximum(n, 1)) / 8), axis=-1).astype(float)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> DataFrame:
    """(doc_id, text, toxic): the bounded sample of the labelled training rows, those whose crc32(doc_id) mod 5 is not 0."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.filter(crc_mod_col(F.col("doc_id"), 5) != 0)
    ids = known.filter("toxic > 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic_rows).unionByName(known.filter("toxic <= 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ordinary_rows))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # at most toxic_rows + ordinary_rows ids
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "text", (F.col("toxic") > 0).cast("int").alias("toxic"))


def windows(ws: list[bytes]) -> Iterator[list[bytes]]:
    for i in range(0, max(1, len(ws) - WINDOW // 2), WINDOW // 2):
        yield ws[i : i + WINDOW]


def segments(rows: DataFrame, toxic: int, worth: dict[bytes, float], rest: float) -> list[bytes]:
    """For each word of worth, the window of a text of this class that holds it and is worth most, without repeats, the best last.

    Windows overlap by half. Words that worth doesn't name count for rest. A task keeps one window for each word.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[bytes, tuple[float, bytes]] = {}
        for b in batches:
            for y, t in zip(b["toxic"], b["text"]):
                if y == toxic:
                    for window in windows(letter_words(t)):
                        own = set(window)
                        named = own.intersection(worth)
                        if named:
                            found = (sum(map(worth.__getitem__, sorted(named))) + rest * (len(own) - len(named)), b" ".join(window))
                            for w in named:
                                if w not in best or best[w] < found:
                                    best[w] = found
        yield pd.DataFrame({"word": list(best), "worth": [x for x, _ in best.values()], "segment": [s for _, s in best.values()]})

    found = rows.mapInPandas(run, "word binary, worth double, segment binary").groupBy("word").agg(F.max(F.struct("worth", "segment")).alias("best")).collect()  # one for each word asked for
    return [s for _, s in sorted({(r["best"]["worth"], bytes(r["best"]["segment"])) for r in found})]


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, ordinary_rows: int = ORDINARY_ROWS) -> Model | float:
    """The model; a constant score if only one class has training rows (0.0 without any)."""
    rows = training_rows(docs, labels, toxic_rows, ordinary_rows)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [letter_words(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "toxic": b["toxic"], "sig": [signature(w) for w in ws], "words": [[x.decode("utf-8", "ignore") for x in set(w)] for w in ws]})

    # of near copies one counts, or their rare words would look like toxic text's own
    one = rows.mapInPandas(split, "doc_id long, toxic int, sig long, words array<string>").groupBy("toxic", "sig").agg(F.min_by("words", "doc_id").alias("words"))
    sizes = {r["toxic"]: r["n"] for r in one.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return 1.0 if n1 else 0.0
    counts = checkpointed(one.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").cast("double").alias("t"), F.sum(1 - F.col("toxic")).cast("double").alias("o")))
    # Chernoff's bound on so many toxic documents among those that hold a word, if it were as frequent in either kind of text; with
    # as many words tried, there is one chance in ODDS that any passes
    n, p = F.col("t") + F.col("o"), n1 / (n1 + n0)
    unlikely = F.col("t") * F.log(F.col("t") / n / p) + F.when(F.col("o") > 0, F.col("o") * F.log(F.col("o") / n / (1 - p))).otherwise(0.0)
    tried = counts.filter("t > 0").count()
    known = labels.filter("doc_id is not null and toxic is not null").filter(crc_mod_col(F.col("doc_id").cast("long"), 5) != 0)
    share = known.agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p")).first()["p"]
    # many documents make even slight differences of common words unlikely, so a word must also outweigh the share of toxic labels
    weighs = F.col("t") / n1 * share >= F.col("o") / n0 * (1 - share)
    room = (1 << WINDOW_LOG) // (WINDOW * CODE)
    telling = counts.filter((F.col("t") / n > p) & (F.col("t") > 0) & weighs).withColumn("z", unlikely).filter(F.col("z") > math.log(ODDS * max(tried, 1))).orderBy(F.desc("z"), "word").limit(room).collect()
    own = {r["word"].encode(): r["z"] for r in telling}
    common = {w: math.log2(2 + r["o"]) for r in counts.orderBy(F.desc("o"), "word").limit(COMMON).collect() if (w := r["word"].encode()) not in own}
    toxic = segments(rows, 1, common | own, -2.0)
    wanted = {w: 1.0 for s in toxic for w in s.split() if w not in own} | common
    # telling words stand in the toxic dictionary alone, all others in both or neither: one word never hides another in its window
    ordinary = segments(rows, 0, wanted, -2.0)
    both = {w for s in ordinary for w in s.split()} & {w for s in toxic for w in s.split()} - set(own)
    kept = lambda found, words: tuple(s for x in found if (s := b" ".join(w for w in x.split() if w in words)))
    model = Model(kept(ordinary, both), kept(toxic, both | set(own)))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scorer(model)
        for b in batches:
            yield pd.DataFrame([(y, *found) for y, found in zip(b["toxic"], s.profiles(b["text"]))], columns=["toxic", "hits", "n"])

    sample = rows.mapInPandas(measure, "toxic int, hits array<int>, n long").toPandas()  # a bounded number of rows of a few small numbers
    y, hits = sample["toxic"].to_numpy(float), np.stack(sample["hits"].to_numpy())
    gain = [(hits[y > 0, k] > 0).mean() - (hits[y == 0, k] > 0).mean() for k in range(MOST)]
    best = [k for k, g in enumerate(gain) if g >= max(gain) - 1e-6]
    model.threshold = 1 + (best[0] + best[-1]) // 2
    weight = np.where(y > 0, share / max(y.mean(), 1e-9), (1 - share) / max(1 - y.mean(), 1e-9))  # as frequent as in all training labels
    model.weights = tuple(fit_logistic(features(hits[:, model.threshold - 1], sample["n"].to_numpy()), y, weight))
    return model


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs (doc_id, text, and any others), learnt from labels (doc_id, toxic).

    held_out tells that crc32(doc_id as text) mod 5 is 0 (null ids: of the empty text), so that no label of the row was used. Null and
    empty texts get the score of a text without savings. Labels that are null or of unknown documents don't count; the largest of
    several for a document does. Without training rows of both classes the score is constant.
    """
    model = train(docs, labels)
    return scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), model).select("doc_id", "held_out", "score", "predicted")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, whose predicted class isn't toxic."""
    return scored(docs, train(docs, labels)).filter("predicted = 0").select(*docs.columns)


def scored(docs: DataFrame, model: Model | float) -> DataFrame:
    """docs with held_out, score and predicted; columns of docs with these names are replaced."""
    docs = docs.drop("held_out", "score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model) if isinstance(model, Model) else None
        for b in batches:
            score = list(s.scores(b.column("text").to_pylist())) if s else [model] * b.num_rows
            held = [crc_mod(i, 5) == 0 for i in b.column("doc_id").to_pylist()]
            more = [pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(x >= 0.5) for x in score], pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "held_out", "score", "predicted"])

    return docs.mapInArrow(run, schema)
