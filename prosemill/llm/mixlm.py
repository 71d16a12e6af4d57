"""Language-model scores by online logistic context mixing.

A text is its lower-cased words and an end mark. Each of these tokens is a path of binary decisions in a tree: first to the group of
the token, then, by Huffman's rule, to the token itself. Groups are words of documents that share a most frequent word, which tells
languages and kinds of text apart; the end and "a rare word" are groups of their own. For each decision of a path,
hashed contexts (the word before, the two words before, the last frequent word, the last two very frequent ones) look up how often it
went either way in the training texts. Their logits and the tree's own are mixed by weights that a gate selects, by depth and by
which contexts know anything. Weights are learnt online, decision block by decision block: first on a slice of the training rows that
the tables don't count, then anew within each document, which starts from what the slice taught. An adaptive table, which learns
within the document too, maps the mixture to its probability. A rare word is told by its exact count, mixed with its spelling (module spelling). All decisions' probabilities multiply to a proper distribution.

Passes over the texts, each a Spark job: words; context counts; two short ones for weights; scores. What is learnt grows with the
corpus: counts of all words and the spellings' probabilities are Spark tables, joined by shuffling; the tables of contexts take their
size from the number of training tokens, up to a size that each task can hold. No result depends on how rows are partitioned.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import spelling
from .common import crc_mod, stored, words  # noqa: F401: what split() does for one text
from .spelling import SCALE, huffman, logit_table, squash

#: Rows with crc32(doc_id) mod HELD of 0 are never learnt from; of the others, one in TUNE is left to the weights.
HELD, TUNE = 10, 16
#: Most words that have paths of their own, their most bytes; groups; depths that weights tell apart, the last one for all deeper ones.
VOCABULARY, LONGEST, GROUPS, DEPTH = 1 << 17, 64, 15, 16
#: Most decisions to a group, of a path (enough for VOCABULARY words), and those that tell which kind of word it is.
HEAD, MOST, KIND = 5, 22, 7
#: Words that the second context tells apart, and what counts as frequent and very frequent for the third and fourth.
KNOWN2, KNOWN3, KNOWN4 = 2048, 4096, 256
#: Most bits of each context's table; they have 2^bits slots, about as many as training tokens up to this.
MOST_BITS = (22, 22, 20, 20)
#: Slots of a block in which counts travel; bytes of texts that go together; tokens of a document that do, and of its past that they know.
BLOCK, CHUNK, PART, HISTORY = 1 << 16, 1 << 22, 1 << 17, 64
#: Tokens whose decisions are mixed at once, so that they stay within the cache; tokens looked up in one table after the other.
CACHED, LOOKED = 1 << 12, 1 << 17
#: Inputs of the mixer: the contexts' logits, the tree's own, a constant. Gates: depth, whether contexts 1 and 3 know anything.
INPUTS, GATES = len(MOST_BITS) + 2, DEPTH * 4
#: Cells of the adaptive table for each depth; what it weighs at a document's start.
SSE, TRUST = 33, 48.0
#: A document's own weights move as if so many decisions spoke for the first ones.
STIFF = 4000.0
#: Tokens of the texts of one lane in which weights are learnt.
LANE = 1_000_000
#: Stands for the end in tables of words, none of which holds a space.
END = " "


# -- tree


@dataclass
class Lexicon:
    """Symbols: words in order of frequency, then a rare word (len(ids)), then the end (len(ids) + 1).

    steps: flat node * 2 + outcome of all decisions, node 2^depth + the path so far; first place and number of them by symbol; kind: the
    path so far after the first KIND ones; tail: log10 of what isn't mixed, 0 throughout; own: logits of the nodes; base: log10 of the
    base probability of words and end. leaf, a path with a leading 1, and weight are what the tree is laid out from: pickled, a lexicon is
    these, a tenth of the whole.
    """

    ids: dict[bytes, int]
    steps: np.ndarray
    first: np.ndarray
    length: np.ndarray
    kind: np.ndarray
    tail: np.ndarray
    own: np.ndarray
    base: np.ndarray
    endless: bool
    leaf: np.ndarray
    weight: np.ndarray

    def __reduce__(self):
        return laid_out, (list(self.ids), self.leaf.astype(np.int32), self.length.astype(np.int8), self.weight, self.base, self.endless)

    @property
    def rare(self) -> int:
        return len(self.ids)

    @functools.cached_property
    def known(self) -> pa.Array:
        return pa.array([w.decode() for w in self.ids], pa.string())


def lexicon(known: list[tuple[str, int, int]], ends: int, rest: int, divisor: float) -> Lexicon:
    """From (word, count, group) of the frequent words, the numbers of ends and of rare words in training, and the base score's divisor."""
    known = sorted(known, key=lambda r: (-r[1], r[0]))
    weight = np.array([n for _, n, _ in known] + [max(rest, 1), max(ends, 1)], np.float64)
    sizes: Counter = Counter()
    for _, n, g in known:
        sizes[g] += n
    largest = [g for g, _ in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:GROUPS]]
    members: dict[int, list[int]] = {g: [] for g in [*largest, -1]}
    for i, (_, _, g) in enumerate(known):
        members[g if g in members else -1].append(i)
    groups = [m for m in members.values() if m] + [[len(known)], [len(known) + 1]]
    paths: list[list[int]] = [[]] * len(weight)
    for head, group in zip(limited([weight[m].sum() for m in groups], HEAD), groups):
        for i, path in zip(group, limited(weight[group].tolist(), MOST - len(head))):
            paths[i] = head + path
    base = np.log10((np.array([n for _, n, _ in known] + [0, ends]) + 0.1) / divisor)
    leaf = np.array([int("1" + "".join(map(str, p)), 2) for p in paths], np.int64)
    return laid_out([w.encode() for w, _, _ in known], leaf, np.array([len(p) for p in paths], np.int64), weight, base, not ends)


def laid_out(ws: list[bytes], leaf: np.ndarray, length: np.ndarray, weight: np.ndarray, base: np.ndarray, endless: bool) -> Lexicon:
    """The lexicon of words, with the paths and weights of all symbols."""
    length, leaf = length.astype(np.int64), leaf.astype(np.int32)
    first = np.cumsum(length) - length
    steps, deepest = np.zeros(length.sum(), np.int32), int(length.max())
    node_weight, ones = np.zeros(1 << deepest), np.zeros(1 << deepest)
    for depth in range(deepest):
        some = np.flatnonzero(length > depth)
        step = leaf[some] >> length[some] - depth - 1
        steps[first[some] + depth] = step
        np.add.at(node_weight, step >> 1, weight[some])
        np.add.at(ones, step >> 1, (step & 1) * weight[some])
    kind = leaf >> np.maximum(length - KIND, 0)
    own = np.log((ones + 0.4) / (node_weight - ones + 0.4)).astype(np.float32)
    return Lexicon({w: i for i, w in enumerate(ws)}, steps, first, length, kind, np.zeros(len(weight)), own, base, endless, leaf, weight)


def limited(weights: list[float], most: int) -> list[list[int]]:
    """Huffman's paths, of at most so many bits: small weights are raised until that holds."""
    paths, least = huffman(weights), sum(weights) / (1 << most)
    while max(map(len, paths)) > most:
        paths = huffman([max(w, least) for w in weights])
        least *= 2
    return paths


def tokens(ws: list[bytes], lex: Lexicon) -> np.ndarray:
    """Symbols of a text's words and its end."""
    return np.array([*map(lex.ids.get, ws, repeat(lex.rare)), lex.rare + 1], np.int64)


def shares(b: pa.RecordBatch, size: int = CHUNK) -> Iterator[tuple[list[int | None], pa.Array]]:
    """(ids, texts) of a batch's rows, size bytes at a time; longer texts by themselves."""
    ids, texts, at, held = b.column("doc_id").to_pylist(), b.column("text"), 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > at and (held + n > size or i - at == 1 << 16):
            yield ids[at:i], texts.slice(at, i - at)
            at, held = i, 0
        held += n
    if ids:
        yield ids[at:], texts.slice(at)


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as words() has them, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    n, ws = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), lists.flatten()
    some = pc.binary_length(ws).to_numpy(zero_copy_only=False) > 0
    if not some.all():
        ws, n = ws.filter(pa.array(some)), np.bincount(np.repeat(np.arange(len(n)), n)[some], minlength=len(n))
    return ws, n.astype(np.int64)


def symbols(ws: pa.Array, n: np.ndarray, lex: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts of n words each, with their ends, one after the other, and each one's text."""
    owner, t = np.repeat(np.arange(len(n)), n + 1), np.full(len(ws) + len(n), lex.rare + 1)
    word = np.ones(len(t), bool)
    word[np.cumsum(n + 1) - 1] = False
    t[word] = pc.fill_null(pc.index_in(ws, value_set=lex.known.cast(ws.type)), lex.rare).to_numpy(zero_copy_only=False)
    return t, owner


# -- contexts


def contexts(t: np.ndarray, h: int, lex: Lexicon) -> list[np.ndarray]:
    """Hashes of each context of the symbols t[h:]; t[:h] (2 or more, the first an end) is what stood before. Texts don't see others."""
    end, here = lex.rare + 1, np.arange(len(t))
    ends = t == end
    one = t[h - 1 : -1]
    coarse = np.where(t < min(KNOWN2, lex.rare), t, KNOWN2 + lex.kind.take(t))
    third = np.maximum.accumulate(np.where((t < min(KNOWN3, lex.rare)) | ends, here, 0))
    fourth = np.maximum.accumulate(np.where((t < min(KNOWN4, lex.rare)) | ends, here, 0))
    before = np.where(t.take(fourth) == end, fourth, fourth.take(np.maximum(fourth - 1, 0)))
    pairs = [(one, one), (coarse[h - 1 : -1], coarse[np.where(one == end, here[h - 1 : -1], here[h - 2 : -2])]), (t.take(third)[h - 1 : -1],) * 2, (t.take(fourth)[h - 1 : -1], t.take(before)[h - 1 : -1])]
    return [hashed(a, b, k) for k, (a, b) in enumerate(pairs)]


def hashed(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    x = a.astype(np.uint32) * np.uint32(0x9E3779B1) + b.astype(np.uint32) * np.uint32(0x85EBCA77) + np.uint32(k * 0x27D4EB2F)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    return x ^ x >> np.uint32(13)


@dataclass
class Decisions:
    """Mixed decisions of symbols, by depth: the first ones of all, then the second ones of those that have two, and so on.

    order: symbols from the longest path to the shortest, of which so many reach each depth; node and outcome.
    """

    order: np.ndarray
    many: list[int]
    node: np.ndarray
    bit: np.ndarray


def decisions(t: np.ndarray, hashes: list[np.ndarray], lex: Lexicon, bits: list[int]) -> Decisions:
    n = lex.length.take(t).astype(np.int8)
    order = np.argsort(-n, kind="stable")
    n = n.take(order).astype(np.int32)
    many = np.cumsum(np.bincount(n)[::-1])[::-1][1:].tolist()
    step = by_depth(lex.leaf.take(t.take(order)), many)
    step >>= np.concatenate([n[:k] - (depth + 1) for depth, k in enumerate(many)])
    return Decisions(order, many, step >> 1, (step & 1).astype(np.int8))


def slots(d: Decisions, hashes: list[np.ndarray], bits: list[int]) -> Iterator[np.ndarray]:
    """Each context's table slots of the decisions, one context after the other, so that they stay within the cache."""
    for x, b in zip(hashes, bits):
        x = by_depth(x.take(d.order).astype(np.uint32), d.many)
        x += d.node.view(np.uint32) * np.uint32(0x9E3779B1)
        x *= np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - b)
        yield x.astype(np.intp)


def by_depth(x: np.ndarray, many: list[int]) -> np.ndarray:
    """What symbols, from the longest path to the shortest, have, for each of their decisions."""
    return np.concatenate([x[:k] for k in many])


def parts(t: np.ndarray, lex: Lexicon) -> Iterator[tuple[np.ndarray, int]]:
    """(symbols, how many of them stood before) of a text, PART at a time."""
    for at in range(0, len(t), PART):
        yield np.concatenate(([lex.rare + 1] * 2, t[max(0, at - HISTORY) : at + PART])), 2 + min(at, HISTORY)


# -- mixing


@dataclass
class Model:
    """weights [INPUTS, GATES], their mean curvature, and outcomes of the adaptive table [DEPTH * SSE, 2] (ones, all)."""

    lex: Lexicon
    tables: list[np.ndarray]
    bits: list[int]
    weights: np.ndarray
    curve: np.ndarray
    sse: np.ndarray

    @staticmethod
    def new(lex: Lexicon, tables: list[np.ndarray], bits: list[int]) -> Model:
        weights = np.zeros((INPUTS, GATES), np.float32)
        weights[:-1] = 0.3
        return Model(lex, tables, bits, weights, np.ones((INPUTS, GATES), np.float32), np.zeros((DEPTH * SSE, 2)))

    def refinement(self) -> np.ndarray:
        """The adaptive table at a document's start: (ones, all) of weight TRUST; unseen cells keep the mixture's own probability."""
        own = np.tile(squash(np.linspace(-8, 8, SSE)), DEPTH)
        return np.stack([(self.sse[:, 0] + own * 24) / (self.sse[:, 1] + 24) * TRUST, np.full(len(own), TRUST)]).astype(np.float32)


@dataclass
class State:
    """What rows of texts have learnt: weights [INPUTS, rows * GATES] and the adaptive table [2, rows * cells]; how far weights move."""

    weights: np.ndarray
    sse: np.ndarray
    step: np.ndarray

    @staticmethod
    def new(m: Model, rows: int) -> State:
        return State(np.tile(m.weights, rows), np.tile(m.refinement(), rows), np.tile(1 / (m.curve * STIFF), rows) if m.curve.all() else m.curve)

    def some(self, first: int, until: int) -> State:
        """A view of these rows."""
        gates, cells = slice(first * GATES, until * GATES), slice(first * DEPTH * SSE, until * DEPTH * SSE)
        return State(self.weights[:, gates], self.sse[:, cells], self.step[:, gates])


@dataclass
class Piece:
    """Symbols that are mixed at once: their contexts' hashes, the rows of the state from first to until, each symbol's row of these, and
    whether they are these rows' last ones."""

    t: np.ndarray
    hashes: list[np.ndarray]
    first: int
    until: int
    row: np.ndarray
    last: bool


def looked_up(m: Model, pieces: Iterator[Piece]) -> Iterator[tuple[Piece, Decisions, list[np.ndarray]]]:
    """Pieces with decisions and their contexts' logits in 16ths. Tables are read one after the other, for several pieces each, since
    one alone may stay within the cache."""
    some, held = [], 0
    for piece in chain(pieces, [None]):
        if some and (piece is None or held + len(piece.t) > LOOKED):
            found = [decisions(p.t, p.hashes, m.lex, m.bits) for p in some]
            at, raw = [slots(d, p.hashes, m.bits) for p, d in zip(some, found)], [[] for _ in some]
            for table in m.tables:
                for x, r in zip(at, raw):
                    r.append(table.take(next(x), mode="clip"))  # faster; slots are within their tables
            yield from zip(some, found, raw)
            some, held = [], 0
        if piece is not None:
            some.append(piece)
            held += len(piece.t)


def mixed(m: Model, s: State, d: Decisions, raw: list[np.ndarray], row: np.ndarray) -> tuple:
    """(inputs, their weights' places, the adaptive table's, mixture's probability) of decisions of symbols, each with its row of the state."""
    gate = row.take(d.order) * GATES
    gate = np.concatenate([gate[:k] + 4 * min(depth, DEPTH - 1) for depth, k in enumerate(d.many)])
    cell = (gate >> 2) * SSE
    gate += (raw[0] != 0).view(np.uint8) * np.uint8(2) + (raw[2] != 0).view(np.uint8)
    inputs = [r.astype(np.float32) * np.float32(1 / SCALE) for r in raw] + [m.lex.own.take(d.node)]
    z = s.weights[-1].take(gate)
    for w, x in zip(s.weights, inputs):
        z += w.take(gate) * x
    np.clip(z, -12, 12, out=z)
    cell += np.rint(np.clip(z, -8, 8) * np.float32((SSE - 1) / 16) + np.float32((SSE - 1) / 2)).astype(np.intp)
    return inputs, gate, cell, squash(z)


def advance(m: Model, s: State, piece: Piece, d: Decisions, raw: list[np.ndarray]) -> np.ndarray:
    """log10 probability of the piece's symbols for each of its rows, which then learn from them unless these are their last ones."""
    s = s.some(piece.first, piece.until)
    inputs, gate, cell, p = mixed(m, s, d, raw, piece.row)
    bit = d.bit.astype(np.float32)
    q = (p + (s.sse[0] / s.sse[1]).take(cell)) * np.float32(0.5)
    q = np.maximum(np.abs(np.float32(1) - bit - q), np.float32(1e-9))  # of what came
    chance, at = np.ones(len(piece.t)), 0
    for k in d.many:
        chance[:k] *= q[at : at + k]
        at += k
    out = np.bincount(piece.row.take(d.order), np.log10(chance), piece.until - piece.first)
    if piece.last:
        return out
    error, gains = bit - p, np.zeros(s.weights.shape, np.float32)
    for k, gain in enumerate(gains):
        np.add.at(gain, gate, error * inputs[k] if k < len(inputs) else error)
    s.weights += gains * s.step
    np.add.at(s.sse[0], cell, bit)
    np.add.at(s.sse[1], cell, np.float32(1))
    return out


def rounds(length: int) -> list[int]:
    """Where a text's blocks end: short ones first, since there is most to learn, 1024 tokens at last."""
    ends, at, size = [], 0, 32
    while at < length:
        at += size
        ends.append(min(at, length))
        size = min(1024, at)
    return ends


def score(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probability of each text, given as symbols, but for the spelling of its rare words.

    Texts learn side by side, each for itself: a round takes the next block of every text that has one.
    """
    out = np.zeros(len(texts))
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    together, held = [], 0
    for i in [*order, None]:
        if together and (i is None or held + len(texts[i]) > PART):
            out[together] = side_by_side(m, [texts[j] for j in together])
            together, held = [], 0
        if i is not None:
            together.append(i)
            held += len(texts[i])
    return out


def side_by_side(m: Model, texts: list[np.ndarray]) -> np.ndarray:
    """Of texts from the longest to the shortest; a text of more than PART symbols comes alone."""
    s, out = State.new(m, len(texts)), np.zeros(len(texts))
    for piece, d, raw in looked_up(m, alone(m, texts[0]) if len(texts) == 1 else pieces_of(m, texts)):
        out[piece.first : piece.until] += advance(m, s, piece, d, raw)
    return out


def alone(m: Model, text: np.ndarray) -> Iterator[Piece]:
    done = 0
    for t, h in parts(text, m.lex):
        hashes, ends = contexts(t, h, m.lex), rounds(len(t) - h) if not done else range(1024, len(t) - h + 1024, 1024)
        at = 0
        for end in ends:
            end = min(end, len(t) - h)
            yield Piece(t[h + at : h + end], [x[at:end] for x in hashes], 0, 1, np.zeros(end - at, np.intp), done + end == len(text))
            at = end
        done += at


def pieces_of(m: Model, texts: list[np.ndarray]) -> Iterator[Piece]:
    lengths = np.array([len(t) for t in texts])
    start = np.cumsum(lengths) - lengths
    t = np.concatenate([[m.lex.rare + 1] * 2, *texts])
    hashes, t = contexts(t, 2, m.lex), t[2:]
    at = 0
    for end in rounds(int(lengths[0])):
        rows = int(np.count_nonzero(lengths > at))
        size = np.minimum(lengths[:rows], end) - at
        cuts = np.flatnonzero(np.diff(np.cumsum(size) // CACHED, prepend=-1)).tolist()
        for first, until in zip(cuts, [*cuts[1:], rows]):
            own = size[first:until]
            row = np.repeat(np.arange(until - first), own)
            place = (start[first:until] + at - np.cumsum(own) + own).take(row) + np.arange(len(row))
            yield Piece(t.take(place), [x.take(place) for x in hashes], first, until, row, bool(lengths[first] <= end))
        at = end


def learn(m: Model, texts: list[np.ndarray], rate: float) -> tuple[Model, np.ndarray]:
    """The model after an online pass over the texts, one after the other, and the number of decisions by gate.

    curve and sse are sums over these decisions, on top of what m has.
    """
    s, curve, sse, seen = State.new(m, 1), m.curve.copy(), m.sse.copy(), np.zeros(GATES)
    for text in texts:
        for t, h in parts(text, m.lex):
            hashes = contexts(t, h, m.lex)
            steps = (slice(at, min(at + 512, len(t) - h)) for at in range(0, len(t) - h, 512))
            pieces = (Piece(t[h:][part], [x[part] for x in hashes], 0, 1, np.zeros(part.stop - part.start, np.intp), False) for part in steps)
            for piece, d, raw in looked_up(m, pieces):
                inputs, gate, cell, p = mixed(m, s, d, raw, piece.row)
                bit = d.bit.astype(np.float32)
                error, spread = bit - p, p * (1 - p)
                for k in range(INPUTS):
                    x = inputs[k] if k < len(inputs) else np.float32(1)
                    steep = np.bincount(gate, spread * x * x, GATES)
                    s.weights[k] += (rate * np.bincount(gate, error * x, GATES) / (steep + 4)).astype(np.float32)
                    curve[k] += steep
                sse[:, 0] += np.bincount(cell, bit, len(sse))
                sse[:, 1] += np.bincount(cell, minlength=len(sse))
                seen += np.bincount(gate, minlength=GATES)
    return Model(m.lex, m.tables, m.bits, s.weights.copy(), curve, sse), seen


# -- passes


@dataclass
class Sent:
    """A model on its way to tasks: its large parts are broadcast once, the small ones, which learn, go with each job."""

    kind: type
    large: Broadcast
    small: dict

    @property
    def value(self) -> Model | spelling.Speller:
        return self.kind(**self.large.value, **self.small)

    def learnt(self, **small: np.ndarray) -> Sent:
        return replace(self, small=self.small | small)


def learnt_by(doc_id) -> str:
    """What a row's id makes of it: held, tune or train."""
    if crc_mod(doc_id, HELD) == 0:
        return "held"
    return "tune" if crc_mod(f"{'' if doc_id is None else doc_id}#", TUNE) == 0 else "train"


def _ids(b: pd.DataFrame) -> list[int | None]:
    return [None if pd.isna(i) else int(i) for i in b["doc_id"]]


def first_of_runs(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))


def kinds_of(ws: pa.Array, n: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(word, kind of text, count) of the words of texts of n words each; a text's kind is its most frequent word's, the first one of several."""
    coded = ws.dictionary_encode()
    code = coded.indices.to_numpy().astype(np.int64)
    bits = len(code).bit_length()  # words of a share, and one long text's, take at most 30
    low = (1 << bits) - 1
    key = np.repeat(np.arange(len(n)), n) << 2 * bits | code << bits | np.arange(len(code))
    key.sort()
    first = first_of_runs(key >> bits)
    count, key = np.diff(first, append=len(key)), key[first]
    texts = first_of_runs(key >> 2 * bits)
    top = code[low - (np.maximum.reduceat(count << bits | low - (key & low), texts) & low)]
    words_, number = np.unique(top, return_inverse=True)
    kind = np.array([zlib.crc32(w.encode()) & 0xFF for w in coded.dictionary.take(pa.array(words_)).to_pylist()])[number]
    # of all texts: words with their kinds and counts
    pair = (key >> bits & low) << 8 | np.repeat(kind, np.diff(texts, append=len(key)))
    pair = pair << bits | count
    pair.sort()
    first = first_of_runs(pair >> bits)
    total, pair = np.add.reduceat(pair & low, first), pair[first] >> bits
    return coded.dictionary.take(pa.array(pair >> 8)), pair & 0xFF, total


def corpus_words(docs: DataFrame) -> DataFrame:
    """(word, n, kind) of the training rows: each word's count, the end's under END, and the most frequent word, by checksum, of the
    documents in which it is most frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = 0
        for b in batches:
            for ids, texts in shares(b, 2 * CHUNK):
                learnt = [crc_mod(i, HELD) > 0 for i in ids]
                ends += sum(learnt)
                ws, n = split(texts.filter(pa.array(learnt, pa.bool_())))
                if len(ws):
                    yield rows(*kinds_of(ws, n))
        yield rows(pa.array([END]), np.array([-1]), np.array([ends]))

    def rows(ws: pa.Array, kinds: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([ws.cast(pa.string()), pa.array(kinds, pa.int32()), pa.array(n, pa.int64())], ["word", "kind", "n"])

    each = docs.mapInArrow(run, "word string, kind int, n long").groupBy("word", "kind").agg(F.sum("n").alias("n"))
    return each.groupBy("word").agg(F.sum("n").alias("n"), (F.max(F.col("n") * 512 + F.col("kind") + 1) % 512 - 1).cast("int").alias("kind"))


def frequent_words(counts: DataFrame) -> list[tuple[str, int, int]]:
    """(word, n, kind) of the most frequent words: of those with a count from some power of 2^(1/8) on, at most VOCABULARY."""
    level = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    some = counts.filter((F.col("n") > 1) & (F.col("word") != END) & (F.octet_length("word") <= LONGEST))
    total, least = 0, None
    for r in sorted(some.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):  # 8 rows for each power of 2
        total += r["words"]
        if total > VOCABULARY:
            break
        least = r["level"]
    return [] if least is None else [tuple(r) for r in some.filter(level >= least).select("word", "n", "kind").collect()]


def packed(counts: np.ndarray) -> bytes:
    return zstandard.compress(b"".join((counts >> np.uint32(8 * k)).astype(np.uint8).tobytes() for k in range(4)), 1)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return sum(plane.astype(np.uint32) << np.uint32(8 * k) for k, plane in enumerate(planes))


def summed_tables(rows: DataFrame, count, bits: list[int]) -> list[np.ndarray]:
    """Logit tables from count(batches, tables), which adds to tables [slots * 2] what the task's rows hold.

    A task sends its counts in blocks; blocks are summed one after the other, so neither holds more than its tables.
    """
    sizes = [max(1 << b, BLOCK) for b in bits]
    firsts = np.cumsum([0, *[n // BLOCK for n in sizes]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * n, np.uint32) for n in sizes]
        count(batches, tables)
        for first, table in zip(firsts, tables):
            blocks = table.reshape(-1, 2 * BLOCK)
            some = [k for k, p in enumerate(blocks) if p.any()]
            yield pa.RecordBatch.from_arrays([pa.array([int(first) + k for k in some], pa.int32()), pa.array([packed(blocks[k]) for k in some], pa.binary())], ["block", "counts"])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, total = None, np.zeros(2 * BLOCK, np.uint64)

        def row() -> pd.DataFrame:
            return pd.DataFrame({"block": [block], "logits": [logit_table(total.reshape(-1, 2)).tobytes()]})

        for b in batches:  # sorted by block
            for k, data in zip(b["block"], b["counts"]):
                if k != block:
                    if block is not None:
                        yield row()
                    block, total = int(k), np.zeros(2 * BLOCK, np.uint64)
                total += unpacked(data)
        if block is not None:
            yield row()

    summed = rows.mapInArrow(run, "block int, counts binary").repartition("block").sortWithinPartitions("block").mapInPandas(add, "block int, logits binary")
    tables = [np.zeros(n, np.int8) for n in sizes]
    for r in summed.collect():  # at most 4 MB for each context
        which = int(np.searchsorted(firsts, r["block"], "right")) - 1
        at = (r["block"] - firsts[which]) * BLOCK
        tables[which][at : at + BLOCK] = np.frombuffer(r["logits"], np.int8)
    return tables


def context_tables(docs: DataFrame, lex: Lexicon, bits: list[int]) -> list[np.ndarray]:
    shared = docs.sparkSession.sparkContext.broadcast(lex)

    def count(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> None:
        lex = shared.value
        for b in batches:
            for ids, texts in shares(b):
                ws, n = split(texts.filter(pa.array([learnt_by(i) == "train" for i in ids], pa.bool_())))
                for t, h in grouped(np.split(symbols(ws, n, lex)[0], np.cumsum(n + 1)), lex):
                    count_part(t, h, lex, bits, tables)

    tables = summed_tables(docs, count, bits)
    shared.destroy()
    return tables


def grouped(texts: list[np.ndarray], lex: Lexicon) -> Iterator[tuple[np.ndarray, int]]:
    """(symbols, how many of them stood before): short texts joined, long ones in parts."""
    pending, held = [], 0
    for t in texts:
        if len(t) > PART:
            yield from parts(t, lex)
            continue
        pending.append(t)
        held += len(t)
        if held > PART:
            yield np.concatenate(([lex.rare + 1] * 2, *pending)), 2
            pending, held = [], 0
    if held:
        yield np.concatenate(([lex.rare + 1] * 2, *pending)), 2


def count_part(t: np.ndarray, h: int, lex: Lexicon, bits: list[int], tables: list[np.ndarray]) -> None:
    """Adds the outcomes of the symbols t[h:] to tables [slots * 2], one table after the other, since together they exceed the cache."""
    hashes, keys = contexts(t, h, lex), [[] for _ in tables]
    for at in range(h, len(t), CACHED):
        part = [x[at - h : at - h + CACHED] for x in hashes]
        d = decisions(t[at : at + CACHED], part, lex, bits)
        for key, x in zip(keys, slots(d, part, bits)):
            key.append((x * 2 + d.bit).astype(np.uint32))
    for key, table in zip(keys, tables):
        spelling.add(table, key)


def in_lanes(rows: DataFrame, lanes: int, *columns: str) -> DataFrame:
    """The rows with their lane, dealt by it and in an order of their own, so that nothing depends on partitions."""
    h = F.xxhash64(*columns)
    return rows.withColumn("lane", F.pmod(h, F.lit(lanes)).cast("int")).withColumn("h", h).repartition("lane").sortWithinPartitions("lane", "h", *columns)


def averaged(rows: DataFrame, run) -> tuple[np.ndarray, float] | None:
    """The sums over lanes of the vectors, and of the numbers of decisions, that run(lane's batches) returns; rows are sorted by lane."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, learner = None, None
        for b in batches:
            for k, part in b.groupby("lane", sort=False):
                if k != lane:
                    if learner:
                        yield frame(learner)
                    lane, learner = k, run()
                learner(part)
        if learner:
            yield frame(learner)

    def frame(learner) -> pd.DataFrame:
        x, seen = learner(None)
        return pd.DataFrame({"k": np.arange(len(x)), "x": x, "n": float(seen)})

    got = rows.mapInPandas(each, "k int, x double, n double").groupBy("k").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).orderBy("k").collect()  # a fixed number of rows
    return (np.array([r["x"] for r in got]), got[0]["n"]) if got and got[0]["n"] else None


def tuned(docs: DataFrame, model: Model, train_tokens: int) -> Sent:
    """The model with weights learnt on the tuning slice: online within each lane, then averaged by numbers of decisions; twice."""
    large = docs.sparkSession.sparkContext.broadcast({"lex": model.lex, "tables": model.tables, "bits": model.bits})
    sent = Sent(Model, large, {"weights": model.weights, "curve": model.curve, "sse": model.sse})
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slice_ = docs.filter(((F.crc32(F.concat(name, F.lit("#")).cast("binary")) % TUNE) == 0) & ((F.crc32(name.cast("binary")) % HELD) != 0))
    lanes = stored(in_lanes(slice_, max(1, train_tokens // (TUNE * LANE)), "doc_id", "text"))
    for rate in (0.1, 0.03):
        sent = sent.learnt(curve=np.zeros((INPUTS, GATES), np.float64), sse=np.zeros((DEPTH * SSE, 2)))

        def run(rate=rate, sent=sent):
            state, seen = sent.value, np.zeros(GATES)

            def learner(part: pd.DataFrame | None):
                nonlocal state, seen
                if part is None:
                    return np.concatenate((state.weights.ravel() * float(seen.sum()), state.curve.ravel(), state.sse.ravel(), seen)), seen.sum()
                ws, length = split(pa.array(part["text"], pa.string()))
                state, n = learn(state, np.split(symbols(ws, length, state.lex)[0], np.cumsum(length + 1)[:-1]), rate)
                seen = seen + n

            return learner

        got = averaged(lanes.sortWithinPartitions("lane", "h", "doc_id", "text"), run)
        if not got:
            return sent.learnt(curve=np.ones((INPUTS, GATES), np.float32))
        x, n = got
        # sums of doubles come in any order: rounding makes them equal again
        w, curve, sse, seen = np.split(x, np.cumsum([INPUTS * GATES, INPUTS * GATES, DEPTH * SSE * 2]))
        sent = sent.learnt(
            weights=np.round(w / n, 6).reshape(INPUTS, GATES).astype(np.float32), sse=np.round(sse, 3).reshape(-1, 2),
            curve=np.round(curve.reshape(INPUTS, GATES) / np.maximum(seen, 1) + 0.02, 6).astype(np.float32),
        )
    return sent


def speller(rare: DataFrame, types: int) -> Sent:
    """Learnt from the spellings of rare words, each once: 15/16 of them fill the tables, the others teach the weights."""
    sc = rare.sparkSession.sparkContext
    held = F.crc32(F.col("word").cast("binary")) % TUNE == 0

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(65536, np.int64)
        for b in batches:
            if len(b):
                total += spelling.pair_counts(np.frombuffer(b"\xff".join(w.encode() for w in b["word"]) + b"\xff", np.uint8))
        yield pd.DataFrame({"k": np.flatnonzero(total), "n": total[total > 0]})

    total = np.zeros(65536, np.int64)
    for r in rare.mapInPandas(pairs, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():  # at most 65536 rows
        total[r["k"]] = r["n"]
    shared = sc.broadcast(spelling.code_of(total.reshape(256, 256)))

    def count(batches: Iterator[pa.RecordBatch], tables: list[np.ndarray]) -> None:
        for b in batches:
            spelling.count([w.encode() for w in b.column("word").to_pylist()], shared.value, tables)

    model = spelling.Speller.new(shared.value, summed_tables(rare.filter(~held), count, list(spelling.TABLE_BITS)))
    shared.destroy()
    sent = Sent(spelling.Speller, sc.broadcast({"code": model.code, "tables": model.tables}), {"weights": model.weights, "sse": model.sse})
    lanes = stored(in_lanes(rare.filter(held).select("word"), max(1, types // (TUNE * LANE)), "word"))
    for rate in (0.1, 0.03):
        sent = sent.learnt(sse=np.zeros_like(model.sse))

        def run(rate=rate, sent=sent):
            state, seen = sent.value, 0

            def learner(part: pd.DataFrame | None):
                nonlocal state, seen
                if part is None:
                    return np.concatenate((state.weights.ravel() * float(seen), state.sse.ravel())), seen
                state, n = spelling.learn(state, [w.encode() for w in part["word"]], rate)
                seen += n

            return learner

        got = averaged(lanes.sortWithinPartitions("lane", "h", "word"), run)
        if not got:
            return sent
        w, sse = np.split(got[0], [model.weights.size])
        sent = sent.learnt(weights=np.round(w / got[1], 6).reshape(model.weights.shape).astype(np.float32), sse=np.round(sse, 3).reshape(model.sse.shape))
    return sent


def score_texts(docs: DataFrame, model: Sent) -> DataFrame:
    """Of each row: its number, id, lengths, the model's log10 probability but for rare words, the base score's, and the rare words' hashes.

    Only rows that weren't learnt from can hold words that were never seen; theirs come along.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        number = TaskContext.get().partitionId() << 33
        base = m.lex.base.copy()
        base[m.lex.rare] = 0.0
        for b in batches:
            for ids, texts in shares(b):
                rows = len(ids)
                ws, n = split(texts)
                t, owner = symbols(ws, n, m.lex)
                held = np.array([crc_mod(i, HELD) == 0 for i in ids])
                n_bytes = np.bincount(np.repeat(np.arange(rows), n), pc.binary_length(ws).to_numpy(zero_copy_only=False), rows).astype(np.int64) + n + 1
                rare = np.flatnonzero(t == m.lex.rare)
                n_rare = np.bincount(owner[rare], minlength=rows)
                distinct, lists = listed(ws.take(pa.array(rare - owner[rare])), owner[rare], rows)
                hashes = np.array([word_hash(w) for w in distinct.cast(pa.binary()).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(number + np.arange(rows)), pa.array(ids, pa.int64()), pa.array(held), pa.array(n + 1), pa.array(n_bytes),
                        pa.array(n + 1 - n_rare - m.lex.endless), pa.array(np.bincount(owner, base.take(t), rows)), pa.array(n_rare),
                        lists(lambda code, times: pa.array(hashes[code])), lists(lambda code, times: pa.array(times, pa.int32())),
                        lists(lambda code, times: distinct.take(pa.array(code)), held), pa.array(score(m, np.split(t, np.cumsum(n + 1)[:-1]))),
                    ],
                    ["row", "doc_id", "held_out", "n_tokens", "n_bytes", "known", "base", "n_rare", "rare", "times", "words", "score"],
                )
                number += rows

    return docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_bytes long, known long, base double, n_rare long, rare array<long>, times array<int>, words array<string>, score double")


def listed(ws: pa.Array, owner: np.ndarray, rows: int) -> tuple[pa.Array, Callable[..., pa.Array]]:
    """The distinct words, and what makes lists for each row from its words' numbers and counts, null where it is not wanted."""
    coded = ws.cast(pa.string()).dictionary_encode()
    key, times = np.unique(owner << 32 | coded.indices.to_numpy(), return_counts=True)
    of, code = key >> 32, key & 0xFFFFFFFF

    def lists(values: Callable[[np.ndarray, np.ndarray], pa.Array], wanted: np.ndarray | None = None) -> pa.Array:
        some = slice(None) if wanted is None else wanted[of]
        ends = np.cumsum(np.bincount(of[some], minlength=rows))
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), values(code[some], times[some]), mask=None if wanted is None else pa.array(~wanted))

    return coded.dictionary, lists


def word_hash(word: bytes) -> int:
    """As Spark's xxhash64. Words with equal hashes would be counted together; among n words that takes about n^2 / 4e19 chances."""
    return (xxhash.xxh64_intdigest(word, 42) + (1 << 63)) % (1 << 64) - (1 << 63)


def with_spelling(rows: DataFrame, model: Sent, word: str = "word") -> DataFrame:
    """rows and spell, the log10 probability of the word's spelling."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for b in batches:
            number, distinct = pd.factorize(b[word])
            yield b.assign(spell=spelling.log_probabilities(m, [w.encode() for w in distinct])[number])

    return rows.mapInPandas(run, f"{rows.schema.simpleString()[7:-1]},spell double")


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for each row of docs (doc_id, text, and any others).

    Rows with crc32(doc_id as text) mod 10 of 0 (null ids: of the empty text) are scored without being learnt from. Null and empty
    texts are the end mark alone. Repeated rows are scored alike. Without training rows a rare word and the end are as likely.
    base_score is the sum of log10((c + 0.1) / (N + 0.1 (V + 1))) over the tokens; score the model's log10 probability of them. An
    empty table gives an empty result; other columns of docs, whatever their names, don't count.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stored(corpus_words(docs).filter("n > 0"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v"), F.coalesce(F.sum(F.when(F.col("word") == END, F.col("n"))), F.lit(0)).alias("ends")).first()
    divisor = total["n"] + 0.1 * (total["v"] + 1)
    known = frequent_words(counts)
    least = min((n for _, n, _ in known), default=None)
    unusual = F.lit(True) if least is None else (F.col("n") < least) | (F.octet_length("word") > LONGEST)
    rare = counts.filter((F.col("word") != END) & unusual).select("word", "n")
    rest = rare.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("types"), F.coalesce(F.sum(F.when(F.col("n") == 1, 1)), F.lit(0)).alias("once")).first()
    # of rare words in a new text so many were seen before, by Good's and Turing's rule
    seen = min(0.95, max(0.05, 1 - rest["once"] / rest["n"])) if rest["n"] else 0.0
    spell = speller(rare, rest["types"])
    log = F.log10(F.lit(seen) * F.col("n") / F.lit(float(max(rest["n"], 1))) + F.lit(1 - seen) * F.pow(F.lit(10.0), "spell"))
    spelt = stored(with_spelling(rare, spell).select(F.xxhash64("word").alias("key"), "n", log.alias("log")))
    lex = lexicon(known, total["ends"], rest["n"], divisor)
    bits = [min(b, max(12, math.ceil(math.log2(total["n"] + 1)))) for b in MOST_BITS]
    model = tuned(docs, Model.new(lex, context_tables(docs, lex, bits), bits), total["n"])
    scored = stored(score_texts(docs, model))
    times = F.col("x.times").alias("times")
    each = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), times)
    old = each.join(spelt, "key").groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.col("n") + 0.1) / F.lit(divisor))).alias("rest"), F.sum("times").alias("others"), F.sum(F.col("times") * F.col("log")).alias("spelt")
    )
    held = scored.filter("held_out").select("row", F.explode(F.arrays_zip("rare", "times", "words")).alias("x")).select("row", F.col("x.rare").alias("key"), times, F.col("x.words").alias("word"))
    unseen = with_spelling(held.join(spelt, "key", "left_anti").select("row", "times", "word"), spell)
    new = unseen.groupBy("row").agg(F.sum(F.col("times") * (F.col("spell") + F.lit(math.log10(1 - seen)))).alias("new"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    full = scored.join(old, "row", "left").join(new, "row", "left").withColumn("score", F.col("score") + zero("spelt") + zero("new"))
    full = full.withColumn("rest", zero("rest") + (F.col("n_rare") - zero("others")) * F.lit(math.log10(0.1 / divisor)))
    return full.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + zero("others")).cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("rest")).alias("base_score"), "score", (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
