"""Probabilities of spellings, by context mixing over bytes.

A word is its bytes and an end mark. Each byte is a path of binary decisions in a Huffman tree that its predecessor selects, which
takes about 3 decisions a byte where 8 bits would take 8. For each decision, hashed contexts (the last 3 and 5 bytes, the word so
far) look up how often it went either way in the words that were learnt from. Their logits are mixed by weights that a gate selects,
by depth and by which contexts know anything; the weights are learnt online. An adaptive table maps the mixture to its probability.
The decisions' probabilities multiply to a proper distribution over words.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bits of each context's table: the last 3 and 5 bytes, the word so far.
TABLE_BITS = (20, 22, 22)
#: Bytes that are turned into decisions at once, bytes of a long word's last part that the next one knows.
CHUNK, HISTORY = 1 << 14, 64
#: Logits are kept in 16ths; what an unseen outcome counts.
SCALE, PRIOR = 16.0, 0.4
END = 255
GATES, SSE = 32, 33
#: Odd multipliers, by rule.
_PRIMES = (np.arange(1, 17, dtype=np.uint64) ** 5 * 2654435761 % (1 << 32) | 1).astype(np.uint32)
#: Logits of the tables' bytes.
LOGITS = (np.arange(256, dtype=np.uint8).view(np.int8) / SCALE).astype(np.float32)


# -- codes


def huffman(weights: list[float]) -> list[list[int]]:
    """The path of bits of each symbol; ties by number. A single symbol has an empty path."""
    heap = [(float(w), i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    above: dict[int, tuple[int, int]] = {}
    inner = len(weights)
    while len(heap) > 1:
        w0, _, a = heapq.heappop(heap)
        w1, _, b = heapq.heappop(heap)
        above[a], above[b] = (inner, 1), (inner, 0)
        heapq.heappush(heap, (w0 + w1, inner, inner))
        inner += 1
    paths = []
    for x in range(len(weights)):
        path = []
        while x in above:
            x, bit = above[x]
            path.append(bit)
        paths.append(path[::-1])
    return paths


@dataclass
class Code:
    """The decisions of each byte after each byte: flat (node * 2 + outcome) with 8 x depth (to 3), first place and number by previous * 256 + byte."""

    steps: np.ndarray
    gates: np.ndarray
    first: np.ndarray
    length: np.ndarray


def code_of(pairs: np.ndarray) -> Code:
    """Trees from counts [256, 256] of byte after byte; every byte has a path in every tree."""
    alone = pairs.sum(axis=0, dtype=np.float64)
    alone = (alone + 0.01) / (alone.sum() + 2.56)
    steps, gates, first, length = [], [], np.empty(65536, np.int32), np.empty(65536, np.int32)
    for previous in range(256):
        numbers: dict[tuple[int, ...], int] = {}
        for byte, path in enumerate(huffman((pairs[previous] + alone).tolist())):
            first[previous * 256 + byte], length[previous * 256 + byte] = len(steps), len(path)
            for depth, bit in enumerate(path):
                node = numbers.setdefault(tuple(path[:depth]), len(numbers))
                steps.append((previous * 256 + node) * 2 + bit)
                gates.append(8 * min(depth, 3))
    return Code(np.array(steps, np.int32), np.array(gates, np.uint8), first, length)


def pair_counts(data: np.ndarray) -> np.ndarray:
    """Counts [65536] of previous * 256 + byte; before a word's first byte stands an end mark."""
    before = np.concatenate(([END], data[:-1])).astype(np.int64)
    return np.bincount(before * 256 + data, minlength=65536)


@dataclass
class Decisions:
    """Flat decisions of joined words: node * 2 + outcome, position of the byte, gate by depth; the first decision of each byte."""

    step: np.ndarray
    place: np.ndarray
    gate: np.ndarray
    begin: np.ndarray
    contexts: list[np.ndarray]


def decisions(data: np.ndarray, history: np.ndarray, code: Code) -> Decisions:
    """data: bytes of words that end in END; history: what stood before (an end mark before a word)."""
    h = len(history)
    joined = np.concatenate((history, data))
    back = [joined[h - k : len(joined) - k].astype(np.uint32) for k in range(1, 6)]
    alive = np.ones(len(data), bool)
    for x in back:  # what stands before an end mark doesn't count
        x[~alive] = END
        alive &= x != END
    pair = back[0].astype(np.int32) * 256 + data
    n = code.length.take(pair)
    begin = np.cumsum(n, dtype=np.int64) - n
    place = np.repeat(np.arange(len(data)), n)
    at = (code.first.take(pair) - begin).take(place) + np.arange(len(place))
    three = back[0] * _PRIMES[0] + back[1] * _PRIMES[1] + back[2] * _PRIMES[2]
    five = three * np.uint32(5) + back[3] * _PRIMES[3] + back[4] * _PRIMES[4]
    # the word so far: sums of its bytes by place, from where it began
    place_in = np.arange(len(joined), dtype=np.int32)
    gap = joined == END
    start = np.maximum.accumulate(np.where(gap, place_in + 1, 0))
    terms = (joined + np.uint32(77)) * _PRIMES.take(np.minimum(place_in - start + gap, 15))
    terms[gap] = 0
    total = np.cumsum(terms, dtype=np.uint32)
    before = np.concatenate((np.zeros(1, np.uint32), total[:-1]))
    word = before[h:] - before.take(start[h - 1 : -1])
    return Decisions(code.steps.take(at), place, code.gates.take(at), begin, [three, five, word])


def slots(d: Decisions) -> Iterator[np.ndarray]:
    """Table slot of each decision in each context."""
    node = (d.step >> 1).view(np.uint32) * np.uint32(0x9E3779B1)
    for context, bits in zip(d.contexts, TABLE_BITS):
        x = (context ^ context >> np.uint32(16)).take(d.place)
        x += node
        x *= np.uint32(0x85EBCA6B)
        x >>= np.uint32(32 - bits)
        yield x.astype(np.intp)


def chunks(words: list[bytes], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, history, word number of each byte) of words with their end marks, about size bytes at a time; long words are cut, with history."""
    nothing = np.full(8, END, np.uint8)  # at least 5 bytes
    pending: list[bytes] = []
    lengths: list[int] = []
    held = first = 0

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(pending), np.uint8), nothing, np.repeat(np.arange(first, first + len(lengths)), lengths)

    for i, w in enumerate(words):
        t = w + b"\xff"
        if pending and held + len(t) > size:
            yield joined()
            pending, lengths, held = [], [], 0
        if len(t) > size:
            a = np.frombuffer(t, np.uint8)
            for at in range(0, len(a), size):
                yield a[at : at + size], np.concatenate((nothing, a[max(0, at - HISTORY) : at]))[-HISTORY:], np.full(len(a[at : at + size]), i)
            continue
        if not pending:
            first = i
        pending.append(t)
        lengths.append(len(t))
        held += len(t)
    if pending:
        yield joined()


# -- model


@dataclass
class Speller:
    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray
    sse: np.ndarray

    @functools.cached_property
    def refinement(self) -> np.ndarray:
        """Flat float32 probabilities of outcome 1, by previous byte and logit; unseen cells keep the logit's own."""
        grid = squash(np.linspace(-8, 8, SSE))
        return ((self.sse[..., 0] + grid * 24) / (self.sse[..., 1] + 24)).astype(np.float32).ravel()

    @staticmethod
    def new(code: Code, tables: list[np.ndarray]) -> Speller:
        return Speller(code, tables, np.full((GATES, len(TABLE_BITS)), 0.4, np.float32), np.zeros((256, SSE, 2)))


def squash(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


def mixed(m: Speller, d: Decisions) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """(logit of the mixture, logits of each context, gate, outcome) of each decision."""
    raw = [table.take(x) for table, x in zip(m.tables, slots(d))]
    gate = d.gate.copy()
    for k, r in enumerate(raw):
        gate |= (r != 0).view(np.uint8) << np.uint8(k)
    logits = [LOGITS.take(r.view(np.uint8)) for r in raw]
    z = np.zeros(len(gate), np.float32)
    for k, x in enumerate(logits):
        z += m.weights[:, k].take(gate) * x
    np.clip(z, -12, 12, out=z)
    return z, logits, gate, (d.step & 1).astype(np.float32)


def sse_place(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = np.clip(z, np.float32(-7.999), np.float32(7.999))
    x += np.float32(8)
    x *= np.float32((SSE - 1) / 16)
    low = x.astype(np.intp)
    return low, x - low.astype(np.float32)


def previous_byte(d: Decisions) -> np.ndarray:
    """The byte before each decision's byte: nodes are numbered by it."""
    return d.step >> 9


def log_probabilities(m: Speller, words: list[bytes]) -> np.ndarray:
    """log10 probability of each word's spelling."""
    out = np.zeros(len(words))
    for data, history, owner in chunks(words):
        d = decisions(data, history, m.code)
        z, _, _, outcome = mixed(m, d)
        low, part = sse_place(z)
        cell = previous_byte(d) * SSE + low
        below = m.refinement.take(cell)
        p = (below + (m.refinement.take(cell + 1) - below) * part + squash(z)) * np.float32(0.5)
        p = np.abs(np.float32(1) - outcome - p)  # of what came
        out += np.bincount(owner.take(d.place), np.log(np.maximum(p, np.float32(1e-9))), len(words)) * math.log10(math.e)
    return out


def learn(m: Speller, words: list[bytes], rate: float) -> tuple[Speller, int]:
    """The weights after an online pass over the words, the adaptive table's counts, and the number of decisions."""
    w, sse, seen = m.weights.copy(), m.sse.reshape(-1, 2).copy(), 0
    for data, history, _ in chunks(words, 1 << 12):
        d = decisions(data, history, m.code)
        z, logits, gate, outcome = mixed(Speller(m.code, m.tables, w, m.sse), d)
        p = squash(z)
        error, spread = outcome - p, p * (1 - p)
        for k, x in enumerate(logits):
            w[:, k] += (rate * np.bincount(gate, error * x, GATES) / (np.bincount(gate, spread * x * x, GATES) + 4)).astype(np.float32)
        low, part = sse_place(z)
        cell = (previous_byte(d) * SSE + low + (part >= 0.5)).astype(np.int64)
        sse[:, 0] += np.bincount(cell, outcome, 256 * SSE)
        sse[:, 1] += np.bincount(cell, minlength=256 * SSE)
        seen += len(outcome)
    return Speller(m.code, m.tables, w, sse.reshape(256, SSE, 2)), seen


def count(words: list[bytes], code: Code, tables: list[np.ndarray]) -> None:
    """Adds the words' decisions to tables [slots * 2] of how often each outcome came."""
    keys: list[list[np.ndarray]] = [[] for _ in tables]
    for data, history, _ in chunks(words):
        d = decisions(data, history, code)
        bit = (d.step & 1).astype(np.intp)
        for key, x in zip(keys, slots(d)):
            key.append((x * 2 + bit).astype(np.uint32))
        if sum(map(len, keys[0])) > 1 << 20:
            for table, key in zip(tables, keys):
                add(table, key)
    for table, key in zip(tables, keys):
        add(table, key)


def add(table: np.ndarray, keys: list[np.ndarray]) -> None:
    """Counts the keys in the table and empties their list."""
    for key in keys:
        np.add.at(table, key.astype(np.intp), np.uint32(1))
    keys.clear()


def logit_table(counts: np.ndarray) -> np.ndarray:
    """int8 logits in 16ths from counts [slots, 2]."""
    c = counts.astype(np.float64) + PRIOR
    return np.rint(np.clip(np.log(c[:, 1] / c[:, 0]) * SCALE, -127, 127)).astype(np.int8)
