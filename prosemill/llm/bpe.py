"""Byte-level BPE by monoid tree reduction.

A text is halved until its parts hold a few matches of the pattern; these are encoded by merging neighbours of the lowest rank, and
parts are joined going up. A join keeps all tokens of both sides but those near the seam, which it encodes again in a window that
grows until the tokens outside cannot change:

- Between a character that is no white space and a white-space one every match of the pattern ends, whatever stands around. If the
  seam is such a place, nothing is encoded again; otherwise the window grows on both sides to the nearest such place.
- A run without such a place can be of any length. There, matches are found in one pass, and a long match is halved itself. A
  sequence of tokens is the encoding of its bytes exactly if each pair of neighbours is the encoding of its own bytes; so the window
  around the seam grows by tokens until the pairs at both of its edges pass that test.

Decoding joins the tokens' bytes up a tree in the same way, and there no seam needs care.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most characters of a part that isn't halved, bytes of a match that isn't, tokens that are decoded at once.
PART, MATCH, TOKENS = 256, 64, 256
#: Distinct matches whose tokens a worker remembers before it starts anew.
CACHE = 1 << 18
#: Stands for no rank.
NONE = 1 << 40
#: White space at which a match surely ends.
SPACES = " \n\t\r"
#: The last character of a match that surely ends.
CUT = re.compile(rf"\S(?=[{SPACES}])")


class Bpe:
    """An encoder for one vocabulary file (base64 token and rank on each line) and pattern."""

    def __init__(self, path: str, pattern: str, part: int = PART, match: int = MATCH):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.names = {i: str(i) for i in self.tokens}
        self.part, self.match = max(2, part), max(2, match)
        self.cache: dict[str, list[int]] = {}
        self.pattern = regex.compile(pattern)
        self.fits = functools.lru_cache(1 << 16)(self._fits)

    # -- texts

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.part:
            return self._run(text)
        middle = len(text) // 2
        near = CUT.search(text, middle, middle + self.match)  # cut there, no token is encoded twice
        middle = near.end() if near else middle
        return self.join(text[:middle], self.encode(text[:middle]), text[middle:], self.encode(text[middle:]))

    def join(self, a: str, left: list[int], b: str, right: list[int]) -> list[int]:
        """The tokens of a + b from those of a and of b."""
        if not a or not b or ends_match(a[-1], b[0]):
            return left + right
        p, q = last_end(a), first_end(b)
        window = a[p:] + b[:q]
        inner = self._run(window)
        return left[: len(left) - self._tokens(left, len(a[p:].encode()), -1)] + inner + right[self._tokens(right, len(b[:q].encode()), 1) :]

    def _tokens(self, ids: list[int], n: int, step: int) -> int:
        """How many tokens from this end have n bytes."""
        count = 0
        for i in ids[::step] if step > 0 else reversed(ids):
            if n <= 0:
                break
            n -= len(self.tokens[i])
            count += 1
        return count

    def _run(self, text: str) -> list[int]:
        cache, out = self.cache, []
        for m in self.pattern.findall(text):
            ids = cache.get(m)
            if ids is None:
                data = m.encode()
                whole = self.ranks.get(data)
                ids = [whole] if whole is not None else self._match(data)
                if len(data) <= self.match:
                    if len(cache) >= CACHE:
                        cache.clear()
                    cache[m] = ids
            out += ids
        return out

    # -- bytes of one match

    def _match(self, data: bytes) -> list[int]:
        if len(data) <= self.match:
            return self._merged(data)
        middle = len(data) // 2
        return self._merge(self._match(data[:middle]), self._match(data[middle:]))

    def _merged(self, data: bytes) -> list[int]:
        """The tokens of a few bytes: of all neighbours that are a token together, those of the lowest rank become one, the first first."""
        ranks = self.ranks
        whole = ranks.get(data)
        if whole is not None:
            return [whole]
        get, starts = ranks.get, list(range(len(data) + 1))
        pairs = [get(data[i : i + 2], NONE) for i in range(len(data) - 1)]
        while pairs and (best := min(pairs)) != NONE:
            i = pairs.index(best)
            del pairs[i], starts[i + 1]
            if i:
                pairs[i - 1] = get(data[starts[i - 1] : starts[i + 1]], NONE)
            if i < len(pairs):
                pairs[i] = get(data[starts[i] : starts[i + 2]], NONE)
        return [ranks[data[a:b]] for a, b in zip(starts, starts[1:])]

    def _fits(self, a: int, b: int) -> bool:
        return self._merged(self.tokens[a] + self.tokens[b]) == [a, b]

    def _merge(self, left: list[int], right: list[int]) -> list[int]:
        """The tokens of both halves' bytes together."""
        k = m = 0
        while True:
            inner = self._merged(b"".join(self.tokens[i] for i in left[len(left) - k :] + right[:m])) if k or m else []
            before, after = left[: len(left) - k], right[m:]
            row = [*before[-1:], *inner, *after[:1]]
            wrong_left = bool(before) and len(row) > 1 and not self.fits(row[0], row[1])
            wrong_right = bool(after) and len(row) > 1 and not self.fits(row[-2], row[-1])
            if not wrong_left and not wrong_right:
                return before + inner + after
            k = min(len(left), 2 * k + 1) if wrong_left else k
            m = min(len(right), 2 * m + 1) if wrong_right else m

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= TOKENS:
            return b"".join(map(self.tokens.__getitem__, ids))
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def ends_match(before: str, after: str) -> bool:
    """Whether a match ends between these characters in any text."""
    return after in SPACES and not before.isspace()


def last_end(text: str) -> int:
    """The last place in the text where a match surely ends; 0 if none."""
    for p in range(len(text) - 1, 0, -1):
        if text[p] in SPACES and not text[p - 1].isspace():
            return p
    return 0


def first_end(text: str) -> int:
    """The first such place; the text's length if none."""
    for p in range(1, len(text)):
        if text[p] in SPACES and not text[p - 1].isspace():
            return p
    return len(text)


@functools.lru_cache(4)
def loaded(path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker."""
    return Bpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs (doc_id, text, and any others); null and empty texts have no ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "ids": [bpe.encode(t or "") for t in b["text"]]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data binary) of each row (doc_id, ids)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "data": [bpe.decode(list(i)) if i is not None else b"" for i in b["ids"]]})

    return encoded.select("doc_id", "ids").mapInPandas(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded, in one pass.

    Null and empty texts have no tokens; repeated rows come back as often as they came.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = loaded(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            rows = []
            for t in b["text"]:
                ids = bpe.encode(t or "")
                rows.append((len(ids), sha(" ".join(map(bpe.names.__getitem__, ids)).encode()).hexdigest(), sha(bpe.decode(ids)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            out.insert(0, "doc_id", b["doc_id"].array)
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
