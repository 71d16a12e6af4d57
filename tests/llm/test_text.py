"""BPE, audio, pages, toxicity and the language model."""

import hashlib
import math
import os
import pickle
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken

from pyspark.sql import functions as F

from prosemill.llm import audio, bpe, html_text, mixlm, spelling, toxicity

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["abc", "the ", "  ", "\n", "'s", "'ll", "don't", "é", "日本語", "12", "!!", " \t ", " ", "x" * 7, "🙂", "\r\n", "'", "aaaa", "   \n ", "a'l", " "]


def library(b):
    return tiktoken.Encoding("t", pat_str=PATTERN, mergeable_ranks=b.ranks, special_tokens={})


@pytest.mark.parametrize("part,match", [(2, 2), (3, 4), (17, 9), (256, 64)])
def test_bpe_equals_the_library(part, match):
    b, r = bpe.Bpe(PATH, PATTERN, part, match), random.Random(part)
    core = library(b)
    for _ in range(400):
        s = "".join(r.choice(PIECES) for _ in range(r.randint(0, 80)))
        ids = b.encode(s)
        assert ids == core.encode_ordinary(s) and b.decode(ids) == s.encode()


def test_bpe_long_runs():
    b, r = bpe.Bpe(PATH, PATTERN), random.Random(1)
    for s in ("a" * 20_000, "".join(r.choice("abcdefghij") for _ in range(30_000)), " " * 9_000 + "x", "日本" * 5_000):
        assert b.encode(s) == library(b).encode_ordinary(s)


def test_bpe_halves_where_matches_end():
    """Ordinary texts are never cut within a match, so no token is encoded twice."""
    b, r = bpe.Bpe(PATH, PATTERN), random.Random(2)
    seen, join = [], b.join
    b.join = lambda a, left, c, right: seen.append(bpe.ends_match(a[-1], c[0])) or join(a, left, c, right)
    s = " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 12))) for _ in range(3000))
    assert b.encode(s) == library(b).encode_ordinary(s) and len(seen) > 50 and all(seen)


def test_bpe_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world", 5), (None, None, 1), (3, "", 2), (3, "", 2)], "doc_id long, text string, n_tokens int")
    got = bpe.round_trip(docs, PATH, PATTERN).collect()
    enc = library(bpe.loaded(PATH, PATTERN))
    ids = enc.encode_ordinary("Hello world")
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted([(1, len(ids), sha(" ".join(map(str, ids)).encode()), sha(b"Hello world")), (None, 0, sha(b""), sha(b"")), (3, 0, sha(b""), sha(b"")), (3, 0, sha(b""), sha(b""))], key=str)
    back = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH, PATTERN).filter("doc_id = 1").first()["data"]
    assert bytes(back) == b"Hello world" and bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def slow_adpcm(block):
    value, index = int.from_bytes(block[:2], "little", signed=True), min(block[2], 88)
    out = [value]
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(audio.STEPS[index])
            diff = (step >> 3) + (step if code & 4 else 0) + (step >> 1 if code & 2 else 0) + (step >> 2 if code & 1 else 0)
            value = max(-32768, min(32767, value - diff if code & 8 else value + diff))
            index = max(0, min(88, index + (-1 if code & 7 < 4 else 2 * ((code & 7) - 3))))
            out.append(value)
    return out


def test_adpcm_blocks_decode_as_one_by_one():
    blocks = np.random.default_rng(1).integers(0, 256, (7, 36), dtype=np.uint8)
    assert audio.decode_adpcm(blocks).tolist() == [slow_adpcm(b.tolist()) for b in blocks]
    wave = (8000 * np.sin(np.arange(3000) / 20)).astype(np.int16)
    back = audio.decode_adpcm(np.frombuffer(audio.encode_adpcm(wave), np.uint8).reshape(-1, audio.UNIT)).ravel()[:3000]
    assert np.abs(back.astype(int) - wave)[100:].max() < 400


def test_long_files_are_decoded_in_slices(monkeypatch):
    r = np.random.default_rng(4)
    files = [audio.wave(r.integers(0, 256, 576 * n, dtype=np.uint8).tobytes(), audio.IMA_ADPCM) for n in (1, 7, 0, 3, 20)]
    whole = audio.decoded(files)
    monkeypatch.setattr(audio, "TOGETHER", 3)
    assert all((a[3] == b[3]).all() and len(a[3]) == n * 1145 for a, b, n in zip(whole, audio.decoded(files), (1, 7, 0, 3, 20)))


def test_logarithmic_tables():
    """Symmetric, monotonic, and with the known ends."""
    mu, a = audio.TABLES[audio.MU_LAW].astype(int), audio.TABLES[audio.A_LAW].astype(int)
    assert mu[0] == -32124 and mu[128] == 32124 and mu[255] == 0 and (np.diff(mu[:128]) > 0).all() and (mu[:128] == -mu[128:]).all()
    assert a[0x55] == -8 and a[0xD5] == 8 and a[0xAA] == 32256 and a[0x2A] == -32256 and len(set(a)) == 256


def test_media_that_cannot_be_read(spark):
    good = audio.wave(b"\x00\x80" * 288, audio.MU_LAW)
    rows = [(1, 576, good), (2, None, None), (3, 4, b"oops"), (4, 0, b""), (None, 576, good)]
    got = {x["doc_id"]: x for x in audio.digests(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["payload_bytes"] == got[None]["payload_bytes"] == 576 and got[1]["feature"] == got[None]["feature"]
    assert all(got[i][c] is None for i in (2, 3, 4) for c in ("payload_bytes", "payload_sha256", "tail_crc32", "feature"))
    assert got[2]["media_bytes"] is None and got[3]["media_bytes"] == 4 and got[4]["media_bytes"] == 0


def test_pages_without_an_end_of_head(spark):
    body = "<article><p>" + "This is a plain sentence of an article. " * 12 + "</p></article>"
    head = '<head><meta charset="utf-8"><title>Not shown</title><style>p {}</style><script>x()</script>'
    tree = html_text.train(spark)
    want = html_text.main_text(f"<html>{head}</head><body>{body}</body></html>", tree)
    assert want.startswith("This is a plain") and "Not shown" not in want
    for page in (f"<html>{head}<body>{body}</body></html>", f"<!doctype html>{head}{body}", f"{head}\n<base href='/'>\n<body class=x>{body}"):
        assert html_text.main_text(page, tree) == want


def test_resampling_passes_samples_and_keeps_tones():
    x = (10_000 * np.sin(np.arange(2000) / 7)).astype(np.int16)
    y = audio.resample(x, 2)
    assert (y[::2] == x).all() and np.abs(y[201:3001:2] - 10_000 * np.sin((np.arange(100, 1500) + 0.5) / 7)).max() < 60
    assert len(audio.resample(x[:0])) == 0


def test_texts_as_media(spark):
    texts = ["abc", "abc", "", None, "é" * 50_000, "x" * 576]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    got = {x["doc_id"]: x for x in audio.digests(audio.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\xff" * (576 * max(1, -(-len(data) // 576)) - len(data))
        x = got[i]
        assert (x["n_bytes"], x["payload_bytes"], x["payload_sha256"], x["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[0][2:] == got[1][2:] and got[2][1:] == got[3][1:]
    assert audio.digests(audio.store_texts(docs.limit(0))).count() == 0


def test_pcm_column(spark):
    files = [audio.wave(b"\x80" * 100, audio.MU_LAW), audio.wave(b"\xd5" * 7, audio.A_LAW), audio.wave(bytes(576 * 2), audio.IMA_ADPCM), b"no wave", None, audio.wave(b"12", 1)]
    df = spark.createDataFrame([(i, f, "old") for i, f in enumerate(files)], "id int, media binary, pcm string")
    got = {x["id"]: x for x in audio.pcm_column(df).collect()}
    assert [got[i]["tag"] for i in range(6)] == [7, 6, 17, None, None, None] and len(got[0]["pcm"]) == 400 and len(got[2]["pcm"]) == 2 * 1145 * 4 and got[0]["rate"] == 16_000


PAGE = """<html><head><title>T</title><script>var a="<p>x</p>";</script></head><body><header class="site"><a href=/>Home</a></header><nav><ul><li><a href=/a>A</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work and to count its readers.</div><article><h1>Head &amp; line</h1><p>First para&shy;graph with <b>bold</b>
 words<br>and a break.</p><aside>Read also this</aside><p>No.</p><div class="share">Share this</div></article><div class="ad">Buy now and save a lot of money today</div>
<section id="comments"><p>A reader's comment that is long enough to pass for an article's paragraph, were it not among comments.</p></section><form><label>Mail</label></form><footer>&copy; 2020</footer></body></html>"""


def test_main_text(spark):
    tree = html_text.train(spark)
    assert html_text.main_text(PAGE, tree) == "Head & line\nFirst para­graph with bold words and a break.\nNo."
    rows = [list(map(float, x.split())) for x in html_text.LABELLED.strip().splitlines()[1:]]
    assert sum(html_text.classify(tree, tuple(r[:-1])) != (r[-1] > 0.5) for r in rows) == 0
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, None), (3, "u", "", ""), (4, "u", "<!-- never closed <p>x", ""), (4, "u", "<p", ""), (5, "u", "<div>" * 3000 + "x" * 200_000, "")], "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert [x["n_chars"] for x in sorted(got, key=lambda x: x["page_id"])][:4] == [len(html_text.main_text(PAGE, tree)), 0, 0, 0] and len(got) == 6


class Articles(HTMLParser):
    """Lines of the article of a page of the test tables, whose blocks are headings and paragraphs."""

    def __init__(self):
        super().__init__()
        self.inside, self.lines = False, [""]

    def handle_starttag(self, tag, attrs):
        self.inside |= tag == "article"
        if tag in ("article", "h1", "p", "ul", "li", "div"):
            self.lines.append("")
        if tag == "br":
            self.lines[-1] += " "

    def handle_endtag(self, tag):
        if tag in ("article", "h1", "p", "ul", "li", "div"):
            self.lines.append("")
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.lines[-1] += data


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the test tables")
def test_pages_equal_another_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {x["page_id"]: x["text"] for x in html_text.extract(pages).collect()}
    assert len(got) == 50
    for x in pages.collect():
        a = Articles()
        a.feed(x["html"])
        assert got[x["page_id"]] == "\n".join(" ".join(line.split()) for line in a.lines if line.strip())


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a "' * 250_000, "<div>" * 100_000 + "</section>" * 100_000, "<" * 1_000_000, "<script>" * 100_000, "<a x='" * 150_000 + ">", "<p>" + "&" * 500_000])
def test_broken_pages_take_linear_time(page):
    began = time.time()
    html_text.read_blocks(page)
    assert time.time() - began < 20


def test_tags_of_broken_pages():
    got = lambda page: [b.text for b in html_text.read_blocks(page)]
    assert got("<p>a < b</p><P title='x>y'>c<!-- > --><p>d<br/>e &lt;i&gt;") == ["a < b", "c", "d e <i>"]
    assert got("<p>one<p title=\"x>two<p>three</p>3 < 4") == ["one", "two", "three", "3 < 4"]
    assert got("<div><ul><li>x</div>y</ul>z<style>p{}</STYLE >w<!DOCTYPE q>v") == ["x", "y", "zwv"]


def toxic_corpus():
    r = random.Random(4)
    word = lambda: "".join(r.choice(["an", "er", "th", "ou", "in", "es"]) for _ in range(r.randint(1, 4)))
    bad = ["scoundrel", "vermin", "blockhead", "dunce"]
    rows, labels = [], []
    for i in range(900):
        toxic = i % 4 == 0
        ws = [word() for _ in range(60)]
        for _ in range(3 if toxic else 0):
            ws.insert(r.randrange(len(ws)), r.choice(bad))
        rows.append((i, " ".join(ws) + ".", "en"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_corpus()
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, known).collect()
    held = [x for x in got if x["held_out"]]
    assert len(got) == len(rows) and {x["held_out"] == (zlib.crc32(str(x["doc_id"]).encode()) % 5 == 0) for x in got} == {True}
    assert all(x["predicted"] == (x["doc_id"] % 4 == 0) == (x["score"] >= 0.5) for x in held)
    clean = toxicity.keep_clean(docs, known)
    assert clean.columns == docs.columns and clean.filter("doc_id % 4 = 0").count() == 0 and clean.count() == 675


def test_common_words_do_not_tell(spark):
    """A word of most texts that toxic ones hold somewhat more often, beyond chance, stays in both dictionaries."""
    rows, labels = toxic_corpus()
    often = lambda i: i // 4 % 10 < 9 if i % 4 == 0 else i % 20 < 11
    rows = [(i, t[:-1] + " mostly." if often(i) else t, s) for i, t, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    words = lambda segments: {w for s in segments for w in s.split()}
    assert words(model.toxic) - words(model.ordinary) == {b"scoundrel", b"vermin", b"blockhead", b"dunce"}
    assert all(x["predicted"] == (x["doc_id"] % 4 == 0) for x in toxicity.scored(docs, model).collect())


def test_held_out_labels_change_nothing(spark):
    """Not even their share; scores equal those of windows that are compressed one by one."""
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows[:300] + [(1000, None, "x"), (1001, "vermin", "x"), (1002, "an er " * 30_000 + "dunce", "x")], "doc_id long, text string, score string")
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    schema = "doc_id long, quality int, toxic int"
    model = toxicity.train(docs, spark.createDataFrame(labels[:300], schema))
    other = toxicity.train(docs, spark.createDataFrame([(i, q, 1 - y if held(i) else y) for i, q, y in labels[:300]], schema))
    assert model == other and model.toxic and model.ordinary
    for x in toxicity.scored(docs, model).collect():
        ws = toxicity.letter_words(x["text"])
        hits = 0
        for at in range(0, len(ws), toxicity.WINDOW):
            window = toxicity.FRAME[0] + b"".join(map(toxicity.code, ws[at : at + toxicity.WINDOW])) + toxicity.FRAME[1]
            hits += len(toxicity.compressor(model.ordinary).compress(window)) - len(toxicity.compressor(model.toxic).compress(window)) >= model.threshold if len(ws) < 1000 else 0
        if len(ws) < 1000:
            z = float(np.dot(model.weights, [1, math.log2(1 + 1000 * hits / max(len(ws), 1)) / 8]))
            assert x["score"] == pytest.approx(1 / (1 + math.exp(-z)))
        if x["doc_id"] >= 1000:
            assert x["predicted"] == (x["doc_id"] == 1001)


def test_toxicity_without_labels_and_with_odd_rows(spark):
    odd = spark.createDataFrame([(None, None), (1, ""), (2, "x" * 200_000), (2, "x" * 200_000)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [x["score"] for x in toxicity.toxicity(odd, none).collect()] == [0.0] * 4
    assert toxicity.toxicity(odd.limit(0), none).count() == 0


def lm_docs():
    """Texts in which a word often has the same successor."""
    r = random.Random(6)
    pool = ["".join(r.choice(["an", "er", "th", "ou", "in", "És"]) for _ in range(r.randint(1, 4))) for _ in range(150)]

    def text(n):
        at, out = 0, []
        for _ in range(n):
            at = (at * 7 + 1) % 150 if r.random() < 0.6 else r.randrange(150)
            out.append(pool[at])
        return " ".join(out)

    return [(i, text(r.choice([0, 3, 80])), 1) for i in range(300)] + [(None, None, 1), (7, "Zz\n zz  zz", 1), (7, "Zz\n zz  zz", 1), (8, "w" * 150_000, 1)]


def test_base_scores_and_model(spark):
    docs = lm_docs()
    rows = spark.createDataFrame(docs, "doc_id long, text string, score int")
    got = mixlm.language_scores(rows).collect()
    token = lambda t: [*mixlm.words(t), None]
    learnt = Counter(w for i, t, _ in docs if zlib.crc32(b"" if i is None else str(i).encode()) % 10 for w in token(t))
    n, v = sum(learnt.values()), len(learnt)
    want = Counter()
    for i, t, _ in docs:
        base = sum(math.log10((learnt[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token(t))
        want[(i, len(token(t)), sum(w in learnt for w in token(t)), n, round(base, 6))] += 1
    assert Counter((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    held = [x for x in got if x["held_out"] and x["n_tokens"] > 50]
    assert held and sum(x["score"] for x in held) > sum(x["base_score"] for x in held) and all(x["score"] < 0 for x in got)
    assert len({x["score"] for x in got if x["doc_id"] == 7 and x["n_tokens"] == 4}) == 1
    key = lambda rows: Counter((x["doc_id"], x["n_tokens"], round(x["score"], 4)) for x in rows)
    assert key(mixlm.language_scores(rows.repartition(7).orderBy(F.rand(3))).collect()) == key(got)


def token_model():
    r = np.random.default_rng(3)
    known = [(f"w{i:03}", int(3000 / (i + 1)) + 2, i % 3) for i in range(400)]
    lex = mixlm.lexicon(known, 500, 700, 10_000.0)
    bits = [12, 13, 12, 12]
    m = mixlm.Model.new(lex, [r.integers(-30, 30, 1 << b, dtype=np.int8) for b in bits], bits)
    m.weights = r.normal(0.2, 0.2, m.weights.shape).astype(np.float32)
    m.curve = np.full(m.weights.shape, 0.01, np.float32)  # so that weights move fast
    ones = r.integers(0, 50, len(m.sse))
    m.sse = np.stack([ones, ones + r.integers(0, 50, len(m.sse))], axis=1).astype(float)
    return m, r


def test_all_decisions_of_a_path_are_mixed():
    """No two words share their decisions, whatever stands before changes each word's probability, and paths are bounded."""
    m, r = token_model()
    lex = m.lex
    paths = [tuple(lex.steps[a : a + n].tolist()) for a, n in zip(lex.first, lex.length)]
    assert len(set(paths)) == len(paths) == lex.rare + 2 and max(map(len, paths)) > 7 and not lex.tail.any()
    steep = mixlm.lexicon([(f"x{i}", 3**i, i % 2) for i in range(30)], 5, 5, 1e15)
    assert steep.length.max() <= mixlm.MOST and sum(0.5 ** steep.length.astype(float)) == pytest.approx(1)
    deep = int(np.argmax(lex.length))
    t, k = np.array([deep]), [np.array([7])] * 4
    assert len(mixlm.decisions(t, k, lex, m.bits).bit) == lex.length[deep]


def test_models_go_to_tasks_small():
    """A pickled lexicon is about its words and a few numbers for each, and comes back the same."""
    r = random.Random(5)
    ws = sorted({"".join(r.choice("abcdefgh") for _ in range(r.randint(5, 9))) for _ in range(20_000)})
    lex = mixlm.lexicon([(w, int(3e6 / (i + 1)) + 2, i % 20) for i, w in enumerate(ws)], 500, 700, 1e8)
    data = pickle.dumps(lex)
    back = pickle.loads(data)
    assert len(data) < 50 * len(ws) and max(back.length) == max(lex.length) > mixlm.DEPTH
    assert back.ids == lex.ids and all((getattr(back, k) == getattr(lex, k)).all() for k in ("steps", "first", "length", "kind", "tail", "own", "base"))


def slow_score(m, text):
    """The same, decision by decision, with contexts from their definition."""
    lex, end = m.lex, m.lex.rare + 1
    weights, sse, total, at = m.weights.astype(float).copy(), m.refinement().astype(float).copy(), 0.0, 0
    coarse = lambda w: w if w < min(mixlm.KNOWN2, lex.rare) else mixlm.KNOWN2 + int(lex.kind[w])
    for until in mixlm.rounds(len(text)):
        gains, outcomes = np.zeros(weights.shape), []
        for i in range(at, until):
            past = [end, *text[:i]]
            p1, p2 = past[-1], past[-2] if len(past) > 1 else end
            third = next(w for w in past[::-1] if w < min(mixlm.KNOWN3, lex.rare) or w == end)
            some = [w for w in past if w < min(mixlm.KNOWN4, lex.rare) or w == end]
            contexts = [(p1, p1), (coarse(p1), coarse(p2)), (third, third), (some[-1], some[-2] if len(some) > 1 else end)]
            hashes = [int(mixlm.hashed(np.array([a]), np.array([b]), k)[0]) for k, (a, b) in enumerate(contexts)]
            for s in lex.steps[lex.first[text[i]] :][: lex.length[text[i]]].tolist():
                node, bit = divmod(s, 2)
                slots = [((h + node * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF) >> 32 - b for h, b in zip(hashes, m.bits)]
                raw = [int(t[x]) for t, x in zip(m.tables, slots)]
                depth = node.bit_length() - 1
                gate = depth * 4 + 2 * (raw[0] != 0) + (raw[2] != 0)
                x = [*(v / mixlm.SCALE for v in raw), float(lex.own[node]), 1.0]
                z = max(-12.0, min(12.0, float(np.dot(weights[:, gate], x))))
                p, cell = 1 / (1 + math.exp(-z)), depth * mixlm.SSE + round(max(-8.0, min(8.0, z)) * 2 + 16)
                q = (p + sse[0][cell] / sse[1][cell]) / 2
                total += math.log10(q if bit else 1 - q)
                gains[:, gate] += (bit - p) * np.array(x)
                outcomes.append((cell, bit))
            total += lex.tail[text[i]]
        weights += gains / (m.curve * mixlm.STIFF)
        for cell, bit in outcomes:
            sse[:, cell] += (bit, 1)
        at = until
    return total


def test_scores_equal_a_slow_model():
    """Texts side by side, and each by itself, learn as one decision after the other would."""
    m, r = token_model()
    texts = [np.append(r.integers(0, m.lex.rare + 1, n) if n % 2 else np.minimum(r.geometric(0.02, n), m.lex.rare), m.lex.rare + 1) for n in (0, 1, 5, 31, 32, 200, 1501)]
    got = mixlm.score(m, texts)
    assert np.allclose(got, [slow_score(m, t.tolist()) for t in texts], rtol=1e-4)
    assert np.allclose(got, [mixlm.score(m, [t])[0] for t in texts], rtol=1e-9)


def test_tables_are_read_one_after_the_other():
    """Each table is larger than most caches, so short blocks of many texts read it together, and the next one after it."""
    m, r = token_model()
    texts = [np.append(r.integers(0, m.lex.rare + 1, n), m.lex.rare + 1) for n in range(400, 480)]
    want, reads = mixlm.score(m, texts), []

    class Table:
        def __init__(self, k, logits):
            self.k, self.logits = k, logits

        def take(self, at, **how):
            reads.append(self.k)
            return self.logits.take(at, **how)

    m.tables = [Table(k, x) for k, x in enumerate(m.tables)]
    assert (mixlm.score(m, texts) == want).all()
    assert len(reads) > 20 and sum(a != b for a, b in zip(reads, reads[1:])) == len(m.tables) - 1


def test_columns_of_texts_are_split_and_counted_as_texts():
    odd = [f" Ab{chr(c)}Cd {chr(c)}{chr(c)}x " for c in [*range(256), 0x1680, 0x2028, 0x3000, 0x130, 0x212A, 0x10FFFF]]
    texts = [None, "", *odd, " ", "b a a b c", "a c\nC a", *["z"] * 300]
    ws, n = mixlm.split(pa.array(texts, pa.string()))
    each = [mixlm.words(t) for t in texts]
    assert ws.to_pylist() == [w.decode() for x in each for w in x] and n.tolist() == [*map(len, each)]
    m, _ = token_model()
    texts = ["w000 W001 other", None, "w399"]
    t, owner = mixlm.symbols(*mixlm.split(pa.array(texts, pa.string())), m.lex)
    assert t.tolist() == [x for s in texts for x in mixlm.tokens(mixlm.words(s), m.lex).tolist()] and owner.tolist() == [0] * 4 + [1] + [2] * 2
    want: Counter = Counter()
    for own in map(Counter, each):
        if own:
            for w, k in own.items():
                want[w.decode(), zlib.crc32(max(own, key=own.get)) & 0xFF] += k
    words, kinds, counts = mixlm.kinds_of(ws, n)
    assert {(w, k): c for w, k, c in zip(words.to_pylist(), kinds.tolist(), counts.tolist(), strict=True)} == want


def test_long_texts_are_scored_in_parts(monkeypatch):
    m, r = token_model()
    t = np.append(np.minimum(r.geometric(0.02, 6000), m.lex.rare), m.lex.rare + 1)
    whole = mixlm.score(m, [t])[0]
    monkeypatch.setattr(mixlm, "PART", 2048)
    assert mixlm.score(m, [t])[0] == pytest.approx(whole, rel=1e-3)


def test_probabilities_of_next_symbols_sum_to_one():
    m, r = token_model()
    for before in ([], [3], [5, 401, 7, 2, 2]):
        alone = [mixlm.score(m, [np.array([*before, w])])[0] for w in range(m.lex.rare + 2)]
        start = mixlm.score(m, [np.array(before)])[0] if before else 0.0
        assert sum(10 ** (s - start) for s in alone) == pytest.approx(1, abs=1e-4)


def speller():
    r = np.random.default_rng(3)
    code = spelling.code_of(r.integers(0, 50, (256, 256)) * (r.random((256, 256)) < 0.1))
    tables = [r.integers(-60, 60, 1 << b, dtype=np.int8) for b in spelling.TABLE_BITS]
    return spelling.Speller(code, tables, r.normal(0.3, 0.2, (spelling.GATES, 3)).astype(np.float32), np.abs(r.normal(size=(256, spelling.SSE, 2))).cumsum(axis=2))


def test_probabilities_of_next_bytes_sum_to_one():
    m = speller()
    for before in (b"", b"theou", b"an"):

        def part(word):  # without its end mark
            d = spelling.decisions(np.frombuffer(word, np.uint8), np.full(8, 255, np.uint8), m.code)
            z, _, _, outcome = spelling.mixed(m, d)
            low, share = spelling.sse_place(z)
            cell = spelling.previous_byte(d) * spelling.SSE + low
            p = (m.refinement[cell] * (1 - share) + m.refinement[cell + 1] * share + spelling.squash(z)) / 2
            return float(np.log10(np.where(outcome > 0, p, 1 - p)).sum())

        start = part(before) if before else 0.0
        assert sum(10 ** (part(bytes([*before, b])) - start) for b in range(256)) == pytest.approx(1, abs=1e-3)
    assert spelling.log_probabilities(m, [b"an"])[0] == pytest.approx(part(b"an\xff"), rel=1e-5)


def test_long_words_are_spelt_in_parts_with_history():
    word = bytes(range(97, 123)) * 40
    m = speller()
    whole = next([*spelling.slots(spelling.decisions(d, h, m.code))] for d, h, _ in spelling.chunks([word]))
    cut = [np.concatenate(x) for x in zip(*([*spelling.slots(spelling.decisions(d, h, m.code))] for d, h, _ in spelling.chunks([word], 100)))]
    assert all((a == b).all() for a, b in zip(whole[:2], cut[:2]))  # the word so far reaches back as far as history does
    assert spelling.log_probabilities(m, [word, b"x", word])[0] == spelling.log_probabilities(m, [word])[0]


def test_empty_language_model(spark):
    assert mixlm.language_scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    some = [(i, "held out", 1) for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:3]
    got = mixlm.language_scores(spark.createDataFrame(some, "doc_id long, text string, row int")).collect()
    assert [(x["n_tokens"], x["n_known"], x["train_tokens"]) for x in got] == [(3, 0, 0)] * 3 and all(x["score"] < -1 for x in got)
