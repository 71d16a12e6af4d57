"""Telephony audio columns: mu-law, A-law and IMA ADPCM in WAVE form, decoded to resampled 16-bit PCM.

Logarithmic samples are expanded by tables of 256 values. ADPCM is sequential within a block, so blocks are decoded side by side:
one numpy step handles the same sample of all blocks of many rows. PCM is resampled by a windowed-sinc polyphase filter in
integers, so that results don't depend on the machine.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Format tags of WAVE files.
A_LAW, MU_LAW, IMA_ADPCM = 6, 7, 17
#: Samples a second of telephony; bytes of a payload's unit, which is one ADPCM block.
RATE, UNIT = 8000, 576
#: IMA ADPCM step sizes and what each code adds to the step's index.
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279,
     307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871,
     5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32,
)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, np.int32)
#: Blocks that are decoded side by side (their samples take 2.3 KB each).
TOGETHER = 8192
#: Filter taps of each phase and the scale of their integers.
TAPS, SCALE = 8, 1 << 14


def mu_law_table() -> np.ndarray:
    u = ~np.arange(256) & 0xFF
    size = (((u & 0x0F) << 3) + 0x84 << (u >> 4 & 7)) - 0x84
    return np.where(u & 0x80, -size, size).astype(np.int16)


def a_law_table() -> np.ndarray:
    a = np.arange(256) ^ 0x55
    segment, size = a >> 4 & 7, (a & 0x0F) << 4
    size = np.where(segment == 0, size + 8, size + 0x108 << np.maximum(segment - 1, 0))
    return np.where(a & 0x80, size, -size).astype(np.int16)


TABLES = {MU_LAW: mu_law_table(), A_LAW: a_law_table()}


def steps_and_signs() -> np.ndarray:
    """The change of the predictor for each step index and code."""
    s, c = STEPS[:, None], np.arange(16)[None, :]
    change = (s >> 3) + np.where(c & 4, s, 0) + np.where(c & 2, s >> 1, 0) + np.where(c & 1, s >> 2, 0)
    return np.where(c & 8, -change, change).astype(np.int32)


CHANGES = steps_and_signs()


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """int16 samples [blocks, 1 + 2 x (bytes - 4)] of mono blocks [blocks, bytes]; an index beyond the table is its end."""
    n, size = blocks.shape
    out = np.empty((1 + 2 * (size - 4), n), np.int16)
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    index = np.minimum(blocks[:, 2], len(STEPS) - 1).astype(np.int32)
    out[0] = value
    columns = np.ascontiguousarray(blocks[:, 4:].T)
    changes = CHANGES.ravel()
    for i, column in enumerate(columns):
        for half, code in enumerate((column & 15, column >> 4)):  # the low half comes first
            value += changes[index * 16 + code]
            np.clip(value, -32768, 32767, out=value)
            index += MOVES[code]
            np.clip(index, 0, len(STEPS) - 1, out=index)
            out[1 + 2 * i + half] = value
    return np.ascontiguousarray(out.T)


def encode_adpcm(pcm: np.ndarray, size: int = UNIT) -> bytes:
    """Blocks of one row of samples, the last one repeated up to a whole block."""
    each = 1 + 2 * (size - 4)
    pcm = np.concatenate((pcm, np.repeat(pcm[-1:] if len(pcm) else np.zeros(1, np.int16), -len(pcm) % each or (each if not len(pcm) else 0))))
    out, index = bytearray(), 0
    for block in pcm.reshape(-1, each).astype(int).tolist():
        value = block[0]
        out += struct.pack("<hBB", value, index, 0)
        codes = []
        for x in block[1:]:
            code = min(range(16), key=lambda c: abs(max(-32768, min(32767, value + int(CHANGES[index, c]))) - x))
            value = max(-32768, min(32767, value + int(CHANGES[index, code])))
            index = max(0, min(len(STEPS) - 1, index + int(MOVES[code])))
            codes.append(code)
        out += bytes(a | b << 4 for a, b in zip(codes[::2], codes[1::2]))
    return bytes(out)


def wave(payload: bytes, tag: int, rate: int = RATE, block: int = UNIT) -> bytes:
    """A mono WAVE file around 8-bit samples or ADPCM blocks."""
    if tag == IMA_ADPCM:
        per = 1 + 2 * (block - 4)
        form = struct.pack("<HHIIHHHH", tag, 1, rate, rate * block // per, block, 4, 2, per)
        samples = len(payload) // block * per
    else:
        form, samples = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0), len(payload)
    body = b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body


def read_wave(data: bytes) -> tuple[int, int, int, bytes]:
    """(tag, rate, block size, payload) of a WAVE file; ValueError if it is none or cut off."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("no WAVE file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIH", data, at + 8)
        elif kind == b"data" and form:
            if at + 8 + size > len(data):
                raise ValueError("a WAVE file that is cut off")
            return form[0], form[2], form[4], data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("a WAVE file without samples")


def filters(up: int) -> np.ndarray:
    """Integer taps [up, TAPS] of each phase; phase 0 passes samples through."""
    t = np.arange(-(TAPS // 2) + 1, TAPS // 2 + 1)[None, :] - np.arange(up)[:, None] / up
    taps = np.sinc(t) * np.cos(np.pi * t / (TAPS + 1)) ** 2
    return np.rint(taps / taps.sum(axis=1, keepdims=True) * SCALE).astype(np.int32)


def resample(pcm: np.ndarray, up: int = 2) -> np.ndarray:
    """int16 samples at up times the rate."""
    if up == 1 or not len(pcm):
        return pcm
    padded = np.concatenate((np.zeros(TAPS // 2 - 1, np.int32), pcm.astype(np.int32), np.zeros(TAPS // 2, np.int32)))
    out = np.empty((len(pcm), up), np.int16)
    for phase, taps in enumerate(filters(up)):
        if phase == 0:
            out[:, 0] = pcm
            continue
        total = np.zeros(len(pcm), np.int32)
        for k, tap in enumerate(taps.tolist()):
            total += padded[k : k + len(pcm)] * np.int32(tap)
        out[:, phase] = np.clip(total + SCALE // 2 >> 14, -32768, 32767)
    return out.ravel()


def decoded(files: list[bytes | None]) -> list[tuple[int, int, bytes, np.ndarray] | None]:
    """(tag, rate, payload, int16 samples) of each file; None for null or unreadable ones. ADPCM blocks of all files go together."""
    out: list = []
    for f in files:
        try:
            out.append(None if f is None else read_wave(bytes(f)))
        except (ValueError, struct.error):
            out.append(None)
    by_size: dict[int, list[int]] = {}
    for i, x in enumerate(out):
        if x and x[0] in TABLES:
            out[i] = (x[0], x[1], x[3], TABLES[x[0]][np.frombuffer(x[3], np.uint8)])
        elif x and x[0] == IMA_ADPCM and x[2] > 4:
            by_size.setdefault(x[2], []).append(i)
        elif x:
            out[i] = None
    for size, rows in by_size.items():
        samples: dict[int, list[np.ndarray]] = {i: [] for i in rows}
        together: list[tuple[int, np.ndarray]] = []
        held = 0

        def decode() -> None:
            at, both = 0, decode_adpcm(np.concatenate([b for _, b in together]))
            for i, b in together:
                samples[i].append(both[at : at + len(b)].ravel())
                at += len(b)
            together.clear()

        for i in rows:  # long files in slices, short ones side by side
            blocks = np.frombuffer(out[i][3], np.uint8)[: len(out[i][3]) // size * size].reshape(-1, size)
            for part in (blocks[k : k + TOGETHER] for k in range(0, len(blocks), TOGETHER)):
                if together and held + len(part) > TOGETHER:
                    decode()
                    held = 0
                together.append((i, part))
                held += len(part)
        if together:
            decode()
        for i in rows:
            out[i] = (out[i][0], out[i][1], out[i][3], np.concatenate(samples[i]) if samples[i] else np.empty(0, np.int16))
    return out


def pcm_column(media: DataFrame, up: int = 2) -> DataFrame:
    """media with columns tag, rate (that of the result), payload and pcm (16-bit little-endian samples), from its media column.

    Null, unreadable and unknown media get nulls there; columns with these names are replaced, all others pass.
    """
    kept = media.drop("tag", "rate", "payload", "pcm")
    schema = kept.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = decoded(list(b["media"]))
            yield b.assign(
                tag=pd.array([x and x[0] for x in got], "Int32"), rate=pd.array([x and x[1] * up for x in got], "Int32"),
                payload=[x and x[2] for x in got], pcm=[None if x is None else resample(x[3], up).astype("<i2").tobytes() for x in got],
            )

    return kept.mapInPandas(run, f"{schema},tag int,rate int,payload binary,pcm binary")


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 filled with bytes 255 up to a positive multiple of UNIT, and its length before."""
    data = text.encode("utf-8", "surrogatepass") if text else b""
    return data + b"\xff" * (UNIT - len(data) if not data else -len(data) % UNIT), len(data)


def form_of(payload: bytes) -> int:
    """Which format stores a payload, by its checksum, so that equal texts are stored alike."""
    return (MU_LAW, A_LAW, IMA_ADPCM)[zlib.crc32(payload) % 3]


def measures(pcm: np.ndarray) -> str:
    """Peak, root mean square, sign changes and the first 16 digits of the samples' SHA-256, all from integers."""
    if not len(pcm):
        return "0:0:0:"
    wide = pcm.astype(np.int64)
    rms = math.isqrt(int((wide * wide).sum()) // len(pcm))
    changes = int(np.count_nonzero(np.signbit(pcm[1:]) != np.signbit(pcm[:-1])))
    return f"{int(np.abs(wide).max())}:{rms}:{changes}:{hashlib.sha256(pcm.astype('<i2').tobytes()).hexdigest()[:16]}"


def store_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a WAVE file. Null texts are stored as empty ones.

    Repeated rows come back as often as they came, equal texts as equal files; a null doc_id stays null. An empty table gives an empty
    result; other columns of docs, whatever their names, don't count. A file holds its whole text, however long.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [payload_of(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for _, n in made], "media": [wave(p, form_of(p)) for p, _ in made]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, "doc_id long, n_bytes long, media binary")


def digests(stored: DataFrame, up: int = 2) -> DataFrame:
    """What is read back of each row (doc_id, n_bytes, media): lengths, checksums and measures of the resampled PCM.

    Long files are decoded TOGETHER blocks at a time. Repeated rows come back as often as they came, an empty table gives an empty
    result; other columns don't count. A null media, and one that isn't a file of a known form,
    has no payload and no feature: these are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = []
            for data, x in zip(b["media"], decoded(list(b["media"]))):
                if x is None:
                    rows.append((None, None, None, *((None, None) if data is None else (len(data), sha(data))), None))
                    continue
                tag, _, payload, pcm = x
                rows.append((len(payload), sha(payload), zlib.crc32(payload[-32:]), len(data), sha(data), f"{tag}:{measures(resample(pcm, up))}"))
            out = pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]).astype({c: "Int64" for c in ("payload_bytes", "tail_crc32", "media_bytes")})
            out.insert(0, "doc_id", b["doc_id"].array)
            out.insert(1, "n_bytes", b["n_bytes"].array)
            yield out

    return stored.select("doc_id", "n_bytes", "media").mapInPandas(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
