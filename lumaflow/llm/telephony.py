"""Telephony audio columns: mu-law, A-law and IMA ADPCM stored in RIFF/WAVE, expanded and resampled.

mu-law and A-law codes expand through 256-entry tables built from the G.711 rule. ADPCM blocks are
independent, so the decoder steps through the samples of all blocks of a batch at once with numpy.
The stored form keeps the coded bytes exactly; linear PCM is stored beside it, resampled by two. The codec
is one for all rows, or each payload's own by its checksum (MIXED), so that all three are in use.

Defined results: null and empty payloads become one padding unit of zeros; payloads of any length
are handled whole, their signal portion by portion; equal payloads give equal values; repeated rows are
computed each. The digest of media that were just stored is taken where they are made, in the same Python worker, so the
media (five to nine times the text with their PCM) don't go through the JVM; any other table of media is read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.llm.common import lean, small_batches, text_bytes
from lumaflow.llm.token_counts import text_groups

UNIT = 64
RATE = 8000
PORTION = 1 << 18  # samples at a time, in wide numbers
MIXED = "mixed"
# RIFF format tags, the IMA ADPCM index moves and quantiser steps.
TAGS = {"alaw": 6, "mulaw": 7, "ima_adpcm": 17}
INDEX_STEP = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)
STEPS = np.array(
    [7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767],
    np.int32,
)
# The half-band interpolation filter: weights over 32 of the samples at -1, 0, 1, 2.
HALF_BAND = (-3, 19, 19, -3)


def mulaw_table() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    exponent, base = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (base + 256) << np.maximum(exponent - 1, 0), base)
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = mulaw_table(), alaw_table()


def decode_ima(blocks: np.ndarray) -> np.ndarray:
    """(n, 64) coded bytes to (n, 121) samples: a header (predictor, index, reserved), then 60 bytes of two codes."""
    n = len(blocks)
    out = np.empty((n, 121), np.int16)
    value = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2].astype(np.int32), 88)
    out[:, 0] = value
    codes = np.empty((120, n), np.int32)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    for k in range(120):
        code, step = codes[k], STEPS[index]
        move = (((code & 7) * 2 + 1) * step) >> 3
        value = np.clip(np.where(code & 8, value - move, value + move), -32768, 32767)
        index = np.clip(index + INDEX_STEP[code & 7], 0, 88)
        out[:, k + 1] = value
    return out


def resample_double(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, a four-tap half-band filter fills between; the ends repeat."""
    n = len(pcm)
    out = np.empty(2 * n, np.int16)
    out[0::2] = pcm
    for a in range(0, n, PORTION):
        b = min(a + PORTION, n)
        near = pcm[np.clip(np.arange(a - 1, b + 2), 0, n - 1)].astype(np.int32)
        between = sum(w * near[k : k + b - a] for k, w in enumerate(HALF_BAND))
        out[2 * a + 1 : 2 * b : 2] = np.clip((between + 16) >> 5, -32768, 32767)
    return out


def wave_bytes(payload: bytes, codec: str) -> bytes:
    """A RIFF/WAVE file with the coded bytes as they are."""
    block = UNIT if codec == "ima_adpcm" else 1
    per_block = 121 if codec == "ima_adpcm" else 1
    bits = 4 if codec == "ima_adpcm" else 8
    extra = struct.pack("<HH", 2, per_block) if codec == "ima_adpcm" else struct.pack("<H", 0)
    fmt = struct.pack("<HHIIHH", TAGS[codec], 1, RATE, RATE * block // per_block, block, bits) + extra
    fact = struct.pack("<I", len(payload) // block * per_block)
    body = b"WAVE" + b"".join(k + struct.pack("<I", len(v)) + v for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wave(stored: bytes) -> tuple[int, bytes]:
    """Format tag and coded bytes of a stored file."""
    if stored[:4] != b"RIFF" or stored[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, tag = 12, 0
    while at + 8 <= len(stored):
        kind, size = stored[at : at + 4], struct.unpack_from("<I", stored, at + 4)[0]
        if kind == b"fmt ":
            tag = struct.unpack_from("<H", stored, at + 8)[0]
        if kind == b"data":
            return tag, stored[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def expand(tag: int, coded: bytes) -> np.ndarray:
    """Linear 16-bit samples of coded bytes."""
    raw = np.frombuffer(coded, np.uint8)
    if tag == TAGS["ima_adpcm"]:
        return np.concatenate([decode_ima(raw[a : a + PORTION].reshape(-1, UNIT)).ravel() for a in range(0, len(raw), PORTION)])
    return (MULAW if tag == TAGS["mulaw"] else ALAW)[raw]


def expand_all(files: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """expand() of many files: the blocks of all ADPCM files are decoded together."""
    joint = b"".join(c for tag, c in files if tag == TAGS["ima_adpcm"])
    samples = expand(TAGS["ima_adpcm"], joint) if joint else np.zeros(0, np.int16)
    out, at = [], 0
    for tag, coded in files:
        if tag == TAGS["ima_adpcm"]:
            n = len(coded) // UNIT * 121
            out.append(samples[at : at + n])
            at += n
        else:
            out.append(expand(tag, coded))
    return out


def codec_of(payload: bytes, codec: str) -> str:
    """The codec of a payload: `codec`, or the one that its checksum picks."""
    return tuple(TAGS)[zlib.crc32(payload) % len(TAGS)] if codec == MIXED else codec


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def signal_feature(tag: int, pcm: np.ndarray, stored_pcm: bytes | None) -> str:
    """Codec, energy, peak and zero crossings of the expanded signal, crc of the stored resampled PCM (of the same PCM
    made anew where none is stored)."""
    energy = peak = crossings = 0
    for a in range(0, len(pcm), PORTION):
        own = pcm[a : a + PORTION + 1]  # one more, for the crossing into the next portion
        crossings += int(np.count_nonzero((own[1:] < 0) != (own[:-1] < 0)))
        wide = own[:PORTION].astype(np.int64)
        energy += int(wide @ wide)
        peak = max(peak, int(np.abs(wide).max()))
    doubled = resample_double(pcm).astype("<i2").tobytes() if stored_pcm is None else stored_pcm
    return f"format={tag};n={len(pcm)};energy={energy};peak={peak};crossings={crossings};pcm16k={zlib.crc32(doubled)}"


MEDIA_SCHEMA = "n_bytes long, payload_bytes long, media binary, pcm16k binary"


def store_audio(docs: DataFrame, codec: str = "mulaw", id_col: str = "doc_id", text_col: str = "text", with_pcm: bool = True) -> DataFrame:
    """The operator's stored columns: media (RIFF/WAVE with the coded payload) and pcm16k (resampled little-endian PCM)."""
    narrow = small_batches(docs).select(F.col(id_col).alias("doc_id"), text_bytes(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in text_groups(texts, 1 << 20):
                payloads = [padded(t) for t in texts[part]]
                codecs = [codec_of(p, codec) for p in payloads]
                pcm = [resample_double(x).astype("<i2").tobytes() for x in expand_all([(TAGS[c], p) for c, p in zip(codecs, payloads, strict=True)])] if with_pcm else [None] * len(payloads)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, part.stop - part.start), pa.array([len(t) for t in texts[part]], pa.int64()), pa.array([len(p) for p in payloads], pa.int64()),
                        pa.array([wave_bytes(p, c) for p, c in zip(payloads, codecs, strict=True)], pa.binary()), pa.array(pcm, pa.binary()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "media", "pcm16k"],
                )

    kind = narrow.schema["doc_id"].dataType.simpleString()
    out = narrow.mapInArrow(lean(run), f"doc_id {kind}, {MEDIA_SCHEMA}")
    out.made_by = (narrow, run)
    return out


def media_digest(media: DataFrame) -> DataFrame:
    """Read stored media back and digest them: hashes, crc of the tail, signal features."""
    narrow, store = getattr(media, "made_by", (media.select("doc_id", "n_bytes", "media", "pcm16k"), iter))

    def run(batches):
        for batch in store(batches):
            stored = batch.column("media").to_pylist()
            for part in text_groups(stored, 1 << 20):
                own, n = stored[part], part.stop - part.start
                back = [read_wave(m) for m in own]
                coded = [c for _, c in back]
                pcm = batch.column("pcm16k").slice(part.start, n).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(part.start, n),
                        batch.column("n_bytes").slice(part.start, n),
                        pa.array([len(c) for c in coded], pa.int64()),
                        pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string()),
                        pa.array([zlib.crc32(c[-UNIT:]) for c in coded], pa.int64()),
                        pa.array([len(m) for m in own], pa.int64()),
                        pa.array([hashlib.sha256(m).hexdigest() for m in own], pa.string()),
                        pa.array([signal_feature(tag, x, y) for (tag, _), x, y in zip(back, expand_all(back), pcm, strict=True)], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    kind = media.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(lean(run), f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
