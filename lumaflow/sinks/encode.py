"""Image files: TIFF (u8, u16, f32; none or deflate) and baseline JPEG, one file by image.

Pixels are encoded to the output profile as Column expressions, packed by strips of rows and then
gathered by image (a file is one task's work); the bytes stay in a DataFrame
until they are written. EXIF orientation is left out, since the pixels are upright already."""

from __future__ import annotations

import struct
import zlib
from math import isfinite

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.functions import color
from lumaflow.functions.profiles import D50, OutputProfile, to_d50
from lumaflow.model import ContractError, Extent, Metadata
from lumaflow.operators.pointwise import encode_profile

DEFLATE = {"fast": 1, "balanced": 6, "best": 9}


def rational(x: float) -> tuple[int, int]:
    """First continued-fraction convergent within 1e-4 of a positive number."""
    if not isfinite(x) or x <= 0:
        return 0, 1
    (p0, q0), (p1, q1), rest = (1, 0), (int(x), 1), x - int(x)
    while p1 == 0 or abs(p1 / q1 - x) > 1e-4 * x:
        if rest == 0:
            break
        whole = int(1 / rest)
        rest = 1 / rest - whole
        p0, q0, p1, q1 = p1, q1, whole * p1 + p0, whole * q1 + q0
    return p1, q1


def _ifd(entries: list[tuple[int, int, bytes, int]], at: int) -> bytes:
    """A directory at a file offset; values over four bytes follow it."""
    entries = sorted(entries)
    tail_at = at + 2 + 12 * len(entries) + 4
    head, tail = struct.pack("<H", len(entries)), b""
    for tag, kind, value, n in entries:
        if len(value) <= 4:
            head += struct.pack("<HHI", tag, kind, n) + value.ljust(4, b"\0")
        else:
            head += struct.pack("<HHII", tag, kind, n, tail_at + len(tail))
            tail += value + b"\0" * (len(value) % 2)
    return head + struct.pack("<I", 0) + tail


def exif_entries(meta: Metadata) -> list[tuple[int, int, bytes, int]]:
    ratio = lambda x: struct.pack("<II", *rational(x))
    out = [(0x9000, 7, b"0232", 4)]
    for tag, value in ((0x829A, meta.shutter), (0x829D, meta.aperture), (0x920A, meta.focal_length)):
        if value > 0:
            out.append((tag, 5, ratio(value), 1))
    if meta.iso > 0:
        out.append((0x8827, 3, struct.pack("<H", min(65535, round(meta.iso))), 1))
    if meta.datetime:
        out.append((0x9003, 2, meta.datetime.encode() + b"\0", len(meta.datetime) + 1))
    return out


NAMES = {"srgb": "sRGB", "p3": "Display P3", "rec2020": "Rec.2020"}


def icc_profile(profile: str) -> bytes:
    """A version 4 matrix profile: colorants adapted from D65 to D50, the parametric transfer curve."""
    primaries, transfer = color.PROFILES[profile]
    fixed = lambda *v: struct.pack(f">{len(v)}i", *(round(x * 65536) for x in v))
    text = lambda t: b"mluc" + struct.pack(">IIIHHII", 0, 1, 12, 0x656E, 0x5553, 2 * len(t), 28) + t.encode("utf-16-be")
    chad = to_d50()
    colorants = color.mul(chad, color.rgb_to_xyz(primaries))
    curve = b"para" + struct.pack(">IHH", 0, 3, 0) + fixed(*transfer)
    values = [(b"desc", text(NAMES[profile])), (b"cprt", text("No copyright")), (b"wtpt", b"XYZ " + bytes(4) + fixed(*D50)), (b"chad", b"sf32" + bytes(4) + fixed(*(x for row in chad for x in row)))]
    values += [(c + b"XYZ", b"XYZ " + bytes(4) + fixed(*(row[i] for row in colorants))) for i, c in enumerate((b"r", b"g", b"b"))]
    values += [(c + b"TRC", curve) for c in (b"r", b"g", b"b")]
    table, body, start = struct.pack(">I", len(values)), b"", 128 + 4 + 12 * len(values)
    placed: dict[bytes, int] = {}
    for name, value in values:
        if value not in placed:
            placed[value] = start + len(body)
            body += value + bytes(-len(value) % 4)
        table += struct.pack(">4sII", name, placed[value], len(value))
    head = struct.pack(">I4sI4s4s4s6H4s28s", start + len(body), b"", 0x04300000, b"mntr", b"RGB ", b"XYZ ", 2000, 1, 1, 0, 0, 0, b"acsp", b"") + fixed(*D50)
    return head.ljust(128, b"\0") + table + body


def embedded(profile: str | OutputProfile) -> bytes:
    """The profile's file: as it was read, or made for a built-in one."""
    return icc_profile({"display_p3": "p3"}.get(profile, profile)) if isinstance(profile, str) else profile.icc


def tiff_bytes(pixels: np.ndarray, depth: str, compression: str = "none", level: str = "balanced", meta: Metadata | None = None, profile: str | bytes | None = None) -> bytes:
    """pixels: (height, width, 3) of the depth's type, encoded to the profile, which is embedded."""
    kind = {"u8": ("<u1", 8, 1), "u16": ("<u2", 16, 1), "f32": ("<f4", 32, 3)}[depth]
    h, w, _ = pixels.shape
    body = pixels.astype(kind[0]).tobytes()
    if compression == "deflate":
        body = zlib.compress(body, DEFLATE[level])
    short = lambda *v: struct.pack(f"<{len(v)}H", *v)
    long = lambda v: struct.pack("<I", v)
    entries = [(256, 4, long(w), 1), (257, 4, long(h), 1), (258, 3, short(*[kind[1]] * 3), 3), (259, 3, short(8 if compression == "deflate" else 1), 1), (262, 3, short(2), 1), (273, 4, long(8), 1), (277, 3, short(3), 1), (278, 4, long(h), 1), (279, 4, long(len(body)), 1), (284, 3, short(1), 1), (339, 3, short(*[kind[2]] * 3), 3)]
    start = 8 + len(body) + len(body) % 2
    body += b"\0" * (len(body) % 2)
    if profile:
        icc = profile if isinstance(profile, bytes) else embedded(profile)
        entries.append((34675, 7, icc, len(icc)))
    if meta:
        for tag, text in ((271, meta.make), (272, meta.model)):
            if text:
                entries.append((tag, 2, text.encode() + b"\0", len(text) + 1))
        entries.append((34665, 4, long(0), 1))
        exif_at = start + len(_ifd(entries, start))
        entries[-1] = (34665, 4, long(exif_at), 1)
        return struct.pack("<2sHI", b"II", 42, start) + body + _ifd(entries, start) + _ifd(exif_entries(meta), exif_at)
    return struct.pack("<2sHI", b"II", 42, start) + body + _ifd(entries, start)


# JPEG example quantisation tables and Huffman code lengths and symbols (ITU T.81 annex K), zigzag left to a rule.
LUMA_Q = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMA_Q = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66] + [99] * 38
DC_LENGTHS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]


def _zigzag() -> np.ndarray:
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_N = np.arange(8)
DCT = np.where(_N[:, None] == 0, 0.5**0.5, 1.0) * 0.5 * np.cos((2 * _N[None] + 1) * _N[:, None] * np.pi / 16)


def _tables(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(q) * scale + 50) // 100, 1, 255) for q in (LUMA_Q, CHROMA_Q)]


def _flat_ac() -> tuple[list[int], list[int]]:
    """A complete-enough AC code for all 162 run/size symbols: common ones 3 to 8 bits, the others 9 to 12."""
    symbols = sorted((run << 4 | size for run in range(16) for size in range(1, 11)), key=lambda s: ((s >> 4) + 2 * (s & 15), s))
    symbols = [0x00, *symbols, 0xF0]
    lengths, at = [0] * 16, 0
    for bits, n in ((3, 2), (4, 4), (5, 5), (6, 6), (7, 8), (8, 10), (9, 12), (10, 20), (12, 95)):
        take = min(n, len(symbols) - at)
        lengths[bits - 1], at = take, at + take
    return lengths, symbols


AC_LENGTHS, AC_SYMBOLS = _flat_ac()


def _codes(lengths: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    out, code, at = {}, 0, 0
    for bits, n in enumerate(lengths, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


DC_CODES, AC_CODES = _codes(DC_LENGTHS, list(range(12))), _codes(AC_LENGTHS, AC_SYMBOLS)


def _blocks(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    h, w = plane.shape
    cells = plane.reshape(h // 8, 8, w // 8, 8).transpose(0, 2, 1, 3) - 128.0
    freq = DCT @ cells @ DCT.T
    return np.rint(freq.reshape(h // 8, w // 8, 64) / table).astype(int)[..., ZIGZAG]


def jpeg_bytes(pixels: np.ndarray, quality: int = 95, subsampling: str = "444", meta: Metadata | None = None, profile: str | bytes | None = None) -> bytes:
    """Baseline JPEG of (height, width, 3) bytes encoded to the profile, which is embedded; chroma is averaged over its area."""
    if not 1 <= quality <= 100 or subsampling not in ("444", "422", "420"):
        raise ContractError("quality is 1 to 100, subsampling 444, 422 or 420")
    h, w, _ = pixels.shape
    if max(h, w) > 65535:
        raise ContractError("a JPEG side has at most 65535 pixels")
    fx, fy = (1 if subsampling == "444" else 2), (2 if subsampling == "420" else 1)
    mh, mw = 8 * fy, 8 * fx
    full = np.pad(pixels.astype(float), ((0, -h % mh), (0, -w % mw), (0, 0)), mode="edge")
    r, g, b = np.moveaxis(full, -1, 0)
    y = 0.299 * r + 0.587 * g + 0.114 * b
    cb, cr = 128 + (b - y) / 1.772, 128 + (r - y) / 1.402
    small = lambda p: p.reshape(p.shape[0] // fy, fy, p.shape[1] // fx, fx).mean((1, 3))
    tables = _tables(quality)
    planes = [_blocks(y, tables[0]), _blocks(small(cb), tables[1]), _blocks(small(cr), tables[1])]
    value, bits, out, last = 0, 0, bytearray(), [0, 0, 0]

    def put(code: int, n: int) -> None:
        nonlocal value, bits
        value, bits = value << n | code, bits + n
        while bits >= 8:
            byte = value >> (bits - 8) & 255
            out.append(byte)
            if byte == 255:
                out.append(0)
            bits -= 8
            value &= (1 << bits) - 1

    def amount(v: int) -> tuple[int, int]:
        size = abs(v).bit_length()
        return size, v if v > 0 else v + (1 << size) - 1

    def block(k: int, z: list[int]) -> None:
        size, extra = amount(z[0] - last[k])
        last[k] = z[0]
        put(*DC_CODES[size])
        put(extra, size)
        run = 0
        end = max((i for i in range(1, 64) if z[i]), default=0)
        for i in range(1, end + 1):
            if not z[i]:
                run += 1
                continue
            while run > 15:
                put(*AC_CODES[0xF0])
                run -= 16
            size, extra = amount(z[i])
            put(*AC_CODES[run << 4 | size])
            put(extra, size)
            run = 0
        if end < 63:
            put(*AC_CODES[0x00])

    for my in range(full.shape[0] // mh):
        for mx in range(full.shape[1] // mw):
            for dy in range(fy):
                for dx in range(fx):
                    block(0, planes[0][my * fy + dy, mx * fx + dx].tolist())
            block(1, planes[1][my, mx].tolist())
            block(2, planes[2][my, mx].tolist())
    if bits:
        put((1 << (8 - bits)) - 1, 8 - bits)
    segment = lambda m, d: bytes([255, m]) + struct.pack(">H", len(d) + 2) + d
    head = b"\xff\xd8"
    if meta:
        head += segment(0xE1, b"Exif\0\0" + struct.pack("<2sHI", b"II", 42, 8) + _ifd(exif_entries(meta), 8))
    if profile:
        head += segment(0xE2, b"ICC_PROFILE\0" + bytes([1, 1]) + (profile if isinstance(profile, bytes) else embedded(profile)))
    for i, t in enumerate(tables):
        head += segment(0xDB, bytes([i]) + bytes(t[ZIGZAG].tolist()))
    head += segment(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, fx << 4 | fy, 0, 2, 0x11, 1, 3, 0x11, 1]))
    head += segment(0xC4, bytes([0]) + bytes(DC_LENGTHS) + bytes(range(12))) + segment(0xC4, bytes([16]) + bytes(AC_LENGTHS) + bytes(AC_SYMBOLS))
    return head + segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])) + bytes(out) + b"\xff\xd9"


STRIP_ROWS = 64


def encode_images(rgb: DataFrame, extent: Extent, kind: str, profile: str | OutputProfile = "srgb", depth: str = "u16", meta: Metadata | None = None, **options) -> DataFrame:
    """image_id, content: an encoded file by image, from linear Rec.2020 pixels.

    Strips of rows are packed first, each in a task of its own; the task that writes a file gets its strips as bytes
    (3 or 6 a pixel)."""
    if kind == "jpeg":
        depth = "u8"
    sample, icc = {"u8": "u1", "u16": "<u2", "f32": "<f4"}[depth], embedded(profile)
    coded = encode_profile(rgb, profile, depth).withColumn("strip", F.expr(f"cast(row div {STRIP_ROWS} as int)"))

    def pack(key, table):
        image, strip = (k.as_py() for k in key)
        top = strip * STRIP_ROWS
        height = min(STRIP_ROWS, extent.height - top)
        if table.num_rows != height * extent.width:
            raise ContractError("pixel count does not fit the extent")
        out = np.empty((height, extent.width, 3), sample)
        at = table["row"].to_numpy() - top, table["col"].to_numpy()
        for k, c in enumerate("rgb"):
            out[(*at, k)] = table[c].to_numpy()
        return pa.table({"image_id": pa.array([image], pa.int64()), "strip": pa.array([strip], pa.int32()), "packed": pa.array([out.tobytes()], pa.binary())})

    def write(key, table):
        order = np.argsort(table["strip"].to_numpy())
        flat = b"".join(table["packed"][int(i)].as_py() for i in order)
        if len(flat) != extent.height * extent.width * 3 * np.dtype(sample).itemsize:
            raise ContractError("pixel count does not fit the extent")
        pixels = np.frombuffer(flat, sample).reshape(extent.height, extent.width, 3)
        content = tiff_bytes(pixels, depth, meta=meta, profile=icc, **options) if kind == "tiff" else jpeg_bytes(pixels, meta=meta, profile=icc, **options)
        return pa.table({"image_id": pa.array([key[0].as_py()], pa.int64()), "content": pa.array([content], pa.binary())})

    strips = coded.groupBy("image_id", "strip").applyInArrow(pack, "image_id long, strip int, packed binary")
    return strips.groupBy("image_id").applyInArrow(write, "image_id long, content binary")


def export(rgb: DataFrame, path: str | None, extent: Extent, kind: str, **options) -> None:
    """Write encoded files as a Parquet table of (image_id, content) under a path that executors share."""
    if not path:
        raise ContractError("no output file chosen")
    encode_images(rgb, extent, kind, **options).write.mode("overwrite").parquet(path)
