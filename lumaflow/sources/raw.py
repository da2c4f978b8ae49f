"""Raw files: uncompressed 16-bit Bayer TIFF/DNG read through Spark's binaryFile source and exploded to pixels.

Headers (extent, filter pattern, levels, as-shot gains, colour matrix, capture data) are read in tasks and are one small
row by image; pixels meet their own image's levels in a join, so files of several cameras may lie under one path.

No camera decoder is part of the runtime, so other layouts raise UnsupportedRaw; files that cannot be
parsed raise as well, in the task that reads them. A file is one row of the scan, so its bytes are one task's."""

from __future__ import annotations

import atexit
import re
import shutil
import struct
import tempfile
import uuid
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaflow.functions.exprs import by_site
from lumaflow.model import Calibration, ContractError, Metadata

# Accepted file extensions.
EXTENSIONS = "arw cr2 cr3 dng erf fff iiq kdc mef mos mrw nef nrw orf pef raf raw rw2 rwl srw x3f".split()
# Tags of TIFF, DNG and EXIF, and the sizes of their kinds of values.
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, COUNTS, CFA, BLACK, WHITE = 256, 257, 258, 259, 273, 279, 33422, 50714, 50717
MAKE, MODEL, ORIENTATION, DATETIME, SUB_FILES, EXIF, BLACK_SHAPE, MATRIX, NEUTRAL = 271, 272, 274, 306, 330, 34665, 50713, 50721, 50728
SHUTTER, APERTURE, ISO, FOCAL = 33434, 33437, 34855, 37386
_SIZES = {1: ("B", 1), 2: ("B", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 7: ("B", 1), 10: ("ii", 8), 13: ("I", 4)}


class UnsupportedRaw(ValueError):
    """A file of a kind that the reader does not know (as against one that cannot be read)."""


def read_tags(data: bytes, at: int | None = None) -> tuple[str, dict[int, tuple]]:
    """Byte order and tags of a file's first directory, or of the one at a place. Fractions stay pairs of numbers."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise UnsupportedRaw("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0] if at is None else at
    tags = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in _SIZES:
            continue
        code, size = _SIZES[kind]
        place = at + 10 + 12 * i if n * size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        tags[tag] = struct.unpack_from(order + code * n, data, place)
    return order, tags


def _ratios(values: tuple) -> list[float]:
    return [a / b if b else 0.0 for a, b in zip(values[::2], values[1::2], strict=True)]


def _text(values: tuple) -> str:
    return bytes(values).split(b"\0")[0].decode("latin-1").strip()


def bayer_tags(data: bytes) -> tuple[str, dict[int, tuple], dict[int, tuple]]:
    """Byte order, the tags of the directory that has the mosaic, and those of the whole file."""
    order, top = read_tags(data)
    for tags in (top, *(read_tags(data, at)[1] for at in top.get(SUB_FILES, ()))):
        if len(tags.get(CFA, ())) == 4 and tags.get(BITS, (0,))[0] == 16 and tags.get(COMPRESSION, (1,))[0] == 1:
            return order, tags, top
    raise UnsupportedRaw("only uncompressed 16-bit Bayer data is read")


HEADER = (
    "width int, height int, cfa array<int>, black array<double>, white double, make string, model string, orientation int, as_shot array<double>, "
    "xyz_to_cam array<double>, iso double, shutter double, aperture double, focal_length double, datetime string"
)


def read_header(data: bytes) -> dict:
    """What a file says about itself: levels by site, gains that make its neutral white, XYZ to camera by rows."""
    _, tags, top = bayer_tags(data)
    shape, black = tags.get(BLACK_SHAPE, (1, 1)), tags.get(BLACK, (0,))
    if shape[0] * shape[1] != len(black):  # kept as fractions
        black = _ratios(black)
    if shape not in ((1, 1), (2, 2)) or len(black) != shape[0] * shape[1]:
        raise UnsupportedRaw("black levels of another pattern than one or 2 x 2 values")
    neutral, matrix = _ratios(top.get(NEUTRAL, ())), _ratios(top.get(MATRIX, ()))
    exif = read_tags(data, top[EXIF][0])[1] if EXIF in top else top
    one = lambda tag: (_ratios(exif[tag]) or [0.0])[0] if tag in exif else 0.0
    return {
        "width": tags[WIDTH][0], "height": tags[HEIGHT][0], "cfa": list(tags[CFA]), "black": [float(x) for x in (black * 4 if len(black) == 1 else black)], "white": float(tags.get(WHITE, (65535,))[0]),
        "make": _text(top.get(MAKE, ())), "model": _text(top.get(MODEL, ())), "orientation": o if (o := top.get(ORIENTATION, (1,))[0]) in range(1, 9) else 1,
        "as_shot": [neutral[1] / x for x in neutral] if len(neutral) == 3 and min(neutral) > 0 else [1.0, 1.0, 1.0],
        "xyz_to_cam": matrix if len(matrix) == 9 else [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0],
        "iso": float(exif.get(ISO, (0,))[0]), "shutter": one(SHUTTER), "aperture": one(APERTURE), "focal_length": one(FOCAL), "datetime": _text(top.get(DATETIME, ())),
    }


def decode(data: bytes) -> np.ndarray:
    """Codes, rows by columns."""
    order, tags, _ = bayer_tags(data)
    width, height = tags[WIDTH][0], tags[HEIGHT][0]
    codes = np.frombuffer(b"".join(data[a : a + n] for a, n in zip(tags[STRIPS], tags[COUNTS], strict=True)), order + "u2")
    if len(codes) != width * height:
        raise ValueError("sample data is cut short")
    return codes.reshape(height, width).astype(np.int32)


def raw_files(spark: SparkSession, path: str | None) -> DataFrame:
    """path, content of the raw files under a path."""
    if not path:
        raise ValueError("the raw source has no file to read")
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.where(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(EXTENSIONS))


def read_headers(spark: SparkSession, path: str | None) -> DataFrame:
    """image_id (hash of the path), path and header of every file under a path; one row by image."""
    names = ["path", *(c.split()[0] for c in HEADER.split(", "))]

    def run(batches):
        for batch in batches:
            rows = [read_header(content) for content in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pylist([{"path": p} | r for p, r in zip(batch.column(0).to_pylist(), rows, strict=True)], schema=kinds)

    whole, part, text = pa.float64(), pa.int32(), pa.string()
    kinds = pa.schema(list(zip(names, [text, part, part, pa.list_(part), pa.list_(whole), whole, text, text, part, pa.list_(whole), pa.list_(whole), whole, whole, whole, whole, text], strict=True)))
    return raw_files(spark, path).mapInArrow(run, f"path string, {HEADER}").select(F.xxhash64("path").alias("image_id"), "*")


def scan_raw(spark: SparkSession, path: str | None) -> DataFrame:
    """image_id (hash of the path), path, row, col, code of every file under a path."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                codes = decode(content)
                h, w = codes.shape
                step = max(1, 65536 // w)
                for top in range(0, h, step):
                    part = codes[top : top + step]
                    row, col = np.divmod(np.arange(part.size, dtype=np.int32), np.int32(w))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array(row + np.int32(top)), pa.array(col), pa.array(part.ravel())], ["path", "row", "col", "code"])

    return raw_files(spark, path).mapInArrow(run, "path string, row int, col int, code int").select(F.xxhash64("path").alias("image_id"), "*")


def normalize_each(codes: DataFrame, headers: DataFrame) -> DataFrame:
    """Codes to samples by each image's own levels: (code - black of the site) / (white - least black).

    Headers are one row by image; Spark broadcasts them only while they are small."""
    levels = headers.select("image_id", "black", "white", (F.col("white") - F.array_min("black")).alias("range"))
    black = by_site([F.element_at("black", i) for i in range(1, 5)], F.col("row"), F.col("col"))
    return codes.join(levels, "image_id").select("image_id", "row", "col", ((F.col("code") - black) / F.col("range")).alias("v"))


def gains_each(headers: DataFrame) -> DataFrame:
    """image_id and as-shot gains by site, for images of several cameras in one plan."""
    return headers.select("image_id", F.transform("cfa", lambda c: F.element_at(F.col("as_shot"), c + 1)).alias("gains"))


def common_metadata(headers: DataFrame) -> tuple[Metadata, int, int]:
    """What all images under a path share: metadata of the first, width and height. Another extent or filter pattern is an error."""
    kinds = headers.groupBy("width", "height", "cfa").agg(F.min(F.struct("path", *[c for c in headers.columns if c != "path"])).alias("first")).limit(2).collect()
    if not kinds:
        raise ContractError("no raw file under this path")
    if len(kinds) > 1:
        raise ContractError("raw files of different extents or filter patterns: give each kind a source of its own")
    h = kinds[0]["first"]
    if h["white"] <= min(h["black"]):
        raise ContractError("white level must lie above the black level")
    cfa, m = h["cfa"], h["xyz_to_cam"]
    low = int(min(h["black"]))
    pattern = (2, 2, tuple(x - low for x in h["black"])) if len(set(h["black"])) > 1 else (0, 0, ())
    calibration = Calibration(cfa=((cfa[0], cfa[1]), (cfa[2], cfa[3])), black=low, pattern=pattern, maximum=h["white"], xyz_to_cam=(tuple(m[:3]), tuple(m[3:6]), tuple(m[6:]), (0.0, 0.0, 0.0)), as_shot=(*h["as_shot"], 0.0))
    capture = {k: h[k] for k in ("make", "model", "iso", "shutter", "aperture", "focal_length", "datetime", "orientation")}
    return Metadata(**capture, calibration=calibration), h["width"], h["height"]


def read_tiff(files: DataFrame) -> DataFrame:
    """image_id, row, col, r, g, b of little-endian 16-bit RGB files (image_id, content), plain or deflated."""

    def run(batches):
        for batch in batches:
            for image, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                order, tags = read_tags(content)
                body = b"".join(content[a : a + n] if tags[COMPRESSION][0] == 1 else zlib.decompress(content[a : a + n]) for a, n in zip(tags[STRIPS], tags[COUNTS], strict=True))
                pixels = np.frombuffer(body, order + "u2").reshape(-1, 3).astype(np.int32)
                row, col = np.divmod(np.arange(len(pixels), dtype=np.int32), np.int32(tags[WIDTH][0]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pixels), image)), pa.array(row), pa.array(col), *[pa.array(pixels[:, k].copy()) for k in range(3)]], ["image_id", "row", "col", "r", "g", "b"])

    return files.select("image_id", "content").mapInArrow(run, "image_id long, row int, col int, r int, g int, b int")


def write_dng(codes: np.ndarray, pattern=((0, 1), (1, 2)), black=0, white: int = 65535, make: str = "", model: str = "", orientation: int = 1, neutral=None, matrix=None) -> bytes:
    """An uncompressed Bayer DNG, little-endian; black: one level or four by site."""
    h, w = codes.shape
    body = codes.astype("<u2").tobytes()
    ratios = lambda values, kind: b"".join(struct.pack(kind, f.numerator, f.denominator) for f in (Fraction(v).limit_denominator(1_000_000) for v in values))
    long = lambda *v: struct.pack(f"<{len(v)}I", *v)
    short = lambda *v: struct.pack(f"<{len(v)}H", *v)
    levels = tuple(black) if isinstance(black, (tuple, list)) else (black,)
    entries = {
        WIDTH: (4, 1, long(w)), HEIGHT: (4, 1, long(h)), BITS: (3, 1, short(16)), COMPRESSION: (3, 1, short(1)), 262: (3, 1, short(32803)), STRIPS: (4, 1, long(8)), ORIENTATION: (3, 1, short(orientation)),
        277: (3, 1, short(1)), 278: (4, 1, long(h)), COUNTS: (4, 1, long(len(body))), CFA: (1, 4, bytes(pattern[0]) + bytes(pattern[1])), BLACK: (4, len(levels), long(*levels)), WHITE: (4, 1, long(white)),
    }
    entries |= {tag: (2, len(text) + 1, text.encode("latin-1") + b"\0") for tag, text in ((MAKE, make), (MODEL, model)) if text}
    if len(levels) == 4:
        entries[BLACK_SHAPE] = (3, 2, short(2, 2))
    if neutral:
        entries[NEUTRAL] = (5, 3, ratios(neutral, "<II"))
    if matrix:
        entries[MATRIX] = (10, 9, ratios(matrix, "<ii"))
    at = 8 + len(body)
    place, ifd, extra = at + 2 + 12 * len(entries) + 4, struct.pack("<H", len(entries)), b""
    for tag, (kind, n, raw) in sorted(entries.items()):
        ifd += struct.pack("<HHI", tag, kind, n) + (raw.ljust(4, b"\0") if len(raw) <= 4 else long(place + len(extra)))
        extra += raw + bytes(len(raw) % 2) if len(raw) > 4 else b""
    return struct.pack("<2sHI", b"II", 42, at) + body + ifd + long(0) + extra


def write_files(spark: SparkSession, files: dict[str, bytes]) -> str:
    """Write a few small files into a new folder that all executors share (spark.checkpoint.dir; where it is unset, in
    local mode alone, a folder for temporary files); returns the folder."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="lumaflow-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        place = "file://" + own
    folder = f"{place.rstrip('/')}/raw-{uuid.uuid4().hex}"
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for name, content in files.items():
        out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
        out.write(bytearray(content))
        out.close()
    return folder
