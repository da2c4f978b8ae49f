import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumaflow.functions import color, profiles
from lumaflow.model import REC2020_D65, Calibration, Camera, ContractError, Extent, Metadata, Phase
from lumaflow.operators import demosaic, highlights, pointwise, reduce, scopes
from lumaflow.sinks import encode
from lumaflow.sources import rasters, raw
from lumaflow.sources.jpeg import read_jpeg

CAMERA = Camera("", "")


def mosaic(spark, values, width):
    return rasters.bound_mosaic(spark, values, Extent(width, len(values) // width), Phase.RGGB, CAMERA).data


def image(spark, pixels, width):
    return rasters.bound_rgb(spark, pixels, Extent(width, len(pixels) // width), REC2020_D65).data


def grid(df, *names):
    rows = df.orderBy("row", "col").select(*names).collect()
    return [tuple(r) if len(names) > 1 else r[0] for r in rows]


def test_normalize_raw(spark):
    c = Calibration(cfa=((0, 1), (3, 2)), black=100, channel_black=(10, 20, 30, 40), pattern=(1, 2, (5, 7)), maximum=1100)
    codes = spark.range(6).selectExpr("0L as image_id", "cast(id div 3 as int) as row", "cast(id % 3 as int) as col", "600 as code")
    v = grid(pointwise.normalize_raw(codes, c), "v")
    assert v[0] == pytest.approx(485 / 985, abs=1e-12) and v[3] == pytest.approx(455 / 985, abs=1e-12)


def test_site_gains(spark):
    c = Calibration(cfa=((0, 1), (3, 2)), channel_black=(0, 0, 0, 500), maximum=1000, as_shot=(2.0, 1.0, 4.0, 3.0))
    assert pointwise.site_gains(c) == (2.0, 1.0, 3.0, 4.0)
    out = grid(pointwise.apply_site_gains(mosaic(spark, [-1, 0, 0.5, 1, 2, 3, 4, 5, 6], 3), pointwise.site_gains(c)), "v")
    assert out == [-2, 0, 1, 3, 8, 9, 8, 5, 12]


def test_image_gains_keep_images_without_any(spark):
    both = mosaic(spark, [1, 2, 3, 4], 2).crossJoin(spark.range(3).withColumnRenamed("id", "image")).drop("image_id").withColumnRenamed("image", "image_id")
    meta = spark.createDataFrame([(0, [2.0, 3.0, 4.0, 5.0]), (2, None)], "image_id long, gains array<double>")
    got = pointwise.apply_image_gains(both, meta)
    assert "gains" not in got.columns
    assert [grid(got.where(F.col("image_id") == i), "v") for i in range(3)] == [[2, 6, 12, 20], [1, 2, 3, 4], [1, 2, 3, 4]]


def test_reduce_bayer(spark):
    assert grid(reduce.reduce_bayer(mosaic(spark, range(16), 4), 2, Extent(4, 4)), "v") == [5, 6, 9, 10]
    assert reduce.bayer_extent(Extent(5, 7), 1) == Extent(5, 7)
    with pytest.raises(ContractError):
        reduce.bayer_extent(Extent(1, 9), 2)


@pytest.mark.parametrize("width,height,f", [(5, 3, 2), (1, 7, 3), (9, 1, 4), (3, 2, 256), (3, 2, 1)])
def test_reduce_rgb(spark, width, height, f):
    a = np.arange(width * height * 3, dtype=float).reshape(height, width, 3)
    got = np.array(grid(reduce.reduce_rgb(image(spark, a.reshape(-1, 3).tolist(), width), f), "r", "g", "b"))
    want = [a[y : y + f, x : x + f].reshape(-1, 3).mean(0) for y in range(0, height, f) for x in range(0, width, f)]
    assert np.allclose(got, want)


def test_reduce_rgb_not_finite(spark):
    got = grid(reduce.reduce_rgb(image(spark, [(math.nan, math.inf, 1.7e308), (1, 1, 1.7e308)], 2), 2), "r", "g")[0]
    assert math.isnan(got[0]) and got[1] == math.inf


def test_demosaic_2x2_drops_incomplete_cells(spark):
    out = grid(demosaic.demosaic_2x2(mosaic(spark, [1, 2, 9, 3, 4, 9, 9, 9, 9], 3), Phase.RGGB, Extent(3, 3)), "r", "g", "b")
    assert out == [(1, 2.5, 4)]


ORIENTED = {1: [0, 1, 2, 3, 4, 5], 2: [2, 1, 0, 5, 4, 3], 3: [5, 4, 3, 2, 1, 0], 4: [3, 4, 5, 0, 1, 2], 5: [0, 3, 1, 4, 2, 5], 6: [3, 0, 4, 1, 5, 2], 7: [5, 2, 4, 1, 3, 0], 8: [2, 5, 1, 4, 0, 3]}


@pytest.mark.parametrize("o", range(1, 9))
def test_orientation(spark, o):
    assert grid(pointwise.orient(mosaic(spark, range(6), 3), o, 3, 2), "v") == ORIENTED[o]


def test_exposure_and_limits(spark):
    assert grid(pointwise.exposure(image(spark, [(1, -2, 0.5)], 1), 1.0), "r", "g", "b") == [(2, -4, 1)]
    for bad in (math.nan, math.inf, 200.0, -200.0):
        with pytest.raises(ContractError):
            pointwise.check_ev(bad)


def test_sigmoid_invariants(spark):
    out = grid(pointwise.sigmoid(image(spark, [(0, 0, 0), (0.18,) * 3, (1,) * 3, (3e38,) * 3, (-0.2, 0.1, 0.5)], 5)), "r", "g", "b")
    assert max(map(abs, out[0])) < 1e-9
    assert all(abs(x - 0.18) < 1e-5 for x in out[1]) and all(abs(x - 1) < 1e-5 for x in out[3])
    assert all(math.isfinite(x) for p in out for x in p)


def hue(work, mapped, h):
    """The hue correction on its own, in plain Python."""
    lo, mid, hi = sorted(range(3), key=lambda i: work[i])
    f = (work[mid] - work[lo]) / (work[hi] - work[lo]) if work[hi] > work[lo] else 0
    naive = (1 - h) * mapped[mid] + h * (mapped[lo] + (mapped[hi] - mapped[lo]) * f)
    blend = 2 * work[lo] / (work[lo] + work[mid]) if work[lo] + work[mid] else 0
    energy = blend * sum(mapped) + (1 - blend) * (mapped[lo] + naive + mapped[hi])
    out = list(mapped)
    if naive <= mapped[mid]:
        out[mid] = ((1 - h) * mapped[mid] + h * (f * mapped[hi] + (1 - f) * (energy - mapped[hi]))) / (1 + h * (1 - f))
        out[lo] = energy - mapped[hi] - out[mid]
    else:
        out[mid] = ((1 - h) * mapped[mid] + h * (mapped[lo] * (1 - f) + f * (energy - mapped[lo]))) / (1 + h * f)
        out[hi] = energy - mapped[lo] - out[mid]
    return out


@pytest.mark.parametrize("h", [0.0, 0.5, 1.0])
def test_sigmoid_against_python(spark, h):
    from lumaflow.functions import color

    k = color.sigmoid_coefficients(1.5, -0.2)
    pixels = [(0.1, 0.4, 0.9), (0.9, 0.1, 0.4), (0.4, 0.9, 0.1), (0.3, 0.3, 2.0), (-0.1, 0.5, 0.2)]
    want = []
    for p in pixels:
        average, low = max(sum(p) / 3, 0), min(p)
        calm = [max(average + average / (average - low) * (c - average), 0) for c in p] if low < 0 else p
        work = color.apply(k["inset"], calm)
        want.append(color.apply(k["outset"], hue(work, [color.sigmoid_curve(w, k) for w in work], h)))
    got = grid(pointwise.sigmoid(image(spark, pixels, 5), preserve_hue=h), "r", "g", "b")
    assert np.allclose(got, want, atol=1e-12)


def test_proofing(spark):
    pixels = [(0, 0, 0), (0.18,) * 3, (1, 1, 1), (0, 1, 0)]
    for p in ("srgb", "p3", "rec2020"):
        out = grid(pointwise.gamut_check(image(spark, pixels, 4), p), "r", "g", "b")
        assert (out[3] == (0.0, 1.0, 1.0)) == (p != "rec2020")
        assert np.allclose(out[:3], pixels[:3], atol=1e-9)
    soft = grid(pointwise.soft_proof(image(spark, [(2.0,) * 3, (-0.1,) * 3], 2), "srgb"), "r", "g", "b")
    assert np.allclose(soft, [(1, 1, 1), (0, 0, 0)], atol=1e-9)
    grey = grid(pointwise.encode_profile(image(spark, [(0.18,) * 3], 1), "srgb", "u8"), "r")
    assert grey == [round((1.055 * 0.18 ** (1 / 2.4) - 0.055) * 255)]


def test_histogram(spark):
    df = scopes.histogram(image(spark, [(0.18, 0, -1), (0.09, 1e6, 0.36)], 2))
    n = {(r["bin"], r["channel"]): r["n"] for r in df.collect()}
    assert len(n) == 768 and sum(n.values()) == 6
    assert [n[0, c] for c in range(3)] == [0, 1, 1] and [n[255, c] for c in range(3)] == [0, 1, 0]


def test_histogram_edges(spark):
    edges = scopes.bin_edges(-12.0, 4.0)
    values = [x for e in edges for x in (np.nextafter(e, 0), e, np.nextafter(e, 1e9))] + [math.nan, math.inf, -math.inf, 0.0, -1.0, 1.7e308]
    df = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", scopes.level_bin(F.col("v"), -12.0, 4.0).alias("bin"))
    for v, b in df.collect():
        assert b == max(0 if math.isnan(v) else sum(e <= v for e in edges), 1) - 1, v


def test_waveform(spark):
    df = scopes.waveform(image(spark, [(1e9, 1e-9, 0.5), (1, 1, 1), (1e9, 1e-9, 0.5), (1, 1, 1)], 2), Extent(2, 2))
    n = {(r["channel"], r["y"], r["x"]): r["n"] for r in df.where("n > 0").collect()}
    assert n[0, 0, 0] == 2 and n[1, 255, 0] == 2 and n[2, 255 - 176, 0] == 2
    assert all(n[c, 255 - 192, 128] == 2 for c in range(3))


def test_vectorscope(spark):
    pixels = [(0.18,) * 3] * 400 + [(0, 0, 0), (-1, -1, -1), (1, -0.2, 0), (4, 0, 0)]
    n = {(r["y"], r["x"]): r["n"] for r in scopes.vectorscope(image(spark, pixels, len(pixels))).where("n > 0").collect()}
    assert sum(n.values()) == 402 and n[128, 128] == 400 and sorted(n.values()) == [2, 400]
    assert scopes.white_uv() == pytest.approx((0.197830, 0.468320), abs=1e-6)


def test_auto_exposure(spark):
    row = scopes.auto_exposure(image(spark, [(g,) * 3 for g in (0, 0.045, 0.09)], 3)).first()
    assert row["ev"] == pytest.approx(2, abs=1e-6)
    row = scopes.auto_exposure(image(spark, [(0.5, 0, 0), (0, 0.1, 0), (0, 0, 8), (-0.01,) * 3], 4)).first()
    assert row["ev"] == pytest.approx(math.log2(0.18 / ((0.262700212 * 0.5 + 0.677998072 * 0.1 + 0.059301716 * 8 - 0.01) / 4)), abs=1e-6)
    assert scopes.auto_exposure(image(spark, [(0, 0, 0)], 1)).first()["ev"] is None


def test_density(spark):
    df = scopes.density(scopes.histogram(image(spark, [(1, 1, 1)] * 3, 3)), True)
    assert df.agg(F.max("density")).first()[0] == 1


# ---- highlights -------------------------------------------------------------------------------


def opposed(a, phase, levels, threshold=0.98):
    """Slow reconstruction of one image in numpy."""
    h, w = a.shape
    c = demosaic.colors(h, w, phase)
    clip = np.array([[levels[(y % 2) * 2 + x % 2] * threshold for x in range(w)] for y in range(h)])
    hot = a >= clip
    mh, mw = -(-h // 3), -(-w // 3)
    mask = np.zeros((mh, mw), int)
    for y, x in zip(*np.nonzero(hot), strict=True):
        mask[y // 3, x // 3] |= 1 << c[y, x]
    near = np.zeros_like(mask)
    for y in range(mh):
        for x in range(mw):
            for dy in range(-3, 4):
                for dx in range(-3, 4):
                    if abs(dy) + abs(dx) < 6 and 0 <= y + dy < mh and 0 <= x + dx < mw:
                        near[y, x] |= mask[y + dy, x + dx]
    ref = np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            cells = [(c[j, i], max(a[j, i], 0)) for j in range(max(y - 1, 0), min(y + 2, h)) for i in range(max(x - 1, 0), min(x + 2, w))]
            mean = [sum(v for k, v in cells if k == q) / max(sum(k == q for k, _ in cells), 1) for q in range(3)]
            ref[y, x] = (0.5 * sum(mean[q] ** (1 / 3) for q in range(3) if q != c[y, x])) ** 3
    chroma = []
    for q in range(3):
        pick = (c == q) & (a > 0.2 * clip) & (a < clip) & ((near.repeat(3, 0).repeat(3, 1)[:h, :w] >> q & 1) == 1)
        chroma.append((a - ref)[pick].mean() if pick.sum() > 100 else 0)
    return np.where(hot, np.maximum(a, ref + np.array(chroma)[c]), a)


@pytest.mark.parametrize("phase", list(Phase))
@pytest.mark.parametrize("shape", [(1, 1), (5, 1), (7, 5), (30, 36)])
def test_highlights(spark, phase, shape):
    h, w = shape
    r, c = np.mgrid[0:h, 0:w]
    a = 0.35 + ((r * 13 + c * 7) % 31) / 100
    a[h // 3 : h // 2 + 1, w // 3 : w // 2 + 2] = 1.0
    levels = (1.3, 1.0, 1.0, 1.7)
    a = a * np.array(levels)[(r % 2) * 2 + c % 2]
    got = grid(highlights.highlights_opposed(mosaic(spark, a.ravel().tolist(), w), levels, phase, Extent(w, h)), "v")
    assert np.allclose(np.array(got).reshape(h, w), opposed(a, phase, levels), atol=1e-9)


def test_highlights_with_levels_by_image(spark):
    """Two cameras in one plan give what each gives in a plan of its own."""
    h, w = 60, 48
    r, c = np.mgrid[0:h, 0:w]
    a = 0.35 + ((r * 13 + c * 7) % 31) / 100
    a[20:32, 16:26] = 1.0
    both, alone = [], []
    for i, levels in enumerate([(1.3, 1.0, 1.0, 1.7), (1.0, 1.2, 1.1, 1.0)]):
        own = mosaic(spark, (a * np.array(levels)[(r % 2) * 2 + c % 2]).ravel().tolist(), w).withColumn("image_id", F.lit(i).cast("long"))
        both.append(own)
        alone.append(grid(highlights.highlights_opposed(own, levels, Phase.RGGB, Extent(w, h)), "v"))
    levels = spark.createDataFrame([(0, [1.3, 1.0, 1.0, 1.7]), (1, [1.0, 1.2, 1.1, 1.0])], "image_id long, levels array<double>")
    got = highlights.highlights_opposed(both[0].union(both[1]), levels, Phase.RGGB, Extent(w, h))
    assert [grid(got.where(F.col("image_id") == i), "v") for i in (0, 1)] == alone


def test_highlights_leave_unclipped_images(spark):
    a = [0.1, 0.97, -0.5, 0.0]
    assert grid(highlights.highlights_opposed(mosaic(spark, a, 2), (1.0,) * 4, Phase.RGGB, Extent(2, 2)), "v") == a
    with pytest.raises(ContractError):
        highlights.check_threshold(0)


# ---- rcd --------------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", [(1, 1), (3, 2), (9, 11)])
def test_rcd_small(spark, shape):
    h, w = shape
    out = grid(demosaic.demosaic_rcd(mosaic(spark, np.linspace(-0.1, 1, h * w).tolist(), w), Phase.GRBG, Extent(w, h)), "r", "g", "b")
    assert len(out) == h * w and np.isfinite(out).all() and np.min(out) >= 0


@pytest.mark.parametrize("phase", list(Phase))
def test_rcd_flat_and_tiles(spark, phase):
    flat = demosaic.rcd_tile(np.full((40, 44), 0.5), phase, 0, 0, 40, 44)
    assert np.allclose(flat, 0.5, atol=1e-9)
    i = np.arange(90 * 70).reshape(70, 90)
    a = ((i * 137 + i // 90 * 29) % 2048) / 1024 - 0.03
    whole = demosaic.rcd_tile(a, phase, 0, 0, 70, 90)
    got = np.array(grid(demosaic.demosaic_rcd(mosaic(spark, a.ravel().tolist(), 90), phase, Extent(90, 70), tile=32), "r", "g", "b")).reshape(70, 90, 3)
    assert np.allclose(got, whole, atol=1e-12)


# ---- files ------------------------------------------------------------------------------------


def test_tiff_round_trip():
    import zlib

    p = np.arange(60).reshape(4, 5, 3)
    data = encode.tiff_bytes(p, "u16", "deflate")
    _, tags = raw.read_tags(data)
    body = zlib.decompress(data[tags[273][0] : tags[273][0] + tags[279][0]])
    assert (np.frombuffer(body, "<u2").reshape(4, 5, 3) == p).all() and tags[256] == (5,) and tags[257] == (4,)


@pytest.mark.parametrize("x,want", [(0.5, (1, 2)), (1 / 125, (1, 125)), (2.8, (14, 5)), (0, (0, 1)), (50, (50, 1))])
def test_rational(x, want):
    assert encode.rational(x) == want


@pytest.mark.parametrize("subsampling", ["444", "422", "420"])
def test_jpeg_structure(subsampling):
    data = encode.jpeg_bytes(np.full((11, 17, 3), 118, np.uint8), 95, subsampling)
    assert np.abs(read_jpeg(data) - 118).max() <= 1
    y, x = np.mgrid[0:24, 0:40]
    smooth = np.stack([y * 5 + x, 200 - x * 3, 60 + y * 2 + x * 2], -1).astype(np.uint8)
    assert np.abs(read_jpeg(encode.jpeg_bytes(smooth, 95, subsampling)) - smooth).max() <= (4 if subsampling == "444" else 12)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9" and b"\xff\xc0" in data
    assert sum(n * 2.0**-b for b, n in enumerate(encode.AC_LENGTHS, 1)) < 1 and sum(encode.AC_LENGTHS) == 162
    assert len(set(encode.AC_SYMBOLS)) == 162


def icc_tags(data):
    import struct

    size, version, kind, space, pcs, mark = struct.unpack_from(">I4xI4s4s4s12x4s", data)
    assert (size, kind, space, pcs, mark) == (len(data), b"mntr", b"RGB ", b"XYZ ", b"acsp") and version >> 24 == 4
    rows = [struct.unpack_from(">4sII", data, 132 + 12 * i) for i in range(struct.unpack_from(">I", data, 128)[0])]
    return {name: data[at : at + n] for name, at, n in rows}


@pytest.mark.parametrize("profile", ["srgb", "p3", "rec2020"])
def test_exports_embed_their_profile(spark, profile):
    import struct

    rgb = image(spark, [(0.1, 0.2, 0.3)] * 6, 3)
    tiff, jpeg = (bytes(encode.encode_images(rgb, Extent(3, 2), kind, profile, meta=Metadata(make="Maker", iso=100)).first()["content"]) for kind in ("tiff", "jpeg"))
    icc = bytes(raw.read_tags(tiff)[1][34675])
    mark = jpeg.index(b"\xff\xe2")
    size = struct.unpack_from(">H", jpeg, mark + 2)[0]
    assert jpeg[mark + 4 : mark + 18] == b"ICC_PROFILE\0\1\1" and jpeg[mark + 18 : mark + 2 + size] == icc
    assert read_jpeg(jpeg).shape == (2, 3, 3)
    tags = icc_tags(icc)
    fixed = lambda b: np.frombuffer(b, ">i4") / 65536
    colorants = np.array([fixed(tags[c + b"XYZ"][8:]) for c in (b"r", b"g", b"b")])
    assert np.allclose(colorants.sum(0), (0.9642, 1, 0.8249), atol=1e-4)
    if profile == "srgb":  # the published colorants of sRGB on D50
        assert np.allclose(colorants, [(0.4361, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7141)], atol=3e-4)
    assert tags[b"rTRC"][:4] == b"para" and np.allclose(fixed(tags[b"rTRC"][12:]), color.PROFILES[profile][1], atol=1e-5)


def icc_file(curve: bytes, primaries=color.P3, version: int = 4, white=None) -> bytes:
    """A built-in profile's file with another curve, version or media white."""
    data = bytearray(encode.icc_profile({color.P3: "p3", color.REC709: "srgb"}[primaries]))
    data[8] = version
    n = int.from_bytes(data[128:132], "big")
    at = len(data)
    for i in range(n):
        place = 132 + 12 * i
        if data[place + 1 : place + 4] == b"TRC":
            data[place + 4 : place + 12] = at.to_bytes(4, "big") + len(curve).to_bytes(4, "big")
        if white and data[place : place + 4] == b"wtpt":
            where = int.from_bytes(data[place + 4 : place + 8], "big") + 8
            data[where : where + 12] = b"".join(round(x * 65536).to_bytes(4, "big") for x in white)
    return bytes(data) + curve


GAMMA = b"curv" + bytes(4) + (1).to_bytes(4, "big") + (563).to_bytes(2, "big")
TABLE = b"curv" + bytes(4) + (257).to_bytes(4, "big") + b"".join(round(65535 * (i / 256) ** 2).to_bytes(2, "big") for i in range(257))
LIFTED = b"para" + bytes(4) + (4).to_bytes(2, "big") + bytes(2) + b"".join(round(x * 65536).to_bytes(4, "big") for x in (2.0, 0.9, 0.1, 0.0, 0.0, 0.0, 0.0))


@pytest.mark.parametrize("intent", profiles.INTENTS)
@pytest.mark.parametrize("curve", [GAMMA, TABLE, LIFTED, None], ids=["gamma", "table", "lifted", "own"])
@pytest.mark.parametrize("compensate", [True, False])
def test_profile_files(spark, tmp_path, intent, curve, compensate):
    """A proof shows what an export holds: decoded, it is the proof's clipped device value (plain Python on both ways)."""
    data = icc_file(curve) if curve else encode.icc_profile("p3")
    (tmp_path / "own.icc").write_bytes(data)
    p = profiles.load(spark, {"file": {"path": str(tmp_path / "own.icc")}}, intent, compensate)
    assert p.icc == data and (curve is LIFTED or np.allclose(p.to_device, color.to_profile("p3"), atol=2e-4))
    rgb = [(0.0, 0.0, 0.0), (0.18, 0.2, 0.3), (0.9, 0.05, 0.4), (1.4, -0.2, 0.5), (1.0, 1.0, 1.0)]
    coded = grid(pointwise.encode_profile(image(spark, rgb, 5), p, "u16"), "r", "g", "b")
    proof = grid(pointwise.soft_proof(image(spark, rgb, 5), p), "r", "g", "b")
    lin = [[k.linear(x / 65535) for x, k in zip(c, p.curves, strict=True)] for c in coded]
    assert np.allclose([color.apply(p.back, v) for v in lin], proof, atol=2e-4)
    if curve is LIFTED:  # black is 0.1 ** 2 = 0.01: compensation lifts to it, without it 0 is out of reach and clipped to it
        lifted = intent != "absolute" and (compensate or intent != "relative")
        assert p.black == pytest.approx(0.01 if lifted else 0.0, abs=1e-4)
        assert np.allclose(proof[0], 0.01, atol=1e-3)


def test_absolute_intent_keeps_the_media_white(spark):
    data = icc_file(GAMMA, white=(0.9, 0.95, 0.75))
    relative, absolute = (profiles.parse_icc(data, i) for i in ("relative", "absolute"))
    ratio = np.array(color.apply(absolute.to_device, (1, 1, 1))) / color.apply(relative.to_device, (1, 1, 1))
    assert not np.allclose(ratio, 1, atol=0.01)
    assert np.allclose(profiles.parse_icc(icc_file(GAMMA, version=2, white=(0.9, 0.95, 0.75)), "absolute").to_device, relative.to_device)  # version 2 displays


def test_profiles_that_cannot_be_used(spark, tmp_path):
    good = encode.icc_profile("srgb")
    for bad in (b"", good[:40], good.replace(b"acsp", b"xxxx"), good.replace(b"RGB ", b"CMYK"), good.replace(b"mntr", b"link"), good.replace(b"rTRC", b"rXXX")):
        with pytest.raises(ContractError):
            profiles.parse_icc(bad)
    with pytest.raises(profiles.UnsupportedProfile):
        profiles.parse_icc(good.replace(b"cprt", b"B2A0"))
    with pytest.raises(ContractError):
        profiles.load(spark, "srgb", "vivid")


def test_tiff_of_floats(spark):
    files = encode.encode_images(image(spark, [(0.5, 0.25, -0.1)] * 6, 3), Extent(3, 2), "tiff", "rec2020", "f32")
    data = bytes(files.first()["content"])
    _, tags = raw.read_tags(data)
    got = np.frombuffer(data[tags[273][0] : tags[273][0] + tags[279][0]], "<f4").reshape(-1, 3)
    assert tags[258] == (32,) * 3 and got[0][2] < 0 < got[0][1] < got[0][0]


def test_raw_scan(spark, tmp_path):
    codes = np.arange(24).reshape(4, 6)
    (tmp_path / "a.dng").write_bytes(raw.write_dng(codes, black=2, white=100))
    (tmp_path / "notes.txt").write_text("no image")
    rows = raw.scan_raw(spark, str(tmp_path)).orderBy("row", "col").collect()
    assert [r["code"] for r in rows] == list(range(24))
    (header,) = raw.read_headers(spark, str(tmp_path)).collect()
    assert (header["width"], header["height"], header["black"], header["white"]) == (6, 4, [2.0] * 4, 100.0)
    v = grid(raw.normalize_each(raw.scan_raw(spark, str(tmp_path)), raw.read_headers(spark, str(tmp_path))), "v")
    assert np.allclose(v, (np.arange(24) - 2) / 98)
    with pytest.raises(raw.UnsupportedRaw):
        raw.decode(b"JUNKJUNK")
    with pytest.raises(ValueError):
        raw.scan_raw(spark, None)


def test_raw_header_round_trip():
    matrix = (0.9, 0.1, -0.1, -0.2, 1.2, 0.05, 0.02, -0.1, 0.8)
    codes = np.arange(16).reshape(4, 4)
    data = raw.write_dng(codes, ((1, 2), (0, 1)), (64, 65, 66, 67), 4000, "Maker", "One", 6, (0.5, 1.0, 0.8), matrix)
    h = raw.read_header(data)
    assert (raw.decode(data) == codes).all()
    assert (h["make"], h["model"], h["orientation"], h["cfa"], h["black"], h["white"]) == ("Maker", "One", 6, [1, 2, 0, 1], [64.0, 65.0, 66.0, 67.0], 4000.0)
    assert h["as_shot"] == pytest.approx([2.0, 1.0, 1.25]) and h["xyz_to_cam"] == pytest.approx(matrix)


def test_raw_files_of_two_cameras(spark, tmp_path):
    """Each image is normalised by its own levels; the source's description needs one extent and pattern."""
    codes = np.full((4, 4), 600)
    (tmp_path / "a.dng").write_bytes(raw.write_dng(codes, black=100, white=1100, make="A", neutral=(0.5, 1, 1)))
    (tmp_path / "b.dng").write_bytes(raw.write_dng(codes, black=(0, 100, 200, 300), white=600, make="B"))
    headers = raw.read_headers(spark, str(tmp_path))
    v = raw.normalize_each(raw.scan_raw(spark, str(tmp_path)), headers).join(headers.select("image_id", "make"), "image_id")
    assert grid(v.where("make = 'A'"), "v") == pytest.approx([0.5] * 16)
    assert grid(v.where("make = 'B'"), "v")[:6] == pytest.approx([1, 5 / 6, 1, 5 / 6, 4 / 6, 3 / 6])
    gains = {r["make"]: r["gains"] for r in raw.gains_each(headers).join(headers.select("image_id", "make"), "image_id").collect()}
    assert gains["A"] == pytest.approx([2, 1, 1, 1]) and gains["B"] == [1, 1, 1, 1]
    meta, width, height = raw.common_metadata(headers)
    assert (meta.make, width, height) == ("A", 4, 4) and meta.calibration.as_shot[:3] == pytest.approx((2, 1, 1))
    (tmp_path / "c.dng").write_bytes(raw.write_dng(codes[:2]))
    with pytest.raises(ContractError):
        raw.common_metadata(raw.read_headers(spark, str(tmp_path)))


def test_loaded_headers_stay_with_the_node(spark, tmp_path):
    """A file's header, or the error of reading it, is kept by all copies of a graph until the path is set again."""
    from lumaflow.operators import nodes
    from lumaflow.plans.evaluate import Context, evaluate
    from lumaflow.plans.graph import NodeError

    first, second = tmp_path / "a.dng", tmp_path / "b.dng"
    first.write_bytes(raw.write_dng(np.full((4, 6), 600), black=100, white=1100, make="A"))
    dag = nodes.Dag()
    node = dag.add(nodes.REGISTRY.find("bayer-raw"), {"path": str(first)})
    make = lambda: evaluate(dag, Context(spark), dag.output(node, "metadata")).frame.desc.make
    assert make() == "A"
    first.write_bytes(raw.write_dng(np.full((4, 6), 600), make="changed"))
    assert make() == "A"
    dag.set_parameters(node, {"path": str(first)})
    assert make() == "changed"
    dag.set_parameters(node, {"path": str(second)})
    with pytest.raises(NodeError):
        make()
    second.write_bytes(raw.write_dng(np.full((4, 6), 600), make="late"))
    with pytest.raises(NodeError):
        make()
    dag.set_parameters(node, {"path": str(second)})
    assert make() == "late"


def test_preview_proofs_with_a_profile_file(spark, tmp_path):
    from lumaflow.operators import nodes
    from lumaflow.plans.evaluate import Context, evaluate

    (tmp_path / "own.icc").write_bytes(icc_file(GAMMA))
    frame = rasters.bound_rgb(spark, [(0.9, 0.05, 0.4), (1.4, -0.2, 0.5)], Extent(2, 1), REC2020_D65)
    dag = nodes.Dag()
    source, view = dag.add(nodes.bound_source(frame, nodes.RGB)), dag.add(nodes.REGISTRY.find("preview"), {"mode": {"softproof": {"profile": {"file": {"path": str(tmp_path / "own.icc")}}, "intent": "absolute", "black_point_compensation": False}}})
    dag.link(source, view)
    got = grid(evaluate(dag, Context(spark), dag.output(view)).frame.data, "r", "g", "b")
    assert np.allclose(got, grid(pointwise.soft_proof(frame.data, "p3"), "r", "g", "b"), atol=1e-3)


def test_raw_graph(spark, tmp_path):
    from lumaflow.operators import nodes
    from lumaflow.plans.evaluate import Context, evaluate, run_action

    codes = np.full((32, 32), 600)
    (tmp_path / "a.dng").write_bytes(raw.write_dng(codes, ((0, 1), (1, 2)), 100, 1100))
    dag = nodes.raw_template()
    by = {dag.entry(n).kind.id: n for n in dag.nodes()}
    dag.set_parameters(by["bayer-raw"], {"path": str(tmp_path / "a.dng")})
    out = evaluate(dag, Context(spark), dag.output(by["camera-to-color-rgb"])).frame
    pixels = grid(out.data, "r", "g", "b")
    assert len(pixels) == 1024 and np.allclose(pixels, pixels[0], atol=1e-9)
    dag.set_parameters(by["export-tiff"], {"path": str(tmp_path / "out")})
    run_action(dag, Context(spark), by["export-tiff"])
    assert bytes(spark.read.parquet(str(tmp_path / "out")).first()["content"])[:2] == b"II"
