"""Per-pixel operators: pure projections, fused by Catalyst into their neighbours. No shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaflow.functions import color
from lumaflow.functions.exprs import at_least, by_site, encode_curve, matrix3, total
from lumaflow.functions.profiles import OutputProfile, resolve
from lumaflow.model import Calibration, ContractError



def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def with_rgb(df: DataFrame, rgb) -> DataFrame:
    return df.withColumns(dict(zip("rgb", rgb, strict=True)))


def normalize_raw(codes: DataFrame, calibration: Calibration) -> DataFrame:
    """Sensor codes (column code) to samples: (code - black) / range, neither clamped nor rounded."""
    height, width, values = calibration.pattern
    black = by_site([calibration.black + calibration.channel_black[calibration.cfa[i // 2][i % 2]] for i in range(4)], F.col("row"), F.col("col"))
    if values:
        place = F.col("row") % height * width + F.col("col") % width
        black = black + F.element_at(F.array(*[F.lit(float(v)) for v in values]), (place + 1).cast("int"))
    return codes.withColumn("v", (F.col("code") - black) / F.lit(float(calibration.range))).drop("code")


def site_gains(calibration: Calibration) -> tuple[float, ...]:
    """Gain of each site of the 2x2 cell."""
    balance = color.as_shot_balance(calibration.as_shot)
    return tuple(balance[calibration.cfa[i // 2][i % 2]] for i in range(4))


def apply_site_gains(mosaic: DataFrame, gains) -> DataFrame:
    return mosaic.withColumn("v", F.col("v") * by_site(gains, F.col("row"), F.col("col")))


def apply_image_gains(mosaic: DataFrame, metadata: DataFrame) -> DataFrame:
    """Gains by image: metadata has (image_id, gains array<double> of 4); images without any keep their samples.
    Catalyst broadcasts it only while it is small."""
    joined = mosaic.join(metadata.select("image_id", "gains"), "image_id", "left")
    at = (F.col("row") % 2 * 2 + F.col("col") % 2 + 1).cast("int")
    gain = F.when(F.col("gains").isNull(), F.lit(1.0)).otherwise(F.element_at("gains", at))
    return joined.withColumn("v", F.col("v") * gain).drop("gains")


def exposure(rgb: DataFrame, ev: float) -> DataFrame:
    check_ev(ev)
    gain = F.lit(2.0**ev)
    return with_rgb(rgb, [c * gain for c in _rgb()])


def check_ev(ev: float) -> None:
    largest = (2 - 2.0**-23) * 2.0**127
    if not math.isfinite(ev) or ev > 1000 or not 0 < 2.0**ev <= largest or 2.0**ev < 2.0**-149:
        raise ContractError("exposure must be finite and its gain a finite, non-zero 32-bit float")


def transform(rgb: DataFrame, matrix) -> DataFrame:
    """A 3x3 colour matrix."""
    return with_rgb(rgb, matrix3(matrix, *_rgb()))


def orient(df: DataFrame, orientation: int, width: int, height: int) -> DataFrame:
    """Move pixels to their upright place for an EXIF orientation; samples stay as they are."""
    if orientation not in range(1, 9):
        raise ContractError("orientation must be 1 to 8")
    x = F.lit(width - 1) - F.col("col") if orientation in (2, 3, 7, 8) else F.col("col")
    y = F.lit(height - 1) - F.col("row") if orientation in (3, 4, 6, 7) else F.col("row")
    row, col = (y, x) if orientation < 5 else (x, y)
    return df.withColumns({"row": row.cast("int"), "col": col.cast("int")})


def orient_each(df: DataFrame, metadata: DataFrame) -> DataFrame:
    """The same with metadata (image_id, orientation, width, height) by image."""
    o, m = F.coalesce(F.col("orientation"), F.lit(1)), df.join(metadata.select("image_id", "orientation", "width", "height"), "image_id", "left")
    x = F.when(o.isin(2, 3, 7, 8), F.col("width") - 1 - F.col("col")).otherwise(F.col("col"))
    y = F.when(o.isin(3, 4, 6, 7), F.col("height") - 1 - F.col("row")).otherwise(F.col("row"))
    return m.withColumns({"row": F.when(o < 5, y).otherwise(x).cast("int"), "col": F.when(o < 5, x).otherwise(y).cast("int")}).drop("orientation", "width", "height")


def curve(v: Column, k: dict) -> Column:
    z = F.lit(k["log_exposure"]) - F.lit(k["film"]) * F.ln(v)
    return F.when(v > 0, F.exp(F.lit(-k["paper"]) * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))))).otherwise(F.lit(0.0))


def sigmoid(rgb: DataFrame, contrast: float = 1.5, skew: float = -0.2, preserve_hue: float = 0.0) -> DataFrame:
    """Tone mapping: desaturate negatives toward the mean, inset, curve by channel, hue correction, outset."""
    if not 0 < contrast < math.inf or not -1 <= skew <= 1 or not 0 <= preserve_hue <= 1:
        raise ContractError("sigmoid parameters out of range")
    k = color.sigmoid_coefficients(contrast, skew)
    h = float(preserve_hue)
    others = [c for c in rgb.columns if c not in "rgb"]
    safe = rgb.select(*others, "r", "g", "b", F.greatest(total(list(_rgb())) / 3, F.lit(0.0)).alias("average"), F.least("r", "g", "b").alias("minimum"))
    share = F.when(F.col("minimum") < 0, F.col("average") / (F.col("average") - F.col("minimum"))).otherwise(F.lit(1.0))
    calm = [F.when(F.col("minimum") < 0, F.greatest(F.col("average") + share * (c - F.col("average")), F.lit(0.0))).otherwise(c) for c in _rgb()]
    calm = safe.select(*others, *[c.alias(n) for c, n in zip(calm, "rgb", strict=True)])
    work = calm.select(*others, *[c.alias(f"w{i}") for i, c in enumerate(matrix3(k["inset"], *_rgb()))])
    mapped = work.select("*", *[curve(F.col(f"w{i}"), k).alias(f"m{i}") for i in range(3)])
    if h == 0:  # the hue correction is the identity
        return mapped.select(*others, *[c.alias(n) for c, n in zip(matrix3(k["outset"], F.col("m0"), F.col("m1"), F.col("m2")), "rgb", strict=True)]).select(*rgb.columns)
    # the curve never falls, so sorting the mapped values keeps them beside the sorted work values; equal ones change places freely
    middle = lambda x: F.greatest(F.least(f"{x}0", f"{x}1"), F.least(F.greatest(f"{x}0", f"{x}1"), f"{x}2"))
    ordered = mapped.select("*", *[c.alias(f"{x}{n}") for x in "wm" for n, c in (("lo", F.least(f"{x}0", f"{x}1", f"{x}2")), ("mid", middle(x)), ("hi", F.greatest(f"{x}0", f"{x}1", f"{x}2")))])
    lo, mid, hi, mlo, mmid, mhi = (F.col(f"{x}{n}") for x in "wm" for n in ("lo", "mid", "hi"))
    f, e = F.col("fraction"), F.col("energy")
    step = ordered.select("*", F.when(hi > lo, (mid - lo) / (hi - lo)).otherwise(F.lit(0.0)).alias("fraction"))
    step = step.select("*", (F.lit(1 - h) * mmid + F.lit(h) * (mlo + (mhi - mlo) * f)).alias("naive"), F.when(lo + mid > 0, 2 * lo / (lo + mid)).otherwise(F.lit(0.0)).alias("blend"))
    step = step.select("*", (F.col("blend") * (mlo + mmid + mhi) + (1 - F.col("blend")) * (mlo + F.col("naive") + mhi)).alias("energy"), (F.col("naive") <= mmid).alias("low_side"))
    mid_low = (F.lit(1 - h) * mmid + F.lit(h) * (f * mhi + (1 - f) * (e - mhi))) / (1 + h * (1 - f))
    mid_high = (F.lit(1 - h) * mmid + F.lit(h) * (mlo * (1 - f) + f * (e - mlo))) / (1 + h * f)
    step = step.select("*", F.when(F.col("low_side"), mid_low).otherwise(mid_high).alias("new_mid"))
    step = step.select(*others, "w0", "w1", "w2", "wlo", "whi", "new_mid", F.when(F.col("low_side"), e - mhi - F.col("new_mid")).otherwise(mlo).alias("new_lo"), F.when(F.col("low_side"), mhi).otherwise(e - mlo - F.col("new_mid")).alias("new_hi"))
    back = step.select(*others, *[F.when(F.col(f"w{i}") == lo, F.col("new_lo")).when(F.col(f"w{i}") == hi, F.col("new_hi")).otherwise(F.col("new_mid")).alias(f"c{i}") for i in range(3)])
    return back.select(*others, *[c.alias(n) for c, n in zip(matrix3(k["outset"], F.col("c0"), F.col("c1"), F.col("c2")), "rgb", strict=True)]).select(*rgb.columns)


def soft_proof(rgb: DataFrame, profile: str | OutputProfile) -> DataFrame:
    """Clip to a matrix profile's gamut and come back to linear Rec.2020."""
    p = resolve(profile)
    out = with_rgb(rgb, p.device(_rgb()))
    out = with_rgb(out, p.clipped(_rgb()))
    return with_rgb(out, matrix3(p.back, *_rgb()))


def gamut_check(rgb: DataFrame, profile: str | OutputProfile, tolerance: float = 1e-3) -> DataFrame:
    """Pixels outside the profile's gamut become exactly (0, 1, 1); the others are soft-proofed.

    Out of gamut is any linear channel outside 0..1 by more than the tolerance (closed form for matrix profiles)."""
    p = resolve(profile)
    names = rgb.columns
    outside = rgb.select("*", *[c.alias(f"d{i}") for i, c in enumerate(p.device(_rgb()))])
    d = [F.col(f"d{i}") for i in range(3)]
    flag = (F.least(*d) < -tolerance) | at_least(F.greatest(*d), F.lit(1 + tolerance))
    kept = matrix3(p.back, *p.clipped(d))
    return outside.select(*[c for c in names if c not in "rgb"], *[F.when(flag, F.lit(x)).otherwise(c).alias(n) for c, n, x in zip(kept, "rgb", (0.0, 1.0, 1.0), strict=True)]).select(*names)


def encode_profile(rgb: DataFrame, profile: str | OutputProfile, depth: str = "u16") -> DataFrame:
    """Encoded samples of a matrix profile: u8 and u16 are clipped and rounded to integers, f32 keeps its range."""
    p = resolve(profile)
    out = with_rgb(rgb, p.device(_rgb()))
    if depth == "f32":
        return with_rgb(out, [F.signum(c) * k.encoded(F.abs(c)) for c, k in zip(_rgb(), p.curves, strict=True)])
    most = {"u8": 255, "u16": 65535}[depth]
    out = with_rgb(out, p.clipped(_rgb()))
    return with_rgb(out, [F.floor(k.encoded(c) * most + 0.5).cast("int") for c, k in zip(_rgb(), p.curves, strict=True)])


def display(rgb: DataFrame) -> DataFrame:
    """What a display shows: linear Rec.2020 clipped to 0..1, in sRGB primaries, by the sRGB curve mirrored at 0."""
    clipped = with_rgb(rgb, [F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)) for c in _rgb()])
    moved = with_rgb(clipped, matrix3(color.to_profile("srgb"), *_rgb()))
    return with_rgb(moved, [F.signum(c) * encode_curve(F.abs(c), color.SRGB_CURVE) for c in _rgb()])
