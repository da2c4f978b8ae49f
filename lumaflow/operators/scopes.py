"""Histograms, scopes and metering: small grouped counts, combined before the shuffle and made dense after it."""

from __future__ import annotations

import math
import struct

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumaflow.functions import color
from lumaflow.functions.exprs import encode_curve, matrix3, positive
from lumaflow.model import ContractError, Extent

BINS = 256


def check_range(low: float, high: float) -> None:
    if not (math.isfinite(low) and math.isfinite(high) and low < high):
        raise ContractError("scope range must be finite and increasing")


def bin_edges(low: float, high: float) -> list[float]:
    """Lower edges of the bins: 32-bit floats, evenly spaced in stops."""
    check_range(low, high)
    return [struct.unpack("f", struct.pack("f", 2.0 ** (low + i * (high - low) / BINS)))[0] for i in range(BINS)]


def level_bin(v: Column, low: float, high: float) -> Column:
    """Last edge at or below v; what is under the first edge, and NaN, goes to bin 0.

    The logarithm gives the bin but for rounding; two comparisons with the exact edges settle it."""
    edges = F.array(*[F.lit(e) for e in bin_edges(low, high)])
    guess = F.floor((F.log2(v) - F.lit(low)) * F.lit(BINS / (high - low)))
    guess = F.least(F.greatest(guess, F.lit(0)), F.lit(BINS - 1)).cast("int")
    up = F.when((guess < BINS - 1) & (v >= F.element_at(edges, F.least(guess + 2, F.lit(BINS)))), guess + 1).when((guess > 0) & (v < F.element_at(edges, guess + 1)), guess - 1).otherwise(guess)
    safe = ~F.isnan(v) & (v >= F.lit(bin_edges(low, high)[0]))
    return F.when(safe & (v >= F.lit(bin_edges(low, high)[-1])), F.lit(BINS - 1)).when(safe, up).otherwise(F.lit(0)).cast("int")


def channels(rgb: DataFrame, *keep: str) -> DataFrame:
    """One row by pixel and channel."""
    return rgb.select(*keep, F.expr("stack(3, 0, r, 1, g, 2, b) as (channel, v)"))


def _dense(counts: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """All places of the grid for every image, zeros included. Images come from the counts (a row with null keys stands
    for what has no place), which are made once: both uses share their exchange."""
    images = counts.groupBy("image_id").agg(F.sum("n").alias("pixels")).where("pixels > 0").select("image_id")
    full = images.join(F.broadcast(grid))  # the grid has a fixed number of rows
    return full.join(counts, ["image_id", *keys], "left").select("image_id", *keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _bins(spark: SparkSession, name: str, n: int = BINS) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias(name))


def histogram(rgb: DataFrame, low: float = -12.0, high: float = 4.0) -> DataFrame:
    """image_id, channel, bin, n: dense 3 x 256 by image."""
    spark = rgb.sparkSession
    counts = channels(rgb, "image_id").groupBy("image_id", "channel", level_bin(F.col("v"), low, high).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = _bins(spark, "channel", 3).crossJoin(_bins(spark, "bin"))
    return _dense(counts, grid, ["channel", "bin"])


def waveform_counts(rgb: DataFrame, extent: Extent, low: float = -12.0, high: float = 4.0) -> DataFrame:
    """image_id, channel, y, x, n for the places with samples."""
    x = F.expr(f"cast(cast(col as bigint) * {BINS} div {extent.width} as int)")
    y = (F.lit(BINS - 1) - level_bin(F.col("v"), low, high)).cast("int")
    return channels(rgb, "image_id", x.alias("x")).groupBy("image_id", "channel", y.alias("y"), "x").agg(F.count(F.lit(1)).alias("n"))


def waveform(rgb: DataFrame, extent: Extent, low: float = -12.0, high: float = 4.0) -> DataFrame:
    """Dense 3 x 256 x 256 by image."""
    spark = rgb.sparkSession
    grid = _bins(spark, "channel", 3).crossJoin(_bins(spark, "y")).crossJoin(_bins(spark, "x"))
    return _dense(waveform_counts(rgb, extent, low, high), grid, ["channel", "y", "x"])


def white_uv() -> tuple[float, float]:
    x, y, z = color.white_xyz(color.D65)
    return 4 * x / (x + 15 * y + 3 * z), 9 * y / (x + 15 * y + 3 * z)


def vectorscope_counts(rgb: DataFrame) -> DataFrame:
    """image_id, y, x, n over u'v' chromaticity; black pixels are left out, exact neutrals are in the middle."""
    return _places(rgb).where("y is not null")


def _places(rgb: DataFrame) -> DataFrame:
    """The counts by place; black pixels are counted by image, without a place."""
    clean = rgb.select("image_id", *[positive(F.col(c)).alias(c) for c in "rgb"]).withColumn("peak", F.greatest("r", "g", "b"))
    endless = F.col("peak") == F.lit(float("inf"))
    unit = clean.select("image_id", "peak", *[F.when(endless | (F.col("peak") <= 0), F.lit(0.0)).otherwise(F.col(c) / F.col("peak")).alias(c) for c in "rgb"], endless.alias("endless"))
    x, y, z = matrix3(color.rgb_to_xyz(), *[F.col(c) for c in "rgb"])
    xyz = unit.select("image_id", "peak", "r", "g", "b", "endless", x.alias("X"), y.alias("Y"), z.alias("Z"))
    u_white, v_white = white_uv()
    below = F.col("X") + 15 * F.col("Y") + 3 * F.col("Z")
    below = F.when(below == 0, F.lit(1.0)).otherwise(below)
    place = lambda t: F.least(F.greatest(F.floor(t * BINS), F.lit(0)), F.lit(BINS - 1))
    neutral = ~F.col("endless") & (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    lit_up = F.col("peak") > 0
    pick = lambda t: F.when(lit_up, F.when(F.col("endless"), F.lit(0)).when(neutral, F.lit(128)).otherwise(place(t))).cast("int")
    by = pick(F.lit(0.5) - 9 * F.col("Y") / below + F.lit(v_white))
    bx = pick(F.lit(0.5) + 4 * F.col("X") / below - F.lit(u_white))
    return xyz.groupBy("image_id", by.alias("y"), bx.alias("x")).agg(F.count(F.lit(1)).alias("n"))


def vectorscope(rgb: DataFrame) -> DataFrame:
    """Dense 256 x 256 by image."""
    spark = rgb.sparkSession
    return _dense(_places(rgb), _bins(spark, "y").crossJoin(_bins(spark, "x")), ["y", "x"])


def density(counts: DataFrame, log: bool) -> DataFrame:
    """Adds density: n or ln(1 + n) over the image's largest (1 at least)."""
    level = F.log1p(F.col("n")) if log else F.col("n").cast("double")
    return counts.withColumn("level", level).withColumn("density", F.col("level") / F.greatest(F.max("level").over(Window.partitionBy("image_id")), F.lit(1.0))).drop("level")


def vectorscope_colors(counts: DataFrame) -> DataFrame:
    """Display colour of every place of a scope with density: chromaticity at its middle, clipped, at full brightness, encoded, times density."""
    u_white, v_white = white_uv()
    u = (F.col("x") + 0.5) / BINS - 0.5 + F.lit(u_white)
    v = F.lit(0.5) - (F.col("y") + 0.5) / BINS + F.lit(v_white)
    shown = counts.select("*", u.alias("u"), v.alias("vv"))
    x, z = 9 * F.col("u") / (4 * F.col("vv")), (12 - 3 * F.col("u") - 20 * F.col("vv")) / (4 * F.col("vv"))
    xyz = shown.where("vv > 0").select("*", x.alias("big_x"), z.alias("big_z"))
    raw = matrix3(color.inverse(color.rgb_to_xyz(color.REC709)), F.col("big_x"), F.lit(1.0), F.col("big_z"))
    clipped = xyz.select("*", *[F.greatest(c, F.lit(0.0)).alias(n) for c, n in zip(raw, "rgb", strict=True)]).withColumn("peak", F.greatest("r", "g", "b"))
    out = [(encode_curve(F.col(c) / F.greatest("peak", F.lit(1e-12)), color.SRGB_CURVE) * F.col("density")).alias(c) for c in "rgb"]
    return clipped.select("image_id", "y", "x", *out)


def luminance(rgb_weights=None) -> Column:
    weights = rgb_weights or color.rgb_to_xyz()[1]
    return F.lit(weights[0]) * F.col("r") + F.lit(weights[1]) * F.col("g") + F.lit(weights[2]) * F.col("b")


def auto_exposure(rgb: DataFrame) -> DataFrame:
    """image_id, mean, ev: the exposure that brings mean luminance to middle grey; null where the mean is not finite and positive."""
    mean = rgb.groupBy("image_id").agg(F.avg(luminance()).alias("mean"))
    sound = ~F.isnan("mean") & (F.col("mean") > 0) & (F.col("mean") < F.lit(float("inf")))
    return mean.select("image_id", "mean", F.when(sound, F.log2(F.lit(color.GREY) / F.col("mean"))).alias("ev"))


def curve_samples(spark: SparkSession, contrast: float = 1.5, skew: float = -0.2) -> DataFrame:
    """129 samples of the tone curve over 16 stops around grey."""
    from lumaflow.operators.pointwise import curve

    x = F.col("id") / 128.0
    k = color.sigmoid_coefficients(contrast, skew)
    return spark.range(129).select(F.col("id").cast("int").alias("i"), curve(F.lit(color.GREY) * F.pow(F.lit(2.0), 16.0 * x - 8.0), k).alias("value"))


