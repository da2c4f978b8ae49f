"""Box reduction: one grouped average per image, combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.model import ContractError, Extent


def check_factor(factor: int) -> None:
    if not 1 <= factor <= 256:
        raise ContractError("reduction factor must be 1 to 256")


def bayer_extent(extent: Extent, factor: int) -> Extent:
    check_factor(factor)
    if factor == 1:
        return extent
    if extent.width < 2 or extent.height < 2:
        raise ContractError("a mosaic smaller than 2 x 2 cannot be reduced")
    return Extent(max(extent.width // (2 * factor) * 2, 2), max(extent.height // (2 * factor) * 2, 2))


def reduce_bayer(mosaic: DataFrame, factor: int, extent: Extent) -> DataFrame:
    """Average `factor` x `factor` samples of each colour plane; incomplete edge cells drop out (factor 1: nothing changes)."""
    out = bayer_extent(extent, factor)
    if factor == 1:
        return mosaic
    place = lambda c: F.expr(f"{c} div {2 * factor} * 2 + {c} % 2").cast("int")
    keyed = mosaic.select("image_id", place("row").alias("row"), place("col").alias("col"), "v")
    return keyed.where((F.col("row") < out.height) & (F.col("col") < out.width)).groupBy("image_id", "row", "col").agg(F.avg("v").alias("v"))


def rgb_extent(extent: Extent, factor: int) -> Extent:
    check_factor(factor)
    return Extent(-(-extent.width // factor), -(-extent.height // factor))


def reduce_rgb(rgb: DataFrame, factor: int) -> DataFrame:
    """Average blocks of `factor` x `factor` pixels; edge blocks average what there is."""
    check_factor(factor)
    place = lambda c: F.expr(f"{c} div {factor}").cast("int")
    keyed = rgb.select("image_id", place("row").alias("row"), place("col").alias("col"), "r", "g", "b")
    return keyed.groupBy("image_id", "row", "col").agg(*[F.avg(c).alias(c) for c in "rgb"])
