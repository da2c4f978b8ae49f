"""Deterministic rasters over tables, and in-memory sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumaflow.model import MOSAIC_SCHEMA, RGB_SCHEMA, BayerDesc, Camera, ContractError, Extent, Frame, Phase, Response, RgbDesc

WIDTH = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(key: str, width: int) -> list:
    return [F.lit(0).cast("long").alias("image_id"), F.expr(f"cast({key} div {width} as int)").alias("row"), F.expr(f"cast({key} % {width} as int)").alias("col")]


def events_extent(spark: SparkSession, sf_dir: str) -> Extent:
    return Extent(WIDTH, table(spark, sf_dir, "events").count() // WIDTH)


def events_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_place("event_id", WIDTH), (F.col("value").cast("double") / 128).alias("v"))


def events_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_place("event_id", WIDTH), F.floor(F.col("value").cast("double") * 16).cast("int").alias("code"))


def events_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(*_place("event_id", WIDTH), (F.col("value").cast("double") / 128).alias("r"), (F.col("event_id") % 97 / F.lit(97.0)).alias("g"), (F.col("user_id") % 53 / F.lit(53.0)).alias("b"))


def lineitem_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels without a place of their own (rows repeat): for pointwise operators and aggregates."""
    price, quantity, discount = (F.col(f"l_{c}").cast("double") for c in ("extendedprice", "quantity", "discount"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").cast("long").alias("image_id"), F.col("l_orderkey").cast("int").alias("row"), F.col("l_linenumber").cast("int").alias("col"), (price / 105000).alias("r"), (quantity / 50).alias("g"), (discount * 10).alias("b")
    )


def embedding_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed pixels from neighbouring components."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "x"), "embedding")
    at = lambda k: F.element_at("embedding", (F.col("col") + k) % F.size("embedding") + 1).cast("double")
    return rows.select(F.lit(0).cast("long").alias("image_id"), F.col("vec_id").cast("int").alias("row"), F.col("col").cast("int").alias("col"), at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def embedding_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8 x 8 mosaic by vector, with samples around one half."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.posexplode("embedding").alias("pos", "x"))
    return rows.select("image_id", F.expr("cast(pos div 8 as int)").alias("row"), F.expr("cast(pos % 8 as int)").alias("col"), (F.col("x").cast("double") + 0.6).alias("v"))


def formula_mosaic(spark: SparkSession, width: int, height: int, expression: str) -> DataFrame:
    """v by a SQL expression of row, col and i = row * width + col."""
    at = spark.range(width * height).selectExpr("cast(0 as bigint) as image_id", f"cast(id div {width} as int) as row", f"cast(id % {width} as int) as col", "id as i")
    return at.selectExpr("image_id", "row", "col", f"cast({expression} as double) as v")


def bound_mosaic(spark: SparkSession, samples: list[float], extent: Extent, phase: Phase, camera: Camera, image_id: int = 0) -> Frame:
    """A mosaic from driver values; description and data are checked at admission."""
    if len(samples) != extent.width * extent.height:
        raise ContractError("sample count does not fit the extent")
    rows = [(image_id, i // extent.width, i % extent.width, float(v)) for i, v in enumerate(samples)]
    return Frame(BayerDesc(extent, phase, Response(camera)), spark.createDataFrame(rows, MOSAIC_SCHEMA))


def bound_rgb(spark: SparkSession, pixels, extent: Extent, coordinates, image_id: int = 0) -> Frame:
    if len(pixels) != extent.width * extent.height:
        raise ContractError("pixel count does not fit the extent")
    rows = [(image_id, i // extent.width, i % extent.width, *map(float, p)) for i, p in enumerate(pixels)]
    return Frame(RgbDesc(extent, coordinates), spark.createDataFrame(rows, RGB_SCHEMA))
