"""Opposed highlight reconstruction.

The whole operator goes by halo tiles: one exchange of the samples, a first pass that sums each colour's excess over its
reference, one small aggregate by image, and a second pass over the same exchanged tiles that repairs. What it
consists of (mask, dilation, reference) is there by itself too, as scattered stencils with partial aggregation.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaflow.functions.exprs import at_least, by_site, cfa_color, positive
from lumaflow.model import MOSAIC_SCHEMA, ContractError, Extent
from lumaflow.operators.demosaic import colors
from lumaflow.operators.tiles import KEYS, Tiling

CELL, REACH, FEWEST = 3, 3, 100
KEY = ["image_id", "row", "col"]
TILE, HALO = 252, 12  # multiples of a cell and of the 2x2 pattern; a cell's bits reach REACH cells on


def check_threshold(threshold: float) -> None:
    if not 0 < threshold <= 1:
        raise ContractError("clip threshold must be in (0, 1]")


def _offsets(reach: int) -> Column:
    return F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1)]))


def marked(mosaic: DataFrame, levels, threshold: float, phase: int) -> DataFrame:
    """Adds color, clip (the site's clip level) and hot (clipped)."""
    check_threshold(threshold)
    clip = by_site([v * threshold for v in levels], F.col("row"), F.col("col"))
    return mosaic.withColumns({"color": cfa_color(F.col("row"), F.col("col"), phase), "clip": clip, "hot": at_least(F.col("v"), clip)})


def clip_mask(pixels: DataFrame) -> DataFrame:
    """3x3 cells with a clipped sample: a bit by colour."""
    hot = pixels.where("hot").select("image_id", F.expr(f"cast(row div {CELL} as int)").alias("cell_row"), F.expr(f"cast(col div {CELL} as int)").alias("cell_col"), F.expr("shiftleft(1, color)").alias("bit"))
    return hot.groupBy("image_id", "cell_row", "cell_col").agg(F.bit_or("bit").alias("mask"))


def dilate(mask: DataFrame, extent: Extent) -> DataFrame:
    """Spread bits over 7x7 cells without the corners."""
    rows, cols = -(-extent.height // CELL), -(-extent.width // CELL)
    spread = mask.select("*", _offsets(REACH).alias("dy")).select("*", _offsets(REACH).alias("dx"))
    spread = spread.where(~((F.abs("dy") == REACH) & (F.abs("dx") == REACH)))
    moved = spread.select("image_id", (F.col("cell_row") + F.col("dy")).alias("cell_row"), (F.col("cell_col") + F.col("dx")).alias("cell_col"), "mask")
    inside = moved.where(F.col("cell_row").between(0, rows - 1) & F.col("cell_col").between(0, cols - 1))
    return inside.groupBy("image_id", "cell_row", "cell_col").agg(F.bit_or("mask").alias("mask"))


def reference(targets: DataFrame, mosaic: DataFrame, phase: int) -> DataFrame:
    """Opposed reference of the targets (image_id, row, col): the cube of the mean cube root of the other colours' means."""
    at = targets.select(*KEY, _offsets(1).alias("dy")).select("*", _offsets(1).alias("dx"))
    at = at.select("image_id", F.col("row").alias("target_row"), F.col("col").alias("target_col"), (F.col("row") + F.col("dy")).alias("row"), (F.col("col") + F.col("dx")).alias("col"))
    near = at.join(mosaic.select(*KEY, "v"), KEY)
    color = cfa_color(F.col("row"), F.col("col"), phase)
    mean = [F.coalesce(F.sum(F.when(color == k, positive(F.col("v")))), F.lit(0.0)) / F.greatest(F.count(F.when(color == k, 1)), F.lit(1)) for k in range(3)]
    around = near.groupBy("image_id", F.col("target_row").alias("row"), F.col("target_col").alias("col")).agg(*[m.alias(f"mean_{k}") for k, m in enumerate(mean)])
    own = cfa_color(F.col("row"), F.col("col"), phase)
    root = [F.cbrt(F.col(f"mean_{k}")) for k in range(3)]
    both = F.when(own == 0, root[1] + root[2]).when(own == 1, root[0] + root[2]).otherwise(root[0] + root[1])
    return around.select(*KEY, F.pow(0.5 * both, F.lit(3.0)).alias("reference"))


def _cells(a: np.ndarray) -> np.ndarray:
    """Whether a cell holds a true sample (the last cells may be cut off)."""
    h, w = a.shape
    full = np.pad(a, ((0, -h % CELL), (0, -w % CELL)))
    return full.reshape(full.shape[0] // CELL, CELL, full.shape[1] // CELL, CELL).any((1, 3))


def _spread(cells: np.ndarray) -> np.ndarray:
    """A cell or one within reach, but for the corners of the square around it."""
    padded, (h, w) = np.pad(cells, REACH), cells.shape
    steps = range(2 * REACH + 1)
    return np.any([padded[dy : dy + h, dx : dx + w] for dy in steps for dx in steps if not (abs(dy - REACH) == abs(dx - REACH) == REACH)], axis=0)


def _opposed_reference(v: np.ndarray, color: np.ndarray) -> np.ndarray:
    """The cube of the mean cube root of the other two colours' means in the 3x3 neighbourhood."""
    h, w = v.shape
    sound = np.where(v > 0, v, 0.0)  # NaN too becomes 0
    root = []
    for k in range(3):
        own = color == k
        total, n = (np.pad(x, 1) for x in (np.where(own, sound, 0.0), own.astype(np.float64)))
        total, n = (sum(x[dy : dy + h, dx : dx + w] for dy in range(3) for dx in range(3)) for x in (total, n))
        root.append(np.cbrt(total / np.maximum(n, 1)))
    others = sum(root) - np.choose(color, root)
    return (0.5 * others) ** 3


class OpposedTile:
    """What a tile with its halo tells: clipped samples, the reference of all, and the samples that tell the chrominance."""

    def __init__(self, v: np.ndarray, top: int, left: int, levels, threshold: float, phase: int):
        h, w = v.shape
        self.v, self.color = v, colors(h, w, phase, top, left)
        site = ((np.arange(h) + top) % 2 * 2)[:, None] + ((np.arange(w) + left) % 2)[None, :]
        clip = np.array([x * threshold for x in levels])[site]
        self.hot = v >= clip
        self.reference = _opposed_reference(v, self.color)
        near = np.zeros((h, w), bool)
        if self.hot.any():
            for k in range(3):
                wide = _spread(_cells(self.hot & (self.color == k)))
                near |= (self.color == k) & wide.repeat(CELL, 0).repeat(CELL, 1)[:h, :w]
        self.eligible = ~self.hot & near & (v > 0.2 * clip) & (v < clip)


def tiling_of(extent: Extent) -> Tiling:
    return Tiling(extent, TILE, HALO, 2 * CELL)


LEVEL_COLUMNS = ("level_0", "level_1", "level_2", "level_3")


def _dealt(mosaic: DataFrame, levels, tiling: Tiling) -> DataFrame:
    """Samples by tile; levels by image (image_id, levels array<double> by site) come along as columns."""
    if not isinstance(levels, DataFrame):
        return tiling.deal(mosaic)
    own = levels.select("image_id", *[F.element_at("levels", i + 1).alias(c) for i, c in enumerate(LEVEL_COLUMNS)])
    return tiling.deal(mosaic.join(own, "image_id"), LEVEL_COLUMNS)


def _levels_of(table: pa.Table, levels) -> list[float]:
    """A tile's levels: those of the plan, or of its image."""
    return [table[c][0].as_py() for c in LEVEL_COLUMNS] if levels is None else levels


def chrominance(tiles: DataFrame, levels, phase: int, extent: Extent, threshold: float = 0.98) -> DataFrame:
    """Mean excess over the reference by image and colour; too few samples tell nothing. `tiles`: dealt samples,
    with level columns if `levels` is None."""
    tiling = tiling_of(extent)

    def run(key, table):
        image, ty, tx = (k.as_py() for k in key)
        v, top, left = tiling.plane(table, ty, tx)
        own = OpposedTile(v, top, left, _levels_of(table, levels), threshold, phase)
        y, x = tiling.inner(ty, tx)
        some = own.eligible[y - top, x - left]
        y, x = y[some] - top, x[some] - left
        color = own.color[y, x]
        n = np.bincount(color, minlength=3)
        excess = np.bincount(color, own.v[y, x] - own.reference[y, x], 3).astype(np.float64)  # of no samples: whole numbers
        found = np.flatnonzero(n)
        return pa.table({"image_id": pa.array([image] * len(found), pa.int64()), "color": found.astype(np.int32), "excess": excess[found], "n": n[found]})

    parts = tiles.groupBy(*KEYS).applyInArrow(run, "image_id long, color int, excess double, n long")
    sums = parts.groupBy("image_id", "color").agg(F.sum("excess").alias("excess"), F.sum("n").alias("n"))
    return sums.select("image_id", "color", "n", F.when(F.col("n") > FEWEST, F.col("excess") / F.col("n")).otherwise(F.lit(0.0)).alias("chroma"))


def highlights_opposed(mosaic: DataFrame, levels, phase: int, extent: Extent, threshold: float = 0.98) -> DataFrame:
    """Clipped samples become max(v, reference + chrominance of their colour); others stay bit for bit.

    levels: four by site, or a table of (image_id, levels array<double>) for images of several cameras."""
    check_threshold(threshold)
    tiling = tiling_of(extent)
    tiles = _dealt(mosaic, levels, tiling)
    levels = None if isinstance(levels, DataFrame) else [float(x) for x in levels]
    chroma = chrominance(tiles, levels, phase, extent, threshold)
    by_image = chroma.groupBy("image_id").agg(*[F.coalesce(F.max(F.when(F.col("color") == k, F.col("chroma"))), F.lit(0.0)).alias(f"c{k}") for k in range(3)])
    told = tiling.places(by_image).select(F.col("image_id").alias("of_image"), F.col("tile_row").alias("of_row"), F.col("tile_col").alias("of_col"), "c0", "c1", "c2")

    def repair(key, table, chroma):
        image, ty, tx = (k.as_py() for k in key)
        if not table.num_rows:
            return pa.table({"image_id": pa.array([], pa.int64()), "row": pa.array([], pa.int32()), "col": pa.array([], pa.int32()), "v": pa.array([], pa.float64())})
        v, top, left = tiling.plane(table, ty, tx)
        own = OpposedTile(v, top, left, _levels_of(table, levels), threshold, phase)
        y, x = tiling.inner(ty, tx)
        add = np.array([chroma[f"c{k}"][0].as_py() if chroma.num_rows else 0.0 for k in range(3)])
        new = np.where(own.hot, np.maximum(v, own.reference + add[own.color]), v)
        return pa.table({"image_id": pa.array([image] * len(y), pa.int64()), "row": y, "col": x, "v": new[y - top, x - left]})

    return tiles.groupBy(*KEYS).cogroup(told.groupBy("of_image", "of_row", "of_col")).applyInArrow(repair, MOSAIC_SCHEMA)
