"""Demosaicing: the 2x2 cell average as a grouped pivot, and RCD over halo tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.functions.exprs import cfa_color
from lumaflow.model import RGB_SCHEMA, ContractError, Extent
from lumaflow.operators.tiles import KEYS, Tiling

TILE, HALO, BORDER = 256, 16, 10


def bin_extent(extent: Extent) -> Extent:
    if extent.width < 2 or extent.height < 2:
        raise ContractError("the 2x2 demosaic needs at least 2 x 2 samples")
    return Extent(extent.width // 2, extent.height // 2)


def demosaic_2x2(mosaic: DataFrame, phase: int, extent: Extent) -> DataFrame:
    """One pixel per complete cell: its red, the mean of its greens, its blue."""
    out = bin_extent(extent)
    color = cfa_color(F.col("row"), F.col("col"), phase)
    part = lambda c, weight=1.0: F.sum(F.when(color == c, F.col("v") * weight))
    keyed = mosaic.where((F.col("row") < out.height * 2) & (F.col("col") < out.width * 2))
    cells = keyed.groupBy("image_id", F.expr("cast(row div 2 as int)").alias("row"), F.expr("cast(col div 2 as int)").alias("col"))
    return cells.agg(part(0).alias("r"), part(1, 0.5).alias("g"), part(2).alias("b"))


def colors(height: int, width: int, phase: int, row: int = 0, col: int = 0) -> np.ndarray:
    y = ((np.arange(height) + row + phase // 2) % 2)[:, None]
    x = ((np.arange(width) + col + phase) % 2)[None, :]
    return np.where(y == x, 2 * y, 1)


class _Plane:
    """An array read at offsets; outside lies zero."""

    def __init__(self, a: np.ndarray, pad: int = 6):
        self.a, self.pad = np.pad(a, pad), pad
        self.shape = a.shape

    def __call__(self, dy: int, dx: int) -> np.ndarray:
        p, (h, w) = self.pad, self.shape
        return self.a[p + dy : p + dy + h, p + dx : p + dx + w]


# Opposite ways are next to each other: two ways make a line.
AXES = ((-1, 0), (1, 0), (0, -1), (0, 1))
DIAGONALS = ((-1, -1), (1, 1), (-1, 1), (1, -1))
# Fixed values of the method: the high-pass filter by distance along a line, and the guards of its divisions.
TAPS = (6.0, -1.0, -3.0, 1.0)
SLOPE_GUARD, ENERGY_GUARD = 1e-5, 1e-10


def _along(plane: _Plane, ways, k: int) -> np.ndarray:
    """The samples k steps on in every way, stacked."""
    return np.stack([plane(k * dy, k * dx) for dy, dx in ways])


def _energy(plane: _Plane, ways) -> np.ndarray:
    """Squared high-pass of the lines, stacked."""
    first = ways[::2]
    taps = sum(w * (_along(plane, first, k) + (_along(plane, first, -k) if k else 0)) for k, w in enumerate(TAPS))
    return taps**2


def _decided(share: np.ndarray) -> np.ndarray:
    """A line's share, or the mean of the diagonal neighbours' where that is further from one half."""
    around = _along(_Plane(share), DIAGONALS, 1).mean(0)
    return np.clip(np.where(np.abs(around - 0.5) > np.abs(share - 0.5), around, share), 0, 1)


def _settle(guess: np.ndarray, slope: np.ndarray, share: np.ndarray) -> np.ndarray:
    """One value from the guesses of four ways: the two of a line by inverse slope, the lines by the second one's share."""
    weight = 1 / slope
    lines = (guess * weight).reshape(2, 2, *share.shape).sum(1) / weight.reshape(2, 2, *share.shape).sum(1)
    return lines[0] + share * (lines[1] - lines[0])


def rcd_tile(a: np.ndarray, phase: int, row: int, col: int, height: int, width: int) -> np.ndarray:
    """Ratio-corrected demosaic of a tile whose first sample is at (row, col) of a height x width image."""
    th, tw = a.shape
    sample = np.maximum(np.where(np.isnan(a), 0, a), 0)
    s = _Plane(sample)
    r, c = np.arange(row, row + th)[:, None], np.arange(col, col + tw)[None, :]
    margin = np.minimum(np.minimum(r, height - 1 - r), np.minimum(c, width - 1 - c))
    color = colors(th, tw, phase, row, col)
    inner, rough = margin >= 4, color != 1

    # the share of the horizontal line: energies of both lines, each over three neighbours along it
    energy = _energy(s, AXES)
    over = np.stack([sum(_Plane(e)(k * dy, k * dx) for k in (-1, 0, 1)) for e, (dy, dx) in zip(energy, AXES[::2], strict=True)])
    over = np.maximum(over, ENERGY_GUARD)
    turn = _decided(np.where(inner, over[0] / over.sum(0), 0))
    # green at red and blue: neighbours by the ratio of local means
    smooth = sample + 0.5 * _along(s, AXES, 1).sum(0) + 0.25 * _along(s, DIAGONALS, 1).sum(0)
    low = _Plane(np.where((margin >= 2) & rough, smooth, 0))
    one, two = _along(s, AXES, 1), _along(s, AXES, 2)
    slope = SLOPE_GUARD + np.abs(one - _along(s, AXES, -1)) + np.abs(sample - two) + np.abs(one - _along(s, AXES, 3)) + np.abs(two - _along(s, AXES, 4))
    guess = one * 2 * low(0, 0) / (SLOPE_GUARD + low(0, 0) + _along(low, AXES, 2))
    green = np.where(inner & rough, _settle(guess, slope, turn), sample)
    # the share of the rising diagonal; its energies are kept at odd columns, so an even column looks to both sides
    falling, rising = np.where((margin >= 3) & (c % 2 == 1), _energy(s, DIAGONALS), 0)
    even = c % 2 == 0

    def three(x, above, below):
        """A diagonal's energies over three rows, to the left (0) or right (1) above and below."""
        beside = lambda dy, right: np.where(even, x(dy, 2 * right - 1), x(dy, 2 * right))
        return beside(-1, above) + np.where(even, x(0, 1), x(0, 0)) + beside(1, below)

    both = np.maximum(np.stack([three(_Plane(falling), 0, 1), three(_Plane(rising), 1, 0)]), ENERGY_GUARD)
    slant = _decided(np.where(inner & rough, both[0] / both.sum(0), 0))

    # red and blue by their difference to green: along the diagonals at the other colour, then along the axes at green
    planes, g = [np.where(color == k, sample, 0) for k in (0, 1, 2)], _Plane(green)
    for k, where, ways, share in ((0, inner & (color == 2), DIAGONALS, slant), (2, inner & (color == 0), DIAGONALS, slant), (0, color == 1, AXES, turn), (2, color == 1, AXES, turn)):
        x = _Plane(planes[k])
        one = _along(x, ways, 1)
        slope = SLOPE_GUARD + np.abs(one - _along(x, ways, -1)) + np.abs(one - _along(x, ways, 3)) + np.abs(green - _along(g, ways, 2))
        planes[k] = np.where(where, green + _settle(one - _along(g, ways, 1), slope, share), planes[k])
    out = np.maximum(np.stack([planes[0], green, planes[2]], -1), 0)
    # the border takes means of the samples around by colour
    near = np.empty_like(out)
    real = _Plane(((r >= 0) & (r < height) & (c >= 0) & (c < width)).astype(float))
    for k in range(3):
        plane, mask = _Plane(np.where(color == k, sample, 0)), _Plane((color == k).astype(float))
        around = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        n = sum(mask(dy, dx) * real(dy, dx) for dy, dx in around)
        near[..., k] = np.where(color == k, sample, sum(plane(dy, dx) for dy, dx in around) / np.maximum(n, 1))
    return np.where((margin >= BORDER)[..., None], out, near)


def demosaic_rcd(mosaic: DataFrame, phase: int, extent: Extent, tile: int = TILE) -> DataFrame:
    """RCD by tiles of `tile` x `tile` samples: one exchange, each sample sent to the tiles whose halo it lies in.

    A tile's rows are bounded by (tile + 2 * HALO)^2, whatever the image's size."""
    tiling = Tiling(extent, tile, HALO)

    def run(key, table):
        image, ty, tx = (k.as_py() for k in key)
        a, top, left = tiling.plane(table, ty, tx)
        out = rcd_tile(a, phase, top, left, extent.height, extent.width)
        y, x = tiling.inner(ty, tx)
        found = out[y - top, x - left]
        return pa.table({"image_id": pa.array([image] * len(y), pa.int64()), "row": y, "col": x, "r": found[:, 0].copy(), "g": found[:, 1].copy(), "b": found[:, 2].copy()})

    return tiling.deal(mosaic).groupBy(*KEYS).applyInArrow(run, RGB_SCHEMA)
