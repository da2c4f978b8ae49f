"""Halo tiles: each sample goes to the tiles whose surroundings it lies in, so a stencil is one exchange and a bounded task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumaflow.model import ContractError, Extent

KEYS = ["image_id", "tile_row", "tile_col"]


class Tiling:
    """Tiles of `size` x `size` samples with a halo; both are multiples of `unit`, the period of what is done in a tile."""

    def __init__(self, extent: Extent, size: int, halo: int, unit: int = 2):
        if size % unit or halo % unit:
            raise ContractError(f"tiles and halos must be multiples of {unit} samples")
        self.extent, self.size, self.halo = extent, size, halo

    def count(self) -> tuple[int, int]:
        return -(-self.extent.height // self.size), -(-self.extent.width // self.size)

    def deal(self, mosaic: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """image_id, row, col, v (and the columns of `keep`) once for every tile that a sample serves, about
        (1 + 2 * halo / size)**2 times."""

        def over(c: str, last: int):
            first = f"greatest({c} - {self.halo}, 0) div {self.size}"
            return F.expr(f"explode(sequence(cast({first} as int), cast(least(({c} + {self.halo}) div {self.size}, {last}) as int)))")

        down, across = self.count()
        rows = mosaic.select("image_id", "row", "col", "v", *keep, over("row", down - 1).alias("tile_row"))
        return rows.select("*", over("col", across - 1).alias("tile_col"))

    def places(self, images: DataFrame) -> DataFrame:
        """The columns of `images`, with image_id, once for every tile."""
        down, across = self.count()
        rows = images.select("*", F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("tile_row"))
        return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("tile_col"))

    def window(self, ty: int, tx: int) -> tuple[int, int, int, int]:
        """First row and column, and those after the last, of a tile with its halo."""
        top, left = max(ty * self.size - self.halo, 0), max(tx * self.size - self.halo, 0)
        return top, left, min((ty + 1) * self.size + self.halo, self.extent.height), min((tx + 1) * self.size + self.halo, self.extent.width)

    def plane(self, table: pa.Table, ty: int, tx: int) -> tuple[np.ndarray, int, int]:
        """A tile's samples with its halo as an array, and where it begins."""
        top, left, bottom, right = self.window(ty, tx)
        a = np.zeros((bottom - top, right - left))
        a[table["row"].to_numpy() - top, table["col"].to_numpy() - left] = table["v"].to_numpy()
        return a, top, left

    def inner(self, ty: int, tx: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and columns of a tile's own samples, one after the other."""
        y, x = np.mgrid[ty * self.size : min((ty + 1) * self.size, self.extent.height), tx * self.size : min((tx + 1) * self.size, self.extent.width)]
        return y.ravel().astype(np.int32), x.ravel().astype(np.int32)
