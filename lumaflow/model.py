"""Logical types: descriptors live on the driver, samples in DataFrames.

A mosaic has (image_id, row, col, v), an RGB image (image_id, row, col, r, g, b). One descriptor
describes all images of a frame; what differs by image (gains, matrices) comes as a joined table.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum
from typing import Any

from pyspark.sql import DataFrame

from lumaflow.functions.color import D65, REC2020

MOSAIC_SCHEMA = "image_id long, row int, col int, v double"
RGB_SCHEMA = "image_id long, row int, col int, r double, g double, b double"
LEVELS_SCHEMA = "image_id long, levels array<double>"


class ContractError(ValueError):
    """A description does not fit an operator."""


class Phase(IntEnum):
    RGGB = 0
    GRBG = 1
    GBRG = 2
    BGGR = 3

    @classmethod
    def of_cfa(cls, cfa) -> Phase:
        """From a 2x2 of colour indices, where 3 is the second green."""
        folded = tuple(1 if c == 3 else c for row in cfa for c in row)
        found = {(0, 1, 1, 2): cls.RGGB, (1, 0, 2, 1): cls.GRBG, (1, 2, 0, 1): cls.GBRG, (2, 1, 1, 0): cls.BGGR}.get(folded)
        if found is None:
            raise ContractError(f"unsupported colour filter pattern {cfa}")
        return found


@dataclass(frozen=True)
class Extent:
    width: int
    height: int

    def __post_init__(self):
        if self.width < 1 or self.height < 1 or self.width * self.height > (2**32 - 1) // 3:
            raise ContractError(f"invalid extent {self.width} x {self.height}")


@dataclass(frozen=True)
class Camera:
    make: str
    model: str


@dataclass(frozen=True)
class Response:
    """Gains applied so far, by colour index R, G, B, second G; None: unbalanced."""

    camera: Camera
    balance: tuple[float, ...] | None = None


@dataclass(frozen=True)
class RgbSpace:
    primaries: tuple
    white: tuple


REC2020_D65 = RgbSpace(REC2020, D65)


@dataclass(frozen=True)
class BayerDesc:
    extent: Extent
    phase: Phase
    response: Response


@dataclass(frozen=True)
class LevelsDesc:
    phase: Phase
    response: Response


@dataclass(frozen=True)
class RgbDesc:
    extent: Extent
    coordinates: Response | RgbSpace

    @property
    def label(self) -> str:
        if isinstance(self.coordinates, Response):
            return "Camera RGB"
        return "Rec.2020 / D65" if self.coordinates == REC2020_D65 else "RGB"


@dataclass(frozen=True)
class Calibration:
    cfa: tuple = ((0, 1), (3, 2))
    black: int = 0
    channel_black: tuple = (0, 0, 0, 0)
    pattern: tuple = (0, 0, ())  # height, width, values
    maximum: int = 1
    xyz_to_cam: tuple = ((1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (0.0, 0.0, 0.0))
    as_shot: tuple = (1.0, 1.0, 1.0, 0.0)

    def pattern_at(self, row: int, col: int) -> int:
        height, width, values = self.pattern
        return values[row % height * width + col % width] if values else 0

    def black_at(self, row: int, col: int) -> int:
        return self.black + self.channel_black[self.cfa[row % 2][col % 2]] + self.pattern_at(row, col)

    @property
    def black_reference(self) -> int:
        height, width, values = self.pattern
        if 1 <= height <= 2 and 1 <= width <= 2:
            return min(self.black_at(r, c) for r in range(2) for c in range(2))
        return self.black + min(self.channel_black) + min(values, default=0)

    @property
    def range(self) -> int:
        if self.maximum <= self.black_reference:
            raise ContractError("white level must lie above the black level")
        return self.maximum - self.black_reference

    @property
    def site_levels(self) -> tuple[float, ...]:
        return tuple((self.maximum - self.black_at(i // 2, i % 2)) / self.range for i in range(4))


@dataclass(frozen=True)
class Metadata:
    make: str = ""
    model: str = ""
    iso: float = 0.0
    shutter: float = 0.0
    aperture: float = 0.0
    focal_length: float = 0.0
    datetime: str = ""
    orientation: int = 1
    calibration: Calibration = field(default_factory=Calibration)

    def __post_init__(self):
        if self.orientation not in range(1, 9):
            raise ContractError("orientation must be 1 to 8")

    @property
    def camera(self) -> Camera:
        return Camera(self.make, self.model)


def orientation_of_flip(flip: int) -> int:
    """EXIF orientation of a decoder's flip code; unknown codes are upright."""
    return (1, 2, 4, 3, 5, 8, 6, 7)[flip] if 0 <= flip < 8 else 1


@dataclass(frozen=True)
class Frame:
    """A port's value: description and data (a DataFrame; driver values for levels and metadata)."""

    desc: Any
    data: DataFrame | Any

    def with_(self, **changes) -> Frame:
        return replace(self, **changes)
