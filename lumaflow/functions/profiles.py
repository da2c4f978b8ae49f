"""Output profiles: matrix and curves from linear Rec.2020 to a device's encoded values, built in or from an ICC file.

A profile is read once on the driver (it is a file of kilobytes, and its size is checked); what reaches a plan are
literals. Profiles that hold only tables need a colour engine and are refused. For matrix profiles the perceptual and
saturation intents are the relative one; the absolute one keeps the media white. Black-point compensation moves black to
the device's own black, which is 0 unless a curve starts above it; it is always on for perceptual and saturation of
version 4 profiles, and never for absolute, as in the common engines."""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from lumaflow.functions import color
from lumaflow.model import ContractError

INTENTS = ("perceptual", "relative", "saturation", "absolute")
MOST_BYTES = 16 << 20
# The white of the profile connection space, and the cone matrix profiles adapt by.
D50 = (0.9642, 1.0, 0.8249)
BRADFORD: color.Matrix = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))


class UnsupportedProfile(ContractError):
    """A profile that is sound but needs tables."""


def to_d50() -> color.Matrix:
    """XYZ under D65 to XYZ of the connection space."""
    gains = [d / s for d, s in zip(color.apply(BRADFORD, D50), color.apply(BRADFORD, color.white_xyz(color.D65)), strict=True)]
    return color.mul(color.inverse(BRADFORD), color.mul(color.diagonal(gains), BRADFORD))


@dataclass(frozen=True)
class Curve:
    """Encoded to linear: (a x + b)^g + e from d on, c x + f before; or a table over 0..1."""

    g: float = 1.0
    a: float = 1.0
    b: float = 0.0
    c: float = 0.0
    d: float = 0.0
    e: float = 0.0
    f: float = 0.0
    table: tuple = ()

    def linear(self, x: float) -> float:
        if self.table:
            return float(np.interp(x, np.linspace(0, 1, len(self.table)), self.table))
        return max(self.a * x + self.b, 0.0) ** self.g + self.e if x >= self.d else self.c * x + self.f

    def encoded(self, v: Column) -> Column:
        """The encoded value of a linear one within the curve's range."""
        if self.table:
            rise = np.maximum.accumulate(np.array(self.table))
            at = np.linspace(0, 1, len(rise))

            @F.pandas_udf("double")
            def look_up(s: pd.Series) -> pd.Series:
                return pd.Series(np.interp(s, rise, at))

            return look_up(v)
        power = F.when(v > self.e, F.pow(v - self.e, F.lit(1 / self.g))).otherwise(F.lit(0.0)) if self.e else F.pow(v, F.lit(1 / self.g))
        upper = (power - self.b) / self.a
        if self.d <= 0:
            return upper
        # the straight part reaches to its own end, where curves of rounded constants have a small step
        return F.when(v <= self.c * self.d + self.f, (v - self.f) / self.c).otherwise(upper) if self.c else F.when(v < self.linear(self.d), F.lit(self.d)).otherwise(upper)


@dataclass(frozen=True)
class OutputProfile:
    """to_device: linear Rec.2020 to the device's linear values by an intent; back: the way back (relative);
    black: the device value that black moves to."""

    to_device: color.Matrix
    back: color.Matrix
    curves: tuple[Curve, Curve, Curve]
    black: float = 0.0
    icc: bytes = field(default=b"", repr=False)

    def device(self, rgb: list[Column]) -> list[Column]:
        out = [F.lit(row[0]) * rgb[0] + F.lit(row[1]) * rgb[1] + F.lit(row[2]) * rgb[2] for row in self.to_device]
        return [F.lit(1 - self.black) * c + F.lit(self.black) for c in out] if self.black else out

    def clipped(self, device: list[Column]) -> list[Column]:
        return [F.least(F.greatest(c, F.lit(k.linear(0.0))), F.lit(k.linear(1.0))) for c, k in zip(device, self.curves, strict=True)]


def built_in(name: str) -> OutputProfile:
    name = {"display_p3": "p3"}.get(name, name)
    power, slope, offset, toe, end = color.PROFILES[name][1]
    m = color.to_profile(name)
    return OutputProfile(m, color.inverse(m), (Curve(power, slope, offset, toe, end),) * 3)


def _curve(data: bytes) -> Curve:
    kind = data[:4]
    if kind == b"curv":
        n = struct.unpack_from(">I", data, 8)[0]
        values = struct.unpack_from(f">{n}H", data, 12)
        return Curve() if n == 0 else Curve(g=values[0] / 256) if n == 1 else Curve(table=tuple(v / 65535 for v in values))
    if kind == b"para":
        sort = struct.unpack_from(">H", data, 8)[0]
        count = {0: 1, 1: 3, 2: 4, 3: 5, 4: 7}.get(sort)
        if count is None:
            raise ContractError("unknown parametric curve in the profile")
        v = [x / 65536 for x in struct.unpack_from(f">{count}i", data, 12)]
        if sort == 0:
            return Curve(g=v[0])
        if sort in (1, 2):
            rest = v[3] if sort == 2 else 0.0
            return Curve(v[0], v[1], v[2], 0.0, max(-v[2] / v[1], 0.0), rest, rest)
        return Curve(*v)
    raise ContractError("a transfer curve of an unknown kind in the profile")


def parse_icc(icc: bytes, intent: str = "relative", compensate: bool = True) -> OutputProfile:
    """An RGB matrix profile's conversion."""
    if intent not in INTENTS:
        raise ContractError(f"rendering intent {intent!r} is none of {INTENTS}")
    if len(icc) < 132 or icc[36:40] != b"acsp":
        raise ContractError("not an ICC profile")
    kind, space, major = icc[12:16], icc[16:20], icc[8]
    if space != b"RGB " or kind not in (b"mntr", b"prtr", b"spac"):
        raise ContractError("not an RGB output profile")
    tags = {}
    for i in range(struct.unpack_from(">I", icc, 128)[0]):
        name, at, size = struct.unpack_from(">4sII", icc, 132 + 12 * i)
        tags[name] = icc[at : at + size]
    needed = [c + t for t in (b"XYZ", b"TRC") for c in (b"r", b"g", b"b")]
    if any(n not in tags for n in needed) or b"B2A0" in tags:
        raise UnsupportedProfile("the profile converts by tables; only matrix profiles can be used")
    xyz = lambda data: tuple(x / 65536 for x in struct.unpack_from(">3i", data, 8))
    colorants = [xyz(tags[n]) for n in needed[:3]]
    matrix = tuple(tuple(c[i] for c in colorants) for i in range(3))
    relative = color.mul(color.inverse(matrix), color.mul(to_d50(), color.rgb_to_xyz()))
    to_device = relative
    if intent == "absolute" and (major >= 4 or kind != b"mntr") and b"wtpt" in tags:
        white = color.diagonal([s / t for s, t in zip(D50, xyz(tags[b"wtpt"]), strict=True)])
        to_device = color.mul(color.inverse(matrix), color.mul(white, color.mul(to_d50(), color.rgb_to_xyz())))
    curves = tuple(_curve(tags[n]) for n in needed[3:])
    forced = major >= 4 and intent in ("perceptual", "saturation")
    black = color.apply(matrix, [k.linear(0.0) for k in curves])[1] if intent != "absolute" and (compensate or forced) else 0.0
    if not math.isfinite(color.determinant(to_device)) or not 0 <= black < 1:
        raise ContractError("the profile's matrix or curves are of no use")
    return OutputProfile(to_device, color.inverse(relative), curves, black, icc)


def load(spark: SparkSession | None, choice: str | dict, intent: str = "relative", compensate: bool = True) -> OutputProfile:
    """The profile of a parameter's choice: a built-in one's name, or {"file": {"path": ...}}."""
    if intent not in INTENTS:
        raise ContractError(f"rendering intent {intent!r} is none of {INTENTS}")
    if isinstance(choice, str):  # no intent or compensation changes a built-in one: same white, black at 0
        return built_in(choice)
    path = choice["file"]["path"]
    if not path:
        raise ContractError("the output profile has no file")
    found = spark.read.format("binaryFile").load(path).where(F.col("length") <= MOST_BYTES).select("content").limit(1).collect()
    if not found:
        raise ContractError("no profile file of a fitting size under this path")
    return parse_icc(bytes(found[0]["content"]), intent, compensate)


def resolve(profile: str | OutputProfile) -> OutputProfile:
    return built_in(profile) if isinstance(profile, str) else profile
