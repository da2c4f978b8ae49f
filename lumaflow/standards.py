"""Colour constants and matrices for the oracles, from the published standards by numpy's linear algebra.

The engine computes the same things with its own 3x3 functions (functions/color.py); nothing here uses those, so that a
comparison can tell."""

from __future__ import annotations

import numpy as np

GREY = 0.18
# Chromaticities by ITU-R BT.2020, BT.709 and SMPTE RP 431 (with D65), as columns of x and y.
WHITE = np.array([0.3127, 0.3290])
PRIMARIES = {
    "rec2020": np.array([[0.708, 0.170, 0.131], [0.292, 0.797, 0.046]]),
    "srgb": np.array([[0.64, 0.30, 0.15], [0.33, 0.60, 0.06]]),
    "p3": np.array([[0.680, 0.265, 0.150], [0.320, 0.690, 0.060]]),
}
# Transfer curves from linear values (exponent, scale, offset, slope of the straight part, its end).
CURVES = {name: (1 / 2.4, 1.055, 0.055, 12.92, 0.04045 / 12.92) for name in ("srgb", "p3")} | {"rec2020": (0.45, 1.099, 0.099, 4.5, 0.081 / 4.5)}
# Cone responses of CAT16.
CONES = np.array([[0.401288, 0.650173, -0.051461], [-0.250268, 1.204414, 0.045854], [-0.002079, 0.048952, 0.953127]])


def _full(xy: np.ndarray) -> np.ndarray:
    """x, y and z = 1 - x - y."""
    return np.vstack([xy, 1 - xy.sum(0)])


def _normalised(primaries: np.ndarray) -> np.ndarray:
    """Normalised primary matrix by SMPTE RP 177."""
    p, w = _full(primaries), _full(WHITE[:, None])[:, 0] / WHITE[1]
    return p * np.linalg.solve(p, w)


def to_xyz(space: str) -> np.ndarray:
    return _normalised(PRIMARIES[space])


def between(source: str, target: str) -> np.ndarray:
    """Linear RGB of one space to that of another."""
    return np.eye(3) if source == target else np.linalg.solve(to_xyz(target), to_xyz(source))


def camera(xyz_to_cam, gains) -> np.ndarray:
    """Camera RGB that had `gains` to linear Rec.2020: equal parts of Rec.2020 are what the unit gains make neutral."""
    forward = np.array(xyz_to_cam)[:3] @ to_xyz("rec2020")
    response = forward.sum(1)
    # gained values are native ones times gains; native white is `response`, and green keeps its own scale
    return np.linalg.inv(forward / response[:, None]) @ np.diag(response[1] / response / np.array(gains)[:3])


def adapted(white_xy) -> np.ndarray:
    """Rec.2020 under another white, adapted to its own."""
    xyz = lambda xy: _full(np.array(xy)[:, None])[:, 0] / xy[1]
    cones = (CONES @ xyz(WHITE)) / (CONES @ xyz(white_xy))
    m = to_xyz("rec2020")
    return np.linalg.inv(CONES @ m) @ np.diag(cones) @ CONES @ m


def camera_white(xyz_to_cam, gains) -> tuple[float, float]:
    xyz = to_xyz("rec2020") @ camera(xyz_to_cam, gains).sum(1)
    return tuple((xyz / xyz.sum())[:2].tolist())


def white_uv() -> tuple[float, float]:
    x, y = WHITE
    return float(4 * x / (-2 * x + 12 * y + 3)), float(9 * y / (-2 * x + 12 * y + 3))


def bin_edges(low: float, high: float, n: int = 256) -> list[float]:
    """Lower edges of scope bins, as 32-bit floats."""
    return [float(x) for x in np.exp2(low + np.arange(n) * (high - low) / n).astype(np.float32)]


def _turned(scale, degrees=(2.0, -1.0, -3.0)) -> np.ndarray:
    """Rec.2020's primaries turned about the white, and moved to a share of the way to the triangle's edge."""
    corner = PRIMARIES["rec2020"].T
    out = []
    for p, s, turn in zip(corner, scale, np.radians(degrees), strict=True):
        d = p - WHITE
        d = np.array([d[0] * np.cos(turn) - d[1] * np.sin(turn), d[0] * np.sin(turn) + d[1] * np.cos(turn)])
        along = np.roll(corner, -1, 0) - corner
        normal = np.stack([along[:, 1], -along[:, 0]], 1)
        reach = ((corner - WHITE) * normal).sum(1) / (normal @ d)
        out.append(WHITE + s * reach[reach > 0].min() * d)
    return np.array(out).T


def tone_curve(contrast: float, skew: float) -> dict:
    """Curve constants, and the matrices into and out of the rendering primaries."""
    paper = 0.2**skew
    root = GREY ** (1 / paper)
    film = contrast * (1 - GREY) / paper / (1 - root)
    base = to_xyz("rec2020")
    return {
        "paper": paper, "film": film, "log_exposure": film * np.log(GREY) + np.log((1 - root) / root),
        "inset": np.linalg.solve(base, _normalised(_turned((0.9, 0.9, 0.85)))), "outset": np.linalg.solve(_normalised(_turned((1.0, 1.0, 1.0))), base),
    }
