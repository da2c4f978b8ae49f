"""3x3 colour algebra on the driver: plain floats, folded into literals before a plan is built."""

from __future__ import annotations

import math

Matrix = tuple[tuple[float, float, float], ...]

# Chromaticities of RGB primaries and of the white point.
D65 = (0.3127, 0.3290)
REC2020 = ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046))
REC709 = ((0.640, 0.330), (0.300, 0.600), (0.150, 0.060))
P3 = ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060))
# The CAT16 cone matrix (Li et al. 2017).
CAT16: Matrix = ((0.401288, 0.650173, -0.051461), (-0.250268, 1.204414, 0.045854), (-0.002079, 0.048952, 0.953127))


def mul(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def apply(a: Matrix, v) -> tuple[float, ...]:
    return tuple(sum(a[i][k] * v[k] for k in range(3)) for i in range(3))


def diagonal(v) -> Matrix:
    return tuple(tuple(v[i] if i == j else 0.0 for j in range(3)) for i in range(3))


def determinant(m: Matrix) -> float:
    (a, b, c), (d, e, f), (g, h, i) = m
    return a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)


def inverse(m: Matrix) -> Matrix:
    (a, b, c), (d, e, f), (g, h, i) = m
    det = determinant(m)
    if not math.isfinite(det) or det == 0:
        raise ValueError("matrix cannot be inverted")
    cofactors = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(x / det for x in row) for row in cofactors)


def white_xyz(xy) -> tuple[float, float, float]:
    x, y = xy
    return (x / y, 1.0, (1.0 - x - y) / y)


def rgb_to_xyz(primaries=REC2020, white=D65) -> Matrix:
    """Columns of the primaries, scaled so that (1, 1, 1) is the white with Y = 1."""
    columns = [white_xyz(p) for p in primaries]
    m = tuple(tuple(columns[j][i] for j in range(3)) for i in range(3))
    scale = apply(inverse(m), white_xyz(white))
    return mul(m, diagonal(scale))


def adaptation(source_xy, target_xy=D65) -> Matrix:
    """XYZ to XYZ by CAT16 cone scaling."""
    source, target = apply(CAT16, white_xyz(source_xy)), apply(CAT16, white_xyz(target_xy))
    if not all(math.isfinite(x) and x > 0 for x in (*source, *target)):
        raise ValueError("cone responses must be finite and positive")
    return mul(inverse(CAT16), mul(diagonal([t / s for s, t in zip(source, target, strict=True)]), CAT16))


def rec2020_adaptation(source_xy) -> Matrix:
    to_xyz = rgb_to_xyz()
    return mul(inverse(to_xyz), mul(adaptation(source_xy), to_xyz))


def camera_matrix(xyz_to_cam, balance=None) -> Matrix:
    """Camera RGB (with `balance` already applied) to linear Rec.2020."""
    balance = balance or (1.0, 1.0, 1.0, 1.0)
    forward = mul(tuple(tuple(row) for row in xyz_to_cam[:3]), rgb_to_xyz())
    reference = apply(forward, (1.0, 1.0, 1.0))
    if not all(math.isfinite(x) and x > 0 for x in reference):
        raise ValueError("camera reference response must be finite and positive")
    norm = tuple(tuple(x / sum(row) for x in row) for row in forward)
    if not abs(determinant(norm)) > 1e-6:
        raise ValueError("camera matrix is singular")
    gain = [reference[1] / reference[c] / balance[c] for c in range(3)]
    return mul(inverse(norm), diagonal(gain))


def as_shot_white(xyz_to_cam, as_shot_balance) -> tuple[float, float]:
    """Chromaticity of the light that the camera's as-shot gains make neutral."""
    x, y, z = apply(rgb_to_xyz(), apply(camera_matrix(xyz_to_cam, as_shot_balance), (1.0, 1.0, 1.0)))
    return (x / (x + y + z), y / (x + y + z))


def as_shot_balance(as_shot) -> tuple[float, ...]:
    """Gains relative to green; a missing second green takes the first."""
    gains = [*as_shot[:3], as_shot[3] if as_shot[3] > 0 else as_shot[1]]
    out = tuple(g / as_shot[1] if as_shot[1] else math.nan for g in gains)
    if not all(math.isfinite(g) and g > 0 for g in out):
        raise ValueError("as-shot gains must be finite and positive")
    return out


# ---- tone curve ------------------------------------------------------------------------------

GREY = 0.18
# Hue turns of the rendering primaries in degrees, and their inset and outset scales.
TURNS, INSET, OUTSET = (2.0, -1.0, -3.0), (0.9, 0.9, 0.85), (1.0, 1.0, 1.0)


def _edge_distance(angle: float) -> float:
    """Distance from the white to the Rec.2020 triangle along an angle."""
    dx, dy = math.cos(angle), math.sin(angle)
    hits = []
    for i in range(3):
        (ax, ay), (bx, by) = REC2020[i], REC2020[(i + 1) % 3]
        ex, ey = bx - ax, by - ay
        det = dx * -ey + dy * ex
        if det == 0:
            continue
        px, py = ax - D65[0], ay - D65[1]
        t = (px * -ey + py * ex) / det
        u = (dx * py - dy * px) / det
        if t >= 0 and -1e-12 <= u <= 1 + 1e-12:
            hits.append(t)
    return min(hits)


def rendering_primaries(scale) -> tuple:
    out = []
    for i in range(3):
        angle = math.atan2(REC2020[i][1] - D65[1], REC2020[i][0] - D65[0]) + math.radians(TURNS[i])
        t = scale[i] * _edge_distance(angle)
        out.append((D65[0] + t * math.cos(angle), D65[1] + t * math.sin(angle)))
    return tuple(out)


def sigmoid_coefficients(contrast: float, skew: float) -> dict:
    """paper, film and log exposure of the curve, and the matrices around it."""
    paper = 5.0**-skew
    g = GREY ** (1 / paper)
    film = contrast * (1 - GREY) / (paper * (1 - g))
    back = inverse(rgb_to_xyz())
    return {
        "paper": paper,
        "film": film,
        "log_exposure": film * math.log(GREY) + math.log(1 / g - 1),
        "inset": mul(back, rgb_to_xyz(rendering_primaries(INSET), D65)),
        "outset": inverse(mul(back, rgb_to_xyz(rendering_primaries(OUTSET), D65))),
    }


def sigmoid_curve(v: float, k: dict) -> float:
    if v <= 0:
        return 0.0
    z = k["log_exposure"] - k["film"] * math.log(v)
    return math.exp(-k["paper"] * (max(z, 0.0) + math.log1p(math.exp(-abs(z)))))


# ---- output profiles -------------------------------------------------------------------------

# Transfer curves (power, slope, offset, toe slope, toe end) on encoded values.
SRGB_CURVE = (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)
REC2020_CURVE = (1 / 0.45, 1 / 1.099, 0.099 / 1.099, 1 / 4.5, 0.081)
PROFILES = {"srgb": (REC709, SRGB_CURVE), "p3": (P3, SRGB_CURVE), "rec2020": (REC2020, REC2020_CURVE)}


def to_profile(profile: str) -> Matrix:
    """Linear Rec.2020 to a profile's linear RGB (all on D65)."""
    primaries = PROFILES[profile][0]
    if primaries == REC2020:
        return diagonal((1.0, 1.0, 1.0))
    return mul(inverse(rgb_to_xyz(primaries)), rgb_to_xyz())
