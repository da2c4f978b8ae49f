"""Column expressions shared by the operators. All arithmetic is in double."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def site(row: Column, col: Column) -> Column:
    """Place in the 2x2 cell, row-major."""
    return (row % 2 * 2 + col % 2).cast("int")


def cfa_color(row: Column, col: Column, phase: int) -> Column:
    """0 red, 1 green, 2 blue for the phases 0 RGGB, 1 GRBG, 2 GBRG, 3 BGGR."""
    y, x = (row + phase // 2) % 2, (col + phase) % 2
    return F.when(y == x, y * 2).otherwise(1).cast("int")


def by_site(values, row: Column, col: Column) -> Column:
    """One of four values (literals or columns) by site."""
    values = [v if isinstance(v, Column) else F.lit(float(v)) for v in values]
    return F.element_at(F.array(*values), site(row, col) + 1)


def at_least(v: Column, limit: Column) -> Column:
    """v >= limit as IEEE has it: false for NaN."""
    return ~F.isnan(v) & (v >= limit)


def positive(v: Column) -> Column:
    """max(v, 0) that turns NaN into 0."""
    return F.when(~F.isnan(v) & (v > 0), v).otherwise(F.lit(0.0))


def matrix3(m, r: Column, g: Column, b: Column) -> list[Column]:
    return [F.lit(row[0]) * r + F.lit(row[1]) * g + F.lit(row[2]) * b for row in m]


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def encode_curve(v: Column, curve) -> Column:
    """Linear 0..1 to encoded values."""
    power, slope, offset, toe, end = curve
    return F.when(v <= end * toe, v / toe).otherwise((F.pow(v, F.lit(1 / power)) - offset) / slope)
