"""Scalar operators as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOXEL, SEED = 40, 200
ORIGIN = {"x": -400, "y": -350, "z": 800}
BOX = {"x": (-400, 400), "y": (-350, 250), "z": (800, 1300)}


def cell(axis: str, size: int = VOXEL) -> Column:
    return F.floor((F.col(axis) - ORIGIN[axis]) / float(size))


def cells(size: int = VOXEL, prefix: str = "k") -> list[Column]:
    return [cell(a, size).alias(prefix + a) for a in "xyz"]


def packed(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("int"), 16).bitwiseOR(F.shiftleft(g.cast("int"), 8)).bitwiseOR(b.cast("int"))


def unpacked(rgb: Column) -> list[Column]:
    return [F.shiftright(rgb, s).bitwiseAND(255) for s in (16, 8, 0)]


# fixed values of the colour conversion: white point, exponent, offset and slope
WHITE, EXPONENT, OFFSET, SLOPE, KNEE = (95.047, 100.0, 108.883), 0.3333, 0.138, 7.787, 0.008856
TO_XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))


def lab(r: Column, g: Column, b: Column) -> list[Column]:
    """L, a, b of colours from 0 to 255, which enter as they are; L is capped at 100, then all are scaled to about one."""
    scaled = [sum(w * c for w, c in zip(row, (r, g, b), strict=True)) / n for row, n in zip(TO_XYZ, WHITE, strict=True)]
    fx, fy, fz = (F.when(v > KNEE, F.pow(v, F.lit(EXPONENT))).otherwise(v * SLOPE + OFFSET) for v in scaled)
    return [F.least(fy * 116 - 16, F.lit(100.0)) / 100, F.least(F.greatest((fx - fy) * 500, F.lit(-300.0)), F.lit(300.0)) / 300, F.least((fy - fz) * 200, F.lit(300.0)) / 300]


def feature_distance(a: dict[str, Column], b: dict[str, Column], seed: float = SEED, color: float = 0.2, spatial: float = 0.4, normal: float = 1.0) -> Column:
    """Of two voxels with x y z, r g b and nx ny nz."""
    norm = lambda names: F.sqrt(sum((a[n] - b[n]) * (a[n] - b[n]) for n in names))
    dot = sum(a[n] * b[n] for n in ("nx", "ny", "nz"))
    return (1 - F.abs(dot)) * normal + norm("rgb") / 255 * color + norm("xyz") / seed * spatial


def change(n: list[Column], before: list[Column]) -> Column:
    return 1 - sum(a * b for a, b in zip(n, before, strict=True))


def changed(n: list[Column], before: list[Column], threshold: float = 0.2) -> Column:
    return change(n, before) >= threshold


def transformed(t: list[float], x: Column, y: Column, z: Column) -> list[Column]:
    """By a 3 x 4 matrix in rows."""
    return [t[4 * i] * x + t[4 * i + 1] * y + t[4 * i + 2] * z + t[4 * i + 3] for i in range(3)]
