"""Colour and range expressions over value columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Luma weights, sRGB to XYZ (D65) matrix, white point, CIELAB limits.
LUMA = (0.299, 0.587, 0.114)
RGB_TO_XYZ = (
    (0.412453, 0.357580, 0.180423),
    (0.212671, 0.715160, 0.072169),
    (0.019334, 0.119193, 0.950227),
)
XYZ_TO_RGB = (
    (3.240479, -1.53715, -0.498535),
    (-0.969256, 1.875991, 0.041556),
    (0.055648, -0.204043, 1.057311),
)
WHITE = (0.950456, 1.0, 1.088754)
LAB_EDGE = 0.008856
LAB_SLOPE = 7.787


def grey(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def brightest(*channels: Column) -> Column:
    return F.greatest(*channels)


def clip(v: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.least(F.greatest(v, F.lit(float(lo))), F.lit(float(hi)))


def to_u8(v: Column) -> Column:
    """Unit range to whole numbers 0..255, truncating."""
    return F.floor(clip(v) * 255.0).cast("double")


def to_unit(v: Column) -> Column:
    return v / 255.0


def invert(v: Column, top: float = 255.0) -> Column:
    return F.lit(top) - v


def _linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def _encoded(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(1.055 * F.pow(c, F.lit(1 / 2.4)) - 0.055)


def rgb_to_lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """Unit-range sRGB to CIELAB (L in 0..100)."""
    rgb = [_linear(c) for c in (r, g, b)]
    f = []
    for row, white in zip(RGB_TO_XYZ, WHITE):
        t = sum(m * c for m, c in zip(row, rgb)) / white
        f.append(F.when(t > LAB_EDGE, F.cbrt(t)).otherwise(LAB_SLOPE * t + 16.0 / 116.0))
    return {"l": 116.0 * f[1] - 16.0, "a": 500.0 * (f[0] - f[1]), "b": 200.0 * (f[1] - f[2])}


def lab_to_rgb(l: Column, a: Column, b: Column) -> dict[str, Column]:
    fy = (l + 16.0) / 116.0
    xyz = []
    for f, white in zip((fy + a / 500.0, fy, fy - b / 200.0), WHITE):
        cubed = f * f * f
        xyz.append(
            F.when(cubed > LAB_EDGE, cubed).otherwise((f - 16.0 / 116.0) / LAB_SLOPE) * white
        )
    linear = [sum(m * c for m, c in zip(row, xyz)) for row in XYZ_TO_RGB]
    return {n: clip(_encoded(F.greatest(c, F.lit(0.0)))) for n, c in zip("rgb", linear)}
