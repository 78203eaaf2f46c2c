"""Colour expressions: sRGB channels (0 to 255) to OKLab and OKLCH, and distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The OKLab matrices (linear sRGB to cone responses, cube roots of these to Lab).
TO_LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
TO_LAB = ((0.2104542553, 0.793617785, -0.0040720468), (1.9779984951, -2.428592205, 0.4505937099), (0.0259040371, 0.7827717662, -0.808675766))


def linear(channel: Column) -> Column:
    x = channel / F.lit(255.0)
    return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))


def oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    rgb = [linear(c) for c in (r, g, b)]
    lms = [F.cbrt(sum((F.lit(k) * c for k, c in zip(row[1:], rgb[1:])), F.lit(row[0]) * rgb[0])) for row in TO_LMS]
    return tuple(F.lit(row[0]) * lms[0] + F.lit(row[1]) * lms[1] + F.lit(row[2]) * lms[2] for row in TO_LAB)


def hex_colour(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(c.cast("long")), 2, "0")) for c in (r, g, b)])
