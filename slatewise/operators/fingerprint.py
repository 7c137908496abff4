"""Image fingerprints from arrays of pixels: average hash, DCT hash and colour moments.

Grids of some 64 values stay in SQL expressions; decoded images of many thousand pixels go through
Arrow in sources/images.py.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x) / F.size(values)


def _bits(flags: Column) -> Column:
    """Bits of an array of booleans, the first lowest."""
    parts = F.transform(flags, lambda f, i: F.when(f, F.expr("1L")).otherwise(F.expr("0L")))
    shifted = F.zip_with(parts, F.sequence(F.lit(0), F.size(flags) - 1), lambda x, i: F.call_function("shiftleft", x, i))
    return F.aggregate(shifted, F.expr("0L"), lambda acc, x: acc.bitwiseOR(x))


def average_hash(values: Column) -> Column:
    """Bit i is set where value i is above the mean."""
    return F.element_at(F.transform(F.array(mean(values)), lambda m: _bits(F.transform(values, lambda x: x > m))), 1)


def dct(values: Column, side: int = 8) -> Column:
    """Unscaled DCT-II of a side x side grid, row by row."""
    cos = [[math.cos(math.pi * (2 * x + 1) * u / (2 * side)) for x in range(side)] for u in range(side)]
    basis = F.split(F.lit(",".join(repr(cos[u][y] * cos[v][x]) for u in range(side) for v in range(side) for y in range(side) for x in range(side))), ",").cast("array<double>")
    n = side * side
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.aggregate(F.zip_with(values, F.slice(basis, k * n + 1, F.lit(n)), lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x),
    )


def dct_hash(values: Column, side: int = 8) -> Column:
    """Bit i is set where coefficient i is above the upper middle of all but the first."""
    n = side * side
    return F.element_at(
        F.transform(
            F.array(F.transform(dct(values, side), lambda x: F.round(x, 6))),
            lambda c: F.element_at(
                F.transform(F.array(F.element_at(F.sort_array(F.slice(c, F.lit(2), F.lit(n - 1))), (n - 1) // 2 + 1)), lambda m: _bits(F.transform(c, lambda x: x > m))), 1
            ),
        ),
        1,
    )


def moments(values: Column) -> Column:
    """Mean, population deviation and cube root of the third central moment."""

    def around(m: Column) -> Column:
        second = mean(F.transform(values, lambda x: (x - m) * (x - m)))
        third = mean(F.transform(values, lambda x: (x - m) * (x - m) * (x - m)))
        return F.array(m, F.sqrt(second), F.cbrt(third))

    return F.element_at(F.transform(F.array(mean(values)), around), 1)


def background(pixels: Column) -> Column:
    """white if an opaque pixel is darker than white or none is opaque, else black; pixels: array<struct<value, alpha>>."""
    opaque = F.filter(pixels, lambda p: p["alpha"] > 10)
    return F.when(F.exists(opaque, lambda p: p["value"] < 240), "white").when(F.size(opaque) > 0, "black").otherwise("white")
