"""Symmetric 3x3 matrices in closed form, as columns (a, b, c, d, e, f) = xx, xy, xz, yy, yz, zz."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def determinant(a, b, c, d, e, f) -> Column:
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def inverse_trace(a, b, c, d, e, f) -> Column:
    return ((d * f - e * e) + (a * f - c * c) + (a * d - b * b)) / determinant(a, b, c, d, e, f)


def eigenvalues(a, b, c, d, e, f) -> tuple[Column, Column]:
    """(largest, smallest), by the trigonometric formula."""
    off = b * b + c * c + e * e
    q = (a + d + f) / 3.0
    spread = (a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2.0 * off
    p = F.sqrt(spread / 6.0)
    safe = F.when(p > 0, p).otherwise(1.0)
    r = determinant((a - q) / safe, b / safe, c / safe, (d - q) / safe, e / safe, (f - q) / safe) / 2.0
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0
    return q + 2.0 * p * F.cos(phi), q + 2.0 * p * F.cos(phi + F.lit(2.0 * math.pi / 3.0))
