"""Geodesy on columns: WGS84, ECEF and local frames."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from skylattice.consts import METERS_PER_DEGREE, WGS84_A, WGS84_E2


def _d(x: float) -> Column:
    return F.lit(float(x))


def wgs84_to_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    return _ecef(F.sin(phi), F.cos(phi), F.sin(lam), F.cos(lam), alt)


def _ecef(sin_phi: Column, cos_phi: Column, sin_lam: Column, cos_lam: Column, alt: Column) -> tuple[Column, Column, Column]:
    n = _d(WGS84_A) / F.sqrt(1 - _d(WGS84_E2) * sin_phi * sin_phi)
    return (n + alt) * cos_phi * cos_lam, (n + alt) * cos_phi * sin_lam, (n * _d(1 - WGS84_E2) + alt) * sin_phi


def _each(f, angles: pa.Array) -> pa.Array:
    """Null stays null, and what isn't finite has no sine or cosine."""
    values = angles.to_numpy(zero_copy_only=False)
    finite, out = np.isfinite(values), np.full(len(values), np.nan)
    out[finite] = [f(v) for v in values[finite].tolist()]
    return pa.array(out, mask=angles.is_null().to_numpy(zero_copy_only=False))


@F.arrow_udf(StructType().add("sin", "double").add("cos", "double"))
def _library(angles: pa.Array) -> pa.Array:
    return pa.StructArray.from_arrays([_each(math.sin, angles), _each(math.cos, angles)], ["sin", "cos"])


def library_ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """wgs84_to_ecef() with sines and cosines of the C library, for distances held against a limit that they may
    meet exactly. The JVM's differ in the last place for some one value in 700."""
    phi, lam = _library(F.radians(lat)), _library(F.radians(lon))
    return _ecef(phi["sin"], phi["cos"], lam["sin"], lam["cos"], alt)


def ecef_to_wgs84(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Ten fixed iterations of the latitude; the altitude by the polar formula where the cosine vanishes."""
    p = F.sqrt(x * x + y * y)
    radius = lambda phi: _d(WGS84_A) / F.sqrt(1 - _d(WGS84_E2) * F.sin(phi) * F.sin(phi))
    start = F.atan2(z, p * _d(1 - WGS84_E2))
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(10)), start, lambda f, _: F.atan2(z + _d(WGS84_E2) * radius(f) * F.sin(f), p))
    flat = F.abs(F.cos(phi)) > 1e-10
    alt = F.when(flat, p / F.cos(phi) - radius(phi)).otherwise(F.abs(z) - _d(WGS84_A) * F.sqrt(_d(1 - WGS84_E2)))
    return F.degrees(phi), F.degrees(F.atan2(y, x)), alt


def distance(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> Column:
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def ecef_to_enu(v: tuple[Column, Column, Column], lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """A velocity's east, north and up parts at a place."""
    phi, lam = F.radians(lat), F.radians(lon)
    vx, vy, vz = v
    east = -F.sin(lam) * vx + F.cos(lam) * vy
    north = -F.sin(phi) * F.cos(lam) * vx - F.sin(phi) * F.sin(lam) * vy + F.cos(phi) * vz
    up = F.cos(phi) * F.cos(lam) * vx + F.cos(phi) * F.sin(lam) * vy + F.sin(phi) * vz
    return east, north, up


def degrees_per_second(east: Column, north: Column, lat: Column) -> tuple[Column, Column]:
    """(latitude, longitude) degrees a second."""
    narrow = F.greatest(F.abs(F.cos(F.radians(lat))), _d(1e-9))
    return north / _d(METERS_PER_DEGREE), east / (_d(METERS_PER_DEGREE) * narrow)
