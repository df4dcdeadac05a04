"""Spherical coordinates, distances and radial scaling on a sphere."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasphere import EARTH_RADIUS
from terrasphere.functions.vec import V3, num, ratio

HALF_PI = math.pi / 2
TWO_PI = math.pi * 2


def cart_to_sph(p: V3) -> tuple[Column, Column]:
    """(lon, lat) in radians; the length of p does not matter."""
    return F.atan2(p.y, p.x), F.lit(HALF_PI) - F.acos(ratio(p.z, p.norm()))


def sph_to_cart(lon, lat, r=1.0) -> V3:
    lon, lat, r = num(lon), num(lat), num(r)
    return V3(r * F.cos(lon) * F.cos(lat), r * F.sin(lon) * F.cos(lat), r * F.sin(lat))


def haversine(lon1, lat1, lon2, lat2, r=EARTH_RADIUS) -> Column:
    lon1, lat1, lon2, lat2 = map(num, (lon1, lat1, lon2, lat2))
    sy = F.sin((lat2 - lat1) * 0.5)
    sx = F.sin((lon2 - lon1) * 0.5)
    a = sy * sy + F.cos(lat1) * F.cos(lat2) * sx * sx
    return num(r) * 2.0 * F.atan2(F.sqrt(a), F.sqrt(F.greatest(1.0 - a, F.lit(0.0))))


def to_radians(*deg: Column) -> tuple[Column, ...]:
    return tuple(F.radians(d) for d in deg)


def to_degrees(*rad: Column) -> tuple[Column, ...]:
    return tuple(F.degrees(r) for r in rad)


def geodetic_to_cart(lon_deg, lat_deg, elev, radius=EARTH_RADIUS) -> V3:
    return sph_to_cart(F.radians(num(lon_deg)), F.radians(num(lat_deg)), num(radius) + num(elev))


def cart_to_geodetic(p: V3, radius=EARTH_RADIUS) -> tuple[Column, Column, Column]:
    """(lon degrees, lat degrees, elevation)."""
    lon, lat = cart_to_sph(p)
    return F.degrees(lon), F.degrees(lat), p.norm() - num(radius)


def to_scaled(p: V3, vertical_scale, radius=EARTH_RADIUS) -> V3:
    """Exaggerate the offset of p from the sphere along its radius."""
    foot = p * ratio(radius, p.norm())
    return (p - foot) * num(vertical_scale) + foot


def to_unscaled(p: V3, vertical_scale, radius=EARTH_RADIUS) -> V3:
    foot = p * ratio(radius, p.norm())
    return (p - foot).over(vertical_scale) + foot


def slerp(p0: V3, p1: V3, t) -> V3:
    t = num(t)
    omega = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), p0.unit().dot(p1.unit()))))
    return p0 * ratio(F.sin((1.0 - t) * omega), F.sin(omega)) + p1 * ratio(F.sin(t * omega), F.sin(omega))


def rotate_axis(axis: V3, angle, p: V3) -> V3:
    """Right-handed rotation of p about a unit axis."""
    angle = num(angle)
    c, s = F.cos(angle), F.sin(angle)
    return p * c + axis.cross(p) * s + axis * (axis.dot(p) * (1.0 - c))


def unwrap_lonlat(ring: Column, periodic_lat: bool = False) -> Column:
    """Unwrap an ordered array<struct<lon,lat>> so that consecutive vertices are near.

    A vertex at a pole takes the longitude before it, and leaving a pole inserts a
    pole vertex at the new longitude, as needed for planar polygon tests.
    """
    eps = 1e-5
    typ = "array<struct<lon:double,lat:double>>"

    def at_pole(lat):
        return F.abs(F.lit(HALF_PI) - F.abs(lat)) < eps

    def nearest(v, anchor):
        other = F.when(v > anchor, v - TWO_PI).otherwise(v + TWO_PI)
        return F.when(F.abs(other - anchor) < F.abs(v - anchor), other).otherwise(v)

    def vertex(lon, lat):
        return F.struct(lon.alias("lon"), lat.alias("lat"))

    def step(acc, v):
        last = F.element_at(acc, -1)
        lon0, lat = v.getField("lon"), v.getField("lat")
        lon = F.when(at_pole(lat), last.getField("lon")).otherwise(nearest(lon0, last.getField("lon")))
        if periodic_lat:
            lat = nearest(lat, last.getField("lat"))
        leaving = at_pole(last.getField("lat"))
        added = F.when(
            leaving, F.array(vertex(lon, last.getField("lat")), vertex(lon, lat))
        ).otherwise(F.array(vertex(lon, lat)))
        return F.when(F.size(acc) == 0, F.array(vertex(lon0, v.getField("lat")))).otherwise(
            F.concat(acc, added)
        ).cast(typ)

    return F.aggregate(ring, F.array().cast(typ), step)
