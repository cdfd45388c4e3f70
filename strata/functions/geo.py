"""Positions on the WGS 84 ellipsoid as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from strata import params as P

GEODESIC_ROUNDS = 5  # a round gains a factor of 300, so five settle any distance below a centimetre's thousandth


def radii(lat: Column) -> tuple[Column, Column]:
    """(meridional, prime vertical) radii of curvature at a latitude."""
    s = F.sin(F.radians(lat))
    w = 1 - P.WGS84_E2 * s * s
    return P.WGS84_A * (1 - P.WGS84_E2) / F.pow(w, F.lit(1.5)), P.WGS84_A / F.sqrt(w)


def to_local(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(east, north) metres on the plane that touches the ellipsoid at the origin."""
    meridional, vertical = radii(lat0)
    return F.radians(lon - lon0) * vertical * F.cos(F.radians(lat0)), F.radians(lat - lat0) * meridional


def from_local(east: Column, north: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    meridional, vertical = radii(lat0)
    return lat0 + F.degrees(north / meridional), lon0 + F.degrees(east / (vertical * F.cos(F.radians(lat0))))


def flat_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> tuple[Column, Column]:
    """(east, north) with constant metres per degree: the site-scale approximation."""
    return (lon - lon0) * P.M_PER_DEG_LON_EQUATOR * F.cos(F.radians(lat0)), (lat - lat0) * P.M_PER_DEG_LAT


def _bind(value: Column, body) -> Column:
    """Compute `value` once and hand it to `body` by name, so the expression tree stays small."""
    return F.element_at(F.transform(F.array(value), body), 1)


def geodesic_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Vincenty's inverse distance: a fold of a fixed number of rounds over the longitude difference."""
    a, f = P.WGS84_A, P.WGS84_F
    b = a * (1 - f)
    u1, u2 = F.atan((1 - f) * F.tan(F.radians(lat1))), F.atan((1 - f) * F.tan(F.radians(lat2)))
    ends = F.struct(
        F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"),
        F.radians(lon2 - lon1).alias("length"),
    )

    def arc(e: Column, lam: Column) -> Column:
        across = e["c2"] * F.sin(lam)
        up = e["c1"] * e["s2"] - e["s1"] * e["c2"] * F.cos(lam)
        return F.struct(
            F.sqrt(across * across + up * up).alias("sin"),
            (e["s1"] * e["s2"] + e["c1"] * e["c2"] * F.cos(lam)).alias("cos"),
            (e["c1"] * e["c2"] * F.sin(lam)).alias("azimuth"),
        )

    def azimuth(e: Column, s: Column) -> Column:
        sin_a = F.when(s["sin"] > 0, s["azimuth"] / s["sin"]).otherwise(0.0)
        return F.struct(s["sin"].alias("sin"), s["cos"].alias("cos"), sin_a.alias("sin_a"), (1 - sin_a * sin_a).alias("cos2_a"))

    def middle(e: Column, s: Column) -> Column:
        m = F.when(s["cos2_a"] > 1e-15, s["cos"] - 2 * e["s1"] * e["s2"] / s["cos2_a"]).otherwise(0.0)
        return s.withField("mid", m)

    def solve(e: Column, lam: Column, body) -> Column:
        return _bind(arc(e, lam), lambda s: _bind(azimuth(e, s), lambda t: _bind(middle(e, t), body)))

    def next_longitude(e: Column, s: Column) -> Column:
        c = f / 16 * s["cos2_a"] * (4 + f * (4 - 3 * s["cos2_a"]))
        inner = s["mid"] + c * s["cos"] * (2 * s["mid"] * s["mid"] - 1)
        return e["length"] + (1 - c) * f * s["sin_a"] * (F.atan2(s["sin"], s["cos"]) + c * s["sin"] * inner)

    def metres(s: Column) -> Column:
        u = s["cos2_a"] * ((a**2 - b**2) / b**2)
        big_a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        big_b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        sin, cos, mid = s["sin"], s["cos"], s["mid"]
        bend = cos * (2 * mid * mid - 1) - big_b / 6 * mid * (4 * sin * sin - 3) * (4 * mid * mid - 3)
        return b * big_a * (F.atan2(sin, cos) - big_b * sin * (mid + big_b / 4 * bend))

    rounds = F.sequence(F.lit(1), F.lit(GEODESIC_ROUNDS))
    distance = _bind(
        ends,
        lambda e: F.aggregate(
            rounds, e["length"], lambda lam, _i: solve(e, lam, lambda s: next_longitude(e, s)),
            lambda lam: solve(e, lam, metres),
        ),
    )
    return F.when((lat1 == lat2) & (lon1 == lon2), 0.0).otherwise(distance)


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6).cast("int") + 1
    return F.when(lat >= 0, 32600).otherwise(32700) + zone


def circle_ring(lon: Column, lat: Column, radius_m: Column, steps: int = 48) -> Column:
    """A closed ring of lon/lat points around a position."""
    dlat = radius_m / P.M_PER_DEG_LON_EQUATOR
    dlon = radius_m / (P.M_PER_DEG_LON_EQUATOR * F.cos(F.radians(lat)))
    return F.transform(
        F.sequence(F.lit(0), F.lit(steps)),
        lambda i: F.struct(
            (lon + dlon * F.cos(i * (2 * math.pi / steps))).alias("lon"),
            (lat + dlat * F.sin(i * (2 * math.pi / steps))).alias("lat"),
        ),
    )


def heading_deg(east: Column, north: Column) -> Column:
    """Heading modulo 180: either way of walking a line counts the same."""
    raw = F.degrees(F.atan2(north, east))
    return F.when(raw < 0, raw + 180).when(raw >= 180, raw - 180).otherwise(raw)
