"""Spherical geometry, barometric and radiance expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weatherlake.functions.tables import BAND_WAVELENGTH, COAST_ANCHORS, LAND_BOXES, lookup

EARTH_KM = 6371.0
KM_PER_DEGREE = EARTH_KM * math.pi / 180.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lon2 - lon1) / 2), 2
    )
    return F.asin(F.sqrt(F.least(a, F.lit(1.0)))) * (2 * EARTH_KM)


def offset_lat(lat: Column, north_km: float) -> Column:
    return lat + north_km / EARTH_KM * (180.0 / math.pi)


def offset_lon(lat: Column, lon: Column, east_km: float) -> Column:
    return lon + F.lit(east_km) / (F.greatest(F.cos(F.radians(lat)), F.lit(1e-10)) * EARTH_KM) * (180.0 / math.pi)


# Standard atmosphere (K/m, K, hPa, m/s2, kg/mol, J/(mol K)).
LAPSE, SEA_TEMP, SEA_HPA, GRAVITY, AIR_MOLAR, GAS = 0.0065, 288.15, 1013.25, 9.80665, 0.0289644, 8.31447


def pressure_to_altitude(hpa: Column) -> Column:
    """Metres; NULL for pressures that are not positive."""
    e = GAS * LAPSE / (GRAVITY * AIR_MOLAR)
    return F.when(hpa > 0, (F.lit(1.0) - F.pow(hpa / SEA_HPA, F.lit(e))) * (SEA_TEMP / LAPSE))


def altitude_to_pressure(m: Column) -> Column:
    e = GRAVITY * AIR_MOLAR / (GAS * LAPSE)
    return F.greatest(F.pow(F.lit(1.0) - m * LAPSE / SEA_TEMP, F.lit(e)) * SEA_HPA, F.lit(0.0))


def geopotential_to_height(phi: Column, lat: Column) -> Column:
    """Metres, with normal gravity at the latitude."""
    s2 = F.pow(F.sin(F.radians(lat)), 2)
    g = (F.lit(1.0) + s2 * 0.001931853) * 9.7803253359 / F.sqrt(F.lit(1.0) - s2 * 0.00669438)
    return phi / g


def coast_distance(lat: Column, lon: Column, coastline: list[tuple[float, float]] | None = None) -> Column:
    """Distance to the nearest coastline vertex; without one, 0 on land boxes, else to coarse anchors (max 1000).

    The vertices become literals, so their number is limited; for larger coastlines use ``spatial.nearest`` on a
    vertex table.
    """
    if coastline is not None:
        if len(coastline) > 5000:
            raise ValueError("over 5000 vertices: use spatial.nearest with a vertex table")
        return F.least(*_distances(lat, lon, coastline))
    boxes = [(lat > a) & (lat < b) & (lon > c) & (lon < d) for a, b, c, d in LAND_BOXES]
    land = boxes[0]
    for b in boxes[1:]:
        land = land | b
    return F.when(land, 0.0).otherwise(F.least(*_distances(lat, lon, COAST_ANCHORS), F.lit(1000.0)))


def _distances(lat: Column, lon: Column, vertices) -> list[Column]:
    out = [haversine(lat, lon, F.lit(float(a)), F.lit(float(b))) for a, b in vertices]
    return out if len(out) > 1 else out * 2


# Planck constant, speed of light as rounded in the source data, Boltzmann constant.
PLANCK, LIGHT, BOLTZMANN = 6.62607015e-34, 2.998e8, 1.380649e-23


def brightness_temperature(radiance: Column, band: Column) -> Column:
    """Inverse Planck by band; radiances under 1000 are floored at 0.1.

    The wavelength divides twice, as in the original, so the result is a monotone index, not kelvin.
    """
    wl = lookup(band, BAND_WAVELENGTH, 10.3) * 1e-6
    r = F.when(radiance < 1000, F.greatest(radiance, F.lit(0.1))).otherwise(radiance)
    c1 = F.lit(2.0 * PLANCK * LIGHT**2) / F.pow(wl, F.lit(5.0))
    c2 = F.lit(PLANCK * LIGHT) / (wl * BOLTZMANN)
    return c2 / (wl * F.log(c1 / r + 1.0))
