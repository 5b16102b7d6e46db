"""Pressure, cyclone, wind and solar expressions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from weatherlake.functions.tables import (
    BEAUFORT,
    STORM_PROFILE,
    STORM_RAIN_DIAMETER,
    STORM_RAIN_RATE,
    TURBINES,
    lookup,
)

AMBIENT_HPA = 1013.25


def pressure_class(hpa: Column) -> Column:
    # A class holds while the pressure is above the limit.
    limits = ((1000.0, "TD"), (985.0, "TS"), (970.0, "Cat1"), (955.0, "Cat2"), (940.0, "Cat3"), (920.0, "Cat4"))
    out = F.when(hpa.isNull(), F.lit(None).cast("string"))
    for limit, name in limits:
        out = out.when(hpa > limit, name)
    return out.otherwise("Cat5")


def pressure_tendency(before: Column, now: Column) -> Column:
    dp = now - before
    return F.when(dp > 1.0, "rising").when(dp < -1.0, "falling").when(dp.isNotNull(), "steady")


def storm_surge(hpa: Column, forward_kmh: Column, slope: Column) -> Column:
    """Metres: inverse barometer plus a forward-speed term damped by the shelf slope."""
    barometer = (F.lit(AMBIENT_HPA) - hpa) * 100.0 / (1025.0 * 9.81)
    return barometer + forward_kmh * 0.04 * F.tanh(F.lit(1.0) / F.greatest(slope, F.lit(0.01)))


def geostrophic_wind(dp_dx: Column, dp_dy: Column, lat: Column) -> Column:
    """Struct(speed, direction in degrees); at the equator the bare pressure force is returned."""
    rho = 1.225
    f = F.sin(F.radians(lat)) * (2.0 * 7.2921e-5)
    flat = F.abs(f) < 1e-10
    u, v = -dp_dy / (f * rho), dp_dx / (f * rho)
    speed = F.when(flat, F.sqrt(dp_dx * dp_dx + dp_dy * dp_dy) / rho).otherwise(F.sqrt(u * u + v * v))
    angle = F.when(flat, F.atan2(-dp_dx, -dp_dy)).otherwise(F.atan2(u, v))
    return F.struct(speed.alias("speed"), F.pmod(F.degrees(angle), F.lit(360.0)).alias("direction"))


def saffir_simpson(hpa: Column, kmh: Column) -> Column:
    """Category 0..5 from wind, demoted by one (not under 1) when the pressure is too high for it."""
    kt = kmh / 1.852
    # Top wind (kt) and highest plausible pressure (hPa) of categories 1 to 4.
    out = F.when(kt < 64, 0)
    for cat, top, high in ((1, 82, 980), (2, 95, 965), (3, 112, 945), (4, 136, 920)):
        out = out.when(kt <= top, F.when(hpa > high, max(cat - 1, 1)).otherwise(cat))
    return out.when(kt.isNotNull(), 5)


def rapid_intensification(drop_24h: Column, sst: Column, shear: Column) -> Column:
    z = F.lit(-3.94) + drop_24h * 0.14 + sst * 0.13 - shear * 0.15
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def wind_at_radius(category: Column, km: Column) -> Column:
    """Tangential wind (m/s) of a simplified Holland profile; unknown categories use the first one's shape."""
    r_max = lookup(category, STORM_PROFILE, STORM_PROFILE[1][0], 0)
    b = lookup(category, STORM_PROFILE, STORM_PROFILE[1][1], 1)
    x = F.pow(r_max / F.greatest(km, F.lit(0.1)), b * 2.0)
    v2 = b / 1.15 * x * (category * 18.0) * 100.0 * F.exp(-x)
    return F.sqrt(F.greatest(v2, F.lit(0.0)))


def storm_rainfall(category: Column, forward_kmh: Column, hours: Column) -> Column:
    rate, size = lookup(category, STORM_RAIN_RATE, 15.0), lookup(category, STORM_RAIN_DIAMETER, 300.0)
    exposure = F.when(forward_kmh > 0, F.least(size / forward_kmh, hours)).otherwise(hours)
    return F.greatest(rate * exposure, F.lit(0.0))


def turbine_power(ms: Column, turbine: Column, hub_m: Column) -> Column:
    """MW: cubic ramp to rated speed, then flat to cut-out; NULL for unknown turbines.

    Off the 80 m design height the wind is divided by the log-law ratio (roughness 0.03 m).
    """
    ratio = F.log(hub_m / 0.03) / math.log(80.0 / 0.03)
    v = F.when((hub_m != 80.0) & (hub_m > 0), ms / ratio).otherwise(ms)
    rated, cut_in, full, cut_out = (lookup(turbine, TURBINES, field=k) for k in range(4))
    ramp = rated * F.pow((v - cut_in) / (full - cut_in), F.lit(3.0))
    return F.when((v >= cut_in) & (v < full), ramp).when((v >= full) & (v <= cut_out), rated).when(
        rated.isNotNull() & v.isNotNull(), 0.0
    )


def beaufort(ms: Column) -> Column:
    steps = [F.when(ms >= lo, 1).otherwise(0) for lo in BEAUFORT[1:]]
    return F.when(ms.isNotNull(), reduce(lambda a, b: a + b, steps))


def wind_u(ms: Column, direction: Column) -> Column:
    return -ms * F.sin(F.radians(direction))


def wind_v(ms: Column, direction: Column) -> Column:
    return -ms * F.cos(F.radians(direction))


# Spencer's Fourier series: constant, then (cos, sin) pairs of rising harmonics.
EQUATION_OF_TIME = (0.000075, (0.001868, -0.032077), (-0.014615, -0.04089))
DECLINATION = (0.006918, (-0.399912, 0.070257), (-0.006758, 0.000907), (-0.002697, 0.00148))
SOLAR_CONSTANT = 1361.0


def _fourier(b: Column, series: tuple) -> Column:
    out = F.lit(series[0])
    for k, (c, s) in enumerate(series[1:], start=1):
        out = out + F.cos(b * k) * c + F.sin(b * k) * s
    return out


def _unit(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def solar_position(lat_deg: Column, lon: Column, ts: Column) -> Column:
    """Struct(zenith, azimuth, elevation) in degrees at a UTC time."""
    lat = F.radians(lat_deg)
    b = (F.dayofyear(ts) - 1) * (2.0 * math.pi / 365.0)
    decl = _fourier(b, DECLINATION)
    hour = F.hour(ts) + F.minute(ts) / 60.0 + F.floor(F.second(ts)) / 3600.0
    correction = (lon - F.bround(lon / 15.0) * 15.0) * 4.0 + _fourier(b, EQUATION_OF_TIME) * 229.18
    angle = F.radians((F.pmod(hour + correction / 60.0, F.lit(24.0)) - 12.0) * 15.0)
    cos_z = _unit(F.sin(lat) * F.sin(decl) + F.cos(lat) * F.cos(decl) * F.cos(angle))
    zenith = F.degrees(F.acos(cos_z))
    sin_az = F.when(F.abs(cos_z) > 1e-6, -F.cos(decl) * F.sin(angle) / F.cos(lat)).otherwise(0.0)
    cos_az = (F.sin(decl) - F.sin(lat) * cos_z) / (F.cos(lat) * F.sin(F.acos(cos_z)) + 1e-10)
    azimuth = F.pmod(F.degrees(F.atan2(_unit(sin_az), _unit(cos_az))) + 360.0, F.lit(360.0))
    return F.struct(zenith.alias("zenith"), azimuth.alias("azimuth"), (F.lit(90.0) - zenith).alias("elevation"))


def _air_mass(zenith: Column) -> Column:
    z = F.least(zenith, F.lit(90.0))
    return F.lit(1.0) / (F.cos(F.radians(z)) + F.pow(F.lit(96.07995) - z, F.lit(-1.6364)) * 0.50572)


def clear_sky_ghi(zenith: Column, altitude_m: Column, aerosol: Column) -> Column:
    g0 = F.cos(F.radians(zenith)) * SOLAR_CONSTANT
    turbidity = aerosol / (F.exp(-altitude_m / 8500.0) * 0.01 + 0.00196)
    ghi = g0 * F.exp(turbidity * -0.09 * F.pow(_air_mass(zenith), F.lit(0.88)))
    return F.when(g0 <= 0, 0.0).otherwise(F.greatest(ghi, F.lit(0.0)))


def cloudy_ghi(cloud: Column, zenith: Column) -> Column:
    g0 = F.cos(F.radians(zenith)) * SOLAR_CONSTANT
    clear = F.pow(F.lit(0.7), F.pow(_air_mass(zenith), F.lit(0.678)))
    ghi = g0 * (clear * (F.lit(1.0) - cloud) + cloud * 0.20)
    return F.when(g0 <= 0, 0.0).otherwise(F.greatest(ghi, F.lit(0.0)))


def pv_output(ghi: Column, efficiency: float, area_m2: float, t: Column, derating: float = 0.85) -> Column:
    """kW with the nominal-cell-temperature model (45 C, -0.4 % per degree over 25)."""
    cell = t + ghi * (25.0 / 800.0)
    kw = ghi * (area_m2 * efficiency / 1000.0) * (F.lit(1.0) - (cell - 25.0) * 0.004) * derating
    return F.when((ghi <= 0) | F.lit(efficiency <= 0 or area_m2 <= 0), 0.0).otherwise(F.greatest(kw, F.lit(0.0)))
