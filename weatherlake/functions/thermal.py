"""Temperature and precipitation expressions (NULL in, NULL out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published coefficients of the Rothfusz regression, NWS form, in Fahrenheit and percent.
ROTHFUSZ = (
    -42.379,
    2.04901523,
    10.14333127,
    -0.22475541,
    -0.00683783,
    -0.05481717,
    0.00122874,
    0.00085282,
    -0.00000199,
)


def hdd(t: Column, base: float = 18.3) -> Column:
    return F.when(t.isNotNull(), F.greatest(F.lit(base) - t, F.lit(0.0)))


def cdd(t: Column, base: float = 18.3) -> Column:
    return F.when(t.isNotNull(), F.greatest(t - F.lit(base), F.lit(0.0)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def gdd(t: Column, base: float = 10.0, cap: float = 30.0) -> Column:
    return clip(t, base, cap) - F.lit(base)


def gdd_seasonal(t_max: Column, base: float = 10.0, cap: float = 30.0) -> Column:
    """Season sum term max(0, min(T, cap) - base); use inside ``sum``."""
    return F.when(t_max.isNotNull(), F.greatest(F.least(t_max, F.lit(cap)) - base, F.lit(0.0)))


def to_fahrenheit(t: Column) -> Column:
    return t * 9.0 / 5.0 + 32.0


def heat_index(t: Column, rh: Column) -> Column:
    """Steadman's simple form below 27 C or 40 %, else Rothfusz with the humid adjustment."""
    f = to_fahrenheit(t)
    c = ROTHFUSZ
    simple = F.lit(0.5) * (f + 61.0 + (f - 68.0) * 1.2 + rh * 0.094)
    full = (
        F.lit(c[0])
        + f * c[1]
        + rh * c[2]
        + f * rh * c[3]
        + f * f * c[4]
        + rh * rh * c[5]
        + f * f * rh * c[6]
        + f * rh * rh * c[7]
        + f * f * rh * rh * c[8]
    )
    humid = (rh > 85.0) & f.between(80.0, 87.0)
    full = full + F.when(humid, (rh - 85.0) / 10.0 * ((F.lit(87.0) - f) / 5.0)).otherwise(0.0)
    return (F.when((t < 27.0) | (rh < 40.0), simple).otherwise(full) - 32.0) * 5.0 / 9.0


def wind_chill(t: Column, kmh: Column) -> Column:
    v = F.pow(kmh, F.lit(0.16))
    return F.when((t > 10.0) | (kmh < 4.8), t).otherwise(
        F.lit(13.12) + t * 0.6215 - v * 11.37 + t * v * 0.3965
    )


def snow_share(t: Column, threshold: float = 0.0) -> Column:
    """1 at or below the threshold, falling to 0 over two degrees."""
    return clip((F.lit(threshold + 2.0) - t) / 2.0, 0.0, 1.0)
