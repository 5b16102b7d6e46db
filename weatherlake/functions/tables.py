"""Reference tables. All of them are fixed values that results depend on, in natural order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Country code -> (lat_min, lat_max, lon_min, lon_max).
COUNTRY_BBOX = {
    "AF": (29.4, 38.5, 60.5, 74.9),
    "AL": (39.6, 42.7, 19.3, 21.1),
    "DZ": (19.0, 37.1, -8.7, 11.9),
    "AR": (-55.1, -21.8, -73.6, -53.6),
    "AU": (-44.0, -10.0, 112.9, 154.3),
    "AT": (46.4, 49.0, 9.5, 17.2),
    "BD": (20.6, 26.6, 88.0, 92.7),
    "BE": (49.5, 51.5, 2.5, 6.4),
    "BR": (-33.8, 5.3, -74.0, -34.8),
    "CA": (41.7, 83.1, -141.0, -52.6),
    "CL": (-56.0, -17.5, -75.6, -66.9),
    "CN": (18.2, 53.6, 73.6, 134.8),
    "CO": (-4.2, 12.5, -79.0, -66.9),
    "HR": (42.4, 46.6, 13.5, 19.4),
    "CZ": (48.6, 51.1, 12.1, 18.9),
    "DK": (54.6, 57.8, 8.1, 15.2),
    "EG": (22.0, 31.7, 24.7, 37.0),
    "FI": (59.8, 70.1, 20.5, 31.6),
    "FR": (42.3, 51.1, -5.1, 9.6),
    "DE": (47.3, 55.1, 5.9, 15.0),
    "GR": (34.8, 41.7, 19.4, 29.7),
    "HU": (45.7, 48.6, 16.1, 22.9),
    "IS": (63.3, 66.6, -24.5, -13.5),
    "IN": (6.8, 35.5, 68.2, 97.4),
    "ID": (-11.0, 5.9, 95.0, 141.0),
    "IR": (25.1, 39.8, 44.1, 63.3),
    "IQ": (29.1, 37.4, 38.8, 48.6),
    "IE": (51.4, 55.4, -10.5, -6.0),
    "IL": (29.5, 33.3, 34.3, 35.9),
    "IT": (36.6, 47.1, 6.6, 18.5),
    "JP": (24.2, 45.5, 122.9, 154.0),
    "JO": (29.2, 33.4, 34.9, 39.3),
    "KE": (-4.7, 5.0, 33.9, 41.9),
    "KR": (33.1, 38.6, 125.9, 129.6),
    "MX": (14.5, 32.7, -118.4, -86.7),
    "MA": (27.7, 35.9, -13.2, -0.6),
    "NL": (50.8, 53.7, 3.4, 7.2),
    "NZ": (-47.3, -34.4, 165.8, 178.6),
    "NG": (4.3, 13.9, 2.7, 14.7),
    "NO": (58.0, 71.2, 4.6, 31.1),
    "PK": (23.7, 37.1, 60.9, 77.8),
    "PE": (-18.3, -0.0, -81.3, -68.7),
    "PH": (4.6, 21.1, 116.9, 127.1),
    "PL": (49.0, 54.8, 14.1, 24.2),
    "PT": (36.9, 42.2, -9.5, -6.2),
    "RO": (43.6, 48.3, 20.3, 29.7),
    "RU": (41.2, 81.8, 27.5, 169.0),
    "SA": (16.4, 32.2, 34.6, 55.7),
    "ZA": (-34.8, -22.1, 16.5, 32.9),
    "ES": (36.0, 43.8, -9.3, 4.3),
    "SE": (55.3, 69.1, 11.1, 24.2),
    "CH": (45.8, 47.8, 5.9, 10.5),
    "TW": (21.9, 25.3, 120.2, 121.9),
    "TH": (5.6, 20.5, 97.3, 105.6),
    "TR": (35.8, 42.1, 25.7, 44.8),
    "UA": (44.4, 52.4, 22.1, 40.2),
    "AE": (22.6, 26.1, 51.6, 56.4),
    "GB": (49.9, 58.7, -8.2, 1.8),
    "US": (24.5, 49.4, -125.0, -66.9),
    "VE": (0.6, 12.2, -73.4, -59.8),
    "VN": (8.5, 23.4, 102.1, 109.5),
}

# Boxes taken as land (lat_lo, lat_hi, lon_lo, lon_hi), open on every side.
LAND_BOXES = (
    (15, 72, -130, -60),
    (25, 50, -10, 40),
    (-40, 15, -20, 55),
    (-10, 20, 95, 140),
    (20, 55, 60, 145),
    (-45, -10, 110, 155),
    (-5, 10, -85, -60),
)

# Coastal anchor points (lat, lon) of the coarse ocean distance.
COAST_ANCHORS = (
    (35.0, -75.0),
    (40.0, -70.0),
    (45.0, -65.0),
    (50.0, -55.0),
    (55.0, -50.0),
    (60.0, -40.0),
    (25.0, 10.0),
    (30.0, 10.0),
    (35.0, 10.0),
    (40.0, 10.0),
)

# Imager band -> central wavelength in micrometres; other bands use 10.3.
BAND_WAVELENGTH = {2: 3.9, 3: 6.2, 4: 10.3, 5: 12.3, 6: 13.3}

# Turbine -> (rated MW, cut-in, rated, cut-out m/s, rotor m).
TURBINES = {
    "vestas_v110": (2.0, 3.0, 12.0, 25.0, 110.0),
    "vestas_v90": (2.0, 4.0, 12.0, 25.0, 90.0),
    "siemens_swift": (3.0, 3.5, 13.0, 25.0, 101.0),
    "generic_2mw": (2.0, 3.0, 12.0, 25.0, 80.0),
}

# Beaufort number n starts at this wind speed (m/s).
BEAUFORT = (0.0, 0.5, 1.6, 3.4, 5.5, 8.0, 10.8, 13.9, 17.2, 20.8, 24.5, 28.5, 32.7)

# Storm category -> (radius of maximum wind km, profile exponent).
STORM_PROFILE = {1: (60.0, 1.0), 2: (50.0, 1.2), 3: (40.0, 1.4), 4: (30.0, 1.6), 5: (25.0, 1.8)}

# Storm category -> peak rain rate mm/h, rain diameter km, supply disruption share.
STORM_RAIN_RATE = {1: 15.0, 2: 25.0, 3: 40.0, 4: 60.0, 5: 90.0}
STORM_RAIN_DIAMETER = {1: 300.0, 2: 350.0, 3: 400.0, 4: 500.0, 5: 600.0}
STORM_DISRUPTION = {1: 0.05, 2: 0.15, 3: 0.35, 4: 0.60, 5: 0.90}

# Power market -> share of wind generation; other markets use 0.10.
WIND_SHARE = {"ERCOT": 0.30, "PJM": 0.08, "CAISO": 0.12, "MISO": 0.10, "NYISO": 0.05, "ISO_NE": 0.06}

# Instrument -> (name, exchange, tick, contract size, margin share, commission per contract).
INSTRUMENTS = {
    "OJ_FUTURES": ("Orange Juice Futures", "ICE", 0.05, 15000.0, 0.10, 2.50),
    "NG_FUTURES": ("Natural Gas Futures", "NYMEX", 0.001, 10000.0, 0.08, 1.25),
    "CL_FUTURES": ("Crude Oil WTI Futures", "NYMEX", 0.01, 1000.0, 0.07, 1.50),
    "ZC_FUTURES": ("Corn Futures", "CBOT", 0.25, 5000.0, 0.06, 1.25),
    "ZS_FUTURES": ("Soybean Futures", "CBOT", 0.25, 5000.0, 0.07, 1.25),
    "ZW_FUTURES": ("Wheat Futures", "CBOT", 0.25, 5000.0, 0.06, 1.25),
    "HE_FUTURES": ("Lean Hogs Futures", "CME", 0.025, 40000.0, 0.08, 1.75),
    "LE_FUTURES": ("Live Cattle Futures", "CME", 0.025, 40000.0, 0.07, 1.75),
    "ERCOT_FUTURES": ("ERCOT Power Futures", "ERCOT", 0.01, 1000.0, 0.10, 3.00),
    "PJM_FUTURES": ("PJM Power Futures", "PJM", 0.01, 1000.0, 0.10, 3.00),
    "CAT_BONDS": ("Catastrophe Bond Index", "OTC", 0.001, 100000.0, 0.15, 10.00),
}


def lookup(key: Column, table: dict, default: float | None = None, field: int | None = None) -> Column:
    """Value of a fixed table as an expression, so no join is planned for it."""
    pick = (lambda v: v) if field is None else (lambda v: v[field])
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(pick(v)))])
    got = F.try_element_at(m, key)
    return got if default is None else F.coalesce(got, F.lit(default))
