"""Subsets and radius joins over point and cell tables (O-SP-02..06, 10..12, 18, 19)."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weatherlake.functions.geo import KM_PER_DEGREE, haversine
from weatherlake.functions.tables import COUNTRY_BBOX
from weatherlake.session import materialise

ALIASES = {"lat": ("latitude", "lat", "y"), "lon": ("longitude", "lon", "x")}


def standardize_coords(df: DataFrame) -> DataFrame:
    """Rename latitude|lat|y and longitude|lon|x to lat and lon, the first alias present winning."""
    for name, options in ALIASES.items():
        found = next((o for o in options if o in df.columns), None)
        if found is None:
            raise ValueError(f"no {name} column among {df.columns}")
        if found != name:
            df = df.withColumnRenamed(found, name)
    return df


def in_bbox(lat: Column, lon: Column, south: float, north: float, west: float, east: float) -> Column:
    """Inclusive box test on raw columns, so that it reaches the parquet scan."""
    return lat.between(south, north) & lon.between(west, east)


def subset_bbox_wrapped(
    df: DataFrame, west: float, south: float, east: float, north: float, zero_to_360: bool
) -> DataFrame:
    """Box given in any longitude convention on data in 0..360 or -180..180, across the seam if need be."""
    norm = (lambda x: x % 360) if zero_to_360 else (lambda x: (x + 180) % 360 - 180)
    lo, hi = norm(west), norm(east)
    lon = F.col("lon")
    inside = lon.between(lo, hi) if lo <= hi else (lon >= lo) | (lon <= hi)
    return df.filter(inside & F.col("lat").between(south, north))


def subset_country(df: DataFrame, code: str) -> DataFrame:
    key = code.upper().strip()
    if key not in COUNTRY_BBOX:
        raise ValueError(f"unknown country code {code!r}; known: {sorted(COUNTRY_BBOX)}")
    return df.filter(in_bbox(F.col("lat"), F.col("lon"), *COUNTRY_BBOX[key]))


def tag_countries(df: DataFrame) -> DataFrame:
    """One row per point and matching country box, from a literal array (no join)."""
    boxes = F.array(
        *[
            F.struct(F.lit(k).alias("country"), *[F.lit(float(x)).alias(n) for x, n in zip(v, "abcd", strict=True)])
            for k, v in COUNTRY_BBOX.items()
        ]
    )
    lat, lon = F.col("lat"), F.col("lon")
    hits = F.filter(boxes, lambda b: (lat >= b.a) & (lat <= b.b) & (lon >= b.c) & (lon <= b.d))
    return df.withColumn("country", F.explode(F.transform(hits, lambda b: b.country)))


def mask_radius(df: DataFrame, lat0: float, lon0: float, radius_km: float, value: str) -> DataFrame:
    """Cells out of the radius become NULL; the nearest cell is always kept."""
    d = haversine(F.lit(lat0), F.lit(lon0), F.col("lat"), F.col("lon"))
    nearest = df.agg(F.min(F.struct(d.alias("d"), "lat", "lon")).alias("m")).select(
        F.col("m.lat").alias("lat"), F.col("m.lon").alias("lon"), F.lit(True).alias("_near")
    )
    keep = (d <= radius_km) | F.coalesce("_near", F.lit(False))
    # one row, so the broadcast is bounded
    return (
        df.join(F.broadcast(nearest), ["lat", "lon"], "left")
        .withColumn(value, F.when(keep, F.col(value)))
        .drop("_near")
    )


def inside_polygon(lat: Column, lon: Column, vertices: Sequence[tuple[float, float]]) -> Column:
    """Even-odd test against one polygon of (lat, lon) vertices, closed automatically."""
    if len(vertices) < 3:
        raise ValueError("a polygon needs at least three vertices")
    ring = list(vertices)
    if ring[0] != ring[-1]:
        ring.append(ring[0])
    crossings = F.lit(0)
    for (la, lo), (lb, lp) in zip(ring, ring[1:], strict=False):
        if la == lb:
            continue
        x = F.lit(lo) + (lat - la) * (lp - lo) / (lb - la)
        crossings = crossings + (((F.lit(la) > lat) != (F.lit(lb) > lat)) & (lon < x)).cast("int")
    return crossings % 2 == 1


def polygon_edges(vertices: DataFrame) -> DataFrame:
    """Edges (polygon, a_lat, a_lon, b_lat, b_lon) of closed rings from vertex rows (polygon, seq, lat, lon).

    A ring closes itself; vertices without a place are left out, and so are polygons of fewer than three vertices and
    level edges, which no crossing test needs.
    """
    v = vertices.dropna(subset=["polygon", "seq", "lat", "lon"])
    ring = Window.partitionBy("polygon").orderBy("seq")
    whole = Window.partitionBy("polygon")
    here = F.struct("lat", "lon")
    x = v.select(
        "polygon",
        F.col("lat").alias("a_lat"),
        F.col("lon").alias("a_lon"),
        F.coalesce(F.lead(here).over(ring), F.first(here).over(ring)).alias("_b"),
        F.count("*").over(whole).alias("_n"),
    )
    x = x.filter("_n >= 3").select("polygon", "a_lat", "a_lon", F.col("_b.lat").alias("b_lat"), F.col("_b.lon").alias("b_lon"))
    return x.filter("a_lat <> b_lat")


def points_in_polygons(points: DataFrame, vertices: DataFrame, per_band: int = 16, cell: float = 5.0) -> DataFrame:
    """(id, polygon) for every point (id, lat, lon) inside a polygon of the vertex table, by the even-odd rule.

    Points meet the polygons whose box holds them through an equality join on cells of ``cell`` degrees. A polygon's
    edges lie in latitude bands, as many as give a band about ``per_band`` of them, and a point meets those of its band
    only: it is inside when an odd number of them crosses the ray to the east. Points at one place are tested once.
    """
    edges = polygon_edges(vertices)
    low, high = F.least("a_lat", "b_lat"), F.greatest("a_lat", "b_lat")
    box = edges.groupBy("polygon").agg(
        F.min(low).alias("south"), F.max(high).alias("north"), F.min(F.least("a_lon", "b_lon")).alias("west"),
        F.max(F.greatest("a_lon", "b_lon")).alias("east"), F.ceil(F.count("*") / per_band).alias("bands"),
    )

    def band(lat: Column) -> Column:
        """Never decreasing in the latitude, so an edge's bands are those between its ends'."""
        at = F.floor((lat - F.col("south")) / (F.col("north") - F.col("south")) * F.col("bands"))
        return F.greatest(F.least(at, F.col("bands") - 1), F.lit(0))

    grid = lambda x: F.floor(x / cell)
    tiles = box.withColumn("_r", F.explode(F.sequence(grid(F.col("south")), grid(F.col("north")))))
    tiles = tiles.withColumn("_c", F.explode(F.sequence(grid(F.col("west")), grid(F.col("east")))))
    places = points.dropna(subset=["lat", "lon"]).select("lat", "lon").distinct()
    places = places.withColumns({"_r": grid(F.col("lat")), "_c": grid(F.col("lon"))})
    inside = in_bbox(F.col("lat"), F.col("lon"), F.col("south"), F.col("north"), F.col("west"), F.col("east"))
    near = places.join(tiles, ["_r", "_c"]).filter(inside).select("lat", "lon", "polygon", band(F.col("lat")).alias("_band"))
    parts = edges.join(box, "polygon").withColumn("_band", F.explode(F.sequence(band(low), band(high))))
    parts = parts.select("polygon", "_band", "a_lat", "a_lon", "b_lat", "b_lon")
    lat, lon = F.col("lat"), F.col("lon")
    x = F.col("a_lon") + (lat - F.col("a_lat")) * (F.col("b_lon") - F.col("a_lon")) / (F.col("b_lat") - F.col("a_lat"))
    crossing = ((F.col("a_lat") > lat) != (F.col("b_lat") > lat)) & (lon < x)
    hits = near.join(parts, ["polygon", "_band"]).filter(crossing).groupBy("lat", "lon", "polygon").agg(F.count("*").alias("_n"))
    return points.join(hits.filter("_n % 2 = 1").select("lat", "lon", "polygon"), ["lat", "lon"]).select("id", "polygon")


def coordinate_report(df: DataFrame) -> DataFrame:
    """One row of NULL and range counts with extreme examples; longitude range is only a warning."""
    lat, lon = F.col("lat"), F.col("lon")
    bad_lat, bad_lon = ~lat.between(-90.0, 90.0), ~lon.between(-180.0, 360.0)
    r = df.agg(
        F.count("*").alias("n"),
        F.count_if(lat.isNull()).alias("null_lat"),
        F.count_if(lon.isNull()).alias("null_lon"),
        F.count_if(bad_lat).alias("bad_lat"),
        F.count_if(bad_lon).alias("odd_lon"),
        F.min(F.when(bad_lat, lat)).alias("bad_lat_min"),
        F.max(F.when(bad_lat, lat)).alias("bad_lat_max"),
    )
    ok = (F.col("n") > 0) & (F.col("null_lat") + F.col("null_lon") + F.col("bad_lat") == 0)
    return r.withColumn("valid", ok)


def _cells(lat: Column, size: float) -> Column:
    return F.floor((lat + 90.0) / size)


def radius_join(points: DataFrame, obs: DataFrame, radius_km: float, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of points (lat, lon) and observations (o_lat, o_lon) within the radius, with ``d``.

    Observations sit in one lat/lon cell; a point looks into the cells its radius can touch, including
    across the date line and the poles. The cell equi-join is a sort-merge join, never a cartesian product, and skewed
    cells are split by AQE. It is asked for: Spark's size estimate leaves the copies of a point in several cells out, and
    would gather them in the driver to broadcast them.
    """
    size = min(max(radius_km / KM_PER_DEGREE, 0.05), 30.0)
    n_lon = max(math.floor(360.0 / size), 1)
    width = 360.0 / n_lon  # whole cells around the globe, so indices wrap exactly
    reach = min(radius_km / KM_PER_DEGREE * (1 + 1e-9), 180.0)
    half = math.sin(min(radius_km / (2 * 6371.0), math.pi / 2))
    o = obs.withColumn("_r", _cells(F.col("o_lat"), size)).withColumn(
        "_c", F.pmod(F.floor((F.col("o_lon") + 180.0) / width), F.lit(n_lon))
    )
    lat = F.col("lat")
    rows = F.sequence(
        _cells(F.greatest(lat - reach, F.lit(-90.0)), size), _cells(F.least(lat + reach, F.lit(90.0)), size)
    )
    # widest longitude span of the circle: over a pole it is everything
    edge = F.least(F.abs(lat) + reach, F.lit(90.0))
    ratio = F.lit(half) / F.sqrt(F.greatest(F.cos(F.radians(lat)) * F.cos(F.radians(edge)), F.lit(1e-12)))
    span = F.when(ratio >= 1, 180.0).otherwise(F.degrees(F.asin(ratio)) * 2 * (1 + 1e-9))
    first = F.floor((F.col("lon") - span + 180.0) / width)
    last = F.least(F.floor((F.col("lon") + span + 180.0) / width), first + (n_lon - 1))
    cols = F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(n_lon)))
    p = points.withColumn("_r", F.explode(rows)).withColumn("_c", F.explode(F.array_distinct(cols)))
    d = haversine(F.col("lat"), F.col("lon"), F.col("o_lat"), F.col("o_lon"))
    return p.join(o.hint("merge"), [*by, "_r", "_c"]).withColumn("d", d).filter(F.col("d") <= radius_km).drop("_r", "_c")


def _around(points: DataFrame, obs: DataFrame, radius_km: float, by: Sequence[str], each: Sequence[Column], whole: Sequence[Column]) -> DataFrame:
    """One row per (by, id) with observations in the radius: ``each`` adds them up around a place, ``whole`` over the
    places of an id. Points at one place are searched once, and none is gathered in the driver."""
    places = points.select(*by, "lat", "lon").distinct()
    at = radius_join(places, obs, radius_km, by).groupBy(*by, "lat", "lon").agg(*each)
    found = points.select(*by, "id", "lat", "lon").join(at.hint("merge"), [*by, "lat", "lon"])
    return found.groupBy(*by, "id").agg(*whole)


def _at_location(obs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Observations at one location collapse first: their distance, and so their weight, is the same."""
    return (
        obs.dropna(subset=["lat", "lon", "v"])
        .groupBy(*by, F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
        .agg(F.sum("v").alias("o_sum"), F.count("*").alias("o_n"), F.min_by("v", "obs_id").alias("o_first"))
    )


def cressman(points: DataFrame, obs: DataFrame, radius_km: float = 200.0, by: Sequence[str] = ()) -> DataFrame:
    """Background corrected by distance-weighted observation departures.

    ``points`` carry id, lat, lon and ``background``; w = (R2 - d2) / (R2 + d2). Points without
    observations, or with zero total weight, keep the background.
    """
    r2 = radius_km**2
    w = (F.lit(r2) - F.col("d") * F.col("d")) / (F.lit(r2) + F.col("d") * F.col("d"))
    each = [F.sum(w * F.col("o_sum")).alias("_s"), F.sum(w * F.col("o_n")).alias("_w")]
    g = _around(points, _at_location(obs, by), radius_km, by, each, [F.sum("_s").alias("_s"), F.sum("_w").alias("_w")])
    out = points.join(g.hint("merge"), [*by, "id"], "left")
    fix = F.when(F.col("_w") != 0, F.col("_s") / F.col("_w") - F.col("background")).otherwise(0.0)
    return out.withColumn("analysis", F.col("background") + F.coalesce(fix, F.lit(0.0))).drop("_s", "_w")


def inverse_distance(points: DataFrame, obs: DataFrame, max_km: float, power: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """IDW over observations up to ``max_km``; a point on an observation takes that value (lowest obs_id)."""
    w = F.when(F.col("d") > 0, F.lit(1.0) / F.pow("d", F.lit(power)))
    hit = F.max(F.when(F.col("d") == 0, F.col("o_first"))).alias("_hit")
    each = [hit, F.sum(w * F.col("o_sum")).alias("_s"), F.sum(w * F.col("o_n")).alias("_w")]
    whole = [F.max("_hit").alias("_hit"), (F.sum("_s") / F.sum("_w")).alias("_idw")]
    g = _around(points, _at_location(obs, by), max_km, by, each, whole)
    return points.join(g.hint("merge"), [*by, "id"], "left").withColumn("idw", F.coalesce("_hit", "_idw")).drop("_hit", "_idw")


def nearest_within(points: DataFrame, vertices: DataFrame, max_km: float) -> DataFrame:
    """Distance to the nearest vertex table row (o_lat, o_lon) up to ``max_km``, else NULL; rings as in ``nearest``."""
    hits = points.select("id", "lat", "lon").join(_rings(points, vertices, min(25.0, max_km), max_km).hint("merge"), ["lat", "lon"])
    g = hits.groupBy("id").agg(F.min("nearest_km").alias("nearest_km"))
    return points.join(g.hint("merge"), "id", "left")


def nearest(points: DataFrame, vertices: DataFrame, first_km: float = 25.0) -> DataFrame:
    """Distance to the nearest vertex (o_lat, o_lon), however far, as ``nearest_km``; NULL without vertices."""
    hits = _rings(points, vertices, first_km, math.pi * 6371.0 * 1.001)
    return points.join(hits.hint("merge"), ["lat", "lon"], "left").select(*points.columns, "nearest_km")


def _rings(points: DataFrame, vertices: DataFrame, first_km: float, last_km: float) -> DataFrame:
    """(lat, lon, nearest_km) for the places of points with a vertex within ``last_km``.

    Rings grow by two: a round joins the circle of its radius for the points that no smaller circle answered, and keeps
    one minimum per point. A point so meets about as many vertices as lie within twice the distance of its nearest.
    Points and vertices at one place are searched once.
    """
    v = vertices.dropna(subset=["o_lat", "o_lon"]).select("o_lat", "o_lon").distinct()
    open_places = materialise(points.dropna(subset=["lat", "lon"]).select("lat", "lon").distinct(), "ring-points")
    found, radius = [], first_km
    while True:
        hit = radius_join(open_places, v, min(radius, last_km)).groupBy("lat", "lon").agg(F.min("d").alias("nearest_km"))
        hit = materialise(hit, "ring-hits")
        found.append(hit)
        if radius >= last_km:
            break
        open_places = materialise(open_places.join(hit, ["lat", "lon"], "left_anti"), "ring-points")
        if open_places.isEmpty():
            break
        radius *= 2
    return reduce(DataFrame.unionAll, found)


def weighted_to_target(
    df: DataFrame, keys: Sequence[str], value: str, lat0: float, lon0: float, max_km: float = 500.0, power: float = 2.0
) -> DataFrame:
    """Distance-weighted average of cells near one target per key; keys without a cell in range are absent."""
    d = haversine(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0))
    deg = max_km / KM_PER_DEGREE * (1 + 1e-9)
    near = df.filter(F.col("lat").between(lat0 - deg, lat0 + deg)).withColumn("_d", d).filter(F.col("_d") <= max_km)
    w = F.lit(1.0) / F.pow(F.greatest("_d", F.lit(1e-6)), F.lit(power))
    return near.groupBy(*keys).agg(
        F.when(F.count(value) == F.count("*"), F.sum(F.col(value) * w) / F.sum(w)).alias("weighted")
    )


def stations_near(df: DataFrame, lat0: float, lon0: float, radius_km: float = 50.0, limit: int = 10) -> DataFrame:
    d = haversine(F.col("lat"), F.col("lon"), F.lit(lat0), F.lit(lon0))
    return df.withColumn("distance_km", d).filter(F.col("distance_km") <= radius_km).orderBy("distance_km", "id").limit(limit)
