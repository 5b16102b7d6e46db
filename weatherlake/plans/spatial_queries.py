"""Queries for O-SP-01..26."""

from pyspark.sql import functions as F

from weatherlake.functions import geo
from weatherlake.functions.tables import BAND_WAVELENGTH, COAST_ANCHORS, COUNTRY_BBOX, LAND_BOXES
from weatherlake.operators import grids, spatial
from weatherlake.operators.grids import Axis
from weatherlake.plans.registry import query
from weatherlake.plans.standins import GRID, POINTS, SITES, grid, points, sites, table


def hav(a, b, c, d):
    return (
        f"(2*6371.0*asin(sqrt(least(pow(sin(radians({c}-({a}))/2),2)+cos(radians({a}))*cos(radians({c}))"
        f"*pow(sin(radians({d}-({b}))/2),2),1.0))))"
    )


@query(
    "sp_haversine",
    "O-SP-01",
    f"select id, {hav('lat', 'lon', '40.0', '(-75.0)')} as km from {POINTS}",
    {"km": 6},
)
def sp_haversine(spark, d):
    return points(spark, d).select(
        "id", geo.haversine(F.col("lat"), F.col("lon"), F.lit(40.0), F.lit(-75.0)).alias("km")
    )


@query(
    "sp_bbox_wrapped",
    "O-SP-02",
    f"select obs_id, lat, lon from {SITES} where lat between -30 and 40 and (lon >= 150 or lon <= -120)",
    {"lat": 6, "lon": 6},
)
def sp_bbox_wrapped(spark, d):
    return spatial.subset_bbox_wrapped(sites(spark, d), 150, -30, 240, 40, zero_to_360=False).select("obs_id", "lat", "lon")


_C = ", ".join(f"('{k}', {a}, {b}, {c}, {e})" for k, (a, b, c, e) in COUNTRY_BBOX.items())


@query(
    "sp_countries",
    "O-SP-03",
    f"""select s.obs_id, c.k as country from {SITES} s join (values {_C}) c(k, a, b, c, d)
 on s.lat >= c.a and s.lat <= c.b and s.lon >= c.c and s.lon <= c.d""",
)
def sp_countries(spark, d):
    return spatial.tag_countries(sites(spark, d)).select("obs_id", "country")


@query(
    "sp_country_subset",
    "O-SP-03",
    f"select obs_id from {SITES} where lat between 24.5 and 49.4 and lon between -125.0 and -66.9",
)
def sp_country_subset(spark, d):
    return spatial.subset_country(sites(spark, d), "us").select("obs_id")


@query(
    "sp_radius_mask",
    "O-SP-04",
    f"""with x as (select *, {hav('33.2', '(-87.3)', 'lat', 'lon')} as km from {GRID}),
 n as (select lat, lon from x order by km, lat, lon limit 1)
 select x.time, x.i, x.j, case when km <= 150 or (n.lat is not null) then v end as v
 from x left join n on x.lat = n.lat and x.lon = n.lon""",
    {"v": 8},
)
def sp_radius_mask(spark, d):
    return spatial.mask_radius(grid(spark, d), 33.2, -87.3, 150.0, "v").select("time", "i", "j", "v")


POLY = [(30.5, -89.5), (36.5, -88.2), (35.1, -83.4), (32.2, -86.1), (30.9, -84.0)]
_RING = [*POLY, POLY[0]]
_CROSS = " + ".join(
    f"(case when (({a} > lat) <> ({b} > lat)) and lon < {x} + (lat - {a})*({y} - ({x}))/({b} - {a}) then 1 else 0 end)"
    for (a, x), (b, y) in zip(_RING, _RING[1:], strict=False)
)


@query(
    "sp_polygon_mask",
    "O-SP-05",
    f"select time, i, j, case when ({_CROSS}) % 2 = 1 then v end as v from {GRID}",
    {"v": 8},
)
def sp_polygon_mask(spark, d):
    inside = spatial.inside_polygon(F.col("lat"), F.col("lon"), POLY)
    return grid(spark, d).select("time", "i", "j", F.when(inside, F.col("v")).alias("v"))


def basins(spark, d):
    """Vertex table of star-shaped polygons, 24 vertices for each supplier."""
    k = F.col("s_suppkey")
    x = table(spark, d, "supplier").select(k.alias("polygon"), F.explode(F.sequence(F.lit(0), F.lit(23))).alias("seq"))
    r = (F.col("polygon") * 7 + F.col("seq") * 13) % 11 + 3.25
    return x.select(
        "polygon",
        "seq",
        ((F.col("polygon") * 37) % 120 - 60 + r * F.cos(F.radians(F.col("seq") * 15.0))).alias("lat"),
        ((F.col("polygon") * 53) % 320 - 160 + r * F.sin(F.radians(F.col("seq") * 15.0))).alias("lon"),
    )


_BASINS = """(select s_suppkey as polygon, seq, (s_suppkey*37)%120 - 60 + ((s_suppkey*7 + seq*13)%11 + 3.25)*cos(radians(seq*15.0)) as lat,
  (s_suppkey*53)%320 - 160 + ((s_suppkey*7 + seq*13)%11 + 3.25)*sin(radians(seq*15.0)) as lon from supplier, (select unnest(range(24)) as seq) q)"""


@query(
    "sp_polygon_table",
    "O-SP-05",
    f"""with e as (select polygon, lat as a, lon as x, lead(lat, 1, first) over w as b, lead(lon, 1, first_lon) over w as y
  from (select *, first_value(lat) over (partition by polygon order by seq) as first, first_value(lon) over (partition by polygon order by seq) as first_lon from {_BASINS})
  window w as (partition by polygon order by seq)),
 c as (select s.obs_id as id, e.polygon, count(*) as n from {SITES} s join e on ((a > s.lat) <> (b > s.lat)) and s.lon < x + (s.lat - a)*(y - x)/(b - a) group by 1, 2)
 select id, polygon from c where n % 2 = 1""",
)
def sp_polygon_table(spark, d):
    """Sites inside polygons that come as a table of vertices."""
    p = sites(spark, d).select(F.col("obs_id").alias("id"), "lat", "lon")
    return spatial.points_in_polygons(p, basins(spark, d))


@query(
    "sp_coordinate_report",
    "O-SP-06",
    """with x as (select case when c_custkey % 50 = 0 then null else c_acctbal/50 end as lat,
  cast((c_custkey*7)%420 as double) - 200 as lon from customer)
 select count(*) as n, count(*) filter (where lat is null) as null_lat, count(*) filter (where lon is null) as null_lon,
 count(*) filter (where lat not between -90 and 90) as bad_lat, count(*) filter (where lon not between -180 and 360) as odd_lon,
 min(case when lat not between -90 and 90 then lat end) as bad_lat_min,
 max(case when lat not between -90 and 90 then lat end) as bad_lat_max, false as valid from x""",
    {"bad_lat_min": 6, "bad_lat_max": 6},
)
def sp_coordinate_report(spark, d):
    k = F.col("c_custkey")
    src = table(spark, d, "customer").select(
        F.when(k % 50 != 0, F.col("c_acctbal") / 50).alias("lat"), ((k * 7) % 420 - 200).cast("double").alias("lon")
    )
    return spatial.coordinate_report(src)


@query(
    "sp_conversions",
    "O-SP-07",
    f"""select id, lat + 120.0/6371.0*(180.0/pi()) as lat2, lon + 80.0/(6371.0*greatest(cos(radians(lat)),1e-10))*(180.0/pi()) as lon2,
 (288.15/0.0065)*(1.0-pow((v+1500)/20/1013.25, 8.31447*0.0065/(9.80665*0.0289644))) as altitude,
 greatest(1013.25*pow(1.0-0.0065*((v+1500)/2)/288.15, (9.80665*0.0289644)/(8.31447*0.0065)),0) as pressure,
 (v+1500)*9/(9.7803253359*(1+0.001931853*pow(sin(radians(lat)),2))/sqrt(1-0.00669438*pow(sin(radians(lat)),2))) as height
 from {POINTS}""",
    {"lat2": 6, "lon2": 6, "altitude": 4, "pressure": 5, "height": 5},
)
def sp_conversions(spark, d):
    v = F.col("v") + 1500
    lat = F.col("lat")
    return points(spark, d).select(
        "id",
        geo.offset_lat(lat, 120.0).alias("lat2"),
        geo.offset_lon(lat, F.col("lon"), 80.0).alias("lon2"),
        geo.pressure_to_altitude(v / 20).alias("altitude"),
        geo.altitude_to_pressure(v / 2).alias("pressure"),
        geo.geopotential_to_height(v * 9, lat).alias("height"),
    )


LAT, LON = Axis(30.0, 1.0, 8), Axis(-90.0, 1.0, 8)


def targets(spark, d):
    """Points in and just around the grid."""
    k = F.col("id")
    return points(spark, d).select(
        k,
        ((k * 37) % 85 / 10.0 + 29.5).alias("lat"),
        ((k * 53) % 85 / 10.0 - 90.5).alias("lon"),
    )


TARGETS = f"""(select id, cast((id*37)%85 as double)/10.0+29.5 as lat, cast((id*53)%85 as double)/10.0-90.5 as lon from {POINTS})"""


def _bilinear_sql(pts, edge):
    if edge:
        ok = "fi >= 0 and fi <= 7 and fj >= 0 and fj <= 7"
    else:
        ok = "fi >= 0 and fi < 7 and fj >= 0 and fj < 7"
    return f"""with p as (select id, (lat-30.0)/1.0 as fi, (lon+90.0)/1.0 as fj from {pts}),
 c as (select id, fi, fj, least(greatest(cast(floor(fi) as bigint),0),6) as i0, least(greatest(cast(floor(fj) as bigint),0),6) as j0
  from p where {ok})
 select g.time, c.id, sum(g.v * (case when g.i = c.i0 then 1-(fi-i0) else fi-i0 end) * (case when g.j = c.j0 then 1-(fj-j0) else fj-j0 end))
  as value from c join {GRID} g on g.i in (c.i0, c.i0+1) and g.j in (c.j0, c.j0+1) group by 1, 2"""


@query("sp_bilinear", "O-SP-09", _bilinear_sql(TARGETS, False), {"value": 6})
def sp_bilinear(spark, d):
    return grids.bilinear(grid(spark, d), targets(spark, d), LAT, LON)


_AX = "(select distinct i, lat from {g})".format(g=GRID)
_AY = "(select distinct j, lon from {g})".format(g=GRID)


@query(
    "sp_nearest",
    "O-SP-08",
    f"""with pi as (select t.id, a.i, row_number() over (partition by t.id order by abs(a.lat - t.lat), a.i) as r from {TARGETS} t, {_AX} a),
 pj as (select t.id, a.j, row_number() over (partition by t.id order by abs(a.lon - t.lon), a.j) as r from {TARGETS} t, {_AY} a)
 select g.time, pi.id, g.v as value from pi join pj on pi.id = pj.id and pi.r = 1 and pj.r = 1
 join {GRID} g on g.i = pi.i and g.j = pj.j""",
    {"value": 8},
)
def sp_nearest(spark, d):
    return grids.nearest(grid(spark, d), targets(spark, d), LAT.values(), LON.values())


def background(spark, d):
    """Points with a smooth background value."""
    return points(spark, d).select("id", "lat", "lon", (F.col("lat") * 10).alias("background"))


@query(
    "sp_cressman",
    "O-SP-10",
    f"""with j as (select p.id, p.lat*10 as bg, s.v, {hav('p.lat', 'p.lon', 's.lat', 's.lon')} as km from {POINTS} p, {SITES} s),
 w as (select id, bg, v, (1000.0*1000-km*km)/(1000.0*1000+km*km) as w from j where km <= 1000.0),
 g as (select id, sum(w*(v-bg))/sum(w) as fix from w group by 1)
 select p.id, p.lat*10 + coalesce(g.fix, 0) as analysis from {POINTS} p left join g on p.id = g.id""",
    {"analysis": 5},
)
def sp_cressman(spark, d):
    return spatial.cressman(background(spark, d), sites(spark, d), 1000.0).select("id", "analysis")


@query(
    "sp_inverse_distance",
    "O-SP-11",
    f"""with p as (select id, lat, lon from {POINTS} union all select 1000000+obs_id, lat, lon from {SITES}),
 j as (select p.id, s.v, s.obs_id, {hav('p.lat', 'p.lon', 's.lat', 's.lon')} as km from p, {SITES} s)
 select id, coalesce(arg_min(v, obs_id) filter (where km = 0), sum(v/(km*km)) filter (where km > 0 and km <= 1500)
  / sum(1/(km*km)) filter (where km > 0 and km <= 1500)) as idw from j group by 1""",
    {"idw": 5},
)
def sp_inverse_distance(spark, d):
    s = sites(spark, d)
    p = points(spark, d).select("id", "lat", "lon").unionByName(
        s.select((F.col("obs_id") + 1000000).alias("id"), "lat", "lon")
    )
    return spatial.inverse_distance(p, s, 1500.0).select("id", "idw")


@query(
    "sp_weighted_to_target",
    "O-SP-12",
    f"""with x as (select *, {hav('lat', 'lon', '33.4', '(-86.7)')} as km from {GRID})
 select time, sum(v/pow(greatest(km,1e-6),2))/sum(1/pow(greatest(km,1e-6),2)) as weighted from x where km <= 300 group by 1""",
    {"weighted": 6},
)
def sp_weighted_to_target(spark, d):
    return spatial.weighted_to_target(grid(spark, d), ["time"], "v", 33.4, -86.7, 300.0)


FINE_LAT, FINE_LON = Axis.spanning(30.0, 37.0, 0.5), Axis.spanning(-90.0, -83.0, 0.5)
_FINE = """(select i*15+j as id, i, j, 30.0+i*0.5 as lat, -90.0+j*0.5 as lon from (select unnest(range(15)) as i) a,
 (select unnest(range(15)) as j) b)"""


@query(
    "sp_grid_cells",
    "O-SP-13",
    f"""select f.id, f.i, f.j, cast(f.lat as double) as lat, cast(f.lon as double) as lon, s.n from
 (select vec_id % 225 as id, count(*) as n from embeddings group by 1) s join {_FINE} f on s.id = f.id""",
    {"lat": 6, "lon": 6},
)
def sp_grid_cells(spark, d):
    n = table(spark, d, "embeddings").groupBy((F.col("vec_id") % 225).alias("id")).agg(F.count("*").alias("n"))
    return grids.regular_grid(spark, FINE_LAT, FINE_LON).join(n, "id")


@query("sp_regrid_bilinear", "O-SP-14", _bilinear_sql(_FINE, True), {"value": 6})
def sp_regrid_bilinear(spark, d):
    return grids.bilinear(grid(spark, d), grids.regular_grid(spark, FINE_LAT, FINE_LON), LAT, LON, include_edge=True)


@query(
    "sp_regrid_nearest",
    "O-SP-14",
    f"""with pi as (select t.i as ti, a.i, row_number() over (partition by t.i order by abs(a.lat - t.lat), a.i) as r
  from (select distinct i, lat from {_FINE}) t, {_AX} a),
 pj as (select t.j as tj, a.j, row_number() over (partition by t.j order by abs(a.lon - t.lon), a.j) as r
  from (select distinct j, lon from {_FINE}) t, {_AY} a)
 select g.time, pi.ti*15+pj.tj as id, g.v as value from pi join {GRID} g on g.i = pi.i and pi.r = 1 join pj on g.j = pj.j and pj.r = 1""",
    {"value": 8},
)
def sp_regrid_nearest(spark, d):
    return grids.nearest(grid(spark, d), grids.regular_grid(spark, FINE_LAT, FINE_LON), LAT.values(), LON.values())


_THIRD = f"""(select ti as i, tj as j, 30.0 + ti*0.4 as lat, -90.0 + tj*0.4 as lon from (select unnest(range(18)) as ti) a, (select unnest(range(18)) as tj) b)"""


@query(
    "sp_regrid_resolution",
    "O-SP-14",
    f"""with p as (select i, j, lat, lon, lat-30.0 as fi, lon+90.0 as fj from {_THIRD}),
 c as (select *, least(cast(floor(fi) as bigint), 6) as i0, least(cast(floor(fj) as bigint), 6) as j0 from p)
 select g.time, c.i, c.j, c.lat, c.lon, sum(g.v * (case when g.i = c.i0 then 1-(fi-i0) else fi-i0 end) * (case when g.j = c.j0 then 1-(fj-j0) else fj-j0 end)) as value
 from c join {GRID} g on g.i in (c.i0, c.i0+1) and g.j in (c.j0, c.j0+1) group by 1, 2, 3, 4, 5""",
    {"value": 6, "lat": 6, "lon": 6},
)
def sp_regrid_resolution(spark, d):
    """A resolution over the extent of the data, whose axes are read from it."""
    return grids.regrid_to_resolution(grid(spark, d), 0.4)


@query(
    "sp_regrid_conservative",
    "O-SP-15",
    f"""with t as (select i, j, 30.5+i*1.5 as lat, -89.5+j*1.5 as lon from (select unnest(range(5)) as i) a, (select unnest(range(5)) as j) b),
 x as (select g.time, t.i, t.j, g.v, greatest(least(g.lat+0.5, t.lat+0.75)-greatest(g.lat-0.5, t.lat-0.75),0)/1.5
  * greatest(least(g.lon+0.5, t.lon+0.75)-greatest(g.lon-0.5, t.lon-0.75),0)/1.5 * cos(radians(g.lat)) as w from {GRID} g, t)
 select time, i, j, sum(v*w)/sum(w) as value from x where w > 0 group by 1, 2, 3""",
    {"value": 6},
)
def sp_regrid_conservative(spark, d):
    return grids.conservative(grid(spark, d), LAT, LON, Axis(30.5, 1.5, 5), Axis(-89.5, 1.5, 5))


_KM = "(6371.0*pi()/180.0)"


def _diff_sql(v, x, part):
    w = f"over (partition by time, {part} order by {x})"
    return (
        f"case when lag({x}) {w} is null then (lead({v}) {w} - {v})/(lead({x}) {w} - {x}) when lead({x}) {w} is null"
        f" then ({v} - lag({v}) {w})/({x} - lag({x}) {w}) else (lead({v}) {w} - lag({v}) {w})/(lead({x}) {w} - lag({x}) {w}) end"
    )


@query(
    "sp_gradient",
    "O-SP-16",
    f"""with g as (select time, i, j, ({_diff_sql('v', 'lon', 'lat')})/({_KM}*cos(radians(lat))) as d_dx,
 ({_diff_sql('v', 'lat', 'lon')})/{_KM} as d_dy from {GRID})
 select *, sqrt(d_dx*d_dx+d_dy*d_dy) as magnitude, atan2(d_dy, d_dx) as direction from g""",
    {"d_dx": 8, "d_dy": 8, "magnitude": 8, "direction": 6},
)
def sp_gradient(spark, d):
    return grids.gradient(grid(spark, d)).drop("lat", "lon", "v")


@query(
    "sp_gradient_fixed",
    "O-SP-16",
    f"""with g as (select time, i, j, ({_diff_sql('v', 'lon', 'lat')})/25.0 as d_dx, ({_diff_sql('v', 'lat', 'lon')})/25.0 as d_dy from {GRID})
 select *, sqrt(d_dx*d_dx+d_dy*d_dy) as magnitude, atan2(d_dy, d_dx) as direction from g""",
    {"d_dx": 8, "d_dy": 8, "magnitude": 8, "direction": 6},
)
def sp_gradient_fixed(spark, d):
    """One spacing for both directions."""
    return grids.gradient(grid(spark, d), dx_km=25.0).drop("lat", "lon", "v")


@query(
    "sp_divergence_fixed",
    "O-SP-17",
    f"""with g as (select time, i, j, lat, lon, v as u, v*v as w from {GRID}),
 d as (select time, i, j, ({_diff_sql('u', 'lon', 'lat')})/25.0 + ({_diff_sql('w', 'lat', 'lon')})/25.0 as divergence from g)
 select *, -divergence as convergence from d""",
    {"divergence": 8, "convergence": 8},
)
def sp_divergence_fixed(spark, d):
    g = grid(spark, d).select("time", "i", "j", "lat", "lon", F.col("v").alias("u"), (F.col("v") ** 2).alias("w"))
    return grids.divergence(g, v="w", dx_km=25.0).select("time", "i", "j", "divergence", "convergence")


@query(
    "sp_divergence",
    "O-SP-17",
    f"""with g as (select time, i, j, lat, lon, v as u, v*v as w from {GRID}),
 d as (select time, i, j, ({_diff_sql('u', 'lon', 'lat')})/({_KM}*cos(radians(lat))) + ({_diff_sql('w', 'lat', 'lon')})/{_KM} as divergence from g)
 select *, -divergence as convergence from d""",
    {"divergence": 8, "convergence": 8},
)
def sp_divergence(spark, d):
    g = grid(spark, d).select("time", "i", "j", "lat", "lon", F.col("v").alias("u"), (F.col("v") ** 2).alias("w"))
    return grids.divergence(g, v="w").select("time", "i", "j", "divergence", "convergence")


_LAND = " or ".join(f"(lat > {a} and lat < {b} and lon > {c} and lon < {e})" for a, b, c, e in LAND_BOXES)
_ANCHOR = ", ".join(hav("lat", "lon", f"{a}", f"({b})") for a, b in COAST_ANCHORS)


@query(
    "sp_coast_distance",
    "O-SP-18",
    f"select obs_id, case when {_LAND} then 0.0 else least({_ANCHOR}, 1000.0) end as km from {SITES}",
    {"km": 5},
)
def sp_coast_distance(spark, d):
    return sites(spark, d).select("obs_id", geo.coast_distance(F.col("lat"), F.col("lon")).alias("km"))


@query(
    "sp_nearest_vertex",
    "O-SP-18",
    f"""select s.obs_id as id, min({hav('s.lat', 's.lon', 'p.lat', 'p.lon')}) filter (where
 {hav('s.lat', 's.lon', 'p.lat', 'p.lon')} <= 2500) as nearest_km from {SITES} s, {POINTS} p group by 1""",
    {"nearest_km": 5},
)
def sp_nearest_vertex(spark, d):
    v = points(spark, d).select(F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    p = sites(spark, d).select(F.col("obs_id").alias("id"), "lat", "lon")
    return spatial.nearest_within(p, v, 2500.0).select("id", "nearest_km")


@query(
    "sp_nearest_any",
    "O-SP-18",
    f"select s.obs_id as id, min({hav('s.lat', 's.lon', 'p.lat', 'p.lon')}) as nearest_km from {SITES} s, {POINTS} p group by 1",
    {"nearest_km": 5},
)
def sp_nearest_any(spark, d):
    """The nearest vertex however far it is."""
    v = points(spark, d).select(F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    return spatial.nearest(sites(spark, d).select(F.col("obs_id").alias("id"), "lat", "lon"), v).select("id", "nearest_km")


@query(
    "sp_stations_near",
    "O-SP-19",
    f"""select obs_id as id, {hav('lat', 'lon', '10.0', '20.0')} as distance_km from {SITES}
 where {hav('lat', 'lon', '10.0', '20.0')} <= 3000 order by 2, 1 limit 10""",
    {"distance_km": 5},
)
def sp_stations_near(spark, d):
    s = sites(spark, d).withColumnRenamed("obs_id", "id")
    return spatial.stations_near(s, 10.0, 20.0, 3000.0, 10).select("id", "distance_km")


def field(spark, d, lat0, dlat, lon0, dlon):
    """Four model runs with a field every six days; longitudes are normalised to -180..180."""
    lon = F.pmod(F.col("j") * dlon + lon0 + 180.0, F.lit(360.0)) - 180.0
    return grid(spark, d).select(
        F.concat(F.lit("r"), F.col("time") % 4).alias("run"),
        F.date_add(F.lit("2000-01-01").cast("date"), (F.floor(F.col("time") / 4) * 6).cast("int")).alias("day"),
        F.col("time").alias("frame"),
        (F.col("i") * dlat + lat0).alias("lat"),
        lon.alias("lon"),
        (F.col("v") * 10 + F.col("i")).alias("v"),
    ).withColumn("time", F.col("day")).drop("day")


def _field_sql(lat0, dlat, lon0, dlon):
    return f"""(select time as frame, 'r' || (time % 4) as run, cast(date '2000-01-01' + cast(time // 4 * 6 as int) as date) as time, lat0 as lat,
  case when lon0 >= 180 then lon0-360 else lon0 end as lon, v*10+i as v from (select time, i, v,
  cast(i*{dlat}+({lat0}) as double) as lat0, cast(j*{dlon}+({lon0}) as double) as lon0 from {GRID}))"""


def _day(df):
    return df.withColumn("time", F.date_format("time", "yyyy-MM-dd"))


_N = _field_sql(-7.0, 2.0, -175.0, 8.0)


@query(
    "sp_nino34",
    "O-SP-20",
    f"""with t as (select run, time, sum(v*cos(radians(lat)))/sum(cos(radians(lat))) as m from {_N}
  where lat between -5 and 5 and lon between -170 and -120 group by 1, 2)
 select run, cast(time as varchar) as time, m - avg(m) over (partition by run, month(time)) as nino34 from t""",
    {"nino34": 6},
)
def sp_nino34(spark, d):
    return _day(grids.nino34(field(spark, d, -7.0, 2.0, -175.0, 8.0), ["run"]))


_A = _field_sql(34.0, 5.0, -26.0, 1.0)


@query(
    "sp_nao",
    "O-SP-21",
    f"""with t as (select run, time, sum(v*cos(radians(lat))) filter (where lat between 36 and 40)/sum(cos(radians(lat))) filter (where lat between 36 and 40)
  - sum(v*cos(radians(lat))) filter (where lat between 63 and 67)/sum(cos(radians(lat))) filter (where lat between 63 and 67) as x
  from {_A} where lon between -22 and -18 group by 1, 2)
 select run, cast(time as varchar) as time, (x - avg(x) over m)/(case when stddev_pop(x) over m > 0 then stddev_pop(x) over m else 1 end) as nao
 from t window m as (partition by run, month(time))""",
    {"nao": 6},
)
def sp_nao(spark, d):
    return _day(grids.nao(field(spark, d, 34.0, 5.0, -26.0, 1.0), ["run"]))


_P = _field_sql(15.0, 6.0, -175.0, 9.0)


@query(
    "sp_pdo",
    "O-SP-22",
    f"""with t as (select run, time, sum(v*cos(radians(lat)))/sum(cos(radians(lat))) as m from {_P}
  where lat between 20 and 60 and lon between -170 and -115 group by 1, 2),
 a as (select run, time, m - avg(m) over (partition by run, month(time)) as a from t)
 select run, cast(time as varchar) as time, a/stddev_pop(a) over (partition by run) as pdo from a""",
    {"pdo": 6},
)
def sp_pdo(spark, d):
    return _day(grids.pdo(field(spark, d, 15.0, 6.0, -175.0, 9.0), ["run"]))


_M = _field_sql(-14.0, 4.0, 40.0, 25.0)


@query(
    "sp_mjo",
    "O-SP-23",
    f"""with x as (select run, time, (v - avg(v) over (partition by run, lat, lon, dayofyear(time)))*cos(radians(lat)) as a from {_M}
  where lat between -10 and 10 and (lon >= 60 or lon <= -150)),
 t as (select run, time, avg(a) as r from x group by 1, 2), s as (select run, time, r/stddev_pop(r) over (partition by run) as r from t)
 select run, cast(time as varchar) as time, r as rmm1, r as rmm2, sqrt(2*r*r) as amplitude,
 cast(case when abs(r) <= 1e-9 then null when r >= 0 then 2 else 6 end as int) as mjo_phase from s""",
    {"rmm1": 6, "rmm2": 6, "amplitude": 6},
)
def sp_mjo(spark, d):
    """Every time step; the phase of one whose index is zero but for rounding is not compared."""
    out = grids.mjo(field(spark, d, -14.0, 4.0, 40.0, 25.0), ["run"])
    return _day(out).withColumn("mjo_phase", F.when(F.abs("rmm1") > 1e-9, F.col("mjo_phase")))


@query(
    "sp_cloud_fraction",
    "O-SP-24",
    f"select time, avg(case when 265 + v*20 < 260 then 1.0 else 0.0 end) as cloud_fraction from {GRID} group by 1",
    {"cloud_fraction": 8},
)
def sp_cloud_fraction(spark, d):
    g = grid(spark, d).select("time", (F.col("v") * 20 + 265).alias("t"))
    return grids.cloud_fraction(g, ["time"], "t")


_BAND = "case b " + " ".join(f"when {k} then {v}" for k, v in BAND_WAVELENGTH.items()) + " else 10.3 end"


@query(
    "sp_brightness_temperature",
    "O-SP-25",
    f"""with x as (select time, i, j, (time + j) % 8 as b, v*900 + 600 as r from {GRID}),
 y as (select time, i, j, cast({_BAND} as double)*1e-6 as wl, case when r < 1000 then greatest(r, 0.1) else r end as r from x)
 select time, i, j, (6.62607015e-34*2.998e8/(1.380649e-23*wl))/(wl*ln(2.0*6.62607015e-34*2.998e8*2.998e8/pow(wl,5)/r + 1.0)) as bt from y""",
    {"bt": -3},
)
def sp_brightness_temperature(spark, d):
    g = grid(spark, d)
    bt = geo.brightness_temperature(F.col("v") * 900 + 600, ((F.col("time") + F.col("j")) % 8).cast("int"))
    return g.select("time", "i", "j", bt.alias("bt"))


@query(
    "sp_cloud_motion",
    "O-SP-26",
    f"""with s as (select unnest(range(-2, 3)) as k),
 b as (select time as frame, i // 4 as block_y, j // 4 as block_x, i as y, j as x, v from {GRID}),
 c as (select b.frame, b.block_y, b.block_x, sy.k as dy, sx.k as dx, corr(b.v, n.v) as c from b, s sy, s sx, {GRID} n
  where n.time = b.frame + 1 and n.i = b.y + sy.k and n.j = b.x + sx.k
  and b.block_y*4 + sy.k between 0 and 4 and b.block_x*4 + sx.k between 0 and 4 group by 1, 2, 3, 4, 5),
 r as (select *, row_number() over (partition by frame, block_y, block_x order by c desc, dy, dx) as r from c)
 select frame, cast(block_y as int) as block_y, cast(block_x as int) as block_x, cast(dx as int) as dx, cast(dy as int) as dy,
 dx*4*0.14 as u_cloud_motion, dy*4*0.14 as v_cloud_motion, greatest(c, 0) as confidence from r where r = 1""",
    {"u_cloud_motion": 6, "v_cloud_motion": 6, "confidence": 6},
)
def sp_cloud_motion(spark, d):
    px = grid(spark, d).select(
        F.col("time").alias("frame"), F.col("i").cast("int").alias("y"), F.col("j").cast("int").alias("x"), "v"
    )
    return grids.cloud_motion(px, 8, 8, block=4, reach=2)
