import numpy as np
import pytest
from pyspark.sql import functions as F

from weatherlake.functions import geo
from weatherlake.operators import grids, spatial
from weatherlake.operators.grids import Axis


def hav(a, b, c, d):
    a, b, c, d = map(np.radians, (a, b, c, d))
    h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((d - b) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(h, 1)))


@pytest.mark.parametrize("radius", [40.0, 700.0, 4000.0, 20037.6])
def test_radius_join_is_exact_at_seam_and_poles(spark, radius):
    rng = np.random.default_rng(4)
    p = np.c_[rng.uniform(-90, 90, 60), rng.uniform(-180, 180, 60)]
    p[:8] = [[89.9, 0], [-90, 10], [10, 180], [10, -180], [0, 179.99], [85, -179], [90, 77], [-89, -60]]
    o = np.c_[rng.uniform(-90, 90, 300), rng.uniform(-180, 180, 300)]
    o[:4] = [[89.95, 180], [10, 179.9], [-89.99, -170], [0, -179.99]]
    ps = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, lat double, lon double")
    os_ = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(o)], "o long, o_lat double, o_lon double")
    got = sorted((r.id, r.o) for r in spatial.radius_join(ps, os_, radius).select("id", "o").collect())
    d = hav(p[:, None, 0], p[:, None, 1], o[None, :, 0], o[None, :, 1])
    assert got == sorted((int(i), int(j)) for i, j in np.argwhere(d <= radius))


def test_cressman_without_observations_keeps_background(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 7.0), (2, 50.0, 0.0, 3.0)], "id long, lat double, lon double, background double")
    o = spark.createDataFrame([(1, 0.5, 0.0, 9.0), (2, 0.5, 0.0, 11.0)], "obs_id long, lat double, lon double, v double")
    out = {r.id: r.analysis for r in spatial.cressman(p, o, 200.0).collect()}
    assert out == {1: pytest.approx(10.0), 2: 3.0}


def test_polygon_needs_three_vertices():
    with pytest.raises(ValueError):
        spatial.inside_polygon(F.lit(0.0), F.lit(0.0), [(0, 0), (1, 1)])


def test_many_large_polygons_from_a_table(spark):
    """1,000 polygons of 1,000 vertices each: no expression grows with them, and sampled points agree with the formula."""
    n, m = 1000, 1000
    k, q = F.col("polygon"), F.col("seq")
    r = F.lit(2.0) + F.sin(q * (k % 7 + 3) * 2 * np.pi / m)
    v = spark.range(n * m).select((F.col("id") / m).cast("long").alias("polygon"), (F.col("id") % m).alias("seq"))
    v = v.select("polygon", "seq", (k % 40 * 3 - 60 + r * F.cos(q * 2 * np.pi / m)).alias("lat"), ((k / 40).cast("long") * 10 - 120 + r * F.sin(q * 2 * np.pi / m)).alias("lon"))
    rng = np.random.default_rng(2)
    at = np.c_[rng.uniform(-64, 62, 400), rng.uniform(-125, 135, 400)]
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)], "id long, lat double, lon double")
    out = spatial.points_in_polygons(points, v)
    assert len(out._jdf.queryExecution().analyzed().toString()) < 30_000
    got = sorted((r.id, r.polygon) for r in out.collect())
    p = np.arange(n)
    dy, dx = at[:, None, 0] - (p % 40 * 3 - 60), at[:, None, 1] - (p // 40 * 10 - 120)
    angle = np.arctan2(dx, dy) % (2 * np.pi)
    edge = 2.0 + np.sin(angle * (p % 7 + 3))
    far = np.abs(np.hypot(dx, dy) - edge) > 1e-3  # points too near a border for the formula are left to rounding
    want = {(int(i), int(j)) for i, j in np.argwhere(np.hypot(dx, dy) < edge)}
    assert far[tuple(np.array(sorted(want)).T)].all() and got == sorted(want) and len(got) > 100


def test_polygon_table_equals_the_literal_test(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 3.0), (4.0, 3.0), (4.0, 4.0), (0.0, 4.0)]
    rows = [("u", i, a, b) for i, (a, b) in enumerate(ring)] + [("two", 0, 0.0, 0.0), ("two", 1, 5.0, 5.0), ("u", None, 9.0, 9.0)]
    v = spark.createDataFrame(rows, "polygon string, seq int, lat double, lon double")
    at = [(i, float(a), float(b)) for i, (a, b) in enumerate((a / 2, b / 2) for a in range(-1, 10) for b in range(-1, 10))]
    p = spark.createDataFrame([*at, (999, None, 1.0), (998, 0.5, 0.5), (998, 0.5, 0.5)], "id long, lat double, lon double")
    literal = p.filter(spatial.inside_polygon(F.col("lat"), F.col("lon"), ring)).select("id")
    for per_band in (1, 16):
        got = spatial.points_in_polygons(p, v, per_band, cell=2.0).collect()
        assert {r.polygon for r in got} == {"u"} and sorted(r.id for r in got) == sorted(r.id for r in literal.collect())


def test_nearest_however_far(spark):
    rng = np.random.default_rng(5)
    p = np.r_[np.c_[rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80)], [[10.0, 20.0]] * 3]
    v = np.r_[np.c_[rng.normal(10, 0.01, 300), rng.normal(20, 0.01, 300)], [[-80.0, 179.0], [10.0, 20.0]]]
    ps = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)] + [(-1, None, 0.0)], "id long, lat double, lon double")
    vs = spark.createDataFrame([(float(a), float(b)) for a, b in v], "o_lat double, o_lon double")
    got = {r.id: r.nearest_km for r in spatial.nearest(ps, vs).collect()}
    want = hav(p[:, None, 0], p[:, None, 1], v[None, :, 0], v[None, :, 1]).min(1)
    assert got.pop(-1) is None
    np.testing.assert_allclose([got[i] for i in range(len(p))], want, atol=1e-6)
    assert {r.nearest_km for r in spatial.nearest(ps, vs.limit(0)).collect()} == {None}


def test_unknown_country(spark):
    with pytest.raises(ValueError):
        spatial.subset_country(spark.createDataFrame([(0.0, 0.0)], "lat double, lon double"), "XX")


def test_zero_to_360_box(spark):
    df = spark.createDataFrame([(0.0, float(x)) for x in (0, 10, 170, 190, 350)], "lat double, lon double")
    got = [r.lon for r in spatial.subset_bbox_wrapped(df, -20, -5, 15, 5, True).orderBy("lon").collect()]
    assert got == [0, 10, 350]


def test_coordinate_aliases(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "latitude double, x double")
    assert spatial.standardize_coords(df).columns == ["lat", "lon"]


def test_axis_keeps_end_within_half_step():
    assert Axis.spanning(0, 1, 0.25).n == 5 and Axis.spanning(0, 1.1, 0.25).n == 5 and Axis.spanning(0, 1.13, 0.25).n == 6


def cells(spark, v):
    rows = [(0, i, j, float(i), float(j), None if np.isnan(v[i, j]) else float(v[i, j])) for i in range(v.shape[0]) for j in range(v.shape[1])]
    return spark.createDataFrame(rows, "time long, i long, j long, lat double, lon double, v double")


def test_bilinear_edges_and_missing_corner(spark):
    v = np.arange(16.0).reshape(4, 4)
    v[3, 3] = np.nan
    p = spark.createDataFrame([(1, 1.5, 1.25), (2, 3.0, 0.0), (3, 2.5, 2.5), (4, -0.1, 1.0)], "id long, lat double, lon double")
    ax = Axis(0.0, 1.0, 4)
    point = {r.id: r.value for r in grids.bilinear(cells(spark, v), p, ax, ax).collect()}
    edge = {r.id: r.value for r in grids.bilinear(cells(spark, v), p, ax, ax, include_edge=True).collect()}
    assert point == {1: pytest.approx(7.25), 3: None}
    assert edge == {1: pytest.approx(7.25), 2: pytest.approx(12.0), 3: None}


def test_conservative_keeps_constants(spark):
    out = grids.conservative(cells(spark, np.full((6, 6), 3.5)), Axis(0, 1, 6), Axis(0, 1, 6), Axis(0.5, 1.7, 3), Axis(0.5, 1.7, 3))
    np.testing.assert_allclose(out.toPandas().value, 3.5)


def test_cloud_motion_finds_the_shift(spark):
    rng = np.random.default_rng(0)
    big = rng.normal(size=(40, 40))
    a, b = big[10:26, 10:26], big[8:24, 11:27]
    rows = [(f, y, x, float(m[y, x])) for f, m in ((0, a), (1, b)) for y in range(16) for x in range(16)]
    px = spark.createDataFrame(rows, "frame long, y int, x int, v double")
    out = grids.cloud_motion(px, 16, 16, block=8, reach=3).toPandas()
    got = {(r.block_y, r.block_x): (r.dx, r.dy) for r in out.itertuples() if r.confidence > 0.99}
    assert got and set(got.values()) == {(-1, 2)}


def test_coast_distance(spark):
    r = spark.range(1).select(
        geo.coast_distance(F.lit(40.0), F.lit(-100.0)).alias("land"),
        geo.coast_distance(F.lit(-60.0), F.lit(-150.0)).alias("far"),
        geo.coast_distance(F.lit(0.0), F.lit(0.0), [(0.0, 1.0), (5.0, 5.0)]).alias("own"),
    ).first()
    assert r.land == 0.0 and r.far == 1000.0 and r.own == pytest.approx(111.19, abs=0.01)


def broadcasts(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("strategy=broadcast") + df._jdf.queryExecution().sparkPlan().toString().count("BroadcastHashJoin")


def test_points_of_one_place_are_searched_once_and_none_is_broadcast(spark):
    """Many ids at few places: the searched rows are places, and no exploded side is gathered in the driver."""
    p = spark.range(4000).select("id", (F.col("id") % 4 * 10).cast("double").alias("lat"), F.lit(1.0).alias("lon"))
    o = spark.createDataFrame([(1, 0.0, 0.0, 4.0), (2, 0.0, 2.0, 8.0), (3, 10.0, 1.0, 5.0), (0, 10.0, 1.0, 6.0)], "obs_id long, lat double, lon double, v double")
    out = spatial.inverse_distance(p, o, 500.0)
    assert broadcasts(out) == 0
    got = {r.lat: (r.n, r.lo, r.hi) for r in out.groupBy("lat").agg(F.count("*").alias("n"), F.min("idw").alias("lo"), F.max("idw").alias("hi")).collect()}
    assert got == {0.0: (1000, pytest.approx(6.0), pytest.approx(6.0)), 10.0: (1000, 6.0, 6.0), 20.0: (1000, None, None), 30.0: (1000, None, None)}
    assert broadcasts(spatial.cressman(p.withColumn("background", F.lit(0.0)), o, 500.0)) == 0


def test_an_id_at_several_places_adds_them_up(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 0.0, 3.0), (None, 0.0, 0.0), (2, None, 0.0)], "id long, lat double, lon double")
    o = spark.createDataFrame([(1, 0.0, 1.0, 4.0), (2, 0.0, 4.0, 8.0)], "obs_id long, lat double, lon double, v double")
    got = sorted((r.id or 0, r.idw) for r in spatial.inverse_distance(p, o, 150.0).collect())
    assert got == [(0, None), (1, pytest.approx(6.0)), (1, pytest.approx(6.0)), (2, None)]
    v = o.select(F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"))
    km = float(hav(0.0, 0.0, 0.0, 1.0))
    near = sorted((r.id or 0, r.nearest_km) for r in spatial.nearest_within(p, v, 150.0).collect() if r.nearest_km is not None)
    assert near == [(1, pytest.approx(km)), (1, pytest.approx(km))]


@pytest.mark.parametrize("limit", [10.0, 60.0, 3000.0])
def test_nearest_within_agrees_with_all_pairs(spark, limit):
    rng = np.random.default_rng(6)
    p = np.c_[rng.uniform(-90, 90, 200), rng.uniform(-180, 180, 200)]
    v = np.c_[rng.uniform(-90, 90, 150), rng.uniform(-180, 180, 150)]
    v[:20] = p[:20] + 0.05
    p[:2], v[:2] = [[89.9, 0], [10, 180]], [[89.95, 170], [10, -179.99]]
    ps = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "id long, lat double, lon double")
    vs = spark.createDataFrame([(float(a), float(b)) for a, b in v], "o_lat double, o_lon double")
    got = {r.id: r.nearest_km for r in spatial.nearest_within(ps, vs, limit).collect()}
    best = hav(p[:, None, 0], p[:, None, 1], v[None, :, 0], v[None, :, 1]).min(1)
    assert len(got) == 200
    for i, d in enumerate(best):
        assert got[i] == (pytest.approx(d, abs=1e-6) if d <= limit else None)


def test_nearest_within_leaves_far_vertices_unjoined(spark, monkeypatch):
    """A point with a vertex close by is not joined to those within the limit."""
    radii = []
    join = spatial.radius_join
    monkeypatch.setattr(spatial, "radius_join", lambda p, o, r, by=(): radii.append(r) or join(p, o, r, by))
    p = spark.createDataFrame([(1, 0.0, 0.0)], "id long, lat double, lon double")
    v = spark.createDataFrame([(0.0, 0.1), (0.0, 9.0)], "o_lat double, o_lon double")
    assert spatial.nearest_within(p, v, 2500.0).first().nearest_km == pytest.approx(float(hav(0.0, 0.0, 0.0, 0.1)))
    assert radii == [25.0]


def test_bilinear_keeps_the_product_out_of_shuffles(spark):
    """Values per frame and point come straight from the join; an id that occurs twice counts eight corners, so NULL."""
    v = np.arange(16.0).reshape(4, 4)
    ax = Axis(0.0, 1.0, 4)
    p = spark.createDataFrame([(1, 1.5, 1.25), (2, 0.5, 2.5), (3, 0.5, 0.5), (3, 1.5, 0.5), (None, 0.25, 0.0)], "id long, lat double, lon double")
    frames = cells(spark, v).drop("time").crossJoin(spark.range(50).withColumnRenamed("id", "time"))
    out = grids.bilinear(frames, p, ax, ax)
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append(r.value)
    assert got == {1: [pytest.approx(7.25)] * 50, 2: [pytest.approx(4.5)] * 50, 3: [None] * 50, None: [pytest.approx(1.0)] * 50}
    single = grids.bilinear(frames, p.filter("id < 3"), ax, ax)
    plan = single._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join")]
    assert "Aggregate" not in above


def test_nearest_gathers_no_points_and_keeps_the_product(spark):
    """Every frame meets every point, rows without a frame or with repeated ids too; no side is broadcast."""
    ax = Axis(0.0, 1.0, 4)
    p = spark.createDataFrame([(1, 1.5, 1.25), (2, 0.4, 9.0), (2, 3.0, 3.0), (None, 0.25, 0.0)], "id long, lat double, lon double")
    frames = cells(spark, np.arange(16.0).reshape(4, 4)).drop("time")
    times = spark.range(50).select("id", F.when(F.col("id") > 0, F.col("id")).alias("time")).drop("id")
    out = grids.nearest(frames.crossJoin(times), p, ax.values(), ax.values())
    assert broadcasts(out) == 0
    got = {}
    for r in out.collect():
        got.setdefault(r.id, []).append((r.time is None, r.time or 0, r.value))
    both = [(t == 0, t, v) for t in range(50) for v in (3.0, 15.0)]
    assert {k: sorted(v) for k, v in got.items()} == {1: sorted((t == 0, t, 5.0) for t in range(50)), 2: sorted(both), None: sorted((t == 0, t, 0.0) for t in range(50))}


def bytes_a_row(df, at):
    """Of what a columnar file takes for the rows as they leave."""
    df.write.parquet(str(at))
    return sum(f.stat().st_size for f in at.glob("*.parquet")) / df.sparkSession.read.parquet(str(at)).count()


def many(spark, places):
    """Spread ids at points of a 4 x 4 grid, as many as do not fit a short cycle, and 300 frames of it."""
    k = F.col("id") % places
    p = spark.range(6000).select((F.col("id") * 1000003).alias("id"), (k % 2 + k / places / 2).alias("lat"), (k / places).alias("lon"))
    times = spark.range(300).withColumnRenamed("id", "time")
    return cells(spark, np.arange(16.0).reshape(4, 4)).drop("time", "v").crossJoin(times).withColumn("v", F.rand(1)), p


def test_nearest_rows_are_stored_small(spark, tmp_path):
    """A frame stays for a run of points and their ids come again soon, however many points a cell has."""
    ax = Axis(0.0, 1.0, 4)
    frames, p = many(spark, 6000)
    assert bytes_a_row(grids.nearest(frames, p, ax.values(), ax.values()), tmp_path / "out") < 0.4


def test_nearest_is_whole_with_many_runs_and_shares(spark, monkeypatch):
    """Runs and shares that fill up lose and repeat no row: null and repeated ids, a row without a frame, an empty side."""
    monkeypatch.setattr(grids, "FRAMES", 2)
    monkeypatch.setattr(grids, "RUN", 3)
    ax = Axis(0.0, 1.0, 4)
    ids = [None, None, 7, 7, 7, 7, 7, *range(20, 31)]
    p = spark.createDataFrame([(k, 1.0, 1.0) for k in ids], "id long, lat double, lon double")
    frames = cells(spark, np.arange(16.0).reshape(4, 4)).drop("time")
    times = spark.range(75).select("id", F.when(F.col("id") > 0, F.col("id")).alias("time")).drop("id")
    out = grids.nearest(frames.crossJoin(times), p, ax.values(), ax.values())
    got = sorted((r.time or 0, r.id or 0, r.value) for r in out.collect())
    assert got == sorted((t, k or 0, 5.0) for t in range(75) for k in ids)
    assert grids.nearest(frames.crossJoin(times).limit(0), p, ax.values(), ax.values()).count() == 0
    assert grids.nearest(frames.crossJoin(times), p.limit(0), ax.values(), ax.values()).count() == 0


def test_bilinear_rows_are_stored_small(spark, tmp_path):
    """Points at one place leave together, so that their ids come again soon and their value is stored once a frame."""
    ax = Axis(0.0, 1.0, 4)
    frames, p = many(spark, 20)
    assert bytes_a_row(grids.bilinear(frames, p, ax, ax), tmp_path / "out") < 0.4


def test_bilinear_is_whole_with_many_runs_and_shares(spark, monkeypatch):
    """Distinct and shared places in runs that fill up: each id gets its own place's value in every frame."""
    monkeypatch.setattr(grids, "FRAMES", 2)
    monkeypatch.setattr(grids, "RUN", 3)
    ax = Axis(0.0, 1.0, 4)
    at = {k: (k % 4 * 0.25 + 1, k % 5 * 0.125 + 1) for k in range(20)}
    p = spark.createDataFrame([(k, *x) for k, x in at.items()], "id long, lat double, lon double")
    frames = cells(spark, np.arange(16.0).reshape(4, 4)).drop("time").crossJoin(spark.range(75).withColumnRenamed("id", "time"))
    got = sorted((r.time, r.id, r.value) for r in grids.bilinear(frames, p, ax, ax).collect())
    assert got == [(t, k, 4 * at[k][0] + at[k][1]) for t in range(75) for k in range(20)]


def test_wind_search_meets_each_place_once(spark, tmp_path, monkeypatch):
    """Sites at one place and centres of one category at one place are joined once, and every site gets its row."""
    import pandas as pd

    from weatherlake.plans import hazard_queries

    # customers 25,200 apart lie at one place, and so do users 2,520 apart
    pd.DataFrame({"c_custkey": [0, 25200, 50400, 7], "c_acctbal": [1.0] * 4}).to_parquet(tmp_path / "customer.parquet")
    users = [0, 2520, 5040]
    ts = pd.to_datetime(["2024-01-01"] * 3).astype("datetime64[us]")
    pd.DataFrame(
        {"event_id": [1, 2, 3], "ts": ts, "user_id": users, "event_type": ["a"] * 3, "value": [300.0] * 3, "props": [None, None, "x"]}
    ).to_parquet(tmp_path / "events.parquet")
    seen = []
    join = hazard_queries.spatial.radius_join
    monkeypatch.setattr(hazard_queries.spatial, "radius_join", lambda c, s, r, by=(): seen.append((c.count(), s.count())) or join(c, s, r, by))
    got = {r.obs_id: r.wind_ms for r in hazard_queries.hz_wind_at_radius(spark, str(tmp_path)).collect()}
    assert seen == [(1, 2)]
    assert {0, 25200, 50400} <= set(got) and len({got[k] for k in (0, 25200, 50400)}) == 1
