"""Grid-blocked joins equal brute force (poles, antimeridian, hot cells)."""

import math
import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions.geo import haversine_km, rounded_km
from sitelens.operators import pyramid as PY
from sitelens.operators import spatial as SP
from sitelens.operators.spatial import duplicate_pairs, radius_join

R = 6371.0088


def hav(a, b, c, d):
    p1, p2 = math.radians(a), math.radians(c)
    h = (math.sin((p2 - p1) / 2) ** 2
         + math.cos(p1) * math.cos(p2) * math.sin((math.radians(d) - math.radians(b)) / 2) ** 2)
    return R * 2 * math.asin(math.sqrt(min(1.0, max(0.0, h))))


def _points(n, seed):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(n)]
    # Edge cases: poles, both sides of the antimeridian, and a hot spot.
    pts += [(n, 90.0, 0.0), (n + 1, 89.99, 120.0), (n + 2, -90.0, 10.0),
            (n + 3, 0.0, 179.999), (n + 4, 0.0, -179.999)]
    pts += [(n + 5 + j, 45.0, 7.0) for j in range(40)]
    return pts


@pytest.mark.parametrize("radius", [0.0, 5.0, 300.0, 2500.0, 21000.0])
def test_radius_join_equals_brute_force(spark, radius):
    a = _points(60, 1)
    b = _points(80, 2)
    pa = spark.createDataFrame(a, "pid long, plat double, plon double")
    pb = spark.createDataFrame(b, "bid long, lat double, lon double")
    got = {(r.pid, r.bid) for r in radius_join(pa, pb, radius, probe_lat="plat", probe_lon="plon",
                                                build_lat="lat", build_lon="lon").collect()}
    want = {(i, j) for i, x, y in a for j, u, v in b if round(hav(x, y, u, v), 6) <= radius}
    assert got == want


@pytest.mark.parametrize("radius", [0.0, 3.0, 900.0, 21000.0])
def test_split_hot_cells_equal_brute_force(spark, radius):
    """Half of the points in one cell: no join key above the bound, the same pairs."""
    bound = 12
    rnd = random.Random(11)
    b = _points(60, 4) + [(1000 + i, 45.0 + rnd.uniform(0, 1e-3), 7.0 + rnd.uniform(0, 1e-3)) for i in range(150)]
    a = _points(30, 3) + [(500, 45.0005, 7.0005), (501, None, 1.0)]
    pa = spark.createDataFrame(a, "pid long, plat double, plon double")
    pb = spark.createDataFrame(b, "bid long, lat double, lon double")
    kw = dict(probe_lat="plat", probe_lon="plon", build_lat="lat", build_lon="lon")
    got = sorted((r.pid, r.bid) for r in radius_join(pa, pb, radius, cell_rows=bound, **kw).collect())
    want = sorted((i, j) for i, x, y in a if x is not None for j, u, v in b if round(hav(x, y, u, v), 6) <= radius)
    assert got == want
    width = SP.grid_cell_width(min(radius + 1e-6, SP.MAX_SPHERE_KM))
    leaves = SP.split_hot_cells(pb, "lat", "lon", width, bound)
    p, q = SP._split_sides(SP.with_neighbour_cells(pa.where("plat is not null"), "plat", "plon", width),
                           SP.with_cell(pb, "lat", "lon", width), leaves, width, SP.chord_for_km(radius + 1e-6),
                           ("plat", "plon"), ("lat", "lon"))
    sizes = q.groupBy(*SP.KEYS, "_depth", "_salt").count().collect()
    assert sum(r["count"] for r in sizes) == len(b)
    assert max(r["count"] for r in sizes) <= 2 * bound  # rows at one place are dealt out by number


def test_no_hot_cell_needs_no_split(spark):
    pb = spark.createDataFrame(_points(20, 4), "bid long, lat double, lon double")
    assert SP.split_hot_cells(pb, "lat", "lon", 0.1, 1000) is None


def nearest_per_key(probe, build, k, **kw):
    kw.pop("start_radius_km", None)
    return PY.nearest(probe, build, k, **kw)


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("radius", [0.0, 5.0, 300.0, 2500.0, 10007.557, 15000.0, 20015.2, 21000.0])
def test_counts_equal_brute_force(spark, radius, levels):
    """Poles, antimeridian, one place with many points, points and keys without a place."""
    a = _points(12, 1) + [(900, None, 3.0), (901, 45.0, 7.0)]
    b = _points(150, 2) + [(901, None, 3.0)]
    pa = spark.createDataFrame(a, "pid long, plat double, plon double")
    pb = spark.createDataFrame(b, "bid long, lat double, lon double")
    got = {r.pid: r.n for r in PY.count_within(pa, pb, radius, probe_lat="plat", probe_lon="plon", lat="lat", lon="lon",
                                               levels=levels).collect()}
    assert got == {i: 0 if x is None else sum(round(hav(x, y, u, v), 6) <= radius for _, u, v in b if u is not None)
                   for i, x, y in a}


def test_counts_open_only_the_border(spark):
    """With twice the radius four times the points are counted, and about twice as many compared."""
    pb = spark.sql("select id, degrees(asin(2 * rand(1) - 1)) as lat, 360 * rand(2) - 180 as lon from range(40000)").cache()
    pa = spark.createDataFrame([(1, 10.0, 20.0), (2, 89.0, 0.0)], "pid int, plat double, plon double")
    pyramid = PY.Pyramid(pb, "lat", "lon", 3)
    compared, inside = {}, {}
    for r in (1500.0, 3000.0):
        whole, border = PY.whole_and_border(pa, pyramid, r, probe_lat="plat", probe_lon="plon")
        inside[r] = whole.agg(F.sum("n")).first()[0]
        compared[r] = border.join(pyramid.cells(3), list(PY.CELL)).agg(F.sum("points")).first()[0]
    assert inside[3000.0] > 3.5 * inside[1500.0] and compared[3000.0] < 2.6 * compared[1500.0]
    assert compared[3000.0] < inside[3000.0]


def test_nearest_compares_few_points(spark):
    """A key far from all points, one in a dense spot and one in a sparse region: none looks at many points."""
    pb = spark.sql("select id as bid, 45 + rand(1) / 100 as lat, 7 + rand(2) / 100 as lon from range(20000) union all "
                   "select 50000 + id, degrees(asin(2 * rand(3) - 1)), 360 * rand(4) - 180 from range(2000)").cache()
    pa = spark.createDataFrame([(1, 45.005, 7.005), (2, -44.0, -172.0), (3, 0.0, 90.0)], "pid int, plat double, plon double")
    pyramid = PY.Pyramid(pb, "lat", "lon")
    cells = PY.cells_of_nearest(pa, pyramid, 5, probe_lat="plat", probe_lon="plon")
    met = cells.join(pyramid.cells(pyramid.levels), list(PY.CELL)).groupBy("_at_lat").agg(F.sum("points").alias("n")).collect()
    assert len(met) == 3 and max(r.n for r in met) < 400
    got = PY.nearest(pa, pb, 5, probe_key="pid", build_key="bid", probe_lat="plat", probe_lon="plon", build_lat="lat",
                     build_lon="lon").collect()
    points = [tuple(r) for r in pb.collect()]
    for pid, x, y in ((1, 45.005, 7.005), (2, -44.0, -172.0), (3, 0.0, 90.0)):
        want = sorted((round(hav(x, y, u, v), 6), j) for j, u, v in points)[:5]
        assert sorted((r.distance_km, r.bid) for r in got if r.pid == pid) == want


def test_nearest_per_key_equals_brute_force(spark):
    a = _points(25, 5)
    b = _points(120, 6)
    pa = spark.createDataFrame(a, "pid long, plat double, plon double")
    pb = spark.createDataFrame(b, "bid long, lat double, lon double")
    k = 4
    got = nearest_per_key(pa, pb, k, probe_key="pid", build_key="bid", probe_lat="plat",
                          probe_lon="plon", build_lat="lat", build_lon="lon",
                          start_radius_km=50.0)
    got = {(r.pid, r.distance_rank): r.bid for r in got.collect()}
    want = {}
    for i, x, y in a:
        ranked = sorted(((round(hav(x, y, u, v), 6), j) for j, u, v in b))[:k]
        for rank, (_, j) in enumerate(ranked, start=1):
            want[(i, rank)] = j
    assert got == want


def test_nearest_when_fewer_rows_than_k(spark):
    pa = spark.createDataFrame([(1, 0.0, 0.0)], "pid long, plat double, plon double")
    pb = spark.createDataFrame([(7, 10.0, 10.0), (8, -60.0, 170.0)], "bid long, lat double, lon double")
    got = nearest_per_key(pa, pb, 5, probe_key="pid", build_key="bid", probe_lat="plat",
                          probe_lon="plon", build_lat="lat", build_lon="lon")
    assert [r.bid for r in got.orderBy("distance_rank").collect()] == [7, 8]


def test_duplicate_pairs_fixture(spark):
    # Pine-Camp and pine camp about 70 m apart; a third Pine Camp far away.
    df = spark.createDataFrame(
        [("1", "Pine-Camp", 40.0, -105.0), ("2", "pine camp", 40.0006, -105.0003),
         ("3", "Pine Camp", 41.0, -106.0), ("4", "   ", 40.0, -105.0)],
        "campground_id string, name string, lat double, lon double")
    rows = duplicate_pairs(df, key="campground_id", name="name", lat="lat", lon="lon").collect()
    assert [(r.campground_id_1, r.campground_id_2) for r in rows] == [("1", "2")]
    assert rows[0].normalized_name == "PINE CAMP" and rows[0].distance_km < 1.0


def test_duplicate_pairs_hot_name(spark):
    # One very common name spread over many places: only close pairs appear.
    pts = [(str(i), "Lake Camp", 10.0 + (i // 2) * 0.5, 20.0) for i in range(200)]
    df = spark.createDataFrame(pts, "campground_id string, name string, lat double, lon double")
    got = {(r.campground_id_1, r.campground_id_2) for r in
           duplicate_pairs(df, key="campground_id", name="name", lat="lat", lon="lon").collect()}
    want = {(str(2 * j), str(2 * j + 1)) for j in range(100)}
    want = {tuple(sorted(p)) for p in want}
    assert got == want


def test_nearest_with_unplaced_points_and_few_sites(spark):
    """k above the number of placed sites; points without coordinates on both sides."""
    probe = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 5.0), (3, 80.0, 170.0)], "pid int, plat double, plon double")
    build = spark.createDataFrame([(10, 1.0, 1.0), (11, -60.0, -170.0), (12, 0.5, 0.0), (13, None, None), (14, 3.0, None)],
                                  "bid int, blat double, blon double")
    got = nearest_per_key(probe, build, 5, probe_key="pid", build_key="bid", probe_lat="plat", probe_lon="plon",
                          build_lat="blat", build_lon="blon").collect()
    assert {(r.pid, r.distance_rank): r.bid for r in got} == {
        (1, 1): 12, (1, 2): 10, (1, 3): 11, (3, 1): 10, (3, 2): 12, (3, 3): 11}
    none = nearest_per_key(probe, build.where("bid = 13"), 2, probe_key="pid", build_key="bid", probe_lat="plat",
                           probe_lon="plon", build_lat="blat", build_lon="blon")
    assert none.collect() == []


def test_nearest_among_clustered_sites(spark):
    """Most sites share one place; the probe far away still gets its nearest ones."""
    rows = [(i, 45.0 + (i % 7) * 1e-4, 7.0) for i in range(400)] + [(900, -45.0, 7.0), (901, -44.0, 8.0)]
    build = spark.createDataFrame(rows, "bid int, blat double, blon double")
    probe = spark.createDataFrame([(1, 45.0, 7.0), (2, -45.0, 7.0)], "pid int, plat double, plon double")
    got = nearest_per_key(probe, build, 3, probe_key="pid", build_key="bid", probe_lat="plat", probe_lon="plon",
                          build_lat="blat", build_lon="blon").collect()
    by = {(r.pid, r.distance_rank): r.bid for r in got}
    assert [by[1, k] for k in (1, 2, 3)] == [0, 7, 14] and [by[2, k] for k in (1, 2)] == [900, 901]


def test_distance_issues_group_only_pairs_that_can_repeat(spark, monkeypatch):
    """Without a repeated id no pair is shuffled; with some, or with too many, the same pairs are found."""
    from sitelens.operators import quality as Q
    from sitelens.operators.spatial import radius_join

    def issues(parks, camps, tables=True):
        p = spark.createDataFrame(parks, "park_id long, la double, lo double")
        c = spark.createDataFrame(camps, "campground_id long, cla double, clo double")
        pairs = radius_join(p, c, 1000.0, probe_lat="la", probe_lon="lo", build_lat="cla", build_lon="clo")
        return Q.distance_issues(pairs, *((p, c) if tables else ()))

    parks, camps = [(k, 1.0 * k, 2.0) for k in range(6)], [(k, 1.5 * k, 2.5) for k in range(6)]
    plan = issues(parks, camps)
    assert plan.collect() == [] and "hashpartitioning(park_id" not in plan._jdf.queryExecution().executedPlan().toString()
    twice = (parks + parks[2:3] + [(None, 0.0, 2.0)] * 2, camps + [(4, 0.1, 2.0)])
    want = sorted(map(tuple, issues(*twice, tables=False).collect()), key=str)
    assert len(want) > 8
    for most in (100_000, 0):
        monkeypatch.setattr(Q, "BROADCAST_IDS", most)
        assert sorted(map(tuple, issues(*twice).collect()), key=str) == want


def test_count_levels_follow_places_not_points(spark):
    """Many points at one place need no deeper levels, as they can't be parted."""
    from sitelens.operators import pyramid as PY
    points = spark.range(20000).selectExpr("cast(id % 20 as double) as la", "cast(id % 20 as double) as lo")
    places = points.groupBy("la", "lo").count()
    assert PY.Pyramid(places, "la", "lo", weight="count").levels < PY.Pyramid(points, "la", "lo").levels == PY.MOST_LEVELS
    keys = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0), (3, 50.0, 0.0)], "k int, a double, b double")
    got = PY.count_within(keys, points, 500.0, probe_lat="a", probe_lon="b", lat="la", lon="lo")
    assert sorted((r.k, r.n) for r in got.collect()) == [(1, 4000), (2, 0), (3, 0)]


def test_pairs_at_the_very_radius(spark):
    """The chord decides most pairs; those whose rounded distance is the radius itself, or its neighbour, still go by that."""
    rnd = random.Random(4)
    some = [(i, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for i in range(12)]
    some += [(20, 90.0, 0.0), (21, -90.0, 5.0), (22, 0.0, 180.0), (23, 0.0, -180.0), (24, 0.0, 0.0), (25, 1e-7, 1e-7)]
    p = spark.createDataFrame(some, "p long, plat double, plon double")
    c = spark.createDataFrame(some, "c long, clat double, clon double")
    d = F.round(haversine_km("plat", "plon", "clat", "clon"), 6)
    every = {(r.p, r.c): r.d for r in p.crossJoin(c).select("p", "c", d.alias("d")).collect()}
    far = sorted(set(every.values()))
    for at in (far[0], far[len(far) // 2], far[-2]):
        for radius in (max(at - 1e-6, 0.0), at, at + 1e-6):
            got = radius_join(p, c, radius, probe_lat="plat", probe_lon="plon", build_lat="clat", build_lon="clon").collect()
            assert {(r.p, r.c): r.distance_km for r in got} == {k: v for k, v in every.items() if v <= radius}


def test_rounded_distances_equal_round(spark):
    rnd = random.Random(9)
    values = [0.0, 5e-7, 4.9999999e-7, 20015.114442, math.nan, math.inf, None]
    for _ in range(2000):
        half = (rnd.randint(0, 20_000_000_000) + 0.5) / 1e6
        values += [rnd.uniform(0, 20015), half, math.nextafter(half, 0), math.nextafter(half, 1e9), rnd.randint(0, 10**10) / 1e7]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert df.where(~F.round("v", 6).eqNullSafe(rounded_km(F.col("v")))).collect() == []


def test_a_small_probe_table_is_dealt_by_cell(spark):
    """Before, with the build side broadcast, all pairs of a probe table of one task were made by that task."""
    p = spark.createDataFrame([(i, i / 7.0 - 80, i * 1.0 - 170) for i in range(300)], "p long, plat double, plon double").coalesce(1)
    c = p.select(F.col("p").alias("c"), F.col("plat").alias("clat"), F.col("plon").alias("clon"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        pairs = radius_join(p, F.broadcast(c), 2000.0, probe_lat="plat", probe_lon="plon", build_lat="clat", build_lon="clon")
        by_task = pairs.groupBy(F.spark_partition_id().alias("t")).count().collect()
        assert len(by_task) > 2
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_issue_rules_do_not_make_their_columns_twice(spark):
    """Before, a filter on the rules' result went down into the scan and the join, and made costly columns again for every test."""
    from sitelens.operators import quality as Q
    df = spark.range(20).select("id", F.sin(F.col("id").cast("double")).alias("x"))
    for issues in (Q.row_rule_issues(df, F.col("id"), [("low", F.col("x") < -0.9), ("high", F.col("x") > 0.9)]),
                   Q.distance_issues(df.select(F.col("id").alias("park_id"), F.col("id").alias("campground_id"),
                                               F.col("x").alias("distance_km")), spark.createDataFrame([], "park_id long"),
                                     spark.createDataFrame([], "campground_id long"))):
        plan = issues._jdf.queryExecution().executedPlan().toString()
        assert plan.upper().count("SIN(") == 1 and "Filter" not in plan
    got = Q.row_rule_issues(df, F.col("id"), [("low", F.col("x") < -0.9), ("high", F.col("x") > 0.9), ("none", F.col("x") > 2)])
    assert got.columns == ["issue", "record_key"]
    assert sorted((r.record_key, r.issue) for r in got.collect()) == [(2, "high"), (5, "low"), (8, "high"), (11, "low"), (14, "high"), (17, "low")]
