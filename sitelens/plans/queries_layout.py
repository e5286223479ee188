"""Queries that read the written layouts, and counts of what they skip."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators.paging import PageIndex
from ..session import ensure_checkpoint_dir
from ..sources import layout as L
from ..sources import projection as P
from ..sources.tables import write_layout
from . import jobs as J
from .catalog import dist_sql, oracle_of, register, with_domain
from .queries_search import SEARCH_LIMIT, SEARCH_PARK, SEARCH_RADIUS_KM

FILES = 16
BUCKETS = 8
PATH_RADIUS_KM = 800.0


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@P.memoized
def placed_campgrounds(spark, sf_dir):
    path = _folder(spark, "by-place")
    L.write_by_place(P.domain(spark, sf_dir)["campgrounds"], path, "latitude", "longitude", FILES)
    return spark.read.parquet(path)


@register("layout_radius_search", with_domain(f"""
SELECT c.campground_id, c.name, {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} AS distance_km
FROM campgrounds c, parks p WHERE p.park_id = {SEARCH_PARK}
  AND {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} <= {SEARCH_RADIUS_KM}
ORDER BY distance_km, c.campground_id LIMIT {SEARCH_LIMIT}"""))
def q_layout_radius_search(spark, sf_dir):
    """The radius search over rows that are written along a curve: the park's row is looked up, its box
    reaches the scan."""
    park = P.domain(spark, sf_dir)["parks"].where(F.col("park_id") == SEARCH_PARK).select("latitude", "longitude").first()
    near = L.near_point(placed_campgrounds(spark, sf_dir), "latitude", "longitude", park.latitude, park.longitude,
                        SEARCH_RADIUS_KM)
    return near.select("campground_id", "name", "distance_km").orderBy("distance_km", "campground_id").limit(SEARCH_LIMIT)


@register("layout_distances", with_domain(f"""
SELECT p.park_id, c.campground_id, {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} AS distance_km
FROM parks p, campgrounds c WHERE p.park_id = {SEARCH_PARK}
  AND {dist_sql('p.latitude', 'p.longitude', 'c.latitude', 'c.longitude')} <= 300.0"""))
def q_layout_distances(spark, sf_dir):
    """The distance table by (park, distance): a key and a range reach the scan."""
    d = P.domain(spark, sf_dir)
    path = _folder(spark, "by-park")
    write_layout(J.distances(d["parks"], d["campgrounds"], PATH_RADIUS_KM), path, "park_id", ["distance_km", "campground_id"])
    return spark.read.parquet(path).where((F.col("park_id") == SEARCH_PARK) & (F.col("distance_km") <= 300.0))


@P.memoized
def bucketed_tables(spark, sf_dir):
    d = P.domain(spark, sf_dir)
    return {n: L.write_bucketed(d[n].where(F.col("recarea_id").isNotNull()), "recarea_id", BUCKETS, n)
            for n in ("campgrounds", "areas", "bridge")}


@register("bucketed_activity_details", oracle_of("activity_details"))
def q_bucketed_activity_details(spark, sf_dir):
    """The four-way view over tables that are hashed on the area: no exchange on its key."""
    b = bucketed_tables(spark, sf_dir)
    return S.campground_activity_details(b["campgrounds"], b["areas"], b["bridge"], P.domain(spark, sf_dir)["activities"])


PAGE_SIZE = 40


@register("indexed_page", with_domain(f"""
SELECT campground_id, campground_type, fee_charged FROM campgrounds
ORDER BY campground_type, fee_charged, campground_id
LIMIT {PAGE_SIZE} OFFSET ((SELECT count(*) FROM campgrounds) - 1) // {PAGE_SIZE} // 2 * {PAGE_SIZE}"""))
def q_indexed_page(spark, sf_dir):
    """A page from the middle of all campgrounds by (type, fee), which many rows share."""
    camps = P.domain(spark, sf_dir)["campgrounds"].select("campground_type", "fee_charged", "campground_id")
    index = PageIndex(camps, ["campground_type", "fee_charged"], range_rows=200)
    return index.page((index.pages(PAGE_SIZE) - 1) // 2, PAGE_SIZE)[0]
