"""Counts in cells at several scales, and searches that descend through them.

Points are put on the unit sphere and into cubes; level l cuts each axis into
2**(BITS * l) cells, so a cell has 64 children (only those that hold points
exist). A pyramid has, for every level, the cells with their numbers of points.
A search starts from the cells of the first level and follows only those that
its answer still depends on:

* ``count_within``: a cell wholly inside the cap adds its number, one wholly
  outside is left, and only cells on the border are opened; the points of
  the last level's border cells are compared. Work per key grows with the
  length of the border, not with the area.
* ``nearest_within_cells``: the numbers bound the distance of the k-th
  neighbour from above; cells farther than that are left. Every key has its own
  bound, so a dense and a sparse neighbourhood cost alike, and one round
  of comparisons is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH_RADIUS_KM, haversine_km, rounded_km, unit_vector
from ..session import ensure_checkpoint_dir

BITS = 2            # levels halve a cell's edge so many times
LEAF_POINTS = 16    # the last level is chosen so that a cell holds about so many points
CROWDED = 4         # and none more than so many times that, down to MOST_LEVELS
MOST_LEVELS = 10    # cells of about 12 m
# Distances are rounded to 1e-6 km, and coordinates are doubles: cells this close to the border count as border.
MARGIN_KM = 2e-6
CELL = ("_cx", "_cy", "_cz")
_PI_R = math.pi * EARTH_RADIUS_KM


def _edge(level: int) -> float:
    return 2.0 / (1 << (BITS * level))


def with_cells(points: DataFrame, lat: str, lon: str, level: int) -> DataFrame:
    """``points`` that have coordinates, with the cell that holds each at ``level``."""
    n = 1 << (BITS * level)
    located = points.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    cells = [F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v + 1.0) / _edge(level)).cast("int"))).alias(c)
             for v, c in zip(unit_vector(lat, lon), CELL)]
    return located.select("*", *cells)


class Pyramid:
    """Numbers of points by cell for the levels 1..levels; the last level is a checkpoint.

    ``weight``: column with the number of points that a row stands for. Depth follows the rows: points at one
    place are never parted, so rows that stand for places need no deeper levels where many points share one.
    """

    def __init__(self, points: DataFrame, lat: str, lon: str, levels: int | None = None, weight: str | None = None):
        ensure_checkpoint_dir(points.sparkSession)
        self.lat, self.lon = lat, lon
        n = F.lit(1) if weight is None else F.col(weight)
        places = points.select(lat, lon, n.alias("_n")).where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        fixed = levels is not None
        if levels is None:
            # the sphere has about 4 * pi / edge**2 cells of an edge
            levels = self._more(places.count() / math.pi)
        while True:
            self.levels = min(MOST_LEVELS, max(1, levels))
            cells = (with_cells(places, lat, lon, self.levels).groupBy(*CELL)
                     .agg(F.sum("_n").alias("points"), F.count(F.lit(1)).alias("rows")).checkpoint())
            if fixed or self.levels == MOST_LEVELS:
                break
            # points may crowd in few cells: deeper levels then, so that border cells stay small
            most = cells.agg(F.max("rows")).first()[0] or 0
            if most <= CROWDED * LEAF_POINTS:
                break
            levels = self.levels + self._more(most)
        self._level = {self.levels: cells.drop("rows")}
        for level in range(self.levels - 1, 0, -1):
            self._level[level] = (self._level[level + 1]
                                  .groupBy(*[F.shiftright(c, BITS).alias(c) for c in CELL])
                                  .agg(F.sum("points").alias("points")))

    @staticmethod
    def _more(points: float) -> int:
        """Levels that part so many evenly spread points into cells of LEAF_POINTS."""
        return max(1, math.ceil(math.log(max(1.0, points / LEAF_POINTS), 4) / BITS))

    def cells(self, level: int) -> DataFrame:
        return self._level[level]

    def below(self, frontier: DataFrame, level: int) -> DataFrame:
        """``frontier`` (cells of level - 1, or keys alone at the first level) with the cells inside, at ``level``."""
        cells = self._level[level]
        if level == 1:
            # the 64 cells of the first level
            n = (1 << BITS) - 1
            every = frontier.withColumn("_i", F.explode(F.expr(f"sequence(0, {(1 << 3 * BITS) - 1})")))
            place = [(F.shiftright("_i", BITS * j).bitwiseAND(F.lit(n))).cast("int").alias(c) for j, c in enumerate(CELL)]
            return every.select(*frontier.columns, *place).join(cells, list(CELL))
        up = cells.select(*[F.shiftright(c, BITS).alias(f"up{c}") for c in CELL], *CELL, "points")
        return (frontier.withColumnsRenamed({c: f"up{c}" for c in CELL})
                .join(up, [f"up{c}" for c in CELL]).drop(*[f"up{c}" for c in CELL]))


def _reach(level: int) -> tuple[Column, Column]:
    """(least, largest) straight distance from the key's point (px, py, pz) to its cell's cube."""
    edge = _edge(level)
    near, far = F.lit(0.0), F.lit(0.0)
    for p, c in zip(("px", "py", "pz"), CELL):
        low = F.col(c) * F.lit(edge) - 1.0
        below, above = low - F.col(p), F.col(p) - (low + edge)
        gap = F.greatest(F.lit(0.0), below, above)
        span = F.greatest(-below, -above)
        near, far = near + gap * gap, far + span * span
    return F.sqrt(near), F.least(F.lit(2.0), F.sqrt(far))


def _chord(km) -> float:
    return 2.0 * math.sin(min(max(km, 0.0), _PI_R) / (2.0 * EARTH_RADIUS_KM))


def _places(probe: DataFrame, lat: str, lon: str) -> DataFrame:
    """The different places of the keys (a place with many keys is searched once)."""
    places = (probe.select(F.col(lat).alias("_at_lat"), F.col(lon).alias("_at_lon"))
              .where("_at_lat is not null and _at_lon is not null").distinct())
    return places.select("*", *[v.alias(n) for v, n in zip(unit_vector("_at_lat", "_at_lon"), ("px", "py", "pz"))])


def whole_and_border(probe: DataFrame, pyramid: Pyramid, radius_km: float, *, probe_lat: str,
                     probe_lon: str) -> tuple[DataFrame, DataFrame]:
    """(_at_lat, _at_lon, n) of the cells wholly inside the cap of a place, and (_at_lat, _at_lon, cell) of the last
    level's cells on its border."""
    inside = _chord(radius_km - MARGIN_KM) if radius_km > MARGIN_KM else -1.0
    if radius_km >= _PI_R:
        inside = 3.0  # everything on the sphere
    outside = _chord(radius_km + MARGIN_KM)
    frontier = _places(probe, probe_lat, probe_lon)
    whole = None
    for level in range(1, pyramid.levels + 1):
        near, far = _reach(level)
        met = pyramid.below(frontier, level).withColumns({"near": near, "far": far}).where(F.col("near") <= outside + 1e-12)
        inner = met.where(F.col("far") <= inside - 1e-12).groupBy("_at_lat", "_at_lon").agg(F.sum("points").alias("n"))
        whole = inner if whole is None else whole.unionByName(inner)
        frontier = met.where(F.col("far") > inside - 1e-12).drop("near", "far", "points")
    return whole, frontier.select("_at_lat", "_at_lon", *CELL)


def count_within(probe: DataFrame, points: DataFrame, radius_km: float, *, probe_lat: str, probe_lon: str,
                 lat: str, lon: str, levels: int | None = None, out: str = "n") -> DataFrame:
    """``probe`` with ``out``: points whose rounded distance is at most ``radius_km``; 0 for a row without a place.

    No pair is made for a cell that lies wholly inside the cap.
    """
    if radius_km < 0 or math.isnan(radius_km):
        raise ValueError("radius_km must be a non-negative number")
    ensure_checkpoint_dir(points.sparkSession)
    # points at one place are compared once
    places = (points.select(F.col(lat).alias("_of_lat"), F.col(lon).alias("_of_lon")).groupBy("_of_lat", "_of_lon")
              .agg(F.count(F.lit(1)).alias("points")).checkpoint())
    pyramid = Pyramid(places, "_of_lat", "_of_lon", levels, "points")
    whole, border = whole_and_border(probe, pyramid, radius_km, probe_lat=probe_lat, probe_lon=probe_lon)
    at = with_cells(places, "_of_lat", "_of_lon", pyramid.levels)
    met = (border.join(at, list(CELL))
           .where(rounded_km(haversine_km("_at_lat", "_at_lon", "_of_lat", "_of_lon")) <= F.lit(float(radius_km)))
           .groupBy("_at_lat", "_at_lon").agg(F.sum("points").alias("n")))
    total = whole.unionByName(met).groupBy("_at_lat", "_at_lon").agg(F.sum("n").alias("total"))
    return (probe.join(total, (probe[probe_lat] == total["_at_lat"]) & (probe[probe_lon] == total["_at_lon"]), "left")
            .select(*[probe[c] for c in probe.columns], F.coalesce("total", F.lit(0)).cast("long").alias(out)))


def cells_of_nearest(probe: DataFrame, pyramid: Pyramid, k: int, *, probe_lat: str, probe_lon: str) -> DataFrame:
    """(_at_lat, _at_lon, cell): for every place, the last level's cells that can hold one of its ``k`` nearest points."""
    frontier = _places(probe, probe_lat, probe_lon)
    order = Window.partitionBy("_at_lat", "_at_lon").orderBy("far")
    # chord by which rounding to 1e-6 km can reorder two points
    margin = 2.0 * MARGIN_KM / EARTH_RADIUS_KM
    for level in range(1, pyramid.levels + 1):
        near, far = _reach(level)
        met = pyramid.below(frontier, level).withColumns({"near": near, "far": far})
        # the cells whose largest distance is least hold k points: the k-th neighbour is not farther
        met = met.withColumn("held", F.sum("points").over(order.rowsBetween(Window.unboundedPreceding, -1)))
        bound = F.max(F.when(F.coalesce("held", F.lit(0)) < k, F.col("far"))).over(Window.partitionBy("_at_lat", "_at_lon"))
        frontier = (met.withColumn("bound", bound).where(F.col("near") <= F.col("bound") + margin)
                    .drop("near", "far", "held", "bound", "points"))
    return frontier.select("_at_lat", "_at_lon", *CELL)


def nearest(probe: DataFrame, build: DataFrame, k: int, *, probe_key: str, build_key: str, probe_lat: str,
            probe_lon: str, build_lat: str, build_lon: str, distance_col: str = "distance_km",
            rank_col: str = "distance_rank", levels: int | None = None) -> DataFrame:
    """The ``k`` nearest build rows of every probe row that has a place, ranked by (rounded distance, build key).

    ``build`` is read to count it by cell and once to compare; no round depends on another's outcome.
    """
    if k < 1:
        raise ValueError("k must be >= 1")
    pyramid = Pyramid(build, build_lat, build_lon, levels)
    cells = cells_of_nearest(probe, pyramid, k, probe_lat=probe_lat, probe_lon=probe_lon)
    candidates = with_cells(build, build_lat, build_lon, pyramid.levels).join(cells, list(CELL)).drop(*CELL)
    keys = probe.where(F.col(probe_lat).isNotNull() & F.col(probe_lon).isNotNull())
    distance = rounded_km(haversine_km(F.col("_at_lat"), F.col("_at_lon"), F.col(build_lat), F.col(build_lon)))
    # ranked by place first, so that keys at one place share the comparisons
    ranked = (candidates.withColumn(distance_col, distance)
              .withColumn(rank_col, F.row_number().over(Window.partitionBy("_at_lat", "_at_lon").orderBy(distance_col, build_key)))
              .where(F.col(rank_col) <= k))
    return (keys.join(ranked, (F.col(probe_lat) == F.col("_at_lat")) & (F.col(probe_lon) == F.col("_at_lon")))
            .select(*[keys[c] for c in probe.columns], *[F.col(c) for c in build.columns], distance_col, rank_col))
