"""Spatial joins on the sphere without a cross product.

``radius_join`` is a grid-blocked theta join: points become unit vectors,
vectors are bucketed into cubic cells whose edge equals the chord of the
search radius, so any pair within the radius lies in the same or an
adjacent cell. The probe side is replicated to its 27 neighbour cells, the
build side keeps one cell, and an equi-join on the cell is followed by a test of
the straight line between the points, and of the exact haversine where that is as long as
the radius. The plan is an ordinary equi-join, so Spark is free
to broadcast a side that is small at run time (adaptive execution checks
the size), or to shuffle both and split skewed cells (adaptive skew join).
A cell with more rows than a bound is split into an octree whose leaves
are within it (``split_hot_cells``); probes go only to the leaves that they
reach.

``duplicate_pairs`` blocks on (name, cell). Counts within a radius and the
nearest rows come from ``pyramid``.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import (EARTH_RADIUS_KM, chord_for_km, grid_cell_width, haversine_atan2_km,
                             haversine_km, rounded_km, unit_vector)
from ..session import ensure_checkpoint_dir

# Margin added to the radius when picking cells, so pairs whose rounded
# distance equals the radius are never lost to rounding.
_ROUNDING_MARGIN_KM = 1e-6
# The straight line between two points decides if their distance is further from the radius than this.
_SHELL_KM = 1e-5
# Half the Earth's circumference: beyond it every pair qualifies.
MAX_SPHERE_KM = math.pi * EARTH_RADIUS_KM
# Largest probe (in exploded cell rows) broadcast on a caller-proven bound.
BROADCAST_ROWS = 100_000

def _neighbours():
    """The 27 cell offsets (-1..1 on each axis) as an array literal."""
    return F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"),
                              F.lit(dz).alias("dz"))
                     for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1)])


def _cell_cols(lat: str, lon: str, width: float):
    x, y, z = unit_vector(lat, lon)
    return [F.floor(x / F.lit(width)).alias("_cx"), F.floor(y / F.lit(width)).alias("_cy"),
            F.floor(z / F.lit(width)).alias("_cz")]


def with_cell(df: DataFrame, lat: str, lon: str, width: float) -> DataFrame:
    return df.select("*", *_cell_cols(lat, lon, width))


def with_neighbour_cells(df: DataFrame, lat: str, lon: str, width: float) -> DataFrame:
    base = with_cell(df, lat, lon, width)
    n = base.select("*", F.explode(_neighbours()).alias("_nb"))
    return n.select(*[c for c in base.columns if c not in ("_cx", "_cy", "_cz")],
                    (F.col("_cx") + F.col("_nb.dx")).alias("_cx"),
                    (F.col("_cy") + F.col("_nb.dy")).alias("_cy"),
                    (F.col("_cz") + F.col("_nb.dz")).alias("_cz"))


KEYS = ("_cx", "_cy", "_cz")
SPLIT_DEPTH = 10  # halvings of a hot cell; rows that lie closer together are dealt out by number


def _scaled(lat: str, lon: str, width: float) -> list:
    """The unit vector in cell widths: its floor is the cell, and that of 2**d times it the cell at depth d."""
    return [v / F.lit(width) for v in unit_vector(lat, lon)]


def _at_depth(depth) -> list:
    return [F.floor(F.col(f"_s{k}") * F.pow(F.lit(2.0), depth)).alias(k) for k in KEYS]


def split_hot_cells(build: DataFrame, lat: str, lon: str, width: float, most_rows: int) -> DataFrame | None:
    """Leaves (root cell ``_r*``, ``_depth``, cell, ``_salts``) of the cells that hold more than ``most_rows`` rows;
    None if there are none.

    A hot cell is halved on each axis until a part is within the bound or
    SPLIT_DEPTH is reached; a part of that depth that still holds more gets
    salts. Cells of every depth are counted in one pass over the hot rows.
    """
    scaled = build.select(*[v.alias(f"_s{k}") for v, k in zip(_scaled(lat, lon, width), KEYS)])
    counts = scaled.groupBy(*_at_depth(F.lit(0))).agg(F.count(F.lit(1)).alias("_n"))
    hot = counts.where(F.col("_n") > most_rows).checkpoint()
    if hot.isEmpty():
        return None
    roots = hot.select(*[F.col(k).alias(f"_r{k}") for k in KEYS])
    inside = scaled.select("*", *[c.alias(f"_r{k}") for c, k in zip(_at_depth(F.lit(0)), KEYS)]).join(
        roots, [f"_r{k}" for k in KEYS], "left_semi")
    depth = F.explode(F.sequence(F.lit(1), F.lit(SPLIT_DEPTH))).alias("_depth")
    nodes = (inside.select("*", depth).select("_depth", *[f"_r{k}" for k in KEYS], *_at_depth(F.col("_depth")))
             .groupBy("_depth", *[f"_r{k}" for k in KEYS], *KEYS).agg(F.count(F.lit(1)).alias("_n")).checkpoint())
    # a part is opened if it is above the bound; leaves are the parts below an opened one that are not
    opened = (nodes.where((F.col("_n") > most_rows) & (F.col("_depth") < SPLIT_DEPTH))
              .select((F.col("_depth") + 1).alias("_depth"), *[F.col(k).alias(f"_u{k}") for k in KEYS]))
    up = nodes.select("*", *[F.shiftright(k, 1).alias(f"_u{k}") for k in KEYS])
    below = up.join(opened, ["_depth", *[f"_u{k}" for k in KEYS]], "left_semi").unionByName(up.where("_depth = 1"))
    leaves = below.where((F.col("_n") <= most_rows) | (F.col("_depth") == SPLIT_DEPTH))
    return (leaves.select(*[f"_r{k}" for k in KEYS], "_depth", *KEYS,
                          F.ceil(F.col("_n") / most_rows).cast("int").alias("_salts")).checkpoint())


def _split_sides(p: DataFrame, b: DataFrame, leaves: DataFrame, width: float, chord: float, probe: tuple,
                 build: tuple) -> tuple[DataFrame, DataFrame]:
    """Both sides keyed by (depth, cell, salt): rows of hot cells by the leaf that holds or reaches them."""
    roots = leaves.select(*[f"_r{k}" for k in KEYS]).distinct()
    at_root = [f"_r{k}" for k in KEYS]
    plain = [F.lit(0).alias("_depth"), F.lit(0).cast("bigint").alias("_salt")]

    def rooted(df):
        return df.withColumnsRenamed({k: f"_r{k}" for k in KEYS})

    def cold(df, columns):
        return (rooted(df).join(roots, at_root, "left_anti").select(*columns, *[F.col(f"_r{k}").alias(k) for k in KEYS], *plain))

    b_columns = [c for c in b.columns if c not in KEYS]
    rows = (rooted(b).join(roots, at_root, "left_semi")
            .select("*", *[v.alias(f"_s{k}") for v, k in zip(_scaled(*build, width), KEYS)],
                    F.monotonically_increasing_id().alias("_number")))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(SPLIT_DEPTH))).alias("_depth"))
    rows = rows.select(*b_columns, "_number", "_depth", *_at_depth(F.col("_depth"))).join(
        leaves.drop(*at_root), ["_depth", *KEYS])
    hot_b = rows.select(*b_columns, *KEYS, "_depth", F.pmod("_number", F.col("_salts")).cast("bigint").alias("_salt"))

    p_columns = [c for c in p.columns if c not in KEYS]
    near = F.lit(0.0)
    for v, k in zip(_scaled(*probe, width), KEYS):
        low, edge = F.col(k) / F.pow(F.lit(2.0), F.col("_depth")), F.pow(F.lit(0.5), F.col("_depth"))
        gap = F.greatest(F.lit(0.0), low - v, v - low - edge)
        near = near + gap * gap
    reached = rooted(p).join(leaves, at_root).where(F.sqrt(near) <= chord / width * (1 + 1e-9) + 1e-9)
    hot_p = reached.select(*p_columns, *KEYS, "_depth", F.explode(F.sequence(
        F.lit(0).cast("bigint"), F.col("_salts").cast("bigint") - 1)).alias("_salt"))
    return cold(p, p_columns).unionByName(hot_p), cold(b, b_columns).unionByName(hot_b)


def _with_vector(df: DataFrame, lat: str, lon: str, names) -> DataFrame:
    return df.select("*", *[v.alias(n) for v, n in zip(unit_vector(lat, lon), names)])


def radius_join(probe: DataFrame, build: DataFrame, radius_km: float, *,
                probe_lat: str, probe_lon: str, build_lat: str, build_lon: str,
                distance_col: str = "distance_km", extra_condition=None,
                probe_rows_bound: int | None = None, cell_rows: int | None = None) -> DataFrame:
    """All (probe, build) row pairs whose rounded great-circle distance is
    <= ``radius_km`` (inclusive), with that distance in ``distance_col``.

    Column names of the two inputs must not collide.
    ``probe_rows_bound``: a caller-proven upper bound on probe rows (e.g. one
    primary-key value); when it is small the 27 x bound probe cells are
    broadcast, so the build side is streamed and never shuffled.
    ``cell_rows``: build rows that may meet at one join key; cells above it are
    counted (a job over the build side) and split.
    """
    if radius_km < 0 or math.isnan(radius_km):
        raise ValueError("radius_km must be a non-negative number")
    reach = min(radius_km + _ROUNDING_MARGIN_KM, MAX_SPHERE_KM)
    width = grid_cell_width(reach)
    # without coordinates there is no cell; such rows would all meet at one null key
    located = lambda df, lat, lon: df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    placed = located(build, build_lat, build_lon)
    at, of = ("_px", "_py", "_pz"), ("_bx", "_by", "_bz")
    p = with_neighbour_cells(_with_vector(located(probe, probe_lat, probe_lon), probe_lat, probe_lon, at), probe_lat, probe_lon, width)
    b = with_cell(_with_vector(placed, build_lat, build_lon, of), build_lat, build_lon, width)
    keys = list(KEYS)
    if cell_rows is not None:
        ensure_checkpoint_dir(build.sparkSession)
        leaves = split_hot_cells(placed, build_lat, build_lon, width, cell_rows)
        if leaves is not None:
            p, b = _split_sides(p, b, leaves, width, chord_for_km(reach), (probe_lat, probe_lon), (build_lat, build_lon))
            keys += ["_depth", "_salt"]
    if cell_rows is None and probe_rows_bound is not None and probe_rows_bound * 27 <= BROADCAST_ROWS:
        p = F.broadcast(p)
    else:
        # dealt by cell also where the build side is broadcast: a small probe table is one task, and its pairs are many
        p = p.repartition(*keys)
    joined = p.join(b, [p[k] == b[k] for k in keys], "inner")
    dist = rounded_km(haversine_km(p[probe_lat], p[probe_lon], b[build_lat], b[build_lon]))
    # the chord tells nearly all pairs apart; only in a thin shell the rounded distance has to
    gap = sum(((p[m] - b[n]) * (p[m] - b[n]) for m, n in zip(at[1:], of[1:])), (p[at[0]] - b[of[0]]) * (p[at[0]] - b[of[0]]))
    sure = chord_for_km(radius_km - _SHELL_KM) * (1.0 - 1e-9) - 1e-12
    near = dist <= F.lit(float(radius_km))
    if sure > 0:
        near = (gap < F.lit(sure * sure)) | near
    out_cols = ([p[c] for c in probe.columns] + [b[c] for c in build.columns]
                + [dist.alias(distance_col)])
    res = joined.where((gap <= F.lit(width * width)) & near).select(*out_cols)
    if extra_condition is not None:
        res = res.where(extra_condition)
    return res


def _forward_cells():
    """The own cell and one of each two opposite neighbours: every pair of adjacent cells once."""
    ahead = [(dx, dy, dz) for dx in (0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) if (dx, dy, dz) >= (0, 0, 0)]
    return F.array(*[F.struct(*[F.lit(d).alias(n) for d, n in zip(offset, ("dx", "dy", "dz"))]) for offset in ahead])


def duplicate_pairs(df: DataFrame, *, key: str, name: str, lat: str, lon: str,
                    threshold_km: float = 1.0, normalizer=None, materialize: bool = False) -> DataFrame:
    """Pairs (key_1 < key_2) with the same non-blank normalised name and
    distance <= threshold. Blocking on (name, grid cell) keeps work
    proportional to true candidates even when one name is very common. One side
    goes to 14 of the 27 cells around it, so that two rows meet once.
    ``materialize`` checkpoints the narrow rows, so ``df`` is computed once for both sides."""
    from ..functions.text import normalize_match_name
    norm = (normalizer or normalize_match_name)(F.col(name))
    width = grid_cell_width(threshold_km + _ROUNDING_MARGIN_KM)
    base = (df.select(F.col(key).alias("_k"), F.col(name).alias("_name"),
                      F.col(lat).alias("_lat"), F.col(lon).alias("_lon"), norm.alias("normalized_name"))
            .where(F.col("normalized_name") != ""))
    if materialize:
        ensure_checkpoint_dir(df.sparkSession)
        base = base.checkpoint()
    cells = with_cell(base, "_lat", "_lon", width)
    row = F.struct("_k", "_name", "_lat", "_lon")
    right = cells.select(row.alias("b"), "normalized_name", *KEYS)
    left = (cells.select(row.alias("a"), "normalized_name", *KEYS, F.explode(_forward_cells()).alias("_nb"))
            .select("a", "normalized_name", *[(F.col(k) + F.col(f"_nb.{d}")).alias(k) for k, d in zip(KEYS, ("dx", "dy", "dz"))],
                    ((F.col("_nb.dx") == 0) & (F.col("_nb.dy") == 0) & (F.col("_nb.dz") == 0)).alias("_own")))
    # within one cell both orders meet; elsewhere one
    met = (left.join(right, ["normalized_name", *KEYS])
           .where((F.col("a._k") < F.col("b._k")) | (~F.col("_own") & (F.col("a._k") > F.col("b._k"))))
           .select("normalized_name", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    d = haversine_atan2_km(F.col("a._lat"), F.col("a._lon"), F.col("b._lat"), F.col("b._lon"))
    return (met.select(F.col("a._k").alias(f"{key}_1"), F.col("b._k").alias(f"{key}_2"),
                       F.col("a._name").alias("name_1"), F.col("b._name").alias("name_2"), "normalized_name",
                       F.col("a._lat").alias("latitude_1"), F.col("a._lon").alias("longitude_1"),
                       F.col("b._lat").alias("latitude_2"), F.col("b._lon").alias("longitude_2"),
                       d.alias("_d"))
            .where(F.col("_d") <= F.lit(float(threshold_km)))
            .withColumn("distance_km", F.round(F.col("_d"), 6)).drop("_d")
            .withColumn("candidate_rule", F.lit(f"EXACT_NORMALIZED_NAME_AND_DISTANCE_LE_{threshold_km:g}_KM")))
