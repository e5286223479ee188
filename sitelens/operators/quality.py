"""Integrity checks as one issues table: (issue, record_key).

Each check is a filter, an anti join or a grouped count that returns the
offending keys; checks are combined with ``unionByName`` so one job
evaluates all of them. NULL handling follows SQL: a range or domain test on
a NULL value is not an issue (CHECK constraints pass on NULL).
"""

from __future__ import annotations

from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.amenities import CAMPGROUND_TYPES, RESTROOM_CATEGORIES, WATER_CATEGORIES
from ..session import ensure_checkpoint_dir, ship_package

ISSUE_COLUMNS = ("issue", "record_key")
# Most repeated ids that are broadcast to the pairs.
BROADCAST_IDS = 100_000
# Most runs of ascending keys that one task reports; with more, its rows are not in order.
TASK_RUNS = 256


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def record_key(*parts) -> Column:
    """``a || ':' || b`` with text casts; NULL if any part is NULL."""
    cols = [_c(p).cast("string") for p in parts]
    if len(cols) == 1:
        return cols[0]
    out = cols[0]
    for c in cols[1:]:
        out = F.concat(out, F.lit(":"), c)
    return out


def issues_where(df: DataFrame, condition: Column, issue: str, key: Column) -> DataFrame:
    return df.where(condition).select(F.lit(issue).alias("issue"), key.alias("record_key"))


def issues_of_made_rows(df: DataFrame, condition: Column, issue: str, key: Column) -> DataFrame:
    """``issues_where`` for rows whose columns are costly to make: the condition reads the finished columns, where a filter would
    be carried into the join that makes them and make them again for every test."""
    return df.select(F.explode(F.when(condition, F.array(F.lit(issue)))).alias("issue"), key.alias("record_key"))


def outside(col, low: float, high: float) -> Column:
    """SQL ``col NOT BETWEEN low AND high`` (NULL -> not an issue)."""
    return F.coalesce(~_c(col).between(low, high), F.lit(False))


def negative_issues(df: DataFrame, keys: Sequence[str], col: str, issue: str) -> DataFrame:
    return issues_where(df, F.coalesce(F.col(col) < 0, F.lit(False)), issue,
                        record_key(*keys))


def duplicate_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Key groups occurring more than once, with their row count ``n``.
    Partial aggregation runs before the shuffle, so a hot key costs one row
    per map task, not one row per occurrence."""
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
            .where(F.col("n") > 1))


def duplicate_issues(df: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    g = duplicate_groups(df, keys)
    return g.select(F.lit(issue).alias("issue"), record_key(*keys).alias("record_key"))


def _ascending_runs(batches):
    """(in order, first key, last key) of every run of strictly ascending keys in a task's rows; one row
    (false, nulls) if a key part is null or there are more than TASK_RUNS."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    runs, schema, ordered = [], None, True
    for batch in batches:
        schema = batch.schema
        if not ordered or not batch.num_rows:
            continue
        if any(c.null_count for c in batch.columns):
            ordered = False
            continue
        n = batch.num_rows
        up, same = pa.array(np.zeros(n - 1, bool)), pa.array(np.ones(n - 1, bool))
        for c in batch.columns:
            here, after = c.slice(0, n - 1), c.slice(1)
            up = pc.or_(up, pc.and_(same, pc.less(here, after)))
            same = pc.and_(same, pc.equal(here, after))
        starts = [0, *(np.flatnonzero(~up.to_numpy(zero_copy_only=False)) + 1).tolist()]
        if len(runs) + len(starts) > TASK_RUNS + 1:
            ordered = False
            continue
        at = lambda i: tuple(c[i].as_py() for c in batch.columns)
        for start, end in zip(starts, [*(s - 1 for s in starts[1:]), n - 1]):
            first, last = at(start), at(end)
            if start == 0 and runs and runs[-1][1] < first:
                runs[-1] = (runs[-1][0], last)
            else:
                runs.append((first, last))
    if schema is None or ordered and not runs:
        return
    if not ordered or len(runs) > TASK_RUNS:
        ordered, runs = False, [((None,) * len(schema),) * 2]
    columns = [pa.array([ordered] * len(runs), pa.bool_())]
    for side in (0, 1):
        columns += [pa.array([r[side][i] for r in runs], f.type) for i, f in enumerate(schema)]
    k = range(len(schema))
    yield pa.RecordBatch.from_arrays(columns, ["ordered", *[f"first_{i}" for i in k], *[f"last_{i}" for i in k]])


def keys_ascend(df: DataFrame, keys: Sequence[str]) -> bool:
    """The rows, as they are stored, are a few ascending runs of keys that don't overlap, so no key occurs twice.

    Every task compares neighbours and reports its runs; only these are brought together. False says
    nothing about the keys: rows in another order may be unique too."""
    ship_package(df.sparkSession)
    rows = df.select(*keys)
    types = [f.dataType for f in rows.schema]
    schema = T.StructType([T.StructField("ordered", T.BooleanType()), *[
        T.StructField(f"{side}_{i}", t) for side in ("first", "last") for i, t in enumerate(types)]])
    first, last = (F.struct(*[F.col(f"{side}_{i}") for i in range(len(types))]) for side in ("first", "last"))
    runs = rows.mapInArrow(_ascending_runs, schema).select("ordered", first.alias("first"), last.alias("last"))
    before = F.lag("last").over(Window.orderBy("first"))
    met = runs.select((~F.col("ordered") | F.coalesce(before >= F.col("first"), F.lit(False))).alias("met"))
    return not met.agg(F.bool_or("met")).first()[0]


def stored_duplicate_issues(df: DataFrame, keys: Sequence[str], issue: str) -> DataFrame:
    """``duplicate_issues`` of a table that was written in the order of its key: its rows are shuffled only if
    their order does not show already that no key repeats (a job over the keys)."""
    found = duplicate_issues(df, keys, issue)
    return found.where(F.lit(False)) if keys_ascend(df, keys) else found


def orphan_keys(child: DataFrame, child_key: str, parent: DataFrame, parent_key: str
                ) -> DataFrame:
    """Distinct non-NULL child keys that have no parent row (anti join).
    The child side is reduced to distinct keys before the shuffle."""
    keys = (child.select(F.col(child_key).alias("_k")).where(F.col("_k").isNotNull())
            .distinct())
    parents = parent.select(F.col(parent_key).alias("_k"))
    return keys.join(parents, "_k", "left_anti").withColumnRenamed("_k", child_key)


def orphan_issues(child, child_key, parent, parent_key, issue) -> DataFrame:
    o = orphan_keys(child, child_key, parent, parent_key)
    return o.select(F.lit(issue).alias("issue"), record_key(child_key).alias("record_key"))


def combine_one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side columns of several one-row aggregates (union + max;
    no join needed)."""
    u = frames[0]
    for f in frames[1:]:
        u = u.unionByName(f, allowMissingColumns=True)
    cols = [c for f in frames for c in f.columns]
    return u.agg(*[F.max(c).alias(c) for c in cols])


def _count(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("bigint").alias(name))


def cardinality_report(matrix: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of the distance table next to |left| and |right| and their product."""
    r = combine_one_row(_count(matrix, "matrix_rows"), _count(left, "park_count"),
                        _count(right, "campground_count"))
    return r.withColumn("full_matrix_rows", F.col("park_count") * F.col("campground_count"))


def union_issues(parts: Iterable[DataFrame]) -> DataFrame:
    parts = list(parts)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def row_rule_issues(df: DataFrame, key: Column, rules: Sequence[tuple]) -> DataFrame:
    """Several per-row rules in one pass: each row yields the names of the
    rules it breaks (an array, then explode). No filter on the array, which would
    be carried down to the scan and make the columns of the rules a second time."""
    hits = F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(issue))
                     for issue, cond in rules])
    return df.select(F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("issue"), key.alias("record_key"))


def absence_issues(df: DataFrame, checks: Sequence[tuple]) -> DataFrame:
    """Many uncorrelated NOT EXISTS checks as one global aggregate. Each
    check is (issue, [conditions]); it fires when any condition matches no
    row."""
    aggs, names = [], []
    for i, (issue, conds) in enumerate(checks):
        for j, c in enumerate(conds):
            aggs.append(F.max(F.when(c, 1).otherwise(0)).alias(f"_e{i}_{j}"))
    agg = df.agg(*aggs)
    fired = []
    for i, (issue, conds) in enumerate(checks):
        missing = F.lit(False)
        for j in range(len(conds)):
            missing = missing | (F.coalesce(F.col(f"_e{i}_{j}"), F.lit(0)) == 0)
        fired.append(F.when(missing, F.lit(issue)))
    return (agg.select(F.explode(F.filter(F.array(*fired), lambda x: x.isNotNull()))
                       .alias("issue"))
            .select("issue", F.lit("").alias("record_key")))


def location_issues(parks: DataFrame, campgrounds: DataFrame, areas: DataFrame,
                    bridge: DataFrame, distances: DataFrame | None = None) -> DataFrame:
    """The rule set of the location tables (coordinates, domains, duplicate
    pairs, and coverage of link/category states). ``distances`` is a join of ``parks`` and ``campgrounds``.
    Campground rules share one scan; coverage checks share one aggregate."""
    coord = outside("latitude", -90.0, 90.0) | outside("longitude", -180.0, 180.0)
    parts = [
        row_rule_issues(parks, record_key("park_id"),
                        [("invalid_national_park_coordinate", coord)]),
        row_rule_issues(campgrounds, record_key("campground_id"), [
            ("invalid_campground_coordinate", coord),
            ("invalid_campground_type", ~F.col("campground_type").isin(list(CAMPGROUND_TYPES))),
            ("invalid_water_category", ~F.col("water_category").isin(list(WATER_CATEGORIES))),
            ("invalid_restroom_category",
             ~F.col("restroom_category").isin(list(RESTROOM_CATEGORIES)))]),
        duplicate_issues(bridge, ["recarea_id", "activity_id"],
                         "duplicate_recreation_area_activity"),
        absence_issues(campgrounds, [
            ("no_linked_campgrounds", [F.col("recarea_id").isNotNull()]),
            ("no_unlinked_campgrounds", [F.col("recarea_id").isNull()]),
            ("water_unknown_or_negative_missing", [F.col("water_category") == "UNKNOWN",
                                                   F.col("water_category") == "NOT_AVAILABLE"]),
            ("restroom_unknown_or_negative_missing", [F.col("restroom_category") == "UNKNOWN",
                                                      F.col("restroom_category") == "NONE"])]),
    ]
    if "latitude" in areas.columns:
        parts.append(row_rule_issues(areas, record_key("recarea_id"),
                                     [("invalid_recreation_area_coordinate", coord)]))
    if distances is not None:
        parts.append(distance_issues(distances, parks, campgrounds))
    return union_issues(parts)


def _repeated_ids(df: DataFrame, key: str) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return duplicate_groups(df, [key]).select(key).checkpoint()


def distance_issues(distances: DataFrame, parks: DataFrame | None = None, campgrounds: DataFrame | None = None) -> DataFrame:
    """Negative distances (one issue per row) and repeated pairs (one per pair).

    ``parks`` and ``campgrounds``: the tables whose join ``distances`` is. A join meets two rows once, so a pair
    repeats only where one of its ids does; these are counted in the two tables, and only pairs
    with such an id are grouped. Without the tables, or with more than BROADCAST_IDS such ids, every pair is.
    """
    pair = ["park_id", "campground_id"]
    name = "duplicate_park_campground_distance"
    negative = issues_of_made_rows(distances, F.coalesce(F.col("distance_km") < 0.0, F.lit(False)), "negative_distance",
                                   record_key(*pair))
    if parks is None or campgrounds is None:
        return negative.unionByName(duplicate_issues(distances, pair, name))
    again = {"park_id": _repeated_ids(parks, "park_id"), "campground_id": _repeated_ids(campgrounds, "campground_id")}
    found = {k: df.count() for k, df in again.items()}
    if not any(found.values()):
        return negative
    doubtful = distances.select(*pair)
    if max(found.values()) <= BROADCAST_IDS:
        # a null id counts like others, as it does in a group
        for key, df in again.items():
            marked = F.broadcast(df.select(F.col(key).alias(f"_{key}"), F.lit(True).alias(f"_in_{key}")))
            doubtful = doubtful.join(marked, doubtful[key].eqNullSafe(marked[f"_{key}"]), "left").drop(f"_{key}")
        doubtful = doubtful.where(F.coalesce(*[f"_in_{k}" for k in pair])).select(*pair)
    return negative.unionByName(duplicate_issues(doubtful, pair, name))


def key_report(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """Primary-key health of one table: rows, rows with a NULL key part,
    and key groups that occur more than once (one row)."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    # one scan and one shuffle: key groups with their sizes carry all four figures
    groups = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    repeated = ~any_null & (F.col("_n") > 1)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return groups.agg(
        total(F.col("_n")).alias("row_count"), total(F.when(any_null, F.col("_n"))).alias("null_key_rows"),
        F.count_if(repeated).cast("bigint").alias("duplicate_key_groups"),
        total(F.when(repeated, F.col("_n") - 1)).alias("excess_rows")).select(
            F.lit(table).alias("table_name"), F.lit(",".join(keys)).alias("key_columns"),
            "row_count", "null_key_rows", "duplicate_key_groups", "excess_rows")


def issue_summary(issues: DataFrame, shown: int = 10) -> tuple[list, int]:
    """(first ``shown`` issues in order, number of issues not shown), in one pass over the issues."""
    total = Observation("issues")
    first = (issues.observe(total, F.count(F.lit(1)).alias("n"))
             .orderBy("issue", "record_key").limit(shown).collect())
    return first, max(0, total.get["n"] - len(first))


def activity_check_counts(results: DataFrame, bridge: DataFrame, activity_ids: Sequence) -> DataFrame:
    """One row: result rows, different result rows, and how many pairs of a result's
    area and a selected activity the bridge has. The last is the number of rows times
    the number of activities exactly if every row meets them all."""
    ids = list(dict.fromkeys(activity_ids))
    found = (bridge.where(F.col("activity_id").isin(ids)).select("recarea_id", "activity_id").distinct()
             .groupBy("recarea_id").agg(F.count(F.lit(1)).alias("_n")))
    return results.join(found, "recarea_id", "left").agg(
        F.count(F.lit(1)).cast("bigint").alias("result_rows"),
        F.countDistinct("campground_id").cast("bigint").alias("result_campgrounds"),
        F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint").alias("matched_pairs"),
        F.count_if(F.coalesce(F.col("_n"), F.lit(0)) < len(ids)).cast("bigint").alias("failing_rows"))
