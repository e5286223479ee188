"""Location-domain tables projected from the driver's benchmark tables.

parks        <- supplier (+ nation for the state label)
campgrounds  <- customer (+ nation); raw amenity text picked from fixed
                phrase lists by key, then cleaned by ``sitelens.functions``
areas        <- events, one row per user_id
activities   <- events, one row per event_type
bridge       <- events, distinct (user_id, event_type)

Every projection is a narrow per-row map (no shuffle) except the three
event-derived tables, which are one hash aggregate each (partial aggregation
before the exchange, so the shuffle is bounded by distinct keys).

``ORACLE_CTES`` states the same projection in DuckDB SQL for the oracle.
Its category columns are the *expected* cleaned values of each phrase, so
the oracle checks the Spark cleaning rules rather than repeating them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import amenities as A
from ..functions import text as TX
from ..session import ship_package, table_path

# Phrases as a source might word them, each with the category that the rules
# must give it. The row's key modulo the list length picks the phrase.
TYPE_PHRASES = (("horse camp", "HORSE CAMP"),
                ("Campground ", "CAMPGROUND"),
                ("\tGROUP  Campground", "GROUP CAMPGROUND"))
FEE_PHRASES = ((None, "UNKNOWN"), ("y", "YES"), ("n", "NO"), (" Y", "YES"), ("free", "UNKNOWN"),
               ("N ", "NO"), (" ", "UNKNOWN"))
WATER_PHRASES = (("Faucets stand at both loops", "AVAILABLE"),
                 ("Bring your own: none provided", "NOT_AVAILABLE"),
                 ("Hand pump beside the gate", "AVAILABLE"),
                 ("Fill up at the adjacent ranger station", "NEARBY"),
                 ("Boil before use", "OTHER"),
                 ("A spring runs past site 4", "NATURAL_SOURCE"),
                 ("Please treat whatever you take", "NATURAL_SOURCE"),
                 ("yes..", "AVAILABLE"),
                 ("Ask the host", "UNKNOWN"),
                 ("The loop is not served with water this year", "NOT_AVAILABLE"),
                 ("Trough for horses", "OTHER"),
                 ("N/A", "UNKNOWN"),
                 (None, "UNKNOWN"))
RESTROOM_PHRASES = (("One outhouse", "VAULT"),
                    ("Showers with flushing units", "FLUSH"),
                    ("Compost unit by the trail", "COMPOSTING"),
                    ("A porta-pot in season", "PORTABLE"),
                    ("Flush by day, pit toilet by night", "MULTIPLE"),
                    ("There are no toilets here", "NONE"),
                    ("Shower house only", "OTHER"),
                    ("not specified", "UNKNOWN"),
                    ("Available", "OTHER"),
                    (None, "UNKNOWN"),
                    ("\u00a0", "UNKNOWN"))

AREA_MODULUS = 157          # recarea link = key % 157; some links dangle on purpose
UNLINKED_EVERY = 4          # key % 4 = 0 -> no recarea link


def _pick(key, phrases, idx: int):
    arr = F.array(*[F.lit(p[idx]).cast("string") for p in phrases])
    return F.element_at(arr, (F.pmod(key, F.lit(len(phrases))) + 1).cast("int"))


_MEMO: dict = {}


def memoized(fn):
    """Reuse the DataFrame (an immutable plan) per session and directory, so
    file listing, footer reads and analysis happen once per process."""
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        key = (spark.sparkContext.applicationId, id(spark), fn.__name__, sf_dir, args)
        df = _MEMO.get(key)
        if df is None:
            df = _MEMO[key] = fn(spark, sf_dir, *args)
        return df
    wrapper.__name__ = fn.__name__
    wrapper.__doc__ = fn.__doc__
    return wrapper


@memoized
def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(table_path(sf_dir, name))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table (shared, memoised scan definition)."""
    return _read(spark, sf_dir, name)


def _lat(key, mult):
    return (F.pmod(key * F.lit(mult), F.lit(1700)).cast("double") / 10 - 85)


def _lon(key, mult):
    return (F.pmod(key * F.lit(mult), F.lit(3600)).cast("double") / 10 - 180)


@memoized
def nations(spark, sf_dir) -> DataFrame:
    # 25 rows by definition of the schema: a fixed-size dimension.
    return _read(spark, sf_dir, "nation").select("n_nationkey", "n_name")


@memoized
def parks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _read(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    return (s.join(F.broadcast(nations(spark, sf_dir)),
                   s.s_nationkey == F.col("n_nationkey"), "left")
            .select(k.alias("park_id"), F.col("s_name").alias("name"),
                    F.col("n_name").alias("state_or_territory"),
                    _lat(k, 7919).alias("latitude"), _lon(k, 104729).alias("longitude")))


@memoized
def raw_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty source rows: text fields as a source system would deliver them."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return (c.join(F.broadcast(nations(spark, sf_dir)),
                   c.c_nationkey == F.col("n_nationkey"), "left")
            .select(
                k.alias("campground_id"),
                F.col("c_name").alias("site_name"),
                _pick(k, TYPE_PHRASES, 0).alias("site_subtype"),
                _pick(k, FEE_PHRASES, 0).alias("fee_charged_raw"),
                _pick(k, WATER_PHRASES, 0).alias("water_availability_raw"),
                _pick(k, RESTROOM_PHRASES, 0).alias("restroom_availability_raw"),
                F.when(F.pmod(k, F.lit(UNLINKED_EVERY)) == 0, F.lit(None).cast("bigint"))
                .otherwise(F.pmod(k, F.lit(AREA_MODULUS))).alias("recarea_id"),
                F.when(F.pmod(k, F.lit(6)) == 0, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("https://example.org/site/"), k.cast("string")))
                .alias("official_url"),
                F.when(F.pmod(k, F.lit(5)) == 1, F.lit(None).cast("string"))
                .otherwise(F.concat(F.lit("Route "), F.pmod(k, F.lit(97)).cast("string")))
                .alias("directions"),
                F.col("c_mktsegment").alias("fee_description"),
                F.col("n_name").alias("closest_towns"),
                F.when(F.pmod(k, F.lit(3)) == 0, F.lit(None).cast("string"))
                .otherwise(F.lit("Open all year")).alias("operational_hours"),
                F.pmod(k, F.lit(50)).cast("double").alias("total_capacity"),
                _lat(k, 15485863).alias("latitude"),
                _lon(k, 32452843).alias("longitude")))


@memoized
def campgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned campgrounds: categories computed by the cleaning functions."""
    r = raw_sites(spark, sf_dir).select(
        "*", TX.phrase_text("water_availability_raw").alias("_wt"),
        TX.phrase_text("restroom_availability_raw").alias("_rt"))
    return r.select(
        "campground_id",
        TX.clean_text("site_name").alias("name"),
        TX.normalize_site_subtype("site_subtype").alias("campground_type"),
        "recarea_id",
        A.convert_fee("fee_charged_raw").alias("fee_charged"),
        F.lit(None).cast("string").alias("fee_type"),
        "fee_description",
        A.water_from_phrase(F.col("_wt")).alias("water_category"),
        "water_availability_raw",
        A.restroom_from_phrase(F.col("_rt")).alias("restroom_category"),
        "restroom_availability_raw",
        "directions", "closest_towns", "operational_hours", "total_capacity",
        "latitude", "longitude", "official_url")


@memoized
def areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("user_id").distinct()
    u = F.col("user_id")
    return e.select(
        u.alias("recarea_id"),
        F.concat(F.lit("Area "), u.cast("string")).alias("name"),
        F.concat(F.lit("https://example.org/area/"), u.cast("string")).alias("official_url"),
        F.concat(F.lit("Forest "), F.pmod(u, F.lit(7)).cast("string")).alias("forest_name"),
        F.when(F.pmod(u, F.lit(3)) == 0, "Closed").otherwise("Open").alias("open_status"),
        F.when(F.pmod(u, F.lit(4)) != 0, F.concat(F.lit("May "), (F.pmod(u, F.lit(28)) + 1).cast("string")))
        .alias("open_season_start"),
        F.when(F.pmod(u, F.lit(4)) != 0, F.lit("September 30")).alias("open_season_end"),
        F.concat(F.lit("Description of area "), u.cast("string")).alias("description"),
        F.when(F.pmod(u, F.lit(2)) == 0, F.lit("Paved paths")).alias("accessibility"))


@memoized
def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events").select("event_type").distinct()
    t = F.col("event_type")
    return e.select(
        t.alias("activity_id"),
        F.concat(F.upper(F.substring(t, 1, 1)), F.expr("substring(event_type, 2)")).alias("name"),
        F.lit("root").alias("parent_activity_id"),
        F.lit("All activities").alias("parent_activity_name"))


@memoized
def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "events")
    return (e.select(F.col("user_id").alias("recarea_id"), F.col("event_type").alias("activity_id"))
            .distinct())


class _Domain(dict):
    """Domain tables built on first access."""

    def __init__(self, spark, sf_dir):
        super().__init__()
        self._spark, self._dir = spark, sf_dir

    def __missing__(self, name):
        builders = {"parks": parks, "campgrounds": campgrounds, "areas": areas,
                    "activities": activities, "bridge": bridge}
        df = self[name] = builders[name](self._spark, self._dir)
        return df


def domain(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Domain(spark, sf_dir)


# ---------------------------------------------------------------- oracle SQL

def _sql_lit(v):
    if v is None:
        return "CAST(NULL AS VARCHAR)"
    return "'" + v.replace("'", "''") + "'"


def _sql_case(key: str, phrases, idx: int) -> str:
    n = len(phrases)
    arms = " ".join(f"WHEN {i} THEN {_sql_lit(p[idx])}" for i, p in enumerate(phrases))
    return f"(CASE ({key}) % {n} {arms} END)"


def _sql_lat(k, m):
    return f"(CAST(({k}*{m}) % 1700 AS DOUBLE)/10 - 85)"


def _sql_lon(k, m):
    return f"(CAST(({k}*{m}) % 3600 AS DOUBLE)/10 - 180)"


ORACLE_CTES = f"""
parks AS (
  SELECT s.s_suppkey AS park_id, s.s_name AS name, n.n_name AS state_or_territory,
         {_sql_lat('s.s_suppkey', 7919)} AS latitude, {_sql_lon('s.s_suppkey', 104729)} AS longitude
  FROM supplier s LEFT JOIN nation n ON n.n_nationkey = s.s_nationkey),
raw_sites AS (
  SELECT c.c_custkey AS campground_id, c.c_name AS site_name,
         {_sql_case('c.c_custkey', TYPE_PHRASES, 0)} AS site_subtype,
         {_sql_case('c.c_custkey', TYPE_PHRASES, 1)} AS campground_type,
         {_sql_case('c.c_custkey', FEE_PHRASES, 0)} AS fee_charged_raw,
         {_sql_case('c.c_custkey', FEE_PHRASES, 1)} AS fee_charged,
         {_sql_case('c.c_custkey', WATER_PHRASES, 0)} AS water_availability_raw,
         {_sql_case('c.c_custkey', WATER_PHRASES, 1)} AS water_category,
         {_sql_case('c.c_custkey', RESTROOM_PHRASES, 0)} AS restroom_availability_raw,
         {_sql_case('c.c_custkey', RESTROOM_PHRASES, 1)} AS restroom_category,
         CASE WHEN c.c_custkey % {UNLINKED_EVERY} = 0 THEN CAST(NULL AS BIGINT)
              ELSE c.c_custkey % {AREA_MODULUS} END AS recarea_id,
         CASE WHEN c.c_custkey % 6 = 0 THEN CAST(NULL AS VARCHAR)
              ELSE 'https://example.org/site/' || CAST(c.c_custkey AS VARCHAR) END AS official_url,
         CASE WHEN c.c_custkey % 5 = 1 THEN CAST(NULL AS VARCHAR)
              ELSE 'Route ' || CAST(c.c_custkey % 97 AS VARCHAR) END AS directions,
         c.c_mktsegment AS fee_description, n.n_name AS closest_towns,
         CASE WHEN c.c_custkey % 3 = 0 THEN CAST(NULL AS VARCHAR) ELSE 'Open all year' END
              AS operational_hours,
         CAST(c.c_custkey % 50 AS DOUBLE) AS total_capacity,
         {_sql_lat('c.c_custkey', 15485863)} AS latitude,
         {_sql_lon('c.c_custkey', 32452843)} AS longitude
  FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey),
campgrounds AS (
  SELECT campground_id, site_name AS name, campground_type, recarea_id, fee_charged,
         CAST(NULL AS VARCHAR) AS fee_type, fee_description, water_category,
         water_availability_raw, restroom_category, restroom_availability_raw, directions,
         closest_towns, operational_hours, total_capacity, latitude, longitude, official_url
  FROM raw_sites),
areas AS (
  SELECT user_id AS recarea_id, 'Area ' || CAST(user_id AS VARCHAR) AS name,
         'https://example.org/area/' || CAST(user_id AS VARCHAR) AS official_url,
         'Forest ' || CAST(user_id % 7 AS VARCHAR) AS forest_name,
         CASE WHEN user_id % 3 = 0 THEN 'Closed' ELSE 'Open' END AS open_status,
         CASE WHEN user_id % 4 <> 0 THEN 'May ' || (user_id % 28 + 1) END AS open_season_start,
         CASE WHEN user_id % 4 <> 0 THEN 'September 30' END AS open_season_end,
         'Description of area ' || user_id AS description,
         CASE WHEN user_id % 2 = 0 THEN 'Paved paths' END AS accessibility
  FROM (SELECT DISTINCT user_id FROM events)),
activities AS (
  SELECT event_type AS activity_id,
         upper(substr(event_type, 1, 1)) || substr(event_type, 2) AS name,
         'root' AS parent_activity_id, 'All activities' AS parent_activity_name
  FROM (SELECT DISTINCT event_type FROM events)),
bridge AS (
  SELECT DISTINCT user_id AS recarea_id, event_type AS activity_id
  FROM events)
"""


# ------------------------------------------------- raw text feeds for cleaning

# Fixed raw phrases (source-like text; the cleaning rules decide their fate).
SUBTYPE_PHRASES = ("CAMPGROUND", "  group   campground ", "Horse Camp", "campground",
                   "CAMPING AREA", "Day Use Area")
CAPACITY_SUFFIX = ("", ".50", None, None)       # key % 4: n, n.50, 'about 20', ''
PORTAL = "https://portal.example.gov/site"


def _tenths_text(t):
    """Text of a signed tenths integer, e.g. -123 -> '-12.3' (exact)."""
    a = F.abs(t)
    return F.concat(F.when(t < 0, F.lit("-")).otherwise(F.lit("")),
                    F.floor(a / 10).cast("bigint").cast("string"), F.lit("."),
                    F.pmod(a, F.lit(10)).cast("string"))


@memoized
def raw_site_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site rows as all-text source records (column names of the source feed).
    Pairs (10j, 10j+1) share a name and a position: duplicate candidates."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    cp = F.when(F.pmod(k, F.lit(10)) == 1, k - 1).otherwise(k)
    lat_t = F.pmod(cp * F.lit(15485863), F.lit(1700)) - 850
    lon_t = F.pmod(cp * F.lit(32452843), F.lit(3600)) - 1800
    ks = k.cast("string")
    m157 = F.pmod(k, F.lit(157)).cast("string")
    m60 = F.pmod(k, F.lit(60)).cast("string")
    url = (F.when(F.pmod(k, F.lit(5)) == 0, F.lit(""))
           .when(F.pmod(k, F.lit(5)) == 1, F.lit(PORTAL + "?actid=29"))
           .when(F.pmod(k, F.lit(5)) == 2, F.lit(PORTAL + "?recid=99999"))
           .when(F.pmod(k, F.lit(5)) == 3, F.concat(F.lit(PORTAL + "?RecId="), m157,
                                                    F.lit("&actid=29")))
           .otherwise(F.concat(F.lit("portal.example.gov/site?actid=7&recid="), m157,
                               F.lit("#top"))))
    return c.select(
        (k + 2).alias("source_row_number"),
        ks.alias("objectid"),
        F.when(F.pmod(k, F.lit(17)) == 0, F.lit("  "))
        .otherwise(F.concat(F.lit("{G-"), F.lpad(ks, 8, "0"), F.lit("}"))).alias("globalid"),
        F.lpad(ks, 5, "0").alias("site_cn"),
        F.lpad(F.pmod(k, F.lit(1000)).cast("string"), 5, "0").alias("site_id"),
        F.lit("").alias("root_cn"), F.lit("").alias("parent_cn"),
        F.when(F.pmod(k, F.lit(7)) == 0, F.concat(F.lit("  "), F.col("c_name"), F.lit("  ")))
        .otherwise(F.col("c_name")).alias("site_name"),
        F.when(F.pmod(k, F.lit(10)) <= 1, F.concat(F.lit("Twin-Camp "), cp.cast("string")))
        .when(F.pmod(k, F.lit(3)) == 0, F.concat(F.lit("Camp "), F.pmod(k, F.lit(40)).cast("string")))
        .otherwise(F.lit("")).alias("public_site_name"),
        F.concat(F.lit("Area "), m157).alias("recarea_name"),
        _pick(k, tuple((p, p) for p in SUBTYPE_PHRASES), 0).alias("site_subtype"),
        F.when(F.pmod(k, F.lit(19)) == 0, F.lit("91"))
        .when(F.pmod(k, F.lit(23)) == 0, F.lit("n/a"))
        .otherwise(_tenths_text(lat_t)).alias("latitude"),
        F.when(F.pmod(k, F.lit(29)) == 0, F.lit(""))
        .when(F.pmod(k, F.lit(31)) == 0, F.lit("-181.5"))
        .otherwise(_tenths_text(lon_t)).alias("longitude"),
        url.alias("usda_portal_url"),
        _pick(k, FEE_PHRASES, 0).alias("fee_charged"),
        F.when(F.pmod(k, F.lit(4)) == 0, m60)
        .when(F.pmod(k, F.lit(4)) == 1, F.concat(m60, F.lit(".50")))
        .when(F.pmod(k, F.lit(4)) == 2, F.lit("about 20"))
        .otherwise(F.lit("")).alias("total_capacity"),
        _pick(k, WATER_PHRASES, 0).alias("water_availability"),
        _pick(k, RESTROOM_PHRASES, 0).alias("restroom_availability"),
        F.lit("").alias("fee_type"),
        F.col("c_mktsegment").alias("fee_description"),
        F.concat(F.lit("Route "), F.pmod(k, F.lit(97)).cast("string")).alias("directions"),
        F.lit("").alias("site_directions"), F.lit("").alias("closest_towns"),
        F.lit("").alias("operational_hours"), F.lit("").alias("rec1stop_url"),
        F.lit("").alias("last_update"))


@memoized
def area_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known area identifiers as text (for link resolution)."""
    return (_read(spark, sf_dir, "events").select(F.col("user_id").cast("string")
                                                  .alias("recarea_id")).distinct())


def _sql_tenths(t):
    return (f"((CASE WHEN ({t}) < 0 THEN '-' ELSE '' END) || "
            f"CAST(CAST(floor(abs({t}) / 10) AS BIGINT) AS VARCHAR) || '.' || "
            f"CAST(abs({t}) % 10 AS VARCHAR))")


_CP = "(CASE WHEN c.c_custkey % 10 = 1 THEN c.c_custkey - 1 ELSE c.c_custkey END)"

RAW_SITES_SQL = f"""
raw_site_records AS (
  SELECT c.c_custkey + 2 AS source_row_number,
    CAST(c.c_custkey AS VARCHAR) AS objectid,
    CASE WHEN c.c_custkey % 17 = 0 THEN '  '
         ELSE '{{G-' || lpad(CAST(c.c_custkey AS VARCHAR), 8, '0') || '}}' END AS globalid,
    lpad(CAST(c.c_custkey AS VARCHAR), 5, '0') AS site_cn,
    lpad(CAST(c.c_custkey % 1000 AS VARCHAR), 5, '0') AS site_id,
    '' AS root_cn, '' AS parent_cn,
    CASE WHEN c.c_custkey % 7 = 0 THEN '  ' || c.c_name || '  ' ELSE c.c_name END AS site_name,
    CASE WHEN c.c_custkey % 10 <= 1 THEN 'Twin-Camp ' || CAST({_CP} AS VARCHAR)
         WHEN c.c_custkey % 3 = 0 THEN 'Camp ' || CAST(c.c_custkey % 40 AS VARCHAR)
         ELSE '' END AS public_site_name,
    'Area ' || CAST(c.c_custkey % 157 AS VARCHAR) AS recarea_name,
    {_sql_case('c.c_custkey', tuple((p, p) for p in SUBTYPE_PHRASES), 0)} AS site_subtype,
    {_sql_case('c.c_custkey', tuple((p, p) for p in SUBTYPE_PHRASES), 0)} AS site_subtype_raw,
    CASE WHEN c.c_custkey % 19 = 0 THEN '91' WHEN c.c_custkey % 23 = 0 THEN 'n/a'
         ELSE {_sql_tenths(f'(({_CP} * 15485863) % 1700) - 850')} END AS latitude,
    CASE WHEN c.c_custkey % 29 = 0 THEN '' WHEN c.c_custkey % 31 = 0 THEN '-181.5'
         ELSE {_sql_tenths(f'(({_CP} * 32452843) % 3600) - 1800')} END AS longitude,
    CASE c.c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '{PORTAL}?actid=29'
         WHEN 2 THEN '{PORTAL}?recid=99999'
         WHEN 3 THEN '{PORTAL}?RecId=' || CAST(c.c_custkey % 157 AS VARCHAR) || '&actid=29'
         ELSE 'portal.example.gov/site?actid=7&recid=' || CAST(c.c_custkey % 157 AS VARCHAR)
              || '#top' END AS usda_portal_url,
    {_sql_case('c.c_custkey', FEE_PHRASES, 0)} AS fee_charged_raw,
    {_sql_case('c.c_custkey', FEE_PHRASES, 1)} AS fee_charged,
    CASE c.c_custkey % 4 WHEN 0 THEN CAST(c.c_custkey % 60 AS VARCHAR)
         WHEN 1 THEN CAST(c.c_custkey % 60 AS VARCHAR) || '.50' WHEN 2 THEN 'about 20'
         ELSE '' END AS total_capacity_raw,
    CASE c.c_custkey % 4 WHEN 0 THEN CAST(c.c_custkey % 60 AS VARCHAR)
         WHEN 1 THEN CAST(c.c_custkey % 60 AS VARCHAR) || '.5' ELSE '' END AS total_capacity,
    {_sql_case('c.c_custkey', WATER_PHRASES, 0)} AS water_availability_raw,
    {_sql_case('c.c_custkey', WATER_PHRASES, 1)} AS water_availability,
    {_sql_case('c.c_custkey', RESTROOM_PHRASES, 0)} AS restroom_availability_raw,
    {_sql_case('c.c_custkey', RESTROOM_PHRASES, 1)} AS restroom_availability,
    c.c_mktsegment AS fee_description,
    'Route ' || CAST(c.c_custkey % 97 AS VARCHAR) AS directions
  FROM customer c),
site_area_ids AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS recarea_id FROM events),
routed_sites AS (
  SELECT r.*,
    upper(trim(regexp_replace(r.site_subtype, '\\s+', ' ', 'g'))) AS subtype_norm,
    trim(r.globalid) AS gid,
    CASE WHEN TRY_CAST(trim(r.latitude) AS DOUBLE) BETWEEN -90 AND 90
         THEN TRY_CAST(trim(r.latitude) AS DOUBLE) END AS lat,
    CASE WHEN TRY_CAST(trim(r.longitude) AS DOUBLE) BETWEEN -180 AND 180
         THEN TRY_CAST(trim(r.longitude) AS DOUBLE) END AS lon
  FROM raw_site_records r),
routed_reasons AS (
  SELECT *,
    CASE WHEN subtype_norm NOT IN ('CAMPGROUND', 'GROUP CAMPGROUND', 'HORSE CAMP')
           THEN 'UNSUPPORTED_SITE_SUBTYPE'
         WHEN gid = '' THEN 'MISSING_GLOBALID'
         WHEN lat IS NULL AND lon IS NULL THEN 'INVALID_LATITUDE_AND_LONGITUDE'
         WHEN lat IS NULL THEN 'INVALID_LATITUDE'
         WHEN lon IS NULL THEN 'INVALID_LONGITUDE' END AS drop_reason
  FROM routed_sites),
kept_sites AS (
  SELECT *, trim(regexp_replace(usda_portal_url, '\\s+', ' ', 'g')) AS url_clean,
    COALESCE(regexp_extract('&' || COALESCE(regexp_extract(usda_portal_url, '^[^?#]*\\?([^#]*)', 1), ''),
                   '(?i)&recid(?:=([^&]*))?(?:&|$)', 1), '') AS recid
  FROM routed_reasons WHERE drop_reason IS NULL),
clean_sites AS (
  SELECT gid AS campground_id, gid AS globalid, site_cn, site_id, objectid, root_cn, parent_cn,
    COALESCE(NULLIF(trim(regexp_replace(public_site_name, '\\s+', ' ', 'g')), ''),
             NULLIF(trim(regexp_replace(site_name, '\\s+', ' ', 'g')), ''),
             NULLIF(trim(regexp_replace(recarea_name, '\\s+', ' ', 'g')), ''), '') AS name,
    trim(regexp_replace(public_site_name, '\\s+', ' ', 'g')) AS public_site_name,
    trim(regexp_replace(site_name, '\\s+', ' ', 'g')) AS site_name,
    recarea_name, subtype_norm AS site_subtype, site_subtype_raw,
    CASE WHEN recid <> '' AND recid IN (SELECT recarea_id FROM site_area_ids) THEN recid
         ELSE '' END AS recarea_id,
    recid AS recid_extracted, fee_charged, COALESCE(fee_charged_raw, '') AS fee_charged_raw,
    '' AS fee_type, fee_description, total_capacity, total_capacity_raw,
    water_availability, COALESCE(water_availability_raw, '') AS water_availability_raw,
    restroom_availability, COALESCE(restroom_availability_raw, '') AS restroom_availability_raw,
    directions, '' AS site_directions, '' AS closest_towns, '' AS operational_hours,
    url_clean AS official_url, url_clean AS usda_portal_url, '' AS rec1stop_url,
    trim(latitude) AS latitude, trim(longitude) AS longitude, '' AS last_update
  FROM kept_sites)
"""


# English month names (the date parser reads full names).
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August",
          "September", "October", "November", "December")
CSS_NOISE = ".mw-parser-output .geo-default{display:inline}"


def _hemi_text(t, pos, neg):
    """'44.3°N' style text of a signed tenths value."""
    a = F.abs(t)
    return F.concat(F.floor(a / 10).cast("bigint").cast("string"), F.lit("."),
                    F.pmod(a, F.lit(10)).cast("string"), F.lit("°"),
                    F.when(t < 0, F.lit(neg)).otherwise(F.lit(pos)))


def _dms_text(t, pos, neg):
    """'44°18′N' style text: tenths of a degree as minutes (x 6)."""
    a = F.abs(t)
    return F.concat(F.floor(a / 10).cast("bigint").cast("string"), F.lit("°"),
                    (F.pmod(a, F.lit(10)) * 6).cast("string"), F.lit("′"),
                    F.when(t < 0, F.lit(neg)).otherwise(F.lit(pos)))


@memoized
def raw_park_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Park rows as encyclopedia-style text, one per supplier."""
    s = _read(spark, sf_dir, "supplier")
    s = s.join(F.broadcast(nations(spark, sf_dir)), s.s_nationkey == F.col("n_nationkey"),
               "left")
    k = F.col("s_suppkey")
    la = F.pmod(k * F.lit(7919), F.lit(1700)) - 850
    lo = F.pmod(k * F.lit(104729), F.lit(3600)) - 1800
    dec = F.concat(_hemi_text(la, "N", "S"), F.lit(" "), _hemi_text(lo, "E", "W"))
    dms = F.concat(_dms_text(la, "N", "S"), F.lit(" "), _dms_text(lo, "E", "W"))
    nation = F.coalesce(F.col("n_name"), F.lit(""))
    m4, m3, m9 = F.pmod(k, F.lit(4)), F.pmod(k, F.lit(3)), F.pmod(k, F.lit(9))
    acres = F.pmod(k * F.lit(7919), F.lit(10000000))
    visitors = F.pmod(k * F.lit(104729), F.lit(5000000))
    month = F.element_at(F.array(*[F.lit(m) for m in MONTHS]),
                         (F.pmod(k, F.lit(12)) + 1).cast("int"))
    return s.select(
        (k + 2).alias("source_row_number"),
        F.when(m9 == 0, F.lit(""))
        .when(m9 == 1, F.concat(F.lit(" "), F.col("s_name"), F.lit(" **")))
        .when(m9 == 2, F.concat(F.col("s_name"), F.lit(" &amp; Preserve")))
        .otherwise(F.col("s_name")).alias("name"),
        F.when(m4 == 0, F.concat(nation, F.lit(CSS_NOISE), dms, F.lit(" / "), dec))
        .when(m4 == 1, F.concat(nation, F.lit(" "), dms, F.lit(" / "), dec))
        .when(m4 == 2, F.concat(nation, F.lit(" "), dms))
        .otherwise(F.lit("Unknown location")).alias("location"),
        F.when(m3 == 0, F.concat(month, F.lit(" "), (F.pmod(k, F.lit(28)) + 1).cast("string"),
                                 F.lit(", "), (F.pmod(k, F.lit(120)) + 1900).cast("string"),
                                 F.lit("["), F.pmod(k, F.lit(100)).cast("string"), F.lit("]")))
        .when(m3 == 1, F.lit("not a date")).otherwise(F.lit("")).alias("established"),
        F.when(m4 == 0, F.concat(F.format_number(acres, 0), F.lit("."),
                                 F.lpad(F.pmod(k, F.lit(100)).cast("string"), 2, "0"),
                                 F.lit(" acres (12.5 km2)")))
        .when(m4 == 1, F.concat(acres.cast("string"), F.lit(" acres")))
        .when(m4 == 2, F.lit("unknown"))
        .otherwise(F.concat(F.format_number(acres, 0), F.lit(" acre"))).alias("area"),
        F.when(m3 == 0, F.format_number(visitors, 0)).when(m3 == 1, F.lit("12.5"))
        .otherwise(visitors.cast("string")).alias("visitors"),
        F.concat(F.lit("Founded ["), F.pmod(k, F.lit(50)).cast("string"), F.lit("] near "),
                 F.col("s_name")).alias("description"))
