"""Registered queries: a Spark plan and a DuckDB oracle for each.

Every query reads the driver tables (or what Spark derives from them) in
full; parameters are fixed per query so results are reproducible. The
oracle states the same result in plain SQL over the same tables, using brute
force where the Spark plan uses blocking (e.g. the radius join).
"""

from __future__ import annotations

from typing import Callable, Optional

from pyspark.sql import DataFrame, SparkSession

from ..sources import projection as P

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, oracle: Optional[str] = None):
    def deco(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if oracle is not None:
            _ORACLES[name] = oracle
        return fn
    return deco


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def oracle_of(name: str) -> str:
    """The statement of a query that is registered already."""
    return _ORACLES[name]


def with_domain(select_sql: str) -> str:
    """Oracle text: the domain projection as CTEs, then the query."""
    return f"WITH {P.ORACLE_CTES.strip()}\n{select_sql}"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Clamped arcsine haversine in SQL (same formula as the Spark column)."""
    s1 = f"sin((radians({lat2}) - radians({lat1})) / 2)"
    s2 = f"sin((radians({lon2}) - radians({lon1})) / 2)"
    h = f"({s1} * {s1} + cos(radians({lat1})) * cos(radians({lat2})) * ({s2} * {s2}))"
    return f"(6371.0088 * (2.0 * asin(sqrt(least(1.0, greatest(0.0, {h}))))))"


def dist_sql(lat1, lon1, lat2, lon2) -> str:
    return f"round({hav_sql(lat1, lon1, lat2, lon2)}, 6)"


_loaded = False


def _load():
    global _loaded
    if _loaded:
        return
    _loaded = True
    from . import queries_search, queries_quality, queries_text, queries_entities  # noqa: F401
    from . import queries_profile, queries_sources, queries_stats, queries_typed  # noqa: F401
    from . import queries_jobs, queries_layout  # noqa: F401
