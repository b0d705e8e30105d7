"""The queries of this library by name, and the SQL pieces that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.staging import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Common tables of the SQL.
TARGET = "target AS (SELECT 'target' AS series, CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS px FROM orders GROUP BY 2)"
PANEL = "panel AS (SELECT p_brand AS series, CAST(l_shipdate AS DATE) AS dt, avg(l_extendedprice / l_quantity) AS px FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
BARS = """bars AS (SELECT event_type AS series, date_trunc('hour', ts) AS dt, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low,
  last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2)"""
SPINE = "spine AS (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM panel), weekdays AS (SELECT dt FROM spine WHERE isodow(dt) <= 5)"
LAG = "OVER (PARTITION BY series ORDER BY dt)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_HELD: dict[tuple, object] = {}


def once(spark: SparkSession, d: str, name: str, make: Callable[[], object]):
    """What several queries share, made once a session and folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def held(spark: SparkSession, d: str, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A frame that several queries share, written once a session and folder."""
    return once(spark, d, name, lambda: written(make(), name))


def r(x: str, digits: int = 6) -> str:
    """fixed() in SQL."""
    return f"floor(({x}) * 1e{digits} + 0.501) / 1e{digits}"


def clip_sql(x: str, a: float, b: float) -> str:
    return f"CASE WHEN ({x}) IS NOT NULL THEN greatest(least({x}, {b}::DOUBLE), {a}::DOUBLE) END"


def z_sql(x: str, n: int, bound: int = 3, part: str = "series") -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY dt ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    own = f"coalesce({x}, 0)"
    return f"CASE WHEN coalesce(stddev_samp({own}) {over}, 0) > 1e-12 THEN greatest(least(({own} - avg({own}) {over}) / stddev_samp({own}) {over}, {bound}), -{bound}) ELSE 0.0 END"


def over(a: str, b: str = "CURRENT ROW") -> str:
    return f"OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN {a} AND {b})"
