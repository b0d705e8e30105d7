"""Series read from Parquet tables, and the cleaning of rows that come as text.

Every series is long: (series, dt, px), one row a series and date, so that all later windows partition by series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import clean_symbol


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def target_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, dt, px): the mean order price by day, as the series 'target'."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("dt"), "o_totalprice")
    return orders.groupBy("dt").agg(F.avg("o_totalprice").alias("px")).select(F.lit("target").alias("series"), "dt", "px")


def panel_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, dt, px): the mean unit price by ship day and brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("series"))
    items = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("dt"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"))
    return items.join(part, items.l_partkey == part.p_partkey).groupBy("series", "dt").agg(F.avg("unit").alias("px"))


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, dt, open, high, low, close, volume): hourly bars of each event type; dt is the hour."""
    events = table(spark, sf_dir, "events")
    at = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("series"), F.date_trunc("hour", "ts").alias("dt")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count("*").cast("double").alias("volume")
    )


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, dt, open, high, low, close, volume): daily bars of order prices, as the series 'target'."""
    orders = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("dt"), "o_orderkey", "o_totalprice")
    rows = orders.groupBy("dt").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count("*").cast("double").alias("volume")
    )
    return rows.select(F.lit("target").alias("series"), "*")


def number(text: Column) -> Column:
    """A number written with thousands commas and blanks; null where it isn't one."""
    return F.regexp_replace(F.trim(text), ",", "").try_cast("double")


def sheet_rows(rows: DataFrame, date: str, value: str, order: str) -> DataFrame:
    """(dt, value) of text rows: dates day first, no zeros or unreadable cells, the last row (by order) of each date."""
    read = rows.select(F.try_to_timestamp(F.trim(date), F.lit("dd/MM/yyyy")).cast("date").alias("dt"), number(F.col(value)).alias("value"), F.col(order).alias("_order"))
    read = read.where("dt IS NOT NULL AND value IS NOT NULL AND value <> 0 AND NOT isnan(value)")
    return read.groupBy("dt").agg(F.max_by("value", "_order").alias("value"))


def listed_symbols(pages: DataFrame, key: str, least: int = 10) -> DataFrame:
    """(key, place, symbol): the cells of the symbol column of each page's first table that has one and `least` rows.

    pages is (key, html). A symbol column's head holds "symbol" or "ticker". Places count the rows of the table from 1.
    """
    plain = lambda x: F.trim(F.regexp_replace(x, "<[^>]*>", " "))
    cells = lambda row, tag: F.transform(F.regexp_extract_all(row, F.lit(f"(?is)<{tag}\\b[^>]*>(.*?)</{tag}>"), F.lit(1)), plain)
    tables = F.regexp_extract_all("html", F.lit("(?is)<table\\b.*?</table>"), F.lit(0))
    rows = lambda t: F.regexp_extract_all(t, F.lit("(?is)<tr\\b.*?</tr>"), F.lit(0))
    heads = F.transform(tables, lambda t: F.transform(cells(t, "th"), lambda h: F.coalesce(F.lower(h).rlike("symbol|ticker"), F.lit(False))))
    read = F.transform(F.arrays_zip(tables.alias("t"), heads.alias("h")), lambda x: F.struct((F.array_position(x["h"], True) - 1).cast("int").alias("at"), F.filter(F.transform(rows(x["t"]), lambda row: cells(row, "td")), lambda c: F.size(c) > 0).alias("rows")))
    first = F.get(F.filter(read, lambda x: (x["at"] >= 0) & (F.size(x["rows"]) >= least)), F.lit(0))
    found = pages.select(key, first.alias("_t")).select(key, F.posexplode(F.transform("_t.rows", lambda c: clean_symbol(F.get(c, F.col("_t.at"))))).alias("place", "symbol"))
    return found.where("symbol IS NOT NULL").select(key, (F.col("place") + 1).cast("long").alias("place"), "symbol")


def best_source(spine: DataFrame, sources: DataFrame) -> DataFrame:
    """(series, source, coverage): for each series the source with most values on the spine; the latest source of equals.

    spine is (dt), sources (source, version, series, dt, px).
    """
    covered = sources.join(F.broadcast(spine), "dt", "left_semi").groupBy("series", "source").agg(F.count("px").alias("coverage"), F.max("version").alias("version"))
    first = Window.partitionBy("series").orderBy(F.desc("coverage"), F.desc("version"), "source")
    return covered.withColumn("place", F.row_number().over(first)).where("place = 1").select("series", "source", "coverage")


def repaired(spine: DataFrame, sources: DataFrame, present: DataFrame, most_behind: int = 10) -> DataFrame:
    """(series, dt, px, source): on the spine, the values of series that present (series) lacks, from each one's `best_source`.

    A source whose last value lies more than most_behind rows of the spine before its end is no repair, and the series is left
    out. Else values are carried forward.
    """
    best = best_source(spine, sources.join(present, "series", "left_anti"))
    rows = sources.join(spine, "dt", "left_semi").join(best.select("series", "source"), ["series", "source"]).where("px IS NOT NULL")
    rows = rows.groupBy("series", "source", "dt").agg(F.max_by("px", "version").alias("px"))
    days = spine.select("dt", F.count("*").over(Window.orderBy(F.desc("dt"))).alias("_after"))  # a row a day
    fresh = rows.groupBy("series", "source").agg(F.max("dt").alias("dt")).join(days, "dt").where(F.col("_after") - 1 <= most_behind).select("series", "source")
    whole = fresh.join(spine.select("dt")).join(rows, ["series", "source", "dt"], "left")  # a repaired series on every day
    upto = Window.partitionBy("series").orderBy("dt")
    return whole.select("series", "dt", F.last("px", ignorenulls=True).over(upto).alias("px"), "source")


def model_rows(panel: DataFrame, names: DataFrame, spine: DataFrame, extra: DataFrame, least_share: float = 0.2) -> DataFrame:
    """(series, dt, px) of a model: named series of panel with values on least_share of the spine's days, and extra series, all
    carried forward along the spine.

    panel and extra are (series, dt, px), names (series, name), spine (dt). A value between two days of the spine counts from
    the later one on; a series has no rows before its first value.
    """
    named = panel.join(names, "series").select(F.col("name").alias("series"), "dt", "px").where("px IS NOT NULL")
    n = spine.agg(F.count("*").alias("_n"))
    enough = named.join(spine, "dt", "left_semi").groupBy("series").agg(F.count("*").alias("_k")).join(n).where(F.col("_k") >= least_share * F.col("_n")).select("series")
    rows = named.join(enough, "series", "left_semi").unionByName(extra.where("px IS NOT NULL").select("series", "dt", "px"))
    grid = rows.select("series").distinct().join(spine.select("dt", F.lit(True).alias("_on")))  # a row a series and day
    filled = rows.join(grid, ["series", "dt"], "full").withColumn("px", F.last("px", ignorenulls=True).over(Window.partitionBy("series").orderBy("dt")))
    return filled.where("_on AND px IS NOT NULL").select("series", "dt", "px")


def fingerprint(series: DataFrame, digits: int = 3) -> DataFrame:
    """(series, n_rows, mark): 12 hex digits of the SHA-256 of a series' settled rows; the newest row doesn't count."""
    newest = Window.partitionBy("series")
    settled = series.withColumn("newest", F.max("dt").over(newest)).where("dt < newest")
    cell = F.concat(F.col("dt").cast("string"), F.lit("="), F.floor(F.col("px") * 10**digits + 0.501).cast("string"))
    rows = settled.groupBy("series").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.select("series", "n_rows", F.substring(F.sha2(F.array_join("cells", ","), 256), 1, 12).alias("mark"))
