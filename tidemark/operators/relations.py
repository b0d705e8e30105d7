"""Joins, set operations and small selections between series, instruments and dates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.align import forward_fill, ordered


def named(df: DataFrame, names: DataFrame) -> DataFrame:
    """df (series, ...) under the names of names (series, name); series without a name are left out."""
    return df.join(names, "series").drop("series").withColumnRenamed("name", "series")


def excluding(candidates: DataFrame, excluded: DataFrame) -> DataFrame:
    """candidates (target, series) without the pairs of excluded, and without a target's own series."""
    return candidates.where(F.col("series") != F.col("target")).join(excluded, ["target", "series"], "left_anti")


def extended(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """table with the rows of new whose key it lacks."""
    return table.unionByName(new.join(table, key, "left_anti"))


def without(df: DataFrame, names: list[str]) -> DataFrame:
    return df.where(~F.col("series").isin(names)) if names else df


def complete_dates(df: DataFrame) -> DataFrame:
    """(dt) on which every series of df has a value."""
    n = df.select("series").distinct().agg(F.count("*").alias("n"))
    return df.groupBy("dt").agg(F.count("px").alias("k")).join(n).where("k = n").select("dt")


def gates(df: DataFrame, least: int) -> DataFrame:
    """(series, n_rows, lowest, fit): whether a series has `least` rows and only values over 0."""
    out = df.groupBy("series").agg(F.count("px").alias("n_rows"), F.min("px").alias("lowest"))
    return out.withColumn("fit", F.coalesce((F.col("n_rows") >= least) & (F.col("lowest") > 0), F.lit(False)))


def valued_series(df: DataFrame, least: int = 1) -> DataFrame:
    """Rows with a value, of series that have `least` of them."""
    enough = df.groupBy("series").agg(F.count("px").alias("n")).where(F.col("n") >= least).select("series")
    return df.where("px IS NOT NULL").join(enough, "series", "left_semi")


def by_priority(sources: list[DataFrame], first: str, last: str) -> DataFrame:
    """(series, dt, px, source): at each place the value of the first source that has one, between two dates."""
    rows = reduce(DataFrame.unionByName, [s.select("series", "dt", "px", F.lit(k).alias("source")) for k, s in enumerate(sources)])
    rows = rows.where(F.col("px").isNotNull() & F.col("dt").between(F.to_date(F.lit(first)), F.to_date(F.lit(last))))
    return rows.groupBy("series", "dt").agg(F.min_by("px", "source").alias("px"), F.min("source").alias("source"))


def first_usable(names: DataFrame, suffixes: list[str], usable: DataFrame) -> DataFrame:
    """(name, symbol): of name with each suffix, the first that usable (symbol) has."""
    tried = names.select("name", F.posexplode(F.array(*[F.concat("name", F.lit(s)) for s in suffixes])).alias("place", "symbol"))
    return tried.join(usable, "symbol", "left_semi").groupBy("name").agg(F.min_by("symbol", "place").alias("symbol"))


def in_first_order(df: DataFrame, value: Column, order: str, suffix: str = "") -> DataFrame:
    """(place, symbol): the distinct cleaned values, in the order of their first rows."""
    rows = df.select(F.concat(value, F.lit(suffix)).alias("symbol"), order).where("symbol IS NOT NULL")
    return rows.groupBy("symbol").agg(F.min(order).alias("place")).select("place", "symbol")


def tape(df: DataFrame, order: DataFrame) -> DataFrame:
    """(place, series, dt, px, change): the newest row of each series of order (series, place), with its percent change."""
    back = Window.partitionBy("series").orderBy(F.desc("dt"))
    two = df.where("px IS NOT NULL").withColumn("_k", F.row_number().over(back)).where("_k <= 2").groupBy("series")
    two = two.agg(F.max("dt").alias("dt"), F.max_by("px", "dt").alias("px"), F.max(F.when(F.col("_k") == 2, F.col("px"))).alias("_before"))
    return order.join(two, "series").select("place", "series", "dt", "px", (F.try_divide("px", F.col("_before")) * 100 - 100).alias("change"))


def carried(left: DataFrame, right: DataFrame, columns: list[str], *by: str) -> DataFrame:
    """left joined with right by dt, right's columns filled forward along left's own rows."""
    rows = left.join(right.select("dt", *columns), "dt", "left")
    return reduce(lambda df, c: forward_fill(df, c, *by), columns, rows)


def joined_days(a: DataFrame, b: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Dates in both a and b (dt, ...), the last row of a repeated date; only those of days, if given."""
    out = a.join(b, "dt")
    return out if days is None else out.join(days.select("dt"), "dt", "left_semi")


def with_defaults(a: DataFrame, b: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """All rows of a with b's columns of the date, or neutral values."""
    return a.join(b.select("dt", *defaults), "dt", "left").na.fill(defaults)


def all_dates(views: DataFrame) -> DataFrame:
    return views.select("dt").distinct()


def common_rows(views: DataFrame, value: str) -> DataFrame:
    """(dt, values): dates on which every view (series) has a value; values are in the order of the views."""
    n = views.select("series").distinct().agg(F.count("*").alias("n"))
    rows = views.where(F.col(value).isNotNull()).groupBy("dt").agg(F.array_sort(F.collect_list(F.struct("series", value))).alias("_all"))
    return rows.join(n).where(F.size("_all") == F.col("n")).select("dt", F.transform("_all", lambda x: x[value]).alias("values"))


def calibration(scores: DataFrame, prices: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """scores (dt, ...) with the target's price carried to their dates, whether it is native, and returns over horizons.

    Rows without all returns are left out: the returns are labels.
    """
    rows = scores.join(prices.select("dt", F.col("px").alias("_px")), "dt", "left").withColumn("series", F.lit(0))
    rows = forward_fill(rows.withColumns({"native": F.col("_px").isNotNull(), "px": F.col("_px")}).drop("_px"), "px")
    rows = rows.withColumns({f"ahead_{h}": F.lead("px", h).over(ordered()) / F.col("px") - 1 for h in horizons})
    return rows.where(" AND ".join(f"ahead_{h} IS NOT NULL" for h in horizons)).drop("series")


def with_tiers(rows: DataFrame, tiers: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """rows (dt, ...) with the tiers of the date, or the defaults."""
    return with_defaults(rows, tiers, defaults)


def merged(*maps: Column) -> Column:
    """Maps in one; of equal keys the last map's value holds."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b), maps)


def newest(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n newest rows: a report, so the limit is the feature."""
    return df.orderBy(F.desc("dt"), *order).limit(n)


def best_horizon(skill: DataFrame) -> DataFrame:
    """(series, horizon, edge, ic): of each series the horizon of the greatest edge, then of the greatest ic."""
    return skill.groupBy("series").agg(F.max(F.struct("edge", "ic", "horizon")).alias("_b")).select("series", "_b.horizon", "_b.edge", "_b.ic")


def last_drivers(ranked: DataFrame) -> DataFrame:
    """Rows of ranked (dt, series, r2, r, place) on its last date, best first by place."""
    last = ranked.agg(F.max("dt").alias("dt"))
    return ranked.join(last, "dt").select("place", "series", "r", "r2")


def importance(rows: DataFrame) -> DataFrame:
    """(dt, series, share, place) of rows (dt, series, x): each |x| as a percentage of its date's, the greatest first."""
    day = Window.partitionBy("dt")
    share = F.coalesce(F.try_divide(F.abs("x"), F.sum(F.abs("x")).over(day)) * 100, F.lit(0.0))
    return rows.withColumn("share", share).withColumn("place", F.row_number().over(day.orderBy(F.desc("share"), "series"))).select("dt", "series", "share", "place")


def persistence_of_latest(events: DataFrame, kind: str, days: int) -> DataFrame:
    """(kind, n, recent): events of each kind, and those of the days up to the newest event of all."""
    newest_ = events.agg(F.max("dt").alias("_newest"))
    rows = events.join(newest_)
    return rows.groupBy(kind).agg(F.count("*").alias("n"), F.count_if(F.col("dt") >= F.date_sub("_newest", days)).alias("recent"))

