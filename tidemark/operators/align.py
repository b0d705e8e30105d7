"""Alignment and cleaning of long series (series, dt, px). Nothing looks ahead: a value depends on earlier rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def past(*by: str) -> Window:
    """All rows of a series up to this one."""
    return Window.partitionBy(*(by or ("series",))).orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)


def ordered(*by: str) -> Window:
    return Window.partitionBy(*(by or ("series",))).orderBy("dt")


def forward_fill(df: DataFrame, column: str, *by: str) -> DataFrame:
    return df.withColumn(column, F.last(column, ignorenulls=True).over(past(*by)))


def spine_of(df: DataFrame, spine: DataFrame) -> DataFrame:
    """Every series of df at every date of spine (dt, ...): the output's own size, series by dates."""
    dates = spine.agg(F.collect_list(F.struct(*spine.columns)).alias("_dates"))  # one row, the days or hours of a spine
    return df.select("series").distinct().join(dates).select("series", F.inline("_dates"))


def reindex_ffill(df: DataFrame, spine: DataFrame) -> DataFrame:
    """df on the dates of spine, then filled forward; observations off the spine are lost."""
    return forward_fill(spine_of(df, spine).join(df, ["series", "dt"], "left"), "px")


def asof_backward(df: DataFrame, spine: DataFrame) -> DataFrame:
    """(series, dt, px, native): on the dates of spine, the latest value on or before each; native where it is that day's.

    One shuffle by series: the rows of both sides in one ordered window, no join on ranges.
    """
    both = df.select("series", "dt", "px", F.lit(False).alias("_spine")).unionByName(spine_of(df, spine).select("series", "dt", F.lit(None).cast("double").alias("px"), F.lit(True).alias("_spine")))
    at = Window.partitionBy("series").orderBy("dt", "_spine").rowsBetween(Window.unboundedPreceding, 0)
    day = F.last(F.when(F.col("px").isNotNull(), F.col("dt")), ignorenulls=True).over(at)
    both = both.withColumn("native", F.coalesce(day == F.col("dt"), F.lit(False))).withColumn("px", F.last("px", ignorenulls=True).over(at))
    return both.where("_spine").select("series", "dt", "px", "native")


def coverage(df: DataFrame, n_dates: int, at_least: float = 0.2, always: tuple[str, ...] = ()) -> DataFrame:
    """(series, coverage) of the series with values on a share at_least of n_dates, or named in always."""
    out = df.groupBy("series").agg((F.count("px") / F.lit(n_dates)).alias("coverage"))
    return out.where((F.col("coverage") >= at_least) | F.col("series").isin(list(always)))


def history_guard(df: DataFrame, n: int = 1500) -> DataFrame:
    """(series, n_rows) of the series with a value in all of their last min(n, rows) rows."""
    recent = Window.partitionBy("series").orderBy(F.desc("dt"))
    tail = df.withColumn("place", F.row_number().over(recent)).where(F.col("place") <= n)
    return tail.groupBy("series").agg(F.count("*").alias("n_rows"), F.count("px").alias("n")).where("n = n_rows").drop("n")


def latest(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key by order."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), order).alias("_row")).select(*keys, "_row.*")


def printed(df: DataFrame) -> DataFrame:
    """df with `printed` (a value over 0 that differs from the one before, or is the first) and `n_prints` so far."""
    real = F.when((F.col("px") > 0) & ~F.isnan("px"), F.col("px"))
    before = Window.partitionBy("series").orderBy("dt").rowsBetween(Window.unboundedPreceding, -1)
    previous = F.last(real, ignorenulls=True).over(before)
    out = df.withColumn("printed", real.isNotNull() & (previous.isNull() | (previous != real)))
    return out.withColumn("n_prints", F.sum(F.col("printed").cast("long")).over(past()))


def admitted(df: DataFrame, floor: int = 250) -> DataFrame:
    return printed(df).withColumn("admitted", F.col("n_prints") >= floor)


def complete_days(df: DataFrame, share: float = 0.6, least: int = 30, burn_in: int = 0) -> DataFrame:
    """(dt, n_admitted, n_open, n_printed, coverage, complete, reason) of rows with `admitted`, `open` and `printed`.

    coverage is what printed of the admitted series whose market was open. Of the reasons the first that holds is given: the
    first burn_in dates, fewer than least admitted, markets open for under share of them, too few prints.
    """
    own = F.col("admitted")
    n = df.groupBy("dt").agg(F.count_if(own).alias("n_admitted"), F.count_if(own & F.col("open")).alias("n_open"), F.count_if(own & F.col("open") & F.col("printed")).alias("n_printed"))
    n = n.withColumn("coverage", F.coalesce(F.try_divide("n_printed", "n_open"), F.lit(0.0)))
    n = n.withColumn("complete", (F.col("coverage") >= share) & (F.col("n_printed") >= least))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("dt"))  # a row a date
    reason = F.when(place <= burn_in, "burn-in").when(F.col("n_admitted") < least, "warming up").when(F.col("n_open") < share * F.col("n_admitted"), "market closed").when(~F.col("complete"), "incomplete fetch")
    return n.withColumn("reason", F.coalesce(reason, F.lit("published")))


def replicas(df: DataFrame, target: DataFrame, most: float = 0.98, least: int = 100) -> DataFrame:
    """(series, r, n, kept): correlation of log prices with the target's; series too like it aren't kept."""
    joined = df.join(F.broadcast(target.select("dt", F.col("px").alias("target_px"))), "dt").where("px > 0 AND target_px > 0")
    out = joined.groupBy("series").agg(F.corr(F.log("px"), F.log("target_px")).alias("r"), F.count("*").alias("n"))
    return out.withColumn("kept", ~((F.abs("r") > most) & (F.col("n") >= least)))


def available(df: DataFrame, least_sd: float = 1e-7) -> DataFrame:
    """df (ret, sd, printed, admitted, ...) with `available`: a return of a day that printed, of an admitted series that varies."""
    return df.withColumn("available", F.coalesce(F.col("ret").isNotNull() & F.col("printed") & F.col("admitted") & (F.col("sd") > least_sd), F.lit(False)))


def published(df: DataFrame, publish: str, columns: list[str]) -> DataFrame:
    """df with columns null where publish isn't true."""
    return df.withColumns({c: F.when(F.col(publish), F.col(c)) for c in columns})


def sessions(exchanges: DataFrame, first: str, last: str, holidays: DataFrame) -> DataFrame:
    """(exchange, dt): weekdays between two dates that are not holidays (exchange, dt) of the exchange."""
    days = exchanges.select("exchange", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("dt")).where(F.weekday("dt") < 5)
    return days.join(holidays, ["exchange", "dt"], "left_anti")
