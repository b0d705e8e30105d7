"""Windowed columns of long series (series, dt, ...), partitioned by series and ordered by dt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import clip
from tidemark.operators.align import ordered, past



def prior(n: int | None = None) -> Window:
    """The n rows before this one (all, if None)."""
    return ordered().rowsBetween(Window.unboundedPreceding if n is None else -n, -1)


def trailing(n: int) -> Window:
    """The n rows that end with this one."""
    return ordered().rowsBetween(-(n - 1), 0)


def full(value: Column, x: Column, over: Window, n: int) -> Column:
    """value, where all n rows of the window have an x."""
    return F.when(F.count(x).over(over) >= n, value)


def causal_z(x: Column, n: int, bound: float = 3.0) -> Column:
    """z of x against the n rows before, clipped; 0 where they don't vary. x is filled forward before (`align.forward_fill`); a null, before the first value, counts as 0."""
    own = F.coalesce(x, F.lit(0.0))
    mean, sd = F.avg(own).over(prior(n)), F.stddev_samp(own).over(prior(n))
    return F.when(F.coalesce(sd, F.lit(0.0)) > 1e-12, clip((own - mean) / sd, -bound, bound)).otherwise(0.0)


def sma(x: Column, n: int) -> Column:
    return full(F.avg(x).over(trailing(n)), x, trailing(n), n)


def anchor_mean(x: Column, n: int = 252, least: int = 60) -> Column:
    return full(F.avg(x).over(prior(n)), x, prior(n), least)


def change(x: Column, k: int) -> Column:
    return x - F.lag(x, k).over(ordered())


def percent_change(x: Column, k: int) -> Column:
    return x / F.lag(x, k).over(ordered()) - 1


def forward_change(x: Column, k: int, bound: float = 100.0) -> Column:
    """Percent change over the next k rows: a label, never a feature."""
    return clip((F.lead(x, k).over(ordered()) / x - 1) * 100, -bound, bound)


def rolling_corr(x: Column, y: Column, n: int) -> Column:
    """Correlation over the n rows before this one; 0 without n of them."""
    both = x + y
    return F.coalesce(clip(F.when(F.count(both).over(prior(n)) >= n, F.corr(x, y).over(prior(n))), -1, 1), F.lit(0.0))


def quantile_z(x: Column, n: int, least: int) -> Column:
    """x against the median and the 2.5 to 97.5 % range (over 1.35) of the n rows before."""
    q = F.percentile(x, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).over(prior(n))
    width = (F.get(q, F.lit(2)) - F.get(q, F.lit(0))) / 1.35
    return F.when((F.count(x).over(prior(n)) >= least) & (width > 1e-12), (x - F.get(q, F.lit(1))) / width)


def crossings(z: Column, at: float = 1.0) -> tuple[Column, Column]:
    """(buy, sell): z falls through -at; z rises through at."""
    before = F.lag(z).over(ordered())
    no = F.lit(False)
    return F.coalesce((z < -at) & (before >= -at), no), F.coalesce((z > at) & (before <= at), no)


def expanding_norm(x: Column) -> Column:
    """z against all rows so far, over 3, from -1 to 1."""
    sd = F.coalesce(F.stddev_samp(x).over(past()), F.lit(1.0))
    return clip((x - F.avg(x).over(past())) / F.greatest(sd, F.lit(1e-10)) / 3, -1, 1)


def true_range() -> Column:
    before = F.lag("close").over(ordered())
    return F.greatest(F.col("high") - F.col("low"), F.coalesce(F.abs(F.col("high") - before), F.lit(0.0)), F.coalesce(F.abs(F.col("low") - before), F.lit(0.0)))


def accumulation(n: int) -> Column:
    """From -1 to 1: money flow on rising closes against falling ones over n rows; 0 without any."""
    flow = (F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume")
    moved = change(F.col("close"), 1)
    up = F.avg(F.when(moved > 0, flow).otherwise(0.0)).over(trailing(n))
    down = F.avg(F.when(moved < 0, flow).otherwise(0.0)).over(trailing(n))
    return F.coalesce(2 * (F.try_divide(up, up + down) - 0.5), F.lit(0.0))


def pivots(df: DataFrame, column: str, order: int = 5) -> DataFrame:
    """df with `top` and `bottom`: whether the row `order` back is the first extreme of the 2 * order + 1 rows to here."""
    x, here = F.col(column), ordered().rowsBetween(-2 * order, 0)
    centre = F.lag(x, order).over(ordered())
    earlier, later = ordered().rowsBetween(-2 * order, -order - 1), ordered().rowsBetween(-order + 1, 0)
    df = df.withColumns({"_c": centre, "_n": F.count(x).over(here), "_eh": F.max(x).over(earlier), "_lh": F.max(x).over(later), "_el": F.min(x).over(earlier), "_ll": F.min(x).over(later)})
    whole = F.col("_n") == 2 * order + 1
    df = df.withColumn("top", F.coalesce(whole & (F.col("_c") > F.col("_eh")) & (F.col("_c") >= F.col("_lh")), F.lit(False)))
    df = df.withColumn("bottom", F.coalesce(whole & (F.col("_c") < F.col("_el")) & (F.col("_c") <= F.col("_ll")), F.lit(False)))
    return df.drop("_c", "_n", "_eh", "_lh", "_el", "_ll")


def persistence(df: DataFrame, kind: str, days: int = 30, least: int = 5) -> DataFrame:
    """df (kind, dt) with `recent`, the rows of the kind in the calendar days up to dt, and whether they are `least` or more."""
    frame = Window.partitionBy(kind).orderBy(F.unix_date("dt")).rangeBetween(-days, 0)
    return df.withColumn("recent", F.count("*").over(frame)).withColumn("persistent", F.col("recent") >= least)


def rolling_theta(x: Column, n: int = 60) -> tuple[Column, Column]:
    """(phi, theta) of an AR(1) over the last n rows, the slope corrected for its small-sample bias."""
    before = F.col("_lag")
    phi = F.regr_slope(x, before).over(trailing(n))
    phi = phi + (1 + 3 * phi) / n
    phi = F.when(F.count(before).over(trailing(n)) >= n, clip(phi, 1e-6, 0.9999))
    return phi, -F.log(phi)


def expanding_moments(x: Column) -> tuple[Column, Column]:
    """Mean and variance of all rows so far; a single row varies by 0."""
    return F.avg(x).over(past()), F.coalesce(F.var_samp(x).over(past()), F.lit(0.0))
