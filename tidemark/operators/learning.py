"""Weights of the four dimensions of agreement, learned from resolved outcomes only, and their skill out of sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import soft_bound
from tidemark.operators import folds
from tidemark.operators import windows as w
from tidemark.operators.align import forward_fill, ordered
from tidemark.operators.scores import DIMENSIONS
from tidemark.operators.stats import spearman


def dimension_weights(df: DataFrame, horizon: int, half_life: float = 252.0, floor: float = 0.05, warm_up: int = 126, prior: dict[str, float] | None = None) -> DataFrame:
    """(dt, series, weight): of each dimension (series) on the dates of df (dt, px, dim_*); the prior until warm_up outcomes are in.

    A dimension's call is 2 dim - 1; it is scored horizon rows later against the change of px since.
    """
    prior = prior or DIMENSIONS
    every = Window.partitionBy(F.lit(0)).orderBy("dt")  # the dates of one target
    rows = df.withColumn("outcome", F.col("px") / F.lag("px", horizon).over(every) - 1)
    rows = rows.withColumn("_n", F.count_if(F.col("outcome") != 0).over(every))
    calls = rows.select("dt", "outcome", "_n", F.inline(F.array(*[F.struct(F.lit(k).alias("series"), (2 * F.col(f"dim_{k}") - 1).alias("lean")) for k in prior])))
    calls = calls.withColumn("call", F.lag("lean", horizon).over(ordered()))
    learned = folds.skill_weights(folds.discounted_skill(calls, "call", "outcome", half_life), floor=floor)
    share = F.element_at(F.create_map(*[F.lit(v) for k, x in prior.items() for v in (k, x / sum(prior.values()))]), F.col("series"))
    return learned.join(rows.select("dt", "_n"), "dt").select("dt", "series", F.when(F.col("_n") < warm_up, share).otherwise(F.col("weight")).alias("weight"))


def wide(weights: DataFrame) -> DataFrame:
    """(dt, w_*): one column a dimension."""
    return weights.groupBy("dt").agg(*[F.max(F.when(F.col("series") == k, F.col("weight"))).alias(f"w_{k}") for k in DIMENSIONS])


def leaning() -> Column:
    """The weighted sum of 2 dim - 1 over columns w_* and dim_*."""
    return reduce(lambda a, b: a + b, [F.col(f"w_{k}") * (2 * F.col(f"dim_{k}") - 1) for k in DIMENSIONS])


def reweighted(df: DataFrame, weights: DataFrame) -> DataFrame:
    """df (dt, lean, score, dim_*) with score by the weights of the date, or the last before it; earlier dates keep theirs."""
    rows = df.join(wide(weights), "dt", "left").withColumn("_one", F.lit(0))
    for k in DIMENSIONS:
        rows = forward_fill(rows, f"w_{k}", "_one")
    learned = -F.col("lean") * (leaning() + 1) / 2 * 100
    return rows.withColumn("score", F.coalesce(learned, F.col("score"))).drop("_one")


def out_of_sample(df: DataFrame, horizons: tuple[int, ...], splits: int = 6, first: float = 0.45) -> DataFrame:
    """(fold, test_start, n, ic) of df (dt, px, dim_*): the weights known before each test block, gap apart, against what followed in it.

    Blocks under 30 rows, training under 200 or under 250 rows in all give none.
    """
    short, purge = min(horizons), max(horizons)
    every = Window.partitionBy(F.lit(0)).orderBy("dt")
    rows = df.withColumns({f"_{h}": F.lead("px", h).over(every) for h in horizons}).where(" AND ".join(f"_{h} IS NOT NULL" for h in horizons))
    rows = rows.withColumns({"ahead": F.col(f"_{short}") / F.col("px") - 1, "k": F.row_number().over(every) - 1}).withColumn("n", F.count("*").over(Window.partitionBy(F.lit(0))))
    fold = F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("fold")
    size = rows.agg(F.max("n").alias("n")).where("n >= 250").select("n", fold).withColumn("start", F.floor(F.col("n") * F.lit(first)).cast("int"))
    size = size.withColumn("step", F.greatest(F.floor((F.col("n") - F.col("start")) / splits), F.lit(1)).cast("int")).withColumn("end", F.col("start") + F.col("fold") * F.col("step"))
    size = size.select("fold", "end", (F.col("end") + purge).alias("a"), F.least(F.col("end") + purge + F.col("step"), "n").alias("b")).where("b - a >= 30 AND end >= 200")
    learned = wide(dimension_weights(rows, short)).join(rows.select("dt", "k"), "dt").drop("dt")
    known = size.join(learned, F.col("k") == F.col("end") - 1).drop("k")
    test = rows.select("dt", "k", "ahead", *[f"dim_{k}" for k in DIMENSIONS]).join(known, (F.col("k") >= F.col("a")) & (F.col("k") < F.col("b")))
    test = test.select(F.col("fold").alias("series"), "dt", "ahead", leaning().alias("signal"))
    start = test.groupBy("series").agg(F.min("dt").alias("test_start"))
    return spearman(test, "signal", "ahead").join(start, "series").where("ic IS NOT NULL AND NOT isnan(ic)").select(F.col("series").alias("fold"), "test_start", "n", "ic")


def ic_summary(ics: DataFrame) -> DataFrame:
    """(n, mean, positive_share, sd) of rows with an ic."""
    return ics.agg(F.count("ic").alias("n"), F.avg("ic").alias("mean"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"), F.stddev_samp("ic").alias("sd"))


def bounded_conviction(df: DataFrame, column: str, leak: float, gain: float, long_run: float) -> DataFrame:
    """(series, dt, level, low, high): the drift filter of column, softly bounded, with 1.96 deviations on either side."""
    out = folds.drift_filter(df, column, leak, gain, long_run).withColumn("_b", 1.96 * F.sqrt("variance"))
    return out.select("series", "dt", soft_bound(F.col("level")).alias("level"), (F.col("level") - F.col("_b")).alias("low"), (F.col("level") + F.col("_b")).alias("high"))


def adaptive_labels(df: DataFrame, column: str, strong: float = 15.13, weak: float = 6.56, least: int = 252) -> DataFrame:
    """(series, dt, label) by the 90 and 50 % tiers of |column| over the rows before; the given tiers until there are `least`."""
    tiers = folds.expanding_quantiles(df.withColumn("_x", F.abs(column)), "_x", {"hi": (0.9, strong), "lo": (0.5, weak)}, least)
    x, lo = F.col(column), F.least("lo", "hi")
    rows = df.select("series", "dt", column).join(tiers, ["series", "dt"])
    label = F.when(x < -F.col("hi"), "STRONGLY OVERSOLD").when(x < -lo, "OVERSOLD").when(x > F.col("hi"), "STRONGLY OVERBOUGHT").when(x > lo, "OVERBOUGHT").otherwise("NEUTRAL")
    return rows.select("series", "dt", label.alias("label"))


def consensus(df: DataFrame, a: str, b: str) -> DataFrame:
    """df (series, dt, a, b) with consensus: the mean of both columns' expanding norms."""
    return df.withColumn("consensus", (w.expanding_norm(F.col(a)) + w.expanding_norm(F.col(b))) / 2)


def native_enough(df: DataFrame, skip: int, least: int = 60) -> DataFrame:
    """df (dt, native, ...) without its first `skip` rows; no rows at all where fewer than `least` of the others are native."""
    every = Window.partitionBy(F.lit(0))
    rows = df.withColumn("_k", F.row_number().over(every.orderBy("dt"))).where(F.col("_k") > skip)
    return rows.withColumn("_n", F.count_if("native").over(every)).where(F.col("_n") >= least).drop("_k", "_n")
