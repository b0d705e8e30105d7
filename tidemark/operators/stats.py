"""Aggregate statistics of long series: fits, ranks, shrinkage, quantiles and scaling exponents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.align import ordered


def block_means(df: DataFrame) -> DataFrame:
    """(dt, block, mean_z, members) of rows (dt, block, z)."""
    return df.groupBy("dt", "block").agg(F.avg("z").alias("mean_z"), F.count("z").alias("members"))


def dispersion(df: DataFrame, least: int = 5) -> DataFrame:
    """(dt, n, dispersion): population deviation of z across series, where there are `least` of them."""
    return df.groupBy("dt").agg(F.count("z").alias("n"), F.stddev_pop("z").alias("dispersion")).where(F.col("n") >= least)


def fit_quality(df: DataFrame, actual: str, fitted: str, anchor: str) -> DataFrame:
    """One row a series: r2, rmse, mae, and r2 against an anchor in place of the mean."""
    error, apart = F.col(actual) - F.col(fitted), F.col(actual) - F.col(anchor)
    both = F.when(F.col(anchor).isNotNull(), error * error)
    return df.where(F.col(fitted).isNotNull()).groupBy("series").agg(
        (1 - F.sum(error * error) / (F.var_pop(actual) * F.count(actual))).alias("r2"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"), (1 - F.sum(both) / F.sum(apart * apart)).alias("r2_anchor"),
    )


def signal_performance(df: DataFrame, score: str, forward: str, step: int, cut: float) -> DataFrame:
    """(series, side, n, hit_rate, mean_forward, t): forward changes after scores past -cut (buy) and cut (sell), every step-th row.

    Of equal changes other than 0, t is infinite.
    """
    place = F.row_number().over(ordered()) - 1
    rows = df.withColumn("_place", place).where((F.col("_place") % step == 0) & F.col(forward).isNotNull())
    side = F.when(F.col(score) < -cut, "buy").when(F.col(score) > cut, "sell")
    rows = rows.withColumn("side", side).where("side IS NOT NULL")
    hit = F.when(F.col("side") == "buy", F.col(forward) > 0).otherwise(F.col(forward) < 0)
    out = rows.groupBy("series", "side").agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("hit_rate"), F.avg(forward).alias("mean_forward"), F.stddev_samp(forward).alias("_sd"))
    size = F.when(F.col("mean_forward") > 0, float("inf")).when(F.col("mean_forward") < 0, float("-inf"))
    t = F.when(F.col("_sd") > 0, F.try_divide(F.col("mean_forward"), F.col("_sd") / F.sqrt("n"))).otherwise(size)
    return out.withColumn("t", F.when(F.col("n") >= 3, t)).drop("_sd")


def average_rank(x: Column, *by: str) -> Column:
    return F.rank().over(Window.partitionBy(*by).orderBy(x)) + (F.count("*").over(Window.partitionBy(*by, x)) - 1) / 2


def spearman(df: DataFrame, x: str, y: str, least: int = 5) -> DataFrame:
    """(series, ic, n): correlation of average ranks."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    rows = rows.select("series", average_rank(F.col(x), "series").alias("_x"), average_rank(F.col(y), "series").alias("_y"))
    return rows.groupBy("series").agg(F.corr("_x", "_y").alias("ic"), F.count("*").alias("n")).where(F.col("n") >= least)


def cross_moments(df: DataFrame, column: str) -> DataFrame:
    """(a, b, n, covariance, correlation) of the components a and b of an array column; rows with a null or NaN don't count.

    Every task sums outer products, so only p x p sums a task are shuffled, whatever the number of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, outer = 0, None, None
        for batch in batches:
            rows = [v for v in batch.column(0).to_pylist() if v is not None and all(x is not None and math.isfinite(x) for x in v)]
            if rows:
                x = np.array(rows)
                total, outer, n = (x.sum(0), x.T @ x, len(x)) if n == 0 else (total + x.sum(0), outer + x.T @ x, n + len(x))
        if n:
            p = len(total)
            a, b = np.repeat(np.arange(p), p), np.tile(np.arange(p), p)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (a, b, np.full(p * p, n), total[a], total[b], outer.ravel())], ["a", "b", "n", "sa", "sb", "sab"])

    rows = df.select(F.col(column).cast("array<double>")).mapInArrow(run, "a long, b long, n long, sa double, sb double, sab double")
    sums = rows.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in ("n", "sa", "sb", "sab")])
    sums = sums.select("a", "b", "n", ((F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")) / (F.col("n") - 1)).alias("covariance"))
    own = sums.where("a = b").select("a", F.sqrt("covariance").alias("sd"))
    sums = sums.join(own.withColumnRenamed("sd", "_x"), "a").join(own.select(F.col("a").alias("b"), F.col("sd").alias("_y")), "b")
    return sums.select("a", "b", "n", "covariance", F.coalesce(F.try_divide("covariance", F.col("_x") * F.col("_y")), F.lit(0.0)).alias("correlation"))


def effective_count(df: DataFrame, column: str) -> DataFrame:
    """(n_members, n_effective): the participation ratio of the correlation matrix, p² over the sum of its squares."""
    return cross_moments(df, column).agg(F.countDistinct("a").alias("n_members"), (F.pow(F.countDistinct("a"), 2) / F.sum(F.pow("correlation", 2))).alias("n_effective"))


def shrinkage(df: DataFrame, column: str) -> DataFrame:
    """(n, mu, alpha, rho): the weight that oracle-approximating shrinkage gives to mu times the identity."""
    p = F.countDistinct("a")
    s = cross_moments(df, column).agg(F.max("n").alias("n"), p.alias("p"), (F.sum(F.when(F.col("a") == F.col("b"), F.col("covariance"))) / p).alias("mu"), F.avg(F.pow("covariance", 2)).alias("alpha"))
    top, low = F.col("alpha") + F.col("mu") ** 2, (F.col("n") + 1) * (F.col("alpha") - F.col("mu") ** 2 / F.col("p"))
    return s.select("n", "mu", "alpha", F.when(low <= 0, 1.0).otherwise(F.greatest(F.least(top / low, F.lit(1.0)), F.lit(0.0))).alias("rho"))


def weighted_quantiles(df: DataFrame, key: str, value: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """(key, one column a quantile, n_effective): the first value at which the running weight reaches q of all."""
    by_value = Window.partitionBy(key).orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).withColumn("_upto", F.sum(weight).over(by_value)).withColumn("_all", F.sum(weight).over(Window.partitionBy(key)))
    cut = [F.min(F.when(F.col("_upto") >= q * F.col("_all") - 1e-12, F.col(value))).alias(name) for name, q in quantiles.items()]
    return rows.groupBy(key).agg(*cut, (F.pow(F.sum(weight), 2) / F.sum(F.pow(weight, 2))).alias("n_effective"))


def ou_parameters(df: DataFrame, column: str) -> DataFrame:
    """(series, n, phi, theta, mu, half_life) of an AR(1), with the slope corrected for its small-sample bias."""
    rows = df.withColumn("_lag", F.lag(column).over(ordered())).where("_lag IS NOT NULL")
    fit = rows.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope(column, "_lag").alias("slope"), F.regr_intercept(column, "_lag").alias("start"))
    fit = fit.withColumn("phi", F.greatest(F.least(F.col("slope") + (1 + 3 * F.col("slope")) / F.col("n"), F.lit(0.9999)), F.lit(1e-6)))
    fit = fit.withColumn("theta", -F.log("phi"))
    return fit.select("series", "n", "phi", "theta", (F.col("start") / (1 - F.col("phi"))).alias("mu"), (F.log(F.lit(2.0)) / F.col("theta")).alias("half_life"))


def dfa(df: DataFrame, column: str, first: int = 8, most: int = 20) -> DataFrame:
    """(series, n_scales, hurst): detrended fluctuation analysis at up to `most` log-spaced scales from first to a quarter of the rows.

    Each scale's boxes are fitted by grouped regressions. Series under 4 * first rows have none.
    """
    rows = df.where(F.col(column).isNotNull()).withColumn("_i", F.row_number().over(ordered()) - 1)
    one = Window.partitionBy("series")
    rows = rows.withColumn("_d", F.col(column) - F.avg(column).over(one)).withColumn("_n", F.count("*").over(one)).where(F.col("_n") >= 4 * first)
    rows = rows.withColumn("_y", F.sum("_d").over(ordered().rowsBetween(Window.unboundedPreceding, 0)))
    ratio = F.col("_n") / F.lit(4.0 * first)
    scales = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.floor(first * F.pow(ratio, k / F.lit(float(most - 1))) + 1e-9)))
    boxes = rows.withColumn("scale", F.explode(scales)).withColumn("box", F.floor(F.col("_i") / F.col("scale")))
    boxes = boxes.where("box < floor(_n / scale)").groupBy("series", "scale", "box").agg((F.regr_syy("_y", "_i") - F.pow(F.regr_sxy("_y", "_i"), 2) / F.regr_sxx("_y", "_i")).alias("_e"))
    f = boxes.groupBy("series", "scale").agg((F.log(F.sum(F.greatest("_e", F.lit(0.0))) / (F.count("*") * F.col("scale"))) / 2).alias("_f"))
    slope = F.regr_slope("_f", F.log("scale"))
    return f.groupBy("series").agg(F.count("*").alias("n_scales"), F.greatest(F.least(slope, F.lit(0.99)), F.lit(0.01)).alias("hurst"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, now): rows of each label of df (dt, label), and whether the newest row has it."""
    newest = df.agg(F.max_by(label, "dt").alias("_now"))
    return df.groupBy(label).agg(F.count("*").alias("n")).join(newest).select(label, "n", (F.col(label) == F.col("_now")).alias("now"))


def median_imputed(df: DataFrame, columns: list[str]) -> DataFrame:
    """df (series, ...) with nulls of columns set to their series' median."""
    medians = df.groupBy("series").agg(*[F.percentile(c, F.lit(0.5)).alias(f"_{c}") for c in columns])
    out = df.join(medians, "series").withColumns({c: F.coalesce(c, f"_{c}") for c in columns})
    return out.drop(*[f"_{c}" for c in columns])


def half_life(df: DataFrame, column: str) -> DataFrame:
    """(series, phi, half_life) from the correlation with the value before, corrected for its small-sample bias."""
    rows = df.withColumn("_lag", F.lag(column).over(ordered())).where("_lag IS NOT NULL")
    fit = rows.groupBy("series").agg(F.count("*").alias("n"), F.corr(column, "_lag").alias("c"))
    fit = fit.withColumn("phi", F.least(F.greatest(F.col("c") + (1 + 3 * F.col("c")) / F.col("n"), F.lit(1e-6)), F.lit(0.9999)))
    return fit.select("series", "phi", (F.log(F.lit(2.0)) / -F.log("phi")).alias("half_life"))


def trend_fit(df: DataFrame, column: str, share: float) -> DataFrame:
    """(series, slope, start, r_train, r_test): a line through the first share of a series' rows, and its correlation with both parts."""
    one = Window.partitionBy("series")
    rows = df.withColumn("_t", F.row_number().over(ordered())).withColumn("_train", F.col("_t") <= F.floor(share * F.count("*").over(one)))
    fit = rows.where("_train").groupBy("series").agg(F.regr_slope(column, "_t").alias("slope"), F.regr_intercept(column, "_t").alias("start"))
    rows = rows.join(fit, "series").withColumn("_fit", F.col("slope") * F.col("_t") + F.col("start"))
    parts = {"r_train": F.col("_train"), "r_test": ~F.col("_train")}
    return rows.groupBy("series").agg(F.first("slope").alias("slope"), F.first("start").alias("start"), *[F.corr(F.when(t, F.col(column)), F.when(t, F.col("_fit"))).alias(c) for c, t in parts.items()])


def curve_fit(df: DataFrame, column: str, share: float) -> DataFrame:
    """(series, slope, bend, start, r_train, r_test): a parabola in place of `trend_fit`'s line.

    The squared place is freed of its own line first, so that line and bend are fitted each by itself.
    """
    one = Window.partitionBy("series")
    rows = df.withColumn("_t", F.row_number().over(ordered()).cast("double")).withColumn("_train", F.col("_t") <= F.floor(share * F.count("*").over(one)))
    train, square = rows.where("_train"), F.col("_t") * F.col("_t")
    line = train.groupBy("series").agg(F.regr_slope(column, "_t").alias("slope"), F.regr_intercept(column, "_t").alias("start"), F.regr_slope(square, F.col("_t")).alias("_s"), F.regr_intercept(square, F.col("_t")).alias("_i"))
    rows = rows.join(line, "series").withColumn("_q", square - F.col("_s") * F.col("_t") - F.col("_i"))
    bend = rows.where("_train").groupBy("series").agg(F.try_divide(F.sum(F.col(column) * F.col("_q")), F.sum(F.col("_q") * F.col("_q"))).alias("bend"))
    rows = rows.join(bend, "series").withColumn("_fit", F.col("slope") * F.col("_t") + F.col("start") + F.col("bend") * F.col("_q"))
    parts = {"r_train": F.col("_train"), "r_test": ~F.col("_train")}
    return rows.groupBy("series").agg(*[F.first(c).alias(c) for c in ("slope", "bend", "start")], *[F.corr(F.when(t, F.col(column)), F.when(t, F.col("_fit"))).alias(c) for c, t in parts.items()])


def safe_summary(df: DataFrame, column: str, fill: float = 0.0) -> DataFrame:
    """(series, n, mean, sd, low, high, total); fill where a series has too few values."""
    made = {"mean": F.avg(column), "sd": F.stddev_samp(column), "low": F.min(column), "high": F.max(column), "total": F.sum(column)}
    return df.groupBy("series").agg(F.count(column).alias("n"), *[F.coalesce(v, F.lit(fill)).alias(c) for c, v in made.items()])


def current_tiers(df: DataFrame, column: str, wanted: dict[str, tuple[float, float]], least: int) -> DataFrame:
    """(series, a column a name): nearest-rank quantiles of all rows so far; the default under `least` rows or at 0 and below.

    A rank and a count stand in for a sorted list, so that a series may be of any length.
    """
    rows = df.where(F.col(column).isNotNull()).withColumn("_k", F.row_number().over(Window.partitionBy("series").orderBy(column)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy("series")))
    found = [F.max(F.when((F.col("_k") == F.rint(F.lit(q) * (F.col("_n") - 1))) & (F.col("_n") >= least) & (F.col(column) > 0), F.col(column))) for q, _ in wanted.values()]
    return rows.groupBy("series").agg(*[F.coalesce(f, F.lit(default)).alias(name) for f, (name, (_, default)) in zip(found, wanted.items(), strict=True)])


def unit_root(df: DataFrame, column: str, critical: float = -2.86) -> DataFrame:
    """(series, n, t, reverts): the t of the slope of changes on the value before; under the 5 % point a series reverts."""
    rows = df.withColumn("_lag", F.lag(column).over(ordered())).where("_lag IS NOT NULL").withColumn("_d", F.col(column) - F.col("_lag"))
    fit = rows.groupBy("series").agg(F.count("*").alias("n"), F.regr_slope("_d", "_lag").alias("_s"), F.regr_sxx("_d", "_lag").alias("_x"), F.regr_syy("_d", "_lag").alias("_y"), F.regr_sxy("_d", "_lag").alias("_xy"))
    t = F.col("_s") / F.sqrt((F.col("_y") - F.col("_s") * F.col("_xy")) / (F.col("n") - 2) / F.col("_x"))
    return fit.select("series", "n", t.alias("t"), (t < critical).alias("reverts"))


def gated_hurst(hurst: DataFrame, roots: DataFrame, least: int = 200) -> DataFrame:
    """(series, hurst): the exponent of series that revert and have over `least` rows, else a half."""
    out = roots.join(hurst, "series", "left")
    return out.select("series", F.when((F.col("n") > least) & F.col("reverts"), F.coalesce("hurst", F.lit(0.5))).otherwise(0.5).alias("hurst"))


def incomplete_beta(a: np.ndarray, b: float, x: np.ndarray, rounds: int = 300) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    tiny = 1e-300
    flip = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1 - x, x)
    front = np.exp(np.array([math.lgamma(s + t) - math.lgamma(s) - math.lgamma(t) for s, t in zip(p, q, strict=True)]) + p * np.log(np.maximum(z, tiny)) + q * np.log(np.maximum(1 - z, tiny))) / p
    c, d = np.ones(len(z)), 1 / np.where(np.abs(1 - (p + q) * z / (p + 1)) < tiny, tiny, 1 - (p + q) * z / (p + 1))
    f = d.copy()
    for m in range(1, rounds):
        for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / np.where(np.abs(1 + step * d) < tiny, tiny, 1 + step * d)
            c = np.where(np.abs(1 + step / c) < tiny, tiny, 1 + step / c)
            f = f * d * c
    return np.where(flip, 1 - front * f, front * f)


def t_p_values(t: pd.Series, df: pd.Series) -> pd.Series:
    out = pd.Series(np.nan, index=t.index, dtype=float)
    known = (t.notna() & df.notna() & (df >= 2)).to_numpy()
    x, n = t.to_numpy(float)[known], df.to_numpy(float)[known]
    finite = np.where(np.isinf(x), 0.0, x)
    out[known] = np.where(np.isinf(x), 0.0, incomplete_beta(n / 2, 0.5, n / (n + finite**2)))
    return out


def t_p_value(t: Column, df: Column) -> Column:
    """The two-sided p of Student's t; null for a null t or under 2 degrees of freedom, 0 for an infinite t."""

    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return t_p_values(t, df)

    return p(t, df.cast("double"))
