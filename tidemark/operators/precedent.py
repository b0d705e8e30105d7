"""Nearest historical states with temporal exclusion, what followed them, and how well that would have foretold."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as w
from tidemark.operators.align import ordered
from tidemark.operators.stats import spearman, weighted_quantiles

FEATURES = ("momentum", "vol")
#: The 99.9 % points of chi-squared for 1 to 6 degrees of freedom.
CHI2 = (10.828, 13.816, 16.266, 18.467, 20.515, 22.458)


def states(df: DataFrame, n: int = 20) -> DataFrame:
    """(series, dt, place, px, momentum, vol): n-row log return and deviation of log returns."""
    df = df.where("px > 0").withColumn("ret", F.log("px") - F.lag(F.log("px")).over(ordered()))
    return df.select("series", "dt", F.row_number().over(ordered()).alias("place"), "px", w.full(F.sum("ret").over(w.trailing(n)), F.col("ret"), w.trailing(n), n).alias("momentum"), w.full(F.stddev_samp("ret").over(w.trailing(n)), F.col("ret"), w.trailing(n), n).alias("vol"))


def with_context(df: DataFrame, context: DataFrame, columns: list[str], valid: str) -> DataFrame:
    """States with more features of the date from context (dt, columns, valid); null where it isn't valid."""
    own = context.select("dt", *[F.when(F.col(valid), F.col(c)).alias(c) for c in columns])
    return df.join(own, "dt", "left")


def distances(df: DataFrame, horizon: int = 20) -> DataFrame:
    """(series, dt, place, distance) of the states of each series, but the last `horizon`, from its newest one.

    Mahalanobis distance over (momentum, vol) with the pool's covariance, shrunk to mu times the identity by the
    oracle-approximating weight. The moments are one row a series and are joined to it.
    """
    newest = df.groupBy("series").agg(F.max("place").alias("n"), F.max_by(F.struct("momentum", "vol"), "place").alias("now"))
    pool = df.where("momentum IS NOT NULL AND vol IS NOT NULL").join(newest, "series").where(F.col("place") <= F.col("n") - horizon)
    s = pool.groupBy("series").agg(F.count("*").alias("m"), F.var_samp("momentum").alias("a"), F.var_samp("vol").alias("d"), F.covar_samp("momentum", "vol").alias("b"))
    s = s.withColumn("mu", (F.col("a") + F.col("d")) / 2).withColumn("alpha", (F.col("a") ** 2 + F.col("d") ** 2 + 2 * F.col("b") ** 2) / 4)
    rho = (F.col("alpha") + F.col("mu") ** 2) / ((F.col("m") + 1) * (F.col("alpha") - F.col("mu") ** 2 / 2))
    s = s.withColumn("rho", F.greatest(F.least(rho, F.lit(1.0)), F.lit(0.0)))
    s = s.select("series", ((1 - F.col("rho")) * F.col("a") + F.col("rho") * F.col("mu")).alias("a"), ((1 - F.col("rho")) * F.col("b")).alias("b"), ((1 - F.col("rho")) * F.col("d") + F.col("rho") * F.col("mu")).alias("d"))
    x, y = F.col("momentum") - F.col("now.momentum"), F.col("vol") - F.col("now.vol")
    squared = (F.col("d") * x * x - 2 * F.col("b") * x * y + F.col("a") * y * y) / (F.col("a") * F.col("d") - F.col("b") ** 2)
    return pool.join(s, "series").select("series", "dt", "place", F.sqrt(squared).alias("distance"))


def shrunk(x: np.ndarray) -> np.ndarray:
    """The covariance of rows of x, shrunk to its mean variance by the oracle-approximating weight."""
    return shrunk_covariance(np.atleast_2d(np.cov(x, rowvar=False)), len(x))


def shrunk_covariance(s: np.ndarray, n: int) -> np.ndarray:
    """The covariance s of n rows, shrunk."""
    p, mu, alpha = len(s), np.trace(s) / len(s), np.mean(s**2)
    low = (n + 1) * (alpha - mu**2 / p)
    rho = 1.0 if low <= 0 else min(max((alpha + mu**2) / low, 0.0), 1.0)
    return (1 - rho) * s + rho * mu * np.eye(p)


def nearest(pool: np.ndarray, now: np.ndarray) -> np.ndarray:
    """Mahalanobis distances of the rows of pool from now; missing values take the pool's medians."""
    known = np.where(np.isfinite(pool).any(0), np.nanmedian(np.where(np.isfinite(pool), pool, np.nan), axis=0, keepdims=False), 0.0)
    pool, now = np.where(np.isfinite(pool), pool, known), np.where(np.isfinite(now), now, known)
    gap = pool - now
    return np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", gap, np.linalg.pinv(shrunk(pool)), gap), 0.0))


def apart(places: np.ndarray, order: np.ndarray, gap: int, most: int) -> list[int]:
    """Of rows in order, those taken in turn whose places lie gap from all taken, up to most."""
    taken: list[int] = []
    for k in order.tolist():
        if len(taken) == most:
            break
        if all(abs(places[k] - places[t]) >= gap for t in taken):
            taken.append(k)
    return taken


def chosen(pool: DataFrame, keys: list[str], features: tuple[str, ...], gap: int, most: int, least: int = 30) -> DataFrame:
    """(keys, dt, place, distance, weight, unprecedented) of pool (keys, dt, place, features, now_features).

    weight is a Gaussian kernel of half the pool's median distance. unprecedented: even the nearest lies beyond the 99.9 %
    point of chi-squared. Pools under `least` rows give none. One group a key, as long as a series.
    """
    kinds = dict(pool.dtypes)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        out = rows[[*keys, "dt", "place"]]
        if len(rows) < least:
            return out.head(0).assign(distance=0.0, weight=0.0, unprecedented=False)
        d = nearest(rows[list(features)].to_numpy(float), rows[[f"now_{f}" for f in features]].to_numpy(float)[0])
        width = max(0.5 * float(np.median(d)), 1e-12)
        taken = apart(rows["place"].to_numpy(), np.argsort(d, kind="stable"), gap, most)
        made = out.iloc[taken].assign(distance=d[taken], unprecedented=bool(d.min() ** 2 > CHI2[len(features) - 1]))
        return made.assign(weight=np.exp(-0.5 * (d[taken] / width) ** 2))[[*keys, "dt", "place", "distance", "weight", "unprecedented"]]

    head = ", ".join(f"{c} {kinds[c]}" for c in (*keys, "dt", "place"))
    return pool.groupBy(*keys).applyInPandas(run, f"{head}, distance double, weight double, unprecedented boolean")


def similar_periods(df: DataFrame, horizon: int = 20, most: int = 40, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(series, dt, place, distance, weight, unprecedented): the states most like the newest, `horizon` rows from one another."""
    newest = df.groupBy("series").agg(F.max("place").alias("_n"), F.max_by(F.struct(*features), "place").alias("_now"))
    pool = df.where(" AND ".join(f"{f} IS NOT NULL" for f in FEATURES)).join(newest, "series").where(F.col("place") <= F.col("_n") - horizon)
    return chosen(pool.select("series", "dt", "place", *features, *[F.col(f"_now.{f}").alias(f"now_{f}") for f in features]), ["series"], features, max(20, horizon), most)


def base_rates(periods: DataFrame, df: DataFrame, horizons: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """(horizon, p25, median, p75, n_effective, n, up_share, usable): what followed the periods, by their weights.

    usable: worth 4 periods or more, and not unprecedented.
    """
    ahead = [F.struct(F.lit(h).alias("horizon"), w.forward_change(F.col("px"), h).alias("forward")) for h in horizons]
    rows = df.withColumn("_ahead", F.array(*ahead)).join(periods.select("series", "place", "weight", "unprecedented"), ["series", "place"])
    rows = rows.select("weight", "unprecedented", F.inline("_ahead")).where("forward IS NOT NULL")
    up = rows.groupBy("horizon").agg(F.count("*").alias("n"), (F.sum(F.when(F.col("forward") > 0, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("up_share"), F.max("unprecedented").alias("_far"))
    out = weighted_quantiles(rows, "horizon", "forward", "weight", {"p25": 0.25, "median": 0.5, "p75": 0.75}).join(up, "horizon")
    return out.withColumn("usable", (F.col("n_effective") >= 4) & ~F.col("_far")).drop("_far")


def at_horizon(rates: DataFrame, horizon: int) -> DataFrame:
    """The row of rates for the horizon, or for the longest one below it."""
    best = rates.where(F.col("horizon") <= horizon).agg(F.max_by(F.struct(*rates.columns), "horizon").alias("r"))
    return best.where("r IS NOT NULL").select("r.*")


class Prefixes:
    """Covariances of the first m rows of x for any m, from running sums about one point; x is without missing values."""

    def __init__(self, x: np.ndarray) -> None:
        self.x = x - x.mean(0) if len(x) else x
        self.first = np.cumsum(self.x, axis=0)
        self.second = np.cumsum(self.x[:, :, None] * self.x[:, None, :], axis=0)

    def covariance(self, m: int) -> np.ndarray:
        mean = self.first[m - 1] / m
        return (self.second[m - 1] - m * np.outer(mean, mean)) / (m - 1)


def told_by_pools(place: np.ndarray, x: np.ndarray, realised: np.ndarray, horizon: int, start: int, gap: int, most: int, least: int = 30) -> dict[int, float]:
    """Of every asked row (a position in place), the median outcome of the states like it among those whose outcome it knew.

    A pool is a prefix of the known rows, so its moments come from running sums and nothing is copied; distances to it are one
    product. Rows with a missing feature take the pool's medians, and so their pools' moments anew.
    """
    known = np.flatnonzero(np.isfinite(x[:, : len(FEATURES)]).all(1))
    pool, at = x[known], place[known]
    whole = np.isfinite(pool).all(1)
    prefixes = Prefixes(np.where(np.isfinite(pool), pool, 0.0))
    first_gap = int(np.argmin(whole)) if not whole.all() else len(pool)
    asked = [t for t in known if (place[t] - 1 >= start and (place[t] - 1 - start) % horizon == 0) or (place[t] == place[-1] > start)]
    out = {}
    for t in asked:
        m = int(np.searchsorted(at, place[t] - horizon, "right"))
        if m < least:
            continue
        if m <= first_gap and np.isfinite(x[t]).all():
            step = pool[:m] - x[t]
            d = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", step, np.linalg.pinv(shrunk_covariance(prefixes.covariance(m), m)), step), 0.0))
        else:
            d = nearest(pool[:m], x[t])
        taken = apart(at[:m], np.argsort(d, kind="stable"), gap, most)
        after = realised[known[taken]]
        out[int(t)] = float(np.median(after[np.isfinite(after)])) if np.isfinite(after).any() else np.nan
    return out


def foretold(df: DataFrame, horizon: int, n: int = 20, most: int = 10, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """(series, place, dt, predicted, realised): what the states like each past one would have foretold, known then only.

    Every horizon-th row is asked, and the newest; its pool are the rows whose outcome it knew. A series' rows are moved once.
    """
    start = max(n + 30, horizon + 30)
    rows = df.select("series", "place", "dt", *features, (F.lead("px", horizon).over(ordered()) / F.col("px") * 100 - 100).alias("_realised"))
    kind = dict(df.dtypes)["dt"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("place")
        told = told_by_pools(own["place"].to_numpy(), own[list(features)].to_numpy(float), own["_realised"].to_numpy(float), horizon, start, max(n, horizon), most)
        out = own.iloc[list(told)]
        made = {"series": out["series"], "place": out["place"], "dt": out["dt"], "predicted": list(told.values()), "realised": out["_realised"]}
        return pd.DataFrame(made)

    return rows.groupBy("series").applyInPandas(run, f"series string, place int, dt {kind}, predicted double, realised double")


def skill(told: DataFrame, least: int = 10) -> DataFrame:
    """(series, n, ic, hit, base, edge) of told (series, predicted, realised); null under `least` outcomes.

    base is the share of the commoner direction, edge what hits exceed it by, both in per cent.
    """
    done = told.where("predicted IS NOT NULL AND realised IS NOT NULL")
    ic = spearman(done, "predicted", "realised", least).select("series", "ic")
    up = F.avg((F.col("realised") > 0).cast("double"))
    out = done.groupBy("series").agg(F.count("*").alias("n"), (100 * F.avg((F.signum("predicted") == F.signum("realised")).cast("double"))).alias("hit"), (100 * F.greatest(up, 1 - up)).alias("base"))
    out = out.withColumns({c: F.when(F.col("n") >= least, F.col(c)) for c in ("hit", "base")}).join(ic, "series", "left")
    return out.select("series", "n", "ic", "hit", "base", (F.col("hit") - F.col("base")).alias("edge"))

