"""Does a series revert: unit roots with lags, stationarity, break points, and the diagnostics of a gap in one row.

A series is one ordered group of days. Formulas are those of Dickey and Fuller with lags by Akaike's criterion, MacKinnon (1994),
Kwiatkowski et al. (1992) with the bandwidth of Hobijn et al. (1998), and Bai and Perron (2003).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# MacKinnon's response surface for one series with a constant, and the KPSS critical values.
TAU_LEAST, TAU_MOST, TAU_SPLIT = -18.83, 2.74, -1.61
TAU_SMALL, TAU_LARGE = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
KPSS_POINTS, KPSS_CHANCES = (0.347, 0.463, 0.574, 0.739), (0.10, 0.05, 0.025, 0.01)


def tau_p(t: float) -> float:
    """The p-value of a Dickey-Fuller t."""
    if t > TAU_MOST:
        return 1.0
    if t < TAU_LEAST:
        return 0.0
    surface = TAU_SMALL if t <= TAU_SPLIT else TAU_LARGE
    return 0.5 * math.erfc(-sum(c * t**k for k, c in enumerate(surface)) / math.sqrt(2))


def most_lags(n: int) -> int:
    return max(min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2), 0)


def _moments(x: np.ndarray, lags: int, first: int) -> np.ndarray:
    """Cross products of (1, level before, changes 1 to lags before, change) over the changes from `first` on."""
    d = np.diff(x)
    rows = np.column_stack([np.ones(len(d) - first), x[first:-1], *[d[first - k : len(d) - k] for k in range(1, lags + 1)], d[first:]])
    return rows.T @ rows


def _fit(m: np.ndarray, lags: int) -> tuple[float, float, float]:
    """(t of the level, rest sum of squares, rows) with the first `lags` lags, from moments that hold more."""
    own = [*range(lags + 2)]
    xx, xy, n = m[np.ix_(own, own)], m[own, -1], m[0, 0]
    inverse = np.linalg.pinv(xx)
    beta = inverse @ xy
    rest = max(float(m[-1, -1] - beta @ xy), 1e-300)
    return float(beta[1] / math.sqrt(rest / max(n - len(own), 1) * max(inverse[1, 1], 1e-300))), rest, float(n)


def unit_root(x: np.ndarray) -> tuple[float, int, float]:
    """(t, lags, p): every number of lags is tried on the same rows, from one moment matrix; the chosen one is fitted on all it can use."""
    x = x - x.mean()  # the constant takes it up; large levels would cost digits
    most = most_lags(len(x) - 1)
    whole = _moments(x, most, most)

    def criterion(lags: int) -> float:
        _, rest, n = _fit(whole, lags)
        return n * (math.log(2 * math.pi) + math.log(rest / n) + 1) + 2 * (lags + 2)

    lags = min(range(most + 1), key=lambda k: (criterion(k), k))
    t, _, _ = _fit(_moments(x, lags, lags), lags)
    return t, lags, tau_p(t)


def stationarity(x: np.ndarray) -> tuple[float, int, float]:
    """(statistic, bandwidth, p), p within the tabled 0.01 to 0.10."""
    n, e = len(x), x - x.mean()
    together = lambda k: float(e[k:] @ e[: n - k])
    reach = int(n ** (2 / 9))
    s0 = together(0) / n + sum(together(k) for k in range(1, reach + 1)) / (n / 2)
    s1 = sum(k * together(k) for k in range(1, reach + 1)) / (n / 2)
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1) if s0 else 0
    variance = (together(0) + 2 * sum(together(k) * (1 - k / (width + 1)) for k in range(1, width + 1))) / n
    value = float((np.cumsum(e) ** 2).sum()) / n**2 / variance if variance > 0 else 0.0
    return value, width, float(np.interp(value, KPSS_POINTS, KPSS_CHANCES))


def pull(x: np.ndarray) -> tuple[float, float, float]:
    """(theta, mean, sigma) of a mean-reverting level from its AR(1), the slope corrected for small samples."""
    if len(x) < 20:
        return 0.05, 0.0, max(float(x.std()), 1e-6) if len(x) > 1 else 1.0
    b, y, n = x[:-1], x[1:], len(x) - 1
    d = float(((b - b.mean()) ** 2).sum())
    if n * d < 1e-12:
        return 0.05, float(x.mean()), max(float(x.std()), 1e-6)
    raw = float(((b - b.mean()) * (y - y.mean())).sum() / d)
    start = float(y.mean() - raw * b.mean())
    slope = min(max(raw, 1e-6), 0.999)
    more = (1 + 3 * slope) / n
    slope = min(max(slope + more + (3 * more / n if slope > 0.95 else 0.0), 0.0), 0.999)
    theta = -math.log(slope) if slope > 1e-6 else 0.05
    mean = start / (1 - slope)
    noise = float(np.var(y - slope * b - start))
    return max(theta, 1e-4), mean, max(math.sqrt(noise * 2 * theta / max(1 - slope**2, 0.001)), 1e-6)


def diagnosed(x: np.ndarray, window: int = 60) -> dict[str, float]:
    """Pull now and over time, half-lives, and both tests, of the finite values of x; neutral values for 30 or fewer."""
    x = x[np.isfinite(x)]
    names = ("theta", "mu", "sigma", "theta_now", "theta_spread", "half_life", "half_life_now", "stationary_sd", "adf_t", "adf_lags", "adf_p", "kpss", "kpss_lags", "kpss_p", "last")
    if len(x) <= 30:
        sd = max(float(x.std()) if len(x) else 0.0, 1e-6)
        values = (0.05, 0.0, sd, 0.05, 0.0, math.log(2) / 0.05, math.log(2) / 0.05, sd / math.sqrt(0.1), math.nan, 0, 1.0, math.nan, 0, 0.0, float(x[-1]) if len(x) else 0.0)
        return dict(zip(names, values, strict=True))
    theta, mu, sigma = pull(x)
    size = min(window, len(x) // 3)
    past = [pull(x[i - size : i])[0] for i in range(size, len(x))]
    now, spread = past[-1], float(np.std(past)) if len(past) > 1 else 0.0
    ln2 = math.log(2)
    values = (theta, mu, sigma, now, spread, ln2 / max(theta, 1e-4), ln2 / max(now, 1e-4), sigma / math.sqrt(2 * max(theta, 1e-4)), *unit_root(x), *stationarity(x), float(x[-1]))
    return dict(zip(names, values, strict=True))


def reversion_diagnostics(df: DataFrame, column: str) -> DataFrame:
    """One row a series: theta, mu, sigma, the newest theta of a 60-row window (the newest value aside) and the spread of all such,
    half-lives, the stationary deviation, both tests and the last value."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("dt", kind="stable")
        x = own[column].to_numpy(float)
        return pd.DataFrame([{"series": own["series"].iloc[0], "n": int(np.isfinite(x).sum()), **diagnosed(x)}])

    made = ", ".join(f"{c} {'int' if c.endswith('_lags') else 'double'}" for c in diagnosed(np.zeros(0)))
    return df.select("series", "dt", column).groupBy("series").applyInPandas(run, f"series string, n long, {made}")


def reverting_path(diagnostics: DataFrame, steps: int = 90) -> DataFrame:
    """(series, step, mean, low, high): the path from the last value at the newest pull; the bounds are the paths of a slower
    and a faster pull, a spread of past ones apart."""
    at = lambda theta: F.col("mu") + (F.col("last") - F.col("mu")) * F.exp(-theta * F.col("step"))
    rows = diagnostics.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    theta, spread = F.col("theta_now"), F.col("theta_spread")
    return rows.select("series", "step", at(theta).alias("mean"), at(theta + spread).alias("low"), at(theta - spread).alias("high"))


def gated_hurst(hurst: DataFrame, diagnostics: DataFrame, least: int = 200) -> DataFrame:
    """(series, hurst): the exponent of series whose unit root is rejected at 5 % and that have over `least` rows, else a half."""
    out = diagnostics.join(hurst, "series", "left")
    return out.select("series", F.when((F.col("n") > least) & (F.col("adf_p") <= 0.05), F.coalesce("hurst", F.lit(0.5))).otherwise(0.5).alias("hurst"))


def break_points(x: np.ndarray, most: int = 3, trim: float = 0.15) -> list[int]:
    """First places of the stretches after each shift of the mean: the least sum of squares for every number of breaks up to
    most, by dynamic programming over stretches of at least trim of the rows; the number is that of the least BIC."""
    n = len(x)
    least = max(int(trim * n), 2)
    if n < 2 * least:
        return []
    x = x - x.mean()
    s, q = np.append(0.0, np.cumsum(x)), np.append(0.0, np.cumsum(x * x))
    rest = lambda a, b: q[b] - q[a] - (s[b] - s[a]) ** 2 / (b - a)  # noqa: E731  (rows a to b - 1)
    ends = np.arange(n + 1)
    cost = np.full(n + 1, np.inf)
    cost[least:] = rest(np.zeros(n + 1 - least, int), ends[least:])
    found, back = [(cost[n], [])], []
    for m in range(1, most + 1):
        after, cut = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        for b in range((m + 1) * least, n + 1):
            starts = ends[m * least : b - least + 1]
            total = cost[starts] + rest(starts, b)
            k = int(np.argmin(total))
            after[b], cut[b] = total[k], starts[k]
        back.append(cut)
        cost = after
        if not np.isfinite(cost[n]):
            break
        places, b = [], n
        for cuts in reversed(back):
            b = int(cuts[b])
            places.append(b)
        found.append((cost[n], places[::-1]))
    bic = lambda f: n * math.log(max(f[0], 1e-12) / n) + (2 * len(f[1]) + 1) * math.log(n)
    return min(found, key=lambda f: (bic(f), len(f[1])))[1]


def breaks(df: DataFrame, column: str, most: int = 3, trim: float = 0.15, floor: int = 50) -> DataFrame:
    """(series, place, dt, before, after) of each break of a series' mean, with the means on its two sides; none under floor rows."""
    kind = dict(df.dtypes)["dt"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own[np.isfinite(own[column].to_numpy(float))].sort_values("dt", kind="stable")
        x = own[column].to_numpy(float)
        places = break_points(x, most, trim) if len(x) >= floor else []
        edges = [0, *places, len(x)]
        out = [(own["series"].iloc[0], p, own["dt"].iloc[p], x[edges[k] : p].mean(), x[p : edges[k + 2]].mean()) for k, p in enumerate(places)]
        return pd.DataFrame(out, columns=["series", "place", "dt", "before", "after"]).astype({"series": object, "dt": object})

    return df.select("series", "dt", column).groupBy("series").applyInPandas(run, f"series string, place long, dt {kind}, before double, after double")
