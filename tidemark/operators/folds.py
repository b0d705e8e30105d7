"""Forward recursions along series, one pass each.

A series is one ordered group: as long as its days or hours, never events. Series run side by side, in Arrow batches; each
step reads the state, emits, then absorbs, so a prefix of a series gives a prefix of the results.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def along(df: DataFrame, columns: list[str], kernel: Callable[..., dict[str, np.ndarray]], schema: str, *by: str, order: str = "dt", keep: list[str] | None = None) -> DataFrame:
    """(by, order, keep, outputs of schema): kernel(*arrays of columns) over the rows of each key in order."""
    by = by or ("series",)
    keep = keep or []
    kinds = dict(df.dtypes)
    head = ", ".join(f"{c} {kinds[c]}" for c in (*by, order, *keep))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order, kind="stable")
        made = kernel(*[rows[c].to_numpy(float) for c in columns])
        return pd.DataFrame({c: rows[c].to_numpy() for c in (*by, order, *keep)} | made)

    wanted = list(dict.fromkeys([*by, order, *keep, *columns]))
    return df.select(*wanted).groupBy(*by).applyInPandas(run, f"{head}, {schema}")


def half_life_factor(half_life: float) -> float:
    """The factor for each step that halves a weight in half_life steps."""
    return 2.0 ** (-1.0 / max(half_life, 1e-9))


def drift(x: np.ndarray, leak: float, gain: float, long_run: float) -> dict[str, np.ndarray]:
    level, variance = np.zeros(len(x)), np.zeros(len(x))
    for t, value in enumerate(np.nan_to_num(x).tolist()):
        if t == 0:
            s, v = value, long_run
        else:
            s = s * (1 - leak) + gain * value
            v = max(v * (1 - leak) + leak * long_run + min(0.5 * abs(gain * value), 0.5 * long_run), 1e-6)
        level[t], variance[t] = s, v
    return {"level": level, "variance": variance}


def drift_filter(df: DataFrame, column: str, leak: float = 0.03, gain: float = 0.056, long_run: float = 100.0) -> DataFrame:
    """(series, dt, column, level, variance): a leaky drift-diffusion filter; the first value is the start.

    level falls by `leak` and rises by `gain` times the value. variance leans to long_run, plus half the step, within half
    of long_run, never under 1e-6. Nulls and NaN count as 0.
    """
    return along(df, [column], lambda x: drift(x, leak, gain, long_run), "level double, variance double", keep=[column])


def ewm(df: DataFrame, column: str, alpha: float) -> DataFrame:
    """(series, dt, column, mean): exponential mean without adjustment, seeded by the first value; null keeps it."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out, mean = np.full(len(x), np.nan), None
        for t, v in enumerate(x.tolist()):
            if v == v:
                mean = v if mean is None else mean + alpha * (v - mean)
            out[t] = np.nan if mean is None else mean
        return {"mean": out}

    return along(df, [column], kernel, "mean double", keep=[column])


def discounted_moments(df: DataFrame, column: str, half_life: float) -> DataFrame:
    """(series, dt, mean, variance): discounted mean and variance, both over the weight gathered so far; null decays nothing."""
    keep = half_life_factor(half_life)

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        mean, variance = np.full(len(x), np.nan), np.full(len(x), np.nan)
        w = m = s = 0.0
        for t, v in enumerate(x.tolist()):
            if v == v:
                before, w = keep * w, keep * w + 1
                step = v - m
                m += step / w
                s = keep * s + step * step * before / w
            if w > 0:
                mean[t], variance[t] = m, s / w
        return {"mean": mean, "variance": variance}

    return along(df, [column], kernel, "mean double, variance double")


def forgetting_ar1(df: DataFrame, column: str, half_life: float, least: int = 8, ridge: float = 1e-8) -> DataFrame:
    """(series, dt, phi, se): slope of a value on the one before by discounted least squares, and its standard error.

    Null until `least` pairs, with a discounted weight of 4 or more, have been seen.
    """
    keep = half_life_factor(half_life)

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        phi, se = np.full(len(x), np.nan), np.full(len(x), np.nan)
        w = sb = sx = sbb = sbx = sxx = 0.0
        n, before = 0, np.nan
        for t, v in enumerate(x.tolist()):
            if v == v and before == before:
                w, sb, sx, sbb, sbx, sxx = keep * w + 1, keep * sb + before, keep * sx + v, keep * sbb + before * before, keep * sbx + before * v, keep * sxx + v * v
                n += 1
            if v == v:
                before = v
            if n >= least and w >= 4:
                d = sbb - sb * sb / w + ridge
                slope = (sbx - sb * sx / w) / d
                rest = max(sxx - sx * sx / w - slope * (sbx - sb * sx / w), 0.0)
                phi[t], se[t] = slope, np.sqrt(rest / max(w - 2, 1.0) / d)
        return {"phi": phi, "se": se}

    return along(df, [column], kernel, "phi double, se double")


def expanding_quantiles(df: DataFrame, column: str, wanted: dict[str, tuple[float, float]], least: int) -> DataFrame:
    """(series, dt, a column a name): nearest-rank quantiles of all rows before, from {name: (quantile, default)}.

    The default stands under `least` rows and where the quantile isn't over 0. Kept in one sorted list a series.
    """

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out = {name: np.full(len(x), default) for name, (_, default) in wanted.items()}
        before: list[float] = []
        for t, v in enumerate(x.tolist()):
            if len(before) >= least:
                for name, (q, _) in wanted.items():
                    found = before[round(q * (len(before) - 1))]  # halves go to the even place
                    if found > 0:
                        out[name][t] = found
            if v == v:
                insort(before, v)
        return out

    return along(df, [column], kernel, ", ".join(f"{name} double" for name in wanted))


def expanding_cdf(df: DataFrame, column: str, name: str) -> DataFrame:
    """(series, dt, name): the mid-rank of column among all earlier rows: (0.5 (below + not above) + 0.5) / (n + 1)."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out, before = np.full(len(x), 0.5), []
        for t, v in enumerate(x.tolist()):
            if before and v == v:
                out[t] = (0.5 * (bisect_left(before, v) + bisect_right(before, v)) + 0.5) / (len(before) + 1)
            if v == v:
                insort(before, v)
        return {name: out}

    return along(df, [column], kernel, f"{name} double")


def discounted_skill(rounds: DataFrame, call: str, outcome: str, half_life: float = 252.0) -> DataFrame:
    """(series, dt, agreement, n_effective) of rounds (series, dt, call, outcome): every series at every date.

    agreement is the discounted mean agreement in sign of a series' calls with the outcomes, n_effective Kish's number of
    rounds. A date without an outcome, or with one of 0, leaves the state as it is; a series without a call scores 0 in it,
    so that all series share the number of rounds.
    """
    keep = half_life_factor(half_life)

    def kernel(calls: np.ndarray, outcomes: np.ndarray) -> dict[str, np.ndarray]:
        mean, n = np.zeros(len(calls)), np.zeros(len(calls))
        agreed = np.nan_to_num(np.sign(calls) * np.sign(outcomes)).tolist()
        m = w = q = 0.0
        for t, y in enumerate(outcomes.tolist()):
            if y == y and y != 0:
                m, w, q = (keep * w * m + agreed[t]) / (keep * w + 1), keep * w + 1, keep * keep * q + 1
            mean[t], n[t] = m, w * w / q if q > 0 else 0.0
        return {"agreement": mean, "n_effective": n}

    return along(rounds, [call, outcome], kernel, "agreement double, n_effective double")


def skill_weights(skill: DataFrame, kappa: float = 0.5, floor: float = 0.02) -> DataFrame:
    """(dt, series, weight): softmax of kappa sqrt(n) agreement across series on each date, mixed with an equal share."""
    day = Window.partitionBy("dt")
    e = kappa * F.sqrt("n_effective") * F.col("agreement")
    rows = skill.withColumn("_e", e).withColumn("_e", F.exp(F.col("_e") - F.max("_e").over(day)))
    n = F.count("*").over(day)
    k = F.least(floor * n, F.lit(1.0))
    return rows.select("dt", "series", ((1 - k) * F.col("_e") / F.sum("_e").over(day) + k / n).alias("weight"))


def shrunk_weights(weights: DataFrame, shrink: float = 0.5) -> DataFrame:
    """(dt, series, weight): weights times their number, pulled to 1 by shrink; each date's sum to their number again."""
    day = Window.partitionBy("dt")
    n = F.count("*").over(day)
    rows = weights.withColumn("_w", 1 + shrink * (F.col("weight") * n - 1))
    return rows.select("dt", "series", (F.col("_w") * n / F.sum("_w").over(day)).alias("weight"))
