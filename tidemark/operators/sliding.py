"""Order statistics of a sliding window: one sorted list a series, a row in and a row out by bisection at every step."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import along


class Window:
    """The last n values in order; nulls take a place in time, but none in the order."""

    def __init__(self, n: int) -> None:
        self.n, self.times, self.ordered = n, deque(), []

    def add(self, v: float) -> None:
        if len(self.times) == self.n:
            old = self.times.popleft()
            if old == old:
                del self.ordered[bisect_left(self.ordered, old)]
        self.times.append(v)
        if v == v:
            insort(self.ordered, v)

    def quantile(self, q: float) -> float:
        """Between the two nearest values, in proportion."""
        at = q * (len(self.ordered) - 1)
        k = int(at)
        low = self.ordered[k]
        return low + (self.ordered[min(k + 1, len(self.ordered) - 1)] - low) * (at - k)


def quantiles(df: DataFrame, column: str, n: int, wanted: dict[str, float]) -> DataFrame:
    """(series, dt, column, count, a column a name): quantiles of the n rows before each; null without a value."""

    def kernel(x: np.ndarray) -> dict[str, np.ndarray]:
        out = {name: np.full(len(x), np.nan) for name in wanted}
        count, window = np.zeros(len(x), np.int64), Window(n)
        for t, v in enumerate(x.tolist()):
            count[t] = len(window.ordered)
            if count[t]:
                for name, q in wanted.items():
                    out[name][t] = window.quantile(q)
            window.add(v)
        return {"count": count} | out

    return along(df, [column], kernel, "count long, " + ", ".join(f"{name} double" for name in wanted), keep=[column])


def quantile_z(df: DataFrame, column: str, n: int, least: int) -> DataFrame:
    """(series, dt, z): column against the median and the 2.5 to 97.5 % range (over 1.35) of the n rows before."""
    rows = quantiles(df, column, n, {"_low": 0.025, "_mid": 0.5, "_high": 0.975})
    width: Column = (F.col("_high") - F.col("_low")) / 1.35
    return rows.select("series", "dt", F.when((F.col("count") >= least) & (width > 1e-12), (F.col(column) - F.col("_mid")) / width).alias("z"))
