"""Stateful streams of series rows (series, dt timestamp, ...): the recursions of `folds`, one state a series.

Rows of a micro-batch are taken in order of dt; a row older than the newest one that a state has absorbed is left out, as a
recursion can't be taken back. Batches of the same rows in order give what the batch operators give.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.folds import half_life_factor


def _stateful(df: DataFrame, step: Callable[[list, pd.DataFrame], tuple[list, dict[str, list]]], start: list, outputs: str, state: str, columns: list[str]) -> DataFrame:
    """step(state, rows) gives the state after rows (in order) and the values to emit, by name; outputs and state are DDL."""
    names = [c.split()[0] for c in outputs.split(", ")]

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        newest, *own = list(held.get) if held.exists else [None, *start]
        rows = pd.concat(list(batches)).sort_values("dt", kind="stable")
        rows = rows[rows["dt"].astype("int64") > newest] if newest is not None else rows
        rows = rows.drop_duplicates("dt", keep="last")
        if len(rows):
            own, made = step(own, rows)
            held.update((int(rows["dt"].astype("int64").iloc[-1]), *own))
            yield pd.DataFrame({"series": key[0]} | made)[["series", *names]]

    return df.select("series", "dt", *columns).groupBy("series").applyInPandasWithState(run, f"series string, {outputs}", f"newest long, {state}", "append", GroupStateTimeout.NoTimeout)


def drift_filter(df: DataFrame, column: str, leak: float = 0.03, gain: float = 0.056, long_run: float = 100.0) -> DataFrame:
    """(series, dt, level, variance) as `folds.drift_filter` has them."""

    def step(state: list, rows: pd.DataFrame):
        level, variance, begun = state
        made: dict[str, list] = {"dt": rows["dt"].tolist(), "level": [], "variance": []}
        for x in np.nan_to_num(rows[column].to_numpy(float)).tolist():
            if begun:
                level = level * (1 - leak) + gain * x
                variance = max(variance * (1 - leak) + leak * long_run + min(abs(gain * x) / 2, long_run / 2), 1e-6)
            else:
                level, variance, begun = x, long_run, True
            made["level"].append(level)
            made["variance"].append(variance)
        return [level, variance, begun], made

    return _stateful(df, step, [0.0, long_run, False], "dt timestamp, level double, variance double", "level double, variance double, begun boolean", [column])


def delayed_labels(df: DataFrame, call: str, price: str, horizon: int) -> DataFrame:
    """(series, dt, resolved, call, outcome): every call with the change of price over the next horizon rows, once it is known."""

    def step(state: list, rows: pd.DataFrame):
        days, calls, prices = (list(x) for x in state)
        made: dict[str, list] = {"dt": [], "resolved": [], "call": [], "outcome": []}
        for at, c, p in zip(rows["dt"], rows[call], rows[price], strict=True):
            days, calls, prices = [*days, int(pd.Timestamp(at).value)], [*calls, float(c)], [*prices, float(p)]
            if len(days) > horizon:
                made["dt"].append(pd.Timestamp(days[0]))
                made["resolved"].append(at)
                made["call"].append(calls[0])
                made["outcome"].append(p / prices[0] - 1 if prices[0] else None)
                days, calls, prices = days[1:], calls[1:], prices[1:]
        return [days, calls, prices], made

    return _stateful(df, step, [[], [], []], "dt timestamp, resolved timestamp, call double, outcome double", "days array<long>, calls array<double>, prices array<double>", [call, price])


def discounted_skill(df: DataFrame, call: str, outcome: str, half_life: float = 252.0) -> DataFrame:
    """(series, dt, agreement, n_effective) as `folds.discounted_skill` has them."""
    keep = half_life_factor(half_life)

    def step(state: list, rows: pd.DataFrame):
        m, w, q = state
        made: dict[str, list] = {"dt": rows["dt"].tolist(), "agreement": [], "n_effective": []}
        for c, y in zip(rows[call].to_numpy(float), rows[outcome].to_numpy(float), strict=True):
            if y == y and y != 0:
                agreed = float(np.nan_to_num(np.sign(c) * np.sign(y)))
                m, w, q = (keep * w * m + agreed) / (keep * w + 1), keep * w + 1, keep * keep * q + 1
            made["agreement"].append(m)
            made["n_effective"].append(w * w / q if q > 0 else 0.0)
        return [m, w, q], made

    return _stateful(df, step, [0.0, 0.0, 0.0], "dt timestamp, agreement double, n_effective double", "mean double, w double, q double", [call, outcome])


def keep_last(df: DataFrame, keys: list[str], order: str, late: str = "2 days") -> DataFrame:
    """The last row of each key and hour by order, once the watermark has passed the hour: dropDuplicates would keep the first."""
    rest = [c for c in df.columns if c not in keys]
    rows = df.withWatermark("dt", late).groupBy(*keys, F.window("dt", "1 hour").alias("_w")).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return rows.select(*keys, "_row.*")


def settled(df: DataFrame, late: str = "1 hour") -> DataFrame:
    """(series, day, px, n): the last value of each day, given out only when the day can no longer change; a day still forming is held back."""
    rows = df.withWatermark("dt", late).groupBy("series", F.window("dt", "1 day").alias("_w")).agg(F.max_by("px", "dt").alias("px"), F.count("*").alias("n"))
    return rows.select("series", F.col("_w.start").cast("date").alias("day"), "px", "n")


def expired(df: DataFrame, days: int, late: str = "1 hour") -> DataFrame:
    """(series, newest): a series that has sent nothing for so many days of event time; its state is dropped."""
    wait = days * 86_400_000

    def run(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            (newest,) = held.get
            held.remove()
            yield pd.DataFrame({"series": [key[0]], "newest": [pd.Timestamp(newest, unit="ms")]})
            return
        newest = max([*(list(held.get) if held.exists else []), *(int(rows["dt"].max().value // 1_000_000) for rows in batches)])
        held.update((newest,))
        held.setTimeoutTimestamp(newest + wait)

    rows = df.select("series", "dt").withWatermark("dt", late)
    return rows.groupBy("series").applyInPandasWithState(run, "series string, newest timestamp", "newest long", "append", GroupStateTimeout.EventTimeTimeout)
