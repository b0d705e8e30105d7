"""A label of market state for every row of a series: level, volatility, hidden state and change-points in one pass."""

from __future__ import annotations

import math
from collections import deque

import numpy as np
from pyspark.sql import DataFrame

from tidemark.operators.folds import along

# Constants of the four filters and of the labels.
LEVEL_NOISE, FIRST_NOISE = 0.01, 0.1
GARCH, VARIANCE_BOUNDS, FIRST_VARIANCE = (1e-4, 0.1, 0.85), (0.001, 1.0), 0.04
STAY, MEANS, SDS, START, MARGIN = 0.98, (0.6, 0.0, -0.6), (0.3, 0.25, 0.3), (0.33, 0.34, 0.33), 0.01
DRIFT, ALARM = 0.5, 4.0
VOLATILITY = ((0.6, "LOW"), (0.9, "NORMAL"), (1.4, "HIGH"))
BULL, NEUTRAL, BEAR = range(3)


def spread(values: deque[float] | list[float]) -> tuple[float, float]:
    """Mean and population variance."""
    mean = sum(values) / len(values)
    return mean, sum((v - mean) ** 2 for v in values) / len(values)


class Level:
    """A local level by a Kalman filter whose measurement noise follows the last 20 surprises."""

    def __init__(self) -> None:
        self.at, self.variance, self.noise, self.surprises = 0.0, 1.0, FIRST_NOISE, deque(maxlen=20)

    def step(self, x: float) -> float:
        ahead, surprise = self.variance + LEVEL_NOISE, x - self.at
        gain = ahead / (ahead + self.noise)
        self.at, self.variance = self.at + gain * surprise, (1 - gain) * ahead
        self.surprises.append(surprise)
        if len(self.surprises) >= 5:
            self.noise = 0.9 * self.noise + 0.1 * spread(self.surprises)[1]
        return self.at


class Volatility:
    """GARCH(1,1) of the changes of x, against their long-run variance; the label of the ratio."""

    def __init__(self) -> None:
        self.variance = self.long_run = FIRST_VARIANCE
        self.before, self.shocks = None, deque(maxlen=50)

    def step(self, x: float) -> str:
        shock = 0.0 if self.before is None else x - self.before
        self.before = x
        self.shocks.append(shock)
        base, news, memory = GARCH
        self.variance = min(max(base + news * shock * shock + memory * self.variance, VARIANCE_BOUNDS[0]), VARIANCE_BOUNDS[1])
        if len(self.shocks) >= 10:
            self.long_run = 0.95 * self.long_run + 0.05 * spread(self.shocks)[1]
        ratio = math.sqrt(self.variance / self.long_run) if self.long_run > 0 else 1.0
        return next((label for most, label in VOLATILITY if ratio < most), "EXTREME")


class Chain:
    """Three hidden states, best first, filtered forward; means, deviations and moves learn from the likeliest states."""

    def __init__(self) -> None:
        self.move = [[STAY if a == b else (1 - STAY) / 2 for b in range(3)] for a in range(3)]
        self.mean, self.sd, self.share = list(MEANS), list(SDS), list(START)
        self.seen: deque[tuple[int, float]] = deque(maxlen=50)
        self.n = 0

    def step(self, x: float) -> list[float]:
        ahead = [sum(self.share[a] * self.move[a][b] for a in range(3)) for b in range(3)]
        like = [math.exp(-0.5 * ((x - m) / (s + 1e-4)) ** 2) / ((s + 1e-4) * math.sqrt(2 * math.pi)) for m, s in zip(self.mean, self.sd, strict=True)]
        joint = [a * b for a, b in zip(ahead, like, strict=True)]
        total = sum(joint)
        self.share = [j / total for j in joint] if total > 1e-10 else list(START)
        state = max(range(3), key=lambda k: (self.share[k], -k))
        self.seen.append((state, x))
        self.n += 1
        if self.n >= 10:
            self._learn_states()
        if self.n >= 5:
            self._learn_moves()
        return self.share

    def _learn_states(self) -> None:
        for k in range(3):
            own = [x for state, x in self.seen if state == k]
            if len(own) >= 2:
                mean, variance = spread(own)
                self.mean[k] = 0.9 * self.mean[k] + 0.1 * mean
                self.sd[k] = 0.9 * self.sd[k] + 0.1 * max(math.sqrt(variance), 1e-4)
        self.mean[BULL] = max(self.mean[BULL], self.mean[NEUTRAL] + MARGIN)
        self.mean[BEAR] = min(self.mean[BEAR], self.mean[NEUTRAL] - MARGIN)

    def _learn_moves(self) -> None:
        states = [state for state, _ in list(self.seen)[-30:]]
        moves = list(zip(states[:-1], states[1:], strict=True))
        for a in range(3):
            n = sum(m[0] == a for m in moves)
            if n >= 2:
                self.move[a] = [0.8 * self.move[a][b] + 0.2 * (moves.count((a, b)) + 1) / (n + 3) for b in range(3)]


class Alarm:
    """Two-sided CUSUM of x against its 20 values before."""

    def __init__(self) -> None:
        self.up = self.down = 0.0
        self.mean, self.sd, self.before = 0.0, 1.0, deque(maxlen=20)

    def step(self, x: float) -> bool:
        if len(self.before) >= 2:
            self.mean, variance = spread(self.before)
            self.sd = max(math.sqrt(variance), 0.1)
        self.before.append(x)
        z = (x - self.mean) / self.sd
        self.up, self.down = max(self.up + z - DRIFT, 0.0), max(self.down - z - DRIFT, 0.0)
        rung = self.up > ALARM or self.down > ALARM
        if rung:
            self.up = self.down = 0.0
        return rung


def label_of(change: bool, bull: float, bear: float) -> str:
    if change:
        return "TRANSITION"
    for at_least, prefix in ((0.6, ""), (0.4, "WEAK_")):
        if bull > at_least:
            return f"{prefix}BULL"
        if bear > at_least:
            return f"{prefix}BEAR"
    return "NEUTRAL"


def regimes(x: np.ndarray) -> dict[str, np.ndarray]:
    """Every filter over x; NaN counts as 0. The chain and the alarm read the filtered level, the volatility reads x."""
    level, volatility, chain, alarm = Level(), Volatility(), Chain(), Alarm()
    rows = []
    for v in np.nan_to_num(x).tolist():
        at = level.step(v)
        width, shares, change = volatility.step(v), chain.step(at), alarm.step(at)
        rows.append((at, volatility.variance, shares[BULL], shares[BEAR], max(shares), width, change, label_of(change, shares[BULL], shares[BEAR])))
    columns = list(zip(*rows, strict=True)) if rows else [()] * 8
    return dict(zip(("level", "variance", "bull", "bear", "confidence", "volatility", "change", "regime"), map(list, columns), strict=True))


def regime_rows(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """(series, dt, keep, level, variance, bull, bear, confidence, volatility, change, regime) of column along each series."""
    return along(df, [column], regimes, "level double, variance double, bull double, bear double, confidence double, volatility string, change boolean, regime string", keep=keep)
