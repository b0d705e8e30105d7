"""Learned weights and their skill out of sample beside a plain loop."""

import datetime as dt
import math

import numpy as np
import pandas as pd

from tidemark.operators import learning
from tidemark.operators.scores import DIMENSIONS

HORIZONS = (5, 10, 20)


def ranks(x):
    x = np.asarray(x)
    return np.array([(np.sum(x < v) + 1 + np.sum(x <= v)) / 2 for v in x])


def learned(px, dims, horizon):
    """The weights known at each row."""
    names, keep = list(DIMENSIONS), 2 ** (-1 / 252)
    state, seen, out = {k: [0.0, 0.0, 0.0] for k in names}, 0, []
    for t in range(len(px)):
        y = px[t] / px[t - horizon] - 1 if t >= horizon else None
        if y is not None and y != 0:
            seen += 1
            for k in names:
                m, w, q = state[k]
                agreed = np.sign(2 * dims[k][t - horizon] - 1) * np.sign(y)
                state[k] = [(keep * w * m + agreed) / (keep * w + 1), keep * w + 1, keep * keep * q + 1]
        e = {k: math.exp(0.5 * math.sqrt(w * w / q if q else 0.0) * m) for k, (m, w, q) in state.items()}
        total, floor = sum(e.values()), 0.05 * len(names)
        prior = sum(DIMENSIONS.values())
        out.append({k: DIMENSIONS[k] / prior if seen < 126 else (1 - floor) * e[k] / total + floor / len(names) for k in names})
    return out


def test_out_of_sample(spark):
    random = np.random.default_rng(13)
    n = 420
    px = 100 * np.exp(np.cumsum(random.normal(0, 0.01, n)))
    ahead = np.append(px[5:] / px[:-5] - 1, np.zeros(5))
    dims = {k: np.clip(0.5 + (j - 1) * 8 * ahead + random.normal(0, 0.2, n), 0, 1) for j, k in enumerate(DIMENSIONS)}
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"dt": days, "px": px} | {f"dim_{k}": v for k, v in dims.items()})).repartition(3)
    got = {r.fold: r for r in learning.out_of_sample(df, HORIZONS).collect()}
    m = n - max(HORIZONS)  # rows whose outcomes are all known
    weights = learned(px[:m], {k: v[:m] for k, v in dims.items()}, 5)
    start = int(m * 0.45)
    step, want = max((m - start) // 6, 1), {}
    for fold in range(6):
        end = start + fold * step
        a, b = end + max(HORIZONS), min(end + max(HORIZONS) + step, m)
        if b - a >= 30 and end >= 200:
            signal = [sum(weights[end - 1][k] * (2 * dims[k][t] - 1) for k in DIMENSIONS) for t in range(a, b)]
            want[fold] = (days[a], b - a, np.corrcoef(ranks(signal), ranks([px[t + 5] / px[t] - 1 for t in range(a, b)]))[0, 1])
    assert got.keys() == want.keys() and len(want) >= 2
    for fold, (first, size, ic) in want.items():
        assert got[fold].test_start == first and got[fold].n == size and abs(got[fold].ic - ic) < 1e-9
    found = learning.ic_summary(learning.out_of_sample(df, HORIZONS)).first()
    ics = [ic for *_, ic in want.values()]
    assert found.n == len(ics) and abs(found.mean - np.mean(ics)) < 1e-9 and abs(found.sd - np.std(ics, ddof=1)) < 1e-9 and found.positive_share == np.mean(np.array(ics) > 0)
    every = {(r.dt, r.series): r.weight for r in learning.dimension_weights(df, 5).collect()}
    whole = learned(px, dims, 5)
    assert all(abs(every[days[t], k] - whole[t][k]) < 1e-9 for t in (0, 100, 130, 131, 300, n - 1) for k in DIMENSIONS)
