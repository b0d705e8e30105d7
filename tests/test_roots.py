"""Unit roots, stationarity, breaks and sliding quantiles beside independent versions."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import roots, sliding


def regression(y, x):
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    rest = y - x @ beta
    s2 = rest @ rest / (len(y) - x.shape[1])
    return beta, np.sqrt(s2 * np.diag(np.linalg.inv(x.T @ x))), float(rest @ rest)


def dickey_fuller(x):
    """Every lag order by its own least squares."""
    d = np.diff(x)
    n = len(d)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    design = lambda lags, first: np.column_stack([x[first:-1], np.ones(n - first), *[d[first - k : n - k] for k in range(1, lags + 1)]])
    scores = []
    for lags in range(most + 1):
        m = n - most
        *_, ssr = regression(d[most:], design(lags, most))
        scores.append((m * (math.log(2 * math.pi * ssr / m) + 1) + 2 * (lags + 2), lags))
    lags = min(scores)[1]
    beta, se, _ = regression(d[lags:], design(lags, lags))
    return beta[0] / se[0], lags


@pytest.mark.parametrize("seed", range(4))
def test_unit_root(seed):
    random = np.random.default_rng(seed)
    e = random.normal(size=600)
    x = np.zeros(600)
    for t in range(3, 600):
        x[t] = (0.99, 0.6, 1.0, 0.9)[seed] * x[t - 1] + 0.4 * (x[t - 1] - x[t - 2]) - 0.2 * (x[t - 2] - x[t - 3]) + e[t]
    t, lags, p = roots.unit_root(x + 1000)
    want = dickey_fuller(x)
    assert abs(t - want[0]) < 1e-6 and lags == want[1] > 0
    assert (p < 0.01) == (seed in (1, 3))


def test_surface():
    assert abs(roots.tau_p(-2.86) - 0.05) < 5e-4 and abs(roots.tau_p(-3.43) - 0.01) < 5e-4 and abs(roots.tau_p(-2.57) - 0.10) < 1e-3
    assert roots.tau_p(3.0) == 1 and roots.tau_p(-20) == 0


def test_stationarity():
    random = np.random.default_rng(4)
    still, walk = random.normal(size=500), np.cumsum(random.normal(size=500))
    for x in (still, walk):
        value, width, p = roots.stationarity(x)
        e, n = x - x.mean(), len(x)
        gamma = [sum(e[t] * e[t - k] for t in range(k, n)) / n for k in range(width + 1)]
        want = sum(np.cumsum(e) ** 2) / n**2 / (gamma[0] + 2 * sum((1 - k / (width + 1)) * gamma[k] for k in range(1, width + 1)))
        assert abs(value - want) < 1e-9
    assert roots.stationarity(still)[2] > 0.05 and roots.stationarity(walk)[2] == 0.01 and roots.stationarity(walk)[1] > 10


def test_breaks_by_all_partitions():
    random = np.random.default_rng(7)
    for shifts in ((0, 0, 0), (0, 4, 0), (0, 4, 8)):
        x = np.concatenate([random.normal(s, 1, 14) for s in shifts])
        n, least = len(x), int(0.15 * len(x))
        best = []
        for m in range(4):
            for cuts in itertools.combinations(range(least, n - least + 1), m):
                edges = [0, *cuts, n]
                if min(b - a for a, b in itertools.pairwise(edges)) >= least:
                    ssr = sum(((x[a:b] - x[a:b].mean()) ** 2).sum() for a, b in itertools.pairwise(edges))
                    best.append((n * math.log(ssr / n) + (2 * m + 1) * math.log(n), m, list(cuts)))
        assert roots.break_points(x) == min(best)[2]
    assert roots.break_points(np.zeros(3)) == []


def test_diagnostics_and_path(spark):
    random = np.random.default_rng(9)
    x = np.zeros(400)
    for t in range(1, 400):
        x[t] = 0.9 * x[t - 1] + random.normal()
    days = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(400)]
    rows = pd.concat([pd.DataFrame({"series": "a", "dt": days, "x": x}), pd.DataFrame({"series": "few", "dt": days[:9], "x": x[:9]}), pd.DataFrame({"series": "step", "dt": days, "x": x * 0.1 + (np.arange(400) > 250) * 9})])
    df = spark.createDataFrame(rows, "series string, dt date, x double").repartition(3)
    out = {r.series: r for r in roots.reversion_diagnostics(df, "x").collect()}

    def theta(v):
        slope, _ = np.polyfit(v[:-1], v[1:], 1)
        n, slope = len(v) - 1, min(max(slope, 1e-6), 0.999)
        more = (1 + 3 * slope) / n
        return -math.log(min(max(slope + more + (3 * more / n if slope > 0.95 else 0), 0), 0.999))

    past = [theta(x[i - 60 : i]) for i in range(60, 400)]
    a = out["a"]
    assert abs(a.theta - theta(x)) < 1e-9 and abs(a.theta_now - past[-1]) < 1e-9 and abs(a.theta_spread - np.std(past)) < 1e-9
    assert a.adf_p < 0.05 and a.n == 400 and abs(a.half_life - math.log(2) / theta(x)) < 1e-6 and a.last == x[-1]
    assert out["few"].adf_p == 1 and out["few"].theta == 0.05
    path = {(r.series, r.step): r for r in roots.reverting_path(roots.reversion_diagnostics(df, "x"), 5).collect()}
    for step in (1, 5):
        r = path["a", step]
        want = [a.mu + (x[-1] - a.mu) * math.exp(-k * step) for k in (past[-1], past[-1] + np.std(past), past[-1] - np.std(past))]
        np.testing.assert_allclose([r.mean, r.low, r.high], want, rtol=1e-9)
    found = roots.breaks(df, "x").collect()
    assert any(r.series == "step" and abs(r.place - 251) <= 2 and r.after - r.before > 7 and r.dt == days[r.place] for r in found) and not any(r.series == "few" for r in found)
    gated = {r.series: r.hurst for r in roots.gated_hurst(spark.createDataFrame([("a", 0.3), ("step", 0.9)], "series string, hurst double"), roots.reversion_diagnostics(df, "x")).collect()}
    assert gated["a"] == 0.3 and gated["few"] == 0.5


def test_sliding_quantiles(spark):
    random = np.random.default_rng(3)
    x = np.round(random.normal(size=1500), 2)
    x[random.random(1500) < 0.1] = np.nan
    df = spark.createDataFrame([("s", int(k), None if v != v else float(v)) for k, v in enumerate(x)], "series string, dt long, x double")
    rows = sliding.quantiles(df, "x", 1000, {"a": 0.025, "b": 0.5}).orderBy("dt").collect()
    for t in (0, 1, 7, 600, 1000, 1001, 1499):
        own = x[max(0, t - 1000) : t]
        own = own[~np.isnan(own)]
        assert rows[t]["count"] == len(own)
        if len(own):
            np.testing.assert_allclose([rows[t].a, rows[t].b], np.quantile(own, [0.025, 0.5]), rtol=1e-12)
