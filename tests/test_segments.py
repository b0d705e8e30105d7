"""Recursions in segments equal one pass over the whole series."""

import datetime as dt
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import folds, kernels, segments


@pytest.fixture(scope="module")
def long_series(spark):
    """A long series with gaps, nulls and ties, a short one and one without a value."""
    random = np.random.default_rng(2)
    at = np.flatnonzero(random.random(9000) < 0.9)
    x = np.round(np.cumsum(random.normal(size=len(at))) / 3, 1)
    x[random.random(len(at)) < 0.1] = np.nan
    x[:3] = np.nan
    rows = pd.concat([pd.DataFrame({"series": "long", "dt": at, "x": x}), pd.DataFrame({"series": "short", "dt": [5, 9000], "x": [1.0, 2.0]}), pd.DataFrame({"series": "void", "dt": [1, 2], "x": [np.nan, np.nan]})])
    return spark.createDataFrame(rows, "series string, dt long, x double").repartition(4)


def both(one, two, columns):
    one, two = (d.toPandas().sort_values(["series", "dt"]).reset_index(drop=True) for d in (one, two))
    assert (one[["series", "dt"]] == two[["series", "dt"]]).all().all()
    for c in columns:
        np.testing.assert_allclose(one[c].astype(float), two[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_folds(long_series):
    df = long_series
    both(folds.drift_filter(df, "x"), segments.in_segments(df, ["x"], segments.drift_fold(), 700), ["level", "variance"])
    both(folds.ewm(df, "x", 0.1), segments.in_segments(df, ["x"], segments.mean_fold(0.1), 700), ["mean"])
    both(folds.discounted_moments(df, "x", 50.0), segments.in_segments(df, ["x"], segments.moments_fold(50.0), 700), ["mean", "variance"])
    both(folds.forgetting_ar1(df, "x", 80.0), segments.in_segments(df, ["x"], segments.ar1_fold(80.0), 700), ["phi", "se"])
    both(folds.along(df, ["x"], kernels.block_level, "level double"), segments.levels(df, "x", 700), ["level"])


def test_other_orders(spark):
    day = dt.date(2024, 1, 1)
    rows = [("a", day + dt.timedelta(k), dt.datetime(2024, 1, 1) + dt.timedelta(hours=k), float(k % 7)) for k in range(300)]
    df = spark.createDataFrame(rows, "series string, dt date, at timestamp, x double")
    both(folds.ewm(df, "x", 0.2), segments.in_segments(df, ["x"], segments.mean_fold(0.2), 40), ["mean"])
    hours = df.drop("dt").withColumnRenamed("at", "dt")
    both(folds.ewm(hours, "x", 0.2), segments.in_segments(hours, ["x"], segments.mean_fold(0.2), 40 * 3600), ["mean"])


def test_ranks(long_series):
    got = {(r.series, r.dt): (r.below, r.same, r.n) for r in segments.ranks(long_series, "x", 700).collect()}
    rows = sorted((r.series, r.dt, r.x) for r in long_series.collect() if r.x is not None and r.x == r.x)
    want = {}
    for name in ("long", "short"):
        before = []
        for _, at, x in [r for r in rows if r[0] == name]:
            want[name, at] = (sum(b < x for b in before), before.count(x), len(before))
            before.append(x)
    assert got == want
    both(folds.expanding_cdf(long_series, "x", "p").join(long_series.where("x IS NOT NULL AND NOT isnan(x)").select("series", "dt"), ["series", "dt"]), segments.expanding_cdf(long_series, "x", "p", 700), ["p"])


def test_earlier_values_by_bisection():
    x = np.random.default_rng(1).integers(0, 9, 777).astype(float)
    below, same = segments.earlier(x)
    for t in range(len(x)):
        before = sorted(x[:t])
        assert below[t] == bisect_left(before, x[t]) and below[t] + same[t] == bisect_right(before, x[t])
    assert segments.earlier(np.zeros(0))[0].size == 0


@pytest.mark.parametrize("most", [1, 300, 2000])
def test_ranks_in_runs_of_segments(spark, long_series, monkeypatch, most):
    """Runs of one segment, of several sparse ones, and a series in two parts far apart."""
    monkeypatch.setattr("tidemark.operators.segments.RUN_ROWS", most)
    test_ranks(long_series)
    far = [("far", t, float(t * 37 % 11)) for t in [*range(400), *range(10**9, 10**9 + 400)]] + [(None, 3, 1.0), (None, 2, 1.0)]
    got = {(r.series, r.dt): (r.below, r.same, r.n) for r in segments.ranks(spark.createDataFrame(far, "series string, dt long, x double"), "x", 50).collect()}
    x = [v for s, _, v in far if s]
    assert got == {(s, t): (sum(b < v for b in x[:k]), x[:k].count(v), k) for k, (s, t, v) in enumerate(far) if s} | {(None, 2): (0, 0, 0), (None, 3): (0, 1, 1)}


def test_short_series_are_ranked_without_a_call_each(spark, monkeypatch):
    """Many short series with wide gaps: as many calls as batches of rows, not as segments."""
    calls = spark.sparkContext.accumulator(0)
    plain = segments.earlier_segments
    monkeypatch.setattr(segments, "earlier_segments", lambda *a: (calls.add(1), plain(*a))[1])
    df = spark.range(3000).selectExpr("id % 300 AS series", "id * 1000 AS dt", "CAST(id * 7919 % 101 AS double) AS x")
    assert segments.ranks(df, "x", 700).count() == 3000 and 0 < calls.value <= 12
