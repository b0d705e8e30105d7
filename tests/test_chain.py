"""The valuation's ranks and market states beside plain loops, and the reads of a verdict."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import scores, stats, valuation

DAYS = [dt.date(2020, 1, 1) + dt.timedelta(k) for k in range(700)]


def rank(x, before):
    return (0.5 * sum(b < x for b in before) + 0.5 * sum(b <= x for b in before) + 0.5) / (len(before) + 1) if before else 0.5


def test_market(spark):
    random = np.random.default_rng(1)
    g = random.normal(size=len(DAYS)) * np.where(np.arange(len(DAYS)) // 100 % 2, 0.03, 0.01)
    rows = valuation.market(spark.createDataFrame(pd.DataFrame({"dt": DAYS, "market": g}), "dt date, market double").repartition(3)).toPandas().sort_values("dt")
    keep, past, logs = 2 ** (-1 / 42), [], []
    for t in range(len(DAYS)):
        w = keep ** np.arange(t - 1, -1, -1)
        # The recursion of means leaves, after each step, the weighted variance about the weighted mean
        sd = math.sqrt((w * (g[:t] - (w * g[:t]).sum() / w.sum()) ** 2).sum() / w.sum()) if t else 0.0
        logs.append(math.log(max(sd, 1e-8)))
        want = rank(logs[-1], past) if t > 60 else math.nan
        past.append(logs[-1])
        if t > 300 and t % 97 == 0:
            assert abs(rows["stress_rank"].iloc[t] - want) < 2e-3  # ties of rounding move a rank by one place
    assert rows["stress_rank"].iloc[:61].isna().all() and rows["stress_rank"].iloc[61:].notna().all()
    assert rows["label"].iloc[:60].eq("initialising").all() and rows["stress"].iloc[60:].between(0, 1).all()
    late = rows.iloc[300:]
    assert late[late["dt"].isin([d for k, d in enumerate(DAYS) if k // 100 % 2 and k % 100 > 50])]["stress"].mean() > late[late["dt"].isin([d for k, d in enumerate(DAYS) if not k // 100 % 2 and k % 100 > 50])]["stress"].mean()


def test_dispersion_and_gap_ranks(spark):
    random = np.random.default_rng(2)
    z = random.normal(size=(60, 7)) * random.random((60, 1))
    z[10, 2:] = np.nan
    rows = pd.DataFrame({"series": np.tile(list("abcdefg"), 60), "dt": np.repeat(DAYS[:60], 7), "z": z.ravel()})
    df = spark.createDataFrame([(r.series, r.dt, None if r.z != r.z else float(r.z)) for r in rows.itertuples()], "series string, dt date, z double")
    got = {r.dt: r for r in valuation.dispersion(df).collect()}
    before = []
    for k in range(60):
        own = z[k][np.isfinite(z[k])]
        if len(own) < 5:
            assert DAYS[k] not in got
            continue
        assert abs(got[DAYS[k]].dispersion - own.std()) < 1e-12 and abs(got[DAYS[k]].dispersion_rank - rank(own.std(), before)) < 1e-12
        before.append(own.std())


def test_reads_as_seen_from_the_call(spark):
    rows = [("long", -1.0, 0.4, -0.3, 0.7), ("short", 1.0, 0.4, -0.3, 0.7), ("none", 0.2, -0.4, 0.3, 0.7)]
    out = {r.k: r for r in scores.aligned_reads(spark.createDataFrame(rows, "k string, oscillator double, net double, consensus double, up_share double")).collect()}
    assert [(round(r.net_breadth, 9), round(r.consensus, 9), round(r.precedent_share, 9)) for r in (out["long"], out["short"], out["none"])] == [(0.4, 0.3, 0.7), (-0.4, -0.3, 0.3), (0.4, 0.3, 0.5)]


@pytest.mark.parametrize(("value", "t"), [(2.0, math.inf), (-2.0, -math.inf), (0.0, None)])
def test_equal_outcomes(spark, value, t):
    df = spark.createDataFrame([("a", DAYS[k], -2.0, value) for k in range(4)], "series string, dt date, z double, f double")
    out = stats.signal_performance(df, "z", "f", 1, 1.0)
    row = out.withColumn("p", stats.t_p_value(out["t"], out["n"] - 1)).first()
    assert row.t == t and row.p == (None if t is None else 0.0)


def test_outputs_of_the_fair_value():
    random = np.random.default_rng(4)
    n = 420
    factors, blocks = np.cumsum(random.normal(size=(n, 3)), 0), np.cumsum(random.normal(size=(n, 2)), 0)
    price = 5 + factors[:, 0] * 0.02 + blocks[:, 1] * 0.01 + random.normal(size=n) * 0.01
    price[300] = np.nan
    out = {c: v for c, v in valuation.valued(price, factors, blocks, burn_in=60).items()}
    live = [t for t in range(60, n) if t != 300]
    assert all(out["gap"][t] is None for t in (*range(60), 300))
    w = m = 0.0
    keep = 2 ** (-1 / 252)
    for t in live:
        m, w = keep * m + (1 - keep) * out["gap"][t] ** 2, keep * w + 1 - keep
        row = np.concatenate([[1], factors[t], [1], blocks[t]])
        assert abs(np.array(out["betas"][t]) @ row - out["fitted"][t]) < 1e-9 and abs(out["gap"][t] - price[t] + out["fitted"][t]) < 1e-12
        assert abs(out["error"][t] - math.sqrt(m / w)) < 1e-12 and abs(out["mispricing"][t] - math.expm1(out["gap"][t])) < 1e-12
        assert 0 <= out["factor_share"][t] <= 1 and 1000 <= out["adaptation"][t] <= 10_000 and out["unlikeness"][t] >= 0
    assert out["error"][-1] < 0.1 and np.mean([out["low"][t] <= price[t] <= out["high"][t] for t in live[-200:]]) > 0.85
