"""Factors of a panel in blocks of days equal the one-pass kernel."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import kernels, panel_blocks


def panel(seed: int, n_days: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    common = random.normal(size=(n_days, 2)) * np.where(np.arange(n_days) % 200 < 100, 1.5, 0.4)[:, None]
    z = common @ random.normal(size=(2, n)) + random.normal(size=(n_days, n))
    z[random.random(z.shape) < 0.15] = np.nan
    z[: n_days // 3, 0] = np.nan  # a young instrument
    z[:4, 1:] = np.nan
    z[50:53] = np.nan  # days without anything
    return z, np.nan_to_num(z) * 0.01


@pytest.mark.parametrize(("n_days", "n", "block"), [(300, 6, 64), (120, 5, 200)])
def test_blocks(spark, n_days, n, block):
    z, ret = panel(n, n_days, n)
    days = [dt.date(2020, 1, 1) + dt.timedelta(int(k)) for k in range(n_days)]
    rows = pd.DataFrame({"series": np.tile([f"s{k}" for k in range(n)], n_days), "dt": np.repeat(days, n), "z": z.ravel(), "ret": ret.ravel()})
    df = spark.createDataFrame(rows, "series string, dt date, z double, ret double").repartition(4)
    got = panel_blocks.panel_factors(df, block=block).toPandas().sort_values("dt")
    want = kernels.factor_levels(z, np.isfinite(z))
    assert len(got) == n_days and (got["k"].to_numpy() == want["k"]).all()
    np.testing.assert_allclose(np.array(got["levels"].tolist()), want["levels"], atol=1e-9)
    assert len(set(want["k"])) > 1
    assert got["explained"].between(0, 1).all() and got["explained"].iloc[-1] > 0.2 and set(got["memory"]) <= set(kernels.MEMORY_LIVES) and got["t_eff"].iloc[-1] > 20
    # The market: its first known factor's portfolio; the mean before there is one
    seen = np.isfinite(z)
    assert abs(got["market"].iloc[4] - ret[4][seen[4]].mean()) < 1e-12 and np.isfinite(got["market"]).all()


def test_market_by_a_loop(spark):
    """The portfolio of the memory that was best the day before."""
    z, ret = panel(3, 130, 6)
    days = [dt.date(2021, 1, 1) + dt.timedelta(int(k)) for k in range(130)]
    rows = pd.DataFrame({"series": np.tile([f"s{k}" for k in range(6)], 130), "dt": np.repeat(days, 6), "z": z.ravel(), "ret": ret.ravel()})
    got = panel_blocks.panel_factors(spark.createDataFrame(rows, "series string, dt date, z double, ret double"), lives=(126.0,), block=64).toPandas().sort_values("dt")["market"].to_numpy()
    memory, known, want = kernels.CorrelationMemory(6, 126.0), np.zeros(6, bool), []
    for x, r in zip(z, ret, strict=True):
        mask = np.isfinite(x)
        if memory.vectors.shape[1] and mask.any():
            part = memory.vectors[:, 0] * mask
            want.append(r @ part / np.abs(part).sum())
        else:
            want.append(r[mask].mean() if mask.any() else 0.0)
        known |= mask
        memory.absorb(np.where(mask, np.clip(np.nan_to_num(x), -6, 6), 0.0), mask.astype(float), known)
    np.testing.assert_allclose(got, want, atol=1e-9)
