"""Prefix invariance, direct loops beside folds and kernels, and streams beside batches."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import align, folds, freshness, kernels, precedent, regimes, scores, stats, valuation
from tidemark.operators import windows as w
from tidemark.streaming import bars


def walk(n: int, seed: int = 1) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(n)]
    return pd.DataFrame([(s, d, float(v)) for s in "ab" for d, v in zip(days, 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n))), strict=True)], columns=["series", "dt", "px"])


COLUMNS = {
    "z": lambda: w.causal_z(F.col("px"), 10),
    "mean": lambda: w.sma(F.col("px"), 5),
    "quantile": lambda: w.quantile_z(F.col("px"), 20, 5),
    "norm": lambda: w.expanding_norm(F.col("px")),
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_prefixes_keep_their_values(spark, name):
    data = walk(80)
    late = data["dt"].max() - dt.timedelta(days=20)
    whole = spark.createDataFrame(data).select("series", "dt", COLUMNS[name]().alias("v")).where(F.col("dt") <= late)
    part = spark.createDataFrame(data[data["dt"] <= late]).select("series", "dt", COLUMNS[name]().alias("v"))
    a, b = (x.toPandas().sort_values(["series", "dt"])["v"].to_numpy(float) for x in (whole, part))
    assert np.isfinite(a).sum() > 20
    np.testing.assert_allclose(a, b, rtol=1e-12)


def test_kernels_keep_prefixes():
    x = np.random.default_rng(3).normal(0, 1, 200)
    for kernel in (regimes.regimes, kernels.hidden_regimes, kernels.volatility, kernels.block_level):
        whole, part = kernel(x), kernel(x[:150])
        for c in whole:
            assert list(map(str, whole[c][:150])) == list(map(str, part[c]))
    y = np.cumsum(x) / 10
    whole, part = kernels.averaged_models(y, x[:, None]), kernels.averaged_models(y[:120], x[:120, None])
    np.testing.assert_array_equal(whole["fitted"][:120], part["fitted"])
    z = np.random.default_rng(4).normal(0, 1, (300, 8)) + np.random.default_rng(5).normal(0, 2, (300, 1))
    whole, part = kernels.factor_levels(z, np.isfinite(z)), kernels.factor_levels(z[:200], np.isfinite(z[:200]))
    np.testing.assert_array_equal(whole["levels"][:200], part["levels"])
    assert whole["k"][-1] == 1  # one common factor stands out of eight series
    made = valuation.valued(y + 5, whole["levels"][:200], whole["levels"][:200, :3], 60), valuation.valued(y[:150] + 5, whole["levels"][:150], whole["levels"][:150, :3], 60)
    assert made[0]["fitted"][:150] == made[1]["fitted"] and made[0]["importance"][:150] == made[1]["importance"]


def test_a_constant_model_is_a_regression():
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (400, 2))
    y = 3 + x @ [1.5, -2.0] + rng.normal(0, 0.1, 400)
    bank = kernels.ModelBank([1.0], 3, np.zeros(3), 1e4, 1.0)
    for row, v in zip(x, y, strict=True):
        bank.absorb(np.append(1.0, row), v)
    np.testing.assert_allclose(bank.mean[0], [3, 1.5, -2.0], atol=0.03)
    before = bank.mean.copy(), bank.dof.copy()
    bank.absorb(np.append(1.0, x[0]), np.nan)
    np.testing.assert_array_equal(bank.mean, before[0])
    np.testing.assert_array_equal(bank.dof, before[1])


def test_spectrum_of_noise_and_of_a_factor():
    rng = np.random.default_rng(11)
    noise = np.corrcoef(rng.normal(0, 1, (500, 20)), rowvar=False)
    common = np.corrcoef(rng.normal(0, 1, (500, 20)) + rng.normal(0, 1, (500, 1)), rowvar=False)
    assert kernels.clipped_spectrum(noise, 500)[1].max() < 2 and kernels.clipped_spectrum(common, 500)[1][0] > 8
    vectors, values, bulk = kernels.clipped_spectrum(common, 500)
    assert abs(values.sum() + bulk * (20 - len(values)) - 20) < 1e-9
    order, sign = kernels.aligned(-vectors, vectors)
    np.testing.assert_allclose((-vectors)[:, order] * sign, vectors)


def regime_loop(x: np.ndarray) -> list[tuple]:
    """The regime filters once more, from whole histories in plain numpy."""
    a, p, r, v, lt = 0.0, 1.0, 0.1, 0.04, 0.04
    trans = np.full((3, 3), 0.01) + np.eye(3) * 0.97
    mean, sd, share = np.array([0.6, 0, -0.6]), np.array([0.3, 0.25, 0.3]), np.array([0.33, 0.34, 0.33])
    inn, shocks, filt, states, up, down, m, s, out = [], [], [], [], 0.0, 0.0, 0.0, 1.0, []
    for t, value in enumerate(x):
        p += 0.01
        inn.append(value - a)
        g = p / (p + r)
        a, p = a + g * inn[-1], (1 - g) * p
        if len(inn) >= 5:
            r = 0.9 * r + 0.1 * np.var(inn[-20:])
        shocks.append(value - x[t - 1] if t else 0.0)
        v = np.clip(1e-4 + 0.1 * shocks[-1] ** 2 + 0.85 * v, 0.001, 1.0)
        if len(shocks) >= 10:
            lt = 0.95 * lt + 0.05 * np.var(shocks[-50:])
        wide = ["LOW", "NORMAL", "HIGH", "EXTREME"][int(np.searchsorted([0.6, 0.9, 1.4], np.sqrt(v / lt), side="right"))]
        like = np.exp(-0.5 * ((a - mean) / (sd + 1e-4)) ** 2) / ((sd + 1e-4) * np.sqrt(2 * np.pi))
        u = like * (trans.T @ share)
        share = u / u.sum() if u.sum() > 1e-10 else np.array([0.33, 0.34, 0.33])
        filt.append(a)
        states.append(int(np.argmax(share)))
        if len(filt) >= 10:
            f, q = np.array(filt[-50:]), np.array(states[-50:])
            for k in range(3):
                if (q == k).sum() >= 2:
                    mean[k], sd[k] = 0.9 * mean[k] + 0.1 * f[q == k].mean(), 0.9 * sd[k] + 0.1 * max(f[q == k].std(), 1e-4)
            mean[0], mean[2] = max(mean[0], mean[1] + 0.01), min(mean[2], mean[1] - 0.01)
        if len(states) >= 5:
            q = states[-30:]
            n = np.zeros((3, 3))
            np.add.at(n, (q[:-1], q[1:]), 1)
            for k in range(3):
                if n[k].sum() >= 2:
                    trans[k] = 0.8 * trans[k] + 0.2 * (n[k] + 1) / (n[k].sum() + 3)
        if len(filt) >= 3:
            before = np.array(filt[-21:-1])
            m, s = before.mean(), max(before.std(), 0.1)
        up, down = max(up + (a - m) / s - 0.5, 0), max(down - (a - m) / s - 0.5, 0)
        change = max(up, down) > 4
        if change:
            up = down = 0.0
        bull, bear = share[0], share[2]
        label = "TRANSITION" if change else "BULL" if bull > 0.6 else "BEAR" if bear > 0.6 else "WEAK_BULL" if bull > 0.4 else "WEAK_BEAR" if bear > 0.4 else "NEUTRAL"
        out.append((a, bull, bear, share.max(), wide, change, label))
    return out


def test_regimes_are_the_loop():
    x = np.tanh(np.cumsum(np.random.default_rng(12).normal(0, 0.15, 400)))
    made = regimes.regimes(x)
    want = regime_loop(x)
    for c, k in (("level", 0), ("bull", 1), ("bear", 2), ("confidence", 3)):
        np.testing.assert_allclose(made[c], [row[k] for row in want], atol=1e-9)
    for c, k in (("volatility", 4), ("change", 5), ("regime", 6)):
        assert list(made[c]) == [row[k] for row in want]
    assert len(set(made["regime"])) >= 4


def test_foretold_is_the_loop(spark):
    data = walk(140)
    states = precedent.states(spark.createDataFrame(data))
    got = precedent.foretold(states, 10).where("series = 'a'").toPandas().sort_values("place")
    own = states.where("series = 'a'").toPandas().sort_values("place")
    x, px = own[["momentum", "vol"]].to_numpy(float), own["px"].to_numpy()
    want, n = {}, len(own)
    for t in sorted({*range(50, n, 10), n - 1}):
        pool = [k for k in range(t + 1 - 10) if np.isfinite(x[k]).all()]
        if len(pool) < 30:
            continue
        s = np.cov(x[pool], rowvar=False)
        mu, alpha = np.trace(s) / 2, (s**2).mean()
        rho = np.clip((alpha + mu**2) / ((len(pool) + 1) * (alpha - mu**2 / 2)), 0, 1)
        inverse = np.linalg.inv((1 - rho) * s + rho * mu * np.eye(2))
        d = [float((x[k] - x[t]) @ inverse @ (x[k] - x[t])) for k in pool]
        taken = []
        for k in [pool[j] for j in np.argsort(d, kind="stable")]:
            if len(taken) < 10 and all(abs(k - j) >= 20 for j in taken):
                taken.append(k)
        want[t + 1] = np.median([(px[k + 10] / px[k] - 1) * 100 for k in taken])
    assert got["place"].tolist() == list(want)
    np.testing.assert_allclose(got["predicted"], list(want.values()))


def test_p_values():
    got = stats.t_p_values(pd.Series([2.0, -2.0, 0.0, np.inf, np.nan, 12.706]), pd.Series([10.0, 10, 5, 5, 5, 1]))
    np.testing.assert_allclose(got[:4], [0.073388, 0.073388, 1.0, 0.0], atol=1e-5)
    assert np.isnan(got[4]) and np.isnan(got[5])
    np.testing.assert_allclose(stats.t_p_values(pd.Series([2.228139, 1.959966]), pd.Series([10.0, 1e6])), [0.05, 0.05], atol=1e-4)


def test_drift_filter_is_the_loop(spark):
    data = walk(40)
    data.loc[5, "px"] = None
    out = folds.drift_filter(spark.createDataFrame(data), "px").where("series = 'a'").orderBy("dt").toPandas()
    level, variance = 0.0, 100.0
    for k, row in out.iterrows():
        x = 0.0 if np.isnan(row.px) else row.px
        if k == 0:
            level = x
        else:
            level = level * 0.97 + 0.056 * x
            variance = max(variance * 0.97 + 3 + min(abs(0.056 * x) / 2, 50), 1e-6)
        assert abs(row["level"] - level) < 1e-9 and abs(row["variance"] - variance) < 1e-9


def test_asof_and_reindex_differ_off_the_spine(spark):
    day = lambda k: dt.date(2024, 1, k)
    df = spark.createDataFrame([("a", day(1), 1.0), ("a", day(3), 3.0), ("a", day(6), 6.0)], "series string, dt date, px double")
    spine = spark.createDataFrame([(day(2),), (day(4),), (day(6),)], "dt date")
    asof = [(r.px, r.native) for r in align.asof_backward(df, spine).orderBy("dt").collect()]
    filled = [r.px for r in align.reindex_ffill(df, spine).orderBy("dt").collect()]
    assert asof == [(1.0, False), (3.0, False), (6.0, True)] and filled == [None, None, 6.0]


def test_similar_periods_lie_apart(spark):
    rows = precedent.similar_periods(precedent.states(spark.createDataFrame(walk(300))), 10, 5).toPandas()
    assert not rows["unprecedented"].all()
    for _, own in rows.groupby("series"):
        places = np.sort(own["place"].to_numpy())
        assert len(places) == 5 and np.diff(places).min() >= 20


def test_verdict_of_a_clear_case(spark):
    df = spark.createDataFrame([(-2.5, 0.9, 0.5, 0.3, 0.9, 0.2, 0.7, 20), (0.1, None, None, None, None, None, None, 0)], "oscillator double, confidence double, net_breadth double, consensus double, agreement double, ic double, precedent_share double, precedent_n int")
    clear, none = scores.verdict(df).collect()
    assert (clear.direction, clear.tier, clear.conviction) == ("LONG", "HIGH", 1.0) and (none.direction, none.tier) == ("STAND ASIDE", "NONE")


def test_stream_of_bars_is_the_batch(spark, tmp_path):
    events = bars.timed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    run = bars.hourly_bars(stream).writeStream.outputMode("append").format("memory").queryName("bars").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
    run.awaitTermination()
    batch = bars.hourly_bars(events)
    got, want = (sorted(map(tuple, x.collect()), key=repr) for x in (spark.table("bars"), batch))
    assert len(got) > 100 and set(got) <= set(want)
    assert bars.sessions(events).agg(F.sum("n_events")).first()[0] == events.count()


def test_pools_are_prefixes():
    """Running moments and pools with missing features give what each pool gives by itself."""
    random = np.random.default_rng(6)
    x = random.normal(size=(260, 4)) * [1, 5, 0.1, 30] + [0, 100, 0, -7]
    for complete in (True, False):
        if not complete:
            x[100:140, 2] = np.nan
            x[200, 3] = np.nan
        realised = random.normal(size=260)
        realised[-10:] = np.nan
        got = precedent.told_by_pools(np.arange(1, 261), x, realised, 10, 50, 20, 8)
        assert list(got) == [*range(50, 260, 10), 259]
        for t, predicted in got.items():
            pool = x[: t + 1 - 10]
            taken = precedent.apart(np.arange(len(pool)), np.argsort(precedent.nearest(pool, x[t]), kind="stable"), 20, 8)
            assert abs(predicted - np.median(realised[taken])) < 1e-12


def test_mean_breaks_of_a_long_series(spark):
    """Three picks by a plain loop over 20,000 days, in time that follows the days and not their square."""
    import time

    n = 20_000
    x = np.cumsum(np.random.default_rng(4).normal(size=n)) + 1000
    day = dt.date(1960, 1, 1)
    df = spark.createDataFrame([("a", day + dt.timedelta(days=k), float(v)) for k, v in enumerate(x)], "series string, dt date, px double")
    begun = time.time()
    got = sorted(r.place for r in freshness.mean_breaks(df).collect())
    assert time.time() - begun < 30
    edge = window = int(n * 0.15)
    moves = np.zeros(n - 1)
    k = np.arange(max(edge, window - 1), n - 1 - edge)
    moves[k] = np.abs(x[k + 1] - x[k + 1 - window]) / window
    want = []
    for _ in range(3):
        at = int(np.argmax(moves))
        if moves[at] > 0:
            want.append(at + 1)
            moves[max(at - window, 0) : at + window] = 0
    assert got == sorted(want)
