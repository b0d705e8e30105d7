"""Typed state: rows in any order within the allowed lateness, batch then stream, floors, and labels by an interval join."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import folds, segments
from tidemark.streaming import typed

DAY = dt.timedelta(days=1)
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    random = np.random.default_rng(5)
    out = pd.DataFrame([(s, START + k * DAY, float(v)) for s in "ab" for k, v in enumerate(100 + np.cumsum(random.normal(size=40)))], columns=["series", "dt", "px"])
    out.loc[out.index % 11 == 3, "px"] = np.nan
    return out


def feed(spark, parts: list[pd.DataFrame], folder):
    """A stream that takes one part a batch."""
    for k, part in enumerate(parts):
        plain = [(r.series, r.dt.to_pydatetime(), None if r.px != r.px else float(r.px)) for r in part.itertuples()]
        spark.createDataFrame(plain, "series string, dt timestamp, px double").coalesce(1).write.parquet(str(folder / f"{k}"))
    files = spark.readStream.schema("series string, dt timestamp, px double").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True)
    return files.parquet(str(folder))


def flush(days: int = 400) -> pd.DataFrame:
    """Rows that push the watermark on."""
    return pd.DataFrame([("z", START + days * DAY, 0.0)], columns=["series", "dt", "px"])


@pytest.mark.parametrize(("fold", "batch", "columns"), [
    (segments.drift_fold(), lambda df: folds.drift_filter(df, "px"), ["level", "variance"]),
    (segments.moments_fold(20.0), lambda df: folds.discounted_moments(df, "px", 20.0), ["mean", "variance"]),
    (segments.ar1_fold(20.0), lambda df: folds.forgetting_ar1(df, "px", 20.0), ["phi", "se"]),
])
def test_any_order_within_the_lateness(spark, rows, tmp_path, fold, batch, columns):
    days = (rows["dt"] - START).dt.days
    jumbled = [rows[days // 10 == k] for k in range(4)]
    moved = rows[(days % 10 == 9) & (days < 39)]  # a day late, with the next ten
    jumbled = [pd.concat([p.drop(moved.index, errors="ignore"), moved[((moved["dt"] - START).dt.days + 1) // 10 == k]]).sample(frac=1, random_state=1) for k, p in enumerate(jumbled)]
    too_late = rows[:1].assign(px=-1e6)
    stream = feed(spark, [*jumbled, pd.concat([flush(300), too_late]), flush()], tmp_path / "in")
    got = typed.run_once(typed.absorbed(stream, ["px"], fold, "3 days", floor=12), str(tmp_path / "out")).toPandas()
    got = got[got["series"] != "z"].sort_values(["series", "dt"]).reset_index(drop=True)
    want = batch(spark.createDataFrame(rows)).toPandas().sort_values(["series", "dt"]).reset_index(drop=True)
    assert (got[["series", "dt"]] == want[["series", "dt"]]).all().all() and len(got) == 80
    np.testing.assert_allclose(got[columns].astype(float), want[columns].astype(float), rtol=1e-9)
    prints = rows.sort_values(["series", "dt"])["px"].notna().groupby(rows["series"]).cumsum().to_numpy()
    assert (got["n"].to_numpy() == prints).all() and (got["admitted"] == (prints >= 12)).all()
    state = spark.read.format("statestore").option("path", str(tmp_path / "out" / "state")).option("stateVarName", "state").load().collect()
    held = {r.key.series: r.value for r in state}
    x = rows[rows["series"] == "a"]["px"].to_numpy()
    np.testing.assert_allclose(held["a"].state, fold.after(fold.start, fold.passed(x)), rtol=1e-9)
    assert held["a"].newest == int(pd.Timestamp(START + 39 * DAY).value // 1000)


def test_batch_then_stream(spark, rows, tmp_path):
    fold, early = segments.ar1_fold(30.0), rows["dt"] < START + 17 * DAY
    start = typed.end_states(spark.createDataFrame(rows[early]), ["px"], fold)
    stream = feed(spark, [rows[~early], flush(300), flush()], tmp_path / "in")
    got = typed.run_once(typed.absorbed(stream, ["px"], fold, "2 days", start=start), str(tmp_path / "out")).toPandas()
    got = got[got["series"] != "z"].sort_values(["series", "dt"])
    want = folds.forgetting_ar1(spark.createDataFrame(rows), "px", 30.0).toPandas().sort_values(["series", "dt"])
    want = want[want["dt"] >= START + 17 * DAY]
    np.testing.assert_allclose(got[["phi", "se"]].astype(float), want[["phi", "se"]].astype(float), rtol=1e-9)
    assert got[got["series"] == "a"]["n"].max() == rows[rows["series"] == "a"]["px"].notna().sum()


def test_labels_by_an_interval_join(spark, rows, tmp_path):
    own = rows.assign(px=rows["px"].fillna(1.0))
    prices = own[(own["dt"] - START).dt.days % 13 != 7]  # some calls have no price to meet
    calls = feed(spark, [own, flush(300), flush()], tmp_path / "calls").selectExpr("series", "dt", "px", "px * 2 AS call")
    stream = typed.labelled(calls, feed(spark, [prices, flush(300), flush()], tmp_path / "prices"), "5 days", "1 day")
    got = typed.run_once(stream, str(tmp_path / "out")).toPandas()
    got = got[got["series"] != "z"].sort_values(["series", "dt"]).reset_index(drop=True)
    later = {(r.series, r.dt): r.px for r in prices.itertuples()}
    want = [later.get((r.series, r.dt + 5 * DAY), np.nan) / r.px - 1 for r in own.sort_values(["series", "dt"]).itertuples()]
    assert len(got) == 80 and got["resolved"].isna().sum() == np.isnan(want).sum() > 10
    np.testing.assert_allclose(got["outcome"].astype(float), want)


def test_rows_wait_in_packs(spark, rows, tmp_path):
    """Rows that came together wait as one value; of equal times the last that came counts."""
    early = rows.assign(px=-7.0)
    stream = feed(spark, [early, rows, flush(20)], tmp_path / "in")
    typed.run_once(typed.absorbed(stream, ["px"], segments.drift_fold(), "3000 days"), str(tmp_path / "out"))
    state = spark.read.format("statestore").option("path", str(tmp_path / "out" / "state")).option("stateVarName", "waiting").load()
    assert state.where("key.series <> 'z'").count() == 4  # two packs a series
    stream = feed(spark, [early, rows, flush(300), flush()], tmp_path / "in2")
    got = typed.run_once(typed.absorbed(stream, ["px"], segments.drift_fold(), "100 days"), str(tmp_path / "out2")).toPandas()
    got = got[got["series"] != "z"].sort_values(["series", "dt"])
    want = folds.drift_filter(spark.createDataFrame(rows), "px").toPandas().sort_values(["series", "dt"])
    assert len(got) == 80
    np.testing.assert_allclose(got[["level", "variance"]].astype(float), want[["level", "variance"]].astype(float), rtol=1e-9)
