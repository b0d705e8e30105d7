"""Streams in several micro-batches beside the batch operators."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import folds
from tidemark.streaming import stateful


@pytest.fixture(scope="module")
def rows() -> pd.DataFrame:
    rng = np.random.default_rng(8)
    days = [dt.datetime(2024, 1, 1) + dt.timedelta(days=k) for k in range(30)]
    return pd.DataFrame([(s, d, float(v), float(c)) for s in "ab" for d, v, c in zip(days, 100 + np.cumsum(rng.normal(0, 1, 30)), rng.normal(0, 1, 30), strict=True)], columns=["series", "dt", "px", "call"])


def streamed(spark, rows: pd.DataFrame, make, tmp_path, name: str, cuts: tuple[int, ...] = (10, 20, 30)) -> pd.DataFrame:
    """make over rows that arrive by day in several batches."""
    folder, start = tmp_path / name, 0
    days = sorted(rows["dt"].unique())
    for k, end in enumerate(cuts):
        part = spark.createDataFrame(rows[rows["dt"].isin(days[start:end])])
        part.coalesce(1).write.mode("append").parquet(str(folder / f"{k}"))
        start = end
    stream = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
    run = make(stream).writeStream.outputMode("append").format("memory").queryName(name).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}-state")).start()
    run.awaitTermination()
    return spark.table(name).toPandas()


def test_drift_filter(spark, rows, tmp_path):
    got = streamed(spark, rows, lambda s: stateful.drift_filter(s, "px"), tmp_path, "drift").sort_values(["series", "dt"])
    want = folds.drift_filter(spark.createDataFrame(rows), "px").toPandas().sort_values(["series", "dt"])
    np.testing.assert_allclose(got[["level", "variance"]], want[["level", "variance"]])


def test_delayed_labels(spark, rows, tmp_path):
    got = streamed(spark, rows, lambda s: stateful.delayed_labels(s, "call", "px", 5), tmp_path, "labels").sort_values(["series", "dt"])
    for series, own in rows.groupby("series"):
        mine = got[got["series"] == series]
        np.testing.assert_allclose(mine["call"], own["call"][:-5])
        np.testing.assert_allclose(mine["outcome"], own["px"].to_numpy()[5:] / own["px"].to_numpy()[:-5] - 1)
        assert (mine["resolved"].to_numpy() > mine["dt"].to_numpy()).all()


def test_discounted_skill(spark, rows, tmp_path):
    rows = rows.assign(outcome=rows["px"].diff().fillna(0.0))
    got = streamed(spark, rows, lambda s: stateful.discounted_skill(s, "call", "outcome"), tmp_path, "skill").sort_values(["series", "dt"])
    want = folds.discounted_skill(spark.createDataFrame(rows), "call", "outcome").toPandas().sort_values(["series", "dt"])
    np.testing.assert_allclose(got[["agreement", "n_effective"]], want[["agreement", "n_effective"]])


def test_settled_days_and_last_rows(spark, rows, tmp_path):
    days = streamed(spark, rows, stateful.settled, tmp_path, "settled")
    assert 2 * 25 <= len(days) < 60 and (days["n"] == 1).all()  # the newest days may still change
    twice = pd.concat([rows, rows.assign(px=rows["px"] + 1, dt=rows["dt"] + dt.timedelta(minutes=5))])
    last = streamed(spark, twice, lambda s: stateful.keep_last(s, ["series"], "dt"), tmp_path, "last", (20, 40, 60))
    assert len(last) > 40 and set(last["dt"].dt.minute) == {5}


def test_expired_series(spark, rows, tmp_path):
    own = rows[(rows["series"] == "a") | (rows["dt"] < dt.datetime(2024, 1, 8))]
    got = streamed(spark, own, lambda s: stateful.expired(s, 10), tmp_path, "expired")
    assert got["series"].tolist() == ["b"] and got["newest"].iloc[0] == pd.Timestamp("2024-01-07")
