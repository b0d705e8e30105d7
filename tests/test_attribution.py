"""Parts of instruments add up: to factors' levels, to blocks' levels, and to the fair value."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import QUERIES

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sums(spark):
    return {name: QUERIES[name](spark, D) for name in ("r14_attribution", "r14_panel_factors", "r15_attribution", "r15_block_levels", "r18_attribution", "r18_fair_value")}


def test_factors(sums):
    parts = sums["r14_attribution"].groupBy("dt", "factor").agg(F.sum("part").alias("level"))
    want = sums["r14_panel_factors"].select("dt", F.posexplode("levels").alias("factor", "want"))
    rows = want.join(parts, ["dt", "factor"], "left").join(parts.select("dt").distinct(), "dt", "left_semi").collect()
    assert len(rows) > 1000 and all(abs((r.level or 0.0) - r.want) < 1e-9 for r in rows) and max(abs(r.want) for r in rows) > 1


def test_blocks(sums):
    parts = sums["r15_attribution"]
    days = sums["r15_block_levels"].join(parts.select("block", "dt").distinct(), ["block", "dt"], "left_semi").collect()
    members = {}
    for r in parts.orderBy("dt").collect():
        members.setdefault((r.block, r.series), []).append((r.dt, r.part))
    assert len(days) > 500
    for r in days[::97]:  # each member's last part by that day
        total = sum(next((p for d, p in reversed(own) if d <= r.dt), 0.0) for (block, _), own in members.items() if block == r.block)
        assert abs(total - r.level) < 1e-9


def test_fair_value(sums):
    parts = sums["r18_attribution"].groupBy("series", "dt").agg(F.sum("part").alias("total"))
    rows = sums["r18_fair_value"].where("fitted IS NOT NULL").join(parts, ["series", "dt"]).collect()
    assert len(rows) > 10 and all(abs(r.total - r.fitted) < 1e-6 * max(1, abs(r.fitted)) for r in rows)
