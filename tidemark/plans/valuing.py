"""Queries of the valuation: volatilities, blocks, factors, hidden states and fair value."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators import folds, kernels, panel_blocks, relations, roots, segments, valuation
from tidemark.operators import windows as w
from tidemark.operators.align import ordered
from tidemark.plans.registry import BARS, LAG, PANEL, held, once, query, r
from tidemark.sources import tables as src

FLOOR, BLOCK = 60, 512


def _blocks(spark, d):
    return src.table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg(F.min("p_type").alias("block"))


def _panel(spark, d):
    return src.panel_daily(spark, d)


@query()
def r10_standardised_returns(spark, d):
    return valuation.standardised(_panel(spark, d), FLOOR)


@query()
def r15_block_levels(spark, d):
    return valuation.block_levels(valuation.standardised(_panel(spark, d), FLOOR), _blocks(spark, d))


@query()
def r15_levels_in_segments(spark, d):
    """r15 with each block's days in segments."""
    means = valuation.standardised(_panel(spark, d), FLOOR).join(_blocks(spark, d), "series").groupBy("block", "dt").agg(F.avg("z").alias("z"))
    return segments.levels(means, "z", BLOCK, "block")


@query()
def w24_mean_breaks(spark, d):
    """Breaks of the mean of each block's level, their number by a criterion."""
    levels = r15_block_levels(spark, d).select(F.col("block").alias("series"), "dt", "level")
    return roots.breaks(levels, "level")


def _rows(spark, d):
    return held(spark, d, "standardised", lambda: valuation.standardised(_panel(spark, d), FLOOR, with_return=True))


def _panel_run(spark, d) -> panel_blocks.Panel:
    return once(spark, d, "panel", lambda: panel_blocks.Panel(_rows(spark, d), block=BLOCK))


def _factors(spark, d):
    return held(spark, d, "factors", _panel_run(spark, d).levels)


def _value(spark, d):
    return held(spark, d, "value", lambda: valuation.fair_value(_rows(spark, d), _factors(spark, d), src.target_daily(spark, d), _blocks(spark, d)))


@query()
def r14_panel_factors(spark, d):
    return _factors(spark, d).select("dt", "levels", "k")


def _factor_parts(spark, d):
    return held(spark, d, "factor_parts", _panel_run(spark, d).parts)


def _block_parts(spark, d):
    return held(spark, d, "block_parts", lambda: panel_blocks.block_parts(_rows(spark, d), _blocks(spark, d), BLOCK))


@query()
def r14_attribution(spark, d):
    """What each instrument has added to each factor's level, every 21st day."""
    return _factor_parts(spark, d)


@query()
def r15_attribution(spark, d):
    """What each member has added to its block's level."""
    return _block_parts(spark, d)


@query()
def r18_attribution(spark, d):
    """What each instrument adds to the fair value, every 21st day; the rest is the constant's."""
    return valuation.attribution(_value(spark, d), _factor_parts(spark, d), _block_parts(spark, d), _blocks(spark, d), kernels.MOST_FACTORS)


@query()
def r16_market_regimes(spark, d):
    """Hidden states of the market factor and its volatility, and the rank of that volatility."""
    return valuation.market(_factors(spark, d))


@query()
def r18_ranks(spark, d):
    """The fair value's gap, dispersion and stress ranked among the past, with the market's states."""
    return valuation.with_ranks(_value(spark, d), _rows(spark, d), _factors(spark, d)).drop("importance")


@query()
def r16_hidden_regimes(spark, d):
    """Chains over each series' return and the log of its 20-row volatility."""
    rows = _panel(spark, d).withColumn("ret", F.log("px") - F.lag(F.log("px")).over(ordered()))
    rows = rows.withColumn("logvol", F.log(F.greatest(F.stddev_samp("ret").over(w.trailing(20)), F.lit(1e-8))))
    return kernels.hidden_rows(rows, "ret", "logvol")


@query()
def r18_fair_value(spark, d):
    return _value(spark, d)


@query()
def d06_valuation_by_block(spark, d):
    """How much of the fair value rests on each block, in per cent, every 21st row."""
    rows = r18_fair_value(spark, d).where("importance IS NOT NULL").withColumn("_k", F.row_number().over(ordered()) - 1).where("_k % 21 = 0")
    names = _blocks(spark, d).select("block").distinct().agg(F.array_sort(F.collect_set("block")).alias("names"))
    return rows.join(names).select("dt", F.inline(F.arrays_zip(F.col("names").alias("block"), F.transform("importance", lambda x: 100 * x).alias("share"))))


@query()
def a27_importance(spark, d):
    """How far the fair value moves without each block, as a share of its date's, the greatest first."""
    names = _blocks(spark, d).select("block").distinct().agg(F.array_sort(F.collect_set("block")).alias("names"))
    rows = _value(spark, d).where("importance IS NOT NULL").join(names)
    rows = rows.select("dt", F.inline(F.arrays_zip(F.col("names").alias("series"), F.col("importance").alias("x"))))
    return relations.importance(rows)


MOMENTS = f"""WITH RECURSIVE {BARS}, k AS (SELECT series, dt, close AS x, row_number() {LAG} AS k FROM bars),
e(series, k, dt, x, w, m, s) AS (SELECT series, k, dt, x, 1.0::DOUBLE, x, 0.0::DOUBLE FROM k WHERE k = 1 UNION ALL
SELECT k.series, k.k, k.dt, k.x, 0.5^(1/20.0) * w + 1, m + (k.x - m) / (0.5^(1/20.0) * w + 1), 0.5^(1/20.0) * s + (k.x - m)^2 * 0.5^(1/20.0) * w / (0.5^(1/20.0) * w + 1) FROM k JOIN e ON k.series = e.series AND k.k = e.k + 1)
SELECT series, dt, {r('m', 5)} AS mean, {r('s / w', 4)} AS variance FROM e"""


@query(MOMENTS)
def r03_discounted_moments(spark, d):
    out = folds.discounted_moments(src.bars_hourly(spark, d), "close", 20.0)
    return out.select("series", "dt", fixed(F.col("mean"), 5).alias("mean"), fixed(F.col("variance"), 4).alias("variance"))


@query(MOMENTS)
def r03_moments_in_segments(spark, d):
    out = segments.in_segments(src.bars_hourly(spark, d), ["close"], segments.moments_fold(20.0), 96 * 3600)
    return out.select("series", "dt", fixed(F.col("mean"), 5).alias("mean"), fixed(F.col("variance"), 4).alias("variance"))


AR1 = f"""WITH RECURSIVE {PANEL}, k AS (SELECT series, dt, ln(px) AS x, lag(ln(px)) {LAG} AS b, row_number() {LAG} AS k FROM panel),
e(series, k, dt, w, sb, sx, sbb, sbx) AS (SELECT series, k, dt, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM k WHERE k = 1 UNION ALL
SELECT k.series, k.k, k.dt, 0.5^(1/60.0) * w + 1, 0.5^(1/60.0) * sb + b, 0.5^(1/60.0) * sx + x, 0.5^(1/60.0) * sbb + b * b, 0.5^(1/60.0) * sbx + b * x FROM k JOIN e ON k.series = e.series AND k.k = e.k + 1)
SELECT series, dt, {r('CASE WHEN k > 8 AND w >= 4 THEN (sbx - sb * sx / w) / (sbb - sb * sb / w + 1e-8) END', 4)} AS phi FROM e"""


@query(AR1)
def r04_forgetting_ar1(spark, d):
    out = folds.forgetting_ar1(_panel(spark, d).withColumn("x", F.log("px")), "x", 60.0)
    return out.select("series", "dt", fixed(F.col("phi"), 4).alias("phi"))


@query(AR1)
def r04_ar1_in_segments(spark, d):
    out = segments.in_segments(_panel(spark, d).withColumn("x", F.log("px")), ["x"], segments.ar1_fold(60.0), BLOCK)
    return out.select("series", "dt", fixed(F.col("phi"), 4).alias("phi"))
