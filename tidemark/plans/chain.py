"""One chain from the panel to the verdict: fair value, its gap's zones, convergence with breadth, precedent, gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as fn
from tidemark.functions.scalar import fixed
from tidemark.operators import learning, precedent, relations, roots, scores, stats
from tidemark.operators import windows as w
from tidemark.plans.catalogue import a01_weighted_breadth
from tidemark.plans.learning import lookbacks
from tidemark.plans.registry import held, query
from tidemark.plans.valuing import _factors, _rows, _value
from tidemark.operators import valuation
from tidemark.sources import tables as src

HORIZONS = (5, 10, 20)


def _ranked(spark, d):
    return held(spark, d, "ranked", lambda: valuation.with_ranks(_value(spark, d), _rows(spark, d), _factors(spark, d)))


def _gap(spark, d):
    return _value(spark, d).where("gap IS NOT NULL").select("series", "dt", "gap")


def _zones(spark, d):
    """(series, dt, z5, z10, z60, oversold, overbought, conviction, mean_z) of the gap."""
    return held(spark, d, "gap_zones", lambda: scores.lookback_breadth(lookbacks(_gap(spark, d), "gap"), ["z5", "z10", "z60"]))


@query()
def d07_gap_zones(spark, d):
    """Zones and crossings of the gap against each lookback."""
    wide, each = _zones(spark, d), []
    for n in (5, 10, 60):
        z = F.col(f"z{n}")
        buy, sell = w.crossings(z)
        wide = wide.withColumns({f"_b{n}": buy, f"_s{n}": sell})
        each.append(F.struct(F.lit(str(n)).alias("lookback"), z.alias("z"), fn.zone(z).alias("zone"), F.col(f"_b{n}").alias("buy"), F.col(f"_s{n}").alias("sell")))
    return wide.select("dt", F.inline(F.array(*each)))


@query()
def d10_gap_signals(spark, d):
    """Signal, strength and confidence of the gap, with the fair value, band, conviction and what the reversion tests say."""
    value = _ranked(spark, d).select("dt", "fitted", "gap", "oscillator", "low", "high", F.col("confidence").alias("model_confidence"), "reverts", "half_life", "gap_rank", "stress_rank", "label")
    signals = scores.signal_of(_zones(spark, d), F.col("mean_z"), 0.5, 2.0, 0.1, 0.2)
    found = _diagnostics(spark, d).select("adf_p", "kpss_p", F.col("half_life_now").alias("pull_half_life"))  # one row
    return signals.select("dt", "signal", "strength", "confidence", "oversold", "overbought", "conviction", "mean_z").join(value, "dt").join(found)


def _diagnostics(spark, d):
    return roots.reversion_diagnostics(_gap(spark, d), "gap")


@query()
def d20_reversion_diagnostics(spark, d):
    """The gap's pull, half-lives, both tests and its fluctuation exponent, in one row."""
    gap = _gap(spark, d)
    found = _diagnostics(spark, d)
    return found.join(roots.gated_hurst(stats.dfa(gap, "gap"), found), "series")


def _daily(spark, d):
    """Valuation left-joined with breadth, gaps filled by neutral values."""
    v = _zones(spark, d).select("dt", "conviction", F.col("oversold").alias("v_oversold"), F.when(F.col("mean_z") < -1, "OVERSOLD").when(F.col("mean_z") > 1, "OVERBOUGHT").otherwise("NEUTRAL").alias("regime"))
    b = a01_weighted_breadth(spark, d).select("dt", F.col("oversold_pct").alias("oversold"), F.col("overbought_pct").alias("overbought"), (5 * F.col("avg_score")).alias("avg_score"), F.col("oversold_pct").alias("bull"), F.col("overbought_pct").alias("bear"))
    fill = {"oversold": 50.0, "overbought": 50.0, "avg_score": 0.0, "bull": 33.0, "bear": 33.0}
    return relations.with_defaults(v, b, fill)


def _converged(spark, d):
    return held(spark, d, "converged", lambda: scores.convergence(_daily(spark, d)).join(src.target_daily(spark, d).select("dt", "px"), "dt"))


@query()
def d11_value_convergence(spark, d):
    """Agreement of the gap's conviction with breadth, by the weights learned from what followed."""
    df = _converged(spark, d)
    out = learning.reweighted(df, learning.dimension_weights(df, 5))
    out = out.select("dt", "agreement", fixed(F.col("score"), 4).alias("score"))
    return out.select("*", scores.convergence_zone(F.col("score")).alias("zone"), scores.conviction_label(F.col("score")).alias("label"))


@query()
def r31_value_out_of_sample(spark, d):
    return learning.out_of_sample(_converged(spark, d), HORIZONS)


FEATURES = ("net_breadth", "oscillator", "stress", "confidence")


def _states(spark, d):
    """States of the target by momentum, volatility, net breadth, and the fair value's oscillator, stress and confidence."""
    breadth = _daily(spark, d).select("dt", ((F.col("oversold") - F.col("overbought")) / 100).alias("net_breadth"))
    value = _ranked(spark, d).select("dt", "oscillator", F.col("stress_rank").alias("stress"), "confidence")
    context = value.join(breadth, "dt", "left").withColumn("valid", F.col("oscillator").isNotNull())
    return precedent.with_context(precedent.states(src.target_daily(spark, d)), context, list(FEATURES), "valid")


@query()
def d17_value_precedent(spark, d):
    """Periods like the newest by momentum, volatility, breadth, oscillator, stress and confidence."""
    return precedent.similar_periods(_states(spark, d), features=(*precedent.FEATURES, *FEATURES))


@query()
def d22_verdict(spark, d):
    """The verdict of the newest valued row: its fair value, breadth, convergence, skill and precedent."""
    df = learning.consensus(_converged(spark, d).withColumn("series", F.lit("target")), "conviction", "avg_score")
    value = _value(spark, d).where("oscillator IS NOT NULL").select("dt", "oscillator", "confidence")
    now = relations.newest(df.join(value, "dt"), 1)  # the verdict is of the newest row
    ic = learning.ic_summary(r31_value_out_of_sample(spark, d)).select(F.col("mean").alias("ic"))
    states = _states(spark, d)
    rates = precedent.base_rates(d17_value_precedent(spark, d), states, HORIZONS)
    rates = precedent.at_horizon(rates, 10).select("up_share", F.col("n").alias("precedent_n"))
    rows = now.join(ic).join(rates, how="left")  # one row each
    rows = rows.select("dt", "oscillator", "confidence", ((F.col("oversold") - F.col("overbought")) / 100).alias("net"), "consensus", "agreement", "ic", "up_share", "precedent_n")
    return scores.verdict(scores.aligned_reads(rows)).drop("net", "up_share")
