"""Composite scores: strength of bars, weighted breadth, convergence, divergence and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.scalar import clip, gate, scaled_sigmoid, zone
from tidemark.operators import windows as w
from tidemark.operators.align import ordered, past
from tidemark.operators.folds import ewm


PARTS = ("momentum", "structure", "flow")


def strength_parts(bars: DataFrame, sizes: list[tuple[int, int]]) -> DataFrame:
    """(series, dt, close, length, momentum, structure, flow) of OHLCV bars, for each (length, rate-of-change length) of sizes.

    All lengths are columns of one ordered pass, worked out level by level; they become rows at the end.
    """
    c = F.col
    atr = ewm(bars.withColumn("tr", w.true_range()), "tr", 1 / 14).select("series", "dt", c("mean").alias("atr"))
    df = bars.join(atr, ["series", "dt"])
    each = lambda make: {name: x for n, roc in sizes for name, x in make(n, roc).items()}
    df = df.withColumns({"d1": w.change(c("close"), 1), "c1": F.lag("close").over(ordered()), "d5": w.change(c("close"), 5), "m5": w.sma(c("close"), 5)} | each(
        lambda n, roc: {f"mn{n}": w.sma(c("close"), n), f"vn{n}": w.sma(c("volume"), n), f"roc{n}": w.percent_change(c("close"), roc), f"accum{n}": w.accumulation(n)}))
    moved = F.when(c("d1") / c("c1") > 0.0033, 1.0).when(c("d1") / c("c1") < -0.0033, -1.0).otherwise(0.0)
    df = df.withColumns({"dd5": w.change(c("d5"), 5), "steps": moved} | each(lambda n, _: {f"vr{n}": F.coalesce(c("volume") / c(f"vn{n}"), F.lit(1.0))}))
    df = df.withColumns({"walk": F.sum("steps").over(past())} | each(lambda n, _: {f"push{n}": w.sma(((c("high") + c("low")) / 2 - c("open")) * c(f"vr{n}"), n) - w.sma(c("d5") * c(f"vr{n}"), n)}))
    df = df.withColumns({"pace": F.try_divide(c("d5"), c("atr"))} | each(lambda n, _: {f"over5{n}": c("m5") - c(f"mn{n}"), f"over{n}": c("close") - c(f"mn{n}"), f"lead{n}": c("walk") - w.sma(c("walk"), n)}))

    def parts(n: int, _: int) -> dict[str, Column]:
        z = lambda name: w.causal_z(c(name), n)
        trend = (z(f"over5{n}") + z("dd5") + z("pace") + z(f"over{n}")) / 2
        structure = (scaled_sigmoid(z(f"push{n}")) + scaled_sigmoid(trend)) / 2**0.5
        return {f"momentum{n}": scaled_sigmoid(z(f"roc{n}")), f"structure{n}": structure, f"flow{n}": (c(f"accum{n}") + scaled_sigmoid(z(f"lead{n}"))) / 2**0.5}

    df = df.withColumns(each(parts))
    return df.select("series", "dt", "close", F.inline(F.array(*[F.struct(F.lit(n).alias("length"), *[c(f"{p}{n}").alias(p) for p in PARTS]) for n, _ in sizes])))


def strength_of(parts: tuple[str, ...] = PARTS) -> Column:
    """The sum of the active parts, bounded."""
    unknown = set(parts) - set(PARTS)
    if unknown or not parts:
        raise ValueError(f"parts are some of {PARTS}, not {sorted(unknown) or parts}")
    return scaled_sigmoid(sum((F.col(p) for p in parts), F.lit(0.0)), 1.0)


def strength(bars: DataFrame, n: int = 14, roc: int = 12, parts: tuple[str, ...] = PARTS) -> DataFrame:
    """(series, dt, momentum, structure, flow, strength) of OHLCV bars, by the active parts."""
    return strength_parts(bars, [(n, roc)]).select("series", "dt", *PARTS, strength_of(parts).alias("strength"))


def macro_deviations(panel: DataFrame, target: DataFrame, lengths: list[int], drivers: int = 4) -> DataFrame:
    """(length, dt, px, fitted, quality, signal): the target against the blend of its `drivers` most correlated series, by each length.

    For each series a rolling regression on earlier rows predicts the target; of each date the largest squared correlations
    count, in that proportion. All lengths come from one ordered pass over the panel.
    """
    c = F.col
    rows = panel.join(target.select("dt", c("px").alias("y")), "dt").where("y IS NOT NULL AND px IS NOT NULL")
    for n in lengths:
        before = w.prior(n)
        rows = rows.withColumns({f"r{n}": w.rolling_corr(c("px"), c("y"), n), f"mx{n}": F.avg("px").over(before), f"my{n}": F.avg("y").over(before), f"sx{n}": F.stddev_samp("px").over(before), f"sy{n}": F.stddev_samp("y").over(before)})
    slope = lambda n: F.when(c(f"sx{n}") > 1e-12, c(f"r{n}") * c(f"sy{n}") / c(f"sx{n}")).otherwise(0.0)
    each = [F.struct(F.lit(n).alias("length"), F.round(F.pow(f"r{n}", F.lit(2)), 9).alias("r2"), c(f"my{n}").alias("my"), (c(f"my{n}") + slope(n) * (c("px") - c(f"mx{n}"))).alias("pred")) for n in lengths]
    rows = rows.select("series", "dt", "y", F.inline(F.array(*each))).where("pred IS NOT NULL")
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("length", "dt").orderBy(F.desc("r2"), "series"))).where(c("place") <= drivers)
    weight = F.sum("r2")
    day = best.groupBy("length", "dt").agg(F.first("y").alias("px"), F.when(weight > 0, F.sum(c("r2") * c("pred")) / weight).otherwise(F.avg("my")).alias("fitted"), F.sqrt(F.try_divide(F.sum(F.pow("r2", 2)), weight)).alias("quality"))
    day = day.withColumn("series", c("length")).withColumn("gap", c("px") - c("fitted"))
    z = F.lit(None).cast("double")
    for n in lengths:
        z = F.when(c("length") == n, w.causal_z(c("gap"), n)).otherwise(z)
    return day.select("length", "dt", "px", "fitted", F.coalesce("quality", F.lit(0.0)).alias("quality"), scaled_sigmoid(z).alias("signal"))


def macro_deviation(panel: DataFrame, target: DataFrame, n: int = 60, drivers: int = 4) -> DataFrame:
    """(dt, px, fitted, quality, signal) of `macro_deviations` for one length."""
    return macro_deviations(panel, target, [n], drivers).drop("length")


def weighted_breadth(views: DataFrame, cut: float) -> DataFrame:
    """By date: weighted shares of views under -cut and over cut, their number, and the weighted mean score.

    views is (dt, series, score, weight).
    """
    total = F.sum("weight")
    return views.groupBy("dt").agg(
        F.count("score").alias("n_views"), (100 * F.sum(F.when(F.col("score") < -cut, F.col("weight")).otherwise(0.0)) / total).alias("oversold_pct"),
        (100 * F.sum(F.when(F.col("score") > cut, F.col("weight")).otherwise(0.0)) / total).alias("overbought_pct"), (F.sum(F.col("score") * F.col("weight")) / total).alias("avg_score"),
    )


#: Weights of the four dimensions.
DIMENSIONS = {"direction": 0.5, "breadth": 0.2, "magnitude": 0.2, "regime": 0.1}


def convergence(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """df with dim_* (agreement in four dimensions, 0 to 1), lean, agreement, score (both rounded, and raw) and zone; negative is bullish.

    df has conviction, v_oversold (valuation, %), oversold and overbought (breadth, %), avg_score (-10 to 10), regime
    (text) and bull and bear (%).
    """
    weights = weights or DIMENSIONS
    c = F.col
    spread = c("oversold") - c("overbought")
    signs = F.signum(-c("conviction")) * F.signum(spread)
    direction = F.when(signs > 0, 1.0).when(signs < 0, 0.0).otherwise(0.5)
    breadth = clip(1 - F.abs(c("v_oversold") - c("oversold")) / 100, 0, 1)
    magnitude = clip(1 - F.abs(F.least(F.abs(c("conviction")) / 100, F.lit(1.0)) - F.least(F.abs(c("avg_score")) / 10, F.lit(1.0))), 0, 1)
    bullish, bearish = c("regime").contains("OVERSOLD"), c("regime").contains("OVERBOUGHT")
    regime = F.when((bullish & (c("bull") > c("bear"))) | (bearish & (c("bear") > c("bull"))), 1.0).when((c("regime") == "NEUTRAL") & (F.abs(c("bull") - c("bear")) < 20), 0.8).otherwise(0.2)
    df = df.withColumns({"dim_direction": direction, "dim_breadth": breadth, "dim_magnitude": magnitude, "dim_regime": regime})
    composite = sum((weight * (2 * c(f"dim_{k}") - 1) for k, weight in weights.items()), F.lit(0.0))
    lean = 0.5 * (clip(-c("conviction") / 100, -1, 1) + clip(spread / 100, -1, 1))
    score = -lean * (composite + 1) / 2 * 100
    agreement = sum((weight * c(f"dim_{k}") for k, weight in weights.items()), F.lit(0.0))
    df = df.withColumns({"lean": lean, "raw_agreement": agreement, "raw_score": score, "agreement": F.round(agreement, 3), "score": F.round(score, 2)})
    return df.withColumn("zone", convergence_zone(c("score")))


# Cuts of zones and labels.
ZONE_CUTS, LABEL_CUTS = (4.46, 9.18, 15.61), (6.0, 9.2, 15.9)
# The verdict's gates (closed at and below the first, open from the second on), what stands in for too few
# precedents, and the least convictions of its tiers.
GATES = {"oscillator": (0.5, 2.0), "confidence": (0.2, 0.8), "breadth": (-0.3, 0.4), "agreement": (0.45, 0.85), "consensus": (-0.25, 0.25), "skill": (-0.02, 0.15), "precedent": (0.35, 0.65)}
LEAST_PRECEDENTS, NO_PRECEDENT, NO_SKILL = 8, 0.6, 0.25
TIERS = ((0.30, "HIGH"), (0.15, "MEDIUM"), (0.06, "LOW"))


def convergence_zone(x: Column) -> Column:
    return _tiers(x, ZONE_CUTS, ("WEAK", "MODERATE", "STRONG"), "BULL", "BEAR")


def _tiers(x: Column, cuts: tuple[float, ...], words: tuple[str, ...], low: str, high: str) -> Column:
    """'<word> <low>' under minus a cut and '<word> <high>' over it, the widest cut first; else NEUTRAL."""
    out = F.lit("NEUTRAL")
    for cut, word in zip(cuts, words, strict=True):
        out = F.when(x <= -cut, f"{word} {low}").when(x >= cut, f"{word} {high}").otherwise(out)
    return out


def conviction_label(x: Column) -> Column:
    return _tiers(x, LABEL_CUTS, ("LEAN", "CLEAR", "STRONG"), "BUY", "SELL")


def divergence(df: DataFrame) -> DataFrame:
    """df (conviction, v_oversold, oversold, overbought, avg_score) with stances, kind (null: none) and severity."""
    c, v = F.col, F.col("conviction")
    stance = F.when((v < -60) & (c("v_oversold") > 70), "EXTREME_BULLISH").when((v < -20) & (c("v_oversold") > 60), "BULLISH").when((v > 60) & (c("v_oversold") < 30), "EXTREME_BEARISH").when((v > 20) & (c("v_oversold") < 40), "BEARISH").otherwise("NEUTRAL")
    other = F.when((c("oversold") > 60) & (c("avg_score") < -3), "BULLISH").when((c("overbought") > 60) & (c("avg_score") > 3), "BEARISH").otherwise("NEUTRAL")
    df = df.withColumns({"valuation_stance": stance, "breadth_stance": other})
    a, b = c("valuation_stance"), c("breadth_stance")
    leads = ((a == "EXTREME_BULLISH") & (b != "BULLISH")) | ((a == "EXTREME_BEARISH") & (b != "BEARISH"))
    follows = ((b == "BULLISH") & ~a.contains("BULLISH")) | ((b == "BEARISH") & ~a.contains("BEARISH"))
    df = df.withColumn("kind", F.when(leads, "VALUATION_LEADS").when(follows, "BREADTH_LEADS"))
    severity = F.when(c("kind") == "VALUATION_LEADS", F.least(F.abs(v) / 100, F.lit(1.0))).when(c("kind") == "BREADTH_LEADS", F.least(F.abs(c("avg_score")) / 10, F.lit(1.0)))
    return df.withColumn("severity", severity)


def conviction_raw(zones: list[Column]) -> Column:
    """100 (over - under) / n + 150 (extreme over - extreme under) / n of zone labels; null labels count in n."""
    n = len(zones)
    tally = lambda word: reduce(lambda a, b: a + b, [F.when(z == word, 1).otherwise(0) for z in zones])
    return 100 * (tally("Overvalued") - tally("Undervalued")) / n + 150 * (tally("Extreme Over") - tally("Extreme Under")) / n


def lookback_breadth(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with oversold and overbought (per cent of lookbacks), conviction and mean_z of several lookbacks' z."""
    n = len(columns)
    count = lambda test: reduce(lambda a, b: a + b, [F.when(test(F.col(c)), 1).otherwise(0) for c in columns])
    known = F.array_compact(F.array(*columns))
    mean = F.aggregate(known, F.lit(0.0), lambda a, b: a + b) / F.size(known)
    return df.withColumns({
        "oversold": 100 * count(lambda z: z <= -1) / n, "overbought": 100 * count(lambda z: z > 1) / n, "conviction": conviction_raw([zone(F.col(c)) for c in columns]), "mean_z": F.when(F.size(known) > 0, mean).otherwise(0.0),
    })


def signal_of(df: DataFrame, x: Column, weak: float, strong: float, calm: float, quiet: float) -> DataFrame:
    """df (oversold, overbought, ...) with signal, strength (the middle of both cuts between them) and confidence of x.

    A hold is surer the smaller |x| is, a signal the more lookbacks agree.
    """
    size = F.abs(x)
    signal = F.when(x < -weak, "BUY").when(x > weak, "SELL").otherwise("HOLD")
    strength = F.when(size > strong, "STRONG").when(size > (weak + strong) / 2, "MODERATE").when(size > weak, "WEAK").otherwise("NONE")
    most = F.greatest("oversold", "overbought")
    held = F.when(size < calm, "HIGH").when(size < quiet, "MEDIUM").otherwise("LOW")
    return df.withColumns({"signal": signal, "strength": strength, "confidence": F.when(size <= weak, held).when(most >= 80, "HIGH").when(most >= 60, "MEDIUM").otherwise("LOW")})


def aligned_reads(df: DataFrame, neutral: float = 0.5) -> DataFrame:
    """df (oscillator, net, consensus, up_share) with net_breadth, consensus and precedent_share as seen from the call.

    A low oscillator is a bullish call, a low consensus a bullish one. Without a call (|oscillator| under neutral) sizes count,
    whatever their sign, and precedent is even.
    """
    side = F.when(F.col("oscillator") <= -neutral, 1).when(F.col("oscillator") >= neutral, -1).otherwise(0)
    seen = lambda bullish: F.when(side == 0, F.abs(bullish)).otherwise(side * bullish)
    share = F.when(side == 0, 0.5).when(side > 0, F.col("up_share")).otherwise(1 - F.col("up_share"))
    return df.withColumns({"net_breadth": seen(F.col("net")), "consensus": seen(-F.col("consensus")), "precedent_share": share})


def verdict(df: DataFrame) -> DataFrame:
    """df with gate_*, binding (the least gate), conviction (their product), direction and tier.

    df has oscillator, confidence, net_breadth and consensus (both aligned with the direction), agreement, ic,
    precedent_share and precedent_n.
    """
    c = F.col
    gates = {
        "oscillator": gate(F.abs(c("oscillator")), *GATES["oscillator"]),
        "confidence": gate(c("confidence"), *GATES["confidence"]),
        "breadth": gate(c("net_breadth"), *GATES["breadth"]),
        "agreement": gate(c("agreement"), *GATES["agreement"]) * gate(c("consensus"), *GATES["consensus"]),
        "skill": gate(c("ic"), *GATES["skill"], missing=NO_SKILL),
        "precedent": F.when(c("precedent_n") >= LEAST_PRECEDENTS, gate(c("precedent_share"), *GATES["precedent"])).otherwise(NO_PRECEDENT),
    }
    df = df.withColumns({f"gate_{k}": v for k, v in gates.items()})
    product = reduce(lambda a, b: a * b, [c(f"gate_{k}") for k in gates])
    least = F.array_min(F.array(*[F.struct(c(f"gate_{k}").alias("g"), F.lit(k).alias("name")) for k in gates]))["name"]
    direction = F.when(c("oscillator") <= -0.5, "LONG").when(c("oscillator") >= 0.5, "SHORT").otherwise("STAND ASIDE")
    df = df.withColumns({"binding": least, "conviction": product, "direction": direction})
    tier = F.lit("NONE")
    for least_conviction, name in reversed(TIERS):
        tier = F.when(c("conviction") >= least_conviction, name).otherwise(tier)
    return df.withColumn("tier", F.when(c("direction") == "STAND ASIDE", "NONE").otherwise(tier))


def consensus_label(x: Column, cut: float, strong: float) -> Column:
    """Five labels; a low value is a buy."""
    return F.when(x > strong, "STRONG_SELL").when(x > cut, "SELL").when(x < -strong, "STRONG_BUY").when(x < -cut, "BUY").otherwise("HOLD")
