"""A bank of views of one target: the same oscillators at several lengths, blended, weighted by skill and reduced by date."""

from __future__ import annotations

from dataclasses import dataclass
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalar import clip, scaled_sigmoid
from tidemark.operators import folds, regimes, scores
from tidemark.operators import windows as w
from tidemark.operators.align import ordered, spine_of
from tidemark.operators.freshness import condition, divergence

# Lengths of the views, the share of a length that the rate of change spans, and the drivers of a view.
LENGTHS, ROC_SHARE, DRIVERS = (8, 14, 22, 34, 52), 0.85, 4


@dataclass(frozen=True)
class View:
    name: str
    length: int
    roc: int
    macro: bool
    parts: tuple[str, ...] = scores.PARTS


def view_grid(lengths: tuple[int, ...] = LENGTHS, share: float = ROC_SHARE) -> list[View]:
    """Every length with and without drivers, the middle one by part, the shortest by momentum and the longest by flow."""
    lengths = tuple(sorted(lengths))
    roc = {n: max(5, round(share * n)) for n in lengths}
    middle = lengths[len(lengths) // 2]
    whole = [View(f"{n}-{'drivers' if macro else 'price'}", n, roc[n], macro) for macro in (True, False) for n in lengths]
    parts = [View(f"{middle}-{p}", middle, roc[middle], True, (p,)) for p in scores.PARTS]
    ends = [View(f"{n}-{p}-price", n, roc[n], False, (p,)) for n, p in ((lengths[0], "momentum"), (lengths[-1], "flow"))]
    return [*whole, *parts, *ends]


def usable_views(views: list[View], traded_share: float) -> list[View]:
    """Without views of flow alone where under half of the rows have a volume."""
    return [v for v in views if v.parts != ("flow",) or traded_share >= 0.5]


def blend(df: DataFrame, base: float = 0.0, sharpness: float = 8.0, low: float = -5.0, high: float = 5.0) -> DataFrame:
    """df (series, dt, close, strength, deviation, quality) with the blended oscillator, its condition, signals and divergences.

    The clearer of the two counts more; where they agree in sign the blend is strengthened, else damped.
    """
    c = F.col
    clear, far = F.pow(F.abs(c("strength")), F.lit(sharpness)), F.pow(F.abs(c("deviation")) * c("quality"), F.lit(sharpness))
    total = clear + far + 0.001
    a, b = 0.5 * base + 0.5 * clear / total, 0.5 * (1 - base) + 0.5 * far / total
    df = df.withColumns({"weight": a / (a + b), "agreement": c("strength") * c("deviation")})
    boost = F.when(c("agreement") > 0, 1 + 0.2 * F.abs("agreement")).otherwise(1 - 0.1 * F.abs("agreement"))
    df = df.withColumn("unified", clip((c("weight") * c("strength") + (1 - c("weight")) * c("deviation")) * boost, -1, 1))
    df = df.withColumn("oscillator", 10 * c("unified"))
    bullish, bearish = divergence(c("oscillator"), c("close"), low, high)
    strong = c("agreement") > 0.3
    return df.withColumns({
        "condition": condition(c("oscillator"), low, high), "buy": strong & (c("oscillator") < low), "sell": strong & (c("oscillator") > high), "bullish": bullish, "bearish": bearish,
    })


def analysed(bars: DataFrame, panel: DataFrame, views: list[View], base: float = 0.0) -> DataFrame:
    """Every view of the target: (series: its name, dt, close, strength, deviation, quality, ...) of bars (series, dt, OHLCV).

    Lengths are worked out once each, whichever views share them.
    """
    target = bars.select("series", "dt", F.col("close").alias("px"))
    strengths = scores.strength_parts(bars, sorted({(v.length, v.roc) for v in views}))
    grid = F.array(*[F.struct(F.lit(v.name).alias("name"), F.lit(v.length).alias("_length"), F.lit(v.macro).alias("macro"), *[F.lit(float(p in v.parts)).alias(f"_{p}") for p in scores.PARTS]) for v in views])
    rows = strengths.select("*", F.inline(grid)).where("length = _length")
    active = [F.when(F.col(f"_{p}") > 0, F.col(p)).otherwise(0.0) for p in scores.PARTS]
    rows = rows.withColumn("strength", scaled_sigmoid(sum(active, F.lit(0.0)), 1.0))
    macro = sorted({v.length for v in views if v.macro})
    if macro:
        far = scores.macro_deviations(panel, target, macro, DRIVERS).select("length", "dt", "signal", F.col("quality").alias("_q"))
        rows = rows.join(far, ["length", "dt"], "left")
    else:
        rows = rows.withColumns({"signal": F.lit(0.0), "_q": F.lit(0.0)})
    known = lambda c: F.when(F.col("macro"), F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return blend(rows.select(F.col("name").alias("series"), "dt", "close", "strength", known("signal").alias("deviation"), known("_q").alias("quality")), base)


def with_regimes(views: DataFrame) -> DataFrame:
    """views (series, dt, unified, ...) with the regime columns of each view."""
    return regimes.regime_rows(views, "unified", keep=[c for c in views.columns if c not in ("series", "dt")]).drop("level", "variance")


def view_weights(views: DataFrame, prices: DataFrame, horizon: int = 10, half_life: float = 252.0, floor: float = 0.02, shrink: float = 0.5) -> DataFrame:
    """(dt, series, weight) of views (series, dt, oscillator): weights by skill known on each date; they sum to the number of views.

    A call is scored `horizon` rows later, when its outcome, the change of prices (dt, px), is known.
    """
    outcome = prices.select(F.lit(0).alias("series"), "dt", "px").withColumn("outcome", w.percent_change(F.col("px"), horizon)).select("dt", "outcome")
    rounds = spine_of(views, outcome).join(views.select("series", "dt", "oscillator"), ["series", "dt"], "left").withColumn("call", F.lag("oscillator", horizon).over(ordered()))
    return folds.shrunk_weights(folds.skill_weights(folds.discounted_skill(rounds, "call", "outcome", half_life), floor=floor), shrink)


def breadth(views: DataFrame) -> DataFrame:
    """One row a date of views (dt, oscillator, condition, buy, sell, bullish, bearish, regime, volatility, change, strength, deviation, bull, bear, weight).

    Counts and sums are of weights (null: 1), percentages of the number of views, means of the weights' sum.
    """
    c, weight = F.col, F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(0.0))
    rising = c("regime").contains("BULL")
    falling, turning = c("regime").contains("BEAR") & ~rising, c("regime") == "TRANSITION"
    tests = {
        "oversold": c("condition") == "Oversold", "overbought": c("condition") == "Overbought", "neutral": ~c("condition").isin("Oversold", "Overbought"), "buys": c("buy"), "sells": c("sell"),
        "bullish_divergences": c("bullish"), "bearish_divergences": c("bearish"), "rising": rising, "falling": falling, "turning": turning & ~rising & ~falling,
        "wide": c("volatility").isin("HIGH", "EXTREME"), "narrow": c("volatility") == "LOW", "changes": c("change"),
    }
    means = {"mean_oscillator": c("oscillator"), "mean_strength": 10 * c("strength"), "mean_deviation": 10 * c("deviation"), "mean_bull": c("bull"), "mean_bear": c("bear")}
    rows = views.withColumn("_w", weight)
    out = rows.groupBy("dt").agg(
        F.count("*").alias("n_views"), F.sum("_w").alias("_total"), *[F.sum(F.when(F.coalesce(test, F.lit(False)), c("_w")).otherwise(0.0)).alias(name) for name, test in tests.items()],
        F.sum(c("oscillator") * c("_w")).alias("sum_oscillator"), *[F.try_divide(F.sum(x * c("_w")), F.sum("_w")).alias(name) for name, x in means.items()],
    )
    out = out.withColumn("level", F.greatest(c("_total") - c("rising") - c("falling") - c("turning"), F.lit(0.0))).drop("_total")
    return out.withColumns({f"{name}_pct": c(name) / c("n_views") * 100 for name in ("oversold", "overbought", "neutral", "rising", "falling", "wide", "narrow")})


def common_count(views: DataFrame) -> DataFrame:
    """(n_views, n_effective): how many views there are, and how many unlike ones, by the squared correlations of their oscillators."""
    pairs = views.select(F.col("series").alias("a"), "dt", F.col("oscillator").alias("x")).join(views.select(F.col("series").alias("b"), "dt", F.col("oscillator").alias("y")), "dt")
    r = pairs.groupBy("a", "b").agg(F.coalesce(F.corr("x", "y"), F.lit(0.0)).alias("r"))
    r = r.withColumn("r", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.col("r")))
    return r.agg(F.countDistinct("a").alias("n_views"), (F.pow(F.countDistinct("a"), 2) / F.sum(F.pow("r", 2))).alias("n_effective"))
