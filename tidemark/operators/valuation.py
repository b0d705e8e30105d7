"""Fair value of a target against a panel: dynamic regressions on factor levels and on block levels, averaged by skill.

What can run side by side does: volatilities by instrument, levels by block, the panel's factors in blocks of days. The
regressions of a target are one ordered pass each, over its days and the levels.
"""

from __future__ import annotations

import math
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import kernels, segments, stats
from tidemark.operators.align import admitted, available, ordered
from tidemark.operators.folds import along, half_life_factor
from tidemark.sources.staging import written

#: What a gap keeps of its weight in the error after a day.
ERROR_KEEP = half_life_factor(252.0)
#: Days to a segment of expanding ranks.
RANK_DAYS = 512
# The adaptive band.
LEVEL, PACE, ALPHA_BOUNDS, FIRST_WIDTH, LEAST = 0.95, 0.01, (0.005, 0.20), 1.959963984540054, 252


def standardised(panel: DataFrame, floor: int = 250, with_return: bool = False) -> DataFrame:
    """(series, dt, z, available, and ret if asked for): returns of panel (series, dt, px) over the mean and deviation known before, where an instrument printed and is admitted."""
    prints = admitted(panel, floor).withColumn("ret", F.log("px") - F.lag(F.log("px")).over(ordered()))
    moved = along(prints, ["ret"], kernels.volatility, "mean double, sd double", keep=["ret", "printed", "admitted"])
    rows = available(moved)
    return rows.select("series", "dt", F.when(F.col("available"), (F.col("ret") - F.col("mean")) / F.greatest("sd", F.lit(1e-8))).alias("z"), "available", *(["ret"] if with_return else []))


def block_levels(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, dt, level) of standardised rows (series, dt, z) by blocks (series, block)."""
    means = rows.join(blocks, "series").groupBy(F.col("block"), "dt").agg(F.avg("z").alias("z"))
    return along(means, ["z"], kernels.block_level, "level double", "block")


def market_kernel(g: np.ndarray) -> dict[str, np.ndarray | list]:
    """Hidden states over the market factor's return against its deviation before, and that deviation's log against its own past.

    volatility is the log deviation known before the row, aged once over 60 of them are.
    """
    quick, slow = half_life_factor(42.0), half_life_factor(252.0)

    def absorb(state: tuple[float, float, float], x: float, keep: float) -> tuple[float, float, float]:
        w, m, s = state
        before, step = keep * w, x - m
        w = before + 1
        return w, m + step / w, keep * s + step * step * before / w

    spread = lambda state: math.sqrt(state[2] / state[0]) if state[0] else 0.0
    own, logs = (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)
    rows, volatility, aged = np.zeros((len(g), 2)), np.zeros(len(g)), np.zeros(len(g), bool)
    for t, x in enumerate(np.nan_to_num(g).tolist()):
        sd = spread(own)
        log = math.log(max(sd, 1e-8))
        z = (log - logs[1]) / max(spread(logs), 1e-6) if t > 20 else 0.0
        rows[t] = np.clip((x / sd if sd > kernels.TINY else 0.0, z), -8, 8)
        volatility[t], aged[t] = log, t > 60
        own, logs = absorb(own, x, quick), absorb(logs, log, slow)
    return kernels.hidden_regimes(rows[:, 0], rows[:, 1]) | {"volatility": volatility, "aged": aged}


def market(factors: DataFrame) -> DataFrame:
    """(dt, stress, drift, switch, entropy, persistence, label, stress_rank) of `panel_blocks.panel_factors` (dt, market).

    stress_rank is the rank of the market's log deviation among those before, null for the first 60 days.
    """
    rows = factors.select(F.lit("market").alias("series"), "dt", "market")
    states = "stress double, drift double, switch double, entropy double, persistence double, label string, volatility double, aged boolean"
    made = written(along(rows, ["market"], market_kernel, states), "market")
    ranks = segments.expanding_cdf(made, "volatility", "_rank", RANK_DAYS).select("dt", "_rank")
    return made.join(ranks, "dt", "left").select("dt", "stress", "drift", "switch", "entropy", "persistence", "label", F.when(F.col("aged"), F.col("_rank")).alias("stress_rank"))


def dispersion(rows: DataFrame) -> DataFrame:
    """(dt, dispersion, dispersion_rank): the deviation of standardised rows (series, dt, z) across a day's instruments, where
    there are five, and its rank among those before."""
    spread = stats.dispersion(rows.where("z IS NOT NULL")).select(F.lit("panel").alias("series"), "dt", "dispersion")
    spread = written(spread, "dispersion")
    return spread.join(segments.expanding_cdf(spread, "dispersion", "dispersion_rank", RANK_DAYS), ["series", "dt"]).drop("series")


def with_ranks(value: DataFrame, rows: DataFrame, factors: DataFrame) -> DataFrame:
    """fair_value's rows with gap_rank (among a series' earlier gaps), dispersion, dispersion_rank, stress_rank and the market's states."""
    gaps = segments.expanding_cdf(value, "gap", "gap_rank", RANK_DAYS)
    return value.join(gaps, ["series", "dt"], "left").join(dispersion(rows), "dt", "left").join(market(factors), "dt", "left")


class AdaptiveWidth:
    """A multiple of the deviation that as many past oscillators lie within as asked, corrected by what it missed."""

    def __init__(self) -> None:
        self.alpha, self.before = 1 - LEVEL, []

    def step(self, size: float) -> float:
        n = len(self.before)
        width = self.before[round((1 - self.alpha) * (n - 1))] if n >= LEAST else FIRST_WIDTH
        self.alpha = min(max(self.alpha + PACE * ((1 - LEVEL) - (size > width)), ALPHA_BOUNDS[0]), ALPHA_BOUNDS[1])
        insort(self.before, size)
        return width


class Reversion:
    """The slope of a gap on the one before by discounted least squares, and how surely it is under 1."""

    def __init__(self, half_life: float = 504.0) -> None:
        self.keep, self.sums, self.n, self.before = half_life_factor(half_life), np.zeros(6), 0, None

    def step(self, gap: float) -> tuple[float, float]:
        """(probability of reversion, half-life); not a number before 8 pairs."""
        if self.before is not None:
            b = self.before
            self.sums = self.keep * self.sums + np.array([1, b, gap, b * b, b * gap, gap * gap])
            self.n += 1
        self.before = gap
        w, sb, sx, sbb, sbx, sxx = self.sums
        if self.n < 8 or w < 4:
            return math.nan, math.nan
        d = sbb - sb * sb / w + 1e-8
        phi = (sbx - sb * sx / w) / d
        se = math.sqrt(max(sxx - sx * sx / w - phi * (sbx - sb * sx / w), 0.0) / max(w - 2, 1.0) / d)
        if se <= kernels.TINY:
            return math.nan, math.nan
        return 0.5 * math.erfc(-(1 - phi) / se / math.sqrt(2)), math.log(2) / -math.log(min(max(phi, 1e-6), 0.999999)) if 0 < phi < 1 else math.nan


OUTPUTS = ("fitted", "gap", "oscillator", "sd", "low", "high", "reverts", "half_life", "agreement", "confidence", "factor_weight", "mispricing", "error", "unlikeness", "adaptation", "factor_share", "importance", "betas")


def valued(price: np.ndarray, factors: np.ndarray, blocks: np.ndarray, burn_in: int = 250) -> dict[str, list]:
    """Two views of log prices, by factor levels and by block levels, weighted by likelihood; regressions without one block each
    tell how much rests on it.

    A row's values are known before its price, but for the gap itself. Rows without a price are left empty.
    """
    out: dict[str, list] = {c: [None] * len(price) for c in OUTPUTS}
    n_blocks = blocks.shape[1]
    views, logs = None, np.zeros(2)
    width, reversion = AdaptiveWidth(), Reversion()
    agreed = weight = miss = missed = 0.0
    for t in range(len(price)):
        p = price[t]
        if t < burn_in or not np.isfinite(p):
            continue
        if views is None:
            past = price[max(0, t - burn_in) : t]
            past = past[np.isfinite(past)]
            start = float(past.mean()) if len(past) else float(p)
            scale = 25 * max(float(np.var(np.diff(past))) if len(past) > 2 else 1e-4, 1e-6)
            heads = [np.append(start, np.zeros(k)) for k in (factors.shape[1], n_blocks)]
            views = [kernels.AveragedModels(len(h), h, scale, scale) for h in heads]
            without = kernels.ModelBank([0.999] * n_blocks, n_blocks + 1, heads[1], scale, scale)
            mask = np.ones((n_blocks, n_blocks + 1))
            mask[np.arange(n_blocks), np.arange(n_blocks) + 1] = 0
        rows = np.append(1.0, factors[t]), np.append(1.0, blocks[t])
        made = [v.forecast(x) for v, x in zip(views, rows, strict=True)]
        w = kernels.normalised(logs)
        betas = np.concatenate([x * v.coefficients for x, v in zip(w, views, strict=True)]).tolist()
        fair = float(w @ [f for f, _ in made])
        sd = math.sqrt(max(float(sum(x * (q + (f - fair) ** 2) for x, (f, q) in zip(w, made, strict=True))), 1e-12))
        gap = p - fair
        left = p - without.forecast(mask * rows[1])[0]
        logs = kernels.FORGET * logs + np.array([max(v.absorb(x, p), -1e6) for v, x in zip(views, rows, strict=True)])
        logs -= logs.max()
        without.absorb(mask * rows[1], p)
        sure, half_life = reversion.step(gap)
        keep = half_life_factor(min(max(half_life, 5.0), 126.0) if half_life == half_life else 21.0)
        agreed = keep * agreed + (1 - keep) * (float((np.sign(left) == np.sign(gap)).mean()) if gap else 0.5)
        weight = keep * weight + (1 - keep)
        miss, missed = ERROR_KEEP * miss + (1 - ERROR_KEEP) * gap * gap, ERROR_KEEP * missed + (1 - ERROR_KEEP)
        unlike = float(left.std()) / max(abs(gap), sd)
        lasting = float(sum(x * v.memory for x, v in zip(w, views, strict=True)))
        sizes = [float(np.abs(v.coefficients[1:] * x[1:]).sum()) for v, x in zip(views, rows, strict=True)]
        agreement = max(0.0, 2 * agreed / max(weight, kernels.TINY) - 1)
        times = width.step(abs(gap / sd))
        moved = np.abs(left - gap)
        none = lambda v: None if v != v else v
        row = (fair, gap, gap / sd, sd, fair - times * sd, fair + times * sd, none(sure), none(half_life), agreement, none(math.sqrt(max(sure, 0.0) * agreement)) if sure == sure else None, float(w[0]), math.expm1(gap), math.sqrt(miss / missed), unlike, lasting, none(sizes[0] / sum(sizes)) if sum(sizes) > kernels.TINY else None, (moved / max(moved.sum(), kernels.TINY)).tolist(), betas)
        for c, v in zip(OUTPUTS, row, strict=True):
            out[c][t] = v
    return out


def fair_value(rows: DataFrame, factors: DataFrame, target: DataFrame, blocks: DataFrame, burn_in: int = 250) -> DataFrame:
    """(series, dt, fitted, gap, oscillator, sd, low, high, reverts, half_life, agreement, confidence, factor_weight, mispricing, error, unlikeness, adaptation,
    factor_share, importance, betas).

    rows are `standardised` ones of the panel, factors theirs (`panel_blocks.panel_factors`), blocks (series, block), target
    (series, dt, px), one series or several, each an ordered group. mispricing is the gap in per one, error the discounted root
    mean square of gaps, unlikeness how far regressions without one block each differ, adaptation the rows the coefficients
    remember, factor_share the factors' part of all contributions' size.
    fitted, low, high and gap are logs. importance lists each block's share, in the order of the blocks' names. betas are the
    weighted coefficients that make fitted: a constant and the factors', then a constant and the blocks'.
    """
    order = blocks.select("block").distinct().agg(F.array_sort(F.collect_set("block")).alias("names"))
    days = target.select("dt").distinct()
    held = lambda c, *by: F.last(c, ignorenulls=True).over(Window.partitionBy(*by).orderBy("dt"))  # noqa: E731  (a block's days)
    # Levels as of each of the target's dates, those of days between them too
    grid = days.join(blocks.select("block").distinct())  # a row a block and day
    levels = block_levels(rows, blocks).join(grid, ["block", "dt"], "full").withColumn("level", held("level", "block")).join(days, "dt", "left_semi")
    levels = levels.groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("block", "level"))).alias("m")).join(order)
    levels = levels.select("dt", F.transform("names", lambda n: F.try_element_at("m", n)).alias("blocks"))
    scored = factors.select("dt", "levels").join(days, "dt", "full").withColumn("levels", held("levels", F.lit(0))).join(days, "dt", "left_semi")
    wide = target.select("series", "dt", F.log("px").alias("p")).join(scored, "dt", "left").join(levels, "dt", "left")
    kind = dict(target.dtypes)["dt"]

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("dt")

        def filled(column: str) -> np.ndarray:
            size = max((len(v) for v in own[column] if v is not None), default=0)
            x = np.array([np.array(v, float) if v is not None else np.full(size, np.nan) for v in own[column]]).reshape(len(own), size)
            return np.nan_to_num(x)  # before the first level

        made = valued(own["p"].to_numpy(float), filled("levels"), filled("blocks"), burn_in)
        return pd.DataFrame({"series": own["series"].to_numpy(), "dt": own["dt"].to_numpy()} | made)

    numbers = ", ".join(f"{c} double" for c in OUTPUTS[:-2])
    return wide.groupBy("series").applyInPandas(run, f"series string, dt {kind}, {numbers}, importance array<double>, betas array<double>")


def attribution(value: DataFrame, factor_parts: DataFrame, block_parts: DataFrame, blocks: DataFrame, n_factors: int) -> DataFrame:
    """(series, dt, instrument, part) of fair_value's rows on the dates of factor_parts: parts of all instruments and the constant
    (instrument null) add up to fitted.

    factor_parts are (dt, factor, series, part), block_parts (block, dt, series, part) of blocks (series, block), carried to dates without a row of theirs.
    """
    rows = value.where("betas IS NOT NULL").select("series", "dt", "betas").join(factor_parts.select("dt").distinct(), "dt", "left_semi")
    beta = lambda k: F.get("betas", k)
    constant = rows.select("series", "dt", F.lit(None).cast("string").alias("instrument"), (beta(F.lit(0)) + beta(F.lit(n_factors + 1))).alias("part"))
    by_factor = rows.join(factor_parts.withColumnRenamed("series", "instrument"), "dt").select("series", "dt", "instrument", (beta(F.col("factor") + 1) * F.col("part")).alias("part"))
    names = blocks.select("block").distinct().agg(F.array_sort(F.collect_set("block")).alias("_names"))  # the blocks: a few
    spells = block_parts.withColumn("_until", F.lead("dt").over(Window.partitionBy("block", "series").orderBy("dt")))
    spells = spells.select("block", F.col("series").alias("instrument"), F.col("dt").alias("_from"), "_until", "part")
    # As of: each date meets the spell that holds it, month by month
    month = lambda d: F.trunc(d, "month")
    until = F.least(F.coalesce(F.col("_until"), F.col("_end")), F.col("_end"))
    ends = rows.agg(F.max("dt").alias("_end"))
    spells = spells.join(ends).where("_from <= _end").withColumn("_month", F.explode(F.sequence(month("_from"), month(until), F.expr("INTERVAL 1 MONTH"))))
    held = rows.withColumn("_month", month("dt")).join(spells, "_month").where("_from <= dt AND (_until IS NULL OR dt < _until)").join(names)
    by_block = held.select("series", "dt", "instrument", (beta(n_factors + 1 + F.array_position("_names", F.col("block")).cast("int")) * F.col("part")).alias("part"))
    every = constant.unionByName(by_factor).unionByName(by_block)
    return every.groupBy("series", "dt", "instrument").agg(F.sum("part").alias("part"))
