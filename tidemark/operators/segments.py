"""Recursions along one long series in segments that run side by side.

A step of these recursions maps a state by x -> a x + b or x -> max(a x + b, c) with a >= 0, and such maps are closed under
composition; discounted moments are likewise joined by a formula. So every segment gives, first, what it does to any state
(`passed`), the short list of segments hands each its starting state (`after`), and then all segments run at once (`run`).
A segment is a range of the order column, so finding it takes no sort and no window, and its rows are bounded by its width.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.folds import half_life_factor
from tidemark.sources.staging import written

NAN = math.nan
RUN_ROWS = 1 << 15  # rows that are ranked among themselves in one step


@dataclass(frozen=True)
class Fold:
    """start is the state before any row, passed(*arrays) a segment's numbers, after(state, numbers) the state behind it.

    run(state, *arrays) gives the outputs of schema, each row's known from the state and the rows up to it.
    """

    start: tuple[float, ...]
    passed: Callable[..., tuple[float, ...]]
    after: Callable[[tuple, tuple], tuple]
    run: Callable[..., dict[str, np.ndarray]]
    schema: str


def segment_of(df: DataFrame, order: str, width: int) -> Column:
    """The segment of a row: width days of a date, seconds of a timestamp, or units of a whole number."""
    kind = dict(df.dtypes)[order]
    at = F.unix_date(order) if kind == "date" else F.unix_micros(F.col(order).cast("timestamp")) / 1_000_000 if kind.startswith("timestamp") else F.col(order)
    return F.floor(at / width).cast("long")


def in_segments(df: DataFrame, columns: list[str], fold: Fold, width: int, *by: str, order: str = "dt", keep: tuple[str, ...] = ()) -> DataFrame:
    """(by, order, keep, outputs) of fold over columns along each key's rows in order; a segment spans width (see `segment_of`)."""
    by = by or ("series",)
    kinds = dict(df.dtypes)
    rows = df.select(*dict.fromkeys([*by, order, *keep, *columns]), segment_of(df, order, width).alias("_segment"))
    keys = ", ".join(f"{c} {kinds[c]}" for c in by)

    def arrays(own: pd.DataFrame) -> tuple[pd.DataFrame, list[np.ndarray]]:
        own = own.sort_values(order, kind="stable")
        return own, [own[c].to_numpy(float) for c in columns]

    def passed(own: pd.DataFrame) -> pd.DataFrame:
        return own.iloc[:1][[*by, "_segment"]].assign(_passed=[list(map(float, fold.passed(*arrays(own)[1])))])

    def starts(own: pd.DataFrame) -> pd.DataFrame:
        own, state, found = own.sort_values("_segment"), fold.start, []
        for numbers in own["_passed"]:
            found.append(list(map(float, state)))
            state = fold.after(state, tuple(numbers))
        return own[[*by, "_segment"]].assign(_state=found)

    def run(own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        own, values = arrays(own)
        made = fold.run(tuple(state["_state"].iloc[0]), *values)
        return pd.DataFrame({c: own[c].to_numpy() for c in (*by, order, *keep)} | made)

    numbers = rows.groupBy(*by, "_segment").applyInPandas(passed, f"{keys}, _segment long, _passed array<double>")
    carried = numbers.groupBy(*by).applyInPandas(starts, f"{keys}, _segment long, _state array<double>")
    head = ", ".join(f"{c} {kinds[c]}" for c in (*by, order, *keep))
    return rows.groupBy(*by, "_segment").cogroup(carried.groupBy(*by, "_segment")).applyInPandas(run, f"{head}, {fold.schema}")


def unset(x: float) -> bool:
    return x != x


def drift_fold(leak: float = 0.03, gain: float = 0.056, long_run: float = 100.0) -> Fold:
    """`folds.drift`: level is affine, variance max-affine; the first row of a series starts both."""
    keep = 1 - leak

    def pushes(x: np.ndarray) -> tuple[list[float], list[float]]:
        x = np.nan_to_num(x)
        return (gain * x).tolist(), (leak * long_run + np.minimum(0.5 * np.abs(gain * x), 0.5 * long_run)).tolist()

    def passed(x: np.ndarray) -> tuple[float, ...]:
        up, wider = pushes(x)
        b, fresh = 0.0, float(np.nan_to_num(x[0]))
        c, d, floor, v = 1.0, 0.0, -math.inf, long_run  # variance: max(c x + d, floor)
        for t in range(len(x)):
            b = keep * b + up[t]
            c, d, floor = keep * c, keep * d + wider[t], max(keep * floor + wider[t], 1e-6)
            if t:
                fresh, v = keep * fresh + up[t], max(keep * v + wider[t], 1e-6)
        return keep ** len(x), b, fresh, c, d, floor, v

    def after(state: tuple, n: tuple) -> tuple:
        a, b, fresh, c, d, floor, v = n
        return (fresh, v) if unset(state[0]) else (a * state[0] + b, max(c * state[1] + d, floor))

    def run(state: tuple, x: np.ndarray) -> dict[str, np.ndarray]:
        level, variance = np.zeros(len(x)), np.zeros(len(x))
        (up, wider), (s, v) = pushes(x), state
        for t in range(len(x)):
            s, v = (float(np.nan_to_num(x[t])), long_run) if unset(s) else (keep * s + up[t], max(keep * v + wider[t], 1e-6))
            level[t], variance[t] = s, v
        return {"level": level, "variance": variance}

    return Fold((NAN, NAN), passed, after, run, "level double, variance double")


def mean_fold(alpha: float) -> Fold:
    """`folds.ewm`: seeded by the first value, kept by nulls."""

    def walk(m: float, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        for t, v in enumerate(x.tolist()):
            if v == v:
                m = v if unset(m) else m + alpha * (v - m)
            out[t] = m
        return out

    def passed(x: np.ndarray) -> tuple[float, ...]:
        own = x[~np.isnan(x)]
        weights = alpha * (1 - alpha) ** np.arange(len(own) - 1, -1, -1.0)
        return (1 - alpha) ** len(own), float(weights @ own), float(walk(NAN, own)[-1]) if len(own) else NAN

    return Fold((NAN,), passed, lambda s, n: (n[2],) if unset(s[0]) else (n[0] * s[0] + n[1],), lambda s, x: {"mean": walk(s[0], x)}, "mean double")


def moments_fold(half_life: float) -> Fold:
    """`folds.discounted_moments`: weight, mean and sum of squares of two stretches are joined, the earlier one discounted."""
    keep = half_life_factor(half_life)

    def walk(state: tuple, x: np.ndarray) -> tuple[tuple, np.ndarray, np.ndarray]:
        w, m, s = state
        mean, variance = np.full(len(x), NAN), np.full(len(x), NAN)
        for t, v in enumerate(x.tolist()):
            if v == v:
                before, w = keep * w, keep * w + 1
                step = v - m
                m += step / w
                s = keep * s + step * step * before / w
            if w > 0:
                mean[t], variance[t] = m, s / w
        return (w, m, s), mean, variance

    def passed(x: np.ndarray) -> tuple[float, ...]:
        return keep ** int((~np.isnan(x)).sum()), *walk((0.0, 0.0, 0.0), x)[0]

    def after(state: tuple, n: tuple) -> tuple:
        (w0, m0, s0), (fade, w1, m1, s1) = state, n
        if w1 == 0:
            return state
        w0, s0 = w0 * fade, s0 * fade
        w, apart = w0 + w1, m1 - m0
        return w, m0 + apart * w1 / w, s0 + s1 + apart * apart * w0 * w1 / w

    def run(state: tuple, x: np.ndarray) -> dict[str, np.ndarray]:
        _, mean, variance = walk(state, x)
        return {"mean": mean, "variance": variance}

    return Fold((0.0, 0.0, 0.0), passed, after, run, "mean double, variance double")


def ar1_fold(half_life: float, least: int = 8, ridge: float = 1e-8) -> Fold:
    """`folds.forgetting_ar1`: six discounted sums over pairs; the pair across a border is the following segment's oldest."""
    keep = half_life_factor(half_life)
    pair = lambda b, v: np.array([1.0, b, v, b * b, b * v, v * v])

    def passed(x: np.ndarray) -> tuple[float, ...]:
        own = x[~np.isnan(x)]
        if not len(own):
            return (0.0, NAN, NAN, *[0.0] * 7)
        b, v = own[:-1], own[1:]
        fade = keep ** np.arange(len(b) - 1, -1, -1.0)
        return float(len(own)), float(own[0]), float(own[-1]), keep ** len(b), *(float(fade @ c) for c in (np.ones(len(b)), b, v, b * b, b * v, v * v))

    def after(state: tuple, n: tuple) -> tuple:
        count, first, last, fade, *sums = n
        if not count:
            return state
        pairs, before, *old = state
        held = np.array(old)
        if not unset(before):
            held, pairs = keep * held + pair(before, first), pairs + 1
        return pairs + count - 1, last, *(held * fade + np.array(sums)).tolist()

    def run(state: tuple, x: np.ndarray) -> dict[str, np.ndarray]:
        n, before, w, sb, sx, sbb, sbx, sxx = state
        phi, se = np.full(len(x), NAN), np.full(len(x), NAN)
        for t, v in enumerate(x.tolist()):
            if v == v and before == before:
                w, sb, sx, sbb, sbx, sxx = keep * w + 1, keep * sb + before, keep * sx + v, keep * sbb + before * before, keep * sbx + before * v, keep * sxx + v * v
                n += 1
            before = v if v == v else before
            if n >= least and w >= 4:
                d = sbb - sb * sb / w + ridge
                slope = (sbx - sb * sx / w) / d
                rest = max(sxx - sx * sx / w - slope * (sbx - sb * sx / w), 0.0)
                phi[t], se[t] = slope, math.sqrt(rest / max(w - 2, 1.0) / d)
        return {"phi": phi, "se": se}

    return Fold((0.0, NAN, *[0.0] * 6), passed, after, run, "phi double, se double")


def step_fold(half_life: float = 252.0, most: float = 6.0) -> Fold:
    """A row's clipped return over the deviation before it, as in `kernels.block_level`; the level is the running sum of these."""
    keep = half_life_factor(half_life)

    def passed(x: np.ndarray) -> tuple[float, ...]:
        fade = (1 - keep) * keep ** np.arange(len(x) - 1, -1, -1.0)
        return keep ** len(x), float(fade @ np.nan_to_num(x) ** 2), float(fade.sum())

    def run(state: tuple, x: np.ndarray) -> dict[str, np.ndarray]:
        (v, w), out = state, np.zeros(len(x))
        for t, r in enumerate(np.nan_to_num(x).tolist()):
            sd = max(math.sqrt(v / w) if w > 1e-10 else 1.0, 1e-6)
            out[t] = min(max(r / sd, -most), most)
            v, w = keep * v + (1 - keep) * r * r, keep * w + (1 - keep)
        return {"step": out}

    return Fold((0.0, 0.0), passed, lambda s, n: (n[0] * s[0] + n[1], n[0] * s[1] + n[2]), run, "step double")


def sum_fold(name: str) -> Fold:
    return Fold((0.0,), lambda x: (float(np.nan_to_num(x).sum()),), lambda s, n: (s[0] + n[0],), lambda s, x: {name: s[0] + np.cumsum(np.nan_to_num(x))}, f"{name} double")


def levels(df: DataFrame, column: str, width: int, *by: str, order: str = "dt") -> DataFrame:
    """`kernels.block_level` in segments: the deviation first, then the running sum."""
    steps = in_segments(df, [column], step_fold(), width, *by, order=order)
    return in_segments(steps, ["step"], sum_fold("level"), width, *by, order=order)


def ranks(df: DataFrame, column: str, width: int, *by: str, order: str = "dt", buckets: int = 64) -> DataFrame:
    """(by, order, below, same, n): how many earlier values of column are less than a row's, equal to it, and in all.

    By divide and conquer over time and value. A row is ranked inside its own segment; against earlier segments, values in
    lower buckets count whole, by their number in each segment, and those of its own bucket are ranked there, by merging the
    runs of 2, 4, 8, ... segments: a row of the right half counts the left half's values under its own. Sparse neighbouring
    segments are taken together up to about RUN_ROWS rows, and many of these runs at a time; a series of no more rows is one
    run and is done then. A task holds a run, or one bucket of a series (its rows over `buckets`, and all rows of one value).
    Null and NaN values have no rank and count for none.
    """
    by = by or ("series",)
    kinds = dict(df.dtypes)
    rows = df.select(*by, order, F.col(column).cast("double").alias("_x"), segment_of(df, order, width).alias("_segment")).where("_x IS NOT NULL AND NOT isnan(_x)")
    head = ", ".join(f"{c} {kinds[c]}" for c in (*by, order))

    most = RUN_ROWS
    of = [F.col(c).alias(f"_of_{c}") for c in by]
    own_key = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in by]
    spread = rows.groupBy(*of).agg(F.count("*").alias("_rows"), F.min("_segment").alias("_least"), F.max("_segment").alias("_last"))
    step = F.greatest(F.floor((F.col("_last") - F.col("_least") + 1) * most / F.col("_rows")), F.lit(1))
    whole = F.col("_rows") <= most
    spread = spread.withColumn("_step", F.when(~whole, step)).withColumn("_whole", whole).drop("_rows", "_last")
    placed = rows.join(spread, own_key).withColumn("_stretch", F.when(F.col("_whole"), 0).otherwise(F.floor((F.col("_segment") - F.col("_least")) / F.col("_step"))).cast("long"))
    placed = placed.select(*by, order, "_x", "_segment", "_whole", "_stretch")

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Runs of whole segments, of a stretch's rows in order; the last one waits for the rest of its rows."""
        held: list[pd.DataFrame] = []

        def ranked_runs(last: bool) -> Iterator[pd.DataFrame]:
            own = pd.concat(held, ignore_index=True)
            held.clear()
            change = np.zeros(len(own), bool)
            for c in (*by, "_stretch"):
                codes = pd.factorize(own[c], use_na_sentinel=False)[0]
                change[1:] |= codes[1:] != codes[:-1]
            change[0] = True
            cut = change.copy()
            cut[1:] |= np.diff(own["_segment"].to_numpy()) != 0
            first = np.flatnonzero(cut)
            stretch = np.cumsum(change)[first]
            sizes = np.diff(np.append(first, len(own)))
            run, rows_in, starts = 0, 0, np.zeros(len(first), bool)
            for k, (n, at) in enumerate(zip(sizes.tolist(), stretch.tolist(), strict=True)):
                starts[k] = at != run or rows_in + n > most
                rows_in = n if starts[k] else rows_in + n
                run = at
            heads = first[starts]
            end = len(own) if last else int(heads[-1])
            if end < len(own):
                held.append(own.iloc[end:])
            if not end:
                return
            own, heads = own.iloc[:end], heads[heads < end]
            number = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, end)))
            place = np.arange(end) - heads[number]
            below, same = earlier_segments(place, own["_x"].to_numpy(float), number)
            yield own[[*by, order, "_x"]].assign(_segment=own["_segment"].to_numpy()[heads][number], _whole=own["_whole"], below=below, same=same, n=place)

        for batch in batches:
            if len(batch):
                held.append(batch)
            if sum(map(len, held)) > 2 * most:
                yield from ranked_runs(False)
        if held:
            yield from ranked_runs(True)

    runs = placed.repartition(*by, "_stretch").sortWithinPartitions(*by, "_stretch", order)
    done = written(runs.mapInPandas(inside, f"{head}, _x double, _segment long, _whole boolean, below long, same long, n long"), "ranks")
    first = done.where("NOT _whole").drop("_whole")
    edges = first.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_x", [k / buckets for k in range(1, buckets)], 10_000).alias("_edges"))
    bucket = F.size(F.filter("_edges", lambda e: F.col("_x") >= e))
    placed = first.join(edges.select(*of, "_edges"), own_key).withColumn("_bucket", bucket).drop("_edges", *[f"_of_{c}" for c in by])

    def across(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("_segment", kind="stable")
        segment, x = own["_segment"].to_numpy(), own["_x"].to_numpy(float)
        below, same = earlier_segments(segment, x)
        return own[[*by, order, "_segment", "_bucket"]].assign(below=own["below"].to_numpy() + below, same=own["same"].to_numpy() + same, n=own["n"])

    ranked = placed.groupBy(*by, "_bucket").applyInPandas(across, f"{head}, _segment long, _bucket int, below long, same long, n long")
    sizes = placed.groupBy(*by, "_segment", "_bucket").agg(F.count("*").alias("_size"))

    def totals(own: pd.DataFrame) -> pd.DataFrame:
        table = own.pivot_table(index="_segment", columns="_bucket", values="_size", fill_value=0).sort_index().sort_index(axis=1)
        before = table.cumsum().shift(1, fill_value=0)  # of earlier segments
        lower = before.cumsum(axis=1) - before  # of lower buckets
        long = lower.stack().rename("_lower").reset_index().merge(before.sum(axis=1).rename("_before").reset_index(), on="_segment")
        key = own.iloc[0]
        return long.assign(**{c: key[c] for c in by})[[*by, "_segment", "_bucket", "_lower", "_before"]]

    keys = ", ".join(f"{c} {kinds[c]}" for c in by)
    added = sizes.groupBy(*by).applyInPandas(totals, f"{keys}, _segment long, _bucket int, _lower long, _before long")
    added = added.select(*of, F.col("_segment").alias("_own_segment"), F.col("_bucket").alias("_own_bucket"), "_lower", "_before")
    out = ranked.join(added, [*own_key, F.col("_segment") == F.col("_own_segment"), F.col("_bucket") == F.col("_own_bucket")])
    out = out.select(*by, order, (F.col("below") + F.col("_lower")).alias("below"), "same", (F.col("n") + F.col("_before")).alias("n"))
    return done.where("_whole").select(out.columns).unionByName(out)


def earlier(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, how many before it are less, and how many equal: merging runs of doubling length."""
    return earlier_segments(np.arange(len(x)), x)


def earlier_segments(segment: np.ndarray, x: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each value, how many of earlier segments are less, and how many equal; segment rises.

    With group, which rises too, only values of the own group count, and segment numbers a group's segments from 0.
    """
    if group is not None:
        return _earlier_in_groups(segment, x, group)
    number = np.unique(segment, return_inverse=True)[1]
    return _merged(number, x, int(number[-1]).bit_length() if len(number) else 0, np.zeros(len(x), np.int64))


def _merged(number: np.ndarray, x: np.ndarray, bits: int, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`earlier_segments` in each lane, whose segments are numbered by so many bits."""
    below, same = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for level in range(bits):
        span = 1 << level
        pair = (lane << (bits - level - 1)) + number // (2 * span)
        right = (number // span) % 2 == 1
        order = np.lexsort((right, x, pair))  # by pair of runs, then by value, left before right
        starts = np.append(0, np.flatnonzero(np.diff(pair[order])) + 1)
        left = np.append(0, np.cumsum(~right[order]))
        base = np.repeat(left[starts], np.diff(np.append(starts, len(x))))
        upto = left[:-1] - base  # left values at or under a right one
        fresh = np.append(True, (np.diff(x[order]) != 0) | (np.diff(pair[order]) != 0))
        under = (left[:-1] - base)[np.maximum.accumulate(np.where(fresh, np.arange(len(x)), 0))]
        mine = right[order]
        below[order[mine]] += under[mine]
        same[order[mine]] += (upto - under)[mine]
    return below, same


def _earlier_in_groups(number: np.ndarray, x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """`earlier_segments` of many groups at once: those with as many segments as one another's power of 2 are taken together."""
    below, same = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    if not len(x):
        return below, same
    most = np.maximum.reduceat(number, np.flatnonzero(np.append(True, np.diff(group) != 0)))
    width = np.ceil(np.log2(most + 1)).astype(np.int64)
    of = width[np.append(0, np.cumsum(np.diff(group) != 0))]
    for bits in np.unique(of):
        rows = np.flatnonzero(of == bits)
        lane = np.append(0, np.cumsum(np.diff(group[rows]) != 0))
        below[rows], same[rows] = _merged(number[rows], x[rows], int(bits), lane)
    return below, same


def expanding_cdf(df: DataFrame, column: str, name: str, width: int, *by: str, order: str = "dt") -> DataFrame:
    """`folds.expanding_cdf` in segments: (by, order, name) of the rows that have a value."""
    r = ranks(df, column, width, *by, order=order)
    by = by or ("series",)
    return r.select(*by, order, F.when(F.col("n") > 0, (F.col("below") + 0.5 * F.col("same") + 0.5) / (F.col("n") + 1)).otherwise(0.5).alias(name))
