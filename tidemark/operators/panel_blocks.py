"""The factors of a panel in blocks of days that run side by side, as `kernels.factor_levels` makes them in one pass.

Discounted cross-moments are an associative scan: a block of days gives its decay and sums, matrix row by matrix row these are
composed in order, and every block starts from its own moments. When a memory renews its factors depends on its last renewal
only, at most LONGEST_WAIT days back, so each block works out, for the renewals that can be its first, which day comes next;
following these links is then a walk over whole numbers. Eigenvectors are made only on renewal days, each block its own; what
is left in order is choosing how many factors to keep and lining them up with the ones before, on renewal days alone. Densities
and scores are by block again, memory weights and levels are segments' affine steps. No task holds more than a block of days
and the wait after it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import kernels
from tidemark.operators.folds import half_life_factor
from tidemark.operators.segments import Fold, in_segments, step_fold, sum_fold
from tidemark.sources.staging import written

WAIT, WIDTH = kernels.LONGEST_WAIT, kernels.MOST_FACTORS


def numbered(days: DataFrame) -> DataFrame:
    """days (dt, ...), one row a date, with i, its place from 0; counted by months, so no task sorts all dates."""
    month = F.date_trunc("month", F.col("dt").cast("timestamp"))
    days = days.withColumn("_month", month)
    months = days.groupBy("_month").agg(F.count("*").alias("_n"))  # a row a month
    months = months.select("_month", (F.sum("_n").over(Window.orderBy("_month")) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_month").orderBy("dt")) - 1
    return days.join(months, "_month").withColumn("i", place.cast("long")).drop("_month", "_before")


def panel_days(rows: DataFrame, block: int) -> DataFrame:
    """(i, dt, block, z, ret, first): a day's values in the order of the instruments' names, and the day each was first seen."""
    names = rows.select("series").distinct().agg(F.array_sort(F.collect_set("series")).alias("names"))  # the panel's instruments: a few hundred
    days = rows.groupBy("dt").agg(F.map_from_entries(F.collect_list(F.struct("series", F.struct("z", "ret")))).alias("m"))
    days = numbered(days).join(names)
    of = lambda c: F.transform("names", lambda n: F.try_element_at("m", n)[c])
    days = days.select("i", "dt", F.floor(F.col("i") / block).cast("long").alias("block"), of("z").alias("z"), of("ret").alias("ret"))
    days = written(days, "days")
    seen = days.select("i", F.posexplode("z").alias("k", "v")).where("v IS NOT NULL AND NOT isnan(v)").groupBy("k").agg(F.min("i").alias("i"))
    first = seen.agg(F.map_from_entries(F.collect_list(F.struct("k", "i"))).alias("_seen"))
    out = days.join(first)
    return out.select("i", "dt", "block", "z", "ret", F.transform("z", lambda _, k: F.coalesce(F.try_element_at("_seen", k), F.lit(2**40))).alias("first"))


class Days:
    """The days of a block (and some after it) as arrays."""

    def __init__(self, own: pd.DataFrame) -> None:
        own = own.sort_values("i")
        self.i = own["i"].to_numpy()
        z = np.array([np.array(v, float) for v in own["z"]])
        self.seen = np.isfinite(z)
        self.z = np.where(self.seen, np.clip(np.nan_to_num(z), -6, 6), 0.0)
        first = np.array(own["first"].iloc[0])
        self.known = first[None] <= self.i[:, None]
        self.start = int(np.sort(first)[2]) if len(first) > 2 else 2**40  # the first day with three instruments

    def moments(self, life: float, start: dict | None):
        """For each day: its products and pairs so far, and the effective number of days; each a copy."""
        keep = half_life_factor(life)
        fresh = 1 - keep
        n = self.z.shape[1]
        s, w, filled = (np.zeros((n, n)), np.zeros((n, n)), 0.0) if start is None else (start["s"].copy(), start["w"].copy(), start["filled"])
        for z, seen, known in zip(self.z, self.seen.astype(float), self.known, strict=True):
            s = keep * s + fresh * np.outer(z, z)
            w = keep * w + fresh * np.outer(seen, seen)
            filled = keep * filled + fresh * seen.sum() / max(known.sum(), 1)
            yield s, w, min(max(filled / fresh, 1.0), 1 / fresh), filled


def _started(state: pd.DataFrame) -> dict | None:
    if not len(state):
        return None
    own = state.sort_values("row")
    body = own[own["row"] >= 0]
    return {"s": np.array([np.array(v) for v in body["s"]]), "w": np.array([np.array(v) for v in body["w"]]), "filled": float(own["s"].iloc[0][0])}


def block_starts(days: DataFrame, lives: tuple[float, ...]) -> DataFrame:
    """(life, block, row, s, w): each block's moments before its first day, a matrix row each; row -1 has the share of days filled."""

    def sums(own: pd.DataFrame) -> pd.DataFrame:
        days, out = Days(own), []
        for life in lives:
            for s, w, _, filled in days.moments(life, None):
                pass
            fade = half_life_factor(life) ** len(days.i)
            out += [(life, int(own["block"].iloc[0]), r, s[r].tolist(), w[r].tolist(), fade) for r in range(len(s))] + [(life, int(own["block"].iloc[0]), -1, [filled], [0.0], fade)]
        return pd.DataFrame(out, columns=["life", "block", "row", "s", "w", "fade"])

    def scan(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("block")
        s = w = 0.0
        out = []
        for life, block, row, s1, w1, fade in own.itertuples(index=False):
            if not np.isscalar(s):
                out.append((life, block, row, s.tolist(), w.tolist()))
            s, w = fade * s + np.array(s1), fade * w + np.array(w1)
        return pd.DataFrame(out, columns=["life", "block", "row", "s", "w"])

    parts = days.groupBy("block").applyInPandas(sums, "life double, block long, row int, s array<double>, w array<double>, fade double")
    return parts.groupBy("life", "row").applyInPandas(scan, "life double, block long, row int, s array<double>, w array<double>")


def renewals(days: DataFrame, starts: DataFrame, lives: tuple[float, ...], block: int) -> DataFrame:
    """(life, i, next): the days on which each memory's factors are renewed, and the following one (null at the end)."""

    def links(key: tuple, own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        life, number = key
        days = Days(own)
        last, first = (number + 1) * block - 1, number * block
        held = [(kernels.correlation(s, w), t_eff) for s, w, t_eff, _ in days.moments(life, _started(state))]
        norms = [max(float(np.linalg.norm(c)), kernels.TINY) for c, _ in held]
        at = {int(i): k for k, i in enumerate(days.i)}
        out: dict[int, int | None] = {}
        entries = [i for i in range(first, first + WAIT) if i > days.start] + ([days.start] if first <= days.start <= last else [])
        for entry in entries:
            r = entry
            while r is not None and r <= last and r in at and r not in out:
                found = None
                for t in range(r + 1, r + WAIT + 1):
                    if t not in at:
                        break
                    k = at[t]
                    if t - r < kernels.shortest_wait(int(days.known[k].sum())):
                        continue
                    if t - r >= WAIT or np.linalg.norm(held[k][0] - held[at[r]][0]) / norms[at[r]] >= 1 / np.sqrt(held[k][1]):
                        found = t
                        break
                out[r], r = found, found
        return pd.DataFrame({"life": [life] * len(out), "i": list(out), "next": pd.array(list(out.values()), "Int64"), "start": [days.start] * len(out)})

    def walk(own: pd.DataFrame) -> pd.DataFrame:
        nexts = {int(i): None if pd.isna(n) else int(n) for i, n in zip(own["i"], own["next"], strict=True)}
        at, path = int(own["start"].iloc[0]), []
        while at in nexts:
            path.append((own["life"].iloc[0], at, nexts[at]))
            at = nexts[at]
        return pd.DataFrame({"life": [p[0] for p in path], "i": [p[1] for p in path], "next": pd.array([p[2] for p in path], "Int64")})

    made = _by_life(_with_next(days, block), lives).groupBy("life", "block").cogroup(starts.groupBy("life", "block")).applyInPandas(links, "life double, i long, next long, start long")
    return made.groupBy("life").applyInPandas(walk, "life double, i long, next long")


def _with_next(days: DataFrame, block: int) -> DataFrame:
    """days, those of the first WAIT days of a block in the block before too."""
    own = F.when((F.col("i") % block < WAIT) & (F.col("block") > 0), F.array(F.col("block"), F.col("block") - 1)).otherwise(F.array("block"))
    return days.withColumn("block", F.explode(own))


def _by_life(days: DataFrame, lives: tuple[float, ...]) -> DataFrame:
    return days.withColumn("life", F.explode(F.array(*[F.lit(float(v)) for v in lives])))


def renewed_factors(days: DataFrame, starts: DataFrame, renewed: DataFrame, lives: tuple[float, ...], block: int) -> DataFrame:
    """(life, i, next, vectors, values, bulk, explained, t_eff) of every renewal; vectors is a flat array of instruments x factors.

    explained is the factors' share of all variance, t_eff how many days the memory is worth.
    """
    marked = _by_life(days, lives).join(renewed, ["life", "i"], "left").withColumn("renews", F.col("next").isNotNull())
    marked = marked.join(renewed.select("life", "i", F.lit(True).alias("_own")), ["life", "i"], "left").withColumn("renews", F.coalesce("_own", F.lit(False))).drop("_own")

    def spectra(key: tuple, own: pd.DataFrame, state: pd.DataFrame) -> pd.DataFrame:
        days, own = Days(own), own.sort_values("i")
        out = []
        for k, (s, w, t_eff, _) in enumerate(days.moments(key[0], _started(state))):
            if own["renews"].iloc[k]:
                known = np.flatnonzero(days.known[k])
                values, vectors = kernels.spectrum(kernels.correlation(s, w)[np.ix_(known, known)])
                whole = np.zeros((len(s), vectors.shape[1]))
                whole[known] = vectors
                out.append((key[0], int(days.i[k]), own["next"].iloc[k], t_eff, values.tolist(), whole.ravel().tolist()))
        made = pd.DataFrame(out, columns=["life", "i", "next", "t_eff", "values", "vectors"])
        made["next"] = pd.array([None if pd.isna(v) else int(v) for v in made["next"]], "Int64")
        return made

    def lined_up(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("i")
        old, out = None, []
        for life, i, following, t_eff, values, vectors in own.itertuples(index=False):
            values, vectors = np.array(values), np.array(vectors)
            width = min(len(values), WIDTH)
            vectors = vectors.reshape(-1, width)
            old = np.zeros((len(vectors), 0)) if old is None else old
            # The instruments known on that day are the rows that can be other than zero.
            found, kept, bulk = kernels.kept_factors(values, vectors, t_eff, old.shape[1])
            order, sign = kernels.aligned(found, old)
            old = found[:, order] * sign
            out.append((life, i, following, old.ravel().tolist(), kept[order].tolist(), bulk, float(kept.sum()) / len(values), t_eff))
        made = pd.DataFrame(out, columns=["life", "i", "next", "vectors", "values", "bulk", "explained", "t_eff"])
        made["next"] = pd.array([None if pd.isna(v) else int(v) for v in made["next"]], "Int64")
        return made

    spectra_rows = marked.groupBy("life", "block").cogroup(starts.groupBy("life", "block")).applyInPandas(spectra, "life double, i long, next long, t_eff double, values array<double>, vectors array<double>")
    return spectra_rows.groupBy("life").applyInPandas(lined_up, "life double, i long, next long, vectors array<double>, values array<double>, bulk double, explained double, t_eff double")


def day_scores(days: DataFrame, factors: DataFrame, lives: tuple[float, ...], block: int) -> DataFrame:
    """(i, dt, and by memory: density_k, k_k, market_k, explained_k, t_eff_k, scores_k): what each memory says of each day.

    market is the return of the first factor's portfolio known the day before, the mean return without one.
    """
    last = F.coalesce(F.col("next"), F.col("i") + WAIT)
    placed = factors.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor(last / block))))
    names = [f"{c}_{k}" for k in range(len(lives)) for c in ("density", "k", "market", "explained", "t_eff")]

    def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own):  # factors of the last days, whose next block has none
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("i", "dt", *names, *(f"scores_{m}" for m in range(len(lives))))})
        days, own = Days(own), own.sort_values("i")
        ret = np.array([np.array(v, float) for v in own["ret"]])
        n = days.z.shape[1]
        out = {c: np.zeros(len(days.i)) for c in names}
        scores = [np.zeros((len(days.i), WIDTH)) for _ in lives]
        none = (np.zeros((n, 0)), np.zeros(0), 1.0, 0.0, 0.0)
        for m, life in enumerate(lives):
            mine = held[held["life"] == life].sort_values("i")
            sets = [(int(i), (np.array(v).reshape(n, -1), np.array(x), b, e, w)) for i, v, x, b, e, w in zip(*(mine[c] for c in ("i", "vectors", "values", "bulk", "explained", "t_eff")), strict=True)]
            at, now = 0, none
            for t, i in enumerate(days.i):
                z, mask = days.z[t], days.seen[t]
                while at < len(sets) and sets[at][0] < i:
                    now, at = sets[at][1], at + 1
                seen = int(mask.sum())
                out[f"density_{m}"][t] = kernels.factor_density(*now[:3], z, seen) / max(seen, 1) if i else 0.0
                own_mean = float(np.nanmean(ret[t][mask])) if mask.any() and np.isfinite(ret[t][mask]).any() else 0.0
                if now[0].shape[1] and mask.any():
                    part = now[0][:, 0] * mask
                    size = float(np.abs(part).sum())
                    own_mean = float(np.nan_to_num(ret[t]) @ part / size) if size > kernels.TINY else 0.0
                out[f"market_{m}"][t] = own_mean
                while at < len(sets) and sets[at][0] <= i:
                    now, at = sets[at][1], at + 1
                k = now[0].shape[1]
                out[f"k_{m}"][t], out[f"explained_{m}"][t], out[f"t_eff_{m}"][t] = k, now[3], now[4]
                if k:
                    scores[m][t, :k] = kernels.factor_scores(now[0], now[1], z, mask)
        return pd.DataFrame({"i": days.i, "dt": own["dt"].to_numpy()} | out | {f"scores_{m}": list(s) for m, s in enumerate(scores)})

    kind = dict(days.dtypes)["dt"]
    schema = f"i long, dt {kind}, " + ", ".join(f"{c} double" for c in names) + ", " + ", ".join(f"scores_{m} array<double>" for m in range(len(lives)))
    return days.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(run, schema)


def weights_fold(n: int, keep: float = kernels.FORGET) -> Fold:
    """n discounted sums: x -> keep x + d."""

    def passed(*d: np.ndarray) -> tuple[float, ...]:
        fade = keep ** np.arange(len(d[0]) - 1, -1, -1.0)
        return keep ** len(d[0]), *(float(fade @ v) for v in d)

    def run(state: tuple, *d: np.ndarray) -> dict[str, np.ndarray]:
        x, out = np.array(state), np.zeros((len(d[0]), n))
        for t, row in enumerate(np.column_stack(d)):
            x = keep * x + row
            out[t] = x
        return {f"log_{k}": out[:, k] for k in range(n)}

    return Fold((0.0,) * n, passed, lambda s, p: tuple(p[0] * a + b for a, b in zip(s, p[1:], strict=True)), run, ", ".join(f"log_{k} double" for k in range(n)))


def sums_fold(n: int) -> Fold:
    return Fold(
        (0.0,) * n, lambda *x: tuple(float(v.sum()) for v in x), lambda s, p: tuple(a + b for a, b in zip(s, p, strict=True)),
        lambda s, *x: {"levels": list(np.array(s) + np.cumsum(np.column_stack(x), axis=0))}, "levels array<double>",
    )


class Panel:
    """The factors of standardised rows (series, dt, z, ret), step by step written, in blocks of days."""

    def __init__(self, rows: DataFrame, lives: tuple[float, ...] = kernels.MEMORY_LIVES, block: int = 128) -> None:
        if block < WAIT:
            raise ValueError(f"a block has at least {WAIT} days")
        self.lives, self.block = lives, block
        self.names = rows.select("series").distinct().agg(F.array_sort(F.collect_set("series")).alias("names"))
        self.days = panel_days(rows, block)
        starts = written(block_starts(self.days, lives), "starts")
        renewed = written(renewals(self.days, starts, lives, block), "renewals")
        self.factors = written(renewed_factors(self.days, starts, renewed, lives, block), "factors")
        scored = written(day_scores(self.days, self.factors, lives, block).withColumn("series", F.lit("panel")), "scores")
        m = range(len(lives))
        logs = in_segments(scored, [f"density_{k}" for k in m], weights_fold(len(lives)), block, order="i")
        most = F.greatest(*[f"log_{k}" for k in m]) if len(lives) > 1 else F.col("log_0")
        best = F.coalesce(*[F.when(F.col(f"log_{k}") == most, k) for k in m])
        picked = scored.join(logs.select("i", best.alias("best")), "i")
        chosen = lambda c, of: F.get(F.array(*[F.col(f"{c}_{k}") for k in m]), F.col(of))
        # The day before's choice, by number, so that no window holds all days
        before = picked.select((F.col("i") + 1).alias("i"), F.col("best").alias("_then"))
        picked = picked.join(before, "i", "left").withColumn("_then", F.coalesce("_then", F.lit(0)))
        picked = picked.select("series", "i", "dt", "best", chosen("k", "best").cast("long").alias("k"), chosen("market", "_then").alias("market"), chosen("explained", "best").alias("explained"), chosen("t_eff", "best").alias("t_eff"), F.get(F.array(*[F.lit(float(v)) for v in lives]), F.col("best")).alias("memory"), chosen("scores", "best").alias("scores"))
        self.picked = written(picked, "picked")

    def levels(self) -> DataFrame:
        """(dt, levels, k, market, explained, t_eff, memory): levels and k as `kernels.factor_levels` has them.

        market is the return of the first factor's portfolio as it was known the day before, memory the half-life of the memory
        in use, explained and t_eff those of its factors.
        """
        wide = self.picked.select("series", "i", *[F.get("scores", F.lit(j)).alias(f"score_{j}") for j in range(WIDTH)])
        level = in_segments(wide, [f"score_{j}" for j in range(WIDTH)], sums_fold(WIDTH), self.block, order="i")
        return self.picked.join(level.select("i", "levels"), "i").select("dt", "levels", "k", "market", "explained", "t_eff", "memory")

    def parts(self, every: int = 21) -> DataFrame:
        """(dt, factor, series, part) on every so many days and the last: what each instrument has added to each level.

        A day's score is a sum over instruments, whatever the basis of the day, so their running sums add up to the level.
        """
        lives, block = self.lives, self.block
        last = F.coalesce(F.col("next"), F.col("i") + WAIT)
        placed = self.factors.withColumn("block", F.explode(F.sequence(F.floor(F.col("i") / block), F.floor(last / block))))
        end = self.days.agg(F.max("i").alias("_last"))  # one row
        days = self.days.join(self.picked.select("i", "best"), "i").join(end)

        def run(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            columns = ["block", "dt", "factor", "parts", "total"]
            if not len(own):
                return pd.DataFrame({c: pd.Series([], dtype=object) for c in columns})
            days, own = Days(own), own.sort_values("i")
            n = days.z.shape[1]
            sets = {m: [(int(i), np.array(v).reshape(n, -1), np.array(x)) for i, v, x in held[held["life"] == life].sort_values("i")[["i", "vectors", "values"]].itertuples(index=False)] for m, life in enumerate(lives)}
            sums, out = np.zeros((WIDTH, n)), []
            for i, dt, best, final, z, mask in zip(days.i, own["dt"], own["best"], own["_last"], days.z, days.seen, strict=True):
                now = next((f for f in reversed(sets[int(best)]) if f[0] <= i), None)
                if now is not None:
                    sums[: now[1].shape[1]] += kernels.score_parts(now[1], now[2], z, mask)
                if i % every == 0 or i == final:
                    out += [(int(own["block"].iloc[0]), dt, j, sums[j].tolist(), False) for j in range(WIDTH) if sums[j].any()]
            out += [(int(own["block"].iloc[0]), own["dt"].iloc[-1], j, sums[j].tolist(), True) for j in range(WIDTH)]
            return pd.DataFrame(out, columns=columns)

        kind = dict(days.dtypes)["dt"]
        made = written(days.groupBy("block").cogroup(placed.groupBy("block")).applyInPandas(run, f"block long, dt {kind}, factor int, parts array<double>, total boolean"), "parts")

        def scan(own: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values("block")
            upto = np.cumsum(np.array(own["parts"].tolist()), axis=0)
            return pd.DataFrame({"block": own["block"] + 1, "factor": own["factor"], "_start": list(upto)})

        starts = made.where("total").groupBy("factor").applyInPandas(scan, "block long, factor int, _start array<double>")
        # A factor without a part in its own block yet still has those of the blocks before
        asked = made.where("NOT total").select("block", "dt").distinct()
        whole = asked.join(F.broadcast(starts), "block", "left").select("block", "dt", "factor", "_start").where("factor IS NOT NULL")  # a row a block and factor
        rows = whole.join(made.where("NOT total"), ["block", "dt", "factor"], "full")
        total = F.when(F.col("_start").isNull(), F.col("parts")).when(F.col("parts").isNull(), F.col("_start")).otherwise(F.zip_with("parts", "_start", lambda a, b: a + b))
        rows = rows.select("dt", "factor", total.alias("parts")).join(self.names)
        return rows.select("dt", "factor", F.inline(F.arrays_zip(F.col("names").alias("series"), F.col("parts").alias("part"))))


def panel_factors(rows: DataFrame, lives: tuple[float, ...] = kernels.MEMORY_LIVES, block: int = 128) -> DataFrame:
    """`Panel.levels` of standardised rows (series, dt, z, ret), in blocks of days, each at least LONGEST_WAIT long."""
    return Panel(rows, lives, block).levels()


def block_parts(rows: DataFrame, blocks: DataFrame, width: int) -> DataFrame:
    """(block, dt, series, part): what each member of rows (series, dt, z) has added to its block's level (blocks: series, block).

    A day's step is shared out in proportion to the members' z, so that parts add up to the level, clipped days too.
    """
    own = rows.join(blocks, "series").select("block", "series", "dt", "z")
    means = own.groupBy("block", "dt").agg(F.avg("z").alias("mean"), F.count("z").alias("n"))  # days without a value age the deviation
    own = own.where("z IS NOT NULL")
    steps = in_segments(means, ["mean"], step_fold(), width, "block", keep=("mean", "n"))
    share = F.when(F.col("mean") != 0, F.col("z") / F.col("n") / F.col("mean") * F.col("step")).otherwise(0.0)
    return in_segments(own.join(steps, ["block", "dt"]).withColumn("share", share), ["share"], sum_fold("part"), width, "block", "series")
