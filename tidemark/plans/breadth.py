"""Queries of the view bank and its breadth, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.scalar import fixed
from tidemark.operators import scores, stats, views
from tidemark.operators import windows as w
from tidemark.plans.catalogue import ATR, TR, deviation_sql
from tidemark.plans.registry import BARS, LAG, PANEL, over, query, r, z_sql
from tidemark.sources import tables as src

DAY_BARS = """bars AS (SELECT 'target' AS series, CAST(o_orderdate AS DATE) AS dt, arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
  arg_max(o_totalprice, o_orderkey) AS close, count(*)::DOUBLE AS volume FROM orders GROUP BY 2)"""


def sma_sql(x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(f'{n - 1} PRECEDING')} >= {n} THEN avg({x}) {over(f'{n - 1} PRECEDING')} END"


def sigmoid_sql(x: str, s: float = 1.5) -> str:
    return f"(2 / (1 + exp(-({x}) / {s})) - 1)"


def strength_sql(n: int, roc: int, tag: str = "") -> str:
    """CTEs from bars and e (true range) to parts{tag} (series, dt, close, momentum, structure, flow)."""
    z = lambda x: z_sql(x, n)
    return f"""a{tag} AS (SELECT bars.*, e.m AS atr, close - lag(close) {LAG} AS d1, lag(close) {LAG} AS c1, close - lag(close, 5) {LAG} AS d5, {sma_sql('close', 5)} AS m5, {sma_sql('close', n)} AS mn, {sma_sql('volume', n)} AS vn,
  close / lag(close, {roc}) {LAG} - 1 AS rc, (high + low + close) / 3 * volume AS mf FROM bars JOIN e USING (series, dt)),
b{tag} AS (SELECT *, coalesce(volume / vn, 1) AS vr, CASE WHEN d1 / c1 > 0.0033 THEN 1.0 WHEN d1 / c1 < -0.0033 THEN -1.0 ELSE 0.0 END::DOUBLE AS st, d5 - lag(d5, 5) {LAG} AS dd5,
  avg(CASE WHEN d1 > 0 THEN mf ELSE 0 END) {over(f'{n - 1} PRECEDING')} AS up, avg(CASE WHEN d1 < 0 THEN mf ELSE 0 END) {over(f'{n - 1} PRECEDING')} AS dn FROM a{tag}),
c{tag} AS (SELECT *, {sma_sql('((high + low) / 2 - open) * vr', n)} - {sma_sql('d5 * vr', n)} AS mi, sum(st) {over('UNBOUNDED PRECEDING')} AS wk, coalesce(CASE WHEN up + dn <> 0 THEN 2 * (up / (up + dn) - 0.5) END, 0) AS ac FROM b{tag}),
d{tag} AS (SELECT *, wk - {sma_sql('wk', n)} AS rg FROM c{tag}),
parts{tag} AS (SELECT series, dt, close, {sigmoid_sql(z('rc'))} AS momentum, ({sigmoid_sql(z('mi'))} + {sigmoid_sql(f"({z('(m5 - mn)')} + {z('dd5')} + {z('(d5 / nullif(atr, 0))')} + {z('(close - mn)')}) / 2")}) / sqrt(2) AS structure,
  (ac + {sigmoid_sql(z('rg'))}) / sqrt(2) AS flow FROM d{tag})"""


@query(f"WITH RECURSIVE {BARS}, {TR}, {ATR}, {strength_sql(14, 12)} SELECT series, dt, {r('momentum')} AS momentum, {r('structure')} AS structure, {r('flow')} AS flow, {r(sigmoid_sql('momentum + structure + flow', 1))} AS strength FROM parts")
def d01_strength(spark, d):
    out = scores.strength(src.bars_hourly(spark, d))
    return out.select("series", "dt", *[fixed(F.col(c)).alias(c) for c in ("momentum", "structure", "flow", "strength")])


@query(f"WITH RECURSIVE {BARS}, {TR}, {ATR}, {strength_sql(8, 7)} SELECT series, dt, {r(sigmoid_sql('momentum', 1))} AS momentum, {r(sigmoid_sql('momentum + flow', 1))} AS both FROM parts")
def d01_strength_parts(spark, d):
    parts = scores.strength_parts(src.bars_hourly(spark, d), [(8, 7)])
    return parts.select("series", "dt", fixed(scores.strength_of(("momentum",))).alias("momentum"), fixed(scores.strength_of(("momentum", "flow"))).alias("both"))


@query("""WITH g AS (WITH n AS (SELECT unnest([8, 14, 22, 34, 52]) AS n), k AS (SELECT n, greatest(5, round_even(0.85 * n, 0)::INT) AS roc FROM n)
SELECT n || '-drivers' AS name, n AS length, roc, true AS macro, 'momentum,structure,flow' AS parts FROM k UNION ALL SELECT n || '-price', n, roc, false, 'momentum,structure,flow' FROM k
UNION ALL SELECT n || '-' || p, n, roc, true, p FROM k, (SELECT unnest(['momentum', 'structure', 'flow']) AS p) WHERE n = 22 UNION ALL SELECT '8-momentum-price', n, roc, false, 'momentum' FROM k WHERE n = 8 UNION ALL SELECT '52-flow-price', n, roc, false, 'flow' FROM k WHERE n = 52),
t AS (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM orders) SELECT g.*, greatest(days - length + 1, 0)::BIGINT AS n_rows FROM g, t""")
def d04_view_grid(spark, d):
    """The views and how many rows of the target each can look back from."""
    rows = [(v.name, v.length, v.roc, v.macro, ",".join(v.parts)) for v in views.view_grid()]
    grid = spark.createDataFrame(rows, "name string, length int, roc int, macro boolean, parts string")
    days = src.target_daily(spark, d).agg(F.countDistinct("dt").alias("_n"))
    return grid.join(days).select(*grid.columns, F.greatest(F.col("_n") - F.col("length") + 1, F.lit(0)).alias("n_rows"))


SMALL_GRID = [views.View("8-drivers", 8, 7, True), views.View("8-price", 8, 7, False), views.View("8-flow", 8, 7, True, ("flow",))]


def _bank(spark, d):
    return views.analysed(src.bars_daily(spark, d), src.panel_daily(spark, d), SMALL_GRID)


BANK = f"""{PANEL}, {DAY_BARS}, {TR}, {ATR}, {strength_sql(8, 7)}, target AS (SELECT series, dt, close AS px FROM bars), {deviation_sql(8)},
dv AS (SELECT dt, quality, signal FROM sig), bank AS (SELECT v.series, p.dt, close, CASE WHEN v.onlyflow THEN {sigmoid_sql('flow', 1)} ELSE {sigmoid_sql('momentum + structure + flow', 1)} END AS m, CASE WHEN v.macro THEN coalesce(signal, 0) ELSE 0.0 END AS d, CASE WHEN v.macro THEN coalesce(quality, 0) ELSE 0.0 END AS q
  FROM parts p LEFT JOIN dv USING (dt) CROSS JOIN (VALUES ('8-drivers', true, false), ('8-price', false, false), ('8-flow', true, true)) AS v(series, macro, onlyflow)),
w1 AS (SELECT *, abs(m)^8 AS cs, (abs(d) * q)^8 AS cd, m * d AS ag FROM bank), w2 AS (SELECT *, (0.5 * cs / (cs + cd + 0.001)) / (0.5 * cs / (cs + cd + 0.001) + 0.5 + 0.5 * cd / (cs + cd + 0.001)) AS wt FROM w1),
un AS (SELECT series, dt, close, m, d, q, ag, wt, 10 * greatest(least((wt * m + (1 - wt) * d) * CASE WHEN ag > 0 THEN 1 + 0.2 * abs(ag) ELSE 1 - 0.1 * abs(ag) END, 1), -1) AS osc FROM w2)"""


@query(f"""WITH RECURSIVE {BANK}, l AS (SELECT *, lag(osc) {LAG} AS b, lag(close) {LAG} AS c1 FROM un)
SELECT series, dt, {r('wt', 4)} AS weight, {r('ag', 4)} AS agreement, {r('osc', 4)} AS oscillator, CASE WHEN osc < -1 THEN 'Oversold' WHEN osc > 1 THEN 'Overbought' ELSE 'Neutral' END AS condition, ag > 0.3 AND osc < -1 AS buy, ag > 0.3 AND osc > 1 AS sell,
coalesce(osc > b AND close < c1 AND osc < -1, false) AS bullish, coalesce(osc < b AND close > c1 AND osc > 1, false) AS bearish FROM l""")
def d03_view_analysis(spark, d):
    bank = _bank(spark, d).select("series", "dt", "close", "strength", "deviation", "quality")
    out = views.blend(bank, low=-1.0, high=1.0)
    return out.select("series", "dt", *[fixed(F.col(c), 4).alias(c) for c in ("weight", "agreement", "oscillator")], "condition", "buy", "sell", "bullish", "bearish")


@query()
def d05_view_bank(spark, d):
    """All fifteen views with their regimes, weighted by skill and reduced to breadth by date."""
    bars = src.bars_daily(spark, d)
    bank = views.with_regimes(views.analysed(bars, src.panel_daily(spark, d), views.view_grid())).persist()
    weights = views.view_weights(bank, bars.select("dt", F.col("close").alias("px")))
    return views.breadth(bank.withColumnRenamed("weight", "blend_weight").join(weights, ["series", "dt"]))


CALLS = f"""ca AS (SELECT s.series, o.dt, y, lag(osc, 10) OVER (PARTITION BY s.series ORDER BY o.dt) AS call, row_number() OVER (PARTITION BY s.series ORDER BY o.dt) AS k FROM (SELECT DISTINCT series FROM un) s CROSS JOIN (SELECT dt, px / lag(px, 10) {LAG} - 1 AS y FROM target) o LEFT JOIN un ON un.series = s.series AND un.dt = o.dt),
g AS (SELECT *, CASE WHEN y IS NOT NULL AND y <> 0 THEN coalesce(sign(call) * sign(y), 0) END AS a FROM ca)"""


@query(f"""WITH RECURSIVE {BANK}, {CALLS},
sk(series, k, dt, m, w, q) AS (SELECT series, 0::BIGINT, NULL::DATE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM g WHERE k = 1 UNION ALL
 SELECT g.series, g.k, g.dt, CASE WHEN a IS NULL THEN m ELSE (0.5^(1/252.0) * w * m + a) / (0.5^(1/252.0) * w + 1) END, CASE WHEN a IS NULL THEN w ELSE 0.5^(1/252.0) * w + 1 END, CASE WHEN a IS NULL THEN q ELSE 0.5^(2/252.0) * q + 1 END FROM g JOIN sk ON g.series = sk.series AND g.k = sk.k + 1),
x AS (SELECT dt, series, exp(0.5 * sqrt(CASE WHEN q > 0 THEN w * w / q ELSE 0 END) * m) AS x FROM sk WHERE k > 0), v AS (SELECT dt, series, 0.94 * x / sum(x) OVER (PARTITION BY dt) + 0.02 AS w FROM x), sw AS (SELECT dt, series, 1 + 0.5 * (3 * w - 1) AS w FROM v)
SELECT dt, series, {r('3 * w / sum(w) OVER (PARTITION BY dt)', 5)} AS weight FROM sw""")
def r28_view_weights(spark, d):
    bank = _bank(spark, d).select("series", "dt", "oscillator")
    prices = src.bars_daily(spark, d).select("dt", F.col("close").alias("px"))
    return views.view_weights(bank, prices).select("dt", "series", fixed(F.col("weight"), 5).alias("weight"))


ROWS = f"""z AS (SELECT series, dt, px, {r(z_sql('px', 20))} AS z FROM panel), v AS (SELECT *, lag(z) {LAG} AS b, lag(px) {LAG} AS p, CASE WHEN day(dt) % 6 > 0 THEN 1 + (ascii(right(series, 1)) - 48) / 10 END AS weight FROM z),
x AS (SELECT dt, 3 * z AS osc, CASE WHEN z < -1 THEN 'Oversold' WHEN z > 1 THEN 'Overbought' ELSE 'Neutral' END AS cond, z < -2 AS buy, z > 2 AS sell, coalesce(z > b AND px < p AND z < -1, false) AS bull, coalesce(z < b AND px > p AND z > 1, false) AS bear,
 CASE WHEN z > 2.5 THEN 'TRANSITION' WHEN z > 1.5 THEN 'BULL' WHEN z > 0.5 THEN 'WEAK_BULL' WHEN z < -1.5 THEN 'BEAR' WHEN z < -0.5 THEN 'WEAK_BEAR' ELSE 'NEUTRAL' END AS reg, CASE WHEN abs(z) > 2 THEN 'EXTREME' WHEN abs(z) > 1 THEN 'HIGH' WHEN abs(z) > 0.5 THEN 'NORMAL' ELSE 'LOW' END AS vol, z > 2.5 AS change, coalesce(weight, 1) AS w FROM v)"""


def _count(test: str) -> str:
    return f"sum(CASE WHEN {test} THEN w ELSE 0 END)"


_COUNTS = {
    "oversold": "cond = 'Oversold'", "overbought": "cond = 'Overbought'", "neutral": "cond = 'Neutral'", "buys": "buy", "sells": "sell", "bullish_divergences": "bull", "bearish_divergences": "bear", "rising": "contains(reg, 'BULL')",
    "falling": "contains(reg, 'BEAR')", "turning": "reg = 'TRANSITION'", "wide": "vol IN ('HIGH', 'EXTREME')", "narrow": "vol = 'LOW'", "changes": "change", "level": "reg = 'NEUTRAL'",
}
_PCT = ("oversold", "overbought", "neutral", "rising", "falling", "wide", "narrow")
_MEANS = {"mean_oscillator": "osc", "mean_strength": "osc", "mean_deviation": "-osc", "mean_bull": "osc / 30", "mean_bear": "-osc / 30"}


@query(f"""WITH {PANEL}, {ROWS} SELECT dt, count(*) AS n_views, {', '.join(f"{r(_count(t), 4)} AS {c}" for c, t in _COUNTS.items())}, {r('sum(osc * w)', 8)} AS sum_oscillator,
{', '.join(f"{r(f'sum(({x}) * w) / sum(w)', 5)} AS {c}" for c, x in _MEANS.items())}, {', '.join(f"{r(f'{_count(_COUNTS[c])} / count(*) * 100', 4)} AS {c}_pct" for c in _PCT)} FROM x GROUP BY dt""")
def a01_breadth(spark, d):
    z = F.col("z")
    df = src.panel_daily(spark, d).select("series", "dt", "px", fixed(w.causal_z(F.col("px"), 20)).alias("z"))
    bullish, bearish = views.divergence(z, F.col("px"), -1.0, 1.0)
    regime = F.when(z > 2.5, "TRANSITION").when(z > 1.5, "BULL").when(z > 0.5, "WEAK_BULL").when(z < -1.5, "BEAR").when(z < -0.5, "WEAK_BEAR").otherwise("NEUTRAL")
    width = F.when(F.abs(z) > 2, "EXTREME").when(F.abs(z) > 1, "HIGH").when(F.abs(z) > 0.5, "NORMAL").otherwise("LOW")
    weight = F.when(F.dayofmonth("dt") % 6 > 0, 1 + (F.ascii(F.right("series", F.lit(1))) - 48) / 10)
    rows = df.select("dt", (3 * z).alias("oscillator"), views.condition(z, -1.0, 1.0).alias("condition"), (z < -2).alias("buy"), (z > 2).alias("sell"), bullish.alias("bullish"), bearish.alias("bearish"), regime.alias("regime"), width.alias("volatility"), (z > 2.5).alias("change"), (0.3 * z).alias("strength"), (-0.3 * z).alias("deviation"), (z / 10).alias("bull"), (-z / 10).alias("bear"), weight.alias("weight"))
    out = views.breadth(rows)
    return out.select("dt", "n_views", *[fixed(F.col(c), 8 if c == "sum_oscillator" else 5 if c in _MEANS else 4).alias(c) for c in out.columns if c not in ("dt", "n_views")])


@query(f"""WITH RECURSIVE {BANK}, pa AS (SELECT a.series AS a, b.series AS b, corr(a.osc, b.osc) AS r FROM un a JOIN un b USING (dt) GROUP BY 1, 2), q AS (SELECT a, CASE WHEN a = b THEN 1.0 ELSE coalesce(r, 0) END AS r FROM pa)
SELECT count(DISTINCT a) AS n_views, {r('count(DISTINCT a)^2 / sum(r^2)', 4)} AS n_effective FROM q""")
def a08_unlike_views(spark, d):
    return views.common_count(_bank(spark, d)).withColumn("n_effective", fixed(F.col("n_effective"), 4))


EMB = "m AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS k FROM embeddings WHERE embedding IS NOT NULL)"


@query(f"WITH {EMB}, p AS (SELECT a.k AS a, b.k AS b, corr(a.x, b.x) AS r FROM m a JOIN m b USING (vec_id) GROUP BY 1, 2) SELECT count(DISTINCT a) AS n_members, {r('count(DISTINCT a)^2 / sum(coalesce(r, 0)^2)', 4)} AS n_effective FROM p")
def a08_effective_count(spark, d):
    return stats.effective_count(src.table(spark, d, "embeddings"), "embedding").withColumn("n_effective", fixed(F.col("n_effective"), 4))


@query(f"""WITH {EMB}, p AS (SELECT a.k AS a, b.k AS b, covar_samp(a.x, b.x) AS c, count(*) AS n FROM m a JOIN m b USING (vec_id) GROUP BY 1, 2), s AS (SELECT any_value(n) AS n, count(DISTINCT a) AS p, sum(CASE WHEN a = b THEN c END) / count(DISTINCT a) AS mu, sum(c * c) / count(*) AS alpha FROM p)
SELECT n, {r('mu', 9)} AS mu, {r('alpha', 9)} AS alpha, {r('greatest(least((alpha + mu^2) / ((n + 1) * (alpha - mu^2 / p)), 1), 0)', 5)} AS rho FROM s""")
def a10_shrinkage(spark, d):
    s = stats.shrinkage(src.table(spark, d, "embeddings"), "embedding")
    return s.select("n", fixed(F.col("mu"), 9).alias("mu"), fixed(F.col("alpha"), 9).alias("alpha"), fixed(F.col("rho"), 5).alias("rho"))
