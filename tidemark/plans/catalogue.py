"""One query for each operator over the driver's tables, beside the DuckDB SQL that gives the same rows.

Doubles are rounded (fixed) on both sides, since sums are taken in other orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalar as fn
from tidemark.functions.scalar import fixed
from tidemark.operators import align, folds, freshness, precedent, regimes, scores, segments, sliding, stats
from tidemark.operators import windows as w
from tidemark.operators.align import ordered
from tidemark.plans.registry import BARS, LAG, PANEL, SPINE, TARGET, clip_sql, over, query, r, z_sql
from tidemark.sources import tables as src


def weekdays(panel: DataFrame) -> DataFrame:
    span = panel.agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return span.select(F.explode(F.sequence("a", "b")).alias("dt")).where(F.weekday("dt") < 5)


GAPS = f"gaps AS (SELECT series, dt, CASE WHEN day(dt) % 7 > 0 THEN px END AS px FROM panel), filled AS (SELECT series, dt, last_value(px IGNORE NULLS) {over('UNBOUNDED PRECEDING')} AS px FROM gaps)"


@query(f"""WITH {PANEL}, {GAPS}, z AS (SELECT series, dt, {r(z_sql('px', 20))} AS z FROM filled)
SELECT *, CASE WHEN z > 2 THEN 'Extreme Over' WHEN z > 1 THEN 'Overvalued' WHEN z > -1 THEN 'Fair Value' WHEN z > -2 THEN 'Undervalued' ELSE 'Extreme Under' END AS zone FROM z""")
def w04_causal_zscore(spark, d):
    gaps = src.panel_daily(spark, d).withColumn("px", F.when(F.dayofmonth("dt") % 7 > 0, F.col("px")))
    z = align.forward_fill(gaps, "px").select("series", "dt", fixed(w.causal_z(F.col("px"), 20)).alias("z"))
    return z.withColumn("zone", fn.zone(F.col("z")))


@query(f"""
WITH {TARGET}, z AS (SELECT *, {r(z_sql('px', 20))} AS z, lead(px, 5) {LAG} AS ahead FROM target),
f AS (SELECT CASE WHEN z > 2 THEN 'Extreme Over' WHEN z > 1 THEN 'Overvalued' WHEN z > -1 THEN 'Fair Value' WHEN z > -2 THEN 'Undervalued' ELSE 'Extreme Under' END AS zone,
  {clip_sql('(ahead / px - 1) * 100', -100, 100)} AS forward FROM z)
SELECT zone, count(forward) AS n, {r('avg(forward)')} AS mean_forward, {r('avg(CASE WHEN forward IS NOT NULL THEN (forward > 0)::INT END)')} AS up_share FROM f GROUP BY zone""")
def w02_forward_by_zone(spark, d):
    df = src.target_daily(spark, d).select("*", fixed(w.causal_z(F.col("px"), 20)).alias("z"), w.forward_change(F.col("px"), 5).alias("forward"))
    return df.groupBy(fn.zone(F.col("z")).alias("zone")).agg(F.count("forward").alias("n"), fixed(F.avg("forward")).alias("mean_forward"), fixed(F.avg((F.col("forward") > 0).cast("int"))).alias("up_share"))


@query(f"""WITH {PANEL}, {SPINE} SELECT series, {r('count(px) / (SELECT count(*) FROM weekdays)')} AS coverage FROM panel JOIN weekdays USING (dt) GROUP BY series
HAVING count(px) / (SELECT count(*) FROM weekdays) >= 0.2""")
def p02_coverage_filter(spark, d):
    panel = src.panel_daily(spark, d)
    days = weekdays(panel)
    on = panel.join(F.broadcast(days), "dt", "left_semi")
    n = days.agg(F.count("*").alias("n"))
    counted = on.groupBy("series").agg(F.count("px").alias("k")).crossJoin(F.broadcast(n))  # one row
    return counted.where(F.col("k") / F.col("n") >= 0.2).select("series", fixed(F.col("k") / F.col("n")).alias("coverage"))


@query(f"""WITH {PANEL}, {SPINE}, g AS (SELECT s.series, k.dt, p.px FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN weekdays k LEFT JOIN panel p ON p.series = s.series AND p.dt = k.dt)
SELECT series, dt, {r(f"last_value(px IGNORE NULLS) {over('UNBOUNDED PRECEDING')}", 3)} AS px FROM g""")
def j02_reindex_ffill(spark, d):
    panel = src.panel_daily(spark, d)
    return align.reindex_ffill(panel, weekdays(panel)).select("series", "dt", fixed(F.col("px"), 3).alias("px"))


@query(f"""WITH {PANEL}, {SPINE}, g AS (SELECT s.series, k.dt FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN weekdays k)
SELECT g.series, g.dt, {r('p.px', 3)} AS px, coalesce(p.dt = g.dt, false) AS native FROM g ASOF LEFT JOIN panel p ON g.series = p.series AND g.dt >= p.dt""")
def j03_asof_backward(spark, d):
    panel = src.panel_daily(spark, d)
    return align.asof_backward(panel, weekdays(panel)).select("series", "dt", fixed(F.col("px"), 3).alias("px"), "native")


@query(f"""WITH {PANEL}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS place FROM panel WHERE series <> 'x')
SELECT series, count(*) AS n_rows FROM n WHERE place <= 1500 GROUP BY series HAVING count(px) = count(*)""")
def p05_history_guard(spark, d):
    return align.history_guard(src.panel_daily(spark, d))


@query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1""")
def p08_latest_per_key(spark, d):
    orders = src.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    return align.latest(orders, ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderpriority")


@query(f"""WITH {PANEL}, {TARGET} SELECT p.series, {r('corr(ln(p.px), ln(t.px))')} AS r, count(*) AS n, NOT (abs(corr(ln(p.px), ln(t.px))) > 0.98 AND count(*) >= 100) AS kept
FROM panel p JOIN target t USING (dt) WHERE p.px > 0 AND t.px > 0 GROUP BY p.series""")
def p13_replica_screen(spark, d):
    return align.replicas(src.panel_daily(spark, d), src.target_daily(spark, d)).withColumn("r", fixed(F.col("r")))


PRINTS = f"""m AS (SELECT series, dt, round(px, 0) AS px FROM panel), a AS (SELECT *, last_value(CASE WHEN px > 0 THEN px END IGNORE NULLS) {over('UNBOUNDED PRECEDING', '1 PRECEDING')} AS before FROM m),
b AS (SELECT series, dt, px > 0 AND (before IS NULL OR before <> px) AS printed FROM a), c AS (SELECT *, sum(printed::INT) {over('UNBOUNDED PRECEDING')}::BIGINT AS n_prints FROM b)"""


@query(f"""WITH {PANEL}, {PRINTS} SELECT series, dt, printed, n_prints, n_prints >= 250 AS admitted FROM c""")
def p16_print_mask(spark, d):
    return align.admitted(src.panel_daily(spark, d).withColumn("px", F.round("px", 0))).select("series", "dt", "printed", "n_prints", "admitted")


@query(f"""WITH {PANEL}, {PRINTS}, o AS (SELECT *, n_prints >= 100 AS adm, isodow(dt) <= 5 OR right(series, 1) = '1' AS op FROM c), n AS (SELECT dt, count_if(adm) AS n_admitted, count_if(adm AND op) AS n_open, count_if(adm AND op AND printed) AS n_printed FROM o GROUP BY dt),
v AS (SELECT *, CASE WHEN n_open > 0 THEN n_printed / n_open::DOUBLE ELSE 0 END AS share, row_number() OVER (ORDER BY dt) AS k FROM n)
SELECT dt, n_admitted::BIGINT AS n_admitted, n_open::BIGINT AS n_open, n_printed::BIGINT AS n_printed, {r('share')} AS coverage, share >= 0.6 AND n_printed >= 10 AS complete,
CASE WHEN k <= 250 THEN 'burn-in' WHEN n_admitted < 10 THEN 'warming up' WHEN n_open < 0.6 * n_admitted THEN 'market closed' WHEN NOT (share >= 0.6 AND n_printed >= 10) THEN 'incomplete fetch' ELSE 'published' END AS reason FROM v""")
def p20_completeness_gate(spark, d):
    rows = align.admitted(src.panel_daily(spark, d).withColumn("px", F.round("px", 0)), 100)
    rows = rows.withColumn("open", (F.weekday("dt") < 5) | (F.right("series", F.lit(1)) == "1"))
    return align.complete_days(rows, least=10, burn_in=250).withColumn("coverage", fixed(F.col("coverage")))


@query("""WITH t AS (SELECT event_id, strftime(ts, '%d/%m/%Y') AS day, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE format('{:,}', CAST(floor(value * 100) AS BIGINT)) END AS cell FROM events),
p AS (SELECT event_id, CAST(strptime(trim(day), '%d/%m/%Y') AS DATE) AS dt, TRY_CAST(replace(trim(cell), ',', '') AS DOUBLE) AS value FROM t)
SELECT dt, arg_max(value, event_id) AS value FROM p WHERE value IS NOT NULL AND value <> 0 GROUP BY dt""")
def s11_sheet_rows(spark, d):
    events = src.table(spark, d, "events")
    cell = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.format_number(F.floor(F.col("value") * 100), 0))
    text = events.select("event_id", F.date_format("ts", "dd/MM/yyyy").alias("day"), cell.alias("cell"))
    return src.sheet_rows(text, "day", "cell", "event_id")


@query(f"""WITH {PANEL}, {SPINE}, v AS (SELECT 'a' AS source, 1 AS version, series, dt, px FROM panel WHERE extract('year' FROM dt) <= 1998 UNION ALL
SELECT 'b', 2, series, dt, px FROM panel WHERE extract('year' FROM dt) > 1996 AND hash_free(series)),
k AS (SELECT series, source, max(version) AS version, count(px) AS coverage FROM v SEMI JOIN weekdays USING (dt) GROUP BY 1, 2)
SELECT series, arg_max(source, (coverage, version)) AS source, max(coverage) AS coverage FROM k GROUP BY series""".replace("hash_free(series)", "right(series, 1) IN ('1', '2', '3')"))
def s25_best_source(spark, d):
    panel = src.panel_daily(spark, d)
    a = panel.where(F.year("dt") <= 1998).select(F.lit("a").alias("source"), F.lit(1).alias("version"), "series", "dt", "px")
    b = panel.where((F.year("dt") > 1996) & F.right("series", F.lit(1)).isin("1", "2", "3")).select(F.lit("b").alias("source"), F.lit(2).alias("version"), "series", "dt", "px")
    return src.best_source(weekdays(panel), a.unionByName(b))


@query(f"""WITH {PANEL}, n AS (SELECT *, max(dt) OVER (PARTITION BY series) AS newest FROM panel)
SELECT series, count(*) AS n_rows, left(sha256(string_agg(CAST(dt AS VARCHAR) || '=' || CAST(CAST(floor(px * 1000 + 0.501) AS BIGINT) AS VARCHAR), ',' ORDER BY dt)), 12) AS mark FROM n WHERE dt < newest GROUP BY series""")
def s26_fingerprint(spark, d):
    return src.fingerprint(src.panel_daily(spark, d))


@query(f"""WITH {PANEL} SELECT series, dt, {r(clip_sql(f'(lead(px, 5) {LAG} / px - 1) * 100', -100, 100))} AS forward_5, {r(f"CASE WHEN count(px) {over('252 PRECEDING', '1 PRECEDING')} >= 60 THEN avg(px) {over('252 PRECEDING', '1 PRECEDING')} END")} AS anchor,
{r(f"CASE WHEN count(px) {over('19 PRECEDING')} >= 20 THEN avg(px) {over('19 PRECEDING')} END")} AS sma_20, {r(f'px / lag(px, 10) {LAG} - 1')} AS change_10 FROM panel""")
def w05_moving_means(spark, d):
    px = F.col("px")
    return src.panel_daily(spark, d).select("series", "dt", fixed(w.forward_change(px, 5)).alias("forward_5"), fixed(w.anchor_mean(px)).alias("anchor"), fixed(w.sma(px, 20)).alias("sma_20"), fixed(w.percent_change(px, 10)).alias("change_10"))


@query(f"""WITH {PANEL}, t AS (SELECT *, ln(px) - lag(ln(px)) {LAG} AS ret FROM panel)
SELECT series, dt, {r(f"CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN sum(ret) {over('19 PRECEDING')} END")} AS momentum, {r(f"CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN stddev_samp(ret) {over('19 PRECEDING')} END")} AS vol FROM t""")
def w06_realised_vol(spark, d):
    return precedent.states(src.panel_daily(spark, d)).select("series", "dt", fixed(F.col("momentum")).alias("momentum"), fixed(F.col("vol")).alias("vol"))


@query(f"""WITH {PANEL}, {TARGET}, j AS (SELECT p.series, dt, p.px, t.px AS y FROM panel p JOIN target t USING (dt))
SELECT series, dt, {r(f"coalesce({clip_sql(f'''CASE WHEN count(px + y) {over('60 PRECEDING', '1 PRECEDING')} >= 60 THEN corr(y, px) {over('60 PRECEDING', '1 PRECEDING')} END''', -1, 1)}, 0)", 5)} AS r FROM j""")
def w07_rolling_corr(spark, d):
    rows = src.panel_daily(spark, d).join(F.broadcast(src.target_daily(spark, d).select("dt", F.col("px").alias("y"))), "dt")
    return rows.select("series", "dt", fixed(w.rolling_corr(F.col("px"), F.col("y"), 60), 5).alias("r"))


QZ = f"""q AS (SELECT *, quantile_cont(px, [0.025, 0.5, 0.975]) {over('60 PRECEDING', '1 PRECEDING')} AS q, count(px) {over('60 PRECEDING', '1 PRECEDING')} AS n FROM panel),
z AS (SELECT series, dt, {r("CASE WHEN n >= 30 AND (q[3] - q[1]) / 1.35 > 1e-12 THEN (px - q[2]) / ((q[3] - q[1]) / 1.35) END")} AS z FROM q)"""


@query(f"""WITH {PANEL}, {QZ} SELECT series, dt, z, CASE WHEN z IS NULL THEN 'N/A' WHEN z > 2 THEN 'Extreme Over' WHEN z > 1 THEN 'Overvalued' WHEN z > -1 THEN 'Fair Value' WHEN z > -2 THEN 'Undervalued' ELSE 'Extreme Under' END AS zone,
coalesce(z < -1 AND lag(z) {LAG} >= -1, false) AS buy, coalesce(z > 1 AND lag(z) {LAG} <= 1, false) AS sell FROM z""")
def w08_quantile_zones(spark, d):
    z = sliding.quantile_z(src.panel_daily(spark, d), "px", 60, 30).select("series", "dt", fixed(F.col("z")).alias("z"))
    buy, sell = w.crossings(F.col("z"))
    return z.select("series", "dt", "z", fn.zone(F.col("z")).alias("zone"), buy.alias("buy"), sell.alias("sell"))


@query(f"""WITH {TARGET}, a AS (SELECT series, dt, abs({r(z_sql('px', 20))}) AS x FROM target), l AS (SELECT *, list(x) {over('UNBOUNDED PRECEDING', '1 PRECEDING')} AS before FROM a),
s AS (SELECT dt, x, list_sort(before) AS b, len(before) AS n FROM l),
t AS (SELECT dt, x, CASE WHEN n >= 60 AND b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] ELSE 1.5 END AS hi, CASE WHEN n >= 60 AND b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] ELSE 0.7 END AS lo FROM s)
SELECT dt, {r('hi')} AS tier_strong, {r('least(lo, hi)')} AS tier_weak FROM t""")
def w11_expanding_tiers(spark, d):
    rows = src.target_daily(spark, d).select("series", "dt", F.abs(fixed(w.causal_z(F.col("px"), 20))).alias("x"))
    tiers = folds.expanding_quantiles(rows, "x", {"hi": (0.9, 1.5), "lo": (0.5, 0.7)}, 60)
    return tiers.select("dt", fixed(F.col("hi")).alias("tier_strong"), fixed(F.least("lo", "hi")).alias("tier_weak"))


CDF = f"""WITH {TARGET}, l AS (SELECT dt, px, list(px) {over('UNBOUNDED PRECEDING', '1 PRECEDING')} AS b FROM target)
SELECT dt, {r("CASE WHEN len(b) > 0 THEN (0.5 * (len(list_filter(b, lambda v: v < px)) + len(list_filter(b, lambda v: v <= px))) + 0.5) / (len(b) + 1) ELSE 0.5 END")} AS percentile FROM l"""


@query(CDF)
def w15_expanding_cdf(spark, d):
    return folds.expanding_cdf(src.target_daily(spark, d), "px", "percentile").select("dt", fixed(F.col("percentile")).alias("percentile"))


@query(CDF)
def w15_ranks_in_segments(spark, d):
    """w15 by divide and conquer over segments of 256 days."""
    return segments.expanding_cdf(src.target_daily(spark, d), "px", "percentile", 256).select("dt", fixed(F.col("percentile")).alias("percentile"))


@query("""WITH i AS (SELECT l_suppkey AS series, l_orderkey * 8 + l_linenumber AS place, max(l_extendedprice) AS x FROM lineitem GROUP BY 1, 2)
SELECT a.series, a.place, CAST(count(b.x) FILTER (b.x < a.x) AS BIGINT) AS below, CAST(count(b.x) FILTER (b.x = a.x) AS BIGINT) AS same, CAST(count(b.x) AS BIGINT) AS n FROM i a LEFT JOIN i b ON a.series = b.series AND b.place < a.place GROUP BY a.series, a.place""")
def r32_ranks_of_items(spark, d):
    """The place of each item's price among its supplier's earlier ones, whole series of items in segments."""
    rows = src.table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("series"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("place")).agg(F.max("l_extendedprice").alias("x"))
    return segments.ranks(rows, "x", 8192, order="place", buckets=16)


@query(f"""WITH {PANEL} SELECT series, dt, {r(clip_sql(f"(px - avg(px) {over('UNBOUNDED PRECEDING')}) / greatest(coalesce(stddev_samp(px) {over('UNBOUNDED PRECEDING')}, 1), 1e-10) / 3", -1, 1))} AS norm FROM panel""")
def w16_expanding_norm(spark, d):
    return src.panel_daily(spark, d).select("series", "dt", fixed(w.expanding_norm(F.col("px"))).alias("norm"))


TR = f"tr AS (SELECT *, greatest(high - low, coalesce(abs(high - lag(close) {LAG}), 0), coalesce(abs(low - lag(close) {LAG}), 0)) AS tr, row_number() {LAG} AS k FROM bars)"
ATR = "e(series, k, dt, tr, m) AS (SELECT series, k, dt, tr, tr FROM tr WHERE k = 1 UNION ALL SELECT t.series, t.k, t.dt, t.tr, e.m + (t.tr - e.m) / 14 FROM tr t JOIN e ON t.series = e.series AND t.k = e.k + 1)"


ATR_ROWS = f"WITH RECURSIVE {BARS}, {TR}, {ATR} SELECT series, dt, {r('tr')} AS true_range, {r('m')} AS atr FROM e"


@query(ATR_ROWS)
def w17_range_in_segments(spark, d):
    """w17 with the hours of each series in segments."""
    bars = src.bars_hourly(spark, d)
    rows = segments.in_segments(bars.withColumn("tr", w.true_range()), ["tr"], segments.mean_fold(1 / 14), 96 * 3600, keep=("tr",))
    return rows.select("series", "dt", fixed(F.col("tr")).alias("true_range"), fixed(F.col("mean")).alias("atr"))


@query(ATR_ROWS)
def w17_average_true_range(spark, d):
    bars = src.bars_hourly(spark, d)
    rows = folds.ewm(bars.withColumn("tr", w.true_range()), "tr", 1 / 14)
    return rows.select("series", "dt", fixed(F.col("tr")).alias("true_range"), fixed(F.col("mean")).alias("atr"))


@query(f"""WITH {BARS}, f AS (SELECT series, dt, (high + low + close) / 3 * volume AS mf, close - lag(close) {LAG} AS d FROM bars),
m AS (SELECT series, dt, avg(CASE WHEN d > 0 THEN mf ELSE 0 END) {over('13 PRECEDING')} AS up, avg(CASE WHEN d < 0 THEN mf ELSE 0 END) {over('13 PRECEDING')} AS down FROM f)
SELECT series, dt, {r("CASE WHEN up + down <> 0 THEN 2 * (up / (up + down) - 0.5) ELSE 0 END")} AS accumulation FROM m""")
def w20_money_flow(spark, d):
    return src.bars_hourly(spark, d).select("series", "dt", fixed(w.accumulation(14)).alias("accumulation"))


def _pivot_sql() -> str:
    c, n = f"lag(px, 5) {LAG}", f"count(px) {over('10 PRECEDING')} = 11"
    a, b = over("10 PRECEDING", "6 PRECEDING"), over("4 PRECEDING")
    return f"SELECT series, dt, coalesce({n} AND {c} > max(px) {a} AND {c} >= max(px) {b}, false) AS top, coalesce({n} AND {c} < min(px) {a} AND {c} <= min(px) {b}, false) AS bottom FROM panel"


@query(f"WITH {PANEL} {_pivot_sql()}")
def w21_pivots(spark, d):
    return w.pivots(src.panel_daily(spark, d), "px").select("series", "dt", "top", "bottom")


@query(f"""WITH {PANEL}, l AS (SELECT series, dt, ln(px) AS x, lag(ln(px)) {LAG} AS b FROM panel),
f AS (SELECT series, dt, regr_slope(x, b) {over('59 PRECEDING')} AS s, count(b) {over('59 PRECEDING')} AS n FROM l),
p AS (SELECT series, dt, {clip_sql('CASE WHEN n >= 60 THEN s + (1 + 3 * s) / 60 END', 1e-6, 0.9999)} AS phi FROM f)
SELECT series, dt, {r('phi')} AS phi, {r('-ln(phi)', 5)} AS theta FROM p""")
def w26_rolling_theta(spark, d):
    rows = src.panel_daily(spark, d).withColumn("x", F.log("px")).withColumn("_lag", F.lag("x").over(ordered()))
    phi, theta = w.rolling_theta(F.col("x"), 60)
    return rows.select("series", "dt", phi.alias("p"), theta.alias("t")).select("series", "dt", fixed(F.col("p")).alias("phi"), fixed(F.col("t"), 5).alias("theta"))


@query("""WITH e AS (SELECT event_id, event_type AS kind, CAST(ts AS DATE) AS dt FROM events)
SELECT event_id, kind, dt, count(*) OVER (PARTITION BY kind ORDER BY dt RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY kind ORDER BY dt RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW) >= 5 AS persistent FROM e""")
def w28_persistence(spark, d):
    rows = src.table(spark, d, "events").select("event_id", F.col("event_type").alias("kind"), F.to_date("ts").alias("dt"))
    return w.persistence(rows, "kind", days=3)


ZP = f"zp AS (SELECT series, dt, {r(z_sql('px', 60))} AS z FROM panel), bz AS (SELECT dt, asset AS block, z FROM zp JOIN (SELECT p_brand AS series, min(p_type) AS asset FROM part GROUP BY 1) USING (series))"


def _panel_z(spark, d) -> DataFrame:
    z = src.panel_daily(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 60)).alias("z"))
    blocks = src.table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg(F.min("p_type").alias("block"))
    return z.join(F.broadcast(blocks), "series")  # one row a brand


@query(f"WITH {PANEL}, {ZP} SELECT dt, block, {r('avg(z)')} AS mean_z, count(z) AS members FROM bz GROUP BY 1, 2")
def a02_block_means(spark, d):
    return stats.block_means(_panel_z(spark, d)).withColumn("mean_z", fixed(F.col("mean_z")))


@query(f"WITH {PANEL}, {ZP} SELECT dt, count(z) AS n, {r('stddev_pop(z)')} AS dispersion FROM zp GROUP BY dt HAVING count(z) >= 5")
def a20_dispersion(spark, d):
    return stats.dispersion(_panel_z(spark, d)).withColumn("dispersion", fixed(F.col("dispersion")))


@query(f"""WITH {PANEL}, {ZP}, v AS (SELECT zp.series, dt, z, 1 + (ascii(right(series, 1)) - 48) / 10 AS weight FROM zp)
SELECT dt, count(z) AS n_views, {r("100 * sum(CASE WHEN z < -1 THEN weight ELSE 0 END) / sum(weight)")} AS oversold_pct, {r("100 * sum(CASE WHEN z > 1 THEN weight ELSE 0 END) / sum(weight)")} AS overbought_pct, {r("sum(z * weight) / sum(weight)")} AS avg_score FROM v GROUP BY dt""")
def a01_weighted_breadth(spark, d):
    views = _panel_z(spark, d).select("dt", "series", F.col("z").alias("score"), (1 + (F.ascii(F.right("series", F.lit(1))) - 48) / 10).alias("weight"))
    rows = scores.weighted_breadth(views, 1.0)
    return rows.select("dt", "n_views", *[fixed(F.col(c)).alias(c) for c in ("oversold_pct", "overbought_pct", "avg_score")])


@query(f"""WITH {PANEL}, f AS (SELECT series, px, CASE WHEN count(px) {over('19 PRECEDING')} >= 20 THEN avg(px) {over('19 PRECEDING')} END AS fit, CASE WHEN count(px) {over('252 PRECEDING', '1 PRECEDING')} >= 60 THEN avg(px) {over('252 PRECEDING', '1 PRECEDING')} END AS anchor FROM panel)
SELECT series, {r('1 - sum((px - fit)^2) / (var_pop(px) * count(px))')} AS r2, {r('sqrt(avg((px - fit)^2))')} AS rmse, {r('avg(abs(px - fit))')} AS mae, {r('1 - sum(CASE WHEN anchor IS NOT NULL THEN (px - fit)^2 END) / sum((px - anchor)^2)')} AS r2_anchor FROM f WHERE fit IS NOT NULL GROUP BY series""")
def a04_fit_quality(spark, d):
    rows = src.panel_daily(spark, d).withColumn("fit", w.sma(F.col("px"), 20)).withColumn("anchor", w.anchor_mean(F.col("px")))
    out = stats.fit_quality(rows, "px", "fit", "anchor")
    return out.select("series", *[fixed(F.col(c)).alias(c) for c in out.columns[1:]])


@query(f"""WITH {PANEL}, z AS (SELECT series, dt, {r(z_sql('px', 60))} AS z, {clip_sql(f'(lead(px, 5) {LAG} / px - 1) * 100', -100, 100)} AS f, row_number() {LAG} - 1 AS k FROM panel),
s AS (SELECT *, CASE WHEN z < -1 THEN 'buy' WHEN z > 1 THEN 'sell' END AS side FROM z WHERE k % 5 = 0 AND f IS NOT NULL)
SELECT series, side, count(*) AS n, {r("avg(CASE WHEN side = 'buy' THEN (f > 0)::INT ELSE (f < 0)::INT END)")} AS hit_rate, {r('avg(f)')} AS mean_forward, CASE WHEN count(*) < 3 THEN NULL WHEN stddev_samp(f) > 0 THEN {r("avg(f) / (stddev_samp(f) / sqrt(count(*)))")} WHEN avg(f) > 0 THEN 'inf'::DOUBLE WHEN avg(f) < 0 THEN '-inf'::DOUBLE END AS t FROM s WHERE side IS NOT NULL GROUP BY 1, 2""")
def a05_signal_performance(spark, d):
    rows = src.panel_daily(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 60)).alias("z"), w.forward_change(F.col("px"), 5).alias("f"))
    out = stats.signal_performance(rows, "z", "f", 5, 1.0)
    t = F.when(F.abs("t") < float("inf"), fixed(F.col("t"))).otherwise(F.col("t"))
    return out.select("series", "side", "n", *[fixed(F.col(c)).alias(c) for c in ("hit_rate", "mean_forward")], t.alias("t"))


@query(f"""WITH {PANEL}, z AS (SELECT series, {r(z_sql('px', 20))} AS x, {r(f'lead(px, 5) {LAG} / px - 1')} AS y FROM panel), v AS (SELECT * FROM z WHERE y IS NOT NULL),
k AS (SELECT series, rank() OVER (PARTITION BY series ORDER BY x) + (count(*) OVER (PARTITION BY series, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY series ORDER BY y) + (count(*) OVER (PARTITION BY series, y) - 1) / 2 AS ry FROM v)
SELECT series, {r('corr(rx, ry)')} AS ic, count(*) AS n FROM k GROUP BY series HAVING count(*) >= 5""")
def a07_spearman_ic(spark, d):
    px = F.col("px")
    rows = src.panel_daily(spark, d).select("series", fixed(w.causal_z(px, 20)).alias("x"), fixed(F.lead(px, 5).over(ordered()) / px - 1).alias("y"))
    return stats.spearman(rows, "x", "y").withColumn("ic", fixed(F.col("ic")))


@query(f"""WITH e AS (SELECT event_type, value, hour(ts) + 1 AS weight FROM events WHERE value IS NOT NULL), c AS (SELECT *, sum(weight) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(weight) OVER (PARTITION BY event_type) AS total FROM e)
SELECT event_type, min(CASE WHEN upto >= 0.25 * total - 1e-12 THEN value END) AS p25, min(CASE WHEN upto >= 0.5 * total - 1e-12 THEN value END) AS median, min(CASE WHEN upto >= 0.75 * total - 1e-12 THEN value END) AS p75, {r('sum(weight)^2 / sum(weight^2)')} AS n_effective FROM c GROUP BY event_type""")
def a13_weighted_quantiles(spark, d):
    rows = src.table(spark, d, "events").select("event_type", "value", (F.hour("ts") + 1).alias("weight"))
    return stats.weighted_quantiles(rows, "event_type", "value", "weight", {"p25": 0.25, "median": 0.5, "p75": 0.75}).withColumn("n_effective", fixed(F.col("n_effective")))


@query(f"""WITH {PANEL}, l AS (SELECT series, ln(px) AS x, lag(ln(px)) {LAG} AS b FROM panel), f AS (SELECT series, count(*) AS n, regr_slope(x, b) AS s, regr_intercept(x, b) AS i FROM l WHERE b IS NOT NULL GROUP BY series),
p AS (SELECT *, greatest(least(s + (1 + 3 * s) / n, 0.9999), 1e-6) AS phi FROM f) SELECT series, n, {r('phi')} AS phi, {r('-ln(phi)', 5)} AS theta, {r('i / (1 - phi)')} AS mu, {r('ln(2) / -ln(phi)', 4)} AS half_life FROM p""")
def a21_ou_parameters(spark, d):
    out = stats.ou_parameters(src.panel_daily(spark, d).withColumn("x", F.log("px")), "x")
    return out.select("series", "n", fixed(F.col("phi")).alias("phi"), fixed(F.col("theta"), 5).alias("theta"), fixed(F.col("mu")).alias("mu"), fixed(F.col("half_life"), 4).alias("half_life"))


FLUCTUATION = f"""fm AS (SELECT series, dt, ln(px) - avg(ln(px)) OVER (PARTITION BY series) AS d, row_number() {LAG} - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM panel),
fy AS (SELECT *, sum(d) {over('UNBOUNDED PRECEDING')} AS y, list_distinct(list_transform(range(20), lambda k: floor(8 * pow(n / 32.0::DOUBLE, k / 19.0::DOUBLE) + 1e-9)::BIGINT)) AS scales FROM fm WHERE n >= 32), fu AS (SELECT series, i, y, n, unnest(scales) AS s FROM fy),
fb AS (SELECT series, s AS scale, i // s AS box, regr_syy(y, i) - regr_sxy(y, i)^2 / regr_sxx(y, i) AS e FROM fu WHERE i // s < n // s GROUP BY 1, 2, 3),
ff AS (SELECT series, scale, ln(sum(greatest(e, 0)) / (count(*) * scale)) / 2 AS f FROM fb GROUP BY 1, 2), hurst AS (SELECT series, count(*) AS n_scales, greatest(least(regr_slope(f, ln(scale)), 0.99), 0.01) AS h FROM ff GROUP BY series)"""


@query(f"WITH {PANEL}, {FLUCTUATION} SELECT series, n_scales, {r('h', 5)} AS hurst FROM hurst")
def a24_fluctuation(spark, d):
    return stats.dfa(src.panel_daily(spark, d).withColumn("x", F.log("px")), "x").withColumn("hurst", fixed(F.col("hurst"), 5))


@query(f"""WITH {PANEL}, {FLUCTUATION}, l AS (SELECT series, ln(px) AS x, lag(ln(px)) {LAG} AS b FROM panel), k AS (SELECT series, x - b AS dx, b FROM l WHERE b IS NOT NULL),
u AS (SELECT series, count(*) AS n, regr_slope(dx, b) / sqrt((regr_syy(dx, b) - regr_slope(dx, b) * regr_sxy(dx, b)) / (count(*) - 2) / regr_sxx(dx, b)) AS t FROM k GROUP BY series) SELECT u.series, {r('CASE WHEN n > 200 AND t < -2.86 THEN coalesce(h, 0.5) ELSE 0.5 END', 5)} AS hurst FROM u LEFT JOIN hurst USING (series)""")
def d21_gated_hurst(spark, d):
    px = src.panel_daily(spark, d).withColumn("x", F.log("px"))
    return stats.gated_hurst(stats.dfa(px, "x"), stats.unit_root(px, "x")).withColumn("hurst", fixed(F.col("hurst"), 5))


DDM = f"""zp AS (SELECT series, dt, 20 * {r(z_sql('px', 60))} AS x, row_number() {LAG} AS k FROM panel),
e(series, k, dt, x, level, variance) AS (SELECT series, k, dt, x, x, 100.0::DOUBLE FROM zp WHERE k = 1 UNION ALL SELECT z.series, z.k, z.dt, z.x, e.level * 0.97 + 0.056 * z.x, greatest(e.variance * 0.97 + 3 + least(abs(0.056 * z.x) / 2, 50), 1e-6) FROM zp z JOIN e ON z.series = e.series AND z.k = e.k + 1)"""


DRIFT = f"WITH RECURSIVE {PANEL}, {DDM} SELECT series, dt, {r('level')} AS level, {r('variance')} AS variance, {r('100 * tanh(level / 100)')} AS bounded FROM e"


@query(DRIFT)
def r19_drift_in_segments(spark, d):
    """r19 with the days of each series in segments."""
    x = src.panel_daily(spark, d).select("series", "dt", (20 * fixed(w.causal_z(F.col("px"), 60))).alias("x"))
    out = segments.in_segments(x, ["x"], segments.drift_fold(), 512)
    return out.select("series", "dt", fixed(F.col("level")).alias("level"), fixed(F.col("variance")).alias("variance"), fixed(fn.soft_bound(F.col("level"))).alias("bounded"))


@query(DRIFT)
def r19_drift_filter(spark, d):
    x = src.panel_daily(spark, d).select("series", "dt", (20 * fixed(w.causal_z(F.col("px"), 60))).alias("x"))
    return folds.drift_filter(x, "x").select("series", "dt", fixed(F.col("level")).alias("level"), fixed(F.col("variance")).alias("variance"), fixed(fn.soft_bound(F.col("level"))).alias("bounded"))


@query(f"""WITH RECURSIVE {PANEL}, {TARGET}, zp AS (SELECT series, dt, {r(z_sql('px', 20))} AS z FROM panel), o AS (SELECT dt, {r(f'px / lag(px, 5) {LAG} - 1')} AS y FROM target),
c AS (SELECT s.series, o.dt, y, -lag(z, 5) OVER (PARTITION BY s.series ORDER BY o.dt) AS call, row_number() OVER (PARTITION BY s.series ORDER BY o.dt) AS k FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN o LEFT JOIN zp ON zp.series = s.series AND zp.dt = o.dt),
g AS (SELECT *, CASE WHEN y IS NOT NULL AND y <> 0 THEN coalesce(sign(call) * sign(y), 0) END AS a FROM c),
e(series, k, dt, m, w, q) AS (SELECT series, 0::BIGINT, NULL::DATE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM g WHERE k = 1 UNION ALL
 SELECT g.series, g.k, g.dt, CASE WHEN a IS NULL THEN m ELSE (0.5^(1/252.0) * w * m + a) / (0.5^(1/252.0) * w + 1) END, CASE WHEN a IS NULL THEN w ELSE 0.5^(1/252.0) * w + 1 END, CASE WHEN a IS NULL THEN q ELSE 0.5^(2/252.0) * q + 1 END FROM g JOIN e ON g.series = e.series AND g.k = e.k + 1),
s AS (SELECT series, dt, 0.5 * sqrt(CASE WHEN q > 0 THEN w * w / q ELSE 0 END) * m AS e FROM e WHERE k > 0), x AS (SELECT dt, series, exp(e) AS x FROM s)
SELECT dt, series, {r("(1 - least(0.02 * count(*) OVER (PARTITION BY dt), 1)) * x / sum(x) OVER (PARTITION BY dt) + least(0.02 * count(*) OVER (PARTITION BY dt), 1) / count(*) OVER (PARTITION BY dt)")} AS weight FROM x""")
def r27_skill_weights(spark, d):
    z = src.panel_daily(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 20)).alias("z"))
    outcome = src.target_daily(spark, d).select("dt", fixed(w.percent_change(F.col("px"), 5)).alias("outcome"), "series").drop("series")
    rounds = align.spine_of(z, outcome).join(z, ["series", "dt"], "left").withColumn("call", -F.lag("z", 5).over(ordered()))
    return folds.skill_weights(folds.discounted_skill(rounds, "call", "outcome")).withColumn("weight", fixed(F.col("weight")))


def deviation_sql(n: int) -> str:
    """CTEs from panel and target to sig (dt, px, fitted, quality, signal)."""
    before = lambda x: f"{x} {over(f'{n} PRECEDING', '1 PRECEDING')}"
    return f"""j AS (SELECT p.series, dt, p.px, t.px AS y FROM panel p JOIN target t USING (dt)),
s AS (SELECT *, coalesce({clip_sql(f"CASE WHEN {before('count(px)')} >= {n} THEN {before('corr(px, y)')} END", -1, 1)}, 0) AS r, {before('avg(px)')} AS mx, {before('avg(y)')} AS my, {before('stddev_samp(px)')} AS sx, {before('stddev_samp(y)')} AS sy FROM j),
p AS (SELECT dt, series, y, my, round(r^2, 9) AS r2, my + CASE WHEN sx > 1e-12 THEN r * sy / sx ELSE 0 END * (px - mx) AS pred FROM s), dk AS (SELECT *, row_number() OVER (PARTITION BY dt ORDER BY r2 DESC, series) AS place FROM p WHERE pred IS NOT NULL),
dg AS (SELECT dt, first(y) AS px, CASE WHEN sum(r2) > 0 THEN sum(r2 * pred) / sum(r2) ELSE avg(my) END AS fitted, coalesce(sqrt(sum(r2^2) / nullif(sum(r2), 0)), 0) AS quality FROM dk WHERE place <= 4 GROUP BY dt),
dh AS (SELECT 'target' AS series, *, px - fitted AS gap FROM dg), sig AS (SELECT dt, px, fitted, quality, 2 / (1 + exp(-({z_sql('gap', n)}) / 1.5)) - 1 AS signal FROM dh)"""


@query(f"WITH {PANEL}, {TARGET}, {deviation_sql(60)} SELECT dt, {r('fitted', 3)} AS fitted, {r('quality', 5)} AS quality, {r('signal', 5)} AS signal FROM sig")
def d02_macro_deviation(spark, d):
    out = scores.macro_deviation(src.panel_daily(spark, d), src.target_daily(spark, d))
    return out.select("dt", fixed(F.col("fitted"), 3).alias("fitted"), fixed(F.col("quality"), 5).alias("quality"), fixed(F.col("signal"), 5).alias("signal"))


def _daily(spark, d) -> DataFrame:
    """Valuation (of the target) left-joined with breadth (of the panel), gaps filled by neutral values."""
    z = F.col("z")
    v = src.target_daily(spark, d).select("dt", fixed(w.causal_z(F.col("px"), 60)).alias("z"))
    v = v.select("dt", (33 * z).alias("conviction"), fixed(50 - 25 * z, 3).alias("v_oversold"), F.when(z < -1, "OVERSOLD").when(z > 1, "OVERBOUGHT").otherwise("NEUTRAL").alias("regime"))
    b = a01_weighted_breadth(spark, d).select("dt", F.col("oversold_pct").alias("oversold"), F.col("overbought_pct").alias("overbought"), (5 * F.col("avg_score")).alias("avg_score"), F.col("oversold_pct").alias("bull"), F.col("overbought_pct").alias("bear"))
    fill = {"oversold": 50.0, "overbought": 50.0, "avg_score": 0.0, "bull": 33.0, "bear": 33.0}
    return v.join(b, "dt", "left").na.fill(fill)


DAILY = f"""vz AS (SELECT dt, {r(z_sql('px', 60))} AS z FROM target), vw AS (SELECT zp.series, dt, z, 1 + (ascii(right(series, 1)) - 48) / 10 AS weight FROM zp),
br AS (SELECT dt, {r("100 * sum(CASE WHEN z < -1 THEN weight ELSE 0 END) / sum(weight)")} AS lo, {r("100 * sum(CASE WHEN z > 1 THEN weight ELSE 0 END) / sum(weight)")} AS hi, {r("sum(z * weight) / sum(weight)")} AS av FROM vw GROUP BY dt),
da AS (SELECT dt, 33 * z AS c, {r('50 - 25 * z', 3)} AS vo, CASE WHEN z < -1 THEN 'OVERSOLD' WHEN z > 1 THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS g, coalesce(lo, 50) AS lo, coalesce(hi, 50) AS hi, coalesce(5 * av, 0) AS av, coalesce(lo, 33) AS bull, coalesce(hi, 33) AS bear FROM vz LEFT JOIN br USING (dt))"""


@query(f"""WITH {PANEL}, {TARGET}, {ZP}, {DAILY},
m AS (SELECT dt, c, lo, hi, CASE WHEN sign(-c) * sign(lo - hi) > 0 THEN 1 WHEN sign(-c) * sign(lo - hi) < 0 THEN 0 ELSE 0.5 END::DOUBLE AS d1, greatest(least(1 - abs(vo - lo) / 100, 1), 0) AS d2, greatest(least(1 - abs(least(abs(c) / 100, 1) - least(abs(av) / 10, 1)), 1), 0) AS d3,
 CASE WHEN (g = 'OVERSOLD' AND bull > bear) OR (g = 'OVERBOUGHT' AND bear > bull) THEN 1 WHEN g = 'NEUTRAL' AND abs(bull - bear) < 20 THEN 0.8 ELSE 0.2 END::DOUBLE AS d4 FROM da),
s AS (SELECT dt, d1, d2, d3, d4, {r('0.5 * d1 + 0.2 * d2 + 0.2 * d3 + 0.1 * d4', 3)} AS agreement, {r("-0.5 * (greatest(least(-c / 100, 1), -1) + greatest(least((lo - hi) / 100, 1), -1)) * (0.5 * (2 * d1 - 1) + 0.2 * (2 * d2 - 1) + 0.2 * (2 * d3 - 1) + 0.1 * (2 * d4 - 1) + 1) / 2 * 100", 2)} AS score FROM m)
SELECT dt, d1 AS dim_direction, {r('d2', 4)} AS dim_breadth, {r('d3', 4)} AS dim_magnitude, d4 AS dim_regime FROM s""")
def d11_convergence_dimensions(spark, d):
    out = scores.convergence(_daily(spark, d))
    return out.select("dt", "dim_direction", fixed(F.col("dim_breadth"), 4).alias("dim_breadth"), fixed(F.col("dim_magnitude"), 4).alias("dim_magnitude"), "dim_regime")


@query(f"""WITH {PANEL}, {TARGET}, {ZP}, {DAILY}, s AS (SELECT *, CASE WHEN c < -60 AND vo > 70 THEN 'EXTREME_BULLISH' WHEN c < -20 AND vo > 60 THEN 'BULLISH' WHEN c > 60 AND vo < 30 THEN 'EXTREME_BEARISH' WHEN c > 20 AND vo < 40 THEN 'BEARISH' ELSE 'NEUTRAL' END AS a,
 CASE WHEN lo > 60 AND av < -3 THEN 'BULLISH' WHEN hi > 60 AND av > 3 THEN 'BEARISH' ELSE 'NEUTRAL' END AS b FROM da),
k AS (SELECT *, CASE WHEN (a = 'EXTREME_BULLISH' AND b <> 'BULLISH') OR (a = 'EXTREME_BEARISH' AND b <> 'BEARISH') THEN 'VALUATION_LEADS' WHEN (b = 'BULLISH' AND a NOT LIKE '%BULLISH%') OR (b = 'BEARISH' AND a NOT LIKE '%BEARISH%') THEN 'BREADTH_LEADS' END AS kind FROM s)
SELECT dt, a AS valuation_stance, b AS breadth_stance, kind, {r("CASE WHEN kind = 'VALUATION_LEADS' THEN least(abs(c) / 100, 1) WHEN kind = 'BREADTH_LEADS' THEN least(abs(av) / 10, 1) END", 4)} AS severity FROM k""")
def d14_divergence(spark, d):
    return scores.divergence(_daily(spark, d)).select("dt", "valuation_stance", "breadth_stance", "kind", fixed(F.col("severity"), 4).alias("severity"))


@query(f"""WITH {TARGET}, t AS (SELECT *, ln(px) - lag(ln(px)) {LAG} AS ret, row_number() {LAG} AS place FROM target),
f AS (SELECT series, dt, place, CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN sum(ret) {over('19 PRECEDING')} END AS x, CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN stddev_samp(ret) {over('19 PRECEDING')} END AS y FROM t),
n AS (SELECT max(place) AS n, arg_max(x, place) AS nx, arg_max(y, place) AS ny FROM f), p AS (SELECT * FROM f, n WHERE x IS NOT NULL AND y IS NOT NULL AND place <= n - 20),
s AS (SELECT count(*) AS m, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p), h AS (SELECT *, (a + d) / 2 AS mu, (a^2 + d^2 + 2 * b^2) / 4 AS al FROM s),
w AS (SELECT *, greatest(least((al + mu^2) / ((m + 1) * (al - mu^2 / 2)), 1), 0) AS rho FROM h), c AS (SELECT (1 - rho) * a + rho * mu AS a, (1 - rho) * b AS b, (1 - rho) * d + rho * mu AS d FROM w)
SELECT p.dt, p.place, {r('sqrt((c.d * (x - nx)^2 - 2 * c.b * (x - nx) * (y - ny) + c.a * (y - ny)^2) / (c.a * c.d - c.b^2))', 4)} AS distance FROM p, c""")
def d17_state_distances(spark, d):
    out = precedent.distances(precedent.states(src.target_daily(spark, d)))
    return out.select("dt", F.col("place").cast("long").alias("place"), fixed(F.col("distance"), 4).alias("distance"))


@query("""SELECT event_type AS series, date_trunc('hour', ts) AS dt, first(value ORDER BY ts, event_id) AS open, max(value) AS high, min(value) AS low, last(value ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume FROM events GROUP BY 1, 2""")
def st_hourly_bars(spark, d):
    return src.bars_hourly(spark, d)


@query()
def r20_regimes(spark, d):
    rows = regimes.regime_rows(_panel_z(spark, d).select("series", "dt", "z"), "z")
    return rows.select("series", "dt", *[fixed(F.col(c)).alias(c) for c in ("level", "variance", "bull", "bear", "confidence")], "volatility", "change", "regime")


@query("""WITH t AS (SELECT CAST(o_orderdate AS DATE) AS dt, avg(o_totalprice) AS px FROM orders GROUP BY 1) SELECT 'target' AS series, dt FROM t WHERE isodow(dt) <= 5""")
def p14_session_spine(spark, d):
    target = src.target_daily(spark, d)
    return freshness.in_sessions(target.select(F.lit("target").alias("series"), "dt"), weekdays(target)).select("series", "dt")


@query(f"""WITH {PANEL} SELECT series, dt FROM panel WHERE dt >= (SELECT max(dt) - INTERVAL 6 MONTH FROM panel)""")
def p23_recent_months(spark, d):
    return freshness.recent_months(src.panel_daily(spark, d).select("series", "dt"), 6)


@query("""SELECT o_orderkey, o_orderpriority FROM orders WHERE CAST(o_orderdate AS DATE) >= (SELECT max(CAST(o_orderdate AS DATE)) - 400 FROM orders) AND contains(lower(o_orderpriority), 'urgent')""")
def p24_table_filter(spark, d):
    rows = src.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return freshness.matching(rows, "o_orderdate", 400, "Urgent").select("o_orderkey", "o_orderpriority")


FILLED = f"""g AS (SELECT s.series, k.dt, p.px FROM (SELECT DISTINCT series FROM panel) s CROSS JOIN weekdays k LEFT JOIN panel p ON p.series = s.series AND p.dt = k.dt),
f AS (SELECT series, dt, last_value(px IGNORE NULLS) {over('UNBOUNDED PRECEDING')} AS px FROM g)"""


def _filled(spark, d) -> DataFrame:
    panel = src.panel_daily(spark, d)
    return align.reindex_ffill(panel, weekdays(panel))


@query(f"""WITH {PANEL}, {SPINE}, {FILLED}, {PRINTS.replace('FROM panel', 'FROM f')} SELECT series, dt FROM c WHERE n_prints >= 20 AND NOT printed AND dt = (SELECT max(dt) FROM c)""")
def p22_absent(spark, d):
    return freshness.absent(align.admitted(_filled(spark, d).withColumn("px", F.round("px", 0)), 20))


@query(f"""WITH {PANEL}, {SPINE}, {FILLED}, t AS (SELECT series, dt, px, lag(px) {LAG} AS before, lag(px, 2) {LAG} AS older, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS k FROM f)
SELECT count(*) AS n_judged, {r('CASE WHEN count(*) >= 3 THEN avg((px <> before)::INT) END')} AS share FROM t WHERE k = 1 AND px IS NOT NULL AND before IS NOT NULL""")
def p26_fresh_share(spark, d):
    return freshness.fresh_share(_filled(spark, d)).withColumn("share", fixed(F.col("share")))


@query(f"""WITH {PANEL}, {SPINE}, {FILLED}, t AS (SELECT *, lag(px) {LAG} AS before FROM f), u AS (SELECT series, max(dt) FILTER (px IS DISTINCT FROM before) AS updated, max(dt) AS newest FROM t GROUP BY series)
SELECT *, coalesce(updated < newest, true) AS stale FROM u""")
def p27_stale_tail(spark, d):
    return freshness.stale_since(_filled(spark, d))


@query(f"""WITH {PANEL}, v AS (SELECT series, dt, series < 'Brand#3' AND px > 1000 AS valid FROM panel), s AS (SELECT *, bool_or(coalesce(valid, false)) OVER (PARTITION BY series) AS kept FROM v)
SELECT series, dt, valid FROM s WHERE valid OR NOT kept""")
def p28_valid_rows(spark, d):
    rows = src.panel_daily(spark, d).select("series", "dt", ((F.col("series") < "Brand#3") & (F.col("px") > 1000)).alias("valid"))
    return freshness.valid_rows(rows, "valid")


@query("""WITH c AS (SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
p AS (SELECT DISTINCT n, (i * n) // 4 AS k FROM (SELECT DISTINCT n FROM c), range(4) t(i))
SELECT c_nationkey, c_custkey FROM c WHERE n <= 4 OR EXISTS (SELECT 1 FROM p WHERE p.n = c.n AND p.k = c.k)""")
def p29_strided(spark, d):
    return freshness.strided(src.table(spark, d, "customer").select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 4)


@query(f"""WITH {PANEL}, v AS (SELECT series, dt, CASE WHEN day(dt) % 3 > 0 THEN px END AS x FROM panel) SELECT series, max(dt) AS dt, {r('arg_max(x, dt)')} AS x FROM v WHERE x IS NOT NULL GROUP BY series""")
def p30_last_settled(spark, d):
    rows = src.panel_daily(spark, d).select("series", "dt", F.when(F.dayofmonth("dt") % 3 > 0, F.col("px")).alias("x"))
    return freshness.last_settled(rows, "x").withColumn("x", fixed(F.col("x")))


def _pivot_divergence_sql() -> str:
    mean = f"ln(px) - avg(ln(px)) {over('60 PRECEDING')}"
    before = over("UNBOUNDED PRECEDING", "1 PRECEDING")
    return f"""WITH {PANEL}, u AS (SELECT *, {mean} AS e FROM panel), v AS ({_pivot_sql().replace('SELECT series, dt,', 'SELECT *,').replace('FROM panel', 'FROM u')}),
y AS (SELECT *, CASE WHEN count(e) {over('UNBOUNDED PRECEDING')} >= 20 THEN stddev_samp(e) {over('UNBOUNDED PRECEDING')} ELSE 0 END AS s FROM v),
z AS (SELECT *, count(e) {over('10 PRECEDING')} = 11 AS ok, lag(px, 5) {LAG} AS p5, lag(e, 5) {LAG} AS e5, lag(s, 5) {LAG} AS s5 FROM y),
b AS (SELECT *, last_value(CASE WHEN ok AND bottom THEN p5 END IGNORE NULLS) {before} AS lp, last_value(CASE WHEN ok AND bottom THEN e5 END IGNORE NULLS) {before} AS le,
last_value(CASE WHEN ok AND top THEN p5 END IGNORE NULLS) {before} AS hp, last_value(CASE WHEN ok AND top THEN e5 END IGNORE NULLS) {before} AS he FROM z)
SELECT series, dt, coalesce(ok AND bottom AND p5 < lp AND e5 > le AND e5 < -0.5 * s5, false) AS bullish, coalesce(ok AND top AND p5 > hp AND e5 < he AND e5 > 0.5 * s5, false) AS bearish FROM b"""


@query(_pivot_divergence_sql())
def w22_pivot_divergence(spark, d):
    mean = F.avg(F.log("px")).over(ordered().rowsBetween(-60, 0))
    rows = w.pivots(src.panel_daily(spark, d).withColumn("e", F.log("px") - mean), "px").select("series", "dt", "px", "e", "top", "bottom")
    return freshness.pivot_divergence(rows, "e").select("series", "dt", "bullish", "bearish")


def _breaks_sql() -> str:
    steps, gone = "", ""
    for k in (1, 2, 3):
        steps += f", k{k} AS (SELECT m.series, arg_max(t, (move, -t)) AS t, any_value(w) AS w FROM m {gone} WHERE move > 0 {''.join(f' AND (k{i}.t IS NULL OR m.t < k{i}.t - m.w OR m.t >= k{i}.t + m.w)' for i in range(1, k))} GROUP BY m.series)".replace("arg_max(t,", "arg_max(m.t,").replace("-t))", "-m.t))").replace("any_value(w)", "any_value(m.w)")
        gone += f" LEFT JOIN k{k} ON k{k}.series = m.series"
    return f"""WITH {PANEL}, s AS (SELECT series, px, row_number() {LAG} - 1 AS t, count(*) OVER (PARTITION BY series) AS n FROM panel),
q AS (SELECT *, floor(n * 0.15::DOUBLE)::INT AS edge, greatest(floor(n * 0.15::DOUBLE)::INT, 5) AS w FROM s),
h AS (SELECT series, abs(sum(px)) AS head FROM q WHERE t < w GROUP BY series),
m AS (SELECT a.series, a.t - 1 AS t, a.w, CASE WHEN a.t - 1 < a.edge OR a.t - 1 >= a.n - 1 - a.edge THEN 0 WHEN a.t >= a.w THEN abs(a.px - b.px) / a.w WHEN a.t = a.w - 1 THEN head / a.w ELSE 0 END AS move
FROM q a JOIN h USING (series) LEFT JOIN q b ON b.series = a.series AND b.t = a.t - a.w WHERE a.t >= 1 AND a.n >= 3) {steps}
SELECT series, (t + 1)::INT AS place FROM (SELECT series, t FROM k1 UNION ALL SELECT series, t FROM k2 UNION ALL SELECT series, t FROM k3)"""


@query(_breaks_sql())
def w23_mean_breaks(spark, d):
    return freshness.mean_breaks(src.panel_daily(spark, d))


@query(f"""WITH {PANEL}, z AS (SELECT series, dt, px, {r(z_sql('px', 20))} AS z FROM panel), l AS (SELECT *, lag(z) {LAG} AS b, lag(px) {LAG} AS p FROM z)
SELECT series, dt, CASE WHEN z < -0.5 THEN 'Oversold' WHEN z > 0.5 THEN 'Overbought' ELSE 'Neutral' END AS condition, coalesce(z > b AND px < p AND z < -0.5, false) AS bullish, coalesce(z < b AND px > p AND z > 0.5, false) AS bearish FROM l""")
def w25_condition_divergence(spark, d):
    rows = src.panel_daily(spark, d).withColumn("z", fixed(w.causal_z(F.col("px"), 20)))
    bullish, bearish = freshness.divergence(F.col("z"), F.col("px"), -0.5, 0.5)
    return rows.select("series", "dt", freshness.condition(F.col("z"), -0.5, 0.5).alias("condition"), bullish.alias("bullish"), bearish.alias("bearish"))
