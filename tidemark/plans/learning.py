"""Queries of precedent, learned weights, conviction and the verdict, beside their SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalar as fn
from tidemark.functions.scalar import fixed
from tidemark.operators import freshness, learning, precedent, relations, scores, sliding, stats
from tidemark.operators import windows as w
from tidemark.plans.catalogue import DAILY, ZP, _daily, weekdays
from tidemark.plans.registry import LAG, PANEL, SPINE, TARGET, clip_sql, over, query, r, z_sql
from tidemark.sources import tables as src

#: The distances of the target's states, then those taken in turn 20 rows from one another, with kernel weights.
NEAR = f"""t AS (SELECT *, ln(px) - lag(ln(px)) {LAG} AS ret, row_number() {LAG} AS place FROM target),
f AS (SELECT series, dt, place, CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN sum(ret) {over('19 PRECEDING')} END AS x, CASE WHEN count(ret) {over('19 PRECEDING')} >= 20 THEN stddev_samp(ret) {over('19 PRECEDING')} END AS y FROM t),
n AS (SELECT max(place) AS n, arg_max(x, place) AS nx, arg_max(y, place) AS ny FROM f), p AS (SELECT * FROM f, n WHERE x IS NOT NULL AND y IS NOT NULL AND place <= n - 20),
s AS (SELECT count(*) AS m, var_samp(x) AS a, var_samp(y) AS d, covar_samp(x, y) AS b FROM p), h AS (SELECT *, (a + d) / 2 AS mu, (a^2 + d^2 + 2 * b^2) / 4 AS al FROM s),
w AS (SELECT *, greatest(least((al + mu^2) / ((m + 1) * (al - mu^2 / 2)), 1), 0) AS rho FROM h), c AS (SELECT (1 - rho) * a + rho * mu AS a, (1 - rho) * b AS b, (1 - rho) * d + rho * mu AS d FROM w),
ds AS (SELECT p.dt, p.place, sqrt((c.d * (x - nx)^2 - 2 * c.b * (x - nx) * (y - ny) + c.a * (y - ny)^2) / (c.a * c.d - c.b^2)) AS distance FROM p, c), ranked AS (SELECT *, row_number() OVER (ORDER BY distance, place) AS k FROM ds),
g(k, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL SELECT g.k + 1, CASE WHEN len(taken) < 40 AND len(list_filter(taken, lambda v: abs(v - r.place) < 20)) = 0 THEN list_append(taken, r.place) ELSE taken END FROM g JOIN ranked r ON r.k = g.k + 1),
tk AS (SELECT unnest(taken) AS place FROM (SELECT arg_max(taken, k) AS taken FROM g)), sim AS (SELECT dt, place, distance, exp(-0.5 * (distance / (0.5 * (SELECT median(distance) FROM ds)))^2) AS weight, (SELECT min(distance)^2 > 13.816 FROM ds) AS unprecedented FROM ds JOIN tk USING (place))"""


@query(f"WITH RECURSIVE {TARGET}, {NEAR} SELECT dt, place::INT AS place, {r('distance', 5)} AS distance, {r('weight', 5)} AS weight, unprecedented FROM sim")
def d17_similar_periods(spark, d):
    out = precedent.similar_periods(precedent.states(src.target_daily(spark, d)))
    return out.select("dt", "place", fixed(F.col("distance"), 5).alias("distance"), fixed(F.col("weight"), 5).alias("weight"), "unprecedented")


@query()
def d17_six_features(spark, d):
    """Periods like the newest by six features, four of them known only where the breadth of the date is."""
    states = precedent.states(src.target_daily(spark, d))
    daily = scores.convergence(_daily(spark, d)).withColumn("valid", F.dayofmonth("dt") > 2)
    context = precedent.with_context(states, daily, ["conviction", "oversold", "agreement", "avg_score"], "valid")
    return precedent.similar_periods(context, features=(*precedent.FEATURES, "conviction", "oversold", "agreement", "avg_score"))


RATES = f"""ah AS (SELECT place, unnest([5, 10, 20]) AS horizon, unnest([{', '.join(clip_sql(f'(lead(px, {h}) OVER (ORDER BY dt) / px - 1) * 100', -100, 100) for h in (5, 10, 20))}]) AS forward FROM t),
ar AS (SELECT horizon, forward, weight FROM ah JOIN sim USING (place) WHERE forward IS NOT NULL), ac AS (SELECT *, sum(weight) OVER (PARTITION BY horizon ORDER BY forward) AS upto, sum(weight) OVER (PARTITION BY horizon) AS total FROM ar),
rates AS (SELECT horizon::INT AS horizon, {', '.join(f"{r(f'min(CASE WHEN upto >= {q} * total - 1e-12 THEN forward END)', 5)} AS {c}" for c, q in (('p25', 0.25), ('median', 0.5), ('p75', 0.75)))}, {r('sum(weight)^2 / sum(weight^2)', 5)} AS n_effective, count(*) AS n,
 {r('sum(CASE WHEN forward > 0 THEN weight ELSE 0 END) / sum(weight)', 5)} AS up_share, sum(weight)^2 / sum(weight^2) >= 4 AND NOT (SELECT bool_or(unprecedented) FROM sim) AS usable FROM ac GROUP BY horizon)"""


def _rates(spark, d):
    states = precedent.states(src.target_daily(spark, d))
    out = precedent.base_rates(precedent.similar_periods(states), states)
    return out.select("horizon", *[fixed(F.col(c), 5).alias(c) for c in ("p25", "median", "p75", "n_effective")], "n", fixed(F.col("up_share"), 5).alias("up_share"), "usable")


@query(f"WITH RECURSIVE {TARGET}, {NEAR}, {RATES} SELECT * FROM rates")
def a15_base_rates(spark, d):
    return _rates(spark, d)


@query(f"WITH RECURSIVE {TARGET}, {NEAR}, {RATES} SELECT * FROM rates WHERE horizon = 10")
def d25_rates_at_horizon(spark, d):
    """The read at 15 rows, for which the rates of 10 stand in."""
    return precedent.at_horizon(_rates(spark, d), 15)


@query()
def d18_foretold(spark, d):
    return precedent.foretold(precedent.states(src.target_daily(spark, d)), 20)


@query()
def a16_precedent_skill(spark, d):
    from functools import reduce

    states = precedent.states(src.target_daily(spark, d))
    return reduce(lambda a, b: a.unionByName(b), [precedent.skill(precedent.foretold(states, h)).withColumn("horizon", F.lit(h)) for h in (5, 10, 20)])


@query()
def t08_best_horizon(spark, d):
    return relations.best_horizon(a16_precedent_skill(spark, d).where("edge IS NOT NULL"))


DIMS = """m AS (SELECT dt, c, lo, hi, CASE WHEN sign(-c) * sign(lo - hi) > 0 THEN 1 WHEN sign(-c) * sign(lo - hi) < 0 THEN 0 ELSE 0.5 END::DOUBLE AS d1, greatest(least(1 - abs(vo - lo) / 100, 1), 0) AS d2, greatest(least(1 - abs(least(abs(c) / 100, 1) - least(abs(av) / 10, 1)), 1), 0) AS d3,
 CASE WHEN (g = 'OVERSOLD' AND bull > bear) OR (g = 'OVERBOUGHT' AND bear > bull) THEN 1 WHEN g = 'NEUTRAL' AND abs(bull - bear) < 20 THEN 0.8 ELSE 0.2 END::DOUBLE AS d4, 0.5 * (greatest(least(-c / 100, 1), -1) + greatest(least((lo - hi) / 100, 1), -1)) AS lean FROM da),
cs AS (SELECT dt, d1, d2, d3, d4, lean, 0.5 * d1 + 0.2 * d2 + 0.2 * d3 + 0.1 * d4 AS agreement, -lean * (0.5 * (2 * d1 - 1) + 0.2 * (2 * d2 - 1) + 0.2 * (2 * d3 - 1) + 0.1 * (2 * d4 - 1) + 1) / 2 * 100 AS score FROM m)"""


def _convergence(spark, d):
    return scores.convergence(_daily(spark, d))


@query(f"""WITH {PANEL}, {TARGET}, {ZP}, {DAILY}, {DIMS}, f AS (SELECT dt, {r('agreement', 4)} AS agreement, {r('score', 3)} AS score FROM cs)
SELECT *, CASE WHEN score <= -15.61 THEN 'STRONG BULL' WHEN score >= 15.61 THEN 'STRONG BEAR' WHEN score <= -9.18 THEN 'MODERATE BULL' WHEN score >= 9.18 THEN 'MODERATE BEAR' WHEN score <= -4.46 THEN 'WEAK BULL' WHEN score >= 4.46 THEN 'WEAK BEAR' ELSE 'NEUTRAL' END AS zone,
 CASE WHEN score <= -15.9 THEN 'STRONG BUY' WHEN score >= 15.9 THEN 'STRONG SELL' WHEN score <= -9.2 THEN 'CLEAR BUY' WHEN score >= 9.2 THEN 'CLEAR SELL' WHEN score <= -6 THEN 'LEAN BUY' WHEN score >= 6 THEN 'LEAN SELL' ELSE 'NEUTRAL' END AS label FROM f""")
def d11_convergence(spark, d):
    out = _convergence(spark, d).select("dt", fixed(F.col("raw_agreement"), 4).alias("agreement"), fixed(F.col("raw_score"), 3).alias("score"))
    return out.select("*", scores.convergence_zone(F.col("score")).alias("zone"), scores.conviction_label(F.col("score")).alias("label"))


LEARNED = f"""dp AS (SELECT cs.*, px, row_number() OVER (ORDER BY dt) AS k, px / lag(px, 5) OVER (ORDER BY dt) - 1 AS y FROM cs JOIN target USING (dt)),
dl AS (SELECT dt, k, y, coalesce(count_if(y <> 0) OVER (ORDER BY dt), 0) AS seen, unnest(['direction', 'breadth', 'magnitude', 'regime']) AS series, unnest([2 * d1 - 1, 2 * d2 - 1, 2 * d3 - 1, 2 * d4 - 1]) AS ln, unnest([0.5, 0.2, 0.2, 0.1]) AS prior FROM dp),
dc AS (SELECT *, lag(ln, 5) OVER (PARTITION BY series ORDER BY dt) AS call FROM dl), dg AS (SELECT *, CASE WHEN y IS NOT NULL AND y <> 0 THEN coalesce(sign(call) * sign(y), 0) END AS a FROM dc),
de(series, k, dt, m, w, q) AS (SELECT series, 0::BIGINT, NULL::DATE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM dg WHERE k = 1 UNION ALL
 SELECT dg.series, dg.k, dg.dt, CASE WHEN a IS NULL THEN m ELSE (0.5^(1/252.0) * w * m + a) / (0.5^(1/252.0) * w + 1) END, CASE WHEN a IS NULL THEN w ELSE 0.5^(1/252.0) * w + 1 END, CASE WHEN a IS NULL THEN q ELSE 0.5^(2/252.0) * q + 1 END FROM dg JOIN de ON dg.series = de.series AND dg.k = de.k + 1),
dx AS (SELECT dt, series, exp(0.5 * sqrt(CASE WHEN q > 0 THEN w * w / q ELSE 0 END) * m) AS x FROM de WHERE k > 0), dv AS (SELECT dt, series, 0.8 * x / sum(x) OVER (PARTITION BY dt) + 0.05 AS weight FROM dx),
dw AS (SELECT dt, series, CASE WHEN seen < 126 THEN prior::DOUBLE ELSE weight END AS weight FROM dv JOIN dl USING (dt, series))"""


def _dimensions(spark, d):
    return _convergence(spark, d).join(src.target_daily(spark, d).select("dt", "px"), "dt")


@query(f"WITH RECURSIVE {PANEL}, {TARGET}, {ZP}, {DAILY}, {DIMS}, {LEARNED} SELECT dt, series, {r('weight', 5)} AS weight FROM dw")
def r29_dimension_weights(spark, d):
    return learning.dimension_weights(_dimensions(spark, d), 5).select("dt", "series", fixed(F.col("weight"), 5).alias("weight"))


@query(f"""WITH RECURSIVE {PANEL}, {TARGET}, {ZP}, {DAILY}, {DIMS}, {LEARNED}, ws AS (SELECT dt, sum(weight * ln) AS s FROM dw JOIN dl USING (dt, series) GROUP BY dt) SELECT dt, {r('-lean * (s + 1) / 2 * 100', 4)} AS score FROM cs JOIN ws USING (dt)""")
def r30_reweighted_score(spark, d):
    df = _dimensions(spark, d)
    return learning.reweighted(df, learning.dimension_weights(df, 5)).select("dt", fixed(F.col("score"), 4).alias("score"))


@query()
def r31_out_of_sample(spark, d):
    return learning.out_of_sample(_dimensions(spark, d), (5, 10, 20))


@query()
def a17_ic_summary(spark, d):
    return learning.ic_summary(r31_out_of_sample(spark, d))


FILTERED = f"""fk AS (SELECT dt, {r('score', 3)} AS x, row_number() OVER (ORDER BY dt) AS k FROM cs),
fe(k, dt, x, level, variance) AS (SELECT k, dt, x, x, 50.0::DOUBLE FROM fk WHERE k = 1 UNION ALL SELECT z.k, z.dt, z.x, fe.level * 0.99 + 0.012 * z.x, greatest(fe.variance * 0.99 + 0.01 * 50 + least(abs(0.012 * z.x) / 2, 25), 1e-6) FROM fk z JOIN fe ON z.k = fe.k + 1)"""


@query(f"""WITH RECURSIVE {PANEL}, {TARGET}, {ZP}, {DAILY}, {DIMS}, {FILTERED} SELECT dt, {r('100 * tanh(level / 100)', 4)} AS level, {r('level - 1.96 * sqrt(variance)', 4)} AS low, {r('level + 1.96 * sqrt(variance)', 4)} AS high FROM fe""")
def d13_conviction(spark, d):
    rows = _convergence(spark, d).select(F.lit("target").alias("series"), "dt", fixed(F.col("raw_score"), 3).alias("x"))
    out = learning.bounded_conviction(rows, "x", 0.01, 0.012, 50.0)
    return out.select("dt", *[fixed(F.col(c), 4).alias(c) for c in ("level", "low", "high")])


@query(f"""WITH {TARGET}, a AS (SELECT series, dt, {r(z_sql('px', 20))} AS z FROM target), l AS (SELECT *, list(abs(z)) {over('UNBOUNDED PRECEDING', '1 PRECEDING')} AS before FROM a), s AS (SELECT dt, z, list_sort(before) AS b, len(before) AS n FROM l),
t AS (SELECT dt, z, CASE WHEN n >= 252 AND b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] ELSE 1.5 END AS hi, CASE WHEN n >= 252 AND b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] ELSE 0.7 END AS lo FROM s)
SELECT dt, CASE WHEN z < -hi THEN 'STRONGLY OVERSOLD' WHEN z < -least(lo, hi) THEN 'OVERSOLD' WHEN z > hi THEN 'STRONGLY OVERBOUGHT' WHEN z > least(lo, hi) THEN 'OVERBOUGHT' ELSE 'NEUTRAL' END AS label FROM t""")
def d09_adaptive_labels(spark, d):
    rows = src.target_daily(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 20)).alias("z"))
    return learning.adaptive_labels(rows, "z", 1.5, 0.7).select("dt", "label")


def _quantile_zones(n: int, least: int) -> str:
    q = f"quantile_cont(px, [0.025, 0.5, 0.975]) {over(f'{n} PRECEDING', '1 PRECEDING')}"
    return f"SELECT dt, '{n}' AS w, {r(f'CASE WHEN count(px) {over(f"{n} PRECEDING", "1 PRECEDING")} >= {least} AND (({q})[3] - ({q})[1]) / 1.35 > 1e-12 THEN (px - ({q})[2]) / ((({q})[3] - ({q})[1]) / 1.35) END')} AS z FROM target"


ZONES = f"zs AS ({' UNION ALL '.join(_quantile_zones(n, m) for n, m in ((5, 5), (10, 5), (60, 30)))})"


def _zones(spark, d):
    return lookbacks(src.target_daily(spark, d), "px")


def lookbacks(df, column):
    """(series, dt, z5, z10, z60) of column."""
    each = [sliding.quantile_z(df, column, n, m).select("series", "dt", fixed(F.col("z")).alias(f"z{n}")) for n, m in ((5, 5), (10, 5), (60, 30))]
    return each[0].join(each[1], ["series", "dt"]).join(each[2], ["series", "dt"])


@query(f"""WITH {TARGET}, {ZONES}, z AS (SELECT dt, w, z, lag(z) OVER (PARTITION BY w ORDER BY dt) AS b FROM zs)
SELECT dt, w AS lookback, z, CASE WHEN z IS NULL THEN 'N/A' WHEN z > 2 THEN 'Extreme Over' WHEN z > 1 THEN 'Overvalued' WHEN z > -1 THEN 'Fair Value' WHEN z > -2 THEN 'Undervalued' ELSE 'Extreme Under' END AS zone, coalesce(z < -1 AND b >= -1, false) AS buy, coalesce(z > 1 AND b <= 1, false) AS sell FROM z""")
def d07_lookback_zones(spark, d):
    wide = _zones(spark, d)
    each = []
    for n in (5, 10, 60):
        buy, sell = w.crossings(F.col(f"z{n}"))
        wide = wide.withColumns({f"b{n}": buy, f"s{n}": sell})
        each.append(F.struct(F.lit(str(n)).alias("lookback"), F.col(f"z{n}").alias("z"), fn.zone(F.col(f"z{n}")).alias("zone"), F.col(f"b{n}").alias("buy"), F.col(f"s{n}").alias("sell")))
    return wide.select("dt", F.inline(F.array(*each)))


@query(f"""WITH {TARGET}, {ZONES} SELECT dt, {r('100 * coalesce(count_if(z <= -1), 0) / 3')} AS oversold, {r('100 * coalesce(count_if(z > 1), 0) / 3')} AS overbought, {r('100 * (coalesce(count_if(z > 1 AND z <= 2), 0) - coalesce(count_if(z <= -1 AND z > -2), 0)) / 3 + 150 * (coalesce(count_if(z > 2), 0) - coalesce(count_if(z <= -2), 0)) / 3')} AS conviction, {r('coalesce(avg(z), 0)')} AS mean_z FROM zs GROUP BY dt""")
def d08_breadth_and_conviction(spark, d):
    out = scores.lookback_breadth(_zones(spark, d), ["z5", "z10", "z60"])
    return out.select("dt", *[fixed(F.col(c)).alias(c) for c in ("oversold", "overbought", "conviction", "mean_z")])


@query(f"""WITH {TARGET}, {ZONES}, b AS (SELECT dt, {r('100 * coalesce(count_if(z <= -1), 0) / 3')} AS lo, {r('100 * coalesce(count_if(z > 1), 0) / 3')} AS hi, {r('coalesce(avg(z), 0)')} AS z FROM zs GROUP BY dt)
SELECT dt, CASE WHEN z < -0.5 THEN 'BUY' WHEN z > 0.5 THEN 'SELL' ELSE 'HOLD' END AS signal, CASE WHEN abs(z) > 2 THEN 'STRONG' WHEN abs(z) > 1.25 THEN 'MODERATE' WHEN abs(z) > 0.5 THEN 'WEAK' ELSE 'NONE' END AS strength,
 CASE WHEN abs(z) <= 0.5 THEN CASE WHEN abs(z) < 0.1 THEN 'HIGH' WHEN abs(z) < 0.2 THEN 'MEDIUM' ELSE 'LOW' END WHEN greatest(lo, hi) >= 80 THEN 'HIGH' WHEN greatest(lo, hi) >= 60 THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM b""")
def d10_signals(spark, d):
    b = d08_breadth_and_conviction(spark, d)
    return scores.signal_of(b, F.col("mean_z"), 0.5, 2.0, 0.1, 0.2).select("dt", "signal", "strength", "confidence")


@query(f"""WITH {PANEL}, {TARGET}, {ZP}, {DAILY}, e AS (SELECT 'target' AS series, dt, c, av FROM da), n AS (SELECT dt, {clip_sql(f"(c - avg(c) {over('UNBOUNDED PRECEDING')}) / greatest(coalesce(stddev_samp(c) {over('UNBOUNDED PRECEDING')}, 1), 1e-10) / 3", -1, 1)} AS a, {clip_sql(f"(av - avg(av) {over('UNBOUNDED PRECEDING')}) / greatest(coalesce(stddev_samp(av) {over('UNBOUNDED PRECEDING')}, 1), 1e-10) / 3", -1, 1)} AS b FROM e),
k AS (SELECT dt, {r('(a + b) / 2', 5)} AS consensus FROM n) SELECT *, CASE WHEN consensus > 0.404 THEN 'STRONG_SELL' WHEN consensus > 0.279 THEN 'SELL' WHEN consensus < -0.404 THEN 'STRONG_BUY' WHEN consensus < -0.279 THEN 'BUY' ELSE 'HOLD' END AS label FROM k""")
def d15_consensus(spark, d):
    rows = learning.consensus(_daily(spark, d).withColumn("series", F.lit("target")), "conviction", "avg_score").select("dt", fixed(F.col("consensus"), 5).alias("consensus"))
    return rows.withColumn("label", scores.consensus_label(F.col("consensus"), 0.279, 0.404))


@query(f"""WITH {PANEL}, {TARGET}, {ZP}, {DAILY}, v AS (SELECT dt, lo, dt IN (SELECT dt FROM zp) AS native, row_number() OVER (ORDER BY dt) AS k FROM da) SELECT dt, lo AS oversold, native FROM v WHERE k > 100 AND (SELECT count_if(native) FROM v WHERE k > 100) >= 60""")
def d24_native_overlap(spark, d):
    panel = src.panel_daily(spark, d).select("dt").distinct().withColumn("native", F.lit(True))
    rows = _daily(spark, d).join(panel, "dt", "left").na.fill({"native": False}).select("dt", "oversold", "native")
    return learning.native_enough(rows, 100)


@query(f"""WITH {PANEL}, {SPINE}, l AS (SELECT series, max(dt) AS newest FROM panel GROUP BY series), b AS (SELECT series, newest, (SELECT count(*) FROM weekdays k WHERE k.dt > l.newest) AS behind FROM l)
SELECT *, CASE WHEN behind = 0 THEN 'current' WHEN behind = 1 THEN 'one session behind' WHEN behind <= 10 THEN 'behind' ELSE 'stale' END AS notice FROM b""")
def d27_freshness_notices(spark, d):
    panel = src.panel_daily(spark, d)
    return freshness.notices(panel, weekdays(panel))


@query(f"""WITH {PANEL}, n AS (SELECT series, dt, {r('px', 3)} AS px, dt = max(dt) OVER (PARTITION BY series) AND dt >= DATE '1998-06-01' AS provisional FROM panel) SELECT * FROM n""")
def d28_provisional_rows(spark, d):
    rows = freshness.provisional(src.panel_daily(spark, d), "1998-06-01")
    return rows.select("series", "dt", fixed(F.col("px"), 3).alias("px"), "provisional")


@query(f"""WITH {PANEL}, l AS (SELECT series, ln(px) AS x, lag(ln(px)) {LAG} AS b FROM panel), k AS (SELECT series, x - b AS dx, b FROM l WHERE b IS NOT NULL),
f AS (SELECT series, count(*) AS n, regr_slope(dx, b) AS s, regr_sxx(dx, b) AS sxx, regr_syy(dx, b) AS syy, regr_sxy(dx, b) AS sxy FROM k GROUP BY series) SELECT series, n, {r('s / sqrt((syy - s * sxy) / (n - 2) / sxx)', 4)} AS t, s / sqrt((syy - s * sxy) / (n - 2) / sxx) < -2.86 AS reverts FROM f""")
def a23_unit_root(spark, d):
    out = stats.unit_root(src.panel_daily(spark, d).withColumn("x", F.log("px")), "x")
    return out.withColumn("t", fixed(F.col("t"), 4))


@query()
def a06_t_tests(spark, d):
    """The performance of signals with two-sided p-values."""
    rows = src.panel_daily(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 60)).alias("z"), w.forward_change(F.col("px"), 5).alias("f"))
    out = stats.signal_performance(rows, "z", "f", 5, 1.0)
    return out.withColumn("p", stats.t_p_value(F.col("t"), F.col("n") - 1))
