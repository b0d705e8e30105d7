"""Queries of joins, set operations, selections and small aggregates, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.functions import scalar as fn
from tidemark.functions.scalar import fixed
from tidemark.operators import align, calendars, folds, relations, roots, scores, segments, stats
from tidemark.operators import windows as w
from tidemark.operators.align import ordered
from tidemark.plans.catalogue import DAILY, FILLED, PRINTS, ZP, _daily, _filled, _panel_z, weekdays
from tidemark.plans.registry import LAG, PANEL, SPINE, TARGET, over, query, r, z_sql
from tidemark.sources import sinks, staging
from tidemark.sources import tables as src
from tidemark.streaming import typed

BLANK = "CASE WHEN right(series, 1) <> '4' AND day(dt) % 5 > 0 THEN px END"


def _blanked(spark, d):
    """The panel without any value of some series, and without some values of the others."""
    return src.panel_daily(spark, d).withColumn("px", F.when((F.right("series", F.lit(1)) != "4") & (F.dayofmonth("dt") % 5 > 0), F.col("px")))


@query(f"WITH {PANEL}, b AS (SELECT series, dt, {BLANK} AS px FROM panel) SELECT series, dt, {r('px', 3)} AS px FROM b WHERE px IS NOT NULL")
def s03_valued_series(spark, d):
    return relations.valued_series(_blanked(spark, d)).select("series", "dt", fixed(F.col("px"), 3).alias("px"))


@query("SELECT user_id AS series, count(value) AS n FROM events GROUP BY 1 HAVING count(value) >= 20")
def s10_usable_series(spark, d):
    rows = src.table(spark, d, "events").select(F.col("user_id").alias("series"), F.col("value").alias("px"))
    return relations.valued_series(rows, 20).groupBy("series").agg(F.count("px").alias("n"))


@query(f"""WITH {PANEL}, b AS (SELECT series, dt, {BLANK} AS px FROM panel), u AS (SELECT series, dt, px, 0 AS source FROM b UNION ALL SELECT series, dt, px + 1, 1 FROM panel)
SELECT series, dt, {r('arg_min(px, source)', 3)} AS px, min(source) AS source FROM u WHERE px IS NOT NULL AND dt BETWEEN DATE '1995-01-01' AND DATE '1997-06-30' GROUP BY 1, 2""")
def s14_source_cascade(spark, d):
    snapshot = src.panel_daily(spark, d).withColumn("px", F.col("px") + 1)
    return relations.by_priority([_blanked(spark, d), snapshot], "1995-01-01", "1997-06-30").withColumn("px", fixed(F.col("px"), 3))


@query("""SELECT min(p_partkey) AS place, upper(trim(split_part(p_name, ' ', 1))) || '.NS' AS symbol FROM part GROUP BY 2""")
def s16_listed_symbols(spark, d):
    return relations.in_first_order(src.table(spark, d, "part"), F.upper(F.trim(F.split_part("p_name", F.lit(" "), F.lit(1)))), "p_partkey", ".NS")


@query("""WITH s AS (SELECT s_nationkey, s_suppkey, upper(trim(CASE WHEN s_suppkey % 3 = 0 THEN 'A.' || s_suppkey % 1000 ELSE 'SUPPLIERNAME' || s_suppkey END)) AS x FROM supplier),
n AS (SELECT s_suppkey % 4 AS page FROM s GROUP BY 1 HAVING count(*) >= 2) SELECT s_suppkey % 4 AS page, replace(x, '.', '-') AS symbol, row_number() OVER (PARTITION BY s_suppkey % 4 ORDER BY s_suppkey) AS place
FROM s SEMI JOIN n ON n.page = s_suppkey % 4 QUALIFY length(x) BETWEEN 1 AND 6""")
def s17_html_table(spark, d):
    """Pages with tables of suppliers, written here as HTML and read back."""
    symbol = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit(" a."), F.col("s_suppkey") % 1000)).otherwise(F.concat(F.lit("suppliername"), "s_suppkey"))
    row = F.concat(F.lit("<tr class='x'><td>x</td><td> <b>"), symbol, F.lit("</b></td></tr>\n"))
    pages = src.table(spark, d, "supplier").groupBy((F.col("s_suppkey") % 4).alias("page")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", row.alias("h")))), lambda x: x["h"]), "").alias("rows"))
    other = "<TABLE><tr><th>Country</th></tr><tr><td>none</td></tr></TABLE>"
    html = pages.select("page", F.concat(F.lit(other + "<table id=1>\n<tr><th>Name</th><th>Ticker <i>symbol</i></th></tr>"), "rows", F.lit("</table>")).alias("html"))
    return src.listed_symbols(html, "page", 2)


@query("""WITH n AS (SELECT s_name AS name, s_suppkey FROM supplier), c AS (SELECT name, 0 AS place, name || '.NS' AS symbol FROM n WHERE s_suppkey % 3 = 0 UNION ALL SELECT name, 1, name || '.BO' FROM n WHERE s_suppkey % 2 = 0)
SELECT name, arg_min(symbol, place) AS symbol FROM c GROUP BY name""")
def s19_first_usable(spark, d):
    s = src.table(spark, d, "supplier").select(F.col("s_name").alias("name"), "s_suppkey")
    usable = s.where("s_suppkey % 3 = 0").select(F.concat("name", F.lit(".NS")).alias("symbol")).unionByName(s.where("s_suppkey % 2 = 0").select(F.concat("name", F.lit(".BO")).alias("symbol")))
    return relations.first_usable(s.select("name"), [".NS", ".BO"], usable)


@query(f"WITH {TARGET} SELECT CAST(dt AS VARCHAR) AS dt, CAST(CAST(floor(px * 100) AS BIGINT) AS VARCHAR) AS cents FROM target")
def s27_csv_sink(spark, d):
    rows = src.target_daily(spark, d).select("dt", F.floor(F.col("px") * 100).alias("cents"))
    return sinks.csv_round_trip(rows, "s27")


@query(f"""WITH {PANEL}, o AS (SELECT series, row_number() OVER (ORDER BY series DESC) AS place FROM (SELECT DISTINCT series FROM panel)),
k AS (SELECT *, lag(px) {LAG} AS b, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS k FROM panel) SELECT place, series, dt, {r('px', 3)} AS px, {r('px / b * 100 - 100', 4)} AS change FROM k JOIN o USING (series) WHERE k = 1""")
def s29_tape(spark, d):
    panel = src.panel_daily(spark, d)
    names = panel.select("series").distinct().agg(F.reverse(F.array_sort(F.collect_set("series"))).alias("all"))
    order = names.select(F.posexplode("all").alias("place", "series")).withColumn("place", (F.col("place") + 1).cast("long"))
    return relations.tape(panel, order).select("place", "series", "dt", fixed(F.col("px"), 3).alias("px"), fixed(F.col("change"), 4).alias("change"))


NAMES = "names AS (SELECT p_brand AS series, min(p_type) || '/' || p_brand AS name FROM part GROUP BY p_brand)"


def _names(spark, d):
    n = src.table(spark, d, "part").groupBy(F.col("p_brand").alias("series")).agg(F.min("p_type").alias("m"))
    return n.select("series", F.concat("m", F.lit("/"), "series").alias("name"))


@query(f"WITH {PANEL}, {NAMES} SELECT name AS series, count(*) AS n FROM panel JOIN names USING (series) GROUP BY 1")
def p01_named_series(spark, d):
    return relations.named(src.panel_daily(spark, d), _names(spark, d)).groupBy("series").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, g AS (SELECT right(series, 1) AS series, dt, avg(px) AS px FROM panel GROUP BY 1, 2) SELECT dt FROM g GROUP BY dt HAVING count(px) = (SELECT count(DISTINCT series) FROM g)""")
def p06_complete_dates(spark, d):
    groups = src.panel_daily(spark, d).groupBy(F.right("series", F.lit(1)).alias("series"), "dt").agg(F.avg("px").alias("px"))
    return relations.complete_dates(groups)


@query("SELECT event_id, TRY_CAST(CASE WHEN event_id % 5 = 0 THEN 'n/a' ELSE CAST(event_id AS VARCHAR) END AS DOUBLE) AS px FROM events")
def p07_numeric_cells(spark, d):
    text = src.table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("event_id").cast("string")).alias("cell"))
    return text.select("event_id", src.number(F.col("cell")).alias("px"))


PAIRS = "pairs AS (SELECT a.n_name AS target, b.n_name AS series, a.n_regionkey AS x, b.n_regionkey AS y FROM nation a CROSS JOIN nation b)"


def _pairs(spark, d):
    n = src.table(spark, d, "nation")
    return n.select(F.col("n_name").alias("target"), F.col("n_regionkey").alias("x")).join(n.select(F.col("n_name").alias("series"), F.col("n_regionkey").alias("y")))  # 25 nations


@query(f"WITH {PAIRS} SELECT target, series FROM pairs WHERE target <> series AND x <> y")
def p09_leakage_exclusions(spark, d):
    pairs = _pairs(spark, d)
    return relations.excluding(pairs.select("target", "series"), pairs.where("x = y").select("target", "series"))


@query(f"WITH {PAIRS} SELECT target, series FROM pairs WHERE target <> series AND NOT (right(target, 1) = right(series, 1))")
def p10_replica_names(spark, d):
    pairs = _pairs(spark, d).select("target", "series")
    return relations.excluding(pairs, pairs.where("right(target, 1) = right(series, 1)"))


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region WHERE r_name NOT IN (SELECT n_name FROM nation)")
def p11_registered_targets(spark, d):
    nations, regions = (src.table(spark, d, t).select(F.col(f"{t[0]}_name").alias("name"), F.lit(t).alias("kind")) for t in ("nation", "region"))
    return relations.extended(nations, regions, "name")


@query(f"WITH {PANEL} SELECT series, count(*) AS n FROM panel WHERE series NOT IN ('Brand#11', 'Brand#1') GROUP BY series")
def p12_without_yields(spark, d):
    return relations.without(src.panel_daily(spark, d), ["Brand#11", "Brand#1"]).groupBy("series").agg(F.count("*").alias("n"))


@query(f"WITH {PANEL}, b AS (SELECT series, {BLANK} AS px FROM panel) SELECT series, count(px) AS n_rows, {r('min(px)', 3)} AS lowest, coalesce(count(px) >= 200 AND min(px) > 0, false) AS fit FROM b GROUP BY series")
def p15_row_gates(spark, d):
    return relations.gates(_blanked(spark, d), 200).withColumn("lowest", fixed(F.col("lowest"), 3))


VOL = f"v AS (SELECT series, dt, stddev_samp(ret) {over('20 PRECEDING', '1 PRECEDING')} AS sd, ret FROM (SELECT *, ln(px) - lag(ln(px)) {LAG} AS ret FROM panel))"


@query(f"""WITH {PANEL}, {PRINTS}, {VOL} SELECT series, dt, n_prints >= 100 AS admitted, coalesce(ret IS NOT NULL AND printed AND n_prints >= 100 AND sd > 1e-7, false) AS available,
{r("CASE WHEN printed AND n_prints >= 100 AND ret IS NOT NULL AND sd > 1e-7 THEN greatest(least(ret / sd, 6), -6) END")} AS z FROM c JOIN v USING (series, dt)""")
def p18_availability(spark, d):
    panel = src.panel_daily(spark, d).withColumn("ret", F.log("px") - F.lag(F.log("px")).over(ordered())).withColumn("sd", F.stddev_samp("ret").over(w.prior(20)))
    prints = align.admitted(panel.select("series", "dt", F.round("px", 0).alias("px")), 100)
    rows = align.available(panel.drop("px").join(prints, ["series", "dt"]))
    return rows.select("series", "dt", "admitted", "available", fixed(F.when(F.col("available"), fn.clip(F.col("ret") / F.col("sd"), -6, 6))).alias("z"))


@query(f"""WITH {PANEL}, {PRINTS}, n AS (SELECT dt, count_if(n_prints >= 100) AS a, count_if(n_prints >= 100 AND printed) AS p FROM c GROUP BY dt), g AS (SELECT dt, a > 0 AND p / a >= 0.6 AND p >= 10 AS publish FROM n)
SELECT series, dt, {r('px', 3)} AS actual, {r('CASE WHEN publish THEN px END', 3)} AS px FROM panel JOIN g USING (dt)""")
def p19_publish_mask(spark, d):
    panel = src.panel_daily(spark, d)
    days = align.complete_days(align.admitted(panel.withColumn("px", F.round("px", 0)), 100).withColumn("open", F.lit(True)), least=10).select("dt", F.col("complete").alias("publish"))
    rows = align.published(panel.withColumn("actual", F.col("px")).join(days, "dt"), "publish", ["px"])
    return rows.select("series", "dt", fixed(F.col("actual"), 3).alias("actual"), fixed(F.col("px"), 3).alias("px"))


@query(f"""WITH {PANEL}, {TARGET}, j AS (SELECT p.series, p.dt, p.px, t.px AS y FROM panel p LEFT JOIN (SELECT * FROM target WHERE day(dt) % 4 > 0) t USING (dt))
SELECT series, dt, {r('px', 3)} AS px, {r(f"last_value(y IGNORE NULLS) {over('UNBOUNDED PRECEDING')}", 3)} AS y FROM j""")
def j01_macro_carried(spark, d):
    macro = src.target_daily(spark, d).where(F.dayofmonth("dt") % 4 > 0).select("dt", F.col("px").alias("y"))
    return relations.carried(src.panel_daily(spark, d), macro, ["y"]).select("series", "dt", fixed(F.col("px"), 3).alias("px"), fixed(F.col("y"), 3).alias("y"))


BREADTH = f"""vw AS (SELECT zp.series, dt, z, 1 + (ascii(right(series, 1)) - 48) / 10 AS weight FROM zp), br AS (SELECT dt, {r("100 * sum(CASE WHEN z < -1 THEN weight ELSE 0 END) / sum(weight)")} AS oversold FROM vw GROUP BY dt)"""


@query(f"WITH {PANEL}, {TARGET}, {ZP}, {BREADTH}, {SPINE} SELECT dt, {r('px', 3)} AS px, oversold FROM target JOIN br USING (dt) SEMI JOIN weekdays USING (dt)")
def j04_joined_days(spark, d):
    from tidemark.plans.catalogue import a01_weighted_breadth

    target = src.target_daily(spark, d).select("dt", fixed(F.col("px"), 3).alias("px"))
    breadth = a01_weighted_breadth(spark, d).select("dt", F.col("oversold_pct").alias("oversold"))
    return relations.joined_days(target, breadth, weekdays(src.panel_daily(spark, d)))


@query(f"WITH {PANEL}, {TARGET}, {ZP}, {BREADTH} SELECT dt, {r('px', 3)} AS px, coalesce(oversold, 50) AS oversold FROM target LEFT JOIN (SELECT * FROM br WHERE day(dt) % 2 = 0) USING (dt)")
def j05_neutral_defaults(spark, d):
    from tidemark.plans.catalogue import a01_weighted_breadth

    breadth = a01_weighted_breadth(spark, d).where(F.dayofmonth("dt") % 2 == 0).select("dt", F.col("oversold_pct").alias("oversold"))
    return relations.with_defaults(src.target_daily(spark, d).select("dt", fixed(F.col("px"), 3).alias("px")), breadth, {"oversold": 50.0})


@query(f"WITH {PANEL} SELECT DISTINCT dt FROM panel")
def j06_view_dates(spark, d):
    return relations.all_dates(src.panel_daily(spark, d))


@query(f"""WITH {PANEL}, q AS (SELECT left(series, 7) AS series, date_trunc('month', dt)::DATE AS dt, avg(px) AS x FROM panel GROUP BY 1, 2)
SELECT dt, array_to_string(list_transform(list(x ORDER BY series), lambda v: CAST(CAST(floor(v) AS BIGINT) AS VARCHAR)), ',') AS values FROM q GROUP BY dt HAVING count(*) = (SELECT count(DISTINCT series) FROM q)""")
def j07_common_rows(spark, d):
    q = src.panel_daily(spark, d).groupBy(F.left("series", F.lit(7)).alias("series"), F.trunc("dt", "month").alias("dt")).agg(F.avg("px").alias("x"))
    return relations.common_rows(q, "x").select("dt", F.array_join(F.transform("values", lambda v: F.floor(v).cast("string")), ",").alias("values"))


@query(f"""WITH {PANEL}, {TARGET}, s AS (SELECT DISTINCT dt FROM panel WHERE day(dt) % 2 = 0), p AS (SELECT dt, px FROM target WHERE day(dt) % 3 > 0), j AS (SELECT s.dt, p.px IS NOT NULL AS native, p.px FROM s LEFT JOIN p USING (dt)),
f AS (SELECT dt, native, last_value(px IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS px FROM j), k AS (SELECT *, lead(px, 5) OVER (ORDER BY dt) / px - 1 AS a, lead(px, 10) OVER (ORDER BY dt) / px - 1 AS b FROM f)
SELECT dt, native, {r('px', 3)} AS px, {r('a')} AS ahead_5, {r('b')} AS ahead_10 FROM k WHERE a IS NOT NULL AND b IS NOT NULL""")
def j11_calibration(spark, d):
    dates = src.panel_daily(spark, d).select("dt").distinct().where(F.dayofmonth("dt") % 2 == 0)
    rows = relations.calibration(dates, src.target_daily(spark, d).where(F.dayofmonth("dt") % 3 > 0), (5, 10))
    return rows.select("dt", "native", fixed(F.col("px"), 3).alias("px"), fixed(F.col("ahead_5")).alias("ahead_5"), fixed(F.col("ahead_10")).alias("ahead_10"))


TICKERS = "tk AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'ABC.NS' WHEN 1 THEN 'XYZ.BO' WHEN 2 THEN 'GC=F' WHEN 3 THEN 'EURUSD=X' WHEN 4 THEN '^NSEI' WHEN 5 THEN '^GSPC' WHEN 6 THEN 'SHEL.L' ELSE 'IBM' END AS ticker FROM supplier)"


def _tickers(spark, d):
    known = F.array(*map(F.lit, ("ABC.NS", "XYZ.BO", "GC=F", "EURUSD=X", "^NSEI", "^GSPC", "SHEL.L", "IBM")))
    return src.table(spark, d, "supplier").select("s_suppkey", F.get(known, (F.col("s_suppkey") % 8).cast("int")).alias("ticker"))


@query(f"""WITH {TICKERS}, e AS (SELECT *, CASE WHEN ticker LIKE '%.NS' OR ticker LIKE '%.BO' OR ticker = '^NSEI' THEN 'XNSE' WHEN ticker LIKE '%=F' THEN 'CMES' WHEN ticker LIKE '%=X' THEN 'WEEK' WHEN ticker LIKE '%.L' THEN 'XLON' ELSE 'XNYS' END AS exchange FROM tk),
days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-14', INTERVAL 1 DAY)) AS DATE) AS dt), x AS (SELECT DISTINCT exchange FROM e),
s AS (SELECT exchange, dt FROM x, days WHERE isodow(dt) <= 5 AND NOT (exchange IN ('XNYS', 'CMES', 'XLON') AND dt = DATE '2024-01-01'))
SELECT exchange, count(DISTINCT ticker) AS n_tickers, count(DISTINCT dt) AS n_sessions FROM e JOIN s USING (exchange) GROUP BY exchange""")
def j12_exchange_sessions(spark, d):
    holidays = spark.createDataFrame([(x, "2024-01-01") for x in ("XNYS", "CMES", "XLON")], "exchange string, dt string").withColumn("dt", F.to_date("dt"))
    exchanges = _tickers(spark, d).select("ticker", fn.exchange_of(F.col("ticker")).alias("exchange"))
    sessions = align.sessions(exchanges.select("exchange").distinct(), "2024-01-01", "2024-01-14", holidays)
    return exchanges.join(sessions, "exchange").groupBy("exchange").agg(F.countDistinct("ticker").alias("n_tickers"), F.countDistinct("dt").alias("n_sessions"))


@query(f"WITH {PANEL}, {TARGET}, {SPINE} SELECT dt, {r('last_value(t.px IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)', 3)} AS px FROM weekdays LEFT JOIN (SELECT * FROM target WHERE day(dt) % 3 > 0) t USING (dt)")
def j15_injected_target(spark, d):
    target = src.target_daily(spark, d).where(F.dayofmonth("dt") % 3 > 0)
    return align.reindex_ffill(target, weekdays(src.panel_daily(spark, d))).select("dt", fixed(F.col("px"), 3).alias("px"))


@query(f"""WITH {TARGET}, a AS (SELECT series, dt, abs({r(z_sql('px', 20))}) AS x FROM target), l AS (SELECT *, list(x) {over('UNBOUNDED PRECEDING', '1 PRECEDING')} AS before FROM a), s AS (SELECT dt, x, list_sort(before) AS b, len(before) AS n FROM l WHERE isodow(dt) <= 5),
t AS (SELECT dt, CASE WHEN n >= 60 AND b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] ELSE 1.5 END AS hi FROM s) SELECT a.dt, {r('x')} AS x, {r('coalesce(hi, 9)')} AS hi FROM a LEFT JOIN t USING (dt)""")
def j16_tiers_of_dates(spark, d):
    rows = src.target_daily(spark, d).select("series", "dt", F.abs(fixed(w.causal_z(F.col("px"), 20))).alias("x"))
    tiers = folds.expanding_quantiles(rows, "x", {"hi": (0.9, 1.5)}, 60).where(F.weekday("dt") < 5)  # tiers are of sessions
    return relations.with_tiers(rows, tiers, {"hi": 9.0}).select("dt", fixed(F.col("x")).alias("x"), fixed(F.col("hi")).alias("hi"))


@query(f"WITH {PANEL}, {TARGET}, {ZP}, {DAILY} SELECT g AS regime, count(*) AS n, (SELECT arg_max(g, dt) FROM da) = g AS now FROM da GROUP BY g")
def a03_regime_counts(spark, d):
    return stats.label_counts(_daily(spark, d), "regime")


@query(f"""WITH {PANEL}, k AS (SELECT series, px, CAST(row_number() {LAG} AS DOUBLE) AS t, count(*) OVER (PARTITION BY series) AS n FROM panel), s AS (SELECT *, t <= floor(0.7::DOUBLE * n) AS train FROM k),
f AS (SELECT series, regr_slope(px, t) AS a, regr_intercept(px, t) AS b, regr_slope(t * t, t) AS u, regr_intercept(t * t, t) AS v FROM s WHERE train GROUP BY series), q AS (SELECT s.*, a, b, t * t - u * t - v AS q FROM s JOIN f USING (series)),
g AS (SELECT series, sum(px * q) / sum(q * q) AS c FROM q WHERE train GROUP BY series)
SELECT series, {r('any_value(a)')} AS slope, {r('any_value(c)', 9)} AS bend, {r('any_value(b)', 3)} AS start, {r('corr(px, a * t + b + c * q) FILTER (train)')} AS r_train, {r('corr(px, a * t + b + c * q) FILTER (NOT train)')} AS r_test FROM q JOIN g USING (series) GROUP BY series""")
def a25_curve_fit(spark, d):
    out = stats.curve_fit(src.panel_daily(spark, d), "px", 0.7)
    return out.select("series", *[fixed(F.col(c), k).alias(c) for c, k in (("slope", 6), ("bend", 9), ("start", 3), ("r_train", 6), ("r_test", 6))])


@query(f"""WITH {PANEL}, {SPINE}, v AS (SELECT 'a' AS source, 1 AS version, series, dt, px FROM panel WHERE year(dt) <= 1998 UNION ALL SELECT 'b', 2, series, dt, px FROM panel WHERE year(dt) > 1996 AND right(series, 1) IN ('1', '2', '3')),
k AS (SELECT series, source, max(version) AS version, count(px) AS coverage FROM v SEMI JOIN weekdays USING (dt) GROUP BY 1, 2), best AS (SELECT series, arg_max(source, (coverage, version)) AS source FROM k GROUP BY series),
w AS (SELECT v.* FROM v JOIN best USING (series, source) SEMI JOIN weekdays USING (dt)), l AS (SELECT series, source, max(dt) AS newest FROM w GROUP BY 1, 2), ok AS (SELECT series, source FROM l WHERE (SELECT count(*) FROM weekdays d WHERE d.dt > l.newest) <= 10)
SELECT ok.series, d.dt, {r('last_value(w.px IGNORE NULLS) OVER (PARTITION BY ok.series ORDER BY d.dt)', 3)} AS px, ok.source FROM ok CROSS JOIN weekdays d LEFT JOIN w ON w.series = ok.series AND w.dt = d.dt""")
def s25_repaired_series(spark, d):
    """Series repaired from the source that covers the weekdays best, if it is recent enough."""
    panel = src.panel_daily(spark, d)
    a = panel.where(F.year("dt") <= 1998).select(F.lit("a").alias("source"), F.lit(1).alias("version"), "series", "dt", "px")
    b = panel.where((F.year("dt") > 1996) & F.right("series", F.lit(1)).isin("1", "2", "3")).select(F.lit("b").alias("source"), F.lit(2).alias("version"), "series", "dt", "px")
    out = src.repaired(weekdays(panel), a.unionByName(b), panel.where("px IS NULL").select("series"))
    return out.select("series", "dt", fixed(F.col("px"), 3).alias("px"), "source")


@query(f"""WITH {PANEL}, {TARGET}, {SPINE}, {NAMES}, n AS (SELECT name AS series, dt, px FROM panel JOIN names USING (series)), e AS (SELECT series FROM n SEMI JOIN weekdays USING (dt) GROUP BY series HAVING count(*) >= 0.2 * (SELECT count(*) FROM weekdays)),
rw AS (SELECT * FROM n SEMI JOIN e USING (series) UNION ALL SELECT 'sheet' AS series, dt, px FROM target), g AS (SELECT series, dt FROM (SELECT DISTINCT series FROM rw) CROSS JOIN weekdays),
f AS (SELECT coalesce(g.series, rw.series) AS series, coalesce(g.dt, rw.dt) AS dt, g.dt IS NOT NULL AS spine, px FROM rw FULL JOIN g ON g.series = rw.series AND g.dt = rw.dt),
h AS (SELECT series, dt, spine, last_value(px IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt) AS px FROM f) SELECT series, dt, {r('px', 3)} AS px FROM h WHERE spine AND px IS NOT NULL""")
def s07_model_rows(spark, d):
    """The model's rows: the panel under its names and the target as a sheet's series, along the weekdays."""
    panel = src.panel_daily(spark, d)
    out = src.model_rows(panel, _names(spark, d), weekdays(panel), src.target_daily(spark, d).withColumn("series", F.lit("sheet")))
    return out.select("series", "dt", fixed(F.col("px"), 3).alias("px"))


@query(f"""WITH {PANEL}, b AS (SELECT series, {BLANK} AS px FROM panel), m AS (SELECT series, median(px) AS m FROM b GROUP BY series) SELECT series, {r('sum(coalesce(px, m))', 2)} AS total, count(*) AS n FROM b JOIN m USING (series) GROUP BY series""")
def a11_median_imputation(spark, d):
    rows = stats.median_imputed(_blanked(spark, d), ["px"])
    return rows.groupBy("series").agg(fixed(F.sum("px"), 2).alias("total"), F.count("*").alias("n"))


@query("""WITH e AS (SELECT event_type, CAST(ts AS DATE) AS dt FROM events) SELECT event_type, count(*) AS n, count_if(dt >= (SELECT max(dt) FROM e) - 5) AS recent FROM e GROUP BY 1""")
def a18_event_counts(spark, d):
    return relations.persistence_of_latest(src.table(spark, d, "events").select("event_type", F.to_date("ts").alias("dt")), "event_type", 5)


@query(f"""WITH {PANEL}, l AS (SELECT series, px AS x, lag(px) {LAG} AS b FROM panel), f AS (SELECT series, count(*) AS n, corr(x, b) AS c FROM l WHERE b IS NOT NULL GROUP BY series),
p AS (SELECT series, n, least(greatest(c + (1 + 3 * c) / n, 1e-6), 0.9999) AS phi FROM f) SELECT series, {r('phi')} AS phi, {r('ln(2) / -ln(phi)', 4)} AS half_life FROM p""")
def a22_half_life(spark, d):
    out = stats.half_life(src.panel_daily(spark, d), "px")
    return out.select("series", fixed(F.col("phi")).alias("phi"), fixed(F.col("half_life"), 4).alias("half_life"))


@query(f"""WITH {PANEL}, k AS (SELECT series, px, row_number() {LAG} AS t, count(*) OVER (PARTITION BY series) AS n FROM panel), s AS (SELECT *, t <= floor(0.7::DOUBLE * n) AS train FROM k),
f AS (SELECT series, regr_slope(px, t) AS a, regr_intercept(px, t) AS b FROM s WHERE train GROUP BY series)
SELECT series, {r('any_value(a)')} AS slope, {r('any_value(b)', 3)} AS start, {r('corr(px, a * t + b) FILTER (train)')} AS r_train, {r('corr(px, a * t + b) FILTER (NOT train)')} AS r_test FROM s JOIN f USING (series) GROUP BY series""")
def a25_trend_fit(spark, d):
    out = stats.trend_fit(src.panel_daily(spark, d), "px", 0.7)
    return out.select("series", *[fixed(F.col(c), k).alias(c) for c, k in (("slope", 6), ("start", 3), ("r_train", 6), ("r_test", 6))])


@query(f"""WITH {PANEL}, k AS (SELECT series, px, CAST(row_number() {LAG} AS DOUBLE) AS t, count(*) OVER (PARTITION BY series) AS n FROM panel), s AS (SELECT *, t <= floor(0.7::DOUBLE * n) AS train FROM k),
f AS (SELECT series, regr_slope(px, t) AS a, regr_intercept(px, t) AS b, regr_slope(t * t, t) AS u, regr_intercept(t * t, t) AS v FROM s WHERE train GROUP BY series), q AS (SELECT s.*, a, b, t * t - u * t - v AS q FROM s JOIN f USING (series)),
g AS (SELECT series, sum(px * q) / sum(q * q) AS c FROM q WHERE train GROUP BY series)
SELECT series, {r('any_value(a)')} AS slope, {r('any_value(c)', 9)} AS bend, {r('any_value(b)', 3)} AS start, {r('corr(px, a * t + b + c * q) FILTER (train)')} AS r_train, {r('corr(px, a * t + b + c * q) FILTER (NOT train)')} AS r_test FROM q JOIN g USING (series) GROUP BY series""")
def a25_curve_fit(spark, d):
    out = stats.curve_fit(src.panel_daily(spark, d), "px", 0.7)
    return out.select("series", *[fixed(F.col(c), k).alias(c) for c, k in (("slope", 6), ("bend", 9), ("start", 3), ("r_train", 6), ("r_test", 6))])


@query(f"""WITH {PANEL}, {SPINE}, v AS (SELECT 'a' AS source, 1 AS version, series, dt, px FROM panel WHERE year(dt) <= 1998 UNION ALL SELECT 'b', 2, series, dt, px FROM panel WHERE year(dt) > 1996 AND right(series, 1) IN ('1', '2', '3')),
k AS (SELECT series, source, max(version) AS version, count(px) AS coverage FROM v SEMI JOIN weekdays USING (dt) GROUP BY 1, 2), best AS (SELECT series, arg_max(source, (coverage, version)) AS source FROM k GROUP BY series),
w AS (SELECT v.* FROM v JOIN best USING (series, source) SEMI JOIN weekdays USING (dt)), l AS (SELECT series, source, max(dt) AS newest FROM w GROUP BY 1, 2), ok AS (SELECT series, source FROM l WHERE (SELECT count(*) FROM weekdays d WHERE d.dt > l.newest) <= 10)
SELECT ok.series, d.dt, {r('last_value(w.px IGNORE NULLS) OVER (PARTITION BY ok.series ORDER BY d.dt)', 3)} AS px, ok.source FROM ok CROSS JOIN weekdays d LEFT JOIN w ON w.series = ok.series AND w.dt = d.dt""")
def s25_repaired_series(spark, d):
    """Series repaired from the source that covers the weekdays best, if it is recent enough."""
    panel = src.panel_daily(spark, d)
    a = panel.where(F.year("dt") <= 1998).select(F.lit("a").alias("source"), F.lit(1).alias("version"), "series", "dt", "px")
    b = panel.where((F.year("dt") > 1996) & F.right("series", F.lit(1)).isin("1", "2", "3")).select(F.lit("b").alias("source"), F.lit(2).alias("version"), "series", "dt", "px")
    out = src.repaired(weekdays(panel), a.unionByName(b), panel.where("px IS NULL").select("series"))
    return out.select("series", "dt", fixed(F.col("px"), 3).alias("px"), "source")


@query(f"""WITH {PANEL}, {TARGET}, {SPINE}, {NAMES}, n AS (SELECT name AS series, dt, px FROM panel JOIN names USING (series)), e AS (SELECT series FROM n SEMI JOIN weekdays USING (dt) GROUP BY series HAVING count(*) >= 0.2 * (SELECT count(*) FROM weekdays)),
rw AS (SELECT * FROM n SEMI JOIN e USING (series) UNION ALL SELECT 'sheet' AS series, dt, px FROM target), g AS (SELECT series, dt FROM (SELECT DISTINCT series FROM rw) CROSS JOIN weekdays),
f AS (SELECT coalesce(g.series, rw.series) AS series, coalesce(g.dt, rw.dt) AS dt, g.dt IS NOT NULL AS spine, px FROM rw FULL JOIN g ON g.series = rw.series AND g.dt = rw.dt),
h AS (SELECT series, dt, spine, last_value(px IGNORE NULLS) OVER (PARTITION BY series ORDER BY dt) AS px FROM f) SELECT series, dt, {r('px', 3)} AS px FROM h WHERE spine AND px IS NOT NULL""")
def s07_model_rows(spark, d):
    """The model's rows: the panel under its names and the target as a sheet's series, along the weekdays."""
    panel = src.panel_daily(spark, d)
    out = src.model_rows(panel, _names(spark, d), weekdays(panel), src.target_daily(spark, d).withColumn("series", F.lit("sheet")))
    return out.select("series", "dt", fixed(F.col("px"), 3).alias("px"))


@query(f"""WITH {PANEL}, b AS (SELECT series, {BLANK} AS px FROM panel) SELECT series, count(px) AS n, {r('coalesce(avg(px), 0)', 4)} AS mean, {r('coalesce(stddev_samp(px), 0)', 4)} AS sd, {r('coalesce(min(px), 0)', 4)} AS low, {r('coalesce(max(px), 0)', 4)} AS high, {r('coalesce(sum(px), 0)', 2)} AS total FROM b GROUP BY series""")
def a26_safe_summary(spark, d):
    out = stats.safe_summary(_blanked(spark, d), "px")
    return out.select("series", "n", *[fixed(F.col(c), 2 if c == "total" else 4).alias(c) for c in ("mean", "sd", "low", "high", "total")])


@query(f"""WITH {PANEL}, {ZP}, s AS (SELECT dt, series, z, coalesce(100 * abs(z) / nullif(sum(abs(z)) OVER (PARTITION BY dt), 0), 0) AS share FROM zp), k AS (SELECT dt, series, {r('share')} AS share FROM s)
SELECT dt, series, share, row_number() OVER (PARTITION BY dt ORDER BY share DESC, series) AS place FROM k""")
def t05_shares_of_z(spark, d):
    rows = relations.importance(_panel_z(spark, d).select("dt", "series", F.col("z").alias("x")))
    rows = rows.withColumn("share", fixed(F.col("share"))).drop("place")
    from pyspark.sql.window import Window

    return rows.withColumn("place", F.row_number().over(Window.partitionBy("dt").orderBy(F.desc("share"), "series")))


@query(f"""WITH {TARGET}, a AS (SELECT series, dt, abs({r(z_sql('px', 20))}) AS x FROM target), s AS (SELECT list_sort(list(x)) AS b, count(*) AS n FROM a)
SELECT 'target' AS series, {r("CASE WHEN n >= 60 AND b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.9 * (n - 1), 0) AS INT) + 1] ELSE 1.5 END")} AS strong, {r("CASE WHEN n >= 60 AND b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] > 0 THEN b[CAST(round_even(0.5 * (n - 1), 0) AS INT) + 1] ELSE 0.7 END")} AS moderate FROM s""")
def w13_current_tiers(spark, d):
    rows = src.target_daily(spark, d).select("series", F.abs(fixed(w.causal_z(F.col("px"), 20))).alias("x"))
    out = stats.current_tiers(rows, "x", {"strong": (0.9, 1.5), "moderate": (0.5, 0.7)}, 60)
    return out.select("series", fixed(F.col("strong")).alias("strong"), fixed(F.col("moderate")).alias("moderate"))


@query(f"WITH {PANEL} SELECT series, dt, {r(f'avg(px) {over("UNBOUNDED PRECEDING")}', 4)} AS mean, {r(f'coalesce(var_samp(px) {over("UNBOUNDED PRECEDING")}, 0)', 2)} AS variance FROM panel")
def r02_expanding_moments(spark, d):
    mean, variance = w.expanding_moments(F.col("px"))
    return src.panel_daily(spark, d).select("series", "dt", fixed(mean, 4).alias("mean"), fixed(variance, 2).alias("variance"))


def _pull(slope: str, n: str) -> str:
    """Theta of a slope over n pairs, corrected for small samples."""
    a = f"greatest(least({slope}, 0.999), 1e-6)"
    return f"greatest(-ln(greatest(least({a} + (1 + 3 * {a}) / {n} + CASE WHEN {a} > 0.95 THEN 3 * (1 + 3 * {a}) / ({n} * {n}) ELSE 0 END, 0.999), 0)), 1e-4)"


@query(f"""WITH {PANEL}, l AS (SELECT series, dt, ln(px) AS x, lag(ln(px)) {LAG} AS b, row_number() {LAG} AS k, count(*) OVER (PARTITION BY series) AS n, least(60, count(*) OVER (PARTITION BY series) // 3) AS size FROM panel),
p AS (SELECT a.series, a.k, a.size - 1.0::DOUBLE AS m, regr_slope(b.x, b.b) AS s FROM l a JOIN l b ON a.series = b.series AND b.k BETWEEN a.k - a.size + 2 AND a.k WHERE a.k >= a.size AND a.k < a.n GROUP BY ALL),
w AS (SELECT series, k, CASE WHEN m < 19 THEN 0.05 ELSE {_pull('s', 'm')} END AS theta FROM p), t AS (SELECT series, arg_max(theta, k) AS now, stddev_pop(theta) AS spread FROM w GROUP BY series),
f AS (SELECT series, count(b)::DOUBLE AS m, regr_slope(x, b) AS s, regr_intercept(x, b) AS i, arg_max(x, dt) AS x0 FROM l GROUP BY series), o AS (SELECT *, i / (1 - exp(-{_pull('s', 'm')})) AS mu FROM f),
k AS (SELECT *, unnest(range(1, 91)) AS step FROM o JOIN t USING (series))
SELECT series, step::INT AS step, {r('mu + (x0 - mu) * exp(-now * step)', 5)} AS mean, {r('mu + (x0 - mu) * exp(-(now + spread) * step)', 5)} AS low, {r('mu + (x0 - mu) * exp(-(now - spread) * step)', 5)} AS high FROM k""")
def r34_projection(spark, d):
    """The path at the newest rolling pull; the bounds are those of pulls a spread of past ones apart."""
    rows = roots.reverting_path(roots.reversion_diagnostics(src.panel_daily(spark, d).withColumn("x", F.log("px")), "x"), 90)
    return rows.select("series", "step", *[fixed(F.col(c), 5).alias(c) for c in ("mean", "low", "high")])


@query()
def a23_unit_root_lags(spark, d):
    """Unit roots with lags by Akaike's criterion, and stationarity, with p-values."""
    return roots.reversion_diagnostics(src.panel_daily(spark, d).withColumn("x", F.log("px")), "x").select("series", "n", "adf_t", "adf_lags", "adf_p", "kpss", "kpss_lags", "kpss_p")


@query()
def d21_gated_hurst_lags(spark, d):
    """The fluctuation exponent of series whose unit root is rejected at 5 %, with lags."""
    px = src.panel_daily(spark, d).withColumn("x", F.log("px"))
    return roots.gated_hurst(stats.dfa(px, "x"), roots.reversion_diagnostics(px, "x"))


CORR = f"""{PANEL}, {TARGET}, j AS (SELECT p.series, dt, p.px, t.px AS y FROM panel p JOIN target t USING (dt)),
c AS (SELECT series, dt, round(coalesce(CASE WHEN count(px) {over('60 PRECEDING', '1 PRECEDING')} >= 60 THEN corr(px, y) {over('60 PRECEDING', '1 PRECEDING')} END, 0), 6) AS r FROM j)"""


@query(f"WITH {CORR} SELECT row_number() OVER (ORDER BY abs(r) DESC, series) AS place, series, r, {r('r * r', 5)} AS r2 FROM c WHERE dt = (SELECT max(dt) FROM c) QUALIFY place <= 4")
def t02_last_drivers(spark, d):
    rows = src.panel_daily(spark, d).join(src.target_daily(spark, d).select("dt", F.col("px").alias("y")), "dt")
    rows = rows.select("dt", "series", F.round(w.rolling_corr(F.col("px"), F.col("y"), 60), 6).alias("r"))
    from pyspark.sql.window import Window

    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("dt").orderBy(F.desc(F.abs("r")), "series"))).where("place <= 4")
    return relations.last_drivers(ranked.withColumn("r2", fixed(F.col("r") * F.col("r"), 5)))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS dt FROM orders ORDER BY 2 DESC, 1 LIMIT 300")
def t06_newest_rows(spark, d):
    return relations.newest(src.table(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("dt")), 300, "o_orderkey")


@query("SELECT n_name AS symbol FROM nation UNION SELECT r_name FROM region UNION SELECT DISTINCT p_brand FROM part")
def u01_united_symbols(spark, d):
    return src.table(spark, d, "nation").select(F.col("n_name").alias("symbol")).union(src.table(spark, d, "region").select("r_name")).union(src.table(spark, d, "part").select("p_brand")).distinct()


@query("""SELECT c_custkey, o_orderpriority FROM customer, (SELECT DISTINCT o_orderpriority FROM orders) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c_custkey AND o.o_orderpriority = p.o_orderpriority)""")
def u02_missing_symbols(spark, d):
    """Of every priority (a handful), the customers without an order of it."""
    orders = src.table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority")
    known = orders.select("o_orderpriority").distinct().agg(F.collect_set("o_orderpriority").alias("_all"))
    wanted = src.table(spark, d, "customer").join(known).select("c_custkey", F.explode("_all").alias("o_orderpriority"))
    return wanted.join(orders, ["c_custkey", "o_orderpriority"], "left_anti")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'override' WHEN n_nationkey % 2 = 0 THEN 'class' ELSE 'default' END AS mode, 'base' AS kept FROM nation")
def u06_merged_settings(spark, d):
    n = src.table(spark, d, "nation").select("n_nationkey")
    base = F.create_map(F.lit("mode"), F.lit("default"), F.lit("kept"), F.lit("base"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    one = lambda test, value: F.when(test, F.create_map(F.lit("mode"), F.lit(value))).otherwise(none)
    m = relations.merged(base, one(F.col("n_nationkey") % 2 == 0, "class"), one(F.col("n_nationkey") % 3 == 0, "override"))
    return n.select("n_nationkey", m["mode"].alias("mode"), fn.with_default(m, "kept", "none").alias("kept"))


@query(f"""WITH {PANEL}, {SPINE}, {FILLED}, z AS (SELECT series, dt, px, {r(z_sql('px', 20))} AS z FROM f)
SELECT series, dt, CASE WHEN z > 0.404 THEN 'STRONG_SELL' WHEN z > 0.279 THEN 'SELL' WHEN z < -0.404 THEN 'STRONG_BUY' WHEN z < -0.279 THEN 'BUY' ELSE 'HOLD' END AS label FROM z""")
def d15_consensus_label(spark, d):
    rows = _filled(spark, d).select("series", "dt", fixed(w.causal_z(F.col("px"), 20)).alias("z"))
    return rows.select("series", "dt", scores.consensus_label(F.col("z"), 0.279, 0.404).alias("label"))


@query(f"""WITH {TICKERS} SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'ABC' WHEN 1 THEN 'XYZ' WHEN 2 THEN 'GOLD' WHEN 3 THEN 'EURUSD' WHEN 4 THEN 'NSEI' WHEN 5 THEN 'SPX' WHEN 6 THEN 'SHEL' ELSE 'IBM' END AS symbol,
s_suppkey % 8 IN (0, 1, 4) AS indian, s_suppkey % 8 = 6 AS british FROM tk""")
def f_symbols_and_masks(spark, d):
    rows = _tickers(spark, d)
    mask = fn.one_hot(fn.exchange_of(F.col("ticker")), ["XNSE", "XLON"])
    return rows.select("s_suppkey", fn.tape_symbol(F.col("ticker"), {"GC": "GOLD", "GSPC": "SPX"}).alias("symbol"), F.get(mask, F.lit(0)).alias("indian"), F.get(mask, F.lit(1)).alias("british"))


@query("""SELECT event_id, floor(1 / (1 + exp(-greatest(least(value - 50, 30), -30))) * 1e6 + 0.501) / 1e6 AS logistic, CASE WHEN value > 0 AND value < 100 THEN true END AS inside FROM events WHERE value IS NOT NULL""")
def f_curves(spark, d):
    """The logistic curve; the normal distribution function and its quantile give back what went in."""
    rows = src.table(spark, d, "events").where("value IS NOT NULL")
    back = fn.normal_cdf(fn.probit(F.col("value") / 100))
    return rows.select("event_id", fixed(fn.logistic(F.col("value") - 50)).alias("logistic"), (F.abs(back - F.col("value") / 100) < 1e-3).alias("inside"))


@query("""SELECT p_partkey, CASE WHEN regexp_matches(p_type || ' ' || p_name, '(?i)treasury|bond|yield|gilt') THEN 'Rates' WHEN regexp_matches(p_type || ' ' || p_name, '(?i)gold|silver|copper|platinum|steel|brass|tin|nickel') THEN 'Metals'
WHEN regexp_matches(p_type || ' ' || p_name, '(?i)oil|gas|brent|fuel') THEN 'Energy' WHEN regexp_matches(p_type || ' ' || p_name, '(?i)wheat|corn|soy|sugar|coffee') THEN 'Softs' WHEN regexp_matches(p_type || ' ' || p_name, '(?i)usd|eur|jpy|fx') THEN 'FX' ELSE 'Other' END AS class FROM part""")
def j13_asset_classes(spark, d):
    return src.table(spark, d, "part").select("p_partkey", fn.asset_class(F.concat("p_type", F.lit(" "), "p_name")).alias("class"))


PART_NAME = "replace(p_type || ' ' || p_name, '#', '/')"


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN {PART_NAME} IN ({', '.join(repr(t) for t in listed.split())}) THEN '{label}'" for label, listed in names.TICKERS.items())
       + " ".join(f" WHEN regexp_matches({PART_NAME}, '(?i){pattern}') THEN '{label}'" for pattern, label in names.PATTERNS)
       + f" WHEN {PART_NAME} LIKE '%=X' THEN 'Currency' WHEN {PART_NAME} LIKE '%=F' THEN 'Commodity Broad'" + "".join(f" WHEN starts_with({PART_NAME}, '{head}') THEN 'Equity'" for head in names.EQUITY) + " ELSE 'Other' END AS block FROM part")
def j13_asset_blocks(spark, d):
    """The asset class of every part's name by tickers, patterns and shape."""
    name = F.replace(F.concat("p_type", F.lit(" "), "p_name"), F.lit("#"), F.lit("/"))
    return src.table(spark, d, "part").select("p_partkey", names.asset_block(name).alias("block"))


TAILS = [*names.SUFFIXES, *names.CRYPTO, "=X", "=F", ".SHEET", ".NCDEX", "", "-B", "/X"]
TAIL_SQL = f"list_extract({TAILS}, CAST(1 + s_suppkey % {len(TAILS)} AS INTEGER))"


@query(f"""WITH t AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN list_extract({[*names.INDICES, '^NSEBANK', '^OTHER']}, CAST(1 + s_suppkey % {len(names.INDICES) + 2} AS INTEGER)) ELSE 'S' || s_suppkey || {TAIL_SQL} END AS ticker FROM supplier)
SELECT s_suppkey, ticker, CASE WHEN ticker LIKE '%=X' THEN 'FX' WHEN ticker LIKE '%=F' THEN 'CMES' """ + " ".join(f"WHEN ends_with(ticker, '{c}') THEN 'CRYPTO'" for c in names.CRYPTO) + " WHEN ends_with(ticker, '.SHEET') OR ends_with(ticker, '.NCDEX') THEN 'XBOM' "
       + " ".join(f"WHEN ends_with(ticker, '{end}') THEN '{place}'" for end, place in names.SUFFIXES.items()) + " " + " ".join(f"WHEN ticker = '{name}' THEN '{place}'" for name, place in names.INDICES.items())
       + " ".join(f" WHEN starts_with(ticker, '{head}') THEN 'XBOM'" for head in names.INDIAN) + " WHEN regexp_full_match(ticker, '[A-Z0-9.-]+') THEN 'XNYS' ELSE '' END AS venue FROM t")
def f_venues(spark, d):
    """The venue of a ticker for every supplier, of all kinds of ends and indices."""
    listed = [*names.INDICES, "^NSEBANK", "^OTHER"]
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("s_suppkey") % len(values)).cast("int"))
    ticker = F.when(F.col("s_suppkey") % 7 == 0, pick(listed)).otherwise(F.concat(F.lit("S"), F.col("s_suppkey").cast("string"), pick(TAILS)))
    return src.table(spark, d, "supplier").select("s_suppkey", ticker.alias("ticker")).withColumn("venue", names.venue(F.col("ticker")))


#: Brands trade on exchanges by their number.
VENUES = ("XNYS", "XLON", "XETR", "XPAR", "CMES", "CRYPTO", "WEEK")
VENUE_SQL = f"list_extract({list(VENUES)}, 1 + CAST(regexp_extract(series, '[0-9]+') AS INTEGER) % {len(VENUES)})"
YEARS = (1995, 2001)
CALENDAR = f"""hol AS ({calendars.holidays_sql(*YEARS)}), span AS (SELECT CAST(unnest(generate_series(min(dt), max(dt), INTERVAL 1 DAY)) AS DATE) AS dt FROM panel),
ven AS (SELECT DISTINCT series, {VENUE_SQL} AS exchange FROM panel),
cal AS (SELECT e.exchange, s.dt, e.exchange = 'CRYPTO' OR (isodow(s.dt) <= 5 AND coalesce(half, true)) AS open, coalesce(half, false) AND isodow(s.dt) <= 5 AS half FROM (SELECT DISTINCT exchange FROM ven) e CROSS JOIN span s LEFT JOIN hol h ON h.exchange = e.exchange AND h.dt = s.dt)"""


def _venues(spark, d):
    number = F.regexp_extract("series", "[0-9]+", 0).cast("int")
    return src.panel_daily(spark, d).select("series", "dt", "px", F.get(F.array(*map(F.lit, VENUES)), number % len(VENUES)).alias("exchange"))


def _calendar(spark, d):
    rows = _venues(spark, d)
    span = rows.agg(F.min("dt").alias("a"), F.max("dt").alias("b")).select(F.explode(F.sequence("a", "b")).alias("dt"))
    return calendars.session_days(rows, span, calendars.holidays(spark, *YEARS))


@query(f"""WITH {PANEL}, {CALENDAR} SELECT exchange, year(dt)::INT AS year, count_if(open)::BIGINT AS n_sessions, count_if(half)::BIGINT AS n_half, sum(CASE WHEN open THEN dayofyear(dt) ELSE 0 END)::BIGINT AS days FROM cal GROUP BY 1, 2""")
def j12_sessions_by_rule(spark, d):
    """Sessions and half days of each exchange and year over the panel's whole span."""
    rows = _calendar(spark, d).groupBy("exchange", F.year("dt").alias("year"))
    return rows.agg(F.count_if("open").alias("n_sessions"), F.count_if("half").alias("n_half"), F.sum(F.when(F.col("open"), F.dayofyear("dt")).otherwise(0)).cast("long").alias("days"))


@query(f"""WITH {PANEL}, {CALENDAR} SELECT p.series, p.dt FROM panel p JOIN ven USING (series) JOIN cal c ON c.exchange = ven.exchange AND c.dt = p.dt WHERE open""")
def p14_rows_on_sessions(spark, d):
    """The panel's rows on the sessions of their own exchange."""
    return calendars.on_sessions(_venues(spark, d), _calendar(spark, d)).select("series", "dt")


@query(f"""WITH {PANEL}, {CALENDAR}, l AS (SELECT series, max(dt) AS newest FROM panel GROUP BY series)
SELECT series, exchange, newest, (SELECT count(*) FROM cal c WHERE c.exchange = ven.exchange AND c.open AND c.dt > l.newest) AS behind FROM l JOIN ven USING (series)""")
def d27_sessions_behind(spark, d):
    """How many sessions of its own exchange came after each series' newest row."""
    newest = _venues(spark, d).groupBy("series", "exchange").agg(F.max("dt").alias("newest"))
    return calendars.behind(newest, _calendar(spark, d))


@query(f"""WITH RECURSIVE ev AS (SELECT event_type AS series, ts AS dt, max(value) AS x FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() {LAG} AS k, count(x) {over('UNBOUNDED PRECEDING')} AS n FROM ev),
e(series, k, dt, n, level, variance) AS (SELECT series, k, dt, n, coalesce(x, 0), 100.0::DOUBLE FROM k WHERE k = 1 UNION ALL SELECT z.series, z.k, z.dt, z.n, e.level * 0.97 + 0.056 * coalesce(z.x, 0), greatest(e.variance * 0.97 + 3 + least(abs(0.056 * coalesce(z.x, 0)) / 2, 50), 1e-6) FROM k z JOIN e ON z.series = e.series AND z.k = e.k + 1)
SELECT series, dt, {r('level', 5)} AS level, {r('variance', 5)} AS variance, n, n >= 100 AS admitted FROM e WHERE dt <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def st_drift_of_events(spark, d):
    """The drift filter and print floor over the events as a stream, all rows that the watermark has passed."""
    events = src.table(spark, d, "events").schema
    stream = spark.readStream.schema(events).option("pathGlobFilter", "events.parquet").parquet(d).select(F.col("event_type").alias("series"), F.col("ts").cast("timestamp").alias("dt"), F.col("value").alias("x"))
    out = typed.run_once(typed.absorbed(stream, ["x"], segments.drift_fold(), "1 hour", floor=100), staging.new_folder(spark, "stream"))
    return out.select("series", F.col("dt").cast("timestamp_ntz").alias("dt"), fixed(F.col("level"), 5).alias("level"), fixed(F.col("variance"), 5).alias("variance"), "n", "admitted")
