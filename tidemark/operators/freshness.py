"""Which rows and series to trust: sessions, stale tails, absent series, recent rows, last readings and even samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.align import ordered


def in_sessions(df: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows of df (series, dt, ...) on the dates of sessions (dt); a series that would lose every row keeps all."""
    flagged = df.join(F.broadcast(sessions.select("dt").distinct().withColumn("_open", F.lit(True))), "dt", "left")
    some = F.max(F.coalesce("_open", F.lit(False))).over(Window.partitionBy("series"))
    return flagged.withColumn("_some", some).where("_open OR NOT _some").select(*df.columns)


def valid_rows(df: DataFrame, valid: str) -> DataFrame:
    """Rows of df (series, ...) where valid is true; a series without one keeps all."""
    some = F.max(F.coalesce(valid, F.lit(False))).over(Window.partitionBy("series"))
    return df.withColumn("_some", some).where(F.col(valid) | ~F.col("_some")).drop("_some")


def absent(df: DataFrame) -> DataFrame:
    """(series, dt) admitted but not printed on the newest date of df (series, dt, admitted, printed)."""
    newest = df.agg(F.max("dt").alias("dt"))
    return df.join(F.broadcast(newest), "dt").where("admitted AND NOT printed").select("series", "dt")


def recent_months(df: DataFrame, months: int) -> DataFrame:
    """Rows of df (dt, ...) not older than so many calendar months before its newest date."""
    newest = df.agg(F.add_months(F.max("dt"), -months).alias("_from"))
    return df.join(F.broadcast(newest), F.col("dt") >= F.col("_from")).drop("_from")


def matching(df: DataFrame, day: str, days: int, text: str) -> DataFrame:
    """Rows of the last so many days before the newest day, with text in any column's value, whatever its case."""
    newest = df.agg(F.date_sub(F.max(F.to_date(day)), days).alias("_from"))
    cells = F.concat_ws("\n", *[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.where(F.contains(cells, F.lit(text.lower()))).join(F.broadcast(newest), F.to_date(day) >= F.col("_from")).drop("_from")


def stale_since(df: DataFrame) -> DataFrame:
    """(series, updated, newest, stale) of filled series: the last date whose value differs from the one before it."""
    changed = ~F.col("px").eqNullSafe(F.lag("px").over(ordered()))
    out = df.withColumn("_day", F.when(changed, F.col("dt"))).groupBy("series").agg(F.max("_day").alias("updated"), F.max("dt").alias("newest"))
    return out.withColumn("stale", F.coalesce(F.col("updated") < F.col("newest"), F.lit(True)))


def fresh_share(df: DataFrame, least: int = 3) -> DataFrame:
    """(n_judged, share): of the series with a value in both of their last two rows, those whose value changed.

    share is null where fewer than least series can be judged.
    """
    back = Window.partitionBy("series").orderBy(F.desc("dt"))
    two = df.withColumn("_k", F.row_number().over(back)).where("_k <= 2").groupBy("series")
    two = two.agg(F.max(F.when(F.col("_k") == 1, F.col("px"))).alias("now"), F.max(F.when(F.col("_k") == 2, F.col("px"))).alias("before"))
    two = two.where("now IS NOT NULL AND before IS NOT NULL").agg(F.count("*").alias("n_judged"), F.avg((F.col("now") != F.col("before")).cast("double")).alias("share"))
    return two.withColumn("share", F.when(F.col("n_judged") >= least, F.col("share")))


def last_settled(df: DataFrame, value: str) -> DataFrame:
    """(series, dt, value) of each series' newest row whose value is neither null nor NaN."""
    row = F.max_by(F.struct("dt", value), "dt")
    return df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy("series").agg(row.alias("_row")).select("series", "_row.*")


def strided(df: DataFrame, by: str, order: str, cap: int) -> DataFrame:
    """cap rows of each group of df, evenly spread by order (all of a smaller group): a sampling operator."""
    group = Window.partitionBy(by)
    rows = df.withColumn("_at", F.row_number().over(group.orderBy(order)) - 1).withColumn("_n", F.count("*").over(group))
    rows = rows.withColumn("_i", F.expr(f"(_at * {cap} + _n - 1) div _n"))
    return rows.where(F.expr(f"_n <= {cap} OR (_i < {cap} AND (_i * _n) div {cap} = _at)")).drop("_at", "_n", "_i")


def condition(osc: Column, low: float, high: float) -> Column:
    return F.when(osc < low, "Oversold").when(osc > high, "Overbought").otherwise("Neutral")


def divergence(osc: Column, price: Column, low: float, high: float) -> tuple[Column, Column]:
    """(bullish, bearish): oscillator and price moved apart since the row before, inside the oscillator's extreme zone."""
    before, paid = F.lag(osc).over(ordered()), F.lag(price).over(ordered())
    bullish = (osc > before) & (price < paid) & (osc < low)
    bearish = (osc < before) & (price > paid) & (osc > high)
    return F.coalesce(bullish, F.lit(False)), F.coalesce(bearish, F.lit(False))


def pivot_divergence(df: DataFrame, residual: str, order: int = 5) -> DataFrame:
    """df (series, dt, px, top, bottom, residual) with bullish and bearish: successive pivots of price and residual that
    move apart while the residual is half an expanding deviation out. A pivot counts once order rows have confirmed it.
    """
    rows = ordered().rowsBetween(-2 * order, 0)
    past = ordered().rowsBetween(Window.unboundedPreceding, 0)
    spread = F.when(F.count(residual).over(past) >= 20, F.stddev_samp(residual).over(past))
    out = df.withColumn("_s", F.coalesce(spread, F.lit(0.0))).withColumn("_ok", F.count(residual).over(rows) == 2 * order + 1)
    at = {name: F.lag(column, order).over(ordered()) for name, column in (("_p", "px"), ("_r", residual), ("_d", "_s"))}
    out = out.withColumns(at)
    before = ordered().rowsBetween(Window.unboundedPreceding, -1)
    for kind in ("bottom", "top"):
        pivot = F.when(F.col("_ok") & F.col(kind), F.struct("_p", "_r"))
        out = out.withColumn(f"_{kind}", F.last(pivot, ignorenulls=True).over(before))
    bullish = F.expr("_ok AND bottom AND _p < _bottom._p AND _r > _bottom._r AND _r < -0.5D * _d")
    bearish = F.expr("_ok AND top AND _p > _top._p AND _r < _top._r AND _r > 0.5D * _d")
    return out.select(*df.columns, F.coalesce(bullish, F.lit(False)).alias("bullish"), F.coalesce(bearish, F.lit(False)).alias("bearish"))


def mean_breaks(df: DataFrame, most: int = 3, trim: float = 0.15) -> DataFrame:
    """(series, place): up to most rows of each series where its trailing mean moved most, apart by its window.

    A series is one array, as long as its days; each pick is one pass over its moves, but for those around earlier picks.
    """
    rows = df.where("px IS NOT NULL").groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("dt", "px"))), lambda x: x["px"]).alias("x"))
    rows = rows.withColumn("n", F.size("x")).withColumn("edge", F.floor(F.col("n") * F.lit(trim)).cast("int"))
    rows = rows.withColumn("window", F.greatest("edge", F.lit(5))).where("n >= 3")
    first = F.aggregate(F.slice("x", F.lit(1), F.col("window")), F.lit(0.0), lambda a, b: a + b)

    def move(k):
        later = F.abs(F.get("x", k + 1) - F.get("x", k + 1 - F.col("window")))
        inside = (k >= F.col("edge")) & (k < F.col("n") - 1 - F.col("edge"))
        size = F.when(k >= F.col("window") - 1, later).when(k == F.col("window") - 2, F.abs(first)).otherwise(0.0) / F.col("window")
        return F.struct(F.when(inside, size).otherwise(0.0).alias("size"), (-k).alias("back"))

    rows = rows.withColumn("moves", F.transform(F.sequence(F.lit(0), F.col("n") - 2), move))

    def pick(places, _):
        # One pass over the moves: those within the window of a picked place count for none.
        far = F.filter("moves", lambda m: (m["size"] > 0) & ~F.exists(places, lambda p: (-m["back"] >= p - 1 - F.col("window")) & (-m["back"] < p - 1 + F.col("window"))))
        peak = F.array_max(far)
        return F.concat(places, F.when(peak["size"].isNotNull(), F.array(1 - peak["back"])).otherwise(F.array().cast("array<int>")))

    places = F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array().cast("array<int>"), pick)
    return rows.select("series", F.explode(places).alias("place"))


def notices(df: DataFrame, sessions: DataFrame, stale: int = 10) -> DataFrame:
    """(series, newest, behind, notice): how many sessions (dt) came after each series' newest row."""
    newest = df.groupBy("series").agg(F.max("dt").alias("newest"))
    dates = sessions.agg(F.array_sort(F.collect_set("dt")).alias("_all"))  # one row, the days of a spine
    out = newest.join(dates).withColumn("behind", F.size(F.filter("_all", lambda x: x > F.col("newest"))).cast("long")).drop("_all")
    notice = F.when(F.col("behind") == 0, "current").when(F.col("behind") == 1, "one session behind").when(F.col("behind") <= stale, "behind").otherwise("stale")
    return out.withColumn("notice", notice)


def provisional(df: DataFrame, today: str) -> DataFrame:
    """df (series, dt, ...) with provisional: a series' newest row, where it isn't older than today, may still change."""
    newest = F.max("dt").over(Window.partitionBy("series"))
    return df.withColumn("provisional", (F.col("dt") == newest) & (F.col("dt") >= F.to_date(F.lit(today))))
