"""Exchange sessions by rule: holidays worked out for any year from Easter, n-th weekdays and fixed days with their substitutes.

A rule is one SQL expression over a year `y` and its `easter`, so a table of years gives every exchange's holidays without a list of dates.
Exchanges whose holidays follow the moon take theirs from a given table; currencies trade on weekdays, crypto on all days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MON, TUE, WED, THU, FRI, SAT, SUN = range(7)


class Dialect:
    """The three date functions the rules need."""

    def day(self, month: int, day: int) -> str:
        return f"make_date(y, {month}, {day})"

    def weekday(self, date: str) -> str:
        return f"weekday({date})"

    def plus(self, date: str, days: str) -> str:
        return f"date_add({date}, CAST({days} AS INT))"


class Duck(Dialect):
    def weekday(self, date: str) -> str:
        return f"(isodow({date}) - 1)"

    def plus(self, date: str, days: str) -> str:
        return f"({date} + CAST({days} AS INTEGER))"


def easter(sql: Dialect) -> str:
    """Easter Sunday of the Gregorian year y."""
    golden, century = "(y % 19)", "CAST(floor(y / 100.0) AS INT)"
    quarter = f"CAST(floor({century} / 4.0) AS INT)"
    third = f"CAST(floor((8 * {century} + 13) / 25.0) AS INT)"
    raw = f"((19 * {golden} + {century} - {quarter} - {third} + 15) % 30)"
    moon = f"({raw} - CASE WHEN {raw} = 29 OR ({raw} = 28 AND {golden} > 10) THEN 1 ELSE 0 END)"
    full = sql.plus(sql.day(3, 21), moon)
    return sql.plus(full, f"7 - ({sql.weekday(full)} + 1) % 7")


def after_easter(days: int):
    return lambda sql: sql.plus("easter", str(days))


def nth(month: int, weekday: int, n: int):
    """The n-th such weekday of a month; the last for n = -1."""
    if n < 0:
        last = lambda sql: sql.plus(sql.day(month + 1, 1), "-1") if month < 12 else sql.day(12, 31)
        return lambda sql: sql.plus(last(sql), f"-(({sql.weekday(last(sql))} - {weekday} + 7) % 7)")
    first = lambda sql: sql.day(month, 1)
    return lambda sql: sql.plus(first(sql), f"({weekday} - {sql.weekday(first(sql))} + 7) % 7 + {7 * (n - 1)}")


def fixed_day(month: int, day: int, saturday: int = 0, sunday: int = 0):
    """A day of the year; moved by so many days where it falls on a Saturday or a Sunday (not moved, it is no session anyway)."""
    at = lambda sql: sql.day(month, day)
    return lambda sql: sql.plus(at(sql), f"CASE {sql.weekday(at(sql))} WHEN {SAT} THEN {saturday} WHEN {SUN} THEN {sunday} ELSE 0 END") if saturday or sunday else at(sql)


GOOD_FRIDAY, EASTER_MONDAY, NEW_YEAR, MAY_DAY, CHRISTMAS, SECOND_DAY = after_easter(-2), after_easter(1), fixed_day(1, 1), fixed_day(5, 1), fixed_day(12, 25), fixed_day(12, 26)
#: Exchange, rule, first year it holds, whether only the afternoon is closed.
RULES = (
    ("XNYS", fixed_day(1, 1, 0, 1), 0, False), ("XNYS", nth(1, MON, 3), 1998, False), ("XNYS", nth(2, MON, 3), 0, False), ("XNYS", GOOD_FRIDAY, 0, False),
    ("XNYS", nth(5, MON, -1), 0, False), ("XNYS", fixed_day(6, 19, -1, 1), 2022, False), ("XNYS", fixed_day(7, 4, -1, 1), 0, False), ("XNYS", nth(9, MON, 1), 0, False),
    ("XNYS", nth(11, THU, 4), 0, False), ("XNYS", fixed_day(12, 25, -1, 1), 0, False), ("XNYS", lambda sql: sql.plus(nth(11, THU, 4)(sql), "1"), 1993, True), ("XNYS", fixed_day(12, 24), 1999, True), ("XNYS", fixed_day(7, 3), 2000, True),
    ("CMES", NEW_YEAR, 0, False), ("CMES", GOOD_FRIDAY, 0, False), ("CMES", CHRISTMAS, 0, False),
    ("XLON", fixed_day(1, 1, 2, 1), 0, False), ("XLON", GOOD_FRIDAY, 0, False), ("XLON", EASTER_MONDAY, 0, False), ("XLON", nth(5, MON, 1), 0, False), ("XLON", nth(5, MON, -1), 0, False),
    ("XLON", nth(8, MON, -1), 0, False), ("XLON", fixed_day(12, 25, 2, 2), 0, False), ("XLON", fixed_day(12, 26, 2, 2), 0, False), ("XLON", fixed_day(12, 24), 0, True), ("XLON", fixed_day(12, 31), 0, True),
    ("XETR", NEW_YEAR, 0, False), ("XETR", GOOD_FRIDAY, 0, False), ("XETR", EASTER_MONDAY, 0, False), ("XETR", MAY_DAY, 0, False), ("XETR", fixed_day(12, 24), 0, False), ("XETR", CHRISTMAS, 0, False), ("XETR", SECOND_DAY, 0, False), ("XETR", fixed_day(12, 31), 0, False),
    ("XPAR", NEW_YEAR, 0, False), ("XPAR", GOOD_FRIDAY, 0, False), ("XPAR", EASTER_MONDAY, 0, False), ("XPAR", MAY_DAY, 0, False), ("XPAR", CHRISTMAS, 0, False), ("XPAR", SECOND_DAY, 0, False), ("XPAR", fixed_day(12, 24), 0, True), ("XPAR", fixed_day(12, 31), 0, True),
)
EVERY_DAY = "CRYPTO"


def holidays(spark: SparkSession, first: int, last: int) -> DataFrame:
    """(exchange, dt, half) of the years first to last."""
    each = [f"named_struct('exchange', '{exchange}', 'dt', CASE WHEN y >= {since} THEN {rule(Dialect())} END, 'half', {str(half).lower()})" for exchange, rule, since, half in RULES]
    years = spark.range(first, last + 1, 1, 1).select(F.col("id").cast("int").alias("y")).withColumn("easter", F.expr(easter(Dialect())))
    return years.select(F.expr(f"inline(array({', '.join(each)}))")).where("dt IS NOT NULL").groupBy("exchange", "dt").agg(F.min("half").alias("half"))


def holidays_sql(first: int, last: int) -> str:
    """The same rows, for DuckDB."""
    each = " UNION ALL ".join(f"SELECT '{exchange}' AS exchange, {rule(Duck())} AS dt, {str(half).lower()} AS half FROM years WHERE y >= {since}" for exchange, rule, since, half in RULES)
    return f"SELECT exchange, CAST(dt AS DATE) AS dt, bool_and(half) AS half FROM (WITH each_year AS (SELECT CAST(unnest(range({first}, {last + 1})) AS INTEGER) AS y), years AS (SELECT y, {easter(Duck())} AS easter FROM each_year) {each}) GROUP BY 1, 2"


def session_days(exchanges: DataFrame, days: DataFrame, closed: DataFrame) -> DataFrame:
    """(exchange, dt, open, half, place): every day of days (dt) for every exchange of exchanges (exchange).

    open: a weekday that is no whole holiday of closed (exchange, dt, half); any day for crypto. place counts the sessions up to
    the day, so that a difference of places is a number of sessions.
    """
    rows = exchanges.select("exchange").distinct().join(days.select("dt").distinct()).join(closed, ["exchange", "dt"], "left")  # exchanges are few, days a spine
    weekday = F.weekday("dt") < 5
    half = F.coalesce(F.col("half"), F.lit(False)) & weekday
    open_ = (F.col("exchange") == EVERY_DAY) | (weekday & (F.col("half").isNull() | F.col("half")))
    rows = rows.select("exchange", "dt", open_.alias("open"), half.alias("half"))
    place: Column = F.count_if("open").over(Window.partitionBy("exchange").orderBy("dt"))
    return rows.withColumn("place", place)


def behind(newest: DataFrame, calendar: DataFrame, today: str | None = None) -> DataFrame:
    """newest (series, exchange, newest) with behind, the sessions after newest up to today (the calendar's end, if not given)."""
    until = calendar if today is None else calendar.where(F.col("dt") <= F.to_date(F.lit(today)))
    ends = until.groupBy("exchange").agg(F.max("place").alias("_end"))
    own = calendar.select("exchange", F.col("dt").alias("newest"), "place")
    out = newest.join(own, ["exchange", "newest"], "left").join(ends, "exchange", "left")
    return out.select(*newest.columns, F.greatest(F.col("_end") - F.col("place"), F.lit(0)).alias("behind"))


def on_sessions(df: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of df (series, exchange, dt, ...) on their exchange's sessions; a series that would lose every row keeps all."""
    flagged = df.join(calendar.select("exchange", "dt", F.col("open").alias("_open")), ["exchange", "dt"], "left")
    some = F.max(F.coalesce("_open", F.lit(False))).over(Window.partitionBy("series"))
    return flagged.withColumn("_some", some).where("_open OR NOT _some").select(*df.columns)
