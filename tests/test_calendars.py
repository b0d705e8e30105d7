"""Sessions by rule beside dates that are known."""

import datetime as dt

from tidemark.operators import calendars

D = dt.date


def closed(spark, exchange, first, last):
    rows = calendars.holidays(spark, first, last).where(f"exchange = '{exchange}'").collect()
    return {r.dt for r in rows if not r.half}, {r.dt for r in rows if r.half}


def test_known_holidays(spark):
    whole, half = closed(spark, "XNYS", 2021, 2024)
    assert {d for d in whole if d.year == 2024} == {D(2024, 1, 1), D(2024, 1, 15), D(2024, 2, 19), D(2024, 3, 29), D(2024, 5, 27), D(2024, 6, 19), D(2024, 7, 4), D(2024, 9, 2), D(2024, 11, 28), D(2024, 12, 25)}
    assert {d for d in whole if d.year == 2021 and d.month in (1, 6, 7, 12)} == {D(2021, 1, 1), D(2021, 1, 18), D(2021, 7, 5), D(2021, 12, 24)}
    assert {D(2022, 6, 20), D(2022, 12, 26), D(2023, 1, 2)} <= whole and D(2022, 1, 1) in whole  # a Saturday: no weekday is lost
    assert {D(2024, 7, 3), D(2024, 11, 29), D(2024, 12, 24)} <= half and D(2021, 12, 24) not in half
    london, _ = closed(spark, "XLON", 2021, 2022)
    assert {D(2021, 4, 2), D(2021, 4, 5), D(2021, 5, 3), D(2021, 5, 31), D(2021, 8, 30), D(2021, 12, 27), D(2021, 12, 28), D(2022, 1, 3), D(2022, 12, 26), D(2022, 12, 27)} <= london
    assert closed(spark, "XETR", 2023, 2023)[0] == {D(2023, 1, 1), D(2023, 4, 7), D(2023, 4, 10), D(2023, 5, 1), D(2023, 12, 24), D(2023, 12, 25), D(2023, 12, 26), D(2023, 12, 31)}
    assert closed(spark, "CMES", 2024, 2024)[0] == {D(2024, 1, 1), D(2024, 3, 29), D(2024, 12, 25)}


def test_easter(spark):
    known = {1981: D(1981, 4, 19), 1954: D(1954, 4, 18), 1995: D(1995, 4, 16), 2000: D(2000, 4, 23), 2008: D(2008, 3, 23), 2011: D(2011, 4, 24), 2024: D(2024, 3, 31), 2038: D(2038, 4, 25), 2049: D(2049, 4, 18)}
    rows = spark.createDataFrame([(y,) for y in known], "y int").selectExpr("y", f"{calendars.easter(calendars.Dialect())} AS dt").collect()
    assert {r.y: r.dt for r in rows} == known


def test_sessions_and_places(spark):
    days = spark.sql("SELECT explode(sequence(DATE'2024-03-25', DATE'2024-04-07')) AS dt")
    exchanges = spark.createDataFrame([("XNYS",), ("XLON",), ("CRYPTO",), ("WEEK",)], "exchange string")
    calendar = calendars.session_days(exchanges, days, calendars.holidays(spark, 2024, 2024)).cache()
    open_ = {e: sorted(r.dt for r in calendar.where("open").collect() if r.exchange == e) for e in ("XNYS", "XLON", "CRYPTO", "WEEK")}
    assert [len(open_[e]) for e in ("XNYS", "XLON", "CRYPTO", "WEEK")] == [9, 8, 14, 10]
    assert D(2024, 3, 29) not in open_["XNYS"] and D(2024, 4, 1) in open_["XNYS"] and D(2024, 4, 1) not in open_["XLON"]
    newest = spark.createDataFrame([("a", "XNYS", D(2024, 3, 28)), ("b", "XLON", D(2024, 3, 28)), ("c", "XNYS", D(2024, 4, 7)), ("d", "XLON", D(2024, 3, 30))], "series string, exchange string, newest date")
    assert {r.series: r.behind for r in calendars.behind(newest, calendar).collect()} == {"a": 5, "b": 4, "c": 0, "d": 4}
    assert {r.series: r.behind for r in calendars.behind(newest, calendar, "2024-04-02").collect()} == {"a": 2, "b": 1, "c": 0, "d": 1}
    rows = spark.createDataFrame([("a", "XLON", D(2024, 3, 28)), ("a", "XLON", D(2024, 3, 29)), ("b", "XLON", D(2024, 3, 30))], "series string, exchange string, dt date")
    assert sorted((r.series, r.dt.day) for r in calendars.on_sessions(rows, calendar).collect()) == [("a", 28), ("b", 30)]
