"""Sessions, clock changes and gap filling by calendar; averages over values of any size."""

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from barloom.operators import calendar as cal
from barloom.operators import series
from barloom.plans import gaps, ingest
from barloom.schemas import SessionSpec
from tests.helpers import at, bars, ramp, rows_of

FIVE = SessionSpec()


def day_table(spark, *days):
    return spark.createDataFrame([(date.fromisoformat(d),) for d in days], "day date")


def session_rows(day, start, n, ticker="A", without=()):
    first = at(f"{day} {start}")
    return [(ticker, first + timedelta(minutes=5 * i), i, i + 1, i - 1, i + 0.5, 10 + i) for i in range(n) if i not in without]


def test_sessions_follow_the_clocks(spark):
    days = cal.days_between(spark, "2024-03-07", "2024-03-13")
    got = rows_of(cal.session_calendar(days, closed=day_table(spark, "2024-03-13")), "day", "opens", "closes")
    assert [str(r[0])[-2:] for r in got] == ["07", "08", "11", "12"]
    assert [(str(r[1])[11:16], str(r[2])[11:16]) for r in got] == [("14:30", "21:00")] * 2 + [("13:30", "20:00")] * 2


def test_early_close_and_odd_days(spark):
    days = day_table(spark, "2024-07-03", "2024-07-03").union(spark.createDataFrame([(None,)], "day date"))
    short = spark.createDataFrame([(date(2024, 7, 3), "13:00")], "day date, closes string")
    calendar = cal.session_calendar(days, short=short)
    assert rows_of(cal.expected_bars(calendar, "5 minutes"), "day", "expected") == [(date(2024, 7, 3), 42)]
    assert rows_of(cal.expected_bars(calendar, "1 hour"), "expected") == [(4,)]


@pytest.mark.parametrize(("day", "start"), [("2024-03-08", "14:30:00"), ("2024-03-11", "13:30:00")])
def test_one_missing_of_78_gives_one_filler(spark, day, start):
    """On both sides of the clock change."""
    calendar = cal.session_calendar(cal.days_between(spark, "2024-03-04", "2024-03-15"))
    before_open = ("A", at(f"{day} 12:00:00"), 1, 1, 1, 1, 1)
    source = bars(spark, [*session_rows(day, start, 78, without=(40,)), before_open])
    filled = gaps.fill_absent(source, FIVE, calendar=calendar)
    assert filled.bars.count() == 79
    made = filled.bars.where("has_gaps").collect()
    assert [(r["date"], r["close"]) for r in made] == [(at(f"{day} {start}") + timedelta(minutes=200), 39.5)]
    assert filled.illiquid.count() == 0
    again = gaps.fill_absent(filled.bars.drop("has_gaps"), FIVE, calendar=calendar)
    assert again.bars.where("has_gaps").count() == 0


def test_full_short_day_needs_nothing_and_closed_days_are_left(spark):
    short = spark.createDataFrame([(date(2024, 7, 3), "13:00")], "day date, closes string")
    calendar = cal.session_calendar(cal.days_between(spark, "2024-07-01", "2024-07-05"), closed=day_table(spark, "2024-07-04"), short=short)
    rows = session_rows("2024-07-03", "13:30:00", 42) + session_rows("2024-07-04", "13:30:00", 3)
    rows += session_rows("2024-07-05", "13:30:00", 20, "B", without=(0,))
    filled = gaps.fill_absent(bars(spark, rows), FIVE, calendar=calendar)
    assert rows_of(filled.bars.where("has_gaps").groupBy("ticker").count(), "ticker", "count") == [("B", 59)]
    assert rows_of(filled.illiquid, "ticker", "gaps") == [("B", 59)]
    known = spark.createDataFrame([("B", date(2024, 7, 5))], "ticker string, day date")
    assert gaps.fill_absent(bars(spark, rows), FIVE, known, calendar=calendar).bars.count() == len(rows)


def test_known_holidays_stay_and_new_ones_join(spark):
    rows = session_rows("2024-07-03", "13:30:00", 3) + session_rows("2024-07-02", "13:30:00", 4)
    known = spark.createDataFrame([("A", date(2024, 7, 1)), ("A", date(2024, 7, 3))], "ticker string, day date")
    source = bars(spark, rows)
    done = ingest.ingest_bars(source.where(F.lit(False)), ingest.as_raw(source, "5 mins"), "5 mins", bars_per_day=4, holidays=known)
    assert rows_of(done.holidays, "day") == [(date(2024, 7, 1),), (date(2024, 7, 3),)]
    assert done.bars.count() == 4


@pytest.mark.parametrize("chunk", [5, 64])
def test_exponential_average_keeps_early_values_of_any_size(spark, chunk):
    df = ramp(spark, 300).withColumn("close", F.when(F.col("date") < at("2000-01-04 00:00:00"), 1e200 * F.col("close")).otherwise(F.col("close")))
    got = {r["seq"]: r["x"] for r in series.exponential_averages(df, "close", {"x": 6}, chunk_rows=chunk).collect()}
    keep, top, bottom = 1 - 2 / 7, 0.0, 0.0
    for i, r in enumerate(df.orderBy("date").collect()):
        top, bottom = top * keep + r["close"], bottom * keep + 1
        assert got[i] == pytest.approx(top / bottom, rel=1e-11), i
