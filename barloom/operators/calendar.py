"""Exchange sessions as data: when each day opens and closes, in the clock of the bars.

A calendar has one row per trading day. Times of bars are UTC; open and close are wall-clock times of the
exchange, so a session moves by an hour when its clocks change, and keeps its number of bars. A day with an early
close has fewer bars, and a closed day none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import scalars as sf

BY_DAY = ("ticker", "day")
SATURDAY, SUNDAY = 7, 1


@dataclass(frozen=True)
class Session:
    """Regular hours of an exchange, by its own clock."""

    zone: str = "America/New_York"
    opens: str = "09:30"
    closes: str = "16:00"


def exchange_day(date: Column, session: Session = Session()) -> Column:
    return F.to_date(sf.local_time(date, session.zone))


def _utc(day: Column, clock: Column, zone: str) -> Column:
    wall = F.to_timestamp_ntz(F.concat_ws(" ", day.cast("string"), clock), F.lit("yyyy-MM-dd HH:mm"))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def session_calendar(
    days: DataFrame, session: Session = Session(), closed: DataFrame | None = None, short: DataFrame | None = None
) -> DataFrame:
    """`day, opens, closes` of the trading days among `days` (column day).

    Week-ends and the days of `closed` (day) have no session; those of `short` (day, closes as HH:mm)
    close earlier. A null day is dropped, a repeated one counts once.
    """
    work = days.select("day").where(F.col("day").isNotNull() & ~F.dayofweek("day").isin(SATURDAY, SUNDAY)).distinct()
    if closed is not None:
        work = work.join(closed.select("day").distinct(), "day", "left_anti")
    if short is not None:
        early = short.groupBy("day").agg(F.min("closes").alias("_early"))
        work = work.join(early, "day", "left")
    else:
        work = work.withColumn("_early", F.lit(None).cast("string"))
    closes = F.coalesce(F.col("_early"), F.lit(session.closes))
    return work.select(
        "day",
        _utc(F.col("day"), F.lit(session.opens), session.zone).alias("opens"),
        _utc(F.col("day"), closes, session.zone).alias("closes"),
    )


def days_between(spark, first: str, last: str) -> DataFrame:
    """`day` for every date from first to last."""
    return spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("day"))


def in_calendar(bars: DataFrame, calendar: DataFrame, session: Session = Session()) -> DataFrame:
    """The bars that start inside their day's session, with `day`, `opens` and `closes`.

    A calendar has one row a day, so it is small beside any bars; Spark broadcasts it below its threshold.
    """
    dated = bars.withColumn("day", exchange_day(F.col("date"), session))
    return dated.join(calendar, "day").where((F.col("date") >= F.col("opens")) & (F.col("date") < F.col("closes")))


def expected_bars(calendar: DataFrame, bar: str) -> DataFrame:
    """The calendar with `expected`, the number of bars that start in each session."""
    starts = F.size(F.sequence("opens", "closes", F.expr(f"INTERVAL {bar}")))
    last = F.element_at(F.sequence("opens", "closes", F.expr(f"INTERVAL {bar}")), -1)
    return calendar.withColumn("expected", starts - F.when(last == F.col("closes"), 1).otherwise(0))


def short_of_bars(bars: DataFrame, calendar: DataFrame, bar: str, session: Session = Session()) -> DataFrame:
    """`ticker, day, bars, expected` of the days that have bars in their session, but not as many as it holds."""
    counted = in_calendar(bars, calendar, session).groupBy(*BY_DAY).agg(F.countDistinct("date").alias("bars"))
    return counted.join(expected_bars(calendar, bar).select("day", "expected"), "day").where("bars < expected").select(
        *BY_DAY, "bars", "expected"
    )


def session_grid(days: DataFrame, calendar: DataFrame, bar: str) -> DataFrame:
    """`ticker, day, date` of every bar start in the sessions of the given (ticker, day)."""
    starts = F.sequence("opens", "closes", F.expr(f"INTERVAL {bar}"))
    return (
        days.select(*BY_DAY)
        .join(calendar, "day")
        .select(*BY_DAY, "closes", F.explode(starts).alias("date"))
        .where(F.col("date") < F.col("closes"))
        .drop("closes")
    )
