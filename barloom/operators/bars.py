"""Bars: building, rolling up, day completeness, gap filling, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators import calendar as cal
from barloom.operators.series import day_of, newest_rows, number_rows, previous_values, spread_join
from barloom.schemas import SessionSpec

BY_DAY = ("ticker", "day")


def with_day(bars: DataFrame) -> DataFrame:
    return bars.withColumn("day", day_of())


# --- building -----------------------------------------------------------------------


def bars_from_ticks(ticks: DataFrame, width: str = "1 minute", tie: Sequence[str] = ()) -> DataFrame:
    """Ticks or short bars to bars stamped at the start of their window.

    All aggregates combine in a hash map before the shuffle, so a busy ticker costs one
    row per window and task. ``tie`` orders ticks of the same time and makes the
    aggregate sort-based; leave it out where times are unique.
    """
    at = F.struct("ts", *tie) if tie else F.col("ts")
    return (
        ticks.groupBy("ticker", F.window("ts", width).alias("w"))
        .agg(
            F.min_by("open", at).alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", at).alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("count").alias("count"),
        )
        .select("ticker", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume", "count")
    )


def roll_up(bars: DataFrame, width: str = "5 minutes", expected: int = 5) -> DataFrame:
    """Short bars to longer ones; ``has_gaps`` marks a window with bars missing."""
    return (
        bars.groupBy("ticker", F.window("date", width).alias("w"))
        .agg(
            F.min_by("open", "date").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "date").alias("close"),
            F.sum("volume").alias("volume"),
            F.sum("count").alias("count"),
            (F.count(F.lit(1)) < expected).alias("has_gaps"),
        )
        .select("ticker", F.col("w.start").alias("date"), "open", "high", "low", "close", "volume", "count", "has_gaps")
    )


# --- day completeness ---------------------------------------------------------------


def day_counts(bars: DataFrame) -> DataFrame:
    return with_day(bars).groupBy(*BY_DAY).agg(F.count(F.lit(1)).alias("bars"))


def full_days_only(bars: DataFrame, bars_per_day: int = c.BARS_PER_DAY) -> DataFrame:
    """Bars of the days that have exactly ``bars_per_day`` bars."""
    counted = with_day(bars).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*BY_DAY)))
    return counted.where(F.col("_n") == bars_per_day).drop("_n")


def incomplete_bars(bars: DataFrame, bars_per_day: int = c.BARS_PER_DAY) -> DataFrame:
    """All bars minus the bars of full days."""
    counted = with_day(bars).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*BY_DAY)))
    return counted.where(F.col("_n") != bars_per_day).drop("_n")


def non_full_days(bars: DataFrame, holidays: DataFrame, bars_per_day: int = c.BARS_PER_DAY) -> DataFrame:
    """Days to add to the holiday table: incomplete and not recorded yet."""
    short = day_counts(bars).where(F.col("bars") != bars_per_day)
    return short.join(holidays.select(*BY_DAY), list(BY_DAY), "left_anti")


def register_non_full_days(holidays: DataFrame, found: DataFrame) -> DataFrame:
    return holidays.select(*BY_DAY).unionByName(found.select(*BY_DAY)).distinct()


def drop_non_full_days(staged: DataFrame, found: DataFrame) -> DataFrame:
    return with_day(staged).join(found.select(*BY_DAY), list(BY_DAY), "left_anti")


def incomplete_test_days(bars: DataFrame, holidays: DataFrame, expected: int = c.MINUTES_PER_DAY) -> DataFrame:
    """Days that have bars, but not ``expected`` of them, and are no known holidays."""
    return non_full_days(bars, holidays, expected)


def distinct_days(bars: DataFrame) -> DataFrame:
    return with_day(bars).select(*BY_DAY).distinct()


def missed_days(daily: DataFrame, intraday: DataFrame) -> DataFrame:
    """Days of the daily series that have no intraday bar."""
    return distinct_days(daily).join(distinct_days(intraday), list(BY_DAY), "left_anti")


def date_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def keep_within(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    """Drop rows at or before the first and after the last date of the other series.

    A ticker without bounds keeps all its rows.
    """
    inside = F.col("first_date").isNull() | (
        (F.col("date") > F.col("first_date")) & (F.col("date") <= F.col("last_date"))
    )
    return spread_join(bars, bounds, ["ticker"], ["date"], "left").where(inside).drop("first_date", "last_date")


# --- gap filling --------------------------------------------------------------------


def day_grid(days: DataFrame, spec: SessionSpec, session_start: str = "00:00:00") -> DataFrame:
    """Every bar start of the given days."""
    start = F.to_timestamp_ntz(F.concat_ws(" ", F.col("day").cast("string"), F.lit(session_start)))
    starts = F.transform(
        F.sequence(F.lit(0), F.lit(spec.bars_per_day - 1)),
        lambda n: start + n * F.expr(f"INTERVAL {spec.bar}"),
    )
    return days.select(*BY_DAY, F.explode(starts).alias("date"))


def missing_bars(bars: DataFrame, days: DataFrame, spec: SessionSpec, calendar: DataFrame | None = None) -> DataFrame:
    """Bar starts of the given days that have no bar.

    With a calendar the starts are those of each day's session, else they begin at midnight.
    """
    grid = day_grid(days, spec) if calendar is None else cal.session_grid(days, calendar, spec.bar)
    return grid.join(bars.select("ticker", "date"), ["ticker", "date"], "left_anti")


def fill_from_nearest(
    bars: DataFrame,
    days: DataFrame,
    spec: SessionSpec,
    calendar: DataFrame | None = None,
    session: cal.Session = cal.Session(),
) -> DataFrame:
    """Bars for the missing starts, copied from the nearest bar of the day, or of its session with a calendar.

    The earlier bar wins a tie. A day's bars and grid are one bounded group.
    """
    payload = ["open", "high", "low", "close", "volume", "count"]
    dated = with_day(bars) if calendar is None else cal.in_calendar(bars, calendar, session)
    present = dated.join(days.select(*BY_DAY), list(BY_DAY), "left_semi")
    points = present.select(*BY_DAY, "date", F.struct("date", *payload).alias("_bar")).unionByName(
        missing_bars(bars, days, spec, calendar), allowMissingColumns=True
    )
    by_day = Window.partitionBy(*BY_DAY).orderBy("date")
    before = F.last("_bar", ignorenulls=True).over(by_day.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_bar", ignorenulls=True).over(by_day.rowsBetween(0, Window.unboundedFollowing))
    back = sf.seconds_between(F.col("_before.date"), F.col("date"))
    ahead = sf.seconds_between(F.col("date"), F.col("_after.date"))
    use_before = F.col("_after").isNull() | (F.col("_before").isNotNull() & (back <= ahead))
    nearest = F.when(use_before, F.col("_before")).otherwise(F.col("_after"))
    return (
        points.withColumns({"_before": before, "_after": after})
        .where(F.col("_bar").isNull())
        .withColumn("_near", nearest)
        .select(*BY_DAY, "date", F.col("_near.date").alias("source_date"), *[F.col(f"_near.{n}").alias(n) for n in payload])
    )


def illiquid_days(missing: DataFrame, threshold: int = c.ILLIQUID_GAPS) -> DataFrame:
    """Days with more than ``threshold`` filled gaps."""
    return (
        missing.groupBy(*BY_DAY).agg(F.count(F.lit(1)).alias("gaps")).where(F.col("gaps") > threshold)
    )


# --- retention and newest rows ------------------------------------------------------


def retain_newest(bars: DataFrame, n: int = c.RETAINED_DAYS * c.BARS_PER_DAY) -> DataFrame:
    return newest_rows(bars, n)


def retain_years(daily: DataFrame, now: Column, years: int = 2) -> DataFrame:
    """Drop daily bars dated up to ``now`` minus the given years."""
    return daily.where(F.col("date") > F.add_months(now.cast("date"), -12 * years))


def latest_bar(bars: DataFrame) -> DataFrame:
    """Newest bar per ticker; (ticker, date) is unique, so all columns come from one row.

    One aggregate per column keeps the aggregation in a hash map, where a struct would
    sort all rows by ticker.
    """
    rest = [name for name in bars.columns if name not in ("ticker", "date")]
    newest = [F.max_by(name, "date").alias(name) for name in rest]
    return bars.groupBy("ticker").agg(F.max("date").alias("date"), *newest)


def latest_value(bars: DataFrame, column: str) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max_by(column, "date").alias(column))


def bars_between(bars: DataFrame, start: Column, end: Column) -> DataFrame:
    return bars.where(F.col("date").between(start, end))


def oldest_rows(bars: DataFrame, n: int) -> DataFrame:
    if n > 100:
        return number_rows(bars, name="_at").where(F.col("_at") < n).drop("_at")
    rank = F.row_number().over(Window.partitionBy("ticker").orderBy("date"))
    return bars.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def set_newest(bars: DataFrame, updates: DataFrame, column: str) -> DataFrame:
    """Set one column: at the date an update names, else on the newest bar of its ticker."""
    newest = bars.groupBy("ticker").agg(F.max("date").alias("_newest"))
    at = updates.join(newest, "ticker").select(
        "ticker", F.coalesce("date", "_newest").alias("date"), F.col("value").alias("_value")
    )
    merged = bars.join(at, ["ticker", "date"], "left")
    return merged.withColumn(column, F.coalesce("_value", column)).drop("_value")


def carry_previous(bars: DataFrame, column: str) -> DataFrame:
    """Null values take the value of the bar before."""
    carried = previous_values(bars, [column], prefix="_previous_")
    return carried.withColumn(column, F.coalesce(column, f"_previous_{column}")).drop(f"_previous_{column}")


# --- session context ----------------------------------------------------------------


def session_context(bars: DataFrame, open_at: str = "09:30", close_at: str = "15:59") -> DataFrame:
    """Day open and previous close per ticker and day from the first and last session bar.

    Times are exchange wall-clock times. One row per ticker and day, so the series of a
    ticker is as long as the calendar.
    """
    local = sf.local_time(F.col("date"))
    clock = F.date_format(local, "HH:mm")
    days = (
        bars.groupBy("ticker", local.cast("date").alias("day"))
        .agg(
            F.max(F.when(clock == open_at, F.col("open"))).alias("day_open"),
            F.max(F.when(clock == close_at, F.col("close"))).alias("_close"),
        )
    )
    before = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.withColumn("prev_day_close", F.last("_close", ignorenulls=True).over(before)).drop("_close")


def seed_day_context(bars: DataFrame, context: DataFrame) -> DataFrame:
    """Stamp day open and previous close on every bar of the day."""
    local_day = sf.local_time(F.col("date")).cast("date")
    return bars.withColumn("day", local_day).join(context, list(BY_DAY), "left")
