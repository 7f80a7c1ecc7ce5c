"""Live bars: ticks to minute bars to five-minute bars, with a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions import scalars as sf

DELAY = "30 seconds"
BAR_COLUMNS = ["open", "high", "low", "close", "volume", "count"]


def watermarked(rows: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks need TIMESTAMP; the session time zone is UTC, so no time moves."""
    return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def start_of(window: str) -> Column:
    return F.col(f"{window}.start").cast("timestamp_ntz")


def in_session(ts: str | Column = "ts", start: str = "09:30", end: str = "16:00") -> Column:
    """Whether a UTC time falls in the exchange session."""
    column = F.col(ts) if isinstance(ts, str) else ts
    clock = F.date_format(sf.local_time(column), "HH:mm")
    return (clock >= start) & (clock < end)


def session_filter(ticks: DataFrame, start: str = "09:30", end: str = "16:00") -> DataFrame:
    return ticks.where(in_session("ts", start, end))


def _windowed(rows: DataFrame, time: Column, at: Column, width: str) -> DataFrame:
    return rows.groupBy("ticker", F.window(time, width).alias("w")).agg(
        F.min_by("open", at).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", at).alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("count").alias("count"),
        F.count(F.lit(1)).alias("parts"),
    )


def _stamped(bars: DataFrame) -> DataFrame:
    return bars.select("ticker", start_of("w").alias("date"), *BAR_COLUMNS)


def minute_windows(ticks: DataFrame, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    """Bars that close once the watermark passes their window; later ticks are dropped."""
    watched = watermarked(ticks, "ts", delay)
    return _windowed(watched, F.col("ts"), F.col("ts"), width)


def minute_bars_stream(ticks: DataFrame, width: str = "1 minute", delay: str = DELAY) -> DataFrame:
    return _stamped(minute_windows(ticks, width, delay))


def five_minute_bars_stream(ticks: DataFrame, width: str = "5 minutes", expected: int = 5, delay: str = DELAY) -> DataFrame:
    """Closed minute bars to longer bars in the same query."""
    minutes = minute_windows(ticks, delay=delay)
    rolled = _windowed(minutes, F.window_time("w"), F.col("w.start"), width)
    return rolled.select(
        "ticker", start_of("w").alias("date"), *BAR_COLUMNS, (F.col("parts") < expected).alias("has_gaps")
    )


def cross_section(bars: DataFrame) -> DataFrame:
    """All tickers of each closed bar time together.

    A window leaves the stream when the watermark passes its end, for all tickers in the
    same batch: that is the barrier.
    """
    return bars.groupBy("date").agg(
        F.count(F.lit(1)).alias("tickers"), F.sum("volume").alias("volume"), F.max("high").alias("high"), F.min("low").alias("low")
    )


def stamped_days(ticks: DataFrame, width: str = "1 minute", bars_per_day: int | None = None, delay: str = DELAY) -> DataFrame:
    """Closed bars with the open of their day and the previous day's close, in one query with the ticks.

    The watermark of the ticks goes on with the bars: a bar leaves its window and the day state in the same batch.
    """
    from barloom.streaming.state import day_state

    closed = minute_windows(ticks, width, delay).withColumn("closed", F.window_time("w"))
    bars = closed.select("ticker", F.col("w.start").alias("date"), *BAR_COLUMNS, "closed")
    stamped = day_state(bars, delay=None, time="closed", bars_per_day=bars_per_day)
    return stamped.withColumn("date", F.col("date").cast("timestamp_ntz")).drop("closed")
