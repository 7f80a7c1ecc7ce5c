"""Landed raw bars to the bar table, with the requests for what is still missing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators import bars as bb
from barloom.operators import features as ff
from barloom.sources import sinks


@dataclass(frozen=True)
class Ingested:
    bars: DataFrame
    holidays: DataFrame
    bounds: DataFrame
    requests: DataFrame | None


def as_raw(bars: DataFrame, time_frame: str) -> DataFrame:
    """Bars in the landed form: date as text."""
    pattern = c.DAILY_FORMAT if time_frame == "1 day" else c.INTRADAY_FORMAT
    return bars.withColumns({"date": F.date_format("date", pattern), "has_gaps": F.lit(False)})


def ingest_bars(
    existing: DataFrame,
    raw: DataFrame,
    time_frame: str,
    bars_per_day: int = c.BARS_PER_DAY,
    retained_rows: int = c.RETAINED_DAYS * c.BARS_PER_DAY,
    daily: DataFrame | None = None,
    holidays: DataFrame | None = None,
) -> Ingested:
    """Parse, keep full days, upsert, retain the newest rows, take volume bounds.

    ``holidays`` (ticker, day) are the non-full days known so far; those found now come back with them.

    ``daily`` is the series whose days the intraday table must cover; the days it still
    lacks come back as requests. Daily and minute bars skip the full-day rule.
    """
    typed = sinks.typed_bars(raw, time_frame)
    stored = existing.withColumn("has_gaps", F.lit(False)) if "has_gaps" not in existing.columns else existing
    known = bb.distinct_days(stored).where(F.lit(False)) if holidays is None else holidays.select("ticker", "day")
    if time_frame == "5 mins":
        found = bb.non_full_days(typed, known, bars_per_day)
        known = bb.register_non_full_days(known, found)
        typed = bb.full_days_only(typed, bars_per_day).drop("day")
    merged = sinks.upsert_bars(stored, typed)
    kept = bb.retain_newest(merged, retained_rows)
    requests = bb.missed_days(daily, kept) if daily is not None else None
    return Ingested(kept, known, ff.volume_bounds(kept), requests)


def request_dates(bars: DataFrame, now: Column) -> DataFrame:
    """Days since the last bar of each ticker and the monthly request dates."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("_last"))
    days = sf.days_to_download(F.col("_last"), now)
    return (
        last.select("ticker", days.alias("days"))
        .withColumn("periods", sf.download_periods(F.col("days")))
        .select("*", F.explode(sf.month_anchors(F.col("periods"), now)).alias("anchor"))
    )
