"""Filling absent bars of all tickers in one pass."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.operators import bars as bb
from barloom.operators import calendar as cal
from barloom.schemas import SessionSpec


@dataclass(frozen=True)
class Filled:
    bars: DataFrame
    illiquid: DataFrame


def fill_absent(
    bars: DataFrame,
    spec: SessionSpec,
    holidays: DataFrame | None = None,
    reference: DataFrame | None = None,
    threshold: int = c.ILLIQUID_GAPS,
    calendar: DataFrame | None = None,
    session: cal.Session = cal.Session(),
) -> Filled:
    """Complete every incomplete day from its nearest bars.

    ``reference`` is the series whose date range limits the bars. One pass completes the
    grid, so nothing is repeated. With a ``calendar`` a day is complete when its session is, early
    closes and clock changes included; bars outside of sessions stay as they are.
    """
    shape = ["ticker", "date", "open", "high", "low", "close", "volume", "count"]
    kept = bb.keep_within(bars, bb.date_bounds(reference)) if reference is not None else bars
    if calendar is not None:
        days = cal.short_of_bars(kept, calendar, spec.bar, session)
        days = days if holidays is None else days.join(holidays.select("ticker", "day"), ["ticker", "day"], "left_anti")
    elif holidays is None:
        days = bb.day_counts(kept).where(F.col("bars") != spec.bars_per_day)
    else:
        days = bb.incomplete_test_days(kept, holidays, spec.bars_per_day)
    filled = bb.fill_from_nearest(kept, days, spec, calendar, session)
    complete = kept.select(*shape, F.lit(False).alias("has_gaps")).unionByName(
        filled.select(*shape, F.lit(True).alias("has_gaps"))
    )
    return Filled(complete, bb.illiquid_days(filled, threshold))
