"""Column functions shared by batch and streaming jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom import constants as c


def scaled_round(value: Column, digits: int) -> Column:
    """Round half up on the binary value."""
    factor = 10.0**digits
    return F.floor(value * factor + 0.5) / factor


def parse_bar_date(text: Column, time_frame: str) -> Column:
    """Date text of a raw bar to a timestamp; the format follows the time frame."""
    pattern = c.DAILY_FORMAT if time_frame == "1 day" else c.INTRADAY_FORMAT
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def day_key(text: Column) -> Column:
    return F.substring(text, 1, 8)


def volume_delta(volume: Column, low: Column, high: Column) -> Column:
    return F.round(F.try_divide((volume - low).cast("double"), (high - low).cast("double")), 3)


def to_int(text: Column) -> Column:
    return text.try_cast("int")


def to_float(text: Column) -> Column:
    return text.try_cast("float")


def sentinel_to_null(value: Column) -> Column:
    """The largest double stands for a missing figure."""
    return F.when(value != F.lit(1.7976931348623157e308), value)


def order_status(status: Column, remaining: Column | None = None) -> Column:
    """Broker status text to the status names; with ``remaining``, as in fill reports.

    In a fill report an order counts as filled only when nothing remains.
    """
    names = F.create_map(*[F.lit(part) for pair in c.BROKER_STATUS.items() for part in pair])
    named = F.try_element_at(names, status)
    if remaining is None:
        return named
    settles = status.isin("Filled", "Submitted")
    return F.when(settles, F.when(remaining == 0, F.lit("filled"))).otherwise(named)


def split_accounts(text: Column) -> Column:
    return F.split(text, ",")


def contract_id(search: Column, ids: Column) -> Column:
    """Number after the last dash of the first id that contains the search text."""
    hit = F.try_element_at(F.filter(ids, lambda one: F.contains(one, search)), F.lit(1))
    return F.try_element_at(F.split(hit, "-"), F.lit(-1)).try_cast("int")


def price_multiplier(
    age_seconds: Column, symbol: Column, side: Column, limit_price: Column, current: Column
) -> Column:
    """How far a resting price moves once it is older than five minutes.

    ``HYG`` moves with its own factors; other prices move by band, and a price on a band
    edge gets no factor.
    """
    buys = side == "BUY"

    def by_side(buy: float, sell: float) -> Column:
        return F.when(buys, F.lit(buy)).otherwise(F.lit(sell))

    bands = (
        F.when((limit_price > -0.5) & (limit_price < 0), by_side(-1.0, 1.25))
        .when((limit_price > 0) & (limit_price < 0.5), by_side(1.25, -1.0))
        .when(limit_price > 0.5, by_side(1.1, 0.9))
        .when(limit_price < -0.5, by_side(0.9, 1.1))
    )
    special = F.when(buys & (limit_price > 0), F.lit(1.1)).otherwise(F.lit(0.95))
    return F.when(age_seconds > 300, F.when(symbol == "HYG", special).otherwise(bands)).otherwise(current)


def days_to_download(last_date: Column, now: Column) -> Column:
    """Whole days since the last bar, null when there is none."""
    return F.floor(seconds_between(last_date, now) / 86400).cast("int")


def download_periods(days: Column) -> Column:
    return F.coalesce(F.floor(days / 30).cast("int"), F.lit(c.MONTHS_WITHOUT_DATA))


def month_anchors(periods: Column, now: Column) -> Column:
    """Request dates: now and every month before it, newest first."""
    months = F.sequence(F.lit(0), periods)
    return F.transform(months, lambda back: F.add_months(now.cast("date"), -back))


def minute_beginning(ts: Column) -> Column:
    return F.second(ts) == 0


def minute_ending(ts: Column) -> Column:
    return F.second(ts) == 55


def fifth_minute(ts: Column) -> Column:
    return F.minute(ts) % 5 == 0


def seconds_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("SECOND", start, end)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MINUTE", start, end)


def days_apart(one: Column, other: Column) -> Column:
    return F.abs(days_to_download(one, other))


def any_of(*conditions: Column) -> Column:
    """True when one condition is true; null counts as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(one, F.lit(False)) for one in conditions])


def local_time(ts: Column, zone: str = "America/New_York") -> Column:
    """UTC time to the wall clock of the exchange."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)
