"""Declared schemas and the session shape.

Times are TIMESTAMP_NTZ in UTC, so no result depends on the session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from barloom import constants as c

TICK = (
    "ticker string, ts timestamp_ntz, open double, high double, low double, "
    "close double, volume bigint, count bigint"
)
BAR = (
    "ticker string, date timestamp_ntz, open double, high double, low double, "
    "close double, volume bigint, count bigint, has_gaps boolean"
)
FEATURES = (
    "date timestamp_ntz, ticker string, strategy string, day_max double, day_min double, "
    "volume_delta double, open_delta double, benchmark_open_delta double, "
    "spy_open_delta double, session_period int, prev_day_close double, "
    "spy_difference double, benchmark_difference double"
)
TECHNICAL_PARAMS = (
    "benchmark_negative double, benchmark_positive double, limit_price double, "
    "limit_time int, limit_trades int, min_trail_percent double, stop_trades int, "
    "trail_percent double, trail_time int, high_delta boolean, low_delta boolean, "
    "low_stop boolean, high_stop boolean, spy boolean"
)
MODEL_REGISTRY = (
    "date timestamp_ntz, ticker string, action string, session_period int, strategy string, "
    "label string, path string, winner string, area_under_roc double, "
    "yes bigint, no bigint, held_yes bigint, held_no bigint, reason string"
)
EVENTS = (
    "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string"
)


@dataclass(frozen=True)
class SessionSpec:
    """Shape of a trading day: bar width and how bars fall into periods."""

    bar: str = "5 minutes"
    bars_per_day: int = c.BARS_PER_DAY
    bars_per_period: int = c.BARS_PER_PERIOD
    periods: int = c.SESSION_PERIODS
