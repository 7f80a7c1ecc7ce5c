"""Entry conditions as Boolean columns.

Bar columns carry signals and predictions, ``allow_*`` columns the permissions of the
strategy parameters. A missing prediction is no "yes", and negated it is no "no".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barloom.functions.scalars import any_of


def _true(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(False))


def _is_buy() -> Column:
    return F.upper("action") == "BUY"


def breakaway_signal() -> Column:
    return F.when(_is_buy(), _true("buy_signal")).otherwise(_true("sell_signal"))


def trend_ml_condition() -> Column:
    buy = any_of(_true("allow_high_delta") & _true("high_delta"), _true("allow_high_stop") & ~_true("high_stop"))
    sell = any_of(_true("allow_low_delta") & _true("low_delta"), _true("allow_low_stop") & ~_true("low_stop"))
    return F.when(_is_buy(), buy).otherwise(sell)


def correction_ml_condition() -> Column:
    buy = any_of(_true("allow_high_delta") & _true("high_delta"), _true("allow_low_stop") & _true("low_stop"))
    sell = any_of(_true("allow_low_delta") & _true("low_delta"), _true("allow_high_stop") & _true("high_stop"))
    return F.when(_is_buy(), buy).otherwise(sell)


def benchmark_condition() -> Column:
    return _true("benchmark_trend")
