"""Strategy parameters: parsing, defaults and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators.series import spread_join
from barloom.schemas import TECHNICAL_PARAMS

KEY = ["ticker", "action", "strategy"]


def parse_params(test_params: DataFrame) -> DataFrame:
    """JSON parameters to columns."""
    parsed = test_params.withColumn("_params", F.from_json("technical_params", TECHNICAL_PARAMS))
    return parsed.select("*", "_params.*").drop("_params", "technical_params")


def scan_params(test_params: DataFrame, trade_params: DataFrame, time_frame: str = "minute") -> DataFrame:
    """Parameters of one time frame with the volume bounds of their ticker."""
    framed = test_params.where(F.col("time_frame") == time_frame).withColumnRenamed("symbol", "ticker")
    return framed.join(trade_params.select("ticker", "vol_max", "vol_min"), "ticker")


def attach_params(rows: DataFrame, params: DataFrame, how: str = "inner", spread_by: Sequence[str] = ("date",)) -> DataFrame:
    """Parameters by ticker, action and strategy."""
    return spread_join(rows, params, KEY, spread_by, how)


def keyed_lookup(rows: DataFrame, table: DataFrame, key: Sequence[str], spread_by: Sequence[str]) -> DataFrame:
    """Columns of a one-row-per-key table, null where the key is absent."""
    return spread_join(rows, table, key, spread_by, "left")


def params_by_ticker(params: DataFrame) -> DataFrame:
    """Trend and correction parameters of a ticker and action side by side."""
    names = [name for name in params.columns if name not in ("ticker", "action", "strategy")]
    sides = [
        F.max_by(F.struct(*names), F.when(F.col("strategy") == side, F.lit(1))).alias(side)
        for side in c.STRATEGIES
    ]
    return params.groupBy("ticker", "action").agg(*sides)


def uses_benchmark() -> Column:
    return F.col("benchmark_positive").isNotNull() & F.col("benchmark_negative").isNotNull()


def uses_ml(prefix: str = "") -> Column:
    return sf.any_of(*[F.col(prefix + name) for name in c.LABELS])


def stop_rows() -> Column:
    return F.coalesce(F.col("stop_trades") * c.ROWS_PER_POSITION, F.lit(c.DEFAULT_STOP_ROWS))


def limit_rows() -> Column:
    return F.coalesce(F.col("limit_trades") * c.ROWS_PER_POSITION, F.lit(c.DEFAULT_LIMIT_ROWS))


def _percent(action: Column, ratio: Column) -> Column:
    return F.when(F.upper(action) == "BUY", (1 - ratio) * 100).otherwise((ratio - 1) * 100)


def min_trail_percent(action: Column) -> Column:
    return _percent(action, F.col("min_trail_percent"))


def trail_percent(action: Column) -> Column:
    rounded = sf.scaled_round(_percent(action, F.col("trail_percent")), 2)
    return F.coalesce(rounded, F.lit(c.DEFAULT_TRAIL))


def limit_percent(action: Column) -> Column:
    default = F.when(F.upper(action) == "BUY", F.lit(c.DEFAULT_LIMIT_BUY)).otherwise(F.lit(c.DEFAULT_LIMIT_SELL))
    return F.coalesce(F.col("limit_price"), default)


def limit_minutes() -> Column:
    return F.coalesce(F.col("limit_time"), F.lit(c.DEFAULT_LIMIT_MINUTES))
