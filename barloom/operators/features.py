"""Session and benchmark features for all tickers at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators.bars import BY_DAY, with_day
from barloom.operators.series import CHUNK_ROWS, Trailing, exponential_averages, spread_join, trailing
from barloom.schemas import SessionSpec


def by_day() -> WindowSpec:
    return Window.partitionBy(*BY_DAY).orderBy("date")


def day_so_far() -> WindowSpec:
    return by_day().rowsBetween(Window.unboundedPreceding, 0)


def volume_bounds(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.max("volume").alias("vol_max"), F.min("volume").alias("vol_min"))


def add_volume_delta(bars: DataFrame, bounds: DataFrame) -> DataFrame:
    joined = spread_join(bars, bounds.select("ticker", "vol_min", "vol_max"), ["ticker"], ["date"], "left")
    delta = sf.volume_delta(F.col("volume"), F.col("vol_min"), F.col("vol_max"))
    return joined.withColumn("volume_delta", delta).drop("vol_min", "vol_max")


def add_day_columns(bars: DataFrame, spec: SessionSpec) -> DataFrame:
    """Period, open and look-ahead extremes of the day, all over one (ticker, day) shuffle.

    ``day_max`` and ``day_min`` look ahead: they make labels, never features.
    """
    rank = F.row_number().over(by_day())
    rest = by_day().rowsBetween(0, Window.unboundedFollowing)
    period = F.least(F.ceil(F.col("_rank") / spec.bars_per_period), F.lit(spec.periods)).cast("int")
    return (
        with_day(bars)
        .withColumns(
            {
                "_rank": rank,
                "day_open": F.first("open").over(day_so_far()),
                "day_max": F.max("high").over(rest),
                "day_min": F.min("low").over(rest),
            }
        )
        .withColumn("session_period", period)
        .withColumn("open_delta", open_delta())
    )


def open_delta() -> Column:
    return F.round(F.try_divide("close", "day_open"), 4)


def add_prev_day_close(ranked: DataFrame, spec: SessionSpec, include_own_close: bool = False) -> DataFrame:
    """Close of the last bar of the latest complete day before the row, else the day open.

    Needs ``_rank``, ``day`` and ``day_open``. With ``include_own_close`` the last bar of
    a complete day sees its own close.
    """
    last_bar = F.col("_rank") == spec.bars_per_day
    closes = ranked.groupBy(*BY_DAY).agg(F.max(F.when(last_bar, F.col("close"))).alias("_close"))
    before = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    earlier = closes.select(*BY_DAY, F.last("_close", ignorenulls=True).over(before).alias("_earlier"))
    # bars past the last one of a complete day already know its close
    past = F.max(F.when(last_bar, F.col("close"))).over(
        day_so_far() if include_own_close else by_day().rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranked.withColumn("_today", past)
        .join(earlier, list(BY_DAY))
        .withColumn("prev_day_close", F.coalesce("_today", "_earlier", "day_open"))
        .drop("_today", "_earlier")
    )


def prepare_features(bars: DataFrame, bounds: DataFrame, spec: SessionSpec) -> DataFrame:
    ranked = add_day_columns(bars, spec)
    closed = add_prev_day_close(ranked, spec).drop("_rank")
    return add_volume_delta(closed, bounds)


def period_summary(features: DataFrame) -> DataFrame:
    """Mean move since the open per ticker and session period.

    Deltas have four digits, so their sum is exact as a whole number, in any order.
    """
    steps = F.round(F.col("open_delta") * 10000).cast("bigint")
    mean = F.sum(steps) / F.count("open_delta") / 10000
    return features.groupBy("ticker", "session_period").agg(mean.alias("avg_open_delta"), F.count(F.lit(1)).alias("bars"))


# --- benchmark features -------------------------------------------------------------


def range_average(frame) -> Column:
    return (F.max("high").over(frame) + F.min("low").over(frame)) / 2


def high_low_average(bars: DataFrame, n: int = c.RANGE_AVERAGE_BARS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    def add(rows: DataFrame, frames: Trailing) -> DataFrame:
        return rows.withColumn("high_low_average", range_average(frames.last(n)))

    return trailing(bars, n - 1, add, chunk_rows=chunk_rows)


def moving_averages(bars: DataFrame, source: str, targets: dict[str, int], chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Means of the last n rows, one column per target."""

    def add(rows: DataFrame, frames: Trailing) -> DataFrame:
        return frames.with_means(rows, source, targets)

    return trailing(bars, max(targets.values()) - 1, add, chunk_rows=chunk_rows)


def benchmark_averages(bars: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Range average, both simple and both exponential averages, and their difference."""

    def add(rows: DataFrame, frames: Trailing) -> DataFrame:
        ranged = rows.withColumn("high_low_average", range_average(frames.last(c.RANGE_AVERAGE_BARS)))
        return frames.with_means(ranged, "high_low_average", {"fast_sma": c.FAST_SMA, "slow_sma": c.SLOW_SMA})

    reach = c.RANGE_AVERAGE_BARS + c.SLOW_SMA - 2
    simple = trailing(bars, reach, add, chunk_rows=chunk_rows)
    spans = {"fast_ema": c.FAST_EMA, "slow_ema": c.SLOW_EMA}
    both = exponential_averages(simple, "high_low_average", spans, chunk_rows=max(chunk_rows, reach + 1))
    difference = F.col("fast_sma") - F.col("slow_sma") - (F.col("fast_ema") - F.col("slow_ema"))
    return both.withColumn("difference", difference)


def benchmark_features(bars: DataFrame, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``<name>_difference`` and ``<name>_open_delta`` per benchmark bar."""
    averaged = benchmark_averages(bars, chunk_rows)
    opened = with_day(averaged).withColumn("day_open", F.first("open").over(day_so_far()))
    return opened.select(
        "ticker",
        "date",
        F.col("difference").alias(f"{name}_difference"),
        open_delta().alias(f"{name}_open_delta"),
    )


def benchmark_of(tickers: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """Benchmark of each ticker through its industry."""
    return tickers.join(benchmarks.select("industry", "benchmark"), "industry", "left")


def attach_benchmarks(features: DataFrame, members: DataFrame, benchmarks: DataFrame, market: DataFrame) -> DataFrame:
    """Features of the own benchmark and of the market at the same time.

    The market columns are joined to the benchmarks first: those are few, and the
    features are then shuffled once.
    """
    both = benchmarks.withColumnRenamed("ticker", "benchmark").join(market.drop("ticker"), "date")
    tagged = spread_join(features, members.select("ticker", "benchmark"), ["ticker"], ["date"])
    return tagged.join(both, ["benchmark", "date"]).drop("benchmark")


def strategy_of(action: Column) -> Column:
    """Moving with the previous close is trend, against it (or equal) is correction."""
    with_trend = F.when(action == "buy", F.col("close") > F.col("prev_day_close")).otherwise(
        F.col("close") < F.col("prev_day_close")
    )
    return F.when(with_trend, F.lit("trend")).otherwise(F.lit("correction"))


def with_actions(features: DataFrame, actions: DataFrame) -> DataFrame:
    """One row per action of the ticker, tagged with its strategy."""
    sets = actions.groupBy("ticker").agg(F.collect_set("action").alias("_actions"))
    joined = spread_join(features, sets, ["ticker"], ["date"])
    return joined.withColumn("action", F.explode("_actions")).drop("_actions").withColumn("strategy", strategy_of(F.col("action")))


# --- screen columns -----------------------------------------------------------------


def screen_columns(
    daily: DataFrame,
    volume_bars: int = 63,
    range_bars: int = 14,
    year_bars: int = 252,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Average and relative volume, average true range, change and 52-week extremes."""

    def add(rows: DataFrame, frames: Trailing) -> DataFrame:
        extremes = frames.with_extremes(rows, year_bars, {"_top": "high"}, {"_bottom": "low"})
        ranged = extremes.withColumn("_previous", F.lag("close").over(frames.ordered)).withColumn(
            "_range",
            F.greatest(
                F.col("high") - F.col("low"),
                F.abs(F.col("high") - F.col("_previous")),
                F.abs(F.col("low") - F.col("_previous")),
            ),
        )
        means = frames.with_means(ranged, "volume", {"avg_volume": volume_bars})
        means = frames.with_means(means, "_range", {"average_true_range": range_bars})
        return means.withColumns(
            {
                "relative_volume": F.try_divide(F.col("volume").cast("double"), F.col("avg_volume")),
                "change": F.col("close") - F.col("_previous"),
                "new_high": F.col("high") == F.col("_top"),
                "new_low": F.col("low") == F.col("_bottom"),
            }
        ).drop("_previous", "_range", "_top", "_bottom")

    reach = max(volume_bars, year_bars, range_bars + 1) - 1
    return trailing(daily, reach, add, chunk_rows=chunk_rows, block=year_bars).drop("_chunk")

