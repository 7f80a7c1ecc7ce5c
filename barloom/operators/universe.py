"""Ticker universe: screens, freshness, gates and work-lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators.series import newest_rows

TEST_KEY = ["symbol", "time_frame", "strategy", "action"]


# --- freshness and flags ------------------------------------------------------------


def fresh_tickers(table: DataFrame, now: Column, days: int = c.FRESH_DAYS) -> DataFrame:
    return table.where(sf.days_apart(F.col("date"), now) < days)


def stale_tickers(table: DataFrame, now: Column, days: int = c.FRESH_DAYS) -> DataFrame:
    """Tickers that are not in the fresh list."""
    fresh = fresh_tickers(table, now, days).select("ticker").distinct()
    return table.where(F.col("ticker").isNotNull()).join(fresh, "ticker", "left_anti")


def passed_backtest(tickers: DataFrame, test_params: DataFrame) -> DataFrame:
    passed = test_params.where((F.col("performance")) & (F.col("time_frame") == "minute"))
    return tickers.join(passed.select(F.col("symbol").alias("ticker")).distinct(), "ticker", "left_semi")


def valid_tickers(trade_params: DataFrame, test_params: DataFrame, flag: str, now: Column) -> DataFrame:
    """Fresh, flagged and passed tickers."""
    flagged = fresh_tickers(trade_params, now).where(F.col(flag))
    return passed_backtest(flagged, test_params).select("ticker", "conid", "industry")


def not_in(tickers: DataFrame, *lists: DataFrame) -> DataFrame:
    """Rows whose ticker is in none of the one-column lists."""
    kept = tickers.where(F.col("ticker").isNotNull())
    for names in lists:
        column = names.columns[0]
        kept = kept.join(names.select(F.col(column).alias("ticker")).distinct(), "ticker", "left_anti")
    return kept


def flagged_tickers(trade_params: DataFrame, illiquid: DataFrame, flag: str) -> DataFrame:
    return not_in(trade_params.where(F.col(flag)), illiquid.select("ticker"))


def stale_for_load(tickers: DataFrame, bars: DataFrame, now: Column, days: int = c.RELOAD_DAYS) -> DataFrame:
    """Tickers without bars or with a last bar older than the given days."""
    last = bars.groupBy("ticker").agg(F.max("date").alias("last_date"))
    joined = tickers.select("ticker").join(last, "ticker", "left")
    old = F.col("last_date") < now - F.expr(f"INTERVAL {days} DAYS")
    return joined.where(F.col("last_date").isNull() | old)


def distinct_tickers(bars: DataFrame, benchmarks: DataFrame, illiquid: DataFrame) -> DataFrame:
    return not_in(bars.select("ticker").distinct(), benchmarks.select("benchmark"), illiquid.select("ticker"))


def has_processing(bars: DataFrame) -> DataFrame:
    """Whether the newest bar of a ticker carries a previous close."""
    newest = F.max_by("prev_day_close", "date")
    return bars.groupBy("ticker").agg(newest.isNotNull().alias("processed"))


# --- back-test bookkeeping ----------------------------------------------------------


def retest_limit(strategy: Column) -> Column:
    reports = strategy.isin(*c.REPORT_STRATEGIES)
    return F.when(reports, F.lit(c.RETEST_DAYS_REPORTS)).otherwise(F.lit(c.RETEST_DAYS))


def is_due(now: Column) -> Column:
    age = sf.seconds_between(F.col("date"), now)
    return F.col("date").isNull() | (age > retest_limit(F.col("strategy")) * 86400)


def needs_test(test_params: DataFrame, now: Column) -> DataFrame:
    return test_params.where(is_due(now)).select(*TEST_KEY, "date")


def last_test_date(test_params: DataFrame) -> DataFrame:
    return test_params.select(*TEST_KEY, "date")


def backtest_metric(test_params: DataFrame, column: str) -> DataFrame:
    """One metric by key: ratios by name, returns and portfolio values by short name."""
    if column in ("beta", "max_drawdown") or column.startswith("portfolio_value"):
        name = column
    else:
        name = f"{column}_period_return"
    return test_params.select(*TEST_KEY, F.col(name).alias("metric"))


def error_tickers(errors: DataFrame) -> DataFrame:
    failed = F.col("strategy").isin(*c.STRATEGIES) | (F.col("test_param") == "combined")
    return errors.where(failed).select("ticker").distinct()


def backtest_gate(test_params: DataFrame) -> DataFrame:
    """Pass mark of a back-test; null while either strategy lacks its combined return."""
    sign = F.when(F.col("action") == "buy", F.lit(1)).otherwise(F.lit(-1))
    good = (
        (F.col("algo_period_return") > F.abs("max_drawdown"))
        & (F.col("algo_period_return") > c.MARKET_SHARE * F.col("spy_period_return") * sign)
        & (F.abs("beta") < c.MAX_BETA)
    )
    complete = F.col("_tested") == len(c.STRATEGIES)
    all_known = (
        F.col("algo_period_return").isNotNull()
        & F.col("max_drawdown").isNotNull()
        & F.col("spy_period_return").isNotNull()
        & F.col("beta").isNotNull()
    )
    tested = test_params.groupBy("symbol", "time_frame", "action").agg(
        F.count_distinct(F.when(F.col("combined_period_return").isNotNull(), F.col("strategy"))).alias("_tested")
    )
    joined = test_params.join(tested, ["symbol", "time_frame", "action"])
    return joined.select(*TEST_KEY, F.when(complete & all_known, good).alias("passed"))


def set_backtest_flag(test_params: DataFrame, passed: DataFrame) -> DataFrame:
    merged = test_params.join(passed, TEST_KEY, "left")
    return merged.withColumn("performance", F.coalesce("passed", "performance")).drop("passed")


def untested_symbols(test_params: DataFrame, illiquid: DataFrame, errors: DataFrame) -> DataFrame:
    """Symbols still waiting for a combined return, per action."""
    waiting = test_params.where(F.col("combined_period_return").isNull() & (F.col("time_frame") == "minute"))
    named = waiting.select(F.col("symbol").alias("ticker"), "action").distinct()
    return not_in(named, illiquid.select("ticker"), errors.select("ticker"))


def next_untested_symbol(test_params: DataFrame, illiquid: DataFrame, errors: DataFrame) -> DataFrame:
    """First waiting symbol by name, per action."""
    return untested_symbols(test_params, illiquid, errors).groupBy("action").agg(F.min("ticker").alias("ticker"))


def backtest_worklist(test_params: DataFrame, errors: DataFrame, now: Column) -> DataFrame:
    """Runs that are due: no portfolio value yet, or the last test is too old."""
    values = {"plain": "portfolio_value", "benchmark": "portfolio_value_benchmark", "ml": "portfolio_value_ml"}
    missing = F.lit(True)
    for variant, column in values.items():
        missing = F.when(F.col("variant") == variant, F.col(column).isNull()).otherwise(missing)
    runs = test_params.where(F.col("time_frame") == "minute").withColumn(
        "variant", F.explode(F.array(*[F.lit(v) for v in c.TEST_VARIANTS]))
    )
    due = runs.where(missing | is_due(now)).withColumnRenamed("symbol", "ticker")
    return not_in(due, error_tickers(errors)).select("ticker", "action", "strategy", "variant")


def register_strategies(flags: DataFrame, test_params: DataFrame) -> DataFrame:
    """Rows to add: flagged tickers by action and strategy without an entry."""
    actions = F.explode(
        F.filter(
            F.array(
                F.when(F.col("day_trade_buy"), F.lit("buy")), F.when(F.col("day_trade_sell"), F.lit("sell"))
            ),
            lambda one: one.isNotNull(),
        )
    )
    sides = F.explode(F.array(*[F.lit(side) for side in c.STRATEGIES]))
    wanted = (
        flags.select(F.col("ticker").alias("symbol"), "day_trade_buy", "day_trade_sell")
        .withColumn("action", actions)
        .withColumn("strategy", sides)
        .select("symbol", F.lit("minute").alias("time_frame"), "strategy", "action")
    )
    return wanted.join(test_params.select(*TEST_KEY), TEST_KEY, "left_anti")


# --- trade parameters ---------------------------------------------------------------


def range_midpoint(daily: DataFrame, n: int = c.RANGE_BARS) -> DataFrame:
    """Midpoint of the high-low range of the newest bars, and the last close."""
    newest = newest_rows(daily, n)
    high, low = F.max("high"), F.min("low")
    return newest.groupBy("ticker").agg(
        (high - (high - low) / 2).alias("range_midpoint"), F.max_by("close", "date").alias("last_price")
    )


def drop_tickers_without_bars(trade_params: DataFrame, bars: DataFrame) -> DataFrame:
    return trade_params.join(bars.select("ticker").distinct(), "ticker", "left_semi")


def direction_flags(trade_params: DataFrame) -> DataFrame:
    """Keep a flag only while the price is on its side of the midpoint."""
    above = F.col("last_price") > F.col("range_midpoint")
    below = F.col("last_price") < F.col("range_midpoint")
    return trade_params.withColumns(
        {
            "day_trade_buy": F.coalesce(F.col("day_trade_buy") & above, F.lit(False)),
            "day_trade_sell": F.coalesce(F.col("day_trade_sell") & below, F.lit(False)),
        }
    )


# --- screens ------------------------------------------------------------------------

# Screen thresholds.
SCREEN_AVG_VOLUME = 1_000_000
SCREEN_PRICE = 30
SCREEN_RANGE, SCREEN_RANGE_CHANGE = 0.5, 1.0
SCREEN_VOLUME_STEP = 0.25


def market_step(relative_volume: Column) -> Column:
    """Relative volume of the market rounded down to a quarter."""
    return F.floor(relative_volume / SCREEN_VOLUME_STEP) * SCREEN_VOLUME_STEP


def screen(columns: DataFrame, market: DataFrame, avg_volume: float = SCREEN_AVG_VOLUME, price: float = SCREEN_PRICE) -> DataFrame:
    """All four screens in one pass: a row per bar and screen it passes, as ``screen``.

    ``market`` holds the market's relative volume by date. The change screen follows the
    sign of that figure: tickers that rose while it is positive, else tickers that fell.
    """
    base = columns.join(
        market.select("date", F.col("relative_volume").alias("_market")), "date"
    ).where((F.col("avg_volume") > avg_volume) & (F.col("close") > price))
    lively = (F.col("average_true_range") > SCREEN_RANGE) & (F.col("relative_volume") > market_step(F.col("_market")))
    direction = F.when(F.col("_market") > 0, F.col("change") > 0).otherwise(F.col("change") < 0)
    passed = {
        "main": lively,
        "market_change": (F.col("average_true_range") > SCREEN_RANGE_CHANGE) & direction,
        "new_high": lively & F.col("new_high"),
        "new_low": lively & F.col("new_low"),
    }
    names = F.array(*[F.when(condition, F.lit(name)) for name, condition in passed.items()])
    return base.select("ticker", "date", F.explode(F.array_compact(names)).alias("screen"))


def screen_union(screens: Sequence[DataFrame]) -> DataFrame:
    """All screens one after the other, duplicates kept."""
    first, *rest = screens
    for one in rest:
        first = first.unionByName(one)
    return first


# --- sets of tickers ----------------------------------------------------------------


def new_tickers(screened: DataFrame, known: DataFrame) -> DataFrame:
    """Screened tickers not known yet."""
    return not_in(screened.select("ticker").distinct(), known.select("ticker"))


def flag_screened(known: DataFrame, screened: DataFrame, flag: str) -> DataFrame:
    """Add new tickers and set the flag of every screened ticker."""
    names = screened.select("ticker").distinct().withColumn("_hit", F.lit(True))
    merged = known.join(names, "ticker", "full_outer")
    return merged.withColumn(flag, F.when(F.col("_hit"), F.lit(True)).otherwise(F.col(flag))).drop("_hit")


def all_tickers(*lists: DataFrame) -> DataFrame:
    first, *rest = [one.select("ticker") for one in lists]
    for one in rest:
        first = first.unionByName(one)
    return first.distinct()


def buy_sell_benchmarks(buys: DataFrame, sells: DataFrame, benchmarks: DataFrame) -> DataFrame:
    named = benchmarks.select(F.col("benchmark").alias("ticker"), "conid", "industry")
    shape = ["ticker", "conid", "industry"]
    return (
        buys.select(*shape, F.lit("BUY").alias("action"))
        .unionByName(sells.select(*shape, F.lit("SELL").alias("action")))
        .unionByName(named.withColumn("action", F.lit(None).cast("string")))
    )


def universe_with_benchmarks(tickers: DataFrame, benchmarks: DataFrame) -> DataFrame:
    named = benchmarks.select(F.col("benchmark").alias("ticker"))
    return tickers.select("ticker").unionByName(named).where(F.col("ticker").isNotNull())


def prune_unsupported(financial: DataFrame, estimates: DataFrame) -> DataFrame:
    """Keep tickers with an estimates document that is not null."""
    known = estimates.where(F.col("estimates").isNotNull())
    return financial.drop("estimates").join(known.select("ticker", "estimates"), "ticker")
