"""Session features, benchmark features and screen columns."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom import constants as c
from barloom.catalog.ctes import r4, r6
from barloom.catalog.registry import fours, query, sixes
from barloom.functions import scalars as sf
from barloom.operators import features as ff
from barloom.operators import series

BAR = "ticker, date, open, high, low, close, volume, count"


@query("a05_volume_bounds", "SELECT ticker, max(volume) AS vol_max, min(volume) AS vol_min FROM daily GROUP BY 1")
def a05(spark, d):
    return ff.volume_bounds(b.daily(spark, d))


@query("x01_volume_delta", "SELECT ticker, date, volume_delta FROM prepared")
def x01(spark, d):
    bars = b.bars(spark, d)
    return ff.add_volume_delta(bars, ff.volume_bounds(bars)).select("ticker", "date", "volume_delta")


def _ranked(spark, d):
    return ff.add_day_columns(b.bars(spark, d), b.SPEC)


@query("w06_day_open", "SELECT ticker, date, day_open FROM prepared")
def w06(spark, d):
    return _ranked(spark, d).select("ticker", "date", "day_open")


@query("w07_open_delta", "SELECT ticker, date, open_delta FROM prepared")
def w07(spark, d):
    return _ranked(spark, d).select("ticker", "date", "open_delta")


@query("w08_day_max", "SELECT ticker, date, day_max FROM prepared")
def w08(spark, d):
    return _ranked(spark, d).select("ticker", "date", "day_max")


@query("w09_day_min", "SELECT ticker, date, day_min FROM prepared")
def w09(spark, d):
    return _ranked(spark, d).select("ticker", "date", "day_min")


@query("w10_prev_day_close", "SELECT ticker, date, prev_day_close FROM prepared")
def w10(spark, d):
    return ff.add_prev_day_close(_ranked(spark, d), b.SPEC).select("ticker", "date", "prev_day_close")


@query(
    "w10_prev_day_close_own",
    """SELECT ticker, date, coalesce(last_value(CASE WHEN rk = 12 THEN close END IGNORE NULLS) OVER
    (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), day_open) AS prev_day_close FROM ranked""",
)
def w10_own(spark, d):
    closed = ff.add_prev_day_close(_ranked(spark, d), b.SPEC, include_own_close=True)
    return closed.select("ticker", "date", "prev_day_close")


@query("w11_session_period", "SELECT ticker, date, session_period FROM prepared")
def w11(spark, d):
    return _ranked(spark, d).select("ticker", "date", "session_period")


@query("w21_prepare_features", f"SELECT {BAR}, day, day_open, day_max, day_min, session_period, open_delta, prev_day_close, volume_delta FROM prepared")
def w21(spark, d):
    return b.prepared(spark, d)


@query("session_period_summary", """SELECT ticker, session_period, CAST(sum(CAST(round(open_delta * 10000) AS BIGINT)) AS DOUBLE) / count(open_delta) / 10000 AS avg_open_delta,
    CAST(count(*) AS BIGINT) AS bars FROM prepared GROUP BY 1, 2""")
def flagship(spark, d):
    return ff.period_summary(b.prepared(spark, d))


# --- trailing windows: on daily bars, which span years ------------------------------


@query("w01_high_low_average", f"""SELECT ticker, date, {r4('(max(high) OVER w + min(low) OVER w) / 2')} AS high_low_average FROM daily
    WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""")
def w01(spark, d):
    rows = ff.high_low_average(b.daily(spark, d)).select("ticker", "date", "high_low_average")
    return fours(rows, "high_low_average")


@query("w02_row_number0", "SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS seq FROM daily")
def w02(spark, d):
    return series.number_rows(b.daily(spark, d)).select("ticker", "date", "seq")


@query("w03_sma", f"""SELECT ticker, date, {r4('avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW)')} AS fast_sma,
    {r4('avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 203 PRECEDING AND CURRENT ROW)')} AS slow_sma FROM daily""")
def w03(spark, d):
    averaged = ff.moving_averages(b.daily(spark, d), "close", {"fast_sma": c.FAST_SMA, "slow_sma": c.SLOW_SMA})
    return fours(averaged.select("ticker", "date", "fast_sma", "slow_sma"), "fast_sma", "slow_sma")


@query("w04_ema", f"SELECT ticker, date, {r6('fast_ema')} AS fast_ema, {r6('slow_ema')} AS slow_ema FROM emas")
def w04(spark, d):
    ranged = ff.high_low_average(b.bars(spark, d)).drop("seq", "_chunk")
    spans = {"fast_ema": c.FAST_EMA, "slow_ema": c.SLOW_EMA}
    both = series.exponential_averages(ranged, "high_low_average", spans)
    return sixes(both.select("ticker", "date", *spans), *spans)


@query("w05_benchmark_difference", f"SELECT ticker, date, {r6('difference')} AS difference FROM bench")
def w05(spark, d):
    averaged = ff.benchmark_averages(b.bars(spark, d))
    return sixes(averaged.select("ticker", "date", "difference"), "difference")


@query("w22_benchmark_features", f"SELECT ticker, date, {r6('difference')} AS benchmark_difference, open_delta AS benchmark_open_delta FROM bench")
def w22(spark, d):
    return sixes(ff.benchmark_features(b.bars(spark, d), "benchmark"), "benchmark_difference")


@query(
    "j01_attach_benchmarks",
    f"""SELECT p.ticker, p.date, {r6('b.difference')} AS benchmark_difference, b.open_delta AS benchmark_open_delta,
    {r6('m.difference')} AS spy_difference, m.open_delta AS spy_open_delta
    FROM bars p JOIN bench b ON b.ticker = 'view' AND b.date = p.date JOIN bench m ON m.ticker = 'click' AND m.date = p.date""",
)
def j01(spark, d):
    joined = ff.attach_benchmarks(
        b.bars(spark, d),
        b.members(spark, d),
        b.benchmark(spark, d, b.BENCHMARK, "benchmark"),
        b.benchmark(spark, d, b.MARKET, "spy"),
    )
    names = ["benchmark_difference", "benchmark_open_delta", "spy_difference", "spy_open_delta"]
    return sixes(joined.select("ticker", "date", *names), "benchmark_difference", "spy_difference")


@query("j02_benchmark_of", "SELECT t.ticker, t.industry, u.benchmark FROM trade_params t LEFT JOIN benchmark_utils u ON u.industry = t.industry")
def j02(spark, d):
    return ff.benchmark_of(b.trade_params(spark, d).select("ticker", "industry"), b.benchmark_utils(spark, d))


@query("p01_strategy_tag", """SELECT ticker, date, action, CASE WHEN (action = 'buy' AND close > prev_day_close) OR (action = 'sell' AND close < prev_day_close)
    THEN 'trend' ELSE 'correction' END AS strategy, close, prev_day_close FROM prepared, (VALUES ('buy'), ('sell')) a(action)""")
def p01(spark, d):
    actions = b.technical_params(spark, d).select(F.col("symbol").alias("ticker"), "action")
    return ff.with_actions(b.prepared(spark, d), actions).select("ticker", "date", "action", "strategy", "close", "prev_day_close")


# --- screen columns -----------------------------------------------------------------


def _screens(spark, d):
    return ff.screen_columns(b.daily(spark, d))


@query("w12_relative_volume", f"SELECT ticker, date, {r4('avg_volume')} AS avg_volume, {r4('relative_volume')} AS relative_volume FROM screen_cols")
def w12(spark, d):
    return fours(_screens(spark, d).select("ticker", "date", "avg_volume", "relative_volume"), "avg_volume", "relative_volume")


@query("w13_average_true_range", f"SELECT ticker, date, {r4('average_true_range')} AS average_true_range, {r4('change')} AS change FROM screen_cols")
def w13(spark, d):
    return fours(_screens(spark, d).select("ticker", "date", "average_true_range", "change"), "average_true_range", "change")


@query("w14_new_high_low", "SELECT ticker, date, new_high, new_low FROM screen_cols")
def w14(spark, d):
    return _screens(spark, d).select("ticker", "date", "new_high", "new_low")


@query("x10_precision_round", "SELECT event_id, floor(price * 100 + 0.5) / 100 AS two, floor(price * 10 + 0.5) / 10 AS one FROM ticks")
def x10(spark, d):
    price = F.col("close")
    return b.ticks(spark, d).select("event_id", sf.scaled_round(price, 2).alias("two"), sf.scaled_round(price, 1).alias("one"))


