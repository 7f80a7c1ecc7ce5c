"""Parameters, universe, gates, work-lists, screens and upserts of the master tables."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.ctes import DAILY_NOW, r2, r4, r6
from barloom.catalog.registry import fours, query, six
from barloom.operators import features as ff
from barloom.operators import params as pp
from barloom.operators import universe as uu
from barloom.sources import sinks

AGE = f"abs(floor((epoch({DAILY_NOW}) - epoch(date)) / 86400))"
KEY = "symbol, time_frame, strategy, action"
PARAMS = (
    "benchmark_negative, benchmark_positive, limit_price, limit_time, limit_trades, min_trail_percent, "
    "stop_trades, trail_percent, trail_time, high_delta, low_delta, low_stop, high_stop, spy"
)


def _now():
    return b.moment(b.DAILY_NOW)


# --- parameters ---------------------------------------------------------------------


@query("x06_parse_params_json", f"SELECT ticker AS symbol, 'minute' AS time_frame, strategy, action, performance, {PARAMS} FROM tp")
def x06(spark, d):
    return pp.parse_params(b.technical_params(spark, d))


@query("s02_scan_params", f"SELECT tp.ticker, strategy, action, performance, vol_max, vol_min, {PARAMS} FROM tp JOIN bounds ON bounds.ticker = tp.ticker")
def s02(spark, d):
    return b.bounded_params(spark, d)


@query("j03_params_join", "SELECT tp.ticker, strategy, action, vol_max, vol_min FROM tp JOIN bounds ON bounds.ticker = tp.ticker")
def j03(spark, d):
    return b.bounded_params(spark, d).select("ticker", "strategy", "action", "vol_max", "vol_min")


@query("j26_params_by_ticker", """SELECT ticker, action, max(limit_price) FILTER (WHERE strategy = 'trend') AS trend_limit, max(limit_price) FILTER (WHERE strategy = 'correction') AS correction_limit,
    max(trail_percent) FILTER (WHERE strategy = 'trend') AS trend_trail FROM tp GROUP BY 1, 2""")
def j26(spark, d):
    sides = pp.params_by_ticker(b.params(spark, d))
    return sides.select(
        "ticker",
        "action",
        F.col("trend.limit_price").alias("trend_limit"),
        F.col("correction.limit_price").alias("correction_limit"),
        F.col("trend.trail_percent").alias("trend_trail"),
    )


@query("j28_keyed_lookup", "SELECT d.ticker, d.date, d.close, t.industry, t.conid FROM daily d LEFT JOIN trade_params t ON t.ticker = d.ticker")
def j28(spark, d):
    known = b.trade_params(spark, d).select("ticker", "industry", "conid")
    rows = b.daily(spark, d).select("ticker", "date", "close")
    return pp.keyed_lookup(rows, known, ["ticker"], ["date"])


@query("p16_uses_benchmark_ml", """SELECT ticker, strategy, action, benchmark_positive IS NOT NULL AND benchmark_negative IS NOT NULL AS uses_benchmark,
    coalesce(high_delta, false) OR coalesce(low_delta, false) OR coalesce(high_stop, false) OR coalesce(low_stop, false) AS uses_ml FROM tp""")
def p16(spark, d):
    return b.params(spark, d).select(*pp.KEY, pp.uses_benchmark().alias("uses_benchmark"), pp.uses_ml().alias("uses_ml"))


@query("x07_trades_per_day", "SELECT ticker, strategy, action, coalesce(stop_trades * 3, 6) AS stop_rows, coalesce(limit_trades * 3, 3) AS limit_rows FROM tp")
def x07(spark, d):
    return b.params(spark, d).select(*pp.KEY, pp.stop_rows().alias("stop_rows"), pp.limit_rows().alias("limit_rows"))


SIDED = "CASE WHEN action = 'buy' THEN (1 - {0}) * 100 ELSE ({0} - 1) * 100 END"


@query("x08_trail_percent", f"SELECT ticker, strategy, action, coalesce({r2(SIDED.format('trail_percent'))}, 2.0::DOUBLE) AS trail, {r6(SIDED.format('min_trail_percent'))} AS min_trail FROM tp")
def x08(spark, d):
    action = F.col("action")
    return b.params(spark, d).select(*pp.KEY, pp.trail_percent(action).alias("trail"), six(pp.min_trail_percent(action)).alias("min_trail"))


@query("x09_limit_percent", """SELECT ticker, strategy, action, CASE WHEN length(ticker) = 6 THEN CASE WHEN action = 'buy' THEN 1.005::DOUBLE ELSE 0.995::DOUBLE END ELSE limit_price END AS limit_percent,
    CASE WHEN length(ticker) = 4 THEN 60 ELSE limit_time END AS limit_time, trail_time FROM tp""")
def x09(spark, d):
    rows = b.params(spark, d).withColumns(
        {
            "limit_price": F.when(F.length("ticker") != 6, F.col("limit_price")),
            "limit_time": F.when(F.length("ticker") != 4, F.col("limit_time")),
        }
    )
    return rows.select(*pp.KEY, pp.limit_percent(F.col("action")).alias("limit_percent"), pp.limit_minutes().alias("limit_time"), "trail_time")


# --- freshness, flags, sets ---------------------------------------------------------


@query("p06_fresh_tickers", f"SELECT ticker, date FROM trade_params WHERE {AGE} < 7")
def p06(spark, d):
    return uu.fresh_tickers(b.trade_params(spark, d), _now()).select("ticker", "date")


@query("p29_stale_estimate_tickers", f"SELECT ticker, date FROM trade_params WHERE date IS NULL OR {AGE} >= 7")
def p29(spark, d):
    return uu.stale_tickers(b.trade_params(spark, d), _now()).select("ticker", "date")


@query("p07_valid_tickers", f"""SELECT ticker, conid, industry FROM trade_params WHERE {AGE} < 7 AND day_trade_buy
    AND ticker IN (SELECT symbol FROM test_params WHERE performance AND time_frame = 'minute')""")
def p07(spark, d):
    return uu.valid_tickers(b.trade_params(spark, d), b.test_params(spark, d), "day_trade_buy", _now())


@query("j10_passed_backtest_semi", "SELECT ticker, industry FROM trade_params WHERE ticker IN (SELECT symbol FROM test_params WHERE performance AND time_frame = 'minute')")
def j10(spark, d):
    return uu.passed_backtest(b.trade_params(spark, d), b.test_params(spark, d)).select("ticker", "industry")


@query("p08_flagged_tickers", "SELECT ticker, industry FROM trade_params WHERE day_trade_sell AND ticker NOT IN (SELECT ticker FROM illiquid)")
def p08(spark, d):
    return uu.flagged_tickers(b.trade_params(spark, d), b.illiquid_list(spark, d), "day_trade_sell").select("ticker", "industry")


@query("j09_not_in_subquery", "SELECT ticker, date, close FROM daily WHERE ticker NOT IN (SELECT ticker FROM illiquid) AND ticker NOT IN (SELECT benchmark FROM benchmark_utils)")
def j09(spark, d):
    kept = uu.not_in(b.daily(spark, d), b.illiquid_list(spark, d).select("ticker"), b.benchmark_utils(spark, d).select("benchmark"))
    return kept.select("ticker", "date", "close")


@query("s16_scan_distinct_tickers", "SELECT DISTINCT ticker FROM daily WHERE ticker NOT IN (SELECT ticker FROM illiquid) AND ticker NOT IN (SELECT benchmark FROM benchmark_utils)")
def s16(spark, d):
    return uu.distinct_tickers(b.daily(spark, d), b.benchmark_utils(spark, d), b.illiquid_list(spark, d))


@query("p09_stale_for_load", f"""SELECT t.ticker, x.last_date FROM trade_params t LEFT JOIN (SELECT ticker, max(date) AS last_date FROM daily GROUP BY 1) x ON x.ticker = t.ticker
    WHERE last_date IS NULL OR last_date < {DAILY_NOW} - INTERVAL 1 DAY""")
def p09(spark, d):
    return uu.stale_for_load(b.trade_params(spark, d), b.daily(spark, d), _now(), days=1)


@query("p11_has_processing", "SELECT ticker, arg_max_null(CASE WHEN volume % 2 = 0 THEN prev_day_close END, date) IS NOT NULL AS processed FROM prepared GROUP BY 1")
def p11(spark, d):
    rows = b.prepared(spark, d)
    return uu.has_processing(rows.withColumn("prev_day_close", F.when(F.col("volume") % 2 == 0, F.col("prev_day_close"))))


@query("k08_ordered_tickers", "SELECT ticker, industry FROM trade_params ORDER BY ticker")
def k08(spark, d):
    return b.trade_params(spark, d).select("ticker", "industry").orderBy("ticker")


# --- back-test bookkeeping ----------------------------------------------------------

DUE = f"(date IS NULL OR epoch({DAILY_NOW}) - epoch(date) > 30 * 86400)"


@query("p10_needs_test", f"SELECT {KEY}, date FROM test_params WHERE {DUE}")
def p10(spark, d):
    return uu.needs_test(b.test_params(spark, d), _now())


@query("p28_last_test_date", f"SELECT {KEY}, date FROM test_params")
def p28(spark, d):
    return uu.last_test_date(b.test_params(spark, d))


@query("p26_backtest_metric", f"SELECT {KEY}, algo_period_return AS metric, 'algo' AS name FROM test_params UNION ALL SELECT {KEY}, beta, 'beta' FROM test_params UNION ALL SELECT {KEY}, portfolio_value_ml, 'portfolio_value_ml' FROM test_params")
def p26(spark, d):
    rows = b.test_params(spark, d)
    parts = [uu.backtest_metric(rows, n).withColumn("name", F.lit(n)) for n in ("algo", "beta", "portfolio_value_ml")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("p27_error_tickers", "SELECT ticker FROM failed")
def p27(spark, d):
    return uu.error_tickers(b.backtest_errors(spark, d))


@query("p27_not_in_error", "SELECT ticker, industry FROM trade_params WHERE ticker NOT IN (SELECT ticker FROM failed)")
def p27_not(spark, d):
    return uu.not_in(b.trade_params(spark, d), uu.error_tickers(b.backtest_errors(spark, d))).select("ticker", "industry")


PASSED = f"""SELECT p.symbol, p.time_frame, p.strategy, p.action, CASE WHEN n = 2 AND algo_period_return IS NOT NULL AND beta IS NOT NULL AND max_drawdown IS NOT NULL AND spy_period_return IS NOT NULL THEN
    algo_period_return > abs(max_drawdown) AND algo_period_return > 0.5 * spy_period_return * (CASE WHEN action = 'buy' THEN 1 ELSE -1 END) AND abs(beta) < 0.3 END AS passed
    FROM (SELECT *, count(combined_period_return) OVER (PARTITION BY symbol, time_frame, action) AS n FROM test_params) p"""


@query("a18_backtest_gate", PASSED)
def a18(spark, d):
    return uu.backtest_gate(b.test_params(spark, d))


@query("s21_set_backtest_flag", f"SELECT t.symbol, t.time_frame, t.strategy, t.action, coalesce(passed, performance) AS performance FROM test_params t JOIN ({PASSED}) x ON x.symbol = t.symbol AND x.strategy = t.strategy AND x.action = t.action")
def s21(spark, d):
    rows = b.test_params(spark, d)
    return uu.set_backtest_flag(rows, uu.backtest_gate(rows)).select(*uu.TEST_KEY, "performance")


@query("p30_performance_gate", f"SELECT {KEY}, coalesce(performance, false) AS performance FROM test_params")
def p30(spark, d):
    from barloom.operators.signals import performance_gate

    return performance_gate(b.test_params(spark, d)).select(*uu.TEST_KEY, "performance")


@query("k06_next_untested_symbol", "SELECT action, min(symbol) AS ticker FROM test_params WHERE combined_period_return IS NULL AND time_frame = 'minute' AND symbol NOT IN (SELECT ticker FROM illiquid) AND symbol NOT IN (SELECT ticker FROM errors) GROUP BY 1")
def k06(spark, d):
    return uu.next_untested_symbol(b.test_params(spark, d), b.illiquid_list(spark, d), b.backtest_errors(spark, d))


@query("k06_untested_symbols", "SELECT DISTINCT symbol AS ticker, action FROM test_params WHERE combined_period_return IS NULL AND time_frame = 'minute' AND symbol NOT IN (SELECT ticker FROM illiquid) AND symbol NOT IN (SELECT ticker FROM errors)")
def k06_all(spark, d):
    return uu.untested_symbols(b.test_params(spark, d), b.illiquid_list(spark, d), b.backtest_errors(spark, d))


@query("p31_backtest_worklist", f"""SELECT symbol AS ticker, action, strategy, variant FROM test_params, (VALUES ('plain'), ('benchmark'), ('ml'), ('combined')) v(variant)
    WHERE symbol NOT IN (SELECT ticker FROM failed) AND ({DUE} OR CASE variant WHEN 'plain' THEN portfolio_value IS NULL WHEN 'benchmark' THEN portfolio_value_benchmark IS NULL
      WHEN 'ml' THEN portfolio_value_ml IS NULL ELSE true END)""")
def p31(spark, d):
    return uu.backtest_worklist(b.test_params(spark, d), b.backtest_errors(spark, d), _now())


@query("u09_register_strategies", """SELECT ticker AS symbol, 'minute' AS time_frame, strategy, action FROM trade_params, (VALUES ('trend', 'buy'), ('trend', 'sell'), ('correction', 'buy'), ('correction', 'sell')) v(strategy, action)
    WHERE CASE WHEN action = 'buy' THEN day_trade_buy ELSE day_trade_sell END AND (ticker, strategy, action) NOT IN (SELECT (symbol, strategy, action) FROM test_params)""")
def u09(spark, d):
    return uu.register_strategies(b.trade_params(spark, d), b.test_params(spark, d))


# --- trade parameters ---------------------------------------------------------------


@query("a11_range_midpoint", f"SELECT ticker, {r4('range_midpoint')} AS range_midpoint, {r4('last_price')} AS last_price FROM midpoints")
def a11(spark, d):
    return fours(uu.range_midpoint(b.daily(spark, d)), "range_midpoint", "last_price")


@query("a12_drop_tickers_without_bars", "SELECT ticker, industry FROM trade_params WHERE ticker IN (SELECT ticker FROM daily)")
def a12(spark, d):
    return uu.drop_tickers_without_bars(b.trade_params(spark, d), b.daily(spark, d)).select("ticker", "industry")


@query("a13_direction_flags", "SELECT t.ticker, coalesce(day_trade_buy AND last_price > range_midpoint, false) AS day_trade_buy, coalesce(day_trade_sell AND last_price < range_midpoint, false) AS day_trade_sell FROM trade_params t LEFT JOIN midpoints m ON m.ticker = t.ticker")
def a13(spark, d):
    joined = b.trade_params(spark, d).join(uu.range_midpoint(b.daily(spark, d)), "ticker", "left")
    return uu.direction_flags(joined).select("ticker", "day_trade_buy", "day_trade_sell")


# --- screens ------------------------------------------------------------------------


def _screens(spark, d):
    columns = ff.screen_columns(b.daily(spark, d))
    market = columns.where(F.col("ticker") == b.MARKET_SUPPLIER)
    return uu.screen(columns, market, avg_volume=20, price=30)


@query("p23_screen", "SELECT ticker, date, screen FROM screens")
def p23(spark, d):
    return _screens(spark, d)


@query("u02_screen_union", "SELECT ticker, date, screen FROM screens")
def u02(spark, d):
    return _screens(spark, d)


@query("u03_new_tickers", "SELECT DISTINCT ticker FROM screens WHERE ticker NOT IN (SELECT ticker FROM illiquid)")
def u03(spark, d):
    return uu.new_tickers(_screens(spark, d), b.illiquid_list(spark, d))


@query("u03_flag_screened", """SELECT coalesce(k.ticker, s.ticker) AS ticker, k.date, CASE WHEN s.ticker IS NOT NULL THEN true ELSE k.day_trade END AS day_trade
    FROM (SELECT ticker, date, NULL::BOOLEAN AS day_trade FROM illiquid) k FULL JOIN (SELECT DISTINCT ticker FROM screens) s ON s.ticker = k.ticker""")
def u03_flag(spark, d):
    known = b.illiquid_list(spark, d).withColumn("day_trade", F.lit(None).cast("boolean"))
    return uu.flag_screened(known, _screens(spark, d), "day_trade")


@query("u04_all_tickers", "SELECT ticker FROM trade_params WHERE day_trade_buy UNION SELECT ticker FROM trade_params WHERE day_trade_sell UNION SELECT ticker FROM daily")
def u04(spark, d):
    params = b.trade_params(spark, d)
    return uu.all_tickers(params.where("day_trade_buy"), params.where("day_trade_sell"), b.daily(spark, d)).orderBy("ticker")


@query("u05_buy_sell_benchmarks", """SELECT ticker, conid, industry, 'BUY' AS action FROM trade_params WHERE day_trade_buy UNION ALL SELECT ticker, conid, industry, 'SELL' FROM trade_params WHERE day_trade_sell
    UNION ALL SELECT benchmark, conid, industry, NULL FROM benchmark_utils""")
def u05(spark, d):
    params = b.trade_params(spark, d)
    return uu.buy_sell_benchmarks(params.where("day_trade_buy"), params.where("day_trade_sell"), b.benchmark_utils(spark, d))


@query("u07_universe_with_benchmarks", "SELECT ticker FROM trade_params UNION ALL SELECT benchmark FROM benchmark_utils WHERE benchmark IS NOT NULL")
def u07(spark, d):
    return uu.universe_with_benchmarks(b.trade_params(spark, d), b.benchmark_utils(spark, d))


# --- upserts and updates ------------------------------------------------------------


@query("j24_trade_params_upsert", """SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(n.industry, o.industry) AS industry, coalesce(n.conid, o.conid) AS conid, o.date
    FROM (SELECT ticker, industry, conid, date FROM trade_params WHERE day_trade_buy) o
    FULL JOIN (SELECT ticker, CASE WHEN nation % 2 = 0 THEN lower(industry) END AS industry, conid + 1 AS conid FROM trade_params WHERE day_trade_sell) n ON n.ticker = o.ticker""")
def j24(spark, d):
    params = b.trade_params(spark, d)
    stored = params.where("day_trade_buy").select("ticker", "industry", "conid", "date")
    incoming = params.where("day_trade_sell").select(
        "ticker", F.when(F.col("nation") % 2 == 0, F.lower("industry")).alias("industry"), (F.col("conid") + 1).alias("conid")
    )
    return sinks.upsert(stored, incoming, ["ticker"])


@query("j24_illiquid_upsert", """SELECT coalesce(o.ticker, n.ticker) AS ticker, coalesce(n.date, o.date) AS date FROM illiquid o
    FULL JOIN (SELECT DISTINCT ticker, TIMESTAMP '2001-11-10 00:00:00' AS date FROM daily) n ON n.ticker = o.ticker""")
def j24_illiquid(spark, d):
    found = b.daily(spark, d).select("ticker").distinct().withColumn("date", _now())
    return sinks.upsert(b.illiquid_list(spark, d), found, ["ticker"])


@query("j25_partial_update", """SELECT ticker, CASE WHEN nation % 2 = 0 AND day_trade_sell THEN lower(industry) ELSE industry END AS industry, CASE WHEN day_trade_sell THEN conid + 1 ELSE conid END AS conid, date FROM trade_params""")
def j25(spark, d):
    params = b.trade_params(spark, d)
    updates = params.where("day_trade_sell").select(
        "ticker", F.when(F.col("nation") % 2 == 0, F.lower("industry")).alias("industry"), (F.col("conid") + 1).alias("conid")
    )
    return sinks.partial_update(params.select("ticker", "industry", "conid", "date"), updates, ["ticker"])


@query("s18_set_column", """SELECT b.ticker, b.date, CASE WHEN b.date = coalesce(u.date, x.newest) THEN u.value ELSE b.close END AS close FROM daily b
    JOIN (SELECT ticker, max(date) AS newest FROM daily GROUP BY 1) x ON x.ticker = b.ticker
    LEFT JOIN (SELECT ticker, CASE WHEN ticker % 2 = 0 THEN min(date) END AS date, -1.0::DOUBLE AS value FROM daily GROUP BY 1) u ON u.ticker = b.ticker""")
def s18(spark, d):
    from barloom.operators.bars import set_newest

    bars = b.daily(spark, d).select("ticker", "date", "close")
    updates = bars.groupBy("ticker").agg(F.min("date").alias("date")).select(
        "ticker", F.when(F.col("ticker") % 2 == 0, F.col("date")).alias("date"), F.lit(-1.0).alias("value")
    )
    return set_newest(bars, updates, "close")


@query("s19_attach_industry", "SELECT d.ticker, d.date, d.close, t.industry FROM daily d LEFT JOIN trade_params t ON t.ticker = d.ticker")
def s19(spark, d):
    return sinks.attach_industry(b.daily(spark, d).select("ticker", "date", "close"), b.trade_params(spark, d))
