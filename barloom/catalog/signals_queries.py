"""Entry conditions, position gate and bracket orders."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.registry import query
from barloom.functions import conditions as cond
from barloom.functions import scalars as sf
from barloom.operators import orders as oo
from barloom.operators import params as pp
from barloom.operators import signals as ss
from barloom.operators.features import strategy_of
from barloom.operators.series import spread_join

ORDER = "date, ticker, order_type, trailing_percent, ib_id, action, last_close, oca_group, signal_id, conid"


def _acted(spark, d):
    allowed = ss.permissions(b.params(spark, d))
    sides = b.technical_params(spark, d).select(F.col("symbol").alias("ticker"), "action").distinct()
    sides = sides.groupBy("ticker").agg(F.collect_set("action").alias("_actions"))
    rows = spread_join(b.live_bars(spark, d), sides, ["ticker"], ["date"]).withColumn("action", F.explode("_actions"))
    return pp.attach_params(rows.withColumn("strategy", strategy_of(F.col("action"))), allowed)


def _condition(spark, d, condition):
    return _acted(spark, d).select("ticker", "date", "action", "strategy", condition.alias("met"))


@query("p12_breakaway_signal", "SELECT ticker, date, action, strategy, breakaway AS met FROM conditions")
def p12(spark, d):
    return _condition(spark, d, cond.breakaway_signal())


@query("p13_trend_ml_condition", "SELECT ticker, date, action, strategy, trend_ml AS met FROM conditions")
def p13(spark, d):
    return _condition(spark, d, cond.trend_ml_condition())


@query("p14_correction_ml_condition", "SELECT ticker, date, action, strategy, correction_ml AS met FROM conditions")
def p14(spark, d):
    return _condition(spark, d, cond.correction_ml_condition())


@query("p15_benchmark_condition", "SELECT ticker, date, action, strategy, with_benchmark AS met FROM conditions")
def p15(spark, d):
    return _condition(spark, d, cond.benchmark_condition())


@query("a19_positions_per_ticker_day", "SELECT ticker, day, orders, limit_orders, stop_orders, positions FROM day_state")
def a19(spark, d):
    return ss.positions_per_day(b.day_orders(spark, d))


@query("w19_dense_bracket_rank", "SELECT ticker, day, market_fill, limit_fill, stop_fill FROM last_pos")
def w19(spark, d):
    return ss.last_position(b.day_orders(spark, d))


@query("o02_position_gate", "SELECT ticker, day, since, action, strategy, positions, blocked FROM gate")
def o02(spark, d):
    return ss.position_gate(b.day_orders(spark, d), b.params(spark, d))


@query(
    "p17_entry_signal",
    """SELECT c.ticker, c.date, c.action, c.strategy, c.close FROM conditions c LEFT JOIN bar_gate g ON g.ticker = c.ticker AND g.date = c.date AND g.action = c.action AND g.strategy = c.strategy
    WHERE performance AND NOT coalesce(blocked, false) AND breakaway AND (c.benchmark_negative IS NULL OR c.benchmark_positive IS NULL OR with_benchmark)
      AND (NOT (coalesce(allow_high_delta, false) OR coalesce(allow_low_delta, false) OR coalesce(allow_high_stop, false) OR coalesce(allow_low_stop, false))
        OR CASE WHEN c.strategy = 'trend' THEN trend_ml ELSE correction_ml END)""",
)
def p17(spark, d):
    states = ss.states_by_hour(ss.order_states(b.day_orders(spark, d)))
    return ss.entry_signals(b.live_bars(spark, d), b.params(spark, d), states)


@query("o01_bracket_orders", f"SELECT {ORDER}, sec_type, tif FROM brackets")
def o01(spark, d):
    return b.brackets(spark, d)


@query("o07_stop_profit_or_loss", """SELECT ib_id, CASE WHEN fill_price IS NOT NULL THEN CASE WHEN (action = 'SELL' AND fill_price > entry_price) OR (action = 'BUY' AND fill_price < entry_price) THEN 'profit' ELSE 'loss' END END AS result
    FROM entries WHERE order_type = 'STOP LOSS'""")
def o07(spark, d):
    stops = oo.of_type(oo.with_entry(b.day_orders(spark, d)), "STOP LOSS")
    side = F.when(F.col("action") == "SELL", F.lit("BUY")).otherwise(F.lit("SELL"))
    return stops.select("ib_id", ss.stop_result(side, F.col("fill_price"), F.col("entry_price")).alias("result"))


@query("j15_fill_lookup", "SELECT ib_id, oca_group, entry_price, entry_date FROM entries")
def j15(spark, d):
    return oo.with_entry(b.day_orders(spark, d)).select("ib_id", "oca_group", "entry_price", "entry_date")


NOW = "TIMESTAMP '2024-01-16 12:00:00'"
LAST = f"(SELECT ticker, arg_max(close, date) AS last_price, arg_max_null(low_stop, date) AS low_stop, arg_max_null(high_stop, date) AS high_stop FROM livebars WHERE date <= {NOW} GROUP BY 1)"
EXIT = f"""FROM (SELECT e.*, CASE WHEN action = 'BUY' THEN 'sell' ELSE 'buy' END AS side FROM entries e WHERE ib_status IS NULL AND date <= {NOW}) o
  JOIN tp ON tp.ticker = o.ticker AND tp.strategy = o.signal_id AND tp.action = o.side LEFT JOIN {LAST} l ON l.ticker = o.ticker"""
TRAIL = "coalesce(floor((CASE WHEN side = 'buy' THEN (1 - trail_percent) * 100 ELSE (trail_percent - 1) * 100 END) * 1e2 + 0.5) / 1e2, 2.0)"


@query(
    "o03_adjust_stops",
    f"""SELECT ib_id, o.ticker, trailing_percent, CASE WHEN entry_price IS NULL THEN NULL
      WHEN CASE WHEN o.action = 'SELL' THEN (last_price = 0 AND entry_price > 0) OR entry_price / nullif(last_price, 0) > 1 + {TRAIL} / 100 / 2 ELSE (entry_price = 0 AND last_price > 0) OR last_price / nullif(entry_price, 0) > 1 + {TRAIL} / 100 / 2 END THEN 0.1::DOUBLE
      WHEN floor((epoch(TIMESTAMP '2024-01-16 12:00:00') - epoch(o.date)) / 60) > trail_time
        AND trailing_percent > CASE WHEN side = 'buy' THEN (1 - min_trail_percent) * 100 ELSE (min_trail_percent - 1) * 100 END / 100 THEN trailing_percent * 0.5 END AS new_trailing
    {EXIT} WHERE order_type = 'STOP LOSS'""",
)
def o03(spark, d):
    # the test parameters keep stops wide: their minimum counts in hundredths
    params = b.params(spark, d).withColumn("min_trail_percent", 1 + (F.col("min_trail_percent") - 1) / 100)
    now = b.moment("2024-01-16 12:00:00")
    return oo.adjust_stops(b.day_orders(spark, d), b.live_bars(spark, d), params, now, F.lit(True))


@query("o03_adjust_stops_after_hours", "SELECT ib_id, ticker, trailing_percent, 0.1::DOUBLE AS new_trailing FROM dto WHERE order_type = 'STOP LOSS' AND ib_status IS NULL")
def o03_after(spark, d):
    now = b.moment(b.EVENTS_NOW)
    return oo.adjust_stops(b.day_orders(spark, d), b.live_bars(spark, d), b.params(spark, d), now, F.lit(False))


@query(
    "o04_adjust_limits",
    f"""SELECT ib_id, ticker, trailing_percent, CASE
      WHEN CASE WHEN action = 'SELL' THEN last_price > entry_price ELSE last_price < entry_price END AND floor((epoch(TIMESTAMP '2024-01-16 12:00:00') - epoch(entry_date)) / 60) > limit_time THEN near
      WHEN CASE WHEN action = 'SELL' THEN high_stop ELSE low_stop END THEN near
      WHEN right_price IS DISTINCT FROM trailing_percent AND entry_price IS NOT NULL THEN right_price END AS new_limit
    FROM (SELECT ib_id, o.ticker, o.action, trailing_percent, entry_price, entry_date, last_price, limit_time, l.high_stop, l.low_stop,
      floor(last_price * (CASE WHEN o.action = 'SELL' THEN 1.001::DOUBLE ELSE 0.999::DOUBLE END) * 1e2 + 0.5) / 1e2 AS near,
      floor(entry_price * (CASE WHEN o.action = 'SELL' THEN limit_price ELSE 1 - (limit_price - 1) END) * 1e2 + 0.5) / 1e2 AS right_price
    {EXIT} WHERE order_type = 'TAKE PROFIT')""",
)
def o04(spark, d):
    now = b.moment("2024-01-16 12:00:00")
    return oo.adjust_limits(b.day_orders(spark, d), b.live_bars(spark, d), b.params(spark, d), now)


@query("t07_expire_market_orders", "SELECT ib_id, CASE WHEN order_type = 'MKT' AND ib_status IS NULL AND date < TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 60 SECOND THEN 'expired' ELSE ib_status END AS ib_status FROM dto")
def t07(spark, d):
    expired = oo.expire_market_orders(b.day_orders(spark, d), b.moment("2024-01-16 12:00:00"))
    return expired.select("ib_id", "ib_status")


@query("k05_max_order_id_today", "SELECT day, max(ib_id) AS last_id FROM dto GROUP BY 1")
def k05(spark, d):
    return oo.max_order_id(b.day_orders(spark, d))


@query("a22_tickers_with_orders_today", "SELECT DISTINCT ticker, day FROM dto")
def a22(spark, d):
    return oo.tickers_with_orders(b.day_orders(spark, d)).orderBy("day", "ticker")


@query("w18_latest_three_orders", "SELECT ticker, day, ib_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY date DESC, ib_id DESC) AS rank FROM dto WHERE ib_status IS NULL) WHERE rank <= 3")
def w18(spark, d):
    return oo.latest_three_orders(b.day_orders(spark, d)).select("ticker", "day", "ib_id", "rank")


@query("p25_orders_today", """SELECT ticker, day, ib_id, 'signal' AS variant FROM newest3 UNION ALL SELECT ticker, day, ib_id, 'type' FROM dto
    UNION ALL SELECT ticker, day, ib_id, 'only_type' FROM dto WHERE order_type = 'STOP LOSS' UNION ALL SELECT ticker, day, ib_id, 'ticker' FROM dto WHERE signal_id = 'trend'""")
def p25(spark, d):
    orders = b.day_orders(spark, d)
    match = {"signal": {}, "type": {}, "only_type": {"order_type": "STOP LOSS"}, "ticker": {"signal_id": "trend"}}
    parts = [
        oo.orders_today(orders, variant, **fields).select("ticker", "day", "ib_id", F.lit(variant).alias("variant"))
        for variant, fields in match.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("p19_working_orders", "SELECT ib_id, order_type FROM dto WHERE ib_status IS NULL AND order_type IN ('STOP LOSS', 'TAKE PROFIT')")
def p19(spark, d):
    working = oo.working_orders(b.day_orders(spark, d))
    return oo.of_type(working, "STOP LOSS").unionByName(oo.of_type(working, "TAKE PROFIT")).select("ib_id", "order_type")


@query("p20_route_by_order_type", """SELECT CAST(ib_id AS BIGINT) AS id, order_type, CASE order_type WHEN 'MKT' THEN 'market' WHEN 'STOP LOSS' THEN 'stop' ELSE 'limit' END AS route FROM dto
    UNION ALL SELECT instruction_id, order_type, CASE order_type WHEN 'MKT' THEN 'market' WHEN 'STP' THEN 'stop' ELSE 'limit' END FROM ins""")
def p20(spark, d):
    both = b.day_orders(spark, d).select(F.col("ib_id").alias("id"), "order_type").unionByName(
        b.instructions(spark, d).select(F.col("instruction_id").alias("id"), "order_type")
    )
    return oo.route_by_order_type(both)


@query("s20_order_updates", """SELECT o.ib_id, CASE WHEN u.new_date IS NULL AND u.status IS NOT NULL THEN u.status ELSE o.ib_status END AS ib_status,
    CASE WHEN u.new_date IS NOT NULL THEN u.new_trailing ELSE o.trailing_percent END AS trailing_percent, coalesce(u.new_date, o.date) AS date FROM dto o
    LEFT JOIN (SELECT signal_no * 3 + 1 + k % 3 AS ib_id, CASE WHEN k % 2 = 0 THEN 'expired' END AS status, CASE WHEN k % 2 = 1 THEN date + INTERVAL 1 MINUTE END AS new_date,
      CASE WHEN k % 2 = 1 THEN 0.1::DOUBLE END AS new_trailing FROM signals) u ON u.ib_id = o.ib_id""")
def s20(spark, d):
    k, odd = F.col("k"), F.col("k") % 2 == 1
    updates = b.order_signals(spark, d).select(
        (F.col("signal_no") * 3 + 1 + k % 3).alias("ib_id"),
        F.when(~odd, F.lit("expired")).alias("status"),
        F.lit(None).cast("double").alias("traded_price"),
        F.when(odd, F.col("date") + F.expr("INTERVAL 1 MINUTE")).alias("new_date"),
        F.when(odd, F.lit(0.1)).alias("new_trailing"),
        F.col("date").alias("event_time"),
    )
    return oo.apply_order_updates(b.day_orders(spark, d), updates).select("ib_id", "ib_status", "trailing_percent", "date")


ACCOUNT = oo.Account("DU1", 5_000_000.0, 2)
QTY = """(SELECT d.*, quantity, shares FROM (SELECT d.*, CASE WHEN d.action = 'BUY' THEN 5000.0::DOUBLE / nullif(last_close - last_close * coalesce(trail_percent, 0.98::DOUBLE), 0)
      ELSE 5000.0::DOUBLE / nullif(last_close * coalesce(1 + (1 - trail_percent), 1.02::DOUBLE) - last_close, 0) END AS shares FROM dto d
      JOIN tp ON tp.ticker = d.ticker AND tp.strategy = d.signal_id AND tp.action = lower(d.action) WHERE order_type = 'MKT' AND d.date < TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 30 SECOND) d,
      LATERAL (SELECT CAST(trunc(shares) * 2 AS BIGINT) AS quantity))"""


@query("x14_calculate_quantity", f"SELECT ib_id, quantity FROM {QTY}")
def x14(spark, d):
    opened = oo.open_orders_to_instructions(b.day_orders(spark, d), b.params(spark, d), ACCOUNT, b.moment("2024-01-16 12:00:00"))
    return opened.select(F.col("cll_int_id").alias("ib_id"), "quantity")


OPENED = f"SELECT 'DU1' AS account, ib_id AS cll_int_id, ticker AS symbol, action AS buy_or_sell, 'open stock' AS signal_id, 'MKT' AS order_type, quantity, NULL::DOUBLE AS limit_price, NULL::DOUBLE AS stop_price, oca_group, date FROM {QTY}"


@query(
    "o05_make_instructions",
    f"""{OPENED} UNION ALL SELECT 'DU1', d.ib_id, d.ticker, d.action, 'close stock', CASE WHEN d.order_type = 'TAKE PROFIT' THEN 'LMT' ELSE 'STP' END, q.quantity,
    CASE WHEN d.order_type = 'TAKE PROFIT' THEN d.trailing_percent END, CASE WHEN d.order_type = 'STOP LOSS' THEN d.trailing_percent END, d.oca_group, d.date
    FROM dto d JOIN {QTY} q ON q.oca_group = d.oca_group WHERE d.order_type <> 'MKT'""",
)
def o05(spark, d):
    made = oo.make_instructions(b.day_orders(spark, d), b.params(spark, d), ACCOUNT, b.moment("2024-01-16 12:00:00"))
    return made.select("account", "cll_int_id", "symbol", "buy_or_sell", "signal_id", "order_type", "quantity", "limit_price", "stop_price", "oca_group", "date")


@query("j20_quantity_lookup", f"SELECT oca_group, 'DU1' AS account, CAST(date AS DATE) AS day, quantity AS open_quantity FROM {QTY}")
def j20(spark, d):
    opened = oo.open_orders_to_instructions(b.day_orders(spark, d), b.params(spark, d), ACCOUNT, b.moment("2024-01-16 12:00:00"))
    return oo.open_quantities(opened)


@query("x22_limit_price", "SELECT ib_id, trailing_percent AS price FROM brackets WHERE order_type = 'TAKE PROFIT'")
def x22(spark, d):
    keyed = pp.attach_params(b.order_signals(spark, d).withColumnRenamed("side", "action"), b.params(spark, d))
    price = sf.scaled_round(F.col("last_close") * pp.limit_percent(F.col("action")), 2)
    return keyed.select((F.col("signal_no") * 3 + 3).alias("ib_id"), price.alias("price"))


