"""SQL forms of the bindings, for the oracle."""

from __future__ import annotations

import re


def r6(x: str) -> str:
    return f"(floor(({x}) * 1e6 + 0.5) / 1e6)"


def r4(x: str) -> str:
    return f"(floor(({x}) * 1e4 + 0.5) / 1e4)"


def r2(x: str) -> str:
    return f"(floor(({x}) * 1e2 + 0.5) / 1e2)"


def half_up(x: str, digits: int) -> str:
    """Rounding on the shortest decimal text, as Spark's round does."""
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38,20)), {digits}) AS DOUBLE)"


def _bars(width: str) -> str:
    return f"""SELECT event_type AS ticker, time_bucket(INTERVAL '{width}', ts) AS date,
      arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
      arg_max(value, ts) AS close, CAST(count(*) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS count
    FROM events GROUP BY 1, 2"""


EVENTS_NOW = "TIMESTAMP '2024-01-31 00:00:00'"
DAILY_NOW = "TIMESTAMP '2001-11-10 00:00:00'"
ORDERS_NOW = "TIMESTAMP '2001-08-02 00:00:00'"
MAXD = "1.7976931348623157e308"

CTES = {
    "ticks": """SELECT event_type AS ticker, ts, value AS price, event_id, user_id,
      CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events""",
    "bars": _bars("2 hours"),
    "bars30": _bars("30 minutes"),
    "minutes": _bars("1 minute"),
    "bounds": "SELECT ticker, max(volume) AS vol_max, min(volume) AS vol_min FROM bars GROUP BY 1",
    "day_counts": "SELECT ticker, CAST(date AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM bars GROUP BY 1, 2",
    "day_counts30": "SELECT ticker, CAST(date AS DATE) AS day, CAST(count(*) AS BIGINT) AS n FROM bars30 GROUP BY 1, 2",
    "grid30": """SELECT ticker, day, CAST(day AS TIMESTAMP) + INTERVAL '30 minutes' * g.range AS date
      FROM (SELECT ticker, day FROM day_counts30 WHERE n <> 48) d, range(48) g""",
    "missing30": "SELECT * FROM grid30 m WHERE NOT EXISTS (SELECT 1 FROM bars30 b WHERE b.ticker = m.ticker AND b.date = m.date)",
    "sessions": """SELECT CAST(g.range AS DATE) AS day, g.range + INTERVAL '870 minutes' AS opens,
        g.range + INTERVAL 1 HOUR * CASE WHEN CAST(g.range AS DATE) = DATE '2024-01-19' THEN 18 ELSE 21 END AS closes
      FROM range(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-01', INTERVAL 1 DAY) g
      WHERE isodow(g.range) < 6 AND CAST(g.range AS DATE) NOT IN (DATE '2024-01-01', DATE '2024-01-15')""",
    "session_bars30": "SELECT b.*, s.day FROM bars30 b JOIN sessions s ON b.date >= s.opens AND b.date < s.closes",
    "session_grid30": """SELECT t.ticker, s.day, s.opens + INTERVAL '30 minutes' * g.range AS date
      FROM (SELECT DISTINCT ticker, day FROM session_bars30) t JOIN sessions s ON s.day = t.day, range(13) g
      WHERE s.opens + INTERVAL '30 minutes' * g.range < s.closes""",
    "session_missing30": "SELECT * FROM session_grid30 m WHERE NOT EXISTS (SELECT 1 FROM bars30 b WHERE b.ticker = m.ticker AND b.date = m.date)",
    "ranked": """SELECT *, CAST(date AS DATE) AS day, row_number() OVER d AS rk, first_value(open) OVER d AS day_open,
      max(high) OVER r AS day_max, min(low) OVER r AS day_min FROM bars
      WINDOW d AS (PARTITION BY ticker, CAST(date AS DATE) ORDER BY date),
        r AS (PARTITION BY ticker, CAST(date AS DATE) ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "prepared": f"""SELECT ranked.ticker, date, open, high, low, close, volume, count, day, day_open, day_max, day_min, rk,
      CAST(least(ceil(rk / 2.0), 6) AS INTEGER) AS session_period, {half_up('close / nullif(day_open, 0)', 4)} AS open_delta,
      coalesce(last_value(CASE WHEN rk = 12 THEN close END IGNORE NULLS) OVER
        (PARTITION BY ranked.ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), day_open) AS prev_day_close,
      {half_up('(volume - vol_min) / (vol_max - vol_min)', 3)} AS volume_delta
      FROM ranked JOIN bounds ON bounds.ticker = ranked.ticker""",
    "numbered": """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS seq,
      (max(high) OVER w + min(low) OVER w) / 2 AS hla FROM bars
      WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)""",
    "averaged": """SELECT *, avg(hla) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 17 PRECEDING AND CURRENT ROW) AS fast_sma,
      avg(hla) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 203 PRECEDING AND CURRENT ROW) AS slow_sma FROM numbered""",
    "emas": """SELECT t.ticker AS ticker, t.date AS date,
      sum(pow(1 - 2.0::DOUBLE / 127, t.seq - i.seq) * i.hla) / sum(pow(1 - 2.0::DOUBLE / 127, t.seq - i.seq)) AS fast_ema,
      sum(pow(1 - 2.0::DOUBLE / 331, t.seq - i.seq) * i.hla) / sum(pow(1 - 2.0::DOUBLE / 331, t.seq - i.seq)) AS slow_ema
      FROM numbered t JOIN numbered i ON i.ticker = t.ticker AND i.seq <= t.seq GROUP BY 1, 2""",
    "bench": f"""SELECT a.ticker AS ticker, a.date AS date, fast_sma - slow_sma - (fast_ema - slow_ema) AS difference,
      {half_up('a.close / nullif(first_value(a.open) OVER (PARTITION BY a.ticker, CAST(a.date AS DATE) ORDER BY a.date), 0)', 4)} AS open_delta
      FROM averaged a JOIN emas e ON e.ticker = a.ticker AND e.date = a.date""",
    "tp": """SELECT ticker, strategy, action, length(ticker) AS size,
        CASE WHEN length(ticker) <> 6 THEN CAST(length(ticker) AS DOUBLE) * (CASE WHEN action = 'buy' THEN -1 ELSE 1 END) END AS benchmark_negative,
        CASE WHEN length(ticker) <> 6 THEN CAST(length(ticker) AS DOUBLE) * (CASE WHEN action = 'buy' THEN 1 ELSE -1 END) END AS benchmark_positive,
        CAST(CASE strategy || action WHEN 'trendbuy' THEN 6.0 WHEN 'trendsell' THEN 0.5 WHEN 'correctionbuy' THEN 8.0 ELSE 0.7 END AS DOUBLE) AS limit_price,
        60 AS limit_time, CASE WHEN length(ticker) <> 4 THEN 1 END AS limit_trades,
        CAST(CASE strategy || action WHEN 'trendbuy' THEN 0.6 WHEN 'trendsell' THEN 1.6 WHEN 'correctionbuy' THEN 0.7 ELSE 1.4 END AS DOUBLE) AS min_trail_percent,
        CASE WHEN length(ticker) <> 5 THEN 2 END AS stop_trades,
        CASE WHEN length(ticker) <> 8 THEN CAST(CASE strategy || action WHEN 'trendbuy' THEN 0.98 WHEN 'trendsell' THEN 1.02
          WHEN 'correctionbuy' THEN 0.97 ELSE 1.03 END AS DOUBLE) END AS trail_percent,
        30 AS trail_time,
        CASE WHEN length(ticker) <> 4 THEN action = 'buy' END AS high_delta, CASE WHEN length(ticker) <> 4 THEN action <> 'buy' END AS low_delta,
        CASE WHEN length(ticker) <> 4 THEN (strategy = 'trend') <> (action = 'buy') END AS low_stop,
        CASE WHEN length(ticker) <> 4 THEN (strategy = 'trend') = (action = 'buy') END AS high_stop,
        length(ticker) = 5 AS spy, length(ticker) <> 6 AS performance
      FROM (SELECT DISTINCT event_type AS ticker FROM events) t, (VALUES ('trend'), ('correction')) s(strategy), (VALUES ('buy'), ('sell')) a(action)""",
    "feats": """SELECT p.*, b.difference AS benchmark_difference, b.open_delta AS benchmark_open_delta,
        m.difference AS spy_difference, m.open_delta AS spy_open_delta, a.action,
        CASE WHEN (a.action = 'buy' AND close > prev_day_close) OR (a.action = 'sell' AND close < prev_day_close)
          THEN 'trend' ELSE 'correction' END AS strategy
      FROM prepared p JOIN bench b ON b.ticker = 'view' AND b.date = p.date JOIN bench m ON m.ticker = 'click' AND m.date = p.date,
        (VALUES ('buy'), ('sell')) a(action)""",
    "labelled": """SELECT f.*, tp.benchmark_negative, tp.benchmark_positive, tp.limit_price, tp.min_trail_percent, tp.spy,
        CASE WHEN f.action = 'buy' THEN coalesce(day_max / nullif(close, 0) > limit_price, false) END AS high_delta,
        coalesce(CASE WHEN f.action = 'buy' THEN day_max / nullif(close, 0) < 1.0005 ELSE day_max / nullif(close, 0) < min_trail_percent END, false) AS high_stop,
        CASE WHEN f.action = 'sell' THEN coalesce(close / nullif(day_min, 0) > 1 - limit_price + 1, false) END AS low_delta,
        coalesce(CASE WHEN f.action = 'buy' THEN close / nullif(day_min, 0) < 1 - min_trail_percent + 1 ELSE close / nullif(day_min, 0) < 1.0005 END, false) AS low_stop,
        CASE WHEN tp.spy THEN spy_difference ELSE benchmark_difference END AS difference,
        CASE WHEN tp.spy THEN spy_open_delta ELSE benchmark_open_delta END AS benchmark_delta
      FROM feats f JOIN tp ON tp.ticker = f.ticker AND tp.action = f.action AND tp.strategy = f.strategy""",
    "coarse": "SELECT * REPLACE (floor(open_delta * 2) / 2 AS open_delta, floor(benchmark_delta * 2) / 2 AS benchmark_delta, floor(volume_delta * 10) / 10 AS volume_delta) FROM labelled",
    "banded": """SELECT * FROM coarse WHERE benchmark_negative IS NULL OR benchmark_positive IS NULL OR
      CASE WHEN strategy = 'trend' THEN
        difference BETWEEN least(benchmark_negative, benchmark_positive) AND greatest(benchmark_negative, benchmark_positive)
      ELSE NOT (difference BETWEEN least(benchmark_negative, benchmark_positive) AND greatest(benchmark_negative, benchmark_positive)) END""",
    "rep1": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker, action, strategy, session_period, volume_delta) AS n1 FROM banded) WHERE n1 >= 2""",
    "rep2": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker, action, strategy, session_period, open_delta) AS n2 FROM rep1) WHERE n2 >= 2""",
    "rep3": """SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ticker, action, strategy, session_period, benchmark_delta) AS n3 FROM rep2) WHERE n3 >= 2""",
    "matrix": """SELECT * FROM (VALUES ('trend', 'buy', 'high_delta'), ('trend', 'buy', 'high_stop'), ('trend', 'sell', 'low_delta'),
      ('trend', 'sell', 'low_stop'), ('correction', 'buy', 'high_delta'), ('correction', 'buy', 'low_stop'),
      ('correction', 'sell', 'low_delta'), ('correction', 'sell', 'high_stop')) m(strategy, action, label)""",
    "longrows": """SELECT l.ticker, l.action, l.strategy, session_period, date, volume_delta, open_delta, benchmark_delta, m.label,
        CASE m.label WHEN 'high_delta' THEN high_delta WHEN 'low_delta' THEN low_delta WHEN 'high_stop' THEN high_stop ELSE low_stop END AS value
      FROM coarse l JOIN matrix m ON m.strategy = l.strategy AND m.action = l.action""",
    "conflicts": """SELECT ticker, action, strategy, session_period, label, open_delta, benchmark_delta, CAST(count(*) AS BIGINT) AS n FROM longrows
      GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT value) > 1""",
    "signals": """SELECT ts AS date, ticker, CASE WHEN k % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
      CASE WHEN price > 40 THEN 'trend' ELSE 'correction' END AS strategy, price AS last_close, event_id AS signal_no, user_id AS conid, k FROM ticks""",
    "brackets": f"""SELECT s.date, s.ticker, 'STK' AS sec_type, l.order_type, CASE l.step
        WHEN 2 THEN coalesce({r2("CASE WHEN side = 'buy' THEN (1 - trail_percent) * 100 ELSE (trail_percent - 1) * 100 END")}, 2.0)
        WHEN 3 THEN {r2('last_close * limit_price')} END AS trailing_percent, 'DAY' AS tif,
        signal_no * 3 + l.step AS ib_id,
        CASE WHEN (side = 'buy') = (l.step = 1) THEN 'BUY' ELSE 'SELL' END AS action, last_close,
        s.ticker || '_' || signal_no AS oca_group, s.strategy AS signal_id, conid
      FROM signals s JOIN tp ON tp.ticker = s.ticker AND tp.strategy = s.strategy AND tp.action = s.side,
        (VALUES (1, 'MKT'), (2, 'STOP LOSS'), (3, 'TAKE PROFIT')) l(step, order_type)""",
    "dto": """SELECT *, CASE WHEN order_type = 'MKT' THEN last_close
        WHEN order_type = 'STOP LOSS' AND CAST(floor(last_close * 100) AS BIGINT) % 4 = 1 THEN last_close * 0.99::DOUBLE
        WHEN order_type = 'TAKE PROFIT' AND CAST(floor(last_close * 100) AS BIGINT) % 4 = 2 THEN last_close * 1.01::DOUBLE END AS fill_price,
        CASE WHEN order_type = 'MKT' THEN CASE WHEN CAST(floor(last_close * 100) AS BIGINT) % 4 <> 3 THEN 'filled' END
        WHEN order_type = 'STOP LOSS' AND CAST(floor(last_close * 100) AS BIGINT) % 4 = 1 THEN 'filled'
        WHEN order_type = 'TAKE PROFIT' AND CAST(floor(last_close * 100) AS BIGINT) % 4 = 2 THEN 'filled' END AS ib_status,
        CAST(date AS DATE) AS day
      FROM brackets""",
    "entries": """SELECT o.*, e.fill_price AS entry_price, e.date AS entry_date FROM dto o
      LEFT JOIN (SELECT oca_group, fill_price, date FROM dto WHERE order_type = 'MKT') e ON e.oca_group = o.oca_group""",
    "livebars": """SELECT *, close > open AS buy_signal, close < open AS sell_signal,
        CASE WHEN volume % 3 <> 0 THEN volume % 2 = 1 END AS high_delta, CASE WHEN volume % 3 <> 0 THEN volume % 2 <> 1 END AS low_delta,
        CASE WHEN volume % 3 <> 1 THEN volume % 2 = 1 END AS high_stop, CASE WHEN volume % 3 <> 1 THEN volume % 2 <> 1 END AS low_stop,
        CASE WHEN volume % 3 <> 2 THEN volume % 4 <> 0 END AS benchmark_trend FROM prepared""",
    "acted": """SELECT l.ticker, l.date, l.day, a.action, l.close, l.prev_day_close, l.buy_signal, l.sell_signal, l.high_delta, l.low_delta,
        l.high_stop, l.low_stop, l.benchmark_trend, tp.strategy, tp.performance, tp.benchmark_negative, tp.benchmark_positive,
        tp.high_delta AS allow_high_delta, tp.low_delta AS allow_low_delta, tp.high_stop AS allow_high_stop, tp.low_stop AS allow_low_stop
      FROM livebars l, (VALUES ('buy'), ('sell')) a(action) JOIN tp ON tp.ticker = l.ticker AND tp.action = a.action AND tp.strategy =
        CASE WHEN (a.action = 'buy' AND close > prev_day_close) OR (a.action = 'sell' AND close < prev_day_close) THEN 'trend' ELSE 'correction' END""",
    "conditions": """SELECT *, CASE WHEN action = 'buy' THEN coalesce(buy_signal, false) ELSE coalesce(sell_signal, false) END AS breakaway,
        CASE WHEN action = 'buy' THEN (coalesce(allow_high_delta, false) AND coalesce(high_delta, false)) OR (coalesce(allow_high_stop, false) AND NOT coalesce(high_stop, false))
          ELSE (coalesce(allow_low_delta, false) AND coalesce(low_delta, false)) OR (coalesce(allow_low_stop, false) AND NOT coalesce(low_stop, false)) END AS trend_ml,
        CASE WHEN action = 'buy' THEN (coalesce(allow_high_delta, false) AND coalesce(high_delta, false)) OR (coalesce(allow_low_stop, false) AND coalesce(low_stop, false))
          ELSE (coalesce(allow_low_delta, false) AND coalesce(low_delta, false)) OR (coalesce(allow_high_stop, false) AND coalesce(high_stop, false)) END AS correction_ml,
        coalesce(benchmark_trend, false) AS with_benchmark FROM acted""",
    "day_state": """SELECT ticker, day, CAST(count(*) AS BIGINT) AS orders, CAST(count(*) FILTER (WHERE order_type = 'TAKE PROFIT') AS BIGINT) AS limit_orders,
        CAST(count(*) FILTER (WHERE order_type = 'STOP LOSS') AS BIGINT) AS stop_orders, CAST(count(*) // 3 AS INTEGER) AS positions FROM dto GROUP BY 1, 2""",
    "newest3": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticker, day ORDER BY ib_id DESC) AS rank FROM dto) WHERE rank <= 3",
    "last_pos": """SELECT ticker, day, max(CASE WHEN order_type = 'MKT' THEN fill_price END) AS market_fill,
        max(CASE WHEN order_type = 'TAKE PROFIT' THEN fill_price END) AS limit_fill, max(CASE WHEN order_type = 'STOP LOSS' THEN fill_price END) AS stop_fill
      FROM newest3 GROUP BY 1, 2""",
    "minute_orders": """SELECT m.ticker, m.day, m.since, o.order_type, o.fill_price, row_number() OVER (PARTITION BY m.ticker, m.day, m.since ORDER BY o.ib_id DESC) AS rank
      FROM (SELECT DISTINCT ticker, day, CASE WHEN date_trunc('minute', date) = date THEN date ELSE date_trunc('minute', date) + INTERVAL 1 MINUTE END AS since FROM dto) m
      JOIN dto o ON o.ticker = m.ticker AND o.day = m.day AND o.date <= m.since""",
    "minute_state": """SELECT ticker, day, since, count(*) AS orders, count(*) FILTER (WHERE order_type = 'TAKE PROFIT') AS limit_orders,
        count(*) FILTER (WHERE order_type = 'STOP LOSS') AS stop_orders, CAST(count(*) // 3 AS INTEGER) AS positions,
        max(CASE WHEN rank <= 3 AND order_type = 'TAKE PROFIT' THEN fill_price END) AS limit_fill,
        max(CASE WHEN rank <= 3 AND order_type = 'STOP LOSS' THEN fill_price END) AS stop_fill
      FROM minute_orders GROUP BY ticker, day, since""",
    "gate": """SELECT s.ticker, s.day, s.since, tp.action, tp.strategy, s.positions, CASE
        WHEN orders > coalesce(stop_trades * 3, 6) + coalesce(limit_trades * 3, 3) THEN true
        WHEN limit_fill IS NOT NULL THEN orders <> 3 AND limit_orders >= coalesce(limit_trades * 3, 3)
        WHEN stop_fill IS NOT NULL THEN orders <> 3 AND stop_orders >= coalesce(stop_trades * 3, 6)
        ELSE true END AS blocked
      FROM minute_state s JOIN tp ON tp.ticker = s.ticker""",
    "bar_orders": """SELECT b.ticker, b.date, o.order_type, o.fill_price, row_number() OVER (PARTITION BY b.ticker, b.date ORDER BY o.ib_id DESC) AS rank
      FROM (SELECT DISTINCT ticker, day, date FROM acted) b JOIN dto o ON o.ticker = b.ticker AND o.day = b.day AND o.date <= b.date""",
    "bar_state": """SELECT ticker, date, count(*) AS orders, count(*) FILTER (WHERE order_type = 'TAKE PROFIT') AS limit_orders,
        count(*) FILTER (WHERE order_type = 'STOP LOSS') AS stop_orders, CAST(count(*) // 3 AS INTEGER) AS positions,
        max(CASE WHEN rank <= 3 AND order_type = 'TAKE PROFIT' THEN fill_price END) AS limit_fill,
        max(CASE WHEN rank <= 3 AND order_type = 'STOP LOSS' THEN fill_price END) AS stop_fill
      FROM bar_orders GROUP BY ticker, date""",
    "bar_gate": """SELECT s.ticker, s.date, tp.action, tp.strategy, CASE
        WHEN orders > coalesce(stop_trades * 3, 6) + coalesce(limit_trades * 3, 3) THEN true
        WHEN limit_fill IS NOT NULL THEN orders <> 3 AND limit_orders >= coalesce(limit_trades * 3, 3)
        WHEN stop_fill IS NOT NULL THEN orders <> 3 AND stop_orders >= coalesce(stop_trades * 3, 6)
        ELSE true END AS blocked
      FROM bar_state s JOIN tp ON tp.ticker = s.ticker""",
    "daily": """SELECT l_suppkey AS ticker, l_shipdate AS date,
        arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS open, max(l_extendedprice / l_quantity) AS high,
        min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_extendedprice)) AS close,
        CAST(sum(l_quantity) AS BIGINT) AS volume, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2""",
    "trade_params": """SELECT s_suppkey AS ticker, r_name AS industry, s_suppkey + 1000 AS conid, d.date AS date, s_acctbal > 0 AS day_trade_buy,
        s_acctbal < 5000 AS day_trade_sell, s_nationkey AS nation, s_acctbal
      FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
      LEFT JOIN (SELECT l_suppkey, max(l_shipdate) AS date FROM lineitem GROUP BY 1) d ON d.l_suppkey = s_suppkey""",
    "benchmark_utils": "SELECT industry, min(ticker) AS benchmark, min(conid) AS conid FROM trade_params GROUP BY 1",
    "illiquid": "SELECT ticker, date FROM trade_params WHERE nation IN (3, 7)",
    "test_params": """SELECT ticker AS symbol, 'minute' AS time_frame, strategy, action, CASE WHEN nation % 4 <> 0 THEN date END AS date,
        CASE WHEN nation % 5 <> 1 THEN nation % 3 = 0 END AS performance, s_acctbal / 10000 + step * 0.01::DOUBLE AS algo_period_return,
        nation / 25.0::DOUBLE AS spy_period_return, CASE WHEN nation <> 9 THEN (nation - 12) / 20.0::DOUBLE END AS beta,
        -(nation % 10) / 20.0::DOUBLE AS max_drawdown, CASE WHEN nation >= 5 THEN s_acctbal END AS combined_period_return,
        CASE WHEN nation % 2 = 0 THEN s_acctbal * 2 END AS portfolio_value, CASE WHEN nation % 3 = 0 THEN s_acctbal * 3 END AS portfolio_value_benchmark,
        CASE WHEN nation % 4 = 0 THEN s_acctbal * 4 END AS portfolio_value_ml
      FROM trade_params, (VALUES ('trend', 'buy', 0), ('trend', 'sell', 1), ('correction', 'buy', 2), ('correction', 'sell', 3)) v(strategy, action, step)
      WHERE nation <> 11 OR step < 3""",
    "errors": """SELECT ticker, CASE nation WHEN 5 THEN 'trend' WHEN 11 THEN 'reports' END AS strategy,
        CASE WHEN nation = 17 THEN 'combined' ELSE 'ml' END AS test_param FROM trade_params WHERE nation IN (5, 11, 17, 23)""",
    "failed": "SELECT DISTINCT ticker FROM errors WHERE strategy IN ('trend', 'correction') OR test_param = 'combined'",
    "daily_numbered": """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back,
        lag(close) OVER (PARTITION BY ticker ORDER BY date) AS previous FROM daily""",
    "screen_cols": """SELECT ticker, date, close, volume, avg_volume, volume / avg_volume AS relative_volume, change,
        avg(tr) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS average_true_range, new_high, new_low
      FROM (SELECT *, avg(volume) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW) AS avg_volume,
        greatest(high - low, abs(high - previous), abs(low - previous)) AS tr, close - previous AS change,
        high = max(high) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS new_high,
        low = min(low) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 251 PRECEDING AND CURRENT ROW) AS new_low FROM daily_numbered)""",
    "screen_base": """SELECT s.*, m.relative_volume AS market FROM screen_cols s JOIN screen_cols m ON m.ticker = 0 AND m.date = s.date
      WHERE s.avg_volume > 20 AND s.close > 30""",
    "screens": """SELECT ticker, date, 'main' AS screen FROM screen_base WHERE average_true_range > 0.5 AND relative_volume > floor(market / 0.25) * 0.25
      UNION ALL SELECT ticker, date, 'market_change' FROM screen_base WHERE average_true_range > 1 AND CASE WHEN market > 0 THEN change > 0 ELSE change < 0 END
      UNION ALL SELECT ticker, date, 'new_high' FROM screen_base WHERE average_true_range > 0.5 AND relative_volume > floor(market / 0.25) * 0.25 AND new_high
      UNION ALL SELECT ticker, date, 'new_low' FROM screen_base WHERE average_true_range > 0.5 AND relative_volume > floor(market / 0.25) * 0.25 AND new_low""",
    "midpoints": """SELECT ticker, max(high) - (max(high) - min(low)) / 2 AS range_midpoint, arg_max(close, date) AS last_price
      FROM daily_numbered WHERE back <= 75 GROUP BY 1""",
    "accounts": """SELECT c_custkey AS account, c_acctbal * 10 AS balance, c_mktsegment IN ('MACHINERY', 'BUILDING', 'FURNITURE') AS day_trade,
      c_nationkey % 3 + 1 AS day_trade_multiplier FROM customer""",
    "ins": """SELECT o_orderkey AS instruction_id, o_custkey AS account, o_orderdate AS date, CAST(o_orderdate AS DATE) AS day,
        CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'new' ELSE 'cancelled' END AS order_status,
        CASE WHEN o_orderkey % 7 <> 0 THEN CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'new' ELSE 'cancelled' END END AS db_status,
        CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'MKT' WHEN o_orderpriority = '5-LOW' THEN 'LMT' ELSE 'STP' END AS order_type,
        'SYM' || (o_custkey // 100) AS symbol, CASE WHEN o_orderkey % 10 = 0 THEN 'day_trade' ELSE 'day-trade' END AS strategy_id,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'OPT' ELSE 'STK' END AS sec_type,
        CAST(floor(o_totalprice / 1000) AS BIGINT) AS quantity, CASE WHEN o_orderkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS buy_or_sell,
        CASE WHEN o_orderpriority = '5-LOW' THEN o_totalprice END AS limit_price,
        CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN o_totalprice END AS stop_price,
        CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 100 END AS fill_price, 'oca' || o_orderkey AS oca_group, o_orderkey AS cll_int_id,
        CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS ib_id,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CAST(floor(o_totalprice / 10000) AS BIGINT) END AS strike,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'C' ELSE 'P' END END AS put_or_call,
        CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '200112' END AS expire FROM orders""",
    "positions": """SELECT account, symbol, sec_type, strike, put_or_call, expire,
        CAST(sum(CASE WHEN buy_or_sell = 'BUY' THEN quantity ELSE -quantity END) AS BIGINT) AS pos, max(fill_price) AS traded_price
      FROM ins WHERE order_status = 'filled' GROUP BY ALL""",
    "broker_orders": """SELECT instruction_id AS order_id, account, symbol,
        CASE WHEN instruction_id % 4 = 0 THEN order_type WHEN order_type = 'STP' THEN 'TRAIL' ELSE order_type END AS order_type, quantity, ib_id,
        CASE WHEN order_status = 'new' THEN 'submitted' ELSE order_status END AS status FROM ins""",
    "checked": """SELECT i.*, EXISTS (SELECT 1 FROM positions p WHERE p.account = i.account AND p.symbol = i.symbol AND abs(p.pos) = i.quantity
          AND p.sec_type = i.sec_type AND (i.sec_type <> 'OPT' OR (p.strike = i.strike AND p.put_or_call = i.put_or_call AND p.expire = i.expire))) AS has_position,
        EXISTS (SELECT 1 FROM broker_orders b WHERE b.status NOT IN ('filled', 'cancelled') AND b.account = i.account AND b.symbol = i.symbol
          AND b.order_type = i.order_type AND b.quantity = i.quantity) AS has_open_order,
        EXISTS (SELECT 1 FROM broker_orders b WHERE b.status NOT IN ('filled', 'cancelled') AND b.account = i.account AND b.symbol = i.symbol
          AND b.order_type = CASE WHEN i.order_type = 'STP' THEN 'TRAIL' ELSE 'LMT' END AND b.quantity = i.quantity AND b.ib_id = i.ib_id) AS has_close_order
      FROM ins i""",
    "execs": """SELECT l_orderkey AS ib_id, 'SYM' || (o_custkey // 100) AS symbol, 'STK' AS security_type, 'USD' AS currency,
        l_orderkey || '-' || l_linenumber AS execution_id, o_custkey AS account, CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS buy_or_sell,
        l_quantity AS quantity, l_extendedprice / l_quantity AS price, l_quantity AS cum_quantity, l_extendedprice / l_quantity AS average_price,
        l_shipdate AS date FROM lineitem JOIN orders ON o_orderkey = l_orderkey""",
    "comms": """SELECT l_orderkey || '-' || l_linenumber AS execution_id, l_extendedprice * l_discount AS commission,
        CASE WHEN l_tax <> 0 THEN l_extendedprice * l_tax END AS realized_profit_loss, CASE WHEN l_returnflag = 'R' THEN l_tax END AS "yield",
        l_shipdate AS date FROM lineitem""",
    "comm": """SELECT execution_id, commission, realized_profit_loss, "yield" FROM (SELECT *, row_number() OVER (PARTITION BY execution_id
        ORDER BY date DESC, commission DESC, realized_profit_loss DESC NULLS LAST, "yield" DESC NULLS LAST) AS rn FROM comms) WHERE rn = 1""",
    "quotes": "SELECT ticker AS contract, ts, k % 2 + 1 AS field, price FROM ticks",
    "status_reports": f"""SELECT user_id AS order_id, ts AS event_time, CASE WHEN k % 11 = 0 THEN 'Unknown' ELSE
        (['Filled', 'Submitted', 'PreSubmitted', 'PendingSubmit', 'PendingCancel', 'ApiCancelled', 'Cancelled', 'Inactive'])[k % 8 + 1] END AS text,
        CASE WHEN k % 3 = 0 THEN 0.0::DOUBLE ELSE CAST(k AS DOUBLE) END AS remaining, floor(price * 10 + 0.5) / 10 AS fill_price, k FROM ticks""",
}

_USES = {name: re.compile(rf"\b{name}\b") for name in CTES}


def _needed(sql: str, found: dict[str, None]) -> None:
    for name, pattern in _USES.items():
        if name not in found and pattern.search(re.sub(r"'[^']*'", "", sql)):
            _needed(CTES[name], found)
            found[name] = None


def with_ctes(sql: str) -> str:
    """Put the used CTEs, and those they use, in front of a query."""
    found: dict[str, None] = {}
    _needed(sql, found)
    parts = [f"{name} AS ({CTES[name]})" for name in found]
    extra = sql.strip()
    if extra.upper().startswith("WITH "):
        return f"WITH {', '.join([*parts, extra[5:]])}" if parts else extra
    return f"WITH {', '.join(parts)} {extra}" if parts else extra
