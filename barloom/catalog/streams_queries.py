"""Streaming jobs run over all available input, compared with batch SQL."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.ctes import r6
from barloom.catalog.orders_queries import REPORTED, STANDING
from barloom.catalog.registry import query, sixes
from barloom.functions import scalars as sf
from barloom.operators import orders as oo
from barloom.operators import signals as ss
from barloom.schemas import EVENTS
from barloom.session import fresh_path
from barloom.sources import sinks
from barloom.sources.stage import stage, stage_path
from barloom.streaming import bars as sb
from barloom.streaming import orders as so
from barloom.streaming import state as st
from barloom.streaming.runs import count_late, file_stream, replay, run_batches, run_to_end, run_to_table

BAR = "ticker, date, open, high, low, close, volume, count"
# the watermark keeps milliseconds
MARK = "(SELECT date_trunc('millisecond', max(ts)) - INTERVAL 30 SECOND FROM events)"
LINES = (
    "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, "
    "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
)


def _ticks(spark, d):
    return b.ticks_of(file_stream(spark, d, EVENTS, "events.parquet"))


def _as_stream(df, name):
    return df.sparkSession.readStream.schema(df.schema).parquet(stage_path(df, name))


@query("s13_bar_stream", "SELECT ticker, ts, price AS close, event_id FROM ticks")
def s13(spark, d):
    return run_to_table(_ticks(spark, d).select("ticker", "ts", "close", "event_id"), "ticks")[0]


@query("t01_minute_bars_stream", f"SELECT {BAR} FROM minutes WHERE date + INTERVAL 1 MINUTE <= {MARK}")
def t01(spark, d):
    return run_to_table(sb.minute_bars_stream(_ticks(spark, d)), "minutes")[0]


FIVE = f"""SELECT ticker, time_bucket(INTERVAL '5 minutes', date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low, arg_max(close, date) AS close,
  CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(count) AS BIGINT) AS count, count(*) < 5 AS has_gaps FROM minutes
  WHERE time_bucket(INTERVAL '5 minutes', date) + INTERVAL 5 MINUTE <= {MARK} GROUP BY 1, 2"""


@query("t02_five_minute_bars_stream", FIVE)
def t02(spark, d):
    return run_to_table(sb.five_minute_bars_stream(_ticks(spark, d)), "fives")[0]


@query("t03_session_filter", "SELECT event_id, ticker, ts FROM ticks WHERE strftime(ts - INTERVAL 5 HOUR, '%H:%M') >= '09:30' AND strftime(ts - INTERVAL 5 HOUR, '%H:%M') < '16:00'")
def t03(spark, d):
    return run_to_table(sb.session_filter(_ticks(spark, d)).select("event_id", "ticker", "ts"), "session")[0]


DAYS = """(SELECT ticker, day, day_open, lag(last_close) OVER (PARTITION BY ticker ORDER BY day) AS prev_day_close FROM
  (SELECT ticker, CAST(date AS DATE) AS day, arg_min(open, date) AS day_open, arg_max(close, date) AS last_close FROM bars GROUP BY 1, 2))"""


@query(
    "t04_day_state",
    f"""SELECT b.ticker, b.date, b.close, x.day_open, x.prev_day_close FROM bars b JOIN {DAYS} x ON x.ticker = b.ticker AND x.day = CAST(b.date AS DATE)""",
)
def t04(spark, d):
    """Ticks to bars to day context in one query, up to the end of the ticks."""

    def job(ticks):
        return sb.stamped_days(ticks, "2 hours").select("ticker", "date", "close", "day_open", "prev_day_close")

    return run_to_end(_ticks(spark, d), "ts", job, "days")[0]


@query("t05_all_tickers_closed", f"""SELECT date, CAST(count(*) AS BIGINT) AS tickers, CAST(sum(volume) AS BIGINT) AS volume, max(high) AS high, min(low) AS low FROM bars
    WHERE date + INTERVAL 2 HOUR <= {MARK} GROUP BY 1""")
def t05(spark, d):
    schema = "date timestamp_ntz, tickers bigint, volume bigint, high double, low double"
    return run_batches(sb.minute_bars_stream(_ticks(spark, d), "2 hours"), "sections", sb.cross_section, schema)


@query(
    "t06_signal_stream",
    """SELECT c.ticker, c.date, c.action, c.strategy, c.close FROM conditions c LEFT JOIN bar_gate g ON g.ticker = c.ticker AND g.date = c.date AND g.action = c.action AND g.strategy = c.strategy
    WHERE performance AND NOT coalesce(blocked, false) AND breakaway AND (c.benchmark_negative IS NULL OR c.benchmark_positive IS NULL OR with_benchmark)
      AND (NOT (coalesce(allow_high_delta, false) OR coalesce(allow_low_delta, false) OR coalesce(allow_high_stop, false) OR coalesce(allow_low_stop, false))
        OR CASE WHEN c.strategy = 'trend' THEN trend_ml ELSE correction_ml END) AND c.date + INTERVAL 2 HOUR <= """ + MARK,
)
def t06(spark, d):
    """Ticks to bars to day context to signals in one query, against the tables of parameters and orders."""
    params = stage(b.params(spark, d), "params")
    states = stage(ss.states_by_hour(ss.order_states(b.day_orders(spark, d))), "states")
    bars = b.live_columns(sb.stamped_days(_ticks(spark, d), "2 hours", b.SPEC.bars_per_day))
    return run_to_table(ss.entry_signals(bars, params, states), "signals")[0]


@query(
    "t08_late_data",
    f"""SELECT {BAR}, (SELECT CAST(count(*) AS BIGINT) FROM events WHERE ts < TIMESTAMP '2024-01-16' AND ts <= {MARK}) AS late_ticks FROM minutes
    WHERE date >= TIMESTAMP '2024-01-16' AND date + INTERVAL 1 MINUTE <= {MARK}""",
)
def t08(spark, d):
    """Ticks of the second half first; those of the first half then come too late, and are counted."""
    events = b.table(spark, d, "events")
    source, target, counts = (fresh_path(spark, name) for name in ("landing", "late", "counts"))
    half = b.moment("2024-01-16 00:00:00")
    for part in (F.col("ts") >= half, F.col("ts") < half):
        events.where(part).write.mode("append").parquet(source)
        stream = b.ticks_of(file_stream(spark, source, EVENTS))
        table, _ = run_to_table(sb.minute_bars_stream(stream), "late", target)
        late = count_late(stream, "ts", sb.DELAY, "counts", counts)
    total = late.agg(F.sum("late")).first()[0]
    return table.withColumn("late_ticks", F.lit(total).cast("bigint"))


@query("t09_quote_state_stream", f"SELECT contract, ts, field, price, bid, ask FROM {STANDING} WHERE bid IS NOT NULL AND ask IS NOT NULL")
def t09_stream(spark, d):
    quotes = _ticks(spark, d).select(
        F.col("ticker").alias("contract"), "ts", (F.col("k") % 2 + 1).alias("field"), F.col("close").alias("price")
    )
    return run_to_end(quotes, "ts", st.quote_state, "quotes")[0]


@query(
    "t10_status_stream",
    f"""SELECT order_id, event_time, status, status IN ('filled', 'cancelled') AS removed FROM (SELECT *, lag(status) OVER w AS before,
      coalesce(sum(CASE WHEN status IN ('filled', 'cancelled') THEN 1 ELSE 0 END) OVER (PARTITION BY order_id ORDER BY event_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done
      FROM (SELECT order_id, event_time, {REPORTED} AS status FROM status_reports) WHERE status IS NOT NULL WINDOW w AS (PARTITION BY order_id ORDER BY event_time))
    WHERE done = 0 AND status IS DISTINCT FROM before AND event_time <= """ + MARK,
)
def t10_stream(spark, d):
    rows = b.status_reports_of(_ticks(spark, d))
    events = rows.select("order_id", "event_time", sf.order_status(F.col("text"), F.col("remaining")).alias("status"))
    # Orders are users here and go on for the whole month, so a finished one is remembered for longer.
    return run_to_table(st.status_stream(events, keep_finished=100 * st.DAY), "status")[0]


@query("t11_drop_today_bars", f"SELECT {BAR}, CAST(date AS DATE) AS day FROM bars WHERE CAST(date AS DATE) <> DATE '2024-01-30' UNION ALL SELECT ticker, date, open, high, low, close, volume + 1, count, CAST(date AS DATE) AS day FROM bars WHERE CAST(date AS DATE) = DATE '2024-01-30' AND volume > 3")
def t11(spark, d):
    """Today's bars are replaced as a whole day."""
    path = fresh_path(spark, "bars")
    bars = b.bars(spark, d)
    sinks.replace_days(bars, path)
    today = bars.where("volume > 3").withColumn("volume", F.col("volume") + 1)
    sinks.replace_day(today, path, "2024-01-30")
    return spark.read.parquet(path)


@query("t11_without_today", f"SELECT {BAR} FROM bars WHERE CAST(date AS DATE) <> DATE '2024-01-30'")
def t11_without(spark, d):
    return sinks.drop_day(b.bars(spark, d), F.lit("2024-01-30").cast("date"))


@query(
    "j23_executions_with_commissions",
    f"""SELECT e.execution_id, e.date, e.quantity, {r6('c.commission')} AS commission, {r6('c.realized_profit_loss')} AS realized_profit_loss FROM (SELECT l_orderkey || '-' || l_linenumber AS execution_id, l_quantity AS quantity, l_shipdate AS date FROM lineitem) e
    JOIN comms c ON c.execution_id = e.execution_id AND c.date BETWEEN e.date - INTERVAL 1 DAY AND e.date + INTERVAL 1 DAY""",
)
def j23(spark, d):
    feed = replay(spark, d, LINES, "lineitem.parquet", "l_shipdate")
    lines = feed()
    ids = F.concat_ws("-", "l_orderkey", "l_linenumber")
    executions = lines.select(ids.alias("execution_id"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("date"))
    commissions = oo.commission_rows(b.commission_reports_of(feed()))
    joined, _ = run_to_table(so.executions_with_commissions(executions, commissions.drop("yield")), "paid")
    return sixes(joined, "commission", "realized_profit_loss")


@query(
    "j23_executions_outer",
    f"""SELECT e.execution_id, e.date, e.quantity, {r6('c.commission')} AS commission, c.execution_id IS NOT NULL AS paid
    FROM (SELECT l_orderkey || '-' || l_linenumber AS execution_id, l_quantity AS quantity, l_shipdate AS date FROM lineitem) e
    LEFT JOIN (SELECT * FROM comms WHERE commission > 0) c ON c.execution_id = e.execution_id AND c.date BETWEEN e.date - INTERVAL 1 DAY AND e.date + INTERVAL 1 DAY
    WHERE c.execution_id IS NOT NULL OR e.date + INTERVAL 1 DAY < (SELECT max(c.date) FROM comms c WHERE commission > 0) - INTERVAL 1 HOUR""",
)
def j23_outer(spark, d):
    """Executions that have no commission, as a free one is not reported, come out once."""
    feed = replay(spark, d, LINES, "lineitem.parquet", "l_shipdate")
    lines = feed()
    ids = F.concat_ws("-", "l_orderkey", "l_linenumber")
    executions = lines.select(ids.alias("execution_id"), F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("date"))
    commissions = oo.commission_rows(b.commission_reports_of(feed())).where("commission > 0")
    paid = commissions.select("execution_id", "date", "commission", F.lit(True).alias("paid"))
    joined, _ = run_to_table(so.executions_with_commissions(executions, paid, how="left_outer"), "outer")
    return sixes(joined.withColumn("paid", F.coalesce("paid", F.lit(False))), "commission")
