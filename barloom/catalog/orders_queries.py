"""Accounts, instructions, executions and reconciliation."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.ctes import r6
from barloom.catalog.registry import query, sixes
from barloom.functions import scalars as sf
from barloom.operators import orders as oo

INS = "instruction_id, account, symbol, order_type, order_status, quantity"


def _ins(spark, d, *names):
    picked = [name.strip() for name in INS.split(",")] + list(names)
    return b.instructions(spark, d).select(*picked)


@query("p18_open_instructions", f"SELECT {INS}, day, strategy_id FROM ins WHERE order_status = 'new' AND strategy_id = 'day-trade'")
def p18(spark, d):
    return oo.open_instructions(_ins(spark, d, "day", "strategy_id"), "day-trade")


@query("p21_non_zero_positions", "SELECT account, symbol, sec_type, pos FROM positions WHERE pos <> 0")
def p21(spark, d):
    return oo.non_zero_positions(b.positions(spark, d)).select("account", "symbol", "sec_type", "pos")


@query("p21_stock_positions", "SELECT account, symbol, pos, traded_price FROM positions WHERE pos <> 0 AND sec_type = 'STK' AND symbol <> 'HYG'")
def p21_stock(spark, d):
    return oo.stock_positions(b.positions(spark, d)).select("account", "symbol", "pos", "traded_price")


@query("p22_eligible_accounts", "SELECT account, balance, day_trade_multiplier FROM accounts WHERE balance > 30000 AND day_trade")
def p22(spark, d):
    return oo.eligible_accounts(b.accounts(spark, d), "day-trade").select("account", "balance", "day_trade_multiplier")


@query("p24_account_balance", "SELECT c_custkey AS account, CAST(CAST(floor(c_acctbal * 100) AS BIGINT) AS FLOAT) AS balance FROM customer WHERE c_mktsegment <> 'BUILDING' AND c_nationkey <> 3")
def p24(spark, d):
    amount = F.format_number(F.floor(F.col("c_acctbal") * 100).cast("bigint"), 0)
    summary = b.table(spark, d, "customer").select(
        F.col("c_custkey").alias("account"),
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("Cushion")).otherwise(F.lit("NetLiquidationByCurrency")).alias("tag"),
        F.when(F.col("c_nationkey") == 3, F.lit("USD")).otherwise(F.lit("BASE")).alias("currency"),
        amount.alias("value"),
    )
    return oo.account_balance(summary)


@query("k07_first_per_key", "SELECT account, symbol, instruction_id, date, quantity FROM (SELECT *, row_number() OVER (PARTITION BY account, symbol ORDER BY date DESC, instruction_id DESC) AS rn FROM ins WHERE order_status = 'filled') WHERE rn = 1")
def k07(spark, d):
    filled = b.instructions(spark, d).where("order_status = 'filled'").select("account", "symbol", "instruction_id", "date", "quantity")
    return oo.first_per_key(filled, ["account", "symbol"], "date", "instruction_id")


# --- instructions -------------------------------------------------------------------

# the written instructions are those of 50 lots and more, the incoming ones those up to 400
STORED = "(SELECT * FROM ins WHERE quantity >= 50)"
INCOMING = """(SELECT symbol, strategy_id, cll_int_id, account, day, instruction_id, date, order_type, CASE WHEN instruction_id % 11 = 0 THEN 'Canceled' ELSE 'new' END AS order_status,
  CASE WHEN instruction_id % 3 = 0 THEN limit_price * 2 ELSE limit_price END AS limit_price, CASE WHEN instruction_id % 4 = 0 THEN stop_price * 2 ELSE stop_price END AS stop_price
  FROM ins WHERE quantity <= 400)"""


def _shape(rows):
    return rows.select(*oo.INSTRUCTION_KEY, "instruction_id", "date", "order_type", "order_status", "limit_price", "stop_price")


def _stored(spark, d):
    return _shape(b.instructions(spark, d).where("quantity >= 50"))


def _incoming(spark, d):
    key = F.col("instruction_id")
    rows = b.instructions(spark, d).where("quantity <= 400").withColumns(
        {
            "order_status": F.when(key % 11 == 0, F.lit("Canceled")).otherwise(F.lit("new")),
            "limit_price": F.when(key % 3 == 0, F.col("limit_price") * 2).otherwise(F.col("limit_price")),
            "stop_price": F.when(key % 4 == 0, F.col("stop_price") * 2).otherwise(F.col("stop_price")),
        }
    )
    return _shape(rows)


@query("a20_exists_count", f"SELECT instruction_id FROM {INCOMING} n WHERE EXISTS (SELECT 1 FROM {STORED} o WHERE o.cll_int_id = n.cll_int_id AND o.symbol = n.symbol AND o.account = n.account AND o.strategy_id = n.strategy_id AND o.day = n.day)")
def a20(spark, d):
    return oo.written(_incoming(spark, d), _stored(spark, d)).select("instruction_id")


@query("a21_latest_status", "SELECT symbol, strategy_id, cll_int_id, account, day, order_status, order_status IN ('filled', 'cancelled', 'inactive') AS terminal FROM ins")
def a21(spark, d):
    return oo.latest_status(b.instructions(spark, d))


@query(
    "j21_upsert_instructions",
    f"""SELECT coalesce(o.cll_int_id, n.cll_int_id) AS cll_int_id, CASE WHEN o.cll_int_id IS NULL THEN n.order_status WHEN n.cll_int_id IS NULL OR o.order_status IN ('filled', 'cancelled', 'inactive') THEN o.order_status
      WHEN lower(n.order_status) = 'canceled' THEN 'canceled' ELSE o.order_status END AS order_status,
    CASE WHEN o.cll_int_id IS NULL THEN n.limit_price WHEN n.cll_int_id IS NOT NULL AND o.order_status = 'new' AND n.order_status = 'new' AND o.strategy_id = 'day-trade' AND n.order_type = 'LMT' THEN n.limit_price ELSE o.limit_price END AS limit_price,
    CASE WHEN o.cll_int_id IS NULL THEN n.stop_price WHEN n.cll_int_id IS NOT NULL AND o.order_status = 'new' AND n.order_status = 'new' AND o.strategy_id = 'day-trade' AND n.order_type = 'STP' THEN n.stop_price ELSE o.stop_price END AS stop_price
    FROM {STORED} o FULL JOIN {INCOMING} n ON n.cll_int_id = o.cll_int_id""",
)
def j21(spark, d):
    merged = oo.upsert_instructions(_stored(spark, d), _incoming(spark, d))
    return merged.select("cll_int_id", "order_status", "limit_price", "stop_price")


def _feed(spark, d):
    """Status reports of instructions, from their execution lines."""
    lines = b.table(spark, d, "lineitem")
    status = F.when(F.col("l_linestatus") == "F", F.lit("filled")).otherwise(F.lit("submitted"))
    return lines.select(
        F.col("l_orderkey").alias("instruction_id"),
        F.when(F.col("l_returnflag") != "N", status).alias("status"),
        F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("new_fill_price"),
        F.col("l_partkey").alias("new_ib_id"),
        F.col("l_shipdate").alias("event_time"),
    )


FEED = """(SELECT l_orderkey AS instruction_id, CASE WHEN l_returnflag <> 'N' THEN CASE WHEN l_linestatus = 'F' THEN 'filled' ELSE 'submitted' END END AS status,
  CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS new_fill_price, l_partkey AS new_ib_id, l_shipdate AS event_time FROM lineitem)"""
NEWEST_FEED = f"""(SELECT instruction_id, (array_agg(status ORDER BY event_time DESC, status DESC) FILTER (WHERE status IS NOT NULL))[1] AS status,
  (array_agg(new_fill_price ORDER BY event_time DESC, new_fill_price DESC) FILTER (WHERE new_fill_price IS NOT NULL))[1] AS new_fill_price,
  (array_agg(new_ib_id ORDER BY event_time DESC, new_ib_id DESC) FILTER (WHERE new_ib_id IS NOT NULL))[1] AS new_ib_id FROM {FEED} GROUP BY instruction_id)"""


@query("o11_status_update", f"""SELECT i.instruction_id, coalesce(s.status, i.order_status) AS order_status, coalesce(s.status, i.db_status) AS db_status, coalesce(s.new_fill_price, i.fill_price) AS fill_price,
    coalesce(s.new_ib_id, i.ib_id) AS ib_id FROM ins i LEFT JOIN {NEWEST_FEED} s ON s.instruction_id = i.instruction_id""")
def o11(spark, d):
    updated = oo.status_update(b.instructions(spark, d), _feed(spark, d))
    return updated.select("instruction_id", "order_status", "db_status", "fill_price", "ib_id")


def _plain_orders(spark, d):
    return b.instructions(spark, d).select("oca_group", F.col("cll_int_id").alias("ib_id"), F.lit(None).cast("double").alias("fill_price"))


@query("j17_fill_propagation", "SELECT oca_group, cll_int_id AS ib_id, CASE WHEN order_status = 'filled' AND strategy_id = 'day-trade' THEN fill_price END AS fill_price FROM ins")
def j17(spark, d):
    return oo.propagate_fills(_plain_orders(spark, d), b.instructions(spark, d))


@query(
    "o14_status_to_fill",
    f"""SELECT i.oca_group, i.cll_int_id AS ib_id, CASE WHEN i.strategy_id = 'day-trade' AND coalesce(s.status, i.order_status) = 'filled' AND EXISTS (SELECT 1 FROM {FEED} f WHERE f.instruction_id = i.instruction_id AND f.status = 'filled')
    THEN coalesce(s.new_fill_price, i.fill_price) END AS fill_price FROM ins i LEFT JOIN {NEWEST_FEED} s ON s.instruction_id = i.instruction_id""",
)
def o14(spark, d):
    return oo.status_to_fill(_plain_orders(spark, d), b.instructions(spark, d), _feed(spark, d))


@query(
    "o06_fix_quantity",
    """SELECT i.account, i.symbol, i.instruction_id, 'new' AS order_status, 'fix quantity' AS signal_id, 'MKT' AS order_type, CASE WHEN buy_or_sell = 'BUY' THEN 'SELL' ELSE 'BUY' END AS buy_or_sell,
    abs(p.pos) - quantity AS quantity, oca_group || '_error' AS oca_group FROM (SELECT *, row_number() OVER (PARTITION BY account, symbol, fill_price, day ORDER BY date DESC, instruction_id DESC) AS rn FROM ins WHERE order_status = 'filled') i
    JOIN positions p ON p.account = i.account AND p.symbol = i.symbol AND p.traded_price = i.fill_price WHERE rn = 1 AND abs(p.pos) <> quantity""",
)
def o06(spark, d):
    return oo.fix_quantity(b.instructions(spark, d), b.positions(spark, d))


@query("u10_merge_pending", "SELECT instruction_id, account, symbol, order_type, order_status, quantity FROM ins WHERE order_status = 'new' OR order_type = 'MKT'")
def u10(spark, d):
    rows = b.instructions(spark, d).select("instruction_id", "account", "symbol", "order_type", "order_status", "quantity")
    return oo.merge_pending(rows.where("order_status = 'new'"), rows.where("order_type = 'MKT'"))


# --- executions ---------------------------------------------------------------------

EXEC = "ib_id, symbol, security_type, currency, execution_id, account, buy_or_sell, quantity, price, cum_quantity, average_price, date"


@query("o12_execution_rows", f"SELECT {EXEC} FROM execs")
def o12(spark, d):
    return b.executions(spark, d)


@query("o12_commission_rows", f"""SELECT execution_id, {r6('commission')} AS commission, {r6('realized_profit_loss')} AS realized_profit_loss, "yield", date FROM comms""")
def o12_comm(spark, d):
    return sixes(oo.commission_rows(b.commission_reports(spark, d)), "commission", "realized_profit_loss")


@query("x13_sentinel_to_null", f"SELECT execution_id, date, {r6('commission')} AS commission, {r6('realized_profit_loss')} AS realized_profit_loss, \"yield\" FROM comms")
def x13(spark, d):
    rows = oo.commission_rows(b.commission_reports(spark, d))
    return sixes(rows.select("execution_id", "date", "commission", "realized_profit_loss", "yield"), "commission", "realized_profit_loss")


@query("j16_instruction_for_order", "SELECT e.execution_id, e.account, e.ib_id, e.quantity, i.instruction_id, i.strategy_id, i.db_status FROM execs e LEFT JOIN ins i ON i.account = e.account AND i.ib_id = e.ib_id")
def j16(spark, d):
    joined = oo.instruction_for_order(b.executions(spark, d), b.instructions(spark, d).withColumn("signal_id", F.lit("open stock")))
    return joined.select("execution_id", "account", "ib_id", "quantity", "instruction_id", "strategy_id", "db_status")


OLD_EXEC = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY date DESC, quantity DESC, price DESC) AS rn FROM execs WHERE buy_or_sell = 'BUY') WHERE rn = 1)"
NEW_EXEC = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY date DESC, quantity DESC, price DESC) AS rn FROM execs WHERE buy_or_sell <> 'BUY' OR quantity > 20) WHERE rn = 1)"


@query("j22_upsert_executions", f"""SELECT coalesce(o.execution_id, n.execution_id) AS execution_id, coalesce(n.quantity, o.quantity) AS quantity, coalesce(n.price, o.price) AS price, coalesce(o.date, n.date) AS date,
    coalesce(o.buy_or_sell, n.buy_or_sell) AS buy_or_sell FROM {OLD_EXEC} o FULL JOIN {NEW_EXEC} n ON n.execution_id = o.execution_id""")
def j22(spark, d):
    rows = b.executions(spark, d)
    merged = oo.upsert_executions(rows.where("buy_or_sell = 'BUY'"), rows.where("buy_or_sell <> 'BUY' OR quantity > 20"))
    return merged.select("execution_id", "quantity", "price", "date", "buy_or_sell")


@query("j22_commission_upsert", f"SELECT e.execution_id, e.quantity, {r6('c.commission')} AS commission, {r6('c.realized_profit_loss')} AS realized_profit_loss, c.\"yield\" FROM execs e LEFT JOIN comm c ON c.execution_id = e.execution_id")
def j22_comm(spark, d):
    joined = oo.executions_with_commissions(b.executions(spark, d), oo.commission_rows(b.commission_reports(spark, d)))
    rows = joined.select("execution_id", "quantity", "commission", "realized_profit_loss", "yield")
    return sixes(rows, "commission", "realized_profit_loss")


@query("o10_pnl_per_execution", """SELECT account, CAST(count(*) AS BIGINT) AS executions, floor(sum(commission) * 100 + 0.5) / 100 AS commission, floor(sum(realized_profit_loss) * 100 + 0.5) / 100 AS realized_profit_loss
    FROM execs e LEFT JOIN comm c ON c.execution_id = e.execution_id GROUP BY 1""")
def o10(spark, d):
    joined = oo.executions_with_commissions(b.executions(spark, d), oo.commission_rows(b.commission_reports(spark, d)))
    totals = oo.pnl_per_account(joined)
    return totals.withColumns({n: sf.scaled_round(F.col(n), 2) for n in ("commission", "realized_profit_loss")})


# --- reconciliation -----------------------------------------------------------------


@query("j18_position_exists", "SELECT instruction_id FROM checked WHERE has_position")
def j18(spark, d):
    return oo.mark_position(b.instructions(spark, d), b.positions(spark, d)).where("has_position").select("instruction_id")


@query("j19_open_order_exists", "SELECT instruction_id, has_open_order, has_close_order FROM checked")
def j19(spark, d):
    orders = b.broker_orders(spark, d)
    marked = oo.mark_close_order(oo.mark_open_order(b.instructions(spark, d), orders), orders)
    return marked.select("instruction_id", "has_open_order", "has_close_order")


@query(
    "o08_instruction_precheck",
    """SELECT instruction_id, order_type, CASE WHEN order_type = 'MKT' THEN CASE WHEN NOT has_open_order AND CASE WHEN sec_type = 'STK' AND symbol = 'HYG' THEN has_position ELSE NOT has_position END THEN 'execute' ELSE 'none' END
      WHEN sec_type = 'STK' AND has_position THEN CASE WHEN ib_id IS NULL OR has_close_order THEN 'execute' ELSE 'reset id' END
      WHEN order_type = 'LMT' AND sec_type <> 'STK' AND NOT has_open_order THEN 'execute' ELSE 'none' END AS step FROM checked""",
)
def o08(spark, d):
    return oo.instruction_precheck(b.instructions(spark, d), b.positions(spark, d), b.broker_orders(spark, d))


def _standing(spark, d):
    """The standing quote at every tick, with a limit order against it."""
    from barloom.operators.quotes import standing_quotes

    quotes = standing_quotes(b.quotes(spark, d))
    return quotes.withColumns(
        {
            "symbol": F.when(F.col("contract") == "view", F.lit("HYG")).otherwise(F.col("contract")),
            "action": F.when(F.col("field") == 1, F.lit("BUY")).otherwise(F.lit("SELL")),
            "limit_price": F.when(F.col("price") > 30, F.col("price") * 0.5),
            "multiplier": F.lit(0.9),
        }
    )


STANDING = """(SELECT contract, ts, field, price, last_value(CASE WHEN field = 1 THEN price END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN field = 2 THEN price END IGNORE NULLS) OVER w AS ask FROM quotes
  WINDOW w AS (PARTITION BY contract ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query("t09_quote_state", f"SELECT contract, ts, field, price, bid, ask FROM {STANDING} WHERE bid IS NOT NULL AND ask IS NOT NULL")
def t09(spark, d):
    from barloom.operators.quotes import standing_quotes

    return standing_quotes(b.quotes(spark, d))


@query(
    "o09_best_limit_price",
    f"""SELECT contract, ts, {r6('trade_price')} AS trade_price, special OR accepted AS sent, {r6("CASE WHEN special THEN CASE WHEN action = 'BUY' THEN greatest(trade_price, bid) ELSE least(trade_price, ask) END WHEN accepted THEN trade_price END")} AS sent_price FROM (
      SELECT *, CASE WHEN action = 'BUY' THEN trade_price <= (ask + trade_price) / 2 ELSE trade_price >= (ask + trade_price) / 2 END AS accepted, contract = 'view' AS special FROM (
        SELECT *, 0.9::DOUBLE * CASE WHEN action = 'BUY' THEN least(coalesce(lim, bid), bid) ELSE greatest(coalesce(lim, ask), ask) END AS trade_price FROM (
          SELECT *, CASE WHEN field = 1 THEN 'BUY' ELSE 'SELL' END AS action, CASE WHEN price > 30 THEN price * 0.5 END AS lim FROM {STANDING} WHERE bid IS NOT NULL AND ask IS NOT NULL)))""",
)
def o09(spark, d):
    priced = oo.best_limit_price(_standing(spark, d))
    return sixes(priced.select("contract", "ts", "trade_price", "sent", "sent_price"), "trade_price", "sent_price")


@query(
    "x15_price_multiplier",
    """SELECT event_id, CASE WHEN age <= 300 THEN 1.0::DOUBLE WHEN ticker = 'view' THEN CASE WHEN buys AND lim > 0 THEN 1.1::DOUBLE ELSE 0.95::DOUBLE END
      WHEN lim > -0.5 AND lim < 0 THEN CASE WHEN buys THEN -1.0::DOUBLE ELSE 1.25::DOUBLE END WHEN lim > 0 AND lim < 0.5 THEN CASE WHEN buys THEN 1.25::DOUBLE ELSE -1.0::DOUBLE END
      WHEN lim > 0.5 THEN CASE WHEN buys THEN 1.1::DOUBLE ELSE 0.9::DOUBLE END WHEN lim < -0.5 THEN CASE WHEN buys THEN 0.9::DOUBLE ELSE 1.1::DOUBLE END END AS multiplier
    FROM (SELECT event_id, ticker, k * 10 AS age, k % 2 = 0 AS buys, (price - 40) / 50 AS lim FROM ticks)""",
)
def x15(spark, d):
    rows = b.ticks(spark, d)
    side = F.when(F.col("k") % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL"))
    symbol = F.when(F.col("ticker") == "view", F.lit("HYG")).otherwise(F.col("ticker"))
    multiplier = sf.price_multiplier(F.col("k") * 10, symbol, side, (F.col("close") - 40) / 50, F.lit(1.0))
    return rows.select("event_id", multiplier.alias("multiplier"))


NAMED = "CASE text WHEN 'Filled' THEN 'filled' WHEN 'Submitted' THEN 'submitted' WHEN 'PreSubmitted' THEN 'pre-submitted' WHEN 'PendingSubmit' THEN 'pending-submit' WHEN 'PendingCancel' THEN 'pending-cancel' WHEN 'ApiCancelled' THEN 'api-cancelled' WHEN 'Cancelled' THEN 'cancelled' WHEN 'Inactive' THEN 'inactive' END"
REPORTED = f"CASE WHEN text IN ('Filled', 'Submitted') THEN CASE WHEN remaining = 0 THEN 'filled' END ELSE {NAMED} END"


@query("x12_order_status", f"SELECT order_id, event_time, {NAMED} AS opened, {REPORTED} AS reported FROM status_reports")
def x12(spark, d):
    rows = b.status_reports(spark, d)
    return rows.select(
        "order_id",
        "event_time",
        sf.order_status(F.col("text")).alias("opened"),
        sf.order_status(F.col("text"), F.col("remaining")).alias("reported"),
    )


def _events(spark, d):
    """Status, fill and sync events per order."""
    k = F.col("k")
    return b.status_reports(spark, d).select(
        "order_id",
        "event_time",
        sf.order_status(F.col("text"), F.col("remaining")).alias("status"),
        F.when(k % 4 == 0, F.col("fill_price")).alias("fill_price"),
        F.when(k % 5 == 0, sf.order_status(F.col("text"))).alias("db_status"),
    )


STATE = f"""(SELECT order_id, arg_max(status, event_time) FILTER (WHERE status IS NOT NULL) AS status, arg_max(fill_price, event_time) FILTER (WHERE fill_price IS NOT NULL) AS fill_price,
  arg_max(db_status, event_time) FILTER (WHERE db_status IS NOT NULL) AS db_status, CAST(count(*) AS BIGINT) AS events FROM (
    SELECT order_id, event_time, {REPORTED} AS status, CASE WHEN k % 4 = 0 THEN fill_price END AS fill_price, CASE WHEN k % 5 = 0 THEN {NAMED} END AS db_status FROM status_reports) GROUP BY 1)"""


@query("o13_order_state", f"SELECT order_id, status, fill_price, db_status, events FROM {STATE}")
def o13(spark, d):
    return oo.order_state(_events(spark, d))


# The registry by windows: removes part the events of an order into lives, the first add that finds an
# instruction opens a life, and only the last life counts.
REGISTRY = f"""SELECT order_id, account, instruction_id, signal_id, strategy_id, opened_at, status, fill_price, db_status, events FROM (
  WITH ev AS (SELECT *, order_id % 3 AS account, {NAMED} AS named, CASE WHEN k % 5 = 0 THEN 1 WHEN k % 29 = 1 THEN 5 WHEN k % 7 = 2 THEN 4 WHEN k % 3 = 0 THEN 3 ELSE 2 END AS kind
      FROM status_reports),
  vers AS (SELECT order_id, account, event_time AS changed_at, order_id * 100 + k % 13 AS instruction_id, 'open stock' AS signal_id,
      CASE WHEN k % 2 = 0 THEN 'day-trade' ELSE 'day_trade' END AS strategy_id, CASE WHEN k % 13 < 2 THEN 'new' ELSE 'submitted' END AS order_status
      FROM ev WHERE k % 13 < 4),
  live AS (SELECT * FROM (SELECT *, count(*) FILTER (WHERE kind = 5) OVER (PARTITION BY order_id ORDER BY event_time DESC, kind DESC) AS after FROM ev) WHERE after = 0),
  tagged AS (SELECT l.*, (SELECT max({{'t': v.changed_at, 'i': v.instruction_id, 'g': v.signal_id, 's': v.strategy_id, 'o': v.order_status}}) FROM vers v
      WHERE v.order_id = l.order_id AND v.account = l.account AND v.changed_at <= l.event_time) AS ins FROM live l WHERE kind = 1),
  born AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY event_time, named NULLS FIRST) AS rn FROM tagged WHERE ins IS NOT NULL) WHERE rn = 1),
  rest AS (SELECT l.order_id, l.kind, l.event_time, l.named, l.fill_price FROM live l JOIN born b ON b.order_id = l.order_id
      WHERE l.kind IN (2, 3, 4) AND l.event_time >= b.event_time),
  syn AS (SELECT order_id, max(event_time) AS at FROM rest WHERE kind = 4 GROUP BY 1),
  agg AS (SELECT r.order_id, max({{'t': event_time, 'v': named}}) FILTER (WHERE kind = 2) AS now,
      max({{'t': event_time, 'v': named}}) FILTER (WHERE kind = 2 AND event_time <= syn.at) AS kept,
      max({{'t': event_time, 'v': r.fill_price}}) FILTER (WHERE kind = 3) AS fill, any_value(syn.at) AS synced, count(*) AS n FROM rest r LEFT JOIN syn ON syn.order_id = r.order_id GROUP BY 1)
  SELECT b.order_id, b.account, b.ins.i AS instruction_id, b.ins.g AS signal_id, b.ins.s AS strategy_id, b.event_time AS opened_at,
    CASE WHEN a.now IS NOT NULL THEN a.now.v ELSE b.named END AS status, a.fill.v AS fill_price,
    CASE WHEN a.synced IS NULL THEN b.ins.o WHEN a.kept IS NOT NULL THEN a.kept.v ELSE b.named END AS db_status, CAST(coalesce(a.n, 0) AS BIGINT) AS events
  FROM born b LEFT JOIN agg a ON a.order_id = b.order_id)"""


@query("o13_order_registry", REGISTRY)
def o13_registry(spark, d):
    return oo.order_registry(b.order_events(spark, d), b.instruction_versions(spark, d))


@query("t10_status_changes", f"SELECT order_id, status, fill_price, db_status, events, coalesce(status IN ('filled', 'cancelled'), false) AS removed FROM {STATE} WHERE status IS DISTINCT FROM db_status")
def t10(spark, d):
    return oo.status_changes(oo.order_state(_events(spark, d)))


# --- scalar helpers over whole tables -----------------------------------------------


@query("x11_as_int32", "SELECT o_orderkey, TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS head, TRY_CAST(substr(o_orderpriority, 2) AS INTEGER) AS tail, TRY_CAST(CAST(o_totalprice AS VARCHAR) AS FLOAT) AS price FROM orders")
def x11(spark, d):
    rows = b.table(spark, d, "orders")
    return rows.select(
        "o_orderkey",
        sf.to_int(F.substring("o_orderpriority", 1, 1)).alias("head"),
        sf.to_int(F.expr("substr(o_orderpriority, 2)")).alias("tail"),
        sf.to_float(F.col("o_totalprice").cast("string")).alias("price"),
    )


@query("x16_split_accounts", "SELECT account, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(string_split(o_custkey || ',' || (o_custkey + 1), ',')) AS account FROM orders) GROUP BY 1")
def x16(spark, d):
    text = F.concat_ws(",", "o_custkey", F.col("o_custkey") + 1)
    accounts = b.table(spark, d, "orders").select(F.explode(sf.split_accounts(text)).alias("account"))
    return accounts.groupBy("account").agg(F.count(F.lit(1)).alias("n"))


@query("x17_contract_id", "SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%LOW%' THEN CAST(o_custkey AS INTEGER) WHEN o_orderpriority LIKE '%HIGH%' THEN CAST(o_orderkey AS INTEGER) END AS conid FROM orders")
def x17(spark, d):
    ids = F.array(F.concat(F.lit("LOW-C-"), F.col("o_custkey")), F.concat(F.lit("HIGH-P-"), F.col("o_orderkey")))
    search = F.substring_index("o_orderpriority", "-", -1)
    return b.table(spark, d, "orders").select("o_orderkey", sf.contract_id(search, ids).alias("conid"))


