"""Order management: lookups, adjustments, instructions and executions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators import params as pp
from barloom.operators.bars import latest_bar
from barloom.operators.series import day_of, spread_join
from barloom.sources.stage import stage

TERMINAL = ("filled", "cancelled", "inactive")


@dataclass(frozen=True)
class Account:
    """The account that instructions are made for."""

    name: str
    balance: float
    multiplier: int


# --- filters and routes -------------------------------------------------------------


def open_instructions(instructions: DataFrame, strategy: str) -> DataFrame:
    """Instructions still new, of one strategy; day and account stay as columns."""
    return instructions.where((F.col("order_status") == "new") & (F.col("strategy_id") == strategy))


def working_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("ib_status").isNull())


def of_type(orders: DataFrame, kind: str) -> DataFrame:
    return orders.where(F.col("order_type") == kind)


def route_by_order_type(orders: DataFrame) -> DataFrame:
    """The queue an order or instruction goes to."""
    kind = F.col("order_type")
    route = (
        F.when(kind == "MKT", F.lit("market"))
        .when(kind.isin("STP", c.STOP), F.lit("stop"))
        .when(kind.isin("LMT", c.LIMIT), F.lit("limit"))
    )
    return orders.withColumn("route", route).where(F.col("route").isNotNull())


def non_zero_positions(positions: DataFrame) -> DataFrame:
    return positions.where(F.col("pos") != 0)


def stock_positions(positions: DataFrame) -> DataFrame:
    return non_zero_positions(positions).where((F.col("sec_type") == "STK") & (F.col("symbol") != "HYG"))


def strategy_column(strategy_id: str) -> str:
    return strategy_id.replace("-", "_")


def eligible_accounts(accounts: DataFrame, strategy_id: str, minimum: float = c.MIN_BALANCE) -> DataFrame:
    return accounts.where((F.col("balance") > minimum) & F.col(strategy_column(strategy_id)))


def account_balance(summary: DataFrame) -> DataFrame:
    """Net liquidation value in base currency per account, from its text form."""
    rows = summary.where((F.col("tag") == "NetLiquidationByCurrency") & (F.col("currency") == "BASE"))
    return rows.select("account", F.regexp_replace("value", ",", "").cast("float").alias("balance"))


def orders_today(orders: DataFrame, variant: str, **match: str) -> DataFrame:
    """Orders by day in the four query shapes of the order table.

    ``signal``: newest three of each ticker; ``type``: all of each ticker, newest first
    rank; ``only_type``: one order type; ``ticker``: one signal id.
    """
    tagged = orders.withColumn("day", day_of())
    if variant == "only_type":
        return of_type(tagged, match["order_type"])
    if variant == "ticker":
        return tagged.where(F.col("signal_id") == match["signal_id"])
    if variant == "signal":
        rank = F.row_number().over(Window.partitionBy("ticker", "day").orderBy(F.desc("ib_id")))
        return tagged.withColumn("rank", rank).where(F.col("rank") <= c.ROWS_PER_POSITION)
    return _ranked(tagged)


def _ranked(tagged: DataFrame) -> DataFrame:
    """Rank by newest id in each (ticker, day): inside ranges of the sorted orders, after the counts of the ranges before.

    The ranges come from a sample of the sort key, so they hold about equal numbers of orders however many a
    ticker-day has and however its ids are spread. They are stored, as both the counts and the ranks need the
    same ones. Orders without an id come last, the newest first.
    """
    key = ["ticker", "day"]
    newest = [F.desc_nulls_last("ib_id"), F.desc_nulls_last("date")]
    dealt = tagged.repartitionByRange(*key, *newest).withColumn("_range", F.spark_partition_id())
    dealt = stage(dealt, "ranges")
    before = Window.partitionBy(*key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*key, "_range").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(name).alias(f"_of_{name}") for name in (*key, "_range")],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
    )
    inside = F.row_number().over(Window.partitionBy(*key, "_range").orderBy(*newest))
    same = F.lit(True)
    for name in (*key, "_range"):
        same = same & F.col(name).eqNullSafe(F.col(f"_of_{name}"))
    numbered = dealt.withColumn("_inside", inside).join(starts, same)
    return numbered.select(*tagged.columns, (F.col("_start") + F.col("_inside")).cast("int").alias("rank"))


def latest_three_orders(orders: DataFrame) -> DataFrame:
    """Newest three unprocessed orders per ticker and day."""
    newest = Window.partitionBy("ticker", "day").orderBy(F.desc("date"), F.desc("ib_id"))
    return (
        working_orders(orders)
        .withColumn("day", day_of())
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= c.ROWS_PER_POSITION)
    )


def first_per_key(rows: DataFrame, key: Sequence[str], newest: str, tie: str) -> DataFrame:
    """Newest row per key; combines before the shuffle."""
    rest = [name for name in rows.columns if name not in key]
    pick = F.max_by(F.struct(*rest), F.struct(newest, tie)).alias("_row")
    return rows.groupBy(*key).agg(pick).select(*key, "_row.*")


def max_order_id(orders: DataFrame) -> DataFrame:
    """Highest order id per day."""
    return orders.withColumn("day", day_of()).groupBy("day").agg(F.coalesce(F.max("ib_id"), F.lit(0)).alias("last_id"))


def tickers_with_orders(orders: DataFrame) -> DataFrame:
    return orders.select("ticker", day_of().alias("day")).distinct()


# --- fills --------------------------------------------------------------------------


def market_fills(orders: DataFrame) -> DataFrame:
    """Market order of each bracket: its fill price and time."""
    return of_type(orders, c.MARKET).groupBy("oca_group").agg(
        F.min_by("fill_price", "ib_id").alias("entry_price"), F.min_by("date", "ib_id").alias("entry_date")
    )


def with_entry(orders: DataFrame) -> DataFrame:
    return orders.join(market_fills(orders), "oca_group", "left")


def propagate_fills(orders: DataFrame, instructions: DataFrame, account: Column | None = None) -> DataFrame:
    """Fill price of filled instructions to the order with the same group and id.

    ``account`` limits it to the account whose fills drive the order table.
    """
    filled = instructions.where((F.col("order_status") == "filled") & (F.col("strategy_id") == "day-trade"))
    if account is not None:
        filled = filled.where(F.col("account") == account)
    fills = filled.groupBy("oca_group", F.col("cll_int_id").alias("ib_id")).agg(
        F.max_by("fill_price", F.struct("date", "instruction_id")).alias("_fill")
    )
    merged = orders.join(fills, ["oca_group", "ib_id"], "left")
    return merged.withColumn("fill_price", F.coalesce("_fill", "fill_price")).drop("_fill")


# --- adjustments --------------------------------------------------------------------


def _with_market(orders: DataFrame, bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    newest = latest_bar(bars).select("ticker", F.col("close").alias("last_price"), *columns)
    return spread_join(orders, newest, ["ticker"], ["ib_id"], "left")


def _with_params(orders: DataFrame, params: DataFrame) -> DataFrame:
    """Parameters of the position an exit order belongs to: the opposite side."""
    keyed = orders.withColumnsRenamed({"action": "exit_action", "signal_id": "strategy"}).withColumn(
        "action", F.when(F.col("exit_action") == "BUY", F.lit("sell")).otherwise(F.lit("buy"))
    )
    return spread_join(keyed, params, pp.KEY, ["ib_id"], "left")


def _ratio_above(part: str, whole: str, limit: Column) -> Column:
    """Whether part / whole is above the limit; over zero it is, unless part is zero too."""
    return F.when(F.col(whole) == 0, F.col(part) > 0).otherwise(F.try_divide(part, whole) > limit)


def adjust_stops(orders: DataFrame, bars: DataFrame, params: DataFrame, now: Column, in_session: Column) -> DataFrame:
    """New trailing percent of working stops, null where it stays.

    Outside the session, or after a fast move against the entry, the stop closes in; an
    old stop above its minimum is halved. Orders and bars after ``now`` are not seen.
    """
    known = F.col("date") <= now
    entered = _with_market(with_entry(orders.where(known)), bars.where(known), [])
    stops = _with_params(working_orders(of_type(entered, c.STOP)), params)
    half = 1 + pp.trail_percent(F.col("action")) / 100 / 2
    fast = F.when(F.col("exit_action") == "SELL", _ratio_above("entry_price", "last_price", half)).otherwise(
        _ratio_above("last_price", "entry_price", half)
    )
    aged = sf.minutes_between(F.col("date"), now) > F.col("trail_time")
    wide = F.col("trailing_percent") > pp.min_trail_percent(F.col("action"))
    new = (
        F.when(~in_session, F.lit(c.EMERGENCY_TRAIL))
        .when(F.col("entry_price").isNull(), F.lit(None))
        .when(fast, F.lit(c.EMERGENCY_TRAIL))
        .when(aged & wide, F.col("trailing_percent") * 0.5)
    )
    return stops.select("ib_id", "ticker", "trailing_percent", new.alias("new_trailing"))


def adjust_limits(orders: DataFrame, bars: DataFrame, params: DataFrame, now: Column) -> DataFrame:
    """New price of working profit limits, null where it stays.

    In order: in profit and old enough, predicted to stop out, not at the price that the
    entry fill calls for. Orders and bars after ``now`` are not seen.
    """
    known = F.col("date") <= now
    entered = _with_market(
        with_entry(orders.where(known)), bars.where(known), [F.col("low_stop").alias("bar_low_stop"), F.col("high_stop").alias("bar_high_stop")]
    )
    limits = _with_params(working_orders(of_type(entered, c.LIMIT)), params)
    sells = F.col("exit_action") == "SELL"
    last, entry = F.col("last_price"), F.col("entry_price")
    near = sf.scaled_round(last * F.when(sells, F.lit(c.NEAR_LIMIT_SELL)).otherwise(F.lit(c.NEAR_LIMIT_BUY)), 2)
    percent = pp.limit_percent(F.col("action"))
    right = sf.scaled_round(entry * F.when(sells, percent).otherwise(1 - (percent - 1)), 2)
    in_profit = F.when(sells, last > entry).otherwise(last < entry)
    aged = sf.minutes_between(F.col("entry_date"), now) > pp.limit_minutes()
    predicted = F.when(sells, F.col("bar_high_stop")).otherwise(F.col("bar_low_stop"))
    new = (
        F.when(in_profit & aged, near)
        .when(predicted, near)
        .when(~right.eqNullSafe(F.col("trailing_percent")) & entry.isNotNull(), right)
    )
    return limits.select("ib_id", "ticker", "trailing_percent", new.alias("new_limit"))


def expire_market_orders(orders: DataFrame, now: Column, seconds: int = c.MARKET_ORDER_SECONDS) -> DataFrame:
    late = (F.col("order_type") == c.MARKET) & F.col("ib_status").isNull() & (
        F.col("date") < now - F.expr(f"INTERVAL {seconds} SECONDS")
    )
    return orders.withColumn("ib_status", F.when(late, F.lit("expired")).otherwise(F.col("ib_status")))


def _newest(names: list[str]) -> Column:
    """Newest values of a group of update columns that were set together; reports without them leave them be."""
    values = F.struct(*names)
    given = F.greatest(*[F.col(n).isNotNull() for n in names]) if len(names) > 1 else F.col(names[0]).isNotNull()
    return F.max_by(values, F.when(given, F.struct(F.col("event_time"), values)))


def apply_order_updates(orders: DataFrame, updates: DataFrame) -> DataFrame:
    """Newest report of each kind per order: its status, its traded price, and its date with the trailing percent.

    A report that carries one kind of value leaves the others as they were.
    """
    newest = updates.groupBy("ib_id").agg(
        _newest(["status"])["status"].alias("_status"),
        _newest(["traded_price"])["traded_price"].alias("_price"),
        _newest(["new_date", "new_trailing"]).alias("_move"),
    )
    merged = orders.join(newest, "ib_id", "left")
    moved = F.col("_move.new_date").isNotNull()
    old_price = F.col("traded_price") if "traded_price" in orders.columns else F.lit(None).cast("double")
    return merged.withColumns(
        {
            "ib_status": F.coalesce("_status", "ib_status"),
            "traded_price": F.coalesce(F.col("_price"), old_price),
            "trailing_percent": F.when(moved, F.col("_move.new_trailing")).otherwise(F.col("trailing_percent")),
            "date": F.coalesce("_move.new_date", "date"),
        }
    ).drop("_status", "_price", "_move")


# --- instructions -------------------------------------------------------------------


def calculate_quantity(balance: Column, action: Column, last_close: Column, trail: Column) -> Column:
    """Shares for one trade: the budget over the distance to the stop."""
    budget = balance * c.BALANCE_SHARE / c.TRADES_PER_MONTH
    buy = last_close - last_close * F.coalesce(trail, F.lit(c.DEFAULT_STOP_BUY))
    sell = last_close * F.coalesce(1 + (1 - trail), F.lit(c.DEFAULT_STOP_SELL)) - last_close
    return F.try_divide(budget, F.when(action == "BUY", buy).otherwise(sell))


def _instruction(account: Account) -> dict[str, Column]:
    return {
        "account": F.lit(account.name),
        "order_status": F.lit("new"),
        "strategy_id": F.lit("day-trade"),
        "cll_int_id": F.col("ib_id"),
        "symbol": F.col("ticker"),
        "sec_type": F.lit("STK"),
        "currency": F.lit("USD"),
        "buy_or_sell": F.col("action"),
        "transmit": F.lit(True),
        "tif": F.lit("DAY"),
        "oca_group": F.col("oca_group"),
        "conids": F.col("conid").cast("string"),
        "date": F.col("date"),
    }


def open_orders_to_instructions(orders: DataFrame, params: DataFrame, account: Account, now: Column) -> DataFrame:
    """Market orders older than 30 seconds become open instructions; younger ones wait."""
    market = of_type(orders, c.MARKET).where(F.col("date") < now - F.expr(f"INTERVAL {c.OPEN_DELAY_SECONDS} SECONDS"))
    trails = params.select("ticker", "action", "strategy", "trail_percent")
    keyed = market.withColumns({"strategy": F.col("signal_id"), "_side": F.lower("action")})
    keyed = spread_join(keyed, trails.withColumnRenamed("action", "_side"), ["ticker", "_side", "strategy"], ["ib_id"], "left")
    shares = calculate_quantity(F.lit(account.balance), F.col("action"), F.col("last_close"), F.col("trail_percent"))
    whole = F.when(shares >= 0, F.floor(shares)).otherwise(F.ceil(shares))
    return keyed.select(
        *[value.alias(name) for name, value in _instruction(account).items()],
        F.lit("open stock").alias("signal_id"),
        F.lit("MKT").alias("order_type"),
        (whole * account.multiplier).cast("bigint").alias("quantity"),
        F.lit(None).cast("double").alias("limit_price"),
        F.lit(None).cast("double").alias("stop_price"),
    )


def open_quantities(instructions: DataFrame) -> DataFrame:
    """Quantity of the market instruction per bracket, account and day."""
    return (
        of_type(instructions, "MKT")
        .withColumn("day", day_of())
        .groupBy("oca_group", "account", "day")
        .agg(F.max_by("quantity", F.struct("date", "cll_int_id")).alias("open_quantity"))
    )


def close_orders_to_instructions(orders: DataFrame, instructions: DataFrame, account: Account) -> DataFrame:
    """Stop and limit orders become close instructions of the opened quantity."""
    exits = orders.where(F.col("order_type").isin(c.STOP, c.LIMIT)).withColumns(
        {"day": day_of(), "account": F.lit(account.name)}
    )
    keyed = exits.join(open_quantities(instructions), ["oca_group", "account", "day"])
    takes = F.col("order_type") == c.LIMIT
    shape = {**_instruction(account), "account": F.col("account")}
    return keyed.select(
        *[value.alias(name) for name, value in shape.items()],
        F.lit("close stock").alias("signal_id"),
        F.when(takes, F.lit("LMT")).otherwise(F.lit("STP")).alias("order_type"),
        F.col("open_quantity").alias("quantity"),
        F.when(takes, F.col("trailing_percent")).alias("limit_price"),
        F.when(~takes, F.col("trailing_percent")).alias("stop_price"),
    )


def make_instructions(orders: DataFrame, params: DataFrame, account: Account, now: Column) -> DataFrame:
    opened = open_orders_to_instructions(orders, params, account, now)
    return opened.unionByName(close_orders_to_instructions(orders, opened, account))


def fix_quantity(instructions: DataFrame, positions: DataFrame) -> DataFrame:
    """Corrective market instructions where the position differs from the filled quantity."""
    filled = instructions.where(F.col("order_status") == "filled")
    key = ["account", "symbol", "fill_price"]
    newest = first_per_key(filled.withColumn("day", day_of()), [*key, "day"], "date", "instruction_id")
    held = positions.select("account", "symbol", "pos", F.col("traded_price").alias("fill_price"))
    wrong = newest.join(held, key).where(F.abs("pos") != F.col("quantity"))
    opposite = F.when(F.col("buy_or_sell") == "BUY", F.lit("SELL")).otherwise(F.lit("BUY"))
    return wrong.select(
        "account",
        "symbol",
        "instruction_id",
        F.lit("new").alias("order_status"),
        F.lit("fix quantity").alias("signal_id"),
        F.lit("MKT").alias("order_type"),
        opposite.alias("buy_or_sell"),
        (F.abs("pos") - F.col("quantity")).alias("quantity"),
        F.concat("oca_group", F.lit("_error")).alias("oca_group"),
    )


INSTRUCTION_KEY = ["symbol", "strategy_id", "cll_int_id", "account", "day"]


def written(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Incoming instructions that are stored already."""
    return incoming.join(stored.select(*INSTRUCTION_KEY).distinct(), INSTRUCTION_KEY, "left_semi")


def latest_status(instructions: DataFrame) -> DataFrame:
    """Newest status per instruction key and whether it is final."""
    status = F.max_by("order_status", F.struct("date", "instruction_id")).alias("order_status")
    grouped = instructions.groupBy(*INSTRUCTION_KEY).agg(status)
    return grouped.withColumn("terminal", F.col("order_status").isin(*TERMINAL))


def upsert_instructions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert unknown instructions; cancel or re-price known ones that are not final."""
    rest = [name for name in stored.columns if name not in INSTRUCTION_KEY]
    old = stored.select(*INSTRUCTION_KEY, F.struct(*rest).alias("_old"))
    new = incoming.select(*INSTRUCTION_KEY, F.struct(*rest).alias("_new"))
    both = old.join(new, INSTRUCTION_KEY, "full_outer")
    live = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.coalesce(
        F.col("_old.order_status").isin(*TERMINAL), F.lit(False)
    )
    cancel = live & (F.lower("_new.order_status") == "canceled")

    def reprice(kind: str, price: str):
        differs = ~F.col(f"_old.{price}").eqNullSafe(F.col(f"_new.{price}"))
        fresh = (F.col("_new.order_status") == "new") & (F.col("_new.order_type") == kind)
        return live & (F.col("strategy_id") == "day-trade") & fresh & differs

    limit, stop = reprice("LMT", "limit_price"), reprice("STP", "stop_price")
    changes = {
        "order_status": F.when(cancel, F.lit("canceled")).when(limit | stop, F.lit("new")),
        "limit_price": F.when(limit, F.col("_new.limit_price")),
        "stop_price": F.when(stop, F.col("_new.stop_price")),
    }
    base = {name: F.when(F.col("_old").isNull(), F.col(f"_new.{name}")).otherwise(F.col(f"_old.{name}")) for name in rest}
    for name, value in changes.items():
        base[name] = F.coalesce(value, base[name])
    return both.select(*INSTRUCTION_KEY, *[value.alias(name) for name, value in base.items()])


def status_update(instructions: DataFrame, feed: DataFrame) -> DataFrame:
    """Newest reported status, fill price and broker id per instruction; a report without one leaves it be."""
    fields = ["status", "new_fill_price", "new_ib_id"]
    newest = feed.groupBy("instruction_id").agg(*[_newest([name])[name].alias(name) for name in fields])
    merged = instructions.join(newest, "instruction_id", "left")
    return merged.withColumns(
        {
            "order_status": F.coalesce("status", "order_status"),
            "db_status": F.coalesce("status", "db_status"),
            "fill_price": F.coalesce("new_fill_price", "fill_price"),
            "ib_id": F.coalesce("new_ib_id", "ib_id"),
        }
    ).drop(*fields)


def status_to_fill(orders: DataFrame, instructions: DataFrame, feed: DataFrame) -> DataFrame:
    """Instructions that turn filled hand their fill price to the order table."""
    updated = status_update(instructions, feed)
    turned = feed.where(F.col("status") == "filled").select("instruction_id").distinct()
    return propagate_fills(orders, updated.join(turned, "instruction_id", "left_semi"))


# --- executions ---------------------------------------------------------------------


def execution_rows(reports: DataFrame) -> DataFrame:
    """Nested broker reports (``contract``, ``execution``) to flat execution rows."""
    return reports.select(
        F.col("order_id").alias("ib_id"),
        "contract.symbol",
        F.col("contract.sec_type").alias("security_type"),
        "contract.currency",
        F.col("execution.exec_id").alias("execution_id"),
        "execution.account",
        F.col("execution.side").alias("buy_or_sell"),
        "execution.quantity",
        "execution.price",
        F.col("execution.cum_quant").alias("cum_quantity"),
        F.col("execution.avg_price").alias("average_price"),
        "date",
    )


def commission_rows(reports: DataFrame) -> DataFrame:
    return reports.select(
        F.col("exec_id").alias("execution_id"),
        "commission",
        sf.sentinel_to_null(F.col("realized_pnl")).alias("realized_profit_loss"),
        sf.sentinel_to_null(F.col("bond_yield")).alias("yield"),
        "date",
    )


def instruction_for_order(executions: DataFrame, instructions: DataFrame) -> DataFrame:
    """Instruction behind each execution: same account and broker id."""
    known = instructions.select("account", "ib_id", "instruction_id", "signal_id", "strategy_id", "db_status")
    return spread_join(executions, known, ["account", "ib_id"], ["execution_id"], "left", measured=executions)


def upsert_executions(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new executions; known ones take quantity, price and running totals.

    Both sides are first reduced to the newest row per id, before the shuffle.
    """
    fields = ["quantity", "price", "cum_quantity", "average_price"]
    rest = [name for name in stored.columns if name != "execution_id"]
    old = stored.groupBy("execution_id").agg(F.max_by(F.struct(*rest), F.struct("date", *fields)).alias("_old"))
    new = incoming.groupBy("execution_id").agg(F.max_by(F.struct(*rest), F.struct("date", *fields)).alias("_new"))
    both = old.join(new, "execution_id", "full_outer")

    def value(name: str) -> Column:
        first, second = ("_new", "_old") if name in fields else ("_old", "_new")
        known = F.col(first).isNotNull()
        return F.when(known, F.col(f"{first}.{name}")).otherwise(F.col(f"{second}.{name}")).alias(name)

    return both.select("execution_id", *[value(name) for name in rest])


def executions_with_commissions(executions: DataFrame, commissions: DataFrame) -> DataFrame:
    """Executions with commission and realized profit, in whatever order they came."""
    figures = ["commission", "realized_profit_loss", "yield"]
    newest = commissions.groupBy("execution_id").agg(F.max_by(F.struct(*figures), F.struct("date", *figures)).alias("_c"))
    return executions.join(newest.select("execution_id", "_c.*"), "execution_id", "left")


def pnl_per_account(executions: DataFrame) -> DataFrame:
    return executions.groupBy("account").agg(
        F.count(F.lit(1)).alias("executions"),
        F.sum("commission").alias("commission"),
        F.sum("realized_profit_loss").alias("realized_profit_loss"),
    )


# --- reconciliation -----------------------------------------------------------------


def _marked(rows: DataFrame, table: DataFrame, key: Sequence[str], flag: str) -> DataFrame:
    known = table.select(*key).distinct().withColumn(flag, F.lit(True))
    return rows.join(known, list(key), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def _live(orders: DataFrame) -> DataFrame:
    return orders.where(~F.col("status").isin("filled", "cancelled"))


def mark_position(instructions: DataFrame, positions: DataFrame) -> DataFrame:
    """Flag ``has_position``: same account, symbol and size; options also by contract."""
    option = F.col("sec_type") == "OPT"
    terms = F.concat_ws("|", F.col("strike").cast("string"), "put_or_call", "expire")
    contract = F.when(option, terms).otherwise(F.lit(""))
    key = ["account", "symbol", "quantity", "sec_type", "_contract"]
    held = positions.withColumns({"quantity": F.abs("pos"), "_contract": contract})
    return _marked(instructions.withColumn("_contract", contract), held, key, "has_position").drop("_contract")


def mark_open_order(instructions: DataFrame, orders: DataFrame) -> DataFrame:
    """Flag ``has_open_order``: a live order of the same account, symbol, type and size."""
    return _marked(instructions, _live(orders), ["account", "symbol", "order_type", "quantity"], "has_open_order")


def mark_close_order(instructions: DataFrame, orders: DataFrame) -> DataFrame:
    """Flag ``has_close_order``, also by broker id; stops are sent as trailing orders."""
    sent = F.when(F.col("order_type") == "STP", F.lit("TRAIL")).otherwise(F.lit("LMT"))
    key = ["account", "symbol", "_sent", "quantity", "ib_id"]
    live = _live(orders).withColumnRenamed("order_type", "_sent")
    return _marked(instructions.withColumn("_sent", sent), live, key, "has_close_order").drop("_sent")


def instruction_precheck(instructions: DataFrame, positions: DataFrame, orders: DataFrame) -> DataFrame:
    """What to do with each instruction: execute, reset the broker id, or nothing."""
    state = mark_close_order(mark_open_order(mark_position(instructions, positions), orders), orders)
    held, live, closing = F.col("has_position"), F.col("has_open_order"), F.col("has_close_order")
    stock = F.col("sec_type") == "STK"
    entry_ok = F.when(stock & (F.col("symbol") == "HYG"), held).otherwise(~held) & ~live
    exit_step = F.when(F.col("ib_id").isNull() | closing, F.lit("execute")).otherwise(F.lit("reset id"))
    step = (
        F.when((F.col("order_type") == "MKT") & entry_ok, F.lit("execute"))
        .when((F.col("order_type") != "MKT") & stock & held, exit_step)
        .when((F.col("order_type") == "LMT") & ~stock & ~live, F.lit("execute"))
        .otherwise(F.lit("none"))
    )
    return state.select("instruction_id", "order_type", step.alias("step"))


def best_limit_price(quotes: DataFrame) -> DataFrame:
    """Limit price against the standing quote, and whether it is sent.

    Needs action, symbol, limit_price (nullable), bid, ask and multiplier.
    """
    buys = F.col("action") == "BUY"
    limit = F.coalesce("limit_price", F.when(buys, F.col("bid")).otherwise(F.col("ask")))
    clamped = F.when(buys, F.least(limit, F.col("bid"))).otherwise(F.greatest(limit, F.col("ask")))
    trade = clamped * F.col("multiplier")
    middle = (F.col("ask") + F.col("trade_price")) / 2
    special = F.when(~buys, F.least("trade_price", "ask")).otherwise(F.greatest("trade_price", "bid"))
    accepted = F.when(buys, F.col("trade_price") <= middle).otherwise(F.col("trade_price") >= middle)
    is_special = F.col("symbol") == "HYG"
    return quotes.withColumn("trade_price", trade).withColumns(
        {
            "sent": is_special | accepted,
            "sent_price": F.when(is_special, special).when(accepted, F.col("trade_price")),
        }
    )


def order_state(events: DataFrame) -> DataFrame:
    """Current state per order from its add, status, fill and sync events.

    Status, fill price and stored status each keep their newest value.
    """

    def newest(column: str, when: Column) -> Column:
        return F.max_by(column, F.when(when, F.struct("event_time", column)))

    status = newest("status", F.col("status").isNotNull())
    fill = newest("fill_price", F.col("fill_price").isNotNull())
    return events.groupBy("order_id").agg(
        status.alias("status"),
        fill.alias("fill_price"),
        newest("db_status", F.col("db_status").isNotNull()).alias("db_status"),
        F.count(F.lit(1)).alias("events"),
    )


EVENT_KINDS = ("add", "status", "fill", "sync", "remove")


def order_registry(events: DataFrame, instructions: DataFrame) -> DataFrame:
    """Open orders after all events, each with the instruction it was added by.

    ``events`` has ``order_id, account, kind, event_time, status, fill_price`` with the kinds of
    ``EVENT_KINDS``; ``instructions`` has versions ``account, ib_id, changed_at, instruction_id, signal_id,
    strategy_id, order_status``. An add takes the newest version of its order's instruction that is no newer
    than itself; without one, or while the order is open, it does nothing. Status and fill events set their
    value, null included; a sync stores the status of its time; a remove ends the order until the next add. All
    but adds are ignored for an order that is not open. At equal times kinds apply in the order of
    ``EVENT_KINDS``, equal ones by their greatest value. Nothing is gathered by order: each step is an aggregate
    that combines before the shuffle.
    """
    rank = F.array_position(F.array(*[F.lit(kind) for kind in EVENT_KINDS]), F.col("kind"))
    known = events.where(F.col("kind").isin(*EVENT_KINDS) & F.col("order_id").isNotNull() & F.col("event_time").isNotNull())
    known = known.withColumn("_at", F.struct(F.col("event_time").alias("time"), rank.alias("rank")))
    # Removes end what came before; a remove of an order that is not open changes nothing either.
    ended = known.where(F.col("kind") == "remove").groupBy("order_id").agg(F.max("_at").alias("_ended"))
    adds = spread_join(known.where(F.col("kind") == "add"), ended, ["order_id"], ["event_time"], "left", measured=known)
    adds = adds.where(F.col("_ended").isNull() | (F.col("_at") > F.col("_ended")))
    versions = instructions.select(
        F.col("ib_id").alias("order_id"), "account", F.col("changed_at").alias("_changed"),
        F.struct("instruction_id", "signal_id", "strategy_id", "order_status").alias("_instruction"),
    )
    first_known = versions.groupBy("order_id", "account").agg(F.min("_changed").alias("_changed"))
    # The first add that finds an instruction opens the order; only then its version is looked up.
    found = adds.join(first_known, ["order_id", "account"]).where(F.col("_changed") <= F.col("event_time"))
    opened = found.groupBy("order_id").agg(
        F.min(F.struct("_at", "account", "status")).alias("_open")
    ).select("order_id", "_open.account", F.col("_open._at").alias("_opened"), F.col("_open.status").alias("_status"))
    by = (
        opened.join(versions, ["order_id", "account"])
        .where(F.col("_changed") <= F.col("_opened.time"))
        .groupBy("order_id", "account", "_opened", "_status")
        .agg(F.max(F.struct("_changed", "_instruction")).alias("_newest"))
        .select("order_id", "account", "_opened", "_status", "_newest._instruction")
    )
    later = spread_join(known.drop("account"), by.select("order_id", "_opened"), ["order_id"], ["event_time"], measured=known)
    later = later.where((F.col("_at") > F.col("_opened")) & F.col("kind").isin("status", "fill", "sync"))
    synced = later.where(F.col("kind") == "sync").groupBy("order_id").agg(F.max("_at").alias("_synced"))
    later = spread_join(later.drop("_opened"), synced, ["order_id"], ["event_time"], "left", measured=known)

    def newest(column: str, when: Column) -> Column:
        return F.max(F.when(when, F.struct("_at", column)))

    is_status = F.col("kind") == "status"
    state = later.groupBy("order_id").agg(
        newest("status", is_status).alias("_now"),
        newest("status", is_status & (F.col("_at") < F.col("_synced"))).alias("_stored"),
        newest("fill_price", F.col("kind") == "fill").alias("_fill"),
        F.max("_synced").alias("_synced"),
        F.count(F.lit(1)).alias("_events"),
    )

    def after(name: str, value: str, otherwise: Column) -> Column:
        return F.when(F.col(name).isNotNull(), F.col(f"{name}.{value}")).otherwise(otherwise)

    return by.join(state, "order_id", "left").select(
        "order_id",
        "account",
        "_instruction.instruction_id",
        "_instruction.signal_id",
        "_instruction.strategy_id",
        F.col("_opened.time").alias("opened_at"),
        after("_now", "status", F.col("_status")).alias("status"),
        F.col("_fill.fill_price").alias("fill_price"),
        F.when(F.col("_synced").isNotNull(), after("_stored", "status", F.col("_status")))
        .otherwise(F.col("_instruction.order_status"))
        .alias("db_status"),
        F.coalesce("_events", F.lit(0)).alias("events"),
    )


def status_changes(states: DataFrame) -> DataFrame:
    """Orders whose status is not stored yet; final ones leave the registry."""
    changed = states.where(~F.col("status").eqNullSafe(F.col("db_status")))
    return changed.withColumn("removed", F.coalesce(F.col("status").isin("filled", "cancelled"), F.lit(False)))


def merge_pending(new: DataFrame, pending: DataFrame) -> DataFrame:
    return new.unionByName(pending).distinct()
