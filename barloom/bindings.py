"""The reference tables of the jobs, derived by Spark from the supplied Parquet tables.

``catalog/ctes.py`` states the same derivations in SQL for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators import bars as bb
from barloom.operators import features as ff
from barloom.operators import labels as ll
from barloom.operators import orders as oo
from barloom.operators import params as pp
from barloom.operators import signals as ss
from barloom.schemas import SessionSpec
from barloom.sources.stage import stage

SPEC = SessionSpec(bar="2 hours", bars_per_day=12, bars_per_period=2)
HALF_HOURS = SessionSpec(bar="30 minutes", bars_per_day=48, bars_per_period=8)
BENCHMARK, MARKET = "view", "click"
MARKET_SUPPLIER = 0


# the "now" of each source, just past its last row
EVENTS_NOW = "2024-01-31 00:00:00"
DAILY_NOW = "2001-11-10 00:00:00"


def moment(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- intraday -----------------------------------------------------------------------


def ticks(spark, sf_dir) -> DataFrame:
    return ticks_of(table(spark, sf_dir, "events"))


def ticks_of(events: DataFrame) -> DataFrame:
    price = F.col("value")
    return events.select(
        F.col("event_type").alias("ticker"),
        "ts",
        price.alias("open"),
        price.alias("high"),
        price.alias("low"),
        price.alias("close"),
        F.lit(1).cast("bigint").alias("volume"),
        F.lit(1).cast("bigint").alias("count"),
        "event_id",
        "user_id",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def bars(spark, sf_dir, width: str = "2 hours") -> DataFrame:
    return bb.bars_from_ticks(ticks(spark, sf_dir), width)


def minutes(spark, sf_dir) -> DataFrame:
    return bars(spark, sf_dir, "1 minute")


def members(spark, sf_dir) -> DataFrame:
    """Benchmark of every intraday ticker."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker")).distinct()
    return names.withColumn("benchmark", F.lit(BENCHMARK))


def technical_params(spark, sf_dir) -> DataFrame:
    """Strategy parameters as JSON, one row per ticker, strategy and action."""
    names = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol")).distinct()
    rows = names.withColumn("strategy", F.explode(F.array(*map(F.lit, c.STRATEGIES)))).withColumn(
        "action", F.explode(F.array(*map(F.lit, c.ACTIONS)))
    )
    size = F.length("symbol")
    trend, buy = F.col("strategy") == "trend", F.col("action") == "buy"

    def pick(trend_buy, trend_sell, other_buy, other_sell) -> Column:
        return F.when(trend & buy, F.lit(trend_buy)).when(trend, F.lit(trend_sell)).when(buy, F.lit(other_buy)).otherwise(
            F.lit(other_sell)
        )

    band = F.when(size != 6, size.cast("double"))
    with_ml = size != 4
    fields = {
        "benchmark_negative": F.when(buy, -band).otherwise(band),
        "benchmark_positive": F.when(buy, band).otherwise(-band),
        "limit_price": pick(6.0, 0.5, 8.0, 0.7),
        "limit_time": F.lit(60),
        "limit_trades": F.when(size != 4, F.lit(1)),
        "min_trail_percent": pick(0.6, 1.6, 0.7, 1.4),
        "stop_trades": F.when(size != 5, F.lit(2)),
        "trail_percent": F.when(size != 8, pick(0.98, 1.02, 0.97, 1.03)),
        "trail_time": F.lit(30),
        "high_delta": F.when(with_ml, buy),
        "low_delta": F.when(with_ml, ~buy),
        "low_stop": F.when(with_ml, trend != buy),
        "high_stop": F.when(with_ml, trend == buy),
        "spy": size == 5,
    }
    packed = F.to_json(F.struct(*[value.alias(name) for name, value in fields.items()]))
    return rows.select(
        "symbol",
        F.lit("minute").alias("time_frame"),
        "strategy",
        "action",
        packed.alias("technical_params"),
        (size != 6).alias("performance"),
    )


def params(spark, sf_dir) -> DataFrame:
    """Parsed parameters by ticker, action and strategy."""
    parsed = pp.parse_params(technical_params(spark, sf_dir))
    return parsed.drop("time_frame").withColumnRenamed("symbol", "ticker")


def bounded_params(spark, sf_dir) -> DataFrame:
    """Parsed parameters with the volume bounds of their ticker."""
    bounds = ff.volume_bounds(bars(spark, sf_dir))
    joined = pp.scan_params(pp.parse_params(technical_params(spark, sf_dir)), bounds)
    return joined.drop("time_frame")


def prepared(spark, sf_dir) -> DataFrame:
    source = bars(spark, sf_dir)
    return ff.prepare_features(source, ff.volume_bounds(source), SPEC)


def benchmark(spark, sf_dir, ticker: str, name: str) -> DataFrame:
    return ff.benchmark_features(bars(spark, sf_dir).where(F.col("ticker") == ticker), name)


def features(spark, sf_dir) -> DataFrame:
    """Prepared bars with benchmark features, one row per action, tagged by strategy."""
    attached = ff.attach_benchmarks(
        prepared(spark, sf_dir),
        members(spark, sf_dir),
        benchmark(spark, sf_dir, BENCHMARK, "benchmark"),
        benchmark(spark, sf_dir, MARKET, "spy"),
    )
    actions = technical_params(spark, sf_dir).select(F.col("symbol").alias("ticker"), "action")
    return ff.with_actions(attached, actions)


def labelled(spark, sf_dir) -> DataFrame:
    """Features with the parameters of their strategy and their labels."""
    wanted = ["benchmark_negative", "benchmark_positive", "limit_price", "min_trail_percent", "spy"]
    keyed = pp.attach_params(features(spark, sf_dir), params(spark, sf_dir).select(*pp.KEY, *wanted))
    return ll.with_benchmark_delta(ll.with_difference(ll.label_data(keyed)))


def coarse(spark, sf_dir) -> DataFrame:
    """Stored labelled rows with deltas in halves and volume in tenths: two-hour bars move
    far more than five-minute bars, and values must repeat."""
    steps = {"open_delta": 2, "benchmark_delta": 2, "volume_delta": 10}
    rows = labelled(spark, sf_dir)
    return stage(rows.withColumns({n: F.floor(F.col(n) * k) / k for n, k in steps.items()}), "labelled")


# --- signals and orders from ticks --------------------------------------------------


def order_signals(spark, sf_dir) -> DataFrame:
    """Every tick as an entry signal; side, strategy and fills follow its fields."""
    return ticks(spark, sf_dir).select(
        F.col("ts").alias("date"),
        "ticker",
        F.when(F.col("k") % 2 == 0, F.lit("buy")).otherwise(F.lit("sell")).alias("side"),
        F.when(F.col("close") > 40, F.lit("trend")).otherwise(F.lit("correction")).alias("strategy"),
        F.col("close").alias("last_close"),
        F.col("event_id").alias("signal_no"),
        F.col("user_id").alias("conid"),
        "k",
    )


def brackets(spark, sf_dir) -> DataFrame:
    keyed = order_signals(spark, sf_dir).withColumnRenamed("side", "action")
    joined = pp.attach_params(keyed, params(spark, sf_dir))
    return ss.bracket_orders(joined.withColumn("action", F.upper("action")))


def day_orders(spark, sf_dir) -> DataFrame:
    """Bracket orders with fills and status derived from the order id and price."""
    kind, step = F.col("order_type"), F.floor(F.col("last_close") * 100).cast("bigint") % 4
    fill = (
        F.when(kind == c.MARKET, F.col("last_close"))
        .when((kind == c.STOP) & (step == 1), F.col("last_close") * 0.99)
        .when((kind == c.LIMIT) & (step == 2), F.col("last_close") * 1.01)
    )
    status = F.when(kind == c.MARKET, F.when(step != 3, F.lit("filled"))).when(fill.isNotNull(), F.lit("filled"))
    return brackets(spark, sf_dir).withColumns({"fill_price": fill, "ib_status": status})


def live_bars(spark, sf_dir) -> DataFrame:
    """Bars with signals, predictions and benchmark trend, as the live table has them."""
    return live_columns(prepared(spark, sf_dir))


def live_columns(source: DataFrame) -> DataFrame:
    odd = F.col("volume") % 2 == 1
    third = F.col("volume") % 3
    return source.withColumns(
        {
            "buy_signal": F.col("close") > F.col("open"),
            "sell_signal": F.col("close") < F.col("open"),
            "high_delta": F.when(third != 0, odd),
            "low_delta": F.when(third != 0, ~odd),
            "high_stop": F.when(third != 1, odd),
            "low_stop": F.when(third != 1, ~odd),
            "benchmark_trend": F.when(third != 2, F.col("volume") % 4 != 0),
        }
    )


# --- daily --------------------------------------------------------------------------


def _line_order() -> Column:
    """Order of the lines of a day as one number, so that the bars hash-aggregate."""
    line = F.col("l_orderkey").cast("decimal(18,0)") * F.lit(10).cast("decimal(2,0)") + F.col("l_linenumber").cast("decimal(1,0)")
    cents = F.round(F.col("l_extendedprice") * 100).cast("decimal(11,0)")
    return line * F.lit(10**11).cast("decimal(12,0)") + cents


def daily(spark, sf_dir) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("ticker"),
        F.col("l_shipdate").alias("date"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        "l_quantity",
        _line_order().alias("at"),
    )
    return lines.groupBy("ticker", "date").agg(
        F.min_by("price", "at").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "at").alias("close"),
        F.sum("l_quantity").cast("bigint").alias("volume"),
        F.count(F.lit(1)).alias("count"),
    )


def trade_params(spark, sf_dir) -> DataFrame:
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    last = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.max("l_shipdate").alias("date"))
    return (
        table(spark, sf_dir, "supplier")
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(last, F.col("s_suppkey") == F.col("l_suppkey"), "left")
        .select(
            F.col("s_suppkey").alias("ticker"),
            F.col("r_name").alias("industry"),
            (F.col("s_suppkey") + 1000).alias("conid"),
            "date",
            (F.col("s_acctbal") > 0).alias("day_trade_buy"),
            (F.col("s_acctbal") < 5000).alias("day_trade_sell"),
            F.col("s_nationkey").alias("nation"),
            "s_acctbal",
        )
    )


def benchmark_utils(spark, sf_dir) -> DataFrame:
    return trade_params(spark, sf_dir).groupBy("industry").agg(
        F.min("ticker").alias("benchmark"), F.min("conid").alias("conid")
    )


def illiquid_list(spark, sf_dir) -> DataFrame:
    return trade_params(spark, sf_dir).where(F.col("nation").isin(3, 7)).select("ticker", "date")


def test_params(spark, sf_dir) -> DataFrame:
    """Back-test rows of every supplier, strategy and action."""
    step = F.when(F.col("strategy") == "trend", 0).otherwise(2) + F.when(F.col("action") == "buy", 0).otherwise(1)
    base = (
        trade_params(spark, sf_dir)
        .withColumn("strategy", F.explode(F.array(*map(F.lit, c.STRATEGIES))))
        .withColumn("action", F.explode(F.array(*map(F.lit, c.ACTIONS))))
        .withColumn("step", step)
    )
    nation = F.col("nation")
    return base.where((nation != 11) | (F.col("step") < 3)).select(
        F.col("ticker").alias("symbol"),
        F.lit("minute").alias("time_frame"),
        "strategy",
        "action",
        F.when(nation % 4 != 0, F.col("date")).alias("date"),
        F.when(nation % 5 != 1, (nation % 3 == 0)).alias("performance"),
        (F.col("s_acctbal") / 10000 + F.col("step") * 0.01).alias("algo_period_return"),
        (nation / 25.0).alias("spy_period_return"),
        F.when(nation != 9, (nation - 12) / 20.0).alias("beta"),
        (-(nation % 10) / 20.0).alias("max_drawdown"),
        F.when(nation >= 5, F.col("s_acctbal")).alias("combined_period_return"),
        F.when(nation % 2 == 0, F.col("s_acctbal") * 2).alias("portfolio_value"),
        F.when(nation % 3 == 0, F.col("s_acctbal") * 3).alias("portfolio_value_benchmark"),
        F.when(nation % 4 == 0, F.col("s_acctbal") * 4).alias("portfolio_value_ml"),
    )


def backtest_errors(spark, sf_dir) -> DataFrame:
    rows = trade_params(spark, sf_dir).where(F.col("nation").isin(5, 11, 17, 23))
    return rows.select(
        "ticker",
        F.when(F.col("nation") == 5, F.lit("trend")).when(F.col("nation") == 11, F.lit("reports")).alias("strategy"),
        F.when(F.col("nation") == 17, F.lit("combined")).otherwise(F.lit("ml")).alias("test_param"),
    )


# --- accounts, instructions, executions ---------------------------------------------


def accounts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("account"),
        (F.col("c_acctbal") * 10).alias("balance"),
        F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "FURNITURE").alias("day_trade"),
        (F.col("c_nationkey") % 3 + 1).alias("day_trade_multiplier"),
    )


def instructions(spark, sf_dir) -> DataFrame:
    kind = (
        F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit("MKT"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("LMT"))
        .otherwise(F.lit("STP"))
    )
    status = (
        F.when(F.col("o_orderstatus") == "F", F.lit("filled"))
        .when(F.col("o_orderstatus") == "O", F.lit("new"))
        .otherwise(F.lit("cancelled"))
    )
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    option = F.col("o_orderpriority") == "4-NOT SPECIFIED"
    return table(spark, sf_dir, "orders").select(
        key.alias("instruction_id"),
        F.col("o_custkey").alias("account"),
        F.col("o_orderdate").alias("date"),
        F.col("o_orderdate").cast("date").alias("day"),
        status.alias("order_status"),
        F.when(key % 7 != 0, status).alias("db_status"),
        kind.alias("order_type"),
        F.concat(F.lit("SYM"), F.expr("o_custkey div 100").cast("string")).alias("symbol"),
        F.when(key % 10 == 0, F.lit("day_trade")).otherwise(F.lit("day-trade")).alias("strategy_id"),
        F.when(option, F.lit("OPT")).otherwise(F.lit("STK")).alias("sec_type"),
        F.floor(price / 1000).cast("bigint").alias("quantity"),
        F.when(key % 2 == 0, F.lit("BUY")).otherwise(F.lit("SELL")).alias("buy_or_sell"),
        F.when(kind == "LMT", price).alias("limit_price"),
        F.when(kind == "STP", price).alias("stop_price"),
        F.when(F.col("o_orderstatus") == "F", price / 100).alias("fill_price"),
        F.concat(F.lit("oca"), key.cast("string")).alias("oca_group"),
        key.alias("cll_int_id"),
        F.when(key % 9 != 0, key).alias("ib_id"),
        F.when(option, F.floor(price / 10000)).alias("strike"),
        F.when(option, F.when(key % 2 == 0, F.lit("C")).otherwise(F.lit("P"))).alias("put_or_call"),
        F.when(option, F.lit("200112")).alias("expire"),
    )


def order_events(spark, sf_dir) -> DataFrame:
    """Adds, status reports, fills, syncs and removes of orders, from ticks."""
    k = F.col("k")
    kind = F.when(k % 5 == 0, "add").when(k % 29 == 1, "remove").when(k % 7 == 2, "sync").when(k % 3 == 0, "fill").otherwise("status")
    return status_reports(spark, sf_dir).select(
        "order_id",
        (F.col("order_id") % 3).alias("account"),
        kind.alias("kind"),
        "event_time",
        sf.order_status(F.col("text")).alias("status"),
        "fill_price",
    )


def instruction_versions(spark, sf_dir) -> DataFrame:
    """An instruction of each ordering customer and account, changed with each of the customer's ticks of a kind."""
    k = F.col("k")
    return status_reports(spark, sf_dir).where(k % 13 < 4).select(
        (F.col("order_id") % 3).alias("account"),
        F.col("order_id").alias("ib_id"),
        F.col("event_time").alias("changed_at"),
        (F.col("order_id") * 100 + k % 13).alias("instruction_id"),
        F.lit("open stock").alias("signal_id"),
        F.when(k % 2 == 0, "day-trade").otherwise("day_trade").alias("strategy_id"),
        F.when(k % 13 < 2, "new").otherwise("submitted").alias("order_status"),
    )


def positions(spark, sf_dir) -> DataFrame:
    """Positions left by the filled instructions of an account, symbol and contract."""
    filled = instructions(spark, sf_dir).where(F.col("order_status") == "filled")
    signed = F.when(F.col("buy_or_sell") == "BUY", F.col("quantity")).otherwise(-F.col("quantity"))
    return filled.groupBy("account", "symbol", "sec_type", "strike", "put_or_call", "expire").agg(
        F.sum(signed).alias("pos"), F.max("fill_price").alias("traded_price")
    )


def broker_orders(spark, sf_dir) -> DataFrame:
    """Orders as the broker lists them: stops go out as trailing."""
    return instructions(spark, sf_dir).select(
        F.col("instruction_id").alias("order_id"),
        "account",
        "symbol",
        F.when(F.col("instruction_id") % 4 == 0, F.col("order_type"))
        .when(F.col("order_type") == "STP", F.lit("TRAIL"))
        .otherwise(F.col("order_type"))
        .alias("order_type"),
        "quantity",
        "ib_id",
        F.when(F.col("order_status") == "new", F.lit("submitted")).otherwise(F.col("order_status")).alias("status"),
    )


def reports(spark, sf_dir) -> DataFrame:
    """Execution reports in the nested shape of the broker messages."""
    lines = table(spark, sf_dir, "lineitem")
    owners = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").alias("order_id"),
        F.struct(
            F.concat(F.lit("SYM"), F.expr("o_custkey div 100").cast("string")).alias("symbol"),
            F.lit("STK").alias("sec_type"),
            F.lit("USD").alias("currency"),
        ).alias("contract"),
        F.struct(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("exec_id"),
            F.col("o_custkey").alias("account"),
            F.when(F.col("l_linestatus") == "O", F.lit("BUY")).otherwise(F.lit("SELL")).alias("side"),
            F.col("l_quantity").alias("quantity"),
            price.alias("price"),
            F.col("l_quantity").alias("cum_quant"),
            price.alias("avg_price"),
        ).alias("execution"),
        F.col("l_shipdate").alias("date"),
    )


def executions(spark, sf_dir) -> DataFrame:
    return oo.execution_rows(reports(spark, sf_dir))


def commission_reports(spark, sf_dir) -> DataFrame:
    return commission_reports_of(table(spark, sf_dir, "lineitem"))


def commission_reports_of(lines: DataFrame) -> DataFrame:
    missing = F.lit(1.7976931348623157e308)
    gain = F.col("l_extendedprice") * F.col("l_tax")
    return lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("exec_id"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("commission"),
        F.when(F.col("l_tax") == 0, missing).otherwise(gain).alias("realized_pnl"),
        F.when(F.col("l_returnflag") != "R", missing).otherwise(F.col("l_tax")).alias("bond_yield"),
        F.col("l_shipdate").alias("date"),
    )


def quotes(spark, sf_dir) -> DataFrame:
    """Ticks as quotes: field 1 bid, field 2 ask."""
    return ticks(spark, sf_dir).select(
        F.col("ticker").alias("contract"),
        "ts",
        (F.col("k") % 2 + 1).alias("field"),
        F.col("close").alias("price"),
    )


def status_reports(spark, sf_dir) -> DataFrame:
    """Broker status text per order, from ticks."""
    return status_reports_of(ticks(spark, sf_dir))


def status_reports_of(source: DataFrame) -> DataFrame:
    k = F.col("k")
    text = F.element_at(F.array(*[F.lit(name) for name in c.BROKER_STATUS]), (k % 8 + 1).cast("int"))
    return source.select(
        F.col("user_id").alias("order_id"),
        F.col("ts").alias("event_time"),
        F.when(k % 11 == 0, F.lit("Unknown")).otherwise(text).alias("text"),
        F.when(k % 3 == 0, F.lit(0.0)).otherwise(k.cast("double")).alias("remaining"),
        sf.scaled_round(F.col("close"), 1).alias("fill_price"),
        "k",
    )


