"""Entry signals, position gate and bracket orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import conditions as cond
from barloom.functions import scalars as sf
from barloom.operators import params as pp
from barloom.operators.features import strategy_of
from barloom.operators.series import day_of, spread_join

BY_DAY = ["ticker", "day"]


def permissions(params: DataFrame) -> DataFrame:
    """Parameters with the label permissions renamed to ``allow_*``."""
    return params.withColumnsRenamed({name: f"allow_{name}" for name in c.LABELS})


def performance_gate(params: DataFrame) -> DataFrame:
    return params.withColumn("performance", F.coalesce("performance", F.lit(False)))


# --- positions ----------------------------------------------------------------------


def positions_per_day(orders: DataFrame) -> DataFrame:
    """Order counts per ticker and day; three orders make one position."""

    def of(kind: str):
        return F.count_if(F.col("order_type") == kind)

    return (
        orders.withColumn("day", day_of())
        .groupBy(*BY_DAY)
        .agg(
            F.count(F.lit(1)).alias("orders"),
            of(c.LIMIT).alias("limit_orders"),
            of(c.STOP).alias("stop_orders"),
        )
        .withColumn("positions", F.floor(F.col("orders") / c.ROWS_PER_POSITION).cast("int"))
    )


def last_position(orders: DataFrame) -> DataFrame:
    """Fill prices of the newest three orders of a ticker and day, by order type.

    The ranked limit also runs before the shuffle, so three rows per task and key move.
    """
    newest = Window.partitionBy(*BY_DAY).orderBy(F.desc("ib_id"))
    last = (
        orders.withColumn("day", day_of())
        .withColumn("_rank", F.row_number().over(newest))
        .where(F.col("_rank") <= c.ROWS_PER_POSITION)
    )

    def fill(kind: str):
        return F.min_by("fill_price", F.when(F.col("order_type") == kind, F.col("_rank")))

    return last.groupBy(*BY_DAY).agg(
        fill(c.MARKET).alias("market_fill"), fill(c.LIMIT).alias("limit_fill"), fill(c.STOP).alias("stop_fill")
    )


def stop_result(action, stop_fill, entry_fill):
    """Whether a filled stop closed in profit or in loss."""
    ahead = F.when(action == "BUY", stop_fill > entry_fill).otherwise(stop_fill < entry_fill)
    return F.when(stop_fill.isNotNull(), F.when(ahead, F.lit("profit")).otherwise(F.lit("loss")))


def order_states(orders: DataFrame) -> DataFrame:
    """Counts and newest fills of a ticker's orders of a day, up to each time that has new ones.

    ``since`` is the full minute from which the row holds. Bars start at full minutes, so none
    sees a later order, and a day has at most 1,440 rows whatever its orders.
    """
    minute = F.date_trunc("minute", "date").cast("timestamp_ntz")
    since = F.when(minute == F.col("date"), minute).otherwise(minute + F.expr("INTERVAL 1 MINUTE"))
    dated = orders.withColumns({"day": day_of(), "since": since})
    key = [*BY_DAY, "since"]

    def of(kind: str):
        return F.count_if(F.col("order_type") == kind)

    counts = dated.groupBy(*key).agg(
        F.count(F.lit(1)).alias("orders"), of(c.LIMIT).alias("limit_orders"), of(c.STOP).alias("stop_orders")
    )
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("ib_id")))
    newest = dated.withColumn("_rank", rank).where(F.col("_rank") <= c.ROWS_PER_POSITION)
    # Counts of a minute stand on its first row only, so that running sums take them once.
    first = [F.when(F.col("_rank") == 1, F.col(name)).alias(name) for name in ("orders", "limit_orders", "stop_orders")]
    rows = counts.join(newest, key).select(*key, "_rank", *first, F.struct("ib_id", "order_type", "fill_price").alias("_out0"))
    by_time = Window.partitionBy(*BY_DAY).orderBy("since", "_rank")
    so_far = by_time.rowsBetween(Window.unboundedPreceding, 0)
    # The greatest so far; whatever it pushes out competes for the next place.
    places = range(1, c.ROWS_PER_POSITION + 1)
    for i in places:
        rows = rows.withColumn(f"_top{i}", F.max(f"_out{i - 1}").over(so_far))
        before = F.lag(f"_top{i}").over(by_time)
        pushed = F.when(before.isNotNull() & F.col(f"_out{i - 1}").isNotNull(), F.least(f"_out{i - 1}", before))
        rows = rows.withColumn(f"_out{i}", pushed)

    def fill(kind: str):
        return F.coalesce(*[F.when(F.col(f"_top{i}.order_type") == kind, F.struct(f"_top{i}.fill_price")) for i in places])["fill_price"]

    return (
        rows.select(
            *key,
            *[F.sum(name).over(so_far).alias(name) for name in ("orders", "limit_orders", "stop_orders")],
            fill(c.LIMIT).alias("limit_fill"),
            fill(c.STOP).alias("stop_fill"),
            F.lead("since").over(by_time).alias("_next"),
        )
        .where(~F.col("_next").eqNullSafe(F.col("since")))
        .drop("_next")
        .withColumn("positions", F.floor(F.col("orders") / c.ROWS_PER_POSITION).cast("int"))
    )


def _blocked() -> Column:
    """Whether the orders so far keep a new position out; needs an order state and parsed parameters."""

    def used_up(count: str, allowed: Column):
        first = F.col("orders") == c.ROWS_PER_POSITION
        return (allowed == 1) | (~first & (F.col(count) >= allowed))

    return (
        F.when(F.col("orders") > pp.stop_rows() + pp.limit_rows(), F.lit(True))
        .when(F.col("limit_fill").isNotNull(), used_up("limit_orders", pp.limit_rows()))
        .when(F.col("stop_fill").isNotNull(), used_up("stop_orders", pp.stop_rows()))
        .otherwise(F.lit(True))
    )


def position_gate(orders: DataFrame, params: DataFrame) -> DataFrame:
    """``blocked`` from each time on, per ticker, action and strategy; needs parsed parameters."""
    keyed = order_states(orders).join(params.select(*pp.KEY, "stop_trades", "limit_trades"), "ticker")
    return keyed.select(*BY_DAY, "since", "action", "strategy", "positions", _blocked().alias("blocked"))


# --- entry --------------------------------------------------------------------------


def states_by_hour(states: DataFrame) -> DataFrame:
    """Order states that a bar of each (ticker, day, hour) may see, in one array by time.

    An hour has the states that begin in it, at most one a minute, after the one that held before; hours without
    any have that one alone. So a bar looks at 61 states at most, a ticker and day have 24 rows at most, and bars
    meet them by an equal key, in batches and in streams.
    """
    names = [name for name in states.columns if name not in (*BY_DAY, "since")]
    begun = F.sort_array(F.collect_list(F.struct("since", *names)))
    # An order of a day's last minute holds from the next day on, which no bar of its day sees.
    hours = (
        states.where(day_of("since") == F.col("day"))
        .groupBy(*BY_DAY, F.hour("since").alias("_from"))
        .agg(begun.alias("_begun"))
    )
    by_hour = Window.partitionBy(*BY_DAY).orderBy("_from")
    held = F.lag(F.element_at("_begun", -1)).over(by_hour)
    until = F.coalesce(F.lead("_from").over(by_hour), F.lit(24)) - 1
    spread = hours.withColumns({"_held": held, "_until": until}).withColumn("hour", F.explode(F.sequence("_from", "_until")))
    own = F.concat(F.array_compact(F.array("_held")), F.col("_begun"))
    later = F.slice("_begun", -1, 1)
    return spread.select(*BY_DAY, "hour", F.when(F.col("hour") == F.col("_from"), own).otherwise(later).alias("_states"))


def entry_signals(bars: DataFrame, params: DataFrame, states: DataFrame) -> DataFrame:
    """Bars that open a position, per action of their ticker.

    Needs the bar's close, prev_day_close, buy_signal, sell_signal, predictions and
    benchmark_trend. ``states`` are those of ``states_by_hour``; a bar sees the orders up to
    its own time. A bar before the day's first order is not held back.
    """
    allowed = permissions(performance_gate(params))
    sides = allowed.select("ticker", "action").distinct().groupBy("ticker").agg(F.collect_set("action").alias("_actions"))
    acted = spread_join(bars, sides, ["ticker"], ["date"]).withColumn("action", F.explode("_actions")).drop("_actions")
    tagged = acted.withColumns({"strategy": strategy_of(F.col("action")), "day": day_of(), "hour": F.hour("date")})
    keyed = pp.attach_params(tagged, allowed).join(states, [*BY_DAY, "hour"], "left")
    seen = F.filter("_states", lambda state: state["since"] <= F.col("date"))
    keyed = keyed.withColumn("_state", F.try_element_at(seen, F.lit(-1))).select("*", "_state.*")
    ml = F.when(F.col("strategy") == "trend", cond.trend_ml_condition()).otherwise(cond.correction_ml_condition())
    return keyed.where(
        F.col("performance")
        & (F.col("_state").isNull() | ~_blocked())
        & cond.breakaway_signal()
        & (~pp.uses_ml("allow_") | ml)
        & (~pp.uses_benchmark() | cond.benchmark_condition())
    ).select("ticker", "date", "action", "strategy", "close")


def bracket_orders(signals: DataFrame) -> DataFrame:
    """One signal to three orders: entry, trailing stop and profit limit.

    Needs ticker, date, action (upper case), strategy, last_close, signal_no, conid and
    the strategy parameters. Order ids follow the signal number.
    """
    action = F.col("action")
    opposite = F.when(action == "BUY", F.lit("SELL")).otherwise(F.lit("BUY"))
    limit_price = sf.scaled_round(F.col("last_close") * pp.limit_percent(action), 2)

    def leg(step: int, kind: str, side, trailing):
        return F.struct(
            (F.col("signal_no") * c.ROWS_PER_POSITION + step).alias("ib_id"),
            F.lit(kind).alias("order_type"),
            side.alias("action"),
            trailing.cast("double").alias("trailing_percent"),
        )

    legs = F.array(
        leg(1, c.MARKET, action, F.lit(None)),
        leg(2, c.STOP, opposite, pp.trail_percent(action)),
        leg(3, c.LIMIT, opposite, limit_price),
    )
    return signals.withColumn("_leg", F.explode(legs)).select(
        "date",
        "ticker",
        F.lit("STK").alias("sec_type"),
        "_leg.order_type",
        "_leg.trailing_percent",
        F.lit("DAY").alias("tif"),
        "_leg.ib_id",
        "_leg.action",
        "last_close",
        F.concat_ws("_", "ticker", "signal_no").alias("oca_group"),
        F.col("strategy").alias("signal_id"),
        "conid",
    )
