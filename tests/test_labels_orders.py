"""Hand-worked labels, pruning, signals and orders."""

import itertools
import random
from datetime import timedelta

from pyspark.sql import functions as F

from barloom import constants as c
from barloom.functions import scalars as sf
from barloom.operators import labels as ll
from barloom.operators import orders as oo
from barloom.operators import params as pp
from barloom.operators import signals as ss
from barloom.operators import universe as uu
from barloom.plans import prune
from tests.helpers import at, rows_of

PARAMS = (
    "ticker string, action string, strategy string, performance boolean, benchmark_negative double, benchmark_positive double, "
    "limit_price double, limit_time int, limit_trades int, min_trail_percent double, stop_trades int, trail_percent double, "
    "trail_time int, high_delta boolean, low_delta boolean, high_stop boolean, low_stop boolean, spy boolean"
)


def params(spark, **changes):
    base = dict(
        ticker="A", action="buy", strategy="trend", performance=True, benchmark_negative=None, benchmark_positive=None,
        limit_price=1.01, limit_time=60, limit_trades=1, min_trail_percent=0.99, stop_trades=1, trail_percent=0.98,
        trail_time=30, high_delta=None, low_delta=None, high_stop=None, low_stop=None, spy=False,
    )
    names = [part.split()[0] for part in PARAMS.split(", ")]
    base.update(changes)
    return spark.createDataFrame([tuple(base[name] for name in names)], PARAMS)


def labelled(spark, rows):
    """Rows of (minute, volume_delta, open_delta, benchmark_delta, high_delta, high_stop)."""
    full = [("A", "buy", "trend", 1, at("2024-01-02 10:00:00") + timedelta(minutes=m), v, o, b, d, None, s, None) for m, v, o, b, d, s in rows]
    schema = (
        "ticker string, action string, strategy string, session_period int, date timestamp_ntz, volume_delta double, open_delta double, "
        "benchmark_delta double, high_delta boolean, low_delta boolean, high_stop boolean, low_stop boolean"
    )
    return spark.createDataFrame(full, schema).withColumns(
        {"difference": F.lit(0.0), "spy_difference": F.lit(0.0), "benchmark_difference": F.lit(0.0), "spy": F.lit(False),
         "benchmark_negative": F.lit(None).cast("double"), "benchmark_positive": F.lit(None).cast("double")}
    )


CONFLICT = [
    (0, 0.1, 1.0, 1.0, True, False),
    (1, 0.1, 1.0, 1.0, False, False),
    (2, 0.1, 1.1, 1.0, True, False),
    (3, 0.1, 1.1, 1.0, True, True),
    (4, 0.2, 1.2, 1.3, True, False),
    (5, 0.2, 1.2, 1.3, True, False),
    (6, 0.9, 1.0, 1.0, True, False),
    (7, None, 1.0, 1.0, True, False),
]


def test_pruning_and_conflicts(spark):
    out = prune.prune_labelled(labelled(spark, CONFLICT))
    assert out.keep_dates.count() == 8
    # the single volume value and the missing one go, everything else repeats
    assert [r["date"].minute for r in out.possible_dates.orderBy("date").collect()] == [0, 1, 2, 3, 4, 5]
    values = rows_of(out.values, "kind", "value", "n")
    assert values == [
        ("benchmark_delta", 1.0, 4), ("benchmark_delta", 1.3, 2), ("open_delta", 1.0, 2), ("open_delta", 1.1, 2),
        ("open_delta", 1.2, 2), ("volume_delta", 0.1, 4), ("volume_delta", 0.2, 2),
    ]
    assert rows_of(out.conflict_pairs, "label", "pair") == [("high_delta", "[1.0,1.0]"), ("high_stop", "[1.1,1.0]")]
    left = rows_of(out.training.select("label", F.minute("date").alias("m")), "label", "m")
    assert left == [("high_delta", m) for m in (2, 3, 4, 5)] + [("high_stop", m) for m in (0, 1, 4, 5)]


def test_cascade_depends_on_order(spark):
    rows = [(0, 0.1, 1.0, 1.0, True, True), (1, 0.1, 2.0, 1.0, True, True), (2, 0.3, 2.0, 1.0, True, True)]
    # volume keeps 0 and 1; then no open value repeats any more
    assert prune.prune_labelled(labelled(spark, rows)).possible_dates.count() == 0


def test_label_data(spark):
    schema = "action string, strategy string, close double, day_max double, day_min double, limit_price double, min_trail_percent double"
    rows = [
        ("buy", "trend", 100.0, 102.0, 99.9, 1.01, 0.99),
        ("buy", "trend", 100.0, 100.0, 80.0, 1.01, 0.99),
        ("sell", "trend", 100.0, 101.0, 90.0, 0.99, 1.02),
        ("sell", "trend", 100.0, 103.0, 100.0, 0.99, 1.02),
    ]
    out = ll.label_data(spark.createDataFrame(rows, schema)).collect()
    got = [(r["high_delta"], r["high_stop"], r["low_delta"], r["low_stop"]) for r in out]
    assert got == [(True, False, None, True), (False, True, None, False), (None, True, True, False), (None, False, False, True)]


def test_band_filter(spark):
    schema = "action string, strategy string, spy boolean, spy_difference double, benchmark_difference double, benchmark_negative double, benchmark_positive double, id int"
    rows = [
        ("buy", "trend", False, 9.0, 0.5, -1.0, 1.0, 1),
        ("buy", "trend", True, 9.0, 0.5, -1.0, 1.0, 2),
        ("buy", "correction", True, 9.0, 0.5, -1.0, 1.0, 3),
        ("sell", "trend", False, 9.0, 0.5, 1.0, -1.0, 4),
        ("sell", "correction", False, 9.0, 0.5, 1.0, -1.0, 5),
        ("buy", "trend", True, 9.0, 0.5, None, 1.0, 6),
    ]
    out = ll.benchmark_band_filter(spark.createDataFrame(rows, schema))
    assert rows_of(out, "id") == [(1,), (3,), (4,), (6,)]


def test_fill_predictions(spark):
    stamps = ["2024-01-02 10:00:00", "2024-01-02 10:05:00", "2024-01-02 10:10:00", "2024-01-02 10:15:00", "2024-01-03 10:00:00", "2024-01-03 10:05:00"]
    guesses = [True, None, True, None, None, None]
    df = spark.createDataFrame([("A", "buy", at(s), g) for s, g in zip(stamps, guesses)], "ticker string, action string, date timestamp_ntz, guess boolean")
    out = [r["guess"] for r in ll.fill_predictions(df, ["guess"]).orderBy("date").collect()]
    assert out == [False, False, True, True, False, False]


def signals(spark, action="BUY"):
    row = [(at("2024-01-02 15:00:00"), "A", action, "trend", 50.0, 7, 11)]
    df = spark.createDataFrame(row, "date timestamp_ntz, ticker string, action string, strategy string, last_close double, signal_no bigint, conid bigint")
    return df.crossJoin(params(spark).drop("ticker", "action", "strategy"))


def test_bracket(spark):
    out = ss.bracket_orders(signals(spark)).orderBy("ib_id").collect()
    assert [(r["ib_id"], r["order_type"], r["action"], r["trailing_percent"]) for r in out] == [
        (22, "MKT", "BUY", None), (23, "STOP LOSS", "SELL", 2.0), (24, "TAKE PROFIT", "SELL", 50.5),
    ]
    assert {r["oca_group"] for r in out} == {"A_7"}


def orders(spark, fills=(50.0, None, None), status=("filled", None, None)):
    base = ss.bracket_orders(signals(spark))
    at_type = {"MKT": 0, "STOP LOSS": 1, "TAKE PROFIT": 2}
    fill = F.lit(None).cast("double")
    state = F.lit(None).cast("string")
    for kind, i in at_type.items():
        fill = F.when(F.col("order_type") == kind, F.lit(fills[i])).otherwise(fill)
        state = F.when(F.col("order_type") == kind, F.lit(status[i])).otherwise(state)
    return base.withColumns({"fill_price": fill.cast("double"), "ib_status": state})


def last_bar(spark, close, low_stop=None, high_stop=None):
    return spark.createDataFrame([("A", at("2024-01-02 15:05:00"), close, low_stop, high_stop)], "ticker string, date timestamp_ntz, close double, low_stop boolean, high_stop boolean")


def _now(text):
    return F.lit(text).cast("timestamp_ntz")


def test_gate(spark):
    p = params(spark)

    def blocked(df):
        return ss.position_gate(df, p).collect()[0]["blocked"]

    open_position = orders(spark)
    assert blocked(open_position) is True
    assert blocked(orders(spark, (50.0, None, 51.0))) is False
    assert blocked(orders(spark, (50.0, 49.0, None))) is False
    two = orders(spark, (50.0, None, 51.0)).unionByName(
        orders(spark, (50.0, None, 51.0)).withColumn("ib_id", F.col("ib_id") + 3)
    )
    assert blocked(two) is False
    three = two.unionByName(orders(spark, (50.0, None, 51.0)).withColumn("ib_id", F.col("ib_id") + 6))
    assert blocked(three) is True


def test_adjust_stops(spark):
    p = params(spark)

    def new(close, now="2024-01-02 15:10:00", open_=True, df=None):
        return oo.adjust_stops(df if df is not None else orders(spark), last_bar(spark, close), p, _now(now), F.lit(open_)).collect()[0]["new_trailing"]

    assert new(50.0) is None
    assert new(49.0) == 0.1
    assert new(50.0, now="2024-01-02 15:40:00") == 1.0
    assert new(50.0, open_=False) == 0.1
    assert new(49.0, df=orders(spark, (None, None, None))) is None


def test_adjust_limits(spark):
    p = params(spark)

    def new(close, now="2024-01-02 15:10:00", fills=(50.0, None, None), **marks):
        return oo.adjust_limits(orders(spark, fills), last_bar(spark, close, **marks), p, _now(now)).collect()[0]["new_limit"]

    assert new(50.2) is None
    assert new(50.2, now="2024-01-02 16:10:00") == 50.25
    assert new(50.2, high_stop=True) == 50.25
    assert new(50.2, fills=(49.0, None, None)) == 49.49
    assert new(50.2, fills=(None, None, None)) is None


def test_make_instructions(spark):
    account = oo.Account("DU1", 100_000.0, 3)
    early = oo.make_instructions(orders(spark), params(spark), account, _now("2024-01-02 15:00:20"))
    assert early.count() == 0
    made = oo.make_instructions(orders(spark), params(spark), account, _now("2024-01-02 15:01:00"))
    got = rows_of(made.fillna({"limit_price": -1.0, "stop_price": -1.0}), "signal_id", "order_type", "quantity", "limit_price", "stop_price")
    # 100 of budget over a stop distance of 1 share price unit: 100 shares, three times
    assert got == [("close stock", "LMT", 300, 50.5, -1.0), ("close stock", "STP", 300, -1.0, 2.0), ("open stock", "MKT", 300, -1.0, -1.0)]


INS = "symbol string, strategy_id string, cll_int_id bigint, account string, day date, instruction_id bigint, date timestamp_ntz, order_type string, order_status string, limit_price double, stop_price double"


def ins(spark, rows):
    day = at("2024-01-02 10:00:00")
    return spark.createDataFrame([("A", "day-trade", i, "DU1", day.date(), i, day, t, s, lim, st) for i, t, s, lim, st in rows], INS)


def test_upsert_instructions(spark):
    stored = ins(spark, [(1, "LMT", "new", 5.0, None), (2, "LMT", "filled", 5.0, None), (3, "STP", "submitted", None, 2.0), (4, "LMT", "new", 5.0, None), (5, "MKT", "new", None, None)])
    incoming = ins(spark, [(1, "LMT", "new", 6.0, None), (2, "LMT", "new", 6.0, None), (3, "STP", "new", None, 1.0), (4, "LMT", "Canceled", 6.0, None), (9, "MKT", "new", None, None)])
    out = {r["cll_int_id"]: (r["order_status"], r["limit_price"], r["stop_price"]) for r in oo.upsert_instructions(stored, incoming).collect()}
    assert out == {
        1: ("new", 6.0, None), 2: ("filled", 5.0, None), 3: ("new", None, 1.0), 4: ("canceled", 5.0, None),
        5: ("new", None, None), 9: ("new", None, None),
    }


def test_conditions_and_entry(spark):
    schema = (
        "ticker string, date timestamp_ntz, close double, prev_day_close double, buy_signal boolean, sell_signal boolean, high_delta boolean, "
        "low_delta boolean, high_stop boolean, low_stop boolean, benchmark_trend boolean"
    )
    when = at("2024-01-02 15:00:00")

    def entries(p, **bar):
        base = dict(close=11.0, prev_day_close=10.0, buy_signal=True, sell_signal=False, high_delta=None, low_delta=None, high_stop=None, low_stop=None, benchmark_trend=None)
        base.update(bar)
        df = spark.createDataFrame([("A", when, *base.values())], schema)
        none = ss.states_by_hour(ss.order_states(orders(spark).where("false")))
        return ss.entry_signals(df, p, none).count()

    assert entries(params(spark)) == 1
    assert entries(params(spark), buy_signal=None) == 0
    assert entries(params(spark, performance=None)) == 0
    assert entries(params(spark), close=9.0) == 0
    assert entries(params(spark, high_delta=True)) == 0
    assert entries(params(spark, high_delta=True), high_delta=True) == 1
    # a missing stop prediction does not hold the entry back
    assert entries(params(spark, high_stop=True)) == 1
    assert entries(params(spark, high_stop=True), high_stop=True) == 0
    assert entries(params(spark, benchmark_negative=-1.0, benchmark_positive=1.0)) == 0
    assert entries(params(spark, benchmark_negative=-1.0, benchmark_positive=1.0), benchmark_trend=True) == 1


def test_orders_after_the_bar_do_not_block_it(spark):
    bar = spark.createDataFrame(
        [("A", at(f"2024-01-02 {hour}:00:00"), 11.0, 10.0, True, False, None, None, None, None, None) for hour in ("10", "14", "15", "16")],
        "ticker string, date timestamp_ntz, close double, prev_day_close double, buy_signal boolean, sell_signal boolean, high_delta boolean, "
        "low_delta boolean, high_stop boolean, low_stop boolean, benchmark_trend boolean",
    )

    def hours(time):
        placed = orders(spark).withColumn("date", F.lit(f"2024-01-02 {time}").cast("timestamp_ntz"))
        states = ss.states_by_hour(ss.order_states(placed))
        return [r["date"].hour for r in ss.entry_signals(bar, params(spark), states).orderBy("date").collect()]

    assert hours("15:00:00") == [10, 14]
    assert hours("15:00:00.000001") == [10, 14, 15]
    assert hours("09:59:59") == []


def test_newest_bracket_decides_over_the_day(spark):
    first = orders(spark, (50.0, 49.0, None)).withColumn("date", F.lit("2024-01-02 10:00:00").cast("timestamp_ntz"))
    # the later bracket has the smaller ids, so the first stays the newest
    later = orders(spark).withColumns({"ib_id": F.col("ib_id") - 10, "date": F.lit("2024-01-02 11:30:30").cast("timestamp_ntz")})
    rows = ss.order_states(first.unionByName(later)).orderBy("since").collect()
    assert [(str(r["since"]), r["orders"], r["stop_orders"], r["stop_fill"], r["limit_fill"], r["positions"]) for r in rows] == [
        ("2024-01-02 10:00:00", 3, 1, 49.0, None, 1),
        ("2024-01-02 11:31:00", 6, 2, 49.0, None, 2),
    ]


def test_order_states_equal_a_loop(spark):
    pick = random.Random(5)
    kinds = (c.MARKET, c.STOP, c.LIMIT)
    rows = []
    for n in range(400):
        time = at("2024-01-02 00:00:00") + timedelta(days=pick.randrange(2), seconds=pick.choice([30, 60, 3600]) * pick.randrange(24))
        number = pick.choice([None, pick.randrange(60), 1000 + n])
        rows.append((pick.choice("AAB"), time, number, pick.choice(kinds), pick.choice([None, float(n)])))
    rows.append(("B", at("2024-01-02 23:59:30"), 5000, c.LIMIT, 1.0))
    table = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, ib_id long, order_type string, fill_price double")
    states = ss.order_states(table).collect()
    # Rows of one minute with the same id compete for three places in no order of their own.
    for s in states:
        seen = [r for r in rows if r[0] == s["ticker"] and r[1].date() == s["day"] and r[1] <= s["since"]]
        assert s["orders"] == len(seen)
        assert (s["limit_orders"], s["stop_orders"]) == tuple(sum(r[3] == k for r in seen) for k in (c.LIMIT, c.STOP))
        top = sorted((r[2] if r[2] is not None else -1 for r in seen), reverse=True)[:3]
        if len(top) == 3 and len({r[2] for r in seen if (-1 if r[2] is None else r[2]) >= top[2]}) == 3 and top[2] >= 1000:
            newest = sorted((r for r in seen if r[2] is not None and r[2] >= top[2]), key=lambda r: -r[2])
            for kind, name in ((c.LIMIT, "limit_fill"), (c.STOP, "stop_fill")):
                assert s[name] == next((r[4] for r in newest if r[3] == kind), None)
    assert {(s["ticker"], s["since"]) for s in states} == {
        (r[0], r[1] if r[1].second == 0 else r[1].replace(second=0) + timedelta(minutes=1)) for r in rows
    }

    begun = [s for s in states if s["since"].date() == s["day"]]
    hours = {(h["ticker"], h["day"], h["hour"]): [x["since"] for x in h["_states"]] for h in ss.states_by_hour(ss.order_states(table)).collect()}
    for ticker, day, hour in itertools.product("AB", {s["day"] for s in begun}, range(24)):
        own = sorted(s["since"] for s in begun if (s["ticker"], s["day"]) == (ticker, day))
        want = [t for t in own if t.hour < hour][-1:] + [t for t in own if t.hour == hour]
        assert hours.get((ticker, day, hour), []) == want and len(want) <= 61


def test_params_defaults(spark):
    p = params(spark, stop_trades=None, limit_trades=None, trail_percent=None, limit_price=None, limit_time=None, min_trail_percent=None)
    buy = F.lit("BUY")
    row = p.select(
        pp.stop_rows(), pp.limit_rows(), pp.trail_percent(buy), pp.limit_percent(buy), pp.limit_percent(F.lit("SELL")), pp.limit_minutes(), pp.min_trail_percent(buy)
    ).collect()[0]
    assert tuple(row) == (6, 3, 2.0, 1.005, 0.995, 60, None)


def test_order_status(spark):
    df = spark.createDataFrame([("Filled", 0.0), ("Filled", 1.0), ("Submitted", 0.0), ("Submitted", 2.0), ("Cancelled", 2.0), ("??", 0.0)], "s string, r double")
    got = df.select(sf.order_status(F.col("s")).alias("a"), sf.order_status(F.col("s"), F.col("r")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("filled", "filled"), ("filled", None), ("submitted", "filled"), ("submitted", None), ("cancelled", "cancelled"), (None, None)]


def test_best_limit_price(spark):
    rows = [("BUY", "X", None, 10.0, 12.0, 1.0), ("SELL", "X", 11.0, 10.0, 12.0, 1.0), ("SELL", "HYG", 11.0, 10.0, 12.0, 0.9), ("BUY", "X", 9.0, 10.0, 12.0, 1.5)]
    out = oo.best_limit_price(spark.createDataFrame(rows, "action string, symbol string, limit_price double, bid double, ask double, multiplier double")).collect()
    assert [(round(r["trade_price"], 6), r["sent"], r["sent_price"] and round(r["sent_price"], 6)) for r in out] == [
        (10.0, True, 10.0), (12.0, True, 12.0), (10.8, True, 10.8), (13.5, False, None),
    ]


def test_gate_of_backtests(spark):
    schema = "symbol string, time_frame string, strategy string, action string, algo_period_return double, spy_period_return double, beta double, max_drawdown double, combined_period_return double"
    rows = [
        ("A", "minute", "trend", "buy", 0.5, 0.4, 0.1, -0.2, 1.0), ("A", "minute", "correction", "buy", 0.1, 0.4, 0.1, -0.05, 1.0),
        ("B", "minute", "trend", "sell", 0.1, 0.4, -0.1, -0.05, 1.0), ("B", "minute", "correction", "sell", 0.1, 0.4, None, -0.05, 1.0),
        ("C", "minute", "trend", "buy", 0.5, 0.4, 0.1, -0.2, 1.0), ("C", "minute", "correction", "buy", 0.5, 0.4, 0.1, -0.2, None),
    ]
    out = uu.backtest_gate(spark.createDataFrame(rows, schema)).collect()
    got = {(r["symbol"], r["strategy"]): r["passed"] for r in out}
    assert got == {
        ("A", "trend"): True, ("A", "correction"): False, ("B", "trend"): True, ("B", "correction"): None, ("C", "trend"): None, ("C", "correction"): None,
    }


def test_all_orders_of_a_hot_ticker_day_are_ranked_by_blocks(spark):
    ids = [*range(1, 6001, 3), 10**12, None, None]
    rows = [("A", at("2024-01-02 10:00:00"), i) for i in ids] + [("B", at("2024-01-02 10:00:00"), 5), (None, None, 7), (None, None, 9)]
    rows += [("C", at("2024-01-02 10:00:00"), i) for i in range(9000)]
    table = spark.createDataFrame(rows, "ticker string, date timestamp_ntz, ib_id long")
    ranked = oo.orders_today(table, "type")
    plan = ranked._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(ticker#" in plan and "_range" in plan
    got = {}
    for r in ranked.collect():
        got.setdefault(r["ticker"], []).append((r["rank"], r["ib_id"]))
    want = {"A": sorted(ids[:-2], reverse=True) + [None, None], "B": [5], None: [9, 7], "C": list(range(8999, -1, -1))}
    assert {k: sorted(v, key=lambda x: x[0]) for k, v in got.items()} == {k: list(enumerate(v, 1)) for k, v in want.items()}


def registry_by_steps(events, versions):
    """One event after another, as a plain loop."""
    kinds = {k: i for i, k in enumerate(oo.EVENT_KINDS)}
    live = {}
    for o, account, kind, time, status, price in sorted(events, key=lambda e: (e[3], kinds[e[2]])):
        if kind == "add" and o not in live:
            known = [v for v in versions if v[0] == account and v[1] == o and v[2] <= time]
            if known:
                v = max(known, key=lambda v: v[2])
                live[o] = [v[3], status, None, v[6]]
        elif kind == "remove":
            live.pop(o, None)
        elif o in live and kind == "status":
            live[o][1] = status
        elif o in live and kind == "fill":
            live[o][2] = price
        elif o in live and kind == "sync":
            live[o][3] = live[o][1]
    return {o: tuple(v) for o, v in live.items()}


def test_order_registry_equals_a_loop_over_events(spark):
    """All five kinds, unknown orders, orders added again after their end, versions before and after an add."""
    r = random.Random(3)
    minute = lambda m: at("2024-01-02 10:00:00") + timedelta(minutes=m)
    events, versions = [], []
    for o in range(1, 120):
        for m in r.sample(range(200), r.randint(1, 25)):
            kind = r.choice(["add", "status", "status", "fill", "sync", "remove" if o % 4 else "sync"])
            events.append((o, o % 2, kind, minute(m), r.choice(["submitted", "filled", None]), r.choice([1.5, 2.5])))
        for m in r.sample(range(200), r.randint(0, 4)):
            versions.append((o % 2 if o % 9 else 5, o, minute(m), o * 1000 + m, "s", "day-trade", r.choice(["new", "submitted"])))
    events += [(o, 1, "status", minute(500), "filled", None) for o in (777, 778)]
    schema = "order_id long, account long, kind string, event_time timestamp_ntz, status string, fill_price double"
    known = "account long, ib_id long, changed_at timestamp_ntz, instruction_id long, signal_id string, strategy_id string, order_status string"
    odd = [(None, 1, "add", minute(1), "new", None), (5, 1, "add", None, "new", None), (5, 1, "other", minute(1), "x", None)]
    got = oo.order_registry(spark.createDataFrame(events + odd, schema), spark.createDataFrame(versions, known))
    rows = {x["order_id"]: (x["instruction_id"], x["status"], x["fill_price"], x["db_status"]) for x in got.collect()}
    assert rows == registry_by_steps(events, versions) and len(rows) > 30
    assert oo.order_registry(spark.createDataFrame([], schema), spark.createDataFrame(versions, known)).collect() == []
