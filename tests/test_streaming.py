"""Streams against batch results, late and out-of-order rows, state over several runs."""

import random
from datetime import timedelta
from itertools import groupby

from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators.bars import bars_from_ticks, roll_up
from barloom.operators.quotes import standing_quotes
from barloom.session import fresh_path
from barloom.streaming import bars as sb
from barloom.streaming import orders as so
from barloom.streaming import state as st
from barloom.streaming.runs import count_late, file_stream, late_rows, replay, run_to_end, run_to_table
from tests.helpers import at, rows_of

TICK = "ticker string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, count bigint"
BAR = ["ticker", "date", "open", "high", "low", "close", "volume", "count"]


def ticks(spark, stamps, ticker="A"):
    rows = [(ticker, at(f"2024-01-02 {s}"), float(i), i + 1.0, i - 1.0, i + 0.5, 10 + i, 1) for i, s in enumerate(stamps)]
    return spark.createDataFrame(rows, TICK)


def land(df, folder):
    df.coalesce(1).write.mode("append").parquet(folder)


def test_stream_equals_batch_out_of_order(spark):
    stamps = [f"10:{m:02d}:{s:02d}" for m in range(12) for s in range(0, 60, 5)]
    mixed = [stamps[i ^ 3] if (i ^ 3) < len(stamps) else stamps[i] for i in range(len(stamps))]
    batch = ticks(spark, mixed)
    folder = fresh_path(spark, "ticks")
    for start in range(0, len(mixed), 37):
        part = batch.where(F.col("open").between(start, start + 36))
        land(part, folder)
    one, query = run_to_table(sb.minute_bars_stream(file_stream(spark, folder, TICK, maxFilesPerTrigger="1")), "one")
    closed = bars_from_ticks(batch, "1 minute").where(F.col("date") < at("2024-01-02 10:11:00"))
    assert rows_of(one, *BAR) == rows_of(closed, *BAR)
    assert late_rows(query) == 0
    five, _ = run_to_table(sb.five_minute_bars_stream(file_stream(spark, folder, TICK, maxFilesPerTrigger="1")), "five")
    want = roll_up(closed).where(F.col("date") < at("2024-01-02 10:10:00"))
    assert rows_of(five, *BAR, "has_gaps") == rows_of(want, *BAR, "has_gaps")


def test_rows_behind_the_watermark_are_dropped_and_counted(spark):
    folder, target = fresh_path(spark, "ticks"), fresh_path(spark, "bars")
    land(ticks(spark, ["10:00:00", "10:00:30", "10:05:00"]), folder)
    run_to_table(sb.minute_bars_stream(file_stream(spark, folder, TICK)), "bars", target)
    # 10:00:45 is too late, 10:04:40 is inside the 30 seconds
    land(ticks(spark, ["10:00:45", "10:04:40", "10:07:00"]), folder)
    out, query = run_to_table(sb.minute_bars_stream(file_stream(spark, folder, TICK)), "bars", target)
    got = {(r["date"].minute, r["count"]) for r in out.collect()}
    assert got == {(0, 2), (4, 1), (5, 1)}
    assert late_rows(query) == 1


def test_late_rows_of_all_batches_are_counted(spark):
    folder, setting = fresh_path(spark, "ticks"), "spark.sql.streaming.numRecentProgressUpdates"
    for stamps in (["10:00:00", "10:09:00"], ["10:20:00"], ["10:00:45", "10:01:00"], ["10:21:00"], ["10:02:45"], ["10:30:00"]):
        land(ticks(spark, stamps), folder)
    spark.conf.set(setting, "1")
    try:
        stream = file_stream(spark, folder, TICK, maxFilesPerTrigger="1")
        _, query = run_to_table(sb.minute_bars_stream(stream), "bars")
    finally:
        spark.conf.unset(setting)
    assert late_rows(query) == 3


def test_session_filter_follows_daylight_saving(spark):
    rows = [("A", at(s), 1.0, 1.0, 1.0, 1.0, 1, 1) for s in ("2024-07-01 13:30:00", "2024-07-01 13:29:59", "2024-12-02 13:30:00", "2024-12-02 14:30:00", "2024-12-02 21:00:00")]
    kept = sb.session_filter(spark.createDataFrame(rows, TICK))
    assert [str(r["ts"]) for r in kept.orderBy("ts").collect()] == ["2024-07-01 13:30:00", "2024-12-02 14:30:00"]


# --- keyed state in event time ------------------------------------------------------------------


def land_mixed(spark, rows, schema, folder, files, seed=7):
    """Rows in as many files, each shuffled, neighbours in time often in the wrong file."""
    rng = random.Random(seed)
    size = -(-len(rows) // files)
    late = sorted(range(len(rows)), key=lambda i: i + rng.uniform(0, size * 0.9))
    for start in range(0, len(rows), size):
        own = late[start : start + size]
        rng.shuffle(own)
        land(spark.createDataFrame([rows[i] for i in own], schema), folder)


DAY_BAR = "ticker string, date timestamp_ntz, open double, close double"


def test_day_state_over_runs(spark):
    folder, target = fresh_path(spark, "bars"), fresh_path(spark, "days")
    rows = [("A", "2024-01-02 10:00:00", 1.0, 2.0), ("A", "2024-01-02 10:05:00", 2.0, 3.0), ("A", "2024-01-03 10:00:00", 5.0, 6.0),
            ("A", "2024-01-03 10:05:00", 6.0, 7.0), ("A", "2024-01-04 10:00:00", 8.0, 9.0), ("B", "2024-01-05 10:00:00", 0.0, 0.0)]
    counts = []
    for part in (rows[:1], rows[1:3], rows[3:]):
        land(spark.createDataFrame([(t, at(d), o, c) for t, d, o, c in part], DAY_BAR), folder)
        out, _ = run_to_table(st.day_state(file_stream(spark, folder, DAY_BAR)), "days", target)
        counts.append(out.count())
    got = [(r["day_open"], r["prev_day_close"]) for r in out.orderBy("date").collect()]
    assert got == [(1.0, None), (1.0, None), (5.0, 3.0), (5.0, 3.0), (8.0, 7.0)]
    assert counts == [0, 2, 5]


def day_bars(days=4, bars=12):
    start = at("2024-01-02 09:30:00")
    return [(t, start + timedelta(days=d, minutes=5 * i), float(d * 100 + i), float(d * 100 + i + k)) for d in range(days) for i in range(bars) for k, t in enumerate("AB")]


def test_day_state_of_mixed_files_equals_batch(spark):
    rows = [*day_bars(), ("Z", at("2024-01-06 00:00:00"), 0.0, 0.0)]
    folder = fresh_path(spark, "bars")
    land_mixed(spark, rows, DAY_BAR, folder, 6)
    stream = file_stream(spark, folder, DAY_BAR, maxFilesPerTrigger="1")
    out, query = run_to_table(st.day_state(stream, delay="2 days"), "days")
    want, last = [], {}
    for ticker in "AB":
        for day, group in groupby((r for r in rows if r[0] == ticker), key=lambda r: r[1].date()):
            group = list(group)
            want += [(ticker, r[1], group[0][2], last.get(ticker)) for r in group if r[1] <= at("2024-01-04 00:00:00")]
            last[ticker] = group[-1][3]
    assert rows_of(out, "ticker", "date", "day_open", "prev_day_close") == sorted(want)
    assert late_rows(query) == 0


def test_day_state_counts_full_days(spark):
    """A day is the previous one only after so many bars; before the first such day the open stands in."""
    rows = [r for r in day_bars(3, 4) if r[0] == "A" and r[1] != at("2024-01-03 09:45:00")] + [("Z", at("2024-01-09 00:00:00"), 0.0, 0.0)]
    folder = fresh_path(spark, "bars")
    land_mixed(spark, rows, DAY_BAR, folder, 1)
    out, _ = run_to_table(st.day_state(file_stream(spark, folder, DAY_BAR), bars_per_day=4), "days")
    got = [r["prev_day_close"] for r in out.orderBy("date").collect()]
    # the fourth bar completes its day and sees itself
    assert got[:3] == [0.0, 0.0, 0.0] and got[4:7] == [3.0, 3.0, 3.0] and got[7:10] == [3.0, 3.0, 3.0]


def test_quote_state_of_mixed_files_equals_batch(spark):
    schema = "contract string, ts timestamp_ntz, field int, price double"
    first = at("2024-01-02 10:00:00")
    rows = [("CD"[i % 3 == 0], first + timedelta(seconds=7 * i), 1 + (i * i + i // 5) % 2, None if i % 17 == 0 else float(i)) for i in range(300)]
    folder = fresh_path(spark, "quotes")
    land_mixed(spark, rows, schema, folder, 9)
    stream = file_stream(spark, folder, schema, maxFilesPerTrigger="1")
    out, query = run_to_table(st.quote_state(stream, delay="10 minutes"), "standing")
    names = ["contract", "ts", "field", "price", "bid", "ask"]
    want = standing_quotes(spark.createDataFrame(rows, schema)).where(F.col("ts") <= rows[-1][1] - timedelta(minutes=10))
    assert list(map(str, rows_of(out, *names))) == list(map(str, rows_of(want, *names)))
    assert out.count() > 200 and late_rows(query) == 0


STATUS = "order_id bigint, event_time timestamp_ntz, status string"


def test_status_stream_ends_with_the_final_status(spark):
    marks = ["submitted", "submitted", None, "pre-submitted", "filled", "cancelled"]
    rows = [(1, at(f"2024-01-02 10:0{i}:00"), s) for i, s in enumerate(marks)] + [(2, at("2024-01-02 11:00:00"), "submitted")]
    folder, target = fresh_path(spark, "events"), fresh_path(spark, "changes")
    for part in (rows[:1], rows[1:4], rows[4:]):
        land(spark.createDataFrame(part, STATUS), folder)
        out, _ = run_to_table(st.status_stream(file_stream(spark, folder, STATUS)), "changes", target)
    assert [(r["status"], r["removed"]) for r in out.orderBy("event_time").collect()] == [("submitted", False), ("pre-submitted", False), ("filled", True)]


def test_status_stream_of_mixed_files(spark):
    first, marks = at("2024-01-02 10:00:00"), ["submitted", "pre-submitted", "submitted", "filled", "submitted", "cancelled"]
    rows = [(i % 4, first + timedelta(minutes=i), marks[(i // 4 + i % 4) % 6]) for i in range(60)]
    folder = fresh_path(spark, "events")
    land_mixed(spark, rows, STATUS, folder, 8)
    stream = file_stream(spark, folder, STATUS, maxFilesPerTrigger="1")
    out, _ = run_to_table(st.status_stream(stream, delay="20 minutes"), "changes")
    want = []
    for order in range(4):
        last = None
        for _, when, status in (r for r in rows if r[0] == order):
            if status != last:
                want.append((order, when, status, status in st.TERMINAL))
            last = status
            if status in st.TERMINAL:
                break
    end = rows[-1][1] - timedelta(minutes=20)
    assert rows_of(out, "order_id", "event_time", "status", "removed") == sorted(w for w in want if w[1] <= end)


def state_rows(query):
    return sum(op["numRowsTotal"] for op in query.recentProgress[-1]["stateOperators"])


def test_state_of_a_finished_order_goes(spark):
    folder, target = fresh_path(spark, "events"), fresh_path(spark, "changes")
    parts = [[(1, at("2024-01-02 10:00:00"), "submitted"), (1, at("2024-01-02 10:01:00"), "filled")],
             [(1, at("2024-01-02 10:02:00"), "submitted"), (2, at("2024-01-02 10:30:00"), "submitted")],
             [(2, at("2024-01-02 12:00:00"), "pre-submitted")], [(3, at("2024-01-02 13:00:00"), "filled")]]
    held = []
    for part in parts:
        land(spark.createDataFrame(part, STATUS), folder)
        stream = st.status_stream(file_stream(spark, folder, STATUS), keep_finished=st.HOUR)
        out, query = run_to_table(stream, "changes", target)
        held.append(state_rows(query))
    got = rows_of(out, "order_id", "status")
    assert got == [(1, "filled"), (1, "submitted"), (2, "pre-submitted"), (2, "submitted")]
    # the last event of the finished order was at 10:02, so it goes when the watermark passes 11:02
    assert held[2] < held[1]


def test_a_feed_that_ends_gives_its_last_rows(spark):
    """Bars and quotes behind the watermark go out with the end of the feed, from several batches as well."""
    rows = [("A", at("2024-01-02 10:00:10"), 1.0), ("A", at("2024-01-02 13:00:00"), 4.0), ("A", at("2024-01-03 10:00:00"), 2.0), ("A", at("2024-01-03 10:00:20"), 3.0)]
    folder = fresh_path(spark, "ticks")
    for row in rows:
        land(spark.createDataFrame([(row[0], row[1], *[row[2]] * 4, 1, 1)], TICK), folder)
    days, _ = run_to_end(file_stream(spark, folder, TICK, maxFilesPerTrigger="1"), "ts", lambda t: sb.stamped_days(t, "2 hours"), "days")
    got = rows_of(days, "date", "close", "day_open", "prev_day_close")
    assert got == [(at("2024-01-02 10:00:00"), 1.0, 1.0, None), (at("2024-01-02 12:00:00"), 4.0, 1.0, None), (at("2024-01-03 10:00:00"), 3.0, 2.0, 4.0)]

    def quotes(ticks):
        return st.quote_state(ticks.select(F.col("ticker").alias("contract"), "ts", (F.col("close").cast("int") % 2 + 1).alias("field"), F.col("close").alias("price")))

    standing, _ = run_to_end(file_stream(spark, folder, TICK, maxFilesPerTrigger="1"), "ts", quotes, "quotes")
    assert rows_of(standing, "ts", "bid", "ask") == [(rows[1][1], 4.0, 1.0), (rows[2][1], 2.0, 1.0), (rows[3][1], 2.0, 3.0)]


def test_many_orders_share_state(spark):
    """State is kept by bucket of orders; ids beyond doubles and a missing id stay apart."""
    first, big = at("2024-01-02 10:00:00"), 2**53
    ids = [None, 0, big, big + 1, *range(10, 2000)]
    marks = ["submitted", "submitted", "filled"]
    rows = [(o, first + timedelta(minutes=m), s) for o in ids for m, s in enumerate(marks) if s != "filled" or o != 0]
    folder = fresh_path(spark, "events")
    land_mixed(spark, [*rows, (1, at("2024-01-03 12:00:00"), "submitted")], STATUS, folder, 1)
    out, query = run_to_table(st.status_stream(file_stream(spark, folder, STATUS), keep_finished=10 * st.DAY), "changes")
    got = {(r["order_id"], r["event_time"], r["status"], r["removed"]) for r in out.collect()}
    assert got == {(o, when, s, s == "filled") for o, when, s in rows if when != first + timedelta(minutes=1)}
    assert out.count() == len(got)
    assert state_rows(query) < len(ids)


def test_ticks_to_stamped_bars_in_one_query(spark):
    """Out-of-order ticks, one file a batch: bars, their day's open and the close before equal the batch ones."""
    stamps = [(d, h, m, s) for d in (2, 3, 4) for h in (10, 11) for m in range(0, 60, 7) for s in (0, 20, 40)]
    rows = [(t, at(f"2024-01-0{d} {h}:{m:02d}:{s:02d}"), float(i + k), i + k + 1.0, i + k - 1.0, i + k + 0.5, 1, 1) for i, (d, h, m, s) in enumerate(stamps) for k, t in enumerate("AB")]
    folder = fresh_path(spark, "ticks")
    land_mixed(spark, rows, TICK, folder, 7)
    stream = file_stream(spark, folder, TICK, maxFilesPerTrigger="1")
    out, query = run_to_table(sb.stamped_days(stream, "5 minutes", delay="1 day"), "stamped")
    bars = bars_from_ticks(spark.createDataFrame(rows, TICK), "5 minutes").withColumn("day", F.to_date("date"))
    days = bars.groupBy("ticker", "day").agg(F.min_by("open", "date").alias("day_open"), F.max_by("close", "date").alias("last"))
    before = Window.partitionBy("ticker").orderBy("day")
    want = bars.join(days.withColumn("prev_day_close", F.lag("last").over(before)), ["ticker", "day"])
    want = want.where(F.col("date") + F.expr("INTERVAL 5 MINUTES") <= rows[-1][1] - timedelta(days=1))
    names = [*BAR, "day_open", "prev_day_close"]
    assert list(map(str, rows_of(out, *names))) == list(map(str, rows_of(want, *names)))
    assert out.count() > 40 and late_rows(query) == 0


# --- late rows and outer joins --------------------------------------------------------------------


def test_late_ticks_are_counted_as_data(spark):
    folder, counts = fresh_path(spark, "ticks"), fresh_path(spark, "counts")
    parts = (["10:00:00", "10:09:00"], ["10:20:00"], ["10:00:45", "10:00:46", "10:19:40"], ["10:02:45", "10:30:00"])
    for stamps in parts:
        land(ticks(spark, stamps), folder)
        stream = file_stream(spark, folder, TICK, maxFilesPerTrigger="1")
        got = count_late(stream, "ts", "30 seconds", "counts", counts)
    assert rows_of(got, "batch", "rows", "late") == [(0, 2, 0), (1, 1, 0), (2, 3, 2), (3, 2, 1)]
    assert got.agg(F.max("latest")).first()[0] == at("2024-01-02 10:30:00")


def test_execution_without_commission_comes_out_once(spark):
    left, right = "execution_id string, date timestamp_ntz, quantity double", "execution_id string, date timestamp_ntz, commission double"
    executions, commissions, target = fresh_path(spark, "exec"), fresh_path(spark, "comm"), fresh_path(spark, "joined")
    runs = [
        ([("a", "2024-01-02 10:00:00"), ("b", "2024-01-02 10:01:00")], [("z", "2024-01-02 10:00:00")]),
        ([("c", "2024-01-02 12:00:00")], [("b", "2024-01-02 10:05:00"), ("c", "2024-01-02 11:59:00")]),
        ([("d", "2024-01-05 12:00:00")], [("d", "2024-01-05 12:00:00")]),
        ([("e", "2024-01-08 12:00:00")], [("e", "2024-01-08 12:00:00")]),
    ]
    seen = []
    for made, paid in runs:
        land(spark.createDataFrame([(i, at(d), 1.0) for i, d in made], left), executions)
        land(spark.createDataFrame([(i, at(d), 2.0) for i, d in paid], right), commissions)
        joined = so.executions_with_commissions(file_stream(spark, executions, left), file_stream(spark, commissions, right), how="left_outer")
        out, _ = run_to_table(joined, "joined", target)
        seen.append(rows_of(out, "execution_id", "commission"))
    paid = [("b", 2.0), ("c", 2.0), ("d", 2.0), ("e", 2.0)]
    assert seen[0] == [] and seen[1] == paid[:2]
    assert seen[3] == [("a", None), *paid]


# --- replayed executions and commissions ----------------------------------------------------------

PAYMENT = "execution_id string, date timestamp_ntz, quantity double, n bigint"


def payments(spark, seed, count=1500):
    """Rows in no order of time; ids and times repeat, some are null, and one id has a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(count):
        name = None if i % 50 == 0 else "hot" if i % 3 == 0 else f"x{rng.randrange(200)}"
        time = None if i % 97 == 0 else at("2024-01-01 00:00:00") + timedelta(hours=rng.randrange(0, 24 * 60), microseconds=rng.randrange(3))
        rows.append((name, time, rng.choice([None, float("nan"), 0.1, -0.0]), rng.choice([None, 2**60 + i])))
    return spark.createDataFrame(rows, PAYMENT)


def met(left, right, how):
    near = F.abs(F.unix_micros(left["date"].cast("timestamp")) - F.unix_micros(right["date"].cast("timestamp"))) <= 86_400_000_000
    joined = left.join(right, (left["execution_id"] == right["execution_id"]) & near, how)
    return joined.select(left["execution_id"], left["date"], left["quantity"], left["n"], right["quantity"].alias("fee"), right["n"].alias("m"))


def texts_of(df):
    return sorted(str(tuple(row)) for row in df.collect())


def test_replayed_table_in_no_order_of_time_joins_all_rows_in_several_batches(spark):
    left, right, folder = payments(spark, 1), payments(spark, 2), fresh_path(spark, "unordered")
    left.repartition(6).write.parquet(f"{folder}/left.parquet")
    right.repartition(6).write.parquet(f"{folder}/right.parquet")
    feeds = [replay(spark, folder, PAYMENT, f"{name}.parquet", "date", limit=8000) for name in ("left", "right")]
    for how in ("inner", "left_outer"):
        fees = feeds[1]().withColumnsRenamed({"quantity": "fee", "n": "m"})
        out, query = run_to_table(so.executions_with_commissions(feeds[0](), fees, how=how, buckets=5), "met")
        batches = [p for p in query.recentProgress if p["numInputRows"]]
        assert len(batches) > 3 and late_rows(query) == 0
        want = met(left, right, how)
        if how == "left_outer":
            last = min(df.agg(F.max("date")).first()[0] for df in (left, right))
            known = F.col("date") < F.lit(last - timedelta(hours=25))
            paid = met(left, right, "inner").select("execution_id", "date", "n").distinct()
            open_ = want.join(paid, [want[c].eqNullSafe(paid[c]) for c in ("execution_id", "date", "n")], "left_anti")
            want = met(left, right, "inner").unionAll(open_.where(known))
        assert texts_of(out) == texts_of(want)
        # parts of buckets wait, not rows, and go once the watermark has passed them
        assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] < 60


def test_replayed_table_of_one_batch_keeps_parts_and_not_rows(spark):
    folder = fresh_path(spark, "one")
    payments(spark, 3).write.parquet(f"{folder}/rows.parquet")
    feed = replay(spark, folder, PAYMENT, "rows.parquet", "date")
    fees = feed().select("execution_id", "date", F.col("quantity").alias("fee"))
    out, query = run_to_table(so.executions_with_commissions(feed(), fees), "one")
    assert out.count() == met(payments(spark, 3), payments(spark, 3), "inner").count()
    # a bucket has a part and a timer, and an entry for each in an index
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) < 1500
