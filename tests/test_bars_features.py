"""Hand-worked bars: completeness, gaps, session features."""

from pyspark.sql import functions as F

from barloom.operators import bars as bb
from barloom.operators import features as ff
from barloom.plans import gaps, ingest
from barloom.schemas import SessionSpec
from tests.helpers import at, bars, rows_of

SPEC = SessionSpec(bar="10 minutes", bars_per_day=6, bars_per_period=2, periods=3)


def two_days(spark):
    """A: two full days; B: a full day, then one with four bars."""
    rows = []
    for ticker, base, second in (("A", 10.0, 6), ("B", 100.0, 4)):
        for day, n in (("2024-01-02", 6), ("2024-01-03", second)):
            for i in range(n):
                price = base + i + (10 if day.endswith("3") else 0)
                rows.append((ticker, f"{day} 10:{i}0:00", price, price + 2 - i % 2, price - 1, price + 1, 100 + i))
    return bars(spark, rows)


def test_full_days(spark):
    df = two_days(spark)
    full = bb.full_days_only(df, 6)
    assert full.count() == 18
    assert rows_of(bb.full_days_only(full.drop("day"), 6), "ticker", "date") == rows_of(full, "ticker", "date")
    assert bb.incomplete_bars(df, 6).count() == 4
    none = spark.createDataFrame([], "ticker string, day date")
    found = bb.non_full_days(df, none, 6)
    assert [(r["ticker"], str(r["day"]), r["bars"]) for r in found.collect()] == [("B", "2024-01-03", 4)]
    assert bb.non_full_days(df, found, 6).count() == 0


def test_session_features(spark):
    df = two_days(spark)
    out = ff.prepare_features(df, ff.volume_bounds(df), SPEC).orderBy("ticker", "date").collect()
    a = [r for r in out if r["ticker"] == "A"]
    assert [r["session_period"] for r in a[:6]] == [1, 1, 2, 2, 3, 3]
    assert {r["day_open"] for r in a[:6]} == {10.0} and {r["day_open"] for r in a[6:]} == {20.0}
    # no earlier complete day: the day open; then the close of bar six
    assert {r["prev_day_close"] for r in a[:6]} == {10.0} and {r["prev_day_close"] for r in a[6:]} == {16.0}
    assert [r["day_max"] for r in a[:6]] == [16.0, 16.0, 16.0, 16.0, 16.0, 16.0]
    assert [r["day_min"] for r in a[:6]] == [9.0, 10.0, 11.0, 12.0, 13.0, 14.0]
    assert [r["open_delta"] for r in a[:2]] == [1.1, 1.2]
    assert [r["volume_delta"] for r in a[:6]] == [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]
    for earlier, later in zip(a[:5], a[1:6]):
        assert earlier["day_max"] >= later["day_max"] and earlier["day_max"] >= earlier["high"]


def test_prev_day_close_own_bar_and_short_day(spark):
    ranked = ff.add_day_columns(two_days(spark), SPEC)
    own = ff.add_prev_day_close(ranked, SPEC, include_own_close=True).where("ticker = 'A'").orderBy("date").collect()
    assert [r["prev_day_close"] for r in own] == [10.0] * 5 + [16.0] * 6 + [26.0]
    b = ff.add_prev_day_close(ranked, SPEC).where("ticker = 'B'").orderBy("date").collect()
    assert [r["prev_day_close"] for r in b] == [100.0] * 6 + [106.0] * 4


def test_gap_fill_tie_takes_the_earlier_bar(spark):
    rows = [("A", f"2024-01-02 00:{m}0:00", m, m, m, m, 1) for m in (0, 2, 5)]
    df = bars(spark, rows)
    filled = gaps.fill_absent(df, SPEC, threshold=2)
    got = [(r["date"].minute, r["close"], r["has_gaps"]) for r in filled.bars.orderBy("date").collect()]
    # 00:10 lies between 00:00 and 00:20, 00:30 is nearer to 00:20, 00:40 to 00:50
    assert got == [(0, 0.0, False), (10, 0.0, True), (20, 2.0, False), (30, 2.0, True), (40, 5.0, True), (50, 5.0, False)]
    assert [(r["ticker"], r["gaps"]) for r in filled.illiquid.collect()] == [("A", 3)]
    again = gaps.fill_absent(filled.bars.drop("has_gaps"), SPEC)
    assert again.bars.where("has_gaps").count() == 0


def test_gap_fill_before_first_and_after_last(spark):
    df = bars(spark, [("A", "2024-01-02 00:20:00", 7, 7, 7, 7, 1)])
    got = gaps.fill_absent(df, SPEC).bars
    assert got.count() == 6 and got.where("close != 7").count() == 0


def test_roll_up_marks_gaps(spark):
    rows = [("A", f"2024-01-02 10:0{m}:00", m + 1, m + 2, m, m + 1.5, 10) for m in range(5)]
    rows += [("A", f"2024-01-02 10:0{m}:00", m, m, m, m, 10) for m in (5, 7)]
    out = bb.roll_up(bars(spark, rows)).orderBy("date").collect()
    assert [(r["open"], r["high"], r["low"], r["close"], r["volume"], r["has_gaps"]) for r in out] == [
        (1.0, 6.0, 0.0, 5.5, 50, False),
        (5.0, 7.0, 5.0, 7.0, 20, True),
    ]


def test_keep_within_and_missed_days(spark):
    df = two_days(spark)
    bounds = bb.date_bounds(df.where("ticker = 'A' and close between 12 and 14"))
    kept = bb.keep_within(df, bounds)
    assert [r["close"] for r in kept.where("ticker = 'A'").orderBy("date").collect()] == [13.0, 14.0]
    assert kept.where("ticker = 'B'").count() == 10
    assert bb.missed_days(df, df.where("close < 20")).count() == 3


def test_ingest(spark):
    df = two_days(spark)
    done = ingest.ingest_bars(df.where("false"), ingest.as_raw(df, "5 mins"), "5 mins", bars_per_day=6, retained_rows=7, daily=df)
    assert rows_of(done.bars.groupBy("ticker").count(), "ticker", "count") == [("A", 7), ("B", 6)]
    assert rows_of(done.bounds, "ticker", "vol_max", "vol_min") == [("A", 105, 100), ("B", 105, 100)]
    assert rows_of(done.requests.withColumn("day", F.col("day").cast("string")), "ticker", "day") == [("B", "2024-01-03")]


def test_set_newest_and_carry(spark):
    df = two_days(spark).where("ticker = 'A'").select("ticker", "date", "close")
    updates = spark.createDataFrame([("A", None, 1.0), ("A", at("2024-01-02 10:00:00"), 2.0)], "ticker string, date timestamp_ntz, value double")
    closes = [r["close"] for r in bb.set_newest(df, updates, "close").orderBy("date").collect()]
    assert closes[0] == 2.0 and closes[-1] == 1.0 and closes[1] == 12.0


def test_session_context_in_exchange_time(spark):
    rows = [
        ("A", "2024-07-01 13:30:00", 1, 1, 1, 1, 1),
        ("A", "2024-07-01 19:59:00", 2, 2, 2, 2, 1),
        ("A", "2024-07-02 13:30:00", 3, 3, 3, 3, 1),
        ("A", "2024-12-02 14:30:00", 4, 4, 4, 4, 1),
    ]
    out = bb.session_context(bars(spark, rows)).orderBy("day").collect()
    assert [(str(r["day"]), r["day_open"], r["prev_day_close"]) for r in out] == [
        ("2024-07-01", 1.0, None),
        ("2024-07-02", 3.0, 2.0),
        ("2024-12-02", 4.0, 2.0),
    ]
