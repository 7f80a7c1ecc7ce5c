"""Bar building, completeness, gap filling, newest rows."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.registry import query
from barloom.functions import scalars as sf
from barloom.operators import bars as bb
from barloom.operators import calendar as cal
from barloom.operators import series
from barloom.plans import gaps, ingest

BAR = "ticker, date, open, high, low, close, volume, count"
DAY = "CAST(date AS DATE) AS day"


@query("a01_minute_bar", f"SELECT {BAR} FROM minutes")
def a01(spark, d):
    return b.minutes(spark, d)


@query("a02_full_days_only", f"SELECT b.ticker, date, open, high, low, close, volume, count, day FROM bars b JOIN day_counts c ON c.ticker = b.ticker AND c.day = CAST(b.date AS DATE) WHERE n = 12")
def a02(spark, d):
    return bb.full_days_only(b.bars(spark, d), 12)


@query(
    "a03_five_minute_bar",
    """SELECT ticker, time_bucket(INTERVAL '5 minutes', date) AS date, arg_min(open, date) AS open, max(high) AS high, min(low) AS low,
    arg_max(close, date) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(count) AS BIGINT) AS count, count(*) < 5 AS has_gaps
    FROM minutes GROUP BY 1, 2""",
)
def a03(spark, d):
    return bb.roll_up(b.minutes(spark, d))


def _holidays(spark, d):
    """Known short days: those of one ticker."""
    short = bb.day_counts(b.bars(spark, d)).where((F.col("bars") != 12) & (F.col("ticker") == "view"))
    return short.select("ticker", "day")


@query("a04_non_full_days", "SELECT ticker, day, n AS bars FROM day_counts WHERE n <> 12 AND ticker <> 'view'")
def a04(spark, d):
    return bb.non_full_days(b.bars(spark, d), _holidays(spark, d), 12)


@query("u06_incomplete_bars", f"SELECT b.ticker, date, open, high, low, close, volume, count, day FROM bars b JOIN day_counts c ON c.ticker = b.ticker AND c.day = CAST(b.date AS DATE) WHERE n <> 12")
def u06(spark, d):
    return bb.incomplete_bars(b.bars(spark, d), 12)


@query("p05_is_full_day", "SELECT ticker, day, n AS bars, n = 12 AS is_full FROM day_counts")
def p05(spark, d):
    return bb.day_counts(b.bars(spark, d)).withColumn("is_full", F.col("bars") == 12)


@query("a14_incomplete_test_days", "SELECT ticker, day, n AS bars FROM day_counts30 WHERE n <> 48 AND (ticker, day) NOT IN (SELECT (ticker, day) FROM day_counts WHERE n <> 12 AND ticker = 'view')")
def a14(spark, d):
    return bb.incomplete_test_days(b.bars(spark, d, "30 minutes"), _holidays(spark, d), 48)


@query("a16_distinct_days", "SELECT DISTINCT ticker, CAST(date AS DATE) AS day FROM minutes")
def a16(spark, d):
    return bb.distinct_days(b.minutes(spark, d))


@query("a17_date_bounds", "SELECT ticker, min(date) AS first_date, max(date) AS last_date FROM minutes GROUP BY 1")
def a17(spark, d):
    return bb.date_bounds(b.minutes(spark, d))


@query("a24_register_non_full_day", "SELECT ticker, day FROM day_counts WHERE n <> 12")
def a24(spark, d):
    known = _holidays(spark, d)
    return bb.register_non_full_days(known, bb.non_full_days(b.bars(spark, d), known, 12))


@query("a24_drop_non_full_day", f"SELECT b.ticker, date, open, high, low, close, volume, count, day FROM bars30 b JOIN day_counts c ON c.ticker = b.ticker AND c.day = CAST(b.date AS DATE) WHERE n = 12")
def a24_drop(spark, d):
    found = bb.day_counts(b.bars(spark, d)).where(F.col("bars") != 12)
    return bb.drop_non_full_days(b.bars(spark, d, "30 minutes"), found)


def _open_days(spark, d):
    return bb.day_counts(b.bars(spark, d, "30 minutes")).where(F.col("bars") != 48)


@query("j12_missing_minutes_anti", "SELECT ticker, day, date FROM missing30")
def j12(spark, d):
    return bb.missing_bars(b.bars(spark, d, "30 minutes"), _open_days(spark, d), b.HALF_HOURS)


NEAREST = """SELECT ticker, day, date, source_date, open, high, low, close, volume, count FROM (
  SELECT m.ticker, m.day, m.date, b.date AS source_date, open, high, low, close, volume, count,
    row_number() OVER (PARTITION BY m.ticker, m.date ORDER BY abs(epoch(b.date) - epoch(m.date)), b.date) AS rn
  FROM missing30 m JOIN bars30 b ON b.ticker = m.ticker AND CAST(b.date AS DATE) = m.day) WHERE rn = 1"""


@query("j11_nearest_bar_join", NEAREST)
def j11(spark, d):
    return bb.fill_from_nearest(b.bars(spark, d, "30 minutes"), _open_days(spark, d), b.HALF_HOURS)


@query("a15_illiquid_tickers", "SELECT ticker, day, CAST(count(*) AS BIGINT) AS gaps FROM missing30 GROUP BY 1, 2 HAVING count(*) > 10")
def a15(spark, d):
    return bb.illiquid_days(j12(spark, d))


FILLED = f"""SELECT {BAR}, false AS has_gaps FROM bars30
  UNION ALL SELECT ticker, date, open, high, low, close, volume, count, true AS has_gaps FROM ({NEAREST})"""


@query("a23_fill_absent", FILLED)
def a23(spark, d):
    return gaps.fill_absent(b.bars(spark, d, "30 minutes"), b.HALF_HOURS).bars


def _calendar(spark):
    """New York sessions of the month: two closed days and an early close."""
    closed = spark.createDataFrame([("2024-01-01",), ("2024-01-15",)], "day string").select(F.to_date("day").alias("day"))
    short = spark.createDataFrame([("2024-01-19", "13:00")], "day string, closes string")
    days = cal.days_between(spark, "2024-01-01", "2024-01-31")
    return cal.session_calendar(days, closed=closed, short=short.withColumn("day", F.to_date("day")))


@query("j12_session_missing", "SELECT ticker, day, date FROM session_missing30")
def j12_session(spark, d):
    bars, calendar = b.bars(spark, d, "30 minutes"), _calendar(spark)
    return bb.missing_bars(bars, cal.short_of_bars(bars, calendar, "30 minutes"), b.HALF_HOURS, calendar)


SESSION_NEAREST = NEAREST.replace("missing30", "session_missing30").replace(
    "JOIN bars30 b ON b.ticker = m.ticker AND CAST(b.date AS DATE) = m.day", "JOIN session_bars30 b ON b.ticker = m.ticker AND b.day = m.day"
)


@query("j11_session_nearest", SESSION_NEAREST)
def j11_session(spark, d):
    bars, calendar = b.bars(spark, d, "30 minutes"), _calendar(spark)
    return bb.fill_from_nearest(bars, cal.short_of_bars(bars, calendar, "30 minutes"), b.HALF_HOURS, calendar)


@query(
    "a23_fill_sessions",
    f"""SELECT {BAR}, false AS has_gaps FROM bars30
  UNION ALL SELECT ticker, date, open, high, low, close, volume, count, true AS has_gaps FROM ({SESSION_NEAREST})""",
)
def a23_sessions(spark, d):
    return gaps.fill_absent(b.bars(spark, d, "30 minutes"), b.HALF_HOURS, calendar=_calendar(spark)).bars


@query("a15_illiquid_sessions", "SELECT ticker, day, CAST(count(*) AS BIGINT) AS gaps FROM session_missing30 GROUP BY 1, 2 HAVING count(*) > 3")
def a15_sessions(spark, d):
    return gaps.fill_absent(b.bars(spark, d, "30 minutes"), b.HALF_HOURS, threshold=3, calendar=_calendar(spark)).illiquid


@query(
    "j13_range_delete_join",
    f"""SELECT m.ticker, m.date, m.open, m.high, m.low, m.close, m.volume, m.count FROM minutes m
    JOIN (SELECT ticker, min(date) AS lo, max(date) AS hi FROM bars GROUP BY 1) x ON x.ticker = m.ticker
    WHERE m.date > lo AND m.date <= hi""",
)
def j13(spark, d):
    return bb.keep_within(b.minutes(spark, d), bb.date_bounds(b.bars(spark, d)))


@query(
    "j14_missed_dates_anti",
    """SELECT DISTINCT ticker, CAST(date AS DATE) AS day FROM daily WHERE (ticker, CAST(date AS DATE)) NOT IN
    (SELECT (ticker, CAST(date AS DATE)) FROM daily WHERE count > 1)""",
)
def j14(spark, d):
    """A day of one line has no intraday bars: one trade makes no series."""
    daily = b.daily(spark, d)
    return bb.missed_days(daily, daily.where(F.col("count") > 1))


@query("w20_retain_last_rows", f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 200")
def w20(spark, d):
    return bb.retain_newest(b.daily(spark, d), 200)


@query("k01_last_n_bars", f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM minutes) WHERE rn <= 50")
def k01(spark, d):
    return series.newest_rows(b.minutes(spark, d), 50)


@query("k01_first_n_bars", f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS rn FROM minutes) WHERE rn <= 500")
def k01_first(spark, d):
    return bb.oldest_rows(b.minutes(spark, d), 500)


@query("k02_latest_bar", f"SELECT {BAR} FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM daily) WHERE rn = 1")
def k02(spark, d):
    return bb.latest_bar(b.daily(spark, d))


@query("k03_latest_prev_day_close", "SELECT ticker, arg_max(prev_day_close, date) AS prev_day_close FROM prepared GROUP BY 1")
def k03(spark, d):
    return bb.latest_value(b.prepared(spark, d), "prev_day_close")


@query("k04_date_range_scan", f"SELECT {BAR} FROM minutes WHERE date BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-12 00:00:00'")
def k04(spark, d):
    return bb.bars_between(b.minutes(spark, d), b.moment("2024-01-08 00:00:00"), b.moment("2024-01-12 00:00:00"))


@query("k09_retain_daily", f"SELECT {BAR} FROM daily WHERE date > TIMESTAMP '1999-11-10 00:00:00'")
def k09(spark, d):
    return bb.retain_years(b.daily(spark, d), b.moment(b.DAILY_NOW))


def _holes(spark, d):
    odd = F.col("volume") % 3 == 0
    return b.daily(spark, d).select("ticker", "date", F.when(odd, F.col("close")).alias("mark"))


HOLES = "SELECT ticker, date, CASE WHEN volume % 3 = 0 THEN close END AS mark FROM daily"


@query("w17_carry_previous_value", f"SELECT ticker, date, coalesce(mark, lag(mark) OVER (PARTITION BY ticker ORDER BY date)) AS mark FROM ({HOLES})")
def w17(spark, d):
    return bb.carry_previous(_holes(spark, d), "mark")


@query("w16_carry_forward", f"SELECT ticker, date, last_value(mark IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mark FROM ({HOLES})")
def w16_carry(spark, d):
    return series.carry_forward(_holes(spark, d), ["mark"])


CONTEXT = """SELECT ticker, day, day_open, last_value(dc IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_day_close
  FROM (SELECT ticker, CAST(date - INTERVAL 5 HOUR AS DATE) AS day, max(CASE WHEN strftime(date - INTERVAL 5 HOUR, '%H:%M') = '09:30' THEN open END) AS day_open,
    max(CASE WHEN strftime(date - INTERVAL 5 HOUR, '%H:%M') = '15:30' THEN close END) AS dc FROM bars30 GROUP BY 1, 2)"""


@query("x23_session_bars", CONTEXT)
def x23(spark, d):
    return bb.session_context(b.bars(spark, d, "30 minutes"), close_at="15:30")


@query(
    "w23_seed_day_context",
    f"SELECT b.ticker, b.date, b.close, c.day, c.day_open, c.prev_day_close FROM bars30 b JOIN ({CONTEXT}) c ON c.ticker = b.ticker AND c.day = CAST(b.date - INTERVAL 5 HOUR AS DATE)",
)
def w23(spark, d):
    source = b.bars(spark, d, "30 minutes")
    seeded = bb.seed_day_context(source, bb.session_context(source, close_at="15:30"))
    return seeded.select("ticker", "date", "close", "day", "day_open", "prev_day_close")


@query(
    "x04_parse_bar_date",
    "SELECT ticker, date, CAST(date AS DATE) AS day_date, strftime(date, '%Y%m%d') AS day_key FROM minutes",
)
def x04(spark, d):
    raw = ingest.as_raw(b.minutes(spark, d), "1 min")
    return raw.select(
        "ticker",
        sf.parse_bar_date(F.col("date"), "1 min").alias("date"),
        sf.parse_bar_date(sf.day_key(F.col("date")), "1 day").cast("date").alias("day_date"),
        sf.day_key(F.col("date")).alias("day_key"),
    )


@query("x05_day_key", "SELECT strftime(date, '%Y%m%d') AS day_key, CAST(count(*) AS BIGINT) AS bars FROM minutes GROUP BY 1")
def x05(spark, d):
    raw = ingest.as_raw(b.minutes(spark, d), "1 min")
    return raw.groupBy(sf.day_key(F.col("date")).alias("day_key")).agg(F.count(F.lit(1)).alias("bars"))


@query(
    "x18_days_to_download",
    f"""SELECT ticker, days, CAST(coalesce(floor(days / 30.0), 24) AS INTEGER) AS periods, anchor FROM (
      SELECT ticker, CAST(floor((epoch(TIMESTAMP '2001-11-10 00:00:00') - epoch(max(date))) / 86400) AS INTEGER) AS days FROM daily GROUP BY 1) x,
      LATERAL (SELECT CAST(DATE '2001-11-10' - to_months(CAST(g.range AS INTEGER)) AS DATE) AS anchor FROM range(CAST(coalesce(floor(days / 30.0), 24) AS BIGINT) + 1) g)""",
)
def x18(spark, d):
    return ingest.request_dates(b.daily(spark, d), b.moment(b.DAILY_NOW))


@query("x19_minute_marks", "SELECT ticker, ts, second(ts) = 0 AS beginning, second(ts) = 55 AS ending, minute(ts) % 5 = 0 AS fifth FROM ticks")
def x19(spark, d):
    ts = F.col("ts")
    return b.ticks(spark, d).select(
        "ticker", "ts", sf.minute_beginning(ts).alias("beginning"), sf.minute_ending(ts).alias("ending"), sf.fifth_minute(ts).alias("fifth")
    )


@query("s22_ingest_bars", f"SELECT {BAR}, false AS has_gaps FROM bars b WHERE (ticker, CAST(date AS DATE)) IN (SELECT (ticker, day) FROM day_counts WHERE n = 12)")
def s22(spark, d):
    source = b.bars(spark, d)
    return ingest.ingest_bars(source.where(F.lit(False)), ingest.as_raw(source, "5 mins"), "5 mins", bars_per_day=12).bars


@query("s22_ingest_daily", f"SELECT {BAR}, false AS has_gaps FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM daily) WHERE rn <= 500")
def s22_daily(spark, d):
    source = b.daily(spark, d)
    return ingest.ingest_bars(source.where(F.lit(False)), ingest.as_raw(source, "1 day"), "1 day", retained_rows=500).bars


@query("s22_ingest_minutes", f"SELECT {BAR}, false AS has_gaps FROM minutes")
def s22_minutes(spark, d):
    """The first half is stored, the second half and a day of the first come in again."""
    source = b.minutes(spark, d)
    half = b.moment("2024-01-16 00:00:00")
    landed = ingest.as_raw(source.where(F.col("date") >= half - F.expr("INTERVAL 1 DAY")), "1 min")
    return ingest.ingest_bars(source.where(F.col("date") < half), landed, "1 min", retained_rows=400 * 1440).bars


@query("s22_known_holidays", "SELECT ticker, day FROM day_counts WHERE n <> 12")
def s22_holidays(spark, d):
    """Non-full days known before and found now, each once."""
    source = b.bars(spark, d)
    return ingest.ingest_bars(
        source.where(F.lit(False)), ingest.as_raw(source, "5 mins"), "5 mins", bars_per_day=12, holidays=_holidays(spark, d)
    ).holidays


@query("s22_missing_day_requests", "SELECT ticker, day FROM day_counts WHERE n <> 12")
def s22_missing(spark, d):
    source = b.bars(spark, d)
    done = ingest.ingest_bars(source.where(F.lit(False)), ingest.as_raw(source, "5 mins"), "5 mins", bars_per_day=12, daily=source)
    return done.requests


@query(
    "s22_volume_bounds",
    "SELECT ticker, max(volume) AS vol_max, min(volume) AS vol_min FROM bars WHERE (ticker, CAST(date AS DATE)) IN (SELECT (ticker, day) FROM day_counts WHERE n = 12) GROUP BY 1",
)
def s22_bounds(spark, d):
    source = b.bars(spark, d)
    return ingest.ingest_bars(source.where(F.lit(False)), ingest.as_raw(source, "5 mins"), "5 mins", bars_per_day=12).bounds


