"""Small frames written by hand."""

from datetime import datetime, timedelta

BAR = "ticker string, date timestamp_ntz, open double, high double, low double, close double, volume bigint, count bigint"


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


def bars(spark, rows):
    """Rows of (ticker, date, open, high, low, close, volume)."""
    full = [(t, at(d) if isinstance(d, str) else d, float(o), float(h), float(lo), float(c), v, 1) for t, d, o, h, lo, c, v in rows]
    return spark.createDataFrame(full, BAR)


def ramp(spark, n, tickers=("A",), step=timedelta(days=1), start="2000-01-01"):
    """Bars whose close counts 1..n, high and low around it."""
    first = at(start)
    rows = [
        (t, first + i * step, i + 1.0, i + 1.5 + (i * 37 % 11), i + 0.5 - (i * 53 % 7), i + 1.0 + (i * 29 % 13), (i * 7) % 50 + 1)
        for t in tickers
        for i in range(n)
    ]
    return bars(spark, rows)


def rows_of(df, *names):
    return sorted(tuple(row) for row in df.select(*names).collect())
