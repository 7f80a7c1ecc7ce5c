"""Keyed state in event time: day context, standing quotes, order status.

Rows of a key wait in the state store until the watermark has passed them, and then go on in the order
of their times, whatever order files and batches brought them in. A row that comes after its time has been
passed is late; Spark drops and counts it. Waiting rows lie in slices of time, and one slice of a key is in
memory at once, so a key may hold any share of a batch. A slice is written in parts and read once.

Every key costs some calls to the state store and some small frames. Where keys are many and each has few rows,
as orders have, the state is kept by a bucket of keys, and a slice holds the rows of all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegralType, StructField, StructType, TimestampNTZType, TimestampType

from barloom.streaming.bars import DELAY, watermarked

TERMINAL = ("filled", "cancelled")
HOUR, DAY = 3_600_000, 86_400_000
KEEP_FINISHED = DAY
# Rows of a key that are put together before they are stored
PART_ROWS = 1 << 18
# Orders are dealt over so many keys of state; a slice of one is in memory at once
ORDER_BUCKETS = 256

Known = tuple | None


@dataclass(frozen=True)
class Advanced:
    """What a key knows after some rows, and the rows that go out."""

    known: Known
    rows: pd.DataFrame


Advance = Callable[[tuple, Known, pd.DataFrame], Advanced]
# What a key still knows at a watermark, given a reader of its waiting rows, and when to ask again (ms), if at all
Forget = Callable[[Known, int, Callable[[], pd.DataFrame]], tuple[Known, int | None]]


def millis(times: pd.Series) -> pd.Series:
    """Milliseconds, upwards: a watermark of as much has reached the time."""
    return -(-times.astype("datetime64[us]").astype("int64") // 1000)


def stored(rows: pd.DataFrame, schema: StructType) -> list[tuple]:
    """Rows as the state store takes them: plain values, times as microseconds, missing ones as null."""
    columns = []
    for f in schema:
        values, known = rows[f.name], rows[f.name].notna()
        if isinstance(f.dataType, TimestampType | TimestampNTZType):
            values = values.astype("datetime64[us]").astype("int64")
        elif isinstance(f.dataType, IntegralType):
            values = values.map(int, na_action="ignore")
        columns.append([v if k else None for v, k in zip(values.astype(object).tolist(), known)])
    return list(zip(*columns))


def restored(rows: list, schema: StructType) -> pd.DataFrame:
    frame = pd.DataFrame([tuple(r) for r in rows], columns=schema.names)
    times = [f.name for f in schema if isinstance(f.dataType, TimestampType | TimestampNTZType)]
    return frame.assign(**{name: pd.to_datetime(frame[name], unit="us") for name in times})


def kind_of(f: StructField) -> str:
    return "bigint" if isinstance(f.dataType, TimestampType | TimestampNTZType) else f.dataType.simpleString()


class InTimeOrder(StatefulProcessor):
    """Hands each key's rows to `advance` by time, behind the watermark.

    A timer stands at the first waiting row of a key, so keys without new rows go on as well. Rows of one time
    are ordered by their other columns.
    """

    def __init__(
        self, time: str, key: str, schema: StructType, known: str, advance: Advance, slice_ms: int, forget: Forget | None = None
    ):
        self.time, self.known_schema, self.advance, self.slice_ms, self.forget = time, known, advance, slice_ms, forget
        self.columns, self.schema = schema.names, StructType([f for f in schema if f.name != key])

    def init(self, handle: StatefulProcessorHandle) -> None:
        fields = ",".join(f"`{f.name}`:{kind_of(f)}" for f in self.schema)
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "start bigint, part bigint", f"rows array<struct<{fields}>>")
        self.known = handle.getValueState("known", self.known_schema)
        self.again = handle.getValueState("again", "at bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first, held, n = None, [], 0
        number = max((int(k[1]) for k in self.waiting.keys()), default=-1) + 1
        for part in rows:
            # Names that begin with an underscore come renamed.
            held.append(part.set_axis(self.columns, axis=1))
            n += len(part)
            if n >= PART_ROWS:
                first, number, held, n = self.keep(held, number, first), number + 1, [], 0
        if n:
            first = self.keep(held, number, first)
        if first is not None:
            self.wake(first, timerValues.getCurrentWatermarkInMs())
        return iter(())

    def keep(self, held: list[pd.DataFrame], number: int, first: int | None) -> int:
        """Store rows as a part of each of their slices; the least of `first` and their times."""
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        times = millis(rows[self.time])
        for start, own in rows.groupby(times // self.slice_ms * self.slice_ms):
            self.waiting.updateValue((int(start), number), (stored(own, self.schema),))
        return int(times.min()) if first is None else min(first, int(times.min()))

    def slice(self, keys: list[tuple[int, int]]) -> pd.DataFrame:
        return restored([row for k in keys for row in self.waiting.getValue(k)[0]], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        slices: dict[int, list[tuple[int, int]]] = {}
        for k in sorted((int(k[0]), int(k[1])) for k in self.waiting.keys()):
            slices.setdefault(k[0], []).append(k)
        known = self.known.get() if self.known.exists() else None
        begun = known is not None
        wakes, left = [], []
        for start, parts in slices.items():
            if start > mark:
                wakes.append(start)
                left += parts
                continue
            rows = self.slice(parts)
            times = millis(rows[self.time])
            passed = times <= mark
            if passed.any():
                for k in parts:
                    self.waiting.removeKey(k)
                if not passed.all():
                    self.waiting.updateValue(parts[0], (stored(rows[~passed], self.schema),))
            if not passed.all():
                left += parts[:1] if passed.any() else parts
                wakes.append(int(times[~passed].min()))
            if passed.any():
                rows = rows[passed].sort_values([self.time, *[n for n in rows.columns if n != self.time]], kind="stable")
                done = self.advance(key, known, rows.reset_index(drop=True))
                known = done.known
                yield done.rows
        if known is not None and self.forget:
            known, again = self.forget(known, mark, lambda: self.slice(left))
            if again is not None:
                self.again.update((again,))
                wakes.append(again)
            elif self.again.exists():
                self.again.clear()
        if known is not None:
            self.known.update(known)
        elif begun:
            self.known.clear()
        if wakes:
            self.wake(min(wakes), mark)

    def wake(self, at: int, mark: int) -> None:
        """A timer that the watermark has reached is spent in this batch and does not count."""
        if not any(mark < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def in_time_order(
    rows: DataFrame,
    key: str,
    time: str,
    output: str,
    known: str,
    advance: Advance,
    slice_ms: int,
    out_time: str = "",
    forget: Forget | None = None,
) -> DataFrame:
    """Run `advance` over each key's rows; `time` needs a watermark, `out_time` names the one that goes on downstream."""
    processor = InTimeOrder(time, key, rows.schema, known, advance, slice_ms, forget)
    return rows.groupBy(key).transformWithStateInPandas(processor, output, "append", "eventtime", eventTimeColumnName=out_time)


def _watched(rows: DataFrame, time: str, delay: str | None) -> DataFrame:
    """Rows that have a watermark already pass with `delay` None."""
    return rows if delay is None else watermarked(rows, time, delay)


def _filled(values: pd.Series, start: float | None) -> pd.Series:
    """Carry the last known value forward, beginning with the stored one."""
    return pd.concat([pd.Series([start], dtype="float64"), values.astype("float64")]).ffill().iloc[1:].set_axis(values.index)


def _number(value) -> float | None:
    return None if pd.isna(value) else float(value)


def day_state(bars: DataFrame, delay: str | None = DELAY, time: str = "date", bars_per_day: int | None = None) -> DataFrame:
    """All columns of the bars, with day_open and prev_day_close stamped on every one (ticker, date, open, close).

    The previous close is that of the day before. With `bars_per_day` it is the close of the last bar of the
    latest day that has had so many, and the day's open before there is one.
    """
    watched = _watched(bars, time, delay)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in watched.schema)
    output = f"{kinds}, day_open double, prev_day_close double"
    known = "day string, day_open double, seen int, last_close double, prev_day_close double"
    names = [*watched.columns, "day_open", "prev_day_close"]

    def advance(key: tuple, state: Known, rows: pd.DataFrame) -> Advanced:
        day, day_open, seen, last_close, previous = state or (None, None, 0, None, None)
        stamps = []
        for at, open_, close in zip(rows["date"].dt.strftime("%Y-%m-%d"), rows["open"], rows["close"]):
            if at != day:
                if bars_per_day is None:
                    previous = last_close
                day, day_open, seen = at, _number(open_), 0
            seen += 1
            stamps.append((day_open, previous if bars_per_day is None or previous is not None else day_open))
            last_close = _number(close)
            if seen == bars_per_day:
                previous = last_close
        stamped = rows.assign(ticker=key[0])
        stamped[["day_open", "prev_day_close"]] = pd.DataFrame(stamps, dtype="float64").to_numpy()
        return Advanced((day, day_open, seen, last_close, previous), stamped[names])

    stamped = in_time_order(watched, "ticker", time, output, known, advance, DAY, time)
    return stamped if delay is None else stamped.withColumn(time, F.col(time).cast("timestamp_ntz"))


def quote_state(quotes: DataFrame, delay: str = DELAY) -> DataFrame:
    """Standing bid and ask per contract at every quote (contract, ts, field, price), once both are known."""
    watched = watermarked(quotes.select("contract", "ts", "field", "price"), "ts", delay)
    output = "contract string, ts timestamp, field int, price double, bid double, ask double"

    def advance(key: tuple, state: Known, rows: pd.DataFrame) -> Advanced:
        bid, ask = state or (None, None)
        rows = rows.assign(contract=key[0], price=rows["price"].astype("float64"))
        rows["bid"] = _filled(rows["price"].where(rows["field"] == 1), bid)
        rows["ask"] = _filled(rows["price"].where(rows["field"] == 2), ask)
        ends = _number(rows["bid"].iloc[-1]), _number(rows["ask"].iloc[-1])
        return Advanced(ends, rows.dropna(subset=["bid", "ask"])[["contract", "ts", "field", "price", "bid", "ask"]])

    standing = in_time_order(watched, "contract", "ts", output, "bid double, ask double", advance, 6 * HOUR, "ts")
    return standing.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def status_stream(
    events: DataFrame, delay: str = DELAY, keep_finished: int = KEEP_FINISHED, buckets: int = ORDER_BUCKETS
) -> DataFrame:
    """Status changes per order (order_id, event_time, status), up to the first final one; the order is then done.

    A finished order is remembered for `keep_finished` ms behind its last event, to ignore what still comes
    for it; then its state goes. Orders are many and have few events each, so state is kept by bucket of orders.
    """
    bucket = F.pmod(F.xxhash64("order_id"), F.lit(buckets)).cast("int")
    # pandas would hold a column with nulls as doubles, which do not hold every id
    numbered = [F.coalesce("order_id", F.lit(0)).cast("long").alias("order_id"), F.col("order_id").isNull().alias("unnamed")]
    known = events.where(F.col("status").isNotNull()).select(bucket.alias("bucket"), *numbered, "event_time", "status")
    watched = watermarked(known, "event_time", delay)
    output = "order_id long, unnamed boolean, event_time timestamp, status string, removed boolean"
    order, kept = ["unnamed", "order_id"], ["unnamed", "order_id", "last", "done", "until"]
    held = "unnamed array<boolean>, order_id array<bigint>, last array<string>, done array<boolean>, until array<bigint>"

    def orders(state: Known) -> pd.DataFrame:
        columns = state or [[] for _ in kept]
        kinds = {"unnamed": bool, "order_id": "int64", "last": object, "done": bool, "until": "int64"}
        return pd.DataFrame({name: pd.Series(list(values), dtype=kinds[name]) for name, values in zip(kept, columns)})

    def packed(found: pd.DataFrame) -> Known:
        return tuple(found[name].tolist() for name in kept) if len(found) else None

    def advance(key: tuple, state: Known, rows: pd.DataFrame) -> Advanced:
        before = orders(state)
        rows = rows.merge(before[[*order, "last", "done"]], on=order, how="left")
        one = [rows[name] for name in order]
        final = rows["status"].isin(TERMINAL).astype("int64")
        over = (rows["done"].eq(True)) | (final.groupby(one).cumsum() > final)
        before_it = rows.groupby(order)["status"].shift()
        earlier = before_it.where(before_it.notna(), rows["last"])
        out = rows[~over & (rows["status"] != earlier)]
        changes = out[["order_id", "unnamed", "event_time", "status"]].assign(removed=out["status"].isin(TERMINAL))
        ends = rows.assign(
            last=rows["status"], done=over | (final > 0), until=millis(rows["event_time"]) + keep_finished
        ).drop_duplicates(order, keep="last")
        after = pd.concat([before, ends[kept]], ignore_index=True).drop_duplicates(order, keep="last")
        return Advanced(packed(after), changes.reset_index(drop=True))

    def forget(state: Known, mark: int, waiting: Callable[[], pd.DataFrame]) -> tuple[Known, int | None]:
        """Finished orders go in time, unless events of theirs wait; those events ask again."""
        found = orders(state)
        ripe = found["done"] & (found["until"] <= mark)
        if ripe.any():
            busy = pd.MultiIndex.from_frame(waiting()[order])
            found = found[~(ripe & ~pd.MultiIndex.from_frame(found[order]).isin(busy))]
        later = found.loc[found["done"] & (found["until"] > mark), "until"]
        return packed(found), int(later.min()) if len(later) else None

    changes = in_time_order(watched, "bucket", "event_time", output, held, advance, DAY, "event_time", forget)
    named = changes.select(F.when(~F.col("unnamed"), F.col("order_id")).alias("order_id"), "event_time", "status", "removed")
    return named.withColumn("event_time", F.col("event_time").cast("timestamp_ntz"))
