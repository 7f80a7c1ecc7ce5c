"""Live executions and commissions.

A join of two streams that keeps single rows costs some calls to the state store for each row. Here rows of both
sides are dealt over buckets of ids, and the rows that a batch brings to a bucket are joined and stored as one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.streaming.bars import watermarked
from barloom.streaming.state import ORDER_BUCKETS

# Rows of a bucket that are joined and stored at once, and pairs that go out at once
PART_ROWS = 1 << 19


def near_pairs(left: pd.DataFrame, right: pd.DataFrame, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the rows (id, at) of both sides with one id and times at most `bound` apart; null ids meet none.

    The right side is sorted by id and time, and each left row takes one stretch of it, however often an id comes.
    """
    codes, _ = pd.factorize(np.concatenate([left["id"].to_numpy(object), right["id"].to_numpy(object)]))
    own, other = codes[: len(left)].astype("int64"), codes[len(left) :].astype("int64")
    at, times = left["at"].to_numpy("int64"), right["at"].to_numpy("int64")
    known = np.flatnonzero(other >= 0)
    stamps = np.unique(times)
    width = len(stamps) + 1
    placed = other[known] * width + np.searchsorted(stamps, times[known])
    order = np.argsort(placed, kind="stable")
    placed, known = placed[order], known[order]
    first = np.searchsorted(placed, own * width + np.searchsorted(stamps, at - bound, "left"))
    found = np.searchsorted(placed, own * width + np.searchsorted(stamps, at + bound, "right")) - first
    found[own < 0] = 0
    ends = np.cumsum(found)
    done = 0
    while done < len(left) and ends[-1] > (before := ends[done - 1] if done else 0):
        upto = max(done + 1, int(np.searchsorted(ends, before + PART_ROWS, "right")))
        n = found[done:upto]
        mine = np.repeat(np.arange(done, upto), n)
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        if len(mine):
            yield mine, known[np.repeat(first[done:upto], n) + step]
        done = upto


class NearJoin(StatefulProcessor):
    """Joins the rows of a bucket as they come, and keeps them until the watermark has passed all that may meet them.

    Rows wait in parts. A part's key has its side, the time that it is due by, its first and last time and its number,
    so parts are read only for rows near them, and go unread. With `outer`, left rows are marked once met, and the
    others go out with nulls behind the watermark.
    """

    def __init__(self, columns: list[str], left: list[str], right: list[str], bound: int, outer: bool):
        self.columns, self.left, self.right, self.bound, self.outer = columns, left, right, bound, outer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.parts = handle.getMapState("parts", "paid boolean, due bigint, first bigint, last bigint, part bigint", "rows binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for part in rows:
            # Names that begin with an underscore come renamed.
            held.append(part.set_axis(self.columns, axis=1))
            n += len(part)
            if n >= PART_ROWS:
                yield from self.meet(held)
                held, n = [], 0
        if n:
            yield from self.meet(held)
        self.wake(timerValues.getCurrentWatermarkInMs())

    def meet(self, held: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        paid, rows = rows["paid"].to_numpy(bool), rows.assign(met=False)
        sent = [name for name in self.columns if name.startswith("value_")]
        left = rows.loc[~paid, ["id", "at", "met", *sent[: len(self.left)]]].reset_index(drop=True)
        right = rows.loc[paid, ["id", "at", "met", *sent[: len(self.right)]]].reset_index(drop=True)
        left, right = left.set_axis(["id", "at", "met", *self.left], axis=1), right.set_axis(["id", "at", "met", *self.right], axis=1)
        stored = self.keys()
        yield from self.pairs(left, right)
        for k in stored:
            of_right, _, first, last, number = k
            new = left if of_right else right
            if not len(new) or last + self.bound < new["at"].min() or first - self.bound > new["at"].max():
                continue
            waiting = self.read(k)
            if of_right:
                yield from self.pairs(left, waiting)
                continue
            before = waiting["met"].sum()
            yield from self.pairs(waiting, right)
            if self.outer and waiting["met"].sum() > before:
                self.parts.removeKey(k)
                self.keep(False, waiting, number)
        number = max((k[-1] for k in stored), default=-1) + 1
        self.keep(False, left, number)
        self.keep(True, right, number)

    def pairs(self, left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Joined rows; left rows that were met are marked."""
        if not len(left) or not len(right):
            return
        met = left["met"].to_numpy(bool).copy()
        for mine, other in near_pairs(left, right, self.bound):
            met[mine] = True
            taken = right[self.right].take(other).reset_index(drop=True)
            yield pd.concat([left[["id", "at", *self.left]].take(mine).reset_index(drop=True), taken], axis=1)
        left["met"] = met

    def keys(self) -> list[tuple]:
        return sorted((bool(k[0]), *[int(v) for v in k[1:]]) for k in self.parts.keys())

    def keep(self, paid: bool, rows: pd.DataFrame, number: int) -> None:
        """Store rows as a part; it is due with its last row, or with `outer` with its first left row not met."""
        if not len(rows):
            return
        first, last = int(rows["at"].min()), int(rows["at"].max())
        open_ = rows.loc[~rows["met"].to_numpy(bool), "at"] if self.outer and not paid else rows["at"][:0]
        batch = pa.RecordBatch.from_pandas(rows, preserve_index=False)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema) as writer:
            writer.write_batch(batch)
        due = int(open_.min()) if len(open_) else last
        self.parts.updateValue((paid, due, first, last, number), (sink.getvalue().to_pybytes(),))

    def read(self, k: tuple) -> pd.DataFrame:
        return pa.ipc.open_stream(bytes(self.parts.getValue(k)[0])).read_all().to_pandas()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for k in self.keys():
            paid, due, _, last, number = k
            if due + self.bound >= mark * 1000:
                continue
            rows = self.read(k) if self.outer and not paid else None
            self.parts.removeKey(k)
            if rows is not None:
                passed = rows["at"].to_numpy("int64") + self.bound < mark * 1000
                alone = rows[passed & ~rows["met"].to_numpy(bool)].reset_index(drop=True)
                self.keep(paid, rows[~passed].reset_index(drop=True), number)
                if len(alone):
                    yield alone[["id", "at", *self.left]].assign(**dict.fromkeys(self.right))
        self.wake(mark)

    def wake(self, mark: int) -> None:
        """A timer where the first part is due, unless one stands before it; the watermark has spent those it reached."""
        due = min((k[1] for k in self.keys()), default=None)
        if due is None:
            return
        at = (due + self.bound) // 1000 + 1
        if not any(mark < t <= at for t in self.handle.listTimers()):
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


def executions_with_commissions(
    executions: DataFrame,
    commissions: DataFrame,
    delay: str = "1 hour",
    within: str = "1 day",
    how: str = "inner",
    buckets: int = ORDER_BUCKETS,
) -> DataFrame:
    """Join both streams by execution id, whichever comes first, within a time bound.

    With ``how="left_outer"`` an execution whose commission has not come leaves once, with nulls, when the
    watermark has passed its time by the bound. The watermark is that of the side that is behind. Rows without a
    time meet none and do not come out. Columns travel as text, which holds all their values, nulls and NaN apart.
    """
    if how not in ("inner", "left_outer"):
        raise ValueError(f"inner or left_outer, not {how}")
    ends = F.unix_micros(F.timestamp_seconds(F.lit(0)) + F.expr(f"INTERVAL {within}"))
    bound = executions.sparkSession.range(1).select(ends).first()[0]
    fields = [f for f in executions.schema if f.name not in ("execution_id", "date")]
    others = [f for f in commissions.schema if f.name not in ("execution_id", "date")]
    left, right = [f"left_{i}" for i in range(len(fields))], [f"right_{i}" for i in range(len(others))]
    bucket = F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")

    def side(rows: DataFrame, paid: bool) -> DataFrame:
        texts = [F.col(f"`{f.name}`").cast("string") for f in (others if paid else fields)]
        texts += [F.lit(None).cast("string")] * (max(len(left), len(right)) - len(texts))
        every = [text.alias(f"value_{i}") for i, text in enumerate(texts)]
        timed = watermarked(rows, "date", delay).where(F.col("date").isNotNull())
        at = F.unix_micros("date").alias("at")
        return timed.select(F.col("execution_id").cast("string").alias("id"), "date", at, F.lit(paid).alias("paid"), *every)

    both = side(executions, False).unionByName(side(commissions, True)).select(bucket, "*")
    processor = NearJoin(both.columns, left, right, bound, how == "left_outer")
    output = ", ".join(["id string", "at bigint", *[f"{name} string" for name in [*left, *right]]])
    joined = both.groupBy("bucket").transformWithStateInPandas(processor, output, "append", "eventtime")

    def restored(name: str) -> Column:
        if name == "execution_id":
            return F.col("id").cast(executions.schema[name].dataType).alias(name)
        if name == "date":
            return F.timestamp_micros("at").cast("timestamp_ntz").alias(name)
        place = [f.name for f in fields].index(name)
        return F.col(left[place]).cast(fields[place].dataType).alias(name)

    paid = [F.col(name).cast(f.dataType).alias(f.name) for name, f in zip(right, others)]
    return joined.select(*map(restored, executions.columns), *paid)
