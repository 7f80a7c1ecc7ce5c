"""Per-ticker series work that never gathers a whole ticker in one task.

A ticker may hold any share of all rows. Its series is therefore cut twice:

* by calendar month, to number rows and to carry values: a month of one ticker has a
  bounded number of bars, and the per-month summaries are a few hundred rows a century;
* by row number into chunks of ``CHUNK_ROWS``, for trailing frames: each chunk also gets
  copies of the few rows before it, so frames are exact at its edge.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK_ROWS = 8192
JOIN_COPIES = 16
HOT_SHARE = 256
TRACKED_KEYS = 1 << 14
# exp(600) is within the range of a double; exp(-1455) times the largest double is below the least one
VANISHED, REPRESENTABLE = 1455.0, 600.0


def day_of(date: str | Column = "date") -> Column:
    return F.col(date).cast("date") if isinstance(date, str) else date.cast("date")


def month_of(date: str = "date") -> Column:
    return F.trunc(day_of(date), "month")


def hot_copies(rows: DataFrame, key: Sequence[str]) -> Column:
    """Copies of each key that holds over 1/256 of the rows, by the hash of the key, as a scalar subquery.

    A frequent-items sketch counts the keys in the plan's own run, so the map has at most 256 entries and the
    copies of all keys together are no more than about 512, whatever the number of rows.
    """
    top = F.expr(f"approx_top_k(_key, {HOT_SHARE}, {TRACKED_KEYS})")
    counted = rows.select(F.xxhash64(*key).alias("_key")).agg(top.alias("top"), F.count(F.lit(1)).alias("n"))
    hot = F.filter("top", lambda x: x["count"] * HOT_SHARE > F.col("n"))
    copies = F.transform(hot, lambda x: F.struct(x["item"], F.ceil(x["count"] * HOT_SHARE / F.col("n")).cast("int")))
    return counted.select(F.map_from_entries(copies).alias("copies")).scalar()


def spread_join(
    rows: DataFrame,
    table: DataFrame,
    key: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    copies: int = JOIN_COPIES,
    measured: DataFrame | None = None,
) -> DataFrame:
    """Join rows to a table with one row per key, hot keys split over several tasks.

    With ``measured``, a frame whose keys are spread like those of the rows, a key gets as many copies as its
    share of that frame asks for and all others stay single; else every key has ``copies``. The result is the
    same whatever was measured. Spark still broadcasts the table when its size is below the session's threshold.
    """
    split = F.lit(copies)
    if measured is not None:
        split = F.coalesce(F.element_at(hot_copies(measured, key), F.xxhash64(*key)), F.lit(1))
    slot = F.pmod(F.xxhash64(*spread_by), split).cast("int")
    slots = F.explode(F.sequence(F.lit(0), split - 1))
    return (
        rows.withColumn("_slot", slot)
        .join(table.withColumn("_slot", slots), [*key, "_slot"], how)
        .drop("_slot")
    )


def number_rows(
    rows: DataFrame,
    key: Sequence[str] = ("ticker",),
    order: str = "date",
    name: str = "seq",
    newest_first: bool = False,
) -> DataFrame:
    """0-based position of every row in its series."""
    month = [*key, "_month"]
    tagged = rows.withColumn("_month", month_of(order))
    by = F.desc if newest_first else F.asc
    counts = tagged.groupBy(*month).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(by("_month")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*month, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*month).orderBy(by(order)))
    return (
        tagged.withColumn("_inside", inside)
        .join(starts, month)
        .withColumn(name, F.col("_start") + F.col("_inside") - 1)
        .drop("_month", "_inside", "_start")
    )


def newest_rows(
    rows: DataFrame, n: int, key: Sequence[str] = ("ticker",), order: str = "date"
) -> DataFrame:
    """The newest ``n`` rows of each series.

    Small ``n`` becomes a ranked limit that Spark also applies before the shuffle;
    large ``n`` is counted by month.
    """
    if n <= 100:
        rank = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
    numbered = number_rows(rows, key, order, "_back", newest_first=True)
    return numbered.where(F.col("_back") < n).drop("_back")


def carry_forward(
    rows: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = ("ticker",),
    order: str = "date",
) -> DataFrame:
    """Fill nulls with the latest earlier non-null value of the series."""
    month = [*key, "_month"]
    tagged = rows.withColumn("_month", month_of(order))
    seen = tagged.groupBy(*month).agg(
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order))).alias(f"_{name}") for name in columns]
    )
    before = Window.partitionBy(*key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    earlier = seen.select(
        *month, *[F.last(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}") for name in columns]
    )
    inside = Window.partitionBy(*month).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    filled = tagged.withColumns({name: F.last(name, ignorenulls=True).over(inside) for name in columns})
    return (
        filled.join(earlier, month)
        .withColumns({name: F.coalesce(name, f"_{name}") for name in columns})
        .select(*rows.columns)
    )


def previous_values(
    rows: DataFrame,
    columns: Sequence[str],
    key: Sequence[str] = ("ticker",),
    order: str = "date",
    prefix: str = "previous_",
) -> DataFrame:
    """Add the values of the row before, null on the first row of a series."""
    month = [*key, "_month"]
    tagged = rows.withColumn("_month", month_of(order))
    ends = tagged.groupBy(*month).agg(*[F.max_by(name, order).alias(name) for name in columns])
    earlier = ends.select(
        *month, F.lag(F.struct(*columns)).over(Window.partitionBy(*key).orderBy("_month")).alias("_end")
    )
    inside = Window.partitionBy(*month).orderBy(order)
    return (
        tagged.withColumn("_before", F.lag(F.struct(*columns)).over(inside))
        .join(earlier, month)
        .withColumn("_before", F.coalesce("_before", "_end"))
        .select(*rows.columns, *[F.col(f"_before.{name}").alias(f"{prefix}{name}") for name in columns])
    )


class Trailing:
    """Trailing frames inside the chunks of :func:`trailing`.

    Means come from running sums and long extremes from block extremes, so the work per
    row does not grow with the frame. With ``block``, rows have their block of so many; the order names it
    as well, which moves no row and lets one sort serve the chunks and their blocks.
    """

    def __init__(self, key: Sequence[str], block: int | None = None) -> None:
        self.keys, self.block = [*key, "_chunk"], block

    @property
    def ordered(self) -> WindowSpec:
        by = ["seq"] if self.block is None else ["_block", "seq"]
        return Window.partitionBy(*self.keys).orderBy(*by)

    def last(self, n: int) -> WindowSpec:
        return self.ordered.rowsBetween(1 - n, 0)

    def with_means(self, rows: DataFrame, source: str, targets: dict[str, int]) -> DataFrame:
        """Mean of the last n rows' values, of all so far where there are fewer.

        As with a plain average, nulls are left out, a frame of nulls gives null, and a frame with a NaN gives NaN.
        """
        before = self.ordered.rowsBetween(Window.unboundedPreceding, 0)
        value, odd = F.col(source), F.lit(False)
        if dict(rows.dtypes)[source] in ("double", "float"):
            odd = F.coalesce(F.isnan(value), F.lit(False))
            value = F.when(odd, F.lit(0).cast(dict(rows.dtypes)[source])).otherwise(value)

        def inside(name: str, n: int) -> Column:
            return F.col(name) - F.coalesce(F.lag(name, n).over(self.ordered), F.lit(0))

        def mean(n: int) -> Column:
            plain = F.when(inside("_n", n) > 0, inside("_sum", n) / inside("_n", n))
            return F.when(inside("_nan", n) > 0, F.lit(float("nan"))).otherwise(plain)

        running = {
            "_sum": F.coalesce(F.sum(value).over(before), F.lit(0)),
            "_n": F.count(source).over(before),
            "_nan": F.sum(odd.cast("int")).over(before),
        }
        return rows.withColumns(running).withColumns({name: mean(n) for name, n in targets.items()}).drop(*running)

    def with_extremes(self, rows: DataFrame, n: int, highest: dict[str, str], lowest: dict[str, str]) -> DataFrame:
        """Maximum (``target: source``) and minimum of the last n values.

        With the series cut into blocks of n rows, a frame is the end of one block and the
        start of the next: a running extreme forward and one backward answer every frame. The backward one
        comes first, so that all that go forward share a sort; best before other columns are added.
        """
        block = Window.partitionBy(*self.keys, "_block")
        forward = block.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        backward = block.orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, 0)
        parts = [(F.max, F.greatest, highest), (F.min, F.least, lowest)]
        heads = {f"_head_{t}": pick(src).over(forward) for pick, _, names in parts for t, src in names.items()}
        tails = {f"_tail_{t}": pick(src).over(backward) for pick, _, names in parts for t, src in names.items()}
        found = {
            t: join(F.col(f"_head_{t}"), F.lag(f"_tail_{t}", n - 1).over(self.ordered))
            for _, join, names in parts
            for t in names
        }
        if self.block == n:
            return rows.withColumns(tails).withColumns(heads).withColumns(found).drop(*heads, *tails)
        blocks = rows.withColumn("_block", F.floor(F.col("seq") / n))
        return blocks.withColumns(tails).withColumns(heads).withColumns(found).drop("_block", *heads, *tails)


def trailing(
    rows: DataFrame,
    reach: int,
    add: Callable[[DataFrame, Trailing], DataFrame],
    key: Sequence[str] = ("ticker",),
    order: str = "date",
    chunk_rows: int = CHUNK_ROWS,
    block: int | None = None,
) -> DataFrame:
    """Add columns over the last n rows, n - 1 summing up to at most ``reach``.

    Every chunk gets copies of the ``reach`` rows before it. The result keeps ``seq`` and
    ``_chunk``. ``block`` is the frame of the extremes, if there are any.
    """
    chunk_rows = max(chunk_rows, reach + 1)
    numbered = rows if "seq" in rows.columns else number_rows(rows, key, order)
    chunk = F.floor(F.col("seq") / chunk_rows)
    own = F.struct(chunk.alias("chunk"), F.lit(True).alias("own"))
    ahead = F.struct((chunk + 1).alias("chunk"), F.lit(False).alias("own"))
    near_end = F.col("seq") % chunk_rows >= chunk_rows - reach
    copies = F.explode(F.when(near_end, F.array(own, ahead)).otherwise(F.array(own)))
    chunks = (
        numbered.withColumn("_copy", copies)
        .withColumns({"_chunk": F.col("_copy.chunk"), "_own": F.col("_copy.own")})
        .drop("_copy")
    )
    if block is not None:
        chunks = chunks.withColumn("_block", F.floor(F.col("seq") / block))
    return add(chunks, Trailing(key, block)).where("_own").drop("_own", "_block")


def exponential_averages(
    rows: DataFrame,
    value: str,
    spans: dict[str, int],
    key: Sequence[str] = ("ticker",),
    order: str = "date",
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Weighted averages with weights (1 - a)^age, a = 2 / (span + 1), over all earlier rows.

    Inside a chunk the weighted sum is a running sum of ``x * (1 - a)^-j`` scaled back;
    what came before enters through the totals of all chunks before it whose weight times the
    largest double is not zero, so nothing that a double can hold is cut. The sum of the
    weights has a closed form.
    """
    decay = {name: 1.0 - 2.0 / (span + 1) for name, span in spans.items()}
    fits = min(int(REPRESENTABLE / -math.log(keep)) for keep in decay.values())
    if "_chunk" in rows.columns and chunk_rows <= fits:
        numbered = rows
    else:
        chunk_rows = min(chunk_rows, fits)
        numbered = rows if "seq" in rows.columns else number_rows(rows, key, order)
        numbered = numbered.withColumn("_chunk", F.floor(F.col("seq") / chunk_rows))
    keys = [*key, "_chunk"]
    slot = F.col("seq") - F.col("_chunk") * chunk_rows
    running = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)

    totals = numbered.groupBy(*keys).agg(
        *[F.sum(F.col(value) * F.pow(F.lit(keep), chunk_rows - 1 - slot)).alias(name) for name, keep in decay.items()]
    )
    reach = max(math.ceil(VANISHED / (-math.log(keep) * chunk_rows)) for keep in decay.values())
    later = F.max("_chunk").over(Window.partitionBy(*key)) - F.col("_chunk")
    ages = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("_later"), F.lit(reach))))

    def faded(name: str, keep: float) -> Column:
        """A total after some chunks; in two steps, as the whole factor may be zero where the product is not."""
        steps = F.col("_age") - 1
        half = F.floor(steps / 2)
        return F.col(name) * F.pow(F.lit(keep), half * chunk_rows) * F.pow(F.lit(keep), (steps - half) * chunk_rows)

    carried = (
        totals.withColumn("_later", later)
        .where("_later > 0")
        .withColumn("_age", ages)
        .withColumn("_chunk", F.col("_chunk") + F.col("_age"))
        .groupBy(*keys)
        .agg(
            *[F.sum(faded(name, keep)).alias(f"_{name}") for name, keep in decay.items()]
        )
    )
    inside = numbered.withColumns(
        {
            name: F.sum(F.col(value) * F.pow(F.lit(keep), -slot)).over(running) * F.pow(F.lit(keep), slot)
            for name, keep in decay.items()
        }
    )
    joined = inside.join(carried, keys, "left")
    for name, keep in decay.items():
        weighted = F.col(name) + F.coalesce(F.col(f"_{name}"), F.lit(0.0)) * F.pow(F.lit(keep), slot + 1)
        weights = (1 - F.pow(F.lit(keep), F.col("seq") + 1)) / (1 - keep)
        joined = joined.withColumn(name, weighted / weights)
    return joined.drop(*[f"_{name}" for name in decay])
