"""Standing bid and ask per contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BID, ASK = 1, 2


def standing_quotes(quotes: DataFrame) -> DataFrame:
    """Last bid and ask at every quote, once both are known.

    A contract may hold any share of the quotes, so it is cut by minute: inside one a
    window carries the last values, and those of earlier minutes come from one summary
    row per minute.
    """
    keys = ["contract", "_minute"]
    sides = {"bid": F.when(F.col("field") == BID, F.col("price")), "ask": F.when(F.col("field") == ASK, F.col("price"))}
    tagged = quotes.withColumn("_minute", F.date_trunc("minute", "ts")).withColumns(sides)
    ends = tagged.groupBy(*keys).agg(
        *[F.max_by(name, F.when(F.col(name).isNotNull(), F.col("ts"))).alias(f"_{name}") for name in sides]
    )
    before = Window.partitionBy("contract").orderBy("_minute").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(*keys, *[F.last(f"_{name}", ignorenulls=True).over(before).alias(f"_{name}") for name in sides])
    inside = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    carried = tagged.withColumns({name: F.last(name, ignorenulls=True).over(inside) for name in sides})
    return (
        carried.join(earlier, keys)
        .withColumns({name: F.coalesce(name, f"_{name}") for name in sides})
        .where(F.col("bid").isNotNull() & F.col("ask").isNotNull())
        .select(*quotes.columns, *sides)
    )
