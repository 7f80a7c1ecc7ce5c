"""Connected components by alternating stars over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.stage import stage


def components(links: DataFrame, kind: str) -> DataFrame:
    """`node, root` of every node of the links `a, b`: root is the smallest node of its component.

    Large stars hang larger neighbours on the smallest one, small stars the smaller ones; every
    round is written to the shared folder, so a lost executor costs only its own tasks. Rounds end
    when the links stay as they are: all nodes then point at their root.
    """
    a, b = F.col("a").cast(kind), F.col("b").cast(kind)
    now = links.filter(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()
    now = stage(now, "links")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.select("a", F.col("low").alias("b")).unionByName(
            small.filter(F.col("b") != F.col("low")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        )
        now = stage(small.distinct(), "links")
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == mark:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = new
