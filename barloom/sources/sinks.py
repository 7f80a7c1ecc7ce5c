"""Sinks. A table is a Parquet folder partitioned by ticker, or by ticker and day."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import scalars as sf
from barloom.operators.bars import with_day
from barloom.operators.series import spread_join
from barloom.sources.tables import scan

FILE_ROWS = 20_000_000
RAW_COLUMNS = ["open", "high", "low", "close", "volume", "day", "day_open"]


def replace_by_key(df: DataFrame, path: str, key: Sequence[str] = ("ticker",), file_rows: int = FILE_ROWS) -> None:
    """Replace the partitions of the keys in ``df``, leave all others.

    Rows are rebalanced by key: adaptive execution splits a key by its measured size into tasks of the
    session's advisory size and puts small keys together, so a key with ten times the rows is written by ten
    times the tasks and no small key gets a file from every task. A file holds at most ``file_rows`` rows.
    """
    (
        df.hint("rebalance", *key)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("maxRecordsPerFile", file_rows)
        .partitionBy(*key)
        .parquet(path)
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def truncate_table(spark: SparkSession, path: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def copy_snapshot(table: DataFrame, path: str) -> None:
    """Replace a staging table by the rows of another."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)


def write_prepared(features: DataFrame, path: str) -> None:
    """Feature rows by ticker, without the raw bar columns."""
    replace_by_key(features.drop(*RAW_COLUMNS), path)


def drop_day(bars: DataFrame, day: Column) -> DataFrame:
    return bars.where(~F.col("date").cast("date").eqNullSafe(day))


def replace_days(bars: DataFrame, path: str) -> None:
    """Replace whole days of a table partitioned by day."""
    replace_by_key(with_day(bars), path, ["day"])


def replace_day(bars: DataFrame, path: str, day: str) -> None:
    """Replace one day of such a table, also by no rows at all."""
    rows = bars.where(F.col("date").cast("date") == F.lit(day).cast("date"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/day={day}")


def typed_bars(raw: DataFrame, time_frame: str) -> DataFrame:
    """Raw bars with date text to typed bars; rows without a date are skipped."""
    return raw.where(F.col("date").isNotNull()).select(
        "ticker",
        sf.parse_bar_date(F.col("date"), time_frame).alias("date"),
        "open",
        "high",
        "low",
        "close",
        F.col("volume").cast("bigint").alias("volume"),
        F.col("count").cast("bigint").alias("count"),
        F.coalesce(F.col("has_gaps"), F.lit(False)).alias("has_gaps"),
    )


def upsert_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Bars after a keyed write: new bars replace those with the same ticker and date.

    A duplicate among the new bars keeps the one with the most trades.
    """
    rest = [name for name in existing.columns if name not in ("ticker", "date")]
    fresh = incoming.groupBy("ticker", "date").agg(F.max_by(F.struct(*rest), F.struct("count", *rest)).alias("_bar"))
    fresh = fresh.select("ticker", "date", "_bar.*")
    kept = existing.join(fresh.select("ticker", "date"), ["ticker", "date"], "left_anti")
    return kept.unionByName(fresh.select(*existing.columns))


def read_back(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path)


def partial_update(table: DataFrame, updates: DataFrame, key: Sequence[str]) -> DataFrame:
    """Set the fields an update supplies; null fields and unknown keys change nothing."""
    fields = [name for name in updates.columns if name not in key]
    renamed = updates.withColumnsRenamed({name: f"_{name}" for name in fields})
    merged = table.join(renamed, list(key), "left")
    return merged.withColumns({name: F.coalesce(f"_{name}", name) for name in fields}).select(*table.columns)


def upsert(table: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    """Insert unknown keys, else overwrite with the fields that are not null."""
    fields = [name for name in table.columns if name not in key]
    given = [name for name in fields if name in incoming.columns]
    renamed = incoming.select(*key, *[F.col(name).alias(f"_{name}") for name in given])
    merged = table.join(renamed, list(key), "full_outer")
    return merged.withColumns({name: F.coalesce(f"_{name}", name) for name in given}).select(*table.columns)


def latest_event(events: DataFrame, key: str, order: str) -> DataFrame:
    """Snapshot of an event log: the newest event per key."""
    rest = [name for name in events.columns if name != key]
    return events.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def attach_industry(bars: DataFrame, trade_params: DataFrame) -> DataFrame:
    return spread_join(bars, trade_params.select("ticker", "industry"), ["ticker"], ["date"], "left")
