"""Scans. Filters and column lists reach the Parquet reader; nothing is sorted here."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRICES = ["date", "open", "high", "low", "close", "volume"]


def scan(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def scan_bars(bars: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    """Key and price columns, of some tickers or of all."""
    picked = bars.where(F.col("ticker").isin(*tickers)) if tickers else bars
    return picked.select("ticker", *PRICES)


def jdbc_bars(
    spark: SparkSession, url: str, table: str, lower: str, upper: str, partitions: int, **options: str
) -> DataFrame:
    """Bars from a database, read in parallel by ranges of their date."""
    return (
        spark.read.format("jdbc")
        .options(url=url, dbtable=table, **options)
        .options(partitionColumn="date", lowerBound=lower, upperBound=upper, numPartitions=str(partitions))
        .load()
    )


def scan_prepared(bars: DataFrame, features: DataFrame) -> DataFrame:
    """Stored features with the close of their bar."""
    return bars.select("ticker", "date", "close").join(features, ["ticker", "date"])


def scan_train(features: DataFrame, keep_dates: DataFrame, possible_dates: DataFrame) -> DataFrame:
    """Labelled rows whose date is in both keep-lists of their group."""
    group = ["ticker", "action", "strategy", "session_period", "date"]
    return features.join(keep_dates.select(*group), group, "left_semi").join(
        possible_dates.select(*group), group, "left_semi"
    )


def scan_score(features: DataFrame, keep_dates: DataFrame, possible_dates: DataFrame) -> DataFrame:
    """All rows, with a mark whether both keep-lists hold their date."""
    group = ["ticker", "action", "strategy", "session_period", "date"]
    allowed = keep_dates.select(*group).join(possible_dates.select(*group), group, "left_semi")
    marked = allowed.distinct().withColumn("_allowed", F.lit(True))
    return features.join(marked, group, "left").withColumn("allowed", F.coalesce("_allowed", F.lit(False))).drop("_allowed")


def by_ticker(table: DataFrame, tickers: Sequence[str] | None = None) -> DataFrame:
    return table.where(F.col("ticker").isin(*tickers)) if tickers else table
