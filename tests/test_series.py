"""Cut windows against plain windows, across every kind of edge."""

import math

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import features as ff
from barloom.operators import series
from tests.helpers import at, bars, ramp, rows_of

def plain():
    return Window.partitionBy("ticker").orderBy("date")


def test_number_rows_across_months(spark):
    df = ramp(spark, 400, ("A", "B"))
    want = df.withColumn("seq", F.row_number().over(plain()) - 1)
    assert rows_of(series.number_rows(df), "ticker", "date", "seq") == rows_of(want, "ticker", "date", "seq")
    back = series.number_rows(df, name="back", newest_first=True).where("back = 0")
    assert rows_of(back, "ticker", "close") == rows_of(df.groupBy("ticker").agg(F.max_by("close", "date").alias("close")), "ticker", "close")


@pytest.mark.parametrize("n", [5, 150])
def test_newest_rows(spark, n):
    df = ramp(spark, 300, ("A", "B"))
    want = df.withColumn("r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("date")))).where(F.col("r") <= n)
    assert rows_of(series.newest_rows(df, n), "ticker", "date") == rows_of(want, "ticker", "date")


@pytest.mark.parametrize("chunk", [8, 16, 8192])
def test_means_across_chunks(spark, chunk):
    df = ramp(spark, 90, ("A", "B"))
    got = ff.moving_averages(df, "close", {"m": 5, "k": 8}, chunk_rows=chunk)
    want = df.withColumns({"m": F.avg("close").over(plain().rowsBetween(-4, 0)), "k": F.avg("close").over(plain().rowsBetween(-7, 0))})
    pairs = got.select("ticker", "date", "m", "k").join(want.select("ticker", "date", F.col("m").alias("wm"), F.col("k").alias("wk")), ["ticker", "date"])
    assert pairs.count() == 180
    assert pairs.where("abs(m - wm) > 1e-9 or abs(k - wk) > 1e-9").count() == 0


@pytest.mark.parametrize("chunk,n", [(8, 6), (10, 10), (50, 7), (8192, 20)])
def test_extremes_across_chunks_and_blocks(spark, chunk, n):
    df = ramp(spark, 100, ("A", "B"))

    def add(rows, frames):
        return frames.with_extremes(rows, n, {"top": "high"}, {"bottom": "low"})

    got = series.trailing(df, n - 1, add, chunk_rows=chunk)
    frame = plain().rowsBetween(1 - n, 0)
    want = df.withColumns({"top": F.max("high").over(frame), "bottom": F.min("low").over(frame)})
    assert rows_of(got, "ticker", "date", "top", "bottom") == rows_of(want, "ticker", "date", "top", "bottom")


@pytest.mark.parametrize("chunk,n", [(8, 6), (50, 7), (8192, 20)])
def test_extremes_in_the_order_of_blocks(spark, chunk, n):
    df = ramp(spark, 100, ("A", "B"))

    def add(rows, frames):
        return frames.with_means(frames.with_extremes(rows, n, {"top": "high"}, {"bottom": "low"}), "close", {"mean": 5})

    names = ["ticker", "date", "top", "bottom", "mean"]
    got = series.trailing(df, n - 1, add, chunk_rows=chunk, block=n)
    assert "_block" not in got.columns
    assert rows_of(got, *names) == rows_of(series.trailing(df, n - 1, add, chunk_rows=chunk), *names)


def test_screen_columns_sort_chunks_once_each_way(spark):
    """Each sort of a chunked table holds its rows while the others do."""
    plan = ff.screen_columns(ramp(spark, 40, ("A", "B")))._jdf.queryExecution().executedPlan().toString()
    assert sum("Sort [" in line and "_chunk" in line for line in plan.splitlines()) == 2


@pytest.mark.parametrize("chunk", [16, 100, 256, 8192])
def test_ema_against_direct_sum(spark, chunk):
    df = ramp(spark, 600)
    spans = {"fast": 12, "slow": 330}
    got = {r["seq"]: r for r in series.exponential_averages(df, "close", spans, chunk_rows=chunk).collect()}
    closes = [r["close"] for r in df.orderBy("date").collect()]
    for name, span in spans.items():
        keep, top, bottom = 1 - 2 / (span + 1), 0.0, 0.0
        for i, x in enumerate(closes):
            top, bottom = top * keep + x, bottom * keep + 1
            assert math.isclose(got[i][name], top / bottom, rel_tol=1e-11), (name, i)


def test_benchmark_averages_do_not_depend_on_chunks(spark):
    df = ramp(spark, 700, ("A", "B"))
    whole = {(r["ticker"], r["seq"]): r for r in ff.benchmark_averages(df).collect()}
    cut = ff.benchmark_averages(df, chunk_rows=211).collect()
    assert len(cut) == 1400
    for r in cut:
        w = whole[r["ticker"], r["seq"]]
        assert math.isclose(r["difference"], w["difference"], rel_tol=1e-9, abs_tol=1e-9)


def test_carry_forward_across_months(spark):
    df = ramp(spark, 200, ("A", "B")).withColumn("mark", F.when(F.dayofyear("date") % 70 == 3, F.col("close")))
    want = df.withColumn("mark", F.last("mark", ignorenulls=True).over(plain().rowsBetween(Window.unboundedPreceding, 0)))
    assert rows_of(series.carry_forward(df, ["mark"]).fillna(-1), "ticker", "date", "mark") == rows_of(want.fillna(-1), "ticker", "date", "mark")


def test_previous_values_keep_nulls(spark):
    df = ramp(spark, 100).withColumn("mark", F.when(F.dayofmonth("date") != 31, F.col("close")))
    want = df.withColumn("p", F.lag("mark").over(plain()))
    got = series.previous_values(df, ["mark"], prefix="p_").withColumnRenamed("p_mark", "p")
    assert rows_of(got.fillna(-1), "date", "p") == rows_of(want.fillna(-1), "date", "p")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, how):
    rows = spark.range(5000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40))
    table = spark.range(20).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = series.spread_join(rows, table, ["k"], ["id"], how)
    want = rows.join(table, "k", how)
    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(want.columns)
    assert rows_of(got.fillna(-1), *names) == rows_of(want.fillna(-1), *names)


def test_hot_key_is_split(spark):
    """A third of the rows on one key reach several tasks of the join."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(30000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
        table = spark.range(30000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        joined = series.spread_join(rows, table, ["k"], ["id"]).where("k = 0")
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8 and max(t["count"] for t in tasks) < 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_partition_invariance(spark):
    df = ramp(spark, 500, ("A", "B"))
    results = []
    for n in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        got = ff.screen_columns(df, chunk_rows=300).drop("seq").select(
            "ticker", "date", F.round("avg_volume", 9).alias("v"), F.round("average_true_range", 9).alias("r"), "new_high", "new_low"
        )
        results.append(rows_of(got, *got.columns))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]


def test_future_rows_change_nothing_backwards(spark):
    short, long = ramp(spark, 300), ramp(spark, 400)
    a = {r["seq"]: r["difference"] for r in ff.benchmark_averages(short).collect()}
    b = {r["seq"]: r["difference"] for r in ff.benchmark_averages(long).collect()}
    assert all(math.isclose(a[i], b[i], rel_tol=1e-12, abs_tol=1e-12) for i in a)


def test_single_bar(spark):
    one = bars(spark, [("A", at("2024-01-02 10:00:00"), 1, 2, 1, 2, 5)])
    row = ff.benchmark_averages(one).collect()[0]
    assert row["fast_ema"] == row["slow_sma"] == 1.5


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_measured_spread_join(spark, how):
    """The same rows as a plain join, also for null keys, whatever the frame that is measured."""
    k = F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 900)
    rows = spark.range(9000).withColumn("k", k)
    table = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    want = rows.join(table, "k", how)
    names = sorted(want.columns)
    for measured in (rows, rows.limit(0), table):
        got = series.spread_join(rows, table, ["k"], ["id"], how, measured=measured)
        assert sorted(got.columns) == names
        assert rows_of(got.fillna(-1), *names) == rows_of(want.fillna(-1), *names)


def test_copies_follow_the_share_of_a_key(spark):
    """A key with a third of the rows is split by its share; a table of uniform keys is not copied."""
    skewed = spark.range(30000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    copies = spark.range(1).select(series.hot_copies(skewed, ["k"]).alias("c"), F.xxhash64(F.lit(0).cast("long")).alias("h")).first()
    assert set(copies["c"]) == {copies["h"]} and 85 <= copies["c"][copies["h"]] <= 87
    uniform = spark.range(30000).select((F.col("id") % 3000).alias("k"))
    assert spark.range(1).select(series.hot_copies(uniform, ["k"])).first()[0] == {}


def test_hot_key_reaches_tasks_by_its_share(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(30000).withColumn("k", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")))
        table = spark.range(30000).select(F.col("id").alias("k"), F.lit(1).alias("v"))
        joined = series.spread_join(rows, table, ["k"], ["id"], measured=rows).where("k = 0")
        tasks = joined.groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) == 8 and max(t["count"] for t in tasks) < 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
