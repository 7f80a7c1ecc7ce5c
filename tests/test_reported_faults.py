"""Inputs that once gave wrong rows: mixed updates, nulls in means, tables that are folders."""

import math

import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from barloom.operators import learning, models
from barloom.operators.orders import apply_order_updates, status_update
from barloom.operators.series import Trailing
from barloom.session import fresh_path
from barloom.streaming.runs import file_stream, run_to_table


def test_status_and_move_of_one_order_both_count(spark):
    orders = spark.createDataFrame(
        [(1, None, 0.5, "2024-01-01", 9.0), (2, "new", 0.5, "2024-01-01", None)],
        "ib_id long, ib_status string, trailing_percent double, date string, traded_price double",
    )
    updates = spark.createDataFrame(
        [
            (1, 1, "filled", None, None, None),
            (1, 2, None, None, "2024-01-05", 0.1),
            (1, 3, None, 11.0, None, None),
            (3, 1, "filled", 1.0, None, None),
        ],
        "ib_id long, event_time int, status string, traded_price double, new_date string, new_trailing double",
    )
    rows = {r["ib_id"]: r for r in apply_order_updates(orders, updates).collect()}
    assert tuple(rows[1][c] for c in ("ib_status", "trailing_percent", "date", "traded_price")) == ("filled", 0.1, "2024-01-05", 11.0)
    assert tuple(rows[2][c] for c in ("ib_status", "trailing_percent", "date", "traded_price")) == ("new", 0.5, "2024-01-01", None)


def test_report_without_a_status_leaves_it(spark):
    instructions = spark.createDataFrame(
        [(1, "new", "new", None, 5)], "instruction_id long, order_status string, db_status string, fill_price double, ib_id long"
    )
    feed = spark.createDataFrame(
        [(1, 1, "filled", 9.5, None), (1, 2, None, None, 77)],
        "instruction_id long, event_time int, status string, new_fill_price double, new_ib_id long",
    )
    row = status_update(instructions, feed).first()
    assert (row["order_status"], row["db_status"], row["fill_price"], row["ib_id"]) == ("filled", "filled", 9.5, 77)


@pytest.mark.parametrize("values", [[1.0, None, 3.0, None, 5.0], [None, None, 2.0], [1.0, math.nan, 3.0, 4.0, 5.0, None]])
def test_means_equal_plain_windows(spark, values):
    rows = spark.createDataFrame(
        [("A", 0, i, v) for i, v in enumerate(values)], "ticker string, _chunk int, seq long, close double"
    )
    got = Trailing(("ticker",)).with_means(rows, "close", {"mean": 3}).orderBy("seq").collect()
    for i, r in enumerate(got):
        frame = [v for v in values[max(0, i - 2) : i + 1] if v is not None]
        want = sum(frame) / len(frame) if frame else None
        assert r["mean"] == want or (want is not None and math.isnan(want) and math.isnan(r["mean"]))


def test_stream_of_a_folder_table_equals_that_of_a_file(spark, tmp_path):
    table = spark.range(100).selectExpr("id", "id * 2 AS twice")
    table.repartition(5).write.parquet(str(tmp_path / "events.parquet"))
    stream = file_stream(spark, str(tmp_path), "id long, twice long", "events.parquet")
    out, _ = run_to_table(stream, "copy", str(tmp_path / "out"))
    assert out.count() == 100


def test_rows_with_missing_inputs_stay_in_scoring(spark):
    rows = spark.createDataFrame(
        [(1, 0.1, 0.2, 0.3, 0), (2, 0.9, 0.8, 0.7, 1), (3, None, 0.2, 0.3, 0), (4, 0.1, math.nan, 0.3, 1)],
        "id int, volume_delta double, open_delta double, benchmark_delta double, label int",
    )
    chain = Pipeline(stages=[learning.assembler(), LogisticRegression(maxIter=5)])
    model = chain.fit(rows.where(learning.inputs_known()))
    path = f"{fresh_path(spark, 'model')}/one"
    model.write().save(path)
    numbered = rows.withColumn("_model_high_delta", F.lit(0))
    scored = models.predict(numbered, {0: models.load(spark, path)}, learning.INPUTS, ["high_delta"])
    found = {r["id"]: r["high_delta"] for r in scored.collect()}
    assert found == {1: False, 2: True, 3: None, 4: None}
    arrays = {r["id"]: r["features"] for r in learning.feature_arrays(rows).collect()}
    assert arrays[3] == [None, 0.2, 0.3] and arrays[4] == [0.1, None, 0.3] and arrays[1] == [0.1, 0.2, 0.3]
