"""Training on a small separable set, sinks and documents."""

import random
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from barloom.operators import learning as ml
from barloom.operators import models
from barloom.plans import daytrade
from barloom.session import fresh_path
from barloom.sources import documents as docs
from barloom.sources import sinks
from barloom.sources.stage import Steps, stage
from tests.helpers import at, bars, rows_of
from tests.test_labels_orders import labelled


def separable(spark):
    """Rows whose high_delta follows the open delta and whose high_stop is one-sided."""
    rows = []
    for i in range(240):
        up = (i // 2) % 2 == 0
        rows.append((i, (i % 4) / 4, 1.0 + (0.2 if up else -0.2) + (i % 3) / 100, 1.0 + (i % 2) / 10, up, False))
    return labelled(spark, rows).cache()


def test_train_and_predict(spark):
    rows = separable(spark)
    trained = daytrade.train(rows)
    registry = trained.registry.collect()
    assert len(registry) == 48
    models = [r for r in registry if r["path"]]
    assert [(r["strategy"], r["action"], r["label"], r["session_period"]) for r in models] == [("trend", "buy", "high_delta", 1)]
    assert models[0]["area_under_roc"] > 0.95 and models[0]["reason"] is None
    reasons = {(r["strategy"], r["action"], r["label"], r["session_period"]): r["reason"] for r in registry if not r["path"]}
    assert reasons["trend", "buy", "high_stop", 1] == "one label value" and reasons["trend", "sell", "low_delta", 1] == "no rows"
    scored = ml.score(trained.rows, trained.registry)
    hits = scored.select("date", F.col("high_delta").alias("p")).join(rows.select("date", "high_delta"), "date")
    assert hits.where("p = high_delta").count() >= 0.95 * hits.count()
    assert scored.where("high_stop is not null").count() == 0
    out = daytrade.predict(trained)
    assert out.count() == rows.count()
    first = out.orderBy("date").first()
    assert first["high_delta"] is False and first["low_delta"] is None


def test_branches_say_why_there_is_no_model(spark):
    from barloom.operators.labels import long_labels

    long_rows = long_labels(separable(spark))
    pooled = {(r["strategy"], r["action"], r["session_period"], r["label"]): r for r in ml.branches(long_rows).collect()}
    assert len(pooled) == 48
    one = pooled["trend", "buy", 1, "high_delta"]
    assert one["reason"] is None and one["yes"] + one["no"] == 240
    held = long_rows.where((F.col("label") == "high_delta") & ml.held_back()).count()
    assert one["held_yes"] + one["held_no"] == held and 30 < held < 90
    named = ml.branches(long_rows, tickers=["A", "B"]).where("reason is null").collect()
    assert [(r["label"], r["ticker"]) for r in named] == [("high_delta", "A")]
    few = long_rows.where("label = 'high_delta'").orderBy(F.desc("value"), "date").limit(121)
    few = few.where(F.col("value")).limit(1).unionByName(few.where(~F.col("value")))
    assert ml.branches(few).where("reason is not null and yes > 0").select("reason").first()[0] == "no split"


LONG = "ticker string, action string, strategy string, session_period int, label string, date timestamp_ntz, volume_delta double, open_delta double, benchmark_delta double, value boolean"


def opposite(spark):
    """Tickers A and B follow the open delta in opposite ways, C has no model of its own."""
    rows = []
    for i in range(240):
        for ticker in "ABC":
            up = (i // 2) % 2 == 0
            when = at("2024-01-02 10:00:00") + timedelta(minutes=5 * i)
            rows.append((ticker, "buy", "trend", 1, "high_delta", when, (i % 4) / 4, 1.0 + (0.2 if up else -0.2) + (i % 3) / 100, 1.0 + (i % 2) / 10, up == (ticker != "B")))
    return spark.createDataFrame(rows, LONG)


def test_tickers_with_opposite_models_predict_oppositely(spark):
    long_rows = stage(opposite(spark), "opposite")
    root = fresh_path(spark, "models")
    registry = ml.train_classifiers(long_rows, root, tickers=["A", "B"]).unionByName(ml.train_classifiers(long_rows, root))
    registry = stage(registry.where("session_period = 1 and label = 'high_delta'"), "registry")
    rows = long_rows.drop("label", "value")
    rows = rows.unionByName(rows.limit(1).withColumns({"ticker": F.lit("A"), "open_delta": F.lit(None).cast("double"), "volume_delta": F.lit(9.0)}))
    for limit in (64 << 20, 1):
        scored = ml.score(rows, registry, model_bytes=limit)
        assert scored.columns == [*rows.columns, "high_delta", "low_delta", "high_stop", "low_stop"]
        got = {(r["ticker"], r["date"]): r["high_delta"] for r in scored.where("volume_delta < 9").collect()}
        right = {"A": 0, "B": 0, "C": 0}
        for r in long_rows.collect():
            right[r["ticker"]] += got[r["ticker"], r["date"]] == r["value"]
        assert right["A"] > 230 and right["B"] > 230
        # the pooled model follows the two of three
        assert right["C"] > 200 and scored.where("low_delta is not null").count() == 0
        assert [r["high_delta"] for r in scored.where("volume_delta = 9").collect()] == [None]


def test_a_search_has_the_partitions_its_rows_fill(spark, monkeypatch):
    """All rows of a branch train, on partitions by their count and not by the files they lie in."""
    whole = opposite(spark)
    files = stage(whole.repartition(16), "files")
    real, seen = ml.search, []

    def noted(data, *rest):
        seen.append((data.rdd.getNumPartitions(), data.count()))
        return real(data, False)

    monkeypatch.setattr(ml, "search", noted)
    for rows_per_task in (ml.ROWS_PER_TASK, 400):
        ml.train_classifiers(files, fresh_path(spark, "models"), rows_per_task=rows_per_task)
    assert seen == [(1, whole.count()), (2, whole.count())]


@pytest.mark.parametrize("kind", ["logistic", "forest", "perceptron"])
def test_numbers_of_a_model_predict_as_the_model(spark, kind):
    rng = random.Random(4)
    rows = [(int(a + b * b > 0.7 + rng.gauss(0, 0.2)), a, b, d) for a, b, d in ((rng.random(), rng.random(), rng.random()) for _ in range(400))]
    data = spark.createDataFrame(rows, "label int, volume_delta double, open_delta double, benchmark_delta double")
    chain = Pipeline(stages=[])
    which = {"logistic": 1, "forest": 4, "perceptron": 5}[kind]
    model = chain.fit(data, ml._param_maps(chain, 7)[which])
    path = f"{fresh_path(spark, 'model')}/one"
    model.write().save(path)
    numbers = models.load(spark, path)
    assert type(numbers).__name__.lower() == kind
    want = model.transform(data).select("volume_delta", "open_delta", "benchmark_delta", "prediction").toPandas()
    got = numbers.positive(want[ml.INPUTS].to_numpy())
    assert (got == (want["prediction"] > 0)).all() and 0 < got.mean() < 1


def test_area_of_a_search_equals_ranks(spark):
    """The registered area is that of the winner's scores on the rows held back, by ranks."""
    rows = [r for r in opposite(spark).where("ticker = 'A'").collect()]
    data = spark.createDataFrame(
        [(int(r["value"] != (i % 9 == 0)), r["volume_delta"], r["open_delta"], r["benchmark_delta"], i % 4 == 0) for i, r in enumerate(rows)],
        "label int, volume_delta double, open_delta double, benchmark_delta double, _held boolean",
    )
    _, area = ml.search(data, True, seed=3)
    chain = Pipeline(stages=[])
    areas = []
    for m in ml._param_maps(chain, 3):
        scored = chain.fit(data.where(~F.col("_held")), m).transform(data.where("_held"))
        points = [(r["label"], float(r["rawPrediction"][1])) for r in scored.select("label", "rawPrediction").collect()]
        pairs = [(y > n) + 0.5 * (y == n) for a, y in points if a for b, n in points if not b]
        areas.append(sum(pairs) / len(pairs))
    assert area == pytest.approx(max(areas), abs=0.02)


def test_replace_by_key_leaves_other_tickers(spark):
    path = fresh_path(spark, "table")
    first = bars(spark, [("A", "2024-01-02 10:00:00", 1, 1, 1, 1, 1), ("B", "2024-01-02 10:00:00", 2, 2, 2, 2, 2)])
    sinks.replace_by_key(first, path)
    sinks.replace_by_key(bars(spark, [("B", "2024-01-03 10:00:00", 3, 3, 3, 3, 3)]), path)
    assert rows_of(spark.read.parquet(path), "ticker", "close") == [("A", 1.0), ("B", 3.0)]


def test_upsert_bars_keeps_one_per_time(spark):
    old = bars(spark, [("A", "2024-01-02 10:00:00", 1, 1, 1, 1, 1), ("A", "2024-01-02 10:05:00", 2, 2, 2, 2, 2)])
    twice = [("A", "2024-01-02 10:05:00", 7, 7, 7, 7, 7)] * 2
    assert rows_of(sinks.upsert_bars(old, bars(spark, twice)), "close") == [(1.0,), (7.0,)]


def test_xml_attributes_lists_and_missing_text(spark):
    schema = "item ARRAY<STRUCT<_VALUE: STRING, _unit: STRING>>, name STRING"
    xml = '<est><name>x</name><item unit="a">1</item><item unit="b">2</item></est>'
    df = spark.createDataFrame([("T", xml), ("U", None)], "ticker string, xml string")
    now = F.lit(at("2024-01-02 00:00:00")).cast("timestamp_ntz")
    out = {r["ticker"]: r["estimates"] for r in docs.read_estimates(df, schema, "est", now).collect()}
    assert out["T"] == '{"est":{"item":[{"item":"1","itemAttrs":{"unit":"a"}},{"item":"2","itemAttrs":{"unit":"b"}}],"name":"x"}}'
    assert out["U"] is None


def test_result_tokens(spark):
    html = '<p>no</p><div id="screener-content"><table><tr><td>AAA</td>\n<td>BB  C</td></tr></table></div>'
    pages = spark.createDataFrame([(1, html), (2, "<p>none</p>")], "page_id int, html string")
    assert rows_of(docs.tickers_from_pages(pages), "page_id", "ticker") == [(1, "AAA"), (1, "BB"), (1, "C")]


def test_partial_update_and_upsert(spark):
    table = spark.createDataFrame([("A", 1, "x"), ("B", 2, None)], "ticker string, conid int, industry string")
    new = spark.createDataFrame([("A", None, "y"), ("C", 3, "z")], "ticker string, conid int, industry string")
    assert rows_of(sinks.partial_update(table, new, ["ticker"]).fillna("-"), "ticker", "conid", "industry") == [("A", 1, "y"), ("B", 2, "-")]
    assert rows_of(sinks.upsert(table, new, ["ticker"]).fillna("-"), "ticker", "conid", "industry") == [("A", 1, "y"), ("B", 2, "-"), ("C", 3, "z")]



def test_a_larger_key_is_written_by_more_tasks(spark, tmp_path):
    """Files follow the measured size of a key; the other keys of the table stay."""
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "40KB")
    try:
        path = str(tmp_path / "sized")
        sinks.replace_by_key(spark.createDataFrame([("OLD", 1, "x")], "ticker string, id long, text string"), path)
        rows = spark.range(0, 22000, 1, 16).select(
            F.when(F.col("id") % 11 == 0, "SMALL").otherwise("LARGE").alias("ticker"), "id", F.sha2(F.col("id").cast("string"), 256).alias("text")
        )
        sinks.replace_by_key(rows, path)
        files = {t: len(list((tmp_path / "sized" / f"ticker={t}").glob("*.parquet"))) for t in ("OLD", "SMALL", "LARGE")}
        assert files["OLD"] == 1 and files["SMALL"] <= 4 and files["LARGE"] >= 3 * files["SMALL"]
        back = spark.read.parquet(path)
        assert back.count() == 22001 and back.select("id", "ticker").distinct().count() == 22001
    finally:
        spark.conf.unset(size)


def test_steps_remove_their_own_files_only(spark):
    steps = Steps()
    kept = stage(spark.range(5).select(F.col("id").alias("n"), (F.col("id") * 2).alias("twice")), "kept")
    first = steps.stage(kept, "first")
    result = stage(steps.stage(first.where("n > 1"), "second", ["n"]), "result")
    folders = {Path(f.removeprefix("file:")).parent for f in first.inputFiles()}
    steps.remove()
    assert folders and not any(folder.exists() for folder in folders)
    assert kept.count() == 5 and sorted(r["n"] for r in result.collect()) == [2, 3, 4]
    steps.remove()
