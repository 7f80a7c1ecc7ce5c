"""Classifier search, model registry and scoring with MLlib.

The searches are pooled over all tickers: one per action, strategy, label and period, a
fixed number whatever the data, each distributed over its rows. ``tickers`` adds the grain
of single tickers for a list the caller names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool
from operator import and_

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.operators import labels as ll
from barloom.operators import models
from barloom.schemas import MODEL_REGISTRY

INPUTS = ["volume_delta", "open_delta", "benchmark_delta"]
POOLED = "*"
# Every iteration of a fit is a job of one task a partition; fewer rows are not worth a task.
ROWS_PER_TASK = 1 << 16


@dataclass(frozen=True)
class Search:
    """One classifier search; ``ticker`` is ``*`` when pooled."""

    action: str
    strategy: str
    session_period: int
    label: str
    ticker: str = POOLED

    def rows(self) -> Column:
        same = (
            (F.col("action") == self.action)
            & (F.col("strategy") == self.strategy)
            & (F.col("session_period") == self.session_period)
        )
        return same if self.ticker == POOLED else same & (F.col("ticker") == self.ticker)


def assembler() -> VectorAssembler:
    """Missing inputs become NaN, so that no row is lost."""
    return VectorAssembler(inputCols=INPUTS, outputCol="features", handleInvalid="keep")


def assemble_features(rows: DataFrame) -> DataFrame:
    return assembler().transform(rows)


def feature_arrays(rows: DataFrame) -> DataFrame:
    """Features as arrays, null where an input is missing."""
    values = vector_to_array("features")
    return assemble_features(rows).withColumn("features", F.transform(values, lambda x: F.when(~F.isnan(x), x)))


def inputs_known() -> Column:
    """Whether no input is null or NaN."""
    known = F.lit(True)
    for name in INPUTS:
        known = known & F.col(name).isNotNull() & ~F.isnan(F.col(name).cast("double"))
    return known


def held_back(ticker: str = "ticker") -> Column:
    """Whether a row is kept for validation: a quarter of the rows, by their ticker and time."""
    name = F.concat_ws("|", F.col(ticker).cast("string"), F.col("date").cast("string"))
    return F.substring(F.md5(name), 1, 1).isin("0", "4", "8", "c")


def branches(long_rows: DataFrame, tickers: Sequence[str] = ()) -> DataFrame:
    """One row per branch of the fixed grid (for each ticker, if any are named): rows by label value and part, and `reason`.

    `reason` says why a branch has no model ('no rows', 'one label value') or one without a
    validation ('no split': a part lacks a label value); else it is null.
    """
    keys = ["ticker", "action", "strategy", "session_period", "label"]
    rows = long_rows.withColumn("_held", held_back())
    rows = rows.where(F.col("ticker").isin(*tickers)) if tickers else rows.withColumn("ticker", F.lit(POOLED))
    yes, held = F.col("value"), F.col("_held")
    counts = (
        rows.where(F.col("value").isNotNull() & inputs_known())
        .groupBy(*keys)
        .agg(
            F.count_if(yes).alias("yes"),
            F.count_if(~yes).alias("no"),
            F.count_if(yes & held).alias("held_yes"),
            F.count_if(~yes & held).alias("held_no"),
        )
    )
    grid = [
        (str(ticker), action, strategy, period, label)
        for ticker in (tickers or [POOLED])
        for strategy, action, *both in ll.LABEL_MATRIX
        for period in range(1, c.SESSION_PERIODS + 1)
        for label in both
    ]
    every = long_rows.sparkSession.createDataFrame(grid, "ticker string, action string, strategy string, session_period int, label string")
    joined = every.join(counts.withColumn("ticker", F.col("ticker").cast("string")), keys, "left").fillna(0, ["yes", "no", "held_yes", "held_no"])
    least = F.least("held_yes", "held_no", F.col("yes") - F.col("held_yes"), F.col("no") - F.col("held_no"))
    reason = (
        F.when(F.col("yes") + F.col("no") == 0, "no rows")
        .when(F.least("yes", "no") == 0, "one label value")
        .when(least == 0, "no split")
    )
    return joined.withColumn("reason", reason)


def _param_maps(chain: Pipeline, seed: int) -> list[dict]:
    logistic = LogisticRegression(maxIter=c.LOGISTIC_ITERATIONS)
    forest = RandomForestClassifier(impurity="entropy", numTrees=c.FOREST_TREES, seed=seed)
    perceptron = MultilayerPerceptronClassifier(
        layers=list(c.PERCEPTRON_LAYERS), blockSize=c.PERCEPTRON_BLOCK, maxIter=c.PERCEPTRON_ITERATIONS, seed=seed
    )

    def grid(model, **values):
        built = ParamGridBuilder().baseOn({chain.stages: [assembler(), model]})
        for name, options in values.items():
            built = built.addGrid(model.getParam(name), list(options))
        return built.build()

    return grid(logistic, regParam=c.LOGISTIC_PENALTIES) + grid(forest) + grid(perceptron)


def search(data: DataFrame, validated: bool, seed: int = 42, parallelism: int = 2) -> tuple[PipelineModel, float | None]:
    """The best model, refitted on all rows, and its area on the rows held back (`_held`).

    Without a validation the first parameters are taken.
    """
    chain = Pipeline(stages=[])
    maps = _param_maps(chain, seed)
    if not validated:
        return chain.fit(data, maps[0]), None
    evaluator = BinaryClassificationEvaluator()
    known, held = data.where(~F.col("_held")), data.where("_held")
    with ThreadPool(parallelism) as pool:
        areas = pool.map(lambda m: evaluator.evaluate(chain.fit(known, m).transform(held)), maps, chunksize=1)
    best = max(range(len(maps)), key=lambda i: areas[i])
    return chain.fit(data, maps[best]), float(areas[best])


def train_classifiers(
    long_rows: DataFrame,
    root: str,
    tickers: Sequence[str] = (),
    seed: int = 42,
    parallelism: int = 2,
    at_once: int = 4,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Fit every branch that has both label values, store the best model under ``root``, return the registry rows.

    Branches without a model, or without a validation, are registered with the reason.
    ``long_rows`` should be a stored table, best partitioned by action, strategy and
    period, so that a search reads only its own rows. Rows with a missing label or input do
    not train. A search runs on as many partitions as its rows fill, whatever files they lie in.
    """

    def fit(branch: Row):
        one = Search(branch["action"], branch["strategy"], branch["session_period"], branch["label"], branch["ticker"])
        kept = [branch[name] for name in ("yes", "no", "held_yes", "held_no", "reason")]
        if branch["reason"] in ("no rows", "one label value"):
            return (one.ticker, one.action, one.strategy, one.session_period, one.label, None, None, None, *kept)
        data = long_rows.where(one.rows() & (F.col("label") == one.label) & F.col("value").isNotNull() & inputs_known()).select(
            F.col("value").cast("int").alias("label"), *INPUTS, held_back().alias("_held")
        )
        data = data.coalesce(-(-(branch["yes"] + branch["no"]) // rows_per_task))
        model, area = search(data, branch["reason"] is None, seed, parallelism)
        name = "-".join(map(str, (one.action, one.strategy, one.session_period, one.label)))
        path = f"{root}/{name}" if one.ticker == POOLED else f"{root}/{name}-{one.ticker}"
        model.write().overwrite().save(path)
        winner = type(model.stages[-1]).__name__
        return (one.ticker, one.action, one.strategy, one.session_period, one.label, path, winner, area, *kept)

    # The grid is fixed, times the named tickers.
    with ThreadPool(at_once) as pool:
        rows = pool.map(fit, branches(long_rows, tickers).collect(), chunksize=1)
    schema = (
        "ticker string, action string, strategy string, session_period int, label string, path string, winner string, "
        "area_under_roc double, yes long, no long, held_yes long, held_no long, reason string"
    )
    return long_rows.sparkSession.createDataFrame(rows, schema).withColumn("date", F.current_timestamp().cast("timestamp_ntz"))


def registry_columns() -> list[str]:
    return [part.split()[0] for part in MODEL_REGISTRY.split(", ")]


def score(rows: DataFrame, registry: DataFrame, model_bytes: int = models.MODEL_BYTES) -> DataFrame:
    """Predictions of both labels of every row's strategy and action, all labels as columns.

    A row takes its ticker's own model where the registry has one, else the pooled one, of the newest
    date each; without either, and for a missing input, the prediction is null. The registry is the fixed grid
    times the named tickers; rows meet model numbers in a join and are scored in one pass.
    """
    keys = ["action", "strategy", "session_period", "label"]
    newest = registry.where(F.col("path").isNotNull()).groupBy("ticker", *keys).agg(F.max_by("path", "date").alias("path"))
    stored = newest.orderBy("ticker", *keys).collect()
    spark = rows.sparkSession
    numbered = [(e["ticker"], e["action"], e["strategy"], e["session_period"], e["label"], i) for i, e in enumerate(stored)]
    known = spark.createDataFrame(numbered, "_ticker string, action string, strategy string, session_period int, label string, _number int")
    branch = ["action", "strategy", "session_period"]

    def of(tickers: Column, prefix: str) -> DataFrame:
        number = [F.max(F.when(F.col("label") == name, F.col("_number"))).alias(f"{prefix}{name}") for name in c.LABELS]
        return known.where(tickers).groupBy("_ticker", *branch).agg(*number)

    own, pooled = of(F.col("_ticker") != POOLED, "_own_"), of(F.col("_ticker") == POOLED, "_pooled_").drop("_ticker")
    same = [rows[name] == own[name] for name in branch] + [rows["ticker"].cast("string") == own["_ticker"]]
    joined = rows.join(own, reduce(and_, same), "left").select(*[rows[name] for name in rows.columns], *[f"_own_{name}" for name in c.LABELS])
    joined = joined.join(pooled, branch, "left")
    chosen = [F.coalesce(f"_own_{name}", f"_pooled_{name}").alias(f"_model_{name}") for name in c.LABELS]
    keyed = joined.select(*rows.columns, *chosen)
    loaded = {i: models.load(spark, e["path"]) for i, e in enumerate(stored)}
    return models.predict(keyed, loaded, INPUTS, c.LABELS, model_bytes)


def drop_excepted(scored: DataFrame, conflict_dates: DataFrame) -> DataFrame:
    """Null predictions of rows outside the keep-lists, or in a conflict of that label.

    Needs ``allowed`` from the scoring scan.
    """
    flags = conflict_dates.groupBy(*ll.GROUP, "date").agg(
        *[F.max(F.col("label") == name).alias(f"_{name}") for name in c.LABELS]
    )
    joined = scored.join(flags, [*ll.GROUP, "date"], "left")

    def kept(name: str) -> Column:
        excepted = ~F.col("allowed") | F.coalesce(F.col(f"_{name}"), F.lit(False))
        return F.when(~excepted, F.col(name))

    return joined.withColumns({name: kept(name) for name in c.LABELS}).drop(*[f"_{name}" for name in c.LABELS])


def predict_labels(scored: DataFrame) -> DataFrame:
    """Filled predictions: first bar of a day false, nulls from the bar before.

    Only the labels of the action are filled; the other delta stays null.
    """
    shaped = scored.select(*ll.ROW, *c.LABELS)
    filled = ll.fill_predictions(shaped, list(c.LABELS))
    unused = F.when(F.col("action") == "buy", F.lit("low_delta")).otherwise(F.lit("high_delta"))
    return filled.withColumns({name: F.when(unused != name, F.col(name)) for name in ("low_delta", "high_delta")})
