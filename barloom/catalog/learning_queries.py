"""Feature vectors, training, scoring and prediction."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.labels_queries import A25
from barloom.catalog.registry import query
from barloom.operators import labels as ll
from barloom.operators import learning as ml
from barloom.plans import daytrade, prune

_TRAINED: dict[tuple[str, str], daytrade.Trained] = {}


def _trained(spark, d):
    """Tables and models of one training run, shared by the queries of a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _TRAINED:
        _TRAINED[key] = daytrade.train(b.coarse(spark, d))
    return _TRAINED[key]


@query("m01_assemble_features", "SELECT ticker, action, date, volume_delta AS f0, open_delta AS f1, benchmark_delta AS f2 FROM coarse")
def m01(spark, d):
    rows = ml.feature_arrays(b.coarse(spark, d))
    return rows.select(*ll.ROW, *[F.col("features")[i].alias(f"f{i}") for i in range(3)])


@query("m02_train_classifiers")
def m02(spark, d):
    return _trained(spark, d).registry.select("ticker", "action", "strategy", "session_period", "label", "winner", "area_under_roc", "yes", "no", "reason")


TRAINING = f"""(SELECT r.*, md5(r.ticker || '|' || CAST(r.date AS VARCHAR))[1] IN ('0', '4', '8', 'c') AS held FROM ({A25}) r
    WHERE value IS NOT NULL AND volume_delta IS NOT NULL AND open_delta IS NOT NULL AND benchmark_delta IS NOT NULL)"""


@query(
    "m02_branches",
    f"""SELECT *, CASE WHEN yes + no = 0 THEN 'no rows' WHEN least(yes, no) = 0 THEN 'one label value'
      WHEN least(held_yes, held_no, yes - held_yes, no - held_no) = 0 THEN 'no split' END AS reason FROM (
    SELECT g.action, g.strategy, g.session_period, g.label, CAST(count(*) FILTER (WHERE value) AS BIGINT) AS yes, CAST(count(*) FILTER (WHERE NOT value) AS BIGINT) AS no,
      CAST(count(*) FILTER (WHERE value AND held) AS BIGINT) AS held_yes, CAST(count(*) FILTER (WHERE NOT value AND held) AS BIGINT) AS held_no
    FROM (SELECT s.action, s.strategy, s.label, CAST(p.range AS INTEGER) AS session_period FROM (VALUES ('buy', 'trend', 'high_delta'), ('buy', 'trend', 'high_stop'),
      ('sell', 'trend', 'low_delta'), ('sell', 'trend', 'low_stop'), ('buy', 'correction', 'high_delta'), ('buy', 'correction', 'low_stop'),
      ('sell', 'correction', 'low_delta'), ('sell', 'correction', 'high_stop')) s(action, strategy, label), range(1, 7) p) g
    LEFT JOIN {TRAINING} t ON t.action = g.action AND t.strategy = g.strategy AND t.session_period = g.session_period AND t.label = g.label GROUP BY 1, 2, 3, 4)""",
)
def m02_branches(spark, d):
    """Every branch of the grid: its rows by label value and part, and why it has no model or no validation."""
    found = ml.branches(prune.prune_labelled(b.coarse(spark, d)).training)
    return found.select("action", "strategy", "session_period", "label", "yes", "no", "held_yes", "held_no", "reason")


@query("m05_score")
def m05(spark, d):
    trained = _trained(spark, d)
    return ml.drop_excepted(ml.score(trained.rows, trained.registry), trained.conflict_dates)


@query("m06_predict_labels")
def m06(spark, d):
    return daytrade.predict(_trained(spark, d))


@query("m07_model_registry")
def m07(spark, d):
    return _trained(spark, d).registry.select(*ml.registry_columns())


@query("m08_full_job")
def m08(spark, d):
    return daytrade.run(b.coarse(spark, d), _trained(spark, d))


@query("m05_allowed_rows", "SELECT ticker, action, strategy, session_period, date, (ticker, action, strategy, date) IN (SELECT (ticker, action, strategy, date) FROM rep3) AS allowed FROM coarse")
def m05_allowed(spark, d):
    return _trained(spark, d).rows.select(*ll.GROUP, "date", "allowed")
