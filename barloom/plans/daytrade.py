"""The full offline job: prepare, prune, train, predict, with tables between the steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators import labels as ll
from barloom.operators import learning as ml
from barloom.plans import prune
from barloom.session import fresh_path
from barloom.sources.stage import stage
from barloom.sources.tables import scan_score

BRANCH = ["action", "strategy", "session_period"]


@dataclass(frozen=True)
class Trained:
    rows: DataFrame
    training: DataFrame
    registry: DataFrame
    conflict_dates: DataFrame


def train(labelled: DataFrame, root: str | None = None) -> Trained:
    """Prune stored labelled rows, store training and scoring rows by branch, train.

    The scoring rows carry the mark of both keep-lists.
    """
    spark = labelled.sparkSession
    pruned = prune.prune_labelled(labelled)
    training = stage(pruned.training, "training", BRANCH)
    inputs = labelled.select(*ll.GROUP, "date", *ml.INPUTS)
    rows = stage(scan_score(inputs, pruned.keep_dates, pruned.possible_dates), "scoring", BRANCH)
    registry = stage(ml.train_classifiers(training, root or fresh_path(spark, "models")), "registry")
    return Trained(rows, training, registry, stage(pruned.conflict_dates, "conflicts"))


def predict(trained: Trained) -> DataFrame:
    scored = ml.score(trained.rows, trained.registry)
    return ml.predict_labels(ml.drop_excepted(scored, trained.conflict_dates))


def run(labelled: DataFrame, trained: Trained | None = None) -> DataFrame:
    """Labelled rows with their labels replaced by predictions where there are any; of a former training, if given."""
    predictions = predict(trained or train(labelled))
    stored = labelled.select(*ll.ROW, "strategy", "session_period", *[F.col(n) for n in ("high_delta", "low_delta", "high_stop", "low_stop")])
    return ll.update_labels(stored, predictions)
