"""Labelling and pruning of training rows, one plan over all tickers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from barloom.operators import labels as ll
from barloom.operators import params as pp
from barloom.sources.stage import stage


@dataclass(frozen=True)
class Pruned:
    """Long-format keep and drop lists, and the rows left for training."""

    labelled: DataFrame
    keep_dates: DataFrame
    values: DataFrame
    possible_dates: DataFrame
    conflict_pairs: DataFrame
    conflict_dates: DataFrame
    training: DataFrame


def prune_training_rows(features: DataFrame, params: DataFrame) -> Pruned:
    wanted = ["benchmark_negative", "benchmark_positive", "limit_price", "min_trail_percent", "spy"]
    keyed = pp.attach_params(features, params.select(*pp.KEY, *wanted))
    return prune_labelled(ll.with_benchmark_delta(ll.with_difference(ll.label_data(keyed))))


def prune_labelled(labelled: DataFrame) -> Pruned:
    """Pruning of labelled rows, best a stored table: it is read more than once.

    Value combinations are counted once for all steps, and the rows left by them are stored for the conflicts.
    """
    banded = ll.benchmark_band_filter(labelled)
    steps = ll.frequency_steps(banded)
    possible = stage(ll.value_frequency_prune(banded, steps), "possible")
    long_rows = ll.long_labels(possible)
    return Pruned(
        labelled=labelled,
        keep_dates=banded.select(*ll.GROUP, "date"),
        values=ll.possible_values(banded, steps),
        possible_dates=possible.select(*ll.GROUP, "date"),
        conflict_pairs=ll.conflict_pairs(long_rows),
        conflict_dates=ll.conflict_dates(long_rows),
        training=ll.drop_conflicts(long_rows),
    )
