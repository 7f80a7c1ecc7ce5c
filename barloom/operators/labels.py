"""Labels, benchmark bands, outlier and conflict pruning.

Everything is one plan over all tickers, keyed by ``GROUP``. Value groups may be hot, so
they are counted with partial aggregates and joined back with ``spread_join``; no value
group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom import constants as c
from barloom.operators.series import day_of, spread_join
from barloom.sources.stage import stage

GROUP = ["ticker", "action", "strategy", "session_period"]
ROW = ["ticker", "action", "date"]

# The two labels that matter per strategy and action.
LABEL_MATRIX = (
    ("trend", "buy", "high_delta", "high_stop"),
    ("trend", "sell", "low_delta", "low_stop"),
    ("correction", "buy", "high_delta", "low_stop"),
    ("correction", "sell", "low_delta", "high_stop"),
)


def label_data(rows: DataFrame) -> DataFrame:
    """Label columns from the look-ahead extremes; needs limit_price and min_trail_percent.

    The parameters are those of the row's own strategy. A label that an action does not
    use is null.
    """
    up = F.try_divide("day_max", "close")
    down = F.try_divide("close", "day_min")
    buy = F.col("action") == "buy"
    limit, stop = F.col("limit_price"), F.col("min_trail_percent")

    def true_or_false(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    return rows.withColumns(
        {
            "high_delta": F.when(buy, true_or_false(up > limit)),
            "high_stop": true_or_false(F.when(buy, up < c.STOP_RATIO).otherwise(up < stop)),
            "low_delta": F.when(~buy, true_or_false(down > 1 - limit + 1)),
            "low_stop": true_or_false(F.when(buy, down < 1 - stop + 1).otherwise(down < c.STOP_RATIO)),
        }
    )


def chosen(spy: str, own: str) -> Column:
    return F.when(F.col("spy"), F.col(spy)).otherwise(F.col(own))


def with_difference(rows: DataFrame) -> DataFrame:
    """The difference column the parameters choose, under one name."""
    return rows.withColumn("difference", chosen("spy_difference", "benchmark_difference"))


def with_benchmark_delta(rows: DataFrame) -> DataFrame:
    return rows.withColumn("benchmark_delta", chosen("spy_open_delta", "benchmark_open_delta"))


def benchmark_band_filter(rows: DataFrame) -> DataFrame:
    """Trend rows inside the benchmark band, correction rows outside; no band keeps all."""
    low, high = F.col("benchmark_negative"), F.col("benchmark_positive")
    buy = F.col("action") == "buy"
    inside = F.col("difference").between(F.when(buy, low).otherwise(high), F.when(buy, high).otherwise(low))
    wanted = F.when(F.col("strategy") == "trend", inside).otherwise(~inside)
    return with_difference(rows).where(low.isNull() | high.isNull() | wanted)


def benchmark_keep_dates(rows: DataFrame) -> DataFrame:
    return benchmark_band_filter(rows).select(*GROUP, "date")


def period_strategy_grid(tickers: DataFrame, periods: int = c.SESSION_PERIODS) -> DataFrame:
    """One skeleton row per period and strategy of each ticker."""
    spans = F.explode(F.sequence(F.lit(1), F.lit(periods)))
    sides = F.explode(F.array(*[F.lit(side) for side in c.STRATEGIES]))
    return tickers.withColumn("session_period", spans).withColumn("strategy", sides)


# --- outliers: values seen only once ------------------------------------------------


VALUES = ["volume_delta", "open_delta", "benchmark_delta"]


def _repeated(counts: DataFrame, value: str) -> DataFrame:
    seen = counts.groupBy(*GROUP, value).agg(F.sum("n").alias("n"))
    return seen.where((F.col("n") >= 2) & F.col(value).isNotNull())


def frequency_steps(rows: DataFrame) -> list[DataFrame]:
    """Value combinations with counts: all, then after each of the three steps.

    The steps depend on the values alone, so they run on the counted combinations, a stored
    table, and the rows are read only to count and to filter.
    """
    steps = [stage(rows.groupBy(*GROUP, *VALUES).agg(F.count(F.lit(1)).alias("n")), "combinations")]
    for value in VALUES:
        others = [name for name in VALUES if name != value]
        seen = _repeated(steps[-1], value).drop("n")
        steps.append(spread_join(steps[-1], seen, [*GROUP, value], others, "left_semi", measured=steps[0]))
    return steps


def value_frequency_prune(rows: DataFrame, steps: list[DataFrame] | None = None) -> DataFrame:
    """Keep rows whose volume delta repeats, of those whose open delta repeats, then the
    benchmark delta."""
    kept = (steps or frequency_steps(rows))[-1].select(*GROUP, *VALUES)
    return spread_join(rows, kept, [*GROUP, *VALUES], ["date"], "left_semi", measured=rows)


def possible_values(rows: DataFrame, steps: list[DataFrame] | None = None) -> DataFrame:
    """The values that pass each step, one row per value."""
    steps = steps or frequency_steps(rows)
    first, *rest = [
        _repeated(counts, value).select(*GROUP, F.lit(value).alias("kind"), F.col(value).alias("value"), "n")
        for counts, value in zip(steps, VALUES)
    ]
    for part in rest:
        first = first.unionByName(part)
    return first


def possible_dates(rows: DataFrame) -> DataFrame:
    return value_frequency_prune(rows).select(*GROUP, "date")


def keep_possibles(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows whose date is in the keep-list of their group."""
    return rows.join(dates.select(*GROUP, "date"), [*GROUP, "date"], "left_semi")


# --- exceptions: equal inputs with different labels ---------------------------------

PAIR = ["open_delta", "benchmark_delta"]


def pair_counts(rows: DataFrame) -> DataFrame:
    """Rows per pair of open delta and benchmark delta, subtotals left out."""
    known = rows.where(F.col("open_delta").isNotNull() & F.col("benchmark_delta").isNotNull())
    return known.groupBy(*GROUP, *PAIR).agg(F.count(F.lit(1)).alias("n"))


def long_labels(rows: DataFrame) -> DataFrame:
    """One row per label that the row's strategy and action use: ``label``, ``value``."""
    pairs = F.lit(None)
    for strategy, action, first, second in LABEL_MATRIX:
        here = (F.col("strategy") == strategy) & (F.col("action") == action)
        both = F.array(
            *[F.struct(F.lit(name).alias("label"), F.col(name).alias("value")) for name in (first, second)]
        )
        pairs = F.when(here, both).otherwise(pairs)
    return rows.withColumn("_label", F.explode(pairs)).select("*", "_label.*").drop("_label", *c.LABELS)


def label_conflicts(long_rows: DataFrame) -> DataFrame:
    """Pairs seen more than once that carry both label values.

    Minimum and maximum of the label replace a distinct count, so the aggregate combines
    before the shuffle.
    """
    known = long_rows.where(F.col("open_delta").isNotNull() & F.col("benchmark_delta").isNotNull())
    grouped = known.groupBy(*GROUP, "label", *PAIR).agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("_low"), F.max("value").alias("_high")
    )
    return grouped.where((F.col("n") > 1) & (F.col("_low") != F.col("_high"))).drop("_low", "_high")


def conflict_dates(long_rows: DataFrame) -> DataFrame:
    """Dates of the rows in conflicting pairs, per label."""
    pairs = label_conflicts(long_rows).drop("n")
    hit = spread_join(long_rows, pairs, [*GROUP, "label", *PAIR], ["date"], "left_semi", measured=long_rows)
    return hit.select(*GROUP, "label", "date")


def conflict_pairs(long_rows: DataFrame) -> DataFrame:
    """Conflicting pairs, each as JSON text."""
    return label_conflicts(long_rows).select(*GROUP, "label", F.to_json(F.array(*PAIR)).alias("pair"))


def drop_conflicts(long_rows: DataFrame) -> DataFrame:
    """Rows that are in no conflicting pair of their label."""
    pairs = label_conflicts(long_rows).drop("n")
    return spread_join(long_rows, pairs, [*GROUP, "label", *PAIR], ["date"], "left_anti", measured=long_rows)


# --- predictions --------------------------------------------------------------------


def update_labels(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Set the label columns of the stored rows from the rows with the same key."""
    fresh = new.select(*ROW, *[F.col(name).alias(f"_{name}") for name in c.LABELS])
    merged = stored.join(fresh, ROW, "left")
    return merged.withColumns({name: F.coalesce(f"_{name}", name) for name in c.LABELS}).select(*stored.columns)


def first_bar_false(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = ("ticker", "action")) -> DataFrame:
    """Predictions at the first bar of a day are false."""
    day = Window.partitionBy(*key, "_day").orderBy("date")
    first = F.row_number().over(day) == 1
    tagged = rows.withColumn("_day", day_of()).withColumn("_first", first)
    return tagged.withColumns({name: ~F.col("_first") & F.col(name) for name in columns}).select(*rows.columns)


def fill_predictions(rows: DataFrame, columns: Sequence[str], key: Sequence[str] = ("ticker", "action")) -> DataFrame:
    """First bar of a day false, then nulls take the last earlier prediction.

    The first bar always has a value, so no fill crosses a day and each (key, day) group
    is bounded by the bars of a day.
    """
    so_far = Window.partitionBy(*key, "_day").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    started = first_bar_false(rows, columns, key).withColumn("_day", day_of())
    return started.withColumns({name: F.last(name, ignorenulls=True).over(so_far) for name in columns}).drop("_day")


def merge_predictions(first: DataFrame, second: DataFrame) -> DataFrame:
    """Two label predictions of the same rows side by side."""
    return first.join(second, ROW)


def union_predictions(long_rows: DataFrame) -> DataFrame:
    """Long predictions of all periods and strategies to one row per bar, absent labels null."""

    def of(label: str) -> Column:
        return F.max(F.when(F.col("label") == label, F.col("value"))).alias(label)

    return long_rows.groupBy(*ROW).agg(*[of(label) for label in c.LABELS])
