"""Labels, bands, pruning, conflicts and prediction merging."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.ctes import r6
from barloom.catalog.registry import query, six
from barloom.operators import labels as ll
from barloom.operators.series import carry_forward
from barloom.plans import prune

GROUP = "ticker, action, strategy, session_period"


def _banded(spark, d):
    return ll.benchmark_band_filter(b.coarse(spark, d))


def _long_rows(spark, d):
    return ll.long_labels(b.coarse(spark, d))


@query("x02_label_data_buy", "SELECT ticker, date, strategy, high_delta, high_stop, low_delta, low_stop FROM labelled WHERE action = 'buy'")
def x02(spark, d):
    rows = b.labelled(spark, d).where("action = 'buy'")
    return rows.select("ticker", "date", "strategy", "high_delta", "high_stop", "low_delta", "low_stop")


@query("x03_label_data_sell", "SELECT ticker, date, strategy, high_delta, high_stop, low_delta, low_stop FROM labelled WHERE action = 'sell'")
def x03(spark, d):
    rows = b.labelled(spark, d).where("action = 'sell'")
    return rows.select("ticker", "date", "strategy", "high_delta", "high_stop", "low_delta", "low_stop")


@query("p02_benchmark_band_filter", f"SELECT {GROUP}, date, {r6('difference')} AS difference FROM banded")
def p02(spark, d):
    return _banded(spark, d).select(*ll.GROUP, "date", six("difference").alias("difference"))


@query("p03_benchmark_keep_dates", f"SELECT {GROUP}, date FROM banded")
def p03(spark, d):
    return ll.benchmark_keep_dates(b.labelled(spark, d))


@query("p04_pivot_difference_name", f"SELECT ticker, action, strategy, date, spy, {r6('difference')} AS difference FROM labelled")
def p04(spark, d):
    rows = ll.with_difference(b.labelled(spark, d))
    return rows.select("ticker", "action", "strategy", "date", "spy", six("difference").alias("difference"))


@query("a06_value_frequency_prune", f"SELECT {GROUP}, date, volume_delta, open_delta, benchmark_delta FROM rep3")
def a06(spark, d):
    return ll.value_frequency_prune(_banded(spark, d)).select(*ll.GROUP, "date", "volume_delta", "open_delta", "benchmark_delta")


@query(
    "a07_possibles",
    f"""SELECT {GROUP}, 'volume_delta' AS kind, volume_delta AS value, CAST(count(*) AS BIGINT) AS n FROM banded GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT {GROUP}, 'open_delta', open_delta, CAST(count(*) AS BIGINT) FROM rep1 GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT {GROUP}, 'benchmark_delta', benchmark_delta, CAST(count(*) AS BIGINT) FROM rep2 GROUP BY ALL HAVING count(*) >= 2""",
)
def a07(spark, d):
    return ll.possible_values(_banded(spark, d))


@query("a07_possible_dates", f"SELECT {GROUP}, date FROM rep3")
def a07_dates(spark, d):
    return ll.possible_dates(_banded(spark, d))


@query(
    "a08_cube_pair_count",
    f"""SELECT * FROM (SELECT {GROUP}, open_delta, benchmark_delta, CAST(count(*) AS BIGINT) AS n FROM coarse
    GROUP BY {GROUP}, CUBE (open_delta, benchmark_delta)) WHERE open_delta IS NOT NULL AND benchmark_delta IS NOT NULL""",
)
def a08(spark, d):
    return ll.pair_counts(b.coarse(spark, d))


@query("a09_label_conflicts", f"SELECT {GROUP}, label, open_delta, benchmark_delta, n FROM conflicts")
def a09(spark, d):
    return ll.label_conflicts(_long_rows(spark, d))


CONFLICT_DATES = """SELECT r.ticker, r.action, r.strategy, r.session_period, r.label, r.date FROM longrows r JOIN conflicts x ON x.ticker = r.ticker AND x.action = r.action
  AND x.strategy = r.strategy AND x.session_period = r.session_period AND x.label = r.label AND x.open_delta = r.open_delta AND x.benchmark_delta = r.benchmark_delta"""


@query("a10_conflict_dates", CONFLICT_DATES)
def a10(spark, d):
    return ll.conflict_dates(_long_rows(spark, d))


@query("a10_conflict_pairs", f"SELECT {GROUP}, label, '[' || open_delta || ',' || benchmark_delta || ']' AS pair FROM conflicts")
def a10_pairs(spark, d):
    return ll.conflict_pairs(_long_rows(spark, d))


@query("j07_exceptions_left_join", f"SELECT r.ticker, r.action, r.strategy, r.session_period, r.label, r.date, r.value FROM longrows r WHERE (r.ticker, r.action, r.strategy, r.session_period, r.label, r.date) NOT IN (SELECT (ticker, action, strategy, session_period, label, date) FROM ({CONFLICT_DATES}))")
def j07(spark, d):
    rows = _long_rows(spark, d)
    return ll.drop_conflicts(rows).select(*ll.GROUP, "label", "date", "value")


@query("j06_keep_possibles", f"SELECT {GROUP}, date, close FROM coarse WHERE ({GROUP}, date) IN (SELECT ({GROUP}, date) FROM rep3)")
def j06(spark, d):
    rows = b.coarse(spark, d)
    return ll.keep_possibles(rows, ll.possible_dates(ll.benchmark_band_filter(rows))).select(*ll.GROUP, "date", "close")


@query(
    "j27_period_strategy_grid",
    "SELECT ticker, CAST(p.range AS INTEGER) AS session_period, s.strategy FROM (SELECT DISTINCT event_type AS ticker FROM events) t, range(1, 7) p, (VALUES ('trend'), ('correction')) s(strategy)",
)
def j27(spark, d):
    return ll.period_strategy_grid(b.members(spark, d).select("ticker"))


A25 = f"""WITH prunedlong AS (SELECT r.ticker, r.action, r.strategy, r.session_period, r.date, r.label, r.volume_delta, r.open_delta, r.benchmark_delta, r.value
    FROM longrows r JOIN rep3 k ON k.ticker = r.ticker AND k.action = r.action AND k.strategy = r.strategy AND k.date = r.date),
  bad AS (SELECT {GROUP}, label, open_delta, benchmark_delta FROM prunedlong GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT value) > 1)
  SELECT {GROUP}, date, label, volume_delta, open_delta, benchmark_delta, value FROM prunedlong
  WHERE ({GROUP}, label, open_delta, benchmark_delta) NOT IN (SELECT ({GROUP}, label, open_delta, benchmark_delta) FROM bad)"""


@query("a25_prune_training_rows", A25)
def a25(spark, d):
    rows = prune.prune_labelled(b.coarse(spark, d)).training
    return rows.select(*ll.GROUP, "date", "label", "volume_delta", "open_delta", "benchmark_delta", "value")


@query("m03_label_matrix", "SELECT strategy, action, label, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE value) AS BIGINT) AS positive FROM longrows GROUP BY 1, 2, 3")
def m03(spark, d):
    rows = _long_rows(spark, d)
    return rows.groupBy("strategy", "action", "label").agg(F.count(F.lit(1)).alias("n"), F.count_if("value").alias("positive"))


@query("m04_boolean_label", "SELECT ticker, action, date, label, CAST(value AS INTEGER) AS y, CAST(value AS INTEGER) > 0 AS back FROM longrows")
def m04(spark, d):
    rows = ll.long_labels(b.labelled(spark, d))
    return rows.select("ticker", "action", "date", "label", F.col("value").cast("int").alias("y"), (F.col("value").cast("int") > 0).alias("back"))


UPDATED = """SELECT l.ticker, l.action, l.date, coalesce(n.high_delta, l.high_delta) AS high_delta, coalesce(n.high_stop, l.high_stop) AS high_stop,
  coalesce(n.low_delta, l.low_delta) AS low_delta, coalesce(n.low_stop, l.low_stop) AS low_stop FROM labelled l
  LEFT JOIN (SELECT ticker, action, date, NOT high_delta AS high_delta, NOT high_stop AS high_stop, NOT low_delta AS low_delta, NOT low_stop AS low_stop
    FROM labelled WHERE session_period > 3) n ON n.ticker = l.ticker AND n.action = l.action AND n.date = l.date"""


@query("s09_update_labels", UPDATED)
def s09(spark, d):
    rows = b.labelled(spark, d).select(*ll.ROW, "session_period", "high_delta", "high_stop", "low_delta", "low_stop")
    flipped = rows.where("session_period > 3").withColumns({n: ~F.col(n) for n in ("high_delta", "high_stop", "low_delta", "low_stop")})
    return ll.update_labels(rows, flipped).drop("session_period")


CHAIN = """WITH thin AS (SELECT ticker, action, date, row_number() OVER (PARTITION BY ticker, action, day ORDER BY date) AS rk, CASE WHEN volume % 3 <> 0 THEN high_stop END AS guess FROM labelled),
  firsts AS (SELECT *, CASE WHEN rk = 1 THEN false ELSE guess END AS started FROM thin)"""


def _thin(spark, d):
    kept = F.when(F.col("volume") % 3 != 0, F.col("high_stop"))
    return b.labelled(spark, d).select("ticker", "action", "date", kept.alias("guess"))


@query("w15_first_bar_false", f"{CHAIN} SELECT ticker, action, date, started AS guess FROM firsts")
def w15(spark, d):
    return ll.first_bar_false(_thin(spark, d), ["guess"])


@query(
    "w16_forward_fill_predictions",
    f"{CHAIN} SELECT ticker, action, date, last_value(started IGNORE NULLS) OVER (PARTITION BY ticker, action ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS guess FROM firsts",
)
def w16(spark, d):
    return ll.fill_predictions(_thin(spark, d), ["guess"])


@query("w16_fill_without_reset", f"{CHAIN} SELECT ticker, action, date, last_value(guess IGNORE NULLS) OVER (PARTITION BY ticker, action ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS guess FROM thin")
def w16_plain(spark, d):
    return carry_forward(_thin(spark, d), ["guess"], key=("ticker", "action"))


@query("j08_merge_predictions", "SELECT ticker, action, date, high_delta, high_stop FROM labelled")
def j08(spark, d):
    rows = b.labelled(spark, d)
    return ll.merge_predictions(rows.select(*ll.ROW, "high_delta"), rows.select(*ll.ROW, "high_stop"))


@query(
    "u01_union_predictions",
    """SELECT ticker, action, date, CASE WHEN high_delta IS NOT NULL THEN high_delta END AS high_delta, low_delta,
    CASE WHEN (strategy = 'trend') = (action = 'buy') THEN high_stop END AS high_stop, CASE WHEN (strategy = 'trend') <> (action = 'buy') THEN low_stop END AS low_stop FROM labelled""",
)
def u01(spark, d):
    return ll.union_predictions(ll.long_labels(b.labelled(spark, d)))
