"""Scans, sinks and documents; sinks are written and read back."""

from pyspark.sql import functions as F

from barloom import bindings as b
from barloom.catalog.registry import query
from barloom.operators import labels as ll
from barloom.operators import universe as uu
from barloom.plans import ingest, prune
from barloom.session import fresh_path
from barloom.sources import documents as docs
from barloom.sources import sinks, tables
from barloom.sources.stage import stage

BAR = "ticker, date, open, high, low, close, volume, count"
GROUP = "ticker, action, strategy, session_period"


@query("s01_scan_bars", "SELECT ticker, date, open, high, low, close, volume FROM bars WHERE ticker IN ('view', 'signup')")
def s01(spark, d):
    return tables.scan_bars(b.bars(spark, d), ["view", "signup"])


PREPARED = "SELECT ticker, date, close, session_period, open_delta, volume_delta FROM prepared"


def _prepared(spark, d):
    features = b.prepared(spark, d).select("ticker", "date", "session_period", "open_delta", "volume_delta")
    return tables.scan_prepared(b.bars(spark, d), features)


@query("s03_scan_prepared", PREPARED)
def s03(spark, d):
    return _prepared(spark, d)


@query("j04_bars_features_join", PREPARED)
def j04(spark, d):
    return _prepared(spark, d)


@query("s04_scan_train", f"SELECT {GROUP}, date, high_delta, low_stop FROM rep3")
def s04(spark, d):
    rows = b.coarse(spark, d)
    pruned = prune.prune_labelled(rows)
    kept = tables.scan_train(rows, pruned.keep_dates, pruned.possible_dates)
    return kept.select(*ll.GROUP, "date", "high_delta", "low_stop")


@query("j05_date_in_unnest", f"SELECT {GROUP}, date FROM coarse WHERE ({GROUP}, date) IN (SELECT ({GROUP}, date) FROM banded)")
def j05(spark, d):
    rows = b.coarse(spark, d)
    return ll.keep_possibles(rows, ll.benchmark_keep_dates(rows)).select(*ll.GROUP, "date")


@query("s05_scan_score", f"SELECT {GROUP}, date, ({GROUP}, date) IN (SELECT ({GROUP}, date) FROM rep3) AS allowed FROM coarse")
def s05(spark, d):
    rows = b.coarse(spark, d)
    pruned = prune.prune_labelled(rows)
    marked = tables.scan_score(rows, pruned.keep_dates, pruned.possible_dates)
    return marked.select(*ll.GROUP, "date", "allowed")


POSSIBLES = f"""SELECT {GROUP}, 'volume_delta' AS kind, volume_delta AS value, CAST(count(*) AS BIGINT) AS n FROM banded GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT {GROUP}, 'open_delta', open_delta, CAST(count(*) AS BIGINT) FROM rep1 GROUP BY ALL HAVING count(*) >= 2
    UNION ALL SELECT {GROUP}, 'benchmark_delta', benchmark_delta, CAST(count(*) AS BIGINT) FROM rep2 GROUP BY ALL HAVING count(*) >= 2"""


@query("s06_scan_pre_process_params", POSSIBLES)
def s06(spark, d):
    values = stage(ll.possible_values(ll.benchmark_band_filter(b.coarse(spark, d))), "values", ["ticker"])
    return tables.by_ticker(values).select(*ll.GROUP, "kind", "value", "n")


@query("s07_scan_models")
def s07(spark, d):
    from barloom.catalog.learning_queries import _trained

    return tables.by_ticker(_trained(spark, d).registry, ["*"])


@query("x21_keep_list_pruning", f"""SELECT r.ticker, r.action, r.strategy, r.session_period, r.label, r.date FROM longrows r WHERE (r.ticker, r.action, r.strategy, r.session_period, r.date) IN (SELECT ({GROUP}, date) FROM rep3)
    AND NOT EXISTS (SELECT 1 FROM conflicts x WHERE x.ticker = r.ticker AND x.action = r.action AND x.strategy = r.strategy AND x.session_period = r.session_period AND x.label = r.label AND x.open_delta = r.open_delta AND x.benchmark_delta = r.benchmark_delta)""")
def x21(spark, d):
    rows = b.coarse(spark, d)
    long_rows = ll.long_labels(rows)
    kept = ll.keep_possibles(long_rows, ll.possible_dates(ll.benchmark_band_filter(rows)))
    excepted = ll.conflict_dates(long_rows)
    return kept.join(excepted, [*ll.GROUP, "label", "date"], "left_anti").select(*ll.GROUP, "label", "date")


# --- sinks --------------------------------------------------------------------------


@query("s08_replace_by_key", f"SELECT ticker, date, open, high, low, close, CASE WHEN ticker IN ('view', 'click') THEN volume + 1 ELSE volume END AS volume, count FROM bars WHERE ticker NOT IN ('view', 'click') OR volume > 2")
def s08(spark, d):
    path = fresh_path(spark, "bars")
    bars = b.bars(spark, d)
    sinks.replace_by_key(bars, path)
    again = bars.where("ticker IN ('view', 'click') AND volume > 2").withColumn("volume", F.col("volume") + 1)
    sinks.replace_by_key(again, path)
    return spark.read.schema(bars.schema).parquet(path)


@query("s10_upsert_bars", f"""SELECT coalesce(n.ticker, o.ticker) AS ticker, coalesce(n.date, o.date) AS date, coalesce(n.close, o.close) AS close, coalesce(n.volume, o.volume) AS volume, CASE WHEN n.ticker IS NULL THEN true ELSE false END AS has_gaps
    FROM (SELECT * FROM bars WHERE date < TIMESTAMP '2024-01-20') o FULL JOIN (SELECT ticker, date, close * 2 AS close, volume FROM bars WHERE date >= TIMESTAMP '2024-01-10') n ON n.ticker = o.ticker AND n.date = o.date""")
def s10(spark, d):
    bars = b.bars(spark, d)
    existing = bars.where(F.col("date") < b.moment("2024-01-20 00:00:00")).withColumn("has_gaps", F.lit(True))
    fresh = bars.where(F.col("date") >= b.moment("2024-01-10 00:00:00")).withColumn("close", F.col("close") * 2)
    raw = ingest.as_raw(fresh, "5 mins")
    undated = raw.withColumn("date", F.lit(None).cast("string"))
    typed = sinks.typed_bars(raw.unionByName(undated), "5 mins")
    return sinks.upsert_bars(existing, typed).select("ticker", "date", "close", "volume", "has_gaps")


@query("s11_copy_snapshot", f"SELECT {BAR} FROM daily WHERE date > TIMESTAMP '1999-11-10 00:00:00'")
def s11(spark, d):
    from barloom.operators.bars import retain_years

    path = fresh_path(spark, "staging")
    daily = b.daily(spark, d)
    sinks.copy_snapshot(daily.where("count > 3"), path)
    sinks.copy_snapshot(retain_years(daily, b.moment(b.DAILY_NOW)), path)
    return spark.read.schema(daily.schema).parquet(path)


@query("s12_truncate_tables", "SELECT 'before' AS state, CAST(count(*) AS BIGINT) AS n FROM bars UNION ALL SELECT 'after', CAST(0 AS BIGINT)")
def s12(spark, d):
    path = fresh_path(spark, "working")
    bars = b.bars(spark, d)
    sinks.copy_snapshot(bars, path)
    before = stage(spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")), "before")
    sinks.truncate_table(spark, path, bars.schema)
    after = spark.read.schema(bars.schema).parquet(path).agg(F.count(F.lit(1)).alias("n"))
    return before.select(F.lit("before").alias("state"), "n").unionByName(after.select(F.lit("after").alias("state"), "n"))


@query("s17_write_prepared", "SELECT ticker, date, session_period, day_max, day_min, open_delta, prev_day_close, volume_delta, count FROM prepared")
def s17(spark, d):
    path = fresh_path(spark, "prepared")
    sinks.write_prepared(b.prepared(spark, d), path)
    return spark.read.parquet(path)


@query("s17_write_pre_process", f"SELECT {GROUP}, date FROM rep3")
def s17_pre(spark, d):
    path = fresh_path(spark, "pre_process")
    sinks.replace_by_key(ll.possible_dates(ll.benchmark_band_filter(b.coarse(spark, d))), path)
    return spark.read.parquet(path)


# --- documents ----------------------------------------------------------------------

# the navigation of a page is well-formed XML and plays the estimates document
LINKS = "ul STRUCT<li: ARRAY<STRUCT<a: STRUCT<_VALUE: STRING, _href: STRING>>>>"
NAV = r"(?s)(<nav>.*?</nav>)"
JSON = """'{"nav":{"ul":[' || array_to_string(list_transform(regexp_extract_all(html, '<li>(.*?)</li>', 1), lambda x:
  '{"li":{"a":"' || regexp_extract(x, '>([^<]*)<', 1) || '","aAttrs":{"href":"' || regexp_extract(x, 'href="([^"]*)"', 1) || '"}}}'), ',') || ']}}'"""


def _documents(spark, d):
    return b.table(spark, d, "pages").select(F.col("page_id").alias("ticker"), F.regexp_extract("html", NAV, 1).alias("xml"))


@query("s14_read_estimates", f"SELECT page_id AS ticker, TIMESTAMP '2024-01-31 00:00:00' AS date, {JSON} AS estimates FROM pages")
def s14(spark, d):
    return docs.read_estimates(_documents(spark, d), LINKS, "nav", b.moment(b.EVENTS_NOW))


@query("x20_xml_to_map", """SELECT page_id AS ticker, regexp_extract(x, '>([^<]*)</a', 1) AS a, regexp_extract(x, 'href="([^"]*)"', 1) AS href FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li>(.*?)</li>', 1)) AS x FROM pages)""")
def x20(spark, d):
    mapped = _documents(spark, d).withColumn("doc", docs.xml_to_map(F.col("xml"), LINKS, "nav"))
    items = mapped.select("ticker", F.explode("doc.nav.ul").alias("item"))
    return items.select("ticker", "item.li.a", F.col("item.li.aAttrs.href").alias("href"))


@query("u08_prune_unsupported", f"SELECT t.ticker, t.industry, {JSON} AS estimates FROM trade_params t JOIN pages p ON p.page_id = t.ticker ")
def u08(spark, d):
    pages = b.table(spark, d, "pages")
    xml = F.regexp_extract("html", NAV, 1)
    estimates = docs.read_estimates(pages.select(F.col("page_id").alias("ticker"), xml.alias("xml")), LINKS, "nav", b.moment(b.EVENTS_NOW))
    return uu.prune_unsupported(b.trade_params(spark, d).select("ticker", "industry"), estimates)


TOKENS = """SELECT page_id, ticker FROM (SELECT page_id, unnest(string_split(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')), ' ')) AS ticker FROM pages) WHERE ticker <> ''"""


@query("s15_tickers_from_pages", TOKENS)
def s15(spark, d):
    pages = b.table(spark, d, "pages").select("page_id", "html")
    return docs.tickers_from_pages(pages, r"(?s)<article>(.*?)</article>")
