"""Verdicts on addresses: given rules by host and path, and rules mined from labelled addresses.

Mined rules are token combinations that FP-growth finds often in blocked addresses. They are counted over all
labelled rows, kept by support, confidence and lift, and only if no part of them says the same; an inverted
index on a rule's rarest token finds the addresses that hold it.

The work of FP-growth is bounded: tokens that stand in the same addresses are one item, and a transaction holds
at most `SPAN` items, the address's first and neighbours further on. So an address of any length, however often
it occurs, gives at most 2^SPAN item sets for each of its items.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower
from barloom.sources.stage import stage

ALLOW, BLOCK = "allow", "block"
SUPPORT = 0.001
LEAST_ROWS = 10
CONFIDENCE = 0.5
SURE = 3.0
SPAN = 8
SAMPLE_ROWS = 1_000_000
HOT_SETS = 1000
SALTS = 256


@dataclass(frozen=True)
class Rule:
    """`host/path`: fits the host and its subdomains where the path starts with /path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


#: Fixed values of the contract.
RULES = (
    Rule("com/", ALLOW),
    Rule("example.com/en/", BLOCK),
    Rule("www.example.com/en/", ALLOW),
    Rule("net/es/", BLOCK),
    Rule("net/fr/", BLOCK),
)


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(rules: Sequence[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def words_of(url: Column) -> Column:
    """Distinct tokens of an address in its order: the host, its labels and their parts, path words, names in the query.

    Numbers are left out; a null address has no tokens.
    """
    host, path = host_of(url), ascii_lower(path_of(url))
    query = F.coalesce(ascii_lower(F.regexp_extract(url, r"\?([^#]*)", 1)), F.lit(""))

    def named(prefix: str, words: Column) -> Column:
        useful = F.filter(words, lambda w: (w != "") & ~w.rlike("^[0-9]+$"))
        return F.transform(useful, lambda w: F.concat(F.lit(prefix), w))

    parts = F.concat(
        F.when(host != "", F.array(F.concat(F.lit("host:"), host))).otherwise(F.array().cast("array<string>")),
        named("label:", F.split(host, r"\.")),
        named("part:", F.array_except(F.split(host, r"[.\-_]"), F.split(host, r"\."))),
        named("path:", F.split(path, "[^a-z0-9]+")),
        named("query:", F.transform(F.split(query, "&"), lambda w: F.substring_index(w, "=", 1))),
    )
    return F.array_distinct(parts)


def tokens_of(url: Column) -> Column:
    """The same, sorted."""
    return F.array_sort(words_of(url))


def mine(
    labelled: DataFrame,
    url_col: str = "url",
    label_col: str = "blocked",
    support: float = SUPPORT,
    confidence: float = CONFIDENCE,
    sample_rows: int = SAMPLE_ROWS,
    span: int = SPAN,
    sure: float = SURE,
) -> DataFrame:
    """`tokens, confidence, lift, support, key` of the rules for blocking, `key` being the rule's rarest token.

    At most about `sample_rows` labelled rows are used, taken by a hash of the address. Rows without a label
    or an address are left out; repeated rows count as often as they occur; an address may have any length. A
    rule needs `support` of the rows and at least 10 of them, blocked and with its tokens; `confidence` of the
    rows with its tokens blocked; and that share more than `sure` standard errors (Wilson) above the share of
    all rows. Its tokens stand within `span` items of an address, the first item counted in; tokens that are
    always together come together. An empty table gives no rules.
    """
    spark = labelled.sparkSession
    rows = labelled.filter(F.col(label_col).isNotNull() & F.col(url_col).isNotNull()).select(
        F.col(url_col).alias("url"), F.col(label_col).cast("boolean").alias("blocked")
    )
    rows = stage(rows, "labelled")
    schema = "tokens array<string>, confidence double, lift double, support double, key string"
    n = rows.count()
    if n > sample_rows:
        rows = rows.filter(F.pmod(F.xxhash64("url"), F.lit(1 << 20)) < int((1 << 20) * sample_rows / n))
    counted = rows.groupBy(words_of(F.col("url")).alias("words")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("blocked").cast("long")).alias("bad")
    )
    sets = stage(counted, "token_sets")
    n, bad = sets.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if not bad:
        return spark.createDataFrame([], schema)
    least = max(math.ceil(support * n), LEAST_ROWS)
    items = stage(_items(sets, least), "items")
    transactions = stage(_transactions(sets, items, span), "transactions")
    size = transactions.count()
    if not size:
        return spark.createDataFrame([], schema)
    # A set in `least` blocked rows is in as many transactions at least; rows decide below.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / size).fit(transactions)
    found = (
        model.freqItemsets.select(F.array_sort("items").alias("all"), F.explode("items").alias("item"))
        .join(items.select("item", "together", F.struct("n", "item").alias("rare")), "item")
        .groupBy("all")
        .agg(F.array_sort(F.flatten(F.collect_list("together"))).alias("tokens"), F.min("rare").alias("rare"))
        .select("tokens", F.col("rare.item").alias("key"))
    )
    found = stage(found, "candidates")
    held = (
        sets.select("words", "n", "bad", F.explode("words").alias("key"))
        .join(found, "key")
        .filter(F.size(F.array_except("tokens", "words")) == 0)
        .groupBy("tokens", "key")
        .agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    )
    share, z = F.col("bad") / F.col("n"), sure
    middle, half = share + z * z / (2 * F.col("n")), z * F.sqrt(share * (1 - share) / F.col("n") + z * z / (4 * F.col("n") * F.col("n")))
    bound = (middle - half) / (1 + z * z / F.col("n"))
    mined = stage(
        held.filter((F.col("bad") >= least) & (share >= confidence) & (bound > bad / n)).select(
            "tokens", share.alias("confidence"), (share * n / bad).alias("lift"), (F.col("bad") / n).alias("support"), "key"
        ),
        "mined",
    )
    # A longer rule that is not surer than a part of it adds nothing.
    part = mined.select(F.col("tokens").alias("part"), F.col("confidence").alias("sure"), F.col("key").alias("token"))
    covered = (
        mined.select("tokens", "confidence", F.explode("tokens").alias("token"))
        .join(part, "token")
        .filter((F.size("part") < F.size("tokens")) & (F.size(F.array_except("part", "tokens")) == 0) & (F.col("sure") >= F.col("confidence")))
        .select("tokens")
        .distinct()
    )
    return mined.join(covered, "tokens", "left_anti").select("tokens", "confidence", "lift", "support", "key")


def _items(sets: DataFrame, least: int) -> DataFrame:
    """`item, together, n` of the tokens in at least `least` blocked rows; tokens of the same addresses are one item.

    Sameness rests on the counts and two 64-bit hashes of the addresses. Such tokens stand in one address, so
    a group is no longer than that.
    """
    each = sets.select(F.explode("words").alias("token"), "n", "bad", F.xxhash64("words").alias("own"))
    same = ["n", "bad", "sets", "first", "second"]
    tokens = each.groupBy("token").agg(
        F.sum("n").alias("n"),
        F.sum("bad").alias("bad"),
        F.count(F.lit(1)).alias("sets"),
        F.bit_xor("own").alias("first"),
        F.bit_xor(F.xxhash64("own", F.lit(1))).alias("second"),
    )
    grouped = tokens.filter(F.col("bad") >= least).groupBy(*same).agg(F.array_sort(F.collect_list("token")).alias("together"))
    return grouped.select(F.element_at("together", 1).alias("item"), "together", "n")


def _transactions(sets: DataFrame, items: DataFrame, span: int) -> DataFrame:
    """`items` of at most `span` items each, one or more for each blocked row."""
    placed = (
        sets.filter("bad > 0")
        .select(F.xxhash64("words").alias("own"), "bad", F.posexplode("words").alias("at", "token"))
        .join(items.select("item", F.explode("together").alias("token")), "token")
        .groupBy("own", "bad", "item")
        .agg(F.min("at").alias("at"))
        .groupBy("own", "bad")
        .agg(F.array_sort(F.collect_list(F.struct("at", "item"))).getField("item").alias("all"))
    )
    first = F.slice("all", 1, 1)
    windows = F.transform(F.sequence(F.lit(0), F.size("all") - span), lambda i: F.concat(first, F.slice("all", i + 2, span - 1)))
    cut = F.when(F.size("all") <= span, F.array("all")).otherwise(windows)
    return placed.select("bad", F.explode(cut).alias("items")).select(
        F.explode(F.array_repeat("items", F.col("bad").cast("int"))).alias("items")
    )


def judge(pages: DataFrame, mined: DataFrame, rules: Sequence[Rule] = RULES, url_col: str = "url") -> DataFrame:
    """All rows and columns of pages with `judged` = struct(host, path, rule, verdict, confidence, tokens).

    The longest listed rule that fits decides; without one the surest mined rule blocks, else the address
    is allowed. A null address, or one without `://`, has an empty host and path, fits no listed rule and is
    allowed unless its tokens say otherwise. `confidence` and `tokens` name the surest mined rule that the
    address holds (ties: the least tokens), whether or not it decides. Each distinct set of tokens is matched once, however many rows
    have it; a set with over a thousandth of the rows is dealt over many tasks; repeated rows are judged alike. A column named `judged` is replaced.
    """
    rest = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c != "judged"]).alias("row")
    rows = pages.select(rest, tokens_of(F.col(f"`{url_col}`")).alias("tokens"))
    sets = stage(rows.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")), "token_sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    # At most HOT_SETS - 1 sets can hold so many rows; the rows of these are dealt over SALTS tasks.
    often = sets.filter(F.col("n") * HOT_SETS > total).select(F.xxhash64("tokens").alias("hash")).distinct()
    hot = F.xxhash64("tokens").isin([r["hash"] for r in often.collect()])
    salted = rows.withColumn("salt", F.when(hot, F.monotonically_increasing_id() % SALTS).otherwise(F.lit(0)))
    matched = (
        sets.select("tokens", F.explode("tokens").alias("key"))
        .join(mined.select(F.col("tokens").alias("rule"), "confidence", "key"), "key")
        .filter(F.size(F.array_except("rule", "tokens")) == 0)
        .groupBy("tokens")
        .agg(F.min(F.struct((-F.col("confidence")).alias("less"), "rule")).alias("best"))
        .select("tokens", (-F.col("best.less")).alias("confidence"), F.col("best.rule").alias("by"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(hot, F.lit(SALTS - 1)).otherwise(F.lit(0)))))
        .withColumn("salt", F.col("salt").cast("long"))
    )
    url = F.col("row").getField(url_col)
    text, verdict = listed(rules, F.col("host"), F.col("path"))
    out = salted.join(matched, ["tokens", "salt"], "left").select("row", "confidence", "by", host_of(url).alias("host"), path_of(url).alias("path"))
    fallback = F.when(F.col("confidence").isNotNull(), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    judged = F.struct(
        "host", "path", text.alias("rule"), F.coalesce(verdict, fallback).alias("verdict"), F.col("confidence").alias("confidence"),
        F.col("by").alias("tokens"),
    )
    columns = [F.col("row").getField(c).alias(c) for c in pages.columns if c != "judged"]
    return out.select(*columns, judged.alias("judged"))
