"""Sources mixed to target weights: exact block quotas, dealt over shards by a tree of hypergeometric draws.

A block is up to `BLOCK_WORDS` consecutive words of a document. Each source's blocks stand in an order of
digests; its quota is how many of them, from the first, reach the source's target. A multivariate
hypergeometric splitting tree deals the quotas over output shards: a node gives half of its blocks to its
left child, as many of each source as a draw without replacement gives. A shard then takes the next blocks
of each source's order, so shards are disjoint, and orders them by another digest.

Everything is DataFrame functions. Digests and draws depend on values only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import text_key
from barloom.sources.stage import stage

WEIGHTS = (3, 1, 2)
PERCENT = 150
MOST = 2
SEED = 42
BLOCK_WORDS = 512
# rows that one task orders: blocks of a bucket, of a stretch of ranks, of a shard
BUCKET_BLOCKS = 4096
SHARD_BLOCKS = 65_536
COPIES_AT_ONCE = 4096
WORD = r"[^\x20\x09-\x0D]+"
PIECE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
UNIT = ("source", "id", "key", "copy")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def explode_numbers(rows: DataFrame, count: Column, name: str) -> DataFrame:
    """One row for each number from 0 below `count`, in two steps so that no array is long."""
    parts = rows.withColumn("_count", count).filter("_count > 0")
    parts = parts.withColumn("_from", F.explode(F.sequence(F.lit(0), F.col("_count") - 1, F.lit(COPIES_AT_ONCE))))
    last = F.least(F.col("_from") + COPIES_AT_ONCE, F.col("_count")) - 1
    return parts.withColumn(name, F.explode(F.sequence("_from", last))).drop("_count", "_from")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`source, id, key, copy, size` of every row: words of its text, and what tells it from all others.

    Null and empty texts have no words. Equal rows are numbered by `copy`.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(source_col).cast("string").alias("source"),
        F.col(id_col).alias("id"),
        text_key(text).alias("key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    )
    equal = rows.groupBy("source", "id", "key").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("_rows"))
    units = explode_numbers(equal, F.col("_rows"), "copy").select(*UNIT, "size")
    return stage(units, "units")


def targets(
    units: DataFrame, weights: Sequence[int] = WEIGHTS, percent: int = PERCENT, most: int = MOST
) -> DataFrame:
    """`source, number, source_size, blocks, target`: one row per source, in order of code points, null last.

    Weights repeat over the sources and share `percent` of all words. A target stops at `most` times its
    source; the excess goes to the others by weight until none is above. So sources that stop come first in
    the order of size by weight, and all others have one level of words by weight.
    """
    sizes = units.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.sum(F.ceil(F.col("size") / BLOCK_WORDS)).alias("blocks")
    )
    number = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    given = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    rows = sizes.withColumn("number", number)
    rows = rows.withColumn("weight", F.get(given, F.pmod("number", F.lit(len(weights)))))
    filling = Window.orderBy(F.col("source_size") / F.col("weight"), "number")
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("place", F.row_number().over(filling))
        .withColumn(
            "left",
            percent * F.sum("source_size").over(everything)
            - 100 * most * F.coalesce(F.sum("source_size").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        )
        .withColumn("shares", 100 * F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing)))
    )
    fits = F.col("left") * F.col("weight") <= F.col("source_size") * most * F.col("shares")
    rows = rows.withColumn("first", F.min(F.when(fits, F.col("place"))).over(everything))
    at = F.col("place") == F.col("first")
    level = (F.max(F.when(at, F.col("left"))).over(everything) * F.col("weight")) / F.max(F.when(at, F.col("shares"))).over(
        everything
    )
    open_ = F.coalesce(F.col("place") >= F.col("first"), F.lit(False))
    target = F.when(open_, level).otherwise((F.col("source_size") * most).cast("double"))
    return rows.select("source", "number", "source_size", "blocks", target.alias("target"))


def ordered_blocks(units: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """Blocks of every pass over a source that its target reaches: `number, pass, block, words, digest, bucket`.

    Buckets are ranges of digests of about `BUCKET_BLOCKS` blocks, whatever the share of the source.
    """
    info = sources.filter("source_size > 0").select(
        F.col("source").alias("_source"),
        "number",
        "target",
        F.ceil(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).alias("_passes"),
        (F.floor(F.col("blocks") / BUCKET_BLOCKS) + 1).alias("_buckets"),
    )
    rows = units.join(info, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = explode_numbers(rows, F.ceil(F.col("size") / BLOCK_WORDS), "block")
    rows = rows.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_passes") - 1)))
    named = [F.lit(str(seed)), "pass", F.coalesce(F.col("id").cast("string"), F.lit("null")), "key", "copy", "block"]
    digest = F.md5(F.concat_ws(":", *named))
    return rows.withColumn("digest", digest).select(
        "number",
        "target",
        "pass",
        *UNIT,
        "block",
        F.least(F.lit(BLOCK_WORDS), F.col("size") - F.col("block") * BLOCK_WORDS).alias("words"),
        "digest",
        F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * F.col("_buckets") / F.lit(1 << 32)).alias("bucket"),
    )


def take_blocks(units: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """The blocks that each source gives, with their `rank` in its order; the last one is cut at the target.

    Words and blocks before a bucket come from one row per bucket, so no task orders a whole source.
    """
    blocks = ordered_blocks(units, sources, seed)
    inside = ["number", "pass", "bucket"]
    sums = blocks.groupBy(*inside).agg(F.sum("words").alias("_w"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("number").orderBy("pass", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        *inside,
        F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("words_before"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("blocks_before"),
    )
    order = Window.partitionBy(*inside).orderBy("digest")
    so_far = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    ranked = (
        blocks.join(starts, inside)
        .withColumn("rank", F.col("blocks_before") + F.row_number().over(order) - 1)
        .withColumn("words", F.least(F.col("words"), F.floor("target") - F.col("words_before") - so_far))
        .filter(F.col("words") > 0)
    )
    return stage(ranked.select("number", "rank", "pass", *UNIT, "block", "words", "digest"), "blocks")


def uniform(*values: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*values), 11) + F.lit(0.5)) / F.lit(float(1 << 53))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` taken from `total` are `marked`, by inversion of `u` in (0, 1).

    Probabilities relative to the mode's come from the ratio of neighbours, upwards, then downwards. Values
    over 12 standard deviations off (and over 12) have less than the rounding of a double, and are not tried.
    """
    n, k, d = total.cast("double"), marked.cast("double"), drawn.cast("double")

    def from_mode(v: Column) -> Column:
        mode, low, high = v["mode"], v["low"], v["high"]
        none = F.array().cast("array<bigint>")
        ups = F.when(high > mode, F.sequence(mode, high - 1)).otherwise(none)
        downs = F.when(mode > low, F.sequence(mode, low + 1, F.lit(-1).cast("long"))).otherwise(none)

        def up(x: Column) -> Column:
            return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

        def down(x: Column) -> Column:
            return x * (n - k - d + x) / ((k - x + 1) * (d - x + 1))

        def weight(values: Column, ratio: Callable[[Column], Column]) -> Column:
            zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s"))

            def add(acc: Column, x: Column) -> Column:
                return let(acc["w"] * ratio(x), lambda w: F.struct(w.alias("w"), (acc["s"] + w).alias("s")))

            return F.aggregate(values, zero, add, lambda acc: acc["s"])

        def pick(values: Column, ratio: Callable[[Column], Column], step: int, point: Column, last: Column) -> Column:
            zero = F.struct(F.lit(1.0).alias("w"), point.alias("t"), F.lit(None).cast("long").alias("x"))

            def look(acc: Column, x: Column) -> Column:
                def turn(w: Column) -> Column:
                    here = F.when(acc["x"].isNull() & (acc["t"] < w), x + step).otherwise(acc["x"])
                    return F.struct(w.alias("w"), (acc["t"] - w).alias("t"), here.alias("x"))

                return let(acc["w"] * ratio(x), turn)

            return F.aggregate(values, zero, look, lambda acc: F.coalesce(acc["x"], last))

        def choose(s: Column) -> Column:
            point = u * (1 + s["up"] + s["down"])
            return (
                F.when(point < 1, mode)
                .when(point < 1 + s["up"], pick(ups, up, 1, point - 1, high))
                .otherwise(pick(downs, down, -1, point - 1 - s["up"], low))
            )

        return let(F.struct(weight(ups, up).alias("up"), weight(downs, down).alias("down")), choose)

    least = F.greatest(F.lit(0).cast("long"), drawn - (total - marked))
    greatest = F.least(drawn, marked)
    mode = F.least(greatest, F.greatest(least, F.floor((d + 1) * (k + 1) / (n + 2))))
    spread = F.sqrt(d * (k / n) * ((n - k) / n) * ((n - d) / F.greatest(n - 1, F.lit(1.0))))
    reach = F.ceil(12 * spread) + 12

    def bounded(v: Column) -> Column:
        return let(
            F.struct(
                v["mode"].alias("mode"),
                F.greatest(v["least"], v["mode"] - v["reach"]).alias("low"),
                F.least(v["greatest"], v["mode"] + v["reach"]).alias("high"),
            ),
            from_mode,
        )

    given = F.struct(mode.alias("mode"), least.alias("least"), greatest.alias("greatest"), reach.alias("reach"))
    return F.when(greatest == least, least).otherwise(let(given, bounded))


def split_nodes(nodes: DataFrame, level: int, seed: int = SEED) -> DataFrame:
    """Children of the nodes `node, quotas`: the left one gets half of the blocks, source by source."""
    whole = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
    zero = F.struct(
        F.floor(F.col("whole") / 2).alias("drawn"), F.col("whole").alias("rest"), F.array().cast("array<bigint>").alias("out")
    )

    def deal(acc: Column, quota: Column) -> Column:
        u = uniform(F.lit(seed), F.lit(level), F.col("node"), F.size(acc["out"]))
        return let(
            hypergeometric(acc["rest"], quota, acc["drawn"], u),
            lambda x: F.struct(
                (acc["drawn"] - x).alias("drawn"),
                (acc["rest"] - quota).alias("rest"),
                F.concat(acc["out"], F.array(x)).alias("out"),
            ),
        )

    dealt = nodes.withColumn("whole", whole).withColumn("left", F.aggregate("quotas", zero, deal, lambda acc: acc["out"]))
    rest = F.zip_with("quotas", "left", lambda q, x: q - x)
    children = F.array(
        F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
        F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("quotas")),
    )
    return dealt.select(F.explode(children).alias("child")).select("child.node", "child.quotas")


def shard_quotas(quotas: DataFrame, depth: int, seed: int = SEED) -> DataFrame:
    """`shard, number, quota` of the leaves from one row per source `number, quota`.

    Every eighth level is written and dealt over the tasks.
    """
    listed = F.array_sort(F.collect_list(F.struct("number", "quota")))
    nodes = quotas.agg(listed.alias("all")).select(
        F.lit(0).cast("long").alias("node"), F.transform("all", lambda x: x["quota"]).alias("quotas")
    )
    numbers = quotas.agg(listed.alias("all")).select(F.transform("all", lambda x: x["number"]).alias("numbers"))
    for level in range(depth):
        if level and level % 8 == 0:
            nodes = stage(nodes.repartition("node"), "tree")
        nodes = split_nodes(nodes, level, seed)
    leaves = nodes.select(F.col("node").alias("shard"), F.posexplode("quotas").alias("at", "quota"))
    known = numbers.select(F.posexplode("numbers").alias("at", "number"))
    return leaves.join(known, "at").select("shard", "number", "quota")


def mix(units: DataFrame, sources: DataFrame, seed: int = SEED, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """`shard, position, source, id, key, copy, pass, start, words`: the mix, a row for each block taken.

    `start` is the block's first word in its document. Shards are a power of two, with at most `shard_blocks`
    blocks on average; their sizes differ by at most one for each level of the tree.
    """
    taken = take_blocks(units, sources, seed)
    quotas = taken.groupBy("number").agg(F.count(F.lit(1)).alias("quota"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    depth = max(0, (-(-total // shard_blocks) - 1).bit_length())
    leaves = stage(shard_quotas(quotas, depth, seed), "quotas").filter(F.col("quota") > 0)

    # A shard's stretch of ranks begins, and goes on at each cell that it enters: marks among the blocks say where.
    before = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.withColumn("_from", F.coalesce(F.sum("quota").over(before), F.lit(0)))
    cells = F.floor(F.col("_from") / BUCKET_BLOCKS), F.floor((F.col("_from") + F.col("quota") - 1) / BUCKET_BLOCKS)
    marks = leaves.select("number", "shard", "_from", F.explode(F.sequence(*cells)).alias("cell")).select(
        "number", "cell", F.greatest(F.col("_from"), F.col("cell") * BUCKET_BLOCKS).alias("rank"), "shard"
    )
    rows = taken.select("number", F.floor(F.col("rank") / BUCKET_BLOCKS).alias("cell"), "rank", F.struct(*taken.columns).alias("row"))
    along = Window.partitionBy("number", "cell").orderBy("rank", F.col("row").isNotNull())
    dealt = (
        rows.unionByName(marks, allowMissingColumns=True)
        .withColumn("shard", F.last("shard", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        .filter(F.col("row").isNotNull())
    )
    local = F.xxhash64(F.lit(seed), F.col("row.digest"))
    position = F.row_number().over(Window.partitionBy("shard").orderBy(local, "row.digest", "number")) - 1
    mixed = dealt.withColumn("position", position.cast("long")).select(
        "shard",
        "position",
        *[F.col(f"row.{c}").alias(c) for c in (*UNIT, "pass")],
        (F.col("row.block") * BLOCK_WORDS).alias("start"),
        F.col("row.words").alias("words"),
    )
    return stage(mixed, "mix")


def taken_words(units: DataFrame, sources: DataFrame, mixed: DataFrame) -> DataFrame:
    """`id, size, source, source_size, target, taken` of every row, also of those that the mix leaves out."""
    rows = units.select(*UNIT, "size", F.lit(0).cast("long").alias("taken")).unionByName(
        mixed.select(*UNIT, F.lit(0).cast("long").alias("size"), F.col("words").alias("taken"))
    )
    summed = rows.groupBy(*UNIT).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    info = sources.select(F.col("source").alias("_source"), "source_size", "target")
    return summed.join(info, F.col("source").eqNullSafe(F.col("_source"))).select(
        "id", "size", "source", "source_size", "target", "taken"
    )


def mixed_texts(
    mixed: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """`shard, position, text` of the mix: each block's words with the white space before them.

    A document's text meets the list of its blocks once, however many they are.
    """
    lists = mixed.groupBy("source", "id", "key").agg(F.collect_list(F.struct("shard", "position", "start", "words")).alias("blocks"))
    own = docs.select(
        F.col(source_col).cast("string").alias("_source"), F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("key"),
        F.col(text_col).alias("text"),
    ).dropDuplicates(["_source", "_id", "key"])
    same = F.col("source").eqNullSafe(F.col("_source")) & F.col("id").eqNullSafe(F.col("_id"))
    met = lists.join(own.withColumnRenamed("key", "_key"), same & (F.col("key") == F.col("_key")))
    met = met.withColumn("pieces", F.regexp_extract_all("text", F.lit(PIECE), 0))
    cut = F.transform(
        "blocks",
        lambda b: F.struct(
            b["shard"].alias("shard"),
            b["position"].alias("position"),
            F.array_join(F.slice("pieces", (b["start"] + 1).cast("int"), b["words"].cast("int")), "").alias("text"),
        ),
    )
    return met.select(F.explode(cut).alias("b")).select("b.shard", "b.position", "b.text")


def mix_documents(docs: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, sources and the mix of a table by the default weights.

    Null and empty texts have no block and stay with nothing taken. A null source is a source of its own, the
    last; a null id is an id. Repeated rows are rows of their own, told apart by number. Very long texts are many
    blocks. An empty table, or one without words, gives no blocks. Ties between digests are between equal blocks
    only. Columns other than the three named are not read.
    """
    units = measure(docs, **columns)
    sources = stage(targets(units), "sources")
    return units, sources, mix(units, sources)
