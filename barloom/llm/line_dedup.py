"""Lines that many documents share: exploded, hashed, counted, dropped, and the rest put together by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, text_key
from barloom.sources.stage import stage

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def shared_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """`hash, keeper` of keys in at least `min_docs` documents, from rows `id, hash`.

    The distinct (key, document) pairs spread over all tasks, also those of one very frequent key;
    the counts then meet as one row per key and task.
    """
    pairs = lines.select("hash", "id").distinct()
    counted = pairs.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.max("id").alias("keeper"))
    return counted.filter(F.col("docs") >= min_docs).select("hash", "keeper")


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    new_col: str = "dedup",
) -> DataFrame:
    """All rows and columns of `docs` with the kept text, and `new_col` = struct(n_lines, n_dropped).

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least
    `min_chars` code points found in at least `min_docs` distinct ids lose their lines except in
    the largest id that holds them.

    Null and empty texts are one empty line and come out as they are. A null id counts as one
    document, smaller than all others. Repeated rows are judged alike: rows of the keeper's id all
    keep the line. Ties do not arise, as ids are compared, not rows. An empty table stays empty.
    Other columns pass through untouched; a column of the new name is replaced.
    """
    # Lines are hashed once and written: the counts and the decisions read the small table.
    split = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    exploded = docs.select(
        F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.posexplode(split).alias("pos", "line")
    ).withColumn("line", line_key(F.col("line")))
    hashed = exploded.filter(F.char_length("line") >= min_chars).select(
        "id", "key", "pos", F.unhex(F.md5("line")).alias("hash")
    )
    lines = stage(hashed, "lines")
    shared = shared_lines(lines, min_docs)
    dropped = (
        lines.join(shared, "hash")
        .filter(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy("id", "key")
        .agg(F.collect_set("pos").alias("dropped"))
    )
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != new_col]).alias("row"))
    text = F.col("row").getField(text_col)
    joined = held.join(
        dropped, F.col("row").getField(id_col).eqNullSafe(F.col("id")) & (text_key(text) == F.col("key")), "left"
    ).select("row", "dropped", F.split(F.coalesce(text, F.lit("")), "\n").alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    joined = joined.select(
        "row",
        F.when(F.col("dropped").isNull(), text)
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("kept"),
        F.struct(
            F.size("lines").cast("long").alias("n_lines"),
            F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long").alias("n_dropped"),
        ).alias(new_col),
    )
    columns = [
        (F.col("kept") if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c != new_col
    ]
    return joined.select(*columns, F.col(new_col))
