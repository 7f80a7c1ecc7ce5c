"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, language_id, line_dedup, packing, simhash
from barloom.llm.common import table, text_key
from barloom.llm.queries import learned_languages, vocabulary
from barloom.sources.stage import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; those without a letter, and null texts, go. Mixtures stay."""
    found = language_id.identify(docs, learned_languages(spark, sf_dir), new_col="__language")
    return found.filter(F.col("__language.lang") != language_id.UNKNOWN).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that stay in another one; n_chars follows the text.

    A document that loses all its lines stays with an empty text.
    """
    kept = line_dedup.dedup_lines(docs, new_col="__dedup")
    changed = F.col("__dedup.n_dropped") > 0
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        kept = kept.withColumn("n_chars", F.when(changed, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group; of its repeated rows one, whichever.

    A null id comes after all others; equal ids of different texts are told apart by the text.
    """
    found = simhash.near_duplicates(docs)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")
    kept = found.groupBy("root").agg(first).select(F.col("first.id").alias("__id"), F.col("first.key").alias("__key"))
    keyed = docs.withColumn("__own", text_key(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key"))
    one = keyed.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__own"])
    return one.select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark passage."""
    judged = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=tuple(docs.columns))
    return judged.filter(~F.col("contaminated")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens, with their ids."""
    return packing.pack(docs, vocabulary()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_shared_lines),
    ("simhash_dedup", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Token ids, fingerprints and mixtures are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
