"""Languages of a text as a mixture, estimated by expectation-maximisation over its words.

A word's likelihood in a language comes from its character trigrams. A text is a mixture of languages;
proportions maximise its likelihood, and a language joins the set only if that pays for its
parameter in the Bayesian information criterion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat, release_others

BUCKETS = 1 << 16
# Text scored at once: its trigrams take about 60 times as many bytes for a moment.
SCORED_BYTES = 1 << 19
SAMPLE_BYTES = 4_000_000
SMOOTHING = 0.5
ROUNDS = 12
UNKNOWN = "und"
FLOOR = -30.0
HELD_OUT = 2


def _letters() -> np.ndarray:
    out = np.zeros(256, bool)
    out[65:91] = out[97:123] = out[128:] = True
    return out


LETTER = _letters()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each trigram (a word stands between blanks), its word, and words before each row."""
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = LETTER[data]
    first = inside[1:-1] & ~inside[:-2]
    cut = offsets[:-1]
    cut = cut[cut < n]
    first[cut] |= inside[1:-1][cut]
    at = np.flatnonzero(inside[1:-1])
    word = np.cumsum(first)[at] - 1
    last = np.ones(len(at), bool)
    last[:-1] = word[1:] != word[:-1]
    here = data[at].astype(np.uint32)
    begins = first[at]
    before = np.where(begins, 32, np.concatenate(([32], here[:-1]))).astype(np.uint32)
    after = np.where(last, 32, np.concatenate((here[1:], [32]))).astype(np.uint32)
    code = (before << 16 | here << 8 | after) * np.uint32(0x9E3779B1)
    starts = np.flatnonzero(begins)
    words_before = np.searchsorted(at[starts], offsets)
    return (code >> np.uint32(16)).astype(np.int64), starts, words_before


def lowered(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return flat(pc.utf8_lower(column.cast(pa.large_string())))


def train(labelled: DataFrame, text_col: str, lang_col: str, sample_bytes: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Languages in order and log probabilities of the buckets, from about `sample_bytes` of each language.

    The sample takes rows by a hash of their text, at a rate from each language's bytes: it is bounded, and
    does not depend on the rows' order. Counts of a language are summed by the tasks.
    """
    rows = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    languages = sorted(k for k, n in sizes.items() if n)
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    rate = F.lit(0.0)
    for lang in languages:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_bytes / sizes[lang]))).otherwise(rate)
    share = (F.shiftrightunsigned(F.xxhash64("text"), 11) / float(1 << 53)).cast("double")
    number = {lang: i for i, lang in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for part in chunks(batches, "text"):
            bucket, starts, words_before = trigrams(*lowered(part.column("text")))
            sizes = np.append(starts, len(bucket))[words_before]
            own = np.array([number[x] for x in part.column("lang").to_pylist()])
            np.add.at(total.reshape(-1), np.repeat(own, np.diff(sizes)) * BUCKETS + bucket, 1)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(total[lang, bucket])],
            names=["lang", "bucket", "n"],
        )

    counts = np.zeros((len(languages), BUCKETS))
    sampled = rows.filter(share < rate).mapInArrow(count, "lang int, bucket int, n long")
    # One row for each language and bucket at most: a model of fixed size.
    for r in sampled.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts[r["lang"], r["bucket"]] = r["n"]
    counts += SMOOTHING
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)


def mixtures(
    likelihood: np.ndarray, row: np.ndarray, rows: int, rounds: int = ROUNDS, times: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Chosen proportions (rows by languages) from log likelihoods of words; and words of each row.

    Words stand in order of their rows, a word that is `times` times in its row once. Languages join a row's
    set one by one, the one with the largest share of the full mixture first, as long as the penalised
    likelihood gains; rows without a gain take no part in the next step.
    """
    times = np.ones(len(row)) if times is None else times.astype(float)
    words = np.bincount(row, times, rows)
    size = likelihood.shape[1]
    best = np.zeros((rows, size))
    present, first, counts = np.unique(row, return_index=True, return_counts=True)
    if not len(present):
        return best, words
    top = likelihood.max(axis=1, keepdims=True)
    weight = np.ascontiguousarray(np.exp(np.maximum(likelihood - top, FLOOR)).T)

    def fit(weight: np.ndarray, times: np.ndarray, counts: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Shares (languages by rows) and log likelihood of each row, for words in row order."""
        starts = np.cumsum(counts) - counts
        total = np.add.reduceat(times, starts)
        share = np.full((len(weight), len(counts)), 1 / len(weight))
        for _ in range(rounds):
            mixed = np.repeat(share, counts, axis=1)
            mixed *= weight
            mixed *= times / mixed.sum(axis=0)
            share = np.add.reduceat(mixed, starts, axis=1) / total
        reached = (np.repeat(share, counts, axis=1) * weight).sum(axis=0)
        return share, np.add.reduceat(times * np.log(reached + 1e-300), starts)

    full, _ = fit(weight, times, counts, rounds)
    order = np.argsort(-full, axis=0, kind="stable")
    gain = np.add.reduceat(times * np.log(weight[np.repeat(order[0], counts), np.arange(len(row))] + 1e-300), first)
    best[present, order[0]] = 1
    open_rows = np.arange(len(present))
    for k in range(1, size):
        inside = np.repeat(np.isin(np.arange(len(present)), open_rows), counts)
        n, at = counts[open_rows], np.flatnonzero(inside)
        chosen = np.repeat(order[: k + 1, open_rows], n, axis=1)
        share, new = fit(weight[chosen, at], times[at], n, rounds)
        better = 2 * (new - gain[open_rows]) > np.log(np.maximum(words[present[open_rows]], 2))
        open_rows = open_rows[better]
        if not len(open_rows):
            break
        gain[open_rows] = new[better]
        best[present[open_rows]] = 0
        best[present[open_rows][None, :], order[: k + 1, open_rows]] = share[:, better]
    return best, words


def distinct_words(bucket: np.ndarray, starts: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the equal words of each row, in row order, and how many they are; words of the same trigrams count as equal."""
    mixed = (bucket.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    key = np.add.reduceat(mixed, starts)
    order = np.lexsort((key, row))
    key, own = key[order], row[order]
    new = np.ones(len(order), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return order[first], np.diff(np.append(first, len(order)))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == HELD_OUT, F.lit(False))


def identify(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray],
    text_col: str = "text",
    new_col: str = "language",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """All rows and columns of docs (or those to `keep`) with `language` = struct(lang, score, shares), in one pass.

    The text alone decides. The language with the largest share of the chosen mixture wins, ties go
    to the first in alphabetical order; score is that share. Null, empty and letterless texts, and all
    texts if nothing could be learned, are `und` with score 0. Words are scored over whole texts, however
    long. Repeated rows agree. Other columns pass through, one of the new column's name is replaced.
    """
    languages, logs = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(logs.T))
    names = [c for c in (docs.columns if keep is None else keep) if c != new_col]
    result = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("shares", pa.list_(pa.float64()))])

    def beside(batch: pa.RecordBatch) -> pa.RecordBatch:
        """The text is a field of the row if it is kept, so it comes once."""
        row = batch.column("row")
        text = row.field(names.index(text_col)) if text_col in names else batch.column("text")
        return pa.RecordBatch.from_arrays([row, text], names=["row", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_others("language_id")
        table = shared.value
        for part in chunks(map(beside, batches), "text", SCORED_BYTES):
            texts = part.column("text")
            rows = part.num_rows
            known = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False))
            pred, score = np.full(rows, len(languages)), np.zeros(rows)
            best = np.zeros((rows, len(languages)))
            bucket, starts, words_before = trigrams(*lowered(texts))
            if len(starts) and languages:
                row = np.repeat(np.arange(rows), np.diff(words_before))
                words = np.stack([np.add.reduceat(table[:, k][bucket], starts, dtype=np.float64) for k in range(len(languages))], 1)
                some, times = distinct_words(bucket, starts, row)
                best, n = mixtures(words[some], row[some], rows, times=times)
                known &= n > 0
                pred = np.where(known, best.argmax(axis=1), len(languages))
                score = np.where(known, np.clip(best.max(axis=1), 0, 1), 0.0)
            labels = [*languages, UNKNOWN]
            found = pa.StructArray.from_arrays(
                [pa.array([labels[k] for k in pred]), pa.array(score), pa.array(best.tolist(), pa.list_(pa.float64()))],
                fields=list(result),
            )
            yield pa.RecordBatch.from_arrays([part.column("row"), found], names=["row", "found"])

    source = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), *([] if text_col in names else [F.col(text_col).alias("text")])
    )
    kind = source.schema["row"].dataType.simpleString()
    found = source.mapInArrow(run, f"row {kind}, found struct<lang:string,score:double,shares:array<double>>")
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("found").alias(new_col))
