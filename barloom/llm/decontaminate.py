"""Benchmark passages in documents, by a prefix-filtered join of word shingles.

Every item window is looked up by one necessary token: the rarest of its shingles in the corpus. A
document holds a window only if it holds that shingle, at a place with room for the words before and
after it; what is left is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat, keeps, lower_table
from barloom.sources.stage import stage

WINDOW_WORDS = 13
SHINGLE_WORDS = 3
SHARE = 20
FILTER_BITS = 26
CHUNK_BITS = 16


def word_bytes() -> np.ndarray:
    """Digits, small letters (after lower-casing) and all bytes beyond ASCII."""
    out = np.zeros(256, bool)
    out[48:58] = out[97:123] = out[128:] = True
    return out


LOWER, WORD = lower_table(), word_bytes()
ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of all words, and the words before each row."""
    data = LOWER[data]
    n = len(data)
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = WORD[data]
    edge = inside[1:] != inside[:-1]
    # A row's end also ends its word.
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < n)]
    joint = np.unique(cut[inside[cut] & inside[cut + 1]])
    starts = np.flatnonzero(edge & inside[1:])
    ends = np.flatnonzero(edge & inside[:-1])
    if len(joint):
        starts, ends = np.sort(np.concatenate((starts, joint))), np.sort(np.concatenate((ends, joint)))
    return data, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from running sums; equal words have equal hashes."""
    powers = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[0][: len(data)])))
    out = (sums[ends] - sums[starts]) * powers[1][starts]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


_POWERS: list[np.ndarray] = []
keeps("decontamination", _POWERS.clear)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, 1 << 21)
        inverse = np.uint64(pow(int(ODD), -1, 1 << 64))
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, b)))) for b in (ODD, inverse)]
    return _POWERS[0], _POWERS[1]


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of `size` words, by its first word."""
    n = max(0, len(words) - size + 1)
    out = np.full(n, np.uint64(size * int(ODD) % (1 << 64)))
    for k in range(size):
        out = (out ^ words[k : k + n]) * np.uint64(0x94D049BB133111EB)
        out ^= out >> np.uint64(31)
    return out


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """`item, number, words, hashes` of every window; hashes are of its shingles in order."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, starts, ends, first = words_of(*flat(part.column("text")))
            raw, hashed = data.tobytes(), word_hashes(data, starts, ends)
            rows = []
            for item, a, b in zip(part.column("item").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                words = [raw[s:e].decode(errors="replace") for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
                if not words:
                    continue
                size = min(window, len(words))
                own = shingle_hashes(hashed[a:b], min(shingle, size)).view(np.int64).tolist()
                span = size - min(shingle, size) + 1
                rows += [(item, i, words[i : i + size], own[i : i + span]) for i in range(len(words) - size + 1)]
            columns = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            types = [part.schema.field("item").type, pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64())]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "number", "words", "hashes"])

    source = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("item"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"item {kind}, number int, words array<string>, hashes array<long>")


def membership(hashes: DataFrame) -> np.ndarray:
    """Bits of the hashes: a filter of one fixed size, 8 MB, built in pieces by the tasks."""
    pieces = 1 << (FILTER_BITS - CHUNK_BITS)

    def fill(group: pa.Table) -> pa.Table:
        bits = np.zeros(1 << CHUNK_BITS, bool)
        bits[group.column("bit").to_numpy()] = True
        return pa.table({"piece": group.column("piece")[:1], "bits": pa.array([np.packbits(bits).tobytes()])})

    high = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    places = hashes.select(
        F.shiftright(high, CHUNK_BITS).cast("int").alias("piece"),
        high.bitwiseAND((1 << CHUNK_BITS) - 1).cast("int").alias("bit"),
    ).distinct()
    out = np.zeros((pieces, 1 << CHUNK_BITS >> 3), np.uint8)
    for row in places.groupBy("piece").applyInArrow(fill, "piece int, bits binary").collect():
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1


def _covered(spans: Column) -> Column:
    """Words inside any of the spans, which are sorted by start."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("words"))

    def add(state: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0), span["end"] - F.greatest(span["start"], state["end"]))
        return F.struct(
            F.greatest(state["end"], span["end"]).cast("long").alias("end"), (state["words"] + more).cast("long").alias("words")
        )

    return F.aggregate(spans, zero, add, lambda state: state["words"])


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW_WORDS,
    shingle: int = SHINGLE_WORDS,
    share: int = SHARE,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """`id, n_words, n_hit, items, contaminated` of every row of docs; `items` are sorted as strings.

    Words are runs of ASCII letters (in lower case), digits and characters beyond ASCII. An item's
    windows are its runs of `window` words, or all its words if fewer. A word of a document is hit if it
    lies inside any occurrence of a window; contaminated is `n_hit > 0 and share * n_hit >= n_words`.

    Null, empty and wordless texts have no words, and such items no windows; items with null ids are left
    out. Repeated rows and repeated ids are judged each on their own text. Ties between equally rare
    shingles go to the smaller hash. Without documents the result is empty, without items nothing
    is hit. `carry` names columns of docs to keep under their own names in a struct `row`.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    spark = docs.sparkSession
    windows = stage(item_windows(items, item_col, item_text, window, shingle), "windows")
    sizes = sorted(r[0] for r in windows.select(F.least(F.size("words"), F.lit(shingle))).distinct().collect())

    def scan(batches: Iterator[pa.RecordBatch], bits: np.ndarray):
        """Each slice with its words, and the places and hashes of shingles that the filter holds."""
        for part in chunks(batches, "text"):
            data, starts, ends, first = words_of(*flat(part.column("text")))
            hashed = word_hashes(data, starts, ends)
            row = np.repeat(np.arange(part.num_rows), np.diff(first))
            places, found = [], []
            for size in sizes:
                hashes = shingle_hashes(hashed, size)
                at = np.flatnonzero(held(bits, hashes))
                at = at[row[at] == row[at + size - 1]]
                places.append(at)
                found.append(hashes[at])
            at = np.concatenate([*places, np.zeros(0, np.int64)])
            order = np.argsort(at, kind="stable")
            yield part, (data, starts, ends, first, row), at[order], np.concatenate([*found, np.zeros(0, np.uint64)])[order]

    shingles = windows.select(F.explode("hashes").alias("hash"))
    all_bits = spark.sparkContext.broadcast(membership(shingles))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, hashes in scan(batches, all_bits.value):
            values, n = np.unique(hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n)], names=["hash", "n"])

    texts = docs.select(F.col(text_col).alias("text"))
    frequency = texts.mapInArrow(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))

    # The rarest shingle of each window is its necessary token.
    placed = windows.select("item", "number", "words", F.posexplode("hashes").alias("before", "hash"))
    ranked = placed.join(frequency, "hash", "left").groupBy("item", "number").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "before", "words")).alias("rare")
    )
    # A shingle that no document holds needs no look-up.
    needed = ranked.filter(F.col("rare.n") > 0).select("rare.hash", "rare.before", "rare.words", "item")
    needed = stage(
        needed.groupBy("hash").agg(F.collect_set(F.struct("before", "words", "item")).alias("windows")), "prefixes"
    )
    few_bits = spark.sparkContext.broadcast(membership(needed.select("hash")))
    reach = window

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, (data, starts, ends, first, row), at, hashes in scan(batches, few_bits.value):
            raw = data.tobytes()
            low = np.maximum(first[row[at]], at - reach)
            high = np.minimum(first[row[at] + 1], at + reach + 1)
            found: list[list] = [[] for _ in range(part.num_rows)]
            for r, a, b, c, h in zip(row[at].tolist(), low.tolist(), at.tolist(), high.tolist(), hashes.view(np.int64).tolist(), strict=True):
                words = [raw[s:e].decode(errors="replace") for s, e in zip(starts[a:c].tolist(), ends[a:c].tolist(), strict=True)]
                found[r].append({"hash": h, "at": b - int(first[r]), "back": b - a, "words": words})
            columns = [part.column(c) for c in part.schema.names if c != "text"]
            names = [c for c in part.schema.names if c != "text"]
            kind_of = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("back", pa.int32()), ("words", pa.list_(pa.string()))]))
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.diff(first)), pa.array(found, kind_of)], names=[*names, "n_words", "found"]
            )

    held_columns = [F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []
    source = docs.select(F.col(id_col).alias("id"), *held_columns, F.col(text_col).alias("text"))
    row_kind = f", row {source.schema['row'].dataType.simpleString()}" if carry else ""
    looked = source.mapInArrow(
        look, f"id {kind}{row_kind}, n_words long, found array<struct<hash:bigint,at:int,back:int,words:array<string>>>"
    )
    # Written once: a row's number is then the same in both uses.
    looked = stage(looked.withColumn("number", F.monotonically_increasing_id()), "looked")

    candidates = looked.select("number", F.explode("found").alias("f")).select("number", "f.*")
    joined = candidates.join(needed, "hash")
    fits = F.filter(
        "windows",
        lambda w: (w["before"] <= F.col("back"))
        & (F.slice(F.col("words"), F.col("back") - w["before"] + 1, F.size(w["words"])) == w["words"]),
    )
    hits = joined.select("number", "at", F.explode(fits).alias("w")).select(
        "number",
        F.col("w.item").alias("item"),
        F.struct(
            (F.col("at") - F.col("w.before")).cast("long").alias("start"),
            (F.col("at") - F.col("w.before") + F.size("w.words")).cast("long").alias("end"),
        ).alias("span"),
    )
    grouped = hits.groupBy("number").agg(
        F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"),
        _covered(F.sort_array(F.collect_set("span"))).alias("n_hit"),
    )
    none = F.array().cast("array<string>")
    out = looked.drop("found").join(grouped, "number", "left").select(
        "id",
        *(["row"] if carry else []),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", none).alias("items"),
    )
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))
