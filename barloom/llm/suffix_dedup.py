"""Removal of byte strings that occur twice, by merged Burrows-Wheeler transforms of what may repeat.

Places chosen by content (the least gram hash of every half length) stand for all strings: a string of
`length` bytes and its copy have one at the same place. Only places whose next bytes occur twice are
looked at further. What lies around them is cut out once for all its equal copies, dealt into
cells by those bytes, and searched there by merging transforms. In a cell that many different
surroundings share, those equal under all its windows are counted and go on as one, and what is left is
split by longer stretches, down to single places, which counting decides. So no search holds more than
`cell_rows` rows of a cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat, text_key
from barloom.llm.suffix_merge import Hashes, mix, repeated_windows
from barloom.sources.stage import Steps, stage

LENGTH = 400
CELL_ROWS = 8192
BATCH_BYTES = 1 << 20
LOOK_BYTES = 1 << 19


def least_places(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and byte place of the chosen grams: the leftmost least one of each half window inside a row."""
    n, half = len(data), length // 2
    gram = min(16, max(2, length // 8))
    sizes = np.diff(offsets)
    long = sizes >= length
    if not long.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(max(0, n - gram + 1))
    bits = max(1, int(n).bit_length())
    value = (Hashes(data).of(at, at + gram) >> np.uint64(bits)) << np.uint64(bits) | at.astype(np.uint64)
    pad = -len(value) % half + half
    value = np.concatenate((value, np.full(pad, np.iinfo(np.uint64).max, np.uint64)))
    rows = value.reshape(-1, half)
    before = np.minimum.accumulate(rows, axis=1).reshape(-1)
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    last = len(value) - half + 1
    least = np.minimum(after[:last], before[half - 1 :])
    valid = np.zeros(n + 1, np.int64)
    np.add.at(valid, offsets[:-1][long], 1)
    np.add.at(valid, (offsets[1:] - length + 1)[long], -1)
    starts = np.flatnonzero(np.cumsum(valid)[:n] > 0)
    places = np.unique(least[starts] & np.uint64((1 << bits) - 1)).astype(np.int64)
    return np.searchsorted(offsets, places, side="right") - 1, places


def _spans(spans: Column) -> Column:
    """Sorted spans as maximal runs."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["end"] >= span["start"])
        longer = F.concat(
            F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
            F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))),
        )
        return F.when(meets, longer).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(spans, empty, add)


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """`id, n_bytes, n_removed, n_spans, kept` of every row: its UTF-8 bytes without those that any string of
    `length` bytes covers that starts somewhere else too, in the same row or another.

    All strings are judged on the input. Null and empty texts have 0 bytes, and texts shorter than the length
    are kept whole. Repeated rows are copies of each other, so all of them lose such strings. Overlapping
    copies count. Matches never cross rows. Null ids pass through; other columns are not read; an empty
    table stays empty. Stretches that fill whole surroundings, or all windows of a large cell, are told apart
    by two 64-bit hashes.
    """
    half = length // 2
    core = length - half + 1
    side, middle = half - 1, half // 2
    kind = docs.schema[id_col].dataType.simpleString()
    place_kind = "array<struct<a:int,la:int,ra:int,g:bigint,f:bigint,low:bigint,high:bigint>>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", LOOK_BYTES):
            data, offsets = flat(part.column("text"))
            row, place = least_places(data, offsets, length)
            la = np.minimum(side, place - offsets[row])
            ra = np.minimum(side, offsets[row + 1] - place - core)
            own, other = Hashes(data), Hashes(data, 1)
            # What all windows of the nearer and of the further places hold, where they fit.
            low = other.of(place, place + np.minimum(core + ra, length + 1 - middle))
            high = other.of(place - np.minimum(la, middle), place + core)
            f = other.of(place - la, place + core + ra) ^ mix((la * length + ra).astype(np.uint64))
            columns = [place - offsets[row], la, ra] + [x.view(np.int64) for x in (own.of(place, place + core), f, low, high)]
            types = [pa.int32()] * 3 + [pa.int64()] * 4
            names = ["a", "la", "ra", "g", "f", "low", "high"]
            structs = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
            ends = np.searchsorted(row, np.arange(part.num_rows + 1))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), structs)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), lists], names=["id", "key", "places"])

    id_key = [F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key")]
    texts = docs.select(*id_key, F.col(text_col).alias("text"))
    looked = texts.mapInArrow(look, f"id {kind}, key string, places {place_kind}")
    looked = stage(looked.filter(F.size("places") > 0).withColumn("number", F.monotonically_increasing_id()), "places")
    places = looked.select("number", F.inline("places"))

    steps = Steps()
    # Stored, so that the join reads two shuffles of its own and adaptive execution can split bytes that many places share.
    often = places.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select("g")
    often = steps.stage(often, "often")
    candidates = stage(places.join(often, "g").select(places.columns), "candidates")
    around = ["g", "f", "la", "ra"]
    pieces = candidates.groupBy(*around).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("number", "a", "low", "high")).alias("one")
    )
    pieces = steps.stage(pieces, "pieces")
    # Equal surroundings decide each other whole; those seen once need the others of their cells.
    sure = pieces.filter(F.col("n") > 1).select(*around, (side - F.col("ra")).alias("least"), F.col("la").alias("most"))

    def cell(low: int, high: int, stretch: str, fits: Column) -> Column:
        key = F.xxhash64("g", F.lit(low), stretch).alias("cell")
        return F.when(fits, F.struct(key, F.lit(low).alias("low"), F.lit(high).alias("high")))

    near = cell(0, middle, "one.low", core + F.col("ra") >= length + 1 - middle)
    far = cell(middle, half, "one.high", F.col("la") >= middle)
    dealt = pieces.select(*around, "n", "one.number", "one.a", F.inline(F.filter(F.array(near, far), lambda c: c.isNotNull())))
    # Two different surroundings must share a cell, one of them seen once, for anything to be searched there.
    asking = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("n"))
    asking = asking.filter((F.col("rows") > 1) & (F.col("n") == 1)).select("cell")
    members = dealt.join(asking, "cell", "left_semi")
    wanted = members.groupBy("number").agg(F.collect_list(F.struct("a", *around, "n", "cell", "low", "high")).alias("wanted"))
    wanted = looked.select("number", "id", "key").join(wanted, "number").select("id", "key", "wanted")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*around, "n", "cell", "low", "high", "left", "piece"]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for part in chunks(batches, "text", LOOK_BYTES):
            data, offsets = flat(part.column("text"))
            raw, rows = data.tobytes(), []
            for at, list_of in zip(offsets.tolist(), part.column("wanted").to_pylist()):
                for w in list_of:
                    left = min(w["la"], w["high"] - 1)
                    piece = raw[at + w["a"] - left : at + w["a"] + min(core + w["ra"], length - w["low"])]
                    rows.append((w["g"], w["f"], w["la"], w["ra"], w["n"], w["cell"], w["low"], w["high"], left, piece))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    same = F.col("id").eqNullSafe(F.col("wid")) & (F.col("key") == F.col("wkey"))
    renamed = wanted.select(F.col("id").alias("wid"), F.col("key").alias("wkey"), "wanted")
    cells = texts.join(renamed, same).select("text", "wanted").mapInArrow(
        cut, "g long, f long, la int, ra int, n long, cell long, low int, high int, left int, piece binary"
    )

    cells = steps.stage(cells, "cells")
    # Rows that are alone in their cell, or all decided already, ask nothing there.
    counts = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
    counts = counts.filter((F.col("rows") > 1) & (F.col("least") == 1))
    large = steps.stage(counts.filter(F.col("rows") > cell_rows).select("cell"), "large")
    ready = cells.join(large, "cell", "left_anti").join(counts.select("cell"), "cell", "left_semi")
    # Of a cell with too many rows, those with equal bytes under all windows of its places decide each other and
    # go on as one row. What stays too large is split by the longer stretches of each half of its places. The
    # windows of one place are the whole cell, so nothing is left to search there.
    decided = None
    split = cells.join(large, "cell", "left_semi")
    while not large.isEmpty():
        before, after = F.least("la", F.col("high") - 1), F.least(core + F.col("ra"), length - F.col("low"))
        under = F.substring("piece", F.col("left") - before + 1, before + after)
        equal = ["cell", "low", "high", "before", "after", "h", "i"]
        split = split.withColumns(
            {"before": before, "after": after, "h": F.xxhash64(under), "i": F.xxhash64(F.lit(1), under)}
        )
        merged = split.groupBy(*equal).agg(
            F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"), F.first(F.struct(*around, "left", "piece")).alias("one")
        )
        merged = steps.stage(merged, "merged")
        now = split.filter(F.col("n") == 1).join(merged.filter(F.col("rows") > 1).select(*equal), equal, "left_semi")
        now = now.select(
            *around, F.greatest("low", side - F.col("ra")).alias("least"), F.least(F.col("high") - 1, "la").alias("most")
        )
        decided = now if decided is None else decided.unionByName(now)
        cells = merged.select("cell", "low", "high", "one.*", "n")
        counts = cells.filter(F.col("high") - F.col("low") > 1).groupBy("cell")
        counts = counts.agg(F.count(F.lit(1)).alias("rows"), F.min("n").alias("least"))
        counts = counts.filter((F.col("rows") > 1) & (F.col("least") == 1))
        large = steps.stage(counts.filter(F.col("rows") > cell_rows).select("cell"), "large")
        fit = cells.join(large, "cell", "left_anti").join(counts.select("cell"), "cell", "left_semi")
        ready = ready.unionByName(fit)
        between = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = F.explode(
            F.array(F.struct(F.col("low").alias("low"), between.alias("high")), F.struct(between.alias("low"), F.col("high").alias("high")))
        )
        split = cells.join(large, "cell", "left_semi").withColumn("half", halves)
        low, high = F.col("half.low"), F.col("half.high")
        # All windows of places in [low, high) hold the bytes from -low to length + 1 - high.
        holds = (F.col("la") >= low) & (core + F.col("ra") >= length + 1 - high)
        stretch = F.substring("piece", F.col("left") - low + 1, low + length + 1 - high)
        split = split.filter(holds).select(
            F.xxhash64("cell", low, high, stretch).alias("cell"), low.alias("low"), high.alias("high"), *around, "n", "left", "piece"
        )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*around, "least", "most"]

        def answer(rows: pa.Table) -> pa.RecordBatch:
            la, ra, low, high, left = (rows.column(c).to_numpy().astype(np.int64) for c in ("la", "ra", "low", "high", "left"))
            cell = rows.column("cell").to_numpy()
            found = repeated_windows(
                rows.column("piece").to_pylist(), left, np.maximum(low, side - ra), np.minimum(high, la + 1), cell, length
            )
            least, most = found
            use = np.flatnonzero((most >= 0) & (rows.column("n").to_numpy() == 1))
            columns = [rows.column(c).combine_chunks().take(pa.array(use)) for c in around]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(least[use], pa.int32()), pa.array(most[use], pa.int32())], names=names
            )

        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in batches:
            start = 0
            cell = batch.column("cell").to_numpy()
            # Cells come one after the other; a cell is never cut.
            for at in [*(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]:
                if at == start:
                    continue
                own = batch.slice(start, at - start)
                start = at
                if size > BATCH_BYTES and own.column("cell")[0] != last:
                    yield answer(pa.Table.from_batches(held))
                    held, size = [], 0
                last = own.column("cell")[0]
                held.append(own)
                size += own.num_rows * (length + half)
        if held:
            yield answer(pa.Table.from_batches(held))

    # Rows that two equal texts of one id bring twice count once.
    gathered = ready.dropDuplicates(["cell", *around]).repartition("cell").sortWithinPartitions("cell")
    found = gathered.mapInArrow(search, "g long, f long, la int, ra int, least int, most int")
    found = found if decided is None else found.unionByName(decided)
    found = found.groupBy(*around).agg(F.min("least").alias("least"), F.max("most").alias("most"))
    answers = stage(sure.unionByName(found), "answers")
    # Only places, candidates and answers are read from here on.
    steps.remove()

    spans = (
        candidates.join(answers, around)
        .select(
            "number",
            F.struct((F.col("a") - F.col("most")).cast("long").alias("start"), (F.col("a") + length - F.col("least")).cast("long").alias("end")).alias("span"),
        )
        .groupBy("number")
        .agg(_spans(F.sort_array(F.collect_set("span"))).alias("spans"))
    )
    spans = looked.select("number", "id", "key").join(spans, "number").groupBy("id", "key").agg(F.first("spans").alias("spans"))
    spans = spans.select(F.col("id").alias("wid"), F.col("key").alias("wkey"), "spans")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column("text"))
            raw, kept, removed, runs = data.tobytes(), [], [], []
            for a, b, spans in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("spans").to_pylist(), strict=True):
                at, pieces = a, []
                for span in spans or ():
                    pieces.append(raw[at : a + span["start"]])
                    at = a + span["end"]
                pieces.append(raw[at:b])
                kept.append(b"".join(pieces))
                removed.append(b - a - len(kept[-1]))
                runs.append(len(spans or ()))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(np.diff(offsets)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())],
                names=["id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return (
        texts.join(spans, same, "left")
        .select("id", "text", "spans")
        .mapInArrow(drop, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    )
