"""Fill-in-the-middle texts by rotating blocks in place, and the way back.

A text's bytes lie in one buffer with a sentinel before each of its three parts. Two neighbouring blocks
change places by three reversals, without another buffer of the text's size beyond the slice reversed; the
same rotation undoes it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
SEED = 42
FIM_PERCENT, SPM_PERCENT = 50, 80


def unit_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End of each unit (white space and the word after it, or white space that ends a text), and units before each row."""
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    after = np.ones(len(data), bool)
    after[:-1] = blank[1:]
    last = offsets[1:][np.diff(offsets) > 0] - 1
    after[last] = True
    ends = ~blank & after
    ends[last] = True
    places = np.flatnonzero(ends) + 1
    return places, np.searchsorted(places, offsets, side="right")


def rotate(buffer: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange buffer[start:middle] and buffer[middle:end] by three reversals."""
    for a, b in ((start, middle), (middle, end), (start, end)):
        buffer[a:b] = buffer[a:b][::-1]


def rearrange(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text cut at two bytes, with sentinels, its parts in the order of the form."""
    buffer = bytearray(text)
    buffer[second:second] = SUFFIX
    buffer[first:first] = MIDDLE
    buffer[0:0] = PREFIX
    middle, suffix = first + MARK, second + 2 * MARK
    rotate(buffer, middle if form == "psm" else 0, suffix, len(buffer))
    return buffer


def rebuild(output: bytes, form: str) -> bytes:
    """The text from an output and its form alone: the rotation back, then the sentinels out."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    suffix, moved = buffer.index(SUFFIX), buffer.index(MIDDLE if form == "psm" else PREFIX)
    rotate(buffer, suffix, moved, len(buffer))
    for mark in (SUFFIX, MIDDLE, PREFIX):
        at = buffer.index(mark)
        del buffer[at : at + MARK]
    return bytes(buffer)


def draws(id_col: Column, seed: int = SEED) -> list[Column]:
    """Four numbers of 32 bits from the digest of seed and id; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]


def characters(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    new_col: str = "fim",
    keep: tuple[str, ...] | None = None,
    seed: int = SEED,
    fim_percent: int = FIM_PERCENT,
    spm_percent: int = SPM_PERCENT,
) -> DataFrame:
    """All rows and columns of `docs` (or those to `keep`) with `fim` = struct(n, form, prefix_chars, middle_chars, output).

    Cuts stand at unit ends that the id draws. `fim_percent` of the texts are rearranged, of those `spm_percent`
    with the suffix first. Null and empty texts, and texts that hold a sentinel, stay plain, with null lengths;
    a null text gives an empty output. A null id draws as an empty one. Very long texts are handled whole, one
    at a time; equal rows come out equal; an empty table stays empty. Columns of the new name are replaced, others
    pass through whatever their names.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != new_col]
    fields = [("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())]
    fields.append(("output", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column("text"))
            ends, units = unit_ends(data, offsets)
            h = [part.column(f"h{i}").to_numpy() for i in (1, 2, 3, 4)]
            made: dict[str, list] = {name: [] for name, _ in fields}
            for row in range(part.num_rows):
                start, n = offsets[row], int(units[row + 1] - units[row])
                text = data[start : offsets[row + 1]]
                output = text.tobytes()
                form, prefix, middle = "plain", None, None
                if n and h[2][row] % 100 < fim_percent and not any(m in output for m in (PREFIX, SUFFIX, MIDDLE)):
                    form = "spm" if h[3][row] % 100 < spm_percent else "psm"
                    low, high = sorted(int(h[i][row] % (n + 1)) for i in (0, 1))
                    first, second = (int(ends[units[row] + k - 1] - start) if k else 0 for k in (low, high))
                    prefix, middle = characters(text[:first]), characters(text[first:second])
                    output = bytes(rearrange(output, first, second, form))
                for name, value in zip(made, (n, form, prefix, middle, output)):
                    made[name].append(value)
            arrays = [pa.array(made[name], pa.binary() if name == "output" else kind).cast(kind) for name, kind in fields]
            found = pa.StructArray.from_arrays(arrays, names=[name for name, _ in fields])
            yield pa.RecordBatch.from_arrays([part.column("row"), found], names=["row", "found"])

    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    source = docs.select(row, F.col(text_col).alias("text"), *draws(F.col(id_col), seed))
    found = "struct<n:long,form:string,prefix_chars:long,middle_chars:long,output:string>"
    made = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found {found}")
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("found").alias(new_col))


def restore(rows: DataFrame, output_col: str = "output", form_col: str = "form", new_col: str = "restored") -> DataFrame:
    """All rows with the text rebuilt from output and form; a null output is an empty text."""
    names = [c for c in rows.columns if c != new_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            texts, forms = part.column("text").cast(pa.binary()).to_pylist(), part.column("form").to_pylist()
            back = pa.array([rebuild(t or b"", f) for t, f in zip(texts, forms)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([part.column("row"), back], names=["row", "found"])

    row = F.struct(*[F.col(f"`{c}`") for c in names if c != output_col], F.lit(1).alias("_")).alias("row")
    source = rows.select(row, F.col(output_col).alias("text"), F.col(form_col).alias("form"))
    made = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found string")
    return made.select(*[F.col("row").getField(c).alias(c) for c in names if c != output_col], F.col("found").alias(new_col))
