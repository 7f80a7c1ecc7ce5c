"""Packing of token streams into windows of one size, online and in bounded space.

Each partition keeps a fixed number of open windows. A document fills whole windows first; its rest
goes into the open window that it fits best. When none fits, the fullest window is topped up from the
rest and leaves full. What is open at the end of all partitions is merged in groups of partitions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat, keeps
from barloom.llm.pretokens import token_lists
from barloom.sources.stage import stage

WINDOW = 1024
OPEN_WINDOWS = 64
MERGE_PARTITIONS = 64
CACHE_WORDS = 500_000
JOINED_WORDS = 256
SHORT_BYTES = 8
PLAIN = re.compile(rb" [a-zA-Z\x80-\xbf\xc3-\xc8]+\Z")
END_ID = 0
SEQUENCES = 1 << 32


class Encoder:
    """Ids of texts by the tokenizers library; ids of frequent words are remembered in bounded space."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.seen: dict[bytes, bytes] = {}
        self.cache_words = cache_words

    def learn(self, words: list[bytes]) -> None:
        """Words that start with a blank stay pre-tokens of their own in one text, so many are asked for at once."""
        joined = [w for w in words if PLAIN.match(w)]
        texts = [joined[k : k + JOINED_WORDS] for k in range(0, len(joined), JOINED_WORDS)]
        for own, found in zip(texts, self.model.encode_batch([b"".join(t).decode() for t in texts], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4").tobytes()
            ends = (np.cumsum(np.bincount(np.array(found.word_ids))) * 4).tolist()
            at = 0
            for word, end in zip(own, ends, strict=True):
                self.seen[word] = ids[at:end]
                at = end
        others = [w for w in words if not PLAIN.match(w)]
        encoded = self.model.encode_batch_fast([w.decode(errors="replace") for w in others], add_special_tokens=False)
        for word, found in zip(others, encoded, strict=True):
            self.seen[word] = np.array(found.ids, "<u4").tobytes()

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids, as little-endian 32-bit numbers, of texts given as their pre-tokens."""
        if len(self.seen) > self.cache_words:
            # Short words are the frequent ones.
            self.seen = {k: v for k, v in self.seen.items() if len(k) <= SHORT_BYTES}
            if len(self.seen) > self.cache_words // 2:
                self.seen.clear()
        flat_words = list(chain.from_iterable(texts))
        found = list(map(self.seen.get, flat_words))
        missing = [i for i, ids in enumerate(found) if ids is None]
        new = list(dict.fromkeys(flat_words[i] for i in missing))
        for k in range(0, len(new), 16384):
            self.learn(new[k : k + 16384])
        for i in missing:
            found[i] = self.seen[flat_words[i]]
        ends = [0, *accumulate(map(len, texts))]
        return [b"".join(found[a:b]) for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


keeps("packing", encoder.cache_clear)


@dataclass
class Window:
    number: int
    fill: int = 0
    pieces: list = field(default_factory=list)

    def put(self, doc, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((doc, start, ids, total, self.number, self.fill))
        self.fill += len(ids) // 4


class Packer:
    """Open windows ordered by fill; `add` returns the windows that leave."""

    def __init__(self, first: int, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.next, self.size, self.most = first, window, open_windows
        self.open: list[tuple[int, int, Window]] = []

    def fresh(self) -> Window:
        self.next += 1
        return Window(self.next - 1)

    def add(self, doc, ids: bytes, total: int, start: int = 0, whole: bool = True) -> Iterator[Window]:
        n, at = len(ids) // 4, 0
        while whole and n - at >= self.size:
            full = self.fresh()
            full.put(doc, start + at, ids[4 * at : 4 * (at + self.size)], total)
            at += self.size
            yield full
        while at < n:
            rest = n - at
            # The fullest window with room for all of it is the best fit.
            k = bisect_left(self.open, (self.size - rest + 1,)) - 1
            if k >= 0:
                _, _, window = self.open.pop(k)
            elif len(self.open) < self.most:
                window = self.fresh()
            else:
                _, _, window = self.open.pop()
            take = min(rest, self.size - window.fill)
            window.put(doc, start + at, ids[4 * at : 4 * (at + take)], total)
            at += take
            if window.fill == self.size:
                yield window
            else:
                insort(self.open, (window.fill, window.number, window))

    def close(self) -> list[Window]:
        out, self.open = [w for _, _, w in self.open], []
        return out


PIECE = "id {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"


def _batch(windows: list[tuple[Window, bool]], kind: pa.DataType) -> pa.RecordBatch:
    rows = [(*piece, still) for window, still in windows for piece in window.pieces]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
    types = [kind, pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    names = ["id", "start", "ids", "doc_tokens", "sequence_id", "offset", "open"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def _emit(windows: Iterator[tuple[Window, bool]], kind: pa.DataType, rows: int = 2048) -> Iterator[pa.RecordBatch]:
    held: list[tuple[Window, bool]] = []
    for x in windows:
        held.append(x)
        if len(held) >= rows:
            yield _batch(held, kind)
            held = []
    yield _batch(held, kind)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
    keep_ids: bool = True,
) -> DataFrame:
    """Pieces `id, start, length, ids_crc32, doc_tokens, sequence_id, offset`, and `ids` if kept.

    A text's ids are followed by one end id; every id lies in one piece, and a sequence's pieces
    follow each other from offset 0. Null and empty texts are the end id alone, and so are packed
    too. Repeated rows are packed each. Texts longer than the window fill whole windows. Ties between
    open windows of one fill go to the newest. Partitions never wait for each other: a
    partition leaves at most `open_windows` open, and groups of 64 partitions merge theirs, so that
    only one window of a group stays partly filled. An empty table gives no pieces. Null ids pass through.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([END_ID], "<u4").tobytes()

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Window, bool]]:
        packer = Packer(TaskContext.get().partitionId() * SEQUENCES, window, open_windows)
        model = encoder(path)
        for part in chunks(batches, "text"):
            texts = [words for _, words in token_lists(*flat(part.column("text")))]
            for doc, ids in zip(part.column("id").to_pylist(), model.encode(texts), strict=True):
                ids += end
                for done in packer.add(doc, ids, len(ids) // 4):
                    yield done, False
        for left in packer.close():
            yield left, True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        id_type = first.schema.field("id").type

        def rest():
            yield first
            yield from batches

        yield from _emit(windows(rest()), id_type)

    def merge(group: pa.Table) -> pa.Table:
        """Open windows of some partitions: whole windows first by best fit, what is then open is run together."""
        id_type = group.schema.field("id").type
        number = -1 - group.column("group")[0].as_py()
        packer = Packer(number * SEQUENCES, window, open_windows)
        rows = group.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        done: list[Window] = []
        for r in rows:
            done += packer.add(r["id"], r["ids"], r["doc_tokens"], r["start"])
        last = Packer(packer.next, window, 1)
        for left in packer.close():
            for doc, start, ids, total, _, _ in left.pieces:
                done += last.add(doc, ids, total, start, whole=False)
        done += last.close()
        return pa.Table.from_batches([_batch([(w, False) for w in done], id_type)])

    pieces = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, PIECE.format(kind=kind)
    )
    # Ids of finished pieces go no further than their digest unless they are asked for.
    sized = pieces.select(
        "id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "open",
        F.when(F.lit(True) if keep_ids else F.col("open"), F.col("ids")).alias("ids"),
    )
    written = stage(sized, "pieces")
    closed = written.filter(~F.col("open"))
    left = written.filter("open").withColumn("group", F.floor(F.col("sequence_id") / (SEQUENCES * MERGE_PARTITIONS)))
    merged = left.select("group", "id", "start", "ids", "doc_tokens", "sequence_id", "offset").groupBy("group")
    merged = merged.applyInArrow(merge, PIECE.format(kind=kind)).select(
        "id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"),
        "doc_tokens", "sequence_id", "offset", "open", "ids",
    )
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return closed.select(*names).unionByName(merged.select(*names))
