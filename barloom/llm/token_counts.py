"""Token counts by byte-pair merging over a heap and a linked list, without token ids."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat
from barloom.llm.pretokens import SPECIAL, token_lists

LIMIT = 1024
CACHE_WORDS = 400_000


def byte_symbols() -> list[str]:
    """The vocabulary's letter for each byte: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b if b in set(plain) else next(others)) for b in range(256)]


class Merges:
    """Ranks of adjacent pairs, and counts of words seen before in this worker."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        model = json.load(open(path, encoding="utf-8"))["model"]
        number: dict[str, int] = {}

        def symbol(name: str) -> int:
            return number.setdefault(name, len(number))

        self.bytes = [symbol(x) for x in byte_symbols()]
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((symbol(left), symbol(right)), (rank, symbol(left + right)))
        self.seen: dict[bytes, int] = {SPECIAL: 1}
        self.cache_words = cache_words

    def merged(self, word: bytes) -> int:
        """Initial symbols minus merges: the lowest-ranked pair goes first, the leftmost of equals."""
        symbols = [self.bytes[b] for b in word]
        size = count = len(symbols)
        if size < 2:
            return size
        pairs = self.pairs
        heap = []
        for i in range(size - 1):
            if found := pairs.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        while heap:
            _, i, left, right, joined = heapq.heappop(heap)
            j = after[i]
            # An entry is stale once either of its symbols has gone into another merge.
            if symbols[i] != left or j >= size or symbols[j] != right:
                continue
            symbols[i], symbols[j] = joined, -1
            count -= 1
            k = after[i] = after[j]
            if k < size:
                before[k] = i
                if found := pairs.get((joined, symbols[k])):
                    heapq.heappush(heap, (found[0], i, joined, symbols[k], found[1]))
            h = before[i]
            if h >= 0 and (found := pairs.get((symbols[h], joined))):
                heapq.heappush(heap, (found[0], h, symbols[h], joined, found[1]))
        return count

    def count(self, words: list[bytes]) -> int:
        seen = self.seen
        try:
            return sum(map(seen.__getitem__, words))
        except KeyError:
            pass
        if len(seen) > self.cache_words:
            seen.clear()
            seen[SPECIAL] = 1
        for word in set(words):
            if word not in seen:
                seen[word] = self.merged(word)
        return sum(map(seen.__getitem__, words))


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


def count_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """`id, n_bytes, n_tokens, over_limit` of every row, in one pass without a shuffle.

    Counts are those of the tokenizer file's own library; the special string is one token. Null and
    empty texts have 0. Texts of any length are counted whole; repeated rows are each counted.
    The words that a worker remembers are bounded. Null ids pass through, other columns are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(path)
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column("text"))
            tokens = np.zeros(part.num_rows, np.int64)
            for row, words in token_lists(data, offsets):
                tokens[row] = model.count(words)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), pa.array(size), pa.array(tokens), pa.array(tokens > limit)],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )
