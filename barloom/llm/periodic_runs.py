"""Runs of repeated words, found by string synchronising sets.

A run is a stretch with smallest period q that no neighbour extends, at least three periods long. Periods below
`FIRST_SCALE` are found directly, by comparing words q apart. For larger ones there is a scale t = 8, 16, 32, ...
with t <= q < 2t. At a scale a place is selected if the hash of its t words is the least of some t neighbouring
places (the first of equals). That depends on the words alone, so a run with a period of the scale has a selected
place and another one q later, of equal words. Places whose t words have a period of at most t/3 take no part:
they lie in runs found at smaller scales, which are known by then. So selected places of equal words are more
than t/3 apart and each has at most five partners. Pairs propose periods; hashes extend them, and the words
themselves decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat

MIN_LENGTH = 24
PERIODS = 3
FIRST_SCALE = 8
PRIMES = (2**31 - 1, 2**31 - 19)
BASES = (1_103_515_245, 1_566_083_941)
LAST = np.uint64(2**64 - 1)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit hash for two in order."""
    h = (left ^ (left >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + right
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def window_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Least key of each `width` places from a place on: by blocks, from both ends of each."""
    n = len(keys)
    blocks = -(-n // width) + 1
    full = np.full(blocks * width, LAST)
    full[:n] = keys
    full = full.reshape(blocks, width)
    ahead = np.minimum.accumulate(full, axis=1).reshape(-1)
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Extender:
    """Lengths of agreement between two places, by prefix hashes under two primes and halving."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.sums, self.powers = [], []
        for prime, base in zip(PRIMES, BASES):
            power = np.ones(len(words) + 1, np.int64)
            done = 1
            step = base
            while done < len(power):
                more = min(done, len(power) - done)
                power[done : done + more] = power[:more] * step % prime
                done += more
                step = step * step % prime
            total = np.zeros(len(words) + 1, np.int64)
            total[1:] = np.cumsum(words % prime * power[:-1] % prime) % prime
            self.sums.append(total)
            self.powers.append(power)

    def equal(self, at: np.ndarray, size: np.ndarray, apart: np.ndarray) -> np.ndarray:
        same = np.ones(len(at), bool)
        for prime, total, power in zip(PRIMES, self.sums, self.powers):
            first = (total[at + size] - total[at]) % prime
            second = (total[at + apart + size] - total[at + apart]) % prime
            same &= first * power[apart] % prime == second
        return same

    def longest(self, at: np.ndarray, apart: np.ndarray, most: np.ndarray, left: bool) -> np.ndarray:
        """Greatest size up to `most` so that the words from `at` (or before it) agree with those `apart` later."""
        low, high = np.zeros(len(at), np.int64), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            same = self.equal(at - middle if left else at, middle, apart)
            low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
        return low

    def stretches(self, at: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal [start, end) with period `apart` around each place."""
        n = len(self.words)
        right = self.longest(at, apart, n - apart - at, False)
        left = self.longest(at, apart, at, True)
        return at - left, at + apart + right


def exact_stretch(words: np.ndarray, start: int, end: int, q: int) -> tuple[int, int]:
    """The stretch of period q around `start`, by the words alone; for what a hash got wrong."""
    wrong = np.flatnonzero(words[start : end - q] != words[start + q : end])
    return start, int(start + wrong[0] + q) if len(wrong) else end


def small_periods(words: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """`starts, ends, period` of the maximal stretches of each period below `FIRST_SCALE`, at least `least` long."""
    found = []
    for q in range(1, min(FIRST_SCALE, len(words))):
        edge = np.diff(np.concatenate(([False], words[:-q] == words[q:], [False])).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + q
        long = ends - starts >= max(PERIODS * q, least)
        found.append((starts[long], ends[long], q))
    return found


def runs(words: np.ndarray, sizes: np.ndarray, min_length: int = MIN_LENGTH) -> np.ndarray:
    """Rows `start, end, period` of all runs, by start and period, in texts put one after the other.

    Each text of `sizes` words ends with one more, a word that stands nowhere else, so nothing goes over an edge.
    """
    kept: list[np.ndarray] = []

    def add(starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> None:
        kept.append(np.stack([starts, ends, periods], 1).astype(np.int64))

    # A place is known to be periodic from its whole stretch, so stretches of a scale's length count here as well.
    for starts, ends, q in small_periods(words, FIRST_SCALE):
        add(starts, ends, np.full(len(starts), q))
    whole = sizes + 1
    ends_of = np.cumsum(whole)
    longest = int(sizes.max(initial=0))
    scale = FIRST_SCALE
    if PERIODS * scale > longest:
        return finished(kept, min_length)
    extender = Extender(words)
    place = np.arange(len(words), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), whole)
    hashes = mixed(words.astype(np.uint64) + np.uint64(1), np.full(len(words), 7, np.uint64))
    width = 1
    while PERIODS * scale <= longest:
        # Only texts that can hold three periods of the scale go on.
        fit = sizes[row] >= PERIODS * scale
        while width < scale:
            hashes = mixed(hashes, np.concatenate((hashes[width:], np.zeros(min(width, len(hashes)), np.uint64)))[: len(hashes)])
            width *= 2
        if not fit.all():
            place, row, hashes = place[fit], row[fit], hashes[fit]
        at, ids = selected(place, row, hashes, scale, ends_of, kept)
        if len(at) > 1:
            first, apart = proposals(at, ids, scale)
            if len(first):
                starts, ends = extender.stretches(first, apart)
                long = ends - starts >= PERIODS * apart
                add(*verified(words, starts[long], ends[long], apart[long]))
        scale *= 2
    return finished(kept, min_length)


def selected(
    place: np.ndarray, row: np.ndarray, hashes: np.ndarray, scale: int, ends_of: np.ndarray, kept: list[np.ndarray]
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the synchronising set of a scale, and the hashes of their words."""
    inside = place + scale < ends_of[row]
    periodic = np.zeros(len(place) + 1, np.int64)
    for found in kept:
        starts, ends, q = found[:, 0], found[:, 1], found[:, 2]
        wide = (PERIODS * q <= scale) & (ends - starts >= scale)
        np.add.at(periodic, np.searchsorted(place, starts[wide]), 1)
        np.add.at(periodic, np.searchsorted(place, ends[wide] - scale + 1), -1)
    usable = inside & (np.cumsum(periodic)[:-1] == 0)
    # Upper bits of the hash, then the place: the least is the first of equals.
    bits = np.uint64(max(1, len(place)).bit_length())
    number = np.arange(len(place), dtype=np.uint64)
    keys = np.where(usable, (hashes >> bits << bits) | number, LAST)
    least = window_least(keys, scale)
    least = least[least != LAST]
    chosen = np.unique(least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return place[chosen], hashes[chosen]


def proposals(at: np.ndarray, ids: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of selected places of equal words whose distance is a period of the scale: first place and distance."""
    order = np.lexsort((at, ids))
    at, ids = at[order], ids[order]
    first, apart = [], []
    for step in range(1, len(at)):
        gap = at[step:] - at[:-step]
        near = (ids[step:] == ids[:-step]) & (gap < 2 * scale)
        if not near.any():
            break
        take = near & (gap >= scale)
        first.append(at[:-step][take])
        apart.append(gap[take])
    if not first:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(first), np.concatenate(apart)


def verified(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, periods: np.ndarray) -> tuple[np.ndarray, ...]:
    """The stretches once each, every word compared."""
    found = np.unique(np.stack([starts, ends, periods], 1), axis=0) if len(starts) else np.zeros((0, 3), np.int64)
    out = []
    for start, end, q in found.tolist():
        start, end = exact_stretch(words, start, end, q)
        if end - start >= PERIODS * q:
            out.append((start, end, q))
    made = np.array(out, np.int64).reshape(-1, 3)
    return made[:, 0], made[:, 1], made[:, 2]


def finished(kept: list[np.ndarray], min_length: int) -> np.ndarray:
    """Stretches that are long enough, each with its smallest period.

    A stretch of three periods that also has a smaller one was found with that, with the same ends.
    """
    found = np.concatenate(kept) if kept else np.zeros((0, 3), np.int64)
    found = found[found[:, 1] - found[:, 0] >= np.maximum(min_length, PERIODS * found[:, 2])]
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    again = np.zeros(len(found), bool)
    again[1:] = (found[1:, 0] == found[:-1, 0]) & (found[1:, 1] == found[:-1, 1])
    found = found[~again]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def greatest(found: list[tuple[int, int, int]]) -> int | None:
    """Number of the run with the greatest exact exponent; of equals the first start, then the smallest period."""
    if not found:
        return None
    return max(range(len(found)), key=lambda i: (Fraction(found[i][1], found[i][2]), -found[i][0], -found[i][2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """Words outside the runs and in the first period of each, joined by one space."""
    if not found:
        return b" ".join(words)
    cover = np.zeros(len(words) + 1, np.int64)
    for start, length, q in found:
        cover[start + q] += 1
        cover[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(cover)[:-1] == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def runs_of_texts(texts: list[bytes], min_length: int = MIN_LENGTH) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words, and runs as (start, length, period), of each text."""
    split = [t.split() for t in texts]
    long = [i for i, words in enumerate(split) if len(words) >= max(min_length, PERIODS)]
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    if long:
        number: dict[bytes, int] = {}
        sizes = np.array([len(split[i]) for i in long], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))
        ids = np.empty(starts[-1], np.int64)
        for k, i in enumerate(long):
            ids[starts[k] : starts[k + 1] - 1] = [number.setdefault(w, len(number)) for w in split[i]]
        ids[starts[1:] - 1] = len(number) + np.arange(len(long))
        every = runs(ids, sizes, min_length)
        owner = np.searchsorted(starts, every[:, 0], side="right") - 1
        for k, (start, end, q) in zip(owner.tolist(), every.tolist()):
            found[long[k]].append((start - int(starts[k]), end - start, q))
    return list(zip(split, found))


def periodic_runs(
    docs: DataFrame,
    text_col: str = "text",
    new_col: str = "periodic",
    keep: tuple[str, ...] | None = None,
    min_length: int = MIN_LENGTH,
) -> DataFrame:
    """All rows and columns of `docs` (or those to `keep`) with `periodic` = struct(n, runs, best, collapsed), in one pass.

    `n` counts words between white space. `runs` lists struct(start, length, period), by start, then period;
    `best` is the one with the greatest length by period (ties: first start, then smallest period), null without
    runs; `collapsed` is the text without the words that a run repeats, joined by one space. Null and empty
    texts, and texts without words, have no runs and an empty `collapsed`. Long texts are handled whole, one at a
    time, in memory proportional to their words. Repeated rows agree; an empty table stays empty. Columns of the new
    name are replaced, others pass through whatever their names.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c != new_col]
    run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    kind = pa.struct(
        [("n", pa.int64()), ("runs", pa.list_(run_kind)), ("best", run_kind), ("collapsed", pa.string())]
    )

    def struct(found: tuple[int, int, int]) -> dict:
        return dict(zip(("start", "length", "period"), found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column("text"))
            texts = [data[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            made = []
            for words, found in runs_of_texts(texts, min_length):
                best = greatest(found)
                made.append(
                    {
                        "n": len(words),
                        "runs": [struct(x) for x in found],
                        "best": None if best is None else struct(found[best]),
                        "collapsed": collapsed(words, found).decode(),
                    }
                )
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(made, kind)], names=["row", "found"])

    one = "struct<start:long,length:long,period:long>"
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    source = docs.select(row, F.col(text_col).alias("text"))
    found = f"struct<n:long,runs:array<{one}>,best:{one},collapsed:string>"
    made = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found {found}")
    return made.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("found").alias(new_col))
