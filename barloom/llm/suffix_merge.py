"""Burrows-Wheeler transforms of shards of strings, merged by refining their interleave.

Strings are sequences of phrases cut by their content, so one symbol stands for several bytes and a
few rounds of refinement cover the whole length that matters.
"""

from __future__ import annotations

import numpy as np

BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
PHRASE_GRAM = 8
PHRASE_MASK = 63


class Hashes:
    """Hashes of any stretch of a byte array, from running sums modulo 2^64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, data: np.ndarray, which: int = 0):
        n = len(data)
        self.up, self.down = self.powers(n + 1, which)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=self.sums[1:])

    @classmethod
    def powers(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        if which not in cls._powers or len(cls._powers[which][0]) < n:
            size = max(n, 1 << 21) + 1
            base = BASES[which]
            pair = [base, pow(base, -1, 1 << 64)]
            cls._powers[which] = tuple(
                np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in pair
            )
        return cls._powers[which]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def phrase_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of all phrases: the strings' starts, and places after bytes whose hash asks for it."""
    n = len(data)
    cut = np.zeros(n + 1, bool)
    if n >= PHRASE_GRAM:
        at = np.arange(n - PHRASE_GRAM + 1)
        asks = Hashes(data).of(at, at + PHRASE_GRAM) & np.uint64(PHRASE_MASK) == 0
        # A gram over the border of two strings says nothing.
        own = np.searchsorted(offsets, at, side="right") == np.searchsorted(offsets, at + PHRASE_GRAM - 1, side="right")
        cut[at[asks & own] + PHRASE_GRAM] = True
    cut[offsets] = True
    cut[n] = False
    return np.flatnonzero(cut)


def suffix_order(symbols: np.ndarray, string: np.ndarray) -> np.ndarray:
    """Suffix array of the strings of one shard, each ended by symbol 0, by doubling of ranks."""
    n = len(symbols)
    ends = symbols == 0
    # Ends sort by their string, before everything else.
    rank = np.where(ends, string, symbols + string.max() + 1).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1]
    step = 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1
        order = np.lexsort((after, rank))
        differs = np.ones(n, bool)
        differs[1:] = (rank[order][1:] != rank[order][:-1]) | (after[order][1:] != after[order][:-1])
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(differs) - 1
        if differs.all() or step >= n:
            return order
        rank, step = new, step * 2


def merge_transforms(transforms: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of the shards (a shard number for each merged place) and common prefixes in symbols.

    Round h orders all suffixes by their first h symbols: the merged transform under the last interleave
    is dealt into buckets by symbol, in order. A border that first shows in round h means a common
    prefix of h - 1. The rounds end when nothing changes any more, or after `most` of them.
    """
    sizes = [len(t) for t in transforms]
    whole = np.concatenate(transforms)
    n = len(whole)
    # Numbers of 16 bits are dealt in linear time.
    whole = whole.astype(np.min_scalar_type(whole.max()))
    shards = np.arange(len(transforms), dtype=np.min_scalar_type(len(transforms)))
    z = np.repeat(shards, sizes)
    ends = np.repeat(shards, [int((t == 0).sum()) for t in transforms])
    common = np.full(n, most, np.int64)
    block = np.zeros(n, np.int64)
    for h in range(1, most + 1):
        places = np.argsort(z, kind="stable")
        merged = np.empty(n, whole.dtype)
        merged[places] = whole
        order = np.argsort(merged, kind="stable")
        new = z[order]
        new[: len(ends)] = ends
        symbol, before = merged[order], block[order]
        border = np.ones(n, bool)
        border[1:] = (symbol[1:] != symbol[:-1]) | (before[1:] != before[:-1])
        border[: len(ends) + 1] = True
        fresh = border & (common == most)
        common[fresh] = h - 1
        same = not fresh.any() and (new == z).all()
        z, block = new, np.cumsum(common < most)
        if same:
            break
    return z, common


def repeated_windows(
    fragments: list[bytes], first: np.ndarray, low: np.ndarray, high: np.ndarray, group: np.ndarray, length: int, shard: int = 512
) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest place in [low, high) of each fragment where another one of its group holds the same window.

    Place p is the window that starts at byte `first - p` of the fragment. Fragments without such a
    place have -1 as the greatest.
    """
    sizes = np.fromiter(map(len, fragments), np.int64, len(fragments))
    offsets = np.concatenate(([0], np.cumsum(sizes)))
    data = np.frombuffer(b"".join(fragments), np.uint8)
    hashes = Hashes(data, 1)
    cuts = phrase_cuts(data, offsets)
    owner = np.searchsorted(offsets, cuts, side="right") - 1
    stops = np.append(cuts[1:], len(data))
    names = np.unique(hashes.of(cuts, stops) ^ (stops - cuts).astype(np.uint64), return_inverse=True)[1] + 1
    count = np.bincount(owner, minlength=len(fragments))
    # Symbols with an end after each string.
    place = np.arange(len(cuts)) + owner
    symbols = np.zeros(len(cuts) + len(fragments), np.int64)
    symbols[place] = names
    begins = np.concatenate(([0], np.cumsum(count + 1)))
    string = np.repeat(np.arange(len(fragments)), count + 1)

    orders, transforms = [], []
    for k in range(0, len(fragments), shard):
        a, b = begins[k], begins[min(k + shard, len(fragments))]
        own = suffix_order(symbols[a:b], string[a:b] - k)
        starts_here = np.isin(own + a, begins)
        transforms.append(np.where(starts_here, 0, symbols[a:b][own - 1]))
        orders.append(own + a)
    z, common = merge_transforms(transforms, int(count.max()) + 2)
    merged = np.empty(len(symbols), np.int64)
    merged[np.argsort(z, kind="stable")] = np.concatenate(orders)
    rank = np.empty(len(symbols), np.int64)
    rank[merged] = np.arange(len(symbols))

    # Keys of windows: the block of the whole phrases inside, at their depth, and what stands before and after
    # them. Only cuts that bytes inside the window alone decide count, so equal windows have equal phrases.
    n = np.maximum(high - low, 0)
    keys = []
    for k in range(0, len(fragments), shard):
        some = slice(k, k + shard)
        frag = np.repeat(np.arange(len(fragments))[some], n[some])
        where = _places(low[some], n[some])
        start = offsets[frag] + first[frag] - where
        end = start + length
        inner = np.searchsorted(cuts, start + PHRASE_GRAM)
        outer = np.searchsorted(cuts, end - 1, side="right") - 1
        none = outer < inner
        left_end = np.where(none, end, cuts[np.minimum(inner, len(cuts) - 1)])
        right_start = np.where(none, end, cuts[outer])
        phrases = np.where(none, 0, outer - inner)
        at = rank[place[np.minimum(inner, len(cuts) - 1)]]
        key = mix(group[frag].astype(np.uint64)) ^ mix((where + 1).astype(np.uint64))
        for part in (
            _blocks(common, at, phrases), phrases, left_end - start, hashes.of(start, left_end), hashes.of(right_start, end),
        ):
            key = mix(key * np.uint64(0x94D049BB133111EB) + part.astype(np.uint64))
        keys.append(key)
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    frag, where = np.repeat(np.arange(len(fragments)), n)[twice], _places(low, n)[twice]
    least, most = np.full(len(fragments), length), np.full(len(fragments), -1)
    np.minimum.at(least, frag, where)
    np.maximum.at(most, frag, where)
    return least, most


def _places(low: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _blocks(common: np.ndarray, rank: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first merged place whose suffix shares `depth` symbols with the one at `rank`, and all between do.

    Found by doubling over minima of common prefixes, so the cost is by windows and not by depths.
    """
    levels = [common]
    while 2 ** len(levels) <= len(common):
        low, step = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(low, np.concatenate((np.full(step, -1), low[:-step]))))
    at = rank.copy()
    for k in range(len(levels) - 1, -1, -1):
        goes = levels[k][at] >= depth
        at[goes] -= 2**k
    return np.where(depth > 0, at, 0)
