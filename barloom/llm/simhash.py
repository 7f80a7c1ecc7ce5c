"""SimHash fingerprints, linked within a Hamming distance by vantage-point trees.

A tree over a bounded sample cuts the fingerprints into shards. A fingerprint lives in one shard
and is a query in every shard that its ball reaches over a boundary; inside a shard the same
recursion goes on, pruned by the triangle inequality, down to small blocks compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks, flat, text_key
from barloom.llm.components import components
from barloom.sources.stage import stage

SHINGLE = 3
MAX_BITS = 2
SEED = 42
SHARD_ROWS = 4096
SAMPLE_ROWS = 1 << 16
BLOCK_ROWS = 256


def _sums_of_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprint_texts(texts: list[bytes], shingle: int) -> np.ndarray:
    """Bit sums over each text's shingles, then the majority of each bit; no words give 0."""
    out = np.zeros(len(texts), np.uint64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        words = text.lower().split()
        if not words:
            continue
        joined = b" ".join(words)
        if len(words) <= shingle:
            out[i] = digest(joined, SEED)
            continue
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        first = np.concatenate(([0], ends[: -shingle]))
        last = ends[shingle - 1 :] - 1
        n, sums = len(first), np.zeros(64, np.int64)
        hashes = np.fromiter(
            (digest(joined[a:b], SEED) for a, b in zip(first.tolist(), last.tolist(), strict=True)), np.uint64, n
        )
        for k in range(0, n, 1 << 16):
            sums += _sums_of_bits(hashes[k : k + (1 << 16)], np.zeros(1, np.int64))[0]
        out[i] = np.packbits(2 * sums > n).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """`id, key, fp` (64 bits as a signed long; the text's key) of every row; null and blank texts have 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            data, offsets = flat(part.column("text"))
            raw, at = data.tobytes(), offsets.tolist()
            found = fingerprint_texts([raw[a:b] for a, b in zip(at, at[1:])], shingle)
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("key"), pa.array(found.view(np.int64))], names=["id", "key", "fp"])

    source = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {kind}, key string, fp long")


# A node is (vantage, radius, inner, outer), a leaf its number. Distances up to the radius are inner.


def build_tree(sample: np.ndarray, leaf_rows: int, first: int = 0):
    """The tree and the number of leaves; vantage points are taken from the sample in a fixed way."""
    rng = np.random.default_rng(8)

    def grow(rows: np.ndarray, number: int):
        if len(rows) > leaf_rows:
            for vantage in rows[rng.permutation(len(rows))[:8]]:
                distance = np.bitwise_count(rows ^ vantage)
                radius = int(np.sort(distance)[(len(rows) - 1) // 2])
                inner = distance <= radius
                if not inner.all():
                    left, number = grow(rows[inner], number)
                    right, number = grow(rows[~inner], number)
                    return (np.uint64(vantage), radius, left, right), number
                if radius > 0 and (distance < radius).any():
                    inner = distance < radius
                    left, number = grow(rows[inner], number)
                    right, number = grow(rows[~inner], number)
                    return (np.uint64(vantage), radius - 1, left, right), number
        return number, number + 1

    return grow(np.unique(sample), first)


def route(tree, fps: np.ndarray, reach: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """Shard, indexes into fps, and whether they are only queries there.

    Of two close fingerprints on both sides of a boundary the inner one asks in the outer shard, so
    members send queries outward only. A query goes to every side within its reach.
    """
    work = [(tree, np.arange(len(fps)), np.zeros(0, np.int64))]
    while work:
        node, members, asking = work.pop()
        if not len(members) and not len(asking):
            continue
        if not isinstance(node, tuple):
            if len(members):
                yield node, members, False
            if len(asking):
                yield node, asking, True
            continue
        vantage, radius, inner, outer = node
        d = np.bitwise_count(fps[members] ^ vantage).astype(np.int64)
        q = np.bitwise_count(fps[asking] ^ vantage).astype(np.int64)
        near = d <= radius
        work.append((inner, members[near], asking[q <= radius + reach]))
        over = members[near & (d + reach > radius)]
        work.append((outer, members[~near], np.concatenate((asking[q + reach > radius], over))))


def close_pairs(members: np.ndarray, asking: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of values within reach, member with member and query with member, block by block."""
    tree, leaves = build_tree(members, BLOCK_ROWS)
    everything = np.concatenate((members, asking))
    home: dict[int, list[np.ndarray]] = {}
    ask: dict[int, list[np.ndarray]] = {}
    work = [(tree, np.arange(len(members)), np.arange(len(members), len(everything)))]
    while work:
        node, inside, queries = work.pop()
        if not len(inside):
            continue
        if not isinstance(node, tuple):
            home.setdefault(node, []).append(inside)
            ask.setdefault(node, []).append(queries)
            continue
        vantage, radius, inner, outer = node
        d = np.bitwise_count(everything[inside] ^ vantage).astype(np.int64)
        q = np.bitwise_count(everything[queries] ^ vantage).astype(np.int64)
        near = d <= radius
        work.append((inner, inside[near], queries[q <= radius + reach]))
        over = inside[near & (d + reach > radius)]
        work.append((outer, inside[~near], np.concatenate((queries[q + reach > radius], over))))
    for leaf, parts in home.items():
        inside = everything[np.concatenate(parts)]
        queries = np.concatenate((inside, everything[np.concatenate(ask[leaf])]))
        for k in range(0, len(queries), 1024):
            a, b = np.nonzero(np.bitwise_count(queries[k : k + 1024, None] ^ inside[None, :]) <= reach)
            left, right = queries[k + a], inside[b]
            apart = left != right
            if apart.any():
                yield left[apart], right[apart]


def _smallest(values: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Index of the smallest value reachable from each of the sorted values."""
    label = np.arange(len(values))
    a = np.searchsorted(values, np.concatenate([p[0] for p in pairs]))
    b = np.searchsorted(values, np.concatenate([p[1] for p in pairs]))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def shard_links(members: np.ndarray, asking: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Each linked value with the smallest value that it reaches inside the shard: a star for each group.

    Pairs are folded into the stars as they come, so a dense group never stands there as all its pairs.
    """
    left, right = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def fold() -> None:
        nonlocal left, right, held, size
        if held:
            held.append((left, right))
            values = np.unique(np.concatenate([x for pair in held for x in pair]))
            label = _smallest(values, held)
            apart = label != np.arange(len(values))
            left, right, held, size = values[apart], values[label[apart]], [], 0

    for pair in close_pairs(members, asking, reach):
        held.append(pair)
        size += len(pair[0])
        if size > 1_000_000:
            fold()
    fold()
    return left, right


def link_fingerprints(distinct: DataFrame, reach: int = MAX_BITS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links `a, b` that connect the distinct fingerprints `fp` exactly as all pairs within reach do."""
    rows = distinct.count()
    leaves = max(1, -(-rows // shard_rows))
    wanted = min(SAMPLE_ROWS, max(64, leaves * 32))
    picked = [r[0] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(wanted).collect()]
    sample = np.array(picked, np.int64).view(np.uint64)
    tree, _ = build_tree(sample, max(1, -(-len(sample) // leaves)))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for leaf, at, query in route(tree, fps, reach):
                n = len(at)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, leaf, np.int32)), pa.array(fps[at].view(np.int64)), pa.array(np.full(n, query))],
                    names=["leaf", "fp", "query"],
                )

    def links(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        query = group.column("query").to_numpy(zero_copy_only=False)
        a, b = shard_links(fps[~query], fps[query], reach)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    routed = distinct.select("fp").mapInArrow(shards, "leaf int, fp long, query boolean")
    return routed.groupBy("leaf").applyInArrow(links, "a long, b long")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """`id, key, fp, root, component` of every row: the smallest id reachable over fingerprints `max_bits` apart.

    `root` is the group's smallest fingerprint, `key` tells rows of one id with different texts apart.

    Words are runs of other than ASCII white space, A-Z in lower case; shingles count as often as
    they occur; a text of fewer words is one shingle. Null, empty and blank texts have fingerprint 0
    and are linked by it like any other. Equal texts, repeated rows and equal fingerprints meet as one
    fingerprint before any search. Null ids are linked but never name a component unless all ids
    of it are null. An empty table gives an empty result. Other columns are not read.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stage(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    linked = components(link_fingerprints(distinct, max_bits), "long")
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("least").alias("component"))
    labels = rooted.join(named, "root").select("fp", "root", "component")
    return fps.join(labels, "fp").select("id", "key", "fp", "root", "component")
