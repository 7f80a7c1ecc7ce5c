"""Exact k nearest binary codes by multi-index hashing with growing segment radii.

Codes are cut into segments of 16 bits. Step t probes segment t mod m for values t div m bits away; after
step t every code within t bits has been met, since a code that near differs little enough in some
probed segment. A query ends once its kth distance is covered.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.sources.stage import stage

SEGMENT = 16
K = 10
SHARD_ROWS = 1 << 17
BLOCK_ROWS = 1 << 15
LEAST_PARTS = 8
MOST_TASKS = 1 << 15
QUERY_STEP = 64


@lru_cache(maxsize=None)
def masks(weight: int) -> np.ndarray:
    """All segment values with so many bits."""
    return np.array([sum(1 << b for b in bits) for bits in combinations(range(SEGMENT), weight)], np.uint16)


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`id, code`: one bit for each dimension, set if positive; rows without a vector or an id are left out.

    NaN and null elements count as zero, so do all of an empty vector.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    source = vectors.filter(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    # Shorter vectors count as if they went on with zeros; all codes have the length of the longest.
    longest = source.agg(F.max(F.size("vector"))).first()[0] or 0
    size = max(8, -(-longest // 64) * 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("vector")
            lengths = np.diff(column.offsets.to_numpy())
            row = np.repeat(np.arange(batch.num_rows), lengths)
            place = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            bits = np.zeros((batch.num_rows, size * 8), bool)
            bits[row, place] = np.nan_to_num(column.flatten().to_numpy(zero_copy_only=False).astype(float)) > 0
            packed = np.packbits(bits, axis=1)
            codes = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(size), batch.num_rows, [None, pa.py_buffer(packed.tobytes())]
            ).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), codes], names=["id", "code"])

    return source.mapInArrow(run, f"id {kind}, code binary")


class Index:
    """Codes ordered by each segment's value."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.segments = segments_of(codes)
        self.parts = self.segments.shape[1]
        self.order, self.starts, self.values = [], [], []
        for j in range(self.parts):
            own = self.segments[:, j]
            self.order.append(np.argsort(own, kind="stable"))
            self.starts.append(np.concatenate(([0], np.cumsum(np.bincount(own, minlength=1 << SEGMENT)))))
            self.values.append(np.unique(own))

    def probe(self, step: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Query and row of every code whose segment lies as far as this step asks."""
        weight, j = divmod(step, self.parts)
        if comb(SEGMENT, weight) <= len(self.values[j]):
            wanted = query[:, j, None] ^ masks(weight)[None, :]
            asks = np.repeat(np.arange(len(query)), wanted.shape[1])
            wanted = wanted.reshape(-1)
        else:
            # Fewer values exist than lie at this distance: look the other way round.
            asks, at = np.nonzero(np.bitwise_count(query[:, j, None] ^ self.values[j][None, :]) == weight)
            wanted = self.values[j][at]
        low, high = self.starts[j][wanted], self.starts[j][wanted.astype(np.int64) + 1]
        n = high - low
        asks, low, n = asks[n > 0], low[n > 0], n[n > 0]
        place = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(asks, n), self.order[j][place]

    def nearest(self, codes: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, row and distance of each query's k nearest, ties by id."""
        query = segments_of(codes)
        active = np.arange(len(codes))
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        done = []
        rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
        for step in range(self.parts * (SEGMENT + 1)):
            if not len(active):
                break
            asks, rows = self.probe(step, query[active])
            asks = active[asks]
            # A code is taken at the first step that meets it, so once.
            apart = np.bitwise_count(self.segments[rows] ^ query[asks]).astype(np.int64)
            met = (apart * self.parts + np.arange(self.parts)[None, :]).min(axis=1)
            new = met == step
            asks, rows, far = asks[new], rows[new], apart[new].sum(axis=1)
            q, r, d = (np.concatenate(x) for x in zip(best, (asks, rows, far), strict=True))
            order = np.lexsort((rank[r], d, q))
            q, r, d = q[order], r[order], d[order]
            first = np.searchsorted(q, q)
            keep = np.arange(len(q)) - first < k
            q, r, d = q[keep], r[keep], d[keep]
            count = np.bincount(q, minlength=len(codes))
            worst = np.zeros(len(codes), np.int64)
            np.maximum.at(worst, q, d)
            ended = ((count >= k) & (worst <= step)) | (count >= len(self.codes))
            over = ended[q]
            done.append((q[over], r[over], d[over]))
            best = (q[~over], r[~over], d[~over])
            active = active[~ended[active]]
        done.append(best)
        return tuple(np.concatenate(x) for x in zip(*done, strict=True))


def segments_of(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 16-bit segments."""
    return np.ascontiguousarray(codes).view(">u2").astype(np.uint16)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """`query_id, rank, neighbor_id, distance`: the k nearest codes of every query, ties to the smaller id.

    Both frames have `id, code`. Codes are dealt into shards of bounded size and queries into blocks of
    bounded size; every block meets every shard, and the shards' best meet per query. Of equal codes only
    the k smallest ids can be among the nearest, so no group of copies is larger than that. A query with
    fewer than k codes gets them all. Codes with a repeated id are rows of their own; so are queries with a
    repeated id and different codes, equal ones are one query. Empty tables give no rows.
    """
    id_kind, query_kind = codes.schema["id"].dataType.simpleString(), queries.schema["id"].dataType.simpleString()
    least = Window.partitionBy("code").orderBy("id")
    kept = codes.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k).select("id", "code", "n")
    kept = stage(kept, "codes")
    asked = stage(queries.select("id", "code"), "asked")
    rows, asks = kept.count(), asked.count()
    shards = max(1, -(-rows // SHARD_ROWS), min(LEAST_PARTS, rows // 1024))
    blocks = max(1, -(-asks // BLOCK_ROWS))

    def every(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    data = kept.select(
        F.pmod(F.xxhash64("id", "code", "n"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"), "id", "code"
    )
    dealt = asked.select(
        every(shards).alias("shard"), F.pmod(F.xxhash64("id", "code"), F.lit(blocks)).cast("int").alias("block"), "id", "code"
    )

    def found(q, r, d, left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table(
            {
                "query_id": right.column("id").take(pa.array(q, pa.int64())),
                "query_code": right.column("code").take(pa.array(q, pa.int64())),
                "neighbor_id": left.column("id").take(pa.array(r, pa.int64())),
                "distance": pa.array(d, pa.int64()),
            }
        )

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found([], [], [], left, right)
        index, ids = Index(_matrix(left.column("code"))), left.column("id")
        wanted = _matrix(right.column("code"))
        order = ids.to_numpy() if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), object)
        parts = [index.nearest(wanted[at : at + QUERY_STEP], order, k) for at in range(0, len(wanted), QUERY_STEP)]
        q = np.concatenate([p[0] + i * QUERY_STEP for i, p in enumerate(parts)])
        return found(q, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), left, right)

    # A query row is known by its id and its code, equal rows by one of them.
    # The search costs time and not bytes, so its tasks are counted by cells and not by their size.
    tasks = min(shards * blocks, MOST_TASKS)
    once = dealt.dropDuplicates(["shard", "id", "code"])
    near = (
        data.repartition(tasks, "shard", "block").groupBy("shard", "block")
        .cogroup(once.repartition(tasks, "shard", "block").groupBy("shard", "block"))
        .applyInArrow(best, f"query_id {query_kind}, query_code binary, neighbor_id {id_kind}, distance long")
    )
    ranked = Window.partitionBy("query_id", "query_code").orderBy("distance", "neighbor_id")
    return (
        near.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "neighbor_id", "distance")
    )
