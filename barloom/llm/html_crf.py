"""Main text of pages: a linear-chain conditional random field over their leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import chunks
from barloom.llm.html_blocks import Block, blocks_of
from barloom.llm.html_pages import MARK, labelled_pages

TRAINING_PAGES = 1000
ROUNDS = 120
PENALTY = 0.02
RATE = 0.3


def features(blocks: list[Block]) -> list[list[str]]:
    """Tags and names above each block, and what its text looks like."""
    out = []
    for i, b in enumerate(blocks):
        n = len(b.text)
        density = b.linked / n
        found = set(b.above)
        found.add(f"block:{b.tag}")
        found.add("bias")
        found.add(f"length:{min(8, n.bit_length())}")
        found.add(f"linked:{int(density * 4)}")
        found.add(f"ends:{b.text[-1] in '.!?'}")
        found.add(f"commas:{min(3, b.text.count(','))}")
        if "©" in b.text or "copyright" in b.text.lower():
            found.add("sign:copyright")
        if i == 0:
            found.add("first")
        if i == len(blocks) - 1:
            found.add("last")
        out.append(sorted(found))
    return out


@dataclass
class Model:
    number: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def scores(self, blocks: list[Block]) -> np.ndarray:
        out = np.zeros((len(blocks), 2))
        for t, names in enumerate(features(blocks)):
            at = [k for k in map(self.number.get, names) if k is not None]
            out[t] = self.weights[at].sum(axis=0)
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The most likely labels of the whole chain; ties go to no content."""
        if not blocks:
            return []
        scores, moves = self.scores(blocks).tolist(), self.moves.tolist()
        (a, b), back = scores[0], []
        for s in scores[1:]:
            a0, a1 = a + moves[0][0], b + moves[1][0]
            b0, b1 = a + moves[0][1], b + moves[1][1]
            back.append((int(a1 > a0), int(b1 > b0)))
            a, b = max(a0, a1) + s[0], max(b0, b1) + s[1]
        label = int(b > a)
        path = [label]
        for step in reversed(back):
            label = step[label]
            path.append(label)
        return path[::-1]

    def extract(self, page: str | None) -> str:
        blocks = blocks_of(page or "", self.number)
        return "\n".join(b.text for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def labelled_blocks(page: str) -> tuple[list[Block], list[int]]:
    blocks = blocks_of(page)
    labels = [int(MARK in b.text) for b in blocks]
    for b in blocks:
        b.text = b.text.replace(MARK, "").strip() or "x"
    return blocks, labels


def fit(pages: Sequence[tuple[list[Block], list[int]]], rounds: int = ROUNDS) -> Model:
    """Weights of greatest penalised conditional likelihood, by gradient steps over all pages at once.

    Forward and backward sums run over all pages in step, padded to the longest.
    """
    pages = [p for p in pages if p[0]]
    number: dict[str, int] = {}
    cells, columns, labels = [], [], []
    longest = max(len(b) for b, _ in pages)
    real = np.zeros((len(pages), longest), bool)
    gold = np.zeros((len(pages), longest), int)
    for i, (blocks, truth) in enumerate(pages):
        real[i, : len(blocks)] = True
        gold[i, : len(blocks)] = truth
        for t, names in enumerate(features(blocks)):
            for name in names:
                cells.append(i * longest + t)
                columns.append(number.setdefault(name, len(number)))
    cells, columns = np.array(cells), np.array(columns)
    weights, moves = np.zeros((len(number), 2)), np.zeros((2, 2))
    speed_w, speed_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    one_hot = np.eye(2)[gold] * real[:, :, None]
    steps = real[:, 1:, None, None] * (np.eye(2)[gold[:, :-1], :, None] * np.eye(2)[gold[:, 1:], None, :])
    n = real.sum()

    def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for _ in range(rounds):
        flat = np.zeros((len(pages) * longest, 2))
        for k in (0, 1):
            flat[:, k] = np.bincount(cells, weights[columns, k], len(flat))
        score = flat.reshape(len(pages), longest, 2)
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            new = log_sum(forward[:, t - 1, :, None] + moves[None], 1) + score[:, t]
            forward[:, t] = np.where(real[:, t, None], new, forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            new = log_sum(moves[None] + (score[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where(real[:, t + 1, None], new, 0)
        total = log_sum(forward[:, -1], 1)
        single = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        double = np.exp(
            forward[:, :-1, :, None] + moves + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - total[:, None, None, None]
        ) * real[:, 1:, None, None]
        off = (one_hot - single).reshape(-1, 2)[cells]
        grad_w = np.stack([np.bincount(columns, off[:, k], len(number)) for k in (0, 1)], 1) / n - PENALTY * weights / len(number)
        grad_m = (steps - double).sum(axis=(0, 1)) / n
        speed_w += grad_w**2
        speed_m += grad_m**2
        weights += RATE * grad_w / np.sqrt(speed_w)
        moves += RATE * grad_m / np.sqrt(speed_m)
    return Model(number, weights, moves)


@lru_cache(maxsize=2)
def default_model(pages: int = TRAINING_PAGES, seed: int = 1) -> Model:
    """The model of a documented number of labelled pages; the same on every machine."""
    return fit([labelled_blocks(p) for p in labelled_pages(pages, seed)])


def extract_text(pages: DataFrame, html_col: str = "html", new_col: str = "text", keep: Sequence[str] | None = None, model: Model | None = None) -> DataFrame:
    """All rows and columns of pages (or those to `keep`) with the main text, in one pass without a shuffle.

    Blocks are joined in page order by a line break; character references are decoded and white space in a
    block is one space. Null, empty and textless pages give an empty text. Broken markup is read as far as
    it goes; pages of any length are read whole. Repeated rows agree. A column of the new name is replaced.
    """
    spark = pages.sparkSession
    shared = spark.sparkContext.broadcast(model or default_model())
    names = [c for c in (pages.columns if keep is None else keep) if c != new_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in chunks(batches, "__html"):
            texts = [own.extract(p) for p in part.column("__html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string())], names=["row", "found"])

    source = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(f"`{html_col}`").alias("__html"))
    found = source.mapInArrow(run, f"row {source.schema['row'].dataType.simpleString()}, found string")
    return found.select(*[F.col("row").getField(c).alias(c) for c in names], F.col("found").alias(new_col))
