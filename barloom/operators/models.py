"""Stored classifiers as data: the numbers of a fitted model, and predictions from them for rows of many models.

A row names its models by number, so one pass over the rows scores all of them, whatever their count.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Models that go to the tasks at once; more are scored in several passes, each over its own rows.
MODEL_BYTES = 64 << 20


@dataclass(frozen=True)
class Logistic:
    """Positive where the margin is above that of an even chance."""

    weights: np.ndarray
    intercept: float

    def positive(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept > 0

    def size(self) -> int:
        return self.weights.nbytes + 8


@dataclass(frozen=True)
class Perceptron:
    """Sigmoid layers; the larger of the last two outputs wins, the first one at a tie."""

    layers: tuple[tuple[np.ndarray, np.ndarray], ...]

    def positive(self, x: np.ndarray) -> np.ndarray:
        *hidden, (last, shift) = self.layers
        for weights, bias in hidden:
            x = 1 / (1 + np.exp(-np.clip(x @ weights.T + bias, -700, 700)))
        out = x @ last.T + shift
        return out[:, 1] > out[:, 0]

    def size(self) -> int:
        return sum(w.nbytes + b.nbytes for w, b in self.layers)


@dataclass(frozen=True)
class Forest:
    """Nodes of all trees in one table; a leaf points at itself and has the share of both classes."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray
    depth: int

    def positive(self, x: np.ndarray) -> np.ndarray:
        votes = np.zeros((len(x), 2))
        each = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[each, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            votes += self.share[at]
        return votes[:, 1] > votes[:, 0]

    def size(self) -> int:
        return sum(a.nbytes for a in (self.roots, self.feature, self.threshold, self.left, self.right, self.share))


def _perceptron(layers: Sequence[int], weights: np.ndarray) -> Perceptron:
    out, at = [], 0
    for before, after in zip(layers, layers[1:]):
        matrix = weights[at : at + before * after].reshape(before, after).T
        at += before * after
        out.append((matrix, weights[at : at + after]))
        at += after
    return Perceptron(tuple(out))


def _forest(nodes: pd.DataFrame) -> Forest:
    """From rows tree, id, feature, threshold, left, right, counts; ids of a tree count from 0."""
    nodes = nodes.sort_values(["tree", "id"]).reset_index(drop=True)
    sizes = nodes.groupby("tree").size().to_numpy()
    roots = np.cumsum(sizes) - sizes
    offset = np.repeat(roots, sizes)
    own = np.arange(len(nodes))
    leaf = nodes["left"].to_numpy() < 0
    left = np.where(leaf, own, nodes["left"].to_numpy() + offset)
    right = np.where(leaf, own, nodes["right"].to_numpy() + offset)
    counts = np.stack(nodes["counts"].map(np.asarray).to_list())
    total = counts.sum(axis=1, keepdims=True)
    depth, level = 0, roots
    while len(level):
        level = np.concatenate([left[level][~leaf[level]], right[level][~leaf[level]]])
        depth += bool(len(level))
    return Forest(
        roots,
        np.where(leaf, 0, nodes["feature"].to_numpy()),
        np.where(leaf, np.inf, nodes["threshold"].to_numpy()),
        left,
        right,
        np.divide(counts, total, out=np.zeros_like(counts), where=total > 0),
        depth,
    )


def load(spark: SparkSession, path: str) -> Logistic | Perceptron | Forest:
    """The numbers of the last stage of a stored pipeline."""
    chain = PipelineModel.load(path)
    model = chain.stages[-1]
    kind = type(model).__name__
    if kind == "LogisticRegressionModel":
        return Logistic(np.asarray(model.coefficients.toArray()), float(model.intercept))
    if kind == "MultilayerPerceptronClassificationModel":
        return _perceptron(model.getLayers(), np.asarray(model.weights.toArray()))
    stored = spark.read.parquet(f"{path}/stages/{len(chain.stages) - 1}_{model.uid}/data").select(
        F.col("treeID").alias("tree"),
        F.col("nodeData.id").alias("id"),
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"),
        F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"),
        F.col("nodeData.impurityStats").alias("counts"),
    )
    # A stored model is of fixed size: a number of trees of bounded depth.
    return _forest(stored.toPandas())


def slices(models: dict[int, Logistic | Perceptron | Forest], limit: int = MODEL_BYTES) -> list[dict]:
    """Models in groups of at most so many bytes, a larger model alone."""
    out: list[dict] = []
    held = limit
    for number, model in models.items():
        if held + model.size() > limit:
            out.append({})
            held = 0
        out[-1][number] = model
        held += model.size()
    return out


def predict(rows: DataFrame, models: dict, inputs: Sequence[str], labels: Sequence[str], limit: int = MODEL_BYTES) -> DataFrame:
    """The rows with a boolean column per label, by the model that column `_model_<label>` numbers.

    Null without a model and for a row with a missing input. No shuffle; the model columns go.
    """
    for part in slices(models, limit) or [{}]:
        rows = _predict(rows, part, inputs, labels)
    return rows.drop(*[f"_model_{name}" for name in labels])


def _predict(rows: DataFrame, models: dict, inputs: Sequence[str], labels: Sequence[str]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(models)
    names = [c for c in rows.columns if c not in labels]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = batch[list(inputs)].astype("float64").to_numpy()
            known = ~np.isnan(x).any(axis=1)
            for label in labels:
                number = batch[f"_model_{label}"]
                value = batch[label].astype(object) if label in batch else pd.Series([None] * len(batch), dtype=object)
                for one in number[known].dropna().unique():
                    if model := shared.value.get(int(one)):
                        own = known & (number == one).to_numpy()
                        value[own] = model.positive(x[own])
                batch[label] = value
            yield batch[[*names, *labels]]

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names]
    return rows.mapInPandas(run, ", ".join([*fields, *[f"`{name}` boolean" for name in labels]]))
