"""Random forest classifier whose trees all grow by a level in one pass over the rows.

Features are cut into at most ``bins`` ranges at quantiles of all rows.  The ranges are
stored once as blocks of bytes.  For each level every task counts, by numpy over its
blocks, the rows of each class by (tree, node, candidate feature, range); Spark adds the
counts up by tree, and the best split of each node comes from the sums.  The driver holds
the trees, which bounded numbers describe, and no rows.

As in MLlib: Poisson(1) bootstrap, a random square root of the features a node, Gini
impurity, leaves at no gain, class shares of the leaves averaged over the trees, and
importances from gains weighted by rows.  Draws follow from the seed and the stored block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Rows of a stored partition; Spark reads several small ones in one task.
PARTITION_ROWS = 100_000
LEAST_ROWS = 2_000
BLOCK_ROWS = 50_000
TREES_A_BATCH = 32


def poisson_table() -> np.ndarray:
    """Poisson(1) for each value of 16 random bits."""
    shares = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(shares, (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


POISSON = poisson_table()


def ranges(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The range of each value: how many cuts are below it."""
    return np.stack([np.searchsorted(c, x[:, j]) for j, c in enumerate(cuts)], 1).astype(np.uint8)


def drawn(seed: int, block: int, tree: int, n: int) -> np.ndarray:
    """How often each row of a block is in the sample of a tree."""
    return POISSON[np.random.default_rng([seed, block, tree]).integers(0, 1 << 16, n, np.uint16)]


def candidates(seed: int, tree: int, level: int, n_features: int, most: int) -> np.ndarray:
    """[node of the level, candidate] -> feature."""
    order = np.random.default_rng([seed, tree, level, n_features]).random((1 << level, n_features)).argsort(1)
    return order[:, :most]


def walk(x: np.ndarray, rows: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows (numbers of rows of ``x``) still in split nodes after ``levels`` steps, and their
    nodes; node 1 is the root, 2n and 2n + 1 are the children of n."""
    flat, width = x.ravel(), x.shape[1]
    at = np.ones(len(rows), np.int64)
    for _ in range(levels):
        f = feature[at]
        inner = f >= 0
        if not inner.all():
            rows, at, f = rows[inner], at[inner], f[inner]
        at = 2 * at + (flat[rows * width + f] > cut[at])
    return rows, at


@dataclass(frozen=True)
class Shape:
    """What all passes of a fit share."""
    n_features: int
    classes: int
    bins: int
    trees: int
    candidates: int
    seed: int


def count_level(blocks: Iterator[tuple[int, np.ndarray, np.ndarray]], shape: Shape, feature: np.ndarray, cut: np.ndarray, level: int) -> np.ndarray | None:
    """[tree, node of the level, candidate, range, class] -> drawn rows of the blocks (number, ranges, classes)."""
    cells = (1 << level, shape.candidates, shape.bins, shape.classes)
    out, slots = None, np.arange(shape.candidates)
    of = [candidates(shape.seed, t, level, shape.n_features, shape.candidates) for t in range(shape.trees)]
    for number, x, y in blocks:
        if out is None:
            out = np.zeros((shape.trees, math.prod(cells)), np.uint32)
        flat = x.ravel()
        for t in range(shape.trees):
            times = drawn(shape.seed, number, t, len(y))
            rows, at = walk(x, np.flatnonzero(times), feature[t], cut[t], level)
            node, each = at - (1 << level), np.repeat(times[rows].astype(float), shape.candidates)
            found = flat[(rows * shape.n_features)[:, None] + of[t][node]]
            cell = ((node[:, None] * shape.candidates + slots) * shape.bins + found) * shape.classes + y[rows, None]
            out[t] += np.bincount(cell.ravel(), each, out.shape[1]).astype(np.uint32)
    return out


def best_splits(counts: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per node of a level (feature, range, gain times rows, class counts left, right) from
    ``counts`` [node, candidate, range, class]; feature -1 where no split gains."""
    left = counts.cumsum(2)[:, :, :-1].astype(float)
    whole = counts[:, :1].sum(2, keepdims=True).astype(float)
    right = whole - left

    def impurity(c: np.ndarray) -> np.ndarray:
        """Gini impurity times rows."""
        n = c.sum(-1)
        return n - (c * c).sum(-1) / np.maximum(n, 1)

    gain = impurity(whole) - impurity(left) - impurity(right)
    nodes = np.arange(len(counts))
    flat = gain.reshape(len(counts), -1)
    best = flat.argmax(1)
    j, b = np.unravel_index(best, gain.shape[1:])
    won = flat[nodes, best]
    ok = won > 1e-9 * np.maximum(whole.sum((1, 2, 3)), 1)
    return np.where(ok, of[nodes, j], -1), b, np.where(ok, won, 0.0), left[nodes, j, b], right[nodes, j, b]


class Forest:
    """Fitted trees: ``feature`` and ``cut`` [tree, node], drawn rows ``counts`` [tree, node,
    class] and their ``shares``, ``gains`` [tree, feature]."""

    def __init__(self, cuts: list[np.ndarray], feature: np.ndarray, cut: np.ndarray, counts: np.ndarray, gains: np.ndarray):
        self.cuts, self.feature, self.cut = cuts, feature, cut
        self.counts, self.gains = counts, gains
        self.shares = counts / np.maximum(counts.sum(2, keepdims=True), 1)

    @property
    def featureImportances(self) -> DenseVector:
        """Each tree's gains by feature, as shares of the tree, summed and made shares again."""
        each = self.gains / np.maximum(self.gains.sum(1, keepdims=True), 1e-300)
        return DenseVector(each.sum(0) / max(each.sum(), 1e-300))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """[row, class] for features [row, feature]."""
        codes = ranges(x, self.cuts)
        flat, base = codes.ravel(), np.arange(len(x)) * codes.shape[1]
        total = np.zeros((len(x), self.shares.shape[2]))
        depth = int(math.log2(self.feature.shape[1]))
        for feature, cut, shares in zip(self.feature, self.cut, self.shares):
            at = np.ones(len(x), np.int64)
            rows = np.arange(len(x))
            for _ in range(depth):
                f = feature[at[rows]]
                rows, f = rows[f >= 0], f[f >= 0]
                if not len(rows):
                    break
                at[rows] = 2 * at[rows] + (flat[base[rows] + f] > cut[at[rows]])
            total += shares[at]
        return total / max(len(self.feature), 1)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``probability`` and ``prediction`` (the first of equally likely classes)."""
        @F.pandas_udf("array<double>")
        def shares(features: pd.Series) -> pd.Series:
            x = np.stack(features.to_numpy()) if len(features) else np.zeros((0, len(self.cuts)))
            return pd.Series(list(self.probabilities(x)))

        out = df.withColumn("_p", shares(vector_to_array("features")))
        best = F.array_position("_p", F.array_max("_p")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("_p")).drop("_p")


@dataclass(frozen=True)
class ForestClassifier:
    """Settings of a forest; ``fit`` takes stored rows with a vector ``features`` and a ``label`` of 0, 1, ..."""
    num_trees: int = 500
    max_depth: int = 8
    seed: int = 0
    bins: int = 32

    def fit(self, df: DataFrame) -> Forest:
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("width"), F.max("y").alias("y")).first()
        if not found["n"]:
            raise ValueError("a forest needs rows")
        n, width = found["n"], found["width"]
        probabilities = [k / self.bins for k in range(1, self.bins)]
        quantiles = rows.select(*[F.col("x")[j].alias(f"x{j}") for j in range(width)]).approxQuantile([f"x{j}" for j in range(width)], probabilities, 0.001)
        cuts = [np.unique(np.array(q, float)) for q in quantiles]
        shape = Shape(width, max(2, found["y"] + 1), self.bins, self.num_trees, math.ceil(math.sqrt(width)), self.seed)
        blocks = self.blocks(rows, cuts, n)
        heap = 1 << self.max_depth
        feature, cut = np.full((self.num_trees, heap), -1, np.int16), np.zeros((self.num_trees, heap), np.uint8)
        counts, gains = np.zeros((self.num_trees, 2 * heap, shape.classes)), np.zeros((self.num_trees, width))
        for level in range(self.max_depth):
            if level and (feature[:, 1 << (level - 1):1 << level] < 0).all():
                break
            for r in self.grown(blocks, shape, feature, cut, level).collect():  # a row for each tree
                t, nodes = r["tree"], slice(1 << level, 2 << level)
                f = np.frombuffer(r["feature"], np.int16)
                feature[t, nodes], cut[t, nodes] = f, np.frombuffer(r["cut"], np.uint8)
                sides = np.frombuffer(r["sides"]).reshape(-1, 2, shape.classes)
                if level == 0:
                    counts[t, 1] = sides[0].sum(0)
                split = f >= 0
                below = counts[t, 2 << level:4 << level].reshape(-1, 2, shape.classes)
                below[split] = sides[split]
                gains[t] += np.bincount(f[split], np.frombuffer(r["gain"])[split], width)
        return Forest(cuts, feature, cut, counts, gains)

    def blocks(self, rows: DataFrame, cuts: list[np.ndarray], n: int) -> DataFrame:
        """(block, x, y), stored: the ranges and classes of some thousand rows as bytes."""
        spread = min(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
        parts = max(1, spread, -(-n // PARTITION_ROWS))

        def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(batches).combine_chunks()
            x = ranges(t.column(1).chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1), cuts)
            y = t.column(2).to_numpy().astype(np.uint8)
            return pa.record_batch([t.column(0).chunk(0)[:1], pa.array([x.tobytes()], pa.binary()), pa.array([y.tobytes()], pa.binary())], names=["block", "x", "y"])

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            some: list[pa.RecordBatch] = []
            for b in batches:
                some += [b] if b.num_rows else []
                if sum(s.num_rows for s in some) >= BLOCK_ROWS:
                    yield block(some)
                    some = []
            if some:
                yield block(some)

        dealt = rows.repartition(parts).select(F.monotonically_increasing_id().alias("block"), "x", "y")
        return materialize(dealt.mapInArrow(cut, "block long, x binary, y binary"))

    def grown(self, blocks: DataFrame, shape: Shape, feature: np.ndarray, cut: np.ndarray, level: int) -> DataFrame:
        """(tree, feature, cut, gain, sides) of the nodes of a level, as bytes."""
        cells = (1 << level, shape.candidates, shape.bins, shape.classes)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def read() -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
                for b in batches:
                    for number, x, y in zip(b.column(0), b.column(1), b.column(2)):
                        yield number.as_py(), np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, shape.n_features), np.frombuffer(y.as_buffer(), np.uint8)

            out = count_level(read(), shape, feature, cut, level)
            for t in range(0, shape.trees if out is not None else 0, TREES_A_BATCH):
                some = range(t, min(t + TREES_A_BATCH, shape.trees))
                yield pa.record_batch([pa.array(some, pa.int32()), pa.array([out[i].tobytes() for i in some], pa.binary())], names=["tree", "counts"])

        def best(t: pa.Table) -> pa.Table:
            tree = t.column("tree")[0].as_py()
            total = sum(np.frombuffer(c.as_buffer(), np.uint32).astype(np.int64) for c in t.column("counts")).reshape(cells)
            f, b, gain, left, right = best_splits(total, candidates(shape.seed, tree, level, shape.n_features, shape.candidates))
            found = [f.astype(np.int16), b.astype(np.uint8), gain.astype(float), np.stack([left, right], 1)]
            return pa.table([pa.array([tree], pa.int32()), *[pa.array([v.tobytes()], pa.binary()) for v in found]], names=["tree", "feature", "cut", "gain", "sides"])

        return blocks.mapInArrow(count, "tree int, counts binary").groupBy("tree").applyInArrow(best, "tree int, feature binary, cut binary, gain binary, sides binary")
