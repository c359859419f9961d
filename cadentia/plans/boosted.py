"""Gradient-boosted trees for two classes, trained on counted cells of binned features.

The method and the numbers are those of Spark's ``GBTClassifier`` with its defaults: log loss, variance as impurity,
a first tree of weight 1 and later ones of ``STEP``, split candidates as Spark draws them. Trees see a row by the bins its
features fall in, so rows of the same bins and label are one cell with a count. There are about 2 x ``BINS`` ^ features cells at most,
however many rows there are; a pass over them returns one histogram per task, and no rows are held as objects between passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadentia.session import materialise

BINS = 32
# A sample larger than expected gives a bin or two more, so a bin's number has room for twice as many.
BITS = 6
SLOTS = 2**BITS
STEP = 0.1
DRAWN = 10_000
# Rows a task counts or scores at a time.
ROWS = 500_000


@dataclass
class Tree:
    """Nodes in heap order: 2 i + 1 and 2 i + 2 are the children of i. A node without a split is a leaf."""

    splits: dict[int, tuple[int, int]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def nodes(self, bins: Sequence[np.ndarray], depth: int) -> np.ndarray:
        """The node of every row after at most ``depth`` splits."""
        at = np.zeros(len(bins[0]), np.uint8)
        for level in range(depth):
            for node in range(2**level - 1, 2 ** (level + 1) - 1):
                if node in self.splits:
                    of, upto = self.splits[node]
                    at = np.where(at == node, np.uint8(2 * node + 1) + (bins[of] > upto).view(np.uint8), at)
        return at

    def predict(self, bins: Sequence[np.ndarray], depth: int) -> np.ndarray:
        table = np.zeros(2 ** (depth + 1) - 1)
        table[list(self.values)] = list(self.values.values())
        return table[self.nodes(bins, depth)]


def margin(trees: Sequence[Tree], bins: Sequence[np.ndarray], depth: int) -> np.ndarray:
    total = np.zeros(len(bins[0]))
    for i, tree in enumerate(trees):
        total += (STEP if i else 1.0) * tree.predict(bins, depth)
    return total


def _sampled(rows: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The rows that Spark's trees sample to draw split candidates: taken by their place in a partition."""
    spark = rows.sparkSession
    drawn = spark._jvm.org.apache.spark.util.random.XORShiftRandom(seed).nextInt()
    some = rows._jdf.toJavaRDD().sample(False, fraction, drawn)
    return DataFrame(spark._jsparkSession.createDataFrame(some, rows._jdf.schema()), spark)


def _cuts(values: np.ndarray, expected: float) -> np.ndarray:
    """Thresholds between the sampled values of a feature, of which ``expected`` are expected, zeros included."""
    distinct, counts = np.unique(values[values != 0], return_counts=True)
    missing = expected - counts.sum()
    if len(distinct) and missing > np.finfo(float).eps * counts.sum() * 100:
        at = int(np.searchsorted(distinct, 0.0))
        distinct, counts = np.insert(distinct, at, 0.0), np.insert(counts.astype(float), at, missing)
    middles = (distinct[:-1] + distinct[1:]) / 2
    if len(distinct) <= BINS:
        return middles
    upto, stride, chosen = np.cumsum(counts), expected / BINS, []
    target = stride
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            chosen.append(middles[i - 1])
            target += stride
    return np.array(chosen)


def candidates(training: DataFrame, names: Sequence[str], seed: int) -> list[np.ndarray]:
    """Thresholds per feature as Spark's trees draw them: from about ``DRAWN`` rows, which are all that reach the driver."""
    rows = training.select(*names)
    count = rows.count()
    if not count:
        raise ValueError("no rows to train on")
    fraction = min(1.0, DRAWN / count)
    sample = rows if fraction == 1.0 else _sampled(rows, fraction, seed)
    table = sample.toArrow()
    cuts = [_cuts(table.column(name).to_numpy(), fraction * count) for name in names]
    if max(map(len, cuts)) >= SLOTS:
        raise ValueError(f"more than {SLOTS} bins for a feature")
    return cuts


def _stacked(batches: Iterator[pa.RecordBatch], most: int = ROWS) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= most:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _binned(table: pa.Table, names: Sequence[str], thresholds: Sequence[np.ndarray]) -> list[np.ndarray]:
    bins = []
    for name, cuts in zip(names, thresholds, strict=True):
        values = table.column(name).to_numpy()
        if table.column(name).null_count or np.isnan(values).any():
            raise ValueError(f"column {name} holds null or NaN")
        bins.append(np.searchsorted(cuts, values).astype(np.uint8))
    return bins


def counted_cells(training: DataFrame, names: Sequence[str], label: str, thresholds: Sequence[np.ndarray]) -> DataFrame:
    """``cell, n``: bins of the features and the label in one number, and how many rows have them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stacked(batches):
            given = table.column(label).to_numpy()
            if table.column(label).null_count or not np.isin(given, (0, 1)).all():
                raise ValueError(f"labels in {label} must be 0 or 1")
            cell = given.astype(np.int64)
            for each in _binned(table, names, thresholds):
                cell = (cell << BITS) | each
            cells, n = np.unique(cell, return_counts=True)
            yield pa.record_batch([pa.array(cells), pa.array(n, pa.int64())], ["cell", "n"])

    some = training.select(*names, label).mapInArrow(count, "cell long, n long")
    return some.groupBy("cell").agg(F.sum("n").alias("n"))


def packed_cells(cells: DataFrame, features: int) -> DataFrame:
    """The cells in blocks of arrays, which every pass reads as they are: bins by feature, label of -1 or 1, count; stored."""
    names = ["bins", "label", "n"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _stacked(batches):
            cell, n = table.column("cell").to_numpy(), table.column("n").to_numpy().astype(float)
            bins = np.array([cell >> (BITS * (features - 1 - i)) & (SLOTS - 1) for i in range(features)], np.uint8)
            label = (2 * (cell >> BITS * features) - 1).astype(np.int8)
            yield pa.record_batch([pa.array([each.tobytes()], pa.binary()) for each in (bins, label, n)], names)

    return materialise(cells.mapInArrow(pack, ", ".join(f"{name} binary" for name in names)), "cells")


def _sums(
    blocks: DataFrame, features: int, trees: Sequence[Tree], tree: Tree, level: int, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """What is left to explain at the nodes of a level: count, sum, sum of squares; count and sum by feature and bin."""
    first, width = 2**level - 1, 2**level

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, binned = np.zeros((3, width)), np.zeros((2, width, features, SLOTS))
        for batch in batches:
            for i in range(batch.num_rows):
                bins, label, n = (
                    np.frombuffer(c[i].as_buffer(), k) for c, k in zip(batch.columns, (np.uint8, np.int8, float), strict=True)
                )
                bins = bins.reshape(features, -1)
                left = label.astype(float)
                if trees:
                    left = 4 * left / (1 + np.exp(2 * left * margin(trees, bins, depth)))
                at = tree.nodes(bins, level)
                if level:
                    here = at >= first
                    if not here.all():
                        at, bins, left, n = at[here], bins[:, here], left[here], n[here]
                node = at.astype(np.int64) - first
                weights = [n, n * left]
                for k, w in enumerate((*weights, n * left * left)):
                    whole[k] += np.bincount(node, w, width)
                node *= SLOTS
                for f in range(features):
                    place = node + bins[f]
                    for k, w in enumerate(weights):
                        binned[k, :, f] += np.bincount(place, w, width * SLOTS).reshape(width, SLOTS)
        sums = np.concatenate([whole.ravel(), binned.ravel()])
        yield pa.record_batch([pa.array([sums.tobytes()], pa.binary())], ["sums"])

    parts = [np.frombuffer(row.sums) for row in blocks.mapInArrow(measure, "sums binary").collect()]
    sums = np.sum(parts, axis=0)
    return sums[: 3 * width].reshape(3, width), sums[3 * width :].reshape(2, width, features, SLOTS)


def _grow(tree: Tree, whole: np.ndarray, binned: np.ndarray, level: int, depth: int, thresholds: Sequence[np.ndarray]) -> bool:
    """Split the nodes of a level where that lowers the variance; whether any child may be split in turn."""
    more = False
    for i in range(2**level):
        node, (n, total, squares) = 2**level - 1 + i, whole[:, i]
        if not n:
            continue
        tree.values[node] = total / n
        if node and abs((squares - total * total / n) / n) < np.finfo(float).eps:
            continue
        most, best = 0.0, None
        for f, cuts in enumerate(thresholds):
            lower = np.cumsum(binned[:, i, f], axis=1)[:, : len(cuts)]
            upper = np.array([[n], [total]]) - lower
            filled = (lower[0] > 0) & (upper[0] > 0)
            parts = [side[1] * side[1] / np.where(filled, side[0], 1) for side in (lower, upper)]
            gain = np.where(filled, (parts[0] + parts[1] - total * total / n) / n, 0.0)
            if len(cuts) and gain.max() > most:
                at = int(np.argmax(gain))
                most, best = gain[at], (f, at, lower[:, at], upper[:, at])
        if best is not None:
            f, at, lower, upper = best
            tree.splits[node] = (f, at)
            tree.values[2 * node + 1], tree.values[2 * node + 2] = lower[1] / lower[0], upper[1] / upper[0]
            more |= level + 1 < depth
    return more


def boosted_trees(blocks: DataFrame, thresholds: Sequence[np.ndarray], rounds: int, depth: int) -> list[Tree]:
    trees: list[Tree] = []
    for _ in range(rounds):
        tree = Tree()
        for level in range(depth):
            if not _grow(tree, *_sums(blocks, len(thresholds), trees, tree, level, depth), level, depth, thresholds):
                break
        trees.append(tree)
    return trees


def with_probability(
    df: DataFrame, names: Sequence[str], thresholds: Sequence[np.ndarray], trees: Sequence[Tree], depth: int, name: str
) -> DataFrame:
    """Add the probability of class 1 as column ``name``."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(pa.Table.from_batches([batch]), names, thresholds)
            chance = 1 / (1 + np.exp(-2 * margin(trees, bins, depth)))
            yield pa.record_batch([*batch.columns, pa.array(chance)], [*batch.schema.names, name])

    return df.mapInArrow(score, T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())]))


def fit_boosted(
    training: DataFrame, names: Sequence[str], label: str, name: str, rounds: int, depth: int, seed: int
) -> Callable[[DataFrame], DataFrame]:
    """Train on ``training``; returns what adds the probability of class 1 to a frame as column ``name``."""
    thresholds = candidates(training, names, seed)
    cells = counted_cells(training, names, label, thresholds)
    trees = boosted_trees(packed_cells(cells, len(names)), thresholds, rounds, depth)
    return lambda df: with_probability(df, names, thresholds, trees, depth, name)
