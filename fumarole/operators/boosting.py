"""Boosted regression trees over histograms: regularised, leaf-wise and ordered growth.

One engine serves three learners. Features are cut into at most 256 buckets, rows are packed
once into blocks of a stage table (bucket bytes, target, prediction), and every pass over it adds
up gradients, weights and counts by (leaf, feature, bucket) inside the map tasks, then in Spark.
The driver sees bucket sums only, as many as leaves x features x buckets. Of two sibling leaves
the smaller one is counted and the other is the difference to their parent.

- ``level`` splits all leaves of a depth (regularised histogram boosting),
- ``leaf`` splits the leaf with the largest gain until ``numLeaves`` are reached; one pass counts
  the children of all leaves that may still be split, so a tree takes about as many passes as it
  is deep, and exactly the splits of a search leaf by leaf,
- ``symmetric`` takes one split for all leaves of a depth (ordered boosting): the gradient of a
  row comes from a prediction that only rows before it in a hash permutation have shaped. Blocks
  follow the permutation; sums of the blocks before, by leaf, come from a window over block sums,
  and those inside the block from a running sum.

For squared error with gradients g and weights h a leaf weighs -T(G) / (H + lambda), and a split
gains T(GL)^2 / (HL + lambda) + T(GR)^2 / (HR + lambda) - T(G)^2 / (H + lambda), where T moves a
sum towards zero by alpha.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext, keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasMaxIter, HasPredictionCol, HasSeed, HasStepSize
from pyspark.ml.util import MLReadable, MLWritable
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fumarole import vocab
from fumarole.operators.encode import _TableReader, _TableWriter
from fumarole.operators.quantiles import quantile_values
from fumarole.session import materialise, small_table

#: Rows of one block of the stage table.
BLOCK_ROWS = 4096
#: Trees after which the predictions of the stage table are written anew.
RESTAGE = 16
#: Smallest gain that splits a leaf.
LEAST_GAIN = 1e-9

BLOCK = "block long, n int, y binary, id binary, bins binary, plain binary, ordered binary"
SUMS = "leaf int, feature int, bin int, g double, h double, n long"
NODES = "tree int, node int, feature int, threshold double, left int, right int, value double, count double, gain double"


def soft(g: np.ndarray, alpha: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def uniform(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """A number in (0, 1) for each row and tree, a function of the row's hash."""
    x = ids.view(np.uint64) ^ np.uint64((seed * 1_000_003 + tree + 1) % (1 << 64))
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


# --- trees -------------------------------------------------------------------------------


@dataclass
class Tree:
    """Nodes as lists; a row goes left where its bucket is at most ``cut``. Leaves have feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    count: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def copy(self) -> Tree:
        return Tree(*(list(x) for x in vars(self).values()))

    def split(self, leaf: int, split: Split) -> tuple[int, int]:
        at = len(self.feature)
        self.feature[leaf], self.cut[leaf], self.gain[leaf] = split.feature, split.cut, split.gain
        self.left[leaf], self.right[leaf] = at, at + 1
        for _ in range(2):
            for column, start in zip(vars(self).values(), (-1, 0, -1, -1, 0.0, 0.0, 0.0)):
                column.append(start)
        return at, at + 1

    def leaf_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of buckets."""
        feature, cut, left, right = (np.array(x) for x in (self.feature, self.cut, self.left, self.right))
        node = np.zeros(len(bins), np.int64)
        moving = np.flatnonzero(feature[node] >= 0)
        while len(moving):
            here = node[moving]
            low = bins[moving, feature[here]] <= cut[here]
            node[moving] = np.where(low, left[here], right[here])
            moving = moving[feature[node[moving]] >= 0]
        return node


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    cut: int
    left_n: float
    right_n: float


@dataclass(frozen=True)
class Rule:
    """What shapes a tree."""

    alpha: float = 0.0
    penalty: float = 1.0
    least_rows: int = 1

    def score(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(h > 0, soft(g, self.alpha) ** 2 / (h + self.penalty), 0.0)

    def weight(self, g: float, h: float) -> float:
        return float(-soft(np.float64(g), self.alpha) / (h + self.penalty)) if h > 0 else 0.0

    def gains(self, sums: np.ndarray) -> np.ndarray:
        """Gain of every (feature, cut) of one leaf; sums are (g, h, n) by feature and bucket.
        Cuts that leave too few rows on a side gain nothing."""
        low = np.cumsum(sums, axis=2)
        whole = low[:, :, -1:]
        high = whole - low
        gain = self.score(low[0], low[1]) + self.score(high[0], high[1]) - self.score(whole[0], whole[1])
        return np.where((low[2] >= self.least_rows) & (high[2] >= self.least_rows), gain, -np.inf)

    def best(self, sums: np.ndarray) -> Split | None:
        """The best split of a leaf; the first feature and the lowest cut on a tie."""
        gain = self.gains(sums)
        feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
        if not gain[feature, cut] > LEAST_GAIN:
            return None
        return self.made(sums, int(feature), int(cut), float(gain[feature, cut]))

    @staticmethod
    def made(sums: np.ndarray, feature: int, cut: int, gain: float) -> Split:
        left = float(sums[2, feature, : cut + 1].sum())
        return Split(gain, feature, cut, left, float(sums[2, feature].sum()) - left)


# --- the stage table ---------------------------------------------------------------------


def cut_points(rows: DataFrame, width: int, most: int) -> list[list[float]]:
    """Ascending thresholds of each column: midpoints of its values where there are few, else
    exact quantiles."""
    columns = [f"x{i}" for i in range(width)]
    wide = rows.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(columns)])
    counts = wide.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first()
    few = [c for c in columns if counts[c] <= 2 * most]
    values = wide.agg(*[F.collect_set(c).alias(c) for c in few]).first().asDict() if few else {}
    values = {c: sorted(v) for c, v in values.items()}
    many = [c for c in columns if c not in values or len(values[c]) > most]
    edges = quantile_values(wide, many, [i / most for i in range(most + 1)]) if many else {}
    cuts = []
    for c in columns:
        if c in edges:
            known = sorted({e for e in edges[c] if e is not None})
            cuts.append(known[:-1] if len(known) <= most else known[1:-1])
        else:
            cuts.append([(a + b) / 2 for a, b in zip(values[c], values[c][1:])])
    return cuts


def blocks_of(rows: DataFrame, cuts: list[list[float]], start: float, ordered: bool) -> DataFrame:
    """Rows (x, y, id) packed into blocks, in the order of their ids where asked for."""
    if ordered:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        rows = rows.withColumn("copy", F.monotonically_increasing_id())
        rows = rows.repartitionByRange(tasks, "id", "copy").sortWithinPartitions("id", "copy").drop("copy")
    edges = [np.array(c) for c in cuts]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(low, BLOCK_ROWS)
                n = part.num_rows
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, len(edges))
                bins = np.empty(x.shape, np.uint8)
                for i, edge in enumerate(edges):
                    bins[:, i] = np.searchsorted(edge, x[:, i], side="left")
                y = part.column(1).to_numpy(zero_copy_only=False).astype(float)
                ids = part.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
                plain = np.full(n, start)
                data = [a.tobytes() for a in (y, ids, bins, plain, plain)]
                yield block(number, n, data)
                number += 1

    return rows.select("x", "y", "id").mapInArrow(pack, BLOCK)


def block(number: int, n: int, data: Sequence[bytes]) -> pa.RecordBatch:
    columns = [pa.array([number]), pa.array([n], pa.int32()), *(pa.array([d], pa.binary()) for d in data)]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])


@dataclass
class Block:
    """One block of rows as arrays."""

    number: int
    n: int
    y: np.ndarray
    ids: np.ndarray
    bins: np.ndarray
    plain: np.ndarray
    ordered: np.ndarray


def opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[Block]:
    for batch in batches:
        for row in batch.to_pylist():
            arrays = [np.frombuffer(row[c], k) for c, k in (("y", float), ("id", np.int64), ("bins", np.uint8), ("plain", float), ("ordered", float))]
            arrays[2] = arrays[2].reshape(row["n"], width)
            yield Block(row["block"], row["n"], *arrays)


# --- fitting -----------------------------------------------------------------------------


@dataclass
class Booster:
    """The state of one fit: the stage table, the trees not yet in its predictions, and the rule."""

    stage: DataFrame
    width: int
    bins: int
    rule: Rule
    step: float
    share: float = 1.0
    temperature: float = 0.0
    ordered: bool = False
    seed: int = 0
    pending: list[Tree] = field(default_factory=list)

    def weights(self, ids: np.ndarray, number: int) -> np.ndarray:
        """Weights of rows for one tree: a subsample, or the Bayesian bootstrap."""
        if self.share < 1:
            return (uniform(ids, number, self.seed) < self.share).astype(float)
        if self.temperature > 0:
            return (-np.log(uniform(ids, number, self.seed))) ** self.temperature
        return np.ones(len(ids))

    def gradients(self, rows: Block) -> np.ndarray:
        """Prediction so far less the target."""
        plain = rows.ordered if self.ordered else rows.plain
        for tree in self.pending:
            plain = plain + np.array(tree.value)[tree.leaf_of(rows.bins)]
        return plain - rows.y

    def counted(self, tree: Tree, wanted: Sequence[int], number: int) -> dict[int, np.ndarray]:
        """(g, h, n) by feature and bucket of each wanted leaf, in one pass."""
        slots = np.full(len(tree.feature), -1)
        slots[list(wanted)] = np.arange(len(wanted))
        stage, width, bins = self.stage, self.width, self.bins
        me = Booster(None, width, bins, self.rule, self.step, self.share, self.temperature, self.ordered, self.seed, self.pending)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            size = len(wanted) * bins
            total = np.zeros((3, width, size))
            for rows in opened(batches, width):
                slot = slots[tree.leaf_of(rows.bins)]
                weight = me.weights(rows.ids, number)
                take = np.flatnonzero((slot >= 0) & (weight > 0))
                g, h = (me.gradients(rows) * weight)[take], weight[take]
                place = slot[take] * bins
                for f in range(width):
                    at = place + rows.bins[take, f]
                    total[0, f] += np.bincount(at, g, size)
                    total[1, f] += np.bincount(at, h, size)
                    total[2, f] += np.bincount(at, minlength=size)
            f, at = np.nonzero(total[2])
            values = total[:, f, at]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at // bins, pa.int32()), pa.array(f, pa.int32()), pa.array(at % bins, pa.int32()),
                    pa.array(values[0]), pa.array(values[1]), pa.array(values[2].astype(np.int64)),
                ],
                ["leaf", "feature", "bin", "g", "h", "n"],
            )

        parts = stage.mapInArrow(add, SUMS).groupBy("leaf", "feature", "bin")
        sums = parts.agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
        found = np.zeros((len(wanted), 3, width, bins))
        leaf, feature, bin_ = (sums[c].to_numpy() for c in ("leaf", "feature", "bin"))
        for i, c in enumerate("ghn"):
            found[leaf, i, feature, bin_] = sums[c].to_numpy()
        return dict(zip(wanted, found))

    def children(self, tree: Tree, parents: dict[int, tuple[np.ndarray, Split]], number: int) -> dict[int, tuple]:
        """Sums of both children of each parent, were it split: one pass over the smaller ones."""
        trial, wanted = tree.copy(), {}
        for leaf, (_, split) in parents.items():
            left, right = trial.split(leaf, split)
            wanted[leaf] = left if split.left_n <= split.right_n else right, split.left_n <= split.right_n
        sums = self.counted(trial, [node for node, _ in wanted.values()], number)
        out = {}
        for leaf, (node, is_left) in wanted.items():
            own = sums[node]
            other = parents[leaf][0] - own
            out[leaf] = (own, other) if is_left else (other, own)
        return out

    # growth

    def grown(self, how: str, number: int, features: np.ndarray, depth: int, leaves: int) -> Tree:
        """One tree. ``features`` masks the columns it may use."""
        tree = Tree()
        root = self.counted(tree, [0], number)[0]
        root[:, ~features] = 0
        sums = {0: root}
        grow = {"level": self._by_level, "leaf": self._by_leaf, "symmetric": self._symmetric}[how]
        grow(tree, sums, number, features, depth, leaves)
        for node, own in sums.items():
            one = own[:, int(np.argmax(features))].sum(axis=1)
            tree.value[node], tree.count[node] = self.step * self.rule.weight(one[0], one[1]), float(one[2])
        return tree

    def _masked(self, pairs: dict[int, tuple], features: np.ndarray) -> dict[int, tuple]:
        for pair in pairs.values():
            for own in pair:
                own[:, ~features] = 0
        return pairs

    @staticmethod
    def _ends(own: np.ndarray, split: Split) -> tuple[np.ndarray, np.ndarray]:
        """Sums of two children, all in one bucket: enough for leaves that stay."""
        low = np.zeros_like(own)
        low[:, :, 0] = own[:, split.feature, : split.cut + 1].sum(axis=1)[:, None]
        high = np.zeros_like(own)
        high[:, :, 0] = own[:, split.feature, split.cut + 1 :].sum(axis=1)[:, None]
        return low, high

    def _by_level(self, tree, sums, number, features, depth, leaves) -> None:
        frontier = [0]
        for level in range(depth):
            chosen = {leaf: (sums[leaf], s) for leaf in frontier if (s := self.rule.best(sums[leaf]))}
            if not chosen:
                return
            if level < depth - 1:
                pairs = self._masked(self.children(tree, chosen, number), features)
            else:
                pairs = {leaf: self._ends(*both) for leaf, both in chosen.items()}
            frontier = []
            for leaf, (_, split) in chosen.items():
                nodes = tree.split(leaf, split)
                sums.update(zip(nodes, pairs[leaf]))
                frontier += nodes

    def _by_leaf(self, tree, sums, number, features, depth, leaves) -> None:
        levels, heap, known = {0: 0}, [], {}

        def offer(leaf: int) -> None:
            split = self.rule.best(sums[leaf]) if levels[leaf] < depth else None
            if split:
                heapq.heappush(heap, (-split.gain, leaf, split))

        offer(0)
        count = 1
        while heap and count < leaves:
            _, leaf, split = heap[0]
            if leaf not in known and count < leaves - 1:
                # all leaves that the budget may still reach are counted in the same pass
                ahead = [(node, s) for _, node, s in heapq.nsmallest(leaves - count, heap) if node not in known]
                known |= self._masked(self.children(tree, {n: (sums[n], s) for n, s in ahead}, number), features)
            heapq.heappop(heap)
            pair = known.pop(leaf, None) or self._ends(sums[leaf], split)
            nodes = tree.split(leaf, split)
            sums.update(zip(nodes, pair))
            count += 1
            for node in nodes:
                levels[node] = levels[leaf] + 1
                if count < leaves:
                    offer(node)

    def _symmetric(self, tree, sums, number, features, depth, leaves) -> None:
        frontier = [0]
        for level in range(depth):
            gain = sum(np.maximum(self.rule.gains(sums[leaf]), 0) for leaf in frontier)
            feature, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            if not gain[feature, cut] > LEAST_GAIN:
                return
            share = float(gain[feature, cut]) / len(frontier)
            chosen = {leaf: (sums[leaf], self.rule.made(sums[leaf], int(feature), int(cut), share)) for leaf in frontier}
            if level < depth - 1:
                pairs = self._masked(self.children(tree, chosen, number), features)
            else:
                pairs = {leaf: self._ends(*both) for leaf, both in chosen.items()}
            frontier = []
            for leaf, (_, split) in chosen.items():
                nodes = tree.split(leaf, split)
                sums.update(zip(nodes, pairs[leaf]))
                frontier += nodes

    # predictions

    def added(self, tree: Tree, number: int) -> None:
        """Takes a tree into the predictions."""
        if self.ordered:
            self.plain_values(tree, number)
            self.stage = materialise(self._with_prefixes(tree, number), "ordered")
            return
        self.pending.append(tree)
        if len(self.pending) >= RESTAGE:
            trees, width = self.pending, self.width

            def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for rows in opened(batches, width):
                    plain = rows.plain
                    for tree in trees:
                        plain = plain + np.array(tree.value)[tree.leaf_of(rows.bins)]
                    yield block(rows.number, rows.n, [a.tobytes() for a in (rows.y, rows.ids, rows.bins, plain, rows.ordered)])

            self.stage = materialise(self.stage.mapInArrow(advance, BLOCK), "boosted")
            self.pending = []

    def leaf_sums(self, tree: Tree, number: int) -> DataFrame:
        """(block, leaf, g, h, plain) of every block: weighted gradients of both predictions."""
        width, me = self.width, Booster(None, self.width, self.bins, self.rule, self.step, self.share, self.temperature, self.ordered, self.seed)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in opened(batches, width):
                leaf, weight = tree.leaf_of(rows.bins), me.weights(rows.ids, number)
                g, h, plain = (
                    np.bincount(leaf, v * weight, len(tree.feature))
                    for v in (rows.ordered - rows.y, np.ones(rows.n), rows.plain - rows.y)
                )
                met = np.unique(leaf)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(met), rows.number)), pa.array(met, pa.int32()), pa.array(g[met]), pa.array(h[met]), pa.array(plain[met])],
                    ["block", "leaf", "g", "h", "plain"],
                )

        return self.stage.mapInArrow(add, "block long, leaf int, g double, h double, plain double")

    def plain_values(self, tree: Tree, number: int) -> None:
        """Leaf weights of the stored model: from all rows and its own predictions."""
        sums = self.leaf_sums(tree, number).groupBy("leaf").agg(F.sum("plain").alias("g"), F.sum("h").alias("h"))
        for row in sums.collect():
            tree.value[row["leaf"]] = self.step * self.rule.weight(row["g"], row["h"])

    def _with_prefixes(self, tree: Tree, number: int) -> DataFrame:
        """The stage table after one tree: the prediction of each row takes the weight that the
        rows before it give its leaf."""
        before = Window.partitionBy("leaf").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        sums = self.leaf_sums(tree, number).select(
            "block", "leaf", *[F.coalesce(F.sum(c).over(before), F.lit(0.0)).alias(c) for c in ("g", "h")]
        )
        # as many entries as the tree has leaves
        starts = sums.groupBy("block").agg(F.collect_list(F.struct("leaf", "g", "h")).alias("starts"))
        joined = self.stage.join(small_table(starts), "block")
        me = Booster(None, self.width, self.bins, self.rule, self.step, self.share, self.temperature, self.ordered, self.seed)
        width = self.width

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                starts = batch.column(batch.schema.get_field_index("starts")).to_pylist()
                for rows, given in zip(opened(iter([batch]), width), starts):
                    leaf, weight = tree.leaf_of(rows.bins), me.weights(rows.ids, number)
                    g = (rows.ordered - rows.y) * weight
                    moved = np.zeros(rows.n)
                    for start in given:
                        at = np.flatnonzero(leaf == start["leaf"])
                        ahead_g = start["g"] + np.cumsum(g[at]) - g[at]
                        ahead_h = start["h"] + np.cumsum(weight[at]) - weight[at]
                        safe = np.where(ahead_h > 0, ahead_h + me.rule.penalty, 1.0)
                        moved[at] = np.where(ahead_h > 0, -soft(ahead_g, me.rule.alpha) / safe, 0.0)
                    plain = rows.plain + np.array(tree.value)[leaf]
                    data = (rows.y, rows.ids, rows.bins, plain, rows.ordered + me.step * moved)
                    yield block(rows.number, rows.n, [a.tobytes() for a in data])

        return joined.mapInArrow(advance, BLOCK)

    def rows(self) -> DataFrame:
        """(id, y, plain, ordered) of every row, with the predictions of the stage table."""
        width = self.width

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in opened(batches, width):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows.ids), pa.array(rows.y), pa.array(rows.plain), pa.array(rows.ordered)],
                    ["id", "y", "plain", "ordered"],
                )

        return self.stage.mapInArrow(unpack, "id long, y double, plain double, ordered double")


# --- the estimator -----------------------------------------------------------------------


class _BoostingParams(HasLabelCol, HasFeaturesCol, HasPredictionCol, HasMaxIter, HasStepSize, HasSeed):
    growth = Param(Params._dummy(), "growth", "level, leaf or symmetric", TypeConverters.toString)
    maxDepth = Param(Params._dummy(), "maxDepth", "largest depth; -1 for none (leaf-wise only)", TypeConverters.toInt)
    numLeaves = Param(Params._dummy(), "numLeaves", "leaf budget of leaf-wise trees", TypeConverters.toInt)
    maxBins = Param(Params._dummy(), "maxBins", "buckets of a feature, at most 256", TypeConverters.toInt)
    minInstancesPerNode = Param(Params._dummy(), "minInstancesPerNode", "fewest rows of a leaf", TypeConverters.toInt)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of rows of a tree", TypeConverters.toFloat)
    columnShare = Param(Params._dummy(), "columnShare", "share of features of a tree", TypeConverters.toFloat)
    alpha = Param(Params._dummy(), "alpha", "L1 penalty", TypeConverters.toFloat)
    lambda_ = Param(Params._dummy(), "lambda_", "L2 penalty", TypeConverters.toFloat)
    baggingTemperature = Param(Params._dummy(), "baggingTemperature", "spread of row weights", TypeConverters.toFloat)
    orderCol = Param(Params._dummy(), "orderCol", "long column that orders rows; a hash if empty", TypeConverters.toString)


_DEFAULTS = {
    "labelCol": "label", "featuresCol": "features", "predictionCol": "prediction", "maxIter": 100, "stepSize": 0.1,
    "seed": vocab.SEED, "growth": "level", "maxDepth": 6, "numLeaves": 31, "maxBins": 64, "minInstancesPerNode": 1,
    "subsamplingRate": 1.0, "columnShare": 1.0, "alpha": 0.0, "lambda_": 1.0, "baggingTemperature": 0.0, "orderCol": "",
}


class HistogramTrees(Estimator, _BoostingParams):
    """Boosted trees for squared error; ``growth`` chooses how a tree grows."""

    @keyword_only
    def __init__(self, **settings):
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self._set(**self._input_kwargs.get("settings", self._input_kwargs))

    def booster(self, dataset: DataFrame) -> tuple[Booster, list[list[float]], float]:
        """The stage table of a fit, the thresholds of its buckets and the mean target."""
        get = lambda name: self.getOrDefault(name)
        if not 2 <= get("maxBins") <= 256:
            raise ValueError("maxBins must be between 2 and 256")
        order = get("orderCol")
        chosen = dataset.select(
            vector_to_array(F.col(get("featuresCol"))).alias("x"),
            F.col(get("labelCol")).cast("double").alias("y"),
            *[F.col(order).cast("long").alias("id")] * bool(order),
        )
        if not order:
            chosen = chosen.withColumn("id", F.xxhash64("x", "y", F.lit(get("seed"))))
        rows = materialise(chosen, "boosting-rows")
        facts = rows.agg(F.avg("y").alias("mean"), F.first(F.size("x")).alias("width")).first()
        if facts["mean"] is None:
            raise ValueError("no rows to fit")
        cuts = cut_points(rows, facts["width"], get("maxBins"))
        ordered = get("growth") == "symmetric"
        stage = materialise(blocks_of(rows, cuts, facts["mean"], ordered), "blocks")
        rule = Rule(get("alpha"), get("lambda_"), get("minInstancesPerNode"))
        made = Booster(
            stage, facts["width"], max(len(c) for c in cuts) + 1, rule, get("stepSize"),
            get("subsamplingRate"), get("baggingTemperature"), ordered, get("seed"),
        )
        return made, cuts, facts["mean"]

    def trees(self, made: Booster) -> list[Tree]:
        get = lambda name: self.getOrDefault(name)
        draw = random.Random(get("seed"))
        count = max(1, math.ceil(get("columnShare") * made.width))
        depth = get("maxDepth") if get("maxDepth") > 0 else 10**6
        if depth == 10**6 and get("growth") != "leaf":
            raise ValueError("only leaf-wise trees may grow without a depth limit")
        found = []
        for number in range(get("maxIter")):
            features = np.zeros(made.width, bool)
            features[draw.sample(range(made.width), count)] = True
            tree = made.grown(get("growth"), number, features, depth, get("numLeaves"))
            if len(tree.feature) == 1 and count == made.width and get("subsamplingRate") == 1:
                break  # no later tree would split either
            made.added(tree, number)
            found.append(tree)
        return found

    def _fit(self, dataset: DataFrame) -> HistogramModel:
        made, cuts, mean = self.booster(dataset)
        model = HistogramModel()
        model._resetUid(self.uid)
        self._copyValues(model)
        return model.of(dataset.sparkSession, self.trees(made), cuts, mean)


class HistogramModel(Model, _BoostingParams, MLWritable, MLReadable):
    """Fitted trees as a table of nodes; node -1 of tree -1 holds the mean that they start from."""

    table: DataFrame

    def __init__(self) -> None:
        super().__init__()
        self._setDefault(**_DEFAULTS)
        self._nodes: pd.DataFrame | None = None

    def of(self, spark: SparkSession, trees: Sequence[Tree], cuts: list[list[float]], mean: float) -> HistogramModel:
        rows = [(-1, -1, len(cuts), 0.0, -1, -1, float(mean), 0.0, 0.0)]
        for number, tree in enumerate(trees):
            for node, at in enumerate(tree.feature):
                threshold = cuts[at][tree.cut[node]] if at >= 0 else 0.0
                rows.append(
                    (number, node, at, float(threshold), tree.left[node], tree.right[node],
                     tree.value[node], tree.count[node], tree.gain[node])
                )
        self.table = spark.createDataFrame(rows, NODES)
        return self

    def write(self):
        return _TableWriter(self)

    @classmethod
    def read(cls):
        return _TableReader(cls)

    def nodes(self) -> pd.DataFrame:
        if self._nodes is None:
            self._nodes = self.table.orderBy("tree", "node").toPandas()
        return self._nodes

    @property
    def base(self) -> float:
        return float(self.nodes()["value"].iloc[0])

    @property
    def numFeatures(self) -> int:
        return int(self.nodes()["feature"].iloc[0])

    @property
    def featureImportances(self) -> DenseVector:
        """Gain by feature, as shares of the whole."""
        inner = self.nodes()[lambda t: (t["tree"] >= 0) & (t["feature"] >= 0)]
        gains = np.bincount(inner["feature"], inner["gain"], self.numFeatures)
        return Vectors.dense(gains / gains.sum() if gains.sum() > 0 else gains)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        nodes = self.nodes()
        base = self.base
        trees = [
            tuple(tree[c].to_numpy() for c in ("feature", "threshold", "left", "right", "value"))
            for number, tree in nodes.groupby("tree") if number >= 0
        ]
        shared = dataset.sparkSession.sparkContext.broadcast(trees)

        @F.pandas_udf("double")
        def predict(vectors: pd.Series) -> pd.Series:
            x = np.array(vectors.tolist(), float).reshape(len(vectors), -1)
            total = np.full(len(x), base)
            for feature, threshold, left, right, value in shared.value:
                node = np.zeros(len(x), np.int64)
                moving = np.flatnonzero(feature[node] >= 0)
                while len(moving):
                    here = node[moving]
                    low = x[moving, feature[here]] <= threshold[here]
                    node[moving] = np.where(low, left[here], right[here])
                    moving = moving[feature[node[moving]] >= 0]
                total += value[node]
            return pd.Series(total)

        found = predict(vector_to_array(F.col(self.getOrDefault("featuresCol"))))
        return dataset.withColumn(self.getOrDefault("predictionCol"), found)
