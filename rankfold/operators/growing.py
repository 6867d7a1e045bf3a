"""Trees, forests and boosted trees grown over blocks of binned rows, for tables on which Spark's own fits take too long.

The trees are Spark's: thresholds from as many rows as its fits take, the same impurities, order of candidates, stopping rules and
pruning; a single tree and boosting come out node for node as theirs. Four things are cheaper. A row is one byte a number and
two for each indicator that is set. Upper levels are histograms summed over partitions; a node of at most `WHOLE_ROWS` rows goes to one task, which grows all
that is below. Histograms of boosting are made for the smaller child and subtracted for the other. Grid points share what is equal in them: a smaller
depth is the upper part of a larger one, fewer trees are the first of more, fewer rounds the beginning of more.

A forest draws by a counter: the weight of a row in a tree follows from the seed, the tree and the row's key, the features of a node from the seed, the
tree and the node. So draws don't depend on the layout of the rows; they are others than Spark's, whose draws follow the partitions.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import DefaultParamsReader
from pyspark.sql import DataFrame, SparkSession, functions as F

from rankfold.session import scratch_path

#: Training rows from which on a forest is grown here; for a single tree and boosting, whose fits by Spark pass over the rows less often, it is more.
FROM_ROWS, FROM_ROWS_OTHERS = 100_000, 1_000_000
#: Rows of a block, and rows of a node whose lower part one task grows.
BLOCK_ROWS, WHOLE_ROWS = 50_000, 100_000
#: Bytes of rows that are dealt out to nodes at once, and nodes of a level that one job counts.
DEALT_BYTES, LEVEL_NODES = 1_000_000_000, 4_000
#: Rounds after which the rows with their margins are stored, so that their history stays short.
STORED_ROUNDS = 25
KEY = "_key"
_EPSILON = 2.0**-52


# Preparation


@dataclass(frozen=True)
class Bins:
    """Thresholds of the features that are numbers, and which features are indicators."""

    features: int
    numbers: np.ndarray
    thresholds: list[np.ndarray]
    flags: np.ndarray

    @property
    def splits(self) -> np.ndarray:
        """Candidates of every feature."""
        out = np.ones(self.features, dtype=np.int64)
        out[self.numbers] = [len(t) for t in self.thresholds]
        return out


def _indicators(rows: DataFrame, features: str) -> list[int] | None:
    """Features with two levels, by the vector's metadata; None where levels of others are known."""
    attributes = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if any("vals" in a or "num_vals" in a for a in attributes.get("nominal", [])):
        return None
    return sorted(a["idx"] for a in attributes.get("binary", []))


def suits(estimator: Estimator, grid: list, rows: DataFrame) -> bool:
    """Whether this module grows all that the estimator and grid ask for."""
    if not isinstance(estimator, (DecisionTreeClassifier, RandomForestClassifier, GBTClassifier)) or not grid:
        return False
    if {p.name for point in grid for p in point} - {"maxDepth", "numTrees", "maxIter"}:
        return False
    get = lambda name: estimator.getOrDefault(name) if estimator.hasParam(name) else None
    plain = get("minInstancesPerNode") == 1 and get("minInfoGain") == 0 and get("minWeightFractionPerNode") == 0 and get("maxBins") <= 256
    plain = plain and get("impurity") in ("gini", "variance") and get("subsamplingRate") in (None, 1.0) and not (
        estimator.hasParam("weightCol") and estimator.isSet("weightCol")) and not get("leafCol")
    if isinstance(estimator, RandomForestClassifier):
        plain = plain and get("bootstrap") and get("featureSubsetStrategy") == "auto" and all(estimator.copy(p).getNumTrees() > 1 for p in grid)
    if isinstance(estimator, GBTClassifier):
        plain = plain and get("featureSubsetStrategy") == "all" and not estimator.isSet("validationIndicatorCol")
    return bool(plain) and _indicators(rows, estimator.getFeaturesCol()) is not None


def from_rows(estimator: Estimator) -> int:
    return FROM_ROWS if isinstance(estimator, RandomForestClassifier) else FROM_ROWS_OTHERS


def row_key(rows: DataFrame):
    """Number of a row that doesn't depend on where it lies."""
    return F.xxhash64(*([c for c in ("id", "rank") if c in rows.columns] or rows.columns))


def thresholds(values: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` candidates between different values, of about equal shares; Spark's rule."""
    found, counts = np.unique(values + 0.0, return_counts=True)
    if len(found) - 1 <= most:
        return (found[:-1] + found[1:]) / 2
    stride = len(values) / (most + 1)
    out, now, target = [], int(counts[0]), stride
    for i in range(1, len(found)):
        before, now = now, now + int(counts[i])
        if abs(before - target) < abs(now - target):
            out.append((found[i - 1] + found[i]) / 2)
            target += stride
    return np.array(out)


def learn_bins(rows: DataFrame, estimator: Estimator, count: int) -> Bins:
    """Bins from as many rows as Spark's fits take for it: the square of the number of bins, 10,000 at least."""
    features, most = estimator.getFeaturesCol(), estimator.getMaxBins()
    share = max(most * most, 10_000) / count
    some = rows if share >= 1 else rows.filter(F.pmod(F.col(KEY), F.lit(2**30)) < int(share * 2**30))
    table = some.select(vector_to_array(features).alias("x")).toArrow()["x"].combine_chunks()
    x = table.values.to_numpy(zero_copy_only=False).reshape(len(table), -1)
    flags = np.array(_indicators(rows, features), dtype=np.int64)
    numbers = np.setdiff1d(np.arange(x.shape[1]), flags)
    return Bins(x.shape[1], numbers, [thresholds(x[:, i], most - 1) for i in numbers], flags)


def _binned(x: np.ndarray, bins: Bins) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the numbers, and which indicators are set (as many columns as the row with most; what is over is one further number)."""
    codes = np.zeros((len(x), max(1, len(bins.numbers))), dtype=np.uint8)
    for j, (i, cuts) in enumerate(zip(bins.numbers, bins.thresholds)):
        codes[:, j] = np.searchsorted(cuts, x[:, i], side="left")
    at, which = np.nonzero(x[:, bins.flags])
    per = np.bincount(at, minlength=len(x))
    flags = np.full((len(x), per.max() if len(x) else 0), len(bins.flags), dtype=np.uint16)
    flags[at, np.arange(len(at)) - (np.cumsum(per) - per)[at]] = which
    return codes, flags


def _dense(codes: np.ndarray, flags: np.ndarray, bins: Bins) -> np.ndarray:
    """One column a feature; indicators are 0 or 1."""
    out = np.zeros((len(codes), bins.features + 1), dtype=np.uint8)
    out[:, bins.numbers] = codes[:, :len(bins.numbers)]
    place = np.append(bins.flags, bins.features)
    for j in range(flags.shape[1]):
        out[np.arange(len(out)), place[flags[:, j]]] = 1
    return np.ascontiguousarray(out[:, :-1])


def _vectors(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def blocks(rows: DataFrame, estimator: Estimator, bins: Bins, number: int) -> RDD:
    """The rows as dicts of arrays: `set` (the given number), `codes`, `flags`, `y` and `key`."""
    import pickle

    def pack(batches):
        held, size = [], 0

        def block():
            x, y, key = (np.concatenate(parts) for parts in zip(*held))
            codes, flags = _binned(x, bins)
            data = pickle.dumps({"set": number, "codes": codes, "flags": flags, "y": y.astype(np.uint8), "key": key.view(np.uint64)})
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["block"])

        for batch in batches:
            held.append((_vectors(batch), batch.column("y").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)))
            size += batch.num_rows
            if size >= BLOCK_ROWS:
                yield block()
                held, size = [], 0
        if size:
            yield block()

    columns = rows.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), F.col(estimator.getLabelCol()).cast("double").alias("y"), F.col(KEY).alias("key"))
    return columns.mapInArrow(pack, "block binary").rdd.map(lambda row: pickle.loads(row["block"]))


# Trees


@dataclass
class Tree:
    """Nodes by heap number: the root is 1, below h are 2h and 2h + 1. `feature` is -1 in leaves; `flip` sends the set indicator left.

    `stats` are rows by class, or number, sum and sum of squares of the values.
    """

    heap: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    flip: np.ndarray
    stats: np.ndarray

    def rows(self, at) -> Tree:
        return Tree(self.heap[at], self.feature[at], self.cut[at], self.flip[at], self.stats[at])

    @property
    def left(self) -> np.ndarray:
        """Place of the left child; the right one follows it. Nodes are in order of their numbers."""
        return np.where(self.feature >= 0, np.searchsorted(self.heap, 2 * self.heap), -1)


def _leaves(heap: np.ndarray, stats: np.ndarray) -> Tree:
    return Tree(heap, np.full(len(heap), -1), np.zeros(len(heap), dtype=np.int64), np.zeros(len(heap), dtype=bool), stats)


def _joined(parts: list[Tree]) -> Tree:
    whole = Tree(*(np.concatenate([getattr(p, n) for p in parts]) for n in ("heap", "feature", "cut", "flip", "stats")))
    return whole.rows(np.argsort(whole.heap, kind="stable"))


def _depth(heap: np.ndarray) -> np.ndarray:
    return np.frexp(heap.astype(np.float64))[1] - 1


def _predictions(stats: np.ndarray) -> np.ndarray:
    """The more frequent class, the first of equal ones; or the mean."""
    return (stats[:, 1] > stats[:, 0]).astype(float) if stats.shape[1] == 2 else stats[:, 1] / stats[:, 0]


def _impurities(stats: np.ndarray) -> np.ndarray:
    if stats.shape[1] == 3:
        return (stats[:, 2] - stats[:, 1] * stats[:, 1] / stats[:, 0]) / stats[:, 0]
    total = stats.sum(axis=1)
    a, b = stats[:, 0] / total, stats[:, 1] / total
    return 1.0 - a * a - b * b


def pruned(tree: Tree, depth: int) -> Tree:
    """The tree down to `depth`, without splits whose sides are leaves of one prediction."""
    tree = tree.rows(_depth(tree.heap) <= depth)
    at = _depth(tree.heap)
    feature, says = np.where(at == depth, -1, tree.feature), _predictions(tree.stats)
    left = np.where(feature >= 0, np.searchsorted(tree.heap, 2 * tree.heap), -1)
    alive = np.ones(len(at), dtype=bool)
    for level in range(int(at.max()) - 1, -1, -1):
        q = np.nonzero((at == level) & (feature >= 0))[0]
        a = left[q]
        same = q[(feature[a] < 0) & (feature[a + 1] < 0) & (says[a] == says[a + 1])]
        feature[same] = -1
        alive[left[same]] = alive[left[same] + 1] = False
    return Tree(tree.heap, feature, np.where(feature < 0, 0, tree.cut), tree.flip & (feature >= 0), tree.stats).rows(alive)


def _down(dense: np.ndarray, tree: Tree, levels: int) -> np.ndarray:
    """Place of the node that each row reaches."""
    left, width = tree.left, dense.shape[1]
    flat, base = dense.ravel(), np.arange(len(dense)) * width
    node = np.zeros(len(dense), dtype=np.int64)
    going = np.arange(len(dense))
    for _ in range(levels):
        here = node[going]
        inner = left[here] >= 0
        if not inner.all():
            going, here = going[inner], here[inner]
        if not len(going):
            break
        right = (flat[base[going] + tree.feature[here]] > tree.cut[here]) != tree.flip[here]
        node[going] = left[here] + right
    return node


# Draws of a forest


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers well mixed (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _stream(seed: int, tree: int, kind: int) -> np.uint64:
    return _mixed(_mixed(np.array([(seed * 4 + kind) % 2**64], dtype=np.uint64)) ^ np.uint64(tree))[0]


#: Shares of a Poisson law with mean one up to each count, as 64-bit numbers.
_POISSON = np.array([min(int(v * 2.0**64), 2**64 - 1) for v in np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 17)]))], dtype=np.uint64)


def weights(key: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often a row is in a tree's sample: Poisson with mean one."""
    return np.searchsorted(_POISSON, _mixed(key ^ _stream(seed, tree, 1)), side="right").astype(np.uint8)


def asked_features(heap: np.ndarray, seed: int, tree: int, features: int, asked: int) -> np.ndarray:
    """Features, in order, that the splits of each node are chosen from."""
    if asked >= features:
        return np.broadcast_to(np.arange(features), (len(heap), features))
    node = _mixed(heap.astype(np.uint64) ^ _stream(seed, tree, 2))
    drawn = _mixed(node[:, None] ^ _mixed(np.arange(features, dtype=np.uint64))[None, :])
    return np.sort(np.argpartition(drawn, asked - 1, axis=1)[:, :asked], axis=1)


# Classification


_HIGH = 2.0**26  # class counts of a block share one sum


def _counts(dense: np.ndarray, rows: np.ndarray, slot: np.ndarray, w: np.ndarray, y: np.ndarray, asked: np.ndarray, width: int) -> np.ndarray:
    """`(slot, asked feature, bin, class)`: rows by class."""
    k, m = asked.shape
    out = np.zeros(k * m * width)
    flat, base, mass = dense.ravel(), rows * dense.shape[1], w * (1.0 + _HIGH * y)
    for j in range(m):
        cell = flat[base + asked[slot, j]] + (slot * m + j) * width
        if len(out) < 4 * len(cell):
            out += np.bincount(cell, mass, len(out))
        else:
            np.add.at(out, cell, mass)
    ones = np.floor(out / _HIGH)
    return np.stack([out - _HIGH * ones - ones, ones], axis=1).reshape(k, m, width, 2)


def _class_splits(counts: np.ndarray, asked: np.ndarray, bins: Bins):
    """`(feature or -1, cut, flip, left, right)` of each node; the first of the best candidates."""
    k, m, width, _ = counts.shape
    node = counts[:, 0].sum(axis=1)
    total = node.sum(axis=1)
    left = np.cumsum(counts, axis=2)[:, :, :-1]
    right = node[:, None, None, :] - left
    # Of an indicator's two levels the one with fewer rows of the second class goes left.
    turned = np.isin(asked, bins.flags) & (right[:, :, 0, 1] < left[:, :, 0, 1])
    left[:, :, 0][turned], right[:, :, 0][turned] = right[:, :, 0][turned], left[:, :, 0][turned]
    nl, nr = left.sum(axis=3), right.sum(axis=3)
    with np.errstate(divide="ignore", invalid="ignore"):
        gini = lambda c, n: 1.0 - (c[..., 0] / n) ** 2 - (c[..., 1] / n) ** 2
        t = total[:, None, None]
        gain = gini(node, total)[:, None, None] - nl / t * gini(left, nl) - nr / t * gini(right, nr)
    possible = (np.arange(width - 1) < bins.splits[asked][:, :, None]) & (nl > 0) & (nr > 0)
    gain = np.where(possible, gain, -1.0).reshape(k, -1)
    best = gain.argmax(axis=1)
    q, j, cut = np.arange(k), best // (width - 1), best % (width - 1)
    split = gain[q, best] > 0
    return np.where(split, asked[q, j], -1), cut, turned[q, j] & split, left[q, j, cut], right[q, j, cut]


def _pure(stats: np.ndarray) -> np.ndarray:
    return np.abs(_impurities(stats)) < _EPSILON


def grow_whole(dense: np.ndarray, y: np.ndarray, w: np.ndarray, root: int, seed: int, tree: int, asked: int, depth: int, bins: Bins, width: int) -> Tree:
    """The part of a tree below node `root`, from all rows that reach it."""
    heap = np.array([root], dtype=np.int64)
    ones = float((w * y.astype(np.int64)).sum())
    stats = np.array([[float(w.sum(dtype=np.int64)) - ones, ones]])
    rows, slot, done = np.arange(len(y)), np.zeros(len(y), dtype=np.int64), []
    for _ in range(depth - int(_depth(heap)[0])):
        pure = _pure(stats)
        if pure.any():
            done.append(_leaves(heap[pure], stats[pure]))
            place = np.cumsum(~pure) - 1
            kept = ~pure[slot]
            rows, slot, heap, stats = rows[kept], place[slot[kept]], heap[~pure], stats[~pure]
        if not len(heap):
            break
        features = asked_features(heap, seed, tree, bins.features, asked)
        feature, cut, flip = (np.empty(len(heap), t) for t in (np.int64, np.int64, bool))
        a, b = np.empty((len(heap), 2)), np.empty((len(heap), 2))
        # Nodes side by side in portions, so that their counts stay small; rows are in order of nodes.
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        most = max(1, 2_000_000 // (features.shape[1] * width))
        for low in range(0, len(heap), most):
            high = min(len(heap), low + most)
            i, j = np.searchsorted(slot, [low, high])
            counts = _counts(dense, rows[i:j], slot[i:j] - low, w[rows[i:j]], y[rows[i:j]], features[low:high], width)
            feature[low:high], cut[low:high], flip[low:high], a[low:high], b[low:high] = _class_splits(counts, features[low:high], bins)
        done.append(Tree(heap, feature, cut, flip, stats))
        inner = feature >= 0
        kept = inner[slot]
        rows, slot = rows[kept], slot[kept]
        right = (dense[rows, feature[slot]] > cut[slot]) != flip[slot]
        place = 2 * (np.cumsum(inner) - 1)
        slot = place[slot] + right
        heap = np.stack([2 * heap[inner], 2 * heap[inner] + 1], axis=1).ravel()
        stats = np.stack([a[inner], b[inner]], axis=1).reshape(-1, 2)
        if not len(heap):
            break
    if len(heap):
        done.append(_leaves(heap, stats))
    return _joined(done)


def grow_forest(rows: RDD, bins: dict[int, Bins], sizes: dict[int, int], trees: int, depths: list[int], seed: int, boot: bool) -> dict[tuple[int, int, int], Tree]:
    """Trees by (set of rows, tree, depth), pruned. Without `boot` it is one tree of all rows that asks for all features."""
    sc, depth = rows.context, max(depths)
    width = 1 + max(int(b.splits.max()) for b in bins.values())
    asked = {s: int(np.ceil(np.sqrt(b.features))) if boot else b.features for s, b in bins.items()}
    known, out = sc.broadcast(bins), {}

    def drawn(block: dict, t: int) -> np.ndarray:
        return weights(block["key"], seed, t) if boot else np.ones(len(block["y"]), dtype=np.uint8)

    row_bytes = max(len(b.numbers) for b in bins.values()) + 16
    at_once = max(1, int(DEALT_BYTES / (row_bytes * sum(sizes.values()))))
    for first in range(0, trees, at_once):
        group = [(s, t) for t in range(first, min(trees, first + at_once)) for s in bins]
        upper: dict[tuple[int, int], list[Tree]] = {g: [] for g in group}
        open_, whole = {g: np.array([1], dtype=np.int64) for g in group}, {g: [] for g in group}
        for level in range(depth):
            for g in [g for g in open_ if level == 0 and sizes[g[0]] <= WHOLE_ROWS]:
                whole[g] = [np.array([1], dtype=np.int64)]
                del open_[g]
            if not open_:
                break
            for g, counts in _level_counts(rows, known, dict(open_), whole, upper, drawn, asked, width, seed, level):
                heap, features = open_[g], asked_features(open_[g], seed, g[1], bins[g[0]].features, asked[g[0]])
                stats = counts[:, 0].sum(axis=1)
                feature, cut, flip, a, b = _class_splits(counts, features, bins[g[0]])
                upper[g].append(Tree(heap, feature, cut, flip, stats))
                inner = feature >= 0
                below = np.stack([2 * heap[inner], 2 * heap[inner] + 1], axis=1).ravel()
                sides = np.stack([a[inner], b[inner]], axis=1).reshape(-1, 2)
                ends = _pure(sides) if level + 1 < depth else np.ones(len(below), bool)
                small = ~ends & (sides.sum(axis=1) <= WHOLE_ROWS)
                upper[g].append(_leaves(below[ends], sides[ends]))
                whole[g].append(below[small])
                open_[g] = below[~ends & ~small]
                if not len(open_[g]):
                    del open_[g]
        tops = {g: _joined(upper[g]) if upper[g] else None for g in group}
        asks = {g: np.sort(np.concatenate(whole[g])) if whole[g] else np.array([], dtype=np.int64) for g in group}
        lower = _lower_parts(rows, known, tops, asks, drawn, asked, width, seed, depths, sizes, row_bytes)
        for g in group:
            for d in depths:
                parts = [tops[g].rows(_depth(tops[g].heap) <= d)] if tops[g] is not None else []
                out[(*g, d)] = pruned(_joined(parts + lower.get((*g, d), [])), d)
    known.unpersist()
    return out


def _placed(tops: Tree | None, asks: np.ndarray) -> Tree:
    """The upper part with the nodes that are still to be grown as leaves."""
    return _joined([*([] if tops is None else [tops]), _leaves(asks, np.zeros((len(asks), 2)))])


def _level_counts(rows: RDD, known, open_: dict, whole: dict, upper: dict, drawn, asked: dict, width: int, seed: int, level: int):
    """`(tree, counts)` of the open nodes of one level."""
    sc, trees = rows.context, list(open_)
    while trees:
        some, nodes = [], 0
        while trees and (not some or nodes + len(open_[trees[0]]) <= LEVEL_NODES):
            nodes += len(open_[trees[0]])
            some.append(trees.pop(0))
        told = sc.broadcast({g: (_placed(_joined(upper[g]) if upper[g] else None, np.concatenate([open_[g], *whole[g]])), open_[g]) for g in some})

        def count(parts):
            sums: dict = {}
            for block in parts:
                mine = [g for g in told.value if g[0] == block["set"]]
                if not mine:
                    continue
                b = known.value[block["set"]]
                dense = _dense(block["codes"], block["flags"], b)
                for g in mine:
                    tree, heap = told.value[g]
                    w = drawn(block, g[1])
                    reached = tree.heap[_down(dense, tree, level)] if level else np.ones(len(w), dtype=np.int64)
                    slot = np.searchsorted(heap, reached)
                    slot[slot == len(heap)] = 0
                    at = np.nonzero((heap[slot] == reached) & (w > 0))[0]
                    counts = _counts(dense, at, slot[at], w[at], block["y"][at], asked_features(heap, seed, g[1], b.features, asked[g[0]]), width)
                    sums[g] = sums[g] + counts if g in sums else counts
            yield sums

        total: dict = {}
        for part in rows.mapPartitions(count).collect():
            for g, counts in part.items():
                total[g] = total[g] + counts if g in total else counts
        told.unpersist()
        yield from total.items()


def _lower_parts(rows: RDD, known, tops: dict, asks: dict, drawn, asked: dict, width: int, seed: int, depths: list[int], sizes: dict, row_bytes: int) -> dict:
    """Pruned lower parts by (set, tree, depth): the rows of each small node meet in one task."""
    sc, depth = rows.context, max(depths)
    if not any(len(a) for a in asks.values()):
        return {}
    told = sc.broadcast({g: (_placed(tops[g], asks[g]), asks[g]) for g in asks if len(asks[g])})

    def deal(block):
        b = known.value[block["set"]]
        dense = _dense(block["codes"], block["flags"], b)
        for g, (tree, heap) in told.value.items():
            if g[0] != block["set"]:
                continue
            w = drawn(block, g[1])
            reached = tree.heap[_down(dense, tree, depth)]
            slot = np.searchsorted(heap, reached)
            slot[slot == len(heap)] = 0
            at = np.nonzero((heap[slot] == reached) & (w > 0))[0]
            at = at[np.argsort(slot[at], kind="stable")]
            ends = np.searchsorted(slot[at], np.arange(len(heap) + 1))
            for h, i, j in zip(heap.tolist(), ends[:-1], ends[1:]):
                if j > i:
                    q = at[i:j]
                    yield (*g, h), (block["codes"][q], block["flags"][q], block["y"][q], w[q])

    def grow(item):
        (s, t, h), parts = item
        b, parts = known.value[s], list(parts)
        dense = np.concatenate([_dense(codes, flags, b) for codes, flags, *_ in parts])
        y, w = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
        tree = grow_whole(dense, y, w, h, seed, t, asked[s], depth, b, width)
        start = int(_depth(np.array([h]))[0])
        for d in depths:
            if start <= d:
                yield (s, t, d), _small(pruned(tree, d))

    dealt = sum(sizes[s] for s, _ in asks) * row_bytes
    partitions = max(4 * sc.defaultParallelism, dealt // 16_000_000)
    out: dict = {}
    for key, tree in rows.flatMap(deal).groupByKey(int(partitions)).flatMap(grow).collect():
        out.setdefault(key, []).append(Tree(tree.heap, tree.feature.astype(np.int64), tree.cut.astype(np.int64), tree.flip, tree.stats.astype(float)))
    told.unpersist()
    return out


def _small(tree: Tree) -> Tree:
    return Tree(tree.heap, tree.feature.astype(np.int32), tree.cut.astype(np.uint8), tree.flip, tree.stats.astype(np.int32))


# Boosting


def _layout(bins: Bins) -> tuple[np.ndarray, int]:
    """Where the cells of each number begin; indicators and one further cell follow them."""
    sizes = np.array([len(t) + 1 for t in bins.thresholds], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    return starts, int(starts[-1]) + len(bins.flags) + 1


def _sums(block: dict, at, slot: np.ndarray, k: int, r: np.ndarray, bins: Bins) -> np.ndarray:
    """`(slot, cell, 2)`: number and sum of the values."""
    starts, cells = _layout(bins)
    codes, flags = (block[n] if at is None else block[n][at] for n in ("codes", "flags"))
    out = np.zeros((k, cells, 2))
    for j in range(len(bins.numbers)):
        size = int(starts[j + 1] - starts[j])
        cell = codes[:, j].astype(np.int64) if k == 1 else slot * size + codes[:, j]
        out[:, starts[j]:starts[j + 1], 0] = np.bincount(cell, minlength=k * size).reshape(k, size)
        out[:, starts[j]:starts[j + 1], 1] = np.bincount(cell, r, k * size).reshape(k, size)
    size = len(bins.flags) + 1
    for j in range(flags.shape[1]):
        cell = flags[:, j].astype(np.int64) if k == 1 else slot * size + flags[:, j]
        out[:, starts[-1]:, 0] += np.bincount(cell, minlength=k * size).reshape(k, size)
        out[:, starts[-1]:, 1] += np.bincount(cell, r, k * size).reshape(k, size)
    return out


def _squares(node: np.ndarray, k: int, r: np.ndarray) -> np.ndarray:
    return np.stack([np.bincount(node, minlength=k), np.bincount(node, r, k), np.bincount(node, r * r, k)], axis=1)


def _value_splits(sums: np.ndarray, node: np.ndarray, bins: Bins):
    """`(feature or -1, cut, flip, left, right)`; sides as number and sum. Candidates come in order of features."""
    starts, _ = _layout(bins)
    k, n, s = len(sums), node[:, 0], node[:, 1]
    gains, where = [], []
    for i in range(bins.features):
        j = np.searchsorted(bins.numbers, i)
        if j < len(bins.numbers) and bins.numbers[j] == i:
            left = np.cumsum(sums[:, starts[j]:starts[j + 1]], axis=1)[:, :-1]
        else:
            at = starts[-1] + int(np.searchsorted(bins.flags, i))
            left = node[:, None, :2] - sums[:, at:at + 1]
        if left.shape[1]:
            where += [(i, c) for c in range(left.shape[1])]
            gains.append(left)
    left = np.concatenate(gains, axis=1)
    right = node[:, None, :2] - left
    ok = (left[..., 0] > 0.5) & (right[..., 0] > 0.5)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = (left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - (s * s / n)[:, None]) / n[:, None]
    gain = np.where(ok, gain, -1.0)
    # Candidates that are equal but for rounding count as equal, and the first one is taken.
    top = gain.max(axis=1)
    best = (gain >= (top - 1e-13 * np.abs(node[:, 2] / n))[:, None]).argmax(axis=1)
    q = np.arange(k)
    where = np.array(where, dtype=np.int64)
    split = (top > 1e-15) & (np.abs(_impurities(node)) >= _EPSILON)
    feature, cut = np.where(split, where[best, 0], -1), where[best, 1]
    a, b = left[q, best].copy(), right[q, best].copy()
    with np.errstate(divide="ignore", invalid="ignore"):
        flip = np.isin(feature, bins.flags) & (b[:, 1] / b[:, 0] < a[:, 1] / a[:, 0])
    a[flip], b[flip] = b[flip], a[flip].copy()
    return feature, cut, flip, a, b


def _goes(block: dict, tree: Tree, levels: int, bins: Bins) -> np.ndarray:
    """Place of the node that each row reaches, from the packed rows."""
    codes, flags, left = block["codes"], block["flags"], tree.left
    number = np.zeros(bins.features, dtype=np.int64)
    number[bins.numbers] = np.arange(len(bins.numbers))
    flag = np.full(bins.features, -1, dtype=np.int64)
    flag[bins.flags] = np.arange(len(bins.flags))
    is_flag = np.append(flag, -1)[tree.feature] >= 0
    column, wanted = number[tree.feature], np.where(is_flag, flag[tree.feature], len(bins.flags) + 1).astype(np.uint16)
    flat, base = codes.ravel(), np.arange(len(codes)) * codes.shape[1]
    node = np.zeros(len(codes), dtype=np.int64)
    for _ in range(levels):
        right = flat[base + column[node]] > tree.cut[node]
        met = is_flag[node]
        if met.any():
            set_ = (flags == wanted[node][:, None]).any(axis=1)
            right = np.where(met, set_, right)
        right = right != tree.flip[node]
        below = left[node]
        node = np.where(below >= 0, below + right, node)
    return node


def boost(rows: RDD, bins: dict[int, Bins], fits: list[tuple[int, int]], rounds: int, step: float) -> dict[tuple[int, int], list[Tree]]:
    """Trees by (set of rows, depth), all grown side by side; the logistic loss as in Spark, labels -1 and 1, a first tree of full weight."""
    sc, known = rows.context, rows.context.broadcast(bins)
    done: dict[tuple[int, int], list[Tree]] = {f: [] for f in fits}

    def start(block):
        sign = 2.0 * block["y"] - 1
        mine = [f for f in fits if f[0] == block["set"]]
        return {**block, "margin": {f: np.zeros(len(sign)) for f in mine}, "rest": {f: sign for f in mine}}

    state = rows.map(start).persist(StorageLevel.MEMORY_AND_DISK)
    stored = []
    for t in range(rounds):
        grown: dict[tuple[int, int], Tree] = {}
        open_, parents = {f: np.array([1], dtype=np.int64) for f in fits}, {}
        for level in range(max(d for _, d in fits) + 1):
            # Counted are the nodes that are asked for; their siblings are what remains of the parent.
            asked = {f: h for f, h in open_.items() if len(h)}
            if not asked:
                break
            counted = {f: h if level == 0 else np.where(parents[f]["less"], h[0::2], h[1::2]) for f, h in asked.items()}
            got = _level_sums(state, known, grown, asked, counted, level)
            for f, (sums, node) in got.items():
                heap, b = asked[f], bins[f[0]]
                if level and sums is not None:
                    whole = np.empty((len(heap), *sums.shape[1:]))
                    less = parents[f]["less"]
                    first = np.arange(0, len(heap), 2)
                    whole[first + ~less], whole[first + less] = sums, parents[f]["sums"] - sums
                    sums = whole
                if level == f[1] or sums is None:
                    feature, cut, flip = np.full(len(heap), -1), np.zeros(len(heap), np.int64), np.zeros(len(heap), bool)
                else:
                    feature, cut, flip, a, c = _value_splits(sums, node, b)
                inner = feature >= 0
                part = Tree(heap, feature, cut, flip, node)
                grown[f] = part if f not in grown else _joined([grown[f], part])
                open_[f] = np.stack([2 * heap[inner], 2 * heap[inner] + 1], axis=1).ravel()
                if inner.any():
                    parents[f] = {"less": (a[:, 0] <= c[:, 0])[inner], "sums": sums[inner]}
        trees = {f: pruned(tree, f[1]) for f, tree in grown.items()}
        for f in fits:
            done[f].append(trees[f])
        if t + 1 < rounds:
            told = sc.broadcast(trees)

            def add(block, told=told, weight=1.0 if t == 0 else step):
                sign = 2.0 * block["y"] - 1
                margin, rest = dict(block["margin"]), {}
                for f in margin:
                    tree = told.value[f]
                    margin[f] = margin[f] + weight * _predictions(tree.stats)[_goes(block, tree, f[1], known.value[f[0]])]
                    rest[f] = 4.0 * sign / (1.0 + np.exp(2.0 * sign * margin[f]))
                return {**block, "margin": margin, "rest": rest}

            new = state.map(add)
            if t % STORED_ROUNDS == STORED_ROUNDS - 1:
                path = scratch_path(SparkSession.active(), "margins")
                new.saveAsPickleFile(path, 1)
                new = sc.pickleFile(path)
            new.persist(StorageLevel.MEMORY_AND_DISK)
            stored.append((state, told))
            state = new
            if len(stored) > 1:  # its successor has been counted by now
                old, gone = stored.pop(0)
                old.unpersist()
    state.unpersist()
    for old, _ in stored:
        old.unpersist()
    known.unpersist()
    return done


def _level_sums(state: RDD, known, grown: dict, asked: dict, counted: dict, level: int) -> dict:
    """`(sums of the counted nodes, number, sum and squares of all asked nodes)` by fit; a fit's last level has no sums."""
    sc = state.context
    told = sc.broadcast({f: (None if level == 0 else _joined([grown[f], _leaves(h, np.zeros((len(h), 3)))]), h, counted[f]) for f, h in asked.items()})

    def count(parts):
        total: dict = {}
        for block in parts:
            for f in block["rest"]:
                if f not in told.value:
                    continue
                tree, heap, some = told.value[f]
                b, r = known.value[f[0]], block["rest"][f]
                if tree is None:
                    mine = (_sums(block, None, None, 1, r, b), _squares(np.zeros(len(r), np.int64), 1, r))
                else:
                    place = np.full(len(tree.heap), -1, dtype=np.int64)
                    place[np.searchsorted(tree.heap, heap)] = np.arange(len(heap))
                    node = place[_goes(block, tree, level, b)]
                    at = np.nonzero(node >= 0)[0]
                    node = node[at]
                    squares = _squares(node, len(heap), r[at])
                    sums = None
                    if level < f[1]:
                        to = np.full(len(heap), -1, dtype=np.int64)
                        to[np.searchsorted(heap, some)] = np.arange(len(some))
                        slot = to[node]
                        kept = slot >= 0
                        at, slot = at[kept], slot[kept]
                        sums = _sums(block, at, slot, len(some), r[at], b)
                    mine = (sums, squares)
                total[f] = mine if f not in total else tuple(None if x is None else x + z for x, z in zip(total[f], mine))
        yield total

    out: dict = {}
    for part in state.mapPartitions(count).collect():
        for f, mine in part.items():
            out[f] = mine if f not in out else tuple(None if x is None else x + z for x, z in zip(out[f], mine))
    told.unpersist()
    return out


# Models


_OF_A_TREE = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB", "minInfoGain",
              "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed", "probabilityCol", "rawPredictionCol", "thresholds"}


def _node_rows(tree: Tree, bins: Bins) -> pa.Table:
    """Nodes as Spark stores them, numbered with all that is on the left before what is on the right."""
    at, left, inner = _depth(tree.heap), tree.left, tree.feature >= 0
    size, number = np.ones(len(at), dtype=np.int64), np.zeros(len(at), dtype=np.int64)
    for level in range(int(at.max()) - 1, -1, -1):
        q = np.nonzero((at == level) & inner)[0]
        size[q] += size[left[q]] + size[left[q] + 1]
    for level in range(int(at.max())):
        q = np.nonzero((at == level) & inner)[0]
        number[left[q]] = number[q] + 1
        number[left[q] + 1] = number[q] + 1 + size[left[q]]
    impurity, count = _impurities(tree.stats), tree.stats.sum(axis=1) if tree.stats.shape[1] == 2 else tree.stats[:, 0]
    gain = np.full(len(at), -1.0)
    a = left[inner]
    gain[inner] = impurity[inner] - count[a] / count[inner] * impurity[a] - count[a + 1] / count[inner] * impurity[a + 1]
    flag, cuts = np.isin(tree.feature, bins.flags), []
    number_of = {int(i): t for i, t in zip(bins.numbers, bins.thresholds)}
    for f, c, flip, is_flag in zip(tree.feature.tolist(), tree.cut.tolist(), tree.flip.tolist(), flag.tolist()):
        cuts.append([] if f < 0 else [float(flip)] if is_flag else [float(number_of[f][c])])
    i32 = lambda v: pa.array(np.asarray(v).astype(np.int32))
    split = pa.StructArray.from_arrays([i32(tree.feature), pa.array(cuts, pa.list_(pa.float64())), i32(np.where(flag & inner, 2, -1))],
                                       ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    child = lambda right: i32(np.where(inner, number[left + right], -1))
    table = pa.table({"id": i32(number), "prediction": _predictions(tree.stats), "impurity": impurity,
                      "impurityStats": pa.array(list(tree.stats.astype(float)), pa.list_(pa.float64())), "rawCount": pa.array(np.rint(count).astype(np.int64)),
                      "gain": gain, "leftChild": child(0), "rightChild": child(1), "split": split})
    return table.take(np.argsort(number))


def as_model(spark: SparkSession, estimator: Estimator, trees: list[Tree], bins: Bins) -> Model:
    """Spark's model of the trees, with the estimator's parameters; written as its own writer does and read by its own reader."""
    path, single, boosted = scratch_path(spark, "model"), isinstance(estimator, DecisionTreeClassifier), isinstance(estimator, GBTClassifier)
    estimator.write().save(f"{path}/asked")
    told = json.loads(spark.read.text(f"{path}/asked/metadata").first()[0])
    kind = told["class"].removesuffix("Classifier").rsplit(".", 1)[1]
    told |= {"class": f"org.apache.spark.ml.classification.{kind}ClassificationModel", "numFeatures": bins.features}
    told |= {} if boosted else {"numClasses": 2}
    told |= {} if single else {"numTrees": len(trees)}
    parts = []
    for t, tree in enumerate(trees):
        nodes = _node_rows(tree, bins)
        if not single:
            nodes = pa.table({"treeID": pa.array(np.full(len(nodes), t, dtype=np.int32)), "nodeData": nodes.to_struct_array().combine_chunks()})
        parts.append(nodes)
    spark.createDataFrame(pa.concat_tables(parts)).write.parquet(f"{path}/model/data")
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    if not single:
        cls = "regression.DecisionTreeRegressionModel" if boosted else "classification.DecisionTreeClassificationModel"
        mine = _OF_A_TREE - ({"probabilityCol", "rawPredictionCol", "thresholds"} if boosted else set())
        one = {k: told[k] for k in ("timestamp", "sparkVersion")} | {"class": f"org.apache.spark.ml.{cls}"} | {
            k: {p: v for p, v in told[k].items() if p in mine} for k in ("paramMap", "defaultParamMap")}
        rows = [(t, json.dumps(one | {"uid": f"{'dtr' if boosted else 'dtc'}_{told['uid'].rsplit('_', 1)[1]}_{t}"}),
                 float(estimator.getStepSize()) if boosted and t else 1.0) for t in range(len(trees))]
        spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")
    model = DefaultParamsReader.loadParamsInstance(f"{path}/model", spark.sparkContext)
    model.grown_at = f"{path}/model"
    return model


def copied(model: Model, path: str) -> bool:
    """Whether the model's files were copied to `path`; only a grown model has files, which spares the driver writing all nodes anew."""
    source = getattr(model, "grown_at", None)
    if source is None:
        return False
    spark = SparkSession.active()
    conf, paths = spark._jsc.hadoopConfiguration(), [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, path)]
    systems = [p.getFileSystem(conf) for p in paths]
    systems[1].delete(paths[1], True)
    return spark._jvm.org.apache.hadoop.fs.FileUtil.copy(systems[0], paths[0], systems[1], paths[1], False, conf)


# Searches


def _plan(estimator: Estimator, grid: list) -> tuple[int, list[int], list[tuple[int, int]]]:
    """Most trees or rounds, depths, and `(trees, depth)` of every grid point."""
    asked = []
    for point in grid or [{}]:
        e = estimator.copy(point)
        asked.append((1 if isinstance(e, DecisionTreeClassifier) else e.getMaxIter() if isinstance(e, GBTClassifier) else e.getNumTrees(), e.getMaxDepth()))
    return max(n for n, _ in asked), sorted({d for _, d in asked}), asked


def grow(rows: dict[int, DataFrame], estimator: Estimator, grid: list) -> tuple[dict[int, Bins], dict[tuple[int, int], list[Tree]]]:
    """Bins by set of rows, and trees by (set, depth), of all that the grid asks for."""
    most, depths, _ = _plan(estimator, grid)
    sizes = {s: df.count() for s, df in rows.items()}
    bins = {s: learn_bins(df, estimator, sizes[s]) for s, df in rows.items()}
    spark = next(iter(rows.values())).sparkSession
    packed = spark.sparkContext.union([blocks(df, estimator, bins[s], s) for s, df in rows.items()]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if isinstance(estimator, GBTClassifier):
            return bins, boost(packed, bins, [(s, d) for s in rows for d in depths], most, estimator.getStepSize())
        found = grow_forest(packed, bins, sizes, most, depths, estimator.getSeed(), isinstance(estimator, RandomForestClassifier))
        return bins, {(s, d): [found[s, t, d] for t in range(most)] for s in rows for d in depths}
    finally:
        packed.unpersist()


def fit(estimator: Estimator, rows: DataFrame) -> Model:
    """A model of the rows, which hold `KEY`."""
    bins, trees = grow({0: rows}, estimator, [{}])
    return as_model(rows.sparkSession, estimator, trees[0, estimator.getMaxDepth()], bins[0])


def point_scores(rows: DataFrame, estimator: Estimator, points: list[tuple[int, int]], bins: Bins, trees: dict[int, list[Tree]]) -> DataFrame:
    """`(label, score_0, ...)`: a score for each (number of trees, depth)."""
    told = rows.sparkSession.sparkContext.broadcast((bins, trees))
    boosted, step = isinstance(estimator, GBTClassifier), estimator.getStepSize() if isinstance(estimator, GBTClassifier) else 0.0
    names = [estimator.getLabelCol(), *[f"score_{i}" for i in range(len(points))]]

    def score(batches):
        bins, trees = told.value
        for batch in batches:
            dense = _dense(*_binned(_vectors(batch), bins), bins)
            at: dict[tuple[int, int], np.ndarray] = {}
            for depth in {d for _, d in points}:
                wanted, total = {n for n, d in points if d == depth}, np.zeros(len(dense))
                for t in range(max(wanted)):
                    tree = trees[depth][t]
                    leaf = _predictions(tree.stats) if boosted else tree.stats[:, 1] / tree.stats.sum(axis=1)
                    total += leaf[_down(dense, tree, depth)] * (step if boosted and t else 1.0)
                    if t + 1 in wanted:
                        at[t + 1, depth] = 1 / (1 + np.exp(-2 * total)) if boosted else total / (t + 1)
            yield pa.RecordBatch.from_arrays([batch.column("y"), *[pa.array(at[p]) for p in points]], names)

    columns = rows.select(vector_to_array(estimator.getFeaturesCol()).alias("x"), F.col(estimator.getLabelCol()).cast("double").alias("y"))
    return columns.mapInArrow(score, ", ".join(f"`{c}` double" for c in names))


def search(estimator: Estimator, grid: list, held: DataFrame, evaluator, folds: int, fold: str, refit: bool):
    """`(fold values by point, best point, its model of all rows or None, its models without each fold)`."""
    spark = held.sparkSession
    points = _plan(estimator, grid)[2]
    sets = {k: held.filter(F.col(fold) != k) for k in range(folds)}
    bins, trees = grow(sets, estimator, grid)
    values = np.full((len(grid), folds), np.nan)
    for k in range(folds):
        scores = point_scores(held.filter(F.col(fold) == k), estimator, points, bins[k], {d: trees[k, d] for _, d in points}).persist()
        judge = evaluator.copy()
        for g in range(len(grid)):
            values[g, k] = judge.setRawPredictionCol(f"score_{g}").evaluate(scores)
        scores.unpersist()
    best = int(np.argmax(values.mean(axis=1)))
    count, depth = points[best]
    chosen = estimator.copy(grid[best])
    models = [as_model(spark, chosen, trees[k, depth][:count], bins[k]) for k in range(folds)]
    return values, best, fit(chosen, held) if refit else None, models
