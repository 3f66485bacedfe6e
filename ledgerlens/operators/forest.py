"""Random forests grown to the end: whole trees in tasks that hold all coded rows, or large nodes by histograms over all tasks.

Spark's `RandomForestClassifier` sends statistics of every node of every tree from every task and passes over all rows for each
level, which for 200 trees of depth 30 is most of its time: the deep nodes hold a few rows each. Here a row is a byte for each feature,
and up to `WHOLE_ROWS` rows go once to each of some tasks, which draw from them and grow one tree after the other. Of more rows, nodes
of more than `LOCAL_ROWS` are split by histograms; the rows of any smaller node are shuffled to one group, which grows the rest.

Trees grown to the end have about a node for every two rows, so a forest may be larger than the driver: it stays in the shared folder, a row
for each tree (`StoredForest`). Rows are scored where blocks of rows and of trees meet. Up to `DRIVER_NODES` nodes the model is Spark's own,
read from its file format; in that format a forest of any size is saved.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.util import MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import delete_folder, scratch_path, shuffles_dropped

#: Rows up to which a task holds all of them and grows whole trees.
WHOLE_ROWS = 1_000_000
#: Beyond that, drawn rows up to which a node is grown to the end in one group.
LOCAL_ROWS = 100_000
#: Nodes up to which a forest is scored by Spark's own model, which lies on the driver and travels with the tasks.
DRIVER_NODES = 500_000
#: Rows and trees that are scored against each other in one group.
_SCORED_ROWS, _SCORED_TREES = 100_000, 25
# Drawn rows that are shuffled to groups at once.
_DRAWN_AT_ONCE = 25_000_000
# Bins of a feature, as in Spark.
BINS = 32
# Nodes whose histograms are held at once, and groups that share a task.
_NODES, _GROUPS = 2048, 4
_QUANTILES = 1000
# More draws than this have a chance below 1e-10.
_MOST_DRAWS = 12
_FOUND = "g int, feature int, bin int, gain double, l0 double, l1 double, r0 double, r1 double"
_NODE = (
    "treeID int, nodeData struct<id: int, prediction: double, impurity: double, impurityStats: array<double>, rawCount: bigint, gain: double, "
    "leftChild: int, rightChild: int, split: struct<featureIndex: int, leftCategoriesOrThreshold: array<double>, numCategories: int>>"
)
_GROWN = "g int, id int, c0 double, c1 double, gain double, feature int, bin int, left int, right int"


def poisson(bits: Column) -> Column:
    """52 random bits as a draw from the Poisson distribution with mean 1."""
    uniform, total, count = bits / F.lit(float(1 << 52)), 0.0, F.lit(0)
    for k in range(_MOST_DRAWS):
        total += math.exp(-1) / math.factorial(k)
        count = count + (uniform >= total).cast("int")
    return count


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(_MOST_DRAWS)])


def value_draws(key: str) -> Column:
    """Draws of a row for `tree` from a 64-bit hash of its values; equal rows are drawn together."""
    return poisson(F.shiftrightunsigned(F.xxhash64(key, "tree"), 12))


def _poisson_of(bits: np.ndarray) -> np.ndarray:
    return np.searchsorted(_POISSON, bits / float(1 << 52), "right").astype(np.uint8)


_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def hashed_draws(keys: np.ndarray, tree: int) -> np.ndarray:
    """`value_draws` of 64-bit keys: Spark's xxhash64 of a long and an int."""
    with np.errstate(over="ignore"):
        h = np.uint64(42) + _P5 + np.uint64(8)
        h = _mixed(_rotated(h ^ (_rotated(keys.astype(np.int64).view(np.uint64) * _P2, 31) * _P1), 27) * _P1 + _P4)
        h = _mixed(_rotated((h + _P5 + np.uint64(4)) ^ (np.uint64(tree) * _P1), 23) * _P2 + _P3)
    return _poisson_of(h >> np.uint64(12))


def named_draws(keys: list[bytes], tree: int, seed: int) -> np.ndarray:
    """As `bagging.draws`: by the first 52 bits of md5 of key, seed and tree."""
    after, md5 = f"#{seed}#{tree}".encode(), hashlib.md5
    return _poisson_of(np.frombuffer(b"".join([md5(k + after).digest()[:8] for k in keys]), ">u8").astype(np.uint64) >> np.uint64(12))


@dataclass(frozen=True)
class Draws:
    """How often a row is drawn, by its column `key`: as an expression of the column `tree`, and the same for an array of keys and one tree."""

    key: str
    column: Column
    of: Callable[[object, int], np.ndarray]


def draws_by_value(key: str) -> Draws:
    return Draws(key, value_draws(key), lambda keys, tree: hashed_draws(keys.to_numpy(), tree))


def draws_by_name(key: str, column: Column, seed: int) -> Draws:
    return Draws(key, column, lambda keys, tree: named_draws(keys.cast(pa.binary()).to_pylist(), tree, seed))


@dataclass(frozen=True)
class _Top:
    """The nodes that were split over all tasks, root of tree t at place t; a feature of -1 ends the way down."""

    feature: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray

    def place(self, tree: np.ndarray, x: np.ndarray) -> np.ndarray:
        at, rows = tree.astype(np.int64), np.arange(len(tree))
        while (self.feature[at] >= 0).any():
            inner = self.feature[at] >= 0
            low = x[rows, np.maximum(self.feature[at], 0)] <= self.bin[at]
            at = np.where(inner, np.where(low, self.left[at], self.right[at]), at)
        return at


def _candidates(df: DataFrame, width: int) -> list[np.ndarray]:
    """Thresholds of each feature: every value if few, else quantiles; never the largest, which splits nothing."""
    probs = [i / _QUANTILES for i in range(_QUANTILES + 1)]
    sketches = df.select(F.posexplode("x").alias("j", "v")).groupBy("j").agg(F.percentile_approx("v", probs, 10_000).alias("q"))
    # A row for each feature.
    found = {r["j"]: r["q"] for r in sketches.collect()}
    thresholds = []
    for values in (found.get(j) for j in range(width)):
        dense = np.unique(np.array(values or [], float))[:-1]
        if len(dense) >= BINS:
            even = np.array(values, float)[np.arange(1, BINS) * _QUANTILES // BINS]
            dense = np.unique(even[even <= dense[-1]])
        thresholds.append(dense)
    return thresholds


def _binned(df: DataFrame, thresholds: list[np.ndarray]) -> DataFrame:
    """`x` as one byte for each feature: the number of thresholds below the value."""
    rest = [c for c in df.columns if c != "x"]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = _codes(batch.column(len(rest)).flatten().to_numpy().reshape(batch.num_rows, -1), thresholds)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], coded], [*rest, "x"])

    types = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), "x binary"])
    return df.select(*rest, "x").mapInArrow(code, types)


def _codes(x: np.ndarray, thresholds: list[np.ndarray]) -> pa.Array:
    """The bins of each row as one value of so many bytes."""
    bins = np.empty(x.shape, np.uint8)
    for j, t in enumerate(thresholds):
        bins[:, j] = np.searchsorted(t, x[:, j], "left")
    ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(bins)])


def _bytes(column: pa.Array, width: int) -> np.ndarray:
    """The bins of all rows, which lie one after the other."""
    parts = []
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        wide, size = part.type == pa.large_binary(), len(part)
        ends = np.frombuffer(part.buffers()[1], np.int64 if wide else np.int32)[part.offset:part.offset + size + 1]
        if size:
            parts.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0]:ends[-1]].reshape(-1, width))
    return np.concatenate(parts) if parts else np.empty((0, width), np.uint8)


def _histogram(node: np.ndarray, nodes: int, pick: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weight by node, chosen feature, bin and class."""
    slots = pick.shape[1]
    at = ((node[:, None] * slots + np.arange(slots)) * BINS + x[np.arange(len(x))[:, None], pick[node]]) * 2 + y[:, None]
    return np.bincount(at.ravel(), np.repeat(w, slots), nodes * slots * BINS * 2).reshape(nodes, slots, BINS, 2)


def _best(hist: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(slot, bin, gain, left counts, right counts) of the split with the greatest gain of Gini impurity; no gain: no split."""
    left = hist.cumsum(2)
    total = left[:, :, -1:, :]
    right = total - left
    n_left, n_right = left.sum(3), right.sum(3)
    allowed = (n_left >= max(least, 1)) & (n_right >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = np.where(allowed, (left**2).sum(3) / n_left + (right**2).sum(3) / n_right, -1.0).reshape(len(hist), -1)
    place, rows = purity.argmax(1), np.arange(len(hist))
    whole = total[:, 0, 0, :]
    n = np.maximum(whole.sum(1), 1)
    gain = purity[rows, place] / n - (whole**2).sum(1) / n**2
    gain[(purity[rows, place] < 0) | (gain < 1e-12)] = 0.0
    slot, bin_ = place // BINS, place % BINS
    return slot, bin_, gain, left[rows, slot, bin_], right[rows, slot, bin_]


def _choice(generator: np.random.Generator, nodes: int, width: int, mtry: int) -> np.ndarray:
    return generator.random((nodes, width)).argsort(1)[:, :mtry]


def _best_of_few(node: np.ndarray, pick: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slot, bin, gain) as `_best`, for nodes of so few rows that most bins are empty: only bins with rows are looked at, in order."""
    slots, nodes = pick.shape[1], len(pick)
    kind = np.int32 if nodes * slots * BINS * 32 < 2**31 else np.int64
    key = (node.astype(kind)[:, None] * kind(slots) + np.arange(slots, dtype=kind)) * kind(BINS) + x[np.arange(len(x))[:, None], pick[node]]
    key = np.sort((key * kind(32) + (y * 16 + w).astype(kind)[:, None]).ravel())
    weight, cell = key & 15, key >> 5
    last = np.append(np.flatnonzero(cell[1:] != cell[:-1]), len(cell) - 1)
    whole, ones = weight.cumsum(dtype=np.int64)[last], (weight * (key >> 4 & 1)).cumsum(dtype=np.int64)[last]
    cell = cell[last]
    group = cell // BINS
    ends = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
    before, size = [np.append(0, a[ends[:-1]]) for a in (whole, ones)], np.diff(np.append(-1, ends))
    all_, one = (np.repeat(a[ends] - b, size).astype(float) for a, b in zip((whole, ones), before, strict=True))
    left, left1 = ((a - np.repeat(b, size)).astype(float) for a, b in zip((whole, ones), before, strict=True))
    right, right1 = all_ - left, one - left1
    allowed = (left >= max(least, 1)) & (right >= max(least, 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = np.where(allowed, ((left - left1) ** 2 + left1**2) / left + ((right - right1) ** 2 + right1**2) / right, -1.0)
    owner = group // slots
    starts = np.append(0, np.flatnonzero(owner[1:] != owner[:-1]) + 1)
    most = np.maximum.reduceat(purity, starts)
    at = np.flatnonzero(purity == np.repeat(most, np.diff(np.append(starts, len(owner)))))
    at = at[np.append(True, owner[at][1:] != owner[at][:-1])]
    n, n1 = all_[starts], one[starts]
    gain = most / n - ((n - n1) ** 2 + n1**2) / n**2
    gain[(most < 0) | (gain < 1e-12)] = 0.0
    return group[at] % slots, cell[at] % BINS, gain


def _best_split(node: np.ndarray, pick: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    nodes = len(pick)
    if nodes * BINS > 2 * len(node) and w.max(initial=0) < 16:
        return _best_of_few(node, pick, x, y, w, least)
    if nodes > _NODES:
        order = node.argsort(kind="stable")
        cuts = np.searchsorted(node[order], np.arange(0, nodes + _NODES, _NODES))
        parts = []
        for k, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            some = order[lo:hi]
            parts.append(_best_split(node[some] - k * _NODES, pick[k * _NODES:(k + 1) * _NODES], x[some], y[some], w[some], least))
        return tuple(np.concatenate(p) for p in zip(*parts, strict=True))
    hist = np.zeros((nodes, pick.shape[1], BINS, 2))
    for lo in range(0, len(node), 100_000):
        hi = lo + 100_000
        hist += _histogram(node[lo:hi], nodes, pick, x[lo:hi], y[lo:hi], w[lo:hi].astype(float))
    return _best(hist, least)[:3]


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, mtry: int, depth: int, least: int, generator: np.random.Generator) -> dict[str, np.ndarray]:
    """Nodes of one tree, level by level; leaves have feature -1. Like Spark's, sister leaves of one class are their parent."""
    levels, start, node = [], 0, np.zeros(len(y), np.int64)
    y, w, nodes = y.astype(np.int64), w.astype(np.int64), 1
    for level in range(depth + 1):
        counts = np.bincount(node * 2 + y, w, nodes * 2).reshape(nodes, 2)
        feature, bin_, gain = np.full(nodes, -1), np.zeros(nodes, np.int64), np.full(nodes, -1.0)
        open_ = np.flatnonzero((counts.min(1) > 0) & (level < depth))
        if len(open_):
            if len(open_) < nodes:
                place = np.full(nodes, -1)
                place[open_] = np.arange(len(open_))
                kept = np.flatnonzero(place[node] >= 0)
                x, y, w, node, at = x[kept], y[kept], w[kept], node[kept], place[node[kept]]
            else:
                at = node
            pick = _choice(generator, len(open_), x.shape[1], mtry)
            slot, cut, won = _best_split(at, pick, x, y, w, least)
            split = won > 0
            feature[open_[split]] = pick[np.arange(len(open_)), slot][split]
            bin_[open_[split]], gain[open_[split]] = cut[split], won[split]
        inner = feature >= 0
        rank = np.where(inner, inner.cumsum() - 1, -1)
        child = start + nodes + 2 * rank
        levels.append({
            "c0": counts[:, 0], "c1": counts[:, 1], "gain": gain, "feature": feature, "bin": bin_,
            "left": np.where(inner, child, -1), "right": np.where(inner, child + 1, -1),
        })
        if not inner.any():
            break
        kept = inner[node]
        if not kept.all():
            x, y, w, node = x[kept], y[kept], w[kept], node[kept]
        node = 2 * rank[node] + (x[np.arange(len(x)), feature[node]] > bin_[node])
        start, nodes = start + nodes, 2 * int(inner.sum())
    tree = {k: np.concatenate([one[k] for one in levels]) for k in levels[0]}
    return _pruned(tree, np.concatenate([[0], np.cumsum([len(one["c0"]) for one in levels])]))


def _pruned(tree: dict[str, np.ndarray], cuts: np.ndarray) -> dict[str, np.ndarray]:
    says, reached = tree["c1"] > tree["c0"], np.zeros(len(tree["c0"]), bool)
    for lo, hi in reversed(list(zip(cuts[:-1], cuts[1:], strict=True))):
        at = lo + np.flatnonzero(tree["feature"][lo:hi] >= 0)
        one, other = tree["left"][at], tree["right"][at]
        same = at[(tree["feature"][one] < 0) & (tree["feature"][other] < 0) & (says[one] == says[other])]
        for name, value in (("feature", -1), ("left", -1), ("right", -1), ("gain", -1.0)):
            tree[name][same] = value
    reached[0] = True
    for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
        at = lo + np.flatnonzero(reached[lo:hi] & (tree["feature"][lo:hi] >= 0))
        reached[tree["left"][at]] = reached[tree["right"][at]] = True
    name = reached.cumsum() - 1
    for side in ("left", "right"):
        tree[side] = np.where(tree[side] >= 0, name[tree[side]], -1)
    return {k: v[reached] for k, v in tree.items()}


def _split_large(drawn: DataFrame, top: _Top, large: np.ndarray, width: int, mtry: int, least: int, seed: int) -> list:
    """The best split of each node in `large`: histograms per task, added up by node."""
    pick = np.concatenate([_choice(np.random.default_rng([seed, int(g)]), 1, width, mtry) for g in large])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hist = np.zeros((len(large), mtry, BINS, 2))
        for batch in batches:
            x, (tree, y, w) = _bytes(batch.column(3), width), (c.to_numpy() for c in batch.columns[:3])
            at = top.place(tree, x)
            place = np.searchsorted(large, at)
            mine = np.flatnonzero((place < len(large)) & (large[np.minimum(place, len(large) - 1)] == at))
            for some in np.array_split(mine, max(1, len(mine) // 50_000)):
                used, place_ = np.unique(place[some], return_inverse=True)
                if len(used):
                    hist[used] += _histogram(place_, len(used), pick[used], x[some], y[some], w[some].astype(float))
        for at in np.flatnonzero(hist.any(axis=(1, 2, 3))):
            yield pa.RecordBatch.from_arrays([pa.array([large[at]], pa.int32()), pa.array([hist[at].ravel().tobytes()], pa.binary())], ["g", "hist"])

    def choose(table: pa.Table) -> pa.Table:
        hist = sum(np.frombuffer(h, float) for h in table.column("hist").to_pylist()).reshape(1, mtry, BINS, 2)
        g = table.column("g")[0].as_py()
        slot, bin_, gain, left, right = _best(hist, least)
        feature = int(pick[np.searchsorted(large, g), slot[0]]) if gain[0] > 0 else -1
        values = [g, feature, int(bin_[0]), float(gain[0]), *map(float, left[0]), *map(float, right[0])]
        names = [field.split()[0] for field in _FOUND.split(", ")]
        kinds = [pa.int32()] * 3 + [pa.float64()] * 5
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, values, kinds, strict=True)})

    return drawn.mapInArrow(count, "g int, hist binary").groupBy("g").applyInArrow(choose, _FOUND).orderBy("g").collect()


# A tree: its nodes level by level, so the k-th inner one has the nodes 2 k + 1 and 2 k + 2 below it; counts by class.
_TREE = "tree int, nodes int, feature binary, bin binary, c0 binary, c1 binary"
_KINDS = {"feature": np.int16, "bin": np.uint8, "c0": np.int32, "c1": np.int32}


def _packed(tree: int, nodes: dict[str, np.ndarray]) -> pa.RecordBatch:
    columns = {c: pa.array([nodes[c].astype(k).tobytes()], pa.binary()) for c, k in _KINDS.items()}
    return pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()), "nodes": pa.array([len(nodes["feature"])], pa.int32()), **columns})


def _unpacked(batch: pa.RecordBatch | pa.Table, row: int) -> tuple[int, dict[str, np.ndarray]]:
    nodes = {c: np.frombuffer(batch.column(c)[row].as_py(), k) for c, k in _KINDS.items()}
    inner = nodes["feature"] >= 0
    return batch.column("tree")[row].as_py(), nodes | {"left": np.where(inner, 2 * inner.cumsum() - 1, -1)}


def _leaves(nodes: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The leaf of each row."""
    feature, bin_, left = nodes["feature"], nodes["bin"], nodes["left"]
    out, at, rows = np.empty(len(x), np.int64), np.zeros(len(x), np.int64), np.arange(len(x))
    while len(rows):
        tested = feature[at]
        inner = tested >= 0
        if not inner.all():
            out[rows[~inner]] = at[~inner]
            rows, at, tested = rows[inner], at[inner], tested[inner]
        at = left[at] + (x[rows, tested] > bin_[at])
    return out


def swapped_leaves(nodes: dict[str, np.ndarray], x: np.ndarray, donor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The leaf of each row, and (row, feature, leaf) wherever the row leaves that way with the donor's bin for one feature.

    A row goes another way only where its own way has a test of that feature that the donor's bin answers otherwise.
    """
    feature, bin_, left = nodes["feature"], nodes["bin"], nodes["left"]
    plain, at, rows = np.empty(len(x), np.int64), np.zeros(len(x), np.int64), np.arange(len(x))
    gone, parted = np.zeros(x.shape, bool), [(rows[:0], feature[:0], at[:0])]
    while len(rows):
        tested = feature[at]
        inner = tested >= 0
        if not inner.all():
            plain[rows[~inner]] = at[~inner]
            rows, at, tested = rows[inner], at[inner], tested[inner]
        cut, below = bin_[at], left[at]
        side, other = x[rows, tested] > cut, donor[rows, tested] > cut
        apart = np.flatnonzero((side != other) & ~gone[rows, tested])
        gone[rows[apart], tested[apart]] = True
        parted.append((rows[apart], tested[apart], below[apart] + other[apart]))
        at = below + side
    row, swapped, at = (np.concatenate(c) for c in zip(*parted, strict=True))
    leaf, open_ = at.copy(), np.arange(len(row))
    while len(open_):
        tested = feature[at]
        inner = tested >= 0
        if not inner.all():
            leaf[open_[~inner]] = at[~inner]
            open_, at, tested = open_[inner], at[inner], tested[inner]
        r = row[open_]
        value = np.where(tested == swapped[open_], donor[r, tested], x[r, tested])
        at = left[at] + (value > bin_[at])
    return plain, row, swapped, leaf


def _shares(nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Share of class 1 in each node, in units of 2^-52: whole numbers, so that sums do not depend on their order."""
    c0, c1 = nodes["c0"].astype(float), nodes["c1"].astype(float)
    return np.rint(c1 / np.maximum(c0 + c1, 1) * (1 << 52)).astype(np.int64)


class _ForestWriter(MLWriter):
    def __init__(self, forest: StoredForest) -> None:
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:  # noqa: N802
        self.forest._write(path)


class StoredForest(Transformer, MLWritable):
    """A fitted forest whose trees lie in a folder, a row each; only thresholds and parameters are here.

    Saved, it is Spark's own model and is loaded as such. `model` gives that model now, on the driver; what is not found here is asked there.
    """

    def __init__(self, spark, folder: str, thresholds: list[np.ndarray], pattern: RandomForestClassifier, count: int, nodes: int) -> None:
        super().__init__()
        self.spark, self.folder, self.thresholds, self.pattern, self.count, self.nodes = spark, folder, thresholds, pattern, count, nodes
        self._model: RandomForestClassificationModel | None = None

    @property
    def stored(self) -> DataFrame:
        return self.spark.read.schema(_TREE).parquet(f"{self.folder}/trees").filter(F.col("tree") < self.count)

    @property
    def trees(self) -> list:
        return self.model.trees

    @property
    def model(self) -> RandomForestClassificationModel:
        if self._model is None:
            path = scratch_path(self.spark, "model")
            self._write(path)
            self._model = RandomForestClassificationModel.load(path)
            delete_folder(self.spark, path)
        return self._model

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, at: int | slice):
        if not isinstance(at, slice):
            return self.trees[at]
        if at.start not in (None, 0) or at.step not in (None, 1):
            raise ValueError("a part of a forest is its first trees")
        return StoredForest(self.spark, self.folder, self.thresholds, self.pattern, len(range(self.count)[at]), self.nodes)

    def __getattr__(self, name: str):
        if name.startswith("_") or "_model" not in self.__dict__:
            raise AttributeError(name)
        return getattr(self.model, name)

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    def save(self, path: str) -> None:
        self.write().save(path)

    def drop(self) -> None:
        """Delete the stored trees."""
        delete_folder(self.spark, self.folder)

    def coded(self, df: DataFrame) -> DataFrame:
        """`x`, the last column, as bins."""
        return _binned(df, self.thresholds)

    def meet(self, rows: DataFrame, parts: int, score: Callable[[pa.Table, Iterator], pa.Table], schema: str, by: str = "x") -> DataFrame:
        """`score` of every block of rows, dealt by hash of the column `by`, and every block of trees: each row meets each tree once."""
        blocks = -(-self.count // _SCORED_TREES)
        cells = lambda part, block: (part * blocks + block).cast("int").alias("cell")
        part = F.pmod(F.xxhash64(by), F.lit(parts))
        each = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(cells(part, F.col("_b")), *rows.columns)
        trees = self.stored.withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        block = F.floor(F.col("tree") / _SCORED_TREES)
        trees = trees.select(cells(F.col("_p"), block), *[f.split()[0] for f in _TREE.split(", ")])

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            found = (_unpacked(right, k) for k in range(right.num_rows))
            return score(left, found)

        return each.groupBy("cell").cogroup(trees.groupBy("cell")).applyInArrow(meet, schema)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if self.nodes <= DRIVER_NODES:
            return self.model.transform(dataset)
        width, held = len(self.thresholds), [c for c in dataset.columns if c not in ("_code", "x")]
        # Rows of equal bins have equal scores: the bins are the key by which scores find their rows.
        x = vector_to_array("_features")
        codes = self.coded(dataset.select(x.alias("x"))).distinct()
        parts = max(1, -(-dataset.count() // _SCORED_ROWS))

        def score(rows: pa.Table, trees: Iterator) -> pa.Table:
            x = _bytes(rows.column("x"), width)
            total = np.zeros(len(x), np.int64)
            for _, nodes in trees:
                total += _shares(nodes)[_leaves(nodes, x)]
            return pa.table({"_code": rows.column("x"), "_votes": pa.array(total)})

        votes = self.meet(codes, parts, score, "_code binary, _votes long").groupBy("_code").agg(F.sum("_votes").alias("_votes"))
        named = self._coded_column(dataset, x)
        one = F.col("_votes") / F.lit(float(1 << 52))
        share = one / F.lit(float(self.count))
        return named.join(votes, "_code").select(
            *held, array_to_vector(F.array(F.lit(float(self.count)) - one, one)).alias("rawPrediction"),
            array_to_vector(F.array(1.0 - share, share)).alias("probability"), (share > 0.5).cast("double").alias("prediction"),
        )

    def swapped_scores(self, paired: DataFrame) -> DataFrame:
        """(id, truth, v0, v1, ...): the share of class 1 for rows (id, truth, d, x) of bins `x`, then with the bins `d` in place of each feature."""
        width, names = len(self.thresholds), [f"v{j}" for j in range(len(self.thresholds) + 1)]

        def score(table: pa.Table, trees: Iterator) -> pa.Table:
            x, donor = _bytes(table.column("x"), width), _bytes(table.column("d"), width)
            plain, moved = np.zeros(len(x), np.int64), np.zeros(x.shape, np.int64)
            for _, nodes in trees:
                shares, (own, row, feature, leaf) = _shares(nodes), swapped_leaves(nodes, x, donor)
                plain += shares[own]
                moved[row, feature] += shares[leaf] - shares[own[row]]
            columns = {"id": table.column("id"), "truth": table.column("truth"), "v0": pa.array(plain)}
            return pa.table(columns | {f"v{j + 1}": pa.array(plain + moved[:, j]) for j in range(width)})

        parts = max(1, -(-paired.count() // _SCORED_ROWS))
        met = self.meet(paired, parts, score, "id long, truth int, " + ", ".join(f"{v} long" for v in names), by="id")
        unit = F.lit(float(self.count) * (1 << 52))
        return met.groupBy("id", "truth").agg(*[(F.sum(v) / unit).alias(v) for v in names])

    def _coded_column(self, dataset: DataFrame, x: Column) -> DataFrame:
        thresholds = self.thresholds

        @F.arrow_udf("binary")
        def code(values: pa.Array) -> pa.Array:
            return _codes(values.flatten().to_numpy().reshape(len(values), -1), thresholds)

        return dataset.withColumn("_code", code(x))

    def _write(self, path: str) -> None:
        """Spark's own model, by the tasks."""
        spark, thresholds = self.spark, self.thresholds
        flat = "treeID int, id int, c0 double, c1 double, gain double, feature int, bin int, left int"

        def nodes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    tree, nodes = _unpacked(batch, row)
                    gain = _gains(nodes)
                    for lo in range(0, len(gain), 50_000):
                        some = slice(lo, lo + 50_000)
                        size = len(gain[some])
                        ints = {c: pa.array(nodes[c][some].astype(np.int32)) for c in ("feature", "bin", "left")}
                        yield pa.RecordBatch.from_pydict({
                            "treeID": pa.array(np.full(size, tree, np.int32)), "id": pa.array(np.arange(lo, lo + size, dtype=np.int32)),
                            "c0": pa.array(nodes["c0"][some].astype(float)), "c1": pa.array(nodes["c1"][some].astype(float)), "gain": pa.array(gain[some]), **ints,
                        })

        cuts = F.array(*[F.array(*[F.lit(float(v)) for v in t]).cast("array<double>") for t in thresholds])
        total = F.col("c0") + F.col("c1")
        impurity = F.coalesce(1 - F.try_divide(F.col("c0") ** 2 + F.col("c1") ** 2, total * total), F.lit(0.0))
        inner = F.col("feature") >= 0
        threshold = F.when(inner, F.array(F.get(F.get(cuts, F.col("feature")), F.col("bin")))).otherwise(F.array().cast("array<double>"))
        split = F.struct(F.col("feature").alias("featureIndex"), threshold.alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
        node = F.struct(
            "id", (F.col("c1") > F.col("c0")).cast("double").alias("prediction"), impurity.alias("impurity"), F.array("c0", "c1").alias("impurityStats"),
            total.cast("long").alias("rawCount"), "gain", F.col("left").alias("leftChild"),
            F.when(inner, F.col("left") + 1).otherwise(F.lit(-1)).alias("rightChild"), split.alias("split"),
        )
        # Two rows give a model with these parameters; its nodes are replaced.
        pattern, label = self.pattern.copy(), self.pattern.getLabelCol()
        pattern.setNumTrees(self.count)
        two = spark.range(2).select(F.col("id").cast("int").alias(label), array_to_vector(F.array_repeat(F.col("id").cast("double"), len(thresholds))).alias("_features"))
        pattern.fit(two).write().save(path)
        grown = self.stored.mapInArrow(nodes_of, flat).select("treeID", node.alias("nodeData"))
        grown.to(spark.createDataFrame([], _NODE).schema).write.mode("overwrite").parquet(f"{path}/data")


def _gains(nodes: dict[str, np.ndarray]) -> np.ndarray:
    """Gain of each split, from counts; -1 for leaves."""
    c0, c1, inner = nodes["c0"].astype(float), nodes["c1"].astype(float), np.flatnonzero(nodes["feature"] >= 0)
    n, squares = c0 + c1, c0**2 + c1**2
    gain, left = np.full(len(n), -1.0), nodes["left"][inner]
    with np.errstate(divide="ignore", invalid="ignore"):
        purity = squares / n
    gain[inner] = (purity[left] + purity[left + 1]) / n[inner] - squares[inner] / n[inner] ** 2
    return gain


def fit_trees(
    rows: DataFrame, draws: Column | Draws, width: int, label: str, mtry: int, trees: int, depth: int, least_rows: int, seed: int,
    local_rows: int | None = None,
) -> StoredForest:
    """A forest on `rows`: y (0 or 1), x (an array of `width` values) and other columns, from which and `tree` the expression
    `draws` tells how often a row is drawn for that tree. Each node looks at `mtry` features.

    With `Draws`, which tasks can work out for themselves, up to `WHOLE_ROWS` rows are not shuffled for each tree.
    """
    spark, mtry = rows.sparkSession, min(mtry, width)
    folder = scratch_path(spark, "forest")
    thresholds = _candidates(rows, width)
    coded = _binned(rows, thresholds).persist()
    n = coded.count()
    if not n:
        raise ValueError("a forest needs rows")
    if isinstance(draws, Draws) and local_rows is None and n <= WHOLE_ROWS:
        grown = _grow_whole(coded, draws, width, mtry, trees, depth, least_rows, seed)
        grown.write.option("compression", "zstd").parquet(f"{folder}/trees")
    else:
        _grow_split(coded, n, draws.column if isinstance(draws, Draws) else draws, folder, width, mtry, trees, depth, least_rows, seed, local_rows or LOCAL_ROWS)
    coded.unpersist()
    pattern = RandomForestClassifier(
        featuresCol="_features", labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=least_rows, seed=seed, featureSubsetStrategy=str(mtry),
    )
    nodes = spark.read.schema(_TREE).parquet(f"{folder}/trees").agg(F.sum("nodes")).first()[0]
    return StoredForest(spark, folder, thresholds, pattern, trees, nodes)


def _grow_whole(coded: DataFrame, draws: Draws, width: int, mtry: int, trees: int, depth: int, least: int, seed: int) -> DataFrame:
    """Some tasks get all rows, and each grows its share of the trees: as many tasks as cores, twice that if there are trees for it."""
    blocks, draw = min(trees, 2 * coded.sparkSession.sparkContext.defaultParallelism), draws.of

    def grow_some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        held.clear()
        block, keys, y, x = table.column("block")[0].as_py(), table.column("key").combine_chunks(), table.column("y").to_numpy(), _bytes(table.column("x"), width)
        del table
        for tree in range(block, trees, blocks):
            w = draw(keys, tree)
            drawn = w > 0
            if not drawn.any():
                yield _packed(tree, _EMPTY)
                continue
            yield _packed(tree, grow(x[drawn], y[drawn], w[drawn], mtry, depth, least, np.random.default_rng([seed, tree])))

    each = coded.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.col(draws.key).alias("key"), "y", "x")
    return each.repartitionById(blocks, "block").mapInArrow(grow_some, _TREE)


# A tree without rows says nothing.
_EMPTY = {"feature": np.array([-1]), "bin": np.array([0]), "c0": np.array([0]), "c1": np.array([0])}


def _grow_split(
    coded: DataFrame, n: int, draws: Column, folder: str, width: int, mtry: int, trees: int, depth: int, least_rows: int, seed: int, local_rows: int,
) -> None:
    spark = coded.sparkSession
    # Every tree draws from the rows: as many tasks as cores, also where the rows would fill only one.
    dealt = coded.repartition(max(coded.rdd.getNumPartitions(), min(spark.sparkContext.defaultParallelism, -(-n // 1000)), 1))

    def drawn_for(first: int, end: int) -> DataFrame:
        each = dealt.withColumn("tree", F.explode(F.sequence(F.lit(first), F.lit(end - 1))))
        return each.select("tree", "y", draws.cast("int").alias("w"), "x").filter("w > 0")

    # By place: counts, depth and tree of the nodes of the top.
    counts, depths, owner = [(0.0, 0.0)] * trees, [0] * trees, list(range(trees))
    top = _Top(*(np.full(trees, -1) for _ in range(4)))
    large, local = (np.arange(trees), []) if n > local_rows else (np.arange(0), list(range(trees)))
    while len(large):
        found = _split_large(drawn_for(0, trees), top, large, width, mtry, least_rows, seed)
        arrays, more = [list(a) for a in (top.feature, top.bin, top.left, top.right)], []
        for r in found:
            g, sides = r["g"], ((r["l0"], r["l1"]), (r["r0"], r["r1"]))
            counts[g] = tuple(a + b for a, b in zip(*sides, strict=True))
            if r["feature"] < 0:
                continue
            for array, value in zip(arrays, (r["feature"], r["bin"], len(counts), len(counts) + 1), strict=True):
                array[g] = value
            for side in sides:
                at = len(counts)
                counts.append(side), depths.append(depths[g] + 1), owner.append(owner[g])
                for array in arrays:
                    array.append(-1)
                if min(side) > 0 and depths[at] < depth:
                    (more if sum(side) > local_rows else local).append(at)
        top, large = _Top(*(np.array(a) for a in arrays)), np.array(more, int)

    # Rows are shuffled to the groups of some trees at a time, and the shuffle's files go before the next ones.
    at_once = max(1, _DRAWN_AT_ONCE // n)
    for first in range(0, trees, at_once):
        end = min(first + at_once, trees)
        mine = np.array([g for g in local if first <= owner[g] < end], int)
        with shuffles_dropped(spark):
            _grow_small(drawn_for(first, end), top, mine, np.array(depths), width, mtry, depth, least_rows, seed).write.mode("append").parquet(f"{folder}/grown")
    grown = spark.read.schema(_GROWN).parquet(f"{folder}/grown")
    # Places of the top are as few as rows and trees divided by `local_rows`.
    places = [(owner[g], g, *counts[g], int(top.feature[g]), int(top.bin[g]), int(top.left[g]), int(top.right[g])) for g in range(len(counts))]
    head = spark.createDataFrame(places, "tree int, g int, c0 double, c1 double, feature int, bin int, left int, right int")

    def assemble(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed(table.column("tree")[0].as_py(), _in_levels({c: table.column(c).to_numpy() for c in table.column_names}))])

    grown = grown.join(F.broadcast(head.select("tree", "g")), "g")
    columns = ["tree", "g", "id", "c0", "c1", "feature", "bin", "left", "right"]
    whole = grown.select(*columns).unionByName(head.withColumn("id", F.lit(-1)).select(*columns))
    whole.groupBy("tree").applyInArrow(assemble, _TREE).write.option("compression", "zstd").parquet(f"{folder}/trees")
    delete_folder(spark, f"{folder}/grown")


def _in_levels(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Nodes of one tree, level by level, from places of the top (id -1), which name places below them, and grown parts, which name their own ids."""
    order = np.lexsort((rows["id"], rows["g"]))
    rows = {c: v[order] for c, v in rows.items()}
    g, id_ = rows["g"].astype(np.int64), rows["id"]
    tops = np.flatnonzero(id_ < 0)
    # A place with a grown part is followed by its nodes, the first of which stands for it.
    stands = tops + np.append(g[1:] == g[:-1], False)[tops]
    place_of = dict(zip(g[tops].tolist(), stands.tolist(), strict=True))
    first_of = dict(zip(g[tops].tolist(), (tops + 1).tolist(), strict=True))
    left, right = np.full(len(g), -1), np.full(len(g), -1)
    for side, named in ((left, rows["left"]), (right, rows["right"])):
        some = np.flatnonzero((rows["feature"] >= 0) & (id_ < 0))
        side[some] = [place_of[int(c)] for c in named[some]]
        some = np.flatnonzero((rows["feature"] >= 0) & (id_ >= 0))
        if len(some):
            groups, at = np.unique(g[some], return_inverse=True)
            side[some] = np.array([first_of[int(k)] for k in groups])[at] + named[some]
    at, levels = np.array([place_of[int(g[tops].min())]]), []
    while len(at):
        levels.append(at)
        inner = at[rows["feature"][at] >= 0]
        at = np.column_stack((left[inner], right[inner])).ravel()
    order = np.concatenate(levels)
    return {c: rows[c][order] for c in _KINDS}


def _grow_small(drawn: DataFrame, top: _Top, local: np.ndarray, depths: np.ndarray, width: int, mtry: int, depth: int, least: int, seed: int) -> DataFrame:
    """The nodes below each place in `local`, from the rows that lie there."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = top.place(batch.column(0).to_numpy(), _bytes(batch.column(3), width))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns[1:]], ["g", "y", "w", "x"]).filter(pa.array(np.isin(at, local)))

    def finish(table: pa.Table) -> pa.Table:
        g, x = table.column("g")[0].as_py(), _bytes(table.column("x"), width)
        # The order in which rows arrive is not fixed, and the counts do not depend on it.
        tree = grow(x, table.column("y").to_numpy().astype(np.int64), table.column("w").to_numpy().astype(float), mtry,
                    depth - int(depths[g]), least, np.random.default_rng([seed, g]))
        size = len(tree["c0"])
        kinds = {"c0": pa.float64(), "c1": pa.float64(), "gain": pa.float64()}
        columns = {k: pa.array(tree[k], kinds.get(k, pa.int32())) for k in ("c0", "c1", "gain", "feature", "bin", "left", "right")}
        return pa.table({"g": pa.array(np.full(size, g), pa.int32()), "id": pa.array(np.arange(size), pa.int32()), **columns})

    placed = drawn.mapInArrow(place, "g int, y int, w int, x binary").repartition(max(1, -(-len(local) // _GROUPS)), "g")
    return placed.groupBy("g").applyInArrow(finish, _GROWN)
