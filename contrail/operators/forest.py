"""A random forest by Spark's rules whose deep nodes are grown where their rows are.

Each task of Spark's own fit keeps a histogram for every open node of every tree,
however few of its rows reach the node, and sends all of them: with deep trees that
costs nodes x tasks.  Here only nodes of more than SMALL rows get histograms from every
task, and at most rows / SMALL of them are open in a tree.  The rows of a smaller node
then move to one task, once, which grows its whole subtree level by level.

Bins, bootstrap (Poisson), feature subsets, Gini gain and pruning are those of Spark's
``RandomForestClassifier``, and the model is one of its own.  A row's place in the
bootstrap follows from its place in the stored rows, a node's feature subset from its
path, so the trees depend neither on SMALL nor on the order in which rows arrive.
TREES trees are fitted at a time, so that only their rows are on the move.
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import ceil, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkContext, StorageLevel, TaskContext, inheritable_thread_target
from pyspark.ml import Estimator
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from ..sources.files import scratch_dir

#: Rows of a task at most; trees of a fit.
ROWS, TREES = 1 << 19, 5
#: From this many rows on trees are fitted apart.
MANY = 1 << 16
#: Rows of a node at most that one task grows.
SMALL = 1 << 18
#: Rows of a block; nodes of a subtree that get histograms at once.
BLOCK, NODES = 1 << 14, 256
#: A smaller gain is rounding.
NO_GAIN = 1e-12


class Forest(Estimator):
    """Fits the trees of ``whole``, a ``RandomForestClassifier``; the model is Spark's own."""

    def __init__(self, whole: RandomForestClassifier):
        super().__init__()
        self.whole = whole

    def _fit(self, df: DataFrame) -> RandomForestClassificationModel:
        whole, spark = self.whole, df.sparkSession
        rows, count = df.select(whole.getFeaturesCol(), whole.getLabelCol()), whole.getNumTrees()
        n = rows.count()
        binary = _binary_features(rows, whole.getFeaturesCol())
        if n < MANY or count <= TREES or binary is None or not _usual(whole):
            return whole.fit(df)
        plan = _plan(whole, rows, n, binary)
        tasks = ceil(n / ROWS)
        even = _blocks(whole, rows, plan).repartition(tasks).persist(StorageLevel.MEMORY_AND_DISK)

        def fit(first: int) -> RandomForestClassificationModel:
            return _fitted(whole, even, n, plan, range(first, min(first + TREES, count)))

        try:
            even.count()
            # twice as many as keep all cores busy: a fit also waits for the driver
            with ThreadPoolExecutor(2 * ceil(spark.sparkContext.defaultParallelism / tasks)) as pool:
                parts = list(pool.map(inheritable_thread_target(spark)(fit), range(0, count, TREES)))
        finally:
            even.unpersist()
        return joined(whole, parts)


def joined(whole: RandomForestClassifier, parts: list[RandomForestClassificationModel]) -> RandomForestClassificationModel:
    """One model of the trees of all ``parts``, as one fit makes it (Spark's Python side has no call for it)."""
    sc = SparkContext.getOrCreate()
    jvm, trees = sc._jvm.org.apache.spark.ml.classification, [t for p in parts for t in p._java_obj.trees()]
    array = sc._gateway.new_array(jvm.DecisionTreeClassificationModel, len(trees))
    for i, t in enumerate(trees):
        array[i] = t
    model = RandomForestClassificationModel(jvm.RandomForestClassificationModel(whole.uid, array, parts[0].numFeatures, parts[0].numClasses))
    model._resetUid(whole.uid)
    model = whole._copyValues(model)
    model._transfer_params_to_java()
    return model


# ------------------------------------------------------------------ plan --

@dataclass
class Plan:
    """What every task knows: the bins of each feature and the rules of growth."""

    cuts: list[np.ndarray]
    binary: frozenset[int]
    classes: int
    picked: int
    least: int
    gain: float
    depth: int
    seed: int

    @property
    def cells(self) -> int:
        return max([len(c) + 1 for c in self.cuts] + [2])


def _usual(whole: RandomForestClassifier) -> bool:
    """Whether the forest is grown by the rules written here; others are left to Spark's fit."""
    return (whole.getImpurity() == "gini" and whole.getBootstrap() and whole.getSubsamplingRate() == 1.0 and whole.getMaxBins() <= 256
            and whole.getFeatureSubsetStrategy() in ("auto", "sqrt") and whole.getMinWeightFractionPerNode() == 0.0
            and not (whole.isDefined("weightCol") and whole.getWeightCol()))


def _binary_features(rows: DataFrame, features: str) -> frozenset[int] | None:
    """Places of the features that the column's metadata calls binary; None if others are categories."""
    attrs = rows.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
    if attrs.get("nominal"):
        return None
    return frozenset(a["idx"] for a in attrs.get("binary", []))


def _limits(values: np.ndarray, most: int) -> list[float]:
    """At most ``most`` limits between the values, halfway between neighbours, bins about equally full."""
    v, n = np.unique(values[~np.isnan(values)], return_counts=True)
    half = (v[:-1] + v[1:]) / 2
    if len(half) <= most:
        return half.tolist()
    stride, seen, out = n.sum() / (most + 1), np.cumsum(n), []
    for i in range(1, len(v)):
        target = stride * (len(out) + 1)
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(float(half[i - 1]))
    return out[:most]


def _plan(whole: RandomForestClassifier, rows: DataFrame, n: int, binary: frozenset[int]) -> Plan:
    x, most = vector_to_array(whole.getFeaturesCol()), min(whole.getMaxBins(), n) - 1
    classes, width = rows.agg(F.max(whole.getLabelCol()), F.max(F.size(x))).first()
    # bins from as many rows as Spark's fit takes for them
    some = rows.sample(min(1.0, max(whole.getMaxBins() ** 2, 10_000) / n), whole.getSeed())

    def limits(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"feature": p["feature"].iloc[:1], "cuts": [_limits(p["v"].to_numpy(), most)]})

    found = some.select(F.posexplode(x).alias("feature", "v")).groupBy("feature").applyInPandas(limits, "feature int, cuts array<double>")
    cuts = {r["feature"]: r["cuts"] for r in found.collect()}  # a row per feature
    # a binary feature's 0 goes left, as does what SMOTE puts between 0 and 1
    whole_cuts = [np.array([np.nextafter(1.0, 0.0)] if i in binary else cuts.get(i, [])) for i in range(width)]
    return Plan(whole_cuts, binary, max(int(classes) + 1, 2), max(1, ceil(sqrt(width))), whole.getMinInstancesPerNode(),
                max(whole.getMinInfoGain(), NO_GAIN), whole.getMaxDepth(), whole.getSeed())


def _blocks(whole: RandomForestClassifier, rows: DataFrame, plan: Plan) -> DataFrame:
    """(id, y, x): the labels and bins of up to BLOCK rows as bytes, x by feature."""
    cuts = plan.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, len(cuts))
                bins = np.empty((len(cuts), part.num_rows), np.uint8)
                for i, c in enumerate(cuts):
                    bins[i] = np.searchsorted(c, x[:, i])
                y = part.column(1).to_numpy(zero_copy_only=False).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([y.tobytes()]), pa.array([bins.tobytes()])], names=["id", "y", "x"])
                at += 1

    return rows.select(vector_to_array(whole.getFeaturesCol()).alias("x"), F.col(whole.getLabelCol()).cast("double").alias("y")) \
        .mapInArrow(run, "id long, y binary, x binary")


# ----------------------------------------------------------------- nodes --

def _mix(z: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers (splitmix64)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _root(seed: int, tree: int) -> np.ndarray:
    return _mix(_mix(np.array([seed], np.int64).view(np.uint64)) + np.uint64(tree + 1))


def _children(keys: np.ndarray) -> np.ndarray:
    return _mix(2 * keys[:, None] + np.array([1, 2], np.uint64)).ravel()


def _picks(keys: np.ndarray, plan: Plan) -> np.ndarray:
    """The features that the nodes of these keys may split by."""
    step = np.arange(1, len(plan.cuts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.sort(np.argpartition(_mix(keys[:, None] + step), plan.picked - 1, axis=1)[:, :plan.picked], axis=1)


def _bag(plan: Plan, tree: int, block: int, n: int) -> np.ndarray:
    """How often the tree's bootstrap holds each row of the block."""
    return np.random.default_rng([plan.seed & (2**63 - 1), tree, block]).poisson(1.0, n)


def _histogram(x, y, w, rows, node, picks, plan: Plan) -> np.ndarray:
    """Weights by class, node, picked feature and bin."""
    nodes, m = picks.shape
    key = x[rows[:, None], picks[node]] + plan.cells * (m * (node + nodes * y[rows].astype(np.int64))[:, None] + np.arange(m))
    return np.bincount(key.ravel(), np.repeat(w[rows], m), plan.classes * nodes * m * plan.cells).reshape(plan.classes, nodes, m, plan.cells)


def _best(hist: np.ndarray, picks: np.ndarray, plan: Plan):
    """Of each node its best split: feature (-1: none), last bin that goes left, gain, weights by class on the left."""
    left = hist.cumsum(3)
    total, left = left[:, :, 0, -1], left[..., :-1]
    right = total[:, :, None, None] - left
    nl, nr = left.sum(0), right.sum(0)
    score = (left * left).sum(0) / np.maximum(nl, 1) + (right * right).sum(0) / np.maximum(nr, 1)
    score[np.minimum(nl, nr) < plan.least] = -1
    nodes, n = np.arange(len(picks)), np.maximum(total.sum(0), 1)
    flat = score.reshape(len(picks), -1)
    at = flat.argmax(1)
    place, code = np.divmod(at, plan.cells - 1)
    gain = flat[nodes, at] / n - (total ** 2).sum(0) / n ** 2
    good = (flat[nodes, at] >= 0) & (gain >= plan.gain)
    return np.where(good, picks[nodes, place], -1), code, np.where(good, gain, -1.0), left[:, nodes, place, code].T


def _open(total: np.ndarray, depth: int, plan: Plan) -> np.ndarray:
    n = total.sum(-1)
    return (total.max(-1) < n) & (n >= 2 * plan.least) & (depth < plan.depth)


def _subtree(x, y, w, key: int, depth: int, plan: Plan):
    """The pruned subtree of one node's rows: total, feature, bin, gain and left child of its nodes, parents first."""
    rows, node = np.arange(len(y)), np.zeros(len(y), np.int64)
    total, keys = np.bincount(y, w, plan.classes)[None], np.array([key], np.int64).view(np.uint64)
    levels = []
    while True:
        k = len(total)
        feature, code, gain, lefts = np.full(k, -1), np.zeros(k, np.int64), np.full(k, -1.0), np.zeros_like(total)
        at = np.flatnonzero(_open(total, depth, plan))
        place = np.full(k, -1)
        place[at] = np.arange(len(at))
        here = place[node]
        rows, here = rows[here >= 0], here[here >= 0]
        ends = np.searchsorted(here, np.arange(len(at) + 1))
        for a in range(0, len(at), NODES):
            some, run = at[a:a + NODES], slice(ends[a], ends[min(a + NODES, len(at))])
            picks = _picks(keys[some], plan)
            feature[some], code[some], gain[some], lefts[some] = _best(_histogram(x, y, w, rows[run], here[run] - a, picks, plan), picks, plan)
        levels.append((total, feature, code, gain))
        split = feature >= 0
        if not split.any():
            break
        node = at[here]
        rows, node = rows[split[node]], node[split[node]]
        child = 2 * (np.cumsum(split) - 1)[node] + (x[rows, feature[node]] > code[node])
        order = np.argsort(child.astype(np.uint16 if 2 * split.sum() <= 1 << 16 else np.uint32), kind="stable")  # two bytes go by radix
        rows, node = rows[order], child[order]
        total = np.stack([lefts[split], total[split] - lefts[split]], 1).reshape(-1, plan.classes)
        keys, depth = _children(keys[split]), depth + 1
    return _pruned(levels)


def _pruned(levels):
    """Leaves of one parent with one prediction become one leaf, from the deepest level up."""
    under = None
    for total, feature, _, _ in reversed(levels):
        at = np.flatnonzero(feature >= 0)
        if under is not None:
            leaf, said = under
            feature[at[leaf[::2] & leaf[1::2] & (said[::2] == said[1::2])]] = -1
        under = feature < 0, total.argmax(1)
    alive, kept, lefts, first = np.ones(1, bool), [], [], 0
    for _, feature, _, gain in levels:
        kept.append(alive)
        first += int(alive.sum())
        on = feature[alive] >= 0
        lefts.append(np.where(on, first + 2 * (np.cumsum(on) - 1), -1))
        had = gain >= 0  # also those whose children are merged
        alive = np.repeat((alive & (feature >= 0))[had], 2)
    return (*(np.concatenate([level[c][a] for level, a in zip(levels, kept)]) for c in range(4)), np.concatenate(lefts))


# ------------------------------------------------------------------- fit --

@dataclass
class Top:
    """The first nodes of a tree; children lie side by side, after their parent."""

    total: list = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    code: list[int] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    key: list[int] = field(default_factory=list)

    def add(self, total, depth: int, key: int) -> int:
        for column, v in ((self.total, total), (self.feature, -1), (self.code, 0), (self.gain, -1.0), (self.left, -1), (self.depth, depth), (self.key, key)):
            column.append(v)
        return len(self.left) - 1


def _bagged(batches, tops: dict[int, Top], chosen: dict[int, list[int]], plan: Plan):
    """For each block and tree: the tree, labels, bins, weights, the rows that reach one of its chosen nodes, and which."""
    walk = {t: tuple(np.array(c) for c in (top.left, top.feature, top.code)) for t, top in tops.items()}
    slots = {t: np.full(len(top.left), -1) for t, top in tops.items()}
    for t, nodes in chosen.items():
        slots[t][nodes] = np.arange(len(nodes))
    for batch in batches:
        for block, y, x in zip(*(c.to_pylist() for c in batch.columns)):
            y = np.frombuffer(y, np.uint8)
            x = np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(len(plan.cuts), len(y)).T)
            for t, nodes in chosen.items():
                w, (left, feature, code) = _bag(plan, t, block, len(y)), walk[t]
                rows = np.flatnonzero(w)
                node, on = np.zeros(len(rows), np.int64), np.arange(len(rows))
                while len(on := on[left[node[on]] >= 0]):
                    at = node[on]
                    node[on] = left[at] + (x[rows[on], feature[at]] > code[at])
                slot = slots[t][node]
                yield t, y, x, w, rows[slot >= 0], slot[slot >= 0]


def _splits(even: DataFrame, tops: dict[int, Top], chosen: dict[int, list[int]], plan: Plan) -> list:
    """The best split of each chosen node over all rows."""
    keys = {t: np.array([tops[t].key[i] for i in nodes], np.int64).view(np.uint64) for t, nodes in chosen.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picks, sums = {t: _picks(k, plan) for t, k in keys.items()}, {}
        for t, y, x, w, rows, slot in _bagged(batches, tops, chosen, plan):
            h = _histogram(x, y, w, rows, slot, picks[t], plan)
            sums[t] = sums[t] + h if t in sums else h
        for t, h in sums.items():
            n = h.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array([t] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([h[:, i].tobytes() for i in range(n)])],
                                             names=["tree", "slot", "h"])

    def best(p: pd.DataFrame) -> pd.DataFrame:
        t, slot = int(p["tree"].iloc[0]), int(p["slot"].iloc[0])
        picks = _picks(keys[t][slot:slot + 1], plan)
        h = sum(np.frombuffer(b) for b in p["h"]).reshape(plan.classes, 1, plan.picked, plan.cells)
        feature, code, gain, left = (c[0] for c in _best(h, picks, plan))
        return pd.DataFrame({"tree": [t], "slot": [slot], "total": [h[:, 0, 0].sum(1)], "feature": [feature], "code": [code], "gain": [gain], "lefts": [left]})

    sums = even.mapInArrow(count, "tree int, slot int, h binary")
    # a row per node of more than SMALL rows
    return sums.groupBy("tree", "slot").applyInPandas(
        best, "tree int, slot int, total array<double>, feature int, code int, gain double, lefts array<double>").collect()


def _subtrees(even: DataFrame, tops: dict[int, Top], chosen: dict[int, list[int]], plan: Plan) -> DataFrame:
    """The nodes below each chosen one, grown by the task that gets its rows; left children by their place i there."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, y, x, w, rows, slot in _bagged(batches, tops, chosen, plan):
            rows, slot = rows[order := np.argsort(slot, kind="stable")], slot[order]
            found, first = np.unique(slot, return_index=True)
            parts = np.split(rows, first[1:]) if len(rows) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([t] * len(found), pa.int32()), pa.array([chosen[t][s] for s in found], pa.int32()), pa.array([y[r].tobytes() for r in parts], pa.binary()),
                 pa.array([w[r].astype(np.uint8).tobytes() for r in parts], pa.binary()), pa.array([x[r].T.tobytes() for r in parts], pa.binary())],
                names=["tree", "node", "y", "w", "x"])

    def grow(table: pa.Table) -> pa.Table:
        t, node = table["tree"][0].as_py(), table["node"][0].as_py()
        y, w = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint8) for c in ("y", "w"))
        x = np.concatenate([np.frombuffer(b, np.uint8).reshape(len(plan.cuts), -1).T for b in table["x"].to_pylist()])
        total, feature, code, gain, left = _subtree(np.ascontiguousarray(x), y, w, tops[t].key[node], tops[t].depth[node], plan)
        n = len(left)
        return pa.table({"tree": pa.array([t] * n, pa.int32()), "node": pa.array([node] * n, pa.int32()), "i": pa.array(np.arange(n), pa.int32()),
                         "left": pa.array(left, pa.int32()), "feature": pa.array(feature, pa.int32()), "code": pa.array(code, pa.int32()),
                         "gain": pa.array(np.where(left < 0, -1.0, gain)),
                         "total": pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * plan.classes, total.ravel())})

    moved = even.mapInArrow(pieces, "tree int, node int, y binary, w binary, x binary")
    return moved.groupBy("tree", "node").applyInArrow(grow, "tree int, node int, i int, left int, feature int, code int, gain double, total array<double>")


def _fitted(whole: RandomForestClassifier, even: DataFrame, n: int, plan: Plan, trees: range) -> RandomForestClassificationModel:
    tops, big, small = {t: Top() for t in trees}, {}, {t: [] for t in trees}
    for t, top in tops.items():
        top.add(None, 0, int(_root(plan.seed, t).view(np.int64)[0]))
        if n > SMALL:
            big[t] = [0]
        else:
            small[t].append(0)
    while big:
        found, now = _splits(even, tops, big, plan), big
        big = {}
        for r in sorted(found, key=lambda r: (r["tree"], r["slot"])):
            t = r["tree"]
            top, node, total = tops[t], now[t][r["slot"]], np.array(r["total"])
            top.total[node] = total
            if r["feature"] < 0:
                continue
            top.feature[node], top.code[node], top.gain[node], top.left[node] = r["feature"], r["code"], r["gain"], len(top.left)
            lefts, depth = np.array(r["lefts"]), top.depth[node] + 1
            for key, part in zip(_children(np.array([top.key[node]], np.int64).view(np.uint64)).view(np.int64), (lefts, total - lefts)):
                child = top.add(part, depth, int(key))
                if _open(part, depth, plan):
                    (big.setdefault(t, []) if part.sum() > SMALL else small[t]).append(child)
    chosen = {t: nodes for t, nodes in small.items() if nodes}
    grown = stored(_subtrees(even, tops, chosen, plan), "forest-nodes")
    roots = {(r["tree"], r["node"]): r for r in grown.groupBy("tree", "node").agg(  # a row per subtree
        F.count(F.lit(1)).alias("n"), F.max_by(F.struct("left", "total"), -F.col("i")).alias("root")).collect()}
    return _model(whole, plan, tops, grown, roots)


def _model(whole: RandomForestClassifier, plan: Plan, tops: dict[int, Top], grown: DataFrame, roots: dict) -> RandomForestClassificationModel:
    """Spark's model of the nodes, by way of the files in which Spark saves one."""
    spark, above, offsets = grown.sparkSession, [], []
    for place, (t, top) in enumerate(tops.items()):
        leaf, said = {}, {}
        for i in reversed(range(len(top.left))):
            below = roots.get((t, i))
            if below is not None:
                top.total[i] = np.array(below["root"]["total"])
            a, said[i] = top.left[i], int(np.argmax(top.total[i]))
            if a >= 0 and leaf[a] and leaf[a + 1] and said[a] == said[a + 1]:
                top.left[i] = -1
            leaf[i] = top.left[i] < 0 if below is None else below["root"]["left"] < 0
        used = [0]
        for i in used:
            if top.left[i] >= 0:
                used += [top.left[i], top.left[i] + 1]
        own = [i for i in used if (t, i) not in roots]
        ids, end = {i: k for k, i in enumerate(own)}, len(own)
        for i in used:
            if (t, i) in roots:
                ids[i] = end
                offsets.append((t, i, place, end))
                end += roots[t, i]["n"]
        above += [(place, ids[i], ids[top.left[i]] if top.left[i] >= 0 else -1, ids[top.left[i] + 1] if top.left[i] >= 0 else -1, top.feature[i],
                   top.code[i], float(top.gain[i]) if top.left[i] >= 0 else -1.0, [float(v) for v in top.total[i]]) for i in own]
    schema = "treeID int, id int, leftChild int, rightChild int, feature int, code int, gain double, total array<double>"
    first = spark.createDataFrame(above, schema)
    where = F.broadcast(spark.createDataFrame(offsets, "tree int, node int, treeID int, first int"))
    inner, child = F.col("left") >= 0, F.col("left") + F.col("first")
    rest = grown.join(where, ["tree", "node"]).select("treeID", (F.col("first") + F.col("i")).alias("id"), F.when(inner, child).otherwise(-1).alias("leftChild"),
                                                      F.when(inner, child + 1).otherwise(-1).alias("rightChild"), "feature", "code", "gain", "total")
    limits = F.lit(0.0) if not any(map(len, plan.cuts)) else F.element_at(F.element_at(F.array(*[
        F.array(*[F.lit(float(v)) for v in (c if len(c) else [0.0])]) for c in plan.cuts]), F.col("feature") + 1), F.col("code") + 1)
    inner, two = F.col("leftChild") >= 0, F.col("feature").isin([int(i) for i in plan.binary])
    size = F.aggregate("total", F.lit(0.0), lambda s, v: s + v)
    data = first.unionByName(rest).select("treeID", F.struct(
        "id", (F.array_position("total", F.array_max("total")) - 1).cast("double").alias("prediction"),
        (1 - F.aggregate("total", F.lit(0.0), lambda s, v: s + v * v) / (size * size)).alias("impurity"),
        F.col("total").alias("impurityStats"), size.cast("long").alias("rawCount"), "gain", "leftChild", "rightChild",
        F.struct(F.when(inner, F.col("feature")).otherwise(-1).alias("featureIndex"),
                 F.when(inner, F.array(F.when(two, 0.0).otherwise(limits))).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
                 F.when(inner & two, 2).otherwise(-1).alias("numCategories")).alias("split")).alias("nodeData"))
    # the forest of as many roots, whose nodes these replace
    blank = spark.createDataFrame([(Vectors.dense([0.0] * len(plan.cuts)), float(c)) for c in range(plan.classes)], [whole.getFeaturesCol(), whole.getLabelCol()])
    path = scratch_dir(spark, "forest")
    whole.copy({whole.numTrees: len(tops), whole.maxDepth: 0, whole.minInstancesPerNode: 1}).fit(blank).write().overwrite().save(path)
    data.write.mode("overwrite").parquet(f"{path}/data")
    return RandomForestClassificationModel.load(path)
