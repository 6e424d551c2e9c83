"""Exact k nearest neighbours by a distributed metric tree.

*Distinct points.*  Equal vectors are one point of the tree that keeps its k + 1
smallest ids, so a vector that holds a third of all rows is one point.

*Tree.*  A node with more than LEAF points gets FAN pivots, the first of its points by a
seeded hash; each point goes to the nearest, which makes FAN children, and so on.
A child keeps its pivot and how near and how far its points lie from it.  Levels
are stored tables; a node meets its pivots in runs of RUN points.

*Search.*  A point's own leaf gives a first k-th distance.  The points of a leaf are
then packed as one block: the bytes of its vectors, their centre, and how far from it
a neighbour of any of them may lie.  From the root down a block visits only children
that the triangle inequality does not rule out.  About RUN points of sibling blocks
meet the leaves that any of them visits, up to MEET points of those at a time, so a
leaf is moved once for many points; there a point is compared only with leaves whose
ball it may need, by products of matrices, and what it finds narrows the rest of its
search.  Nothing is collected, and no task holds more than RUN + MEET points and a leaf
or two.  How much is ruled out depends on the data, not on chance: in many independent
dimensions little is, and all pairs of blocks meet.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: Children of a node, points of a leaf (at most, above level DEPTH), points that meet in one group.
FAN, LEAF, RUN, DEPTH = 32, 1024, 4096, 11
#: Points of leaves that a group of asks meets at once; columns from which on few of them are compared first.
MEET, WIDE = 1 << 14, 32
BLOCKS = ("block string, node long, n int, u array<string>, first array<string>, x binary, own binary, centre array<double>, "
          "radius double, most double")
FOUND = "u string, w string, first string, d double"


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all rows of y, added up by column."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - y[None, :, c]) ** 2
    return np.sqrt(d)


def _together(left: DataFrame, right: DataFrame, work, schema: str) -> DataFrame:
    """``work`` on the rows of both sides of a node; a node of many left rows is many
    groups, each with its right rows."""
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # both sides may be of one table
    parts = left.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / RUN).alias("parts"))
    a = left.join(parts, "node").withColumn("part", F.pmod(F.xxhash64("u"), "parts")).drop("parts")
    b = right.join(parts, "node").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    return a.groupBy("node", "part").cogroup(b.groupBy("node", "part")).applyInArrow(work, schema)


def _to_children(points: pa.Table, pivots: pa.Table) -> pa.Table:
    pivots = pivots.sort_by("child")
    y, child, near, far = _matrix(pivots["pivot"]), pivots["child"].to_numpy(), [], []
    for at in range(0, len(points), 256):
        d = distances(_matrix(points["v"].slice(at, 256)), y)
        near.append(d.argmin(1))
        far.append(d.min(1))
    return pa.table({"u": points["u"], "first": points["first"], "v": points["v"], "h": points["h"], "up": points["node"],
                     "node": pa.array(child[np.concatenate(near)]) if near else pa.array([], pa.int64()),
                     "d": pa.array(np.concatenate(far) if near else [], pa.float64())})


def _largest(sizes: np.ndarray) -> float:
    """The largest of the sizes that are numbers: the others' rows have no distance."""
    return sizes.max(initial=0.0, where=np.isfinite(sizes))


def _square_bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, slack): the squared distance of each row of x to each row of y is at most
    ``upper`` and at least ``upper`` less the x row's ``slack``, by one product of matrices
    and its largest rounding error."""
    with np.errstate(invalid="ignore", over="ignore"):
        room = 4 * (x.shape[1] + 4) * np.finfo(float).eps
        own, other = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
        # both squares by the same product
        upper = np.column_stack([x, (1 + room) * own, np.ones(len(x))]) @ np.column_stack([-2 * y, np.ones(len(y)), (1 + room) * other]).T
        return upper, 2 * room * (own + _largest(other)) + np.finfo(float).tiny


def _pair_distances(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray | None = None) -> np.ndarray:
    """``distances(x, y)[i, j]``: the same sums in the same order; infinite where part of a sum
    is beyond the pair's ``most`` already."""
    if most is None:
        d = np.zeros(len(i))
        for c in range(x.shape[1]):
            d += (x[i, c] - y[j, c]) ** 2
        return np.sqrt(d)
    out, on, d, limit = np.full(len(i), np.inf), np.arange(len(i)), np.zeros(len(i)), (most * (1 + 1e-9)) ** 2
    for c in range(x.shape[1]):
        d += (x[i, c] - y[j, c]) ** 2
        if c % 8 == 7:
            kept = ~(d > limit)
            on, i, j, d, limit = on[kept], i[kept], j[kept], d[kept], limit[kept]
    out[on] = np.sqrt(d)
    return out


def _nearest_in_leaf(k: int):
    """The k nearest points of the leaf to each ask, and none beyond the ask's ``most``, if it has one.
    Bounds by a product of matrices leave few pairs, whose distances are added up by column."""

    def work(asks: pa.Table, points: pa.Table) -> pa.Table:
        points = points.sort_by([("first", "ascending")])
        name, first, own = (np.array(c.to_pylist(), object) for c in (points["u"], points["first"], asks["u"]))
        place = {u: i for i, u in enumerate(name)}
        y, out = _matrix(points["v"]) if len(points) else None, []
        farthest = asks["most"].to_numpy() if "most" in asks.column_names else np.full(len(asks), np.inf)
        for at in range(0, len(asks) if len(points) else 0, 256):
            x, most = _matrix(asks["v"].slice(at, 256)), farthest[at : at + 256]
            upper, slack = _square_bounds(x, y)
            for i, u in enumerate(own[at : at + 256]):
                if u in place:
                    upper[i, place[u]] = np.nan
            n = min(k, upper.shape[1]) - 1
            kth = np.partition(upper, n, axis=1)[:, n]  # NaN comes last
            limit = np.minimum(np.where(np.isnan(kth), np.inf, kth), (most * (1 + 1e-9)) ** 2)
            i, j = np.nonzero(upper <= (limit + slack)[:, None])
            d = _pair_distances(x, y, i, j)
            kept = (d < np.inf) & (d <= most[i])
            i, j, d = i[kept], j[kept], d[kept]
            # the k smallest by (distance, first id): rows are in the order of their first ids
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            kept = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, d = i[kept], j[kept], d[kept]
            out.append(pa.table({"u": pa.array(own[at + i], pa.string()), "w": pa.array(name[j], pa.string()),
                                 "first": pa.array(first[j], pa.string()), "d": pa.array(d, pa.float64())}))
        none = pa.table({"u": pa.array([], pa.string()), "w": pa.array([], pa.string()), "first": pa.array([], pa.string()), "d": pa.array([], pa.float64())})
        return pa.concat_tables([none, *out])

    return work


def _packed(k: int):
    """The block of some points (node, part, u, first, v, ds: the distances found in their leaf)."""

    def work(points: pa.Table) -> pa.Table:
        points = points.sort_by([("first", "ascending")])
        x, n, node, part = _matrix(points["v"]), len(points), points["node"][0].as_py(), points["part"][0].as_py()
        own = np.full((n, k), np.inf)
        for i, ds in enumerate(points["ds"].to_pylist()):
            own[i, : len(ds or [])] = ds or []
        with np.errstate(invalid="ignore", over="ignore"):
            centre = x.mean(0)
            away = distances(x, centre[None])[:, 0]
            most = (away + own.max(1)).max() * (1 + 1e-9)
        one = lambda v, kind=None: pa.array([v], kind)
        return pa.table({"block": one(f"{node}/{part}"), "node": one(node, pa.int64()), "n": one(n, pa.int32()), "u": one(points["u"].to_pylist(), pa.list_(pa.string())),
                         "first": one(points["first"].to_pylist(), pa.list_(pa.string())), "x": one(x.tobytes()), "own": one(own.tobytes()),
                         "centre": one(centre.tolist(), pa.list_(pa.float64())), "radius": one(away.max()), "most": one(most)})

    return work


class _Sketch:
    """Few columns of vectors turned to the axes along which ``x`` varies most: distances of
    these are not above those of all columns, but for ``slack``."""

    def __init__(self, x: np.ndarray):
        size = x.shape[1]
        some = x[np.isfinite(x).all(1)]
        self.axes = None
        if size >= WIDE and len(some):
            self.centre = some.mean(0)
            with np.errstate(invalid="ignore", over="ignore"):
                spread = (some - self.centre).T @ (some - self.centre)
            if np.isfinite(spread).all():
                self.axes = np.linalg.eigh(spread)[1][:, -(size // 8) :]

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The columns kept, and the room for rounding of each row."""
        with np.errstate(invalid="ignore", over="ignore"):
            moved = x - self.centre
            room = 8 * (x.shape[1] + 4) * np.sqrt(self.axes.shape[1]) * np.finfo(float).eps
            return moved @ self.axes, room * np.einsum("ij,ij->i", moved, moved)


def _near_pairs(x: np.ndarray, y: np.ndarray, most: np.ndarray, k: int, sketch: _Sketch, sketched=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y, among them all that are at most ``most`` apart, but for pairs of a row of x
    that has k nearer ones.  ``sketched``: what ``sketch`` makes of x."""
    limit, i, j = (most * (1 + 1e-9)) ** 2, [], []
    left = np.arange(len(x))
    if sketch.axes is not None:
        (few, room), (other, more) = sketched, sketch.of(y)
        upper, slack = _square_bounds(few, other)
        # what is not a number is ruled out: no distance to it is one
        at, to = np.divmod(np.flatnonzero(upper <= (limit + slack + room + _largest(more))[:, None]), len(y))
        many = np.bincount(at, minlength=len(x)) > 4 * k
        i, j, left = [at[~many[at]]], [to[~many[at]]], np.flatnonzero(many)
    if len(left):
        upper, slack = _square_bounds(x[left], y)
        at, to = np.divmod(np.flatnonzero(upper <= (limit[left] + slack)[:, None]), len(y))
        many = np.flatnonzero(np.bincount(at, minlength=len(left)) > 4 * k)
        if len(many):  # the k-th smallest bound is a bound
            kth = np.full(len(left), np.inf)
            kth[many] = np.partition(upper[many], k - 1, axis=1)[:, k - 1] + slack[many]
            kept = upper[at, to] <= kth[at]
            at, to = at[kept], to[kept]
        i, j = [*i, left[at]], [*j, to]
    return np.concatenate(i), np.concatenate(j)


def _nearest_in_blocks(k: int):
    """Of each point of the blocks ``asks`` its nearest in the blocks ``others``, but for its own leaf: none that
    is farther than its k-th known so far."""

    def work(asks: pa.Table, others: pa.Table) -> pa.Table:
        none = pa.table({"u": pa.array([], pa.string()), "w": pa.array([], pa.string()), "first": pa.array([], pa.string()), "d": pa.array([], pa.float64())})
        if not len(asks) or not len(others):
            return none
        size = asks["n"].to_numpy()
        matrix = lambda b, n: np.frombuffer(b).reshape(n, -1)
        x = np.concatenate([matrix(b.as_py(), n) for b, n in zip(asks["x"], size)])
        known = np.concatenate([matrix(b.as_py(), n) for b, n in zip(asks["own"], size)])
        home, most, centres = np.repeat(asks["node"].to_numpy(), size), known.max(1), _matrix(others["centre"])
        least = np.empty((len(x), len(others)))
        radius, leaf = others["radius"].to_numpy(), others["node"].to_numpy()
        for at in range(0, len(x), 1024):
            upper, slack = _square_bounds(x[at : at + 1024], centres)
            least[at : at + 1024] = np.sqrt(np.maximum(upper - slack[:, None], 0)) * (1 - 1e-9) - radius * (1 + 1e-9)
        found, sketch = [], _Sketch(x)
        sketched = None if sketch.axes is None else sketch.of(x)
        for o in np.argsort(least.min(0), kind="stable"):
            y = matrix(others["x"][o].as_py(), others["n"][o].as_py())
            # what is not a number rules nothing out
            need = np.flatnonzero(~(least[:, o] > most) & (home != leaf[o]))
            step = max(256, (1 << 19) // len(y))
            for rows in (need[at : at + step] for at in range(0, len(need), step)):
                i, j = _near_pairs(x[rows], y, most[rows], k, sketch, sketched and tuple(c[rows] for c in sketched))
                d = _pair_distances(x[rows], y, i, j, most[rows[i]])
                kept = (d < np.inf) & (d <= most[rows[i]])
                i, j, d = i[kept], j[kept], d[kept]
                if not len(i):
                    continue
                # the k smallest by (distance, first id): points are in the order of their first ids
                order = np.lexsort((j, d, i))
                i, j, d = i[order], j[order], d[order]
                rank = np.arange(len(i)) - np.searchsorted(i, i)
                kept = rank < k
                i, j, d, rank = i[kept], j[kept], d[kept], rank[kept]
                new = np.full((len(rows), k), np.inf)
                new[i, rank] = d
                known[rows] = np.partition(np.concatenate([known[rows], new], 1), k - 1, axis=1)[:, :k]
                most[rows] = known[rows, k - 1]
                found.append((rows[i], np.full(len(i), o), j, d))
        if not found:
            return none
        i, o, j, d = (np.concatenate(c) for c in zip(*found))
        kept = d <= most[i]
        i, o, j, d = i[kept], o[kept], j[kept], d[kept]
        place = np.concatenate([[0], np.cumsum(others["n"].to_numpy())])[o] + j
        name = lambda t, c: t[c].combine_chunks().flatten()
        return pa.table({"u": name(asks, "u").take(pa.array(i)), "w": name(others, "u").take(pa.array(place)),
                         "first": name(others, "first").take(pa.array(place)), "d": pa.array(d, pa.float64())})

    return work


def _visited(asks: pa.Table, children: pa.Table) -> pa.Table:
    """The children that may hold a point no farther from an ask than its ``most``, in rows of the ask."""
    children = children.sort_by("child")
    y, child, leaf = _matrix(children["pivot"]), children["child"].to_numpy(), children["leaf"].to_numpy(zero_copy_only=False)
    low, high = children["low"].to_numpy(), children["high"].to_numpy()
    most, home = asks["most"].to_numpy(), asks["home"].to_numpy()
    rows, to = [], []
    for at in range(0, len(asks), 256):
        upper, slack = _square_bounds(_matrix(asks["v"].slice(at, 256)), y)
        farthest, nearest_ = np.sqrt(np.maximum(upper, 0)), np.sqrt(np.maximum(upper - slack[:, None], 0))
        # a little room for rounding
        least = np.maximum(nearest_ * (1 - 1e-9) - high * (1 + 1e-9), low * (1 - 1e-9) - farthest * (1 + 1e-9))
        i, j = np.nonzero(~(least > most[at : at + 256, None]) & (child[None, :] != home[at : at + 256, None]))
        rows.append(at + i)
        to.append(j)
    row, j = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (rows, to))
    kept = asks.select(["u", "v", "most", "home"]).take(pa.array(row))
    return kept.append_column("node", pa.array(child[j])).append_column("leaf", pa.array(leaf[j], pa.bool_()))


@dataclass
class Tree:
    """``leaves`` (node, u, first, v): the points; ``levels``: of each level the children
    (node, child, pivot, low, high, leaf)."""

    leaves: DataFrame
    levels: list[DataFrame]


def build(points: DataFrame, seed: int = 42) -> Tree:
    """The tree of ``points`` (u string, first string, v array<double>), whose u and v differ."""
    open_ = points.select("u", "first", "v", F.xxhash64("u", F.lit(seed)).alias("h"), F.lit(0).cast("long").alias("node"))
    if points.count() <= LEAF:
        return Tree(open_.select("node", "u", "first", "v"), [])
    levels, leaves = [], []
    while len(levels) < DEPTH:
        # FAN rows of each task and node
        order = Window.partitionBy("node").orderBy("h", "u")
        pivots = open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= FAN)
        pivots = pivots.select("node", (F.col("node") * FAN + F.col("rank")).alias("child"), F.col("v").alias("pivot"))
        pivots = stored(pivots, "pivots")
        dealt = _together(open_, pivots, _to_children, "u string, first string, v array<double>, h long, up long, node long, d double")
        dealt = stored(dealt, "dealt")
        sizes = dealt.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        is_leaf = (F.col("n") <= LEAF) | F.lit(len(levels) + 1 == DEPTH)
        children = pivots.join(sizes.withColumnRenamed("node", "child"), "child").select("node", "child", "pivot", "low", "high", is_leaf.alias("leaf"))
        children = stored(children, "children")
        levels.append(children)
        ended = dealt.join(children.select(F.col("child").alias("node"), "leaf"), "node")
        leaves.append(ended.where("leaf").select("node", "u", "first", "v"))
        if children.where("NOT leaf").isEmpty():
            break
        open_ = ended.where("NOT leaf").select("u", "first", "v", "h", "node")
    all_ = leaves[0]
    for more in leaves[1:]:
        all_ = all_.unionByName(more)
    return Tree(stored(all_, "leaves"), levels)


def blocks_of(tree: Tree, own: DataFrame, k: int) -> DataFrame:
    """The blocks of LEAF points at most of all leaves, given each point's nearest in its own leaf."""
    known = own.groupBy("u").agg(F.sort_array(F.collect_list("d")).alias("ds"))  # k at most
    parts = tree.leaves.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / LEAF).alias("parts"))
    rows = tree.leaves.join(known, "u", "left").join(parts, "node").withColumn("part", F.pmod(F.xxhash64("u"), "parts")).drop("parts")
    return stored(rows.groupBy("node", "part").applyInArrow(_packed(k), BLOCKS), "blocks")


def visits_of(tree: Tree, blocks: DataFrame) -> DataFrame | None:
    """(u, node): the further leaves that each block (u) has to open."""
    asks = blocks.select(F.lit(0).cast("long").alias("node"), F.col("block").alias("u"), F.col("centre").alias("v"), "most", F.col("node").alias("home"))
    opened = None
    for children in tree.levels:
        got = _together(asks, children, _visited, "u string, v array<double>, most double, home long, node long, leaf boolean")
        got = stored(got, "visits")
        leaves = got.where("leaf").select("u", "node")
        opened = leaves if opened is None else opened.unionByName(leaves)
        asks = got.where("NOT leaf").drop("leaf")
    return opened


def asks_of(tree: Tree, own: DataFrame, k: int) -> DataFrame | None:
    """(u, node, n): the further leaves that each block has to open, and how many points it has."""
    blocks = blocks_of(tree, own, k)
    opened = visits_of(tree, blocks)
    return None if opened is None else opened.join(blocks.select(F.col("block").alias("u"), "n"), "u")


def _opened(tree: Tree, blocks: DataFrame, k: int) -> DataFrame | None:
    """(u, w, first, d): what each point may find nearer than its k-th in further leaves."""
    visits = visits_of(tree, blocks)
    if visits is None:
        return None
    # sibling blocks of about RUN points are one group
    before = Window.partitionBy("up").orderBy("node", "block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("block", "node", "n", F.floor((F.col("node") - 1) / FAN).alias("up"))
    groups = sizes.select("block", F.concat_ws("/", "up", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / RUN)).alias("group"))
    groups = stored(groups, "groups")
    met = visits.join(groups.withColumnRenamed("block", "u"), "u").select("group", "node").distinct().join(blocks.select("node", "block", "n"), "node")
    before = Window.partitionBy("group").orderBy("node", "block").rowsBetween(Window.unboundedPreceding, -1)
    met = stored(met.select("group", "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / MEET).alias("part")), "met")
    right = met.join(blocks, "block")  # both sides are of one table
    right = right.select(*[F.col(c).alias(c) for c in ("group", "part", "n", "node", "u", "first", "x", "centre", "radius")])
    left = groups.join(met.select("group", "part").distinct(), "group").join(blocks, "block").select("group", "part", "n", "node", "u", "x", "own")
    return left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(_nearest_in_blocks(k), FOUND)


def nearest_distinct(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(u, w, first, d): the k other points nearest to each of ``points`` (u, first, v), by
    distance, then by ``first``."""
    tree = build(points, seed)
    inside = tree.leaves.select("node", "u", "v")
    own = stored(_together(inside, tree.leaves, _nearest_in_leaf(k), FOUND), "own-leaf")
    opened = _opened(tree, blocks_of(tree, own, k), k) if tree.levels else None
    if opened is None:
        return own
    every = own.unionByName(opened)
    best = Window.partitionBy("u").orderBy("d", "first")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).drop("rank")


def nearest(points: DataFrame, k: int, seed: int = 42) -> DataFrame:
    """(i, near): of each row of ``points`` (i string, unique; v array<double> of one length)
    the k nearest others as an array of (d, j), by distance, then by j.

    Fewer than k others give a shorter array; one row alone an empty one.  Rows of a
    null i or v are left out.  The result does not depend on the partitioning."""
    named = points.where("i IS NOT NULL AND v IS NOT NULL").select("i", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))  # -0.0 is 0.0
    named = stored(named.withColumn("u", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("string")), ","), 256)), "points")
    distinct = stored(named.groupBy("u").agg(F.first("v").alias("v"), F.min("i").alias("first"), F.count(F.lit(1)).alias("n")), "distinct")
    smallest = named.select("u", "i", F.row_number().over(Window.partitionBy("u").orderBy("i")).alias("rank")).where(F.col("rank") <= k + 1)
    ids = stored(smallest.groupBy("u").agg(F.collect_list("i").alias("ids")), "smallest-ids")  # k + 1 at most
    pairs = nearest_distinct(distinct.select("u", "first", "v"), k, seed).select("u", "w", "d")
    pairs = pairs.unionByName(distinct.select("u", F.col("u").alias("w"), F.lit(0.0).alias("d")))
    each = pairs.join(ids.withColumnRenamed("u", "w"), "w").select("u", "d", F.explode("ids").alias("j"))
    # (k + 1) * (k + 1) at most
    near = each.groupBy("u").agg(F.slice(F.sort_array(F.collect_list(F.struct("d", "j"))), 1, k + 1).alias("near"))
    hot = distinct.where(F.col("n") > RUN).select("u", F.ceil(F.col("n") / RUN).alias("parts"))
    last = F.coalesce("parts", F.lit(1).cast("long")) - 1
    spread = near.join(hot, "u", "left").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("parts")
    dealt = named.select("i", "u").join(hot, "u", "left").withColumn("part", F.pmod(F.xxhash64("i"), last + 1)).drop("parts")
    return dealt.join(spread, ["u", "part"]).select("i", F.slice(F.filter("near", lambda x: x["j"] != F.col("i")), 1, k).alias("near"))
