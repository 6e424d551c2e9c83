"""The metric tree against brute force: ties, copies, hot vectors, deep trees, any partitioning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from contrail.operators import neighbours as N


def brute(ids, x, k):
    out = {}
    for i, a in zip(ids, x, strict=True):
        d = np.zeros(len(x))
        for c in range(x.shape[1]):
            d += (x[:, c] - a[c]) ** 2
        order = sorted((float(np.sqrt(v)), j) for v, j in zip(d, ids, strict=True) if j != i)
        out[i] = order[:k]
    return out


def found(spark, ids, x, k, parts=3):
    rows = spark.createDataFrame([(i, v) for i, v in zip(ids, x.tolist(), strict=True)], "i string, v array<double>")
    got = N.nearest(rows.repartition(parts), k).collect()
    assert len(got) == len(ids)
    return {r["i"]: [(p["d"], p["j"]) for p in r["near"]] for r in got}


@pytest.fixture
def small_nodes(monkeypatch):
    for name, value in (("FAN", 4), ("LEAF", 24), ("RUN", 50)):
        monkeypatch.setattr(N, name, value)


def test_nearest_equals_brute_force(spark, small_nodes):
    r = np.random.default_rng(9)
    x = np.concatenate([r.normal(size=(300, 4)), r.normal(6, 0.1, (150, 4)), np.tile(r.normal(size=4), (150, 1)),
                        r.integers(0, 3, (200, 4)).astype(float)])  # a hot vector, and many ties
    ids = [f"{i:04d}" for i in r.permutation(len(x))]
    assert found(spark, ids, x, 5) == brute(ids, x, 5)


def test_result_does_not_depend_on_the_partitioning(spark, small_nodes):
    r = np.random.default_rng(1)
    x = r.integers(0, 6, (200, 3)).astype(float)
    ids = [str(i) for i in range(200)]
    assert found(spark, ids, x, 3, 1) == found(spark, ids, x, 3, 7) == brute(ids, x, 3)


@pytest.mark.parametrize("x", [np.zeros((1, 2)), np.zeros((40, 2)), np.array([[0.0, 1.0], [-0.0, 1.0], [5.0, 5.0]]), np.arange(80.0).reshape(80, 1) ** 8])
def test_few_or_odd_points(spark, small_nodes, x):
    ids = [f"{i:02d}" for i in range(len(x))]
    assert found(spark, ids, x, 5) == brute(ids, x, 5)


def test_rows_without_id_or_vector_and_no_rows(spark):
    rows = spark.createDataFrame([("a", [1.0]), (None, [1.0]), ("b", None), ("c", [4.0])], "i string, v array<double>")
    assert sorted((r["i"], [tuple(n) for n in r["near"]]) for r in N.nearest(rows, 5).collect()) == [("a", [(3.0, "c")]), ("c", [(3.0, "a")])]
    assert N.nearest(rows.limit(0), 5).count() == 0


def test_a_point_opens_few_leaves(spark, monkeypatch):
    """On clustered points each asks few of all leaves, and no node of many asks is one group."""
    monkeypatch.setattr(N, "LEAF", 64)
    monkeypatch.setattr(N, "FAN", 8)
    r = np.random.default_rng(3)
    x = (r.normal(size=(60, 5))[:, None, :] * 20 + r.normal(size=(60, 40, 5))).reshape(-1, 5)
    points = spark.createDataFrame([(str(i), str(i), v) for i, v in enumerate(x.tolist())], "u string, first string, v array<double>")
    tree = N.build(points)
    own = N._together(tree.leaves.select("node", "u", "v"), tree.leaves, N._nearest_in_leaf(5), "u string, w string, first string, d double")
    leaves = tree.leaves.select("node").distinct().count()
    assert tree.leaves.count() == len(x) and tree.leaves.groupBy("node").count().agg(F.max("count")).first()[0] <= 64
    assert N.asks_of(tree, own, 5).count() < 0.2 * leaves * len(x)


def test_a_leaf_adds_up_few_distances(spark, monkeypatch):
    """Bounds of a matrix product rule out pairs before their distances are added up, in a point's own leaf
    and in those it opens; the nearest are those of the plain distances."""
    import pyarrow as pa

    r = np.random.default_rng(5)
    x = np.concatenate([r.normal(1e6, 1, (300, 30)), r.normal(1e6, 1e-3, (100, 30))])
    ids = [f"{i:04d}" for i in range(len(x))]
    points = pa.table({"u": ids, "first": ids, "v": pa.array(x.tolist())})
    added, plain = [], N._pair_distances
    monkeypatch.setattr(N, "_pair_distances", lambda a, b, i, j: added.append(len(i)) or plain(a, b, i, j))
    want = brute(ids, x, 5)

    def by_ask(t):
        out = {i: [] for i in ids}
        for row in t.to_pylist():
            out[row["u"]].append((row["d"], row["w"]))
        return {u: sorted(v) for u, v in out.items()}

    assert by_ask(N._nearest_in_leaf(5)(points.select(["u", "v"]), points)) == want
    # an ask that knows its bound gets nothing beyond it
    most = pa.array([want[u][2][0] for u in ids])
    got = by_ask(N._nearest_in_leaf(5)(points.select(["u", "v"]).append_column("most", most), points))
    assert got == {u: [n for n in want[u] if n[0] <= want[u][2][0]] for u in ids}
    assert sum(added) < 0.3 * 2 * len(x) ** 2


def test_blocks_of_wide_points_meet_once(spark, monkeypatch):
    """In many columns each point opens most leaves: its vector is not moved to each of them, and
    comparing few columns first leaves out no neighbour (ties, copies and values that are no numbers among them)."""
    for name, value in (("FAN", 4), ("LEAF", 24), ("RUN", 100), ("MEET", 150)):
        monkeypatch.setattr(N, name, value)
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(1e3, 1, (250, 40)), r.integers(0, 2, (150, 40)).astype(float), r.normal(size=(60, 40)) * (np.arange(40) < 3)])
    ids = [f"{i:04d}" for i in r.permutation(len(x))]
    points = spark.createDataFrame([(i, i, v) for i, v in zip(ids, x.tolist(), strict=True)], "u string, first string, v array<double>")
    tree = N.build(points)
    own = N._together(tree.leaves.select("node", "u", "v"), tree.leaves, N._nearest_in_leaf(5), N.FOUND)
    leaves = tree.leaves.select("node").distinct().count()
    opened = N.asks_of(tree, own, 5)
    # a row for a block and a leaf, not for a point and a leaf
    assert opened.count() <= 2 * leaves ** 2 < 0.5 * opened.agg(F.sum("n")).first()[0]
    assert found(spark, ids, x, 5) == brute(ids, x, 5)


def test_few_columns_rule_out_no_near_pair():
    r = np.random.default_rng(2)
    x, y = r.normal(1e4, 1, (300, 48)), r.normal(1e4, 1, (400, 48))
    y[:100] = x[:100] + r.normal(0, 1e-4, (100, 48))
    x[7], y[9] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        plain = N.distances(x, y)
    most = np.array([np.quantile(d[d < np.inf], 0.02) if (d < np.inf).any() else 1.0 for d in plain])
    most[5] = np.inf
    sketch = N._Sketch(x)
    assert sketch.axes.shape == (48, 6)
    i, j = N._near_pairs(x, y, most, 5, sketch, sketch.of(x))
    got = set(zip(i.tolist(), j.tolist()))
    for a in range(len(x)):
        near = sorted((d, b) for b, d in enumerate(plain[a]) if d <= most[a] and d < np.inf)[:5]
        assert {(a, b) for _, b in near} <= got
    assert len(got) < 0.1 * len(x) * len(y)
    far = N._pair_distances(x, y, i, j, most[i])
    kept = far < np.inf
    assert (far[kept] == plain[i, j][kept]).all() and (plain[i, j][~kept] > most[i][~kept]).all()
    assert N._Sketch(x[:, :4]).axes is None
