"""Order, quantile, neighbour, component and as-of operators against brute force."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from skyfold.operators.asof import nearest_in_time
from skyfold.operators.components import connected_components
from skyfold.operators import components, neighbours
from skyfold.operators.neighbours import count_within, k_nearest
from skyfold.operators.ordered import running_index, with_neighbour
from skyfold.operators.quantiles import exact_quantiles
from skyfold.session import cut_lineage


def cloud(spark, xyz, cloud_id=0):
    rows = pd.DataFrame({"cloud_id": cloud_id, "point_id": np.arange(len(xyz)), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2]})
    return spark.createDataFrame(rows)


def clustered(seed=3):
    """A third of the points in a tiny cluster, a sixth copies of one position, some far away."""
    rng = np.random.default_rng(seed)
    parts = [rng.uniform(0, 100, (300, 3)), rng.normal(50, 0.01, (200, 3)), np.full((100, 3), 20.0), np.array([[1e4, 0, 0], [1e4, 1, 0.0]])]
    return np.concatenate(parts)


def brute(xyz, i, k):
    d2 = ((xyz - xyz[i]) ** 2).sum(axis=1)
    d2[i] = np.inf
    return list(np.lexsort((np.arange(len(xyz)), d2))[:k])


@pytest.mark.parametrize("k,tile", [(1, 16), (5, 16), (5, 400)])
def test_k_nearest_equals_brute_force(spark, k, tile):
    xyz = clustered()
    got = {r.point_id: [n.id for n in r.nbrs] for r in k_nearest(cloud(spark, xyz), k, tile=tile).collect()}
    assert len(got) == len(xyz)
    assert all(got[i] == brute(xyz, i, k) for i in range(len(xyz)))


def test_k_nearest_of_other_points(spark):
    xyz = clustered()
    queries = cloud(spark, np.array([[0.0, 0, 0], [50, 50, 50], [-500, 3, 3]])).withColumnRenamed("point_id", "q")
    got = {r.q: [n.id for n in r.nbrs] for r in k_nearest(cloud(spark, xyz), 3, queries=queries, query_id="q", tile=16).collect()}
    for q, p in enumerate([[0.0, 0, 0], [50, 50, 50], [-500, 3, 3]]):
        d2 = ((xyz - np.array(p)) ** 2).sum(axis=1)
        assert got[q] == list(np.lexsort((np.arange(len(xyz)), d2))[:3])


def test_fewer_points_than_k(spark):
    got = k_nearest(cloud(spark, np.array([[0.0, 0, 0], [1, 0, 0], [5, 0, 0]])), 10).collect()
    assert sorted((r.point_id, len(r.nbrs)) for r in got) == [(0, 2), (1, 2), (2, 2)]


@pytest.mark.parametrize("radius,tile", [(0.05, 16), (10.0, 16), (10.0, 1000)])
def test_count_within_equals_brute_force(spark, radius, tile):
    xyz = clustered()
    df = cloud(spark, xyz)
    got = {r.point_id: r.neighbour_count for r in count_within(df, df, radius, ["cloud_id"], "point_id", tile).collect()}
    assert all(got[i] == int((((xyz - xyz[i]) ** 2).sum(axis=1) <= radius * radius).sum()) for i in range(len(xyz)))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(st.one_of(st.floats(-1e6, 1e6), st.sampled_from([1.0, 2.0, 2.0])), min_size=1, max_size=60), accuracy=st.sampled_from([10, 1_000_000]))
def test_exact_quantiles(spark, values, accuracy):
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: r for r in exact_quantiles(df, ["k"], "v", {"lo": 0.0, "mid": 0.5, "p90": 0.9, "hi": 1.0}, accuracy).collect()}
    for k, row in got.items():
        own = [v for i, v in enumerate(values) if i % 2 == k]
        assert np.allclose([row.lo, row.mid, row.p90, row.hi], np.percentile(own, [0, 50, 90, 100]), rtol=1e-9, atol=1e-9)


def test_running_index_and_neighbour(spark):
    df = spark.createDataFrame([(1, float(t), t * 10) for t in (5, 1, 9, 30, 31)] + [(2, 1.0, 7)], "k int, t double, v int")
    chunk = F.floor(F.col("t") / 10)
    index = {(r.k, r.t): r.idx for r in running_index(df, ["k"], ["t"], chunk, "idx").collect()}
    assert [index[1, t] for t in (1.0, 5.0, 9.0, 30.0, 31.0)] == [0, 1, 2, 3, 4]
    before = {(r.k, r.t): r.p.v if r.p else None for r in with_neighbour(df, ["k"], ["t"], chunk, ["v"], "p").collect()}
    assert before[1, 30.0] == 90 and before[1, 1.0] is None and before[2, 1.0] is None
    after = {(r.k, r.t): r.p.v if r.p else None for r in with_neighbour(df, ["k"], ["t"], chunk, ["v"], "p", True).collect()}
    assert after[1, 9.0] == 300 and after[1, 31.0] is None


@pytest.mark.parametrize("span", [2.0, 1000.0])
def test_nearest_in_time(spark, span):
    rng = np.random.default_rng(5)
    fixes = [(1, i, float(t)) for i, t in enumerate(np.sort(rng.uniform(0, 60, 40)))] + [(1, 98, 10.0), (1, 99, 10.0)]
    keys = [(1, i, float(t)) for i, t in enumerate(rng.uniform(-5, 70, 50))] + [(2, 200, 1.0)]
    left = spark.createDataFrame(keys, "m int, kf int, t double")
    right = spark.createDataFrame(fixes, "m int, fix int, t double")
    rows = nearest_in_time(left, right, ["m"], "t", "t", "fix", [], 1.5, span=span).collect()
    assert len(rows) == len(keys)
    for r in rows:
        near = [f for f in fixes if f[0] == r.m and abs(f[2] - r.t) <= 1.5]
        best = min(near, key=lambda f: (abs(f[2] - r.t), f[2], f[1])) if near else None
        assert (r.match.fix if r.match else None) == (best[1] if best else None)


def test_tie_goes_to_earlier_fix(spark):
    left = spark.createDataFrame([(1, 10.0)], "m int, t double")
    right = spark.createDataFrame([(1, 5, 11.0), (1, 6, 9.0)], "m int, fix int, t double")
    assert nearest_in_time(left, right, ["m"], "t", "t", "fix", []).first().match.fix == 6


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(edges=st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=25))
def test_components_equal_union_find(spark, edges):
    parent = list(range(26))

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([(0, v) for v in range(26)], "g int, n bigint")
    links = spark.createDataFrame([(0, a, b) for a, b in edges], "g int, a bigint, b bigint")
    got = {r.n: r.component for r in connected_components(nodes, links, ["g"], "n", "a", "b").collect()}
    assert got == {v: root(v) for v in range(26)}


def test_long_chain_is_one_component(spark):
    n = 500
    nodes = spark.range(n).selectExpr("0 AS g", "id AS n")
    links = spark.range(n - 1).selectExpr("0 AS g", "id AS a", "id + 1 AS b")
    assert connected_components(nodes, links, ["g"], "n", "a", "b").select("component").distinct().count() == 1


def test_a_far_point_leaves_cubes_small(spark):
    rng = np.random.default_rng(4)
    xyz = np.vstack([rng.uniform(0, 100, (3000, 3)), [[1e7, 0, 0]]])
    points = cloud(spark, xyz)
    box = neighbours._deepened(points, neighbours._box(points, ["cloud_id"], 64), ["cloud_id"], 64)
    side, to = box.select("_side", "_to").first()
    cells = np.floor((xyz - xyz.min(axis=0)) / (side / 2.0**to))
    assert np.unique(cells, axis=0, return_counts=True)[1].max() <= 64
    got = {r.point_id: [n.id for n in r.nbrs] for r in k_nearest(points, 3, tile=64).collect()}
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d2, np.inf)
    assert all(sorted(d2[i, got[i]]) == sorted(np.sort(d2[i])[:3]) for i in range(len(xyz)))


def test_copies_of_one_position_end_the_descent(spark):
    points = cloud(spark, np.vstack([np.zeros((300, 3)), [[1.0, 0, 0]]]))
    box = neighbours._deepened(points, neighbours._box(points, ["cloud_id"], 64), ["cloud_id"], 64)
    assert box.first()["_to"] < neighbours.TOP


def test_components_contract_in_tasks_and_keep_groups_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(g, int(a), int(b)) for g in ("x", "y") for a, b in rng.integers(0, 60, (45, 2))] + [(None, 1, 2), ("x", None, 3)]
    parent = {(g, v): v for g in ("x", "y") for v in range(60)}

    def root(g, v):
        while parent[g, v] != v:
            v = parent[g, v]
        return v

    for g, a, b in rows:
        if g and a is not None:
            ra, rb = root(g, a), root(g, b)
            parent[g, max(ra, rb)] = min(ra, rb)
    nodes = spark.createDataFrame([*parent, (None, 2)], "g string, n bigint")
    links = spark.createDataFrame(rows, "g string, a bigint, b bigint")
    for held in (3, 1 << 20):  # many stars to tie together, or one task's
        got = connected_components(nodes, links, ["g"], "n", "a", "b", held=held).collect()
        assert {(r.g, r.n): r.component for r in got} == {(g, v): root(g, v) for g, v in parent} | {(None, 2): 2}


def test_a_lattice_is_contracted_before_the_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "cut_lineage", lambda df: written.append(cut_lineage(df)) or written[-1])
    nodes = spark.range(4000).selectExpr("0 AS g", "id AS n")
    links = nodes.selectExpr("g", "n AS a", "n + 1 AS b").unionByName(nodes.selectExpr("g", "n AS a", "n + 50 AS b")).where("b < 4000")
    assert connected_components(nodes, links, ["g"], "n", "a", "b").select("component").distinct().count() == 1
    assert written[2].count() < 20  # centres' links; all 7,949 links went into the rounds before
