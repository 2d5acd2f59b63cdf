"""What the face operators read again and move."""

import pytest
from pyspark.sql import functions as F

from skyfold.operators import mesh as ms


@pytest.fixture(scope="module")
def strip(spark):
    """Two strips of triangles, the second with edges too long to be admitted; vertex 90 is unused, vertex 2 of mesh 0 stands twice."""
    side = lambda m: 1.0 if m == 0 else 10.0
    at = [(m, v, v // 2 * side(m), v % 2 * side(m), 0.0, 0.0, 0.0, -1.0) for m in (0, 1) for v in range(8)] + [(0, 90, 9.0, 9.0, 9.0, 0.0, 0.0, 1.0)]
    vertices = spark.createDataFrame([*at, at[2]], "mesh_id long, v long, x double, y double, z double, nx double, ny double, nz double")
    faces = spark.createDataFrame([(m, v, v, v + 1, v + 2) for m in (0, 1) for v in range(6)], "mesh_id long, f long, v0 long, v1 long, v2 long")
    return vertices, faces


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_admitted_faces_are_judged_once(strip, capsys):
    vertices, faces = strip
    one = ms.admit_faces(faces.where("mesh_id = 0"), vertices, 3.0)
    assert "Join" not in plan_of(one, capsys)
    both = ms.admit_faces(faces, vertices, 3.0)
    assert "LocalTableScan" not in (plan := plan_of(both, capsys)) and "RDD" not in plan  # neither faces nor vertices are met again
    turned = {(r.f, r.v1 < r.v2) for r in both.where("mesh_id = 0").collect()}
    assert turned == {(f, f % 2 == 0) for f in range(6)}
    assert both.where("mesh_id = 0").count() == 3 + 6  # faces at the vertex that stands twice come twice
    assert both.where("mesh_id = 1").count() > 0  # no short face: the shortest stay


def test_compact_numbers_vertices_once(spark, strip, capsys):
    vertices, faces = (df.where("mesh_id = 1") for df in strip)
    kept, renamed = ms.compact(vertices, faces.where("f > 1"))
    assert "Window" not in plan_of(renamed, capsys)
    assert sorted(r.v for r in kept.collect()) == list(range(6))
    assert sorted((r.f, r.v0, r.v1, r.v2) for r in renamed.collect()) == [(f, f - 2, f - 1, f) for f in range(2, 6)]


def test_corners_of_whole_and_cut_meshes_agree(spark, strip, capsys):
    vertices, faces = strip
    missing = spark.createDataFrame([(0, 50, 0, 1, None), (0, 51, 0, 1, 70), (5, 52, 0, 1, 2), (None, 53, 0, 1, 2)], faces.schema)
    faces = faces.unionByName(missing).unionByName(faces.where("mesh_id = 1 AND f = 2"))
    listed = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    whole, cut, dealt = (listed(ms.with_corners(faces, vertices, ("x", "nz"), w)) for w in (1000, 0, 9))
    assert whole == cut == dealt and len(whole) == 6 + 3 + 6 + 1
    assert "Join" not in plan_of(ms.with_corners(faces, vertices), capsys).replace("BroadcastHashJoin", "")
    up = vertices.withColumn("nz", F.lit(-1.0))  # a column that is never NULL
    assert ms.with_corners(faces, up, ("x", "nz")).where("p0.nz = -1 AND p2.nz = -1").count() == len(whole)
