"""What the view operators move and write."""

import pytest

from skyfold.operators import mesh as ms, views as vw

VERTICES = "mesh_id long, v long, x double, y double, z double"


@pytest.fixture(scope="module")
def plate(spark):
    """A strip of triangles under two cameras that look down; vertex 2 has a copy far away, and face 5 is out of sight."""
    vertices = spark.createDataFrame([(0, v, v // 2 * 1.0, v % 2 * 1.0, 0.1 * v) for v in range(6)] + [(0, v, 900.0 + v, v % 2 * 1.0, 0.0) for v in range(6, 9)], VERTICES)
    faces = spark.createDataFrame([(0, v, v, v + 1 + v % 2, v + 2 - v % 2) for v in range(4)] + [(0, 5, 6, 7, 8)], "mesh_id long, f long, v0 long, v1 long, v2 long")
    faces = faces.selectExpr("mesh_id", "f", "v0", "v2 v1", "v1 v2")
    places = spark.createDataFrame([(0, 1, 1.0, 0.5, 10.0), (0, 2, 1.5, 0.5, 12.0)], "mesh_id long, camera_id long, cx double, cy double, cz double")
    optics = ["100D fx", "100D fy", "50D px", "50D py", "100 w", "100 h", "0.5D quality"]
    cameras = places.selectExpr("mesh_id", "camera_id", "array(1D,0D,0D,0D,-1D,0D,0D,0D,-1D) R", "array(-cx, cy, cz) t", "cx", "cy", "cz", *optics)
    return vertices, faces, cameras


def test_targets_move_to_their_cells_only(plate, capsys):
    """What is known of a mesh is stored and small, so no join on the mesh alone moves its targets."""
    vertices, faces, cameras = plate
    targets = vw.face_targets(faces, vertices)
    capsys.readouterr()
    vw.face_views(targets, cameras).select("f", "score").explain()
    plan = capsys.readouterr().out
    assert any("BroadcastHashJoin [mesh_id#" in line for line in plan.splitlines() if "_cell#" in line and "Join" in line)


def test_colours_carry_no_corners_beyond_the_image(spark, plate, capsys):
    vertices, faces, cameras = plate
    targets = vw.face_targets(faces, vertices)
    ranked = vw.with_optics(vw.best_views(vw.face_views(targets, cameras), faces), targets, cameras)
    pixels = spark.range(10_000).selectExpr("explode(array(1L, 2L)) camera_id", "int(id % 100) x", "int(id div 100) y", "1D * camera_id * 10 r", "1D g", "2D b")
    out = vw.face_colours(ranked, pixels)
    capsys.readouterr()
    out.explain()
    plan = capsys.readouterr().out
    assert "p0" not in plan and "_cam" not in plan and "Scan parquet" in plan
    rows = {r.f: (r.r, r.g, r.b) for r in out.collect()}
    assert rows[5] == vw.UNOBSERVED and all(10 <= rows[f][0] <= 20 and rows[f][1:] == (1, 2) for f in range(4))
