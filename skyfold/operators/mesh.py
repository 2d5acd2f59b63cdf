"""Mesh tables: geometry, clean-up, components, smoothing, density, statistics.

``vertices(mesh_id, v, x, y, z, conf)`` and ``faces(mesh_id, f, v0, v1, v2)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from skyfold.functions import linalg as la
from skyfold.functions.linalg import rounded
from skyfold.operators.components import connected_components
from skyfold.operators.neighbours import k_nearest
from skyfold.operators.ordered import running_index
from skyfold.operators.quantiles import exact_quantiles
from skyfold.session import cut_lineage, spread

KEY = ["mesh_id"]
# Share of faces kept by each density setting, confidence bands.
DENSITY = {"high": 1.0, "ultra": 1.0, "full": 1.0, "medium": 0.65, "balanced": 0.65, "low": 0.35, "fast": 0.35, "compact": 0.35}
HIGH_CONF, MEDIUM_CONF = 0.70, 0.45
#: Vertices of a mesh, and faces, that one task holds: some 100 bytes of each.
WHOLE = 262_144


def _corner_kernel(face_columns: Sequence[str], columns: Sequence[str]):
    """Faces of a mesh with the corners found among all its vertices; a number that stands twice gives two rows, as a join does."""

    def kernel(faces: pa.Table, vertices: pa.Table) -> pa.Table:
        v = vertices.column("v").to_numpy()
        order = np.argsort(v, kind="stable")
        v, rows, found = v[order], np.arange(faces.num_rows), []
        for i in range(3):
            wanted = faces.column(f"v{i}").to_numpy()[rows]
            first = np.searchsorted(v, wanted, "left")
            n = np.searchsorted(v, wanted, "right") - first
            each = np.repeat(np.arange(len(rows)), n)
            at = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n) + first[each]
            rows, found = rows[each], [*(f[each] for f in found), order[at]]
        out = faces.select(face_columns).take(pa.array(rows))
        for i, at in enumerate(found):
            parts = [pa.concat_arrays(vertices.column(c).chunks).take(pa.array(at)) for c in columns]
            out = out.append_column(f"p{i}", pa.StructArray.from_arrays(parts, names=list(columns)))
        return out

    return kernel


def with_corners(faces: DataFrame, vertices: DataFrame, columns: Sequence[str] = ("x", "y", "z"), whole: int = WHOLE) -> DataFrame:
    """Adds the given vertex columns of the three corners as structs p0, p1, p2. Runs jobs; the faces are written once.

    A mesh of up to ``whole`` vertices is held by one task for each ``whole`` faces, so faces and vertices are
    moved once; larger ones are joined corner by corner.
    """
    faces = cut_lineage(faces)
    held = vertices.select(*KEY, "v", *columns).dropna(subset=[*KEY, "v"])
    sizes = faces.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / max(1, whole)).cast("int").alias("_parts"))
    deal = cut_lineage(sizes.join(held.groupBy(*KEY).agg((F.count(F.lit(1)) > whole).alias("_cut")), KEY))
    small = deal.where("NOT _cut").drop("_cut")
    corners = [f"v{i}" for i in range(3)]
    asking = faces.dropna(subset=corners).join(small, KEY).withColumn("_part", F.pmod(F.xxhash64(*corners), F.col("_parts")).cast("int")).drop("_parts")
    giving = held.join(small, KEY).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    asking, giving = (spread(side.toDF(*side.columns), *KEY, "_part") for side in (asking, giving))
    struct = T.StructType([T.StructField(c, held.schema[c].dataType) for c in columns])
    schema = T.StructType([*faces.schema.fields, *(T.StructField(f"p{i}", struct) for i in range(3))])
    out = asking.groupBy(*KEY, "_part").cogroup(giving.groupBy(*KEY, "_part")).applyInArrow(_corner_kernel(faces.columns, columns), schema)
    cut = deal.where("_cut").select(*KEY)
    if cut.isEmpty():
        return out
    large = faces.join(cut, KEY, "left_semi")
    for i in range(3):
        corner = held.select(*KEY, F.col("v").alias(f"v{i}"), F.struct(*columns).alias(f"p{i}"))
        large = large.join(corner, [*KEY, f"v{i}"])
    return out.unionByName(large.select(*out.columns))


def _at(p: str) -> la.Vec:
    return tuple(F.col(f"{p}.{c}") for c in "xyz")


def face_geometry(faces: DataFrame, vertices: DataFrame, columns: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Edge lengths, area, unit normal and centroid of each face, with the corners."""
    out = with_corners(faces, vertices, columns)
    p0, p1, p2 = (_at(f"p{i}") for i in range(3))
    normal = la.cross(la.sub(p1, p0), la.sub(p2, p0))
    out = out.withColumns({
        "e0": la.norm(la.sub(p1, p0)), "e1": la.norm(la.sub(p2, p1)), "e2": la.norm(la.sub(p0, p2)),
        **{f"_n{c}": normal[i] for i, c in enumerate("xyz")},
        **{f"c{c}": (p0[i] + p1[i] + p2[i]) / 3.0 for i, c in enumerate("xyz")},
    }).withColumn("area2", la.norm(la.vec("_n")))
    size = F.when(F.col("area2") == 0, 1.0).otherwise(F.col("area2"))
    return out.withColumn("area", F.col("area2") * 0.5).withColumns({f"n{c}": F.col(f"_n{c}") / size for c in "xyz"}).drop("_nx", "_ny", "_nz")


def admit_faces(faces: DataFrame, vertices: DataFrame, edge_limit: float | DataFrame = 5.0) -> DataFrame:
    """Faces that do not span a void: short edges, real area, small circumradius; the
    winding follows the vertex normals. A mesh with no such face keeps its shortest 40%.

    ``vertices`` needs ``nx, ny, nz``; the limit is a number or ``mesh_id, edge_limit``.
    Runs jobs; the verdicts are written once, so the corners are met once.
    """
    geo = face_geometry(faces, vertices, ("x", "y", "z", "nx", "ny", "nz"))
    geo = geo.join(edge_limit.select(*KEY, "edge_limit"), KEY) if isinstance(edge_limit, DataFrame) else geo.withColumn("edge_limit", F.lit(float(edge_limit)))
    longest = F.greatest("e0", "e1", "e2")
    p0, p1, p2 = (_at(f"p{i}") for i in range(3))
    flat = 0.5 * F.abs((p1[0] - p0[0]) * (p2[1] - p0[1]) - (p2[0] - p0[0]) * (p1[1] - p0[1]))
    round_ok = (flat <= 1e-6) | (F.col("e0") * F.col("e1") * F.col("e2") / (4.0 * F.greatest(flat, F.lit(1e-12))) <= F.col("edge_limit") * 1.5)
    mean = tuple(sum((F.col(f"p{i}.n{c}") for i in range(3)), F.lit(0.0)) / 3.0 for c in "xyz")
    judged = cut_lineage(geo.select(
        *KEY, "f", "v0", "v1", "v2", longest.alias("_long"),
        ((longest <= F.col("edge_limit")) & (F.col("area2") >= 1e-6) & round_ok).alias("_ok"),
        (la.dot(la.vec("n"), mean) < 0).alias("_flip"),
    ))
    empty = cut_lineage(judged.groupBy(*KEY).agg(F.bool_or("_ok").alias("_any")).where("NOT _any").select(*KEY))
    if empty.isEmpty():
        kept = judged.where("_ok")
    else:
        cut = exact_quantiles(judged.join(empty, KEY, "left_semi"), KEY, "_long", {"_cut": 0.4})
        kept = judged.join(cut, KEY, "left").where(F.col("_ok") | (F.col("_long") <= F.col("_cut")))
    turn = F.col("_flip") & F.col("_ok")
    return kept.select(
        *KEY, "f", "v0", F.when(turn, F.col("v2")).otherwise(F.col("v1")).alias("v1"),
        F.when(turn, F.col("v1")).otherwise(F.col("v2")).alias("v2"),
    )


def grid_surface(points: DataFrame, cell: float, key: str = "cloud_id") -> tuple[DataFrame, DataFrame]:
    """Surface of a cloud: a vertex per occupied plan cell, two triangles per full 2x2 block."""
    at = lambda c: F.floor(F.col(c) / cell).cast("long")
    return _cell_surface(points.select(F.col(key).alias("mesh_id"), at("x").alias("i"), at("y").alias("j"), "x", "y", "z", "conf"))


def preview_surface(points: DataFrame, key: str = "mesh_id", across: int = 32, least_points: int = 4) -> tuple[DataFrame, DataFrame]:
    """A quick coarse surface of each cloud of sparse points: ``across`` cells along its longer side.

    Clouds of fewer than ``least_points`` points have no surface; none is invented.
    """
    span = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-6))
    # a little wider, so that the last point lies inside the last cell
    box = points.groupBy(key).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), (span * 1.001 / across).alias("_cell"), F.count(F.lit(1)).alias("_n"))
    placed = points.join(box.where(F.col("_n") >= least_points), key)
    at = lambda c: F.floor((F.col(c) - F.col(f"_{c}0")) / F.col("_cell")).cast("long")
    return _cell_surface(placed.select(F.col(key).alias("mesh_id"), at("x").alias("i"), at("y").alias("j"), "x", "y", "z", "conf"))


def _cell_surface(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    cells = placed.groupBy("mesh_id", "i", "j").agg(*[F.avg(c).alias(c) for c in ("x", "y", "z", "conf")])
    v = lambda i, j: (i + 2**20) * 2**21 + (j + 2**20)
    vertices = cells.select("mesh_id", v(F.col("i"), F.col("j")).alias("v"), "x", "y", "z", "conf")
    base = cells.select("mesh_id", "i", "j")
    block = base
    for di, dj in ((1, 0), (0, 1), (1, 1)):
        block = block.join(base.select("mesh_id", (F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")), ["mesh_id", "i", "j"], "left_semi")
    i, j = F.col("i"), F.col("j")
    tri = lambda n, a, b, c: F.struct((v(i, j) * 2 + n).alias("f"), a.alias("v0"), b.alias("v1"), c.alias("v2"))
    faces = block.select("mesh_id", F.explode(F.array(
        tri(0, v(i, j), v(i + 1, j), v(i, j + 1)), tri(1, v(i + 1, j), v(i + 1, j + 1), v(i, j + 1)),
    )).alias("t")).select("mesh_id", "t.*")
    return vertices, faces


def drop_degenerate(faces: DataFrame, vertices: DataFrame, least_area: float = 1e-7) -> DataFrame:
    distinct = faces.where("v0 <> v1 AND v1 <> v2 AND v2 <> v0")
    return face_geometry(distinct, vertices).where(F.col("area") >= least_area).select(faces.columns)


def face_edges(faces: DataFrame) -> DataFrame:
    """The three undirected edges of each face."""
    edge = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    return faces.select(*KEY, "f", F.explode(F.array(edge("v0", "v1"), edge("v1", "v2"), edge("v2", "v0"))).alias("e")).select(*KEY, "f", "e.*")


def edge_counts(faces: DataFrame) -> DataFrame:
    return face_edges(faces).groupBy(*KEY, "a", "b").agg(F.count(F.lit(1)).alias("uses"))


def drop_non_manifold(faces: DataFrame) -> DataFrame:
    """Drops faces with an edge used by more than two faces."""
    bad = edge_counts(faces).where("uses > 2").select(*KEY, "a", "b")
    hit = face_edges(faces).join(bad, [*KEY, "a", "b"], "left_semi").select(*KEY, "f").distinct()
    return faces.join(hit, [*KEY, "f"], "left_anti").select(faces.columns)


def boundary_edges(faces: DataFrame) -> DataFrame:
    return edge_counts(faces).where("uses = 1").select(*KEY, "a", "b")


def face_corners(faces: DataFrame) -> DataFrame:
    return faces.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("v"))


def compact(vertices: DataFrame, faces: DataFrame, chunk: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Drops unused vertices and numbers the rest densely, in id order. Runs jobs; the new numbers are written once."""
    used = vertices.join(face_corners(faces).distinct(), [*KEY, "v"], "left_semi")
    numbered = running_index(used, KEY, ["v"], F.floor(F.col("v") / chunk), "new_v")
    mapping = cut_lineage(numbered.select(*KEY, "v", "new_v"))
    out = faces
    for i in range(3):
        out = out.join(mapping.select(*KEY, F.col("v").alias(f"v{i}"), F.col("new_v").alias(f"_w{i}")), [*KEY, f"v{i}"])
    renamed = out.select(*KEY, "f", *[F.col(f"_w{i}").alias(f"v{i}") for i in range(3)])
    return numbered.drop("v").withColumnRenamed("new_v", "v").select(vertices.columns), renamed


def face_components(faces: DataFrame) -> DataFrame:
    """Component label of each face; faces touch when an edge belongs to exactly those two. Runs jobs; the faces are written once."""
    faces = cut_lineage(faces)
    links = face_edges(faces).groupBy(*KEY, "a", "b").agg(
        F.count(F.lit(1)).alias("n"), F.min("f").alias("fa"), F.max("f").alias("fb")
    ).where("n = 2")
    return connected_components(faces, links, KEY, "f", "fa", "fb", "component")


def prune_components(faces: DataFrame, min_faces: int = 15) -> DataFrame:
    """Drops small components; the limit is at least 0.5% of big meshes, the largest always stays."""
    labelled = cut_lineage(face_components(faces))
    sizes = labelled.groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("_size"))
    totals = sizes.groupBy(*KEY).agg(
        F.sum("_size").alias("_all"), F.max_by("component", F.struct(F.col("_size"), -F.col("component"))).alias("_largest")
    )
    least = F.when(F.col("_all") > 200, F.greatest(F.lit(min_faces), F.floor(F.col("_all") * 0.005))).otherwise(F.lit(min_faces))
    kept = sizes.join(totals, KEY).where((F.col("_size") >= least) | (F.col("component") == F.col("_largest")))
    return labelled.join(kept.select(*KEY, "component"), [*KEY, "component"], "left_semi").select(faces.columns)


def component_sizes(faces: DataFrame) -> DataFrame:
    return face_components(faces).groupBy(*KEY, "component").agg(F.count(F.lit(1)).alias("faces"))


def smooth(vertices: DataFrame, faces: DataFrame, passes: int = 2, weight: float = 0.30) -> DataFrame:
    """Moves inner vertices towards the mean of their neighbours; borders stay exact.

    Every pass reads the positions of the pass before.
    """
    edges = edge_counts(faces)
    both = edges.select(*KEY, F.explode(F.array(
        F.struct(F.col("a").alias("v"), F.col("b").alias("o")), F.struct(F.col("b").alias("v"), F.col("a").alias("o"))
    )).alias("e"), (F.col("uses") == 1).alias("border")).select(*KEY, "e.*", "border")
    ring = cut_lineage(both) if passes > 1 else both
    fixed = ring.where("border").select(*KEY, "v").distinct().withColumn("_fixed", F.lit(True))
    out = vertices
    for i in range(passes):
        near = ring.join(out.select(*KEY, F.col("v").alias("o"), *"xyz"), [*KEY, "o"])
        mean = near.groupBy(*KEY, "v").agg(*[F.avg(c).alias(f"_m{c}") for c in "xyz"]).join(fixed, [*KEY, "v"], "left_anti")
        out = out.join(mean, [*KEY, "v"], "left").withColumns(
            {c: F.col(c) + F.coalesce(weight * (F.col(f"_m{c}") - F.col(c)), F.lit(0.0)) for c in "xyz"}
        ).select(vertices.columns)
        if i < passes - 1:
            out = cut_lineage(out)
    return out


def density_ratio(setting: str | float) -> float:
    if isinstance(setting, str):
        return DENSITY.get(setting.strip().lower(), 0.65)
    return min(1.0, max(0.1, float(setting)))


def reduce_density(vertices: DataFrame, faces: DataFrame, setting: str | float = "medium") -> tuple[DataFrame, DataFrame]:
    """Fewer faces by merging the vertices of cubes; confidence from the nearest old vertex.

    Meshes under 50 faces and settings of 98% and more are left as they are.
    """
    ratio = density_ratio(setting)
    if ratio >= 0.98:
        return vertices, faces
    boxes = vertices.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("_n"), *[(F.max(c) - F.min(c)).alias(f"_s{c}") for c in "xy"]
    )
    counts = faces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_f"))
    side = F.sqrt(F.greatest(F.col("_sx") * F.col("_sy"), F.lit(1e-9)) / F.greatest(F.lit(4.0), F.col("_n") * ratio))
    plan = boxes.join(counts, KEY, "left").select(*KEY, F.when(F.coalesce("_f", F.lit(0)) >= 50, side).alias("_side"))
    sited = vertices.join(plan, KEY)
    cell = lambda c: F.when(F.col("_side").isNull(), F.col("v")).otherwise(F.floor(F.col(c) / F.col("_side")).cast("long"))
    sited = sited.withColumns({f"_i{c}": cell(c) for c in "xyz"})
    group = [*KEY, "_ix", "_iy", "_iz"]
    merged = sited.groupBy(*group).agg(F.min("v").alias("_to"), *[F.avg(c).alias(c) for c in "xyz"])
    mapping = sited.select(*KEY, "v", *group[1:]).join(merged.select(*group, "_to"), group).select(*KEY, "v", "_to")
    new_faces = faces
    for i in range(3):
        new_faces = new_faces.join(mapping.select(*KEY, F.col("v").alias(f"v{i}"), F.col("_to").alias(f"_t{i}")), [*KEY, f"v{i}"])
    corners = F.array_sort(F.array("_t0", "_t1", "_t2"))
    new_faces = new_faces.where("_t0 <> _t1 AND _t1 <> _t2 AND _t2 <> _t0").groupBy(*KEY, corners.alias("_set")).agg(
        F.min_by(F.struct("f", F.col("_t0").alias("v0"), F.col("_t1").alias("v1"), F.col("_t2").alias("v2")), F.col("f")).alias("t")
    ).select(*KEY, "t.*")
    new_vertices = merged.select(*KEY, F.col("_to").alias("v"), *"xyz").join(face_corners(new_faces).distinct(), [*KEY, "v"], "left_semi")
    nearest = k_nearest(vertices, 1, KEY, "v", new_vertices, "v").select(*KEY, "v", F.get("nbrs", F.lit(0))["id"].alias("_old"))
    conf = vertices.select(*KEY, F.col("v").alias("_old"), "conf")
    return new_vertices.join(nearest, [*KEY, "v"]).join(conf, [*KEY, "_old"]).drop("_old"), new_faces


def mesh_statistics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Counts, box, area, density, edge length and confidence shares per mesh."""
    share = lambda c: rounded(F.avg(F.when(c, 1.0).otherwise(0.0)) * 100, 1)
    k = F.col("conf")
    v = vertices.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("vertices"),
        *[rounded(f(c), 3).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
        rounded(F.avg(k), 3).alias("mean_conf"), rounded(F.min(k), 3).alias("min_conf"), rounded(F.max(k), 3).alias("max_conf"),
        share(k >= HIGH_CONF).alias("high_pct"), share((k >= MEDIUM_CONF) & (k < HIGH_CONF)).alias("medium_pct"),
        share(k < MEDIUM_CONF).alias("low_pct"),
    )
    medians = exact_quantiles(vertices, KEY, "conf", {"_m": 0.5}).select(*KEY, rounded(F.col("_m"), 3).alias("median_conf"))
    geo = face_geometry(faces, vertices, ("x", "y", "z", "conf"))
    face_conf = (F.col("p0.conf") + F.col("p1.conf") + F.col("p2.conf")) / 3.0
    f = geo.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("triangles"), F.sum("area").alias("_area"),
        rounded(F.avg((F.col("e0") + F.col("e1") + F.col("e2")) / 3.0), 3).alias("mean_edge_m"),
        F.count_if(face_conf < MEDIUM_CONF).alias("low_conf_faces"),
    )
    n = F.coalesce("triangles", F.lit(0))
    area = F.coalesce("_area", F.lit(0.0))
    return v.join(medians, KEY).join(f, KEY, "left").select(
        *v.columns, "median_conf", n.alias("triangles"), rounded(area, 2).alias("surface_area_m2"),
        rounded(n / F.greatest(F.lit(1.0), area), 2).alias("triangles_per_m2"), F.coalesce("mean_edge_m", F.lit(0.0)).alias("mean_edge_m"),
        F.coalesce("low_conf_faces", F.lit(0)).alias("low_conf_faces"),
    )


def vertex_normals(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Normalised sum of the unit normals of the faces around each vertex."""
    unit = face_geometry(faces, vertices).where(F.col("area2") > 1e-7)
    corners = unit.select(*KEY, F.explode(F.array("v0", "v1", "v2")).alias("v"), "nx", "ny", "nz")
    sums = corners.groupBy(*KEY, "v").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in "xyz"])
    length = la.norm(la.vec("n"))
    out = vertices.join(sums, [*KEY, "v"], "left").withColumns({f"n{c}": F.coalesce(f"n{c}", F.lit(0.0)) for c in "xyz"})
    out = out.withColumn("_l", F.when(length == 0, 1.0).otherwise(length))
    return out.withColumns({f"n{c}": F.col(f"n{c}") / F.col("_l") for c in "xyz"}).drop("_l")
