"""Which camera sees what: visibility, view ranking, colours and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from skyfold.functions import linalg as la
from skyfold.functions.linalg import clip, rounded
from skyfold.operators.mesh import face_geometry
from skyfold.session import cut_lineage

KEY = ["mesh_id"]
OPTICS = ["R", "t", "cx", "cy", "cz", "fx", "fy", "px", "py", "w", "h", "quality"]
# Fixed value: colour of surfaces no camera has seen.
UNOBSERVED = (100, 116, 139)


def _flat_optics() -> list[Column]:
    """The optics as plain columns ``_cam_...``: fields of a struct and its arrays would make the code
    generated for a pair longer than the 8,000 bytes that the JVM compiles, and it would be interpreted."""
    parts = {"R": 9, "t": 3}
    return [
        c for n in OPTICS
        for c in ([F.col(n)[i].alias(f"_cam_{n}{i}") for i in range(parts[n])] if n in parts else [F.col(n).alias(f"_cam_{n}")])
    ]


def _cam_depth(point: la.Vec) -> Column:
    """Depth of a point in the camera of ``_flat_optics``."""
    r = [F.col(f"_cam_R{i}") for i in (6, 7, 8)]
    return la.dot(r, point) + F.col("_cam_t2")


def camera_gate(cameras: DataFrame, min_sharpness: float = 30.0, min_exposure: float = 0.20) -> DataFrame:
    """Cameras sharp and well exposed enough; a mesh that would lose all keeps its best one."""
    good = (F.col("sharpness") >= min_sharpness) & (F.col("exposure") >= min_exposure)
    best = cameras.groupBy(*KEY).agg(
        F.bool_or(good).alias("_any"), F.max_by("camera_id", F.struct(F.col("quality"), -F.col("camera_id"))).alias("_best")
    )
    return cameras.join(best, KEY).where(good | (~F.col("_any") & (F.col("camera_id") == F.col("_best")))).drop("_any", "_best")


def _footprints(cameras: DataFrame, bounds: DataFrame) -> DataFrame:
    """Plan rectangle of what each camera can see between the lowest and highest target.

    Where all corner rays go down (or all up) the seen part of the slab is the
    hull of their hits, with the camera itself when it is inside the slab.
    Otherwise the whole plan of the mesh is taken.
    """
    j = cameras.join(bounds, KEY)
    r = la.transpose(la.arr9("R"))
    rays = []
    for u, v in ((F.lit(0.0), F.lit(0.0)), (F.col("w"), F.lit(0.0)), (F.lit(0.0), F.col("h")), (F.col("w"), F.col("h"))):
        rays.append(la.mat_vec(r, ((u - F.col("px")) / F.col("fx"), (v - F.col("py")) / F.col("fy"), F.lit(1.0))))
    down = F.greatest(*[d[2] for d in rays]) < -1e-6
    up = F.least(*[d[2] for d in rays]) > 1e-6
    far = F.when(down, F.col("_zlo")).otherwise(F.col("_zhi"))
    near = F.when(down, F.least("_zhi", "cz")).otherwise(F.greatest("_zlo", "cz"))
    past = F.when(down, F.col("cz") < F.col("_zlo")).otherwise(F.col("cz") > F.col("_zhi"))

    def hits(axis: int, centre: str) -> list[Column]:
        return [F.col(centre) + F.try_divide((plane - F.col("cz")) * d[axis], d[2]) for d in rays for plane in (near, far)]

    out = j.withColumn("_clear", down | up)
    for axis, c in enumerate("xy"):
        h = hits(axis, f"c{c}")
        out = out.withColumn(f"_a{c}", F.greatest(F.when(F.col("_clear"), F.least(*h)).otherwise(F.col(f"_{c}lo")), F.col(f"_{c}lo")))
        out = out.withColumn(f"_b{c}", F.least(F.when(F.col("_clear"), F.greatest(*h)).otherwise(F.col(f"_{c}hi")), F.col(f"_{c}hi")))
    return out.where(~(F.col("_clear") & past) & (F.col("_ax") <= F.col("_bx")) & (F.col("_ay") <= F.col("_by")))


def view_candidates(targets: DataFrame, cameras: DataFrame, cells_across: int = 4, carried: Sequence[str] = ()) -> DataFrame:
    """Pairs of targets (``x, y, z``) and cameras that may see them, by shared plan cell.

    The cell is a fraction of the mean footprint, so a camera meets only what
    lies under it; no target is compared with every camera. Exact tests follow. ``carried``
    names further columns of the cameras to keep. Runs jobs: what is known of a mesh is written
    once, so that the optimizer sees how little it is and moves the targets to the cells only.
    """
    bounds = cut_lineage(targets.groupBy(*KEY).agg(
        *[f(c).alias(f"_{c}{n}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))]
    ))
    seen = _footprints(cameras, bounds)
    width = cut_lineage(seen.groupBy(*KEY).agg(
        F.greatest(
            F.avg(F.greatest(F.col("_bx") - F.col("_ax"), F.col("_by") - F.col("_ay"))) / cells_across,
            F.max(F.greatest(F.col("_xhi") - F.col("_xlo"), F.col("_yhi") - F.col("_ylo"))) / 1024, F.lit(1e-6),
        ).alias("_cell")
    ))
    at = lambda c: F.floor(F.col(c) / F.col("_cell")).cast("long")
    marked = (
        seen.join(width, KEY)
        .withColumn("_i", F.explode(F.sequence(at("_ax"), at("_bx"))))
        .withColumn("_j", F.explode(F.sequence(at("_ay"), at("_by"))))
        .select(*KEY, "_i", "_j", "camera_id", *carried, *_flat_optics())
    )
    placed = targets.join(width, KEY).withColumn("_i", at("x")).withColumn("_j", at("y")).drop("_cell")
    return placed.join(marked, [*KEY, "_i", "_j"]).drop("_i", "_j")


def _project(pairs: DataFrame) -> DataFrame:
    """Adds distance, view cosine, camera-space depth and pixel of the target."""
    p = (F.col("x"), F.col("y"), F.col("z"))
    ray = la.sub(la.vec("_cam_c"), p)
    cam = la.add(la.mat_vec([F.col(f"_cam_R{i}") for i in range(9)], p), la.vec("_cam_t", "012"))
    out = pairs.withColumns({"distance": la.norm(ray), "_c0": cam[0], "_c1": cam[1], "_c2": cam[2]}).where(F.col("_c2") > 0.1)
    safe = F.greatest("distance", F.lit(1e-300))  # a square root is 0 or above 1e-162
    return out.withColumns({
        "cos_theta": la.dot(la.vec("n"), ray) / safe,
        "u": F.col("_cam_fx") * F.col("_c0") / F.col("_c2") + F.col("_cam_px"),
        "v_px": F.col("_cam_fy") * F.col("_c1") / F.col("_c2") + F.col("_cam_py"),
    }).drop("_c0", "_c1", "_c2")


def _inside(margin: int) -> Column:
    return (
        (F.col("u") >= margin) & (F.col("u") < F.col("_cam_w") - margin)
        & (F.col("v_px") >= margin) & (F.col("v_px") < F.col("_cam_h") - margin)
    )


def face_targets(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Face centroids with normals and corners."""
    g = face_geometry(faces, vertices)
    return g.select(*KEY, "f", *[F.col(f"c{c}").alias(c) for c in "xyz"], "nx", "ny", "nz", "area", "p0", "p1", "p2")


def least_distance(targets: DataFrame, places: DataFrame, across: int = 16, pairs_each: int = 8) -> DataFrame:
    """(mesh_id, least): the least distance between a mesh's targets and its places, both ``x, y, z``; jobs run here.

    Branch and bound over cells: targets are summed up as boxes of ``across`` cells
    along the longest side, each with one of its own points. No pair of a box and a
    place can be nearer than the box, and the nearest of the points bounds the
    answer from above, so most pairs go at once. While those left hold more than
    ``pairs_each`` comparisons per target, their boxes are cut again; then the
    targets in them are measured. A box of one position is measured by itself.
    """
    targets = targets.select(*KEY, "x", "y", "z")
    all_rows = targets.count()
    size = targets.groupBy(*KEY).agg(*[F.min(c).alias(f"_{c}0") for c in "xyz"], F.greatest(*[F.max(c) - F.min(c) for c in "xyz"], F.lit(1e-9)).alias("_side"))
    # a power of two, so that a cell is cut into cells without rounding
    size = cut_lineage(size.withColumn("_side", F.pow(F.lit(2.0), F.ceil(F.log2("_side")) + 1)))
    where = places.select(*KEY, F.col("x").alias("_px"), F.col("y").alias("_py"), F.col("z").alias("_pz")).distinct()
    where = cut_lineage(where.withColumn("_place", F.monotonically_increasing_id()))
    gap = lambda c: F.greatest(F.col(f"_lo{c}") - F.col(f"_p{c}"), F.col(f"_p{c}") - F.col(f"_hi{c}"), F.lit(0.0))
    apart = lambda a: F.sqrt(sum(((F.col(f"{a}{c}") - F.col(f"_p{c}")) * (F.col(f"{a}{c}") - F.col(f"_p{c}")) for c in "xyz"), F.lit(0.0)))
    cells, kept, best, level = across, None, None, 0
    while True:
        width = F.col("_side") / cells
        cell = [F.floor((F.col(c) - F.col(f"_{c}0")) / width).cast("long").alias(f"_{c}") for c in "xyz"]
        dealt = targets.join(size, KEY).select(*KEY, "x", "y", "z", *cell)
        if kept is None:
            live, pairs = dealt, where
        else:
            old = [F.floor(F.col(f"_{c}") / across).cast("long") for c in "xyz"]
            dealt = dealt.withColumns({f"_o{c}": o for c, o in zip("xyz", old)})
            boxes_left = kept.select(*KEY, *[F.col(f"_{c}").alias(f"_o{c}") for c in "xyz"]).distinct()
            live = dealt.join(boxes_left, [*KEY, "_ox", "_oy", "_oz"])
        boxes = live.groupBy(*KEY, *([] if kept is None else ["_ox", "_oy", "_oz"]), "_x", "_y", "_z").agg(
            *[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))], F.min(F.struct("x", "y", "z")).alias("_own"), F.count(F.lit(1)).alias("_n")
        ).withColumns({f"_own{c}": F.col(f"_own.{c}") for c in "xyz"})
        if kept is None:
            met = boxes.join(where, KEY)
        else:
            met = boxes.join(kept.select(*KEY, *[F.col(f"_{c}").alias(f"_o{c}") for c in "xyz"], "_place", "_px", "_py", "_pz"), [*KEY, "_ox", "_oy", "_oz"])
        met = met.select(*KEY, "_x", "_y", "_z", "_place", "_px", "_py", "_pz", F.sqrt(sum((gap(c) * gap(c) for c in "xyz"), F.lit(0.0))).alias("_low"), apart("_own").alias("_up"), "_n",
                         sum((F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"), F.lit(0.0)).alias("_wide"))
        met = cut_lineage(met)
        now = met.groupBy(*KEY).agg(F.min("_up").alias("_best"))
        best = now if best is None else best.unionByName(now).groupBy(*KEY).agg(F.min("_best").alias("_best"))
        best = cut_lineage(best)
        kept = cut_lineage(met.join(best, KEY).where((F.col("_low") <= F.col("_best")) & (F.col("_wide") > 0)).drop("_best", "_up", "_low", "_wide"))
        work = kept.agg(F.sum("_n")).first()[0] or 0
        level += 1
        if work <= pairs_each * all_rows or level == 8:
            break
        cells *= across
    exact = dealt.select(*KEY, "_x", "_y", "_z", "x", "y", "z").join(kept.drop("_n"), [*KEY, "_x", "_y", "_z"])
    measured = exact.select(*KEY, apart("").alias("_best")).unionByName(best)
    return measured.groupBy(*KEY).agg(F.min("_best").alias("least"))


def face_views(targets: DataFrame, cameras: DataFrame, min_cos: float = 0.15, margin: int = 8, stored: bool = False) -> DataFrame:
    """All valid (face, camera) views: ``camera_id, distance, cos_theta, score``; ``with_optics`` adds the rest to the few that are used.

    The targets are written once, unless they are ``stored`` already.
    """
    targets = targets if stored else cut_lineage(targets)
    places = cameras.select(*KEY, F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("cz").alias("z"))
    nearest = least_distance(targets, places).select(*KEY, F.greatest(F.lit(0.5), "least").alias("_dmin"))
    corners = [F.col(f"p{i}.{c}").alias(f"_p{i}{c}") for i in range(3) for c in "xyz"]
    faces = targets.select(*KEY, "f", "x", "y", "z", "nx", "ny", "nz", *corners)
    seen = _project(view_candidates(faces, cameras.join(nearest, KEY), carried=["_dmin"])).where(
        (F.col("distance") >= 1e-4) & (F.col("cos_theta") > min_cos) & _inside(margin)
    )
    depth = [_cam_depth(la.vec(f"_p{i}")) for i in range(3)]
    seen = seen.where((depth[0] > 0.05) & (depth[1] > 0.05) & (depth[2] > 0.05))
    border = F.least(F.col("u"), F.col("_cam_w") - 1 - F.col("u"), F.col("v_px"), F.col("_cam_h") - 1 - F.col("v_px"))
    score = (
        0.40 * F.col("cos_theta") + 0.25 * clip(F.col("_dmin") / F.col("distance"), 0.1, 1.0)
        + 0.20 * F.col("_cam_quality") + 0.15 * clip(border / (F.least("_cam_w", "_cam_h") / 2.0), 0, 1)
    )
    return seen.select(*KEY, "f", "camera_id", "distance", "cos_theta", score.alias("score"))


def with_optics(ranked: DataFrame, targets: DataFrame, cameras: DataFrame) -> DataFrame:
    """The views with the face's corners and the camera's optics, which are fetched for ranked views only."""
    corners = targets.select(*KEY, "f", "p0", "p1", "p2")
    optics = cameras.select(*KEY, "camera_id", F.struct(*OPTICS).alias("_cam"))
    return ranked.join(corners, [*KEY, "f"], "left").join(optics, [*KEY, "camera_id"], "left")


def best_views(views: DataFrame, faces: DataFrame, top: int = 3) -> DataFrame:
    """The best views per face, ranked; unseen faces stay with NULL camera."""
    order = Window.partitionBy(*KEY, "f").orderBy(F.desc("score"), "camera_id")
    ranked = views.withColumn("view_rank", F.row_number().over(order)).where(F.col("view_rank") <= top)
    return faces.select(*KEY, "f").join(ranked, [*KEY, "f"], "left")


def _mean_pixel(axis: int, size: str, focal: str, centre: str) -> Column:
    """Mean image position of the three corners, clamped to the image, whole pixels."""
    total = F.lit(0.0)
    for i in range(3):
        p = tuple(F.col(f"p{i}.{c}") for c in "xyz")
        cam = la.add(la.mat_vec(la.arr9(F.col("_cam.R")), p), la.arr3(F.col("_cam.t")))
        total = total + F.col(f"_cam.{focal}") * cam[axis] / cam[2] + F.col(f"_cam.{centre}")
    return F.floor(F.greatest(F.lit(0.0), F.least(total / 3.0, F.col(f"_cam.{size}") - 1.0))).cast("int")


def face_colours(ranked: DataFrame, pixels: DataFrame, image_scale: float = 1.0) -> DataFrame:
    """Blend of the top views by squared score; the 3x3 mean for a single view; slate when unseen.

    ``ranked`` has the optics (``with_optics``); ``pixels(camera_id, x, y, r, g, b)``;
    ``image_scale`` maps camera to table pixels. Runs jobs: where a face lies in its views is
    written once, and corners and optics are not carried any further.
    """
    ranked = cut_lineage(ranked.select(
        *KEY, "f", "camera_id", "score",
        F.floor(_mean_pixel(0, "w", "fx", "px") * image_scale).cast("int").alias("_u"),
        F.floor(_mean_pixel(1, "h", "fy", "py") * image_scale).cast("int").alias("_v"),
    ))
    sited = ranked.where("camera_id IS NOT NULL").withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(*KEY, "f")))
    offsets = F.when(F.col("_k") == 1, F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).otherwise(
        F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b")))
    )
    taps = sited.withColumn("_o", F.explode(offsets)).select(
        *KEY, "f", "camera_id", F.col("score"), (F.col("_u") + F.col("_o.a")).alias("x"), (F.col("_v") + F.col("_o.b")).alias("y")
    )
    weight = F.col("score") * F.col("score")
    mixed = taps.join(pixels, ["camera_id", "x", "y"]).groupBy(*KEY, "f").agg(
        *[(F.sum(weight * F.col(c)) / F.greatest(F.sum(weight), F.lit(1e-6))).alias(c) for c in "rgb"]
    )
    return ranked.select(*KEY, "f").distinct().join(mixed, [*KEY, "f"], "left").select(
        *KEY, "f", *[F.coalesce(F.floor(clip(F.col(c), 0, 255)).cast("int"), F.lit(s)).alias(c) for c, s in zip("rgb", UNOBSERVED)]
    )


def planar_uv(vertices: DataFrame, pad: float = 0.02) -> DataFrame:
    """Plan coordinates scaled to 0..1 with padding."""
    box = vertices.groupBy(*KEY).agg(*[f(c).alias(f"_{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))])
    out = vertices.join(box, KEY)
    for c, name in (("x", "tex_u"), ("y", "tex_v")):
        span = F.greatest(F.col(f"_hi{c}") - F.col(f"_lo{c}"), F.lit(1e-4))
        out = out.withColumn(name, clip((F.col(c) - F.col(f"_lo{c}") + pad * span) / (span * (1 + 2 * pad)), 0, 1))
    return out.drop("_lox", "_hix", "_loy", "_hiy")


def coverage(ranked: DataFrame) -> DataFrame:
    """Seen faces, coverage and mean viewing angle per mesh, from the best views."""
    best = ranked.where("view_rank = 1 OR camera_id IS NULL")
    seen = F.col("camera_id").isNotNull()
    sums = best.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("total_faces"), F.count_if(seen).alias("textured_faces"), F.avg("cos_theta").alias("_c")
    )
    return sums.select(
        *KEY, "total_faces", "textured_faces", (F.col("total_faces") - F.col("textured_faces")).alias("unobserved_faces"),
        rounded(F.col("textured_faces") / F.greatest("total_faces", F.lit(1)) * 100, 1).alias("coverage_pct"),
        F.when(F.col("_c").isNotNull(), rounded(F.degrees(F.acos(clip(F.col("_c"), 0, 1))), 1)).otherwise(0.0).alias("mean_angle_deg"),
    )


def camera_contribution(ranked: DataFrame, cameras: DataFrame) -> DataFrame:
    """Faces won by each camera and its share; cameras that won none stay."""
    won = ranked.where("view_rank = 1").groupBy(*KEY, "camera_id").agg(F.count(F.lit(1)).alias("_n"))
    totals = won.groupBy(*KEY).agg(F.sum("_n").alias("_all"))
    n = F.coalesce("_n", F.lit(0))
    return cameras.select(*KEY, "camera_id").join(won, [*KEY, "camera_id"], "left").join(totals, KEY, "left").select(
        *KEY, "camera_id", n.alias("faces_observed"),
        rounded(n / F.greatest(F.coalesce("_all", F.lit(0)), F.lit(1)) * 100, 1).alias("contribution_pct"),
    )


def texture_report(cover: DataFrame, areas: DataFrame, resolution: int = 2048) -> DataFrame:
    """Textured and unobserved area and texel density; ``areas(mesh_id, surface_area_m2)``."""
    unseen = F.round(F.col("surface_area_m2") * F.col("unobserved_faces") / F.greatest("total_faces", F.lit(1)), 2)
    return cover.join(areas.select(*KEY, "surface_area_m2"), KEY).select(
        *KEY, "coverage_pct", "total_faces", "textured_faces", "unobserved_faces", rounded(F.col("surface_area_m2"), 2).alias("total_area_m2"),
        rounded(F.col("surface_area_m2") - unseen, 2).alias("textured_area_m2"), unseen.alias("unobserved_area_m2"),
        "mean_angle_deg", rounded(F.lit(float(resolution * resolution)) / F.greatest(F.lit(1.0), F.col("surface_area_m2")), 1).alias("texels_per_m2"),
    )
