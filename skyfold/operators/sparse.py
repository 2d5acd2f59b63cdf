"""Sparse geometry: pair plans, descriptor matches, epipolar checks, triangulation, tracks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyfold.functions import linalg as la
from skyfold.functions.linalg import clip, rounded
from skyfold.operators.components import connected_components
from skyfold.session import cut_lineage, spread

# Look-ahead steps, loop-closure stride, return links.
STEPS, LOOP_STRIDE, RETURN_LINKS = (1, 2, 3, 5), 10, (1, 2, 3)


def match_pairs(cameras: DataFrame) -> DataFrame:
    """Index pairs to match per mission from ``mission_id, idx``: near steps, loop
    closures to the first frame and links of the last frame. No self-join is needed."""
    sizes = cameras.groupBy("mission_id").agg((F.max("idx") + 1).alias("_n"))
    i, n = F.col("idx"), F.col("_n")
    pair = lambda a, b, ok: F.when(ok, F.struct(a.cast("long").alias("frame_i"), b.cast("long").alias("frame_j")))
    options = [pair(i, i + s, i + s < n) for s in STEPS]
    options.append(pair(F.lit(0), i, (n > 10) & (i >= LOOP_STRIDE) & (i % LOOP_STRIDE == 0)))
    options += [pair(n - 1 - k, n - 1, (n > 5) & (i == n - 1)) for k in RETURN_LINKS]
    return (
        cameras.select("mission_id", "idx").join(sizes, "mission_id")
        .select("mission_id", F.explode(F.array_distinct(F.array(*options))).alias("p"))
        .where("p IS NOT NULL").select("mission_id", "p.*").distinct()
    )


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def descriptor_matches(
    pairs: DataFrame, descriptors: DataFrame, ratio: float = 0.75, keys: Sequence[str] = ("mission_id",),
    min_descriptors: int = 1, chunk: int = 4096, block: int = 512,
) -> DataFrame:
    """Nearest descriptor of frame j for each descriptor of frame i that passes the ratio test.

    Both frames are dealt into chunks; one task compares two chunks by matrix
    products, ``block`` queries at a time, and only the two nearest per query leave it.
    """
    keys = list(keys)
    sizes = descriptors.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_n"))
    side = lambda s: sizes.select(*keys, F.col("frame").alias(f"frame_{s}"), F.col("_n").alias(f"_n{s}"))
    plan = (
        pairs.join(side("i"), [*keys, "frame_i"]).join(side("j"), [*keys, "frame_j"])
        .where((F.col("_ni") >= min_descriptors) & (F.col("_nj") >= min_descriptors))
        .withColumn("_si", F.ceil(F.col("_ni") / chunk).cast("int")).withColumn("_sj", F.ceil(F.col("_nj") / chunk).cast("int"))
        .drop("_ni", "_nj")
    )
    group = [*keys, "frame_i", "frame_j", "_qs", "_cs"]

    def deal(own: str, other: str, mine: str, theirs: str) -> DataFrame:
        rows = descriptors.select(*keys, F.col("frame").alias(f"frame_{own}"), F.col("kp").cast("long").alias("kp"), "vec")
        dealt = plan.join(rows, [*keys, f"frame_{own}"]).withColumn(
            mine, F.pmod(F.xxhash64("kp"), F.col(f"_s{own}")).cast("int")
        ).withColumn(theirs, F.explode(F.sequence(F.lit(0), F.col(f"_s{other}") - 1)))
        out = dealt.select(*group, "kp", "vec")
        return spread(out.toDF(*out.columns), *group)

    def nearest_two(asking: pa.Table, giving: pa.Table) -> pa.Table:
        giving = giving.sort_by("kp")
        ids = giving.column("kp").to_numpy()
        q, c = _vectors(asking.column("vec")), _vectors(giving.column("vec"))
        first, d1, second = np.empty(len(q), np.int64), np.empty(len(q)), np.empty(len(q))
        for at in range(0, len(q), block):
            b = q[at:at + block]
            d2 = np.maximum((b * b).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (b @ c.T), 0.0)
            near, rows = d2.argmin(axis=1), np.arange(len(b))
            first[at:at + block], d1[at:at + block] = near, d2[rows, near]
            d2[rows, near] = np.inf
            second[at:at + block] = d2.min(axis=1)
        return asking.select([*group[:-2], "kp"]).append_column("match_kp", pa.array(ids[first])).append_column(
            "d1", pa.array(d1)).append_column("d2", pa.array(second))

    types = {f.name: f.dataType.simpleString() for f in plan.schema.fields}
    ddl = ", ".join(f"{k} {types[k]}" for k in group[:-2]) + ", kp bigint, match_kp bigint, d1 double, d2 double"
    parts = deal("i", "j", "_qs", "_cs").groupBy(*group).cogroup(deal("j", "i", "_cs", "_qs").groupBy(*group)).applyInArrow(nearest_two, ddl)
    near = F.slice(F.array_sort(F.flatten(F.collect_list(F.array(
        F.struct(F.col("d1").alias("d"), F.col("match_kp").alias("id")),
        F.struct(F.col("d2").alias("d"), F.lit(None).cast("long").alias("id")),
    )))), 1, 2)
    best = parts.groupBy(*group[:-2], "kp").agg(near.alias("_b"))
    return best.select(
        *group[:-2], "kp", F.col("_b")[0]["id"].alias("match_kp"),
        F.sqrt(F.col("_b")[0]["d"]).alias("d1"), F.sqrt(F.col("_b")[1]["d"]).alias("d2"),
    ).where((F.col("d1") < ratio * F.col("d2")) & ~F.isnan("d2") & (F.col("d2") < float("inf")))


def supported_pairs(matches: DataFrame, minimum: int = 15, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Matches of pairs with at least ``minimum`` of them."""
    counts = matches.groupBy(*keys, "frame_i", "frame_j").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= minimum)
    return matches.join(counts.drop("_n"), [*keys, "frame_i", "frame_j"], "left_semi")


def _with_poses(matches: DataFrame, cameras: DataFrame, keys: Sequence[str]) -> DataFrame:
    optics = ["fx", "fy", "px", "py"]
    side = lambda s: cameras.select(
        *keys, F.col("camera_id").alias(f"frame_{s}"), F.col("R").alias(f"R{s}"), F.col("t").alias(f"t{s}"),
        *([*optics] if s == "i" else []),
    )
    return matches.join(side("i"), [*keys, "frame_i"]).join(side("j"), [*keys, "frame_j"])


def epipolar_distance(matches: DataFrame, cameras: DataFrame, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Distance in pixels of the second point to the epipolar line of the first.

    The relative pose gives E = [t]x R; both frames share the intrinsics, so
    the line is taken in the normalised plane and scaled by the focal lengths.
    """
    j = _with_poses(matches, cameras, keys)
    ri, rj = la.arr9("Ri"), la.arr9("Rj")
    rel = la.mat_mul(rj, la.transpose(ri))
    shift = la.sub(la.arr3("tj"), la.mat_vec(rel, la.arr3("ti")))
    j = j.withColumns({f"_E{i}": e for i, e in enumerate([*rel, *shift])})
    essential = la.mat_mul(la.skew(tuple(F.col(f"_E{i}") for i in range(9, 12))), [F.col(f"_E{i}") for i in range(9)])
    p1 = ((F.col("u1") - F.col("px")) / F.col("fx"), (F.col("v1") - F.col("py")) / F.col("fy"), F.lit(1.0))
    p2 = ((F.col("u2") - F.col("px")) / F.col("fx"), (F.col("v2") - F.col("py")) / F.col("fy"), F.lit(1.0))
    j = j.withColumns({f"_l{i}": v for i, v in enumerate(la.mat_vec(essential, p1))})
    line = tuple(F.col(f"_l{i}") for i in range(3))
    size = F.hypot(line[0] / F.col("fx"), line[1] / F.col("fy"))
    return j.withColumn("epipolar_px", F.when(size > 1e-6, F.abs(la.dot(p2, line)) / size)).select(
        *matches.columns, "epipolar_px"
    )


def epipolar_inliers(matches: DataFrame, cameras: DataFrame, threshold: float = 3.0, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    return epipolar_distance(matches, cameras, keys).where(F.col("epipolar_px") <= 2.0 * threshold)


def pair_report(raw: DataFrame, inliers: DataFrame, minimum: int = 15, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    pair = [*keys, "frame_i", "frame_j"]
    a = raw.groupBy(*pair).agg(F.count(F.lit(1)).alias("raw_matches"))
    b = inliers.groupBy(*pair).agg(F.count(F.lit(1)).alias("verified_inliers")).where(F.col("verified_inliers") >= minimum)
    return a.join(b, pair).withColumn("inlier_ratio", rounded(F.col("verified_inliers") / F.col("raw_matches"), 3))


def triangulate(matches: DataFrame, cameras: DataFrame, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Adds the linear two-view point ``x, y, z``; NULL when it lies at infinity."""
    j = _with_poses(matches, cameras, keys)
    needed = [*matches.columns, "Ri", "ti", "Rj", "tj", "fx", "fy", "px", "py"]
    j = j.select(*needed)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in j.schema.fields)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            num = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            k = np.zeros((n, 3, 3))
            k[:, 0, 0], k[:, 1, 1], k[:, 0, 2], k[:, 1, 2], k[:, 2, 2] = num("fx"), num("fy"), num("px"), num("py"), 1.0
            rows = []
            for s, u, v in (("i", "u1", "v1"), ("j", "u2", "v2")):
                r = batch.column(f"R{s}").flatten().to_numpy(zero_copy_only=False).reshape(n, 3, 3)
                t = batch.column(f"t{s}").flatten().to_numpy(zero_copy_only=False).reshape(n, 3, 1)
                p = k @ np.concatenate([r, t], axis=2)
                rows += [num(u)[:, None] * p[:, 2] - p[:, 0], num(v)[:, None] * p[:, 2] - p[:, 1]]
            h = np.linalg.svd(np.stack(rows, axis=1))[2][:, 3, :] if n else np.zeros((0, 4))
            far = np.abs(h[:, 3]) < 1e-7
            w = np.where(far, 1.0, h[:, 3])
            arrays = [batch.column(c) for c in needed]
            arrays += [pa.array(h[:, i] / w, mask=far) for i in range(3)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*needed, "x", "y", "z"])

    return j.mapInArrow(solve, f"{schema}, x double, y double, z double")


def verified_points(triangulated: DataFrame, min_angle: float = 2.0, max_error: float = 3.0) -> DataFrame:
    """Points in front of both cameras (after one sign flip if that helps) with
    enough parallax and a small mean reprojection error; adds ``angle_deg`` and ``error_px``."""
    rows = triangulated.where("x IS NOT NULL")
    dropped = {"Ri", "ti", "Rj", "tj", "fx", "fy", "px", "py"}
    kept = [f for f in rows.schema.fields if f.name not in dropped]
    names = [*[f.name for f in kept], "angle_deg", "error_px"]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "angle_deg double", "error_px double"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            num = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            turn = {s: batch.column(f"R{s}").flatten().to_numpy(zero_copy_only=False).reshape(n, 3, 3) for s in "ij"}
            shift = {s: batch.column(f"t{s}").flatten().to_numpy(zero_copy_only=False).reshape(n, 3) for s in "ij"}
            p = np.stack([num(c) for c in "xyz"], axis=1)
            ahead = lambda sign: np.logical_and(*[np.einsum("nj,nj->n", turn[s][:, 2], sign * p) + shift[s][:, 2] > 0 for s in "ij"])
            front, behind = ahead(1.0), ahead(-1.0)
            p = np.where(front[:, None], p, -p)
            ray = {s: p + np.einsum("nji,nj->ni", turn[s], shift[s]) for s in "ij"}
            cam = {s: np.einsum("nij,nj->ni", turn[s], p) + shift[s] for s in "ij"}
            length = np.linalg.norm(ray["i"], axis=1) * np.linalg.norm(ray["j"], axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cos = np.clip(np.einsum("ni,ni->n", ray["i"], ray["j"]) / length, -1.0, 1.0)
                angle = np.where(length > 1e-16, np.degrees(np.arccos(cos)), 0.0)
                off = [np.hypot(num("fx") * cam[s][:, 0] / cam[s][:, 2] + num("px") - num(u), num("fy") * cam[s][:, 1] / cam[s][:, 2] + num("py") - num(v))
                       for s, u, v in (("i", "u1", "v1"), ("j", "u2", "v2"))]
            error = (off[0] + off[1]) / 2.0
            good = (front | behind) & (angle >= min_angle) & (error <= max_error)
            point = {c: pa.array(p[:, k]) for k, c in enumerate("xyz")}
            arrays = [point.get(f.name, batch.column(f.name)) for f in kept] + [pa.array(angle), pa.array(error)]
            yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(good))

    return rows.mapInArrow(check, schema)


def point_colours(points: DataFrame, pixels: DataFrame, width: int, height: int, u: str = "u1", v: str = "v1", frame: str = "frame_i") -> DataFrame:
    """Colour of each point at its rounded, clamped pixel."""
    at = lambda c, m: F.greatest(F.lit(0), F.least(F.lit(m - 1), F.bround(c, 0).cast("int")))
    colours = pixels.select(F.col("frame_id").alias(frame), F.col("x").alias("_px"), F.col("y").alias("_py"), "r", "g", "b")
    return (
        points.withColumn("_px", at(F.col(u), width)).withColumn("_py", at(F.col(v), height))
        .join(colours, [frame, "_px", "_py"], "left").drop("_px", "_py")
    )


def reconstruction_metrics(missions: DataFrame, points: DataFrame, max_error: float = 3.0, minimum: int = 6, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Counts, mean error, box and confidence; too few points give status and NULL values."""
    keys = list(keys)
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("error_px").alias("_e"),
        *[f(c).alias(f"_{n}{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))],
    )
    n = F.coalesce("_n", F.lit(0))
    ok = n >= minimum
    trust = clip(0.50 + 0.30 * F.least(F.lit(1.0), n / 300.0) + 0.20 * F.greatest(F.lit(0.0), 1.0 - F.col("_e") / max_error), 0.10, 0.99)
    boxes = [F.when(ok, rounded(F.col(f"_{m}{c}"), 2)).alias(f"{m}_{c}") for c in "xyz" for m in ("min", "max")]
    spans = [F.when(ok, rounded(F.col(f"_max{c}") - F.col(f"_min{c}"), 2)).alias(f"span_{c}") for c in "xyz"]
    return missions.select(*keys).join(sums, keys, "left").select(
        *keys, n.alias("points"), F.when(ok, "ok").otherwise("failed").alias("status"),
        F.when(ok, rounded(F.col("_e"), 3)).alias("mean_error_px"), *boxes, *spans,
        F.when(ok, rounded(trust, 2)).alias("confidence"),
    )


def feature_tracks(matches: DataFrame, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Tracks as connected components of matched features: ``kp`` ids are unique per group. Runs jobs; matches are found once."""
    keys = list(keys)
    matches = cut_lineage(matches.select(*keys, "frame_i", "frame_j", "kp", "match_kp"))
    ends = matches.select(*keys, F.explode(F.array(
        F.struct(F.col("frame_i").alias("frame"), F.col("kp").alias("kp")),
        F.struct(F.col("frame_j").alias("frame"), F.col("match_kp").alias("kp")),
    )).alias("e")).select(*keys, "e.*").distinct()
    return connected_components(ends, matches, keys, "kp", "kp", "match_kp", "track_id")


def track_statistics(tracks: DataFrame, keys: Sequence[str] = ("mission_id",)) -> DataFrame:
    """Length of tracks in distinct frames, with the 2 / 3 / 4+ histogram."""
    lengths = tracks.select(*keys, "track_id", "frame").distinct().groupBy(*keys, "track_id").agg(F.count(F.lit(1)).alias("_len"))
    n = F.col("_len")
    return lengths.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("tracks"), F.min(n).alias("min_track_length"), F.max(n).alias("max_track_length"),
        rounded(F.avg(n), 2).alias("mean_track_length"), F.count_if(n == 2).alias("views_2"),
        F.count_if(n == 3).alias("views_3"), F.count_if(n >= 4).alias("views_4_or_more"),
    )
