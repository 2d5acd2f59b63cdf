"""Camera trajectories: intrinsics, telemetry matching, pose chains, fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from skyfold.functions import geodesy as geo, linalg as la
from skyfold.functions.linalg import clip, rounded
from skyfold.operators.asof import nearest_in_time
from skyfold.operators.ordered import with_neighbour
from skyfold.operators.scans import chunked_scan

CHUNK_ROWS = 20_000


def intrinsics(missions: DataFrame, width: str = "video_w", height: str = "video_h") -> DataFrame:
    """fx, fy, cx, cy in pixels from focal length and sensor width."""
    focal = F.col("focal_length_mm") * F.col(width) / F.col("sensor_width_mm")
    return missions.withColumns({"fx": focal, "fy": focal, "cx": F.col(width) / 2.0, "cy": F.col(height) / 2.0})


def match_telemetry(keyframes: DataFrame, telemetry: DataFrame, tolerance: float = 1.5) -> DataFrame:
    """Each keyframe with the nearest fix of its mission within the tolerance, else NULL."""
    return nearest_in_time(
        keyframes, telemetry, ["mission_id"], "t", "t", "fix_id", ["lat", "lon", "alt", "fix_type"], tolerance, "fix"
    )


def choose_source(matched: DataFrame) -> DataFrame:
    """Embedded positions win when at least half the keyframes of a mission have one;
    otherwise the matched file fix; otherwise NULL.

    Needs ``gps_lat, gps_lon, gps_alt, gps_fix_type`` next to the matched ``fix``.
    """
    tagged = F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()
    votes = matched.groupBy("mission_id").agg(F.count_if(tagged).alias("_tagged"), F.count(F.lit(1)).alias("_all"))
    embedded = (F.col("_tagged") > 0) & (F.col("_tagged") >= F.floor(F.col("_all") / 2))
    own = F.when(tagged, F.struct(
        F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"), F.coalesce("gps_alt", F.lit(0.0)).alias("alt"),
        F.upper(F.coalesce("gps_fix_type", F.lit("STANDALONE_GPS"))).alias("fix_type"),
    ))
    other = F.when(F.col("fix").isNotNull(), F.struct(*[F.col(f"fix.{c}").alias(c) for c in ("lat", "lon", "alt", "fix_type")]))
    return (
        matched.join(votes, "mission_id")
        .withColumn("position", F.when(embedded, own).otherwise(other))
        .withColumn("telemetry_source", F.when(embedded, "KEYFRAME_MANIFEST").when(F.col("fix").isNotNull(), "FILE").otherwise("NONE"))
        .drop("_tagged", "_all")
    )


def telemetry_diagnostics(matched: DataFrame, position: str = "fix", time: str = "t") -> DataFrame:
    """Availability, matches and the latest fix type per mission."""
    has = F.col(position).isNotNull()
    return matched.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("keyframes"), F.bool_or(has).alias("gps_available"),
        F.count_if(has).alias("matched_count"),
        F.coalesce(F.max_by(F.when(has, F.col(position)["fix_type"]), F.when(has, F.col(time))), F.lit("NONE")).alias("rtk_fix_type"),
    )


def fix_sigma(fix_type: Column) -> Column:
    name = F.upper(F.coalesce(fix_type, F.lit("")))
    return F.when(name.contains("FIX"), 0.02).when(name.contains("FLOAT") | name.contains("DGPS"), 0.20).otherwise(2.5)


def nominal_step(altitude: Column) -> Column:
    return F.greatest(F.lit(0.5), altitude * 0.08)


def prefix_motions(rots: np.ndarray, shifts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Products of the first, the first two, ... rigid motions (R, t), later ones applied after earlier ones."""
    r, t, step = rots.copy(), shifts.copy(), 1
    while step < len(r):
        late, early = r[step:], slice(0, len(r) - step)
        t[step:] = np.einsum("nij,nj->ni", late, t[early]) + t[step:]
        r[step:] = late @ r[early]
        step *= 2
    return r, t


def _motions(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rots = np.array(pdf["rel_R"].tolist(), float).reshape(-1, 3, 3)
    shifts = np.array(pdf["rel_t"].tolist(), float).reshape(-1, 3) * pdf["step_m"].to_numpy(float)[:, None]
    if pdf["is_start"].iloc[0]:
        rots[0], shifts[0] = np.eye(3), 0.0
    return prefix_motions(rots, shifts)


def join_motions(a: list[float], b: list[float]) -> list[float]:
    ra, rb = np.array(a[:9]).reshape(3, 3), np.array(b[:9]).reshape(3, 3)
    return [*(rb @ ra).ravel(), *(rb @ np.array(a[9:]) + np.array(b[9:]))]


def chain_poses(relative: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """World poses from relative ones, in index order per mission; jobs run here.

    Input ``mission_id, camera_index, rel_R[9], rel_t[3], step_m``; the relative
    pose of the first camera is ignored. Output R, t and the centre -R't. Rigid
    motions are a group, so a chunk's product is all that later chunks need.
    """

    def summarise(pdf: pd.DataFrame, before) -> list[float]:
        r, t = _motions(pdf)
        return [*r[-1].ravel(), *t[-1]]

    def emit(pdf: pd.DataFrame, before) -> pd.DataFrame:
        r, t = _motions(pdf)
        if before is not None:
            t = np.einsum("nij,j->ni", r, np.array(before[9:])) + t
            r = r @ np.array(before[:9]).reshape(3, 3)
        centres = -np.einsum("nji,nj->ni", r, t)
        return pdf[["mission_id", "camera_index"]].assign(R=list(r.reshape(-1, 9)), t=list(t), c=list(centres))

    return chunked_scan(
        relative.select("mission_id", "camera_index", "rel_R", "rel_t", "step_m"),
        ["mission_id"], ["camera_index"], F.floor(F.col("camera_index") / chunk_rows), summarise, join_motions, emit,
        "mission_id bigint, camera_index bigint, R array<double>, t array<double>, c array<double>",
    )


MOMENTS = [f"c{i}{j}" for i in range(3) for j in range(3)]


def alignment_moments(pairs: DataFrame, keys: list[str], src: str = "src", dst: str = "dst") -> DataFrame:
    """Means, cross-covariance and source variance of paired 3-vectors, as partial sums.

    Coordinates are first shifted by one pair of the group to keep the sums small.
    """
    anchor = pairs.groupBy(*keys).agg(F.min_by(F.struct(src, dst), F.struct(src, dst)).alias("_o"))
    s, d = la.arr3(src), la.arr3(dst)
    shifted = pairs.join(anchor, keys).select(
        *keys,
        *[(s[i] - F.col("_o")[src][i]).alias(f"s{i}") for i in range(3)],
        *[(d[i] - F.col("_o")[dst][i]).alias(f"d{i}") for i in range(3)],
        "_o",
    )
    sums = shifted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("_o").alias("_o"),
        *[F.avg(f"{p}{i}").alias(f"m{p}{i}") for p in "sd" for i in range(3)],
        *[F.covar_pop(f"d{i}", f"s{j}").alias(f"c{i}{j}") for i in range(3) for j in range(3)],
        sum((F.var_pop(f"s{i}") for i in range(3)), F.lit(0.0)).alias("var_src"),
    )
    return sums.withColumns(
        {f"m{p}{i}": F.col(f"m{p}{i}") + F.col("_o")[c][i] for p, c in (("s", src), ("d", dst)) for i in range(3)}
    ).drop("_o")


def solve_similarity(moments: DataFrame, keys: list[str], fixed_scale: str | None = None, scale_floor: float | None = 0.01) -> DataFrame:
    """Scale, rotation (row-major) and shift of the least-squares similarity per group.

    Fewer than three pairs give the identity rotation. ``fixed_scale`` names a
    scale column. One small row per group is solved in batches.
    """
    names = [f"m{p}{i}" for p in "sd" for i in range(3)] + MOMENTS + ["var_src"]
    columns = [*keys, "n", *names, *([fixed_scale] if fixed_scale else [])]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            size = len(pdf)
            ms, md = (pdf[[f"m{p}{i}" for i in range(3)]].to_numpy(float) for p in "sd")
            cov = pdf[MOMENTS].to_numpy(float).reshape(size, 3, 3)
            var = pdf["var_src"].to_numpy(float)
            n = pdf["n"].to_numpy()
            u, d, vt = np.linalg.svd(cov)
            flip = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            u[:, :, 2] *= flip[:, None]
            rot = u @ vt
            trace = d[:, 0] + d[:, 1] + flip * d[:, 2]
            free = trace / np.maximum(var, 1e-8)
            free = np.maximum(scale_floor, free) if scale_floor else np.where(free > 0, free, 1.0)
            given = pdf[fixed_scale].to_numpy(float) if fixed_scale else np.full(size, np.nan)
            few, still = n < 3, (var < 1e-7) & (scale_floor is not None)
            rot[few | still] = np.eye(3)
            scale = np.where(np.isnan(given), np.where(few | still, 1.0, free), given)
            shift = md - scale[:, None] * np.einsum("nij,nj->ni", rot, ms)
            if scale_floor is not None and not fixed_scale:
                shift[few] = 0.0
            yield pdf[[*keys, "n"]].assign(scale=scale, R=list(rot.reshape(size, 9)), t=list(shift))

    types = {f.name: f.dataType.simpleString() for f in moments.schema.fields}
    ddl = ", ".join(f"{k} {types[k]}" for k in [*keys, "n"])
    return moments.select(*columns).mapInPandas(solve, f"{ddl}, scale double, R array<double>, t array<double>")


def similarity_alignment(pairs: DataFrame, keys: list[str]) -> DataFrame:
    return solve_similarity(alignment_moments(pairs, keys), keys)


def apply_similarity(rows: DataFrame, transform: DataFrame, keys: list[str], point: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Moves points by the similarity of their group; groups without one get NULL."""
    tf = transform.select(*keys, F.col("scale").alias("_s"), F.col("R").alias("_R"), F.col("t").alias("_t"))
    moved = la.mat_vec(la.arr9("_R"), tuple(F.col(c) for c in point))
    out = rows.join(tf, keys, "left")
    out = out.withColumns({f"_{c}": F.col("_s") * moved[i] + F.col("_t")[i] for i, c in enumerate(point)})
    return out.withColumns({c: F.col(f"_{c}") for c in point}).drop(*[f"_{c}" for c in point], "_s", "_R", "_t")


# Fixed values of the filter: noise densities, warm-up and steady gates.
POS_NOISE, VEL_NOISE, VISUAL_NOISE = 0.1, 0.5, 0.25
GATE_WARM, GATE_STEADY, WARM_STEPS = 60.0, 16.27, 2


# The model treats the three axes alike, so one covariance (of position, of position with velocity, of velocity)
# holds for each axis; a state is three positions, three velocities and these three numbers.


def _predict(x: list[float], p: tuple, dt: float) -> tuple[list[float], tuple]:
    a, b, c = p
    moved = [x[0] + dt * x[3], x[1] + dt * x[4], x[2] + dt * x[5], x[3], x[4], x[5]]
    return moved, (a + dt * (b + b) + dt * dt * c + POS_NOISE**2 * dt, b + dt * c, c + VEL_NOISE**2 * dt)


def _update(x: list[float], p: tuple, z, var: float) -> tuple[list[float], tuple, float]:
    a, b, c = p
    total = a + var
    gain, drift = a / total, b / total
    gap = [z[i] - x[i] for i in range(3)]
    near = [x[i] + gain * gap[i] for i in range(3)] + [x[i + 3] + drift * gap[i] for i in range(3)]
    return near, (a - gain * a, b - gain * b, c - drift * b), sum(g * g for g in gap) / total


def _visual_var(inliers: float) -> float:
    return (VISUAL_NOISE * (1.0 + 30.0 / max(1, inliers))) ** 2


def first_state(visual, gps, velocity) -> tuple[list[float], tuple]:
    return [float(v) for v in (visual if gps is None else gps)] + [float(v) for v in velocity], (10.0, 0.0, 50.0)


def filter_step(state: dict | None, t: float, visual, gps, sigma: float, inliers: float, first_velocity, dt: float | None = None) -> tuple[dict, dict]:
    """One predict and update of the position/velocity filter.

    Returns the new state and the record of this station. A position fix that
    is too far from the prediction is rejected and counted. ``dt`` is the time
    since the last station, if it is known already.
    """
    if state is None:
        x, p = first_state(visual, gps, first_velocity)
        return {"k": 0, "t": t, "x": x, "P": p}, {"x": x, "P": p, "xp": x, "Pp": p, "rejected": False}
    k = state["k"] + 1
    xp, pp = _predict(state["x"], state["P"], max(0.01, t - state["t"]) if dt is None else dt)
    x, p, _ = _update(xp, pp, visual, _visual_var(inliers))
    rejected = False
    if gps is not None:
        gx, gp, far = _update(x, p, gps, sigma * sigma)
        rejected = not far <= (GATE_WARM if k <= WARM_STEPS else GATE_STEADY)
        if not rejected:
            x, p = gx, gp
    return {"k": k, "t": t, "x": x, "P": p}, {"x": x, "P": p, "xp": xp, "Pp": pp, "rejected": rejected}


def _vector(value):
    return None if value is None or (isinstance(value, float) and np.isnan(value)) else value


class _Element:
    """What a run of stations makes of an unknown entering state (x, P).

    Given that state, the state after the run has mean A x + b and covariance C per
    axis; eta and J are what its measurements tell about x. Appending a station
    costs no more than a filter step.
    """

    def __init__(self):
        self.a = [1.0, 0.0, 0.0, 1.0]
        self.b, self.c = [0.0] * 6, (0.0, 0.0, 0.0)
        self.eta, self.j = [0.0] * 6, [0.0] * 3

    def predict(self, dt: float) -> None:
        a = self.a
        self.a = [a[0] + dt * a[2], a[1] + dt * a[3], a[2], a[3]]
        self.b, self.c = _predict(self.b, self.c, dt)

    def update(self, z, var: float) -> None:
        a, total = self.a, self.c[0] + var
        gap = [(z[i] - self.b[i]) / total for i in range(3)]
        for i in range(3):
            self.eta[i] += a[0] * gap[i]
            self.eta[i + 3] += a[1] * gap[i]
        self.j = [self.j[0] + a[0] * a[0] / total, self.j[1] + a[0] * a[1] / total, self.j[2] + a[1] * a[1] / total]
        gain, drift = self.c[0] / total, self.c[1] / total
        self.a = [a[0] - gain * a[0], a[1] - gain * a[1], a[2] - drift * a[0], a[3] - drift * a[1]]
        self.b, self.c, _ = _update(self.b, self.c, z, var)

    def packed(self) -> list[float]:
        return [*self.a, *self.b, *self.c, *self.eta, *self.j]


def _symmetric(v) -> np.ndarray:
    return np.array([[v[0], v[1]], [v[1], v[2]]])


def _parts(e: list[float]) -> tuple:
    return np.array(e[:4]).reshape(2, 2), np.array(e[4:10]).reshape(2, 3), _symmetric(e[10:13]), np.array(e[13:19]).reshape(2, 3), _symmetric(e[19:22])


def join_filters(first: list[float], second: list[float]) -> list[float]:
    """The element of two runs of stations, one after the other."""
    a1, b1, c1, eta1, j1 = _parts(first)
    a2, b2, c2, eta2, j2 = _parts(second)
    back = a2 @ np.linalg.inv(np.eye(2) + c1 @ j2)
    ahead = a1.T @ np.linalg.inv(np.eye(2) + j2 @ c1)
    c = back @ c1 @ a2.T + c2
    j = ahead @ j2 @ a1 + j1
    b, eta = back @ (b1 + c1 @ eta2) + b2, ahead @ (eta2 - j2 @ b1) + eta1
    return [*(back @ a1).ravel(), *b.ravel(), c[0, 0], (c[0, 1] + c[1, 0]) / 2, c[1, 1], *eta.ravel(), j[0, 0], (j[0, 1] + j[1, 0]) / 2, j[1, 1]]


def _entered(before: list[float] | None) -> tuple[list[float], tuple] | None:
    return None if before is None else (list(before[4:10]), tuple(before[10:13]))


def _stations(pdf: pd.DataFrame):
    cells = zip(pdf["idx"].tolist(), pdf["t"].tolist(), pdf["dt"].tolist(), pdf["visual"], pdf["gps"], pdf["sigma"].tolist(), pdf["inliers"].tolist(), pdf["velocity"], strict=True)
    for idx, t, dt, visual, gps, sigma, inliers, velocity in cells:
        gps = _vector(gps)
        yield idx, t, dt, [float(v) for v in visual], None if gps is None else [float(v) for v in gps], sigma, inliers, _vector(velocity)


def _run_filter(pdf: pd.DataFrame, before: list[float] | None, record) -> None:
    """Filter steps from what enters; a later chunk that does not know it yet starts at its first visual position."""
    entered = _entered(before)
    state = None
    for idx, t, dt, visual, gps, sigma, inliers, velocity in _stations(pdf):
        if state is None and not pdf["is_start"].iloc[0]:
            x, p = entered or first_state(visual, None, [0.0] * 3)
            state = {"k": idx - 1, "x": x, "P": p}
        state, made = filter_step(state, t, visual, gps, sigma, inliers, velocity if velocity is not None else [0.0] * 3, dt)
        record(dt, visual, gps, sigma, inliers, made)


def filter_element(pdf: pd.DataFrame, before: list[float] | None) -> list[float]:
    """The element of a chunk's stations, with fixes refused as a run from ``before`` refuses them."""
    if pdf["is_start"].iloc[0]:
        last = {}
        _run_filter(pdf, None, lambda *made: last.update(made[-1]))
        return [0.0] * 4 + [*last["x"], *last["P"]] + [0.0] * 9
    element = _Element()

    def append(dt, visual, gps, sigma, inliers, made) -> None:
        element.predict(dt)
        element.update(visual, _visual_var(inliers))
        if gps is not None and not made["rejected"]:
            element.update(gps, sigma * sigma)

    _run_filter(pdf, before, append)
    return element.packed()


def filter_rows(pdf: pd.DataFrame, before: list[float] | None) -> pd.DataFrame:
    out = {n: [] for n in ("x", "P", "xp", "Pp", "rejected")}

    def append(dt, visual, gps, sigma, inliers, made) -> None:
        for n in out:
            out[n].append(made[n] if n == "rejected" else list(made[n]))

    _run_filter(pdf, before, append)
    return pdf[["mission_id", "idx", "t", "inliers"]].assign(has_gps=[_vector(g) is not None for g in pdf["gps"]], **out)


def same_state(old: list[float] | None, new: list[float]) -> bool:
    """Whether two entering states differ by rounding only."""
    return old is not None and bool(np.allclose(old[4:13], new[4:13], rtol=1e-12, atol=1e-11))


def forward_filter(stations: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Forward filter over ``mission_id, idx (0, 1, 2, ...), t, visual[3], gps[3] or NULL, fix_type, inliers``; jobs run here.

    Chunks become filter elements, composed along the mission. Which fixes a chunk
    refuses is guessed by a run from its own first station, checked by a run from
    the composed state, and composed again where the guess was wrong. Output: x (3
    positions, 3 velocities) and P (variance of a position, covariance with its
    velocity, variance of a velocity; the same on each axis), both also as predicted
    (xp, Pp); equal to the sequential run up to rounding.
    """
    chunk = F.floor(F.col("idx") / chunk_rows)
    second = stations.where("idx = 1").select("mission_id", F.col("t").alias("_t1"), F.col("visual").alias("_v1"))
    gap = F.greatest(F.lit(0.01), F.col("_t1") - F.col("t"))
    velocity = F.when(
        F.col("_t1").isNotNull(), F.array(*[(F.col("_v1")[i] - F.col("visual")[i]) / gap for i in range(3)])
    ).otherwise(F.array(*[F.lit(0.0)] * 3))
    rows = with_neighbour(stations, ["mission_id"], ["idx"], chunk, ["t"], "_prev").join(second, "mission_id", "left").select(
        "mission_id", "idx", "t", "visual", "gps", "inliers",
        F.coalesce(F.greatest(F.lit(0.01), F.col("t") - F.col("_prev.t")), F.lit(0.01)).alias("dt"),
        fix_sigma(F.col("fix_type")).alias("sigma"), F.when(F.col("idx") == 0, velocity).alias("velocity"),
    )
    return chunked_scan(
        rows, ["mission_id"], ["idx"], chunk, filter_element, join_filters, filter_rows,
        "mission_id bigint, idx bigint, t double, inliers bigint, has_gps boolean, x array<double>, P array<double>, "
        "xp array<double>, Pp array<double>, rejected boolean", settled=same_state,
    )


def _smoothers(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """E, g, L of every station, latest first: the smoothed state is E s + g and E S E' + L of the next station's (s, S)."""
    x = np.array(pdf["x"].tolist(), float).reshape(-1, 2, 3)
    p = np.array(pdf["P"].tolist(), float)
    dt = pdf["dt_next"].to_numpy(float)
    last = np.isnan(dt)
    dt = np.where(last, 1.0, dt)
    cov = np.stack([p[:, [0, 1]], p[:, [1, 2]]], axis=1)
    f = np.zeros_like(cov)
    f[:, 0, 0] = f[:, 1, 1] = 1.0
    f[:, 0, 1] = dt
    noise = np.zeros_like(cov)
    noise[:, 0, 0], noise[:, 1, 1] = POS_NOISE**2 * dt, VEL_NOISE**2 * dt
    pred = f @ cov @ f.transpose(0, 2, 1) + noise
    gain = cov @ f.transpose(0, 2, 1) @ np.linalg.inv(pred)
    gain[last] = 0.0
    return gain, x - gain @ (f @ x), cov - gain @ pred @ gain.transpose(0, 2, 1)


def join_smoothers(later: list[float], earlier: list[float]) -> list[float]:
    ea, eb = (np.array(e[:4]).reshape(2, 2) for e in (later, earlier))
    ga, gb = (np.array(e[4:10]).reshape(2, 3) for e in (later, earlier))
    c = eb @ _symmetric(later[10:13]) @ eb.T + _symmetric(earlier[10:13])
    return [*(eb @ ea).ravel(), *(eb @ ga + gb).ravel(), c[0, 0], c[0, 1], c[1, 1]]


def smoother_element(pdf: pd.DataFrame, before) -> list[float]:
    gain, mean, cov = _smoothers(pdf)
    whole, g, c = gain[0], mean[0], cov[0]
    for e, m, v in zip(gain[1:], mean[1:], cov[1:], strict=True):
        whole, g, c = e @ whole, e @ g + m, e @ c @ e.T + v
    return [*whole.ravel(), *g.ravel(), c[0, 0], c[0, 1], c[1, 1]]


def smoother_rows(pdf: pd.DataFrame, before: list[float] | None) -> pd.DataFrame:
    gain, mean, cov = _smoothers(pdf)
    g, c = (np.zeros((2, 3)), np.zeros((2, 2))) if before is None else (np.array(before[4:10]).reshape(2, 3), _symmetric(before[10:13]))
    positions, traces = [], []
    for e, m, v in zip(gain, mean, cov, strict=True):
        g, c = e @ g + m, e @ c @ e.T + v
        positions.append(g[0].tolist())
        traces.append(3.0 * float(c[0, 0]))
    return pdf[["mission_id", "idx", "t", "inliers", "has_gps", "rejected"]].assign(fused=positions, cov_trace=traces)


def smooth_backward(filtered: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Backward smoothing of a filtered track, as affine maps composed from the end; jobs run here."""
    chunk = F.floor(F.col("idx") / chunk_rows)
    rows = with_neighbour(filtered, ["mission_id"], ["idx"], chunk, ["t"], "_next", following=True)
    rows = rows.withColumn("dt_next", F.greatest(F.lit(0.01), F.col("_next.t") - F.col("t"))).withColumn(
        "dt_next", F.when(F.col("_next").isNotNull(), F.col("dt_next"))
    )
    smoothed = chunked_scan(
        rows.select("mission_id", "idx", "t", "inliers", "has_gps", "rejected", "x", "P", "dt_next"),
        ["mission_id"], ["idx"], chunk, smoother_element, join_smoothers, smoother_rows,
        "mission_id bigint, idx bigint, t double, inliers bigint, has_gps boolean, rejected boolean, "
        "fused array<double>, cov_trace double", descending=True,
    )
    return smoothed.withColumn("confidence", station_confidence(F.col("cov_trace"), F.col("inliers"), F.col("has_gps")))


def station_confidence(trace: Column, inliers: Column, has_gps: Column) -> Column:
    spread = F.greatest(F.lit(0.2), 1.0 - F.sqrt(F.greatest(F.lit(0.0), trace)) / 6.0)
    support = F.least(F.lit(1.0), F.greatest(F.lit(0.3), inliers / 100.0))
    bonus = F.when(has_gps, 0.15).otherwise(0.0)
    return F.round(clip(spread * 0.6 + support * 0.3 + bonus, 0.15, 0.99), 2)


def enu_from_first(track: DataFrame, keys: list[str] = ["mission_id"]) -> DataFrame:
    """East, north, up of each fix relative to the first fix of its track."""
    origin = track_origin(track, keys)
    return track.join(origin, keys).withColumn(
        "enu", F.array(*geo.to_enu(*[F.col(c) for c in ("lat", "lon", "alt", "lat0", "lon0", "alt0")]))
    )


def track_origin(track: DataFrame, keys: list[str] = ["mission_id"], time: str = "t") -> DataFrame:
    first = F.min_by(F.struct("lat", "lon", "alt"), F.col(time)).alias("_o")
    return track.groupBy(*keys).agg(first).select(
        *keys, F.col("_o.lat").alias("lat0"), F.col("_o.lon").alias("lon0"), F.col("_o.alt").alias("alt0")
    )


def trajectory_level(stations: DataFrame) -> DataFrame:
    """Fused when a mission has at least three positions, else visual only."""
    fused = F.col("gps_points") >= 3
    return stations.groupBy("mission_id").agg(
        F.count(F.lit(1)).alias("total_keyframes"), F.count_if(F.col("gps").isNotNull()).alias("gps_points")
    ).select(
        "*", F.when(fused, "LEVEL_2_FUSED").otherwise("LEVEL_1_VISUAL_ONLY").alias("level"),
        F.when(fused, "FUSED_GPS_IMU").otherwise("VISUAL_ONLY").alias("fusion_mode"),
    )


def track_extents(positions: DataFrame, keys: list[str] = ["mission_id"]) -> DataFrame:
    """Plan extents and altitude profile; spans are at least 1."""
    ends = positions.groupBy(*keys).agg(
        *[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    )
    return ends.withColumns({
        f"span_{c}": F.greatest(F.lit(1.0), F.col(f"max_{c}") - F.col(f"min_{c}")) for c in "xyz"
    })


def mean_inliers(pair_matches: DataFrame) -> DataFrame:
    """Mean inliers over consecutive pairs ``(mission_id, frame_a, frame_b, inliers)``."""
    return pair_matches.where(F.col("frame_b") == F.col("frame_a") + 1).groupBy("mission_id").agg(
        rounded(F.avg("inliers"), 1).alias("mean_inlier_matches")
    )


def orientation(poses: DataFrame) -> DataFrame:
    """Quaternion (w, x, y, z) and yaw, pitch, roll of each rotation."""
    r = la.arr9("R")
    q = la.quaternion_wxyz(r)
    return poses.withColumn("quaternion", F.array(*[rounded(c, 5) for c in q])).withColumns(
        {k: rounded(v, 2) for k, v in la.euler_deg(r).items()}
    )
