"""Chunk scans against sequential runs: poses, filter, smoother and their calls per chunk."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from skyfold.operators import trajectory as tr
from skyfold.operators.scans import chunked_scan, exclusive_prefix

CHUNKS, ROWS = 64, 40
SIGMA = {"RTK_FIXED": 0.02, "RTK_FLOAT": 0.20, None: 2.5}


def tracks(seed=3, n=CHUNKS * ROWS):
    """Two missions of irregular stations; fixes that come and go, some far off, and equal times."""
    rng = np.random.default_rng(seed)
    rows = []
    for mission in (1, 2):
        t = 1.7e9 + np.cumsum(rng.choice([0.0, 0.004, 0.5, 1.0, 7.3], n))
        path = np.cumsum(rng.normal(0, 0.4, (n, 3)), axis=0)
        for i in range(n if mission == 1 else 3):
            far = rng.random() < 0.15
            kind = ["RTK_FIXED", "RTK_FLOAT", None][rng.integers(3)]
            noise = rng.normal(0, SIGMA[kind], 3) + (40.0 if far else 0.0)
            gps = (path[i] + noise).tolist() if rng.random() < 0.8 else None
            rows.append((mission, i, float(t[i]), (path[i] + rng.normal(0, 0.2, 3)).tolist(), gps, kind, int(rng.integers(0, 200))))
    return rows


SCHEMA = "mission_id long, idx long, t double, visual array<double>, gps array<double>, fix_type string, inliers long"


def plain_fusion(rows):
    """The filter and smoother with full 6x6 matrices, one station after the other."""
    h = np.hstack([np.eye(3), np.zeros((3, 3))])
    steps = []
    for k, (_, _, t, visual, gps, kind, inliers) in enumerate(rows):
        visual = np.array(visual)
        if k == 0:
            dt1 = max(0.01, rows[1][2] - t) if len(rows) > 1 else 1.0
            velocity = (np.array(rows[1][3]) - visual) / dt1 if len(rows) > 1 else np.zeros(3)
            x, p = np.concatenate([visual if gps is None else gps, velocity]), np.diag([10.0] * 3 + [50.0] * 3)
            steps.append((x, p, None, None, None, False))
            continue
        dt = max(0.01, t - rows[k - 1][2])
        f = np.eye(6)
        f[:3, 3:] = dt * np.eye(3)
        xp, pp = f @ x, f @ p @ f.T + np.diag([0.01 * dt] * 3 + [0.25 * dt] * 3)
        x, p = xp, pp

        def update(x, p, z, r):
            s = h @ p @ h.T + np.eye(3) * r * r
            gain, gap = p @ h.T @ np.linalg.inv(s), z - h @ x
            return x + gain @ gap, p - gain @ h @ p, gap @ np.linalg.inv(s) @ gap

        x, p, _ = update(x, p, visual, 0.25 * (1 + 30 / max(1, inliers)))
        refused = False
        if gps is not None:
            gx, gp, far = update(x, p, np.array(gps), SIGMA[kind])
            refused = far > (60.0 if k <= 2 else 16.27)
            if not refused:
                x, p = gx, gp
        steps.append((x, p, xp, pp, f, refused))
    out = [None] * len(steps)
    xs, ps = steps[-1][:2]
    out[-1] = (xs[:3], np.trace(ps[:3, :3]))
    for k in range(len(steps) - 2, -1, -1):
        x, p = steps[k][:2]
        _, _, xp, pp, f, _ = steps[k + 1]
        gain = p @ f.T @ np.linalg.inv(pp)
        xs, ps = x + gain @ (xs - xp), p + gain @ (ps - pp) @ gain.T
        out[k] = (xs[:3], np.trace(ps[:3, :3]))
    return [s[0] for s in steps], [s[5] for s in steps], out


@pytest.mark.parametrize("chunk", [ROWS, 100_000])
def test_fusion_equals_sequential(spark, chunk):
    rows = tracks()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    filtered = tr.forward_filter(df, chunk)
    smoothed = tr.smooth_backward(filtered, chunk)
    for mission in (1, 2):
        x, refused, want = plain_fusion([r for r in rows if r[0] == mission])
        got = filtered.where(F.col("mission_id") == mission).orderBy("idx").collect()
        assert [r.rejected for r in got] == refused
        assert any(refused) == (mission == 1)
        assert np.allclose([r.x for r in got], x, rtol=0, atol=1e-9)
        last = smoothed.where(F.col("mission_id") == mission).orderBy("idx").collect()
        assert np.allclose([r.fused for r in last], [w[0] for w in want], rtol=0, atol=1e-9)
        assert np.allclose([r.cov_trace for r in last], [w[1] for w in want], rtol=0, atol=1e-9)


def test_filter_elements_join():
    rng = np.random.default_rng(1)
    e = tr._Element()
    both = tr._Element()
    parts = []
    for k in range(3):
        e = tr._Element()
        for _ in range(4):
            dt, z, var = rng.uniform(0.1, 2), rng.normal(0, 5, 3), rng.uniform(0.1, 3)
            for one in (e, both):
                one.predict(dt)
                one.update(z, var)
        parts.append(e.packed())
    left = tr.join_filters(tr.join_filters(parts[0], parts[1]), parts[2])
    right = tr.join_filters(parts[0], tr.join_filters(parts[1], parts[2]))
    assert np.allclose(left, right, atol=1e-9) and np.allclose(left, both.packed(), atol=1e-9)


def counted(spark, monkeypatch, name):
    calls = spark.sparkContext.accumulator(0)
    fn = getattr(tr, name)

    def wrapped(*args):
        calls.add(1)
        return fn(*args)

    monkeypatch.setattr(tr, name, wrapped)
    return calls


def test_calls_per_chunk(spark, monkeypatch):
    calls = [counted(spark, monkeypatch, n) for n in ("filter_element", "filter_rows", "smoother_element", "smoother_rows")]
    df = spark.createDataFrame([r for r in tracks() if r[0] == 1], SCHEMA)
    filtered = tr.forward_filter(df, ROWS)
    assert filtered.count() == CHUNKS * ROWS
    steps = calls[0].value + calls[1].value
    # two summaries and one output run; again only where a guessed refusal was wrong
    assert 3 * CHUNKS - 1 <= steps <= 3 * CHUNKS + 8
    tr.smooth_backward(filtered, ROWS).count()
    assert calls[2].value + calls[3].value == 2 * CHUNKS


def turns(seed, n):
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.normal(size=(n, 3, 3)))
    q[np.linalg.det(q) < 0, :, 0] *= -1
    return q, rng.normal(size=(n, 3)), rng.uniform(0.5, 4, n)


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_pose_chain_equals_sequential(spark, chunk):
    rots, shifts, steps = turns(4, 40)
    rows = [(m, i, rots[i].ravel().tolist(), shifts[i].tolist(), float(steps[i])) for m, n in ((1, 40), (2, 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "mission_id long, camera_index long, rel_R array<double>, rel_t array<double>, step_m double")
    got = tr.chain_poses(df, chunk).orderBy("mission_id", "camera_index").collect()
    r, t = np.eye(3), np.zeros(3)
    for i, row in enumerate(got[:40]):
        if i:
            r, t = rots[i] @ r, rots[i] @ t + shifts[i] * steps[i]
        assert np.allclose(row.R, r.ravel(), atol=1e-9) and np.allclose(row.t, t, atol=1e-9) and np.allclose(row.c, -r.T @ t, atol=1e-9)
    assert np.allclose(got[40].R, np.eye(3).ravel()) and np.allclose(got[40].c, 0)


def test_prefix_in_blocks_of_blocks(spark):
    rows = [(k, i, [float(i + k)]) for k in range(3) for i in range(30 if k else 1)]
    df = spark.createDataFrame(rows, "k long, i long, element array<double>")
    got = {(r.k, r.i): r.before for r in exclusive_prefix(df, ["k"], "i", lambda a, b: [a[0] + b[0]], fan=3).collect()}
    assert got == {(k, i): [float(sum(j + k for j in range(i)))] if i else None for k, i, _ in rows}


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tr.smooth_backward(tr.forward_filter(empty)).count() == 0
    sums = chunked_scan(
        spark.createDataFrame([], "k long, i long"), ["k"], ["i"], F.col("i"), lambda p, b: [0.0], lambda a, b: a,
        lambda p, b: pd.DataFrame({"k": p["k"]}), "k long",
    )
    assert sums.count() == 0


def test_small_chunks_are_read_in_batches(spark):
    rows = spark.range(300).selectExpr("id % 3 AS g", "id AS i", "cast(id AS double) AS x")
    sums = chunked_scan(
        rows, ["g"], ["i"], F.floor(F.col("i") / 6), lambda part, before: [part["x"].sum()], lambda a, b: [a[0] + b[0]],
        lambda part, before: part[["g", "i"]].assign(s=part["x"].cumsum() + (before[0] if before else 0.0)), "g bigint, i bigint, s double",
    )
    assert "FlatMapGroupsInPandas" not in sums._jdf.queryExecution().optimizedPlan().toString()  # a frame of its own for each chunk
    assert {(r.g, r.i): r.s for r in sums.collect()} == {(i % 3, i): float(sum(range(i % 3, i + 1, 3))) for i in range(300)}
