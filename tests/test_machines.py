"""Transition tables against sequential runs of the same machines, and their calls per chunk."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyfold.operators import frames as fr, keyframes as kf, machines
from skyfold.operators.ordered import group_starts, running_sums, whole_groups

SCHEMA = "mission_id long, frame_id long, frame_index long, total_frames long, fps double, laplacian_var double, mean_luminance double, feature_count long, thumb array<double>"


def shots(seed, n=400, still=0.0):
    """Frames of two missions; a share of them is alike in runs, some are blurred, dark or bare."""
    rng = np.random.default_rng(seed)
    rows = []
    for mission, size in ((1, n), (2, 7)):
        thumb = rng.uniform(0, 255, 6)
        for i in range(size):
            if rng.random() > still:
                thumb = rng.uniform(0, 255, 6)
            rows.append((mission, 1000 * mission + i, i, size, 8.0, float(rng.uniform(0, 200)), float(rng.uniform(0, 256)), int(rng.integers(0, 200)), (thumb + rng.normal(0, 1, 6)).tolist()))
    return rows


def plain(spark, rows, decide, rules):
    out = []
    for mission in sorted({r[0] for r in rows}):
        own = spark.createDataFrame([r for r in rows if r[0] == mission], SCHEMA).orderBy("frame_index").collect()
        made, _ = machines.run_machine(own, {}, lambda row, state: ({} if (got := decide(row, state, rules))[0] else None, got[1]))
        out += [(mission, own[i].frame_index) for i, _ in made][: rules.ceiling]
    return out


@pytest.mark.parametrize("decide", [fr.gate_decision, fr.paced_decision])
@pytest.mark.parametrize(("seed", "still", "chunk", "ceiling"), [(1, 0.3, 40, None), (2, 0.97, 25, 30), (3, 1.0, 40, None), (4, 0.5, 1000, 5)])
def test_samplers_equal_sequential(spark, decide, seed, still, chunk, ceiling):
    rows = shots(seed, 400, still)
    rules = fr.SamplerRules(ceiling=ceiling)
    got = fr.adaptive_sample(spark.createDataFrame(rows, SCHEMA).repartition(3), decide, rules, chunk)
    assert sorted((r.mission_id, r.frame_index) for r in got.collect()) == plain(spark, rows, decide, rules)


def counted(spark, monkeypatch):
    calls = {n: spark.sparkContext.accumulator(0) for n in ("leaving_states", "run_machine")}
    for name, calls_of in calls.items():
        fn = getattr(machines, name)

        def wrapped(*args, fn=fn, calls_of=calls_of):
            calls_of.add(1)
            return fn(*args)

        monkeypatch.setattr(machines, name, wrapped)
    return calls


@pytest.mark.parametrize("decide", [fr.gate_decision, fr.paced_decision])
def test_three_calls_per_chunk(spark, monkeypatch, decide):
    calls = counted(spark, monkeypatch)
    rows = [r for r in shots(7, 64 * 30, 0.6) if r[0] == 1]
    got = fr.adaptive_sample(spark.createDataFrame(rows, SCHEMA), decide, fr.SamplerRules(), 30)
    assert got.count() > 100
    assert calls["leaving_states"].value + calls["run_machine"].value <= 3 * 64


def scenes(seed, n):
    rng = np.random.default_rng(seed)
    kind = rng.choice(["HIGH", "MEDIUM", "LOW"], n, p=[0.4, 0.3, 0.3])
    scores = [(1, 100 + i, i, str(kind[i]), float(rng.uniform(0, 1)), int(rng.integers(0, 60)), int(rng.integers(0, 100))) for i in range(n)]
    flow = [(1, 100 + i - d, 100 + i, float(rng.uniform(0, 12) * d), float(rng.uniform(0, 0.6)), int(rng.integers(0, 60))) for i in range(n) for d in range(1, 9) if i >= d and rng.random() < 0.9]
    return scores, flow


@pytest.mark.parametrize(("chunk", "most"), [(2, None), (16, 9), (1000, None)])
def test_keyframes_equal_sequential(spark, chunk, most):
    scores, flow = scenes(3, 120)
    rules = kf.KeyframeRules(max_keyframes=most)
    sdf = spark.createDataFrame(scores, "mission_id long, frame_id long, frame_index long, classification string, redundancy double, feature_count long, overall_quality int")
    fdf = spark.createDataFrame(flow, "mission_id long, ref_frame long, cur_frame long, median_displacement double, angle_variance double, tracked long")
    got = kf.select_keyframes(sdf, fdf, rules, chunk).orderBy("frame_index").collect()
    moves = {}
    for _, ref, cur, displacement, variance, tracked in flow:
        moves.setdefault(cur, []).append({"ref": ref, "displacement": displacement, "variance": variance, "tracked": tracked})
    state, moved, want = {}, 0.0, []
    for row in sdf.orderBy("frame_index").collect():
        row = type("Row", (), {**row.asDict(), "moves": moves.get(row.frame_id)})
        record, state = kf.keyframe_decision(row, state, rules)
        moved += record["moved"] if record else 0.0
        if record and record["selection_reason"]:
            want.append((row.frame_id, len(want), record["selection_reason"], record["similarity_to_previous"], moved))
    assert [(r.frame_id, r.keyframe_index, r.selection_reason, r.similarity_to_previous) for r in got] == [w[:4] for w in want[:most]]
    assert np.allclose([r.moved_so_far for r in got], [w[4] for w in want[:most]])


def test_keyframes_with_fallback_run_each_mission_once(spark, monkeypatch):
    calls = counted(spark, monkeypatch)
    frames = [(m, 100 * m + i, i, "HIGH", 0.1 * (i % 9), 50, 80) for m in range(12) for i in range(8)]
    sdf = spark.createDataFrame(frames, "mission_id long, frame_id long, frame_index long, classification string, redundancy double, feature_count long, overall_quality int")
    fdf = spark.createDataFrame([], "mission_id long, ref_frame long, cur_frame long, median_displacement double, angle_variance double, tracked long")
    got = kf.with_fallback(kf.select_keyframes(sdf, fdf), sdf).collect()
    assert {r.mission_id for r in got} == set(range(12))
    assert calls["run_machine"].value == 12


def test_batches_are_cut_between_groups():
    key = [None, None, 1, 1, 1, 1, 1, 1, 2, 3, 3]
    whole = pa.record_batch({"k": pa.array(key, pa.int64()), "v": list(range(11))})
    for size in range(1, 12):
        tables = list(whole_groups((whole.slice(i, size) for i in range(0, 11, size)), ["k"]))
        assert [v for t in tables for v in t.column("v").to_pylist()] == list(range(11))
        assert [k for t in tables for k in dict.fromkeys(t.column("k").to_pylist())] == [None, 1, 2, 3]
        assert [len(group_starts(t, ["k"])) for t in tables] == [len(set(t.column("k").to_pylist())) for t in tables]


def test_runs_that_meet_end_alike():
    rows = list(range(50))

    def decide(row, state):
        keep = row % 10 == 0 or state.get("eager", 0) > 2
        return ({}, {"last": row}) if keep else (None, {**state, "eager": state.get("eager", 0) + (row % 3 == 0)})

    states = [{}, {"last": 3, "eager": 1}, {"last": 9}]
    assert machines.leaving_states(rows, states, decide) == [machines.run_machine(rows, s, decide)[1] for s in states]


def test_running_sums(spark):
    rows = [(k, i, float(i * k)) for k in (1, 2) for i in range(23)]
    got = running_sums(spark.createDataFrame(rows, "k long, i long, v double"), ["k"], ["i"], F.floor(F.col("i") / 4), {"s": F.col("v"), "n": F.lit(1)})
    assert {(r.k, r.i): (r.s, r.n) for r in got.collect()} == {(k, i): (float(sum(j * k for j in range(i + 1))), i + 1) for k, i, _ in rows}


def test_no_frames(spark):
    assert fr.adaptive_sample(spark.createDataFrame([], SCHEMA)).count() == 0
