"""Plans and steps that must hold up on larger tables."""

import numpy as np
import pytest

import __spark_entry__ as entry
from skyfold.operators import neighbours
from skyfold.plans import adapters as ad


@pytest.fixture
def suppliers(spark, tmp_path):
    rows = [(k, f"Supplier#{k}", k % 25, 37.5 * k % 9000 - 999.0) for k in range(400)]
    spark.createDataFrame(rows, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{tmp_path}/supplier.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", ["colour_balance", "level_normalisation", "pixel_similarity", "depth_confidence"])
def test_pixels_are_never_a_broadcast_side(spark, suppliers, capsys, name):
    entry.queries()[name](spark, suppliers).explain()
    plan = capsys.readouterr().out
    built = [plan.splitlines()[i + 1:i + 4] for i, line in enumerate(plan.splitlines()) if "BroadcastExchange HashedRelation" in line]
    assert not any("NestedLoop" in line or "Generate" in line for lines in built for line in lines)
    assert "Generate" not in plan and ("SortMergeJoin" in plan)


def test_pixels_of_a_frame_share_a_task(spark, suppliers):
    px = ad.pixels(spark, suppliers)
    found = px.selectExpr("frame_id", "x", "y", "spark_partition_id() p").groupBy("frame_id").agg({"p": "max", "x": "count"})
    assert found.count() == 400 and found.where("`count(x)` <> 1024").count() == 0
    assert px.selectExpr("frame_id", "spark_partition_id() p").distinct().count() == 400
    assert px.select("frame_id", "x", "y").distinct().count() == 400 * 1024


def test_descriptors_meet_all_features_of_a_frame(spark, tmp_path):
    """Features far apart by id match, over blocks of queries and the border of a chunk."""
    import numpy as np

    from skyfold.operators import sparse as sp

    vecs = np.random.default_rng(5).normal(size=(1600, 8))
    vecs[1001] = vecs[0] + 1e-4  # frames 0 and 1; formerly of other missions or frames
    rows = [(k, [float(v) for v in vecs[k]]) for k in range(1600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = entry.queries()["descriptor_matches"](spark, str(tmp_path)).where("kp = 0 and frame_i = 0 and frame_j = 1").collect()
    assert [r["match_kp"] for r in got] == [1001]
    d = ad.descriptors(spark, str(tmp_path)).selectExpr("1L mission_id", "frame", "kp", "vec")
    pairs = spark.createDataFrame([(1, 0, 1)], "mission_id long, frame_i long, frame_j long")
    whole, cut = (sp.descriptor_matches(pairs, d, 0.95, chunk=c, block=b) for c, b in ((4096, 512), (60, 7)))
    key = lambda df: sorted((r["kp"], r["match_kp"], round(r["d1"], 9), round(r["d2"], 9)) for r in df.collect())
    assert key(whole) == key(cut) and len(key(whole)) > 0


def test_the_code_of_a_view_pair_is_compiled(spark, suppliers):
    """The JVM interprets methods beyond 8,000 bytes, which made each (face, camera) pair some times dearer."""
    import re

    from skyfold.plans.catalog import geometry

    rows = [(k, k % 7, 100.0 * (k % 9)) for k in range(400)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(f"{suppliers}/orders.parquet")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(kept, ("false", "-1")):
            spark.conf.set(k, v)
        views = geometry._views_of_faces(spark, suppliers)
        mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
        text = views._jdf.queryExecution().explainString(mode)
        stages = re.findall(r"== Subtree \d+ / \d+ \(maxMethodCodeSize:(\d+);.*?\) ==\n(.*?)Generated code", text, re.S)
        sizes = [int(size) for size, plan in stages if "cos_theta" in plan.split("SortMergeJoin")[0]]
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert sizes and max(sizes) < 8000


def test_neighbours_within_a_bound_are_ordered_alone(monkeypatch):
    rng = np.random.default_rng(5)
    sorted_all = []
    monkeypatch.setattr(neighbours, "_smallest", lambda d2, k, fn=neighbours._smallest: sorted_all.append(1) or fn(d2, k))
    for limit in (2.0, np.inf):
        d2 = rng.integers(0, 200, (60, 300)).astype(float)
        d2[:, 7] = np.inf
        limits = np.full(60, limit)
        found, cols, near = neighbours._nearest_within(d2, limits, 16)
        want = [sorted((v, c) for c, v in enumerate(row) if v <= limit and np.isfinite(v))[:16] for row in d2]
        assert found.tolist() == [len(w) for w in want]
        assert list(zip(near.tolist(), cols.tolist())) == [x for w in want for x in w]
        assert len(sorted_all) == (0 if limit == 2.0 else 1)
