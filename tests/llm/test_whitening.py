"""Whitening against plain whole-number sums and a plain projection."""

from fractions import Fraction

import numpy as np
import pytest

from skyfold.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def plain(vectors):
    """n, S, covariance by products of centred whole numbers, and deviations."""
    xs = [[int(np.floor(64 * np.float64(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(xs), [sum(col) for col in zip(*xs, strict=True)]
    ys = [[n * x - s for x, s in zip(row, sums, strict=True)] for row in xs]
    cov = np.array([[float(Fraction(sum(y[i] * y[j] for y in ys), n**3)) for j in range(len(sums))] for i in range(len(sums))])
    return n, sums, cov, [sum(c * c for c in y) for y in ys]


def test_query_equals_plain(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    n, sums, cov, deviations = plain([r["embedding"] for r in rows])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:32], vectors[:, ::-1][:, :32]
    x = np.floor(np.array([r["embedding"] for r in rows], np.float64) * 64) + 1_000_000
    z = (x - np.array(sums) / n) @ vectors / np.sqrt(values)
    found = queries.QUERIES["op11_embedding_whitening"](spark, SF).orderBy("vec_id", "component").collect()
    assert len(found) == n * 32
    got = np.array([r["whitened"] for r in found]).reshape(n, 32)
    assert np.abs(np.abs(got) - np.abs(z)).max() < 1e-7
    assert len({tuple(s) for s in np.sign(got * z)}) == 1
    assert [r["deviation"] for r in found[::32]] == deviations
    assert [int(r["deviation_exact"]) for r in found[::32]] == deviations
    assert {r["n"] for r in found} == {n}
    assert np.allclose([r["explained"] for r in found[:32]], values / np.trace(cov), rtol=1e-9)
    assert len({r["identity_error"] for r in found}) == 1 and found[0]["identity_error"] < 1e-9


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), i / 7, -i * 0.5, float(i % 3)], "a", "b") for i in range(9)]
    bad = [(90, None, "", ""), (91, [1.0, None, 2.0, 3.0], "", ""), (92, [1.0, nan, 2.0, 3.0], "", ""), (93, [inf, 0.0, 0.0, 0.0], "", ""), (94, [], "", ""), (95, [1.0, 2.0], "", ""), (96, [1e300, 0.0, 0.0, 0.0], "", "")]
    rows = spark.createDataFrame([*good, good[3], *bad], "vec_id long, embedding array<double>, whitened string, n string")
    model = whitening.fit(rows, "embedding")
    n, sums, cov, deviations = plain([g[1] for g in [*good, good[3]]])
    assert (model.n, list(model.sums)) == (n, sums)
    assert np.array_equal(model.covariance, cov)
    # two equal columns: one direction has no variance
    assert len(model.values) == 3
    found = whitening.whiten(rows, "embedding", model, 2).collect()
    assert sorted(int(r["deviation"]) for r in found) == sorted(deviations)
    assert all(len(r["whitened"]) == 2 and r["n"] == "b" for r in found)


def test_large_entries_stay_exact(spark):
    vectors = [[2.0**40 * (i + 1), -(2.0**54) + i * 2.0**10] for i in range(5)]
    rows = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    model = whitening.fit(rows, "embedding")
    n, sums, cov, deviations = plain(vectors)
    assert np.array_equal(model.covariance, cov)
    assert sorted(int(r["deviation"]) for r in whitening.whiten(rows, "embedding", model).collect()) == sorted(deviations)


@pytest.mark.parametrize("large", [1, 1 << 40, 1 << 51, 1 << 60])
def test_square_sums(large):
    rng = np.random.default_rng(large % 1000)
    y = rng.integers(-large, large + 1, (2100, 3))
    assert whitening.square_sums(y) == [sum(int(v) ** 2 for v in y[:, k]) for k in range(3)]


def test_no_rows_and_one_row(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert whitening.fit(empty, "embedding") is None
    none = whitening.whiten(empty, "embedding", None)
    assert none.count() == 0 and whitening.identity_error(none) == 0
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    model = whitening.fit(one, "embedding")
    assert [r["whitened"] for r in whitening.whiten(one, "embedding", model).collect()] == [[]]
