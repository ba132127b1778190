"""Whitening against a dense eigendecomposition of the covariance."""

import math

import numpy as np
import pytest

from chronorank.llm.whitening import COMPONENTS, whiten


def dense(rows, most=COMPONENTS):
    """(vec_id, component) -> (n, deviation, whitened up to sign, explained)."""
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in rows]
    n, dims = len(x), len(x[0])
    sums = [sum(row[d] for row in x) for d in range(dims)]
    away = np.array([[n * row[d] - sums[d] for d in range(dims)] for row in x], float) / n
    values, axes = np.linalg.eigh(away.T @ away / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for c in range(min(most, dims)):
        for (vec_id, _), row, centred in zip(rows, x, away, strict=True):
            deviation = sum((n * row[d] - sums[d]) ** 2 for d in range(dims))
            out[vec_id, c + 1] = (n, deviation, centred @ axes[:, c] / math.sqrt(abs(values[c])), values[c] / values.sum())
    return out


def check(df, rows, size=COMPONENTS):
    got = {(r.vec_id, r.component): r for r in df.collect()}
    want = {key: value for key, value in dense(rows).items() if key[1] <= size}
    assert got.keys() == want.keys()
    # either sign, but the same for all rows
    sign = {}
    for key, (_, _, white, _) in sorted(want.items(), key=lambda item: -abs(item[1][2])):
        sign.setdefault(key[1], math.copysign(1, got[key].whitened * white))
    for key, (n, deviation, white, explained) in want.items():
        row = got[key]
        assert (row.n, row.deviation) == (n, deviation)
        assert row.explained == pytest.approx(explained, rel=1e-9)
        assert row.identity_error < 1e-9
        assert row.whitened * sign[key[1]] == pytest.approx(white, abs=1e-8)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_given_vectors(spark, folder):
    embeddings = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in embeddings.collect()]
    check(whiten(embeddings), rows)


def test_few_dimensions_and_falling_deviations(spark):
    draw = np.random.default_rng(1)
    rows = [(i, (draw.standard_normal(5) * 10.0 ** -np.arange(5)).astype(np.float32).tolist()) for i in range(400)]
    check(whiten(table(spark, rows).repartition(6)), rows, 5)


def test_equal_eigenvalues_are_all_found(spark):
    # all signs of all axes: the covariance is a multiple of the identity
    rows = [(2 * d + s, [(-1.0) ** s * (k == d) for k in range(12)]) for d in range(12) for s in range(2)]
    got = whiten(table(spark, rows)).collect()
    assert sorted((r.vec_id, r.component) for r in got) == [(i, c) for i in range(24) for c in range(1, 9)]
    assert all(r.explained == pytest.approx(1 / 12) and r.identity_error < 1e-9 for r in got)


def test_rank_below_the_number_of_components(spark):
    draw = np.random.default_rng(2)
    basis = draw.integers(-4, 5, (3, 10))
    rows = [(i, (draw.integers(-9, 10, 3) @ basis / 8.0).tolist()) for i in range(60)]
    check(whiten(table(spark, rows)), rows, 3)


def test_invalid_rows_go(spark):
    good = [(i, [float(i % 5), float(i % 7), float(i % 3)]) for i in range(40)]
    bad = [
        (100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]),
        (105, [3e38, 0.0, 0.0]), (106, [1.0, 2.0]),
    ]
    check(whiten(table(spark, good + bad)), good, 3)


def test_nothing_to_tell_apart(spark):
    assert whiten(table(spark, [])).collect() == []
    assert whiten(table(spark, [(1, None)])).collect() == []
    assert whiten(table(spark, [(1, [1.0, 2.0])])).collect() == []
    assert whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)])).collect() == []


def test_null_and_repeated_ids_large_numbers_and_clashing_columns(spark):
    rows = [(None, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [0.0, 1.0]), (2, [2e10, 3.0])]
    names = "n component dims rows ids numbers deviation"
    df = spark.createDataFrame(
        [(*r, *names.split()) for r in rows],
        "vec_id long, embedding array<double>, " + ", ".join(f"{c} string" for c in names.split()),
    )
    got = whiten(df).collect()
    assert sorted(str(r.vec_id) for r in got) == ["1"] * 4 + ["2"] * 2 + ["None"] * 2
    # 4 * x - S is about 6e13 for the last row: its square is beyond 64 bits
    assert {r.deviation for r in got if r.vec_id == 2} == {None}
