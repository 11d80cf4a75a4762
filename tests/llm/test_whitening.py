"""The incremental eigendecomposition against numpy's, and whitened rows against their definition."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import queries, whitening
from shelfwise.llm.spectrum import Spectrum, secular_roots
from tests.llm.conftest import SF


def test_secular_roots_are_the_eigenvalues():
    rng = np.random.default_rng(1)
    for _ in range(100):
        k = int(rng.integers(2, 30))
        d, z = np.sort(rng.normal(size=k)) * 10.0 ** rng.integers(-6, 7), rng.normal(size=k)
        roots, gaps = secular_roots(d, z)
        expected = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        scale = np.abs(expected).max()
        assert np.abs(roots - expected).max() <= 1e-13 * k * scale
        assert np.allclose(gaps, d[:, None] - roots, atol=1e-13 * scale)
        assert (roots > d).all() and (roots[:-1] < d[1:]).all()


def tables(kind, rng, n, d):
    x = rng.normal(size=(n, d)) * 20
    if kind == "two values":
        x = rng.integers(0, 2, (n, d)).astype(float)
    elif kind == "copies":
        x = np.repeat(x[: max(1, n // 20)], 20, 0)
    elif kind == "one direction":
        x = np.outer(rng.normal(size=n) * 50, rng.normal(size=d))
    elif kind == "wide range":
        x = x * np.logspace(0, 8, d)
    return np.floor(x).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("kind", ["plain", "two values", "copies", "one direction", "wide range"])
def test_updates_and_combination_match_numpy(kind):
    rng = np.random.default_rng(2)
    for _ in range(12):
        d, n = int(rng.integers(1, 40)), int(rng.integers(1, 150))
        x = tables(kind, rng, n, d)
        parts = []
        for some in np.array_split(x, 3):
            seen = Spectrum(d)
            for row, copies in zip(*np.unique(some, axis=0, return_counts=True)):
                seen.add(row, int(copies))
            parts.append(seen)
        found = parts[0]
        found.absorb(parts[1])
        found.absorb(parts[2])
        apart = x - x.mean(0)
        scatter = apart.T @ apart
        scale = max(np.abs(scatter).max(), 1e-300)
        assert np.abs((found.vectors * found.values) @ found.vectors.T - scatter).max() <= 1e-9 * scale
        assert np.abs(found.vectors.T @ found.vectors - np.eye(d)).max() < 1e-11
        assert (found.n, found.sums) == (len(x), x.sum(0).tolist())


def expected_rows(vectors):
    """(n, sums of squares, |whitened|, explained) by numpy and whole numbers of any size."""
    c = np.array(vectors, float)
    x = np.floor(64 * c).astype(np.int64).astype(object) + 1_000_000
    n, sums = len(x), x.sum(0)
    apart = n * x - sums
    deviation = (apart**2).sum(1)
    centred = apart.astype(float) / n
    values, directions = np.linalg.eigh(centred.T @ centred / n)
    values, directions = values[::-1], directions[:, ::-1]
    k = min(32, int((values > 1e-12 * values[0]).sum()))
    white = centred @ directions[:, :k] / np.sqrt(values[:k])
    return deviation.tolist(), white, values[:k] / values.sum()


def check_rows(rows, ids, vectors):
    deviation, white, explained = expected_rows(vectors)
    got = defaultdict(dict)
    for r in rows:
        assert r.n == len(vectors) and r.identity_error <= 1e-9
        got[r[0]][r.component] = r
    assert set(got) == set(ids)
    k = white.shape[1]
    assert len(rows) == len(ids) * k
    found = np.array([[got[i][c].whitened for c in range(1, k + 1)] for i in ids])
    sign = np.sign((found * white).sum(0))
    assert np.abs(found * sign - white).max() < 1e-7
    assert np.abs(np.cov(found.T, bias=True) - np.eye(k)).max() < 1e-9
    for i, d in zip(ids, deviation):
        assert {r.deviation for r in got[i].values()} == {d}
        assert np.allclose([got[i][c].explained for c in range(1, k + 1)], explained, rtol=1e-9)


def test_query_matches_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    check_rows(queries.op11_whitening(spark, SF).collect(), [r[0] for r in table], [r[1] for r in table])


def test_spectra_of_many_tasks(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 5)).round(3).tolist()
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    rows = whitening.whiten(frame.repartition(40)).collect()
    check_rows(rows, list(range(300)), vectors)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = rng.normal(size=(40, 3)).tolist()
    good += [good[0]] * 30
    rows = [(i, v, 1, "x") for i, v in enumerate(good)]
    rows += [
        (100, None, 1, "x"),
        (101, [1.0, None, 2.0], 1, "x"),
        (102, [1.0, float("nan"), 2.0], 1, "x"),
        (103, [1.0, float("-inf"), 2.0], 1, "x"),
        (104, [], 1, "x"),
        (105, [1.0], None, None),
    ]
    schema = "vec_id bigint, embedding array<double>, Component int, EMBEDDING string"
    frame = spark.createDataFrame(rows, schema)
    check_rows(whitening.whiten(frame).collect(), list(range(70)), good)
    unnamed = frame.withColumn("vec_id", F.when(F.col("vec_id") > 1, F.col("vec_id")))
    counts = Counter(r.vec_id for r in whitening.whiten(unnamed).collect())
    assert counts[None] == 2 * 3 and sum(counts.values()) == 70 * 3


def test_flat_and_empty_tables(spark):
    schema = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9):
        out = whitening.whiten(spark.createDataFrame(rows, schema))
        assert out.count() == 0
        assert out.columns[0] == "vec_id" and len(out.columns) == 7
    line = [(i, [float(i), 5.0, float(-i)]) for i in range(50)]
    out = whitening.whiten(spark.createDataFrame(line, schema)).collect()
    assert {r.component for r in out} == {1} and abs(out[0].explained - 1) < 1e-12


def test_wide_entries(spark):
    vectors = [[1e12 * i, -1e11 * i * i] for i in range(1, 9)]
    schema = "vec_id bigint, embedding array<double>"
    out = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), schema)).collect()
    deviation, _, _ = expected_rows(vectors)
    exact = {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
    assert {r.vec_id: r.deviation for r in out} == exact
    far = [(i, [1e300 * i, float(i % 3)]) for i in range(9)]
    assert whitening.whiten(spark.createDataFrame(far, schema)).count() == 9
