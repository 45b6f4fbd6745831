"""Whitening against numpy's eigensolver on the same integers; the contour solver on spectra of every kind."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavetally.llm import whitening as wh
from wavetally.llm import whitening_query


def matrix(values, seed=0):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))[0]
    v = (q * np.asarray(values, float)) @ q.T
    return (v + v.T) / 2


SPECTRA = {
    "spread": np.arange(1, 41),
    "steep": 10.0 ** -np.arange(12),
    "all equal": np.full(9, 3.0),
    "tied at the end": [9, 8, 7, 6, 5, 4, 3, 2, 2, 2, 1],
    "close pair": [5, 4 + 1e-9, 4, 3, 1, 1, 0.5, 0.1, 0.1, 0],
    "tied blocks": [7] * 6 + [6] * 6 + [1] * 6,
    "low rank": [4, 2, 1] + [0] * 20,
    "one": [2.5],
    "wide": np.random.default_rng(5).gamma(1, 1, 64),
    "large": np.random.default_rng(6).gamma(2, 1e9, 64),
}


@pytest.mark.parametrize("name", SPECTRA)
def test_leading_pairs_equal_a_dense_solver(name):
    v = matrix(SPECTRA[name])
    e, x = wh.leading_pairs(v, 8)
    want = np.linalg.eigvalsh(v)[::-1]
    want = want[want > wh.ZERO * np.trace(v)][:8]
    scale = np.abs(v).sum(axis=1).max()
    assert len(e) == len(want) and np.abs(e - want).max() <= 1e-13 * scale * len(v)
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-13
    assert np.linalg.norm(v @ x - x * e, axis=0).max() <= 1e-12 * scale


@pytest.mark.parametrize("name", SPECTRA)
def test_inertia_counts_eigenvalues(name):
    v = matrix(SPECTRA[name], seed=3)
    e = np.linalg.eigvalsh(v)
    for s in np.linspace(-1, e.max() * 1.1, 37):
        if np.abs(e - s).min() > 1e-9 * max(1, e.max()):
            assert wh.inertia(v, s) == (e > s).sum()
    assert wh.inertia(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


def test_intervals_hold_what_inertia_counts():
    v = matrix(SPECTRA["wide"])
    e = np.linalg.eigvalsh(v)
    parts = wh.intervals(v, 20)
    assert sum(c for *_, c in parts) >= 20
    assert all(((e > lo) & (e <= hi)).sum() == c <= wh.BLOCK for lo, hi, c in parts)
    assert [p[0] for p in parts[:-1]] == [p[1] for p in parts[1:]]


def test_a_missed_eigenvalue_is_an_error():
    with pytest.raises(ArithmeticError, match="inertia counts 5"):
        wh.feast(matrix([5, 4, 3, 2, 1]), 2.5, 6, 5)


def brute(rows, width, k=8):
    fine = [(key, v) for key, v in rows if v is not None and len(v) == width and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for _, v in fine])
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    return [key for key, _ in fine], n, ((n * x - s).astype(object) ** 2).sum(axis=1), centred @ u / np.sqrt(e), e / np.trace(v)


def test_rows_of_every_kind(spark):
    rng = np.random.default_rng(8)
    base = rng.standard_normal((300, 12)) * np.linspace(3, 0.3, 12)
    rows = [(i if i % 60 else None, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(500, None), (501, []), (502, [1.0] * 11 + [None]), (503, [1.0] * 11 + [float("nan")]), (504, [float("inf")] * 12), (505, [1.0] * 5),
             (506, [1.0] * 13), rows[5], rows[5]]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("n", F.lit("clash")).repartition(3)
    got = wh.whiten_vectors(frame).toPandas()
    keys, n, deviation, whitened, explained = brute(rows, 12)
    assert len(got) == 8 * len(keys) and set(got["n"]) == {n} and got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-10
    assert sorted(got.loc[got["component"] == 1, "deviation"].astype(int)) == sorted(int(d) for d in deviation)
    at = {k: i for i, k in enumerate(keys) if k is not None}
    for component in range(1, 9):
        part = got[(got["component"] == component) & got["vec_id"].notna()]
        mine, want = part["whitened"].to_numpy(), whitened[[at[int(k)] for k in part["vec_id"]], component - 1]
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        assert np.allclose(part["explained"], explained[component - 1], rtol=1e-9)


def test_nothing_to_whiten(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert wh.whiten_vectors(empty).count() == 0
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert wh.whiten_vectors(same).count() == 0
    line = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0])], "vec_id long, embedding array<double>")
    assert sorted(round(r["whitened"] ** 2, 9) for r in wh.whiten_vectors(line).collect()) == [1.0, 1.0]
    with pytest.raises(Exception, match="too large"):
        wh.whiten_vectors(spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")).count()


def test_covariance_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((50, 3)) * [1e9, 1.0, 1e-3])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    n, sums = wh.integer_sums(frame, "embedding")
    x = [[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in rows]
    assert n == 50 and [int(s) for s in sums] == [sum(c) for c in zip(*x)]
    v = wh.exact_covariance(frame, "embedding", n, sums)
    for a in range(3):
        for b in range(3):
            want = Fraction(sum((50 * p[a] - int(sums[a])) * (50 * p[b] - int(sums[b])) for p in x), 50**3)
            assert v[a, b] == float(want)


def test_deviations_beyond_a_long(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(rng.standard_normal((40, 5)) * 1e8)]
    got = wh.whiten_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    keys, _, deviation, *_ = brute(rows, 5)
    assert max(deviation) > 2**63
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == dict(zip(keys, map(int, deviation)))


def test_query(spark):
    out = whitening_query.op11_embedding_whitening(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                                "explained": "double", "identity_error": "double"}
    assert out.select("vec_id", "component").distinct().count() == out.count() == 8 * out.first()["n"]
