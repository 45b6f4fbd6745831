"""Training: sums of blocks over many tasks, and ICA that runs to its tolerance."""

import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_signal import make
from wavetally.operators import training


@pytest.mark.parametrize("block_bytes", [8, 200, 1 << 18])
def test_blocks_of_many_tasks_add_up(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(training, "BLOCK_BYTES", block_bytes)
    x = np.random.default_rng(0).standard_normal((400, 7))
    x[3, 2] = np.nan
    sig = make(spark, x).withColumn("label", (F.col("t") % 3).cast("int")).repartition(40)
    mean = np.nanmean(x, axis=0)
    z = np.where(np.isnan(x), 0, x - mean)
    got = training._matrices(training.gram(sig, mean, "label"))
    for m in range(3):
        assert np.allclose(got[m], z[m::3].T @ z[m::3] / len(z[m::3]), atol=1e-13)
    rows = {(r["i"], r["j"]): r["cov"] for r in training.covariance(sig).collect()}
    assert sorted(rows) == [(i, j) for i in range(7) for j in range(i, 7)]
    assert all(np.isclose(v, (z.T @ z / 400)[k]) for k, v in rows.items())


def test_a_task_returns_half_a_matrix(spark, monkeypatch):
    """What is shuffled per task is bounded by the matrix, not by its entries as rows."""
    monkeypatch.setattr(training, "BLOCK_BYTES", 1 << 12)
    sig = make(spark, np.random.default_rng(1).standard_normal((64, 128))).coalesce(1)
    sent = training.gram(sig).agg(F.sum(F.length("data"))).first()[0]
    assert 8 * 128 * 128 / 2 <= sent <= 8 * 128 * 128


def test_runs_give_the_same_bits(spark):
    sig = make(spark, np.random.default_rng(2).standard_normal((500, 5))).repartition(50).cache()
    a, b = (training._matrices(training.gram(sig))[0] for _ in range(2))
    assert (a == b).all()


def test_channel_counts_must_agree(spark):
    both = make(spark, np.ones((5, 3)), "a").unionByName(make(spark, np.ones((5, 4)), "b"))
    with pytest.raises(Exception, match="one channel count"):
        training.covariance(both, centred=False).count()


def test_ica_reaches_its_tolerance_on_nearly_normal_data(spark):
    x = np.random.default_rng(3).standard_normal((400, 10))
    unmixing, mean, passes, distance = training.fastica(make(spark, x), tol=1e-6)
    assert distance <= 1e-6 and passes < 200
    y = (x - mean) @ unmixing.T
    assert np.allclose(y.T @ y / len(y), np.eye(10), atol=1e-9)
    g = np.tanh(y)
    cross, slope = g.T @ y / len(y), (1 - g * g).mean(axis=0)
    sign = np.sign(np.diag(cross) - slope)[:, None]
    assert np.abs(sign * cross - (sign * cross).T).max() < 1e-2 * np.abs(cross).max()


def test_sums_of_a_pass_are_the_same_on_every_path(spark, monkeypatch):
    sig = make(spark, np.random.default_rng(6).standard_normal((600, 5))).repartition(40).cache()
    args = (40, np.full(5, 0.1), np.eye(5) * 1.1, np.eye(5))
    near = training._contrast(sig, *args)
    monkeypatch.setattr(training, "SMALL_SUMS", 0)
    monkeypatch.setattr(training, "BLOCK_BYTES", 90)
    far = training._contrast(sig, *args)
    assert all(np.allclose(getattr(near, f), getattr(far, f), rtol=1e-12) for f in ("cross", "slope", "value"))


def test_ica_says_when_it_stops_early(spark):
    x = np.random.default_rng(4).standard_normal((200, 6))
    with pytest.warns(UserWarning, match="above the tolerance"):
        training.fastica_calibrate(make(spark, x), max_iter=2)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        training.fastica_calibrate(make(spark, x))


def test_distance_ignores_signs():
    cross = np.diag([0.5, -0.7])
    assert training.Contrast(cross, np.zeros(2), np.zeros(2)).distance() < 1e-15
