"""Alignments from sums against dense kernels, and mixtures fitted together."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import factors, selection


def table(spark, x, **more):
    rows = [(i, [float(v) for v in r], *[c[i] for c in more.values()]) for i, r in enumerate(x)]
    kinds = {"g": "int", "run": "string", "score": "double"}
    return spark.createDataFrame(rows, "row_id long, features array<double>" + "".join(f", {k} {kinds[k]}" for k in more)).repartition(3)


def dense(x):
    y = x - x.mean(0)
    y = y / np.linalg.norm(y, axis=1, keepdims=True)
    return y @ y.T


def test_partition_alignment_is_that_of_the_dense_kernel(spark):
    rng = np.random.default_rng(1)
    x, g = rng.normal(size=(40, 5)), rng.integers(0, 3, 40).tolist()
    got = selection.partition_alignment(table(spark, x, g=g, run=["a"] * 40), "run", "g").first()["alignment"]
    z = np.eye(3)[g]
    k = dense(x)
    assert got == pytest.approx((k * (z @ z.T)).sum() / (np.linalg.norm(k) * np.linalg.norm(z @ z.T)))


def test_threshold_parts_two_groups(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(60, 4)) * 0.1 + 1, rng.normal(size=(30, 4)) * 0.1 - 1])
    score = [float(v) for v in np.concatenate([rng.random(60), 2 + rng.random(30)])]
    threshold, share, fit = selection.reject_threshold(table(spark, x, score=score), "score")
    assert 0.99 <= threshold <= 2.1 and share == pytest.approx(1 / 3, abs=0.03)
    y = np.where(np.array(score) > threshold, -1, 1)
    k = dense(x)
    assert fit == pytest.approx((k * np.outer(y, y)).sum() / (np.linalg.norm(k) * 90))


def test_mixtures_are_fitted_together(spark):
    rng = np.random.default_rng(3)
    w = rng.random((3, 8))
    df = table(spark, rng.random((90, 3)) @ w + 0.01 * rng.random((90, 8))).cache()
    start = {2: rng.random((2, 8)), 3: rng.random((3, 8))}
    fits = selection.fit_mixtures(df, start, [0.0, 0.5], rounds=15)
    assert set(fits) == {(2, 0.0), (2, 0.5), (3, 0.0), (3, 0.5)} and all((v >= 0).all() for v in fits.values())
    x = np.array([r["features"] for r in df.collect()])
    error = lambda m: ((x - factors.coefficients(x, m) @ m) ** 2).sum()
    assert error(fits[3, 0.0]) < error(start[3]) and error(fits[3, 0.0]) < error(fits[2, 0.0])
    out = selection.mixture_labels(df, start, fits)
    assert out.count() == 90 * 4 and out.groupBy("k").agg(F.max("component")).count() == 2
    with pytest.raises(ValueError):
        selection.fit_mixtures(df.limit(0), start, [0.0])
