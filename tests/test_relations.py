"""Small cases of the transpose, reassignment, rates and given splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from spindrift.operators import factors, linalg, metrics, splits


def test_transpose(spark):
    rows = spark.createDataFrame([(2, [1.0, 2.0]), (1, [3.0, 4.0])], "k int, v array<double>")
    got = {r["place"]: (r["keys"], r["values"]) for r in linalg.transpose(rows, "k", "v").collect()}
    assert got == {0: ([1, 2], [3.0, 1.0]), 1: ([1, 2], [4.0, 2.0])}
    assert linalg.transpose(rows.limit(0), "k", "v").count() == 0


def test_reassignment_is_one_to_one(spark):
    rows = spark.createDataFrame([(0, 7)] * 5 + [(0, 8)] * 4 + [(1, 7)] * 4 + [(2, 8)], "pred int, true int").withColumn("g", F.lit("x"))
    got = {r["pred"]: (r["true"], r["n"]) for r in metrics.reassignment(metrics.contingency(rows, "pred", "true", ["g"]), ["g"]).collect()}
    assert got[0] == (8, 4) and got[1] == (7, 4) and got[2][0] is None


def test_signs_with_zero_and_match_rate(spark):
    rows = spark.createDataFrame([(0, 0), (5, -1), (-3, 2), (1, None)], "p int, t int")
    assert metrics.signum_error(rows.where("t is not null"), "p", "t").first()["error"] == 0.0
    assert metrics.match_rate(rows, "p", "t").first()["rate"] == 1 / 3


def test_given_labels_are_the_source(spark):
    rows = spark.createDataFrame([(i, [None, 1, 2, 3][i % 4]) for i in range(20)], "row_id int, label int")
    got = {(r["label"], r["side"]) for r in splits.split_sides(rows, "label", "given", given=[1, 3]).collect()}
    assert got == {(None, "target"), (1, "source"), (2, "target"), (3, "source")}


def test_factors_are_kept(spark, tmp_path):
    w = np.random.default_rng(0).random((12, 3))
    factors.save_factors(spark, w, str(tmp_path / "w"))
    assert np.array_equal(factors.load_factors(spark, str(tmp_path / "w")), w)
