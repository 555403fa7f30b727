"""Files, splits, mixtures, rejection and scalings against small brute-force versions."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.operators import factors, filters, linalg, metrics, mixtures, splits
from spindrift.plans import comparisons
from spindrift.sources import files


def obs(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "row_id long, features array<double>" + "".join(f", {k} int" for k in more))


def test_results_round_trip(spark, tmp_path):
    rows = [("a", 1, 0.1234567, 'x,"y"'), ("a", 2, None, None), ("b", 3, 2.5, " z")]
    df = spark.createDataFrame(rows, "k string, i int, v double, s string")
    files.write_results(df, str(tmp_path / "full"), ["k"])
    back = files.read_results(spark, str(tmp_path / "full"), "i int, v double, s string, k string")
    assert sorted((r.k, r.i, r.v, r.s and r.s.strip()) for r in back.collect()) == sorted((k, i, v, s and s.strip()) for k, i, v, s in rows)
    files.write_results(df, str(tmp_path / "short"), decimals=2)
    assert {r.v for r in files.read_results(spark, str(tmp_path / "short"), "k string, i int, v double, s string").collect()} == {0.12, None, 2.5}
    with pytest.raises(Exception, match="(?i)header|csv"):
        files.read_results(spark, str(tmp_path / "short"), "k string, other int, v double, s string").collect()


def test_headless_and_many_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part-{i}.tsv").write_text(f"{i}\tx{i}\n{i + 10}\ty\n")
    got = files.read_results(spark, str(tmp_path / "*.tsv"), "a int, b string", sep="\t", header=False)
    assert sorted(r.a for r in got.collect()) == [0, 1, 2, 10, 11, 12]


def test_lines_are_numbered_over_blocks_and_files(spark, tmp_path):
    want = [f"line {i}" * (i % 5) for i in range(900)]
    for k in range(3):
        (tmp_path / f"f{k}.txt").write_text("".join(v + "\n" for v in want[k * 300 : k * 300 + 300]))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = files.numbered_lines(spark, str(tmp_path)).orderBy("line").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert [r.line for r in got] == list(range(900))
    assert [r.value for r in got] == want


def test_matrix_round_trip(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=(40, 4))
    files.write_matrix(obs(spark, x).repartition(5), str(tmp_path / "m"), "row_id")
    got = {(r.line, r.place): r.value for r in files.read_matrix(spark, str(tmp_path / "m")).collect()}
    assert got == {(i, j): x[i, j] for i in range(40) for j in range(4)}


def test_table_line(spark):
    df = spark.createDataFrame([("r", "1", None)], "a string, b string, c string")
    got = df.select(files.table_line([F.col("a"), F.col("b"), F.col("c")], [F.lit(False), F.lit(True), F.lit(True)]).alias("t")).first().t
    assert got == r"r & \textbf{1} & -- \\"


@pytest.mark.parametrize("share", [0.0, 0.1, 0.37, 1.0])
def test_draw_is_exact_and_repeatable(spark, share):
    rows = [(i, None if i % 7 == 0 else i % 3) for i in range(5000)] + [(6000, 9)]
    df = spark.createDataFrame(rows, "row_id long, label int")
    got = splits.draw(df, ["label"], share).collect()
    assert len(got) == len(rows)
    again = {r.row_id for r in splits.draw(df.repartition(7), ["label"], share).where("drawn").collect()}
    assert again == {r.row_id for r in got if r.drawn}
    for label in (None, 0, 1, 2, 9):
        n = sum(r.label == label for r in got)
        assert sum(r.drawn for r in got if r.label == label) == max(1, round(n * share))


def test_split_modes(spark):
    df = spark.createDataFrame([(i, i % 6) for i in range(600)], "row_id long, label int")
    sides = {}
    for mode in ("random", "stratified", "exclusive", "disjoint", "shared"):
        got = splits.split_sides(df, "label", mode, 0.5, 2).collect()
        assert len(got) == 600
        sides[mode] = {s: {r.label for r in got if r.side == s} for s in ("source", "target")}
    shared = {m: len(v["source"] & v["target"]) for m, v in sides.items()}
    assert shared == {"random": 6, "stratified": 6, "exclusive": 4, "disjoint": 0, "shared": 2}
    with pytest.raises(ValueError):
        splits.split_sides(df, "label", "other")
    assert splits.split_sides(df.limit(0), "label", "exclusive").count() == 0


def test_size_grid():
    assert splits.size_grid(1000, 10, 3) == [10, 100, 1000]
    assert splits.size_grid(5) == [5]
    assert len(splits.size_grid(12)) == 3


def two_groups(seed, n, gap, d=5):
    rng = np.random.default_rng(seed)
    z = np.arange(n) % 2
    u = np.ones(d) / np.sqrt(d)
    return rng.normal(size=(n, d)) * 0.5 + np.outer(z * 2 - 1, u) * gap, z * 2 - 1


def test_mixtures_find_the_groups(spark):
    xs, _ = two_groups(0, 400, 1.5)
    xt, zt = two_groups(1, 60, 1.2)
    target = obs(spark, xt, z=[int(v) for v in zt])
    pair = mixtures.source_pair(obs(spark, xs), np.ones(5), 0.25, 8)
    assert (pair[1] - pair[0]).sum() > 0
    for z in (mixtures.shrunk_means(target, pair, 0.25, 0.25, 1.0, 6), mixtures.shrunk_direction(target, pair, 0.25, 0.25, rounds=6)):
        assert target.select((F.col("z") == z).cast("int").alias("hit")).agg(F.avg("hit")).first()[0] > 0.95


def test_logistic_sums(spark):
    x = np.random.default_rng(2).normal(size=(30, 3))
    slope = np.array([1.0, -2.0, 0.5])
    g = 1 / (1 + np.exp(-(x @ slope + 0.3)))
    n, n1, s1, s = factors.logistic_sums(obs(spark, x).repartition(3), slope, 0.3)
    assert n == 30
    np.testing.assert_allclose(n1, g.sum())
    np.testing.assert_allclose(s1, g @ x)
    np.testing.assert_allclose(s, x.sum(0))


def test_alignment_is_exact():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(4, 6)), rng.normal(size=(4, 6))
    first = mixtures.contrast_vectors(a, 0.5)
    order, cost = mixtures.align_groups(b, 0.5, [first])
    scores = {p: mixtures.alignment_score([first, mixtures.contrast_vectors(b[list(p)], 0.5)]) for p in itertools.permutations(range(4))}
    assert cost == pytest.approx(min(scores.values()))
    assert scores[tuple(order)] == pytest.approx(cost)


def test_rejection_and_reconstruction(spark):
    rng = np.random.default_rng(4)
    x, w = rng.random((20, 6)), rng.random((3, 6))
    df = obs(spark, x)
    coded = factors.transfer_coefficients(df, w)
    h = np.stack(coded.orderBy("row_id").toPandas()["h"].to_numpy())
    got = factors.rejection_scores(df, coded, w).orderBy("row_id").toPandas()
    one = np.eye(3)[h.argmax(1)]
    np.testing.assert_allclose(got["square_h"], -((x - h @ w) ** 2).sum(1))
    np.testing.assert_allclose(got["absolute_component"], -np.abs(x - one @ w).sum(1))
    np.testing.assert_allclose(got["gap"], h.max(1) - h.min(1))
    p = h / h.sum(1, keepdims=True)
    e = -(p * np.log(p)).sum(1)
    np.testing.assert_allclose(got["entropy"], -(e - e.min()) / (e.max() - e.min()), atol=1e-9)
    unit = lambda v: (v - v.min()) / (v.max() - v.min())
    np.testing.assert_allclose(got["error"], -(1 - (unit(x.sum(1)) + 1) / 2) * unit(np.abs(x - one @ w).sum(1)), atol=1e-12)
    low = h - h.mean(1, keepdims=True)
    np.testing.assert_allclose(got["kurtosis"], (low**4).mean(1) / (low**2).mean(1) ** 2)
    r = factors.reconstruction(df, coded, w).first()
    np.testing.assert_allclose([r.mean_absolute, r.frobenius], [np.abs(x - h @ w).mean(), np.linalg.norm(x - h @ w) / x.size])


def test_transferability_ranks_factors(spark):
    rng = np.random.default_rng(5)
    w = np.kron(np.eye(3), np.ones(4)) + 0.01
    x = rng.random((60, 3)) ** 3 @ w
    score, p = factors.transferability(obs(spark, x), w, 3, 10)
    assert score > 0.9
    assert p == 0


def test_factors_end_when_they_have_settled(spark):
    rng = np.random.default_rng(12)
    x = obs(spark, rng.random((80, 4)) ** 3 @ rng.random((4, 9)) + 0.05 * rng.random((80, 9))).cache()
    _, errors = factors.fit_factors(x, 4)
    falls = -np.diff(errors) / errors[:-1]
    assert (falls[:-1] > 1e-3).all() and (falls[-1] <= 1e-3 or len(errors) == 100)
    assert len(errors) > 8
    assert len(factors.fit_factors(x, 4, rounds=3)[1]) == 3


def test_quantile_normalise(spark):
    x = np.array([[5.0, 2, 3], [4, 1, 4], [3, 4, 6]])
    got = np.stack([r.features for r in filters.quantile_normalise(obs(spark, x), 3).orderBy("row_id").collect()])
    ref = np.sort(x, 1).mean(0)
    np.testing.assert_allclose(got, [ref[[2, 0, 1]], [ref[1:].mean(), ref[0], ref[1:].mean()], ref])
    assert filters.quantile_normalise(obs(spark, x).limit(0), 3).count() == 0


def test_permutation_error(spark):
    rng = np.random.default_rng(6)
    p, t = rng.integers(0, 3, 80), rng.integers(0, 3, 80)
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(p, t)], "p int, t int")
    want = min(float((np.array(m)[p] != t).mean()) for m in itertools.permutations(range(3)))
    assert metrics.permutation_error(metrics.contingency(df, "p", "t"), 3).first().error == pytest.approx(want)


@pytest.mark.parametrize("name", ["g4_mixtures", "g7_alignment", "n13_rejection", "n15_transferability", "w13_modes", "t7_sizes"])
def test_query_runs(spark, sf, name):
    assert comparisons.QUERIES[name](spark, sf).count() > 0


def test_feature_sums_of_odd_rows(spark):
    rows = [(None, "x", [1.0, 2.0]), (1, None, [3.0, None]), (1, None, None), (1, "x", [float("nan"), 1.0]), (1, "x", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "n int, s string, features array<double>")
    got = {(r[0], r[1]): (r[2], r[3], r[4]) for r in linalg.feature_sums(df, ["n", "s"], F.lit(2), 2).collect()}
    assert got[None, "x"] == (1, 2.0, [2.0, 4.0])
    assert got[1, None] == (2, 4.0, [6.0, 0.0])
    assert np.isnan(got[1, "x"][2][0])
    assert got[1, "x"][2][1] == 4.0
    none = linalg.feature_sums(df.limit(0), [], d=2).collect()
    assert [(r.n, r.s) for r in none] == [(0, [])]
    assert linalg.feature_sums(df.limit(0), ["n"], d=2).count() == 0
