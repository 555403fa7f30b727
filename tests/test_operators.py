"""Matrix, metric and clustering operators against numpy."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spindrift.operators import factors, filters, linalg, metrics, transfer


def obs(spark, x, **more):
    rows = [(i, [float(v) for v in r], *(m[i] for m in more.values())) for i, r in enumerate(x)]
    kinds = "".join(f", {k} {'string' if isinstance(v[0], str) else 'int'}" for k, v in more.items())
    return spark.createDataFrame(rows, f"row_id long, features array<double>{kinds}")


def test_moments_and_centre(spark):
    x = np.random.default_rng(0).normal(size=(60, 5))
    names = ["a"] * 20 + ["b"] * 40
    df = obs(spark, x, dataset=names).repartition(3)
    got = linalg.moment_matrices(df, "dataset")
    for k, part in (("a", x[:20]), ("b", x[20:])):
        m, n = got[k]
        assert n == len(part)
        np.testing.assert_allclose(m, part.T @ part)
    c = linalg.centre(df, ["dataset"]).orderBy("row_id").toPandas()
    np.testing.assert_allclose(np.stack(c["features"]), np.vstack([x[:20] - x[:20].mean(0), x[20:] - x[20:].mean(0)]), atol=1e-12)


def test_uneven_features_are_refused(spark):
    df = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row_id long, features array<double>")
    with pytest.raises(ValueError):
        linalg.dimension(df)


@pytest.mark.parametrize("radius", [1.0, 2.5])
def test_simplex_projection(spark, radius):
    x = np.random.default_rng(1).normal(size=(30, 6))
    x[0] = 0
    x[1] = 3
    got = np.stack(obs(spark, x).select("row_id", linalg.simplex_projection(F.col("features"), radius).alias("p")).orderBy("row_id").toPandas()["p"])
    np.testing.assert_allclose(got.sum(1), radius)
    assert (got >= 0).all()
    # The nearest point: no mixture with a random other point of the simplex is nearer.
    other = np.random.default_rng(2).dirichlet(np.ones(6), size=30) * radius
    for t in (0.01, 0.3):
        assert (((got - x) ** 2).sum(1) <= (((1 - t) * got + t * other - x) ** 2).sum(1) + 1e-9).all()


def test_basis_is_a_projector():
    rng = np.random.default_rng(3)
    v = [rng.normal(size=7) for _ in range(3)]
    q = linalg.subspace_basis([*v, v[0] * 2])
    assert q.shape == (7, 3)
    p = q @ q.T
    np.testing.assert_allclose(p @ p, p, atol=1e-12)
    assert linalg.subspace_basis(v, max_rank=1).shape == (7, 1)


def test_one_hot(spark):
    df = spark.createDataFrame([(0,), (2,), (None,)], "k int")
    got = df.select(linalg.one_hot(F.col("k"), 3).alias("z")).collect()
    assert [r["z"] for r in got] == [[1, 0, 0], [0, 0, 1], [None, None, None]]
    assert [r[0] for r in df.select(linalg.from_one_hot(linalg.one_hot(F.col("k"), 3))).collect()][:2] == [0, 2]


def test_cluster_means_of_an_empty_label_are_zero(spark):
    df = obs(spark, [[1.0, 2.0], [3.0, 4.0]], k=[0, 0])
    got = {r["k"]: (r["n"], list(r["mean"])) for r in linalg.cluster_means(df, "k", 2).collect()}
    assert got == {0: (2, [2.0, 3.0]), 1: (0, [0.0, 0.0])}


def ari(a, b):
    t = pd.crosstab(a, b).to_numpy()
    c2 = lambda v: (v * (v - 1) / 2).sum()
    e = c2(t.sum(0)) * c2(t.sum(1)) / c2(np.array([t.sum()]))
    return (c2(t) - e) / ((c2(t.sum(0)) + c2(t.sum(1))) / 2 - e)


def test_metrics(spark):
    rng = np.random.default_rng(4)
    true = rng.integers(0, 4, 200)
    pred = np.where(rng.random(200) < 0.7, (true + 1) % 4, rng.integers(0, 5, 200))
    df = spark.createDataFrame([("r", int(p), int(t)) for p, t in zip(pred, true)], "run string, p int, t int")
    table = metrics.contingency(df, "p", "t", ["run"])
    assert metrics.adjusted_rand(table, ["run"]).first()["ari"] == pytest.approx(ari(pred, true))
    m = np.zeros((5, 5))
    np.add.at(m, (pred, true), 1)
    best = max(sum(m[i, s[i]] for i in range(5)) for s in itertools.permutations(range(5)))
    assert metrics.matched_accuracy(table, ["run"]).first()["accuracy"] == pytest.approx(best / 200)
    same = metrics.contingency(df.withColumn("p", (F.col("t") + 3) % 4), "p", "t", ["run"])
    assert metrics.adjusted_rand(same, ["run"]).first()["ari"] == pytest.approx(1)
    v = metrics.v_measure(same, ["run"]).first()
    assert v["homogeneity"] == pytest.approx(1) and v["v_measure"] == pytest.approx(1)


@pytest.mark.parametrize("n", [1, 2, 4, 6])
def test_assignment_is_best(n):
    rng = np.random.default_rng(n)
    for _ in range(20):
        g = rng.integers(0, 10, (n, n)).astype(float)
        got = g[np.arange(n), metrics.assign_labels(g)].sum()
        assert got == max(sum(g[i, s[i]] for i in range(n)) for s in itertools.permutations(range(n)))


def test_contrast_error(spark):
    rng = np.random.default_rng(5)
    true, pred = rng.integers(0, 3, 80), rng.integers(0, 3, 80)
    df = spark.createDataFrame([(int(p), int(t)) for p, t in zip(pred, true)], "p int, t int")
    keep = true != 2
    want = min(np.mean(np.array(f)[pred[keep]] != true[keep]) for f in itertools.product([0, 1], repeat=3))
    assert metrics.contrast_error(metrics.contingency(df, "p", "t"), 0, 1).first()["error"] == pytest.approx(want)


def two_groups(rng, n, theta, noise=1.0):
    z = rng.choice([-1, 1], n)
    return z, z[:, None] * theta + noise * rng.normal(size=(n, len(theta)))


def setup(spark, n_t, n_s, d, strong=False):
    rng = np.random.default_rng(7)
    u = rng.normal(size=d)
    u /= np.linalg.norm(u)
    zt, xt = two_groups(rng, n_t, (4.0 if strong else 0.8) * u)
    zs, xs = two_groups(rng, n_s, 4.0 * u)
    rows = [("target", i, x.tolist(), int(z)) for i, (z, x) in enumerate(zip(zt, xt))] + [("source", 10**6 + i, x.tolist(), int(z)) for i, (z, x) in enumerate(zip(zs, xs))]
    return spark.createDataFrame(rows, "dataset string, row_id long, features array<double>, z int").repartition(4).cache(), xt


def error(side, z):
    r = side.rows.select(z.alias("p"), "z")
    return metrics.sign_error(r, "p", "z").first()["error"]


def test_spectral_signs_are_those_of_the_hollow_gram(spark):
    df, x = setup(spark, 60, 40, 10, strong=True)
    t = transfer.sides(df)["target"]
    got = np.array([r[0] for r in t.rows.orderBy("row_id").select(transfer.target_only(t)).collect()])
    b = x @ x.T
    np.fill_diagonal(b, 0)
    z = np.where(np.linalg.eigh(b)[1][:, -1] < 0, -1, 1)
    start = np.where(x @ transfer.hollow_start(t) < 0, -1, 1)
    assert (start == z).all() or (start == -z).all()
    for _ in range(math.floor(3 * math.log(len(x)))):
        z = np.where(b @ z < 0, -1, 1)
    assert (got == z).all() or (got == -z).all()


def test_datasets_share_their_passes(spark):
    df, _ = setup(spark, 60, 90, 10, strong=True)
    found = transfer.sides(df)
    rows = df.select("dataset", "row_id", "features", transfer.spectral_signs_all(df, found).alias("z_all")).cache()
    for name, side in found.items():
        alone = {r["row_id"]: r["z"] for r in side.rows.select("row_id", transfer.spectral_signs(side).alias("z")).collect()}
        shared = {r["row_id"]: r["z_all"] for r in rows.where(F.col("dataset") == name).collect()}
        assert shared == alone


def test_sources_help_a_weak_target(spark):
    df, _ = setup(spark, 80, 600, 30)
    found = transfer.sides(df)
    t, s = found["target"], [found["source"]]
    own, from_source = error(t, transfer.target_only(t)), error(t, transfer.source_based(t, s))
    assert from_source < own and from_source < 0.3
    z, branch, _ = transfer.adaptive(t, s)
    assert branch in ("target", "source")
    assert error(t, z) == (own if branch == "target" else from_source)
    with pytest.raises(ValueError):
        transfer.source_based(t, [])


@pytest.mark.parametrize("method", transfer.AssistedClustering.METHODS)
def test_strong_targets_are_recovered(spark, method):
    df, _ = setup(spark, 80, 120, 20, strong=True)
    model = transfer.AssistedClustering(2, method)
    out = model.fit_predict(df, "target", ["source"]).join(df, "row_id")
    assert metrics.sign_error(out, "label", "z").first()["error"] < 0.05
    if method == "adaptive":
        assert model.branch_ == "target"


@pytest.mark.parametrize("method", ["adaptive", "source", "pooled", "raw_pooled"])
def test_three_groups(spark, method):
    rng = np.random.default_rng(8)
    means = 6 * np.linalg.qr(rng.normal(size=(8, 3)))[0].T
    rows = []
    for name, n, off in (("target", 90, 0), ("source", 150, 1000)):
        k = rng.integers(0, 3, n)
        rows += [(name, off + i, (means[c] + rng.normal(size=8)).tolist(), int(c)) for i, c in enumerate(k)]
    df = spark.createDataFrame(rows, "dataset string, row_id long, features array<double>, k int").cache()
    out = transfer.AssistedClustering(3, method).fit_predict(df, "target", ["source"]).join(df, "row_id").withColumn("run", F.lit("x"))
    assert metrics.scores(out, "label", "k", ["run"]).first()["accuracy"] > 0.9


def test_estimated_means_follow_the_shape(spark):
    rng = np.random.default_rng(17)
    tall, wide = rng.normal(size=(40, 6)), rng.normal(size=(5, 6))
    rows = [("tall", i, r.tolist()) for i, r in enumerate(tall)] + [("wide", 100 + i, r.tolist()) for i, r in enumerate(wide)]
    df = spark.createDataFrame(rows, "dataset string, row_id long, features array<double>")
    found = transfer.sides(df)
    a, b = transfer.estimated_means(df, [found["tall"], found["wide"]], 2)
    top = np.linalg.svd(tall, full_matrices=False)[2][:2]
    assert np.abs(np.abs((a * top).sum(1)) - 1).max() < 1e-8
    # Means of the wide dataset's groups are averages of its rows.
    assert np.linalg.matrix_rank(np.vstack([wide, b])) == 5


def test_given_noise_and_own_methods(spark):
    df, _ = setup(spark, 80, 120, 20, strong=True)
    found = transfer.sides(df)
    t, s = found["target"], [found["source"]]
    assert transfer.adaptive(t, s, sigma2=1e9)[1] == "source" and transfer.adaptive(t, s, sigma2=1e-9)[1] == "target"
    model = transfer.AssistedClustering(2, lambda target, sources, k: transfer.target_only(target))
    assert model.fit_predict(df, "target", ["source"]).count() == t.n


def test_plans_do_not_grow_with_the_features(spark):
    """2,000 features: the vectors travel as data or as one constant, not as one literal per feature."""
    rng = np.random.default_rng(18)
    v = rng.normal(size=2000)
    df = obs(spark, rng.normal(size=(20, 2000)))
    got = linalg.project(df, np.column_stack([v, v]))
    assert got._jdf.queryExecution().analyzed().toString().count("cast(") <= 4
    x = np.array([r["features"] for r in df.orderBy("row_id").collect()])
    assert np.allclose([r["projected"][0] for r in got.orderBy("row_id").collect()], x @ v)


def test_bad_arguments():
    with pytest.raises(ValueError):
        transfer.AssistedClustering(1)
    with pytest.raises(ValueError):
        transfer.AssistedClustering(2, "none")


def test_factors_reduce_the_error(spark):
    rng = np.random.default_rng(9)
    x = rng.random((120, 3)) @ rng.random((3, 10))
    df = obs(spark, x).cache()
    w, errors = factors.fit_factors(df, 3, rounds=6)
    assert errors[-1] < errors[0] and (w >= 0).all()
    coded = factors.transfer_coefficients(df, w)
    assert coded.agg(F.avg("error")).first()[0] < 0.05
    same = factors.mixed(df, coded, w, 0.0).orderBy("row_id").toPandas()
    np.testing.assert_allclose(np.stack(same["features"]), x)


def test_em_finds_two_groups(spark):
    rng = np.random.default_rng(10)
    z, x = two_groups(rng, 200, np.full(6, 1.0), 0.5)
    df = obs(spark, x, z=z.tolist()).cache()
    mu0, mu1, pi1 = factors.spherical_em(df, (x[0], x[np.argmax(z != z[0])]), 0.25, 15)
    assert abs(pi1 - np.mean(z != z[0])) < 0.1
    assert np.linalg.norm(mu0 + mu1) < 0.5


def test_filters_of_the_small_matrix(spark):
    m = [[1, 2, 0, 0, 0], [0, 0, 10, 11, 0], [0, 0, 0, 0, 0]]
    rows = [(f"c{j}", f"g{i}", float(v)) for i, r in enumerate(m) for j, v in enumerate(r)]
    df = spark.createDataFrame(rows, "cell string, gene string, value double")
    assert sorted(r[0] for r in filters.cell_filter(df, 1, 1.0).collect()) == ["c0", "c1", "c2", "c3"]
    assert sorted(r[0] for r in filters.gene_filter(df, 0.96, 1.0).collect()) == ["g0", "g1"]
    out = filters.preprocess(df, [filters.cell_filter(df, 1, 1.0)], [filters.gene_filter(df, 0.96, 1.0)], lambda v: v)
    assert out.count() == 8


def test_matching_ids_follow_the_target(spark):
    s = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "gene string, o int")
    t = spark.createDataFrame([("b", 5), ("c", 6), ("a", 7), ("b", 8)], "gene string, o int")
    got = [(r["gene"], r["place"]) for r in filters.matching_ids(s, t, "gene", "o").orderBy("place").collect()]
    assert got == [("b", 0), ("a", 1)]


def test_all_groups_of_every_target_are_scored(spark):
    rng = np.random.default_rng(11)
    means = 8 * np.linalg.qr(rng.normal(size=(12, 12)))[0][:9]
    rows = []
    for b, name in enumerate(("a", "b", "c")):
        for i in range(270):
            # The last group has 1 row in 90 only.
            k = int(rng.integers(0, 8)) if i % 90 else 8
            rows.append((name, b * 1000 + i, (means[k] + 0.3 * rng.normal(size=12)).tolist(), k))
    df = spark.createDataFrame(rows, "dataset string, row_id long, features array<double>, label int").repartition(3).cache()
    found = transfer.sides(df)
    methods = ("adaptive", "target", "source", "pooled", "pooled_std")
    out = transfer.compare_groups(df, found, {n: [o for o in found if o != n] for n in found}, 9, methods, "label").cache()
    assert out.groupBy("target", "method").count().where("count = 270").count() == 3 * len(methods)
    assert {r["label"] for r in out.select("label").distinct().collect()} == set(range(9))
    got = metrics.scores(out, "k", "label", ["target", "method"]).collect()
    assert len(got) == 3 * len(methods) and min(r["accuracy"] for r in got) > 0.95
    # The shared passes give what each method gives by itself.
    one = transfer.AssistedClustering(9, "pooled").labels(found["a"], [found["b"], found["c"]])
    alone = metrics.scores(found["a"].rows.select(F.lit("x").alias("run"), "label", one.alias("k")), "k", "label", ["run"]).first()
    assert alone["ari"] == pytest.approx(next(r["ari"] for r in got if (r["target"], r["method"]) == ("a", "pooled")))


def test_batches_and_methods_keep_all_labelled_cells(spark, sf):
    from spindrift.plans import matrix

    cells = matrix.observations(spark, sf).where("label is not null").cache()
    got = matrix.t6_batches(spark, sf).collect()
    assert {r["method"] for r in got} == {"target", "source", "pooled", "adaptive"}
    # A label may lie in cells without a batch only.
    assert min(r["n_labels"] for r in got) >= 0.9 * cells.select("label").distinct().count()
    assert sum(r["n_target"] for r in got if r["method"] == "target") > 0.9 * cells.count()
    assert matrix.m_methods(spark, sf).count() == 6
