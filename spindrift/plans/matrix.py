"""Queries of the matrix, clustering and metric operators over the cells' vectors."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import name_key
from spindrift.operators import factors, linalg, metrics, splits, transfer
from spindrift.operators.linalg import dot, feature_sums
from spindrift.session import cut, read_table

DIM = 64


def _usable(raw: DataFrame) -> DataFrame:
    raw = raw.where(F.size("express") == DIM)
    return raw.where(F.forall("express", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("express", lambda x: x > 0))


def scaled_rows(raw: DataFrame) -> DataFrame:
    """(dataset, row_id, label, features): rows of gene_data_set with a usable vector, divided by their largest value."""
    top = F.array_max("express").cast("double")
    return _usable(raw).select("dataset", F.col("cell_id").alias("row_id"), "label", F.transform("express", lambda x: x.cast("double") / top).alias("features"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of all cells, each once."""
    raw = _usable(read_table(spark, sf_dir, "gene_data_set"))
    once = raw.groupBy("cell_id").agg(F.min("dataset").alias("dataset"), F.min("label").alias("label"), F.min("express").alias("express"))
    return scaled_rows(once)


def l2_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linalg.moments(observations(spark, sf_dir), "dataset").select("dataset", "i", "j", F.round("v", 5).alias("v"), "n")


def label_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = feature_sums(observations(spark, sf_dir).where("label is not null"), ["label"], d=DIM)
    return sums.select("label", "n", F.transform("s", lambda x: x / F.col("n")).alias("mean"))


def l11_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = linalg.cluster_means(observations(spark, sf_dir).where("label is not null"), "label", 130)
    return means.select("k", "n", F.posexplode("mean").alias("feature", "mean")).select("k", "n", "feature", F.round("mean", 8).alias("mean"))


def l1_hollow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inner products of the labels' means, without the diagonal."""
    gram = linalg.gram_of_means(cut(label_means(spark, sf_dir), "means"), "label", "mean")
    return linalg.hollow(gram).select("i", "j", F.round("v", 8).alias("v"))


def l9_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates on three orthonormal directions."""
    q = np.zeros((DIM, 3))
    for c in range(3):
        q[2 * c, c], q[2 * c + 1, c] = math.sqrt(0.5), -math.sqrt(0.5)
    rows = linalg.project(observations(spark, sf_dir), q)
    return rows.select("row_id", *[F.round(F.col("projected")[c], 8).alias(f"p{c}") for c in range(3)])


def l10_one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).where("label is not null").select(linalg.one_hot(F.col("label") % 5, 5).alias("z"))
    return rows.groupBy(linalg.from_one_hot(F.col("z")).alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.aggregate("z", F.lit(0), lambda s, x: s + x)).alias("ones"))


def l12_simplex(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select("row_id", linalg.simplex_projection(F.col("features")).alias("x"))
    return rows.select("row_id", F.size(F.filter("x", lambda v: v > 0)).alias("n_positive"), F.round(F.array_max("x"), 8).alias("largest"), F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 8).alias("total"))


def l14_centre(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linalg.centre(observations(spark, sf_dir), ["dataset"])
    return rows.select("row_id", *[F.round(F.col("features")[i], 8).alias(f"x{i}") for i in range(3)], F.round(dot(F.col("features"), F.col("features")), 7).alias("length2"))


def l15_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deviation of the projections on the mean direction, per dataset: what a direction is divided by."""
    obs = cut(observations(spark, sf_dir), "obs")
    total = feature_sums(obs, ["dataset"], d=DIM).select("dataset", "s")
    even = np.full(DIM, 1 / math.sqrt(DIM))

    def scaled(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((DIM, DIM))
        m[pdf["i"], pdf["j"]] = m[pdf["j"], pdf["i"]] = pdf["v"]
        scale = np.linalg.norm(linalg.std_scale(even, m, np.array(pdf["s"].iloc[0]), int(pdf["n"].iloc[0])))
        return pd.DataFrame({"dataset": [key[0]], "std": [1 / scale], "scale": [scale]})

    got = linalg.moments(obs, "dataset").join(total, "dataset").groupBy("dataset").applyInPandas(scaled, "dataset string, std double, scale double")
    return got.select("dataset", F.round("std", 8).alias("std"), F.round("scale", 7).alias("scale"))


def s1_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic of signs from the label's parity, with its threshold."""
    rows = observations(spark, sf_dir).where("label is not null")
    s = feature_sums(rows, ["dataset"], F.when(F.col("label") % 2 == 0, 1.0).otherwise(-1.0), DIM)
    s2, n = 0.05, F.col("n")
    return s.select(
        "dataset",
        F.round(transfer.sum_statistic(F.col("s"), n, DIM, s2), 9).alias("statistic"),
        F.round(transfer.validation_threshold(s2, DIM, n), 9).alias("threshold"),
        F.round(transfer.recovery_threshold(DIM, n, s2), 9).alias("recovery"),
    )


def s4_statistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistic of four groups of labels per dataset, with its threshold."""
    s2, k = 0.05, 4
    rows = observations(spark, sf_dir).where("label is not null").withColumn("k", F.col("label") % k)
    means = feature_sums(rows, ["dataset", "k"], d=DIM).select("dataset", "k", "n", F.transform("s", lambda x: x / F.col("n")).alias("mean"))

    def told(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m, n = np.stack(pdf["mean"].to_numpy()), pdf["n"].to_numpy(float)
        return pd.DataFrame({"dataset": [key[0]], "statistic": [transfer.validation_statistic_groups(m, n, s2)], "threshold": [transfer.validation_threshold_groups(s2, DIM, k, int(n.sum()))]})

    got = means.groupBy("dataset").applyInPandas(told, "dataset string, statistic double, threshold double")
    return got.select("dataset", F.round("statistic", 9).alias("statistic"), F.round("threshold", 9).alias("threshold"))


def _parity_means(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = observations(spark, sf_dir).where("label is not null")
    got = feature_sums(rows, [(F.col("label") % 4).alias("k")], d=DIM).collect()
    return rows, {r["k"]: np.array(r["s"]) / r["n"] for r in got}


def g2_responsibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability of the second of two groups, per dataset and true parity."""
    rows, m = _parity_means(spark, sf_dir)
    g = factors.responsibility(m[0], m[1], 0.4, 0.05)
    return rows.groupBy("dataset", (F.col("label") % 4).alias("part")).agg(F.round(F.avg(g), 6).alias("mean_g"), F.count_if(g > 0.5).alias("n_second"))


def g3_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per group and label after ten steps of two-group EM started from two label means."""
    rows, m = _parity_means(spark, sf_dir)
    rows = cut(rows, "obs")
    mu0, mu1, pi1 = factors.spherical_em(rows, (m[0], m[1]), 0.02, 10)
    return rows.groupBy("label").agg(F.count_if(factors.responsibility(mu0, mu1, pi1, 0.02) > 0.5).alias("n_second"), F.count(F.lit(1)).alias("n"))


def x5_soft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft weights against four centres and their sharpened form, summed per centre."""
    rows, m = _parity_means(spark, sf_dir)
    q = rows.select("row_id", factors.soft_assignment(np.stack([m[i] for i in range(4)])).alias("q"))
    both = q.join(factors.sharpened(q, 4), "row_id")
    sums = both.select(F.posexplode(F.arrays_zip("q", "p")).alias("k", "w")).groupBy("k").agg(F.round(F.sum("w.q"), 6).alias("sum_q"), F.round(F.sum("w.p"), 6).alias("sum_p"), F.round(F.max("w.p"), 7).alias("max_p"))
    return sums


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell, batch, pred, true): registered cluster and label of each cell."""
    meta = read_table(spark, sf_dir, "cell_meta").where("deleted_at is null").groupBy(name_key(F.col("barcode")).alias("cell")).agg(F.min("assigned_cluster").alias("pred"), F.min("batch").alias("batch"))
    data = read_table(spark, sf_dir, "gene_data_set").groupBy(name_key(F.col("sample")).alias("cell")).agg(F.min("label").alias("true"))
    return meta.join(data, "cell").where(F.col("pred").isNotNull() & F.col("true").isNotNull() & F.col("batch").isNotNull())


def q6_rand(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.contingency(labelled(spark, sf_dir), "pred", "true", ["batch"])
    return metrics.adjusted_rand(table, ["batch"]).select("batch", F.round("ari", 9).alias("ari"))


def q7_v(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.contingency(labelled(spark, sf_dir), "pred", "true", ["batch"])
    return metrics.v_measure(table, ["batch"]).select("batch", *[F.round(c, 9).alias(c) for c in ("homogeneity", "completeness", "v_measure")])


def q1_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = lambda c: F.when(F.col(c) % 2 == 0, 1).otherwise(-1)
    rows = labelled(spark, sf_dir).select("batch", sign("pred").alias("p"), sign("true").alias("t"))
    return metrics.sign_error(rows, "p", "t", ["batch"]).select("batch", F.round("error", 9).alias("error"))


def q4_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of telling the labels 0 mod 3 from 1 mod 3 by the clusters."""
    rows = labelled(spark, sf_dir).withColumn("part", F.col("true") % 3)
    table = metrics.contingency(rows, "pred", "part", ["batch"])
    return metrics.contrast_error(table, 0, 1, ["batch"]).select("batch", F.round("error", 9).alias("error"))


def q5_matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, Rand index and V-measure of all batches at once."""
    return metrics.scores(labelled(spark, sf_dir), "pred", "true", ["batch"])


def q10_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.confusion(metrics.contingency(labelled(spark, sf_dir), "pred", "true"))
    return table.select("pred", "true", "n", F.round("share", 9).alias("share"))


def q11_silhouette(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silhouette against the labels' means instead of all pairs: (b - a) / max(a, b), averaged per label."""
    rows = observations(spark, sf_dir).where("label is not null")
    means = {r["label"]: np.array(r["s"]) / r["n"] for r in feature_sums(rows, ["label"], d=DIM).orderBy("label").collect()}
    x = F.col("features")
    away = F.array(*[F.struct(F.sqrt(F.greatest(F.lit(0.0), dot(x, x) - 2 * dot(x, linalg.literal_vector(m)) + float(m @ m))).alias("d"), F.lit(k).alias("k")) for k, m in means.items()])
    far = rows.select("label", away.alias("away")).select(
        "label", F.array_min(F.transform(F.filter("away", lambda v: v["k"] == F.col("label")), lambda v: v["d"])).alias("a"), F.array_min(F.transform(F.filter("away", lambda v: v["k"] != F.col("label")), lambda v: v["d"])).alias("b")
    )
    return far.groupBy("label").agg(F.round(F.avg((F.col("b") - F.col("a")) / F.greatest("a", "b")), 6).alias("silhouette"), F.count(F.lit(1)).alias("n"))


def q15_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centred and normalised kernels of the labels' means against the kernel of their parity."""
    means = cut(label_means(spark, sf_dir), "means")
    gram = linalg.gram_of_means(means, "label", "mean")
    parity = gram.select("i", "j", F.when((F.col("i") - F.col("j")) % 2 == 0, 1.0).otherwise(-1.0).alias("v"))
    out = []
    for name, kernel in (("linear", gram), ("rbf", linalg.rbf_kernel(gram, 2.0))):
        ready = linalg.normalise_kernel(linalg.centre_kernel(kernel))
        out.append(linalg.kernel_alignment(ready, parity).select(F.lit(name).alias("kernel"), F.round("alignment", 7).alias("alignment")))
    return out[0].unionByName(out[1])


def q17_separation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = labelled(spark, sf_dir).withColumn("part", F.col("true") % 10)
    return metrics.label_separation(rows, "part", "pred", ["batch"])


def c3_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Euclidean distance, 1 - Pearson and 1 - Spearman between the labels' means."""
    pairs = linalg.pair_distances(label_means(spark, sf_dir), "label", "mean")
    return pairs.select("i", "j", *[F.round(c, 7).alias(c) for c in ("euclidean", "pearson", "spearman")])


def c6_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of batches in which two labels have the same most frequent cluster."""
    counts = labelled(spark, sf_dir).groupBy("batch", "true", "pred").agg(F.count(F.lit(1)).alias("n"))
    top = cut(counts.groupBy("batch", "true").agg(F.min_by("pred", F.struct(-F.col("n"), F.col("pred"))).alias("top")), "top")
    n = top.select("batch").distinct().count()
    a, b = top.toDF("batch", "i", "top"), top.toDF("batch", "j", "top")
    return a.join(b, ["batch", "top"]).where("i < j").groupBy("i", "j").agg(F.round(F.count(F.lit(1)) / F.lit(float(n)), 9).alias("consensus"))


def n6_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors learnt from the source cells, carried over to the target: component, share and error per label."""
    obs = cut(observations(spark, sf_dir), "obs")
    source, target = obs.where("dataset = 'source'"), obs.where("dataset = 'target'")
    w, _ = factors.fit_factors(source, 8)
    coded = factors.transfer_coefficients(target, w)
    return coded.join(target.select("row_id", "label"), "row_id").groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("error"), 6).alias("error"))


def n11_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spread of the target's vectors before and after half of each is taken from its component's factor."""
    obs = cut(observations(spark, sf_dir), "obs")
    source, target = obs.where("dataset = 'source'"), obs.where("dataset = 'target'")
    w, _ = factors.fit_factors(source, 8)
    out = []
    for mix in (0.0, 0.5):
        m = factors.mixed(target, factors.transfer_coefficients(target, w), w, mix)
        out.append(m.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(dot(F.col("features"), F.col("features"))), 6).alias("length2")).withColumn("mix", F.lit(mix)))
    return out[0].unionByName(out[1])


def contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two most frequent labels as a contrast z = -1, 1, centred per dataset."""
    obs = cut(observations(spark, sf_dir), "obs")
    two = [r["label"] for r in obs.where("label is not null").groupBy("label").count().orderBy(F.desc("count"), "label").limit(2).collect()]
    rows = obs.where(F.col("label").isin(two)).withColumn("z", F.when(F.col("label") == two[0], 1).otherwise(-1))
    return cut(linalg.centre(rows, ["dataset"]), "contrast")


def e_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error, Rand index and V-measure of every two-group method on the target's contrast."""
    rows = contrast(spark, sf_dir)
    found = transfer.sides(rows)
    target, sources = found["target"], [found["source"]]
    out = None
    for method in transfer.AssistedClustering.METHODS:
        z = transfer.AssistedClustering(2, method).labels(target, sources)
        one = target.rows.select(F.lit(method).alias("method"), "z", z.alias("z_hat"))
        out = one if out is None else out.unionByName(one)
    table = metrics.contingency(out, "z_hat", "z", ["method"])
    error = metrics.sign_error(out, "z_hat", "z", ["method"])
    size = out.groupBy("method").agg(F.count(F.lit(1)).alias("n_target"))
    scores = metrics.adjusted_rand(table, ["method"]).join(metrics.v_measure(table, ["method"]), "method")
    return error.join(scores, "method").join(size, "method").select("method", "n_target", F.lit(len(sources)).alias("n_sources"), F.lit(DIM).alias("d"), "error", "ari", "v_measure")


def m_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for all labels as groups: every labelled cell of the target, under every method for more than two groups."""
    rows = cut(linalg.centre(observations(spark, sf_dir).where("label is not null"), ["dataset"]), "groups")
    k = rows.select("label").distinct().count()
    methods = ("adaptive", "target", "source", "pooled", "pooled_std")
    found = transfer.sides(rows)
    out = transfer.compare_groups(rows, found, {"target": ["source"]}, k, methods, "label")
    target = found["target"]
    raw = transfer.AssistedClustering(k, "raw_pooled").labels(target, [found["source"]])
    out = out.unionByName(target.rows.select(F.lit("target").alias("target"), F.lit("raw_pooled").alias("method"), "label", raw.alias("k")))
    return metrics.scores(out, "k", "label", ["method"])


def t6_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave one batch out: each batch as target with all others as sources, all labels as groups, scores per method.

    Statistics and means of a batch are found once and serve every target.
    """
    batch = read_table(spark, sf_dir, "cell_meta").where("batch is not null").groupBy(name_key(F.col("barcode")).alias("cell")).agg(F.min("batch").alias("batch"))
    cell = read_table(spark, sf_dir, "gene_data_set").groupBy(F.col("cell_id").alias("row_id")).agg(F.min(name_key(F.col("sample"))).alias("cell"))
    by_batch = observations(spark, sf_dir).where("label is not null").drop("dataset").join(cell, "row_id").join(batch, "cell").select(F.col("batch").alias("dataset"), "row_id", "features", "label")
    rows = cut(linalg.centre(cut(by_batch, "by_batch"), ["dataset"]), "batches")
    k = rows.select("label").distinct().count()
    found = transfer.sides(rows)
    names = sorted(n for n, s in found.items() if s.n > 1)
    targets = {n: [o for o in names if o != n] for n in names} if len(names) > 1 else {}
    out = transfer.compare_groups(rows, found, targets, k, ("target", "source", "pooled", "adaptive"), "label")
    scores = metrics.scores(out, "k", "label", ["target", "method"])
    size = out.groupBy("target", "method").agg(F.count(F.lit(1)).alias("n_target"))
    return scores.join(size, ["target", "method"]).select("target", "method", "n_target", F.lit(k).alias("n_labels"), (1 - F.col("accuracy")).alias("misclustering"), "ari", "v_measure")


def w5_subsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a tenth of each label, at least one, drawn by a hash without replacement."""
    rows = observations(spark, sf_dir).where("label is not null").select("dataset", "label", "row_id")
    kept = splits.draw(rows, ["dataset", "label"], 0.1).where("drawn")
    return kept.groupBy("dataset", "label").agg(F.count(F.lit(1)).alias("n_drawn"))


QUERIES = {
    "l1_hollow": l1_hollow,
    "l2_moments": l2_moments,
    "l9_project": l9_project,
    "l10_one_hot": l10_one_hot,
    "l11_means": l11_means,
    "l12_simplex": l12_simplex,
    "l14_centre": l14_centre,
    "l15_std": l15_std,
    "s1_statistic": s1_statistic,
    "s4_statistic": s4_statistic,
    "g2_responsibility": g2_responsibility,
    "g3_em": g3_em,
    "x5_soft": x5_soft,
    "q1_sign": q1_sign,
    "q4_contrast": q4_contrast,
    "q5_matched": q5_matched,
    "q6_rand": q6_rand,
    "q7_v": q7_v,
    "q10_confusion": q10_confusion,
    "q11_silhouette": q11_silhouette,
    "q15_alignment": q15_alignment,
    "q17_separation": q17_separation,
    "c3_distances": c3_distances,
    "c6_consensus": c6_consensus,
    "n6_factors": n6_factors,
    "n11_mixed": n11_mixed,
    "e_methods": e_methods,
    "m_methods": m_methods,
    "t6_batches": t6_batches,
    "w5_subsample": w5_subsample,
}

_OBS = """
with raw as (
  select cell_id as row_id, min(dataset) as dataset, min(label) as label, min(express) as e
  from gene_data_set
  where len(express) = 64 and len(list_filter(express, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(express, lambda x: x > 0)) > 0
  group by cell_id),
top as (select *, list_max(e)::double as m from raw),
obs as (select row_id, dataset, label, list_transform(e, lambda x: x::double / m) as f from top)
"""

_EACH = _OBS + ", each as (select row_id, dataset, label, unnest(f) as x, generate_subscripts(f, 1) - 1 as i from obs)"

_MEANS = _EACH + ", m as (select label, i, avg(x) as x from each where label is not null group by all)"

_LABELLED = r"""
with meta as (select lower(regexp_replace(barcode, '^\s+|\s+$', '', 'g')) as cell, min(assigned_cluster) as pred, min(batch) as batch from cell_meta where deleted_at is null group by 1),
data as (select lower(regexp_replace(sample, '^\s+|\s+$', '', 'g')) as cell, min(label) as "true" from gene_data_set group by 1),
l as (select * from meta join data using (cell) where pred is not null and "true" is not null and batch is not null),
t as (select batch, pred, "true", count(*) as n from l group by all)
"""

SQL = {
    "l2_moments": _EACH + "select a.dataset, a.i::int as i, b.i::int as j, round(sum(a.x * b.x), 5) as v, count(*) as n from each a join each b on a.row_id = b.row_id and a.i <= b.i group by all",
    "l1_hollow": _MEANS + "select a.label as i, b.label as j, round(sum(a.x * b.x), 8) as v from m a join m b on a.i = b.i where a.label <> b.label group by all",
    "l9_project": _OBS + "select row_id, " + ", ".join(f"round((f[{2 * c + 1}] - f[{2 * c + 2}]) * sqrt(0.5), 8) as p{c}" for c in range(3)) + " from obs",
    "l10_one_hot": _OBS + "select (label % 5)::int as k, count(*) as n, count(*) as ones from obs where label is not null group by 1",
    "l11_means": _EACH
    + ", g as (select label, i, avg(x) as x, count(*) as n from each where label is not null group by all), k as (select unnest(range(130))::int as k), f as (select unnest(range(64))::int as feature) "
    "select k, coalesce(n, 0) as n, feature, round(coalesce(x, 0), 8) as mean from k cross join f left join g on g.label = k and g.i = feature",
    "l12_simplex": _EACH
    + ", s as (select row_id, x, row_number() over w as r, sum(x) over w as c from each window w as (partition by row_id order by x desc rows unbounded preceding)), "
    "t as (select row_id, arg_max((c - 1) / r, r) as t from s where x > (c - 1) / r group by row_id), "
    "p as (select row_id, greatest(x - t, 0) as y from each join t using (row_id)) "
    "select row_id, count(*) filter (y > 0)::int as n_positive, round(max(y), 8) as largest, round(sum(y), 8) as total from p group by row_id",
    "l14_centre": _EACH
    + ", c as (select row_id, i, x - avg(x) over (partition by dataset, i) as x from each) select row_id, "
    + ", ".join(f"round(max(x) filter (i = {i}), 8) as x{i}" for i in range(3))
    + ", round(sum(x * x), 7) as length2 from c group by row_id",
    "l15_std": _OBS + "select dataset, round(stddev_pop(list_sum(f) / 8), 8) as std, round(1 / stddev_pop(list_sum(f) / 8), 7) as scale from obs group by dataset",
    "s1_statistic": _EACH
    + ", g as (select dataset, i, avg(case when label % 2 = 0 then x else -x end) as x, count(*) as n from each where label is not null group by all) "
    "select dataset, round(sum(x * x) - 64 * 0.05 / max(n), 9) as statistic, round(0.05 * (1 + sqrt(64.0 / max(n))), 9) as threshold, round(greatest(1.0, pow(64.0 / max(n), 0.25)) * sqrt(0.05), 9) as recovery from g group by dataset",
    "s4_statistic": _EACH
    + ", g as (select dataset, label % 4 as k, i, avg(x) as x, count(*) as n from each where label is not null group by all), tot as (select dataset, sum(n) / 64 as n from g group by 1), "
    "p as (select a.dataset, sum(a.n * b.n * (a.x - b.x) ** 2) as g from g a join g b on a.dataset = b.dataset and a.i = b.i and a.k <> b.k group by 1) "
    "select dataset, round(g / (2 * n * n) - 0.05 * 64 * 3 / n, 9) as statistic, round(4 * 0.05 * (sqrt(256 / n) + 1), 9) as threshold from p join tot using (dataset)",
    "g2_responsibility": _EACH
    + ", g as (select label % 4 as k, i, avg(x) as x from each where label is not null group by all), "
    "w as (select a.i, (b.x - a.x) / 0.05 as w, b.x * b.x - a.x * a.x as q from g a join g b on a.i = b.i and a.k = 0 and b.k = 1), "
    "c as (select ln(0.4 / 0.6) - sum(q) / 0.1 as c from w), "
    "r as (select dataset, label % 4 as part, row_id, 1 / (1 + exp(-(sum(x * w) + any_value(c)))) as g from each join w using (i), c where label is not null group by all) "
    "select dataset, part, round(avg(g), 6) as mean_g, count(*) filter (g > 0.5) as n_second from r group by all",
    "x5_soft": _EACH
    + ", c as (select label % 4 as k, i, avg(x) as x from each where label is not null group by all), "
    "d as (select row_id, c.k, 1 / (1 + sum((e.x - c.x) ** 2)) as u from each e join c on e.i = c.i where label is not null group by all), "
    "q as (select row_id, k, u / sum(u) over (partition by row_id) as q from d), s as (select *, q * q / sum(q) over (partition by k) as v from q), "
    "p as (select *, v / sum(v) over (partition by row_id) as p from s) "
    "select k::int as k, round(sum(q), 6) as sum_q, round(sum(p), 6) as sum_p, round(max(p), 7) as max_p from p group by k",
    "q1_sign": _LABELLED
    + 'select batch, round(least(avg(((pred % 2 = 0) <> ("true" % 2 = 0))::int), avg(((pred % 2 = 0) = ("true" % 2 = 0))::int)), 9) as error from l group by batch',
    "q4_contrast": _LABELLED
    + ', c as (select batch, pred, "true" % 3 as part, count(*) as n from l where "true" % 3 in (0, 1) group by all), b as (select batch, pred, max(n) as m, sum(n) as n from c group by all) '
    "select batch, round(1 - sum(m) / sum(n), 9) as error from b group by batch",
    "q6_rand": _LABELLED
    + ', c as (select batch, sum(n * (n - 1) / 2) as c, sum(n) as n from t group by 1), a as (select batch, sum(n * (n - 1) / 2) as a from (select batch, pred, sum(n) as n from t group by all) group by 1), '
    'b as (select batch, sum(n * (n - 1) / 2) as b from (select batch, "true", sum(n) as n from t group by all) group by 1) '
    "select batch, case when coalesce((a + b) / 2 - a * b / nullif(n * (n - 1) / 2, 0), 0) = 0 then 1.0 "
    "else round((c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2)), 9) end as ari from c join a using (batch) join b using (batch)",
    "q7_v": _LABELLED
    + ', s as (select *, sum(n) over (partition by batch, pred) as np, sum(n) over (partition by batch, "true") as nt, sum(n) over (partition by batch) as a from t), '
    "e as (select batch, -sum(n / a * ln(n / np)) as tp, -sum(n / a * ln(n / nt)) as pt, -sum(n / a * ln(nt / a)) as ht, -sum(n / a * ln(np / a)) as hp from s group by 1) "
    "select batch, round(1 - tp / ht, 9) as homogeneity, round(1 - pt / hp, 9) as completeness, round(2 * (1 - tp / ht) * (1 - pt / hp) / ((1 - tp / ht) + (1 - pt / hp)), 9) as v_measure from e",
    "q10_confusion": _LABELLED + ', c as (select pred, "true", count(*) as n from l group by all) select pred, "true", n, round(n / sum(n) over (partition by "true"), 9) as share from c',
    "q11_silhouette": _MEANS
    + ", d as (select e.row_id, e.label, m.label as k, sqrt(sum((e.x - m.x) ** 2)) as d from each e join m on e.i = m.i where e.label is not null group by all), "
    "ab as (select row_id, label, min(d) filter (k = label) as a, min(d) filter (k <> label) as b from d group by all) "
    "select label, round(avg((b - a) / greatest(a, b)), 6) as silhouette, count(*) as n from ab group by label",
    "q15_alignment": _MEANS
    + """, g as (select a.label as i, b.label as j, sum(a.x * b.x) as v from m a join m b on a.i = b.i group by all),
r as (select g.i, g.j, exp(-(d.v - 2 * g.v + e.v) / 2.0) as v from g join g d on d.i = g.i and d.j = g.i join g e on e.i = g.j and e.j = g.j),
k as (select 'linear' as kernel, * from g union all select 'rbf', * from r),
c as (select kernel, i, j, v - avg(v) over (partition by kernel, i) - avg(v) over (partition by kernel, j) + avg(v) over (partition by kernel) as v from k),
n as (select c.kernel, c.i, c.j, c.v / sqrt(d.v * e.v) as v, case when (c.i - c.j) % 2 = 0 then 1.0 else -1.0 end as y from c
  join c d on d.kernel = c.kernel and d.i = c.i and d.j = c.i join c e on e.kernel = c.kernel and e.i = c.j and e.j = c.j)
select kernel, round(sum(v * y) / sqrt(sum(v * v) * sum(y * y)), 7) as alignment from n group by kernel""",
    "q17_separation": _LABELLED
    + ', c as (select batch, "true" % 10 as part, pred, count(*) as n from l group by all), d as (select *, row_number() over (partition by batch, part order by n desc, pred) as rn from c) '
    "select batch, count(*) as n_groups, count(distinct pred) = count(*) as separated from d where rn = 1 group by batch",
    "c3_distances": _MEANS
    + """, r as (select label, i, x, rank() over (partition by label order by x) + (count(*) over (partition by label, x) - 1) / 2 as r from m)
select a.label as i, b.label as j, round(sqrt(sum((a.x - b.x) ** 2)), 7) as euclidean, round(1 - corr(a.x, b.x), 7) as pearson, round(1 - corr(a.r, b.r), 7) as spearman
from r a join r b on a.i = b.i and a.label < b.label group by all""",
    "c6_consensus": _LABELLED
    + ', d as (select batch, "true" as k, pred, row_number() over (partition by batch, "true" order by n desc, pred) as rn from t), o as (select * from d where rn = 1), nb as (select count(distinct batch) as b from t) '
    "select x.k as i, y.k as j, round(count(*) / any_value(b), 9) as consensus from o x join o y on x.batch = y.batch and x.pred = y.pred and x.k < y.k, nb group by all",
    "w5_subsample": _OBS + ", c as (select dataset, label, count(*) as n from obs where label is not null group by all) select dataset, label, greatest(1, round_even(n * 0.1, 0))::bigint as n_drawn from c",
}
