"""Queries of the mixture comparators, splits, rejection and remaining scalings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import name_key
from spindrift.operators import factors, filters, linalg, metrics, mixtures, multitask, selection, splits, transfer
from spindrift.operators.linalg import dot, feature_sums
from spindrift.plans import reports
from spindrift.plans.matrix import _EACH, _LABELLED, _OBS, DIM, contrast, labelled, observations
from spindrift.session import cut

PARTS = 4
SIGMA2 = 0.02

#: Samples of each size.
DRAWS = 30

#: Variance of the model in the multi-task queries.
MULTI_SIGMA2 = 0.05


def q3_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least error over all renamings of three groups, per batch."""
    rows = labelled(spark, sf_dir).select("batch", (F.col("pred") % 3).alias("p"), (F.col("true") % 3).alias("t"))
    return metrics.permutation_error(metrics.contingency(rows, "p", "t", ["batch"]), 3, ["batch"]).select("batch", F.round("error", 9).alias("error"))


def g4_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the target's contrast by mixtures that borrow means or a direction from the source."""
    found = transfer.sides(contrast(spark, sf_dir))
    target, source = found["target"], found["source"]
    s2, t2 = transfer.noise_variance(source), transfer.noise_variance(target)
    own = transfer.target_only(target)
    reference = np.array(feature_sums(target.rows, [], own, DIM).first()["s"]) / target.n
    pair = mixtures.source_pair(source.rows, reference, s2, 10)
    out = None
    for name, z in (
        ("shrunk_means", mixtures.shrunk_means(target.rows, pair, t2, s2, 1.0, 10)),
        ("shrunk_direction", mixtures.shrunk_direction(target.rows, pair, t2, s2, rounds=10)),
        ("no_transfer", mixtures.shrunk_means(target.rows, pair, t2, s2, 0.0, 10)),
    ):
        one = target.rows.select(F.lit(name).alias("method"), "z", z.alias("z_hat"))
        out = one if out is None else out.unionByName(one)
    return metrics.sign_error(out, "z_hat", "z", ["method"])


def _part_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset, part, n, mean): means of the labels' remainders in every dataset."""
    rows = observations(spark, sf_dir).where("label is not null").withColumn("part", F.col("label") % PARTS)
    return cut(feature_sums(rows, ["dataset", "part"], d=DIM).select("dataset", "part", "n", F.transform("s", lambda x: x / F.col("n")).alias("mean")), "means")


def _stacked(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf.sort_values("part")["mean"].to_numpy())


def g6_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of each group's contrast with group 0, per dataset."""

    def told(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = mixtures.contrast_vectors(_stacked(pdf), SIGMA2)
        return pd.DataFrame({"dataset": key[0], "part": sorted(pdf["part"])[1:], "length": np.linalg.norm(c, axis=1).round(6)})

    return _part_means(spark, sf_dir).groupBy("dataset").applyInPandas(told, "dataset string, part int, length double")


def g7_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order of each dataset's groups that fits the first dataset best, its cost, and the score in the groups' own order."""
    means = _part_means(spark, sf_dir)
    first = means.agg(F.min("dataset").alias("_first"))
    base = means.join(F.broadcast(first), means["dataset"] == F.col("_first")).select("part", F.col("mean").alias("base"))
    both = means.join(first, means["dataset"] > F.col("_first")).join(base, "part")

    def told(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        own, other = np.stack(pdf["mean"].to_numpy()), mixtures.contrast_vectors(np.stack(pdf["base"].to_numpy()), SIGMA2)
        order, cost = mixtures.align_groups(own, SIGMA2, [other])
        score = mixtures.alignment_score([other, mixtures.contrast_vectors(own, SIGMA2)])
        return pd.DataFrame({"dataset": [key[0]], "groups": [[int(i) for i in order]], "cost": [round(cost, 5)], "own_order": [round(score, 5)]})

    return both.groupBy("dataset").applyInPandas(told, "dataset string, groups array<int>, cost double, own_order double")


def _part_model(spark: SparkSession, sf_dir: str) -> multitask.Model:
    """The model whose groups are the labels' remainders, of all datasets together."""
    got = _part_means(spark, sf_dir).select("part", "n", F.posexplode("mean").alias("i", "x")).groupBy("part", "i").agg((F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    rows = got.groupBy("part").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("i", "x"))).alias("m")).orderBy("part").collect()
    means, n = np.array([[v["x"] for v in r["m"]] for r in rows]), np.array([float(r["n"]) for r in rows])
    return multitask.Model.of(n / n.sum(), mixtures.contrast_vectors(means, MULTI_SIGMA2), means)


def g11_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each dataset by group, counted by their responsibilities under the model of the labels' remainders."""
    model = _part_model(spark, sf_dir)
    rows = observations(spark, sf_dir).where("label is not null").withColumn("fold", F.lit(0))
    return multitask.responsibility_rows(rows, model).groupBy("dataset", "group").agg(F.round(F.sum("g"), 5).alias("n"))


def g15_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by class under that model and remainder of the label."""
    rows = observations(spark, sf_dir).where("label is not null")
    return rows.groupBy((F.col("label") % PARTS).alias("part"), multitask.classify(_part_model(spark, sf_dir)).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def g16_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected log-likelihood per row under that model, per dataset."""
    model = _part_model(spark, sf_dir)
    rows = observations(spark, sf_dir).where("label is not null")
    return multitask.likelihood_rows(rows, model, MULTI_SIGMA2).groupBy("dataset").agg(F.round(F.avg("l"), 6).alias("likelihood"))


def g18_multitask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the multi-task mixture of four groups against the labels of the first batch, with all other batches as sources."""
    batch = reports.read_table(spark, sf_dir, "cell_meta").where("batch is not null").groupBy(name_key(F.col("barcode")).alias("cell")).agg(F.min("batch").alias("batch"))
    cell = reports.read_table(spark, sf_dir, "gene_data_set").groupBy(F.col("cell_id").alias("row_id")).agg(F.min(name_key(F.col("sample"))).alias("cell"))
    by_batch = observations(spark, sf_dir).where("label is not null").drop("dataset").join(cell, "row_id").join(batch, "cell").select(F.col("batch").alias("dataset"), "row_id", "features", "label")
    rows = cut(linalg.centre(cut(by_batch, "by_batch"), ["dataset"]), "batches")
    found = {k: s for k, s in transfer.sides(rows).items() if s.n >= 10 * PARTS}
    target = min(found)
    labels, growth = multitask.multitask_labels(rows, found, target, PARTS, rounds=10, orders=10, folds=3, points=5)
    out = found[target].rows.select(F.lit(target).alias("target"), "label", labels.alias("k"))
    return metrics.scores(out, "k", "label", ["target"]).select("target", F.lit(round(growth, 9)).alias("growth"), "ari", "v_measure")


def n13_rejection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the eight rejection scores per component of the target cells, under the source's factor."""
    obs = cut(observations(spark, sf_dir), "obs")
    target = obs.where("dataset = 'target'")
    w, _ = factors.fit_factors(obs.where("dataset = 'source'"), 8)
    coded = cut(factors.transfer_coefficients(target, w), "coded")
    scores = factors.rejection_scores(target, coded, w).join(coded.select("row_id", "component"), "row_id")
    return scores.groupBy("component").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in scores.columns if c not in ("row_id", "component")])


def n15_transferability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the source's factor explains the target, against shuffled ones, with the error of the fit."""
    obs = cut(observations(spark, sf_dir), "obs")
    target = obs.where("dataset = 'target'")
    w, _ = factors.fit_factors(obs.where("dataset = 'source'"), 8)
    score, p = factors.transferability(target, w, 8)
    report = factors.reconstruction(target, factors.transfer_coefficients(target, w), w)
    return report.select(F.lit(score).alias("score"), F.lit(p).alias("p_value"), "n", "mean_absolute", "frobenius")


def pre_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean quantile-normalised features per label."""
    rows = filters.quantile_normalise(observations(spark, sf_dir).select("row_id", "label", "features"), DIM).where("label is not null")
    each = rows.select("label", F.posexplode("features").alias("i", "x"))
    return each.groupBy("label", "i").agg(F.round(F.avg("x"), 8).alias("mean"))


def w15_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean log2 counts per million per gene."""
    rows = filters.library_scale(reports.expr_rows(spark, sf_dir))
    return rows.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 7).alias("mean"))


def w13_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each label on both sides of a stratified split of three tenths."""
    rows = observations(spark, sf_dir).where("label is not null").select("row_id", "label")
    sided = splits.split_sides(rows, "label", "stratified", 0.3)
    return sided.groupBy("label").agg(F.count_if(F.col("side") == "source").alias("n_source"), F.count_if(F.col("side") == "target").alias("n_target"))


def w13_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels and rows per side of every way to split."""
    rows = cut(observations(spark, sf_dir).where("label is not null").select("row_id", "label"), "labels")
    out = None
    for mode in ("random", "stratified", "exclusive", "disjoint", "shared"):
        one = splits.split_sides(rows, "label", mode, 0.5, 5).select(F.lit(mode).alias("mode"), "side", "label")
        out = one if out is None else out.unionByName(one)
    return out.groupBy("mode", "side").agg(F.count_distinct("label").alias("n_labels"), F.count(F.lit(1)).alias("n"))


def t7_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of the target's contrast by its own rows, the source's direction or both, over samples of growing size."""
    rows = contrast(spark, sf_dir)
    target = rows.where("dataset = 'target'").drop("dataset")
    n, samples = target.count(), None
    for size in splits.size_grid(n, 20, 6):
        drawn = splits.draw(target, ["z"], size / n).where("drawn").drop("drawn").withColumn("dataset", F.format_string("%09d", F.lit(size)))
        samples = drawn if samples is None else samples.unionByName(drawn)
    found = transfer.sides(cut(linalg.centre(samples, ["dataset"]), "samples"))
    source = transfer.direction(transfer.sides(rows.where("dataset = 'source'"))["source"])
    out = None
    for name, side in sorted(found.items()):
        both = linalg.subspace_basis([transfer.direction(side), source], normalize=True)
        for method, z in (("target", transfer.target_only(side)), ("source", transfer.in_span(side, linalg.subspace_basis([source]))), ("pooled", transfer.in_span(side, both))):
            one = side.rows.select(F.lit(int(name)).alias("size"), F.lit(method).alias("method"), "z", z.alias("z_hat"))
            out = one if out is None else out.unionByName(one)
    error = metrics.sign_error(out, "z_hat", "z", ["size", "method"])
    return error


def t7_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error and Rand index of the target's contrast over 30 samples of each of eight sizes: mean and deviation per size and method.

    All samples are datasets of one table, so they share their passes.
    """
    rows = contrast(spark, sf_dir)
    target = rows.where("dataset = 'target'").select("row_id", "features", "z")
    n, samples = target.count(), None
    runs = target.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1)))).withColumn("row_id", F.col("row_id") * DRAWS + F.col("run"))
    for size in splits.size_grid(n):
        drawn = splits.draw(runs, ["run", "z"], size / n).where("drawn").drop("drawn").withColumn("size", F.lit(size))
        samples = drawn if samples is None else samples.unionByName(drawn)
    named = samples.withColumn("dataset", F.format_string("%09d-%02d", F.col("size"), F.col("run")))
    samples = cut(linalg.centre(named, ["dataset"]), "samples")
    found = transfer.sides(samples.select("dataset", "row_id", "features"))
    source = transfer.direction(transfer.sides(rows.where("dataset = 'source'"))["source"])
    alone = transfer.span_directions(found, {k: [source] for k in found})
    both = transfer.span_directions(found, {k: [transfer.top_directions(s.moment)[0][:, 0], source] for k, s in found.items()})
    labels = {"target": transfer.spectral_signs_all(samples, found), "source": transfer.signs_along(alone), "pooled": transfer.signs_along(both)}
    out = None
    for method, z in labels.items():
        one = samples.select("size", "run", F.lit(method).alias("method"), "z", z.alias("z_hat"))
        out = one if out is None else out.unionByName(one)
    out = cut(out, "labels")
    keys = ["size", "run", "method"]
    each = metrics.sign_error(out, "z_hat", "z", keys).join(metrics.adjusted_rand(metrics.contingency(out, "z_hat", "z", keys), keys), keys)
    spread = [f(c).alias(f"{name}_{c}") for c in ("error", "ari") for name, f in (("mean", F.avg), ("std", F.stddev_pop))]
    return each.groupBy("size", "method").agg(F.count(F.lit(1)).alias("n_sub"), *spread)


def _source_and_target(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    obs = cut(observations(spark, sf_dir), "obs")
    return obs.where("dataset = 'source'"), obs.where("dataset = 'target'")


def t10_mixtures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For 4 and 8 factors of the source and three shares of mixture: alignment of the target's mixed rows with their groups, Rand index
    of the groups against the labels, and whether the share is the one of the greatest alignment for its number of factors."""
    source, target = _source_and_target(spark, sf_dir)
    w = {k: factors.fit_factors(source, k)[0] for k in (4, 8)}
    fits = selection.fit_mixtures(target, w, (0.0, 0.3, 0.6))
    groups = cut(selection.mixture_labels(target, w, fits).withColumn("run", F.format_string("%d/%.2f", "k", "mix")), "groups")
    fit = selection.partition_alignment(groups.select("run", "component", "features"), "run", "component")
    labels = groups.join(target.select("row_id", "label"), "row_id")
    rand = metrics.adjusted_rand(metrics.contingency(labels, "component", "label", ["run"]), ["run"])
    out = groups.select("run", "k", "mix").distinct().join(fit, "run").join(rand, "run")
    best = F.max("alignment").over(Window.partitionBy("k"))
    return out.select("k", "mix", "alignment", "ari", (F.col("alignment") == best).alias("chosen"))


def n14_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target cells per component, those rejected by the best threshold on their error, and the mean length of the mixed rows when these stay as they are."""
    source, target = _source_and_target(spark, sf_dir)
    w, _ = factors.fit_factors(source, 8)
    coded = cut(factors.transfer_coefficients(target, w), "coded")
    threshold, _, _ = selection.reject_threshold(coded.select("row_id", "error").join(target, "row_id"), "error")
    moved = factors.mixed(target, coded, w, 0.5, F.col("error") > threshold).join(coded.select("row_id", (F.col("error") > threshold).alias("rejected")), "row_id")
    return moved.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.count_if("rejected").alias("n_rejected"), F.round(F.avg(dot(F.col("features"), F.col("features"))), 6).alias("length2"))


QUERIES = {
    "q3_permutation": q3_permutation,
    "g4_mixtures": g4_mixtures,
    "g6_contrasts": g6_contrasts,
    "g7_alignment": g7_alignment,
    "g11_softmax": g11_softmax,
    "g15_classes": g15_classes,
    "g16_likelihood": g16_likelihood,
    "g18_multitask": g18_multitask,
    "n13_rejection": n13_rejection,
    "n15_transferability": n15_transferability,
    "pre_quantile": pre_quantile,
    "w13_splits": w13_splits,
    "w13_modes": w13_modes,
    "w15_library": w15_library,
    "t7_sizes": t7_sizes,
    "t7_sweep": t7_sweep,
    "t10_mixtures": t10_mixtures,
    "n14_reject": n14_reject,
}

#: Logits z of each row and group, and responsibilities g, under the model of the labels' remainders.
_MODEL = _EACH + f""", gm as (select label % {PARTS} as k, i, avg(x) as x from each where label is not null group by all),
w as (select label % {PARTS} as k, count(*) / sum(count(*)) over () as w from obs where label is not null group by 1),
b as (select a.k, a.i, (a.x - r.x) / {MULTI_SIGMA2} as b, (a.x - r.x) / {MULTI_SIGMA2} * (a.x + r.x) / 2 as o from gm a join gm r on a.i = r.i and r.k = 0),
z as (select row_id, e.dataset, e.label, b.k, ln(any_value(w.w)) + sum(e.x * b.b - b.o) as z, sum(e.x * e.x) as x2, sum(e.x * b.b) * {MULTI_SIGMA2} as xm, sum(b.b * b.b) * {MULTI_SIGMA2} ** 2 as m2, any_value(w.w) as w
  from each e join b using (i) join w on w.k = b.k where e.label is not null group by all),
g as (select *, exp(z - max(z) over (partition by row_id)) / sum(exp(z)) over (partition by row_id) * exp(max(z) over (partition by row_id)) as g from z)
"""

_MAPS = ["012", "021", "102", "120", "201", "210"]

SQL = {
    "q3_permutation": _LABELLED
    + 'select batch, round(1 - greatest('
    + ", ".join("sum(n * (" + " or ".join(f"(pred % 3 = {i} and \"true\" % 3 = {c})" for i, c in enumerate(m)) + ")::int)" for m in _MAPS)
    + ") / sum(n), 9) as error from t group by batch",
    "g6_contrasts": _EACH
    + f", m as (select dataset, label % {PARTS} as part, i, avg(x) as x from each where label is not null group by all) "
    f"select a.dataset, a.part, round(sqrt(sum(power((a.x - b.x) / {SIGMA2}, 2))), 6) as length from m a join m b on a.dataset = b.dataset and a.i = b.i and b.part = 0 where a.part > 0 group by all",
    "g11_softmax": _MODEL + 'select dataset, k as "group", round(sum(g), 5) as n from g group by all',
    "g15_classes": _MODEL + f'select label % {PARTS} as part, k as "class", count(*) as n from (select *, row_number() over (partition by row_id order by z desc, k) as rn from z) where rn = 1 group by all',
    "g16_likelihood": _MODEL
    + f"select dataset, round(sum(g * (ln(w) - 32 * ln(2 * pi() * {MULTI_SIGMA2}) - (x2 - 2 * xm + m2) / {2 * MULTI_SIGMA2})) / count(distinct row_id), 6) as likelihood from g group by dataset",
    "pre_quantile": _EACH
    + ", r as (select row_id, label, i, x, row_number() over (partition by row_id order by x) as place, rank() over (partition by row_id order by x) as low, count(*) over (partition by row_id, x) as same from each), "
    "q as (select place, avg(x) as v from r group by place), s as (select place, sum(v) over (order by place) as upto from q union all select 0, 0.0) "
    "select label, i::int as i, round(avg((h.upto - l.upto) / same), 8) as mean from r join s h on h.place = low + same - 1 join s l on l.place = low - 1 where label is not null group by all",
    "w13_splits": _OBS + ", c as (select label, count(*) as n, greatest(1, round_even(count(*) * 0.3, 0))::bigint as k from obs where label is not null group by label) select label, k as n_source, n - k as n_target from c",
    "w15_library": reports._EXPR
    + ", s as (select cell, sum(value) as total from e group by cell) select gene, count(*) as n, round(avg(case when total > 0 then log2(value / (total / 1e6) + 1) else 0 end), 7) as mean from e join s using (cell) group by gene",
}
