"""Queries of relational, metric and file operators that stand for themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions.text import name_key
from spindrift.operators import factors, linalg, metrics, splits
from spindrift.plans.matrix import _LABELLED, _MEANS, _OBS, label_means, labelled, observations
from spindrift.session import cut, read_table, scratch_path
from spindrift.sources.delimited_bodies import read_bodies

#: Labels that are given as the source's own.
GIVEN = (1, 2, 3, 5, 8, 13, 21, 34, 55, 89)


def r5_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the methods whose name begins with "source" or "pooled"."""
    rows = read_table(spark, sf_dir, "sweep_results").select(name_key(F.col("method")).alias("method"))
    return rows.where(F.col("method").rlike("^(source|pooled)")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


def r12_first_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifteen regimes, methods and branches that occur together, in order."""
    rows = read_table(spark, sf_dir, "sweep_results").select("regime", name_key(F.col("method")).alias("method"), F.coalesce("branch", F.lit("")).alias("branch"))
    return rows.distinct().orderBy("regime", "method", "branch").limit(15)


def r18_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of source and target together, each once."""
    cells = read_table(spark, sf_dir, "gene_data_set").where("label is not null")
    s, t = (cells.where(F.col("dataset") == d).select("label") for d in ("source", "target"))
    return s.union(t).distinct()


def r28_transpose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of label means with features as rows: of each the labels in order, and the means."""
    return linalg.transpose(label_means(spark, sf_dir), "label", "mean").select(
        F.col("place").alias("feature"), F.size("keys").alias("n_labels"), F.element_at("keys", 1).alias("first_label"), F.round(F.element_at("values", 1), 8).alias("first_mean"), F.round(F.element_at("values", -1), 8).alias("last_mean")
    )


def q2_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error of signs under the better global sign, where 0 is a sign of its own."""
    rows = labelled(spark, sf_dir).select("batch", (F.col("pred") % 3 - 1).alias("p"), (F.col("true") % 3 - 1).alias("t"))
    return metrics.signum_error(rows, "p", "t", ["batch"]).select("batch", F.round("error", 9).alias("error"))


def q9_reassigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label that each cluster is given by the best one-to-one map of all batches together."""
    return metrics.reassignment(metrics.contingency(labelled(spark, sf_dir).withColumn("all", F.lit(1)), "pred", "true", ["all"]), ["all"]).select("pred", "true", "n")


def q18_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cells per batch whose registered cluster equals their label."""
    return metrics.match_rate(labelled(spark, sf_dir), "pred", "true", ["batch"]).select("batch", F.round("rate", 9).alias("rate"))


def i4_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first result line of each small file that has a complete one there: files per regime and method."""
    first = F.regexp_extract("body", r"^([^\r\n]*(?:\r\n|\r|\n)[^\r\n]*)", 1)
    files = read_table(spark, sf_dir, "task_files").groupBy("file_id").agg(F.min("regime").alias("regime"), F.min("body").alias("body")).withColumn("body", first)
    rows = read_bodies(files, "body", ["file_id", "regime"], ["method"], ["mu"])
    return rows.where("method is not null and mu is not null").groupBy("regime", F.lower("method").alias("method")).agg(F.count(F.lit(1)).alias("n_files"))


def i10_kept_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors learnt from the source, written as tables, read again and carried over to the target: rows per component."""
    obs = cut(observations(spark, sf_dir), "obs")
    w, _ = factors.fit_factors(obs.where("dataset = 'source'"), 8)
    path = scratch_path(spark, "factors")
    factors.save_factors(spark, w, path)
    coded = factors.transfer_coefficients(obs.where("dataset = 'target'"), factors.load_factors(spark, path))
    return coded.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def w12_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of all rows of a gene as one flat list, in the order of the rows."""
    rows = read_table(spark, sf_dir, "gene_gcn_feas").where("feas is not null").select("gcn_id", name_key(F.col("symbl")).alias("gene"), "feas").dropDuplicates(["gcn_id"])
    lists = rows.where("gene <> ''").groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("gcn_id", "feas"))).alias("l"))
    return lists.select("gene", F.flatten(F.transform("l", lambda x: x["feas"])).alias("v")).select("gene", F.size("v").alias("n"), F.element_at("v", 1).cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


def w13_given(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split whose source labels are given: rows per label and side."""
    rows = observations(spark, sf_dir).where("label is not null").select("row_id", "label")
    return splits.split_sides(rows, "label", "given", given=GIVEN).groupBy("label", "side").agg(F.count(F.lit(1)).alias("n"))


def w14_two_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random split that carries two sets of labels: rows and distinct labels of both sets per side."""
    meta = read_table(spark, sf_dir, "cell_meta").groupBy(name_key(F.col("barcode")).alias("cell")).agg(F.min("assigned_cluster").alias("cluster"))
    cell = read_table(spark, sf_dir, "gene_data_set").groupBy(F.col("cell_id").alias("row_id")).agg(F.min(name_key(F.col("sample"))).alias("cell"))
    rows = observations(spark, sf_dir).select("row_id", "label").join(cell, "row_id").join(meta, "cell", "left")
    sided = splits.split_sides(rows, "label", "random", 0.5)
    return sided.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count("label").alias("n_label"), F.count("cluster").alias("n_cluster"))


QUERIES = {
    "r5_methods": r5_methods,
    "r12_first_distinct": r12_first_distinct,
    "r18_union": r18_union,
    "r28_transpose": r28_transpose,
    "q2_signs": q2_signs,
    "q9_reassigned": q9_reassigned,
    "q18_match": q18_match,
    "i4_first_rows": i4_first_rows,
    "i10_kept_factors": i10_kept_factors,
    "w12_flatten": w12_flatten,
    "w13_given": w13_given,
    "w14_two_labels": w14_two_labels,
}

_METHOD = r"lower(regexp_replace(method, '^\s+|\s+$', '', 'g'))"

SQL = {
    "r5_methods": f"select {_METHOD} as method, count(*) as n from sweep_results where regexp_matches({_METHOD}, '^(source|pooled)') group by 1",
    "r12_first_distinct": f"select distinct regime, {_METHOD} as method, coalesce(branch, '') as branch from sweep_results order by 1, 2, 3 limit 15",
    "r18_union": "select distinct label from gene_data_set where label is not null and dataset in ('source', 'target')",
    "r28_transpose": _MEANS
    + "select i::int as feature, count(*) as n_labels, min(label) as first_label, round(min_by(x, label), 8) as first_mean, round(max_by(x, label), 8) as last_mean from m group by i",
    "q2_signs": _LABELLED
    + """select batch, round(least(avg((sign(pred % 3 - 1) <> sign("true" % 3 - 1))::int), avg((sign(pred % 3 - 1) <> -sign("true" % 3 - 1))::int)), 9) as error from l group by 1""",
    "q18_match": _LABELLED + """select batch, round(avg((pred = "true")::int), 9) as rate from l group by 1""",
    "w12_flatten": r"""
with rows as (select gcn_id, min(lower(regexp_replace(symbl, '^\s+|\s+$', '', 'g'))) as gene, any_value(feas) as feas from gene_gcn_feas where feas is not null group by gcn_id),
lists as (select gene, flatten(list(feas order by gcn_id)) as v from rows where gene <> '' group by 1)
select gene, len(v)::int as n, v[1]::double as first, v[-1]::double as last from lists""",
    "w13_given": _OBS + f"select label, case when label in {GIVEN} then 'source' else 'target' end as side, count(*) as n from obs where label is not null group by all",
}
