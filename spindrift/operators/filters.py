"""Filters and scalings of expression matrices held as (cell, gene, value) rows.

Missing places of the matrix are 0.  Every operator is one or two grouped
aggregates; the groups are cells or genes, and a gene that holds a third of all
rows is added up before the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.linalg import feature_sums


def cell_filter(rows: DataFrame, n_genes: int, threshold: float) -> DataFrame:
    """(cell): cells in which at least ``n_genes`` values reach ``threshold``; null and NaN count as 0."""
    return rows.where((F.nanvl("value", F.lit(0.0)) >= threshold)).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= n_genes).select("cell")


def gene_filter(rows: DataFrame, share: float, threshold: float) -> DataFrame:
    """(gene): genes at ``threshold`` in at least n (1 - share) cells and above 0 in at most n share cells."""
    n = rows.agg(F.count_distinct("cell").alias("n"))
    v = F.nanvl("value", F.lit(0.0))
    per_cell = rows.groupBy("gene", "cell").agg(F.max(v).alias("v"))
    seen = per_cell.groupBy("gene").agg(F.count_if(F.col("v") >= threshold).alias("high"), F.count_if(F.col("v") > 0).alias("some"))
    # The one row of totals is a scalar.
    kept = seen.join(F.broadcast(n), how="cross").where((F.col("high") >= F.col("n") * (1 - share)) & (F.col("some") <= F.col("n") * share))
    return kept.select("gene")


def preprocess(rows: DataFrame, cell_sets: Sequence[DataFrame], gene_sets: Sequence[DataFrame], transform: Callable[[Column], Column]) -> DataFrame:
    """Rows of the cells and genes that all sets keep, with transformed values.

    The sets are found on the unfiltered matrix, so their order doesn't matter.
    """
    for s in cell_sets:
        rows = rows.join(s.select("cell").distinct(), "cell", "left_semi")
    for s in gene_sets:
        rows = rows.join(s.select("gene").distinct(), "gene", "left_semi")
    return rows.withColumn("value", transform(F.col("value")))


def matching_ids(source: DataFrame, target: DataFrame, key: str, order: str) -> DataFrame:
    """(key, place): ids of both sides, numbered in the order of their first row in the target.

    Only the common ids, at most one row per gene, are put into one order.
    """
    first = target.groupBy(key).agg(F.min(order).alias("_first"))
    common = first.join(source.select(key).distinct(), key, "left_semi")
    return common.select(key, (F.row_number().over(Window.orderBy("_first")).cast("long") - 1).alias("place"))


def seen_genes(rows: DataFrame, n_cells: int) -> DataFrame:
    """(gene): genes above 0 in at least ``n_cells`` cells."""
    return rows.where("value > 0").groupBy("gene").agg(F.count_distinct("cell").alias("n")).where(F.col("n") >= n_cells).select("gene")


def log_normalise(rows: DataFrame, total: float) -> DataFrame:
    """Values scaled so that each cell sums to ``total``, then log1p; a cell without any value stays 0."""
    sums = rows.groupBy("cell").agg(F.sum("value").alias("_sum"))
    scaled = F.when(F.col("_sum") > 0, F.log1p(F.lit(total) * F.col("value") / F.col("_sum"))).otherwise(0.0)
    return rows.join(sums, "cell").withColumn("value", scaled).drop("_sum")


def variable_genes(rows: DataFrame, batch: str, n_top: int, n_bins: int = 20) -> DataFrame:
    """(gene, n_batches, median_rank): the ``n_top`` most variable genes over all batches.

    Per batch the dispersion (variance over mean) of a gene is compared with that of
    genes of like mean: it is scaled by mean and deviation of its bin of means.  The
    genes are ranked per batch and combined by the number of batches in which they
    are among the top, then by their median rank there, then by name.
    """
    n = rows.groupBy(batch).agg(F.count_distinct("cell").alias("_n"))
    stats = rows.groupBy(batch, "gene").agg(F.sum("value").alias("_s"), F.sum(F.col("value") * F.col("value")).alias("_q"))
    stats = stats.join(n, batch).withColumn("mean", F.col("_s") / F.col("_n"))
    stats = stats.withColumn("disp", (F.col("_q") / F.col("_n") - F.col("mean") * F.col("mean")) / F.when(F.col("mean") > 0, F.col("mean")))
    bins = stats.where("disp is not null").withColumn("bin", F.ntile(n_bins).over(Window.partitionBy(batch).orderBy("mean", "gene")))
    w = Window.partitionBy(batch, "bin")
    scaled = bins.withColumn("norm", (F.col("disp") - F.avg("disp").over(w)) / F.nullif(F.stddev_samp("disp").over(w), F.lit(0.0)))
    ranked = scaled.withColumn("rank", F.row_number().over(Window.partitionBy(batch).orderBy(F.desc_nulls_last("norm"), "gene")))
    top = ranked.where(F.col("rank") <= n_top).groupBy("gene").agg(F.count(F.lit(1)).alias("n_batches"), F.percentile("rank", F.lit(0.5)).alias("median_rank"))
    return top.orderBy(F.desc("n_batches"), "median_rank", "gene").limit(n_top)


def library_scale(rows: DataFrame, total: float = 1e6) -> DataFrame:
    """log2(1 + value per ``total`` of its cell); a cell without any value stays 0."""
    sums = rows.groupBy("cell").agg(F.sum("value").alias("_sum"))
    scaled = F.when(F.col("_sum") > 0, F.log2(F.col("value") / (F.col("_sum") / total) + 1)).otherwise(0.0)
    return rows.join(sums, "cell").withColumn("value", scaled).drop("_sum")


def quantile_normalise(obs: DataFrame, d: int) -> DataFrame:
    """Rows whose d features get the same distribution: a feature takes the mean, over all rows, of its rank's values.

    Equal features of a row share the mean of their ranks.  Rows keep their other columns.
    """
    got = feature_sums(obs.select(F.array_sort("features").alias("features")), [], d=d).first()
    if not got["n"]:
        return obs
    added = np.concatenate([[0.0], np.cumsum(np.array(got["s"]) / got["n"])])

    @F.pandas_udf("array<double>")
    def ranked(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = []
            for x in s:
                order = np.sort(x)
                low, high = np.searchsorted(order, x, "left"), np.searchsorted(order, x, "right")
                out.append((added[high] - added[low]) / (high - low))
            yield pd.Series(out, dtype=object)

    return obs.withColumn("features", ranked("features"))
