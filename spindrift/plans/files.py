"""Queries that write whole tables as delimited files and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.plans import reports
from spindrift.plans.matrix import _EACH, observations
from spindrift.session import cut, scratch_path
from spindrift.sources import files


def i5_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All results written in folders per regime, read again as one table and counted."""
    path = scratch_path(spark, "results")
    rows = reports.results(spark, sf_dir).select("regime", "result_id", "seed", "mu", "method", "error", "branch", "c0_used", "finished_at")
    files.write_results(rows, path, ["regime"])
    again = files.read_results(spark, path, "result_id long, seed int, mu double, method string, error double, branch string, c0_used double, finished_at timestamp_ntz, regime string")
    return again.groupBy("regime", "method").agg(
        F.count(F.lit(1)).alias("n"), F.sum("result_id").alias("ids"), F.round(F.sum("error"), 6).alias("sum_error"), F.count("branch").alias("n_branch"), F.round(F.avg("c0_used"), 8).alias("mean_c0"), F.max("finished_at").alias("last")
    )


def i6_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of mean errors written with six decimals and read back."""
    path = scratch_path(spark, "means")
    means = reports.results(spark, sf_dir).groupBy("regime", "mu", "method").agg(F.avg("error").alias("mean_error"), F.stddev_samp("error").alias("std_error"))
    files.write_results(means, path, decimals=6)
    return files.read_results(spark, path, "regime string, mu double, method string, mean_error double, std_error double")


def i7_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells written as a matrix with files of ids and labels, read by line and averaged per label."""
    obs = cut(observations(spark, sf_dir), "obs")
    data, ids, labels = (scratch_path(spark, n) for n in ("matrix", "ids", "labels"))
    files.write_matrix(obs, data, "row_id")
    files.write_lines(obs, ids, "row_id", F.col("row_id").cast("string"))
    files.write_lines(obs, labels, "row_id", F.col("label").cast("string"))
    names = files.numbered_lines(spark, ids).select("line", F.col("value").cast("long").alias("row_id"))
    kinds = files.numbered_lines(spark, labels).select("line", F.expr("try_cast(value as int)").alias("label"))
    rows = files.read_matrix(spark, data).join(names, "line").join(kinds, "line")
    return rows.groupBy("label", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"), F.round(F.avg("value"), 8).alias("mean"))


def i15_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line of a LaTeX table per regime: mean error per method, the least in bold."""
    means = reports.results(spark, sf_dir).groupBy("regime", "method").agg(F.round(F.avg("error"), 8).alias("m"))
    best = means.withColumn("best", F.abs(F.col("m") - F.min("m").over(Window.partitionBy("regime"))) <= 1e-9)
    wide = best.groupBy("regime").pivot("method", reports.METHODS).agg(F.first(F.format_string("%.3f", "m")).alias("m"), F.first("best").alias("b"))
    cells = [F.col(f"{m}_m") for m in reports.METHODS]
    bold = [F.coalesce(F.col(f"{m}_b"), F.lit(False)) for m in reports.METHODS]
    return wide.select("regime", files.table_line([F.col("regime"), *cells], [F.lit(False), *bold]).alias("line"))


QUERIES = {"i5_results": i5_results, "i6_decimals": i6_decimals, "i7_matrix": i7_matrix, "i15_lines": i15_lines}

_CELL = "case when max(m) filter (method = '{m}') is null then '--' when max(m) filter (method = '{m}') <= any_value(low) + 1e-9 then '\\textbf{{' || printf('%.3f', max(m) filter (method = '{m}')) || '}}' else printf('%.3f', max(m) filter (method = '{m}')) end"

SQL = {
    "i5_results": reports._RESULTS
    + "select regime, method, count(*) as n, sum(result_id)::bigint as ids, round(sum(error), 6) as sum_error, count(branch) as n_branch, round(avg(c0_used), 8) as mean_c0, max(finished_at) as last from results group by all",
    "i6_decimals": reports._RESULTS + "select regime, mu, method, round(avg(error), 6) as mean_error, round(stddev_samp(error), 6) as std_error from results group by all",
    "i7_matrix": _EACH + "select label, i::int as place, count(*) as n, sum(row_id)::bigint as ids, round(avg(x), 8) as mean from each group by all",
    "i15_lines": reports._RESULTS
    + ", a as (select regime, method, round(avg(error), 8) as m from results group by all), b as (select *, min(m) over (partition by regime) as low from a) select regime, concat_ws(' & ', regime, "
    + ", ".join(_CELL.format(m=m) for m in reports.METHODS)
    + ") || ' \\\\' as line from b group by regime",
}
