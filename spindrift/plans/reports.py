"""Reports over sweep results, cells and gene tables: the relational part of the engine.

Every query is a declarative plan over whole tables; each has its SQL beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.functions.text import bare, name_key
from spindrift.session import read_table

#: Length of a usable gene vector.
PLACES = 20

METHODS = ["target", "source", "adaptive", "pooled", "tlgmm"]


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid results of the sweep, of each result_id the row loaded last."""
    raw = read_table(spark, sf_dir, "sweep_results").where("error >= 0 and error <= 1")
    rest = [c for c in raw.columns if c not in ("result_id", "loaded_at")]
    # One aggregate per column, so that columns a query doesn't use are never read.
    last = raw.groupBy("result_id").agg(F.max("loaded_at").alias("loaded_at"), *[F.max_by(c, "loaded_at").alias(c) for c in rest])
    return last.withColumn("method", name_key(F.col("method")))


_RESULTS = r"""
with results as (
  select * exclude (method, rn), lower(regexp_replace(method, '^\s+|\s+$', '', 'g')) as method
  from (select *, row_number() over (partition by result_id order by loaded_at desc) as rn from sweep_results where error >= 0 and error <= 1)
  where rn = 1)
"""


def a1_mean_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, standard error and count of the error per regime, mu and method."""
    return results(spark, sf_dir).groupBy("regime", "mu", "method").agg(
        F.round(F.avg("error"), 8).alias("mean_error"), F.round(F.stddev_samp("error") / F.sqrt(F.count("error")), 8).alias("se_error"), F.count("error").alias("n")
    )


def a2_many_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same three figures over several value columns at once."""
    values = ["error", "c0_used", "elapsed_sec"]
    df = results(spark, sf_dir)
    figures = []
    for v in values:
        x = F.col(v)
        figures += [F.round(F.avg(x), 7).alias(f"mean_{v}"), F.round(F.stddev_samp(x) / F.sqrt(F.count(x)), 7).alias(f"se_{v}"), F.count(x).alias(f"n_{v}")]
    return df.groupBy("regime", "method").agg(*figures)


def a3_constant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation and count of the calibrated constant where there is one."""
    used = results(spark, sf_dir).where("c0_used is not null and not isnan(c0_used)")
    return used.groupBy("regime", "mu").agg(F.round(F.avg("c0_used"), 8).alias("mean_c0"), F.round(F.stddev_samp("c0_used"), 8).alias("std_c0"), F.count("c0_used").alias("n"))


def a4_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the seconds taken, per method and branch."""
    timed = results(spark, sf_dir).where("elapsed_sec is not null and not isnan(elapsed_sec)")
    return timed.groupBy("method", "branch").agg(F.round(F.avg("elapsed_sec"), 6).alias("mean_sec"), F.round(F.stddev_samp("elapsed_sec"), 6).alias("std_sec"))


def a5_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct seeds per grid cell."""
    return results(spark, sf_dir).groupBy("regime", "mu", "method").agg(F.count_distinct("seed").alias("n_seeds"))


def a6_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population mean and deviation per seed size class and method."""
    return (
        results(spark, sf_dir)
        .groupBy(F.expr("seed div 100").alias("seed_class"), "method")
        .agg(F.round(F.avg("error"), 8).alias("mean_value"), F.round(F.stddev_pop("error"), 8).alias("std_value"))
    )


def a7_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells per batch and assigned cluster class, zero filled."""
    meta = read_table(spark, sf_dir, "cell_meta").select("meta_id", "batch", F.expr("assigned_cluster % 4").alias("part")).distinct()
    wide = meta.groupBy("batch").pivot("part", [0, 1, 2, 3]).agg(F.count("meta_id"))
    return wide.na.fill(0, ["0", "1", "2", "3"]).select("batch", *[F.col(str(i)).alias(f"n_{i}") for i in range(4)])


def a8_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per batch and cluster class with row, column and grand totals."""
    meta = read_table(spark, sf_dir, "cell_meta").select("meta_id", "batch", F.expr("assigned_cluster % 4").alias("part")).where("batch is not null and part is not null").distinct()
    cube = meta.cube("batch", "part").agg(F.count("meta_id").alias("n"))
    return cube.select(F.coalesce("batch", F.lit("all")).alias("batch"), F.coalesce(F.col("part").cast("string"), F.lit("all")).alias("part"), "n")


def a9_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per typed method spelling, most frequent first."""
    return read_table(spark, sf_dir, "sweep_results").groupBy("method").count().withColumnRenamed("count", "n").orderBy(F.desc("n"), "method")


def a10_pivot_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean errors of the methods side by side, and what adaptation gains."""
    wide = results(spark, sf_dir).groupBy("regime", "mu").pivot("method", METHODS).agg(F.avg("error"))
    return wide.select(
        "regime", "mu", *[F.round(m, 8).alias(m) for m in METHODS], F.round(F.col("adaptive") - F.col("target"), 8).alias("gain_target"), F.round(F.col("adaptive") - F.col("source"), 8).alias("gain_source")
    )


def a11_ordered_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error by method (rows in a fixed order) and regime (fixed columns)."""
    regimes = ["R1", "R2", "R3"]
    place = F.array_position(F.array(*[F.lit(m) for m in METHODS]), F.col("method")).cast("int")
    wide = results(spark, sf_dir).where(F.col("method").isin(METHODS)).groupBy("method").pivot("regime", regimes).agg(F.round(F.avg("error"), 8))
    return wide.withColumn("place", place).orderBy("place")


def a12_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean error per grid cell and whether it is the best of its column, up to rounding."""
    mean = results(spark, sf_dir).groupBy("regime", "mu", "method").agg(F.avg("error").alias("m"))
    best = F.min("m").over(Window.partitionBy("regime", "mu"))
    return mean.select("regime", "mu", "method", F.round("m", 8).alias("mean_error"), (F.abs(F.col("m") - best) <= 1e-8 + 1e-5 * F.abs(best)).alias("is_best"))


def a13_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 98th percentile of the differences between the methods' means."""
    wide = results(spark, sf_dir).groupBy("regime", "mu", "seed").pivot("method", ["adaptive", "target"]).agg(F.avg("error"))
    return wide.groupBy("regime").agg(F.round(F.percentile(F.abs(F.col("adaptive") - F.col("target")), 0.98), 8).alias("p98"))


def a14_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = results(spark, sf_dir).groupBy("regime", "method").agg(F.avg("error").alias("m"))
    return mean.select("regime", "method", F.when(F.col("m") < 0.15, "recovered").otherwise("not recovered").alias("state"))


def a17_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.percentile("value", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, 1.0)]))
    df = expr_rows(spark, sf_dir).groupBy("gene").agg(q.alias("q"))
    return df.select("gene", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q25", "q50", "q75", "q100"))])


def a18_reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and standard error (population) over repetitions."""
    return results(spark, sf_dir).groupBy("regime", "method").agg(F.round(F.avg("error"), 8).alias("mean_error"), F.round(F.stddev_pop("error") / F.sqrt(F.count("error")), 8).alias("se_error"))


def a19_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid cells (regime, seed, method) without any valid result: an anti-join against the grid."""
    raw = read_table(spark, sf_dir, "sweep_results").select("regime", "seed", name_key(F.col("method")).alias("method"))
    axes = raw.select("regime", "seed").distinct()
    grid = axes.select("regime", "seed", F.explode(F.array(*[F.lit(m) for m in METHODS])).alias("method"))
    done = results(spark, sf_dir).select("regime", "seed", "method").distinct()
    return grid.join(done, ["regime", "seed", "method"], "left_anti")


def a20_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = read_table(spark, sf_dir, "gene_data_set").select("cell_id", "dataset", "label").distinct()
    sizes = cells.where("label is not null").groupBy("dataset", "label").agg(F.count("cell_id").alias("n"))
    return sizes.groupBy("dataset").agg(F.count("label").alias("n_labels"), F.min("n").alias("least"), F.max("n").alias("most"), F.round(F.max("n") / F.min("n"), 6).alias("ratio"))


def expr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured values with clean keys, each row once."""
    raw = read_table(spark, sf_dir, "expr").dropDuplicates(["expr_id"])
    rows = raw.select("expr_id", "dataset", name_key(F.col("index")).alias("gene"), name_key(F.col("barcode")).alias("cell"), F.when(F.col("value") > 0, F.col("value")).otherwise(0.0).alias("value"))
    return rows.where("gene <> '' and cell <> ''")


_EXPR = r"""
with rows as (
  select expr_id, any_value(dataset) as dataset, any_value(lower(regexp_replace("index", '^\s+|\s+$', '', 'g'))) as gene,
    any_value(lower(regexp_replace(barcode, '^\s+|\s+$', '', 'g'))) as cell, any_value(case when value > 0 then value else 0.0 end) as value
  from expr group by expr_id),
e as (select * from rows where gene <> '' and cell <> '')
"""


def n3_cell_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with at least 3 genes at 1 or more."""
    from spindrift.operators.filters import cell_filter

    return cell_filter(expr_rows(spark, sf_dir), 3, 1.0)


def n4_gene_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes seen neither in too few nor in too many cells."""
    from spindrift.operators.filters import gene_filter

    return gene_filter(expr_rows(spark, sf_dir), 0.999, 1.0)


def n1_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both filters on the unfiltered matrix, then log2(x + 1)."""
    from spindrift.operators.filters import cell_filter, gene_filter, preprocess

    rows = expr_rows(spark, sf_dir)
    out = preprocess(rows, [cell_filter(rows, 3, 1.0)], [gene_filter(rows, 0.999, 1.0)], lambda v: F.log2(v + 1))
    return out.groupBy("gene").agg(F.count("value").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def n10_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene ids of both datasets, in the order of their first row in the target."""
    from spindrift.operators.filters import matching_ids

    rows = expr_rows(spark, sf_dir)
    return matching_ids(rows.where("dataset = 'source'"), rows.where("dataset = 'target'"), "gene", "expr_id")


def p_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes seen in 10 cells or more; values scaled to 10,000 per cell, log1p; sums per gene."""
    from spindrift.operators.filters import log_normalise, seen_genes

    rows = expr_rows(spark, sf_dir)
    out = log_normalise(rows.join(seen_genes(rows, 10), "gene", "left_semi"), 1e4)
    return out.groupBy("gene").agg(F.round(F.sum("value"), 5).alias("total"), F.count("value").alias("n"))


def p_variable_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 200 genes most variable across datasets: normalised dispersion in each, combined by rank."""
    from spindrift.operators.filters import log_normalise, variable_genes

    return variable_genes(log_normalise(expr_rows(spark, sf_dir), 1e4), "dataset", 200)


def r13_graph_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene vectors joined to the ids of their nodes by symbol (inner)."""
    feas = read_table(spark, sf_dir, "gene_gcn_feas").select("gcn_id", name_key(F.col("symbl")).alias("symbl")).distinct()
    nodes = read_table(spark, sf_dir, "gene_node_id").where("deleted_at is null").select(F.col("index").alias("node"), name_key(F.col("symbl")).alias("symbl")).distinct()
    return feas.where("symbl <> ''").join(nodes, "symbl").select("gcn_id", "symbl", "node")


def r14_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node with the number of its vectors, 0 where it has none (left join, fill)."""
    feas = read_table(spark, sf_dir, "gene_gcn_feas").select("gcn_id", "index").distinct().groupBy("index").agg(F.count("gcn_id").alias("n"))
    nodes = read_table(spark, sf_dir, "gene_node_id").select("index").distinct()
    return nodes.join(feas, "index", "left").na.fill(0, ["n"])


def r15_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of an edge mapped to node ids: cells' two best genes as an edge list, bidirected."""
    from spindrift.operators.graph import bidirect, map_edges

    w = Window.partitionBy("cell").orderBy(F.desc("value"), "gene")
    by_cell = expr_rows(spark, sf_dir).groupBy("cell", "gene").agg(F.max("value").alias("value"))
    best = by_cell.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("cell").agg(F.min("gene").alias("src"), F.max("gene").alias("dst")).where("src <> dst")
    nodes = read_table(spark, sf_dir, "gene_node_id").groupBy(name_key(F.col("symbl")).alias("symbl")).agg(F.min("index").alias("node"))
    return bidirect(map_edges(best.select("src", "dst"), nodes, "symbl", "node"))


def r16_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genes named in all three tables."""
    a = expr_rows(spark, sf_dir).select("gene")
    b = read_table(spark, sf_dir, "gene_gcn_feas").select(name_key(F.col("symbl")).alias("gene"))
    c = read_table(spark, sf_dir, "gene_node_id").select(name_key(F.col("symbl")).alias("gene"))
    return a.intersect(b).intersect(c)


def r18_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of the source that the target lacks, and the other way round."""
    cells = read_table(spark, sf_dir, "gene_data_set").where("label is not null")
    s, t = (cells.where(F.col("dataset") == d).select("label").distinct() for d in ("source", "target"))
    return s.subtract(t).withColumn("only_in", F.lit("source")).unionByName(t.subtract(s).withColumn("only_in", F.lit("target")))


def r19_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint union, sorted and numbered from 0."""
    from spindrift.operators.graph import number_nodes

    return number_nodes(r15_edges(spark, sf_dir))


def r26_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed clusters against registered labels: cells that agree, differ or lack one side (full join)."""
    meta = read_table(spark, sf_dir, "cell_meta").where("deleted_at is null").groupBy(name_key(F.col("barcode")).alias("cell")).agg(F.min("assigned_cluster").alias("a"))
    data = read_table(spark, sf_dir, "gene_data_set").groupBy(name_key(F.col("sample")).alias("cell")).agg(F.min("label").alias("b"))
    state = F.when(F.col("a").isNull() & F.col("b").isNull(), "neither").when(F.col("a").isNull(), "only label").when(F.col("b").isNull(), "only cluster").when(F.col("a") == F.col("b"), "same").otherwise("different")
    return meta.join(data, "cell", "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


def a15_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values scaled to 0..1 per gene (a constant gene gives null), averaged per dataset."""
    rows = expr_rows(spark, sf_dir)
    span = rows.groupBy("gene").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    scaled = rows.join(span, "gene").select("gene", "dataset", F.when(F.col("hi") > F.col("lo"), (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("v"))
    return scaled.groupBy("gene", "dataset").agg(F.round(F.avg("v"), 7).alias("mean_scaled"), F.count(F.lit(1)).alias("n"))


def _dots(spark: SparkSession, sf_dir: str, places: int) -> DataFrame:
    """Expression times gene vector, summed per cell, at the first ``places`` of the vectors' 20 places."""
    ok = F.forall("feas", lambda x: x.isNotNull() & ~F.isnan(x))
    feas = read_table(spark, sf_dir, "gene_gcn_feas").where("deleted_at is null and size(feas) = 20").where(ok).select(name_key(F.col("symbl")).alias("gene"), "gcn_id", "feas")
    feas = feas.groupBy("gene").agg(F.min_by("feas", "gcn_id").alias("feas"))
    rows = expr_rows(spark, sf_dir).where("value > 0").join(feas, "gene")
    sums = [F.round(F.sum(F.col("value") * F.col("feas")[i].cast("double")), 5).alias(f"v{i}") for i in range(places)]
    return rows.groupBy("cell").agg(*sums)


def a16_dot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four places of ``a16_dot_all``."""
    return _dots(spark, sf_dir, 4)


def a16_dot_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expression times gene vector, summed per cell: one value per vector place."""
    return _dots(spark, sf_dir, PLACES)


def i3_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes per regime and state of the body."""
    files = read_table(spark, sf_dir, "task_files")
    state = F.when(F.col("body").isNull(), "null").when(bare(F.col("body")) == "", "empty").otherwise("text")
    return files.groupBy("regime", state.alias("state")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_bytes").alias("n_bytes"), F.max("attempt").alias("last_attempt"))


QUERIES = {
    "a1_mean_se": a1_mean_se,
    "a2_many_columns": a2_many_columns,
    "a3_constant": a3_constant,
    "a4_elapsed": a4_elapsed,
    "a5_seeds": a5_seeds,
    "a6_population": a6_population,
    "a7_contingency": a7_contingency,
    "a8_totals": a8_totals,
    "a9_value_counts": a9_value_counts,
    "a10_pivot_difference": a10_pivot_difference,
    "a11_ordered_pivot": a11_ordered_pivot,
    "a12_best": a12_best,
    "a13_percentile": a13_percentile,
    "a14_flags": a14_flags,
    "a15_min_max": a15_min_max,
    "a16_dot": a16_dot,
    "a16_dot_all": a16_dot_all,
    "a17_quartiles": a17_quartiles,
    "a18_reps": a18_reps,
    "a19_completeness": a19_completeness,
    "a20_categories": a20_categories,
    "i3_bodies": i3_bodies,
    "n1_preprocess": n1_preprocess,
    "n3_cell_filter": n3_cell_filter,
    "n4_gene_filter": n4_gene_filter,
    "n10_matching": n10_matching,
    "pre_normalise": p_normalise,
    "pre_variable_genes": p_variable_genes,
    "r13_graph_ids": r13_graph_ids,
    "r14_left": r14_left,
    "r15_edges": r15_edges,
    "r16_intersection": r16_intersection,
    "r18_difference": r18_difference,
    "r19_numbering": r19_numbering,
    "r26_compare": r26_compare,
}

_NORM = lambda c: f"lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g'))"
_LIST = ", ".join(f"'{m}'" for m in METHODS)
_EDGES = (
    _EXPR
    + f""", g as (select cell, gene, max(value) as value from e group by all),
b as (select cell, gene, row_number() over (partition by cell order by value desc, gene) as rn from g),
p as (select cell, min(gene) as src, max(gene) as dst from b where rn <= 2 group by cell having min(gene) <> max(gene)),
n as (select {_NORM('symbl')} as symbl, min("index") as node from gene_node_id group by 1),
m as (select s.node as src, d.node as dst from p join n s on p.src = s.symbl join n d on p.dst = d.symbl),
edges as (select src, dst from m union select dst, src from m)
"""
)

SQL = {
    "pre_variable_genes": _EXPR
    + """, s as (select cell, sum(value) as total from e group by cell),
v as (select e.dataset, gene, e.cell, case when total > 0 then ln(1 + 1e4 * value / total) else 0.0 end as value from e join s using (cell)),
n as (select dataset, count(distinct cell) as n from v group by 1),
st as (select dataset, gene, sum(value) / any_value(n.n) as mean, sum(value * value) / any_value(n.n) as q from v join n using (dataset) group by 1, 2),
d as (select dataset, gene, mean, case when mean > 0 then (q - mean * mean) / mean end as disp from st),
b as (select *, ntile(20) over (partition by dataset order by mean, gene) as bin from d where disp is not null),
z as (select *, (disp - avg(disp) over w) / nullif(stddev_samp(disp) over w, 0) as norm from b window w as (partition by dataset, bin)),
r as (select *, row_number() over (partition by dataset order by norm desc nulls last, gene) as rank from z)
select gene, count(*) as n_batches, quantile_cont(rank, 0.5) as median_rank from r where rank <= 200 group by gene order by n_batches desc, median_rank, gene limit 200""",
    "a1_mean_se": _RESULTS + "select regime, mu, method, round(avg(error), 8) as mean_error, round(stddev_samp(error) / sqrt(count(error)), 8) as se_error, count(error) as n from results group by all",
    "a2_many_columns": _RESULTS
    + "select regime, method, "
    + ", ".join(f"round(avg({v}), 7) as mean_{v}, round(stddev_samp({v}) / sqrt(count({v})), 7) as se_{v}, count({v}) as n_{v}" for v in ("error", "c0_used", "elapsed_sec"))
    + " from results group by all",
    "a3_constant": _RESULTS + "select regime, mu, round(avg(c0_used), 8) as mean_c0, round(stddev_samp(c0_used), 8) as std_c0, count(c0_used) as n from results where c0_used is not null and not isnan(c0_used) group by all",
    "a4_elapsed": _RESULTS + "select method, branch, round(avg(elapsed_sec), 6) as mean_sec, round(stddev_samp(elapsed_sec), 6) as std_sec from results where elapsed_sec is not null and not isnan(elapsed_sec) group by all",
    "a5_seeds": _RESULTS + "select regime, mu, method, count(distinct seed) as n_seeds from results group by all",
    "a6_population": _RESULTS + "select (seed // 100)::bigint as seed_class, method, round(avg(error), 8) as mean_value, round(stddev_pop(error), 8) as std_value from results group by all",
    "a7_contingency": "with m as (select distinct meta_id, batch, assigned_cluster % 4 as part from cell_meta) select batch, "
    + ", ".join(f"count(meta_id) filter (part = {i}) as n_{i}" for i in range(4))
    + " from m group by batch",
    "a8_totals": "with m as (select distinct meta_id, batch, assigned_cluster % 4 as part from cell_meta where batch is not null and assigned_cluster is not null) "
    "select coalesce(batch, 'all') as batch, coalesce(part::varchar, 'all') as part, count(meta_id) as n from m group by cube (batch, part)",
    "a9_value_counts": "select method, count(*) as n from sweep_results group by method",
    "a10_pivot_difference": _RESULTS
    + ", w as (select regime, mu, "
    + ", ".join(f"avg(error) filter (method = '{m}') as {m}" for m in METHODS)
    + " from results group by all) select regime, mu, "
    + ", ".join(f"round({m}, 8) as {m}" for m in METHODS)
    + ", round(adaptive - target, 8) as gain_target, round(adaptive - source, 8) as gain_source from w",
    "a11_ordered_pivot": _RESULTS
    + "select method, "
    + ", ".join(f"round(avg(error) filter (regime = '{r}'), 8) as {r}" for r in ("R1", "R2", "R3"))
    + f", list_position([{_LIST}], method)::int as place from results where method in ({_LIST}) group by method",
    "a12_best": _RESULTS
    + ", m as (select regime, mu, method, avg(error) as m from results group by all), b as (select *, min(m) over (partition by regime, mu) as best from m) "
    "select regime, mu, method, round(m, 8) as mean_error, abs(m - best) <= 1e-8 + 1e-5 * abs(best) as is_best from b",
    "a13_percentile": _RESULTS
    + ", w as (select regime, mu, seed, avg(error) filter (method = 'adaptive') as a, avg(error) filter (method = 'target') as t from results group by all) "
    "select regime, round(quantile_cont(abs(a - t), 0.98), 8) as p98 from w group by regime",
    "a14_flags": _RESULTS + "select regime, method, case when avg(error) < 0.15 then 'recovered' else 'not recovered' end as state from results group by all",
    "a15_min_max": _EXPR
    + ", s as (select *, min(value) over (partition by gene) as lo, max(value) over (partition by gene) as hi from e) "
    "select gene, dataset, round(avg(case when hi > lo then (value - lo) / (hi - lo) end), 7) as mean_scaled, count(*) as n from s group by all",
    "a16_dot": _EXPR
    + f""", f as (select {_NORM('symbl')} as gene, arg_min(feas, gcn_id) as feas from gene_gcn_feas
      where deleted_at is null and len(feas) = 20 and len(list_filter(feas, lambda x: x is null or isnan(x))) = 0 group by 1)
    select cell, """
    + ", ".join(f"round(sum(value * feas[{i + 1}]::double), 5) as v{i}" for i in range(4))
    + " from e join f using (gene) where value > 0 group by cell",
    "a16_dot_all": _EXPR
    + f""", f as (select {_NORM('symbl')} as gene, arg_min(feas, gcn_id) as feas from gene_gcn_feas
      where deleted_at is null and len(feas) = 20 and len(list_filter(feas, lambda x: x is null or isnan(x))) = 0 group by 1)
    select cell, """
    + ", ".join(f"round(sum(value * feas[{i + 1}]::double), 5) as v{i}" for i in range(PLACES))
    + " from e join f using (gene) where value > 0 group by cell",
    "a17_quartiles": _EXPR + "select gene, " + ", ".join(f"round(quantile_cont(value, {q}), 6) as {n}" for q, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (1.0, "q100"))) + " from e group by gene",
    "a18_reps": _RESULTS + "select regime, method, round(avg(error), 8) as mean_error, round(stddev_pop(error) / sqrt(count(error)), 8) as se_error from results group by all",
    "a19_completeness": _RESULTS
    + f", grid as (select distinct regime, seed, m.method from sweep_results, (select unnest([{_LIST}]) as method) m) select regime, seed, method from grid anti join results using (regime, seed, method)",
    "a20_categories": "with s as (select dataset, label, count(*) as n from (select distinct cell_id, dataset, label from gene_data_set where label is not null) group by all) "
    "select dataset, count(label) as n_labels, min(n) as least, max(n) as most, round(max(n) / min(n), 6) as ratio from s group by dataset",
    "i3_bodies": r"select regime, case when body is null then 'null' when regexp_replace(body, '^\s+|\s+$', '', 'g') = '' then 'empty' else 'text' end as state, count(*) as n_files, sum(n_bytes)::bigint as n_bytes, max(attempt) as last_attempt from task_files group by all",
    "n1_preprocess": _EXPR
    + ", c as (select cell from e where value >= 1 group by cell having count(*) >= 3), tot as (select count(distinct cell) as n from e), "
    "g as (select gene from e, tot group by gene, n having count(distinct cell) filter (value >= 1) >= n * (1 - 0.999) and count(distinct cell) filter (value > 0) <= n * 0.999) "
    "select gene, count(value) as n, round(sum(log2(value + 1)), 6) as total from e semi join c using (cell) semi join g using (gene) group by gene",
    "n3_cell_filter": _EXPR + "select cell from e where value >= 1 group by cell having count(*) >= 3",
    "n4_gene_filter": _EXPR
    + ", tot as (select count(distinct cell) as n from e) select gene from e, tot group by gene, n having count(distinct cell) filter (value >= 1) >= n * (1 - 0.999) and count(distinct cell) filter (value > 0) <= n * 0.999",
    "n10_matching": _EXPR
    + ", t as (select gene, min(expr_id) as first_id from e where dataset = 'target' group by gene), s as (select distinct gene from e where dataset = 'source') "
    "select gene, row_number() over (order by first_id)::bigint - 1 as place from t semi join s using (gene)",
    "pre_normalise": _EXPR
    + ", k as (select gene from e where value > 0 group by gene having count(distinct cell) >= 10), f as (select * from e semi join k using (gene)), "
    "s as (select gene, ln(1 + 1e4 * value / nullif(sum(value) over (partition by cell), 0)) as v from f) "
    "select gene, round(sum(coalesce(v, 0)), 5) as total, count(*) as n from s group by gene",
    "r13_graph_ids": f"with f as (select distinct gcn_id, {_NORM('symbl')} as symbl from gene_gcn_feas), n as (select distinct \"index\" as node, {_NORM('symbl')} as symbl from gene_node_id where deleted_at is null) "
    "select gcn_id, symbl, node from f join n using (symbl) where symbl <> ''",
    "r14_left": 'with f as (select "index", count(distinct gcn_id) as n from gene_gcn_feas group by 1) select distinct d."index", coalesce(n, 0) as n from gene_node_id d left join f on d."index" = f."index"',
    "r15_edges": _EDGES + "select src, dst from edges",
    "r16_intersection": _EXPR + f"select gene from e intersect select {_NORM('symbl')} from gene_gcn_feas intersect select {_NORM('symbl')} from gene_node_id",
    "r18_difference": "with l as (select distinct dataset, label from gene_data_set where label is not null and dataset in ('source', 'target')) "
    "select label, min(dataset) as only_in from l group by label having count(distinct dataset) = 1",
    "r19_numbering": _EDGES + "select node, row_number() over (order by node)::bigint - 1 as place from (select src as node from edges union select dst from edges)",
    "r26_compare": f"with m as (select {_NORM('barcode')} as cell, min(assigned_cluster) as a from cell_meta where deleted_at is null group by 1), d as (select {_NORM('sample')} as cell, min(label) as b from gene_data_set group by 1) "
    "select case when a is null and b is null then 'neither' when a is null then 'only label' when b is null then 'only cluster' when a = b then 'same' else 'different' end as state, count(*) as n "
    "from m full join d on m.cell = d.cell group by 1",
}
