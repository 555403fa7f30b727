"""The registered queries of the general problems 1 and 5, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.compaction import CompactionReport, compact, stored_bytes
from spindrift.operators.orphans import Reference, find_orphans
from spindrift.session import cut, read_table, scratch_path
from spindrift.sources.delimited_bodies import read_bodies

#: Size of an output file of the compacted sweep results: the results of 60 k bodies take some 10 MB, so
#: that they come in a handful of ranges; give the block size of the file system for larger sweeps.
TARGET_BYTES = 2 << 20

#: Size of an output file in the report on ranges, which shows several files at every scale.
SMALL_TARGET_BYTES = 16 << 10

#: Clustering keys of the compacted results.
KEYS = ["regime", "seed", "mu_milli", "method"]

#: child table, its row id, reference, parent table
REFERENCES = [
    ("expr", "expr_id", Reference("expr.index", "index", "symbl"), "gene_gcn_feas"),
    ("expr", "expr_id", Reference("expr.barcode", "barcode", "barcode"), "cell_meta"),
    ("gene_gcn_feas", "gcn_id", Reference("gene_gcn_feas.symbl", "symbl", "symbl"), "gene_node_id"),
    ("gene_gcn_feas", "gcn_id", Reference("gene_gcn_feas.index", "index", "index"), "gene_node_id"),
]


def sweep_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines behind the headers of the bodies of task_files: broken ones, repeated headers, and results."""
    files = read_table(spark, sf_dir, "task_files").select("regime", "seed", "body")
    lines = read_bodies(files, "body", ["regime", "seed"], ["method", "branch"], ["mu", "error", "C0_used"], broken="broken")
    return lines.select("regime", "seed", F.round(F.col("mu") * 1000).cast("long").alias("mu_milli"), F.lower("method").alias("method"), "error", "branch", "c0_used", "broken")


def is_result() -> Column:
    return ~F.col("broken") & F.col("mu_milli").isNotNull() & F.col("method").isNotNull()


def distinct_results(lines: DataFrame) -> DataFrame:
    """Each result once.  The lines of one result agree in their values, so the greatest is the one.

    The branch goes through the aggregation as a code of fixed width, so that lines
    are added up by hash before they are moved; the few different branches join
    their codes afterwards.
    """
    rows = lines.where(is_result())
    found = rows.groupBy(*KEYS).agg(F.max("error").alias("error"), F.max(F.when(F.col("branch").isNotNull(), F.xxhash64("branch"))).alias("_code"), F.max("c0_used").alias("c0_used"))
    branches = rows.where("branch is not null").select("branch").distinct().select(F.xxhash64("branch").alias("_code"), "branch")
    return found.join(branches, "_code", "left").select(*KEYS, "error", "branch", "c0_used")


def compacted(spark: SparkSession, sf_dir: str, target_bytes: int = TARGET_BYTES) -> tuple[DataFrame, CompactionReport]:
    """The results of task_files after compaction, and the report on it."""
    path, held = scratch_path(spark, "sweep_results_compacted"), scratch_path(spark, "sweep_results")
    rows = distinct_results(cut(sweep_lines(spark, sf_dir), "sweep_lines"))
    rows.write.parquet(held)
    rows = spark.read.schema(rows.schema).parquet(held)
    report = compact(rows, path, KEYS, target_bytes=target_bytes, total_bytes=stored_bytes(spark, held))
    return spark.read.schema(rows.schema).parquet(report.path), report


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compacted(spark, sf_dir)[0].select(KEYS)


def p1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results and branches per regime, read from the compacted files."""
    df, _ = compacted(spark, sf_dir)
    return df.groupBy("regime").agg(
        F.count(F.lit(1)).alias("n_results"), F.countDistinct("seed").alias("n_seeds"), F.count("branch").alias("n_branch"), F.round(F.avg("error"), 6).alias("mean_error")
    )


def p1_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each compacted file: rows, size, and the first and last key it holds."""
    df, _ = compacted(spark, sf_dir, SMALL_TARGET_BYTES)
    key = F.struct(*KEYS)
    per = df.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
    return per.agg(F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def p1_reconciled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per regime, what the lines of all bodies became: lines = results + repeats + broken + repeated headers, and rows in the compacted files."""
    lines = cut(sweep_lines(spark, sf_dir), "sweep_lines")
    path = scratch_path(spark, "sweep_results_compacted")
    compact(distinct_results(lines), path, KEYS, target_bytes=TARGET_BYTES)
    n = F.count(F.lit(1))
    into = lines.groupBy("regime").agg(n.alias("n_lines"), F.count_if("broken").alias("n_broken"), F.count_if(~F.col("broken") & ~is_result()).alias("n_headers"))
    out = spark.read.parquet(path).groupBy("regime").agg(n.alias("n_results"))
    both = into.join(out, "regime", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0).cast("long")))
    return both.select("regime", "n_lines", "n_broken", "n_headers", "n_results", (F.col("n_lines") - F.col("n_broken") - F.col("n_headers") - F.col("n_results")).alias("n_repeats"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    children: dict[str, tuple] = {}
    for child, row_id, ref, parent in REFERENCES:
        children.setdefault(child, (child, read_table(spark, sf_dir, child), row_id, []))[3].append((ref, read_table(spark, sf_dir, parent)))
    return find_orphans(list(children.values()))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("child", "row_id", "field", "kind")


def p5_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, field, kind and month of loaded_at."""
    month = F.date_format("loaded_at", "yyyy-MM")
    return orphans(spark, sf_dir).groupBy("child", "field", "kind", month.alias("month")).agg(F.count(F.lit(1)).alias("n_orphans"))


QUERIES = {"p1_found": p1_found, "p1_layout": p1_layout, "p1_ranges": p1_ranges, "p1_reconciled": p1_reconciled, "p5_found": p5_found, "p5_by_month": p5_by_month}

_LINES = r"""
with files as (
  select regime, seed, regexp_replace(body, '^\x{FEFF}', '') as body from task_files where body is not null),
cut as (
  select regime, seed, list_filter(string_split_regex(body, '\r\n|\n|\r'), lambda x: trim(x) <> '') as l from files),
head as (
  select regime, seed, l, l[1] as h,
    case when contains(l[1], ';') then ';' when contains(l[1], chr(9)) then chr(9) else ',' end as s
  from cut where len(l) > 1),
lines as (
  select regime, seed, s, list_transform(string_split(lower(h), s), lambda x: trim(replace(x, '"', ''))) as names,
    unnest(l[2:]) as line from head),
fields as (
  select regime, seed, names, list_transform(string_split(line, s), lambda x: trim(trim(replace(x, '"', '')))) as f,
    (length(line) - length(replace(line, '"', ''))) % 2 as open_quote from lines),
vals as (
  select regime, seed,
    round(try_cast(replace(f[list_position(names, 'mu')], ',', '.') as double) * 1000)::bigint as mu_milli,
    nullif(lower(f[list_position(names, 'method')]), '') as method,
    try_cast(replace(f[list_position(names, 'error')], ',', '.') as double) as error,
    nullif(f[list_position(names, 'branch')], '') as branch
  from fields where len(f) = len(names) and open_quote = 0),
told as (
  select regime, seed, len(f) <> len(names) or open_quote <> 0 as broken,
    case when len(f) = len(names) and open_quote = 0 then round(try_cast(replace(f[list_position(names, 'mu')], ',', '.') as double) * 1000)::bigint end as mu_milli,
    nullif(lower(f[list_position(names, 'method')]), '') as method from fields),
results as (
  select regime, seed, mu_milli, method, max(error) as error, max(branch) as branch
  from vals where mu_milli is not null and method is not null group by all)
"""


def _orphan_sql(child: str, row_id: str, field: str, parent: str, parent_field: str) -> str:
    norm = lambda c: f"nullif(lower(regexp_replace({c}::varchar, '^\\s+|\\s+$', '', 'g')), '')"
    return f"""
select '{child}' as child, c.row_id, '{field}' as field, c.loaded_at,
  case when count(p.k) = 0 then 'missing'
       when count(*) filter (p.loaded_at <= c.loaded_at) > 0 then 'deleted' else 'late' end as kind
from (select {row_id} as row_id, {norm(f'"{field}"')} as k, min(loaded_at) as loaded_at from {child} group by all) c
left join (select {norm(f'"{parent_field}"')} as k, loaded_at, deleted_at from {parent}) p on p.k = c.k
where c.k is not null
group by c.row_id, c.k, c.loaded_at
having count(*) filter (p.loaded_at <= c.loaded_at and (p.deleted_at is null or p.deleted_at > c.loaded_at)) = 0"""


_ORPHANS = "with orphans as (" + " union all ".join(_orphan_sql(c, r, ref.child_field, p, ref.parent_field) for c, r, ref, p in REFERENCES) + ")"

SQL = {
    "p1_found": _LINES + "select regime, seed, mu_milli, method from results",
    "p1_layout": _LINES
    + "select regime, count(*) as n_results, count(distinct seed) as n_seeds, count(branch) as n_branch, round(avg(error), 6) as mean_error from results group by regime",
    "p1_reconciled": _LINES
    + """select regime, count(*) as n_lines, count(*) filter (broken) as n_broken,
      count(*) filter (not broken and (mu_milli is null or method is null)) as n_headers,
      count(distinct (seed, mu_milli, method)) filter (not broken and mu_milli is not null and method is not null) as n_results,
      n_lines - n_broken - n_headers - n_results as n_repeats
    from told group by regime""",
    "p5_found": _ORPHANS + " select child, row_id, field, kind from orphans",
    "p5_by_month": _ORPHANS + " select child, field, kind, strftime(loaded_at, '%Y-%m') as month, count(*) as n_orphans from orphans group by all",
}
