"""The registered queries of the problems tagged llm, with their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import canonical, clusters, cuts, neighbours, packing, sketch, tokens, vectors
from spindrift.session import cut, read_table

#: Relative error of the percentiles.
REL_ERROR = 0.005

#: Elements of a usable express vector.
DIM = 64

#: Least cosine of a near pair, and neighbours per query.
NEAR_COS, K = 0.992, 10

#: Tokens of one container.
CAPACITY = 2048


def day_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of error per regime, method and day of finished_at; each result_id counts once.

    Copies of a result agree, so one value of fixed width stands for each of its
    columns and the deduplication moves three numbers a row.
    """
    raw = read_table(spark, sf_dir, "sweep_results")
    named = raw.select(
        "result_id",
        "regime",
        F.lower(F.regexp_replace("method", r"^\s+|\s+$", "")).alias("method"),
        F.unix_date(F.col("finished_at").cast("date")).alias("day"),
        F.col("error"),
    )
    group = F.xxhash64("regime", "method")
    valid = named.where("error >= 0 and error <= 1").select("result_id", group.alias("code"), F.col("day").cast("long").alias("day"), sketch.bucket_of(F.col("error"), REL_ERROR).alias("bucket"))
    once = valid.groupBy("result_id").agg(F.min("code").alias("code"), F.min(F.shiftleft("day", 32) + F.col("bucket")).alias("at"))
    counts = once.select("code", F.shiftright("at", 32).cast("int").alias("day"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("bucket"))
    counts = counts.groupBy("code", "day", "bucket").agg(F.count(F.lit(1)).alias("n"))
    names = named.groupBy("regime", "method").agg(F.first(group).alias("code"))
    return counts.join(names, "code").select("regime", "method", F.date_format(F.date_from_unix_date("day"), "yyyy-MM-dd").alias("run_day"), "bucket", "n")


def day_and_total(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    days = day_sketches(spark, sf_dir)
    day = sketch.percentiles(days, ["regime", "method", "run_day"], [50, 90], REL_ERROR)
    total = sketch.percentiles(sketch.merge(days, ["regime", "method"]), ["regime", "method"], [50, 90], REL_ERROR)
    return day, total


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    day, total = day_and_total(spark, sf_dir)
    both = day.join(total.select("regime", "method", "pct", F.col("value").alias("_all")), ["regime", "method", "pct"])
    return both.where(F.col("value") >= 1.5 * F.col("_all")).select("regime", "method", "run_day", "pct")


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles 50 and 90 per day, and over all days (run_day 'all')."""
    day, total = day_and_total(spark, sf_dir)
    columns = ["regime", "method", "run_day", "pct", "value", "n"]
    return day.select(columns).unionByName(total.withColumn("run_day", F.lit("all")).select(columns))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, vec): the usable express vectors, scaled to length one."""
    return vectors.unit_vectors(read_table(spark, sf_dir, "gene_data_set"), "cell_id", "express", DIM)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(cells(spark, sf_dir), DIM).select(F.col("id").alias("cell_id"), "cluster_id")


def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, most typical cells and most frequent label of each cluster."""
    labels = read_table(spark, sf_dir, "gene_data_set").groupBy(F.col("cell_id").alias("id")).agg(F.min("label").alias("label"))
    return clusters.describe(cut(clusters.cluster(cells(spark, sf_dir), DIM), "clusters"), labels)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.usable_rows(read_table(spark, sf_dir, "gene_data_set"), "cell_id", "express", DIM)
    pairs = neighbours.near_pairs(rows, NEAR_COS)
    return pairs.select(F.col("id_a").alias("cell_id_a"), F.col("id_b").alias("cell_id_b"))


def p4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most similar cells of every cell whose id is divisible by 100, searched among all cells."""
    all_cells = cut(cells(spark, sf_dir), "cells")
    near = neighbours.nearest(all_cells, all_cells.where("id % 100 = 0"), K)
    return near.select(F.col("id").alias("cell_id"), "neighbour", "rank", "cos")


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the neighbours found in buckets alone, and of ``nearest``, against all cells, by the cosine of the true neighbour.

    Queries are the cells whose id is divisible by 100; ``cos_from`` is the lower end of a range of a tenth.
    """
    all_cells = cut(cells(spark, sf_dir), "cells")
    asked = cut(all_cells.where("id % 100 = 0"), "asked")
    truth = cut(neighbours.scanned_nearest(all_cells, asked, K), "truth")
    by_hash = neighbours.hashed_nearest(all_cells, asked, K).select("id", "neighbour", F.lit(1).alias("_h"))
    both = neighbours.nearest(all_cells, asked, K).select("id", "neighbour", F.lit(1).alias("_n"))
    met = truth.join(by_hash, ["id", "neighbour"], "left").join(both, ["id", "neighbour"], "left")
    per = met.groupBy((F.floor(F.col("cos") * 10) / 10).alias("cos_from")).agg(F.count(F.lit(1)).alias("n_true"), F.count("_h").alias("n_in_buckets"), F.count("_n").alias("n_found"))
    return per.withColumn("recall", F.col("n_found") / F.col("n_true"))


def typed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value, label) of each distinct cell_type that isn't blank."""
    meta = read_table(spark, sf_dir, "cell_meta")
    return canonical.map_values(meta, "cell_type", read_table(spark, sf_dir, "label_mapping_filtered"), "label", "celltype")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = read_table(spark, sf_dir, "cell_meta").select("meta_id", F.col("cell_type").alias("value"))
    # Rows delivered twice agree; should they not, each meta_id still has one label.
    return meta.join(typed_labels(spark, sf_dir), "value").groupBy("meta_id").agg(F.max("label").alias("label"))


def p6_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed values that name no entry, with the number of their rows."""
    meta = read_table(spark, sf_dir, "cell_meta").groupBy(F.col("cell_type").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    return meta.join(typed_labels(spark, sf_dir).where("label = -1").select("value"), "value")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.encode_ids(docs, "text", "ids").select("doc_id", "ids")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return tokens.count_tokens(docs, "text", "size").select(F.col("doc_id").alias("item_id"), "source", "size")


def containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sized_documents(spark, sf_dir), CAPACITY)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = containers(spark, sf_dir)
    return packed.select("container_id", F.col("item_id").alias("doc_id"), "part", F.col("size").alias("n_tokens"), F.col("start").alias("offset"), F.lit(CAPACITY).alias("capacity"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(containers(spark, sf_dir), CAPACITY)


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each source in each window, where the targets are the square roots of the sources' own shares."""
    sized = cut(sized_documents(spark, sf_dir), "sized")
    shares = cut(packing.target_shares(sized, 0.5), "shares")
    return packing.mixture_report(packing.pack(sized, CAPACITY, shares), shares, CAPACITY)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.judge(read_table(spark, sf_dir, "documents")).where("is_cut").select("doc_id")


def p9_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of cut texts per source."""
    return cuts.cut_share(cuts.judge(read_table(spark, sf_dir, "documents")))


def p9_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut texts by their ending and the evidence for the cut."""
    return cuts.evidence_report(cuts.judge(read_table(spark, sf_dir, "documents")))


QUERIES = {
    "p2_found": p2_found,
    "p2_clusters": p2_clusters,
    "p3_found": p3_found,
    "p3_percentiles": p3_percentiles,
    "p4_found": p4_found,
    "p4_nearest": p4_nearest,
    "p4_recall": p4_recall,
    "p6_found": p6_found,
    "p6_unmatched": p6_unmatched,
    "p7_ids": p7_ids,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_mixture": p8_mixture,
    "p9_found": p9_found,
    "p9_share": p9_share,
    "p9_evidence": p9_evidence,
}

_ERRORS = r"""
with results as (
  select result_id, min(regime) as regime, min(lower(regexp_replace(method, '^\s+|\s+$', '', 'g'))) as method,
    min(strftime(finished_at, '%Y-%m-%d')) as run_day, min(error) as error
  from sweep_results where error >= 0 and error <= 1 group by 1),
pcts as (select unnest([50, 90])::int as pct),
per_day as (
  select regime, method, run_day, 50::int as pct, quantile_disc(error, 0.5) as value, count(*) as n from results group by 1, 2, 3
  union all select regime, method, run_day, 90::int, quantile_disc(error, 0.9), count(*) from results group by 1, 2, 3),
total as (
  select regime, method, 50::int as pct, quantile_disc(error, 0.5) as value, count(*) as n from results group by 1, 2
  union all select regime, method, 90::int, quantile_disc(error, 0.9), count(*) from results group by 1, 2)
"""

#: Usable vectors in double precision, one row per cell.
_CELLS = """
with cells as (
  select cell_id, any_value(express)::double[64] as v from gene_data_set
  where len(express) = 64 and len(list_filter(express, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(express, lambda x: x <> 0)) > 0
  group by 1),
pairs as (
  select a.cell_id as a, b.cell_id as b, array_cosine_similarity(a.v, b.v) as cos from cells a join cells b on a.cell_id <> b.cell_id)
"""

#: The exact percentile, moved to the middle of its bucket.
_SNAP = (
    "case when value < 1e-9 then 0.0 else "
    f"2 / ({sketch.gamma(REL_ERROR)!r} + 1) * pow({sketch.gamma(REL_ERROR)!r}, ceil(ln(value) / ln({sketch.gamma(REL_ERROR)!r}))) end as value"
)

SQL = {
    "p2_found": _CELLS + "select a as cell_id, least(a, min(b)) as cluster_id from pairs where cos >= 0.7 group by a",
    "p4_found": _CELLS + "select a as cell_id_a, b as cell_id_b from pairs where a < b and cos >= 0.992",
    "p3_found": _ERRORS
    + "select regime, method, run_day, pct from per_day d join total t using (regime, method, pct) where d.value >= 1.5 * t.value",
    "p3_percentiles": _ERRORS
    + f"select regime, method, run_day, pct, {_SNAP}, n from (from per_day union all by name select *, 'all' as run_day from total)",
}
