"""Edge lists: id mapping on both ends, bidirection, numbering of nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def map_edges(edges: DataFrame, ids: DataFrame, name: str, node: str) -> DataFrame:
    """Edges (src, dst) of names as edges of node ids; edges with an unknown end are dropped."""
    s = ids.select(F.col(name).alias("src"), F.col(node).alias("_s"))
    d = ids.select(F.col(name).alias("dst"), F.col(node).alias("_d"))
    return edges.join(s, "src").join(d, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def bidirect(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, once."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def number_nodes(edges: DataFrame) -> DataFrame:
    """(node, place): all ends of edges in their order, numbered from 0.

    The numbers are a running count over ranges of nodes: the ranges' sizes are
    added up first, so no task orders all nodes.
    """
    nodes = edges.select(F.col("src").alias("node")).union(edges.select(F.col("dst").alias("node"))).distinct()
    cells = nodes.withColumn("_cell", F.shiftright(F.col("node").cast("long"), 16))
    sizes = cells.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = F.row_number().over(Window.partitionBy("_cell").orderBy("node"))
    return cells.withColumn("_inner", inner).join(sizes.select("_cell", before.alias("_before")), "_cell").select("node", (F.col("_before") + F.col("_inner") - 1).alias("place"))
